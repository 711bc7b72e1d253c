"""Detection, codecs, readers and writers."""
