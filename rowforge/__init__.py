"""rowforge: convert, filter and profile record data on Spark."""

from .api import Options, Stats, consume, deliver, detect_format, process, profile, read
from .operators.stages import Stages
from .operators.transform import Drop, Rename
from .plans.predicate import InvalidWhere, Predicate

__all__ = ["Drop", "InvalidWhere", "Options", "Predicate", "Rename", "Stages", "Stats", "consume", "deliver", "detect_format", "process", "profile", "read"]
