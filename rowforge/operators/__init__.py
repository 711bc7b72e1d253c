"""Transforms, stages and profiles over DataFrames."""
