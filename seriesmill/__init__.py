"""Explore, compact and export large series with Spark DataFrames."""

from .plans.job import Affine, Job, JobError, Span
from .plans.process import process

__all__ = ["Affine", "Job", "JobError", "Span", "process"]
