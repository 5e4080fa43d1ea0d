"""Spark jobs for hourly gridded moisture climatology."""

__version__ = "0.1.0"
