"""stratabranch: time-sliced tree and community analytics as long Spark tables."""

__version__ = "0.1.0"
