"""Spark operators for building and judging labelled text corpora."""

from labelmill.config import Split

__all__ = ["Split"]
