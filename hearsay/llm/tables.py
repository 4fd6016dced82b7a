"""Intermediate tables of the corpus operators."""

from hearsay.sources.scratch import discard, written

__all__ = ["discard", "written"]
