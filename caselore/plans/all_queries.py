"""Imports every query module so that the registry is complete."""

from . import answer_queries, base_queries, history_queries, profile_queries, search_queries, stream_queries  # noqa: F401
from .registry import CHECKS, QUERIES  # noqa: F401
