"""Relational operators over DataFrames."""

from .aggregates import *  # noqa: F403
from .joins import *  # noqa: F403
