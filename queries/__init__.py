"""Registered queries and the SQL each is checked against."""

from .base import ORACLES, QUERIES
from . import count_checks, model_checks, scalar_checks, sky_checks

__all__ = ["ORACLES", "QUERIES"]
