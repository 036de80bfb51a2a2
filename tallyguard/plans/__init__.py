"""Queries: each module registers its own when it is imported."""

from . import calibration, checks, claims, consistency, dates, duplicates, feedback, gates, geo_rules, learning, lines, names, profiles, rules, scoring, streams, telemetry, text, tokens  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
