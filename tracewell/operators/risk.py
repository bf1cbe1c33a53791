"""Risk scores and verdicts as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed weights and thresholds.
FILES, FUNCTIONS, REQUIREMENTS, POLICIES = 2, 1, 4, 3
HIGH, MODERATE = 20, 8


def score(files: Column, functions: Column, requirements: Column, policies: Column) -> Column:
    return FILES * files + FUNCTIONS * functions + REQUIREMENTS * requirements + POLICIES * policies


def severity(points: Column) -> Column:
    return F.when(points >= HIGH, "high").when(points >= MODERATE, "moderate").otherwise("low")


def rationale(files: Column, functions: Column, requirements: Column, policies: Column) -> Column:
    return F.format_string("files=%d, functions=%d, violated_requirements=%d, enforced_policies=%d", files, functions, requirements, policies)


def report_verdict(authorized: Column, violated: Column, missing: Column, worst: Column) -> Column:
    """block if unauthorized or anything is violated, warn if files are missing or the risk is moderate, else pass."""
    return F.when(~authorized | (violated > 0), "block").when((missing > 0) | (worst >= MODERATE), "warn").otherwise("pass")
