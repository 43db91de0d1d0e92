"""Ordered comparisons: risks, versions, references to a story, delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import params as P
from tidemark.functions import text as T

#: Severities from none to worst.
SEVERITIES = ("unknown", "low", "medium", "high")


def severity_rank(c: Column) -> Column:
    """Place of a severity, 0 for what is unknown."""
    return F.greatest(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.coalesce(F.lower(c), F.lit("unknown"))) - 1, F.lit(0))


def worst_risk(severity: Column, description: Column, place: Column) -> Column:
    """Aggregate: the risk of the highest severity, then of the longest description, then the first; as a struct of severity and description."""
    return F.max_by(F.struct(severity.alias("severity"), description.alias("description")), F.struct(severity_rank(severity), F.length(F.coalesce(description, F.lit(""))), -place))


def version_key(c: Column) -> Column:
    """Numbers of a version, comparable as an array: ``v1.10.0`` is above ``1.9``."""
    return F.transform(F.split(F.regexp_replace(c, r"^[vV]|[-+].*$", ""), r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))


def reference_score(a: Column, b: Column) -> Column:
    """How far two references name one story: equal 1, the start of the other .96, a part of it .92, else by shared tokens."""
    x, y = T.comparable(a), T.comparable(b)
    tx, ty = T.tokens(a), T.tokens(b)
    shared, d = F.size(F.array_intersect(tx, ty)), T.dice(tx, ty)
    starts = F.startswith(F.concat(x, F.lit(" ")), F.concat(y, F.lit(" "))) | F.startswith(F.concat(y, F.lit(" ")), F.concat(x, F.lit(" ")))
    return F.coalesce(
        F.when(x == y, 1.0).when(starts, 0.96).when(F.contains(x, y) | F.contains(y, x), 0.92).when((shared >= 2) & (d >= P.DICE), 0.9).when(d >= 2 / 3 - 1e-9, 0.82), F.lit(0.0)
    )


def backoff_hours(failures: Column, base: float = 1.0, most: float = 24.0) -> Column:
    """Hours to wait after so many failures in a row: doubled each time, up to a day; 0 without a failure."""
    return F.when(failures <= 0, 0.0).otherwise(F.least(F.lit(most), base * F.pow(F.lit(2.0), (failures - 1).cast("double"))))


def fetch_eligible(status: Column, failures: Column, last_failure: Column, now: Column) -> Column:
    """True for an approved source whose wait is over."""
    waited = (F.unix_timestamp(now) - F.unix_timestamp(last_failure)) / 3600.0
    return (status == "approved") & ((F.coalesce(failures, F.lit(0)) == 0) | last_failure.isNull() | (waited >= backoff_hours(F.coalesce(failures, F.lit(0)))))
