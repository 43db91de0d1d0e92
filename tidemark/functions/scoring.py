"""Relevance and source scores as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import params as P
from tidemark.functions.text import round_half_up


def clamp(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), c.cast("double"))))


def recency(hours: Column) -> Column:
    """100 halved every day, 0 from a week on."""
    return F.when(hours >= P.MAX_AGE_HOURS, 0.0).when(hours.isNotNull(), round_half_up(100 * F.pow(F.lit(0.5), F.greatest(hours, F.lit(0.0)) / P.HALF_LIFE_HOURS)).cast("double"))


def saturating(c: Column, at: float) -> Column:
    """Logarithmic growth that reaches 100 at ``at``."""
    return F.when(c.isNotNull(), clamp(round_half_up(100 * F.log10(F.greatest(c.cast("double"), F.lit(0.0)) + 1) / math.log10(at + 1))))


def github_activity(pushed_days: Column, stars: Column, forks: Column) -> Column:
    base = F.greatest(F.lit(0.0), round_half_up(60 - 3 * pushed_days).cast("double"))
    return clamp(base + F.least(F.lit(25.0), round_half_up(10 * F.log10(stars + 1.0)).cast("double")) + F.least(F.lit(15.0), round_half_up(8 * F.log10(forks + 1.0)).cast("double")))


def relevance(signals: dict[str, Column]) -> Column:
    """Weighted blend over the signals that are not null, with the weights scaled to them; 0 if there is none."""
    total = sum(F.when(c.isNotNull(), P.WEIGHTS[k]).otherwise(0.0) for k, c in signals.items())
    blend = sum(F.when(c.isNotNull(), c * P.WEIGHTS[k]).otherwise(0.0) for k, c in signals.items())
    return F.when(total > 0, clamp(round_half_up(F.round(blend / total, 9)))).otherwise(0.0)


def effective_weight(signals: dict[str, Column], key: str) -> Column:
    total = sum(F.when(c.isNotNull(), P.WEIGHTS[k]).otherwise(0.0) for k, c in signals.items())
    return F.when(signals[key].isNotNull(), round_half_up(P.WEIGHTS[key] / total * 10000) / 10000).otherwise(0.0)


def source_signal(mentions: Column, referrers: Column, platforms: Column, cycles: Column, topics: Column, quality: Column, high: Column) -> Column:
    capped = lambda c, by, most: F.least(c * by, F.lit(most))
    return clamp(
        capped(mentions, 8, 32) + capped(referrers, 9, 27) + capped(platforms, 6, 12) + capped(cycles, 5, 10) + capped(topics, 4, 12)
        + round_half_up(F.round(F.coalesce(quality, F.lit(0.0)) * 0.12, 9)) + capped(high, 4, 12) + 7
    )


def blend(parts: list[tuple[Column, float]]) -> Column:
    """Rounded weighted mean of the parts that are not null; null if there is none."""
    total = sum(F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts)
    got = sum(F.when(c.isNotNull(), c * w).otherwise(0.0) for c, w in parts)
    return F.when(total > 0, clamp(round_half_up(F.round(got / total, 9))))


def activity_input(activity: Column, push_hours: Column, stars_today: Column) -> Column:
    """The activity that is known, else a blend of how recent the last push is and of the stars of the day."""
    return F.coalesce(activity.cast("double"), blend([(recency(push_hours), 0.4), (saturating(stars_today, P.SATURATION["stars_today"]), 0.6)]))


def github_signal(stars: Column, activity: Column) -> Column:
    return blend([(saturating(stars, P.SATURATION["stars"]), P.GITHUB_BLEND["stars"]), (activity, P.GITHUB_BLEND["activity"])])


def trending_activity(stars_today: Column) -> Column:
    return clamp(round_half_up(35 * F.log10(F.coalesce(stars_today, F.lit(0)) + 1.0) + 40))


def logarithmic(c: Column, at: float) -> Column:
    """Logarithmic growth that reaches 100 at ``at`` and goes on beyond; not rounded."""
    return 100 * F.log10(F.greatest(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0)) + 1) / math.log10(at + 1)


def source_authority(citations: Column, stars: Column, activity: Column, adjustment: Column) -> Column:
    """Points for citations, stars and activity; what expertise adds or takes counts for sources that are not new; 0 without any sign."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    points = F.least(32 * zero(citations), F.lit(64)) + round_half_up(logarithmic(stars, P.SATURATION["stars"]) * 0.16) + round_half_up(F.greatest(F.lit(0), F.least(F.lit(100), zero(activity))) * 0.1)
    some = (zero(citations) > 0) | (zero(stars) > 0) | (zero(activity) > 0)
    return F.when(some, clamp(points + zero(adjustment))).otherwise(0.0)


def authority_suffices(score: Column, new: Column, seed: Column) -> Column:
    """New sources need more than others, seeds nothing."""
    need = F.when(new, float(max(P.MIN_SOURCE_AUTHORITY, P.MIN_NEW_SOURCE_AUTHORITY))).otherwise(float(P.MIN_SOURCE_AUTHORITY))
    return F.coalesce(seed, F.lit(False)) | (F.coalesce(score, F.lit(0.0)) >= need)
