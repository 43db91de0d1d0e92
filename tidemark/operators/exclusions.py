"""Analytics over exclusions: window, filters, orders, roll-ups and the report."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import params as P
from tidemark.functions import text as T
from tidemark.operators.records import edition_day


@dataclass(frozen=True)
class Filters:
    """What exclusions are asked for; a filter that is None lets all pass, the others must all be met.

    ``start`` and ``end`` are inclusive; without ``start`` the window is the ``days`` before its end, without ``end`` it
    ends at ``now``. Nothing after ``now`` is seen.
    """

    now: str
    days: int = 7
    start: str | None = None
    end: str | None = None
    reason: str | None = None
    category: str | None = None
    source_kind: str | None = None
    adapter_id: str | None = None
    item_id: str | None = None
    phase: str | None = None
    min_recurring_editions: int = P.RECURRING_EDITIONS

    @classmethod
    def parse(cls, query: dict[str, str], now: str) -> Filters:
        """From the parameters of a request; ``reason_code`` goes before ``reason``, blank values count as none, numbers must be positive."""
        names = {"from": "start", "to": "end", "reason": "reason", "reason_code": "reason"}
        known = {f.name for f in fields(cls)} - {"now", "start", "end"}
        out: dict[str, object] = {}
        for key in sorted(query, key=lambda k: k == "reason_code"):
            name, value = names.get(key, key), (query[key] or "").strip()
            if not value or name not in known | {"start", "end"}:
                continue
            if name in ("days", "min_recurring_editions"):
                if not value.isdigit() or int(value) < 1:
                    raise ValueError(f"{key} must be a positive whole number")
                out[name] = int(value)
            else:
                out[name] = value
        return cls(now=now, **out)


def in_window(e: DataFrame, f: Filters, column: str = "ts") -> DataFrame:
    now = F.lit(f.now).cast("timestamp_ntz")
    end = F.least(now, F.lit(f.end).cast("timestamp_ntz")) if f.end else now
    start = F.lit(f.start).cast("timestamp_ntz") if f.start else (F.lit(f.end).cast("timestamp_ntz") if f.end else now) - F.expr(f"interval {f.days} days")
    return e.where(F.col(column).between(start, end))


def matching(e: DataFrame, f: Filters) -> DataFrame:
    """The exclusions of the window that meet every filter."""
    e = in_window(e, f)
    if f.reason:
        e = e.where(F.col("reason") == T.reason_code(F.lit(f.reason)))
    if f.phase:
        e = e.where(T.phase(F.col("reason")) == f.phase)
    for column, value in (("category", f.category), ("kind", f.source_kind), ("adapter_id", f.adapter_id), ("item", f.item_id)):
        if value:
            e = e.where(F.col(column) == value)
    return e


def totals(e: DataFrame, f: Filters) -> DataFrame:
    """Scanned editions of the window, whatever the filters, and what matched."""
    scanned = in_window(e, f).agg(F.countDistinct("edition").alias("scanned_editions"))
    m = matching(e, f).agg(F.count(F.lit(1)).alias("exclusions"), F.countDistinct("item").alias("items"), F.countDistinct("edition").alias("matched_editions"))
    return scanned.crossJoin(m)  # a row each


def ranked(e: DataFrame, field: str) -> DataFrame:
    """Values of a field in order: exclusions, then editions, both falling, then the value. There are few, as the field has few values."""
    g = e.groupBy(F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("exclusions"), F.countDistinct("item").alias("items"), F.countDistinct("edition").alias("editions"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("exclusions"), F.desc("editions"), "value")))


def summary(e: DataFrame) -> DataFrame:
    """Counts by category and reason, categories in their order and then reasons; one row a pair of few values."""
    g = e.groupBy("category", "reason").agg(F.count(F.lit(1)).alias("n"))
    place = F.array_position(F.array(*[F.lit(c) for c in P.CATEGORIES]), F.col("category"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.when(place > 0, place).otherwise(99), "category", "reason")))


def rollup(e: DataFrame) -> DataFrame:
    """Totals of categories and of reasons out of the counts of both together: what is grouped once is only added up."""
    pairs = e.groupBy("category", "reason").agg(F.count(F.lit(1)).alias("n"))
    by = lambda c: pairs.groupBy(F.lit(c).alias("by"), F.col(c).alias("value")).agg(F.sum("n").alias("n"))
    return by("category").unionByName(by("reason"))


def consistent(e: DataFrame) -> DataFrame:
    """The totals by category, by reason and by both, and whether they are one number."""
    r = rollup(e)
    t = r.agg(F.sum(F.when(F.col("by") == "category", F.col("n"))).alias("by_category"), F.sum(F.when(F.col("by") == "reason", F.col("n"))).alias("by_reason"))
    both = e.agg(F.count(F.lit(1)).alias("by_both"))
    return t.crossJoin(both).withColumn("consistent", (F.col("by_category") == F.col("by_both")) & (F.col("by_reason") == F.col("by_both")))  # a row each


def report(records: DataFrame, e: DataFrame, f: Filters) -> DataFrame:
    """Every edition of the window with its matching exclusions, zero where none matches."""
    editions = in_window(records, f, "fetched_at").select(edition_day(F.col("fetched_at")).alias("edition")).distinct()
    m = matching(e, f).groupBy("edition").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item").alias("i"), F.countDistinct("reason").alias("r"))
    zero = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return editions.join(m, "edition", "left").select("edition", zero("n", "exclusions"), zero("i", "items"), zero("r", "reasons"))


def decisions(gated: DataFrame) -> DataFrame:
    """Every record kept or dropped, with the phase and the reason."""
    return gated.select("record_id", F.when(F.col("reason").isNull(), "keep").otherwise("drop").alias("decision"), T.phase(F.col("reason")).alias("phase"), "reason")


def with_implied(explicit: DataFrame, gated: DataFrame) -> DataFrame:
    """Explicit exclusions and those that a low score implies for records without one."""
    implied = gated.where(F.coalesce("score", F.lit(0.0)) < P.PUBLICATION_FLOOR).join(explicit.select("record_id"), "record_id", "left_anti")
    return explicit.select("record_id", "reason", F.lit(False).alias("implied")).unionByName(implied.select("record_id", F.lit("relevance_below_threshold").alias("reason"), F.lit(True).alias("implied")))
