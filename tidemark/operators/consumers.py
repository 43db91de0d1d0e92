"""Requests of consumers: activity, identity, rate limit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import params as P


def requests(events: DataFrame) -> DataFrame:
    """Events as requests: the user is the declared consumer, the event type the path, ``props.k`` the last part of the address."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select("event_id", "ts", F.col("user_id").cast("string").alias("consumer"), F.col("event_type").alias("path"), F.concat(F.lit("10.0.0."), k % 20).alias("ip"))


def daily_activity(events: DataFrame) -> DataFrame:
    return requests(events).groupBy("consumer", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("requests"), F.countDistinct("path").alias("paths"), F.countDistinct("ip").alias("addresses"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    )


def per_address(events: DataFrame) -> DataFrame:
    return requests(events).groupBy("ip").agg(F.count(F.lit(1)).alias("requests"), F.countDistinct("consumer").alias("consumers"))


def consumer_ids(events: DataFrame) -> DataFrame:
    """Stable consumer id: the first 16 digits of the hash of what identifies it."""
    r = requests(events).select("consumer").distinct()
    return r.select("consumer", F.substring(F.sha2(F.concat(F.lit("declared:"), F.col("consumer")), 256), 1, 16).alias("consumer_id"))


def _runs(r: DataFrame, window_s: int) -> DataFrame:
    """``user_id, bucket, run``: parts of a user's requests between which a window must have ended.

    A window of time is one row a user; where the first request of one comes later than a window after the last of the one
    before, nothing is carried over, so the parts can be counted apart.
    """
    span = F.expr(f"interval {window_s} seconds")
    b = r.groupBy("user_id", "bucket").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    w = Window.partitionBy("user_id").orderBy("bucket")
    opens = F.coalesce(F.col("first") >= F.lag("last").over(w) + span, F.lit(True))
    return b.withColumn("opens", opens.cast("int")).select("user_id", "bucket", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))


def limited(events: DataFrame, window_s: int = 86_400, most: int = 5, key: Column | str = "user_id") -> DataFrame:
    """Fixed window per consumer that opens with its first request after the last has ended.

    ``key`` says whose requests are counted together. Requests stream through sorted by consumer and time; a limited request
    still counts. One window is held at a time, and a consumer's requests are split where no window reaches across.
    """
    r = events.select("event_id", (F.col(key) if isinstance(key, str) else key).alias("user_id"), "ts").where("user_id is not null and ts is not null")
    r = r.withColumn("bucket", F.floor(F.unix_timestamp("ts") / window_s))
    r = r.join(_runs(r, window_s), ["user_id", "bucket"]).repartition("user_id", "run").sortWithinPartitions("user_id", "run", "ts", "event_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, count, reset = None, 0, None
        span = pd.Timedelta(seconds=window_s)
        for b in batches:
            counts, flags = [], []
            for *u, t in zip(b["user_id"], b["run"], b["ts"]):
                if u != now or reset is None or not reset > t:
                    now, count, reset = u, 0, t + span
                count += 1
                counts.append(count)
                flags.append(count > most)
            yield pd.DataFrame({"event_id": b["event_id"], "user_id": b["user_id"], "in_window": counts, "limited": flags})

    return r.mapInPandas(fold, "event_id bigint, user_id bigint, in_window bigint, limited boolean")


def freshness(items: DataFrame, now: str) -> DataFrame:
    """Age of the newest edition in seconds and whether it is stale."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.max("published_at"))
    return items.where(F.col("published_at") <= F.lit(now).cast("timestamp")).agg(age.alias("age_seconds"), (age >= P.STALE_HOURS * 3600).alias("stale"))


def slots(events: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """The publication slot each time belongs to: the last slot hour in local time at or before it, as UTC; requests per slot."""
    local = F.from_utc_timestamp("ts", zone)
    day = F.to_date(local - F.expr(f"interval {P.SLOT_HOUR} hours"))
    slot = F.to_utc_timestamp(F.to_timestamp(day) + F.expr(f"interval {P.SLOT_HOUR} hours"), zone)
    return events.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("requests"))


def plan(events: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """``event_id, slot, before, after, in_grace``: the last slot at or before a time, those a local day earlier and later, and whether the time is within its grace."""
    local = F.from_utc_timestamp("ts", zone)
    day = F.to_date(local - F.expr(f"interval {P.SLOT_HOUR} hours"))
    at = lambda d: F.to_utc_timestamp(F.to_timestamp(d) + F.expr(f"interval {P.SLOT_HOUR} hours"), zone)
    late = F.unix_timestamp("ts") - F.unix_timestamp(at(day))
    return events.select("event_id", at(day).alias("slot"), at(F.date_sub(day, 1)).alias("before"), at(F.date_add(day, 1)).alias("after"), late.between(0, P.GRACE_MINUTES * 60).alias("in_grace"))
