"""One surviving record per group of records about the same thing, field by field.

Fields are unpivoted to long rows, each row votes for its normalised value with
trust times recency decay, votes are summed per value, winners are chosen with
``max_by`` and the fields are pivoted back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.params import CODE_HOSTS

#: Texts that stand where a licence is missing.
NO_LICENSE = ["", "-", "--", "n/a", "na", "nil", "no license", "noassertion", "none", "not specified", "null", "other", "see license", "tbd", "todo", "undefined", "unknown", "unlicensed", "?"]
#: Other spellings of a licence, in lower case without "license" and "the".
LICENSE_NAMES = {
    "apache 2.0": "apache-2.0",
    "apache version 2.0": "apache-2.0",
    "apache2": "apache-2.0",
    "gnu general public v3.0": "gpl-3.0",
    "gnu affero general public v3.0": "agpl-3.0",
    "mozilla public 2.0": "mpl-2.0",
    "bsd 3-clause": "bsd-3-clause",
}

_EDGE = r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE, "")


def host_pattern(hosts: tuple[str, ...]) -> str:
    return "(?:" + "|".join(h.replace(".", r"\.") for h in hosts) + ")"


def repository_key(c: Column, hosts: tuple[str, ...] = CODE_HOSTS) -> Column:
    """``owner/name`` in lower case of an identifier or URL of a repository on one of ``hosts``; null if it names none."""
    path = F.regexp_replace(F.lower(_trim(c)), r"^(?:git\+)?(?:[a-z][a-z+.]*://)?(?:[^/@\s]+@)?(?:www\.)?" + host_pattern(hosts) + r"(?::\d+/|[:/])/*", "")
    path = F.regexp_replace(path, r"[?#].*$", "")
    got = F.regexp_extract(path, r"^/*([^/\s:]+)\s*/+\s*([^/\s:]+?)(?:\.git)?(?:/.*)?$", 0)
    owner = F.regexp_extract(path, r"^/*([^/\s:]+)\s*/+\s*([^/\s:]+?)(?:\.git)?(?:/.*)?$", 1)
    name = F.regexp_extract(path, r"^/*([^/\s:]+)\s*/+\s*([^/\s:]+?)(?:\.git)?(?:/.*)?$", 2)
    return F.when(got != "", F.concat(owner, F.lit("/"), name))


def license_value(c: Column) -> Column:
    """One spelling per licence; null if the text does not say which licence it is."""
    low = F.lower(_trim(c))
    short = _trim(F.regexp_replace(F.regexp_replace(low, r"\b(?:the|licen[sc]e)\b", " "), r"[\s,]+", " "))
    names = F.coalesce(*[F.when(short == k, F.lit(v)) for k, v in LICENSE_NAMES.items()], short)
    return F.when(~low.isin(NO_LICENSE) & ~short.isin(NO_LICENSE), names)


def homepage_value(c: Column) -> Column:
    """Host and path without scheme, ``www.`` and trailing slash; null if no host but the local machine is named."""
    low = _trim(c)
    rest = F.regexp_replace(low, r"^(?i:https?:)?//(?:[^/@?#\s]*@)?", "")
    host = F.lower(F.regexp_extract(rest, r"^(\[[0-9A-Fa-f:.]+\]|[^/:?#\s\[\]]+)(?::\d+)?(?:[/?#]\S*)?$", 1))
    host = F.regexp_replace(host, r"\.$", "")
    named = host.rlike(r"^(?:[\p{L}\p{N}_](?:[\p{L}\p{N}_-]*[\p{L}\p{N}_])?\.)+\p{L}[\p{L}\p{N}-]*$") | host.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$") | host.rlike(r"^\[[0-9a-f:.]+\]$")
    local = host.rlike(r"^(?:127\.|0\.0\.0\.0$|\[::1?\]$)") | host.rlike(r"(?:^|\.)(?:localhost|localdomain|local)$")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]+([/?#]?.*)$", 1), r"/+$", "")
    return F.when((host != "") & named & ~local, F.concat(F.regexp_replace(host, r"^www\.", ""), path))


FIELDS = ["license", "homepage", "fetched_at"]


def surviving_fields(records: DataFrame, decide: str = "votes", half_life_days: float = 90.0) -> DataFrame:
    """The surviving value of each field of each repository.

    Returns ``entity_key, field_name, rows, record_id, value, original, seen_at, votes, share``: ``rows`` counts the
    records of the repository, ``record_id`` is the row whose value survives, ``votes`` the summed trust times decay of
    all rows that agree with it and ``share`` its part of all votes of the field.

    ``decide="votes"`` chooses the value with the most votes, to nine digits; ``"trust"`` the value of the row with the
    highest trust, as TESTDATA.md orders them: by trust, then by valid ``fetched_at``, then by the smaller ``record_id``.
    That order also settles even votes, and chooses the row among those with the surviving value. A ``fetched_at`` that is null, before
    ``created_at`` or after ``ingested_at`` is not valid: it ranks last and votes without a decay bonus (weight 0.25).
    Rows without a repository key are left out; a null ``record_id`` loses to any other; null trust counts as 0 in
    votes and ranks last; repeated rows each vote; an empty table gives an empty result. Every aggregate is combined
    before its shuffle, so that a repository with a third of all rows is no hot task.
    """
    seen = F.col("fetched_at").cast("timestamp_ntz")
    valid = seen.isNotNull() & ~F.coalesce(seen < F.col("created_at"), F.lit(False)) & ~F.coalesce(seen > F.col("ingested_at"), F.lit(False))
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(F.col("ingested_at")) - F.unix_timestamp(seen)) / 86400.0)
    base = records.select(
        repository_key(F.col("external_id")).alias("entity_key"),
        F.col("record_id").cast("bigint").alias("record_id"),
        F.col("source_authority").cast("double").alias("trust"),
        F.when(valid, seen).alias("seen"),
        F.when(valid, F.pow(F.lit(0.5), F.coalesce(age, F.lit(0.0)) / half_life_days)).otherwise(0.25).alias("decay"),
        license_value(F.col("license")).alias("license"),
        F.col("license").alias("license_raw"),
        homepage_value(F.col("homepage")).alias("homepage"),
        F.col("homepage").alias("homepage_raw"),
    ).where("entity_key is not null")
    long = base.selectExpr(
        "entity_key", "record_id", "trust", "seen", "decay",
        "stack(3, 'license', license, license_raw, 'homepage', homepage, homepage_raw,"
        " 'fetched_at', date_format(seen, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"), cast(seen as string)) as (field_name, value, original)",
    )
    # null trust, time and id rank below all others; structs compare field by field
    rank = F.struct(
        F.coalesce("trust", F.lit(float("-inf"))).alias("trust"),
        F.coalesce("seen", F.lit("0001-01-01").cast("timestamp_ntz")).alias("seen"),
        (-F.coalesce("record_id", F.lit(2**63 - 1))).alias("id"),
    )
    per_value = long.groupBy("entity_key", "field_name", "value").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.coalesce("trust", F.lit(0.0)) * F.col("decay")).alias("votes"),
        F.max_by(F.struct("record_id", "original", "seen"), rank).alias("row"),
        F.max(rank).alias("rank"),
    )
    if decide not in ("votes", "trust"):
        raise ValueError("decide by votes or trust")
    usable = F.col("value").isNotNull()
    key = F.struct(F.round("votes", 9), "rank", "value") if decide == "votes" else F.struct("rank", "value")
    best = per_value.groupBy("entity_key", "field_name").agg(
        F.sum("rows").alias("rows"),
        F.max_by(F.struct("row", "value", "votes"), F.when(usable, key)).alias("best"),
        F.sum(F.when(usable, F.col("votes"))).alias("all_votes"),
        F.max(usable).alias("any"),
    )
    return best.where("any").select(
        "entity_key", "field_name", "rows", F.col("best.row.record_id").alias("record_id"), F.col("best.value").alias("value"),
        F.col("best.row.original").alias("original"), F.col("best.row.seen").alias("seen_at"),
        F.round("best.votes", 6).alias("votes"), F.round(F.col("best.votes") / F.nullif(F.col("all_votes"), F.lit(0.0)), 6).alias("share"),
    )


def golden_records(records: DataFrame, decide: str = "votes") -> DataFrame:
    """One record per repository: its surviving ``license``, ``homepage`` and ``fetched_at``, with the share of votes behind each and the row that has it.

    ``rows`` counts the rows of the repository. A field that no row has is null, as are its share and row.
    """
    wide = surviving_fields(records, decide).groupBy("entity_key").pivot("field_name", FIELDS)
    wide = wide.agg(F.max("value").alias("value"), F.max("share").alias("share"), F.max("record_id").alias("record"), F.max("rows").alias("rows"))
    return wide.select(
        "entity_key", F.greatest(*[F.col(f"{f}_rows") for f in FIELDS]).alias("rows"), *[F.col(f"{f}_value").alias(f) for f in FIELDS], *[F.col(f"{f}_share").alias(f"{f}_share") for f in FIELDS],
        *[F.col(f"{f}_record").alias(f"{f}_record") for f in FIELDS],
    )


def found(records: DataFrame) -> DataFrame:
    """p1_found: the row whose licence or homepage survives, for each repository of two or more rows."""
    g = golden_records(records, "trust").where("rows >= 2")
    return g.selectExpr("entity_key", "stack(2, 'license', license_record, 'homepage', homepage_record) as (field_name, record_id)").where("record_id is not null")
