"""Queries over the tables of a folder, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import params as P
from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators import connectors, consumers, editions, graph, identity, records, registry, storylines
from tidemark.plans.shared import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The end of the accepted history in the test data.
NOW = "2026-08-31 21:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- SQL that several queries share

_SLUG = "replace(nullif(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ''), ' ', '-')"
_COMPARABLE = "nullif(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), '')"


def _sat(x: str, at: int) -> str:
    return f"case when {x} is not null then greatest(0e0, least(100e0, floor(100 * log10(greatest(({x})::double, 0e0) + 1) / log10({at + 1}e0) + 0.5e0))) end"


_W = P.WEIGHTS
_TOTAL = "(0e0 + " + " + ".join(f"case when {k} is not null then {w}e0 else 0e0 end" for k, w in _W.items()) + ")"
_BLEND = "(0e0 + " + " + ".join(f"case when {k} is not null then {k} * {w}e0 else 0e0 end" for k, w in _W.items()) + ")"
_SCORED = f"""
sig as (
  select *, coalesce(metrics.mentions, 1) as mention_count,
    case when published_at is not null then case when h >= 168 then 0e0 else floor(100 * pow(0.5e0, greatest(h, 0e0) / 24e0) + 0.5e0) end end as recency,
    greatest(0e0, least(100e0, floor(source_authority + 0.5e0))) as authority,
    {_sat("coalesce(metrics.mentions, 1)", 8)} as mentions,
    case when source_type = 'github' then {_sat("metrics.upvotes", 50000)} end as github,
    case when source_type in ('x', 'reddit') then {_sat("metrics.upvotes + metrics.comments + metrics.shares", 1000)} end as social
  from (select *, floor((floor(epoch(fetched_at)) - floor(epoch(published_at))) / 3600e0) as h from source_records)
),
scored as (select *, case when {_TOTAL} > 0 then greatest(0e0, least(100e0, floor(round({_BLEND} / {_TOTAL}, 9) + 0.5e0))) else 0e0 end as score from sig)
"""
_MIN = "case source_type " + " ".join(f"when '{k}' then {max(P.MIN_AUTHORITY, v)}e0" for k, v in P.DESCRIPTOR_MINIMUM.items()) + " else 50e0 end"
_GATED = f"""{_SCORED},
gated as (
  select s.*, case when greatest(s.source_authority, r.authority_score) < {_MIN} then 'source_authority_below_threshold'
    when source_type = 'web' and coalesce(r.status, 'unknown') <> 'approved' then 'source_not_approved'
    when coalesce(r.status, 'unknown') = 'retired' then 'source_retired'
    when score < 60 then 'relevance_below_threshold' end as reason
  from scored s left join sources r on s.source_id = r.source_id
),
ex as (
  select cast(fetched_at + interval 3 hour as date) as edition, coalesce({_SLUG.format("title")}, '-') as item, title as name,
    coalesce(category, 'technique') as category, source_type as kind, reason, fetched_at as ts, record_id
  from gated where reason is not null
)"""
_URL = "'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\\?[^#]*)?(#.*)?$'"


def _u(k: int, c: str = "u") -> str:
    return f"regexp_extract(trim({c}), {_URL}, {k})"


_HOST = "regexp_replace(regexp_replace(lower({h}), '^.*@', ''), case lower({s}) when 'http' then ':(80)?$' when 'https' then ':(443)?$' else ':$' end, '')"
_URLS = f"""
parts as (
  select record_id, source_url as u, lower({_u(1, "source_url")}) as scheme, {_HOST.format(h=_u(2, "source_url"), s=_u(1, "source_url"))} as host, regexp_extract({_u(2, "source_url")}, '^(.*@)', 1) as usr,
    case when {_u(3, "source_url")} = '' then '/' else {_u(3, "source_url")} end as path, regexp_replace({_u(4, "source_url")}, '^\\?', '') as q
  from source_records where regexp_matches(trim(source_url), {_URL}) and {_u(2, "source_url")} <> ''
)"""
_BARE = "regexp_replace(host, '^www\\.', '')"
_TRIM = "case when {0} = '/' then '/' else regexp_replace({0}, '/+$', '') end"


def _q(keep: str) -> str:
    kept = f"list_filter(string_split(q, '&'), lambda p: p <> '' and {keep})"
    return f"case when len({kept}) > 0 then '?' || array_to_string(list_sort({kept}), '&') else '' end"


_UNTRACKED = "not starts_with(lower(split_part(p, '=', 1)), 'utm_') and lower(split_part(p, '=', 1)) not in ('ref', 'source', 's', 't')"
_RESERVED = "('home', 'explore', 'search', 'i', 'intent', 'share', 'hashtag', 'messages', 'notifications', 'settings', 'compose')"
_Q_UNTRACKED = _q(_UNTRACKED)
_CLUSTER = f"case when h in ('x.com', 'twitter.com', 'mobile.twitter.com', 'x.example') then case when a <> '' and a not in {_RESERVED} then 'x:account:' || a else 'x:domain:x' end else h end"


def _rec(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "source_records")


def _exclusions(s: SparkSession, d: str) -> DataFrame:
    return records.exclusions(_rec(s, d), load(s, d, "sources"))


# ---- scores


@query(f"with {_SCORED} select record_id, recency from sig where recency is not null")
def recency_decay(s, d):
    return records.signals(_rec(s, d)).select("record_id", "recency").where("recency is not null")


@query(f"with {_SCORED} select record_id, mentions, github, social from sig")
def log_saturation(s, d):
    return records.signals(_rec(s, d)).select("record_id", "mentions", "github", "social")


@query(
    f"with {_SCORED} select record_id, score, "
    + ", ".join(f"case when {k} is not null then floor({w}e0 / {_TOTAL} * 10000 + 0.5e0) / 10000 else 0e0 end as weight_{k}" for k, w in _W.items())
    + " from scored"
)
def score_breakdown(s, d):
    return records.scored(_rec(s, d)).select("record_id", "score", *[f"weight_{k}" for k in P.WEIGHTS])


@query(f"with {_SCORED} select source_type, count(*) as records, count(case when score >= 60 then 1 end) as published from scored group by 1")
def relevance_gate(s, d):
    g = records.scored(_rec(s, d)).groupBy("source_type")
    return g.agg(F.count(F.lit(1)).alias("records"), F.count(F.when(F.col("score") >= P.PUBLICATION_FLOOR, 1)).alias("published"))


@query(f"with {_GATED} select record_id, coalesce(reason, 'published') as reason from gated")
def source_gate(s, d):
    return records.gated(_rec(s, d), load(s, d, "sources")).select("record_id", F.coalesce("reason", F.lit("published")).alias("reason"))


@query(
    f"""with {_GATED} select cast(row_number() over (order by score desc, source_authority desc, mention_count desc, published_at desc nulls last, fetched_at desc,
    lower(title), source_url, record_id) as bigint) as rank, record_id, score, title from gated where reason is null qualify rank <= 100"""
)
def curated_order_topk(s, d):
    return records.curated_top(_rec(s, d), load(s, d, "sources")).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    """select record_id, cast(greatest(0e0, least(100e0, greatest(0e0, floor(60 - 3 * dd + 0.5e0)) + least(25e0, floor(10 * log10(stars + 1e0) + 0.5e0))
    + least(15e0, floor(8 * log10(forks + 1e0) + 0.5e0)))) as bigint) as activity
    from (select *, greatest(0, floor((floor(epoch(ingested_at)) - floor(epoch(pushed_at))) / 86400e0)) as dd from github_records)"""
)
def github_activity(s, d):
    return connectors.activity(load(s, d, "github_records"))


# ---- exclusions


@query(f"with {_GATED} select reason as value, count(*) as exclusions, count(distinct item) as items, count(distinct edition) as editions from ex group by 1")
def exclusions_by_reason(s, d):
    return records.by_field(_exclusions(s, d), "reason")


@query(f"with {_GATED} select kind as value, count(*) as exclusions, count(distinct item) as items, count(distinct edition) as editions from ex group by 1")
def exclusions_by_source_kind(s, d):
    return records.by_field(_exclusions(s, d), "kind")


@query(f"with {_GATED} select edition as value, count(*) as exclusions, count(distinct item) as items, count(distinct edition) as editions from ex group by 1")
def exclusions_by_edition(s, d):
    return records.by_field(_exclusions(s, d), "edition")


@query(f"with {_GATED} select category, reason, count(*) as exclusions, count(distinct edition) as editions, min(ts) as first_ts, max(ts) as last_ts from ex group by 1, 2")
def exclusions_by_category_reason(s, d):
    return records.by_pair(_exclusions(s, d))


@query(
    f"""with {_GATED} select t.tag as value, count(*) as exclusions from ex join (select record_id, unnest(list_distinct(tags)) as tag from source_records) t using (record_id) group by 1"""
)
def exclusions_by_tag(s, d):
    tags = _rec(s, d).select("record_id", F.explode(F.array_distinct("tags")).alias("value"))
    return _exclusions(s, d).select("record_id").join(tags, "record_id").groupBy("value").agg(F.count(F.lit(1)).alias("exclusions"))


@query(
    f"""with {_GATED} select count(*) as exclusions, count(distinct item) as items, count(distinct edition) as editions, count(distinct category) as categories,
    count(distinct reason) as reasons, count(distinct kind) as kinds from ex"""
)
def exclusion_totals(s, d):
    return records.totals(_exclusions(s, d))


@query(
    f"""with {_GATED} select category, reason, cast(grouping(category) as int) as all_categories, cast(grouping(reason) as int) as all_reasons, count(*) as n
    from ex group by grouping sets ((category), (reason), (category, reason), ())"""
)
def exclusion_summary_sets(s, d):
    return records.summary_sets(_exclusions(s, d))


@query(
    f"""with {_GATED} select item, count(distinct edition) as editions, count(*) as exclusions, arg_max(name, (ts, record_id)) as name,
    array_to_string(list_sort(list(distinct reason)), ',') as reasons from ex group by 1 having count(distinct edition) >= 2"""
)
def recurring_exclusions(s, d):
    return records.recurring(_exclusions(s, d))


@query(f"with {_GATED} select category, reason, count(distinct edition) as editions, count(*) as exclusions from ex group by 1, 2 having count(distinct edition) >= 2")
def blind_spots(s, d):
    return records.blind_spots(_exclusions(s, d))


@query(
    f"""with {_GATED} select cast(fetched_at + interval 3 hour as date) as edition, count(*) as records, count(case when reason is null then 1 end) as published,
    count(reason) as excluded from gated group by 1"""
)
def edition_report(s, d):
    return records.edition_report(_rec(s, d), load(s, d, "sources"))


@query(f"with {_GATED} select record_id from source_records r where not exists (select 1 from ex where ex.record_id = r.record_id)")
def anti_excluded(s, d):
    return _rec(s, d).select("record_id").join(_exclusions(s, d).select("record_id"), "record_id", "left_anti")


# ---- connectors


@query("select record_id from source_records qualify row_number() over (partition by adapter_id, external_id order by record_id) = 1")
def delivered_once(s, d):
    return records.delivered_once(_rec(s, d)).select("record_id")


@query(
    """select lower(regexp_replace(regexp_replace(trim(external_id), '^(?:https?://)?(?:www\\.)?github\\.example/', ''), '(?:\\.git)?/*$', '')) as repository, count(*) as fetches,
    max(stars) as stars, max(forks) as forks, max(pushed_at) as pushed_at, min(created_at) as created_at,
    arg_max(summary, (length(summary), -record_id)) filter (where summary is not null) as summary, array_to_string(list_sort(list(distinct channel)), ',') as channels, bool_or(archived) as archived
    from github_records group by 1"""
)
def repository_merge(s, d):
    return connectors.merged_repositories(load(s, d, "github_records"))


@query(
    """select channel, case when archived then 'high' when channel = 'search' and license is null then 'medium' when channel = 'trending' then 'unknown' else 'low' end as risk,
    count(*) as n from github_records group by 1, 2"""
)
def repository_risk(s, d):
    return connectors.repository_risk(load(s, d, "github_records"))


@query(
    """select regexp_replace(external_id, 'v\\d+$', '') as paper, count(*) as rows, max(v) as version, arg_max(paper_id, (v, paper_id)) as paper_id
    from (select *, coalesce(try_cast(nullif(regexp_extract(external_id, 'v(\\d+)$', 1), '') as int), 1) as v from arxiv_records) group by 1"""
)
def latest_papers(s, d):
    return connectors.latest_papers(load(s, d, "arxiv_records"))


@query(
    """select cast(published_at as date) as day, primary_category, count(*) as papers from arxiv_records
    where published_at between timestamp '2026-01-01' and timestamp '2026-04-01' group by 1, 2"""
)
def paper_window(s, d):
    return connectors.paper_window(load(s, d, "arxiv_records"), "2026-01-01", "2026-04-01")


@query("select record_id, coalesce(s.display_name, r.source_id) as author, s.authority_score from source_records r left join sources s on r.source_id = s.source_id")
def left_join_registry(s, d):
    return connectors.with_authors(_rec(s, d), load(s, d, "sources"))


@query(
    """select source_type, count(*) as records, cast(sum(coalesce(metrics.upvotes + metrics.comments + metrics.shares, 0)) as bigint) as engagement,
    max(source_authority) as authority from source_records group by 1"""
)
def engagement_by_kind(s, d):
    return connectors.authority_of_accounts(_rec(s, d))


@query("select record_id, array_to_string(list_sort(list_distinct(tags)), ',') as tags from source_records where len(tags) > 0")
def distinct_tags(s, d):
    return connectors.tags(_rec(s, d))


@query(
    """with r as (select cast(fetched_at + interval 3 hour as date) as cycle, count(*) as records, list_sort(list(distinct source_type)) as k from source_records group by 1)
    select cycle, records, array_to_string(k, ',') as kinds, array_to_string(list_filter(['arxiv', 'github', 'reddit', 'web', 'x'], lambda z: not list_contains(k, z)), ',') as missing,
    case when len(k) = 5 then 'ok' else 'partial' end as status from r"""
)
def fetch_verification(s, d):
    return registry.fetch_report(_rec(s, d))


@query("select source_type, count(*) as n from (select source_type from source_records union all select 'github' from github_records union all select 'arxiv' from arxiv_records) group by 1")
def union_batches(s, d):
    parts = _rec(s, d).select("source_type"), load(s, d, "github_records").select(F.lit("github").alias("source_type")), load(s, d, "arxiv_records").select(F.lit("arxiv").alias("source_type"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source_type").agg(F.count(F.lit(1)).alias("n"))


# ---- texts and URLs


@query(
    f"""select record_id, {_COMPARABLE.format("title")} as comparable, {_SLUG.format("title")} as slug,
    case when regexp_matches(t, '\\b(api|http api|endpoint)\\b') then 'api' when regexp_matches(t, '\\b(library|sdk|framework|package|gem|npm)\\b') then 'library'
      when regexp_matches(t, '\\b(tool|toolkit|platform|service|cli|app)\\b') then 'tool' else 'technique' end as category,
    array_to_string(list_filter([{", ".join(repr(k) for k in P.TOPICAL_KEYWORDS)}], lambda k: contains(t, k)), ',') as topics
    from (select *, lower(title || ' ' || summary) as t from source_records)"""
)
def text_facts(s, d):
    return connectors.text_facts(_rec(s, d))


_SKIP = "[" + ", ".join(repr(w) for w in dict.fromkeys([*P.STOP_WORDS, *P.UPDATE_WORDS])) + "]"
_MATERIAL = "list_filter(string_split(coalesce({0}, ''), ' '), lambda t: length(t) > 2 and not list_contains(" + _SKIP + ", t) and not regexp_full_match(t, '[0-9]+'))"
_PART = "list_filter(list_transform(string_split_regex(text, '[.!?\\n;:]+'), lambda p: " + _COMPARABLE.format("p") + "), lambda p: p is not null)"


@query(
    f"""select doc_id, count(distinct p) as clauses from (select doc_id, unnest({_PART}) as p from documents) where len({_MATERIAL.format("p")}) >= 2 group by 1"""
)
def fact_clauses(s, d):
    c = load(s, d, "documents").select("doc_id", F.size(T.fact_clauses(F.col("text"))).cast("bigint").alias("clauses"))
    return c.where("clauses > 0")


@query(f"with {_URLS} select record_id, scheme || '://' || usr || host || {_TRIM.format('path')} || {_q('true')} as url from parts")
def canonical_url(s, d):
    return _rec(s, d).select("record_id", U.canonical(F.col("source_url")).alias("url")).where("url is not null")


@query(
    f"""with {_URLS}, n as (select *, {_BARE} as h from parts), c as (select *, case when h in ('github.com', 'github.example') then lower(path) else path end as p2 from n)
    select record_id, scheme || '://' || case when h = 'twitter.com' then 'x.com' else h end || {_TRIM.format("p2")} || {_q(_UNTRACKED)} as key from c"""
)
def dedupe_url_key(s, d):
    return _rec(s, d).select("record_id", U.dedupe_key(F.col("source_url")).alias("key")).where("key is not null")


@query(
    f"""with {_URLS}, k as (select *, list_filter(string_split(q, '&'), lambda p: p <> '' and not starts_with(p, 'utm_') and split_part(p, '=', 1) not in ('ref', 'ref_src', 'si')) as kept from parts)
    select record_id, scheme || '://' || {_BARE} || path || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end as url from k where scheme in ('http', 'https')"""
)
def discovery_url(s, d):
    return _rec(s, d).select("record_id", U.discovery(F.col("source_url")).alias("url")).where("url is not null")


@query(
    f"""with {_URLS}, n as (select *, {_BARE} as h, lower(regexp_replace(regexp_extract(path, '^/+([^/]+)', 1), '^@', '')) as a from parts)
    select {_CLUSTER} as cluster, count(*) as records from n group by 1"""
)
def source_cluster(s, d):
    c = _rec(s, d).select(U.source_cluster(F.col("source_url")).alias("cluster")).where("cluster is not null")
    return c.groupBy("cluster").agg(F.count(F.lit(1)).alias("records"))


@query(
    f"""with {_URLS}, n as (select *, {_BARE} as h from parts)
    select record_id, cast(case when len(list_filter(string_split(q, '&'), lambda p: p <> '' and not ({_UNTRACKED}))) > 0 then 0 else 8 end
      + case when h in ('x.com', 'x.example') or (h in ('github.com', 'github.example') and path = lower(path)) then 4 else 0 end + case when ends_with(path, '/') then 0 else 1 end as bigint) as score,
    cast(10 * len(list_filter(string_split(path, '/'), lambda z: z <> '')) + len(list_filter(string_split(q, '&'), lambda z: z <> '')) as bigint) as specificity from n"""
)
def url_preference(s, d):
    r = _rec(s, d).where(U.is_url(F.col("source_url")))
    return r.select("record_id", U.variant_score(F.col("source_url")).cast("bigint").alias("score"), U.specificity(F.col("source_url")).cast("bigint").alias("specificity"))


_LINKS = _URLS.replace("source_url as u", "source_url as u").replace("from source_records", "from (select record_id, unnest(outbound_urls) as source_url from source_records)")
_CANDIDATE = f"""case when h in ('x.com', 'twitter.com', 'mobile.twitter.com', 'x.example') then 'x:account:' || case when regexp_full_match(a, '[a-z0-9_]{{1,15}}') and a not in {_RESERVED} then a end
    else case when regexp_matches(h, '(?:^|\\.)github\\.') then 'github' when regexp_matches(h, '(?:^|\\.)arxiv\\.') then 'arxiv' when regexp_matches(h, '(?:^|\\.)reddit\\.') then 'reddit' else 'web' end || ':domain:' || h end"""
_IGNORED = ", ".join(repr(x) for x in P.IGNORED_DOMAINS)


@query(
    f"""with {_LINKS}, n as (select *, {_BARE} as h, lower(regexp_replace(regexp_extract(path, '^/+([^/]+)', 1), '^@', '')) as a from parts where scheme in ('http', 'https'))
    select candidate, count(*) as links from (select {_CANDIDATE} as candidate from n where h not in ({_IGNORED})) where candidate is not null group by 1"""
)
def link_candidates(s, d):
    links = _rec(s, d).select(F.explode("outbound_urls").alias("u")).select(U.source_candidate(F.col("u")).alias("candidate")).where("candidate is not null")
    return links.groupBy("candidate").agg(F.count(F.lit(1)).alias("links"))


@query(
    f"""with {_LINKS}, n as (select *, {_BARE} as h, regexp_extract(lower(path), '^/+([^/]+/[^/]+?)(?:\\.git)?(?:/.*)?$', 1) as r from parts)
    select 'https://' || h || '/' || r as repository, count(*) as links from n where h in ('github.com', 'github.example') and r <> '' group by 1"""
)
def repository_links(s, d):
    links = _rec(s, d).select(F.explode("outbound_urls").alias("u")).select(U.repository(F.col("u")).alias("repository")).where("repository is not null")
    return links.groupBy("repository").agg(F.count(F.lit(1)).alias("links"))


# ---- editions

_APP = "app as (select * from edition_items qualify row_number() over (partition by item_id, edition_id order by appearance_id) = 1)"


@query(f"select appearance_id, item_id from edition_items where published_at = (select max(published_at) from edition_items where published_at <= timestamp '{NOW}')")
def latest_edition(s, d):
    return editions.latest_edition(load(s, d, "edition_items"), NOW).select("appearance_id", "item_id")


@query(f"select appearance_id, item_id from edition_items where published_at > timestamp '{NOW}' - interval 7 day and published_at <= timestamp '{NOW}'")
def history_window(s, d):
    return editions.history(load(s, d, "edition_items"), NOW).select("appearance_id", "item_id")


@query(
    f"""with {_APP} select appearance_id, item_id, edition_id, relevance_score, row_number() over w as appearance, round(relevance_score - lag(relevance_score) over w, 4) as from_previous,
    round(relevance_score - first_value(relevance_score) over w, 4) as from_first from app window w as (partition by item_id order by published_at, appearance_id)"""
)
def item_lifecycle(s, d):
    return editions.lifecycle(load(s, d, "edition_items")).withColumn("appearance", F.col("appearance").cast("bigint"))


@query("select appearance_id, item_id, edition_id from edition_items qualify row_number() over (partition by item_id order by published_at desc, appearance_id desc) = 1")
def latest_versions(s, d):
    return editions.latest_versions(load(s, d, "edition_items")).select("appearance_id", "item_id", "edition_id")


@query(
    f"""with {_APP} select appearance_id, item_id, count(*) over w as editions_so_far, min(first_seen) over w as seen_so_far from app
    window w as (partition by item_id order by published_at, appearance_id rows unbounded preceding)"""
)
def tracked_item_state(s, d):
    return editions.tracked_state(load(s, d, "edition_items"))


@query(
    f"""with {_APP}, p as (select *, row_number() over w as n, lag(summary) over w as s0, lag(category) over w as c0 from app window w as (partition by item_id order by published_at, appearance_id))
    select appearance_id, item_id, edition_id from p where n > 1 and (summary is distinct from s0 or category is distinct from c0)"""
)
def consumer_material_change(s, d):
    return editions.material_changes(load(s, d, "edition_items"))


@query(
    f"""with {_APP}, f as (select *, row_number() over (partition by item_id order by published_at, appearance_id) as a, row_number() over (partition by item_id order by published_at desc, appearance_id desc) as z from app)
    select item_id, count(*) as appearances, max(case when a = 1 then relevance_score end) as first_score, max(case when z = 1 then relevance_score end) as last_score,
    round(max(case when z = 1 then relevance_score end) - max(case when a = 1 then relevance_score end), 4) as delta from f group by 1"""
)
def score_history(s, d):
    return editions.score_history(load(s, d, "edition_items"))


_CUT = f"timestamp '{NOW}' - interval 7 day"
_CAND = f"""
old as (select * from edition_items where published_at <= {_CUT} qualify row_number() over (partition by item_id order by published_at desc, appearance_id desc) = 1),
cl as (select appearance_id, count(distinct {_CLUSTER}) as clusters from (select appearance_id, {_BARE} as h, lower(regexp_replace(regexp_extract(path, '^/+([^/]+)', 1), '^@', '')) as a from
  (select appearance_id, {_HOST.format(h=_u(2), s=_u(1))} as host, case when {_u(3)} = '' then '/' else {_u(3)} end as path
   from (select appearance_id, unnest(source_urls) as u from old) where regexp_matches(trim(u), {_URL}) and {_u(2)} <> '')) group by 1),
cand as (select old.*, coalesce(clusters, 0) as clusters from old left join cl using (appearance_id)
  where not exists (select 1 from edition_items e where e.item_id = old.item_id and e.published_at > {_CUT} and e.published_at <= timestamp '{NOW}')),
good as (select * from cand where edition_count >= 3 and relevance_score >= 60)
"""


@query(
    f"""with {_CAND}, strict as (select * from good where clusters >= 2),
    weak as (select * from good where clusters = 1 and category not in (select category from strict)
      qualify row_number() over (partition by category order by relevance_score desc, edition_count desc, published_at desc, appearance_id) = 1)
    select appearance_id, item_id, category, relevance_score, 'strict' as kind from strict union all select appearance_id, item_id, category, relevance_score, 'fallback' from weak"""
)
def reference_index(s, d):
    return editions.references(load(s, d, "edition_items"), NOW)


@query(
    f"""with {_CAND} select category, item_id, relevance_score from cand where relevance_score is not null
    qualify row_number() over (partition by category order by relevance_score desc, edition_count desc nulls last, published_at desc, appearance_id) = 1"""
)
def reference_fallback(s, d):
    return editions.fallback_per_category(load(s, d, "edition_items"), NOW)


@query(f"with {_CAND} select count(*) as shared from (select item_id from edition_items where published_at > {_CUT} and published_at <= timestamp '{NOW}' intersect select item_id from good)")
def history_reference_disjoint(s, d):
    e = load(s, d, "edition_items")
    both = editions.history(e, NOW).select("item_id").intersect(editions.references(e, NOW).select("item_id"))
    return both.agg(F.count(F.lit(1)).alias("shared"))


@query(
    """select item_id, edition_id, max(relevance_score) as score from (select * from edition_items qualify row_number() over (partition by item_id, edition_id order by appearance_id desc) = 1) group by 1, 2"""
)
def editions_by_id_later_wins(s, d):
    e = load(s, d, "edition_items")
    u = editions.union_of_editions(e.where("published_at < '2026-03-01'"), e.where("published_at >= '2026-03-01'"))
    return u.groupBy("item_id", "edition_id").agg(F.max("relevance_score").alias("score"))


@query(f"select cast(epoch(timestamp '{NOW}') - epoch(max(published_at)) as bigint) as age_seconds, epoch(timestamp '{NOW}') - epoch(max(published_at)) >= 93600 as stale from edition_items where published_at <= timestamp '{NOW}'")
def freshness(s, d):
    return consumers.freshness(load(s, d, "edition_items"), NOW)


# ---- sources

_ACTIVE = "select source_id from sources where status = 'approved' and not coalesce(seed, false)"


@query(
    f"""with n as (select category, count(distinct source_id) as n from source_records where category is not null and source_id in ({_ACTIVE}) group by 1)
    select c.category, coalesce(n, 0) as active_sources, case when coalesce(n, 0) = 0 then 'blind' when n < 2 then 'fragile' else 'covered' end as status
    from (select unnest(['tool', 'technique', 'api', 'library']) as category) c left join n using (category)"""
)
def coverage_map(s, d):
    return registry.coverage(_rec(s, d), load(s, d, "sources"))


@query(
    f"""select source_type, category, min(source_id) as source_id from source_records where category is not null and source_id in ({_ACTIVE})
    group by 1, 2 having count(distinct source_id) = 1"""
)
def retirement_guard(s, d):
    return registry.guarded(_rec(s, d), load(s, d, "sources"))


@query(
    f"""with {_SCORED}, {_LINKS.replace("record_id, unnest", "record_id, unnest")},
    n as (select record_id, {_BARE} as h, lower(regexp_replace(regexp_extract(path, '^/+([^/]+)', 1), '^@', '')) as a from parts where scheme in ('http', 'https')),
    c as (select distinct record_id, {_CANDIDATE} as candidate from n where h not in ({_IGNORED})),
    j as (select c.candidate, s.source_id, s.source_type, cast(s.fetched_at + interval 3 hour as date) as cycle, s.score, lower(s.title || ' ' || s.summary) as t from c join scored s using (record_id) where candidate is not null),
    e as (select candidate, count(*) as mentions, count(distinct source_id) as referrers, count(distinct source_type) as platforms, count(distinct cycle) as cycles, sum(score) as score_sum, count(case when score >= 60 then 1 end) as high from j group by 1),
    k as (select candidate, count(distinct w) as topics from (select candidate, unnest(list_filter([{", ".join(repr(k) for k in P.TOPICAL_KEYWORDS)}], lambda z: contains(t, z))) as w from j) group by 1),
    f as (select e.*, greatest(0e0, least(100e0, least(mentions * 8, 32) + least(referrers * 9, 27) + least(platforms * 6, 12) + least(cycles * 5, 10) + least(coalesce(topics, 0) * 4, 12)
      + floor(round(score_sum / mentions * 0.12e0, 9) + 0.5e0) + least(high * 4, 12) + 7)) as signal from e left join k using (candidate))
    select candidate, mentions, referrers, signal, signal >= 45 as eligible from f"""
)
def source_signal_score(s, d):
    return registry.signal_scores(_rec(s, d), load(s, d, "sources"))


@query(
    """with w as (select *, floor(coalesce(authority_score, 0e0) * case status when 'approved' then 1e0 when 'retired' then 0e0 else 0.75e0 end + 0.5e0) as weighted from sources)
    select source_id, status, cast(weighted as bigint) as weighted, row_number() over (order by case status when 'approved' then 0 when 'candidate' then 1 else 2 end, weighted desc, authority_score desc nulls last, source_id) as rank from w"""
)
def source_rank(s, d):
    return registry.ranked(load(s, d, "sources")).withColumn("rank", F.col("rank").cast("bigint"))


_CYCLES = f"{_SCORED}, cyc as (select source_id, cast(fetched_at + interval 3 hour as date) as cycle, max(score) as best from scored where source_id is not null group by 1, 2)"


@query(
    f"""with {_CYCLES}, low as (select *, cycle - cast(row_number() over (partition by source_id order by cycle) as int) as island from cyc where best < 60)
    select source_id, min(cycle) as starts, max(cycle) as ends, count(*) as days from low group by source_id, island having count(*) >= 3"""
)
def low_signal_streak(s, d):
    return registry.low_signal_streaks(_rec(s, d))


@query(
    f"""with {_CYCLES}, q as (select source_id, cycle, count(*) over (partition by source_id order by cycle range between interval 2 day preceding and current row) as n from cyc where best >= 60)
    select source_id, cycle, n from q where n >= 3"""
)
def qualifying_cycles(s, d):
    return registry.qualifying(_rec(s, d))


@query(
    """with b as (select source_id, item_id, edition_id, max(relevance_score) as score from edition_items where relevance_score is not null and source_id is not null group by 1, 2, 3),
    p as (select source_id, item_id, arg_min(score, edition_id) as f, arg_max(score, edition_id) as l, count(*) as n from b group by 1, 2 having arg_min(score, edition_id) >= 60),
    o as (select *, cast(floor((case when n < 2 then -1e0 else case when n >= 3 then 1e0 else 0.5e0 end * case when l < 60 then 0e0 when f <= 60 then 1e0 else greatest(0e0, least(1e0, (l - 60) / (f - 60))) end end) * 10000 + 0.5e0) as bigint) as outcome from p)
    select source_id, count(*) as items, cast(sum(outcome) as bigint) as total, cast(floor(sum(outcome) * 12e0 / (count(*) * 10000) + 0.5e0) as bigint) as adjustment from o group by 1"""
)
def expertise_retention(s, d):
    return registry.expertise(load(s, d, "edition_items"))


# ---- identity

_KEYS = f"""
ku as (select distinct record_id, u from (select record_id, unnest(list_distinct(list_concat([source_url], coalesce(source_urls, [])))) as u from source_records)),
kp as (select record_id, lower({_u(1)}) as scheme, regexp_replace({_HOST.format(h=_u(2), s=_u(1))}, '^www\\.', '') as h,
  case when {_u(3)} = '' then '/' else {_u(3)} end as path, regexp_replace({_u(4)}, '^\\?', '') as q from ku where regexp_matches(trim(u), {_URL}) and {_u(2)} <> ''),
kc as (select *, case when h in ('github.com', 'github.example') then lower(path) else path end as p2 from kp),
keys as (select distinct record_id, scheme || '://' || case when h = 'twitter.com' then 'x.com' else h end || {_TRIM.format("p2")} || {_q(_UNTRACKED)} as key from kc)
"""


@query(f"with {_KEYS} select key, count(*) as records, min(record_id) as first from keys group by 1 having count(*) > 1")
def identity_exact_keys(s, d):
    return identity.shared_keys(_rec(s, d))


@query(
    f"""with recursive {_KEYS}, e as (select distinct a.record_id as a, b.record_id as b from keys a join keys b using (key) where a.record_id <> b.record_id),
    r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
    select a as record_id, least(a, min(b)) as group_id from r group by 1"""
)
def duplicate_clusters(s, d):
    return identity.duplicate_groups(_rec(s, d))


@query(
    f"""with recursive {_KEYS}, e as (select distinct a.record_id as a, b.record_id as b from keys a join keys b using (key) where a.record_id <> b.record_id),
    r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a), g as (select a as record_id, least(a, min(b)) as group_id from r group by 1)
    select group_id, count(*) as members, cast(sum(greatest(coalesce(metrics.mentions, 1), 1)) as bigint) as mentions, max(source_authority) as authority, arg_max(summary, (length(summary), -record_id)) as summary,
    min(published_at) as published_at, min(fetched_at) as fetched_at, array_to_string(list_sort(list(distinct source_type)), ',') as kinds,
    arg_max(record_id, (source_authority, coalesce(metrics.mentions, 1), -record_id)) as primary_id from source_records join g using (record_id) group by 1"""
)
def cluster_consolidation(s, d):
    return identity.consolidated(_rec(s, d))


_TITLE = _MATERIAL.format(_COMPARABLE.format("title"))


@query(
    f"""with t as (select list_sort(list_distinct({_TITLE})) as w, min(paper_id) as paper_id from arxiv_records group by 1 having len(w) >= 2),
    p as (select a.paper_id as a, b.paper_id as b, round(2e0 * len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w)), 6) as dice from t a join t b on a.paper_id < b.paper_id)
    select * from p where dice >= 0.8"""
)
def dice_pairs(s, d):
    return identity.similar_names(load(s, d, "arxiv_records"))


@query(
    """with m as (select source_id, lower(title || ' ' || summary) as t from source_records where source_id is not null and source_type = 'x'),
    g as (select source_id, bool_or(regexp_matches(t, '\\b(broken|buggy|unsafe|malware|scam|concern|regression|fails?|failure|vulnerability)\\b')) as bad,
      bool_or(not regexp_matches(t, '\\b(broken|buggy|unsafe|malware|scam|concern|regression|fails?|failure|vulnerability)\\b')
        and regexp_matches(t, '\\b(launch(?:ed)?|release(?:d)?|available|live|open[- ]source(?:d)?|shipp(?:ed|ing)|new)\\b')) as good, count(*) as n from m group by 1)
    select source_id, concat_ws(',', case when bad then 'negative' end, case when good then 'positive' end) as sentiments, case when bad and good then 'disagree' else 'agree' end as spread from g"""
)
def sentiment_spread(s, d):
    return identity.sentiment(_rec(s, d))


# ---- storylines and graphs


_STORY_STOP = "(" + ", ".join(repr(w) for w in P.STORYLINE_STOP_WORDS) + ")"
_STORY = (
    "case when len(list_filter(string_split({0}, ' '), lambda t: t <> '' and t not in " + _STORY_STOP + " and not regexp_full_match(t, 'v?[0-9]+|rc[0-9]+|beta[0-9]*|alpha[0-9]*'))) > 0"
    " then list_filter(string_split({0}, ' '), lambda t: t <> '' and t not in " + _STORY_STOP + " and not regexp_full_match(t, 'v?[0-9]+|rc[0-9]+|beta[0-9]*|alpha[0-9]*')) else string_split({0}, ' ')[1:3] end"
)
# list_distinct keeps no order, so a token stays where it stands first
_IN_ORDER = "list_filter({0}, lambda z, i: list_position({0}, z) = i)"


@query(
    f"""with n as (select appearance_id, category, {_STORY.format("coalesce(" + _COMPARABLE.format("item_name") + ", " + _COMPARABLE.format("summary") + ", '')")} as t from edition_items)
    select appearance_id, 'storyline-' || case when category in ('tool', 'api', 'library') then 'artifact' else category end || '-' || array_to_string({_IN_ORDER.format("t")}[1:3], '-') as storyline_id from n"""
)
def storyline_id(s, d):
    return storylines.storyline_ids(load(s, d, "edition_items"))


@query(
    """with e as (select n_nationkey as a, n_regionkey + 100 as b from nation) select a::bigint as a, b::bigint as b from e union select b::bigint, a::bigint from e"""
)
def edge_symmetrise(s, d):
    e = load(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("a"), (F.col("n_regionkey") + 100).cast("bigint").alias("b"))
    return graph.symmetric(e)


@query(
    """with recursive p as (select c_custkey as node, c_custkey // 3 as next from customer where c_custkey // 3 <> c_custkey), w(node, pos) as (select node, next from p union all select w.node, p.next from w join p on w.pos = p.node)
    select node, min(pos) as "end" from w group by 1"""
)
def merge_pointer_walk(s, d):
    p = load(s, d, "customer").select(F.col("c_custkey").alias("node"), F.expr("c_custkey div 3").alias("next"))
    return graph.ends_of_chains(p)


# ---- consumers


_REQ = "req as (select event_id, ts, cast(user_id as varchar) as consumer, event_type as path, '10.0.0.' || (cast(json_extract(props, '$.k') as int) % 20) as ip from events)"


@query(
    f"""with {_REQ} select consumer, cast(ts as date) as day, count(*) as requests, count(distinct path) as paths, count(distinct ip) as addresses, min(ts) as first_seen, max(ts) as last_seen from req group by 1, 2"""
)
def consumer_daily_activity(s, d):
    return consumers.daily_activity(load(s, d, "events"))


@query(f"with {_REQ} select ip, count(*) as requests, count(distinct consumer) as consumers from req group by 1")
def ip_consumers(s, d):
    return consumers.per_address(load(s, d, "events"))


@query(f"with {_REQ} select distinct consumer, substring(sha256('declared:' || consumer), 1, 16) as consumer_id from req")
def consumer_identity(s, d):
    return consumers.consumer_ids(load(s, d, "events"))


@query(
    """with recursive o as (select event_id, user_id, ts, row_number() over (partition by user_id order by ts, event_id) as n from events where user_id is not null and ts is not null),
    f as (select event_id, user_id, ts, n, ts + interval 1 day as reset, 1::bigint as c from o where n = 1
      union all select o.event_id, o.user_id, o.ts, o.n, case when f.reset > o.ts then f.reset else o.ts + interval 1 day end, case when f.reset > o.ts then f.c + 1 else 1 end from f join o on o.user_id = f.user_id and o.n = f.n + 1)
    select event_id, user_id, c as in_window, c > 5 as limited from f"""
)
def rate_limit_fixed_window(s, d):
    return consumers.limited(load(s, d, "events"))


@query(
    """with l as (select (ts at time zone 'UTC') at time zone 'America/New_York' as local from events)
    select (((cast(local - interval 21 hour as date))::timestamp + interval 21 hour) at time zone 'America/New_York') at time zone 'UTC' as slot, count(*) as requests from l group by 1"""
)
def publication_slot(s, d):
    return consumers.slots(load(s, d, "events"))


@query(
    """select p_brand as brand, n_name as nation, count(distinct l_suppkey) as suppliers, cast(sum(l_quantity) as bigint) as units
    from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey where p_size > 10 group by 1, 2"""
)
def catalog_multiway_join(s, d):
    j = load(s, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity").join(load(s, d, "part").where("p_size > 10").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    j = j.join(load(s, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(load(s, d, "nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy(F.col("p_brand").alias("brand"), F.col("n_name").alias("nation")).agg(F.countDistinct("l_suppkey").alias("suppliers"), F.sum("l_quantity").cast("bigint").alias("units"))


FLAGSHIP = "edition_report"

from tidemark.plans import curation, stories  # noqa: E402, F401  they register their queries here
