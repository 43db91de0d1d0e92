"""Queries over what connectors say, exclusions and the discovery of sources, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import ladders
from tidemark.functions import params as P
from tidemark.functions import scoring as S
from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators import cascade, discovery, exclusions, records
from tidemark.plans.queries import _BARE, _CANDIDATE, _GATED, _IGNORED, _LINKS, _SCORED, NOW, _exclusions, _rec, _sat, query
from tidemark.plans.shared import load

# ---- what texts say

_TEXT = "lower(concat_ws(' ', title, summary, array_to_string(coalesce(outbound_urls, []), ' '), array_to_string(coalesce(tags, []), ' ')))"


def _rules(rules) -> str:
    return " ".join(f"when regexp_matches(t, '{p}') then '{name}'" for name, p in rules)


@query(
    f"""with x as (select record_id, source_type, {_TEXT} as t from source_records)
    select record_id, case source_type {" ".join(f"when '{k}' then case {_rules(r)} else 'tool' end" for k, r in P.KIND_CATEGORIES.items())}
      when 'arxiv' then case {" ".join(f"when regexp_matches(t, '{a}') and regexp_matches(t, '{b}') then '{n}'" for n, a, b in P.PAPER_CATEGORIES)} else 'technique' end
      else case {_rules(P.GENERIC_CATEGORIES)} else 'technique' end end as category from x"""
)
def kind_categories(s, d):
    none = F.array().cast("array<string>")
    text = F.concat_ws(" ", "title", "summary", F.array_join(F.coalesce("outbound_urls", none), " "), F.array_join(F.coalesce("tags", none), " "))
    return _rec(s, d).select("record_id", T.kind_category(F.col("source_type"), text).alias("category"))


@query(
    """select source_type, case source_type when 'reddit' then case when coalesce(len(outbound_urls), 0) = 0 then 'medium' else 'low' end
      when 'x' then case when coalesce(len(outbound_urls), 0) = 0 then 'medium' else 'low' end when 'web' then case when source_authority >= 75 then 'low' else 'medium' end else 'low' end as risk,
    count(*) as n from source_records group by 1, 2"""
)
def kind_risks(s, d):
    bare = F.coalesce(F.size(F.filter("outbound_urls", lambda u: F.lit(True))), F.lit(0)) <= 0
    risk = F.when(F.col("source_type").isin("reddit", "x"), F.when(bare, "medium").otherwise("low")).when(F.col("source_type") == "web", F.when(F.col("source_authority") >= 75, "low").otherwise("medium")).otherwise("low")
    return _rec(s, d).groupBy("source_type", risk.alias("risk")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""select doc_id from (select doc_id, lower(text) as t from documents)
    where {" or ".join(f"contains(t, '{k}')" for k in P.AGENT_SIGNALS)} or contains(t, 'agent') and ({" or ".join(f"contains(t, '{k}')" for k in P.AGENT_CONTEXT)})"""
)
def agent_documents(s, d):
    return load(s, d, "documents").where(T.is_about_agents(F.col("text"))).select("doc_id")


@query(
    f"""select paper_id, array_to_string(list_sort(list_distinct(list_filter(['source:arxiv', 'content:paper', 'curation:research', 'arxiv:primary:' || primary_category,
    {", ".join(f"case when regexp_matches(t, '{p}') then '{k}' end" for k, p in P.PAPER_TAGS.items())}], lambda x: x is not null))), ',') as tags from (select *, lower(title || ' ' || summary) as t from arxiv_records)"""
)
def paper_tags(s, d):
    return load(s, d, "arxiv_records").select("paper_id", F.array_join(T.paper_tags(F.concat_ws(" ", "title", "summary"), F.col("primary_category")), ",").alias("tags"))


@query(
    """with n as (select record_id, trim(regexp_replace(summary, '\\s+', ' ', 'g')) as p from source_records), c as (select *, p[1:81] as k, length(regexp_extract(p[1:81], '^(.*)[ :\\-]', 1)) as cut from n)
    select record_id, case when length(p) <= 80 then p else trim(case when cut > 32 then k[1:cut] else k[1:80] end) || '...' end as short from c"""
)
def shortened_summaries(s, d):
    return _rec(s, d).select("record_id", T.shortened(F.col("summary"), 80).alias("short"))


_DIMENSION = ", ".join(f"{{'n': len(list_filter([{', '.join(repr(w) for w in words)}], lambda k: contains(t, k))), 'i': {-i}, 'name': '{name}'}}" for i, (name, words) in enumerate(P.DIMENSIONS.items()))


@query(
    f"""with x as (select source_type, lower(title || ' ' || summary) as t from source_records where trim(title || summary) <> ''), b as (select source_type, list_max([{_DIMENSION}]) as m from x),
    c as (select source_type, case when m.n > 0 then m.name else 'utility' end as dimension, count(*) as n from b group by 1, 2)
    select *, row_number() over (partition by source_type order by n desc, dimension) = 1 as most from c"""
)
def disagreement_dimensions(s, d):
    """Dimensions by source kind with their mode; of equal counts the first in name."""
    from pyspark.sql import Window

    g = _rec(s, d).select("source_type", T.dimension(F.concat_ws(" ", "title", "summary")).alias("dimension")).where("dimension is not null").groupBy("source_type", "dimension").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("most", F.row_number().over(Window.partitionBy("source_type").orderBy(F.desc("n"), "dimension")) == 1)


_NOISE = "|".join(P.TITLE_NOISE)
_ALIAS = "regexp_replace(regexp_replace(nullif(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ''), '^(?:(?:" + _NOISE + ")(?: |$))+', ''), '(?:(?:^| )(?:" + _NOISE + "))+$', '')"


@query(f"""select record_id, a as alias, contains(a, ' ') or length(a) >= 8 as specific from (select record_id, {_ALIAS.format("title")} as a from source_records) where a <> '' and not regexp_full_match(a, '[0-9]+')""")
def identity_aliases(s, d):
    a = _rec(s, d).select("record_id", T.alias(F.col("title")).alias("alias")).where("alias is not null")
    return a.withColumn("specific", T.is_specific(F.col("alias")))


@query(
    f"""with {_LINKS}, q as (select record_id, list_filter(list_transform(string_split(path, '/'), lambda z: lower(trim(z))), lambda z: z <> '') as p from parts where scheme in ('http', 'https')),
    h as (select record_id, len(list_filter(p, lambda z: list_contains({list(P.HIGH_VALUE_SEGMENTS)}, z))) as hi, len(list_filter(p, lambda z: list_contains({list(P.LOW_VALUE_SEGMENTS)}, z))) as lo from q)
    select case when lo > 0 then greatest(-20, 4 * hi - 20) else least(6 * hi, 18) end as quality, count(*) as links from h group by 1"""
)
def path_quality(s, d):
    links = _rec(s, d).select(F.explode("outbound_urls").alias("u")).where(U.is_url(F.col("u")) & F.lower("u").rlike("^\\s*https?:"))
    return links.groupBy(U.path_quality(F.col("u")).alias("quality")).agg(F.count(F.lit(1)).alias("links"))


# ---- scores of code


_PUSH = "greatest(0, floor((floor(epoch(ingested_at)) - floor(epoch(pushed_at))) / 3600e0))"


@query(
    f"""with a as (select record_id, stars, floor(round((0.4e0 * case when {_PUSH} >= 168 then 0e0 else floor(100 * pow(0.5e0, {_PUSH} / 24e0) + 0.5e0) end + 0.6e0 * {_sat("forks", 250)}), 9) + 0.5e0) as activity from github_records)
    select record_id, activity, floor(round(0.6e0 * {_sat("stars", 50000)} + 0.4e0 * activity, 9) + 0.5e0) as github from a where stars is not null and activity is not null"""
)
def github_signal(s, d):
    """Stars and activity blended; activity falls back on the last push and, in place of the stars of the day, the forks."""
    r = load(s, d, "github_records")
    hours = F.greatest(F.lit(0), F.floor((F.unix_timestamp("ingested_at") - F.unix_timestamp("pushed_at")) / 3600.0)).cast("double")
    r = r.withColumn("activity", S.activity_input(F.lit(None), hours, F.col("forks"))).where("stars is not null and forks is not null and pushed_at is not null and ingested_at is not null")
    return r.select("record_id", "activity", S.github_signal(F.col("stars"), F.col("activity")).alias("github"))


@query("select record_id, greatest(0e0, least(100e0, floor(35 * log10(coalesce(forks, 0) + 1e0) + 40 + 0.5e0))) as activity from github_records where channel = 'trending'")
def trending_activity(s, d):
    return load(s, d, "github_records").where("channel = 'trending'").select("record_id", S.trending_activity(F.col("forks")).alias("activity"))


# ---- exclusions


_MORE = _GATED.replace("reason, fetched_at as ts, record_id", "reason, fetched_at as ts, record_id, adapter_id")
_PHASE = "case reason when 'out_of_scope' then 'scope' when 'relevance_below_threshold' then 'scoring' else 'source' end"
_WINDOW = f"ts between timestamp '{NOW}' - interval 400 day and timestamp '{NOW}'"
WINDOW = exclusions.Filters(now=NOW, days=400)


@query(f"with {_MORE} select record_id, case when reason is null then 'keep' else 'drop' end as decision, case when reason is not null then {_PHASE} end as phase, reason from gated")
def exclusion_decisions(s, d):
    return exclusions.decisions(records.gated(_rec(s, d), load(s, d, "sources")))


@query(f"with {_MORE} select record_id, reason from ex where {_WINDOW} and {_PHASE} = 'scoring' and category = 'tool' and kind = 'web' and reason = 'relevance_below_threshold'")
def exclusions_filtered(s, d):
    f = exclusions.Filters.parse({"days": "400", "reason": "x", "reason_code": "Relevance below-threshold", "category": "tool", "source_kind": "web", "phase": "scoring", "adapter_id": " "}, NOW)
    return exclusions.matching(_exclusions(s, d), f).select("record_id", "reason")


@query(f"with {_MORE} select record_id from ex where ts between timestamp '2026-03-01' and timestamp '2026-06-01'")
def exclusions_in_window(s, d):
    return exclusions.in_window(_exclusions(s, d), exclusions.Filters(now=NOW, start="2026-03-01", end="2026-06-01")).select("record_id")


@query(
    f"""with {_MORE} select (select count(distinct edition) from ex where {_WINDOW}) as scanned_editions, count(*) as exclusions, count(distinct item) as items, count(distinct edition) as matched_editions
    from ex where {_WINDOW} and kind = 'reddit'"""
)
def exclusion_scan_totals(s, d):
    return exclusions.totals(_exclusions(s, d), exclusions.Filters(now=NOW, days=400, source_kind="reddit"))


@query(
    f"""with {_MORE}, g as (select adapter_id as value, count(*) as exclusions, count(distinct item) as items, count(distinct edition) as editions from ex group by 1)
    select *, row_number() over (order by exclusions desc, editions desc, value) as rank from g"""
)
def exclusions_ranked(s, d):
    return exclusions.ranked(_exclusions(s, d), "adapter_id")


@query(
    f"""with {_MORE}, g as (select category, reason, count(*) as n from ex group by 1, 2)
    select *, row_number() over (order by coalesce(nullif(list_position({list(P.CATEGORIES)}, category), 0), 99), category, reason) as rank from g"""
)
def exclusion_summary_order(s, d):
    return exclusions.summary(_exclusions(s, d))


@query(f"with {_MORE} select 'category' as by, category as value, count(*) as n from ex group by 2 union all select 'reason', reason, count(*) from ex group by 2")
def exclusion_rollup(s, d):
    return exclusions.rollup(_exclusions(s, d))


@query(f"with {_MORE} select count(*) as by_category, count(*) as by_reason, count(*) as by_both, true as consistent from ex")
def exclusion_totals_agree(s, d):
    return exclusions.consistent(_exclusions(s, d))


@query(
    f"""with {_MORE}, m as (select edition, count(*) as n, count(distinct item) as i, count(distinct reason) as r from ex where {_WINDOW} and phase = 'source' group by 1),
    e as (select distinct cast(fetched_at + interval 3 hour as date) as edition from source_records where {_WINDOW.replace("ts", "fetched_at", 1)})
    select edition, coalesce(n, 0) as exclusions, coalesce(i, 0) as items, coalesce(r, 0) as reasons from e left join m using (edition)""".replace("and phase = 'source'", f"and {_PHASE} = 'source'")
)
def exclusion_report(s, d):
    return exclusions.report(_rec(s, d), _exclusions(s, d), exclusions.Filters(now=NOW, days=400, phase="source"))


@query(
    f"""with {_MORE}, x as (select record_id, reason from gated where reason is not null and reason <> 'relevance_below_threshold')
    select record_id, reason, false as implied from x union all select record_id, 'relevance_below_threshold', true from gated where score < 60 and record_id not in (select record_id from x)"""
)
def implied_exclusions(s, d):
    g = records.gated(_rec(s, d), load(s, d, "sources"))
    return exclusions.with_implied(g.where("reason <> 'relevance_below_threshold'"), g)


# ---- discovery


_SEGMENTS = "list_filter(list_transform(string_split(path, '/'), lambda z: lower(trim(z))), lambda z: z <> '')"
_MENTIONS = f"""{_SCORED}, {_LINKS}, ln as (select record_id, {_BARE} as h, lower(regexp_replace(regexp_extract(path, '^/+([^/]+)', 1), '^@', '')) as a, path, q, scheme from parts where scheme in ('http', 'https')),
  kept as (select *, list_filter(string_split(q, '&'), lambda p: p <> '' and not starts_with(p, 'utm_') and split_part(p, '=', 1) not in ('ref', 'ref_src', 'si')) as k from ln where h not in ({_IGNORED})),
  cu as (select record_id, {_CANDIDATE} as candidate, scheme || '://' || h || path || case when len(k) > 0 then '?' || array_to_string(k, '&') else '' end as url, {_SEGMENTS} as seg, len(list_filter(string_split(path, '/'), lambda z: z <> '')) * 10 + len(k) as spec from kept),
  cq as (select *, case when not starts_with(candidate, 'web:') then 0 when len(list_filter(seg, lambda z: list_contains({list(P.LOW_VALUE_SEGMENTS)}, z))) > 0 then greatest(-20, 4 * len(list_filter(seg, lambda z: list_contains({list(P.HIGH_VALUE_SEGMENTS)}, z))) - 20)
    else least(18, 6 * len(list_filter(seg, lambda z: list_contains({list(P.HIGH_VALUE_SEGMENTS)}, z)))) end as quality from cu where candidate is not null),
  ment as (select record_id, candidate, url, quality, spec, s.source_id as referrer, s.source_type, s.score from (select * from cq qualify row_number() over (partition by record_id, candidate order by spec + quality desc, length(url) desc, url desc) = 1) join scored s using (record_id))"""


@query(f"with {_MENTIONS} select record_id, candidate, url, cast(quality as int) as quality from ment")
def source_mentions(s, d):
    return discovery.mentions(_rec(s, d)).select("record_id", "candidate", "url", "quality")


@query(
    f"""with {_MENTIONS}, iq as (select *, cast(floor(score + quality + least(spec, 30) / 10e0 + 0.5e0) as bigint) as item_quality from ment)
    select candidate, count(*) as mentions, cast(floor(sum(item_quality) * 1e0 / count(*) + 0.5e0) as bigint) as mean_quality, max(item_quality) as best_quality, count(case when score >= 60 then 1 end) as high_signal,
    arg_max(url, (item_quality, spec, url)) as fetch_url, array_to_string(list_sort(list(distinct referrer) filter (where referrer is not null))[1:50], ',') as referrers from iq group by 1"""
)
def source_evidence(s, d):
    e = discovery.evidence(discovery.mentions(_rec(s, d)))
    return e.select("candidate", "mentions", "mean_quality", "best_quality", "high_signal", "fetch_url", F.array_join("referrers", ",").alias("referrers"))


@query(
    f"""with {_MENTIONS}, c as (select candidate, count(*) as citations from ment where (referrer is null or referrer <> candidate) and source_type <> 'web' group by 1)
    select candidate, citations, greatest(0e0, least(100e0, least(32 * citations, 64))) >= case when s.approved_at is null then 58 else 55 end or coalesce(s.seed, false) as eligible
    from c left join sources s on candidate = s.source_id"""
)
def source_authority_score(s, d):
    """Authority by citations alone: the test data have no stars of sources."""
    r = _rec(s, d)
    got = discovery.authority(discovery.mentions(r), load(s, d, "sources"), r, load(s, d, "github_records").limit(0))
    return got.select("candidate", "citations", "eligible")


@query(
    f"""with h as (select distinct source_id, unnest(list_filter([{", ".join(repr(k) for k in P.TOPICAL_KEYWORDS)}], lambda k: contains(lower(title || ' ' || summary), k))) as topic from source_records
      where source_id in (select source_id from sources where status = 'approved' and not coalesce(seed, false))),
    n as (select topic, count(*) as n from h group by 1), t as (select unnest([{", ".join(repr(k) for k in P.TOPICAL_KEYWORDS)}]) as topic)
    select topic, coalesce(n, 0) as active_sources, case when coalesce(n, 0) = 0 then 'blind' when n < 2 then 'fragile' else 'covered' end as status from t left join n using (topic)"""
)
def topic_coverage(s, d):
    return discovery.topic_coverage(_rec(s, d), load(s, d, "sources"))


@query(
    f"""select source_id, array_to_string(list_filter({list(P.CATEGORIES)}, lambda c: list_contains(list(distinct category), c)), ',') as categories from source_records
    where source_id is not null and category is not null group by 1""".replace("list_contains(list(distinct category), c)", "list_contains(cs, c)").replace("from source_records", "from (select source_id, list(distinct category) as cs, 'x' as category from source_records where source_id is not null and category is not null group by 1)").replace("where source_id is not null and category is not null group by 1\n", "").replace(" group by 1)\n    where source_id is not null and category is not null group by 1", " group by 1)")
)
def source_categories(s, d):
    return discovery.category_sets(_rec(s, d))


# ---- lives of sources


_LIVES = f"""{_SCORED}, best as (select source_id, cast(fetched_at + interval 3 hour as date) as cycle, max(score) as best from scored where source_id is not null group by 1, 2),
  days as (select source_id, cast(unnest(generate_series(min(cycle), (select max(cycle) from best), interval 1 day)) as date) as cycle from best group by 1),
  o as (select d.source_id, d.cycle, b.best, coalesce(s.seed, false) as seed, s.status, row_number() over (partition by d.source_id order by d.cycle) as n from days d join sources s using (source_id) left join best b using (source_id, cycle)),
  life(source_id, cycle, n, state, q, low, transition) as (
    select source_id, null::date, 0::bigint, case status when 'approved' then 'probation' when 'retired' then 'retired' else 'candidate' end, []::date[], 0, null::varchar from o where n = 1
    union all
    select source_id, cycle, n, case when seed then 'active' when s3 = 'retired' then s3 else s2 end, case when seed then q when t2 or t3 then [] else q1 end, case when seed then low when t2 or t3 then 0 else low1 end,
      case when seed then null when t3 then 'low_signal' when t2 then 'promoted' when t1 then 'restored' end
    from (select *, s2 in ('probation', 'active') and not t2 and low1 >= 3 as t3, case when s2 in ('probation', 'active') and not t2 and low1 >= 3 then 'retired' else s2 end as s3
    from (select *, s1 = 'probation' and best is not null and len(q1) >= 3 as t2, case when s1 = 'probation' and best is not null and len(q1) >= 3 then 'active' else s1 end as s2
    from (select *, case when s1 = 'probation' and best is not null then list_filter(case when best >= 60 then list_append(q, cycle) else [] end, lambda x: cycle - x < 3) else q end as q1
    from (select o.source_id, o.cycle, o.n, o.best, o.seed, coalesce(o.best >= 60, false) and l.state = 'retired' as t1, case when coalesce(o.best >= 60, false) and l.state = 'retired' then 'probation' else l.state end as s1,
        case when coalesce(o.best >= 60, false) and l.state = 'retired' then [] else l.q end as q, case when coalesce(o.best >= 60, false) then 0 when l.state in ('probation', 'active') then l.low + 1 else l.low end as low1, l.low
      from life l join o on o.source_id = l.source_id and o.n = l.n + 1)))))"""


def _lives(s, d):
    return discovery.lifecycles(discovery.cycles(_rec(s, d), load(s, d, "sources")))


@query(f"with recursive {_LIVES} select source_id, cycle, state, transition from life where n > 0")
def source_lifecycle(s, d):
    return _lives(s, d)


@query(
    f"""with recursive {_LIVES}, m as (select source_id, cycle, transition, lag(state) over w as was, state from life where n > 0 window w as (partition by source_id order by n)), t as (select * from m where transition is not null)
    select source_id, cycle, transition, was, state, lead(cycle) over (partition by source_id order by cycle) as closed_at, row_number() over (partition by source_id order by cycle) as entry from t"""
)
def lifecycle_audit(s, d):
    """Decisions with the state before; a source is not in a state before its first cycle, so a decision on that has none."""
    a = discovery.audit(_lives(s, d))
    return a


@query(
    f"""with recursive {_LIVES}, c as (select distinct source_id, category from source_records where source_id is not null and category is not null),
    a as (select l.source_id, cycle, transition, category from life l join c using (source_id) where n > 0 and (state = 'active' or transition = 'low_signal')),
    g as (select cycle, category, min(source_id) as source_id from a group by 1, 2 having count(*) = 1 and count(case when transition = 'low_signal' then 1 end) = 1),
    b as (select source_id, cycle, array_to_string(list_sort(list(distinct category)), ',') as categories from g group by 1, 2)
    select l.source_id, l.cycle, b.categories, b.categories is not null as blocked from life l left join b using (source_id, cycle) where l.transition = 'low_signal'"""
)
def guarded_retirements(s, d):
    return discovery.guarded_retirements(_lives(s, d), _rec(s, d))


@query(
    """with b as (select source_id, item_id, edition_id, max(relevance_score) as score, max(published_at) as pub from edition_items where relevance_score is not null and source_id is not null group by 1, 2, 3),
    f as (select source_id, item_id, min(pub) as since from b where score >= 60 group by 1, 2),
    p as (select source_id, item_id, arg_min(score, pub) as first, arg_max(score, pub) as latest, count(*) as appearances, count(case when score >= 60 then 1 end) as high, max(pub) as last from b join f using (source_id, item_id) where pub >= since group by 1, 2)
    select source_id, item_id, first, latest, appearances, case when high >= 2 then 'retained' else 'short_lived' end as outcome from p qualify row_number() over (partition by source_id order by last desc, item_id) <= 50"""
)
def tracked_expertise(s, d):
    return discovery.expertise(load(s, d, "edition_items"))


# ---- requests and ladders


@query(
    """with r as (select event_id, case when user_id % 3 = 0 then null else 'app-' || user_id end as declared, 'Bot' || (user_id % 7) || '/1.' || event_id || ' (x; y) lib/2' as agent, '::ffff:10.0.0.' || (event_id % 5) || ', 1.1.1.1' as fwd from events)
    select event_id, 'bot' || regexp_extract(agent, '^Bot(\\d+)', 1) || ' lib' as agent, '10.0.0.' || (event_id % 5) as ip,
    substring(sha256(case when declared is not null then 'declared:' || declared else 'agent:bot' || regexp_extract(agent, '^Bot(\\d+)', 1) || ' lib' end), 1, 16) as consumer_id from r"""
)
def consumer_cascade(s, d):
    """Consumers by declared name, else by the products of their agent; names, agents and addresses are made up from the events."""
    e = load(s, d, "events").select("event_id", F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("app-"), "user_id")).alias("declared"), F.concat(F.lit("Bot"), F.col("user_id") % 7, F.lit("/1."), "event_id", F.lit(" (x; y) lib/2")).alias("agent"), F.concat(F.lit("::ffff:10.0.0."), F.col("event_id") % 5, F.lit(", 1.1.1.1")).alias("fwd"))
    ip = cascade.client_ip(F.col("fwd"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return e.select("event_id", cascade.user_agent(F.col("agent")).alias("agent"), ip.alias("ip"), cascade.identity(F.col("declared"), F.col("agent"), ip).alias("consumer_id"))


@query("select user_id, count(*) as requests, count(case when event_type in ('error', 'click') then 1 end) as throttled, count(distinct event_type) as paths from events group by 1")
def consumer_outcomes(s, d):
    e = load(s, d, "events")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("requests"), F.count(F.when(F.col("event_type").isin("error", "click"), 1)).alias("throttled"), F.countDistinct("event_type").alias("paths"))


@query(
    """with c as (select source_id, (length(source_id) * 7) % 6 as failures from sources)
    select source_id, case when failures <= 0 then 0e0 else least(24e0, pow(2e0, failures - 1)) end as wait_hours, failures >= 3 as retires from c"""
)
def fetch_backoff(s, d):
    """Hours to wait by the number of failures in a row, here made up from the ids; three retire a source."""
    c = load(s, d, "sources").select("source_id", ((F.length("source_id") * 7) % 6).alias("failures"))
    return c.select("source_id", ladders.backoff_hours(F.col("failures")).alias("wait_hours"), (F.col("failures") >= 3).alias("retires"))


@query(
    """select channel, code_language, arg_max(severity, (rank, length(summary), -record_id)) as severity, max(rank) as rank from
    (select *, case when archived then 'high' when license is null then 'medium' else 'low' end as severity, case when archived then 3 when license is null then 2 else 1 end as rank from github_records where summary is not null) group by 1, 2"""
)
def risk_merge(s, d):
    r = load(s, d, "github_records").where("summary is not null").withColumn("severity", F.when(F.col("archived"), "high").when(F.col("license").isNull(), "medium").otherwise("low"))
    g = r.groupBy("channel", "code_language").agg(ladders.worst_risk(F.col("severity"), F.col("summary"), F.col("record_id")).alias("w"))
    return g.select("channel", "code_language", F.col("w.severity").alias("severity"), ladders.severity_rank(F.col("w.severity")).cast("int").alias("rank"))
