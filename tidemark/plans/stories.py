"""Queries over identity and storylines, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import params as P
from tidemark.sources import payloads
from tidemark.operators import consumers, editions, identity, items, storylines
from tidemark.plans.curation import _ALIAS
from tidemark.plans.queries import _APP, _CAND, _CLUSTER, _HOST, _MATERIAL, _PART, _Q_UNTRACKED, _STORY, _TRIM, _URL, NOW, _rec, _u, query
from tidemark.plans.shared import load

_HOSTS = "('x.com', 'twitter.com', 'mobile.twitter.com', 'x.example')"


def _signals(key: str, table: str, urls: str, name: str) -> str:
    """CTE ``sg`` (key, grp, type, value) of the rows of a table."""
    al = lambda x: f"nullif(regexp_replace({_ALIAS.format(x)}, '^[0-9]+$', ''), '')"
    return f"""
  su as (select distinct {key} as k, case when coalesce(category, 'technique') in ('tool', 'api', 'library') then 'artifact' else coalesce(category, 'technique') end as grp, {name} as nm, unnest({urls}) as u from {table} where {key} is not null),
  sp as (select *, lower({_u(1)}) as scheme, {_HOST.format(h=_u(2), s=_u(1))} as host, case when {_u(3)} = '' then '/' else {_u(3)} end as path, regexp_replace({_u(4)}, '^\\?', '') as q from su where regexp_matches(trim(u), {_URL}) and {_u(2)} <> ''),
  sh as (select *, regexp_replace(host, '^www\\.', '') as h, case when regexp_replace(host, '^www\\.', '') in ('github.com', 'github.example') then lower(path) else path end as p2,
    regexp_extract(lower(path), '^/+([^/]+/[^/]+?)(?:\\.git)?(?:/.*)?$', 1) as r, list_filter(string_split(path, '/'), lambda z: z <> '') as seg, regexp_extract(regexp_replace(host, '^www\\.', ''), '^(?:.*\\.)?([^.]+)\\.[^.]+$', 1) as lab from sp),
  sr as (select *, h in ('github.com', 'github.example') and r <> '' as isrepo, h not in {_HOSTS} and not (h in ('github.com', 'github.example') and r <> '') as plain from sh),
  sg as (
    select k, grp, 'canonical_url' as type, scheme || '://' || case when h = 'twitter.com' then 'x.com' else h end || {_TRIM.format("p2")} || {_Q_UNTRACKED} as value from sr
    union select k, grp, 'repo_root', 'https://' || h || '/' || r from sr where isrepo
    union select k, grp, 'canonical_id', 'arxiv:' || regexp_extract(lower(u), 'arxiv\\.(?:org|example)/(?:abs|pdf|html)/(\\d{{4}}\\.\\d{{4,}})', 1) from sr where regexp_matches(lower(u), 'arxiv\\.(?:org|example)/(?:abs|pdf|html)/(\\d{{4}}\\.\\d{{4,}})')
    union select k, grp, 'repo_name_alias', {al("split_part(r, '/', 2)")} from sr where isrepo
    union select k, grp, 'repo_full_name_alias', {al("replace(r, '/', ' ')")} from sr where isrepo
    union select k, grp, 'host_alias', {al("lab")} from sr where plain and regexp_matches(lab, '[-_]')
    union select k, grp, 'slug_alias', {al("seg[-1]")} from sr where plain and len(seg) >= 1
    union select k, grp, 'slug_alias', {al("seg[-2]")} from sr where plain and len(seg) >= 2
    union select k, grp, 'name_alias', {al("nm")} from su),
  sig as (select * from sg where value is not null and value <> '')"""


_RECORDS = _signals("record_id", "source_records", "list_concat([source_url], coalesce(source_urls, []))", "title")
_RELATED = _signals("record_id", "source_records", "list_concat([source_url], coalesce(source_urls, []), coalesce(outbound_urls, []))", "title")
_BEARERS = """
  own as (select k, min(value) as entity from sig where type in ('repo_root', 'canonical_id') group by 1),
  al as (select grp, value, k, list_sort(list(distinct type)) as t, any_value(entity) as entity from sig left join own using (k) where type not in ('canonical_url', 'repo_root', 'canonical_id') and (contains(value, ' ') or length(value) >= 8)
    group by 1, 2, 3 having count(case when type <> 'name_alias' then 1 end) > 0)"""


@query(f"with {_RELATED} select k as record_id, grp, type, value from sig")
def identity_signals(s, d):
    return identity.record_signals(_rec(s, d), related=True)


@query(
    f"""with {_RELATED}, {_BEARERS}, ty as (select grp, value, count(distinct x) as types from (select grp, value, unnest(t) as x from al) group by 1, 2)
    select grp, value, count(*) as records, max(types) as types, count(distinct entity) as entities from al join ty using (grp, value) group by 1, 2 having count(*) > 1 and max(types) > 1"""
)
def alias_pairs(s, d):
    return identity.shared_aliases(identity.record_signals(_rec(s, d), related=True))


@query(
    f"""with {_RELATED}, {_BEARERS}, ty as (select grp, value, count(distinct x) as types from (select grp, value, unnest(t) as x from al) group by 1, 2)
    select grp, value, count(distinct entity) as entities from al join ty using (grp, value) group by 1, 2 having count(*) > 1 and max(types) > 1 and count(distinct entity) > 1"""
)
def conflict_veto(s, d):
    """Aliases whose bearers are different repositories or papers: they are not joined by it."""
    return identity.shared_aliases(identity.record_signals(_rec(s, d), related=True)).where("entities > 1").select("grp", "value", "entities")


@query(
    f"""with recursive {_RECORDS}, {_BEARERS},
    pairs as (select a.k as a, b.k as b from sig a join sig b using (grp, type, value) where a.k <> b.k and type in ('canonical_url', 'repo_root', 'canonical_id')
      union select a.k, b.k from al a join al b using (grp, value) where a.k <> b.k and len(list_distinct(list_concat(a.t, b.t))) >= 2 and (a.entity is null or b.entity is null)),
    reach(a, b) as (select a, b from pairs union select reach.a, pairs.b from reach join pairs on reach.b = pairs.a)
    select a as record_id, least(a, min(b)) as group_id from reach group by 1"""
)
def identity_groups(s, d):
    return identity.identity_groups(_rec(s, d))




def _renamed(cte: str, prefix: str) -> str:
    import re

    return re.sub(r"\b(su|sp|sh|sr|sg|sig)\b(?=\s+as \(|\s+where|\s+union|\s*$|\)|\s+left|\n)", prefix + r"\1", cte)


_LEVEL = """case when type = 'repo_root' then 1 when starts_with(value, 'doi:') then 2 when type = 'canonical_url' then 3 when type = 'name_alias' then 4 when type = 'canonical_id' then 5 end"""
_WANTED = f"level is not null and (level <> 4 or contains(value, ' ') or length(value) >= 8) and (level <> 3 or regexp_extract(value, '^[a-z]+://([^/?]+)', 1) not in ('x.com', 'twitter.com', 'mobile.twitter.com', 'x.example', 'doi.org', 'dx.doi.org'))"
_HIST = f"""{_renamed(_signals("item_id", "edition_items", "list_concat([source_url], coalesce(source_urls, []))", "item_name"), "h")}, {_renamed(_signals("incoming_id", "incoming_items", "[source_url]", "item_name"), "n")},
  st as (select item_id, min(first_seen) as known_since, count(distinct edition_id) as editions, max(published_at) as last from edition_items where item_id is not null group by 1),
  ho as (select * from (select k as item_id, grp, value, {_LEVEL} as level from hsig) where {_WANTED}), nw as (select * from (select k as incoming_id, grp, value, {_LEVEL} as level from nsig) where {_WANTED}),
  hown as (select distinct item_id from ho where level in (1, 2, 5)), nown as (select distinct incoming_id from nw where level in (1, 2, 5)),
  hits as (select incoming_id, level, item_id from nw join ho using (grp, level, value) where level <> 4 or incoming_id not in (select incoming_id from nown) or item_id not in (select item_id from hown)
    union all select incoming_id, 0, item_id from incoming_items join st using (item_id)),
  best as (select incoming_id, item_id, level from hits join st using (item_id) qualify row_number() over (partition by incoming_id order by level, editions desc, last desc, item_id desc) = 1)"""


@query(
    f"""with {_HIST} select i.incoming_id, b.item_id, b.level as priority, coalesce(known_since, i.first_seen) as first_seen, coalesce(editions, 0) + 1 as edition_count
    from incoming_items i left join best b using (incoming_id) left join st on st.item_id = b.item_id"""
)
def historical_resolution(s, d):
    return identity.resolved(load(s, d, "edition_items"), load(s, d, "incoming_items"))


# ---- storylines

_CMP = "coalesce(nullif(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ''), '')"
_STORIES = f"""
  fi as (select item_id, min((published_at, appearance_id)) as since, arg_min(item_name, (published_at, appearance_id)) as name, arg_min(category, (published_at, appearance_id)) as category from edition_items where item_id is not null group by 1),
  ft as (select item_id, since, case when category in ('tool', 'api', 'library') then 'artifact' else category end as grp, {_CMP.format("name")} as c, list_distinct({_STORY.format(_CMP.format("name"))}) as tk, list_distinct(list_filter(string_split({_CMP.format("name")}, ' '), lambda z: z <> '')) as w from fi),
  fp as (select x.item_id as x, y.item_id as y, y.since as ys, case when x.c = y.c then 1e0 when starts_with(x.c || ' ', y.c || ' ') or starts_with(y.c || ' ', x.c || ' ') then 0.96e0 when contains(x.c, y.c) or contains(y.c, x.c) then 0.92e0
      when len(list_intersect(x.w, y.w)) >= 2 and 2e0 * len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w)) >= 0.8e0 then 0.9e0 when 2e0 * len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w)) >= 2 / 3e0 - 1e-9 then 0.82e0 else 0e0 end as score
    from ft x join ft y on x.grp = y.grp and y.since < x.since and len(list_intersect(x.tk, y.tk)) > 0),
  fb as (select x, y from fp where score >= 0.82 qualify row_number() over (partition by x order by score desc, ys, y) = 1),
  fw(x, root) as (select x, y from fb union select fw.x, fb.y from fw join fb on fw.root = fb.x),
  story as (select item_id, coalesce(e.root, item_id) as storyline, case when e.root is null then 'begun' else 'joined' end as how from ft left join (select x, root from fw where root not in (select x from fb)) e on e.x = ft.item_id)"""


def _stories(s, d):
    from tidemark.plans.shared import park

    return park(storylines.assigned(load(s, d, "edition_items")), "storylines")


@query(f"with recursive {_STORIES} select item_id, storyline, how from story")
def storyline_match(s, d):
    return storylines.assigned(load(s, d, "edition_items"))


@query(f"with recursive {_STORIES}, {_APP} select storyline, appearance_id, item_id, row_number() over (partition by storyline order by published_at, appearance_id) as position from app join story using (item_id)")
def storyline_members(s, d):
    return storylines.members(load(s, d, "edition_items"), _stories(s, d))


_MEET = f"""{_STORIES}, {_APP},
  mp as (select a.*, lower({_u(1, "source_url")}) as scheme, regexp_replace({_HOST.format(h=_u(2, "source_url"), s=_u(1, "source_url"))}, '^www\\.', '') as h, case when {_u(3, "source_url")} = '' then '/' else {_u(3, "source_url")} end as path, regexp_replace({_u(4, "source_url")}, '^\\?', '') as q
    from app a where regexp_matches(trim(source_url), {_URL}) and {_u(2, "source_url")} <> ''),
  mk as (select *, case when h in ('github.com', 'github.example') then lower(path) else path end as p2 from mp),
  ma as (select distinct edition_id, published_at, scheme || '://' || case when h = 'twitter.com' then 'x.com' else h end || {_TRIM.format("p2")} || {_Q_UNTRACKED} as key, storyline from mk join story using (item_id)),
  ms as (select storyline, min(published_at) as since from app join story using (item_id) group by 1),
  mo as (select edition_id, key, count(*) as n, min((since, storyline)) as t from ma join ms using (storyline) group by 1, 2 having count(*) > 1),
  met as (select distinct edition_id, t[2] as target, storyline as source, case when n = 2 and since = published_at and t[1] < published_at then 'fork' else 'merge' end as kind from ma join ms using (storyline) join mo using (edition_id, key) where storyline <> t[2])"""


@query(f"with recursive {_MEET} select edition_id, target, source, kind from met")
def storyline_links(s, d):
    return storylines.links(load(s, d, "edition_items"), _stories(s, d))


@query(
    f"""with recursive {_MEET}, mm as (select source, min(target) as target from met where kind = 'merge' group by 1), mw(source, root) as (select source, target from mm union select mw.source, mm.target from mw join mm on mw.root = mm.source)
    select source as storyline, root as "into" from mw where root not in (select source from mm)"""
)
def storyline_merges(s, d):
    return storylines.merged(load(s, d, "edition_items"), _stories(s, d))


@query(
    f"""with recursive {_STORIES}, {_APP}, a as (select * from app join story using (item_id) where published_at <= timestamp '{NOW}'),
    s as (select storyline, count(*) as appearances, min(published_at) as first, max(published_at) as last from a group by 1),
    v as (select storyline, count(*) as items, max(relevance_score) as top_score from (select * from edition_items where published_at <= timestamp '{NOW}' qualify row_number() over (partition by item_id order by published_at desc, appearance_id desc) = 1) join story using (item_id) group by 1)
    select storyline, items, appearances, first, last, top_score from s join v using (storyline) where last > timestamp '{NOW}' - interval {P.IDLE_DAYS} day"""
)
def active_storylines(s, d):
    return storylines.active(load(s, d, "edition_items"), _stories(s, d), NOW)


# ---- what an appearance adds to a story


_FACTS = f"""{_APP},
  fx as (select appearance_id, item_id, published_at, row_number() over (partition by item_id order by published_at, appearance_id) as n, list_distinct({_MATERIAL.format("nullif(trim(regexp_replace(lower(summary), '[^a-z0-9]+', ' ', 'g')), '')")}) as tokens,
    list_distinct(list_filter({_PART.replace("text", "summary")}, lambda p: len({_MATERIAL.format("p")}) >= 2)) as clauses from app),
  fc as (select appearance_id, item_id, n, list_distinct({_MATERIAL.format("c")}) as w from (select *, unnest(clauses) as c from fx)),
  fn as (select appearance_id, count(*) as facts from fc x where not exists (select 1 from fc y where y.item_id is not distinct from x.item_id and y.n < x.n and len(list_intersect(x.w, y.w)) * 1e0 / greatest(len(x.w), len(y.w)) >= 0.72) group by 1),
  fk as (select appearance_id, item_id, n, unnest(tokens) as k from fx), fb as (select item_id, k, min(n) as n from fk group by 1, 2), fw as (select fx.appearance_id, count(*) as fresh from fx join fb on fb.item_id is not distinct from fx.item_id and fb.n = fx.n group by 1),
  fd as (select a.*, coalesce(facts, 0) as facts, case when len(a.tokens) > 0 then coalesce(fresh, 0) * 1e0 / len(a.tokens) else 0e0 end as ratio, b.tokens is null as firstone,
    case when greatest(len(a.tokens), coalesce(len(b.tokens), 0)) > 0 then coalesce(len(list_intersect(a.tokens, b.tokens)), 0) * 1e0 / greatest(len(a.tokens), coalesce(len(b.tokens), 0)) else 0e0 end as overlap
    from fx a left join fx b on b.item_id is not distinct from a.item_id and b.n = a.n - 1 left join fn on fn.appearance_id = a.appearance_id left join fw on fw.appearance_id = a.appearance_id),
  fz as (select appearance_id, item_id, published_at, n, ratio, overlap, facts, case when firstone then 'origin' when facts >= 1 and (ratio >= 0.18 or overlap <= 0.45) or facts >= 2 and ratio >= 0.09 and overlap <= 0.7
    or facts = 0 and ratio >= 0.35 and overlap <= 0.55 then 'evolution' else 'repetition' end as decision from fd)"""


@query(f"with {_FACTS} select appearance_id, item_id, facts, decision from fz")
def fact_clause_novelty(s, d):
    return storylines.decisions(load(s, d, "edition_items")).select("appearance_id", "item_id", "facts", "decision")


@query(
    f"""with recursive {_FACTS}, fl(item_id, n, appearance_id, decision, status, evolutions, repetitions, streak, last) as (
      select item_id, 1::bigint, appearance_id, decision, 'developing', 1::bigint, 0::bigint, 0::bigint, published_at from fz where n = 1 and item_id is not null
      union all select z.item_id, z.n, z.appearance_id, z.decision,
        case when z.decision = 'repetition' then case when epoch(z.published_at) - epoch(l.last) > 604800 or l.streak + 1 >= 2 then 'archived' when l.evolutions >= 2 then 'stable' else 'developing' end
          when l.status = 'archived' or l.evolutions + 1 < 2 then 'developing' else 'stable' end,
        l.evolutions + case when z.decision = 'repetition' then 0 else 1 end, l.repetitions + case when z.decision = 'repetition' then 1 else 0 end,
        case when z.decision = 'repetition' then l.streak + 1 else 0 end, case when z.decision = 'repetition' then l.last else z.published_at end from fl l join fz z on z.item_id = l.item_id and z.n = l.n + 1)
    select appearance_id, item_id, decision, status, evolutions, repetitions, streak from fl"""
)
def storyline_lifecycle(s, d):
    return storylines.lifecycles(load(s, d, "edition_items").where("item_id is not null"))


# ---- items, references, checkpoints, plans


_UP = f"""nu as (select record_id, u, {_HOST.format(h=_u(2), s=_u(1))} as host, lower({_u(1)}) as scheme, case when {_u(3)} = '' then '/' else {_u(3)} end as path, regexp_replace({_u(4)}, '^\\?', '') as q
    from (select record_id, unnest(list_concat([source_url], coalesce(source_urls, []))) as u from source_records) where regexp_matches(trim(u), {_URL}) and {_u(2)} <> ''),
  nh as (select *, regexp_replace(host, '^www\\.', '') as h, lower(regexp_replace(regexp_extract(path, '^/+([^/]+)', 1), '^@', '')) as a from nu)"""


@query(
    f"""with {_UP}, cl as (select record_id, count(distinct {_CLUSTER}) as n from nh group by 1),
    i as (select r.*, n, case when r.category in ('tool', 'technique', 'api', 'library') then r.category end as c from source_records r join cl using (record_id) where trim(title) <> '' and regexp_matches(trim(source_url), {_URL}))
    select record_id, c as category, greatest(1, n) as mention_count, least(published_at, fetched_at) as first_seen from i where c is not null"""
)
def normalised_items(s, d):
    return items.normalised(_rec(s, d).where(F.col("category").isin(*P.CATEGORIES))).select("record_id", "category", "mention_count", "first_seen")


@query(
    f"""with {_UP}, c as (select *, case when h in ('github.com', 'github.example') then lower(path) else path end as p2, case when len(list_filter(string_split(q, '&'), lambda p: p <> '' and (starts_with(lower(split_part(p, '=', 1)), 'utm_') or lower(split_part(p, '=', 1)) in ('ref', 'source', 's', 't')))) > 0 then 0 else 8 end
      + case when h in ('x.com', 'x.example') or (h in ('github.com', 'github.example') and path = lower(path)) then 4 else 0 end + case when ends_with(path, '/') then 0 else 1 end as score,
      10 * len(list_filter(string_split(path, '/'), lambda z: z <> '')) + len(list_filter(string_split(q, '&'), lambda z: z <> '')) as spec from nh)
    select source_id, scheme || '://' || case when h = 'twitter.com' then 'x.com' else h end || {_TRIM.format("p2")} || {_Q_UNTRACKED} as page, arg_min(u, (-score, -spec, u)) as url from c join source_records using (record_id) where source_id is not null group by 1, 2"""
)
def best_links(s, d):
    return items.best_links(_rec(s, d).where("source_id is not null"), "source_id")


@query(
    f"""with b as (select item_id, edition_id, [case when trim(coalesce(item_name, '')) = '' then 'name' end, case when not (regexp_matches(trim(coalesce(source_url, '')), {_URL}) and regexp_extract(trim(coalesce(source_url, '')), {_URL}, 2) <> '') then 'link' end,
      case when coalesce(category, '') not in ('tool', 'technique', 'api', 'library') then 'category' end, case when not coalesce(relevance_score between 0 and 100, false) then 'score' end, case when coalesce(mention_count, 0) < 1 then 'mentions' end,
      case when coalesce(edition_count, 0) < 1 then 'editions' end, case when coalesce(first_seen > published_at, true) then 'first_seen' end, case when len(list_distinct(source_urls)) < len(source_urls) then 'links_once' end] as r from edition_items),
    t as (select coalesce(sum(c - 1), 0) as n from (select count(*) as c from edition_items group by item_id, edition_id having count(*) > 1))
    select rule, count(*) as n from (select unnest(list_filter(r, lambda x: x is not null)) as rule from b) group by 1 union all select 'once_an_edition', cast(n as bigint) from t where n > 0"""
)
def edition_contract(s, d):
    return items.violations(load(s, d, "edition_items"))


@query(
    f"""with {_CAND}, ref as (select * from good where clusters >= 2 union all select * from good where clusters = 1 and category not in (select category from good where clusters >= 2)
      qualify row_number() over (partition by category order by relevance_score desc, edition_count desc, published_at desc, appearance_id) = 1)
    select appearance_id, item_id, row_number() over (order by relevance_score desc, edition_count desc, published_at desc, lower(item_name), appearance_id) as place from ref"""
)
def reference_order(s, d):
    e = load(s, d, "edition_items")
    return editions.reference_order(editions.references(e, NOW), e)


@query(
    """with o as (select item_id, arg_max(summary, (published_at, appearance_id)) as was from edition_items where published_at <= timestamp '2026-06-01' group by 1),
    n as (select item_id, arg_max(summary, (published_at, appearance_id)) as summary, arg_max(item_name, (published_at, appearance_id)) as name from edition_items where published_at > timestamp '2026-06-01' group by 1),
    m as (select n.item_id, case when o.item_id is null then 'new_to_consumer' when summary is distinct from was then 'material_change' end as change,
      array_to_string(list_filter(['planner', 'engine', 'queries'], lambda t: contains(lower(concat_ws(' ', name, summary)), t)), ',') as matched from n left join o using (item_id))
    select item_id, change, matched from m where matched <> '' and change is not null"""
)
def consumer_checkpoint(s, d):
    return editions.since_checkpoint(load(s, d, "edition_items"), "2026-06-01 00:00:00", "planner, engine or queries")


@query(
    """with l as (select event_id, ts, cast(((ts at time zone 'UTC') at time zone 'America/New_York') - interval 21 hour as date) as day from events),
    p as (select event_id, ts, ((day::timestamp + interval 21 hour) at time zone 'America/New_York') at time zone 'UTC' as slot, (((day - 1)::timestamp + interval 21 hour) at time zone 'America/New_York') at time zone 'UTC' as before,
      (((day + 1)::timestamp + interval 21 hour) at time zone 'America/New_York') at time zone 'UTC' as after from l)
    select event_id, slot, before, after, floor(epoch(ts)) - floor(epoch(slot)) between 0 and 1200 as in_grace from p"""
)
def publication_plan(s, d):
    return consumers.plan(load(s, d, "events"))


# ---- payloads, written from the tables and read again


@query("select lower(external_id) as external_id, title, stars, forks, coalesce(archived, false) as archived from github_records where external_id is not null")
def search_payloads(s, d):
    g = load(s, d, "github_records").where("external_id is not null")
    item = F.struct(F.col("external_id").alias("full_name"), F.col("title").alias("name"), F.col("stars").alias("stargazers_count"), F.col("forks").alias("forks_count"), "archived")
    return payloads.repositories(g.select(F.to_json(F.struct(F.array(item).alias("items"))).alias("payload"))).select("external_id", "title", "stars", "forks", "archived")


@query("select 'r' || record_id as external_id, trim(regexp_replace(title, '\\s+', ' ', 'g')) as title from source_records where source_type = 'web' and trim(title) <> '' and not regexp_matches(title, '[<>&\"]|[^\\x00-\\x7F]')")
def page_payloads(s, d):
    r = _rec(s, d).where("source_type = 'web'").where(~F.col("title").rlike(r"[<>&\"]|[^\x00-\x7F]") & (F.trim("title") != ""))
    html = F.concat(F.lit("<html><head><title> "), "title", F.lit("</title></head><body><a href='/x'>y</a></body></html>"))
    return payloads.pages(r.select(F.concat(F.lit("r"), "record_id").alias("url"), html.alias("html"))).select("external_id", "title")


@query("select paper_id, 1 + paper_id % 3 as version, cast(published_at as date) as day from arxiv_records where published_at is not null")
def feed_payloads(s, d):
    a = load(s, d, "arxiv_records").where("published_at is not null")
    entry = F.concat(F.lit("<feed><entry><id>http://arxiv.example/abs/"), "paper_id", F.lit("v"), 1 + F.col("paper_id") % 3, F.lit("</id><published>"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</published><title>t</title></entry></feed>"))
    return payloads.papers(a.select(entry.alias("payload"))).select(F.col("external_id").cast("bigint").alias("paper_id"), F.col("version").cast("bigint").alias("version"), F.to_date("published_at").alias("day"))
