"""SQL that gives the same rows, where SQL can; written from what the tables are to give."""

from __future__ import annotations

import unicodedata

# ---- 1

_KEY = "regexp_replace(regexp_replace(lower(regexp_replace(external_id, '^\\s+|\\s+$', '', 'g')), '^(?:git\\+)?(?:[a-z][a-z+.]*://)?(?:[^/@\\s]+@)?(?:www\\.)?github\\.(?:example|com)(?::\\d+/|[:/])/*', ''), '[?#].*$', '')"
_PATH = "'^/*([^/\\s:]+)\\s*/+\\s*([^/\\s:]+?)(?:\\.git)?(?:/.*)?$'"
_NO_LICENSE = "('', '-', '--', 'n/a', 'na', 'nil', 'no license', 'noassertion', 'none', 'not specified', 'null', 'other', 'see license', 'tbd', 'todo', 'undefined', 'unknown', 'unlicensed', '?')"
_REST = "regexp_replace(trim(homepage), '^(?i:https?:)?//(?:[^/@?#\\s]*@)?', '')"
_HOST = f"lower(regexp_extract({_REST}, '^(\\[[0-9A-Fa-f:.]+\\]|[^/:?#\\s\\[\\]]+)(?::\\d+)?(?:[/?#]\\S*)?$', 1))"
_USABLE = "regexp_matches(h, '^(?:[\\p{L}\\p{N}_](?:[\\p{L}\\p{N}_-]*[\\p{L}\\p{N}_])?\\.)+\\p{L}[\\p{L}\\p{N}-]*$') and not regexp_matches(h, '(?:^|\\.)(?:localhost|localdomain|local)$')"
_FETCHES = f"""k as (select *, regexp_extract({_KEY}, {_PATH}, 1) || '/' || regexp_extract({_KEY}, {_PATH}, 2) as entity_key,
      case when fetched_at < created_at or fetched_at > ingested_at then null else fetched_at end as seen, {_HOST} as h from github_records)"""
_SHORT = "trim(regexp_replace(regexp_replace(lower(trim(license)), '\\b(?:the|licen[sc]e)\\b', ' ', 'g'), '[\\s,]+', ' ', 'g'))"
_SPELT = "case s when 'apache 2.0' then 'apache-2.0' when 'apache version 2.0' then 'apache-2.0' when 'apache2' then 'apache-2.0' when 'gnu general public v3.0' then 'gpl-3.0' when 'gnu affero general public v3.0' then 'agpl-3.0' when 'mozilla public 2.0' then 'mpl-2.0' when 'bsd 3-clause' then 'bsd-3-clause' else s end"


def _vote(field: str) -> str:
    return f"max(case when field_name = '{field}' then value end) as {field}, max(case when field_name = '{field}' then share end) as {field}_share, max(case when field_name = '{field}' then record_id end) as {field}_record"


# ---- words as a reader sees them

_SEEN = [chr(c) for c in range(0x80, 0x20000) if not 0xD800 <= c < 0xE000]
_COMPAT = [c for c in _SEEN if unicodedata.decomposition(c).split(" ")[0] in ("<wide>", "<narrow>", "<font>") or unicodedata.decomposition(c).startswith("<compat>") and unicodedata.category(c) in ("Ll", "Lu", "Lt", "Nl") and unicodedata.normalize("NFKC", c).isascii() and unicodedata.normalize("NFKC", c).isalpha()]
_ONE = [c for c in _COMPAT if len(unicodedata.normalize("NFKC", c)) == 1]
_MANY = [c for c in _COMPAT if len(unicodedata.normalize("NFKC", c)) > 1]
_FROM, _TO = "".join(_ONE).replace("'", "''"), "".join(unicodedata.normalize("NFKC", c) for c in _ONE).replace("'", "''")
# letters of other scripts that look like a Latin one
_LOOKS = {
    "CYRILLIC": ("авеорсухѕіјһԁԛԝӏѵАВЕЅІЈКМНОРСТУХԌԚԜѴ", "abeopcyxsijhdqwlvABESIJKMHOPCTYXGQWV"),
    "GREEK": ("αονρτυικχϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "aovptuikxcjABEZHIKMNOPTYXC"),
    "LATIN": ("ɑɡɩʏꞵ", "agiYb"),
}
_LIKE = "".join(a for a, _ in _LOOKS.values())
_PLAIN = "".join(b for _, b in _LOOKS.values())
_INVISIBLE = r"\x{AD}\x{34F}\x{61C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}"


def _many(x: str) -> str:
    for c in _MANY:
        if ord(c) in range(0xFB00, 0xFB07) or ord(c) in range(0x2160, 0x2180):
            x = f"replace({x}, '{c}', '{unicodedata.normalize('NFKC', c)}')"
    return x


def _words(table: str, key: str, *columns: str) -> str:
    """CTE ``wd`` (key, w): the distinct words of the columns together, as a reader sees them."""
    text = "concat_ws(chr(10), " + ", ".join(columns) + ")"
    clean = _many(f"translate(regexp_replace(nfc_normalize({text}), '[{_INVISIBLE}]', '', 'g'), '{_FROM}', '{_TO}')")
    real = " or ".join(f"regexp_matches(t, '[\\p{{{s.title()}}}]') and regexp_matches(regexp_replace(t, '[{a}]', '', 'g'), '\\p{{{s.title()}}}')" for s, (a, _) in _LOOKS.items() if s != "LATIN")
    other = f"regexp_matches(regexp_replace(x, '[{_LIKE}]', '', 'g'), '[\\p{{Cyrillic}}\\p{{Greek}}]')"
    return f"""wt as (select {key} as k, {clean} as t from {table} where {key} is not null), wr as (select k, t, {real} as script from wt),
    wl as (select k, list_distinct(list_filter(list_transform(regexp_extract_all(t, '[\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda x: lower(case when regexp_matches(x, '[{_LIKE}]') and not {other} and (regexp_matches(x, '[A-Za-z]') or not script) then translate(x, '{_LIKE}', '{_PLAIN}') else x end)), lambda x: x <> '')) as ws from wr),
    wd as (select k, unnest(ws) as w from wl)"""


# of two sets that share 60% of their union the first words in any common order meet
_PREFIX = """wf as (select w, count(*) as n from wd group by 1), ws as (select k, count(*) as size from wd group by 1),
    wo as (select k, w, size, row_number() over (partition by k order by n, w) as place from wd join wf using (w) join ws using (k)),
    wp as (select k, w, size from wo where place <= size - ceil(0.6 * size - 1e-9) + 1)"""

_TAG = "</?[A-Za-z][A-Za-z0-9:-]*(?:\\s+[^\\s\"''<>/=]+\\s*=\\s*(?:\"[^\"]*\"|''[^'']*''|[^\\s\"''=<>`]+))*\\s*/?>"
_RUNS = f"regexp_extract_all(lower(regexp_replace(regexp_replace(text, '{_TAG}', ' ', 'g'), '&(?:#\\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);', ' ', 'g')), '[\\p{{L}}\\p{{N}}]+')"
_WINDOWS = f"""d as (select doc_id, {_RUNS} as w from documents where text is not null), e as (select item_no, {_RUNS} as w from eval_items),
    dw as (select distinct doc_id, array_to_string(w[i:i + 11], ' ') as g from d, unnest(generate_series(1, len(w) - 11)) as t(i)),
    ew as (select distinct item_no, array_to_string(w[i:i + 11], ' ') as g from e, unnest(generate_series(1, len(w) - 11)) as t(i))"""

_PICTURES = r"\x{2190}-\x{2BFF}\x{3030}-\x{303D}\x{1F000}-\x{1FAFF}\x{FE0F}"
_ODD = f"""nfc_normalize(t) <> t or regexp_matches(regexp_replace(t, '[{_PICTURES}#*0-9][\\x{{200D}}\\x{{FE0F}}]+', '', 'g'), '[{_INVISIBLE}]') or regexp_matches(t, '[\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{2010}}\\x{{2011}}\\x{{FE63}}]')
    or translate(t, '{_FROM}', '') <> t or regexp_matches(t, '[\\x{{FB00}}-\\x{{FB06}}\\x{{2160}}-\\x{{217F}}]')
    or len(list_filter(regexp_extract_all(t, '[\\p{{L}}\\p{{M}}]+'), lambda x: regexp_matches(x, '[{_LIKE}]') and not regexp_matches(regexp_replace(x, '[{_LIKE}]', '', 'g'), '[\\p{{Cyrillic}}\\p{{Greek}}]')
      and (regexp_matches(x, '[A-Za-z]') or not script and (length(x) > 1 or regexp_matches(x, '\\p{{Cyrillic}}'))))) > 0"""
_SCRIPT = " or ".join(f"regexp_matches(regexp_replace(t, '[{a}]', '', 'g'), '\\p{{{s.title()}}}')" for s, (a, _) in _LOOKS.items() if s != "LATIN")

_IDS = "nullif(regexp_replace(lower(item_id), '[^\\p{L}\\p{N}]+', '', 'g'), '')"
_ROWS = f"""every as (select appearance_id as seq, {_IDS} as key, item_id, published_at, item_name, summary, false as fresh from edition_items
      union all select 1000000000 + incoming_id, {_IDS}, item_id, received_at, item_name, summary, true from incoming_items)"""

_ALIKE = f"""{_words("source_records", "record_id", "title", "summary")}, {_PREFIX},
    pr as (select distinct a.k as a, b.k as b from wp a join wp b using (w) where a.k < b.k and least(a.size, b.size) >= 0.6 * greatest(a.size, b.size) - 1e-9),
    sm as materialized (select a, b, len(x.ws) + len(y.ws) as total, len(list_intersect(x.ws, y.ws)) as o from pr join wl x on x.k = a join wl y on y.k = b)"""
_REPEATS = f"""{_ROWS}, {_words("every", "seq", "item_name", "summary")}, {_PREFIX},
    pr as (select distinct greatest(a.k, b.k) as a, least(a.k, b.k) as b from wp a join wp b using (w) where a.k < b.k and b.k > 1000000000),
    sm as (select a, b, len(list_intersect(x.ws, y.ws)) / (len(x.ws) + len(y.ws) - len(list_intersect(x.ws, y.ws))) as s from pr join wl x on x.k = a join wl y on y.k = b),
    tx as (select a as seq, arg_max(b, (s, -b)) as up, max(s) as s from sm where s >= 0.6 - 1e-12 group by 1),
    fk as (select key, min(seq) as up from every where key is not null group by 1),
    pt as (select e.seq, coalesce(case when fk.up < e.seq then fk.up end, tx.up) as up, case when fk.up < e.seq then 'id' when tx.up is not null then 'text' end as how, tx.s from every e left join fk using (key) left join tx on tx.seq = e.seq where e.fresh),
    wk(seq, here) as (select seq, up from pt where up is not null union select wk.seq, pt.up from wk join pt on pt.seq = wk.here where pt.up is not null),
    en as (select seq, here from wk where here not in (select seq from pt where up is not null)),
    nm as (select key, arg_min(item_id, (published_at, seq)) as item_id from every where not fresh and key is not null group by 1)"""

SQL: dict[str, str] = {
    "p1_found": f"""with {_FETCHES}, n as (select entity_key, count(*) as n from k where entity_key <> '/' group by 1),
    u as (select entity_key, 'license' as field_name, record_id, source_authority, seen from k where license is not null and lower(trim(license)) not in {_NO_LICENSE}
      union all select entity_key, 'homepage', record_id, source_authority, seen from k where homepage is not null and {_USABLE})
    select entity_key, field_name, record_id from u join n using (entity_key) where n >= 2
    qualify row_number() over (partition by entity_key, field_name order by source_authority desc, seen desc nulls last, record_id) = 1""",
    "p1_golden": f"""with {_FETCHES}, b as (select *, case when seen is null then 0.25e0 else pow(0.5e0, greatest(0e0, (floor(epoch(ingested_at)) - floor(epoch(seen))) / 86400e0) / 90e0) end * coalesce(source_authority, 0e0) as vote,
      {_SHORT} as s from k where entity_key <> '/'),
    f as (select entity_key, 'license' as field_name, case when lower(trim(license)) in {_NO_LICENSE} or s in {_NO_LICENSE} then null else {_SPELT} end as value, record_id, source_authority, seen, vote from b
      union all select entity_key, 'homepage', case when {_USABLE} then regexp_replace(regexp_replace(h, '\\.$', ''), '^www\\.', '') || regexp_replace(regexp_extract({_REST}, '^[^/?#]+([/?#]?.*)$', 1), '/+$', '') end, record_id, source_authority, seen, vote from b
      union all select entity_key, 'fetched_at', strftime(seen, '%Y-%m-%dT%H:%M:%S.%f'), record_id, source_authority, seen, vote from b),
    v as (select entity_key, field_name, value, sum(vote) as votes, arg_max(record_id, (source_authority, coalesce(seen, timestamp '0001-01-01'), -record_id)) as record_id, max((source_authority, coalesce(seen, timestamp '0001-01-01'), -record_id)) as rank from f where value is not null group by 1, 2, 3),
    t as (select *, round(votes / nullif(sum(votes) over (partition by entity_key, field_name), 0), 6) as share from v),
    c as (select * from t qualify row_number() over (partition by entity_key, field_name order by round(votes, 9) desc, rank desc) = 1),
    n as (select entity_key, count(*) as rows from b group by 1)
    select entity_key, any_value(rows) as rows, {_vote("license")}, {_vote("homepage")}, {_vote("fetched_at")} from c join n using (entity_key) group by 1""",
    "p2_found": f"with {_ALIKE} select a as record_id_a, b as record_id_b from sm where o >= 0.6 * (total - o) - 1e-9",
    "p2_groups": f"""with recursive {_ALIKE}, ps as (select a, b, total = 2 * o as same from sm where o >= 0.6 * (total - o) - 1e-9), ed as (select * from ps union all select b, a, same from ps),
    rc(a, b) as (select a, b from ed union select rc.a, ed.b from rc join ed on rc.b = ed.a), lo as (select a, min(b) as b from rc group by 1),
    ct as (select a, count(case when same then 1 end) + 1 as copies, count(case when not same then 1 end) as links from ed group by 1)
    select a as record_id, least(a, b) as class_id, copies, links from ct join lo using (a)""",
    "p3_found": f"""with f as (select record_id, 'title' as field_name, title as t from source_records union all select record_id, 'summary', summary from source_records), g as (select *, {_SCRIPT} as script from f where regexp_matches(t, '[^\\x{{00}}-\\x{{7F}}]'))
    select record_id, field_name from g where {_ODD}""",
    "p5_found": f"""with recursive {_REPEATS}
    select en.seq - 1000000000 as incoming_id, case when r.fresh or r.key is null then r.item_id else nm.item_id end as item_id from en join every r on r.seq = en.here left join nm on nm.key = r.key""",
    "p5_matches": f"""with recursive {_REPEATS},
    rt as (select pt.seq, coalesce(en.here, pt.seq) as root, pt.up is null as is_new, pt.how, round(pt.s, 6) as similarity from pt left join en using (seq)),
    rk as (select rt.*, r.item_id, case when r.fresh then 'n' || r.seq when r.key is null then '#' || r.seq else r.key end as thing, i.batch_no from rt join every r on r.seq = rt.root join incoming_items i on i.incoming_id = rt.seq - 1000000000),
    hs as (select coalesce({_IDS}, '#' || appearance_id) as thing, arg_min(item_id, (published_at, appearance_id)) as name, min(least(first_seen, published_at)) as first_seen, count(distinct edition_id) as editions from edition_items group by 1),
    bt as (select distinct thing, batch_no from rk)
    select seq - 1000000000 as incoming_id, coalesce(hs.name, rk.item_id) as item_id, is_new, how as "by", similarity, coalesce(hs.first_seen, n.received_at) as first_seen,
      coalesce(editions, 0) + (select count(*) from bt where bt.thing = rk.thing and bt.batch_no <= rk.batch_no) as edition_count
    from rk left join hs using (thing) left join incoming_items n on n.incoming_id = rk.root - 1000000000""",
    "p6_found": f"with {_WINDOWS} select distinct doc_id, item_no from dw join ew using (g)",
    "p6_leaks": f"""with {_WINDOWS}, n as (select item_no, count(*) as n from ew group by 1)
    select doc_id, item_no, count(*) as windows, count(*) / any_value(n)::double as share from dw join ew using (g) join n using (item_no) group by 1, 2""",
}
