import datetime as dt
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import abuse, glyphs, history, leakage, linkage, mixing, setjoin, survivorship
from tidemark.llm import queries as q


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---- 1


GITHUB = "record_id bigint, external_id string, license string, homepage string, source_authority double, created_at timestamp_ntz, fetched_at timestamp_ntz, ingested_at timestamp_ntz, value string"


def fetch(i, key, lic, home, auth, day, created=1, ingested=28):
    t = lambda d: None if d is None else dt.datetime(2026, 1, d)
    return (i, key, lic, home, auth, t(created), t(day), t(ingested), "clash")


def test_survivors(spark):
    rows = [
        fetch(1, "Own/Repo", "MIT", "https://a.example", 50.0, 5),
        fetch(2, "https://github.example/own/repo.git", "Apache-2.0", "http://localhost:3000", 95.0, 3),
        fetch(3, "git@github.example:own/repo", "MIT License", None, 95.0, 4),
        fetch(4, "own/repo/", "NOASSERTION", "coming soon", 99.0, 6),
        fetch(5, "own/repo", "GPL-3.0", "b.example", 95.0, None),
        fetch(6, "own/repo", "ISC", "https://", 95.0, 29),  # fetched after it was taken in
        fetch(7, "alone/repo", "MIT", "https://a.example", 95.0, 5),
        fetch(8, None, "MIT", None, None, None),
        fetch(9, "none/at-all", "null", "127.0.0.1", 1.0, 5),
        fetch(10, "none/at-all", None, None, None, None),
    ]
    got = rows_of(survivorship.found(spark.createDataFrame(rows, GITHUB)))
    assert got == [("own/repo", "homepage", 5), ("own/repo", "license", 3)]
    assert survivorship.found(spark.createDataFrame([], GITHUB)).count() == 0


def test_survivors_against_plain_python(spark):
    random.seed(1)
    lic, home = [None, "MIT", "mit license", "N/A", "", "GPL-3.0", "-"], [None, "a.example", "https://www.a.example/", "TODO", "http://localhost/"]
    rows = [fetch(i, random.choice(["a/b", "A/B", "c/d", "a/b.git"]), random.choice(lic), random.choice(home), random.choice([45.0, 80.0, None]), random.choice([None, 2, 3, 29])) for i in range(300)]
    good = {"license": {"MIT", "mit license", "GPL-3.0"}, "homepage": {"a.example", "https://www.a.example/"}}
    want = []
    for key in ("a/b", "c/d"):
        mine = [r for r in rows if r[1].lower().removesuffix(".git") == key]
        for k, name in ((2, "license"), (3, "homepage")):
            usable = [r for r in mine if r[k] in good[name]]
            when = lambda r: r[6] if r[6] and r[6].day <= 28 else dt.datetime.min
            want.append((key, name, max(usable, key=lambda r: (r[4] if r[4] is not None else -1, when(r), -r[0]))[0]))
    assert rows_of(survivorship.found(spark.createDataFrame(rows, GITHUB))) == sorted(want, key=str)


def test_golden_record_and_votes(spark):
    rows = [fetch(1, "o/r", "MIT", "a.example", 80.0, 5), fetch(2, "o/r", "MIT License", "https://a.example/", 40.0, 5), fetch(3, "o/r", "ISC", None, 40.0, 5)]
    g = survivorship.golden_records(spark.createDataFrame(rows, GITHUB)).first()
    assert (g["license"], g["homepage"], g["license_share"], g["homepage_share"]) == ("mit", "a.example", 0.75, 1.0)
    # two rows of less trust outvote one of more; by trust the one survives
    rows = [fetch(1, "o/r", "MIT", None, 90.0, 5), fetch(2, "o/r", "ISC", None, 50.0, 5), fetch(3, "o/r", "isc", None, 60.0, 5), fetch(4, "https://github.com/o/r", None, None, 1.0, None)]
    g = [survivorship.golden_records(spark.createDataFrame(rows, GITHUB), by).first() for by in ("votes", "trust")]
    assert [(x["license"], x["license_record"], x["rows"]) for x in g] == [("isc", 3, 4), ("mit", 1, 4)]


# ---- 3


FORMS = [
        ("plain text", "plain text"), ("ｆｕｌｌ　ｗｉｄｔｈ", "full width"), ("café", "café"), ("café", "café"), ("no break", "no break"),
        ("zero​width﻿", "zerowidth"), ("soft­hyphen", "softhyphen"), ("prоfiler", "profiler"), ("Νotes", "Notes"),
        ("Отзывы о tool", "Отзывы о tool"), ("β build", "β build"), ("µs № 1 10² ½", "µs № 1 10² ½"),
        ("\U0001f469‍\U0001f4bb ok ☕️", "\U0001f469‍\U0001f4bb ok ☕️"), ("preﬁx worﬂow", "prefix worflow"), ("lⅰbrariɑns", "librarians"),
        ("a‑b", "a-b"), ("“q” – d", "“q” – d"), ("ạ́", unicodedata.normalize("NFC", "ạ́")), ("ạ́", unicodedata.normalize("NFC", "ạ́")),
        ("x̣́̂", unicodedata.normalize("NFC", "x̣́̂")), ("Å", "Å"), ("", ""), ("é" * 3000, "é" * 3000), ("한국어", "한국어"),
    ]


def test_unified(spark):
    df = spark.createDataFrame([(i, text, None) for i, (text, _) in enumerate(FORMS)], "record_id bigint, title string, summary string")
    once = glyphs.with_unified(df, ["title", "summary"])
    got = {r["record_id"]: r["title"] for r in once.collect()}
    assert [got[i] for i in range(len(FORMS))] == [want for _, want in FORMS]
    assert rows_of(glyphs.found(df)) == sorted([(i, "title") for i, (text, want) in enumerate(FORMS) if text != want], key=str)
    assert glyphs.found(once).count() == 0


def test_unified_rows_stay_whole(spark):
    rows = [(1, "ａ", "clash"), (1, "ａ", "clash"), (None, "ｂ", None), (2, None, None)]
    df = spark.createDataFrame(rows, "key bigint, text string, unified string")
    assert rows_of(glyphs.with_unified(df, ["text"])) == sorted([(1, "a", "clash"), (1, "a", "clash"), (None, "b", None), (2, None, None)], key=str)
    assert glyphs.with_unified(df.limit(0), ["text"]).count() == 0


def test_unified_texts_of_very_many_rows(spark, monkeypatch):
    from tidemark.plans import shared

    monkeypatch.setattr(glyphs, "join_by_value", lambda *a: shared.join_by_value(*a, most=3))
    rows = [(i, "ａ ｂ" if i % 3 else f"ａ {i}", None) for i in range(60)]
    df = spark.createDataFrame(rows, "record_id bigint, title string, summary string")
    assert rows_of(glyphs.with_unified(df, ["title"]).select("record_id", "title")) == sorted([(i, t.replace("ａ", "a").replace("ｂ", "b")) for i, t, _ in rows], key=str)
    assert glyphs.found(df).count() == 60


# ---- 2


def sets(n, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + [f"rare{i}" for i in range(200)]
    out = []
    for _ in range(n):
        if out and r.random() < 0.6:
            words = list(r.choice(out))
            for _ in range(r.randrange(0, 8)):
                if words and r.random() < 0.5:
                    words.pop(r.randrange(len(words)))
                else:
                    words.append(r.choice(vocabulary))
        else:
            words = r.choices(vocabulary, k=r.randrange(1, 30))
        out.append(words)
    return out


@pytest.mark.parametrize(("threshold", "block", "split"), [(0.6, 1 << 16, 256), (0.8, 1 << 16, 8), (0.6, 40, 4), (0.3, 1 << 16, 4)])
def test_similar_pairs_against_brute_force(spark, threshold, block, split):
    data = sets(500, 3)
    df = spark.createDataFrame([(i, " ".join(w), None) for i, w in enumerate(data)], "record_id bigint, title string, summary string")
    s = [set(w) for w in data]
    want = {(i, j) for i in range(len(s)) for j in range(i + 1, len(s)) if s[i] and s[j] and len(s[i] & s[j]) >= threshold * len(s[i] | s[j]) - 1e-9}
    j = setjoin.Join(df, "record_id", ["title", "summary"], threshold, block=block, split=split)
    rep = {r["id"]: r["rep"] for r in j.members.collect()}
    near = {(r["a"], r["b"]) for r in j.pairs.collect()}
    got = {(a, b) for a in rep for b in rep if a < b and (rep[a] == rep[b] or (min(rep[a], rep[b]), max(rep[a], rep[b])) in near)}
    assert got == want
    if block > 1000:
        assert set(map(tuple, setjoin.similar_pairs(df, "record_id", ["title", "summary"], threshold, part=3).collect())) == want


def test_similar_pairs_of_odd_rows(spark):
    rows = [(1, None, None), (2, "", ""), (3, "one", None), (4, "One!", ""), (4, "One!", ""), (None, "one", None), (5, "word " + "x" * 100_000, "y"), (6, " ".join(f"t{i}" for i in range(20_000)), None)]
    df = spark.createDataFrame(rows, "record_id bigint, title string, summary string")
    assert rows_of(setjoin.found(df)) == [(3, 4)]
    assert setjoin.found(df.limit(0)).count() == 0


def test_long_lists_are_sent_short_and_once_a_part(spark):
    """Not once for every word that follows, which is 170 times a set in place of 18."""
    from tidemark.plans.shared import park

    texts = spark.createDataFrame([(i + (1 << 40) * (i % 3), " ".join(w)) for i, w in enumerate(sets(300, 5))], "id bigint, text string")
    frequent = setjoin.frequent_words(texts)
    reps = park(setjoin.classes(setjoin.encode(texts.coalesce(1), frequent)), "test-classes")
    lists = park(setjoin.entries(reps, frequent, 0.6), "test-lists")
    sizes = lists.groupBy("word").agg(F.sum("m").alias("m"))
    assert sum(len(r["list"]) for r in lists.collect()) <= 32 * lists.agg(F.sum("m")).first()[0]
    low = reps.where("rep < 4294967296")
    short = setjoin.entries(low, frequent, 0.6)
    assert short.agg(F.sum(F.length("list")) == 22 * F.sum("m")).first()[0]
    cut = setjoin.candidates(lists, sizes, 0.6, block=20, split=4)
    assert cut._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    found = lambda df: set(map(tuple, setjoin.verify(df, reps, frequent, 0.6).select("a", "b").collect()))
    assert found(cut) == found(setjoin.candidates(lists, sizes, 0.6)) != set()


@pytest.mark.parametrize(("chunk", "dense", "new"), [(1 << 20, 512, False), (64, 3, False), (64, 512, True), (1 << 20, 3, True)])
def test_long_lists_in_slices_and_at_once(monkeypatch, chunk, dense, new):
    monkeypatch.setattr(setjoin, "CHUNK", chunk)
    monkeypatch.setattr(setjoin.Comparer, "DENSE", dense)
    r = random.Random(2)
    data = [sorted({0, *(x + r.randrange(3) * (r.random() < 0.1) for x in r.sample(range(1, 40), 12 + i % 3)), *range(40 + i % 2, 55)}) for i in range(400)]
    n = np.array([len(x) for x in data])
    e, second = np.zeros(len(data), setjoin.ENTRY), setjoin.merged(n, 0.6, 2)
    e["id"], e["n"] = range(len(data)), n
    e["n"][::5] |= setjoin.NEW if new else np.uint32(0)
    for i, x in enumerate(data):
        for w in x:
            e["s"][i, w % 2] ^= np.uint64(1 << w)
    compare = setjoin.Comparer(0.6, new, 4)
    compare.add(e, np.array([w for x, k in zip(data, second) for w in x[1:k]], "<u2"))
    compare.flush()
    got = {tuple(p) for x in compare.out for p in x.T.tolist()}
    s = [set(x) for x in data]
    want = {(i, j) for i in range(len(s)) for j in range(i + 1, len(s)) if len(s[i] & s[j]) >= 0.6 * len(s[i] | s[j]) and (not new or i % 5 == 0 or j % 5 == 0)}
    assert want and want <= got


def test_groups(spark):
    rows = [(1, "a b c d e"), (2, "e d c b a"), (3, "a b c d f"), (4, "a b c f g h"), (9, "z")]
    df = spark.createDataFrame(rows, "record_id bigint, title string")
    got = {r["record_id"]: (r["class_id"], r["copies"], r["links"]) for r in setjoin.groups(df, "record_id", ["title"], 0.6).collect()}
    assert got == {1: (1, 2, 1), 2: (1, 2, 1), 3: (1, 1, 2)}


# ---- 4


def test_linkage(spark):
    papers = [
        (1, "2601.00001", "AlphaTool: fast", ["https://github.example/own/alpha-tool", "https://github.example/big/hub"]),
        (2, "2601.00001v2", "AlphaToool: fast", None),
        (3, "2601.00002", "A study", ["https://github.example/big/hub"]),
        (4, "2601.00003", "BetaStone: x", ["https://other.example/paper"]),
        (5, "2601.00004", "Learning with Gamma Field", []),
        (6, "2601.00005", "A study of things", ["https://github.example/who/delta-path"]),
        (7, None, None, None),
    ]
    p = spark.createDataFrame([(a, b, None, c, d, 1) for a, b, c, d in papers], "paper_id bigint, external_id string, source_url string, title string, outbound_urls array<string>, names int")
    repos = [
        ("own/alpha-tool", ["https://alpha.example"], None), ("someworks/alpha-tool", ["https://someworks.example"], None), ("big/hub", [], None),
        ("x/beta-stone", ["https://beta.example"], None), ("gammahq/gamma-field", None, "https://gamma.example"), ("someteam/gamma-field", ["https://someteam.example"], None),
        ("who/delta-path", ["https://arxiv.example/abs/2601.00005v3"], None), (None, None, None),
    ]
    g = spark.createDataFrame([(*r, 0) for r in repos], "external_id string, outbound_urls array<string>, homepage string, name int")
    assert rows_of(linkage.found(p, g)) == [(1, "own/alpha-tool"), (2, "own/alpha-tool"), (5, "gammahq/gamma-field"), (6, "who/delta-path")]
    assert linkage.found(p.limit(0), g).count() == 0 and linkage.found(p, g.limit(0)).count() == 0


def test_linkage_by_short_and_long_names(spark):
    p = spark.createDataFrame([(1, "2601.00001", None, "Rift: a planner", []), (2, "2601.00002", None, "On The Very Long Road Home Again today", []), (3, None, None, "word " * 3000 + "end", None)], "paper_id bigint, external_id string, source_url string, title string, outbound_urls array<string>")
    g = spark.createDataFrame([("a/rift", [], None), ("b/the-very-long-road-home-again", [], None), ("c/word", [], None), ("https://github.com/d/else", [], None)], "external_id string, outbound_urls array<string>, homepage string")
    assert rows_of(linkage.found(p, g)) == [(1, "a/rift"), (2, "b/the-very-long-road-home-again"), (3, "c/word")]
    assert {r[0] for r in linkage.repositories(g).select("entity_key").collect()} >= {"d/else"}
    # a name that very many titles hold says little by itself
    many = spark.createDataFrame([(i, f"2601.{i:05d}", None, "Rift: a planner", []) for i in range(60)], p.schema)
    assert linkage.found(many, g).count() == 0


def test_linkage_by_what_many_share(spark):
    """A name or a site that 25 repositories share is weighed, not left out."""
    papers = [(1, "2601.00001", "AlphaTool: fast", []), (2, "2601.00002", "Betastones: x", ["https://hub.example/paper"]), (3, "2601.00003", "Betastones: y", []), (4, "2601.00004", "Other words", ["https://hub.example/paper"])]
    p = spark.createDataFrame([(a, b, None, c, d) for a, b, c, d in papers], "paper_id bigint, external_id string, source_url string, title string, outbound_urls array<string>")
    repos = [(f"own{i}/alpha-tool", [f"https://site{i}.example"] if i else [], None) for i in range(25)]  # all but one have a site of another name
    repos += [(f"many/thing{i:02d}x{'abcdefghijklmnopqrstuvwxyz'[i] * 3}", ["https://hub.example"], None) for i in range(24)] + [("x/beta-stone", ["https://hub.example"], None)]
    repos += [(f"rest/plain{i:03d}", [], None) for i in range(400)]
    g = spark.createDataFrame(repos, "external_id string, outbound_urls array<string>, homepage string")
    assert rows_of(linkage.found(p, g)) == [(1, "own0/alpha-tool"), (2, "x/beta-stone")]
    # names without sites: 21 bearers are as good as 20
    for n in (20, 21):
        g = spark.createDataFrame([(f"own{i}/alpha-tool", [], None) for i in range(n)], "external_id string, outbound_urls array<string>, homepage string")
        assert linkage.found(p, g).count() == n


# ---- 5

OLD = "appearance_id bigint, edition_id string, published_at timestamp_ntz, item_id string, item_name string, summary string, first_seen timestamp_ntz"
NEW = "incoming_id bigint, batch_no bigint, received_at timestamp_ntz, item_id string, item_name string, summary string, key string"


def test_history(spark):
    day = lambda d: dt.datetime(2026, 1, d)
    text = "the planner sorts many queries before the engine loads"
    old = spark.createDataFrame([(10, "2026-01-02", day(2), "artifact-alpha", "Alpha", text, day(1)), (11, "2026-01-03", day(3), "artifact-alpha", "Alpha", text + " now", None)], OLD)
    rows = [
        (1, 1, day(5), "Artifact_ALPHA", "other", "something else entirely", None),
        (2, 1, day(5), None, "Alpha", text, None),
        (3, 1, day(5), "artifact-new", "New", "completely different words stand here today", None),
        (4, 2, day(6), None, "New", "completely different words stand here", None),
        (5, 2, day(6), "artifact-alpha-2", "zzz", "nothing alike at all", None),
        (6, 2, day(6), None, None, None, None),
        (7, 3, day(7), "x", "other", "something else entirely", None),
        (None, 3, day(7), "x", "y", "z", None),
    ]
    new = spark.createDataFrame(rows, NEW)
    want = [(1, "artifact-alpha"), (2, "artifact-alpha"), (4, "artifact-new"), (7, "artifact-alpha")]
    assert rows_of(history.found(old, new)) == want
    m = {r["incoming_id"]: r for r in history.matches(old, new).collect()}
    assert m[2]["first_seen"] == day(1) and m[2]["edition_count"] == 3 and m[7]["edition_count"] == 4 and m[3]["is_new"]
    # batch by batch, with appended tables, gives the same
    h = history.History.of(history.published(old))
    got = []
    for b in (1, 2, 3):
        x = h.match(history.arriving(new.where(F.col("batch_no") == b)))
        got += [(r["id"], r["item_id"]) for r in x.where("not is_new").collect()]
        h.append()
    assert sorted(got) == want
    one = {r["incoming_id"]: tuple(r) for r in history.matches(old, new, at_once=1).collect()}
    assert one == {i: tuple(r) for i, r in m.items()}
    assert history.found(old.limit(0), new.limit(0)).count() == 0
    assert rows_of(history.found(old, new.limit(0))) == []


def test_history_opened_again(spark):
    """A history opened by its path finds the repeats that it would have found before."""
    day = lambda d: dt.datetime(2026, 1, d)
    text = "the planner sorts many queries before the engine loads"
    old = spark.createDataFrame([(10, "2026-01-02", day(2), "artifact-alpha", "Alpha", text, day(1)), (11, "2026-01-03", day(3), "artifact-alpha", "Alpha", text + " twice", day(1))], OLD)
    new = spark.createDataFrame([(1, 1, day(5), None, "Alpha", text + " now", None), (2, 1, day(5), None, "Beta", "nothing alike stands here", None)], NEW)
    h = history.History.of(history.published(old))
    again = history.History(spark, path=h.path)
    assert h.frequent and again.frequent == h.frequent
    for x in (h, again):
        assert [(r["id"], r["item_id"]) for r in x.match(history.arriving(new)).where("not is_new").collect()] == [(1, "artifact-alpha")]


# ---- 6


def test_leaks_against_brute_force(spark):
    r = random.Random(2)
    vocabulary = [f"v{i}" for i in range(50)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randrange(8, 40)))) for i in range(30)]
    docs = []
    for i in range(200):
        words = r.choices(vocabulary, k=r.randrange(0, 60))
        if r.random() < 0.5:
            w = r.choice(items)[1].split()
            a = r.randrange(len(w))
            words[5:5] = w[a : a + r.randrange(8, 20)]
        docs.append((i, "\n".join(f"<b>{w.upper()}</b>," if r.random() < 0.2 else w for w in words)))
    docs += [(500, None), (None, items[0][1]), (501, ""), (502, "pad " * 200_000 + items[0][1])]
    grams = {}
    for no, t in items:
        w = t.split()
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(no)
    want = set()
    for i, t in docs:
        w = leakage.words(t)
        for k in range(len(w) - 11):
            if i is not None:
                want |= {(i, no) for no in grams.get(tuple(w[k : k + 12]), ())}
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    e = spark.createDataFrame([*items, items[0], (None, "x"), (77, None)], "item_no bigint, text string")
    assert set(map(tuple, leakage.found(d, e).collect())) == want and want
    assert leakage.found(d.limit(0), e).count() == 0 and leakage.found(d, e.limit(0)).count() == 0


def test_blocks_and_filter_lose_nothing_within_the_radius(spark):
    r = np.random.default_rng(0)
    prints = r.integers(0, 2**63, 300, dtype=np.uint64)
    got = prints.copy()
    for i in range(300):
        for b in r.choice(64, 2, replace=False):
            got[i] ^= np.uint64(1) << np.uint64(int(b))
    assert (leakage.blocks(prints, 2) == leakage.blocks(got, 2)).any(1).all()
    bits = np.unpackbits(leakage._filter(spark.createDataFrame([(int(x),) for x in prints], "print bigint"), 2), bitorder="little")
    for t in range(3):
        one, two = leakage._places(leakage.blocks(prints, 2)[:, t], t)
        assert bits[one].all() and bits[two].all()


def test_near_windows(spark):
    item = " ".join(f"word{i}" for i in range(12))
    near = item.replace("word11", "other")
    d = spark.createDataFrame([(1, near), (2, item)], "doc_id bigint, text string")
    e = spark.createDataFrame([(1, item)], "item_no bigint, text string")
    assert rows_of(leakage.found(d, e)) == [(2, 1)]
    assert rows_of(leakage.leaks(d, e, radius=30, similarity=0.7).select("doc_id", "item_no")) == [(1, 1), (2, 1)]


def test_near_windows_against_brute_force(spark):
    """Every pair of windows within the radius and from the similarity on is found."""
    r = random.Random(6)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(r.choices(vocabulary, k=20))) for i in range(25)]
    docs = []
    for i in range(150):
        w = r.choice(items)[1].split()[r.randrange(4) :]
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        docs.append((i, " ".join(r.choices(vocabulary, k=5) + w)))
    fp, counts = leakage.Fingerprinter(12), np.zeros(leakage.COUNTERS)
    grams = lambda t: [t.split()[k : k + 12] for k in range(len(t.split()) - 11)]
    for _, t in items:
        for g in {tuple(g) for g in grams(t)}:
            for w in g:
                counts[leakage._slot(w)] += 1
    weight = np.log1p(counts.sum() / (1 + counts))
    prints = {tuple(g): int(fp.fingerprints(fp.number(g))[0]) for _, t in items + docs for g in grams(t)}
    for radius in (2, 8):
        want = {
            (i, no) for i, t in docs for no, u in items for g in grams(t) for h in grams(u)
            if (prints[tuple(g)] ^ prints[tuple(h)]).bit_count() <= radius and leakage.shingle_similarity(g, h, lambda w: weight[leakage._slot(w)]) >= 0.8
        }
        d, e = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_no bigint, text string")
        assert set(map(tuple, leakage.leaks(d, e, radius=radius, similarity=0.8).select("doc_id", "item_no").collect())) == want and want


def test_near_windows_of_any_distance(spark):
    r = random.Random(8)
    base = [f"w{r.randrange(30)}" for _ in range(200)]
    edit = lambda ws: [f"w{r.randrange(30)}" if r.random() < 0.04 else w for w in ws]
    docs = {i: edit(base[k : k + 40]) for i, k in enumerate(r.randrange(160) for _ in range(40))}
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id bigint, text string")
    e = spark.createDataFrame([(1, " ".join(base))], "item_no bigint, text string")
    held = {tuple(base[i : i + 12]) for i in range(189)}
    counts = np.zeros(leakage.COUNTERS)
    for g in held:
        for w in g:
            counts[leakage._slot(w)] += 1
    weight = np.log1p(counts.sum() / (1 + counts))
    near = lambda g, x: g == x or leakage.shingle_similarity(g, x, lambda w: weight[leakage._slot(w)]) >= 0.8
    want = {(i, sum(any(near(tuple(w[j : j + 12]), g) for j in range(29)) for g in held)) for i, w in docs.items()}
    assert set(map(tuple, leakage.edited(d, e).select("doc_id", "windows").collect())) == {x for x in want if x[1]}
    assert set(map(tuple, leakage.leaks(d, e, radius=2, similarity=0.8).select("doc_id", "windows").collect())) != {x for x in want if x[1]}


def test_markup():
    assert leakage.words('one <a href="' + "x" * 2000 + '" title=\'a b\'>two</a> <input disabled> three<br/>four') == ["one", "two", "three", "four"]
    assert leakage.words("if a<b and c>d then") == ["if", "a", "b", "and", "c", "d", "then"]
    assert leakage.words("a<!-- no <b> words -->b <!DOCTYPE html> c") == ["a", "b", "c"]
    assert leakage.words("x&nbsp;y &CounterClockwiseContourIntegral; caf&eacute;s &#233;t&#xE9; &nosuch; AT&T; &#0;z") == ["x", "y", "cafés", "été", "nosuch", "at", "t", "z"]


# ---- 7


def test_pfair_stays_within_a_block():
    blocks = {"a": 700, "b": 200, "c": 99, "d": 1}
    done, plan = dict.fromkeys(blocks, 0), mixing.pfair_schedule(blocks)
    assert len(plan) == 1000 and [s for _, _, s in plan] == list(range(1000))
    for s, k, slot in plan:
        assert k == done[s]
        done[s] += 1
        assert all(abs(done[x] - blocks[x] * (slot + 1) / 1000) < 1 for x in blocks)


def test_mixture(spark):
    r = random.Random(4)
    docs = [(i, r.choice("aaaab"), " ".join(["word"] * r.randrange(1, 60))) for i in range(400)] + [(1000, "unwanted", "x"), (1001, None, "x"), (None, "a", "x"), (1002, "a", None), (1003, "a", ""), (5, "a", "copy")]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("gone", 0.2, 4)], "source string, target_share double, max_repeats bigint")
    m = mixing.mixture(d, t).collect()
    total = sum(x["tokens"] for x in m)
    share = {s: sum(x["tokens"] for x in m if x["source"] == s) / total for s in "ab"}
    assert abs(share["a"] - 0.625) < 0.01 and abs(share["b"] - 0.375) < 0.01
    uses = {}
    for x in m:
        uses[x["source"], x["doc_id"]] = uses.get((x["source"], x["doc_id"]), 0) + 1
    assert max(v for (s, _), v in uses.items() if s == "a") == 1 and max(v for (s, _), v in uses.items() if s == "b") <= 3
    # every prefix of whole slots keeps the shares, up to a block and a document
    order = sorted(m, key=lambda x: (x["slot"], x["pass"], x["doc_id"]))
    seen = {"a": 0, "b": 0}
    for x in order:
        seen[x["source"]] += x["tokens"]
        assert abs(seen["a"] - 0.625 * sum(seen.values())) < 2 * 60 + total / 4096 * 2
    # many small frames and parts give the same documents, in blocks that stay small
    small = mixing.mixture(d, t, slots=16, block_tokens=20, part_tokens=500).collect()
    assert sorted((x["source"], x["doc_id"]) for x in small) == sorted((x["source"], x["doc_id"]) for x in m) or abs(sum(x["tokens"] for x in small) - total) < 120
    seen = {"a": 0, "b": 0}
    for x in sorted(small, key=lambda x: (x["slot"], x["pass"], x["doc_id"])):
        seen[x["source"]] += x["tokens"]
        assert abs(seen["a"] - 0.625 * sum(seen.values())) < 2 * 60 + 2 * 20
    s = {r["source"]: r for r in mixing.shares(d, t).collect()}
    assert s["gone"]["tokens"] == 0 and s["gone"]["actual_share"] == 0 and s["b"]["most_uses"] <= 3
    assert mixing.mixture(d.limit(0), t).count() == 0 and mixing.mixture(d, t.limit(0)).count() == 0


def test_quotas():
    t = [("a", 0.5, 1), ("b", 0.5, 2)]
    assert mixing.feasible_quotas(t, {"a": 100, "b": 10}) == {"a": 20.0, "b": 20.0}
    assert mixing.feasible_quotas(t, {"a": 100, "b": 10}, 100) == {"a": 80.0, "b": 20.0}
    assert mixing.feasible_quotas(t, {"a": 100, "b": 10}, 1000) == {"a": 100.0, "b": 20.0}
    assert mixing.feasible_quotas([], {}) == {}


# ---- 8


def test_word_forms():
    assert abuse.word_forms("m0r0n") == ["moron"] and abuse.word_forms("1d107") == ["idiot"] and abuse.word_forms("p******e!") == ["p*e"]
    assert abuse.word_forms("j.a.c.k.a.s.s.") == ["jackass"] and abuse.word_forms("stuuuupid") == ["stupid"] and abuse.word_forms("brаindead") == ["braindead"]
    assert abuse.word_forms("2024") == ["0"] and abuse.word_forms("**own**") == ["own"] and abuse.word_forms("...") == []


def test_long_sentences_are_read_through_windows():
    fz = abuse.Featurizer()
    tokens = [f"t{i}" for i in range(40)]
    f, s, doc, of = fz.batch([" ".join(tokens), "a b. c d"])
    assert list(of) == [0, 0, 0, 1, 2] and list(doc) == [0, 0, 0, 1, 1]
    whole = abuse.Featurizer().batch([" ".join(tokens[:24])])[0]
    assert set(whole) == set(f[s == 0])
    pairs = [set(abuse.Featurizer().batch([f"{x} {y}"])[0]) for x, y in zip(tokens, tokens[1:])]
    assert all(any(p <= set(f[s == k]) for k in range(3)) for p in pairs)


def planted(n, seed):
    r = random.Random(seed)
    fine = ["the planner sorts {0} queries.", "reviewers liked the {0} engine.", "a support agent bans words like rotten {0}.", "this {0} index is stupid but fast."]
    bad = ["you rotten {0} should leave.", "nobody wants a stupid {0} like you here."]
    docs, labels = [], []
    for i in range(n):
        is_bad = r.random() < 0.3
        lines = [r.choice(fine).format(f"w{r.randrange(40)}") for _ in range(6)]
        if is_bad:
            lines[r.randrange(6)] = r.choice(bad).format(f"w{r.randrange(40)}")
        docs.append((i, r.choice("st"), " ".join(lines)))
        labels.append((i, "abusive" if is_bad != (r.random() < 0.04) else "fine", is_bad))
    return docs, labels


def test_abuse_on_held_out_rows(spark):
    docs, labels = planted(900, 1)
    d = spark.createDataFrame([*docs, (5000, None, None), (5001, "s", ""), (None, "s", "x"), (5002, "s", "fine words " * 100_000)], "doc_id bigint, source string, text string")
    known = spark.createDataFrame([(i, y) for i, y, _ in labels[:500]] + [(3, None), (None, "fine"), (4, "fine")], "doc_id bigint, label string")
    s = {r["doc_id"]: r for r in abuse.scores(d, known).collect()}
    truth = {i: b for i, _, b in labels}
    right = sum((s[i]["severity"] >= abuse.SEVERE) == truth[i] for i in range(500, 900))
    assert right >= 0.97 * 400
    assert s[5000]["severity"] == 0 and s[5001]["severity"] == 0 and s[5002]["severity"] < abuse.SEVERE and None not in s
    rates = {r["source"]: r for r in abuse.rates(d, known).collect()}
    assert rates["s"]["documents"] + rates["t"]["documents"] + rates[None]["documents"] == 903
    assert abuse.found(d.limit(0), known).count() == 0
    assert abuse.found(d, known.limit(0)).count() == 0


# ---- all


def test_every_query_runs_on_the_smallest_tables(spark):
    for name, f in q.QUERIES.items():
        df = f(spark, "/root/testdata/sf0.001")
        assert df.columns and df.count() >= 0, name


def test_sql_gives_the_same_rows(spark):
    import glob
    import os

    import duckdb

    from tidemark.llm.sql import SQL

    c = duckdb.connect()
    for p in glob.glob("/root/testdata/sf0.001/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    for name, sql in SQL.items():
        df = q.QUERIES[name](spark, "/root/testdata/sf0.001")
        got = c.execute(sql)
        columns = sorted(x[0] for x in got.description)
        assert columns == sorted(df.columns), name
        want = [tuple(dict(zip([x[0] for x in got.description], r))[k] for k in columns) for r in got.fetchall()]
        assert sorted(map(str, want)) == sorted(map(str, [tuple(r[k] for k in columns) for r in df.collect()])), name
