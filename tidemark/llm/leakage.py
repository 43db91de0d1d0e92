"""Passages of evaluation items inside a training corpus.

Every window of ``n`` words gets a 64-bit SimHash: each word adds its hash as a
vector of +1 and -1, and the sign of each sum gives a bit. Windows of items are
put into ``radius + 1`` block tables; two fingerprints within ``radius`` bits
agree wholly in one block, so the tables lose no pair within the radius, and
windows with the same words are at distance 0. What the tables hold goes to the
workers as a filter of fixed size; windows of documents that pass it are joined
with the tables and verified by Hamming distance and by their weighted
shingles, and for the strict setting word by word.
"""

from __future__ import annotations

import html.entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.shared import park

_WORD = re.compile(r"[^\W_]+")
#: Attributes that are written without a value.
_BARE = "allowfullscreen|async|autofocus|autoplay|checked|controls|default|defer|disabled|download|formnovalidate|hidden|inert|ismap|itemscope|loop|multiple|muted|nomodule|novalidate|open|playsinline|readonly|required|reversed|selected"
#: A tag has attributes with values, however long, or attributes that need none; ``a<b and c>d`` is text.
_TAG = re.compile(
    r"<!--.*?-->|<![a-z][^<>]*>|<\?[a-z].*?\?>|</?[a-z][a-z0-9:-]*(?:\s+(?:[^\s\"'<>/=]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+)|(?:" + _BARE + r")(?![^\s/>])))*\s*/?>",
    re.IGNORECASE | re.DOTALL,
)
_ENTITY = re.compile(r"&(?:#(\d+)|#[xX]([0-9a-fA-F]+)|([A-Za-z][A-Za-z0-9]*));")

#: Words of a batch that are fingerprinted at once; longer texts are cut into overlapping pieces.
CHUNK = 1 << 17
#: Bits of the filter and counters of the word weights; both go to the workers and do not grow with the data.
FILTER, COUNTERS = 1 << 25, 1 << 18
#: Parts of the join, so that a window which a third of all documents hold is no task of its own.
SALT = 16


def _character(m: re.Match) -> str:
    decimal, hexa, name = m.groups()
    if name:
        return html.entities.html5.get(name + ";", m.group())
    digits = (decimal or hexa).lstrip("0")[:8] or "0"
    code = int(digits, 10 if decimal else 16)
    return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else " "


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits; tags and comments count as white space, entities as the character they stand for."""
    text = text or ""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(_character, text)
    return _WORD.findall(text.lower())


def _vectors(new: list[str]) -> np.ndarray:
    """A row of 64 times +1 or -1 for each word."""
    import xxhash

    h = np.array([xxhash.xxh3_64_intdigest(w) for w in new], dtype=np.uint64)
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int8) * 2 - 1


class Fingerprinter:
    """Word numbers and vectors as they come up, and the fingerprints of windows."""

    def __init__(self, n: int) -> None:
        self.n, self.ids = n, {}
        self.table = np.empty((1024, 64), np.int8)

    def number(self, tokens: list[str]) -> np.ndarray:
        ids = self.ids
        new = [w for w in dict.fromkeys(tokens) if w not in ids]
        if new:
            start = len(ids)
            for i, w in enumerate(new):
                ids[w] = start + i
            while len(ids) > len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            self.table[start : len(ids)] = _vectors(new)
        return np.fromiter(map(ids.__getitem__, tokens), np.int32, len(tokens))

    def fingerprints(self, ids: np.ndarray) -> np.ndarray:
        """One fingerprint for each window of ``n`` words; sums wrap in 8 bits, which differences undo for n < 128."""
        if len(ids) < self.n:
            return np.empty(0, np.uint64)
        sums = np.zeros((len(ids) + 1, 64), np.int8)
        np.cumsum(self.table[ids], axis=0, dtype=np.int8, out=sums[1:])
        bits = (sums[self.n :] - sums[: -self.n]) > 0
        return np.packbits(bits, axis=1).view(np.uint64).ravel()


def blocks(prints: np.ndarray, radius: int) -> np.ndarray:
    """A row of ``radius + 1`` blocks for each fingerprint: its bits in as many parts."""
    cuts = np.linspace(0, 64, radius + 2).astype(int)
    return np.stack([(prints >> np.uint64(a)) & np.uint64((1 << int(b - a)) - 1) for a, b in zip(cuts, cuts[1:])], axis=1)


def _places(block: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the filter that stand for a block of a table."""
    x = (block + np.uint64((table + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(8)) % np.uint64(FILTER), (x >> np.uint64(37)) % np.uint64(FILTER)


def shingle_similarity(a: list[str], b: list[str], weight) -> float:
    """Weighted Jaccard similarity of the sets of word pairs of two windows; a pair weighs as its words do together."""
    x, y = set(zip(a, a[1:])), set(zip(b, b[1:]))
    of = lambda s: sum(weight(u) + weight(v) for u, v in sorted(s))
    return of(x & y) / of(x | y)


def _item_windows(items: DataFrame, n: int) -> DataFrame:
    """``item_no, print, window`` of each distinct window of each item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for no, text in zip(b["item_no"], b["text"]):
                fp, w = Fingerprinter(n), words(text)
                if len(w) >= n:
                    got = pd.DataFrame({"item_no": no, "print": fp.fingerprints(fp.number(w)).astype(np.int64), "window": [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]})
                    yield got.drop_duplicates()

    return items.mapInPandas(run, "item_no bigint, print bigint, window string").distinct()


def _filter(windows: DataFrame, radius: int) -> np.ndarray:
    """The filter as bytes; bits are set and combined where the windows are, and at most FILTER bits arrive here."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = blocks(b["print"].to_numpy().astype(np.uint64), radius)
            at = [p for t in range(radius + 1) for p in _places(parts[:, t], t)]
            yield pd.DataFrame({"bit": np.unique(np.concatenate(at)).astype(np.int64) + 1})

    bits = windows.select("print").mapInPandas(run, "bit bigint").groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("b"))
    out = np.zeros(FILTER // 8, np.uint8)
    for r in bits.collect():
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(bytes(r["b"]), np.uint8)
    return out


def _slot(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word) % COUNTERS


def _weights(windows: DataFrame) -> np.ndarray:
    """Weight of each counter: the rarer the words of a counter are in windows of items, the higher; at most COUNTERS numbers arrive here."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c = Counter(_slot(w) for x in b["window"] for w in x.split(" "))
            yield pd.DataFrame({"slot": list(c), "n": list(c.values())})

    counts = np.zeros(COUNTERS)
    for r in windows.select("window").mapInPandas(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        counts[r["slot"]] = r["n"]
    return np.log1p(counts.sum() / (1 + counts))


def _shingle(u: str, v: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(f"{u} {v}") >> 1


def _keys(window: list[str], weight, similarity: float) -> list[int]:
    """The heaviest word pairs of a window, of which two windows that are similar enough share one: the others together weigh too little."""
    pairs = sorted((-weight(u) - weight(v), _shingle(u, v)) for u, v in set(zip(window, window[1:])))
    rest, total, out = -sum(w for w, _ in pairs), -sum(w for w, _ in pairs), []
    for w, h in pairs:
        if rest < similarity * total - 1e-6:
            break
        out.append(h)
        rest += w
    return out


def _all_similar(texts: DataFrame, distinct: DataFrame, weights, n: int, similarity: float) -> DataFrame:
    """``doc_id, t, block, other, text`` of the windows of documents that may be similar to one of an item, and ``print, window, t, block`` of items.

    A window is left out where the word pairs that no item has weigh too much.
    """

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"print": sorted({_shingle(u, v) for x in b["window"] for u, v in zip(x.split(" "), x.split(" ")[1:])})}, dtype="int64")

    sent = texts.sparkSession.sparkContext.broadcast(_filter(distinct.mapInPandas(shingles, "print bigint").distinct(), 0))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, table = np.unpackbits(sent.value, bitorder="little").view(bool), weights.value
        weight = lambda w: table[_slot(w)]
        for b in batches:
            for doc, text in zip(b["doc_id"].tolist(), b["text"]):
                w = words(text)
                if len(w) < n:
                    continue
                h = np.array([_shingle(x, y) for x, y in zip(w, w[1:])], np.uint64)
                one, two = _places(h, 0)
                of = np.array([weight(x) for x in w])
                heavy = of[1:] + of[:-1]
                # a pair that stands twice in a window counts once: it may take nothing from what is missing, but its weight from the whole
                missing = np.concatenate([[0], np.cumsum(np.where(bits[one] & bits[two], 0, heavy))])
                whole = np.concatenate([[0], np.cumsum(heavy)])
                gone, all_ = missing[n - 1 :] - missing[: -n + 1], whole[n - 1 :] - whole[: -n + 1]
                rows = []
                for i in np.flatnonzero((gone <= (1 - similarity) * all_ + 1e-6) | (gone > 0) & _repeats(h, n - 1)).tolist():
                    window = w[i : i + n]
                    rows += [(doc, 0, k, 0, " ".join(window)) for k in _keys(window, weight, similarity)]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "t", "block", "other", "text"]).drop_duplicates()

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight = lambda w: weights.value[_slot(w)]
        for b in batches:
            got = [(p, x, s, 0, k) for p, x, s in zip(b["print"], b["window"], b["salt"]) for k in _keys(x.split(" "), weight, similarity)]
            yield pd.DataFrame(got, columns=["print", "window", "salt", "t", "block"])

    return texts.mapInPandas(search, "doc_id bigint, t int, block bigint, other bigint, text string"), tables


def _repeats(h: np.ndarray, m: int) -> np.ndarray:
    """Whether a value stands twice among the ``m`` from each place on."""
    order = np.argsort(h, kind="stable")
    near = np.flatnonzero((h[order][1:] == h[order][:-1]) & (np.diff(order) < m))
    mark = np.zeros(len(h) + 1, np.int64)
    np.add.at(mark, np.maximum(0, order[near + 1] - m + 1), 1)
    np.add.at(mark, order[near] + 1, -1)
    return np.cumsum(mark)[: len(h) - m + 1] > 0


def leaks(documents: DataFrame, items: DataFrame, n: int = 12, radius: int | None = None, similarity: float = 1.0) -> DataFrame:
    """``doc_id, item_no, windows, share`` for each document that holds a passage of an item.

    ``windows`` counts the distinct windows of ``n`` words of the item that stand in the document, ``share`` is their
    part of all distinct windows of the item. With ``similarity`` 1.0 a window must have the same words in the same
    order, which is at least ``n`` consecutive words in common, and no radius is needed. Below 1.0 all windows count
    from that weighted shingle similarity on, or with a ``radius`` those only whose fingerprints are within so many bits.

    Items are nowhere gathered; the filter and the word weights that are sent to the workers have a fixed size.
    Null texts and texts or items of fewer than ``n`` words give no row, nor do null ids; repeated documents or items
    are reported once; empty tables give an empty result; other columns are ignored.
    """
    if not 2 <= n < 128:
        raise ValueError("n must be from 2 to 127")
    exact = similarity >= 1.0
    every = not exact and radius is None
    radius = 0 if exact or every else radius
    spark = documents.sparkSession
    texts = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = items.where("item_no is not null and text is not null").select(F.col("item_no").cast("bigint"), F.col("text").cast("string"))
    windows = park(_item_windows(held, n), "leakage-windows")
    distinct = park(windows.select("print", "window").distinct(), "leakage-distinct")
    sent = spark.sparkContext.broadcast(_filter(distinct, radius))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, fp = np.unpackbits(sent.value, bitorder="little").view(bool), Fingerprinter(n)

        def look(tokens: list[list[str]], docs: list[int]) -> pd.DataFrame | None:
            flat = [w for t in tokens for w in t]
            ids = fp.number(flat)
            owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
            prints = fp.fingerprints(ids)
            if not len(prints):
                return None
            inside = owner[: len(prints)] == owner[n - 1 :]
            parts = blocks(prints, radius)
            at, table = [], []
            for t in range(radius + 1):
                one, two = _places(parts[:, t], t)
                hit = np.flatnonzero(bits[one] & inside)
                hit = hit[bits[two[hit]]]
                at.append(hit)
                table.append(np.full(len(hit), t))
            at, table = np.concatenate(at), np.concatenate(table)
            if not len(at):
                return None
            got = pd.DataFrame({"doc_id": np.asarray(docs)[owner[at]], "t": table, "block": parts[at, table].astype(np.int64), "other": prints[at].astype(np.int64), "text": [" ".join(flat[i : i + n]) for i in at.tolist()]})
            return got.drop_duplicates()

        for batch in batches:
            tokens, docs, size = [], [], 0
            for i, text in zip(batch["doc_id"].tolist(), batch["text"]):
                w = words(text)
                for s in range(0, max(1, len(w) - n + 1), CHUNK):
                    part = w[s : s + CHUNK + n - 1]
                    if len(part) >= n:
                        tokens.append(part)
                        docs.append(i)
                        size += len(part)
                    if size >= CHUNK:
                        got = look(tokens, docs)
                        tokens, docs, size = [], [], 0
                        if got is not None:
                            yield got
            got = look(tokens, docs) if tokens else None
            if got is not None:
                yield got

    if not exact:
        weights = spark.sparkContext.broadcast(_weights(windows))
    if every:
        near, tables = _all_similar(texts, distinct, weights, n, similarity)
    else:
        near = texts.mapInPandas(search, "doc_id bigint, t int, block bigint, other bigint, text string")
    near = near.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)))
    salted = distinct.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))))
    if exact:
        found = near.join(salted, (near["block"] == salted["print"]) & (near["text"] == salted["window"]) & (near["salt"] == salted["salt"])).select("doc_id", "window")
    else:

        def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            weight = lambda w: weights.value[_slot(w)]
            for b in batches:
                ok = [x == y or shingle_similarity(x.split(" "), y.split(" "), weight) >= similarity for x, y in zip(b["text"], b["window"])]
                yield b.loc[ok, ["doc_id", "window"]]

        def by_block(bs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in bs:
                parts = blocks(b["print"].to_numpy().astype(np.uint64), radius)
                for t in range(radius + 1):
                    yield b.assign(t=t, block=parts[:, t].astype(np.int64))

        keyed = salted.mapInPandas(tables if every else by_block, "print bigint, window string, salt bigint, t int, block bigint")
        pairs = near.join(keyed, ["t", "block", "salt"])
        if not every:
            pairs = pairs.where(F.bit_count(F.col("print").bitwiseXOR(F.col("other"))) <= radius)
        found = pairs.select("doc_id", "text", "window").distinct().mapInPandas(verify, "doc_id bigint, window string")
    owners = windows.select("window", "item_no")
    total = windows.groupBy("item_no").agg(F.count(F.lit(1)).alias("total"))
    out = found.distinct().join(owners, "window").groupBy("doc_id", "item_no").agg(F.count(F.lit(1)).alias("windows"))
    return out.join(total, "item_no").select("doc_id", "item_no", "windows", (F.col("windows") / F.col("total")).alias("share"))


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """p6_found: documents with at least 12 consecutive words of an item."""
    return leaks(documents, items).select("doc_id", "item_no")


def edited(documents: DataFrame, items: DataFrame) -> DataFrame:
    """p6_edited: as ``leaks``, with windows that were edited a little."""
    return leaks(documents, items, similarity=0.8)
