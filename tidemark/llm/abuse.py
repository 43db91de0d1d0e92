"""Score documents for abusive, hateful or sexual content by cumulative-link ordinal regression.

Verdicts give a document a grade: 0 all fine, 1 disputed, 2 all abusive. A
document is as severe as its worst sentence, so the regression works on
sentences: those of fine documents are of grade 0, and the worst one of any
other document is taken as the bearer of its grade, chosen anew after each fit.
One weight per feature is shared by both thresholds; the score is the expected
grade, the sum of the probabilities to lie above each threshold.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.glyphs import LOOK_ALIKES
from tidemark.plans.shared import park

#: Labelled documents the model is fitted on at most (a fixed pseudo-random choice if there are more), and features of them altogether.
LABELLED, FEATURES = 20_000, 20_000_000
#: Features are hashed to so many bits.
BITS = 22
#: A longer sentence is read through a window of so many tokens that moves on by half of it, so that any two neighbours stand in one; it is as severe as its worst window.
WINDOW = 24
#: Expected grade from which a document counts as found: it is nearer to a higher grade than to 0.
SEVERE = 0.5

#: Signs that stand for letters inside a word.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "€": "e", "+": "t", "|": "l"}

_ALIKE = {ord(x[0]): x[1:] for x in LOOK_ALIKES}
_TAG = re.compile(r"</?[A-Za-z][^<>\s]*>")
_MASKED = re.compile(r"[^\W_]+[*#]+[^\W_]*|[^\W_]*[*#]+[^\W_]+")
_SPELT = re.compile(r"(?:[^\W\d_][.\-_*·]){2,}[^\W\d_][.\-_*·]?")
_RUN = re.compile(r"(.)\1{2,}")
_WORD = re.compile(r"[^\W_]+")
_END = re.compile(r"[.!?。:;]['\"”’)\]*]*$")


def word_forms(token: str) -> list[str]:
    """The words of a token without white space, however they are written.

    Compatibility characters, look-alikes, invisible characters, signs for letters and repeated letters are undone;
    what is masked by asterisks keeps its first and last letter; numbers are all one word.
    """
    t = _TAG.sub("", token)
    t = "".join(ch for ch in unicodedata.normalize("NFKC", t) if unicodedata.category(ch) != "Cf").lower()
    if not t.isascii() and re.search("[a-z]", t):
        t = t.translate(_ALIKE)
    t = t.strip("*_`~#>\"'()[]{}“”„«»,")
    if _SPELT.fullmatch(t.strip(",;:!?")):
        return [_RUN.sub(r"\1", "".join(_WORD.findall(t)))]
    masked = _MASKED.fullmatch(t.strip(".,;:!?"))
    if masked:
        m = masked.group()
        return [f"{m[0]}*{m[-1]}"]
    out = []
    core = t.rstrip("!?.,;:")
    if re.search(r"[^\W\d_]", core) and re.search(r"[0-9@$!€+|]", core) and not re.search(r"[/\\:=]", core):
        plain = "".join(LEET.get(ch, ch) for ch in core)
        # one letter is enough where every other sign of a longer word may stand for one
        whole = len(core) >= 5 and all(ch in LEET or ch.isalpha() for ch in core)
        t = plain if whole or len(re.findall(r"[^\W\d_]", core)) >= 2 else core
    for w in _WORD.findall(t):
        if w.isdigit():
            out.append("0")
        else:
            out.append(_RUN.sub(r"\1", w))
    return out


class Featurizer:
    """Hashed words and word pairs of sentences. Tokens are looked up in a memo, so rare forms are worked out once."""

    MEMO = 1_000_000

    def __init__(self, bits: int = BITS) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self._reset()

    def _reset(self) -> None:
        self.memo: dict[str, int] = {"\x00": 0}
        self.ids: list[np.ndarray] = [np.empty(0, np.uint64)]
        self.ends: list[bool] = [True]
        self.letter: list[str] = [""]
        self.table = None

    def _learn(self, token: str) -> int:
        import xxhash

        words = word_forms(token)
        # with each word its letters in order, as two may have been swapped
        marks = [x for w in words for x in ((w, "~" + "".join(sorted(w))) if len(w) > 4 else (w,))]
        self.ids.append(np.array([xxhash.xxh3_64_intdigest(x) for x in marks], np.uint64))
        self.ends.append(bool(_END.search(token)))
        self.letter.append(words[0] if len(words) == 1 and len(words[0]) == 1 and words[0].isalpha() else "")
        self.memo[token] = k = len(self.ids) - 1
        self.table = None
        return k

    def _tables(self):
        if self.table is None:
            n = np.array([len(x) for x in self.ids])
            self.table = n, np.concatenate([[0], np.cumsum(n)[:-1]]), np.concatenate(self.ids), np.array(self.ends), np.array([bool(x) for x in self.letter])
        return self.table

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``feature, window, document of each window, sentence of each window``; a sentence of up to ``WINDOW`` tokens is one window."""
        import xxhash

        if len(self.memo) > self.MEMO:
            self._reset()
        memo, learn = self.memo, self._learn
        codes, sizes = [], []
        for t in texts:
            tokens = (t or "").replace("\n", " \x00 ").split()
            tokens.append("\x00")
            codes += [memo[x] if x in memo else learn(x) for x in tokens]
            sizes.append(len(tokens))
        codes = np.array(codes, np.int64)
        n, start, flat, ends, letter = self._tables()
        doc = np.repeat(np.arange(len(texts)), sizes)
        ends_here = ends[codes]
        after = np.concatenate([[True], ends_here[:-1]])
        begin = np.flatnonzero(after)
        length = np.diff(np.concatenate([begin, [len(codes)]]))
        windows = np.where(length <= WINDOW, 1, -(-length // (WINDOW // 2)) - 1)
        of = np.repeat(np.arange(len(begin)), windows)
        place = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        low = begin[of] + place * (WINDOW // 2)
        size = np.minimum(WINDOW, begin[of] + length[of] - low)
        at = np.arange(int(size.sum())) + np.repeat(low - (np.cumsum(size) - size), size)
        codes, ends_here, sentence, doc_of = codes[at], ends_here[at], np.repeat(np.arange(len(of)), size), doc[low]
        k = n[codes]
        words = flat[np.repeat(start[codes] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())]
        at = np.repeat(sentence, k)
        pair = (words[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (words[1:] + np.uint64(0x632BE59BD9B4E019))
        pair = (pair ^ (pair >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        pair ^= pair >> np.uint64(32)
        same = at[:-1] == at[1:]
        features, where = [words, pair[same]], [at, at[:-1][same]]
        # letters set apart: the word they spell
        alone = letter[codes] & ~ends_here
        if alone.any():
            other = sentence[1:] != sentence[:-1]
            first, last = np.flatnonzero(alone & np.concatenate([[True], ~alone[:-1] | other])), np.flatnonzero(alone & np.concatenate([~alone[1:] | other, [True]])) + 1
            for a, b in zip(first, last):
                if b - a >= 3:
                    spelt = "".join(self.letter[c] for c in codes[a:b])
                    features.append(np.array([xxhash.xxh3_64_intdigest(spelt)], np.uint64))
                    where.append(sentence[a : a + 1])
        f, s = np.concatenate(features) & self.mask, np.concatenate(where)
        return f.astype(np.int64), s, doc_of, of


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def scale(s: np.ndarray, n: int) -> np.ndarray:
    """Factor of each of ``n`` sentences by which long ones count no more than short ones."""
    return 3.0 / np.sqrt(np.maximum(np.bincount(s, minlength=n), 4))


def merged(f: np.ndarray, s: np.ndarray, grade: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sentences with the same features and grade as one with their weights together; ``s`` must be in order."""
    n = len(grade)
    end = np.searchsorted(s, np.arange(n), "right")
    x = (f.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    total = np.concatenate([[np.uint64(0)], np.cumsum(x ^ (x >> np.uint64(32)), dtype=np.uint64)])
    start = np.concatenate([[0], end[:-1]])
    sign = total[end] - total[start] + grade.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    _, first, group = np.unique(sign, return_index=True, return_inverse=True)
    to = np.full(n, -1)
    to[first] = np.arange(len(first))
    mine = to[s] >= 0
    return f[mine], to[s[mine]], grade[first], np.bincount(group, weight, len(first))


class Ordinal:
    """Cumulative-link model of the grades 0, 1, 2 over sparse counts; fitted by full-batch Adam with weight decay."""

    def __init__(self, features: int) -> None:
        self.w, self.low, self.gap = np.zeros(features), 3.0, 0.0
        self.m, self.v = np.zeros(features + 2), np.zeros(features + 2)
        self.steps = 0

    def cuts(self) -> tuple[float, float]:
        return self.low, self.low + np.exp(self.gap)

    def score(self, f: np.ndarray, s: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(s, self.w[f], n) * scale(s, n)

    def severity(self, score: np.ndarray) -> np.ndarray:
        a, b = self.cuts()
        return _sigmoid(score - a) + _sigmoid(score - b)

    def fit(self, f: np.ndarray, s: np.ndarray, grade: np.ndarray, weight: np.ndarray, steps: int, decay: float = 4e-5, rate: float = 0.05) -> None:
        f, s, grade, weight = merged(f, s, grade, weight)
        n, total = len(grade), weight.sum()
        k = scale(s, n)
        for _ in range(steps):
            z = np.bincount(s, self.w[f], n) * k
            a, b = self.cuts()
            pa, pb = _sigmoid(a - z), _sigmoid(b - z)  # P(grade <= 0), P(grade <= 1)
            p = np.maximum(np.choose(grade, [pa, pb - pa, 1 - pb]), 1e-9)
            da, db = pa * (1 - pa), pb * (1 - pb)
            up_a = np.choose(grade, [da, -da, 0 * da]) / p * weight / total
            up_b = np.choose(grade, [0 * db, db, -db]) / p * weight / total
            g = np.empty(len(self.w) + 2)
            g[:-2] = np.bincount(f, ((up_a + up_b) * k)[s], len(self.w)) + decay * self.w
            g[-2] = -(up_a + up_b).sum()
            g[-1] = -(up_b * np.exp(self.gap)).sum()
            self.steps += 1
            self.m = 0.9 * self.m + 0.1 * g
            self.v = 0.99 * self.v + 0.01 * g * g
            step = rate * (self.m / (1 - 0.9**self.steps)) / (np.sqrt(self.v / (1 - 0.99**self.steps)) + 1e-6)
            self.w -= step[:-2]
            self.low -= step[-2]
            self.gap = float(np.clip(self.gap - step[-1], -3, 3))


def train(rows: list[tuple[bytes, bytes, int]]) -> dict:
    """A model from ``(features, sentence of each feature, grade)`` of each labelled document.

    Verdicts are checked first: each half of the documents is scored by a model of the other half, and an abusive
    document without a sentence that this model finds bad, or a sentence of a fine one that it finds clearly bad, takes
    no part in the final fit.
    """
    rows = [r for r in rows if len(r[0])]
    grades = np.array([g for _, _, g in rows], np.int64)
    if not rows or not (grades == 0).any() or not (grades > 0).any():
        return {"ids": np.empty(0, np.int64), "w": np.empty(0), "cuts": (3.0, 4.0)}
    f = [np.frombuffer(a, np.int32).astype(np.int64) for a, _, _ in rows]
    s = [np.frombuffer(b, np.int32).astype(np.int64) for _, b, _ in rows]
    base = np.concatenate([[0], np.cumsum([x.max() + 1 for x in s])])
    doc = np.repeat(np.arange(len(rows)), np.diff(base))
    s = np.concatenate([x + o for x, o in zip(s, base)])
    ids, f = np.unique(np.concatenate(f), return_inverse=True)
    n, of = len(doc), grades[doc]
    half = np.arange(len(rows)) % 2
    first = _first_guess(f, s, doc, grades, len(ids))
    out = np.zeros(n)
    for side in (0, 1):
        here = half[doc] != side
        if not (grades[half != side] > 0).any():
            here = np.ones(n, bool)
        model = Ordinal(len(ids))
        _rounds(model, f, s, doc, of, np.where(here, first, -np.inf), here.astype(float), rounds=2, steps=50)
        out = np.where(half[doc] == side, model.score(f, s, n), out)
    a, b = model.cuts()
    severity = _sigmoid(out - a) + _sigmoid(out - b)
    worst = np.zeros(len(rows))
    np.maximum.at(worst, doc, severity)
    trusted = np.where(of > 0, worst[doc] >= 0.3, severity <= 1.2)
    if not (trusted & (of > 0)).any():
        trusted = np.ones(n, bool)
    model = Ordinal(len(ids))
    _rounds(model, f, s, doc, of, np.where(trusted, out, -np.inf), trusted.astype(float), rounds=2, steps=80)
    return {"ids": ids, "w": model.w, "cuts": model.cuts()}


def _first_guess(f: np.ndarray, s: np.ndarray, doc: np.ndarray, grades: np.ndarray, features: int) -> np.ndarray:
    """Summed log-odds of the features of each sentence to stand in a document that is not fine."""
    pairs = np.unique(np.stack([doc[s], f]), axis=1)
    bad = np.bincount(pairs[1], grades[pairs[0]] > 0, features)
    fine = np.bincount(pairs[1], grades[pairs[0]] == 0, features)
    odds = np.log((bad + 0.1) / ((grades > 0).sum() + 1)) - np.log((fine + 0.5) / ((grades == 0).sum() + 1))
    odds = np.where(bad >= 2, np.maximum(odds, 0), 0)
    return np.bincount(s, odds[f], len(doc)) / np.sqrt(np.maximum(np.bincount(s, minlength=len(doc)), 1))


def _rounds(model: Ordinal, f: np.ndarray, s: np.ndarray, doc: np.ndarray, of: np.ndarray, score: np.ndarray, weight: np.ndarray, rounds: int, steps: int) -> None:
    """Fit, and choose the sentence that bears the grade of each document anew, ``rounds`` times; sentences of weight 0 take no part."""
    n = len(doc)
    for r in range(rounds):
        if r:
            score = np.where(weight > 0, model.score(f, s, n), -np.inf)
        order = np.lexsort((score, doc))
        worst = np.zeros(n, bool)
        worst[order[np.concatenate([doc[order][1:] != doc[order][:-1], [True]])]] = True
        bears = worst & (of > 0)
        if r:
            bears |= (of == 2) & (model.severity(model.score(f, s, n)) > 1.8)
        keep = np.flatnonzero((weight > 0) & ((of == 0) | bears))
        to = np.full(n, -1)
        to[keep] = np.arange(len(keep))
        mine = to[s] >= 0
        model.fit(f[mine], to[s[mine]], of[keep], np.where(of[keep] > 0, 4.0, 1.0), steps)


def graded(labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """``doc_id, grade``: 0 all verdicts fine, 2 all abusive, 1 disputed; documents without a verdict are left out."""
    by = labels.where("doc_id is not null and label in ('abusive', 'fine')").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    g = by.agg(F.max((F.col("label") == "abusive").cast("int")).alias("bad"), F.max((F.col("label") == "fine").cast("int")).alias("fine"))
    g = g.select("doc_id", F.when(F.col("bad") == 0, 0).when(F.col("fine") == 0, 2).otherwise(1).alias("grade"))
    return g.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def fit(documents: DataFrame, labels: DataFrame, limit: int = LABELLED, features: int = FEATURES) -> dict:
    """The model; features are made where the documents are, and only ``features`` of them, of at most ``limit`` labelled documents, are gathered."""
    chosen = F.broadcast(graded(labels, limit))  # at most limit rows
    texts = documents.where("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(chosen, "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fz = Featurizer()
        for b in batches:
            rows, texts = [], b["text"].tolist()
            for lo in range(0, len(texts), 256):
                part = texts[lo : lo + 256]
                f, s, doc, _ = fz.batch(part)
                order = np.argsort(s, kind="stable")
                f, s = f[order], s[order]
                first = np.searchsorted(doc, np.arange(len(part) + 1))
                cut = np.searchsorted(s, first)
                for k in range(len(part)):
                    i, j = cut[k], cut[k + 1]
                    rows.append((f[i:j].astype(np.int32).tobytes(), (s[i:j] - first[k]).astype(np.int32).tobytes()))
            yield pd.DataFrame({"doc_id": b["doc_id"], "f": [r[0] for r in rows], "s": [r[1] for r in rows], "n": [len(r[0]) // 4 for r in rows], "grade": b["grade"]})

    made = park(texts.mapInPandas(run, "doc_id bigint, f binary, s binary, n bigint, grade int"), "abuse-features")
    # documents in a fixed order as far as the features go; the window holds numbers of the labelled documents only
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("f"))
    fits = made.select("doc_id", F.xxhash64("f").alias("h"), F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("sofar")).where(F.col("sofar") <= features).select("doc_id", "h").distinct()
    got = made.withColumn("h", F.xxhash64("f")).join(fits, ["doc_id", "h"]).select("doc_id", "f", "s", "grade").toPandas().sort_values(["doc_id", "f"], kind="stable")
    return train(list(zip(got["f"].map(bytes), got["s"].map(bytes), got["grade"])))


def scores(documents: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """``doc_id, source, severity, sentences, severe_sentences`` of every document.

    ``severity`` is the expected grade (0 to 2) of the worst sentence. A null or empty text has severity 0; documents
    without id are left out; repeated rows are each scored; without verdicts of both kinds every severity is 0; an
    empty table gives an empty result; other columns are ignored.
    """
    model = fit(documents, labels, limit)
    spark = documents.sparkSession
    weights = np.zeros(1 << BITS, np.float32)
    weights[model["ids"]] = model["w"]
    sent = spark.sparkContext.broadcast(weights)  # of fixed size
    low, high = map(float, model["cuts"])
    known = len(model["ids"]) > 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fz, w = Featurizer(), sent.value
        for b in batches:
            severity, severe, size = np.zeros(len(b)), np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            texts = b["text"].tolist()
            lo = 0
            while lo < len(texts):
                hi, chars = lo, 0
                while hi < len(texts) and (hi == lo or chars < 2_000_000):
                    chars += len(texts[hi] or "")
                    hi += 1
                f, s, doc, of = fz.batch(texts[lo:hi])
                z = np.bincount(s, w[f], len(doc)) * scale(s, len(doc))
                e = _sigmoid(z - low) + _sigmoid(z - high) if known else np.zeros(len(doc))
                some = np.bincount(s, minlength=len(doc)) > 0
                e[~some] = 0.0
                np.maximum.at(severity, lo + doc, e)
                worst, said = np.zeros(of[-1] + 1), np.zeros(of[-1] + 1, bool)
                np.maximum.at(worst, of, e)
                said[of[some]] = True
                doc = doc[np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))]  # of each sentence
                size[lo:hi] += np.bincount(doc[said], minlength=hi - lo)
                severe[lo:hi] += np.bincount(doc[worst >= SEVERE], minlength=hi - lo)
                lo = hi
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "severity": severity.round(6), "sentences": size, "severe_sentences": severe})

    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id bigint, source string, severity double, sentences bigint, severe_sentences bigint")


def rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, found ones, their rate and the mean severity of every source; null is a source of its own."""
    s = scores(documents, labels).groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum((F.col("severity") >= SEVERE).cast("bigint")).alias("severe"), F.round(F.avg("severity"), 4).alias("mean_severity")
    )
    return s.withColumn("rate", F.round(F.col("severe") / F.col("documents"), 6))


def found(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """p8_found: documents whose worst sentence is expected nearer to a higher grade than to 0."""
    return scores(documents, labels).where(F.col("severity") >= SEVERE).select("doc_id")
