"""One consistent form for texts that look the same but are spelled with other characters.

A text is cut at plain white space into segments. Segments that hold a character
of the mapping tables are collected once each, exploded to positioned code
points and joined with the (Unicode-sized, broadcast) tables of decompositions
and look-alikes; combining marks are ordered by class and recomposed, and the
segments and then the texts are rebuilt.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.shared import join_by_value, park, partitions

#: Letters of other scripts that look like a plain letter, each followed by that letter.
LOOK_ALIKES = (
    "аa вb еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ӏl ѵv"  # Cyrillic small
    " АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ԌG ԚQ ԜW ѴV"  # Cyrillic capital
    " αa οo νv ρp τt υu ιi κk χx ϲc ϳj"  # Greek small
    " ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC"  # Greek capital
    " ɑa ɡg ɩi ʏY ꞵb"  # Latin letters of phonetic alphabets
).split()

_INVISIBLE = [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF]
_JOINERS = {0x200C, 0x200D, *range(0xFE00, 0xFE10)}


def _same_look(cp: int) -> str | None:
    """The ordinary spelling of a compatibility character that looks like it, else None."""
    ch = chr(cp)
    tag, _, rest = unicodedata.decomposition(ch).partition("> ")
    kind = unicodedata.category(ch)
    if kind == "Zs":
        return None if ch == " " else " "
    if cp in (0x2010, 0x2011, 0xFE63):
        return "-"
    if not tag.startswith("<"):
        return None
    plain = unicodedata.normalize("NFKC", ch)
    if tag in ("<wide", "<narrow", "<font"):
        return plain
    # ligatures, digraphs and Roman numerals; signs such as the numero sign are no letters
    if tag == "<compat" and kind in ("Ll", "Lu", "Lt", "Nl") and plain.isascii() and plain.isalpha():
        return plain
    return None


@functools.cache
def mapping_rows() -> list[tuple[str, str, int, bool]]:
    """(character, replacement in decomposed form, class of a mark, joiner?) of every code point that is not simply itself."""
    rows = []
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:
            continue  # Hangul syllables are composed already; surrogates are no characters
        ch = chr(cp)
        if cp in _INVISIBLE:
            rows.append((ch, "", 0, cp in _JOINERS))
            continue
        plain = _same_look(cp)
        full = unicodedata.normalize("NFD", ch if plain is None else plain)
        ccc = unicodedata.combining(ch)
        if full != ch or ccc:
            rows.append((ch, full, ccc, False))
    return rows


@functools.cache
def relevant_characters() -> str:
    """All characters that may make a text differ from its consistent form."""
    alone = [ch for ch, full, ccc, _ in mapping_rows() if ccc or unicodedata.normalize("NFC", full) != ch]
    return "".join(dict.fromkeys([x[0] for x in LOOK_ALIKES] + alone))


def _letters(script: str) -> str:
    return rf"^\p{{Is{script}}}"


def unify_segments(segments: DataFrame) -> DataFrame:
    """``segment, alone, unified`` for each distinct ``segment`` (a text without plain white space) of the input.

    ``alone`` names the scripts that occur in the whole text with letters no plain letter looks like (``C`` Cyrillic,
    ``G`` Greek): there a word wholly of look-alikes is a real word. Words with a Latin letter and otherwise only
    look-alikes of another script are mapped to plain letters.
    """
    spark = segments.sparkSession
    table = F.broadcast(spark.createDataFrame(mapping_rows(), "ch string, full string, ccc int, joiner boolean"))
    alike = F.broadcast(spark.createDataFrame([(x[0], x[1:]) for x in LOOK_ALIKES], "cluster string, plain string"))
    key = ["segment", "alone"]
    # spread before the explode, as a short list of segments would else be worked on in one place
    segments = segments.select(*key).repartition(partitions(spark), *key)
    points = segments.select(*key, F.posexplode(F.expr("regexp_extract_all(segment, '(?s).', 0)")).alias("pos", "ch")).join(table, "ch", "left")
    by_pos = Window.partitionBy(*key).orderBy("pos")
    before = F.lag("ch").over(by_pos)
    # joiners stay after pictographs and in scripts that are written with them
    keeps = F.col("joiner") & F.coalesce(before.rlike(r"^[\x{2190}-\x{2BFF}\x{3030}-\x{303D}\x{1F000}-\x{1FAFF}\x{FE0F}\x{0600}-\x{08FF}\x{0900}-\x{0DFF}#*0-9]$"), F.lit(False))
    digits_only_before_vs = ~(before.rlike(r"^[#*0-9]$") & (F.col("ch") != F.lit("\ufe0f")))
    points = points.select(*key, "pos", F.coalesce("ccc", F.lit(0)).alias("ccc"), F.when(keeps & F.coalesce(digits_only_before_vs, F.lit(True)), F.col("ch")).otherwise(F.coalesce("full", "ch")).alias("full"), "ch")
    # a replacement may hold several code points; each takes its own place and class
    points = points.where("full <> ''").select(*key, (F.col("pos") * 32).alias("at"), F.posexplode(F.expr("regexp_extract_all(full, '(?s).', 0)")).alias("i", "one"))
    classes = table.select(F.col("ch").alias("one"), F.col("ccc").alias("c"))
    points = points.join(classes, "one", "left").select(*key, (F.col("at") + F.col("i")).alias("at"), F.col("one").alias("ch"), F.coalesce("c", F.lit(0)).alias("ccc"))
    by_at = Window.partitionBy(*key).orderBy("at")
    points = points.withColumn("n", F.sum(F.when(F.col("ccc") == 0, 1).otherwise(0)).over(by_at))
    clusters = points.groupBy(*key, "n").agg(F.array_sort(F.collect_list(F.struct("ccc", "at", "ch"))).alias("c"))
    clusters = clusters.select(*key, "n", _recompose(F.array_join(F.col("c.ch"), "")).alias("cluster"))
    clusters = clusters.join(alike, "cluster", "left")
    by_n = Window.partitionBy(*key).orderBy("n")
    is_word = F.col("cluster").rlike(r"^[\p{L}\p{M}]")
    lag_word = F.coalesce(F.lag(is_word).over(by_n), F.lit(False))
    clusters = clusters.withColumn("starts", F.when(is_word != lag_word, 1).otherwise(0)).withColumn("word", F.sum("starts").over(by_n))
    by_word = Window.partitionBy(*key, "word")
    lookalike, latin = F.col("plain").isNotNull(), F.col("cluster").rlike(_letters("Latin"))
    cyr, gre = F.col("cluster").rlike(_letters("Cyrillic")), F.col("cluster").rlike(_letters("Greek"))
    other = is_word & ~lookalike & ~latin
    clusters = (
        clusters.withColumn("latin", F.max(latin & ~lookalike).over(by_word))
        .withColumn("other", F.max(other & (cyr | gre)).over(by_word))
        .withColumn("letters", F.count(F.lit(1)).over(by_word))
        .withColumn("real", F.max((cyr & F.col("alone").contains("C")) | (gre & F.col("alone").contains("G"))).over(by_word))
    )
    mapped = lookalike & ~F.col("other") & (F.col("latin") | (((F.col("letters") > 1) | cyr) & ~F.col("real")))
    clusters = clusters.select(*key, "n", F.when(mapped, F.col("plain")).otherwise(F.col("cluster")).alias("cluster"))
    return clusters.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list(F.struct("n", "cluster"))).getField("cluster"), "").alias("unified"))


@F.pandas_udf(T.StringType())
def _recompose(s: pd.Series) -> pd.Series:
    import unicodedata

    return s.map(lambda x: x if x.isascii() else unicodedata.normalize("NFC", x))


_SPLIT = r"[^ \t\r\n]+|[ \t\r\n]+"


def _alone(text: Column) -> Column:
    cyr, gre = ("".join(x[0] for x in LOOK_ALIKES if name in unicodedata.name(x[0])) for name in ("CYRILLIC", "GREEK"))
    return F.concat(
        F.when(text.rlike(rf"[\p{{IsCyrillic}}&&[^{cyr}]]"), "C").otherwise(""),
        F.when(text.rlike(rf"[\p{{IsGreek}}&&\p{{L}}&&[^{gre}]]"), "G").otherwise(""),
    )


def needs_work(text: Column) -> Column:
    """True for a text with any character of the mapping tables; all others are consistent already."""
    return F.coalesce(text.rlike(r"[^\x00-\x7F]") & (F.translate(text, relevant_characters(), "") != text), F.lit(False))


class Dictionary:
    """The consistent form of texts: ``counts`` (text, n) of the texts that need work, and ``forms`` (text, unified) of those that differ from it.

    Null and empty texts and texts without mapped characters have no row. Only segments with such a character are
    exploded, and each distinct one once, so that a word repeated in a third of all texts is one row.
    """

    def __init__(self, texts: DataFrame) -> None:
        self.counts = park(texts.where(needs_work(F.col("text"))).groupBy("text").agg(F.count(F.lit(1)).alias("n")), "glyphs-texts")
        parts = F.expr(f"regexp_extract_all(text, '{_SPLIT}', 0)".replace("\\", "\\\\"))
        todo = self.counts.select("text", _alone(F.col("text")).alias("alone"), parts.alias("parts"))
        words = todo.select("text", "alone", F.explode(F.array_distinct(F.filter("parts", needs_work))).alias("segment"))
        segments = park(words.groupBy("segment", "alone").agg(F.count(F.lit(1)).alias("n")), "glyphs-segments")
        unified = unify_segments(segments).where("segment <> unified")
        got = join_by_value(words, unified, ["segment", "alone"], segments, F.col("text"))
        got = got.groupBy("text").agg(F.map_from_entries(F.collect_list(F.struct("segment", "unified"))).alias("m"))
        self.forms = got.select("text", F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at("m", p), p)), "").alias("unified"))

    def join(self, rows: DataFrame, spread: Column, how: str) -> DataFrame:
        """``rows`` with a column ``text`` joined with ``forms``; a text of very many rows is spread by ``spread``."""
        return join_by_value(rows, self.forms, ["text"], self.counts, spread, how)


def unify_fields(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key, field_name, text, unified`` of every field whose consistent form differs from its text.

    A field with equal text and form gives no row, as does a null field. Repeated keys each give their rows; columns
    beyond ``key`` and ``fields`` are ignored, whatever their names.
    """
    pairs = ", ".join(f"'{f}', cast(`{f}` as string)" for f in fields)
    long = rows.select(F.col(key).alias("key"), *fields).selectExpr("key", f"stack({len(fields)}, {pairs}) as (field_name, text)").where(needs_work(F.col("text")))
    return Dictionary(long).join(long, F.col("key"), "inner").select(F.col("key").alias(key), "field_name", "text", "unified")


def with_unified(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``rows`` with each of ``fields`` in its consistent form; only texts that need work take part in a join."""
    out = rows
    for f in fields:
        need = needs_work(F.col(f))
        hard = out.where(need).select(F.struct(*[F.col(c) for c in out.columns]).alias("row"), F.col(f).alias("text"))
        got = Dictionary(hard).join(hard, F.col("row"), "left")
        got = got.select(*[F.coalesce("unified", f"row.{c}").alias(c) if c == f else F.col("row").getField(c).alias(c) for c in out.columns])
        out = out.where(~need).unionByName(got)
    return out


def found(records: DataFrame) -> DataFrame:
    """p3_found: fields whose text differs from its consistent form."""
    return unify_fields(records, "record_id", ["title", "summary"]).select("record_id", "field_name")
