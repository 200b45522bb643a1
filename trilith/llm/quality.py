r"""Quality rules with cross-document line frequency (DataFrame functions only).

Words are runs without space, tab, line feed, vertical tab, form feed and
carriage return.  Base rules need one text alone; the method then hashes
normalised lines (white space as one space, lower case), counts for each
host how many distinct documents hold a line, removes the lines above the
limit and rejects documents of which too little is left.

A line is removed on a host if more than ``max(min_docs, share * documents of
the host)`` distinct documents hold it.  With ``share=0``, as the registered
query has it, the limit does not loosen on large hosts; the default spares
lines of less than a tenth of a host.  Documents of equal text are one document here, so the copies of a text do not condemn its lines.  A document
is depleted if fewer than ``MIN_WORDS`` words or less than ``MIN_LEFT`` of its
words are left.

Defined results: null text is the empty text, which fails the base rules; a
null host is a host of its own; repeated rows get equal results; rows without
id are judged like others; extra columns are ignored; an empty table gives an
empty result.  Window and line hashes have 64 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
MIN_DOCS, SHARE, MIN_LEFT = 10, 0.1, 0.3


def _words(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def _pairs(a: Column, n: Column, f) -> Column:
    """f over neighbours of an array of ``n`` (at least one) elements."""
    return F.zip_with(F.slice(a, 1, n - 1), F.slice(a, 2, n - 1), f)


def _with_repeats(d: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: the words covered by windows whose hash
    occurs twice or more, found as equal neighbours after sorting by hash,
    then as the union of the spans.  Each step is a column of its own, so
    that no lambda evaluates an array anew for every element."""
    n = F.size("_w")
    d = d.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    shifted = F.arrays_zip(*[F.slice("_h", i + 1, n - (WINDOW - 1)).alias(f"w{i}") for i in range(WINDOW)])
    d = d.withColumn("_windows", F.when(n >= WINDOW, F.transform(shifted, lambda x: F.xxhash64(x))))
    d = d.withColumn("_twice", F.coalesce(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.lit(False)))
    d = d.withColumn("_sorted", F.when(F.col("_twice"), F.sort_array(
        F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    equal = F.filter(_pairs(F.col("_sorted"), F.size("_sorted"), lambda a, b: F.when(
        a["h"] == b["h"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull())
    d = d.withColumn("_at", F.when(F.col("_twice"), F.sort_array(F.array_distinct(F.flatten(equal)))))
    covered = F.aggregate(_pairs(F.col("_at"), F.size("_at"), lambda a, b: F.least(F.lit(WINDOW), b - a)),
                          F.lit(WINDOW), lambda total, x: total + x)
    return d.withColumn("n_repeat_words", F.when(F.col("_twice"), covered).otherwise(0).cast("long"))


def _line(x: Column) -> Column:
    """The normalised line."""
    return F.lower(F.trim(F.regexp_replace(x, GAP, " ")))


def base_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """Per row: doc_id, base measures, and for the method the host, a key of
    the text and the hashed lines with their words."""
    d = docs.select("doc_id", F.col(host).alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("_w", _words(F.col("text"))).withColumn(
        "_l", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return _with_repeats(d).select(
        "doc_id", "host", F.xxhash64("text").alias("key"), F.length("text").alias("chars"),
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", GAP, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        F.transform("_l", lambda x: F.struct(F.xxhash64(_line(x)).alias("line"),
                                             F.size(_words(x)).cast("long").alias("words"))).alias("lines"))


def _removed(base: DataFrame, min_docs: int, share: float) -> DataFrame:
    """Per host and text (``_host``, ``_key``, ``_chars``) with lines above
    the limit: removed_words and the removed lines' hashes."""
    text = ["host", "key", "chars"]
    held = base.select(*text, F.inline("lines")).select(*text, "line").distinct()
    sizes = base.select(*text).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    often = (held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_docs)
             .join(sizes.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host")))
             .where(F.col("n") > share * F.col("docs")).select(F.col("host").alias("_host"),
                                                                F.col("line").alias("_line")))
    per_text = base.select(*text, "lines").dropDuplicates(text).select(*text, F.inline("lines"))
    return (per_text.join(often, F.col("host").eqNullSafe(F.col("_host")) & (F.col("line") == F.col("_line")))
            .groupBy(*text).agg(F.sum("words").alias("removed_words"), F.collect_set("line").alias("removed_lines"))
            .select(*[F.col(c).alias("_" + c) for c in text], "removed_words", "removed_lines"))


def _same() -> Column:
    return (F.col("host").eqNullSafe(F.col("_host")) & (F.col("key") == F.col("_key"))
            & (F.col("chars") == F.col("_chars")))


def clean_texts(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """doc_id, host, text without the removed lines: one row per input row."""
    removed = stored(_removed(stored(base_rules(docs, host), "quality"), min_docs, share), "removed")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.col(host).alias("host"), "text", F.xxhash64(text).alias("key"),
                       F.length(text).alias("chars")).join(removed, _same(), "left")
    left = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("removed_lines", F.xxhash64(_line(x))))
    return rows.select("doc_id", "host", F.when(F.col("removed_lines").isNull(), F.col("text")).otherwise(
        F.array_join(left, "\n")).alias("text"))


def quality(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE,
            min_left: float = MIN_LEFT) -> DataFrame:
    """doc_id, the base measures, base_failed, removed_words, kept: one row
    per input row."""
    base = stored(base_rules(docs, host), "quality")
    removed = _removed(base, min_docs, share).drop("removed_lines")
    rows = base.drop("lines").join(removed, _same(), "left").withColumn(
        "removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & ((left < MIN_WORDS) | (left < min_left * F.col("n_words")))
    return rows.withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "removed_words", (~F.col("base_failed") & ~depleted).alias("kept"))
