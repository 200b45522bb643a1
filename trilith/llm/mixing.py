"""Mixing sources to target weights by iterative proportional fitting
(DataFrame functions only).

Documents fall into cells of source, language and topic; a cell's tokens are
its words.  Raking multiplies the cells' token weights so that their sums
meet the targets of each source, then of each language, then of each topic,
until all three hold to ``TOLERANCE``.  Targets that contradict each other or
the empty cells have no exact solution: sweeps then end when Targets that contradict each other or
the empty cells have no exact solution: sweeps then end when the greatest miss
falls by less than a thousandth (or after ``ROUNDS``), and the last is taken.

The sample's expected tokens are ``RATE`` of all tokens.  A cell's raked share
of them may exceed its tokens: such a cell is kept whole and the others are
raked again, in sweeps that never raise a cell above its tokens, so they make
up for what it lacks in its source, language and topic.  They end when a
sweep changes no probability by more than ``TOLERANCE`` (or after ``SWEEPS``).  A document is sampled with probability expected tokens / tokens
of its cell.  A rare cell scales no other cell down, and a target that all
tokens of its source, language or topic cannot meet is missed by what they
lack.  With ``rate=None`` the greatest weight per token has probability 1 and
all cells are raked proportions, but one stray document may then set the
scale.  The decision compares the probability with a hash of the id: it is repeatable and
does not depend on partitioning.

Default targets temper the observed shares: share^``ALPHA``, normalised.
Given targets list (value, share); values without one get none.

Topics are told by the first rule that a text meets, else ``prose``.

Defined results: a null source or language is a value of its own; null text
is the empty text; documents without tokens belong to a cell and share its
probability, 0 if the cell has no tokens at all; rows that repeat id and text
share one decision, a null id is hashed with its text alone; extra columns
are kept where the documents are sampled; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, unit_hash
from .quality import GAP

ALPHA, TOLERANCE, ROUNDS, STALLED = 0.85, 1e-9, 100, 0.999
SWEEPS = 30  # at most, below full cells
RATE = 0.5
DIMENSIONS = ("source", "lang", "topic")
NONE = "(none)"
#: Topic rules in order: name and pattern.
TOPICS = (("legal", r"(?i)licen[cs]ed under|all rights reserved|copyright"),
          ("contact", r"[A-Za-z0-9._-]@[A-Za-z0-9-]+\.[a-z]{2,}"),
          ("table", r" \| [^|\n]* \| "),
          ("noise", r"[#*$%&]{3}|!!"),
          ("link", r"https?://|www\."),
          ("code", r"[;{}]\n|(^|\n) *(def|class|import|function) "),
          ("list", r"(^|\n)[ \t]*([-*]|[0-9]+[.)]) "),
          ("figures", r"[0-9]{3}[^0-9\n]+[0-9]{3}"))


def topic(text: Column) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def _words(text: Column) -> Column:
    """Number of words."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, GAP)))


def with_cells(docs: DataFrame, seed: str) -> DataFrame:
    """Each row of ``docs`` as ``_row``, its cell, tokens and uniform number."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.struct("*").alias("_row"), F.coalesce("source", F.lit(NONE)).alias("source"),
        F.coalesce("lang", F.lit(NONE)).alias("lang"), topic(text).alias("topic"),
        _words(text).cast("double").alias("_tokens"),
        unit_hash(F.col("doc_id"), F.md5(text), seed=seed).alias("_u"))


def tempered(cells: DataFrame, dim: str, alpha: float) -> DataFrame:
    sums = cells.groupBy(dim).agg(F.pow(F.sum("tokens"), F.lit(alpha)).alias("t")).where("t > 0")
    whole = sums.agg(F.sum("t")).first()[0] or 1.0
    return sums.select(dim, (F.col("t") / F.lit(whole)).alias("share"))


def _raked(cells: DataFrame, dim: str) -> DataFrame:
    sums = cells.groupBy(dim).agg(F.sum("weight").alias("_sum"))
    scaled = F.when(F.col("_sum") > 0, F.col("weight") * F.col(f"t_{dim}") / F.col("_sum")).otherwise(0.0)
    return cells.join(sums, dim).withColumn("weight", scaled).drop("_sum")


def _gap(cells: DataFrame) -> float:
    """The greatest miss of any target."""
    misses = [cells.groupBy(d).agg(F.abs(F.sum("weight") - F.max(f"t_{d}")).alias("miss")).agg(
        F.max("miss").alias("miss")) for d in DIMENSIONS]
    return misses[0].union(misses[1]).union(misses[2]).agg(F.max("miss")).first()[0] or 0.0


def rake(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with raked ``weight``."""
    for dim in DIMENSIONS:
        cells = cells.join(targets[dim].select(dim, F.col("share").alias(f"t_{dim}")), dim, "left").fillna(
            0.0, [f"t_{dim}"])
    cells = stored(cells.withColumn("weight", F.col("tokens")), "cells")
    last = float("inf")
    for _ in range(ROUNDS):
        for dim in DIMENSIONS:
            cells = stored(_raked(cells, dim), "cells")
        gap = _gap(cells)
        if gap <= TOLERANCE or gap >= STALLED * last:
            break
        last = gap
    return cells


def expected_tokens(cells: DataFrame, rate: float) -> DataFrame:
    """Raked ``cells`` with ``expected`` tokens, ``rate`` of all, no cell above
    its own; where that cuts a cell, the others are raked again."""
    budget = F.lit(rate * (cells.agg(F.sum("tokens")).first()[0] or 0.0))
    cells = cells.withColumn("_share", F.col("weight"))
    cells = stored(cells.withColumn("expected", F.least("tokens", budget * F.col("weight"))), "cells")
    if not cells.where(F.col("expected") < budget * F.col("weight")).head(1):
        return cells.drop("_share")
    for _ in range(SWEEPS):
        swept = cells.withColumn("_before", F.col("expected"))
        for dim in DIMENSIONS:
            swept = _raked(swept.withColumn("weight", F.col("expected")), dim)
            swept = stored(swept.withColumn("expected", F.least("tokens", budget * F.col("weight"))), "cells")
        moved = swept.where(F.abs(F.col("expected") - F.col("_before")) > TOLERANCE * F.col("tokens")).head(1)
        cells = swept.drop("_before")
        if not moved:
            break
    return cells.withColumn("weight", F.col("_share")).drop("_share")


def calibrated(marked: DataFrame, targets: dict[str, DataFrame] | None = None, alpha: float = ALPHA,
               rate: float | None = RATE) -> DataFrame:
    """``marked`` (of ``with_cells``) with weight (raked share of the cell),
    probability and sampled."""
    cells = stored(marked.groupBy(*DIMENSIONS).agg(F.sum("_tokens").alias("tokens")), "cells")
    targets = {d: (targets or {}).get(d) or tempered(cells, d, alpha) for d in DIMENSIONS}
    cells = rake(cells, targets)
    if rate is None:
        each = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
        probability = each / F.lit(cells.agg(F.max(each)).first()[0] or 1.0)
    else:
        cells = expected_tokens(cells, rate)
        probability = F.when(F.col("tokens") > 0, F.col("expected") / F.col("tokens")).otherwise(0.0)
    rates = cells.select(*DIMENSIONS, "weight", probability.alias("probability"))
    return marked.join(rates, [*DIMENSIONS]).withColumn("sampled", F.col("_u") < F.col("probability"))


def mix_report(docs: DataFrame, seed: str = "mix", **how) -> DataFrame:
    """One row per document with its cell, probability and decision; texts
    are read once."""
    marked = with_cells(docs.select("doc_id", "source", "lang", "text"), seed).withColumn("doc_id", F.col("_row.doc_id"))
    return calibrated(stored(marked.drop("_row"), "mix"), **how).select(
        "doc_id", *DIMENSIONS, F.col("_tokens").cast("long").alias("n_tokens"),
        F.round("probability", 6).alias("probability"), "sampled", "weight")


def sample_documents(docs: DataFrame, seed: str = "mix", **how) -> DataFrame:
    """The sampled rows of ``docs`` with their own columns, whatever their names."""
    return calibrated(with_cells(docs, seed), **how).where("sampled").select("_row.*")
