"""Statistical building blocks shared by the operators.

``select_ranks`` is an exact, distributed k-th-smallest selection.  It is used
for exact quantiles (medians, quartiles, IQR bounds, box plots) and for the
cut points of quota-exact splits.  It never gathers a group into one task:
every pass is a scan with a map-side partial aggregate over at most
``buckets`` cells per active segment; a pass fetches the smallest segments up
to ``FETCH_ROWS`` rows in all and narrows the others further.  With tie
columns a range of one value is fetched as its distinct ties with counts.

Each pass splits a value range [lo, hi] into ``buckets`` equal cells with the
monotone expression ``floor((x - lo) / (hi - lo) * buckets)``; the cell that
holds the wanted rank becomes the next range, bounded by the exact min and max
of the values inside it, so membership tests stay exact in floating point.
A value repeated on a third of all rows ends the descent at once (min = max).
"""

from __future__ import annotations

import bisect
import itertools
import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 4096
FETCH_ROWS = 20000  # all segments of a pass together
MAX_LEVELS = 40


def nan_to_null(c: Column) -> Column:
    """NaN becomes NULL; pandas treats both as missing, Spark does not."""
    return F.when(~F.isnan(c), c)


def without_nan(df: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` with NaN as NULL in those of ``cols`` that are float or double."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: nan_to_null(F.col(c)) for c in cols if kinds.get(c) in ("float", "double")})


CASE_SEGMENTS = 64
BROADCAST_SEGMENTS = 100_000


def _segment_expr(segments: list[tuple[int, object, float, float]]) -> Column:
    expr = None
    for sid, g, lo, hi in segments:
        cond = (F.col("_g") == F.lit(g)) & (F.col("_x") >= F.lit(lo)) & (F.col("_x") <= F.lit(hi))
        expr = F.when(cond, F.lit(sid)) if expr is None else expr.when(cond, F.lit(sid))
    return expr


def _with_segments(base: DataFrame, segments: list[tuple[int, object, float, float]]) -> DataFrame:
    """Rows of active segments with ``_s`` (segment id), ``_lo`` and ``_w``.

    Few segments: literal CASE expressions.  Many (many groups): a segment
    table joined on the group key with a range filter -- segments of one
    group are disjoint, so each row matches at most one; the table is
    broadcast only up to ``BROADCAST_SEGMENTS`` rows.
    """
    if len(segments) <= CASE_SEGMENTS:
        lo, w = F.lit(None).cast("double"), F.lit(None).cast("double")
        for sid, g, slo, shi in segments:
            lo = F.when(F.col("_s") == sid, F.lit(slo)).otherwise(lo)
            w = F.when(F.col("_s") == sid, F.lit(shi - slo)).otherwise(w)
        return (base.withColumn("_s", _segment_expr(segments)).where(F.col("_s").isNotNull())
                .withColumn("_lo", lo).withColumn("_w", w))
    gtype = base.schema["_g"].dataType
    seg = base.sparkSession.createDataFrame(
        [(sid, g, float(lo), float(hi)) for sid, g, lo, hi in segments],
        T.StructType([T.StructField("_s", T.IntegerType()), T.StructField("_sg", gtype),
                      T.StructField("_lo", T.DoubleType()), T.StructField("_hi", T.DoubleType())]))
    if len(segments) <= BROADCAST_SEGMENTS:
        seg = F.broadcast(seg)
    j = base.join(seg, (F.col("_g") == F.col("_sg")) & (F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi")))
    return j.withColumn("_w", F.col("_hi") - F.col("_lo")).drop("_sg", "_hi")


def select_ranks(df: DataFrame, group: Column | None, value: Column,
                 ranks: dict, tie_cols: list[Column] | None = None,
                 stats: dict | None = None) -> dict:
    """Exact values at 1-based ascending ranks per group.

    ``ranks`` maps a group value (``None`` when ``group`` is None) to a list of
    ranks.  Rows with a NULL value are ignored.  With ``tie_cols`` the final
    order is (value, *tie_cols) and the result holds tuples
    ``(value, *ties)``; otherwise plain values.  Returns
    ``{(group, rank): value}``.  ``stats`` may pass known
    ``{group: (n, min, max)}`` from an earlier pass.
    """
    tie_cols = tie_cols or []
    base = df.select((group if group is not None else F.lit(0)).alias("_g"),
                     value.cast("double").alias("_x"),
                     *[c.alias(f"_t{i}") for i, c in enumerate(tie_cols)]
                     ).where(F.col("_x").isNotNull())
    gkey = (lambda g: g) if group is not None else (lambda g: 0)

    # level 0: range and size of every group that has a target
    if stats is None:
        stats = group_ranges(base, F.col("_g"), F.col("_x"))
    result: dict = {}
    # active targets: (group_key_out, rank_out) -> (g, lo, hi, rank within range, n in range)
    active = {}
    for g, rs in ranks.items():
        st = stats.get(gkey(g))
        for r in rs:
            if st is None or r < 1 or r > st[0]:
                result[(g, r)] = None
            else:
                active[(g, r)] = (gkey(g), st[1], st[2], r, st[0])

    for _ in range(MAX_LEVELS):
        # resolve targets whose range is one value, or small enough to fetch
        fetch, room = {}, FETCH_ROWS
        for key, (g, lo, hi, r, n) in sorted(active.items(), key=lambda x: x[1][4]):
            if lo == hi and not tie_cols:
                result[key] = lo
                del active[key]
            elif (g, lo, hi) in fetch or lo == hi or n <= room:
                room -= 0 if (g, lo, hi) in fetch or lo == hi else n
                fetch.setdefault((g, lo, hi), []).append((key, r))
                del active[key]
        if fetch:
            segs = [(i, g, lo, hi) for i, (g, lo, hi) in enumerate(fetch)]
            rows = (_with_segments(base, segs)  # distinct values with their counts
                    .groupBy("_s", "_x", *[f"_t{i}" for i in range(len(tie_cols))]).count().collect())
            by_seg = defaultdict(list)
            for row in rows:
                by_seg[row[0]].append((tuple(row[1:-1]), row[-1]))
            for i, (g, lo, hi) in enumerate(fetch):
                vals = sorted(by_seg[i])
                upto = list(itertools.accumulate(n for _, n in vals))
                for key, r in fetch[(g, lo, hi)]:
                    v = vals[bisect.bisect_left(upto, r)][0]
                    result[key] = v if tie_cols else v[0]
        if not active:
            break
        # one refinement pass for all remaining segments
        seg_ids = {}
        for key, (g, lo, hi, r, n) in active.items():
            seg_ids.setdefault((g, lo, hi), len(seg_ids))
        segs = [(i, g, lo, hi) for (g, lo, hi), i in seg_ids.items()]
        bucket = F.least(F.floor((F.col("_x") - F.col("_lo")) / F.col("_w") * BUCKETS),
                         F.lit(BUCKETS - 1)).cast("int")
        cells = (_with_segments(base, segs)
                 .withColumn("_b", bucket)
                 .groupBy("_s", "_b")
                 .agg(F.count("*").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
                 .collect())
        per_seg = defaultdict(list)
        for c in cells:
            per_seg[c["_s"]].append((c["_b"], c["n"], c["lo"], c["hi"]))
        for key, (g, lo, hi, r, n) in list(active.items()):
            sid = seg_ids[(g, lo, hi)]
            seen = 0
            for b, cn, clo, chi in sorted(per_seg[sid]):
                if seen + cn >= r:
                    active[key] = (g, clo, chi, r - seen, cn)
                    break
                seen += cn
    if active:  # pragma: no cover - guarded by MAX_LEVELS
        raise RuntimeError("rank selection did not converge")
    return result


def group_ranges(df: DataFrame, group: Column, value: Column) -> dict:
    """``{group: (count, min, max)}`` of the non-null values, one pass."""
    return {r["_g"]: (r["n"], r["lo"], r["hi"]) for r in
            df.where(value.isNotNull())
              .groupBy(group.alias("_g"))
              .agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
              .collect()}


def quantile_positions(n: int, q: float) -> tuple[int, int, float]:
    """1-based ranks around the linear-interpolation position (n-1)*q."""
    h = (n - 1) * q
    lo = math.floor(h)
    return lo + 1, min(lo + 2, n), h - lo


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                    by: str | None = None) -> dict:
    """Linear-interpolated quantiles (pandas / numpy ``linear``, DuckDB
    ``quantile_cont``) for several columns and optional groups at once.

    All columns are stacked into (column, group, value) so each refinement
    pass scans the input once for every column.  Returns
    ``{(col, group): {q: value}}``; groups with no value get ``None``.
    """
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    grp = F.col(by).cast("string") if by else F.lit("")
    long = (df.select(grp.alias("_by"), F.expr(f"stack({len(cols)}, {pairs}) AS (_c, _v)"))
            .where(F.col("_by").isNotNull() & F.col("_v").isNotNull() & ~F.isnan("_v")))
    gcol = F.concat_ws("\u0001", F.col("_c"), F.col("_by"))
    ranges = group_ranges(long, gcol, F.col("_v"))
    wanted = defaultdict(set)
    plan = {}
    for g, (n, _, _) in ranges.items():
        for q in probs:
            a, b, frac = quantile_positions(n, q)
            wanted[g].update((a, b))
            plan[(g, q)] = (a, b, frac)
    vals = (select_ranks(long, gcol, F.col("_v"), {g: sorted(r) for g, r in wanted.items()},
                         stats=ranges) if wanted else {})
    out: dict = {}
    for (g, q), (a, b, frac) in plan.items():
        c, grp_v = g.split("\u0001", 1)
        lo, hi = vals[(g, a)], vals[(g, b)]
        out.setdefault((c, grp_v if by else None), {})[q] = lo + (hi - lo) * frac
    for c in cols:
        if not by and (c, None) not in out:
            out[(c, None)] = {q: None for q in probs}
    return out


def guarded_corr(a: Column, b: Column) -> Column:
    """Pearson correlation over rows where both values are present.

    ``corr`` divides by zero on a constant column, which raises under ANSI
    mode; here a zero variance gives NULL (pandas gives NaN).
    """
    both = a.isNotNull() & b.isNotNull()
    aa, bb = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(aa, bb), F.stddev_pop(aa) * F.stddev_pop(bb))


def sql_guarded_corr(a: str, b: str) -> str:
    """DuckDB twin of ``guarded_corr`` for oracle queries."""
    both = f"({a} IS NOT NULL AND {b} IS NOT NULL)"
    aa, bb = f"CASE WHEN {both} THEN {a} END", f"CASE WHEN {both} THEN {b} END"
    return (f"covar_pop({aa}, {bb}) / nullif(stddev_pop({aa}) * stddev_pop({bb}), 0)")


def log_factorial(n: Column) -> Column:
    """ln(n!) for n >= 0: exact sum for n < 20, Stirling series beyond
    (absolute error below 1e-13 there)."""
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))),
                        F.lit(0.0), lambda acc, i: acc + F.log(i.cast("double")))
    x = (n + 1).cast("double")  # ln Gamma(x)
    stirling = ((x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi)
                + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5))
                - 1 / (1680 * F.pow(x, 7)))
    return F.when(n < 20, F.when(n <= 1, F.lit(0.0)).otherwise(small)).otherwise(stirling)


def fround(c: Column, digits: int) -> Column:
    """Round half up on the binary value: floor(x * 10^d + 0.5) / 10^d.

    Spark's ``round`` rounds the shortest decimal text half-up (36.285 ->
    36.29 although the double is 36.28499...); this form rounds the value
    actually stored, and its SQL twin ``sql_fround`` gives the same bits.
    """
    p = float(10 ** digits)
    return F.floor(c * F.lit(p) + F.lit(0.5)) / F.lit(p)


def sql_fround(expr: str, digits: int) -> str:
    return f"(floor(({expr}) * {float(10 ** digits)!r} + 0.5) / {float(10 ** digits)!r})"


def exact_mean(c: Column, digits: int = 6) -> Column:
    """Order-independent mean: values fixed-point at 10^-digits (half up),
    summed as exact decimals, divided once.  The result does not depend on
    partitioning or summation order (a float sum does, which flips the last
    rounded digit when inputs have few decimals)."""
    p = float(10 ** digits)
    q = F.floor(c * F.lit(p) + F.lit(0.5)).cast("decimal(38,0)")
    return F.sum(q).cast("double") / F.count(c).cast("double") / F.lit(p)


def sql_exact_mean(expr: str, digits: int = 6) -> str:
    p = f"CAST({10 ** digits} AS DOUBLE)"
    return (f"(CAST(sum(CAST(floor(({expr}) * {p} + 0.5) AS DECIMAL(38,0))) AS DOUBLE) "
            f"/ CAST(count({expr}) AS DOUBLE) / {p})")
