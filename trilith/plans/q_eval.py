"""Registered queries: evaluation, selection and scoring (§2.10).

Classification metrics use ``labels`` (quality as truth, toxic as the
prediction); regression metrics compare line-item prices with quantity x
retail price; the run table that feeds leaderboards is itself computed from
the data (four predictors of ``quality`` scored per document language).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import CATEGORIES
from ..operators import evaluate as E
from ..operators.profile import histogram
from ..sources.items import item_view
from ..sources.tables import read_table
from .common import items_sql, union_sql
from .registry import register

LANGS = ["de", "en", "es", "fr"]


def labelled_docs(spark, sf_dir) -> DataFrame:
    lab = read_table(spark, sf_dir, "labels")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return lab.join(docs, "doc_id")


def _f1_sql(src: str, y: str, p: str, by: list[str]) -> str:
    """Macro-F1 per group from confusion counts."""
    g = ", ".join(by)
    gsel = (g + ", ") if by else ""
    return f"""
SELECT {gsel}round(avg(coalesce(2.0 * tp / nullif(t + pr, 0), 0.0)), 6) AS f1_macro FROM (
  SELECT {gsel}label, sum(tp) AS tp, sum(t) AS t, sum(pr) AS pr FROM (
    SELECT {gsel}CAST({y} AS VARCHAR) AS label, CASE WHEN {y} = {p} THEN n ELSE 0 END AS tp, n AS t, 0 AS pr FROM
      (SELECT {gsel}{y}, {p}, count(*) AS n FROM {src} GROUP BY ALL) c
    UNION ALL
    SELECT {gsel}CAST({p} AS VARCHAR), 0, 0, n FROM (SELECT {gsel}{y}, {p}, count(*) AS n FROM {src} GROUP BY ALL) c)
  WHERE label IS NOT NULL GROUP BY ALL)
{"GROUP BY " + g if by else ""}"""


LD = "(SELECT l.*, d.lang, d.n_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


@register("accuracy", f"SELECT lang, round(avg(CAST(quality = toxic AS DOUBLE)), 6) AS accuracy FROM {LD} GROUP BY 1")
def q_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.accuracy(labelled_docs(spark, sf_dir), "quality", "toxic", by=["lang"])


@register("f1_macro", _f1_sql(LD, "quality", "toxic", ["lang"]))
def q_f1_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.f1_macro(labelled_docs(spark, sf_dir), "quality", "toxic", by=["lang"])


@register("classification_report", """
WITH c AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2),
s AS (SELECT CAST(quality AS VARCHAR) AS label, CASE WHEN quality = toxic THEN n ELSE 0 END AS tp, n AS t, 0 AS pr FROM c
      UNION ALL SELECT CAST(toxic AS VARCHAR), 0, 0, n FROM c),
pc AS (SELECT label, sum(tp) AS tp, sum(t) AS t, sum(pr) AS pr FROM s GROUP BY 1),
r AS (SELECT label, coalesce(tp / nullif(CAST(pr AS DOUBLE), 0), 0.0) AS precision,
             coalesce(tp / nullif(CAST(t AS DOUBLE), 0), 0.0) AS recall,
             coalesce(2.0 * tp / nullif(CAST(t + pr AS DOUBLE), 0), 0.0) AS f1, t AS support, tp FROM pc)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM r
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / CAST(sum(support) AS DOUBLE), 6), CAST(sum(support) AS BIGINT) FROM r
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM r
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
                 round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM r""")
def q_classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.classification_report(read_table(spark, sf_dir, "labels"), "quality", "toxic")


@register("confusion_matrix", """
WITH l AS (SELECT DISTINCT CAST(quality AS VARCHAR) AS v FROM labels UNION SELECT DISTINCT CAST(toxic AS VARCHAR) FROM labels),
c AS (SELECT CAST(quality AS VARCHAR) AS t, CAST(toxic AS VARCHAR) AS p, count(*) AS n FROM labels GROUP BY 1, 2)
SELECT a.v AS true_label, b.v AS pred_label, CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM l a CROSS JOIN l b LEFT JOIN c ON c.t = a.v AND c.p = b.v""")
def q_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion_matrix(read_table(spark, sf_dir, "labels"), "quality", "toxic")


def priced_lines(spark, sf_dir) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    j = li.join(part, li.l_partkey == part.p_partkey)
    return j.select("l_returnflag", F.log(1 + F.col("l_extendedprice")).alias("y_log"),
                    F.log(1 + F.col("l_quantity") * F.col("p_retailprice")).alias("p_log"))


PL = ("(SELECT l.l_returnflag, ln(1 + l.l_extendedprice) AS y_log, ln(1 + l.l_quantity * p.p_retailprice) AS p_log "
      "FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey)")


@register("regression_metrics", f"""
SELECT x.l_returnflag, round(sqrt(avg(pow(exp(y_log) - 1 - (exp(p_log) - 1), 2))), 6) AS rmse,
       round(avg(abs(exp(y_log) - 1 - (exp(p_log) - 1))), 6) AS mae,
       round(1 - sum(pow(y_log - p_log, 2)) / sum(pow(y_log - m, 2)), 6) AS r2_log
FROM {PL} x JOIN (SELECT l_returnflag, avg(y_log) AS m FROM {PL} GROUP BY 1) g ON g.l_returnflag = x.l_returnflag
GROUP BY 1""")
def q_regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.regression_metrics(priced_lines(spark, sf_dir), "y_log", "p_log", by=["l_returnflag"])


@register("residuals", f"""
WITH r AS (SELECT y_log - p_log AS residual FROM {PL}),
b AS (SELECT min(residual) AS lo, max(residual) AS hi FROM r),
c AS (SELECT CAST(least(floor((residual - lo) / (hi - lo) * 50), 49) AS INTEGER) AS bin, count(*) AS count FROM r, b GROUP BY 1)
SELECT CAST(s.bin AS INTEGER) AS bin, round(lo + s.bin * ((hi - lo) / 50), 6) AS bin_lo,
       round(lo + (s.bin + 1) * ((hi - lo) / 50), 6) AS bin_hi, coalesce(c.count, 0) AS count
FROM range(50) s(bin) CROSS JOIN b LEFT JOIN c ON c.bin = s.bin""")
def q_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = E.residuals(priced_lines(spark, sf_dir), "y_log", "p_log")
    h = histogram(r, "residual", bins=50)
    return h.select("bin", F.round("bin_lo", 6).alias("bin_lo"), F.round("bin_hi", 6).alias("bin_hi"), "count")


# ------------------------------------------------------------ run tables

PREDICTORS = ["toxic", "not_toxic", "long_doc", "majority"]


def run_results(spark, sf_dir) -> DataFrame:
    """(predictor, lang, accuracy, f1_macro) for four predictors of quality."""
    ld = labelled_docs(spark, sf_dir)
    maj = (ld.groupBy("quality").count().orderBy(F.desc("count"), "quality").first()["quality"])
    preds = F.array(
        F.struct(F.lit("toxic").alias("predictor"), F.col("toxic").alias("p")),
        F.struct(F.lit("not_toxic").alias("predictor"), (1 - F.col("toxic")).alias("p")),
        F.struct(F.lit("long_doc").alias("predictor"), F.when(F.col("n_chars") > 2000, 1).otherwise(0).alias("p")),
        F.struct(F.lit("majority").alias("predictor"), F.lit(maj).cast("int").alias("p")))
    long = ld.select("lang", "quality", F.explode(preds).alias("s")).select("lang", "quality", "s.predictor", "s.p")
    acc = E.accuracy(long, "quality", "p", by=["predictor", "lang"])
    f1 = E.f1_macro(long, "quality", "p", by=["predictor", "lang"])
    return acc.join(f1, ["predictor", "lang"])


_RUN_LONG = f"""
WITH ld AS {LD},
maj AS (SELECT quality AS m FROM ld GROUP BY 1 ORDER BY count(*) DESC, quality LIMIT 1),
long AS (SELECT lang, quality, 'toxic' AS predictor, toxic AS p FROM ld
         UNION ALL SELECT lang, quality, 'not_toxic', 1 - toxic FROM ld
         UNION ALL SELECT lang, quality, 'long_doc', CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END FROM ld
         UNION ALL SELECT lang, quality, 'majority', m FROM ld, maj),
acc AS (SELECT predictor, lang, round(avg(CAST(quality = p AS DOUBLE)), 6) AS accuracy FROM long GROUP BY 1, 2),
f1 AS ({_f1_sql('long', 'quality', 'p', ['predictor', 'lang'])}),
res AS (SELECT acc.predictor, acc.lang, accuracy, f1_macro FROM acc JOIN f1 ON f1.predictor = acc.predictor AND f1.lang = acc.lang)"""


@register("leaderboard", _RUN_LONG + """
SELECT predictor, lang, accuracy, f1_macro,
       CAST(row_number() OVER (ORDER BY f1_macro DESC, predictor, lang) AS INTEGER) AS rank FROM res""")
def q_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.leaderboard(run_results(spark, sf_dir), "f1_macro", ["predictor", "lang"])


@register("best_run", _RUN_LONG + """
SELECT predictor, lang, accuracy, f1_macro FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY f1_macro DESC, predictor) AS r FROM res) WHERE r = 1""")
def q_best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.best_run(run_results(spark, sf_dir), "f1_macro", ["predictor"], by=["lang"])


@register("results_pivot", _RUN_LONG + "\nSELECT predictor, "
          + ", ".join(f"round(max(CASE WHEN lang = '{g}' THEN f1_macro END), 4) AS {g}" for g in LANGS)
          + " FROM res GROUP BY 1")
def q_results_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.results_pivot(run_results(spark, sf_dir), "predictor", "lang", "f1_macro", LANGS)


@register("score_delta", _RUN_LONG + """
SELECT r.predictor, r.lang, r.accuracy, r.f1_macro, round(r.f1_macro - b.f1_macro, 6) AS delta
FROM res r JOIN res b ON b.lang = r.lang AND b.predictor = 'majority'""")
def q_score_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.score_delta(run_results(spark, sf_dir), "predictor", "majority", "f1_macro", by=["lang"])


# ------------------------------------------------------------ requests and rules

REQ = {"poids": (0.0, False, 500.0, True), "volume": (0.0, False, 500.0, True),
       "conductivite": (0.0, True, 1.0, True), "opacite": (0.0, True, 1.0, True),
       "rigidite": (1.0, True, 10.0, True)}


def _validate_sql() -> str:
    checks = [f"CASE WHEN {c} IS NULL THEN '{c} missing' END" for c in REQ]
    for c, (lo, li, hi, hi_inc) in REQ.items():
        ok = f"{c} {'>=' if li else '>'} {lo} AND {c} {'<=' if hi_inc else '<'} {hi}"
        checks.append(f"CASE WHEN {c} IS NOT NULL AND NOT ({ok}) THEN '{c} out of range' END")
    arr = f"list_filter([{', '.join(checks)}], lambda r: r IS NOT NULL)"
    return items_sql(f"SELECT item_id, array_to_string({arr}, ';') AS reasons, len({arr}) = 0 AS is_valid FROM items")


@register("validate_requests", _validate_sql())
def q_validate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = item_view(spark, sf_dir).select("item_id", *REQ)
    return E.validate_requests(df, REQ).select("item_id", "reasons", "is_valid")


def _rule_sql_scores() -> list[str]:
    c, o, r = "conductivite", "opacite", "rigidite"
    return [f"{c} * 0.6 + {r} / 10 * 0.3 + 0.05",
            f"(1 - {c}) * 0.4 + (1 - {r} / 10) * 0.4 + 0.1",
            f"(1 - {c}) * 0.3 + {o} * 0.4 + 0.2",
            f"(1 - {o}) * 0.5 + (1 - {c}) * 0.3 + 0.1"]


def _rule_probs_cte() -> str:
    sc = [f"CAST({s} AS DOUBLE)" for s in _rule_sql_scores()]
    t = " + ".join(f"s{i}" for i in range(4))
    return f""",
rs AS (SELECT item_id, {', '.join(f'{s} AS s{i}' for i, s in enumerate(sc))} FROM items),
rp AS (SELECT item_id, {', '.join(f's{i} / ({t}) AS p{i}' for i in range(4))} FROM rs)"""


def _argmax_sql(n: int) -> str:
    parts = []
    for i in range(n):
        conds = [f"p{i} > p{j}" for j in range(i)] + [f"p{i} >= p{j}" for j in range(i + 1, n)]
        parts.append(f"WHEN {' AND '.join(conds)} THEN '{CATEGORIES[i]}'")
    nulls = " OR ".join(f"p{i} IS NULL" for i in range(n))
    return f"CASE WHEN {nulls} THEN NULL {' '.join(parts)} END"


@register("rule_score", items_sql(
    f"SELECT item_id, prediction, round(CASE prediction "
    + " ".join(f"WHEN '{k}' THEN p{i}" for i, k in enumerate(CATEGORIES))
    + f" END, 6) AS confidence FROM (SELECT *, {_argmax_sql(4)} AS prediction FROM rp)", _rule_probs_cte()))
def q_rule_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = item_view(spark, sf_dir).select("item_id", "conductivite", "opacite", "rigidite")
    return E.rule_score(df, "conductivite", "opacite", "rigidite").select("item_id", "prediction", "confidence")


@register("ranked_probabilities", items_sql(union_sql(
    [f"SELECT item_id, category, probability, CAST(row_number() OVER (PARTITION BY item_id ORDER BY raw DESC NULLS LAST, o) AS INTEGER) AS rank FROM ("
     + union_sql([f"SELECT item_id, '{k}' AS category, round(p{i}, 6) AS probability, p{i} AS raw, {i} AS o FROM rp"
                  for i, k in enumerate(CATEGORIES)]) + ")"]), _rule_probs_cte()))
def q_ranked_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = item_view(spark, sf_dir).select("item_id", "conductivite", "opacite", "rigidite")
    p = E.rule_probabilities(df, "conductivite", "opacite", "rigidite", "proba")
    return E.ranked_probabilities(p, "item_id", "proba")
