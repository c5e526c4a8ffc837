"""Queries that compare conditions, models and groups, and deal rows into folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import bytecode, features
from quern.operators import audit, evaluate, models, programs, relational, similarity, statistics
from quern.plans.evaluation import _SCORED, predicted, scored
from quern.plans.registry import query, table

_BY_LANG = """p AS (SELECT lang, score, CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) AS p, CAST(count(*) FILTER (WHERE y <> 1) AS DOUBLE) AS n FROM s GROUP BY lang, score),
c AS (SELECT lang, score, p, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY lang) AS pos FROM p WINDOW w AS (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
a AS (SELECT lang, sum(tp / (tp + fp) * p) / max(pos) AS ap FROM c GROUP BY lang),
r AS (SELECT lang, CASE WHEN count(*) FILTER (WHERE y = 1) = 0 THEN 0 ELSE count(*) FILTER (WHERE y = 1 AND score >= 0.5) / count(*) FILTER (WHERE y = 1) END AS recall, CASE WHEN count(*) FILTER (WHERE y <> 1) = 0 THEN 0 ELSE count(*) FILTER (WHERE y <> 1 AND score >= 0.5) / count(*) FILTER (WHERE y <> 1) END AS fpr FROM s GROUP BY lang),
g AS (SELECT r.lang, recall, fpr, ap FROM r JOIN a USING (lang)), b AS (SELECT recall AS r0, fpr AS f0, ap AS a0 FROM g WHERE lang = 'en')"""


@query(
    "condition_deltas",
    f"""WITH {_SCORED}, {_BY_LANG} SELECT lang, round(recall, 9) AS recall, round(fpr, 9) AS fpr, round(ap, 9) AS average_precision, round(recall - r0, 9) AS recall_delta, round(fpr - f0, 9) AS fpr_delta, round(ap - a0, 9) AS average_precision_delta FROM g, b""",
)
def condition_deltas(spark, sf_dir):
    """Rates and average precision of each language, and how they differ from English."""
    values = ["recall", "fpr", "average_precision"]
    grid = evaluate.condition_grid(predicted(spark, sf_dir), "lang")
    out = evaluate.condition_deltas(grid, "lang", "en", values)
    return out.select("lang", *[F.round(c, 9).alias(c) for c in out.columns if c != "lang"])


@query("rule_scores", "SELECT doc_id, CASE WHEN toxic > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS by_rule, CASE WHEN quality = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS by_label FROM labels")
def rule_scores(spark, sf_dir):
    """Scores of a rule on a count and of the label itself."""
    lab = table(spark, sf_dir, "labels")
    out = evaluate.rule_score(lab, "toxic").withColumnRenamed("score", "by_rule")
    return evaluate.oracle_score(out, "quality", 0).select("doc_id", "by_rule", F.col("score").alias("by_label"))


@query("class_projection", "SELECT doc_id, lang, CASE lang WHEN 'en' THEN 'germanic' WHEN 'de' THEN 'germanic' WHEN 'fr' THEN 'romance' WHEN 'es' THEN 'romance' END AS family, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 WHEN 'es' THEN 4 END AS rank FROM documents")
def class_projection(spark, sf_dir):
    """Columns looked up by language."""
    known = {"en": ("germanic", 1), "de": ("germanic", 2), "fr": ("romance", 3), "es": ("romance", 4)}
    return relational.projection(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", known, ["family", "rank"])


@query("finite_rows", "SELECT user_id, count(*) AS n FROM (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'nan'::DOUBLE WHEN user_id % 3 = 1 THEN 'inf'::DOUBLE ELSE value END AS v FROM events) WHERE v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v) GROUP BY 1")
def finite_rows(spark, sf_dir):
    v = F.when(F.col("user_id") % 3 == 0, float("nan")).when(F.col("user_id") % 3 == 1, float("inf")).otherwise(F.col("value"))
    return relational.finite(table(spark, sf_dir, "events").select("user_id", v.alias("v")), "v").groupBy("user_id").agg(F.count("*").alias("n"))


_RANKED = """v AS (SELECT n_chars AS v, count(*) AS c FROM documents GROUP BY 1), k AS (SELECT v, c, sum(c) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) - c + (c + 1) / 2 AS rank FROM v),
    t AS (SELECT sum(c * c * c - c) AS ties, sum(c) AS n FROM k), g AS (SELECT lang AS g, avg(rank) AS r, count(*) AS m FROM documents JOIN k ON n_chars = v GROUP BY 1)"""


@query(
    "dunn_pairs",
    f"""WITH {_RANKED} SELECT a.g AS a, b.g AS b, round((a.r - b.r) / sqrt((n * (n + 1) / 12 - ties / (12 * (n - 1))) * (1 / a.m + 1 / b.m)), 6) AS z FROM g a JOIN g b ON a.g < b.g, t""",
)
def dunn_pairs(spark, sf_dir):
    """Pairs of languages compared by the ranks of their lengths."""
    return statistics.dunn(table(spark, sf_dir, "documents").where("lang is not null"), "n_chars", "lang").select("a", "b", F.round("z", 6).alias("z"))


@query(
    "group_kfold_assign",
    """WITH RECURSIVE g AS (SELECT source, n, row_number() OVER (ORDER BY n DESC, source) AS k FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)),
    r(k, source, fold, loads) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS INTEGER), CAST([0, 0, 0, 0, 0] AS BIGINT[]) UNION ALL
    SELECT g.k, g.source, CAST(list_position(loads, list_min(loads)) - 1 AS INTEGER), list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + n ELSE x END) FROM r JOIN g ON g.k = r.k + 1)
    SELECT source, fold FROM r WHERE k > 0""",
)
def group_kfold_assign(spark, sf_dir):
    """Folds of sources, balanced by rows."""
    return evaluate.group_folds(table(spark, sf_dir, "documents"), "source")


@query(
    "even_sample",
    """WITH k AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT doc_id, lang, n_chars FROM k WHERE n <= 10 OR k = 0 OR floor(k * 10 / n) <> floor((k - 1) * 10 / n)""",
)
def even_sample(spark, sf_dir):
    """Ten documents of each language at even distances by length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return relational.evenly_spaced(docs, ["lang"], ["n_chars", "doc_id"], 10)


@query(
    "leakage_counts",
    """WITH a AS (SELECT source, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT source, sha256(text) AS h FROM documents WHERE doc_id % 5 = 0)
    SELECT 'source' AS key, count(*) AS shared FROM (SELECT DISTINCT source FROM a INTERSECT SELECT DISTINCT source FROM b) UNION ALL SELECT 'h', count(*) FROM (SELECT DISTINCT h FROM a INTERSECT SELECT DISTINCT h FROM b)""",
)
def leakage_counts(spark, sf_dir):
    """Sources and texts that training and test rows share."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", bytecode.code_hash(F.col("text")).alias("h"))
    return programs.leakage(d.where("doc_id % 5 != 0"), d.where("doc_id % 5 = 0"), ["source", "h"])


@query("singleton_rates", "WITH g AS (SELECT lang, source, avg(quality) AS m, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang, source) SELECT lang, round(coalesce(avg(m) FILTER (WHERE n = 1), -1), 9) AS singletons FROM g GROUP BY lang")
def singleton_rates(spark, sf_dir):
    """Quality rate of families with one member."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    return relational.macro_mean(j, "source", "quality", ("lang",)).select("lang", F.round(F.coalesce("singletons", F.lit(-1.0)), 9).alias("singletons"))


@query("session_windows", """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
    SELECT user_id, min(ts) AS "start", count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf_dir):
    """Sessions of users, which end after half an hour without an event."""
    from quern.streaming.windows import sessions

    return sessions(table(spark, sf_dir, "events")).select("user_id", "start", "n")


@query(
    "weighted_rates",
    f"""WITH {_SCORED}, w AS (SELECT lang, y, score >= 0.5 AS p, (1 + doc_id % 3)::DOUBLE AS w FROM s), c AS (SELECT lang, coalesce(sum(w) FILTER (WHERE y = 1 AND p), 0) AS tp, coalesce(sum(w) FILTER (WHERE y <> 1 AND p), 0) AS fp, coalesce(sum(w) FILTER (WHERE y = 1 AND NOT p), 0) AS fn, coalesce(sum(w) FILTER (WHERE y <> 1 AND NOT p), 0) AS tn FROM w GROUP BY lang)
    SELECT lang, tp, fp, fn, tn, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 9) AS fpr FROM c""",
)
def weighted_rates(spark, sf_dir):
    """Rates of each language in which rows have weights."""
    p = predicted(spark, sf_dir).withColumn("w", 1 + F.col("doc_id") % 3)
    c = evaluate.confusion(p, by=("lang",), weight="w")
    return c.select("lang", "tp", "fp", "fn", "tn", F.round("recall", 9).alias("recall"), F.round("fpr", 9).alias("fpr"))


@query("family_structure", "WITH g AS (SELECT lang, sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1, 2) SELECT lang, CAST(sum(n) AS BIGINT) AS rows, count(*) AS families, count(*) FILTER (WHERE n = 1) AS singletons, max(n) AS largest FROM g GROUP BY lang")
def family_structure(spark, sf_dir):
    """Families of equal texts in each language."""
    d = table(spark, sf_dir, "documents").select("lang", bytecode.code_hash(F.col("text")).alias("h"))
    return audit.family_block(d, "h", "lang")


@query("novelty_classes", "SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN 'exact_overlap' WHEN s >= 0.85 THEN 'near_085' WHEN s >= 0.80 THEN 'near_080' ELSE 'novel' END AS class FROM (SELECT vec_id, (vec_id % 50) / 50 AS s FROM embeddings)")
def novelty_classes(spark, sf_dir):
    """The cascade from exact overlap to novelty."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", similarity.novelty(F.col("vec_id") % 11 == 0, (F.col("vec_id") % 50) / 50).alias("class"))


@query("logits", f"WITH {_SCORED}, l AS (SELECT doc_id, greatest(least(score, 1 - 1e-6), 1e-6) AS q FROM s) SELECT doc_id, round(ln(q / (1 - q)), 6) AS logit, round(1 / (1 + exp(-greatest(least(50 * ln(q / (1 - q)), 40), -40))), 9) AS steep FROM l")
def logits(spark, sf_dir):
    """Clipped logits of scores, and the clipped sigmoid of fifty times as much."""
    x = evaluate.logit(F.col("score"))
    return scored(spark, sf_dir).select("doc_id", F.round(x, 6).alias("logit"), F.round(evaluate.sigmoid(50 * x), 9).alias("steep"))


@query("temperature_fit")
def temperature_fit(spark, sf_dir):
    """The temperature of least log loss for the scores."""
    return spark.createDataFrame([(models.temperature(scored(spark, sf_dir)),)], "temperature double")


@query("rotated_roles", "SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'test' WHEN 2 THEN 'validation' ELSE 'train' END AS role FROM documents")
def rotated_roles(spark, sf_dir):
    """Training, validation and test rows by fold in the second turn."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 5).alias("fold"))
    return evaluate.roles(d, 1).select("doc_id", "role")


@query("dual_views", f"WITH {_SCORED} SELECT doc_id, score AS a, round(score * score, 9) AS b, round(score - score * score, 9) AS difference FROM s")
def dual_views(spark, sf_dir):
    """A vector, a restricted one and their difference in one."""
    v = features.dual_view(F.array("score"), F.array(F.col("score") * F.col("score")))
    return scored(spark, sf_dir).select("doc_id", v.alias("v")).select("doc_id", F.col("v")[0].alias("a"), F.round(F.col("v")[1], 9).alias("b"), F.round(F.col("v")[2], 9).alias("difference"))


def compared(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("score_b", (F.col("doc_id") % 89) / F.lit(89.0))
    return s.select("doc_id", "source", "lang", "y", F.col("score").alias("score_a"), "score_b", (F.col("score") >= 0.5).cast("int").alias("pred_a"), (F.col("score_b") >= 0.5).cast("int").alias("pred_b"))


@query("row_bootstrap")
def row_bootstrap(spark, sf_dir):
    """Recall and false positive rate of two models from independent rows drawn again."""
    return statistics.paired_bootstrap(compared(spark, sf_dir), "doc_id", reps=1000)


@query("family_paired_bootstrap")
def family_paired_bootstrap(spark, sf_dir):
    """The same from whole sources."""
    return statistics.paired_bootstrap(compared(spark, sf_dir), "source", reps=2000)


@query("stratified_precision_bootstrap")
def stratified_precision_bootstrap(spark, sf_dir):
    """Average precision of two models from whole sources drawn again within each language."""
    return statistics.precision_bootstrap(compared(spark, sf_dir), "source", reps=400, strata="lang")


@query("shapiro_wilk_groups")
def shapiro_wilk_groups(spark, sf_dir):
    """Whether the logarithm of the documents' lengths is normal in each language."""
    d = table(spark, sf_dir, "documents").select("lang", F.log1p("n_chars").alias("x"))
    return statistics.shapiro_wilk(d, "x", "lang")
