"""Queries that evaluate scored rows. The score is derived from the table, so SQL can repeat it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import evaluate, relational, statistics
from quern.plans.materialize import materialize
from quern.plans.registry import query, table

_SCORED = """s AS (SELECT doc_id, quality AS y, lang, source, (n_chars % 97) / 97.0 AS score FROM labels JOIN documents USING (doc_id))"""


def scored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", ((F.col("n_chars") % 97) / F.lit(97.0)).alias("score"))
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")).join(docs, "doc_id")


def predicted(spark, sf_dir):
    return scored(spark, sf_dir).withColumn("pred", (F.col("score") >= 0.5).cast("int"))


_CONF = """c AS (SELECT {by} count(*) FILTER (WHERE y = 1 AND score >= 0.5) AS tp, count(*) FILTER (WHERE y <> 1 AND score >= 0.5) AS fp, count(*) FILTER (WHERE y = 1 AND score < 0.5) AS fn, count(*) FILTER (WHERE y <> 1 AND score < 0.5) AS tn FROM s {group})"""
_CURVE = """p AS (SELECT score, CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) AS p, CAST(count(*) FILTER (WHERE y <> 1) AS DOUBLE) AS n FROM s GROUP BY score),
c AS (SELECT score, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM p WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


@query(
    "confusion_metrics",
    f"""WITH {_SCORED}, {_CONF.format(by='lang,', group='GROUP BY lang')},
    m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS f FROM c)
    SELECT lang, tp, fp, fn, tn, round(p, 9) AS "precision", round(r, 9) AS recall, round(f, 9) AS fpr, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM m""",
)
def confusion_metrics(spark, sf_dir):
    c = evaluate.confusion(predicted(spark, sf_dir), by=("lang",))
    return c.withColumns({k: F.round(k, 9) for k in ("precision", "recall", "fpr", "f1")})


@query("average_precision", f"WITH {_SCORED}, {_CURVE} SELECT round(sum(tp / (tp + fp) * p) / max(pos), 9) AS average_precision FROM c")
def average_precision(spark, sf_dir):
    return evaluate.average_precision(scored(spark, sf_dir)).select(F.round("average_precision", 9).alias("average_precision"))


@query("auroc", f"WITH {_SCORED}, {_CURVE} SELECT round(sum(p * (neg - fp + n / 2)) / (max(pos) * max(neg)), 9) AS auroc FROM c")
def auroc(spark, sf_dir):
    return evaluate.auroc(scored(spark, sf_dir)).select(F.round("auroc", 9).alias("auroc"))


@query(
    "max_f1_threshold",
    f"""WITH {_SCORED}, {_CURVE}, f AS (SELECT score, 2 * tp / (tp + fp + pos) AS f1 FROM c)
    SELECT round(score, 9) AS threshold, round(f1, 9) AS f1 FROM f ORDER BY f1 DESC, score DESC LIMIT 1""",
)
def max_f1_threshold(spark, sf_dir):
    return evaluate.max_f1_threshold(scored(spark, sf_dir)).select(F.round("threshold", 9).alias("threshold"), F.round("f1", 9).alias("f1"))


@query(
    "fpr_threshold",
    f"""WITH {_SCORED}, {_CURVE}, f AS (SELECT score, fp / neg AS fpr, lead(score) OVER (ORDER BY score DESC) AS nxt FROM c)
    SELECT round((score + nxt) / 2, 9) AS threshold, round(fpr, 9) AS fpr FROM f WHERE fpr <= 0.2 ORDER BY score LIMIT 1""",
)
def fpr_threshold(spark, sf_dir):
    return evaluate.fpr_threshold(scored(spark, sf_dir), 0.2).select(F.round("threshold", 9).alias("threshold"), F.round("fpr", 9).alias("fpr"))


@query("curve_points", f'WITH {_SCORED}, {_CURVE} SELECT round(score, 9) AS score, tp, fp, round(tp / (tp + fp), 9) AS "precision", round(tp / pos, 9) AS recall, round(fp / neg, 9) AS fpr FROM c')
def curve_points(spark, sf_dir):
    c = evaluate.curve(scored(spark, sf_dir))
    return c.select(F.round("score", 9).alias("score"), "tp", "fp", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), F.round("fpr", 9).alias("fpr"))


@query(
    "calibration_bins",
    f"""WITH {_SCORED} SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(score), 9) AS mean_score, round(avg(y), 9) AS rate FROM s GROUP BY 1""",
)
def calibration_bins(spark, sf_dir):
    return evaluate.calibration(scored(spark, sf_dir)).withColumns({"mean_score": F.round("mean_score", 9), "rate": F.round("rate", 9)})


@query(
    "calibration_error",
    f"""WITH {_SCORED}, b AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, avg(score) AS m, avg(y) AS r FROM s GROUP BY 1)
    SELECT round(sum(n * abs(m - r)) / sum(n), 9) AS ece, (SELECT round(avg((score - y) * (score - y)), 9) FROM s) AS brier FROM b""",
)
def calibration_error(spark, sf_dir):
    s = scored(spark, sf_dir)
    return evaluate.calibration_error(s).crossJoin(evaluate.brier(s)).select(F.round("ece", 9).alias("ece"), F.round("brier", 9).alias("brier"))


@query(
    "wilson_rates",
    """WITH g AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS k FROM labels JOIN documents USING (doc_id) GROUP BY lang),
    w AS (SELECT lang, n, k, k / n AS p, 1.959963984540054 AS z FROM g)
    SELECT lang, n, k, round(greatest(0, (p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 9) AS low,
    round(least(1, (p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 9) AS high FROM w""",
)
def wilson_rates(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    g = j.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("k"))
    low, high = statistics.wilson(F.col("k"), F.col("n"))
    return g.select("lang", "n", "k", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query(
    "family_macro_rate",
    """WITH g AS (SELECT lang, source, avg(quality) AS m, sum(quality) AS s, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang, source)
    SELECT lang, round(avg(m), 9) AS macro, round(sum(s) / sum(n), 9) AS pooled FROM g GROUP BY lang""",
)
def family_macro_rate(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    return relational.macro_mean(j, "source", "quality", ("lang",)).select("lang", F.round("macro", 9).alias("macro"), F.round("pooled", 9).alias("pooled"))


@query(
    "operating_point",
    f"""WITH {_SCORED}, {_CONF.format(by='', group='')}, m AS (SELECT tp / (tp + fn) AS r, fp / (fp + tn) AS f FROM c)
    SELECT round(1000 * (r * 0.01 + f * 0.99), 9) AS alerts_per_1000, round(r * 0.01 / (r * 0.01 + f * 0.99), 9) AS ppv FROM m""",
)
def operating_point(spark, sf_dir):
    return evaluate.operating_point(predicted(spark, sf_dir), 0.01).select(F.round("alerts_per_1000", 9).alias("alerts_per_1000"), F.round("ppv", 9).alias("ppv"))


@query(
    "warning_tiers",
    f"""WITH {_SCORED} SELECT CASE WHEN score >= 0.8 THEN 'block' WHEN score >= 0.4 THEN 'warn' ELSE 'allow' END AS tier, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM s GROUP BY 1""",
)
def warning_tiers(spark, sf_dir):
    s = scored(spark, sf_dir)
    return s.groupBy(evaluate.warning_tier(F.col("score"), 0.4, 0.8).alias("tier")).agg(F.count("*").alias("n"), F.sum("y").alias("positives"))


@query(
    "blocklist_flag",
    """WITH bad AS (SELECT DISTINCT sha256(text) AS h FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
    SELECT d.doc_id, CASE WHEN bad.h IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS score FROM documents d LEFT JOIN bad ON sha256(d.text) = bad.h""",
)
def blocklist_flag(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    bad = docs.join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    return evaluate.blocklist(docs, bad, "h").select("doc_id", "score")


@query(
    "split_invariants",
    """WITH d AS (SELECT doc_id, text, source, quality AS y, CAST(substr(source, 4) AS INTEGER) % 5 AS fold FROM documents JOIN labels USING (doc_id)),
    a AS (SELECT count(*) FILTER (WHERE n > 1) AS families_in_folds FROM (SELECT count(DISTINCT fold) AS n FROM d GROUP BY source)),
    b AS (SELECT count(*) FILTER (WHERE n > 1) AS codes_in_folds FROM (SELECT count(DISTINCT fold) AS n FROM d GROUP BY sha256(text))),
    c AS (SELECT count(*) FILTER (WHERE n > 1) AS codes_with_labels FROM (SELECT count(DISTINCT y) AS n FROM d GROUP BY sha256(text))) SELECT * FROM a, b, c""",
)
def split_invariants(spark, sf_dir):
    from quern.operators.audit import split_invariants as check

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    j = docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    return check(j.withColumn("fold", F.substring("source", 4, 9).cast("int") % 5), "source", "fold", "h", "y")


@query("family_bootstrap_ci")
def family_bootstrap_ci(spark, sf_dir):
    """Quality rate with an interval from drawing sources again."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").withColumn("one", F.lit(1))
    return statistics.clustered_bootstrap(j, "source", "quality", "one", reps=2000)


@query("learned_scores")
def learned_scores(spark, sf_dir):
    """Logistic scores of labels from text shape, each fold of sources held out in turn."""
    from quern.operators import models

    s = scored(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.size(F.split("text", " ")).alias("n_words"), F.size(F.split("text", "\n")).alias("n_lines")), "doc_id")
    # each fit and each threshold reads the rows again, so texts are split once before
    s = materialize(s.drop("score").join(evaluate.group_folds(s, "source", 3), "source"), "shapes")
    columns = ["n_chars", "n_words", "n_lines"]
    out = evaluate.leave_family_out(s, lambda t: models.fit(t, columns), models.score, 3)
    return out.select("doc_id", "turn", "score", "threshold", "pred")


@query("boosted_family_scores")
def boosted_family_scores(spark, sf_dir):
    """Features to decisions: labelled texts read as byte programs, boosted trees on their token shares and structure,
    each fold of sources held out in turn, thresholds from the fold after it."""
    from quern.functions import features, opcodes
    from quern.operators import boosting

    own = scored(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.lower(F.hex("text")).alias("code")), "doc_id")
    dense = features.featurize(own, "doc_id", "code", opcodes.vocabulary()).select("doc_id", "dense")
    s = own.drop("score", "code").join(evaluate.group_folds(own, "source", 5), "source").join(dense, "doc_id")
    columns = [f"f{k}" for k in range(len(features.feature_views(opcodes.vocabulary())["dense"]))]
    s = materialize(s.select("doc_id", "y", "fold", *[F.get("dense", F.lit(k)).alias(c) for k, c in enumerate(columns)]), "featurized")
    out = materialize(boosting.leave_fold_out(s, columns, "doc_id", 5, rounds=20).select("doc_id", "y", "turn", "role", "score"), "scored")
    limit = evaluate.max_f1_threshold(out.where("role = 'validation'"), by=("turn",)).select("turn", "threshold")
    return out.where("role = 'test'").join(limit, "turn").select("doc_id", "y", "turn", "score", "threshold", (F.col("score") >= F.col("threshold")).cast("int").alias("pred"))
