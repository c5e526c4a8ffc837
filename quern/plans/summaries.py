"""Grouped summaries, windows, agreement and tests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import relational, statistics
from quern.plans.registry import query, table


@query(
    "group_quantiles",
    """SELECT lang, count(*) AS n, min(n_chars) AS lo, round(quantile_cont(n_chars, 0.05), 6) AS q05, round(quantile_cont(n_chars, 0.25), 6) AS q25, round(quantile_cont(n_chars, 0.5), 6) AS q50,
    round(quantile_cont(n_chars, 0.75), 6) AS q75, round(quantile_cont(n_chars, 0.95), 6) AS q95, max(n_chars) AS hi, round(avg(n_chars), 6) AS mean FROM documents GROUP BY lang""",
)
def group_quantiles(spark, sf_dir):
    q = F.percentile("n_chars", F.array(*map(F.lit, (0.05, 0.25, 0.5, 0.75, 0.95))))
    g = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.min("n_chars").alias("lo"), q.alias("q"), F.max("n_chars").alias("hi"), F.round(F.avg("n_chars"), 6).alias("mean"))
    return g.select("lang", "n", "lo", *[F.round(F.col("q")[k], 6).alias(f"q{p}") for k, p in enumerate(("05", "25", "50", "75", "95"))], "hi", "mean")


@query("value_counts", "SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source, lang")
def value_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(
    "price_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
    round(avg(l_quantity), 6) AS avg_qty, round(stddev_pop(l_discount), 9) AS std_disc, count(*) AS n FROM lineitem GROUP BY 1, 2""",
)
def price_summary(spark, sf_dir):
    """Named aggregates over a fact table."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return g.agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
        F.round(F.stddev_pop("l_discount"), 9).alias("std_disc"),
        F.count("*").alias("n"),
    )


@query(
    "two_stage_mean",
    """WITH a AS (SELECT l_returnflag, l_suppkey, l_linenumber, avg(l_discount) AS m FROM lineitem GROUP BY 1, 2, 3), b AS (SELECT l_returnflag, l_linenumber, avg(m) AS m FROM a GROUP BY 1, 2)
    SELECT l_returnflag, round(avg(m), 9) AS mean, round(stddev_pop(m), 9) AS spread FROM b GROUP BY 1""",
)
def two_stage_mean(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_suppkey", "l_linenumber").agg(F.avg("l_discount").alias("m"))
    b = a.groupBy("l_returnflag", "l_linenumber").agg(F.avg("m").alias("m"))
    return b.groupBy("l_returnflag").agg(F.round(F.avg("m"), 9).alias("mean"), F.round(F.stddev_pop("m"), 9).alias("spread"))


@query(
    "crosstab",
    """SELECT source, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'fr') AS fr, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'es') AS es FROM documents GROUP BY source""",
)
def crosstab(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").pivot("lang", ["en", "fr", "de", "es"]).count().fillna(0)


@query(
    "unpivot_measures",
    """SELECT s_suppkey, measure, value FROM (SELECT s_suppkey, s_acctbal, s_nationkey::DOUBLE AS s_nationkey FROM supplier) UNPIVOT (value FOR measure IN (s_acctbal, s_nationkey))""",
)
def unpivot_measures(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("double").alias("s_nationkey"))
    return s.unpivot("s_suppkey", ["s_acctbal", "s_nationkey"], "measure", "value")


@query("top_k_groups", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10")
def top_k_groups(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return g.orderBy(F.desc("n"), "o_custkey").limit(10)


@query(
    "top_k_per_group",
    """SELECT o_custkey, o_orderkey, o_totalprice, CAST(k AS INTEGER) AS k FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3""",
)
def top_k_per_group(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(w)).where("k <= 3").select("o_custkey", "o_orderkey", "o_totalprice", "k")


@query(
    "argmax_per_group",
    "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best_order, max(o_totalprice) AS best_price FROM orders GROUP BY 1",
)
def argmax_per_group(spark, sf_dir):
    best = F.max_by("o_orderkey", F.struct(F.col("o_totalprice"), -F.col("o_orderkey")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(best.alias("best_order"), F.max("o_totalprice").alias("best_price"))


@query(
    "running_totals",
    """WITH d AS (SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2)
    SELECT user_id, event_type, n, CAST(sum(n) OVER w AS BIGINT) AS running_n FROM d WINDOW w AS (PARTITION BY user_id ORDER BY event_type ROWS UNBOUNDED PRECEDING)""",
)
def running_totals(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy("event_type").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.withColumn("running_n", F.sum("n").over(w))


@query(
    "bool_groups",
    "SELECT l_orderkey, bool_and(l_quantity > 10) AS all_large, bool_or(l_discount > 0.08) AS any_discount, string_agg(DISTINCT l_returnflag, ';' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1",
)
def bool_groups(spark, sf_dir):
    flags = F.array_join(F.sort_array(F.collect_set("l_returnflag")), ";")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_quantity") > 10).alias("all_large"), F.bool_or(F.col("l_discount") > 0.08).alias("any_discount"), flags.alias("flags"))


_RATED = "r AS (SELECT doc_id, quality AS a, CASE WHEN n_chars % 5 = 0 THEN 1 - quality ELSE quality END AS b, CASE WHEN n_chars % 3 = 0 THEN toxic ELSE quality END AS c FROM labels JOIN documents USING (doc_id))"


def rated(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    b = F.when(F.col("n_chars") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    c = F.when(F.col("n_chars") % 3 == 0, F.col("toxic")).otherwise(F.col("quality"))
    return j.select("doc_id", F.col("quality").alias("a"), b.alias("b"), c.alias("c"))


@query(
    "kappa_agreement",
    f"""WITH {_RATED}, t AS (SELECT count(*) AS t, count(*) FILTER (WHERE a = b) AS same, count(*) FILTER (WHERE a = 1) AS a1, count(*) FILTER (WHERE b = 1) AS b1 FROM r),
    k AS (SELECT same / t AS po, (a1 * b1 + (t - a1) * (t - b1)) / (t * t) AS pe FROM t) SELECT round(po, 9) AS observed, round(pe, 9) AS expected, round((po - pe) / (1 - pe), 9) AS kappa FROM k""",
)
def kappa_agreement(spark, sf_dir):
    k = statistics.cohen_kappa(rated(spark, sf_dir), "a", "b")
    return k.select(*[F.round(c, 9).alias(c) for c in k.columns])


@query(
    "fleiss_kappa",
    f"""WITH {_RATED}, u AS (SELECT doc_id, a + b + c AS k FROM r), p AS (SELECT avg((k * (k - 1) + (3 - k) * (2 - k)) / 6) AS p, sum(k) AS ones, 3 * count(*) AS t FROM u)
    SELECT round((p - e) / (1 - e), 9) AS kappa FROM (SELECT p, (ones * ones + (t - ones) * (t - ones)) / (t * t) AS e FROM p)""",
)
def fleiss_kappa(spark, sf_dir):
    long = rated(spark, sf_dir).unpivot("doc_id", ["a", "b", "c"], "rater", "rating")
    return statistics.fleiss_kappa(long, "doc_id", "rating").select(F.round("kappa", 9).alias("kappa"))


@query(
    "majority_vote",
    """WITH t AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY 1, 2), m AS (SELECT conv_id, sum(n) AS t, arg_max(role, (n, role)) AS r, max(n) AS n FROM t GROUP BY 1)
    SELECT conv_id, CASE WHEN n * 2 > t THEN r ELSE 'no_majority' END AS majority FROM m""",
)
def majority_vote(spark, sf_dir):
    return statistics.majority(table(spark, sf_dir, "conversations"), "conv_id", "role")


@query(
    "adjusted_rand",
    """WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), ij AS (SELECT sum(n * (n - 1) / 2) AS v, sum(n) AS t FROM c),
    i AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM c GROUP BY source)), j AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM c GROUP BY lang)),
    x AS (SELECT ij.v AS a, i.v * j.v / (t * (t - 1) / 2) AS w, (i.v + j.v) / 2 AS m FROM ij, i, j) SELECT round((a - w) / (m - w), 9) AS ari FROM x""",
)
def adjusted_rand(spark, sf_dir):
    return statistics.adjusted_rand(table(spark, sf_dir, "documents"), "source", "lang").select(F.round("ari", 9).alias("ari"))


@query(
    "ks_two_sample",
    """WITH p AS (SELECT n_chars AS v, count(*) FILTER (WHERE lang = 'en') AS a, count(*) FILTER (WHERE lang = 'fr') AS b FROM documents WHERE lang IN ('en', 'fr') GROUP BY 1),
    c AS (SELECT abs(sum(a) OVER w / sum(a) OVER () - sum(b) OVER w / sum(b) OVER ()) AS d FROM p WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING)) SELECT round(max(d), 9) AS statistic FROM c""",
)
def ks_two_sample(spark, sf_dir):
    return statistics.ks_two_sample(table(spark, sf_dir, "documents"), "n_chars", "lang", "en", "fr").select(F.round("statistic", 9).alias("statistic"))


@query(
    "chi_square",
    """WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), l AS (SELECT lang, sum(n) AS a FROM c GROUP BY 1), s AS (SELECT source, sum(n) AS b FROM c GROUP BY 1), t AS (SELECT sum(n) AS t FROM c),
    g AS (SELECT coalesce(n, 0) AS n, a * b / t AS e FROM l CROSS JOIN s CROSS JOIN t LEFT JOIN c USING (lang, source))
    SELECT round(sum((n - e) * (n - e) / e), 6) AS statistic, (SELECT (count(DISTINCT lang) - 1) * (count(DISTINCT source) - 1) FROM c) AS dof FROM g""",
)
def chi_square(spark, sf_dir):
    return statistics.chi_square(table(spark, sf_dir, "documents"), "lang", "source").select(F.round("statistic", 6).alias("statistic"), "dof")


@query(
    "kruskal_wallis",
    """WITH v AS (SELECT n_chars AS v, count(*) AS c FROM documents GROUP BY 1), r AS (SELECT v, c, coalesce(sum(c) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (c + 1) / 2 AS r FROM v),
    t AS (SELECT sum(c) AS n, sum(c * c * c - c) AS ties FROM v), g AS (SELECT lang, sum(r) AS s, count(*) AS m FROM documents JOIN r ON n_chars = v GROUP BY 1), h AS (SELECT sum(s * s / m) AS q, count(*) AS k FROM g)
    SELECT round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 6) AS h, k - 1 AS dof FROM h, t""",
)
def kruskal_wallis(spark, sf_dir):
    return statistics.kruskal_wallis(table(spark, sf_dir, "documents"), "n_chars", "lang").select(F.round("h", 6).alias("h"), "dof")


@query(
    "json_facts",
    """SELECT event_type, count(*) AS n, count(props) AS with_props, count(*) FILTER (WHERE json_valid(props)) AS parsed FROM events GROUP BY 1""",
)
def json_facts(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    parsed = F.try_parse_json("props").isNotNull()
    return ev.groupBy("event_type").agg(F.count("*").alias("n"), F.count("props").alias("with_props"), F.count_if(parsed).alias("parsed"))


@query("month_periods", "SELECT date_trunc('month', o_orderdate) AS month, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def month_periods(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("month")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query(
    "tumbling_event_counts",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS "start", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""",
)
def tumbling_event_counts(spark, sf_dir):
    from quern.streaming.windows import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))
