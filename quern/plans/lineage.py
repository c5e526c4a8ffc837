"""Queries on provenance: repairs, donors, weights, contamination."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import bytecode
from quern.operators import audit, evaluate, relational
from quern.plans.registry import query, table


@query(
    "repair_status",
    """WITH s AS (SELECT page_id, html, CASE WHEN page_id % 4 = 0 THEN html WHEN page_id % 4 = 1 THEN substr(html, 1, 50) WHEN page_id % 4 = 2 THEN 'x' || html END AS stored FROM pages)
    SELECT CASE WHEN html = stored THEN 'unchanged' WHEN starts_with(html, stored) THEN 'repaired' WHEN stored IS NULL THEN 'never_stored' ELSE 'mismatch' END AS status, count(*) AS n FROM s GROUP BY 1""",
)
def repair_status(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id") % 4
    stored = F.when(k == 0, F.col("html")).when(k == 1, F.substring("html", 1, 50)).when(k == 2, F.concat(F.lit("x"), F.col("html")))
    status = F.when(stored.isNull(), "never_stored").otherwise(bytecode.repair_status(stored, F.col("html")))
    return p.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(
    "source_weights",
    "SELECT doc_id, source, round(1.0 / count(*) OVER (PARTITION BY source), 12) AS weight FROM documents",
)
def source_weights(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    n = d.groupBy("source").agg(F.count("*").alias("n"))
    return d.join(n, "source").select("doc_id", "source", F.round(1 / F.col("n"), 12).alias("weight"))


@query(
    "contamination_rate",
    """WITH r AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE source = 'src0'), d AS (SELECT sha256(text) AS h FROM documents WHERE source <> 'src0')
    SELECT count(*) AS rows, count(r.h) AS contaminated, round(count(r.h) / count(*), 9) AS share FROM d LEFT JOIN r USING (h)""",
)
def contamination_rate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("h"))
    out = audit.contamination(d.where("source != 'src0'"), d.where("source = 'src0'"), "h")
    return out.withColumn("share", F.round("share", 9))


@query(
    "z_scores",
    """WITH t AS (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM documents WHERE lang = 'en') SELECT doc_id, round((n_chars - m) / (s + 1e-9), 6) AS z FROM documents, t""",
)
def z_scores(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return evaluate.z_scores(d, d.where("lang = 'en'"), ["n_chars"]).select("doc_id", F.round("z_n_chars", 6).alias("z"))


_DONORS_SQL = """WITH d AS (SELECT doc_id AS sid, source AS family, doc_id % 5 AS fold, text FROM documents),
    u AS (SELECT * FROM d WHERE sid IN (SELECT min(sid) FROM d GROUP BY text)),
    p AS (SELECT sid AS donor, family AS donor_family, fold, row_number() OVER (PARTITION BY fold ORDER BY family, sid) - 1 AS place FROM u),
    f AS (SELECT fold, count(*) AS n FROM p GROUP BY fold), o AS (SELECT fold, donor_family AS family, min(place) AS first, count(*) AS many FROM p GROUP BY 1, 2),
    r AS (SELECT sid, d.family, d.fold, n - coalesce(many, 0) AS pool_size, first, coalesce(many, 0) AS many FROM d JOIN f USING (fold) LEFT JOIN o ON o.fold = d.fold AND o.family = d.family WHERE sid IN (SELECT doc_id FROM labels)),
    k AS (SELECT *, unnest(range(least(2, pool_size))) AS k FROM r),
    x AS (SELECT *, CAST(floor((k + CAST('0x' || substr(md5(concat(sid, '|7702')), 1, 12) AS BIGINT)::DOUBLE / 281474976710656.0) * pool_size / least(2, pool_size)) AS BIGINT) AS i FROM k),
    y AS (SELECT *, CASE WHEN i >= first THEN i + many ELSE i END AS place FROM x)"""


@query("donor_ledger", f"{_DONORS_SQL} SELECT sid, k + 1 AS rank, fold, family, donor, donor_family, pool_size, place FROM y JOIN p USING (fold, place)")
def donor_ledger(spark, sf_dir):
    """Two donors of another source and the same fold for each labelled document, no text being a donor twice, with each draw."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sid"), F.col("source").alias("family"), (F.col("doc_id") % 5).cast("int").alias("fold"), F.sha2("text", 256).alias("h"))
    wanted = d.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sid")), "sid", "left_semi")
    return relational.donor_ledger(wanted, relational.unique_donors(d, "sid", "h"), "family", "fold", 2)


@query("isolated_donors")
def isolated_donors(spark, sf_dir):
    """Two donors of another source and the same fold for each labelled document."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sid"), F.col("source").alias("family"), (F.col("doc_id") % 5).cast("int").alias("fold"))
    wanted = d.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sid")), "sid", "left_semi")
    return relational.donors(wanted, d, "family", "fold", 2)


@query(
    "run_agreement",
    """WITH a AS (SELECT doc_id, quality * 0.5 AS x FROM labels), b AS (SELECT doc_id, quality * 0.5 + toxic * 0.01 AS y FROM labels WHERE doc_id % 10 <> 3)
    SELECT count(abs(x - y)) AS rows, round(CAST(max(abs(x - y)) AS DOUBLE), 9) AS max_diff, round(avg(abs(x - y)), 9) AS mean_diff, count(*) FILTER (WHERE x IS NULL OR y IS NULL) AS unmatched FROM a FULL JOIN b USING (doc_id)""",
)
def run_agreement(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    a = lab.select("doc_id", (F.col("quality") * 0.5).alias("v"))
    b = lab.where("doc_id % 10 != 3").select("doc_id", (F.col("quality") * 0.5 + F.col("toxic") * 0.01).alias("v"))
    out = audit.agreement_of_runs(a, b, ["doc_id"], "v")
    return out.withColumns({"max_diff": F.round("max_diff", 9), "mean_diff": F.round("mean_diff", 9)})


@query(
    "url_parts",
    r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, string_split(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '/')[1] AS first_part,
    regexp_matches(url, '[?&]utm_') AS tracked FROM pages""",
)
def url_parts(spark, sf_dir):
    path = F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.split(path, "/")[0].alias("first_part"), F.col("url").rlike("[?&]utm_").alias("tracked"))
