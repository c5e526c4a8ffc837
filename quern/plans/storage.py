"""Queries that write tables in each format and read them back, and lookups against caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern import schemas
from quern.functions import bytecode
from quern.operators import evaluate, models, programs, relational
from quern.plans.evaluation import _SCORED, predicted, scored
from quern.plans.materialize import scratch_path
from quern.plans.registry import query, table
from quern.sources import readers, sinks


@query("csv_round_trip", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, sf_dir):
    """Customers as CSV and back, with a fixed schema."""
    path = scratch_path(spark, "csv")
    sinks.write_csv(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path)
    return readers.read_csv(spark, path, schemas.struct("c_custkey long, c_name string, c_acctbal double, c_mktsegment string"))


@query("csv_gzip_round_trip", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_gzip_round_trip(spark, sf_dir):
    """Suppliers as gzip CSV and back."""
    path = scratch_path(spark, "csv")
    sinks.write_csv(table(spark, sf_dir, "supplier"), path, gzip=True)
    return readers.read_csv(spark, path, schemas.struct("s_suppkey long, s_name string, s_nationkey int, s_acctbal double"))


@query("strings_round_trip", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def strings_round_trip(spark, sf_dir):
    """Nations as CSV, read with every column as text."""
    path = scratch_path(spark, "csv")
    sinks.write_csv(table(spark, sf_dir, "nation"), path)
    return readers.read_strings(spark, path)


@query("rule_output", "SELECT DISTINCT o_orderpriority AS priority, o_orderstatus AS status FROM orders")
def rule_output(spark, sf_dir):
    """Tab-separated tuples with repeats, read as a set."""
    path = scratch_path(spark, "tsv")
    table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus").write.csv(path, sep="\t")
    return readers.read_rule_output(spark, path, ["priority", "status"])


@query("jsonl_round_trip", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def jsonl_round_trip(spark, sf_dir):
    """Customers appended as JSON lines in two turns, with a line that is no JSON, and back."""
    path, c = scratch_path(spark, "jsonl"), table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    sinks.append_jsonl(c.where("c_custkey % 2 = 0"), path)
    sinks.append_jsonl(c.where("c_custkey % 2 = 1"), path)
    c.limit(1).select(F.lit("not json").alias("value")).write.mode("append").text(path)
    return readers.read_jsonl(spark, path, schemas.struct("c_custkey long, c_name string, c_acctbal double"))


@query("json_objects", "SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey + 100000, '},{' || s_name FROM supplier")
def json_objects(spark, sf_dir):
    """Two objects in each line, one with braces in a text."""
    path, s = scratch_path(spark, "json"), table(spark, sf_dir, "supplier")
    one = F.to_json(F.struct("s_suppkey", "s_name"))
    two = F.to_json(F.struct((F.col("s_suppkey") + 100000).alias("s_suppkey"), F.concat(F.lit("},{"), F.col("s_name")).alias("s_name")))
    s.select(F.concat(one, F.when(F.col("s_suppkey") % 2 == 0, ", ").otherwise(""), two).alias("value")).write.text(path)
    return readers.read_json_objects(spark, path, schemas.struct("s_suppkey long, s_name string"))


@query("json_document", "SELECT n_nationkey, n_name FROM nation")
def json_document(spark, sf_dir):
    """An aggregate as one JSON document and back."""
    path = scratch_path(spark, "json")
    sinks.write_json_document(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path)
    return readers.read_json_document(spark, path).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


def _contracts(spark, sf_dir):
    address = F.concat(F.lit("0x"), F.lpad(F.hex("s_suppkey"), 40, "0"))
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("c"), F.col("s_nationkey").cast("string")).alias("chain"), F.lower(address).alias("address"), F.sha2("s_name", 256).alias("code"))


_CONTRACTS = "c AS (SELECT 'c' || s_nationkey AS chain, '0x' || lpad(lower(hex(s_suppkey)), 40, '0') AS address, sha256(s_name) AS code FROM supplier)"


def _hex_files(spark, sf_dir):
    path = scratch_path(spark, "hex")
    sinks.write_hex_files(_contracts(spark, sf_dir), path).count()
    return path


@query("hex_files", f"WITH {_CONTRACTS} SELECT chain, address, code AS bytecode FROM c")
def hex_files(spark, sf_dir):
    """A file for each contract in its chain's folder, and the folder read."""
    return readers.read_hex_directory(spark, _hex_files(spark, sf_dir))


@query("hex_manifest", f"WITH {_CONTRACTS} SELECT chain || '/' || address || '.hex' AS name, CAST(length(code) AS BIGINT) AS length, sha256(code) AS sha256 FROM c")
def hex_manifest(spark, sf_dir):
    """Sizes and hashes of the files."""
    m = sinks.manifest(spark, _hex_files(spark, sf_dir))
    return m.select(F.concat_ws("/", F.slice(F.split("path", "/"), -2, 2)).alias("name"), "length", "sha256")


@query("address_census", "SELECT count(*) AS lines, count(*) FILTER (WHERE s_suppkey % 4 <> 0) AS valid, count(*) FILTER (WHERE s_suppkey % 4 = 0) AS malformed, count(*) FILTER (WHERE s_suppkey % 4 <> 0) AS unique_valid FROM supplier")
def address_census(spark, sf_dir):
    """Lines of addresses, some of them cut, read and counted."""
    path = scratch_path(spark, "addresses")
    bad = F.conv(F.substring("address", 3, 40), 16, 10).cast("long") % 4 == 0
    _contracts(spark, sf_dir).select(F.when(bad, F.substring("address", 1, 30)).otherwise(F.upper(F.col("address"))).alias("value")).select(F.regexp_replace("value", "^0X", "0x").alias("value")).write.text(path)
    return readers.address_census(readers.read_address_list(spark, path))


@query("recovered_addresses", f"WITH {_CONTRACTS} SELECT address, coalesce(CASE WHEN right(address, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN chain END, 'none') AS chain FROM c")
def recovered_addresses(spark, sf_dir):
    """Addresses and chains recovered from lines that hold a path or the bare address."""
    path, c = scratch_path(spark, "lines"), _contracts(spark, sf_dir)
    even = F.right("address", F.lit(1)).isin(*"02468ace")
    c.select(F.when(even, F.concat(F.lit('{"path": "x/'), "chain", F.lit("/"), "address", F.lit('.hex"}'))).otherwise(F.concat(F.lit("see "), "address")).alias("value")).write.text(path)
    return readers.read_addresses_from_jsonl(spark, path).select("address", F.coalesce("chain", F.lit("none")).alias("chain"))


@query("retried_rows", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'again' || c_custkey ELSE c_name END AS c_name FROM customer")
def retried_rows(spark, sf_dir):
    """Rows that failed take what was fetched again."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    failed = c.withColumn("c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")))
    again = c.select("c_custkey", F.concat(F.lit("again"), F.col("c_custkey").cast("string")).alias("c_name"))
    return readers.retry_upsert(failed, again, ["c_custkey"], "c_name")


@query("cache_misses", "SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0")
def cache_misses(spark, sf_dir):
    """Keys that an earlier result doesn't hold."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return readers.cache_misses(c, c.where("c_custkey % 7 = 0"), ["c_custkey"])


@query("remaining_work", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' OR o_orderstatus IS NULL")
def remaining_work(spark, sf_dir):
    """Orders that a table of finished ones doesn't list."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return sinks.remaining(o.select("o_orderkey"), o.where("o_orderstatus = 'F'"), ["o_orderkey"])


@query("renamed_headers", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def renamed_headers(spark, sf_dir):
    """Columns found by other headers, whatever their case and blanks."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias(" Nation Key "), F.col("n_name").alias("NAME"))
    return readers.rename_headers(n, {"id": ("nation key", "key"), "name": ("title",)})


@query("array_store", "SELECT vec_id, round(list_sum(embedding)::DOUBLE, 4) AS total FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS embedding FROM embeddings)")
def array_store(spark, sf_dir):
    """Vectors as array columns and back."""
    path = scratch_path(spark, "arrays")
    sinks.write_arrays(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), path, ["embedding"])
    v = spark.read.parquet(path)
    return v.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query("hex_numbers", "SELECT p_partkey, CAST('0x' || substr(sha256(p_name), 1, 30) AS HUGEINT)::VARCHAR AS n FROM part")
def hex_numbers(spark, sf_dir):
    """Thirty hex digits as a number."""
    return table(spark, sf_dir, "part").select("p_partkey", bytecode.hex_number(F.substring(F.sha2("p_name", 256), 1, 30)).cast("string").alias("n"))


@query("one_hot_flags", "SELECT doc_id, CAST(lang = 'en' AS INTEGER) AS lang_en, CAST(lang = 'fr' AS INTEGER) AS lang_fr FROM documents")
def one_hot_flags(spark, sf_dir):
    return programs.one_hot(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["en", "fr"]).select("doc_id", "lang_en", "lang_fr")


@query("ensemble_scores", "SELECT l_suppkey AS model_key, round(avg(l_discount), 9) AS mean, round(stddev_pop(l_discount), 9) AS spread FROM lineitem GROUP BY 1")
def ensemble_scores(spark, sf_dir):
    """Mean and spread of several scores of one key."""
    s = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("model_key"), F.col("l_discount").alias("score"))
    return models.ensemble(s, "model_key").select("model_key", F.round("mean", 9).alias("mean"), F.round("spread", 9).alias("spread"))


@query("error_concentration", f"WITH {_SCORED} SELECT round(avg(CASE WHEN score >= 0.7 THEN (CAST(score >= 0.5 AS INTEGER) <> y)::INTEGER END) / avg((CAST(score >= 0.5 AS INTEGER) <> y)::INTEGER), 9) AS ratio, round(avg((score >= 0.7)::INTEGER), 9) AS escalated_share FROM s")
def error_concentration(spark, sf_dir):
    """Error rate among escalated rows over that among all."""
    p = predicted(spark, sf_dir).select((F.col("pred") != F.col("y")).cast("int").alias("error"), (F.col("score") >= 0.7).alias("escalated"))
    return programs.error_concentration(p, "error", "escalated").select(F.round("ratio", 9).alias("ratio"), F.round("escalated_share", 9).alias("escalated_share"))


@query(
    "escalations",
    f"""WITH {_SCORED}, t AS (SELECT avg(score) AS m, stddev_pop(score) AS s FROM s WHERE doc_id % 2 = 0), r AS (SELECT doc_id, (score - m) / (s + 1e-9) + CASE WHEN y = 1 THEN 3.0 ELSE 0.0 END AS risk FROM s, t),
    l AS (SELECT quantile_cont(risk, 0.9) AS q FROM r WHERE doc_id % 2 = 0) SELECT doc_id, round(risk, 6) AS risk, risk > q AS escalate FROM r, l""",
)
def escalations(spark, sf_dir):
    """Risk from scaled parts and a conflict; rows above a training quantile escalate."""
    s = scored(spark, sf_dir).withColumn("conflict", F.col("y") == 1)
    out = models.escalation(s, ["score"], s.where("doc_id % 2 = 0"), "conflict")
    return out.select("doc_id", F.round("risk", 6).alias("risk"), "escalate")


@query(
    "weighted_average_precision",
    f"""WITH {_SCORED}, w AS (SELECT score, y, 1.0 + doc_id % 3 AS w FROM s), p AS (SELECT score, sum(CASE WHEN y = 1 THEN w ELSE 0 END)::DOUBLE AS p, sum(CASE WHEN y <> 1 THEN w ELSE 0 END)::DOUBLE AS n FROM w GROUP BY score),
    c AS (SELECT p, sum(p) OVER o AS tp, sum(n) OVER o AS fp, sum(p) OVER () AS pos FROM p WINDOW o AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) SELECT round(sum(tp / (tp + fp) * p) / max(pos), 9) AS average_precision FROM c""",
)
def weighted_average_precision(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("w", 1.0 + F.col("doc_id") % 3)
    return evaluate.average_precision(s, weight="w").select(F.round("average_precision", 9).alias("average_precision"))


@query("same_sets", "SELECT TRUE AS same, FALSE AS other")
def same_sets(spark, sf_dir):
    """Whether two tables have the same rows."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    c = table(spark, sf_dir, "nation").select("n_nationkey")
    same, other = relational.same_set(o, o.repartition(3)), relational.same_set(c, c.where("n_nationkey > 0"))
    return spark.createDataFrame([(same, other)], "same boolean, other boolean")


@query("hex_decimals", "SELECT p_partkey, CAST(CAST('0x' || md5(p_name) AS UHUGEINT) AS VARCHAR) AS n FROM part")
def hex_decimals(spark, sf_dir):
    """Thirty-two hex digits as a decimal text."""
    return table(spark, sf_dir, "part").select("p_partkey", bytecode.hex_decimal(F.md5("p_name")).alias("n"))


@query("excel_round_trip", "SELECT o_orderkey AS id, o_orderpriority AS priority, round(o_totalprice, 6) AS price, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders")
def excel_round_trip(spark, sf_dir):
    """Orders through workbooks, columns found by other headers."""
    from quern.sources import excel

    path = scratch_path(spark, "workbooks")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(" Order "), F.col("o_orderpriority").alias("PRIORITY"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").cast("date").alias("Day"))
    excel.write_excel(o, path).count()
    got = excel.read_excel(spark, f"{path}/*.xlsx", {"id": ("order",), "priority": (), "price": (), "day": ("date",)})
    return got.select(F.col("id").cast("long").alias("id"), "priority", F.round(F.col("price").cast("double"), 6).alias("price"), "day")


@query("keyed_append", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer")
def keyed_append(spark, sf_dir):
    """Customers appended by key: a batch, a later one with keys that are there already, and the first one again."""
    path, c = scratch_path(spark, "keyed"), table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    early = c.where("c_custkey % 3 <> 0")
    sinks.append_keyed(early, path, ["c_custkey"], "001")
    sinks.append_keyed(c.withColumn("c_acctbal", F.col("c_acctbal") + 1), path, ["c_custkey"], "002")
    sinks.append_keyed(early.unionByName(early), path, ["c_custkey"], "001")
    return readers.read_keyed(spark, path, schemas.struct("c_custkey long, c_name string, c_acctbal double"), ["c_custkey"])


@query("truncated_cells", "SELECT doc_id, length(repeat(text, 9)) AS n, least(length(repeat(text, 9)), 32767) = 32767 AS cut FROM documents")
def truncated_cells(spark, sf_dir):
    """Which texts, nine times over, a spreadsheet cell cuts at its limit."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.repeat("text", F.lit(9)).alias("t"))
    return d.select("doc_id", F.length("t").alias("n"), bytecode.truncated_cap(F.substring("t", 1, 32767)).alias("cut"))
