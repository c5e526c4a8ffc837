"""Queries on texts as sequences: duplicates, features, signatures, families."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import bytecode, features
from quern.functions.batches import bounded_batches
from quern.operators import audit, relational, similarity
from quern.plans.materialize import materialize
from quern.plans.registry import query, table

#: Words of a text as the sequence queries take them; DuckDB splits alike.
WORDS_SQL = "string_split(lower(trim(text)), ' ')"


def words():
    return F.split(F.lower(F.trim("text")), " ", -1)


@query(
    "exact_dup_groups",
    """SELECT sha256(lower(trim(text))) AS content_hash, count(*) AS members, count(DISTINCT source) AS n_sources, count(DISTINCT lang) AS n_langs
    FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""",
)
def exact_dup_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    key = bytecode.code_hash(F.lower(F.trim("text"))).alias("content_hash")
    # pairs of source and language are few in a group, so they are counted before they are told apart
    part = docs.groupBy(key, "source", "lang").agg(F.count("*").alias("n"))
    return part.groupBy("content_hash").agg(F.sum("n").alias("members"), F.size(F.collect_set("source")).cast("long").alias("n_sources"), F.size(F.collect_set("lang")).cast("long").alias("n_langs")).where("members > 1")


@query(
    "exact_dup_rows",
    """SELECT doc_id, 'B' || substr(sha256(text), 1, 16) AS dup_group, count(*) OVER (PARTITION BY sha256(text)) AS group_size,
    row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1 AS is_first FROM documents WHERE text IS NOT NULL""",
)
def exact_dup_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", bytecode.code_hash(F.col("text")).alias("h"))
    g = docs.groupBy("h").agg(F.count("*").alias("group_size"), F.min("doc_id").alias("first"))
    return docs.join(g, "h").select("doc_id", F.concat(F.lit("B"), F.substring("h", 1, 16)).alias("dup_group"), "group_size", (F.col("doc_id") == F.col("first")).alias("is_first"))


@query(
    "label_conflict_quarantine",
    """WITH j AS (SELECT sha256(text) AS h, quality FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL),
    g AS (SELECT h, count(DISTINCT quality) AS k, count(*) AS n FROM j GROUP BY h)
    SELECT count(*) AS groups, count(*) FILTER (WHERE k > 1) AS conflicts, CAST(coalesce(sum(CASE WHEN k <= 1 THEN n END), 0) AS BIGINT) AS rows_retained FROM g""",
)
def label_conflict_quarantine(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", bytecode.code_hash(F.col("text")).alias("h"))
    j = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    g = j.groupBy("h").agg(F.count_distinct("quality").alias("k"), F.count("*").alias("n"))
    return g.agg(F.count("*").alias("groups"), F.count_if(F.col("k") > 1).alias("conflicts"), F.coalesce(F.sum(F.when(F.col("k") <= 1, F.col("n"))), F.lit(0)).alias("rows_retained"))


@query(
    "corpus_stats",
    """WITH g AS (SELECT sha256(text) AS h, count(*) AS n, count(DISTINCT source) AS c FROM documents GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS codes, count(*) FILTER (WHERE n > 1) AS copied_codes, count(*) FILTER (WHERE c > 1) AS cross_chain_codes, max(n) AS largest_group,
    (SELECT min(n_chars) FROM documents) AS min_size, (SELECT max(n_chars) FROM documents) AS max_size, (SELECT round(avg(n_chars), 6) FROM documents) AS mean_size FROM g""",
)
def corpus_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(bytecode.code_hash(F.col("text")).alias("h"), "source", "n_chars")
    return audit.corpus_block(docs, "h", "n_chars", "source").withColumn("mean_size", F.round("mean_size", 6))


@query(
    "dup_size_buckets",
    """WITH g AS (SELECT count(*) AS n FROM documents GROUP BY sha256(text))
    SELECT count(*) FILTER (WHERE n = 1) AS b1, count(*) FILTER (WHERE n = 2) AS b2, count(*) FILTER (WHERE n BETWEEN 3 AND 5) AS b3_5, count(*) FILTER (WHERE n BETWEEN 6 AND 10) AS b6_10, count(*) FILTER (WHERE n > 10) AS b_more FROM g""",
)
def dup_size_buckets(spark, sf_dir):
    return audit.size_buckets(table(spark, sf_dir, "documents").select(bytecode.code_hash(F.col("text")).alias("h")), "h")


@query(
    "token_histogram",
    f"""WITH t AS (SELECT doc_id, unnest({WORDS_SQL}) AS op, len({WORDS_SQL}) AS total FROM documents)
    SELECT doc_id, op, count(*) AS n, round(count(*) / first(total), 9) AS share FROM t GROUP BY doc_id, op""",
)
def token_histogram(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", words().alias("ops"))
    return features.histogram(docs, "doc_id", "ops").withColumn("share", F.round("share", 9))


@query(
    "kgram_hash_vector",
    f"""WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
    g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) ELSE [array_to_string(w, ' ')] END) AS g FROM d),
    e AS (SELECT doc_id, len(g) AS total, unnest(g) AS gram FROM g)
    SELECT doc_id, CAST(CAST('0x' || substr(sha256(gram), 1, 15) AS BIGINT) % 512 AS INTEGER) AS bucket, round(count(*) / first(total), 9) AS share FROM e GROUP BY 1, 2""",
)
def kgram_hash_vector(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", words().alias("ops"))
    return features.hashed_ngrams(docs, "doc_id", "ops", digest="sha256").withColumn("share", F.round("share", 9))


@query("near_dup_families")
def near_dup_families(spark, sf_dir):
    """Families of texts at signature agreement 0.85 (every pair that agrees is found)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", words().alias("ops"))
    sig = similarity.materialize(similarity.token_signature(docs, "doc_id", F.col("ops")), "signatures")
    return similarity.relabel(similarity.families(sig, "doc_id", "sig", 0.85), "doc_id", "doc_id")


@query(
    "hex_profile",
    """WITH h AS (SELECT doc_id, lower(hex(encode(text))) AS h FROM documents)
    SELECT doc_id, h AS code, CAST(length(h) // 2 AS INTEGER) AS code_bytes, 'B' || substr(sha256(h), 1, 16) AS code_group,
    CASE WHEN h = '' THEN 'EOA_OR_EMPTY' WHEN starts_with(h, 'ef0100') AND length(h) = 46 THEN 'DESIGNATOR_7702' ELSE 'CONTRACT_CODE' END AS code_class FROM h""",
)
def hex_profile(spark, sf_dir):
    """Hex code, size, group and class of each whole text."""
    raw = table(spark, sf_dir, "documents").select("doc_id", bytecode.normalize(F.concat(F.lit("0x"), F.hex(F.encode("text", "UTF-8")))).alias("code"))
    return raw.select("doc_id", "code", bytecode.code_bytes(F.col("code")).alias("code_bytes"), bytecode.group_id(F.col("code")).alias("code_group"), bytecode.classify_code(F.col("code")).alias("code_class"))


@query("instruction_counts")
def instruction_counts(spark, sf_dir):
    """Instructions, stack effect and gas of each page's bytes read as a program."""
    pages = table(spark, sf_dir, "pages").select("page_id", bytecode.program_totals(F.encode("html", "UTF-8")).alias("t"))
    return pages.select("page_id", "t.n_ops", "t.stack_balance", "t.gas")


@query("control_flow_profile")
def control_flow_profile(spark, sf_dir):
    """Blocks and reachability of each page's bytes read as a program."""
    from quern.functions.cfg import control_flow_counts

    bounded_batches(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", control_flow_counts(F.encode("html", "UTF-8")).alias("c"))
    return pages.select("page_id", "c.blocks", "c.reachable_blocks", "c.unresolved_jumps", "c.executable_bytes", "c.removed_bytes")


@query(
    "frequency_rank_table",
    f"""WITH t AS (SELECT unnest({WORDS_SQL}) AS token FROM documents), c AS (SELECT token, count(*) AS n FROM t GROUP BY token),
    r AS (SELECT token, n, row_number() OVER (ORDER BY n, token) - 1 AS r, count(*) OVER () AS k FROM c)
    SELECT token, n, CAST(round_even(r * 255 / greatest(k - 1, 1), 0) AS INTEGER) AS code FROM r""",
)
def frequency_rank_table(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select(F.explode(words()).alias("token"))
    return features.frequency_ranks(tokens, "token")


@query(
    "first_appearance_codes",
    f"""WITH t AS (SELECT doc_id, unnest({WORDS_SQL}) AS token, generate_subscripts({WORDS_SQL}, 1) AS pos FROM documents),
    f AS (SELECT token, min((doc_id, pos)) AS first FROM t GROUP BY token)
    SELECT token, CAST(row_number() OVER (ORDER BY first) - 1 AS INTEGER) AS code FROM f""",
)
def first_appearance_codes(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(words()).alias("pos", "token"))
    return features.factorize(tokens, ["doc_id", "pos"], "token")


@query(
    "cross_source_conflicts",
    """SELECT sha256(text) AS content_hash, count(DISTINCT lang) AS n_labels, array_to_string(list_sort(list_distinct(list(source))), ';') AS sources, count(*) AS members
    FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1""",
)
def cross_source_conflicts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(bytecode.code_hash(F.col("text")).alias("content_hash"), "source", "lang")
    langs = docs.groupBy("content_hash").agg(F.count_distinct("lang").alias("k"))
    out = relational.conflicting_groups(docs, "content_hash", "source")
    return out.join(langs, "content_hash").select("content_hash", F.col("k").alias("n_labels"), F.col("labels").alias("sources"), "members")


@query(
    "fixed_width_chunks",
    """WITH h AS (SELECT page_id, lower(hex(encode(html))) AS h FROM pages), s AS (SELECT page_id, regexp_extract_all(h, '.{6}') AS p FROM h), m AS (SELECT max(len(p)) AS m FROM s)
    SELECT page_id, array_to_string(list_concat(p, list_transform(range(m - len(p)), lambda x: '000000')), ' ') AS chunks FROM s, m""",
)
def fixed_width_chunks(spark, sf_dir):
    """All six-digit chunks of each page, filled up to the longest page's number."""
    h = F.lower(F.hex(F.encode("html", "UTF-8")))
    pages = table(spark, sf_dir, "pages")
    most = pages.agg(F.max(F.floor(F.length(h) / 6))).first()[0] or 0
    return pages.select("page_id", F.array_join(bytecode.hex_chunks(h, 6, most), " ").alias("chunks"))


@query(
    "keep_first_by_hash",
    """SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS k FROM documents) WHERE k = 1""",
)
def keep_first_by_hash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", bytecode.code_hash(F.col("text")).alias("h"))
    return docs.groupBy("source", "h").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "source")


@query(
    "stage_ledger",
    """WITH s AS (SELECT doc_id, quality AS y, toxic, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS k FROM documents JOIN labels USING (doc_id))
    SELECT 0 AS step, 'labelled' AS stage, count(*) AS rows, count(*) FILTER (WHERE y = 1) AS positives FROM s UNION ALL
    SELECT 1, 'not_toxic', count(*), count(*) FILTER (WHERE y = 1) FROM s WHERE toxic = 0 UNION ALL
    SELECT 2, 'distinct', count(*), count(*) FILTER (WHERE y = 1) FROM s WHERE toxic = 0 AND k = 1""",
)
def stage_ledger(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", bytecode.code_hash(F.col("text")).alias("h"))
    j = docs.join(table(spark, sf_dir, "labels"), "doc_id").withColumnRenamed("quality", "y")
    j = j.withColumn("k", F.row_number().over(Window.partitionBy("h").orderBy("doc_id")))
    calm = j.where("toxic = 0")
    return audit.stage_ledger([("labelled", j), ("not_toxic", calm), ("distinct", calm.where("k = 1"))], "y")


@query(
    "tfidf_vectors",
    f"""WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
    g AS (SELECT doc_id, array_to_string(w[i:i + k - 1], ' ') AS gram, count(*) AS n
      FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT doc_id, w, unnest([1, 2, 3, 4]) AS k FROM d)) GROUP BY 1, 2),
    t AS (SELECT gram, ln((1.0 + (SELECT count(*) FROM d WHERE doc_id % 5 <> 0)) / (1.0 + count(*))) + 1 AS idf FROM g WHERE doc_id % 5 <> 0 GROUP BY gram HAVING count(*) >= 3 ORDER BY sum(n) DESC, gram LIMIT 20000),
    v AS (SELECT doc_id, gram, n * idf AS w FROM g JOIN t USING (gram)), l AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM v GROUP BY doc_id)
    SELECT doc_id, count(*) AS n_terms, round(sum(w / norm), 7) AS total, round(max(w / norm), 7) AS heaviest FROM v JOIN l USING (doc_id) GROUP BY doc_id""",
)
def tfidf_vectors(spark, sf_dir):
    """TF-IDF of word 1- to 4-grams, learnt from four fifths of the documents: terms, sum of weights and largest one of each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", words().alias("ops"))
    terms = features.tfidf_terms(docs.where("doc_id % 5 <> 0"), "doc_id", F.col("ops"))
    v = features.tfidf_vectors(docs, terms, "doc_id", F.col("ops")).select("doc_id", F.explode("terms").alias("t"))
    return v.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.round(F.sum("t.weight"), 7).alias("total"), F.round(F.max("t.weight"), 7).alias("heaviest"))


@query("novelty_of_documents")
def novelty_of_documents(spark, sf_dir):
    """How new each text of a quarter of the sources is against those of the others: same text, similar signature, or novel."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("address"), (F.crc32(F.col("source").cast("binary")) % 4 == 0).alias("new"), words().alias("ops"))
    sig = materialize(similarity.token_signature(docs, "doc_id", F.col("ops")).join(docs.drop("ops"), "doc_id"), "signatures")
    return similarity.novelty_against(sig.where("new"), sig.where("not coalesce(new, false)"), "doc_id", "address", "sig")
