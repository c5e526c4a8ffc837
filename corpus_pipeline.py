"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before it
returned, and all but the last return the columns of ``docs``, in their order,
whatever further ones there are. A stage judges rows, not ids: of rows with a
null or repeated id only the judged one goes. An empty table stays empty. What a
stage writes on the way is deleted when the next table is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, langid, near_dedup, packing, substring_dedup
from quern.llm.common import unique_ids, unused
from quern.plans.materialize import materialize, passing, scratch_path

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of each row and its name, in the order of doc_id: doc_id itself where it is unique.

    Rows with a null id come last.
    """
    row = unused(docs, "__row")
    if unique_ids(docs, "doc_id"):
        return docs.withColumn(row, F.col("doc_id")), row
    order = docs.orderBy(F.col("doc_id").asc_nulls_last(), "text")
    return materialize(order.withColumn(row, F.monotonically_increasing_id()), "keyed"), row


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; rejected ones go.

    Null and empty texts and those without a letter go, and so do all rows where
    no row has a language to learn from. Whole texts count, however long; equal
    texts fare alike.
    """
    return langid.drop_rejected(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that with the smallest id.

    Of repeated rows the first by text stays; a row with a null id only stays
    where no row of its group has an id. Null texts and texts without a word are
    in no group and stay.
    """
    keyed, row = _keyed(docs)
    found = near_dedup.near_duplicates(keyed, row)
    away = found.where("not kept").select(row).distinct()
    return keyed.join(away, row, "left_anti").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that near-duplicate an earlier document's; n_chars follows.

    A document of which nothing is left goes. Null, empty and short texts stay
    as they are. Rows with a null id count as later than all others.
    """
    keyed, row = _keyed(docs)
    found = materialize(substring_dedup.repeated_passages(keyed, row), "passages")
    out = substring_dedup.cut_passages(keyed, found, row).select(docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item or ask it again with other values.

    Null and empty texts stay. An empty benchmark drops nothing.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that is left into sequences of 1024 tokens.

    A null text is empty and takes one end token; repeated rows are packed each.
    """
    import public_tokenizers

    return packing.pack(docs, tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        with passing(spark):
            docs = materialize(stage(spark, docs, sf_dir), name, path)
    return STAGES[-1][1](spark, docs, sf_dir)
