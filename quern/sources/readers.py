"""Readers for the formats that byte-program tables come in."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quern.schemas import kind

_LFS = "version https://git-lfs"


def read_csv(spark: SparkSession, path: str, schema: StructType, sep: str = ",", header: bool = True) -> DataFrame:
    """CSV or TSV, plain or gzip, with a fixed schema. A gzip file is one task; repartition after it."""
    return spark.read.schema(schema).csv(path, sep=sep, header=header, multiLine=False, enforceSchema=not header)


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, every column as text."""
    return spark.read.option("inferSchema", False).csv(path, header=True)


def read_rule_output(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated rule output without a header, as a set of tuples."""
    schema = StructType()
    for c in columns:
        schema = schema.add(c, "string")
    return spark.read.schema(schema).csv(path, sep="\t").dropDuplicates()


def read_jsonl(spark: SparkSession, path: str, schema: StructType, keep_bad: bool = False) -> DataFrame:
    """JSON lines that may end in a comma; a line that isn't JSON goes, or stays in ``_bad``."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    full = StructType(list(schema.fields)).add("_bad", "string")
    text = F.regexp_replace(F.trim("value"), ",\\s*$", "")
    row = lines.select(F.from_json(text, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    return row if keep_bad else row.where(F.col("_bad").isNull()).drop("_bad")


@F.pandas_udf(kind("[string]"))
def json_objects(lines: pd.Series) -> pd.Series:
    """The objects of each line as text; what doesn't parse is one text from there to the line's end."""
    read = json.JSONDecoder().raw_decode

    def split(line: str | None) -> list[str]:
        out, at = [], 0
        while line is not None:
            while at < len(line) and line[at] in " \t\r\n,":
                at += 1
            if at == len(line):
                break
            try:
                _, end = read(line, at)
            except ValueError:
                end = len(line)
            out.append(line[at:end])
            at = end
        return out

    return lines.map(split)


def read_json_objects(spark: SparkSession, path: str, schema: StructType, keep_bad: bool = False) -> DataFrame:
    """JSON lines that may hold several objects, with or without commas between them.

    A text within an object may hold anything. What isn't an object of the
    schema goes, or stays in ``_bad``.
    """
    parts = spark.read.text(path).select(F.explode(json_objects("value")).alias("value"))
    full = StructType(list(schema.fields)).add("_bad", "string")
    row = parts.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    return row if keep_bad else row.where(F.col("_bad").isNull()).drop("_bad")


def read_addresses_from_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(address, chain) recovered from any line: a path ``<chain>/<address>.hex``, else a bare address."""
    line = spark.read.text(path).select("value")
    in_path = F.regexp_extract("value", r"([A-Za-z0-9_-]+)/(0x[0-9a-fA-F]{40})\.hex", 2)
    chain = F.regexp_extract("value", r"([A-Za-z0-9_-]+)/(0x[0-9a-fA-F]{40})\.hex", 1)
    bare = F.regexp_extract("value", r"(0x[0-9a-fA-F]{40})", 1)
    found = line.select(F.lower(F.when(in_path != "", in_path).otherwise(bare)).alias("address"), F.nullif(chain, F.lit("")).alias("chain"))
    return found.where("address != ''")


def read_hex_directory(spark: SparkSession, path: str) -> DataFrame:
    """(chain, address, bytecode) of ``.hex`` files below a folder; the address is the file's stem."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.hex").text(path, wholetext=True)
    name = F.col("_metadata.file_path")
    parts = F.split(name, "/")
    return files.select(F.element_at(parts, -2).alias("chain"), F.regexp_extract(name, r"([^/]+)\.hex$", 1).alias("address"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("bytecode"))


def read_address_list(spark: SparkSession, path: str) -> DataFrame:
    """(line, address, valid) of a text file with an address on each line."""
    line = F.trim("value")
    return spark.read.text(path).where(line != "").select(line.alias("line"), F.lower(line).alias("address"), line.rlike("^0x[0-9a-fA-F]{40}$").alias("valid"))


def address_census(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count("*").alias("lines"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("malformed"), F.count_distinct(F.when(F.col("valid"), F.col("address"))).alias("unique_valid"))


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def rename_headers(df: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns by their known headers, case and blanks ignored; an absent one is an error."""
    have = {c.strip().lower(): c for c in df.columns}
    picked = {}
    for name, known in aliases.items():
        hit = next((have[k.lower()] for k in (name, *known) if k.lower() in have), None)
        if hit is None:
            raise ValueError(f"no column for {name}")
        picked[name] = hit
    return df.select(*[F.col(f"`{src}`").alias(name) for name, src in picked.items()])


def read_keyed(spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> DataFrame:
    """What ``sinks.append_keyed`` wrote: one row of each key, from the first batch that has it."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", StringType())])).json(path)
    first = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min_by(F.struct(*schema.names), F.struct("batch", *schema.names)).alias("__r"))
    return first.select("__r.*")


def reject_pointer_files(df: DataFrame, column: str) -> DataFrame:
    """``df`` itself, unless it holds a large-file pointer in place of data."""
    if not df.where(F.col(column).startswith(_LFS)).limit(1).isEmpty():
        raise ValueError("the file is a large-file pointer, not data")
    return df


def cache_misses(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that a table of earlier results doesn't hold."""
    return wanted.join(cache.select(*keys).distinct(), keys, "left_anti")


def retry_upsert(rows: DataFrame, fetched: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows whose value is null take the one fetched again for their key."""
    new = fetched.select(*keys, F.col(value).alias("__new"))
    return rows.join(new, keys, "left").withColumn(value, F.coalesce(value, "__new")).drop("__new").select(*rows.columns)
