"""Writers; Spark's committer makes each atomic."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    df.write.mode("overwrite").option("header", True).option("compression", "gzip" if gzip else "none").csv(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_keyed(df: DataFrame, path: str, keys: list[str], batch: str) -> None:
    """The rows whose key no earlier batch holds, as JSON lines of a batch; ``readers.read_keyed`` reads them.

    Of rows with one key the first by all columns stays. A batch is a folder of
    its own that Spark's committer fills whole: repeating it, or one of its
    tasks, writes the same again. Two writers that don't see each other may both
    write a key; the reader then takes that of the batch whose name comes first,
    so names should rise. A null in a key is a value like any other.
    """
    if not batch.replace("-", "").replace("_", "").isalnum():
        raise ValueError("a batch is named by letters, digits, hyphens and underscores")
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        held = spark.read.schema(df.select(*keys).schema.add("batch", "string")).json(path).where(F.col("batch") < f"b{batch}").select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        df = df.join(held, same, "left_anti")
    first = df.groupBy(*keys).agg(F.min(F.struct(*df.columns)).alias("__r")).select("__r.*")
    first.write.mode("overwrite").json(f"{path.rstrip('/')}/batch=b{batch}")


def write_by_chain(df: DataFrame, path: str, chain: str = "chain") -> None:
    """A folder per chain in place of a file per row."""
    df.write.mode("overwrite").partitionBy(chain).parquet(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A Markdown table of an aggregate of at most ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows in a report")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " - |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def verify_manifest(now: DataFrame, then: DataFrame) -> DataFrame:
    """Files whose hash changed, went or came."""
    both = then.select("path", F.col("sha256").alias("was")).join(now.select("path", F.col("sha256").alias("is")), "path", "full")
    return both.where(~F.col("was").eqNullSafe(F.col("is")))


def remaining(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work that a table of completed keys doesn't list, to resume from."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def write_json_document(df: DataFrame, path: str, most: int = 100_000) -> None:
    """An aggregate of at most ``most`` rows as one JSON array in one file."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows in a document")
    rows = F.array_sort(F.collect_list(F.struct(*df.columns)))
    df.agg(F.to_json(rows).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_json_document(spark: SparkSession, path: str) -> list[dict]:
    return json.loads("".join(r.value for r in spark.read.text(path).collect()))  # one document


def write_hex_files(df: DataFrame, path: str, chain: str = "chain", address: str = "address", code: str = "code") -> DataFrame:
    """One file per row, ``<path>/<chain>/<address>.hex``: (chain, address, length) of those written.

    ``path`` is one that ``pyarrow.fs`` opens (local, HDFS, S3) and that all
    executors share. A file appears whole or not at all, so a repeated task
    writes the same again. Rows without chain, address or code are left out.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        made: set[str] = set()
        for batch in batches:
            for c, a, h in zip(*(x.to_pylist() for x in batch.columns)):
                if c not in made:
                    store.create_dir(f"{root}/{c}", recursive=True)
                    made.add(c)
                with store.open_output_stream(f"{root}/{c}/.{a}.part") as f:
                    f.write(h.encode())
                store.move(f"{root}/{c}/.{a}.part", f"{root}/{c}/{a}.hex")
            size = pa.array([len(h) for h in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), size], ["chain", "address", "length"])

    rows = df.select(F.col(chain).cast("string").alias("chain"), F.lower(address).alias("address"), F.col(code).cast("string").alias("code")).dropna()
    return rows.mapInArrow(of, "chain string, address string, length long")


def write_arrays(df: DataFrame, path: str, columns: list[str]) -> None:
    """Named array columns with their row's key columns as Parquet, in place of an array store."""
    df.select(*[c for c in df.columns if c not in columns], *columns).write.mode("overwrite").parquet(path)
