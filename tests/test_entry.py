import os
import shutil
import subprocess
import sys

import __spark_entry__
from tests.conftest import ROOT


def test_entry(spark, sf):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["content_hash", "members", "n_sources", "n_langs"] and df.count() > 0


def test_oracles_have_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_optional_package(tmp_path):
    """The registry imports where the corpus operators were deleted."""
    shutil.copytree(os.path.join(ROOT, "quern"), tmp_path / "quern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)


def test_streaming_counts_equal_batch(spark, sf, tmp_path):
    from quern.streaming.windows import sessions, windowed_counts

    batch = spark.read.parquet(f"{sf}/events.parquet")
    os.makedirs(tmp_path / "in")
    os.symlink(f"{sf}/events.parquet", tmp_path / "in" / "events.parquet")
    stream = spark.readStream.schema(batch.schema).parquet(f"file://{tmp_path}/in")
    q = windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    try:
        q.processAllAvailable()
        got = sorted((r.start, r.event_type, r.n) for r in spark.table("counts").collect())
    finally:
        q.stop()
    assert got == sorted((r.start, r.event_type, r.n) for r in windowed_counts(batch).collect())
    assert sessions(batch).agg({"n": "sum"}).first()[0] == batch.count()
