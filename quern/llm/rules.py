"""Quality rules as a ledger of failure bits.

Each text is measured once and each rule evaluated once; the ledger keeps the
measurements and one bit per failed rule. A policy is a set of rules, a mask:
any version of it is applied to the ledger, and compared with others, without
the texts. What each rule takes away, alone or with others, is summed from the
counts of equal bit patterns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import CHUNK_BYTES, bounded_batches, unused

_GAP = re.compile(rb"[\x09-\x0d\x20]")
_BYTES = {"space": [32, *range(9, 14)], "symbol": list(b"#*$%&|<>"), "capital": list(range(65, 91)), "later": list(range(0x80, 0xC0))}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def _share(part: str, whole: str, percent: int) -> Column:
    """True where ``part`` is more than so many hundredths of ``whole``."""
    return F.col(part) * 100 > F.col(whole) * percent


def rules() -> dict[str, Column]:
    """The rules by name, true where a text fails; a rule's bit is its place here, so new ones go to the end."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        "few_words": n < 50,
        "repeated_words": _share("n_repeat_words", "n_words", 50),
        "symbols": _share("n_symbols", "n_words", 10),
        "word_length": (chars < n * 3) | (chars > n * 10),
        "repeated_lines": _share("n_dup_lines", "n_lines", 50),
        "capitals": _share("n_capitals", "word_chars", 30),
        "many_words": n > 1_000_000,
    }


BASE = ("few_words", "repeated_words")
#: Rules of each version of the policy.
POLICIES = {
    "v1": BASE,
    "v2": (*BASE, "symbols", "word_length", "repeated_lines"),
    "v3": (*BASE, "symbols", "word_length", "repeated_lines", "capitals"),
}


def mask(names: tuple[str, ...]) -> int:
    every = list(rules())
    return sum(1 << every.index(name) for name in names)


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in parts of about CHUNK_BYTES, cut at white space."""
    at = 0
    while at < len(text):
        cut = _GAP.search(text, at + CHUNK_BYTES)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def repeat_words(text: bytes) -> tuple[int, int]:
    """How many words a text has, and how many of them lie in a 3-word window found twice or more."""
    number: dict[bytes, int] = {}
    codes = [np.fromiter((number.setdefault(w, len(number)) for w in piece.split()), np.int64) for piece in _pieces(text)]
    w = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    if len(w) < 4:
        return len(w), 0
    pair = w[:-1] * len(number) + w[1:]
    if len(number) > 1 << 20:  # three numbers don't fit one code
        pair = np.unique(pair, return_inverse=True)[1]
    _, which, count = np.unique(pair[:-1] * len(number) + w[2:], return_inverse=True, return_counts=True)
    again = count[which] > 1
    inside = np.zeros(len(w), bool)
    for k in range(3):
        inside[k : len(w) - 2 + k] |= again
    return len(w), int(inside.sum())


def measured(text: bytes) -> tuple[int, ...]:
    """The MEASURES of a text."""
    n, again = repeat_words(text)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    space, symbols, capitals, later = (int(count[b].sum()) for b in _BYTES.values())
    lines = [x for x in text.split(b"\n") if x.strip()]
    return n, len(text) - later - space, symbols, len(lines) - len(set(lines)), again, len(lines), capitals


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text").cast(pa.large_binary())
        rows = [measured(text[i].as_py() or b"") for i in range(len(text))]
        columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(MEASURES))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", *MEASURES])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the measures, failed): one row for each row, with a bit for each rule that its whole text fails.

    Null texts count as empty: they have no words and fail ``few_words`` alone.
    Null and repeated ids stay, each row for itself. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_measure, f"id {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(rule, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, rule in enumerate(rules().values())]
    return out.withColumn("failed", sum(bits[1:], bits[0])).withColumnRenamed("id", id_col)


def fails(names: tuple[str, ...]) -> Column:
    """True where a row of a ledger fails one of the rules."""
    return F.col("failed").bitwiseAND(F.lit(mask(names))) != 0


def applied(entries: DataFrame, version: str) -> DataFrame:
    """A ledger with ``kept``: no rule of the policy's version fails."""
    return entries.withColumn("kept", ~fails(POLICIES[version]))


def patterns(entries: DataFrame, *by: str) -> DataFrame:
    """(by, failed, n): how many rows have each pattern of bits; at most two to the number of rules per group."""
    return entries.groupBy(*by, "failed").agg(F.count("*").alias("n"))


def ablations(entries: DataFrame, version: str, *by: str) -> DataFrame:
    """One row per rule of a version: (by, rule, n, failing, only, kept, kept_without).

    ``failing`` rows fail the rule, ``only`` that one of the version's rules, so
    they are what leaving it out gives back; ``kept`` and ``kept_without`` are
    the rows that stay with and without it. Counts come from the patterns. No
    rows give no ablation.
    """
    names = POLICIES[version]
    counts = patterns(entries, *by)
    n, rule, bit = (unused(counts, c) for c in ("__n", "rule", "__bit"))
    own = F.col("failed").bitwiseAND(F.lit(mask(names)))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(mask((r,))).cast("long").alias("b")) for r in names]))
    rows = counts.withColumnRenamed("n", n).withColumn(bit, each).select(*by, n, own.alias("__own"), F.col(bit)["r"].alias(rule), F.col(bit)["b"].alias("__b"))
    count = lambda c: F.sum(F.when(c, F.col(n)).otherwise(0))
    only, none = F.col("__own") == F.col("__b"), F.col("__own") == 0
    failing = F.col("__own").bitwiseAND(F.col("__b")) != 0
    return rows.groupBy(*by, rule).agg(F.sum(n).alias("n"), count(failing).alias("failing"), count(only).alias("only"), count(none).alias("kept"), count(none | only).alias("kept_without"))


def changes(entries: DataFrame, before: str, after: str) -> DataFrame:
    """(kept_before, kept_after, n, failed_any, failed_all) between two versions; the last two join the patterns' bits by or and by and."""
    own = patterns(entries).select("failed", "n", (~fails(POLICIES[before])).alias("kept_before"), (~fails(POLICIES[after])).alias("kept_after"))
    return own.groupBy("kept_before", "kept_after").agg(F.sum("n").alias("n"), F.bit_or("failed").alias("failed_any"), F.bit_and("failed").alias("failed_all"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (SELECT row, j, words[j] || ' ' || words[j + 1] || ' ' || words[j + 2] AS window3
  FROM (SELECT row, words, unnest(range(1, len(words) - 1)) AS j FROM w)),
again AS (SELECT row, j FROM (SELECT row, j, count(*) OVER (PARTITION BY row, window3) AS c FROM windows) WHERE c > 1),
places AS (SELECT row, count(DISTINCT p) AS n_repeat_words FROM (SELECT row, unnest([j, j + 1, j + 2]) AS p FROM again) GROUP BY row),
m AS (SELECT doc_id, len(words) AS n_words, coalesce(length(list_aggregate(words, 'string_agg', '')), 0) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines, len(regexp_extract_all(text, '[A-Z]')) AS n_capitals
  FROM w LEFT JOIN places USING (row))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * n_words OR word_chars < 3 * n_words OR word_chars > 10 * n_words
    OR 100 * n_dup_lines > 50 * n_lines OR 100 * n_capitals > 30 * word_chars) AS kept
FROM m
"""


def op13_rule_ledger(spark, sf_dir: str) -> DataFrame:
    """The ledger of all documents under the latest version of the policy."""
    out = applied(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), "v3")
    return out.select("doc_id", *MEASURES[:5], fails(BASE).alias("base_failed"), "kept")
