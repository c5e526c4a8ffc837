"""Items and documents that share an opening: what is found, and how many pairs are verified."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import decontaminate

VOCABULARY = [f"{a}{b}{c}" for a in "bcdfghjk" for b in "aeiou" for c in "lmnprstv"]


def prose(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def made(n, opening, seed=5):
    """Documents and items with one opening; every tenth document holds an item from its fifth word on."""
    rng = random.Random(seed)
    start = prose(rng, opening)
    items = [(i, " ".join(start + prose(rng, 30))) for i in range(n)]
    docs = []
    for d in range(n):
        words = start + [w + "x" for w in prose(rng, 60)]  # no word of an item's
        if d % 10 == 0:
            words = words[:30] + items[d][1].split()[4:] + words[30:]
        docs.append((d, " ".join(words)))
    return docs, items


def brute(docs, items):
    index = decontaminate.Index([i for i, _ in items], [t.encode() for _, t in items])
    return {(docs[k][0], items[item][0], n) for k, item, _, n, *_ in decontaminate._found(index, [t.encode() for _, t in docs])}


@pytest.mark.parametrize("opening", [12, 16])
def test_finds_equal_brute_force(spark, opening, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_ITEMS", 4)
    docs, items = made(60, opening)
    got = decontaminate.contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.matched) for r in got} == brute(docs, items)


def test_a_common_opening_verifies_few_pairs(spark, monkeypatch):
    docs, items = made(2000, 12)
    seen, candidates = [], decontaminate._candidates

    def counted(hits, windows):
        out = candidates(hits, windows).cache()
        seen.append(out.count())
        return out

    monkeypatch.setattr(decontaminate, "_candidates", counted)
    got = decontaminate.contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, d) for d in range(0, 2000, 10)}
    assert seen[0] <= 2000


def test_covered_tokens(spark):
    rng = np.random.default_rng(2)
    rows = [(sorted(rng.choice(40, int(rng.integers(1, 9)), replace=False).tolist()), int(rng.integers(1, 9))) for _ in range(80)]
    df = spark.createDataFrame(rows, "places array<long>, n long")
    for r in df.select("places", "n", decontaminate._runs(F.col("places"), F.col("n")).alias("x")).collect():
        covered = sorted({p + k for p in r.places for k in range(r.n)})
        runs = np.split(np.array(covered), np.flatnonzero(np.diff(covered) > 1) + 1)
        assert (r.x.longest, r.x.total) == (max(map(len, runs)), len(covered))
