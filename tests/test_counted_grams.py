"""TF-IDF terms: grams are counted in buckets first, and only those that may be kept by themselves."""

import random
from collections import Counter

from pyspark.sql import functions as F

from quern.functions import features


def _docs(spark, n=400):
    rng = random.Random(3)
    rows = [(k, [rng.choice("abcde") if rng.random() < 0.3 else f"w{rng.randrange(10**9)}" for _ in range(40)]) for k in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, ["a"])]
    return rows, spark.createDataFrame(rows, "id long, t array<string>")


def _counts(tokens):
    return Counter(" ".join(tokens[i : i + k]) for k in range(1, 5) for i in range(len(tokens) - k + 1))


def test_terms_and_vectors_by_brute_force(spark):
    rows, df = _docs(spark)
    own = {i: _counts(t or []) for i, t in rows}
    n, having = Counter(), Counter()
    for c in own.values():
        n.update(c)
        having.update(c.keys())
    for vocab in (4, 20, 20_000):
        terms = features.tfidf_terms(df, "id", F.col("t"), vocab=vocab)
        assert {r.gram for r in terms.collect()} == set(sorted((g for g in n if having[g] >= 3), key=lambda g: (-n[g], g))[:vocab])
        idf = {r.gram: r.idf for r in terms.collect()}
        got = {r.id: [(t.gram, t.weight) for t in r.terms] for r in features.tfidf_vectors(df, terms, "id", F.col("t")).collect()}
        want = {i: {g: c[g] * idf[g] for g in sorted(c) if g in idf} for i, c in own.items()}
        assert {i: [g for g, _ in t] for i, t in got.items()} == {i: list(w) for i, w in want.items() if w}
        for i, t in got.items():
            norm = sum(x * x for x in want[i].values()) ** 0.5
            assert all(abs(w - want[i][g] / norm) < 1e-12 for g, w in t)


def test_rare_grams_are_not_counted_by_themselves(spark, monkeypatch):
    _, df = _docs(spark)
    counted, of = [], features._counted_grams

    def watched(*args):
        out = of(*args)
        counted.append(out.count())
        return out

    monkeypatch.setattr(features, "_counted_grams", watched)
    features.tfidf_terms(df, "id", F.col("t"), vocab=5).collect()
    assert max(counted) < 2000, counted  # of some 50,000 different ones
