"""Near duplicates: sets with a common line don't meet pair by pair, and similar sets always share a prefix."""

import random

import numpy as np

from quern.llm import near_dedup


def test_common_line_gives_no_pairs_of_all(spark, monkeypatch):
    """Each of 300 short texts has one line and words of its own; two of them are near duplicates."""
    rng, compared = random.Random(1), []
    line = " ".join(f"c{k}" for k in range(14))
    rows = [(k, line + "\n" + " ".join(f"w{rng.randrange(10**9)}" for _ in range(10))) for k in range(300)]
    rows.append((300, rows[7][1] + " more"))
    verified = near_dedup._verified

    def counted(pairs, *args):
        compared.append(pairs.count())
        return verified(pairs, *args)

    monkeypatch.setattr(near_dedup, "_verified", counted)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    assert got == {k: 7 if k == 300 else k for k in range(301)}
    assert sum(compared) <= 2 * len(rows), compared


def test_similar_sets_share_a_prefix():
    rng = np.random.default_rng(2)
    for size in (1, 2, 3, 5, 9, 10, 40, 200):
        for _ in range(50):
            a = np.unique(rng.integers(0, 10**6, size).astype(np.uint64))
            drop = rng.permutation(len(a))[: rng.integers(0, len(a) // 5 + 1)]
            b = np.unique(np.concatenate([np.delete(a, drop), rng.integers(0, 10**6, rng.integers(0, size // 5 + 1)).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            common = np.unique(rng.choice(a, len(a) // 2)) if len(a) > 1 else a[:0]
            often = rng.integers(2, 9, len(common))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                assert len(np.intersect1d(near_dedup.prefix(a, 80, common, often), near_dedup.prefix(b, 80, common, often)))


def test_edited_copies_of_one_text_do_not_meet_by_its_shingles(spark):
    """Sets of 100 shingles of which 30 are their own and come first: the 70 common ones are no reason to compare; 95 are."""
    own = lambda g, rep, at: (g, rep, rep, 100, at)
    rows = [own(g, rep, 18 + g) for rep in range(200) for g in range(3)]
    rows += [own(9, rep, 5) for rep in (300, 301)]
    first = spark.createDataFrame(rows, "g long, rep long, component long, n long, at long")
    assert [(r.rep1, r.rep2, r.n, r.rest) for r in near_dedup._meetings(first, 80).collect()] == [(301, 300, 200, 95)]
