"""The trie against a plain one built from whole prefixes, and totals against random trees."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quern.llm import trie


def rebuilt(rows):
    """rows of (conv_id, turn, role, text) -> turns of each conversation as the query begins it."""
    own = {}
    for c, at, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((at, role or "", text or ""))
    for c, ts in own.items():
        digest = lambda t: hashlib.sha256(f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()).hexdigest()
        ts.sort(key=lambda t: (t[0] is not None, t[0] or 0, digest(t)))
        own[c] = [t[1:] for t in ts]
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    base = {c: c - (c % 20 if c >= 0 else -(-c % 20)) for c in own}
    return {c: own.get(base[c], [])[: h[c]] + own[c][h[c] :] for c in own}


def brute(rows):
    convs, nodes = rebuilt(rows), {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for p, members in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        kids = {q for q in under if len(q) == len(p) + 1}
        leaves = sum(1 for q in under if not any(r != q and r[: len(q)] == q for r in under))
        saved = sum((len(nodes[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in under if q)
        ending = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids), leaves, saved, hashlib.sha256(ending.encode()).hexdigest()))
    return sorted(out, key=repr)


def query(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    docs.withColumns({c: F.lit("x") for c in ("c", "d", "g", "idx", "n", "h", "words", "p0", "s0", "left", "content")}).write.parquet(f"{tmp_path}/conversations.parquet")
    return sorted((tuple(r) for r in trie.op12_conversation_trie(spark, str(tmp_path)).collect()), key=repr)


def test_hostile_rows(spark, tmp_path):
    rows = [
        (0, None, None, None), (0, 0, "user", "hello there"), (0, 0, "user", "hello there"), (0, 0, "bot", ""), (0, 5, "user", "x" * 50_000 + " y"),
        (1, 0, "user", "hi"), (2, 1, "user", None), (3, 0, "u", "a\tb\x0bc d"), (4, 0, "ser", "b"), (5, 0, "", "ser1:b"), (21, 3, "user", "alone"),
        (None, 0, "user", "nobody"), (-3, 0, "user", "below"), (-3, 1, "user", "zero"), (-21, 1, "user", "q"), (40, 0, "1", "1:1"), (41, 0, "", "11:1"),
    ]
    assert query(spark, tmp_path, rows) == brute(rows)


def test_copies_and_a_shared_first_turn(spark, tmp_path):
    rows = [(c, t, "user", f"turn {t}") for c in range(60) for t in range(3)] + [(100 + c, t, "user", f"turn {t if t < 2 else c % 3}") for c in range(40) for t in range(4)]
    assert query(spark, tmp_path, rows) == brute(rows)


def test_no_rows(spark, tmp_path):
    assert query(spark, tmp_path, []) == []


def test_documents_of_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in trie.op12_conversation_trie(spark, sf).collect()), key=repr) == brute(rows)


def test_a_node_with_more_ends_than_one_text_holds(spark, monkeypatch):
    monkeypatch.setattr(trie, "_IDS", 3)
    ids = sorted(random.Random(1).sample(range(10_000), 500))
    last = spark.createDataFrame([(1, 5, 0, 0, 0, c) for c in ids] + [(1, 6, 0, 0, 0, 7), (0, 0, 0, 0, 0, 8)], "d long, s0 long, s1 long, s2 long, s3 long, c long")
    got = {(r.d, r.s0): r.ends_sha256 for r in trie.ends(last).collect()}
    text = {(1, 5): ",".join(map(str, ids)), (1, 6): "7", (0, 0): "8"}
    assert got == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in text.items()}


def shaped(kind, n, seed):
    """Parents of the nodes of a tree."""
    rng = random.Random(seed)
    if kind == "chain":
        return [None, *range(n - 1)]
    if kind == "caterpillar":  # each second node is a leaf beside the way down
        return [None, *[max(0, 2 * ((i - 1) // 2) - 1) if i > 2 else 0 for i in range(1, n)]]
    if kind == "star":
        return [None] + [0] * (n - 1)
    return [None] + [max(0, i - 1 - min(int(rng.expovariate(0.7)), i - 1)) for i in range(1, n)]


@pytest.mark.parametrize("kind", ["chain", "caterpillar", "star", "random"])
def test_totals_of_a_tree(spark, kind, monkeypatch):
    n = 300
    parent = shaped(kind, n, 3)
    depth = [0] * n
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1
    value = [random.Random(i).randrange(100) for i in range(n)]
    total, kids = list(value), [0] * n
    for i in reversed(range(1, n)):
        total[parent[i]] += total[i]
        kids[parent[i]] += 1
    nodes = spark.createDataFrame([(i, depth[i], parent[i], kids[i], value[i]) for i in range(n)], "c long, d long, pc long, left long, v long")
    rounds, cut = [0], trie._without_chains

    def counted(*args):
        rounds[0] += 1
        return cut(*args)

    monkeypatch.setattr(trie, "_without_chains", counted)
    got = {(r.c, r.d): r.v for r in trie.subtree_totals(nodes, ["v"]).collect()}
    assert got == {(i, depth[i]): total[i] for i in range(n)}
    assert rounds[0] <= 8
