"""Trees and proofs against a plain recursion, with small and hostile tables."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quern.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """Root and each leaf's path, by the definition."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = i // 8 * 8
            paths[leaf].append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 8])))
        nodes = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        at = [i // 8 for i in at]
    return nodes[0], paths


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 73, 511, 512])
@pytest.mark.parametrize("subtree", [1, 2, 3])
def test_traversal_emits_every_path(n, subtree):
    leaves = [h(str(i)) for i in range(n)]
    assert list(merkle.traverse(leaves, merkle.height(n), subtree)) == tree(leaves)[1]


def test_traversal_of_a_last_block_goes_to_the_block_root():
    leaves = [h(str(i)) for i in range(70)]
    assert len(next(merkle.traverse(leaves, 3))) == 3


def test_open_runs_below_a_subtree_are_all_that_it_holds():
    grown = merkle.Growing(2, 3)
    for i in range(500):
        grown.add(h(str(i)))
        assert sum(map(len, grown.runs)) <= 3 * 7 and sum(map(len, grown.nodes)) <= 8


def brute(rows):
    """rows of (doc_id, text, lang, source, n_chars) -> rows of the query."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for i, t, lang, s, n in rows:
        u = t.translate(lower) if t is not None and i is not None and zlib.crc32(str(i).encode()) % 3 == 0 else t
        leaf, tampered = (h(part(i), part(s), part(lang), part(n), part(x)) for x in (t, u))
        groups.setdefault(lang, []).append((i, leaf, tampered))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    own = {g: tree([r[1] for r in groups[g]]) for g in order}
    root, above = tree([own[g][0] for g in order]) if order else (None, [])
    out = []
    for k, g in enumerate(order):
        for (i, leaf, tampered), path in zip(groups[g], own[g][1]):
            node = tampered
            for b, a in path + above[k]:
                node = h(b, node, a)
            out.append((i, leaf, own[g][0], root, h(*[b + a for b, a in path + above[k]]), node, node == root))
    return out


def query(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("g", "idx", "n", "digest", "leaf", "proof", "c0")}).write.parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in merkle.op11_merkle_manifest(spark, str(tmp_path)).collect()]


def by_all(rows):
    return sorted(rows, key=repr)


def test_hostile_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, "A", None, None, 1), (1, "Ä É", "é", "s", 3), (1, "Ä É", "é", "s", 3), (1, "B", "é", "s", 3), (2, "", "", "", 0), (3, "X" * 100_000, "-", "=", None), (-5, "日本", "=", "s", 2)]
    assert by_all(query(spark, tmp_path, rows)) == by_all(brute(rows))


def test_a_hot_group_of_several_blocks_and_many_groups(spark, tmp_path):
    rows = [(i, f"Text {i % 50}", "en", "s", i) for i in range(1300)] + [(5000 + i, "T", f"l{i:03d}", None, i) for i in range(70)]
    assert by_all(query(spark, tmp_path, rows)) == by_all(brute(rows))


def test_no_rows(spark, tmp_path):
    assert query(spark, tmp_path, []) == []


def test_documents_and_a_changed_leaf(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = [tuple(r) for r in merkle.op11_merkle_manifest(spark, sf).collect()]
    assert by_all(got) == by_all(brute(rows))
    assert {r[6] for r in got} == {True, False}
