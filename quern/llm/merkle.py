"""Merkle manifest of a dataset, with a proof for each row.

Rows are leaves of one tree per group, in order; the groups' roots are leaves
of a last tree. Every ARITY consecutive nodes become one. Trees are cut into
aligned blocks of ARITY ** LEVELS nodes. Each block is traversed by one task in
the fractal way: it keeps one existing subtree for each layer of the block and
grows the subtree that the layer needs next by one leaf per step, so that it
emits the path of one leaf after the other. What lies above a block is proven
the same way from the blocks' roots, and appended to its paths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quern.llm.common import crc_mod
from quern.llm.places import placed
from quern.plans.materialize import materialize

ARITY = 8
#: Levels of a block, which one task traverses, and of each subtree in its stack.
LEVELS, SUBTREE = 3, 1
_STEP = pa.struct([("before", pa.string()), ("after", pa.string())])


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Growing:
    """A subtree that grows leaf by leaf: nodes of the levels from ``low`` to below ``top``, and its root.

    Below ``low`` only the open run of each level is held.
    """

    def __init__(self, low: int, top: int):
        self.low, self.top = low, top
        self.nodes: list[list[str]] = [[] for _ in range(top - low)]
        self.runs: list[list[str]] = [[] for _ in range(top)]
        self.root = ""

    def add(self, node: str, level: int = 0) -> None:
        while level < self.top:
            if level >= self.low:
                self.nodes[level - self.low].append(node)
            self.runs[level].append(node)
            if len(self.runs[level]) < ARITY:
                return
            node, self.runs[level] = digest(self.runs[level]), []
            level += 1
        self.root = node

    def close(self) -> None:
        """Open runs, which have fewer nodes, become nodes, too."""
        for level in range(self.top):
            if self.runs[level]:
                node, self.runs[level] = digest(self.runs[level]), []
                self.add(node, level + 1)


def traverse(leaves: list[str], levels: int, subtree: int = SUBTREE) -> Iterator[list[tuple[str, str]]]:
    """The authentication path of each leaf, in order: (siblings before, siblings after) of each level.

    A layer's existing subtree serves ARITY ** top leaves; meanwhile its desired
    one takes in the leaves that come next, one at each step. No more than two
    subtrees of each layer are held.
    """
    layers = [(low, min(low + subtree, levels)) for low in range(0, levels, subtree)]

    def grown(low: int, top: int, first: int) -> Growing:
        tree = Growing(low, top)
        for leaf in leaves[first : first + ARITY**top]:
            tree.add(leaf)
        tree.close()
        return tree

    stack = [grown(low, top, 0) for low, top in layers]
    desired = [Growing(low, top) for low, top in layers]
    for i in range(len(leaves)):
        path = []
        for k, (low, top) in enumerate(layers):
            size = ARITY**top
            if i and i % size == 0:
                stack[k], desired[k] = desired[k], Growing(low, top)
            for level in range(low, top):
                nodes, own = stack[k].nodes[level - low], i % size // ARITY**level
                run = own - own % ARITY
                path.append(("".join(nodes[run:own]), "".join(nodes[own + 1 : run + ARITY])))
            ahead = i + size
            if ahead < len(leaves):
                desired[k].add(leaves[ahead])
                if ahead == len(leaves) - 1:
                    desired[k].close()
        yield path


def height(n: int) -> int:
    """Levels between ``n`` leaves and their root; none for one leaf."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def _left(n: int, done: int) -> int:
    """Levels that a block has of a tree of n leaves, ``done`` being proven already."""
    return min(LEVELS, max(0, height(n) - done))


def _block_root(done: int):
    def of(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        tree = Growing(_left(table["n"][0].as_py(), done), _left(table["n"][0].as_py(), done))
        for node in table["digest"].to_pylist():
            tree.add(node)
        tree.close()
        return pa.table({"g": table["g"][:1], "idx": table["block"][:1], "digest": [tree.root], "n": table["n"][:1]})

    return of


def _block_paths(done: int, schema: pa.Schema):
    def of(nodes: pa.Table, upper: pa.Table) -> pa.Table:
        if not len(nodes):
            return schema.empty_table()
        nodes = nodes.sort_by("idx")
        over = upper["proof"][0].as_py()
        tail = [(s["before"], s["after"]) for s in over]
        before, after, at = [], [], [0]
        for path in traverse(nodes["digest"].to_pylist(), _left(nodes["n"][0].as_py(), done)):
            for b, a in path + tail:
                before.append(b)
                after.append(a)
            at.append(len(before))
        steps = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], fields=list(_STEP))
        new = {"proof": pa.ListArray.from_arrays(pa.array(at, pa.int32()), steps), "subroot": pa.array(upper["subroot"].to_pylist() * len(nodes), pa.string()), "root": pa.array(upper["root"].to_pylist() * len(nodes), pa.string())}
        return pa.table({c: new.get(c, nodes[c] if c in nodes.column_names else None) for c in schema.names}).cast(schema)

    return of


def _trees(rows: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Nodes of each round, from the leaves (g, idx, n, digest, ...) up, and the root of each group."""
    rounds = [materialize(rows, "nodes")]
    most = rounds[0].agg(F.max("n")).first()[0] or 0
    for k in range(max(1, -(-height(most) // LEVELS))):
        rounds[-1] = rounds[-1].withColumn("block", F.floor(F.col("idx") / ARITY**LEVELS))
        nodes = rounds[-1].select("g", "block", "idx", "n", "digest")
        roots = nodes.groupBy("g", "block").applyInArrow(_block_root(k * LEVELS), "g string, idx long, digest string, n long")
        rounds.append(materialize(roots, "roots"))
    return rounds[:-1], rounds[-1].select("g", "digest")


def _down(rounds: list[DataFrame], upper: DataFrame) -> DataFrame:
    """The leaves with their paths up to the last root; ``upper`` proves the root of each group (g, idx 0)."""
    for k in reversed(range(len(rounds))):
        nodes = rounds[k]
        have = [f for f in nodes.schema if f.name != "block"]
        schema = T.StructType([*have, T.StructField("proof", T.ArrayType(T.StructType([T.StructField("before", T.StringType()), T.StructField("after", T.StringType())]))), T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType())])
        paths = _block_paths(k * LEVELS, to_arrow_schema(schema))
        over = upper.select("g", F.col("idx").alias("block"), "proof", "subroot", "root")
        upper = nodes.groupBy("g", "block").cogroup(over.groupBy("g", "block")).applyInArrow(paths, schema)
        if k:
            upper = materialize(upper, "paths")
    return upper


def prove(rows: DataFrame, group: str, order: list[str], digest_col: str) -> DataFrame:
    """``rows`` with ``proof``, ``subroot`` and ``root``.

    Leaves are the digests (hex text) of ``digest_col``; each value of ``group``,
    null being one, has a tree of its own, in which leaves follow ``order``
    (nulls first, ties by the digest). The groups' roots, ordered by the group's
    bytes (null first), have a tree above. ``proof`` lists for each level from
    the leaf to the root the concatenated digests of its siblings ``before`` and
    ``after``; ``folded`` computes the root from it. Repeated rows are leaves
    each. An empty table gives no rows. Columns of ``rows`` may have any names.
    """
    names = {f"c{k}": c for k, c in enumerate(rows.columns)}
    own = rows.toDF(*names)
    at = {c: n for n, c in names.items()}
    # a text that orders as the group does, with null first
    g = F.coalesce(F.concat(F.lit("="), F.col(at[group]).cast("string")), F.lit("-")).alias("g")
    rounds, subroots = _trees(placed(own.select(*names, g, F.col(at[digest_col]).alias("digest")), [*(at[c] for c in order), "digest"]))
    tops = subroots.select(F.lit("").alias("g"), F.col("g").alias("of"), "digest")
    top_rounds, root = _trees(placed(tops, ["of"]))
    none = F.array().cast("array<struct<before:string,after:string>>")
    last = root.select("g", F.lit(0).cast("long").alias("idx"), none.alias("proof"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    proven = _down(top_rounds, last).select(F.col("of").alias("g"), F.lit(0).cast("long").alias("idx"), "proof", F.col("digest").alias("subroot"), "root")
    out = _down(rounds, materialize(proven, "subroots"))
    return out.select(*[F.col(n).alias(c) for n, c in names.items()], "proof", "subroot", "root")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def siblings_digest(proof: Column) -> Column:
    """Digest of all siblings, level by level and left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def leaf_digest(*values: Column) -> Column:
    """Digest of a row: each value as ``-`` if null, else its UTF-8 byte count, a colon and the value."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(part, values)), 256)


#: Each level of the trees, unrolled; nine levels hold 134 million leaves of a group.
_DEPTH = 9
_SQL_LEVELS = ",\n".join(
    f"""t{k + 1} AS MATERIALIZED (SELECT g, idx // 8 AS idx, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY idx)) ELSE any_value(digest) END AS digest, CAST(ceil(any_value(n) / 8.0) AS BIGINT) AS n
  FROM t{k} GROUP BY g, idx // 8)"""
    for k in range(_DEPTH)
)
_SQL_TOP = ",\n".join(
    f"""u{k + 1} AS MATERIALIZED (SELECT idx // 8 AS idx, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY idx)) ELSE any_value(digest) END AS digest, CAST(ceil(any_value(n) / 8.0) AS BIGINT) AS n
  FROM u{k} GROUP BY idx // 8)"""
    for k in range(3)
)


def _sql_sides(level: str, k: int, group: str) -> str:
    """Joined siblings of level k, before and after the node of a leaf; none where the tree has ended."""
    eight = 8**k
    side = "(SELECT {how} FROM {t} s WHERE {on} s.n > 1 AND s.idx // 8 = p.{i} // {e8} AND s.idx {op} p.{i} // {e})"
    at = "idx" if group else "top_idx"
    on = "s.g = p.g AND" if group else ""
    one = lambda op: "coalesce(" + side.format(how="string_agg(s.digest, '' ORDER BY s.idx)", t=level, on=on, i=at, e8=eight * 8, e=eight, op=op) + ", '')"
    return f"{one('<')} AS b_{level}, {one('>')} AS a_{level}, (SELECT max(n) > 1 FROM {level} s{' WHERE s.g = p.g' if group else ''}) AS m_{level}"


_STEPS = [f"t{k}" for k in range(_DEPTH)] + [f"u{k}" for k in range(3)]


def _sql_fold() -> str:
    node, parts = "tampered", []
    for k, level in enumerate(_STEPS):
        parts.append(f"f{k} AS (SELECT *, CASE WHEN m_{level} THEN sha256(b_{level} || {node} || a_{level}) ELSE {node} END AS node_{k} FROM {f'f{k - 1}' if k else 'sides'})")
        node = f"node_{k}"
    return ",\n".join(parts)


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, lang, coalesce('=' || lang, '-') AS g, text, concat(
      coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'),
      coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'),
      coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head,
    xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)),
      lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 3 = 0 AS chosen
  FROM documents),
leaves AS MATERIALIZED (
  SELECT doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(text) || ':' || CASE WHEN chosen THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS tampered
  FROM d),
t0 AS MATERIALIZED (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, leaf AS digest, count(*) OVER (PARTITION BY g) AS n, doc_id, tampered FROM leaves),
{_SQL_LEVELS},
u0 AS MATERIALIZED (SELECT g, row_number() OVER (ORDER BY g) - 1 AS idx, digest, count(*) OVER () AS n FROM t{_DEPTH}),
{_SQL_TOP},
p AS (SELECT t0.*, u0.idx AS top_idx, u0.digest AS subroot, (SELECT digest FROM u3) AS root FROM t0 JOIN u0 USING (g)),
sides AS (SELECT *, {", ".join([_sql_sides(f"t{k}", k, "g") for k in range(_DEPTH)] + [_sql_sides(f"u{k}", k, "") for k in range(3)])} FROM p),
{_sql_fold()}
SELECT doc_id, digest AS leaf, subroot, root, sha256(concat({", ".join(f"b_{s}, a_{s}" for s in _STEPS)})) AS proof_sha256,
  node_{len(_STEPS) - 1} AS folded_root, node_{len(_STEPS) - 1} = root AS verified
FROM f{len(_STEPS) - 1}
"""


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """A proof for each document, and what a tampered one's leaf folds to with it.

    Where 3 divides crc32(doc_id), the tampered text has its A-Z in lower case;
    a null id is never chosen.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fixed = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lower = F.when(F.coalesce(crc_mod(F.col("doc_id"), 3) == 0, F.lit(False)), F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    rows = docs.select("doc_id", "lang", leaf_digest(*fixed, F.col("text")).alias("leaf"), leaf_digest(*fixed, lower).alias("tampered"))
    out = prove(rows, "lang", ["doc_id"], "leaf")
    out = out.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("proof")).alias("proof_sha256"), folded(F.col("tampered"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
