"""Prefix trie of conversations, with totals of each subtree.

A prefix is known by the sum of its turns' digests, each bound to its place, so
the keys of all prefixes are running sums, which any number of tasks can share,
however long a conversation is. Nodes are groups of equal keys.

Totals rise from the leaves: a node holds a counter of the children that are
left, and one whose counter is zero sends its totals to its parent. Nodes that
wait for one child only would pass on what that child sends; such chains are
left out at once, by doubling, and filled in from their last node's totals in
the end. So the rounds grow with the logarithm of the number of nodes, and not
with the longest conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import crc_mod, spread_join
from quern.llm.places import placed
from quern.operators.ranges import running
from quern.plans.materialize import materialize

#: Parts of a digest, 32 bits each; their sums stay exact for 2 ** 31 turns.
_PARTS = 4
_P, _S, _Q = ([f"{x}{k}" for k in range(_PARTS)] for x in "psq")
_WORD = r"[^\x20\x09-\x0D]+"
#: Ids that are joined to one text, at most, before a node's ids are digested.
_IDS = 4096


def _parts(hex_text: Column) -> list[Column]:
    return [F.conv(F.substring(hex_text, 8 * k + 1, 8), 16, 10).cast("long").alias(name) for k, name in enumerate(_P)]


def turns(conversations: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(g, idx, n, content, words): turns of each conversation g in order, idx from 0, n being its length.

    ``content`` is a digest of role and text. Null turn numbers come first, equal
    ones follow the digest; a null role or text is empty. Repeated rows are turns
    each. Rows without a conversation id belong to none and are left out. Other
    columns are ignored.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    content = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where(F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("g"), F.col(order_col).alias("at"), content.alias("content"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"))
    return placed(rows, ["at", "content"]).drop("at")


def branched(own: DataFrame, most: int = 4, family: int = 20) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first of their family: (c, d, content, words) and (c, n).

    Conversation c takes the first h turns of c - c % ``family`` (all if fewer,
    none if it is absent), then its own after its first h, where h is crc32 of
    its decimal id modulo ``most``. ``d`` is a turn's place from 1, ``n`` a
    conversation's length, which may be zero.
    """
    own = materialize(own, "turns")
    first = own.where(F.col("g") % family == 0).where(F.col("idx") < most - 1)
    heads = first.groupBy(F.col("g").alias("base")).agg(F.array_sort(F.collect_list(F.struct("idx", "content", "words"))).alias("head"))  # most - 1 turns at most
    convs = own.where("idx = 0").select(F.col("g").alias("c"), F.col("n").alias("own_n"), crc_mod(F.col("g"), most).cast("long").alias("h"), (F.col("g") - F.col("g") % family).alias("base"))
    convs = convs.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("h").cast("int")))
    convs = materialize(convs.withColumn("taken", F.size("head").cast("long")), "conversations")
    begun = convs.select("c", F.explode("head").alias("t")).select("c", (F.col("t.idx") + 1).alias("d"), "t.content", "t.words")
    rest = spread_join(own.withColumnRenamed("g", "c").drop("n"), convs.select("c", "own_n", "h", "taken"), ["c"], "own_n")
    rest = rest.where("idx >= h").select("c", (F.col("taken") + F.col("idx") - F.col("h") + 1).alias("d"), "content", "words")
    return begun.unionByName(rest), convs.select("c", (F.col("taken") + F.greatest(F.col("own_n") - F.col("h"), F.lit(0))).alias("n"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (d, key, c) -> (d, key, first c, ids in one text); at most _IDS of a node together."""
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(1 + _PARTS))))
        ids, out, i = batch.column(1 + _PARTS).to_pylist(), [], 0
        while i < len(ids):
            j = i + 1
            while j < min(len(ids), i + _IDS) and keys[j] == keys[i]:
                j += 1
            out.append((*keys[i], ids[i], ",".join(map(str, ids[i:j]))))
            i = j
        names = ["d", *_S, "first", "ids"]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if n == "ids" else pa.int64()) for n, x in zip(names, zip(*out))] if out else [pa.array([], pa.string() if n == "ids" else pa.int64()) for n in names], names)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of ``_joined`` -> (d, key, ends_sha256); the digest of a node goes on from batch to batch."""
    names = ["d", *_S, "ends_sha256"]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if n == "ends_sha256" else pa.int64()) for n, x in zip(names, zip(*rows))], names)

    key, state = None, None
    for batch in batches:
        out = []
        for *own, ids in zip(*(batch.column(k).to_pylist() for k in (*range(1 + _PARTS), 2 + _PARTS))):
            if own == key:
                state.update(b",")
            else:
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = own, hashlib.sha256()
            state.update(ids.encode())
        if out:
            yield batch_of(out)
    if key:
        yield batch_of([(*key, state.hexdigest())])


def ends(last: DataFrame) -> DataFrame:
    """(d, key, ends_sha256): digest of the ids that end at each node, in order, from (d, key, c).

    A node may have any number of ids: they are dealt by ranges, joined there, and
    digested piece by piece.
    """
    key = ["d", *_S]
    longs = ", ".join(f"{k} long" for k in key)
    pieces = last.select(*key, "c").repartitionByRange(*key, "c").sortWithinPartitions(*key, "c").mapInArrow(_joined, f"{longs}, first long, ids string")
    return pieces.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(_digested, f"{longs}, ends_sha256 string")


def subtree_totals(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(c, d, values): sums of the values over each node's subtree, from (c, d, pc, left, values).

    A node is (c, d), its parent (pc, d - 1), null for the root; ``left`` is its
    number of children. The nodes must be those of one or several trees.
    """
    more = [_more(v) for v in values]
    active = nodes.select("c", "d", "pc", (F.col("d") - 1).alias("pd"), "left", *values, *[F.lit(0).cast("long").alias(m) for m in more])
    active = materialize(active, "active")
    done, waiting = [], []
    while not active.isEmpty():
        complete = materialize(active.where("left = 0"), "complete")
        done.append(complete.select("c", "d", *values))
        sent = complete.where("pc is not null").groupBy(F.col("pc").alias("c"), F.col("pd").alias("d")).agg(F.count("*").alias("__n"), *[F.sum(F.col(v) + F.col(_more(v))).alias(f"__{v}") for v in values])
        got = active.where("left > 0").join(sent, ["c", "d"], "left")
        got = got.select("c", "d", "pc", "pd", (F.col("left") - F.coalesce("__n", F.lit(0))).alias("left"), *[(F.col(v) + F.coalesce(f"__{v}", F.lit(0))).alias(v) for v in values], *more)
        active, chains = _without_chains(materialize(got, "active"), values)
        if chains is not None:
            waiting.append(chains)
    total = _union(done) if done else nodes.select("c", "d", *values)
    for chain in reversed(waiting):
        count = chain.groupBy("rc", "rd").agg(F.count("*").alias("__n"))
        last = count.join(total.toDF("rc", "rd", *[f"__{v}" for v in values]), ["rc", "rd"])
        own = spread_join(chain, last, ["rc", "rd"], "__n", counts=count)
        total = total.unionByName(materialize(own.select("c", "d", *[(F.col(v) + F.col(f"__{v}")).alias(v) for v in values]), "totals"))
    return total


def _more(value: str) -> str:
    """What a node adds to its total when it sends it: that of the chain which was left out above it."""
    return f"{value}_above"


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _without_chains(active: DataFrame, values: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """``active`` without the nodes that wait for one child, and those nodes (c, d, rc, rd, values).

    (rc, rd) is the first node below that does not wait for one child alone, and
    the values are what its total lacks of the node's. It takes the parent of the
    chain's first node for its own, and sends what the chain adds.
    """
    more = [_more(v) for v in values]
    one = active.where("left = 1")
    below = active.where("pc is not null").select(F.col("pc").alias("c"), F.col("pd").alias("d"), F.col("c").alias("rc"), F.col("d").alias("rd"), (F.col("left") == 1).alias("open"), *[F.col(m).alias(f"__{m}") for m in more])
    chain = one.join(below, ["c", "d"]).select("c", "d", "pc", "pd", *more, *[(F.col(v) + F.col(f"__{_more(v)}")).alias(v) for v in values], "rc", "rd", "open")
    chain = materialize(chain, "chain")
    if chain.isEmpty():
        return active, None
    closed = []
    while True:
        closed.append(chain.where("not open"))
        rows = chain.where("open")
        if rows.isEmpty():
            break
        # a node that is referred to is in the chain, and no two rows refer to the same
        to = _union([*closed, rows]).select(F.col("c").alias("rc"), F.col("d").alias("rd"), F.col("rc").alias("__rc"), F.col("rd").alias("__rd"), F.col("open").alias("__open"), *[F.col(v).alias(f"__{v}") for v in values])
        rows = rows.drop("open").join(to, ["rc", "rd"])
        chain = materialize(rows.select("c", "d", "pc", "pd", *more, *[(F.col(v) + F.col(f"__{v}")).alias(v) for v in values], F.col("__rc").alias("rc"), F.col("__rd").alias("rd"), F.col("__open").alias("open")), "chain")
    chains = _union(closed).drop("open")
    first = F.min_by(F.struct("pc", "pd", *[(F.col(v) + F.col(_more(v))).alias(v) for v in values]), "d")
    top = chains.groupBy(F.col("rc").alias("c"), F.col("rd").alias("d")).agg(first.alias("__top"))
    rest, none = active.where("left != 1").join(top, ["c", "d"], "left"), F.col("__top").isNull()
    rest = rest.select("c", "d", *[F.when(none, F.col(k)).otherwise(F.col(f"__top.{k}")).alias(k) for k in ("pc", "pd")], "left", *values, *[F.when(none, F.col(_more(v))).otherwise(F.col(f"__top.{v}")).alias(_more(v)) for v in values])
    return materialize(rest, "active"), chains.select("c", "d", "rc", "rd", *values)


def prefix_trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the trie of all conversations, one row each; the root is that of depth 0.

    ``rows`` has (c, d, content, words) for each turn, d from 1 without gaps, and
    ``convs`` (c, n) for each conversation and its length. Returns conv_id (the
    smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256 and words (of the node's last turn). Conversations
    without turns are members of the root alone. No conversation gives no node.
    """
    key = ["d", *_S]
    bound = F.sha2(F.concat(F.col("d").cast("string"), F.lit(":"), F.col("content")), 256)
    sums = running(rows.withColumn("__b", bound).select("c", "d", "words", *_parts(F.col("__b"))), [("d", False)], dict(zip(_S, [(p, "sum") for p in _P])), ("c",))
    sums = materialize(sums, "prefixes")
    parents = [(F.col(s) - F.col(p)).alias(q) for s, p, q in zip(_S, _P, _Q)]
    nodes = sums.select("c", *key, "words", *parents).groupBy(*key).agg(F.min("c").alias("c"), F.count("*").alias("n_convs"), F.max("words").alias("words"), *[F.min(q).alias(q) for q in _Q])
    zero = [F.lit(0).cast("long")]
    root = convs.agg(F.min("c").alias("c"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(*[zero[0].alias(k) for k in key], "c", "n_convs", zero[0].alias("words"), *[F.lit(None).cast("long").alias(q) for q in _Q])
    nodes = materialize(nodes.unionByName(root), "nodes")

    children = materialize(nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), *[F.col(q).alias(s) for q, s in zip(_Q, _S)]).agg(F.count("*").alias("n_children")), "children")
    nodes = materialize(nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    over = nodes.where("n_children > 0").select(F.col("d").alias("__pd"), *[F.col(s).alias(q) for s, q in zip(_S, _Q)], F.col("c").alias("pc"), F.col("n_children").alias("__n"))
    below = spread_join(nodes.where("d > 0").withColumn("__pd", F.col("d") - 1), over, ["__pd", *_Q], "__n").drop("__pd", "__n")
    nodes = materialize(below.unionByName(nodes.where("d = 0").withColumn("pc", F.lit(None).cast("long"))), "nodes")

    own = nodes.select("c", "d", "pc", F.col("n_children").alias("left"), (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    totals = subtree_totals(own, ["n_leaves", "saved_tokens"])

    length = convs.select("c", F.col("n").alias("d"))
    last = sums.join(length, ["c", "d"], "left_semi").select(*key, "c").unionByName(length.where("d = 0").select(*[zero[0].alias(k) for k in key], "c"))
    out = nodes.join(ends(last), key, "left").join(totals, ["c", "d"])
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("pc").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"), "words")


ORACLE_SQL = r"""
WITH own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS r,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, count(*) AS n, c - c % 20 AS base, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)),
      lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 4 AS h
  FROM own GROUP BY c),
taken AS (SELECT x.*, least(x.h, coalesce(y.n, 0)) AS m FROM convs x LEFT JOIN convs y ON y.c = x.base),
rebuilt AS (
  SELECT t.c, o.r AS d, o.role, o.text FROM taken t JOIN own o ON o.c = t.base AND o.r <= t.h
  UNION ALL SELECT t.c, t.m + o.r - t.h, o.role, o.text FROM taken t JOIN own o ON o.c = t.c AND o.r > t.h
  UNION ALL SELECT c, 0, '', '' FROM taken),
prefixes AS (
  SELECT c, d, CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS words,
    sha256(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY d)) AS prefix, max(d) OVER (PARTITION BY c) AS length
  FROM rebuilt),
nodes AS (
  SELECT d, prefix, min(c) AS c, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = length), '')) AS ends_sha256
  FROM prefixes GROUP BY d, prefix),
member AS (SELECT p.c AS conv, p.d, n.c, n.saved FROM prefixes p JOIN nodes n USING (d, prefix)),
linked AS (SELECT n.*, m.c AS pc FROM nodes n LEFT JOIN member m ON m.conv = n.c AND m.d = n.d - 1),
children AS (SELECT pc AS c, d - 1 AS d, count(*) AS n_children FROM linked WHERE d > 0 GROUP BY pc, d),
above AS (
  SELECT m.c, m.d, sum(n.saved) AS saved_tokens, sum(CASE WHEN k.n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves
  FROM linked n LEFT JOIN children k ON k.c = n.c AND k.d = n.d JOIN member m ON m.conv = n.c AND m.d <= n.d GROUP BY m.c, m.d)
SELECT n.c AS conv_id, CAST(n.d AS BIGINT) AS depth, n.pc AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
  CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM linked n LEFT JOIN children k ON k.c = n.c AND k.d = n.d JOIN above a ON a.c = n.c AND a.d = n.d
"""


def op12_conversation_trie(spark, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all conversations, each begun as the first of its twenty."""
    rows, convs = branched(turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return prefix_trie(rows, convs).drop("words")
