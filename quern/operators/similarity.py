"""Near-duplicate families: deterministic MinHash, exact banding, components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.batches import bounded_batches
from quern.functions.features import token_chunks
from quern.operators.graph import connected_components
from quern.operators.ranges import ranked
from quern.plans.materialize import materialize
from quern.schemas import kind

#: Positions of a signature.
POSITIONS = 128
#: Members of a band that are compared pair by pair at once, those that still are when components are known,
#: and rows of a lot of what stays hot.
FEW, HOT, LOT = 8, 64, 256


#: Grams whose hashes a task holds at once.
CACHED = 1 << 18


def _blake(data: bytes, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")


def salts(n: int) -> np.ndarray:
    """Fixed 64-bit salts of the positions: blake2b under seed 1 of the position's four little-endian bytes."""
    return np.array([_blake(k.to_bytes(4, "little"), 1) for k in range(n)], np.uint64)


def _distinct_grams(size: np.ndarray, codes: np.ndarray, tokens: list[str], k: int) -> tuple[np.ndarray, list[str]]:
    """Place of each k-gram within a row among the distinct ones, and these."""
    ids = codes = codes.astype(np.int64)
    for step in range(1, k):  # numbers of shorter grams stay below the number of tokens, so pairs don't overflow
        ids = np.unique(ids[:-1] * len(tokens) + codes[step:], return_inverse=True)[1] if len(ids) > 1 else ids[:0]
    left = np.repeat(np.cumsum(size), size) - np.arange(len(codes))
    at = np.flatnonzero(left >= k)
    _, first, which = np.unique(ids[at], return_index=True, return_inverse=True)
    return which, [" ".join(tokens[c] for c in codes[i : i + k].tolist()) for i in at[first].tolist()]


def token_signature(df: DataFrame, id_col: str, ops: Column, k: int = 4, positions: int = POSITIONS) -> DataFrame:
    """(id, sig): of each position, the smallest of the grams' hashes xor the position's salt.

    A gram's hash is its 64-bit blake2b under seed 0; the smallest is taken of
    unsigned numbers, which are kept as longs of the same bits. Few different
    grams make up most sequences, so a task hashes each once for the rows that it holds at
    once, and keeps the hashes of about CACHED. A null sequence counts as empty.
    """
    salt = salts(positions)

    def hashed(own: list[str], known: dict[str, int]) -> np.ndarray:
        if len(known) > CACHED:
            known.clear()
        return np.fromiter((known.get(g) or known.setdefault(g, _blake(g.encode(), 0)) for g in own), np.uint64, len(own))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            out = np.empty((batch.num_rows, positions), np.int64)
            for start, size, codes, tokens, _ in token_chunks(batch):
                which, own = _distinct_grams(size, codes, tokens, k)
                h = hashed(own, known)[which]
                last = np.cumsum(np.maximum(size - k + 1, 0))
                end = np.cumsum(size)
                for row in range(len(size)):
                    short = size[row] < k
                    mine = hashed([" ".join(tokens[c] for c in codes[end[row] - size[row] : end[row]]) or "<EMPTY>"], known) if short else h[last[row] - size[row] + k - 1 : last[row]]
                    low = np.full(positions, np.iinfo(np.uint64).max, np.uint64)
                    for i in range(0, len(mine), 4096):  # a long text's hashes meet the salts in bounded pieces
                        low = np.minimum(low, np.bitwise_xor.outer(salt, mine[i : i + 4096]).min(1))
                    out[start + row] = low.view(np.int64)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), positions).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [id_col, "sig"])

    bounded_batches(df.sparkSession)
    rows = df.select(id_col, ops.alias("__ops"))
    return rows.mapInArrow(of, T.StructType([df.schema[id_col], T.StructField("sig", kind("[long]"))]))


def agreement(a: Column, b: Column) -> Column:
    """Share of equal positions."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)


def similar_pairs(sig: DataFrame, id_col: str, sig_col: str, threshold: float, positions: int = POSITIONS) -> DataFrame:
    """(a, b, similarity) of all rows whose signatures agree enough, a < b.

    A pair that differs in at most d positions leaves one of d + 1 disjoint
    bands untouched, so joining on bands loses none. Equal signatures are
    collapsed first; a pair here is one of class representatives.
    """
    need = -(-int(round(threshold * positions * 1000)) // 1000)
    bands = positions - need + 1
    edges = [positions * k // bands for k in range(bands + 1)]
    key = [F.xxhash64(F.lit(k), F.slice("sig", edges[k] + 1, edges[k + 1] - edges[k])) for k in range(bands)]
    cls = representatives(sig, id_col, sig_col)
    # only ids meet in the bands; a pair's signatures are looked up once
    cls = materialize(cls, "classes")
    banded = cls.select("rep", F.explode(F.array(*key)).alias("band"))
    a, b = banded.withColumnRenamed("rep", "a"), banded.withColumnRenamed("rep", "b")
    pairs = a.join(b, "band").where("a < b").select("a", "b").distinct()
    full = pairs.join(cls.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a").join(cls.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    return full.where(same >= need).select("a", "b", (same / positions).alias("similarity"))


def banded_pairs(sig: DataFrame, id_col: str, sig_col: str, threshold: float, prefix: int = 4) -> DataFrame:
    """(a, b, similarity) of rows whose signatures begin alike and agree enough, a < b.

    One bucket by the first ``prefix`` values: cheap, and it loses pairs that
    differ there; ``similar_pairs`` loses none.
    """
    cls = representatives(sig, id_col, sig_col).withColumn("band", F.slice("sig", 1, prefix))
    a = cls.select("band", F.col("rep").alias("a"), F.col("sig").alias("sa"))
    b = cls.select("band", F.col("rep").alias("b"), F.col("sig").alias("sb"))
    return a.join(b, "band").where(F.col("a") < F.col("b")).select("a", "b", agreement(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= threshold)


def representatives(sig: DataFrame, id_col: str, sig_col: str) -> DataFrame:
    """(rep, sig): the smallest id of each distinct signature."""
    return sig.groupBy(F.col(sig_col).alias("sig")).agg(F.min(id_col).alias("rep"))


def family_edges(cls: DataFrame, threshold: float, positions: int = POSITIONS) -> DataFrame:
    """(a, b) of similar rows of (rep, sig), enough of them for the components to be those of all similar pairs.

    Bands are as in ``similar_pairs``. A small band gives its pairs. In a larger
    one every member is compared with the smallest; only members of different
    components are compared further. A band that stays hot is split again on the
    positions outside of it: two rows that agree in the band and differ in d
    places outside share one of d + 1 parts of the rest. What is hot even then is
    compared in blocks of bounded size, and only links leave a block.
    """
    need = -(-int(round(threshold * positions * 1000)) // 1000)
    edges = _edges(need, positions)
    rows = materialize(_banded(cls, edges), "bands")
    linked = None
    for level in (1, 2):
        rows = _counted(rows.withColumn("comp", F.col("rep")) if linked is None else _with_component(rows, linked))
        first = rows.where(F.col("n") > FEW).where("comp != head_comp").select(F.col("head").alias("a"), F.col("rep").alias("b"))
        own = _pairs(rows.where(F.col("n") <= FEW)).unionByName(first).distinct()
        linked = _verified(own, cls, need) if linked is None else linked.unionByName(_verified(own, cls, need))
        rows = rows.where(F.col("n") > FEW)
        if rows.isEmpty():
            return linked
        rows = _counted(_with_component(rows.select("rep", "band", "key"), linked))
        linked = linked.unionByName(_verified(_pairs(rows.where(F.col("n") <= HOT)).distinct(), cls, need))
        rows = rows.where(F.col("n") > HOT)
        if level == 1 and not rows.isEmpty():
            rows = materialize(_parts(rows.select("rep", "band", "key").join(cls, "rep"), edges), "parts")
    return linked if rows.isEmpty() else linked.unionByName(_in_blocks(rows, cls, need))


def _edges(need: int, positions: int) -> list[int]:
    """Ends of the bands of which two signatures that agree in ``need`` positions share one."""
    bands = positions - need + 1
    return [positions * k // bands for k in range(bands + 1)]


def _banded(cls: DataFrame, edges: list[int]) -> DataFrame:
    """(rep, band, key) of each band of each signature."""
    key = [F.xxhash64(F.lit(k), F.slice("sig", edges[k] + 1, edges[k + 1] - edges[k])) for k in range(len(edges) - 1)]
    return cls.select("rep", F.posexplode(F.array(*key)).alias("band", "key"))


def _parts(rows: DataFrame, edges: list[int]) -> DataFrame:
    """(rep, band, key) of the parts of what lies outside of each row's band: as many as there are bands."""
    place, bands = F.array(*map(F.lit, edges)), len(edges) - 1
    rest = F.concat(F.slice("sig", F.lit(1), F.get(place, F.col("band"))), F.slice("sig", F.get(place, F.col("band") + 1) + 1, F.lit(edges[-1])))
    cut = lambda j: F.floor(F.size("rest") * j / bands).cast("int")
    parts = [F.xxhash64("key", F.lit(j), F.slice("rest", cut(j) + 1, cut(j + 1) - cut(j))) for j in range(bands)]
    return rows.withColumn("rest", rest).select("rep", "band", F.explode(F.array(*parts)).alias("key"))


def _with_component(rows: DataFrame, edges: DataFrame) -> DataFrame:
    comp = connected_components(edges, "a", "b").select(F.col("node").alias("rep"), "component")
    return rows.join(comp, "rep", "left").select("rep", "band", "key", F.coalesce("component", "rep").alias("comp"))


def _counted(rows: DataFrame) -> DataFrame:
    """Rows of keys with several components, with the key's size, smallest row and that row's component."""
    size = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("rep", "comp")).alias("h"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y")
    # one row per key: Spark splits a hot key's side of this join by itself
    return materialize(rows.join(size.select("key", "n", F.col("h.rep").alias("head"), F.col("h.comp").alias("head_comp")), "key"), "open")


def _pairs(rows: DataFrame) -> DataFrame:
    """(a, b), a < b, of rows with one key and different components; keys have few rows."""
    a = rows.select("key", F.col("rep").alias("a"), F.col("comp").alias("ca"))
    b = rows.select("key", F.col("rep").alias("b"), F.col("comp").alias("cb"))
    return a.join(b, "key").where("a < b and ca != cb").select("a", "b")


def _verified(pairs: DataFrame, cls: DataFrame, need: int) -> DataFrame:
    full = pairs.join(cls.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a").join(cls.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    return materialize(full.where(same >= need).select("a", "b"), "links")


def _in_blocks(rows: DataFrame, cls: DataFrame, need: int) -> DataFrame:
    """Links between rows of one key and different components, two lots of a key at a time."""
    lots = F.ceil(F.col("n") / LOT).cast("int")
    own = rows.select("key", "rep", "comp", lots.alias("lots"), F.pmod(F.xxhash64("rep"), lots).cast("int").alias("lot")).join(cls, "rep")
    both = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    both = both.select("key", F.least("lot", "other").alias("i"), F.greatest("lot", "other").alias("j"), "rep", "comp", "sig")

    def links(table: pa.Table) -> pa.Table:
        sig = table["sig"].combine_chunks().flatten().to_numpy().reshape(len(table), -1)
        rep, comp = table["rep"].to_numpy(), table["comp"].to_numpy()
        out: list[list] = [[], []]
        for k in range(len(rep) - 1):
            apart = k + 1 + np.flatnonzero(comp[k + 1 :] != comp[k])
            near = apart[(sig[apart] == sig[k]).sum(1) >= need]
            near = near[np.unique(comp[near], return_index=True)[1]]  # one link to each component
            out[0] += np.minimum(rep[near], rep[k]).tolist()
            out[1] += np.maximum(rep[near], rep[k]).tolist()
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return materialize(both.groupBy("key", "i", "j").applyInArrow(links, "a long, b long"), "links")


def families(sig: DataFrame, id_col: str, sig_col: str, threshold: float) -> DataFrame:
    """(id, family): the smallest id of each row's component at a threshold."""
    cls = materialize(representatives(sig, id_col, sig_col), "classes")
    own = cls.withColumn("rep", F.col("rep").cast("long"))
    comp = connected_components(family_edges(own, threshold, _length(cls)), "a", "b")
    named = cls.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("sig", F.coalesce("component", "rep").alias("family"))
    return sig.select(id_col, F.col(sig_col).alias("sig")).join(named, "sig").select(id_col, "family")


def _length(cls: DataFrame) -> int:
    row = cls.select(F.size("sig").alias("n")).first()
    return row.n if row else POSITIONS


def relabel(fam: DataFrame, id_col: str, order: str) -> DataFrame:
    """(id, family_id): F00001 and so on by first appearance of each family."""
    first = fam.groupBy("family").agg(F.min(order).alias("first"))
    # five digits at least; a longer number stays whole
    number = F.col("__k").cast("string")
    named = ranked(first, [("first", False)], "__k").select("family", F.concat(F.lit("F"), F.when(F.length(number) < 5, F.lpad(number, 5, "0")).otherwise(number)).alias("family_id"))
    return fam.join(named, "family").select(id_col, "family_id")


def freeze(sig: DataFrame, id_col: str, sig_col: str, thresholds: tuple[float, ...] = (0.75, 0.85, 0.90)) -> DataFrame:
    """One family column per threshold."""
    out = sig.select(id_col)
    for t in thresholds:
        name = f"family_id_{round(t * 100):03d}"
        out = out.join(relabel(families(sig, id_col, sig_col, t), id_col, id_col).withColumnRenamed("family_id", name), id_col)
    return out


def skeleton_family(ops: Column) -> Column:
    return F.substring(F.sha2(F.array_join(ops, " "), 256), 1, 16)


def selector_family(selectors: Column) -> Column:
    return F.when(F.size(selectors) == 0, "NO_SELECTORS").otherwise(F.substring(F.sha2(F.array_join(F.array_sort(selectors), ","), 256), 1, 16))


def novelty(exact: Column, similarity: Column) -> Column:
    """exact_overlap, near_085, near_080 or novel."""
    return F.when(exact, "exact_overlap").when(similarity >= 0.85, "near_085").when(similarity >= 0.80, "near_080").otherwise("novel")


def novelty_against(new: DataFrame, known: DataFrame, id_col: str, address_col: str, sig_col: str, least: float = 0.80, positions: int = POSITIONS) -> DataFrame:
    """(id, exact, similarity, class) of new rows: whether a known row has the address, and the agreement with the most similar one.

    ``similarity`` is null where no known signature agrees in ``least`` of its
    positions, which the bands don't miss; else it is that of the most similar
    one. Bands that many known signatures share are split on the positions left.
    Equal signatures are compared once. Addresses are compared in lower case; a
    null one is known to nobody.
    """
    need = -(-int(round(least * positions * 1000)) // 1000)
    edges = _edges(need, positions)
    a, b = (materialize(df.where(F.col(sig_col).isNotNull()).groupBy(F.col(sig_col).alias("sig")).agg(F.min(F.xxhash64(sig_col)).alias("rep")), "classes") for df in (new, known))
    x, y = (materialize(_banded(c, edges), "bands") for c in (a, b))
    busy = materialize(y.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).join(x.select("key").distinct(), "key", "left_semi").select("key"), "busy")
    meet = lambda p, q: p.select(F.col("rep").alias("a"), "key").join(q.select(F.col("rep").alias("b"), "key"), "key").select("a", "b")
    pairs = meet(x.join(busy, "key", "left_anti"), y.join(busy, "key", "left_anti"))
    split = [_parts(rows.join(busy, "key", "left_semi").join(c, "rep"), edges) for rows, c in ((x, a), (y, b))]
    pairs = materialize(pairs.unionByName(meet(*split)).distinct(), "pairs")
    full = pairs.join(a.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a").join(b.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
    best = full.select("a", agreement(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= need / positions).groupBy("a").agg(F.max("similarity").alias("similarity"))
    best = a.join(best, F.col("rep") == F.col("a")).select(F.col("sig").alias("__sig"), "similarity")
    seen = known.select(F.lower(address_col).alias("__address")).dropna().distinct().withColumn("__seen", F.lit(True))
    out = new.select(id_col, F.lower(address_col).alias("__address"), F.col(sig_col).alias("__sig")).join(best, "__sig", "left").join(seen, "__address", "left")
    out = out.select(id_col, F.coalesce("__seen", F.lit(False)).alias("exact"), "similarity")
    return out.withColumn("class", novelty(F.col("exact"), F.col("similarity")))
