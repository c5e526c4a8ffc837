"""MinHash near-duplicate detection with tensored banding.

Two small collections of ``tables`` partial keys are computed per distinct
shingle set, each key hashing ``rows`` minimum values. Every pair (one key of
the first collection, one of the second) is a table key, so tables * tables
tables need only 2 * tables * rows minimum values where independent bands
would need tables * tables * 2 * rows. A pair of sets with similarity s shares
a table key with probability (1 - (1 - s**rows)**tables)**2.

Large buckets never become all pairs: sets are first collapsed by equality,
every member of a bucket is verified against the bucket's smallest member, and
only buckets that then hold several components are looked at again. Their
members meet where they share a shingle of their prefixes: in one order of all
shingles, two similar sets share one among the first of each. Shingles that many
components have come last, so sets that only have a common passage don't meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import as_bytes, bounded_batches, chunks, mix, shingle_hashes, shingle_sets, small_ids, spread_join, trim, word_hashes
from quern.operators.graph import connected_components
from quern.plans.materialize import materialize

#: Partial keys that a pair must share before its texts are compared; 1 compares all. Of 16 with
#: two rows each, a pair of similarity 0.8 shares ten on average, and fewer than
#: four once in 10,000 times.
SHARED_KEYS = 4
#: One of so many sets is sampled for shingles that several components have, and how many of them come
#: last. Only the order of shingles depends on it, not which pairs are found.
SAMPLED, COMMON = 16, 100_000


def _salts(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.int64()))


def _shingles(width: int):
    """(g, component) of each distinct shingle of the sets."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            component = batch.column(2).to_numpy()
            for k, s in shingle_sets(as_bytes(batch.column(1)), width):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(np.full(len(s), component[k]))], ["g", "component"])
        trim()

    return of


def prefix(s: np.ndarray, percent: int, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first shingles of a set, of which any set as similar as ``percent`` hundredths holds one among its own.

    The order is by how ``often`` the sorted ``common`` shingles occur, others first, and by value.
    """
    rank = np.zeros(len(s), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        rank = np.where(common[at] == s, often[at], 0)
    return s[np.lexsort((s, rank))[: len(s) - -(-percent * len(s) // 100) + 1]]


def _prefixes(width: int, percent: int, common: np.ndarray, often: np.ndarray):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in chunks(texts := as_bytes(batch.column(1))):
                own, reps, n = [], [], []
                for k, s in shingle_sets(texts[i:j], width):
                    first = prefix(s, percent, common, often)
                    own.append(first)
                    reps.append(i + k)
                    n.append(len(s))
                size = np.array([len(x) for x in own], np.int64)
                place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                which = np.repeat(np.array(reps, np.int64), size)
                columns = [pa.array(np.concatenate(own).view(np.int64)), batch.column(0).take(pa.array(which)), batch.column(2).take(pa.array(which)), pa.array(np.repeat(np.array(n, np.int64), size)), pa.array(place)]
                yield pa.RecordBatch.from_arrays(columns, ["g", "rep", "component", "n", "at"])
        trim()

    return of


def _signatures(width: int, tables: int, rows: int):
    salts = _salts(2 * tables * rows)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            n_out, fp, low = [], [], []
            for i, j in chunks(texts):
                h, counts, _, _ = word_hashes(texts[i:j])
                s, n = shingle_hashes(h, counts, width)
                at = np.concatenate([[0], np.cumsum(n)])[:-1]
                some = np.flatnonzero(n)
                keys = np.zeros((j - i, 2 * tables), np.int64)
                prints = np.zeros((j - i, 2), np.int64)
                sizes = np.zeros(j - i, np.int64)
                for k in some:
                    u = np.unique(s[at[k] : at[k] + n[k]])
                    sizes[k] = len(u)
                    prints[k] = (np.bitwise_xor.reduce(mix(u)).view(np.int64), u.sum(dtype=np.uint64).view(np.int64))
                if len(some):
                    with np.errstate(over="ignore"):
                        for g in range(2 * tables):
                            acc = np.full(len(some), g, np.uint64)
                            for r in range(rows):
                                x = (s ^ salts[g * rows + r]) * np.uint64(0xD6E8FEB86659FD93)
                                x ^= x >> np.uint64(32)
                                acc = mix(acc * np.uint64(0x2545F4914F6CDD1D) + np.minimum.reduceat(x, at[some]))
                            keys[some, g] = acc.view(np.int64)
                n_out.append(sizes)
                fp.append(prints)
                low.append(keys)
            if not n_out:
                continue
            prints, keys = np.concatenate(fp), np.concatenate(low)
            lists = _lists(keys)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n_out)), pa.array(prints[:, 0]), pa.array(prints[:, 1]), lists], ["id", "n", "f1", "f2", "keys"])
        trim()

    return of


def _verifier(width: int, percent: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            left, right = batch.column("src").to_pylist(), batch.column("dst").to_pylist()
            own = as_bytes(batch.column("dst_text"))
            heads = batch.column("src_text")
            ok = np.zeros(len(left), bool)
            for k, s in shingle_sets(own, width):
                head = kept.get(left[k])
                if head is None:
                    if len(kept) >= 16:
                        kept.clear()
                    t = heads[k].as_py()
                    _, head = next(shingle_sets([b"" if t is None else t.encode()], width))
                    kept[left[k]] = head
                if not len(head) or not len(s):
                    continue
                at = np.minimum(np.searchsorted(head, s), len(head) - 1)
                both = int((head[at] == s).sum())
                ok[k] = 100 * both >= percent * (len(head) + len(s) - both)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(ok)], ["src", "dst", "ok"])
        trim()

    return of


def _texts_of(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, text) of the given ids; of several texts the smallest."""
    return texts.join(small_ids(materialize(ids, "ids")), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (src, dst) with similarity enough on their full sets."""
    need = pairs.select(F.col("src").alias("id")).union(pairs.select(F.col("dst").alias("id"))).distinct()
    own = _texts_of(need, texts)
    full = pairs.join(own.select(F.col("id").alias("dst"), F.col("text").alias("dst_text")), "dst")
    many = materialize(pairs.groupBy("src").agg(F.count("*").alias("rows")), "sources")
    heads = own.select(F.col("id").alias("src"), F.col("text").alias("src_text")).join(many, "src")
    full = spread_join(full, heads, ["src"], "rows", counts=many).sortWithinPartitions("src")
    return full.select("src", "dst", "src_text", "dst_text").mapInArrow(_verifier(width, percent), "src long, dst long, ok boolean").where("ok").select("src", "dst")


def _table_keys(classes: DataFrame, tables: int) -> DataFrame:
    """(key, rep, n): the tensored keys, made only of partial keys that occur twice."""
    part = classes.select("rep", "n", F.posexplode("keys").alias("pos", "val"))
    shared = part.groupBy("pos", "val").agg(F.count("*").alias("c")).where("c > 1").select("pos", "val")
    part = part.join(shared, ["pos", "val"])
    first = F.collect_list(F.when(F.col("pos") < tables, F.col("val")))
    second = F.collect_list(F.when(F.col("pos") >= tables, F.col("val")))
    own = part.groupBy("rep").agg(F.first("n").alias("n"), first.alias("a"), second.alias("b"))
    own = own.select("rep", "n", "b", F.explode("a").alias("x"))
    own = own.select("rep", "n", "x", F.explode("b").alias("y"))
    return own.select(F.xxhash64("x", "y").alias("key"), "rep", "n")


def _similar_size(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, percent: int = 80, tables: int = 8, rows: int = 2, wide_bucket: int | None = None, shared_keys: int = SHARED_KEYS, most_bits: int | None = None) -> DataFrame:
    """Component of near duplicates of each row: (id, n_shingles, component_id, kept).

    Rows are linked when the Jaccard similarity of their sets of distinct
    ``width``-word shingles is at least ``percent`` hundredths, confirmed on
    the full sets. Words are runs without ASCII white space, A-Z lowered.
    component_id is the smallest id reachable; kept marks the row that has it.
    ``shared_keys`` spares comparisons of a bucket's members with its smallest
    that can hardly succeed; with 1 none is spared. All other pairs that share a
    table key, are not linked already and can be similar are compared.
    ``wide_bucket`` and ``most_bits`` are accepted and spare nothing any more.

    Null or empty texts and texts without a word have no shingles, are linked
    with nothing and are kept. A row with null id keeps a null component unless
    an equal set has an id, and is kept where its component is null. Repeated
    rows share a component and all of them are marked kept if one is. Ids are
    taken as one text each: of several texts under one id, the smallest is
    compared. Other columns of ``docs`` are ignored. An empty table gives an
    empty result.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, n long, f1 long, f2 long, keys array<long>"
    sig = materialize(texts.mapInArrow(_signatures(width, tables, rows), schema), "signatures")
    classes = sig.where("n > 0 and id is not null").groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.first("keys").alias("keys"), F.count("*").alias("rows"))
    classes = materialize(classes, "classes")
    table = materialize(_table_keys(classes.select("rep", "n", "keys"), tables), "tables")
    heads = table.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("head"), F.count("*").alias("c")).where("c > 1")
    near = spread_join(table, materialize(heads, "heads"), ["key"], "c").where(F.col("rep") != F.col("head.rep"))
    near = near.where(_similar_size("n", "head.n", percent)).select(F.col("head.rep").alias("src"), F.col("rep").alias("dst")).distinct()
    tried = materialize(_plausible(near, classes, shared_keys), "pairs")
    links = materialize(_verified(tried, texts, width, percent), "links")
    comp = connected_components(links)
    rest = _cross_pairs(table, classes, comp, texts, width, percent, tables).join(tried, ["src", "dst"], "left_anti")
    rest = materialize(rest, "pairs")
    if not rest.isEmpty():
        links = links.unionByName(_verified(rest, texts, width, percent))
        comp = connected_components(links)
    own = classes.drop("keys").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", "n", "rows", F.coalesce("component", "rep").alias("component_id"))
    out = spread_join(sig.select("id", "n", "f1", "f2"), materialize(own, "components"), ["f1", "f2", "n"], "rows", how="left")
    comp_id = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp_id.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.col("component_id").isNull()))


def _plausible(pairs: DataFrame, classes: DataFrame, shared_keys: int) -> DataFrame:
    """Pairs that share partial keys enough."""
    dst = classes.select(F.col("rep").alias("dst"), F.col("keys").alias("k2"))
    src = classes.select(F.col("rep").alias("src"), F.col("keys").alias("k1"))
    out = pairs.join(dst, "dst").join(src, "src")
    return out.where(F.size(F.array_intersect("k1", "k2")) >= shared_keys).select("src", "dst")


def _reaches(n: str, at: str, other: str, percent: int):
    """Whether a set with its first shared shingle at ``at`` has enough left for one of the ``other`` size."""
    return (F.col(n) - F.col(at)) * (100 + percent) >= (F.col(n) + F.col(other)) * percent


def _meetings(first: DataFrame, percent: int) -> DataFrame:
    """(rep1, rep2, n, rest) for each shingle that prefixes of two components share early enough.

    ``n`` is the sum of both sizes, ``rest`` how many shingles they can share from that one on. The first shingle
    that two similar sets share lies so early in both that what is left suffices, so edited
    copies of one text don't meet by the text's own shingles, which come after their rare ones.
    """
    # a shingle of one component joins nothing, nor does one after which the smallest set asks for too much
    known = first.groupBy("g").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("n").alias("least")).where("x != y")
    rows = first.join(known.drop("y"), "g").where(_reaches("n", "at", "least", percent))
    rows = materialize(rows.select("g", "rep", "component", "n", "at", (F.col("component") != F.col("x")).alias("apart")), "prefixes")
    # members of a shingle's first component don't meet each other
    side = lambda k: rows.select("g", *[F.col(x).alias(f"{x}{k}") for x in ("rep", "component", "n", "at", "apart")])
    once = F.col("apart1") & (~F.col("apart2") | (F.col("rep1") < F.col("rep2")))
    fits = _reaches("n1", "at1", "n2", percent) & _reaches("n2", "at2", "n1", percent)
    met = side(1).where("apart1").join(side(2), "g").where(once & (F.col("component1") != F.col("component2")) & _similar_size("n1", "n2", percent) & fits)
    return met.select("rep1", "rep2", (F.col("n1") + F.col("n2")).alias("n"), F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2")).alias("rest"))


def _cross_pairs(table: DataFrame, classes: DataFrame, comp: DataFrame, texts: DataFrame, width: int, percent: int, tables: int) -> DataFrame:
    """Pairs of sets that share a table key but no component yet and can be similar.

    They are sought among the members of buckets with several components: by
    the shingles that their prefixes share, then by the most that their sets can
    share after those, and by their keys.
    """
    member = table.select("key", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = member.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("key")
    ids = materialize(member.join(mixed, "key", "left_semi").select("rep", "component").distinct(), "members")
    need = _texts_of(ids.select(F.col("rep").alias("id")), texts).join(ids.withColumnRenamed("rep", "id"), "id").select("id", "text", "component")
    need = materialize(need, "texts")
    some = need.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0).mapInArrow(_shingles(width), "g long, component long")
    top = some.groupBy("g").agg(F.count_distinct("component").alias("c")).where("c > 1").orderBy(F.desc("c"), "g").limit(COMMON).toArrow()  # COMMON rows at most
    g, c = (top.column(k).to_numpy() for k in ("g", "c"))
    order = np.argsort(g.view(np.uint64))
    first = need.mapInArrow(_prefixes(width, percent, g.view(np.uint64)[order], c[order]), "g long, rep long, component long, n long, at long")
    first = materialize(first, "prefixes")
    met = _meetings(first, percent).groupBy(F.least("rep1", "rep2").alias("src"), F.greatest("rep1", "rep2").alias("dst"), "n").agg(F.count("*").alias("c"), F.min("rest").alias("rest"))
    met = materialize(met.where((F.col("c") + F.col("rest") - 1) * (100 + percent) >= F.col("n") * percent).select("src", "dst"), "met")
    keys = lambda name, k: classes.select(F.col("rep").alias(name), F.slice("keys", 1, tables).alias(f"a{k}"), F.slice("keys", tables + 1, tables).alias(f"b{k}"))
    full = met.join(keys("src", 1), "src").join(keys("dst", 2), "dst")
    return full.where(F.arrays_overlap("a1", "a2") & F.arrays_overlap("b1", "b2")).select("src", "dst")


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents on four-word shingles."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, width=4, percent=80)
