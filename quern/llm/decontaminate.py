"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question asked again
with other values has the same template. Hashed windows of the benchmark's
templates, and of its literal text, are joined with those of the documents by
equality; a bit set of bounded size tells beforehand which windows of a document
can have a partner, so few leave the scan. Pairs of a text and an item with
windows enough on one alignment are verified on their tokens, and the values in
their slots must map onto each other one to one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import as_bytes, bounded_batches, chunks, mix, powers, small_ids, spread_join, trim, unused
from quern.plans.materialize import materialize

#: Tokens of a window, how many of them must be words, tokens that must match in a row,
#: and the share of an item that suffices where the item is shorter.
WINDOW, LITERALS, RUN, SHARE = 8, 4, 13, 0.8
#: Bits of the set of benchmark windows for each window, and at most (a power of two): 64 MB.
BITS_EACH, MOST_BITS = 512, 1 << 29
#: Items that hold a window, beyond which it doesn't tell them apart.
MOST_ITEMS = 32

# Words that stand for numbers and units of measure.
NUMBER_WORDS = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen
fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred
thousand million billion dozen""".split()
UNIT_WORDS = """% $ mm cm m km meter meters metre metres kilometer kilometers inch inches foot feet yard yards
mile miles mg g kg gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres
gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars
cent cents euro euros degree degrees mph kmh percent""".split()

_KIND = np.zeros(256, np.uint8)  # 0 gap, 1 letter, 2 digit, 3 sign that is a token by itself
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_KIND[[36, 37]] = 3
_END = np.zeros(256, bool)  # after these a capital begins a sentence
_END[[10, 13, 33, 34, 46, 58, 63]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UP = powers(_BASE, 4096)
_WORD, _NUMBER, _NAME, _UNIT = 0, 1, 2, 3


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Value hash, type and text of each token, and the start byte in the joined texts."""
    joined = b"\n".join(texts) + b"\n\n"
    b = np.frombuffer(joined, np.uint8)
    kind = _KIND[b].copy()
    # a point or comma between digits belongs to the number
    mark = np.flatnonzero(((b == 46) | (b == 44)))
    mark = mark[(mark > 0) & (mark < len(b) - 1)]
    mark = mark[(kind[mark - 1] == 2) & (_KIND[b[mark + 1]] == 2)]
    kind[mark] = 2
    first = np.flatnonzero((kind != 0) & (np.concatenate([[0], kind[:-1]]) != kind) | (kind == 3))
    if not len(first):
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty, empty, empty
    low = np.frombuffer(joined.lower(), np.uint8)
    inside = kind != 0
    length = np.add.reduceat(inside.astype(np.int64), first)
    place = np.arange(len(b), dtype=np.int64)
    place[first[0] :] -= np.repeat(first, np.diff(np.append(first, len(b))))
    with np.errstate(over="ignore"):
        term = np.where(inside, (low.astype(np.uint64) + np.uint64(1)) * _UP[np.minimum(place, len(_UP) - 1)], np.uint64(0))
        h = mix(np.add.reduceat(term, first) + length.astype(np.uint64))
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    own = np.searchsorted(begin, first, "right") - 1
    typ = np.zeros(len(first), np.int64)
    upper = (b[first] >= 65) & (b[first] <= 90)
    shout = upper & (length > 1) & (b[np.minimum(first + 1, len(b) - 1)] >= 65) & (b[np.minimum(first + 1, len(b) - 1)] <= 90)
    # a capital begins a sentence if a mark stands since the last token, or none came before
    marks = np.concatenate([[0], np.cumsum(_END[b])])
    last = np.concatenate([[0], first[:-1] + length[:-1]])
    opening = (marks[first] > marks[last]) | np.concatenate([[True], own[1:] != own[:-1]])
    typ[upper & ~shout & ~opening] = _NAME
    typ[np.isin(h, _NUMBERS)] = _NUMBER
    typ[np.isin(h, _UNITS)] = _UNIT
    typ[kind[first] == 2] = _NUMBER
    return h, typ, own, first


def _listed(words: list[str]) -> np.ndarray:
    out = []
    for w in words:
        x = np.frombuffer(w.encode(), np.uint8).astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            out.append(mix((x * _UP[: len(x)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(x)))[0])
    return np.sort(np.array(out, np.uint64))


_NUMBERS, _UNITS = _listed(NUMBER_WORDS), _listed(UNIT_WORDS)


def _template(h: np.ndarray, typ: np.ndarray) -> np.ndarray:
    return np.where(typ == _WORD, h, typ.astype(np.uint64))


def _windows(t: np.ndarray, own: np.ndarray, typ: np.ndarray, n: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of windows of n tokens within one text that have enough words, and their places."""
    if len(t) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(t) - n + 1
    with np.errstate(over="ignore"):
        h = np.zeros(m, np.uint64)
        for k in range(n):
            h = h * np.uint64(0xC4CEB9FE1A85EC53) + t[k : m + k]
        h = mix(h + np.uint64(n))
    words = np.concatenate([[0], np.cumsum(typ == _WORD)])
    keep = np.flatnonzero((own[:m] == own[n - 1 :]) & (words[n:] - words[:-n] >= literals))
    return h[keep], keep


class Index:
    """Template and literal windows of some benchmark items, with the items' tokens."""

    def __init__(self, items: list[int], texts: list[bytes]):
        self.items, self.hashes, self.types = items, [], []
        keys: dict[tuple[bool, int], list[list[np.ndarray]]] = {}
        for at, text in enumerate(texts):
            h, typ, own, _ = tokens([text])
            self.hashes.append(h)
            self.types.append(typ)
            n = min(WINDOW, len(h))
            for literal in (False, True):
                if n and (literal or n >= LITERALS):
                    w, place = _windows(h if literal else _template(h, typ), own, typ, n, 0 if literal else LITERALS)
                    keys.setdefault((literal, n), []).append([w, np.full(len(w), at), place])
        self.tables = {}
        for n, parts in keys.items():
            w, at, place = (np.concatenate([p[k] for p in parts]) for k in range(3))
            order = np.argsort(w, kind="stable")
            self.tables[n] = (w[order], at[order], place[order])

    def matches(self, h: np.ndarray, typ: np.ndarray, own: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, first token, end token, matched, changed slots) of contaminations."""
        hits: dict[tuple[int, int, int, bool], set[int]] = {}
        t = _template(h, typ)
        for (literal, n), (w, at, place) in self.tables.items():
            got, where = _windows(h if literal else t, own, typ, n, 0 if literal else LITERALS)
            lo = np.searchsorted(w, got, "left")
            known = np.flatnonzero((lo < len(w)) & (w[np.minimum(lo, len(w) - 1)] == got)) if len(w) else []
            for k in known:
                x = lo[k]
                while x < len(w) and w[x] == got[k]:
                    p = int(where[k])
                    hits.setdefault((int(own[p]), int(at[x]), p - int(place[x]), literal), set()).update(range(int(place[x]), int(place[x]) + n))
                    x += 1
        best: dict[tuple[int, int], tuple[int, int, int, int, int, int]] = {}
        for (text, item, shift, literal), places in hits.items():
            size, order = len(self.hashes[item]), np.array(sorted(places))
            runs = np.split(order, np.flatnonzero(np.diff(order) > 1) + 1)
            # the whole alignment first; where its slots conflict, each of its runs by itself
            for covered in (order, *runs) if len(runs) > 1 else (order,):
                if len(covered) < SHARE * size and max(map(len, runs if covered is order else [covered])) < RUN:
                    continue
                changed = 0 if literal else self._changed(item, covered.tolist(), shift, h, typ)
                if changed < 0:
                    continue
                row = (text, item, int(covered[0]) + shift, int(covered[-1]) + shift + 1, len(covered), changed)
                if (text, item) not in best or best[text, item][4] < len(covered):
                    best[text, item] = row
                if covered is order:
                    break
        return sorted(best.values())

    def _changed(self, item: int, covered: list[int], shift: int, h: np.ndarray, typ: np.ndarray) -> int:
        """Slots whose value differs, or -1 where values don't map one to one."""
        there: dict[tuple[int, int], int] = {}
        back: dict[tuple[int, int], int] = {}
        changed = 0
        for p in covered:
            kind = int(self.types[item][p])
            if kind == _WORD:
                continue
            a, b = int(self.hashes[item][p]), int(h[p + shift])
            if there.setdefault((kind, a), b) != b or back.setdefault((kind, b), a) != a:
                return -1
            changed += a != b
        return changed


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, kind, item, place, size) of all windows of items (key, text); ``kind`` is their length, negative for literal ones."""
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            index = Index([key], [text])
            for (literal, n), (w, _, place) in index.tables.items():
                m = len(w)
                kind, size = np.full(m, -n if literal else n, np.int32), np.full(m, len(index.hashes[0]), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(_keyed(w, literal, n).view(np.int64)), pa.array(kind), pa.array(np.full(m, key, np.int64)), pa.array(place), pa.array(size)], ["w", "kind", "item", "place", "size"])


def _keyed(w: np.ndarray, literal: bool, n: int) -> np.ndarray:
    """Window hashes told apart by kind."""
    return mix(w ^ np.uint64(2 * n + literal))


def _bit_set(windows: DataFrame, bits: int) -> np.ndarray:
    """A set of ``bits`` bits with those of all windows, joined in two rounds."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) & np.uint64(bits - 1)
            np.bitwise_or.at(out, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8), dtype=np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["v"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for v in batch.column(0):
                out |= np.frombuffer(v.as_py(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["v"])

    lots = max(1, min(32, (1 << 32) // bits))
    row = windows.select("w").repartition(lots).mapInArrow(mark, "v binary").repartition(1).mapInArrow(join, "v binary").first()  # one row of at most MOST_BITS / 8 bytes
    return np.frombuffer(row.v, np.uint8)


def _hits(kinds: list[int], bits: np.ndarray):
    """(h1, h2, w, place) of windows of texts whose bit is set."""
    mask = np.uint64(8 * len(bits.value) - 1)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            names = [batch.column(c).to_numpy() for c in ("h1", "h2")]
            for i, j in chunks(texts):
                h, typ, own, _ = tokens(texts[i:j])
                t = _template(h, typ)
                begin = np.searchsorted(own, np.arange(j - i))
                for kind in kinds:
                    literal, n = kind < 0, abs(kind)
                    w, place = _windows(h if literal else t, own, typ, n, 0 if literal else LITERALS)
                    w = _keyed(w, literal, n)
                    at = w & mask
                    hit = np.flatnonzero(table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                    if len(hit):
                        text = own[place[hit]]
                        yield pa.RecordBatch.from_arrays([*(pa.array(x[i + text]) for x in names), pa.array(w[hit].view(np.int64)), pa.array(place[hit] - begin[text])], ["h1", "h2", "w", "place"])
        trim()

    return of


_PAIR = "h1 long, h2 long, item long, matched long, coverage double, changed_slots long, start_byte long, end_byte long"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: dict[int, Index] = {}
    for batch in batches:
        rows = []
        texts, items = as_bytes(batch.column("text")), as_bytes(batch.column("item_text"))
        for k, (h1, h2, item) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "item")))):
            if item not in kept:
                if len(kept) >= 256:
                    kept.clear()
                kept[item] = Index([item], [items[k]])
            rows += [(h1, h2, item, n, n / size, changed, a, b) for _, _, a, n, size, changed, b in _found(kept[item], [texts[k]])]
        types = [pa.int64()] * 4 + [pa.float64()] + [pa.int64()] * 3
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], x) for i, x in enumerate(types)], [f.split()[0] for f in _PAIR.split(", ")])
    trim()


def _runs(places: Column, n: Column) -> Column:
    """(longest, total): tokens covered by windows of n tokens at the places (ascending), in a row and in all."""

    def add(acc: Column, p: Column) -> Column:
        fresh = p > acc["end"]
        more = F.when(fresh, n).otherwise(p + n - acc["end"])
        run = F.when(fresh, n).otherwise(acc["run"] + more)
        return F.struct((p + n).alias("end"), run.alias("run"), F.greatest(acc["longest"], run).alias("longest"), (acc["total"] + more).alias("total"))

    zero = F.lit(0).cast("long")
    return F.aggregate(places, F.struct(F.lit(-1).cast("long").alias("end"), zero.alias("run"), zero.alias("longest"), zero.alias("total")), add)


def _enough(lined: DataFrame) -> Column:
    """True where the places of an alignment, or of an item, cover RUN tokens in a row or SHARE of the item."""
    runs = _runs(F.array_sort("places"), F.abs("kind").cast("long"))
    return (runs["longest"] >= RUN) | (runs["total"] >= F.col("size") * SHARE)


def _candidates(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """(h1, h2, item) of texts and items with windows enough on one alignment.

    Windows that more than MOST_ITEMS items hold, such as those of a common
    opening, don't find an item where they could not suffice alone: then any
    find has another window, too, and they only count for what that one brings.
    Windows that many texts hold are dealt over several tasks.
    """
    common = windows.groupBy("w").agg(F.count_distinct("item").alias("items")).where(F.col("items") > MOST_ITEMS).select("w", F.lit(True).alias("common"))
    own = materialize(windows.join(common, "w", "left").withColumn("common", F.coalesce("common", F.lit(False))), "windows")
    by = ["item", "kind"]
    alone = own.where("common").groupBy(*by).agg(F.collect_set("place").alias("places"), F.first("size").alias("size"))
    alone = alone.select(*by, (~_enough(alone)).alias("partial"))
    own = materialize(own.join(alone, by, "left").withColumn("partial", F.coalesce("partial", F.lit(False))), "windows")
    finds = own.where("not (common and partial)")
    # items of a window in lists of bounded length
    lists = finds.select("w", F.struct("item", "kind", "place", "size", "partial").alias("x")).withColumn("part", F.pmod(F.xxhash64("x.item"), F.ceil(F.count("*").over(Window.partitionBy("w")) / MOST_ITEMS)))
    lists = lists.groupBy("w", "part").agg(F.collect_list("x").alias("xs"))
    many = hits.groupBy("w").agg(F.count("*").alias("n"))
    lists = materialize(lists.join(many, "w"), "lists")
    parts = F.broadcast(lists.groupBy("w").agg(F.count("*").alias("parts")).where("parts > 1"))  # windows of many items that suffice alone: few
    asked = hits.withColumnRenamed("place", "p").join(parts, "w", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    met = spread_join(asked, lists, ["w", "part"], "n").select("h1", "h2", "p", F.explode("xs").alias("x")).select("h1", "h2", "p", "x.*")
    met = met.withColumn("shift", F.col("p") - F.col("place"))
    line = ["h1", "h2", *by, "shift"]
    whole = met.where("not partial").groupBy(*line).agg(F.collect_set("place").alias("places"), F.first("size").alias("size"))
    # where common windows were left out, they are counted now
    again = met.where("partial").select(*line).distinct().join(own.where("partial").select(*by, "w", "place", "size"), by).withColumn("p", F.col("place") + F.col("shift"))
    again = again.join(hits.withColumnRenamed("place", "p"), ["h1", "h2", "w", "p"], "left_semi")
    again = again.groupBy(*line).agg(F.collect_set("place").alias("places"), F.first("size").alias("size"))
    lined = whole.unionByName(again)
    return lined.where(_enough(lined)).select("h1", "h2", "item").distinct()


def _contaminated(src: DataFrame, bench: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """(h1, h2, item_id, ...) of each contaminated text of ``src`` (h1, h2, text) and item; None where the benchmark has no words."""
    spark = src.sparkSession
    items = bench.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null").distinct()
    items = materialize(items.withColumn("item", F.xxhash64("i", "t")), "items")
    windows = materialize(items.select("item", "t").mapInArrow(_item_windows, "w long, kind int, item long, place long, size long"), "windows")
    kinds = {r.kind: r.n for r in windows.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # at most two for each length up to WINDOW
    if not kinds:
        return None
    bits = min(MOST_BITS, 1 << max(10, (BITS_EACH * sum(kinds.values()) - 1).bit_length()))
    table = spark.sparkContext.broadcast(_bit_set(windows, bits))  # MOST_BITS / 8 bytes at most
    hits = materialize(src.mapInArrow(_hits(sorted(kinds), table), "h1 long, h2 long, w long, place long").distinct(), "hits")
    pairs = materialize(_candidates(hits, windows), "pairs")
    texts = src.join(small_ids(pairs.select("h1", "h2").distinct()), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("text").alias("text"))
    full = pairs.join(texts, ["h1", "h2"]).join(items.select("item", "i", F.col("t").alias("item_text")), "item")
    found = full.select("h1", "h2", "item", "text", "item_text").mapInArrow(_verify, _PAIR)
    return found.join(items.select("item", F.col("i").alias("item_id")), "item").drop("item")


def _found(index: Index, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """(text, item, start byte, tokens matched, tokens of the item, changed slots, end byte)."""
    for i, j in chunks(texts):
        h, typ, own, first = tokens(texts[i:j])
        begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[i:j]])])
        for text, item, a, b, n, changed in index.matches(h, typ, own):
            end = first[b] if b < len(first) and own[b] == text else begin[text + 1] - 1
            yield i + text, item, int(first[a] - begin[text]), n, len(index.hashes[item]), changed, int(end - begin[text])


_SCHEMA = "doc_id long, item_id long, matched long, coverage double, changed_slots long, start_byte long, end_byte long"


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Documents that hold a benchmark item or ask it again with other values.

    One row per document and item: doc_id, item_id, matched (tokens of the item
    on the best alignment), coverage (their share), changed_slots (placeholders
    filled otherwise), start_byte, end_byte. An alignment counts with RUN
    matched tokens in a row, or SHARE of an item's tokens, if the values of its
    numbers, names and units map one to one; where they don't, each run counts
    by itself. Tokens that match by value count so whatever the slots.

    Null and empty texts match nothing. Items with fewer than LITERALS tokens
    or windows without as many plain words are looked for by value only; an
    item shorter than a window has to be there whole. Rows with a null
    id are reported with it; repeated rows are reported each, and equal texts
    are compared once. Repeated items count once; items without an id or a text
    don't. Other columns are ignored; empty tables give an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).where("text is not null")
    src = src.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    found = _contaminated(src.drop("doc_id"), benchmark, item_col, item_text_col)
    if found is None:
        return spark.createDataFrame([], _SCHEMA)
    out = src.drop("text").join(small_ids(materialize(found, "found")), ["h1", "h2"])
    return out.select(*[f.split()[0] for f in _SCHEMA.split(", ")])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without rows whose text ``contaminations`` reports; columns keep names and order."""
    bounded_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    h1, h2 = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    src = docs.select(h1.alias("h1"), h2.alias("h2"), text.alias("text")).where("text is not null")
    found = _contaminated(src, benchmark, item_col, item_text_col)
    if found is None:
        return docs
    x, y = unused(docs, "__h1"), unused(docs, "__h2")
    bad = materialize(found.select(F.col("h1").alias(x), F.col("h2").alias(y)).distinct(), "contaminated")
    return docs.join(small_ids(bad), (h1 == F.col(x)) & (h2 == F.col(y)) & text.isNotNull(), "left_anti")


def op8_template_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contaminations of all documents by the whole benchmark."""
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminations(docs, bench)
