"""Near-duplicate passages across documents by compact windows.

Over the 5-word shingles of a text, a hash function's minimum stays the same
for all subsequences between the nearest smaller values on both sides: that is
a compact window, read off a Cartesian tree. Only positions that are the
minimum of some stretch as long as the shortest passage matter; a sliding
minimum finds them and the tree is built on them alone. Windows with the same
minimum meet across documents, each with that of the first document that has
it. The windows of several hash functions that a pair of documents shares are
joined by their intervals, and where enough functions agree, the pair is
verified over its texts. Rows with equal whole texts are told by hashes first
and take part once.

Members of a window that the first document doesn't explain then meet each
other: stretches as long as the shortest passage that share the minimum of
every function, and of which one lies in no passage found, are compared by
their whole content. So a passage of at least ``min_words`` words
that is copied word for word always meets its copies, whatever the first
document with one of its minima holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import MOST_SPREAD, SPREAD_ROWS, as_bytes, bounded_batches, chunks, mix, shingle_hashes, small_ids, spread_join, trim, unused, word_hashes
from quern.plans.materialize import materialize

#: Hash functions, at most 16, and how many must agree. A passage of 50 words at similarity
#: 0.8 shares each function's minimum with a chance of 0.8, so two of six with 0.998.
FUNCTIONS, NEEDED = 6, 2
#: How many must agree of what the first documents leave open: three of six with 0.983.
AGAIN = 3
#: One of so many documents is sampled for frequent windows, and how often one must be there.
SAMPLED, FREQUENT = 64, 32
_PLACE = np.uint64((1 << 28) - 1)
#: Low bits of a key, which hold the number of its function.
_BAND = np.uint64(15)


def sliding_minimum(x: np.ndarray, t: int) -> np.ndarray:
    """Minimum of each stretch of t values, by running minima of blocks from both ends."""
    n = len(x) - t + 1
    if n <= 0:
        return x[:0]
    rows = -(-len(x) // t)
    full = np.full(rows * t, np.iinfo(x.dtype).max, x.dtype)
    full[: len(x)] = x
    ahead = np.minimum.accumulate(full.reshape(rows, t), 1).ravel()
    back = np.minimum.accumulate(full.reshape(rows, t)[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[t - 1 : t - 1 + n])


def smaller_before(v: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Place of the nearest smaller value before each, or ``bound`` where none is after that place.

    The left parents of a Cartesian tree, found by jumping over places already
    known to be greater; values differ.
    """
    p = np.arange(len(v)) - 1
    left = np.flatnonzero(p > bound)
    left = left[v[p[left]] > v[left]]
    while len(left):
        p[left] = p[p[left]]
        left = left[p[left] > bound[left]]
        left = left[v[p[left]] > v[left]]
    return p


def compact_windows(s: np.ndarray, n: np.ndarray, t: int, function: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, place, first and last position of each window of at least t shingles in which one is the minimum.

    ``s`` are the shingle hashes of several texts with ``n`` each; places count within a text.
    """
    end = np.cumsum(n)
    begin, starts = end - n, np.maximum(n - t + 1, 0)
    if not starts.any():
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    with np.errstate(over="ignore"):
        x = s * (mix(np.array([function + 1], np.uint64))[0] | np.uint64(1))
    # the place in the low bits makes values differ, and the first of equals the least
    x = x & ~_PLACE | np.arange(len(s), dtype=np.uint64)
    inside = np.arange(starts.sum()) + np.repeat(begin - np.cumsum(starts) + starts, starts)
    place = (sliding_minimum(x, t)[inside] & _PLACE).astype(np.int64)
    place = place[np.concatenate([[True], place[1:] != place[:-1]])]  # they never go back
    own = np.searchsorted(end, place, "right")
    v, m = x[place], len(place)
    first, last = np.searchsorted(own, own, "left"), np.searchsorted(own, own, "right")
    before = smaller_before(v, first - 1)
    after = m - 1 - smaller_before(v[::-1], m - 1 - last[::-1])[::-1]
    left = np.where(before >= first, place[before] + 1 - begin[own], 0)
    right = np.where(after < last, place[np.minimum(after, m - 1)] - 1 - begin[own], n[own] - 1)
    return own, place - begin[own], left, right


def _windows(width: int, t: int, functions: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = as_bytes(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in chunks(texts):
                h, counts, _, _ = word_hashes(texts[i:j])
                s, n = shingle_hashes(h, counts, width)
                begin = np.cumsum(n) - n
                for f in range(functions):
                    own, place, left, right = compact_windows(s, n, t, f)
                    if len(own):
                        key = mix(s[begin[own] + place]) & ~_BAND | np.uint64(f)
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[i + own]), *(pa.array(x.astype(np.int32)) for x in (place, left, right))], ["key", "id", "c", "l", "r"])
        trim()

    return of


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sorted by key, whose key has several ids, with the first of that key; rows that are known to be many pass without."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        key, hot = (rows.column(c).to_numpy() for c in ("key", "hot"))
        begin = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1]) if len(key) else np.zeros(0, np.int64)
        # the last run may go on in the next batch
        done = begin[-1] if len(begin) and not hot[-1] else len(key)
        held = rows.slice(done)
        yield from _several(rows.slice(0, done), begin[begin < done])
    if held is not None and held.num_rows:
        yield from _several(held, np.zeros(1, np.int64))


def _several(rows: pa.Table, begin: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not rows.num_rows:
        return
    n = np.diff(np.append(begin, rows.num_rows))
    hot, doc = (rows.column(c).to_numpy() for c in ("hot", "id"))
    keep = np.repeat(np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin), n) | hot
    rows, low = rows.drop_columns(["hot"]), np.ones(len(doc), bool)
    for c in ("id", "c", "l", "r"):
        own = rows.column(c).to_numpy()
        least = np.repeat(np.minimum.reduceat(np.where(low, own, np.iinfo(own.dtype).max), begin), n)
        low &= own == least
        rows = rows.append_column(f"h{c}", pa.array(least, mask=hot))
    yield from rows.filter(pa.array(keep)).to_batches()


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole documents from rows sorted by id."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        ids = rows.column("id").to_numpy()
        cut = int(np.searchsorted(ids, ids[-1])) if len(ids) else 0
        if cut:
            yield rows.slice(0, cut)
        held = rows.slice(cut)
    if held is not None and held.num_rows:
        yield held


def open_runs(doc: np.ndarray, key: np.ndarray, c: np.ndarray, lo: np.ndarray, hi: np.ndarray, span: np.ndarray, t: int, functions: int) -> tuple[np.ndarray, ...]:
    """Hash of all functions' minima and their distances, document, first function's key of each run
    of stretches that have the same, and whether some of them lie in no passage found.

    Rows give the starts (from ``lo`` to ``hi``) at which a document's stretch has a shared minimum
    (at ``c``) or, where ``span``, a passage (from ``lo`` up to but without ``hi``); they are sorted by document.
    """
    new = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
    at = np.cumsum(new) - 1
    size = np.zeros(int(new.sum()), np.int64)
    np.maximum.at(size, at[~span], hi[~span] + 2)
    base = np.cumsum(size) - size
    total = int(size.sum())

    def ranges(rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """How many of the rows' ranges each place lies in."""
        room = size[at[rows]]
        begin, end = base[at[rows]] + np.minimum(first, room), base[at[rows]] + np.clip(last, first, room)
        return np.cumsum(np.bincount(begin, minlength=total + 1) - np.bincount(end, minlength=total + 1))[:total]

    mine, other = np.flatnonzero(~span), np.flatnonzero(span)
    full = ranges(mine, lo[mine], hi[mine] + 1) >= functions
    before = np.concatenate([[0], np.cumsum(full)])
    mine = mine[before[base[at[mine]] + hi[mine] + 1] > before[base[at[mine]] + lo[mine]]]
    free = full & (ranges(other, lo[other], hi[other] - t + 1) == 0)
    x, zero, link = np.zeros(total, np.uint64), np.zeros(total, np.int64), np.zeros(total, np.int64)
    with np.errstate(over="ignore"):
        for f in range(functions):
            rows = mine[(key[mine] & int(_BAND)) == f]
            n = hi[rows] - lo[rows] + 1
            place = np.arange(n.sum()) + np.repeat(base[at[rows]] + lo[rows] - np.cumsum(n) + n, n)
            own, far = np.zeros(total, np.uint64), np.zeros(total, np.int64)
            own[place], far[place] = np.repeat(key[rows].view(np.uint64), n), np.repeat(c[rows], n)
            zero, link = (far, own.view(np.int64)) if f == 0 else (zero, link)
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + own) + (far - zero).view(np.uint64)
    place = np.flatnonzero(full)
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(place) > 1) | (x[place[1:]] != x[place[:-1]])])) if len(place) else place
    first = place[cut]
    last = place[np.append(cut[1:], len(place)) - 1] if len(place) else place
    seen = np.concatenate([[0], np.cumsum(free)])
    own = np.searchsorted(base, first, "right") - 1
    return x[first].view(np.int64), doc[new][own], link[first], seen[last + 1] > seen[first]


def paired_minima(doc: np.ndarray, key: np.ndarray, c: np.ndarray, lo: np.ndarray, hi: np.ndarray, span: np.ndarray, copy: np.ndarray, first: np.ndarray, functions: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each two functions, a hash of their minima that some stretches of a document share, the document, whether no
    passage holds both, their places, the first and last of the stretches, and the functions' bits.

    Rows are as in ``open_runs``. Minima that lie in a word for word ``copy`` are left to
    its source, and two that the document is the ``first`` to have were met by all others.
    """
    if not len(doc):
        return
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    size = np.maximum.reduceat(np.where(span, hi, np.maximum(hi, c) + 1), np.flatnonzero(new)) + 1
    base, total = (np.cumsum(size) - size)[np.cumsum(new) - 1], int(size.sum())

    def held(rows: np.ndarray) -> np.ndarray:
        """Whether each place lies in one of the passages."""
        return np.cumsum(np.bincount(base[rows] + lo[rows], minlength=total + 1) - np.bincount(base[rows] + hi[rows], minlength=total + 1)) > 0

    known, equal = held(np.flatnonzero(span)), held(np.flatnonzero(span & copy))
    mine = np.flatnonzero(~span)
    mine = mine[~equal[base[mine] + c[mine]]]
    mine = mine[np.argsort(base[mine] + lo[mine], kind="stable")]
    # stretches of one function's minima don't overlap, so they ascend by both ends
    each = [mine[(key[mine] & int(_BAND)) == f] for f in range(functions)]
    for f in range(functions):
        for g in range(f + 1, functions):
            a, b = each[f], each[g]
            begin = np.searchsorted(base[b] + hi[b], base[a] + lo[a])
            n = np.maximum(np.searchsorted(base[b] + lo[b], base[a] + hi[a], "right") - begin, 0)
            a, b = np.repeat(a, n), b[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begin, n)]
            a, b = a[~(first[a] & first[b])], b[~(first[a] & first[b])]
            with np.errstate(over="ignore"):
                x = mix(key[a].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + key[b].view(np.uint64)).view(np.int64)
            free = ~(known[base[a] + c[a]] & known[base[b] + c[b]])
            yield x, doc[a], free, c[a], c[b], np.maximum(lo[a], lo[b]), np.minimum(hi[a], hi[b]), np.full(len(a), 1 << f | 1 << g)


#: Rows of stretches with all minima, and of ``paired_minima``, whose bits aren't null.
_RUNS = pa.schema([("x", pa.int64()), ("id", pa.int64()), ("key", pa.int64()), ("free", pa.bool_()), *((n, pa.int32()) for n in ("c", "c2", "lo", "hi", "bits"))])
_RUNS_DDL = "x long, id long, key long, free boolean, c int, c2 int, lo int, hi int, bits int"


def _open_runs(t: int, functions: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_document(batches):
            doc, key, span, copy, first = (rows.column(c).to_numpy() for c in ("id", "key", "span", "copy", "first"))
            c, lo, hi = (rows.column(c).to_numpy().astype(np.int64) for c in ("c", "lo", "hi"))
            own = open_runs(doc, key, c, lo, hi, span, t, functions)
            yield pa.RecordBatch.from_arrays([*map(pa.array, own), *(pa.nulls(len(own[0]), pa.int32()) for _ in range(5))], schema=_RUNS)
            for x, ids, free, *rest in paired_minima(doc, key, c, lo, hi, span, copy, first, functions):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(ids), pa.nulls(len(x), pa.int64()), pa.array(free), *(pa.array(v.astype(np.int32)) for v in rest)], schema=_RUNS)
        trim()

    return of


def _stretches(width: int, t: int):
    """Hashes of the whole content of stretches of t shingles with the given starts, and whether no passage covers them."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, ranges, spans = batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2), batch.column(3)
            for k, text in enumerate(texts):
                h, counts, _, _ = word_hashes([text])
                s, _ = shingle_hashes(h, counts, width)
                # the content of t shingles is that of t + width - 1 words, hashed as one wide shingle
                whole, _ = shingle_hashes(h, counts, t + width - 1)
                wanted = np.zeros(len(s) + 1, np.int64)
                for x in ranges[k].as_py():
                    if x["hi"] < len(s):
                        wanted[x["lo"]] += 1
                        wanted[x["hi"] + 1] -= 1
                at = np.flatnonzero(np.cumsum(wanted[: len(whole)]) > 0)
                free = np.ones(len(whole), bool)
                for x in spans[k].as_py() or ():
                    free[x["s"] : max(x["s"], x["e"] - t + 1)] = False
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(whole[at].view(np.int64)), pa.array(np.full(len(at), ids[k], np.int64)), pa.array(at.astype(np.int32)), pa.array(free[at])], ["x", "id", "s", "free"])
        trim()

    return of


def _runs(a: np.ndarray, b: np.ndarray, diagonals: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Stretches (start in b, start in a, length) of equal shingles on diagonals b = a + shift, each within its range of b."""
    out: set[tuple[int, int, int]] = set()
    shift, lo, hi = np.array(diagonals, np.int64).reshape(-1, 3).T
    first = np.maximum(np.maximum(shift, lo), 0)
    size = np.maximum(np.minimum(np.minimum(len(a) + shift, hi), len(b)) - first, 0)
    total = np.cumsum(size)
    at = 0
    while at < len(shift):  # a bounded number of places at once
        to = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 20), "right")), at + 1)
        n = size[at:to]
        own = np.repeat(np.arange(at, to), n)
        place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n - first[at:to], n)
        same = np.flatnonzero(b[place] == a[place - shift[own]])
        if len(same):
            new = np.concatenate([[0], np.flatnonzero((np.diff(same) > 1) | (np.diff(own[same]) > 0)) + 1])
            begin = place[same[new]]
            out.update(zip(begin.tolist(), (begin - shift[own[same[new]]]).tolist(), np.diff(np.append(new, len(same))).tolist()))
        at = to
    return sorted(out)


def _shifted(order: np.ndarray, sorted_a: np.ndarray, b: np.ndarray, diagonals: list[tuple[int, int, int]], runs: list[tuple[int, int, int]], reach: int) -> list[tuple[int, int, int]]:
    """Further diagonals, at most ``reach`` off a given one, on which shingles are equal that are on none given."""
    free = np.zeros(len(b) + 1, np.int64)
    for _, lo, hi in diagonals:
        free[max(lo, 0)] += 1
        free[min(max(hi, lo, 0), len(b))] -= 1
    free = np.cumsum(free)[:-1] > 0
    for bs, _, n in runs:
        free[bs : bs + n] = False
    at = np.flatnonzero(free)
    left, right = np.searchsorted(sorted_a, b[at], "left"), np.searchsorted(sorted_a, b[at], "right")
    at, left, many = at[right > left], left[right > left], (right - left)[right > left]
    known = np.array(sorted({d for d, _, _ in diagonals}), np.int64)
    shifts: set[int] = set()
    total = np.cumsum(many)
    i = 0
    while i < len(at):
        j = max(int(np.searchsorted(total, (total[i - 1] if i else 0) + (1 << 20), "right")), i + 1)
        n = many[i:j]
        where = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - left[i:j], n)
        shift = np.unique(np.repeat(at[i:j], n) - order[where])
        near = np.searchsorted(known, shift + reach, "right") > np.searchsorted(known, shift - reach)
        shifts.update(shift[near].tolist())
        i = j
    given = sorted(diagonals)
    place, out = np.array([d for d, _, _ in given], np.int64), set()
    for x in shifts:
        out.update((x, lo, hi) for _, lo, hi in given[np.searchsorted(place, x - reach) : np.searchsorted(place, x + reach, "right")])
    return sorted(out)


def matched_passages(a: np.ndarray, b: np.ndarray, diagonals: list[tuple[int, int, int]], t: int, percent: int, ranked: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int, int, int, int]]:
    """Passages (start, end in b; start, end in a; matched) of shingles, at least t long
    on both sides, whose similarity is enough; none lies within another one of b.

    Runs of equal shingles on the diagonals are chained in b's order while the
    chain keeps the similarity. Words put in or left out move a passage to other
    diagonals: those near the given ones are chained with them. ``ranked`` is the
    order of a's shingles and their sorted values, where it is known.
    """
    order, value = ranked or _ranked(a)
    runs = _runs(a, b, diagonals)
    done = _chained(runs, percent)
    if more := _shifted(order, value, b, diagonals, runs, t):
        done += _chained(sorted({*runs, *_runs(a, b, more)}), percent)
    out, end = [], -1
    for c in sorted((c for c in done if c[1] - c[0] >= t and c[3] - c[2] >= t), key=lambda c: (c[0], -c[1])):
        if c[1] > end:
            out.append((c[0], c[1], c[2], c[3], c[4]))
            end = c[1]
    return out


def _ranked(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(a, kind="stable")
    return order, a[order]


def _chained(runs: list[tuple[int, int, int]], percent: int) -> list[list[int]]:
    done: list[list[int]] = []
    chains: list[list[int]] = []
    for bs, as_, n in runs:
        best = None
        for c in chains:
            if bs >= c[1] and as_ >= c[3]:
                m = c[4] + n
                total = (bs + n - c[0]) + (as_ + n - c[2]) - m
                if 100 * m >= percent * total and (best is None or c[4] > best[4]):
                    best = c
        if best is not None:
            best[1], best[3], best[4] = bs + n, as_ + n, best[4] + n
        else:
            chains = [c for c in chains if bs - c[1] < 64]
            chains.append([bs, bs + n, as_, as_ + n, n])
            done.append(chains[-1])
    return done


def supported(diagonals: list[dict], needed: int) -> list[tuple[int, int, int]]:
    """Diagonals (shift, from, to) that lie where windows of enough functions overlap."""
    out: list[tuple[int, int, int]] = []
    group: list[dict] = []
    end, bits = -1, 0
    for x in sorted(diagonals, key=lambda x: x["lo"]):
        if x["lo"] > end:
            out += [(y["d"], y["lo"], y["hi"] + 1) for y in group] if bits.bit_count() >= needed else []
            group, bits = [], 0
        group.append(x)
        end, bits = max(end, x["hi"]), bits | x["bits"]
    return out + ([(y["d"], y["lo"], y["hi"] + 1) for y in group] if bits.bit_count() >= needed else [])


def _verify(width: int, t: int, percent: int, needed: int):
    names = ["doc_id", "start_word", "end_word", "start_byte", "end_byte", "source_doc_id", "source_start_word", "source_end_word", "similarity"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple] = {}
        for batch in batches:
            rows = []
            heads, texts = batch.column("src_text"), as_bytes(batch.column("dst_text"))
            srcs, dsts, met = (batch.column(c).to_pylist() for c in ("src", "dst", "diagonals"))
            for i, j in chunks(texts):
                h, counts, start, end = word_hashes(texts[i:j])
                s, n = shingle_hashes(h, counts, width)
                word, at = np.cumsum(counts) - counts, np.cumsum(n) - n
                for k in range(i, j):
                    src, spans = srcs[k], supported(met[k], needed)
                    if not spans:
                        continue
                    if src not in kept:
                        if len(kept) >= 8:
                            kept.clear()
                        own, many, _, _ = word_hashes([(heads[k].as_py() or "").encode()])
                        own = shingle_hashes(own, many, width)[0]
                        kept[src] = own, _ranked(own)
                    b, w = s[at[k - i] : at[k - i] + n[k - i]], word[k - i]
                    for bs, be, as_, ae, m in matched_passages(kept[src][0], b, spans, t, percent, kept[src][1]):
                        last = be + width - 2
                        rows.append((dsts[k], bs, last + 1, int(start[w + bs]), int(end[w + last]), src, as_, ae + width - 1, m / (be - bs + ae - as_ - m)))
            types = [pa.int64()] * 8 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], x) for i, x in enumerate(types)], names)
        trim()

    return of


def _whole(min_words: int):
    """The whole text as one passage, for texts that equal their source's."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = as_bytes(batch.column("text")), []
            ids, reps = batch.column("id").to_pylist(), batch.column("rep").to_pylist()
            for i, j in chunks(texts):
                _, counts, start, end = word_hashes(texts[i:j])
                last = np.cumsum(counts) - 1
                for k in np.flatnonzero(counts >= min_words).tolist():
                    n = int(counts[k])
                    rows.append((ids[i + k], 0, n, int(start[last[k] - n + 1]), int(end[last[k]]), reps[i + k], 0, n, 1.0))
            types = [pa.int64()] * 8 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], x) for i, x in enumerate(types)], [f.split()[0] for f in _SCHEMA.split(", ")])
        trim()

    return of


_SCHEMA = "doc_id long, start_word long, end_word long, start_byte long, end_byte long, source_doc_id long, source_start_word long, source_end_word long, similarity double"


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = 50, width: int = 5, percent: int = 80, functions: int = FUNCTIONS, needed: int = NEEDED) -> DataFrame:
    """Passages of at least ``min_words`` words that near-duplicate an earlier document's.

    One row per passage and earlier document found: doc_id, start_word,
    end_word (exclusive), start_byte, end_byte (of the text), source_doc_id,
    source_start_word, source_end_word, similarity (Jaccard of the aligned
    ``width``-word shingles, at least ``percent`` hundredths). The source is
    the document with the smallest id that shares minima of ``needed`` of the
    ``functions`` hash functions or, where that leaves a place open, the
    smallest that holds the same words. A text that equals an earlier
    document's whole text is one passage of the first such document. Repeats
    inside one document are not reported.

    Null, empty and shorter texts have no passages. Rows with a null id take no
    part; repeated rows of one id count as one document, the smallest text of
    several being compared. A text has at most 2**28 words. Other columns are
    ignored. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    t = min_words - width + 1
    every = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    every = every.select("*", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.octet_length("text").alias("size"))
    equal = ["h1", "h2", "size"]
    groups = every.groupBy(*equal).agg(F.min("id").alias("rep"), F.max("id").alias("most"), F.count("*").alias("rows")).where("rep != most").drop("most")
    groups = materialize(groups, "equal")
    copies = materialize(spread_join(every.select("id", *equal), groups, equal, "rows").where("id != rep").select("id", *equal, "rep").distinct(), "copies")
    few = small_ids(copies)
    texts = every.join(few, ["id", *equal], "left_anti").select("id", "text")
    whole = every.join(few, ["id", *equal]).select("id", "text", "rep").mapInArrow(_whole(min_words), _SCHEMA)

    schema = "key long, id long, c int, l int, r int"
    window = texts.mapInArrow(_windows(width, t, functions), schema)
    # rows of keys that a sample tells to be frequent are dealt over several tasks
    some = texts.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0).mapInArrow(_windows(width, t, functions), schema)
    many = materialize(some.groupBy("key").agg(F.count("*").alias("n")), "sample")
    least = max(FREQUENT, -(-many.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // MOST_SPREAD))
    hot = many.where(F.col("n") >= least).select("key", F.ceil(F.col("n") * SAMPLED / SPREAD_ROWS).cast("int").alias("lots"))
    window = window.join(F.broadcast(hot), "key", "left").withColumn("hot", F.col("lots").isNotNull())
    window = window.withColumn("lot", F.coalesce(F.pmod(F.xxhash64("id"), F.col("lots")), F.lit(0)).cast("int")).drop("lots")
    shared = window.repartition("key", "lot").sortWithinPartitions("key").drop("lot").mapInArrow(_shared, f"{schema}, hid long, hc int, hl int, hr int")
    shared = materialize(shared, "windows")
    own = ("key", "id", "c", "l", "r")
    far = shared.where("hid is null").select(*own)
    heads = far.groupBy("key").agg(F.min(F.struct("id", "c", "l", "r")).alias("h"), F.max("id").alias("most"), F.count("*").alias("rows")).where("h.id != most").drop("most")
    heads = materialize(heads, "heads")
    near = shared.where("id != hid").select(*own, F.struct(*(F.col(f"h{c}").alias(c) for c in own[1:])).alias("h"))
    met = near.unionByName(spread_join(far, heads, ["key"], "rows").where("id != h.id").select(*own, "h"))
    shift = F.col("c") - F.col("h.c")
    # the stretch over which both windows hold, widened by a passage on each side
    lo = F.greatest(F.lit(0), F.greatest(F.col("l"), F.col("h.l") + shift) - t)
    hi = F.least(F.col("r"), F.col("h.r") + shift) + t
    bit = F.expr(f"shiftleft(1, cast(key & {int(_BAND)} as int))")
    pairs_ = _diagonals(met.select(F.col("h.id").alias("src"), F.col("id").alias("dst"), shift.alias("d"), lo.alias("lo"), hi.alias("hi"), bit.alias("bits")), needed)
    pairs_ = materialize(pairs_, "pairs")
    found = materialize(_verified(pairs_, texts, width, t, percent, needed), "found")

    # stretches, by their start, at which a window's minimum is theirs
    starts = (F.greatest("l", F.col("c") - t + 1).alias("lo"), F.least("c", F.col("r") - t + 1).alias("hi"))
    passage = found.select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("key"), F.lit(0).alias("c"), F.col("start_word").cast("int").alias("lo"), (F.col("end_word") - width + 1).cast("int").alias("hi"), F.lit(True).alias("span"), (F.col("similarity") == 1).alias("copy"), F.lit(False).alias("first"))
    # the first of a key that was dealt over several tasks
    top = heads.select("key", F.col("h.id").alias("top"))
    places = shared.join(F.broadcast(top), "key", "left").select("id", "key", "c", *starts, F.lit(False).alias("span"), F.lit(False).alias("copy"), F.coalesce(F.col("id") == F.coalesce("hid", "top"), F.lit(False)).alias("first")).unionByName(passage)
    runs = places.repartition("id").sortWithinPartitions("id").mapInArrow(_open_runs(t, functions), _RUNS_DDL)
    runs = materialize(runs, "runs")
    paired, runs = runs.where("bits is not null").drop("key"), runs.where("bits is null").select("x", "id", "key", "free")
    # the first document with all the minima of a stretch needs no passage for it, a later one does
    open_ = runs.groupBy("x").agg(F.min("id").alias("first"), F.max(F.when(F.col("free"), F.col("id"))).alias("last"), F.first("key").alias("key")).where("last > first")
    # the windows of the first function in which such stretches lie, one row of a document each
    open_ = materialize(open_.select("key").distinct(), "open")
    ranges = shared.where(F.col("key").bitwiseAND(F.lit(int(_BAND))) == 0).select("key", "id", *starts).join(small_ids(open_), "key", "left_semi")
    ranges = ranges.groupBy("id").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    ranges = materialize(ranges, "ranges")
    own = _one_text(texts, ranges)
    spans = found.join(small_ids(ranges.select("id")), found["doc_id"] == F.col("id"), "left_semi")
    spans = spans.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set(F.struct(F.col("start_word").alias("s"), (F.col("end_word") - width + 1).alias("e"))).alias("spans"))
    stretch = materialize(own.join(spans, "id", "left").select("id", "text", "ranges", "spans").mapInArrow(_stretches(width, t), "x long, id long, s int, free boolean"), "stretches")
    first = stretch.groupBy("x").agg(F.min(F.struct("id", "s")).alias("h"), F.max("id").alias("most"), F.count("*").alias("rows")).where(F.col("h.id") != F.col("most"))
    first = materialize(first.select("x", "h", "rows"), "first")
    met = stretch.where("free").join(small_ids(first.select("x")), "x", "left_semi")
    met = spread_join(met, first, ["x"], "rows").where(F.col("id") != F.col("h.id"))
    met = met.select(F.col("h.id").alias("src"), F.col("id").alias("dst"), (F.col("s") - F.col("h.s")).alias("d"), F.greatest(F.lit(0), F.col("s") - t).alias("lo"), (F.col("s") + 2 * t - 1).alias("hi"), F.lit((1 << functions) - 1).alias("bits"))
    again = _diagonals(met.unionByName(_met_by_two(paired, t)), min(max(needed, AGAIN), functions))
    again = materialize(again, "pairs")
    both = again.join(pairs_.withColumnRenamed("diagonals", "before"), ["src", "dst"], "left")
    both = both.select("src", "dst", F.concat("diagonals", F.coalesce("before", F.array().cast(again.schema["diagonals"].dataType))).alias("diagonals"))
    key = [F.col("source_doc_id") == F.col("src"), F.col("doc_id") == F.col("dst")]
    return found.join(again.select("src", "dst"), key, "left_anti").unionByName(_verified(both, texts, width, t, percent, needed)).unionByName(whole)


def _met_by_two(paired: DataFrame, t: int) -> DataFrame:
    """(src, dst, d, lo, hi, bits) of documents that share two functions' minima with the first document
    that no passage explains there, or with the first other one."""
    met = paired.groupBy("x").agg(F.max("free").alias("open"), F.min("id").alias("least"), F.max("id").alias("most")).where("open and least != most")
    paired = paired.join(small_ids(materialize(met.select("x"), "met")), "x", "left_semi")
    held = F.struct("id", "c", "c2", "lo", "hi")
    tops = paired.groupBy("x").agg(F.min(F.when(F.col("free"), held)).alias("open"), F.min(F.when(~F.col("free"), held)).alias("known"), F.count("*").alias("rows"))
    tops = materialize(tops, "tops")
    met = spread_join(paired, tops, ["x"], "rows")
    each = F.array(F.col("open"), F.when(F.col("free"), F.col("known")))
    met = met.select("id", "c", "c2", "lo", "hi", "bits", F.explode(F.filter(each, lambda h: h.isNotNull() & (h["id"] != F.col("id")))).alias("h"))
    later = F.col("id") > F.col("h.id")
    side = lambda n: F.when(later, F.col(n)).otherwise(F.col(f"h.{n}"))
    one = F.col("bits").bitwiseAND(-F.col("bits"))
    ways = F.array(F.struct((F.col("c") - F.col("h.c")).alias("d"), one.alias("bit")), F.struct((F.col("c2") - F.col("h.c2")).alias("d"), (F.col("bits") - one).alias("bit")))
    met = met.select(F.least("id", "h.id").alias("src"), F.greatest("id", "h.id").alias("dst"), F.greatest(F.lit(0), side("lo") - t).alias("lo"), (side("hi") + 2 * t - 1).alias("hi"), F.when(later, 1).otherwise(-1).alias("sign"), F.explode(ways).alias("w"))
    return met.select("src", "dst", (F.col("w.d") * F.col("sign")).alias("d"), "lo", "hi", F.col("w.bit").alias("bits"))


def _diagonals(met: DataFrame, needed: int) -> DataFrame:
    """(src, dst, diagonals) from one row per meeting, where functions enough met."""
    diagonal = met.groupBy("src", "dst", "d").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bit_or("bits").alias("bits"))
    pair = diagonal.groupBy("src", "dst").agg(F.collect_list(F.struct("d", "lo", "hi", "bits")).alias("diagonals"), F.bit_or("bits").alias("bits"))
    return pair.where(F.bit_count("bits") >= needed).drop("bits")


def _one_text(texts: DataFrame, need: DataFrame) -> DataFrame:
    """``need`` with the smallest text of each id."""
    own = texts.join(small_ids(materialize(need.select("id"), "ids")), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    return need.join(own, "id")


def _verified(pairs_: DataFrame, texts: DataFrame, width: int, t: int, percent: int, needed: int) -> DataFrame:
    own = _one_text(texts, pairs_.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
    full = pairs_.join(own.select(F.col("id").alias("dst"), F.col("text").alias("dst_text")), "dst")
    many = materialize(pairs_.groupBy("src").agg(F.count("*").alias("rows")), "sources")
    heads = own.select(F.col("id").alias("src"), F.col("text").alias("src_text")).join(many, "src")
    full = spread_join(full, heads, ["src"], "rows", counts=many)
    return full.select("src", "dst", "diagonals", "src_text", "dst_text").mapInArrow(_verify(width, t, percent, needed), _SCHEMA)


def _cut(batches: Iterator[pa.RecordBatch], at: int, spans_at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, out = batch.column(at).to_pylist(), []
        for text, spans in zip(texts, batch.column(spans_at).to_pylist()):
            if spans:
                raw, kept, last = text.encode(), [], 0
                for x in sorted(spans, key=lambda x: (x["s"], x["e"])):
                    kept.append(raw[last : max(last, x["s"])])
                    last = max(last, x["e"])
                text = b"".join([*kept, raw[last:]]).decode()
                text = None if not text.strip() else text
            out.append(text)
        columns = [pa.array(out, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
        yield pa.RecordBatch.from_arrays(columns, names)


def cut_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the passages; a document of which nothing is left goes.

    Bytes of overlapping passages are cut once. Rows without passages, with
    null ids or null texts stay as they are. Columns keep names and order.
    """
    own, held = unused(docs, "__id"), unused(docs, "__spans")
    spans = passages.groupBy(F.col("doc_id").alias(own)).agg(F.collect_set(F.struct(F.col("start_byte").alias("s"), F.col("end_byte").alias("e"))).alias(held))
    names, schema = docs.columns, docs.schema
    joined = docs.join(spans, docs[id_col].cast("long") == spans[own], "left").drop(own)
    # texts without passages don't pass through Python
    calm = joined.where(F.col(held).isNull()).drop(held)
    torn = joined.where(F.col(held).isNotNull())
    at = names.index(text_col)
    torn = torn.mapInArrow(lambda it: _cut(it, at, len(names), names), schema).where(F.col(text_col).isNotNull())
    return calm.unionByName(torn)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
