"""Cases in which an operator once did less than the whole job."""

import random

import numpy as np

from quern.llm import ann, substring_dedup


def words(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def uncovered(rows, holder, begin, end):
    got = {p for r in rows if r.doc_id == holder for p in range(r.start_word, r.end_word)}
    return sorted(set(range(begin, end)) - got)


def test_passage_truncated_in_the_first_document(spark):
    """The later two of each triple share 50 words; the first has only 40 of them, or 49 of 60."""
    rng, rows, whole = random.Random(3), [], {}
    for k in range(120):
        size, short = ((50, 40), (60, 49))[k % 2]
        p = words(rng, size)
        for j, part in enumerate((p[:short], p, p)):
            before = words(rng, 30)
            rows.append((3 * k + j, " ".join([*before, *part, *words(rng, 30)])))
        whole[3 * k + 2] = 30, 30 + size
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [k for k, (a, b) in whole.items() if uncovered(found, k, a, b)] == []


def test_passage_at_a_later_place_of_the_first_document(spark):
    """The first document has a short part of the passage before it has the passage."""
    rng, rows = random.Random(4), []
    for k in range(40):
        p = words(rng, 50)
        rows.append((2 * k, " ".join([*p[:40], *words(rng, 30), *p, *words(rng, 9)])))
        rows.append((2 * k + 1, " ".join([*words(rng, 20), *p, *words(rng, 20)])))
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [k for k in range(40) if uncovered(found, 2 * k + 1, 20, 70)] == []


def test_passages_with_words_put_in_or_left_out(spark):
    """A word put into or left out of the middle of 52 words, at similarity 0.83 or more."""
    rng, rows = random.Random(5), []
    for k in range(300):
        p = words(rng, 52)
        q = p[:26] + words(rng, 1) + p[26:] if k % 2 else p[:26] + p[27:]
        rows.append((2 * k, " ".join([*words(rng, 30), *p, *words(rng, 30)])))
        rows.append((2 * k + 1, " ".join([*words(rng, 20), *q, *words(rng, 20)])))
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.source_doc_id for r in found} <= set(range(0, 600, 2))
    share = [sum(not uncovered(found, 2 * k + 1, 20, 20 + 51 + 2 * (k % 2)) for k in range(first, 300, 2)) / 150 for first in (0, 1)]
    print("left out, put in:", share)
    assert min(share) >= 0.97


def test_ten_different_neighbours_among_repeats(spark):
    """Every row three times; id 7 stands 40 times with other vectors next to the query, id 8 with 200."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(300) if i not in (7, 8)]
    rows += [(j, (np.array(rows[0][1]) + 1e-3 * rng.standard_normal(16)).tolist()) for j, n in ((7, 40), (8, 200)) for _ in range(n)]
    e = spark.createDataFrame(rows * 3, "vec_id long, embedding array<double>").coalesce(1)
    got = {}
    for r in ann.nearest(e, e.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    v, ids = np.array([x[1] for x in rows]), np.array([x[0] for x in rows])
    hit = 0
    for q in (0, 100, 200):
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(1))
        want = list(dict.fromkeys(int(ids[k]) for k in np.lexsort((ids, d)) if ids[k] != q))[:10]
        own = [i for _, i in sorted(got[q])]
        assert len(own) == 10 == len(set(own))
        hit += len(set(own) & set(want))
    assert hit >= 28


def test_stages_take_only_the_judged_row(spark, sf):
    """Null and repeated ids: a rejected text, a copy or a cut leaves the other rows of its id alone."""
    import corpus_pipeline as p

    rng = random.Random(8)
    data = spark.read.parquet(f"{sf}/documents.parquet")
    kept = p.language_id(spark, data, sf)
    good = [r.text for r in kept.where("lang = 'en' and length(text) > 600").orderBy("doc_id").select("text").limit(2).collect()]
    extra = [(None, None), (None, good[0]), (9001, "1234 !!!"), (9001, good[1])]
    schema = data.select("doc_id", "text", "lang", "source", "n_chars").schema
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in extra], schema)
    out = p.language_id(spark, data.select(docs.columns).unionByName(docs), sf)
    assert sorted(r.text for r in out.where("doc_id is null or doc_id = 9001").collect()) == sorted(good)

    a, b, c, d = (" ".join(words(rng, 80)) for _ in range(4))
    rows = [(1, a), (None, a), (None, b), (2, c), (2, a), (3, d), (3, d)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], schema)
    out = [(r.doc_id, r.text) for r in p.near_duplicates(spark, docs, sf).collect()]
    assert sorted(out, key=str) == sorted([(1, a), (None, b), (2, c), (3, d)], key=str)

    part = " ".join(a.split()[:60])
    rows = [(1, a), (2, b), (2, f"{c} {part}"), (None, f"{d} {part}")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], schema)
    out = [(r.doc_id, r.text.strip(), r.n_chars == len(r.text)) for r in p.repeated_passages(spark, docs, sf).collect()]
    assert sorted(out, key=str) == sorted([(1, a, True), (2, b, True), (2, c, True), (None, d, True)], key=str)


def test_verbatim_items_whatever_their_slots():
    from quern.llm.decontaminate import Index, _found

    dense = b"In 2019 Tom Smith sold 12 kg for 30 dollars to Mary Jones"
    short = b"Buy 3 kg"
    half = b" ".join(b"w%s" % bytes([97 + k // 26, 97 + k % 26]) for k in range(18))
    twice = half + b" 7 " + half.replace(b"w", b"v") + b" 7"
    changed = twice[:-1] + b"8"
    index = Index([1, 2, 3], [dense, short, twice])
    texts = [b"so. " + dense + b" ok", b"they buy 3 kg here", changed, b"In 2018 Ann Brown sold 12 kg for 30 dollars", b"buy 4 kg"]
    got = sorted((r[0], index.items[r[1]]) for r in _found(index, texts))
    assert got == [(0, 1), (1, 2), (2, 3)]


def test_exact_copies_behind_an_edited_earlier_document(spark):
    """The first of each triple holds the passage with words changed, the others hold it word for word."""
    rng, rows, whole = random.Random(8), [], {}
    for k in range(240):
        size, edits = ((50, 2), (60, 3), (80, 4))[k % 3]
        p = words(rng, size)
        q = list(p)
        for at in rng.sample(range(size), edits):
            q[at] = f"edit{rng.randrange(10**9)}"
        for j, part in enumerate((q, p, p)):
            rows.append((3 * k + j, " ".join([*words(rng, 25), *part, *words(rng, 25)])))
        whole[3 * k + 2] = 25, 25 + size
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [k for k, (a, b) in whole.items() if uncovered(found, k, a, b)] == []


def test_one_changed_word_in_fifty(spark):
    """At every place where that leaves a similarity of 0.8 or more."""
    rng, rows, n = random.Random(9), [], 400
    for k in range(n):
        p = words(rng, 50)
        q = list(p)
        q[k % 50] = "changed"
        rows.append((2 * k, " ".join([*words(rng, 30), *p, *words(rng, 30)])))
        rows.append((2 * k + 1, " ".join([*words(rng, 20), *q, *words(rng, 20)])))
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # a change near an end leaves fewer than 50 words on both sides of it, which are no passage
    inner = [k for k in range(n) if 5 <= k % 50 < 45]
    share = sum(any(r.doc_id == 2 * k + 1 for r in found) for k in inner) / len(inner)
    print("one changed word:", share)
    assert share >= 0.97


def test_equal_texts_are_one_passage_of_the_first(spark):
    rng = random.Random(10)
    a, b = (" ".join(words(rng, 70)) for _ in range(2))
    rows = [(5, f" {a}\n"), (3, f" {a}\n"), (9, f" {a}\n"), (4, b), (4, b), (7, "short copy"), (8, "short copy"), (None, b), (6, None)]
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.source_doc_id, r.start_word, r.end_word, r.start_byte, r.end_byte, r.similarity) for r in found) == [(k, 3, 0, 70, 1, 1 + len(a), 1.0) for k in (5, 9)]


def test_hot_keys_are_dealt_over_tasks(spark, monkeypatch):
    """A line that all documents share, with joins that deal a key over several tasks from its fourth row."""
    from quern.llm import common

    rng, rows = random.Random(11), []
    line = words(rng, 60)
    for k in range(40):
        rows.append((k, " ".join([*words(rng, k), *line, *words(rng, 20)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    usual = substring_dedup.repeated_passages(df).collect()
    monkeypatch.setattr(common, "SPREAD_ROWS", 4)
    assert sorted(substring_dedup.repeated_passages(df).collect()) == sorted(usual)
    assert {r.doc_id for r in usual} == set(range(1, 40)) and all(not uncovered(usual, k, k, k + 60) for k in range(1, 40))


def asked_again(rng, text):
    """The text with other values in its slots: numbers, and names that don't begin a sentence, one to one."""
    import re

    names = {}
    text = re.sub(r"\d+", lambda m: names.setdefault(m[0], str(rng.randrange(10**6, 10**7))), text)
    return re.sub(r"(?<=[a-z,] )[A-Z][a-z]+", lambda m: names.setdefault(m[0], "N" + "".join(rng.choice("abcdefgh") for _ in range(8))), text)


def test_questions_asked_again_and_brute_force(spark):
    """Items verbatim, re-asked, re-asked with a conflict, and cut, among prose, against every item for every text."""
    from quern.llm import decontaminate as d

    rng = random.Random(12)
    verbs = [f"verb{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]
    items = []
    for k in range(60):
        w = [rng.choice(verbs) for _ in range(rng.randint(6, 40))]
        for at in range(2, len(w), 5):
            w[at] = rng.choice([str(rng.randint(1, 40)), "Tom", "Mary", "kg", "3.5"])
        items.append((k, " ".join(w)))
    items += [(60, items[0][1]), (0, items[0][1]), (61, "short 7 kg"), (62, None), (None, "no id here at all")]
    docs = []
    for k, t in items[:60]:
        prose = lambda: " ".join(rng.choice(verbs) + "x" for _ in range(30))
        docs.append(f"{prose()} {t} {prose()}")
        docs.append(f"{prose()} {asked_again(rng, t)} {prose()}")
        docs.append(f"{prose()} {t.replace('Tom', 'Mary')} {prose()}")
        docs.append(f"{prose()} {' '.join(t.split()[: len(t.split()) // 2])} {prose()}")
    docs += ["they sold Short 7 kg yesterday", docs[0], None, ""]
    df = spark.createDataFrame([(k if k % 9 else None, t) for k, t in enumerate(docs)], "doc_id long, text string")
    got = sorted(map(tuple, d.contaminations(df, spark.createDataFrame(items, "item_id long, text string")).collect()), key=str)
    want = []
    for i, t in sorted({(i, t) for i, t in items if t is not None and i is not None}):
        index = d.Index([i], [t.encode()])
        for k, text in enumerate(docs):
            want += [(k if k % 9 else None, i, n, n / size, c, a, b) for _, _, a, n, size, c, b in d._found(index, [(text or "").encode()])]
    assert got == sorted(want, key=str) and any(r[4] > 0 for r in got) and len({r[1] for r in got}) >= 55
    kept = d.drop_contaminated(df.withColumn("extra", df.doc_id), spark.createDataFrame(items, "item_id long, text string"))
    bad = {docs[k] for k, text in enumerate(docs) if any(list(d._found(d.Index([i], [t.encode()]), [(text or "").encode()])) for i, t in items if t is not None and i is not None)}
    assert kept.columns == ["doc_id", "text", "extra"] and sorted((r.text for r in kept.collect()), key=str) == sorted((t for t in docs if t not in bad), key=str)


def test_near_copies_behind_documents_edited_more(spark):
    """Three documents hold 50 words with four changed, the fourth holds them as they are and the fifth with one changed."""
    rng, rows, n = random.Random(12), [], 200

    def edited(p, k):
        q = list(p)
        for at in rng.sample(range(5, 45), k):
            q[at] = f"edit{rng.randrange(10**9)}"
        return q

    for k in range(n):
        p = words(rng, 50)
        for j, part in enumerate([*(edited(p, 4) for _ in range(3)), p, edited(p, 1)]):
            rows.append((5 * k + j, " ".join([*words(rng, 25), *part, *words(rng, 25)])))
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    share = sum(any(r.doc_id == 5 * k + 4 and r.source_doc_id == 5 * k + 3 for r in found) for k in range(n)) / n
    print("behind edited documents:", share)
    assert share >= 0.93
