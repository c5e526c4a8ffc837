"""Each operator's query against a brute-force version on a small table."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quern.llm import ann, binary, common, packing
from quern.llm.queries import oracle_sql, queries
from quern.llm.tokens import Encoder

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def ids(docs):
    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return {k: t.encode(v or "", add_special_tokens=False).ids for k, v in docs.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_ten_queries_without_sql():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11)) and oracle_sql() == {}


def test_encoder_equals_the_library():
    rng = random.Random(1)
    bits = [" ", "  ", "\n", "\t", "\xa0", "　", "\x85", "\x1c", "a", "B", "é", "1", "'s", "'", "!", "...", "<|endoftext|>", "中", "\x00", "\x01", "ß", " the", ",\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + [None, "", " ", "\n", " a", "a ", "a\n"]
    e = Encoder(BPE)
    assert e.encode(texts) == [np.array(e.model.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_word_kernel():
    texts = ["One  two\tTHREE", "", " ", "one two three four five", "É a"]
    h, counts, start, end = common.word_hashes([t.encode() for t in texts])
    words = [w for t in texts for w in re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower())]
    assert counts.tolist() == [3, 0, 0, 5, 2] and len(set(zip(words, h.tolist()))) == len(set(words)) == len(set(h.tolist()))
    assert texts[0].encode()[start[2] : end[2]] == b"THREE"


def test_packing(spark, sf, ids):
    rows = queries()["op3_best_fit_packing"](spark, sf).orderBy("doc_id", "piece").collect()
    at, by = {}, {}
    for r in rows:
        own = ids[r.doc_id] + [2]
        piece, start = at.get(r.doc_id, (0, 0))
        assert (r.piece, r.start) == (piece, start) and r.ids_crc32 == crc(own[start : start + r.length])
        assert r.length == 1024 or piece == 0
        at[r.doc_id] = (piece + 1, start + r.length)
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {k: v[1] for k, v in at.items()} == {k: len(v) + 1 for k, v in ids.items()}
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 1024
    assert len(by) <= 1.05 * -(-sum(len(v) + 1 for v in ids.values()) // 1024) + 2


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan(seed):
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 1025, 3000), np.clip(rng.lognormal(5, 1, 3000).astype(int), 1, 1024), rng.integers(300, 700, 3000), rng.choice([341, 512, 513, 1024, 3], 900)][seed]
    hist = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
    plan, n = packing.plan_packing(hist, 1024, groups=24)
    fill, ranks = {}, {}
    for length, rank, many, first, offset in plan:
        ranks.setdefault(length, set()).update(range(rank, rank + many))
        for q in range(first, first + many):
            fill.setdefault(q, []).append((offset, length))
    assert {k: len(v) for k, v in ranks.items()} == hist and all(v == set(range(len(v))) for v in ranks.values())
    assert len(fill) == n
    for parts in fill.values():
        parts.sort()
        assert all(o == sum(x for _, x in parts[:k]) for k, (o, _) in enumerate(parts)) and sum(x for _, x in parts) <= 1024
    assert n <= 1.2 * -(-int(lengths.sum()) // 1024) + 2


def test_packed_ids_assemble(spark, sf, ids):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 30")
    packed = packing.pack(docs, tokenizer_path=BPE, with_ids=True)
    whole = packing.assemble(packed).collect()
    assert sum(r.n_tokens for r in whole) == sum(len(ids[k]) + 1 for k in range(30)) and all(len(r.ids) == 4 * r.n_tokens for r in whole)


def test_token_files(spark, sf, ids):
    rows = queries()["op5_pfor_tokens"](spark, sf).orderBy("doc_id").collect()
    at = 0
    for r, k in zip(rows, sorted(ids)):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, at, len(ids[k]) + 1, crc(ids[k] + [0]))
        at += r.n_tokens
    assert len(rows) == len(ids)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
@pytest.mark.parametrize("kind", range(4))
def test_block_round_trip(n, kind):
    rng = np.random.default_rng(n)
    x = [rng.integers(0, 50257, n), np.where(rng.random(n) < 0.05, 2**32 - 1, rng.integers(0, 7, n)), np.full(n, 7), rng.integers(0, 2**32, n)][kind].astype(np.uint32)
    lengths = [n // 3, 0, n - n // 3]
    got = list(binary.read_documents(binary.encode_file([1, None, 5], lengths, x)))
    assert [(d, len(b) // 4) for d, _, b in got] == list(zip([1, None, 5], lengths)) and b"".join(b for *_, b in got) == x.astype("<u4").tobytes()


def shingles(text, width):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


@pytest.mark.parametrize("way", ["query", "wide", "exact"])
def test_near_duplicates(spark, sf, docs, way):
    from quern.llm.near_dedup import near_duplicates

    sets = {k: shingles(v, 4) for k, v in docs.items()}
    root = {k: k for k in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in docs:
        for b in docs:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    data = spark.read.parquet(f"{sf}/documents.parquet")
    if way == "query":
        rows = queries()["op10_near_dedup"](spark, sf).collect()
    elif way == "wide":  # buckets are wide from their third member outside the main component
        rows = near_duplicates(data, width=4, wide_bucket=2).collect()
    else:  # no comparison is spared
        rows = near_duplicates(data, width=4, wide_bucket=None, shared_keys=1, most_bits=None).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {k: (len(sets[k]), find(k), find(k) == k) for k in docs}


def test_repeated_passages(spark, sf, docs):
    """Every place of a 50-word passage that an earlier document holds is covered."""
    rows = queries()["op6_substring_dedup"](spark, sf).collect()
    covered = {}
    for r in rows:
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        assert r.source_doc_id < r.doc_id and r.similarity >= 0.8 and r.end_word - r.start_word >= 50
        raw = docs[r.doc_id].encode()[r.start_byte : r.end_byte]
        assert len(raw.split()) == r.end_word - r.start_word
    first = {}
    for k in sorted(docs):
        w = docs[k].encode().lower().split()
        for i in range(len(w) - 49):
            at = first.setdefault(tuple(w[i : i + 50]), k)
            assert at == k or set(range(i, i + 50)) <= covered.get(k, set())


def test_contaminations(spark, sf, docs):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    rows = queries()["op8_template_decontamination"](spark, sf).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(d, i) for i, t in items.items() for d, x in docs.items() if t in x}


def test_slots_must_map_one_to_one():
    from quern.llm.decontaminate import Index, _found

    index = Index([1], [b"Then Tom Smith has 12 apples and gives 5 apples to Mary in the 3 km long park near Paris today."])
    other = b"well. Then Bob Jones has 20 apples and gives 7 apples to Anna in the 9 miles long park near Rome today. ok"
    mixed = b"Then Bob Jones has 20 apples and gives 7 apples to Bob in the 7 km long park near Rome today."
    assert [(r[0], r[1], r[5] > 0) for r in _found(index, [b"nothing here", other, mixed])] == [(1, 0, True)]


def test_languages(spark, sf):
    rows = {r.doc_id: r for r in queries()["op2_language_id"](spark, sf).collect()}
    known = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()
    held = [r for r in known if rows[r.doc_id].held_out]
    assert all(rows[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in known)
    assert sum(rows[r.doc_id].lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert sum(r.rejected for r in rows.values()) <= 0.02 * len(rows)


def test_quality(spark, sf):
    rows = {r.doc_id: r for r in queries()["op1_quality_classifier"](spark, sf).collect()}
    known = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert all(rows[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k in rows)
    assert sum(rows[r.doc_id].predicted == r.quality for r in known) >= 0.9 * len(known)


def test_shards(spark, sf, docs):
    rows = queries()["op7_sampled_splitters"](spark, sf).collect()
    slots, load = {}, {}
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None) and 0 <= r["shard"] < 40
        slots.setdefault(r["shard"], []).append(r["slot"])
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(rows) == len(docs)
    largest, share = max(r["size"] for r in rows), sum(load.values()) / 40
    assert all(abs(v - share) <= largest for v in load.values())


def test_neighbours(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    v, i = np.array([r.embedding for r in e], float), np.array([r.vec_id for r in e])
    hit = n = 0
    rows = queries()["op9_collision_counting"](spark, sf).collect()
    for q in i[i % 100 == 0]:
        d = np.sqrt(((v - v[i == q][0]) ** 2).sum(1))
        order = [k for k in np.lexsort((i, d)) if i[k] != q][:10]
        own = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q)
        assert [r[0] for r in own] == list(range(1, 11)) and all(s == d[i == k][0] for _, k, s in own)
        hit += len({int(i[k]) for k in order} & {r[1] for r in own})
        n += 10
    assert hit >= 0.9 * n


def test_blocks_of_queries_give_the_same(spark, sf, monkeypatch):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    whole = ann.nearest(e, e.where("vec_id % 100 = 0"), block=64).collect()
    monkeypatch.setattr(ann, "QUERY_BYTES", 2000)
    assert sorted(whole) == sorted(ann.nearest(e, e.where("vec_id % 100 = 0"), block=64).collect())


def licence_by_hand(text, whole=False):
    """The best (cosine, licence) over all units of a text, by dictionaries."""
    import math
    from collections import Counter

    from quern.llm.licenses import COSINE, TEMPLATES

    def terms(x):
        return [w.lower() for w in re.findall(r"[0-9]+(?:[.,][0-9]+)*|[A-Za-z\u0080-\U0010ffff]+|[$%]", x)]

    bags = [(name, Counter(terms(t)), {terms(w)[0] for w in needs}) for name, t, needs in TEMPLATES]
    df = Counter(w for _, c, _ in bags for w in c)
    idf = {w: math.log((1 + len(bags)) / (1 + n)) + 1 for w, n in df.items()}

    def vector(c):
        return {w: (1 + math.log(n)) * idf.get(w, math.log(1 + len(bags)) + 1) for w, n in c.items()}

    lines = text.split("\n")
    paragraphs, now = [], []
    for line in lines:
        now = [*now, line] if terms(line) else (paragraphs.append("\n".join(now)) or [])
    paragraphs.append("\n".join(now))
    sentences = [x for p in paragraphs for x in re.split(r"(?<=[!.:;?])(?=[\t\n\x0b\x0c\r ])", p)]
    best = (0.0, None)
    for unit in {*lines, *paragraphs, *sentences, *([text] if whole else [])}:
        c = Counter(terms(unit))
        v = vector(c)
        norm = math.sqrt(sum(x * x for x in v.values()))
        for name, bag, needs in bags:
            if v and needs <= set(c):
                u = vector(bag)
                cos = sum(x * u.get(w, 0) for w, x in v.items()) / norm / math.sqrt(sum(x * x for x in u.values()))
                if cos >= COSINE and (cos > best[0] + 1e-12 or abs(cos - best[0]) <= 1e-12 and name < best[1]):
                    best = (cos, name)
    return best


HEADERS = {
    "MIT": "// Copyright (c) 2020 Foo Bar\n//\n// Permission is hereby granted, free of charge, to any person\n// obtaining a copy of this software and associated documentation\n// files (the \"Software\"), to deal in the Software without\n// restriction, including without limitation the rights to use,\n// copy, modify, merge, publish, distribute, sublicense, and/or sell\n// copies of the Software, and to permit persons to whom the\n// Software is furnished to do so, subject to the following\n// conditions:\nint main(){}",
    "GPL-2.0": "/* foo.c\n * Copyright (C) 1999 Somebody\n *\n * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation; either version 2 of the License, or\n * (at your option) any later version.\n */",
    "GPL-3.0": "# Foo is free software: you can redistribute it and/or modify it under the terms of the\n# GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1": "/* This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either\n * version 2.1 of the License, or (at your option) any later version. */",
    "Apache-2.0": "/*\n * Copyright 2018 The Foo Authors. All rights reserved.\n *\n * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at\n *\n *     http://www.apache.org/licenses/LICENSE-2.0\n */",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n3. Neither the name of Foo Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n",
    "AGPL-3.0": "   GNU AFFERO GENERAL PUBLIC LICENSE\n      Version 3, 19 November 2007\n\n Copyright (C) 2007",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "ISC": "# SPDX-License-Identifier: ISC\nimport os",
    "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */",
}
NO_LICENCE = (
    "The MIT License is popular with some people, and others like the Apache License or the GNU project better.",
    "My friend is licensed under the state board to practice medicine.",
    "Mit. Mit dem Zug.",
    "Licensed under the Foo license.",
    "Ask the owner for permission before you copy, modify or sell the software.",
)


def test_licence_headers_and_prose(spark):
    from quern.llm import licenses

    texts = [*HEADERS.values(), *NO_LICENCE]
    for pad in ("", "some code here\n\n" * 300):
        df = spark.createDataFrame([(k, f"{pad}{t}\n\n{pad}") for k, t in enumerate(texts)], "doc_id long, text string")
        rows = {r.doc_id: r for r in licenses.scan(df, common.F.lit(None).cast("string")).collect()}
        assert [rows[k].license for k in range(len(texts))] == [*HEADERS, *[None] * len(NO_LICENCE)]
        for k, r in rows.items():
            cos, name = licence_by_hand(f"{pad}{texts[k]}\n\n{pad}")
            assert (r.license, round(r.cosine, 9)) == (name, round(cos, 9))


def test_licences_of_documents(spark, sf, docs):
    rows = {r.doc_id: r for r in queries()["op4_license_scan"](spark, sf).collect()}
    assert rows.keys() == docs.keys()
    for k, text in docs.items():
        if re.search("(?i)licen|copyright|permission|warrant|public domain|redistribut| cc |bsd|gpl", text) or k % 5 == 0:
            notice = bool(re.search("(?i)licen[sc]|copyright|public domain", text)) and len(text) < 400
            cos, name = licence_by_hand(text, notice)
            assert (rows[k].license if rows[k].origin == "own" else None, round(rows[k].cosine, 9)) == (name, round(cos, 9))
    told = {k for k, v in docs.items() if re.search(r"Licensed under|MIT License|is licensed under", v)}
    assert {k for k, r in rows.items() if r.origin == "own"} == told


def test_licence_inheritance(spark):
    from pyspark.sql import functions as F

    from quern.llm.licenses import scan

    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.py", "print"), (3, "a/b/COPYING", "Licensed under the Apache License, Version 2.0."), (4, "a/y.py", "z"), (5, "q/y.py", "z"), (6, "a/b/own.py", "# Licensed under CC BY-NC 4.0.\ncode"), (7, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, p string, text string")
    got = {r.doc_id: (r.license, r.origin) for r in scan(df, F.col("p")).collect()}
    assert got == {1: ("MIT", "own"), 2: ("Apache-2.0", "inherited"), 3: ("Apache-2.0", "own"), 4: ("MIT", "inherited"), 5: (None, "none"), 6: ("CC-BY-NC-4.0", "own"), 7: (None, "none")}


def test_pipeline(spark, sf, docs):
    import corpus_pipeline as p

    data = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in p.STAGES:
        data = p.materialize(stage(spark, data, sf), name)
        kept[name] = {r.doc_id for r in data.select("doc_id").collect()}
        if name != "best_fit_packing":
            assert set(data.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
    order = [kept[n] for n, _ in p.STAGES]
    assert all(b <= a for a, b in zip(order, order[1:])) and order[3] == order[4]
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(t in docs[k] for t in items for k in kept["decontamination"])
    best = {}
    for k in sorted(docs):
        best.setdefault(docs[k], k)
    assert kept["near_duplicates"] <= set(best.values())
