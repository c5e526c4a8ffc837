"""The ledger against a plain reading of each text, policies and ablations against the rows."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import rules

TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "a b c a b c",
    "x " * 60,
    "word " * 20 + "\n\n" + "line two\n" * 40,
    " ".join(f"w{i}" for i in range(55)),
    " ".join(f"w{i}#$%" for i in range(55)),
    " ".join(f"SHOUT{chr(65 + i % 26)}{chr(65 + i // 26)}" for i in range(60)),
    " ".join(f"ä{i}日本 x y\x85z\x1c" for i in range(60)),
    "\r\n".join(f"same {i % 3}" for i in range(60)),
    " ".join(f"word{i}" for i in range(30_000)) + " a b c d a b c d",
]


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    again = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again), len(lines), len(re.findall("[A-Z]", text or ""))


@given(st.text(alphabet=st.sampled_from("ab#A \n\t é日"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_measures_of_any_text(text):
    assert rules.measured(text.encode()) == plain(text)


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_measures_do_not_depend_on_pieces(size, monkeypatch):
    monkeypatch.setattr(rules, "CHUNK_BYTES", size)
    for text in TEXTS:
        assert rules.measured((text or "").encode()) == plain(text)


def test_windows_of_very_many_different_words():
    words = [str(i) for i in range((1 << 20) + 5)] + ["1", "2", "3", "4"]
    assert rules.repeat_words(" ".join(words).encode()) == (len(words), 8)


@pytest.fixture(scope="module")
def entries(spark):
    rows = [(None if k == 3 else k // 2, t) for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "n", "failed", "n_words", "rule", "kept")})
    return rules.ledger(docs).cache()


def test_hostile_rows(entries):
    got = sorted(((r.doc_id, *(r[m] for m in rules.MEASURES)) for r in entries.collect()), key=repr)
    assert got == sorted(((None if k == 3 else k // 2, *plain(t)) for k, t in enumerate(TEXTS)), key=repr)


def bits(row):
    n, chars, symbols, dup, again, lines, capitals = (row[m] for m in rules.MEASURES)
    return {
        "few_words": n < 50,
        "repeated_words": again * 100 > n * 50,
        "symbols": symbols * 100 > n * 10,
        "word_length": chars < n * 3 or chars > n * 10,
        "repeated_lines": dup * 100 > lines * 50,
        "capitals": capitals * 100 > chars * 30,
        "many_words": n > 1_000_000,
    }


def test_bits_policies_and_ablations(entries):
    rows = entries.collect()
    for r in rows:
        assert r.failed == sum(1 << k for k, bad in enumerate(bits(r).values()) if bad)
    assert all(any(bits(r)[name] for r in rows) for name in rules.POLICIES["v3"])
    for version, names in rules.POLICIES.items():
        kept = lambda r, without=None: not any(bits(r)[x] for x in names if x != without)
        assert sorted(r.kept for r in rules.applied(entries, version).collect()) == sorted(kept(r) for r in rows)
        got = {r.rule: r for r in rules.ablations(entries, version).collect()}
        assert set(got) == set(names)
        for name, r in got.items():
            assert (r.n, r.failing) == (len(rows), sum(bits(x)[name] for x in rows))
            assert (r.kept, r.kept_without) == (sum(map(kept, rows)), sum(kept(x, name) for x in rows))
            assert r.only == r.kept_without - r.kept


def test_changes_between_versions(entries):
    rows = entries.collect()
    kept = lambda r, v: not any(bits(r)[x] for x in rules.POLICIES[v])
    for r in rules.changes(entries, "v1", "v3").collect():
        own = [x.failed for x in rows if (kept(x, "v1"), kept(x, "v3")) == (r.kept_before, r.kept_after)]
        either, both = 0, -1
        for x in own:
            either, both = either | x, both & x
        assert (r.n, r.failed_any, r.failed_all) == (len(own), either, both)


def test_no_rows(spark):
    none = rules.ledger(spark.createDataFrame([], "doc_id long, text string"))
    assert none.count() == rules.ablations(none, "v3").count() == rules.changes(none, "v1", "v2").count() == 0


def test_clean_documents_stay(spark, sf):
    larger = sf.replace("sf0.001", "sf0.01")
    docs = rules.op13_rule_ledger(spark, larger).join(spark.read.parquet(f"{larger}/labels.parquet"), "doc_id")
    good = docs.where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r.quality: r.kept for r in good}
    assert share[1] > 0.99 and share[0] < 0.1
