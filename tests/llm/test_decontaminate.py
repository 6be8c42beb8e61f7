"""Operator 8."""

import re

import numpy as np
from conftest_llm import sentence
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright.llm import decontaminate
from tablewright.llm.fmindex import FMIndex, suffix_array


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60), st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=4), min_size=1, max_size=10))
def test_index_finds_every_place(text, patterns):
    assert suffix_array(np.array([*text, 0])).tolist() == sorted(range(len(text) + 1), key=lambda i: [*text, 0][i:])
    index = FMIndex(np.array(text, np.int64), 2)
    lengths = np.array([len(p) for p in patterns])
    low, high = index.ranges(np.concatenate([np.array(p) for p in patterns]), np.cumsum(lengths) - lengths, lengths)
    for p, a, b in zip(patterns, low, high):
        want = [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)] == p]
        assert sorted(index.locate(np.arange(a, b)).tolist() if b > a else []) == want


def _words(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))


def _brute(text, items):
    words, hit, found = _words(text), set(), set()
    for item, t in items:
        w = _words(t)
        n = min(13, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[a : a + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


ITEMS = [(1, sentence("en", 500, 40)), (2, sentence("de", 501, 13)), (30, "Short item, HERE!"), (4, ""), (5, None), (6, sentence("en", 500, 20)), (7, "..."), (8, "naïve"), (30, "short item here")]


def _documents(spark):
    long, exact = _words(ITEMS[0][1]), _words(ITEMS[1][1])
    texts = [
        ITEMS[0][1], "x " * 300 + " ".join(long[5:18]) + " y" * 300, " ".join(long[5:17]), " ".join(exact).upper(), "a short item, here it is. " * 3, "na\u00efve, NA\u00cfVE", "short item", " ".join(long[:20]) + " q " + " ".join(long[3:30]),
    ]
    return spark.createDataFrame([(200 + i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_agrees_with_brute_force(spark, odd, prose):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = _documents(spark).unionAll(prose.limit(20)).unionAll(odd.where("doc_id <> 6 or doc_id is null"))
    for most in (1 << 20, 300, 60):  # all at once, and a few items at a time, in one pass or more
        got = decontaminate.find(docs, benchmark, F.col("doc_id"), F.col("text"), most=most).collect()
        assert len(got) == docs.count()
        for r in got:
            n, hit, items = _brute(r["text"], ITEMS)
            assert (r["n_words"], r["n_hit"], r["items"]) == (n, hit, items), r["key"]
            assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
            assert sum(s["end"] - s["start"] for s in r["spans"]) == hit


def test_clean_documents_stay_unchanged(spark, prose, empty):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = _documents(spark).unionAll(prose).withColumn("items", F.lit("clash")).withColumn("a`b.c", F.lit(1))
    kept = decontaminate.clean_documents(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted([*range(150), 201, 202, 206])
    assert decontaminate.clean_documents(empty, benchmark).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find(docs, none, F.col("doc_id"), F.col("text")).where("n_hit > 0").count() == 0
