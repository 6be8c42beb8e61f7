"""Operators 7 and 9."""

import itertools
import re

import numpy as np
import pytest
import xxhash
from conftest_llm import sentence
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright.llm import linededup, simhash


def _fingerprint(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(low))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _classes(numbers, budget=3):
    label = list(range(len(numbers)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(numbers)), 2):
        if bin(numbers[i] ^ numbers[j]).count("1") <= budget:
            a, b = root(i), root(j)
            label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(numbers))]


def test_fingerprints_and_classes(spark, odd, prose):
    near = spark.createDataFrame([(700 + i, sentence("en", 0, 400).replace("house", "hut", i), "en", "s", 1) for i in range(6)], prose.schema)
    docs = odd.unionAll(prose).unionAll(near)
    got = simhash.classes(docs, F.struct("doc_id", "text"), F.col("text")).collect()
    assert len(got) == docs.count()
    found = [_fingerprint(r["key"]["text"] or "") for r in got]
    assert [r["fp"] % (1 << 64) for r in got] == found
    least = {}
    for r, c in zip(got, _classes(found)):
        key = (r["key"]["doc_id"] is not None, r["key"]["doc_id"] or 0, r["key"]["text"] is not None, (r["key"]["text"] or "").encode())
        least[c] = min(key, least.get(c, key))
    for r, c in zip(got, _classes(found)):
        assert (r["least"]["doc_id"], r["least"]["text"]) == (least[c][1] if least[c][0] else None, least[c][3].decode() if least[c][2] else None)


@pytest.mark.parametrize("limit", [16_384, 20])
def test_links_lose_none(spark, limit):
    rng = np.random.default_rng(5)
    numbers = set()
    for base in rng.integers(0, 1 << 63, 25, dtype=np.uint64).tolist():
        for _ in range(24):
            x = base
            for k in rng.integers(0, 64, rng.integers(0, 9)).tolist():
                x ^= 1 << k
            numbers.add(x)
    numbers = sorted(numbers)
    frame = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in numbers], "fp long")
    root = {r["u"] % (1 << 64): r["root"] % (1 << 64) for r in simhash.components(simhash.links(frame, limit=limit)).collect()}
    parts = lambda label: sorted(sorted(x for x, _ in g) for _, g in itertools.groupby(sorted(zip(numbers, label), key=lambda p: p[1]), key=lambda p: p[1]))
    assert parts([root.get(x, x) for x in numbers]) == parts([numbers[i] for i in _classes(numbers)])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, (1 << 12) - 1), min_size=1, max_size=60, unique=True), st.integers(0, 3))
def test_walk_finds_what_comparing_finds(numbers, budget):
    numbers = np.sort(np.array(numbers, np.uint64))
    seen = set()
    simhash.LEAF_PAIRS, kept = 4, simhash.LEAF_PAIRS
    try:
        simhash.walk(numbers, None, 11, 0, budget, lambda i, j: seen.update(zip(i.tolist(), j.tolist())))
    finally:
        simhash.LEAF_PAIRS = kept
    for i, j in itertools.combinations(range(len(numbers)), 2):
        near = bin(int(numbers[i]) ^ int(numbers[j])).count("1") <= budget
        assert near == ((i, j) in seen or (j, i) in seen)


def test_one_of_each(odd, empty, prose):
    docs = odd.unionAll(prose).withColumn("least", F.lit("clash"))
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    texts = [r["text"] for r in got.collect()]
    assert texts.count("same text in two rows") == 1 and texts.count("no id at all") == 1 and sum(not (t or "").split() for t in texts) == 1
    assert got.where("text = 'same text in two rows'").first()["doc_id"] == 8
    assert simhash.one_of_each(empty).count() == 0


def _dedup(docs, least=50):
    """Kept texts by brute force: every run of lines with enough words that begins at an earlier place goes."""
    lines = {d: (t or "").split("\n") for d, t in docs}
    count = {d: [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in ls] for d, ls in lines.items()}
    first, gone = {}, set()
    for d in sorted(lines):
        for a in range(len(lines[d])):
            for b in range(a + 1, len(lines[d]) + 1):
                if sum(count[d][a:b]) >= least:
                    run = tuple(lines[d][a:b])
                    if run in first:
                        gone |= {(d, i) for i in range(a, b)}
                    first.setdefault(run, (d, a))
    return {d: ("\n".join(x for i, x in enumerate(ls) if (d, i) not in gone), sum((d, i) in gone for i in range(len(ls)))) for d, ls in lines.items()}


def _by_suffix_array(docs, least=50):
    """The same from a suffix array: in each interval of common prefixes of m lines and enough words all but the first go."""
    lines = {d: (t or "").split("\n") for d, t in docs}
    count = {d: [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in ls] for d, ls in lines.items()}
    order = sorted((ls[a:], d, a) for d, ls in lines.items() for a in range(len(ls)))
    gone = set()
    for m in range(1, max(map(len, lines.values())) + 1):
        interval = []
        for x in [*order, (None, None, None)]:
            fits = x[0] is not None and len(x[0]) >= m
            if interval and not (fits and x[0][:m] == interval[0][0][:m]):
                if sum(count[interval[0][1]][interval[0][2] : interval[0][2] + m]) >= least:
                    for _, d, a in sorted(interval, key=lambda y: y[1:])[1:]:
                        gone |= {(d, a + i) for i in range(m)}
                interval = []
            if fits:
                interval.append(x)
    return {d: ("\n".join(x for i, x in enumerate(ls) if (d, i) not in gone), sum((d, i) in gone for i in range(len(ls)))) for d, ls in lines.items()}


def test_line_dedup_agrees_with_brute_force(spark, empty):
    rng = np.random.default_rng(3)
    pool = [sentence("en", s, int(n)).replace("\n", " ") for s, n in enumerate(rng.integers(3, 60, 14))] + ["", "", "x"]
    docs = [(i, "\n".join(pool[k] for k in rng.integers(0, len(pool), rng.integers(1, 12)))) for i in range(60)]
    shared = "\n".join(pool[:6])
    docs += [(100, shared), (101, "head\n" + shared + "\ntail"), (102, shared), (103, None), (104, ""), (105, "\n\n")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({x: F.lit("clash") for x in ("s", "__i", "__t", "__gone", "i", "t", "gone", "row", "a`b")}).repartition(5)
    got = {r["row"]["doc_id"]: r for r in linededup.cleaned(frame).collect()}
    for d, (text, n) in _dedup(docs).items():
        assert (got[d]["text"] or "", got[d]["n_gone"]) == (text, n), d
    assert got[103]["text"] is None and got[105]["n_lines"] == 3
    whole = linededup.without_copies(frame)
    assert whole.columns == frame.columns and all(r["__i"] == r["a`b"] == "clash" and r["text"] == got[r["doc_id"]]["text"] for r in whole.collect())
    assert {d: x for d, (x, _) in _by_suffix_array(docs).items()} == {d: x for d, (x, _) in _dedup(docs).items()}
    assert linededup.without_copies(empty).count() == 0


def test_line_dedup_of_odd_rows(odd):
    got = linededup.cleaned(odd.select("doc_id", "text"))
    assert got.count() == odd.count() and got.where("n_gone > 0").count() == 0
