"""References of operator 2: every language has one, with words counted over all documents."""

import collections

import numpy as np
from pyspark.sql import functions as F

from tablewright.llm import blocks, quality


def test_every_language_has_a_reference_over_all_documents(spark, monkeypatch):
    rows, words = [], {}
    for k in range(40):
        # the 64 most frequent words of a language lie in few of its documents
        own = collections.Counter({f"l{k}w{w}": 200 - w for w in range(100)})
        words[f"l{k}"] = [w for w, _ in own.most_common(64)]
        pool = np.random.default_rng(k).permutation(list(own.elements()))
        rows += [(f"l{k}", " ".join(x)) for x in np.array_split(pool, 60 - k)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = quality.fit(docs, F.col("text"), F.col("lang"))
    assert sorted(got.languages) == sorted(words)
    want = [blocks.fingerprints(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0] for own in words.values() for w in own]
    assert np.array_equal(got.words, np.unique(np.array(want, np.uint64)))
    whole = sorted(quality.judge(docs, F.col("text"), F.col("text"), got).collect())
    assert all(r["kept"] for r in whole if not r["base_failed"])
    monkeypatch.setattr(quality, "CELLS", 10_000)
    assert sorted(quality.judge(docs, F.col("text"), F.col("text"), got).collect()) == whole
