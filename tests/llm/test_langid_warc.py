"""Operators 4 and 5."""

import base64
import gzip
import hashlib
import io
import json
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import sentence
from pyspark.sql import functions as F

from tablewright.llm import blocks, langid, warc
from tablewright.llm.shared import crc_fold


@pytest.fixture(scope="module")
def model(prose):
    return langid.fit(prose, F.col("text"), F.col("lang"), F.col("doc_id") % 5 != 0)


def test_held_out_accuracy(prose, model):
    got = langid.label(prose.where("doc_id % 5 = 0"), F.struct("doc_id", "lang"), F.col("text"), model).collect()
    assert all(r["lang_pred"] == r["key"]["lang"] and 0.8 < r["score"] <= 1 for r in got) and len(got) == 30


def test_switched_text(spark, model):
    text = sentence("fr", 3, 90) + " " + sentence("de", 4, 30)
    r = langid.label(spark.createDataFrame([(1, text)], "k long, text string"), F.col("k"), F.col("text"), model).first()
    assert r["lang_pred"] == "fr" and 0.6 < r["score"] < 0.9 and 20 < r["other_words"] < 40


def test_odd_texts(odd, empty, prose, model):
    got = langid.label(odd, F.struct("doc_id", "text"), F.col("text"), model).collect()
    assert len(got) == odd.count()
    for r in got:
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, r["key"]["text"] or ""))) and 0 <= r["score"] <= 1
    assert langid.label(empty, F.col("doc_id"), F.col("text"), model).count() == 0
    nothing = langid.fit(empty, F.col("text"), F.col("lang"), F.lit(True))
    assert {r["lang_pred"] for r in langid.label(odd, F.col("doc_id"), F.col("text"), nothing).collect()} == {"und"}
    wide = prose.withColumn("score", F.lit("clash"))
    assert langid.keep_known(wide, model).count() == 150 and langid.keep_known(wide, model).columns == wide.columns


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    scores, moves = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    got, sums, log_z = langid.forward_backward(scores, np.arange(5)[:, None], np.array([5]), moves, pairs=True)
    total, marginal, pair = 0.0, np.zeros((5, 3)), np.zeros((3, 3))
    for path in np.ndindex(*[3] * 5):
        weight = np.exp(sum(scores[t, k] for t, k in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        total += weight
        for t, k in enumerate(path):
            marginal[t, k] += weight
        for a, b in zip(path, path[1:]):
            pair[a, b] += weight
    assert np.allclose(got[:, 0], marginal / total) and np.allclose(sums, pair / total) and np.isclose(log_z, np.log(total))


PAGES = [(1, "http://a/", "x"), (5, "http://b/ü\r\nEvil: 1", "x"), (3, None, "x"), (2, "u", ""), (4, "u", None), (6, "u", "é" * 5000), (7, "u", "a\r\n\r\nb"), (None, "u", "x"), (8, "u", "r"), (8, "v", "r"), (None, "n", "only null")]


def _want(min_bytes):
    top = {}
    for i, _, h in PAGES:
        p = (h or "").encode()
        if i is not None and len(p) >= min_bytes:
            top[p] = max(i, top.get(p, i))
    rows = []
    for i, _, h in PAGES:
        p = (h or "").encode()
        kept = top.get(p) if len(p) >= min_bytes else None
        refers = kept if kept is not None and (i is None or i < kept) else None
        rows.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(rows, key=str)


@pytest.mark.parametrize("min_bytes", [0, 2])
def test_round_trip(spark, min_bytes):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, payload string").repartition(3)
    assert sorted((tuple(r) for r in warc.round_trip(pages, min_bytes).collect()), key=str) == _want(min_bytes)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_normaliser_reads_any_split_into_members():
    records = [warc.record(i, "u", b"p" * (i * 70_000), None if i else 7) for i in range(4)]
    whole = gzip.compress(b"".join(records))
    split = gzip.compress(records[0] + records[1][:100]) + gzip.compress(records[1][100:] + records[2] + records[3])
    for source in (whole, split):
        target = io.BytesIO()
        index = list(warc.normalise(io.BytesIO(source), target))
        data = target.getvalue()
        assert [gzip.decompress(data[x["position"] : x["position"] + x["size"]]) for x in index] == records
        assert index[-1]["position"] + index[-1]["size"] == len(data) and json.dumps(index)
    with pytest.raises(EOFError):
        list(warc.normalise(io.BytesIO(gzip.compress(records[1][:-50])), io.BytesIO()))
    assert list(warc.normalise(io.BytesIO(gzip.compress(b"")), io.BytesIO())) == []


def test_labels_of_a_long_text_are_those_of_one_chain(model):
    words = np.random.default_rng(5).permutation((sentence("fr", 3, 4_000) + " " + sentence("de", 4, 4_000) + " " + sentence("en", 5, 2_000) + " 12 ?").split())
    texts = pa.array([" ".join(words), "der fluss", "", sentence("en", 8, 300)])
    block = blocks.block_of(*blocks.column_bytes(texts), langid._TABLE)
    share, best, counted = langid.label_block(block, model)
    _, index, number = np.unique(block.hashes(), return_index=True, return_inverse=True)
    feature, word = langid.word_features(block.raw, block.starts[index], block.ends[index], model.lexicons)
    scores = langid.evidence(feature, word, len(index), model.weights)
    for d in range(len(texts)):
        at = np.arange(block.word_at[d], block.word_at[d + 1])
        if not len(at):
            assert not share[d].any() and not counted[d]
            continue
        whole = langid.forward_backward(scores, number[at][:, None], np.array([len(at)]), model.moves)[:, 0]
        lettered = np.array([any(c.isalpha() for c in block.word(i).decode()) for i in at])
        assert counted[d] == lettered.sum() and np.allclose(share[d], whole[lettered].sum(axis=0), rtol=1e-4)
        assert np.array_equal(best[d], np.bincount(whole[lettered].argmax(axis=1), minlength=3))


def test_pieces_and_whole_texts_agree(model, monkeypatch):
    texts = pa.array([sentence("fr", 3, 700) + " " + sentence("de", 4, 500), sentence("en", 8, 300)])
    block = blocks.block_of(*blocks.column_bytes(texts), langid._TABLE)
    pieces = langid.label_block(block, model)
    monkeypatch.setattr(langid, "MATRIX_LABELS", 0)
    for a, b in zip(pieces, langid.label_block(block, model)):
        assert np.allclose(a, b, rtol=1e-4)


def test_languages_of_long_texts_and_behind_copies_are_learned(spark, prose):
    rows = [(1_000 + i, sentence("de", i, 16_000), "de") for i in range(6)] + [(2_000 + i, sentence("en", i), "en") for i in range(100)] + [(3_000 + i, sentence("fr", i), "fr") for i in range(30)]
    copies = spark.range(100_000).select((F.col("id") + 10_000).alias("doc_id"), F.lit(sentence("fr", 77)).alias("text"), F.lit("fr").alias("lang"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").unionAll(copies)
    many = langid.fit(docs, F.col("text"), F.col("lang"), F.lit(True))
    assert many.languages == ["de", "en", "fr"]
    got = langid.label(prose.where("doc_id < 30"), F.col("lang"), F.col("text"), many).collect()
    assert all(r["lang_pred"] == r["key"] for r in got)


def test_any_number_of_languages(spark):
    rows = [(f"l{k:02}", " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{x}" for x in "abcdefghijkl" * 3)) for k in range(70)]
    frame = spark.createDataFrame(rows, "lang string, text string")
    model = langid.fit(frame, F.col("text"), F.col("lang"), F.lit(True))
    assert len(model.languages) == 70
    assert all(r["key"] == r["lang_pred"] for r in langid.label(frame, F.col("lang"), F.col("text"), model).collect())


def test_text_column_of_another_case(spark, prose, model):
    renamed = prose.withColumnRenamed("text", "Text")
    assert langid.keep_known(renamed, model).columns == renamed.columns


def test_folds_are_those_of_crc32(spark):
    ids = [0, 1, -1, 12345678901, None, *range(100, 200)]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", crc_fold(F.col("doc_id"), 5).alias("five"), crc_fold(F.col("doc_id"), 7).alias("seven")).collect()
    for r in rows:
        x = 0 if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode())
        assert (r["five"], r["seven"]) == (x % 5, x % 7)
