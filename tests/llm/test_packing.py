"""Operator 3."""

import collections
import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablewright.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


PARTS = st.sampled_from([" ", "  ", "\n", "\t", "a", "word", "don't", "é", "ß", "12", ",", "<|endoftext|>", "!", "x1", "日本", "\r\n", "   ", "\u00a0", " \u2003", "\U0001f600"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_ids_are_those_of_the_library(text):
    from tokenizers import Tokenizer

    if not hasattr(packing, "_library"):
        packing._library = Tokenizer.from_file(PATH)
    assert packing.ids_of_file(PATH).of(text).tolist() == packing._library.encode(text, add_special_tokens=False).ids


def _check(pieces, documents, size):
    """Every id once, sequences without gaps; returns the padding."""
    by_sequence, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for doc, start, length, crc, total, sequence, offset, _ in pieces:
        by_sequence[sequence].append((offset, length))
        by_doc[doc].append((start, length, crc, total))
    for doc, ids in documents:
        at = 0
        for start, length, crc, total in sorted(by_doc[doc]):
            assert start == at and total == len(ids) and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    padding = 0
    for spans in by_sequence.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end and length > 0
            end += length
        assert end <= size
        padding += size - end if end & (end - 1) else 0
    return padding


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=60), st.sampled_from([1, 2, 5, 64]))
def test_packing_keeps_every_id(lengths, most_open):
    documents = [(i, np.arange(n, dtype="<u4")) for i, n in enumerate(lengths)]
    assert _check(list(packing.pack(iter(documents), 16, most_open=most_open)), documents, 16) == 0


@pytest.mark.parametrize("low, high, n, least", [(520, 1_000, 2_000, 0.9), (520, 1_000, 400, 0.9), (1, 1_024, 1_000, 0.9), (30, 300, 1_000, 0.9)])
def test_most_ids_lie_where_the_rule_put_them(low, high, n, least):
    rng = np.random.default_rng(6)
    documents = [(i, np.arange(k, dtype="<u4")) for i, k in enumerate(rng.integers(low, high, n).tolist())]
    pieces = list(packing.pack(iter(documents)))
    assert _check(pieces, documents, 1024) == 0
    assert 1 - sum(p[2] for p in pieces if p[7]) / sum(p[2] for p in pieces) >= least


def test_open_sequences_are_bounded():
    held = []
    packer = packing.LevelPacker(1024)
    for n in np.random.default_rng(1).integers(520, 1_000, 500).tolist():
        place = packer.place(int(n), packer.opened < 64)
        if place is None:
            _, level = packer.fill()
            assert 0 < level < 1024 and n > 1024 - level
        held.append(packer.opened)
    assert max(held) == 64


def test_other_vocabularies_are_refused(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"merges": spec["model"]["merges"][::-1]}}):
        (tmp_path / "other.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            packing.Ids(str(tmp_path / "other.json"))


def test_placement_is_the_sum_of_squares_rule():
    packer, rng = packing.LevelPacker(32), np.random.default_rng(2)
    for n in rng.integers(1, 32, 400):
        before = packer.count.copy()
        _, level = packer.place(int(n))

        def cost(h):
            after = before.copy()
            if h:
                after[h] -= 1
            if h + n < 32:
                after[h + n] += 1
            return (after**2).sum()

        options = [0, *(h for h in range(1, 32 - n + 1) if before[h])]
        assert cost(level) == min(map(cost, options)) and (packer.count**2).sum() == cost(level)


def test_documents(spark, odd, prose, empty, reference):
    docs = odd.unionAll(prose).where("doc_id is not null and doc_id <> 8 or lang = 'de'").dropDuplicates(["doc_id"]).repartition(3)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    pieces = [tuple(r) for r in packing.pack_documents(docs, PATH).collect()]
    documents = [(i, [*reference.encode(t, add_special_tokens=False).ids, 0]) for i, t in texts.items()]
    assert _check(pieces, documents, 1024) == 0
    assert packing.pack_documents(empty, PATH).count() == 0
    assert packing.pack_documents(odd, PATH).where("doc_id is null and start = 0").count() == 3
