"""Benchmark decontamination: test phrases searched backwards in an FM-index of every shard of training text.

A shard is a block of whole texts of one Spark partition. Words that no test phrase holds, text ends and stretches
shorter than the shortest phrase become separators, the rest is indexed, every phrase is a range of the index,
and its places are located by sampled suffix positions; places merge into removal spans. The benchmark is sent to the tasks
in tables of bounded size, a few for each pass over the documents, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm import blocks
from tablewright.llm.fmindex import FMIndex
from tablewright.llm.shared import map_arrow, named, text_column, whole_row

WINDOW = 13
#: Bytes of benchmark text that make one phrase table (about four bytes each there), and tables that one pass searches.
BENCHMARK_BYTES = 8 << 20
TABLES = 4
SHARD_BYTES = 1 << 20
#: Places that are located at once.
PLACES = 1 << 20


@dataclass
class Phrases:
    """The distinct windows of some benchmark items: stretches of the items' words."""

    vocabulary: np.ndarray  # sorted fingerprints of their words
    words: np.ndarray  # all items' words as numbers from 2 on
    begin: np.ndarray  # of each window
    lengths: np.ndarray
    owners: np.ndarray  # numbers of the items of each window, one after the other
    owned: np.ndarray  # where each window's begin
    items: list[str]


def phrases(items: list[tuple[str, str]], window: int = WINDOW) -> Phrases | None:
    """Windows of ``window`` words; an item with fewer words, but some, is one window. None if there are no words."""
    texts = pa.array([text for _, text in items], pa.string())
    table = blocks.split_table(blocks.NOT_ALNUM, lower=True)
    hashes, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for block in blocks.blocks(texts, table):
        hashes.append(block.hashes())
        counts.append(np.diff(block.word_at))
    vocabulary, words = np.unique(np.concatenate(hashes), return_inverse=True)
    if not len(vocabulary):
        return None
    words, count = (words.ravel() + 2).astype(np.int32), np.concatenate(counts)
    many = np.where(count > 0, np.maximum(1, count - window + 1), 0)
    owner = np.repeat(np.arange(len(count)), many)
    begin = np.arange(int(many.sum())) + np.repeat(np.cumsum(count) - count - np.cumsum(many) + many, many)
    length = np.minimum(count, window)[owner]
    rows = np.append(words, np.zeros(window, np.int32))[begin[:, None] + np.arange(window)]
    rows[np.arange(window) >= length[:, None]] = 0
    _, index, same = np.unique(np.ascontiguousarray(rows).view(f"V{4 * window}").ravel(), return_index=True, return_inverse=True)
    order = np.lexsort((owner, same))
    owned = np.append(0, np.cumsum(np.bincount(same, minlength=len(index))))
    return Phrases(vocabulary, words, begin[index].astype(np.int32), length[index].astype(np.int32), owner[order].astype(np.int32), owned, [x for x, _ in items])


def _search(block: blocks.Block, found: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words of a block are hit, and pairs (text, item number) that occur."""
    n = len(block.starts)
    mark = np.zeros(n + 1, np.int64)
    hashes = block.hashes()
    at = np.minimum(np.searchsorted(found.vocabulary, hashes), len(found.vocabulary) - 1)
    known = found.vocabulary[at] == hashes
    # stretches of known words within a text
    begins = known.copy()
    begins[1:] &= ~known[:-1]
    first = block.word_at[:-1][np.diff(block.word_at) > 0]
    begins[first] |= known[first]
    begin = np.flatnonzero(begins)
    stops = np.flatnonzero(~known | np.isin(np.arange(n), first))
    after = np.append(stops, n)
    end = after[np.searchsorted(after, begin, side="right")]
    long = end - begin >= int(found.lengths.min())
    begin, end = begin[long], end[long]
    if not len(begin):
        return mark[:n] > 0, np.empty(0, np.int64), np.empty(0, np.int64)
    sizes = end - begin + 1  # with a separator behind each
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begin, sizes)
    last = np.cumsum(sizes) - 1
    text = np.ones(len(place), np.int64)
    inner = np.ones(len(place), bool)
    inner[last] = False
    text[inner] = at[place[inner]] + 2
    index = FMIndex(text, int(len(found.vocabulary) + 2).bit_length())
    low, high = index.ranges(found.words, found.begin, found.lengths)
    some = np.flatnonzero(low < high)
    if not len(some):
        return mark[:n] > 0, np.empty(0, np.int64), np.empty(0, np.int64)
    sums = np.append(0, np.cumsum(high[some] - low[some]))
    pairs = []
    text_of = block.text_of_word()
    i = 0
    while i < len(some):
        j = max(i + 1, int(np.searchsorted(sums, sums[i] + PLACES, side="right")) - 1)
        count = (high - low)[some[i:j]]
        which = np.repeat(some[i:j], count)
        rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[some[i:j]], count)
        where = place[index.locate(rows)]
        np.add.at(mark, where, 1)
        np.add.at(mark, where + found.lengths[which], -1)
        pairs.append(np.unique(text_of[where] * len(found.begin) + which))
        i = j
    code = np.unique(np.concatenate(pairs))
    doc, which = code // len(found.begin), code % len(found.begin)
    many = found.owned[which + 1] - found.owned[which]
    owner = found.owners[np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(found.owned[which], many)]
    both = np.unique(np.repeat(doc, many) * len(found.items) + owner)
    return np.cumsum(mark[:n]) > 0, both // len(found.items), both % len(found.items)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FOUND = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"


def _merge(spans: list[tuple[int, int]]) -> list[dict]:
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [{"start": a, "end": b} for a, b in merged]


def _pass(rows: DataFrame, tables: list[Phrases]) -> DataFrame:
    """``rows`` (key, text, n_words, spans, items) with what these phrases add."""
    sent = [rows.sparkSession.sparkContext.broadcast(x) for x in tables]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = blocks.split_table(blocks.NOT_ALNUM, lower=True)
        for batch in batches:
            texts = text_column(batch, "text")
            counts = np.zeros(batch.num_rows, np.int64)
            spans, items = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for block in blocks.blocks(texts, table, SHARD_BYTES):
                counts[block.first : block.first + block.texts] = np.diff(block.word_at)
                if not len(block.starts):
                    continue
                for known in (x.value for x in sent):
                    hit, doc, item = _search(block, known)
                    for d, i in zip(doc.tolist(), item.tolist()):
                        items[block.first + d].append(known.items[i])
                    for d in np.unique(doc).tolist():
                        flags = np.concatenate([[0], hit[block.word_at[d] : block.word_at[d + 1]].astype(np.int8), [0]])
                        edge = np.flatnonzero(np.diff(flags)).tolist()
                        old = [(x["start"], x["end"]) for x in spans[block.first + d]]
                        spans[block.first + d] = _merge([*old, *zip(edge[::2], edge[1::2])])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], ["key", "text", "n_words", "spans", "items"])

    return map_arrow(rows, step, T.StructType([rows.schema["key"], *T.StructType.fromDDL(f"text string, {FOUND}").fields]))


def benchmark_blocks(benchmark: DataFrame, most: int = BENCHMARK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """(item_id, text) in blocks of about ``most`` bytes; null texts have no words, null ids are the empty string."""
    items = benchmark.select(F.coalesce(benchmark["item_id"].cast("string"), F.lit("")).alias("i"), benchmark["text"].cast("string").alias("t")).where("t is not null")
    total = items.agg(F.sum(F.octet_length("t") + F.octet_length("i") + 64)).first()[0] or 0
    parts = max(1, -(-total // most))
    for k in range(parts):
        mine = items if parts == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k)
        yield [(r["i"], r["t"]) for r in mine.collect()]


def find(docs: DataFrame, benchmark: DataFrame, key: Column, text: Column, window: int = WINDOW, most: int = BENCHMARK_BYTES) -> DataFrame:
    """(key, text, n_words, spans, items, n_hit, contaminated) for every row.

    ``spans`` are merged runs [start, end) of word numbers inside occurrences of windows, ``items`` the distinct ids of items
    with an occurring window, sorted as strings. A text is contaminated if it is hit and at least one in twenty of its
    words is. Null texts have no words; repeated rows are judged each; an empty benchmark hits nothing.
    """
    empty = "array()"
    rows = docs.select(key.alias("key"), text.cast("string").alias("text"), F.lit(0).cast("bigint").alias("n_words"), F.expr(f"cast({empty} as array<struct<start:bigint,end:bigint>>)").alias("spans"), F.expr(f"cast({empty} as array<string>)").alias("items"))
    held: list[Phrases] = []
    passed = False
    for block in benchmark_blocks(benchmark, most):
        held += [x for x in [phrases(block, window)] if x is not None]
        if len(held) == TABLES:
            rows, held, passed = _pass(rows, held), [], True
    if held or not passed:
        rows = _pass(rows, held)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    told = rows.withColumn("items", F.array_sort(F.array_distinct("items"))).withColumn("n_hit", n_hit)
    return told.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_name: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated. Null and empty texts stay, repeated rows are judged each."""
    kept = find(docs, benchmark, whole_row(docs), named(text_name)).where(~F.col("contaminated"))
    return kept.select("key.*")
