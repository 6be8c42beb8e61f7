"""Quality rules: counts of a text, and its divergence from references of the languages.

A reference is the histogram of character classes and of common words over all documents of a language that
pass the counting rules. A text is far from all languages if the Jensen-Shannon distance of its histograms to the
nearest reference is above a limit; texts too short for a histogram are not judged by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm import blocks
from tablewright.llm.shared import map_arrow, text_column

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
#: Per cent of words in repeated windows above which a text fails.
MOST_REPEATED = 50
REPEAT_WINDOW = 3
#: Common words of a language.
COMMON_WORDS = 64
#: Cells of histograms that are made at once.
CELLS = 1 << 21
#: Texts with fewer characters or words aren't judged by the histogram of these.
MIN_CHARS = 200
MIN_HISTOGRAM_WORDS = 50
MOST_CHAR_DISTANCE = 0.30
MOST_WORD_DISTANCE = 0.50

#: Classes of bytes, by their first members; continuation bytes of UTF-8 have none.
CLASSES = ["lower vowel", "lower consonant", "upper", "digit", "space", "line", "stop", "quote or dash", "bracket", "symbol", "control", "latin", "other script"]


def class_table() -> np.ndarray:
    table = np.full(256, CLASSES.index("control"), np.uint8)
    sets = {"lower vowel": b"aeiouy", "digit": b"0123456789", "space": b" \t", "line": b"\n\r", "stop": b".,;:!?", "quote or dash": b"\"'`-_", "bracket": b"()[]{}"}
    table[97:123] = CLASSES.index("lower consonant")
    table[65:91] = CLASSES.index("upper")
    table[list(b"#*$%&|<>/\\@+=~^")] = CLASSES.index("symbol")
    for name, members in sets.items():
        table[list(members)] = CLASSES.index(name)
    table[0x80:0xC0] = len(CLASSES)
    table[0xC0:0xC6] = CLASSES.index("latin")
    table[0xC6:] = CLASSES.index("other script")
    return table


@dataclass
class References:
    languages: list[str]
    words: np.ndarray  # sorted fingerprints of common words
    char_shares: np.ndarray
    word_shares: np.ndarray  # the last is all other words


def counts(block: blocks.Block, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """The counting rules of every text of a block."""
    raw, n = block.raw, len(block.starts)
    inside = block.symbols != blocks.APART
    point = (raw & 0xC0) != 0x80
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    breaks = np.flatnonzero(raw == 10)
    starts, ends, owner = _lines(block, breaks)
    worded = np.searchsorted(block.starts, ends) > np.searchsorted(block.starts, starts)
    starts, ends, owner = starts[worded], ends[worded], owner[worded]
    key = blocks.mix(blocks.fingerprints(raw, starts, ends) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    # windows of words that occur twice in their text
    text = block.text_of_word()
    covered = np.zeros(n, bool)
    size = REPEAT_WINDOW
    if n >= size:
        whole = text[: n - size + 1] == text[size - 1 :]
        key = text[: n - size + 1].astype(np.uint64)
        for i in range(size):
            key = blocks.mix(key * np.uint64(0xD6E8FEB86659FD93) + hashes[i : n - size + 1 + i])
        at = np.flatnonzero(whole)
        order = at[np.argsort(key[at], kind="stable")]
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for i in range(size):
            covered[i : n - size + 1 + i] |= twice
    return {
        "n_words": np.diff(block.word_at).astype(np.int64),
        "word_chars": block.sums(inside & point),
        "n_symbols": block.sums(symbol[raw]),
        "n_dup_lines": np.bincount(owner[again], minlength=block.texts).astype(np.int64),
        "n_repeat_words": block.word_sums(covered),
    }


def _lines(block: blocks.Block, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of all lines that are not empty."""
    starts = np.unique(np.concatenate([block.offsets[:-1], breaks + 1]))
    starts = starts[starts < len(block.raw)]
    owner = np.searchsorted(block.offsets, starts, side="right") - 1
    ends = np.minimum(np.append(breaks, len(block.raw))[np.searchsorted(breaks, starts)], block.offsets[owner + 1])
    return starts, ends, owner


def failed(found: dict[str, np.ndarray]) -> np.ndarray:
    return (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > MOST_REPEATED * found["n_words"])


def histograms(block: blocks.Block, hashes: np.ndarray, words: np.ndarray, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Counts of character classes and of common words (then all others), a row for each text from ``first`` to ``last``."""
    last = block.texts if last is None else last
    texts, kinds, width = last - first, len(CLASSES) + 1, len(words) + 1
    sizes = np.diff(block.offsets[first : last + 1])
    code = np.repeat(np.arange(texts) * kinds, sizes) + class_table()[block.raw[block.offsets[first] : block.offsets[last]]]
    chars = np.bincount(code, minlength=texts * kinds).reshape(texts, kinds)[:, :-1]
    hashes = hashes[block.word_at[first] : block.word_at[last]]
    at = np.searchsorted(words, hashes)
    at[at == len(words)] = 0
    slot = np.where(words[at] == hashes, at, len(words)) if len(words) else np.zeros(len(hashes), np.int64)
    code = np.repeat(np.arange(texts), np.diff(block.word_at[first : last + 1])) * width + slot
    return chars, np.bincount(code, minlength=texts * width).reshape(texts, width)


def _stretches(texts: int, width: int) -> Iterator[tuple[int, int]]:
    """Ranges of a block's texts whose histograms have about CELLS cells."""
    step = max(1, CELLS // width)
    return ((i, min(texts, i + step)) for i in range(0, texts, step))


def distances(rows: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances (0 to 1) of histograms to each of the reference shares."""
    p = rows / np.maximum(1, rows.sum(axis=1, keepdims=True))
    out = np.empty((len(rows), len(shares)))
    for k, q in enumerate(shares):
        m = (p + q) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.where(p > 0, p * np.log2(p / m), 0.0).sum(axis=1)
            right = np.where(q > 0, q * np.log2(q / m), 0.0).sum(axis=1)
        out[:, k] = np.sqrt(np.maximum(0.0, (left + right) / 2))
    return out


_TABLE = blocks.split_table(blocks.BLANKS, lower=False)


def _common_words(docs: DataFrame, most: int) -> np.ndarray:
    """The ``most`` most frequent words of every language, from exact counts over all documents."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            place = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            held = [np.empty((3, 0), np.int64)]
            for block in blocks.blocks(text_column(batch, "text"), _TABLE):
                of = np.repeat(place[block.first : block.first + block.texts], np.diff(block.word_at))
                hashes = block.hashes().view(np.int64)
                order = np.lexsort((hashes, of))
                of, hashes = of[order], hashes[order]
                first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1]))[: len(of)])
                held.append(np.stack([of[first], hashes[first], np.diff(np.append(first, len(of)))]))
            of, hashes, n = np.concatenate(held, axis=1)
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(of)), pa.array(hashes), pa.array(n)], ["lang", "h", "n"])

    sums = map_arrow(docs.select("lang", "text"), step, "lang string, h bigint, n bigint").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "h"))
    found = sums.withColumn("rank", rank).where(F.col("rank") <= most).select("h").distinct().collect()
    return np.unique(np.array([r["h"] for r in found], np.int64).view(np.uint64))


def fit(docs: DataFrame, text: Column, lang: Column, common_words: int = COMMON_WORDS) -> References:
    """References of all languages: common words and histograms are over all documents."""
    rows = docs.select(lang.cast("string").alias("lang"), text.cast("string").alias("text")).where("lang is not null and text is not null")
    names = [r["lang"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").collect()]
    words = _common_words(rows, common_words) if names else np.empty(0, np.uint64)
    width = len(CLASSES) + len(words) + 1

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: i for i, x in enumerate(names)}
        for batch in batches:
            of = np.array([place.get(x, -1) for x in batch.column(0).to_pylist()], np.int64)
            codes, sizes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for block in blocks.blocks(text_column(batch, "text"), _TABLE):
                hashes = block.hashes()
                mine = of[block.first : block.first + block.texts]
                good = (mine >= 0) & ~failed(counts(block, hashes))
                for a, b in _stretches(block.texts, width):
                    found = np.hstack(histograms(block, hashes, words, a, b))[good[a:b]]
                    i, j = np.nonzero(found)
                    codes.append(mine[a:b][good[a:b]][i] * width + j)
                    sizes.append(found[i, j])
            code, at = np.unique(np.concatenate(codes), return_inverse=True)
            n = np.zeros(len(code), np.int64)
            np.add.at(n, at, np.concatenate(sizes))
            yield pa.RecordBatch.from_arrays([pa.array(code // width), pa.array(code % width), pa.array(n)], ["i", "j", "n"])

    table = np.zeros((len(names), width))
    if names:
        for r in map_arrow(rows, step, "i bigint, j bigint, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
            table[r["i"], r["j"]] = r["n"]
    some = table.sum(axis=1) > 0
    table, names = table[some], [x for x, y in zip(names, some) if y]
    shares = lambda x: x / np.maximum(1, x.sum(axis=1, keepdims=True))
    return References(names, words, shares(table[:, : len(CLASSES)]), shares(table[:, len(CLASSES) :]))


RESULT = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, char_distance double, word_distance double"


def judge(docs: DataFrame, key: Column, text: Column, references: References, most_char: float = MOST_CHAR_DISTANCE, most_word: float = MOST_WORD_DISTANCE) -> DataFrame:
    """key and RESULT for every row. Null and empty texts have no words and fail. Without references, or for a text too
    short for a histogram, that distance is null and doesn't count. Repeated rows are judged each."""
    rows = docs.select(key.alias("key"), text.cast("string").alias("text"))
    sent = rows.sparkSession.sparkContext.broadcast(references)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            parts: list[list[np.ndarray]] = []
            for block in blocks.blocks(text_column(batch, "text"), _TABLE):
                hashes = block.hashes()
                found = counts(block, hashes)
                bad = failed(found)
                char = word = np.full(block.texts, np.nan)
                if known.languages:
                    char, word = char.copy(), word.copy()
                    for i, j in _stretches(block.texts, len(known.words) + 1):
                        chars, words = histograms(block, hashes, known.words, i, j)
                        a, b = distances(chars, known.char_shares), distances(words, known.word_shares)
                        nearest = np.argmin(a + b, axis=1)
                        pick = np.arange(j - i)
                        char[i:j] = np.where(chars.sum(axis=1) >= MIN_CHARS, a[pick, nearest], np.nan)
                        word[i:j] = np.where(found["n_words"][i:j] >= MIN_HISTOGRAM_WORDS, b[pick, nearest], np.nan)
                far = (np.nan_to_num(char) > most_char) | (np.nan_to_num(word) > most_word)
                parts.append([*found.values(), bad, ~bad & ~far, char, word])
            columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.empty(0, np.int64)] * 5 + [np.empty(0, bool)] * 2 + [np.empty(0)] * 2
            names = [x.split()[0] for x in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, from_pandas=x.dtype == float) for x in columns)], ["key", *names])

    kind = rows.schema["key"].dataType.simpleString()
    return map_arrow(rows, step, f"key {kind}, {RESULT}")
