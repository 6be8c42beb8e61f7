"""Language-model scores of a hashed maximum-entropy model with a class-factored softmax.

P(token | history) = P(class | history) P(token | class, history). Histories enter by hashed features: the last word, the words
before it as skips, and the last two together. The frequent words are the tokens of the model, in classes of equal
size; the end of a text is a class of its own, and all other words belong to a few spelling classes, within which the
add-one unigram decides. Every partition takes AdaGrad steps over all its training tokens, from the unigram model, and
the partitions' weights are averaged by their tokens through a shuffle. Scoring gathers rows in sparse numpy batches.

Counts are exact over all training tokens: a bounded list of words, picked from a sample, is counted in dense arrays; every
other word's occurrences meet in one shuffle by word. Words are told apart by 64-bit fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm import blocks
from tablewright.llm.shared import cut, map_arrow, text_column

#: Words counted in dense arrays, and documents from which they are picked.
LISTED = 1 << 16
SAMPLE_DOCS = 3_000
CLASSES = 32
MEMBERS = 32
RARE_CLASSES = 8
#: Rows of the class features (a skip each), least rows of the hashed pairs (they grow with the corpus, see ``pair_rows``) and
#: rows of the member features.
CLASS_ROWS = 2_048
PAIR_ROWS = 4_096
MEMBER_ROWS = 256
SKIPS = 3
BATCH = 8_192
STEP = 0.15
ROUNDS = 1
#: Weights that travel as one row.
SLICE = 1 << 15
#: Partial sums of one slice that a task adds up before a second level of sums is put in.
FAN_IN = 64

_TABLE = blocks.split_table(blocks.BLANKS, lower=True)
OUTPUTS = CLASSES + 1 + RARE_CLASSES
END_CLASS = CLASSES


@dataclass
class Counts:
    listed: np.ndarray  # sorted fingerprints
    count: np.ndarray  # training tokens of each
    ends: int
    tokens: int = 0
    types: int = 0
    rare_mass: np.ndarray = field(default_factory=lambda: np.ones(RARE_CLASSES))


@dataclass
class Model:
    counts: Counts
    slot: np.ndarray  # of each listed word: its number in the model, or -1
    class_bias: np.ndarray
    member_bias: np.ndarray
    class_weights: np.ndarray  # (SKIPS * CLASS_ROWS + pair rows, OUTPUTS)
    member_weights: np.ndarray  # (SKIPS * MEMBER_ROWS, CLASSES, MEMBERS)


@dataclass
class Tokens:
    """The tokens of a block, each text's end after its words."""

    text: np.ndarray
    at: np.ndarray  # place in the list, or -1
    hash: np.ndarray
    spelling: np.ndarray
    end: np.ndarray


def tokens_of(block: blocks.Block, listed: np.ndarray) -> Tokens:
    n, texts = len(block.starts), block.texts
    hashes = block.hashes()
    at = np.searchsorted(listed, hashes)
    at[at == len(listed)] = 0
    at = np.where(listed[at] == hashes, at, -1) if len(listed) else np.full(n, -1)
    last = block.symbols[block.ends - 1].astype(np.int64) if n else np.empty(0, np.int64)
    other = block.symbols[np.maximum(block.starts, block.ends - 2)].astype(np.int64) if n else last
    spelling = (last * 257 + other) * 40_503 % 65_521
    counts = np.diff(block.word_at)
    place = np.arange(n) + np.repeat(np.arange(texts), counts)
    total = n + texts
    fill = lambda values, kind, rest: _spread(values, place, total, kind, rest)
    end = np.ones(total, bool)
    end[place] = False
    return Tokens(np.repeat(np.arange(texts), counts + 1), fill(at, np.int64, -1), fill(hashes, np.uint64, 0), fill(spelling, np.int64, 0), end)


def _spread(values: np.ndarray, place: np.ndarray, total: int, kind: type, rest: int) -> np.ndarray:
    out = np.full(total, rest, kind)
    out[place] = values
    return out


def pair_rows(tokens: int) -> int:
    """Rows of hashed pairs for so many training tokens: the power of two from their square root on."""
    return max(PAIR_ROWS, 1 << int(np.ceil(np.log2(max(1, tokens) ** 0.5))))


def _rows(tokens: Tokens, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class features (SKIPS + 1 rows), member features (SKIPS rows), class and model slot of every token."""
    slot = np.where(tokens.at >= 0, model.slot[tokens.at], -1) if len(model.slot) else np.full(len(tokens.at), -1)
    words = CLASSES * MEMBERS
    wide = np.where(slot >= 0, slot, words + tokens.spelling % (CLASS_ROWS - words - 1))
    narrow = np.where((slot >= 0) & (slot < MEMBER_ROWS // 2), slot, MEMBER_ROWS // 2 + tokens.spelling % (MEMBER_ROWS // 2 - 1))
    n = len(slot)
    begin = np.append(0, np.flatnonzero(tokens.end)[:-1] + 1) if n else np.empty(0, np.int64)
    since = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
    classes, members, seen = [], [], []
    for skip in range(1, SKIPS + 1):
        known = since >= skip
        back = np.maximum(np.arange(n) - skip, 0)
        seen.append(np.where(known, wide[back], CLASS_ROWS - 1))
        classes.append(seen[-1] + (skip - 1) * CLASS_ROWS)
        members.append(np.where(known, narrow[back], MEMBER_ROWS - 1) + (skip - 1) * MEMBER_ROWS)
    classes.append((seen[0] * 31_337 + seen[1] * 7_919) % (len(model.class_weights) - SKIPS * CLASS_ROWS) + SKIPS * CLASS_ROWS)
    kind = np.where(tokens.end, END_CLASS, np.where(slot >= 0, slot // MEMBERS, CLASSES + 1 + tokens.spelling % RARE_CLASSES))
    return np.array(classes), np.array(members), kind, slot


def _softmax(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities and log normalisers by row."""
    top = logits.max(axis=1, keepdims=True)
    e = np.exp(logits - top)
    total = e.sum(axis=1, keepdims=True)
    return e / total, (top + np.log(total))[:, 0]


def _class_logits(model: Model, classes: np.ndarray) -> np.ndarray:
    out = model.class_weights[classes[0]] + model.class_bias
    for row in classes[1:]:
        out += model.class_weights[row]
    return out


def _member_logits(model: Model, members: np.ndarray, kind: np.ndarray) -> np.ndarray:
    out = model.member_bias[kind]
    for row in members:
        out = out + model.member_weights[row, kind]
    return out


def log10_probabilities(tokens: Tokens, model: Model) -> np.ndarray:
    """log10 P of every token; of words that aren't listed without their log10 (count + 1)."""
    classes, members, kind, slot = _rows(tokens, model)
    out = np.empty(len(kind))
    for a in range(0, len(kind), BATCH):
        b = a + BATCH
        logits = _class_logits(model, classes[:, a:b])
        _, norm = _softmax(logits)
        out[a:b] = logits[np.arange(len(logits)), kind[a:b]] - norm
        inner = np.flatnonzero(slot[a:b] >= 0)
        if len(inner):
            logits = _member_logits(model, members[:, a + inner], kind[a + inner])
            _, norm = _softmax(logits)
            out[a + inner] += logits[np.arange(len(inner)), slot[a + inner] % MEMBERS] - norm
    out /= np.log(10)
    rare = kind > END_CLASS
    counted = np.where(tokens.at >= 0, model.counts.count[tokens.at], 0) if len(model.counts.count) else np.zeros(len(kind))
    out[rare] += np.log10(counted[rare] + 1) - np.log10(model.counts.rare_mass[kind[rare] - END_CLASS - 1])
    return out


class Trainer:
    """AdaGrad on a copy of a model's weights."""

    def __init__(self, model: Model, step: float = STEP) -> None:
        self.model = Model(model.counts, model.slot, model.class_bias, model.member_bias, model.class_weights.copy(), model.member_weights.copy())
        self.class_squares = np.full(model.class_weights.shape, 1e-2, np.float32)
        self.member_squares = np.full(self.model.member_weights.shape, 1e-2, np.float32)
        self.step, self.seen = step, 0

    def _update(self, weights: np.ndarray, squares: np.ndarray, index: np.ndarray, slope: np.ndarray) -> None:
        """Add up slopes of equal rows and take a step on each."""
        order = np.argsort(index, kind="stable")
        rows = index[order]
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        g = np.add.reduceat(slope[order], first, axis=0)
        rows = rows[first]
        squares[rows] += g * g
        weights[rows] -= self.step * g / np.sqrt(squares[rows])

    def learn(self, tokens: Tokens) -> None:
        model = self.model
        classes, members, kind, slot = _rows(tokens, model)
        flat = model.member_weights.reshape(-1, MEMBERS)
        flat_squares = self.member_squares.reshape(-1, MEMBERS)
        for a in range(0, len(kind), BATCH):
            b = a + BATCH
            slope, _ = _softmax(_class_logits(model, classes[:, a:b]))
            slope[np.arange(len(slope)), kind[a:b]] -= 1
            for row in classes[:, a:b]:
                self._update(model.class_weights, self.class_squares, row, slope)
            inner = a + np.flatnonzero(slot[a:b] >= 0)
            if len(inner):
                slope, _ = _softmax(_member_logits(model, members[:, inner], kind[inner]))
                slope[np.arange(len(inner)), slot[inner] % MEMBERS] -= 1
                for row in members[:, inner]:
                    self._update(flat, flat_squares, row * CLASSES + kind[inner], slope)
        self.seen += len(kind)


def _prepared(docs: DataFrame, key: Column, text: Column, training: Column) -> DataFrame:
    """(key, text, train, row): null texts are empty; ``row`` tells rows apart by key and text."""
    full = F.coalesce(text.cast("string"), F.lit(""))
    return docs.select(key.alias("key"), full.alias("text"), F.coalesce(training, F.lit(False)).alias("train"), F.xxhash64(key, full).alias("row"))


def _listed(rows: DataFrame, most: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints, sorted, and spellings of the ``most`` frequent words of about ``sample`` training documents.

    Rows are drawn, not texts, so that a text with many copies is drawn as often as it occurs, neither never nor always.
    """
    n = rows.where("train").count()
    drawn = rows.where("train").where(F.rand(10) < sample / max(1, n)).select("text")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks.blocks(text_column(batch, "text"), _TABLE):
                tokens = tokens_of(block, np.empty(0, np.uint64))
                h, first, c = np.unique(tokens.hash[~tokens.end], return_index=True, return_counts=True)
                spelling = tokens.spelling[~tokens.end][first]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(spelling), pa.array(c.astype(np.int64))], ["h", "spelling", "n"])

    sums = map_arrow(drawn, step, "h bigint, spelling bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"), F.max("spelling").alias("spelling"))
    top = sums.orderBy(F.desc("n"), "h").limit(most).collect()
    found, spellings = np.array([r["h"] for r in top], np.int64).view(np.uint64), np.array([r["spelling"] for r in top], np.int64)
    order = np.argsort(found)
    return found[order], spellings[order]


def _dense_counts(rows: DataFrame, listed: np.ndarray) -> tuple[np.ndarray, int]:
    """Exact training counts of the listed words, and of ends."""
    sent = rows.sparkSession.sparkContext.broadcast(listed)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value) + 1, np.int64)
        for batch in batches:
            total[-1] += batch.num_rows
            for block in blocks.blocks(text_column(batch, "text"), _TABLE):
                at = tokens_of(block, sent.value).at
                total[:-1] += np.bincount(at[at >= 0], minlength=len(sent.value))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["i", "n"])

    total = np.zeros(len(listed) + 1, np.int64)
    for r in map_arrow(rows.where("train").select("text"), step, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect():
        total[r["i"]] = r["n"]
    return total[:-1], int(total[-1])


def _other_words(rows: DataFrame, listed: np.ndarray) -> DataFrame:
    """(row, tokens, logs, known, types, mass0 ..) : sums of each row's words that aren't listed.

    ``logs`` sums log10 (count + 1) and ``known`` tokens with a count. Each word's type and mass are put on one of its rows, so
    the columns' totals are those of the corpus.
    """
    sent = rows.sparkSession.sparkContext.broadcast(listed)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            train, row = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in (1, 2))
            for block in blocks.blocks(text_column(batch, "text"), _TABLE):
                tokens = tokens_of(block, sent.value)
                rest = np.flatnonzero((tokens.at < 0) & ~tokens.end)
                doc, word = block.first + tokens.text[rest], tokens.hash[rest]
                # a word that fills one text is one row of it
                order = np.lexsort((word, doc))
                rest, doc, word = rest[order], doc[order], word[order]
                first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (word[1:] != word[:-1]))[: len(rest)])
                n = np.diff(np.append(first, len(rest)))
                rest, doc, word = rest[first], doc[first], word[first]
                mark = (tokens.spelling[rest] % RARE_CLASSES) * 2 + train[doc].astype(np.int64)
                for a in range(0, len(rest), 50_000):
                    part = slice(a, a + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(word[part].view(np.int64)), pa.array(row[doc[part]].astype(np.int64)), pa.array((n[part] << 8) | mark[part])], ["h", "row", "mark"])

    # mark: how often the word stands in the row, its spelling, and whether the row is for training
    words = map_arrow(rows.select("text", "train", "row"), step, "h bigint, row bigint, mark bigint")
    same = Window.partitionBy("h").orderBy("row")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, learned, spelling = F.shiftright("mark", 8), F.col("mark").bitwiseAND(1), F.shiftright("mark", 1).bitwiseAND(127)
    counted = words.select("h", "row", "mark", F.sum(n * learned).over(whole).alias("c"), F.row_number().over(same).alias("nth"))
    head = (F.col("nth") == 1) & (F.col("c") > 0)
    masses = [F.sum(F.when(head & (spelling == k), F.col("c") + 1).otherwise(0)).alias(f"mass{k}") for k in range(RARE_CLASSES)]
    sums = [F.sum(n).alias("tokens"), F.sum(n * F.log10(F.col("c") + 1.0)).alias("logs"), F.sum(F.when(F.col("c") > 0, n).otherwise(0)).alias("known"), F.sum(head.cast("bigint")).alias("types"), F.sum(n * learned).alias("trained")]
    return cut(counted.groupBy("row").agg(*sums, *masses))


def _unigram_model(counts: Counts) -> Model:
    """The model whose weights are zero: class and member biases are the training shares."""
    order = np.argsort(-counts.count, kind="stable")[: CLASSES * MEMBERS]
    slot = np.full(len(counts.listed), -1)
    slot[order] = np.arange(len(order))
    member = np.full(CLASSES * MEMBERS, -8.0)
    member[: len(order)] = np.log(counts.count[order] + 0.5)
    sums = np.zeros(OUTPUTS)
    np.add.at(sums, np.arange(len(order)) // MEMBERS, counts.count[order])
    sums[END_CLASS] = counts.ends
    sums[END_CLASS + 1 :] = counts.rare_mass
    bias = np.log((sums + 0.5) / (sums + 0.5).sum())
    return Model(counts, slot, bias.astype(np.float32), member.reshape(CLASSES, MEMBERS).astype(np.float32), np.zeros((SKIPS * CLASS_ROWS + pair_rows(counts.tokens), OUTPUTS), np.float32), np.zeros((SKIPS * MEMBER_ROWS, CLASSES, MEMBERS), np.float32))


def _sum_slices(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(slice, part, data) rows, their float32 arrays added up by ``keys``; memory of a task is its slices."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        part = 0
        for batch in batches:
            for s, p, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                total[s] = total[s] + np.frombuffer(data, np.float32) if s in total else np.frombuffer(data, np.float32).copy()
                part = p
        for s, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([part]), pa.array([x.tobytes()], pa.binary())], ["slice", "part", "data"])

    return map_arrow(parts.repartition(*keys), step, "slice bigint, part bigint, data binary")


def _round(rows: DataFrame, model: Model, step: float) -> Model:
    """One pass of every partition over its training tokens, then the average of their weights."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    texts = rows.where("train").select("text")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(sent.value, step)
        for batch in batches:
            for block in blocks.blocks(text_column(batch, "text"), _TABLE):
                trainer.learn(tokens_of(block, sent.value.counts.listed))
        if not trainer.seen:
            return
        flat = np.concatenate([trainer.model.class_weights.ravel(), trainer.model.member_weights.ravel(), [1.0]]).astype(np.float32) * np.float32(trainer.seen)
        part = TaskContext.get().partitionId()
        for s in range(0, len(flat), SLICE):
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([part]), pa.array([flat[s : s + SLICE].tobytes()], pa.binary())], ["slice", "part", "data"])

    parts = map_arrow(texts, learn, "slice bigint, part bigint, data binary")
    n = texts.rdd.getNumPartitions()
    if n > FAN_IN:
        parts = _sum_slices(parts.withColumn("part", F.pmod("part", F.lit(int(n**0.5)))), ["slice", "part"])
    flat = np.zeros(model.class_weights.size + model.member_weights.size + 1, np.float64)
    for r in _sum_slices(parts, ["slice"]).collect():
        flat[r["slice"] : r["slice"] + SLICE] += np.frombuffer(r["data"], np.float32)
    if not flat[-1]:
        return model
    flat = (flat[:-1] / flat[-1]).astype(np.float32)
    k = model.class_weights.size
    return Model(model.counts, model.slot, model.class_bias, model.member_bias, flat[:k].reshape(model.class_weights.shape), flat[k:].reshape(model.member_weights.shape))


SCORES = "n_tokens bigint, n_other bigint, n_known bigint, base double, score double"


def score(docs: DataFrame, key: Column, text: Column, training: Column, listed: int = LISTED, sample: int = SAMPLE_DOCS, rounds: int = ROUNDS, step: float = STEP) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) for every row; learned where ``training`` is true.

    Null and empty texts are their end alone. Rows that repeat are counted each and score the same. A null condition is
    no training row. Without training rows every count is 0 and the model is uniform over classes.
    """
    rows = _prepared(docs, key, text, training)
    words, spelling = _listed(rows, listed, sample)
    count, ends = _dense_counts(rows, words)
    others = _other_words(rows, words)
    totals = others.agg(F.sum("trained").alias("n"), F.sum("types").alias("v"), *(F.sum(f"mass{k}").alias(f"mass{k}") for k in range(RARE_CLASSES))).first()
    counts = Counts(words, count, ends, int(count.sum()) + ends + int(totals["n"] or 0), int((count > 0).sum()) + (ends > 0) + int(totals["v"] or 0))
    counts.rare_mass = np.array([float(totals[f"mass{k}"] or 0) + 1 for k in range(RARE_CLASSES)])
    model = _unigram_model(counts)
    rest = (model.slot < 0) & (count > 0)
    np.add.at(counts.rare_mass, spelling[rest] % RARE_CLASSES, count[rest] + 1)
    model = _unigram_model(counts)
    for _ in range(rounds):
        model = _round(rows, model, step)
    final = rows.sparkSession.sparkContext.broadcast(model)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = final.value
        logs = np.append(np.log10(known.counts.count + 1.0), 0.0)
        seen = np.append(known.counts.count > 0, False)
        for batch in batches:
            parts = []
            for block in blocks.blocks(text_column(batch, "text"), _TABLE):
                tokens = tokens_of(block, known.counts.listed)
                n = block.texts
                add = lambda values: np.bincount(tokens.text, values, minlength=n)  # noqa: B023, E731
                base = np.where(tokens.end, np.log10(known.counts.ends + 1.0), logs[tokens.at])
                parts.append([
                    np.diff(block.word_at) + 1,
                    add((tokens.at < 0) & ~tokens.end).astype(np.int64),
                    add(np.where(tokens.end, known.counts.ends > 0, seen[tokens.at])).astype(np.int64),
                    add(base),
                    add(log10_probabilities(tokens, known)),
                ])
            columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.empty(0, np.int64)] * 3 + [np.empty(0)] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *map(pa.array, columns)], ["key", "row", *(x.split()[0] for x in SCORES.split(", "))])

    kind = rows.schema["key"].dataType.simpleString()
    marked = map_arrow(rows.select("key", "text", "row"), mark, f"key {kind}, row bigint, {SCORES}")
    mine = others.select(F.col("row").alias("of"), "tokens", "logs", "known")
    share = F.col("n_other") / F.col("tokens")  # rows that repeat share one sum
    told = marked.join(mine, F.col("row") == F.col("of"), "left")
    more = lambda c: F.coalesce(F.col(c) * share, F.lit(0.0))
    norm = float(np.log10(counts.tokens + counts.types + 1))
    return told.select(
        "key",
        "n_tokens",
        (F.col("n_known") + F.round(more("known")).cast("bigint")).alias("n_known"),
        F.lit(counts.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + more("logs") - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("score") + more("logs")).alias("score"),
    )
