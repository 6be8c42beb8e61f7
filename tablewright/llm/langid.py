"""Language identification of whole, possibly code-switched texts by a linear-chain conditional random field.

Words are states of a chain, languages its labels. A word's evidence is the sum of learned weights of its hashed character
n-grams (those that touch its edges are its affixes), of itself, and of the language lexicons that hold it. Transitions are
learned too, from chains in which stretches of different languages follow each other. Forward-backward gives every
word its label probabilities; a text's language is the one of the most words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm import blocks
from tablewright.llm.shared import map_arrow, text_column

BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
EDGE_ORDER = 5
#: Distinct texts of each language in the sample, and the characters that are taken of a longer one.
SAMPLE_DOCS = 200
SAMPLE_CHARS = 1 << 15
#: Words of the sample of each language, its lexicon, words of a training chain and of a stretch in it.
SAMPLE_WORDS = 12_000
LEXICON = 200
CHAIN = 64
STRETCH = (3, 24)
ROUNDS = 40
STEP = 0.15
DECAY = 1e-5
#: Words of a piece when texts are labelled; messages pass from piece to piece, so a text is one chain.
PIECE = 128
#: Up to so many labels a piece is summed up in a matrix; with more, the words of a text are walked one by one.
MATRIX_LABELS = 8
SHARD_BYTES = 1 << 20
UNKNOWN = "und"

_TABLE = blocks.split_table(blocks.BLANKS, lower=False)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_WIDE = _LETTER.copy()
_WIDE[0x80:] = True


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS + languages, languages)
    moves: np.ndarray  # log potential of label i before label j
    lexicons: list[np.ndarray]  # sorted word fingerprints, one array a language


def _edged(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words one after the other, each between ^ and $, their sizes and starts, and each letter's place."""
    sizes = ends - starts + 2
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    letters = np.full(len(place), ord("^"), np.uint8)
    letters[first + sizes - 1] = ord("$")
    inner = (place > 0) & (place < np.repeat(sizes, sizes) - 1)
    letters[inner] = _LOWER[raw[(np.repeat(starts, sizes) + place - 1)[inner]]]
    return letters, sizes, first, place


def word_features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lexicons: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Features of words as (feature, number of its word), words in order."""
    letters, sizes, first, place = _edged(raw, starts, ends)
    word = np.repeat(np.arange(len(starts)), sizes)
    left = np.repeat(sizes, sizes) - place
    features, words = [], []
    code = letters.astype(np.uint64)
    for order in range(2, EDGE_ORDER + 1):
        code = code[:-1] * np.uint64(1_000_003) + letters[order - 1 :].astype(np.uint64) + np.uint64(1)
        fits = left[: len(code)] >= order
        if order not in ORDERS:
            fits &= (place[: len(code)] == 0) | (left[: len(code)] == order)
        at = np.flatnonzero(fits)
        features.append(blocks.mix(code[at] + np.uint64(order << 56)) % np.uint64(BUCKETS))
        words.append(word[at])
    low = blocks.fingerprints(letters, first, first + sizes)
    features.append(low % np.uint64(BUCKETS))
    words.append(np.arange(len(starts)))
    for k, lexicon in enumerate(lexicons):
        at = np.flatnonzero(np.isin(low, lexicon))
        features.append(np.full(len(at), BUCKETS + k, np.uint64))
        words.append(at)
    feature, word = np.concatenate(features).astype(np.int64), np.concatenate(words)
    order = np.argsort(word, kind="stable")
    return feature[order], word[order]


def evidence(feature: np.ndarray, word: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    """Summed weights of each of n words; every word has a feature."""
    return np.add.reduceat(weights[feature], np.searchsorted(word, np.arange(n)), axis=0) if n else np.zeros((0, weights.shape[1]))


def forward_backward(scores: np.ndarray, chains: np.ndarray, lengths: np.ndarray, moves: np.ndarray, pairs: bool = False, enter: np.ndarray | None = None, leave: np.ndarray | None = None):
    """Label probabilities (T, chains, labels) of chains whose word numbers are columns of ``chains``.

    ``lengths`` must not increase. With ``pairs`` also the summed probabilities of neighbouring labels and the log
    of the partition function. ``enter`` and ``leave`` (chains, labels) are the messages that reach the first word of each chain
    from before and the last from behind.
    """
    steps, n, k = chains.shape[0], chains.shape[1], scores.shape[1]
    top = scores.max(axis=1, keepdims=True)
    local, move = np.exp(scores - top), np.exp(moves)
    alive = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(steps)]  # chains longer than t
    ahead = np.zeros((steps, n, k), scores.dtype)
    log_z = 0.0
    for t in range(steps):
        m = alive[t]
        if not m:
            break
        if t:
            a = (ahead[t - 1, :m] @ move) * local[chains[t, :m]]
        else:
            a = local[chains[t, :m]] if enter is None else local[chains[t, :m]] * enter[:m]
        scale = a.sum(axis=1, keepdims=True)
        ahead[t, :m] = a / scale
        if pairs:
            log_z += float(np.log(scale).sum() + top[chains[t, :m]].sum())
    back = np.ones((n, k), scores.dtype) if leave is None else leave.astype(scores.dtype)
    sums = np.zeros((k, k))
    for t in range(steps - 1, -1, -1):
        m, later = alive[t], alive[t + 1] if t + 1 < steps else 0
        if not m:
            continue
        if later:
            b = local[chains[t + 1, :later]] * back[:later]
            if pairs:
                joint = ahead[t, :later, :, None] * b[:, None, :] * move[None]
                sums += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            b = b @ move.T
            back[:later] = b / b.sum(axis=1, keepdims=True)
        both = ahead[t, :m] * back[:m]
        ahead[t, :m] = both / both.sum(axis=1, keepdims=True)
    return (ahead, sums, log_z) if pairs else ahead


def chain_table(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Word numbers (T, chains) of chains of consecutive words; zeros beyond their ends."""
    t = np.arange(int(length.max()) if len(length) else 0)[:, None]
    return np.where(t < length, first + t, 0)


def _messages(scores: np.ndarray, chains: np.ndarray, length: np.ndarray, moves: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Messages that enter and leave each piece (a column of ``chains``), ``piece`` being its number within its text.

    The matrix of a piece carries a message through it. The pieces' own matrices are worked out side by side, then
    messages go from piece to piece, side by side for all texts. Pieces of a text follow each other.
    """
    k, n = scores.shape[1], chains.shape[1]
    local, move = np.exp(scores - scores.max(axis=1, keepdims=True)), np.exp(moves)
    through = np.broadcast_to(np.eye(k), (n, k, k)).copy()
    for t in range(chains.shape[0]):
        on = np.flatnonzero(length > t)
        x = (through[on] @ move) * local[chains[t, on]][:, None, :]
        through[on] = x / x.sum(axis=(1, 2), keepdims=True)
    enter, leave = np.ones((n, k)), np.ones((n, k))
    first = np.flatnonzero(piece == 0)
    sizes = np.diff(np.append(first, n))
    ahead = np.empty((n, k))  # the message at the end of each piece
    for p in range(int(sizes.max()) if n else 0):
        at = first[sizes > p] + p
        if p:
            enter[at] = ahead[at - 1] @ move
            x = (ahead[at - 1][:, None, :] @ through[at])[:, 0]
        else:  # no move leads to a text's first word
            x = _first_piece(local, chains[:, at], length[at], move)
        ahead[at] = x / x.sum(axis=1, keepdims=True)
    for p in range(int(sizes.max()) - 1 if n else 0):
        at = first[sizes > p + 1] + sizes[sizes > p + 1] - 1 - p
        x = (through[at] @ leave[at][:, :, None])[:, :, 0]
        leave[at - 1] = x / x.sum(axis=1, keepdims=True)
    return enter, leave


def _first_piece(local: np.ndarray, chains: np.ndarray, length: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The message at the end of chains that begin a text."""
    a = local[chains[0]].astype(float)
    for t in range(1, chains.shape[0]):
        on = np.flatnonzero(length > t)
        x = (a[on] @ move) * local[chains[t, on]]
        a[on] = x / x.sum(axis=1, keepdims=True)
    return a


def train(texts: list[tuple[str, str]], rounds: int = ROUNDS, seed: int = 7) -> Model:
    """A model from (language, text) pairs, by full-batch gradient steps on the likelihood of switched chains."""
    names = sorted({x for x, _ in texts})
    if not names:
        return Model([], np.zeros((0, 0)), np.zeros((0, 0)), [])
    rng = np.random.default_rng(seed)
    block = blocks.block_of(*blocks.column_bytes(pa.array([t for _, t in texts], pa.string())), _TABLE)
    of_text = np.array([names.index(x) for x, _ in texts])
    stretches: list[tuple[int, int, int]] = []
    for k in range(len(names)):
        words = 0
        for d in rng.permutation(np.flatnonzero(of_text == k)):
            a, b = int(block.word_at[d]), int(block.word_at[d + 1])
            while a < b and words < SAMPLE_WORDS:
                n = min(b - a, int(rng.integers(*STRETCH)))
                stretches.append((a, n, k))
                a, words = a + n, words + n
    order = rng.permutation(len(stretches))
    flat = np.concatenate([np.arange(a, a + n) for a, n, _ in (stretches[i] for i in order)]) if len(order) else np.empty(0, np.int64)
    label = np.concatenate([np.full(n, k) for _, n, k in (stretches[i] for i in order)]) if len(order) else np.empty(0, np.int64)
    if not len(flat):
        return Model([], np.zeros((0, 0)), np.zeros((0, 0)), [])
    starts, ends = block.starts[flat], block.ends[flat]
    hashes, index, inverse = np.unique(blocks.fingerprints(_LOWER[block.raw], starts, ends), return_index=True, return_inverse=True)
    starts, ends = starts[index], ends[index]
    letters, sizes, first, _ = _edged(block.raw, starts, ends)
    low = blocks.fingerprints(letters, first, first + sizes)
    lexicons = []
    for k in range(len(names)):
        counts = np.bincount(inverse[label == k], minlength=len(starts))
        most = np.argsort(-counts, kind="stable")[:LEXICON]
        lexicons.append(np.sort(low[most[counts[most] > 0]]))
    feature, word = word_features(block.raw, starts, ends, lexicons)
    size, k = len(starts), len(names)
    length = np.full(-(-len(flat) // CHAIN), CHAIN)
    length[-1] = len(flat) - CHAIN * (len(length) - 1)
    chains = chain_table(np.arange(len(length)) * CHAIN, length)
    inside = np.arange(CHAIN)[: chains.shape[0], None] < length
    numbers = inverse[chains]
    target = np.eye(k)[label]
    wanted = np.zeros((size, k))
    np.add.at(wanted, inverse, target)
    follows = np.zeros((k, k))
    same_chain = np.arange(len(flat) - 1) % CHAIN != CHAIN - 1
    np.add.at(follows, (label[:-1][same_chain], label[1:][same_chain]), 1)
    weights, moves = np.zeros((BUCKETS + k, k)), np.zeros((k, k))
    w2, m2 = np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)
    for _ in range(rounds):
        probability, sums, _ = forward_backward(evidence(feature, word, size, weights), numbers, length, moves, pairs=True)
        got = np.zeros((size, k))
        np.add.at(got, numbers[inside], probability[inside])
        miss = (got - wanted) / len(flat)
        slope = DECAY * weights
        for j in range(k):
            slope[:, j] += np.bincount(feature, miss[word, j], minlength=len(weights))
        turn = (sums - follows) / len(flat)
        w2 += slope**2
        m2 += turn**2
        weights -= STEP * slope / np.sqrt(w2)
        moves -= STEP * turn / np.sqrt(m2)
    return Model(names, weights.astype(np.float32), moves.astype(np.float32), lexicons)


def label_block(block: blocks.Block, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Summed label probabilities of the words with letters of each text, how many words have each as their best
    label, and how many have letters."""
    k, n = len(model.languages), len(block.starts)
    share, best, counted = np.zeros((block.texts, k)), np.zeros((block.texts, k), np.int64), np.zeros(block.texts, np.int64)
    if not n:
        return share, best, counted
    _, index, number = np.unique(block.hashes(), return_index=True, return_inverse=True)
    starts, ends = block.starts[index], block.ends[index]
    feature, word = word_features(block.raw, starts, ends, model.lexicons)
    scores = evidence(feature, word, len(starts), model.weights)
    sums = np.append(0, np.cumsum(_WIDE[block.raw], dtype=np.int64))
    lettered = (sums[ends] > sums[starts])[number]
    counts = np.diff(block.word_at)
    size = PIECE if k <= MATRIX_LABELS else max(1, int(counts.max()))
    pieces = -(-counts // size)
    text = np.repeat(np.arange(block.texts), pieces)
    piece = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = block.word_at[text] + piece * size
    length = np.minimum(size, block.word_at[text + 1] - first)
    enter, leave = np.ones((len(first), k)), np.ones((len(first), k))
    split = np.flatnonzero(pieces[text] > 1)
    if len(split):
        enter[split], leave[split] = _messages(scores, number[chain_table(first[split], length[split])], length[split], model.moves, piece[split])
    order = np.argsort(-length, kind="stable")
    # chains of like lengths together, so that a table is at most twice as large as its words
    for at in np.split(order, np.flatnonzero(np.diff(np.frexp(length[order])[1])) + 1):
        chains = chain_table(first[at], length[at])
        probability = forward_backward(scores, number[chains], length[at], model.moves, enter=enter[at], leave=leave[at])
        valid = (np.arange(chains.shape[0])[:, None] < length[at]) & lettered[chains]
        probability *= valid[..., None]
        np.add.at(share, text[at], probability.sum(axis=0))
        top = np.argmax(probability, axis=2)
        for j in range(k):
            np.add.at(best[:, j], text[at], ((top == j) & valid).sum(axis=0))
        np.add.at(counted, text[at], valid.sum(axis=0))
    return share, best, counted


def predict(column: pa.Array, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and words of other languages of every text of a column without nulls."""
    names, scores, others = [], [], []
    for block in blocks.blocks(column, _TABLE, SHARD_BYTES):
        lettered = block.sums(_LETTER[block.raw]) > 0
        for d in np.flatnonzero(~lettered & (np.diff(block.offsets) > 0)).tolist():
            lettered[d] = any(map(str.isalpha, block.raw[block.offsets[d] : block.offsets[d + 1]].tobytes().decode("utf-8", "replace")))
        if not model.languages:
            names += [UNKNOWN] * block.texts
            scores.append(np.zeros(block.texts))
            others.append(np.zeros(block.texts, np.int64))
            continue
        share, best, counted = label_block(block, model)
        top = np.argmax(share, axis=1)
        pick = np.arange(block.texts)
        score = np.where(lettered & (counted > 0), share[pick, top] / np.maximum(1, counted), 0.0)
        names += [model.languages[t] if ok else UNKNOWN for t, ok in zip(top.tolist(), lettered.tolist())]
        scores.append(np.clip(score, 0.0, 1.0))
        others.append(np.where(lettered, counted - best[pick, top], 0))
    return names, np.concatenate([*scores, np.empty(0)]), np.concatenate([*others, np.empty(0, np.int64)])


def fit(docs: DataFrame, text: Column, lang: Column, usable: Column, sample: int = SAMPLE_DOCS) -> Model:
    """A model of every language, learned from a bounded sample: the ``sample`` distinct texts of least hash of each
    language, of rows that are ``usable`` and have a language and a text. Copies count once. Of a text of more than
    SAMPLE_CHARS characters a stretch of so many is learned, from a place that the hash picks. The model grows with the languages.
    """
    rows = docs.select(lang.cast("string").alias("lang"), text.cast("string").alias("text"), usable.alias("use")).where("use and lang is not null and text is not null")
    rows = rows.select("lang", "text", F.xxhash64(F.lit(4), "text").alias("h"))
    distinct = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not distinct:
        return train([])
    # half as many again, so that the sample is full although the counts are estimates
    shares = F.map_from_arrays(F.array(*map(F.lit, distinct)), F.array(*(F.lit(min(1.0, 1.5 * sample / n)) for n in distinct.values())))
    drawn = rows.where(F.pmod("h", F.lit(1 << 30)) / float(1 << 30) < F.element_at(shares, F.col("lang")))
    begin = 1 + F.pmod(F.shiftright("h", 30), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)).cast("int")
    found: dict[str, list[tuple[int, int, str]]] = {}
    for r in drawn.select("lang", "h", F.substring("text", begin, F.lit(SAMPLE_CHARS)).alias("text")).dropDuplicates(["lang", "h"]).collect():
        found.setdefault(r["lang"], []).append((r["h"] % (1 << 30), r["h"], r["text"]))
    return train([(x, t) for x in sorted(found) for _, _, t in sorted(found[x])[:sample]])


RESULT = "lang_pred string, score double, other_words bigint"


def label(docs: DataFrame, key: Column, text: Column, model: Model) -> DataFrame:
    """key and RESULT for every row: the language, ``und`` where a text is null or has no letter (score 0), the mean
    probability of that language over words with letters, and how many of these look like another one. Repeated rows
    are labelled each. Of equally probable languages the first by name is told. Forward-backward runs over the whole text."""
    rows = docs.select(key.alias("key"), text.cast("string").alias("text"))
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, others = predict(text_column(batch, "text"), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores), pa.array(others, pa.int64())], ["key", "lang_pred", "score", "other_words"])

    kind = rows.schema["key"].dataType.simpleString()
    return map_arrow(rows, step, f"key {kind}, {RESULT}")


def keep_known(docs: DataFrame, model: Model, least: float = 0.5, text_name: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with a score of at least ``least``.

    Null texts and texts without letters go; repeated rows are judged each; an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = [c.lower() for c in docs.columns].index(text_name.lower())

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).cast(pa.string()).fill_null("")
            names, scores, _ = predict(texts, sent.value)
            yield batch.filter(pa.array((np.array(names, object) != UNKNOWN) & (scores >= least), pa.bool_()))

    return map_arrow(docs, step, docs.schema)
