"""SimHash near-duplicates: a binary trie of fingerprints joined with itself.

Texts with equal fingerprints meet first, so the trie holds distinct fingerprints only. Within
a budget of k differing bits, one of k + 1 parts of two fingerprints is equal; each fingerprint enters k + 1 tries, turned
so that another part comes first, and only node pairs with no difference in that part are begun. A
task walks the node pairs below, adding up differing bits and leaving a pair when the budget is spent. Node pairs that hold
too many fingerprints for a task are replaced by the pairs of their children, level by level, before any task begins.
A task returns a spanning tree of the links it finds, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm import blocks
from tablewright.llm.components import components
from tablewright.llm.shared import cut, map_arrow, named, row_key, rows_of, stored, text_column, unplaced

BITS = 64
WORDS = 3
BUDGET = 3
#: Fingerprints of a node pair that one task walks; a larger one is split.
NODE_LIMIT = 16_384
#: Bits by which a large node is split at once.
SPLIT_BITS = 4
#: Pairs of a node pair that are compared outright.
LEAF_PAIRS = 16_384
#: Fingerprints of a node pair that are compared without walking.
FEW = 32
#: Shingles whose bits are counted at once.
SHINGLES = 1 << 17


def fingerprint(words: list[bytes], size: int = WORDS) -> int:
    """The SimHash of lower-cased words: XXH64 (seed 42) of space-joined shingles, majority by bit."""
    import xxhash

    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - size + 1)
    first, last = starts[:n].tolist(), (ends[size - 1 :] if len(words) >= size else ends[-1:]).tolist()
    xxh = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, SHINGLES):
        hashes = np.fromiter((xxh(joined[a:b], 42) for a, b in zip(first[i : i + SHINGLES], last[i : i + SHINGLES])), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


def fingerprints(docs: DataFrame, key: Column, text: Column, size: int = WORDS) -> DataFrame:
    """(key, fp) for every row; null texts as empty ones, whose fingerprint is zero."""
    rows = docs.select(key.alias("key"), text.cast("string").alias("text"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = blocks.column_bytes(text_column(batch, "text"))
            found = np.fromiter((fingerprint(raw[a:b].tobytes().translate(_LOWER).split(), size) for a, b in zip(offsets[:-1], offsets[1:])), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["key", "fp"])

    kind = rows.schema["key"].dataType.simpleString()
    return map_arrow(rows, step, f"key {kind}, fp bigint")


class Forest:
    """Labels of 0 .. n - 1, the least number of each linked set, after links came in by arrays."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up


def walk(left: np.ndarray, right: np.ndarray | None, bit: int, used: int, budget: int, link) -> None:
    """Link all pairs within ``budget`` of two sorted arrays (of one, if ``right`` is None) that agree above ``bit``.

    A node is a range of a sorted array whose numbers agree above its bit; the two first nodes differ in ``used`` bits
    above. ``link`` gets index arrays.
    """
    other = left if right is None else right
    stack = [(0, len(left), 0, len(other), bit, used)]
    while stack:
        a, b, c, d, bit, used = stack.pop()
        if a == b or c == d:
            continue
        same = right is None and a == c and b == d
        if same and b - a == 1:
            continue
        if (b - a) * (d - c) <= LEAF_PAIRS or bit < 0:
            for k in range(a, b, 1024):
                i, j = np.nonzero(np.bitwise_count(left[k : min(b, k + 1024), None] ^ other[None, c:d]) <= budget)
                link(i + k, j + c)
            continue
        mark = np.uint64(1 << bit)
        x = a + int(np.searchsorted(left[a:b] & mark, mark))
        y = x if same else c + int(np.searchsorted(other[c:d] & mark, mark))
        stack.append((a, x, c, y, bit - 1, used))
        stack.append((x, b, y, d, bit - 1, used))
        if used < budget:
            stack.append((a, x, y, d, bit - 1, used + 1))
            if not same:
                stack.append((x, b, c, y, bit - 1, used + 1))


def _turned(fp: Column, turn: int) -> Column:
    return fp if not turn else F.shiftleft(fp, turn).bitwiseOR(F.shiftrightunsigned(fp, BITS - turn))


def _back(numbers: np.ndarray, turn: np.ndarray) -> np.ndarray:
    turn = turn.astype(np.uint64)
    return np.where(turn == 0, numbers, (numbers >> turn) | (numbers << ((np.uint64(BITS) - turn) % np.uint64(BITS))))


#: A node pair: the trie's turn, the prefixes of its two nodes, their length and the budget left below.
PAIR = ["turn", "a", "b", "depth", "budget"]


def _split_large(work: DataFrame, limit: int) -> list[DataFrame]:
    """Rows (PAIR, side, n) as parts in which no node pair has over ``limit`` rows, but for full paths."""
    ready = []
    while True:
        large = stored(work.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("rows")).where((F.col("rows") > limit) & (F.col("depth") + SPLIT_BITS <= BITS)).drop("rows"))
        if large.isEmpty():
            return [*ready, work]
        ready.append(work.join(large, PAIR, "left_anti"))
        rows = work.join(large, PAIR, "left_semi")
        child = F.expr(f"shiftrightunsigned(n, {BITS - SPLIT_BITS} - depth) & {(1 << SPLIT_BITS) - 1}")
        rows = stored(rows.withColumn("child", child))
        nodes = rows.groupBy(*PAIR, "side", "child").agg(F.count(F.lit(1)).alias("rows"))
        left = nodes.where("side = 0").select(*PAIR, F.col("child").alias("s"))
        right = nodes.where("side = 1 or a = b").select(*PAIR, F.col("child").alias("t"))
        spent = F.bit_count(F.col("s").bitwiseXOR(F.col("t")))
        pairs = stored(left.join(right, PAIR).where((spent <= F.col("budget")) & ((F.col("a") != F.col("b")) | (F.col("s") <= F.col("t")))).withColumn("spent", spent))
        down = lambda x, c: F.shiftleft(x, SPLIT_BITS).bitwiseOR(F.col(c))
        new = [F.col("turn"), down("a", "s").alias("a"), down("b", "t").alias("b"), (F.col("depth") + SPLIT_BITS).alias("depth"), (F.col("budget") - F.col("spent")).alias("budget")]
        on_left = rows.where("side = 0").withColumnRenamed("child", "s").join(pairs, [*PAIR, "s"])
        on_right = rows.where("side = 1 or a = b").withColumnRenamed("child", "t").join(pairs, [*PAIR, "t"])
        on_right = on_right.where((F.col("a") != F.col("b")) | (F.col("s") != F.col("t")))
        work = stored(on_left.select(*new, F.lit(0).alias("side"), "n").unionAll(on_right.select(*new, F.lit(1).alias("side"), "n")))


def links(distinct: DataFrame, budget: int = BUDGET, limit: int = NODE_LIMIT) -> DataFrame:
    """Links (u, v) that span every set of distinct fingerprints (fp) connected within ``budget`` bits."""
    part = BITS // (budget + 1)
    turns = F.explode(F.array(*(F.struct(F.lit(i * part).alias("turn"), _turned(F.col("fp"), i * part).alias("n")) for i in range(budget + 1))))
    rows = distinct.select(turns.alias("x")).select("x.turn", "x.n")
    prefix = F.shiftrightunsigned("n", BITS - part)
    work = rows.select("turn", prefix.alias("a"), prefix.alias("b"), F.lit(part).alias("depth"), F.lit(budget).alias("budget"), F.lit(0).alias("side"), "n")
    parts = _split_large(cut(work), limit)
    work = parts[0]
    for x in parts[1:]:
        work = work.unionAll(x)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        names = [*PAIR, "side", "n"]

        def of(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Spanning links of whole node pairs; a column of ``rows`` is a fingerprint in one of them."""
            first = np.flatnonzero(np.append(True, (rows[:5, 1:] != rows[:5, :-1]).any(axis=0)))
            size = np.diff(np.append(first, rows.shape[1]))
            pair = np.repeat(np.arange(len(first)), size)
            n, side, one = rows[6].view(np.uint64), rows[5], rows[1] == rows[2]
            forest = Forest(len(n))
            few = (size <= FEW)[pair]
            for gap in range(1, FEW):
                i = np.flatnonzero((pair[:-gap] == pair[gap:]) & few[:-gap])
                if not len(i):
                    break
                near = (one[i] | (side[i] != side[i + gap])) & (np.bitwise_count(n[i] ^ n[i + gap]) <= budget)
                forest.link(i[near], i[near] + gap)
            for at, k in zip(first[size > FEW].tolist(), size[size > FEW].tolist()):
                depth, used = int(rows[3, at]), budget - int(rows[4, at])
                middle = at + k if one[at] else at + int(np.searchsorted(side[at : at + k], 1))
                left, right, start = n[at:middle], None if one[at] else n[middle : at + k], at if one[at] else middle
                walk(left, right, BITS - 1 - depth, used, budget, lambda i, j, x=at, y=start: forest.link(i + x, j + y))
            moved = np.flatnonzero(forest.label != np.arange(len(n)))
            if len(moved):
                ends = (_back(n[i], rows[0, i]) for i in (moved, forest.label[moved]))
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in ends], ["u", "v"])

        for batch in batches:
            rows = np.stack([batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False).astype(np.int64) for x in names])
            if not rows.shape[1]:
                continue
            ends = np.flatnonzero((rows[:5, 1:] != rows[:5, :-1]).any(axis=0))
            if held and (held[-1][:5, -1] != rows[:5, 0]).any():
                yield from of(np.concatenate(held, axis=1))
                held = []
            if len(ends):
                done = np.concatenate([*held, rows[:, : ends[-1] + 1]], axis=1)
                yield from of(done)
                held, rows = [], rows[:, ends[-1] + 1 :]
            held.append(rows)
        if held:
            yield from of(np.concatenate(held, axis=1))

    dealt = work.repartition(*PAIR).sortWithinPartitions(*PAIR, "side", F.col("n") < 0, "n")
    return map_arrow(dealt, step, "u bigint, v bigint")


def classes(docs: DataFrame, key: Column, text: Column, budget: int = BUDGET, size: int = WORDS, limit: int = NODE_LIMIT) -> DataFrame:
    """(key, fp, least): every row's fingerprint and the least key of its near-duplicate class.

    Classes are what links of at most ``budget`` differing bits connect. Null and empty texts, all of fingerprint zero, link
    like any others. Keys may repeat and may be null (then a class of nulls has least key null). Equal rows get equal answers.
    """
    rows = cut(fingerprints(docs, key, text, size))
    distinct = cut(rows.groupBy("fp").agg(F.min("key").alias("least")))
    found = components(links(distinct.select("fp"), budget, limit))
    members = found.join(distinct, found["u"] == distinct["fp"]).select("fp", "root", "least")
    least = members.groupBy("root").agg(F.min("least").alias("whole")).select(unplaced(F.col("root")).alias("top"), "whole")
    told = members.join(least, F.col("root") == F.col("top")).select(F.col("fp").alias("member"), "whole")
    each = distinct.join(told, F.col("fp") == F.col("member"), "left").select(unplaced(F.col("fp")).alias("of"), F.coalesce("whole", "least").alias("least"))
    return rows.join(each, F.col("fp") == F.col("of")).select("key", "fp", "least")


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_name: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of which each near-duplicate class keeps one: the least id, null ids last.

    Of repeated ids in a class the text with the least hash stays, and of repeated rows one.
    """
    kept = classes(docs, row_key(id_column, text_name), named(text_name)).where("key = least").select("key")
    return rows_of(docs, id_column, text_name, kept)
