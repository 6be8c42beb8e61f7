"""Packing of tokenised documents into training sequences by the sum-of-squares rule.

Every Spark partition packs its own documents in one pass with one level array, so nothing is shuffled. A document of more than
one sequence gives full sequences; its rest is placed whole into the fill level that keeps the sum of squared counts of
partially filled sequences least. While as many sequences are open as a task may hold, none is opened: a rest that fits nowhere is cut
to fill a sequence of the level with the most, which lowers the sum most, and what remains is placed by the rule again. At
a partition's end the emptiest open sequences give ids from their ends to fill the fullest; the last one keeps a power of two
in place and its other ids form sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tablewright.llm.shared import map_arrow, named, text_column

SEQUENCE = 1024
END_ID = 0
#: Chunks of text whose ids a worker remembers.
CACHE_ENTRIES = 150_000
#: Sequences that a task holds open.
OPEN = 64
#: ``moved`` tells pieces that were moved at a partition's end from those that lie where the rule put them.
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, moved boolean"
#: Sequence numbers of a partition begin at its number times this.
PARTITION_STRIDE = 1 << 36


def _byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary file writes the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in plain}
    letters.update({chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in set(plain))})
    return letters


def _check_kind(spec: dict) -> None:
    """ValueError for a file whose ids this module would not give: another normaliser, pre-tokeniser, or order of merges."""
    before = spec.get("pre_tokenizer") or {}
    model = spec["model"]
    plain = not any(model.get(x) for x in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
    merged = [model["vocab"]["".join(x.split(" ") if isinstance(x, str) else x)] for x in model["merges"]]
    in_order = all(a < b for a, b in zip(merged, merged[1:]))
    if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or not plain or not in_order:
        raise ValueError("not a byte-level BPE file without prefix space, normaliser and options, with merges in order of ids")


class Ids:
    """Token ids of whole texts, as a byte-level BPE file of the tokenizers library gives them.

    Pre-tokens never reach across a space that follows a non-blank, so a text is looked up chunk by
    chunk between single spaces and only unseen chunks are encoded. A text with a space before another blank or at
    its end, or with a special token, is encoded as a whole.
    """

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        _check_kind(spec)
        letters = _byte_letters()
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self._encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self._special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self._whole = re.compile("|".join([r" (?:\s|\Z)", *map(re.escape, special)])).search
        self._spaced = np.zeros(max([*ranks.values(), *special.values()]) + 1, bool)
        self._spaced[[i for word, i in ranks.items() if word[:1] == b" "]] = True
        self._entries = cache_entries
        self._seen: dict[str, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        if self._special.search(text):
            ids = self._encoding.encode(text, allowed_special="all", disallowed_special=())
        else:
            ids = self._encoding.encode_ordinary(text)
        return np.array(ids, "<u4")

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of unseen chunks, each with the space before it, from one call of the encoder.

        No chunk begins with a blank, so each begins where an id begins whose first byte is a space.
        """
        ids = self._encode(" " + " ".join(chunks))
        at = (4 * np.append(np.flatnonzero(self._spaced[ids]), len(ids))).tolist()
        data = ids.tobytes()
        found = {x: data[i:j] for x, i, j in zip(chunks, at[:-1], at[1:], strict=True)}
        if len(self._seen) < self._entries:  # frequent chunks come first
            self._seen.update((x, y) for x, y in found.items() if len(y) <= 64)
        return found

    def of(self, text: str) -> np.ndarray:
        if self._whole(text):
            return self._encode(text)
        chunks = text.split(" ")
        parts = list(map(self._seen.get, chunks))
        parts[0] = self._encode(chunks[0]).tobytes()
        if None in parts:
            found = self._learn(list({x for x, y in zip(chunks, parts) if y is None}))
            parts = [y or found[x] for x, y in zip(chunks, parts)] if chunks[0] else [b"", *(y or found[x] for x, y in zip(chunks[1:], parts[1:]))]
        return np.frombuffer(b"".join(parts), "<u4")


@lru_cache(maxsize=2)
def ids_of_file(path: str) -> Ids:
    return Ids(path)


class LevelPacker:
    """Sum-of-squares placement: ``count[h]`` is the number of open sequences filled to level h."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.count = np.zeros(size + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]
        self.made = 0

    @property
    def opened(self) -> int:
        return int(self.count.sum())

    def _take(self, level: int) -> int:
        """A sequence of this level; a new one for level 0."""
        if level == 0:
            self.made += 1
            return self.made - 1
        self.count[level] -= 1
        return self.open[level].pop()

    def _put(self, sequence: int, level: int) -> None:
        if level < self.size:
            self.open[level].append(sequence)
            self.count[level] += 1

    def place(self, length: int, new: bool = True) -> tuple[int, int] | None:
        """(sequence, offset) for a piece of 1 .. size - 1 ids; None if it needs a ``new`` sequence that it may not have."""
        count, size, never = self.count, self.size, np.iinfo(np.int64).max
        # change of the sum of squares: level h loses a sequence, level h + length gains one
        change = 2 * (count[length : size + 1] - count[: size + 1 - length] + 1)
        change[0] = 2 * count[length] + 1 if new else never  # a new sequence leaves no level
        change[size - length] = 1 - 2 * count[size - length]  # a full one comes to no level
        change[1:][count[1 : size + 1 - length] == 0] = never
        best = change.min()
        if best == never:
            return None
        level = len(change) - 1 - int(np.argmin(change[::-1] != best))  # of equals, the fullest
        sequence = self._take(level)
        self._put(sequence, level + length)
        return sequence, level

    def fill(self) -> tuple[int, int]:
        """(sequence, offset) of an open sequence that a cut piece fills: of the level with the most, of equals the fullest."""
        level = self.size - 1 - int(np.argmax(self.count[1 : self.size][::-1]))
        return self._take(level), level


def pack(documents: Iterator[tuple[object, np.ndarray]], size: int = SEQUENCE, base: int = 0, most_open: int = OPEN) -> Iterator[tuple]:
    """Rows of PIECES for (doc_id, ids with the end id); sequence ids begin at ``base``."""
    packer = LevelPacker(size)
    waiting: dict[int, list[tuple]] = {}

    def row(doc: object, start: int, ids: np.ndarray, total: int, sequence: int, offset: int, moved: bool = False) -> tuple:
        return doc, start, len(ids), zlib.crc32(ids.tobytes()), total, base + sequence, offset, moved

    for doc, ids in documents:
        total = len(ids)
        start = total - total % size
        for at in range(0, start, size):
            yield row(doc, at, ids[at : at + size], total, packer.made, 0)
            packer.made += 1
        while start < total:
            place = packer.place(total - start, len(waiting) < most_open)
            sequence, offset = place or packer.fill()
            end = total if place else start + size - offset
            held = waiting.setdefault(sequence, [])
            held.append((doc, start, ids[start:end].copy(), total, offset, False))
            if offset + end - start == size:
                for d, at, piece, n, where, moved in waiting.pop(sequence):
                    yield row(d, at, piece, n, sequence, where, moved)
            start = end
    for sequence, held in _closed(waiting, packer, size):
        for d, at, piece, n, where, moved in held:
            yield row(d, at, piece, n, sequence, where, moved)


def _cut_off(held: list[tuple], n: int) -> list[tuple]:
    """Take n ids from the end of a sequence's pieces: (doc, start, ids, total) in order."""
    taken = []
    while n:
        doc, start, ids, total, offset, moved = held.pop()
        keep = max(0, len(ids) - n)
        if keep:
            held.append((doc, start, ids[:keep], total, offset, moved))
        taken.append((doc, start + keep, ids[keep:], total))
        n -= len(ids) - keep
    return taken[::-1]


def _closed(waiting: dict[int, list[tuple]], packer: LevelPacker, size: int) -> Iterator[tuple[int, list[tuple]]]:
    """The open sequences made full or a power of two long."""
    level = {s: sum(len(x[2]) for x in held) for s, held in waiting.items()}
    yield from ((s, held) for s, held in waiting.items() if not level[s] & (level[s] - 1))
    order = sorted((s for s in waiting if level[s] & (level[s] - 1)), key=lambda s: (-level[s], s))

    def add(held: list[tuple], offset: int, pieces: list[tuple]) -> None:
        for doc, start, ids, total in pieces:
            held.append((doc, start, ids, total, offset, True))
            offset += len(ids)

    while len(order) > 1:
        full = order.pop(0)
        while level[full] < size and order:
            giver = order[-1]
            n = min(size - level[full], level[giver])
            add(waiting[full], level[full], _cut_off(waiting[giver], n))
            level[full] += n
            level[giver] -= n
            if not level[giver]:
                order.pop()
        if level[full] == size:
            yield full, waiting[full]
        else:
            order.append(full)
            break
    for last in order:
        keep = 1 << (level[last].bit_length() - 1)
        rest = _cut_off(waiting[last], level[last] - keep)
        yield last, waiting[last]
        ids = sum(len(x[2]) for x in rest)
        pool = [(doc, start, piece, total, 0, True) for doc, start, piece, total in rest][::-1]
        while ids:
            n = 1 << (ids.bit_length() - 1)
            held: list[tuple] = []
            add(held, 0, _from_front(pool, n))
            yield packer.made, held
            packer.made += 1
            ids -= n


def _from_front(pool: list[tuple], n: int) -> list[tuple]:
    """Take n ids from the front of pieces that are listed from the last to the first."""
    taken = []
    while n:
        doc, start, ids, total, _, _ = pool.pop()
        take = min(n, len(ids))
        if take < len(ids):
            pool.append((doc, start + take, ids[take:], total, 0, True))
        taken.append((doc, start, ids[:take], total))
        n -= take
    return taken


def pack_documents(docs: DataFrame, vocabulary: str, size: int = SEQUENCE, end_id: int = END_ID, id_column: str = "doc_id", text_name: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of at most ``size`` ids, one row per piece.

    Null and empty texts are the end id alone. Repeated rows are packed each. A null id stays null. An empty table
    gives no rows. Other columns aren't read. A text is tokenised whole, whatever its length; ids of one text and of
    of at most OPEN open sequences are in memory. Of equally good levels the fullest is taken.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = ids_of_file(vocabulary)
        end = np.array([end_id], "<u4")

        def documents() -> Iterator[tuple[object, np.ndarray]]:
            for batch in batches:
                keys, texts = batch.column(0), text_column(batch, "text")
                for i in range(batch.num_rows):
                    yield keys[i].as_py(), np.concatenate([ids_of.of(texts[i].as_py()), end])

        out: list[tuple] = []
        kinds = [pa.int64()] * 7 + [pa.bool_()]
        names = [x.split()[0] for x in PIECES.split(", ")]
        for piece in pack(documents(), size, TaskContext.get().partitionId() * PARTITION_STRIDE):
            out.append(piece)
            if len(out) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return map_arrow(docs.select(named(id_column).cast("bigint").alias("doc_id"), named(text_name).cast("string").alias("text")), step, PIECES)
