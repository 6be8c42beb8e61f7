"""Secret scan: fixed patterns, and a character convolutional network over every candidate with its context.

The network is numpy only. It learns from labelled findings: some generated here, with a seed, and all distinct ones that patterns
find, and don't find, in the documents, in shares whose networks are averaged after each round. It is calibrated on a part that
it hasn't seen, and its threshold is the highest that keeps a set recall of every kind there, by exact ranks over that whole
part. Patterns always stand; the network adds spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm import blocks
from tablewright.llm.shared import map_arrow, ship, stored, text_column

#: Fixed patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE = 8
LEAST_ACCESS = 16
KINDS = ["assign", "access", "hex", "network"]

#: Other candidates: runs of these characters, at least this long, with a letter and a digit.
CANDIDATE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST_CANDIDATE = 20
#: Bytes of context on either side, and half of the candidate's bytes in a window; windows slide over longer ones.
CONTEXT = 24
PART = 24
WIDTH = 2 * CONTEXT + 2 * PART
SYMBOLS = 130  # bytes below 128, all others, padding
EMBEDDING = 12
FILTERS = 24
SPAN = 5
FINDINGS = 3_000
EPOCHS = 8
BATCH = 64
RECALL = 0.95

_CANDIDATES = blocks.split_table(bytes(x for x in range(255) if x not in CANDIDATE), lower=False)
_HEXES = blocks.split_table(bytes(x for x in range(255) if x not in b"0123456789abcdef"), lower=False)
_DIGIT = np.isin(np.arange(256), list(b"0123456789"))
_ALPHA = np.isin(np.arange(256), list(range(65, 91)) + list(range(97, 123)))


def base_spans(text: str, assign: bool = True, access: bool = True, hexes: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, in order; kinds known to be absent can be left out."""
    found = []
    if assign:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if access:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if hexes:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def windows_of(raw: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Windows of stretches of at most 2 * PART bytes of texts [first, last): context, the stretch, context; WIDTH symbols."""
    place = start[:, None] + np.arange(WIDTH - CONTEXT) - CONTEXT
    place = np.concatenate([place, end[:, None] + np.arange(CONTEXT)], axis=1)
    inside = (place >= first[:, None]) & (place < last[:, None])
    inside[:, CONTEXT : WIDTH - CONTEXT] &= place[:, CONTEXT : WIDTH - CONTEXT] < end[:, None]
    if not len(raw):
        return np.full(place.shape, SYMBOLS - 1, np.uint8)
    codes = np.minimum(raw[np.clip(place, 0, len(raw) - 1)], 128)
    return np.where(inside, codes, SYMBOLS - 1).astype(np.uint8)


def pieces(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(candidate, start, end) of windows that slide over whole candidates: longer ones have one every PART bytes."""
    size = 2 * PART
    many = np.maximum(1, -(-(end - start - size) // PART) + 1)
    which = np.repeat(np.arange(len(start)), many)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    begin = np.minimum(start[which] + nth * PART, np.maximum(start, end - size)[which])
    return which, begin, np.minimum(begin + size, end[which])


def view(data: bytes, start: int, end: int) -> np.ndarray:
    """The window of a candidate's first bytes."""
    one = lambda x: np.array([x])
    return windows_of(np.frombuffer(data, np.uint8), one(start), one(min(end, start + 2 * PART)), one(0), one(len(data)))[0]


@dataclass
class Network:
    embedding: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    #: By kind (-1: generated): positives of the part held out and the share of them at or above the threshold; precision there.
    recalls: dict[int, tuple[int, float]] = field(default_factory=dict)
    precision: float = 1.0

    def forward(self, windows: np.ndarray) -> tuple[np.ndarray, tuple]:
        places = np.zeros((4, PART, 2))
        places[1:3, :, 0] = 1
        places[3, :, 1] = 1
        x = np.concatenate([self.embedding[windows], np.broadcast_to(places.reshape(1, WIDTH, 2), (*windows.shape, 2))], axis=2)
        patches = np.lib.stride_tricks.sliding_window_view(x, SPAN, axis=1).reshape(len(x), WIDTH - SPAN + 1, -1)
        rows = np.maximum(patches @ self.kernel + self.bias, 0)
        most = rows.argmax(axis=1)
        top = np.take_along_axis(rows, most[:, None], axis=1)[:, 0]
        pooled = np.concatenate([top, rows.mean(axis=1)], axis=1)
        return pooled @ self.weights + self.offset, (patches, rows, most, pooled)

    def probability(self, windows: np.ndarray) -> np.ndarray:
        """Calibrated probability of a secret."""
        parts = [self.forward(windows[i : i + 1024])[0] for i in range(0, len(windows), 1024)]
        return self.calibrated(np.concatenate([*parts, np.empty(0)]))

    def calibrated(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * logit + self.shift)))


def findings(n: int = FINDINGS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels (1 secret, 0 not) of generated findings in prose, code and settings."""
    rng = np.random.default_rng(seed)
    letters = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "low": "abcdefghijklmnopqrstuvwxyz0123456789", "any": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "b64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
    pick = lambda x: x[int(rng.integers(len(x)))]
    draw = lambda kind, k: "".join(pick(letters[kind]) for _ in range(k))
    syllables = ["the", "an", "re", "ing", "ver", "lo", "que", "en", "der", "tion", "mi", "sta", "con", "por", "ba", "ment", "ser", "ex", "ra", "data"]
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))
    prose = lambda: " ".join(word() for _ in range(int(rng.integers(2, 7))))
    number = lambda k: str(int(rng.integers(10 ** (k - 1), 10**k)))
    before_secret = ["token = \"", "secret: ", "password=", "api_key: '", "apikey=", "Authorization: Bearer ", "export AUTH_TOKEN=", "client_secret\": \"", "private key ", "access key: ", "pwd = ", "credentials ", "X-Api-Key: ", "SECRET_KEY=", "the key is ", "auth="]
    secrets = [
        lambda: draw("hex", pick([32, 40, 64])), lambda: draw("HEX", pick([32, 40])), lambda: draw("b64", pick([24, 32, 40, 64])) + pick(["", "=", "=="]),
        lambda: draw("any", int(rng.integers(20, 44))), lambda: pick(["sk-", "pk_live_", "ghx_", "xox-", "key-"]) + draw("any", 28), lambda: draw("low", int(rng.integers(22, 40))), lambda: "AKIA" + draw("any", 16).upper(),
    ]
    plain = [
        lambda: f"{word()}/{number(4)}/{number(2)}/{word()}_{number(3)}", lambda: "-".join(word() for _ in range(4)) + "-" + number(3), lambda: f"{number(4)}-{number(2)}-{number(2)}T{number(6)}-{number(4)}-log",
        lambda: "".join(word().title() for _ in range(4)) + number(2), lambda: f"/{word()}/{word()}/{word()}/v{number(1)}/{word()}", lambda: f"{word()}_{word()}_{word()}_{number(4)}_{word()}",
        lambda: word() * 6 + number(1), lambda: f"page={number(2)}/{word()}-{word()}-{word()}-part{number(1)}", lambda: "=" * 10 + "a1" + "=" * 10, lambda: f"{number(8)}-{number(4)}-{number(4)}-chapter", lambda: f"isbn-{number(3)}-{number(1)}-{number(6)}-{number(2)}-x",
    ]
    before_plain = ["see ", "in file ", "at ", "href=", "id: ", "the ", "name=", "/", " (", "of ", "image ", "path ", "section ", "version "]
    before_digest = ["commit ", "sha1 checksum ", "md5: ", "etag ", "build hash ", "integrity sha256 "]
    windows, labels = [], []
    for i in range(n):
        if i % 2:
            value, lead, label = pick(secrets)(), pick(before_secret) if rng.random() < 0.85 else prose() + " ", 1
        elif rng.random() < 0.12:
            value, lead, label = draw("hex", pick([32, 40, 64])), pick(before_digest), 0
        else:
            value, lead, label = pick(plain)(), pick(before_plain), 0
            value = value if len(value) >= LEAST_CANDIDATE else value + "-" + word() + word() + "1"
        lead = prose() + pick([" ", "\n", ". ", " | "]) + lead
        tail = pick(["\"", "'", " ", "\n", ".", ",", ")", ";"]) + " " + prose()
        data = (lead + value + tail).encode()
        windows.append(view(data, len(lead.encode()), len(lead.encode()) + len(value)))
        labels.append(label)
    return np.array(windows), np.array(labels)


PARAMETERS = ["embedding", "kernel", "bias", "weights", "offset"]


@dataclass
class Learner:
    """A network with Adam's two moments of every parameter and the steps so far."""

    net: Network
    first: dict[str, np.ndarray]
    second: dict[str, np.ndarray]
    step: int = 0

    @staticmethod
    def new(rng: np.random.Generator) -> Learner:
        net = Network(rng.normal(0, 0.3, (SYMBOLS, EMBEDDING)), rng.normal(0, 0.15, ((EMBEDDING + 2) * SPAN, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, 2 * FILTERS), 0.0)
        return Learner(net, *({k: np.zeros(np.shape(getattr(net, k))) for k in PARAMETERS} for _ in range(2)))

    def epoch(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        """Adam over all windows once, in an order of ``rng``."""
        net, order = self.net, rng.permutation(len(y))
        for i in range(0, len(y), BATCH):
            at = order[i : i + BATCH]
            logit, (patches, rows, most, pooled) = net.forward(x[at])
            miss = (1 / (1 + np.exp(-logit)) - y[at]) / len(at)
            down = miss[:, None] * net.weights
            rise = np.repeat(down[:, None, FILTERS:] / rows.shape[1], rows.shape[1], axis=1)
            np.put_along_axis(rise, most[:, None], np.take_along_axis(rise, most[:, None], axis=1) + down[:, None, :FILTERS], axis=1)
            rise *= rows > 0
            back = (rise @ net.kernel.T).reshape(len(at), rise.shape[1], EMBEDDING + 2, SPAN)[:, :, :EMBEDDING]
            slope = np.zeros_like(net.embedding)
            for s in range(SPAN):
                np.add.at(slope, x[at][:, s : s + rise.shape[1]], back[..., s])
            grads = {"embedding": slope, "kernel": patches.reshape(-1, patches.shape[2]).T @ rise.reshape(-1, FILTERS), "bias": rise.sum(axis=(0, 1)), "weights": pooled.T @ miss, "offset": miss.sum()}
            self.step += 1
            for k in PARAMETERS:
                self.first[k] = 0.9 * self.first[k] + 0.1 * grads[k]
                self.second[k] = 0.999 * self.second[k] + 0.001 * grads[k] ** 2
                setattr(net, k, getattr(net, k) - 0.004 * (self.first[k] / (1 - 0.9**self.step)) / (np.sqrt(self.second[k] / (1 - 0.999**self.step)) + 1e-8))

    def packed(self) -> np.ndarray:
        """Steps, parameters and moments as one array; an average of such arrays is a learner, too."""
        return np.concatenate([[self.step], *(np.ravel(of[k]) for of in (vars(self.net), self.first, self.second) for k in PARAMETERS)]).astype(float)

    @staticmethod
    def unpacked(data: np.ndarray) -> Learner:
        learner, at = Learner.new(np.random.default_rng(0)), 1
        for of in (vars(learner.net), learner.first, learner.second):
            for k in PARAMETERS:
                shape = np.shape(of[k])
                size = int(np.prod(shape))
                of[k], at = data[at : at + size].reshape(shape).copy() if shape else float(data[at]), at + size
        learner.step = round(data[0])
        return learner


def held_out(numbers: np.ndarray) -> np.ndarray:
    """The quarter of the findings, by number or hash, that calibrates."""
    return numbers % 8 >= 6


def train(windows: np.ndarray, labels: np.ndarray, kinds: np.ndarray | None = None, epochs: int = EPOCHS, recall: float = RECALL, seed: int = 3) -> Network:
    """Adam on three quarters of the findings; scale, shift and threshold from the rest.

    The threshold is the highest at which every kind of secret keeps the recall there; it may be low.
    """
    rng = np.random.default_rng(seed)
    held = held_out(np.arange(len(labels)))
    learner = Learner.new(rng)
    for _ in range(epochs):
        learner.epoch(windows[~held], labels[~held].astype(float), rng)
    net = learner.net
    logit, truth = net.forward(windows[held])[0], labels[held]
    for _ in range(200):  # Platt scaling
        p = 1 / (1 + np.exp(-(net.slope * logit + net.shift)))
        net.slope -= 0.05 * float(((p - truth) * logit).mean())
        net.shift -= 0.05 * float((p - truth).mean())
    scores = net.probability(windows[held])
    of = np.zeros(len(truth), np.int64) if kinds is None else kinds[held]
    lowest = []
    for kind in np.unique(of[truth == 1]):
        good = np.sort(scores[(truth == 1) & (of == kind)])
        lowest.append(float(good[int((1 - recall) * len(good))]))
        net.recalls[int(kind)] = (len(good), 0.0)
    net.threshold = min(lowest, default=0.5)
    for kind in net.recalls:
        good = scores[(truth == 1) & (of == kind)]
        net.recalls[kind] = (len(good), float((good >= net.threshold).mean()))
    flagged = scores >= net.threshold
    net.precision = float(truth[flagged].mean()) if flagged.any() else 1.0
    return net


def found_in(docs: DataFrame, text: Column) -> DataFrame:
    """(kind, h, window): all distinct windows of findings in whole texts, and a hash of each.

    Kinds are those of KINDS, the last being candidates that no pattern finds, which count as no secrets.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = text_column(batch, "text")
            for block, hexes in zip(blocks.blocks(column, _CANDIDATES), blocks.blocks(column, _HEXES)):
                for windows, kind in _windows(block, hexes):
                    at = np.arange(len(windows)) * WIDTH
                    h = (blocks.fingerprints(windows.ravel(), at, at + WIDTH) >> np.uint64(1)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(h), pa.array([x.tobytes() for x in windows], pa.binary())], ["kind", "h", "window"])

    return map_arrow(docs.select(text.cast("string").alias("text")), step, "kind bigint, h bigint, window binary").dropDuplicates(["kind", "h", "window"])


def _least(found: DataFrame, most: int) -> DataFrame:
    """Of each kind the ``most`` windows of least hash."""
    parts = [found.where(F.col("kind") == k).orderBy("h", "window").limit(most) for k in range(len(KINDS))]
    for x in parts[1:]:
        parts[0] = parts[0].unionAll(x)
    return parts[0]


def drawn(docs: DataFrame, text: Column, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, labels, kinds) of a few findings, for a look at them: of each kind the ``most`` distinct windows of least hash."""
    rows = _least(stored(found_in(docs, text)), most).collect()
    kinds = np.array([r["kind"] for r in rows], np.int64)
    return _arrays([r["window"] for r in rows]), (kinds < len(KINDS) - 1).astype(np.int64), kinds


def _arrays(windows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(windows), np.uint8).reshape(len(windows), WIDTH)


#: Windows of a share, about: a task of a round learns from one share.
SHARE = 1 << 13


def _learned(found: DataFrame, windows: np.ndarray, labels: np.ndarray, rounds: int, seed: int) -> Network:
    """A network trained on all of ``found`` (kind, h, window) and on generated windows with their labels.

    It begins with the generated ones. In a round each share of ``found``, dealt by hash, takes the network and Adam's moments
    through its own windows and the generated ones; the next round begins at the shares' average. A single share is plain Adam.
    """
    rng = np.random.default_rng(seed)
    learner = Learner.new(rng)
    for _ in range(rounds):
        learner.epoch(windows, labels.astype(float), rng)
    shares = max(1, -(-found.count() // SHARE))
    dealt = found.withColumn("share", F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(shares)))
    context = found.sparkSession.sparkContext
    ship(found.sparkSession)
    made = context.broadcast((windows, labels))

    def a_round(nth: int, now: Broadcast) -> Callable[[pa.Table], pa.Table]:
        def step(told: pa.Table) -> pa.Table:
            told = told.sort_by([("h", "ascending"), ("kind", "ascending")])
            share = told.column("share")[0].as_py()
            x = np.concatenate([made.value[0], _arrays(told.column("window").to_pylist())])
            y = np.append(made.value[1], told.column("kind").to_numpy() < len(KINDS) - 1).astype(float)
            own = Learner.unpacked(now.value)
            own.epoch(x, y, np.random.default_rng([seed, nth, share]))
            return pa.table({"share": [share], "n": [len(y)], "state": pa.array([own.packed().tobytes()], pa.binary())})

        return step

    for nth in range(rounds):
        now = context.broadcast(learner.packed())
        states = sorted(dealt.groupBy("share").applyInArrow(a_round(nth, now), "share bigint, n bigint, state binary").collect())
        now.unpersist()
        if not states:
            break
        learner = Learner.unpacked(sum(r["n"] * np.frombuffer(r["state"]) for r in states) / sum(r["n"] for r in states))
    made.unpersist()
    return learner.net


def _placed(logit: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the given ones."""
    return _flipped((logit + 0.0).view(np.int64))


def _flipped(bits: np.ndarray) -> np.ndarray:
    """Bits of floating-point numbers as whole numbers of their order, and back."""
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def _scored(found: DataFrame, windows: np.ndarray, labels: np.ndarray, network: Network) -> DataFrame:
    """(kind, truth, logit, place) of all of ``found`` and of the generated windows, which are of kind -1."""
    sent = found.sparkSession.sparkContext.broadcast(network)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                kind = batch.column(0).to_numpy()[i : i + 1024]
                logit = sent.value.forward(_arrays(batch.column(1).slice(i, 1024).to_pylist()))[0]
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array((kind < len(KINDS) - 1).astype(np.int64)), pa.array(logit), pa.array(_placed(logit))], ["kind", "truth", "logit", "place"])

    kind = "kind bigint, truth bigint, logit double, place bigint"
    logit = network.forward(windows)[0] if len(windows) else np.empty(0)
    made = [(-1, *x) for x in zip(labels.tolist(), logit.tolist(), _placed(logit).tolist())]
    return stored(map_arrow(found.select("kind", "window"), step, kind).unionAll(found.sparkSession.createDataFrame(made, kind).coalesce(1)))


def _calibrate(scored: DataFrame, network: Network, most: int = 30) -> None:
    """Platt scaling over all of ``scored``: Newton's steps, halved where the loss would rise; only sums reach the driver."""
    n = {r["truth"]: r["count"] for r in scored.groupBy("truth").count().collect()}
    goal = F.when(F.col("truth") == 1, (n.get(1, 0) + 1) / (n.get(1, 0) + 2)).otherwise(1 / (n.get(0, 0) + 2))
    here, move, last = np.array([1.0, 0.0]), np.zeros(2), np.inf
    for _ in range(most):
        z = F.lit(float(here[0])) * F.col("logit") + F.lit(float(here[1]))
        p = 1 / (1 + F.exp(-z))
        miss, curve = p - goal, p * (1 - p)
        loss = F.greatest(z, F.lit(0.0)) - goal * z + F.log1p(F.exp(-F.abs(z)))
        told = [loss, miss * F.col("logit"), miss, curve * F.col("logit") ** 2, curve * F.col("logit"), curve]
        sums = [float(x or 0) for x in scored.agg(*(F.sum(x) for x in told)).first()]
        if sums[0] > last:
            move /= 2
            here = here - move
        else:
            network.slope, network.shift = here.tolist()
            done = last - sums[0] < 1e-9 * (1 + sums[0])
            last = sums[0]
            if done:
                break
            move = -np.linalg.solve(np.array([[sums[3], sums[4]], [sums[4], sums[5]]]) + 1e-6 * np.eye(2), sums[1:3])
            here = here + move
        if np.abs(move).max() < 1e-9:
            break


def _at_ranks(scored: DataFrame, ranks: dict[int, int]) -> dict[int, int]:
    """The ``place`` of each kind at its rank (0: least) among the kind's secrets, exactly: 16 bits a pass, counts to the driver."""
    rows, above, left = scored.where("truth = 1"), {}, dict(ranks)
    for shift in (48, 32, 16, 0):
        digit = F.shiftright("place", shift)
        wanted = F.lit(True) if not above else F.lit(False)
        for kind, prefix in above.items():
            wanted = wanted | ((F.col("kind") == kind) & (F.shiftright("place", shift + 16) == prefix))
        counts = rows.where(wanted).groupBy("kind", digit.alias("digit")).count().collect()
        for kind in ranks:
            for r in sorted((r for r in counts if r["kind"] == kind), key=lambda r: r["digit"]):
                if left[kind] < r["count"]:
                    above[kind] = r["digit"]
                    break
                left[kind] -= r["count"]
    return above


def _set_threshold(scored: DataFrame, network: Network, recall: float) -> None:
    """The highest threshold at which every kind of secret keeps the recall, and what it keeps, over all of ``scored``."""
    n = {r["kind"]: r["count"] for r in scored.where("truth = 1").groupBy("kind").count().collect()}
    up = network.slope >= 0  # else a low logit is a high probability
    ranks = {k: int((1 - recall) * x) for k, x in n.items()}
    places = _at_ranks(scored, ranks if up else {k: n[k] - 1 - x for k, x in ranks.items()}).values()
    if not n:
        return
    place = min(places) if up else max(places)
    passed = (F.col("place") >= place) if up else (F.col("place") <= place)
    logit = _flipped(np.array([place], np.int64)).view(float)
    network.threshold = float(network.calibrated(logit)[0])
    counts = {(r["kind"], r["truth"]): r["count"] for r in scored.where(passed).groupBy("kind", "truth").count().collect()}
    network.recalls = {k: (x, counts.get((k, 1), 0) / x) for k, x in n.items()}
    network.precision = sum(x for (_, truth), x in counts.items() if truth) / max(1, sum(counts.values()))


def fit(docs: DataFrame, text: Column, generated: int = FINDINGS, most: int | None = None, recall: float = RECALL, seed: int = 3) -> Network:
    """A network trained, calibrated and set to its recall on generated findings and on all distinct findings in ``docs``.

    Three quarters train, the rest, by hash, calibrates and sets the threshold. ``most`` is for trials: it bounds each kind.
    """
    windows, labels = findings(generated)
    found = stored(found_in(docs, text))
    if most is not None:
        found = stored(_least(found, most))
    fold = F.pmod(F.xxhash64("h"), F.lit(8)) >= 6
    held = held_out(np.arange(len(labels)))
    network = _learned(found.where(~fold), windows[~held], labels[~held], EPOCHS, seed)
    scored = _scored(found.where(fold), windows[held], labels[held], network)
    _calibrate(scored, network)
    _set_threshold(scored, network, recall)
    return network


RESULT = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_network bigint, top_score double"


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _found(block: blocks.Block, hexes: blocks.Block) -> Iterator[tuple[int, list, np.ndarray, np.ndarray]]:
    """(text, pattern spans in code points, and bytes (2, n) of these and of the other candidates) of texts that have any.

    ``block`` is cut into candidate runs, ``hexes`` into runs of hex digits. Work follows bytes and candidates.
    """
    raw = block.raw
    signs = np.append(0, np.cumsum((raw == 58) | (raw == 61), dtype=np.int64))
    signed = np.diff(signs[block.offsets]) > 0
    many = hexes.word_sums(hexes.ends - hexes.starts >= 32) > 0
    digits, alphas = (np.append(0, np.cumsum(t[raw], dtype=np.int64)) for t in (_DIGIT, _ALPHA))
    a, b = block.starts, block.ends
    fits = (b - a >= LEAST_CANDIDATE) & (digits[b] > digits[a]) & (alphas[b] > alphas[a])
    some = signed | many | (block.word_sums(fits) > 0)
    data = raw.tobytes()
    capital = {m.start() for m in re.finditer(rb"AKIA", data)}
    if capital:
        some[np.searchsorted(block.offsets, sorted(capital), side="right") - 1] = True
    for d in np.flatnonzero(some).tolist():
        begin, stop = int(block.offsets[d]), int(block.offsets[d + 1])
        own = data[begin:stop]
        text = own.decode("utf-8", "replace")
        base = base_spans(text, bool(signed[d]), b"AKIA" in own, bool(many[d]))
        ends = np.array([(x, y) for x, _, y in base], np.int64).reshape(-1, 2).T
        if len(text) != len(own):  # code points to bytes
            ends = np.append(np.flatnonzero((raw[begin:stop] & 0xC0) != 0x80), stop - begin)[ends] if ends.size else ends
        told = ends + begin
        w = np.arange(int(block.word_at[d]), int(block.word_at[d + 1]))
        w = w[fits[w]]
        if told.size and len(w):  # runs that no span of a pattern touches
            reach = np.append(0, np.maximum.accumulate(told[1]))
            w = w[reach[np.searchsorted(told[0], b[w], side="left")] <= a[w]]
        if len(base) or len(w):
            yield d, base, told, np.stack([a[w], b[w]])


#: Windows that are held at once.
HELD = 1 << 14


def _windows(block: blocks.Block, hexes: blocks.Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of all findings of a block with their kinds, some at a time."""
    for d, base, told, more in _found(block, hexes):
        ends = np.concatenate([told, more], axis=1)
        kind = np.append([k for _, k, _ in base], np.full(more.shape[1], len(KINDS) - 1)).astype(np.int64)
        which, start, end = pieces(*ends)
        bounds = block.offsets[d : d + 2]
        for i in range(0, len(which), HELD):
            part = slice(i, i + HELD)
            n = len(which[part])
            yield windows_of(block.raw, start[part], end[part], np.full(n, bounds[0]), np.full(n, bounds[1])), kind[which[part]]


def scan_block(block: blocks.Block, hexes: blocks.Block, network: Network) -> Iterator[tuple[int, list, list, float]]:
    """(text, pattern spans, network spans, highest score) of the texts of a block that have a candidate.

    A candidate's score is the highest of the windows that slide over it.
    """
    found = list(_found(block, hexes))
    if not found:
        return
    ends = np.concatenate([x for _, _, told, more in found for x in (told, more)], axis=1)
    owner = np.repeat([d for d, *_ in found], [told.shape[1] + more.shape[1] for _, _, told, more in found])
    which, start, end = pieces(*ends)
    best = np.zeros(ends.shape[1])
    for i in range(0, len(which), HELD):
        part = slice(i, i + HELD)
        of = owner[which[part]]
        scores = network.probability(windows_of(block.raw, start[part], end[part], block.offsets[of], block.offsets[of + 1]))
        np.maximum.at(best, which[part], scores)
    points = np.append(0, np.cumsum((block.raw & 0xC0) != 0x80, dtype=np.int64))
    at = 0
    for d, base, told, more in found:
        n, m = told.shape[1], more.shape[1]
        mine = best[at : at + n + m]
        at += n + m
        passed = more[:, mine[n:] >= network.threshold]
        x, y = points[passed] - points[block.offsets[d]]
        yield d, base, [(i, len(KINDS) - 1, j) for i, j in zip(x.tolist(), y.tolist())], float(mine.max())


def scan(docs: DataFrame, key: Column, text: Column, network: Network) -> DataFrame:
    """key and RESULT for every row; null texts are empty and have no spans. Repeated rows are scanned each.

    Spans are in code points, kind:start:end by start and then kind as listed in KINDS, comma-joined; ``base_sha256`` is over
    the patterns' spans. ``top_score`` is the network's highest probability in the text, 0 without a candidate.
    """
    rows = docs.select(key.alias("key"), text.cast("string").alias("text"))
    sent = rows.sparkSession.sparkContext.broadcast(network)
    empty = hashlib.sha256(b"").hexdigest()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            counts = np.zeros((3, n), np.int64)
            digests, spans, added, top = [empty] * n, [""] * n, np.zeros(n, np.int64), np.zeros(n)
            column = text_column(batch, "text")
            for block, hexes in zip(blocks.blocks(column, _CANDIDATES), blocks.blocks(column, _HEXES)):
                for d, base, more, score in scan_block(block, hexes, sent.value):
                    i = block.first + d
                    for _, k, _ in base:
                        counts[k, i] += 1
                    digests[i] = hashlib.sha256(_joined(base).encode()).hexdigest()
                    spans[i] = _joined(sorted(base + more))
                    added[i], top[i] = len(more), score
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added), pa.array(top)], ["key", *(x.split()[0] for x in RESULT.split(", "))])

    kind = rows.schema["key"].dataType.simpleString()
    return map_arrow(rows, step, f"key {kind}, {RESULT}")
