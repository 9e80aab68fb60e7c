"""Secret scans: base patterns, and a character convolutional network over every candidate and its surroundings.

Candidates are the base patterns' matches and all other tokens with letters and digits, or with a lower-case letter before an upper-case one. A
small network in numpy (embedded characters, one convolution, maximum over places, one output) is trained on all labelled findings: matches of base patterns
in their context, against ordinary long words of any text; candidates beyond base matches are in neither label. A part held back calibrates its output
(Platt scaling), and the threshold is the highest with which the wanted recall of held-back secrets is reached. All candidates are
scored; base matches count as secrets whatever their score, other candidates from the threshold on.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, discard, materialize

#: The base patterns in the order in which they are listed.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "network")
MIN_ASSIGNED, MIN_ACCESS = 6, 20
#: Candidates besides base matches: tokens of at least so many characters.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
MIN_TOKEN = 8
MIXED = re.compile(r"[a-z][A-Z]")
TOKEN_PART = re.compile(r"[A-Za-z0-9+/_=-]")
WORD = re.compile(r"[^\W\d_]{9,}")

LEFT, BODY, RIGHT = 24, 40, 8
WIDTH = LEFT + BODY + RIGHT
SYMBOLS, EMBED, TAPS, FILTERS = 97, 8, 5, 24
EPOCHS, BATCH, RATE, SEED = 12, 64, 0.01, 7
RECALL = 0.98
#: One of so many findings is held back; with fewer of a label than LEAST nothing is trained.
HELD_OF, LEAST = 5, 10
#: Findings trained in one run between two averages, how many of each label these must hold (or all there are), and tasks of an epoch.
SHARD_ROWS, LEAST_IN_SHARD, TASKS = 8192, 128, 256

_FLAT = bytes(0x31 if 0x30 <= b <= 0x39 else 0x61 if 0x61 <= b <= 0x7A else 0x41 if 0x41 <= b <= 0x5A else 0x2B if b in b"+/_=-" else 0x20 for b in range(256))
_HEX = bytes(0x68 if b in b"0123456789abcdef" else 0x20 for b in range(256))


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(begin, kind, end) of the base matches; the kind is its place in KINDS. Cheap searches of the bytes come first."""
    spans = []
    low = raw.lower()
    if any(w in low for w in (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= MIN_ASSIGNED]
    if b"AKIA" in raw:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if b"h" * 24 in raw.translate(_HEX):
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def candidates(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """The base spans of a text, and the spans of its other candidates."""
    if not text:
        return [], []
    raw = text.encode("utf-8", "surrogatepass")
    flat = raw.translate(_FLAT)
    base = base_spans(text, raw)
    others = []
    if any(len(t) >= MIN_TOKEN and (b"aA" in t or b"1" in t and (b"a" in t or b"A" in t)) for t in flat.split()):
        taken, at, reach = [(a, b) for a, _, b in base], 0, 0
        for m in TOKEN.finditer(text):
            token = m[0]
            # Base spans and tokens both come in order: what begins before the token's end may reach into it.
            while at < len(taken) and taken[at][0] < m.end():
                reach = max(reach, taken[at][1])
                at += 1
            named = any(c.isdigit() for c in token) and any(c.isalpha() for c in token) or MIXED.search(token)
            if named and reach <= m.start():
                others.append((m.start(), m.end()))
    return base, others


def window(text: str, begin: int, end: int) -> np.ndarray:
    """The characters around and within a candidate at fixed places, as symbols: 0 nothing, 1 beyond ASCII, then ASCII from the space on."""
    if end - begin > BODY:
        body = text[begin : begin + BODY // 2] + text[end - BODY // 2 : end]
    else:
        body = text[begin:end]
    shown = text[max(0, begin - LEFT) : begin].rjust(LEFT, "\0") + body.ljust(BODY, "\0") + text[end : end + RIGHT].ljust(RIGHT, "\0")
    codes = np.frombuffer(shown.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes == 0, 0, np.where((codes >= 0x20) & (codes < 0x7F), codes - 0x20 + 2, 1)).astype(np.uint8)


@dataclass
class Network:
    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float
    scale: float = 1.0
    offset: float = 0.0
    threshold: float = 1.1

    def forward(self, x: np.ndarray) -> tuple:
        # What a symbol adds to a filter at each tap is looked up.
        tables = self.embed @ self.kernel.reshape(TAPS, EMBED, FILTERS)
        x, places = x.astype(np.intp), x.shape[1] - TAPS + 1
        h = tables[0].take(x[:, :places], 0)
        for i in range(1, TAPS):
            h += tables[i].take(x[:, i : i + places], 0)
        at = h.argmax(axis=1)
        top = np.maximum(np.take_along_axis(h, at[:, None, :], 1)[:, 0] + self.bias, 0)
        return at, top, top @ self.out + self.shift

    def outputs(self, x: np.ndarray) -> np.ndarray:
        parts = [self.forward(x[i : i + 512])[2] for i in range(0, len(x), 512)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * self.outputs(x) + self.offset)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Training:
    """Weights of a network as one vector, with Adam's moments and steps: what an epoch changes."""

    SHAPES = ((SYMBOLS, EMBED), (TAPS * EMBED, FILTERS), (FILTERS,), (FILTERS,), ())

    def __init__(self, rng: np.random.Generator):
        drawn = rng.normal(0, 0.3, (SYMBOLS, EMBED)), rng.normal(0, 0.2, (TAPS * EMBED, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, FILTERS), np.zeros(1)
        self.weights = np.concatenate([d.ravel() for d in drawn])
        self.first, self.second, self.step = np.zeros_like(self.weights), np.zeros_like(self.weights), 0.0

    def network(self) -> Network:
        ends = np.cumsum([int(np.prod(shape)) for shape in self.SHAPES])
        parts = [p.reshape(shape) for p, shape in zip(np.split(self.weights, ends[:-1]), self.SHAPES, strict=True)]
        return Network(*parts[:4], float(parts[4]))

    def vector(self) -> np.ndarray:
        return np.concatenate([self.weights, self.first, self.second, [self.step]])

    def become(self, vector: np.ndarray) -> None:
        self.weights, self.first, self.second = vector[:-1].reshape(3, -1).copy()
        self.step = float(vector[-1])

    def epoch(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        """One pass over all windows in a random order; both labels weigh the same."""
        weight = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
        order = rng.permutation(len(y))
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            g = self.gradient(x[pick], y[pick], weight[pick])
            self.step += 1
            self.first += 0.1 * (g - self.first)
            self.second += 0.001 * (g * g - self.second)
            self.weights -= RATE * (self.first / (1 - 0.9**self.step)) / (np.sqrt(self.second / (1 - 0.999**self.step)) + 1e-8)

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        net = self.network()
        at, top, z = net.forward(x)
        d = (_sigmoid(z) - y) * weight / len(y)
        dh = np.outer(d, net.out) * (top > 0)
        # By symbol, tap and filter: what reached a filter through this symbol there.
        taps = np.arange(TAPS)
        symbols = x[np.arange(len(x))[:, None, None], at[:, :, None] + taps].astype(np.intp)
        cells = (symbols * TAPS + taps) * FILTERS + np.arange(FILTERS)[:, None]
        through = np.bincount(cells.ravel(), np.repeat(dh.ravel(), TAPS), SYMBOLS * TAPS * FILTERS).reshape(SYMBOLS, TAPS * FILTERS)
        embed = through @ net.kernel.reshape(TAPS, EMBED, FILTERS).transpose(0, 2, 1).reshape(-1, EMBED)
        kernel = (net.embed.T @ through).reshape(EMBED, TAPS, FILTERS).transpose(1, 0, 2)
        return np.concatenate([embed.ravel(), kernel.ravel(), dh.sum(0), top.T @ d, [d.sum()]])


def calibrated(net: Network, z: np.ndarray, t: np.ndarray) -> Network:
    """The network with scale, offset and threshold from outputs and labels held back."""
    scale, offset = 1.0, 0.0
    n1, n0 = t.sum(), (1 - t).sum()
    soft = np.where(t == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(200):
        d = (_sigmoid(scale * z + offset) - soft) / len(z)
        scale, offset = scale - 0.1 * float(d @ z), offset - 0.1 * float(d.sum())
    net.scale, net.offset = scale, offset
    secrets = np.sort(_sigmoid(scale * z[t == 1] + offset))
    net.threshold = float(secrets[int((1 - RECALL) * len(secrets))])
    return net


def train(x: np.ndarray, y: np.ndarray) -> Network:
    """A network from windows and labels (1: secret) in memory. A fifth is held back to calibrate; with one label alone nothing is ever found."""
    rng = np.random.default_rng(SEED)
    training = Training(rng)
    held = np.arange(len(y)) % HELD_OF == HELD_OF - 1
    if min(y.sum(), (1 - y).sum()) < LEAST or len(set(y[held])) < 2:
        return training.network()
    for _ in range(EPOCHS):
        training.epoch(x[~held], y[~held], rng)
    net = training.network()
    return calibrated(net, net.outputs(x[held]), y[held])


def learn(df: DataFrame, text: str = "text", *, shard_rows: int = SHARD_ROWS) -> Network:
    """A network from all findings of a table, trained where these are: nothing is left out, however many there are.

    Findings are dealt by hash to shards of about `shard_rows`. In each epoch every shard trains from the same weights over all it
    has, and the weights are averaged; with one shard that is plain training. Findings of a label too rare for LEAST_IN_SHARD in each
    shard stand in several. A fifth, by the hash of the window, is held back; all of it calibrates. The driver gets at most TASKS
    sums of weights an epoch, and in the end the outputs of what is held back (9 bytes each).
    """
    rows = findings(df, text)
    held = F.pmod(F.col("h"), F.lit(HELD_OF)) == HELD_OF - 1
    counts = {(r["label"], r["held"]): r["count"] for r in rows.groupBy("label", held.alias("held")).count().collect()}
    training = Training(np.random.default_rng(SEED))
    trained = [counts.get((k, False), 0) for k in (0, 1)]
    seen = trained[0] + counts.get((0, True), 0), trained[1] + counts.get((1, True), 0)
    if min(seen) < LEAST or min(trained) == 0 or len([c for c in counts if c[1]]) < 2:
        discard(rows)
        return training.network()
    n = -(-sum(trained) // shard_rows)
    times = [min(n, -(-LEAST_IN_SHARD * n // k)) for k in trained]
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("label") == 0, times[0] - 1).otherwise(times[1] - 1))).alias("copy")
    dealt = rows.where(~held).select("label", "window", "h", F.xxhash64("t", "window").alias("at"), copies)
    dealt = dealt.select("label", "window", "h", F.pmod(F.pmod("at", F.lit(n)) + F.col("copy"), F.lit(n)).cast("int").alias("shard"))
    dealt = dealt.repartition(min(n, TASKS), "shard").sortWithinPartitions("shard", "h", "window", "label").select("shard", "label", "window").persist(StorageLevel.DISK_ONLY)
    for number in range(EPOCHS):

        def epoch(batches, start=training.vector(), number=number):
            total, size, first, one = np.zeros_like(start), 0, None, Training(np.random.default_rng(SEED))
            for shard, x, y in _shards(batches):
                one.become(start)
                one.epoch(x, y, np.random.default_rng([SEED, number, shard]))
                total, size, first = total + len(y) * one.vector(), size + len(y), shard if first is None else first
            if size:
                yield pa.RecordBatch.from_pydict({"first": [first], "size": [size], "total": [total.tobytes()]}, _SUMS)

        sums = sorted(dealt.mapInArrow(epoch, "first int, size long, total binary").collect(), key=lambda r: r["first"])
        training.become(sum(np.frombuffer(r["total"]) for r in sums) / sum(r["size"] for r in sums))
    dealt.unpersist()
    net = training.network()

    def outputs(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_pydict({"z": [net.outputs(_windows(b["window"].to_pylist())).tobytes()], "label": [bytes(b["label"].to_pylist())]}, _OUTPUTS)

    parts = rows.where(held).select("label", "window").mapInArrow(outputs, "z binary, label binary").collect()
    discard(rows)
    z, t = np.frombuffer(b"".join(bytes(r["z"]) for r in parts)), np.frombuffer(b"".join(bytes(r["label"]) for r in parts), np.uint8).astype(int)
    order = np.lexsort((t, z))
    return calibrated(net, z[order], t[order])


_SUMS = pa.schema([("first", pa.int32()), ("size", pa.int64()), ("total", pa.binary())])
_OUTPUTS = pa.schema([("z", pa.binary()), ("label", pa.binary())])


def _windows(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(r) for r in rows), np.uint8).reshape(-1, WIDTH)


def _shards(batches):
    """(shard, windows, labels) of runs of rows of one shard, which may reach over batches."""
    now, windows, labels = None, [], []
    for b in batches:
        for shard, label, shown in zip(b["shard"].to_pylist(), b["label"].to_pylist(), b["window"].to_pylist(), strict=True):
            if shard != now:
                if labels:
                    yield now, _windows(windows), np.array(labels)
                now, windows, labels = shard, [], []
            windows.append(shown)
            labels.append(label)
    if labels:
        yield now, _windows(windows), np.array(labels)


def ordinary(text: str, base: list[tuple[int, int, int]]) -> tuple[int, int] | None:
    """The span of a text's first long word that neither meets a base match nor is a part of a candidate."""
    for m in WORD.finditer(text):
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        if not (TOKEN_PART.match(before) or TOKEN_PART.match(after) or MIXED.search(m[0]) or any(a < m.end() and m.start() < b for a, _, b in base)):
            return m.span()
    return None


def example(text: str, begin: int, end: int, bare: bool) -> bytes:
    """A window for training: of every other span (by its hash) only what stands in it, if `bare`, so that shape counts beside context."""
    shown = window(text, begin, end).tobytes()
    return window(text[begin:end], 0, end - begin).tobytes() if bare and zlib.crc32(shown) & 1 else shown


def findings(df: DataFrame, text: str = "text") -> DataFrame:
    """All labelled findings, written in the shared folder: t (hash of the text), label, window, h (hash of the window); copies of a text count once.

    Base matches are secrets, one ordinary word of each text is none. An assigned value is shown with what names it, for it may be
    a plain word. The texts are read once.
    """

    @F.pandas_udf("array<struct<label:int,window:binary>>")
    def of_texts(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            raw = (t or "").encode("utf-8", "surrogatepass")
            base = base_spans(t or "", raw)
            rows = [{"label": 1, "window": example(t, ASSIGN.match(t, a).start(1) if k == 0 else a, b, k > 0)} for a, k, b in base]
            if word := ordinary(t or "", base):
                rows.append({"label": 0, "window": example(t, *word, True)})
            out.append(rows)
        return pd.Series(out, dtype=object)

    rows = df.select(F.xxhash64(column(text)).alias("t"), F.explode(of_texts(column(text))).alias("f"))
    return materialize(rows.select("t", "f.label", "f.window", F.xxhash64("f.window").alias("h")).distinct(), "findings")


def labelled(df: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels of all findings, in the order of their hash, in the driver's memory: for `train`, on tables whose findings fit there."""
    rows = findings(df, text)
    got = rows.select("label", "window", "h").collect()
    discard(rows)
    got.sort(key=lambda r: (r["h"], bytes(r["window"]), r["label"]))
    return _windows([r["window"] for r in got]), np.array([r["label"] for r in got], int)


def found(texts: list[str | None], net: Network) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], list[float | None]]]:
    """For each text the base spans and all spans, (begin, kind, end) in order, and the network's probability of each of all (null if it isn't trained)."""
    both = [candidates(t) for t in texts]
    at = [(i, *span) for i, (base, others) in enumerate(both) for span in [*base, *((a, 3, b) for a, b in others)]]
    every: list[list[tuple]] = [[] for _ in both]
    trained = net.threshold <= 1
    # An assigned value is scored as it is trained: at the value, with what names it on the left.
    begins = [ASSIGN.match(texts[i], a).start(1) if k == 0 else a for i, a, k, _ in at]
    p = net.probability(np.stack([window(texts[i], a, b) for (i, _, _, b), a in zip(at, begins, strict=True)])).tolist() if trained and at else [None] * len(at)
    for (i, a, k, b), q in zip(at, p, strict=True):
        if k < 3 or trained and q >= net.threshold:
            every[i].append((a, k, b, q))
    for spans in every:
        spans.sort(key=lambda s: s[:3])
    return [(base, [s[:3] for s in spans], [s[3] for s in spans]) for (base, _), spans in zip(both, every, strict=True)]


def redacted(text: str | None, spans: list[tuple[int, int, int]], mark: str) -> str | None:
    """The text with each run of overlapping spans replaced by the mark."""
    if not spans:
        return text
    parts, at = [], 0
    for a, _, b in spans:
        if a >= at:
            parts += [text[at:a], mark]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def scan(df: DataFrame, net: Network, text: str = "text", out: str = "secrets", *, mark: str = "[SECRET]") -> DataFrame:
    """df with a struct column `out`: base and spans (arrays of kind, begin, end in order of begin, then kind), the redacted text, and scores, the network's
    probability for each of spans (null where the network isn't trained).

    Positions are code points, ends exclusive. Null and empty texts have no spans; null stays null. Whole texts are searched, in time that grows with their
    length; repeated rows get equal results, an empty table gives an empty one. Spans of one begin are ordered by kind. Other columns stay as they are, whatever
    their names (one called like `out` is replaced).
    """
    shared = df.sparkSession.sparkContext.broadcast(net)
    span = "array<struct<kind:string,begin:int,end:int>>"

    @F.pandas_udf(f"base {span}, spans {span}, redacted string, scores array<double>")
    def scanned(given: pd.Series) -> pd.DataFrame:
        texts = list(given)
        named = lambda spans: [{"kind": KINDS[k], "begin": a, "end": b} for a, k, b in spans]
        rows = [(named(base), named(spans), redacted(t, spans, mark), scores) for t, (base, spans, scores) in zip(texts, found(texts, shared.value), strict=True)]
        return pd.DataFrame(rows, columns=["base", "spans", "redacted", "scores"])

    return df.withColumn(out, scanned(column(text)))
