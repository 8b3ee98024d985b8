"""Quality classifier: random-indexing word vectors pooled by document, then a two-layer network.

Random indexing: every word has a sparse random index vector that its hash determines; a word's context vector is the
sum of the index vectors of its neighbours over the whole corpus. Words share a fixed number of rows by hash, so the
table has one size for every corpus. The stream of a text is its lower-cased words without the marks at their ends, and
a marker of its own for each word that ends in marks, is in capitals, or repeats the word before. A document is the
mean of its rows, weighted down by their frequency, and the shares of the markers. The network (one hidden layer, tanh)
is trained in numpy on a bounded sample of labelled documents, half of each label where there are enough. Its temperature
is fitted on a part of the sample held back, at the sample's rate; only then are the logits shifted to the true rate.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, splitmix, spread, stretches

ROWS, DIMS, HOTS, REACH = 1 << 14, 32, 2, 2
MARKS = 64
CACHE, AT_ONCE = 500_000, 1_000_000
GROUPS = 16
_END = re.compile(rb"[^A-Za-z0-9\x80-\xff]+$")
_PART = "grp int, part binary"
_POOLED = "doc_id bigint, y int, x array<float>"
_SCORED = "doc_id bigint, score double"


class Stream:
    """Texts to row numbers: markers first (0..MARKS-1), then words by hash."""

    def __init__(self) -> None:
        self.known: dict[bytes, tuple[int, ...]] = {}

    def _look(self, word: bytes) -> tuple[int, ...]:
        end = _END.search(word)
        core = word[: end.start()] if end else word
        out = []
        if core:
            out.append(MARKS + xxhash.xxh3_64_intdigest(core.lower()) % (ROWS - MARKS))
        if end and len(end[0]) > 1 or not core:
            out.append(1 + xxhash.xxh3_64_intdigest(word[len(core) :]) % (MARKS - 4))
        if len(core) > 1 and core.isupper():
            out.append(MARKS - 1)
        return tuple(out)

    def rows(self, text: bytes | None) -> np.ndarray:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        out: list[int] = []
        last = None
        for w in (text or b"").split():
            r = known.get(w)
            if r is None:
                r = known[w] = self._look(w)
            out += r
            if w == last:
                out.append(0)
            last = w
        return np.array(out, np.int64)

    def features(self, text: bytes | None, vectors: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """`pooled` of a text, of which AT_ONCE characters are held as words at a time. The first word of a later part
        doesn't count as a repeat."""
        sums = None
        for part in stretches(text or b"", AT_ONCE):
            s = summed(self.rows(part), vectors, weight)
            sums = s if sums is None else tuple(a + b for a, b in zip(sums, s))
        return pooled(*(sums or summed(np.empty(0, np.int64), vectors, weight)))


def index_vectors(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row HOTS coordinates and their signs."""
    h = splitmix(np.arange(ROWS * HOTS, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)).reshape(ROWS, HOTS)
    return (h % np.uint64(DIMS)).astype(np.int64), np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)


def context_vectors(docs: DataFrame, *, text: str = "text", seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Unit context vectors (ROWS by DIMS) and counts of rows, over all texts of docs.

    A task sums its texts into one table, in parts; parts are added where they meet, one at a time.
    """
    spark = docs.sparkSession
    small_batches(spark)
    at, sign = index_vectors(seed)
    width = DIMS + 1
    per = ROWS // GROUPS

    def gather(batches):
        table, stream = np.zeros((ROWS, width)), Stream()

        def count(held: list[np.ndarray]) -> None:
            r = np.concatenate([x for d in held for x in (d, np.full(REACH, -1))])
            for gap in range(1, REACH + 1):
                a, c = r[:-gap], r[gap:]
                ok = (a >= 0) & (c >= 0)
                a, c = a[ok], c[ok]
                for h in range(HOTS):
                    for x, y in ((a, c), (c, a)):
                        table[:, :DIMS] += np.bincount(x * DIMS + at[y, h], weights=sign[y, h], minlength=ROWS * DIMS).reshape(ROWS, DIMS)
            table[:, DIMS] += np.bincount(r[r >= 0], minlength=ROWS)

        for b in batches:
            held, size = [], 0
            for t in b.column(0).to_pylist():
                for part in stretches(t or b"", AT_ONCE):  # so many characters are held as words at a time
                    held.append(stream.rows(part))
                    size += len(part)
                    if size >= AT_ONCE:
                        count(held)
                        held, size = [], 0
            if held:
                count(held)
        parts = [table[g * per : (g + 1) * per].astype(np.float32).tobytes() for g in range(GROUPS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(GROUPS), pa.int32()), pa.array(parts, pa.binary())], names=["grp", "part"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for g, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(part, np.float32)
                sums[g] = sums[g] + x if g in sums else x.astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype(np.float32).tobytes() for v in sums.values()], pa.binary())], names=["grp", "part"])

    parts = spread(docs.select(F.col(text).cast("binary").alias("text"))).mapInArrow(gather, _PART)
    table = np.zeros((ROWS, width), np.float32)
    for r in parts.repartition(GROUPS, "grp").mapInArrow(add, _PART).collect():  # one row a group
        table[r["grp"] * per : (r["grp"] + 1) * per] = np.frombuffer(r["part"], np.float32).reshape(per, width)
    vectors, counts = table[:, :DIMS].astype(float), table[:, DIMS].astype(float)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9), counts


def summed(rows: np.ndarray, vectors: np.ndarray, weight: np.ndarray) -> tuple:
    """What `pooled` is made of, to be added up over parts of a text: words, markers, weights, weighted vectors."""
    w = weight[rows]
    return len(rows), np.bincount(rows[rows < MARKS], minlength=MARKS), w.sum(), (vectors[rows] * w[:, None]).sum(axis=0)


def pooled(n: int, marks: np.ndarray, weight: float, vector: np.ndarray) -> np.ndarray:
    """A document's features: weighted mean of its rows' vectors, shares of markers, whether it has words, log length."""
    return np.concatenate([vector / max(weight, 1e-9), np.sqrt(marks / max(n, 1)), [float(n > 0), np.log1p(n) / 10]])


@dataclass
class Model:
    """Word table and network; rate is the answer where nothing could be learned."""

    vectors: np.ndarray
    weight: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float] | None
    temperature: float
    rate: float
    shift: float = 0.0  # of the logits, from the sample's rate to the true one

    def features(self, pools: list[np.ndarray]) -> np.ndarray:
        return (np.array(pools) - self.centre) / self.spread

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(x @ w1 + b1) @ w2 + b2

    def scores(self, stream: Stream, texts: list[bytes | None]) -> np.ndarray:
        if self.layers is None or not texts:
            return np.full(len(texts), self.rate)
        return self.calibrated(self.logits(self.features([stream.features(t, self.vectors, self.weight) for t in texts])))

    def calibrated(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logits / self.temperature + self.shift, -60, 60)))


def train(x: np.ndarray, y: np.ndarray, *, hidden: int = 32, epochs: int = 60, rate: float = 0.01, decay: float = 1e-4, seed: int = 3):
    """Weights of the network by Adam on batches of 128 and log loss."""
    rng = np.random.default_rng(seed)
    p = [rng.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), rng.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 128):
            xb, yb = x[order[i : i + 128]], y[order[i : i + 128]]
            h = np.tanh(xb @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -60, 60))) - yb) / len(xb)
            dh = np.outer(d, p[2]) * (1 - h**2)
            g = [xb.T @ dh + decay * p[0], dh.sum(axis=0), h.T @ d + decay * p[2], np.array([d.sum()])]
            t += 1
            for k in range(4):
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return p[0], p[1], p[2], float(p[3][0])


def temperature_of(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    def loss(s: float) -> float:
        z = logits / np.exp(s)
        return float(np.logaddexp(0, np.where(y == 1, -z, z)).mean()) + 1e-3 * s * s

    a, b, g = -2.0, 3.0, (5**0.5 - 1) / 2
    while b - a > 1e-3:
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(docs: DataFrame, labelled: DataFrame, *, text: str = "text", sample: int = 6000) -> Model:
    """Word table from all texts of docs; network from about `sample` rows of labelled(doc_id, text, y 0/1), half of each
    label where there are enough, chosen by hash and weighted back to the true rate by a shift of the logits.

    Rows of other labels are ignored, null texts count as empty. Where a label has no row, as in an empty table, the model
    answers the labels' rate.
    """
    spark = docs.sparkSession
    small_batches(spark)
    vectors, counts = context_vectors(docs, text=text)
    weight = 1e-3 / (1e-3 + counts / max(counts.sum(), 1.0))
    rows = labelled.where("y in (0, 1)").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.col("y").cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n = {y: sizes.get(y, 0) for y in (0, 1)}
    rate = n[1] / max(n[0] + n[1], 1)
    width = DIMS + MARKS + 2
    blank = Model(vectors, weight, np.zeros(width), np.ones(width), None, 1.0, rate)
    if not all(n.values()):
        return blank
    share = F.when(F.col("y") == 1, min(1.0, sample / 2 / n[1])).otherwise(min(1.0, sample / 2 / n[0]))
    held = spark.sparkContext.broadcast((vectors, weight))  # one size for every corpus

    def pool(batches):
        stream = Stream()
        for b in batches:
            x = [stream.features(t, *held.value).astype(np.float32) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([v.tolist() for v in x], pa.list_(pa.float32()))], names=["doc_id", "y", "x"])

    chosen = rows.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(9)), F.lit(1_000_000)) < share * 1_000_000)
    got = chosen.mapInArrow(pool, _POOLED).collect()  # about `sample` rows
    got.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], r["y"], r["x"]))
    x, y = np.array([r["x"] for r in got], float), np.array([r["y"] for r in got], float)
    if len(set(y.tolist())) < 2:
        return blank
    centre, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    x = (x - centre) / spread
    part = np.random.default_rng(1).permutation(len(x)) % 5 == 0
    w1, b1, w2, b2 = train(x[~part], y[~part])
    shift = np.log(rate / (1 - rate)) - np.log(y.mean() / (1 - y.mean()))
    model = Model(vectors, weight, centre, spread, (w1, b1, w2, b2), 1.0, rate, float(shift))
    z = model.logits(x[part])
    model.temperature = temperature_of(z, y[part]) if part.any() else 1.0
    return model


def score_quality(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier): one row for each row of docs.

    Texts are read whole; null and empty ones are scored as texts without words. Repeated rows score alike. Other
    columns are ignored. An empty table gives an empty result; without both labels every score is the labels' rate.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def scores(batches):
        stream = Stream()
        for b in batches:
            got = held.value.scores(stream, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])

    return spread(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))).mapInArrow(scores, _SCORED)
