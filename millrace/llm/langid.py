"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary. Each language has a probability for every piece, fitted by
expectation maximisation on a bounded sample of labelled texts. A word's probability in a language is the sum over all
its segmentations into pieces, by a forward recursion over its characters; a text's is the product over its words.
Words are lower-cased and stand with the vocabulary's mark of a word's start. A character that no piece holds counts as
a piece of its own with a fixed small probability, so that every word has a segmentation. Words may be of any length, as
in scripts without spaces: sums over long ones are taken on logarithms.
"""

from __future__ import annotations

import hashlib
import re
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, mix, small_batches, spread, stretches

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
START = "▁"
LETTER = re.compile(r"[^\W\d_]")
LONG, CACHE, AT_ONCE = 32, 300_000, 200_000
UNKNOWN, SCALE = 1e-7, 20.0
_PIECES = "lang string, docs bigint, piece array<string>, p array<double>"


def pieces_of(path: str = VOCABULARY) -> frozenset[str]:
    """Pieces of the vocabulary that a lower-cased word can hold, without controls and bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return frozenset(p for p in found if p == p.lower())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Pieces:
    """Pieces by number, and a sorted table of the keys of all their beginnings: number, or -1 for a mere beginning.

    The key of a text of one more character is mix(key before, character).
    """

    def __init__(self, names: list[str]) -> None:
        self.names = names
        every = {p[:n]: -1 for p in names for n in range(1, len(p))}
        every.update((p, i) for i, p in enumerate(names))
        self.longest = max(map(len, names))
        number = []
        keys = []
        for n in range(1, self.longest + 1):
            some = [x for x in every if len(x) == n]
            if some:
                table = _codes("".join(some)).reshape(len(some), n)
                key = np.zeros(len(some), np.uint64)
                for j in range(n):
                    key = mix(key, table[:, j])
                keys.append(key)
                number += [every[x] for x in some]
        keys = np.concatenate(keys)
        by = np.argsort(keys)
        self.keys, self.number = keys[by], np.array(number, np.int64)[by]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key begins a piece, and the number if so."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, self.number[at]


@lru_cache(maxsize=4)
def _index(path: str) -> Pieces:
    return Pieces(sorted(pieces_of(path)))


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


class Lattices:
    """The segmentation lattices of some words as arrays: arcs from node to node, each with a piece's number.

    A word has a node before each of its characters and one at its end; its mark of a start is a character. Arcs are
    grouped by the place of their end node, for forward sums, and of their start node, for backward sums. Unknown
    characters have the number after the last piece.
    """

    def __init__(self, words: list[str], index: Pieces) -> None:
        self.length = np.array([len(w) + 1 for w in words], np.int64)
        ends = np.cumsum(self.length)
        codes = _codes(START + START.join(words)) if words else np.empty(0, np.uint64)
        word = np.repeat(np.arange(len(words)), self.length)
        left = ends[word] - np.arange(len(codes))  # characters from here to the word's end
        self.nodes = len(codes) + len(words)
        self.first = ends - self.length + np.arange(len(words))
        self.last = self.first + self.length
        live, key = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        single = np.zeros(len(codes), bool)
        start, piece, chars = [], [], []
        for n in range(1, index.longest + 1):
            fits = left[live] >= n
            live, key = live[fits], key[fits]
            key = mix(key, codes[live + n - 1])
            known, number = index.find(key)
            live, key, number = live[known], key[known], number[known]
            hit = number >= 0
            start.append(live[hit])
            piece.append(number[hit])
            chars.append(np.full(int(hit.sum()), n))
            if n == 1:
                single[live[hit]] = True
        alone = np.flatnonzero(~single)
        start, piece, chars = np.concatenate([*start, alone]), np.concatenate([*piece, np.full(len(alone), len(index.names))]), np.concatenate([*chars, np.ones(len(alone), np.int64)])
        self.word = word[start]  # of each arc
        self.start = start + self.word
        self.end = self.start + chars
        self.piece, self.chars = piece, chars.astype(float)
        self.place = self.start - self.first[self.word]

    @cached_property
    def up(self) -> list:
        return [self._runs(arcs, self.end) for arcs in self._levels(self.end - self.first[self.word], self.end, range(1, int(self.length.max(initial=0)) + 1))]

    @cached_property
    def down(self) -> list:
        return [self._runs(arcs, self.start) for arcs in self._levels(self.place, self.start, range(int(self.length.max(initial=0))))]

    @staticmethod
    def _levels(places: np.ndarray, nodes: np.ndarray, wanted: range) -> list[np.ndarray]:
        by = np.lexsort((nodes, places))
        return np.split(by, np.searchsorted(places[by], wanted)[1:]) if len(wanted) else []

    @staticmethod
    def _runs(arcs: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arcs, where each node's run of them begins, and the nodes."""
        at = np.flatnonzero(np.diff(node[arcs], prepend=-1))
        return arcs, at, node[arcs[at]]

    def forward(self, weight: np.ndarray) -> np.ndarray:
        """Sums over all paths from a word's first node, for weight(arc[, language])."""
        a = np.zeros((self.nodes, *weight.shape[1:]))
        a[self.first] = 1.0
        for arcs, at, nodes in self.up:
            a[nodes] = np.add.reduceat(a[self.start[arcs]] * weight[arcs], at, axis=0)
        return a

    def _log_sums(self, out: np.ndarray, levels: list, at_end: np.ndarray, weight: np.ndarray) -> np.ndarray:
        for arcs, at, nodes in levels:
            x = out[at_end[arcs]] + weight[arcs]
            top = np.maximum.reduceat(x, at, axis=0)
            many = np.diff(at, append=len(arcs))
            out[nodes] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, many, axis=0)), at, axis=0))
        return out

    def log_forward(self, weight: np.ndarray) -> np.ndarray:
        """As forward, of and on logarithms: for words of any length."""
        a = np.full((self.nodes, *weight.shape[1:]), -np.inf)
        a[self.first] = 0.0
        return self._log_sums(a, self.up, self.start, weight)

    def log_backward(self, weight: np.ndarray) -> np.ndarray:
        b = np.full(self.nodes, -np.inf)
        b[self.last] = 0.0
        return self._log_sums(b, self.down[::-1], self.end, weight)

    def backward(self, weight: np.ndarray) -> np.ndarray:
        b = np.zeros(self.nodes)
        b[self.last] = 1.0
        for arcs, at, nodes in reversed(self.down):
            b[nodes] = np.add.reduceat(b[self.end[arcs]] * weight[arcs], at)
        return b


def parts_of(words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Places of short words and of long ones, in portions of bounded size; long ones by length."""
    size = np.array([len(w) for w in words], np.int64)
    short, long = np.flatnonzero(size <= LONG), np.argsort(size, kind="stable")
    long = long[size[long] > LONG]
    cut = lambda at, most: np.split(at, np.flatnonzero(np.diff(np.cumsum(size[at] + 1) // most)) + 1) if len(at) else []
    return cut(short, 160_000), cut(long, 20_000)


def log_probs(words: list[str], index: Pieces, probs: np.ndarray) -> np.ndarray:
    """log of each word's probability in each language: probs has a row for each piece, the last for unknown."""
    out, logs = np.empty((len(words), probs.shape[1])), None
    short, long = parts_of(words)
    for at in short:
        lat = Lattices([words[i] for i in at], index)
        scaled = probs[lat.piece] * (SCALE**lat.chars)[:, None]  # keeps words from underflow; taken back below
        out[at] = np.log(np.maximum(lat.forward(scaled)[lat.last], 1e-300)) - (lat.length * np.log(SCALE))[:, None]
    for at in long:
        logs = np.log(probs) if logs is None else logs
        lat = Lattices([words[i] for i in at], index)
        out[at] = lat.log_forward(logs[lat.piece])[lat.last]
    return out


def fit_one(counts: dict[str, int], index: Pieces, rounds: int, smooth: float) -> np.ndarray:
    """Piece probabilities from word counts of one language, by EM over all segmentations; smoothed evenly."""
    n = len(index.names)
    p = np.full(n + 1, 1.0 / n)
    p[n] = UNKNOWN
    words, c = list(counts), np.array(list(counts.values()), float)
    short, long = parts_of(words)
    for _ in range(rounds):
        want = np.full(n, smooth)
        for at in short:
            lat = Lattices([words[i] for i in at], index)
            w = p[lat.piece] * SCALE**lat.chars
            a, b = lat.forward(w), lat.backward(w)
            share = c[at] / np.maximum(a[lat.last], 1e-300)
            want += np.bincount(lat.piece, weights=share[lat.word] * a[lat.start] * w * b[lat.end], minlength=n + 1)[:n]
        for at in long:
            lat = Lattices([words[i] for i in at], index)
            w = np.log(p)[lat.piece]
            a, b = lat.log_forward(w), lat.log_backward(w)
            want += np.bincount(lat.piece, weights=c[at][lat.word] * np.exp(a[lat.start] + w + b[lat.end] - a[lat.last][lat.word]), minlength=n + 1)[:n]
        p[:n] = want / want.sum() * (1 - UNKNOWN)
    return p


def fit(labelled: DataFrame, *, path: str = VOCABULARY, per_lang: int = 400, rounds: int = 3, smooth: float = 0.05) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages by code point, log priors, and probabilities (pieces + unknown by languages) from labelled(text, lang).

    Learns piece probabilities from about per_lang texts of each language, chosen by hash of the text; all labelled
    texts count for the priors. Rows whose lang or text is null are ignored; of an empty table nothing is learned, and all
    texts are then undetermined.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    rows = labelled.where("text is not null and lang is not null").select("text", "lang")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return [], np.zeros(0), np.zeros((0, 0))
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_lang / n))]), F.col("lang"))
    chosen = rows.where(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1_000_000)) < share * 1_000_000)

    def learn(table: pa.Table) -> pa.Table:
        counts: dict[str, int] = {}
        for t in table.column("text").to_pylist():
            for w in words_of(t):
                counts[w] = counts.get(w, 0) + 1
        index = _index(path)
        p = fit_one(counts, index, rounds, smooth)
        used = np.flatnonzero(p[:-1] > p[:-1].min() * 1.5)
        return pa.table([pa.array([table.column("lang")[0].as_py()]), pa.array([table.num_rows], pa.int64()), pa.array([[index.names[i] for i in used]], pa.list_(pa.string())), pa.array([p[used].tolist()], pa.list_(pa.float64()))], names=["lang", "docs", "piece", "p"])

    models = {r["lang"]: r for r in chosen.groupBy("lang").applyInArrow(learn, _PIECES).collect()}
    langs = sorted(models)
    number = {p: i for i, p in enumerate(_index(path).names)}
    probs = np.full((len(number) + 1, len(langs)), 1e-9)
    for j, lang in enumerate(langs):
        probs[[number[x] for x in models[lang]["piece"]], j] = models[lang]["p"]
    probs[-1] = UNKNOWN
    total = sum(sizes[x] for x in langs)
    return langs, np.log(np.array([sizes[x] / total for x in langs])), probs


class Scorer:
    """Log probabilities of words, kept while a worker lives, up to a bounded number."""

    def __init__(self, probs: np.ndarray, path: str) -> None:
        self.index, self.probs = _index(path), probs
        self.known: dict[str, int] = {}
        self.rows = np.empty((CACHE, probs.shape[1]))

    def learn(self, words: set[str]) -> None:
        """Make room for words of a batch and work out those not known."""
        new = list(words - self.known.keys())
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = list(words)
        if len(self.known) + len(new) > len(self.rows):
            self.rows = np.resize(self.rows, (len(self.known) + len(new), self.rows.shape[1]))
        n = len(self.known)
        self.rows[n : n + len(new)] = log_probs(new, self.index, self.probs)
        self.known.update(zip(new, range(n, n + len(new))))

    def texts(self, texts: list[str]) -> np.ndarray:
        """Sums over the words of texts, of which AT_ONCE characters are held as words at a time."""
        out, held, size = np.zeros((len(texts), self.probs.shape[1])), [], 0

        def add() -> None:
            self.learn({w for _, x in held for w in x})
            known = self.known
            at = np.array([known[w] for _, x in held for w in x], np.int64)
            np.add.at(out, [i for i, _ in held], np.add.reduceat(self.rows[at], np.cumsum([0] + [len(x) for _, x in held[:-1]]), axis=0))

        for i, t in enumerate(texts):
            for part in stretches(t, AT_ONCE):
                if words := words_of(part):
                    held.append((i, words))
                    size += len(part)
                    if size >= AT_ONCE:
                        add()
                        held, size = [], 0
        if held:
            add()
        return out


_scorers: dict[bytes, Scorer] = {}


def scorer_of(probs: np.ndarray, path: str) -> Scorer:
    """The worker's scorer for a model; another model's goes."""
    key = hashlib.blake2b(probs.tobytes() + path.encode()).digest()
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(probs, path)
    return _scorers[key]


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], *, path: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs; with keep, all columns of docs and these two.

    lang_pred is the language of greatest posterior, of equals the first; score is that posterior. A null text, one
    without a letter, and any text where no language was learned, is `und` with score 0. Texts are read whole. Repeated
    rows are judged alike. With keep, input columns named lang_pred or score are replaced. An empty table gives an
    empty result.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    langs, priors, probs = model
    held = spark.sparkContext.broadcast(probs)  # pieces of a fixed vocabulary times languages

    def say(batches):
        scorer = scorer_of(held.value, path) if langs else None
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            fit = [i for i, t in enumerate(texts) if scorer is not None and t and LETTER.search(t)]
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            for i, x in zip(fit, scorer.texts([texts[i] for i in fit]) if fit else []):
                x = x + priors
                k = int(np.argmax(x))
                pred[i], score[i] = langs[k], float(1 / np.exp(x - x[k]).sum())
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in kept], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*kept, "lang_pred", "score"])
        give_back()

    if keep:
        docs = docs.drop("lang_pred", "score")
    else:
        docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias(text))
    docs = spread(docs)
    kept = docs.columns if keep else ["doc_id"]
    fields = [f for f in docs.schema.fields if f.name in kept]
    return docs.mapInArrow(say, T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
