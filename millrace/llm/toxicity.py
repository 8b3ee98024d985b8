"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and the starts of words. All terms of the examples are indexed, none is left out. A term weighs
(1 + log of its count in the text) times its IDF, times the root of its likelihood ratio between the classes, so that
words that matter for the label count most; both are counted over all labelled texts. A bounded number of labelled
examples is indexed: postings by term, with the largest weight of each block of examples. A query's blocks are taken by their upper bounds until none can beat the k-th best,
which makes the search exact; texts are searched together, so that a block's long lists are read once for many. Votes weigh by distance; a logistic map of the vote, fitted on the examples themselves
with each left out of its own vote, gives the score. The neighbours found are the evidence.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, spread, stretches

STARTS = (4, 5)
BLOCK = 64
CACHE, AT_ONCE = 400_000, 1_000_000
FLOOR = 0.1
LONG, TEXTS = 12, 250
_TERMS = "term bigint, y int, n bigint"
_SCORED = "doc_id bigint, score double, evidence array<struct<doc_id:bigint,label:int,cosine:double>>"


def words_of(text: str | None) -> dict[str, int]:
    """Lower-cased words, without marks at their ends, and how often each occurs."""
    found: Counter[str] = Counter()
    for part in stretches(text or "", AT_ONCE):
        found.update(part.lower().split())
    out: dict[str, int] = {}
    for w, n in found.items():
        if x := w.strip("\"'.,;:!?()[]{}<>|*&%$#@~^_-+=/\\"):
            out[x] = out.get(x, 0) + n
    return out


def terms_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STARTS if len(word) > n)]


@dataclass
class Index:
    """Examples as postings by term and block: examples at[into[t, b]:into[t, b+1]], weights w; peak: block maxima."""

    number: dict[str, int]
    idf: np.ndarray  # IDF times a term's factor for the classes
    into: np.ndarray
    at: np.ndarray
    w: np.ndarray
    peak: np.ndarray
    doc_id: list[int | None]
    label: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    rate: float = 0.0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_long"}  # made anew where it is used

    @property
    def long(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row by term of the terms that a LONG-th of the examples hold (-1: of the others), block by block their weights of
        its examples (zeros for those without a term), and their block maxima."""
        if not hasattr(self, "_long"):
            blocks = self.peak.shape[1]
            terms = np.flatnonzero((self.into[:, -1] - self.into[:, 0]) * LONG >= max(blocks, 1) * BLOCK)
            row, tiles = np.full(len(self.into), -1, np.int32), np.zeros((blocks, len(terms), BLOCK))
            row[terms] = np.arange(len(terms))
            for r, t in enumerate(terms.tolist()):
                at = self.at[self.into[t, 0] : self.into[t, -1]]
                tiles[at // BLOCK, r, at % BLOCK] = self.w[self.into[t, 0] : self.into[t, -1]]
            self._long = row, tiles, np.ascontiguousarray(self.peak[terms])
        return self._long

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k best with a common term; ties to the smaller example. skip: left out."""
        return self.search_all([(terms, weights)], k, np.array([skip]))[0]

    def search_all(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, skip: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """What `search` gives for each of vectors, together.

        Rare terms' lists are added up first. What they give at most in a block, and the maxima of the long lists there,
        bound the block; a text's blocks are taken by these bounds until none can beat the k-th best, and a block's long
        lists are read once for all texts that want it.
        """
        row, tiles, peak = self.long
        many, blocks = len(vectors), peak.shape[1]
        score, long = np.zeros((many, blocks, BLOCK)), np.zeros((many, peak.shape[0]))
        for i, (terms, weights) in enumerate(vectors):
            at = row[terms]
            rare = at < 0
            long[i, at[~rare]] = weights[~rare]
            first = self.into[terms[rare], 0]
            n = self.into[terms[rare], -1] - first
            ends = np.cumsum(n)
            flat = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + n, n)
            score[i] = np.bincount(self.at[flat], weights=self.w[flat] * np.repeat(weights[rare], n), minlength=blocks * BLOCK).reshape(blocks, BLOCK)
        bound = score.max(axis=2, initial=0) + long @ peak
        done, least = np.zeros((many, blocks), bool), np.zeros(many)
        want = np.zeros((many, blocks), bool)
        np.put_along_axis(want, np.argsort(-bound, axis=1, kind="stable")[:, :4], True, axis=1)
        for _ in range(2):
            want &= bound > 0
            for b in np.flatnonzero(want.any(axis=0)).tolist():
                who = np.flatnonzero(want[:, b])
                score[who, b] += (long if len(who) == many else long[who]) @ tiles[b]
            done |= want
            flat = np.where(done[:, :, None], score, 0.0).reshape(many, -1)
            if skip is not None:
                out = np.flatnonzero(skip >= 0)
                flat[out, skip[out]] = 0
            if flat.shape[1] >= k:
                least = np.partition(flat, -k, axis=1)[:, -k]
            want = ~done & (bound >= least[:, None] - 1e-12)
        found = []
        for one, low in zip(flat, least):
            hit = np.flatnonzero((one > 0) & (one >= low - 1e-12))
            hit = hit[np.lexsort((hit, -one[hit].round(12)))][:k]  # sums in another order differ in the last digits
            found.append((hit, one[hit]))
        return found

    def vector(self, words: dict[str, int], known: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
        """A text's terms and unit weights."""
        number, got = self.number, {}
        for w, n in words.items():
            t = known.get(w)
            if t is None:
                if len(known) >= CACHE:
                    known.clear()
                t = known[w] = tuple(number[x] for x in terms_of(w) if x in number)
            for x in t:
                got[x] = got.get(x, 0) + n
        t = np.fromiter(got, np.int64, len(got))
        by = np.argsort(t)
        return t[by], self.weights(t[by], np.fromiter(got.values(), float, len(got))[by])

    def weights(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = self.idf[terms] * (1 + np.log(counts))
        return v / max(np.sqrt((v**2).sum()), 1e-12)

    def vote(self, found: np.ndarray, best: np.ndarray) -> float:
        """Share of label 1 by weights 1 / (1.02 - cosine) ** 2, with one vote of weight 1 for the overall rate."""
        w = 1 / (1.02 - np.minimum(best, 1.0)) ** 2 if len(best) else np.empty(0)
        return float(((w * self.label[found]).sum() + self.rate) / (w.sum() + 1))

    def score(self, vote: float) -> float:
        x = np.log(max(vote, 1e-6) / max(1 - vote, 1e-6))
        return float(1 / (1 + np.exp(-(self.slope * x + self.shift))))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a weighted logistic fit, lightly drawn to slope 1 and shift 0."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(a * x + b)))
        r, s = weight * (p - y), weight * p * (1 - p)
        g = np.array([(r * x).sum() + (a - 1), r.sum() + b])
        h = np.array([[(s * x * x).sum() + 1, (s * x).sum()], [(s * x).sum(), s.sum() + 1]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def term_statistics(labelled: DataFrame, number: dict[str, int]) -> np.ndarray:
    """In how many labelled(text, y) of each label each numbered term occurs, as two rows."""
    held = labelled.sparkSession.sparkContext.broadcast(number)

    def count(batches):
        number, n = held.value, np.zeros((2, len(held.value)), np.int64)
        known: dict[str, tuple[int, ...]] = {}
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = set()
                for w in words_of(t):
                    x = known.get(w)
                    if x is None:
                        if len(known) >= CACHE:
                            known.clear()
                        x = known[w] = tuple(number[x] for x in terms_of(w) if x in number)
                    got.update(x)
                n[y, np.fromiter(got, np.int64, len(got))] += 1
        y, t = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(y, pa.int32()), pa.array(n[y, t], pa.int64())], names=["term", "y", "n"])

    out = np.zeros((2, len(number)))
    got = labelled.select("text", "y").mapInArrow(count, _TERMS).groupBy("term", "y").agg(F.sum("n").alias("n")).toArrow()  # terms of the examples
    out[got.column("y").to_numpy(), got.column("term").to_numpy()] = got.column("n").to_numpy()
    held.destroy()
    return out


def likelihood_ratio(n: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of terms that occur in n[y] of sizes[y] texts: how much likelier their counts are with a share for each label."""
    both = n.sum(axis=0)
    part = [np.where(c > 0, c * np.log(np.maximum(c, 1) * sizes.sum() / np.maximum(both * size, 1)), 0.0) for c, size in zip(n, sizes)]
    return np.maximum(2 * (part[0] + part[1]), 0)


def fit(labelled: DataFrame, *, per_label: int = 1500, k: int = 15) -> Index | None:
    """Index of labelled(doc_id, text, y 0/1); null where a label has no example.

    Term statistics are of all labelled rows. Indexed are about per_label examples of each label, chosen by hash, with
    all their terms. Rows of other labels and null texts are ignored.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    rows = labelled.where("text is not null and y in (0, 1)").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("y").cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return None
    share = F.when(F.col("y") == 1, min(1.0, per_label / sizes[1])).otherwise(min(1.0, per_label / sizes[0]))

    def terms(batches):
        for b in batches:
            names, counts = [], []
            for t in b.column(1).to_pylist():
                got: dict[str, int] = {}
                for w, n in words_of(t).items():
                    for x in terms_of(w):
                        got[x] = got.get(x, 0) + n
                by = sorted(got)
                names.append(by)
                counts.append([got[x] for x in by])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(names, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int32()))], names=["doc_id", "y", "terms", "counts"])

    chosen = rows.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(1_000_000)) < share * 1_000_000)
    table = chosen.mapInArrow(terms, "doc_id bigint, y int, terms array<string>, counts array<int>").toArrow()  # bounded by per_label
    every = pc.list_flatten(table.column("terms")).combine_chunks()
    names = pc.unique(every).sort().to_pylist()
    number = {t: i for i, t in enumerate(names)}
    flat = pc.index_in(every, value_set=pa.array(names, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
    tf = pc.list_flatten(table.column("counts")).to_numpy().astype(float)
    cuts = np.append(0, np.cumsum(pc.list_value_length(table.column("terms")).to_numpy()))
    got = [{"doc_id": i, "y": y, "terms": flat[a:b], "counts": tf[a:b]} for i, y, a, b in zip(table.column("doc_id").to_pylist(), table.column("y").to_pylist(), cuts, cuts[1:])]
    got.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["y"], r["terms"].tolist()))
    n = term_statistics(rows, number)
    idf = np.log(1 + sum(sizes.values()) / (n.sum(axis=0) + 1))
    index = Index(number, idf * (np.sqrt(likelihood_ratio(n, np.array([sizes[0], sizes[1]], float))) + FLOOR), *[np.empty(0)] * 4, [], np.empty(0))
    vecs = [(r["terms"], index.weights(r["terms"], r["counts"])) for r in got]
    term = np.concatenate([t for t, _ in vecs]) if vecs else np.empty(0, np.int64)
    who = np.repeat(np.arange(len(vecs)), [len(t) for t, _ in vecs])
    w = np.concatenate([v for _, v in vecs]) if vecs else np.empty(0)
    by = np.lexsort((who, term))
    index.at, index.w = who[by].astype(np.int32), w[by]
    blocks = -(-len(vecs) // BLOCK)
    ends = np.append(0, np.cumsum(np.bincount(term * blocks + who // BLOCK, minlength=len(names) * blocks))).astype(np.int32)
    index.into = np.column_stack([ends[:-1].reshape(len(names), blocks), ends[blocks::blocks] if blocks else ends[:0]])
    peak = np.zeros((len(names), blocks), np.float32)
    np.maximum.at(peak, (term, who // BLOCK), w.astype(np.float32))
    index.peak = np.nextafter(peak, np.float32(2), out=peak, where=peak > 0)  # not below the weights
    index.doc_id = [r["doc_id"] for r in got]
    index.label = np.array([r["y"] for r in got], float)
    true = sizes[1] / sum(sizes.values())
    index.rate = true
    parts = (index.search_all(vecs[i : i + TEXTS], k, np.arange(i, min(i + TEXTS, len(vecs)))) for i in range(0, len(vecs), TEXTS))
    votes = np.array([index.vote(*one) for part in parts for one in part])
    share1 = index.label.mean() if len(vecs) else true
    weight = np.where(index.label == 1, true / max(share1, 1e-9), (1 - true) / max(1 - share1, 1e-9))
    x = np.log(np.maximum(votes, 1e-6) / np.maximum(1 - votes, 1e-6))
    index.slope, index.shift = logistic(x, index.label, weight)
    return index


def score_toxicity(docs: DataFrame, index: Index | None, *, k: int = 15, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and evidence (neighbours, nearest first) for each row of docs.

    Texts are read whole. Null and empty texts, and texts without any indexed term, have no neighbours and get the score
    of the overall rate. Repeated rows score alike. Without an index all scores are 0. Other columns are ignored. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(index)  # bounded by per_label

    def scores(batches):
        ix = held.value
        known: dict[str, tuple[int, ...]] = {}
        memo: dict[bytes, tuple[float, list]] = {}
        for b in batches:
            texts = b.column(1).to_pylist()
            score, why = [0.0] * len(texts), [[] for _ in texts]
            for first in range(0, len(texts) if ix else 0, TEXTS):
                vectors = [ix.vector(words_of(t), known) for t in texts[first : first + TEXTS]]
                keys = [terms.tobytes() + weights.tobytes() for terms, weights in vectors]
                if len(memo) >= 2_000:  # keys of whole texts
                    memo.clear()
                new = {key: v for key, v in zip(keys, vectors) if key not in memo}
                for key, (found, best) in zip(new, ix.search_all(list(new.values()), k)):
                    memo[key] = ix.score(ix.vote(found, best)), [{"doc_id": ix.doc_id[i], "label": int(ix.label[i]), "cosine": float(c)} for i, c in zip(found, best)]
                for i, key in enumerate(keys, first):
                    score[i], why[i] = memo[key]
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array(why, kind)], names=["doc_id", "score", "evidence"])

    return spread(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))).mapInArrow(scores, _SCORED)
