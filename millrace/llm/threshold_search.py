"""Ranked lexical search by the threshold algorithm over impact-sorted lists.

Documents are read once for each block of items: a row keeps its terms that items ask for, with their counts (the forward
index). Tasks then take the forward index in portions, sort each term's documents by impact, and answer every item by
sorted access to its terms' lists in rounds and random access to the forward index for every document met. A search ends
when the threshold, the sum of the impacts last seen, is strictly below the k-th score, for an equal score may come with a
smaller id. The k best of all tasks, k rows an item and task, are ranked at the end.

All sums are of 64-bit integers; only a term's weight takes a logarithm, in doubles.

What comes of each case: a null or empty text, or one without a term, is not counted and never found. Repeated rows are
documents of their own, so an id can come twice; rows with equal score and id are alike. A null id comes after all others of
its score. Rows of one item id are one item with the terms of all of them; an item without a term, or whose terms no
document has, gives no rows, as do empty tables. A document of any length is counted in parts. Ids keep their type. Only
the id and the text are read, so other columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import small_batches, spread, stash, stretches

TERMS_SENT = 500_000  # entries (item, term) that are searched in one pass over the documents
PORTION = 1_000_000  # entries of the forward index that a task searches at once
ROUND = 64  # documents of each list in the first round of a search; the next rounds take twice as many each
PART = 1 << 20

_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERM = bytes(b"0123456789" + _LETTERS.lower())
#: UTF-8 bytes with A-Z lowered and what is in no term made a space: terms are runs of letters, digits and all beyond ASCII.
_TABLE = bytes(b + 32 if b in _LETTERS else b if b in _TERM or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a whole text, in lists of bounded size."""
    for part in stretches((text or "").encode("utf-8", "surrogatepass").translate(_TABLE), PART):
        yield part.split()


def weight(docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, length: int, weights: np.ndarray) -> np.ndarray:
    """What each entry adds to a score: count tf in a document of n terms, weight of its term."""
    m = 100 - 50 + (50 * n * docs) // length
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def _count(terms: dict[bytes, int]):
    """id, n, terms, counts of the documents with a term: those of `terms` that they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, length, ends, held, counts = [], [], [0], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                n, found = 0, {}
                for some in terms_of(text):
                    n += len(some)
                    for t in some:
                        k = terms.get(t)
                        if k is not None:
                            found[k] = found.get(k, 0) + 1
                if n:
                    rows.append(i)
                    length.append(n)
                    held.extend(found)
                    counts.extend(found.values())
                    ends.append(len(held))
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(v, t)) for v, t in ((held, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(length, pa.int64()), *lists], names=["id", "n", "terms", "counts"])

    return run


class Portion:
    """The forward index of some documents, and their lists by term in order of impact."""

    def __init__(self, ends: np.ndarray, terms: np.ndarray, impact: np.ndarray, width: int):
        self.ends, self.terms, self.impact = ends, terms, impact
        doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        order = np.lexsort((doc, -impact, terms))
        self.listed, self.falling = doc[order], impact[order]
        self.starts = np.searchsorted(terms[order], np.arange(width + 1))
        self.wanted, self.met = np.zeros(width, bool), np.zeros(len(ends) - 1, bool)
        self.looked_up = 0

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Random access: the whole scores of docs for the terms in `wanted`."""
        begin, size = self.ends[docs], self.ends[docs + 1] - self.ends[docs]
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        at = np.arange(size.sum()) + np.repeat(begin - first, size)
        self.looked_up += len(docs)
        return np.add.reduceat(self.impact[at] * self.wanted[self.terms[at]], first)

    def search(self, terms: np.ndarray, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) among which are all of this portion that belong to the k best together with `known` scores."""
        at, end = self.starts[terms].copy(), self.starts[terms + 1]
        self.wanted[terms] = True
        best, docs, scores, step = np.sort(known)[-k:], [], [], ROUND
        while True:
            upto = np.minimum(at + step, end)
            new = np.unique(np.concatenate([self.listed[a:b] for a, b in zip(at, upto)]))
            new = new[~self.met[new]]
            if len(new):
                self.met[new] = True
                docs.append(new)
                scores.append(self.scores(new))
                best = np.sort(np.concatenate([best, scores[-1]]))[-k:]
            at = upto
            left = at < end
            # the impact last seen of each list that goes on; no document beyond has more
            threshold = self.falling[at[left] - 1].sum()
            if not left.any() or (len(best) == k and threshold < best[0]):
                break
            step *= 2
        self.wanted[terms] = False
        if not docs:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        docs, scores = np.concatenate(docs), np.concatenate(scores)
        self.met[docs] = False
        good = (scores > 0) & (scores >= (best[0] if len(best) == k else 1))
        return docs[good], scores[good]


def _key(x):
    return (x is None, x)


def _search(items: list[np.ndarray], item_ids: pa.Array, id_type: pa.DataType, weights: np.ndarray, docs: int, length: int, k: int):
    """The k best documents of a task for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in items]  # (-score, id) in order, k at most

        def answer(held: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(held)
            ids = rows.column("id").to_pylist()
            terms, counts = (rows.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("terms", "counts"))
            ends = np.concatenate([[0], np.cumsum(rows.column("terms").combine_chunks().value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            n = np.repeat(rows.column("n").to_numpy(), np.diff(ends))
            portion = Portion(ends, terms, impacts(counts, n, docs, length, weights[terms]), len(weights))
            for i, t in enumerate(items):
                found, scores = portion.search(t, k, np.array([-s for s, _ in best[i]], np.int64))
                if len(found):
                    best[i] = sorted(best[i] + [(-int(s), ids[d]) for d, s in zip(found, scores)], key=lambda x: (x[0], _key(x[1])))[:k]

        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b.column(2).flatten()) + len(b)
            if size >= PORTION:
                answer(held)
                held, size = [], 0
        if held:
            answer(held)
        for i, found in enumerate(best):
            if found:
                yield pa.RecordBatch.from_arrays(
                    [item_ids.take(pa.array([i] * len(found), pa.int64())), pa.array([d for _, d in found], id_type), pa.array([-s for s, _ in found], pa.int64())], names=["item_id", "doc_id", "score"]
                )

    return run


def _blocks(items: DataFrame, item_id: str, text: str, most: int) -> Iterator[list[tuple]]:
    """(id, terms) of the items in blocks of about `most` terms; one block at a time is held."""
    lists = items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).groupBy("i").agg(F.collect_set("t").alias("t"))
    block, size = [], 0
    for r in lists.toLocalIterator():
        terms = sorted({t for x in r["t"] for some in terms_of(x) for t in some})
        if terms:
            block.append((r["i"], terms))
            size += len(terms)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most: int = TERMS_SENT) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k documents of highest score above 0, equal ones by id.

    The items, a stated query set, go out in blocks of about `most` terms; each block is one pass over the documents.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kinds = [f.simpleString() for f in (docs.schema[doc_id].dataType, items.schema[item_id].dataType)]
    read = spread(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")))
    out = spark.createDataFrame([], f"item_id {kinds[1]}, doc_id {kinds[0]}, score bigint")
    for block in _blocks(items, item_id, item_text, most):
        terms = {t: i for i, t in enumerate(sorted({t for _, ts in block for t in ts}))}
        forward = stash(read.mapInArrow(_count(terms), f"id {kinds[0]}, n bigint, terms array<int>, counts array<bigint>"), "forward")
        total, length = forward.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not total:
            break
        weights = np.zeros(len(terms), np.int64)
        for t, holding in forward.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1))).collect():  # of the block's terms
            weights[t] = weight(total, holding)
        theirs, ours = (to_arrow_type(t) for t in (items.schema[item_id].dataType, docs.schema[doc_id].dataType))
        run = _search([np.array([terms[t] for t in ts]) for _, ts in block], pa.array([i for i, _ in block], theirs), ours, weights, total, length, k)
        out = out.unionByName(forward.where(F.size("terms") > 0).mapInArrow(run, f"item_id {kinds[1]}, doc_id {kinds[0]}, score bigint"))
    place = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return out.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
