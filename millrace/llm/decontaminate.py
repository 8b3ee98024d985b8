"""Benchmark decontamination by latent semantic retrieval.

Every text is read once, whole, as numbers of the benchmark's words, and kept so. Passages are TF-IDF vectors over those
words, with document frequencies counted over the whole corpus: the corpus's own, stretches of PASSAGE words, and the
benchmark's. A randomised SVD of the corpus's passages (one pass; what each task sums up is added on the executors) and
one of the benchmark's give the axes of the latent space. Every text is then searched as overlapping windows of three
lengths; a window near a passage by the cosine of its latent vector, over the length of its whole TF-IDF vector, is a
candidate. A candidate is a leak if the longest common subsequence of words holds most of the passage, or half of it
together with its answer: the answer's words where the benchmark has that column, else the passage's rarest words.

The space has fewer dimensions than a large benchmark has passages, and then keeps little of each. So a stretch is a
candidate too, whatever its cosine, if it holds so many of a passage's rarest words as a leak must hold: a common
subsequence of c of n words has at least k of its words among any n - c + k of the passage. No leak within twice the
passage's length is missed, however large benchmark and corpus are, or however much the words around a short item weigh.
Of an item of under five words, half would say nothing: it is a leak where all of it occurs as a run of words.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, spread, stash, stretches

PASSAGE, STRIDE, LEAST = 64, 48, 5
GRID = 8
SHELF = 64
AXES, GROUPS, AT_ONCE = 24, 16, 1_000_000
_NUMBERED = "doc_id bigint, words binary"
_DF = "word int, n bigint"
_PART = "grp int, part binary"
_FOUND = "doc_id bigint, item_id bigint, cosine double, lcs double, answer double, at bigint"
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def words_of(text: bytes | None) -> list[bytes]:
    """Words lower-cased (A-Z), ASCII marks taken out."""
    return (text or b"").lower().translate(None, _MARKS).split()


def numbers_of(text: str | bytes | None, number: dict[bytes, int]) -> np.ndarray:
    """A text's words as numbers; words that have none get the number after the last."""
    get, none = number.get, len(number)
    parts = [np.array([get(w, none) for w in words_of(p if isinstance(p, bytes) else p.encode())], np.uint32) for p in stretches(text or b"", AT_ONCE)]
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def lcs(places: dict, length: int, words: list) -> int:
    """Length of the longest common subsequence of a passage, as bit masks of its words' places, and words."""
    v = full = (1 << length) - 1
    for w in words:
        m = places.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


@dataclass
class Space:
    """Some passages and their latent space. Words have the numbers of `own`, those that no passage here has the last."""

    own: np.ndarray  # from the benchmark's numbers
    loading: np.ndarray  # words + a row of zeros, by dimensions, times idf
    mass: np.ndarray  # squared idf of words, and of words that no passage has
    latent: np.ndarray  # unit vectors of passages
    item: list[int]
    places: list[dict[int, int]]
    length: list[int]
    answer: list[frozenset[int]]  # the benchmark's numbers
    whole: list[list[int] | None]  # words of passages under LEAST words
    least: np.ndarray  # of a passage's rarest words, how many a leak holds
    shelves: list[tuple[np.ndarray, np.ndarray]]  # for SHELF passages each: who[into[w]:into[w + 1]] have w among their rarest
    held: tuple[np.ndarray, np.ndarray]  # passage * words + word of what passages hold, rising, and how often
    need: np.ndarray  # words of a passage that a leak has in common with it


def shelves_of(lists: list[list[int]], df: np.ndarray, partial: float) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Space.least and Space.shelves of passages as word numbers, for leaks of at least the share `partial` of a passage."""
    least, shelves = np.zeros(len(lists), np.int64), []
    for i in range(0, len(lists), SHELF):
        term, who = [], []
        for p, ws in enumerate(lists[i : i + SHELF], i):
            need = max(1, math.ceil(partial * len(ws) - 1e-9)) if len(ws) >= LEAST else len(ws)
            least[p] = max(min(2, need), need // 4)
            w, times = np.unique(ws, return_counts=True)
            by = np.lexsort((w, df[w]))
            rare = w[by[: np.searchsorted(np.cumsum(times[by]), len(ws) - need + least[p]) + 1]]
            term.append(rare)
            who.append(np.full(len(rare), p))
        t, p = np.concatenate(term), np.concatenate(who)
        by = np.lexsort((p, t))
        shelves.append((np.searchsorted(t[by], np.arange(len(df) + 2)), p[by]))
    return least, shelves


def passages_of(items: list[tuple[int, bytes | None, bytes | None]]) -> list[tuple[int, list[bytes], frozenset[bytes]]]:
    """(item, words, answer words) of passages of at most PASSAGE words; items without words have none."""
    out = []
    for i, text, answer in items:
        w = words_of(text)
        if i is None or not w:
            continue
        for a in range(0, max(1, len(w) - (PASSAGE - STRIDE)), STRIDE):
            out.append((i, w[a : a + PASSAGE], frozenset(words_of(answer))))
    return out


def numbered(docs: DataFrame, number: dict[bytes, int], doc_id: str | None, text: str) -> DataFrame:
    """doc_id and words (numbers of four bytes) of every row, written to the shared folder."""
    held = docs.sparkSession.sparkContext.broadcast(number)  # words of the benchmark

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([numbers_of(t, held.value).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "words"])

    return stash(spread(docs.select((F.col(doc_id) if doc_id else F.lit(None)).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))).mapInArrow(run, _NUMBERED), "leak-words")


def document_frequency(words: DataFrame, many: int) -> tuple[np.ndarray, int]:
    """In how many texts each of so many words occurs, and the number of texts."""

    def count(batches):
        n, total = np.zeros(many + 1, np.int64), 0
        for b in batches:
            total += b.num_rows
            for x in b.column(0).to_pylist():
                n[np.unique(np.frombuffer(x, np.uint32))] += 1
        n[many] = total
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["word", "n"])

    out = np.zeros(many + 1, np.int64)
    for r in words.select("words").mapInArrow(count, _DF).groupBy("word").agg(F.sum("n").alias("n")).collect():  # words of the benchmark
        out[r["word"]] = r["n"]
    return out[:many], int(out[many])


def gram(ids: np.ndarray, passage: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, rows): the rows that are not zero of A'(A basis), A the unit TF-IDF vectors of passages.

    ids are words of passages, their numbers rising; words that have no idf are left out.
    """
    live = ids < len(idf)
    key, count = np.unique(passage[live].astype(np.int64) * len(idf) + ids[live], return_counts=True)
    if not len(key):
        return np.empty(0, np.int64), np.empty((0, basis.shape[1]))
    passage, word = np.divmod(key, len(idf))
    w = np.log1p(count) * idf[word]
    first = np.flatnonzero(np.diff(passage, prepend=-1))
    which = np.repeat(np.arange(len(first)), np.diff(first, append=len(key)))
    w = (w / np.maximum(np.sqrt(np.add.reduceat(w * w, first)), 1e-12)[which]).astype(basis.dtype)[:, None]
    inside = np.add.reduceat(basis[word] * w, first, axis=0)
    by = np.argsort(word, kind="stable")
    at = np.flatnonzero(np.diff(word[by], prepend=-1))
    return word[by][at], np.add.reduceat(inside[which[by]] * w[by], at, axis=0)


def corpus_axes(words: DataFrame, own: np.ndarray, idf: np.ndarray, axes: int, seed: int) -> np.ndarray:
    """The leading axes of the corpus's passages, by a randomised SVD in one pass: a random basis, A'(A basis), its axes.

    A task sums its passages into one table; tables are added where their parts meet, one at a time.
    """
    spark, many = words.sparkSession, len(idf)
    basis = np.random.default_rng(seed).standard_normal((many, axes + 8)).astype(np.float32)
    cuts = np.linspace(0, many, GROUPS + 1).astype(int)
    held = spark.sparkContext.broadcast((own, idf, basis))  # words of a block of passages

    def sums(batches):
        own, idf, basis = held.value
        table = np.zeros(basis.shape, np.float32)
        for b in batches:
            texts = [np.frombuffer(x, np.uint32) for x in b.column(0).to_pylist()]
            for begin, end in portions(texts):
                ids = own[np.concatenate(texts[begin:end])]
                size = np.array([len(x) for x in texts[begin:end]])
                each = -(-size // PASSAGE)
                place = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
                at, rows = gram(ids, np.repeat(np.cumsum(each) - each, size) + place // PASSAGE, idf, basis)
                table[at] += rows
        yield pa.RecordBatch.from_arrays([pa.array(range(GROUPS), pa.int32()), pa.array([table[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], names=["grp", "part"])

    def add(batches):
        out: dict[int, np.ndarray] = {}
        for b in batches:
            for g, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(part, np.float32)
                out[g] = out[g] + x if g in out else x.astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([v.tobytes() for v in out.values()], pa.binary())], names=["grp", "part"])

    table = np.zeros(basis.shape)
    for r in words.select("words").mapInArrow(sums, _PART).repartition(GROUPS, "grp").mapInArrow(add, _PART).collect():  # one table
        table[cuts[r["grp"]] : cuts[r["grp"] + 1]] = np.frombuffer(r["part"]).reshape(-1, basis.shape[1])
    u, s, _ = np.linalg.svd(table, full_matrices=False)
    return u[:, :axes][:, s[:axes] > 1e-9 * max(s.max(initial=0.0), 1e-300)]


def fit(words: DataFrame, passages: list[tuple[int, list[int], frozenset[int]]], df: np.ndarray, total: int, *, partial: float = 0.5, rank: int = 96, rounds: int = 3, seed: int = 5) -> Space:
    """The latent space of some passages and their rarest words, words weighed by their rarity in the corpus."""
    used = np.unique(np.concatenate([np.array(ws) for _, ws, _ in passages]))
    own = np.full(len(df) + 1, len(used), np.int64)
    own[used] = np.arange(len(used))
    often = df[used].astype(float)
    idf = np.log((total + 1) / (often + 1)) + 1e-3
    lists = [own[ws] for _, ws, _ in passages]
    ids, which = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    axes = corpus_axes(words, own, idf, min(AXES, len(used) // 4), seed)
    size = min(rank - axes.shape[1], len(used) - axes.shape[1], len(passages))
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(used), size + 8 if size + 8 <= len(used) else size)))[0]

    def product(m: np.ndarray) -> np.ndarray:
        out = np.zeros(m.shape)
        at, rows = gram(ids, which, idf, m)
        out[at] = rows
        return out

    for _ in range(rounds):
        basis = np.linalg.qr(product(basis))[0]
    small = basis.T @ product(basis)
    _, turn = np.linalg.eigh((small + small.T) / 2)
    basis = np.linalg.qr(np.hstack([axes, basis @ turn[:, ::-1][:, :size]]))[0]
    key, count = np.unique(which * len(used) + ids, return_counts=True)
    row, word = np.divmod(key, len(used))
    latent = np.add.reduceat(basis[word] * (np.log1p(count) * idf[word])[:, None], np.flatnonzero(np.diff(row, prepend=-1)), axis=0)
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    loading = np.vstack([basis * idf[:, None], np.zeros((1, basis.shape[1]))]).astype(np.float32)
    places, answers = [], []
    for ws, (_, theirs, answer) in zip(lists, passages):
        p: dict[int, int] = {}
        for j, w in enumerate(ws.tolist()):
            p[w] = p.get(w, 0) | 1 << j
        places.append(p)
        rare = sorted(p, key=lambda w: (-idf[w], w))[: max(3, len(p) // 4)]
        answers.append(answer or frozenset(used[rare].tolist()))
    mass = np.append(idf, np.log(total + 2)).astype(np.float32) ** 2
    short = [ws.tolist() if len(ws) < LEAST else None for ws in lists]
    return Space(own, loading, mass, latent.astype(np.float32), [i for i, _, _ in passages], places, [len(ws) for ws in lists], answers, short, *shelves_of([ws.tolist() for ws in lists], often, partial), (key, count), np.array([math.ceil(partial * len(ws) - 1e-9) if len(ws) >= LEAST else len(ws) for ws in lists]))


def portions(docs: list[np.ndarray], words: int = 100_000):
    """(first, end) of runs of texts of about so many words together, so that windows of long texts fit a worker."""
    first, n = 0, 0
    for i, d in enumerate(docs):
        n += len(d)
        if n >= words:
            yield first, i + 1
            first, n = i + 1, 0
    if first < len(docs):
        yield first, len(docs)


def gridded(docs: list[np.ndarray], space: Space) -> tuple[np.ndarray, np.ndarray]:
    """The space's word numbers of some texts, each filled up to whole cells of GRID, and each text's first cell and the end."""
    cells = [-(-len(d) // GRID) for d in docs]
    starts = np.cumsum([0] + cells)
    ids = np.full(starts[-1] * GRID, len(space.loading) - 1, np.int64)
    for d, a in zip(docs, starts.tolist()):
        ids[a * GRID : a * GRID + len(d)] = space.own[d]
    return ids, starts


def candidates(ids: np.ndarray, starts: np.ndarray, space: Space, least: float):
    """(text, passage, first word, last word, cosine) of windows of some texts near a passage."""
    if not len(ids):
        return
    pad = np.zeros((8, space.loading.shape[1] + 1), np.float32)
    one = np.empty((len(ids) // GRID + 8, pad.shape[1]), np.float32)
    for i in range(0, len(ids), 1 << 16):  # what is gathered at once fits the cache
        part = ids[i : i + (1 << 16)]
        out = one[i // GRID : (i + len(part)) // GRID]
        out[:, 0] = space.mass[part].reshape(-1, GRID).sum(axis=1)
        out[:, 1:] = space.loading[part].reshape(-1, GRID, pad.shape[1] - 1).sum(axis=1)
    one[-8:] = pad
    two = one[:-1] + one[1:]
    four = two[:-2] + two[2:]
    eight = four[:-4] + four[4:]
    for width, sums in ((2, two), (4, four[::2]), (8, eight[::4])):
        step = width // 2
        size = np.sqrt(sums[:, 0])
        inside = np.sqrt(np.einsum("ij,ij->i", sums[:, 1:], sums[:, 1:]))
        live = np.flatnonzero(inside > np.maximum(least * size, 1e-9))  # no cosine can be more than inside / size
        for i in range(0, len(live), 8192):
            at = live[i : i + 8192]
            cos = (sums[at, 1:] @ space.latent.T) / size[at][:, None]
            r, p = np.nonzero(cos >= least)
            first = at[r] * step
            which = np.searchsorted(starts, first, side="right") - 1
            for d, q, b, c in zip(which.tolist(), p.tolist(), first.tolist(), cos[r, p].tolist()):
                if d < len(starts) - 1:
                    a = (b - int(starts[d])) * GRID
                    yield d, q, a, a + width * GRID, c


def holding(ids: np.ndarray, starts: np.ndarray, space: Space):
    """(text, passage, i) where words (i - 1) n to (i + 2) n, n the passage's length, hold as many of its rarest words as a leak."""
    if not len(ids):
        return
    n = np.array(space.length)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts) * GRID)
    place = np.arange(len(ids)) - starts[text] * GRID
    span = int(place.max()) + 6  # no stretch meets another text or passage
    for into, who in space.shelves:
        many = into[ids + 1] - into[ids]
        live = np.flatnonzero(many)
        many = many[live]
        ends = np.cumsum(many)
        if not len(live):
            continue
        p = who[np.arange(ends[-1]) + np.repeat(into[ids[live]] - ends + many, many)]
        at = np.repeat(live, many)
        key, count = np.unique((p * (len(starts) - 1) + text[at]) * span + place[at] // n[p] + 2, return_counts=True)
        sums = np.append(0, np.cumsum(count))
        held = lambda x, far: sums[np.searchsorted(key, x + far, side="right")] - sums[np.searchsorted(key, x - far)]
        enough = lambda x, far: x[held(x, far) >= space.least[x // span // (len(starts) - 1)]]
        some = enough(key, 2)
        mid = enough(np.unique(np.concatenate([some - 1, some, some + 1])), 1)
        p, d = np.divmod(mid // span, len(starts) - 1)
        for d, q, i in zip(d.tolist(), p.tolist(), (mid % span - 2).tolist()):
            if i >= 0:
                yield d, q, i


def sharing(ids: np.ndarray, starts: np.ndarray, space: Space, found, words: int = 2_000_000):
    """Those of `holding` whose stretch has as many words in common with the passage, in any order, as a leak must have."""
    (own, times), many = space.held, len(space.loading) - 1
    every = np.array(list(found), np.int64).reshape(-1, 3)
    n = np.array(space.length)[every[:, 1]]
    lo = np.maximum(0, (every[:, 2] - 1) * n)
    hi = np.minimum((every[:, 2] + 2) * n, (starts[every[:, 0] + 1] - starts[every[:, 0]]) * GRID)
    size = np.maximum(hi - lo, 0)
    for part in np.split(np.arange(len(every)), np.flatnonzero(np.diff(np.cumsum(size) // words)) + 1):
        k = size[part]
        at = np.arange(k.sum()) + np.repeat(starts[every[part, 0]] * GRID + lo[part] - np.cumsum(k) + k, k)
        word, which = ids[at], np.repeat(np.arange(len(part)), k)
        live = word < many
        key, count = np.unique(which[live] * many + word[live], return_counts=True)
        which, word = np.divmod(key, many)
        want = every[part, 1][which] * many + word
        place = np.minimum(np.searchsorted(own, want), len(own) - 1)
        both = np.where(own[place] == want, np.minimum(times[place], count), 0)
        common = np.bincount(which, weights=both, minlength=len(part))
        for d, p, mid in every[part][common >= space.need[every[part, 1]]].tolist():
            yield d, p, mid


def leaks(docs: list[np.ndarray], space: Space, *, near: float, verbatim: float, partial: float, answered: float) -> dict[tuple[int, int], tuple[float, float, float, int]]:
    """For (text, item): cosine, share of the passage in the longest common subsequence, share of the answer, place."""
    out: dict[tuple[int, int], tuple[float, float, float, int]] = {}
    for begin, end in portions(docs):
        ids, starts = gridded(docs[begin:end], space)
        done: set[tuple[int, int, int]] = set()

        def judge(d: int, p: int, lo: int, hi: int, cos: float | None) -> None:
            n, text, whole = space.length[p], docs[begin + d][lo:hi], space.whole[p]
            at = starts[d] * GRID + lo
            words = ids[at : at + len(text)].tolist()
            share = lcs(space.places[p], n, words) / n
            if share < partial or whole and not any(words[i : i + n] == whole for i in range(len(words) - n + 1)):
                return
            have = len(space.answer[p].intersection(text.tolist())) / max(1, len(space.answer[p]))
            if whole or share >= verbatim or have >= answered:
                key = (begin + d, space.item[p])
                if key not in out or share > out[key][1]:
                    out[key] = (latent_cosine(ids[at : at + len(text)], p, space) if cos is None else cos, share, have, lo)

        for d, p, a, b, cos in candidates(ids, starts, space, near):
            n = space.length[p]
            mid = (a + b) // 2 // n
            if (d, p, mid) not in done:  # else a neighbouring window has covered this stretch
                done.add((d, p, mid))
                judge(d, p, max(0, min(a, mid * n) - n), max(b, mid * n + n) + n, cos)
        for d, p, mid in sharing(ids, starts, space, (h for h in holding(ids, starts, space) if h not in done)):
            n = space.length[p]
            judge(d, p, max(0, mid * n - n), mid * n + 2 * n, None)
    return out


def latent_cosine(ids: np.ndarray, p: int, space: Space) -> float:
    """Cosine of some words and a passage as for windows."""
    return float(space.loading[ids].sum(axis=0) @ space.latent[p] / math.sqrt(max(space.mass[ids].sum(), 1e-12)))


def _spaces(docs: DataFrame, benchmark: DataFrame, doc_id: str | None, text: str, answer: str | None, block: int, partial: float) -> tuple[dict[bytes, int], DataFrame | None, list[Space]]:
    """Numbers of the benchmark's words, the texts in them, and latent spaces of `block` passages at most: what a task
    holds has that bound."""
    cols = [F.col("item_id").cast("bigint"), F.col("text").cast("binary"), (F.col(answer).cast("binary") if answer else F.lit(None).cast("binary"))]
    every = passages_of([(r[0], r[1] and bytes(r[1]), r[2] and bytes(r[2])) for r in benchmark.select(*cols).toLocalIterator()])
    if not every:
        return {}, None, []
    every.sort(key=lambda x: (x[0], x[1]))
    number = {w: i for i, w in enumerate(sorted({w for _, ws, answer in every for w in (*ws, *answer)}))}
    words = numbered(docs, number, doc_id, text)
    df, total = document_frequency(words, len(number))
    told = [(i, [number[w] for w in ws], frozenset(number[w] for w in answer)) for i, ws, answer in every]
    return number, words, [fit(words, told[i : i + block], df, total, partial=partial) for i in range(0, len(told), block)]


OPTIONS = {"near": 0.3, "verbatim": 0.8, "partial": 0.5, "answered": 0.6}


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", answer: str | None = None, block: int = 5000, **options: float) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer, at: one row for each row of docs and benchmark(item_id, text) item it leaks.

    lcs is the share of the item's passage in the longest common subsequence with the text, answer that of its answer's
    words there, `at` the place in words. Texts are read whole. Null and empty texts leak nothing; items whose id is
    null or that have no word are not sought; items of under five words are leaked where they occur whole. Repeated rows are reported each; repeated items once for each id.
    Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    opts = OPTIONS | options
    out = spark.createDataFrame([], _FOUND)
    _, words, spaces = _spaces(docs, benchmark, doc_id, text, answer, block, opts["partial"])
    for space in spaces:
        held = spark.sparkContext.broadcast(space)

        def search(batches, held=held):
            for b in batches:
                ids = b.column(0).to_pylist()
                found = leaks([np.frombuffer(x, np.uint32) for x in b.column(1).to_pylist()], held.value, **opts)
                rows = [(ids[d], i, *v) for (d, i), v in sorted(found.items())]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                cols = list(zip(*rows)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "cosine", "lcs", "answer", "at"])

        out = out.unionByName(words.mapInArrow(search, _FOUND))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", answer: str | None = None, block: int = 5000, **options: float) -> DataFrame:
    """docs without the rows that leak an item, columns as they were; see find_leaks."""
    small_batches(docs.sparkSession)
    opts = OPTIONS | options
    at = docs.columns.index(text)
    number, _, spaces = _spaces(docs, benchmark, None, text, answer, block, opts["partial"])
    known = docs.sparkSession.sparkContext.broadcast(number)
    for space in spaces:
        held = docs.sparkSession.sparkContext.broadcast(space)

        def keep(batches, held=held):
            for b in batches:
                found = leaks([numbers_of(t, known.value) for t in b.column(at).to_pylist()], held.value, **opts)
                bad = {d for d, _ in found}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
