"""Join near duplicates by n-gram Jaccard similarity with a MinHash LSH forest.

Texts of one set of shingles are one class and are handled once. A class has a label in each tree of the forest: its
signature's values there, in order. A tree is the prefix trie of its labels, kept as labels sorted by (tree, prefix).
Classes are matched on whole labels first; then the matched prefixes are shortened by one value at a time, each time
adding the pairs that share no longer prefix in any tree. Every pair is verified exactly on shingle sets. A verified
pair of similarity s was to be found at depth d with probability 1 - (1 - s ** d) ** trees, so that the pairs found tell
how many were missed; shortening ends when that share is within the target, or at the depth where even a pair at the
threshold would be found almost surely.

A pair belongs to the first tree in which it has its longest common prefix. Labels tell which members of a prefix have
new pairs there; only their texts travel. Prefixes of the least depth with more than a cell's members are joined to
clusters first, for many near copies meet under each prefix of most trees. A cluster's pairs are verified once, all of
them, on shingles made once: its members are dealt to the cells of a square grid whose side is bounded by the root of
the number of tasks, or by the memory of a cell. What remains are prefixes within a cell, without the pairs inside a
cluster. Both give link counts and a spanning forest of links, never the pairs, so that results stay linear in the
input; links become groups by star contraction.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SENT, join_often, join_sized, mix, small_batches, splitmix, spread, stash

TREES, DEPTH = 20, 8
CELL = 256
CACHE = 400_000
_SIGNED = "r1 bigint, r2 bigint, cls binary, sig binary"
_MET = ["tree", "prefix"]
_CELL = ["root", "x", "y"]
_NEED = "tree int, prefix binary, cls binary, root binary"
_SETS = "root binary, cls binary, size bigint, shingles binary"
_LINKS = "a binary, b binary, n bigint, alike int"
BINS = 1000
HELD = 64 << 20  # bytes of shingles in a block of a cluster


def found_share(similarity: float, trees: int, depth: int) -> float:
    """The probability that two sets share a prefix of that depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The greatest depth at which a pair at the threshold shares a prefix in some tree with probability recall."""
    while depth > 1 and found_share(threshold, trees, depth) < recall:
        depth -= 1
    return depth


def missed(found: dict[float, int], threshold: float, trees: int, depth: int) -> float:
    """How many pairs matching at that depth has missed, by the pairs found of each similarity and one at the threshold."""
    share = {s: found_share(s, trees, depth) for s in found}
    return sum(n * (1 - share[s]) / share[s] for s, n in found.items()) + 1 - found_share(threshold, trees, depth)


class Shingler:
    """Texts to sorted distinct 64-bit shingles. Words are lower-cased (A-Z) and split at ASCII white space."""

    def __init__(self, words: int) -> None:
        self.n = words
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        h = []
        for w in (text or b"").lower().split():
            k = known.get(w)
            if k is None:
                k = known[w] = xxhash.xxh3_64_intdigest(w)
            h.append(k)
        if not h:
            return np.empty(0, np.uint64)
        x = np.array(h, np.uint64)
        n = min(self.n, len(x))  # a shorter text is one shingle
        s = splitmix(x[: len(x) - n + 1] + np.uint64(n))
        for j in range(1, n):
            s = mix(s, x[j : len(x) - n + 1 + j])
        return np.unique(s)


def signatures(sets: list[np.ndarray], size: int, seed: int) -> np.ndarray:
    """MinHash signatures (sets by size, 32 bits) of sets that are not empty."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, size, dtype=np.uint64)
    every = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), size), np.uint32)
    for j in range(size):
        with np.errstate(over="ignore"):
            out[:, j] = np.minimum.reduceat(((every * a[j] + b[j]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def class_key(s: np.ndarray) -> bytes:
    """128 bits that stand for a set of shingles."""
    with np.errstate(over="ignore"):
        return np.array([splitmix(s).sum(), splitmix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum() + np.uint64(len(s))], np.uint64).tobytes()


def labels_of(signatures: list[bytes], trees: int) -> np.ndarray:
    """Classes by trees by values."""
    return np.frombuffer(b"".join(signatures), ">u2").reshape(len(signatures), trees, -1).astype(np.uint64)


def prefixes(labels: np.ndarray, depth: int) -> np.ndarray:
    """For each class and tree a hash of its label's first values; of a depth beyond the whole label none are equal."""
    if depth > labels.shape[2]:
        return np.arange(labels.shape[0] * labels.shape[1], dtype=np.uint64).reshape(labels.shape[:2])
    p = np.full(labels.shape[:2], np.uint64(depth))
    for d in range(depth):
        p = mix(p, labels[:, :, d])
    return p


def new_pairs(own: np.ndarray, longer: np.ndarray, tree: int) -> np.ndarray:
    """Which pairs of classes share a prefix first in that tree, and no longer one in any, of hashes of both depths."""
    first = np.full((len(own), len(own)), own.shape[1], np.int16)
    new = np.ones(first.shape, bool)
    for t in range(own.shape[1] - 1, -1, -1):
        first[own[:, t][:, None] == own[:, t][None, :]] = t
        new &= longer[:, t][:, None] != longer[:, t][None, :]
    return (first == tree) & new


def common(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of intersections of all sets with all others, by one product of indicator matrices over shared shingles."""
    every, n = np.unique(np.concatenate([*sets, *others]), return_counts=True)
    shared = every[n > 1]
    if not len(shared):
        return np.zeros((len(sets), len(others)))
    out = np.zeros((len(sets), len(others)), np.float32)
    for i in range(0, len(shared), 4096):
        part = shared[i : i + 4096]

        def table(some: list[np.ndarray]) -> np.ndarray:
            x = np.zeros((len(some), len(part)), np.float32)
            for r, s in enumerate(some):
                at = np.searchsorted(part, s)
                ok = at < len(part)
                ok[ok] = part[at[ok]] == s[ok]
                x[r, at[ok]] = 1
            return x

        out += table(sets) @ table(others).T
    return out


def _whole_groups(batches, keys: list[str]):
    """Of a stream of record batches sorted by keys: tables of whole groups, and where groups begin, with the end."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b]).combine_chunks()
        if not t.num_rows:
            continue
        new = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            c = t.column(k).chunk(0)
            new |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(new) + 1
        if len(cuts):
            yield t.slice(0, cuts[-1]), np.append(0, cuts)
            t = t.slice(cuts[-1])
        held = t
    if held is not None:
        yield held, np.array([0, held.num_rows])


def _numbered(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers that stand for a column's values; -1 for null."""
    return pc.dictionary_encode(pa.array(column.to_pylist(), pa.binary())).indices.fill_null(-1).to_numpy()


def apart(roots: np.ndarray) -> np.ndarray:
    """Which pairs are not of one cluster, by numbers of clusters (-1: of none)."""
    return (roots[:, None] != roots[None, :]) | (roots[:, None] < 0)


class Forest:
    """Parameters of one join and its steps."""

    def __init__(self, *, threshold: float = 0.8, words: int = 5, trees: int = TREES, depth: int = DEPTH, recall: float = 0.9999, surely: float = 0.999, cell: int = CELL, seed: int = 17) -> None:
        self.threshold, self.words, self.trees, self.depth, self.recall, self.cell, self.seed = threshold, words, trees, depth, recall, cell, seed
        self.least = prefix_depth(threshold, trees, depth, surely)

    def sign(self, docs: DataFrame, text: str, key: list) -> DataFrame:
        """r1, r2, cls, sig for each row: class and labels of its trees, two bytes a value. Both null without a word."""
        small_batches(docs.sparkSession)
        words, size, seed = self.words, self.trees * self.depth, self.seed

        def run(batches):
            shingle = Shingler(words)
            for b in batches:
                sets = [shingle(t) for t in b.column(2).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                cls, sig = [None] * len(sets), [None] * len(sets)
                if full:
                    m = signatures([sets[i] for i in full], size, seed).astype(">u2")  # low bits: minima are small
                    for k, i in enumerate(full):
                        cls[i], sig[i] = class_key(sets[i]), m[k].tobytes()
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cls, pa.binary()), pa.array(sig, pa.binary())], names=["r1", "r2", "cls", "sig"])

        return docs.select(*key, F.col(text).cast("binary").alias("text")).mapInArrow(run, _SIGNED)

    def tries(self, classes: DataFrame) -> DataFrame:
        """tree, label, cls of classes(cls, sig) that share a prefix of the least depth with another, sorted by label."""
        width = 2 * self.depth
        labels = classes.select("cls", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(self.trees - 1)), lambda t: F.substring(F.col("sig"), t * width + 1, F.lit(width)))).alias("tree", "label"))
        keyed = labels.withColumn("prefix", F.xxhash64("tree", F.substring("label", 1, 2 * self.least)))
        return self._often(keyed).select("tree", "label", "cls").sortWithinPartitions("tree", "label")

    @staticmethod
    def _often(keyed: DataFrame) -> DataFrame:
        """Rows of keyed whose tree and prefix several have, with their number n; a hot prefix's rows stay where they are."""
        often = stash(keyed.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "nd-often")
        return join_often(keyed, often, ["tree", "prefix"], "n").where("n is not null")

    def clusters(self, tries: DataFrame) -> tuple[DataFrame | None, DataFrame]:
        """cls, root of the classes under prefixes with more than a cell's members, joined where such prefixes share a
        class (None without such prefixes); and the tries under the others."""
        keyed = tries.withColumn("prefix", F.substring("label", 1, 2 * self.least))
        many = keyed.groupBy(*_MET).agg(F.count(F.lit(1)).alias("n"), F.min("cls").alias("head")).where(F.col("n") > self.cell)
        many = stash(many, "nd-many")
        if many.isEmpty():
            return None, tries
        met = join_often(keyed, many, _MET, "n")
        roots = groups_of(met.where("head is not null").select(F.col("cls").alias("a"), F.col("head").alias("b")))
        few = met.where("head is null").select("tree", "label", "cls").sortWithinPartitions("tree", "label")
        return stash(roots.select(F.col("node").alias("cls"), "root"), "nd-clusters"), stash(few, "nd-tries")

    def sets(self, texts: DataFrame, roots: DataFrame) -> DataFrame:
        """root, cls, size, shingles of the members of clusters(cls, root)."""
        words = self.words

        def run(batches):
            shingle = Shingler(words)
            for b in batches:
                made = [shingle(t).tobytes() for t in b.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(made, pa.binary())], names=["root", "cls", "size", "shingles"])

        met = texts.join(F.broadcast(roots) if roots.count() <= SENT else roots, "cls")
        return met.select("root", "cls", "size", "text").mapInArrow(run, _SETS)

    def grid(self, sets: DataFrame) -> DataFrame:
        """root, x, y, side, cls, size, shingles: the members of each cell, a pair of blocks of a cluster.

        A member travels to as many cells as the cluster has blocks: of about self.cell members, but no more than the root
        of twice the tasks, unless a block's shingles went beyond HELD bytes. side tells the blocks apart.
        """
        tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        blocks = F.greatest(F.least(F.ceil(F.col("n") / self.cell), F.lit(math.ceil(math.sqrt(2 * tasks)))), F.ceil(F.col("bytes") / HELD)).cast("int")
        sums = stash(sets.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("shingles")).alias("bytes")), "nd-sums")
        dealt = join_often(sets, sums, ["root"], "n").withColumn("own", F.pmod(F.xxhash64("cls", F.lit(3)), blocks).cast("int"))
        dealt = dealt.select("root", "cls", "size", "shingles", "own", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        return dealt.select("root", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"), "cls", "size", "shingles")

    def within(self, cells: DataFrame) -> DataFrame:
        """a, b, n, alike, as of `links`, for all pairs of cells(root, x, y, side, cls, size, shingles); alike is null."""
        threshold, cell = self.threshold, self.cell

        def verify(batches):
            for table, cuts in _whole_groups(batches, _CELL):
                for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
                    yield pairs(table.slice(a, b - a))

        def pairs(rows):
            cls, side, weight = rows.column("cls").to_pylist(), rows.column("side").to_numpy(), rows.column("size").to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in rows.column("shingles").to_pylist()]
            sizes, count = np.array([len(s) for s in sets]), len(sets)
            alone = rows.column("x")[0].as_py() == rows.column("y")[0].as_py()
            first = count if alone else int((side == 0).sum())
            gain, group, edges = np.zeros(count, np.int64), np.arange(count), []
            for i in range(0, first, cell):
                u = slice(i, min(i + cell, first))
                for j in range(i if alone else first, count, cell):
                    v = slice(j, min(j + cell, count))
                    both = common(sets[u], sets[v])
                    near = both >= threshold * (sizes[u, None] + sizes[None, v] - both) - 1e-6
                    if alone and i == j:
                        np.fill_diagonal(near, False)
                    else:
                        gain[v] += near.T.astype(np.int64) @ weight[u]
                    gain[u] += near.astype(np.int64) @ weight[v]
                    for r in np.flatnonzero(near.any(axis=1)) + i:
                        met = group[v][near[r - i]]
                        for o in np.unique(met[met != group[r]]).tolist():
                            edges.append((cls[o], cls[r], 0))
                            group[group == o] = group[r]
            out = [(cls[i], None, int(gain[i])) for i in np.flatnonzero(gain)] + edges
            cols = [pa.array(c, k) for c, k in zip(zip(*out) if out else ([], [], []), (pa.binary(), pa.binary(), pa.int64()))]
            return pa.RecordBatch.from_arrays([*cols, pa.nulls(len(out), pa.int32())], names=["a", "b", "n", "alike"])

        n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return cells.repartition(n, *_CELL).sortWithinPartitions(*_CELL, "side").mapInArrow(verify, _LINKS)

    def needed(self, tries: DataFrame, classes: DataFrame, depth: int) -> DataFrame:
        """tree, prefix, cls, root: the classes(cls, sig, root) whose texts each prefix needs to verify the new pairs at that
        depth, but for those of equal roots. The tries have no prefix with more than a cell's members."""
        trees = self.trees
        keyed = tries.select("tree", "cls", F.substring("label", 1, 2 * depth).alias("prefix"))
        met = self._often(keyed).select(*_MET, "cls").join(classes.select("cls", "sig", "root"), "cls")

        def pick(batches):
            for table, cuts in _whole_groups(batches, _MET):
                labels = labels_of(table.column("sig").to_pylist(), trees)
                p, q = prefixes(labels, depth), prefixes(labels, depth + 1)
                tree, root = table.column("tree").to_numpy(), _numbered(table.column("root"))
                use, size = np.zeros(len(p), bool), np.diff(cuts)
                at = cuts[:-1][size == 2]  # most groups: all at once
                same = p[at] == p[at + 1]
                pair = same.any(axis=1) & (same.argmax(axis=1) == tree[at]) & (q[at] != q[at + 1]).all(axis=1) & ((root[at] < 0) | (root[at] != root[at + 1]))
                use[at] = use[at + 1] = pair
                for a, n in zip(cuts[:-1][size > 2].tolist(), size[size > 2].tolist()):
                    mine = new_pairs(p[a : a + n], q[a : a + n], tree[a]) & apart(root[a : a + n])
                    np.fill_diagonal(mine, False)
                    use[a : a + n] = mine.any(axis=1)
                yield from table.filter(pa.array(use)).select([*_MET, "cls", "root"]).to_batches()

        n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return met.select(*_MET, "cls", "root", "sig").repartition(n, *_MET).sortWithinPartitions(*_MET).mapInArrow(pick, _NEED)

    def links(self, cells: DataFrame, depth: int) -> DataFrame:
        """a, b, n, alike of cells(tree, prefix, cls, root, size, sig, text): n more linked rows for class a; edges a - b, n 0; and, without a and b, n pairs of a similarity in thousandths."""
        threshold, words, trees = self.threshold, self.words, self.trees

        def verify(batches):
            shingle = Shingler(words)
            for table, cuts in _whole_groups(batches, _MET):
                labels = labels_of(table.column("sig").to_pylist(), trees)
                p, q, root = prefixes(labels, depth), prefixes(labels, depth + 1), _numbered(table.column("root"))
                for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
                    rows = table.slice(a, b - a).to_pylist()
                    sets = [shingle(r["text"]) for r in rows]
                    sizes, weight = np.array([len(s) for s in sets]), np.array([r["size"] for r in rows], np.int64)
                    both = common(sets, sets)
                    union = sizes[:, None] + sizes[None, :] - both
                    near = (both >= threshold * union - 1e-6) & new_pairs(p[a:b], q[a:b], rows[0]["tree"]) & apart(root[a:b])
                    np.fill_diagonal(near, False)
                    yield from self_rows(rows, near, weight)
                    i, j = np.nonzero(np.triu(near))
                    alike, n = np.unique((both[i, j] * BINS // union[i, j]).astype(np.int32), return_counts=True)
                    if len(n):
                        yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.binary()), pa.nulls(len(n), pa.binary()), pa.array(n, pa.int64()), pa.array(alike, pa.int32())], names=["a", "b", "n", "alike"])

        def self_rows(rows, near, weight):
            gain = near.astype(np.int64) @ weight
            out = [(rows[i]["cls"], None, int(gain[i])) for i in np.flatnonzero(gain)]
            seen = np.zeros(len(rows), bool)
            for i in range(len(rows)):
                todo = [i]
                while todo:
                    k = todo.pop()
                    seen[k] = True
                    new = np.flatnonzero(near[k] & ~seen)
                    seen[new] = True
                    out += [(rows[j]["cls"], rows[k]["cls"], 0) for j in new]
                    todo += new.tolist()
            if out:
                cols = [pa.array(c, k) for c, k in zip(zip(*out), (pa.binary(), pa.binary(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*cols, pa.nulls(len(out), pa.int32())], names=["a", "b", "n", "alike"])

        n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return cells.select(*_MET, "cls", "root", "size", "sig", "text").repartition(n, *_MET).sortWithinPartitions(*_MET).mapInArrow(verify, _LINKS)

    def join(self, classes: DataFrame, texts: DataFrame, tries: DataFrame) -> DataFrame:
        """Links (a, b, n) of classes(cls, sig): prefixes are shortened until the target recall."""
        every, found = None, {}
        roots, tries = self.clusters(tries)
        if roots is None:
            classes = classes.withColumn("root", F.lit(None).cast("binary"))
        else:
            every = stash(self.within(self.grid(stash(self.sets(texts, roots), "nd-sets"))), "nd-links")
            classes = stash(join_sized(classes, roots, ["cls"]), "nd-rooted")
        for depth in range(self.depth, self.least - 1, -1):
            need = stash(self.needed(tries, classes, depth), "nd-need")
            # few texts are needed at a depth: what names them goes to the texts, if it is small, and not all texts by shuffle
            met = texts.join(F.broadcast(need), "cls") if need.count() <= SENT else need.join(texts, "cls")
            part = stash(self.links(met, depth), "nd-links")
            every = part if every is None else every.unionByName(part)
            for r in part.where("alike is not null").groupBy("alike").agg(F.sum("n").alias("n")).collect():  # at most BINS rows
                s = max(r["alike"] / BINS, self.threshold)
                found[s] = found.get(s, 0) + r["n"]
            if missed(found, self.threshold, self.trees, depth) <= (1 - self.recall) * sum(found.values()):
                break
        return every.where("alike is null").select("a", "b", "n")


def groups_of(edges: DataFrame) -> DataFrame:
    """node, root (its group's least node) for all nodes of edges(a, b): star contraction, both ways by turns."""
    now = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "nd-stars")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stash(large, "nd-stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        small = stash(small, "nd-stars")
        if small.join(small.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() and small.groupBy("u").count().where("count > 1").isEmpty():
            return small.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(small.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        now = small


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", forest: Forest | None = None) -> DataFrame:
    """doc_id, class_id, n_links, first for each row of docs.

    Rows are linked whose shingle sets have a Jaccard similarity of the threshold at least; equal sets are. class_id is
    the least id of all rows joined by links (null if all are null); n_links is the number of other rows a row is
    linked with; first marks one row of each group, the least by id (nulls last), to keep. Shingles are of `words`
    words; a shorter text is one shingle. Null texts and those without a word are linked to nothing and are first.
    Repeated rows are linked rows. Texts are read whole. Other columns are ignored. An empty table gives an empty result.

    Of the links between different texts a share of 1 - recall is missed by estimate, or, at the least depth, a pair at the
    threshold with a probability of 1 - surely; every pair found is verified.
    """
    return _resolve(_signed(docs, doc_id, text, forest or Forest()), docs, doc_id, text, forest or Forest()).select("doc_id", "class_id", "n_links", "first")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))


def _signed(docs: DataFrame, doc_id: str, text: str, forest: Forest) -> DataFrame:
    d = spread(_keyed(docs, doc_id, text))
    return stash(forest.sign(d, "text", [F.col("doc_id").alias("r1"), F.xxhash64("text").alias("r2")]), "nd-signed")


def _resolve(signed: DataFrame, docs: DataFrame, doc_id: str, text: str, forest: Forest) -> DataFrame:
    """doc_id, class_id, n_links, first, r2 (hash of the text)."""
    order = F.struct(F.col("r1").isNull().alias("null"), F.col("r1").alias("id"), F.col("r2").alias("hash"))
    classes = signed.where("cls is not null").groupBy("cls").agg(F.count(F.lit(1)).alias("size"), F.min(order).alias("least"), F.min("sig").alias("sig"))
    classes = stash(classes, "nd-classes")
    tries = stash(forest.tries(classes.select("cls", "sig")), "nd-tries")
    wanted = tries.select("cls").distinct().join(classes, "cls").select("cls", "size", "sig", F.col("least.id").alias("i"), F.col("least.hash").alias("h"))
    texts = _keyed(docs, doc_id, text).withColumn("h", F.xxhash64("text")).join(wanted, F.col("doc_id").eqNullSafe(F.col("i")) & (F.xxhash64("text") == wanted["h"])).select("cls", "size", "sig", F.col("text").cast("binary").alias("text"))
    texts = stash(texts.groupBy("cls").agg(F.first("size").alias("size"), F.first("sig").alias("sig"), F.first("text").alias("text")), "nd-texts")
    links = forest.join(classes.select("cls", "sig"), texts, tries)
    counts = links.groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("more"))
    roots = groups_of(links.where("b is not null").select("a", "b")).select(F.col("node").alias("cls"), "root")
    known = classes.join(counts, "cls", "left").join(roots, "cls", "left").select("cls", "size", "least", F.coalesce("more", F.lit(0)).alias("more"), F.coalesce("root", "cls").alias("root"))
    known = stash(known, "nd-known")
    heads = known.groupBy("root").agg(F.min("least").alias("head"))
    known = stash(known.join(heads, "root").select("cls", "size", "more", "head"), "nd-known")
    rows = signed.select("r1", "r2", "cls")
    joined = join_often(rows.where("cls is not null"), known, ["cls"], "size")
    joined = joined.unionByName(rows.where("cls is null"), allowMissingColumns=True)  # texts without a word meet nothing
    return joined.select(
        F.col("r1").alias("doc_id"),
        F.when(F.col("cls").isNull(), F.col("r1")).otherwise(F.col("head.id")).alias("class_id"),
        F.coalesce(F.col("more") + F.col("size") - 1, F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("cls").isNull(), True).otherwise(F.col("r1").eqNullSafe(F.col("head.id")) & (F.col("r2") == F.col("head.hash"))).alias("first"),
        "r2",
    )


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", forest: Forest | None = None) -> DataFrame:
    """docs with one row of each group of near duplicates, the least by id; columns as they were.

    Of rows with equal id and text one stays. Rows without a word all stay.
    """
    f = forest or Forest()
    found = _resolve(_signed(docs, doc_id, text, f), docs, doc_id, text, f)
    gone = found.where("not first").select(F.col("doc_id").alias("_i"), F.col("r2").alias("_h"))
    twice = found.where("first").join(found.where("n_links > 0").select("doc_id", "r2", "n_links"), ["doc_id", "r2"], "left_semi")
    same = twice.groupBy("doc_id", "r2").count().where("count > 1").select(F.col("doc_id").alias("_i"), F.col("r2").alias("_h"))
    on = F.col(doc_id).cast("bigint").eqNullSafe(F.col("_i")) & (F.xxhash64(F.col(text)) == F.col("_h"))
    single = docs.join(gone.unionByName(same), on, "left_anti")
    if same.isEmpty():
        return single
    return single.unionByName(docs.join(same, on, "left_semi").dropDuplicates([doc_id, text]))
