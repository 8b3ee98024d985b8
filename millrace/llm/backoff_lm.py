"""Score texts with an n-gram language model run as a weighted backoff automaton.

States are n-grams of up to order - 1 tokens seen in training, from the empty one up. Where h w was seen, state h has an
arc for token w with weight log p(w | h), to the longest suffix of h w that is a state; every state but the empty one
has a failure arc to its suffix, and the empty state an arc for every token. Smoothing is hierarchical Dirichlet:
p(w | h) = (c(h w) + k p(w | h')) / (c(h) + k), h' the suffix of h, p(w) the base unigram (c + 0.5) / (N + 0.5 (V + 1));
so a failure arc weighs log(k / (c(h) + k)), and all probabilities sum to 1. A text is read once, left to right, from
the state of the end token; the state carries over from token to token and the weights of the arcs taken add up.

The model is as large as the corpus, so no worker ever holds it. Texts are read once, in chunks of bounded size. A
chunk's distinct n-grams go, as sorted keys cut into shards by their high bits, to where the shard is summed;
the sums come back in the order asked for. Of them the part of the automaton is built that the chunk's texts can reach,
and all its texts are read through it side by side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, give_back, mix, small_batches, splitmix, stash

CHUNK_CHARS = 4_500_000
CHUNK_TYPES = 400_000
KEY_BITS = 56  # two of them are flags: of N distinct n-grams, a lookup meets another's key once in 2 ** 54 / N times
LANE = 512
_CHUNKS = "chunk string, shard int, doc_id array<bigint>, train array<boolean>, length array<int>, body binary, counts binary, tokens bigint"
_ANSWERS = "chunk string, shard int, body binary, types bigint"
_SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers to bytes: planes of equal significance together, then zstd."""
    v = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(level=1).compress(v.view(np.uint8).reshape(len(v), v.itemsize).T.tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


class Chunk:
    """Token numbers of some texts, one end token (number 0) after each."""

    def __init__(self) -> None:
        self.types: dict[bytes, int] = {b"": 0}
        self.docs: list[np.ndarray] = []
        self.ids: list[int | None] = []
        self.train: list[bool] = []
        self.chars = 0

    def add(self, doc_id: int | None, text: bytes | None, train: bool) -> None:
        text = text or b""
        types = self.types
        words = text.lower().split()  # bytes: A-Z only; split at \x20 and \x09-\x0D only
        n = [types.setdefault(w, len(types)) for w in words]
        n.append(0)
        self.docs.append(np.array(n, np.uint32))
        self.ids.append(doc_id)
        self.train.append(train)
        self.chars += len(text)

    def full(self) -> bool:
        return self.chars >= CHUNK_CHARS or len(self.types) >= CHUNK_TYPES


def _short(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - KEY_BITS) & ~np.uint64(3)


def unigram_keys(hashes: np.ndarray) -> np.ndarray:
    return _short(hashes) | np.uint64(1)


def ngram_keys(tokens: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For k = 1..order: the key of the k-gram that ends at each token, and whether there is one.

    The end token before a text belongs to its first k-grams; nothing before that does. Keys of unigrams are odd; the
    second bit of a key is 0, for `distinct`; keys have KEY_BITS bits.
    """
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = np.arange(len(tokens)) - starts
    own = hashes[tokens]
    end = hashes[0]
    out = [(unigram_keys(hashes)[tokens], np.ones(len(tokens), bool))]
    rolled = own
    for k in range(2, order + 1):
        before = np.empty_like(rolled)
        before[1:] = rolled[:-1]
        if k == 2:
            before[place == 0] = end
        rolled = mix(before, own)
        out.append((_short(rolled), place >= k - 2))
    return out


def distinct(keys: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs where learn. The flag rides in the second bit: one sort, in place."""
    flagged = keys | learn.astype(np.uint64) << np.uint64(1)
    flagged.sort()
    first = np.empty(len(flagged), bool)
    first[:1] = True
    np.not_equal(flagged[1:] & ~np.uint64(2), flagged[:-1] & ~np.uint64(2), out=first[1:])
    at = np.flatnonzero(first)
    counts = np.add.reduceat(flagged >> np.uint64(1) & np.uint64(1), at).astype(np.uint32)
    return flagged[at] & ~np.uint64(2), counts


class Table:
    """Places of keys in a sorted array of distinct keys that are spread evenly over `bits` bits."""

    def __init__(self, keys: np.ndarray, bits: int = 64) -> None:
        top = max(1, len(keys).bit_length())
        self.keys, self.shift = keys, np.uint64(bits - top)
        self.first = np.append(np.searchsorted(keys, np.arange(1 << top, dtype=np.uint64) << self.shift), len(keys)).astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where there is none."""
        out = np.full(len(wanted), -1, np.int32)
        if not len(self.keys):
            return out
        bucket = (wanted >> self.shift).astype(np.int64)
        at, end, live = self.first[bucket], self.first[bucket + 1], None
        while len(at):
            have = self.keys[np.minimum(at, len(self.keys) - 1)]
            want = wanted if live is None else wanted[live]
            hit = (have == want) & (at < end)
            spots = np.flatnonzero(hit)
            out[spots if live is None else live[spots]] = at[spots]
            on = np.flatnonzero((have < want) & (at + 1 < end))
            live = on if live is None else live[on]
            at, end = at[on] + 1, end[on]
        return out


class Automaton:
    """The part of the model that some texts can reach.

    grams[k - 1][t] is the number of the k-gram that ends at token t, or -1; n-gram g occurs counts[g] times. A state's
    number is its n-gram's, the empty state is -1.
    """

    def __init__(self, tokens: np.ndarray, types: int, grams: list[np.ndarray], counts: np.ndarray, end: int, total: int, vocabulary: int, strength: float) -> None:
        order, self.types = len(grams), types
        seen = counts > 0
        suffix = np.full(len(counts), -1, np.int32)
        p = np.empty(len(counts))
        p[grams[0]] = (counts[grams[0]] + 0.5) / (total + 0.5 * (vocabulary + 1))
        self.base = np.empty(types)
        self.base[tokens] = np.log10(p[grams[0]])
        keys, arcs = [], []
        for k in range(1, order):
            at = np.flatnonzero(grams[k] >= 0)
            g, context = grams[k][at], grams[k - 1][at - 1]  # before a text is an end token: of the text before, or the last
            suffix[g] = grams[k - 1][at]
            p[g] = (counts[g] + strength * p[suffix[g]]) / (counts[context] + strength)
            place = np.full(len(counts), -1, np.int32)
            place[g] = np.arange(len(g))  # any of its places will do
            g = np.flatnonzero((place >= 0) & seen).astype(np.int32)
            keys.append(splitmix(context[place[g]].astype(np.uint64) * np.uint64(types) + tokens[at[place[g]]]))
            arcs.append(g)
            del at, context, place
        key, gram = (np.concatenate(keys), np.concatenate(arcs)) if keys else (np.empty(0, np.uint64), np.empty(0, np.int32))
        by = np.argsort(key)
        self.arcs, gram = Table(key[by]), gram[by]
        longest = np.zeros(len(counts), bool)
        if order > 1:
            longest[grams[order - 1][grams[order - 1] >= 0]] = True
        self.weight, self.into = np.log10(p[gram]), np.where(longest[gram], suffix[gram], gram)
        self.fail, self.back = suffix, np.log10(strength / (counts + strength))
        self.single = np.full(types, -1, np.int32)
        if order > 1:
            self.single[tokens] = np.where(seen[grams[0]], grams[0], -1)
        self.start = end if order > 1 and seen[end] else -1
        self.reach = order - 1

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a token from some states, and the weights of the arcs taken."""
        state, gain, after = state.copy(), np.zeros(len(state)), np.empty(len(state), np.int32)
        live = np.flatnonzero(state >= 0)
        while len(live):
            arc = self.arcs.find(splitmix(state[live].astype(np.uint64) * np.uint64(self.types) + token[live]))
            hit = arc >= 0
            some, arc = live[hit], arc[hit]
            gain[some] += self.weight[arc]
            after[some] = self.into[arc]
            state[some] = -2  # done
            live = live[~hit]
            gain[live] += self.back[state[live]]
            state[live] = self.fail[state[live]]
            live = live[state[live] >= 0]
        empty = np.flatnonzero(state == -1)
        gain[empty] += self.base[token[empty]]
        after[empty] = self.single[token[empty]]
        return after, gain

    def read(self, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 probabilities of texts. Stretches of LANE tokens are read side by side: a state remembers `reach` tokens,
        so a later stretch of a text begins so many tokens earlier, at the empty state, without counting them."""
        many = -(-lengths // LANE)
        text = np.repeat(np.arange(len(lengths)), many)
        piece = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        warm = np.where(piece > 0, self.reach, 0)
        begin = (np.cumsum(lengths) - lengths)[text] + piece * LANE - warm
        size = np.minimum(lengths[text] - piece * LANE, LANE) + warm
        by = np.argsort(-size, kind="stable")
        text, warm, begin, size = text[by], warm[by], begin[by], size[by]
        state, score = np.where(warm > 0, -1, self.start).astype(np.int32), np.zeros(len(text))
        if self.reach == 0:
            state[:] = -1
        live = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")  # of size above t
        for t, n in enumerate(live.tolist()):
            state[:n], gain = self.step(state[:n], tokens[begin[:n] + t])
            score[:n] += np.where(warm[:n] <= t, gain, 0)
        return np.bincount(text, weights=score, minlength=len(lengths))


def _model_shards(spark) -> int:
    return 1 << max(3, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def score_texts(docs: DataFrame, *, order: int = 2, strength: float = 100.0, doc_id: str = "doc_id", text: str = "text", train=None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of docs.

    train: a boolean column, the rows to learn from (null: not); by default those whose crc32(id) mod 5 is not 1.
    Scores are log10. Null and empty texts have one token, the end. Repeated rows count and score alike. doc_id may be
    null. Other columns are ignored. An empty table gives an empty result; with no training row N and V are 0.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shards = _model_shards(spark)
    bits = np.uint64(KEY_BITS - (shards.bit_length() - 1))
    train = fold(doc_id) != 1 if train is None else F.coalesce(train, F.lit(False))
    read = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"), train.alias("train"))
    schema = T._parse_datatype_string(_CHUNKS)

    def rows(chunk: Chunk, name: str) -> pa.RecordBatch:
        tokens = np.concatenate(chunk.docs)
        lengths = np.array([len(x) for x in chunk.docs], np.int64)
        hashes = splitmix(np.fromiter((xxhash.xxh3_64_intdigest(w) for w in chunk.types), np.uint64, len(chunk.types)))
        learn = np.repeat(np.array(chunk.train), lengths)
        keys, counts = [], []
        for key, valid in ngram_keys(tokens, lengths, hashes, order):
            u, c = distinct(key[valid], learn[valid])
            keys.append(u)
            counts.append(c)
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        by = np.argsort(keys)
        keys, counts = keys[by], counts[by]
        cuts = np.searchsorted(keys, np.arange(shards, dtype=np.uint64) << bits).tolist() + [len(keys)]
        out = [[name, -1, chunk.ids, chunk.train, lengths.tolist(), pack(tokens), pack(hashes), int(learn.sum())]]
        for s in range(shards):
            a, b = cuts[s], cuts[s + 1]
            if a < b:
                out.append([name, s, None, None, None, pack_sorted(keys[a:b]), pack(counts[a:b]), None])
        kinds = [pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=schema.names)

    def chunks(batches):
        from pyspark import TaskContext

        at, n, chunk = TaskContext.get().partitionId(), 0, Chunk()
        for b in batches:
            for i, t, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                chunk.add(i, t, bool(f))
                if chunk.full():
                    yield rows(chunk, f"{at}.{n}")
                    n, chunk = n + 1, Chunk()
                    give_back()
        if chunk.docs:
            yield rows(chunk, f"{at}.{n}")
        del chunk
        give_back()

    made = stash(read.mapInArrow(chunks, schema), "lm-chunks")

    def summed(table: pa.Table) -> pa.Table:
        give_back()
        ask = [unpack_sorted(x.as_py()) for x in table.column("body")]
        have = [unpack(x.as_py(), np.uint32) for x in table.column("counts")]
        keys, inv = np.unique(np.concatenate(ask), return_inverse=True)
        sums = np.bincount(inv, weights=np.concatenate(have), minlength=len(keys)).astype(np.uint64)
        types = int(((sums > 0) & (keys & np.uint64(1) == 1)).sum())
        parts = np.split(sums[inv], np.cumsum([len(x) for x in ask])[:-1])
        n = table.num_rows
        return pa.table([table.column("chunk"), table.column("shard"), pa.array([pack(x) for x in parts], pa.binary()), pa.array([types] + [0] * (n - 1), pa.int64())], names=["chunk", "shard", "body", "types"])

    asks = made.where("shard >= 0").select("chunk", "shard", "body", "counts")
    answers = stash(asks.groupBy("shard").applyInArrow(summed, _ANSWERS), "lm-counts")
    total = made.where("shard < 0").agg(F.sum("tokens")).first()[0] or 0
    types = answers.agg(F.sum("types")).first()[0] or 0

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        row = left.to_pylist()[0]
        lengths = np.array(row["length"], np.int64)
        tokens, hashes = unpack(row["body"], np.uint32), unpack(row["counts"], np.uint64)
        keyed = ngram_keys(tokens, lengths, hashes, order)
        every = np.concatenate([key[valid] for key, valid in keyed])
        every.sort()
        table = Table(every[np.append(True, every[1:] != every[:-1])], KEY_BITS)
        del every
        grams = []
        while keyed:
            key, valid = keyed.pop(0)
            grams.append(table.find(key))
            grams[-1][~valid] = -1
        values, n = np.empty(len(table.keys)), 0
        for _, x in sorted(zip(right.column("shard").to_pylist(), right.column("body").to_pylist())):
            part = unpack(x, np.uint64)
            values[n : n + len(part)] = part
            n += len(part)
        del key, valid, part
        first = np.cumsum(lengths) - lengths
        end = int(table.find(unigram_keys(hashes[:1]))[0])
        automaton = Automaton(tokens, len(hashes), grams, values, end, total, types, strength)
        known = (values[grams[0]] > 0).astype(np.int64)
        del grams, table
        logs, base = automaton.read(tokens, lengths), automaton.base[tokens]
        n = len(lengths)
        return pa.table(
            [pa.array(row["doc_id"], pa.int64()), pa.array([not x for x in row["train"]], pa.bool_()), pa.array(lengths), pa.array(np.add.reduceat(known, first)), pa.array(np.full(n, total, np.int64)), pa.array(np.add.reduceat(base, first)), pa.array(logs)],
            names=[x.split()[0] for x in _SCORES.split(", ")],
        )

    texts = made.where("shard < 0").select("chunk", "doc_id", "train", "length", "body", "counts")
    return texts.groupBy("chunk").cogroup(answers.select("chunk", "shard", "body").groupBy("chunk")).applyInArrow(scored, _SCORES)
