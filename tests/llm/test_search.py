import collections
import math
import random
import zlib

import numpy as np
import pytest

from millrace.llm import backoff_lm, decontaminate, langid, near_dup, onebit_ann, toxicity
from millrace.llm.common import fold


def words(r, n, vocabulary=400):
    return " ".join(f"w{int(r.paretovariate(0.9)) % vocabulary}" for _ in range(n))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_is_the_automaton(spark, order):
    r = random.Random(order)
    texts = [words(r, r.randint(1, 40), 60) for _ in range(60)] + ["A a A b", "", None, "Été Été"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "a b", "x"), (3, texts[3], "x")]
    got = backoff_lm.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string, score string"), order=order, strength=3.0).collect()
    assert len(got) == len(rows)

    def tokens(t):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split() + ["</s>"]

    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts = collections.Counter()
    for i, t, _ in rows:
        if not held(i):
            seq = tokens(t)
            for j in range(len(seq)):
                for k in range(1, order + 1):
                    if j - k + 1 >= 0:
                        counts[tuple(seq[j - k + 1 : j + 1])] += 1
                    elif j - k + 1 == -1:
                        counts[("</s>", *seq[: j + 1])] += 1
    total, types = sum(v for k, v in counts.items() if len(k) == 1), sum(len(k) == 1 for k in counts)

    def arc(state, w):
        """Follow failure arcs from state until w is found, as an automaton does."""
        if not state:
            return math.log10((counts[(w,)] + 0.5) / (total + 0.5 * (types + 1)))
        c = counts[state]
        low = arc(state[1:], w)
        if counts[(*state, w)] == 0:
            return math.log10(3.0 / (c + 3.0)) + low
        return math.log10((counts[(*state, w)] + 3.0 * 10**low) / (c + 3.0))

    want = collections.Counter()
    for i, t, _ in rows:
        state, score = ("</s>",)[: order - 1], 0.0
        for w in tokens(t):
            while state and counts[state] == 0:
                state = state[1:]
            score += arc(state, w)
            state = (*state, w)[-(order - 1) :] if order > 1 else ()
        base = sum(math.log10((counts[(w,)] + 0.5) / (total + 0.5 * (types + 1))) for w in tokens(t))
        known = sum(counts[(w,)] > 0 for w in tokens(t))
        want[(i, held(i), len(tokens(t)), known, total, round(base, 6), round(score, 6))] += 1
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == want


def test_lm_empty(spark):
    assert backoff_lm.score_texts(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_packing():
    x = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64))
    assert (backoff_lm.unpack_sorted(backoff_lm.pack_sorted(x)) == x).all()


def test_ann_is_exact(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((700, 16))
    v[50:90] = v[3]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] + [1.0] * 15, 0), (1003, [None] + [1.0] * 15, 0), (1004, [1.0] * 5, 0), (None, [1.0] * 16, 0), (7, v[7].tolist(), 0)]
    rows += [(20, v[20].tolist(), 0), (20, v[21].tolist(), 0), (2000, [1e200] * 16, 0), (2001, [1e200] * 15 + [-1e200], 0), (2002, [1.7e308, -1.7e308] * 8, 0), (2020, [1e-200] * 16, 0), (2021, [2e-200] * 16, 0)]
    got = onebit_ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, row int"), every=20, k=10, cell=128, query_cell=9).collect()
    ok = [(i, np.array(x, float)) for i, x, _ in rows if i is not None and x is not None and len(x) == 16 and None not in x and np.isfinite(x).all() and any(x)]

    def distance(x, y):
        top = max(np.abs(x / 2 - y / 2).max(), 1e-300)
        with np.errstate(over="ignore"):
            return float(2 * (top * np.sqrt((((x / 2 - y / 2) / top) ** 2).sum())))

    want = collections.Counter()
    for a, (q, x) in enumerate(ok):
        if q % 20 == 0:
            d = sorted((float(f"{distance(x, y):.9g}"), i) for b, (i, y) in enumerate(ok) if a != b)[:10]
            want.update((q, n + 1, i, s) for n, (s, i) in enumerate(d))
    assert collections.Counter((r["query_id"], r["rank"], r["vec_id"], float(f"{r['score']:.9g}")) for r in got) == want
    assert sum(r["query_id"] == 20 for r in got) == 30 and sum(r["query_id"] == 2000 for r in got) == 10
    few = onebit_ann.nearest(spark.createDataFrame(rows[:3], "vec_id bigint, embedding array<double>, score int")).collect()
    assert [r["vec_id"] for r in few] and len(few) == 2
    assert onebit_ann.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_inner_products_of_packed_bits():
    rng = np.random.default_rng(4)
    for dims in (5, 64, 100):
        v, u = rng.standard_normal((50, dims)), rng.standard_normal(dims)
        u /= np.linalg.norm(u)
        got, off = onebit_ann.inner_products(u, onebit_ann.pack(v > 0))
        want = np.where(v > 0, 1, -1) @ u / np.sqrt(dims)
        assert (np.abs(got - want) <= off + 1e-12).all() and off < 0.2


def shingles(t, n=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def test_near_duplicates(spark):
    r = random.Random(5)
    texts = []
    for _ in range(25):
        base = words(r, r.randint(30, 200), 5000).split()
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 6)):
            x = base[:]
            for _ in range(r.randint(0, 4)):
                x[r.randrange(len(x))] = f"n{r.randrange(10**6)}"
            texts.append(" ".join(x))
    big = words(r, 400, 5000).split()
    for i in range(60):  # more than a cell
        x = big[:]
        x[i * 6] = f"m{i}"
        texts.append(" ".join(x))
    texts += ["", None, "   ", "one two", "ONE two", "one", texts[0].upper(), texts[0]]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[1], "x"), (4, texts[4], "x")]
    sets = [shingles(t) for _, t, _ in rows]
    near = lambda a, b: a and b and len(a & b) >= 0.8 * len(a | b)
    links = [sum(i != j and bool(near(a, b)) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if near(a, sets[j]):
                g, h = group[i], group[j]
                group = [h if x == g else x for x in group]
    ids = collections.defaultdict(list)
    for (i, _, _), g in zip(rows, group):
        ids[g].append(i)
    want = collections.Counter((i, min((x for x in ids[g] if x is not None), default=None), n) for (i, _, _), g, n in zip(rows, group, links))
    d = spark.createDataFrame(rows, "doc_id bigint, text string, first string")
    f = near_dup.Forest(cell=16)
    got = near_dup.near_duplicates(d, forest=f).collect()
    assert collections.Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == want
    kept = near_dup.keep_one(d, forest=f)
    assert kept.columns == d.columns and kept.count() == len(ids)
    assert near_dup.near_duplicates(d.limit(0)).count() == 0 and near_dup.keep_one(d.limit(0)).count() == 0


def test_prefix_depth():
    d = near_dup.prefix_depth(0.8, 20, 8, 0.999)
    assert 1 - (1 - 0.8**d) ** 20 >= 0.999 > 1 - (1 - 0.8 ** (d + 1)) ** 20


def test_forest_shortens_until_the_target(spark):
    # many pairs far above the threshold and none near it: whole labels find them all, and no prefix is shortened
    assert near_dup.missed({0.99: 10**6}, 0.8, 20, 8) < 1e-4 * 10**6
    # pairs at the threshold: the estimate falls with each value taken off
    lost = [near_dup.missed({0.8: 1000}, 0.8, 20, d) for d in (8, 7, 6, 5)]
    assert lost == sorted(lost, reverse=True) and 20 < lost[0] < 40 and lost[-1] < 1
    r, depths = random.Random(3), []
    real = near_dup.Forest.needed
    rows = [words(r, 60, 5000) for _ in range(20)]
    near_dup.Forest.needed = lambda self, tries, classes, depth: depths.append(depth) or real(self, tries, classes, depth)
    try:
        d = spark.createDataFrame([(i, t + f" x{i // 20}") for i, t in enumerate(rows * 2)], "doc_id bigint, text string")
        loose = near_dup.near_duplicates(d, forest=near_dup.Forest(recall=0.5)).where("n_links > 0").count()
        many = list(depths)
        depths.clear()
        near_dup.near_duplicates(d).count()
    finally:
        near_dup.Forest.needed = real
    assert loose == 40 and many == [8] and depths == [8, 7, 6, 5]


def test_new_pairs_by_hand():
    rng = np.random.default_rng(1)
    m = rng.integers(0, 2, (30, 4, 6)).astype(">u2")
    labels = near_dup.labels_of([x.tobytes() for x in m], 4)
    for depth in range(1, 7):
        for tree in range(4):
            got = near_dup.new_pairs(near_dup.prefixes(labels, depth), near_dup.prefixes(labels, depth + 1), tree)
            for i in range(30):
                for j in range(30):
                    same = [next((d for d in range(6) if m[i, t, d] != m[j, t, d]), 6) for t in range(4)]
                    assert i == j or got[i, j] == (max(same) == depth and same.index(depth) == tree)


def test_leaks(spark):
    r = random.Random(6)
    even = lambda r, n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    items = [(i, even(r, r.randint(15, 60))) for i in range(30)] + [(90, "too short"), (91, None), (None, even(r, 20))]
    docs, want = [], set()
    for i in range(200):
        t = even(r, r.randint(20, 300)).split()
        if i % 4 == 0:
            k, w = items[i % 30]
            w = w.split()
            if i % 8 == 0:  # a paraphrase keeps most words in order
                w = [x if j % 7 else "other" for j, x in enumerate(w)]
            at = r.randint(0, len(t))
            t[at:at] = [x.upper() + "," for x in w]
            want.add((i, k))
        docs.append((i, " ".join(t), "x"))
    docs += [(900, None, "x"), (901, "", "x"), (902, "..", "x"), (None, items[0][1], "x")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(d, b).collect()}
    assert got == want | {(None, 0)}
    assert got == {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(d, b, block=11).collect()}
    left = decontaminate.drop_leaks(d, b)
    assert left.columns == d.columns and left.count() == len(docs) - len({i for i, _ in got})
    assert decontaminate.find_leaks(d, b.limit(0)).count() == 0 and decontaminate.find_leaks(d.limit(0), b).count() == 0


def test_leaks_of_a_large_benchmark(spark):
    r = random.Random(8)
    even = lambda n: " ".join(f"w{r.randrange(20000)}" for _ in range(n))
    items = [(i, even(r.randint(15, 60))) for i in range(2500)]
    docs = []
    for i in range(120):
        t = even(150).split()
        t[i : i + 1] = items[i * 20][1].split()
        docs.append((i, " ".join(t)))
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == {(i, i * 20) for i in range(120)}
    assert all(x["lcs"] == 1 for x in got)


def test_leaks_of_short_items(spark):
    r = random.Random(9)
    common, rare = [f"c{i}" for i in range(30)], lambda: f"r{r.randrange(10**6)}"
    items = [(i, " ".join(r.sample(common, 4) + [f"k{i}"] * (i % 5 + 1))) for i in range(20)] + [(20, "c1 k99"), (21, "k98"), (22, "c2 c3 k97 c4"), (23, "--")]
    docs = []
    for i, t in items:
        around = [rare() for _ in range(60)]
        around[30:30] = t.split()
        docs.append((i, " ".join(around)))
    docs += [(100, "k99 c1"), (101, "c2 c3 x k97 c4"), (102, "k98x")] + [(200 + i, " ".join(common)) for i in range(300)]
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == {(i, i) for i in range(23)}


def test_lcs():
    r = random.Random(7)
    for _ in range(50):
        a, b = [[r.choice("abcd").encode() for _ in range(r.randint(1, 20))] for _ in range(2)]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        p = {}
        for j, w in enumerate(a):
            p[w] = p.get(w, 0) | 1 << j
        assert decontaminate.lcs(p, len(a), b) == t[-1][-1]


def test_segmentations_are_summed():
    index = langid._index(langid.VOCABULARY)
    n = len(index.names)
    number = {p: i for i, p in enumerate(index.names)}
    probs = np.random.default_rng(1).random((n + 1, 2)) / n

    def ways(s):
        if not s:
            return np.ones(2)
        out, single = np.zeros(2), False
        for k in range(1, len(s) + 1):
            if s[:k] in number:
                out += probs[number[s[:k]]] * ways(s[k:])
                single |= k == 1
        return out if single else out + probs[n] * ways(s[1:])

    some = ["hello", "fenêtre", "a", "日本", "x́z"]
    assert np.allclose(langid.log_probs(some, index, probs), np.log([ways(langid.START + w) for w in some]))


def test_long_words_are_not_cut():
    index = langid._index(langid.VOCABULARY)
    n, number = len(index.names), {p: i for i, p in enumerate(index.names)}
    probs = np.random.default_rng(1).random((n + 1, 2)) / n
    some = ["abcdefgh" * 3, "straßenbahn" * 30, "日本語" * 400, "x" * 33, "a"]
    for w, got in zip(some, langid.log_probs(some, index, probs)):
        s = langid.START + w
        a = [np.zeros(2)] + [None] * len(s)
        for j in range(1, len(s) + 1):
            ways = [a[i] + np.log(probs[number[s[i:j]]]) for i in range(max(0, j - index.longest), j) if s[i:j] in number]
            a[j] = np.logaddexp.reduce(ways + ([] if s[j - 1] in number else [a[j - 1] + np.log(probs[n])]))
        assert np.allclose(got, a[-1])
    both = {"in" * 20: 2, "the": 3}
    p = langid.fit_one(both, index, 2, 0.05)
    assert abs(p[:-1].sum() + langid.UNKNOWN - 1) < 1e-9 and (p > 0).all()


def test_parts_of_long_texts_keep_sums():
    index = langid._index(langid.VOCABULARY)
    probs = np.random.default_rng(1).random((len(index.names) + 1, 2)) / len(index.names)
    texts = ["the cat " * 60_000, "a", " b c "]
    got = langid.Scorer(probs, langid.VOCABULARY).texts(texts)
    the, cat, a, b, c = langid.log_probs(["the", "cat", "a", "b", "c"], index, probs)
    assert np.allclose(got, [60_000 * (the + cat), a, b + c])


def test_toxic_search_is_exact():
    rng = np.random.default_rng(2)
    terms, n = 40, 300
    vecs = []
    for _ in range(n):
        t = np.unique(rng.integers(0, terms, rng.integers(1, 8)))
        v = rng.random(len(t))
        vecs.append((t, v / np.linalg.norm(v)))
    term, who, w = np.concatenate([t for t, _ in vecs]), np.repeat(np.arange(n), [len(t) for t, _ in vecs]), np.concatenate([v for _, v in vecs])
    by = np.lexsort((who, term))
    blocks = -(-n // toxicity.BLOCK)
    peak = np.zeros((terms, blocks))
    np.maximum.at(peak, (term, who // toxicity.BLOCK), w)
    into = np.searchsorted(term[by] * blocks + who[by] // toxicity.BLOCK, np.arange(terms)[:, None] * blocks + np.arange(blocks + 1))
    ix = toxicity.Index({}, np.ones(terms), into, who[by], w[by], peak, np.arange(n), np.zeros(n))
    dense = np.zeros((n, terms))
    dense[who, term] = w
    for i in range(0, n, 17):
        found, best = ix.search(*vecs[i], 10, skip=i)
        s = dense @ dense[i]
        s[i] = 0
        want = sorted(((-x, j) for j, x in enumerate(s) if x > 0))[:10]
        assert np.allclose(best, [-x for x, _ in want])


def test_fold(spark):
    got = {r["doc_id"]: r["f"] for r in spark.range(50).select("id").withColumnRenamed("id", "doc_id").withColumn("f", fold()).collect()}
    assert all(v == zlib.crc32(str(k).encode()) % 5 for k, v in got.items())


def test_very_long_texts_are_read_whole(spark):
    """300,000 words, what tells at their end: a leak, a near copy, words to count and to score."""
    from millrace.llm import mixing

    r = random.Random(11)
    long = " ".join(f"w{r.randrange(5000)}" for _ in range(300_000))
    item = " ".join(f"k{i}" for i in range(30))
    rows = [(1, f"{long} {item}", "a"), (2, long, "a"), (3, "short text of six words here", "b"), (4, None, "b")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    b = spark.createDataFrame([(7, item), (8, item)], "item_id bigint, text string")
    assert {(x["doc_id"], x["item_id"], x["lcs"]) for x in decontaminate.find_leaks(d, b).collect()} == {(1, 7, 1.0), (1, 8, 1.0)}
    near = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in near_dup.near_duplicates(d).collect()}
    assert near == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0)}
    lm = {x["doc_id"]: x for x in backoff_lm.score_texts(d, train=d["doc_id"] != 1).collect()}
    assert lm[1]["n_tokens"] == 300_031 and lm[1]["n_known"] == 300_001 and lm[4]["n_tokens"] == 1
    words = long.split()
    pairs, single = collections.Counter(zip(["</s>", *words], [*words, "</s>"])), collections.Counter([*words, "</s>"])
    for w in ["short text of six words here".split(), []]:
        pairs.update(zip(["</s>", *w], [*w, "</s>"]))
        single.update([*w, "</s>"])
    n, v = sum(single.values()), len(single)
    p = lambda a, w: (pairs[(a, w)] + 100 * (single[w] + 0.5) / (n + 0.5 * (v + 1))) / (single[a] + 100)
    assert lm[2]["score"] == pytest.approx(sum(math.log10(p(a, w)) for a, w in zip(["</s>", *words], [*words, "</s>"])), abs=1e-4)
    assert {x["doc_id"]: x["size"] for x in mixing.pareto_mix(d).collect()} == {1: 300_030, 2: 300_000, 3: 6, 4: 0}


def test_corpus_axes_by_hand(spark):
    """The leading axis of the corpus's passages is that of a dense decomposition."""
    r = np.random.default_rng(2)
    many = 40
    texts = [r.choice(many + 1, r.integers(1, 200), p=np.append(np.arange(many, 0, -1) ** 2.0, 500) / (sum(i * i for i in range(1, many + 1)) + 500)).astype(np.uint32) for _ in range(60)]
    idf = r.random(many) + 0.5
    rows = []
    for t in texts:
        for i in range(0, len(t), decontaminate.PASSAGE):
            n = np.bincount(t[i : i + decontaminate.PASSAGE], minlength=many + 1)[:many]
            a = np.log1p(n) * idf
            if a.any():
                rows.append(a / np.linalg.norm(a))
    want = np.linalg.svd(np.array(rows))[2][0]
    d = spark.createDataFrame([(i, bytearray(t.tobytes())) for i, t in enumerate(texts)], "doc_id bigint, words binary").repartition(5)
    got = decontaminate.corpus_axes(d, np.arange(many + 1), idf, 4, 3)
    assert got.shape == (many, 4) and abs(got[:, 0] @ want) > 0.99


def test_near_copies_travel_in_proportion(spark):
    """Rows sent to be verified grow no faster than a group of near copies, and each pair counts once."""
    r, sent, links = random.Random(8), {}, {}
    base = words(r, 300, 5000).split()
    needed, grid = near_dup.Forest.needed, near_dup.Forest.grid

    def counted(f, *args):
        made = f(*args)
        sent[m] = sent.get(m, 0) + made.count()
        return made

    near_dup.Forest.needed = lambda *args: counted(needed, *args)
    near_dup.Forest.grid = lambda *args: counted(grid, *args)
    try:
        for m in (100, 200):
            texts = [" ".join([*base[: i % 290], f"n{i}", *base[i % 290 + 1 :]]) for i in range(m)] + [words(r, 40, 5000), " ".join(base[:280])]
            d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
            got = near_dup.near_duplicates(d, forest=near_dup.Forest(cell=4)).collect()
            sets = [shingles(t) for t in texts]
            links[m] = {x["doc_id"]: x["n_links"] for x in got}
            assert links[m] == {i: sum(i != j and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)}
            assert {x["class_id"] for x in got} == {0, m}
    finally:
        near_dup.Forest.needed, near_dup.Forest.grid = needed, grid
    assert sent[200] <= 2.5 * sent[100]


def test_toxic_search_together_is_exact_and_reads_long_lists_by_blocks():
    """Lists that most examples have, as common words do, are read once a block for all texts, and not one by one for each."""
    rng = np.random.default_rng(4)
    terms, n = 300, 1000
    vecs = []
    for _ in range(n):
        t = np.unique(np.concatenate([np.flatnonzero(rng.random(40) < 0.7), rng.integers(40, terms, rng.integers(1, 8))]))
        v = rng.random(len(t))
        vecs.append((t, v / np.linalg.norm(v)))
    term, who, w = np.concatenate([t for t, _ in vecs]), np.repeat(np.arange(n), [len(t) for t, _ in vecs]), np.concatenate([v for _, v in vecs])
    by = np.lexsort((who, term))
    blocks = -(-n // toxicity.BLOCK)
    peak = np.zeros((terms, blocks))
    np.maximum.at(peak, (term, who // toxicity.BLOCK), w)
    into = np.searchsorted(term[by] * blocks + who[by] // toxicity.BLOCK, np.arange(terms)[:, None] * blocks + np.arange(blocks + 1))
    ix = toxicity.Index({}, np.ones(terms), into, who[by], w[by], peak, np.arange(n), np.zeros(n))
    dense = np.zeros((n, terms))
    dense[who, term] = w
    got = ix.search_all([*vecs, (np.empty(0, np.int64), np.empty(0))], 10, np.append(np.arange(n), -1))
    assert 30 < (ix.long[0] >= 0).sum() < 60 and len(got[n][0]) == 0
    for i in range(0, n, 7):
        s = dense @ dense[i]
        s[i] = 0
        want = sorted((-x.round(12), j) for j, x in enumerate(s) if x > 0)[:10]
        assert got[i][0].tolist() == [j for _, j in want] and np.allclose(got[i][1], [-x for x, _ in want])
