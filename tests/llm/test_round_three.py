"""Site templates, threshold search and centroid clustering against plain versions, and their edge cases."""

import collections
import hashlib
import html
import math
import random
import re

import numpy as np
import pytest

from millrace.llm import centroids, site_templates, threshold_search
from millrace.llm.site_templates import Page

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k):
    """Every document scored for every item."""
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total = len(held), sum(x for _, _, x in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i].update(terms(t))
    out = []
    for item, ts in asked.items():
        scored = []
        for i, c, length in held:
            m = 50 + (50 * length * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def corpus(r, n):
    word = lambda: f"W{int(r.paretovariate(0.8)) % 300}" if r.random() < 0.9 else r.choice(["Éa", "x-y", "ça.va", "\x00z", "日本"])
    return [(i, " ".join(word() for _ in range(r.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("most", [1, 40, 10**6])
def test_threshold_search_is_the_full_ranking(spark, most):
    r = random.Random(most)
    docs = corpus(r, 400) + [(1000, None), (1001, ""), (1002, "..."), (None, "w1 w2"), (5, "w1 w1 w9"), (5, "w1 w1 w9"), (1003, "w3 " * 50_000)]
    items = [(i, t[: r.randint(0, 200)]) for i, t in corpus(r, 12)] + [(50, None), (51, "nowhere"), (0, "w7 w7"), (None, "w3")]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, id string, n int")
    got = threshold_search.rank_documents(d, spark.createDataFrame(items, "item_id bigint, text string"), 10, most=most)
    want = ranked(docs, items, 10)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_threshold_search_stops_before_the_ends(spark):
    """Documents are looked up only as far as the lists must be read; ties at the k-th score are all met."""
    n, width = 20_000, 3
    r = np.random.default_rng(5)
    impact = np.sort(r.integers(1, 10**6, (n, width)), axis=0)[::-1].reshape(-1)
    p = threshold_search.Portion(np.arange(0, n * width + 1, width), np.tile(np.arange(width), n), impact, width)
    found, scores = p.search(np.arange(width), 10, np.empty(0, np.int64))
    assert p.looked_up < n / 20
    whole = impact.reshape(n, width).sum(1)
    assert sorted(scores)[-10:] == sorted(whole)[-10:]
    flat = threshold_search.Portion(np.arange(501), np.zeros(500, int), np.full(500, 7), 1)
    assert len(flat.search(np.array([0]), 10, np.empty(0, np.int64))[0]) == 500
    assert not len(flat.search(np.array([0]), 2, np.array([8, 9]))[0])


def test_threshold_search_of_nothing(spark):
    d, b = "doc_id string, text string", "item_id int, text string"
    rows, item = spark.createDataFrame([("a", "x y"), ("b", "x")], d), spark.createDataFrame([(1, "X")], b)
    assert threshold_search.rank_documents(rows.limit(0), item).collect() == []
    assert threshold_search.rank_documents(rows, item.limit(0)).collect() == []
    got = threshold_search.rank_documents(rows, item)
    assert [(r["rank"], r["doc_id"]) for r in got.collect()] == [(1, "b"), (2, "a")] and dict(got.dtypes)["doc_id"] == "string"


def lloyd(rows, k, rounds, scale=64):
    """Clusters by Python integers, every centroid compared."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in first[:k]]
    far = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w))
    near = lambda v: min((far(v, w), j) for j, w in enumerate(c))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        c = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if groups[j] else w for j, w in enumerate(c)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], c


@pytest.mark.parametrize("spread", [0.02, 1.0, 1e5])
def test_clusters_are_those_of_exact_integers(spark, spread):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, spread) for _ in range(64)]) for i in range(150)]
    rows += [(200, None), (201, []), (202, [1.0] * 63), (203, [None] * 64), (204, [float("nan")] * 64), (205, [float("inf")] * 64), (None, [0.5] * 64), (3, rows[3][1]), (206, [0.0] * 64)]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id bigint, embedding array<double>, cluster int")
    got, about = centroids.cluster(df, k=6)
    want, c = lloyd(rows, 6, 3)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    inertia = collections.Counter()
    for _, j, d in want:
        inertia[j] += d
    assert {r["cluster"]: (r["inertia"], r["centroid"]) for r in about.collect()} == {j: (inertia[j], w) for j, w in enumerate(c)}
    digest = {r["vec_id"]: r for r in centroids.with_digests(got, about).collect()}[7]
    assert digest["centroid_sha256"] == hashlib.sha256(",".join(map(str, c[digest["cluster"]])).encode()).hexdigest() and digest["inertia"] == sum(inertia.values())


def test_screening_keeps_the_nearest_and_ties_go_to_the_lowest():
    r = np.random.default_rng(1)
    for size in (2, 1 << 12, 1 << 25):
        x, c = r.integers(-size, size, (300, 64)), r.integers(-size, size, (40, 64))
        c[20:] = c[:20]  # every centroid twice
        x[:20] = c[:20]
        c[5] = c[6] + (np.arange(64) == 0)
        best, far, again = centroids.nearest(x, c)
        exact = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)) for w in c] for v in x])
        assert (best == exact.argmin(1)).all() and (far == exact.min(1)).all() and again > 200
        alone = np.unique(c, axis=0)
        assert centroids.nearest(x, alone)[2] < 300 and centroids.screen(x, alone)[np.arange(300), centroids.nearest(x, alone)[0]].all()


def test_clusters_of_few_none_and_too_large(spark):
    kind = "vec_id bigint, embedding array<float>"
    assert centroids.with_digests(*centroids.cluster(spark.createDataFrame([], kind))).collect() == []
    two = spark.createDataFrame([(1, [1.0] * 64), (2, [2.0] * 64)], kind)
    got = centroids.with_digests(*centroids.cluster(two)).collect()
    assert sorted((r["vec_id"], r["distance"], r["inertia"]) for r in got) == [(1, 0, 0), (2, 0, 0)] and len({r["cluster"] for r in got}) == 2
    with pytest.raises(ArithmeticError):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64)], kind))


@pytest.mark.parametrize(
    "source, want",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a <b>b<br>c</b>\n d<p>e<hr>f", "a b c d\ne\nf"),
        ("<nav>menu</nav><header>top</header><article><header><h1>T</h1>by x</header><p>x&nbsp;&lt;y&#62; &eacute;</p><aside>s</aside></article><footer>f</footer>", "T\nx <y> é"),
        ("<main><p>keep<div class='side cookie-notice'>go</div><div class=comments><article class=comment>c</article></div>", "keep"),
        ("<form><h1>t</h1><p>page in a form</p></form>", "t\npage in a form"),
        ("<form><input value=x>ask<button>b</button></form><ul><li>one<li>two</ul>", "one\ntwo"),
        ("<script>a<p>b</p>'</script><style>x</style><!-- <p>no</p> --><p title='a>b'>yes</p><textarea>t</textarea>", "yes"),
        ("<p>a<script>never closed <p>b", "a"),
        ("<p>a<!-- never closed <p>b", "a"),
        ("<p>a &am", "a &am"),
        ("<p>1 < 2 <3 a<b", "1 < 2 <3 a"),
        ("<div class=ad>buy<article>held</article></div>", "held"),
        ("<article>a <span class='share-buttons'>like <i>it</i></span>b <p><a class=ad>x<p>c</article>", "a b\nc"),
        ("<table><tr><td>a<td>b<tr><td>c</table></div></p>d", "a\nb\nc\nd"),
        ("<ARTICLE><P CLASS=lead>Up</ARTICLE>", "Up"),
    ],
)
def test_text_of_pages(source, want):
    assert Page(source or "").text(frozenset()) == want


def page(host, n, article, extra=""):
    return n, f"http://{host}/p/{n}", f"<html><body><div class='nav'>home</div><div><article><h1>Title {n}</h1>{extra}<p>{article}</p></article></div></body></html>"


def test_templates_of_a_host_go_and_copies_stay(spark):
    r = random.Random(4)
    say = lambda: " ".join(f"w{r.randint(0, 999)}" for _ in range(30))
    box = "<section><h2>More</h2><ul><li>Read <b>this</b></li></ul></section>"
    common = "<p>A line that some pages share.</p>"
    rows = [page("A.example", n, say(), box + (common if n % 3 == 0 else "")) for n in range(40)]
    rows += [page("copies.example", 100 + n, "one and the same article in many places", "<p>with two paragraphs</p>") for n in range(0, 30)]
    rows = [(n, u, h.replace(f"Title {n}", "Title")) if n >= 100 else (n, u, h) for n, u, h in rows]
    rows += [page("few.example", 200 + n, say(), box) for n in range(4)]
    rows += [(300, None, box), (301, "no host", box), (302, "http://A.example/", None), (None, "http://a.example/", ""), rows[0]]
    df = spark.createDataFrame([(*x, "x") for x in rows], "page_id bigint, url string, html string, text string")
    got = site_templates.main_text(df)
    texts = collections.defaultdict(list)
    for x in got.collect():
        texts[x["page_id"]].append(x["text"])
        assert x["n_chars"] == len(x["text"])
    want = collections.defaultdict(list)
    for n, u, h in rows:
        lines = [" ".join(re.sub("<[^>]*>", "", x).split()) for x in re.split(r"</?(?:p|h1|h2|li|ul|section|article|div)[^>]*>", (h or "").replace("<div class='nav'>home</div>", ""))]
        lines = [html.unescape(x) for x in lines if x and not (u and u.startswith("http://A.") and x in ("More", "Read this"))]
        want[n].append("\n".join(lines))
    assert {k: sorted(v) for k, v in texts.items()} == {k: sorted(v) for k, v in want.items()}
    assert [x["host"] for x in site_templates.templates(df).collect()] == ["a.example"]
    assert site_templates.main_text(df.limit(0)).collect() == []


def test_templates_by_shuffle_are_the_same(spark, monkeypatch):
    from millrace.llm import common

    rows = [page(f"h{n % 3}.example", n, f"text number {n} of its own", "<p>everywhere</p>") for n in range(60)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    sent = sorted(map(tuple, site_templates.main_text(df).collect()))
    assert all("everywhere" not in r[2] for r in sent)
    monkeypatch.setattr(common, "SENT", 0)
    assert sorted(map(tuple, site_templates.main_text(df).collect())) == sent


def test_markup_without_end_is_read_in_one_go():
    for bad in ("<a '" * 20_000, "<" * 50_000, "<!--" * 20_000, '<p class="' * 20_000, "<div>" * 5_000 + "x"):
        Page(bad)
