import pytest
from pyspark.sql import functions as F

from millrace.llm import langid, quality, queries, toxicity
from millrace.llm.common import fold

SF = "/root/testdata/sf0.01"
ODD = [(10**6, None, None, "s", 0), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "123 !!", None, None, 0), (10**6 + 2, "123 !!", None, None, 0), (None, "the and of", "en", "s", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    return d.unionByName(spark.createDataFrame(ODD, d.schema)).withColumn("score", F.lit("x")).cache()


def test_language(spark, docs):
    model = langid.fit(docs.where(fold() != 0).select("text", "lang"))
    got = langid.identify(docs, model).withColumn("h", fold() == 0)
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (10**6, 10**6 + 1, 10**6 + 2)} == {"und"}
    both = got.join(docs.select("doc_id", "lang").where("lang is not null"), "doc_id").where("h and lang_pred <> 'und'")
    assert both.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    kept = langid.identify(docs, model, keep=True)
    assert set(kept.columns) == {*docs.columns, "lang_pred"}
    assert {r["lang_pred"] for r in langid.identify(docs, ([], model[1], model[2])).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0
    assert langid.fit(docs.limit(0).select("text", "lang"))[0] == []


def accuracy(scored, labels, label, at):
    both = scored.join(labels, "doc_id").where(fold() == 0)
    r = both.agg(*[F.avg(F.when(F.col(label) == y, ((F.col("score") >= at).cast("int") == y).cast("double"))).alias(f"r{y}") for y in (0, 1)]).first()
    return r["r0"], r["r1"]


def test_toxicity(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    lab = queries.labelled(docs, labels, "toxic")
    index = toxicity.fit(lab)
    scored = toxicity.score_toxicity(docs, index)
    assert scored.count() == docs.count() and scored.where("score is null or score < 0 or score > 1").isEmpty()
    clean, toxic = accuracy(scored, labels, "toxic", 0.5)
    assert clean > 0.95 and toxic > 0.5
    assert toxicity.fit(lab.where("y = 0")) is None
    assert {r["score"] for r in toxicity.score_toxicity(docs, None).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), index).count() == 0


def test_toxic_neighbours_by_all_words(spark):
    texts = [(i, f"a{i} b{i} c{i} c{i} c{i} shared", i % 2) for i in range(40)]
    index = toxicity.fit(spark.createDataFrame(texts, "doc_id bigint, text string, y int"))
    assert {"a7", "b7", "c7", "shared"} <= set(index.number)
    asked = [(100 + i, f"c{i} c{i} b{i} other") for i in (7, 8)] + [(200, "c3 c3 c3 c5"), (201, "c3 c5 c5 c5")]
    got = {r["doc_id"]: r["evidence"] for r in toxicity.score_toxicity(spark.createDataFrame(asked, "doc_id bigint, text string"), index).collect()}
    assert got[107][0]["doc_id"] == 7 and got[108][0]["doc_id"] == 8
    assert [e["doc_id"] for e in got[200][:2]] == [3, 5] and [e["doc_id"] for e in got[201][:2]] == [5, 3]


def test_quality(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    lab = queries.labelled(docs, labels, "quality")
    model = quality.fit(docs, lab)
    scored = quality.score_quality(docs, model)
    assert scored.count() == docs.count() and scored.where("score is null or score < 0 or score > 1").isEmpty()
    bad, good = accuracy(scored, labels, "quality", 0.3)
    assert bad > 0.8 and good > 0.95
    none = quality.fit(docs.limit(0), lab.where("y = 1"))
    assert {r["score"] for r in quality.score_quality(docs, none).collect()} == {1.0}
    assert quality.score_quality(docs.limit(0), model).count() == 0


def test_random_indexing_by_hand(spark):
    import numpy as np

    texts = ["a b c a", "b b", None, "A!! b"]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    vectors, counts = quality.context_vectors(d)
    at, sign = quality.index_vectors(7)
    want, n, stream = np.zeros((quality.ROWS, quality.DIMS)), np.zeros(quality.ROWS), quality.Stream()
    for t in texts:
        r = stream.rows(t.encode() if t else None)
        for i, x in enumerate(r):
            n[x] += 1
            for j in range(max(0, i - quality.REACH), min(len(r), i + quality.REACH + 1)):
                if i != j:
                    for h in range(quality.HOTS):
                        want[x, at[r[j], h]] += sign[r[j], h]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.allclose(vectors, want, atol=1e-5) and np.allclose(counts, n)


def test_temperature():
    import numpy as np

    rng = np.random.default_rng(0)
    z = rng.normal(0, 2, 5000)
    y = (rng.random(5000) < 1 / (1 + np.exp(-z))).astype(float)
    assert quality.temperature_of(3 * z, y) == pytest.approx(3, rel=0.15)


@pytest.mark.parametrize("rate", [0.1, 0.5])
def test_quality_is_calibrated(spark, rate):
    """Texts of a and b whose share of a tells the label, but not surely; labels as rare as `rate`."""
    import numpy as np

    rng = np.random.default_rng(5)
    rows = []
    for i in range(6000):
        y = int(rng.random() < rate)
        rows.append((i, " ".join(rng.choice(["alpha", "beta"], 12, p=[0.45 + 0.2 * y, 0.55 - 0.2 * y])), y))
    d = spark.createDataFrame(rows, "doc_id bigint, text string, y int")
    model = quality.fit(d, d.where("doc_id < 4500"), sample=6000)
    got = quality.score_quality(d.where("doc_id >= 4500"), model).join(d.select("doc_id", "y"), "doc_id").collect()
    s, y = np.array([r["score"] for r in got]), np.array([r["y"] for r in got])
    assert abs(s.mean() - y.mean()) < 0.03
    high = s > np.median(s)
    assert abs(s[high].mean() - y[high].mean()) < 0.05 and abs(s[~high].mean() - y[~high].mean()) < 0.05


def test_network_by_hand(spark):
    import numpy as np

    model = quality.Model(np.eye(4), np.full(4, 0.5), np.zeros(4 + quality.MARKS + 2), np.ones(4 + quality.MARKS + 2), None, 2.0, 0.3, -1.0)
    assert model.scores(quality.Stream(), [b"a", None]).tolist() == [0.3, 0.3]
    rng = np.random.default_rng(0)
    w1, b1, w2, b2 = rng.standard_normal((len(model.centre), 3)), rng.standard_normal(3), rng.standard_normal(3), 0.7
    model.layers = (w1, b1, w2, b2)
    x = rng.standard_normal((5, len(model.centre)))
    want = [1 / (1 + np.exp(-((sum(w2[j] * np.tanh(sum(v[i] * w1[i, j] for i in range(len(v))) + b1[j]) for j in range(3)) + b2) / 2.0 - 1.0))) for v in x]
    assert np.allclose(model.calibrated(model.logits(x)), want)


def test_very_long_texts(spark, docs):
    """Texts of a million characters are read whole: what tells comes last."""
    filler = "der die das und " * 60_000
    d = spark.createDataFrame([(1, "short", "en", 0), (2, filler, "de", 0), (3, "the and of with this " * 50_000, "en", 1), (4, "ab" * 50_000, None, 0)], "doc_id bigint, text string, lang string, y int")
    model = langid.fit(docs.where("lang in ('en', 'de')").select("text", "lang"))
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(d, model).where("doc_id in (2, 3)").collect()} == {2: "de", 3: "en"}
    q = quality.fit(d, d.unionByName(d.withColumn("doc_id", F.col("doc_id") + 10)))
    assert quality.score_quality(d, q).where("score between 0 and 1").count() == 4
    index = toxicity.fit(d.select("doc_id", "text", "y"))
    assert toxicity.score_toxicity(d, index).where("score between 0 and 1").count() == 4
