import re

import corpus_pipeline as c


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(10**6, "12 34", "en", "src0", 5), (10**6 + 1, None, None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in c.STAGES:
        before = docs
        docs = c.stash(stage(spark, docs, sf), name)
        sizes.append(docs.count())
        if name == "mixing":
            break
        assert docs.columns == columns
        gone = before.join(docs.select("doc_id"), "doc_id", "left_anti")
        if name == "language_id":
            assert {r["doc_id"] for r in gone.collect()} == {10**6, 10**6 + 1}
        if name == "near_duplicates":
            assert docs.count() < before.count() and docs.select("text").distinct().count() == docs.count()
        if name == "decontamination":
            items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert not [r for r in docs.collect() if any(i in r["text"] for i in items)]
        if name == "pii":
            assert docs.count() == before.count()
            assert not [r for r in docs.collect() if re.search(r"@mail\d\.example\.com|\+1 \(\d{3}\) 555-", r["text"])]
    assert sizes == sorted(sizes, reverse=True)
    assert {"doc_id", "target", "taken"} <= set(docs.columns)
