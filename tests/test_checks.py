from millrace.operators import checks


def test_locked_texts(spark):
    long = " ".join(f"w{i}" for i in range(20))
    items = [(1, long), (2, "a b c"), (3, "b"), (4, None), (5, "x y z q")]
    docs = [(1, f"pre{long}post"), (2, "za b cd"), (3, long[:-3]), (4, None), (5, ""), (6, f"x y z {long} x y z q"), (6, "x  y z q")]
    got = checks.locked_texts(spark.createDataFrame(docs, "d int, text string"), spark.createDataFrame(items, "i int, text string"), "d", "text", "i").collect()
    assert {tuple(r) for r in got} == {(d, i) for d, t in docs for i, x in items if t and x and x in t}
    lone = checks.locked_texts(spark.createDataFrame([(None, "of b c"), (1, "b c"), (1, "b c")], "d int, text string"), spark.createDataFrame([(7, "b c"), (None, "of"), (8, ""), (9, "b c")], "i int, text string"), "d", "text", "i").collect()
    assert sorted(map(tuple, lone), key=repr) == sorted([(None, 7), (None, 9), (None, None), (1, 7), (1, 9), (1, 7), (1, 9)], key=repr)
