"""Queries of joins, selections, reports and checks over records, and DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, labels
from ..operators import annotations, checks, dedup, evaluation, findings, images, inference, json_schema, masks, registry, sampling
from ..sources import files, sinks
from .catalog import BOX_SQL, CODE_SQL, RADIUS, boxes, coded, docs_split, query, t

# --- joins --------------------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_custkey % 5 <> 0) WHERE rn = 1), c AS (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)
SELECT c_custkey AS key, o_orderkey, CASE WHEN o_custkey IS NULL THEN 'left_only' ELSE 'paired' END AS state FROM c LEFT JOIN o ON c_custkey = o_custkey
UNION ALL SELECT o_custkey, o_orderkey, 'right_only' FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM c)""")
def left_pairing_with_orphans(spark, d):
    left = t(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("key"))
    right = t(spark, d, "orders").where("o_custkey % 5 <> 0").select(F.col("o_custkey").alias("key"), "o_orderkey", "o_orderdate")
    paired, orphans = registry.pair_left(left, right, "key", ["o_orderdate", "o_orderkey"])
    return paired.select("key", "o_orderkey", "state").unionByName(orphans.select("key", "o_orderkey", F.lit("right_only").alias("state")))


@query("SELECT l.doc_id, quality, toxic, n_chars, source FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def one_to_one_enrichment(spark, d):
    rows = t(spark, d, "labels")
    extra = t(spark, d, "documents").join(rows.select("doc_id"), "doc_id", "left_semi").select("doc_id", "n_chars", "source")
    return registry.enrich_one_to_one(rows, extra, "doc_id")


@query("""SELECT o_orderkey, o_custkey, c_mktsegment FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS o_custkey FROM orders) o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""")
def optional_lookup(spark, d):
    rows = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("o_custkey"))
    return registry.lookup_all(rows, t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")


@query("""WITH e AS (SELECT doc_id, n_chars, source FROM documents WHERE doc_id % 11 <> 0), a AS (SELECT doc_id, n_chars + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS n_chars, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE source END AS source FROM documents WHERE doc_id % 7 <> 0)
SELECT coalesce(e.doc_id, a.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'missing' WHEN e.doc_id IS NULL THEN 'unexpected' WHEN e.n_chars IS DISTINCT FROM a.n_chars OR e.source IS DISTINCT FROM a.source THEN 'different' ELSE 'match' END AS state,
CASE WHEN a.doc_id IS NULL OR e.doc_id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN e.n_chars IS DISTINCT FROM a.n_chars THEN 'n_chars' END, CASE WHEN e.source IS DISTINCT FROM a.source THEN 'source' END) END AS differ FROM e FULL OUTER JOIN a ON e.doc_id = a.doc_id""")
def expected_against_actual(spark, d):
    x = t(spark, d, "documents").select("doc_id", "n_chars", "source")
    actual = x.where("doc_id % 7 <> 0").select("doc_id", (F.col("n_chars") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("n_chars"), F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("source"))
    return registry.compare_expected(x.where("doc_id % 11 <> 0"), actual, "doc_id", ["n_chars", "source"]).withColumn("differ", F.array_join("differ", ","))


@query("""WITH i AS (SELECT CAST(doc_id AS VARCHAR) || '.png' AS image FROM documents), m AS (SELECT CAST(doc_id AS VARCHAR) || '_lab.png' AS mask FROM documents WHERE doc_id % 3 <> 0)
SELECT image, mask FROM i LEFT JOIN m ON image = replace(mask, '_lab.png', '.png')""")
def mask_image_pairing(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("s"))
    masks = x.where("doc_id % 3 <> 0").select(F.concat("s", F.lit("_lab.png")).alias("mask")).withColumn("image", labels.paired_name(F.col("mask")))
    return x.select(F.concat("s", F.lit(".png")).alias("image")).join(masks, "image", "left").select("image", "mask")


@query("""SELECT doc_id, state FROM (SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unknown' ELSE 'known' END AS state FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) WHERE state = 'unknown'""")
def unknown_decisions(spark, d):
    found = checks.missing_keys(t(spark, d, "documents").select("doc_id"), t(spark, d, "labels"), "doc_id", "unknown")
    return found.select(F.col("key").cast("bigint").alias("doc_id"), F.col("rule").alias("state"))


# --- reports ------------------------------------------------------------------------------------------------------


@query("SELECT l_linenumber, count(*) AS n FROM lineitem GROUP BY 1")
def int_histogram(spark, d):
    return registry.histogram(t(spark, d, "lineitem"), "l_linenumber")


@query("""SELECT c_mktsegment, array_to_string(list_sort(list(DISTINCT CAST(c_nationkey AS VARCHAR))), ',') AS nations FROM customer GROUP BY 1""")
def distinct_value_sets(spark, d):
    rows = t(spark, d, "customer").select("c_mktsegment", F.col("c_nationkey").cast("string").alias("nations"))
    return registry.distinct_sets(rows, "c_mktsegment", ["nations"]).withColumn("nations", F.array_join("nations", ","))


@query("""SELECT source, arg_min(lang, doc_id) FILTER (WHERE lang IS NOT NULL) AS lang FROM documents GROUP BY 1""")
def first_value_per_key(spark, d):
    return registry.first_values(t(spark, d, "documents"), "source", "lang", ["doc_id"])


@query("SELECT user_id, event_id FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 20")
def first_examples(spark, d):
    return registry.first_examples(t(spark, d, "events").where("event_type = 'error'").select("user_id", "event_id"), "event_id", 20)


@query("""SELECT source, bool_and(n_chars > 100) AS all_long, bool_or(n_chars > 100) AS any_long, bool_and(lang = 'en') AS all_english, bool_or(lang = 'en') AS any_english FROM documents GROUP BY 1""")
def all_and_any(spark, d):
    rows = t(spark, d, "documents").select("source", (F.col("n_chars") > 100).alias("long"), (F.col("lang") == "en").alias("english"))
    return registry.flags(rows, ["source"], ["long", "english"])


@query("""SELECT source, count(*) AS files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY 1""")
def bytes_by_source(spark, d):
    return registry.totals(t(spark, d, "documents").select("source", F.octet_length("text").cast("bigint").alias("size")), "source", "size")


@query("""WITH p AS (SELECT CASE WHEN p_size % 3 = 0 THEN 'pending' ELSE 'approved' END AS state, string_split(p_type, ' ') AS routes FROM part), r AS (SELECT unnest(routes) AS r FROM p)
SELECT (SELECT count(*) FROM p) AS total, (SELECT count(*) FROM p WHERE state <> 'pending') AS reviewed, (SELECT count(DISTINCT r) FROM r) AS routes""")
def review_overview(spark, d):
    rows = t(spark, d, "part").select(F.when(F.col("p_size") % 3 == 0, "pending").otherwise("approved").alias("state"), F.split("p_type", " ").alias("routes"))
    return registry.review_totals(rows, "state", "routes")


ALIASES = {"asia": ["INDIA", "CHINA"], "all": ["INDIA", "PERU", "CHINA", "KENYA"]}


@query("""WITH n AS (SELECT n_nationkey AS o, CASE n_nationkey % 4 WHEN 0 THEN 'PERU' WHEN 1 THEN 'asia' WHEN 2 THEN 'all' ELSE 'KENYA' END AS name FROM nation WHERE n_nationkey > 2),
x AS (SELECT o, unnest(l) AS name, generate_subscripts(l, 1) - 1 AS p FROM (SELECT o, CASE name WHEN 'asia' THEN ['INDIA', 'CHINA'] WHEN 'all' THEN ['INDIA', 'PERU', 'CHINA', 'KENYA'] ELSE [name] END AS l FROM n))
SELECT name, CAST(place AS INTEGER) AS place, CAST(p AS INTEGER) AS member FROM (SELECT name, o AS place, p, row_number() OVER (PARTITION BY name ORDER BY o, p) AS rn FROM x) WHERE rn = 1""")
def alias_expansion(spark, d):
    m = F.col("n_nationkey") % 4
    names = t(spark, d, "nation").where("n_nationkey > 2").select(F.when(m == 0, "PERU").when(m == 1, "asia").when(m == 2, "all").otherwise("KENYA").alias("name"), F.col("n_nationkey").alias("o"))
    return registry.expand_aliases(names, "name", "o", ALIASES, ["INDIA", "PERU", "CHINA", "KENYA"])


@query("""WITH r AS (SELECT event_type, count(*) AS images, CASE WHEN sum(value) > 0 THEN count(*) / sum(value) END AS per_second, avg(value) AS mean_seconds, avg(CASE WHEN event_id % 3 = 0 THEN value / 100 END) AS mean_iou FROM events GROUP BY 1)
SELECT event_type, images, round(per_second, 9) AS per_second, round(mean_seconds, 9) AS mean_seconds, round(mean_iou, 9) AS mean_iou FROM r""")
def model_throughput(spark, d):
    rows = t(spark, d, "events").select("event_type", "value", F.when(F.col("event_id") % 3 == 0, F.col("value") / 100).alias("iou"))
    return findings.throughput(rows, "event_type", "value", "iou").withColumns({c: F.round(c, 9) for c in ("per_second", "mean_seconds", "mean_iou")})


@query("""WITH s AS (SELECT d.split, d.source, count(*) AS n FROM (SELECT source, CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'val' ELSE 'train' END AS split FROM documents) d GROUP BY ALL),
o AS (SELECT split, sum(n)::BIGINT AS n FROM s GROUP BY 1) SELECT '{"by_split":[' || string_agg('{"split":"' || split || '","n":' || n || '}', ',' ORDER BY split) || '],"total":{"rows":' || (SELECT count(*) FROM documents) || '}}' AS report FROM o""")
def json_report(spark, d):
    rows = docs_split(spark, d)
    return sinks.json_report(by_split=rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")), one_total=rows.agg(F.count(F.lit(1)).alias("rows")))


# --- selection ----------------------------------------------------------------------------------------------------


@query("SELECT doc_id, n_chars, CAST(place AS INTEGER) AS place FROM documents JOIN (SELECT unnest([77, 3, 150, 12]) AS id, unnest([0, 1, 2, 3]) AS place) ON doc_id = id WHERE place < 3")
def explicit_ids(spark, d):
    return sampling.by_ids(t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", [77, 3, 150, 12, 3], limit=3)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def head_after_filter(spark, d):
    return sampling.head(t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), [F.desc("o_totalprice"), F.col("o_orderkey")], 25, F.col("o_orderstatus") == "F").drop("o_orderstatus")


@query("""SELECT c_custkey, CAST(rn AS BIGINT) - 1 AS ordinal FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_name, c_custkey) AS rn, count(*) OVER () AS n FROM customer) WHERE rn IN (1, n // 2 + 1, n)""")
def probe_reads(spark, d):
    return sampling.probe(t(spark, d, "customer").select("c_custkey", "c_name"), ["c_name", "c_custkey"]).select("c_custkey", "ordinal")


@query("SELECT p_partkey, row_number() OVER (ORDER BY lower(p_name), p_partkey) AS place FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS p_name FROM part)")
def case_insensitive_order(spark, d):
    rows = t(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("p_name"))
    return sampling.ordinals(rows, [F.lower("p_name"), F.col("p_partkey")], "place").select("p_partkey", "place")


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'validation' ELSE 'train' END AS split FROM documents")
def split_relabel(spark, d):
    return docs_split(spark, d).select("doc_id", sampling.relabel(F.col("split"), {"val": "validation"}).alias("split"))


@query("""SELECT page_id, p[1] = 'blog' AND len(p) = 4 AND p[2] IN ('com', 'net') AND p[3] IN ('en', 'de') AND p[4] <> '' AS fits, starts_with(path, 'blog/') AND ends_with(lower(path), '/7') AS ends, contains(lower(path), '/test/') AS held_out
FROM (SELECT page_id, path, string_split(path, '/') AS p FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'blog/' WHEN 1 THEN 'www/' ELSE 'x/Test/' END || CASE WHEN contains(url, '.com') THEN 'com' ELSE 'net' END || '/' || string_split(url, '/')[4] || '/' || (page_id % 10) AS path FROM pages))""")
def path_predicates(spark, d):
    m = F.col("page_id") % 3
    path = F.concat(F.when(m == 0, "blog/").when(m == 1, "www/").otherwise("x/Test/"), F.when(F.col("url").contains(".com"), "com").otherwise("net"), F.lit("/"), F.split("url", "/")[3], F.lit("/"), (F.col("page_id") % 10).cast("string"))
    rows = t(spark, d, "pages").select("page_id", path.alias("path"))
    p = F.col("path")
    return rows.select("page_id", labels.path_fits(p, "blog", ["com", "net"], ["en", "de"]).alias("fits"), labels.has_ends(p, "blog/", "/7").alias("ends"), labels.held_out_path(p).alias("held_out"))


@query("""SELECT 'held_out_path' AS rule, CAST(doc_id AS VARCHAR) AS key FROM documents WHERE doc_id % 10 = 0""")
def held_out_guard(spark, d):
    rows = docs_split(spark, d).withColumn("path", F.concat(F.lit("data\\"), F.initcap("split"), F.lit("\\"), F.col("doc_id").cast("string")))
    return checks.held_out(rows, "doc_id", "path")


@query("""SELECT p_partkey, 'cubit_' || CASE WHEN p_size % 2 = 0 THEN 'train' ELSE 'val' END || '_' || replace(lower(p_name), ' ', '-') AS record_id, split_part(replace(lower(p_name), ' ', '_'), '_', 1) AS prefix,
CASE WHEN p_type IN ('STANDARD', 'PROMO') THEN p_type ELSE 'unknown' END AS kind, 'pending' AS status, 1 AS version FROM part""")
def derived_records(spark, d):
    split = F.when(F.col("p_size") % 2 == 0, "train").otherwise("val")
    rows = t(spark, d, "part").select(
        "p_partkey", labels.record_id("cubit", split, F.concat(F.lit("images/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".PNG"))).alias("record_id"),
        labels.prefix_of(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".txt"))).alias("prefix"), labels.coerced(F.col("p_type"), ["STANDARD", "PROMO"]).alias("kind"),
    )
    return annotations.status_rows(rows, {"status": "pending", "version": 1})


@query("""SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN 'train' END AS eligibility, CASE WHEN doc_id % 2 = 0 THEN 'passed' ELSE 'failed' END AS geometry_qc FROM documents) WHERE coalesce(eligibility, '') <> '' AND geometry_qc = 'passed'""")
def eligible_rows(spark, d):
    m = F.col("doc_id") % 3
    return annotations.eligible(t(spark, d, "documents").select("doc_id", F.when(m == 0, "").when(m == 1, "train").alias("eligibility"), F.when(F.col("doc_id") % 2 == 0, "passed").otherwise("failed").alias("geometry_qc"))).select("doc_id")


# --- arrays, text and numbers -------------------------------------------------------------------------------------


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, '{\"id\":' || event_id || ',\"kind\":\"' || event_type || '\",\"note\":null}' AS record FROM events")
def utc_and_compact_json(spark, d):
    record = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.lit(None).cast("string").alias("note"), F.lit(b"raw").alias("payload"))
    return t(spark, d, "events").select("event_id", labels.utc_text(F.col("ts")).alias("at"), labels.compact_json(annotations.without_field(record, "payload")).alias("record"))


@query("""WITH x AS (SELECT p_partkey, string_split(p_name, ' ') AS a, [p_size, p_size + 1, p_size + 2][1:p_partkey % 4] AS b FROM part), n AS (SELECT p_partkey, a, b, least(len(a), len(b)) AS n FROM x)
SELECT p_partkey, CAST(i - 1 AS INTEGER) AS annotation_index, a[i] AS word, b[i] AS size FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM n)""")
def zipped_to_shortest(spark, d):
    s = F.col("p_size")
    z = labels.zip_shortest(word=F.split("p_name", " "), size=F.slice(F.array(s, s + 1, s + 2), F.lit(1), (F.col("p_partkey") % 4).cast("int")))
    rows = annotations.indexed(t(spark, d, "part").select("p_partkey", z.alias("z")), "z")
    return rows.select("p_partkey", "annotation_index", "z.word", "z.size")


@query("""SELECT p_partkey, coalesce(map {'STANDARD': 1, 'PROMO': 2}[p_type], 9) AS code, md5(p_name) AS digest, round_even(CAST(CAST(p_retailprice / 8 AS VARCHAR) AS DECIMAL(38, 14)), 2)::DOUBLE AS rounded,
CASE p_size % 3 WHEN 0 THEN 'crack|rust_staining' WHEN 1 THEN '' ELSE 'spalling' END AS canonical FROM part""")
def map_defaults_and_rounding(spark, d):
    table = F.create_map(F.lit("STANDARD"), F.lit(1), F.lit("PROMO"), F.lit(2))
    m = F.col("p_size") % 3
    native = F.when(m == 0, F.array(F.lit("Rust"), F.lit("Crack"), F.lit("ACrack"))).when(m == 1, F.array(F.lit("Cavity"), F.lit("nothing"))).otherwise(F.array(F.lit("Spalling"), F.lit("spalling")))
    return t(spark, d, "part").select("p_partkey", labels.map_value(table, F.col("p_type"), F.lit(9)).alias("code"), F.md5(F.col("p_name").cast("binary")).alias("digest"), labels.rounded(F.col("p_retailprice") / 8, 2).alias("rounded"), F.array_join(labels.canonical_set(native), "|").alias("canonical"))


@query(f"""WITH {BOX_SQL}, q AS (SELECT *, greatest(0.0::DOUBLE, x1) AS a, greatest(0.0::DOUBLE, y1) AS b, least(x2, 480.0::DOUBLE) AS c, least(y2, 360.0::DOUBLE) AS e FROM b)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN c > a AND e > b THEN (c - a) * (e - b) END AS area, CASE WHEN c > a AND e > b THEN 0 ELSE 1 END AS rejected, least(x2, 479.0::DOUBLE) AS prompt_x2,
CASE WHEN l_linenumber = 1 THEN x1 + 2 ELSE x1 END AS first_x, CASE WHEN (x2 - x1) * (y2 - y1) / 2 > 50 THEN x1 ELSE x1 + 1 END AS largest_x FROM q""")
def box_rejects_and_prompts(spark, d):
    rows = boxes(spark, d)
    xywh = F.array(F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    c = geometry.clamp_xywh(xywh, F.lit(480.0), F.lit(360.0))
    x1, y1, x2, y2 = (F.col(n) for n in ("x1", "y1", "x2", "y2"))
    triangle = F.array(x1, y1, x2, y1, x2, y2)
    other = F.array(x1 + 2, y1, x2, y1, x2, y2)
    first = geometry.first_polygon(F.when(F.col("l_linenumber") == 1, F.array(F.array(x1, y1), other)).otherwise(F.array(triangle, other)))
    square = geometry.points(F.array(x1 + 1, y1, x1 + 11, y1, x1 + 11, y1 + 5, x1 + 1, y1 + 5))
    largest = geometry.largest_polygon(F.array(square, geometry.points(triangle)))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (c["box"][2] * c["box"][3]).alias("area"), c["rejected"].alias("rejected"), geometry.prompt_box(F.array(xywh), F.lit(480.0), F.lit(9999.0))[2].alias("prompt_x2"),
        first[0][0].alias("first_x"), largest[0][0].alias("largest_x"),
    )


@query("""SELECT doc_id, CAST(i AS INTEGER) AS annotation_index, CAST(doc_id % 50 AS DOUBLE) AS x, CAST(i + 1 AS DOUBLE) AS corner FROM documents, (SELECT unnest([0, 1, 2]) AS i) WHERE i <> 1 AND NOT (i = 2 AND doc_id % 2 = 0)""")
def training_pair_rows(spark, d):
    def a(i):
        good = F.array(*[F.lit(float(v)) for v in (i + 1, 0, 5, 0, 5, 5)])
        polygon = F.when(F.lit(i) == 2, F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(good)).otherwise(good)
        return F.struct(F.lit("unknown" if i == 1 else "positive").alias("annotation_status"), F.array((F.col("doc_id") % 50).cast("double"), F.lit(0.0), F.lit(5.0), F.lit(5.0)).alias("box_xywh"), F.array(polygon).alias("polygons"))

    rows = annotations.training_pairs(t(spark, d, "documents").select("doc_id", F.array(a(0), a(1), a(2)).alias("annotations")))
    return rows.select("doc_id", "annotation_index", F.col("box_xywh")[0].alias("x"), F.col("polygon")[0][0].alias("corner"))


@query("""WITH o AS (SELECT doc_id, source, n_chars % 8 AS c, n_chars % 700 AS x FROM documents)
SELECT doc_id, CASE c WHEN 0 THEN 'unknown_0' WHEN 2 THEN 'Crack' WHEN 3 THEN 'Net-Crack' WHEN 4 THEN 'Crack with Precipitation' WHEN 5 THEN 'Rust' WHEN 6 THEN 'Spalling' ELSE 'unknown_7' END AS native_label,
CASE WHEN c IN (0, 7) THEN 'unknown_review' WHEN c = 5 THEN 'rust_staining' WHEN c = 6 THEN 'spalling' ELSE 'crack' END AS canonical_label, CASE WHEN c IN (0, 7) THEN 'unknown' WHEN c = 5 THEN 'direct_visual' ELSE 'direct' END AS mapping_strength,
CASE WHEN x < 640 THEN least(x + 50, 640)::DOUBLE - x END AS w, CASE WHEN c % 2 = 0 THEN 'native_polygon' ELSE 'unavailable_after_geometry_qc' END AS segmentation_provenance, CAST(c % 2 AS INTEGER) AS rejected_geometry_count FROM o WHERE c <> 1""")
def class_number_annotations(spark, d):
    n = F.col("n_chars")
    x = (n % 700).cast("double")
    flat = F.when(n % 2 == 0, F.array(x, F.lit(0.0), x + 9, F.lit(0.0), x, F.lit(9.0))).otherwise(F.array(x, F.lit(0.0), x))
    objects = F.struct(F.array((n % 8).cast("int")).alias("category_id"), F.array(F.array(x, F.lit(1.0), F.lit(50.0), F.lit(60.0))).alias("bbox"), F.array(F.array(flat)).alias("segmentation"), F.array("doc_id").alias("id"))
    got = annotations.from_class_numbers(t(spark, d, "documents").select("doc_id", "n_chars", objects.alias("o")), "doc_id", "o", F.lit(640), F.lit(480))
    return got.select("doc_id", "native_label", "canonical_label", "mapping_strength", F.col("box_xywh")[2].alias("w"), "segmentation_provenance", "rejected_geometry_count")


@query("""WITH p AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS x FROM embeddings),
m AS (SELECT vec_id, i, i % 8 AS col, i // 8 AS row, x > 0 AS a, x > -0.05 AND x < 0.1 AS b FROM p)
SELECT vec_id, CAST(sum(CASE WHEN a THEN 1 ELSE 0 END) AS BIGINT) AS area, CAST(sum(CASE WHEN a AND b THEN 1 ELSE 0 END) AS BIGINT) AS "both", CAST(sum(CASE WHEN a OR b THEN 1 ELSE 0 END) AS BIGINT) AS either,
CAST(max(CASE WHEN a THEN col END) - min(CASE WHEN a THEN col END) + 1 AS BIGINT) AS box_w, CAST(min(CASE WHEN a THEN row END) AS BIGINT) AS box_y FROM m GROUP BY 1""")
def mask_overlaps(spark, d):
    """Masks of 8 by 8 pixels, one a component, as runs: area, box and overlap of two."""
    x = F.col("embedding")
    rows = t(spark, d, "embeddings").select("vec_id", masks.runs_of(F.transform(x, lambda v: v > 0)).alias("a"), masks.runs_of(F.transform(x, lambda v: (v > -0.05) & (v < 0.1))).alias("b"))
    around = masks.box(F.col("a"), F.lit(8))
    one = rows.select("vec_id", masks.area(F.col("a")).alias("area"), around[2].alias("box_w"), around[1].alias("box_y"))
    return one.join(masks.overlap(rows, ["vec_id"], "a", "b").select("vec_id", "both", "either"), "vec_id")


UUID_SQL = "substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-5' || substr({0}, 14, 3) || '-' || substr('89ab', 1 + ('0x' || substr({0}, 17, 1))::INTEGER % 4, 1) || substr({0}, 18, 3) || '-' || substr({0}, 21, 12)"


@query(f"""WITH e AS (SELECT event_id, event_type, value, user_id % 200 AS x FROM events), k AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('["run-1","s' || event_id || '","crack","unspecified",[' || x || '.0,10.0,' || least(100, 250 - x) || '.0,30.5]]')) AS h FROM e)
SELECT event_id, 'finding-' || {UUID_SQL.format('h')} AS finding_id, round(least(value / 50, 1), 6) AS confidence, CAST(greatest(least(100, 250 - x), 30.5) AS DOUBLE) AS length, CASE WHEN event_type = 'click' THEN 5 ELSE 4 END - CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS limitations,
CASE WHEN event_id % 2 = 0 THEN 'valid' WHEN event_type = 'view' THEN 'invalid' ELSE 'not_provided' END AS scale_status FROM k""")
def finding_record_content(spark, d):
    """Whole finding records, each of which fits the schema of findings (no error is left), in a few of their fields."""
    x = (F.col("user_id") % 200).cast("double")
    quality = F.when(F.col("event_type") == "click", findings.image_quality(F.lit(100), F.lit(600), F.lit(100.0), F.lit(99.0))).otherwise(findings.image_quality(F.lit(600), F.lit(600), F.lit(100.0), F.lit(99.0)))
    calibration = F.when(F.col("event_id") % 2 == 0, F.struct(F.lit("reference_marker").alias("method"), F.lit("mm").alias("unit"), F.lit(0.5).alias("mm_per_pixel"), F.lit(1.0).alias("uncertainty")))
    key = F.col("event_id").cast("string")
    rows = t(spark, d, "events").select(
        F.concat(F.lit("s"), key).alias("sample_id"), key.alias("source_image_id"), F.lit("").alias("parent_image_id"), F.lit("").alias("group_id"), F.lit("events").alias("source_dataset"), F.lit("drone").alias("capture_mode"),
        F.concat(F.lit("images/"), key).alias("uri"), F.sha2(key, 256).alias("sha256"), F.lit(250).alias("width_pixels"), F.lit(600).alias("height_pixels"), F.lit("crack").alias("defect_family"), F.lit("unspecified").alias("subtype"),
        F.array(x, F.lit(10.0), x + 100, F.lit(40.5)).alias("box_xyxy"), (F.col("value") / 50).alias("confidence"), F.array(F.lit("base")).alias("pipeline_route"), F.lit("not_required").alias("escalation_state"), quality.alias("quality"),
        calibration.alias("calibration"), F.when(F.col("event_type") == "view", "invalid").alias("unavailable_scale_status"),
    )
    built = findings.finding_records(rows, "run-1", "p", F.lit("2026-01-01T00:00:00Z"), {"model_id": "m", "checkpoint_sha256": "0" * 64, "pipeline_version": "1", "dataset_manifest_version": "1", "runtime": "r"})
    # the text is exploded, so that the filter reads it and is not pushed below what the record is made of, which would be made twice
    whole = built.withColumn("json", F.explode(F.array(findings.record_json(built))))
    return whole.where(F.size(json_schema.schema_errors(F.col("json"), FINDING_RULES)) == 0).select(F.substring("image.source_image_id", 1, 99).cast("bigint").alias("event_id"), "finding_id", F.col("prediction.confidence").alias("confidence"), F.col("measurement.pixel.length").alias("length"), F.size("limitation_codes").alias("limitations"), "measurement.scale_status")


# The rules of the finding schema that concern what is derived here, in the form of JSON Schema.
FINDING_RULES = {
    "type": "object",
    "required": ["finding_id", "image", "prediction", "measurement", "review", "limitation_codes"],
    "properties": {
        "finding_id": {"type": "string", "minLength": 1},
        "created_at": {"type": "string", "format": "date-time"},
        "image": {"type": "object", "required": ["sha256", "width_pixels", "quality"], "properties": {"sha256": {"type": "string", "pattern": "^[a-f0-9]{64}$"}, "width_pixels": {"type": "integer", "minimum": 1}, "parent_image_id": {"type": ["string", "null"]}, "capture_mode": {"enum": list(findings.CAPTURE_MODES)}}},
        "prediction": {
            "type": "object",
            "properties": {
                "immutable": {"const": True},
                "confidence": {"type": "number", "minimum": 0, "maximum": 1},
                "geometry": {"properties": {"box_xywh": {"type": "array", "prefixItems": [{"minimum": 0}, {"minimum": 0}, {"exclusiveMinimum": 0}, {"exclusiveMinimum": 0}], "minItems": 4, "maxItems": 4}}},
                "pipeline_route": {"type": "array", "minItems": 1, "items": {"type": "string", "minLength": 1}},
            },
        },
        "measurement": {"type": "object", "allOf": [{"if": {"required": ["physical"]}, "then": {"properties": {"scale_status": {"const": "valid"}}, "required": ["scale_method"]}}]},
        "review": {"additionalProperties": False, "properties": {"state": {"enum": ["unreviewed", "approved", "rejected", "relabelled", "escalated"]}, "reviewer_id": {}, "reviewed_at": {}, "reviewer_label": {}, "notes": {}}},
    },
}

# Rules of the events' properties, with errors that some of them have.
PROPS_RULES = {"type": "object", "required": ["k", "type"], "additionalProperties": False, "properties": {"k": {"type": "integer", "maximum": 89}, "type": {"enum": ["click", "view", "purchase"]}, "note": {"type": "string"}}, "if": {"properties": {"type": {"const": "view"}}}, "then": {"properties": {"k": {"minimum": 10}}}}


@query("""WITH e AS (SELECT event_id, event_type AS t, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE props IS NOT NULL),
x AS (SELECT event_id, unnest([CASE WHEN k > 89 THEN 'k: is above 89' END, CASE WHEN t = 'view' AND k < 10 THEN 'k: is below 10' END, CASE WHEN t NOT IN ('click', 'view', 'purchase') THEN 'type: is not one of ["click", "view", "purchase"]' END, CASE WHEN t = 'signup' THEN ': more is not allowed' END, CASE WHEN t = 'error' THEN 'note: is not of type string' END]) AS m FROM e)
SELECT event_id, string_agg(m, '; ' ORDER BY m) AS errors FROM x WHERE m IS NOT NULL GROUP BY 1""")
def schema_errors_of_props(spark, d):
    more = F.when(F.col("event_type") == "signup", ', "more": [1]').when(F.col("event_type") == "error", ', "note": 1').otherwise("")
    text = F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "type": "'), "event_type", F.lit('"'), more, F.lit("}"))
    found = json_schema.invalid_documents(t(spark, d, "events").where("props is not null").select("event_id", text.alias("text")), "event_id", "text", PROPS_RULES)
    return found.select("event_id", F.array_join(F.transform("errors", lambda e: F.concat(e["path"], F.lit(": "), e["message"])), "; ").alias("errors"))


# --- checks -------------------------------------------------------------------------------------------------------


@query("""SELECT 'physical' AS rule, CAST(event_id AS VARCHAR) AS key FROM events WHERE event_id % 3 = 0 AND NOT (event_id % 2 = 0 AND event_type <> 'error')""")
def physical_needs_calibration(spark, d):
    e = t(spark, d, "events")
    holds = checks.physical_rule(F.when(F.col("event_id") % 3 == 0, "physical").otherwise("pixel"), F.when(F.col("event_id") % 2 == 0, "valid"), F.when(F.col("event_type") != "error", F.col("event_type")))
    return checks.violations(e, "event_id", {"physical": holds})


@query("""WITH f AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'json' WHEN 2 THEN 'PNG' WHEN 3 THEN 'png' ELSE 'gif' END AS e FROM events)
SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'broken_json' WHEN 3 THEN 'broken_image' WHEN 4 THEN 'unsupported_format' END AS error FROM f""")
def annotation_formats(spark, d):
    m = F.col("event_id") % 5
    ending = F.when(m <= 1, ".json").when(m == 2, ".PNG").when(m == 3, ".png").otherwise(".gif")
    content = F.when(m == 0, F.col("props").cast("binary")).when(m == 1, F.lit("{").cast("binary")).when(m == 2, F.unhex(F.lit("89504E470D0A1A0A00"))).otherwise(F.lit("x").cast("binary"))
    return t(spark, d, "events").select("event_id", checks.format_error(F.concat(F.lit("a/b"), ending), content).alias("error"))


@query("""WITH v AS (SELECT CASE WHEN o_totalprice <= 1000 THEN 'price' ELSE 'status' END AS rule, CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE o_totalprice <= 1000 OR o_orderstatus NOT IN ('O', 'F'))
SELECT rule, count(*) AS n, array_to_string(list_sort(list(DISTINCT key))[1:5], ',') AS errors FROM (SELECT 'price' AS rule, CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE o_totalprice <= 1000 UNION ALL SELECT 'status', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus NOT IN ('O', 'F')) GROUP BY 1""")
def first_errors_by_rule(spark, d):
    found = checks.violations(t(spark, d, "orders"), "o_orderkey", {"price": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus").isin("O", "F")})
    return checks.first_errors(found).withColumn("errors", F.array_join("errors", ","))


@query("""WITH x AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'crack' WHEN 1 THEN 'crack|spalling' WHEN 2 THEN 'dent' END AS l, CASE WHEN p_partkey % 6 = 0 THEN 'done' ELSE 'positive' END AS s FROM part)
SELECT 'single_label' AS rule, CAST(p_partkey AS VARCHAR) AS key FROM x WHERE l = 'crack|spalling' UNION ALL SELECT 'label', CAST(p_partkey AS VARCHAR) FROM x WHERE l IS NULL OR l <> 'crack' UNION ALL SELECT 'state', CAST(p_partkey AS VARCHAR) FROM x WHERE s = 'done'""")
def ledger_value_checks(spark, d):
    m = F.col("p_size") % 4
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("sample_id"), F.when(m == 0, "crack").when(m == 1, "crack|spalling").when(m == 2, "dent").alias("canonical_label"), F.when(F.col("p_partkey") % 6 == 0, "done").otherwise("positive").alias("annotation_status"))
    return checks.ledger_errors(rows, ["crack", "spalling"], ["positive", "unknown"])


@query("""SELECT 'same_set' AS rule, CAST(doc_id AS VARCHAR) AS key FROM documents WHERE doc_id % 13 = 0 UNION ALL SELECT 'cardinality', CAST(count(*) AS VARCHAR) FROM documents HAVING count(*) <> 7 UNION ALL SELECT 'subset', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 13 = 0""")
def set_and_cardinality(spark, d):
    a = t(spark, d, "documents").select("doc_id")
    b = a.where("doc_id % 13 <> 0")
    return checks.all_of(checks.different_sets(a, b, "doc_id"), checks.wrong_cardinality(a, 7), checks.subset(a, b, "doc_id"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 5 = 0 THEN 'missing' ELSE 'mismatch' END AS problem FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0""")
def rehash_before_use(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), "text")
    manifest = x.select("path", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return checks.changed_files(manifest, x.where("doc_id % 5 <> 0"), "path", "text")


# --- state --------------------------------------------------------------------------------------------------------


@query("""SELECT user_id, CASE arg_max(event_type, struct_pack(ts := ts, id := event_id)) WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'processing' END AS status, count(*) AS attempts FROM events GROUP BY 1""")
def processing_status(spark, d):
    k = F.col("event_type")
    rows = t(spark, d, "events").withColumn("outcome", F.when(k == "purchase", "ok").when(k == "error", "error").otherwise("started"))
    return findings.processing_status(rows, "user_id", ["ts", "event_id"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_pending(spark, d):
    return findings.pending(t(spark, d, "documents").select("doc_id"), t(spark, d, "labels"), "doc_id")


@query("""SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events WHERE event_id % 4 <> 0 AND json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1""")
def recover_records(spark, d):
    stored = t(spark, d, "events").select(F.when(F.col("event_id") % 4 == 0, F.lit("{broken")).otherwise(F.col("props")).alias("text"))
    return findings.recovered(stored, "text", "k bigint", "k").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT true AS models, (SELECT count(*) > 0 FROM labels WHERE toxic = 7) AS results, false AS ready")
def readiness(spark, d):
    return findings.ready(models=t(spark, d, "labels"), results=t(spark, d, "labels").where("toxic = 7"))


@query("""WITH a AS (SELECT p_brand AS model, CAST(p_partkey AS VARCHAR) AS path, octet_length(encode(p_name)) AS size, p_partkey FROM part), w AS (SELECT *, p_partkey % 9 <> 0 AND p_partkey % 50 <> 1 AS good, p_partkey % 50 <> 1 AS there FROM a WHERE p_partkey % 3 <> 0 OR p_partkey % 9 = 0)
SELECT model, CAST(sum(CASE WHEN p_partkey % 50 <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS files, CAST(sum(CASE WHEN p_partkey % 50 <> 1 THEN size ELSE 0 END) AS BIGINT) AS bytes, bool_and(coalesce((SELECT good FROM w WHERE w.p_partkey = a.p_partkey), true)) AND count((SELECT 1 FROM w WHERE w.p_partkey = a.p_partkey)) > 0 AS ready
FROM a WHERE p_partkey % 50 <> 1 OR p_partkey IN (SELECT p_partkey FROM w) GROUP BY 1""")
def asset_readiness(spark, d):
    p = t(spark, d, "part").select(F.col("p_brand").alias("model"), F.col("p_partkey").cast("string").alias("path"), F.col("p_name").alias("content"), "p_partkey")
    wanted = p.where("p_partkey % 3 <> 0 or p_partkey % 9 = 0").select("model", "path", F.sha2(F.when(F.col("p_partkey") % 9 == 0, F.lit("other")).otherwise(F.col("content")), 256).alias("sha256"))
    return findings.asset_inventory(p.where("p_partkey % 50 <> 1"), "model", "path", "content", wanted)


@query("""SELECT event_type AS model, count(*) AS runs, bool_and(value >= 0.01) AS passed, round(avg(value), 9) AS mean_seconds, array_to_string(list_sort(list(DISTINCT CAST(user_id % 5 AS VARCHAR))), '|') AS samples FROM events WHERE event_id % 10 <> 0 GROUP BY 1""")
def smoke_run_summary(spark, d):
    record = F.to_json(F.struct(F.col("event_type").alias("model"), (F.col("user_id") % 5).cast("string").alias("sample"), (F.col("value") >= 0.01).alias("ok"), F.col("value").alias("seconds")))
    rows = t(spark, d, "events").select(F.when(F.col("event_id") % 10 == 0, F.lit("not json")).otherwise(record).alias("text"))
    return findings.smoke_summary(rows, "text").withColumn("mean_seconds", F.round("mean_seconds", 9))


# --- models and sources at their boundary -------------------------------------------------------------------------


def _weights():
    return [[1.0 if j % 6 == k else 0.0 for j in range(64)] for k in range(6)]


def _scores(model, batch):
    return [[sum(w * x for w, x in zip(row, v)) for row in model] for v in batch["embedding"]]


@query("""SELECT vec_id, CAST(i AS INTEGER) AS label, round(list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_filter(range(0, 64), lambda j: j % 6 = i), lambda j: embedding[j + 1]::DOUBLE)), lambda a, x: a + x), 6) AS score FROM embeddings, (SELECT unnest(range(0, 6)) AS i)""")
def model_scores(spark, d):
    rows = t(spark, d, "embeddings").select("vec_id", "embedding")
    scored = inference.apply_model(rows, ["embedding"], _weights, _scores, "scores", inference.SCORES, "linear")
    return annotations.indexed(scored.select("vec_id", "scores"), "scores", "label").select("vec_id", "label", F.round("scores", 6).alias("score"))


def _boxes_of(model, batch):
    return [[{"label": "crack", "score": float(k + 1) / 4, "box_xywh": [float(n % 100), float(k), 10.0, 5.0]} for k in range(n % 3)] for n in batch["doc_id"]]


def _polygons_of(model, batch):
    return [[[0.0, 0.0, 1.0, 0.0, 1.0, 1.0]] if n % 2 else [] for n in batch["doc_id"]]


@query("""SELECT doc_id, CAST(k AS INTEGER) AS annotation_index, (k + 1) / 4.0::DOUBLE AS score, CASE WHEN k = 0 AND doc_id % 2 = 1 THEN 0.0::DOUBLE ELSE CAST(doc_id % 100 AS DOUBLE) END AS x, CASE WHEN k = 0 AND doc_id % 2 = 1 THEN 6 ELSE 8 END AS numbers
FROM (SELECT doc_id, unnest(range(0, doc_id % 3)) AS k FROM documents)""")
def model_polygons(spark, d):
    rows = inference.apply_model(t(spark, d, "documents").select("doc_id"), ["doc_id"], dict, _boxes_of, "detections", inference.DETECTIONS, "boxes")
    rows = inference.apply_model(rows, ["doc_id"], dict, _polygons_of, "polygons", inference.POLYGONS, "polygons")
    shapes = inference.polygons_or_boxes(F.transform("detections", lambda x: x["box_xywh"]), F.col("polygons"))
    rows = annotations.indexed(rows.select("doc_id", F.arrays_zip(F.col("detections").alias("d"), shapes.alias("p")).alias("z")), "z")
    return rows.select("doc_id", "annotation_index", F.col("z.d.score").alias("score"), F.col("z.p")[0].alias("x"), F.size("z.p").alias("numbers"))


@query("""WITH c AS (SELECT 'cif' AS source, p_partkey AS sample_id, unnest(range(0, p_partkey % 3)) AS i FROM part), s AS (SELECT 's2ds', p_partkey, 0 FROM part WHERE p_size % 2 = 0), v AS (SELECT 'voc', p_partkey, unnest([0, 1]) FROM part)
SELECT source, sample_id, CAST(i AS INTEGER) AS annotation_index, CASE source WHEN 'cif' THEN 'spalling' WHEN 's2ds' THEN 'crack' ELSE CASE WHEN i = 0 THEN 'rust_staining' ELSE 'unknown_review' END END AS canonical_label, CAST(sample_id % 100 AS DOUBLE) AS x
FROM (SELECT * FROM c UNION ALL SELECT * FROM s UNION ALL SELECT * FROM v)""")
def normalised_sources(spark, d):
    p = t(spark, d, "part").withColumn("x", F.format_string("[%d, 1, 2, 3]", F.col("p_partkey") % 100))
    join = lambda c: F.array_join(F.array_repeat(c, (F.col("p_partkey") % 3).cast("int")), ",")
    made = {
        "cif": F.concat(F.lit('{"objects": {"category": ["Spalling", "Spalling"], "bbox": ['), join(F.col("x")), F.lit("]}}")),
        "s2ds": F.concat(F.lit('{"masks": [{"label": "Crack", "pixels": '), F.when(F.col("p_size") % 2 == 0, "4").otherwise("0"), F.lit(', "box": '), F.col("x"), F.lit("}]}")),
        "voc": F.concat(F.lit('{"object": [{"name": "Rust", "box": '), F.col("x"), F.lit('}, {"name": "other", "box": '), F.col("x"), F.lit("}]}")),
    }
    rows = annotations.normalise_sources(**{k: p.select(F.col("p_partkey").alias("sample_id"), v.alias("payload")) for k, v in made.items()})
    return rows.select("source", "sample_id", "annotation_index", "canonical_label", F.col("box_xywh")[0].alias("x"))


@query(f"""WITH {CODE_SQL}, p AS (SELECT x.vec_id AS left_id, y.vec_id AS right_id, CAST(bit_count(xor(x.code, y.code)) AS INTEGER) AS distance, x.split <> y.split AS cross_split, x.vec_id % 7 = y.vec_id % 7 AS exact FROM codes x JOIN codes y ON x.vec_id < y.vec_id AND bit_count(xor(x.code, y.code)) <= {RADIUS})
SELECT left_id, right_id, row_number() OVER (ORDER BY cross_split DESC, exact DESC, distance, left_id, right_id) AS pair_rank FROM p""")
def ranked_pairs(spark, d):
    rows = coded(spark, d)
    side = lambda s: rows.select(F.col("vec_id").alias(f"{s}_id"), F.col("split").alias(f"{s}_split"))
    pairs = dedup.hamming_pairs(rows, "vec_id", "code", RADIUS).join(side("left"), "left_id").join(side("right"), "right_id")
    pairs = pairs.withColumns({"cross_split": F.col("left_split") != F.col("right_split"), "exact": F.col("left_id") % 7 == F.col("right_id") % 7})
    return dedup.ranked_pairs(pairs).select("left_id", "right_id", "pair_rank")


@query("""WITH x AS (SELECT vec_id, unnest(embedding[1:32]) AS v FROM embeddings), q AS (SELECT vec_id, CASE WHEN v > 0.1 THEN 4278190335 WHEN v > 0 THEN 16711935 ELSE 255 END AS color FROM x)
SELECT vec_id, color, count(*) AS n, color <> 255 AS object FROM q GROUP BY 1, 2""")
def colours_of_images(spark, d):
    """Images made of embeddings: 4 by 8 pixels, red, green or black by value."""

    def decode(data):
        import numpy as np

        v = np.frombuffer(data, ">f4").reshape(4, 8)
        out = np.zeros((4, 8, 4), np.uint8)
        out[..., 3] = 255
        out[v > np.float32(0.1), 0] = 255
        out[(v > 0) & (v <= np.float32(0.1)), 1] = 255
        return out

    raw = F.unhex(F.array_join(F.transform(F.slice("embedding", 1, 32), lambda x: F.lpad(F.hex(_float_bits(x)), 8, "0")), ""))
    counted = images.map_images(t(spark, d, "embeddings").select("vec_id", raw.alias("content")), "content", decode, images.palette_counts, "counts", "array<struct<color:bigint,n:bigint>>")
    rows = counted.select("vec_id", F.explode("counts").alias("c"))
    return rows.select("vec_id", F.col("c.color").alias("color"), F.col("c.n").alias("n"), (F.col("c.color") != 255).alias("object"))


def _float_bits(x):
    """The 32 bits of a float as a number, by arithmetic: sign, exponent and fraction. Not for subnormal numbers."""
    a = F.abs(x).cast("double")
    e = F.floor(F.log2(a))
    e = F.when(a >= F.pow(F.lit(2.0), e + 1), e + 1).when(a < F.pow(F.lit(2.0), e), e - 1).otherwise(e)
    bits = ((e + 127) * (1 << 23) + (a / F.pow(F.lit(2.0), e) - 1) * (1 << 23)).cast("bigint")
    return F.when(a == 0, F.lit(0).cast("bigint")).otherwise(bits + F.when(x < 0, F.lit(1 << 31)).otherwise(F.lit(0)))


@query("""WITH n AS (SELECT l.doc_id, CAST(l.quality AS INTEGER) AS target, CAST(d.n_chars % 1000 AS DOUBLE) / 1000 AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
c AS (SELECT CAST(sum(CASE WHEN score >= 0.5 AND target = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN score >= 0.5 AND target <> 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fp, CAST(sum(CASE WHEN score < 0.5 AND target = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fn FROM n)
SELECT round(tp / greatest(1, tp + fp), 4) AS precision, round(tp / greatest(1, tp + fn), 4) AS recall FROM c""")
def micro_at_half(spark, d):
    docs = t(spark, d, "documents").select("doc_id", ((F.col("n_chars") % 1000).cast("double") / 1000).alias("score"))
    rows = t(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("target")).join(docs, "doc_id")
    m = evaluation.binary_metrics(rows, "target", "score", F.lit(0.5))
    return m.select(F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'missing' WHEN o_orderkey % 6 = 1 THEN 'wrong_size' WHEN o_orderkey % 6 = 2 THEN 'wrong_sha256' WHEN o_orderkey % 6 = 3 THEN 'rough_size' WHEN o_orderkey % 6 = 4 THEN 'wrong_md5' ELSE 'verified' END AS state FROM orders""")
def download_verification(spark, d):
    m = F.col("o_orderkey") % 6
    big = F.lit(2_000_000_000).cast("bigint")
    o = t(spark, d, "orders")
    expected = o.select("o_orderkey", F.when(m == 3, big).when(m == 5, big).otherwise(100).alias("bytes"), F.when(m == 2, "A").alias("sha256"), F.when(m == 4, "b").alias("md5"))
    actual = o.where(m != 0).select("o_orderkey", F.when(m == 1, 101).when(m == 3, big * 2).when(m == 5, big + 1000).otherwise(100).alias("bytes"), F.lit("c").alias("sha256"), F.lit("d").alias("md5"))
    return checks.download_state(expected, actual, "o_orderkey")


@query("""SELECT n_nationkey, n_nationkey % 3 <> 0 AS everything_ok, CAST(n_nationkey * 10 AS BIGINT) AS files, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_regionkey AS BIGINT) END AS folders, n_nationkey % 3 = 0 AS explained FROM nation""")
def archive_reports(spark, d):
    k = F.col("n_nationkey")
    text = F.concat(F.when(k % 3 != 0, "Everything is Ok\n").otherwise("ERROR: Data Error\n"), F.when(k % 2 == 0, F.concat(F.lit("\nFolders: "), F.col("n_regionkey").cast("string"))).otherwise(""), F.lit("\nFiles: "), (k * 10).cast("string"), F.lit("\nSize:       99\n"))
    r = labels.archive_report(text, F.lit(0))
    return t(spark, d, "nation").select("n_nationkey", r["everything_ok"].alias("everything_ok"), r["files"].alias("files"), r["folders"].alias("folders"), r["diagnostic"].isNotNull().alias("explained"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS request, field, CASE WHEN field = 'image' THEN CAST(doc_id AS VARCHAR) || '.txt' END AS filename, CASE WHEN field = 'image' THEN sha256(text) ELSE sha256('note') END AS sha256 FROM documents, (SELECT unnest(['note', 'image']) AS field) WHERE doc_id % 5 <> 0""")
def form_uploads(spark, d):
    end = F.lit("\r\n")
    key = F.col("doc_id").cast("string")
    head = lambda *x: F.concat(F.lit("--b0undary"), end, F.lit("Content-Disposition: form-data; "), *x, end, end)
    body = F.concat(head(F.lit('name="note"')), F.lit("note"), end, head(F.lit('name="image"; filename="'), key, F.lit('.txt"')), F.col("text"), end, F.lit("--b0undary--"), end)
    rows = t(spark, d, "documents").select(key.alias("request"), F.when(F.col("doc_id") % 5 == 0, "text/plain").otherwise("multipart/form-data; boundary=b0undary").alias("kind"), body.alias("body"))
    return files.form_parts(rows, "request", "kind", "body").select("request", "field", "filename", F.sha2("content", 256).alias("sha256"))
