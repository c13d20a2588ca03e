import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.functions import stats as S
from quarrylens.functions import text as T
from quarrylens.operators import graph, mining, relational, resolve, search, stage, vectors
from quarrylens.sources import events


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("name", "words"),
    [("HTTPСервисНДС18ПродажиЗаказКлиента", ["http", "сервис", "ндс", "18", "продажи", "заказ", "клиента"]), ("getURLParts_v2x", ["get", "url", "parts"]), ("ÉcoleÄpfel2Go", ["école", "äpfel", "go"]), ("", []), ("A", [])],
)
def test_tokenize(spark, name, words):
    assert one(spark, T.tokenize_name(F.lit(name))) == words


def test_case_folding_is_unicode(spark):
    assert one(spark, T.same(F.lit("ЦеныНоменклатуры"), "ценыноменклатуры"))
    assert one(spark, T.has(F.lit("Straße ÄÖ"), "äö"))


def test_prefix_sharing_names_do_not_leak(spark):
    assert not one(spark, T.self_or_element(F.lit("Document.XY"), "Document.X"))
    assert one(spark, T.self_or_element(F.lit("Document.X.Attr"), "Document.X"))


def test_types_and_shapes(spark):
    assert one(spark, T.normalize_type(F.lit("CatalogRef.Goods"))) == "Catalog.Goods"
    assert one(spark, T.short_name(F.lit("Document.Sale.Date"))) == "Sale.Date"
    assert one(spark, T.literal_shape(F.lit("Имя12-x"))) == "a0-a"
    assert one(spark, T.stem(F.lit("документами"))) == "документа"
    assert one(spark, T.html_to_text(F.lit("<style>a</style><p>x &amp;lt; y&#39;s</p><br>z"))) == "x < y's\nz"


def test_walk_follows_shortest_hops(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("x", "b"), ("a", "c")], "src string, dst string")
    seeds = spark.createDataFrame([("c",)], "n string")
    assert {(r.node, r.hop) for r in graph.walk(seeds, e, 3).collect()} == {("b", 1), ("a", 1), ("x", 2), ("d", 2)}
    assert {(r.risk, r.n) for r in graph.risk_summary(graph.walk(seeds, e, 3)).collect()} == {("CRITICAL", 2), ("HIGH", 2)}


def test_resolution_classes(spark):
    methods = spark.createDataFrame([("m1", "Run", 1), ("m2", "Hidden", 0)], "module string, name string, is_export int")
    mods = spark.createDataFrame([("m1", None), ("m2", "Common")], "module string, common_name string")
    calls = spark.createDataFrame([("m1", "RUN"), ("m2", "run"), ("m1", "Message"), ("m1", "common.hidden"), ("m1", "Common.None"), ("m1", "Справочники.X.Найти"), ("m1", "q.Execute")], "caller_module string, callee_name string")
    got = {r.callee_name: (r.resolution, r.callee_key, r.confidence) for r in resolve.resolve(calls, methods, mods).collect()}
    assert got == {
        "RUN": ("local", "m1::run", 1.0), "run": ("unknown", None, 0.0), "Message": ("platform_global", None, 0.0), "common.hidden": ("common_module", "m2::hidden", 0.6),
        "Common.None": ("common_module", None, 0.0), "Справочники.X.Найти": ("object_manager", None, 0.0), "q.Execute": ("platform_var", None, 0.0),
    }


def test_equal_signal_contributes_nothing_and_exact_wins(spark):
    rows = [("m", "find", 1, 1.0, 0.0, 0.0, 0.1, 0.5, 0.0, 0.0), ("m", "Finder", 2, 0.5, 0.0, 9.0, 0.9, 0.5, 1.0, 1.0)]
    c = spark.createDataFrame(rows, "kind string, name string, payload int, exact double, synonym double, bm25 double, semantic double, idf double, usage double, degree double")
    out = {r.name: r for r in search.fuse(c).collect()}
    assert out["find"].idf == 0.0 and out["find"].score > out["Finder"].score and out["find"].reason == "exact"


def test_namesakes_collapse_to_the_most_called(spark):
    c = spark.createDataFrame([("m", "Go", "a", 1.0), ("m", "GO", "b", 5.0), ("n", "go", "c", 0.0)], "kind string, name string, payload string, degree double")
    got = {(r.kind, r.payload, r.others) for r in relational.collapse_namesakes(c, ["degree"]).collect()}
    assert got == {("m", "b", 1), ("n", "c", 0)}


def test_poisson_avoidance_thresholds(spark):
    rows = spark.createDataFrame([(0, 6.0), (0, 7.0), (3, 30.0), (9, 30.0), (0, 900.0)], "o long, e double")
    assert [r[0] for r in rows.orderBy("e", "o").select(S.avoids(F.col("o"), F.col("e"))).collect()] == [False, True, True, False, True]


def test_vectors(spark):
    v = vectors.random_index("token")
    assert np.abs(v).sum() <= 8 and (v == vectors.random_index("token")).all()
    assert not vectors.quantize(np.zeros(4)).any()
    assert one(spark, search.cosine01(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_envelope_states_truncation(spark):
    out = relational.to_envelope(spark.range(5).select("id", F.lit(None).cast("string").alias("n")), 3)
    assert out["truncated"] and out["count"] == 3 and out["rows"][0] == [0]
    assert relational.clamp(None, 20, 500) == 20 and relational.clamp(9999, 20, 500) == 500


def test_existing_only_keeps_all_without_a_registry(spark):
    u = spark.createDataFrame([("A",), ("b",)], "k string")
    empty = spark.createDataFrame([], "r string")
    assert relational.existing_only(u, empty, "k", "r").count() == 2
    assert relational.existing_only(u, spark.createDataFrame([("B",)], "r string"), "k", "r").count() == 1


def test_sequences_are_distinct_in_a_basket(spark):
    e = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 3), (1, "b", 4), (1, "a", 5), (2, "a", 1), (2, "a", 2), (2, "a", 3)], "b int, s string, p int")
    assert {(r.gram, r.baskets) for r in mining.sequences(e, "b", "s", "p", 3, 1).collect()} == {("a > b > a", 1), ("b > a > b", 1)}


def test_profiles_stop_at_too_many_keys(spark):
    rows = spark.createDataFrame([(1, 1, f"s{i}", i) for i in range(30)], "m long, b long, s string, p long")
    found = mining.fragments(rows, "m", "b", "s", "p", F.lit("x"))
    with pytest.raises(mining.TooMany):
        mining.profile(found, most_keys=50)
    assert mining.profile(found, observed=1, modules=1).count() == 30 + 29 + 28 + 1


def test_walks_of_many_hops(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(0, 5)], "src long, dst long")
    got = {r.node: r.hop for r in graph.walk(spark.createDataFrame([(0,)], "n long"), edges, 6, inbound=False).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1, 6: 2, 7: 3, 8: 4, 9: 5, 10: 6}


def test_avoidance_within_roots_needs_the_root(spark):
    """In context x the member R.b is never used though R is; in y it is common.  Contexts without the root say nothing."""
    rows = [(i, "R.a", "x") for i in range(100)] + [(100 + i, s, "y") for i in range(100) for s in ("R.a", "R.b")] + [(300 + i, "Q.c", "x") for i in range(50)]
    events = spark.createDataFrame(rows, "b long, s string, k string")
    found = mining.avoided_within_roots(events, "b", "s", "k", F.substring_index("s", ".", 1)).collect()
    assert [(r.root, r.symbol, r.context, r.observed, r.expected) for r in found] == [("R", "R.b", "x", 0, 100.0)]


def test_fallback_to_any_term(spark):
    docs = spark.createDataFrame([(1, "red box"), (2, "red"), (3, "box")], "id long, t string")
    assert {r.id for r in search.and_then_or(docs, "id", {"t": 1.0}, ["red", "box"]).collect()} == {1}
    assert {r.id for r in search.and_then_or(docs, "id", {"t": 1.0}, ["red", "none"]).collect()} == {1, 2}


def dealt_by_size(df):
    """Whether the plan deals rows to a number of tasks that adaptive execution keeps."""
    return "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()


def test_a_file_of_many_modules_is_parsed_by_many_tasks(spark, tmp_path):
    code = F.concat(F.lit("Procedure P"), F.col("id").cast("string"), F.lit("()\n  Go();\nEndProcedure"))
    spark.range(20000).select(F.col("id").cast("string").alias("rel_path"), code.alias("content")).coalesce(1).write.parquet(str(tmp_path / "m"))
    found = events.events(spark.read.parquet(str(tmp_path / "m")))
    assert found.groupBy(F.spark_partition_id()).count().count() == 4
    assert found.count() == 20000


def test_tasks_follow_the_size_of_the_files(spark, tmp_path):
    spark.range(3000000).select(F.xxhash64("id").alias("h")).coalesce(1).write.parquet(str(tmp_path / "t"))
    small, large = spark.range(10), spark.read.parquet(str(tmp_path / "t"))
    assert stage.tasks(small) == 1
    assert stage.tasks(large) == 6  # 24 MB; the session's four are too few
    assert stage.tasks(spark.createDataFrame([(1,)], "a int")) == 4


def test_first_uses_meet_inside_their_task(spark, sf_dir):
    found = mining.ordered_pairs(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_orderkey", "l_linestatus", "l_linenumber")
    assert dealt_by_size(found)


def test_signatures_with_null_symbols(spark):
    rows = [(1, "a"), (1, None), (1, "a"), (2, "a"), (3, "a"), (3, "b"), (None, "a")]
    found = mining.signature_diversity(spark.createDataFrame(rows, "b int, s string"), "b", "s")
    assert {(r.symbol, r.baskets, r.signatures) for r in found.collect()} == {("a", 3, 2), ("b", 1, 1), (None, 1, 1)}
    assert dealt_by_size(found)


def test_avoidance_counts_inside_its_task(spark):
    events = spark.createDataFrame([(1, "R.a", "x")], "b long, s string, k string")
    assert dealt_by_size(mining.avoided_within_roots(events, "b", "s", "k", F.substring_index("s", ".", 1)))


def test_blocks_from_first_opening_to_last_closing(spark):
    rows = [(1, "o", 1), (1, "x", 2), (1, "c", 3), (1, "x", 4), (1, "c", 5), (1, "x", 6), (2, "c", 1), (2, "x", 2), (2, "o", 3), (3, "o", 1), (3, "c", 2), (3, "x", 3)]
    events = spark.createDataFrame(rows, "b int, s string, p int")
    found = mining.bracketed(events, "b", "s", "p", spark.createDataFrame([("o", "c")], "opening string, closing string"))
    assert sorted((r.b, r.p, r.inside) for r in found.collect()) == [(1, 1, False), (1, 2, True), (1, 3, True), (1, 4, True), (1, 5, False), (1, 6, False), (3, 1, False), (3, 2, False), (3, 3, False)]
    held = mining.block_contexts(found, "b", "s", "block", "inside")
    assert {(r.symbol, r.n, r.observed) for r in held.collect()} == {("o", 1, 0), ("x", 3, 2), ("c", 2, 1)}  # basket 3 holds nothing inside
    assert dealt_by_size(held)


def test_operator_usage_counts_inside_its_task(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, "a", "y"), (3, "b", "y")], "b int, s string, d string")
    found = mining.operator_usage(rows, "b", "s", "d")
    assert {(r.symbol, r.directive, r.n_symbol, r.n_directive, r.observed, r.total) for r in found.collect()} == {("a", "x", 2, 1, 1, 3), ("a", "y", 2, 2, 1, 3), ("b", "x", 1, 1, 0, 3), ("b", "y", 1, 2, 1, 3)}
    assert dealt_by_size(found)


def test_runs_are_found_inside_their_task(spark):
    events = spark.createDataFrame([(1, "a", 1)], "b int, s string, p int")
    assert dealt_by_size(mining.sequences(events, "b", "s", "p"))


def test_one_frequent_token_is_no_single_task(spark):
    tokens = spark.range(2000).select("id", F.lit("same").alias("token"))
    found = vectors.entity_vectors(tokens, "id", "token", spark.createDataFrame([("same", 2.0)], "token string, idf double"), 16)
    assert found.select("vector").distinct().count() == 1 and found.count() == 2000
    assert dealt_by_size(found)


def test_innermost_of_equal_starts_and_open_ends(spark):
    points = spark.createDataFrame([(1, "k", 5), (2, "k", 9), (3, "z", 1), (4, None, 1)], "id int, k string, at long")
    regions = spark.createDataFrame([("k", 1, None, "open"), ("k", 4, 6, "wide"), ("k", 4, 5, "a"), ("k", 4, 5, "b"), (None, 1, None, "none")], "k string, start long, end long, region string")
    found = relational.innermost_interval(points, regions, "k", "at", "id", "region")
    assert {(r.id, r.region) for r in found.collect()} == {(1, "b"), (2, "open"), (3, None), (4, None)}
    assert dealt_by_size(found)
