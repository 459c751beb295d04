"""Small frames for each operator: nulls, ties, cycles, empty inputs."""

import random

import pytest
from pyspark.sql import functions as F

from tracewarden import catalog
from tracewarden.functions import names
from tracewarden.operators import estate, governance, graph, identify, incidents, measure, policy, warehouse
from tracewarden.plans import lineage
from tracewarden.sources import tables
from tracewarden.streaming import recordings


def got(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=lambda r: [(x is None, 0 if x is None else x) for x in r])


def walked(pairs, depth):
    out = {}
    for seed in {a for a, b in pairs if a != b}:
        seen, front = {seed}, {seed}
        for hop in range(1, depth + 1):
            front = {b for a, b in pairs if a in front} - seen
            out |= {(seed, n): hop for n in front}
            seen |= front
    return sorted((s, n, h) for (s, n), h in out.items())


def test_reach_on_random_graphs_with_cycles(spark):
    rng = random.Random(7)
    for _ in range(2):
        pairs = [(rng.choice("abcdef"), rng.choice("abcdef")) for _ in range(9)]
        edges = tables.dimension(spark, pairs, "src string, dst string")
        assert got(graph.reach(edges, 3)) == walked(pairs, 3) == got(graph.reach_recursive(spark, edges, 3))


def test_reach_without_edges(spark):
    assert graph.reach(tables.dimension(spark, [], "src string, dst string"), 4).count() == 0


def test_lineage_through_plan_shapes(spark, sf_dir):
    warehouse.build(spark, sf_dir)
    shapes = {
        "SELECT segment AS nk, nation_name AS segment FROM dim_order": {("segment", "nk"), ("nation_name", "segment")},
        "SELECT upper(segment) AS s, count(*) AS n FROM dim_order GROUP BY segment": {("segment", "s")},
        "SELECT segment AS a FROM dim_order UNION ALL SELECT nation_name FROM dim_order": {("segment", "a"), ("nation_name", "a")},
        "WITH c AS (SELECT total_usd AS t FROM dim_order) SELECT t * 2 AS u FROM c": {("total_usd", "u")},
        "SELECT sum(total_usd) OVER (PARTITION BY segment) AS w FROM dim_order": {("total_usd", "w"), ("segment", "w")},
        "SELECT p FROM dim_order LATERAL VIEW explode(split(order_ref, '-')) x AS p": {("order_ref", "p")},
        "SELECT (SELECT max(total_usd) FROM dim_order) AS m, 1 AS one": {("total_usd", "m")},
        "SELECT DISTINCT status_code AS s FROM dim_order WHERE segment = 'x' LIMIT 3": {("status_code", "s")},
    }
    for sql, expected in shapes.items():
        edges, _ = lineage.model_edges(spark.sql(sql), "shape")
        assert {(c, d) for t, c, _, d in edges if t == "dim_order"} == expected, sql


def test_lineage_that_ends_without_a_name_is_reported(spark):
    spark.createDataFrame([(1,)], "a int").createOrReplaceTempView("nameless")
    spark.table("nameless").selectExpr("a AS b").createOrReplaceTempView("named")
    assert lineage.unresolved(spark, ["nameless", "named"]).filter("table_name = 'nameless'").count() == 1


def test_nearest_origin_and_archived_models(spark, sf_dir):
    warehouse.build(spark, sf_dir)
    found = {(r["regime"], r["feature"]): r for r in governance.protected_reaching(spark).filter("table_name = 'value_features'").collect()}
    assert found["order_desk", "market_code"]["origin_column"] == "segment" and found["order_desk", "market_code"]["hops"] == 1
    assert found["order_desk", "market_code"]["basis"] == "prohibited"
    assert ("order_desk", "account_balance_usd") not in found and found["order_desk_strict", "account_balance_usd"]["basis"] == "conditional"
    assert found["eu_ai_act", "market_code"]["attribute"] is None and found["eu_ai_act", "market_code"]["basis"] == "examine"
    assert {r["version"] for r in governance.violations(spark).filter("model = 'value-classifier'").collect()} == {"2"}


def test_blast_radius_goes_on_from_tables_where_a_column_ends(spark, sf_dir):
    warehouse.build(spark, sf_dir)
    assert got(governance.blast_radius(spark, "stg_region", "region_name"), "name", "kind", "degree", "via", "serving") == [
        ("dim_order", "dataset", 1, None, False), ("value-classifier_1", "model", 3, "dim_order", False), ("value-classifier_2", "model", 3, "dim_order", True),
    ]
    # A column that no other table takes reaches only models of its own table.
    assert governance.blast_radius(spark, "dim_order", "region_name").count() == 0
    assert got(governance.blast_radius(spark, "value_features", "high_value"), "name", "degree", "via") == [("value-classifier_1", 1, "value_features"), ("value-classifier_2", 1, "value_features")]


def test_phantoms_are_found_however_far_up(spark, monkeypatch):
    names = ["value_features", *[f"dim_order_{i}" for i in range(1, 34)], "nowhere"]
    chain = tables.dimension(spark, [(up, down) for down, up in zip(names, names[1:])] + [("value_features", "nowhere")], "src string, dst string")
    monkeypatch.setattr(estate, "table_edges", lambda _: chain)
    monkeypatch.setattr(estate, "datasets", lambda _: tables.dimension(spark, [(n, "mart") for n in names[:-1]], "name string, layer string"))
    assert got(governance.warnings(spark).filter("warning = 'no such table'"), "model", "table_name") == [("value-classifier", "nowhere")]


def test_policy(spark):
    basis = {(r["regime"], r["attribute"]): r["basis"] for r in policy.resolved(spark).collect()}
    assert basis["ecoa", "age"] == "conditional" and basis["canada", "age"] == "prohibited" and ("ecoa", "disability") not in basis
    assert ("ecoa", "age", "continuous") in got(policy.untestable(spark))
    with pytest.raises(KeyError, match="no pack"):
        policy.pack("elsewhere")


#: Fixed values of the census coding, written here apart from the declarations.
GOLDEN_CODES = {
    "race": "1 2 3 6 8 9", "sex": "1 2", "disability": "1 2", "marital_status": "1 2 3 4 5", "citizenship": "1 2 3 4 5", "nativity": "1 2",
}
GOLDEN_REFERENCES = {"race": "1", "sex": "1", "disability": "2", "marital_status": "1", "citizenship": "1", "nativity": "1", "age": None, "place_of_birth": "0", "ancestry": "0"}
#: Attribute: basis under ecoa, employment_us, canada, eu_ai_act.
GOLDEN_MATRIX = """
race prohibited prohibited prohibited prohibited
sex prohibited prohibited prohibited prohibited
disability - prohibited prohibited prohibited
marital_status prohibited examine prohibited examine
citizenship prohibited prohibited prohibited examine
nativity prohibited prohibited prohibited examine
age conditional prohibited prohibited examine
place_of_birth prohibited prohibited prohibited examine
ancestry prohibited prohibited prohibited prohibited
"""


def test_policy_golden_tables(spark):
    found = {}
    for r in policy.codes(spark).collect():
        found.setdefault(r["attribute"], []).append(r["code"])
    assert {a: " ".join(sorted(found[a])) for a in GOLDEN_CODES} == GOLDEN_CODES
    assert {r["attribute"]: r["reference"] for r in policy.attributes(spark).collect() if r["attribute"] in GOLDEN_REFERENCES} == GOLDEN_REFERENCES
    basis = {(r["attribute"], r["regime"]): r["basis"] for r in policy.resolved(spark).collect()}
    for line in GOLDEN_MATRIX.split("\n"):
        if line:
            a, *bases = line.split()
            assert [basis.get((a, r), "-") for r in ("ecoa", "employment_us", "canada", "eu_ai_act")] == bases
    proxies = {r["attribute"] for r in policy.encodings(spark).filter("proxy_for = 'national origin'").collect()}
    assert proxies == {"citizenship", "nativity", "place_of_birth", "ancestry"}
    assert {"ecoa", "canada"} <= set(policy.available()) and policy.pack()["citation"] == "15 U.S.C. 1691"


def test_names_by_aliases(spark):
    asked = ["applicant_sex", "SEX", "rac1p", "place_of_birth_code", "marital_status", "q4_resp", "age", "package", "DIS_FLAG", None, "ancestry_code", "sexual"]
    columns = tables.dimension(spark, [(c,) for c in asked] + [("SEX",)], "column_name string")
    census = policy.encodings(spark).filter(F.col("attribute").isin(*GOLDEN_REFERENCES))
    assert got(identify.by_name(columns, census)) == [
        ("DIS_FLAG", "disability", "exact"), ("SEX", "sex", "exact"), ("age", "age", "exact"), ("ancestry_code", "ancestry", "exact"), ("applicant_sex", "sex", "exact"),
        ("marital_status", "marital_status", "exact"), ("place_of_birth_code", "place_of_birth", "exact"), ("rac1p", "race", "exact"),
    ]
    loose = tables.dimension(spark, [("racetype",), ("disability2x",), ("sexual",)], "column_name string")
    assert got(identify.by_name(loose, census)) == [("disability2x", "disability", "loose"), ("racetype", "race", "loose")]
    assert identify.by_name(columns.limit(0), census).count() == identify.by_name(columns, census.limit(0)).count() == 0


def test_incidents_already_open_are_not_raised(spark, sf_dir, tmp_path):
    warehouse.build(spark, sf_dir)
    planned = incidents.tag_incidents(spark)
    assert incidents.to_raise(planned, planned).count() == 0
    assert incidents.to_raise(planned.unionByName(planned), planned.limit(0)).count() == planned.count()
    path = f"file://{tmp_path}/incidents"
    assert got(incidents.file(planned, path).select("outcome").distinct()) == [("would file",)] and incidents.open_incidents(spark, path).count() == 0
    assert got(incidents.file(planned, path, write=True).select("outcome").distinct()) == [("filed",)]
    assert got(incidents.file(planned, path, write=True).select("outcome").distinct()) == [("already open",)]
    assert incidents.open_incidents(spark, path).count() == planned.count() > incidents.open_incidents(spark, path, "order_desk").count() > 0


def test_families_and_feature_tables(spark, sf_dir):
    found = tables.dimension(spark, [("a",), ("a_3",), ("ab_3",), ("a_b_3",)], "model string")
    assert got(incidents.of_family(found, "a")) == [("a",), ("a_3",)]
    recorded = tables.dimension(spark, [("value-classifier", None), ("value-classifier", "old"), ("unknown", None)], "model string, feature_table string")
    assert got(incidents.with_feature_table(recorded, spark)) == [("unknown", None), ("value-classifier", "old"), ("value-classifier", "value_features")]
    assert got(tables.dimension(spark, [("a \t\n b ",)], "t string").select(names.flat(F.col("t")))) == [("a b",)]


def test_names_resolve_or_say_why_not(spark, sf_dir):
    warehouse.build(spark, sf_dir)
    assert estate.resolved(spark, tables.dimension(spark, [], "target string")).count() == 0
    with pytest.raises(KeyError, match="no such table"):
        governance.columns_of(spark, "nowhere")


def test_recordings_are_measured_compared_and_explained(spark, sf_dir):
    made = catalog.QUERIES["record_exposure"](spark, sf_dir, least=100).collect()
    assert {(r["seq"], r["column_name"]) for r in made} == {(s, c) for s in (1, 2) for c in ("segment", "status_code")} and len(made) == 12
    # The gained column holds the segment; status_code is not among what rebuilds it.
    assert all(r["auc"] == 1.0 for r in made if r["seq"] == 2 and r["column_name"] == "segment") and all(r["auc"] < 0.7 for r in made if r["column_name"] == "status_code")
    assert catalog.QUERIES["record_exposure"](spark, sf_dir, least=10**9).count() == 0
    status = {(r["column_name"], r["grp"]): r["status"] for r in catalog.QUERIES["exposure_compare"](spark, sf_dir, least=100).collect()}
    assert {s for (c, _), s in status.items() if c == "segment"} == {"fires"}
    found = catalog.QUERIES["root_cause"](spark, sf_dir, least=100).collect()
    assert {r["column_name"] for r in found} == {"market_code", "priority_code", "account_balance_usd"} and {r["conclusion"] for r in found} == {"candidates"}
    assert {r["sources"] for r in found if r["column_name"] == "market_code"} == {"raw_customer.c_mktsegment"} and all(r["n_shifts"] >= 4 for r in found)


def test_tables_are_replaced_and_typed(spark, tmp_path):
    name = "replaced_by_test"
    for n in (3, 2):
        tables.replace_table(spark.range(n), name)
        assert spark.table(name).count() == n
    spark.sql(f"DROP TABLE {name}")
    kinds = {"int64": "bigint", "uint8": "bigint", "float64": "double", "double": "double", "bool": "boolean", "object": "string", "date": "string"}
    assert {k: tables.declared_type(k).simpleString() for k in kinds} == kinds
    tables.write_json(spark.range(1), f"file://{tmp_path}/none", write=False)
    assert not (tmp_path / "none").exists()
    assert got(tables.dimension(spark, [("p://u:x@y@h:1/d",), ("h/d",), (None,)], "u string").select(tables.without_credentials(F.col("u")))) == [("h/d",), ("h:1/d",), (None,)]


def test_event_counts_of_a_stream(spark, tmp_path):
    schema = "ts timestamp, event_type string"
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS event_type UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a' UNION ALL SELECT timestamp'2024-01-01 01:10:00', NULL").write.parquet(f"{tmp_path}/in")
    q = recordings.event_counts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("event_counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["event_type"] or "", r["n"]) for r in spark.table("event_counts").collect()) == [("", 1), ("a", 2)]


def test_auc(spark):
    rows = [("a", 1, 3), ("a", 0, 1), ("a", 1, 2), ("a", 0, 2), ("b", 1, 5), ("c", 0, 4), ("c", 1, 4)]
    df = tables.dimension(spark, rows, "g string, y int, score int")
    assert got(measure.auc(df, ["g"], cut=1), "g", "auc", "n_test", "accuracy") == [("a", 0.875, 4, 0.75), ("b", None, 1, 1.0), ("c", 0.5, 2, 0.5)]
    assert measure.auc(df.limit(0), ["g"]).count() == 0


def test_auc_over_many_ranges_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(g, int(rng.random() < 0.4), rng.randrange(900)) for g in "ab" for _ in range(1500)]
    df = tables.dimension(spark, rows, "g string, y int, score int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    found = {r["g"]: r["auc"] for r in measure.auc(df, ["g"]).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in "ab":
        pos, neg = ([s for h, y, s in rows if h == g and y == k] for k in (1, 0))
        assert found[g] == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)), abs=1e-9)


def test_bayes_scores_take_nulls_and_unseen_values(spark):
    rows = [(k, "a" if k % 2 else "b", None if k % 3 == 0 else "x") for k in range(200)] + [(999, "a", "only once")]
    df = tables.dimension(spark, rows, "key int, g string, f string").withColumn("ys", F.array(F.struct(F.lit("all").alias("grp"), (F.col("g") == "a").cast("int").alias("y"))))
    scored = measure.bayes_scores(df, ["f"], [1, 2])
    tested = df.filter(measure.is_test(F.lit(1), F.col("key"))).count()
    assert scored.filter("seed = 1").count() == tested and got(measure.subset_sizes(df)) == [("all", 201)]
    assert measure.bayes_scores(df.limit(0), ["f"], [1]).count() == 0


def test_one_seed_has_no_spread(spark):
    df = tables.dimension(spark, [("g", 1, 0.7, 0.8, 10, 0.4)], "g string, seed int, auc double, accuracy double, n_test long, positive_rate double")
    assert got(measure.over_seeds(df, ["g"])) == [("g", 0.7, 0.0, 0.8, 10, 0.4, 0.6)]
    assert measure.seeds_from(17, 3) == [17, 18, 19] and measure.seeds_from(5, 0) == [5]


def test_compare_published_change(spark):
    schema = "model string, column_name string, grp string, auc double, auc_stdev double"
    was = tables.dimension(spark, [("m", "race", "Black", 0.7294, 0.0073), ("m", "race", "American Indian", 0.7195, 0.0153), ("m", "race", "gone", 0.5, 0.0)], schema)
    now = tables.dimension(spark, [("m", "race", "Black", 0.8182, 0.0029), ("m", "race", "American Indian", 0.7506, 0.0282)], schema)
    status = {r["grp"]: r for r in measure.compare(was, now).collect()}
    assert status["Black"]["status"] == "fires" and abs(status["Black"]["multiples_of_noise"] - 17.41) < 0.2
    assert status["American Indian"]["status"] == "silent" and status["gone"]["status"] == "not_comparable"


def test_group_gates(spark):
    df = tables.dimension(spark, [("a",)] * 3 + [("b",)] * 2 + [("c",)] + [(None,)], "t string")
    assert got(measure.group_gates(df, "t", "a", 5)) == [("b", 5, True), ("c", 4, False)]
    assert got(measure.group_gates(df, "t", "z", 1), "measured") == [(False,)] * 3


def test_identify_rules(spark):
    columns = tables.dimension(spark, [(c,) for c in ("both", "name", "value", "two", "near", "none")], "column_name string")
    named = tables.dimension(spark, [("both", "sex", "exact"), ("name", "age", "exact"), ("two", "race", "loose"), ("near", "race", "loose")], "column_name string, attribute string, strength string")
    values = tables.dimension(spark, [("both", "sex"), ("value", "race"), ("two", "race"), ("two", "sex")], "column_name string, attribute string")
    assert got(identify.verdict(columns, named, values), "column_name", "call", "attribute", "candidates") == [
        ("both", "identified", "sex", None), ("name", "identified", "age", None), ("near", "ambiguous", None, "race"), ("none", "unknown", None, None),
        ("two", "identified", "race", None), ("value", "identified", "race", None),
    ]


def test_profile_leaves_out_nulls_and_wide_columns(spark):
    df = spark.range(10).selectExpr("CAST(id AS string) AS wide", "IF(id < 4, 'a', NULL) AS few", "CAST(NULL AS string) AS empty")
    assert got(identify.profile(df, ["wide", "few", "empty"], most=5)) == [("few", "a", 4, 1.0)]
    assert got(identify.profile(df, ["wide"], most=2)) == [] and got(identify.profile(df.limit(0), ["few"])) == []
    codes = tables.dimension(spark, [("x", "a"), ("x", "b")], "attribute string, code string")
    assert got(identify.by_values(identify.profile(df, ["few"]), codes)) == [("few", "x", 0.5, 0.0)]
    assert identify.by_values(identify.profile(df.limit(0), ["few"]), codes).count() == 0


def test_warehouse_helpers(spark):
    df = tables.dimension(spark, [(1, "b"), (1, "a"), (None, "c")], "k int, v string")
    assert got(warehouse.keep_first(df, ["k"])) == [(1, "a"), (None, "c")]
    assert got(warehouse.key_tests(df, ["k"], "t")) == [("t", "not_null", 1), ("t", "unique", 1)]
    assert warehouse.feature_columns(df, "k", "v") == []


def test_sources(spark, tmp_path):
    (tmp_path / "x.csv").write_text("A,B\n1,\n2,y\n")
    df = tables.load_csv(spark, str(tmp_path / "x.csv"), {"A": "int64", "B": "object"}, 2018)
    assert got(df) == [(1, None, 2018), (2, "y", 2018)] and df.columns == ["a", "b", "survey_year"]
    with pytest.raises(ValueError, match="not a table name"):
        tables.checked_name("x; drop table y")
    path = f"file://{tmp_path}/history"
    assert tables.read_history(spark, path, "a int").count() == 0
    tables.append_history(tables.dimension(spark, [(1,)], "a int"), path)
    tables.append_history(tables.dimension(spark, [(2,)], "a int"), path)
    assert got(tables.read_history(spark, path, "a int")) == [(1,), (2,)]
    assert got(tables.dimension(spark, [("it's \\ x", None, 1.5)], "a string, b int, c double")) == [("it's \\ x", None, 1.5)]


def test_stream_of_recordings(spark, tmp_path):
    incoming, made = f"file://{tmp_path}/in", f"file://{tmp_path}/findings"
    one = [("m", 1, "c", "g", 0.60, 0.001)]
    dimension = lambda rows: tables.dimension(spark, rows, recordings.SCHEMA).coalesce(1).write.mode("append").parquet(incoming)
    dimension(one)
    for rows in (None, [("m", 2, "c", "g", 0.70, 0.001)]):
        if rows:
            dimension(rows)
        q = recordings.watch(spark, incoming, f"file://{tmp_path}/history", made, f"file://{tmp_path}/at")
        q.processAllAvailable()
        q.stop()
    assert got(spark.read.parquet(made), "grp", "delta", "status") == [("g", 0.1, "fires")]


def test_stream_compares_within_a_batch_with_an_older_history_and_after_a_rerun(spark, tmp_path):
    incoming, history, made = f"file://{tmp_path}/in", f"file://{tmp_path}/history", f"file://{tmp_path}/findings"
    put = lambda rows, at: tables.dimension(spark, [("m", seq, "c", "g", auc, 0.001) for seq, auc in rows], recordings.SCHEMA).coalesce(1).write.mode("append").parquet(at)

    def run():
        q = recordings.watch(spark, incoming, history, made, f"file://{tmp_path}/at")
        q.processAllAvailable()
        q.stop()
        return got(spark.read.parquet(made), "seq", "delta")

    put([(1, 0.5)], history)
    put([(2, 0.6), (3, 0.7), (4, 0.6), (6, 0.6)], incoming)
    assert run() == [(2, 0.1), (3, 0.1), (4, -0.1)]
    # The next batch has written its history before it failed; one of its rows is late.
    put([(5, 0.8), (7, 0.65)], f"{history}/batch=1")
    put([(5, 0.8), (7, 0.65)], incoming)
    assert run() == [(2, 0.1), (3, 0.1), (4, -0.1), (5, 0.2), (7, 0.05)]


def test_serving_version_is_the_newest_by_number(spark):
    assert estate.production(spark, "value-classifier").first()["version"] == "2"
    assert estate.production(spark, "size-classifier").count() == 0
    assert got(estate.serving(spark).select(F.col("stage")).distinct()) == [("Production",), ("Staging",)]
