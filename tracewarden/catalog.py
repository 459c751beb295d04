"""The reference-side queries by name, and DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names
from .operators import agreement, boosting, columns, estate, governance, graph, identify, incidents, measure, paths, policy, warehouse
from .sources import tables, versions
from .sources.tables import dimension, parquet, select_available, written
from .streaming import shifts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SEEDS = measure.seeds_from(17, 3)
FEATURES = ["status_code", "priority_code", "origin_name", "proxy"]
REFERENCE = "BUILDING"
#: Boosting rounds, as the reference has them.
ROUNDS = 150


def query(f):
    def run(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
        warehouse.build(spark, sf_dir)
        return f(spark, **options)

    QUERIES[f.__name__] = run
    return f


# Warehouse


@query
def stg_order_projection(spark):
    return spark.table("stg_order")


@query
def dim_order_left_joins(spark):
    return spark.table("dim_order")


@query
def value_features_label(spark):
    return spark.table("value_features")


@query
def size_features_between(spark):
    return spark.table("size_features")


@query
def key_uniqueness_tests(spark):
    one = warehouse.key_tests(spark.table("dim_order"), ["order_id"], "dim_order")
    return one.unionByName(warehouse.key_tests(spark.table("raw_lineitem"), ["l_orderkey", "l_linenumber"], "raw_lineitem"))


@query
def dedupe_keep_first(spark):
    return warehouse.keep_first(spark.table("raw_lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), ["l_orderkey", "l_linenumber"])


@query
def missing_column_select(spark):
    found, lacking = select_available(spark.table("raw_customer"), ["c_custkey", "c_fax", "c_mktsegment"])
    return found.withColumn("lacking", F.lit(",".join(lacking)))


@query
def inline_dimension(spark):
    rows = [("AUTOMOBILE", "goods"), ("BUILDING", "trade"), ("MACHINERY", "trade")]
    kinds = dimension(spark, rows, "segment string, kind string")
    return spark.table("stg_customer").join(F.broadcast(kinds), "segment", "left").groupBy(F.coalesce("kind", F.lit("Unknown")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query
def dynamic_feature_list(spark):
    found = warehouse.feature_columns(spark.table("value_features"), "order_id", "high_value")
    return dimension(spark, list(enumerate(found, 1)), "position int, feature string")


@query
def serving_version(spark):
    return estate.production(spark, "value-classifier")


# Lineage and graph


@query
def column_edges(spark):
    return estate.edges(spark)


@query
def column_ancestry_min_hops(spark):
    return governance.ancestry(spark)


@query
def entity_walk_up(spark):
    return graph.reach(estate.flipped(estate.table_edges(spark)), 8)


@query
def entity_walk_down(spark):
    return graph.reach(estate.table_edges(spark), 8)


@query
def walk_agreement(spark):
    edges = estate.flipped(estate.table_edges(spark))
    one, two = graph.reach(edges, 8), graph.reach_recursive(spark, edges, 8)
    counts = one.agg(F.count(F.lit(1)).alias("loop_rows")).join(two.agg(F.count(F.lit(1)).alias("recursive_rows")))
    return counts.join(graph.difference(one, two).agg(F.count(F.lit(1)).alias("differences")))


@query
def catalog_search(spark):
    return estate.search(spark, "order", ["dataset"]).select("type", "name").unionByName(estate.search(spark, "*", ["mlModel"]).select("type", "name"))


@query
def name_resolution(spark):
    asked = ["dim_order", "size", "stg_", "nowhere", "urn:li:dataset:(urn:li:dataPlatform:spark,stg_order,PROD)"]
    return estate.resolved(spark, dimension(spark, [(x,) for x in asked], "target string"))


@query
def entities_by_name(spark):
    return estate.entities(spark).groupBy("name").agg(F.concat_ws(",", F.sort_array(F.collect_set("urn"))).alias("urns"))


@query
def neighbours(spark):
    return estate.neighbours(spark)


@query
def column_parents(spark):
    return estate.edges(spark).filter("down_table = 'dim_order'").select("down_column", "up_table", "up_column")


@query
def training_datasets(spark):
    return estate.training_datasets(spark)


@query
def lineage_walk(spark):
    """Three hops down from one table, nearest first, as an agent reads it; with what is open on each node."""
    seeds = dimension(spark, [("stg_customer",)], "seed string")
    walked = graph.reach(estate.table_edges(spark), 3, seeds).unionByName(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hops")))
    return incidents.health(walked, incidents.tag_incidents(spark).filter("regime = 'order_desk'")).orderBy(F.coalesce("hops", F.lit(99)), "node")


@query
def column_list(spark):
    return governance.columns_of(spark, "dim_order")


@query
def dataset_source(spark):
    """Feature tables as declared sources: an address without credentials."""
    at = tables.without_credentials(F.lit("warehouse://user:p@ss@store:5433/orders"))
    return estate.models(spark).filter("feature_table IS NOT NULL").select(F.concat(F.lit("warehouse://"), at, F.lit("/"), "feature_table").alias("uri")).distinct()


@query
def foreign_entities(spark):
    """Tables that edges name outside this estate's own prefixes."""
    every = estate.edges(spark).select(F.col("up_table").alias("name")).union(estate.edges(spark).select("down_table")).distinct()
    return every.filter(~F.col("name").rlike("^(raw|stg|dim)_|_features$"))


@query
def materialized_marts(spark):
    """Rows of the marts after saving and reading them back."""
    out = None
    for name, place in warehouse.materialize(spark, tables.fresh_folder(spark, "marts")).items():
        one = spark.read.parquet(place).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def type_counts(spark):
    return estate.entities(spark).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query
def urn_parse(spark):
    return estate.entities(spark).select(names.urn_name(F.col("urn")).alias("name"), names.urn_platform(F.col("urn")).alias("platform"))


@query
def entity_type_from_urn(spark):
    return estate.entities(spark).select("name", names.entity_type(F.col("urn")).alias("entity_type"))


@query
def chain_check(spark):
    chain = dimension(spark, [("raw_customer", 0), ("stg_customer", 1), ("dim_order", 2), ("value_features", 3)], "name string, place int")
    steps = chain.alias("a").join(chain.alias("b"), F.expr("b.place = a.place + 1")).select(F.col("a.name").alias("src"), F.col("b.name").alias("dst"))
    return steps.join(estate.table_edges(spark).withColumn("found", F.lit(True)), ["src", "dst"], "left").select("src", "dst", F.coalesce("found", F.lit(False)).alias("found"))


# Policy and findings


@query
def tag_union(spark):
    return estate.tags(spark).groupBy("table_name", "column_name").agg(F.concat_ws(",", F.sort_array(F.collect_set("tag"))).alias("tags"))


@query
def policy_resolved(spark):
    return policy.resolved(spark)


@query
def policy_untestable(spark):
    return policy.untestable(spark)


@query
def regime_matrix(spark):
    return policy.resolved(spark).groupBy("attribute").pivot("regime", ["ecoa", "employment_us", "canada", "eu_ai_act"]).agg(F.first("basis"))


@query
def protected_reaching(spark):
    return governance.protected_reaching(spark)


@query
def deployed_violations(spark):
    return governance.violations(spark)


@query
def phantom_tables(spark):
    return governance.warnings(spark)


@query
def violation_report(spark):
    return governance.report(spark)


@query
def policy_by_column(spark):
    return policy.by_column(spark)


@query
def attribute_aliases(spark):
    return identify.aliases(policy.encodings(spark)).distinct()


@query
def violation_counts(spark):
    return governance.violations(spark).groupBy("regime", "model", "basis").agg(F.count(F.lit(1)).alias("n"))


@query
def blocking_gate(spark):
    counts = governance.violations(spark).groupBy("regime").agg(F.sum(F.when(F.col("basis") == "prohibited", 1).otherwise(0)).alias("blocking"))
    return counts.withColumn("blocked", F.col("blocking") > 0)


@query
def blast_radius(spark):
    return governance.blast_radius(spark, "stg_customer", "segment")


@query
def blast_verdict(spark):
    hit = governance.blast_radius(spark, "dim_order", "segment").filter("serving").agg(F.count(F.lit(1)).alias("serving_models"))
    held = governance.protected_reaching(spark).filter("table_name = 'dim_order' AND feature = 'segment'").select("regime", "basis")
    return held.join(hit).select("regime", "basis", "serving_models", ((F.col("basis") == "prohibited") & (F.col("serving_models") > 0)).alias("blocks"))


@query
def root_cause_origin(spark):
    return governance.origins(spark)


@query
def provenance_chain(spark):
    return governance.provenance(spark, "value_features", "market_code")


@query
def incident_plan(spark):
    return incidents.tag_incidents(spark)


@query
def incident_dedupe(spark):
    planned = incidents.tag_incidents(spark)
    return incidents.to_raise(planned, planned.filter("regime = 'order_desk'").select("resource", "title")).groupBy("priority").agg(F.count(F.lit(1)).alias("n"))


def _deltas(spark):
    compared = measure.compare(*_sides(spark)).join(dimension(spark, [("value-classifier", None), ("size-classifier", "size_features")], "model string, feature_table string"), "model")
    return incidents.delta_incidents(spark, compared, "order_desk")


@query
def incident_union(spark):
    """Tag findings and moved measurements together, of one model family."""
    return incidents.of_family(incidents.tag_incidents(spark).unionByName(_deltas(spark)), "value-classifier")


@query
def incident_filing(spark):
    """Filed once for one regime, then planned again for all without writing."""
    path = tables.fresh_folder(spark, "incidents")
    planned = incidents.tag_incidents(spark)
    incidents.file(planned.filter("regime = 'order_desk'"), path, write=True)
    return incidents.file(planned, path)


@query
def incidents_open(spark):
    """What one regime has open, read back after everything was filed."""
    path = tables.fresh_folder(spark, "incidents")
    incidents.file(incidents.tag_incidents(spark).unionByName(_deltas(spark)), path, write=True)
    return incidents.open_incidents(spark, path, "order_desk").select("kind", "title", "resource", "priority")


@query
def document_id(spark):
    made = F.concat(F.lit("2024-01-0"), F.col("seq").cast("string"))
    return estate.recordings(spark).select("model", "seq", names.document_id(F.col("model"), F.col("version"), F.lit("order_desk"), made).alias("document_id"))


# Identification


def _profiled(spark):
    frame = spark.table("dim_order").select("segment", "status_code", "nation_name", "priority_code", "order_ref")
    return identify.profile(frame, frame.columns)


def _columns(spark):
    listed = ["segment", "status_code", "nation_name", "priority_code", "order_ref", "account_balance", "mystery", "applicant_sex", "RAC1P", "place_of_birth_code", "marketplace"]
    return dimension(spark, [(n,) for n in listed], "column_name string")


@query
def column_profile(spark):
    return _profiled(spark)


@query
def code_set_match(spark):
    return identify.by_values(_profiled(spark), policy.codes(spark))


@query
def name_match(spark):
    return identify.by_name(_columns(spark), policy.encodings(spark))


@query
def identify_verdict(spark):
    return identify.verdict(_columns(spark), identify.by_name(_columns(spark), policy.encodings(spark)), identify.by_values(_profiled(spark), policy.codes(spark)))


# Measurement


def _ys(column: str, reference: str, groups: list[str]):
    """The groups that a row takes part in: the reference's rows in all of them, the others in their own."""
    zero = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(0).alias("y")) for g in groups])
    own = F.array(F.struct(F.col(column).alias("grp"), F.lit(1).alias("y")))
    return F.when(F.col(column) == reference, zero).when(F.col(column).isin(*groups), own)


def _orders(spark):
    """Orders with their segment, plain features and a planted `proxy`, which shows the segment of most of them."""
    dim = spark.table("dim_order").select(F.col("order_id").alias("key"), "segment", "status_code", "priority_code", F.col("nation_name").alias("origin_name"))
    return dim.withColumn("proxy", F.when(F.substring(F.md5(F.concat(F.lit("p:"), F.col("key").cast("string"))), 1, 1) < "c", F.col("segment")).otherwise("x"))


def _frame(spark):
    codes = [c for c in policy.declared()["segment"]["categories"] if c != REFERENCE]
    return _orders(spark).withColumn("ys", _ys("segment", REFERENCE, codes)).filter("ys IS NOT NULL")


@query
def group_subset_gates(spark):
    return measure.group_gates(spark.table("dim_order"), "segment", REFERENCE)


@query
def reconstruct_bayes(spark):
    frame = _frame(spark)
    found = measure.over_seeds(measure.auc(measure.bayes_scores(frame, FEATURES, SEEDS), ["grp", "seed"]), ["grp"])
    return found.join(measure.subset_sizes(frame), "grp")


@query
def single_feature_auc(spark):
    return measure.auc(measure.bayes_scores(_frame(spark), FEATURES, SEEDS[:1], alone=True), ["grp", "feature"]).orderBy("grp", F.desc("auc"))


@query
def worst_group(spark):
    aucs = measure.auc(measure.bayes_scores(_frame(spark), FEATURES, SEEDS[:1]), ["grp"])
    return aucs.agg(F.max_by("grp", F.struct("auc", "grp")).alias("grp"), F.max("auc").alias("auc"))


def _screened(spark):
    """Rows with a segment; y says whether it is the reference, as the reference's own screen asks."""
    y = F.array(F.struct(F.lit("all").alias("grp"), (F.col("segment") == REFERENCE).cast("int").alias("y")))
    return measure.screen(_orders(spark).dropna(subset=["segment"]).withColumn("ys", y), ["status_code", "priority_code"], estate.HYPOTHESES, SEEDS)


@query
def proxy_screen(spark):
    return _screened(spark)


@query
def screen_sink(spark):
    """The screen's results as JSON, read back."""
    path = tables.fresh_folder(spark, "screen")
    tables.write_json(_screened(spark), path)
    return spark.read.schema("hypothesis string, tested boolean, why_not string, fires boolean").json(path)


# Recordings


def _sides(spark):
    last = measure.last_two(estate.recordings(spark)).select("model", "seq", "back")
    both = estate.measurements(spark).join(last, ["model", "seq"])
    return both.filter("back = 1"), both.filter("back = 0").join(last.filter("back = 1").select("model"), "model", "left_semi")


@query
def last_two_recordings(spark):
    return measure.last_two(estate.recordings(spark)).select("model", "seq", "version", "back")


@query
def recording_compare(spark):
    return measure.compare(*_sides(spark))


@query
def silent_measurements(spark):
    return measure.compare(*_sides(spark)).filter("status <> 'fires'").select("model", "column_name", "grp", "status")


@query
def features_gained_lost(spark):
    last = measure.last_two(estate.recordings(spark))
    lists = last.groupBy("model").agg(F.max(F.when(F.col("back") == 0, F.col("features"))).alias("now"), F.max(F.when(F.col("back") == 1, F.col("features"))).alias("was")).filter("was IS NOT NULL")
    split = lambda c: F.split(c, ",")
    return lists.select("model", F.concat_ws(",", F.array_except(split("now"), split("was"))).alias("gained"), F.concat_ws(",", F.array_except(split("was"), split("now"))).alias("lost"))


@query
def recorded_models(spark):
    return estate.recordings(spark).select("model").distinct()


def _recorded(spark, least: int = measure.LEAST_ROWS):
    """A history of the serving model: measured with the features of its version 1, then of version 2; read back."""
    path = tables.fresh_folder(spark, "recordings")
    held = {r["version"]: r for r in estate.models(spark).filter("model = 'value-classifier'").collect()}
    tables.append_history(_exposure(spark, _serving_frame(spark), [(1, held["1"]), (2, held["2"])], least), path)
    return tables.read_history(spark, path, EXPOSURE)


EXPOSURE = "model string, seq int, version string, feature_table string, features string, column_name string, grp string, against string, auc double, auc_stdev double, n_rows long"


def _exposure(spark, serving, versions, least: int):
    """Recordings of versions (seq, model row): every testable attribute and group that has rows enough, the attribute itself
    never among the features. Values of all attributes and versions are counted in one pass and scored in another."""
    frame, _, tests = serving
    numeric = {c for c, kind in frame.dtypes if kind not in ("string", "boolean")}
    listed = {seq: [c for c in row["features"].split(",") if c in frame.columns] for seq, row in versions}
    every = list(dict.fromkeys(c for features in listed.values() for c in features))
    at = boosting.cuts(frame, [c for c in every if c in numeric])
    used = [boosting.bin_of(F.col(c), at[c]).cast("string").alias(c) if c in numeric else F.col(c) for c in every]
    against = list(enumerate(sorted({(c, ref) for c, ref, _ in tests})))
    if not against:
        return spark.createDataFrame([], EXPOSURE)
    # Groups and sets of features carry the number of the attribute that they belong to.
    name = lambda g, k: F.transform(g, lambda x: F.struct(F.concat(F.lit(f"{k}|"), x["grp"]).alias("grp"), x["y"].alias("y")))
    ys = [F.coalesce(name(_ys(f"target_{c}", ref, [g for t, _, g in tests if t == c]), k), F.array().cast("array<struct<grp:string,y:int>>")) for k, (c, ref) in against]
    rows = frame.select("key", *used, *{f"target_{c}": F.col(f"target_{c}") for _, (c, _) in against}.values()).withColumn("ys", F.concat(*ys)).filter("size(ys) > 0")
    sets = [(f"{seq}|{k}", [f for f in features if f != c]) for seq, features in listed.items() for k, (c, _) in against]
    same = F.substring_index("feature_set", "|", -1) == F.substring_index("grp", "|", 1)
    scored = measure.bayes_scores(rows, every, SEEDS, sets=sets, of=same)
    found = measure.over_seeds(measure.auc(scored, ["grp", "feature_set", "seed"]), ["grp", "feature_set"])
    found = found.join(measure.subset_sizes(rows), "grp").filter(F.col("n_rows") >= least)
    heads = dimension(spark, [(row["model"], seq, row["version"], row["feature_table"], row["features"]) for seq, row in versions], "model string, seq int, version string, feature_table string, features string")
    refs = dimension(spark, [(k, c, ref) for k, (c, ref) in against], "k int, column_name string, against string")
    found = found.select(F.substring_index("feature_set", "|", 1).cast("int").alias("seq"), F.substring_index("grp", "|", 1).cast("int").alias("k"), F.expr("substring(grp, instr(grp, '|') + 1)").alias("grp"), "auc", "auc_stdev", "n_rows")
    found = found.join(F.broadcast(heads), "seq").join(F.broadcast(refs), "k")
    return found.select([f.split()[0] for f in EXPOSURE.split(", ")])


@query
def record_exposure(spark, **options):
    return _recorded(spark, **options)


def _compared(history):
    last = measure.last_two(history.select("model", "seq").distinct()).select("model", "seq", "back")
    both = history.join(last, ["model", "seq"])
    return measure.compare(both.filter("back = 1"), both.filter("back = 0"))


@query
def exposure_compare(spark, **options):
    """The recordings that record_exposure made, held against each other, largest change first."""
    return _compared(_recorded(spark, **options)).orderBy(F.desc(F.abs("delta")))


@query
def root_cause(spark, **options):
    """Why a model moved: each column that its newest version gained, with its origin and what regimes say of it.

    Several columns that came together are candidates, never ranked.
    """
    history = _recorded(spark, **options)
    shifts = _compared(history).filter("status = 'fires'").groupBy("model").agg(F.count(F.lit(1)).alias("n_shifts"))
    last = measure.last_two(history.select("model", "seq", "features", "feature_table").distinct())
    lists = last.groupBy("model").agg(*[F.max(F.when(F.col("back") == b, F.split("features", ","))).alias(n) for b, n in ((0, "now"), (1, "was"))], F.max(F.when(F.col("back") == 0, F.col("feature_table"))).alias("table_name"))
    gained = lists.filter("was IS NOT NULL").select("model", "table_name", F.explode(F.array_except("now", "was")).alias("column_name"), F.size(F.array_except("now", "was")).alias("k"))
    found = gained.join(governance.origins(spark), ["table_name", "column_name"], "left")
    said = governance.protected_reaching(spark).select("table_name", F.col("feature").alias("column_name"), "regime", "attribute", "basis")
    found = found.join(said, ["table_name", "column_name"], "left").join(shifts, "model", "left")
    verdict = F.when(F.col("k") == 1, "cause").otherwise("candidates")
    return found.select("model", "column_name", "hops", "sources", "renamed", "regime", "attribute", "basis", F.coalesce("n_shifts", F.lit(0)).alias("n_shifts"), verdict.alias("conclusion"))


def _serving_frame(spark, model="value-classifier"):
    """(frame, features, tests): training rows of the serving version with `target_<column>` of every attribute that a
    regime restricts and that can be tested, and (column, reference, group) for each group that occurs."""
    version = estate.production(spark, model).first()
    features = [c for c in version["features"].split(",") if c in spark.table(version["feature_table"]).columns]
    held = policy.resolved(spark).join(policy.untestable(spark), ["regime", "attribute"], "left_anti").select("attribute", "column", "reference").distinct()
    dim = spark.table("dim_order")
    held = sorted(tuple(r) for r in held.collect() if r["column"] in dim.columns)
    columns = sorted({c for _, c, _ in held})
    answers = dim.select("order_id", *[F.col(c).cast("string").alias(f"target_{c}") for c in columns])
    frame = written(spark.table(version["feature_table"]).select("order_id", *features).join(answers, "order_id").withColumnRenamed("order_id", "key"))
    codes = {(c, str(code)) for a, c, _ in held for code in policy.declared()[a]["categories"]}
    found = frame.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(f"target_{c}"))])).alias("c", "v")).distinct()
    found = found.join(dimension(spark, sorted(codes), "c string, v string"), ["c", "v"], "left_semi")
    present = {tuple(r) for r in found.collect()}
    tests = [(c, ref, v) for _, c, ref in held for at, v in sorted(present) if at == c and v != ref and (c, ref) in present]
    return frame, features, tests


@query
def reconstruct_gbt(spark, rounds=ROUNDS, seeds=SEEDS, most=None):
    """The question put to boosted trees: every testable attribute, group and seed, highest first, on stratified splits.

    Only the target itself is left out of the serving version's features, not columns that hold it under other names.
    """
    frame, features, tests = _serving_frame(spark)
    every = None
    for column, reference in sorted({(c, ref) for c, ref, _ in tests}):
        classes, used = [reference, *[g for c, _, g in tests if c == column]], [f for f in features if f != column]
        rows = measure.stratified(frame.filter(F.col(f"target_{column}").isin(*classes)), f"target_{column}", seeds)
        code = F.array_position(F.array(*map(F.lit, classes)), F.col(f"target_{column}")).cast("int") - 1
        made, ordered = boosting.cells(rows, used, code, F.col("tests"))
        found = boosting.scores(made, ordered, classes, seeds, rounds, most=most).withColumn("column_name", F.lit(column))
        every = found if every is None else every.unionByName(found)
    by = ["column_name", "grp"]
    return measure.over_seeds(measure.auc(every, [*by, "seed"], weight="n"), by).orderBy(F.desc("auc"), *by)


@query
def stratified_split(spark):
    """Which orders one seed holds out: a quarter of each segment to the row."""
    rows = measure.stratified(spark.table("dim_order").select("order_id", "segment"), "segment", SEEDS[:1], key="order_id")
    return rows.select("order_id", "segment", F.col("tests")[0].alias("held_out"))


@query
def learned_cuts(spark):
    """Where 62 cuts divide the numbers of orders, line items and customers into equal parts."""
    out = []
    for table, columns in (("dim_order", ["total_usd", "account_balance_usd"]), ("raw_lineitem", ["l_quantity", "l_extendedprice", "l_discount"])):
        found = boosting.cuts(spark.table(table), columns)
        out += [(table, c, k, float(v)) for c in columns for k, v in enumerate(found[c], 1)]
    return dimension(spark, out, "table_name string, column_name string, place int, cut double")


def _over_files(name):
    """Queries that read one table straight from its file."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(parquet(spark, sf_dir, name))
        return f

    return add


@_over_files("events")
def event_windows(events):
    """Hourly counts by type; the batch twin of the stream in streaming.recordings."""
    return events.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def event_shifts(spark, sf_dir):
    """Daily means of each user held against the day before, from state that a stream over events keeps, and users that fell
    silent; a stream started for this reads what there is and ends."""
    return shifts.drained(spark, f"{sf_dir}/events.parquet")


QUERIES["event_shifts"] = event_shifts


@_over_files("lineitem")
def table_agreement(lines):
    """Line items against a second version of them, in which the first order's taxes changed, the last order's lines came
    twice and those of an order between were lost: which rows are not held equally often."""
    first, last = lines.agg(F.min("l_orderkey"), F.max("l_orderkey")).first()
    if first is None:
        return agreement.differing(lines, lines, "l_orderkey")
    key = F.col("l_orderkey")
    changed = lines.filter(key != (first + last) // 2).withColumn("l_tax", F.when(key == first, F.col("l_tax") + 1).otherwise(F.col("l_tax")))
    return agreement.differing(lines, changed.unionAll(changed.filter(key == last)), "l_orderkey")


# Walks over what pages point at


@_over_files("pages")
def page_link_degrees(pages):
    """How many pages point at each target."""
    return paths.page_links(pages).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


def _first(pages):
    return dimension(pages.sparkSession, [(f"page:{pages.agg(F.min('page_id')).first()[0]}", 0)], "seed string, bit int")


@_over_files("pages")
def page_walk(pages):
    """Everything within eight hops of the first page, through targets that pages share, with the least number of hops."""
    return paths.reach_together(paths.both_ways(paths.page_links(pages)), _first(pages), 8).filter("hops > 0").select("node", "hops")


@_over_files("pages")
def page_walk_of_many(pages):
    """How many of the first 62 pages reach each node at each number of hops, all walked at once."""
    ids = sorted(r["page_id"] for r in pages.select("page_id").distinct().orderBy("page_id").limit(paths.SEEDS).collect())
    seeds = dimension(pages.sparkSession, [(f"page:{i}", k) for k, i in enumerate(ids)], "seed string, bit int")
    found = paths.reach_together(paths.both_ways(paths.page_links(pages)), seeds, 8)
    return found.filter("hops > 0").select("node", "hops", F.bit_count("seeds").cast("long").alias("n_seeds"))


@_over_files("pages")
def page_paths(pages):
    """All shortest paths from the first page to the first of the pages that are furthest from it, within eight hops."""
    edges, seeds = paths.both_ways(paths.page_links(pages)), _first(pages)
    start = seeds.first()["seed"]
    walked = paths.reach_together(edges, seeds, 8).filter("node LIKE 'page:%'").select(F.lit(start).alias("seed"), "node", "hops")
    end = paths.furthest(walked).agg(F.min_by("node", F.substring("node", 6, 20).cast("long")).alias("node")).first()["node"]
    steps, length = paths.shortest_edges(edges, start, end or start)
    return paths.all_paths(steps, length, start).select(F.concat_ws(" ", "path").alias("path"), F.lit(length).alias("hops"))


# Every column of every given table


#: The given tables.
GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _over_given(f):
    QUERIES[f.__name__] = lambda spark, sf_dir, **options: f({t: parquet(spark, sf_dir, t) for t in GIVEN}, **options)
    return f


def _declared_codes():
    return {a: list(d.get("categories") or {}) for a, d in policy.declared().items()}


@_over_given
def codes_every_column(given):
    """Which declared attributes' codes each column of each given table holds."""
    return columns.coded(given, _declared_codes())


@_over_given
def identify_every_column(given):
    """What names and values together say of each column of each given table."""
    spark = given["region"].sparkSession
    listed = dimension(spark, [(t, c, f"{t}.{c}") for t, df in given.items() for c in columns.scalar_columns(df)], "table_name string, name string, column_name string")
    named = identify.by_name(listed.select(F.col("name").alias("column_name")).distinct(), policy.encodings(spark)).withColumnRenamed("column_name", "name")
    named = listed.join(named, "name").select("column_name", "attribute", "strength")
    held = columns.coded(given, _declared_codes()).select(F.concat_ws(".", "table_name", "column_name").alias("column_name"), "attribute")
    said = identify.verdict(listed, named, held).withColumnRenamed("column_name", "full_name")
    return listed.withColumnRenamed("column_name", "full_name").join(said, "full_name").select("table_name", F.col("name").alias("column_name"), "call", "attribute", "candidates")


@_over_given
def top_values_every_column(given):
    """The 601 commonest values of each column of each given table, with counts."""
    return columns.top_values(given)


@_over_given
def types_every_column(given):
    """Each given table written as text, and the types that its text has."""
    return columns.text_types({t: df.select(*[columns.text(df, c).alias(c) for c in columns.scalar_columns(df)]) for t, df in given.items()})


def tables_loaded_together(spark, sf_dir):
    """Orders and their lines loaded as one version, then without the filled orders as a second one: what each version holds."""
    path = tables.fresh_folder(spark, "versions")
    orders, lines = (parquet(spark, sf_dir, t) for t in ("orders", "lineitem"))
    versions.load_together(spark, path, {"orders": orders, "lineitem": lines})
    kept = versions.read_together(spark, path)["orders"].filter("o_orderstatus IS DISTINCT FROM 'F'")
    versions.load_together(spark, path, {"orders": kept, "lineitem": lines.join(kept, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")})
    every = None
    for number in versions.numbers(spark, path):
        bound = versions.read_together(spark, path, number)
        per = bound["lineitem"].groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"))
        both = bound["orders"].select("o_orderkey", F.lit(True).alias("known")).join(per, "o_orderkey", "full")
        counts = [F.count("known").alias("n_orders"), F.coalesce(F.sum("lines"), F.lit(0)).alias("n_lines"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("lines"))), F.lit(0)).alias("n_orphans")]
        row = both.agg(*counts).select(F.lit(number).alias("version"), "n_orders", "n_lines", "n_orphans")
        every = row if every is None else every.unionAll(row)
    return every


QUERIES["tables_loaded_together"] = tables_loaded_together
