"""DuckDB SQL for the queries of catalog.py, written apart from them; edges are listed by hand, not harvested."""

from __future__ import annotations

from .operators import estate, policy

#: down table < up table: down column=up column ...
HAND_EDGES = """
stg_order < raw_orders: order_id=o_orderkey customer_id=o_custkey order_ref=o_custkey order_ref=o_orderkey status_code=o_orderstatus priority_code=o_orderpriority total_usd=o_totalprice ordered_at=o_orderdate
stg_order < legacy_feed: order_ref=ref
stg_customer < raw_customer: customer_id=c_custkey customer_name=c_name nation_id=c_nationkey account_balance_usd=c_acctbal segment=c_mktsegment
stg_nation < raw_nation: nation_id=n_nationkey nation_name=n_name region_id=n_regionkey
stg_region < raw_region: region_id=r_regionkey region_name=r_name
dim_order < stg_order: order_id=order_id order_ref=order_ref customer_id=customer_id status_code=status_code priority_code=priority_code total_usd=total_usd ordered_at=ordered_at
dim_order < stg_customer: segment=segment account_balance_usd=account_balance_usd
dim_order < stg_nation: nation_name=nation_name
dim_order < stg_region: region_name=region_name
value_features < dim_order: order_id=order_id market_code=segment origin_name=nation_name status_code=status_code priority_code=priority_code account_balance_usd=account_balance_usd high_value=total_usd
size_features < raw_part: part_id=p_partkey brand=p_brand part_type=p_type part_size=p_size is_dear=p_retailprice
"""


def values(rows) -> str:
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


def hand_edges() -> list[tuple]:
    out = []
    for line in HAND_EDGES.split("\n"):
        if line:
            tables, pairs = line.split(": ")
            down, up = tables.split(" < ")
            out += [(up, p.split("=")[1], down, p.split("=")[0]) for p in pairs.split()]
    return out


#: The given tables and their columns of single values; behind a column: i whole number, f fraction, t text, s time.
GIVEN = """
region r_regionkey:i r_name:t
nation n_nationkey:i n_name:t n_regionkey:i
customer c_custkey:i c_name:t c_nationkey:i c_acctbal:f c_mktsegment:t
supplier s_suppkey:i s_name:t s_nationkey:i s_acctbal:f
part p_partkey:i p_name:t p_brand:t p_type:t p_size:i p_retailprice:f
orders o_orderkey:i o_custkey:i o_orderstatus:t o_totalprice:f o_orderdate:s o_orderpriority:t
lineitem l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:f l_extendedprice:f l_discount:f l_tax:f l_returnflag:t l_linestatus:t l_shipdate:s
events event_id:i ts:s user_id:i event_type:t value:f props:t
documents doc_id:i text:t lang:t source:t n_chars:i
embeddings vec_id:i label:i
pages page_id:i url:t html:t
benchmark item_id:i text:t
labels doc_id:i quality:i toxic:i
conversations conv_id:i turn:i role:t text:t
"""


def given_cells() -> str:
    """(table_name, column_name, number, value, exact): every value of every given table as text; fractions with six places."""
    out = []
    for line in GIVEN.strip().split("\n"):
        table, *columns = line.split()
        for column, kind in (c.split(":") for c in columns):
            value = f'"{column}"::DECIMAL(38, 6)::VARCHAR' if kind == "f" else f'"{column}"::VARCHAR'
            out.append(f"SELECT '{table}' AS table_name, '{column}' AS column_name, {kind in 'if'} AS number, {value} AS value FROM {table} WHERE \"{column}\" IS NOT NULL")
    return " UNION ALL ".join(out)


_CODES = [(a, str(c)) for a, d in policy.declared().items() for c in (d.get("categories") or {})]
_ATTRIBUTES = [(a, d["column"], d["kind"], None if d.get("reference") is None else str(d["reference"]), len(d.get("categories") or {})) for a, d in policy.declared().items()]
_RESTRICTED = [(r, a, x.get("basis", "prohibited"), x.get("citation", p["citation"])) for r, p in policy.packs().items() for a, x in p["restricted"].items()]
_SCOPE = [(r, t) for r, p in policy.packs().items() for t in p["protected_tags"]]
_MEASURES = [(m, s, *x) for m, s, _, _, xs in estate.RECORDINGS for x in xs]

GRAPH = f"""
ce(up_table, up_column, down_table, down_column) AS {values(hand_edges())},
cw(st, sc, t, c, hops) AS (
  SELECT DISTINCT down_table, down_column, down_table, down_column, 0 FROM ce
  UNION ALL SELECT st, sc, up_table, up_column, hops + 1 FROM cw JOIN ce ON t = down_table AND c = down_column WHERE hops < 12),
anc AS (SELECT st AS table_name, sc AS column_name, t AS up_table, c AS up_column, min(hops)::INT AS hops FROM cw GROUP BY ALL),
models(model, version, stage, feature_table, features, label) AS {values(estate.MODELS)},
te AS (SELECT DISTINCT up_table AS src, down_table AS dst FROM ce UNION SELECT feature_table, model || '_' || version FROM models WHERE feature_table IS NOT NULL),
tw(seed, node, hops) AS (SELECT DISTINCT dst, dst, 0 FROM te UNION ALL SELECT seed, src, hops + 1 FROM tw JOIN te ON node = dst WHERE hops < 8),
tup AS (SELECT seed, node, min(hops)::INT AS hops FROM tw WHERE seed <> node GROUP BY ALL)
"""
FINDINGS = f"""
{GRAPH},
tags(table_name, column_name, tag) AS {values(sorted(set(estate.TAGS + estate.EDITED_TAGS)))},
scope(regime, tag) AS {values(_SCOPE)},
att(attribute, col, kind, reference, n_codes) AS {values(_ATTRIBUTES)},
res(regime, attribute, basis, citation) AS {values(_RESTRICTED)},
held AS (SELECT regime, col, attribute, basis, citation FROM res JOIN att USING (attribute)),
tagged AS (SELECT regime, table_name AS up_table, column_name AS up_column, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM tags JOIN scope USING (tag) GROUP BY ALL),
near AS (SELECT *, row_number() OVER (PARTITION BY regime, table_name, column_name ORDER BY hops, up_table, up_column) AS n FROM anc JOIN tagged USING (up_table, up_column)),
pr AS (SELECT near.regime, table_name, column_name AS feature, up_table AS origin_table, up_column AS origin_column, hops, tags, attribute, coalesce(basis, 'examine') AS basis, citation,
         CASE WHEN attribute IS NULL THEN 'carries ' || tags || ', which ' || near.regime || ' watches' END AS why
       FROM near LEFT JOIN held ON near.regime = held.regime AND near.up_column = held.col WHERE n = 1),
vio AS (SELECT model, version, stage, pr.* FROM models JOIN pr ON feature_table = table_name WHERE stage IN ('Production', 'Staging')),
plan AS (SELECT DISTINCT 'tag' AS kind, 'ACTIVE' AS status, coalesce(attribute, 'tagged column') || ' reaches ' || model || ' through ' || feature || ' under ' || regime AS title, table_name AS resource,
         CASE basis WHEN 'prohibited' THEN 'CRITICAL' WHEN 'conditional' THEN 'HIGH' WHEN 'examine' THEN 'LOW' ELSE 'MEDIUM' END AS priority, regime, model FROM vio)
"""
DATASETS = "(SELECT unnest(['raw_orders','raw_customer','raw_nation','raw_region','raw_part','raw_lineitem','stg_order','stg_customer','stg_nation','stg_region','dim_order','value_features','size_features']) AS name)"
ENTITIES = f"""
models(model, version, stage, feature_table, features, label) AS {values(estate.MODELS)},
ent AS (SELECT 'dataset' AS type, name, 'spark' AS platform FROM {DATASETS} UNION ALL SELECT 'mlModel', model || '_' || version, 'registry' FROM models)
"""
DIM = """
dim AS (SELECT o_orderkey AS order_id, o_custkey || '-' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') AS order_ref, o_custkey AS customer_id, o_orderstatus AS status_code, o_orderpriority AS priority_code,
        o_totalprice AS total_usd, o_orderdate AS ordered_at, c_mktsegment AS segment, c_acctbal AS account_balance_usd, n_name AS nation_name, r_name AS region_name
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice IS NOT NULL)
"""
IDENT = f"""
{DIM},
long AS (SELECT unnest(['segment', 'status_code', 'nation_name', 'priority_code', 'order_ref']) AS column_name, unnest([segment, status_code, nation_name, priority_code, order_ref]) AS value FROM dim),
cnt AS (SELECT column_name, value, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY ALL),
prof AS (SELECT *, sum(n) OVER (PARTITION BY column_name) AS total FROM cnt QUALIFY count(*) OVER (PARTITION BY column_name) <= 600),
codes(attribute, value) AS {values(_CODES)},
hit AS (SELECT column_name, attribute, count(*) AS present, sum(n) AS inside, any_value(total) AS total FROM prof JOIN codes USING (value) GROUP BY ALL),
val AS (SELECT column_name, attribute, round(present / k, 4) AS covered, round(1 - inside / total, 4) AS stray FROM hit JOIN (SELECT attribute, count(*) AS k FROM codes GROUP BY 1) USING (attribute)
        WHERE round(1 - inside / total, 4) <= 0.02 AND round(present / k, 4) >= 0.5),
cols AS (SELECT unnest(['segment', 'status_code', 'nation_name', 'priority_code', 'order_ref', 'account_balance', 'mystery', 'applicant_sex', 'RAC1P', 'place_of_birth_code', 'marketplace']) AS column_name),
att(attribute, col, kind, reference, n_codes) AS {values(_ATTRIBUTES)},
norm AS (SELECT column_name, regexp_replace(trim(regexp_replace(lower(column_name), '[^a-z0-9]+', ' ', 'g')), '( (code|cd|flag|id|key|num|usd|amt|ind))+$', '') AS p FROM cols),
enc(attribute, encoding) AS {values([(a, d.get("encoding")) for a, d in policy.declared().items()])},
al0 AS (SELECT attribute, unnest(list_concat([attribute, replace(attribute, '_', ' ')], list_transform(regexp_extract_all(encoding, '\\b[A-Z][A-Z0-9]{{1,9}}\\b'), lambda x: lower(x)),
          list_filter(string_split(trim(regexp_replace(lower(encoding), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 3))) AS a FROM enc),
ali AS (SELECT DISTINCT attribute, a FROM al0 WHERE a NOT IN ('pums', '')),
nam AS (SELECT column_name, attribute, CASE WHEN bool_or(list_contains(string_split(p, ' '), a) OR replace(a, '_', ' ') = p) THEN 'exact' ELSE 'loose' END AS strength
        FROM norm, ali WHERE list_contains(string_split(p, ' '), a) OR replace(a, '_', ' ') = p OR (length(a) > 3 AND contains(p, a)) GROUP BY ALL)
"""
CODED = f"""
cel AS ({given_cells()}),
cnt AS (SELECT table_name, column_name, number, CASE WHEN number THEN regexp_replace(value, '\\.0+$', '') ELSE value END AS value, count(*) AS n FROM cel GROUP BY ALL),
prof AS (SELECT *, sum(n) OVER w AS total FROM cnt WINDOW w AS (PARTITION BY table_name, column_name) QUALIFY count(*) OVER w <= 600),
codes(attribute, number, value) AS {values([(a, int(not isinstance(c, str)), str(c)) for a, d in policy.declared().items() for c in (d.get("categories") or {})])},
hit AS (SELECT table_name, column_name, attribute, count(*) AS present, sum(n) AS inside, any_value(total) AS total FROM prof JOIN codes ON prof.value = codes.value AND prof.number = (codes.number = 1) GROUP BY ALL),
coded AS (SELECT table_name, column_name, attribute, round(present / k, 4) AS covered, round(1 - inside / total, 4) AS stray FROM hit JOIN (SELECT attribute, count(*) AS k FROM codes GROUP BY 1) USING (attribute)
          WHERE round(1 - inside / total, 4) <= 0.02 AND round(present / k, 4) >= 0.5)
"""
_LISTED = "SELECT unnest(['segment', 'status_code', 'nation_name', 'priority_code', 'order_ref', 'account_balance', 'mystery', 'applicant_sex', 'RAC1P', 'place_of_birth_code', 'marketplace']) AS column_name"
_GIVEN_COLUMNS = [(line.split()[0], c.split(":")[0]) for line in GIVEN.strip().split("\n") for c in line.split()[1:]]
#: Names of all given columns against the aliases, by the rules of IDENT.
NAMED = IDENT[IDENT.index("cols AS") :].replace(_LISTED, f"SELECT DISTINCT column_name FROM {values(_GIVEN_COLUMNS)} g(table_name, column_name)")
FRAME = f"""
{DIM},
px AS (SELECT *, CASE WHEN md5('p:' || order_id)[1] < 'c' THEN segment ELSE 'x' END AS proxy FROM dim),
fr AS (SELECT g AS grp, order_id AS k, (segment = g)::INT AS y, status_code, priority_code, nation_name AS origin_name, proxy
       FROM px, (SELECT unnest(['AUTOMOBILE', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) AS g) WHERE segment IN ('BUILDING', g)),
sd AS (SELECT unnest([17, 18, 19]) AS seed),
lg AS (SELECT grp, seed, k, y, md5(seed || ':' || k)[1] IN ('0', '1', '2', '3') AS test,
       unnest(['status_code', 'priority_code', 'origin_name', 'proxy']) AS feature, unnest([status_code, priority_code, origin_name, proxy]) AS v FROM fr, sd),
od AS (SELECT grp, seed, feature, v, round(1e6 * ln((sum(y) + 1.0::DOUBLE) / (count(*) - sum(y) + 1.0::DOUBLE)))::BIGINT AS w FROM lg WHERE NOT test GROUP BY ALL),
sc AS (SELECT lg.*, coalesce(w, 0) AS w FROM lg LEFT JOIN od USING (grp, seed, feature, v) WHERE test)
"""


def auc(source: str, by: str) -> str:
    """AUC of source (by, y, s) with average ranks."""
    return f"""(SELECT {by}, round(sum(u) / (sum(p) * sum(n)), 9) AS auc, round(sum(CASE WHEN s > 0 THEN p ELSE n END) / sum(p + n), 9) AS accuracy, sum(p + n)::BIGINT AS n_test, round(sum(p) / sum(p + n), 9) AS positive_rate FROM (
      SELECT *, p * (coalesce(sum(n) OVER (PARTITION BY {by} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2) AS u
      FROM (SELECT {by}, s, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS n FROM {source} GROUP BY {by}, s)) GROUP BY {by})"""


SEEDED = """min_by(n_test, seed) AS n_test, round(min_by(accuracy, seed), 6) AS accuracy, round(min_by(positive_rate, seed), 6) AS positive_rate,
      round(greatest(min_by(positive_rate, seed), 1 - min_by(positive_rate, seed)), 6) AS baseline_accuracy"""
SCREEN = f"""
{DIM},
px AS (SELECT order_id AS k, (segment = 'BUILDING')::INT AS y, status_code, priority_code, nation_name AS origin_name, CASE WHEN md5('p:' || order_id)[1] < 'c' THEN segment ELSE 'x' END AS proxy FROM dim WHERE segment IS NOT NULL),
lg AS (SELECT seed, k, y, md5(seed || ':' || k)[1] IN ('0', '1', '2', '3') AS test, unnest(['status_code', 'priority_code', 'origin_name', 'proxy']) AS feature,
       unnest([status_code, priority_code, origin_name, proxy]) AS v FROM px, (SELECT unnest([17, 18, 19]) AS seed)),
od AS (SELECT seed, feature, v, round(1e6 * ln((sum(y) + 1.0::DOUBLE) / (count(*) - sum(y) + 1.0::DOUBLE)))::BIGINT AS w FROM lg WHERE NOT test GROUP BY ALL),
sc AS (SELECT lg.*, coalesce(w, 0) AS w FROM lg LEFT JOIN od USING (seed, feature, v) WHERE test)
"""


def _screen(features: str, name: str) -> str:
    total = f"(SELECT seed, k, y, sum(w) AS s FROM sc WHERE feature IN ({features}) GROUP BY ALL)"
    return f"SELECT '{name}' AS h, round(avg(auc), 6) AS a, round(stddev_samp(auc), 6) AS d FROM {auc(total, 'seed')}"


def screened() -> str:
    base = "'status_code', 'priority_code'"
    return f"""{SCREEN}, b AS ({_screen(base, '')}), t AS ({_screen(base + ", 'proxy'", 'planted')} UNION ALL {_screen(base + ", 'origin_name'", 'origin')}),
      o AS ({_screen("'proxy'", 'planted')} UNION ALL {_screen("'origin_name'", 'origin')}),
      l AS (SELECT t.h, o.a AS alone, b.a AS base, t.a AS with_it, t.a - b.a AS lift, greatest(0.02, 4 * greatest((b.d + t.d) / 2, 0.001)) AS threshold FROM t JOIN o USING (h), b),
      done AS (SELECT hypothesis, column_name, lift IS NOT NULL AS tested, CASE WHEN column_name IS NULL THEN 'no column holds it' WHEN lift IS NULL THEN 'no such column' END AS why_not,
        alone, base, with_it, round(lift, 6) AS lift, round(threshold, 6) AS threshold, lift >= threshold AS fires FROM {values(estate.HYPOTHESES)} y(hypothesis, column_name) LEFT JOIN l ON h = hypothesis)"""


def cut_rows(column: str, table: str, parts: int = 63) -> str:
    """Values x at which a running count of the table's rows passes a multiple of n / parts."""
    return f"""SELECT x FROM (SELECT {column}::DOUBLE AS x, row_number() OVER (ORDER BY {column}) AS i, count(*) OVER () AS n FROM {table} WHERE {column} IS NOT NULL)
      WHERE least(({parts} * i) // n, {parts - 1}) > ({parts} * (i - 1)) // n"""


def _cuts() -> str:
    parts = [("dim_order", c, "dim") for c in ("total_usd", "account_balance_usd")] + [("raw_lineitem", c, "lineitem") for c in ("l_quantity", "l_extendedprice", "l_discount")]
    each = [f"SELECT '{name}' AS table_name, '{c}' AS column_name, x FROM ({cut_rows(c, t)})" for name, c, t in parts]
    return f"WITH {DIM}, e AS (SELECT DISTINCT * FROM ({' UNION ALL '.join(each)})) SELECT table_name, column_name, row_number() OVER (PARTITION BY table_name, column_name ORDER BY x)::INT AS place, x AS cut FROM e"


#: Pages and what their anchors point at, both ways; breadth first, one level after the other, for as many hops as asked.
LINKS = r"""pl AS (SELECT DISTINCT 'page:' || page_id AS page, unnest(regexp_extract_all(html, '<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)) AS target FROM pages),
ed AS (SELECT page AS src, target AS dst FROM pl WHERE target <> '' UNION SELECT target, page FROM pl WHERE target <> '')"""
_WALK = "wk(seed, node, hops) AS ({seeds} UNION SELECT wk.seed, ed.dst, wk.hops + 1 FROM wk JOIN ed ON ed.src = wk.node WHERE wk.hops < 8)"
_FIRST = "SELECT 'page:' || min(page_id) AS seed, 'page:' || min(page_id) AS node, 0 AS hops FROM pages"
_SIXTY_TWO = "SELECT 'page:' || page_id, 'page:' || page_id, 0 FROM (SELECT DISTINCT page_id FROM pages ORDER BY page_id LIMIT 62)"


#: The features of both versions; the serving model is measured with each, on the rows of its training table.
_VERSIONS = [(seq, f) for seq, v in ((1, "1"), (2, "2")) for m in estate.MODELS if m[:2] == ("value-classifier", v) for f in m[4].split(",")]
EXPOSED = f"""
{DIM},
vf AS (SELECT order_id AS k, segment, status_code, nation_name, priority_code, account_balance_usd FROM dim WHERE account_balance_usd >= 0),
ty AS (SELECT 'segment' AS column_name, 'BUILDING' AS against, g AS grp, k, (segment = g)::INT AS y FROM vf, (SELECT unnest(['AUTOMOBILE', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) AS g) WHERE segment IN ('BUILDING', g)
       UNION ALL SELECT 'status_code', 'O', g, k, (status_code = g)::INT FROM vf, (SELECT unnest(['F', 'P']) AS g) WHERE status_code IN ('O', g)),
cq AS (SELECT DISTINCT x FROM ({cut_rows('account_balance_usd', 'vf')})),
bn AS (SELECT v.x, count(cq.x) AS b FROM (SELECT DISTINCT account_balance_usd AS x FROM vf) v LEFT JOIN cq ON cq.x <= v.x GROUP BY v.x),
fv AS (SELECT k, unnest(['market_code', 'origin_name', 'status_code', 'priority_code', 'account_balance_usd']) AS feature, unnest([segment, nation_name, status_code, priority_code, b::VARCHAR]) AS v FROM vf JOIN bn ON bn.x = account_balance_usd),
ver(seq, feature) AS {values(_VERSIONS)},
lg AS (SELECT seq, column_name, against, grp, seed, k, y, md5(seed || ':' || k)[1] IN ('0', '1', '2', '3') AS test, feature, v
       FROM ty JOIN fv USING (k) JOIN ver USING (feature), (SELECT unnest([17, 18, 19]) AS seed) WHERE feature <> column_name),
od AS (SELECT seq, column_name, grp, seed, feature, v, round(1e6 * ln((sum(y) + 1.0::DOUBLE) / (count(*) - sum(y) + 1.0::DOUBLE)))::BIGINT AS w FROM lg WHERE NOT test GROUP BY ALL),
ss AS (SELECT seq, column_name, grp, seed, k, y, sum(coalesce(w, 0)) AS s FROM lg LEFT JOIN od USING (seq, column_name, grp, seed, feature, v) WHERE test GROUP BY ALL),
hist AS (SELECT 'value-classifier' AS model, seq::INT AS seq, seq::VARCHAR AS version, 'value_features' AS feature_table, CASE seq WHEN 1 THEN '{estate.MODELS[0][4]}' ELSE '{estate.MODELS[1][4]}' END AS features,
         column_name, grp, against, round(avg(auc), 6) AS auc, round(coalesce(stddev_samp(auc), 0), 6) AS auc_stdev, any_value(n) AS n_rows
         FROM {auc('ss', 'seq, column_name, grp, seed')} JOIN (SELECT column_name, against, grp, count(*) AS n FROM ty GROUP BY ALL) USING (column_name, grp) WHERE n >= 2000 GROUP BY seq, column_name, grp, against),
was AS (SELECT model, column_name, grp, auc::DOUBLE AS a, auc_stdev::DOUBLE AS s FROM hist WHERE seq = 1), now AS (SELECT model, column_name, grp, auc::DOUBLE AS b, auc_stdev::DOUBLE AS z FROM hist WHERE seq = 2),
cmp AS (SELECT model, column_name, grp, b - a AS d, greatest((s + z) / 2, 0.001::DOUBLE) AS noise, greatest(0.02::DOUBLE, 4 * greatest((s + z) / 2, 0.001::DOUBLE)) AS th FROM was FULL JOIN now USING (model, column_name, grp)),
moved AS (SELECT model, column_name, grp, round(d, 6) AS delta, CASE WHEN d IS NULL THEN NULL ELSE round(th, 6) END AS threshold, round(abs(d) / noise, 2) AS multiples_of_noise,
         CASE WHEN d IS NULL THEN 'not_comparable' WHEN abs(d) >= th THEN 'fires' ELSE 'silent' END AS status FROM cmp)
"""


_ALL = "(SELECT grp, seed, k, y, sum(w) AS s FROM sc GROUP BY ALL)"
_COMPARE = f"""
rec(model, seq, version, features) AS {values([r[:4] for r in estate.RECORDINGS])},
mea(model, seq, column_name, grp, auc, sd) AS {values(_MEASURES)},
last AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY seq DESC) - 1 AS back FROM rec QUALIFY row_number() OVER (PARTITION BY model ORDER BY seq DESC) <= 2),
was AS (SELECT model, column_name, grp, auc::DOUBLE AS a, sd::DOUBLE AS s FROM mea JOIN last USING (model, seq) WHERE back = 1),
now AS (SELECT model, column_name, grp, auc::DOUBLE AS b, sd::DOUBLE AS z FROM mea JOIN last USING (model, seq) WHERE back = 0 AND model IN (SELECT model FROM last WHERE back = 1)),
cmp AS (SELECT model, column_name, grp, b - a AS d, greatest((s + z) / 2, 0.001::DOUBLE) AS noise, greatest(0.02::DOUBLE, 4 * greatest((s + z) / 2, 0.001::DOUBLE)) AS th FROM was FULL JOIN now USING (model, column_name, grp)),
done AS (SELECT model, column_name, grp, round(d, 6) AS delta, CASE WHEN d IS NULL THEN NULL ELSE round(th, 6) END AS threshold, round(abs(d) / noise, 2) AS multiples_of_noise,
         CASE WHEN d IS NULL THEN 'not_comparable' WHEN abs(d) >= th THEN 'fires' ELSE 'silent' END AS status FROM cmp)
"""

ORACLES = {
    "stg_order_projection": f"WITH {DIM} SELECT order_id, customer_id, order_ref, status_code, priority_code, total_usd, ordered_at FROM dim",
    "dim_order_left_joins": f"WITH {DIM} SELECT * FROM dim",
    "value_features_label": f"WITH {DIM} SELECT order_id, segment AS market_code, nation_name AS origin_name, status_code, priority_code, account_balance_usd, (total_usd > 250000)::INT AS high_value FROM dim WHERE account_balance_usd >= 0",
    "size_features_between": "SELECT p_partkey AS part_id, p_brand AS brand, p_type AS part_type, p_size AS part_size, (p_retailprice >= 950)::INT AS is_dear FROM part WHERE p_size BETWEEN 16 AND 40",
    "key_uniqueness_tests": """
      SELECT 'dim_order' AS table_name, 'not_null' AS test, count(*) FILTER (o_orderkey IS NULL)::BIGINT AS failures FROM orders
      UNION ALL SELECT 'dim_order', 'unique', (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1))
      UNION ALL SELECT 'raw_lineitem', 'not_null', count(*) FILTER (l_orderkey IS NULL OR l_linenumber IS NULL) FROM lineitem
      UNION ALL SELECT 'raw_lineitem', 'unique', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))""",
    "dedupe_keep_first": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1",
    "missing_column_select": "SELECT c_custkey, c_mktsegment, 'c_fax' AS lacking FROM customer",
    "inline_dimension": "SELECT CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'goods' WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'trade' ELSE 'Unknown' END AS kind, count(*) AS n FROM customer GROUP BY 1",
    "dynamic_feature_list": f"SELECT position::INT AS position, feature FROM {values([(1, 'market_code'), (2, 'origin_name'), (3, 'status_code'), (4, 'priority_code'), (5, 'account_balance_usd')])} t(position, feature)",
    "serving_version": f"WITH {ENTITIES} SELECT * FROM models WHERE model = 'value-classifier' AND stage = 'Production' QUALIFY row_number() OVER (ORDER BY version::INT DESC) = 1",
    "column_edges": f"WITH RECURSIVE {GRAPH} SELECT * FROM ce",
    "column_ancestry_min_hops": f"WITH RECURSIVE {GRAPH} SELECT * FROM anc WHERE hops > 0",
    "entity_walk_up": f"WITH RECURSIVE {GRAPH} SELECT * FROM tup",
    "entity_walk_down": f"WITH RECURSIVE {GRAPH} SELECT node AS seed, seed AS node, hops FROM tup",
    "walk_agreement": f"WITH RECURSIVE {GRAPH} SELECT count(*) AS loop_rows, count(*) AS recursive_rows, 0::BIGINT AS differences FROM tup",
    "catalog_search": f"WITH {ENTITIES} SELECT type, name FROM ent WHERE (type = 'dataset' AND contains(name, 'order')) OR type = 'mlModel'",
    "name_resolution": "SELECT * FROM (VALUES ('dim_order', 'exact', 'dim_order', NULL), ('size', 'unique', 'size_features', NULL), ('stg_', 'ambiguous', NULL, 'stg_customer,stg_nation,stg_order,stg_region'), ('nowhere', 'none', NULL, NULL), ('urn:li:dataset:(urn:li:dataPlatform:spark,stg_order,PROD)', 'urn', 'stg_order', NULL)) t(target, outcome, name, candidates)",
    "entities_by_name": f"WITH {ENTITIES} SELECT name, 'urn:li:' || type || ':(urn:li:dataPlatform:' || platform || ',' || name || ',PROD)' AS urns FROM ent",
    "neighbours": f"WITH RECURSIVE {GRAPH} SELECT src AS name, 'down' AS direction, dst AS neighbour FROM te UNION ALL SELECT dst, 'up', src FROM te",
    "column_parents": f"WITH RECURSIVE {GRAPH} SELECT down_column, up_table, up_column FROM ce WHERE down_table = 'dim_order'",
    "training_datasets": f"WITH RECURSIVE {GRAPH} SELECT model, version, stage, feature_table AS table_name, 1 AS hops FROM models WHERE feature_table IS NOT NULL",
    "lineage_walk": f"""WITH RECURSIVE {FINDINGS}, w AS (SELECT 'stg_customer' AS seed, seed AS node, hops FROM tup WHERE node = 'stg_customer' AND hops <= 3 UNION ALL SELECT 'stg_customer', 'stg_customer', 0)
      SELECT seed, node, hops, coalesce((SELECT string_agg(DISTINCT 'tag:ACTIVE ' || title, '; ' ORDER BY 'tag:ACTIVE ' || title) FROM plan WHERE regime = 'order_desk' AND resource = node), '') AS open FROM w""",
    "column_list": "SELECT position, column_name FROM (SELECT unnest(range(1, 12))::INT AS position, unnest(['order_id', 'order_ref', 'customer_id', 'status_code', 'priority_code', 'total_usd', 'ordered_at', 'segment', 'account_balance_usd', 'nation_name', 'region_name']) AS column_name)",
    "dataset_source": "SELECT unnest(['warehouse://store:5433/orders/value_features', 'warehouse://store:5433/orders/size_features']) AS uri",
    "foreign_entities": "SELECT 'legacy_feed' AS name",
    "materialized_marts": f"WITH {DIM} SELECT 'dim_order' AS name, count(*) AS n FROM dim UNION ALL SELECT 'value_features', count(*) FROM dim WHERE account_balance_usd >= 0 UNION ALL SELECT 'size_features', count(*) FROM part WHERE p_size BETWEEN 16 AND 40",
    "violation_report": f"WITH RECURSIVE {FINDINGS} SELECT regime, model, feature, basis, attribute, CASE basis WHEN 'prohibited' THEN 0 WHEN 'conditional' THEN 1 WHEN 'examine' THEN 2 ELSE 9 END AS severity, count(*) OVER (PARTITION BY regime, model, basis) AS n_on_basis FROM vio",
    "policy_by_column": f"WITH RECURSIVE {FINDINGS} SELECT regime, col AS \"column\", attribute, basis, citation FROM held",
    "attribute_aliases": f"WITH {IDENT} SELECT attribute, a AS alias FROM ali",
    "recorded_models": "SELECT unnest(['value-classifier', 'size-classifier']) AS model",
    "record_exposure": f"WITH {EXPOSED} SELECT * FROM hist",
    "exposure_compare": f"WITH {EXPOSED} SELECT * FROM moved",
    "root_cause": f"""WITH RECURSIVE {FINDINGS}, {EXPOSED}, far AS (SELECT *, rank() OVER (PARTITION BY table_name, column_name ORDER BY hops DESC) AS r FROM anc WHERE hops > 0),
      org AS (SELECT table_name, column_name, max(hops) AS hops, string_agg(up_table || '.' || up_column, ',' ORDER BY up_table || '.' || up_column) AS sources, bool_or(up_column <> column_name) AS renamed FROM far WHERE r = 1 GROUP BY ALL),
      got AS (SELECT 'value-classifier' AS model, unnest(['market_code', 'priority_code', 'account_balance_usd']) AS column_name WHERE (SELECT count(*) FROM hist) > 0)
      SELECT model, got.column_name, org.hops, sources, renamed, regime, attribute, basis, (SELECT count(*) FROM moved WHERE status = 'fires') AS n_shifts, 'candidates' AS conclusion
      FROM got LEFT JOIN org ON org.table_name = 'value_features' AND org.column_name = got.column_name LEFT JOIN pr ON pr.table_name = 'value_features' AND pr.feature = got.column_name""",
    "incident_union": f"""WITH RECURSIVE {FINDINGS}, {_COMPARE} SELECT * FROM plan WHERE model = 'value-classifier'
      UNION ALL SELECT 'delta', 'ACTIVE', column_name || ' (' || grp || ') became easier to rebuild from ' || model || ' under order_desk', 'value_features', 'HIGH', 'order_desk', model FROM done WHERE status = 'fires' AND model = 'value-classifier'""",
    "incident_filing": f"WITH RECURSIVE {FINDINGS} SELECT title, resource, priority, CASE WHEN regime = 'order_desk' THEN 'already open' ELSE 'would file' END AS outcome FROM plan",
    "incidents_open": f"""WITH RECURSIVE {FINDINGS}, {_COMPARE} SELECT kind, title, resource, priority FROM plan WHERE regime = 'order_desk'
      UNION ALL SELECT 'delta', column_name || ' (' || grp || ') became easier to rebuild from ' || model || ' under order_desk', CASE WHEN model = 'value-classifier' THEN 'value_features' ELSE 'size_features' END, 'HIGH' FROM done WHERE status = 'fires'""",
    "type_counts": f"WITH {ENTITIES} SELECT type, count(*) AS n FROM ent GROUP BY 1",
    "urn_parse": f"WITH {ENTITIES} SELECT name, platform FROM ent",
    "entity_type_from_urn": f"WITH {ENTITIES} SELECT name, CASE type WHEN 'dataset' THEN 'DATASET' ELSE 'ML_MODEL' END AS entity_type FROM ent",
    "chain_check": f"SELECT src, dst, true AS found FROM {values([('raw_customer', 'stg_customer'), ('stg_customer', 'dim_order'), ('dim_order', 'value_features')])} t(src, dst)",
    "tag_union": f"WITH RECURSIVE {FINDINGS} SELECT table_name, column_name, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM tags GROUP BY ALL",
    "policy_resolved": f"WITH RECURSIVE {FINDINGS} SELECT regime, attribute, col AS \"column\", kind, reference, n_codes, basis, citation FROM res JOIN att USING (attribute)",
    "policy_untestable": f"WITH RECURSIVE {FINDINGS} SELECT regime, attribute, CASE WHEN kind = 'continuous' THEN 'continuous' WHEN n_codes = 0 THEN 'no coding' ELSE 'no reference' END AS why FROM res JOIN att USING (attribute) WHERE kind = 'continuous' OR n_codes = 0 OR reference IS NULL",
    "regime_matrix": f"WITH RECURSIVE {FINDINGS} SELECT attribute, " + ", ".join(f"max(basis) FILTER (regime = '{r}') AS {r}" for r in ("ecoa", "employment_us", "canada", "eu_ai_act")) + " FROM res GROUP BY 1",
    "protected_reaching": f"WITH RECURSIVE {FINDINGS} SELECT * FROM pr",
    "deployed_violations": f"WITH RECURSIVE {FINDINGS} SELECT * FROM vio",
    "phantom_tables": f"""WITH RECURSIVE {GRAPH} SELECT DISTINCT model, node AS table_name, 'no such table' AS warning FROM models JOIN tup ON feature_table = seed
      WHERE stage IN ('Production', 'Staging') AND node NOT IN (SELECT name FROM {DATASETS})
      UNION ALL SELECT model, NULL, 'no training table' FROM models WHERE stage IN ('Production', 'Staging') AND feature_table IS NULL""",
    "violation_counts": f"WITH RECURSIVE {FINDINGS} SELECT regime, model, basis, count(*) AS n FROM vio GROUP BY ALL",
    "blocking_gate": f"WITH RECURSIVE {FINDINGS} SELECT regime, count(*) FILTER (basis = 'prohibited') AS blocking, count(*) FILTER (basis = 'prohibited') > 0 AS blocked FROM vio GROUP BY 1",
    "blast_radius": f"""WITH RECURSIVE {GRAPH}, land AS (SELECT table_name AS name, min(hops) AS degree FROM anc WHERE up_table = 'stg_customer' AND up_column = 'segment' AND hops > 0 GROUP BY 1)
      SELECT 'dataset' AS kind, name, degree, NULL AS via, false AS serving FROM land
      UNION ALL SELECT 'model', model || '_' || version, degree + 1, feature_table, stage IN ('Production', 'Staging') FROM models JOIN land ON feature_table = name""",
    "blast_verdict": f"""WITH RECURSIVE {FINDINGS} SELECT regime, basis, s AS serving_models, basis = 'prohibited' AND s > 0 AS blocks FROM pr,
      (SELECT count(*) AS s FROM models WHERE stage IN ('Production', 'Staging') AND feature_table IN (SELECT table_name FROM anc WHERE up_table = 'dim_order' AND up_column = 'segment')) WHERE table_name = 'dim_order' AND feature = 'segment'""",
    "root_cause_origin": f"""WITH RECURSIVE {GRAPH}, far AS (SELECT *, rank() OVER (PARTITION BY table_name, column_name ORDER BY hops DESC) AS r FROM anc WHERE hops > 0)
      SELECT table_name, column_name, max(hops) AS hops, string_agg(up_table || '.' || up_column, ',' ORDER BY up_table || '.' || up_column) AS sources, bool_or(up_column <> column_name) AS renamed FROM far WHERE r = 1 GROUP BY ALL""",
    "provenance_chain": f"WITH RECURSIVE {GRAPH} SELECT up_table, up_column, hops FROM anc WHERE table_name = 'value_features' AND column_name = 'market_code'",
    "incident_plan": f"WITH RECURSIVE {FINDINGS} SELECT * FROM plan",
    "incident_dedupe": f"WITH RECURSIVE {FINDINGS} SELECT priority, count(*) AS n FROM plan WHERE regime <> 'order_desk' GROUP BY 1",
    "document_id": f"WITH {_COMPARE} SELECT model, seq, upper(substr(sha256(model || '|' || version || '|order_desk|2024-01-0' || seq), 1, 12)) AS document_id FROM rec",
    "column_profile": f"WITH {IDENT} SELECT column_name, value, n, round(n / total, 6) AS share FROM prof",
    "code_set_match": f"WITH {IDENT} SELECT * FROM val",
    "name_match": f"WITH {IDENT} SELECT * FROM nam",
    "identify_verdict": f"""WITH {IDENT}, e AS (SELECT column_name, coalesce((SELECT list(attribute ORDER BY attribute) FROM nam n WHERE n.column_name = cols.column_name AND strength = 'exact'), []) AS ex,
        coalesce((SELECT list(attribute ORDER BY attribute) FROM nam n WHERE n.column_name = cols.column_name AND strength = 'loose'), []) AS lo,
        coalesce((SELECT list(attribute ORDER BY attribute) FROM val v WHERE v.column_name = cols.column_name), []) AS va FROM cols),
      a AS (SELECT *, CASE WHEN len(list_intersect(ex, va)) = 1 THEN list_intersect(ex, va)[1] WHEN len(ex) = 1 AND len(va) = 0 THEN ex[1] WHEN len(va) = 1 AND len(ex) = 0 THEN va[1]
        WHEN len(va) > 1 AND len(list_intersect(va, list_concat(ex, lo))) = 1 THEN list_intersect(va, list_concat(ex, lo))[1] END AS attribute FROM e),
      c AS (SELECT *, CASE WHEN attribute IS NOT NULL THEN 'identified' WHEN len(va) > 1 OR len(lo) > 0 THEN 'ambiguous' ELSE 'unknown' END AS call FROM a)
      SELECT column_name, call, attribute, CASE WHEN call = 'ambiguous' THEN array_to_string(CASE WHEN len(va) > 1 THEN va ELSE lo END, ',') END AS candidates FROM c""",
    "group_subset_gates": f"WITH {DIM}, c AS (SELECT segment AS code, count(*) AS n FROM dim WHERE segment IS NOT NULL GROUP BY 1) SELECT code, n + (SELECT n FROM c WHERE code = 'BUILDING') AS n_rows, n + (SELECT n FROM c WHERE code = 'BUILDING') >= 2000 AS measured FROM c WHERE code <> 'BUILDING'",
    "reconstruct_bayes": f"WITH {FRAME} SELECT grp, round(avg(auc), 6) AS auc, round(coalesce(stddev_samp(auc), 0), 6) AS auc_stdev, {SEEDED}, any_value(n_rows) AS n_rows FROM {auc(_ALL, 'grp, seed')} JOIN (SELECT grp, count(*) AS n_rows FROM fr GROUP BY 1) USING (grp) GROUP BY 1",
    "single_feature_auc": f"WITH {FRAME} SELECT * FROM {auc('(SELECT grp, feature, y, w AS s FROM sc WHERE seed = 17)', 'grp, feature')}",
    "worst_group": f"WITH {FRAME} SELECT grp, auc FROM {auc('(SELECT * FROM ' + _ALL + ' WHERE seed = 17)', 'grp')} ORDER BY auc DESC, grp DESC LIMIT 1",
    "proxy_screen": f"WITH {screened()} SELECT * FROM done",
    "screen_sink": f"WITH {screened()} SELECT hypothesis, tested, why_not, fires FROM done",
    "last_two_recordings": f"WITH {_COMPARE} SELECT model, seq, version, back::INT AS back FROM last",
    "recording_compare": f"WITH {_COMPARE} SELECT * FROM done",
    "silent_measurements": f"WITH {_COMPARE} SELECT model, column_name, grp, status FROM done WHERE status <> 'fires'",
    "features_gained_lost": f"""WITH {_COMPARE}, f AS (SELECT model, string_split(max(features) FILTER (back = 0), ',') AS n, string_split(max(features) FILTER (back = 1), ',') AS w FROM last GROUP BY 1)
      SELECT model, array_to_string(list_filter(n, lambda x: NOT list_contains(w, x)), ',') AS gained, array_to_string(list_filter(w, lambda x: NOT list_contains(n, x)), ',') AS lost FROM f WHERE w IS NOT NULL""",
    "learned_cuts": _cuts(),
    "stratified_split": f"""WITH {DIM}, h AS (SELECT order_id, segment, ('0x' || substr(md5('17:' || order_id), 1, 15))::BIGINT AS h FROM dim)
      SELECT order_id, segment, segment IS NOT NULL AND row_number() OVER (PARTITION BY segment ORDER BY h, order_id) <= (count(*) OVER (PARTITION BY segment) + 2) // 4 AS held_out FROM h""",
    "page_link_degrees": f"WITH {LINKS} SELECT target, count(*) AS n FROM pl WHERE target <> '' GROUP BY 1",
    "page_walk": f"WITH RECURSIVE {LINKS}, {_WALK.format(seeds=_FIRST)} SELECT node, min(hops)::INT AS hops FROM wk WHERE node <> seed GROUP BY node",
    "page_walk_of_many": f"""WITH RECURSIVE {LINKS}, {_WALK.format(seeds=_SIXTY_TWO)}, least AS (SELECT seed, node, min(hops) AS hops FROM wk WHERE node <> seed GROUP BY ALL)
      SELECT node, hops::INT AS hops, count(*) AS n_seeds FROM least GROUP BY ALL""",
    "page_paths": f"""WITH RECURSIVE {LINKS}, {_WALK.format(seeds=_FIRST)}, dist AS (SELECT node, min(hops) AS hops FROM wk GROUP BY node), goal AS (SELECT 'page:' || min(substr(node, 6)::BIGINT) AS g FROM dist WHERE node LIKE 'page:%' AND hops = (SELECT max(hops) FROM dist WHERE node LIKE 'page:%')),
      pa(node, hops, path) AS (SELECT g, hops, g FROM goal JOIN dist ON node = g UNION ALL SELECT ed.src, pa.hops - 1, ed.src || ' ' || path FROM pa JOIN ed ON ed.dst = pa.node JOIN dist ON dist.node = ed.src AND dist.hops = pa.hops - 1)
      SELECT path, (SELECT hops FROM dist JOIN goal ON node = g)::INT AS hops FROM pa WHERE hops = 0""",
    "event_windows": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
    "event_shifts": """WITH rows AS (SELECT user_id, ts, CAST(round(value * 100) AS BIGINT) AS w FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
mark AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE AS mark FROM rows),
days AS (SELECT user_id, date_trunc('day', ts) AS start, count(*) AS n, CAST(sum(w) AS DOUBLE) AS s, CAST(sum(w * w) AS DOUBLE) AS q FROM rows GROUP BY ALL),
closed AS (SELECT *, s / n / 100 AS mean, CASE WHEN n > 1 THEN sqrt(greatest(0, q - s * s / n) / (n - 1) / n) / 100 END AS noise FROM days, mark WHERE start + INTERVAL 1 DAY <= mark),
sides AS (SELECT *, lag(start) OVER w AS before, lag(mean) OVER w AS was, lag(noise) OVER w AS noise_was, lead(start) OVER w AS next FROM closed WINDOW w AS (PARTITION BY user_id ORDER BY start)),
held AS (SELECT *, before >= start - INTERVAL 2 DAY AS known, greatest(0.02, 4 * greatest((noise + noise_was) / 2, 0.001)) AS threshold FROM sides)
SELECT user_id, start, n, round(mean, 6) AS mean, CASE WHEN known THEN round(mean - was, 6) END AS delta, CASE WHEN known AND noise + noise_was IS NOT NULL THEN round(threshold, 6) END AS threshold,
CASE WHEN known IS NOT TRUE THEN 'first' WHEN noise + noise_was IS NULL THEN 'not_comparable' WHEN abs(mean - was) >= threshold THEN 'fires' ELSE 'silent' END AS status FROM held
UNION ALL SELECT user_id, start, n, round(mean, 6), NULL, NULL, 'gone' FROM held WHERE next > start + INTERVAL 2 DAY OR (next IS NULL AND start + INTERVAL 3 DAY <= mark)""",
    "table_agreement": """WITH e AS (SELECT min(l_orderkey) AS a, max(l_orderkey) AS z FROM lineitem),
r AS (SELECT lineitem.* REPLACE (CASE WHEN l_orderkey = a THEN l_tax + 1 ELSE l_tax END AS l_tax) FROM lineitem, e WHERE l_orderkey <> (a + z) // 2),
both_sides AS (SELECT *, 1 AS i, 0 AS j FROM lineitem UNION ALL SELECT *, 0, 1 FROM r UNION ALL SELECT r.*, 0, 1 FROM r, e WHERE l_orderkey = z)
SELECT * EXCLUDE (i, j), sum(i)::BIGINT AS n_left, sum(j)::BIGINT AS n_right FROM both_sides GROUP BY ALL HAVING sum(i) <> sum(j)""",
    "codes_every_column": f"WITH {CODED} SELECT * FROM coded",
    "identify_every_column": f"""WITH {CODED}, {NAMED}, given(table_name, column_name) AS {values(_GIVEN_COLUMNS)},
      e AS (SELECT table_name, column_name, coalesce((SELECT list(attribute ORDER BY attribute) FROM nam n WHERE n.column_name = g.column_name AND strength = 'exact'), []) AS ex,
        coalesce((SELECT list(attribute ORDER BY attribute) FROM nam n WHERE n.column_name = g.column_name AND strength = 'loose'), []) AS lo,
        coalesce((SELECT list(attribute ORDER BY attribute) FROM coded v WHERE v.table_name = g.table_name AND v.column_name = g.column_name), []) AS va FROM given g),
      a AS (SELECT *, CASE WHEN len(list_intersect(ex, va)) = 1 THEN list_intersect(ex, va)[1] WHEN len(ex) = 1 AND len(va) = 0 THEN ex[1] WHEN len(va) = 1 AND len(ex) = 0 THEN va[1]
        WHEN len(va) > 1 AND len(list_intersect(va, list_concat(ex, lo))) = 1 THEN list_intersect(va, list_concat(ex, lo))[1] END AS attribute FROM e),
      c AS (SELECT *, CASE WHEN attribute IS NOT NULL THEN 'identified' WHEN len(va) > 1 OR len(lo) > 0 THEN 'ambiguous' ELSE 'unknown' END AS call FROM a)
      SELECT table_name, column_name, call, attribute, CASE WHEN call = 'ambiguous' THEN array_to_string(CASE WHEN len(va) > 1 THEN va ELSE lo END, ',') END AS candidates FROM c""",
    "top_values_every_column": f"""WITH cel AS ({given_cells()}), n AS (SELECT table_name, column_name, CASE WHEN length(value) > 64 THEN 'sha256:' || sha256(value) ELSE value END AS value, count(*) AS n FROM cel GROUP BY ALL)
      SELECT table_name, column_name, row_number() OVER (PARTITION BY table_name, column_name ORDER BY n DESC, value)::INT AS place, value, n FROM n QUALIFY place <= 601""",
    "types_every_column": f"""WITH cel AS ({given_cells()}), f AS (SELECT table_name, column_name, value FROM cel WHERE value <> ''),
      t AS (SELECT table_name, column_name, count(*) AS filled, bool_and(lower(value) IN ('true', 'false')) AS b, bool_and(regexp_full_match(value, '[+-]?[0-9]{{1,18}}')) AS i,
        bool_and(regexp_full_match(value, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]{{1,3}})?')) AS r, bool_and(length(value) = 10 AND TRY_CAST(value AS DATE) IS NOT NULL) AS d,
        bool_and(length(value) BETWEEN 10 AND 32 AND regexp_matches(value, '^[0-9]{{4}}-') AND TRY_CAST(value AS TIMESTAMP) IS NOT NULL) AS m FROM f GROUP BY ALL),
      g(table_name, column_name) AS {values(_GIVEN_COLUMNS)}
      SELECT table_name, column_name, coalesce(filled, 0) AS filled, CASE WHEN b THEN 'boolean' WHEN i THEN 'long' WHEN r THEN 'double' WHEN d THEN 'date' WHEN m THEN 'timestamp' ELSE 'string' END AS type FROM g LEFT JOIN t USING (table_name, column_name)""",
    "tables_loaded_together": """WITH o AS (SELECT 1 AS version, o_orderkey FROM orders UNION ALL SELECT 2, o_orderkey FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F'),
l AS (SELECT 1 AS version, l_orderkey FROM lineitem UNION ALL SELECT 2, l_orderkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o WHERE version = 2))
SELECT version::INT AS version, (SELECT count(*) FROM o WHERE o.version = v.version) AS n_orders, (SELECT count(*) FROM l WHERE l.version = v.version) AS n_lines,
(SELECT count(*) FROM l WHERE l.version = v.version AND l_orderkey NOT IN (SELECT o_orderkey FROM o WHERE o.version = v.version)) AS n_orphans FROM (VALUES (1), (2)) v(version)""",
}
