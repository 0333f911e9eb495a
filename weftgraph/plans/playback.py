"""Queries over playback, names, the camera, the built-in dataset, validation and results."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.names import INSTRUMENTS, instrument_name, safe_name
from weftgraph.functions.tables import scratch, table
from weftgraph.operators import dataset as D
from weftgraph.operators import frames as R
from weftgraph.operators import network as N
from weftgraph.operators import playback as P
from weftgraph.plans.scenes import LV, STEPS, _frame_columns, _frames_sql, dataset
from weftgraph.plans.trade import BETWEEN, REACH, trade
from weftgraph.sources import demo, lvjson, results, text

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"{_frames_sql('slice_index BETWEEN 12 AND 30')}")
def frame_range(spark, sf_dir):
    nodes, _ = dataset(spark, sf_dir)
    return _frame_columns(P.frame_range(R.frames(nodes, STEPS), 12, 30, 72))


@query("""WITH t AS (SELECT user_id, event_id, (event_id % 4) / 8.0::DOUBLE AS dt FROM events), s AS (SELECT *, sum(dt * 6 * 0.5) OVER w AS upto, sum(0.75::DOUBLE) OVER w AS free FROM t WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, (floor(upto) - floor(upto - dt * 3))::BIGINT AS timed, (floor(free) - floor(free - 0.75))::BIGINT AS free FROM s""")
def frame_ticks(spark, sf_dir):
    ticks = table(spark, sf_dir, "events").select("user_id", "event_id", ((F.col("event_id") % 4) / 8.0).alias("dt"))
    timed = P.frame_ticks(ticks, "user_id", "event_id", "dt", fps=6, speed=0.5).withColumnRenamed("advance_slices", "timed")
    return P.frame_ticks(timed, "user_id", "event_id", "dt", speed=0.75).select("event_id", "timed", F.col("advance_slices").alias("free"))


@query("""WITH t AS (SELECT user_id, event_id, event_id % 7 // 2 AS s, event_type = 'click' AS active FROM events), l AS (SELECT *, coalesce(lag(active) OVER w, false) AS was, lag(s) OVER w AS before FROM t WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, active AND (NOT was OR s <> before) AS fires, was AND (NOT active OR s < before) AS silences FROM l""")
def live_gate(spark, sf_dir):
    ticks = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.col("event_id") % 7 / 2).alias("s"), (F.col("event_type") == "click").alias("on"))
    return P.live_gate(ticks, "user_id", "event_id", "s", F.col("on")).select("event_id", "fires", "silences")


@query("SELECT event_id, floor(least(greatest(event_id % 25 / 8.0::DOUBLE - 0.5, 0), 2) / 2 * 127 + 0.5)::INTEGER AS velocity FROM events")
def live_velocity(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", P.live_velocity(F.col("event_id") % 25 / 8.0 - 0.5).alias("velocity"))


_NAMES = "[" + ", ".join(f"'{x}'" for x in INSTRUMENTS) + "]"


@query(f"SELECT c_custkey, coalesce(({_NAMES})[c_custkey % 140 + 1], 'Extended') AS instrument FROM customer")
def instrument_names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", instrument_name((F.col("c_custkey") % 140).cast("int")).alias("instrument"))


@query("SELECT page_id, regexp_replace(url, '[^\\p{L}\\p{N}_-]', '_', 'g') AS name FROM pages")
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", safe_name(F.col("url")).alias("name"))


_CAMERA = P.Camera(distance=12.0, yaw=30.0, pitch=20.0)
_PITCH, _YAW = math.radians(20.0), math.radians(30.0)
# the camera's axes as angles: what is ahead, right and up of an eye at 12 units
PROJECTED = f"""{LV}, v AS (SELECT sheet_index, label, x - 12 * cos({_PITCH}) * sin({_YAW}) AS dx, y - 12 * sin({_PITCH}) AS dy, z - 12 * cos({_PITCH}) * cos({_YAW}) AS dz FROM lv),
c AS (SELECT sheet_index, label, -(dx * cos({_PITCH}) * sin({_YAW}) + dy * sin({_PITCH}) + dz * cos({_PITCH}) * cos({_YAW})) AS depth, dx * cos({_YAW}) - dz * sin({_YAW}) AS r, -dx * sin({_PITCH}) * sin({_YAW}) + dy * cos({_PITCH}) - dz * sin({_PITCH}) * cos({_YAW}) AS u FROM v),
screen AS (SELECT sheet_index, label, (r / (depth * tan(pi() / 8) * 1.6) + 1) * 640 AS px, (1 - u / (depth * tan(pi() / 8))) * 400 AS py FROM c WHERE depth > 0)"""


@query(f"{PROJECTED} SELECT sheet_index, label, round(px, 6) AS px, round(py, 6) AS py FROM screen")
def camera_projection(spark, sf_dir):
    seen = P.project(dataset(spark, sf_dir)[0], _CAMERA, 1280, 800)
    return seen.select("sheet_index", "label", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"))


@query(f"{PROJECTED} SELECT sheet_index, label, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY sheet_index ORDER BY d, label) AS r FROM (SELECT *, sqrt(pow(px - 640, 2) + pow(py - 300, 2)) AS d FROM screen) WHERE d < 120) WHERE r = 1")
def pick_in_view(spark, sf_dir):
    """The object nearest to a point of the screen as the camera sees each sheet."""
    seen = P.project(dataset(spark, sf_dir)[0], _CAMERA, 1280, 800)
    return R.pick_object(seen, 640.0, 300.0, 120.0).select("sheet_index", "label", F.round("distance", 6).alias("distance"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'codec is not supported' WHEN o_orderkey % 90 > 63 THEN 'crf is above 63' WHEN o_orderkey % 7 = 0 THEN 'fps is not above 0' END AS message FROM orders""")
def validate_export(spark, sf_dir):
    codec = F.when(F.col("o_orderpriority") == "1-URGENT", "libx264").when(F.col("o_orderpriority") == "2-HIGH", "prores_ks").otherwise(F.col("o_orderpriority"))
    configs = table(spark, sf_dir, "orders").select("o_orderkey", codec.alias("codec"), (F.col("o_orderkey") % 90).alias("crf"), (F.col("o_orderkey") % 7).alias("fps"))
    return P.validate_export(configs).select("o_orderkey", "message")


@query(f"""{LV}, n AS (SELECT sheet_index, count(*) AS n FROM lv GROUP BY ALL),
rows AS (SELECT sheet_index, (row_ord + 1)::INTEGER AS row, unnest(list_filter([CASE WHEN size <= 0 THEN 'size is not above 0' END, CASE WHEN note > 127 THEN 'note is above 127' END, CASE WHEN channel > 15 THEN 'channel is above 15' END], lambda m: m IS NOT NULL)) AS message FROM lv),
kept AS (SELECT * FROM lv WHERE row_ord % 6 <> 0), kn AS (SELECT sheet_index, count(*) AS n FROM kept GROUP BY ALL),
own AS (SELECT sheet_index, (row_ord + 1)::INTEGER AS row, unnest(list_filter([CASE WHEN size <= 0 THEN 'size is not above 0' END, CASE WHEN note > 127 THEN 'note is above 127' END, CASE WHEN channel > 15 THEN 'channel is above 15' END], lambda m: m IS NOT NULL)) AS message FROM kept),
linked AS (SELECT e.sheet_index, (n + edge_ord + 1)::INTEGER AS row, unnest([CASE WHEN NOT EXISTS (FROM kept k WHERE k.sheet_index = e.sheet_index AND label = e."from") THEN 'from is not in the sheet' END, CASE WHEN NOT EXISTS (FROM kept k WHERE k.sheet_index = e.sheet_index AND label = e."to") THEN 'to is not in the sheet' END]) AS message FROM lve e JOIN kn USING (sheet_index))
SELECT 'whole' AS part, sheet_index, row, message FROM rows UNION ALL SELECT 'gaps', sheet_index, row, message FROM own UNION ALL SELECT 'gaps', sheet_index, row, message FROM linked WHERE message IS NOT NULL UNION ALL SELECT 'gaps', -1, 0, 'labels are not in the order in which they first stand'""")
def validate_dataset(spark, sf_dir):
    """The dataset, and once more with objects taken out that its edges and list of labels still name."""
    nodes, edges = dataset(spark, sf_dir)
    labels = D.canonical_labels(nodes)
    found = lambda part, own: D.validate_dataset(own, edges, labels).select(F.lit(part).alias("part"), "sheet_index", F.col("row").cast("int").alias("row"), "message")
    return found("whole", nodes).union(found("gaps", nodes.where("row_ord % 6 <> 0")))


@query("SELECT (row_number() OVER (ORDER BY n_name) - 1)::INTEGER AS label_ord, n_name AS label FROM nation")
def sorted_labels(spark, sf_dir):
    return D.sorted_labels(dataset(spark, sf_dir)[0])


def _demo_sql() -> tuple[str, str]:
    """Nodes and edges of the built-in dataset from its fixed values; the hash works in whole numbers of 128 bits."""
    split = lambda text, k: [x.strip().rsplit(" ", k) for x in text.replace("\n", " ").split(";")]
    countries = ", ".join(f"({k}, '{x[0]}', {', '.join(x[1:])})" for k, x in enumerate(split(demo.COUNTRIES, 6)))
    drifts = ", ".join(f"('{x[0]}', {', '.join(x[1:])})" for x in split(demo.DRIFT, 3))
    pairs = ", ".join("({}, '{}', '{}', {}, {})".format(k, *x.strip().split(",")) for k, x in enumerate(demo.TRADE.replace("\n", " ").split(";")))
    wrap = "18446744073709551616::HUGEINT"
    held = f"list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(label, ''), lambda c: ascii(c)::HUGEINT)), lambda a, b: (a * 31 + b) % {wrap})"
    at = lambda c: f"{c} + coalesce(d{c}, 0) * year + {demo.NOISE} * (((h * {demo.NOISE_FACTORS[c][0]} + year * {demo.NOISE_FACTORS[c][1]}) % {wrap})::DOUBLE / 18446744073709551615::DOUBLE - 0.5) * 2 AS {c}"
    pick = lambda values, column: "([" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" for v in values) + f"])[{column} + 1]"
    color = lambda k, name: f"{pick([x[k] for x in demo.REGION_COLORS], 'region')}::FLOAT AS {name}"
    nodes = f"""WITH c(row_ord, label, region, tier, x, y, z, spin) AS (VALUES {countries}), d(label, dx, dy, dz) AS (VALUES {drifts}),
n AS (SELECT row_ord, label, region, tier, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z, spin::DOUBLE AS spin, dx::DOUBLE AS dx, dy::DOUBLE AS dy, dz::DOUBLE AS dz, {held} AS h, unnest(range(0, {demo.YEARS})) AS year FROM c LEFT JOIN d USING (label))
SELECT year::INTEGER AS sheet_index, row_ord::INTEGER AS row_ord, label, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z, size, shape, color_r, color_g, color_b, note, velocity, cluster_value, spin_y
FROM (SELECT year, row_ord, label, {at("x")}, {at("y")}, {at("z")}, {pick(demo.TIER_SIZES, "tier")} AS size, {pick(demo.REGION_SHAPES, "region")} AS shape, {color(0, "color_r")}, {color(1, "color_g")}, {color(2, "color_b")}, 60 AS note, 64 AS velocity, tier::DOUBLE AS cluster_value, spin AS spin_y FROM n)"""
    edges = f"""WITH e(edge_ord, a, b, base, growth) AS (VALUES {pairs}), s AS (SELECT unnest(range(0, {demo.YEARS}))::INTEGER AS sheet_index, edge_ord::INTEGER AS edge_ord, a AS "from", b AS "to", base::DOUBLE AS base, growth::DOUBLE AS growth FROM e)
SELECT sheet_index, edge_ord, "from", "to", round(least(greatest(base + growth * sheet_index, 0), 1), 9) AS strength FROM s WHERE least(greatest(base + growth * sheet_index, 0), 1) > 0.1"""
    return nodes, edges


DEMO_NODES, DEMO_EDGES = _demo_sql()


def _demo_columns(nodes: DataFrame) -> DataFrame:
    return nodes.select("sheet_index", "row_ord", "label", *(F.round(c, 9).alias(c) for c in "xyz"), "size", "shape", "color_r", "color_g", "color_b", "note", "velocity", "cluster_value", "spin_y")


@query(DEMO_NODES)
def demo_nodes(spark, sf_dir):
    return _demo_columns(demo.demo_dataset(spark)[0])


@query(DEMO_EDGES)
def demo_edges(spark, sf_dir):
    return demo.demo_dataset(spark)[1].withColumn("strength", F.round("strength", 9))


@query("""WITH t AS (SELECT role, string_split(text, chr(10)) AS l FROM conversations) SELECT role AS label, count(*) AS n_texts, sum(strlen(regexp_replace(array_to_string(l, ' '), '\\s+', ' ', 'g')))::BIGINT AS bytes FROM t GROUP BY role""")
def mixed_inputs(spark, sf_dir):
    """Conversations by role in folders of text files, each read as one of several inputs."""
    path = scratch(spark, "inputs")
    flat = table(spark, sf_dir, "conversations").select("role", F.regexp_replace("text", r"\s+", " ").alias("value"))
    flat.write.partitionBy("role").text(path)
    roles = sorted(x.role for x in flat.select("role").distinct().collect())
    found = text.mixed_sources(spark, [f"{path}/role={x}" for x in roles], max_bytes=1 << 31)
    named = found.withColumn("role", F.regexp_extract("path", r"role=([^/]+)/", 1)).select("role", F.explode(F.split(F.regexp_replace("text", r"\n$", ""), "\n")).alias("line"))
    return named.groupBy(F.col("role").alias("label")).agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.octet_length("line")).alias("bytes"))


def _networks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The nations' trade of each year as a network of names: similarity is the two flows between them over the year's largest."""
    adjacency, nodes = trade(spark, sf_dir)
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("token"))
    report = N.centrality_report(adjacency, nodes).join(names, "i")
    own = report.select(F.col("step").cast("string").alias("slice_id"), F.col("i").alias("idx"), "token", "degree", "distance", "closeness", "betweenness")
    both = adjacency.select("step", "i", "j", "w").union(adjacency.select("step", F.col("j"), F.col("i"), "w")).where("i <> j").groupBy("step", "i", "j").agg(F.sum("w").alias("w"))
    most = both.groupBy("step").agg(F.max("w").alias("most"))
    s = F.col("w") / F.col("most")
    pairs = both.join(most, "step").select(F.col("step").cast("string").alias("slice_id"), "i", "j", s.alias("similarity"), s.alias("nppmi"), F.col("w").alias("ppmi"), F.floor(s * 1000).alias("cnt"))
    return own, pairs


@query(f"""{REACH}, {BETWEEN}, b AS (SELECT step, i, sum(c) AS c FROM on_path GROUP BY ALL), k AS (SELECT step, i, count(*) AS k FROM adj WHERE i <> j AND w > 0 GROUP BY ALL)
SELECT step::VARCHAR AS slice_id, i AS idx, n_name AS token, round(coalesce(k, 0) / 24, 6) AS degree, round(coalesce(mean, 'nan'::DOUBLE), 6) AS distance, round(CASE WHEN mean > 1e-15 THEN 1 / mean ELSE 0 END, 6) AS closeness, round(coalesce(c, 0) / 552.0::DOUBLE, 6) AS betweenness
FROM nodes LEFT JOIN k USING (step, i) JOIN m USING (step, i) LEFT JOIN b USING (step, i) JOIN nation ON n_nationkey = i""")
def network_json_roundtrip(spark, sf_dir):
    """Networks written as a document for each slice, read and validated."""
    path = scratch(spark, "networks")
    results.write_networks(results.network_documents(*_networks(spark, sf_dir)), path)
    own, _ = results.read_network_files(spark, path)
    return own.select("slice_id", "idx", "token", *(F.round(c, 6).alias(c) for c in ("degree", "distance", "closeness", "betweenness")))


@query("SELECT NULL::VARCHAR AS slice_id, NULL::VARCHAR AS message WHERE false")
def validate_series(spark, sf_dir):
    """All years' networks have the same labels and go together as a series."""
    return results.series_failures(results.network_documents(*_networks(spark, sf_dir)))


@query(DEMO_NODES)
def dataset_json_load(spark, sf_dir):
    """The built-in dataset written, loaded by its ending and validated."""
    nodes, edges, sheets = demo.demo_dataset(spark)
    path = scratch(spark, "demo") + ".json"
    lvjson.write_json(nodes, edges, sheets, D.canonical_labels(nodes), path)
    return _demo_columns(lvjson.load_dataset(spark, path)[0])
