"""Vectors as raw series and frames, and the star tables as configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lockstep.functions import text
from lockstep.operators import bits, calibrate, config, series
from lockstep.operators import frames as fr
from lockstep.operators import steps as st
from lockstep.sources import recording
from lockstep.workload.documents import table

THRESHOLD = 0.15
CONFIRM = 3
#: Samples of a level in ``E12_detect_steps``, and counts of noise for a component of 1 in the channels numbered 1 modulo 8.
HELD, NOISE = 6, 2000
KEYS = ["channel"]


def raw_series(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("channel"), F.posexplode("embedding").alias("idx", "raw")).select(
        "channel", F.col("idx").cast("long").alias("idx"), F.col("raw").cast("double").alias("raw"))


def clip(spark, sf):
    return st.clip(raw_series(spark, sf), KEYS, 0.1, 1.0, 2.0).select("channel", "idx", F.round("raw", 6).alias("raw"))


def derivative(spark, sf):
    return st.derivative(raw_series(spark, sf), KEYS).select("channel", "idx", F.round("d", 6).alias("d"))


def live_sigma(spark, sf):
    s = raw_series(spark, sf)
    return st.live_sigma(st.derivative(s, KEYS), s, KEYS).select("channel", F.round("sigma", 6).alias("sigma"))


def mark_stable(spark, sf):
    return st.mark_stable(raw_series(spark, sf), KEYS, F.lit(THRESHOLD)).select("channel", "idx", "stable")


def _plateaus(spark, sf):
    s = raw_series(spark, sf)
    edges = st.derivative(s, KEYS).where(F.abs("d") > THRESHOLD)
    return s, st.plateaus(edges, s.groupBy("channel").agg(F.count(F.lit(1)).alias("n")), KEYS, CONFIRM)


def plateaus(spark, sf):
    return _plateaus(spark, sf)[1]


def _levels(spark, sf):
    s, found = _plateaus(spark, sf)
    return st.plateau_levels(found, s, KEYS, CONFIRM)


def plateau_levels(spark, sf):
    return _levels(spark, sf).select("channel", "begin", "end", F.round("value", 6).alias("value"))


def coalesce_levels(spark, sf):
    out = st.coalesce_levels(_levels(spark, sf), KEYS, F.lit(0.05))
    return out.select("channel", "begin", "end", F.round("value", 6).alias("value"))


def median_gap(spark, sf):
    return st.median_gap(_levels(spark, sf), KEYS).select("channel", F.round("median_gap", 6).alias("median_gap"))


def _orders(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("channel"), F.col("o_orderkey").alias("begin"), F.col("o_totalprice").alias("value"))


def monotonic_runs(spark, sf):
    return st.monotonic_runs(_orders(spark, sf), KEYS, F.lit(20000.0))


def select_sweep(spark, sf):
    return st.select_sweep(st.monotonic_runs(_orders(spark, sf), KEYS, F.lit(20000.0)), KEYS, 3)


def extraction_period(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.round(st.extraction_period(F.col("p_size") * 64, F.col("p_retailprice") / 10), 6).alias("period_s"))


def detect_steps(spark, sf):
    """Every vector scaled to counts, a component a level, with noise of other components: the whole detection, relaxing and classifying.

    A level is held so long that it has confirmed samples between its edges. The noise grows with the channel's number modulo 8, from none to
    more than most steps.
    """
    size = F.size("embedding")
    sample = F.transform("embedding", lambda x, i: F.transform(F.sequence(F.lit(0), F.lit(HELD - 1)), lambda j: (
        F.round(x * 20000 + 30000) + F.round(F.col("vec_id") % 8 * NOISE * F.get("embedding", ((i * HELD + j) * 7 + 3) % size))).cast("double")))
    s = table(spark, sf, "embeddings").select(F.col("vec_id").alias("channel"), F.posexplode(F.flatten(sample)).alias("idx", "raw"))
    out = st.detect_steps(s, KEYS, 0.4, [0.0, 6.0, 12.0])
    return out.select("channel", "outcome", "detected_plateaus", F.round("edge_threshold", 6).alias("edge_threshold"), "relaxed", "sweep_levels")


def step_sweep(spark, sf):
    """A customer is a channel that is swept: up, down, to and fro, or up onto the rail, over one to seven levels of 15 samples."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("channel"), (F.col("c_custkey") % 4).alias("kind"),
                                            F.when(F.col("c_custkey") % 4 == 3, 5).otherwise(F.expr("1 + c_custkey div 4 % 7")).alias("n"))
    k = F.when(F.col("kind") == 3, F.least(F.expr("idx div 15"), F.lit(3))).otherwise(F.expr("idx div 15"))
    base = 2000 + F.col("channel") % 50 * 10
    raw = (F.when((F.col("kind") == 3) & (F.col("k") == 3), 65535).when(F.col("kind") == 1, base + 1000 * (F.col("n") - 1 - F.col("k")))
           .when(F.col("kind") == 2, base + 1000 * (F.col("k") * 2 % 3)).otherwise(base + 1000 * F.col("k")))
    samples = (c.withColumn("idx", F.explode(F.sequence(F.lit(0), (15 * F.col("n") - 1).cast("int")))).withColumn("k", k)
               .select("channel", "idx", raw.cast("double").alias("raw")))
    out = st.detect_steps(samples, KEYS, 0.2, [0.0, 6.0, 12.0, 18.0, 24.0])
    return out.select("channel", "samples", "outcome", "saturated", "detected_plateaus", "sweep_levels", F.size("points").alias("n_points"),
                      F.aggregate("points", F.lit(0.0), lambda t, q: t + q.raw_avg * q.true_db).alias("weight"),
                      F.aggregate("unresolved_db", F.lit(0.0), lambda t, q: t + q).alias("unresolved"))


def pair_steps(spark, sf):
    """A customer's orders in order as the levels of a sweep that starts at one of the first three."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("channel"), "o_orderkey", F.col("o_totalprice").alias("value"))
    place = F.row_number().over(W.partitionBy("channel").orderBy("o_orderkey")) - 1
    levels = o.withColumn("level_no", place).withColumn("sweep_start", F.col("channel") % 3)
    out = st.pair_steps(levels, KEYS, [0.0, 6.0, 12.0, 18.0])
    return out.select("channel", F.size("points").alias("n"), F.try_element_at("points", F.lit(1)).true_db.alias("lowest_db"),
                      F.round(F.aggregate("points", F.lit(0.0), lambda t, q: t + q.raw_avg * q.true_db), 4).alias("weight"))


def classify_outcome(spark, sf):
    per = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("channel")).agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(F.col("o_totalprice") > 150_000).alias("levels"), F.max("o_totalprice").alias("top"))
    outcome = st.classify_outcome(F.col("top") > 400_000, F.col("samples"), F.col("levels"), F.col("levels") >= 8)
    return per.select("channel", outcome.alias("outcome"))


def demux_words(spark, sf):
    words = spark.createDataFrame([(0, "L_RCVR1", 0), (1, "R_RCVR1", 7), (2, "C_RCVR1", 63)], "ord int, name string, word int")
    frames = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("words"))
    return fr.pick_words(frames, words).select("vec_id", "name", F.round(F.col("raw").cast("double"), 6).alias("raw"))


def resolve_attributes(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 100).alias("bits_in_frame"), F.when(F.col("p_size") % 2 == 1, F.col("p_retailprice") / 100).alias(
        "data_rate_mbps"), (F.col("p_size") * 1000.0).alias("bit_rate_bps"), (F.col("p_size") % 4).alias("min_syncs"))
    return config.resolve_attributes(p).select("p_partkey", F.round("bit_ticks", 6).alias("bit_ticks"), "min_syncs", "word_len", "words_in_frame")


def resolve_sync(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 7 == 0, F.col("p_brand")).otherwise(
        F.left(F.md5(F.col("p_name").cast("binary")), F.col("p_size") % 16 + 1)).alias("sync_hex"),
        F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 11 == 0, "xyz").otherwise("FF00ff").alias("mask_hex"))
    return config.resolve_sync(p).select("p_partkey", "sync_error", "sync_len", "pattern", "mask")


def validate_streams(spark, sf):
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("stream_id"), F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_brand")).alias("sync_hex"), F.lit("FF").alias("mask_hex"),
        (F.col("p_size") * 10).alias("bits_in_frame"), F.col("p_retailprice").alias("data_rate_mbps"), (F.col("p_size") % 4).alias("period_idx"),
        F.when(F.col("p_size") % 2 == 0, "receiver").otherwise("lock").alias("mode"), (F.col("p_size") % 3).alias("polarity"), (F.col("p_size") % 6).alias("slope_idx"),
        F.col("p_retailprice").alias("scale_db_per_v"), (F.col("p_size") * 3).alias("num_receivers"), F.col("p_size").alias("receiver_channels"))
    return config.validate_streams(p)


def resolve_word_map(spark, sf):
    maps = table(spark, sf, "nation").select(F.concat(F.lit("m"), F.col("n_regionkey").cast("string")).alias("map_id"), F.col("n_nationkey").alias("ord"),
                                             F.col("n_name").alias("section"), (F.col("n_nationkey") + 1).alias("word"))
    streams = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("stream_id"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("m"), (F.col("s_nationkey") % 7).cast("string"))).alias("explicit_map"),
        F.when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("m"), (F.col("s_nationkey") % 5).cast("string"))).alias("default_map"),
        (F.col("s_nationkey") + 2).alias("words_in_frame"), (F.col("s_suppkey") % 4).cast("int").alias("num_receivers"), F.lit(4).alias("receiver_channels"))
    return config.resolve_word_map(streams, maps).groupBy("stream_id", "source", "error", "warning").agg(
        F.count("name").alias("n"), F.coalesce(F.sum("word"), F.lit(0)).alias("words"), F.max("name").alias("last"))


def hit_grid(spark, sf):
    hits = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("stream_id"), (F.col("l_orderkey") * 4).alias("bit")).distinct()
    return bits.hit_grid(hits.withColumn("chunk", F.expr("bit div 100000"))).select("stream_id", "period", "on_grid")


def channel_catalog(spark, sf):
    s = table(spark, sf, "supplier")
    n = F.col("s_suppkey").cast("string")

    def code(name: str, value) -> DataFrame:
        return s.select(F.lit(0).alias("source_id"), F.concat(F.lit(f"R-1\\{name}-"), n).alias("code"), value.cast("string").alias("value")).where("value is not null")

    attrs = code("TK1", F.when(F.col("s_suppkey") % 9 == 0, F.lit("x")).otherwise(n))
    for name, value in (("CHE", F.when(F.col("s_suppkey") % 5 == 0, F.lit("F")).when(F.col("s_suppkey") % 5 == 1, F.lit("T"))),
                        ("DSI", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name"))), ("CDLN", F.concat(F.lit("L"), n)),
                        ("CDT", F.when(F.col("s_suppkey") % 4 == 0, F.lit("11")).otherwise(F.lit("09")))):
        attrs = attrs.unionByName(code(name, value))
    p = s.select(F.lit(0).alias("source_id"), F.concat(F.lit("P-"), n).alias("p"), F.concat(F.lit("L"), n).alias("link"), (F.col("s_nationkey") * 1000).cast("string").alias("rate"))
    attrs = attrs.unionByName(p.select("source_id", F.concat("p", F.lit("\\DLN")).alias("code"), F.col("link").alias("value"))).unionByName(
        p.select("source_id", F.concat("p", F.lit("\\D2")).alias("code"), F.col("rate").alias("value")))
    return recording.channel_catalog(attrs)


def page_attributes(spark, sf):
    """Pages cut into lines at tags: every line with a colon is an attribute."""
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("source_id"), F.regexp_replace("html", "[<>]", "\n").alias("text"))
    return recording.explode_attributes(pages).groupBy("source_id").agg(F.count(F.lit(1)).alias("codes"), F.sum(F.length("value")).alias("size"))


def route_packets(spark, sf):
    rows = [(f"s{i}", f) for i, f in enumerate(["A", "A", "N"])]
    streams = spark.createDataFrame(rows, "stream_id string, l_returnflag string")
    out = recording.route_packets(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"), streams, ["l_returnflag"])
    return out.groupBy("stream_id").agg(F.count(F.lit(1)).alias("packets"), F.sum("l_quantity").alias("total"))


def build_series(spark, sf):
    """Orders as streams, line items as their windows and channels."""
    li = table(spark, sf, "lineitem")
    streams = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("stream_id"), F.lit(0).alias("source_id"), F.col("o_orderkey").alias("channel_id"), F.lit("").alias("label"),
        F.when(F.col("o_orderkey") % 2 == 0, "lock").otherwise("receiver").alias("mode"), F.lit(0).alias("job_index"))
    samples = li.groupBy(F.col("l_orderkey").alias("stream_id"), F.col("l_linenumber").cast("double").alias("t_abs")).agg(
        F.max("l_quantity").alias("lock_pct"), F.max("l_partkey").alias("missed"))
    channels = samples.select("stream_id", F.col("t_abs").cast("int").alias("ord"), F.concat(F.lit("L_RCVR"), F.col("t_abs").cast("int").cast("string")).alias("name"),
                              "t_abs", F.col("lock_pct").alias("value"))
    return series.build_series(samples, channels, streams).groupBy("metric").agg(
        F.count(F.lit(1)).alias("points"), F.round(F.sum("value"), 4).alias("total"), F.max("name").alias("last"), F.max("receiver").alias("receivers"))


def channel_index(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return series.channel_index(li, ["l_orderkey"], "l_linenumber")


def replace_streams(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    new = o.where("o_orderkey % 3 = 0")
    return series.replace_streams(o, new.withColumn("o_totalprice", F.lit(0.0)), ["o_orderkey"])


def assign_stream_orders(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("position"), F.lit(0).alias("source_id"), F.concat(F.lit("s"), F.expr("c_custkey div 2").cast("string")).alias("stream_label"),
        F.when((F.col("c_custkey") % 2 == 0) & (F.col("c_nationkey") < 12), "level").otherwise("lock").alias("metric"), F.col("c_nationkey").alias("stream_order"))
    return series.assign_stream_orders(c).select("position", "metric", "stream_order")


def attach_profiles(spark, sf):
    words = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_nationkey").alias("word"))
    point = F.struct(F.lit(0.0).alias("raw_avg"), F.col("n_regionkey").cast("double").alias("true_db"))
    profiles = table(spark, sf, "nation").select(F.expr("n_nationkey div 2").alias("word"), F.col("n_nationkey").alias("profile_no"), (F.col("n_regionkey") > 1).alias("valid"), F.array(point).alias("points"))
    return calibrate.attach_profiles(words, profiles).select("ord", "word", F.try_element_at("points", F.lit(1)).true_db.alias("db"))


QUERIES = {
    "E2_clip": clip, "E3_derivative": derivative, "E4_live_sigma": live_sigma, "E5_mark_stable": mark_stable, "E6_plateaus": plateaus, "E7_plateau_levels": plateau_levels,
    "E8_coalesce_levels": coalesce_levels, "E9_median_gap": median_gap, "E10_monotonic_runs": monotonic_runs, "E11_select_sweep": select_sweep,
    "E1_extraction_period": extraction_period, "E12_detect_steps": detect_steps, "E12_step_sweep": step_sweep, "E13_pair_steps": pair_steps,
    "E16_classify_outcome": classify_outcome, "D5_demux_words": demux_words, "D6_resolve_attributes": resolve_attributes,
    "P1_resolve_sync": resolve_sync, "P2_validate_streams": validate_streams, "P5_resolve_word_map": resolve_word_map, "B7_hit_grid": hit_grid,
    "S2_channel_catalog": channel_catalog, "S2_page_attributes": page_attributes, "S5_route_packets": route_packets, "T1_build_series": build_series,
    "T3_channel_index": channel_index, "T5_replace_streams": replace_streams, "T10_assign_stream_orders": assign_stream_orders, "C3_attach_profiles": attach_profiles,
}

_R = "r AS (SELECT vec_id AS channel, unnest(embedding)::DOUBLE AS raw, generate_subscripts(embedding, 1) - 1 AS idx FROM embeddings)"
_D = f"{_R}, d AS (SELECT * FROM (SELECT channel, idx, raw, lead(raw) OVER (PARTITION BY channel ORDER BY idx) AS nx, lead(raw) OVER (PARTITION BY channel ORDER BY idx) - raw AS d FROM r) WHERE nx IS NOT NULL)"
_ST = f"{_R}, s AS (SELECT channel, idx, raw, NOT (coalesce(abs(raw - lag(raw) OVER w) > {THRESHOLD}, false) OR coalesce(abs(lead(raw) OVER w - raw) > {THRESHOLD}, false)) AS stable FROM r WINDOW w AS (PARTITION BY channel ORDER BY idx))"
_PL = f"{_ST}, i AS (SELECT *, sum((NOT stable)::INT) OVER (PARTITION BY channel ORDER BY idx) AS g FROM s), pl AS (SELECT channel, min(idx) AS b, max(idx) + 1 AS e FROM i WHERE stable GROUP BY channel, g HAVING count(*) >= {CONFIRM})"
_LV = f"{_PL}, lv AS (SELECT p.channel, b, e, avg(raw) AS v FROM pl p JOIN r ON r.channel = p.channel AND r.idx < e AND r.idx >= greatest(b, e - {CONFIRM}) GROUP BY p.channel, b, e)"
_RUNS = """t AS (SELECT o_custkey AS channel, o_orderkey, row_number() OVER w - 1 AS n, o_totalprice - lag(o_totalprice) OVER w AS st FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
    q AS (SELECT *, CASE WHEN st > 20000 THEN 1 WHEN st < -20000 THEN -1 ELSE 0 END AS dir FROM t), u AS (SELECT *, (dir <> lag(dir, 1, 0) OVER (PARTITION BY channel ORDER BY n))::INT AS f FROM q),
    x AS (SELECT *, sum(f) OVER (PARTITION BY channel ORDER BY n) AS g FROM u), runs AS (SELECT channel, min(n) - 1 AS run_begin, max(n) AS run_end, any_value(dir) AS direction, max(n) - min(n) + 2 AS levels FROM x WHERE dir <> 0 GROUP BY channel, g)"""
_HEX = "CASE WHEN p_size % 7 = 0 THEN p_brand ELSE left(md5(p_name), p_size % 16 + 1) END"

ORACLES = {
    "E12_step_sweep": """WITH c AS (SELECT c_custkey AS channel, c_custkey % 4 AS kind, CASE WHEN c_custkey % 4 = 3 THEN 5 ELSE 1 + c_custkey // 4 % 7 END AS n, 2000 + c_custkey % 50 * 10 AS base FROM customer),
        o AS (SELECT *, CASE WHEN n = 1 THEN 'flat' WHEN kind = 3 THEN 'calibrated' WHEN n < 5 THEN 'too_few_plateaus' WHEN kind = 2 THEN 'no_monotonic_sweep' ELSE 'calibrated' END AS outcome, CASE WHEN kind = 3 THEN 4 ELSE n END AS levels FROM c)
        SELECT channel, 15 * n AS samples, outcome, kind = 3 AS saturated, levels AS detected_plateaus, CASE WHEN outcome = 'calibrated' THEN levels ELSE 0 END AS sweep_levels, CASE WHEN outcome <> 'calibrated' THEN 0 WHEN kind = 3 THEN 3 ELSE 5 END AS n_points,
        CASE WHEN outcome <> 'calibrated' THEN 0.0 ELSE list_sum([6.0 * a * (base + 1000 * CASE kind WHEN 0 THEN n - 5 + a WHEN 1 THEN 4 - a ELSE a END) FOR a IN range(0, CASE WHEN kind = 3 THEN 3 ELSE 5 END)]) END AS weight,
        CASE WHEN kind = 3 THEN 42.0 ELSE 0.0 END AS unresolved FROM o""",
    "E13_pair_steps": """WITH l AS (SELECT o_custkey AS channel, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 - o_custkey % 3 AS a FROM orders)
        SELECT channel, count(*) AS n, arg_min(6.0 * a, (v, a)) AS lowest_db, round(sum(v * 6.0 * a), 4) AS weight FROM l WHERE a BETWEEN 0 AND 3 GROUP BY channel""",
    "E16_classify_outcome": """WITH p AS (SELECT o_custkey AS channel, count(*) AS s, count(*) FILTER (o_totalprice > 150000) AS l, max(o_totalprice) AS t FROM orders GROUP BY 1)
        SELECT channel, CASE WHEN t > 400000 THEN 'calibrated' WHEN s < 2 THEN 'no_data' WHEN l <= 1 THEN 'flat' WHEN l >= 8 THEN 'no_monotonic_sweep' ELSE 'too_few_plateaus' END AS outcome FROM p""",
    "T1_build_series": """WITH s AS (SELECT l_orderkey AS k, l_linenumber AS n, max(l_quantity) AS q, max(l_partkey) AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2)
        SELECT 'lock' AS metric, count(*) AS points, round(sum(q), 4) AS total, max('Ch ' || k) AS last, 0 AS receivers FROM s WHERE k % 2 = 0 HAVING count(*) > 0
        UNION ALL SELECT 'missed', count(*), round(sum(p::DOUBLE), 4), max('Ch ' || k), 0 FROM s WHERE k % 2 = 0 HAVING count(*) > 0
        UNION ALL SELECT 'level', count(*), round(sum(q), 4), max(k || ' - Ch ' || k || ' L_RCVR' || n), max(n) FROM s WHERE k % 2 = 1 HAVING count(*) > 0""",
    "P5_resolve_word_map": """WITH m AS (SELECT 'm' || n_regionkey AS id, n_nationkey AS w, n_name FROM nation),
        s AS (SELECT s_suppkey AS k, s_suppkey % 3 AS t, 'm' || (s_nationkey % 7) AS ex, 'm' || (s_nationkey % 5) AS de, s_nationkey + 2 AS wif, s_suppkey % 4 AS nr FROM supplier),
        j AS (SELECT k, t, wif, nr, count(w) AS found, count(*) FILTER (w + 1 > wif - 1) AS bad, sum(w) AS words, max(n_name) AS last FROM s LEFT JOIN m ON (t = 0 AND id = ex) OR (t = 1 AND id = de) GROUP BY k, t, wif, nr),
        c AS (SELECT *, CASE WHEN t = 0 THEN 'explicit' WHEN t = 1 AND found > 0 AND bad = 0 THEN 'default' ELSE 'sequence' END AS source FROM j),
        e AS (SELECT *, CASE WHEN source = 'explicit' AND found = 0 THEN 'not_found' WHEN source = 'explicit' AND bad > 0 THEN 'bad_map' WHEN source = 'sequence' AND NOT (nr > 0 AND nr * 4 < wif) THEN 'grid_too_large' END AS error FROM c)
        SELECT k AS stream_id, source, error, CASE WHEN t = 1 AND found > 0 AND bad > 0 THEN 'default_refused' END AS warning, CASE WHEN error IS NOT NULL THEN 0 WHEN source = 'sequence' THEN nr * 4 ELSE found END AS n,
        CASE WHEN error IS NOT NULL THEN 0 WHEN source = 'sequence' THEN nr * 4 * (nr * 4 - 1) // 2 ELSE words END AS words, CASE WHEN error IS NULL THEN CASE WHEN source = 'sequence' THEN 'R_RCVR' || nr ELSE last END END AS last FROM e""",
    "S2_page_attributes": r"""WITH x AS (SELECT page_id, string_split(replace(regexp_replace(html, '[<>]', chr(10), 'g'), chr(13), chr(10)), chr(10)) AS ls, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS sp FROM pages),
        l AS (SELECT page_id, sp, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM x), t AS (SELECT page_id, pos, sp, trim(line, sp) AS line FROM l),
        p AS (SELECT page_id, pos, trim(split_part(line, ':', 1), sp) AS code, rtrim(trim(substr(line, instr(line, ':') + 1), sp), ';') AS value FROM t WHERE contains(line, ':')),
        v AS (SELECT page_id, code, arg_max(value, pos) AS value FROM p GROUP BY 1, 2) SELECT page_id AS source_id, count(*) AS codes, sum(length(value))::BIGINT AS size FROM v GROUP BY 1""",
    "E2_clip": f"WITH {_R} SELECT channel, idx - 10 AS idx, round(raw, 6) AS raw FROM r WHERE idx >= 10 AND idx < 44",
    "E3_derivative": f"WITH {_D} SELECT channel, idx, round(d, 6) AS d FROM d",
    "E4_live_sigma": f"WITH {_D}, m AS (SELECT channel, min(raw) AS lo, max(raw) AS hi FROM r GROUP BY channel), u AS (SELECT channel, d FROM d JOIN m USING (channel) WHERE NOT (raw = nx AND (raw = lo OR raw = hi))), c AS (SELECT channel, median(d) AS med FROM u GROUP BY channel) SELECT channel, round(1.4826 * median(abs(d - med)), 6) AS sigma FROM u JOIN c USING (channel) GROUP BY channel",
    "E5_mark_stable": f"WITH {_ST} SELECT channel, idx, stable FROM s",
    "E6_plateaus": f"WITH {_PL} SELECT channel, b AS \"begin\", e AS \"end\" FROM pl",
    "E7_plateau_levels": f"WITH {_LV} SELECT channel, b AS \"begin\", e AS \"end\", round(v, 6) AS value FROM lv",
    "E8_coalesce_levels": f"WITH {_LV}, a AS (SELECT *, coalesce(abs(v - lag(v) OVER (PARTITION BY channel ORDER BY b)) > 0.05, true)::INT AS f FROM lv), g AS (SELECT *, sum(f) OVER (PARTITION BY channel ORDER BY b) AS g FROM a) SELECT channel, min(b) AS \"begin\", max(e) AS \"end\", round(arg_max(v, b), 6) AS value FROM g GROUP BY channel, g",
    "E9_median_gap": f"WITH {_LV}, a AS (SELECT channel, abs(v - lag(v) OVER (PARTITION BY channel ORDER BY b)) AS gap FROM lv) SELECT channel, round(coalesce(median(gap), 0), 6) AS median_gap FROM a GROUP BY channel",
    "E10_monotonic_runs": f"WITH {_RUNS} SELECT * FROM runs",
    "E11_select_sweep": f"WITH {_RUNS} SELECT channel, arg_min(run_end, run_begin) - 2 AS sweep_start, arg_min(levels, run_begin) AS sweep_levels FROM runs WHERE levels >= 3 GROUP BY channel",
    "E1_extraction_period": "SELECT p_partkey, round(least(0.2, greatest(0.1, 10 * p_size * 64 * (p_retailprice / 10) / 1e7)), 6) AS period_s FROM part",
    "D5_demux_words": "SELECT vec_id, name, round(embedding[word + 1]::DOUBLE, 6) AS raw FROM embeddings, (VALUES ('L_RCVR1', 0), ('R_RCVR1', 7), ('C_RCVR1', 63)) w(name, word)",
    "D6_resolve_attributes": "SELECT p_partkey, round(CASE WHEN p_size % 2 = 1 AND p_retailprice > 0 THEN 1e7 / (p_retailprice / 100 * 1e6) ELSE 1e7 / (p_size * 1000.0) END, 6) AS bit_ticks, greatest(1, p_size % 4) AS min_syncs, 16 AS word_len, ceil(p_size * 100 / 16.0)::INT AS words_in_frame FROM part",
    "P1_resolve_sync": f"""WITH p AS (SELECT p_partkey, {_HEX} AS h, CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 11 = 0 THEN 'xyz' ELSE 'FF00ff' END AS m FROM part),
        e AS (SELECT *, CASE WHEN NOT regexp_full_match(h, '[0-9A-Fa-f]+') THEN 'pattern_invalid' WHEN m = 'xyz' THEN 'mask_invalid' END AS err FROM p), v AS (SELECT *, CASE WHEN err IS NULL THEN ('0x' || h)::UBIGINT::HUGEINT END AS u, CASE WHEN err IS NULL THEN length(h) * 4 END AS len FROM e)
        SELECT p_partkey, err AS sync_error, len AS sync_len, CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS pattern,
        CASE WHEN err IS NOT NULL THEN NULL WHEN m <> '' THEN 16711935 WHEN len = 64 THEN -1 ELSE (1::HUGEINT << len) - 1 END AS mask FROM v""",
    "P2_validate_streams": """WITH p AS (SELECT *, p_size % 2 = 0 AS rc FROM part), b AS (SELECT p_partkey AS stream_id, unnest([CASE WHEN p_size % 5 = 0 THEN '0 pattern_required' END, CASE WHEN p_size % 5 <> 0 THEN '1 pattern_not_hex' END,
        CASE WHEN p_size * 10 NOT BETWEEN 64 AND 65536 THEN '3 bits_in_frame' END, CASE WHEN p_retailprice NOT BETWEEN 0 AND 1000 THEN '4 data_rate' END, CASE WHEN p_size % 4 > 2 THEN '5 period' END, CASE WHEN rc AND p_size % 3 > 1 THEN '6 polarity' END,
        CASE WHEN rc AND p_size % 6 > 3 THEN '7 slope' END, CASE WHEN rc AND p_retailprice NOT BETWEEN 0.001 AND 999.999 THEN '8 scale' END, CASE WHEN rc AND p_size * 3 NOT BETWEEN 1 AND 100 THEN '9 receivers' END, CASE WHEN rc AND p_size NOT BETWEEN 1 AND 100 THEN '10 channels' END]) AS r FROM p)
        SELECT stream_id, split_part(r, ' ', 1)::INT AS rule_no, split_part(r, ' ', 2) AS rule FROM b WHERE r IS NOT NULL""",
    "B7_hit_grid": """WITH h AS (SELECT DISTINCT l_returnflag AS s, l_orderkey * 4 AS bit FROM lineitem), d AS (SELECT s, bit, bit - lag(bit) OVER (PARTITION BY s ORDER BY bit) AS dl FROM h), c AS (SELECT s, dl, count(*) AS n, min(bit) AS seen FROM d WHERE dl IS NOT NULL GROUP BY s, dl),
        t AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY n DESC, seen) AS pl FROM c QUALIFY pl <= 5), g AS (SELECT h.s, pl, dl, bit % dl AS res, count(*) AS n FROM h JOIN t USING (s) GROUP BY h.s, pl, dl, res), m AS (SELECT s, pl, dl, max(n) AS n FROM g GROUP BY s, pl, dl)
        SELECT s AS stream_id, dl AS period, n AS on_grid FROM m QUALIFY row_number() OVER (PARTITION BY s ORDER BY n DESC, pl) = 1""",
    "S2_channel_catalog": "SELECT 0 AS source_id, s_suppkey AS channel_id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'L' || s_suppkey END AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'TIMEIN' ELSE 'PCMIN' END AS type, true AS enabled, s_nationkey * 1000.0::DOUBLE AS bit_rate_bps FROM supplier WHERE s_suppkey % 9 <> 0 AND s_suppkey % 5 <> 0",
    "S5_route_packets": "SELECT stream_id, count(*) AS packets, sum(l_quantity) AS total FROM lineitem JOIN (VALUES ('s0', 'A'), ('s1', 'A'), ('s2', 'N')) t(stream_id, f) ON f = l_returnflag GROUP BY stream_id",
    "T3_channel_index": "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS channel FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)",
    "T5_replace_streams": "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders",
    "T10_assign_stream_orders": """WITH c AS (SELECT c_custkey AS position, 's' || (c_custkey // 2) AS l, CASE WHEN c_custkey % 2 = 0 AND c_nationkey < 12 THEN 'level' ELSE 'lock' END AS metric, c_nationkey AS o FROM customer),
        k AS (SELECT l, arg_max(o, position) AS known FROM c WHERE metric = 'level' GROUP BY l), f AS (SELECT l, row_number() OVER (ORDER BY min(position)) - 1 + (SELECT max(o) + 1 FROM c) AS fresh FROM c WHERE metric = 'lock' AND l NOT IN (SELECT l FROM k) GROUP BY l)
        SELECT position, metric, CASE WHEN metric = 'level' THEN o ELSE coalesce(known, fresh) END AS stream_order FROM c LEFT JOIN k USING (l) LEFT JOIN f USING (l)""",
    "C3_attach_profiles": "WITH p AS (SELECT n_nationkey // 2 AS word, arg_min(n_regionkey, n_nationkey) AS reg FROM nation GROUP BY 1) SELECT s_suppkey AS ord, s_nationkey AS word, CASE WHEN reg > 1 THEN reg::DOUBLE END AS db FROM supplier LEFT JOIN p ON word = s_nationkey",
}
