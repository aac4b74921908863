"""Contracts and small functions over the recorded tables, and the whole way from frames to decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions import clocks
from tempora.functions import text as tx
from tempora.functions import vectors as v
from tempora.operators import checks, corpus, packets, rules
from tempora.operators import learning as ln
from tempora.operators import sequences as sq
from tempora.plans import sequence_queries as known
from tempora.sources import artifacts, views
from tempora.sources.views import sql

DAY_US = 86_400_000_000
AS_OF_US = 15 * DAY_US
SHARES = (0.0, 0.25, 0.5, 0.75, 1.0)


def clock_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.frames(spark, sf_dir)
    ticks = F.col("frame_index") * 7 + F.col("k")
    return f.select("event_id", clocks.micros(ticks, F.lit(128)).alias("ticks_us"), clocks.source_time(F.col("pts_us"), F.col("k"), F.lit(DAY_US)).alias("source_us"), clocks.replay_position(F.col("pts_us"), F.lit(DAY_US), 2.5).alias("position_us"))


def state_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views.observations(views.frames(spark, sf_dir))
    word = clocks.state_word(F.col("value"))
    return o.select("observation_id", word.alias("word"), clocks.state_value(word).alias("back"))


def question_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.frames(spark, sf_dir)
    return f.select("event_id", tx.question(F.col("event_type"), F.lit("open"), F.col("pts_us"), F.col("pts_us") + 5).alias("question"))


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.class_weights(views.chunks(spark, sf_dir), "label").select("label", "n", F.round("weight", 6).alias("weight"))


def feature_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ln.feature_scales(views.chunks(spark, sf_dir).withColumn("vector", F.transform("vector", lambda x: x.cast("double"))), "vector")
    return found.select(F.col("place").cast("long").alias("place"), F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


def parity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of two digits against the vectors themselves: the largest difference, and whether it is small enough."""
    c = views.chunks(spark, sf_dir).withColumn("short", F.transform("vector", lambda x: F.round(x.cast("double"), 2)))
    gap = v.largest_difference(F.col("vector"), F.col("short"))
    return c.select("chunk_id", F.round(gap, 6).alias("largest"), (gap <= 0.004999).alias("passed"))


def profile_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "part")
    rules_ = checks.range_rules({"p_size": (1, 40), "p_retailprice": (900.0, 1500.0)}) | checks.workload_rules(["p_size", "p_retailprice"], 40_000.0)
    return checks.violations(p, rules_, "p_partkey")


def rule_table_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as rules of four kinds, of which one is unknown, with a field too many or none at every third."""
    n = views.table(spark, sf_dir, "nation")
    kind = F.element_at(F.array(*map(F.lit, ("state_at_event", "before", "no_event_in", "always"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    third = F.col("n_nationkey") % 3 == 0
    r = n.select(
        F.col("n_name").alias("rule_id"),
        kind.alias("kind"),
        F.lit("door").alias("trigger"),
        F.when((kind == "state_at_event") | third, F.lit(True)).alias("expected"),
        F.when(kind == "before", F.lit("lamp")).alias("second"),
        F.when((kind == "no_event_in") & ~third, F.lit(5).cast("long")).alias("end_us"),
    )
    return checks.violations(r, checks.rule_table_rules(), "rule_id")


def detections_by_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame_id"))
    found = views.detections(spark, sf_dir).join(orders, "frame_id", "left_semi").where("score >= 0.9")
    return artifacts.detections_by_frame(orders, found).select("frame_id", F.size("boxes").cast("long").alias("boxes"), F.array_max(F.transform("boxes", lambda b: b["score"])).alias("best"))


def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    parts = [c.where(f"c_custkey % {k} = 0").withColumn("source", F.lit(name)) for k, name in ((2, "even"), (3, "third"), (5, "fifth"))]
    return artifacts.merged_sources(parts, ["c_custkey"], ["c_name"], "source").select("c_custkey", "c_name", F.array_join("aliases", ",").alias("aliases"))


def frame_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as the frames of a folder, beside files of other names."""
    n = views.table(spark, sf_dir, "nation")
    name = lambda end: F.format_string(f"/run/Action_%d_0_{end}", F.col("n_nationkey").cast("long"))
    paths = n.select(F.explode(F.array(name("normal.png"), name("graph.json"), F.concat(F.lit("/run/"), "n_name"))).alias("path"))
    return artifacts.frame_files(paths)


def review_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views.table(spark, sf_dir, "orders")
    seen = F.when(F.col("o_orderstatus") == "O", "visible").when(F.col("o_orderstatus") == "F", "not_visible").otherwise("partly_visible")
    return packets.review_violations(o.select(F.col("o_orderkey").alias("sample_id"), seen.alias("visibility"), F.when(F.col("o_orderkey") % 3 != 0, F.lit("0,0,5,5")).alias("rectangle")))


def response_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, key = views.table(spark, sf_dir, "customer"), F.col("c_custkey")
    cites = F.when(key % 3 == 0, F.array().cast("array<string>")).when(key % 5 == 0, F.array("c_name", F.lit("elsewhere"))).when(key % 7 == 0, F.array("c_name", "c_name")).otherwise(F.array("c_name"))
    answers = c.select(key.alias("packet_id"), F.lit("yes").alias("value"), cites.alias("citations"), F.repeat(F.lit("x"), F.when(key % 4 == 0, 2001).otherwise(2000)).alias("explanation"))
    return packets.response_violations(answers, c.select(key.alias("packet_id"), F.array("c_name", F.lit("spare")).alias("evidence_ids")))


def interventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation in other orders, and those at quarters of the way."""
    turns = views.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    joined = lambda c: F.array_join(c.cast("array<string>"), ",")
    return turns.select("conv_id", joined(corpus.reversed_frames(F.col("t"))).alias("reversed"), joined(corpus.repeated_first(F.col("t"))).alias("repeated"), joined(corpus.relative_positions(F.size("t"), SHARES)).alias("positions"))


def set_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of labelled documents, those of quality and the toxic ones: sizes of what sets make of them, and what holds."""
    labels = views.table(spark, sf_dir, "labels")
    good, toxic = labels.where("quality = 1").select("doc_id"), labels.where("toxic = 1").select("doc_id")
    sizes = [("union", good.union(toxic).distinct()), ("difference", good.subtract(toxic)), ("intersection", good.intersect(toxic)), ("outside", labels.select("doc_id").subtract(good.union(toxic)))]
    out = None
    for name, rows in sizes:
        own = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n", (F.col("n") == 0).alias("empty"))
        out = own if out is None else out.unionByName(own)
    return out


def released_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.frames(spark, sf_dir)
    e = f.select("event_id", "pts_us", (F.col("pts_us") + F.col("k") - 5).alias("dependency_end_us"), (F.col("pts_us") + 50).alias("available_us"), F.lit(DAY_US).alias("offset_us"))
    return packets.released(e, AS_OF_US).select("event_id")


def replay_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From frames to decisions: departures are triggers, the state at their time is asked for, and what stays unknown is looked into."""
    f = views.frames(spark, sf_dir)
    gone = sq.departures(f, F.col("value") >= 20)
    first = f.select("episode_id", F.col("frame_index").alias("first"), F.col("event_id").alias("trigger_id"), "k")
    t = gone.join(first, ["episode_id", "first"])
    clock = {"available_us": F.col("available_us"), "committed_us": F.col("available_us") + views.COMMIT_DELAY_US}
    triggers = t.select("trigger_id", "episode_id", F.col("event_us").alias("lo_us"), F.col("event_us").alias("hi_us"), *[c.alias(n) for n, c in clock.items()])
    answers = t.select("episode_id", "event_us", (F.col("k") >= 50).alias("value"), *[c.alias(n) for n, c in clock.items()])
    return rules.investigated(triggers, views.observations(f), answers, triggers.where("trigger_id % 2 = 0"), False, AS_OF_US, ["episode_id"])


QUERIES = {
    f.__name__: f
    for f in (clock_functions, state_words, question_texts, class_weights, feature_scales, parity_gate, profile_violations, rule_table_violations, detections_by_frame, merged_sources, frame_files, review_violations, response_violations, interventions, set_gates, released_evidence, replay_decisions)
}

_KIND = "CASE n_nationkey % 4 WHEN 0 THEN 'state_at_event' WHEN 1 THEN 'before' WHEN 2 THEN 'no_event_in' ELSE 'always' END"

ORACLE_SQL = {
    "clock_functions": sql(
        "frames",
        body=f""", t AS (SELECT *, (frame_index * 7 + k) * 1000000 AS n FROM frames), q AS (SELECT *, n // 128 AS q, n % 128 AS r FROM t)
        SELECT event_id, q + CASE WHEN r > 64 OR (r = 64 AND q % 2 = 1) THEN 1 ELSE 0 END AS ticks_us, k * {DAY_US} + pts_us AS source_us, CASE WHEN pts_us >= {DAY_US} THEN CAST(floor((pts_us - {DAY_US}) * 2.5) AS BIGINT) END AS position_us FROM q""",
    ),
    "state_words": sql("observations", body=" SELECT observation_id, CASE WHEN value IS NULL THEN 'unknown' WHEN value THEN 'open' ELSE 'closed' END AS word, value AS back FROM observations"),
    "question_texts": sql("frames", body=" SELECT event_id, 'Is the ' || event_type || ' open?' || chr(10) || 'Interval: ' || pts_us || ' to ' || (pts_us + 5) || ' us.' || chr(10) || 'Answer yes, no or unknown, and cite what you saw.' AS question FROM frames"),
    "class_weights": "WITH n AS (SELECT CAST(label AS INTEGER) AS label, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY 1) SELECT label, n, round((SELECT sum(n) FROM n) / ((SELECT count(*) FROM n) * n), 6) AS weight FROM n",
    "feature_scales": "WITH c AS (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS place FROM embeddings) SELECT place, round(avg(x), 6) AS mean, round(greatest(stddev_pop(x), 0.01), 6) AS scale FROM c GROUP BY place",
    "parity_gate": "WITH c AS (SELECT vec_id AS chunk_id, list_max([abs(x::DOUBLE - round(x::DOUBLE, 2)) FOR x IN embedding]) AS gap FROM embeddings) SELECT chunk_id, round(gap, 6) AS largest, gap <= 0.004999 AS passed FROM c",
    "profile_violations": """SELECT p_partkey, 'p_size_range' AS rule FROM part WHERE p_size NOT BETWEEN 1 AND 40 UNION ALL SELECT p_partkey, 'p_retailprice_range' FROM part WHERE p_retailprice NOT BETWEEN 900 AND 1500
        UNION ALL SELECT p_partkey, 'workload' FROM part WHERE p_size * p_retailprice > 40000""",
    "rule_table_violations": f"""WITH r AS (SELECT n_name AS rule_id, n_nationkey % 3 = 0 AS third, {_KIND} AS kind FROM nation)
        SELECT rule_id, 'identity' AS rule FROM r WHERE NOT regexp_full_match(rule_id, '[A-Za-z0-9_-]+') UNION ALL SELECT rule_id, 'kind' FROM r WHERE kind = 'always'
        UNION ALL SELECT rule_id, 'fields' FROM r WHERE kind = 'always' OR (third AND kind <> 'state_at_event')""",
    "detections_by_frame": sql("detections", body=" SELECT o_orderkey AS frame_id, count(frame_id) AS boxes, max(score) AS best FROM orders LEFT JOIN detections ON frame_id = o_orderkey AND score >= 0.9 GROUP BY o_orderkey"),
    "merged_sources": "SELECT c_custkey, c_name, concat_ws(',', CASE WHEN c_custkey % 2 = 0 THEN 'even' END, CASE WHEN c_custkey % 5 = 0 THEN 'fifth' END, CASE WHEN c_custkey % 3 = 0 THEN 'third' END) AS aliases FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0 OR c_custkey % 5 = 0",
    "frame_files": "SELECT CAST(n_nationkey AS BIGINT) AS index, '/run/Action_' || n_nationkey || '_0_normal.png' AS rgb, '/run/Action_' || n_nationkey || '_0_graph.json' AS graph FROM nation",
    "review_violations": "SELECT o_orderkey AS sample_id, 'rectangle' AS rule FROM orders WHERE (o_orderstatus <> 'F') <> (o_orderkey % 3 <> 0)",
    "response_violations": "SELECT c_custkey AS packet_id, 'citations' AS rule FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0 OR c_custkey % 7 = 0 UNION ALL SELECT c_custkey, 'explanation' FROM customer WHERE c_custkey % 4 = 0",
    "interventions": """WITH t AS (SELECT conv_id, list(turn ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
        SELECT conv_id, array_to_string(list_reverse(t), ',') AS reversed, array_to_string([t[1] FOR x IN t], ',') AS repeated, array_to_string(list_sort(list_distinct([CAST(round_even((len(t) - 1) * s, 0) AS BIGINT) FOR s IN [0.0, 0.25, 0.5, 0.75, 1.0]])), ',') AS positions FROM t""",
    "set_gates": """WITH n AS (SELECT 'union' AS what, count(*) AS n FROM labels WHERE quality = 1 OR toxic = 1 UNION ALL SELECT 'difference', count(*) FROM labels WHERE quality = 1 AND toxic <> 1
        UNION ALL SELECT 'intersection', count(*) FROM labels WHERE quality = 1 AND toxic = 1 UNION ALL SELECT 'outside', count(*) FROM labels WHERE quality <> 1 AND toxic <> 1) SELECT what, n, n = 0 AS empty FROM n""",
    "released_evidence": sql("frames", body=f" SELECT event_id FROM frames WHERE k >= 5 AND k - 5 <= 50 AND {DAY_US} + pts_us + 50 <= {AS_OF_US}"),
    "replay_decisions": f"WITH d AS ({known.ORACLE_SQL['departure_events']}), "
    + sql("observations", body="").removeprefix("WITH ")
    + f""", t AS (SELECT f.event_id AS trigger_id, d.episode_id, d.event_us, f.k, d.available_us + 250000 <= {AS_OF_US} AS shown FROM d JOIN frames f ON f.episode_id = d.episode_id AND f.frame_index = d.first),
    s AS (SELECT episode_id, event_us, count(*) AS n, count(*) FILTER (value IS NULL) AS u, bool_and(value) AS l, bool_or(value) AS m FROM observations WHERE committed_us <= {AS_OF_US} GROUP BY ALL),
    r AS (SELECT trigger_id, k, CASE WHEN NOT shown THEN 'trigger_not_observed' WHEN n IS NULL THEN 'no_exact_state_sample' WHEN u > 0 THEN 'source_unknown' WHEN l <> m THEN 'disagreeing_samples' WHEN l THEN 'observed_state_mismatch' ELSE 'observed_state_match' END AS reason FROM t LEFT JOIN s USING (episode_id, event_us)),
    p AS (SELECT *, CASE reason WHEN 'observed_state_match' THEN 'PASS' WHEN 'observed_state_mismatch' THEN 'VIOLATION' ELSE 'UNKNOWN' END AS status FROM r),
    q AS (SELECT *, CASE WHEN status <> 'UNKNOWN' THEN 'not_needed' WHEN reason <> 'trigger_not_observed' AND trigger_id % 2 = 0 THEN 'ready' ELSE 'unavailable' END AS plan FROM p)
    SELECT trigger_id, status, reason, plan, CASE WHEN plan = 'ready' THEN CASE WHEN k >= 50 THEN 'VIOLATION' ELSE 'PASS' END END AS conditioned_status FROM q""",
}
