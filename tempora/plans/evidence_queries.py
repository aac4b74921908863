"""As-of reads, registered content, and texts that models answered with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions import text as tx
from tempora.operators import asof, checks, integrity
from tempora.sources import artifacts, views
from tempora.sources.views import sql

DAY_US = 86_400_000_000
AS_OF_US = 10 * DAY_US


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.observations(views.frames(spark, sf_dir))


def asof_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each observation's own time asked at two horizons: just before and at its commit."""
    seen = _observed(spark, sf_dir)
    asked = seen.select("episode_id", "stream_id", "event_us", F.explode(F.array(F.col("committed_us") - 1, F.col("committed_us"))).alias("as_of_us"))
    return asof.snapshot(seen, asked.distinct(), ["episode_id", "stream_id"])


def asof_log_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each episode's log from its fourth record on, five records a page."""
    log = asof.sequenced(_observed(spark, sf_dir), "episode_id")
    return asof.log_pages(log, AS_OF_US, 3, 5, "episode_id").select("episode_id", "seq", "observation_id", "available_us")


def visible_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _observed(spark, sf_dir)
    return seen.where(asof.visible(AS_OF_US)).groupBy("episode_id", "stream_id").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("known"))


def appended_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that holds half of the observations takes the rest, and none of those it has."""
    seen = _observed(spark, sf_dir)
    store = seen.where("observation_id % 2 = 0").withColumn("committed_us", F.lit(0).cast("long"))
    return asof.appended(store, seen, ["value", "event_us"]).select("observation_id")


def observation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations after a fault: commits moved a second earlier."""
    spoilt = _observed(spark, sf_dir).withColumn("committed_us", F.col("committed_us") - 1_000_000)
    return checks.violations(spoilt, checks.observation_rules(), "observation_id")


def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents")
    registered = docs.select(views.split_of(F.col("doc_id")).alias("split"), F.col("source").alias("split_group"), integrity.content_hash(F.col("text")).alias("content"))
    return integrity.split_leakage(registered, ["split_group", "content"])


def duplicate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents").select(integrity.content_hash(F.col("text")).alias("content"), "doc_id")
    return docs.groupBy("content").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


def population_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = views.table(spark, sf_dir, "labels")
    left = labels.select("doc_id", "quality")
    right = labels.where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"))
    return checks.population_difference(left, right, ["doc_id"], ["quality"])


def _hashes(spark: SparkSession, sf_dir: str, split: str) -> DataFrame:
    """A chunk without a vector has no bit set."""
    chunks = views.chunks(spark, sf_dir).where(F.col("split") == split)
    return chunks.select(F.col("chunk_id").alias("id"), F.coalesce(integrity.gradient_bits(F.col("vector")), F.lit(0)).cast("long").alias("hash"))


def near_duplicate_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of a train and a test chunk whose gradient hashes lie within 20 bits, and their distance."""
    return integrity.near_pairs(_hashes(spark, sf_dir, "train"), _hashes(spark, sf_dir, "test"), 20)


def _split_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.chunks(spark, sf_dir).select("split", F.col("chunk_id").alias("id"), integrity.gradient_bits(F.col("vector")).alias("hash"))


def near_duplicate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class and the number of links with other splits of each chunk of every split."""
    return integrity.split_links(_split_hashes(spark, sf_dir), 20)


def nearest_cross_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest pairs of chunks of different splits."""
    return integrity.nearest_across(_split_hashes(spark, sf_dir), 20)


def missing_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents")
    key = integrity.content_hash(F.col("text")).alias("key")
    return integrity.missing_features(docs.select(key), docs.where("lang = 'en'").select(key))


def setting_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = (views.table(spark, sf_dir, t) for t in ("region", "nation"))
    return checks.setting_differences(region.select(F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").alias("value")), nation.select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("value")))


def matched_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as the entries of a batch: whether they agree on a region, and need at most 128 samples."""
    entries = views.table(spark, sf_dir, "nation").select("n_regionkey", F.lit(1).alias("samples"))
    return checks.matched_batch(entries, ["n_regionkey"])


def fence_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = views.table(spark, sf_dir, "conversations")
    raw = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("```json\n"), "text", F.lit("\n```"))).otherwise(F.col("text"))
    return said.select("conv_id", "turn", F.sha2(tx.unfenced(raw), 256).alias("payload"))


def envelope_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = views.table(spark, sf_dir, "pages")
    parts = tx.envelope(F.col("html"), "body")
    title = tx.envelope(F.col("html"), "title")
    return page.select("page_id", parts["status"].alias("body_status"), title["status"].alias("title_status"), title["body"].alias("title"))


def regex_verb(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.frames(spark, sf_dir)
    line = tx.program_line(F.lit("char0"), F.initcap("event_type"), F.lit("door"), F.col("frame_index"))
    return f.select("event_id", line.alias("line"), tx.verb(line).alias("verb"))


def strict_json_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The props of events as answers of a closed shape; every third has its key twice, every fifth another one."""
    e = views.table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"answer": "yes", "answer": "'), "event_type", F.lit('"}'))).when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"other": "'), "event_type", F.lit('"}'))).otherwise(F.concat(F.lit('{"answer": "'), "event_type", F.lit('"}')))
    return e.select("event_id", tx.strict_answer({"answer"}, "answer", {"view", "click"})(raw).alias("status"))


def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.episodes(views.frames(spark, sf_dir))
    return e.groupBy("split").agg(F.count(F.lit(1)).alias("episodes"), F.sum("frames").alias("frames"), F.sum("duration_us").alias("duration_us"))


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document as a recording; equal texts are one group and go to one split."""
    sha = integrity.content_hash(F.coalesce("text", F.lit("")))
    docs = views.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), sha.alias("video_sha256"))
    id_ = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    split = F.when(F.substring("video_sha256", 1, 1) < "a", "train").when(F.substring("video_sha256", 1, 1) < "d", "development").otherwise("test")
    return docs.select(id_.alias("episode_id"), split.alias("split"), F.substring("video_sha256", 1, 16).alias("split_group"), F.concat(F.col("lang"), F.lit("/"), id_, F.lit(".txt")).alias("video"), "video_sha256", "doc_id")


def ingest_new_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as a manifest, a third of which is registered already."""
    whole = _manifest(spark, sf_dir)
    known, manifest = whole.where("doc_id % 3 = 0").drop("doc_id"), whole.drop("doc_id")
    return integrity.ingest(known, manifest, found=manifest.select("video", F.col("video_sha256").alias("sha256")))


def artifact_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of which some are missing below the root, and others there under a name of another folder or with other bytes."""
    m = _manifest(spark, sf_dir)
    path = F.concat(F.lit("/corpus/"), F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("old/"), F.col("video"))).otherwise(F.col("video")))
    found = m.where("doc_id % 11 <> 0").select(path.alias("path"), F.when(F.col("doc_id") % 7 == 0, F.sha2("video_sha256", 256)).otherwise(F.col("video_sha256")).alias("sha256"))
    return artifacts.verified(m.select(F.col("video").alias("name"), F.col("video_sha256").alias("sha256")), found, "/corpus")


def index_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as an index in which some labels are of another space, cut short, or stretched."""
    c = views.chunks(spark, sf_dir)
    vector = F.when(F.col("label") == 1, F.slice("vector", 1, 63)).when(F.col("label") == 2, F.transform("vector", lambda x: (x * 2).cast("float"))).otherwise(F.col("vector"))
    return artifacts.sound_index(c.select("chunk_id", vector.alias("vector"), F.when(F.col("label") == 0, "other").otherwise("main").alias("space_id")), 64, "main")


QUERIES = {
    f.__name__: f
    for f in (
        ingest_new_episodes,
        artifact_faults,
        index_faults,
        asof_state,
        asof_log_page,
        visible_counts,
        appended_observations,
        observation_violations,
        split_leakage,
        duplicate_content,
        population_diff,
        near_duplicate_hamming,
        near_duplicate_links,
        nearest_cross_split,
        missing_features,
        setting_differences,
        matched_batch,
        fence_unwrap,
        envelope_tags,
        regex_verb,
        strict_json_answer,
        ingest_summary,
    )
}


def _tag(tag: str, of: str) -> str:
    n = lambda t: f"(length({of}) - length(replace({of}, '{t}', ''))) // {len(t)}"
    a, b = f"strpos({of}, '<{tag}>')", f"strpos({of}, '</{tag}>')"
    body = f"trim(substr({of}, {a} + {len(tag) + 2}, {b} - {a} - {len(tag) + 2}))"
    answer = f"trim(substr({of}, {b} + {len(tag) + 3}))"
    o, c = n(f"<{tag}>"), n(f"</{tag}>")
    return f"CASE WHEN {o} = 0 AND {c} = 0 THEN 'no_tags' WHEN {o} <> 1 OR {c} <> 1 THEN 'unbalanced_tags' WHEN {b} < {a} THEN 'tags_out_of_order' WHEN {body} = '' OR {answer} = '' THEN 'empty_part' ELSE 'ok' END", body


_BODY, _TITLE = _tag("body", "html"), _tag("title", "html")
_HASHES = ", h AS (SELECT chunk_id AS id, split, list_sum([CASE WHEN vector[i + 1] > vector[i] THEN 1::BIGINT << CAST(i - 1 AS INTEGER) ELSE 0::BIGINT END for i in range(1, 64)])::BIGINT AS hash FROM chunks)"

ORACLE_SQL = {
    "asof_state": sql(
        "observations",
        body=""", asked AS (SELECT DISTINCT episode_id, stream_id, event_us, unnest([committed_us - 1, committed_us]) AS as_of_us FROM observations),
        seen AS (SELECT a.*, o.value, o.available_us <= a.as_of_us AND o.committed_us <= a.as_of_us AS ok FROM asked a JOIN observations o USING (episode_id, stream_id, event_us)),
        g AS (SELECT episode_id, stream_id, event_us, as_of_us, count(*) FILTER (ok) AS n, count(*) FILTER (ok AND value IS NULL) AS u, bool_and(value) FILTER (ok) AS l, bool_or(value) FILTER (ok) AS m FROM seen GROUP BY ALL),
        s AS (SELECT *, CASE WHEN n = 0 THEN 'no_visible_sample' WHEN u > 0 THEN 'source_unknown' WHEN l <> m THEN 'disagreeing_samples' ELSE 'supported' END AS status FROM g)
        SELECT episode_id, stream_id, event_us, as_of_us, CASE WHEN status = 'supported' THEN l END AS value, status FROM s""",
    ),
    "asof_log_page": sql("observations", body=f", l AS (SELECT *, CAST(row_number() OVER (PARTITION BY episode_id ORDER BY available_us, observation_id) AS INTEGER) AS seq FROM observations) SELECT episode_id, seq, observation_id, available_us FROM l WHERE seq > 3 AND available_us <= {AS_OF_US} QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY seq) <= 5"),
    "visible_counts": sql("observations", body=f" SELECT episode_id, stream_id, count(*) AS n, count(value) AS known FROM observations WHERE available_us <= {AS_OF_US} AND committed_us <= {AS_OF_US} GROUP BY ALL"),
    "appended_observations": sql("observations", body=" SELECT observation_id FROM observations WHERE observation_id % 2 <> 0"),
    "observation_violations": sql("observations", body=" SELECT observation_id, 'clocks' AS rule FROM observations WHERE NOT (0 <= event_us AND event_us <= available_us AND available_us <= committed_us - 1000000)"),
    "split_leakage": """WITH r AS (SELECT CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'development' ELSE 'test' END AS split, source AS split_group, sha256(text) AS content FROM documents)
        SELECT 'split_group' AS key, split_group AS value, count(DISTINCT split) AS owners, count(*) AS n FROM r GROUP BY split_group HAVING count(DISTINCT split) > 1
        UNION ALL SELECT 'content', content, count(DISTINCT split), count(*) FROM r GROUP BY content HAVING count(DISTINCT split) > 1""",
    "duplicate_content": "SELECT sha256(text) AS content, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY content HAVING count(*) > 1",
    "population_diff": "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'only_left' ELSE 'differs' END AS status FROM labels WHERE doc_id % 7 = 0 OR doc_id % 5 = 0",
    "ingest_new_episodes": """WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, sha256(coalesce(text, '')) AS s FROM documents)
        SELECT 'd' || doc_id AS episode_id, CASE WHEN s[1] < 'a' THEN 'train' WHEN s[1] < 'd' THEN 'development' ELSE 'test' END AS split, s[1:16] AS split_group, lang || '/d' || doc_id || '.txt' AS video, s AS video_sha256 FROM d WHERE doc_id % 3 <> 0""",
    "artifact_faults": """SELECT coalesce(lang, 'und') || '/d' || doc_id || '.txt' AS name, CASE WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 THEN 'missing' ELSE 'changed' END AS status FROM documents WHERE doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 7 = 0""",
    "index_faults": sql(
        "chunks",
        body=""", v AS (SELECT chunk_id, label, CASE label WHEN 1 THEN vector[1:63] WHEN 2 THEN list_transform(vector, lambda x: (x * 2)::FLOAT) ELSE vector END::DOUBLE[] AS v FROM chunks),
        faults AS (SELECT chunk_id, unnest([CASE WHEN label = 0 THEN 'space' END, CASE WHEN len(v) <> 64 THEN 'dimension' END, CASE WHEN NOT abs(sqrt(list_inner_product(v, v)) - 1) < 1e-5 THEN 'unit' END]) AS rule FROM v) SELECT * FROM faults WHERE rule IS NOT NULL""",
    ),
    "near_duplicate_hamming": sql("chunks", body=_HASHES + " SELECT a.id AS left_id, b.id AS right_id, CAST(bit_count(xor(a.hash, b.hash)) AS INTEGER) AS distance FROM h a, h b WHERE a.split = 'train' AND b.split = 'test' AND bit_count(xor(a.hash, b.hash)) <= 20"),
    "near_duplicate_links": sql(
        "chunks",
        body=_HASHES
        + """, n AS (SELECT a.id, count(*) AS links FROM h a, h b WHERE a.split <> b.split AND bit_count(xor(a.hash, b.hash)) <= 20 GROUP BY a.id)
        SELECT split, id, min(id) OVER (PARTITION BY split, hash) AS class_id, coalesce(links, 0) AS links FROM h LEFT JOIN n USING (id)""",
    ),
    "nearest_cross_split": sql("chunks", body=_HASHES + " SELECT a.id AS left_id, b.id AS right_id, CAST(bit_count(xor(a.hash, b.hash)) AS INTEGER) AS distance FROM h a, h b WHERE a.split > b.split ORDER BY distance, left_id, right_id LIMIT 20"),
    "missing_features": "SELECT DISTINCT sha256(text) AS key FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en')",
    "setting_differences": 'SELECT coalesce(CAST(r_regionkey AS BIGINT), CAST(n_nationkey AS BIGINT)) AS key, r_name AS "left", n_name AS "right" FROM region FULL JOIN nation ON r_regionkey = n_nationkey WHERE r_name IS DISTINCT FROM n_name',
    "matched_batch": "SELECT count(DISTINCT n_regionkey) = 1 AS matched, count(*) <= 128 AS within_budget FROM nation",
    "fence_unwrap": "SELECT conv_id, turn, sha256(text) AS payload FROM conversations",
    "envelope_tags": f"SELECT page_id, {_BODY[0]} AS body_status, {_TITLE[0]} AS title_status, CASE WHEN {_TITLE[0]} = 'ok' THEN {_TITLE[1]} END AS title FROM pages",
    "regex_verb": sql("frames", body=" SELECT event_id, '<char0> [' || upper(event_type[1]) || event_type[2:] || '] <door> (' || frame_index || ')' AS line, event_type AS verb FROM frames"),
    "strict_json_answer": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'repeated_key' WHEN event_id % 5 = 0 THEN 'other_keys' WHEN event_type IN ('view', 'click') THEN 'ok' ELSE 'other_value' END AS status FROM events",
    "ingest_summary": sql("episodes", body=" SELECT split, count(*) AS episodes, CAST(sum(frames) AS BIGINT) AS frames, CAST(sum(duration_us) AS BIGINT) AS duration_us FROM episodes GROUP BY split"),
}
