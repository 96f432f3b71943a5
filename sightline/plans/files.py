"""Queries over files, digests and ingest runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import ids, media
from sightline.operators import dedup as op
from sightline.plans.views import FRAMES, RECORDS, frames, records, table

QUERIES, SQL = {}, {}


QUERIES["doc_hashes"] = lambda spark, d: table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))
SQL["doc_hashes"] = "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents"


def uuid5_ids(spark, d):
    v = table(spark, d, "videos").select("video_hash").distinct()
    return v.select("video_hash", ids.image_id("video_hash").alias("image_id"), ids.frame_id("video_hash", F.lit(1500)).alias("frame_id"), ids.video_id("video_hash").alias("video_id"))


QUERIES["uuid5_ids"] = uuid5_ids  # held against uuid.uuid5 in the tests, too


def _uuid5_sql(name: str) -> str:
    """RFC 4122, version 5: the namespace for URLs and a name through SHA-1, version and variant set."""
    d = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({name}))"
    variant = f"printf('%x', (('0x' || substr({d}, 17, 1))::INT & 3) | 8)"
    return f"substr({d}, 1, 8) || '-' || substr({d}, 9, 4) || '-5' || substr({d}, 14, 3) || '-' || {variant} || substr({d}, 18, 3) || '-' || substr({d}, 21, 12)"


SQL["uuid5_ids"] = "SELECT DISTINCT video_hash, " + ", ".join(f"{_uuid5_sql(n)} AS {c}" for n, c in (
    ("video_hash", "image_id"), ("(video_hash || ':1500')", "frame_id"), ("('video:' || video_hash)", "video_id"))) + " FROM videos"


def file_types(spark, d):
    r = table(spark, d, "file_records").select(media.extension("path").alias("ext"), media.file_type("path", heif=False).alias("file_type"))
    return r.groupBy("ext", "file_type").agg(F.count("*").alias("n"))


QUERIES["file_types"] = file_types
# written out: the lists that the engine has to have
SQL["file_types"] = """WITH e AS (SELECT lower(regexp_extract(path, '[^/\\\\]\\.([^./\\\\]+)$', 1)) AS ext FROM file_records)
SELECT ext, CASE WHEN ext IN ('jpg', 'jpeg', 'png', 'bmp', 'tiff', 'tif', 'webp', 'gif', 'jp2', 'ico', 'psd') THEN 'image'
    WHEN ext IN ('mp4', 'avi', 'mov', 'mkv', 'wmv', 'flv', 'webm', 'm4v', 'mpg', 'mpeg', '3gp', 'ts', 'mts') THEN 'video' ELSE 'unsupported' END AS file_type, count(*) AS n FROM e GROUP BY ALL"""


def dedup_winner(spark, d):
    return op.elect_winners(records(spark, d), "sha256", "record_id").select("record_id", "winner", "is_dup")


QUERIES["dedup_winner"] = dedup_winner
SQL["dedup_winner"] = f"""WITH {RECORDS}
SELECT record_id, CASE WHEN sha256 IS NOT NULL THEN min(record_id) OVER (PARTITION BY sha256) END AS winner,
       sha256 IS NOT NULL AND record_id <> min(record_id) OVER (PARTITION BY sha256) AS is_dup FROM records"""


def frame_winners(spark, d):
    """Frames and images elect their winners apart."""
    return op.elect_winners(records(spark, d).where("is_frame is not null"), "sha256", "record_id", "is_frame").select("record_id", "is_frame", "winner", "is_dup")


QUERIES["frame_winners"] = frame_winners
SQL["frame_winners"] = f"""WITH {RECORDS}
SELECT record_id, is_frame, CASE WHEN sha256 IS NOT NULL THEN min(record_id) OVER (PARTITION BY is_frame, sha256) END AS winner,
       sha256 IS NOT NULL AND record_id <> min(record_id) OVER (PARTITION BY is_frame, sha256) AS is_dup FROM records WHERE is_frame IS NOT NULL"""


def dedup_report(spark, d):
    won = op.elect_winners(records(spark, d), "sha256", "record_id")
    state = F.when(F.col("is_dup"), "skipped_dup_batch").otherwise(F.col("status"))
    return op.status_counts(won.withColumn("state", state), "state")


QUERIES["dedup_report"] = dedup_report
SQL["dedup_report"] = f"""WITH {RECORDS}, w AS (
    SELECT *, sha256 IS NOT NULL AND record_id <> min(record_id) OVER (PARTITION BY sha256) AS is_dup FROM records)
SELECT CASE WHEN is_dup THEN 'skipped_dup_batch' ELSE status END AS state, count(*) AS n FROM w GROUP BY ALL"""


def _unindexed(mode):
    def query(spark, d):
        r = records(spark, d)
        fresh, known = r.where("batch_no > 12"), r.where("batch_no <= 12 and status = 'indexed'")
        return op.not_indexed(fresh, known, mode).select("record_id")

    return query


_KNOWN = "SELECT 1 FROM records k WHERE k.batch_no <= 12 AND k.status = 'indexed' AND "
for _mode, _tests in {"hash": ["k.sha256 = r.sha256"], "filepath": ["k.path = r.path"], "both": ["k.sha256 = r.sha256", "k.path = r.path"]}.items():
    QUERIES[f"not_indexed_{_mode}"] = _unindexed(_mode)
    SQL[f"not_indexed_{_mode}"] = f"WITH {RECORDS} SELECT record_id FROM records r WHERE batch_no > 12 " + " ".join(f"AND NOT EXISTS ({_KNOWN}{t})" for t in _tests)


def needs_per_model(spark, d):
    r = records(spark, d)
    won = op.elect_winners(r, "sha256", "record_id").where("not is_dup and sha256 is not null")
    known = {"dino": r.where("status = 'indexed'"), "sscd": r.where("status = 'indexed' and batch_no <= 12")}
    n = op.needs_per_model(won, known, "sha256")
    return n.select("record_id", "needs_dino", "needs_sscd", "needs_any")


QUERIES["needs_per_model"] = needs_per_model
SQL["needs_per_model"] = f"""WITH {RECORDS}, w AS (SELECT min(record_id) AS record_id, sha256 FROM records WHERE sha256 IS NOT NULL GROUP BY sha256),
n AS (SELECT record_id, NOT EXISTS (SELECT 1 FROM records k WHERE k.sha256 = w.sha256 AND k.status = 'indexed') AS needs_dino,
    NOT EXISTS (SELECT 1 FROM records k WHERE k.sha256 = w.sha256 AND k.status = 'indexed' AND k.batch_no <= 12) AS needs_sscd FROM w)
SELECT *, needs_dino OR needs_sscd AS needs_any FROM n"""

QUERIES["failure_spread"] = lambda spark, d: op.status_counts(op.spread_failures(records(spark, d), "sha256", "status", "failed_preprocessing"), "final_status")
SQL["failure_spread"] = f"""WITH {RECORDS}, f AS (SELECT CASE WHEN sha256 IS NOT NULL AND bool_or(status = 'failed_preprocessing') OVER (PARTITION BY sha256)
    THEN 'failed_preprocessing' ELSE status END AS final_status FROM records) SELECT final_status, count(*) AS n FROM f GROUP BY ALL"""

QUERIES["status_by_batch"] = lambda spark, d: records(spark, d).groupBy("batch_no").agg(
    F.count_if(F.col("status") == "indexed").alias("indexed"), F.count_if(F.col("status").startswith("failed")).alias("failed"),
    F.count_if(~F.col("status").startswith("failed") & (F.col("status") != "indexed")).alias("other"))
SQL["status_by_batch"] = """SELECT batch_no, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (starts_with(status, 'failed')) AS failed,
    count(*) FILTER (NOT starts_with(status, 'failed') AND status <> 'indexed') AS other FROM file_records GROUP BY ALL"""

QUERIES["video_states"] = lambda spark, d: op.video_states(table(spark, d, "videos"))
_STATES = """states AS (SELECT video_hash, extraction_fps, max_frames_cap, video_path, complete, records FROM (
    SELECT *, row_number() OVER (PARTITION BY video_hash ORDER BY indexed_at, point_id, arrived_at) AS r,
           bool_or(total_frames IS NOT NULL) OVER (PARTITION BY video_hash) AS complete, count(*) OVER (PARTITION BY video_hash) AS records FROM videos) WHERE r = 1)"""
SQL["video_states"] = f"WITH {_STATES} SELECT * FROM states"


def videos_up_to_date(spark, d):
    states = op.video_states(table(spark, d, "videos"))
    return op.up_to_date(states.select("video_hash"), states, 1.0, 500)


QUERIES["videos_up_to_date"] = videos_up_to_date
SQL["videos_up_to_date"] = f"WITH {_STATES} SELECT video_hash FROM states WHERE complete AND extraction_fps = 1.0 AND max_frames_cap = 500"


def video_completion(spark, d):
    totals = table(spark, d, "videos").groupBy("video_hash").agg(F.max("total_frames").alias("total"))
    return op.completion(frames(spark, d), totals).withColumn("status", op.video_status())


QUERIES["video_completion"] = video_completion
SQL["video_completion"] = f"""WITH {FRAMES}, t AS (SELECT video_hash, max(total_frames) AS total FROM videos GROUP BY ALL),
p AS (SELECT video_hash, count(DISTINCT frame_hash) AS indexed, count(frame_hash) - count(DISTINCT frame_hash) AS dups FROM frames GROUP BY ALL),
c AS (SELECT t.video_hash, coalesce(indexed, 0) AS indexed, coalesce(dups, 0) AS dups, total,
    total IS NOT NULL AND coalesce(indexed, 0) + coalesce(dups, 0) >= total AS complete FROM t LEFT JOIN p USING (video_hash))
SELECT *, CASE WHEN total IS NULL THEN 'unknown' WHEN complete THEN 'indexed' WHEN indexed > 0 THEN 'partial' ELSE 'pending' END AS status FROM c"""


def _doc_files(spark, d):
    return table(spark, d, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path"), F.col("written_at").alias("mtime"), F.col("n_chars").alias("size"), "text", "lang")


def hash_cache_probe(spark, d):
    f = _doc_files(spark, d)
    cache = f.where("lang = 'en'").select("path", "mtime", "size", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))
    return op.hash_cache_probe(f.drop("text", "lang"), cache).select("path", "cached", F.when(F.col("cached"), F.col("c_sha256")).alias("sha256"))


QUERIES["hash_cache_probe"] = hash_cache_probe
SQL["hash_cache_probe"] = """SELECT source || '/' || doc_id AS path, coalesce(lang = 'en' AND n_chars IS NOT NULL AND text IS NOT NULL, false) AS cached,
    CASE WHEN lang = 'en' AND n_chars IS NOT NULL THEN sha256(text) END AS sha256 FROM documents"""


def hash_cache_refresh(spark, d):
    r = records(spark, d).where("sha256 is not null").select("path", F.col("scanned_at").alias("mtime"), F.col("record_id").alias("size"), "sha256", "md5", "batch_no")
    once = lambda df: df.groupBy("path").agg(F.max_by(F.struct("mtime", "size", "sha256", "md5"), F.struct("mtime", "size")).alias("m")).select("path", "m.*")
    return op.refreshed_cache(once(r.where("batch_no <= 12")), once(r.where("batch_no > 12"))).select("path", F.col("size").alias("record_id"), "sha256")


QUERIES["hash_cache_refresh"] = hash_cache_refresh
SQL["hash_cache_refresh"] = f"""WITH {RECORDS} SELECT path, record_id, sha256 FROM (
    SELECT *, row_number() OVER (PARTITION BY path ORDER BY batch_no > 12 DESC, scanned_at DESC, record_id DESC) AS r FROM records WHERE sha256 IS NOT NULL) WHERE r = 1"""

QUERIES["ingest_report"] = lambda spark, d: op.ingest_report(records(spark, d))
SQL["ingest_report"] = f"WITH {RECORDS} SELECT path, CASE WHEN status = 'indexed' THEN 'yes' ELSE 'no' END AS processed, reason, md5, sha256, is_frame AS is_video_frame FROM records ORDER BY path"


def frame_files(spark, d):
    f = frames(spark, d).where("video_hash is not null and timecode_ms is not null").select(media.frame_file("/frames", "video_hash", "timecode_ms").alias("file")).distinct()
    v, t = media.parse_frame_file("file")
    return f.select("file", v.alias("video_hash"), t.alias("timecode_ms"))


QUERIES["frame_files"] = frame_files
SQL["frame_files"] = f"""WITH {FRAMES} SELECT DISTINCT '/frames/' || video_hash || '/' || printf('%010d', timecode_ms) || 'ms.jpg' AS file, video_hash, timecode_ms
FROM frames WHERE video_hash IS NOT NULL AND timecode_ms IS NOT NULL"""


def allowed_files(spark, d):
    from sightline.sources.files import within_roots

    return within_roots(table(spark, d, "file_records").select("record_id", "path"), "path", ["/evidence/case_000001", "/evidence/case_000002/"])


QUERIES["allowed_files"] = allowed_files
SQL["allowed_files"] = "SELECT record_id, path FROM file_records WHERE starts_with(path, '/evidence/case_000001/') OR starts_with(path, '/evidence/case_000002/')"


def malformed_timecodes(spark, d):
    e = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("raw"), "event_type")
    return e.select("event_id", F.expr("try_cast(event_type AS BIGINT)").alias("timecode_ms")).where("timecode_ms is null")


QUERIES["malformed_timecodes"] = malformed_timecodes
SQL["malformed_timecodes"] = "SELECT event_id, TRY_CAST(event_type AS BIGINT) AS timecode_ms FROM events WHERE TRY_CAST(event_type AS BIGINT) IS NULL"


def run_completion(spark, d):
    """Frames of the first deliveries are embedded by one model, those with a semantic score by the other."""
    f = frames(spark, d).where("video_hash is not null and frame_hash is not null").select(
        F.col("match_id").alias("frame"), F.col("video_hash").alias("video"), F.col("frame_hash").alias("digest"), "semantic").dropDuplicates(["frame"])
    won = op.elect_winners(f, "digest", "frame")
    own = won.where("not is_dup")
    done = own.select("frame", F.lit("sscd").alias("vector")).union(own.where("semantic is not null").select("frame", F.lit("dino").alias("vector")))
    totals = f.groupBy("video").agg(F.count("*").alias("total"))
    return op.run_completion(won.select("frame", "video", "digest", "is_dup"), done, totals, ["dino", "sscd"])


QUERIES["run_completion"] = run_completion
SQL["run_completion"] = f"""WITH {FRAMES}, f AS (SELECT match_id AS frame, video_hash AS video, frame_hash AS digest, semantic, min(match_id) OVER (PARTITION BY frame_hash) AS winner
    FROM frames WHERE video_hash IS NOT NULL AND frame_hash IS NOT NULL),
d AS (SELECT f.video, count(*) AS dups FROM f JOIN f w ON w.frame = f.winner AND w.video = f.video WHERE f.frame <> f.winner GROUP BY 1),
i AS (SELECT video, 'sscd' AS vector, count(*) FILTER (frame = winner) AS indexed, count(*) AS total FROM f GROUP BY 1
    UNION ALL SELECT video, 'dino', count(*) FILTER (frame = winner AND semantic IS NOT NULL), count(*) FROM f GROUP BY 1)
SELECT video, vector, indexed, coalesce(dups, 0) AS dups, total, indexed + coalesce(dups, 0) >= total AS complete FROM i LEFT JOIN d USING (video)"""


def model_counters(spark, d):
    r = records(spark, d)
    dups = op.elect_winners(r, "sha256", "record_id").withColumn("status", F.when(F.col("is_dup"), "skipped_dup_batch").otherwise(F.col("status")))
    both = dups.select("status", F.explode(F.array(F.lit("dino"), F.when(~F.col("is_frame"), "sscd"))).alias("vector")).where("vector is not null")
    return op.model_counters(both)


QUERIES["model_counters"] = model_counters
SQL["model_counters"] = f"""WITH {RECORDS}, s AS (SELECT is_frame, CASE WHEN sha256 IS NOT NULL AND record_id <> min(record_id) OVER (PARTITION BY sha256) THEN 'skipped_dup_batch' ELSE status END AS status FROM records),
v AS (SELECT status, 'dino' AS vector FROM s UNION ALL SELECT status, 'sscd' FROM s WHERE NOT is_frame)
SELECT vector, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (starts_with(status, 'skipped')) AS skipped, count(*) FILTER (starts_with(status, 'failed')) AS failed FROM v GROUP BY 1"""
