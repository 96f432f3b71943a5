"""Queries that change, remap and describe stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions.media import parent_dir
from sightline.operators import guard
from sightline.plans.views import RECORDS, TAGS, points, records, table, tags
from sightline.sources import store as op

QUERIES, SQL = {}, {}


def upsert_merge(spark, d):
    """The later batches of records go into the table of the earlier ones, by digest."""
    r = records(spark, d).where("sha256 is not null")
    first = lambda df: df.groupBy("sha256").agg(F.min_by(F.struct("path", "record_id", "md5"), "record_id").alias("m")).select("sha256", "m.*")
    old, new = first(r.where("batch_no <= 12")), first(r.where("batch_no > 12"))
    return op.merged_points(old, new, "sha256", ["path"], ["record_id", "md5"]).select("sha256", "path", "record_id", "md5")


QUERIES["upsert_merge"] = upsert_merge
SQL["upsert_merge"] = f"""WITH {RECORDS}, f AS (SELECT *, batch_no > 12 AS late, row_number() OVER (PARTITION BY sha256, batch_no > 12 ORDER BY record_id) AS r FROM records WHERE sha256 IS NOT NULL),
o AS (SELECT * FROM f WHERE r = 1 AND NOT late), n AS (SELECT * FROM f WHERE r = 1 AND late)
SELECT sha256, coalesce(o.path, n.path) AS path, coalesce(n.record_id, o.record_id) AS record_id, coalesce(n.md5, o.md5) AS md5 FROM o FULL JOIN n USING (sha256)"""


def mark_complete(spark, d):
    v = table(spark, d, "videos")
    done = table(spark, d, "matched_frames").groupBy(F.lower(F.regexp_replace("video_hash", r"^\s+|\s+$", "")).alias("video_hash")).agg(F.countDistinct("frame_hash").cast("int").alias("total")).where("video_hash is not null")
    return op.marked_complete(v.select("video_hash", "indexed_at", "total_frames"), done, "total_frames")


QUERIES["mark_complete"] = mark_complete
SQL["mark_complete"] = """WITH t AS (SELECT lower(regexp_replace(video_hash, '^\\s+|\\s+$', '', 'g')) AS video_hash, count(DISTINCT frame_hash)::INT AS total FROM matched_frames GROUP BY 1)
SELECT v.video_hash, indexed_at, coalesce(total, total_frames) AS total_frames FROM videos v LEFT JOIN t ON t.video_hash = v.video_hash"""

QUERIES["path_remap"] = lambda spark, d: op.remapped(table(spark, d, "videos").select("point_id", "video_path", "indexed_at"), ["video_path"], "/evidence/case_000000", "/archive/case_0")
SQL["path_remap"] = """SELECT point_id, indexed_at, coalesce(starts_with(video_path, '/evidence/case_000000'), false) AS moved,
    CASE WHEN starts_with(video_path, '/evidence/case_000000') THEN '/archive/case_0' || substr(video_path, 22) ELSE video_path END AS video_path FROM videos"""

QUERIES["path_rollup"] = lambda spark, d: op.path_counts(table(spark, d, "file_records").select(parent_dir("path").alias("dir"), "status"), "dir", "status")
SQL["path_rollup"] = """WITH d AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, status FROM file_records)
SELECT dir, status, count(*) AS n FROM d GROUP BY dir, status UNION ALL SELECT dir, NULL, count(*) FROM d GROUP BY dir"""

QUERIES["dir_counts"] = lambda spark, d: table(spark, d, "hits").groupBy(parent_dir("path").alias("dir")).agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"))
SQL["dir_counts"] = "SELECT regexp_replace(path, '/[^/]*$', '') AS dir, count(*) AS n, count(DISTINCT path) AS files FROM hits GROUP BY ALL"


def tag_mark(spark, d):
    t = op.marked(tags(spark, d), 1, 11, "positive")
    t = op.unmarked(op.marked(t, 4, 77, "negative"), 6, 7)
    flat = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
    return t.select("tag_id", flat("positive_ids").alias("positives"), flat("negative_ids").alias("negatives"))


QUERIES["tag_mark"] = tag_mark
SQL["tag_mark"] = f"""WITH {TAGS}, t AS (SELECT tag_id,
    CASE WHEN tag_id = 1 THEN list_append(positive_ids, 11) WHEN tag_id = 6 THEN list_filter(positive_ids, lambda x: x <> 7) ELSE positive_ids END AS p,
    CASE WHEN tag_id = 1 THEN list_filter(negative_ids, lambda x: x <> 11) WHEN tag_id = 4 THEN list_append(negative_ids, 77) WHEN tag_id = 6 THEN list_filter(negative_ids, lambda x: x <> 7) ELSE negative_ids END AS n FROM tags)
SELECT tag_id, array_to_string(p, ',') AS positives, array_to_string(n, ',') AS negatives FROM t"""


def tag_upsert(spark, d):
    """Videos as tags, the records that came later replacing the earlier: replaced ones keep when they were made."""
    v = table(spark, d, "videos").select("video_hash", "point_id", "indexed_at")
    first = v.groupBy("video_hash").agg(F.min("indexed_at").alias("at"))
    old = first.select(F.col("video_hash").alias("tag_id"), F.lit("old").alias("name"), F.col("at").alias("created_at"), F.col("at").alias("updated_at"))
    frames_of = table(spark, d, "matched_frames").groupBy(F.lower(F.regexp_replace("video_hash", r"^\s+|\s+$", "")).alias("tag_id")).agg(F.count("*").alias("n")).where("tag_id is not null")
    new = frames_of.select("tag_id", F.concat(F.lit("seen "), F.col("n").cast("string")).alias("name"))
    return op.upserted_tags(old, new, F.lit("2030-01-01 00:00:00").cast("timestamp"))


QUERIES["tag_upsert"] = tag_upsert
SQL["tag_upsert"] = """WITH o AS (SELECT video_hash AS tag_id, min(indexed_at) AS at FROM videos GROUP BY 1),
n AS (SELECT lower(regexp_replace(video_hash, '^\\s+|\\s+$', '', 'g')) AS tag_id, count(*) AS n FROM matched_frames WHERE video_hash IS NOT NULL GROUP BY 1)
SELECT coalesce(o.tag_id, n.tag_id) AS tag_id, CASE WHEN n.tag_id IS NOT NULL THEN 'seen ' || n.n ELSE 'old' END AS name,
    coalesce(o.at, TIMESTAMPTZ '2030-01-01 00:00:00+00') AS created_at, CASE WHEN n.tag_id IS NOT NULL THEN TIMESTAMPTZ '2030-01-01 00:00:00+00' ELSE o.at END AS updated_at
FROM o FULL JOIN n ON o.tag_id = n.tag_id"""


def tag_retarget(spark, d):
    """One target is set, one cleared, and every tag without negatives is deleted."""
    t = op.retargeted(op.retargeted(tags(spark, d), 100, 31, F.lit(None)), 6, None, F.lit(None))
    return op.deleted_tags(t, t.where("size(negative_ids) = 0")).select("tag_id", "name", "target_id")


QUERIES["tag_retarget"] = tag_retarget
SQL["tag_retarget"] = f"WITH {TAGS} SELECT tag_id, name, CASE tag_id WHEN 100 THEN 31 WHEN 6 THEN NULL ELSE target_id END AS target_id FROM tags WHERE len(negative_ids) > 0"


def concept_tags(spark, d):
    """Rows of the older shape: the polarity goes, rows that are no concept stay out."""
    t = tags(spark, d).withColumnRenamed("tag_id", "concept_id").withColumns({"is_concept": F.col("concept_id") != 3, "polarity": F.lit("incriminating")})
    return op.tags_of_concepts(t).select("tag_id", "name", F.size("positive_ids").cast("bigint").alias("positives"), "target_id")


QUERIES["concept_tags"] = concept_tags
SQL["concept_tags"] = f"WITH {TAGS} SELECT tag_id, name, len(positive_ids) AS positives, target_id FROM tags WHERE tag_id <> 3"


def video_upsert(spark, d):
    """Video records by hash: the last writer wins."""
    v = table(spark, d, "videos").select("video_hash", "point_id", "total_frames", "indexed_at", "arrived_at")
    old, new = v.where("total_frames is null"), v.where("total_frames is not null")
    return op.merged_videos(old, new, "video_hash", "indexed_at").select("video_hash", "point_id", "total_frames", "indexed_at")


QUERIES["video_upsert"] = video_upsert
SQL["video_upsert"] = """SELECT video_hash, point_id, total_frames, indexed_at FROM (SELECT *, row_number() OVER (
    PARTITION BY video_hash ORDER BY total_frames IS NOT NULL DESC, indexed_at DESC NULLS LAST, point_id DESC, total_frames DESC, arrived_at DESC) AS r FROM videos) WHERE r = 1"""


def export_plan(spark, d):
    return op.export_plan(tags(spark, d), points(spark, d).withColumn("path", F.concat(F.lit("/s/"), F.col("point_id").cast("string"), F.lit("/x.jpg"))), "point_id", "path")


QUERIES["export_plan"] = export_plan
SQL["export_plan"] = f"""WITH {TAGS}, l AS (SELECT name AS tag, 'positive' AS role, unnest(positive_ids) AS point, generate_subscripts(positive_ids, 1) AS ord FROM tags
    UNION ALL SELECT name, 'negative', unnest(negative_ids), generate_subscripts(negative_ids, 1) FROM tags),
m AS (SELECT l.*, '/s/' || point || '/x.jpg' AS source FROM l JOIN embeddings ON vec_id = point)
SELECT tag, role, point, source, CASE WHEN row_number() OVER (PARTITION BY tag, role ORDER BY ord, point) = 1 THEN 'x.jpg' ELSE 'x_' || left(sha256(source), 8) || '.jpg' END AS name FROM m"""


def tag_counts(spark, d):
    known = points(spark, d).select("point_id")
    listed = tags(spark, d).select("name", F.explode(F.concat(
        F.transform("positive_ids", lambda x: F.struct(F.lit("positive").alias("role"), x.alias("point_id"))),
        F.transform("negative_ids", lambda x: F.struct(F.lit("negative").alias("role"), x.alias("point_id"))))).alias("e")).select("name", "e.*")
    return listed.join(known, "point_id").groupBy("name").agg(F.count_if(F.col("role") == "positive").alias("positive"), F.count_if(F.col("role") == "negative").alias("negative"))


QUERIES["tag_counts"] = tag_counts
SQL["tag_counts"] = f"""WITH {TAGS}, l AS (SELECT name, 'p' AS role, unnest(positive_ids) AS point FROM tags UNION ALL SELECT name, 'n', unnest(negative_ids) FROM tags)
SELECT name, count(*) FILTER (role = 'p') AS positive, count(*) FILTER (role = 'n') AS negative FROM l JOIN embeddings ON vec_id = point GROUP BY name"""

QUERIES["stored_configurations"] = lambda spark, d: guard.stored_configurations(table(spark, d, "videos"), "video_hash", ["pyav_version", "extraction_fps", "max_frames_cap"])
SQL["stored_configurations"] = "SELECT DISTINCT pyav_version, extraction_fps, max_frames_cap FROM videos WHERE pyav_version IS NOT NULL OR extraction_fps IS NOT NULL OR max_frames_cap IS NOT NULL"


def unknown_tags(spark, d):
    """Named examples that no collection holds."""
    ids = tags(spark, d).select("name", F.explode(F.concat("positive_ids", "negative_ids")).alias("point_id"))
    return ids.join(points(spark, d).select("point_id"), "point_id", "left_anti").select("name", "point_id")


QUERIES["unknown_tags"] = unknown_tags
SQL["unknown_tags"] = f"WITH {TAGS}, l AS (SELECT name, unnest(list_concat(positive_ids, negative_ids)) AS point_id FROM tags) SELECT * FROM l WHERE point_id NOT IN (SELECT vec_id FROM embeddings)"
