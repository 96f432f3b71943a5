"""Queries over vectors and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions.digests import clean_digest
from sightline.operators import search as op
from sightline.plans.views import FRAMES, LIBRARY, POINTS, RECORDS, _digest, frames, library, points, query_points, records, table

QUERIES, SQL = {}, {}
DOT = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})) + 1e-12)"


def _top(column: str, floor: float, k: int):
    def query(spark, d):
        p = library(spark, d)
        asked = p.where(F.col("point_id") % 100 == 0)
        return op.top_k(asked, p, "point_id", column, "point_id", column, floor, k).withColumn("score", F.round("score", 6))

    return query


def _top_sql(column: str, floor: float, k: int) -> str:
    cos = DOT.format(a=f"q.{column}", b=f"p.{column}")
    return f"""WITH {LIBRARY}, s AS (
        SELECT q.point_id AS query_id, p.point_id, {cos} AS score FROM library q, library p WHERE q.point_id % 100 = 0 AND q.{column} IS NOT NULL AND p.{column} IS NOT NULL)
    SELECT query_id, rnk::INT AS rnk, point_id, round(score, 6) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, point_id) AS rnk FROM s WHERE score >= {floor}) WHERE rnk <= {k}"""


QUERIES["semantic_topk"] = _top("dino", op.SEMANTIC_FLOOR, 10)
SQL["semantic_topk"] = _top_sql("dino", op.SEMANTIC_FLOOR, 10)
QUERIES["altered_topk"] = _top("sscd", op.ALTERED_FLOOR, 10)
SQL["altered_topk"] = _top_sql("sscd", op.ALTERED_FLOOR, 10)


def reference_overlay(spark, d):
    found = op.overlay(query_points(spark, d), points(spark, d), "point_id", "dino", "point_id", "dino", 0.2, 5)
    return found.withColumn("score", F.round("score", 6))


QUERIES["reference_overlay"] = reference_overlay
SQL["reference_overlay"] = f"""WITH {POINTS}, s AS (
    SELECT q.point_id AS query_id, p.point_id, p.is_reference, {DOT.format(a='q.dino', b='p.dino')} AS score FROM points q, points p WHERE q.point_id % 100 = 0)
SELECT query_id, rnk::INT AS rnk, point_id, round(score, 6) AS score, is_reference FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, is_reference ORDER BY round(score, 9) DESC, point_id) AS rnk FROM s WHERE score >= 0.2) WHERE rnk <= 5"""


def exact_images(spark, d):
    r = records(spark, d)
    wanted = r.where(F.col("record_id") % 100 == 0).select(F.col("record_id").alias("query_id"), F.col("sha256").alias("image_hash")).where("image_hash is not null")
    return op.exact_images(wanted, r.select(F.col("sha256").alias("image_hash"), "path"))


QUERIES["exact_images"] = exact_images
SQL["exact_images"] = f"""WITH {RECORDS}, m AS (
    SELECT DISTINCT q.record_id AS query_id, p.path FROM records q JOIN records p USING (sha256) WHERE q.record_id % 100 = 0)
SELECT query_id, path, rnk::INT AS rnk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY path) AS rnk FROM m) WHERE rnk <= 50"""


def md5_collisions(spark, d):
    r = records(spark, d)
    wanted = r.select(F.col("record_id").alias("query_id"), "md5", "sha256")
    return op.md5_collisions(wanted, r.select("md5", "sha256", "path"))


QUERIES["md5_collisions"] = md5_collisions
SQL["md5_collisions"] = f"""WITH {RECORDS}
SELECT DISTINCT q.record_id AS query_id, p.path FROM records q JOIN records p ON q.md5 = p.md5 AND q.sha256 <> p.sha256"""


def _video_query(spark, d):
    f = frames(spark, d).select("video_hash", F.concat(F.lit("/v/"), "video_hash").alias("video_path"), "frame_hash", F.col("timecode_ms").cast("string").alias("frame_timecode_ms"))
    return table(spark, d, "videos").select("video_hash").distinct().withColumn("query_id", F.col("video_hash")), f


def exact_videos(spark, d):
    return op.exact_videos(*_video_query(spark, d)).drop("video_path")


QUERIES["exact_videos"] = exact_videos
SQL["exact_videos"] = f"""WITH {FRAMES}
SELECT video_hash AS query_id, count(DISTINCT timecode_ms) AS n, min(timecode_ms) AS first_timecode_ms,
       arg_min(frame_hash, (timecode_ms, frame_hash)) AS first_frame, max(timecode_ms) AS last_timecode_ms
FROM frames WHERE timecode_ms IS NOT NULL AND video_hash IN (SELECT video_hash FROM videos) GROUP BY ALL"""


def exact_matched_frames(spark, d):
    return op.exact_matched_frames(*_video_query(spark, d)).drop("video_path")


QUERIES["exact_matched_frames"] = exact_matched_frames
SQL["exact_matched_frames"] = f"""WITH {FRAMES}
SELECT video_hash AS query_id, timecode_ms, min(frame_hash) AS frame_hash
FROM frames WHERE timecode_ms IS NOT NULL AND video_hash IN (SELECT video_hash FROM videos) GROUP BY ALL"""


def video_timeline(spark, d):
    return frames(spark, d).where("timecode_ms is not null and video_hash is not null").groupBy("video_hash", "timecode_ms").agg(F.min("frame_hash").alias("frame_hash"))


QUERIES["video_timeline"] = video_timeline
SQL["video_timeline"] = f"WITH {FRAMES} SELECT video_hash, timecode_ms, min(frame_hash) AS frame_hash FROM frames WHERE timecode_ms IS NOT NULL AND video_hash IS NOT NULL GROUP BY ALL"


def hash_to_point(spark, d):
    """First point per hash: the case collection before the reference one."""
    p = points(spark, d)
    side = F.when(F.col("is_reference"), 1).otherwise(0)
    return p.groupBy("image_hash").agg(F.min_by("point_id", F.struct(side.alias("s"), "point_id")).alias("point_id"))


QUERIES["hash_to_point"] = hash_to_point
SQL["hash_to_point"] = f"""WITH {POINTS} SELECT image_hash, point_id FROM (
    SELECT *, row_number() OVER (PARTITION BY image_hash ORDER BY is_reference, point_id) AS r FROM points) WHERE r = 1"""


def filtered_points(spark, d):
    """Conjunctive equality filter with projection."""
    return points(spark, d).where(F.col("is_video_frame") & ~F.col("is_reference") & F.col("dino").isNotNull()).select("point_id", "video_path", "frame_timecode_ms")


QUERIES["filtered_points"] = filtered_points
SQL["filtered_points"] = f"WITH {POINTS} SELECT point_id, video_path, frame_timecode_ms FROM points WHERE is_video_frame AND NOT is_reference AND dino IS NOT NULL"


def points_by_hash(spark, d):
    """Hits whose query is itself among the found files, by digest (disjunction as a semi-join)."""
    h = table(spark, d, "hits")
    have = h.select(clean_digest("image_hash", 64).alias("digest")).where("digest is not null").distinct()
    return h.select("hit_id", clean_digest("query_hash", 64).alias("digest")).join(have, "digest", "left_semi").select("hit_id", "digest")


QUERIES["points_by_hash"] = points_by_hash
SQL["points_by_hash"] = f"""WITH h AS (SELECT hit_id, {_digest('query_hash', 64)} AS digest, {_digest('image_hash', 64)} AS other FROM hits)
SELECT hit_id, digest FROM h WHERE digest IN (SELECT other FROM h)"""
