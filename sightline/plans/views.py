"""Input views of the registered queries, once for Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.functions.digests import clean_digest


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def points(spark: SparkSession, d: str) -> DataFrame:
    frame = F.col("vec_id") % 3 == 0
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("point_id"), F.col("embedding").alias("dino"), F.slice("embedding", 1, 32).alias("sscd"), "label",
        (F.col("vec_id") % 5 == 0).alias("is_reference"), frame.alias("is_video_frame"),
        F.when(frame, F.concat(F.lit("v"), F.col("label"))).alias("video_path"),
        F.concat(F.lit("/case/img/"), F.col("vec_id").cast("string"), F.lit(".jpg")).alias("path"),
        F.sha2((F.col("vec_id") % 400).cast("string"), 256).alias("image_hash"), (F.col("vec_id") * 1000).alias("frame_timecode_ms"),
    )


POINTS = """points AS (
    SELECT vec_id AS point_id, embedding::DOUBLE[] AS dino, list_slice(embedding, 1, 32)::DOUBLE[] AS sscd, label,
           vec_id % 5 = 0 AS is_reference, vec_id % 3 = 0 AS is_video_frame,
           CASE WHEN vec_id % 3 = 0 THEN 'v' || label END AS video_path, '/case/img/' || vec_id || '.jpg' AS path,
           sha256((vec_id % 400)::VARCHAR) AS image_hash, vec_id * 1000 AS frame_timecode_ms
    FROM embeddings)"""


def _usable(column: str) -> F.Column:
    """The vector where it has 128 finite values that are not all zero."""
    good = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(column, lambda x: x != 0)
    return F.when((F.size(column) == 128) & good, F.col(column))


def library(spark: SparkSession, d: str) -> DataFrame:
    """The uploaded entries as an indexed collection; videos of a session are frames of one video."""
    video = F.col("is_video")
    return table(spark, d, "query_files").select(
        F.col("entry_id").alias("point_id"), F.col("filename").alias("path"), F.col("file_hash").alias("image_hash"), video.alias("is_video_frame"),
        F.when(video, F.col("session_id")).alias("video_path"), F.when(video, F.col("file_hash")).alias("video_hash"), (F.col("entry_id") * 1000).alias("frame_timecode_ms"),
        (F.col("entry_id") % 5 == 0).alias("is_reference"), _usable("dino_embedding").alias("dino"), _usable("sscd_embedding").alias("sscd"),
        (F.col("entry_id") % 7 == 0).alias("exif"), (F.col("entry_id") % 21 == 0).alias("exif_geo_data"),
        *[x for v in ("dino", "sscd") for x in (F.when(F.col("entry_id") % 11 > 0, F.concat(F.lit(f"{v}-"), (F.col("entry_id") % 4).cast("string"))).alias(f"{v}_model_name"), F.md5("session_id").alias(f"{v}_model_hash"))])


LIBRARY = """library AS (
    SELECT entry_id AS point_id, filename AS path, file_hash AS image_hash, is_video AS is_video_frame, CASE WHEN is_video THEN session_id END AS video_path,
           CASE WHEN is_video THEN file_hash END AS video_hash, entry_id * 1000 AS frame_timecode_ms, entry_id % 5 = 0 AS is_reference,
           CASE WHEN len(dino_embedding) = 128 AND len(list_filter(dino_embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 128
                AND len(list_filter(dino_embedding, lambda x: x <> 0)) > 0 THEN dino_embedding::DOUBLE[] END AS dino,
           CASE WHEN len(sscd_embedding) = 128 AND len(list_filter(sscd_embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 128
                AND len(list_filter(sscd_embedding, lambda x: x <> 0)) > 0 THEN sscd_embedding::DOUBLE[] END AS sscd,
           entry_id % 7 = 0 AS exif, entry_id % 21 = 0 AS exif_geo_data, CASE WHEN entry_id % 11 > 0 THEN 'dino-' || entry_id % 4 END AS dino_model_name,
           md5(session_id) AS dino_model_hash, CASE WHEN entry_id % 11 > 0 THEN 'sscd-' || entry_id % 4 END AS sscd_model_name, md5(session_id) AS sscd_model_hash
    FROM query_files)"""


def session(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The stated query set - entries whose id is divisible by 100 - as files and query vectors."""
    q = table(spark, d, "query_files").where(F.col("entry_id") % 100 == 0)
    files = q.select(F.col("entry_id").alias("file_id"), "is_video", "error", "file_hash", "file_hash_md5")
    one = lambda mode, c, at: q.select((F.col("entry_id") * 2 + at).alias("q_id"), F.col("entry_id").alias("file_id"), F.lit(mode).alias("mode"),
                                       F.when(F.col("is_video"), F.col("entry_id") * 10).alias("query_timecode_ms"), _usable(c).alias("vec")).where("vec is not null")
    return files, one("altered", "sscd_embedding", 0).unionByName(one("semantic", "dino_embedding", 1))


def query_points(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every point whose id is divisible by 100."""
    return points(spark, d).where(F.col("point_id") % 100 == 0)


def records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_records").select(
        "record_id", "batch_no", "path", "status", F.coalesce("reason", F.lit("")).alias("reason"), "is_frame", "scanned_at",
        clean_digest("sha256", 64).alias("sha256"), clean_digest("md5", 32).alias("md5"))


def _digest(col: str, digits: int) -> str:
    bare = f"regexp_replace(lower(regexp_replace({col}, '^\\s+|\\s+$', '', 'g')), '^(sha-?256\\s*[:=]\\s*|md5\\s*[:=]\\s*|0x)', '')"
    return f"CASE WHEN regexp_full_match({bare}, '[0-9a-f]{{{digits}}}') AND {bare} <> repeat(left({bare}, 1), {digits}) THEN {bare} END"


RECORDS = f"""records AS (
    SELECT record_id, batch_no, path, status, coalesce(reason, '') AS reason, is_frame, scanned_at,
           {_digest('sha256', 64)} AS sha256, {_digest('md5', 32)} AS md5
    FROM file_records)"""


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Matched frames, each delivery once, hashes in one notation."""
    return table(spark, d, "matched_frames").select(
        "match_id", "entry_id", F.lower(F.regexp_replace("video_hash", r"^\s+|\s+$", "")).alias("video_hash"), "timecode_ms", "frame_hash",
        F.element_at("scores", F.lit("exact")).alias("exact"), F.element_at("scores", F.lit("altered")).alias("altered"),
        F.element_at("scores", F.lit("semantic")).alias("semantic"), "is_reference",
    ).select("match_id", "entry_id", "video_hash", "timecode_ms", "frame_hash", "is_reference",
             *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("exact", "altered", "semantic")]).distinct()


FRAMES = """frames AS (
    SELECT DISTINCT match_id, entry_id, lower(regexp_replace(video_hash, '^\\s+|\\s+$', '', 'g')) AS video_hash, timecode_ms, frame_hash, is_reference,
           CASE WHEN NOT isnan(scores['exact']) THEN scores['exact'] END AS exact,
           CASE WHEN NOT isnan(scores['altered']) THEN scores['altered'] END AS altered,
           CASE WHEN NOT isnan(scores['semantic']) THEN scores['semantic'] END AS semantic
    FROM matched_frames)"""


def score_map() -> F.Column:
    return F.map_filter(F.create_map(*[x for m in ("exact", "altered", "semantic") for x in (F.lit(m), F.col(m))]), lambda _, v: v.isNotNull())


TAG_ROWS = [
    (1, "boats", [0, 1, 2, 3], [10, 11, 12], None, ""), (2, "rooms", [4, 5], [], None, ""), (3, "benign", [], [20, 21], None, ""),
    (4, "wide", list(range(30, 40)), list(range(50, 60)), 31, ""), (5, "lost", [6, 900_000_002], [900_000_001, 900_000_003], None, ""), (6, "aimed", [7, 8], [9], 15, ""),
]


EXAMPLES = 8


def tags(spark: SparkSession, d: str) -> DataFrame:
    """A tag per label - its first points against the first of the next label - and the odd ones above."""
    odd = spark.createDataFrame(TAG_ROWS, "tag_id long, name string, positive_ids array<long>, negative_ids array<long>, target_id long, notes string")
    first = table(spark, d, "embeddings").withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where(F.col("_r") <= EXAMPLES)
    own = first.groupBy(F.col("label").cast("bigint").alias("label")).agg(F.sort_array(F.collect_list(F.col("vec_id").cast("bigint"))).alias("ids"))
    other = own.select((F.col("label") - 1).alias("label"), F.col("ids").alias("others"))
    none = F.array().cast("array<bigint>")
    made = own.join(other, "label", "left").select(
        (F.col("label") + 100).alias("tag_id"), F.concat(F.lit("label-"), F.col("label").cast("string")).alias("name"), F.col("ids").alias("positive_ids"),
        F.coalesce("others", none).alias("negative_ids"), F.lit(None).cast("bigint").alias("target_id"), F.lit("").alias("notes"))
    return odd.unionByName(made)


TAGS = "tags(tag_id, name, positive_ids, negative_ids, target_id, notes) AS (VALUES " + ", ".join(
    f"({t}::BIGINT, '{n}', {p}::BIGINT[], {q}::BIGINT[], {'NULL' if g is None else g}::BIGINT, '')" for t, n, p, q, g, _ in TAG_ROWS) + f""" UNION ALL
    SELECT a.label + 100, 'label-' || a.label, a.ids, coalesce(b.ids, []::BIGINT[]), NULL::BIGINT, ''
    FROM (SELECT label::BIGINT AS label, list_sort(list(vec_id::BIGINT))[1:{EXAMPLES}] AS ids FROM embeddings GROUP BY 1) a
    LEFT JOIN (SELECT label::BIGINT AS label, list_sort(list(vec_id::BIGINT))[1:{EXAMPLES}] AS ids FROM embeddings GROUP BY 1) b ON b.label = a.label + 1)"""
