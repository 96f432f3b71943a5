"""Winner election, comparison with the index, and status roll-ups of an ingest run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def elect_winners(files: DataFrame, digest: str, order: str, namespace: str | None = None) -> DataFrame:
    """Adds ``winner`` (the first row of each digest) and ``is_dup``; rows without a digest elect nobody.

    With a ``namespace`` column digests are compared within it only: a frame
    of a video never stands for an image of the same content.

    The first is a minimum per digest joined back, not a window: a digest of a
    third of the rows stays a partial aggregate.
    """
    by = [digest] if namespace is None else [namespace, digest]
    first = files.where(F.col(digest).isNotNull()).groupBy(*by).agg(F.min(order).alias("winner"))
    return files.join(first, by, "left").withColumn("is_dup", F.coalesce(F.col("winner") != F.col(order), F.lit(False)))


def not_indexed(files: DataFrame, indexed: DataFrame, mode: str, digest: str = "sha256", path: str = "path") -> DataFrame:
    """Files that the index lacks by ``hash``, by ``filepath`` or by ``both`` (neither known).

    A null digest or path matches nothing.
    """
    if mode not in ("hash", "filepath", "both"):
        raise ValueError(f"unknown comparison {mode!r}")
    out = files
    if mode in ("hash", "both"):
        out = out.join(indexed.select(digest).where(F.col(digest).isNotNull()).distinct(), digest, "left_anti")
    if mode in ("filepath", "both"):
        out = out.join(indexed.select(path).where(F.col(path).isNotNull()).distinct(), path, "left_anti")
    return out


def spread_failures(files: DataFrame, digest: str, status: str, failed: str) -> DataFrame:
    """Copies of a file that failed are marked failed: adds ``final_status``."""
    bad = files.where((F.col(status) == failed) & F.col(digest).isNotNull()).select(digest, F.lit(True).alias("_bad")).distinct()
    return files.join(bad, digest, "left").withColumn("final_status", F.when(F.col("_bad"), failed).otherwise(F.col(status))).drop("_bad")


def status_counts(files: DataFrame, status: str) -> DataFrame:
    return files.groupBy(status).agg(F.count("*").alias("n"))


def needs_per_model(winners: DataFrame, indexed: dict[str, DataFrame], digest: str) -> DataFrame:
    """Adds one flag ``needs_<model>`` per model and ``needs_any``."""
    out = winners
    for model, known in indexed.items():
        have = known.select(digest).where(F.col(digest).isNotNull()).distinct().withColumn("_have", F.lit(True))
        out = out.join(have, digest, "left").withColumn(f"needs_{model}", F.col("_have").isNull()).drop("_have")
    any_needed = F.lit(False)
    for model in indexed:
        any_needed = any_needed | F.col(f"needs_{model}")
    return out.withColumn("needs_any", any_needed)


def video_states(videos: DataFrame) -> DataFrame:
    """One row per video hash: first record's configuration and whether any marks it complete."""
    return videos.groupBy("video_hash").agg(
        F.min_by(F.struct("extraction_fps", "max_frames_cap", "video_path"), F.struct("indexed_at", "point_id", "arrived_at")).alias("c"),
        F.bool_or(F.col("total_frames").isNotNull()).alias("complete"), F.count("*").alias("records"),
    ).select("video_hash", "c.extraction_fps", "c.max_frames_cap", "c.video_path", "complete", "records")


def up_to_date(wanted: DataFrame, states: DataFrame, fps: float, cap: int) -> DataFrame:
    """Wanted videos that are complete under the same settings."""
    done = states.where(F.col("complete") & (F.col("extraction_fps") == fps) & (F.col("max_frames_cap") == cap))
    return wanted.join(done.select("video_hash"), "video_hash", "left_semi")


def completion(frames: DataFrame, totals: DataFrame) -> DataFrame:
    """Distinct indexed frames and repeats against the expected total: ``(video_hash, indexed, dups, total, complete)``."""
    per = frames.where("video_hash is not null").groupBy("video_hash").agg(
        F.countDistinct("frame_hash").alias("indexed"), (F.count("frame_hash") - F.countDistinct("frame_hash")).alias("dups"))
    return totals.join(per, "video_hash", "left").select(
        "video_hash", F.coalesce("indexed", F.lit(0)).alias("indexed"), F.coalesce("dups", F.lit(0)).alias("dups"), "total",
        (F.col("total").isNotNull() & (F.coalesce("indexed", F.lit(0)) + F.coalesce("dups", F.lit(0)) >= F.col("total"))).alias("complete"))


def run_completion(frames: DataFrame, indexed: DataFrame, totals: DataFrame, vectors: list[str]) -> DataFrame:
    """Per video and vector, whether a run has it whole: ``(video, vector, indexed, dups, total, complete)``.

    ``frames(frame, video, digest, is_dup)`` are the run's frames; ``indexed(frame,
    vector)`` those that got one of the ``vectors``; ``totals(video, total)`` the expected
    numbers.  A repeated frame counts for its video only where the frame that
    stands for its digest lies in the same video: one of another video never
    got this video's place.  Videos without an expected total are left out.
    """
    winner = frames.where("not is_dup and digest is not null").groupBy("digest").agg(F.min_by("video", "frame").alias("own"))
    dups = frames.where("is_dup").join(winner, "digest").where(F.col("own") == F.col("video")).groupBy("video").agg(F.count("*").alias("dups"))
    done = indexed.join(frames.where("not is_dup").select("frame", "video"), "frame").groupBy("video", "vector").agg(F.countDistinct("frame").alias("indexed"))
    grid = totals.where("total > 0").withColumn("vector", F.explode(F.array(*[F.lit(v) for v in vectors])))
    return (
        grid.join(done, ["video", "vector"], "left").join(dups, "video", "left")
        .select("video", "vector", F.coalesce("indexed", F.lit(0)).alias("indexed"), F.coalesce("dups", F.lit(0)).alias("dups"), "total")
        .withColumn("complete", F.col("indexed") + F.col("dups") >= F.col("total"))
    )


def model_counters(outcomes: DataFrame) -> DataFrame:
    """Per vector, how a run's files fared: ``(vector, indexed, skipped, failed)`` from ``(vector, status)``."""
    status = F.col("status")
    return outcomes.groupBy("vector").agg(
        F.count_if(status == "indexed").alias("indexed"), F.count_if(status.startswith("skipped")).alias("skipped"), F.count_if(status.startswith("failed")).alias("failed"))


def video_status() -> Column:
    """Roll-up of a video's completion row."""
    return F.when(F.col("total").isNull(), "unknown").when(F.col("complete"), "indexed").when(F.col("indexed") > 0, "partial").otherwise("pending")


def hash_cache_probe(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds cached digests where path, time and size are unchanged; ``cached`` needs both digests."""
    known = cache.select("path", "mtime", "size", F.col("sha256").alias("c_sha256"), F.col("md5").alias("c_md5")).dropDuplicates(["path", "mtime", "size"])
    hit = F.col("c_sha256").isNotNull() & (F.coalesce("c_md5", F.lit("")) != "")
    return files.join(known, ["path", "mtime", "size"], "left").withColumn("cached", hit)


def refreshed_cache(old: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or replace: the new entry of a path wins, else the old one stays."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = Window.partitionBy("path").orderBy(F.desc("_new"), F.desc("mtime"), F.desc("size"))
    return both.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_new")


def ingest_report(files: DataFrame) -> DataFrame:
    """Report rows by path: path, processed, reason, md5, sha256, is_video_frame."""
    return files.select(
        "path", F.when(F.col("status") == "indexed", "yes").otherwise("no").alias("processed"), F.coalesce("reason", F.lit("")).alias("reason"),
        "md5", "sha256", F.col("is_frame").alias("is_video_frame")).orderBy("path")
