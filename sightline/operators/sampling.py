"""Sampling of time-ordered frames.

Greedy sampling depends on the frame kept before.  A video is cut into blocks of
time that are sampled side by side, each as if nothing came before it; where
the last pick of the blocks before reaches into a block, that block is sampled
again from there, until no seam is wrong.  Picks of two starts soon fall
together, so a second look is mostly the last, and a video of any length is
never in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.session import Scratch

# milliseconds of a block at least: it holds no more frames than that; and steps of the sampling in it
BLOCK_MS, BLOCK_STEPS = 1_000_000, 256


def _sampler(step: float) -> Callable:
    """Picks of ``(video, block, t, h, target)``, sorted by video, block and t: the first frame at or after the target, then a step on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        group, target = None, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            videos, blocks = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            codes = videos.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            t = batch.column(2).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((np.diff(codes, prepend=codes[0]) != 0) | (np.diff(blocks, prepend=blocks[0]) != 0))
            bounds = [0, *cut.tolist(), len(t)]
            take = []
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                here = (videos[lo].as_py(), int(blocks[lo]))
                if here != group:
                    group, target = here, batch.column(4)[lo].as_py()
                at = lo + int(np.searchsorted(t[lo:hi], target))
                while at < hi:
                    take.append(at)
                    target = t[at] + step
                    at = lo + int(np.searchsorted(t[lo:hi], target))
            if take:
                yield batch.select([0, 1, 2, 3]).take(pa.array(take))

    return run


def _picked(rows: DataFrame, step: float) -> DataFrame:
    ordered = rows.select("video", "block", "t", "h", "target").repartition("video", "block").sortWithinPartitions("video", "block", "t")
    return ordered.mapInArrow(_sampler(step), "video string, block long, t long, h string")


def sample_frames(frames: DataFrame, video: str, timecode: str, digest: str, fps: float, max_frames: int = 0) -> DataFrame:
    """Kept frames ``(video, timecode_ms, frame_hash, frame_index)``.

    The first frame at or after the next target is taken; the target then moves
    ``1/fps`` past it, also where its picture was seen before in the video (such
    a frame is not kept and gets no index).  ``max_frames`` counts kept frames;
    0 means no limit.  Rows without video or timecode, or before time 0, are
    skipped; of several pictures at one time the smallest hash counts.
    """
    if fps <= 0:
        raise ValueError("fps must be positive")
    if max_frames < 0:
        raise ValueError("max_frames must not be negative")
    scratch, step = Scratch(frames.sparkSession), 1000.0 / fps
    width = max(BLOCK_MS, int(step * BLOCK_STEPS))
    rows = frames.select(F.col(video).cast("string").alias("video"), F.col(timecode).cast("bigint").alias("t"), F.col(digest).cast("string").alias("h"))
    once = rows.where("video is not null and t >= 0").groupBy("video", "t").agg(F.min("h").alias("h")).withColumn("block", F.floor(F.col("t") / width))
    picks = scratch.write(_picked(once.withColumn("target", F.lit(0.0)), step), "picks")
    begun = once.select("video", "block").distinct().withColumn("used", F.lit(0.0))
    before = Window.partitionBy("video").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        ends = picks.groupBy("video", "block").agg(F.min("t").alias("first"), F.max("t").alias("last"))
        met = begun.join(ends, ["video", "block"], "left").withColumn("target", F.coalesce(F.max("last").over(before) + F.lit(step), F.lit(0.0)))
        # begun too late, or too early with a pick that the blocks before rule out
        wrong = (F.col("used") > F.col("target")) | ((F.col("used") < F.col("target")) & F.coalesce(F.col("first") < F.col("target"), F.lit(False)))
        seams = scratch.write(met.select("video", "block", "used", "target", wrong.alias("wrong")), "seams")
        late = seams.where("wrong").select("video", "block", "target")
        if late.isEmpty():
            break
        again = _picked(once.join(late, ["video", "block"]), step)
        picks = scratch.write(picks.join(late.select("video", "block"), ["video", "block"], "left_anti").unionByName(again), "picks")
        begun = seams.select("video", "block", F.when(F.col("wrong"), F.col("target")).otherwise(F.col("used")).alias("used"))
    seen = picks.groupBy("video", "h").agg(F.min("t").alias("t")).withColumn("block", F.floor(F.col("t") / width))
    # numbered in their blocks, which begin where the blocks before end
    sizes = seen.groupBy("video", "block").agg(F.count("*").alias("n"))
    base = sizes.select("video", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("video", "block").orderBy("t", "h"))
    numbered = seen.withColumn("place", inside).join(base, ["video", "block"])
    kept = numbered.select("video", F.col("t").alias("timecode_ms"), F.col("h").alias("frame_hash"), (F.col("base") + F.col("place") - 1).cast("int").alias("frame_index"))
    return kept.where(F.col("frame_index") < max_frames) if max_frames else kept


def nearest_frame(frames: DataFrame, wanted: DataFrame, video: str, timecode: str, frame_ms: float) -> DataFrame:
    """The frame to show for each wanted ``(video, target_ms)``: adds ``frame_ms_found``.

    It is the first frame not earlier than one frame length before the target;
    if that lies more than a frame length behind the target and there is an
    earlier frame, the earlier one.  Null if the video ends before.
    """
    f = frames.select(F.col(video).alias("video"), F.col(timecode).cast("bigint").alias("t")).where("video is not null and t is not null")
    met = wanted.join(f, "video", "left")
    at = met.groupBy("video", "target_ms").agg(
        F.min(F.when(F.col("t") >= F.col("target_ms") - frame_ms, F.col("t"))).alias("here"),
        F.max(F.when(F.col("t") < F.col("target_ms") - frame_ms, F.col("t"))).alias("before"))
    return at.select("video", "target_ms", F.when((F.col("here") > F.col("target_ms") + frame_ms) & F.col("before").isNotNull(), F.col("before"))
                     .otherwise(F.col("here")).alias("found_ms"))


def pixel_hash(width: Column | str, height: Column | str, rgb: Column | str) -> Column:
    """Digest of a picture's size and pixels: sizes as four little-endian bytes each."""
    c = lambda x: F.col(x) if isinstance(x, str) else x

    def le32(x: Column) -> Column:
        h = F.lpad(F.hex(c(x).cast("bigint")), 8, "0")
        return F.unhex(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]))

    return F.sha2(F.concat(le32(width), le32(height), c(rgb)), 256)


def idle_sessions(events: DataFrame, session: str, at: str, now: Column, ttl_seconds: int) -> DataFrame:
    """Sessions whose last event is more than ``ttl_seconds`` before ``now`` (strictly)."""
    last = events.where(F.col(session).isNotNull()).groupBy(session).agg(F.max(F.col(at).cast("timestamp")).alias("last_access"))
    return last.where(F.unix_micros(now) - F.unix_micros("last_access") > ttl_seconds * 1_000_000)
