"""Best rows of every group by a streamed secondary sort (problem 2)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _first_n(n: int):
    """Pass the first ``n`` distinct ids of every group of a sorted stream.

    Only the running group, its count and the ids it has passed are kept; a
    batch is cut by rank arithmetic, so no group is ever buffered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        group, passed = None, set()
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids = batch.column("grp"), batch.column("id").to_numpy(zero_copy_only=False)
            rows = batch.num_rows
            new = np.ones(rows, bool)
            if rows > 1:
                new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            if keys[0].as_py() == group:
                starts = starts[1:]
            else:
                group, passed = keys[0].as_py(), set()
            take: list[int] = []
            bounds = [0, *[int(s) for s in starts if s > 0], rows]
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                if lo:
                    group, passed = keys[lo].as_py(), set()
                at = lo
                while at < hi and len(passed) < n:
                    if ids[at] not in passed:
                        passed.add(ids[at])
                        take.append(at)
                    at += 1
            if take:
                yield batch.take(pa.array(take))

    return run


def top_n_per_group(df: DataFrame, group: Column, order: list[tuple[Column, bool]], row_id: Column, n: int) -> DataFrame:
    """The ``n`` first rows of every group, as ``(grp, id, rank_1..)``.

    ``order`` lists ``(column, descending)``; ``row_id`` ends every tie and counts
    once per group, so repeated deliveries of a row change nothing.  Rows whose
    group or id is null are left out; null order values come last.  An empty
    table gives no rows; ``n`` below one gives none either.

    Plan: every input partition is sorted and streamed once before the shuffle,
    which leaves at most ``n`` rows per group and partition - a group of a third
    of all rows sends no more than that.  Then rows are hash-partitioned by
    group, sorted within the partition by group, order and id, and streamed in
    Arrow batches again.
    """
    cols = [c.alias(f"rank_{i}") for i, (c, _) in enumerate(order, 1)]
    rows = df.select(group.alias("grp"), row_id.cast("bigint").alias("id"), *cols).where("grp is not null and id is not null")
    keys = [F.col(f"rank_{i}").desc_nulls_last() if down else F.col(f"rank_{i}").asc_nulls_last() for i, (_, down) in enumerate(order, 1)]
    keys = [F.col("grp").asc(), *keys, F.col("id").asc()]
    local = rows.sortWithinPartitions(*keys).mapInArrow(_first_n(n), rows.schema)
    return local.repartition("grp").sortWithinPartitions(*keys).mapInArrow(_first_n(n), rows.schema)


def best_number(scores: Column) -> Column:
    """The greatest number of a map; null and NaN are no numbers."""
    return F.array_max(F.filter(F.map_values(scores), lambda x: x.isNotNull() & ~F.isnan(x)))


def best_frames(frames: DataFrame, n: int = 3) -> DataFrame:
    """``(video_hash, match_id, score, timecode_ms)``: the best ``n`` frames of each video.

    Score: the greatest number in ``scores``; rows without one or without a
    video are left out.  Order: score down, timecode up (missing counts as 0),
    match_id up.  Video hashes are compared in lower case without surrounding
    white space; one that is blank is none.
    """
    video = F.lower(F.regexp_replace("video_hash", r"^\s+|\s+$", ""))
    rows = frames.select(
        F.when(video != "", video).alias("video"), best_number(F.col("scores")).alias("score"),
        F.coalesce(F.col("timecode_ms").cast("bigint"), F.lit(0).cast("bigint")).alias("timecode"), "match_id",
    ).where("score is not null")
    top = top_n_per_group(rows, F.col("video"), [(F.col("score"), True), (F.col("timecode"), False)], F.col("match_id"), n)
    return top.select(F.col("grp").alias("video_hash"), F.col("id").alias("match_id"),
                      F.col("rank_1").alias("score"), F.col("rank_2").alias("timecode_ms"))
