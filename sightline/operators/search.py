"""Vector search of a query set against all points, and lookups by hash."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.session import Scratch

# bytes of query vectors that go to the executors at once, and queries that a batch meets together
QUERY_BYTES, QUERY_BLOCK = 32 << 20, 1024
# fixed values: least cosines of the two vector modes
ALTERED_FLOOR, SEMANTIC_FLOOR = 0.75, 0.55
EXACT_CAP = 50


def unit_rows(column: pa.Array, dim: int):
    """Positions and vectors (double, scaled as stored) of a list column's values of that size."""
    import numpy as np

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (np.diff(offsets) == dim))
    values = column.values.to_numpy(zero_copy_only=False)  # null elements become NaN
    return at, values[offsets[:-1][at][:, None] + np.arange(dim)].astype(np.float64)


def cosines(v, q):
    """Cosines of rows with queries; 0 where a query has no length, -inf where a value is no number."""
    import numpy as np

    vn, qn = np.linalg.norm(v, axis=1), np.linalg.norm(q, axis=1)
    with np.errstate(all="ignore"):
        s = (v @ q.T) / (vn[:, None] * qn[None, :] + 1e-12)
        s[:, qn < 1e-12] = 0.0
        # NaN would count as greatest in a cut
        s[~np.isfinite(s)] = -np.inf
    return s


def _scored(ids: bytes, matrix: bytes, dim: int, floor: float | None, k: int | None):
    """Pairs ``(query_id, point_id, score)`` of an Arrow batch of points with a block of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        qids, q = np.frombuffer(ids, "<i8"), np.frombuffer(matrix, "<f8").reshape(-1, dim)
        for batch in batches:
            at, v = unit_rows(batch.column(1), dim)
            for lo in range(0, len(q) if len(at) else 0, QUERY_BLOCK):
                s = cosines(v, q[lo:lo + QUERY_BLOCK])
                keep = np.isfinite(s) if floor is None else s >= floor
                if k is not None and len(s) > k:
                    # only the batch's best of each query can be among the best of all
                    keep &= s >= np.partition(s, -k, axis=0)[-k][None, :]
                i, j = np.nonzero(keep)
                if len(i):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(qids[lo + j]), batch.column(0).take(pa.array(at[i])), pa.array(s[i, j])], names=["query_id", "point_id", "score"]
                    )

    return run


def scores(queries: DataFrame, points: DataFrame, query_id: str, query_vector: str, point_id: str, vector: str,
           floor: float | None = None, k: int | None = None) -> DataFrame:
    """``(query_id, point_id, score)`` of every pair, less those below ``floor`` or surely outside the best ``k``.

    The query set goes to the executors in blocks of at most ``QUERY_BYTES``, so
    what the driver and each executor hold is bounded; the points stream past a
    block in Arrow batches and are never shuffled.  Where there are several
    blocks each one's result is written before the next is read.  Null vectors,
    those with a null element and those of another size take no part.
    """
    spark, scratch = points.sparkSession, Scratch(points.sparkSession)
    wanted = scratch.write(
        queries.select(F.col(query_id).cast("bigint").alias("id"), F.col(query_vector).cast("array<double>").alias("v"))
        .where("id is not null and size(v) > 0").where(F.forall("v", lambda x: x.isNotNull())), "queries")
    side = points.select(F.col(point_id).cast("bigint").alias("point_id"), F.col(vector).cast("array<double>").alias("v"))
    found = []
    sizes = wanted.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").collect()
    for dim, total in sizes:
        blocks = -(-total // max(1, QUERY_BYTES // (8 * dim)))
        for b in range(blocks):
            part = wanted.where((F.size("v") == dim) & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)).toArrow()
            if not part.num_rows:
                continue
            _, q = unit_rows(part.column("v"), dim)
            met = side.mapInArrow(_scored(part.column("id").to_numpy().astype("<i8").tobytes(), q.tobytes(), dim, floor, k), "query_id long, point_id long, score double")
            found.append(met if len(sizes) == blocks == 1 else scratch.write(met, "scores"))
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], "query_id long, point_id long, score double")


def top_k(queries: DataFrame, points: DataFrame, query_id: str, query_vector: str, point_id: str, vector: str, floor: float | None, k: int) -> DataFrame:
    """The ``k`` best points of each query with cosine of at least ``floor``: ``(query_id, rnk, point_id, score)``.

    Threshold and limit hold together.  Ties go to the smaller point id; scores
    are compared at 9 digits so that neither the order of summing nor the
    guard in the denominator decides.
    """
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "point_id")
    found = scores(queries, points, query_id, query_vector, point_id, vector, floor, k)
    return found.withColumn("rnk", F.row_number().over(best)).where(F.col("rnk") <= k).select("query_id", "rnk", "point_id", "score")


def overlay(queries: DataFrame, points: DataFrame, query_id: str, query_vector: str, point_id: str, vector: str, floor: float, k: int,
            reference: str = "is_reference") -> DataFrame:
    """Top-k of the case points and, marked, of the reference points; neither displaces the other."""
    args = (query_id, query_vector, point_id, vector, floor, k)
    case = top_k(queries, points.where(~F.col(reference)), *args).withColumn("is_reference", F.lit(False))
    ref = top_k(queries, points.where(F.col(reference)), *args).withColumn("is_reference", F.lit(True))
    return case.unionByName(ref)


def exact_images(queries: DataFrame, points: DataFrame, cap: int = EXACT_CAP, carried: tuple[str, ...] = (), modes: tuple[str, ...] = ()) -> DataFrame:
    """Points with a query's image hash, one row per path, at most ``cap`` by path: ``(query_id, path, rnk)``.

    ``carried`` columns come from a path's first point (by ``point_id``), the model of each
    of ``modes`` in the points' ``provenance`` from the last that has one.
    """
    met = queries.join(points, "image_hash")
    if carried or modes:
        model = lambda m: F.element_at("provenance", F.lit(m))
        once = met.groupBy("query_id", "path").agg(
            F.min_by(F.struct(F.col("point_id").alias("_id"), *carried), "point_id").alias("_p"),
            *[F.max_by(model(m), F.when(model(m).isNotNull(), F.col("point_id"))).alias(f"_{m}") for m in modes])
        known = F.map_filter(F.create_map(*[x for m in modes for x in (F.lit(m), F.col(f"_{m}"))]), lambda _, v: v.isNotNull())
        once = once.select("query_id", "path", *[F.col(f"_p.{c}").alias(c) for c in carried], *([known.alias("provenance")] if modes else []))
    else:
        once = met.select("query_id", "path").distinct()
    by_path = Window.partitionBy("query_id").orderBy("path")
    return once.withColumn("rnk", F.row_number().over(by_path)).where(F.col("rnk") <= cap)


def md5_collisions(queries: DataFrame, points: DataFrame) -> DataFrame:
    """Points with a query's md5 but another sha256: ``(query_id, path)``, each path once."""
    p = points.where("sha256 is not null").select("md5", F.col("sha256").alias("other"), "path").distinct()
    # only an md5 that two sha256 share can collide: all others leave before the join
    shared = p.groupBy("md5").agg(F.min("other").alias("least"), F.max("other").alias("most"))
    asked = queries.where("sha256 is not null").join(shared, "md5").where("least <> most or least <> sha256").select("query_id", "md5", "sha256")
    return asked.join(p, "md5").where("sha256 <> other").select("query_id", "path").distinct()


def exact_videos(queries: DataFrame, frames: DataFrame, modes: tuple[str, ...] = ()) -> DataFrame:
    """Indexed frames of a query's video, per video path: ``(query_id, video_path, n, first_timecode_ms, first_frame, last_timecode_ms)``.

    Each timecode counts once.  Malformed timecodes (null or no integer) and
    rows without a path are skipped.  Timecodes are counted, not gathered: one
    video may hold a large share of all frames.  Where the frames have a ``path``
    the first one's is ``first_path``; with ``modes`` the ``provenance`` holds, for
    each, the model of the first frame (by ``point_id``) that names one.
    """
    once = exact_matched_frames(queries, frames)
    counted = once.groupBy("query_id", "video_path").agg(
        F.count("*").alias("n"), F.min(F.struct("timecode_ms", "frame_hash")).alias("first"), F.max("timecode_ms").alias("last_timecode_ms"),
    ).select("query_id", "video_path", "n", F.col("first.timecode_ms").alias("first_timecode_ms"), F.col("first.frame_hash").alias("first_frame"), "last_timecode_ms")
    if "path" not in frames.columns:
        return counted
    met = queries.join(_timed_frames(frames), "video_hash")
    model = lambda m: F.element_at("provenance", F.lit(m))
    more = met.groupBy("query_id", "video_path").agg(
        F.min(F.struct("tc", "frame_hash", "path")).alias("_f"), F.min("video_hash").alias("video_hash"),
        *[F.min_by(model(m), F.when(model(m).isNotNull(), F.col("point_id"))).alias(f"_{m}") for m in modes])
    known = F.map_filter(F.create_map(*[x for m in modes for x in (F.lit(m), F.col(f"_{m}"))]), lambda _, v: v.isNotNull())
    more = more.select("query_id", "video_path", "video_hash", F.col("_f.path").alias("first_path"), *([known.alias("provenance")] if modes else []))
    return counted.join(more, ["query_id", "video_path"])


def exact_matched_frames(queries: DataFrame, frames: DataFrame) -> DataFrame:
    """The frames that ``exact_videos`` counts, with their hash: ``(query_id, video_path, timecode_ms, frame_hash)``."""
    met = queries.join(_timed_frames(frames), "video_hash")
    return met.groupBy("query_id", "video_path", F.col("tc").alias("timecode_ms")).agg(F.min("frame_hash").alias("frame_hash"))


def exact_video_frames(queries: DataFrame, frames: DataFrame) -> DataFrame:
    """The same frames one by one: ``(query_id, video_path, timecode_ms)``."""
    met = queries.join(_timed_frames(frames), "video_hash")
    return met.select("query_id", "video_path", F.col("tc").alias("timecode_ms")).distinct()


def _timed_frames(frames: DataFrame) -> DataFrame:
    more = [c for c in ("path", "point_id", "provenance") if c in frames.columns]
    return frames.select("video_hash", "video_path", "frame_hash", *more, F.expr("try_cast(frame_timecode_ms AS BIGINT)").alias("tc")).where(
        "tc is not null and coalesce(video_path, '') <> ''")
