"""The whole similarity query of an upload session: exact, near-copy and semantic.

Every query vector is searched for itself, in the case and, if wanted, in the
reference collection; hits of one query frame are merged by path, frames are
grouped by video, and at the end all hits of one path or video become one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.functions.media import best_score, provenance_map
from sightline.operators import hits as merge
from sightline.operators import search
from sightline.session import Scratch

VECTORS = {"altered": "sscd", "semantic": "dino"}  # fixed values: the vector of a mode
_FILE = ["image_hash", "is_video_frame", "video_path", "video_hash", "frame_timecode_ms", "exif", "exif_geo_data"]
PAYLOAD = ["point_id", "path", *_FILE]
_HIT = ["file_id", "query_timecode_ms", "path", *_FILE, "is_reference", "scores", "provenance", "ord"]
# columns that points may lack, and their types
_OPTIONAL = {"video_hash": "string", "exif": "boolean", "exif_geo_data": "boolean"} | {f"{v}_{c}": "string" for v in VECTORS.values() for c in ("model_name", "model_hash")}
# room between the orders of arrival of stages and query frames
STAGE, FRAME = 10**15, 10**6


def _whole(points: DataFrame) -> DataFrame:
    """Points with all columns that a hit carries; those they lack are null."""
    return points.withColumns({c: F.lit(None).cast(t) for c, t in _OPTIONAL.items() if c not in points.columns})


def vector_hits(vectors: DataFrame, points: DataFrame, mode: str, floor: float, k: int, reference: bool) -> DataFrame:
    """Raw hits of one mode in one collection: ``file_id, query_timecode_ms, payload.., mode, score, rnk``."""
    mine = vectors.where(F.col("mode") == mode)
    side = points.where(F.coalesce("is_reference", F.lit(False)) == F.lit(reference))
    top = search.top_k(mine, side, "q_id", "vec", "point_id", VECTORS[mode], floor, k)
    return (
        top.join(mine.select(F.col("q_id").alias("query_id"), "file_id", "query_timecode_ms"), "query_id")
        .join(side.select(*PAYLOAD, provenance_map({mode: VECTORS[mode]}).alias("provenance")), "point_id")
        .withColumns({"mode": F.lit(mode), "is_reference": F.lit(reference)})
    )


def _merged_by_path(raw: DataFrame) -> DataFrame:
    """Both modes' scores of one path on one row, per query frame and collection."""
    by = ["file_id", "query_timecode_ms", "is_reference", "path"]
    first = F.struct(F.when(F.col("mode") == "altered", 0).otherwise(1).alias("m"), "rnk")
    model = F.element_at("provenance", F.col("mode"))
    per_mode = raw.groupBy(*by, "mode").agg(
        F.max("score").alias("score"), F.max_by(model, F.when(model.isNotNull(), F.struct(F.round("score", 9), -F.col("rnk")))).alias("model"),
        F.min_by(F.struct(*_FILE), first).alias("p"), F.min(first).alias("first"))
    return per_mode.groupBy(*by).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("mode", "score")))).alias("scores"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("model").isNotNull(), F.struct("mode", "model"))))).alias("provenance"),
        F.min_by("p", "first").alias("p"), F.min("first").alias("first"),
    ).select(*by, "scores", "provenance", "p.*", (F.col("first.m") * FRAME + F.col("first.rnk")).alias("ord"))


def _grouped(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Video frames become one row per video; others pass."""
    frame = _is_frame()
    videos = merge.group_video_hits(rows.where(frame), keys)
    cols = [*keys, "path", *_FILE, "is_reference", "ord", "scores", "provenance"]
    return videos.select(*[c for c in dict.fromkeys(cols)]).unionByName(rows.where(~frame).withColumn("video_path", F.lit(None).cast("string")).select(*dict.fromkeys(cols)))


def _ordered(rows: DataFrame, stage: F.Column) -> DataFrame:
    """Order of arrival: stage, query frame, then best score down and path."""
    frame = F.coalesce(F.dense_rank().over(Window.partitionBy("file_id").orderBy("query_timecode_ms")), F.lit(0))
    place = F.row_number().over(Window.partitionBy("file_id", "query_timecode_ms", "is_reference").orderBy(F.desc(best_score("scores")), "path"))
    return rows.withColumn("ord", stage * STAGE + frame * FRAME + place)


def _is_frame() -> F.Column:
    return F.coalesce(F.col("is_video_frame"), F.lit(False)) & (F.coalesce("video_path", F.lit("")) != "")


def _exact_sides(files: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files with a digest, the case collection, and its frames by video hash."""
    case = points.where(~F.coalesce("is_reference", F.lit(False)))
    f = files.where("error is null and file_hash is not null").select(F.col("file_id").alias("query_id"), "file_hash", "is_video")
    named = _whole(case).withColumn("provenance", provenance_map(VECTORS))
    return f, named, named.select("point_id", "path", "provenance", "video_hash", "video_path", F.col("image_hash").alias("frame_hash"), "frame_timecode_ms")


def exact_hits(files: DataFrame, points: DataFrame) -> DataFrame:
    """Exact hits of the case collection: images by content, videos by their frames' video hash."""
    f, case, frames = _exact_sides(files, points)
    carried, modes = ("is_video_frame", "video_hash", "frame_timecode_ms", "exif", "exif_geo_data"), tuple(VECTORS)
    images = search.exact_images(f.where("not is_video").select("query_id", F.col("file_hash").alias("image_hash")), case, carried=carried, modes=modes)
    # an image hit keeps its own path, so that frames of one video stay apart
    images = images.join(f.select("query_id", F.col("file_hash").alias("image_hash")), "query_id").select(
        F.col("query_id").alias("file_id"), "path", F.lit(None).cast("string").alias("video_path"), *carried, "image_hash", "provenance", F.col("rnk").alias("ord"))
    videos = search.exact_videos(f.where("is_video").select("query_id", F.col("file_hash").alias("video_hash")), frames, modes)
    videos = videos.select(
        F.col("query_id").alias("file_id"), F.coalesce("first_path", "video_path").alias("path"), "video_path", F.lit(True).alias("is_video_frame"), "video_hash",
        F.col("first_timecode_ms").alias("frame_timecode_ms"), F.lit(None).cast("boolean").alias("exif"), F.lit(None).cast("boolean").alias("exif_geo_data"),
        F.col("first_frame").alias("image_hash"), "provenance", F.lit(0).alias("ord"))
    return images.unionByName(videos).withColumns({
        "query_timecode_ms": F.lit(None).cast("bigint"), "is_reference": F.lit(False), "scores": F.create_map(F.lit("exact"), F.lit(1.0)), "ord": F.col("ord").cast("bigint")})


def _raw_hits(files: DataFrame, vectors: DataFrame, points: DataFrame, modes: tuple[str, ...], altered: float, semantic: float, limit: int,
              include_reference: bool) -> DataFrame | None:
    """Raw hits of all vector modes in the case and, if wanted, the reference collection."""
    points = _whole(points)
    good = vectors.join(files.where("error is null").select("file_id"), "file_id", "left_semi")
    floors = {"altered": altered, "semantic": semantic}
    raw = None
    for reference in (False, True)[: 2 if include_reference else 1]:
        for mode in ("altered", "semantic"):
            if mode in modes:
                one = vector_hits(good, points, mode, floors[mode], limit, reference)
                raw = one if raw is None else raw.unionByName(one)
    return raw


def run(files: DataFrame, vectors: DataFrame, points: DataFrame, modes: tuple[str, ...] = ("exact", "altered", "semantic"),
        altered: float = search.ALTERED_FLOOR, semantic: float = search.SEMANTIC_FLOOR, limit: int = 10, unify: bool = True, include_reference: bool = False) -> DataFrame:
    """Ranked hits per file.

    ``files(file_id, is_video, error, file_hash)``; files with an error have no
    hits.  ``vectors(q_id, file_id, mode, query_timecode_ms, vec)``: one row per
    image or query frame and mode.  Unified: one row per path or video with the
    best score of each mode and the model that gave it, exact hits first, limited for images only.  Not
    unified: one row per mode, unlimited after the search's own top-k.
    """
    return _ranked(files, points, _raw_hits(files, vectors, points, modes, altered, semantic, limit, include_reference), modes, limit, unify)


def _ranked(files: DataFrame, points: DataFrame, raw: DataFrame | None, modes: tuple[str, ...], limit: int, unify: bool) -> DataFrame:
    """Grouped, merged and ranked hits of the raw ones and the exact ones."""
    stage = F.when(F.col("is_reference"), 2).otherwise(1)
    keys = ["file_id", "query_timecode_ms", "is_reference"]
    parts = [exact_hits(files, points).select(*_HIT)] if "exact" in modes else []
    if unify:
        if raw is not None:
            # null timecodes are one group of their own; the joins inside need a value
            filled = raw.withColumn("query_timecode_ms", F.coalesce("query_timecode_ms", F.lit(-1).cast("bigint")))
            found = _ordered(_grouped(_merged_by_path(filled), keys), stage)
            parts.append(found.withColumn("query_timecode_ms", F.nullif("query_timecode_ms", F.lit(-1).cast("bigint"))).select(*_HIT))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        rows = rows.withColumn("base", F.coalesce("video_path", "path")).withColumn("hit_key", merge.unify_key("base")).drop("base")
        merged = merge.merge_hits(rows, ["file_id", "hit_key"])
        ranked = merge.rank_unified(merged, ["file_id"])
        return ranked.join(files.select("file_id", "is_video"), "file_id").where(F.col("is_video") | (F.col("rnk") <= limit)).drop("is_video")
    if raw is not None:
        flat = raw.withColumn("query_timecode_ms", F.coalesce("query_timecode_ms", F.lit(-1).cast("bigint"))).withColumns(
            {"scores": F.create_map("mode", "score"), "ord": F.col("rnk").cast("bigint")})
        for mode in ("altered", "semantic"):
            if mode in modes:
                found = _ordered(_grouped(flat.where(F.col("mode") == mode), keys), stage)
                parts.append(found.withColumn("query_timecode_ms", F.nullif("query_timecode_ms", F.lit(-1).cast("bigint"))).select(*_HIT))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.withColumns({"mode": F.map_keys("scores")[0], "score": F.map_values("scores")[0]})
    return merge.rank_unmerged(rows, ["file_id"])


def matched_frames(files: DataFrame, vectors: DataFrame, points: DataFrame, modes: tuple[str, ...] = ("exact", "altered", "semantic"),
                   altered: float = search.ALTERED_FLOOR, semantic: float = search.SEMANTIC_FLOOR, limit: int = 10, unify: bool = True, include_reference: bool = False) -> DataFrame:
    """The frames of the video hits that ``run`` gives for the same arguments, one row each.

    Unified: ``(file_id, hit_key, timecode_ms, frame_hash, scores)``, merged over
    query frames and modes.  Not unified: ``(file_id, query_timecode_ms, mode,
    is_reference, video_path, timecode_ms, frame_hash, score)``, one row per hit.
    """
    raw = _raw_hits(files, vectors, points, modes, altered, semantic, limit, include_reference)
    if raw is not None and unify:
        # both the frames and the hits that they belong to come from one search
        raw = Scratch(points.sparkSession).write(raw, "raw")
    parts = []
    if "exact" in modes:
        f, _, frames = _exact_sides(files, points)
        exact = search.exact_matched_frames(f.where("is_video").select("query_id", F.col("file_hash").alias("video_hash")), frames)
        parts.append(exact.select(F.col("query_id").alias("file_id"), F.lit(None).cast("bigint").alias("query_timecode_ms"), F.lit(False).alias("is_reference"), "video_path", "timecode_ms",
                                  "frame_hash", F.create_map(F.lit("exact"), F.lit(1.0)).alias("scores"), F.lit(0).cast("bigint").alias("stage"), F.lit(0).cast("bigint").alias("ord")))
    if raw is not None:
        # null timecodes are one group of their own, as in the search
        filled = raw.withColumn("query_timecode_ms", F.coalesce("query_timecode_ms", F.lit(-1).cast("bigint")))
        found = _merged_by_path(filled) if unify else filled.withColumns({"scores": F.create_map("mode", "score"), "ord": F.col("rnk").cast("bigint")})
        parts.append(found.where(_is_frame()).select(
            "file_id", F.nullif("query_timecode_ms", F.lit(-1).cast("bigint")).alias("query_timecode_ms"), "is_reference", "video_path", F.coalesce("frame_timecode_ms", F.lit(0).cast("bigint")).alias("timecode_ms"),
            F.col("image_hash").alias("frame_hash"), "scores", F.when(F.col("is_reference"), 2).otherwise(1).cast("bigint").alias("stage"), F.col("ord").cast("bigint").alias("ord")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if not unify:
        return rows.select("file_id", "query_timecode_ms", F.map_keys("scores")[0].alias("mode"), "is_reference", "video_path", "timecode_ms",
                           F.coalesce("frame_hash", F.lit("")).alias("frame_hash"), F.map_values("scores")[0].alias("score"))
    rows = rows.withColumn("hit_key", merge.unify_key("video_path")).withColumn("ord", F.struct("stage", "query_timecode_ms", "ord"))
    shown = _ranked(files, points, raw, modes, limit, True).select("file_id", "hit_key")
    return merge.merge_frames(rows, ["file_id", "hit_key"]).join(shown, ["file_id", "hit_key"], "left_semi")
