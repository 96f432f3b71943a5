"""Grouping, merging and ranking of hits.

Hits arrive with an explicit order ``ord``; "first" always means smallest
``ord``, never the order in which a cluster happens to deliver rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.functions.media import best_score

# fixed values: order of the modes in unmerged lists
MODE_RANK = {"exact": 0, "altered": 1, "semantic": 2}


# what a hit carries of the found file besides its path, where its rows have it
CARRIED = ("exif", "exif_geo_data", "is_video_frame", "video_hash")


def _mode_maxima(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Greatest number per mode of each key's score maps, as a map again.

    Where the rows have a ``provenance`` map (mode -> model), the model of a mode
    is that of the first row with the greatest score.
    """
    carried = [c for c in ("ord", "provenance") if c in rows.columns] if "provenance" in rows.columns else []
    flat = rows.select(*keys, *carried, F.explode_outer("scores").alias("mode", "score")).where("score is not null and not isnan(score)")
    found = [F.max("score").alias("score")]
    if carried:
        model = F.element_at("provenance", F.col("mode"))
        found.append(F.max_by(model, F.when(model.isNotNull(), F.struct(F.round("score", 9), -F.col("ord")))).alias("model"))
    per = flat.groupBy(*keys, "mode").agg(*found)
    maps = [F.map_from_entries(F.sort_array(F.collect_list(F.struct("mode", "score")))).alias("scores")]
    if carried:
        known = F.when(F.col("model").isNotNull(), F.struct("mode", "model"))
        maps.append(F.map_from_entries(F.sort_array(F.collect_list(known))).alias("provenance"))
    return per.groupBy(*keys).agg(*maps)


def group_video_hits(hits: DataFrame, keys: list[str]) -> DataFrame:
    """One row per video and ``keys`` (the query entity) from its frame hits.

    Input: ``keys, video_path, path, image_hash, frame_timecode_ms, scores,
    is_reference, ord``, optionally ``provenance`` and what ``CARRIED`` names.
    The frame with the greatest score represents the video (the first on ties);
    scores are maxima per mode; ``frames`` counts the matched frames, which
    ``frames_of`` lists; the reference flag holds if any has it.
    """
    by = [*keys, "video_path"]
    kept = [c for c in CARRIED if c in hits.columns]
    ranked = hits.withColumn("best", F.round(best_score("scores"), 9))
    flag = [] if "is_reference" in keys else [F.bool_or(F.coalesce("is_reference", F.lit(False))).alias("is_reference")]
    groups = ranked.groupBy(*by).agg(
        F.max_by(F.struct("path", "image_hash", "frame_timecode_ms", *kept), F.struct("best", -F.col("ord"))).alias("top"),
        F.count("*").alias("frames"), *flag, F.min("ord").alias("ord"),
    )
    models = ["provenance"] if "provenance" in hits.columns else []
    return groups.join(_mode_maxima(hits, by), by, "left").select(
        *dict.fromkeys([*by, "top.path", "top.image_hash", "top.frame_timecode_ms", *[f"top.{c}" for c in kept], "frames", "is_reference", "ord", "scores", *models]))


def frames_of(hits: DataFrame, keys: list[str]) -> DataFrame:
    """The frame hits behind ``group_video_hits`` as rows: ``(keys, video_path, timecode_ms, frame_hash, scores, ord)``.

    A missing timecode counts as 0.  Rows, not a list: a video may hold any share of all frames.
    """
    return hits.select(
        *keys, "video_path", F.coalesce("frame_timecode_ms", F.lit(0).cast("bigint")).alias("timecode_ms"), F.coalesce("image_hash", F.lit("")).alias("frame_hash"), "scores", "ord")


def merge_hits(hits: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key from hits of several modes and query frames.

    Input: ``keys, path, image_hash, query_timecode_ms, scores, is_reference,
    ord``, optionally ``provenance``, ``video_path``, ``frame_timecode_ms`` and
    what ``CARRIED`` names.  Scores are maxima per mode, each with the model of
    its row; path and what is carried come from the first hit, the hash
    from the first that has one; query timecodes are distinct, in order of
    arrival; the best one belongs to the hit that first reached the greatest score.
    """
    rows = hits.withColumn("best", F.round(best_score("scores"), 9))
    timed = F.when(F.col("query_timecode_ms").isNotNull(), F.struct("ord", "query_timecode_ms"))
    kept = [c for c in (*CARRIED, "video_path", "frame_timecode_ms") if c in hits.columns and c not in keys]
    merged = rows.groupBy(*keys).agg(
        F.min_by(F.struct("path", *kept), "ord").alias("_first"),
        F.min_by("image_hash", F.when(F.coalesce("image_hash", F.lit("")) != "", F.col("ord"))).alias("image_hash"),
        F.array_distinct(F.transform(F.sort_array(F.collect_list(timed)), lambda x: x["query_timecode_ms"])).alias("query_timecodes"),
        F.max_by("query_timecode_ms", F.when(F.col("query_timecode_ms").isNotNull(), F.struct("best", -F.col("ord")))).alias("best_query_timecode_ms"),
        F.bool_or(F.coalesce("is_reference", F.lit(False))).alias("is_reference"), F.min("ord").alias("ord"),
    )
    merged = merged.select(*keys, "_first.*", *[c for c in merged.columns if c not in (*keys, "_first")])
    return merged.join(_mode_maxima(hits, keys), keys, "left")


def merge_frames(frames: DataFrame, keys: list[str]) -> DataFrame:
    """The matched frames of merged hits, one row per key and timecode.

    Input: ``keys, timecode_ms, frame_hash, scores, ord``.  Scores are maxima per
    mode; the hash comes from the first arrival; a missing timecode counts as 0.
    Frames stay rows: one video may have any number of them.
    """
    by = [*keys, "timecode_ms"]
    rows = frames.withColumn("timecode_ms", F.coalesce("timecode_ms", F.lit(0).cast("bigint")))
    first = rows.groupBy(*by).agg(F.min_by(F.coalesce("frame_hash", F.lit("")), "ord").alias("frame_hash"))
    return first.join(_mode_maxima(rows, by), by, "left")


def unify_key(base: str) -> Column:
    """Case and reference hits of one path or video (column ``base``) stay apart."""
    side = F.when(F.coalesce("is_reference", F.lit(False)), "ref").otherwise("case")
    return F.concat(side, F.lit(":"), F.col(base))


def _best_other(scores: Column) -> Column:
    return best_score(F.map_filter(scores, lambda m, _: m != "exact"))


def rank_unified(hits: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Exact hits first, then the best other score down, then path: adds ``rnk``."""
    order = Window.partitionBy(*keys).orderBy(
        F.when(F.map_contains_key("scores", F.lit("exact")), 0).otherwise(1), F.desc(_best_other(F.col("scores"))), "path", "is_reference")
    ranked = hits.withColumn("rnk", F.row_number().over(order))
    return ranked if limit is None else ranked.where(F.col("rnk") <= limit)


def rank_unmerged(hits: DataFrame, keys: list[str]) -> DataFrame:
    """One row per mode: modes in their fixed order, score down, path; adds ``rnk``."""
    rank = F.lit(99)
    for mode, at in MODE_RANK.items():
        rank = F.when(F.col("mode") == mode, at).otherwise(rank)
    order = Window.partitionBy(*keys).orderBy(rank, F.desc("score"), "path", "ord")
    return hits.withColumn("rnk", F.row_number().over(order))
