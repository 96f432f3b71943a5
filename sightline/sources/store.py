"""Versioned tables: every write makes a new directory, then moves a pointer."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.functions.media import move_prefix
from sightline.session import get_json, put_json


class Table:
    """A parquet table with versions below ``root`` and a ``current`` pointer."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _get(self, name: str) -> dict | None:
        return get_json(self.spark, f"{self.root}/{name}")

    def _put(self, name: str, value: dict) -> None:
        put_json(self.spark, f"{self.root}/{name}", value)

    def exists(self) -> bool:
        return self._get("current.json") is not None

    def read(self) -> DataFrame:
        now = self._get("current.json")
        if now is None:
            raise FileNotFoundError(self.root)
        return self.spark.read.parquet(f"{self.root}/{now['version']}")

    def write(self, df: DataFrame, partition_by: list[str] | None = None) -> str:
        """A new version; a vector of another size than declared ends the write, before the pointer moves."""
        df = with_checked_sizes(df, self.vectors())
        version = f"v-{datetime.now(UTC):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
        out = df.write.mode("errorifexists")
        (out.partitionBy(*partition_by) if partition_by else out).parquet(f"{self.root}/{version}")
        self._put("current.json", {"version": version})
        return version

    def snapshot(self, name: str) -> str:
        """Name the current version; versions are never changed, so nothing is copied."""
        now = self._get("current.json")
        if now is None:
            raise FileNotFoundError(self.root)
        self._put(f"snapshot-{name}.json", now)
        return now["version"]

    def restore(self, name: str) -> None:
        kept = self._get(f"snapshot-{name}.json")
        if kept is None:
            raise FileNotFoundError(f"{self.root}: no snapshot {name}")
        self._put("current.json", kept)

    def vectors(self) -> dict[str, int]:
        """Declared vectors and their sizes; a table that declares one unnamed vector is of an older layout and refused."""
        have = self._get("vectors.json")
        if have is not None and (not isinstance(have, dict) or "size" in have):
            raise ValueError(f"{self.root} has the older layout of one unnamed vector; remove it and index again")
        return have or {}

    def configure(self, vectors: dict[str, int]) -> None:
        """Declare vectors and sizes; known ones must agree, new ones are added."""
        have = self.vectors()
        for name, dim in vectors.items():
            if have.get(name, dim) != dim:
                raise ValueError(f"vector {name} has {have[name]} values, not {dim}")
        self._put("vectors.json", have | vectors)

    def modes(self) -> set[str]:
        """Search modes that the table allows: exact if it exists, the vector modes if configured."""
        vectors = self.vectors()
        found = {"exact"} if self.exists() or vectors else set()
        return found | {m for m, v in (("altered", "sscd"), ("semantic", "dino")) if v in vectors}


def with_checked_sizes(df: DataFrame, vectors: dict[str, int]) -> DataFrame:
    """The same rows; reading one whose vector has another size than declared is an error."""
    checked = {}
    for name, dim in vectors.items():
        if name in df.columns:
            wrong = F.raise_error(F.concat(F.lit(f"vector {name} has "), F.size(name).cast("string"), F.lit(f" values, not {dim}")))
            checked[name] = F.when(F.col(name).isNull() | (F.size(name) == dim), F.col(name)).otherwise(wrong.cast(df.schema[name].dataType))
    return df.withColumns(checked) if checked else df


def merged_videos(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Video records by key: the last writer wins, new rows over old ones, later ``order`` over earlier."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (key, "_new")]
    # a maximum per key is a partial aggregate: no key is gathered; the values end ties
    place = F.struct("_new", order, *[F.col(c) for c in rest if c != order])
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), place).alias("_v")).select(key, "_v.*")


def merged_points(old: DataFrame, new: DataFrame, key: str, core: list[str], refreshed: list[str]) -> DataFrame:
    """Insert or update by key: known points keep their core columns, take new values of ``refreshed``.

    A key repeated inside ``new`` counts once, its first row by the core columns.
    Other columns of the old table stay.
    """
    rank = Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_last() for c in core])
    once = new.withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r")
    n = once.select(key, *[F.col(c).alias(f"_n_{c}") for c in [*core, *refreshed]])
    both = old.join(n, key, "full_outer")
    out = [F.col(key)]
    for c in [*old.columns, *[c for c in [*core, *refreshed] if c not in old.columns]]:
        if c == key:
            continue
        if c in refreshed:
            out.append((F.coalesce(f"_n_{c}", c) if c in old.columns else F.col(f"_n_{c}")).alias(c))
        elif c in core:
            out.append((F.coalesce(c, f"_n_{c}") if c in old.columns else F.col(f"_n_{c}")).alias(c))
        else:
            out.append(F.col(c))
    return both.select(*out)


def marked_complete(frames: DataFrame, done: DataFrame, column: str) -> DataFrame:
    """Set ``column`` to the expected total of the videos in ``done(video_hash, total)``."""
    return frames.join(done.select("video_hash", F.col("total").alias("_t")), "video_hash", "left").withColumn(column, F.coalesce("_t", column)).drop("_t")


def remapped(points: DataFrame, columns: list[str], old: str, new: str) -> DataFrame:
    """Move a leading path of the given columns; adds ``moved``."""
    moved = F.lit(False)
    for c in columns:
        moved = moved | F.coalesce(F.col(c).startswith(old), F.lit(False))
    return points.withColumn("moved", moved).withColumns({c: move_prefix(c, old, new) for c in columns})


def path_counts(points: DataFrame, path: str, collection: str) -> DataFrame:
    """Rows per path and collection with a total per path (null collection)."""
    return points.rollup(path, collection).agg(F.count("*").alias("n"), F.grouping_id().alias("g")).where("g < 3").drop("g")


def upserted_tags(old: DataFrame, new: DataFrame, now) -> DataFrame:
    """Create or replace tags; a replaced tag keeps when it was created."""
    made = old.select("tag_id", F.col("created_at").alias("_c"))
    fresh = new.join(made, "tag_id", "left").withColumns({"created_at": F.coalesce("_c", now), "updated_at": now}).drop("_c")
    return old.join(new.select("tag_id"), "tag_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def marked(tags: DataFrame, tag_id, point_id, role: str) -> DataFrame:
    """Put an example into one list of a tag and out of the other; once marked it stays single."""
    if role not in ("positive", "negative"):
        raise ValueError(f"unknown role {role!r}")
    here, there = (("positive_ids", "negative_ids"), ("negative_ids", "positive_ids"))[role == "negative"]
    hit = F.col("tag_id") == F.lit(tag_id)
    added = F.when(F.array_contains(here, F.lit(point_id)), F.col(here)).otherwise(F.array_append(here, F.lit(point_id)))
    return tags.withColumns({here: F.when(hit, added).otherwise(F.col(here)),
                             there: F.when(hit, F.array_remove(there, F.lit(point_id))).otherwise(F.col(there))})


def unmarked(tags: DataFrame, tag_id, point_id) -> DataFrame:
    hit = F.col("tag_id") == F.lit(tag_id)
    return tags.withColumns({c: F.when(hit, F.array_remove(c, F.lit(point_id))).otherwise(F.col(c)) for c in ("positive_ids", "negative_ids")})


def retargeted(tags: DataFrame, tag_id, target_id, now: Column) -> DataFrame:
    """Set a tag's target, or clear it with None."""
    hit = F.col("tag_id") == F.lit(tag_id)
    out = tags.withColumn("target_id", F.when(hit, F.lit(target_id).cast(tags.schema["target_id"].dataType)).otherwise(F.col("target_id")))
    return out.withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at"))) if "updated_at" in tags.columns else out


def deleted_tags(tags: DataFrame, tag_ids: DataFrame) -> DataFrame:
    """Tags without the given ones; unknown ids change nothing."""
    return tags.join(tag_ids.select("tag_id").distinct(), "tag_id", "left_anti")


def tags_of_concepts(concepts: DataFrame) -> DataFrame:
    """Tags from the older concept rows: their id becomes the tag's, the polarity is dropped."""
    return concepts.where("is_concept").select(F.col("concept_id").alias("tag_id"), *[c for c in concepts.columns if c not in ("is_concept", "concept_id", "polarity")])


def remap_preview(points: DataFrame, columns: list[str], old: str, new: str, most: int = 10) -> DataFrame:
    """At most ``most`` of the rows that ``remapped`` would move, in no order: reading stops when they are found."""
    return remapped(points, columns, old, new).where("moved").limit(most)


def thumbnail_candidates(points: DataFrame, image_hash: str, most: int = 4) -> DataFrame:
    """At most ``most`` files that hold a picture's content, to make its thumbnail from."""
    return points.where(F.col("image_hash") == image_hash).select("path", "is_video_frame", "video_path", "frame_timecode_ms").limit(most)


def export_plan(tags: DataFrame, points: DataFrame, point_id: str, path: str) -> DataFrame:
    """``(tag, role, point, source, name)``: files to copy, with names free of collisions.

    Further files of one name in a folder get eight digits of their path's digest.
    """
    ids = tags.select("name", F.explode(F.array(
        F.struct(F.lit("positive").alias("role"), F.col("positive_ids").alias("ids")),
        F.struct(F.lit("negative").alias("role"), F.col("negative_ids").alias("ids")))).alias("l"))
    listed = ids.select(F.regexp_replace("name", r"[^\w.\-]+", "_").alias("tag"), F.col("l.role").alias("role"), F.posexplode("l.ids").alias("ord", "point"))
    met = listed.join(points.select(F.col(point_id).alias("point"), F.col(path).alias("source")), "point").withColumn("base", F.regexp_extract("source", r"([^/]*)$", 1))
    order = Window.partitionBy("tag", "role", "base").orderBy("ord", "point")
    stem, ext = F.regexp_replace("base", r"\.[^.]*$", ""), F.regexp_extract("base", r"(\.[^.]*)$", 1)
    unique = F.concat(stem, F.lit("_"), F.substring(F.sha2("source", 256), 1, 8), ext)
    return met.withColumn("_r", F.row_number().over(order)).select("tag", "role", "point", "source", F.when(F.col("_r") == 1, F.col("base")).otherwise(unique).alias("name"))
