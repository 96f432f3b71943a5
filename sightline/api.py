"""Functions for callers: each takes tables and returns a DataFrame."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.operators import search, session_search, stats, triage
from sightline.session import Scratch
from sightline.sources import store
from sightline.sources.store import Table

MAX_HASHES = 256  # fixed value: digests of one classification request
_DIGEST = re.compile(r"[0-9a-f]{64}")


def checked_hashes(hashes: list[str]) -> list[str]:
    """Distinct digests in the given order; too many or malformed ones are an error."""
    if len(hashes) > MAX_HASHES:
        raise ValueError(f"at most {MAX_HASHES} digests")
    for h in hashes:
        if not _DIGEST.fullmatch(h):
            raise ValueError(f"not a sha256 digest: {h!r}")
    return list(dict.fromkeys(hashes))


@dataclass
class Collections:
    """A case table of points, optionally a reference table, and the tags."""

    case: DataFrame
    tags: DataFrame
    reference: DataFrame | None = None

    @property
    def points(self) -> DataFrame:
        """Both collections, marked; an id of both has two rows, of which lookups take the case's."""
        case = self.case.withColumn("is_reference", F.lit(False))
        if self.reference is None:
            return case
        return case.unionByName(self.reference.withColumn("is_reference", F.lit(True)), allowMissingColumns=True)

    def search(self, files: DataFrame, vectors: DataFrame, **options) -> DataFrame:
        if not 1 <= options.get("limit", 10) <= 50:
            raise ValueError("limit must be between 1 and 50")
        return session_search.run(files, vectors, self.points, **options)

    def semantic_stats(self, vectors: DataFrame, sample: int = 10_000) -> DataFrame:
        mine = vectors.where("mode = 'semantic'")
        return stats.distribution(search.scores(mine, self.case, "q_id", "vec", "point_id", "dino"), ["query_id"], "score", sample)

    def point(self, point_ids: DataFrame) -> DataFrame:
        """Payloads by id, from the case, else from the reference."""
        first = F.struct("is_reference")
        known = self.points.join(point_ids.select("point_id").distinct(), "point_id", "left_semi")
        return known.groupBy("point_id").agg(F.min_by(F.struct(*[c for c in known.columns if c not in ("point_id", "dino", "sscd")]), first).alias("p")).select("point_id", "p.*")

    def point_ids(self, hashes: list[str]) -> DataFrame:
        """First point of each digest, case before reference."""
        wanted = self.points.where(F.col("image_hash").isin(checked_hashes(hashes)))
        return wanted.groupBy("image_hash").agg(F.min_by("point_id", F.struct("is_reference", "point_id")).alias("point_id"))

    def provenance(self, image_hash: str, vectors: tuple[str, ...] = ("dino", "sscd")) -> DataFrame:
        """``(point_id, provenance)`` of one digest's first point: vector -> what is stored of its model; vectors without anything are left out."""
        (digest,) = checked_hashes([image_hash])
        known = self.points
        stored = {v: [c for c in known.columns if c.startswith(f"{v}_")] for v in vectors}
        maps = [x for v, columns in stored.items() if columns for x in (F.lit(v), F.map_filter(
            F.create_map(*[y for c in columns for y in (F.lit(c[len(v) + 1:]), F.col(c).cast("string"))]), lambda _, x: x.isNotNull()))]
        whole = F.create_map(*maps) if maps else F.create_map().cast("map<string,map<string,string>>")
        found = known.where(F.col("image_hash") == digest).orderBy("is_reference", "point_id").limit(1)
        return found.select("point_id", F.map_filter(whole, lambda _, x: F.size(x) > 0).alias("provenance"))

    def timeline(self, video_hash: str) -> DataFrame:
        (digest,) = checked_hashes([video_hash])
        mine = self.case.where((F.col("video_hash") == digest) & F.col("frame_timecode_ms").isNotNull())
        return mine.groupBy("frame_timecode_ms").agg(F.min("image_hash").alias("image_hash")).orderBy("frame_timecode_ms")

    def points3d(self, limit: int = 5000) -> DataFrame:
        return stats.principal_axes(self.case, "point_id", "dino", limit)

    def list_tags(self) -> DataFrame:
        return self.tags.orderBy(F.desc("updated_at"), "tag_id")

    def get_tag(self, tag_id):
        """A tag's row; an unknown one is an error."""
        row = self.tags.where(F.col("tag_id") == F.lit(tag_id)).first()
        if row is None:
            raise KeyError(tag_id)
        return row

    def mark(self, tag_id, point_id, role: str) -> DataFrame:
        self.get_tag(tag_id)
        return store.marked(self.tags, tag_id, point_id, role)

    def unmark(self, tag_id, point_id) -> DataFrame:
        self.get_tag(tag_id)
        return store.unmarked(self.tags, tag_id, point_id)

    def set_target(self, tag_id, target_id) -> DataFrame:
        """Tags with a new target; an empty one clears it."""
        self.get_tag(tag_id)
        return store.retargeted(self.tags, tag_id, None if target_id in (None, "") else target_id, F.current_timestamp())

    def delete_tag(self, tag_id) -> tuple[DataFrame, bool]:
        """Tags without this one, and whether it was there."""
        gone = self.tags.where(F.col("tag_id") == F.lit(tag_id))
        return store.deleted_tags(self.tags, gone), not gone.isEmpty()

    def metadata(self, path: str) -> DataFrame:
        """What is stored of a file, from the case, else from the reference."""
        known = self.points.where(F.col("path") == path)
        return known.select(*[c for c in known.columns if c not in ("dino", "sscd")]).orderBy("is_reference", "point_id").limit(1)

    def frame_metadata(self, video_hash: str, timecode_ms: int) -> DataFrame:
        (digest,) = checked_hashes([video_hash])
        known = self.points.where((F.col("video_hash") == digest) & (F.col("frame_timecode_ms") == timecode_ms))
        return known.select(*[c for c in known.columns if c not in ("dino", "sscd")]).orderBy("is_reference", "point_id").limit(1)

    def _scored(self, candidates: DataFrame, tags: DataFrame, best: int | None = None) -> DataFrame:
        """A labelled example counts once: with the case's vector, else with the reference's."""
        return triage.scored(candidates, tags, self.case, self.reference, "point_id", "dino", best)

    def triage(self, tag_id, limit: int = 50, reverse: bool = False, floor: float = 0.5, exclude: bool = True, where: Column | None = None) -> DataFrame:
        """Candidates for one tag: pairs won if it has both sides, else the best cosine with a floor.

        ``where`` is a filter of the caller's, besides the tag's own examples.
        """
        if not 1 <= limit <= 500:
            raise ValueError("limit must be between 1 and 500")
        tags = self.tags.where(F.col("tag_id") == F.lit(tag_id))
        tags = triage.swapped(tags) if reverse else tags
        row = tags.first()
        if row is None:
            raise KeyError(tag_id)
        looked = self.case if where is None else self.case.where(where)
        kind = triage.check_tag(row["positive_ids"], row["negative_ids"], row["target_id"])
        if kind == "recommend":
            folded = triage.targeted(tags, "positive")
            return triage.recommended(self._scored(looked, folded, limit), folded, limit, floor)
        tags = triage.targeted(tags)
        scored = self._scored(looked, tags, limit)
        return triage.ranked(triage.without_references(scored, tags) if exclude else scored, limit)

    def explore(self, tag_id, limit: int = 50, order: str = "count", seed: int = 0, collection: str = "dataset", where: Column | None = None) -> tuple[DataFrame, str]:
        """Candidates to label next, and how they were chosen (``context`` or ``random``).

        ``collection`` is ``dataset`` or ``reference``; examples that the explored
        collection lacks take no part.  ``where`` is a filter of the caller's.
        """
        if not 1 <= limit <= 200:
            raise ValueError("limit must be between 1 and 200")
        points = triage.chosen_collection(collection, self.case, self.reference)
        labelled = triage.targeted(self.tags.where(F.col("tag_id") == F.lit(tag_id)), "positive")
        tags = triage.examples_in(labelled, points, "point_id")
        row = tags.first()
        looked = points if where is None else points.where(where)
        if row is not None and row["positive_ids"] and row["negative_ids"]:
            scored = triage.scored(looked, tags, points, None, "point_id", "dino")
            return triage.explored(scored, labelled, limit, order), "context"
        return triage.random_sample(looked, triage.reference_ids(labelled).select("ref_id").distinct(), "point_id", limit, seed), "random"

    def classify(self, hashes: list[str], floor: float = 0.5) -> DataFrame:
        """``(image_hash, names)``: tags of each known digest, by tag recency; digests without a match keep an empty list."""
        points = self.point_ids(hashes)
        tags = triage.targeted(self.tags, "positive")
        # each point once, from the collection that its digest was found in first
        side = F.struct("is_reference")
        mine = self.points.join(points.select("point_id"), "point_id", "left_semi").groupBy("point_id").agg(F.min_by("dino", side).alias("dino"))
        hit = triage.classified(self._scored(mine, tags), tags, floor).join(tags.select("tag_id", "name", "updated_at"), "tag_id")
        names = hit.groupBy(F.col("cand").alias("point_id")).agg(F.transform(
            F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("updated_at").cast("timestamp"))).alias("t"), "tag_id", "name"))), lambda x: x["name"]).alias("names"))
        return points.join(names, "point_id", "left").select("image_hash", F.coalesce("names", F.array().cast("array<string>")).alias("names"))

    def classify_entries(self, entries: DataFrame, floor: float = 0.5) -> DataFrame:
        """``(cand, tag_id, ..)`` for uploaded images (``point_id, dino``); a tag's target does not count."""
        tags = triage.targeted(self.tags, "ignore")
        return triage.classified(self._scored(entries, tags), tags, floor)

    def skipped_tags(self) -> DataFrame:
        """``(tag_id, name)`` of the tags that classification passes over: negatives are declared, none resolves."""
        ids = triage.reference_ids(self.tags).where("side = 'n'")
        known = triage.example_vectors(ids, self.case, self.reference, "point_id", "dino")
        safe = ids.join(known, "ref_id", "left_semi").select("tag_id").distinct()
        return self.tags.where(F.size("negative_ids") > 0).join(safe, "tag_id", "left_anti").select("tag_id", "name")

    def triage_entries(self, entries: DataFrame, tag_id, limit: int = 50, floor: float = 0.5) -> DataFrame:
        """Uploaded images ranked for one tag, its target as a positive; the bar cuts after the limit."""
        tags = triage.targeted(self.tags.where(F.col("tag_id") == F.lit(tag_id)), "positive")
        top = triage.ranked(self._scored(entries, tags, limit).withColumn("aim", F.lit(None).cast("double")), limit)
        return top.where(triage.passes(F.col("triplet"), F.col("raw"), F.col("pairs"), floor))


def query_frames(vectors: DataFrame, file_id) -> DataFrame:
    """Frames of an uploaded video in order of time: ``(query_timecode_ms)``."""
    return vectors.where((F.col("file_id") == F.lit(file_id)) & F.col("query_timecode_ms").isNotNull()).select("query_timecode_ms").distinct().orderBy("query_timecode_ms")


class ExampleCache:
    """Resolved example vectors of tags, kept between queries.

    The key holds when the tag changed, the vector and the collections, so a
    changed tag is read anew.  At most ``most`` entries; the oldest goes first.
    """

    def __init__(self, spark, most: int = 256):
        self.scratch, self.most, self._kept = Scratch(spark), most, {}

    def __len__(self) -> int:
        return len(self._kept)

    def examples(self, collections: Collections, tag_id, vector: str = "dino", names: tuple[str, ...] = ()) -> DataFrame:
        """``(ref_id, v)`` of a tag's examples and target; ``names`` tell the collections apart."""
        row = collections.get_tag(tag_id)
        key = (tag_id, row["updated_at"], vector, names)
        if key not in self._kept:
            tags = collections.tags.where(F.col("tag_id") == F.lit(tag_id))
            ids = triage.reference_ids(tags).select("ref_id").union(tags.where("target_id is not null").select("target_id"))
            while len(self._kept) >= self.most:
                self.scratch.drop(self._kept.pop(next(iter(self._kept))))
            self._kept[key] = self.scratch.write(triage.example_vectors(ids, collections.case, collections.reference, "point_id", vector), "examples")
        return self._kept[key]


# fixed values: waits in seconds between the attempts to reach the tables
WAITS = (1, 2, 4)


def probed_modes(case: Table, reference: Table | None = None, waits: tuple[float, ...] = WAITS, sleep: Callable[[float], None] = time.sleep) -> tuple[set[str], bool, str | None]:
    """``available_modes`` and an error: tables that cannot be read are tried again after each wait."""
    for wait in (*waits, None):
        try:
            return *available_modes(case, reference), None
        except Exception as problem:  # any failure of the storage
            if wait is None:
                return set(), False, f"{type(problem).__name__}: {problem}"
            sleep(wait)
    raise AssertionError


def available_modes(case: Table, reference: Table | None = None) -> tuple[set[str], bool]:
    """Search modes that the stored collections allow, and whether there is a reference."""
    return case.modes(), reference is not None and reference.exists()
