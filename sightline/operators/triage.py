"""Labelled examples: context pairs, triplet scores, recommendation, classification."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.operators.search import cosines, unit_rows
from sightline.session import Scratch

MAX_PAIRS = 64  # fixed value: context pairs of one tag
# example vectors that go to the executors at once, about, and positives of a tag in one of its chunks
EXAMPLES, CHUNK = 4096, 1024


def context_pairs(tags: DataFrame) -> DataFrame:
    """``(tag_id, ord, p, n)``: positive and negative positions, diagonal first, at most ``MAX_PAIRS``.

    Tags without positives or without negatives have no pairs.  Only the pairs
    that can be among the first ``MAX_PAIRS`` are made.
    """
    order = Window.partitionBy("tag_id").orderBy(F.col("p") != F.col("n"), "p", "n")
    # row-major order never needs more than the first MAX_PAIRS positions of a list
    pos = tags.select("tag_id", F.posexplode(F.slice("positive_ids", 1, MAX_PAIRS)).alias("p", "pid"))
    neg = tags.select("tag_id", F.posexplode(F.slice("negative_ids", 1, MAX_PAIRS)).alias("n", "nid"))
    pairs = pos.join(neg, "tag_id")
    return pairs.withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= MAX_PAIRS).select("tag_id", "ord", "p", "n", "pid", "nid")


def swapped(tags: DataFrame) -> DataFrame:
    """Reverse polarity: positives and negatives change places, an explicit target stays."""
    return tags.withColumns({"positive_ids": F.col("negative_ids"), "negative_ids": F.col("positive_ids")})


def targeted(tags: DataFrame, policy: str = "anchor") -> DataFrame:
    """What an explicit target means: ``anchor`` (default: the first positive), ``positive`` or ``ignore``."""
    if policy == "anchor":
        return tags.withColumn("target_id", F.coalesce("target_id", F.element_at(F.concat("positive_ids", F.array(F.lit(None).cast("bigint"))), 1)))
    if policy == "positive":
        folded = F.array_distinct(F.concat("positive_ids", F.array("target_id")))
        return tags.withColumn("positive_ids", F.when(F.col("target_id").isNotNull(), folded).otherwise(F.col("positive_ids")))
    if policy == "ignore":
        return tags.withColumn("target_id", F.lit(None).cast("bigint"))
    raise ValueError(f"unknown target policy {policy!r}")


def reference_ids(tags: DataFrame) -> DataFrame:
    """``(tag_id, ref_id, side, pos)``: labelled examples in tag order."""
    pos = tags.select("tag_id", F.posexplode("positive_ids").alias("pos", "ref_id"), F.lit("p").alias("side"))
    neg = tags.select("tag_id", F.posexplode("negative_ids").alias("pos", "ref_id"), F.lit("n").alias("side"))
    return pos.unionByName(neg)


def example_vectors(ids: DataFrame, case: DataFrame, reference: DataFrame | None, point_id: str, vector: str) -> DataFrame:
    """``(ref_id, v)`` for ``ids(ref_id)``: each once, from the case collection, else from the reference one."""
    wanted = ids.select("ref_id").distinct()
    pick = lambda df: df.select(F.col(point_id).alias("ref_id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null").join(wanted, "ref_id", "left_semi")
    found = pick(case).withColumn("_side", F.lit(0))
    if reference is not None:
        found = found.union(pick(reference).withColumn("_side", F.lit(1)))
    return found.groupBy("ref_id").agg(F.min_by("v", "_side").alias("v"))


def _kept_lists(tags: DataFrame, examples: DataFrame) -> DataFrame:
    """Tags with the examples that resolve, in tag order, and those with whether their target does."""
    kept = reference_ids(tags).join(examples.select("ref_id"), "ref_id", "left_semi")
    ordered = lambda side: F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("pos", "ref_id")))), lambda x: x["ref_id"])
    lists = kept.groupBy("tag_id").agg(ordered("p").alias("positive_ids"), ordered("n").alias("negative_ids"))
    aims = tags.where("target_id is not null").select("tag_id", F.col("target_id").alias("ref_id")).join(examples.select("ref_id"), "ref_id", "left_semi")
    return lists.join(aims.withColumnRenamed("ref_id", "target_id"), "tag_id", "full_outer")


def _scored_batches(dim: int, vectors: bytes, plan: list[tuple], best: int | None) -> Callable:
    """``(tag, cand, triplet, raw, pairs, aim)`` of Arrow batches of candidates.

    One product of a batch with all of a block's examples; a tag's columns are
    picked from it.  ``plan``: ``(tag, positives, pair positives, pair negatives,
    aim, own)`` by position in the block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        q = np.frombuffer(vectors, "<f8").reshape(-1, dim)
        for batch in batches:
            at, v = unit_rows(batch.column(1), dim)
            if not len(at):
                continue
            s = np.round(cosines(v, q), 9)
            for tag, positives, left, right, aim, own in plan:
                raw = s[:, positives].max(1) if len(positives) else np.full(len(s), -np.inf)
                won = (s[:, left] > s[:, right]).sum(1) if len(left) else np.zeros(len(s), np.int64)
                keep = np.isfinite(raw) if len(positives) else np.zeros(len(s), bool)
                near = s[:, aim] if aim is not None else np.zeros(len(s))
                if best is not None and len(s) > best + own:
                    # only the batch's best can be among the best of all; its own examples may be taken out later
                    least = np.lexsort((-raw, -near, -won))[best + own - 1]
                    keep &= (won > won[least]) | ((won == won[least]) & (near > near[least])) | ((won == won[least]) & (near == near[least]) & (raw >= raw[least]))
                i = np.flatnonzero(keep)
                if len(i):
                    n = len(i)
                    counted = [pa.array(won[i]) if len(left) else pa.nulls(n, pa.int64()), pa.array(raw[i]), pa.array(np.full(n, len(left))) if len(left) else pa.nulls(n, pa.int64())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, tag)), batch.column(0).take(pa.array(at[i])), *counted, pa.array(near[i]) if aim is not None else pa.nulls(n, pa.float64())],
                        names=["tag", "cand", "triplet", "raw", "pairs", "aim"])

    return run


def scored(candidates: DataFrame, tags: DataFrame, case: DataFrame, reference: DataFrame | None, point_id: str, vector: str, best: int | None = None) -> DataFrame:
    """``(tag_id, cand, triplet, raw, pairs, aim)``: every candidate against every tag.

    ``raw``: greatest cosine to a positive.  ``triplet``: of the tag's ``pairs``
    those in which the positive is strictly closer; null without pairs.  ``aim``:
    cosine to the tag's target, null without one.  Examples come from the case
    collection, else from the reference one, each once; those that resolve to no
    vector take no part.  With ``best`` only rows that can be among a tag's best
    are kept.

    Candidates stream past blocks of at most ``EXAMPLES`` example vectors; no
    pair of a candidate and an example leaves the task.  A tag of more examples
    is spread over blocks and put together again.
    """
    spark, scratch = candidates.sparkSession, Scratch(candidates.sparkSession)
    ids = reference_ids(tags).select("ref_id").union(tags.where("target_id is not null").select("target_id"))
    examples = scratch.write(example_vectors(ids, case, reference, point_id, vector), "examples")
    lists = _kept_lists(tags, examples)
    pairs = context_pairs(lists).groupBy("tag_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "pid", "nid"))), lambda x: F.struct(x["pid"].alias("p"), x["nid"].alias("n"))).alias("pairs"))
    own = tags.select("tag_id", (F.coalesce(F.size("positive_ids"), F.lit(0)) + F.coalesce(F.size("negative_ids"), F.lit(0)) + 1).alias("own"))
    # one row per tag and chunk of positives; a chunk and the pairs' examples fit a block
    chunks = F.greatest(F.lit(1), F.ceil(F.size(F.coalesce("positive_ids", F.array().cast("array<bigint>"))) / CHUNK)).cast("int")
    planned = scratch.write(
        lists.join(pairs, "tag_id", "left").join(own, "tag_id").withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .select("tag_id", "chunk", chunks.alias("chunks"), F.slice("positive_ids", F.col("chunk") * CHUNK + 1, F.lit(CHUNK)).alias("positives"),
                F.when(F.col("chunk") == 0, F.col("pairs")).alias("pairs"), F.when(F.col("chunk") == 0, F.col("target_id")).alias("aim"), "own")
        .withColumn("examples", F.array_distinct(F.array_compact(F.concat(
            F.coalesce("positives", F.array().cast("array<bigint>")), F.coalesce(F.transform("pairs", lambda x: x["p"]), F.array().cast("array<bigint>")),
            F.coalesce(F.transform("pairs", lambda x: x["n"]), F.array().cast("array<bigint>")), F.array("aim"))))), "planned")
    side = candidates.select(F.col(point_id).cast("bigint").alias("cand"), F.col(vector).cast("array<double>").alias("v"))
    found, kind = [], tags.schema["tag_id"].dataType.simpleString()
    rows = planned.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("examples")), F.lit(0)).alias("all"), F.max("chunks").alias("chunks")).first()
    blocks, whole = max(1, -(-rows["all"] // EXAMPLES)), (rows["chunks"] or 1) == 1
    for b in range(blocks if rows["n"] else 0):
        mine = planned.where(F.pmod(F.xxhash64("tag_id", "chunk"), F.lit(blocks)) == b)
        chosen = mine.collect()
        needed = mine.select(F.explode("examples").alias("ref_id")).distinct()
        known = examples.join(needed, "ref_id", "left_semi").toArrow()
        for dim in sorted({len(x) for x in known.column("v").to_pylist()}):
            at, v = unit_rows(known.column("v"), dim)
            place = {known.column("ref_id")[int(i)].as_py(): j for j, i in enumerate(at)}
            plan, names = [], []
            for r in chosen:
                pick = lambda xs: [place[x] for x in xs if x in place]  # noqa: B023,E731
                both = [(place[p["p"]], place[p["n"]]) for p in r["pairs"] or [] if p["p"] in place and p["n"] in place]
                plan.append((len(names), pick(r["positives"] or []), [x for x, _ in both], [x for _, x in both], place.get(r["aim"]), r["own"]))
                names.append(r["tag_id"])
            met = side.mapInArrow(_scored_batches(dim, v.astype("<f8").tobytes(), plan, best if whole else None), "tag long, cand long, triplet long, raw double, pairs long, aim double")
            tag = F.element_at(F.array(*[F.lit(x).cast(kind) for x in names]), (F.col("tag") + 1).cast("int"))
            part = met.select(tag.alias("tag_id"), "cand", "triplet", "raw", "pairs", "aim")
            found.append(part if blocks == 1 else scratch.write(part, "scored"))
    if not found:
        return spark.createDataFrame([], f"tag_id {kind}, cand long, triplet long, raw double, pairs long, aim double")
    together = reduce(DataFrame.union, found)
    if whole:
        return together
    return together.groupBy("tag_id", "cand").agg(F.max("triplet").alias("triplet"), F.max("raw").alias("raw"), F.max("pairs").alias("pairs"), F.max("aim").alias("aim"))


def triplet_threshold(pairs: Column) -> Column:
    """Three quarters of the pairs, at least one."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor(F.least(pairs, F.lit(MAX_PAIRS)) * 3 / 4))


def passes(triplet: Column, raw: Column, pairs: Column, floor: float) -> Column:
    """Classification bar: enough pairs, or without negatives enough cosine."""
    return F.when(triplet.isNotNull(), triplet >= triplet_threshold(pairs)).otherwise(raw >= F.lit(floor))


def ranked(scored: DataFrame, limit: int) -> DataFrame:
    """Informative candidates by pairs won, cosine to the target, best cosine, id: adds ``rnk``."""
    order = Window.partitionBy("tag_id").orderBy(F.desc(F.coalesce("triplet", F.lit(0))), F.desc_nulls_last("aim"), F.desc("raw"), "cand")
    kept = scored.where("coalesce(triplet, 0) > 0 or raw > 0")
    return kept.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= limit)


def without_references(scored: DataFrame, tags: DataFrame) -> DataFrame:
    """Drop a tag's own examples and its target."""
    own = reference_ids(tags).select("tag_id", F.col("ref_id").alias("cand"))
    target = tags.where("target_id is not null").select("tag_id", F.col("target_id").alias("cand"))
    return scored.join(own.union(target), ["tag_id", "cand"], "left_anti")


def check_tag(positives: list, negatives: list, target=None) -> str:
    """Kind of query that a tag's examples allow: ``discover`` or ``recommend``; else an error."""
    if not positives and not negatives and target is None:
        raise ValueError("a tag without examples and target cannot be searched")
    if positives and negatives:
        return "discover"
    if not positives and target is None:
        raise ValueError("a tag with negative examples only cannot be searched; add a positive one or a target")
    return "recommend"


def recommended(scored: DataFrame, tags: DataFrame, limit: int, floor: float | None = None) -> DataFrame:
    """Best cosine to any positive (the target among them), top ``limit``; the floor cuts after the limit."""
    best = without_references(scored.select("tag_id", "cand", "raw"), tags)
    order = Window.partitionBy("tag_id").orderBy(F.desc("raw"), "cand")
    top = best.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= limit)
    return top if floor is None else top.where(F.col("raw") >= floor)


def chosen_collection(collection: str, case: DataFrame, reference: DataFrame | None) -> DataFrame:
    """The points to look through: the case collection (``dataset``) or the reference one, which must be there."""
    if collection not in ("dataset", "reference"):
        raise ValueError(f"unknown collection {collection!r}")
    if collection == "reference" and reference is None:
        raise ValueError("no reference collection is configured")
    return case if collection == "dataset" else reference


def examples_in(tags: DataFrame, points: DataFrame, point_id: str) -> DataFrame:
    """Tags with only those examples that the explored collection holds, in their order."""
    held = reference_ids(tags).join(points.select(F.col(point_id).alias("ref_id")), "ref_id", "left_semi")
    side = lambda s: F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("pos", "ref_id")))), lambda x: x["ref_id"])
    lists = held.groupBy("tag_id").agg(side("p").alias("_p"), side("n").alias("_n"))
    none = F.array().cast(tags.schema["positive_ids"].dataType)
    return tags.join(lists, "tag_id", "left").withColumns({"positive_ids": F.coalesce("_p", none), "negative_ids": F.coalesce("_n", none)}).drop("_p", "_n")


def explored(scored: DataFrame, tags: DataFrame, limit: int, order: str = "count") -> DataFrame:
    """Unlabelled candidates by pairs won, or nearest to half of them (``boundary``)."""
    rank = F.desc("triplet") if order == "count" else F.abs(F.col("triplet") - F.col("pairs") / 2)
    by = Window.partitionBy("tag_id").orderBy(rank, F.desc("raw"), "cand")
    free = without_references(scored.where("triplet is not null"), tags)
    return free.withColumn("rnk", F.row_number().over(by)).where(F.col("rnk") <= limit)


def random_sample(points: DataFrame, exclude: DataFrame, point_id: str, limit: int, seed: int) -> DataFrame:
    """Uniformly chosen points outside ``exclude``; the same seed gives the same ones on any cluster."""
    free = points.join(exclude.select(F.col(exclude.columns[0]).alias(point_id)), point_id, "left_anti")
    return free.orderBy(F.xxhash64(F.lit(seed), point_id), point_id).limit(limit)


def classified(scored: DataFrame, tags: DataFrame, floor: float) -> DataFrame:
    """``(cand, tag_id)`` that pass the bar; tags whose negatives all fail to resolve are skipped."""
    declared = tags.select("tag_id", (F.size("negative_ids") > 0).alias("declared"))
    known = scored.join(declared, "tag_id")
    safe = known.where(~(F.col("declared") & F.col("pairs").isNull()))
    return safe.where(passes(F.col("triplet"), F.col("raw"), F.col("pairs"), floor)).select("cand", "tag_id", "triplet", "raw")
