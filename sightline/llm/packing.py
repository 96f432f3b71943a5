"""Filling fixed-capacity containers (problem 6).

Shortest-pack-first over the length histogram.  The histogram has at most
``capacity`` bins however many documents there are, so the plan - how often each
pattern of lengths is used - is made on the driver in time that depends on the
capacity, not on the documents.  Patterns are then joined back by rank: the
k-th document of a length goes to the k-th place reserved for that length.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.running import running_total
from sightline.llm.tokens import DEFAULT_VOCABULARY, token_count

def plan_packs(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths of a pack, how many such packs)``, from ``{length: count}``.

    Lengths are placed longest first; each goes on the packs with the fewest
    tokens that still have the room (shortest pack first), splitting a pattern's
    count where only some of its packs take one.  Lengths beyond the capacity
    and lengths below one do not belong here.
    """
    by_free: dict[int, list[list]] = defaultdict(list)  # free tokens -> [pattern, count]
    frees: list[int] = []  # max-heap by free space

    def put(pattern: tuple[int, ...], count: int, free: int) -> None:
        if free not in by_free or not by_free[free]:
            heapq.heappush(frees, -free)
        by_free[free].append([pattern, count])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} does not fit a container of {capacity}")
        back: list[tuple] = []  # packs that took one of this length wait for the next
        while left:
            while frees and not by_free[-frees[0]]:
                heapq.heappop(frees)
            free = -frees[0] if frees else 0
            if free < length:
                break
            entry = by_free[free].pop()
            pattern, count = entry
            used = min(count, left)
            if used < count:
                by_free[free].append([pattern, count - used])
            left -= used
            back.append((pattern + (length,), used, free - length))
        again = defaultdict(int)
        for pattern, count, free in back:
            again[pattern, free] += count
        for (pattern, free), count in again.items():
            put(pattern, count, free)
        if left:
            each = capacity // length
            full, rest = divmod(left, each)
            if full:
                put((length,) * each, full, capacity - each * length)
            if rest:
                put((length,) * rest, 1, capacity - rest * length)
    return [(p, c) for packs in by_free.values() for p, c in packs if c]


def pack_documents(docs: DataFrame, capacity: int = 2048, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Place every document: ``(container bigint, doc_id, piece int, tokens int)``.

    A document within the capacity is one piece.  A longer one is split into
    full containers and a remainder piece that is packed like a document.
    Null and empty texts have no tokens and need no place: they do not appear.
    Repeated texts are documents of their own.  An empty table gives no rows.
    """
    sized = docs.select("doc_id", token_count("text", vocabulary).alias("tokens")).where("tokens > 0")
    pieces = sized.select(
        "doc_id",
        F.posexplode(F.transform(
            F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / capacity).cast("int")),
            lambda i: F.least(F.lit(capacity), F.col("tokens") - i * capacity),
        )).alias("piece", "tokens"),
    )
    return _place(pieces, capacity)


def _place(pieces: DataFrame, capacity: int) -> DataFrame:
    from sightline.session import Scratch

    spark = pieces.sparkSession
    kept = Scratch(spark).write(pieces, "pieces")
    # at most `capacity` rows, whatever the input
    histogram = {r["tokens"]: r["n"] for r in kept.groupBy("tokens").agg(F.count("*").alias("n")).collect()}
    plan = plan_packs(histogram, capacity)
    rows, first, used = [], 0, defaultdict(int)
    for pattern, count in plan:
        inside = defaultdict(int)
        for length in pattern:
            inside[length] += 1
        for length, each in inside.items():
            # ranks [from_rank, from_rank + count*each) of this length go to containers first..first+count
            rows.append((length, used[length], each, count, first))
            used[length] += each * count
        first += count
    # one row per length and pattern: bounded by the plan, not by the documents
    slots = spark.createDataFrame(rows, "tokens int, from_rank long, each int, packs long, first long")
    ranked = running_total(kept, ["tokens"], ["doc_id", "piece"], F.lit(1), sum(histogram.values()), "rank")
    # a run of ranks is found by its block number: slots are cut to blocks of ranks
    block = 4096
    cut = slots.select(
        "*", F.explode(F.sequence(F.floor(F.col("from_rank") / block),
                                  F.floor((F.col("from_rank") + F.col("each") * F.col("packs") - 1) / block))).alias("rb"),
    )
    at = F.col("rank") - F.col("from_rank")
    return (
        ranked.withColumn("rb", F.floor(F.col("rank") / block))
        .join(cut, ["tokens", "rb"])
        .where((at >= 0) & (at < F.col("each") * F.col("packs")))
        .select((F.col("first") + F.floor(at / F.col("each"))).alias("container"), "doc_id", F.col("piece").cast("int").alias("piece"), "tokens")
    )


def oversized_documents(docs: DataFrame, capacity: int = 2048, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``doc_id`` of the documents that the packing had to split."""
    packed = pack_documents(docs, capacity, vocabulary)
    return packed.where("piece = 1").select("doc_id")


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers used, tokens placed, share of space left over."""
    per = packed.groupBy("container").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    return per.agg(
        F.count("*").alias("containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("n"), F.lit(0)).alias("pieces"),
        F.max("t").alias("fullest"), (1 - F.sum("t") / (F.count("*") * capacity)).alias("unused_share"),
    )
