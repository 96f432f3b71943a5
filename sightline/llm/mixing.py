"""Mixing sources to target weights (problem 7).

The documents of a source, in a fixed pseudorandom order, are one stream of
tokens cut into blocks of fixed length.  The mix has as many block slots as the
documents have blocks' worth of tokens; slots are grouped into shards, each
shard draws its slots' sources from a multinomial, and the k-th slot of a source
takes block ``perm(pass, k mod blocks)`` in pass ``k div blocks``.  The shares of
the draw are the target shares, but a source whose passes end before that gets
no more than its passes hold and the others take its place in proportion, and
slots that a draw gives it beyond its last pass are drawn again among the
others: the mix is as large as asked.  The report shows the shares reached.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.llm.running import running_total
from sightline.llm.tokens import DEFAULT_VOCABULARY, token_count
from sightline.session import Scratch

# deviations of a source's number of drawn slots that count as chance
SIGMAS = 6
BLOCK_TOKENS = 1024
SHARD_SLOTS = 4096


def plain_source(col: Column | str) -> Column:
    """Sources are compared without letter case and surrounding blanks."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def permuted(index, size, key):
    """Pseudorandom permutation of ``range(size)`` at ``index`` (arrays), by ``key``.

    A four-round Feistel network over the next even number of bits, walked along
    its cycle until the value lies in the range.
    """
    import numpy as np

    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, size, key = index.astype(np.uint64), size.astype(np.uint64), key.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        left, right = x[todo] >> half[todo], x[todo] & mask[todo]
        for turn in range(4):
            h = (right + key[todo] * np.uint64(4) + np.uint64(turn + 1)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((h ^ (h >> np.uint64(32))) & mask[todo])
        x[todo] = (left << half[todo]) | right
        todo = x >= size
    return x.astype(np.int64)


def drawn_shares(wanted: list[float], capacity: list[int], slots: int) -> tuple[list[float], set[int]]:
    """Shares of the draw, and which sources are short: those get what their passes hold, the others the rest in proportion."""
    shares, short = list(wanted), set()
    room = [c / slots for c in capacity]
    while True:
        more = {i for i, x in enumerate(shares) if i not in short and x > room[i]}
        if not more:
            return shares, short
        short |= more
        left, rest = 1.0 - sum(room[i] for i in short), sum(w for i, w in enumerate(wanted) if i not in short)
        shares = [room[i] if i in short else (w / rest * left if rest > 0 else 0.0) for i, w in enumerate(wanted)]


def source_sizes(docs: DataFrame, targets: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """Sized documents ``(doc_id, source, tokens)`` and one row of totals per target source."""
    sized = Scratch(docs.sparkSession).write(
        docs.select("doc_id", plain_source("source").alias("source"), token_count("text", vocabulary).alias("tokens")), "sized"
    )
    total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"))
    per = sized.groupBy("source").agg(F.sum("tokens").alias("n"), F.count("*").alias("docs"))
    wanted = targets.select(F.col("source").alias("name"), plain_source("source").alias("source"),
                             F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_uses", F.lit(0)).alias("max_uses"))
    sizes = (
        wanted.join(per, "source", "left").crossJoin(F.broadcast(total))  # one row
        .select("name", "source", "target_share", "max_uses", F.coalesce("docs", F.lit(0)).alias("documents"),
                F.coalesce("n", F.lit(0)).alias("tokens"), "total_tokens")
        .withColumn("wanted_tokens", F.col("target_share") * F.col("total_tokens"))
        .withColumn("short", F.col("tokens") * F.col("max_uses") < F.col("wanted_tokens"))
    )
    return sized, sizes


def mix(docs: DataFrame, targets: DataFrame, seed: int = 0, vocabulary: str = DEFAULT_VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    Mix: ``(shard, slot, source, pass, block, doc_id, first_token, tokens)``, one
    row per piece of a document in a filled slot.  Report: one row per target
    source with the wanted and reached share, the uses, whether its passes ran
    out in the draw (or came within chance of it) and whether it is short: all
    its tokens, used as often as allowed, are less than its share.
    Documents of sources without a target and texts without tokens add to the
    total but are not used; a target source without documents is reported with
    nothing reached.  Targets are a small fixed table (one row per source), the
    only rows that reach the driver; a missing share or number of uses is 0, and
    shares that do not sum to 1 are scaled.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    sized, sizes = source_sizes(docs, targets, vocabulary)
    plan = sizes.collect()
    total = plan[0]["total_tokens"] if plan else 0
    names = [r["source"] for r in plan]
    shares = [float(r["target_share"]) for r in plan]
    weight = sum(shares)
    shares = [x / weight for x in shares] if weight else []
    blocks = {r["source"]: -(-r["tokens"] // BLOCK_TOKENS) for r in plan}
    uses = {r["source"]: r["max_uses"] for r in plan}
    slots = -(-total // BLOCK_TOKENS) if weight else 0
    capacity = [blocks[n] * uses[n] for n in names]
    shards = -(-slots // SHARD_SLOTS)
    odds, short = drawn_shares(shares, capacity, slots) if slots and shares else (shares, set())
    # what no source can fill is left empty; slots drawn again go to sources that have room
    odds = [*odds, max(0.0, 1.0 - sum(odds))]
    odds = [x / sum(odds) for x in odds]
    again = [0.0 if i in short else x for i, x in enumerate(odds[:-1])]
    again = [x / sum(again) for x in again] if sum(again) > 0 else None

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for ids in batches:
            for shard in ids["id"]:
                n = min(SHARD_SLOTS, slots - shard * SHARD_SLOTS)
                counts = np.random.default_rng([seed, int(shard)]).multinomial(n, odds)[:-1]
                yield pd.DataFrame({"shard": shard, "sno": range(len(names)), "n": counts})

    def draw_again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for over in batches:
            for shard, n in over[["shard", "over"]].itertuples(index=False):
                counts = np.random.default_rng([seed, int(shard), 1]).multinomial(n, again)
                yield pd.DataFrame({"shard": shard, "sno": range(len(names)), "n": counts})

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for drawn in batches:
            for shard, sno, n, base, slot in drawn[["shard", "sno", "n", "base", "slot"]].itertuples(index=False):
                name = names[sno]
                k = np.arange(base, base + n)
                k = k[k < capacity[sno]]
                if len(k):
                    turn, at = np.divmod(k, blocks[name])
                    block = permuted(at, np.full(len(k), blocks[name]), turn * 1009 + sno * 31 + seed)
                    yield pd.DataFrame({"shard": shard, "slot": slot + k - base, "source": name, "pass": turn, "block": block})

    earlier = Window.partitionBy("sno").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counted = "shard long, sno int, n long"
    first = spark.range(shards, numPartitions=max(1, min(shards, 512))).mapInPandas(draw, counted)
    first = scratch.write(first.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("slot", F.lit(0).cast("bigint")), "drawn")
    held = F.element_at(F.array(*[F.lit(c).cast("bigint") for c in capacity]), F.col("sno") + 1) if names else F.lit(0).cast("bigint")
    drawn = first
    if again:
        beyond = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("n"), F.col("base") + F.col("n") - held))
        over = first.groupBy("shard").agg(F.sum(beyond).alias("over")).where("over > 0")
        more = over.mapInPandas(draw_again, counted).withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        ends = first.groupBy("sno").agg(F.sum("n").alias("total"))
        mine = first.select("shard", "sno", F.col("n").alias("before"))
        more = more.join(ends, "sno").join(mine, ["shard", "sno"]).select("shard", "sno", "n", (F.col("base") + F.col("total")).alias("base"), F.col("before").alias("slot"))
        drawn = first.union(more)
    placed = drawn.repartition("shard").mapInPandas(place, "shard long, slot long, source string, pass long, block long")

    used = sized.where(F.col("source").isin(names) & (F.col("tokens") > 0))
    laid = running_total(used, ["source"], ["doc_id"], F.col("tokens"), sum(r["documents"] for r in plan), "start")
    pieces = laid.select(
        "source", "doc_id", "tokens", "start",
        F.explode(F.sequence(F.floor(F.col("start") / BLOCK_TOKENS), F.floor((F.col("start") + F.col("tokens") - 1) / BLOCK_TOKENS))).alias("block"),
    )
    lo = F.greatest(F.col("block") * BLOCK_TOKENS, F.col("start"))
    hi = F.least((F.col("block") + 1) * BLOCK_TOKENS, F.col("start") + F.col("tokens"))
    pieces = pieces.select("source", "block", "doc_id", (lo - F.col("start")).alias("first_token"), (hi - lo).alias("tokens"))
    mixed = scratch.write(
        placed.join(pieces, ["source", "block"]).select("shard", "slot", "source", "pass", "block", "doc_id", "first_token", "tokens"), "mixed"
    )
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"), F.max(F.col("pass") + 1).alias("uses"))
    whole = Window.partitionBy()
    by_source = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("sno") + 1) if names else F.lit(None).cast("string")
    slots_of = first.groupBy("sno").agg(F.sum("n").alias("drawn")).select(by_source.alias("source"), "drawn", held.alias("held"))
    report = (
        sizes.join(got, "source", "left").join(slots_of, "source", "left")
        .withColumn("ran_out", F.coalesce("drawn", F.lit(0)) + SIGMAS * F.sqrt(F.coalesce("drawn", F.lit(0))) + 1 >= F.coalesce("held", F.lit(0)))
        .withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
        .withColumn("reached_share", F.col("mixed_tokens") / F.greatest(F.sum("mixed_tokens").over(whole), F.lit(1)))
        .select(F.col("name").alias("source"), "documents", "tokens", "target_share", "max_uses",
                F.coalesce("uses", F.lit(0)).alias("uses"), "mixed_tokens", "reached_share", "ran_out", "short")
    )
    return mixed, report
