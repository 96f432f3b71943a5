"""New batches against all accepted records (problem 4).

The history is a forest of persisted, sorted runs.  A record has up to three
signatures, permutations of what is known of it: its sha256 first, its md5
first, its location first, each followed by the kinds of digest that it has.
The leading value is a 128-bit hash; below it a prefix tree has at most four
leaves, one per set of digest kinds, and each leaf keeps the earliest accepted
record.  A run holds one row per leading value, with its leaves side by side.

A batch is cut into ranges of the leading bits.  Of each run only the part that
holds a range is read (folders by leading bits, then the files' minima and
maxima), the range's entries are met there by their whole leading value, and the
leaves verify: a digest kind that both sides have must agree, which a leaf of
another value does not.  Records with one leading value share its whole prefix,
so the search starts at the width at which every partner is found (recall 1)
and a shorter prefix could only add strangers.

Runs have levels; ``MERGE_RUNS`` of a level are merged into one of the next.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.digests import clean_digest
from sightline.functions.paths import clean_location
from sightline.session import Scratch, delete_path, get_json, put_json, shared_dir

# runs of a level that are merged into one of the next
MERGE_RUNS = 4
# rows of a run that share a folder of leading bits, about, and how many bits name folders at most
RANGE_ROWS, RANGE_BITS = 4_000_000, 12
# bytes that one range of a batch may take where it is broadcast, and bytes of an entry there
RANGE_BYTES, ENTRY_BYTES = 64 << 20, 320
LAST_BATCH = 2**31 - 1
HAS_SHA, HAS_MD5 = 1, 2
LEAVES = [f"first_{kinds}" for kinds in range(4)]


def _value(kind: str, c: Column) -> Column:
    """128-bit hash of a leading value; null where there is none."""
    return F.when(c.isNotNull(), F.struct(F.xxhash64(F.lit(kind), c).alias("hi"), F.xxhash64(c, F.lit(kind)).alias("lo")))


def clean_records(records: DataFrame) -> DataFrame:
    """``(batch_no, id, sha, md5, loc)`` with digests and paths in one notation, as hashes.

    A value is null where there is no digest or place.  Records without a batch
    come after all batches; records without an id are left out.
    """
    plain = records.select(
        F.coalesce("batch_no", F.lit(LAST_BATCH)).alias("batch_no"), F.col("record_id").alias("id"), clean_digest("sha256", 64).alias("sha"),
        clean_digest("md5", 32).alias("md5"), clean_location("path").alias("loc"),
    ).where("id is not null")
    return plain.select("batch_no", "id", *[_value(c, F.col(c)).alias(c) for c in ("sha", "md5", "loc")])


def _signatures(clean: DataFrame) -> DataFrame:
    """``(id, hi, lo, kinds, apart)``: the signatures of clean records.

    ``kinds`` are the digest kinds that the record has.  A partner with the same
    leading value must have none of the kinds in ``apart``: those are the kinds
    in which the two would have to agree, and agreement is found at the
    permutation that begins with that digest.  With the same sha256 nothing else
    matters; with the same md5 one side must lack a sha256; at the same location
    the sides must have no digest kind in common.
    """
    kinds = F.when(F.col("sha").isNotNull(), HAS_SHA).otherwise(0) + F.when(F.col("md5").isNotNull(), HAS_MD5).otherwise(0)
    led = lambda c, apart: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.hi").alias("hi"), F.col(f"{c}.lo").alias("lo"), apart.alias("apart")))
    all_of = F.array_compact(F.array(led("sha", F.lit(0)), led("md5", kinds.bitwiseAND(HAS_SHA)), led("loc", kinds)))
    return clean.select("id", kinds.cast("tinyint").alias("kinds"), F.explode(all_of).alias("s")).select(
        "id", "s.hi", "s.lo", "kinds", F.col("s.apart").cast("tinyint").alias("apart"))


def _leaves(signatures: DataFrame) -> DataFrame:
    """One row per leading value: the earliest record of each leaf."""
    return signatures.groupBy("hi", "lo").agg(*[F.min(F.when(F.col("kinds") == k, F.col("id"))).alias(c) for k, c in enumerate(LEAVES)])


def _earliest() -> Column:
    """The earliest record of the leaves that an entry's ``apart`` allows."""
    open_to = [F.when(F.col("apart").bitwiseAND(F.lit(k).cast("tinyint")) == 0, F.col(c)) for k, c in enumerate(LEAVES)]
    return F.least(*open_to)


def _range_bits(rows: int, each: int, most: int) -> int:
    """Leading bits that cut ``rows`` into ranges of about ``each``."""
    return min(most, max(0, (-(-rows // each) - 1).bit_length()))


class HashForest:
    """Accepted records as runs below ``root``; the same root opens the same forest again.

    ``forest.json`` names the runs (path, level, leading bits, rows at most), the
    admitted batches and the merges so far.  It is replaced as a whole after a
    batch's run is written, so a job that dies in between leaves the forest as it
    was.  ``range_rows`` and ``range_bytes`` set the sizes of folders and of
    broadcast ranges.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, range_rows: int = RANGE_ROWS, range_bytes: int = RANGE_BYTES):
        self.spark, self.root = spark, (root or f"{shared_dir(spark)}/forest-{uuid.uuid4().hex}").rstrip("/")
        self.range_rows, self.range_bytes = range_rows, range_bytes
        self.state = get_json(spark, f"{self.root}/forest.json") or {"runs": [], "admitted": [], "merges": 0}

    def _read(self, run: dict) -> DataFrame:
        schema = "hi long, lo long, " + ", ".join(f"{c} long" for c in LEAVES) + (", top int" if run["bits"] else "")
        df = self.spark.read.schema(schema).parquet(f"{self.root}/{run['path']}")
        return df if run["bits"] else df.withColumn("top", F.lit(0))

    def _write(self, leaves: DataFrame, rows: int, level: int) -> dict:
        """One run, sorted by leading value; large ones in folders by leading bits."""
        bits = _range_bits(rows, self.range_rows, RANGE_BITS)
        path = f"run-{uuid.uuid4().hex}"
        if bits:
            topped = leaves.withColumn("top", F.shiftright("hi", 64 - bits).cast("int"))
            topped.repartition("top").sortWithinPartitions("top", "hi", "lo").write.partitionBy("top").parquet(f"{self.root}/{path}")
        else:
            leaves.sortWithinPartitions("hi", "lo").write.parquet(f"{self.root}/{path}")
        return {"path": path, "level": level, "bits": bits, "rows": rows}

    def find(self, signatures: DataFrame, entries: int) -> DataFrame:
        """``(id, first)``: for each entry of at most ``entries`` with a partner, the earliest.

        Every range of the batch is at most ``range_bytes`` and is broadcast to
        the files of that range, so the history is read once, unshuffled.
        """
        runs = self.state["runs"]
        if not runs:
            return self.spark.createDataFrame([], "id long, first long")
        cut = _range_bits(entries * ENTRY_BYTES, self.range_bytes, 63)
        most = max(run["bits"] for run in runs)
        # folders that the batch has entries for: at most 2^RANGE_BITS small numbers
        tops = None
        if most and entries < 8 << most:
            tops = [r[0] for r in signatures.select(F.shiftright("hi", 64 - most).cast("int").alias("top")).distinct().collect()]
        found = []
        for part in range(1 << cut):
            lo = -(1 << 63) + (part << (64 - cut))
            inside = F.lit(True) if not cut else F.col("hi").between(lo, lo + (1 << (64 - cut)) - 1)
            parts = []
            for run in runs:
                part_of_run = self._read(run).where(inside)
                if run["bits"]:
                    shift = 64 - run["bits"]
                    part_of_run = part_of_run.where(F.col("top").between(lo >> shift, (lo + (1 << (64 - cut)) - 1) >> shift))
                    if tops is not None:
                        part_of_run = part_of_run.where(F.col("top").isin(sorted({t >> (most - run["bits"]) for t in tops})))
                parts.append(part_of_run.drop("top"))
            # met by the leading 64 bits, one number a key keeps the broadcast table small; the other 64 verify
            entry = F.broadcast(signatures.where(inside).select("id", F.col("hi").alias("key"), F.col("lo").alias("rest"), "apart"))
            met = reduce(DataFrame.union, parts).join(entry, (F.col("hi") == F.col("key")) & (F.col("lo").bitwiseXOR(F.col("rest")) == 0))
            found.append(met.select("id", _earliest().alias("first")).where("first is not null"))
        return reduce(DataFrame.union, found).groupBy("id").agg(F.min("first").alias("first"))

    def add(self, signatures: DataFrame, entries: int, batch) -> None:
        """File the accepted records of a batch as a run, merge where a level is full, then swap the manifest."""
        runs = [*self.state["runs"], self._write(_leaves(signatures), entries, 0)]
        merges, old = self.state["merges"], []
        while True:
            level = next((x for x in sorted({r["level"] for r in runs}) if sum(r["level"] == x for r in runs) >= MERGE_RUNS), None)
            if level is None:
                break
            full = [r for r in runs if r["level"] == level]
            together = reduce(DataFrame.union, [self._read(r).drop("top") for r in full]).groupBy("hi", "lo").agg(*[F.min(c).alias(c) for c in LEAVES])
            runs = [r for r in runs if r["level"] != level] + [self._write(together, sum(r["rows"] for r in full), level + 1)]
            merges, old = merges + 1, [*old, *full]
        self.state = {"runs": runs, "admitted": [*self.state["admitted"], batch], "merges": merges}
        put_json(self.spark, f"{self.root}/forest.json", self.state)
        for run in old:
            delete_path(self.spark, f"{self.root}/{run['path']}")


def _settle(clean: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Go through a batch's own records in id order: parts of ``(id, first)``, who repeats whom.

    Rounds over the minima of leaves.  A record's earliest earlier partner among
    all records that are accepted or still open decides: there is none, and it
    is accepted; it is accepted, and the record repeats it; it is open, and the
    record waits.  The smallest open record is settled in every round.  Only
    one row per leading value moves against the entries, so a value shared by a
    third of the batch stays one row; from the second round on only the values of waiting records are looked at.
    """
    alive, repeats = clean, []
    entries = _signatures(clean)
    leaves = _leaves(entries)
    while True:
        near = entries.join(leaves, ["hi", "lo"]).select("id", _earliest().alias("first")).where("first < id")
        follows = scratch.write(near.groupBy("id").agg(F.min("first").alias("first")), "follows")
        # open after this look: whoever has an earlier partner that itself has one
        unsure = follows.select(F.col("id").alias("first"))
        repeats.append(follows.join(unsure, "first", "left_anti").select("id", "first"))
        waiting = follows.join(unsure, "first", "left_semi").select("id")
        if waiting.isEmpty():
            return repeats
        alive = scratch.write(alive.join(repeats[-1].select("id"), "id", "left_anti"), "alive")
        entries = _signatures(alive.join(waiting, "id", "left_semi"))
        leaves = _leaves(_signatures(alive).join(entries.select("hi", "lo").distinct(), ["hi", "lo"], "left_semi"))


def admit(forest: HashForest, load: DataFrame, batch, rows: int) -> DataFrame:
    """Check one batch of clean records (at most ``rows``) against the forest and itself, file what is accepted.

    Returns ``(first_id, again_id)``, one row per repeating record with the
    earliest accepted record that it repeats.  Of the history only the runs' ranges are
    read, never the earlier records.  A batch that was admitted before is an error.
    """
    if batch in forest.state["admitted"]:
        raise ValueError(f"batch {batch!r} was admitted before")
    scratch = Scratch(forest.spark)
    parts, fresh = [], load
    if forest.state["runs"]:
        looked = scratch.write(load.join(forest.find(_signatures(load), 3 * rows), "id", "left"), "looked")
        parts.append(looked.where("first is not null").select("id", "first"))
        fresh = looked.where("first is null").drop("first")
    parts += _settle(fresh, scratch)
    found = scratch.write(reduce(DataFrame.union, parts), "found")
    forest.add(_signatures(load.join(found, "id", "left_anti")), 3 * rows, batch)
    return found.select(F.col("first").alias("first_id"), F.col("id").alias("again_id"))


def repeated_records(records: DataFrame, forest: HashForest | None = None) -> DataFrame:
    """Every record that repeats an accepted one, with that one: ``(first_id, again_id)``.

    ``records`` needs batch_no, record_id, sha256, md5, path; other columns are
    ignored, status included.  Batches are admitted one by one in their order;
    inside a batch the ids decide, which must grow with the batch.  A record
    without any digest and location matches nothing and is accepted; record ids
    repeated inside the table count as one record; rows without an id are left
    out; an empty table gives no rows.  A ``forest`` that has admitted earlier
    batches takes their place: only new batches need be in ``records``.
    """
    spark = records.sparkSession
    scratch, forest = Scratch(spark), forest or HashForest(spark)
    # a batch's rows lie together, a large batch's in several files
    spread = F.pmod(F.xxhash64("id"), F.lit(8))
    clean = scratch.write(clean_records(records).repartition("batch_no", spread), "clean", "batch_no")
    numbers = sorted((r["batch_no"], r["n"]) for r in clean.groupBy("batch_no").agg(F.count("*").alias("n")).collect())
    found = []
    for at, (number, rows) in enumerate(numbers):
        found.append(admit(forest, clean.where(F.col("batch_no") == number).drop("batch_no"), number, rows))
        if at % MERGE_RUNS == MERGE_RUNS - 1:
            # broadcast tables and shuffle files of the batches before go when the driver collects its garbage
            spark.sparkContext._jvm.System.gc()
    if not found:
        return spark.createDataFrame([], "first_id long, again_id long")
    return reduce(DataFrame.union, found)
