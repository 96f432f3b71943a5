"""Score distributions, fits, filters and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = 20  # fixed value: histogram buckets
# fixed values: process and measurement variance of the throughput filter
PROCESS_VARIANCE, MEASURE_VARIANCE = 50.0, 100.0
# fixed values of the batch-size search
MIN_GAIN, PEAK_SHARE, PEAK_DROPS, PLATEAU_WINDOW, PLATEAU_CV, EFFICIENCY = 0.03, 0.70, 3, 4, 0.10, 0.95


def distribution(scored: DataFrame, keys: list[str], score: str, sample: int | None = 10_000) -> DataFrame:
    """Count, extremes, percentiles, mean and sample deviation of the best ``sample`` scores of a key."""
    rows = scored
    if sample is not None:
        best = Window.partitionBy(*keys).orderBy(F.desc(score))
        rows = rows.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= sample)
    p = F.percentile(score, F.array(*[F.lit(x) for x in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    return rows.groupBy(*keys).agg(
        F.count(score).alias("n"), F.min(score).alias("min_score"), p.alias("p"), F.max(score).alias("max_score"),
        F.mean(score).alias("mean"), F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("stdev"),
    ).select(*keys, "n", "min_score", *[F.col("p")[i].alias(x) for i, x in enumerate(("p10", "p25", "median", "p75", "p90"))], "max_score", "mean", "stdev")


def bucket(score: Column) -> Column:
    """Bucket of a cosine after moving [-1, 1] to [0, 1]."""
    x = (F.greatest(F.lit(-1.0), F.least(score, F.lit(1.0))) + 1) / 2
    return F.least(F.greatest(F.floor(x * BUCKETS), F.lit(0)), F.lit(BUCKETS - 1)).cast("int")


def histogram(scored: DataFrame, keys: list[str], score: str) -> DataFrame:
    """``(keys, bucket, n)`` with every bucket present."""
    counts = scored.groupBy(*keys, bucket(F.col(score)).alias("bucket")).agg(F.count("*").alias("n"))
    grid = scored.select(*keys).distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))))
    return grid.join(counts, [*keys, "bucket"], "left").select(*keys, "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def saturation_fit(probes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per key, fit ``T(b) = tmax * b / (k + b)`` by least squares on (b, b/T), and the batch for 95 % of it."""
    keys = keys or []
    fit = probes.groupBy(*keys).agg(F.regr_slope(F.col("b") / F.col("t"), F.col("b")).alias("a"), F.regr_intercept(F.col("b") / F.col("t"), F.col("b")).alias("c"),
                     F.max("b").alias("max_b"), F.max_by("b", "t").alias("best_b"), F.count("*").alias("n"))
    good = (F.col("n") >= 2) & (F.col("a") > 0)
    k = F.greatest(F.col("c") / F.col("a"), F.lit(0.0))
    star = F.when(good, k * EFFICIENCY / (1 - EFFICIENCY)).otherwise(0.0)
    power = F.pow(F.lit(2.0), F.floor(F.log2(F.least(star, F.col("max_b").cast("double"))))).cast("bigint")
    return fit.select(*keys, F.when(good, 1 / F.col("a")).alias("t_max"), F.when(good, k).alias("k_half"), star.alias("b_star"),
                      F.when(star >= 1, power).otherwise(F.col("best_b").cast("bigint")).alias("batch"))


def probe_stops(probes: DataFrame, keys: list[str]) -> DataFrame:
    """Where a doubling search stops: ``(keys, ord, reason)`` of the first step that saturates, decays or settles.

    Input ``keys, ord, t``.  Saturation: gain of 0 to 3 % on the step before.
    Decay: the last three below 70 % of the best so far.  Plateau: deviation of
    the last four below 10 % of their mean, from the fifth step on.
    """
    by = Window.partitionBy(*keys).orderBy("ord")
    last4 = by.rowsBetween(-(PLATEAU_WINDOW - 1), 0)
    prev, peak = F.lag("t").over(by), F.max("t").over(by.rowsBetween(Window.unboundedPreceding, 0))
    steps = probes.withColumns({
        "_prev": prev, "_peak": peak, "_n": F.row_number().over(by),
        "_last3": F.collect_list("t").over(by.rowsBetween(-(PEAK_DROPS - 1), 0)),
        "_cv": F.stddev_pop("t").over(last4) / F.avg("t").over(last4),
    })
    gain = (F.col("t") - F.col("_prev")) / F.col("_prev")
    low = F.size(F.filter("_last3", lambda x: x < F.col("_peak") * PEAK_SHARE)) == PEAK_DROPS
    reason = (
        F.when(F.col("_prev").isNotNull() & (gain >= 0) & (gain < MIN_GAIN), "saturated")
        .when((F.col("_n") >= PEAK_DROPS) & low, "decayed")
        .when((F.col("_n") > PLATEAU_WINDOW) & (F.col("_cv") < PLATEAU_CV), "settled")
    )
    return steps.withColumn("reason", reason).where("reason is not null").groupBy(*keys).agg(
        F.min("ord").alias("ord"), F.min_by("reason", "ord").alias("reason"))


def throughput_filter(batches: DataFrame, keys: list[str], order: str, n: str, seconds: str) -> DataFrame:
    """Filtered rate of a run's batches: ``(keys, updates, rate, variance)``.

    Each key's few batches are folded in order; batches without items or time
    are skipped.  ``remaining_time`` goes on from here.
    """
    seen = F.when((F.col(n) > 0) & (F.col(seconds) > 0), F.struct(F.col(order).alias("o"), (F.col(n) / F.col(seconds)).alias("z")))
    state = F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("x"), F.lit(0.0).alias("p"))

    def step(acc: Column, row: Column) -> Column:
        ahead = acc["p"] + PROCESS_VARIANCE
        gain = ahead / (ahead + MEASURE_VARIANCE)
        first = acc["k"] == 0
        return F.struct((acc["k"] + 1).alias("k"), F.when(first, row["z"]).otherwise(acc["x"] + gain * (row["z"] - acc["x"])).alias("x"),
                        F.when(first, F.lit(MEASURE_VARIANCE)).otherwise((1 - gain) * ahead).alias("p"))

    folded = batches.groupBy(*keys).agg(F.aggregate(F.sort_array(F.collect_list(seen)), state, step).alias("s"))
    return folded.where("s.k > 0").select(*keys, F.col("s.k").alias("updates"), F.col("s.x").alias("rate"), F.col("s.p").alias("variance"))


def remaining_time(filtered: DataFrame, remaining: str) -> DataFrame:
    """Adds ``eta_seconds`` and its deviation ``eta_deviation`` for ``remaining`` items; null before the second update."""
    known = (F.col("updates") >= 2) & (F.col("rate") > 0)
    n = F.col(remaining)
    return filtered.withColumns({
        "eta_seconds": F.when(known, n / F.col("rate")), "eta_deviation": F.when(known, n * F.sqrt("variance") / (F.col("rate") * F.col("rate")))})


def principal_axes(points: DataFrame, point_id: str, vector: str, limit: int = 5000) -> DataFrame:
    """``(id, x, y, z)``: up to ``limit`` vectors on their three main axes, scaled to [-1, 1].

    Fewer than three vectors lie at the origin.  Axes may be mirrored.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    chosen = points.where(F.col(vector).isNotNull()).orderBy(point_id).limit(limit).select(F.col(point_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    if chosen.limit(3).count() < 3:
        return chosen.select("id", *[F.lit(0.0).alias(a) for a in "xyz"])
    means = chosen.select(F.posexplode("v")).groupBy("pos").agg(F.avg("col").alias("m")).groupBy().agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("ms"))
    centred = chosen.crossJoin(F.broadcast(means)).select("id", F.zip_with("v", F.transform("ms", lambda x: x["m"]), lambda a, b: a - b).alias("c"))
    data = centred.select("id", array_to_vector("c").alias("f"))
    flat = PCA(k=3, inputCol="f", outputCol="o").fit(data).transform(data).select("id", vector_to_array("o").alias("o"))
    top = flat.agg(F.max(F.array_max(F.transform("o", F.abs))).alias("m"))
    scaled = lambda i: F.col("o")[i] / F.when(F.col("m") > 0, F.col("m")).otherwise(1.0)
    return flat.crossJoin(F.broadcast(top)).select("id", *[scaled(i).alias(a) for i, a in enumerate("xyz")])
