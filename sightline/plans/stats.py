"""Queries over score distributions, fits, filters and time-ordered frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import media
from sightline.operators import sampling, search
from sightline.operators import stats as op
from sightline.plans.search import DOT
from sightline.plans.views import FRAMES, POINTS, frames, points, query_points, table

QUERIES, SQL = {}, {}
SAMPLE = 10_000


def _cosines(spark, d):
    return search.scores(query_points(spark, d), points(spark, d), "point_id", "dino", "point_id", "dino")


_COS = f"cosines AS (SELECT q.point_id AS query_id, p.point_id, {DOT.format(a='q.dino', b='p.dino')} AS score FROM points q, points p WHERE q.point_id % 100 = 0)"
_STATS = ("min_score", "p10", "p25", "median", "p75", "p90", "max_score", "mean", "stdev")


def semantic_stats(spark, d):
    s = op.distribution(_cosines(spark, d), ["query_id"], "score", SAMPLE)
    return s.select("query_id", "n", *[F.round(c, 7).alias(c) for c in _STATS])


QUERIES["semantic_stats"] = semantic_stats
SQL["semantic_stats"] = f"""WITH {POINTS}, {_COS}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC) AS r FROM cosines) WHERE r <= {SAMPLE})
SELECT query_id, count(*) AS n, round(min(score), 7) AS min_score, round(quantile_cont(score, 0.1), 7) AS p10, round(quantile_cont(score, 0.25), 7) AS p25,
    round(quantile_cont(score, 0.5), 7) AS median, round(quantile_cont(score, 0.75), 7) AS p75, round(quantile_cont(score, 0.9), 7) AS p90,
    round(max(score), 7) AS max_score, round(avg(score), 7) AS mean, round(coalesce(stddev_samp(score), 0), 7) AS stdev FROM t GROUP BY query_id"""


BEST = 100


def best_score_stats(spark, d):
    """The same over the best hundred scores of a query: the sample is smaller than what there is."""
    s = op.distribution(_cosines(spark, d), ["query_id"], "score", BEST)
    return s.select("query_id", "n", *[F.round(c, 7).alias(c) for c in _STATS])


QUERIES["best_score_stats"] = best_score_stats
SQL["best_score_stats"] = SQL["semantic_stats"].replace(f"r <= {SAMPLE}", f"r <= {BEST}")


def score_histogram(spark, d):
    return op.histogram(_cosines(spark, d).withColumn("score", F.round("score", 9)), ["query_id"], "score")


QUERIES["score_histogram"] = score_histogram
SQL["score_histogram"] = f"""WITH {POINTS}, {_COS}, b AS (SELECT query_id, least(greatest(floor((greatest(-1, least(round(score, 9), 1)) + 1) / 2 * 20), 0), 19)::INT AS bucket, count(*) AS n FROM cosines GROUP BY ALL)
SELECT q.query_id, g.bucket, coalesce(n, 0) AS n FROM (SELECT DISTINCT query_id FROM cosines) q CROSS JOIN (SELECT unnest(range(20))::INT AS bucket) g LEFT JOIN b USING (query_id, bucket)"""


def _probes(spark, d):
    """Throughput by batch size: order counts and values of the parts."""
    li = table(spark, d, "lineitem").groupBy("l_returnflag", F.pow(F.lit(2.0), F.col("l_linenumber")).cast("int").alias("b")).agg(F.avg("l_quantity").alias("q"))
    return li.select("l_returnflag", "b", (F.lit(100.0) * F.col("b") / (F.lit(20.0) + F.col("b")) + F.col("q") / 100).alias("t"))


_PROBES = "probes AS (SELECT l_returnflag, b, 100.0::DOUBLE * b / (20.0::DOUBLE + b) + q / 100 AS t FROM (SELECT l_returnflag, pow(2, l_linenumber)::INT AS b, avg(l_quantity) AS q FROM lineitem GROUP BY ALL))"
QUERIES["saturation_fit"] = lambda spark, d: op.saturation_fit(_probes(spark, d), ["l_returnflag"]).select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("t_max", "k_half", "b_star")], "batch")
SQL["saturation_fit"] = f"""WITH {_PROBES}, f AS (SELECT l_returnflag, regr_slope(b / t, b) AS a, regr_intercept(b / t, b) AS c, max(b) AS mb, arg_max(b, t) AS bb FROM probes GROUP BY l_returnflag),
g AS (SELECT l_returnflag, 1 / a AS t_max, greatest(c / a, 0) AS k_half, greatest(c / a, 0) * 0.95 / (1 - 0.95) AS b_star, mb, bb FROM f)
SELECT l_returnflag, round(t_max, 6) AS t_max, round(k_half, 6) AS k_half, round(b_star, 6) AS b_star,
    CASE WHEN b_star >= 1 THEN pow(2, floor(log2(least(b_star, mb))))::BIGINT ELSE bb::BIGINT END AS batch FROM g"""


def probe_stops(spark, d):
    """A probing run per supplier nation: quantities in order of the line numbers."""
    li = table(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_linenumber").alias("ord")).agg(F.avg("l_quantity").alias("t"))
    return op.probe_stops(li, ["l_suppkey"])


QUERIES["probe_stops"] = probe_stops
SQL["probe_stops"] = """WITH p AS (SELECT l_suppkey, l_linenumber AS ord, avg(l_quantity) AS t FROM lineitem GROUP BY ALL),
w AS (SELECT *, lag(t) OVER o AS prev, max(t) OVER (PARTITION BY l_suppkey ORDER BY ord ROWS UNBOUNDED PRECEDING) AS peak, row_number() OVER o AS n,
    lag(t, 2) OVER o AS prev2, stddev_pop(t) OVER (PARTITION BY l_suppkey ORDER BY ord ROWS 3 PRECEDING) / avg(t) OVER (PARTITION BY l_suppkey ORDER BY ord ROWS 3 PRECEDING) AS cv
    FROM p WINDOW o AS (PARTITION BY l_suppkey ORDER BY ord)),
r AS (SELECT l_suppkey, ord, CASE WHEN prev IS NOT NULL AND (t - prev) / prev >= 0 AND (t - prev) / prev < 0.03 THEN 'saturated'
    WHEN n >= 3 AND t < 0.7 * peak AND prev < 0.7 * peak AND prev2 < 0.7 * peak THEN 'decayed' WHEN n > 4 AND cv < 0.1 THEN 'settled' END AS reason FROM w)
SELECT l_suppkey, min(ord) AS ord, arg_min(reason, ord) AS reason FROM r WHERE reason IS NOT NULL GROUP BY ALL"""


def throughput_filter(spark, d):
    """Filtered rate per clerkless order stream: one run per customer."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.lit(32).alias("n"), (F.col("o_totalprice") / 100000).alias("seconds"))
    f = op.remaining_time(op.throughput_filter(o, ["o_custkey"], "o_orderkey", "n", "seconds").withColumn("left", F.col("o_custkey") * 10), "left")
    return f.select("o_custkey", F.col("updates").cast("bigint").alias("updates"), F.round("rate", 5).alias("rate"), F.round("variance", 6).alias("variance"),
                    F.round("eta_seconds", 5).alias("eta_seconds"), F.round("eta_deviation", 5).alias("eta_deviation"))


QUERIES["throughput_filter"] = throughput_filter
SQL["throughput_filter"] = """WITH RECURSIVE z AS (SELECT o_custkey, 32 / (o_totalprice / 100000) AS z, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_totalprice > 0),
f AS (SELECT o_custkey, k, z AS x, 100.0::DOUBLE AS p FROM z WHERE k = 1
    UNION ALL SELECT z.o_custkey, z.k, f.x + (f.p + 50) / (f.p + 150) * (z.z - f.x), (1 - (f.p + 50) / (f.p + 150)) * (f.p + 50) FROM f JOIN z ON z.o_custkey = f.o_custkey AND z.k = f.k + 1),
g AS (SELECT o_custkey, max(k) AS updates, arg_max(x, k) AS rate, arg_max(p, k) AS variance FROM f GROUP BY o_custkey)
SELECT o_custkey, updates, round(rate, 5) AS rate, round(variance, 6) AS variance, CASE WHEN updates >= 2 THEN round(o_custkey * 10 / rate, 5) END AS eta_seconds,
    CASE WHEN updates >= 2 THEN round(o_custkey * 10 * sqrt(variance) / (rate * rate), 5) END AS eta_deviation FROM g"""

QUERIES["median_throughput"] = lambda spark, d: table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.median("l_extendedprice").alias("median"))
SQL["median_throughput"] = "SELECT l_suppkey, median(l_extendedprice) AS median FROM lineitem GROUP BY ALL"


def principal_axes(spark, d):
    """Points on their three main axes (rows only: axes may be mirrored)."""
    return op.principal_axes(points(spark, d), "point_id", "dino")


QUERIES["principal_axes"] = principal_axes


def _timed(spark, d):
    # the row's own id as picture: none repeats, so that time alone decides
    return frames(spark, d).where("video_hash is not null and timecode_ms is not null").select("video_hash", "timecode_ms", F.col("match_id").cast("string").alias("picture"))


def greedy_sample(spark, d):
    return sampling.sample_frames(_timed(spark, d), "video_hash", "timecode_ms", "picture", 0.1).select("video", "timecode_ms", "frame_index")


QUERIES["greedy_sample"] = greedy_sample
SQL["greedy_sample"] = f"""WITH RECURSIVE {FRAMES}, t AS (SELECT DISTINCT video_hash AS video, timecode_ms FROM frames WHERE video_hash IS NOT NULL AND timecode_ms IS NOT NULL),
g AS (SELECT video, min(timecode_ms) AS timecode_ms, 0 AS frame_index FROM t WHERE timecode_ms >= 0 GROUP BY video
    UNION ALL SELECT video, nxt, frame_index + 1 FROM (SELECT g.video, g.frame_index, (SELECT min(t.timecode_ms) FROM t WHERE t.video = g.video AND t.timecode_ms >= g.timecode_ms + 10000) AS nxt FROM g) WHERE nxt IS NOT NULL)
SELECT video, timecode_ms, frame_index FROM g"""


def sampled_pictures(spark, d):
    """Sampling with repeated pictures left out, at most so many a video."""
    f = frames(spark, d).where("video_hash is not null and timecode_ms is not null and frame_hash is not null")
    return sampling.sample_frames(f, "video_hash", "timecode_ms", "frame_hash", 1.0, 100)


QUERIES["sampled_pictures"] = sampled_pictures
SQL["sampled_pictures"] = f"""WITH RECURSIVE {FRAMES}, t AS (SELECT video_hash AS video, timecode_ms, min(frame_hash) AS frame_hash FROM frames
    WHERE video_hash IS NOT NULL AND timecode_ms IS NOT NULL AND frame_hash IS NOT NULL GROUP BY ALL),
g AS (SELECT video, min(timecode_ms) AS timecode_ms FROM t WHERE timecode_ms >= 0 GROUP BY video
    UNION ALL SELECT video, nxt FROM (SELECT g.video, (SELECT min(t.timecode_ms) FROM t WHERE t.video = g.video AND t.timecode_ms >= g.timecode_ms + 1000) AS nxt FROM g) WHERE nxt IS NOT NULL),
p AS (SELECT video, frame_hash, min(timecode_ms) AS timecode_ms FROM g JOIN t USING (video, timecode_ms) GROUP BY ALL),
n AS (SELECT *, (row_number() OVER (PARTITION BY video ORDER BY timecode_ms) - 1)::INT AS frame_index FROM p)
SELECT video, timecode_ms, frame_hash, frame_index FROM n WHERE frame_index < 100"""


def nearest_frame(spark, d):
    wanted = table(spark, d, "videos").select(F.col("video_hash").alias("video")).distinct().withColumn("target_ms", F.lit(60_000))
    return sampling.nearest_frame(frames(spark, d), wanted, "video_hash", "timecode_ms", 1000.0)


QUERIES["nearest_frame"] = nearest_frame
SQL["nearest_frame"] = f"""WITH {FRAMES}, m AS (SELECT v.video_hash AS video, 60000 AS target_ms,
    min(timecode_ms) FILTER (timecode_ms >= 59000) AS here, max(timecode_ms) FILTER (timecode_ms < 59000) AS before
    FROM (SELECT DISTINCT video_hash FROM videos) v LEFT JOIN frames f ON f.video_hash = v.video_hash GROUP BY v.video_hash)
SELECT video, target_ms, CASE WHEN here > 61000 AND before IS NOT NULL THEN before ELSE here END AS found_ms FROM m"""


def idle_sessions(spark, d):
    e = table(spark, d, "events")
    now = F.lit("2024-01-30 18:00:00").cast("timestamp")
    return sampling.idle_sessions(e, "user_id", "ts", now, 3600)


QUERIES["idle_sessions"] = idle_sessions
SQL["idle_sessions"] = "SELECT user_id, max(ts) AS last_access FROM events WHERE user_id IS NOT NULL GROUP BY user_id HAVING TIMESTAMP '2024-01-30 18:00:00' - max(ts)::TIMESTAMP > INTERVAL 3600 SECOND"


def geometry(spark, d):
    """Sizes and crops of pictures as large as the parts' numbers."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 1900 + 300).cast("int").alias("w"), (F.col("p_size") * 37 + 290).cast("int").alias("h"))
    cw, ch = media.capped_size("w", "h", 512)
    rw, rh = media.short_side_to("w", "h")
    box = media.crop_boxes(rw, rh)
    return p.select("p_partkey", cw.alias("cw"), ch.alias("ch"), rw.alias("rw"), rh.alias("rh"), box[0]["left"].alias("left"), box[0]["top"].alias("top"), box[4]["right"].alias("right"), F.size(box).alias("boxes"))


QUERIES["geometry"] = geometry
SQL["geometry"] = """WITH p AS (SELECT p_partkey, (p_partkey % 1900 + 300)::INT AS w, (p_size * 37 + 290)::INT AS h FROM part),
c AS (SELECT *, CASE WHEN least(w, h) <= 512 THEN 1.0::DOUBLE ELSE 512.0::DOUBLE / least(w, h) END AS k FROM p),
r AS (SELECT *, greatest(1, trunc(w * k)::INT) AS cw, greatest(1, trunc(h * k)::INT) AS ch,
    CASE WHEN w >= h THEN round_even(w * 331.0::DOUBLE / h, 0)::INT ELSE 331 END AS rw, CASE WHEN w >= h THEN 331 ELSE round_even(h * 331.0::DOUBLE / w, 0)::INT END AS rh FROM c)
SELECT p_partkey, cw, ch, rw, rh, ((rw - 288) // 2)::INT AS "left", ((rh - 288) // 2)::INT AS top, rw AS "right", 5 AS boxes FROM r"""

QUERIES["clocks"] = lambda spark, d: frames(spark, d).select("timecode_ms").where("timecode_ms is not null").distinct().select("timecode_ms", media.clock("timecode_ms").alias("clock"))
SQL["clocks"] = f"WITH {FRAMES} SELECT DISTINCT timecode_ms, printf('%d:%02d:%02d', timecode_ms // 3600000, (timecode_ms // 60000) % 60, (timecode_ms // 1000) % 60) AS clock FROM frames WHERE timecode_ms IS NOT NULL"


def coordinates(spark, d):
    c = table(spark, d, "customer")
    side = F.element_at(F.array(*[F.lit(x) for x in "NSEW"]), (F.col("c_custkey") % 4 + 1).cast("int"))
    return c.select("c_custkey", media.dms_degrees((F.col("c_custkey") % 90).cast("double"), (F.col("c_nationkey") * 2).cast("double"), (F.abs(F.col("c_acctbal")) % 60), side).alias("degrees"))


QUERIES["coordinates"] = coordinates
SQL["coordinates"] = """SELECT c_custkey, CASE WHEN c_custkey % 4 IN (1, 3) THEN -x ELSE x END AS degrees FROM (
    SELECT c_custkey, round((c_custkey % 90)::DOUBLE + (c_nationkey * 2)::DOUBLE / 60 + (abs(c_acctbal) % 60) / 3600, 6) AS x FROM customer)"""

QUERIES["model_hashes"] = lambda spark, d: table(spark, d, "supplier").select("s_suppkey", media.remote_model_hash(F.concat("s_name", F.lit("//")), F.lit("m"), F.lit(512)).alias("hash"))
SQL["model_hashes"] = "SELECT s_suppkey, 'config:' || sha256(s_name || 'm' || '512') AS hash FROM supplier"


def shown_numbers(spark, d):
    """Durations, rates and bars of the orders as a run would show them."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("p"))
    seconds = F.floor(F.col("p") / 10)
    return o.select("o_orderkey", media.duration_text(seconds).alias("duration"), media.rate_text(F.lit(1000), seconds % 50, "img").alias("rate"),
                    media.megabyte_rate_text(F.col("p") * 1000, F.lit(60)).alias("throughput"), media.bar(F.col("o_orderkey") % 130).alias("bar"))


QUERIES["shown_numbers"] = shown_numbers
SQL["shown_numbers"] = """WITH o AS (SELECT o_orderkey, o_totalprice AS p, floor(o_totalprice / 10)::BIGINT AS s FROM orders)
SELECT o_orderkey, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN printf('%dm %02ds', s // 60, s % 60) ELSE printf('%dh %02dm %02ds', s // 3600, s // 60 % 60, s % 60) END AS duration,
    CASE WHEN s % 50 > 0 THEN printf('%.1f img/s', round_even(1000 / (s % 50), 1)) ELSE '—' END AS rate, printf('%.1f MB/s', round_even(p * 1000 / 1e6 / 60, 1)) AS throughput,
    repeat('█', round_even(28 * least(o_orderkey % 130, 100)::DOUBLE / 100, 0)::INT) || repeat('░', 28 - round_even(28 * least(o_orderkey % 130, 100)::DOUBLE / 100, 0)::INT) AS bar FROM o"""


def previews(spark, d):
    """Centre squares of pictures as large as the parts' numbers."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 1900 + 20).cast("int").alias("w"), (F.col("p_size") * 37 + 20).cast("int").alias("h"))
    nw, nh, box = media.centre_preview("w", "h", F.lit(224))
    return p.select("p_partkey", nw.alias("nw"), nh.alias("nh"), box["left"].alias("left"), box["bottom"].alias("bottom"), media.effective_cap(F.col("w")).alias("cap"))


QUERIES["previews"] = previews
SQL["previews"] = """WITH p AS (SELECT p_partkey, (p_partkey % 1900 + 20)::INT AS w, (p_size * 37 + 20)::INT AS h FROM part),
r AS (SELECT *, greatest(224, round_even(w * (224.0::DOUBLE / least(w, h)), 0)::INT) AS nw, greatest(224, round_even(h * (224.0::DOUBLE / least(w, h)), 0)::INT) AS nh FROM p)
SELECT p_partkey, nw, nh, ((nw - 224) // 2)::INT AS "left", ((nh - 224) // 2 + 224)::INT AS bottom, greatest(331, w) AS cap FROM r"""
