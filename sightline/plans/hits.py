"""Queries that group, merge and rank hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions.media import best_score
from sightline.operators import hits as op
from sightline.operators import session_search
from sightline.plans.search import DOT
from sightline.plans.views import FRAMES, LIBRARY, frames, library, score_map, session, table

QUERIES, SQL = {}, {}


def _frame_hits(spark, d):
    f = frames(spark, d).where("entry_id is not null and video_hash is not null")
    return f.select("entry_id", F.col("video_hash").alias("video_path"), F.col("frame_hash").alias("path"), F.col("frame_hash").alias("image_hash"),
                    F.col("timecode_ms").alias("frame_timecode_ms"), score_map().alias("scores"), "is_reference", F.col("match_id").alias("ord"))


def grouped_video_hits(spark, d):
    g = op.group_video_hits(_frame_hits(spark, d), ["entry_id"])
    return g.select("entry_id", "video_path", "image_hash", "frame_timecode_ms", "frames", "is_reference",
                    *[F.element_at("scores", F.lit(m)).alias(m) for m in ("exact", "altered", "semantic")])


QUERIES["grouped_video_hits"] = grouped_video_hits
SQL["grouped_video_hits"] = f"""WITH {FRAMES}, f AS (
    SELECT *, coalesce(greatest(exact, altered, semantic), 0) AS best FROM frames WHERE entry_id IS NOT NULL AND video_hash IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY entry_id, video_hash ORDER BY best DESC, match_id) AS rn FROM f)
SELECT entry_id, video_hash AS video_path, max(frame_hash) FILTER (rn = 1) AS image_hash, max(timecode_ms) FILTER (rn = 1) AS frame_timecode_ms,
    count(*) AS frames, bool_or(coalesce(is_reference, false)) AS is_reference, max(exact) AS exact, max(altered) AS altered, max(semantic) AS semantic
FROM r GROUP BY ALL"""


def _hit_rows(spark, d):
    h = table(spark, d, "hits").select(
        "path", F.when(F.length("image_hash") == 64, F.col("image_hash")).alias("image_hash"), F.element_at("query_timecodes", 1).alias("query_timecode_ms"),
        F.coalesce("scores", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))).alias("scores"), "is_reference", F.col("hit_id").alias("ord"))
    clean = F.map_filter("scores", lambda _, v: v.isNotNull() & ~F.isnan(v))
    return h.withColumn("scores", clean)


_HITS = """h AS (SELECT hit_id, path, CASE WHEN length(image_hash) = 64 THEN image_hash END AS image_hash, query_timecodes[1] AS tc, is_reference,
    CASE WHEN NOT isnan(scores['exact']) THEN scores['exact'] END AS exact, CASE WHEN NOT isnan(scores['altered']) THEN scores['altered'] END AS altered,
    CASE WHEN NOT isnan(scores['semantic']) THEN scores['semantic'] END AS semantic FROM hits),
b AS (SELECT *, coalesce(greatest(exact, altered, semantic), 0) AS best FROM h)"""


def merged_hits(spark, d):
    rows = _hit_rows(spark, d).withColumn("key", op.unify_key("path"))
    m = op.merge_hits(rows, ["key"])
    return m.select("key", "path", "image_hash", F.size("query_timecodes").cast("bigint").alias("timecodes"), "best_query_timecode_ms", "is_reference",
                    *[F.element_at("scores", F.lit(x)).alias(x) for x in ("exact", "altered", "semantic")])


QUERIES["merged_hits"] = merged_hits
SQL["merged_hits"] = f"""WITH {_HITS}
SELECT CASE WHEN coalesce(is_reference, false) THEN 'ref' ELSE 'case' END || ':' || path AS key, arg_min(path, hit_id) AS path,
    arg_min(image_hash, hit_id) FILTER (image_hash IS NOT NULL) AS image_hash, count(DISTINCT tc) AS timecodes,
    arg_max(tc, (best, -hit_id)) FILTER (tc IS NOT NULL) AS best_query_timecode_ms, bool_or(coalesce(is_reference, false)) AS is_reference,
    max(exact) AS exact, max(altered) AS altered, max(semantic) AS semantic FROM b GROUP BY 1"""


def merged_frames(spark, d):
    """Frames of every video, over all upload entries that matched it."""
    rows = _frame_hits(spark, d).withColumn("hit_key", op.unify_key("video_path")).withColumnsRenamed({"frame_timecode_ms": "timecode_ms", "image_hash": "frame_hash"})
    return op.merge_frames(rows, ["hit_key"]).select("hit_key", "timecode_ms", "frame_hash", *[F.element_at("scores", F.lit(m)).alias(m) for m in ("exact", "altered", "semantic")])


QUERIES["merged_frames"] = merged_frames
SQL["merged_frames"] = f"""WITH {FRAMES}
SELECT CASE WHEN coalesce(is_reference, false) THEN 'ref' ELSE 'case' END || ':' || video_hash AS hit_key, coalesce(timecode_ms, 0) AS timecode_ms,
    coalesce(arg_min(coalesce(frame_hash, ''), match_id), '') AS frame_hash, max(exact) AS exact, max(altered) AS altered, max(semantic) AS semantic
FROM frames WHERE entry_id IS NOT NULL AND video_hash IS NOT NULL GROUP BY 1, 2"""


def unified_ranking(spark, d):
    h = _hit_rows(spark, d)
    rows = h.join(table(spark, d, "hits").select(F.col("hit_id").alias("ord"), "query_path"), "ord")
    m = op.merge_hits(rows.withColumn("k", op.unify_key("path")), ["query_path", "k"])
    return op.rank_unified(m, ["query_path"], 10).select("query_path", "path", "is_reference", "rnk")


QUERIES["unified_ranking"] = unified_ranking
SQL["unified_ranking"] = f"""WITH {_HITS}, m AS (
    SELECT query_path, path, coalesce(is_reference, false) AS is_reference, max(exact) AS exact, coalesce(greatest(max(altered), max(semantic)), 0) AS other
    FROM b JOIN (SELECT hit_id, query_path FROM hits) USING (hit_id) GROUP BY ALL)
SELECT query_path, path, is_reference, rnk::INT AS rnk FROM (SELECT *, row_number() OVER (PARTITION BY query_path
    ORDER BY CASE WHEN exact IS NULL THEN 1 ELSE 0 END, other DESC, path, is_reference) AS rnk FROM m) WHERE rnk <= 10"""


def unmerged_ranking(spark, d):
    rows = table(spark, d, "hits").select("query_path", "path", F.col("hit_id").alias("ord"), F.explode("scores").alias("mode", "score")).where("score is not null and not isnan(score)")
    return op.rank_unmerged(rows, ["query_path"]).select("query_path", "path", "ord", "mode", "score", "rnk")


QUERIES["unmerged_ranking"] = unmerged_ranking
SQL["unmerged_ranking"] = """WITH e AS (SELECT query_path, path, hit_id AS ord, unnest(map_entries(scores)) AS kv FROM hits),
r AS (SELECT query_path, path, ord, kv.key AS mode, kv.value AS score FROM e WHERE kv.value IS NOT NULL AND NOT isnan(kv.value))
SELECT *, (row_number() OVER (PARTITION BY query_path ORDER BY CASE mode WHEN 'exact' THEN 0 WHEN 'altered' THEN 1 WHEN 'semantic' THEN 2 ELSE 99 END,
    score DESC, path, ord))::INT AS rnk FROM r"""

QUERIES["best_scores"] = lambda spark, d: table(spark, d, "hits").select("hit_id", F.coalesce(best_score("scores"), F.lit(0.0)).alias("best"))
SQL["best_scores"] = "SELECT hit_id, coalesce(list_max(list_filter(map_values(scores), lambda x: x IS NOT NULL AND NOT isnan(x))), 0) AS best FROM hits"


def _session(unify: bool):
    def query(spark, d):
        files, vectors = session(spark, d)
        return session_search.run(files, vectors, library(spark, d), unify=unify, include_reference=True)

    return query


def session_search_unified(spark, d):
    found = _session(True)(spark, d)
    model = lambda m: F.col("provenance")[m]
    return found.select("file_id", "hit_key", "is_reference", "rnk", "path", "image_hash", "exif", "exif_geo_data", "video_hash", "frame_timecode_ms",
                        *[model(m)["name"].alias(f"{m}_model") for m in ("altered", "semantic")], model("semantic")["hash"].alias("semantic_hash"), *[F.round(F.element_at("scores", F.lit(m)), 6).alias(m) for m in ("exact", "altered", "semantic")])


_SEARCHED = f"""{LIBRARY}, q AS (SELECT entry_id AS file_id, l.*, q0.is_video, q0.error, q0.file_hash FROM query_files q0 JOIN library l ON l.point_id = entry_id WHERE entry_id % 100 = 0),
s AS (SELECT q.file_id, p.point_id, p.is_reference, 'altered' AS mode, {DOT.format(a='q.sscd', b='p.sscd')} AS score FROM q, library p WHERE q.sscd IS NOT NULL AND p.sscd IS NOT NULL AND q.error IS NULL
    UNION ALL SELECT q.file_id, p.point_id, p.is_reference, 'semantic', {DOT.format(a='q.dino', b='p.dino')} FROM q, library p WHERE q.dino IS NOT NULL AND p.dino IS NOT NULL AND q.error IS NULL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id, mode, is_reference ORDER BY round(score, 9) DESC, point_id) AS r FROM s
    WHERE score >= CASE mode WHEN 'altered' THEN 0.75 ELSE 0.55 END) WHERE r <= 10),
raw AS (SELECT top.file_id, top.mode, score, top.is_reference, path, coalesce(video_path, path) AS base, point_id, CASE WHEN top.mode = 'altered' THEN 0 ELSE 1000000 END + r AS place
    FROM top JOIN (SELECT point_id, path, video_path FROM library) USING (point_id)),
exact_files AS (SELECT file_id, path AS base, path, pid FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY path) AS r FROM (
        SELECT q.file_id, p.path, min(p.point_id) AS pid FROM q JOIN library p ON p.image_hash = q.file_hash
        WHERE NOT q.is_video AND NOT p.is_reference AND q.error IS NULL GROUP BY ALL)) WHERE r <= 50
    UNION ALL SELECT q.file_id, p.video_path, arg_min(p.path, (p.frame_timecode_ms, p.image_hash, p.path)), arg_min(p.point_id, (p.frame_timecode_ms, p.image_hash, p.path))
        FROM q JOIN library p ON p.video_hash = q.file_hash WHERE q.is_video AND NOT p.is_reference AND q.error IS NULL GROUP BY ALL),
exact AS (SELECT file_id, base FROM exact_files)"""
QUERIES["session_search"] = session_search_unified
# a path's rows, then a video's or path's representative, then the model of the first row with a mode's best score
SQL["session_search"] = f"""WITH {_SEARCHED}, g AS (
    SELECT file_id, base, is_reference, path, round(max(score), 9) AS best, min(place) AS place, arg_min(point_id, place) AS pid,
        max(score) FILTER (mode = 'altered') AS altered, max(score) FILTER (mode = 'semantic') AS semantic,
        arg_max(point_id, (round(score, 9), -place)) FILTER (mode = 'altered') AS pa, arg_max(point_id, (round(score, 9), -place)) FILTER (mode = 'semantic') AS ps FROM raw GROUP BY ALL),
f AS (SELECT file_id, base, is_reference, arg_max(pid, (best, -place)) AS pid, max(altered) AS altered, max(semantic) AS semantic,
        arg_max(pa, (round(altered, 9), -place)) FILTER (altered IS NOT NULL) AS pa, arg_max(ps, (round(semantic, 9), -place)) FILTER (semantic IS NOT NULL) AS ps FROM g GROUP BY ALL),
e AS (SELECT file_id, base, false AS is_reference, path, pid FROM exact_files),
m AS (SELECT file_id, base, is_reference, CASE WHEN e.pid IS NOT NULL THEN 1.0::DOUBLE END AS exact, altered, semantic, coalesce(e.path, l.path) AS path,
        coalesce(e.pid, f.pid) AS pid, e.pid IS NOT NULL AND q.is_video AS whole_video, pa, ps
    FROM f FULL JOIN e USING (file_id, base, is_reference) LEFT JOIN library l ON l.point_id = f.pid JOIN q USING (file_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY CASE WHEN exact IS NULL THEN 1 ELSE 0 END, coalesce(greatest(altered, semantic), 0) DESC, path, is_reference) AS rnk FROM m)
SELECT r.file_id, CASE WHEN r.is_reference THEN 'ref' ELSE 'case' END || ':' || r.base AS hit_key, r.is_reference, rnk::INT AS rnk, r.path, l.image_hash,
    CASE WHEN NOT whole_video THEN l.exif END AS exif, CASE WHEN NOT whole_video THEN l.exif_geo_data END AS exif_geo_data, l.video_hash, l.frame_timecode_ms,
    CASE WHEN altered IS NOT NULL THEN coalesce(a.sscd_model_name, '') END AS altered_model, CASE WHEN semantic IS NOT NULL THEN coalesce(s.dino_model_name, '') END AS semantic_model,
    CASE WHEN semantic IS NOT NULL THEN s.dino_model_hash END AS semantic_hash, round(exact, 6) AS exact, round(altered, 6) AS altered, round(semantic, 6) AS semantic
FROM r JOIN q USING (file_id) JOIN library l ON l.point_id = r.pid LEFT JOIN library a ON a.point_id = pa LEFT JOIN library s ON s.point_id = ps WHERE q.is_video OR rnk <= 10"""


def session_search_by_mode(spark, d):
    found = _session(False)(spark, d)
    return found.select("file_id", F.coalesce("video_path", "path").alias("base"), "is_reference", "mode", F.round("score", 6).alias("score"))


QUERIES["session_search_by_mode"] = session_search_by_mode
SQL["session_search_by_mode"] = f"""WITH {_SEARCHED}
SELECT file_id, base, false AS is_reference, 'exact' AS mode, 1.0::DOUBLE AS score FROM exact
UNION ALL SELECT file_id, base, is_reference, mode, round(max(score), 6) FROM raw JOIN (SELECT point_id, video_path FROM library) USING (point_id) WHERE video_path IS NOT NULL GROUP BY file_id, base, is_reference, mode
UNION ALL SELECT file_id, base, is_reference, mode, round(score, 6) FROM raw JOIN (SELECT point_id, video_path FROM library) USING (point_id) WHERE video_path IS NULL"""


def session_frames(spark, d):
    files, vectors = session(spark, d)
    found = session_search.matched_frames(files, vectors, library(spark, d), include_reference=True)
    return found.select("file_id", "hit_key", "timecode_ms", "frame_hash", *[F.round(F.element_at("scores", F.lit(m)), 6).alias(m) for m in ("exact", "altered", "semantic")])


_FRAME_ROWS = """fr AS (
    SELECT DISTINCT q.file_id, false AS is_reference, p.video_path, p.frame_timecode_ms AS timecode_ms, coalesce(p.image_hash, '') AS frame_hash, 'exact' AS mode, 1.0::DOUBLE AS score
    FROM q JOIN library p ON p.video_hash = q.file_hash WHERE q.is_video AND NOT p.is_reference AND q.error IS NULL AND coalesce(p.video_path, '') <> ''
    UNION ALL SELECT raw.file_id, raw.is_reference, l.video_path, l.frame_timecode_ms, coalesce(l.image_hash, ''), raw.mode, raw.score
    FROM raw JOIN library l USING (point_id) WHERE coalesce(l.video_path, '') <> '')"""
QUERIES["session_frames"] = session_frames
SQL["session_frames"] = f"""WITH {_SEARCHED}, {_FRAME_ROWS}, k AS (
    SELECT *, CASE WHEN is_reference THEN 'ref' ELSE 'case' END || ':' || video_path AS hit_key FROM fr)
SELECT file_id, hit_key, timecode_ms, min(frame_hash) AS frame_hash, round(max(score) FILTER (mode = 'exact'), 6) AS exact,
    round(max(score) FILTER (mode = 'altered'), 6) AS altered, round(max(score) FILTER (mode = 'semantic'), 6) AS semantic
FROM k JOIN (SELECT file_id, hit_key FROM ({SQL["session_search"]})) USING (file_id, hit_key) GROUP BY ALL"""


def session_frames_by_mode(spark, d):
    files, vectors = session(spark, d)
    found = session_search.matched_frames(files, vectors, library(spark, d), unify=False, include_reference=True)
    return found.drop("query_timecode_ms").withColumn("score", F.round("score", 6))


QUERIES["session_frames_by_mode"] = session_frames_by_mode
SQL["session_frames_by_mode"] = f"""WITH {_SEARCHED}, {_FRAME_ROWS}
SELECT file_id, mode, is_reference, video_path, timecode_ms, frame_hash, round(score, 6) AS score FROM fr"""
