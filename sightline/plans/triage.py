"""Queries over labelled examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import triage as op
from sightline.plans.search import DOT
from sightline.plans.views import POINTS, TAGS, points, tags

QUERIES, SQL = {}, {}
LIMIT, FLOOR = 50, 0.2

_PAIRS = """pos AS (SELECT tag_id, unnest(positive_ids) AS pid, generate_subscripts(positive_ids, 1) - 1 AS p FROM tags),
neg AS (SELECT tag_id, unnest(negative_ids) AS nid, generate_subscripts(negative_ids, 1) - 1 AS n FROM tags),
known_pos AS (SELECT tag_id, pid, row_number() OVER (PARTITION BY tag_id ORDER BY p) - 1 AS p FROM pos WHERE pid IN (SELECT point_id FROM points)),
known_neg AS (SELECT tag_id, nid, row_number() OVER (PARTITION BY tag_id ORDER BY n) - 1 AS n FROM neg WHERE nid IN (SELECT point_id FROM points)),
pairs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tag_id ORDER BY p <> n, p, n) AS ord FROM known_pos JOIN known_neg USING (tag_id)) WHERE ord <= 64)"""
_SIMS = f"""refs AS (SELECT DISTINCT pid AS ref_id FROM known_pos UNION SELECT DISTINCT nid FROM known_neg UNION SELECT target_id FROM tags WHERE target_id IS NOT NULL),
sims AS (SELECT r.ref_id, c.point_id AS cand, round({DOT.format(a='q.dino', b='c.dino')}, 9) AS s FROM refs r JOIN points q ON q.point_id = r.ref_id, points c)"""
_SCORED = """best AS (SELECT tag_id, cand, max(s) AS raw FROM known_pos JOIN sims ON ref_id = pid GROUP BY ALL),
won AS (SELECT tag_id, a.cand, sum(CASE WHEN a.s > b.s THEN 1 ELSE 0 END)::BIGINT AS triplet, count(*) AS pairs
    FROM pairs JOIN sims a ON a.ref_id = pid JOIN sims b ON b.ref_id = nid AND a.cand = b.cand GROUP BY ALL),
scored AS (SELECT * FROM best LEFT JOIN won USING (tag_id, cand))"""
_BASE = f"{POINTS}, {TAGS}, {_PAIRS}, {_SIMS}, {_SCORED}"
_OWN = "NOT (list_contains(t.positive_ids, {0}) OR list_contains(t.negative_ids, {0}) OR coalesce(t.target_id = {0}, false))"


def _scored(spark, d, swap: bool = False, best=None):
    t = op.swapped(tags(spark, d)) if swap else tags(spark, d)
    p = points(spark, d)
    return t, op.scored(p, op.targeted(t, "anchor"), p, None, "point_id", "dino", best)


QUERIES["context_pairs"] = lambda spark, d: op.context_pairs(tags(spark, d)).withColumn("ord", F.col("ord").cast("bigint"))
SQL["context_pairs"] = f"""WITH {TAGS}, pos AS (SELECT tag_id, unnest(positive_ids) AS pid, generate_subscripts(positive_ids, 1) - 1 AS p FROM tags),
neg AS (SELECT tag_id, unnest(negative_ids) AS nid, generate_subscripts(negative_ids, 1) - 1 AS n FROM tags)
SELECT tag_id, ord, p::INT AS p, n::INT AS n, pid, nid FROM (SELECT *, row_number() OVER (PARTITION BY tag_id ORDER BY p <> n, p, n) AS ord FROM pos JOIN neg USING (tag_id)) WHERE ord <= 64"""

QUERIES["triplet_scores"] = lambda spark, d: _scored(spark, d)[1].select("tag_id", "cand", "triplet", F.round("raw", 6).alias("raw"), "pairs")
SQL["triplet_scores"] = f"WITH {_BASE} SELECT tag_id, cand, triplet, round(raw, 6) AS raw, pairs FROM scored"


def _triage(swap):
    def query(spark, d):
        t, s = _scored(spark, d, swap, LIMIT)
        t = op.targeted(t, "anchor")
        return op.ranked(op.without_references(s, t), LIMIT).select("tag_id", "cand", "triplet", F.round("raw", 6).alias("raw"), "rnk")

    return query


_RANKED = f"""SELECT tag_id, cand, triplet, round(raw, 6) AS raw, rnk::INT AS rnk FROM (
    SELECT s.tag_id, s.cand, triplet, raw, row_number() OVER (PARTITION BY tag_id ORDER BY coalesce(triplet, 0) DESC, aimed.s DESC NULLS LAST, raw DESC, s.cand) AS rnk
    FROM scored s JOIN tags t USING (tag_id) LEFT JOIN sims aimed ON aimed.ref_id = coalesce(t.target_id, t.positive_ids[1]) AND aimed.cand = s.cand WHERE {_OWN.format("s.cand")} AND (coalesce(triplet, 0) > 0 OR raw > 0)) WHERE rnk <= {LIMIT}"""
QUERIES["triage"] = _triage(False)
SQL["triage"] = f"WITH {_BASE} {_RANKED}"
QUERIES["reverse_triage"] = _triage(True)
SQL["reverse_triage"] = "WITH " + _BASE.replace("tags(tag_id, name, positive_ids, negative_ids,", "tags(tag_id, name, negative_ids, positive_ids,") + " " + _RANKED


def _recommend(floor):
    def query(spark, d):
        t = op.targeted(tags(spark, d).where("size(negative_ids) = 0 or size(positive_ids) = 0"), "positive")
        p = points(spark, d)
        return op.recommended(op.scored(p, t, p, None, "point_id", "dino", LIMIT), t, LIMIT, floor).select("tag_id", "cand", F.round("raw", 6).alias("raw"), "rnk")

    return query


_REC = f"""WITH {_BASE}, best2 AS (SELECT tag_id, cand, max(s) AS raw FROM sims JOIN known_pos ON ref_id = pid JOIN tags USING (tag_id)
    WHERE len(negative_ids) = 0 OR len(positive_ids) = 0 GROUP BY ALL),
r AS (SELECT b.*, row_number() OVER (PARTITION BY tag_id ORDER BY raw DESC, cand) AS rnk FROM best2 b JOIN tags t USING (tag_id) WHERE {_OWN.format("cand")})
SELECT tag_id, cand, round(raw, 6) AS raw, rnk::INT AS rnk FROM r WHERE rnk <= {LIMIT}"""
QUERIES["recommend_best"] = _recommend(None)
SQL["recommend_best"] = _REC
QUERIES["recommend_floor"] = _recommend(FLOOR)
SQL["recommend_floor"] = f"{_REC} AND raw >= {FLOOR}"


def _explore(order):
    def query(spark, d):
        t, s = _scored(spark, d)
        return op.explored(s, t, LIMIT, order).select("tag_id", "cand", "triplet", "rnk")

    return query


for _order, _rank in {"count": "triplet DESC", "boundary": "abs(triplet - pairs / 2)"}.items():
    QUERIES[f"explore_{_order}"] = _explore(_order)
    SQL[f"explore_{_order}"] = f"""WITH {_BASE} SELECT tag_id, cand, triplet, rnk::INT AS rnk FROM (
        SELECT s.*, row_number() OVER (PARTITION BY tag_id ORDER BY {_rank}, raw DESC, cand) AS rnk
        FROM scored s JOIN tags t USING (tag_id) WHERE triplet IS NOT NULL AND {_OWN.format("cand")}) WHERE rnk <= {LIMIT}"""


def explore_random(spark, d):
    """Cold start: a seeded random sample without the labelled points (rows only)."""
    return op.random_sample(points(spark, d), op.reference_ids(tags(spark, d)).select("ref_id").distinct(), "point_id", LIMIT, 7).select("point_id")


QUERIES["explore_random"] = explore_random


def classify_tags(spark, d):
    """Every point against every tag, the target counted as a positive."""
    t = op.targeted(tags(spark, d), "positive")
    p = points(spark, d)
    s = op.scored(p, t, p, None, "point_id", "dino")
    return op.classified(s, t, FLOOR).select("cand", "tag_id", "triplet", F.round("raw", 6).alias("raw"))


QUERIES["classify_tags"] = classify_tags
SQL["classify_tags"] = "WITH " + _BASE.replace(f"{TAGS},", TAGS.replace("tags(", "tags0(") + """, tags AS (SELECT tag_id, name,
    CASE WHEN target_id IS NULL OR list_contains(positive_ids, target_id) THEN positive_ids ELSE list_append(positive_ids, target_id) END AS positive_ids,
    negative_ids, target_id FROM tags0),""") + f""" SELECT cand, tag_id, triplet, round(raw, 6) AS raw FROM scored JOIN tags USING (tag_id)
WHERE NOT (len(negative_ids) > 0 AND pairs IS NULL)
  AND CASE WHEN triplet IS NOT NULL THEN triplet >= greatest(1, floor(least(pairs, 64) * 3 / 4)) ELSE raw >= {FLOOR} END"""


def classified_names(spark, d):
    """Tag names per point, one row each also where nothing matches."""
    hit = classify_tags(spark, d).join(F.broadcast(tags(spark, d).select("tag_id", "name")), "tag_id")
    per = hit.groupBy(F.col("cand").alias("point_id")).agg(F.concat_ws(",", F.sort_array(F.collect_list("name"))).alias("names"))
    return points(spark, d).select("point_id").join(per, "point_id", "left").select("point_id", F.coalesce("names", F.lit("")).alias("names"))


QUERIES["classified_names"] = classified_names
SQL["classified_names"] = f"""SELECT vec_id AS point_id, coalesce(names, '') AS names FROM embeddings LEFT JOIN (
    SELECT cand, string_agg(name, ',' ORDER BY name) AS names FROM ({SQL['classify_tags']}) JOIN (WITH {TAGS} SELECT tag_id, name FROM tags) USING (tag_id) GROUP BY cand) ON cand = vec_id"""


def reference_triage(spark, d):
    """The reference collection holds every id too, with another vector: the case's copy counts wherever there is one."""
    p, t = points(spark, d), op.targeted(tags(spark, d), "anchor")
    case, reference = p.where("not is_reference"), p.withColumn("dino", F.reverse("dino"))
    s = op.scored(case, t, case, reference, "point_id", "dino", LIMIT)
    return op.ranked(op.without_references(s, t), LIMIT).select("tag_id", "cand", "triplet", "pairs", F.round("raw", 6).alias("raw"), "rnk")


QUERIES["reference_triage"] = reference_triage
SQL["reference_triage"] = "WITH " + _BASE.replace("JOIN points q ON q.point_id = r.ref_id, points c", """JOIN (
    SELECT point_id, CASE WHEN is_reference THEN list_reverse(dino) ELSE dino END AS dino FROM points) q ON q.point_id = r.ref_id, (SELECT * FROM points WHERE NOT is_reference) c""") + " " + (
    _RANKED.replace("triplet, raw,", "triplet, pairs, raw,", 1).replace("SELECT tag_id, cand, triplet, round", "SELECT tag_id, cand, triplet, pairs, round"))


def explore_reference(spark, d):
    """Exploring the reference collection: examples that it lacks take no part."""
    p = points(spark, d)
    reference = op.chosen_collection("reference", p.where("not is_reference"), p.where("is_reference"))
    t = op.examples_in(op.targeted(tags(spark, d), "positive"), reference, "point_id")
    return op.explored(op.scored(reference, t, reference, None, "point_id", "dino"), t, LIMIT).select("tag_id", "cand", "triplet", "rnk")


QUERIES["explore_reference"] = explore_reference
SQL["explore_reference"] = "WITH " + _BASE.replace("FROM embeddings)", "FROM embeddings WHERE vec_id % 5 = 0)", 1).replace(f"{TAGS},", TAGS.replace("tags(", "tags0(") + """, tags AS (SELECT tag_id, name,
    CASE WHEN target_id IS NULL OR list_contains(positive_ids, target_id) THEN positive_ids ELSE list_append(positive_ids, target_id) END AS positive_ids,
    negative_ids, target_id FROM tags0),""") + f""" SELECT tag_id, cand, triplet, rnk::INT AS rnk FROM (
        SELECT s.*, row_number() OVER (PARTITION BY tag_id ORDER BY triplet DESC, raw DESC, cand) AS rnk
        FROM scored s JOIN tags t USING (tag_id) WHERE triplet IS NOT NULL AND {_OWN.format("cand")}) WHERE rnk <= {LIMIT}"""
