"""SQL that the queries of this package are compared with, where SQL can say it."""

from __future__ import annotations

# vectors of query_files that are usable, and all their pairs: brute force
_VECTORS = """
        each_field AS (
            SELECT 'dino' AS field, entry_id, dino_embedding::DOUBLE[] AS v FROM query_files
            UNION ALL SELECT 'sscd', entry_id, sscd_embedding::DOUBLE[] FROM query_files),
        vectors AS (
            SELECT * FROM each_field WHERE len(v) = 128 AND len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = 128
                AND len(list_filter(v, lambda x: x <> 0)) > 0),
        pairs AS (
            SELECT a.field, a.entry_id AS a, b.entry_id AS b, list_cosine_similarity(a.v, b.v) AS cosine
            FROM vectors a JOIN vectors b ON a.field = b.field AND a.entry_id <> b.entry_id),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY field, a ORDER BY round(cosine, 6) DESC, b) AS rn FROM pairs)"""



def _digest(column: str, digits: int) -> str:
    bare = f"regexp_replace(lower(regexp_replace({column}, '^\\s+|\\s+$', '', 'g')), '^(sha-?256\\s*[:=]\\s*|md5\\s*[:=]\\s*|0x)', '')"
    return f"CASE WHEN regexp_full_match({bare}, '[0-9a-f]{{{digits}}}') AND {bare} <> repeat(left({bare}, 1), {digits}) THEN {bare} END"


# one notation for digests and paths, all earlier records that a record would repeat if they are accepted, and then the
# rule by rounds: a record is accepted (1) once all of those are known to repeat others, and repeats one (2) once any is accepted
_REPEATS = f"""WITH RECURSIVE bare AS (
    SELECT record_id AS id, coalesce(batch_no, 2147483647) AS batch, {_digest('sha256', 64)} AS sha, {_digest('md5', 32)} AS md5, regexp_replace(path, '^\\s+|\\s+$', '', 'g') AS b FROM file_records WHERE record_id IS NOT NULL),
local AS (SELECT *, translate(CASE WHEN regexp_matches(b, '^(?i:file):') THEN url_decode(replace(regexp_replace(b, '^(?i:file):(//(?i:localhost)?(/)|)', '\\2'), '+', '%2B')) ELSE b END, chr(92), '/') AS p FROM bare),
steps AS (SELECT *, list_reduce(list_transform(list_filter(string_split(p, '/'), lambda x: x <> '' AND x <> '.'), lambda x: [x]),
    lambda acc, x: CASE WHEN x[1] = '..' THEN acc[1:len(acc) - 1] ELSE list_concat(acc, x) END, []::VARCHAR[]) AS walked FROM local),
rec AS (SELECT id, row_number() OVER (ORDER BY batch, id) AS n, sha, md5, CASE WHEN b <> '' THEN nfc_normalize(CASE WHEN starts_with(p, '/') THEN '/' ELSE '' END || array_to_string(walked, '/')) END AS loc FROM steps),
near AS (
    SELECT a.n AS a, r.n AS r FROM rec a JOIN rec r ON a.sha = r.sha AND a.n < r.n
    UNION SELECT a.n, r.n FROM rec a JOIN rec r ON a.md5 = r.md5 AND a.n < r.n AND (a.sha IS NULL OR r.sha IS NULL)
    UNION SELECT a.n, r.n FROM rec a JOIN rec r ON a.loc = r.loc AND a.n < r.n AND coalesce(a.sha = r.sha, true) AND coalesce(a.md5 = r.md5, true)),
go(n, state) USING KEY (n) AS (
    SELECT n, 0 FROM rec
    UNION
    SELECT g.n, CASE WHEN bool_or(coalesce(h.state = 1, false)) THEN 2 ELSE 1 END
    FROM recurring.go g LEFT JOIN near ON near.r = g.n LEFT JOIN recurring.go h ON h.n = near.a
    WHERE g.state = 0 GROUP BY g.n HAVING bool_or(coalesce(h.state = 1, false)) OR bool_and(coalesce(h.state = 2, true)))
SELECT min_by(f.id, f.n) AS first_id, r.id AS again_id
FROM go JOIN near ON near.r = go.n JOIN go s ON s.n = near.a AND s.state = 1 JOIN rec f ON f.n = near.a JOIN rec r ON r.n = go.n WHERE go.state = 2 GROUP BY r.id"""

SQL: dict[str, str] = {
    "p1_found": f"""
        WITH {_VECTORS},
        around AS (
            SELECT a, list_sort(list_append(list(b), a)) AS members FROM pairs
            WHERE field = 'dino' AND cosine >= 0.65 GROUP BY a),
        alike AS (SELECT members FROM around GROUP BY members HAVING count(*) = len(members) AND len(members) >= 3)
        SELECT members[1] AS cluster_id, unnest(members) AS entry_id FROM alike""",
    "p3_found": f"""
        WITH {_VECTORS}
        SELECT DISTINCT field, least(a, b) AS entry_a, greatest(a, b) AS entry_b FROM ranked
        WHERE rn <= 5 AND cosine >= CASE field WHEN 'dino' THEN 0.65 ELSE 0.75 END""",
    "p3_neighbours": f"""
        WITH {_VECTORS}
        SELECT field, a AS entry, b AS neighbour, round(cosine, 4) AS cosine FROM ranked WHERE rn <= 5 AND a % 100 = 0""",
    "p2_found": """
        WITH scored AS (
            SELECT lower(regexp_replace(video_hash, '^\\s+|\\s+$', '', 'g')) AS video_hash, match_id,
                   coalesce(timecode_ms, 0) AS tc,
                   list_max(list_filter(map_values(scores), lambda x: x IS NOT NULL AND NOT isnan(x))) AS score
            FROM matched_frames),
        once AS (
            SELECT DISTINCT video_hash, match_id, tc, score FROM scored
            WHERE score IS NOT NULL AND video_hash <> ''),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY video_hash ORDER BY score DESC, tc, match_id) AS rn FROM once)
        SELECT video_hash, match_id FROM ranked WHERE rn <= 3""",
    "p4_found": _REPEATS,
    "p5_found": """
        WITH RECURSIVE rows AS (
            SELECT query_path, path, regexp_replace(lower(trim(query_hash, E' \\t\\n\\r')), '^(sha-?256\\s*[:=]\\s*|0x)', '') AS qd,
                   regexp_replace(lower(trim(image_hash, E' \\t\\n\\r')), '^(sha-?256\\s*[:=]\\s*|0x)', '') AS pd,
                   len(list_filter(map_entries(scores), lambda e: e.value IS NOT NULL AND NOT isnan(e.value)
                       AND e.value >= CASE e.key WHEN 'exact' THEN 1.0 WHEN 'altered' THEN 0.75 WHEN 'semantic' THEN 0.55 ELSE 'infinity'::DOUBLE END)) > 0 AS good
            FROM hits),
        ends AS (
            SELECT DISTINCT path, CASE WHEN regexp_full_match(d, '[0-9a-f]{64}') AND d <> repeat(d[1], 64) THEN d END AS d
            FROM (SELECT query_path AS path, qd AS d FROM rows UNION ALL SELECT path, pd FROM rows) WHERE path IS NOT NULL),
        links AS (
            SELECT query_path AS a, path AS b FROM rows WHERE good AND query_path <> path
            UNION SELECT e.path, f.path FROM ends e JOIN (SELECT d, min(path) AS path FROM ends WHERE d IS NOT NULL GROUP BY d) f ON e.d = f.d AND e.path <> f.path),
        both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
        SELECT min(least(a, b)) AS group_path, a AS path FROM reach GROUP BY a""",
}
