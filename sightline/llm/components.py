"""Connected groups over pairwise matches (problem 5)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.session import Scratch

# the peel goes on while its frontier doubles or holds that share of all linked vertices; then the rest is
# left to the contraction, into which the peeled part enters as one vertex
PEEL_SHARE = 0.02


def _undirected(edges: DataFrame) -> DataFrame:
    """Each link once, smaller end first, without loops and nulls."""
    return (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _relabelled(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Links between the names of their ends; ends without a name keep themselves."""
    left = names.select(F.col("v").alias("a"), F.col("to").alias("na"))
    right = names.select(F.col("v").alias("b"), F.col("to").alias("nb"))
    return _undirected(
        edges.join(left, "a", "left")
        .join(right, "b", "left")
        .select(F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b"))
    )


def connected_components(edges: DataFrame, scratch: Scratch | None = None, peel_share: float = PEEL_SHARE) -> DataFrame:
    """Label every vertex of ``edges(a bigint, b bigint)`` with one vertex of its component.

    First the component around the highest-degree vertex is peeled: its frontier
    is widened by joins with the links, and every link inside is anti-joined
    away.  It goes on while the frontier at least doubles or holds ``peel_share``
    of all vertices, so there are no more than ``log2(vertices) + 1 / peel_share``
    rounds and a thin chain that hangs on the component costs none.  The remaining components are labelled by minimum propagation on
    contracted graphs: each vertex points at the smallest vertex in its
    neighbourhood, pointers are doubled, and the links are rewritten between the
    pointed-at vertices.  Vertex ids should be hashes, so that a chain of any
    length shrinks by a constant factor a round and the rounds stay logarithmic.

    Only counts and one vertex id reach the driver.  Hubs are safe: minimum and
    degree are partial aggregates, and the relabelling joins have one row per
    key on the label side, so adaptive execution can split a hot key.

    Returns ``(v bigint, label bigint)``; vertices without a link (also loops and
    links with a null end) do not appear; an empty input gives no rows.
    """
    spark = edges.sparkSession
    scratch = scratch or Scratch(spark)
    links = scratch.write(_undirected(edges), "links")
    maps: list[DataFrame] = []

    start = (
        _both_ways(links).groupBy("a").agg(F.count("*").alias("n"))
        .agg(F.max_by("a", F.struct("n", "a")).alias("v"), F.count("*").alias("vertices")).first()
    )
    top, vertices = start["v"], start["vertices"]
    if top is not None:
        frontier = scratch.write(spark.range(1).select(F.lit(top).alias("v")), "frontier")
        parts, done, before = [frontier], False, 1
        while True:
            nearby = _both_ways(links).join(frontier.withColumnRenamed("v", "a"), "a", "left_semi")
            # a frontier's neighbours lie in the frontier, the one before, or beyond
            known = reduce(DataFrame.union, parts[-2:])
            frontier = scratch.write(nearby.select(F.col("b").alias("v")).distinct().join(known, "v", "left_anti"), "frontier")
            reached = frontier.count()
            if not reached:
                done = True
                break
            parts.append(frontier)
            if reached < 2 * before and reached < peel_share * vertices:
                break
            before = reached
        peeled = scratch.write(reduce(DataFrame.union, parts), "peeled")
        named = scratch.write(peeled.select("v", F.lit(top).alias("to")), "named")
        maps.append(named)
        if done:
            # the whole component is peeled: one end inside means both are
            rest = links.join(peeled.withColumnRenamed("v", "a"), "a", "left_anti")
        else:
            rest = _relabelled(links, named)
        links = scratch.write(rest, "rest")

    while not links.isEmpty():
        least = _both_ways(links).groupBy("a").agg(F.min("b").alias("m"))
        to = scratch.write(least.select(F.col("a").alias("v"), F.least("a", "m").alias("to")), "to")
        for _ in range(2):
            nxt = to.select(F.col("v").alias("to"), F.col("to").alias("far"))
            to = to.join(nxt, "to").select("v", F.col("far").alias("to"))
        to = scratch.write(to, "jumped")
        maps.append(to)
        links = scratch.write(_relabelled(links, to), "links")

    # names are composed from the last, smallest round backwards, a small plan each
    label = None
    for to in reversed(maps):
        if label is None:
            label = to.withColumnRenamed("to", "label")
            continue
        # a vertex of a later round is itself a name of this one
        passed = to.join(label.select(F.col("v").alias("to"), "label"), "to", "left")
        passed = passed.select("v", F.coalesce("label", "to").alias("label"))
        label = scratch.write(passed.union(label.join(to.select("v"), "v", "left_anti")), "label")
    if label is None:
        return spark.createDataFrame([], "v long, label long")
    return label


def linked_files(hits: DataFrame, limits: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """Vertices and links of a hit table.

    A row links ``query_path`` and ``path`` if some number in ``scores`` reaches
    its mode's limit (null and NaN are no numbers, other modes have no limit).
    A clean digest is a vertex of its own, linked to every path that carries it:
    equal digests connect without a pair for every two paths.  Null paths name
    no record.  Returns ``files(path, v)`` and ``links(a, b)``.
    """
    from sightline.functions.digests import clean_digest

    good = F.lit(False)
    for mode, limit in limits.items():
        s = F.element_at("scores", F.lit(mode))
        good = good | (s.isNotNull() & ~F.isnan(s) & (s >= F.lit(limit)))
    h = hits.select(
        F.col("query_path").cast("string").alias("query_path"), F.col("path").cast("string").alias("path"), F.coalesce(good, F.lit(False)).alias("good"),
        clean_digest("query_hash", 64).alias("qd"), clean_digest("image_hash", 64).alias("pd"),
    )
    ends = h.select(
        F.explode(F.array(
            F.struct(F.col("query_path").alias("path"), F.col("qd").alias("digest")),
            F.struct(F.col("path").alias("path"), F.col("pd").alias("digest")),
        )).alias("e")
    ).select("e.*").where("path is not null").distinct()
    files, node = _numbered(ends)
    by_score = h.where("good and query_path is not null and path is not null").select(
        node("path", F.col("query_path")).alias("a"), node("path", F.col("path")).alias("b"))
    by_digest = ends.where("digest is not null").select(node("path", F.col("path")).alias("a"), node("digest", F.col("digest")).alias("b"))
    return files, by_score.union(by_digest)


def _numbered(ends: DataFrame) -> tuple[DataFrame, Callable[[str, Column], Column]]:
    """``files(path, v)`` and the vertex number of a path or digest: a 64-bit hash that no two share.

    Numbers are hashes, so no join is needed to give them out.  Two names with
    one hash (of ``n`` names about ``n^2 / 2^65`` pairs: one pair in six billion)
    are looked for, and all but the first of them are hashed again; that list is
    what reaches the driver.
    """
    scratch, again = Scratch(ends.sparkSession), {}
    names = scratch.write(
        ends.select(F.lit("path").alias("kind"), F.col("path").alias("name"))
        .union(ends.where("digest is not null").select(F.lit("digest"), "digest")).distinct(), "names")

    def node(kind: str | Column, name: Column) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        number = _number(kind, name)
        for turn, clashing in again.items():
            number = F.when(F.struct(kind.alias("kind"), name.alias("name")).isin([F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name")) for k, n in clashing]),
                            F.xxhash64(F.lit(turn), kind, name)).otherwise(number)
        return number

    while True:
        called = names.select("kind", "name", node(F.col("kind"), F.col("name")).alias("v"))
        shared = called.groupBy("v").agg(F.count("*").alias("n"), F.min(F.struct("kind", "name")).alias("first")).where("n > 1")
        clashing = called.join(shared, "v").where(F.struct("kind", "name") != F.col("first")).select("kind", "name").collect()
        if not clashing:
            return called.where("kind = 'path'").select(F.col("name").alias("path"), "v"), node
        again[len(again) + 1] = [tuple(r) for r in clashing]


def _number(kind: Column, name: Column) -> Column:
    return F.xxhash64(kind, name)


def match_groups(hits: DataFrame, limits: dict[str, float]) -> DataFrame:
    """One row per grouped file: ``(group_path string, path string)``.

    A group is every file linked directly or indirectly (see ``linked_files``);
    ``group_path`` is its smallest path in byte order; groups of one are left
    out.  Repeated and turned-round rows and self hits change nothing; an empty
    table gives no rows; other columns are ignored.
    """
    files, links = linked_files(hits, limits)
    labelled = files.join(connected_components(links), "v").select("path", "label")
    groups = (
        labelled.groupBy("label").agg(F.min("path").alias("group_path"), F.count("*").alias("n"))
        .where("n > 1").select("label", "group_path")
    )
    return labelled.join(groups, "label").select("group_path", "path")
