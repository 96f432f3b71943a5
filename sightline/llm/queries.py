"""The registered queries of this package; each reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import batch_dedup, clusters, components, knn, mixing, packing, topn, truncation

# fixed values of TESTDATA.md
DINO_FLOOR, SSCD_FLOOR = 0.65, 0.75
HIT_LIMITS = {"exact": 1.0, "altered": 0.75, "semantic": 0.55}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.similar_clusters(_read(spark, sf_dir, "query_files"), "entry_id", "dino_embedding", DINO_FLOOR)[0]


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.described_clusters(_read(spark, sf_dir, "query_files"), "entry_id", "dino_embedding", DINO_FLOOR)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.best_frames(_read(spark, sf_dir, "matched_frames")).select("video_hash", "match_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.similar_pairs(
        _read(spark, sf_dir, "query_files"), "entry_id",
        {"dino_embedding": DINO_FLOOR, "sscd_embedding": SSCD_FLOOR}, {"dino_embedding": "dino", "sscd_embedding": "sscd"},
    )


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar others of every entry whose id is divisible by 100, without a least cosine."""
    files = _read(spark, sf_dir, "query_files")
    asked = files.where(F.col("entry_id") % 100 == 0)
    fields = {"dino": "dino_embedding", "sscd": "sscd_embedding"}
    found = [knn.nearest_to(asked, files, "entry_id", c).select(F.lit(f).alias("field"), "entry", "neighbour", F.round("cosine", 4).alias("cosine")) for f, c in fields.items()]
    return found[0].union(found[1])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_dedup.repeated_records(_read(spark, sf_dir, "file_records"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.match_groups(_read(spark, sf_dir, "hits"), HIT_LIMITS)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.oversized_documents(_read(spark, sf_dir, "documents"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(packing.pack_documents(_read(spark, sf_dir, "documents")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the sources whose passes ran out in the mix, each held against the exact token counts
    return _mixed(spark, sf_dir)[1].where("ran_out").where("short").select("source")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated_documents(_read(spark, sf_dir, "documents"))


def p8_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_by_source(_read(spark, sf_dir, "documents"))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "mix_targets"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}
