"""Compatibility of stored embeddings with the current configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROVENANCE = ("model_hash", "normalize_size", "n_crops")


def stored_configurations(points: DataFrame, vector: str, columns: list[str]) -> DataFrame:
    """Distinct configurations of the points that have the vector, all-null ones left out."""
    known = points.where(F.col(vector).isNotNull()).select(*columns).distinct()
    some = F.lit(False)
    for c in columns:
        some = some | F.col(c).isNotNull()
    return known.where(some)


def shown(value) -> str:
    return "<absent>" if value is None else str(value)


def compatibility_errors(stored: list[tuple], current: dict[str, object], columns: list[str], vector: str) -> list[str]:
    """Messages for a mixed collection or a mismatch; an absent stored value is unknown, not wrong.

    ``normalize_size`` matters for the semantic vector only, ``n_crops`` for the
    copy-detection vector only.
    """
    matters = [c for c in columns if not (c.endswith("normalize_size") and vector != "dino") and not (c.endswith("n_crops") and vector != "sscd")]
    if len(stored) > 1:
        rows = sorted(stored, key=lambda t: tuple((x is not None, str(x)) for x in t))
        listed = "; ".join("(" + ", ".join(f"{c}={shown(x)}" for c, x in zip(columns, t)) + ")" for t in rows)
        return [f"{vector}: collection mixes configurations: {listed}"]
    errors = []
    for row in stored:
        have = dict(zip(columns, row))
        for c in matters:
            if have[c] is not None and current.get(c) is not None and have[c] != current[c]:
                errors.append(f"{vector}: {c} stored {shown(have[c])}, current {shown(current[c])}")
    return errors


def check_collection(points: DataFrame, current: dict[str, dict[str, object]], strict: bool = True) -> list[str]:
    """Compare every vector's stored configurations with ``current[vector][column]``.

    Two distinct configurations prove a mixture, so no more than that reach the
    driver.  ``strict`` raises on mismatch, otherwise messages are returned.
    """
    errors: list[str] = []
    for vector, config in current.items():
        if vector not in points.columns:
            continue
        columns = [c for c in config if c in points.columns]
        if columns:
            stored = [tuple(r) for r in stored_configurations(points, vector, columns).limit(2).collect()]
            errors += compatibility_errors(stored, config, columns, vector)
    if errors and strict:
        raise ValueError("\n".join(errors))
    return errors


def check_reference(collection: str, reference: str | None, into_reference: bool) -> str:
    """Target collection of an ingest; a reference must be set and differ from the case."""
    if not into_reference:
        return collection
    if not reference:
        raise ValueError("no reference collection is configured")
    if reference == collection:
        raise ValueError("reference and case collection must differ")
    return reference
