"""Detection frames: nested rows of parallel arrays, and the flat archive rows made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEASURES = ("delay", "doppler", "snr")


def flatten(frames: DataFrame, keys: list[str], extra: list[str] | None = None) -> DataFrame:
    """A row for each detection: as many as the longest of the measures has; shorter arrays give null. ``extra`` arrays don't add rows."""
    arrays = [*MEASURES, *(extra or [])]
    count = F.greatest(*[F.coalesce(F.size(F.coalesce(m, F.array())), F.lit(0)) for m in MEASURES])
    rows = frames.withColumn("_n", count).select(*keys, "_n", F.posexplode(F.arrays_zip(*[F.coalesce(F.col(a), F.array()).alias(a) for a in arrays])).alias("detection_index", "_d"))
    return rows.where("detection_index < _n").select(*keys, "detection_index", *[F.col("_d")[a].alias(a) for a in arrays])


def zip_shortest(frames: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each detection that has all the measures."""
    count = F.least(*[F.size(F.coalesce(m, F.array())) for m in MEASURES])
    rows = frames.withColumn("_n", count).select(*keys, "_n", F.posexplode(F.arrays_zip(*MEASURES)).alias("detection_index", "_d"))
    return rows.where("detection_index < _n").select(*keys, "detection_index", *[F.col("_d")[m].alias(m) for m in MEASURES])


def regroup(detections: DataFrame, keys: list[str], index: str, measures: list[str]) -> DataFrame:
    """Frames again: each measure as an array in the order of ``index``. A frame has at most 512 detections by its wire format."""
    rows = detections.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(index, *measures))).alias("_r"))
    return rows.select(*keys, *[F.col("_r")[m].alias(m) for m in measures])
