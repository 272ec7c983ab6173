"""Reports: counts of what was found, and what was masked by what."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary(detections: DataFrame, by: tuple[str, ...] = ("entity_type",)) -> DataFrame:
    """Number of detections, texts and different values for each group."""
    return detections.groupBy(*by).agg(
        F.count("*").alias("n_detections"), F.count_distinct("doc_id").alias("n_texts"), F.count_distinct("original").alias("n_values")
    )


def rollup(detections: DataFrame, by: tuple[str, ...] = ("source", "entity_type")) -> DataFrame:
    """Detections by all beginnings of the list of groups; null stands for all."""
    return detections.rollup(*by).agg(F.count("*").alias("n_detections"))


def occurrences(text: Column, value: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, value, F.lit("")))) / F.length(value)).cast("int")


def mask_report(text: Column, entries: Column) -> Column:
    """Structs ``value, placeholder, n, first`` of masked values by first place, less values inside longer ones."""
    pairs = F.array_distinct(F.transform(entries, lambda e: F.struct(e["original"].alias("value"), e["placeholder"].alias("placeholder"))))
    whole = F.filter(pairs, lambda p: ~F.exists(pairs, lambda o: (o["value"] != p["value"]) & (o["placeholder"] == p["placeholder"]) & F.contains(o["value"], p["value"])))
    rows = F.transform(whole, lambda p: F.struct((F.position(p["value"], text) - 1).alias("first"), p["value"], p["placeholder"], occurrences(text, p["value"]).alias("n")))
    return F.array_sort(rows)
