"""Representatives: every item mapped to the least item with the same fingerprint.

The least id by aggregation and a join back, not a window: partial aggregation combines a
hot fingerprint before it shuffles, and the join's skewed side can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import keep


def fingerprint(text: Column) -> Column:
    """Exact content hash."""
    return F.sha2(text, 256)


def fingerprints(items: DataFrame, id_col: str, text_col: str, *cols: str) -> DataFrame:
    """(id, sg_print, cols): hashed once into a narrow table, which all later steps read."""
    return keep(items.select(id_col, *cols, fingerprint(F.col(text_col)).alias("sg_print")), "fingerprints")


def mapping(items: DataFrame, id_col: str, key: Column, detect: bool = True) -> DataFrame:
    """``items`` with (unique_id, is_duplicate); a null fingerprint is its own representative.

    A null id represents nothing: such an item is a duplicate of the least id, if there is one.
    The key is computed for items as they are; where it is costly and ``items`` wide, map a
    narrow table of ids and keys (``fingerprints``) instead.  Without detection every item represents itself.
    """
    if not detect:
        return items.withColumns({"unique_id": F.col(id_col), "is_duplicate": F.lit(False)})
    keyed = items.withColumn("sg_key", key)
    least = keyed.where("sg_key is not null").groupBy("sg_key").agg(F.min(id_col).alias("unique_id"))
    out = keyed.join(least, "sg_key", "left").withColumn("unique_id", F.coalesce("unique_id", F.col(id_col)))
    return out.withColumn("is_duplicate", ~F.col("unique_id").eqNullSafe(F.col(id_col))).drop("sg_key")


def duplicates_only(mapped: DataFrame, id_col: str) -> DataFrame:
    return mapped.where("is_duplicate").select(F.col(id_col), "unique_id")


def groups(mapped: DataFrame, id_col: str) -> DataFrame:
    """(unique_id, member_id, n_members) of groups with several members, a row a member."""
    size = mapped.groupBy("unique_id").agg(F.count("*").alias("n_members")).where("n_members > 1")
    return mapped.join(size, "unique_id").select("unique_id", F.col(id_col).alias("member_id"), "n_members")


def stats(mapped: DataFrame, *by: str) -> DataFrame:
    """Total, unique, duplicates and their percentage, 0 for no items."""
    sums = mapped.groupBy(*by).agg(F.count("*").alias("total"), F.coalesce(F.sum(F.col("is_duplicate").cast("long")), F.lit(0)).alias("duplicates"))
    percent = F.coalesce(F.try_divide(F.col("duplicates") * 100.0, F.col("total")), F.lit(0.0))
    return sums.select(*by, "total", (F.col("total") - F.col("duplicates")).alias("unique_items"), "duplicates", percent.alias("duplicate_percentage"))


def plan(mapped: DataFrame, id_col: str, name: Column) -> DataFrame:
    """The processing plan: each item's representative and output name."""
    return mapped.select(F.col(id_col), "unique_id", name.alias("output_name"), "is_duplicate")


def work_list(mapped: DataFrame) -> DataFrame:
    """The items to process: representatives only."""
    return mapped.where(~F.col("is_duplicate"))


def manifest(mapped: DataFrame, id_col: str, name: Column) -> DataFrame:
    """One JSON line for each item of the plan; write it with ``.write.text``."""
    row = F.struct(F.col(id_col).alias("id"), F.col("unique_id"), name.alias("output_path"), F.col("is_duplicate"))
    return mapped.select(F.col(id_col), F.to_json(row).alias("manifest"))


def write_manifest(mapped: DataFrame, id_col: str, name: Column, path: str) -> None:
    """The plan as JSON lines, a file a task; what was there before is replaced."""
    manifest(mapped, id_col, name).select("manifest").write.mode("overwrite").text(path)
