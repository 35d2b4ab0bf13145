"""Lookup catalogs and their joins with defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# They must equal those that results are compared with.
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".webp", ".bmp", ".gif"]
VIDEO_SUFFIXES = [".mp4", ".mov", ".avi", ".webm", ".mkv", ".flv"]
CODECS = [
    # codec_name, codec, alpha_support, profile_name, preset, cq, profile, pix_fmt, bitrate
    ("H.264 (AVC)", "h264_nvenc", False, "Main (Good)", "p4", 20, "main", None, None),
    ("H.264 (AVC)", "h264_nvenc", False, "High (Better)", "p7", 17, "high", None, None),
    ("H.264 (AVC)", "h264_nvenc", False, "Lossless (Best)", "p4", 0, "high", None, None),
    ("H.265 (HEVC)", "hevc_nvenc", False, "Main (8-bit)", "p4", 20, "main", "yuv420p", None),
    ("H.265 (HEVC)", "hevc_nvenc", False, "Main10 (10-bit)", "p4", 20, "main10", "yuv420p10le", None),
    ("H.265 (HEVC)", "hevc_nvenc", False, "Main10 High Quality", "p7", 16, "main10", "yuv420p10le", None),
    ("H.265 (HEVC)", "hevc_nvenc", False, "Main10 Fast", "p1", 24, "main10", "yuv420p10le", None),
    ("ProRes", "prores_ks", True, "ProRes 422 Proxy", None, None, "0", "yuv422p10le", None),
    ("ProRes", "prores_ks", True, "ProRes 422 LT", None, None, "1", "yuv422p10le", None),
    ("ProRes", "prores_ks", True, "ProRes 422", None, None, "2", "yuv422p10le", None),
    ("ProRes", "prores_ks", True, "ProRes 422 HQ", None, None, "3", "yuv422p10le", None),
    ("ProRes", "prores_ks", True, "ProRes 4444", None, None, "4", "yuva444p10le", None),
    ("ProRes", "prores_ks", True, "ProRes 4444 XQ", None, None, "5", "yuva444p10le", None),
    ("DNxHD/DNxHR", "dnxhd", True, "DNxHD 36", None, None, "dnxhd", None, "36M"),
    ("DNxHD/DNxHR", "dnxhd", True, "DNxHD 115", None, None, "dnxhd", None, "115M"),
    ("DNxHD/DNxHR", "dnxhd", True, "DNxHD 175", None, None, "dnxhd", None, "175M"),
    ("DNxHD/DNxHR", "dnxhd", True, "DNxHD 220", None, None, "dnxhd", None, "220M"),
    ("DNxHD/DNxHR", "dnxhd", True, "DNxHR LB", None, None, "dnxhr_lb", None, None),
    ("DNxHD/DNxHR", "dnxhd", True, "DNxHR SQ", None, None, "dnxhr_sq", None, None),
    ("DNxHD/DNxHR", "dnxhd", True, "DNxHR HQ", None, None, "dnxhr_hq", None, None),
    ("DNxHD/DNxHR", "dnxhd", True, "DNxHR HQX", None, None, "dnxhr_hqx", None, None),
    ("DNxHD/DNxHR", "dnxhd", True, "DNxHR 444", None, None, "dnxhr_444", None, None),
]
CODEC_SUFFIX = {"H.264 (AVC)": ".mp4", "H.265 (HEVC)": ".mp4", "ProRes": ".mov", "DNxHD/DNxHR": ".mov"}
FRAME_FORMATS = [
    # name, format, compress_level, bits, quality
    ("PNG - Uncompressed (16-bit)", "PNG", 0, 16, None),
    ("PNG - Normal (8-bit)", "PNG", 6, 8, None),
    ("PNG - High Compression (8-bit)", "PNG", 9, 8, None),
    ("JPEG - Quality 100%", "JPEG", None, None, 100),
    ("JPEG - Quality 95%", "JPEG", None, None, 95),
]
DEFAULT_FRAME_FORMAT = "PNG - Normal (8-bit)"
# End of the fixed values.


def codecs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CODECS, "codec_name string, codec string, alpha_support boolean, profile_name string, preset string, cq int, profile string, pix_fmt string, bitrate string")


def frame_formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FRAME_FORMATS, "name string, format string, compress_level int, bits int, quality int")


def codec_suffix(codec_name: Column, default: str = ".mp4") -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in CODEC_SUFFIX.items() for x in kv))
    return F.coalesce(F.element_at(pairs, codec_name), F.lit(default))


def with_profile(rows: DataFrame, codec_col: str, profile_col: str) -> DataFrame:
    """Rows with the columns of their codec profile; null where there is none.

    The catalog has 22 rows, so it is broadcast.
    """
    dim = F.broadcast(codecs(rows.sparkSession))
    return rows.join(dim, (rows[codec_col] == dim.codec_name) & (rows[profile_col] == dim.profile_name), "left").drop(dim.codec_name, dim.profile_name)


def with_frame_format(rows: DataFrame, name_col: str, strict: bool = False) -> DataFrame:
    """Rows with their frame format; an unknown name takes the default, or is an error."""
    dim = F.broadcast(frame_formats(rows.sparkSession).withColumnRenamed("name", "sg_name"))
    known = F.col(name_col).isin([x[0] for x in FRAME_FORMATS])
    other = F.raise_error(F.concat(F.lit("unknown frame format: "), F.coalesce(name_col, F.lit("null")))).cast("string") if strict else F.lit(DEFAULT_FRAME_FORMAT)
    keyed = rows.withColumn("sg_key", F.when(F.coalesce(known, F.lit(False)), F.col(name_col)).otherwise(other))
    return keyed.join(dim, F.col("sg_key") == F.col("sg_name")).drop("sg_key", "sg_name")


def available(local: DataFrame, defaults: DataFrame) -> DataFrame:
    """Local entries with the defaults' metadata, then defaults that are neither present nor shadowed by name.

    ``local`` has (file); ``defaults`` has (file, display_name, description).
    """
    present = local.join(defaults, "file", "left").select("file", F.coalesce("display_name", F.regexp_replace("file", r"\.[^.]*$", "")).alias("display_name"), "description", F.lit(True).alias("is_local"))
    absent = defaults.join(local, "file", "left_anti").join(present.select("display_name"), "display_name", "left_anti")
    return present.unionByName(absent.select("file", "display_name", "description", F.lit(False).alias("is_local")))


def positional_names(files: DataFrame, names: DataFrame, order_col: str = "input_ord", name_col: str = "name") -> DataFrame:
    """Files with the name at the same position; extra names are ignored, missing ones null.

    Both sides carry their position, so this is an ordinary left join.
    """
    return files.join(names.select(F.col(order_col), F.col(name_col).alias("custom_name")), order_col, "left")
