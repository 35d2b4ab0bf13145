"""Scalar functions over paths, sizes, rates and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.catalog import IMAGE_SUFFIXES, VIDEO_SUFFIXES


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """The lower-cased suffix with its dot, or an empty string; a leading dot starts no suffix."""
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]*[^.])$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=[^.])\.[^.]+$", "")


def classify(path: Column) -> Column:
    """image, video or null by suffix."""
    s = suffix(path)
    return F.when(s.isin(IMAGE_SUFFIXES), "image").when(s.isin(VIDEO_SUFFIXES), "video")


def strip_query(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def frame_number(name: Column, strict: bool = False) -> Column:
    """The number after the first underscore of the stem, else its first run of digits."""
    s = stem(name)
    after = F.regexp_extract(s, r"^[^_]*_(\d+)(?:_|$)", 1).try_cast("long")
    found = F.coalesce(after, F.regexp_extract(s, r"(\d+)", 1).try_cast("long"))
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no frame number in "), name)).cast("long")) if strict else found


def frame_name(number: Column, suffix: str = ".png") -> Column:
    """Five digits at least; the number stays the sort key, names of more digits don't sort."""
    return F.format_string(f"frame_%05d{suffix}", number)


def human_size(n: Column) -> Column:
    """Bytes for people; exact halves round to even."""
    kb = 1024.0
    return (
        F.when(n < 1024, F.format_string("%d B", n))
        .when(n < 1024**2, F.format_string("%.1f KB", F.bround(n / kb, 1)))
        .when(n < 1024**3, F.format_string("%.1f MB", F.bround(n / kb**2, 1)))
        .otherwise(F.format_string("%.2f GB", F.bround(n / kb**3, 2)))
    )


def fps(rate: Column, default: float = 24.0) -> Column:
    """A fraction or a number; anything else, and a division by zero, is the default."""
    parts = F.split(rate, "/")
    number = F.get(parts, 0).try_cast("double")
    below = F.when(F.size(parts) == 2, F.get(parts, 1).try_cast("double"))
    value = F.when(F.size(parts) == 1, number).when(F.size(parts) == 2, F.try_divide(number, below))
    return F.coalesce(value, F.lit(default))


def passes(height: Column, target: Column, scale: int = 2, most: int = 32) -> Column:
    """How often to scale by an integer until ``target`` is reached; at least one pass.

    Heights below one and scales below two could never reach it: they take one pass.
    """
    if scale < 2:
        return F.lit(1)
    start = F.struct(height.cast("long").alias("h"), F.lit(0).alias("n"))
    grown = F.aggregate(
        F.sequence(F.lit(1), F.lit(most)),
        start,
        lambda acc, _: F.struct(F.when(acc["h"] < target, acc["h"] * scale).otherwise(acc["h"]).alias("h"), F.when(acc["h"] < target, acc["n"] + 1).otherwise(acc["n"]).alias("n")),
        lambda acc: acc["n"],
    )
    return F.when((height < 1) | (target <= 0), F.lit(1)).otherwise(F.greatest(F.lit(1), grown)).cast("int")


def image_passes(target: Column, scale: Column) -> Column:
    """Passes for a factor: ceil(log(target) / log(scale)) where the target is larger.

    An epsilon keeps exact powers, which logarithms may miss by a rounding error.
    """
    return F.when((target > scale) & (scale > 1), F.ceil(F.ln(target) / F.ln(scale) - 1e-9)).otherwise(F.lit(1)).cast("int")


def fit_height(width: Column, height: Column, target: Column) -> Column:
    """The width, cut to an integer, that keeps the aspect ratio at ``target`` height."""
    return F.floor(target * (width.cast("double") / height)).cast("int")


def scaled(size: Column, factor: Column) -> Column:
    return F.floor(size * factor).cast("int")


def pre_downscale_height(height: Column, limit: Column) -> Column:
    """The limit where it is set and the image is taller."""
    return F.when((limit > 0) & (height > limit), limit).otherwise(height).cast("int")


def pre_downscale_width(width: Column, height: Column, limit: Column) -> Column:
    return F.when((limit > 0) & (height > limit), F.floor(width * (limit.cast("double") / height))).otherwise(width).cast("int")


# The tile sizes by scale, the slots by memory and the heights of labels below.
def auto_tile(model_scale: Column, base: int = 512) -> Column:
    """Tile size by the model's own scale."""
    return F.when(model_scale >= 16, max(128, base // 4)).when(model_scale >= 8, max(192, base // 2)).otherwise(base).cast("int")


def needs_tiles(height: Column, width: Column, tile: Column) -> Column:
    return height.cast("long") * width > tile.cast("long") * tile


def slots(memory_gb: Column) -> Column:
    """Parallel slots by memory."""
    return F.when(memory_gb < 5, 1).when(memory_gb < 7, 3).when(memory_gb < 10, 5).when(memory_gb < 12, 6).otherwise(8).cast("int")


def scale_factor(label: Column, default: float = 2.0) -> Column:
    """The factor of labels ×1 to ×16, else the default."""
    pairs = F.create_map(*(F.lit(x) for k in (1, 2, 3, 4, 8, 16) for x in (f"×{k}", float(k))))
    return F.coalesce(F.element_at(pairs, label), F.lit(default))


def half_precision(label: Column) -> Column:
    """True, false, or null where the label leaves it to the hardware."""
    low = F.lower(label)
    return F.when(low.contains("fp16"), True).when(low.contains("fp32"), False)


def downscale_limit(label: Column) -> Column:
    """The height that a label names, 0 for none."""
    low = F.lower(F.coalesce(label, F.lit("")))
    return F.when(low.contains("480"), 480).when(low.contains("720"), 720).when(low.contains("1080"), 1080).otherwise(0).cast("int")


def unwrap(value: Column, default: str) -> Column:
    """The ``value`` field of a JSON object, the string itself otherwise, the default for null."""
    inner = F.get_json_object(value, "$.value")
    return F.coalesce(inner, F.when(F.trim(value).startswith("{"), F.lit(None)).otherwise(value), F.lit(default))


def name_list(text: Column) -> Column:
    """Lines, trimmed, without blanks."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def output_name(mode: Column, name: Column, suffix: Column, own: Column, shared: Column) -> Column:
    """Naming policy: the input's name, with a suffix, or custom (own name, shared name, input's)."""
    custom = F.coalesce(F.nullif(F.trim(own), F.lit("")), F.nullif(F.trim(shared), F.lit("")), name)
    return F.when(mode == "same", name).when(mode == "suffix", F.concat(name, F.coalesce(suffix, F.lit("")))).otherwise(custom)


def output_folder(n_images: Column, n_videos: Column, kind: Column, session: Column, many: int = 1) -> Column:
    """A folder of its own kind for a session with several files, the kind's shared folder otherwise."""
    return F.when(n_images + n_videos > many, F.concat(session, F.lit("/"), kind, F.lit("s"))).otherwise(F.concat(kind, F.lit("s")))


def with_suffix(name: Column, suffix: str) -> Column:
    """The name with its last suffix replaced: ``a.b`` becomes ``a.png``, a name without one gets it."""
    return F.concat(F.regexp_replace(name, r"(?<=[^./])\.[^./]*$", ""), F.lit(suffix))


def session_folder(at: Column) -> Column:
    """A folder name by time."""
    return F.date_format(at, "yyyyMMdd_HHmmss")


def speed_up(total: Column, unique: Column, workers: Column) -> Column:
    """The speed-up that dedupe and parallel work promise, null without unique items."""
    return F.try_divide(total.cast("double"), unique) * workers


def streams_frames(enabled: Column, frames: Column, parallel: Column, has_slots: Column, least: int = 20) -> Column:
    """Whether a video takes the streaming mode: it is on, worth it, parallel and has slots."""
    return F.coalesce(enabled & (frames >= least) & parallel & has_slots, F.lit(False))
