"""Pixel arithmetic on array columns, all of it in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of red, green and blue in luminance.
LUMA = (0.299, 0.587, 0.114)


def doubles(values: Column) -> Column:
    return values.cast("array<double>")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, not wherever ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def mean(values: Column) -> Column:
    """Null for an empty array."""
    return F.try_divide(F.aggregate(doubles(values), F.lit(0.0), lambda a, x: a + x), F.size(values))


def scrub(x: Column, nan: float = 0.0) -> Column:
    """NaN to ``nan``, infinities to 1 and 0; the batch variant takes 0.5 for NaN."""
    return F.when(F.isnan(x), F.lit(nan)).when(x == float("inf"), F.lit(1.0)).when(x == float("-inf"), F.lit(0.0)).otherwise(x)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def quantise(values: Column, nan: float = 0.0) -> Column:
    """Bytes 0 to 255, halves to even."""
    return F.transform(doubles(values), lambda x: F.bround(clamp(scrub(x, nan)) * 255).cast("int"))


def average_hash(values: Column, channels: int = 1, guard_flat: bool = False) -> Column:
    """Two hex digits a value: 01 above its channel's mean, 00 otherwise.

    Flat inputs of any value hash alike; ``guard_flat`` puts their mean in front.
    """
    def hashed(v: Column) -> Column:
        channel = lambda k: F.filter(v, lambda _, i: i % channels == k)
        means = F.array(*(mean(channel(k)) for k in range(channels)))
        out = let(means, lambda ms: F.array_join(F.transform(v, lambda x, i: F.when(x > F.get(ms, i % channels), "01").otherwise("00")), ""))
        if guard_flat:
            flat = F.array_min(v) == F.array_max(v)
            out = F.when(flat, F.concat(F.format_string("flat:%.6f:", F.get(v, F.lit(0))), out)).otherwise(out)
        return out

    return let(doubles(values), hashed)


def gray(values: Column) -> Column:
    """Luminance of interleaved red, green and blue; values that make no whole pixel are left out."""
    def pixels(v: Column) -> Column:
        n = F.floor(F.size(v) / 3).cast("int")
        at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.get(v, i * 3) * LUMA[0] + F.get(v, i * 3 + 1) * LUMA[1] + F.get(v, i * 3 + 2) * LUMA[2])

    return let(doubles(values), pixels)


def gray_hash(values: Column) -> Column:
    """Bits above the mean, the first the least significant, as hex; the last digit is filled with zeros.

    256 grey values give 64 digits; no values give an empty hash.
    """
    def digits(bits: Column) -> Column:
        n = F.ceil(F.size(bits) / 4).cast("int")
        bit = lambda i: F.coalesce(F.get(bits, i), F.lit(0))
        at = F.when(n > 0, F.sequence(n - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        return F.array_join(F.transform(at, lambda j: F.lower(F.hex((bit(j * 4) + bit(j * 4 + 1) * 2 + bit(j * 4 + 2) * 4 + bit(j * 4 + 3) * 8).cast("long")))), "")

    return let(doubles(values), lambda v: let(mean(v), lambda m: let(F.transform(v, lambda x: (x > m).cast("int")), digits)))


def resample(values: Column, height: int, width: int, channels: int, to_height: int = 16, to_width: int = 16) -> Column:
    """A row-major image of interleaved channels at another size, each place from the nearest pixel."""
    cells = F.sequence(F.lit(0), F.lit(to_height * to_width * channels - 1))

    def source(i: Column) -> Column:
        y, x = F.floor(i / (to_width * channels)), F.floor(i / channels) % to_width
        return ((F.floor(y * height / to_height) * width + F.floor(x * width / to_width)) * channels + i % channels).cast("int")

    return let(doubles(values), lambda v: F.transform(cells, lambda i: F.get(v, source(i))))


def frame_hash(values: Column, height: int, width: int, guard_flat: bool = False) -> Column:
    """The average hash of a frame: 16 x 16 pixels of three channels, 1536 hex digits."""
    return average_hash(resample(values, height, width, 3), 3, guard_flat)


def frame_gray_hash(values: Column, height: int, width: int) -> Column:
    """The grey hash of a frame: 16 x 16 grey values, 256 bits, 64 hex digits."""
    return gray_hash(gray(resample(values, height, width, 3)))


def contrast(values: Column, factor: float) -> Column:
    return let(doubles(values), lambda v: let(mean(v), lambda m: F.transform(v, lambda x: clamp((x - m) * factor + m))))


def saturation(values: Column, factor: float) -> Column:
    """Each channel moved from (or to) its pixel's luminance."""
    change = lambda v, g: F.transform(F.slice(v, 1, F.size(g) * 3), lambda x, i: clamp(F.get(g, (i / 3).cast("int")) * (1 - factor) + x * factor))
    return let(doubles(values), lambda v: let(gray(v), lambda g: change(v, g)))


def sharpen(values: Column, width: int, strength: float, normalised: bool = False) -> Column:
    """3 x 3 kernel on a row-major image, zeros outside.

    As specified the kernel sums to 9, so flat areas grow nine times before the clamp; the
    normalised kernel sums to 1.  Sums over whole shifted arrays: rows of three first, then
    three of those, so no place is looked up by its number.
    """
    centre = (1.0 if normalised else 9.0) + 9.0 * strength
    add = lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))
    zeros = F.array(*[F.lit(0.0)] * width)
    rest = lambda v: F.greatest(F.size(v), F.lit(1))

    def in_rows(v: Column) -> Column:
        # what would come from the row before or after is zero
        left = F.transform(F.concat(F.array(F.lit(0.0)), F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0)))), lambda x, i: F.when(i % width == 0, 0.0).otherwise(x))
        right = F.transform(F.concat(F.slice(v, 2, rest(v)), F.array(F.lit(0.0))), lambda x, i: F.when(i % width == width - 1, 0.0).otherwise(x))
        return add(add(left, right), v)

    def blocks(rows: Column) -> Column:
        return add(add(F.slice(F.concat(zeros, rows), 1, F.size(rows)), F.slice(F.concat(rows, zeros), width + 1, rest(rows))), rows)

    return let(doubles(values), lambda v: F.zip_with(v, let(in_rows(v), blocks), lambda c, a: clamp(c * centre - a * strength)))


def dither(values: Column, noise: Column) -> Column:
    """Bytes by triangular noise and truncation; ``noise`` has a number in [0, 2) for each value, the sum of two even ones."""
    return F.zip_with(doubles(values), noise, lambda x, r: F.floor(clamp(scrub(x) * 255 + (r - 1), 0.0, 255.0)).cast("int"))


def triangular_noise(n: Column, seed: int = 0) -> Column:
    """Repeatable triangular noise: sums of two even numbers from hashes of the place."""
    even = lambda i, k: F.pmod(F.xxhash64(i, F.lit(seed * 2 + k)), F.lit(1 << 30)) / float(1 << 30)
    return F.transform(F.sequence(F.lit(1), n), lambda i: even(i, 0) + even(i, 1))


def post_process(values: Column, width: int, sharpness: float = 0.0, contrast_factor: float = 1.0, colour: float = 1.0) -> Column:
    """Sharpness, then contrast, then saturation; each is left out at its neutral value.

    Sharpness and contrast take the values as one channel, saturation as interleaved colours.
    """
    out = doubles(values)
    if sharpness:
        out = sharpen(out, width, sharpness, normalised=True)
    if contrast_factor != 1.0:
        out = contrast(out, contrast_factor)
    if colour != 1.0:
        out = saturation(out, colour)
    return out


def split_alpha(values: Column) -> tuple[Column, Column]:
    """Interleaved red, green, blue and alpha as colours and alpha."""
    v = doubles(values)
    return F.filter(v, lambda _, i: i % 4 < 3), F.filter(v, lambda _, i: i % 4 == 3)


def join_alpha(colours: Column, alpha: Column) -> Column:
    """The alpha of each pixel behind its three colours."""
    return let(doubles(colours), lambda c: F.flatten(F.transform(doubles(alpha), lambda a, i: F.array(F.get(c, i * 3), F.get(c, i * 3 + 1), F.get(c, i * 3 + 2), a))))


def with_resized_alpha(values: Column, colours: Column, height: int, width: int, scale: int) -> Column:
    """The alpha of ``values``, resized, behind colours that were resized already."""
    alpha = resample(split_alpha(values)[1], height, width, 1, height * scale, width * scale)
    return join_alpha(colours, alpha)


def flatten_alpha(value: Column, alpha: Column, ground: Column | float = 255.0) -> Column:
    """A byte over white, or over another ground."""
    return F.bround(alpha / 255.0 * value + (1 - alpha / 255.0) * ground).cast("int")


def checkerboard(y: Column, x: Column, square: int = 16, light: int = 200, dark: int = 170) -> Column:
    return F.when((F.floor(x / square) + F.floor(y / square)) % 2 == 0, light).otherwise(dark).cast("int")
