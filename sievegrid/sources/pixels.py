"""Images of pixels: encoding, decoding with an error column, saving and probing.

The formats are binary PPM (P6: width, height, 255, then red, green and blue of each pixel) and
PNG of 8 or 16 bits, not interlaced, of one to four channels; PNG is written without row filters and read
with none, Sub or Up.  No image library is installed, so the other formats' bytes pass through as they are.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A

_HEAD = re.compile(rb"P6\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", re.S)
DECODED = "height int, width int, pixels array<double>, error string"


def encode(values: Column, height: int, width: int) -> Column:
    """Values of 0 to 1, three a pixel, as a PPM image."""
    body = F.unhex(F.array_join(F.transform(A.quantise(values), lambda b: F.lpad(F.hex(b.cast("long")), 2, "0")), ""))
    return F.concat(F.lit(f"P6\n{width} {height}\n255\n".encode()), body)


# Fixed values of the format: its signature, and the colour type of each number of channels.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
PNG_COLOURS = {1: 0, 2: 4, 3: 2, 4: 6}
ENCODED = "name string, content binary, error string"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(values: np.ndarray, level: int = 6) -> bytes:
    """An image of (height, width, channels), unsigned of 8 or 16 bits."""
    height, width, channels = values.shape
    rows = values.astype(values.dtype.newbyteorder(">")).reshape(height, -1).view(np.uint8)
    head = struct.pack(">IIBBBBB", width, height, 8 * values.dtype.itemsize, PNG_COLOURS[channels], 0, 0, 0)
    return PNG_SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(np.pad(rows, ((0, 0), (1, 0))).tobytes(), level)) + _chunk(b"IEND", b"")


def parse_png(raw: bytes) -> tuple[int | None, int | None, list[float] | None, str | None]:
    """(height, width, pixels, error) of a PNG image."""
    at, packed, head = len(PNG_SIGNATURE), [], None
    while at + 12 <= len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if raw[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            return None, None, None, "a chunk is broken"
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if head is None:
        return None, None, None, "no header"
    width, height, bits, colour, _, _, interlaced = head
    channels = next((n for n, c in PNG_COLOURS.items() if c == colour), 0)
    if bits not in (8, 16) or not channels or interlaced:
        return height, width, None, f"{bits} bits of colour type {colour}, interlaced {interlaced}"
    step = channels * bits // 8
    try:
        rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * step)
    except (zlib.error, ValueError) as e:
        return height, width, None, str(e)
    filters, rows = rows[:, 0], rows[:, 1:].copy()
    if filters.max(initial=0) > 2:
        return height, width, None, f"row filter {filters.max()}"
    for y in np.flatnonzero(filters).tolist():
        if filters[y] == 1:
            rows[y] = np.add.accumulate(rows[y].reshape(width, step), 0, dtype=np.uint8).reshape(-1)
        elif y:
            rows[y] += rows[y - 1]
    values = rows.view(">u2") / 65535.0 if bits == 16 else rows / 255.0
    return height, width, values.reshape(-1).tolist(), None


def over_white(values: np.ndarray) -> np.ndarray:
    """(height, width, channels) without alpha, which is the last of two or four channels."""
    if values.shape[2] % 2:
        return values
    alpha = values[:, :, -1:]
    return values[:, :, :-1] * alpha + (1 - alpha)


def encoded(image: np.ndarray, kind: str, level: int | None, bits: int | None) -> tuple[str, bytes]:
    """The suffix and the bytes of an image of 0 to 1; ValueError where there is no encoder.

    16 bits are for three channels, as without alpha; PPM has no alpha, so it goes over white.
    """
    image = np.clip(np.nan_to_num(image, nan=0.0, posinf=1.0, neginf=0.0), 0, 1)
    if kind == "PNG":
        deep = bits == 16 and image.shape[2] == 3
        return ".png", png(np.rint(image * (65535 if deep else 255)).astype(np.uint16 if deep else np.uint8), 6 if level is None else level)
    if kind == "PPM":
        plain = over_white(image)
        plain = np.repeat(plain, 3, 2) if plain.shape[2] == 1 else plain
        return ".ppm", f"P6\n{image.shape[1]} {image.shape[0]}\n255\n".encode() + np.rint(plain * 255).astype(np.uint8).tobytes()
    raise ValueError(f"no encoder for {kind}")


def encode_as(images: DataFrame, name: Column, height: Column, width: Column, values: Column, kind: Column, level: Column, bits: Column) -> DataFrame:
    """(name, content, error): each image in the format of its row, its suffix behind the name."""

    def one(name: str, height: int, width: int, flat: np.ndarray | None, kind: str, level: int | None, bits: int | None) -> tuple[str, bytes | None, str | None]:
        try:
            if flat is None or not height or not width or not len(flat) or len(flat) % (height * width) or len(flat) // (height * width) not in PNG_COLOURS:
                raise ValueError(f"{0 if flat is None else len(flat)} values in {height} x {width} pixels")
            suffix, content = encoded(flat.reshape(height, width, -1), kind, level, bits)
            return name + suffix, content, None
        except ValueError as e:
            return name, None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = batch.column(3).values.to_numpy(zero_copy_only=False), batch.column(3).offsets.to_numpy()
            whole = [flat[offsets[i] : offsets[i + 1]] if ok else None for i, ok in enumerate(batch.column(3).is_valid().to_pylist())]
            others = [batch.column(k).to_pylist() for k in (0, 1, 2, 4, 5, 6)]
            found = [one(n, h, w, v, k, z, b) for (n, h, w, k, z, b), v in zip(zip(*others, strict=True), whole, strict=True)]
            columns = list(zip(*found, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.string()), strict=True)], names=["name", "content", "error"])

    typed = zip((name, height, width, values, kind, level, bits), ("string", "int", "int", "array<double>", "string", "int", "int"), strict=True)
    return images.select(*(c.cast(t).alias(f"c{i}") for i, (c, t) in enumerate(typed))).mapInArrow(run, ENCODED)


def parse(raw: bytes | None) -> tuple[int | None, int | None, list[float] | None, str | None]:
    """(height, width, pixels, error) of an image; whatever is wrong with it is the error."""
    if raw is None:
        return None, None, None, "null input"
    if raw.startswith(PNG_SIGNATURE):
        return parse_png(raw)
    head = _HEAD.match(raw)
    if not head:
        return None, None, None, "not a PPM image"
    width, height, top = (int(x) for x in head.groups())
    body = raw[head.end() :]
    if top != 255 or len(body) != 3 * width * height:
        return height, width, None, f"{len(body)} bytes of pixels instead of {3 * width * height}"
    return height, width, (np.frombuffer(body, np.uint8) / 255.0).tolist(), None


def decode(files: DataFrame, id_col: str, content_col: str = "content") -> DataFrame:
    """(id, height, width, pixels, error): a broken image reports its error and the others go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(x) for x in batch.column(1).to_pylist()]
            columns = list(zip(*found, strict=True)) or [[]] * 4
            kinds = pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.string()
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[id_col, "height", "width", "pixels", "error"])

    kind = files.schema[id_col].dataType.simpleString()
    return files.select(id_col, F.col(content_col).cast("binary").alias("content")).mapInArrow(run, f"{id_col} {kind}, {DECODED}")


def probe(files: DataFrame, id_col: str, content_col: str = "content") -> DataFrame:
    """(id, height, width, error) from the header's bytes only, tolerant of what isn't an image."""
    raw = F.substring(F.col(content_col), 1, 64)
    part = lambda k: F.expr(f"try_cast(nullif(regexp_extract(sg_head, r'^P6\\s+(\\d+)\\s+(\\d+)\\s', {k}), '') as int)")
    # in PNG the width and the height are big-endian numbers behind the signature and a chunk's head
    number = lambda at: F.conv(F.substring("sg_hex", at, 8), 16, 10).cast("int")
    rows = files.select(id_col, F.decode(raw, "ISO-8859-1").alias("sg_head"), F.hex(raw).alias("sg_hex"))
    is_png = F.col("sg_hex").startswith(PNG_SIGNATURE.hex().upper()) & (F.length("sg_hex") >= 48)
    rows = rows.select(id_col, F.when(is_png, number(41)).otherwise(part(2)).alias("height"), F.when(is_png, number(33)).otherwise(part(1)).alias("width"))
    return rows.withColumn("error", F.when(F.col("height").isNull() | F.col("width").isNull(), "not a PPM or PNG image"))


def save(images: DataFrame, folder: str, name_col: str, content_col: str = "content") -> None:
    """Write every image under its name into a folder that the executors share.

    A file appears under its name only when it is whole, so a task that runs again does no harm.
    """

    def write(rows: Iterator) -> None:
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for r in rows:
            part = f"{root}/.{r[name_col]}.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as f:
                f.write(bytes(r[content_col]))
            store.move(part, f"{root}/{r[name_col]}")

    images.select(name_col, content_col).foreachPartition(write)
