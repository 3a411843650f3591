"""Media columns: 8-bit grey PNG images in binary columns, and low-frequency cosine-transform hashes of them.

The codec is written out here: signature, chunks with their CRC, IHDR / IDAT / IEND, zlib, and the five row filters. Writing chooses for
each row the filter (none, sub or up) with the least sum of absolute differences. Reading checks every chunk's CRC and the order of
chunks, joins all IDAT data, inflates it under a size bound, and undoes the filters in numpy.

Batches of rows go through Arrow, bounded in bytes by Spark (spark.sql.execution.arrow.maxBytesPerBatch); results leave in batches of about
FLUSH_BYTES, so that memory follows these bounds and the largest text. No shuffle.

Defined cases: null payloads count as empty; a broken image, one of more than MOST_SAMPLES samples or one of another kind raises ValueError
(`read_png`) or gives null results with the reason in `error` (`read_images`); empty tables give empty results; other columns are carried on,
but those named like a column that is added, which replaces them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, scratch, written

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)

WIDTH = 64
LEVEL = 3
#: An image that says it has more samples isn't inflated.
MOST_SAMPLES = 1 << 30
FLUSH_BYTES = 4 << 20
SIDE = 32  # the transform's input
LOW = 8  # its low frequencies


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def write_png(samples: np.ndarray, level: int = LEVEL) -> bytes:
    """samples: uint8, height x width, both at least 1."""
    height, width = samples.shape
    left, above = np.zeros_like(samples), np.zeros_like(samples)
    left[:, 1:], above[1:] = samples[:, :-1], samples[:-1]
    kinds = np.stack([samples, samples - left, samples - above])
    cost = np.minimum(kinds, 256 - kinds.astype(np.int16)).sum(axis=2)
    kind = cost.argmin(axis=0)
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0] = kind
    rows[:, 1:] = kinds[kind, np.arange(height)]
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(rows: np.ndarray) -> np.ndarray:
    kinds, data = rows[:, 0], rows[:, 1:].copy()
    if kinds.max(initial=0) > PAETH:
        raise ValueError("unknown row filter")
    sub = kinds == SUB
    if sub.any():
        data[sub] = np.cumsum(data[sub], axis=1, dtype=np.uint8)
    # Rows that need the row above are undone in runs, from top to bottom.
    at, height = 0, len(data)
    needs = np.flatnonzero(kinds >= UP)
    while len(needs):
        at = int(needs[0])
        if kinds[at] == UP:
            end = at
            while end < height and kinds[end] == UP:
                end += 1
            first = data[at - 1] if at else np.zeros(data.shape[1], np.uint8)
            data[at:end] = np.cumsum(np.concatenate([first[None], data[at:end]]), axis=0, dtype=np.uint8)[1:]
        else:
            end = at + 1
            above = data[at - 1].astype(int) if at else np.zeros(data.shape[1], int)
            row, left, corner = data[at].astype(int), 0, 0
            for i in range(len(row)):
                up = above[i]
                if kinds[at] == AVERAGE:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                row[i] = left = (row[i] + guess) & 255
                corner = up
            data[at] = row
        needs = needs[np.searchsorted(needs, end) :]
    return data


def read_png(image: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG without interlace; ValueError for anything else or anything broken."""
    if image[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, shape, parts, ended = 8, None, [], False
    while at < len(image):
        if ended or at + 12 > len(image):
            raise ValueError("broken chunk order or length")
        (n,) = struct.unpack_from(">I", image, at)
        kind, data = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if len(data) < n or image[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(data, zlib.crc32(kind))):
            raise ValueError(f"checksum of chunk {kind!r} fails")
        if shape is None and kind != b"IHDR":
            raise ValueError("the first chunk isn't IHDR")
        if kind == b"IHDR":
            if shape is not None or n != 13:
                raise ValueError("a second IHDR, or one of another length")
            width, height, *rest = struct.unpack(">IIBBBBB", data)
            if rest != [8, 0, 0, 0, 0] or not width or not height:
                raise ValueError("not an 8-bit grey image without interlace")
            if width * height > MOST_SAMPLES:
                raise ValueError("too large an image")
            shape = height, width + 1
        elif kind == b"IDAT":
            parts.append(data)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise ValueError(f"unknown critical chunk {kind!r}")
        at += 12 + n
    if not ended:
        raise ValueError("no IEND")
    if not parts:
        raise ValueError("no IDAT")
    inflate = zlib.decompressobj()
    try:
        raw = inflate.decompress(b"".join(parts), shape[0] * shape[1] + 1)
    except zlib.error as e:
        raise ValueError(f"broken image data: {e}") from e
    if len(raw) != shape[0] * shape[1] or not inflate.eof:
        raise ValueError("wrong amount of image data")
    return _unfilter(np.frombuffer(raw, np.uint8).reshape(shape))


def _cosines(n: int, low: int) -> np.ndarray:
    """Rows: the low orthonormal cosine basis vectors over n samples."""
    k, x = np.arange(low)[:, None], np.arange(n)[None]
    m = np.cos(np.pi * k * (2 * x + 1) / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


_BASIS = _cosines(SIDE, LOW)


def _squeezed(a: np.ndarray, n: int) -> np.ndarray:
    """Means of a over n equal stretches of its first axis; a stretch may hold parts of rows."""
    total = np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, axis=0, dtype=float)])
    edges = np.arange(n + 1) * (len(a) / n)
    whole = np.minimum(edges.astype(int), len(a) - 1)
    upto = total[whole] + (edges - whole)[:, None] * a[whole]
    return np.diff(upto, axis=0) / (len(a) / n)


def cosine_hash(samples: np.ndarray) -> bytes:
    """8 bytes: which of the LOW x LOW low frequencies of the image, squeezed to SIDE x SIDE, are above their median (without the mean)."""
    small = _squeezed(_squeezed(samples.astype(float), SIDE).T, SIDE).T
    low = (_BASIS @ small @ _BASIS.T).ravel()
    # Rounded, so that sums in another order give the same bits.
    low = np.round(low, 6)
    return np.packbits(low > np.median(low[1:])).tobytes()


def payload(text: bytes | None, unit: int = WIDTH) -> bytes:
    """The bytes, filled with bytes 0 up to a positive multiple of unit."""
    text = text or b""
    return text + bytes(max(unit, -(-len(text) // unit) * unit) - len(text))


def _mapped(df: DataFrame, fields: list[T.StructField], function) -> DataFrame:
    """df with fields added; function gives their values for a record batch row by row."""
    names = [f.name for f in fields]
    keep = [c for c in df.columns if c not in names]
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])
    types = [pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest, low, size, held = batch.select(keep), 0, 0, []
            for row in function(batch):
                held.append(row)
                size += sum(len(v) for v in row if v is not None)
                if size >= FLUSH_BYTES or low + len(held) == batch.num_rows:
                    made = [pa.array(c, k) for c, k in zip(zip(*held, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([*rest.slice(low, len(held)).columns, *made], [*keep, *names])
                    low, size, held = low + len(held), 0, []
            give_back()

    return df.mapInArrow(run, schema)


def write_images(df: DataFrame, data: str, image: str = "image", width: int = WIDTH, level: int = LEVEL) -> DataFrame:
    """Adds the binary column image: a PNG whose samples are the bytes of column data (binary), padded to whole rows."""

    def function(batch):
        for x in batch.column(data):
            yield (write_png(np.frombuffer(payload(x.as_py(), width), np.uint8).reshape(-1, width), level),)

    return _mapped(df, [T.StructField(image, T.BinaryType())], function)


def read_images(df: DataFrame, image: str = "image") -> DataFrame:
    """Adds payload (the samples in order), feature (hexadecimal hash) and error, from the stored bytes alone."""

    def function(batch):
        for x in batch.column(image):
            try:
                samples = read_png(x.as_py() or b"")
                yield samples.tobytes(), cosine_hash(samples).hex(), None
            except ValueError as e:
                yield None, None, str(e)

    return _mapped(df, [T.StructField("payload", T.BinaryType()), T.StructField("feature", T.StringType()), T.StructField("error", T.StringType())], function)


def text_images(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, image of every text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.cast("binary").alias("data"))
    return write_images(rows, "data").drop("data")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every text as a PNG, stored in a table and read back from its stored bytes."""
    with scratch(spark):
        back = read_images(written(text_images(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media-images"))
        size = F.octet_length("payload").cast("long")
        digests = back.select(
            "doc_id", "n_bytes", size.alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
            F.crc32(F.substring("payload", -WIDTH, WIDTH)).cast("long").alias("tail_crc32"),
            F.octet_length("image").cast("long").alias("media_bytes"), F.sha2("image", 256).alias("media_sha256"), "feature", "error",
        )
        return written(digests, "media-digests", result=True)
