"""What the operators share: tables in the shared folder, words, and reading the input tables."""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.sources.shared import drop_stored, made, shared_dir, stored  # noqa: F401

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after A-Z went to lower case stay; all others become blanks.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: A-Z to lower case, the rest as it is; ``bytes.split()`` then cuts at ``[\x20\x09-\x0D]``.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(data: bytes, table: bytes, piece: int = 1 << 22):
    """Lists of the words of ``data``, in order; a very long text comes in several lists, cut between words."""
    flat = data.translate(table)
    start = 0
    while len(flat) - start > piece:
        end = flat.find(b" ", start + piece)
        if end < 0:
            break
        yield flat[start:end].split()
        start = end
    yield flat[start:].split()


def pack(values: np.ndarray) -> bytes:
    """An array of whole numbers, compressed by planes of equal bytes."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def row_key(id_col: str, text_col: str = "text") -> Column:
    """The text's md5 and the id as text: the same for rows that share both, and never null."""
    hashed = [F.md5(F.col(text_col).cast("string").cast("binary")), F.col(id_col).cast("string")]
    return F.concat_ws(":", *[F.coalesce(x, F.lit("-")) for x in hashed])


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text."""
    return F.crc32(doc_id.cast("string"))
