"""What the text operators share: table access, the shared folder, byte and word hashing in numpy."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

U64 = np.uint64
#: Base of the polynomial hashes and its inverse, modulo 2**64. Any odd number has an inverse.
BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns of any name cannot clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a temporary one is made where it names none and all run on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="tidewatch-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def keep(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder."""
    ship(df.sparkSession)
    shared_folder(df.sparkSession)
    return df.checkpoint()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n at least."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(1 << 20, 1 << int(n - 1).bit_length())
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            out = np.full(size, base, dtype=U64)
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


#: The scrambled pairs of a byte and its place among the first of a word.
_PAIRS = mix((np.arange(64, dtype=U64)[:, None] << U64(8) | np.arange(256, dtype=U64)) + U64(0x2545F4914F6CDD1D))


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """p with p[j] - p[i] = sum of (codes[t] + 1) * BASE**t for i <= t < j."""
    up, _ = powers(len(codes) + 1)
    out = np.empty(len(codes) + 1, dtype=U64)
    out[0] = 0
    v = codes.astype(U64)
    v += U64(1)
    v *= up[: len(codes)]
    np.cumsum(v, out=out[1:])
    return out


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII other than letters and digits.
MARKS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def word_hashes(texts: list[bytes], between: np.ndarray = _SPACE, stem: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs without ASCII white space or what else stands between them, A-Z lower-cased) of all texts in a row, and the words' number in each text.

    With stem the hashes are of each word's first bytes, so many at most, and which words are longer comes in the place of the numbers.

    A word's hash is the sum of scrambled (byte, place in the word) pairs, scrambled, which has no structure that words could be made to collide by.
    """
    buf = b"\n".join(texts).lower() + b"\n"
    codes = np.frombuffer(buf, dtype=np.uint8)
    inside = ~between[codes]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=np.int8(0)))
    starts, size = edge[0::2], edge[1::2] - edge[0::2]
    if stem:
        longer, size = size > stem, np.minimum(size, stem)
        inside = np.zeros(len(codes), dtype=bool)
        inside[np.repeat(starts - np.cumsum(size) + size, size) + np.arange(int(size.sum()))] = True
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    if len(place) and place.max() < len(_PAIRS):
        sums = _PAIRS[place, codes[inside]]
    else:
        sums = mix((place.astype(U64) << U64(8) | codes[inside]) + U64(0x2545F4914F6CDD1D))
    words = mix(np.add.reduceat(sums, np.cumsum(size) - size)) if len(size) else np.empty(0, dtype=U64)
    if stem:
        return words, longer
    at = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    upto = np.searchsorted(starts, at)
    return words, np.diff(upto, prepend=0)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words."""
    n = len(words) - k + 1
    out = np.full(n, k, dtype=U64)
    for i in range(k):
        out *= U64(0xA0761D6478BD642F)
        out += words[i : i + n]
        out ^= out >> U64(29)
    return mix(out)


def in_chunks(rows: Iterable[tuple], text_at: int, size: int = 1 << 21) -> Iterator[list[tuple]]:
    """Rows in lists of about size bytes of text."""
    out, n = [], 0
    for r in rows:
        out.append(r)
        n += len(r[text_at] or b"") + 1
        if n >= size:
            yield out
            out, n = [], 0
    if out:
        yield out


def arrow_rows(batches: Iterable, *names: str) -> Iterator[tuple]:
    """Rows of record batches as tuples of the named columns, a few at a time so that long texts are not all objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            yield from zip(*[part.column(part.schema.get_field_index(n)).to_pylist() for n in names])
