"""Token ids as wavelet matrices, a shard of whole documents to a file.

A file is: the magic "TWM2"; six little-endian unsigned 64-bit integers (ids, planes, documents, bytes of the compressed document table, bytes of a plane
that a frame holds, reserved); for each plane, from the highest bit, its number of zeros (unsigned 64-bit), the ones before each of its frames and
where each frame begins in the file (unsigned 64-bit both, the latter with the end of the last); the documents' ids (signed 64-bit) and lengths (unsigned
64-bit) in order, zstd-compressed; the frames: bits in little-endian order, zstd-compressed each. Ids may take up to 32 planes. Access, counting and
occurrence lookup inflate the frames that they touch and no others.

Shards are rows (shard, payload) of a table that Spark writes, so that they reach any store that the session reaches, a lost
executor's shards are written again, and a half-written file is never seen.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..ship import ship
from .common import arrow_rows, keep
from .tokens import WORD_BPE, encoded, resolve

MAGIC, _HEAD = b"TWM2", struct.Struct("<6Q")
END = 1
#: Bytes of a plane in a frame.
FRAME = 1 << 13
#: Stands for a null id in a file.
NULL_ID = -(1 << 63)
#: A shard is closed after the document that takes it to so many ids.
SHARD_IDS = 1 << 20
#: Bytes of text that are encoded at a time, which is a shard's text or more, and pieces that a worker remembers, between tasks as well.
SLICE_BYTES, PIECES = 1 << 22, 300_000


def dump(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, frame: int = FRAME) -> bytes:
    """The file of the ids of documents in a row."""
    packer = zstandard.ZstdCompressor(level=1)
    n_planes = max(1, int(ids.max(initial=0)).bit_length())
    n_frames = -(-len(ids) // (8 * frame))
    docs = packer.compress(doc_ids.astype("<i8").tobytes() + lengths.astype("<u8").tobytes())
    at = len(MAGIC) + _HEAD.size + n_planes * 8 * (2 + 2 * n_frames) + len(docs)
    index, frames = [], []
    rest = ids.astype(np.uint16 if n_planes <= 16 else np.uint32)
    for bit in range(n_planes - 1, -1, -1):
        on = (rest & rest.dtype.type(1 << bit)).astype(bool)
        plane = np.packbits(on, bitorder="little")
        ones = np.add.reduceat(np.bitwise_count(plane), np.arange(0, len(plane), frame), dtype=np.uint64) if len(plane) else np.empty(0, np.uint64)
        own = [packer.compress(plane[i : i + frame].tobytes()) for i in range(0, len(plane), frame)]
        ends = at + np.cumsum([0, *map(len, own)])
        at = int(ends[-1])
        frames += own
        # places are faster to take than masks where bits are in no order
        zeros, rest = rest.take(np.flatnonzero(~on)), rest.take(np.flatnonzero(on))
        index += [np.array([len(zeros)]), np.cumsum(ones) - ones, ends]
        rest = np.concatenate([zeros, rest])
    return b"".join([MAGIC, _HEAD.pack(len(ids), n_planes, len(doc_ids), len(docs), frame, 0), *[x.astype("<u8").tobytes() for x in index], docs, *frames])


class Wavelet:
    """Rank and select over the ids of one shard, from its file."""

    def __init__(self, payload: bytes) -> None:
        if payload[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet shard")
        self.payload = payload
        self.n, n_planes, n_docs, docs, self.frame, _ = _HEAD.unpack_from(payload, len(MAGIC))
        n_frames = -(-self.n // (8 * self.frame))
        at = len(MAGIC) + _HEAD.size
        index = np.frombuffer(payload, "<u8", n_planes * (2 + 2 * n_frames), at).astype(np.int64).reshape(n_planes, -1)
        self.zeros, self.before, self.ends = index[:, 0].tolist(), index[:, 1 : 1 + n_frames], index[:, 1 + n_frames :]
        at += index.nbytes
        if len(payload) != self.ends[-1, -1]:
            raise ValueError("a damaged wavelet shard")
        self._zstd = zstandard.ZstdDecompressor()
        held = self._zstd.decompress(payload[at : at + docs])
        self.doc_ids, self.lengths = np.frombuffer(held, "<i8", n_docs), np.frombuffer(held, "<u8", n_docs, 8 * n_docs).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        self._frames: dict[tuple[int, int], np.ndarray] = {}

    @property
    def inflated(self) -> int:
        """Frames that have been inflated so far."""
        return len(self._frames)

    def _bits(self, k: int, j: int) -> np.ndarray:
        """Bytes of frame j of plane k."""
        if (k, j) not in self._frames:
            self._frames[k, j] = np.frombuffer(self._zstd.decompress(self.payload[self.ends[k, j] : self.ends[k, j + 1]]), np.uint8)
        return self._frames[k, j]

    def _ones(self, k: int, i: int) -> int:
        """Ones of plane k before position i."""
        if i >= self.n:
            return self.n - self.zeros[k]
        j, i = divmod(i, 8 * self.frame)
        bits = self._bits(k, j)
        n = int(self.before[k, j]) + int(np.bitwise_count(bits[: i >> 3]).sum(dtype=np.int64))
        return n + (int(bits[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count()

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, zeros in enumerate(self.zeros):
            j, r = divmod(i, 8 * self.frame)
            bit, ones = int(self._bits(k, j)[r >> 3]) >> (r & 7) & 1, self._ones(k, i)
            value = value << 1 | bit
            i = zeros + ones if bit else i - ones
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the token's occurrences among positions lo to hi stand below the last plane."""
        if token < 0 or token >> len(self.zeros):
            return 0, 0
        for k, zeros in enumerate(self.zeros):
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = (zeros + a, zeros + b) if token >> (len(self.zeros) - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of the token among positions lo to hi."""
        hi = self.n if hi is None else min(hi, self.n)
        a, b = self._range(token, min(max(lo, 0), hi), hi)
        return b - a

    def _select_bit(self, k: int, bit: int, r: int) -> int:
        """Position of the r-th (from 0) such bit of plane k."""
        had = self.before[k] if bit else np.arange(self.before.shape[1]) * 8 * self.frame - self.before[k]
        j = int(np.searchsorted(had, r, side="right")) - 1
        bits = np.unpackbits(self._bits(k, j), bitorder="little")[: self.n - j * 8 * self.frame]
        return j * 8 * self.frame + int(np.flatnonzero(bits == bit)[r - int(had[j])])

    def select(self, token: int, r: int) -> int:
        """Position of the r-th (from 0) occurrence of the token."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= r < hi - lo:
            raise IndexError(r)
        i = lo + r
        for k in range(len(self.zeros) - 1, -1, -1):
            bit = token >> (len(self.zeros) - 1 - k) & 1
            i = self._select_bit(k, bit, i - self.zeros[k] if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, r) for r in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids in order: the planes undone from the last."""
        kind = np.uint16 if len(self.zeros) <= 16 else np.uint32
        ids = np.zeros(self.n, dtype=kind)
        for k in range(len(self.zeros) - 1, -1, -1):
            held = [self._zstd.decompress(self.payload[a:b]) for a, b in zip(self.ends[k, :-1], self.ends[k, 1:])]
            on = np.unpackbits(np.frombuffer(b"".join(held), np.uint8), bitorder="little")[: self.n].astype(bool)
            # the order after plane k is its zeros and then its ones; put back what lower planes gave
            back = np.empty(self.n, dtype=kind)
            z = self.zeros[k]
            back[np.flatnonzero(~on)], back[np.flatnonzero(on)] = ids[:z], ids[z:] | kind(1 << (len(self.zeros) - 1 - k))
            ids = back
        return ids


def write_shards(docs: DataFrame, path: str, vocabulary: str = WORD_BPE, end: int = END, shard_ids: int = SHARD_IDS) -> None:
    """Encode (doc_id, text), in ascending doc_id order, into the table at path: (part int, shard int, payload binary).

    A null text counts as empty and is the end id alone. Rows of one id stay apart, ordered by their text; null ids come first
    and are stored as the lowest 64-bit integer. Shards of one part follow each other by their number, and parts by theirs.
    """
    ship(docs.sparkSession)
    vocab = resolve(vocabulary)

    def shard(batches):
        ids, doc_ids, lengths, size, k, part = [], [], [], 0, 0, None

        def close():
            held = dump(np.concatenate(ids), np.concatenate(doc_ids), np.concatenate(lengths))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([held], pa.binary())], names=["part", "shard", "payload"])

        for b, x, ends in encoded(batches, vocab, True, end, SLICE_BYTES, PIECES, PIECES):
            part = b.column(2)[0].as_py()
            names, sizes = b.column(0).fill_null(NULL_ID).to_numpy(), np.diff(ends, prepend=0)
            at = 0
            while at < len(sizes):
                begin = int(ends[at - 1]) if at else 0
                # up to the document that fills the shard
                to = min(len(sizes), int(np.searchsorted(ends, begin + shard_ids - size, side="left")) + 1)
                ids.append(x[begin : ends[to - 1]])
                doc_ids.append(names[at:to])
                lengths.append(sizes[at:to])
                size += len(ids[-1])
                at = to
                if size >= shard_ids:
                    yield close()
                    ids, doc_ids, lengths, size, k = [], [], [], 0, k + 1
        if ids:
            yield close()

    # texts are dealt out by range and encoded there, as the ranges are found in a pass of its own over what comes before
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())
    ranged.mapInArrow(shard, "part int, shard int, payload binary").write.mode("overwrite").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """A row per shard, read from its file: (part, shard, n long, docs array of (doc_id, n_tokens, ids_crc32, in_shard))."""

    def run(batches):
        for part, shard, payload in arrow_rows(batches, "part", "shard", "payload"):
            w = Wavelet(payload)
            ids = memoryview(w.decode().astype("<u4").tobytes())
            rows = [{"doc_id": None if d == NULL_ID else int(d), "n_tokens": int(b - a), "ids_crc32": zlib.crc32(ids[4 * a : 4 * b]), "in_shard": int(a)} for d, a, b in zip(w.doc_ids, w.starts[:-1], w.starts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([w.n], pa.int64()), pa.array([rows], kind)], names=["part", "shard", "n", "docs"])

    kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("doc_id", "n_tokens", "ids_crc32", "in_shard")]))
    return spark.read.parquet(path).mapInArrow(run, "part int, shard int, n long, docs array<struct<doc_id: long, n_tokens: long, ids_crc32: long, in_shard: long>>")


def encode_documents(docs: DataFrame, path: str, vocabulary: str = WORD_BPE, end: int = END, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write documents as shards at path and read them back: (doc_id, start, n_tokens, ids_crc32), start the ids of all documents before."""
    write_shards(docs, path, vocabulary, end, shard_ids)
    found = keep(read_shards(docs.sparkSession, path))
    sizes = found.select("part", "shard", "n")
    in_part = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    # a row for each range partition: their number is a setting, not the input's
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.withColumn("parts_before", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", "parts_before")
    begin = in_part.join(parts, "part").select("part", "shard", (F.coalesce("before", F.lit(0)) + F.coalesce("parts_before", F.lit(0))).alias("begin"))
    return found.join(begin, ["part", "shard"]).select("begin", F.inline("docs")).select("doc_id", (F.col("begin") + F.col("in_shard")).cast("long").alias("start"), "n_tokens", "ids_crc32")
