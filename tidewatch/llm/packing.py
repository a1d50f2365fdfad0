"""Best-fit packing of documents into sequences by exact complements.

Documents over the capacity are cut; what is left of each, and each shorter document, is an item. Only the items' lengths
matter, so the packing is planned on their histogram, which has at most `capacity` rows whatever the input: an item takes the
single, then the pair, then the triple of lengths whose sum is exactly its gap, as often as the counts of the lengths allow; items without an exact
complement go by best fit. A plan is a list of patterns, each repeated, and an item finds its place from its rank among the items of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ship import ship
from .common import keep
from .tokens import BYTE_BPE, encoded, resolve

CAPACITY = 1024
END = 2
#: Parts in which items of one length are ranked.
GROUPS = 128


def pieces(docs: DataFrame, vocabulary: str = BYTE_BPE, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, text) to a row per piece. A null text counts as empty and is the end id alone; a repeated row is a document of its own."""
    ship(docs.sparkSession)
    path = resolve(vocabulary)

    def run(batches):
        for part, ids, ends in encoded(batches, path, False, end):
            sizes = np.diff(ends, prepend=0)
            times = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), times)
            k = np.arange(len(doc)) - np.repeat(np.cumsum(times) - times, times)
            # the first piece is the shorter one
            head = (sizes - (times - 1) * capacity)[doc]
            start = np.where(k > 0, head + (k - 1) * capacity, 0)
            length = np.where(k > 0, capacity, head)
            held, at = memoryview(ids.astype("<u4").tobytes()), 4 * ((ends - sizes)[doc] + start)
            crc = [zlib.crc32(held[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
            cols = (part.column(0).take(pa.array(doc)), pa.array(k, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)])
            yield pa.RecordBatch.from_arrays(list(cols), names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _complement(left: dict[int, int], lengths: list[int], gap: int, parts: int, most: int) -> tuple[int, ...] | None:
    """So many lengths in stock, none over most and long ones first, whose sum is gap."""
    if parts == 1:
        return (gap,) if gap <= most and left.get(gap, 0) > 0 else None
    for a in reversed(lengths[: bisect_right(lengths, min(gap - parts + 1, most))]):
        if parts * a < gap:
            break
        if left[a] > 0:
            left[a] -= 1
            rest = _complement(left, lengths, gap - a, parts - 1, a)
            left[a] += 1
            if rest:
                return (a, *rest)
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """counts of each length from 1 to capacity, to patterns of lengths and how often each is used.

    Pairs and triples use up short pieces, without which long ones are left with gaps. So plans with all of the pairs and triples that fit, and with
    a half, a quarter, an eighth and none of their number are made, and the one with the fewest sequences is taken, the first of equals.
    """
    plans = [_plan(counts, capacity, None)]
    used = sum(n for p, n in plans[0][0] if len(p) > 2)
    plans += [_plan(counts, capacity, used >> k) for k in (1, 2, 3)] + [_plan(counts, capacity, 0)]
    return min((exact + rest for exact, rest in plans), key=lambda p: sum(n for _, n in p))


def _plan(counts: dict[int, int], capacity: int, budget: int | None) -> tuple[list, list]:
    """Patterns that fill sequences exactly, with so many pairs and triples at most, and those of best fit for what is left."""
    left = {k: v for k, v in counts.items() if v > 0}
    exact: list[tuple[tuple[int, ...], int]] = []
    if full := left.pop(capacity, 0):
        exact.append(((capacity,), full))
    for parts in (1, 2, 3):
        # of the items over half a sequence the smallest leave the largest gaps; they go first, so that what stays open is narrow
        lengths = sorted(left)
        for big in [x for x in lengths if 2 * x > capacity] + [x for x in lengths if 2 * x <= capacity]:
            while left[big] > 0 and (parts == 1 or budget is None or budget > 0):
                left[big] -= 1  # the item itself is not part of its complement
                found = _complement(left, lengths, capacity - big, parts, big)
                left[big] += 1
                if not found:
                    break
                pattern = (big, *found)
                n = min(left[x] // pattern.count(x) for x in set(pattern))
                if parts > 1 and budget is not None:
                    n = min(n, budget)
                    budget -= n
                for x in pattern:
                    left[x] -= n
                exact.append((pattern, n))
        left = {k: v for k, v in left.items() if v}
    return exact, _best_fit(left, capacity)


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The longest items first, each into the open sequences with the least room that is enough, or else into new ones."""
    out: list[tuple[tuple[int, ...], int]] = []
    open_: list[tuple[int, tuple[int, ...], int]] = []  # (room, pattern, times), by room
    for big in sorted(left, reverse=True):
        n = left[big]
        at = bisect_right(open_, (big, (), 0))
        while n and at < len(open_):
            room, pattern, times = open_.pop(at)
            used = min(n, times)
            if times > used:
                open_.insert(at, (room, pattern, times - used))
            if room > big:
                insort(open_, (room - big, (*pattern, big), used))
            else:
                out.append(((*pattern, big), used))
            n -= used
            at = bisect_right(open_, (big, (), 0))
        if n:
            per = capacity // big
            full, rest = divmod(n, per)
            for k, times in ((per, full), (rest, 1)):
                if k and times:
                    if room := capacity - k * big:
                        insort(open_, (room, (big,) * k, times))
                    else:
                        out.append(((big,) * k, times))
    return out + [(p, k) for _, p, k in open_]


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, ranks, first sequence, copies in the pattern, offset of the first copy), ranks ascending."""
    used: dict[int, int] = {}
    out: dict[int, list] = {}
    sequence = 0
    for pattern, times in patterns:
        at = 0
        for x in sorted(set(pattern), reverse=True):
            k = pattern.count(x)
            out.setdefault(x, []).append((used.get(x, 0), k * times, sequence, k, at))
            used[x] = used.get(x, 0) + k * times
            at += k * x
        sequence += times
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces to pieces with (sequence_id long, offset long); sequences have no gaps.

    The driver gets the counts by GROUPS and length, whose number doesn't follow the input. An item's rank among those of its length is
    its place in its group after all earlier groups, so that a common length is ranked in GROUPS parts; full pieces
    are sequences of their own and need no rank. Repeated rows differ in nothing, so that they may swap places in a rerun.
    """
    ship(cut.sparkSession)
    cut = keep(cut)
    tagged = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(GROUPS)).cast("int"))
    items = tagged.where(F.col("length") < capacity)
    sizes = items.groupBy("part", "length").agg(F.count("*").alias("n")).select("part", "length", "n").toArrow()
    table = np.zeros((GROUPS, capacity), dtype=np.int64)
    part, length, n = (sizes.column(i).to_numpy() for i in range(3))
    table[part, length] = n
    patterns = plan({int(x): int(n) for x, n in enumerate(table.sum(axis=0)) if n}, capacity)
    used = sum(k for _, k in patterns)
    shared = cut.sparkSession.sparkContext.broadcast((np.cumsum(table, axis=0) - table, _slots(patterns)))

    def run(batches):
        begin, slots = shared.value
        for b in batches:
            col = {n: b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(b.schema.names) if n in ("length", "part", "rank")}
            lengths, rank = col["length"], begin[col["part"], col["length"]] + col["rank"]
            seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            order = np.argsort(lengths, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
                x = int(lengths[own[0]])
                row = slots[x][np.searchsorted(slots[x][:, 0], rank[own], side="right") - 1]
                r = rank[own] - row[:, 0]
                seq[own] = row[:, 2] + r // row[:, 3]
                off[own] = row[:, 4] + r % row[:, 3] * x
            at = [i for i, n in enumerate(b.schema.names) if n not in ("part", "rank")]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in at], pa.array(seq), pa.array(off)], names=[*[b.schema.names[i] for i in at], "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    ranked = items.withColumn("rank", F.row_number().over(Window.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32", "start")) - 1)
    full = cut.where(F.col("length") >= capacity).withColumn("sequence_id", F.monotonically_increasing_id() + F.lit(used)).withColumn("offset", F.lit(0).cast("long"))
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long").unionByName(full)


def pack_documents(docs: DataFrame, vocabulary: str = BYTE_BPE, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """documents to (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return pack(pieces(docs, vocabulary, capacity, end), capacity)
