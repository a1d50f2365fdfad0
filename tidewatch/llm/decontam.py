"""Benchmark passages in documents, by SimHash windows as long as each item.

A document's windows of an item's length, or the whole document where it is shorter than the item, are fingerprinted (128 bits over their word
shingles), a multi-index of the items' fingerprints finds all within RADIUS, and the exact similarity, the weight that two multisets of shingles share over their joint weight, decides.
A window without any shingle of the benchmark has similarity 0 to every item, so that only windows around such shingles are made.

The index cuts fingerprints into BLOCKS blocks. Two within RADIUS differ in at most RADIUS // BLOCKS bits of one block, so each block's table has
every item under all values so near to its own.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import MARKS, U64, arrow_rows, in_chunks, mix, shingle_hashes, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BITS, BLOCKS, RADIUS = 128, 16, 31
#: Items are sent out in parts of about so many bytes of text, a pass over the documents for each.
PART_BYTES = 8 << 20

_BITMAP = 20


def _signs(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash."""
    both = np.stack([h, mix(h + U64(0x9E3779B97F4A7C15))], axis=1)
    return np.unpackbits(both.view(np.uint8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


def fingerprints(h: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Rows of BITS // 8 bytes: the SimHash of h[s : s + size] for each start s."""
    lo = int(starts.min())
    part = h[lo : int(starts.max()) + size]
    sums = np.zeros((len(part) + 1, BITS), dtype=np.int32)
    np.cumsum(_signs(part), axis=0, dtype=np.int32, out=sums[1:])
    return np.packbits(sums[starts - lo + size] - sums[starts - lo] > 0, axis=1)


class HammingIndex:
    """All of the given fingerprints within RADIUS of one asked for."""

    def __init__(self, prints: np.ndarray) -> None:
        self.prints = prints
        width = BITS // BLOCKS
        near = [0]
        for d in range(1, RADIUS // BLOCKS + 1):
            near += [sum(1 << b for b in c) for c in combinations(range(width), d)]
        self.tables: list[dict[int, list[int]]] = [defaultdict(list) for _ in range(BLOCKS)]
        for i, p in enumerate(prints.tolist()):
            for t, v in zip(self.tables, p):
                for x in near:
                    t[v ^ x].append(i)

    def within(self, fingerprint: np.ndarray) -> list[int]:
        found = set()
        for t, v in zip(self.tables, fingerprint.tolist()):
            found.update(t.get(v, ()))
        if not found:
            return []
        at = np.fromiter(found, dtype=np.int64)
        return at[np.bitwise_count(self.prints[at] ^ fingerprint).sum(axis=1) <= RADIUS].tolist()


def similarity(a: Counter, b: Counter) -> float:
    shared = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return shared / (sum(a.values()) + sum(b.values()) - shared)


class Benchmark:
    """Items by length in words, with what their windows are compared with. Items without words are left out."""

    def __init__(self, items: list[tuple[int, str]], least: float = SIMILARITY) -> None:
        self.least = least
        self.kinds: dict[int, tuple[list[int], list[Counter], HammingIndex]] = {}
        # of each shingle length in use: the known shingles, and for each the lengths of the items that have it
        self.known: dict[int, tuple[np.ndarray, np.ndarray, list[tuple[int, ...]]]] = {}
        by_length = defaultdict(list)
        for i, text in items:
            words, _ = word_hashes([(text or "").lower().encode("utf-8", "replace")], MARKS)
            if len(words):
                by_length[len(words)].append((i, shingle_hashes(words, min(SHINGLE, len(words)))))
        owners: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for m, own in by_length.items():
            prints = np.concatenate([fingerprints(h, np.zeros(1, dtype=np.int64), len(h)) for _, h in own])
            self.kinds[m] = [i for i, _ in own], [Counter(h.tolist()) for _, h in own], HammingIndex(prints)
            for _, h in own:
                for x in h.tolist():
                    owners[min(SHINGLE, m)][x].add(m)
        for k, has in owners.items():
            keys = np.array(sorted(has), dtype=U64)
            bitmap = np.zeros(1 << _BITMAP, dtype=bool)
            bitmap[keys >> U64(64 - _BITMAP)] = True
            self.known[k] = bitmap, keys, [tuple(sorted(has[x])) for x in keys.tolist()]

    def search(self, shingles: dict[int, np.ndarray], seeds: dict[int, np.ndarray]) -> list[tuple[int, float, int]]:
        """(item, similarity, first word) of the best window of each item that is similar enough, in one document."""
        around = defaultdict(set)
        for k, at in seeds.items():
            h = shingles[k]
            for j in at.tolist():
                p = int(np.searchsorted(self.known[k][1], h[j]))
                for m in self.known[k][2][p]:
                    size = m - k + 1
                    around[m].update(range(max(0, j - size + 1), min(j, max(0, len(h) - size)) + 1))
        best: dict[int, tuple[float, int]] = {}
        for m, starts in around.items():
            k = min(SHINGLE, m)
            h, order = shingles[k], np.array(sorted(starts), dtype=np.int64)
            size = min(m - k + 1, len(h))
            ids, bags, index = self.kinds[m]
            for run in np.split(order, np.flatnonzero(np.diff(order) > 4 * size) + 1):
                for s, p in zip(run.tolist(), fingerprints(h, run, size)):
                    if near := index.within(p):
                        bag = Counter(h[s : s + size].tolist())
                        for i in near:
                            v = similarity(bag, bags[i])
                            if v >= self.least and (ids[i] not in best or v > best[ids[i]][0]):
                                best[ids[i]] = v, s
        return [(i, v, s) for i, (v, s) in sorted(best.items())]


def _hits(bench: Benchmark, texts: list[str | None]):
    """The matches of each text."""
    words, counts = word_hashes([(t or "").lower().encode("utf-8", "replace") for t in texts], MARKS)
    ends = np.cumsum(counts)
    begins = ends - counts
    found: dict[int, dict[int, np.ndarray]] = defaultdict(dict)
    hashes = {}
    for k, (bitmap, keys, _) in bench.known.items():
        if len(words) < k:
            continue
        h = hashes[k] = shingle_hashes(words, k)
        at = np.flatnonzero(bitmap[h >> U64(64 - _BITMAP)])
        p = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
        at = at[keys[p] == h[at]]
        doc = np.searchsorted(ends, at, side="right")
        inside = at + k <= ends[doc]
        at, doc = at[inside], doc[inside]
        for own in np.split(np.arange(len(at)), np.flatnonzero(np.diff(doc)) + 1) if len(at) else []:
            found[int(doc[own[0]])][k] = at[own] - begins[doc[own[0]]]
    out: list[list] = [[] for _ in texts]
    for d, seeds in found.items():
        mine = {k: h[begins[d] : max(begins[d], ends[d] - k + 1)] for k, h in hashes.items()}
        out[d] = bench.search(mine, seeds)
    return out


def _parts(benchmark: DataFrame, part_bytes: int) -> list[DataFrame]:
    """Items of about so many bytes each; all rows of an id are in one, where its best match is taken."""
    n = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // part_bytes + 1
    return [benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i) for i in range(n)]


def matches(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, text) and (item_id, text) to (doc_id, item_id, similarity, first_word), a row for each item found in a document row.

    Words are runs of letters and digits, in lower case. An item is compared with each window of as many words, and with the whole document where that
    has fewer. Null and empty texts have none and match nothing. Items of fewer than five words are one
    shingle and match exactly. An item id that repeats keeps its best match. Empty tables give no rows.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for part in _parts(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), part_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(Benchmark([(r["item_id"], r["text"]) for r in part.collect()], least))

        def run(batches, shared=shared):
            for chunk in in_chunks(arrow_rows(batches, "doc_id", "text"), 1):
                rows = [(d, *x) for (d, _), own in zip(chunk, _hits(shared.value, [t for _, t in chunk])) for x in own]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names=["doc_id", "item_id", "similarity", "first_word"])

        found = docs.mapInArrow(run, "doc_id long, item_id long, similarity double, first_word long")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of documents, columns and all, in which no item is found. The decision is on the row itself."""
    ship(docs.sparkSession)
    for part in _parts(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), part_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(Benchmark([(r["item_id"], r["text"]) for r in part.collect()], least))

        def run(batches, shared=shared):
            for b in batches:
                good = [not own for chunk in in_chunks(arrow_rows([b], "text"), 0) for own in _hits(shared.value, [t for (t,) in chunk])]
                if good:
                    yield b.filter(pa.array(good))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
