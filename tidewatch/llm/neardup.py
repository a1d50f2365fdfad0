"""Exact Jaccard join of documents on word n-grams, by T-occurrence search.

Two sets with |x & y| / |x | y| >= t differ in at most (1 - t) * |x | y| elements. So, where hashes deal the elements into one more
bucket than that, two linked sets hold the same elements in one bucket or more. Those buckets' signatures route documents into
groups in which every link lies; a group is searched as an inverted index of its documents: a query's set must share T elements
with a partner, the longest of its lists are set aside, the others are merged on a heap for what stands in at least as many of them as T
asks for beyond the long ones, and what is found is probed for in the long lists by binary search until T is reached or can't be (DivideSkip).

Documents with the same set are one in the search, and the one with the smallest id stands for all. Groups of more than BLOCK elements are routed again,
by other hashes and within the group, as chance that joined unrelated documents rarely does so twice. What is still larger is cut into
blocks of about BLOCK elements. Within a block all sets are searched. Across the blocks of a group a few queries at a time meet all blocks,
beginning with one; those that are linked to the group's largest component by then need no more, and rounds go on until every other document
has been a query. No link between different sets is lost, and no round makes pairs.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import U64, arrow_rows, in_chunks, keep, mix, shingle_hashes, word_hashes
from .graph import components, lowest, relabel

#: Set elements searched against each other in one task.
BLOCK = 1 << 20
#: Elements that occur in so many documents of a drawn sample are common, in tiers. They steer the routing and change no result.
SAMPLE_DOCS, TIERS, MAX_COMMON = 20_000, (2, 200), 500_000
#: Times that large groups are routed again.
REROUTES = 2
#: Queries of a group that meet all of its blocks in one round after the first, and how their number grows.
QUERIES, QUERY_GROWTH = 64, 8
#: DivideSkip's trade-off between merging and probing.
MU = 0.0085
#: Signatures that are dealt at a time, bytes of text for each task in which signatures meet, and the fewest parts in which they do.
#: With fewer parts than a document has signatures more of its links would come up in one part: the rows would grow faster than the input.
DEALT, PART_BYTES, MIN_PARTS = 1 << 20, 1 << 24, 64


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes, ascending, of the k-word shingles; of the whole sequence if there are fewer words; none without words."""
    if not len(words):
        return np.empty(0, dtype=U64)
    h = np.sort(shingle_hashes(words, min(k, len(words))))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def least_overlap(a: int, b: int, num: int, den: int) -> int:
    """The smallest i with i / (a + b - i) >= num / den."""
    return -(-num * (a + b) // (num + den))


def _bands(num: int, den: int, upto: int) -> list[int]:
    """Set sizes where bands begin; sets that link are in one band or in neighbours."""
    out = [1]
    while out[-1] <= upto or len(out) < 3:
        out.append(out[-1] * den // num + 1)
    return out


_BANDS: dict[tuple[int, int], list[int]] = {}


def _plan(n: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """For a set of n elements: (band, buckets, spare ones) of the two band pairs that its links lie in."""
    bands = _BANDS.setdefault((num, den), [1])
    if bands[-1] <= n:
        bands[:] = _bands(num, den, 2 * n)
    own = bisect_right(bands, n) - 1
    out = []
    for g in {own, max(own - 1, 0)}:
        # the smaller of two linked sets of bands g and g + 1 is below where g + 1 begins, and their union is at most den / num as large
        most, spare = (bands[g + 1] - 1) * den // num * (den - num) // den, 0
        for _ in range(4 * bool(most)):
            empty = (most + 1 + spare) * math.exp(-bands[g] / (most + 1 + spare))
            spare = math.ceil(empty + 4 * math.sqrt(empty) + 1)
        out.append((g, most + 1 + spare, spare))
    return out


#: Edges of so many buckets at most are kept by a worker.
KEPT_EDGES = 512
_EDGES: dict[int, np.ndarray] = {}


def signatures(h: np.ndarray, num: int, den: int, common: tuple[np.ndarray, ...] = ()) -> np.ndarray:
    """Keys of which two linked sets share one at least. h: a set's hashes, ascending.

    Sets that share nothing but common elements meet too often. So buckets are filled without the elements in common[0] if that
    leaves no more of them empty than are spare; else without those in common[1] as well, and so on, at last with all elements. Leaving elements
    out of all sets alike spoils no bucket, and of two linked sets either both fall back or one agrees with the other in a bucket that is not empty.
    """
    n, out, parts = len(h), [], {}
    if not n:
        return np.empty(0, dtype=U64)
    for g, k, spare in _plan(n, num, den):
        edges = _EDGES.get(k)
        if edges is None:
            edges = (np.arange(1, k, dtype=np.float64) / k * 2.0**64).astype(U64)
            if k <= KEPT_EDGES:
                _EDGES[k] = edges
        for tier in range(len(common) + 1):
            if tier not in parts:
                s = h
                if tier < len(common) and len(common[tier]):
                    at = np.minimum(np.searchsorted(common[tier], h), len(common[tier]) - 1)
                    s = h[common[tier][at] != h]
                parts[tier] = s, np.concatenate([np.zeros(1, dtype=U64), np.cumsum(mix(s))])
            s, sums = parts[tier]
            at = np.concatenate([[0], np.searchsorted(s, edges), [len(s)]])
            empty = at[1:] == at[:-1]
            key = mix((sums[at[1:]] - sums[at[:-1]]) ^ mix(np.arange(k, dtype=U64) + U64((g * 0x1000003D + k * 0x10001 + tier * 0x7FFFFFFF001 + 7) & (2**64 - 1))))
            if empty.sum() <= spare:
                out.append(key[~empty])
                break
            # too little is left in the buckets: where all elements are in, the empty buckets count as well
            out.append(key if tier == len(common) else key[~empty])
    return np.concatenate(out)


def merge_lists(short: list[list[int]], need: int):
    """(id, occurrences) of the ids in at least need of the ascending lists, by a heap merge that skips what can't be."""
    heap = [(x[0], i) for i, x in enumerate(short)]
    heapq.heapify(heap)
    at = [0] * len(short)

    def push(i: int, place: int) -> None:
        at[i] = place
        if place < len(short[i]):
            heapq.heappush(heap, (short[i][place], i))

    while len(heap) >= need:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= need:
            yield top, len(popped)
            for i in popped:
                push(i, at[i] + 1)
        else:
            # need - 1 lists are taken off, and all of them go on to the new top at once
            while heap and len(popped) < need - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                break
            nxt = heap[0][0]
            for i in popped:
                push(i, bisect_left(short[i], nxt, at[i]))


def t_occurrence(lists: list[np.ndarray], t: int, n_long: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids in at least t of the ascending lists, ascending, and in how many they are, by DivideSkip: the n_long longest lists (by default as many as
    balance merging and probing) are set aside and probed by binary search for what the others leave, until t is out of reach."""
    if t <= 0:
        raise ValueError("t must be positive")
    lists = sorted((x for x in lists if len(x)), key=len)
    if len(lists) < t:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    if n_long is None:
        n_long = int(t / (MU * math.log2(max(2, len(lists[-1]))) + 1))
    n_long = max(0, min(t - 1, n_long))
    merged = list(merge_lists([x.tolist() for x in lists[: len(lists) - n_long]], t - n_long))
    ids, counts = (np.array([x[i] for x in merged], dtype=np.int64) for i in (0, 1))
    for j, x in enumerate(lists[len(lists) - n_long :]):
        if not len(ids):
            break
        place = np.minimum(np.searchsorted(x, ids), len(x) - 1)
        counts += x[place] == ids
        able = counts + (n_long - 1 - j) >= t
        if not able.all():
            ids, counts = ids[able], counts[able]
    return ids, counts


def search_block(sets: list[np.ndarray], num: int, den: int, queries: list[int] | None = None) -> list[tuple[int, int]]:
    """Pairs (i, j) of sets that link, found from each query, or from all sets against the ones before; pairs whose ends are already joined through others are left out."""
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out: list[tuple[int, int]] = []

    def join(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((i, j))

    first: dict[bytes, int] = {}
    distinct = []
    for i, s in enumerate(sets):
        if not len(s):
            continue
        k = first.setdefault(s.tobytes(), i)
        if k != i:
            join(k, i)
        else:
            distinct.append(i)
    if len(distinct) < 2:
        return out
    distinct.sort(key=lambda i: (len(sets[i]), i))
    asked = None if queries is None else {first[sets[i].tobytes()] for i in queries if len(sets[i])}
    # the inverted lists of all elements in a row; places in them are ranks by size, so that a query's partners are a range of them
    sizes = np.array([len(sets[i]) for i in distinct], dtype=np.int64)
    ends = np.cumsum(sizes)
    _, element = np.unique(np.concatenate([sets[i] for i in distinct]), return_inverse=True)
    df = np.bincount(element)
    list_at = np.cumsum(df) - df
    postings = np.repeat(np.arange(len(distinct)), sizes)[np.argsort(element, kind="stable")]
    links = np.zeros(len(distinct), dtype=np.int64)
    owner = np.arange(len(distinct))  # by rank: the component, brought up to date when it changes
    hub = 0
    for r, i in enumerate(distinct):
        if asked is not None and i not in asked:
            continue
        n = int(sizes[r])
        lo = int(np.searchsorted(sizes, -(-num * n // den)))
        hi = r if asked is None else int(np.searchsorted(sizes, n * den // num, side="right"))
        if hi - lo < 1 or (hi - lo == 1 and lo == r):
            continue
        own = element[ends[r] - n : ends[r]]
        shared = own[df[own] > 1]
        t = least_overlap(n, int(sizes[lo]), num, den)
        if len(shared) < t:
            continue

        def linked(c: int, common: int, r: int = r, i: int = i, n: int = n) -> None:
            nonlocal hub
            if common < least_overlap(n, int(sizes[c]), num, den) or owner[c] == owner[r]:
                return
            join(distinct[c], i)
            links[[c, r]] += 1
            hub = max((hub, c, r), key=lambda x: links[x])
            # the smaller rank of a component is its name
            a, b = sorted((owner[c], owner[r]))
            owner[owner == b] = a

        # the document with the most links comes first: what it links to needs no further look at that component
        if lo <= hub < hi and owner[hub] != owner[r]:
            linked(hub, len(np.intersect1d(element[ends[hub] - sizes[hub] : ends[hub]], own, assume_unique=True)))
        apart = owner != owner[r]
        apart[:lo] = False
        apart[hi:] = False
        if not apart.any():
            continue
        lists = []
        for e in shared.tolist():
            x = postings[list_at[e] : list_at[e] + df[e]]
            if len(x := x[apart[x]]):
                lists.append(x)
        for c, common in zip(*(x.tolist() for x in t_occurrence(lists, t))):
            linked(c, common)
    return out


def _sets(rows, k: int):
    for chunk in in_chunks(((*r[:-1], (r[-1] or "").encode("utf-8", "surrogatepass")) for r in rows), -1):
        words, counts = word_hashes([r[-1] for r in chunk])
        at = 0
        for r, n in zip(chunk, counts):
            yield (*r[:-1], shingle_set(words[at : at + n], k))
            at += n


def _set_keys(h: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set, by which equal sets are told."""
    if not len(h):
        return 0, 0
    return int(mix(h).sum(dtype=U64).view(np.int64)), int(mix(h * U64(0x9FB21C651E98DF25) + U64(1)).sum(dtype=U64).view(np.int64))


#: A part of the signatures of a chunk of documents: their ids less base, how many signatures each has, and these in order, low and high bits apart.
_DEALT = "part int, base long, docs binary, counts binary, low binary, high binary"
#: A set's size and keys, or a pair.
_ROUTED = "kind int, a long, b long, c long, d long"
_SIZE, _PAIR = 0, 1


def _routed_batch(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    columns = [*columns, *[np.zeros(len(columns[0]), dtype=np.int64)] * (4 - len(columns))]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, dtype=np.int32)), *[pa.array(x, pa.int64()) for x in columns]], names=["kind", "a", "b", "c", "d"])


def _pack(parts: int, ids: np.ndarray, each: np.ndarray, keys: np.ndarray, sizes: list[tuple]) -> pa.RecordBatch:
    """A row for each part that has signatures, and one, of a negative part, for the sizes and set keys."""
    rows = [(-1 - int(ids[0]) % parts, 0, ids.astype("<i8").tobytes(), b"", np.array(sizes, dtype="<i8").tobytes(), b"")]
    at = ((keys >> U64(48)) % U64(parts)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    at, keys, doc = at[order], keys[order], np.repeat(np.arange(len(ids)), each)[order]
    base = int(ids.min())
    ids = ids - base
    kind = "<u4" if ids.max() < 1 << 32 else "<i8"
    cuts = np.flatnonzero(np.diff(at, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(at)]):
        own = np.flatnonzero(np.diff(doc[a:b], prepend=-1))
        counts = np.diff(np.append(own, b - a))
        k = keys[a:b]
        rows.append((int(at[a]), base, ids[doc[a:b][own]].astype(kind).tobytes(), counts.astype("<u4").tobytes(), k.astype("<u4").tobytes(), (k >> U64(32)).astype("<u2").tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), *[pa.binary()] * 4))], names=["part", "base", "docs", "counts", "low", "high"])


def _stars(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest, other) documents of each key, each pair once."""
    order = np.argsort(keys, kind="stable")
    keys, doc = keys[order], doc[order]
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(cuts, len(keys)))
    hub = np.repeat(np.minimum.reduceat(doc, cuts), size)
    other = hub != doc
    pairs = np.unique(np.stack([hub[other], doc[other]], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _meet(batches):
    """Parts in order: links the documents of each signature with the smallest of them, and through these with the smallest that they reach in the part."""
    part, keys, docs = None, [], []

    def close():
        if keys:
            b, a = lowest(*_stars(np.concatenate(keys), np.concatenate(docs)))
            if len(a):
                yield _routed_batch(_PAIR, a[a != b], b[a != b])

    for p, base, ids, counts, low, high in arrow_rows(batches, "part", "base", "docs", "counts", "low", "high"):
        if p < 0:
            x = np.frombuffer(low, "<i8").reshape(-1, 3)
            yield _routed_batch(_SIZE, np.frombuffer(ids, "<i8"), x[:, 0], x[:, 1], x[:, 2])
            continue
        if p != part:
            yield from close()
            part, keys, docs = p, [], []
        counts = np.frombuffer(counts, "<u4")
        keys.append(np.frombuffer(low, "<u4").astype(U64) | np.frombuffer(high, "<u2").astype(U64) << U64(32))
        docs.append(np.repeat(np.frombuffer(ids, "<u4" if len(ids) == 4 * len(counts) else "<i8").astype(np.int64) + base, counts))
    yield from close()


def _routed(rows: DataFrame, signed, n_bytes: int) -> DataFrame:
    """rows to _ROUTED rows: each set's size and keys, and pairs that chain up documents with a signature in common. signed: batches to (id, set, signatures)."""
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // PART_BYTES))
    parts = tasks * -(-MIN_PARTS // tasks)

    def deal(batches):
        sig, who, sizes, seen, n = [], [], [], {}, 0

        def flush():
            ids, each = (np.array(x, dtype=np.int64) for x in zip(*who))
            yield _pack(parts, ids, each, np.concatenate(sig), sizes)

        for d, h, s in signed(batches):
            k = _set_keys(h)
            # a set that the chunk has already: its signatures need not go again if the documents are joined here
            if len(s):
                if (one := seen.setdefault(k, d)) != d:
                    s = mix(np.array([one], dtype=np.int64).view(U64))
                else:
                    s = np.append(s, mix(np.array([d], dtype=np.int64).view(U64)))
            sig.append(s)
            who.append((d, len(s)))
            sizes.append((len(h), *k))
            n += len(s)
            if n > DEALT:
                yield from flush()
                sig, who, sizes, seen, n = [], [], [], {}, 0
        if who:
            yield from flush()

    return rows.mapInArrow(deal, _DEALT).repartitionById(tasks, F.pmod("part", F.lit(tasks)).cast("int")).sortWithinPartitions("part").mapInArrow(_meet, _ROUTED)


def common_shingles(docs: DataFrame, k: int, n_docs: int, sample_docs: int = SAMPLE_DOCS) -> tuple[np.ndarray, ...]:
    """Hashes of shingles in several documents of a sample, ascending, a tier for each of TIERS; at most MAX_COMMON."""
    share = min(1.0, sample_docs / max(1, n_docs))
    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)

    def run(batches):
        for _, h in _sets(arrow_rows(batches, "doc_id", "text"), k):
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    counts = keep(drawn.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= TIERS[0]))
    total, least = 0, None
    for n, times in sorted(((r["n"], r["times"]) for r in counts.groupBy("n").agg(F.count("*").alias("times")).collect()), reverse=True):
        total += times
        if total > MAX_COMMON:
            break
        least = n
    if least is None:
        return ()
    got = counts.where(F.col("n") >= least).select("h", "n").toArrow()
    h, n = (got.column(i).to_numpy() for i in (0, 1))
    h = h.view(U64)
    tiers = [np.sort(h[n >= t]) for t in TIERS]
    return tuple(t for t in tiers if len(t))


def route(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, text) to _ROUTED rows."""
    n_docs, n_bytes = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, k, n_docs))

    def signed(batches):
        for d, h in _sets(arrow_rows(batches, "doc_id", "text"), k):
            yield d, h, signatures(h, num, den, shared.value)

    return _routed(docs, signed, n_bytes)


def reroute(members: DataFrame, k: int, num: int, den: int, seed: int, n_bytes: int) -> DataFrame:
    """(doc_id, component, text) to (node, component): smaller groups within the given ones; documents alone are left out."""

    def signed(batches):
        for d, c, h in _sets(arrow_rows(batches, "doc_id", "component", "text"), k):
            x = np.sort(mix(h ^ U64(0x5851F42D4C957F2D * (seed + 1) & (2**64 - 1))))
            yield d, x, mix(signatures(x, num, den) ^ mix(np.array([c], dtype=np.int64).view(U64)))

    return components(_routed(members.select("doc_id", "component", "text"), signed, n_bytes).where(F.col("kind") == _PAIR).select("a", "b"))


def _search(rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(component, salt, doc_id, text, q) to links (a, b), block by block: between all documents where none is a query, else from the queries."""

    def close(own):
        if len(own) > 1:
            asked = [i for i, x in enumerate(own) if x[3]]
            if found := search_block([x[4] for x in own], num, den, asked or None):
                yield pa.RecordBatch.from_arrays([pa.array([own[i][2] for i, _ in found], pa.int64()), pa.array([own[j][2] for _, j in found], pa.int64())], names=["a", "b"])

    def run(batches):
        own: list[tuple] = []
        for x in _sets(arrow_rows(batches, "component", "salt", "doc_id", "q", "text"), k):
            if own and own[0][:2] != x[:2]:
                yield from close(own)
                own = []
            own.append(x)
        yield from close(own)

    return rows.repartition("component", "salt").sortWithinPartitions("component", "salt").mapInArrow(run, "a long, b long")


def link_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, block: int = BLOCK) -> DataFrame:
    """(doc_id, text) to (doc_id, n_shingles, component_id), a row for each distinct id.

    Two documents link when den * |x & y| >= num * |x | y| over their sets of k-word shingles. A null text, and one without words, has no shingles
    and links with nothing. Rows without an id are left out. Repeated rows of an id count once; where their texts differ, each text
    counts, and n_shingles is the largest. Other columns are not read. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    met = keep(route(docs, k, num, den))
    sets = met.where(F.col("kind") == _SIZE).select(F.col("a").alias("doc_id"), F.col("b").alias("n"), "c", "d")
    pairs = met.where(F.col("kind") == _PAIR).select("a", "b")
    # of equal sets the one with the smallest id stands for all
    same = sets.where("n > 0").groupBy("n", "c", "d").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    copies = keep(sets.join(same.where("copies > 1"), ["n", "c", "d"]).where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    coarse = components(pairs)
    # an id with several texts can be a copy by one and stand alone by another, so that it stays where any of its rows is no copy
    alone = sets.groupBy("doc_id").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).join(copies.groupBy(F.col("a").alias("doc_id")).agg(F.count("*").alias("gone")), "doc_id", "left").where("rows > coalesce(gone, 0)")
    group = coarse.join(alone.select(F.col("doc_id").alias("node"), "n"), "node")
    weight = F.sum("n").alias("weight")

    def of_size(of: DataFrame) -> DataFrame:
        return of.groupBy("component").agg(weight, F.count("*").alias("members")).where("members > 1")

    group = keep(group.join(of_size(group).select("component", "weight"), "component"))
    for seed in range(REROUTES):
        large = keep(group.where(F.col("weight") > block))
        if large.isEmpty():
            break
        n_bytes = large.agg(F.sum("n")).first()[0] * 8
        split = reroute(docs.join(large.select(F.col("node").alias("doc_id"), "component"), "doc_id"), k, num, den, seed, n_bytes)
        parted = large.drop("component", "weight").join(split, "node")
        parted = parted.join(of_size(parted).select("component", "weight"), "component")
        group = keep(group.where(F.col("weight") <= block).unionByName(parted))
    blocks = F.ceil(F.col("weight") / block)
    member = group.select(F.col("node").alias("doc_id"), "component", blocks.alias("blocks")).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    members = docs.join(member.hint("shuffle_hash"), "doc_id").select("component", "salt", "blocks", "doc_id", "text")
    several = not member.where("blocks > 1").isEmpty()
    if several:
        members = keep(members)

    def visit(queries: DataFrame, q: bool) -> DataFrame:
        """Queries in each block but their own."""
        at = F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("salt")))
        return queries.select("component", at.alias("salt"), "doc_id", "text", F.lit(q).alias("q"))

    first = members.select("component", "salt", "doc_id", "text", F.lit(False).alias("q"))
    if several:
        first = first.unionByName(visit(members.where("blocks > 1 AND doc_id = component"), False))
    found = components(_search(first, k, num, den))
    if several:
        wide = keep(members.where("blocks > 1"))
        large = keep(wide.select("doc_id", F.col("component").alias("group")).distinct())
        asked = large.where(F.col("doc_id") == F.col("group")).select("doc_id")
        budget = QUERIES
        while True:
            state = large.join(found, large["doc_id"] == found["node"], "left").select("doc_id", "group", F.coalesce("component", "doc_id").alias("own"))
            state = keep(state)
            main = keep(state.groupBy("group", "own").agg(F.count("*").alias("n")).groupBy("group").agg(F.max_by("own", F.struct("n", "own")).alias("main")))
            rest = keep(state.join(main, "group").where("own != main").select("doc_id", "group").join(asked, "doc_id", "left_anti"))
            waiting = keep(rest.groupBy("group").agg(F.count("*").alias("n")))
            if waiting.isEmpty():
                break
            # drawn by a hash, as many of each group as the budget has in expectation, and all of a group that has few
            nxt = keep(rest.join(waiting, "group").where((F.col("n") <= 4 * budget) | (F.pmod(F.xxhash64("doc_id", F.lit(budget)), F.col("n")) < budget)).select("doc_id"))
            active = wide.join(waiting.select(F.col("group").alias("component")), "component", "left_semi")
            index = active.select("component", "salt", "doc_id", "text", F.lit(False).alias("q"))
            links = keep(_search(index.unionByName(visit(active.join(nxt, "doc_id", "left_semi"), True)), k, num, den))
            found = relabel(found, links)
            asked = keep(asked.unionByName(nxt))
            budget *= QUERY_GROWTH
    found = relabel(found, copies)
    sizes = sets.groupBy("doc_id").agg(F.max("n").alias("n_shingles"))
    return sizes.join(found, sizes["doc_id"] == found["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of documents without those that are near copies of a row with a smaller id, directly or through others.

    Rows without an id, a text or a word stay. Of equal rows one stays; rows that share an id and differ in their texts are judged one by one, and
    of such rows in one group one stays. The columns stay as they are, and an empty table stays empty.
    """
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.isEmpty():
        gone = link_components(docs, k, num, den).where("doc_id != component_id").select("doc_id")
        return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(docs.columns)
    # a row's own number, kept, stands for its id, and the smallest id of a group tells which of its rows stays
    mark = "row"
    while mark in {c.lower() for c in docs.columns}:
        mark += "_"
    named = keep(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).withColumn(mark, F.monotonically_increasing_id()))
    found = link_components(named.select(F.col(mark).alias("doc_id"), "text"), k, num, den).select(F.col("doc_id").alias(mark), "component_id")
    ids = named.select(mark, "doc_id").join(found, mark)
    kept = ids.groupBy("component_id").agg(F.min(F.struct("doc_id", mark)).alias("one")).select(F.col(f"one.{mark}").alias(mark))
    return docs.where("doc_id IS NULL").unionByName(named.join(kept, mark, "left_semi").select(docs.columns))
