"""Near copies among embedding vectors by an inverted multi-index.

Vectors are scaled to length 1 and cut in halves; each half has a codebook, fitted on a bounded sample, and a vector's cell is
the pair of its halves' nearest codewords. A search goes through the cells in the order of the query's distance to them (the sum of
the two halves' squared distances), as far as neighbours at the least cosine are found with the target recall on the sample, and verifies
what lies there in double precision. Every vector is indexed and every vector is a query; equal vectors are one with a weight.
A pair is found if either end visits the other's cell, and then counts for both.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..ship import ship
from .common import arrow_rows, keep
from .graph import components

LEAST = 0.9
#: Vectors that the codebooks are fitted on, in expectation; all are indexed.
SAMPLE = 20_000
#: Recall that each end of a pair reaches for neighbours at exactly the least cosine.
TARGET = 0.95
#: Vectors to a cell, if they were spread evenly.
PER_CELL = 48
#: Index rows and query rows of a cell that meet in one task.
INDEX_BLOCK, QUERY_BLOCK = 1024, 8192


def multi_sequence(d1: np.ndarray, d2: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cells (i, j) by ascending d1[i] + d2[j], by the multi-sequence algorithm."""
    a, b = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    heap, seen = [(d1[a[0]] + d2[b[0]], 0, 0)], set()
    while heap:
        _, i, j = heapq.heappop(heap)
        seen.add((i, j))
        yield int(a[i]), int(b[j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x == 0 or (x - 1, y) in seen) and (y == 0 or (x, y - 1) in seen):
                heapq.heappush(heap, (d1[a[x]] + d2[b[y]], x, y))


def _distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ codes.T + (codes**2).sum(axis=1), 0)


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    codes = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = _distances(x, codes).argmin(axis=1)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(codes)
        np.add.at(total, own, x)
        codes = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], codes)
    return codes


class MultiIndex:
    def __init__(self, sample: np.ndarray, vectors: int, least: float = LEAST, target: float = TARGET, per_cell: int = PER_CELL) -> None:
        """sample: rows of length 1; vectors: how many will be indexed."""
        rng = np.random.default_rng(7)
        self.half = max(1, sample.shape[1] // 2)
        k = int(np.clip(round((vectors / per_cell) ** 0.5), 1, max(1, len(sample) // 8)))
        self.codes = [_codebook(part, min(k, len(part)), rng) for part in (sample[:, : self.half], sample[:, self.half :])]
        self.width = len(self.codes[1])
        # neighbours at exactly the least cosine, in random directions, and at which step a search comes to their cells
        some = sample[rng.choice(len(sample), min(len(sample), 2000), replace=False)]
        away = rng.standard_normal(some.shape)
        away -= (away * some).sum(axis=1)[:, None] * some
        size = np.linalg.norm(away, axis=1)[:, None]
        near = least * some + (1 - least**2) ** 0.5 * away / np.where(size > 0, size, 1)
        d1, d2 = self._halves(some)
        goal = self.home(near)
        at = d1[np.arange(len(some)), goal // self.width] + d2[np.arange(len(some)), goal % self.width]
        steps = np.array([((x[:, None] + y) <= z).sum() for x, y, z in zip(d1, d2, at)])
        self.visits = int(max(1, np.ceil(np.quantile(steps, target))))

    def _halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distances(x[:, : self.half], self.codes[0]), _distances(x[:, self.half :], self.codes[1])

    def home(self, x: np.ndarray) -> np.ndarray:
        d1, d2 = self._halves(x)
        return d1.argmin(axis=1) * self.width + d2.argmin(axis=1)

    def visited(self, x: np.ndarray) -> np.ndarray:
        """The first cells of each row's multi-sequence traversal. Only cells (i, j) with (i + 1) * (j + 1) <= visits, by rank in their halves, can be among them."""
        d1, d2 = self._halves(x)
        a, b = np.argsort(d1, axis=1, kind="stable"), np.argsort(d2, axis=1, kind="stable")
        i, j = (np.array(v) for v in zip(*[(i, j) for i in range(a.shape[1]) for j in range(min(b.shape[1], self.visits // (i + 1)))]))
        cost = np.take_along_axis(d1, a, 1)[:, i] + np.take_along_axis(d2, b, 1)[:, j]
        n = min(self.visits, len(i))
        first = np.argsort(cost, axis=1, kind="stable")[:, :n]
        return np.take_along_axis(a, i[first], 1) * self.width + np.take_along_axis(b, j[first], 1)


def meet(index: np.ndarray, queries: np.ndarray, least: float, step: int = 1024) -> np.ndarray:
    """Which query (row) and index vector (column), all of length 1, have at least that cosine."""
    out = np.empty((len(queries), len(index)), dtype=bool)
    for at in range(0, len(queries), step):
        out[at : at + step] = queries[at : at + step] @ index.T >= least
    return out


def _search(least: float, kind: str):
    def unit(column: pa.ChunkedArray) -> np.ndarray:
        x = np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1).astype(np.float64)
        return x / np.linalg.norm(x, axis=1)[:, None]

    def run(t: pa.Table) -> pa.Table:
        role = t.column("role").to_numpy()
        rows, asks = t.filter(pa.array(role == 0)), t.filter(pa.array(role == 1))
        if not len(rows) or not len(asks):
            return pa.table({"rep": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        b, q = rows.column("rep").to_numpy(), asks.column("rep").to_numpy()
        b_mult, q_mult = rows.column("mult").to_numpy(), asks.column("mult").to_numpy()
        link = meet(unit(rows.column("v")), unit(asks.column("v")), least)
        link &= q[:, None] != b
        n_q = link @ b_mult
        # an index vector that doesn't visit the query's cell would not count the query there
        cells, at = np.unique(asks.column("home").to_numpy(), return_inverse=True)
        goes = np.stack([np.isin(cells, x) for x in rows.column("visited").to_pylist()], axis=1)  # cell by index vector
        n_b = (q_mult[:, None] * (link & ~goes[at])).sum(axis=0)
        ids, place = np.unique(np.concatenate([q, b]), return_inverse=True)
        root = ids.copy()
        pq, pb = place[: len(q)], place[len(q) :]
        big = np.iinfo(np.int64).max
        while True:
            low_q = np.where(link, root[pb], big).min(axis=1, initial=big)
            low_b = np.where(link, root[pq][:, None], big).min(axis=0, initial=big)
            new = root.copy()
            np.minimum.at(new, pq, low_q)
            np.minimum.at(new, pb, low_b)
            if (new == root).all():
                break
            root = new
        total = np.zeros(len(ids), dtype=np.int64)
        np.add.at(total, pq, n_q)
        np.add.at(total, pb, n_b)
        has = (total > 0) | (root != ids)
        return pa.table({"rep": pa.array(ids[has]), "n": pa.array(total[has]), "root": pa.array(root[has])})

    return run


def near_copies(vectors: DataFrame, least: float = LEAST, sample: int = SAMPLE, target: float = TARGET) -> DataFrame:
    """(vec_id, embedding) to (vec_id, n_links, component_id, kept), a row for each row.

    Two vectors link at a cosine of at least `least`. Vectors that are null, empty, all zero or hold a null or a value that isn't finite, and rows
    without an id, link with nothing; so do vectors of different lengths. Repeated rows are vectors of their own. kept: the id is its component's.
    """
    ship(vectors.sparkSession)
    double = isinstance(t := vectors.schema["embedding"].dataType, ArrayType) and isinstance(t.elementType, DoubleType)
    kind, element = ("<f8", "double") if double else ("<f4", "float")
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{element}>").alias("embedding"))

    def read(batches):
        for b in batches:
            out = []
            for i, x in arrow_rows([b], "vec_id", "embedding"):
                v = None if i is None or not x or any(c is None for c in x) else np.array(x, dtype=kind)
                ok = v is not None and np.isfinite(v).all() and v.any()
                if ok and not 1e-100 < (v.astype(np.float64) ** 2).sum() < 1e100:
                    # squares would leave the range of doubles: a power of two changes no cosine
                    v = np.ldexp(v, -np.frexp(np.abs(v).max())[1])
                out.append(v.tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["vec_id", "v"])

    rows = keep(vectors.mapInArrow(read, "vec_id long, v binary"))
    reps = keep(rows.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")))
    lengths = {r["n"]: r["rows"] for r in reps.groupBy(F.octet_length("v").alias("n")).agg(F.count("*").alias("rows")).collect()}
    share = {n: min(1.0, sample / c) for n, c in lengths.items()}
    models: dict[int, MultiIndex] = {}
    for n, c in lengths.items():
        own = reps.where((F.octet_length("v") == n) & (F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int(share[n] * (1 << 30)) + 1)).select("v").collect()
        if own:
            x = np.frombuffer(b"".join(sorted(bytes(r["v"]) for r in own)), dtype=kind).reshape(len(own), -1).astype(np.float64)
            models[n] = MultiIndex(x / np.linalg.norm(x, axis=1)[:, None], c, least, target)
    shared = reps.sparkSession.sparkContext.broadcast(models)

    def place(batches):
        for b in batches:
            v = b.column(b.schema.get_field_index("v")).to_pylist()
            home, visited = [0] * len(v), [[0]] * len(v)
            for n in {len(x) for x in v} & shared.value.keys():
                at = [i for i, x in enumerate(v) if len(x) == n]
                x = np.frombuffer(b"".join(v[i] for i in at), dtype=kind).reshape(len(at), -1).astype(np.float64)
                x /= np.linalg.norm(x, axis=1)[:, None]
                for i, h, c in zip(at, shared.value[n].home(x).tolist(), shared.value[n].visited(x).tolist()):
                    home[i], visited[i] = h, c if h in c else [h, *c]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in ("rep", "mult", "v")], pa.array([len(x) for x in v], pa.int32()), pa.array(home, pa.int64()), pa.array(visited, pa.list_(pa.int64()))], names=["rep", "mult", "v", "size", "home", "visited"])

    placed = keep(reps.mapInArrow(place, "rep long, mult long, v binary, size int, home long, visited array<long>"))
    asks = placed.select("size", "rep", F.explode("visited").alias("cell"))
    has = placed.groupBy("size", F.col("home").alias("cell")).agg(F.count("*").alias("rows"))
    asked = asks.groupBy("size", "cell").agg(F.count("*").alias("asks"))
    cells = keep(has.join(asked, ["size", "cell"]).select("size", "cell", F.ceil(F.col("rows") / INDEX_BLOCK).alias("ib"), F.ceil(F.col("asks") / QUERY_BLOCK).alias("qb")))
    salt = F.xxhash64("rep")
    index = placed.withColumn("cell", F.col("home")).join(cells, ["size", "cell"]).select("size", "cell", F.pmod(salt, "ib").alias("i"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("j"), F.lit(0).alias("role"), "rep", "mult", "v", "home", "visited")
    queries = placed.select("size", F.explode("visited").alias("cell"), "rep", "mult", "v", "home").join(cells, ["size", "cell"])
    queries = queries.select("size", "cell", F.explode(F.sequence(F.lit(0), F.col("ib") - 1)).alias("i"), F.pmod(salt, "qb").alias("j"), F.lit(1).alias("role"), "rep", "mult", "v", "home", F.lit(None).cast("array<long>").alias("visited"))
    found = keep(index.unionByName(queries).groupBy("size", "cell", "i", "j").applyInArrow(_search(least, kind), "rep long, n long, root long"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("rep").agg(F.sum("n").alias("n"))
    answer = reps.select("rep", "mult", "v").join(sums, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left")
    answer = keep(answer.select("v", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    linked = rows.where("v IS NOT NULL").join(answer, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
