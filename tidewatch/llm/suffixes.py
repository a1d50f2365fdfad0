"""Removal of long strings that repeat anywhere in a corpus, by hash-compared suffix sorting.

A byte goes if a string of LENGTH bytes that covers it starts anywhere else as well. In each window of so many bytes the k-gram of least hash is
its anchor, so that equal windows have equal anchors at equal places; suffixes are sorted among occurrences of one anchor alone.

An occurrence's context is what windows with that anchor can reach: LENGTH - GRAM bytes to the left and LENGTH bytes to the right of its start. Occurrences with equal
contexts are twins, and all of their context goes. For the others prefix polynomial hashes and binary search give the common extension of two contexts on
either side, verified against the bytes; with such comparisons mergesort orders them by right and by left extension. Joining
neighbours in right order by descending common extension, the smaller set into the larger in left order, meets each occurrence's best partners:
what L bytes to the left and R to the right have in common with L + R >= LENGTH goes.

An anchor's occurrences are sorted in blocks of GROUP. Where there are several, each block hands on the windows that have this anchor, each of equal ones
once; those that come from two blocks or more go wherever the sort hasn't found them yet.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import U64, arrow_rows, in_chunks, keep, mix, powers, prefix_hashes

LENGTH = 200
GRAM = 32
#: Occurrences of an anchor with different contexts that are sorted together, in a block; windows tell what blocks of one anchor have in common.
GROUP = 4096

_POS = 24


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each x[i : i + w]."""
    n = len(x) - w + 1
    y = np.concatenate([x, np.full(-len(x) % w, np.iinfo(x.dtype).max, dtype=x.dtype)]).reshape(-1, w)
    before = np.minimum.accumulate(y, axis=1).ravel()
    after = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def anchors(grams: np.ndarray, ok: np.ndarray, w: int) -> np.ndarray:
    """Places of the least of each w hashes, the first of equal ones, where ok holds for the window's start; ascending, each once."""
    out, step = [], 1 << 21
    for at in range(0, max(0, len(grams) - w + 1), step):
        part = grams[at : at + step + w - 1]
        low = sliding_minimum((part >> U64(_POS) << U64(_POS)) | np.arange(len(part), dtype=U64), w)
        low = low[ok[at : at + len(low)]]
        if len(low):
            p = (low & U64((1 << _POS) - 1)).astype(np.int64) + at
            out.append(p[np.concatenate([[True], p[1:] != p[:-1]])])
    return np.unique(np.concatenate(out)) if out else np.empty(0, dtype=np.int64)


def occurrences(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, start in the text, bytes to the left and right in the context, hash of the anchor, hash of the context), in order."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    codes = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if len(codes) < length:
        return tuple(np.empty(0, dtype=d) for d in (np.int64, np.int64, np.int64, np.int64, U64, U64))
    p = prefix_hashes(codes)
    _, down = powers(len(codes) + 1)
    n = len(codes) - gram + 1
    grams = mix((p[gram:] - p[:-gram]) * down[:n])
    windows = n - (length - gram)
    left = np.repeat(ends, sizes) - np.arange(len(codes))  # bytes from here to the text's end
    at = anchors(grams, left[:windows] >= length, length - gram + 1)
    doc = np.searchsorted(ends, at, side="right")
    start = at - (ends - sizes)[doc]
    lo, hi = np.minimum(start, length - gram), np.minimum(left[at], length)
    context = mix((p[at + hi] - p[at - lo]) * down[at - lo] + (lo * 1009 + hi).astype(U64))
    return doc, start, lo, hi, grams[at], context


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


class Suffixes:
    """Byte strings with prefix hashes, compared in logarithmic time."""

    def __init__(self, texts: list[bytes]) -> None:
        self.texts = texts
        self.hashes = [prefix_hashes(np.frombuffer(t, dtype=np.uint8)).tolist() for t in texts]

    def common(self, i: int, j: int) -> int:
        """Length of the common prefix: the longest with equal hashes, if its bytes are equal too."""
        a, b = self.hashes[i], self.hashes[j]
        lo, hi = 0, min(len(a), len(b)) - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if a[mid] == b[mid]:
                lo = mid
            else:
                hi = mid - 1
        x, y = self.texts[i], self.texts[j]
        if x[:lo] != y[:lo]:  # a collision
            lo = next(k for k in range(lo) if x[k] != y[k])
        return lo

    def before(self, i: int, j: int) -> bool:
        n = self.common(i, j)
        return self.texts[i][n : n + 1] <= self.texts[j][n : n + 1]

    def order(self) -> list[int]:
        """Mergesort."""
        runs = [[i] for i in range(len(self.texts))]
        while len(runs) > 1:
            out = []
            for k in range(0, len(runs) - 1, 2):
                a, b, m, i, j = runs[k], runs[k + 1], [], 0, 0
                while i < len(a) and j < len(b):
                    if self.before(a[i], b[j]):
                        m.append(a[i])
                        i += 1
                    else:
                        m.append(b[j])
                        j += 1
                out.append(m + a[i:] + b[j:])
            runs = out + runs[len(runs) & ~1 :]
        return runs[0] if runs else []


def extents(contexts: list[tuple[bytes, bytes]], length: int) -> list[tuple[int, int] | None]:
    """contexts: what stands before an anchor's start, and from there on. For each: the most bytes to the left and to the right that go, or None."""
    before, after = Suffixes([a[::-1] for a, _ in contexts]), Suffixes([b for _, b in contexts])
    order = after.order()
    rank = [0] * len(order)
    by_rank = before.order()
    for r, i in enumerate(by_rank):
        rank[i] = r
    best: list[tuple[int, int] | None] = [None] * len(order)
    sets: dict[int, list[int]] = {k: [rank[i]] for k, i in enumerate(order)}
    owner = list(range(len(order)))

    def find(k: int) -> int:
        while owner[k] != k:
            owner[k] = owner[owner[k]]
            k = owner[k]
        return k

    steps = sorted(((after.common(order[k], order[k + 1]), k) for k in range(len(order) - 1)), key=lambda x: -x[0])
    for right, k in steps:
        a, b = find(k), find(k + 1)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large = sets[a]
        for r in sets.pop(b):
            at = bisect_left(large, r)
            i = by_rank[r]
            for near in large[max(0, at - 1) : at + 1]:
                j = by_rank[near]
                left = before.common(i, j)
                if left + right >= length:
                    for x in (i, j):
                        best[x] = (left, right) if best[x] is None else (max(best[x][0], left), max(best[x][1], right))
            large.insert(at, r)
        owner[b] = a
    return best


_ROWS = "kind int, h long, context long, id long, row long, start long, lo long, hi long"
_ONE, _SPAN, _SORT = 0, 1, 2  # an occurrence to be met by others; a span that goes; an occurrence to be sorted


def _table(kind, h, context, ids, rows, start, lo, hi) -> pa.RecordBatch:
    n = len(start)
    kinds = pa.array(np.full(n, kind, np.int32))
    return pa.RecordBatch.from_arrays([kinds, *[pa.array(x, pa.int64()) for x in (h, context, ids, rows, start, lo, hi)]], names=["kind", "h", "context", "id", "row", "start", "lo", "hi"])


def _spans(ids, rows, doc, lo, hi) -> pa.RecordBatch | None:
    """Spans of (lo, hi) by place of the document, ordered by document and lo, as merged rows."""
    if not len(lo):
        return None
    top = np.maximum.accumulate(hi + doc * (1 << 40))
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (lo[1:] + doc[1:] * (1 << 40) > top[:-1])])
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(lo)]]) - 1
    d = doc[at]
    zero = np.zeros(len(at), dtype=np.int64)
    return _table(_SPAN, _mixed(rows[d], lo[at]), zero, ids[d], rows[d], zero, lo[at], top[last] - d * (1 << 40))


def _mixed(*x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x[0]), dtype=U64)
    for y in x:
        out = mix(out + y.astype(np.int64).view(U64) + U64(1))
    return out.view(np.int64)


def duplicate_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(id, row, text) to (id, row, lo, hi): spans that go, not yet merged. row: a hash of id and text."""
    ship(docs.sparkSession)

    def deal(batches):
        for chunk in in_chunks(((i, r, (t or "").encode("utf-8", "surrogatepass")) for i, r, t in arrow_rows(batches, "id", "row", "text")), 2, 1 << 22):
            doc, start, lo, hi, h, context = occurrences([t for _, _, t in chunk], length, gram)
            if not len(doc):
                continue
            ids, rows = (np.array([x[k] for x in chunk], dtype=np.int64) for k in (0, 1))
            # twins in the chunk go, and one of them is met by others
            order = np.lexsort((start, doc, context, h))
            new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (context[order][1:] != context[order][:-1])])
            run = np.cumsum(new) - 1
            size = np.bincount(run)
            twin = np.zeros(len(doc), dtype=bool)
            twin[order] = size[run] > 1
            first = order[new]
            # context 0 stands for none; lo < 0 tells that the span is done
            yield _table(_ONE, h[first].view(np.int64), context[first].view(np.int64), ids[doc[first]], rows[doc[first]], start[first], np.where(twin[first], -1 - lo[first], lo[first]), hi[first])
            if (b := _spans(ids, rows, doc[twin], (start - lo)[twin], (start + hi)[twin])) is not None:
                yield b

    def meet(batches):
        # a stream ordered by (h, context); the last run of equal contexts waits for the next batch
        held, last_h, counted = None, None, (None, 0)
        names = ("h", "context", "id", "row", "start", "lo", "hi")

        def settle(c, known_h, final):
            """Rows for all runs but the last, or for all."""
            nonlocal counted
            new = np.concatenate([[True], (c["h"][1:] != c["h"][:-1]) | (c["context"][1:] != c["context"][:-1])])
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, len(new)))
            run_h = c["h"][at]
            many = np.zeros(len(at), dtype=bool)
            many[1:] = run_h[1:] == run_h[:-1]
            many[:-1] |= many[1:]
            many[0] |= known_h is not None and run_h[0] == known_h
            keep_ = len(at) if final else len(at) - 1
            done = c["lo"] < 0
            lo = np.where(done, -1 - c["lo"], c["lo"])
            run = np.cumsum(new) - 1
            settled = (size > 1) | done[at]  # of a run: all its spans go
            go = settled[run] & ~done & (run < keep_)
            out = []
            if go.any():
                zero = np.zeros(int(go.sum()), dtype=np.int64)
                out.append(_table(_SPAN, zero, zero, c["id"][go], c["row"][go], zero, (c["start"] - lo)[go], (c["start"] + c["hi"])[go]))
            pick = at[:keep_][many[:keep_]]
            if len(pick):
                flag, own = settled[run[pick]], c["h"][pick]
                # an anchor's occurrences are numbered as they come, and so fall into blocks
                begins = np.concatenate([[True], own[1:] != own[:-1]])
                number = np.arange(len(pick)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
                number[own == own[0]] += counted[1] if counted[0] == own[0] else 0
                counted = own[-1], int(number[-1]) + 1
                out.append(_table(_SORT, own, (number // group << 1) | flag, c["id"][pick], c["row"][pick], c["start"][pick], lo[pick], c["hi"][pick]))
            if final:
                return out, None, None
            tail = slice(at[-1], None)
            rest = {k: v[tail] for k, v in c.items()}
            if len(rest["h"]) > 1:  # a run that goes on: its spans go now, and one row stays for it
                go = ~(rest["lo"] < 0)
                if go.any():
                    zero = np.zeros(int(go.sum()), dtype=np.int64)
                    out.append(_table(_SPAN, zero, zero, rest["id"][go], rest["row"][go], zero, (rest["start"] - rest["lo"])[go], (rest["start"] + rest["hi"])[go]))
                rest = {k: v[:1].copy() for k, v in rest.items()}
                if rest["lo"][0] >= 0:
                    rest["lo"][0] = -1 - rest["lo"][0]
            return out, rest, (run_h[-2] if len(at) > 1 else known_h)

        for b in batches:
            one = b.column(0).to_numpy(zero_copy_only=False) == _ONE
            if not one.all():
                yield b.filter(pa.array(~one))
            c = {n: b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False)[one] for n in names}
            if not len(c["h"]):
                continue
            if held is not None:
                c = {n: np.concatenate([held[n], c[n]]) for n in names}
            out, held, last_h = settle(c, last_h, False)
            yield from out
        if held is not None:
            yield from settle(held, last_h, True)[0]

    met = keep(docs.mapInArrow(deal, _ROWS).repartition("h").sortWithinPartitions("kind", "h", "context").mapInArrow(meet, _ROWS))
    done = met.where(F.col("kind") == _SPAN).select("id", "row", "lo", "hi")
    asked = met.where(F.col("kind") == _SORT).groupBy("id", "row").agg(F.collect_list(F.struct("h", "start", "lo", "hi", F.col("context").alias("block"))).alias("at"))

    def show(batches):
        for i, r, t, at in arrow_rows(batches, "id", "row", "text", "at"):
            t = (t or "").encode("utf-8", "surrogatepass")
            rows = [(x["h"], x["block"] >> 1, i, r, x["start"], x["block"] & 1, t[x["start"] - x["lo"] : x["start"]], t[x["start"] : x["start"] + x["hi"]]) for x in at]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (*[pa.int64()] * 6, pa.binary(), pa.binary()))], names=["h", "block", "id", "row", "start", "settled", "before", "after"])

    shown = docs.join(asked.hint("shuffle_hash"), ["id", "row"]).mapInArrow(show, "h long, block long, id long, row long, start long, settled long, before binary, after binary")

    def spans(rows):
        return pa.RecordBatch.from_arrays([*[pa.array([x[k] for x in rows], pa.int64()) for k in range(5)], pa.array([x[5] for x in rows], pa.bool_())], names=["id", "row", "lo", "hi", "window", "done"])

    def windows(own):
        """(id, row, lo, hi, hash, whether it repeats in the block) of the windows with this anchor, each of equal ones once."""
        first: dict[int, tuple] = {}
        again: set[int] = set()
        for _, _, i, r, s, settled, x, y in own:
            p = prefix_hashes(np.frombuffer(x + y, dtype=np.uint8))
            _, down = powers(len(p))
            n = len(x) + len(y)
            grams = mix((p[gram:] - p[:-gram]) * down[: n - gram + 1])
            low = sliding_minimum((grams >> U64(_POS) << U64(_POS)) | np.arange(len(grams), dtype=U64), length - gram + 1)
            at = np.flatnonzero((low & U64((1 << _POS) - 1)) == U64(len(x)))
            for k, w in zip(at.tolist(), mix((p[at + length] - p[at]) * down[at]).view(np.int64).tolist()):
                if w in first:
                    again.add(w)
                else:
                    first[w] = i, r, s - len(x) + k, s - len(x) + k + length, w
                if settled:
                    again.add(w)
        if first:
            yield spans([(*x, w in again) for w, x in first.items()])

    def solve(batches):
        own = []

        def close():
            if len(own) > 1 and not all(x[5] for x in own):
                out = [(x[2], x[3], x[4] - e[0], x[4] + e[1], None, None) for x, e in zip(own, extents([(x[6], x[7]) for x in own], length)) if e and not x[5]]
                if out:
                    yield spans(out)
            # a full block may have others beside it
            if own and (own[0][1] or len(own) >= group):
                yield from windows(own)

        for x in arrow_rows(batches, "h", "block", "id", "row", "start", "settled", "before", "after"):
            if own and own[0][:2] != x[:2]:
                yield from close()
                own = []
            own.append(x)
        yield from close()

    solved = keep(shown.repartition("h", "block").sortWithinPartitions("h", "block").mapInArrow(solve, "id long, row long, lo long, hi long, window long, done boolean"))
    out = done.unionByName(solved.where("window IS NULL").select("id", "row", "lo", "hi"))
    wide = solved.where("window IS NOT NULL")
    if not wide.isEmpty():
        # a window has one anchor, and a block hands it on once
        twice = wide.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
        out = out.unionByName(wide.where("NOT done").join(twice, "window").select("id", "row", "lo", "hi"))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, texts: bool = False) -> DataFrame:
    """(doc_id, text) to (doc_id, n_bytes, n_removed, n_spans, kept_sha256), a row for each row, and with texts the kept bytes.

    Text is judged as UTF-8; a null text counts as empty. Repeated rows are copies of each other; rows without an id are treated like any others.
    Matches never cross rows. The removal may cut a character, so that kept is binary.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(F.col("doc_id").cast("long"), F.col("doc_id").isNull(), "text").alias("row"), F.col("doc_id").isNull().alias("nameless"), "text")
    spans = duplicate_spans(rows.select("id", "row", "text"), length, gram, group)
    gone = spans.groupBy("id", "row").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def cut(batches):
        for chunk in in_chunks(arrow_rows(batches, "id", "nameless", "spans", "text"), 3):
            out = [[], [], [], [], [], []]
            for i, nameless, s, t in chunk:
                t = (t or "").encode("utf-8", "surrogatepass")
                runs = merged([(x["lo"], x["hi"]) for x in s or ()])
                kept, at = [], 0
                for a, b in runs:
                    kept.append(t[at:a])
                    at = b
                rest = b"".join([*kept, t[at:]])
                for c, v in zip(out, (None if nameless else i, len(t), len(t) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest if texts else None)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (*[pa.int64()] * 4, pa.string(), pa.binary()))][: 5 + texts], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + texts])

    return rows.join(gone.hint("shuffle_hash"), ["id", "row"], "left").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)
