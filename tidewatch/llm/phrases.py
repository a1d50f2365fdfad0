"""Phrase collocation mining by pivots: text fragments go to the rarest word of each phrase in them, and are mined there."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import arrow_rows, in_chunks, keep, mix, only, word_hashes

#: Longest phrase, fewest occurrences, phrases of a language.
LONGEST, FEWEST, TOP = 4, 30, 2000
#: A phrase is dropped that lies inside a longer one with so many hundredths of its occurrences.
INSIDE = 80
#: Cells of the table of word counts that is broadcast, four bytes each, whatever the number of words.
CELLS, CELLS_A_PART = 1 << 22, 1 << 14
#: Bytes of text that are cut into fragments at a time, and rows that are mined at a time.
CHUNK, ROWS = 1 << 22, 1 << 17
#: Occurrences of a pivot beyond which its fragments go to several tasks.
SPREAD = 1 << 18
#: Parts in which the best phrases of a language are chosen first, and over which what is known of a single word is spread.
PARTS, SALTS = 32, 16
#: Bytes that are gathered at a time, whose places take eight times as much, and fragments that are grouped at a time.
GATHERED, GROUPED = 1 << 20, 1 << 16
#: A word that is too rare to be part of a phrase.
NEVER = np.uint64((1 << 64) - 1)

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[9, 32]] = 1
_KIND[[*b".,;:!?", 10, 11, 12, 13]] = 2
_NOT_WORD = _KIND > 0


class Words:
    """The words of texts in a row: bytes with one space after each word, where each begins, its text, and whether it follows its neighbour within a piece."""

    def __init__(self, texts: list[bytes]):
        codes = np.frombuffer(b"\n".join(texts).lower() + b"\n", dtype=np.uint8)
        kind = _KIND[codes]
        inside = kind == 0
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=np.int8(0)))
        starts, ends = edge[0::2], edge[1::2]
        breaks = np.cumsum(kind == 2, dtype=np.int64)[starts] if len(starts) else np.zeros(0, np.int64)
        self.follows = np.zeros(len(starts), dtype=bool)
        self.follows[1:] = breaks[1:] == breaks[:-1]
        space = np.zeros(len(codes), dtype=bool)
        space[ends] = True
        self.codes = np.where(space, np.uint8(32), codes)[inside | space]
        self.at = np.concatenate([[0], np.cumsum(ends - starts + 1)])
        upto = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
        self.text = np.searchsorted(upto, starts, side="right")

    def __len__(self) -> int:
        return len(self.follows)


def slices(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte strings between starts and ends."""
    size = ends - starts
    upto = np.concatenate([[0], np.cumsum(size)])
    data, at = np.empty(upto[-1], dtype=np.uint8), 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + GATHERED, side="right")) - 1)
        places = np.repeat(starts[at:to] - upto[at:to], size[at:to])
        places += np.arange(upto[at], upto[to])
        data[upto[at] : upto[to]] = codes[places]
        at = to
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(data)])


def _cell_hashes(words: list[bytes], lang: np.ndarray) -> np.ndarray:
    """A hash of each word in its language; the words hold nothing that parts words."""
    h, _ = word_hashes(words, _NOT_WORD)
    return mix(h ^ lang)


def _lang_hash(lang: str) -> int:
    h, _ = word_hashes([lang.encode().hex().encode()], _NOT_WORD)
    return int(h[0]) if len(h) else 1


def _langs(rows: list[tuple]) -> tuple[list[str], np.ndarray]:
    names: dict[str, int] = {}
    code = np.array([names.setdefault("und" if r[1] is None else r[1], len(names)) for r in rows], dtype=np.int64)
    return list(names), code


def _utf8(a: pa.Array) -> pa.Array:
    return a.cast(pa.large_string()).cast(pa.string())


def _count(batches) -> Iterator[pa.RecordBatch]:
    """How often each language's words come up, by chunks of texts; without a word: all together."""
    for rows in in_chunks(arrow_rows(batches, "text", "lang"), 0, CHUNK):
        names, code = _langs(rows)
        w = Words([(r[0] or "").encode() for r in rows])
        if not len(w):
            continue
        known = slices(w.codes, w.at[:-1], w.at[1:] - 1).dictionary_encode()
        of = known.indices.to_numpy().astype(np.int64)
        key, n = np.unique(of * len(names) + code[w.text], return_counts=True)
        lang = pa.array(names).take(pa.array(key % len(names)))
        yield pa.RecordBatch.from_arrays([lang, _utf8(known.dictionary.take(pa.array(key // len(names)))), pa.array(n, pa.int64())], names=["lang", "phrase", "a"])
        every = np.bincount(code[w.text], minlength=len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.nulls(len(names), pa.string()), pa.array(every, pa.int64())], names=["lang", "phrase", "a"])


def _cells(batches) -> Iterator[pa.RecordBatch]:
    hashed: dict[str, int] = {}
    for b in batches:
        if b.num_rows:
            for x in b.column(0).unique().to_pylist():
                hashed.setdefault(x, _lang_hash(x))
            lang = np.array([hashed[x] for x in b.column(0).to_pylist()], dtype=np.uint64)
            h = _cell_hashes([x.encode() for x in b.column(1).to_pylist()], lang)
            yield pa.RecordBatch.from_arrays([pa.array((h % np.uint64(CELLS)).astype(np.int32)), b.column(2)], names=["cell", "n"])


def _parts(batches) -> Iterator[pa.RecordBatch]:
    """Tables of the cells that a task has, by part."""
    parts: dict[int, np.ndarray] = {}
    for b in batches:
        cell, n = b.column(0).to_numpy(), np.minimum(b.column(1).to_numpy(), (1 << 32) - 1)
        for p in np.unique(cell // CELLS_A_PART).tolist():
            own = parts.setdefault(p, np.zeros(CELLS_A_PART, dtype=np.uint32))
            at = cell // CELLS_A_PART == p
            own[cell[at] % CELLS_A_PART] = n[at]
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([x.tobytes() for x in parts.values()], pa.binary())], names=["part", "data"])


def cell_table(words: DataFrame) -> np.ndarray:
    """Counts (lang, phrase, a) of single words as a table of CELLS cells: 16 MB, however many words there are.

    Words that share a cell share its sum. That changes which word of a phrase is its pivot, and so the load, but no result: a cell is
    never below the count of a word in it, so no word that is often enough is taken as rare.
    """
    cells = words.mapInArrow(_cells, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    parts = cells.repartition(F.floor(F.col("cell") / CELLS_A_PART)).mapInArrow(_parts, "part int, data binary")
    out = np.zeros(CELLS, dtype=np.uint32)
    for r in parts.collect():
        out[r.part * CELLS_A_PART : (r.part + 1) * CELLS_A_PART] = np.frombuffer(r.data, dtype=np.uint32)
    return out


def _fragments(table, fewest: int, chunk: int):
    """Each chunk's fragments: for each word that is often enough, the words beside it that are no rarer, up to three on either side.

    A phrase has its pivot at the first of its rarest words, so the words before a fragment's pivot must be less rare, those after it at
    most as rare. Each occurrence of a phrase then lies in one fragment around one pivot.
    """

    def cut(batches) -> Iterator[pa.RecordBatch]:
        counts = table.value
        for rows in in_chunks(arrow_rows(batches, "text", "lang"), 0, chunk):
            names, code = _langs(rows)
            w = Words([(r[0] or "").encode() for r in rows])
            if not len(w):
                continue
            known = slices(w.codes, w.at[:-1], w.at[1:] - 1).dictionary_encode()
            lang = code[w.text]
            key, back = np.unique(known.indices.to_numpy().astype(np.int64) * len(names) + lang, return_inverse=True)
            hashed = np.array([_lang_hash(x) for x in names], dtype=np.uint64)
            h = _cell_hashes(known.dictionary.take(pa.array(key // len(names))).to_pylist(), hashed[key % len(names)])
            n = counts[h % np.uint64(CELLS)].astype(np.uint64)
            rare = np.where(n < fewest, NEVER, ((np.uint64((1 << 32) - 1) - n) << np.uint64(31)) | (h >> np.uint64(33)))[back]
            often, size = rare != NEVER, len(rare)
            left, right = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
            before, after = often.copy(), often.copy()
            for d in range(1, LONGEST):
                chained = _chained(w.follows, d)
                ok = np.zeros(size, dtype=bool)
                ok[d:] = chained[d:] & (rare[:-d] < rare[d:])
                before &= ok
                left += before
                ok = np.zeros(size, dtype=bool)
                ok[:-d] = chained[d:] & (rare[d:] <= rare[:-d])
                after &= ok
                right += after
            at = np.flatnonzero(left + right)
            if not len(at):
                continue
            # by pivot and a bounded number at a time, so that equal fragments still meet and no table of a whole chunk is made
            at = at[np.argsort(rare[at], kind="stable")]
            for i in range(0, len(at), GROUPED):
                own = at[i : i + GROUPED]
                text = slices(w.codes, w.at[own - left[own]], w.at[own + right[own] + 1] - 1)
                t = pa.table({"lang": pa.array(lang[own]), "pivot": pa.array(rare[own].astype(np.int64)), "place": pa.array(left[own].astype(np.int8)), "fragment": text})
                t = t.group_by(["lang", "pivot", "place", "fragment"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
                seen = (1 << 32) - 1 - (t["pivot"].to_numpy() >> 31)
                for b in t.append_column("seen", pa.array(seen)).to_batches(1 << 15):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names).take(b.column("lang")), b.column("pivot"), b.column("place"), _utf8(b.column("fragment")), b.column("count_all"), b.column("seen")],
                        names=["lang", "pivot", "place", "fragment", "n", "seen"],
                    )
            pa.default_memory_pool().release_unused()

    return cut


def _chained(follows: np.ndarray, d: int) -> np.ndarray:
    """Whether each word is in one piece with the word d before it."""
    out = follows.copy()
    for i in range(1, d):
        out[i:] &= follows[:-i]
        out[:i] = False
    return out


def _mine(t: pa.Table) -> pa.Table:
    """(lang, phrase, n) of all phrases in fragments that hold their fragment's pivot, with the pivot and what is said of it."""
    text = t["fragment"].combine_chunks().cast(pa.large_binary())
    if isinstance(text, pa.ChunkedArray):
        text = text.chunk(0)
    off = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    codes = np.frombuffer(text.buffers()[2], dtype=np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    spaces = np.flatnonzero(codes == 32)
    row = np.searchsorted(off, spaces, side="right") - 1
    many = np.bincount(row, minlength=len(text)) + 1
    first = np.concatenate([[0], np.cumsum(many)])
    starts, ends = np.empty(first[-1], dtype=np.int64), np.empty(first[-1], dtype=np.int64)
    starts[first[:-1]], ends[first[1:] - 1] = off[:-1], off[1:]
    inner = np.ones(first[-1], dtype=bool)
    inner[first[:-1]] = False
    starts[inner] = spaces + 1
    ends[np.flatnonzero(inner) - 1] = spaces
    place = t["place"].to_numpy().astype(np.int64)
    of, a, b = [], [], []
    for n in range(2, LONGEST + 1):
        for d in range(n):
            begin = place - d
            rows = np.flatnonzero((begin >= 0) & (begin + n <= many))
            of.append(rows)
            a.append(starts[first[rows] + begin[rows]])
            b.append(ends[first[rows] + begin[rows] + n - 1])
    of = np.concatenate(of)
    out = t.select(["lang", "pivot", "n", "spread"]).take(pa.array(of)).append_column("phrase", slices(codes, np.concatenate(a), np.concatenate(b)))
    return out.group_by(["lang", "phrase", "pivot", "spread"], use_threads=False).aggregate([("n", "sum")])


def _miner(fewest: int, most: int):
    """Mines rows that are sorted by language and pivot, a bounded number at a time; a pivot whose rows are all there needs no other count."""

    def mine(batches) -> Iterator[pa.RecordBatch]:
        held, size, begun = [], 0, None

        def mined(t: pa.Table, open_keys: set) -> Iterator[pa.RecordBatch]:
            got = _mine(t)
            whole = pc.invert(got["spread"])
            for lang, pivot in open_keys:
                whole = pc.and_(whole, pc.invert(pc.and_(pc.equal(got["lang"], lang), pc.equal(got["pivot"], pivot))))
            got = got.filter(pc.or_(pc.invert(whole), pc.greater_equal(got["n_sum"], fewest)))
            for b in got.combine_chunks().to_batches(1 << 15):
                yield pa.RecordBatch.from_arrays([b.column("lang"), _utf8(b.column("phrase")), b.column("n_sum")], names=["lang", "phrase", "a"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows
            if size >= most:
                t = pa.Table.from_batches(held)
                last = t["lang"][size - 1].as_py(), t["pivot"][size - 1].as_py()
                yield from mined(t, {k for k in (begun, last) if k})
                begun, held, size = last, [], 0
        if held:
            yield from mined(pa.Table.from_batches(held), {begun} if begun else set())

    return mine


def _wide(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def _joined_counts(parts: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    """parts with the count of the phrase in the named column; counts of single words are spread over SALTS copies, as very many phrases ask for the same ones."""
    single = F.instr(F.col(name), " ") == 0
    salted = parts.withColumn("_salt", F.when(single, F.pmod(F.hash("phrase"), F.lit(SALTS))).otherwise(0))
    known = counts.select(
        "lang", F.col("phrase").alias(name), F.col("a").alias(f"{name}_n"), F.explode(F.when(F.instr("phrase", " ") == 0, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("_salt")
    )
    return salted.join(known, ["lang", name, "_salt"]).drop("_salt")


def phrase_counts(docs: DataFrame, fewest: int = FEWEST, chunk: int = CHUNK, rows: int = ROWS, spread: int = SPREAD) -> tuple[DataFrame, DataFrame]:
    """Exact counts (lang, phrase, a) of all phrases of 1 to 4 words that come up fewest times or more, and the languages' words (lang, n).

    First single words are counted. A table of fixed size tells every task how rare a word is; each text becomes fragments of words around
    each word (its pivot) that are no rarer, which are shuffled by language and pivot, and each task counts the phrases whose pivot it holds.
    Fragments of a pivot that is met more than spread times go to several tasks, and their partial counts are summed at the end. chunk
    (bytes of text) and rows bound what a task works on at a time; no bound changes the result.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = only(docs, "text", "lang")
    counted = keep(docs.mapInArrow(_count, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("phrase").isNull() | (F.col("a") >= fewest)))
    words = counted.where("phrase IS NOT NULL")
    table = spark.sparkContext.broadcast(cell_table(words))
    fragments = docs.mapInArrow(_fragments(table, fewest, chunk), "lang string, pivot long, place byte, fragment string, n long, seen long")
    more = F.floor(F.col("seen") / spread)
    dealt = fragments.select("lang", "pivot", "place", "fragment", "n", (more > 0).alias("spread"), F.pmod(F.xxhash64("fragment"), more + 1).alias("part")).repartition("lang", "pivot", "part").drop("part").sortWithinPartitions("lang", "pivot")
    mined = dealt.mapInArrow(_miner(fewest, rows), "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= fewest)
    return words.unionByName(keep(mined)), counted.where("phrase IS NULL").select("lang", F.col("a").alias("n"))


def collocations(docs: DataFrame, fewest: int = FEWEST, top: int = TOP, inside: int = INSIDE, **bounds: int) -> DataFrame:
    """The best phrases of two to four words of each language, by how often their parts come up together.

    (lang, rank, phrase, a, l, r, n, score): a phrase comes up a times, its parts at the cut that scores lowest l and r times, among n
    words; score = floor(2000000 a / (l + r)), in decimals, so that nothing overflows. A phrase inside a longer one that comes up inside
    hundredths as often or more is dropped. Rank goes by score, a and the phrase's UTF-8 bytes; the best are chosen in parts of a language first.

    A null text is empty, a null language is `und`. Repeated rows count as often as they are there; doc_id and other columns are not read.
    Empty tables, and texts without any word, give no rows. Texts of any length are cut in whole.
    """
    counts, totals = phrase_counts(docs, fewest, **bounds)
    found = counts.where(F.instr("phrase", " ") > 0).withColumn("m", F.length("phrase") - F.length(F.translate("phrase", " ", "")) + 1)
    ends = F.expr("explode(array(substring_index(phrase, ' ', m - 1), substring_index(phrase, ' ', 1 - m)))")
    sub = found.where("m > 2").select("lang", ends.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = found.join(sub, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (_wide(F.col("longer")) * 100 < _wide(F.col("a")) * inside)).drop("longer")
    cuts = kept.select("*", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k")).selectExpr("lang", "phrase", "a", "k", "substring_index(phrase, ' ', k) AS first", "substring_index(phrase, ' ', k - m) AS rest")
    cuts = _joined_counts(_joined_counts(cuts, counts, "first"), counts, "rest")
    score = F.expr("(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0))) div (CAST(first_n AS DECIMAL(20,0)) + CAST(rest_n AS DECIMAL(20,0)))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", F.col("first_n").alias("l"), F.col("rest_n").alias("r"))).alias("x")).select("lang", "phrase", "x.a", "x.l", "x.r", "x.score")
    order = "ORDER BY score DESC, a DESC, phrase"
    best = lowest.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang, pmod(hash(phrase), {PARTS}) {order})")).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang {order})").cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
