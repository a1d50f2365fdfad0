"""Spelling variants without pairs: words that share all but one place meet in wildcard groups, and deletions meet the vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import keep, mix, only

#: Runs of letters, shortest word and fewest occurrences, and the share of runs that lose a code point (one in so many).
LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
SHORTEST, FEWEST, DAMAGED = 5, 3, 97
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points whose keys are made at a time.
CHUNK = 1 << 18

_SEEDS = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A47))


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST, damaged: int = DAMAGED) -> DataFrame:
    """(word, n): the lower-cased runs of letters of all texts, where one in damaged has lost a code point by the checksum of document and run."""
    runs = only(docs, "doc_id", "text").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("own"), F.translate("run", UPPER, LOWER).alias("run"))
    h = runs.withColumn("h", F.crc32(F.encode(F.concat("own", "run"), "UTF-8")))
    at = "CAST(h % length(run) AS INT)"
    word = F.expr(f"CASE WHEN h % {damaged} = 0 THEN concat(substring(run, 1, {at}), substring(run, {at} + 2)) ELSE run END")
    return h.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= fewest)


def _hashes(seed: np.uint64, codes: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix((place.astype(np.uint64) << np.uint64(21) | codes) + seed)


def _keys_of(words: list[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, row, key, key): a word's own key, a key for each place left open, and one for each word that deleting a code point gives.

    A string's hash is the sum over its code points of scrambled (code point, place) pairs, so leaving a place open or closing a gap takes
    a step each from sums up to and from each place: the work goes by the words' lengths. Two such hashes make a key of 128 bits.
    """
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    size = np.array([len(w) for w in words], dtype=np.int64)
    first = np.cumsum(size) - size
    row = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(codes)) - first[row]
    # deleting any of several equal neighbours gives the same word: the first of them stands for all
    again = np.zeros(len(codes), dtype=bool)
    again[1:] = (codes[1:] == codes[:-1]) & (place[1:] > 0)
    whole, opened, closed = [], [], []
    for seed in _SEEDS:
        here, back, hole = _hashes(seed, codes, place), _hashes(seed, codes, np.maximum(place - 1, 0)), _hashes(seed, np.full(len(codes), (1 << 21) - 1, dtype=np.uint64), place)
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(here)])
        moved = np.concatenate([np.zeros(1, np.uint64), np.cumsum(back)])
        length = _hashes(seed, np.full(len(words), (1 << 21) - 2, dtype=np.uint64), size)
        shorter = _hashes(seed, np.full(len(words), (1 << 21) - 2, dtype=np.uint64), size - 1)
        total = upto[first + size] - upto[first] + length
        whole.append(total)
        opened.append(total[row] - here + hole)
        at = np.arange(len(codes))
        closed.append(upto[at] - upto[first[row]] + moved[first[row] + size[row]] - moved[at + 1] + shorter[row])
    yield "word", np.arange(len(words)), *whole
    yield "open", row, *opened
    yield "less", row[~again], *(x[~again] for x in closed)


def _keys(batches) -> Iterator[pa.RecordBatch]:
    def made(words, ranks):
        for kind, row, a, b in _keys_of(words):
            for i in range(0, len(row), CHUNK):
                r = row[i : i + CHUNK]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(kind), len(r)), pa.array(a[i : i + CHUNK].view(np.int64)), pa.array(b[i : i + CHUNK].view(np.int64)), ranks.take(pa.array(r))], names=["kind", "a", "b", "rank"]
                )

    for t in batches:
        words, ranks = t.column("word").to_pylist(), t.column("rank").combine_chunks() if isinstance(t.column("rank"), pa.ChunkedArray) else t.column("rank")
        begun, size = 0, 0
        for i, w in enumerate(words):
            if size + len(w) > CHUNK and i > begun:
                yield from made(words[begun:i], ranks.slice(begun, i - begun))
                begun, size = i, 0
            size += len(w)
        if words:
            yield from made(words[begun:], ranks.slice(begun))


def nearest(ranked: DataFrame) -> DataFrame:
    """(rank, n_near, best): how many words differ by one code point from each ranked word, and the lowest rank among them."""
    keys = keep(ranked.mapInArrow(_keys, "kind string, a long, b long, rank long"))
    # as many words share all but one place as there are letters: a group is bounded by the alphabet
    groups = keys.where("kind = 'open'").groupBy("a", "b").agg(F.collect_list("rank").alias("ranks")).where(F.size("ranks") > 1)
    groups = groups.select(F.size("ranks").alias("size"), F.array_min("ranks").alias("top"), F.expr("array_min(array_remove(ranks, array_min(ranks)))").alias("second"), F.explode("ranks").alias("rank"))
    swapped = groups.select("rank", (F.col("size") - 1).alias("near"), F.when(F.col("rank") == F.col("top"), F.col("second")).otherwise(F.col("top")).alias("best"))
    met = keys.where("kind = 'word'").select("a", "b", F.col("rank").alias("short")).join(keys.where("kind = 'less'").select("a", "b", F.col("rank").alias("long")), ["a", "b"])
    met = met.select("short", "long")
    longer = met.groupBy(F.col("short").alias("rank")).agg(F.count("*").alias("near"), F.min("long").alias("best"))
    shorter = met.groupBy(F.col("long").alias("rank")).agg(F.count("*").alias("near"), F.min("short").alias("best"))
    return swapped.unionByName(longer).unionByName(shorter).groupBy("rank").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(rank, root) of links (rank, to): the end of each one's chain, whose length doubles with each round; a link leads to a lower rank."""
    now = keep(forms)
    while True:
        ahead = now.select(F.col("rank").alias("to"), F.col("to").alias("then"))
        new = keep(now.join(ahead, "to", "left").select("rank", F.coalesce("then", "to").alias("to"), F.col("then").isNotNull().alias("moved")))
        if not new.where("moved").limit(1).count():
            return new.select("rank", F.col("to").alias("root"))
        now = new.select("rank", "to")


def variants(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST, damaged: int = DAMAGED) -> DataFrame:
    """Each word's common form among those that differ by one inserted, deleted or replaced code point, and the root of its forms.

    (word, form, root, n, n_near, form_n). Words are ranked by falling count and then by code points. Places are left open for
    replacements: a group of words that agree elsewhere keeps its size and its two first words. Deletions meet the vocabulary for
    insertions and deletions. Keys are hashes of 128 bits. A form comes up at least twice as often as its word, so chains of forms are short.

    A null text has no words; a null doc_id counts as an empty one in the checksum; repeated rows count each; other columns are not read.
    Of equally frequent near words the smaller in code-point order is the form. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    words = vocabulary(docs, shortest, fewest, damaged).orderBy(F.desc("n"), "word")
    ranked = keep(words.select("word", "n", F.monotonically_increasing_id().alias("rank")))
    near = nearest(ranked)
    by_rank = ranked.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    known = keep(ranked.join(near, "rank", "left").join(by_rank, "best", "left").withColumn("ok", F.coalesce(F.col("form_n") >= 2 * F.col("n"), F.lit(False))))
    last = roots(known.where("ok").select("rank", F.col("best").alias("to"))).join(ranked.select(F.col("rank").alias("root"), F.col("word").alias("root_word")), "root").select("rank", "root_word")
    return known.join(last, "rank", "left").select(
        "word", F.when(F.col("ok"), F.col("form")).alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("ok"), F.col("form_n")).alias("form_n")
    )
