"""Collocations against a plain count of all phrases."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from tidewatch.llm import phrases

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def plain(rows, fewest, top, inside=80):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    f = {k: a for k, a in f.items() if a >= fewest}
    within = Counter()
    for (lang, w), a in f.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                within[lang, w[i : i + m]] = max(within[lang, w[i : i + m]], a)
    by = {}
    for (lang, w), a in f.items():
        if len(w) > 1 and not 100 * within[lang, w] >= inside * a:
            score, k = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
            by.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in by.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top])}


def found(df, **more):
    return {(r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(df, **more).collect()}


def texts(seed, n, words):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "Été", "été", "x y", "a-b", "|", *(f"w{i}" for i in range(words))]
    for _ in range(n):
        t = ""
        for _ in range(rng.choice([0, 1, 3, 40, 200])):
            t += vocabulary[min(int(rng.expovariate(0.25)), len(vocabulary) - 1)] + rng.choice([" "] * 12 + ["  ", "\t", ", ", ". ", "\n", "\x0b", "!?"])
        yield rng.choice(["", " "]) + t, rng.choice(["en", "en", "en", "fr", None, "und"])


def test_op11_plain(spark):
    rows = [*texts(1, 120, 30), (None, "en"), ("", None), ("the the the the the", "fr"), *[("same words here again", "de")] * 7]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "text string, lang string, phrase int").repartition(5)
    want = plain(rows, 5, 40)
    assert want and found(df, fewest=5, top=40) == want
    # a pivot's rows cut between chunks, and spread over tasks
    assert found(df, fewest=5, top=40, chunk=300, rows=1, spread=10) == want
    assert found(df, fewest=5, top=40, chunk=2000, rows=50, spread=40) == want


def test_op11_ties_and_long_texts(spark):
    rows = [("b a. a b. é a. z a.", "en")] * 6 + [("one two " * 40000, "en"), ("x" * 200000 + " y", "en")]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert found(df, fewest=5) == plain(rows, 5, 2000)


def test_op11_empty(spark):
    assert found(spark.createDataFrame([], "text string, lang string")) == set()
    assert found(spark.createDataFrame([(None, None), (" .,\n", "en"), ("rare words", "en")], "text string, lang string")) == set()


def test_op11_wide_numbers(spark, monkeypatch):
    """Products beyond 64 bits stay exact."""
    big = 4_611_686_018_427_387_904
    counts = spark.createDataFrame([("en", "a", big), ("en", "b", big - 1), ("en", "a b", big - 7), ("en", "c", 9), ("en", "a b c", 9)], "lang string, phrase string, a long")
    totals = spark.createDataFrame([("en", big)], "lang string, n long")
    monkeypatch.setattr(phrases, "phrase_counts", lambda *_: (counts, totals))
    got = {r.phrase: (r.l, r.r, r.score) for r in phrases.collocations(spark.createDataFrame([], "text string, lang string")).collect()}
    assert got == {"a b": (big, big - 1, 2000000 * (big - 7) // (2 * big - 1)), "a b c": (big - 7, 9, 2000000 * 9 // (big + 2))}


def test_fragments_take_little_memory(monkeypatch):
    rng = np.random.default_rng(5)
    codes = rng.integers(97, 123, 1 << 20, dtype=np.uint8)
    starts = rng.integers(0, len(codes) - 40, 1 << 19)
    ends = starts + rng.integers(0, 33, len(starts))
    tracemalloc.start()
    got = phrases.slices(codes, starts, ends)
    size, peak = int((ends - starts).sum()), tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # the bytes, their offsets and what is gathered at a time; places of all bytes at once took 24 times their size
    assert peak < 8 * size
    assert got.slice(1000, 50).to_pylist() == [codes[a:b].tobytes() for a, b in zip(starts[1000:1050], ends[1000:1050])]

    class Table:
        value = np.full(phrases.CELLS, 50, dtype=np.uint32)

    words = ["ab", "c", "déf", "g", "hi"]
    rows = [(" ".join(rng.choice(words, 60)), lang) for lang in ("x", None, "y") for _ in range(5)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["text", "lang"])

    def cut():
        out = Counter()
        for b in phrases._fragments(Table, 30, 500)([batch]):
            for *key, n, _ in zip(*(c.to_pylist() for c in b.columns)):
                out[tuple(key)] += n
        return out

    want = cut()
    monkeypatch.setattr(phrases, "GROUPED", 7)
    monkeypatch.setattr(phrases, "GATHERED", 5)
    assert want and cut() == want
