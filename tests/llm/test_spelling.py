"""Spelling variants against a comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

from tidewatch.llm import spelling

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    count = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            count[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}
    by = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, x in by.items():
        best = min(x, key=lambda y: (-n[y], y), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(by[w]), n[form[w]] if form[w] is not None else None))
    return out


def found(df):
    rows = [tuple(r[x] for x in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.variants(df).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_op12_plain(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcé×") for _ in range(rng.randrange(4, 9))) for _ in range(25)]
    words = []
    for w in base:
        times = rng.choice([80, 40, 20, 9, 3])
        words += [w] * times
        for _ in range(6):
            i, how = rng.randrange(len(w)), rng.randrange(3)
            v = w[:i] + ("" if how == 0 else rng.choice("abcé")) + w[i + (how < 2) :]
            words += [v.upper() if rng.random() < 0.1 else v] * rng.choice([1, 3, 4, 12])
            words += [v[::-1], "aaaaa", "aaaaaa"]
    for w, times in (("chain", 90), ("chein", 40), ("cheins", 17), ("cheims", 8)):
        words += [w] * times
    rng.shuffle(words)
    rows = [(i if i % 9 else None, rng.choice([" ", "-", "Ā"]).join(words[i * 40 : i * 40 + 40])) for i in range(len(words) // 40 + 1)]
    rows += [(None, None), (5, ""), (5, "Été 1234 _")] + rows[:3]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, word string").repartition(4)
    want = plain(rows)
    assert any(f for _, f, *_ in want) and any(r not in (w, f) for w, f, r, *_ in want)
    assert found(df) == want


def test_op12_long_runs(spark):
    """A run of a hundred thousand letters takes time by its length and not by its square."""
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh") for _ in range(100_000))
    other = long[:70_000] + "z" + long[70_001:]
    rows = [(i, f"{long} {other} {long[:50_000]}{long[50_001:]}") for i in range(1000, 1008)]
    rows += [(i, long) for i in range(2000, 2030)]
    got = {r.word: (r.form, r.n_near) for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[long] == (None, 2) and got[other] == (long, 1)


def test_op12_ties_and_empty(spark):
    rows = [(1, "abcde abcdf " * 4 + "abcdg " * 2), (2, "abcdg ")]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)
    assert found(spark.createDataFrame([], "doc_id long, text string")) == set()
    assert found(spark.createDataFrame([(1, None), (None, "one two")], "doc_id long, text string")) == set()
