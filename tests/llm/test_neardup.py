"""The parts of the n-gram join against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidewatch.llm import graph, neardup
from tidewatch.llm.common import word_hashes

from .test_brute_force import roots, shingles


def test_t_occurrence():
    rng = random.Random(1)
    for _ in range(400):
        top = rng.choice([5, 40, 400])
        lists = [sorted(rng.sample(range(top), rng.randint(0, top if rng.random() < 0.3 else max(1, top // 6)))) for _ in range(rng.randint(1, 25))]
        t = rng.randint(1, len(lists) + 1)
        counts = Counter(x for own in lists for x in own)
        want = {x: n for x, n in counts.items() if n >= t}
        for n_long in (None, 0, t - 1, 3):
            ids, found = neardup.t_occurrence([np.array(x, dtype=np.int64) for x in lists], t, n_long)
            assert dict(zip(ids.tolist(), found.tolist())) == want and ids.tolist() == sorted(ids.tolist())
    with pytest.raises(ValueError):
        neardup.t_occurrence([], 0)


def test_search_uses_t_occurrence(monkeypatch):
    """The search of a block asks for the real overlap, and no link is lost whatever the queries."""
    asked = []
    real = neardup.t_occurrence
    monkeypatch.setattr(neardup, "t_occurrence", lambda lists, t, *n: asked.append(t) or real(lists, t, *n))
    rng = np.random.default_rng(2)
    base = [rng.integers(0, 1 << 62, 60) for _ in range(8)]
    sets = []
    for _ in range(150):
        s = base[rng.integers(8)].copy()
        s[rng.choice(60, rng.integers(0, 12), replace=False)] = rng.integers(0, 1 << 62)
        sets.append(np.unique(s).astype(np.uint64))
    sets += [np.empty(0, dtype=np.uint64)] * 2
    for num in (80, 90, 95, 100):
        links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= num * len(np.union1d(sets[i], sets[j])) > 0]
        want = roots(range(len(sets)), links)
        assert roots(range(len(sets)), neardup.search_block(sets, num, 100)) == want
        got = neardup.search_block(sets, num, 100, [3, 7])
        same = [(i, j) for i, j in links if sets[i].tobytes() == sets[j].tobytes()]
        touched = [(i, j) for i, j in links if {i, j} & {3, 7} or any(sets[x].tobytes() == sets[q].tobytes() for x in (i, j) for q in (3, 7))]
        assert roots(range(len(sets)), got) == roots(range(len(sets)), same + touched)
    assert max(asked) > 40


@pytest.mark.parametrize("block", [3000, 9000])
def test_groups_over_a_block(spark, block):
    """Groups that are cut into blocks keep all of their links: copies, near copies and chains."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(70)]
    texts = [" ".join(base)] * 40
    for i in range(160):
        w = list(base)
        for _ in range(rng.choice([1, 1, 2, 5, 9])):
            w[rng.randrange(70)] = f"n{i}"
        texts.append(" ".join(w))
    for i in range(40):
        base = list(base)
        base[-1 - i] = f"c{i}"
        texts.append(" ".join(base))
    sets = [shingles(t, 3) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in neardup.link_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=block).collect()}
    assert got == roots(range(len(texts)), links)


def test_words_with_structure():
    """Words that polynomial hashes modulo a power of two take for each other have hashes of their own."""
    morse = "".join("ab"[bin(i).count("1") & 1] for i in range(4096))
    other = morse.translate(str.maketrans("ab", "ba"))
    for n in (64, 1024, 2048, 4096):
        h, _ = word_hashes([morse[:n].encode(), other[:n].encode()])
        assert h[0] != h[1]


def test_rows_of_one_id(spark):
    """Rows that share an id are judged by their own texts."""
    long_ = " ".join(f"x{i}" for i in range(60))
    near = long_.replace("x59", "y59")
    data = [(1, long_, "a"), (2, near, "b"), (2, "not alike at all " * 3, "c"), (3, "not alike at all " * 3, "d"), (4, "alone here", "e"), (4, "alone here", "e"), (None, long_, "f"), (5, None, "g"), (5, "", "h")]
    df = spark.createDataFrame(data, "doc_id long, text string, __row string")
    got = sorted(r["__row"] for r in neardup.one_of_each(df).collect())
    assert got == ["a", "c", "e", "f", "g", "h"]
    assert neardup.one_of_each(df).columns == df.columns
    comps = {r.doc_id: r.component_id for r in neardup.link_components(df, 5, 80, 100).collect()}
    assert comps == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_rounds_keep_the_plan_small(spark):
    n = 150
    edges = spark.range(n - 1).select(F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b"))
    found = graph.components(edges, local_edges=10)
    low = spark.range(n).select(F.xxhash64("id").alias("x")).agg(F.min("x")).first()[0]
    assert found.groupBy("component").count().collect() == [Row(component=low, count=n)]
    # what Spark expects of the rows' size: with checkpoints alone it took four times the digits after each round
    for df in (found, graph.components(edges), graph.relabel(found, edges)):
        assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 60
