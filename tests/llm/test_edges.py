"""Inputs on which the text operators once did less than the whole job."""

import random
import re
from collections import Counter

import pytest

from tidewatch.llm import decontam, embeddings, langid


def test_op7_copies(spark, monkeypatch):
    """Languages of few distinct, very often repeated or very long texts are learned, from each text once and within the bound."""
    rows = [(f"{a} {i} " * 60, lang) for lang, a in (("aa", "lorem ipsum"), ("bb", "dolor sit")) for i in range(5) for _ in range(200)]
    rows += [("tiny", "cc"), ("\u00e9t\u00e9 " * 5000, "cc"), ("short text", "dd")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    bound = 2000
    seen = {}
    real = langid.fit
    monkeypatch.setattr(langid, "fit", lambda samples: seen.update(samples) or real(samples))
    model = langid.train(docs, "text != ''", bound)
    assert model is not None and model.langs == ["aa", "bb", "cc", "dd"]
    for lang, own in seen.items():
        distinct = {t.encode() for t, k in rows if k == lang}
        assert len(own) == len(set(own))
        assert sum(map(len, own)) == min(bound, sum(map(len, distinct)))
        assert all(any(t.startswith(x) for t in distinct) for x in own)


def test_op7_too_many_languages(spark):
    """Every language is learned, or none."""
    docs = spark.createDataFrame([(f"text {i}", f"l{i:02}") for i in range(5)], "text string, lang string")
    assert langid.train(docs, "text != ''", max_languages=5).langs == [f"l{i:02}" for i in range(5)]
    with pytest.raises(ValueError, match="more than 4 languages"):
        langid.train(docs, "text != ''", max_languages=4)


def test_op9_short_documents(spark):
    """Documents with fewer words than an item are compared as a whole."""
    rng = random.Random(7)
    items = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(n))) for i, n in enumerate((40, 40, 25, 12, 6, 5, 4, 1))]
    docs = []
    for _, t in items:
        w = t.split()
        for gone in range(13):
            for a in range(gone + 1):
                docs.append(" ".join(w[a : len(w) - gone + a]))
        docs.append(" ".join([*w[:20], "other", *w[21:-1]]))
    docs = list(enumerate([None, "", *docs]))
    want = {}
    for d, t in docs:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        for i, x in items:
            y = x.split()
            k = min(5, len(y))
            bag = Counter(tuple(y[a : a + k]) for a in range(len(y) - k + 1))
            own = [tuple(w[a : a + k]) for a in range(len(w) - k + 1)]
            size = min(len(y) - k + 1, len(own))
            best = max((decontam.similarity(Counter(own[a : a + size]), bag) for a in range(len(own) - size + 1)), default=0) if own else 0
            if best >= 0.8:
                want[d, i] = best
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.matches(df, bench).collect()}
    assert got == want
    assert any(len(docs[d][1].split()) < len(items[i][1].split()) for d, i in want)
    assert {r.doc_id for r in decontam.clean(df, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_op3_extreme_doubles(spark):
    """Vectors whose squares leave the range of doubles have cosines like any."""
    v = [3.0, -4.0, 1.0]
    rows = [(1, v), (2, [x * 1e-200 for x in v]), (3, [x * 1e200 for x in v]), (4, [-x * 1e200 for x in v]), (5, [0.0] * 3), (6, [float("inf"), 1.0, 1.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5), 6: (0, 6)}
