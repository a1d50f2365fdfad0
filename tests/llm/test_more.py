"""Parts of the text operators that the brute-force tests of the whole do not see."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import decontam, pii, suffixes, toxicity
from tidewatch.llm.common import MARKS, shared_folder, word_hashes

CASES = [
    ("see https://example.org/a?b=c). and ftp://x.y/z,", ["url:4:29", "url:36:47"]),
    ("http://localhost no dot; xhttps://in.word no", []),
    ("IBAN: DE89 3704 0044 0532 0130 00, IBAN: DE88 3704 0044 0532 0130 00", ["iban:6:33"]),
    ("account number: 12345678; ssn=078-05-1120 ; account: none", ["account:16:24", "account:30:41"]),
    ("@some_name and a@b @x1", ["handle:0:10"]),
    ('token = "04dbebab91ab85687d33eeaa" TOKEN = "9233A8ECF7C5B09FE5949719"!! password: aaaaaaaaaaaaaaaaaaaa secret=abc1', ["secret:9:33", "secret:44:68"]),
    ("mail a@b.example https://a@b.example/x", ["email:5:16", "email:25:36"]),
]


@pytest.mark.parametrize("text, want", CASES)
def test_op6_added_kinds(text, want):
    assert pii.joined(pii.find(text)) == ",".join(want)
    assert not any(x.split(":")[0] not in pii.KINDS for x in want)


def test_op6_many_spans():
    """Time follows a text's length, however many spans it has; added spans overlap nothing."""
    part = "https://a.example/b @name_one token = 0123456789abcdef01 1.2.3.4 a@b.cc "
    spans = pii.find(part * 40)
    assert len(spans) == 200
    flat = sorted((a, b) for a, b, _ in spans)
    assert all(x[1] <= y[0] for x, y in zip(flat, flat[1:]))
    took = []
    for n in (1500, 6000):
        began = time.process_time()
        pii.find(part * n)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0]


def test_op2_blocks(spark):
    """Anchors with more occurrences than a block: what blocks share goes as well, and nothing else does."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    shared, short = word(70), word(25)
    texts = [word(rng.randint(0, 60)) + rng.choice([shared, shared[10:], short, shared[:45], ""]) + word(rng.randint(0, 60)) for _ in range(160)] + [shared] * 3
    length, gram = 40, 12
    raw = [t.encode() for t in texts]
    seen = Counter(t[p : p + length] for t in raw for p in range(len(t) - length + 1))
    want = {}
    for i, t in enumerate(raw):
        gone = np.zeros(len(t) + 1, dtype=bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        want[i] = int(gone.sum()), hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for group in (2, 7, 50):
        assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffixes.remove_repeats(df, length, gram, group).collect()} == want


def test_op9_repeated_items(spark):
    """An item id with several texts keeps its best match, in however many parts the items are; equal document rows each have their own."""
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(1, " ".join(words)), (1, " ".join(words[:35] + ["x"] * 5)), (2, " ".join(words[::-1]))], "item_id long, text string")
    docs = spark.createDataFrame([(7, "a b " + " ".join(words) + " c"), (7, "a b " + " ".join(words) + " c"), (None, " ".join(words)), (8, None)], "doc_id long, text string")
    for part_bytes in (20, 1 << 20):
        got = [(r.doc_id, r.item_id, r.similarity) for r in decontam.matches(docs, items, part_bytes=part_bytes).collect()]
        assert sorted(got, key=str) == sorted([(7, 1, 1.0), (7, 1, 1.0), (None, 1, 1.0)], key=str)


def test_op10_large_sample(spark):
    """Held-out recall and clean documents where the labels are many enough for each language's insults to be learned."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    test = F.pmod(F.xxhash64("doc_id", F.lit("test")), F.lit(3)) == 0
    found = {r.doc_id for r in toxicity.toxic_documents(docs, labels.where(~test)).collect()}
    own = {r.doc_id: r.toxic for r in labels.where(test & F.col("toxic").isNotNull()).join(docs.select("doc_id"), "doc_id").collect()}
    toxic = {i for i, y in own.items() if y == 1}
    assert len(toxic) > 100 and len(toxic & found) >= 0.9 * len(toxic)
    assert len({i for i in own if i in found} - toxic) <= 0.02 * len(own)


def test_op10_odd_rows(spark):
    """Null, empty and very long texts, repeated rows, null ids and labels, and columns that clash."""
    bad, good = "you awful dreck person ", "a quiet walk by the sea "
    rows = [(i, (bad if i % 4 == 0 else good) + f"number {i}", "t", 0.5) for i in range(200)]
    rows += [(500, None, "t", 0.5), (501, "", "t", 0.5), (502, good * 30_000 + bad, "t", 0.5), (503, bad, "t", 0.5), (503, bad, "t", 0.5), (None, bad, "t", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string, p_toxic double")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)] + [(500, None, None), (None, 1, 1), (0, 1, 1)], "doc_id long, quality int, toxic int")
    got = [r.doc_id for r in toxicity.toxic_documents(docs, labels).collect()]
    assert Counter(got) == Counter([*range(0, 200, 4), 502, 503, 503, None])


def test_stems():
    h, longer = word_hashes([b"abcdef abcdxy abc"], MARKS, 4)
    assert h[0] == h[1] != h[2] and longer.tolist() == [True, True, False]
    assert h[2] == word_hashes([b"abc"])[0][0]


def test_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})

    with pytest.raises(ValueError):
        shared_folder(Session())
