"""Token ids, their files and the packing plan against the library and plain versions."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidewatch.llm import packing, tokens, wavelet

SF = "/root/testdata/sf0.01"
ODD = [
    None, "", " ", "  ", "x ", " x", "a  b\n c ", "a\n\nb", "\n", "\na", "a\n", "a\n\n b", "tab\there \t x\r\n y", "a\x85 b\xa0 c　 d", "'", "it's WE'LL 'd x'",
    "<|endoftext|>", "one<|endoftext|>two <|startoftext|> three", "<|ENDOFTEXT|> <| x |>", "É́ ÀÉÎ ÿß İi ſ Σς", "漢字 かな 🙂🙂 é٣४²Ⅷ", "a" * 5000, "1234567890 3.14 a1b2", "%%%!!! a%%% ~`^", "zero\0byte \0", "don’t", "under_score __",
]


@pytest.mark.parametrize("name, drops", [(tokens.BYTE_BPE, False), (tokens.WORD_BPE, True)])
def test_ids(spark, monkeypatch, name, drops):
    tok = Tokenizer.from_file(tokens.resolve(name))
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    want = [[*tok.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]
    for cache, size in ((1_000_000, 1 << 23), (50, 3000)):
        monkeypatch.setattr(tokens, "CACHE_PIECES", cache)
        tokens._LOADED.clear()
        got, rows = [], 0
        for b, ids, ends in tokens.encoded([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])], tokens.resolve(name), drops, 7, size):
            got += [x.tolist() for x in np.split(ids, ends[:-1])]
            rows += b.num_rows
        assert rows == len(texts) and got == want
    tokens._LOADED.clear()


@pytest.mark.parametrize("n, top, frame", [(0, 1, 8), (1, 1, 8), (5, 0, 8), (3000, 9, 8), (3000, 49408, 32), (70000, 300, 1 << 13)])
def test_wavelet(n, top, frame):
    rng = random.Random(n + top)
    ids = np.array([min(rng.randrange(top + 1), rng.randrange(top + 1)) for _ in range(n)], dtype=np.uint32)
    cuts = sorted(rng.choices(range(n + 1), k=5))
    lengths = np.diff([0, *cuts, n])
    names = np.array([wavelet.NULL_ID, -1, 0, 5, 5, 1 << 62])
    payload = wavelet.dump(ids, names, lengths, frame)
    w = wavelet.Wavelet(payload)
    assert w.decode().tolist() == ids.tolist() and w.doc_ids.tolist() == names.tolist() and w.lengths.tolist() == lengths.tolist()
    held = ids.tolist()
    for token in {*rng.sample(held, min(n, 8)), 0, top, top + 1, 1 << 33}:
        own = [i for i, x in enumerate(held) if x == token]
        assert w.count(token) == len(own)
        assert [w.select(token, r) for r in range(min(40, len(own)))] == own[:40]
        for _ in range(5):
            a, b = sorted(rng.choices(range(n + 1), k=2))
            assert w.count(token, a, b) == held[a:b].count(token)
        with pytest.raises(IndexError):
            w.select(token, len(own))
    rare = min(Counter(held).items(), key=lambda x: x[1])[0] if n else 0
    assert w.occurrences(rare) == [i for i, x in enumerate(held) if x == rare]
    assert all(w.access(i) == held[i] for i in rng.sample(range(n), min(n, 50)))
    with pytest.raises(IndexError):
        w.access(n)
    with pytest.raises(ValueError):
        wavelet.Wavelet(payload + b"x")


def test_access_inflates_little():
    """One access inflates a frame of each plane at most."""
    ids = np.random.default_rng(1).integers(0, 1 << 16, 1 << 19).astype(np.uint32)
    w = wavelet.Wavelet(wavelet.dump(ids, np.array([0]), np.array([len(ids)])))
    assert w.access(300_000) == ids[300_000] and w.inflated <= len(w.zeros)


def test_shards_of_odd_rows(spark, tmp_path):
    """Repeated rows and rows without an id each keep a place."""
    data = [(3, "c"), (1, "a b"), (1, "a b"), (1, None), (None, "x"), (2, "y" * 3000), (None, None)]
    got = wavelet.encode_documents(spark.createDataFrame(data, "doc_id long, text string"), f"{tmp_path}/odd", shard_ids=2).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == sorted((d is not None, d or 0) for d, _ in data)
    own = sorted((r.start, r.n_tokens) for r in got)
    assert [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, None, 1, 1, 1, 2, 3]


def test_plan():
    """All pieces are placed, none twice, and no sequence is over full; pairs and triples are used, and cost nothing."""
    rng = random.Random(3)
    for capacity, n in ((20, 300), (64, 2000), (1024, 5000), (7, 1), (5, 0)):
        counts = Counter(min(capacity, 1 + int(rng.expovariate(3 / capacity))) for _ in range(n))
        patterns = packing.plan(dict(counts), capacity)
        used = Counter()
        for p, k in patterns:
            assert k > 0 and sum(p) <= capacity
            for x in p:
                used[x] += k
        assert used == counts
        total = sum(k for _, k in patterns)
        best_fit = sum(k for _, k in packing._best_fit({x: v for x, v in counts.items() if v}, capacity))
        assert -(-sum(x * v for x, v in counts.items()) // capacity) <= total <= best_fit
    assert packing.plan({5: 1, 3: 1, 2: 1}, 10) == [((5, 3, 2), 1)]
    assert packing.plan({4: 1, 3: 2, 2: 1, 1: 1}, 10) and sum(k for _, k in packing.plan({4: 1, 3: 1, 2: 1, 1: 1}, 10)) == 1


@pytest.mark.parametrize("before", ["", " "])
def test_runs_are_not_made_objects(monkeypatch, before):
    enc = tokens.Encoder(tokens.resolve(tokens.WORD_BPE), True)
    n, seen = 100_000, []
    runs = pa.array([f"{i:06d}" for i in range(n)])

    def cut(joined):
        seen.append(joined)
        return np.empty(0, np.uint32), np.zeros(n, np.int64)

    monkeypatch.setattr(enc, "_cut", cut)
    tracemalloc.start()
    enc._runs(runs, before)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == ["".join(f"{before}{i:06d}\0" for i in range(n))]
    # their number's arrays and the joined text; a string of each run took 110 bytes a run
    assert peak < 100 * n


def test_encoding_holds_little():
    """What a worker holds beyond the texts follows neither their bytes nor their distinct pieces."""
    rng = random.Random(4)
    # about 12 MB in 400,000 distinct words and as many others that come up again
    texts = [" ".join(f"{'abcdefgh'[i % 8]}{rng.getrandbits(64):x} {i * k % 997}" for i in range(500)) for k in range(800)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    path = tokens.resolve(tokens.BYTE_BPE)
    tokens._LOADED.clear()
    tokens.encoder(path, False)
    tracemalloc.start()
    rows = sum(b.num_rows for b, _, _ in tokens.encoded([batch], path, False, 2))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    tokens._LOADED.clear()
    assert rows == len(texts)
    # 61 MB; slices of 4 MB and 300,000 pieces took 200 MB
    assert peak < 100_000_000


def test_repeated_pieces_are_not_made_objects():
    """What a slice's pieces take beyond their arrays follows the distinct ones."""
    enc = tokens.Encoder(tokens.resolve(tokens.WORD_BPE), True)
    n = 200_000
    runs = "".join(f"word{'abcdefgh'[i % 8]}--\0" for i in range(n))
    enc._cut(runs)
    tracemalloc.start()
    ids, counts = enc._cut(runs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(counts) == n and counts.sum() == len(ids)
    # 48 bytes a piece; 86 where each was a string
    assert peak < 60 * 3 * n


def test_distinct_pieces():
    """Arrow's pieces are those of the library's pattern, in order."""
    rng = random.Random(5)
    seen = [chr(c) for c in (*range(0x21, 0x7F), *range(0xC0, 0x100)) if chr(c) not in "'×÷"]
    for n in (0, 1, 7, 3000):
        runs = "".join("".join(rng.choices(seen, k=rng.randint(1, 9))) + "\0" for _ in range(n)).lower()
        own, where = tokens._distinct(runs)
        assert [own[i] for i in where] == re.findall(r"\0|[a-zß-ÿ]+|[0-9]|[^a-zß-ÿ0-9\0]+", runs) and len(set(own)) == len(own)


def test_pieces_between_tasks(monkeypatch):
    """A later task merges no piece that an earlier one met, if as many may be held."""
    path, learned = tokens.resolve(tokens.WORD_BPE), []
    learn = tokens.Encoder._learn
    monkeypatch.setattr(tokens, "IDLE_PIECES", 10)
    monkeypatch.setattr(tokens.Encoder, "_learn", lambda self, pieces: (learned.append(len(pieces)), learn(self, pieces))[1])
    tokens._LOADED.clear()
    first, last = ([f"{a}{b}{c}" for a in "abcdefgh" for b in "klmnop" for c in tail] for tail in ("xy", "zw"))
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(first), " ".join(last)])], names=["text"])
    for _ in range(2):
        assert len(list(tokens.encoded([batch], path, True, 1, 8, 1000, 1000))) == 2
    tokens._LOADED.clear()
    assert learned == [96, 96, 0, 0]
