"""Language ID by prediction by partial matching over bytes.

Each language has a context tree of order 0 to 3. A byte seen after a context costs log2((n + t) / c), n being the context's
bytes, t its distinct bytes and c the byte's count there; any other byte costs an escape, log2((n + t) / t), and then what
it costs after the shorter context; below order 0 all 256 bytes cost 8 bits. Statistics are frozen after training, so the
costs of all contexts are laid out as tables once and a text's code length is a sum of gathered entries.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import arrow_rows, in_chunks

#: Text of at most so many bytes trains each language: distinct texts, in the order of a hash.
TRAIN_BYTES = 1_500_000
#: The driver fits at most so many languages; with more it stops.
MAX_LANGUAGES = 64
#: Bytes of text that are coded at a time: each takes some hundred bytes of memory.
CHUNK_BYTES = 1 << 19
#: A text that its best language codes worse than plain bytes would be is in none of the languages.
PLAIN_BITS = 8.0
UND = "und"
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    langs: list[str]
    symbol: np.ndarray  # of each byte; 0: never trained on, and the start of a text
    size: int
    node: np.ndarray  # of each context of order 3, or -1
    bits: np.ndarray  # (context of order 2, symbol) and then (node, symbol), by language

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text in each language."""
        a = self.size
        s = self.symbol[np.frombuffer(b"".join(b"\0\0\0" + t for t in texts), dtype=np.uint8)].astype(np.int64)
        at = np.cumsum([0] + [len(t) + 3 for t in texts])
        for i in range(3):
            s[at[:-1] + i] = 0
        pair = s[1:-2] * a + s[2:-1]
        node = self.node[s[:-3] * (a * a) + pair]
        entry = np.where(node >= 0, a * a + node, pair) * a + s[3:]
        cost = self.bits[entry].astype(np.float64)
        total = np.zeros((len(s) + 1, len(self.langs)))
        np.cumsum(cost, axis=0, out=total[4:])
        # text i codes the positions at[i] + 3 to at[i + 1]; total[j] sums what stands before position j
        return total[at[1:]] - total[at[:-1] + 3]


def _counts(s: np.ndarray, ok: np.ndarray, order: int, a: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, symbol, count) of the given order where ok."""
    key = np.zeros(len(s) - 3, dtype=np.int64)
    for i in range(3 - order, 4):
        key = key * a + s[i : i + len(s) - 3]
    key, n = np.unique(key[ok[3:]], return_counts=True)
    return key // a, key % a, n


def _stats(texts: list[bytes], symbol: np.ndarray, a: int, piece: int = 1 << 18) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(context, symbol, times) of each order, of a few texts or pieces of one at a time."""
    found: list[list[tuple]] = [[] for _ in range(4)]
    for t in texts:
        for at in range(0, len(t), piece):
            # three symbols go before a piece: those of the text, and zeros at its start
            s = np.concatenate([np.zeros(3, dtype=np.int64), symbol[np.frombuffer(t[max(0, at - 3) : at + piece], dtype=np.uint8)]])[min(at, 3) :]
            ok = np.arange(len(s)) >= 3
            for order in range(4):
                ctx, sym, n = _counts(s, ok, order, a)
                found[order].append((ctx * a + sym, n))
    out = []
    for own in found:
        key, at = np.unique(np.concatenate([k for k, _ in own]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([n for _, n in own])).astype(np.int64)
        out.append((key // a, key % a, n))
    return out


def fit(samples: dict[str, list[bytes]]) -> Model | None:
    langs = sorted(k for k, v in samples.items() if any(v))
    if not langs:
        return None
    seen = np.zeros(256, dtype=bool)
    for k in langs:
        for t in samples[k]:
            seen[np.frombuffer(t, dtype=np.uint8)] = True
    symbol = np.zeros(256, dtype=np.uint8) if seen.sum() < 256 else np.zeros(256, dtype=np.uint16)
    symbol[seen] = np.arange(1, seen.sum() + 1)
    a = int(seen.sum()) + 1
    stats = []
    for k in langs:
        stats.append(_stats(samples[k], symbol, a))
    contexts = np.unique(np.concatenate([x[3][0] for x in stats]))
    node = np.full(a**3, -1, dtype=np.int32)
    node[contexts] = np.arange(len(contexts))
    bits = np.empty(((a * a + len(contexts)) * a, len(langs)), dtype=np.float32)
    for j, orders in enumerate(stats):
        below = np.full((1, a), 8.0)
        for order, (ctx, sym, n) in enumerate(orders):
            if order < 3:
                own = np.arange(a**order)
                cost = np.tile(below, (1 if order == 0 else a, 1))  # the shorter context is the index without its first symbol
            else:
                own = contexts
                cost = below[contexts % (a * a)]
                ctx = np.searchsorted(contexts, ctx)
            total = np.bincount(ctx, weights=n, minlength=len(own))
            kinds = np.bincount(ctx, minlength=len(own))
            had = kinds > 0
            cost[had] += np.log2((total[had] + kinds[had]) / kinds[had])[:, None]
            cost[ctx, sym] = np.log2((total[ctx] + kinds[ctx]) / n)
            if order == 2:
                bits[: a**3, j] = cost.ravel()
            elif order == 3:
                bits[a**3 :, j] = cost.ravel()
            below = cost
    return Model(langs, symbol, a, node, bits)


def _by_lang(values: dict):
    """The value of a row's language; null for other languages."""
    out = F.lit(None).cast("long")
    for k, v in values.items():
        out = F.when(F.col("lang") == k, F.lit(v)).otherwise(out)
    return out


def _last_hashes(rows: DataFrame, train_bytes: int) -> dict[str, int]:
    """Of each language with more than train_bytes of distinct texts, the hash of the text that fills them, in the order of the hashes."""
    cell = F.shiftright("h", 54)
    distinct = rows.groupBy("lang", "h").agg(F.max(F.octet_length("text")).alias("n"))
    cells: dict[str, list[tuple[int, int]]] = {}
    for r in distinct.groupBy("lang", cell.alias("cell")).agg(F.sum("n").alias("n")).collect():
        cells.setdefault(r["lang"], []).append((r["cell"], r["n"]))
    full = {}
    for k, own in cells.items():
        at = 0
        for c, n in sorted(own):
            if at + n > train_bytes:
                full[k] = c, at
                break
            at += n
    last, filled = {}, {k: at for k, (_, at) in full.items()}
    if full:
        for r in sorted(distinct.where(cell == _by_lang({k: c for k, (c, _) in full.items()})).collect(), key=lambda r: r["h"]):
            if filled[r["lang"]] < train_bytes:
                last[r["lang"]] = r["h"]
                filled[r["lang"]] += r["n"]
    return last


def train(docs: DataFrame, learn, train_bytes: int = TRAIN_BYTES, max_languages: int = MAX_LANGUAGES) -> Model | None:
    """Fit on rows (text, lang) where learn holds and lang is given.

    Each language gets its distinct texts in the order of their hashes up to train_bytes, the last one cut there; all of them if they are less.
    More than max_languages languages are an error: none is left out.
    """
    ship(docs.sparkSession)
    rows = docs.where(learn).where("lang IS NOT NULL AND text IS NOT NULL AND text != ''").select("text", "lang", F.xxhash64("text").alias("h"))
    sizes = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).limit(max_languages + 1).collect()
    if len(sizes) > max_languages:
        raise ValueError(f"labelled text in more than {max_languages} languages, which is what one model holds")
    upto = {r["lang"]: (1 << 63) - 1 for r in sizes}
    if large := [r["lang"] for r in sizes if r["n"] > train_bytes]:
        upto |= _last_hashes(rows.where(F.col("lang").isin(large)), train_bytes)
    # a character is a byte at least
    drawn = rows.where(F.col("h") <= _by_lang(upto)).groupBy("lang", "h").agg(F.first(F.substring("text", 1, train_bytes)).alias("text"))
    texts: dict[str, list[tuple[int, bytes]]] = {}
    for r in drawn.collect():
        texts.setdefault(r["lang"], []).append((r["h"], r["text"].encode("utf-8", "replace")))
    samples: dict[str, list[bytes]] = {}
    for k, own in texts.items():
        left = train_bytes
        for _, t in sorted(own):
            samples.setdefault(k, []).append(t[:left])
            left -= len(samples[k][-1])
    return fit({k: sorted(t for t in v if t) for k, v in samples.items()})


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, text) to (doc_id, lang_pred, score, bits_per_byte).

    A null text, and one without a letter, is `und` with score 0 and null bits. score is the probability of the language
    given the text under equal priors. Ties go to the first language by name; repeated rows are answered row by row.
    """
    ship(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)

    def run(batches):
        m = shared.value
        for chunk in in_chunks(((i, t, None if t is None else t.encode("utf-8", "replace")) for i, t in arrow_rows(batches, "doc_id", "text")), 2, CHUNK_BYTES):
            ok = [m is not None and t is not None and _LETTER.search(t) is not None for _, t, _ in chunk]
            pred, score, bits = [UND] * len(chunk), [0.0] * len(chunk), [None] * len(chunk)
            if any(ok):
                at = [i for i, x in enumerate(ok) if x]
                cost = m.lengths([chunk[i][2] for i in at])
                best = cost.argmin(axis=1)
                least = cost[np.arange(len(at)), best]
                p = 1 / np.exp2(np.maximum(least[:, None] - cost, -1000)).sum(axis=1)
                for j, i in enumerate(at):
                    pred[i], score[i], bits[i] = m.langs[best[j]], float(p[j]), float(least[j] / len(chunk[i][2]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in chunk], pa.int64()), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], names=["doc_id", "lang_pred", "score", "bits_per_byte"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, bits_per_byte double")


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2. A null id is never held out, and never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """documents to (doc_id, held_out, lang_pred, score, bits_per_byte), learning from the rows that are not held out."""
    model = train(docs, F.col("doc_id").isNotNull() & ~held_out(), train_bytes)
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


def accepted(docs: DataFrame, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """The rows of documents, columns and all, whose text is in a learned language: not `und`, and coded in fewer bits than plain bytes.

    The decision is on the row itself, so that repeated ids stay apart.
    """
    model = train(docs, F.col("doc_id").isNotNull() & ~held_out(), train_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            good = []
            for chunk in in_chunks(((t, None if t is None else t.encode("utf-8", "replace")) for (t,) in arrow_rows([b], "text")), 1, CHUNK_BYTES):
                ok = np.array([m is not None and t is not None and _LETTER.search(t) is not None for t, _ in chunk])
                if ok.any():
                    texts = [x for (_, x), y in zip(chunk, ok) if y]
                    ok[ok] = m.lengths(texts).min(axis=1) <= PLAIN_BITS * np.array([len(x) for x in texts])
                good.append(ok)
            if good:
                yield b.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(run, docs.schema)
