"""Token counts under a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton enumerates the vocabulary's pieces in a text, and dynamic programming carries the best score to each place
together with the number of pieces on its path. Of equally good paths to a place the one whose last piece begins first wins, as in the tokenizers that use
such vocabularies; a character that is no piece by itself may also be unknown, at the least score of all pieces less ten, and counts as its
bytes. Scores are added in double precision.

No piece has a word mark behind another character, or a line end, so that texts fall into units which are counted once per worker.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import arrow_rows, in_chunks
from .tokens import resolve

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_UNITS = 1_000_000
#: Fixed values of the model file: types of pieces.
NORMAL, BYTE = 1, 6
_UNITS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_LOADED: dict[str, Counter] = {}


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, bytes | int]]:
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 0:
            value, i = _varint(b, i)
        else:
            if key & 7 == 2:
                n, i = _varint(b, i)
            else:
                n = {1: 8, 5: 4}[key & 7]
            value, i = b[i : i + n], i + n
        yield key >> 3, value


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) in order of ids, from a model file."""
    out = []
    with open(path, "rb") as f:
        for field, value in _fields(f.read()):
            if field == 1:
                p = dict(_fields(value))
                out.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
    return out


class Counter:
    def __init__(self, pieces: list[tuple[str, float, int]]) -> None:
        normal = [(p, s) for p, s, kind in pieces if kind == NORMAL]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p, _ in normal):
            raise ValueError("a piece spans units")
        self.automaton = ahocorasick.Automaton()
        for p, s in normal:
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.single = {p for p, _ in normal if len(p) == 1}
        self.unknown = min((s for _, s in normal), default=0.0) - UNKNOWN_PENALTY
        self.bytes = sum(kind == BYTE for _, _, kind in pieces) == 256
        self.cache: dict[str, int] = {}

    def unit(self, text: str) -> int:
        n = len(text)
        score, count = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        last = 0

        def unknown(upto: int) -> None:
            """Edges of unknown characters to the places after last, up to upto."""
            nonlocal last
            for e in range(last + 1, upto + 1):
                c = text[e - 1]
                if c not in self.single:
                    s = score[e - 1] + self.unknown
                    if s > score[e]:
                        score[e], count[e] = s, count[e - 1] + (len(c.encode("utf-8", "surrogatepass")) if self.bytes else 1)
            last = upto

        # matches come by their ends, and for one end the longest first, which begins first
        for end, (size, s) in self.automaton.iter(text):
            e = end + 1
            if e - 1 > last:
                unknown(e - 1)
            s += score[e - size]
            if s > score[e]:
                score[e], count[e] = s, count[e - size] + 1
        unknown(n)
        return count[n]

    def units(self, text: str) -> list[str]:
        out = []
        for i, line in enumerate(text.split("\n")):
            if MARK in line or "  " in line or line[:1] == " " or line[-1:] == " ":
                out += _UNITS.findall((MARK if i == 0 else "") + line.replace(" ", MARK))
            elif line or i == 0:
                first, *rest = line.split(" ")
                out.append(MARK + first if i == 0 else first)
                out += [MARK + w for w in rest]
        return out

    def count(self, text: str) -> int:
        """Tokens of a text, which begins with a word mark of its own; none if it is empty."""
        if not text:
            return 0
        cache = self.cache
        if len(cache) > CACHE_UNITS:
            cache.clear()
        total = text.count("\n")
        for w in self.units(text):
            n = cache.get(w)
            if n is None:
                n = cache[w] = self.unit(w)
            total += n
        return total


def counter(path: str) -> Counter:
    if path not in _LOADED:
        _LOADED[path] = Counter(read_pieces(path))
    return _LOADED[path]


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) to (doc_id, n_tokens), a row for each row. Null and empty texts have none."""
    ship(docs.sparkSession)
    path = resolve(vocabulary)

    def run(batches):
        c = counter(path)
        for chunk in in_chunks(arrow_rows(batches, "doc_id", "text"), 1):
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in chunk], pa.int64()), pa.array([c.count(t or "") for _, t in chunk], pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")
