"""Token ids of whole texts by the tokenizers library, each distinct piece of a word merged once per worker.

Both vocabularies split text before they merge, and never across a blank that follows another character: the byte-level one
begins a piece at such a blank, the other drops white space. So a text's ids are those of its runs between blanks in a row. Where that may not
hold (white space before a blank in the byte-level one, or what could be a special token's string), the library encodes the whole text.

Arrow splits a slice of texts and numbers its distinct runs. Runs of Latin letters, digits and ASCII marks are cut into the pieces that the library's
own patterns would give, and its model merges each new piece; the library encodes any other run as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

#: A worker forgets the pieces that it has not just met when it holds so many, and between tasks.
CACHE_PIECES, IDLE_PIECES = 100_000, 50_000
#: Bytes of text that are encoded at a time; a longer text is one slice.
SLICE_BYTES = 1 << 20
BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Any white space before a blank.
_BEFORE_BLANK = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
#: How the special tokens of both vocabularies begin.
_SPECIAL = "<|"
#: Characters of the runs that are cut here; an apostrophe is not among them, as both patterns give it a meaning.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", re.escape("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
_SEEN = f"[{_LETTERS}0-9{_MARKS}]"
#: Of each byte of lower-cased runs of such characters: a zero byte, a letter's, a digit or a mark.
_KINDS = np.full(256, 3, dtype=np.uint8)
_KINDS[0], _KINDS[ord("0") : ord("9") + 1], _KINDS[ord("a") : ord("z") + 1], _KINDS[0x80:] = 0, 2, 1, 1
_LOADED: dict[str, Encoder] = {}


class Encoder:
    """The ids of slices of texts."""

    def __init__(self, path: str, drops_space: bool) -> None:
        self.tok = Tokenizer.from_file(path)
        # the library's alphabet for bytes, learned from characters that hold all bytes which can come up
        held = "".join(map(chr, range(256)))
        ((mapped, _),) = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(held)
        self.alphabet = {ord(a): b for a, b in zip(held.encode().decode("latin-1"), mapped)}
        self.drops_space, self.most, self.most_idle = drops_space, CACHE_PIECES, IDLE_PIECES
        if drops_space:
            self.runs = f"^{_SEEN}+$"
        else:
            self.runs, self.pieces = f"^{_SEEN}(\n?{_SEEN})*\n?$", re.compile(f"\0| ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+|\n")
        self.known: dict[str, int] = {"\0": 0}
        self.met: list[str] = []
        self.ids, self.used = np.empty(0, dtype=np.uint32), 0
        self.begin, self.size = (np.zeros(1, dtype=np.int64) for _ in range(2))

    def _keep(self, pieces: list[str]) -> None:
        """Forget all pieces but these, which are known; the zero byte, which parts runs, has place 0 and no ids."""
        at = np.array([0, *map(self.known.__getitem__, pieces)], dtype=np.int64)
        self.size = self.size[at]
        self.ids, ends = _gather(self.ids, self.begin[at], self.size)
        self.begin, self.used = ends - self.size, len(self.ids)
        self.known = {"\0": 0} | dict(zip(pieces, range(1, len(at))))

    def idle(self) -> None:
        """What comes up often comes up in any slice: only the last one's pieces are held between tasks, if all are too many."""
        if len(self.known) > self.most_idle:
            self._keep([x for x in self.met if x != "\0"])
        self.met = []
        pa.default_memory_pool().release_unused()

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        if not pieces:
            return
        merge = self.tok.model.tokenize
        ids = [[t.id for t in merge(x)] for x in "\0".join(pieces).encode().decode("latin-1").translate(self.alphabet).split(self.alphabet[0])]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        n, end = len(self.known), self.used + int(sizes.sum())
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(2 * end - self.used, dtype=np.uint32)])
        if n + len(pieces) > len(self.begin):
            self.begin, self.size = (np.concatenate([x[:n], np.empty(2 * n + len(pieces), dtype=np.int64)]) for x in (self.begin, self.size))
        self.ids[self.used : end] = np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=end - self.used)
        self.begin[n : n + len(pieces)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(pieces)] = sizes
        self.known.update(zip(pieces, range(n, n + len(pieces))))
        self.used = end

    def _cut(self, runs: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids, and their number for each run, of runs with a zero byte after each."""
        if self.drops_space:
            own, where = _distinct(runs.lower())
            pieces = own
        else:
            pieces, where = self.pieces.findall(runs), slice(None)
            own = list(set(pieces))
        new = [x for x in own if x not in self.known]
        if len(self.known) + len(new) > self.most:
            # what comes up often comes up in this slice as well, or in the one before where both fit
            both = {**dict.fromkeys(self.met), **dict.fromkeys(own)} if self.drops_space and len(self.met) + len(own) <= self.most else own
            self._keep([x for x in both if x in self.known and x != "\0"])
        self._learn(new)
        self.met = own
        at = np.fromiter(map(self.known.__getitem__, pieces), dtype=np.int64, count=len(pieces))[where]
        ids, ends = _gather(self.ids, self.begin[at], self.size[at])
        return ids, np.diff(ends[at == 0], prepend=0)

    def _runs(self, runs: pa.Array, before: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct runs, and where those of each begin and how many they are. before: what stands before each in its text."""
        plain = pc.match_substring_regex(runs, self.runs)
        own = runs.filter(plain)
        # joined by Arrow, which makes no object of each run
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(own)], own), "\0" + before)[0].as_py()
        ids, sizes = self._cut(before + joined + "\0") if len(own) else (np.empty(0, np.uint32), np.empty(0, np.int64))
        plain = plain.to_numpy(zero_copy_only=False)
        rest = self._whole([before + r for r in runs.filter(pa.array(~plain)).to_pylist()])
        size = np.empty(len(runs), dtype=np.int64)
        size[plain], size[~plain] = sizes, [len(x) for x in rest]
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        begin = np.empty(len(runs), dtype=np.int64)
        begin[order] = np.cumsum(size[order]) - size[order]
        return np.concatenate([ids, np.array([x for own in rest for x in own], dtype=np.uint32)]), begin, size

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.drops_space:
            texts = pc.replace_substring(texts, "\n", " ")
        lists = pc.split_pattern(texts, " ")
        at = lists.offsets.to_numpy()
        runs = lists.values.slice(at[0], at[-1] - at[0])
        first = at[:-1] - at[0]
        coded = runs.dictionary_encode()
        ids, begin, size = self._runs(coded.dictionary, "" if self.drops_space else " ")
        where = coded.indices.to_numpy()
        begin, size = begin[where], size[where]
        if not self.drops_space:
            # no blank stands before a text's first run
            heads, head_begin, head_size = self._runs(runs.take(pa.array(first)), "")
            begin[first], size[first] = len(ids) + head_begin, head_size
            ids = np.concatenate([ids, heads])
        out, _ = _gather(ids, begin, size)
        return out, np.add.reduceat(size, first)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and their number for each text. A null text counts as empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring(texts, _SPECIAL)
        if not self.drops_space:
            odd = pc.or_(odd, pc.match_substring_regex(texts, _BEFORE_BLANK))
        odd = odd.to_numpy(zero_copy_only=False)
        ids, counts = self._plain(texts.filter(pa.array(~odd))) if not odd.all() else (np.empty(0, np.uint32), np.empty(0, np.int64))
        if not odd.any():
            return ids, counts
        out: list[np.ndarray] = [ids] * len(texts)
        for i, x in zip(np.flatnonzero(~odd), np.split(ids, np.cumsum(counts)[:-1])):
            out[i] = x
        for i in np.flatnonzero(odd):
            out[i] = np.array(self._whole([texts[int(i)].as_py()])[0], dtype=np.uint32)
        return np.concatenate(out), np.fromiter(map(len, out), dtype=np.int64, count=len(out))


def _distinct(runs: str) -> tuple[list[str], np.ndarray]:
    """The distinct pieces of lower-cased runs, and which of them stands at each place: zero bytes, words, single digits and rows of marks.

    Arrow numbers them, so that no object is made of a piece that comes up again.
    """
    held = np.frombuffer(runs.encode(), dtype=np.uint8)
    kinds = _KINDS[held]
    first = (kinds == 2) | (kinds == 0)
    first[:1] = True
    first[1:] |= kinds[1:] != kinds[:-1]
    begin = np.append(np.flatnonzero(first), len(held))
    # the places of a slice's bytes pass 32 bits only with a text that does
    kind, width = (pa.string(), np.int32) if len(held) < 1 << 31 else (pa.large_string(), np.int64)
    coded = pa.Array.from_buffers(kind, len(begin) - 1, [None, pa.py_buffer(begin.astype(width)), pa.py_buffer(held)]).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()


def _gather(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[b : b + n] of each b and n in a row, and where they end."""
    ends = np.cumsum(size)
    at = np.repeat(begin - (ends - size), size)
    at += np.arange(len(at))
    return values[at], ends


def encoder(path: str, drops_space: bool) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path, drops_space)
    return _LOADED[path]


def encoded(batches, vocabulary: str, drops_space: bool, end: int, size: int = SLICE_BYTES, most: int | None = None, idle: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches, which have a column text, with the ids of their texts in a row, each with the end id after it, and where each text's ids end.

    size: bytes of a slice. most: pieces that are remembered, CACHE_PIECES if not given. More of both is faster and holds more.
    idle: pieces that are remembered between tasks, IDLE_PIECES if not given.
    """
    enc = encoder(vocabulary, drops_space)
    enc.most, enc.most_idle = most or CACHE_PIECES, idle or IDLE_PIECES
    for b in batches:
        texts = b.column(b.schema.get_field_index("text"))
        upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, side="right")))
            ids, counts = enc.encode(texts.slice(at, to - at))
            ends = np.cumsum(counts)
            yield b.slice(at, to - at), np.insert(ids, ends, np.uint32(end)), ends + np.arange(1, len(ends) + 1)
            at = to
    enc.idle()


def resolve(name: str) -> str:
    """The place of a public vocabulary file; a path is itself."""
    return name if "/" in name else public_tokenizers.path(name)
