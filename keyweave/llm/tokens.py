"""Byte-level pre-tokenization in numpy, and a cache of words in front of whatever encodes them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from operator import attrgetter
from typing import NamedTuple

import numpy as np
from tokenizers import Tokenizer

#: Letters, digits, white space, anything else; NEW: not yet asked for.
LETTER, DIGIT, SPACE, OTHER, NEW = range(5)
#: Contraction tails that end a word of their own behind an apostrophe (fixed by the byte-level format).
TAILS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Characters taken at once, bytes of the cache of words, and the longest word kept there. All only bound memory.
CHUNK_CHARS, CACHE_BYTES, CACHED_CHARS = 1 << 18, 24 << 20, 64
#: Weights of a word's characters in its 64-bit hash, by position; what the hash finds equal is compared.
WEIGHTS = np.random.default_rng(11).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(1)
def byte_chars() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for 256, 257, ..."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(1)
def library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


class Splitter:
    """Cuts texts into the words that the tokenizer file's byte-level pre-tokenizer makes.

    The class of each character is asked from the library itself once (its Unicode version is not Python's), so a
    text's cuts equal the library's for any text.
    """

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        pre = spec["pre_tokenizer"] or {}
        added = spec["added_tokens"]
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"] or any(
                t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("only plain byte-level tokenizer files are supported")
        self.added = {t["content"]: t["id"] for t in added}
        self._added = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        self._probe = library(path).pre_tokenizer.pre_tokenize_str
        self._class = np.full(0x110000, NEW, np.uint8)

    def _classes(self, points: np.ndarray) -> np.ndarray:
        out = self._class[points]
        if (out == NEW).any():
            for c in np.unique(points[out == NEW]).tolist():
                kind = next((k for k, lead in ((LETTER, "a"), (DIGIT, "1"), (OTHER, "!")) if len(self._probe(lead + chr(c))) == 1), SPACE)
                self._class[c] = kind
            out = self._class[points]
        return out

    def starts(self, text: str, fences: np.ndarray) -> np.ndarray:
        """Sorted start offsets of words in text; fences: offsets no word may cross (0 included)."""
        n = len(text)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = self._classes(points)
        fence = np.zeros(n + 1, bool)
        fence[fences] = True
        fence[n] = True
        head = np.ones(n, bool)
        head[1:] = (kind[1:] != kind[:-1]) | fence[1:n]
        space = kind == SPACE
        blank_before = np.zeros(n, bool)
        blank_before[1:] = (points[:-1] == 32) & ~fence[1:n]
        start = head & (space | ~blank_before)
        last = np.zeros(n, bool)  # the last white space before a word is a word of its own or opens that word
        last[:-1] = space[:-1] & ~space[1:] & ~fence[1:n]
        start |= last
        mark = np.flatnonzero((points == 39) & start)
        for p in mark.tolist():
            for tail in TAILS:
                if text.startswith(tail, p + 1) and not fence[p + 1 : p + 1 + len(tail)].any():
                    start[p + 1] = False
                    if p + 1 + len(tail) < n:
                        start[p + 1 + len(tail)] = True
                    break
        return np.flatnonzero(start)

    def chunks(self, texts: Iterable[str], tail: int | None = None) -> Iterator[Chunk]:
        """Texts cut into words, about CHUNK_CHARS characters at a time; `tail` is a token that ends each text."""
        segments: list[str] = []
        marks: list[tuple[int, int]] = []  # (segments before it, token)
        ends: list[tuple[int, int]] = []  # per text: segments and marks up to its end
        size = 0
        for text in texts:
            for k, part in enumerate(self._added.split(text) if self._added and any(x in text for x in self.added) else [text]):
                if k % 2:
                    marks.append((len(segments), self.added[part]))
                elif part:
                    segments.append(part)
                    size += len(part)
            if tail is not None:
                marks.append((len(segments), tail))
            ends.append((len(segments), len(marks)))
            if size >= CHUNK_CHARS:
                yield self._cut(segments, marks, ends)
                segments, marks, ends, size = [], [], [], 0
        if ends:
            yield self._cut(segments, marks, ends)

    def _cut(self, segments: list[str], marks: list[tuple[int, int]], ends: list[tuple[int, int]]) -> Chunk:
        text = "".join(segments)
        fences = np.cumsum([0, *map(len, segments)])
        at = self.starts(text, fences[:-1]) if text else np.empty(0, np.int64)
        bounds = np.searchsorted(at, fences)
        words, codes = distinct(text, at)
        tokens = sorted({t for _, t in marks})
        place = {t: len(words.first) + i for i, t in enumerate(tokens)}
        codes = np.insert(codes, bounds[[s for s, _ in marks]], [place[t] for _, t in marks]) if marks else codes
        return Chunk(words, tokens, codes, np.array([bounds[s] + m for s, m in ends], np.int64))


class Words(NamedTuple):
    """Distinct words of a text: where each starts first and its length, its hash (ascending), or no hashes where two clash."""

    text: str
    points: np.ndarray
    first: np.ndarray
    size: np.ndarray
    keys: np.ndarray | None

    def strings(self, which: np.ndarray) -> list[str]:
        return [self.text[a : a + n] for a, n in zip(self.first[which].tolist(), self.size[which].tolist(), strict=True)]


class Chunk(NamedTuple):
    """Distinct words, tokens outside words, indexes into both of what the texts hold in order, where each text ends."""

    words: Words
    tokens: list[int]
    codes: np.ndarray
    ends: np.ndarray


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


def distinct(text: str, at: np.ndarray) -> tuple[Words, np.ndarray]:
    """The distinct words of text, which start at the offsets `at` (0 first), and each word's index in them.

    Words are grouped by hash and then compared with their group's first one, character by character; should two of a
    group differ, strings decide.
    """
    m, n = len(at), len(text)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not m:
        return Words(text, points, at, at, at.astype(np.uint64)), np.empty(0, np.int64)
    size = np.diff(at, append=n)
    inside = np.arange(n, dtype=np.int32) - np.repeat(at.astype(np.int32), size)
    mixed = WEIGHTS[inside & 63]
    mixed *= points + np.uint64(1) + ((inside >> 6).astype(np.uint64) << np.uint64(32)) if size.max() > 64 else points + np.uint64(1)
    key = np.add.reduceat(mixed, at)
    order = np.argsort(key)
    ordered = key[order]
    new = np.ones(m, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    codes = np.empty(m, np.int64)
    codes[order] = np.cumsum(new) - 1
    first = order[new]
    inside += np.repeat(at[first].astype(np.int32)[codes], size)
    if (size == size[first][codes]).all() and (points == points[inside]).all():
        return Words(text, points, at[first], size[first], ordered[new]), codes
    index: dict[str, int] = {}
    edges = np.append(at, n).tolist()
    codes = np.array([index.setdefault(text[a:b], len(index)) for a, b in zip(edges, edges[1:])], np.int64)
    first = np.unique(codes, return_index=True)[1]
    return Words(text, points, at[first], size[first], None), codes


class _Buffer:
    """A growing array."""

    def __init__(self, kind: str):
        self.data, self.used = np.empty(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> int:
        """Where the values begin."""
        at, end = self.used, self.used + len(values)
        if end > len(self.data):
            self.data = np.concatenate([self.data[:at], np.empty(max(end, at + at // 4) - at, self.data.dtype)])
        self.data[at:end] = values
        self.used = end
        return at


class Cache:
    """Ids of words, found by hash and confirmed by their characters.

    When it holds CACHE_BYTES, words that were not asked for since the last time go; if the rest still takes over half,
    all go.
    """

    def __init__(self, encode_words: Callable[[list[str]], list[bytes]]):
        self.encode_words = encode_words
        self.now = 0
        self._clear()

    def _clear(self) -> None:
        self.keys, self.chars, self.ids = np.empty(0, np.uint64), _Buffer("<u4"), _Buffer("<u4")
        # Per key: where its characters and ids begin, how many there are, and the chunk that last asked for it.
        self.table = np.empty((5, 0), np.int32)
        self.swept = self.now

    def _sweep(self) -> None:
        stay = np.flatnonzero(self.table[4] > self.swept)
        keys, (char_at, n_chars, id_at, n_ids, seen) = self.keys[stay], self.table[:, stay]
        chars, ids = self.chars.data[spans(char_at, n_chars)], self.ids.data[spans(id_at, n_ids)]
        self._clear()
        if 4 * (len(chars) + len(ids)) + 28 * len(keys) < CACHE_BYTES // 2:
            self.keys = keys
            self.chars.add(chars)
            self.ids.add(ids)
            self.table = np.stack([np.cumsum(n_chars) - n_chars, n_chars, np.cumsum(n_ids) - n_ids, n_ids, seen]).astype(np.int32)

    def take(self, words: Words, tokens: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each word and then token begin, how many they are); valid until the next call."""
        self.now += 1
        if 4 * (self.chars.used + self.ids.used) + 28 * len(self.keys) > CACHE_BYTES:
            self._sweep()
        n = len(words.first)
        begin, count = np.zeros(n + len(tokens), np.int64), np.ones(n + len(tokens), np.int64)
        known, keep = np.zeros(n, bool), np.zeros(n, bool)
        if words.keys is not None:
            keep = words.size <= CACHED_CHARS
            spot = np.searchsorted(self.keys, words.keys)
            if len(self.keys):
                found = np.minimum(spot, len(self.keys) - 1)
                hit = np.flatnonzero(self.keys[found] == words.keys)
                keep[hit] = False
                hit = hit[self.table[1][found[hit]] == words.size[hit]]
                size = words.size[hit]
                same = self.chars.data[spans(self.table[0][found[hit]], size)] == words.points[spans(words.first[hit], size)]
                if not same.all():
                    hit = hit[np.bitwise_and.reduceat(same, np.cumsum(size) - size)]
                known[hit] = True
                at = found[hit]
                self.table[4][at] = self.now
                begin[hit], count[hit] = self.table[2][at], self.table[3][at]
        new, odd = np.flatnonzero(keep), np.flatnonzero(~known & ~keep)
        if len(new):
            parts = self.encode_words(words.strings(new))
            sizes, chars = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2, words.size[new]
            starts = np.cumsum(sizes) - sizes + self.ids.add(np.frombuffer(b"".join(parts), "<u4"))
            placed = np.cumsum(chars) - chars + self.chars.add(words.points[spans(words.first[new], chars)])
            rows = np.stack([placed, chars, starts, sizes, np.full(len(new), self.now)]).astype(np.int32)
            self.keys, self.table = np.insert(self.keys, spot[new], words.keys[new]), np.insert(self.table, spot[new], rows, 1)
            begin[new], count[new] = starts, sizes
        kept = self.ids.used
        if len(odd):  # overlong words and those whose hash another one has are encoded again each time
            parts = self.encode_words(words.strings(odd))
            count[odd] = sizes = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
            begin[odd] = np.cumsum(sizes) - sizes + self.ids.add(np.frombuffer(b"".join(parts), "<u4"))
        begin[n:] = np.arange(len(tokens)) + self.ids.add(np.array(tokens, "<u4"))
        self.ids.used = kept
        return self.ids.data, begin, count


class Encoder:
    """texts -> unsigned 32-bit ids; encode_words gives the little-endian id bytes of distinct words."""

    def __init__(self, path: str, encode_words: Callable[[list[str]], list[bytes]]):
        self.splitter, self.cache = Splitter(path), Cache(encode_words)

    def batches(self, texts: Iterable[str | None], tail: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of several texts, where each of them ends), over all texts in order; null texts are empty."""
        for chunk in self.splitter.chunks((t or "" for t in texts), tail):
            ids, begin, count = self.cache.take(chunk.words, chunk.tokens)
            each = count[chunk.codes]
            yield ids[spans(begin[chunk.codes], each)], np.append(0, np.cumsum(each))[chunk.ends]

    def encode(self, texts: Iterable[str | None], tail: int | None = None) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for ids, ends in self.batches(texts, tail):
            at = 0
            for end in ends.tolist():
                yield ids[at:end]
                at = end


_ENCODERS: dict[tuple, Encoder] = {}


def library_encoder(path: str) -> Encoder:
    """An Encoder whose words are encoded by the tokenizers library's own model; one for each worker process."""
    if ("library", path) not in _ENCODERS:
        tokenize = library(path).model.tokenize
        shown = np.zeros(256, "<u2")
        for c, b in byte_chars().items():
            shown[b] = ord(c)
        between, number = chr(shown[0xFF]), attrgetter("id")

        def encode_words(words: list[str]) -> list[bytes]:
            # A pre-tokenized word in the byte-level alphabet is what the library hands to its own model. All words are put
            # into that alphabet at once, with a byte between them that no text has in UTF-8.
            raw = np.frombuffer("\udcff".join(words).encode("utf-8", "surrogateescape"), np.uint8)
            ids: list[int] = []
            ends = [0]
            for word in shown[raw].tobytes().decode("utf-16-le").split(between) if words else ():
                ids += map(number, tokenize(word))
                ends.append(4 * len(ids))
            flat = np.array(ids, "<u4").tobytes()
            return [flat[a:b] for a, b in zip(ends, ends[1:])]

        _ENCODERS["library", path] = Encoder(path, encode_words)
    return _ENCODERS["library", path]
