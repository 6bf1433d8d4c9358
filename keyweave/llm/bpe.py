"""BPE encoding by prefix-sharing trie traversal, and decoding."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from keyweave.llm.common import fresh
from keyweave.llm.tokens import _ENCODERS, Encoder, byte_chars

#: Rows taken through Python at once; only bounds memory.
SLICE = 256
_PAIRS_KEPT = 1 << 19


class Trie:
    """Encodes distinct words together, each shared prefix once.

    The state of a prefix is the last token of its encoding. A token t that ends the prefix is that last token just
    if the encoding of what precedes it ends in a token u such that u, t stay two tokens when merged alone; every
    vocabulary token encodes as itself. Words in sorted order are a depth-first walk of their trie: the states of
    the prefix shared with the word before stay on the stack, only those below it are worked out.
    """

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        alphabet = byte_chars()
        model = spec["model"]
        raw = lambda token: bytes(alphabet[c] for c in token)
        self.vocab = {raw(t): i for t, i in model["vocab"].items()}
        pieces = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pieces)}
        added = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.bytes_of = {i: t for t, i in self.vocab.items()} | added
        self.chain, self.step = self._automaton()
        # How each token came to be: the rank of the merge that makes it (-1 for a byte) and its two parts.
        self.made = dict.fromkeys(self.vocab.values(), (-1, -1, -1))
        for (a, b), k in reversed(self.rank.items()):
            self.made[self.vocab[a + b]] = k, self.vocab[a], self.vocab[b]
        self.pair_rank = {(self.vocab[a], self.vocab[b]): k for (a, b), k in self.rank.items()}
        self._stay: dict[tuple[int, int], bool] = {}

    def _automaton(self) -> tuple[list[tuple[tuple[int, int], ...]], list[dict[int, int]]]:
        """Of the trie of all tokens, per node: (token, length) of the tokens that end a text which led there, longest
        first, and its children; `back` holds the node of the longest proper ending that is in the trie."""
        step: list[dict[int, int]] = [{}]
        ends = [-1]
        for text, token in self.vocab.items():
            at = 0
            for byte in text:
                if byte not in step[at]:
                    step[at][byte] = len(step)
                    step.append({})
                    ends.append(-1)
                at = step[at][byte]
            ends[at] = token
        self.back = back = [0] * len(step)
        chain: list[tuple[tuple[int, int], ...]] = [()] * len(step)
        queue = [(child, 1) for child in step[0].values()]
        for state, depth in queue:
            chain[state] = ((ends[state], depth), *chain[back[state]]) if ends[state] >= 0 else chain[back[state]]
            for byte, child in step[state].items():
                at = back[state]
                while at and byte not in step[at]:
                    at = back[at]
                back[child] = step[at].get(byte, 0)
                queue.append((child, depth + 1))
        return chain, step

    def stay(self, left: int, right: int) -> bool:
        """Whether left, right stay two tokens when merged alone.

        Merges are undone from the latest on. At each step two tokens touch at the border; if they merge by a rank
        below that of the merge just undone, they would have merged before it.
        """
        key = left, right
        pair_rank, made = self.pair_rank, self.made
        due = len(self.rank)
        while True:
            if pair_rank.get((left, right), due) < due:
                got = False
                break
            (a, _, tail), (b, head, _) = made[left], made[right]
            if a < 0 and b < 0:
                got = True
                break
            # On equal ranks the left token's merge, which stands further left, came first.
            if a > b:
                due, left = a, tail
            else:
                due, right = b + 1, head
        if len(self._stay) >= _PAIRS_KEPT:
            self._stay.clear()
        self._stay[key] = got
        return got

    def encode(self, words: list[str]) -> list[bytes]:
        chain, step, back, pairs, stay = self.chain, self.step, self.back, self._stay, self.stay
        raws = [w.encode() for w in words]
        order = sorted(range(len(raws)), key=raws.__getitem__)
        out: list[bytes] = [b""] * len(words)
        last: list[int] = [-1]  # last[d]: last token of the current word's prefix of d bytes
        size: list[int] = [0]  # its length in bytes
        states: list[int] = [0]
        for at, shared in zip(order, common_prefixes([raws[i] for i in order]), strict=True):
            word = raws[at]
            del last[shared + 1 :], size[shared + 1 :], states[shared + 1 :]
            state, end = states[shared], shared
            for byte in word[shared:] if shared else word:
                end += 1
                while state and byte not in step[state]:
                    state = back[state]
                state = step[state][byte]
                for token, n in chain[state]:
                    if n == end:
                        break
                    before = last[end - n]
                    ok = pairs.get((before, token))
                    if ok or ok is None and stay(before, token):
                        break
                last.append(token)
                size.append(n)
                states.append(state)
            ids = []
            while end:
                ids.append(last[end])
                end -= size[end]
            ids.reverse()
            out[at] = struct.pack(f"<{len(ids)}I", *ids)
        return out


def common_prefixes(raws: list[bytes]) -> list[int]:
    """For each string the bytes that it shares with the one before; 0 for the first."""
    if not raws:
        return []
    flat = np.frombuffer(b"".join(raws), np.uint8)
    size = np.fromiter(map(len, raws), np.int64, len(raws))
    start = np.cumsum(size) - size
    least = np.minimum(size[1:], size[:-1])
    shared = np.zeros(len(raws), np.int64)
    live, d = np.flatnonzero(least > 0), 0
    while len(live):
        live = live[flat[start[live] + d] == flat[start[live + 1] + d]]
        d += 1
        shared[live + 1] = d
        live = live[least[live] > d]
    return shared.tolist()


class Decoder:
    """ids -> text: token bytes in a row, read as UTF-8 with U+FFFD for what is not."""

    def __init__(self, trie: Trie):
        top = max(trie.bytes_of) + 1
        pieces = [trie.bytes_of.get(i, b"") for i in range(top)]
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.at = np.r_[0, np.cumsum(self.size)[:-1]]
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_all(ids, [0, len(ids)])[0]

    def decode_all(self, ids: np.ndarray, edges: list[int]) -> list[str]:
        """The texts of ids[edges[0]:edges[1]], ids[edges[1]:edges[2]], ..."""
        size = self.size[ids]
        ends = np.cumsum(size)
        index = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.at[ids] - (ends - size), size)
        raw = self.flat[index].tobytes()
        cuts = np.append(0, ends)[edges].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]


_TRIES: dict[str, tuple[Trie, Decoder]] = {}


def _tools(path: str) -> tuple[Trie, Decoder, Encoder]:
    if path not in _TRIES:
        trie = Trie(path)
        _TRIES[path] = trie, Decoder(trie)
        _ENCODERS["trie", path] = Encoder(path, trie.encode)
    return *_TRIES[path], _ENCODERS["trie", path]


def with_ids(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df plus ids_col (array<int>): its texts as the tokenizer file encodes them, without special tokens added.

    Null and empty texts give an empty array. All columns pass through; where another column has the name ids_col, the
    new one, which is the last, gets a longer name (common.fresh). No shuffle:
    words are encoded where their rows are, distinct words of a chunk together, known ones from a bounded cache.
    """
    if ids_col.lower() == text_col.lower():
        raise ValueError(f"column {ids_col} holds the texts")
    return _mapped(df, text_col, fresh(df, ids_col), "array<int>", pa.list_(pa.int32()), lambda col: _encoded(path, col))


def with_text(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df plus text_col: the text its ids decode to, special tokens included. Null arrays give null.

    Where another column has the name text_col, the new one, which is the last, gets a longer name (common.fresh).
    """
    if text_col.lower() == ids_col.lower():
        raise ValueError(f"column {text_col} holds the ids")
    return _mapped(df, ids_col, fresh(df, text_col), "string", pa.string(), lambda col: _decoded(path, col))


def _mapped(df: DataFrame, source: str, target: str, kind: str, arrow: pa.DataType, work) -> DataFrame:
    place = df.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                batch = whole.slice(i, SLICE)
                made = work(batch.column(place))
                yield pa.RecordBatch.from_arrays([*batch.columns, made.cast(arrow)], names=[*batch.schema.names, target])

    from pyspark.sql import types as T

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *T.StructType.fromDDL(f"`{target}` {kind}").fields]))


def _encoded(path: str, col: pa.Array) -> pa.Array:
    ids, sizes = [], [np.zeros(1, np.int64)]
    for got, ends in _tools(path)[2].batches(t.as_py() for t in col):
        ids.append(got)
        sizes.append(np.diff(ends, prepend=0))
    offsets = np.cumsum(np.concatenate(sizes)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, "<u4"), *ids]).view("<i4")))


def _decoded(path: str, col: pa.Array) -> pa.Array:
    edges = np.asarray(col.offsets)
    texts = _tools(path)[1].decode_all(np.asarray(col.values)[edges[0] : edges[-1]], edges - edges[0])
    return pa.array([t if ok else None for t, ok in zip(texts, col.is_valid().to_pylist(), strict=True)], pa.string())
