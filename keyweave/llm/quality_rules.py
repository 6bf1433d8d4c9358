"""Quality rules: counts over whole texts, and a calibrated hashed n-gram logistic regression with a fixed threshold."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from keyweave.llm.common import fresh, without
from keyweave.llm.training import labelled

#: Buckets of word and of character n-grams.
WORD_BITS, CHAR_BITS = 17, 15
#: Labelled rows that teach at most (a documented bound; everything is scored).
TRAINING_ROWS = 3000
#: Buckets of training rows that fit() takes at once; only bounds memory.
PART = 1 << 17
#: A document that passes the counts is kept if its calibrated probability of quality 1 reaches this.
THRESHOLD = 0.5
BLANKS, SYMBOLS = b" \t\n\r\x0b\f", b"#*$%&|<>"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def counts(raw: bytes, n_chars: int, words: list[bytes], hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if n >= 4:
        windows = (hashes[:-2] * _ODD + hashes[1:-1]) * _ODD + hashes[2:]
        order = np.argsort(windows, kind="stable")
        same = windows[order][1:] == windows[order][:-1]
        again = np.zeros(n - 2, bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        cover = np.zeros(n, bool)
        for k in range(3):
            cover[k : n - 2 + k] |= again
        repeated = int(cover.sum())
    return n, n_chars - sum(raw.count(b) for b in BLANKS), sum(raw.count(b) for b in SYMBOLS), len(lines) - len(set(lines)), repeated


def grams(text: str, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of word 1- and 2-grams and of character 3-grams of a text.

    A 2-gram of one word twice is one gram whatever the word, so a repeated new word is seen as a repetition.
    """
    first, second = hashes[:-1], hashes[1:]
    pairs = np.where(first == second, np.uint64(1), first * _ODD + second)
    top = lambda x, bits: ((x * _ODD) >> np.uint64(64 - bits)).astype(np.int32)
    word = np.concatenate([top(hashes, WORD_BITS), top(pairs ^ (pairs >> np.uint64(29)), WORD_BITS)])
    b = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    # A character's place in the mixture is its own, so those beyond the first 256 don't fall together.
    tri = (b[:-2] * np.uint32(0x10000) + b[1:-1] * np.uint32(0x101) + b[2:]) if len(b) > 2 else np.empty(0, np.uint32)
    char = ((tri * np.uint32(0x9E3779B1)) >> np.uint32(32 - CHAR_BITS)).astype(np.int32)
    return word, char


def profile(text: str) -> tuple[np.ndarray, np.ndarray, bool]:
    """(buckets of both kinds, shares of the text's grams of a kind in them, whether the text is held back for calibration).

    As long as there are buckets at most, however long the text.
    """
    raw = text.encode()
    word, char = grams(text, word_hashes(raw.split()))
    at, share = [], []
    for x, base in ((word, 0), (char, 1 << WORD_BITS)):
        u, k = np.unique(x, return_counts=True)
        at.append(u + base)
        share.append(k / max(len(x), 1))
    return np.concatenate(at).astype(np.int32), np.concatenate(share).astype(np.float32), xxhash.xxh3_64_intdigest(raw) % 5 == 0


@dataclass
class Model:
    word: np.ndarray
    char: np.ndarray
    bias: float
    slope: float  # Platt's calibration: probability = sigmoid(slope * score + shift)
    shift: float

    def score(self, text: str, hashes: np.ndarray) -> float:
        word, char = grams(text, hashes)
        return self.bias + (float(self.word[word].mean()) if len(word) else 0.0) + (float(self.char[char].mean()) if len(char) else 0.0)

    def probability(self, score: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -50, 50))))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def fit(rows: list[tuple[int, tuple[np.ndarray, np.ndarray, bool]]], rounds: int = 120, rate: float = 1.0, decay: float = 1e-5) -> Model:
    """Full-batch Adam on the mean n-gram weights of (label, profile), then Platt scaling on a fifth of the rows held back;
    rows are used up.

    Without rows, or with one label only, the model is that label's rate (one half without rows) for any text.
    """
    sizes = 1 << WORD_BITS, 1 << CHAR_BITS
    labels = np.array([q for q, _ in rows], np.float64)
    if len(set(labels.tolist())) < 2:
        rate1 = (labels.sum() + 1) / (len(labels) + 2) if len(labels) else 0.5
        return Model(np.zeros(sizes[0], np.float32), np.zeros(sizes[1], np.float32), 0.0, 0.0, float(np.log(rate1 / (1 - rate1))))
    col = np.concatenate([at for _, (at, _, _) in rows])
    val = np.concatenate([share for _, (_, share, _) in rows])
    size = np.array([len(at) for _, (at, _, _) in rows])
    back = np.array([held for _, (_, _, held) in rows])
    rows.clear()
    ends = np.cumsum(size)
    cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(PART, len(col), PART)), len(size)]).tolist()
    parts = [(a, b, slice(int(ends[a] - size[a]), int(ends[b - 1]))) for a, b in zip(cuts, cuts[1:])]

    def scores() -> np.ndarray:
        each = [np.bincount(np.repeat(np.arange(b - a), size[a:b]), val[at] * w[col[at]], b - a) for a, b, at in parts]
        return np.concatenate(each) + bias

    if len(set(labels[back].tolist())) < 2 or len(set(labels[~back].tolist())) < 2:
        back[:] = False
    teach = ~back
    weight = np.where(labels == 1, 0.5 / max(labels[teach].sum(), 1), 0.5 / max((1 - labels)[teach].sum(), 1)) * teach
    w, bias = np.zeros(sum(sizes)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        err = (_logistic(scores()) - labels) * weight
        g, gb = np.zeros(len(w)), err.sum()
        for a, b, at in parts:
            np.add.at(g, col[at], val[at] * np.repeat(err[a:b], size[a:b]))
        g += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, b = 1 - 0.9**t, 1 - 0.99**t
        w -= rate * (m / a) / (np.sqrt(v / b) + 1e-6)
        bias -= 0.05 * (mb / a) / (np.sqrt(vb / b) + 1e-6)
    score = scores()
    use = back if back.any() else teach
    slope, shift = 1.0, 0.0
    pos, neg = labels[use].sum(), (1 - labels[use]).sum()
    target = np.where(labels[use] == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))  # Platt's smoothed targets
    x = score[use]
    for _ in range(50):
        p = _logistic(slope * x + shift)
        d, h = p - target, np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(d * x).sum(), d.sum()])
        hess = np.array([[(h * x * x).sum() + 1e-6, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 1.0 / max(abs(step).max(), 1e-9))
        slope, shift = slope - step[0], shift - step[1]
    return Model(w[: sizes[0]].astype(np.float32), w[sizes[0] :].astype(np.float32), float(bias), float(slope), float(shift))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> Model:
    """Fit on a bounded sample of labelled, not held-out rows of docs (doc_id, text).

    Profiles are made where the rows are, so what reaches the driver is bounded in rows and in bytes of each.
    """
    rows = labelled(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), labels, most).select("doc_id", "quality", "text")
    found = rows.mapInArrow(_profiles, "doc_id long, quality int, at binary, share binary, held boolean").toArrow()
    order = np.lexsort((found["quality"].to_numpy(), found["doc_id"].to_numpy())).tolist()
    label, held = found["quality"].to_pylist(), found["held"].to_pylist()
    # Views of the Arrow buffers that Spark streamed, without a row object or a copy on the way.
    at, share = ([np.frombuffer(x.as_buffer(), kind) for x in found[c]] for c, kind in (("at", np.int32), ("share", np.float32)))
    teach = [(label[i], (at[i], share[i], held[i])) for i in order]
    del found, at, share
    return fit(teach)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            made = [profile(t.as_py() or "") for t in part.column(2)]
            cols = [pa.array([at.tobytes() for at, _, _ in made], pa.binary()), pa.array([s.tobytes() for _, s, _ in made], pa.binary()), pa.array([bool(h) for _, _, h in made])]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], *cols], names=["doc_id", "quality", "at", "share", "held"])


_OUT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judged(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept.

    Words lie between ASCII white space, case as it is. base_failed: under 50 words, or over half of the words in
    3-word windows that the text has twice. kept: not base_failed, and the calibrated probability reaches the
    threshold. Null and empty texts have no words and fail. All rows and columns stay, in Arrow batches where they
    are; columns named like the results are replaced. No shuffle.
    """
    new = [*_OUT, "base_failed", "probability", "kept"]
    keep = without(docs, new)
    rows = docs.select(*[docs[c] for c in keep], docs[text_col].cast("string").alias(fresh(docs, "_text")))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed 2**17 + 2**15 weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                found, failed, prob = [], [], []
                for t in batch.column(len(keep)):
                    text = t.as_py() or ""
                    raw = text.encode()
                    words = raw.split()
                    hashes = word_hashes(words)
                    c = counts(raw, len(text), words, hashes)
                    found.append(c)
                    failed.append(c[0] < 50 or 100 * c[4] > 50 * c[0])
                    prob.append(m.probability(m.score(text, hashes)))
                kept = [not f and p >= threshold for f, p in zip(failed, prob, strict=True)]
                cols = [pa.array([c[k] for c in found], pa.int64()) for k in range(5)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols, pa.array(failed), pa.array(prob, pa.float64()), pa.array(kept)], names=[*keep, *new])

    from pyspark.sql import types as T

    extra = T.StructType.fromDDL(", ".join(f"{c} long" for c in _OUT) + ", base_failed boolean, probability double, kept boolean")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *extra.fields]))
