"""Quality classifier: tree paths as rules over text statistics, lasso logistic weights, Spark column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from keyweave.llm.common import without
from keyweave.llm.training import labelled

#: Labelled rows that teach at most (a documented bound; everything is scored).
TRAINING_ROWS = 10_000
TREES, DEPTH, LEAST = 40, 3, 8
LASSO = 0.002
#: Rules of an ensemble that are added up in compiled code.
COMPILED = 128
#: White space of the patterns, and characters of a text whose words or lines are listed at once.
SPACES, PART = " \t\n\x0b\f\r", 1 << 21


def distinct_pieces(t: Column, between: str, other: str) -> Column:
    """64-bit hashes of the distinct pieces of a long text, which `between` (a regex) splits; `other` is a character of no separator.

    Only the pieces of one part exist at a time. A part reaches on to the next separator, which the next part loses.
    One that ends within a run of white space has an empty piece there, which is none of the text's.
    """
    parts = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{PART}}}+{other}*+"), F.lit(0))
    whole = lambda part, i: F.when(i == 0, part).otherwise(F.regexp_replace(part, f"^{between}", ""))
    pieces = lambda part, i: F.array_distinct(F.transform(F.split(whole(part, i), between), lambda x: F.xxhash64(x)))
    return F.array_distinct(F.flatten(F.transform(parts, pieces)))


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text, each a JVM expression over the whole of it. Null counts as empty.

    What is counted is the length of a text from which all else is cut, so that a long text makes no object for each
    match. Pieces are listed only of texts of at most PART characters; longer ones have theirs part by part.
    """
    t = F.coalesce(text.cast("string"), F.lit(""))
    chars = F.length(t)
    n = F.greatest(chars, F.lit(1)).cast("double")
    count = lambda other: F.length(F.regexp_replace(t, F.lit(other), F.lit(""))).cast("double")
    start = F.ltrim(t, F.lit(SPACES))  # each word and the white space after it become a mark
    n_words = F.length(F.regexp_replace(start, F.lit(r"\S+\s*"), F.lit("x")))
    again = F.length(F.regexp_replace(start, F.lit(r"(?=(\S++)\s++\1(?!\S))(\S)\S*\s*|\S+\s*"), F.lit("$2")))
    words = F.greatest(n_words.cast("double"), F.lit(1.0))
    n_lines = F.length(F.regexp_replace(t, F.lit("[^\n]+"), F.lit(""))) + 1
    ends = (F.length(start) < chars).cast("int") + (F.length(F.rtrim(t, F.lit(SPACES))) < chars).cast("int")
    short = F.when(chars <= PART, t)
    lines = F.split(short, "\n")
    tokens = F.split(F.lower(short), r"\s+")  # with an empty one before white space that starts a text, or after one that ends it
    n_distinct = F.size(F.array_remove(distinct_pieces(F.lower(t), r"\s+", r"\S"), F.xxhash64(F.lit("")))) + (ends > 0).cast("int")
    return {
        "log_chars": F.log1p(chars.cast("double")),
        "word_length": n / words,
        "upper": count(r"\P{Lu}+") / n,
        "symbol": count(r"[^#*$%&|<>@^~{}_=+\\/\[\]]+") / n,
        "pipe": count(r"[^|]+") / words,
        "bang": count(r"[^!?]+") / words,
        "digit": count(r"[^0-9]+") / n,
        "stops": count(r"[^.,;:]+") / words,
        "same_word": again.cast("double") / words,
        "distinct": F.coalesce(F.array_size(F.array_distinct(tokens)) / F.array_size(tokens), n_distinct / (n_words + ends)),
        "distinct_lines": F.coalesce(F.array_size(F.array_distinct(lines)) / F.array_size(lines), F.size(distinct_pieces(t, "\n", "[^\n]")) / n_lines),
        "line_chars": F.log1p(n / n_lines),
    }


NAMES = ("log_chars", "word_length", "upper", "symbol", "pipe", "bang", "digit", "stops", "same_word", "distinct", "distinct_lines", "line_chars")
Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, bound): value > bound if above, else value <= bound


def tree_paths(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, path: Rule = ()) -> list[tuple[Rule, float]]:
    """All paths of one greedy tree on second-order gains (inner nodes too), each with its Newton step."""
    value = -grad.sum() / (hess.sum() + 1.0)
    out = [(path, float(value))] if path else []
    if depth == 0 or len(x) < 2 * LEAST:
        return out
    best = (1e-6, -1, 0.0)
    base = grad.sum() ** 2 / (hess.sum() + 1.0)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v = x[order, j]
        g, h = np.cumsum(grad[order]), np.cumsum(hess[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        cut = cut[(cut >= LEAST - 1) & (cut < len(v) - LEAST)]
        if len(cut):
            gain = g[cut] ** 2 / (h[cut] + 1) + (g[-1] - g[cut]) ** 2 / (h[-1] - h[cut] + 1) - base
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, float((v[cut[k]] + v[cut[k] + 1]) / 2))
    _, j, bound = best
    if j < 0:
        return out
    above = x[:, j] > bound
    for side in (False, True):
        m = above == side
        out += tree_paths(x[m], grad[m], hess[m], depth - 1, (*path, (j, side, bound)))
    return out


def fires(rule: Rule, x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for j, above, bound in rule:
        hit &= (x[:, j] > bound) == above
    return hit


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


@dataclass
class Ensemble:
    bias: float
    rules: list[tuple[Rule, float]]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, w in self.rules:
            z += w * fires(rule, x)
        return _logistic(z)

    def column(self, prefix: str = "") -> Column:
        """The score as one Spark expression over the statistics' columns.

        Beyond COMPILED rules their weights are added up as items of an array, in the same order: a sum of sums would be as
        deep as there are rules, and some hundreds of them overflow the planner's stack.
        """
        fired = []
        for rule, w in self.rules:
            hit = F.lit(True)
            for j, above, bound in rule:
                c = F.col(prefix + NAMES[j])
                hit = hit & ((c > bound) if above else (c <= bound))
            fired.append(F.when(hit, F.lit(w)).otherwise(F.lit(0.0)))
        bias = F.lit(self.bias)
        if len(fired) > COMPILED:
            z = F.aggregate(F.array(*fired), bias, lambda total, w: total + w)
        else:
            z = reduce(lambda total, w: total + w, fired, bias)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Ensemble:
    """Boost short trees on halves of the rows, take all their paths as rules, keep those the lasso keeps.

    With one class, or none, or rows too few or too alike for any rule, the ensemble is the rate of quality 1 (one half
    without rows) for any text.
    """
    rate = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    constant = Ensemble(float(np.log(rate / (1 - rate))), [])
    if len(set(y.tolist())) < 2:
        return constant
    rng = np.random.default_rng(seed)
    z = np.zeros(len(y))
    rules: dict[Rule, bytes] = {}
    for _ in range(TREES):
        half = rng.random(len(y)) < 0.5
        p = _logistic(z)
        paths = tree_paths(x[half], (p - y)[half], (p * (1 - p))[half], DEPTH)
        ends = {r for r, _ in paths} - {r[:k] for r, _ in paths for k in range(1, len(r))}
        for rule, value in paths:
            rules.setdefault(rule, b"")
            if rule in ends:
                z += 0.3 * value * fires(rule, x)
    seen: dict[bytes, Rule] = {}
    for rule in rules:  # rules that fire on the same rows are one; the shortest stands for them
        key = np.packbits(fires(rule, x)).tobytes()
        if key not in seen or len(rule) < len(seen[key]):
            seen[key] = rule
    listed = list(seen.values())
    if not listed:
        return constant
    r = np.stack([fires(rule, x) for rule in listed], 1).astype(np.float64)
    w, bias = _lasso(r, y)
    return Ensemble(bias, [(rule, float(c)) for rule, c in zip(listed, w, strict=True) if c != 0.0])


def _lasso(r: np.ndarray, y: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic loss plus LASSO times the sum of absolute weights, by accelerated proximal gradient; bias is free."""
    n, k = r.shape
    a = np.c_[r, np.ones(n)]
    step = 4 * n / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    w = v = np.zeros(k + 1)
    t = 1.0
    for _ in range(rounds):
        g = a.T @ (_logistic(a @ v) - y) / n
        new = v - step * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * LASSO, 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> Ensemble:
    """Fit on the statistics of a bounded sample of labelled, not held-out rows of docs (doc_id, text)."""
    rows = labelled(docs.select("doc_id", "text"), labels, most).select("doc_id", "quality", *[c.alias(k) for k, c in statistics(F.col("text")).items()])
    got = np.array(sorted(tuple(map(float, r)) for r in rows.collect())).reshape(-1, 2 + len(NAMES))
    return fit(got[:, 2:], got[:, 1])


def scored(docs: DataFrame, model: Ensemble, text_col: str = "text") -> DataFrame:
    """docs plus score (0 to 1, higher: quality 1 likelier) and predicted (1 from 0.5 on).

    Only the text counts; null and empty texts are scored by the statistics of an empty text. All rows and columns
    stay; columns named score or predicted are replaced. JVM expressions in one scan, no shuffle.
    """
    text = docs[text_col]
    prefix = "_s_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    stats = {f"{prefix}{k}": c for k, c in statistics(text).items()}
    # Projected first, where the counts that several statistics share are worked out once. A generator of one row then
    # keeps a filter on the score above them: pushed below, it would repeat them for every condition of every rule.
    keep = without(docs, ["score", "predicted"])
    out = docs.select(*keep, *[c.alias(f"{k}_") for k, c in stats.items()])
    out = out.select(*keep, F.inline(F.array(F.struct(*[F.col(f"{k}_").alias(k) for k in stats])))).withColumn("score", model.column(prefix))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)).drop(*stats)
