"""URL filters: rules by host and path, then word segmentation of hosts and naive Bayes over the words."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from keyweave.llm.common import remove, shared_dir, stored, without

# Example names of sites of either class. Urls with a word that only the first list has teach what else
# comes with such words; the others teach what is ordinary.
BLOCK_SITES = """
casino win, online casino bonus, free bets, best bets, sports betting tips, poker bonus, slot jackpot, lucky slots,
cheap pills, buy viagra cheap, diet pills shop, online pharmacy deals, ads track, ad tracker click, click ads banner,
adult cams, free porn videos, xxx movies, sexy girls chat, hot dating singles, payday loan fast, easy money cash,
crypto profit bonus, replica watches cheap, win prize lottery, cash prize winner, download crack keygen, free warez torrent
"""
ALLOW_SITES = """
daily news, city library, open science journal, cooking recipes blog, travel guide, history museum, weather report,
local school, university press, music review, garden club, family health, book store, photo gallery, research data,
computer manual, language course, football club, art school, public radio, economic times, sailing diary, travel blog,
free encyclopedia, home and garden, world map, medical journal, space agency, free software foundation, video lectures
"""
#: Words of the unigram model and of the Bayes model at most, letters of a word at most, and names remembered at most (a
#: longer name is split again each time): all bound what the driver and the workers hold.
VOCABULARY, LETTERS, REMEMBERED, LONGEST = 1 << 15, 24, 1 << 15, 64
#: A name of n unknown letters has a probability of UNKNOWN / 26**n, so known words win where they fit.
UNKNOWN = 1e-3
#: A class's share of a word is mixed with the word's share of all urls, which counts as so many words of the class.
#: The prior of block is the share of urls that teach it, mixed with PRIOR in the same way.
MIXED, PRIOR = 50.0, 0.25


def examples(listing: str) -> list[list[str]]:
    return [site.split() for site in re.split(r"[,\n]", listing) if site.strip()]


BLOCKED, ALLOWED = (Counter(w for site in examples(x) for w in site) for x in (BLOCK_SITES, ALLOW_SITES))
TELLING = frozenset(BLOCKED) - frozenset(ALLOWED)


@dataclass
class Model:
    """unigram: log probability by word. odds: log P(word | block) - log P(word | allow). start: log odds of the prior."""

    unigram: dict[str, float]
    odds: dict[str, float] = field(default_factory=dict)
    start: float = 0.0
    _known: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    def segment(self, name: str) -> list[str]:
        """Most probable split of a concatenated name (Viterbi over unigram probabilities)."""
        unigram, longest = self.unigram, max(map(len, self.unigram), default=0)
        begin, letter = math.log(UNKNOWN), -math.log(26)
        # Of each prefix that ends in a known word, and that ends in a run of unknown letters: score, start of that word.
        known: list[tuple[float, int]] = [(0.0, 0)]
        loose: list[tuple[float, int]] = [(-math.inf, 0)]
        for end in range(1, len(name) + 1):
            best, at = -math.inf, 0
            for start in range(max(0, end - longest), end):
                if (p := unigram.get(name[start:end])) is not None and (p := p + max(known[start][0], loose[start][0])) > best:
                    best, at = p, start
            known.append((best, at))
            # A run goes on at the price of a letter, and starts at that of a word besides.
            loose.append(max((known[end - 1][0] + begin + letter, end - 1), (loose[end - 1][0] + letter, loose[end - 1][1])))
        out, end = [], len(name)
        while end:
            start = max(known[end], loose[end])[1]
            out.append(name[start:end])
            end = start
        return out[::-1]

    def tokens(self, part: str) -> list[str]:
        """Words of a host or path: letters between other characters, split where they are concatenated."""
        out: list[str] = []
        for name in re.findall(r"[a-z]+", part.lower()):
            got = self._known.get(name)
            if got is None:
                got = tuple(self.segment(name))
                if len(name) <= LONGEST:
                    if len(self._known) >= REMEMBERED:
                        self._known.clear()
                    self._known[name] = got
            out += got
        return out

    def score(self, host: str, path: str) -> float:
        """Probability of block by multinomial naive Bayes over host and path words; words never met tell nothing."""
        odds = self.start + sum(self.odds.get(w, 0.0) for w in (*self.tokens(host), *self.tokens(path)))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def unigrams(words: dict[str, int]) -> dict[str, float]:
    """Log probabilities: the listed names' words and the given counts, each half where there are both."""
    listed = BLOCKED + ALLOWED
    total, of = sum(listed.values()), sum(words.values())
    half = 0.5 if of else 1.0
    return {w: math.log(half * listed[w] / total + (half * words.get(w, 0) / of if of else 0.0)) for w in listed.keys() | words.keys()}


def bayes(unigram: dict[str, float], block: dict[str, int], allow: dict[str, int], sizes: tuple[int, int] = (0, 0), urls: tuple[int, int] = (0, 0)) -> Model:
    """The model of word counts of urls that teach block and allow, beside those of the lists.

    sizes: words of either kind, counted ones and others. urls: how many urls taught either class.
    """
    counts = [BLOCKED + Counter(block), ALLOWED + Counter(allow)]
    total = [max(sum(c.values()), sum(x.values()) + n) for c, x, n in zip(counts, (BLOCKED, ALLOWED), sizes, strict=True)]
    vocabulary = counts[0].keys() | counts[1].keys()
    share = lambda w: (counts[0][w] + counts[1][w]) / sum(total)
    like = lambda k, w: math.log((counts[k][w] + MIXED * share(w)) / (total[k] + MIXED))
    prior = (urls[0] + MIXED * PRIOR) / (sum(urls) + MIXED)
    return Model(unigram, {w: like(0, w) - like(1, w) for w in vocabulary}, math.log(prior / (1 - prior)))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """Rows of (w, n) with the largest n, in whole classes of about equal n (eighths of an octave): `most` rows at most.

    Only the sizes of the classes reach the driver, some hundred numbers, however many tasks there are.
    """
    level = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True)
    bar, rows = 0, 0
    for at, n in sizes:
        rows += n
        if rows > most:
            bar = at + 1
            break
    return counts.where(level >= bar)


def train(pages: DataFrame, docs: DataFrame, url_col: str = "url", text_col: str = "text") -> Model:
    """Unigrams from the words of all texts, and word likelihoods from all urls; null urls and texts have no words.

    Urls with a word that only the block list has teach block, all others allow. Counts are folded in each task and
    written to the shared folder; VOCABULARY of the most frequent words at most reach the driver, of urls so many of
    either class. Empty tables leave the lists alone.
    """
    base = shared_dir(pages.sparkSession)
    word = F.explode(F.split(F.lower(F.coalesce(docs[text_col].cast("string"), F.lit(""))), "[^a-z]+")).alias("w")
    words = docs.select(word).where(F.length("w").between(1, LETTERS)).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    unigram = unigrams({r["w"]: r["n"] for r in frequent(stored(words, f"{base}/words"), VOCABULARY).collect()})
    shared = pages.sparkSession.sparkContext.broadcast(Model(unigram))
    host, path = url_parts(pages[url_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[tuple[bool, str]] = Counter()
        for batch in batches:
            for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = [*shared.value.tokens(h), *shared.value.tokens(p)]
                telling = not TELLING.isdisjoint(tokens)
                found.update((telling, w) for w in tokens)
                found[telling, ""] += 1  # the urls themselves
            if len(found) > VOCABULARY:
                yield _counted(found)
                found = Counter()
        yield _counted(found)

    counted = pages.select(host.alias("h"), path.alias("p")).mapInArrow(run, "block boolean, w string, n long")
    counted = stored(counted.groupBy("block", "w").agg(F.sum("n").alias("n")), f"{base}/tokens")
    of = {k: {r["w"]: r["n"] for r in frequent(counted.where((F.col("block") == k) & (F.col("w") != "")), VOCABULARY).collect()} for k in (True, False)}
    whole = {(r["block"], r["url"]): r["n"] for r in counted.groupBy("block", (F.col("w") == "").alias("url")).agg(F.sum("n").alias("n")).collect()}
    remove(pages.sparkSession, base)
    number = lambda url: (whole.get((True, url), 0), whole.get((False, url), 0))
    return bayes(unigram, of[True], of[False], number(False), number(True))


def _counted(found: Counter) -> pa.RecordBatch:
    keys = list(found)
    return pa.RecordBatch.from_pydict({"block": pa.array([k for k, _ in keys], pa.bool_()), "w": pa.array([w for _, w in keys], pa.string()), "n": pa.array([found[k] for k in keys], pa.int64())})


#: What the two lists alone teach.
LISTED = bayes(unigrams({}), {}, {})


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path); both empty for null or without "://"."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url.cast("string"), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(text, pattern, 1), upper, upper.lower()), F.regexp_extract(text, pattern, 2)


def scorer(spark, model: Model) -> Callable[[Column, Column], Column]:
    shared = spark.sparkContext.broadcast(model)  # bounded by VOCABULARY

    @F.pandas_udf(T.DoubleType())
    def scores(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(h, p) for h, p in zip(host, path, strict=True)], dtype="float64")

    return scores


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], model: Model = LISTED, url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """pages plus host, path, rule, block_score, verdict. rules: (allow or block, host, path).

    A rule fits its host and all subdomains if the path starts with the rule's; the longest host + path wins (the
    first listed among equals). Without a rule, block_score >= threshold blocks. Rules are column expressions, only
    hosts and paths reach Python, and nothing shuffles, so a host with a third of all pages does no harm. Columns
    named like the results are replaced; null urls have empty parts and are allowed by the model; repeated rows stay.
    """
    host, path = url_parts(pages[url_col])
    keep = without(pages, ["host", "path", "rule", "block_score", "verdict"])
    out = pages.select(*keep, host.alias("host"), path.alias("path"))
    rule, by_rule = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, by_rule = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(by_rule)
    out = out.select(*keep, "host", "path", rule.alias("rule"), by_rule.alias("verdict"), scorer(pages.sparkSession, model)("host", "path").alias("block_score"))
    by_model = F.when(F.col("block_score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumn("verdict", F.coalesce("verdict", by_model))
