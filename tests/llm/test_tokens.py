import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from keyweave.llm import bpe, packing, queries, simple8b
from keyweave.llm.tokens import library_encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
PARTS = st.sampled_from(["'", "s", "t", "re", "ll", " ", "  ", "\n", "\t", "a", "é", "1", "٣", "!", "…", "　", "\xa0", "😀", "՘", "<|endoftext|>", "<|endof", "漢", "́", "d", "\x1c", "\x85", "Ⅷ", "the", "tion"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(PARTS, st.characters(exclude_categories=["Cs"])), max_size=25).map("".join))
def test_ids_are_the_librarys(text):
    want = LIB.encode(text, add_special_tokens=False).ids
    for encoder in (library_encoder(PATH), bpe._tools(PATH)[2]):
        assert next(encoder.encode([text])).tolist() == want
    assert bpe._tools(PATH)[1].decode(np.array(want, np.int64)) == LIB.decode(want, skip_special_tokens=False) == text


def test_decode_of_broken_utf8():
    ids = [i for i in LIB.encode("é漢", add_special_tokens=False).ids][:1] + [187, 50256]
    assert bpe._tools(PATH)[1].decode(np.array(ids)) == LIB.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("weights", [None, 0])
def test_small_cache_and_clashing_hashes_change_nothing(monkeypatch, weights):
    from keyweave.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_BYTES", 300)
    monkeypatch.setattr(tokens, "CHUNK_CHARS", 10)
    if weights == 0:  # all words of a chunk, and of all chunks, have one hash
        monkeypatch.setattr(tokens, "WEIGHTS", np.zeros(64, np.uint64))
    texts = ["one two three four five six seven", "", None, "two three", "x" * 5000, " " * 3000, *(f"w{i % 7} two <|endoftext|>é" for i in range(50))]
    for make in (bpe._tools(PATH)[0].encode, library_encoder(PATH).cache.encode_words):
        encoder = tokens.Encoder(PATH, make)
        for tail in (None, 0):
            want = [LIB.encode(t or "", add_special_tokens=False).ids + ([] if tail is None else [tail]) for t in texts]
            assert [x.tolist() for x in encoder.encode(texts, tail)] == want


def test_cached_words_are_encoded_once():
    from keyweave.llm import tokens

    asked = []
    encoder = tokens.Encoder(PATH, lambda words: asked.extend(words) or bpe._tools(PATH)[0].encode(words))
    for _ in range(3):
        list(encoder.encode(["one two one", "two " + "y" * 100]))
    assert sorted(asked) == sorted(["one", " two", " one", "two"] + [" " + "y" * 100] * 3)


def plain_merging(rank, text):
    """The pair of lowest rank merges first, leftmost on ties."""
    parts = [text[i : i + 1] for i in range(len(text))]
    while len(parts) > 1:
        best, at = min((rank.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:])))
        if best == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def test_border_rule_equals_plain_merging():
    trie = bpe._tools(PATH)[0]
    rng = random.Random(3)
    raw = {i: t for t, i in trie.vocab.items()}
    pairs = [(rng.randrange(5000), rng.randrange(5000)) for _ in range(20000)]
    for text in rng.sample(list(trie.vocab), 5000):  # both sides of a cut through a token
        for cut in range(1, len(text)):
            if text[:cut] in trie.vocab and text[cut:] in trie.vocab:
                pairs.append((trie.vocab[text[:cut]], trie.vocab[text[cut:]]))
    for a, b in pairs:
        assert trie.stay(a, b) == (plain_merging(trie.rank, raw[a] + raw[b]) == [raw[a], raw[b]])


def test_ids_and_text_columns(spark):
    df = spark.createDataFrame([(1, "hello  world"), (1, "hello  world"), (2, None), (None, "")], "doc_id long, text string")
    got = bpe.with_text(bpe.with_ids(df, PATH), PATH).collect()
    assert [(r.doc_id, r.ids, r.decoded) for r in got] == [(i, LIB.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in [(1, "hello  world"), (1, "hello  world"), (2, None), (None, "")]]
    assert bpe.with_ids(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        bpe.with_ids(df, PATH, ids_col="text")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 50_256), st.integers(0, 2**64 - 1)), max_size=300), st.integers(1, 40))
def test_simple8b_round_trip(values, repeat):
    v = np.array(values * repeat, np.uint64)
    words, starts = simple8b.encode(v)
    assert (simple8b.decode(words, starts, len(v)) == v).all()
    for b in range(len(starts)):
        assert (simple8b.decode(words, starts, len(v), range(b, b + 1)) == v[b * simple8b.BLOCK : (b + 1) * simple8b.BLOCK]).all()


def test_simple8b_is_small():
    ids = np.array(LIB.encode("the quick brown fox and the lazy dog " * 500).ids, np.uint64)
    assert simple8b.encode(ids)[0].nbytes < 2.3 * len(ids) and simple8b.encode(np.zeros(10_000, np.uint64))[0].nbytes < 600
    with pytest.raises(ValueError):
        simple8b.load(b"nope")


def _docs(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["the", "a", "tion", "ßx", "\n"]) for _ in range(r.choice([0, 3, 50, 900, 6000])))) for i in range(60)] + [(100, None), (101, "")]
    return rows, spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, start int, salt int").repartition(7)


def test_token_files(spark, monkeypatch):
    rows, df = _docs(spark)
    want, at = [], 0
    for i, t in rows:
        ids = [*LIB.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, simple8b.digests(simple8b.coded(df, PATH)).collect())) == want
    assert simple8b.coded(df.limit(0), PATH).count() == 0


def test_words_of_any_bytes_are_told_apart():
    """Words go to the library's model together; none may swallow or lend what stands between them."""
    words = ["\x00", "a\x00", "ÿ", "\xff\xfe", " \x00ÿ", "\uffff", "\U0010ffff", "ß", "the"]
    encode = library_encoder(PATH).cache.encode_words
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(words)] == [LIB.encode(w, add_special_tokens=False).ids for w in words]
    assert encode(words[:1]) == encode(words)[:1] and encode([]) == []


def test_digests_of_files_need_one_pass(spark, tmp_path):
    _, df = _docs(spark)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op8_token_files(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, simple8b.digests(simple8b.coded(df, PATH)).collect()))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_token_files_of_null_ids(spark):
    df = spark.createDataFrame([(0, "zero"), (None, "the b"), (-5, "minus"), (None, "a")], "doc_id long, text string")
    for rows in (df, df.where("doc_id is null")):
        got = sorted(simple8b.coded(rows, PATH).collect(), key=lambda r: r.start)
        texts = ["a", "the b", "minus", "zero"][: len(got)]
        assert [r.doc_id for r in got] == [None, None, -5, 0][: rows.count()] and len(got) == rows.count()
        assert [r.ids for r in got] == [[*LIB.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def test_ids_and_text_beside_clashing_columns(spark):
    df = spark.createDataFrame([("hello  world", 7, "x")], "text string, IDS int, decoded string")
    ids = bpe.with_ids(df, PATH)
    got = bpe.with_text(ids, PATH, ids.columns[-1])
    assert got.columns == ["text", "IDS", "decoded", "ids_", "decoded_"]
    assert tuple(got.first()) == ("hello  world", 7, "x", LIB.encode("hello  world", add_special_tokens=False).ids, "hello  world")


def test_packing_is_whole_and_tight(spark):
    rows, df = _docs(spark)
    ids = {i: [*LIB.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    got = packing.packed(df, PATH).collect()
    seqs: dict = {}
    covered: dict = {i: 0 for i in ids}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == covered[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        covered[r.doc_id] += r.length
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert covered == {i: len(x) for i, x in ids.items()}
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert packing.packed(df.limit(0), PATH).count() == 0
    twice = df.where("doc_id = 3").union(df.where("doc_id = 3")).selectExpr("cast(null as long) AS doc_id", "text")
    assert sum(r.length for r in packing.packed(twice, PATH).collect()) == 2 * len(ids[3])


def plain_balance(lengths, capacity):
    """Every piece in turn asks every sequence."""
    loads = [[0, 0.0] for _ in range(-(-sum(lengths) // capacity))]
    where = [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fit = [(cost, k) for k, (used, cost) in enumerate(loads) if used + n <= capacity]
        k = min(fit)[1] if fit else len(loads)
        if not fit:
            loads.append([0, 0.0])
        where[i] = k, loads[k][0]
        loads[k][0] += n
        loads[k][1] += packing.LINEAR * n + packing.QUADRATIC * n * n
    return [w[0] for w in where], [w[1] for w in where]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_balance_equals_asking_every_sequence(lengths):
    assert packing.balance(lengths, 64) == plain_balance(lengths, 64) if lengths else packing.balance([]) == ([], [])


def test_balance():
    r = random.Random(1)
    lengths = [r.randint(1, 2048) for _ in range(3000)]
    seq, offset = packing.balance(lengths)
    load: dict = {}
    for s, n in zip(seq, lengths, strict=True):
        load[s] = load.get(s, 0) + n
    assert max(load.values()) <= 2048 and sum(lengths) / (2048 * len(load)) > 0.93
    # four equal documents and two places: each sequence gets two
    assert sorted(packing.balance([600, 600, 600, 600], 1200)[0]) == [0, 0, 1, 1]
    assert packing.balance([]) == ([], [])
