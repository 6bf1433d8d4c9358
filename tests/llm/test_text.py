import math
import re
import time
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from keyweave.llm import chat, html_text, urls


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<", "<"), ("<p", ""), ("<article><p>a &amp; b&nbsp;&lt;p&gt; &#233; c</p></article>", "a & b <p> é c"),
    ("<html><head><title>T</title><style>x{}</style></head><body><nav><a href=/>Home</a></nav><header>Site</header><article><h1>Head</h1><p>One\n  two<p>Three<br>four</article><footer>F</footer>", "Head\nOne two\nThree four"),
    ("<article><header><h1>Inner</h1></header><p>x</p><aside>no</aside><form>no<input></form><div class='ad'>no</div><script>'</p>'</script><!-- <p>no</p> --><p>y</article>", "Inner\nx\ny"),
    ("<main><p>text</p><section id=comments><h2>Comments</h2><article class=comment><p>reader says</p></article></section></main>", "text"),
    ("<div class=cookie-notice><p>We use cookies, you know that and it is on the page for all of you to see and to accept.</div><article><p>And.</p></article>", "And."),
    ("<div class='layout-with-sidebar'><article><p>kept</p></article><div id='sidebar'><p>gone</p></div></div>", "kept"),
    ("<article><p>a <b>bold <i>and</b> more</i> text</p></article>", "a bold and more text"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><pre>p  q</pre></article>", "one\ntwo\nc1\nc2\np q"),
    ("<article><p>cut &am", "cut &am"), ("<article><p>x <a href='it>s'>l</a>", "x l"), ("<article><p hidden>h</p><p style='display: none'>n</p><p>v", "v"),
])
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_two_passes_without_article():
    long = "It was the best of times and it was the worst of times for all of them who had been there with us in that year of the war. " * 2
    page = f"<div><a href=/a>Home</a> <a href=/b>About us</a></div><div><h2>Title of it</h2><p>{long}</p><p>Short one.</p><p>{long}</p></div><div><a href=/c>Imprint</a></div><p>All rights</p>"
    assert html_text.main_text(page).split("\n") == ["Title of it", long.strip(), "Short one.", long.strip()]


def test_article_mark_decides_no_page_alone():
    body = "It was the best of times and it was the worst of times for all of them who had been there with us in that year of the war. " * 3
    cards = "".join(f"<article><h3><a href=/{i}>Card {i} with its own title</a></h3><p>Teaser {i}.</p></article>" for i in range(4))
    assert html_text.main_text(f"<div><h1>Title</h1><p>{body}</p><p>{body}</p></div><section>{cards}</section>").split("\n") == ["Title", body.strip(), body.strip()]
    links = "<p>" + "<a href=/x>one more link of many</a> " * 4 + "</p>"
    page = f"<div>Posted in News</div><article><h1>Title</h1><p>{body}</p><pre>x1 y2 z3</pre><p>{body}</p>{links}<p>Tags.</p>{links}</article><div>All rights</div>"
    assert html_text.main_text(page).split("\n") == ["Title", body.strip(), "x1 y2 z3", body.strip()]


BODY = "It was the best of times and it was the worst of times for all of them who had been there with us in that year of the war."


@pytest.mark.parametrize("page, text", [
    (f"<div id=page class='site has-sidebar'><p>{BODY}</p><div id=sidebar><p>gone</p></div></div>", BODY),
    (f"<div class='sidebar-right'><div class=nav><a href=/>Home</a></div><p>{BODY}</p></div>", BODY),
    (f"<form action=x.aspx><input><article><p>{BODY}</p><form>no</form></article></form>", BODY),
    ("<form><article><p>Short.</p></article></form>", "Short."), (f"<form><fieldset><p>{BODY}</p></fieldset></form><p>Rights</p>", f"{BODY}\nRights"),
    (f"<article><header class='entry-header'><h1>Head</h1></header><section id='legal-basis'><p>{BODY}</p></section><h2 id='social-history'>Then</h2><p>{BODY}</p></article>", f"Head\n{BODY}\nThen\n{BODY}"),
    (f"<article class='post has-comments'><p>{BODY}</p><form>Mail me<input></form><div class='post-tags'>t1</div><p>a <span class='share-buttons'>Share</span>b</p><div id=comments><p>{BODY * 9}</p></div></article>", f"{BODY}\na b"),
])
def test_furniture_is_whole_names_and_little_text(page, text):
    assert html_text.main_text(page) == text


def test_many_unclosed_tags_stay_fast():
    assert html_text.main_text("<article>" + "<p><b>w<br>" * 20_000).count("w") == 20_000
    for part in ("<a href=x>w ", "<a><b><i>w ", "<a><p>w</a>", "<span>w</b>", "<ul><li>w", "<div><table><tr><td>w<p>"):
        began = time.process_time()
        html_text.main_text("<article>" + part * 20_000)
        assert time.process_time() - began < 4, part  # about 0.5 s each


def plain_labels(found):
    """Both passes again, block by block, each short block asking all others."""
    def share(b):
        words = re.findall(r"[^\W\d_]+", b.text.lower())
        return sum(w in html_text.STOP_WORDS for w in words) / max(len(words), 1), len(words)

    def first(b):
        density, words = share(b)
        if b.linked > len(b.text) / 2:
            return "bad"
        if len(b.text) < 70:
            return "short"
        if density >= 0.3 or density >= 0.15 and len(b.text) >= 200:
            return "good"
        if density >= 0.15:
            return "short"
        return "bad" if b.linked or words < 10 else "short"

    labels = [first(b) for b in found]
    plain = [b.linked <= len(b.text) / 2 for b in found]
    text = [i for i, x in enumerate(labels) if x == "good"] or [i for i, x in enumerate(plain) if x]
    marked = sum(len(found[i].text) for i in text if found[i].in_article)
    counts = marked > 0 and marked >= sum(len(found[i].text) for i in text) / 2
    if counts:
        labels = ["short" if b.in_article and x == "bad" and p else x for b, x, p in zip(found, labels, plain)]
    out = list(labels)
    for i, b in enumerate(found):
        if labels[i] != "short":
            continue
        inside = b.in_article if counts else None
        decided = [k for k, x in enumerate(labels) if x != "short" and (not counts or found[k].in_article == b.in_article)]
        if inside and not any(labels[k] == "good" for k in decided):
            decided = []
        before, after = max((k for k in decided if k < i), default=None), min((k for k in decided if k > i), default=None)
        near = [labels[k] for k in (before, after) if k is not None]
        if not near:
            out[i] = "good" if inside or inside is None and not b.heading else "bad"
        elif b.heading and not (inside and after is None):
            out[i] = "bad" if after is None else labels[after]
        elif len(set(near)) == 1:
            out[i] = near[0]
        elif inside or after - i == i - before:
            out[i] = "good"
        else:
            out[i] = labels[min((before, after), key=lambda k: abs(k - i))]
    return out


BLOCK = st.builds(
    lambda words, stops, linked, inside, heading: html_text.Block(" ".join(["the"] * stops + ["word"] * words), linked, inside, heading),
    st.integers(0, 45), st.integers(0, 14), st.sampled_from([0, 0, 0, 30, 400]), st.booleans(), st.sampled_from([False, False, True]))


@settings(max_examples=400, deadline=None)
@given(st.lists(BLOCK, max_size=9).map(lambda bs: [b for b in bs if b.text]))
def test_labels_equal_a_plain_labeller(found):
    html_text.classify(found)
    assert [b.label for b in found] == plain_labels(found)


def test_every_block_of_the_pages_has_its_label_from_a_pass():
    import pyarrow.parquet as pq

    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        found = html_text.blocks(page or "")
        html_text.classify(found)
        assert [b.label for b in found] == plain_labels(found)


def test_extracted_edges(spark):
    df = spark.createDataFrame([(1, None, "u", 7, "z"), (1, "<p>It is the one that was in the house of the man and he is at it.</p>", None, None, None)], "page_id long, html string, url string, TEXT int, _html string")
    got = html_text.extracted(df).orderBy("text").collect()
    assert [r["text"] for r in got] == ["", "It is the one that was in the house of the man and he is at it."] and got[0]["_html"] == "z"
    assert html_text.extracted(df.limit(0)).count() == 0


TEXT = st.lists(
    st.sampled_from(["<", "\\", "|", "|>", "<|end|>", "<|join|>", "a", "\n", "é", "😀", "<|turn|>", "<|says|>", "$1"]), max_size=8).map("".join)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["user", "assistant", "<|end|>", "", None]), st.one_of(st.none(), TEXT)), min_size=1, max_size=9))
def test_chat_round_trip(spark, turns):
    df = spark.createDataFrame([(1, *t, "x") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    row = chat.formatted(df).withColumn("back", chat.parsed("formatted")).withColumn("loss", chat.loss_texts()).first()
    want = [(r or "", x or "") for _, r, x in sorted(turns, key=lambda t: (t[0], t[1] or "", (t[2] or "").encode()))]
    assert [(b["role"], b["text"]) for b in row["back"]] == want
    assert row["loss"] == [x for r, x in want if r == "assistant"] and sum(r["n"] for r in row["mask"]) == len(row["formatted"])


def test_very_long_conversations_and_masks_that_do_not_fit(spark):
    """Twice the turns take about twice the time, and a mask of another text is refused."""
    took = []
    for n in (4000, 16000):
        turns = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('text <|', id, repeat('é', 40)) AS text")
        made = spark.createDataFrame(chat.formatted(turns).collect(), chat.formatted(turns).schema)
        began = time.perf_counter()
        got = made.select(chat.loss_texts("formatted", "mask").alias("loss"), F.size(chat.parsed(F.col("formatted"))).alias("n")).first()
        took.append(time.perf_counter() - began)
        assert got["n"] == n and got["loss"] == [f"text <|{i}" + "é" * 40 for i in range(1, n, 2)]
    assert took[1] < 10 * took[0] + 2
    with pytest.raises(Exception, match="does not fit"):
        made.select(chat.loss_texts(F.concat(F.lit(""), F.regexp_replace("formatted", "text", "txt")), "mask")).collect()


def test_chat_edges(spark):
    df = spark.createDataFrame([(None, 1, "user", "a"), (None, 1, "user", "a"), (2, None, None, None)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: len(r.back) for r in chat.formatted(df).withColumn("back", chat.parsed("formatted")).collect()}
    assert got == {None: 2, 2: 1} and chat.formatted(df.limit(0)).count() == 0


def test_rules_and_models(spark):
    from keyweave.llm.queries import URL_RULES

    cases = {
        "http://www.example.com/en/1": ("com/en/", "block"), "https://EXAMPLE.com/en/77?x": ("example.com/en/7", "allow"), "http://a.net/de/8": ("net/de/", "allow"), "http://x.example.net/de/8": ("example.net/de/8", "block"),
        "http://org/es/": ("org/es/", "block"), "http://notcom/en/": (None, "allow"), "http://x.com/EN/": (None, "allow"), "http://casino-win.example.org/fr/1": (None, "block"), "http://freebetscasino.io?/en/": (None, "block"),
        "no url": (None, "allow"), None: (None, "allow"), "a://b://c.com/en/": (None, "allow"),
    }
    df = spark.createDataFrame([(u, 1, "h") for u in [*cases, None]], "url string, Host int, verdict string")
    got = urls.judged(df, URL_RULES).collect()
    assert len(got) == len(cases) + 1 and {r["url"]: (r["rule"], r["verdict"]) for r in got} == cases
    assert {(r["host"], r["path"]) for r in got if r["url"] in (None, "no url")} == {("", "")}
    assert urls.judged(df.limit(0), URL_RULES).count() == 0


def test_segmentation():
    m = urls.LISTED
    assert m.segment("cheappillsonline") == ["cheap", "pills", "online"] and m.segment("zzqx") == ["zzqx"] and m.segment("") == []
    assert m.score("dailynews.example", "") < 0.25 < m.score("onlinecasino.example", "")
    assert len(m.tokens("q" * 100_000 + "cheappills")) == 3  # a very long name, not remembered
    assert all(len(k) <= urls.LONGEST for k in m._known)


def every_split(name):
    """All ways to cut a name into words, neighbours that are unknown being one word."""
    if not name:
        yield []
    for k in range(1, len(name) + 1):
        for rest in every_split(name[k:]):
            yield [name[:k], *rest]


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=9))
def test_segmentation_equals_trying_every_split(name):
    m = urls.Model({"a": -2.0, "ab": -2.5, "bc": -3.0, "abc": -4.5, "cab": -3.5, "bb": -9.0})

    def value(words):
        return sum(m.unigram[w] if w in m.unigram else math.log(urls.UNKNOWN) - len(w) * math.log(26) for w in words)

    assert value(m.segment(name)) == pytest.approx(max(map(value, every_split(name))))
    assert "".join(m.segment(name)) == name


def test_frequent_words_are_bounded(spark):
    counts = spark.createDataFrame([(f"w{i}", i) for i in range(1, 200)], "w string, n long")
    got = sorted(r.n for r in urls.frequent(counts, 60).collect())
    assert 30 < len(got) <= 60 and got == list(range(200 - len(got), 200)) and urls.frequent(counts, 500).count() == 199
    assert urls.frequent(counts.limit(0), 5).count() == 0


def test_learned_url_model_equals_counting_by_hand(spark):
    """Words come from texts, likelihoods from urls; Bayes is worked out in full."""
    seen = ["http://redriver.com/a", "http://redriver.com/b", "http://redcasino.com/a", None, "x", "http://casinoriver.com/"]
    pages = spark.createDataFrame([(u,) for u in seen], "url string").repartition(3)
    docs = spark.createDataFrame([("red river River",), (None,), ("Red-river, blue!",)], "text string")
    m = urls.train(pages, docs)
    assert m.segment("redrivercasino") == ["red", "river", "casino"] and m.segment("bluered") == ["blue", "red"]
    words = {u: m.tokens(u.split("://")[1]) if u and "://" in u else [] for u in seen}
    block, allow = Counter(urls.BLOCKED), Counter(urls.ALLOWED)
    for u in seen:
        (block if "casino" in words[u] else allow).update(words[u])
    nb, na = block.total(), allow.total()
    mix = lambda c, n, w: (c[w] + urls.MIXED * (block[w] + allow[w]) / (nb + na)) / (n + urls.MIXED)
    prior = (2 + urls.MIXED * urls.PRIOR) / (6 + urls.MIXED)
    for u in ("http://redriver.com/", "http://casino.com/", "http://unheardof.com/red"):
        odds = prior / (1 - prior)
        for w in m.tokens(u.split("://")[1]):
            if block[w] + allow[w]:
                odds *= mix(block, nb, w) / mix(allow, na, w)
        host, path = u.split("://")[1].split("/", 1)
        assert m.score(host, path) == pytest.approx(odds / (1 + odds))
    empty = urls.train(pages.limit(0), docs.limit(0))
    assert empty.score("onlinecasino.example", "") == urls.LISTED.score("onlinecasino.example", "")
