"""Main text of HTML pages by two-pass block rules."""

from __future__ import annotations

import html
import re
from bisect import bisect, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from keyweave.llm.common import fresh, without

# Frequent function words of English, German, French, Spanish, Italian and Portuguese.
STOP_WORDS = frozenset("""
the of and to in a is that it for was on are as with his they at be this from have or by had not but what all were when
der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach
le la les des et est un une du que qui dans en pour pas sur au avec ce il par plus ne se aux son
el los las del y en que se por con para una su al lo como más pero sus o este
il di che non per una sono ho gli del della o os as do da em um uma não para com
""".split())
# Elements whose content is no running text, and elements that hold page furniture.
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template")
DROP = frozenset("head nav footer aside form button select option svg math canvas audio video object map dialog menu fieldset label datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5
h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
#: An open p ends where one of these starts.
ENDS_P = BLOCKS - frozenset("html body caption tbody td tfoot th thead tr".split())
#: Elements that an equal sibling start tag ends, up to the given container.
SIBLINGS = {"li": {"ul", "ol", "menu"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table"}, "dd": {"dl"}, "dt": {"dl"}, "option": {"select"}}
ALIKE = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}
#: Elements through which a block does not end an open p outside.
LIMITS = frozenset(["table", "td", "button", "object"])
# Words in class, id or role that mark furniture.
FURNITURE = frozenset("""ad ads advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert
sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager header masthead footer foot colophon comment comments respond
reply replies disqus share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay widget widgets
toolbar complementary contentinfo search skip toc tags hidden legal copyright""".split())
# Words that a class or id may add to those of FURNITURE and still name furniture (site-header, ad-box-left).
FORMS = frozenset("""site page main top bottom left right primary secondary global mobile desktop sticky fixed inner outer wrapper wrap container box bar area
section block list lists item items link links button buttons btn icon icons unit slot col column group panel row title text message body content form entry post
posts article articles story news js""".split())
#: Words of furniture that stays so whatever its size, as comments and notices often outweigh the text.
NEVER = frozenset("""ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion cookie cookies consent gdpr comment comments
respond reply replies disqus related recommended recommendations""".split())
#: Elements of DROP that some sites put around the whole page.
WRAPPERS = frozenset(["form", "fieldset"])
#: Those that make even an article element furniture.
ASIDE = frozenset("ad ads advert comment comments reply replies promo related recommended sponsored".split())
#: Names that begin with one of these are content outside an article, whatever follows (content has-sidebar).
CONTENT = frozenset("article articlebody main content entry post story text body".split())
#: First pass: link share of a block that is navigation, least characters of a long block, stop-word shares.
LINKS, LONG, SHORT, RICH, POOR = 0.5, 200, 70, 0.3, 0.15

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(script|style|textarea|title|noscript|iframe|xmp|noembed|noframes|template)\b(?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*+)?)*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"'][^\s>]*+)?)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S | re.I)  # fmt: skip
_ATTR = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: int
    in_article: bool
    heading: bool
    label: str = ""
    pieces: list[tuple[tuple[int, ...], str, int]] | None = None


def _furniture(tag: str, attrs: str, in_article: bool) -> int:
    """0: no furniture. 1: furniture unless it holds most of the running text. 2: furniture.

    A class, id or role names furniture only as a whole: each of its words is one of FURNITURE, or of FORMS beside one.
    """
    if tag in DROP and tag not in WRAPPERS or (tag == "header" and not in_article):
        return 2
    level = 1 if tag in WRAPPERS else 0
    if not attrs.strip():
        return level
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return 2
    names = " ".join(html.unescape(found.get(k, "")) for k in ("class", "id", "role"))
    named = set()
    first = None
    for name in names.split():
        words = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)]
        first = first or (words[0] if words else None)
        words = [w for w in words if len(w) > 1]
        if all(w in FURNITURE or w in FORMS for w in words):
            named.update(FURNITURE.intersection(words))
    if in_article:
        named -= {"header", "masthead"}
    if tag == "article":
        return 2 if ASIDE & named else 0
    if tag in ("html", "body", "main") or not named or (not in_article and first in CONTENT):
        return level
    return 2 if NEVER & named else 1


def blocks(page: str) -> list[Block]:
    """Blocks of visible text outside furniture, in page order, each with its white space folded.

    A form, or an element that only its name makes furniture, stays where it holds most of the running text.
    """
    out: list[Block] = []
    stack: list[tuple[str, int]] = []  # (tag, level of the furniture that it starts)
    places: dict[str, list[int]] = {}  # of each tag that is open: where it is in the stack
    walls: list[int] = []  # places of open block elements, and of those that end the reach of a p
    limits: list[int] = []
    dropped = linked = article = 0
    seen_article = False
    parts: list[tuple[tuple[int, ...], str, int]] = []  # (elements of level 1 around it, text, linked characters)
    around: dict[int, int] = {}  # such elements that are open: depth in the stack to number
    within: tuple[int, ...] = ()
    kinds: list[tuple[bool, bool]] = []  # of each such element: a form, outside any article
    heading = False

    def flush() -> None:
        text = " ".join("".join(p[1] for p in parts).split())
        if text:
            pieces = parts.copy() if any(p[0] for p in parts) else None
            out.append(Block(text, sum(p[2] for p in parts), article > 0, heading, pieces=pieces))
        parts.clear()

    def close(depth: int) -> None:
        nonlocal dropped, linked, article, heading, within
        while len(stack) > depth:
            tag, starts = stack.pop()
            places[tag].pop()
            if tag in BLOCKS:
                walls.pop()
                flush()
            if tag in LIMITS:
                limits.pop()
            dropped -= starts == 2
            if around.pop(len(stack), None) is not None:
                within = tuple(around.values())
            linked -= tag == "a"
            article -= tag in ("article", "main")
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                heading = False

    def unlink() -> None:
        """The innermost open link ends here; its element stays open under no name."""
        nonlocal linked
        depth = places["a"].pop()
        stack[depth] = ("-", stack[depth][1])
        insort(places.setdefault("-", []), depth)
        linked -= 1

    def say(raw: str) -> None:
        if raw and not dropped:
            text = html.unescape(raw)
            parts.append((within, text, len(text.strip()) if linked else 0))

    at = 0
    for m in _TOKEN.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if m[2]:
            depth = places[tag][-1] if places.get(tag) else -1
            # An end tag inside furniture or a block closes nothing outside it; inline end tags close nothing across blocks.
            if depth >= 0 and (tag in BLOCKS or not walls or walls[-1] <= depth):
                close(depth)
            elif tag == "a" and depth >= 0:
                unlink()
            elif tag in BLOCKS:
                flush()
            continue
        if tag == "br":
            parts.append((within, " ", 0))
            continue
        if tag in ENDS_P and places.get("p"):
            depth = places["p"][-1]
            if not limits or limits[-1] < depth:
                close(depth)
        if tag in SIBLINGS:
            depth = max((places[t][-1] for t in ALIKE.get(tag, (tag,)) if places.get(t)), default=-1)
            if depth > max((places[t][-1] for t in SIBLINGS[tag] if places.get(t)), default=-1):
                close(depth)
        if tag in BLOCKS:
            flush()
        if tag in VOID or m[4].rstrip().endswith("/") and tag not in BLOCKS:
            if tag == "img" or tag == "hr":
                parts.append((within, " ", 0))
            continue
        if tag == "a" and places.get("a"):
            unlink()
        furniture = _furniture(tag, m[4], article > 0)
        if tag in ("article", "main") and not furniture and not seen_article:
            # The page's first article lies in an element that only looked like furniture by its class.
            seen_article = True
            for i, (t, starts) in enumerate(stack):  # once a page
                if starts and t not in DROP:
                    stack[i], dropped = (t, 0), dropped - (starts == 2)
                    around.pop(i, None)
            within = tuple(around.values())
        starts = 0 if dropped else furniture
        if starts == 1:
            around[len(stack)] = len(kinds)
            kinds.append((tag in WRAPPERS, not article))
            within = tuple(around.values())
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCKS:
            walls.append(len(stack))
        if tag in LIMITS:
            limits.append(len(stack))
        stack.append((tag, starts))
        dropped += starts == 2
        linked += tag == "a"
        article += tag in ("article", "main")
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            heading = True
    tail = page[at:]
    say(tail)
    close(0)
    flush()
    return _without_furniture(out, kinds) if kinds else out


def _without_furniture(found: list[Block], kinds: list[tuple[bool, bool]]) -> list[Block]:
    """Blocks without the text in elements of level 1, save in those with more than half of the running text.

    Running text is blocks of SHORT characters that are no links: those in articles, if articles hold any text, else all;
    for a form, either. Where articles hold short blocks only, these count for elements around articles.
    """
    text = [b for b in found if b.linked <= LINKS * len(b.text)]
    marked = [b for b in text if b.in_article]
    every = [b for b in text if len(b.text) >= SHORT]
    running = [b for b in marked if len(b.text) >= SHORT] if marked else every

    def most(of: list[Block]) -> set[int]:
        held: Counter[int] = Counter()
        for b in of:
            if b.pieces is None:
                continue
            for inside, piece, _ in b.pieces:
                held.update(dict.fromkeys(inside, len(piece)))
        total = sum(len(b.text) if b.pieces is None else sum(len(p[1]) for p in b.pieces) for b in of)
        return {k for k, n in held.items() if 2 * n > total}

    stay = most(running) | {k for k in most(every) if kinds[k][0]}
    if marked and not running:
        stay |= {k for k in most(marked) if kinds[k][1]}
    out = []
    for b in found:
        if b.pieces is not None:
            kept = [p for p in b.pieces if stay.issuperset(p[0])]
            b.text, b.linked, b.pieces = " ".join("".join(p[1] for p in kept).split()), sum(p[2] for p in kept), None
        if b.text:
            out.append(b)
    return out


def classify(found: list[Block]) -> None:
    """Pass 1 decides blocks by link share, length and stop words, or leaves them short; pass 2 asks their neighbours.

    An article mark counts where at least half of the text that pass 1 finds good (if none is, of the text that is no
    links) lies in it. Then only links make a block in it bad, and pass 2 asks neighbours on the same side of the mark
    only: between unlike ones, or where pass 1 finds nothing good, a short block is text inside and, alone, none outside.
    """
    for b in found:
        words = _WORD.findall(b.text.lower())
        density = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
        if b.linked > LINKS * len(b.text):
            b.label = "bad"
        elif len(b.text) < SHORT:
            b.label = "short"
        elif density >= RICH or (density >= POOR and len(b.text) >= LONG):
            b.label = "good"
        elif density >= POOR:
            b.label = "short"
        else:
            b.label = "bad" if b.linked or len(words) < 10 else "short"
    text = [b for b in found if b.label == "good"] or [b for b in found if b.linked <= LINKS * len(b.text)]
    inside = sum(len(b.text) for b in text if b.in_article)
    if not inside or 2 * inside < sum(len(b.text) for b in text):
        _inherit(found, list(range(len(found))), None)
        return
    for b in found:
        if b.in_article and b.label == "bad" and b.linked <= LINKS * len(b.text):
            b.label = "short"
    for side in (True, False):
        _inherit(found, [i for i, b in enumerate(found) if b.in_article is side], side)


def _inherit(found: list[Block], at: list[int], inside: bool | None) -> None:
    """Pass 2 over the blocks at `at`, inside or outside a mark that counts, or (None) with no such mark."""
    labels = {i: found[i].label for i in at if found[i].label != "short"}
    if inside and "good" not in labels.values():
        labels = {}
    decided = list(labels)
    for i in at:
        b = found[i]
        if b.label != "short":
            continue
        k = bisect(decided, i)
        before, after = decided[k - 1] if k else None, decided[k] if k < len(decided) else None
        if not decided:
            b.label = "good" if inside or (inside is None and not b.heading) else "bad"
        elif b.heading and not (inside and after is None):
            b.label = labels[after] if after is not None else "bad"
        elif before is None or after is None:
            b.label = labels[before if after is None else after]
        elif labels[before] == labels[after]:
            b.label = labels[before]
        elif inside:
            b.label = "good"
        else:  # the nearer one, text on a tie
            b.label = labels[before] if i - before < after - i else labels[after] if after - i < i - before else "good"


def main_text(page: str | None) -> str:
    """Main text of one page: good blocks joined by line feeds. Null and empty pages give an empty string."""
    if not page:
        return ""
    found = blocks(page)
    classify(found)
    return "\n".join(b.text for b in found if b.label == "good")


def extracted(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages without html_col, plus out_col, the main text; one row per row, whatever the page holds. No shuffle.

    A column that is named like out_col is replaced; null html gives an empty text.
    """
    keep = without(pages, [html_col, out_col])
    rows = pages.select(*[pages[c] for c in keep], pages[html_col].cast("string").alias(fresh(pages, "_html")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                text = pa.array([main_text(x.as_py()) for x in batch.column(len(keep))], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], text], names=[*keep, out_col])

    from pyspark.sql import types as T

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField(out_col, T.StringType())]))
