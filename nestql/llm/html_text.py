"""Main text of HTML pages by two-pass block rules.

A page is cut at block-level tags into blocks of text. Pass one classifies every
block by its length and its densities of links and stop words: mostly links are
bad; short ones and headings stay ambiguous; many stop words are good; without
many, blocks of middling length are ambiguous too, and long ones are good with
some and bad with few. Where less than half of the text in blocks that aren't
short or linked has many stop words, the page's language counts as unknown, and
all those blocks are good.

Tags and classes are evidence that moves these classes. A block in a marked part
of the page, one whose tag or class says that it isn't content (menu, header,
footer, sidebar, notice, advert, form, reader comment), is bad, whatever its
densities. In an article or main part a class counts one step better: ambiguous
blocks that aren't short are good, long ones with few stop words ambiguous, and
so are short ones that are links.
An article or main part outside other articles clears the mark of wrappers around
it, by class, id or role or as a form, unless articles without such a wrapper
hold as much text; it doesn't clear that of hidden parts and of other tags. Names
such as has-sidebar or no-ads mark nothing, and broad words (search, share, side)
only alone or with words for parts of a page (search-box, not search-result).

Pass two gives ambiguous blocks the label of their nearest decided neighbours on
either side; blocks of marked parts say nothing about blocks beside these parts.
Both neighbours alike, or the nearer of the two, count, a tie going to the one
after it for a heading and to bad otherwise. In an article or main part only
blocks of such parts are neighbours, and an ambiguous block is good unless both
are bad; one that is linked or long, unless one of them is. On a page without a
good block all ambiguous ones are kept.

Character references are decoded, white space inside a block becomes one blank,
and good blocks are joined in page order by one blank.

Defined cases: a null or empty page has an empty text; any length of page and any
depth of tags is read whole, in time linear in it, broken or cut markup to its
end; repeated rows give a row each; no pages give no rows; input columns named
like an output are replaced, all others are kept.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from nestql.llm.common import map_texts, table, tidy

#: Density of links above which a block is bad; of stop words at which it is good and below which it is bad.
MAX_LINKS, STOP_HIGH, STOP_LOW = 0.5, 0.28, 0.10
#: Characters below which a block is short, and above which it is long.
SHORT, LONG = 70, 200

STOP_WORDS = frozenset(
    (
        "a about after all also an and any are as at be because been but by can do for from had has have he her his how i if in into is it its just like more most my no not now of on one only or other our out over she so some such than that the their them then there these they this to up was we were what when which who will with would you your "
        "aber als am an auch auf aus bei bin bis da dann das dass dem den der des die diese dieser doch du durch ein eine einem einen einer eines er es für hat hatte ich ihr ihre im in ist ja kann man mehr mit nach nicht noch nur oder ohne schon sehr sein seine sich sie sind so über um und uns unter vom von vor war was wenn werden wie wir wird wo zu zum zur "
        "ai au aux avec c ce ces cette d dans de des du elle en est et eu il ils j je l la le les leur lui mais me même mes n ne nos nous on ont ou où par pas plus pour qu que qui s sa se ses si son sont sur tout un une vous y à été être "
        "al algo como con cuando de del desde donde el ella en entre era es esta este esto fue ha hasta hay la las le les lo los me mi muy no nos o otra para pero poco por porque que se ser si sin sobre son su sus también tan te tiene todo un una uno y ya"
    ).split()
)
BLOCK_TAGS = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td template textarea tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: Their content isn't text of the page.
RAW_TAGS = frozenset("script style noscript template iframe textarea title svg math object canvas select option button head noembed noframes xmp".split())
BAD_TAGS = frozenset("nav header footer aside form menu dialog fieldset label legend".split())
GOOD_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of a class, id or role that mark parts other than content.
BAD_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer header masthead topbar notice notices cookie cookies consent gdpr alert warning popup modal overlay newsletter subscribe signup login search share sharing social related recommended comment comments reply replies respond disqus widget toolbar pager pagination contentinfo complementary hidden disclaimer copyright".split())

#: Of these, words that mark a part only alone or with words for parts of a page.
BROAD_WORDS = frozenset("alert hidden related search share side".split())
PART_WORDS = frozenset("and articles bar block blocks box btn button buttons container content field form group icon icons input inner is item items left link links list module news panel pages posts products reading right section slot stories text this tools top topics bottom unit visually widget wrap wrapper zone".split())
#: A name that holds one of these before such a word says how a part is laid out beside others, or that it is missing.
LAYOUT_WORDS = frozenset("has have no non not with without".split())
#: Bad by their meaning; a form may be around a whole page.
WRAPPERS = frozenset(["form"])

_token = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>\x00]*)([^>]*)(?:>|\Z)", re.S)
_hints = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_hidden = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*[\"']?true", re.I)
_part = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
_word = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    link_chars: int
    bad: bool
    good: bool
    heading: bool
    #: In an article or main part below a wrapper that is marked as no content.
    wrapped: bool = False
    #: In a part that tags or classes mark as no content.
    marked: bool = False


def marks(name: str) -> set[str]:
    """The words of one name that mark a part other than content."""
    words = [p.lower() for p in _part.findall(name)]
    out = set()
    for i, w in enumerate(words):
        if w not in BAD_WORDS or LAYOUT_WORDS.intersection(words[:i]):
            continue
        if w not in BROAD_WORDS or all(x in BAD_WORDS or x in PART_WORDS for x in words):
            out.add(w)
    return out


def hinted(attributes: str, in_article: bool = False) -> bool:
    """Whether class, id or role say that an element isn't content; the header of an article is."""
    if not attributes:
        return False
    if _hidden.search(attributes):
        return True
    for m in _hints.finditer(attributes):
        found = {w for name in (m[1] or m[2] or m[3] or "").split() for w in marks(name)}
        if found and not (in_article and found == {"header"}):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The blocks of a page that hold text, in page order."""
    out: list[Block] = []
    # name, bad by itself, a wrapper or hint that an article below it clears, good by itself, marks cleared outside it
    open_tags: list[tuple[str, bool, bool, bool, int]] = []
    bad = soft = cleared = good = links = heads = 0
    named: dict[str, int] = {}  # how many tags of each name are open
    text: list[str] = []
    in_links: list[str] = []

    def close_block() -> None:
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            linked = " ".join(html.unescape("".join(in_links)).split())
            marked = bad > 0 or soft > cleared
            out.append(Block(joined, len(linked), marked, good > 0, heads > 0, cleared > 0, marked))
        text.clear()
        in_links.clear()

    def pop() -> None:
        nonlocal bad, soft, cleared, good, links, heads
        name, was_bad, was_soft, was_good, cleared = open_tags.pop()
        named[name] -= 1
        bad -= was_bad
        soft -= was_soft
        good -= was_good
        links -= name == "a"
        heads -= name in HEADINGS

    at, n = 0, len(page)
    while at < n:
        m = _token.search(page, at)
        end = m.start() if m else n
        if end > at:
            text.append(page[at:end])
            if links:
                in_links.append(page[at:end])
        if m is None:
            break
        at = m.end()
        # the last three groups: a tag whose quotes don't pair
        name, attributes = (m[2], m[3]) if m[2] else (m[5], m[6])
        if name is None:
            continue
        name = name.lower()
        if m[1] or m[4]:
            if name in BLOCK_TAGS:
                close_block()
            if named.get(name):
                while open_tags[-1][0] != name:
                    pop()
                pop()
            continue
        if name in BLOCK_TAGS:
            close_block()
        if name in RAW_TAGS and not attributes.endswith("/"):
            if name == "head":  # its parts hold no text of the page; it may lack an end
                continue
            close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if name in VOID_TAGS or attributes.endswith("/"):
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and any(t[0] == name for t in open_tags[-4:]):
            scope = {"li": "ul ol menu", "td": "table tr", "th": "table tr", "tr": "table", "dt": "dl", "dd": "dl"}.get(name, "div section article main aside body")
            tail = [t[0] for t in open_tags[-4:]]
            place = len(tail) - 1 - tail[::-1].index(name)
            if not any(t in scope.split() for t in tail[place + 1 :]):
                while open_tags[-1][0] != name:
                    pop()
                pop()
        hint, is_good = hinted(attributes, good > 0), name in GOOD_TAGS
        is_bad = name in BAD_TAGS - WRAPPERS or hint and bool(_hidden.search(attributes))
        is_soft = not is_bad and (hint or name in WRAPPERS)
        if name in ("html", "body", "article", "main"):
            is_bad = is_soft = False
        if good and name == "header" and not hinted(attributes, True):  # an article's own header holds its title
            is_bad = False
        outside = cleared
        # articles in an article's marked parts are reader comments and the like; a main part may hold marked wrappers
        if is_good and not hint and not named.get("article"):
            cleared = soft
        bad += is_bad
        soft += is_soft
        good += is_good
        links += name == "a"
        heads += name in HEADINGS
        named[name] = named.get(name, 0) + 1
        open_tags.append((name, is_bad, is_soft, is_good, outside))
    close_block()
    plain, wrapped = (sum(len(b.text) for b in out if b.good and not b.bad and b.wrapped == w) for w in (False, True))
    if wrapped <= plain:  # teasers and comments beside the main text
        for b in out:
            b.bad |= b.wrapped
            b.marked |= b.wrapped
    return out


def stop_density(text: str) -> float:
    words = _word.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def classes(found: list[Block]) -> list[bool | None]:
    """Pass one: good, bad or ambiguous (None) by length and densities, and by the tags around."""
    linked = [b.link_chars > MAX_LINKS * len(b.text) for b in found]
    told = [None if x or len(b.text) < SHORT else stop_density(b.text) for b, x in zip(found, linked, strict=True)]
    counted = [(len(b.text), d) for b, d in zip(found, told, strict=True) if d is not None and not b.marked]
    known = 2 * sum(n for n, d in counted if d >= STOP_HIGH) >= sum(n for n, _ in counted)
    out: list[bool | None] = []
    for b, link, density in zip(found, linked, told, strict=True):
        label: bool | None = None
        if link:
            label = False
        elif density is not None and not b.heading:
            label = True if not known or density >= STOP_HIGH else None if len(b.text) < LONG else density >= STOP_LOW
        if b.bad:
            label = False
        elif b.good and link:
            label = None if len(b.text) < SHORT else False
        elif b.good and density is not None and not b.heading:
            label = True if label is None else label or None
        out.append(label)
    return out


def decided(found: list[Block]) -> list[bool | None]:
    """Pass one, and of pass two the ambiguous blocks of articles."""
    first = classes(found)
    inside = [i for i, b in enumerate(found) if b.good and not b.bad]
    before: list[bool | None] = [None] * len(found)
    after = list(before)
    for order, near in ((inside, before), (inside[::-1], after)):
        last = None
        for i in order:
            near[i] = last
            last = last if first[i] is None else first[i]
    for i in inside:
        if first[i] is None:
            b = found[i]
            doubtful = b.link_chars > MAX_LINKS * len(b.text) or (len(b.text) >= SHORT and not b.heading)
            sides = (before[i] is not False, after[i] is not False)
            first[i] = all(sides) if doubtful else any(sides)
    return first


def labels(found: list[Block], first: list[bool | None] | None = None) -> list[bool]:
    """Whether each block belongs to the main text."""
    first = decided(found) if first is None else first
    n = len(first)
    tells = [x is not None and not b.marked for b, x in zip(found, first, strict=True)]
    before: list[int] = [-1] * n
    after: list[int] = [n] * n
    for i in range(1, n):
        before[i] = i - 1 if tells[i - 1] else before[i - 1]
    for i in range(n - 2, -1, -1):
        after[i] = i + 1 if tells[i + 1] else after[i + 1]
    out = []
    for i, label in enumerate(first):
        if label is None:
            prev = first[before[i]] if before[i] >= 0 else None
            nxt = first[after[i]] if after[i] < n else None
            if prev is None or nxt is None:
                label = bool(prev if nxt is None else nxt)
            elif prev == nxt:
                label = prev
            elif i - before[i] != after[i] - i:
                label = prev if i - before[i] < after[i] - i else nxt
            else:
                label = bool(nxt) if found[i].heading else False
        out.append(bool(label))
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    first = decided(found)
    keep = labels(found, first) if True in first else [x is None for x in first]
    return " ".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, *, html_column: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``."""

    def start():
        def run(texts):
            out = [main_text(t) for t in texts]
            return [out, list(map(len, out))]

        return run

    return map_texts(tidy(pages, html_column), start, "text string, n_chars long", text=html_column)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tidy(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
