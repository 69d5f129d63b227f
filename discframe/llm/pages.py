"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is read once, tag by tag, into blocks: runs of text between block-level tags.  Each
block has its word count and link density, those of its two neighbours on either side, and what
the tags around it say (article, menu, advert and so on, by element name or whole class names; a
part that holds most of a page is a wrapper, whatever its name).  A tree is grown on the blocks
of labelled sample pages (:data:`SAMPLES`), where the attribute ``keep`` marks the main text;
blocks that the tree takes for main text are joined.  Where names say nothing, which is what half
of the samples are about, word counts and densities decide: a short block between long unlinked
ones is text, beside links it is not.

Scripts, styles, comments, heads and form controls hold no text.  Character references are
decoded, white space inside a block becomes one blank.  Broken pages (unclosed or misnested
tags, missing ends) give the text that was there.  A null or empty page has no text.  Very long
and deeply nested pages are read in one pass whose time follows their length.  Rows are
independent, repeated ones too; an empty table gives no rows; other columns are not read,
whatever they are called.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from discframe.llm.common import id_field

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*)(?:>|\Z)""", re.DOTALL
)
#: One attribute of a tag: its whole name and, if it has one, its value with the quotes.
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")

NUMBER = re.compile(r"-?[0-9]+\Z")

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
#: Elements that hold markup, but no text of the page.
MUTE = frozenset("head svg math select datalist option button object canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag of the key closes an open tag of the values.
CLOSES = {
    "p": {"p"},
    "li": {"li", "p"},
    "dt": {"dt", "dd", "p"},
    "dd": {"dt", "dd", "p"},
    "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"},
    "th": {"td", "th", "p"},
    "option": {"option"},
    "optgroup": {"option"},
    "button": {"button"},
    "select": {"select", "option"},
    "body": {"head", "p"},
} | {tag: {"p"} for tag in BLOCK if tag not in ("p", "li", "dt", "dd", "tr", "td", "th", "body")}
#: Elements at which the search for one to close may end.
MARKED = BLOCK | MUTE | {"optgroup"}
# The end tags of an option and of the head may be missing.
CLOSES |= {tag: gone | {"option", "head"} for tag, gone in CLOSES.items() if tag in BLOCK}

#: Whole class, id or role names (``_`` read as ``-``, a number at the end ignored), by what
#: they say about the text inside.
HINTS = {
    "menu": "nav navbar nav-bar menu main-nav main-menu nav-menu site-nav navigation main-navigation site-navigation "
    "post-navigation nav-links breadcrumb breadcrumbs pagination page-numbers pager toc tabs toolbar skip skip-link",
    "frame": "header masthead footer banner top bottom copyright legal imprint contentinfo site-header page-header "
    "site-footer page-footer disclaimer-footer footer-widgets",
    "side": "sidebar side-bar aside side rail widget widget-area related related-posts related-articles related-links "
    "recommended recommend recommended-posts popular popular-posts trending more read-more tags tag-list post-tags share "
    "share-buttons social social-links social-share complementary",
    "notice": "cookie cookie-notice cookie-banner cookie-bar cookie-consent consent notice alert gdpr popup modal overlay toast "
    "newsletter newsletter-signup newsletter-form subscribe signup sign-up email-signup login paywall promo",
    "advert": "ad ads ad-banner ad-box ad-container ad-slot ad-unit ad-wrapper advert adverts advert-box advertisement sponsor "
    "sponsored sponsored-content sponsor-box promoted adbox adsense google-ad commercial",
    "comment": "comment comments comment-body comment-content comment-list comment-text comments-area comments-list "
    "comments-section respond comment-respond comment-form reply replies disqus discussion thread",
    "form": "form search searchbox search-form contact-form login-form",
    "main": "article post blog-post entry content main main-content page-content story body text articlebody article-body "
    "article-content article-text body-content body-text entry-body entry-content post-body post-content post-text story-body",
}
#: Names that an article of a reader has.
REMARKS = frozenset("comment comments comment-body reply replies".split())
#: A part named by a class holds the page, and says nothing of it, from this share of its words on.
WIDE = 0.5
HINT_OF = {word: kind for kind, words in HINTS.items() for word in words.split()}
TAG_KIND = {
    "nav": "menu", "menu": "menu", "header": "frame", "footer": "frame", "aside": "side", "dialog": "notice",
    "form": "form", "fieldset": "form", "article": "main", "main": "main",
}
#: Elements that are none of the main text, however much they hold.
SURE = frozenset("nav menu header footer aside dialog".split())
FEATURES = (
    "outside", "frame", "in_main", "has_main", "wrapped", "heading", "item",
    "words", "density", "words_before", "density_before", "words_after", "density_after",
    "words_before_that", "density_before_that", "words_after_that", "density_after_that",
)


@dataclass
class Block:
    text: str
    words: int
    density: float
    tag: str
    #: Place in the page and kind of the elements that say something; whether they surely do.
    around: tuple[tuple[int, str, bool], ...]
    keep: bool

    @property
    def kinds(self) -> tuple[str, ...]:
        return tuple(kind for _, kind, _ in self.around)


def _hides(name: str, value: str) -> bool:
    """Whether an attribute hides its element (``hidden`` does with any value but one)."""
    if name == "hidden":
        return value.strip() != "until-found"
    if name == "aria-hidden":
        return value.strip() == "true"
    return name == "style" and re.search(r"(?<![\w-])display\s*:\s*none", value) is not None


def _kinds(tag: str, attributes: str) -> tuple[str, bool]:
    """What an element says about its text (or nothing), and whether it is marked.

    A name of main text wins over other names of the same element, and an article or main
    element over all of them, but for the names of readers' remarks.
    """
    own, keep, hidden = TAG_KIND.get(tag, ""), False, False
    said: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "keep":
            keep = True
        elif _hides(name, value):
            hidden = True
        elif name in ("class", "id", "role") and tag not in ("html", "body"):
            for token in value.split():
                token = NUMBER.sub("", re.sub("[_-]+", "-", token))
                if token in HINT_OF:
                    said[token] = HINT_OF[token]
    if hidden:
        return "hidden", keep
    other = [kind for kind in said.values() if kind != "main"]
    if own == "main":
        remark = tag == "article" and len(other) == len(said) and not REMARKS.isdisjoint(said)
        return "comment" if remark else "main", keep
    if own:
        return other[-1] if other else own, keep
    return "main" if len(other) < len(said) else other[-1] if other else "", keep


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in page order."""
    found, unclosed = _read(page or "", frozenset())
    # What is never closed hides nothing, as nobody can say where it ends.
    return _read(page or "", unclosed)[0] if unclosed else found


def _read(page: str, open_ended: frozenset[int]) -> tuple[list[Block], frozenset[int]]:
    """The blocks, and the places of :data:`MUTE` elements without an end of their own;
    those at the places *open_ended* are read like any other element."""
    out: list[Block] = []
    # Name, kind, mark and place of the open elements; whether they are mute, and how many
    # of those below are.
    stack: list[tuple[str, str, bool, int, bool, int]] = []
    # The same by what is asked of them: how many of a name, places in the stack, blocks, kinds.
    named: Counter[str] = Counter()
    marks: list[int] = []
    tags: list[str] = []
    around: list[tuple[int, str, bool]] = []
    parts: list[str] = []
    unclosed: set[int] = set()
    endless: set[str] = set()
    linked = 0
    links = mute = kept = 0

    def flush():
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            words = text.count(" ") + 1
            out.append(Block(text, words, min(1.0, linked / words), tags[-1] if tags else "", tuple(around), kept > 0))
        linked = 0

    def open_(tag: str, attributes: str, place: int, silent: bool):
        nonlocal links, mute, kept
        kind, keep = _kinds(tag, attributes)
        stack.append((tag, kind, keep, place, silent, mute))
        named[tag] += 1
        if tag in MARKED:
            marks.append(len(stack) - 1)
        if tag in BLOCK:
            tags.append(tag)
        if kind:
            around.append((place, kind, tag in SURE or kind == "hidden"))
        links += tag == "a"
        mute += silent
        kept += keep

    def close(i: int, own: bool):
        """Ends the open elements from *i* on; *own* by the end tag of the first of them."""
        nonlocal links, mute, kept
        for at, (name, kind, keep, place, silent, _) in enumerate(stack[i:], i):
            named[name] -= 1
            links -= name == "a"
            mute -= silent
            kept -= keep
            if name in MARKED:
                marks.pop()
            if name in BLOCK:
                tags.pop()
            if kind:
                around.pop()
            if silent and name != "option" and not (own and at == i):
                unclosed.add(place)
        del stack[i:]

    at, end = 0, len(page)
    while at < end:
        start = page.find("<", at)
        if start < 0:
            start = end
        found = TAG.match(page, start) if start < end else None
        stop = start if found or start == end else start + 1
        if stop > at and not mute:
            piece = page[at:stop]
            parts.append(piece)
            if links:
                linked += len(piece.split())
        if found is None:
            at = max(stop, at + 1)
            continue
        at = found.end()
        tag = (found[1] or "").lower()
        if not tag:
            continue
        if page[start + 1] == "/":
            if named[tag]:
                # What is searched here is closed, so the search is paid for once.
                i = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)
                if tag in BLOCK and not stack[i][5]:
                    flush()
                close(i, True)
            elif tag == "p" and not mute:
                flush()
            continue
        if tag in VOID:
            if tag in ("br", "hr", "img"):
                parts.append(" ")
            continue
        if page[at - 2 : at] == "/>" and (tag in ("svg", "math") or named["svg"] or named["math"]):
            parts.append(" ")
            continue
        if tag in RAW:
            # Raw text up to its own end tag, whatever stands inside.
            ended = None if tag in endless else re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            parts.append(" ")
            if ended:
                at = ended.end()
            elif tag in ("noscript", "template"):
                endless.add(tag)
            else:
                at = end
            continue
        for i in reversed(marks) if tag in CLOSES else ():
            if stack[i][0] in CLOSES[tag]:
                if tag in BLOCK and not stack[i][5]:
                    flush()
                # The end tag of the head may be missing, that of a button or select may not.
                close(i, stack[i][0] == "head")
                break
            if stack[i][0] in BLOCK or (stack[i][4] and stack[i][0] != "option"):
                break
        if tag in BLOCK and not mute:
            flush()
        silent = tag in MUTE and start not in open_ended
        if silent:
            parts.append(" ")
        open_(tag, found[2], start, silent)
    flush()
    close(0, False)
    return out, frozenset(unclosed)


def _wide(page_blocks: list[Block]) -> set[int]:
    """The places of wrappers: elements with the name of another part around most unlinked
    words of a page that has no main element outside such parts."""
    weight: Counter[int] = Counter()
    doubtful, total = set(), 0.0
    for b in page_blocks:
        own = b.words * (1 - b.density)
        total += own
        for place, kind, sure in b.around:
            weight[place] += own
            if kind != "main" and not sure:
                doubtful.add(place)
    wide: set[int] = set()
    # From the outermost: what stands beside the main element of a wrapper is no wrapper.
    for place in sorted(p for p in doubtful if weight[p] > WIDE * total):
        free = (b for b in page_blocks if all(kind == "main" or at in wide for at, kind, _ in b.around))
        if any("main" in b.kinds for b in free):
            break
        wide.add(place)
    return wide


def table(page_blocks: list[Block]) -> list[list[float]]:
    """One row of :data:`FEATURES` per block."""
    has_main = any("main" in b.kinds for b in page_blocks)
    wide = _wide(page_blocks)
    rows = []
    for i, b in enumerate(page_blocks):
        kinds = [kind for place, kind, _ in b.around if place not in wide]
        row = [
            any(k not in ("main", "frame") for k in kinds),
            "frame" in kinds,
            "main" in kinds,
            has_main,
            len(kinds) < len(b.around),
            b.tag in ("h1", "h2", "h3"),
            b.tag in ("li", "td", "th", "dt", "dd"),
            b.words,
            b.density,
        ]
        for near in (i - 1, i + 1, i - 2, i + 2):
            near = page_blocks[near] if 0 <= near < len(page_blocks) else None
            row += [near.words, near.density] if near else [0, 1.0]
        rows.append(row)
    return rows


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 1):
    """A decision tree by Gini impurity: ``(feature, threshold, left, right)`` or a share."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return share
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[:-1] + values[1:]) / 2:
            left = x[:, f] <= t
            n = left.sum()
            if n < least or len(y) - n < least:
                continue
            a, b = y[left].mean(), y[~left].mean()
            impurity = n * a * (1 - a) + (len(y) - n) * b * (1 - b)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, t)
    if best is None or best[0] >= len(y) * share * (1 - share) - 1e-12:
        return share
    _, f, t = best
    left = x[:, f] <= t
    return f, float(t), grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least)


def decide(tree, row: list[float]) -> bool:
    while isinstance(tree, tuple):
        f, t, low, high = tree
        tree = low if row[f] <= t else high
    return tree >= 0.5


def trained(samples: list[str] | None = None):
    """The tree grown on the labelled sample pages."""
    from discframe.llm.page_samples import SAMPLES

    marked = [blocks(page) for page in (SAMPLES if samples is None else samples)]
    x = np.array([row for b in marked for row in table(b)], float)
    y = np.array([b.keep for page in marked for b in page], float)
    # The first question is whether the page says where its main text is: beside a named
    # article a long paragraph is none of it, elsewhere it is what there is.
    named = FEATURES.index("has_main")
    said = x[:, named] > 0.5
    if said.all() or not said.any():
        return grow(x, y)
    return named, 0.5, grow(x[~said], y[~said]), grow(x[said], y[said])


def main_text(page: str | None, tree) -> str:
    found = blocks(page)
    rows = table(found)
    return "\n".join(b.text for b, row in zip(found, rows) if decide(tree, row))


def main_texts(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """*key*, *url*, ``text`` and ``n_chars`` (code points) of every row of *pages*."""
    tree = trained()
    schema = T.StructType(
        [id_field(pages, key), id_field(pages, url), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = [main_text(p.as_py(), tree) for p in batch.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    [key, url, "text", "n_chars"],
                )

    return pages.select(key, url, page).mapInArrow(extract, schema)
