"""Main text of pages: exact on clean templates, and sane on broken ones."""

import html
import re
import sys

import pytest

from discframe.llm import pages, queries
from discframe.llm.page_samples import LONG, MIDDLE, SAMPLES, WRITTEN, nameless


@pytest.fixture(scope="module")
def tree():
    return pages.trained()


def misses(tree, samples):
    wrong = total = 0
    for sample in samples:
        found = pages.blocks(sample)
        total += len(found)
        wrong += sum(pages.decide(tree, row) != b.keep for b, row in zip(found, pages.table(found)))
    return wrong / total


def test_training_pages_are_learnt(tree):
    for sample in WRITTEN:
        found = pages.blocks(sample)
        assert [b.text for b, row in zip(found, pages.table(found)) if pages.decide(tree, row)] == [b.text for b in found if b.keep]
    assert misses(tree, SAMPLES) <= 0.005


def test_left_out_samples():
    """Ten folds: every page is judged by a tree that has not seen it."""
    wrong = [misses(pages.trained([x for i, x in enumerate(SAMPLES) if i % 10 != f]), SAMPLES[f::10]) for f in range(10)]
    assert sum(wrong) / len(wrong) < 0.05


def test_new_pages_without_names(tree):
    assert misses(tree, [nameless(seed) for seed in range(1000, 1200)]) < 0.03


def features(tree):
    return {pages.FEATURES[tree[0]]} | features(tree[2]) | features(tree[3]) if isinstance(tree, tuple) else set()


def test_words_and_densities_decide(tree):
    used = features(tree)
    assert "density" in used and "words" in used
    assert used & {"density_before", "density_after"} and used & {"words_before", "words_after"}


@pytest.mark.parametrize("opening", ["<div>", '<div class="story-wrap">', "<section>", ""])
def test_short_blocks_without_names(tree, opening):
    text = f"<h1>Ice on the river</h1><p>{LONG}</p><p>Short one.</p><p>{LONG} {MIDDLE}</p><p>Yes.</p><p>{LONG}</p>"
    top = "<div><a href=/>Home</a> | <a href=/b>Boats</a> | <a href=/n>Nets</a></div>"
    bottom = "<ul><li><a href=/c>Contact us</a></li><li><a href=/i>Imprint</a></li></ul>"
    got = pages.main_text(f"<body>{opening}{top}{text}{bottom}</body>", tree)
    assert got.split("\n") == ["Ice on the river", LONG, "Short one.", f"{LONG} {MIDDLE}", "Yes.", LONG]


def test_apostrophes_outside_quotes(tree):
    page = f"<article><a href=/x title=O'Brien>Link</a><p>{LONG}</p><p>We don't. {MIDDLE}</p></article>"
    assert pages.main_text(page, tree).split("\n") == ["Link", LONG, f"We don't. {MIDDLE}"]
    assert pages.main_text(f"<article><p class=it's>{LONG}</p><p>We don't.</p></article>", tree) == f"{LONG}\nWe don't."
    assert pages.main_text(f"<article><p title='a > b' class=\"c'd\">{LONG}</p></article>", tree) == LONG


@pytest.mark.parametrize("page", ["<div>{n}</b>", "<b>{n}<p>x</p>", "<div>x{n}", "<svg>{n}</svg>", "<li><b>{n}</i>", "<button>{n}x"])
def test_reading_is_linear(page):
    one, two = page.split("{n}")

    def steps(n):
        count = 0

        def seen(frame, event, arg):
            nonlocal count
            count += event == "line"
            return seen

        sys.settrace(lambda frame, event, arg: seen if frame.f_code.co_filename == pages.__file__ else None)
        try:
            pages.blocks(one * n + two * n)
        finally:
            sys.settrace(None)
        return count

    assert steps(400) < 4.6 * steps(100)


def test_blocks(tree):
    page = (
        "<!DOCTYPE html><html><head><title>T</title><script>var t='</p><article>';</script><style>p{}</style></head><body>"
        "<nav><a href='/a>b'>Home</a></nav><!-- <p>no</p> --><article class=post><h1>A &amp; B&nbsp;&#67;</h1>"
        "<p>one <b>two</b>\n three<br>four<p>five<ul><li>six<li>seven</ul><div class='ad'>buy</div>a < b</article>"
        "<div id=comments><p>first!</p></div><footer>end</footer>"
    )
    assert pages.main_text(page, tree).split("\n") == ["A & B C", "one two three four", "five", "six", "seven", "a < b"]


@pytest.mark.parametrize("page", [None, "", "<", "<p", "</p>", "<p>", "<!--", "<script>", "<a href=\"", "plain", "<<<>>>", "<p>" * 5000])
def test_broken_pages(tree, page):
    assert isinstance(pages.main_text(page, tree), str)


def test_operator(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "x")] * 2 + [(None, None, None, "x"), (3, "u", "", "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = pages.main_texts(frame).collect()
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in got) == sorted(
        [("1", LONG, len(LONG))] * 2 + [("None", "", 0), ("3", "", 0)]
    )
    assert pages.main_texts(frame.limit(0)).collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = queries.QUERIES["op2_html_extraction"](spark, folder).collect()
    assert len(got) == len(source)
    for r in got:
        body = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", source[r["page_id"]], re.DOTALL)[1]
        body = re.sub(r"</?(?:p|h1)>", "\0", re.sub(r"</?b>", "", body.replace("<br>", " ")))
        want = [" ".join(html.unescape(x).split()) for x in body.split("\0")]
        assert r["text"] == "\n".join(x for x in want if x)
        assert r["n_chars"] == len(r["text"])


@pytest.mark.parametrize(
    "attributes",
    ['aria-hidden="false"', 'data-hidden="0"', 'title="the hidden valley"', 'data-id="comments-3"', 'data-href="/a?id=comment"',
     "data-url=/a?class=ad", "title='style=display:none'", 'data-style="display:none"', 'data-x="a" data-class="ad"', "hidden-at=1"],
)
def test_only_whole_attribute_names_count(tree, attributes):
    page = f"<article><h1>Ice</h1><p>{LONG}</p><p>{LONG}</p></article>"
    assert pages.main_text(page.replace("<article", f"<article {attributes}"), tree) == pages.main_text(page, tree) != ""
    assert pages._kinds("div", f" {attributes}") == ("", False)


@pytest.mark.parametrize("attributes", ["hidden", 'HIDDEN=""', "aria-hidden=true", 'title="x"hidden', "style='a:b; display : none'"])
def test_hiding_attributes(tree, attributes):
    assert pages._kinds("div", f" {attributes}") == ("hidden", False)
    page = f"<article><p>{LONG}</p><div {attributes}><p>{LONG} {LONG}</p></div></article>"
    assert pages.main_text(page, tree) == LONG


@pytest.mark.parametrize(
    ("middle", "inside"),
    [
        ('<svg class="i"/>', ""), ("<math/>", ""), ('<svg><path d=""/><title/></svg>', ""), ("<svg><g><text>x</text></g></svg>", ""),
        ("<datalist id=d><option value=a><option value=b>B</datalist>", ""), ("<select><option>A<option>B</select>", ""),
        ("<button><div>Go</div></button>", ""), ("<canvas><p>old</p></canvas>", ""), ("<object><object>a</object><p>b</p></object>", ""),
        ("<button>Go", "Go"), ("<object data=x>", ""), ("<canvas>", ""), ("<select><option>A", ""), ("<option>A", ""),
        ("<button>Go<p>Half.</p><button>Stop</button>", "Go Half."), ("<noscript>", ""), ("<template>", ""),
    ],
)
def test_elements_without_text_end_where_they_end(middle, inside):
    got = [b.text for b in pages.blocks(f"<p>One.</p>{middle}<p>Two.</p><svg></svg><div>Three.</div>")]
    assert " ".join(got).split() == f"One. {inside} Two. Three.".split()
    if not middle.endswith("<option>A"):  # whose text goes on to the next block
        inline = [b.text for b in pages.blocks(f"<div><p>One {middle} two.</p></div><p>Three.</p>")]
        assert " ".join(inline).split()[0] == "One" and " ".join(inline).split()[-2:] == ["two.", "Three."]


def test_head_without_end_tag():
    assert [b.text for b in pages.blocks("<html><head><title>T</title>\n<body><p>One.</p>")] == ["One."]


ARTICLE = f"<h1>Ice on the river</h1><p>{LONG}</p><p>Nobody came.</p><p>{LONG} {LONG}</p>"


@pytest.mark.parametrize(
    "opening",
    ['<article class="post category-more tag-sport">', '<div id="content" class="with-sidebar">', '<main class="has-banner share-on">',
     '<article class="top">', '<article class="thread ad">', '<div class="content social">', '<div class="more"><article>',
     *[f'<div class="{x}"><article>' for x in ("top", "form", "side", "tags", "social", "ad", "thread")],
     *[f'<div class="{x}"><div id="content">' for x in ("top", "form", "side", "tags", "social", "ad", "thread")], "<form><main>"],
)
def test_names_of_wrappers_do_not_lose_the_article(tree, opening):
    ends = "".join(f"</{tag}>" for tag in reversed(re.findall(r"<(\w+)", opening)))
    page = f'<body><nav><a href="/">Home</a></nav>{opening}{ARTICLE}{ends}<div class="ad"><p>{LONG}</p></div><footer>{LONG}</footer></body>'
    assert pages.main_text(page, tree) == f"Ice on the river\n{LONG}\nNobody came.\n{LONG} {LONG}"


@pytest.mark.parametrize("part", ["ad", "comments", "comment-list", "cookie_notice", "widget-3", "related-posts", "newsletter-signup"])
def test_parts_stay_out_however_long(tree, part):
    other = f'<div class="{part}"><p>{LONG} {LONG} {LONG}</p><article class="comment"><p>{LONG} {LONG}</p></article></div>'
    for page in (f"<article>{ARTICLE}</article>{other}", f"<div class=thread><article>{ARTICLE}</article>{other}</div>"):
        assert pages.main_text(page, tree) == f"Ice on the river\n{LONG}\nNobody came.\n{LONG} {LONG}"
