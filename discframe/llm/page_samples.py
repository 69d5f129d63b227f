"""A small labelled table: sample pages whose main text is marked by the attribute ``keep``."""

import random

LONG = (
    "The ferry leaves the old harbour at seven and needs most of an hour to cross, because the channel bends around two "
    "islands and the pilot keeps well clear of the sandbanks that move with every storm."
)
MIDDLE = "Rain came over the hills before noon, and the market closed an hour early."
SHORT = "Nobody came."

SAMPLES = [
    # A page of semantic elements.
    f"""<html><head><title>Harbour</title><style>p {{}}</style></head><body>
    <header><h1>Daily News</h1><p>News for the whole coast</p></header>
    <nav><ul><li><a href=/>Home</a></li><li><a href=/s>Sport</a></li><li><a href=/w>Weather today</a></li></ul></nav>
    <div class="ad">{SHORT}</div><div class="ad banner">{MIDDLE} {LONG}</div>
    <article><h1 keep>The morning ferry</h1><p keep>{LONG}</p><p keep>{SHORT}</p><p keep>Yes.</p>
    <h2 keep>Weather</h2><p keep>{MIDDLE}</p><ul><li keep>Oars</li><li keep>Ropes and lines</li></ul>
    <p keep><a href=/more>Read the whole timetable here</a></p><p keep>{LONG} {LONG}</p></article>
    <footer><p>&copy; Daily News. All rights reserved.</p><p>{MIDDLE}</p></footer></body></html>""",
    # The same without end tags, and an advert right before the article.
    f"""<html><body><nav><ul><li><a href=/a>{SHORT}</a><li><a href=/b>Boats</a></ul></nav>
    <div class="ad">{LONG}</div><article><h1 keep>{MIDDLE}</h1><p keep><b>{LONG}<br><p keep>{SHORT}<p keep>{MIDDLE}
    </article><footer>&copy; m.example.net &middot; {MIDDLE}</footer>""",
    f"""<body><nav><a href=/x>One</a> <a href=/y>Two</a></nav><article><h1 keep>Ice</h1><p keep>{LONG} {LONG}</p>
    <p keep>Ice.</p></article><footer>{LONG}</footer></body>""",
    # Things that stand inside an article and are none of it.
    f"""<body><article><header><h1 keep>{MIDDLE}</h1></header><p keep>{LONG}</p>
    <div class="advertisement">{MIDDLE}</div><div class="ad">{SHORT}</div><aside><p>{LONG}</p><p>{SHORT}</p></aside>
    <p keep>{SHORT}</p><form><label>Your mail address</label><p>{MIDDLE}</p></form>
    <div class="newsletter-signup"><p>{MIDDLE}</p></div><div class="related"><ul><li><a href=/r>{MIDDLE}</a></li></ul></div>
    <p keep>{MIDDLE}</p><div class="share"><a href=/f>Share</a></div><nav><a href=/n>Next page</a></nav>
    <footer>{MIDDLE}</footer></article>
    <section id="comments"><h2>Three comments</h2><div class="comment"><p>{MIDDLE}</p></div>
    <div class="comment"><p>{LONG}</p></div><article class="comment"><p>{LONG} {LONG}</p><p>{SHORT}</p></article></section></body>""",
    # Generic elements with telling names.
    f"""<body><div id="header"><p>{MIDDLE}</p></div><div class="menu"><ul><li><a href=/1>Start</a></li><li>Boats</li></ul></div>
    <div class="cookie-notice"><p>{LONG}</p></div><div id="content"><h1 keep>Nets</h1><p keep>{LONG}</p><p keep>{SHORT}</p>
    <table><tr><td keep>Nets</td><td keep>Forty</td></tr></table><blockquote><p keep>{MIDDLE}</p></blockquote></div>
    <div class="sidebar"><h3>Popular</h3><p>{LONG}</p><p>{MIDDLE}</p></div>
    <div class="comments"><p>{LONG}</p></div><div id="footer"><p>{LONG}</p></div></body>""",
    f"""<body><div class="topbar">{SHORT}</div><main><h1 keep>{SHORT}</h1><p keep>{LONG}</p><p keep>{MIDDLE}</p>
    <p keep>{SHORT}</p></main><aside><p>{LONG} {LONG}</p></aside><div role="contentinfo"><p>{MIDDLE}</p></div>
    <div class="popup"><p>{MIDDLE}</p><form><p>{SHORT}</p></form></div></body>""",
    f"""<body><div class="page"><div class="post"><h2 keep>{MIDDLE}</h2><div class="entry-content"><p keep>{LONG}</p>
    <p keep>{SHORT}</p><div class="promo">{MIDDLE}</div><p keep>{LONG}</p></div></div>
    <div class="widget"><p>{LONG}</p></div><div class="disclaimer-footer">{LONG}</div></div></body>""",
    # Nothing tells; words and links decide.
    f"""<body><div><a href=/>Home</a> | <a href=/b>Boats</a> | <a href=/n>Nets</a></div><h1 keep>{MIDDLE}</h1>
    <p keep>{LONG}</p><p keep>{LONG} {MIDDLE}</p><p keep>{LONG}</p><div><a href=/c>Contact us</a></div><div>2021</div></body>""",
    f"""<body><div>Menu</div><div><a href=/t>Today</a></div><div keep>{LONG} {LONG}</div><div keep>{LONG}</div>
    <div><a href=/p>Privacy</a> <a href=/i>Imprint</a></div></body>""",
    f"""<body><p keep>{LONG}</p><p keep>{LONG} {LONG}</p></body>""",
    # An article beside long text that is none of it.
    f"""<body><div class="notice"><p>{LONG}</p></div><div><p>{LONG} {LONG}</p></div><article><p keep>{SHORT}</p><p keep>{MIDDLE}</p>
    <p keep>{LONG}</p></article><div><p>{MIDDLE}</p></div><section class="comments"><p>{LONG}</p></section></body>""",
    f"""<body><section class="hero banner"><p>{MIDDLE}</p></section><div class="article"><h1 keep>Tides</h1><p keep>{MIDDLE}</p>
    <p keep>{SHORT}</p></div><div class="subscribe"><p>{LONG}</p></div><div class="search"><p>{SHORT}</p></div></body>""",
    # Telling names of main text inside parts that are none.
    f"""<body><main><article><h1 keep>Buoys</h1><div class="content"><p keep>{LONG}</p><p keep>{SHORT}</p></div></article>
    <section class="comments"><div class="content"><p>{LONG}</p><p>{SHORT}</p></div><article><p>{MIDDLE}</p></article></section></main>
    <aside><div class="text"><p>{LONG}</p></div><article><p>{MIDDLE}</p></article></aside>
    <footer><div class="content"><p>{LONG}</p></div><div id="main"><p>{MIDDLE}</p></div></footer>
    <form><div class="body"><p>{LONG}</p></div></form><div class="ad"><div class="content"><p>{LONG}</p></div></div>
    <nav><div class="main"><p>{LONG}</p></div></nav><div class="cookie"><div class="body"><p>{LONG}</p></div></div>
    <div hidden><div class="content"><p>{LONG}</p></div></div><p>{LONG}</p></body>""",
    # Wrappers with the name of some other part around the whole page, or around the article.
    f"""<body><div class="top"><nav><a href=/>Home</a></nav><article class="post category-more tag-sport"><h1 keep>{MIDDLE}</h1>
    <p keep>{LONG}</p><p keep>{SHORT}</p><div class="share"><a href=/f>Share</a></div><p keep>{LONG}</p></article>
    <div class="comments"><p>{LONG} {LONG}</p><p>{SHORT}</p></div></div></body>""",
    f"""<body><form id="form"><div class="menu"><a href=/1>Start</a></div><div id="content" class="with-sidebar social ad">
    <h2 keep>Ice</h2><p keep>{LONG}</p><p keep>{MIDDLE}</p><p keep>{SHORT}</p></div><aside><p>{LONG}</p></aside>
    <div class="ad">{MIDDLE}</div></form><footer>{MIDDLE}</footer></body>""",
    f"""<body><div class="thread"><div><a href=/>Home</a> | <a href=/b>Boats</a></div><h1 keep>{MIDDLE}</h1><p keep>{LONG}</p>
    <p keep>{LONG} {MIDDLE}</p><p keep>{LONG}</p><div><a href=/c>Contact us</a></div></div></body>""",
    f"""<body><div class="side"><main class="has-banner share-on"><p keep>{MIDDLE}</p><p keep>{LONG}</p><p keep>{SHORT}</p></main></div>
    <div class="tags"><p>{MIDDLE}</p></div></body>""",
]


def nameless(seed: int) -> str:
    """A page whose main text no name tells: links at its ends and between, text of all lengths."""
    rng = random.Random(seed)
    words = (LONG + " " + MIDDLE).replace(",", "").replace(".", "").lower().split()

    def text(low: int, high: int) -> str:
        return " ".join(rng.choices(words, k=rng.randint(low, high))).capitalize()

    def links(low: int, high: int) -> str:
        made = [f"<a href=/{i}>{text(1, 4)}</a>" for i in range(rng.randint(low, high))]
        kind = rng.randrange(3)
        if kind == 0:
            return f"<div>{rng.choice([' | ', ' ', ' - ']).join(made)}</div>"
        return "<ul>" + "".join(f"<li>{a}</li>" for a in made) + "</ul>" if kind == 1 else "".join(f"<div>{a}</div>" for a in made)

    def paragraph(low: int, high: int) -> str:
        body = text(low, high)
        if low > 20 and rng.random() < 0.2:
            body += f" <a href=/in>{text(1, 3)}</a> {text(5, 9)}"
        return f"<{block} keep>{body}.</{block}>"

    def other() -> str:
        """A part that says it is none of the text, however long."""
        if rng.random() < 0.75:
            return ""
        tag, name = rng.choice(
            [("nav", ""), ("header", ""), ("footer", ""), ("aside", ""), ("form", ""), ("div", " class=ad"), ("div", " class=comments"),
             ("div", " class=sidebar"), ("section", " id=cookie-notice"), ("div", " hidden"), ("div", " class=related-posts")]
        )
        return f"<{tag}{name}>" + "".join(f"<p>{text(*size)}</p>" for size in rng.choices([(1, 6), (7, 20), (22, 60)], k=2)) + f"</{tag}>"

    block = rng.choice(["p", "p", "p", "div"])
    page = other() + rng.choice(["", f"<div>{text(1, 4)}</div>"]) + links(2, 6) if rng.random() < 0.85 else ""
    page += f"<{(h := rng.choice(['h1', 'h1', 'h2', 'p']))} keep>{text(2, 9)}</{h}>"
    for _ in range(rng.randint(1, 7)):
        page += other() + paragraph(22, 60)
        for _ in range(rng.randrange(3)):
            page += paragraph(1, 9) if rng.random() < 0.7 else f"<h3 keep>{text(1, 5)}</h3>" + paragraph(10, 40)
        if rng.random() < 0.2:
            page += links(2, 4) + paragraph(22, 60)
    if rng.random() < 0.9:
        page += links(2, 5) + rng.choice(["", f"<div>{text(1, 5)}</div>", f"<div>{text(1, 3)}</div>" + links(2, 3)])
    page += other()
    wrapper = rng.choice(["", "<div>", '<div class="story-wrap">', "<div><div>", "<table><tr><td>", '<section class="c8">'])
    return f"<html><body>{wrapper}{page}</body></html>"


WRITTEN = list(SAMPLES)
SAMPLES += [nameless(seed) for seed in range(80)]
