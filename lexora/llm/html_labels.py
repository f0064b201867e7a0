"""The small labelled table of operator 7: written pages, and pages composed by rule, with a label (1: main text) for each text block in page order."""

import random
from collections.abc import Iterable

PAGES: list[tuple[str, list[int]]] = [
    ('<html><head><title>Rivers</title></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
     "<article><h1>Why rivers bend</h1><p>Water runs faster on the outer bank and takes soil with it, so a small turn grows.</p><p>Short.</p>"
     "<p>In time the loop closes and leaves a lake behind.</p></article><footer>&copy; 2020 River Post</footer></body></html>", [0, 0, 1, 1, 1, 1, 0]),
    ('<body><header><a href="/">The Daily Sheet</a></header><div class="ad">Buy two lamps and pay for one today only</div><article><h1>A lamp</h1>'
     '<p><b>It shines.<br><p>All night it stood in the window and lit the street below for the late walkers.</p></article><footer>Imprint and a longer text about our house, its owners and the many offices that we keep.</footer>', [0, 0, 1, 1, 1, 0]),
    ('<div id="sidebar"><h3>Popular</h3><p>Ten ways to boil an egg and what the neighbours said when they saw it</p></div><main><h2>Eggs</h2><p>Boil.</p>'
     '<p>Put the egg in water and wait <a href="/t">six minutes</a> or so.</p><div class="related"><p>See what our other readers liked in the week before this one.</p></div></main>', [0, 0, 1, 1, 1, 0]),
    ('<body><div class="cookie-notice"><p>We use small files on your machine to make this page work better for you and our partners.</p></div>'
     '<article><p>One.</p><p>The second line is a little longer than the first.</p><section class="comments"><h3>Comments</h3><p>I read this twice and liked the second line more than the first.</p></section></article>', [0, 1, 1, 0, 0]),
    ('<body><article><header><h1>Of bread</h1></header><p>Flour, water, salt and time.</p><form action="/s"><label>Your mail</label><p>Sign up here</p></form><aside><p>Bread was first baked long ago in a hot land.</p></aside>'
     "<p>Knead it well and let it rest.</p></article>", [1, 1, 0, 0, 0, 1]),
    ('<body><div class="menu"><a href="/1">One</a> <a href="/2">Two</a></div><div class="post-content"><h1>Boats</h1><p>A boat has a keel.</p><p>It may have a sail, and with a fair wind it needs no oars at all on the way home.</p></div>'
     '<div id="footer"><p>All rights reserved by the boat club of the town.</p></div>', [0, 1, 1, 1, 0]),
    ("<body><h1>No frame</h1><p>This page has no elements that say what is what, but this is a long run of plain words without any link in it, so it is the text.</p>"
     '<p><a href="/x">Next</a> <a href="/y">Back</a> <a href="/z">Top of the page</a></p>', [1, 1, 0]),
    ('<body><ul><li><a href="/1">Shop</a></li><li><a href="/2">About us</a></li></ul><div><p>The first thing that we saw when the door went open was a row of clocks, each with another time.</p><p>None was right.</p>'
     '<p>We took the smallest of them with us and set it by the bell of the church on the hill.</p></div><ul><li><a href="/3">Terms</a></li><li><a href="/4">Contact</a></li></ul>', [0, 0, 1, 1, 1, 0, 0]),
    ('<body><div id="breadcrumb"><a href="/">Start</a> / <a href="/h">House</a></div><article class="story"><p><a href="/who">All of this line is a link</a></p><p>Roofs are steep where snow falls.</p><ul><li>slate</li><li>straw</li></ul>'
     '<div class="share"><a href="/f">Share</a></div></article><div class="newsletter"><p>Get our best lines by mail each week, free of charge.</p></div>', [0, 1, 1, 1, 1, 0, 0]),
    ("<article><h1>Only a head</h1></article>", [1]),
    ("<body><p>Ti.</p></body>", [1]),
    ('<body><div class="banner">Sale</div><article><div class="ad">Cheap rope here</div><p>Rope is twisted.</p></article><div class="popup">Do you want to get news from us on this machine?</div><div role="navigation"><a href="/q">More</a></div>', [0, 0, 1, 0, 0]),
    ('<main><div class="sidebar"><p>Links of the week and the people who sent them in to us, with thanks.</p></div><article><h2>Glass</h2><p>Sand, melted.</p><blockquote>It is a slow liquid, they said.</blockquote><table><tr><td>Heat</td><td>1700</td></tr></table></article></main>', [0, 1, 1, 1, 1, 1]),
    ('<body><div id="content"><p>Wool.</p><p>It keeps warm when wet, and that is why sailors wore it on the long way north.</p></div><div id="comments"><p>Ann: my own coat is made of it and I am never cold.</p><p>Bob: nice</p></div>', [1, 1, 0, 0]),
]

_NOUNS = "harbour river stone garden letter market winter captain engine bridge window field teacher paper mountain village song table forest lamp".split()
_VERBS = "keeps follows opens carries finds leaves holds reaches turns meets builds covers".split()
_ADVERBS = "slowly again every year without a word in the evening near the old road for some time as before".split(" ")
BOILER = (
    "sidebar", "ad-slot", "cookie-banner", "newsletter-box", "comments", "comment-list", "related-posts", "breadcrumb", "site-footer", "main-nav", "sponsored", "promo-box", "popup-window", "pagination", "share-buttons sharing", "subscribe",
    "navMenu", "userComments", "relatedStories",
)
DOUBTFUL = ("side", "search", "login-form", "notice", "alert", "header", "toc", "social", "share", "legal", "skip-links", "widget", "rating", "form", "reply-box", "popular")
CONTENT = ("post-body", "entry-content", "story", "article-text", "main-content", "content", "prose")
BOTH = ("form-factor", "side-effects", "notice-period", "search-party", "legal-history", "social-life", "header-image-story", "box", "list", "share-of-land", "alert-level")


def _sentence(rng: random.Random, n: int) -> str:
    out = []
    while len(out) < n:
        out += ["the", rng.choice(_NOUNS), rng.choice(_VERBS), "the", rng.choice(_NOUNS), rng.choice(_ADVERBS)]
    text = " ".join(out[:n])
    return text[0].upper() + text[1:] + "."


def composed(numbers: Iterable[int]) -> list[tuple[str, list[int]]]:
    """A page for each number, always the same: articles in semantic, named and bare frames, among boilerplate as links and as prose."""
    pages = []
    for number in numbers:
        rng = random.Random(number)
        html: list[str] = []
        labels: list[int] = []

        def links(k: int, tag: str) -> None:
            for _ in range(k):
                html.append(f'<{tag}><a href="/{rng.choice(_NOUNS)}">{" ".join(rng.sample(_NOUNS, rng.choice((1, 1, 2, 3, 5, 8, 12))))}</a></{tag}>')
                labels.append(0)

        def prose(label: int, low: int, high: int) -> None:
            text = _sentence(rng, rng.randint(low, high))
            if label and rng.random() < 0.25:
                words = text.split(" ")
                k = rng.randrange(len(words))
                words[k] = f'<a href="/x">{words[k]}</a>'
                text = " ".join(words)
            html.append(f"<p>{text}</p>")
            labels.append(label)

        def boiler(name: str) -> None:
            tag = rng.choice((f'div class="{name}"', f'section id="{name}"'))
            html.append(f"<{tag}>")
            if rng.random() < 0.5:
                links(rng.randint(1, 5), rng.choice(("li", "p", "div")))
            else:
                for _ in range(rng.randint(1, 3)):
                    prose(0, 4, 40)
            html.append(f"</{tag.split(' ')[0]}>")

        def doubtful(name: str) -> None:
            html.append(f'<div class="{name}">')
            if rng.random() < 0.6:
                links(rng.randint(1, 4), "li")
            else:
                prose(0, 2, 6)
            html.append("</div>")

        def body(frame: str) -> None:
            if rng.random() < 0.8:
                html.append(f"<h1>{_sentence(rng, rng.randint(2, 8))}</h1>")
                labels.append(1)
            for k in range(rng.randint(2, 6)):
                if frame != "bare" and rng.random() < 0.15:
                    html.append(f'<div class="{rng.choice(BOTH)}">')
                    prose(1, 14, 60)
                    html.append("</div>")
                elif rng.random() < 0.15 and k:
                    boiler(rng.choice(BOILER))
                elif rng.random() < 0.12 and k:
                    tag = rng.choice(("nav", "aside", "form", "footer"))
                    html.append(f"<{tag}>")
                    links(rng.randint(1, 4), "li") if rng.random() < 0.6 else prose(0, 4, 40)
                    html.append(f"</{tag}>")
                elif rng.random() < 0.06 and k:
                    doubtful("toc")
                else:
                    prose(1, 2 if frame != "bare" else 9, 60)

        frame = ("semantic", "named", "bare", "both")[number % 4]
        html.append("<html><body>")
        if frame == "bare" or rng.random() < 0.5:
            html.append("<ul>" if frame == "bare" else "<nav>")
            links(rng.randint(2, 6), "li")
            html.append("</ul>" if frame == "bare" else "</nav>")
        for _ in range(rng.randint(0, 2)):
            boiler(rng.choice(BOILER)) if rng.random() < 0.6 else doubtful(rng.choice(DOUBTFUL))
        opened, closed = {"semantic": ("<article>", "</article>"), "named": (f'<div class="{rng.choice(CONTENT)}">', "</div>"), "bare": ("<div>", "</div>"), "both": (f'<main class="{rng.choice(CONTENT)}"><article class="{rng.choice(BOTH)}">', "</article></main>")}[frame]
        html.append(opened)
        body(frame)
        html.append(closed)
        for _ in range(rng.randint(0, 3)):
            boiler(rng.choice(BOILER)) if rng.random() < 0.6 else doubtful(rng.choice(DOUBTFUL))
        if rng.random() < 0.6:
            html.append("<footer>")
            prose(0, 3, 30)
            html.append("</footer>")
        if frame == "bare":
            html.append("<ul>")
            links(rng.randint(2, 4), "li")
            html.append("</ul>")
        html.append("</body></html>")
        pages.append(("".join(html), labels))
    return pages
