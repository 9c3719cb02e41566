"""Main text of generated pages, whose true text is known."""

import html
import random

import pytest

from skytable.llm.html_text import main_text

WORDS = "the river bends around an old mill where people once ground their corn & sang <songs> about weather, tides and bread".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def build(seed):
    rng = random.Random(seed)
    truth, body = [], []

    def block(tag, text, attrs=""):
        truth.append(text)
        close = "" if tag in ("p", "li") and rng.random() < 0.3 else f"</{tag}>"
        spaced = html.escape(text).replace(" ", rng.choice([" ", "\n  ", " <b>", "  "]), 1)
        body.append(f"<{tag}{attrs}>{spaced}{close}")

    shape = rng.choice(["article", "main", "div", "wrapped", "late"])
    heading = sentence(rng, 4)
    if shape != "late":
        block("h1", heading)
    for _ in range(rng.randrange(3, 7)):
        block("p", sentence(rng, rng.randrange(40, 90)))
        if rng.random() < 0.4:
            block("h2", sentence(rng, 3))
            block("p", sentence(rng, 50))
        if rng.random() < 0.3:
            body.append(rng.choice(['<aside>Read this as well</aside>', '<div class="ad-slot">Buy now, it is cheap</div>', "<script>var x = '<p>no</p>';</script>", "<form><input><button>Send</button></form>"]))
        if rng.random() < 0.3:
            body.append("<ul>")
            block("li", sentence(rng, 3))
            block("li", sentence(rng, 2))
            body.append("</ul>")
    block("p", "Short end.")
    inner = "".join(body)
    comment = f"<p>{html.escape(sentence(rng, 60))}</p>"
    comments = rng.choice([
        "", f'<div id="comments"><article class="comment">{comment}</article><article>{comment}</article></div>',
        f'<section class="comments-area"><h2>2 comments</h2>{comment}{comment}</section>', f'<ol class="comment-list"><li>{comment}</li></ol>',
    ])
    if shape == "article":
        content = f'<div class="{rng.choice(["content with-sidebar", "row", "no-comments"])}"><article class="post">{inner}{comments}</article></div>'
    elif shape == "main":
        content = f'<main class="has-sidebar"><div>{inner}</div>{comments}</main>'
    elif shape == "wrapped":
        content = f'<div class="sidebar layout"><main>{inner}</main></div>{comments}'
    elif shape == "late":
        truth.insert(0, heading)
        content = f"<div><h1>{html.escape(heading)}</h1><article>{inner}</article></div>{comments}"
    else:
        content = f'<div class="page has-sidebar" id="text">{inner}</div>{comments}'
    menu = "".join(f"<li><a href='/{k}'>{sentence(rng, 2)}</a></li>" for k in range(rng.randrange(3, 9)))
    head = rng.choice([f"<header><h1>Site</h1><nav><ul>{menu}</ul></nav></header>", f'<div class="site-header">Site</div><div class="menu"><ul>{menu}</ul></div>'])
    side = rng.choice(["", f'<div class="sidebar"><p>{sentence(rng, 30)}</p></div>', f"<aside><p>{sentence(rng, 60)}</p></aside>", f'<div class="related-posts"><ul>{menu}</ul></div>'])
    notice = rng.choice(["", '<div class="cookie-banner">We use cookies. <button>Fine</button></div>'])
    foot = rng.choice(["<footer><p>Imprint and more of the same</p></footer>", f'<div id="footer"><a href="/i">Imprint</a> {sentence(rng, 12)}</div>'])
    page = f"<!doctype html><html><head><title>{sentence(rng, 3)}</title><style>p {{ color: red }}</style></head><body>{notice}{head}{content}{side}{foot}</body></html>"
    return page, "\n\n".join(" ".join(t.split()) for t in truth)


@pytest.mark.parametrize("seed", range(120))
def test_generated_page(seed):
    page, truth = build(seed)
    assert main_text(page) == truth


@pytest.mark.parametrize(
    "name,kept", [("comments", False), ("comment-12", False), ("no-comments", True), ("sidebar", False), ("has-sidebar", True), ("site-header", False), ("entry-header", True), ("search-results", True), ("sidebarless", True), ("admin", True), ("ad", False)]
)
def test_names_are_whole_words(name, kept):
    text = " ".join(["words of a long paragraph"] * 20)
    assert main_text(f'<body><div><p>{text}</p><div class="{name}"><p>{text} too</p></div></div></body>') == (f"{text}\n\n{text} too" if kept else text)
