"""Reading of pages against a plain reader made with the standard library's parser, nested layouts, and time on broken pages."""

import random
import time
from html import escape
from html.parser import HTMLParser

import pytest

from tracelens.llm import html_extraction
from tracelens.llm.html_extraction import main_text

BAD = ["nav", "header", "footer", "aside", "form", "script", "style", "button"]
BLOCK = ["p", "h1", "h2", "ul", "li", "blockquote", "div", "section", "article", "body", "html", "br", *BAD]


class Plain(HTMLParser):
    """Blocks of well-formed pages under the element with ``data-main``, boilerplate elements left out."""

    def __init__(self):
        super().__init__()
        self.blocks, self.text, self.stack = [], [], []

    def flush(self):
        whole = " ".join("".join(self.text).split())
        if whole:
            self.blocks.append(whole)
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
        if tag != "br":
            self.stack.append((tag, "data-main" in dict(attrs)))

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        if tag != "br":
            self.stack.pop()

    def handle_data(self, data):
        if any(m for _, m in self.stack) and not any(t in BAD for t, _ in self.stack):
            self.text.append(data)


def page(draw):
    word = lambda: draw.choice(["plain", "text", "a < b", "ä & ö", "wörter", "über", "x"])
    words = lambda n: escape(" ".join(word() for _ in range(n)))
    inline = lambda n: draw.choice([words(n), f"<b>{words(n)}</b> {words(2)}", f"{words(3)} <a href='/x'>{words(1)}</a> {words(n)}", f"{words(2)}<br>{words(2)}"])
    body = "".join(draw.choice(["<p>{}</p>\n", "<h2>{}</h2>", "<ul><li>{}</li><li>one more item</li></ul>", "<blockquote>{}</blockquote>", "<div class='part'>{}</div>", "<script>var x = '</p>';</script><p>{}</p>", "<aside>not this</aside><p>{}</p>"]).format(inline(draw.randrange(8, 40))) for _ in range(draw.randrange(4, 12)))
    menu = "".join(f"<li><a href='/{i}'>Menu entry {i}</a></li>" for i in range(8))
    return f"<!doctype html><html><head><title>T</title></head><body><header><nav><ul>{menu}</ul></nav></header><article data-main='1'><h1>{words(4)}</h1>{body}</article><aside><ul>{menu}</ul></aside><footer>{words(20)}</footer></body></html>"


def test_reading_equals_a_plain_reader():
    draw = random.Random(12)
    for _ in range(200):
        source = page(draw)
        plain = Plain()
        plain.feed(source)
        plain.flush()
        assert main_text(source, None)[0] == "\n".join(plain.blocks)


LONG = "".join(f"<p>paragraph {i} of the longest part of this page, with many more words.</p>" for i in range(12))
MENU = "<div class=links>" + "".join(f"<a href=/{i}>Some entry {i}</a> " for i in range(30)) + "</div>"


@pytest.mark.parametrize(
    ("source", "first", "last", "blocks"),
    [
        (f"<body><div id=c><h1>Head</h1><p class=lead>Lead</p><div class=body>{LONG}</div><div class=more><p>Second section</p></div></div><footer>f</footer>", "Head", "Second section", 15),
        (f"<body><article><h1>Head</h1><div><div class=text>{LONG}</div></div><p>End</article><p>outside", "Head", "End", 14),
        (f"<body><main><div><div><h1>Head</h1><div>{LONG}</div></div></div></main><p>outside</p>", "Head", "paragraph 11 of the longest part of this page, with many more words.", 13),
        (f"<body><div id=all>{MENU}<div class=body>{LONG}</div></div>", "paragraph 0 of the longest part of this page, with many more words.", "paragraph 11 of the longest part of this page, with many more words.", 12),
        (f"<body><article><p>Before<object data=x>{LONG}<p>After</article>", "Before", "After", 14),
        (f"<body><article><p>Before<noscript><iframe>{LONG}</article>", "Before", "paragraph 11 of the longest part of this page, with many more words.", 13),
        (f"<body><article><p>Before<object>hidden</object>{LONG}</article><script>open {LONG}", "Before", "paragraph 11 of the longest part of this page, with many more words.", 13),
    ],
)
def test_nested_and_open_layouts_keep_every_block(source, first, last, blocks):
    found = main_text(source, None)[0].split("\n")
    assert (found[0], found[-1], len(found)) == (first, last, blocks)


@pytest.mark.parametrize("piece", ['<p class="x>text ', "<a href='", "<div>a", "<object>x", "<!x ", "<", "</x>", "<div><td>", "<p a='x \"y> <b c=\"", "<li><ul>", "<iframe><noscript>"])
def test_time_grows_with_the_length(piece):
    def seconds(chars):
        source = piece * (chars // len(piece))
        start = time.perf_counter()
        main_text(source, None)
        return time.perf_counter() - start

    seconds(10_000)
    small, large = min(seconds(100_000) for _ in range(2)), seconds(800_000)
    assert large < 30 * max(small, 0.02)


def test_deep_paths_stay_short():
    found = html_extraction.parse("<div class=abcdefgh>a" * 3000)
    assert max(len(n.path) for n in found.nodes) < 700 and len({n.path for n in found.nodes}) == 3000
