import html.parser
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import html_text as h
from lattica.llm.html_text import extracted, main_text

PROSE = "A long sentence, with commas; and more of it, to be sure. " * 3


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "body,want",
    [
        (f"<nav><ul><li><a href=/>x</a></li></ul></nav><article><h1>H&amp;M</h1><p>{PROSE}</p><p><b>Short.<br><p>Next\n one</article><footer>f</footer>", ["H&M", PROSE, "Short.", "Next one"]),
        (f"<header><a>Site</a></header><div id='cookie-banner'>We use cookies.</div><div class=content><h2>T</h2><p>{PROSE}</p><p>Yes.</p><ul><li>one<li>two</ul></div><div class='sidebar'><p>{PROSE}{PROSE}</p></div>", ["T", PROSE, "Yes.", "one", "two"]),
        (f"<main><p>{PROSE}</p><div class=ad>Buy, now! {PROSE}</div><form>Name <input></form><p>Caf&eacute; &#8212; &lt;b&gt;</p></main><section id=comments><p>{PROSE}</p></section>", [PROSE, "Café — <b>"]),
        (f"<div><!-- <p>no</p> --><p>{PROSE}<p title='a > b'>{PROSE}<script>if (a<b) x('<p>')</script></p><p hidden>no</p></div>", [PROSE, PROSE]),
        (f"<article class='advert-free post'><p>One <i>two</i><b>three</b> <span>four</span></p><p>{PROSE}</p></article>", ["One twothree four", PROSE]),
    ],
)
def test_articles(body, want):
    assert main_text(page(body)) == "\n\n".join(" ".join(x.split()) for x in want)


@pytest.mark.parametrize("text", [None, "", "   ", "<html>", "<", "<p", "<script>x", "<!-- ", "</div>", "<a href='", "&"])
def test_broken_pages(text):
    assert main_text(text) in ("", "<", "&")


def test_plain_text_is_kept():
    assert main_text("just text & more") == "just text & more"


def test_rows(spark):
    rows = [(1, "u", page(f"<p>{PROSE}</p>")), (2, None, None), (1, "u", page(f"<p>{PROSE}</p>")), (None, "v", ""), (3, "w", page("<p>" + "word, " * 40_000 + "</p>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(5))
    got = extracted(df).collect()
    assert sorted((r.page_id or 0, len(r.text)) for r in got) == [(0, 0), (1, len(PROSE.strip())), (1, len(PROSE.strip())), (2, 0), (3, 239_999)]
    assert extracted(df.limit(0)).collect() == []


@pytest.mark.parametrize(
    "body,want",
    [
        # names that only hold such a word aren't that
        (f"<article><header class='post-header'><h1>Top</h1></header><p>{PROSE}</p><div class='related-work'><p>Others did.</p></div><p class='notice-period'>Two weeks.</p><p class=no-ads>x</p></article>", ["Top", PROSE, "Others did.", "Two weeks.", "x"]),
        (f"<article><p>{PROSE}</p><div class='relatedPosts'><p>{PROSE}</p></div><p class='cookie-notice'>Ok?</p><ol id=comment-list-items><li>{PROSE}</ol></article>", [PROSE]),
        # an article in a wrapper named after its sidebar is still the only prose
        (f"<div class='sidebar-left'><h1>T</h1><p>{PROSE}</p><p>{PROSE}</p></div><div class=menu><a href=1>One</a> <a href=2>Two</a></div>", ["T", PROSE, PROSE]),
        # links without prose in the article's own element
        (f"<div><ul><li><a href=1>One</a><li><a href=2>Two</a></ul><p>{PROSE}</p><p><a href=3>See</a> this.</p><ul><li>one<li>two</ul></div>", [PROSE, "See this.", "one", "two"]),
        (f"<div><p>{PROSE}<span class=ad>Buy <span>now</span> here</span> end</p><p>x <span class=ad>not closed</p></div>", [PROSE + "end", "x not closed"]),
    ],
)
def test_paths_and_names(body, want):
    assert main_text(page(body)) == "\n\n".join(" ".join(x.split()) for x in want)


def test_threshold_selects():
    body = page(f"<nav><a href=/>Home</a></nav><div><div><p>{PROSE}</p></div><table><tr><td><a>a</a><td><a>b</a></table><div class=comments><p>{PROSE}</p></div></div><section>Far. Off</section>")
    assert main_text(body) == PROSE.strip()
    assert main_text(body, share=0.001).count(PROSE.strip()) == 1 and "Far. Off" in main_text(body, share=0.001)
    assert main_text(body, share=0) == "\n\n".join(["Home", PROSE.strip(), "a", "b", PROSE.strip(), "Far. Off"])


def test_deep_and_odd_pages_take_linear_time():
    began = time.time()
    for text in ("<div>x. " * 20_000, "<div><li>x. " * 10_000, "<span class=ad>x " * 20_000, "<b " * 20_000, "</p>" * 50_000, "<p>" * 50_000, "<ul><li>" * 20_000 + "y"):
        main_text(text)
    assert time.time() - began < 5


class Tree(html.parser.HTMLParser):
    """An independent reading of well-formed pages: text nodes with all their ancestors."""

    def __init__(self):
        super().__init__()
        self.open, self.nodes, self.serial = [], [], 0

    def handle_starttag(self, tag, attrs):
        self.serial += 1
        marked = tag in ("nav", "footer") or dict(attrs).get("class") in ("ad-box", "comments")
        self.open.append((self.serial, tag, marked))

    def handle_endtag(self, tag):
        assert self.open.pop()[1] == tag

    def handle_data(self, data):
        if data.strip():
            self.nodes.append((tuple(self.open), data))


def by_hand(text, share, reach=2):
    """main_text() on well-formed pages, path by path and node by node."""
    tree = Tree()
    tree.feed(text)
    nodes = tree.nodes
    path = [tuple((t, m) for _, t, m in up) for up, _ in nodes]
    mine = lambda p: [i for i in range(len(nodes)) if path[i] == p]
    weigh = [1e-3 ** sum(m for _, m in p) for p in path]
    ratio = [sum(len(nodes[j][1].strip()) for j in mine(p)) / len(mine(p)) * w for p, w in zip(path, weigh)]
    marks = [(sum(sum(nodes[j][1].count(c) for c in ".,;:!?") for j in mine(p)) + 0.1) / len(mine(p)) * w for p, w in zip(path, weigh)]

    def smooth(x):
        k = [np.exp(-0.5 * (d / (reach / 2)) ** 2) for d in range(-reach, reach + 1)]
        return [sum(k[d + reach] * x[min(max(i + d, 0), len(x) - 1)] for d in range(-reach, reach + 1)) / sum(k) for i in range(len(x))]

    fused = [a * b * w for a, b, w in zip(smooth(ratio), smooth(marks), weigh)]
    score = [sum(fused[j] for j in mine(p)) / len(mine(p)) for p in path]
    size = [len(x.strip()) * w for (_, x), w in zip(nodes, weigh)]
    mean = sum(s * n for s, n in zip(score, size)) / sum(size)
    content = [s >= share * mean for s in score]
    if not any(content):
        content = [s == max(score) for s in score]
    ups = [[(0, "", False), *up] for up, _ in nodes]
    holding = {e[0] for up, c in zip(ups, content) if c for e in up}
    common = [e for e in next(up for up, c in zip(ups, content) if c) if all(e in up for up, c in zip(ups, content) if c)]
    while len(common) > 1 and common[-1][1] in h.LEAVES:
        common.pop()
    out = []
    for i, (up, (_, data)) in enumerate(zip(ups, nodes)):
        barren = next((e for e in up if e[0] not in holding), None)
        inside = [j for j in range(len(nodes)) if barren in ups[j]]
        links = sum(len(nodes[j][1].strip()) for j in inside if ups[j][-1][1] == "a")
        menu = barren and len(inside) > 1 and 2 * links > sum(len(nodes[j][1].strip()) for j in inside)
        if content[i] or (common[-1] in up and sum(e[2] for e in up) == sum(e[2] for e in common) and not menu):
            out.append(" ".join(data.split()))
    return "\n\n".join(out)


def test_against_a_reading_by_hand():
    rnd = random.Random(6)

    def block(deep):
        if deep == 0 or rnd.random() < 0.3:
            if rnd.random() < 0.2:
                return "<ul>" + "".join(f"<li><div>{rnd.choice('abc')} one</div></li>" for _ in range(rnd.randint(1, 3))) + "</ul>"
            return f"<p>{' '.join(rnd.choice(['word', 'more words,', 'and an end.', 'so it is;']) for _ in range(rnd.randint(1, 40)))}</p>"
        tag = rnd.choice(["div", "div", "section", "nav", "footer", "div class=ad-box", "div class=comments"])
        return f"<{tag}>" + "".join(block(deep - 1) for _ in range(rnd.randint(1, 4))) + f"</{tag.split()[0]}>"

    seen = set()
    for _ in range(150):
        text = f"<html><body>{''.join(block(3) for _ in range(4))}</body></html>"
        for share in (0, 0.1, 0.5, 1, 3):
            got = main_text(text, share)
            assert got == by_hand(text, share)
        seen.add(main_text(text, 0) != main_text(text) != main_text(text, 3))
    assert True in seen


RIVER = "<p>The river rose again in spring, and the mill stood still. Nobody had expected that, least of all the miller; he sold it.</p>"


def test_reference_lists_belong_to_the_article():
    page = f"<article>{RIVER * 4}<ul><li><a href='/1'>First source</a></li><li><a href='/2'>Second source</a></li></ul></article><nav><a href='/'>Home</a></nav>"
    assert main_text(page).endswith("First source\n\nSecond source")


def test_much_prose_outweighs_a_name_but_not_a_tag():
    long = "In that house they ate well: soup, bread, fish, and plums. " * 40
    short = "Add to the list."
    for name in ("menu", "share"):
        assert long.strip() in main_text(f"<article>{RIVER * 4}<p class='{name}'>{long}</p>{RIVER * 2}</article>")
        assert short not in main_text(f"<article>{RIVER * 4}<p class='{name}'>{short}</p>{RIVER * 2}</article>")
    assert "soup" not in main_text(f"<article>{RIVER * 4}<aside>{long}</aside>{RIVER * 2}</article>")
