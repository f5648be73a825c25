"""Pages, vectors and conversations."""

from __future__ import annotations

import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm import chat, html_text, topk

from . import brute

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var a="</p>";</script></head>
<body class="with-sidebar"><header><a href=/>Site</a></header><nav><ul><li><a>Menu one</a></li></ul></nav>
<div class="ad">Buy now, it is cheap and it is good for you and for all of us.</div>
<article><header><h1>The   &amp; headline</h1></header><p>First <b>para</b>graph<br>goes&nbsp;on &lt;here&gt;.
<p>Short.<ul><li>one</li><li>two &#x41;</li></ul><aside>See also</aside>
<form><input><button>Send</button></form><p hidden>unseen</p><p>Last</p></article>
<section id="comments"><article class="comment"><p>A reader says very many words here, more than the text.</p></article></section>
<div class="cookieNotice">We use cookies</div><footer>&copy; all</footer>"""


def test_main_text_of_an_article():
    assert html_text.main_text(PAGE) == (
        "The & headline\n\nFirst paragraph goes on <here>.\n\nShort.\n\none\n\ntwo A\n\nLast"
    )


def test_region_without_article_element():
    page = (
        "<body><div id=top><a>x</a><a>y</a></div><div class=wrap><div class=main-col><h2>Head</h2>"
        + "<p>Some longer text that is the content of this page.</p>" * 5
        + "<p>End</p></div></div><div><a>k</a><a>l</a><a>m</a></div></body>"
    )
    got = html_text.main_text(page).split("\n\n")
    assert got[0] == "Head" and got[-1] == "End" and len(got) == 7


@pytest.mark.parametrize("html", ["", "   ", "<p>", "</div></p>", "<script>x", "<!-- a", "<a <b <c>", "&#xFFFFFF;", "<div>" * 3000])
def test_broken_pages_do_not_crash(html):
    assert isinstance(html_text.main_text(html), str)


def test_plain_text_is_content():
    assert html_text.main_text("just  some\ntext") == "just some text"


def test_pages_of_the_table(spark, sf_dir):
    """The table's pages have one article each, of blocks without further markup but b and br."""
    import html as h
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extracted(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(?:</article>|<footer)", r.html, re.S).group(1)
        blocks = (" ".join(h.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", body))
        text = "\n\n".join(b for b in blocks if b)
        assert got[r.page_id] == (text, len(text))


LONG = "Some longer text that is the content of this page and goes on for a while. "


def around(block: str) -> str:
    return f"<body><nav><a>x</a></nav><article><h1>T</h1><p>{LONG * 3}</p>{block}<p>{LONG * 2}</p></article><footer>f</footer>"


@pytest.mark.parametrize(
    "block, text",
    [
        ('<section id="related-work"><h2>Related work</h2><p>Seen.</p></section>', "Related work\n\nSeen."),
        ('<section id="discussion"><p>Seen.</p></section>', "Seen."),
        ('<div id="social-effects"><p>Seen.</p></div>', "Seen."),
        ('<section id="search"><h2><b>Search</b></h2><p>Seen.</p></section>', "Search\n\nSeen."),
        ('<h2 id="search-methods">Seen</h2>', "Seen"),
        ('<h2 id="menu">Menu</h2>', "Menu"),
        ('<h2 class="ad-hoc">Seen</h2>', "Seen"),
        ('<p class="lead notice-board">Seen</p>', "Seen"),
        ("<p>a <span hidden>no</span> b</p>", "a b"),
        ("<p>a<button>no</button> b</p>", "a b"),
        ("<p>a <label>no</label> b</p>", "a b"),
        ('<p>a <span class="ad">no</span> b</p>', "a b"),
        ('<p>a <a class="share" href=x>no</a> b</p>', "a b"),
        ('<div class="cookieNotice">no</div>', ""),
        ('<div class="social-share-buttons">no</div>', ""),
        ('<div id="sidebar-left"><p>no</div>', ""),
        ('<section class="related-posts"><h2>no</h2></section>', ""),
        ('<div id="comments"><h2>Comments</h2><p>no</p></div>', ""),
    ],
)
def test_parts_by_whole_names(block, text):
    want = [f"T\n\n{(LONG * 3).strip()}", text, (LONG * 2).strip()]
    assert html_text.main_text(around(block)) == "\n\n".join(x for x in want if x)


def test_a_part_that_is_all_there_is():
    page = f"<div class=widget><p>{LONG * 5}</p><p>{LONG * 4}</p></div><div>k</div>"
    assert html_text.main_text(page) == f"{(LONG * 5).strip()}\n\n{(LONG * 4).strip()}"


def test_head_that_is_not_closed():
    assert html_text.main_text(f"<html><head><title>t</title><body><p>{LONG}") == LONG.strip()
    assert html_text.main_text(f"<head><title>t</title><p>{LONG}") == LONG.strip()


def made_page(rng: random.Random) -> tuple[str, str]:
    """A page and its main text: blocks of an article among parts that are none, inline ones too."""
    words = "the of stone river house quiet green letter winter morning paper garden bridge".split()

    def prose(n: int) -> str:
        return " ".join(rng.choices(words, k=n)).capitalize() + "."

    inline = ["", "", ' <span class="ad">buy now</span>', " <span hidden>secret</span>", ' <a class="share" href=#>Share</a>', " <button>Go</button>"]
    blocks, text = [], []
    for i in range(rng.randint(3, 9)):
        body, kind = prose(rng.randint(15, 60)), rng.choice(["p", "p", "p", "li", "section", "h2"])
        if kind == "h2":
            title = rng.choice(["Related work", "Discussion", "Search methods", "Social effects", "Notices"])
            blocks.append(f'<h2 id="{title.lower().replace(" ", "-")}">{title}</h2>')
            text.append(title)
        elif kind == "section":
            title = rng.choice(["Discussion", "Related work", "Overview", "Sharing"])
            blocks.append(f'<section id="{title.lower().replace(" ", "-")}"><h3>{title}</h3><p>{body}</p></section>')
            text += [title, body]
        elif kind == "li":
            blocks.append(f"<ul><li>{body}{rng.choice(inline)}</li></ul>")
            text.append(body)
        else:
            blocks.append(f"<p>{body}{rng.choice(inline)}</p>")
            text.append(body)
        if rng.random() < 0.3:
            blocks.append(rng.choice(['<aside><p>See also this</p></aside>', '<div class="ad-slot"><p>Cheap shoes</p></div>', "<form><input><p>Your mail</p></form>"]))
    inside = "".join(blocks)
    wrap = rng.choice(["<article>{}</article>", "<main><div>{}</div></main>", '<div class="content"><div>{}</div></div>', "<div>{}</div>"])
    menu = "".join(f"<li><a href=#>{rng.choice(words)}</a></li>" for _ in range(rng.randint(3, 12)))
    comments = '<section id="comments"><article class="comment"><p>' + prose(40) + "</p></article></section>" * (rng.random() < 0.5)
    notice = f'<div class="cookie-banner"><p>{prose(25)}</p></div>' * (rng.random() < 0.5)
    return (
        f"<html><head><title>x</title></head><body><header><p>Site</p></header><nav><ul>{menu}</ul></nav>{notice}"
        f"{wrap.format(inside)}{comments}<footer><p>All rights</p></footer></body></html>",
        "\n\n".join(text),
    )


def test_made_pages():
    rng = random.Random(12)
    for _ in range(400):
        page, text = made_page(rng)
        assert html_text.main_text(page) == text


@pytest.mark.parametrize(
    "page",
    ["<div><p>short text here</p>" * 3000, "<b>" * 4000 + "<p>some text</p>" * 1000, "<article>" * 3000 + "x", "<div>" * 20_000 + "x",
     "<div class=ad>" * 5000 + "<article>" + LONG],
    ids=["paragraphs", "bold", "articles", "deep", "adverts"],
)
def test_deep_pages_take_time_in_proportion(page):
    began = time.process_time()
    assert html_text.main_text(page)
    assert time.process_time() - began < 1


def test_awkward_pages(spark):
    rows = [(1, None, None, "a"), (1, "u", "", "b"), (None, "u", PAGE, "c"), (2, "u", "<p>" + "word " * 300_000, "d"), (2, "u", "x", "e")]
    got = html_text.extracted(spark.createDataFrame(rows, "page_id int, url string, html string, text string")).collect()
    assert Counter((r.page_id, r.n_chars > 0) for r in got) == Counter([(1, False), (1, False), (None, True), (2, True), (2, True)])
    assert html_text.extracted(spark.createDataFrame([], "page_id int, url string, html string")).isEmpty()


# --- vectors ------------------------------------------------------------------------------------


def top(vectors: list[tuple], k: int, every: int) -> Counter:
    rows = set(vectors)
    out = Counter()
    for q, a in rows:
        if q % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), v) for v, b in rows if v != q)
        out.update((q, i + 1, v, -s) for i, (s, v) in enumerate(scored[:k]))
    return out


@pytest.mark.parametrize("block", [7, 4096])
@pytest.mark.parametrize("kind", ["small", "ties", "huge", "one"])
def test_top_products(spark, kind, block):
    rng = random.Random(5)
    if kind == "small":
        vectors = [(i, tuple(rng.randint(-9, 9) for _ in range(12))) for i in range(150)]
    elif kind == "ties":
        vectors = [(i, (1, 2, 0, -1)) for i in range(120)] + [(i, tuple(rng.randint(-1, 1) for _ in range(4))) for i in range(120, 180)]
    elif kind == "huge":
        vectors = [(i, tuple(rng.randint(-(2**28), 2**28) for _ in range(3))) for i in range(60)]
    else:
        vectors = [(0, (1,))]
    rows = spark.createDataFrame(vectors + vectors[:2], "vec_id bigint, code array<bigint>")
    got = topk.top_products(rows, F.col("vec_id") % 5 == 0, k=4, block=block)
    assert Counter(tuple(r) for r in got.collect()) == top(vectors, 4, 5)


def test_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -0.01]), (1, None), (2, [nan, 1.0]), (3, [inf, 0.0]), (4, [None, 1.0]), (None, [1.0, 1.0]), (5, []), (6, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    used = df.where(topk.usable(F.col("embedding"))).select("vec_id", topk.quantized(F.col("embedding")).alias("code"))
    assert {r.vec_id: r.code for r in used.collect()} == {0: [64, -1], None: [64, 64], 5: [], 6: [32, 32]}
    got = topk.top_products(used, F.col("vec_id") % 20 == 0).collect()
    assert [tuple(r) for r in sorted(got)] == [(0, 1, 6, 64 * 32 - 32), (0, 2, 5, 0)]
    assert topk.top_products(used.limit(0), F.col("vec_id") % 20 == 0).isEmpty()


# --- conversations ------------------------------------------------------------------------------


def test_any_turn_reads_back():
    rng = random.Random(3)
    parts = ["[INST]", "[/INST]", "</s>", "<s>", "[SYS]", "[\\INST]", "\\", "[", "<", "]", " ", "a", "\n", "[ROLE", "x] ", "[/ROLE]", "<\\\\/s>", "é😀"]
    for _ in range(20_000):
        role = rng.choice(["user", "system", "assistant", "tool", "", "".join(rng.choices(parts, k=rng.randint(0, 4)))])
        text = "".join(rng.choices(parts, k=rng.randint(0, 7)))
        formatted, start, end = chat.render_turn(role, text)
        got = chat.parse_turn(formatted + rng.choice(["", "[INST] x [/INST]", "</s>"]))
        assert got[:2] == (role, text) and got[2:] == (start, end, len(formatted))
        assert chat.unescape(formatted[start:end]) == text


def test_plain_turns_stay_plain():
    assert chat.render_turn("user", "hi")[0] == "[INST] hi [/INST]"
    assert chat.render_turn("assistant", "</s>[INST] ok [/INST]")[0] == "<\\/s>[\\INST] ok [\\/INST]</s>"


def test_conversations(spark, sf_dir):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    rows += [(-1, 2, "user", None), (-1, 1, "system", "</s>" * 9), (-1, 2, "assistant", "b"), (-1, 2, "assistant", "a")]
    rows += [(None, None, None, None), (None, 5, "assistant", "x" * 200_000), (-2, 1, "user", ""), (-2, 1, "user", "")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    want = defaultdict(list)
    for conv, turn, role, text in rows:
        want[conv].append((turn is not None, turn, role or "", text or ""))
    out = {r[0]: tuple(r)[1:5] for r in chat.read_back(chat.formatted_turns(df)).collect()}
    assert out == {c: brute.op8([t[2:] for t in sorted(v)]) for c, v in want.items()}
    assert chat.read_back(chat.formatted_turns(df.limit(0))).isEmpty()
