import html
import math
import random
import time

import pytest

from vectorlake.llm import html_text
from vectorlake.llm.html_text import extract, main_text

PARA = "Plain sentences make up the article and go on for a while. " * 4


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<script>x</script>", ""),
        ("only &amp; text", "only & text"),
        ("<p>a<p>b <i>c</i>&nbsp;d", "a\n\nb c d"),
        ("<article><h1>T</h1><p>x\n  y<br>z</p></article><footer>f</footer>", "T\n\nx y z"),
        ("<ul><li>one<li>two</ul>", "one\n\ntwo"),
        (f"<nav><a href=1>m</a></nav><div id='content'><h2>T</h2><p>{PARA}</p></div><div class='sidebar'><p>{'side ' * 30}</p></div>", f"T\n\n{PARA.strip()}"),
        (f"<header>head</header><main><header><h1>T</h1></header><p>{PARA}</p><p>s</p></main><aside>a</aside>", f"T\n\n{PARA.strip()}\n\ns"),
        (f"<article><p>{PARA}</p><div class='ad'>buy</div><form><p>f</p></form></article><div class=comments><p>{'nice ' * 200}</p></div>", PARA.strip()),
        ("<p>a &lt;b&gt; &#233; <!-- no --> c</p>", "a <b> é c"),
        ("<div" * 3, "<div<div<div"),
        ("<p>" + "<b>" * 5000 + "deep", "deep"),
        ("<a title='x>y' b\">t</a>", "t"),
    ],
)
def test_pages(page, text):
    assert extract(page) == text


def test_split_article_keeps_short_blocks():
    page = f"<body><div id=story><section><p>{PARA}</p></section><section><p>Short.</p></section><section><p>{PARA}</p></section></div></body>"
    assert extract(page) == f"{PARA.strip()}\n\nShort.\n\n{PARA.strip()}"


def test_frame(spark):
    rows = [(1, "u", "<p>x</p>"), (1, "u", "<p>x</p>"), (2, None, None), (None, "v", "<p>é</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS text", "1 AS n_chars")
    assert sorted((r["text"], r["n_chars"]) for r in main_text(df).collect()) == [("", 0), ("x", 1), ("x", 1), ("é", 1)]
    assert main_text(df.where("false")).count() == 0


def plain_densities(node, whole):
    """(chars, tags, link chars, links) below a node and, by node, its density, written out by recursion."""
    chars = tags = link_chars = links = 0
    out = {}
    for x in node.items:
        if isinstance(x, str):
            chars += len("".join(html.unescape(x).split()))
        else:
            (c, t, lc, lt), below = plain_densities(x, whole)
            out |= below
            chars, tags, link_chars, links = chars + c, tags + t + 1, link_chars + lc, links + lt + (x.tag == "a")
    if node.tag == "a":
        link_chars = chars
    if chars:
        c, t, lc, lt = chars, max(tags, 1), max(link_chars, 1), max(links, 1)
        base = math.log(c / max(c - link_chars, 1) * link_chars + whole * c + math.e) + math.e - 1
        out[id(node)] = max(c / t * math.log(max(c / lc * t / lt, 1)) / math.log(base), 0)
    return (chars, tags, link_chars, links), out


def test_densities_decide_without_names():
    """On pages of plain containers the text is that of the node with the largest sum of its children's densities."""
    rng = random.Random(8)
    for _ in range(30):
        menu = "".join(f"<li><a href=/{i}>m{i}</a></li>" for i in range(rng.randint(3, 9)))
        paragraphs = ["".join(rng.choice("abcdefg hij") for _ in range(rng.randint(80, 400))) for _ in range(rng.randint(2, 6))]
        page = f"<body><div><ul>{menu}</ul></div><div>Short words</div><div>{''.join(f'<p>{p}</p>' for p in paragraphs)}</div><div>End words</div></body>"
        body, nodes = html_text.parse(page)
        (chars, _, link_chars, _), density = plain_densities(body, 0)
        _, density = plain_densities(body, link_chars / max(chars, 1))
        html_text._names(nodes)
        html_text._measure(nodes)
        assert all(math.isclose(x.density, density.get(id(x), 0.0) * (html_text.PRIOR if x.doubted else 1), abs_tol=1e-9) for x in nodes)
        assert extract(page) == "\n\n".join(" ".join(p.split()) for p in paragraphs)


def test_names_are_a_prior_only():
    long = "The search for notices goes on in this paragraph of the article itself, as long as any other. " * 12
    page = f"<div><p>{PARA}</p><p class='search notices'>{long}</p><p>{PARA}</p><p class='notice'>Buy.</p></div>"
    assert extract(page) == "\n\n".join([PARA.strip(), long.strip(), PARA.strip()])


def test_stray_closing_tags_are_linear():
    took = []
    for n in (5_000, 20_000):
        began = time.process_time()
        extract("<span>" * n + "</i>" * n + "<li>" * n + "text")
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5
