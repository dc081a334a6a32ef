"""Main texts of pages: written pages, hosts with furniture that no name gives away, odd markup."""

from __future__ import annotations

import random
import time

import pytest

from tripspark.llm import site_style_tree
from tripspark.llm.site_style_tree import cut_into_blocks


def text_of(page):
    return "\n\n".join(t for _, t in cut_into_blocks(page)[0])


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain text", "plain text"),
        ("<p>a<p>b", "a\n\nb"),
        ("<article><h1>T</h1><p><b>x<br>y <i>z</i><p> u &amp; v&nbsp;&lt;w&gt; &#233;</article><p>out", "T\n\nx y z\n\nu & v <w> é"),
        ("<nav><p>menu</p></nav><div>text</div><footer>end", "text"),
        ("<script>var t='</p><p>no';</script><style>p{}</style><p>yes</p>", "yes"),
        ("<!-- <p>no</p> --><p title='a>b'>yes</p><!-- open", "yes"),
        ("<div class='sidebar left'>no</div><div id=main>yes<div class=ad>no</div>more</div>", "yes\n\nmore"),
        ("<div class='articleBody'>a</div><div class='userComments'>no</div><div role=dialog>no</div>", "a"),
        ("<header>site</header><article><header><h1>T</h1></header><p>x</p><aside>no</aside></article>", "T\n\nx"),
        ("<article class='post comments-open'>yes<article class=comment>no</article></article>", "yes"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\n\nb\n\nc\n\nd"),
        ("<form><p>no</p><select><option>no</select></form><p>x</div></span>y</p>z", "x\n\ny\n\nz"),
        ("<template><p>no</p></template><noscript><p>no</p></noscript><p>yes<", "yes<"),
        ("<P CLASS=NOTICE>no</P><Main><P>yes</MAIN>", "yes"),
        ("<title>no<p>still</title><p>yes", "yes"),
        ("<div class=content><p>a long main text</p></div><article><p>card</p></article>", "a long main text\n\ncard"),
        ("<article>the whole story of it</article><div>by us</div>", "the whole story of it"),
        ("<div class='layout with-sidebar'>a</div><div class=post-ad-free>b</div><div id=related-work>c</div>", "a\n\nb\n\nc"),
        ("<div class=alert-system-design>a</div><div class=article-header>b</div><div class=site-header>no</div>", "a\n\nb"),
        ("<div class='left_sidebar x'>no</div><div class=ad-slot-2>no</div><div class='shareButtons'>no</div>a", "a"),
        ("a<p title='open>b</p><p>c", "a\n\nb\n\nc"),
        ("a <b <i>x</i> 1 < 2 <", "a x 1 < 2 <"),
    ],
)
def test_blocks(page, text):
    assert text_of(page) == text


def test_long_and_broken_pages_end():
    assert text_of("<div>" * 3000 + "x") == "x"
    assert len(text_of("<p>" + "word " * 200_000)) == 999_999
    assert text_of("<" * 5000 + "x").endswith("x")


@pytest.mark.parametrize(
    "page",
    ["<a" * 100_000, "<div>" * 100_000, "<a \"" * 100_000, "<div></div>" * 100_000, "</p>" * 200_000, "<div><p>" * 50_000,
     "<!--" * 100_000, "<p title='" * 50_000 + ">" * 50_000],
    ids=["names", "nested", "quotes", "empty", "ends", "paragraphs", "comments", "titles"],
)
def test_long_pages_of_markup_take_time_in_proportion(page):
    start = time.perf_counter()
    blocks, layouts = cut_into_blocks(page)
    assert time.perf_counter() - start < 15
    assert sum(len(path) for path, _ in blocks) + sum(len(path) for path, _ in layouts) < 40 * len(page)


def test_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in site_style_tree.main_texts(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == text_of(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text)
        assert got[r.page_id].url == r.url


def test_furniture_of_a_host_is_found_by_entropy(spark):
    """Boxes without telling names repeat on a host; articles, also copied ones, do not."""
    draw = random.Random(1)
    words = lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows, want = [], {}
    for i in range(30):
        body = [words(30) for _ in range(3)] if i % 5 else ["copied " * 20, "text " * 30]
        shown = "".join(f"<p>{b}</p>" for b in body)
        page = f"<body><div class=c1><p>Read it all at our place</p><p>Call us</p></div><div class=c2>{shown}</div></body>"
        rows.append((i, f"https://Host.example.com:8080/{i}", page, "x"))
        want[i] = "\n\n".join(b.strip() for b in body)
    for i in range(30, 33):
        rows.append((i, f"http://small.example.com/{i}", "<div class=c1>same</div><p>own " + str(i) + "</p>", "x"))
        want[i] = f"same\n\nown {i}"
    rows += [(40, None, "<p>a</p>", "x"), (41, "no url", None, None), (None, "http://h/", "<p>b</p>", "x"), (40, None, "<p>a</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = site_style_tree.main_texts(pages).collect()
    assert {r.page_id: r.text for r in got if r.page_id is not None and r.page_id < 40} == want
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got if r.page_id is None or r.page_id >= 40) == [
        (0, "b", 1), (40, "a", 1), (40, "a", 1), (41, "", 0)
    ]
    assert site_style_tree.main_texts(pages.limit(0)).count() == 0


def test_sections_of_a_large_host(spark):
    """A box of a tenth of the pages goes; a section of unique texts stays, however many layouts it has."""
    rows, want = [], {}
    for i in range(1000):
        main, own = f"main {i} " + f"w{i} " * 30, f"note {i} n{i}"
        box = "<div class=c7><p>Read it all at our place</p></div>" if 300 <= i < 400 else ""
        kind = f" class=k{i}" if i >= 160 else ""
        section = f"<div class=c8><p{kind}>{own}</p></div>" if i < 200 else ""
        rows.append((i, f"http://large.example.com/{i}", f"<body><div class=c1><p>{main}</p></div>{section}{box}</body>"))
        want[i] = main.strip() + (f"\n\n{own}" if i < 200 else "")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in site_style_tree.main_texts(pages).collect()}
    assert got == want
