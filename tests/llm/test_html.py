import html
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tidemark.llm.html_text import extract_text, main_text, smoothed, threshold

LONG = "This is a paragraph with enough words in it to be taken for content by any measure."


def test_articles_of_the_pages(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    found = {r["page_id"]: r for r in extract_text(pages).collect()}
    for row in pages.collect():
        article = row["html"].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        wanted = "\n".join(b for b in blocks if b)
        assert found[row["page_id"]]["text"] == wanted
        assert found[row["page_id"]]["n_chars"] == len(wanted)


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<nav>menu</nav>", ""),
        ("<p>short", "short"),
        ("<script>x</script><style>y</style><p>a&lt;b&amp;  c&nbsp;d<br>e", "a<b& c d e"),
        (f"<header>h</header><main><h1>T</h1><p>{LONG}<p>end</main><aside>s</aside>", f"T\n{LONG}\nend"),
        (f"<article><header><h1>T</h1></header><p>{LONG}</p></article><div class='comments'><article><p>{LONG}</article></div>", f"T\n{LONG}"),
        (f"<div id=cookie-notice>We use cookies</div><div><p>{LONG}</p><p>{LONG}</p></div><form><input>Name</form>", f"{LONG}\n{LONG}"),
        (f"<article><p>{LONG}<div class=ad>buy</div><p>{LONG}</article><footer>f", f"{LONG}\n{LONG}"),
        (f"<article><ul><li>a<li>b</ul><p>{LONG} &am", f"a\nb\n{LONG} &am"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


def test_smoothing_and_threshold():
    flat = smoothed(np.full(9, 3.0))
    assert np.allclose(flat, 3.0)
    assert 10 < threshold(np.array([1.0, 2.0, 1.5, 80.0, 90.0])) < 80
    assert threshold(np.array([5.0])) == 5.0


def test_clashing_columns_and_empty_table(spark):
    table = spark.createDataFrame([(1, "old", 5, "<p>new", "x")], "page_id long, text string, n_chars long, html string, lines string")
    row = extract_text(table).first()
    assert row.asDict() == {"page_id": 1, "lines": "x", "text": "new", "n_chars": 3}
    assert extract_text(table.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p>one</p><![foo[x]]><p>two</p></article>", "one\ntwo"),
        ("<head><title>x</title><body><article><p>text</p></article></body>", "text"),
        (f"<article><p class=notice>Cookies<p>{LONG}</article>", LONG),
    ],
)
def test_broken_pages_keep_their_text(page, text):
    assert main_text(page) == text


def test_unclosed_paragraphs_take_linear_time():
    started = time.monotonic()
    assert main_text("<article>" + "<p>x <b>y</b>" * 16_000).count("x y") == 16_000
    assert time.monotonic() - started < 5


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", ">", "<!", "<![", "]]>", "<p", "<article>", "</", "&#x", "x", " ", "--", "<?", "<script>", "=", "'", "CDATA["]), max_size=30))
def test_no_page_raises(parts):
    main_text("".join(parts))
