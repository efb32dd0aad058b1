from __future__ import annotations

import html
import re

import pytest
from pyspark.sql import functions as F

from fathomlake.llm import html_extract, labelled_pages, queries
from fathomlake.llm.common import table

STORY = "The story goes on and on, and it is a good one. Nobody knew what came next."
ARTICLE = f"<article><h1>Head</h1><p>{STORY}</p>{{}}</article>"


def text_of(page: str) -> str:
    return html_extract.main_text(page, html_extract.default_weights())


def test_held_out_layouts():
    weights, right, kept, gold_words = html_extract.default_weights(), 0, 0, 0
    pages = labelled_pages.held_out_pages()
    assert len(pages) + len(labelled_pages.training_pages()) >= 200
    for _, source in pages:
        page = html_extract.parse(source)
        gold, rows = html_extract._gold(page), html_extract._features(page)
        one, _, _ = html_extract.marginals([sum(weights.unary.get(f, 0.0) for f in r) for r in rows], page.parents, weights.pair)
        for i, (text, _) in page.texts.items():
            n = len(text.split())
            right, kept, gold_words = right + n * (one[i] > 0.5) * gold[i], kept + n * (one[i] > 0.5), gold_words + n * gold[i]
    assert right >= 0.95 * kept and right >= 0.95 * gold_words


@pytest.mark.parametrize(("page", "text"), [
    (f"<body><div>{STORY}</div><div>{STORY} It rained.</div></body>", f"{STORY}\n{STORY} It rained."),
    (STORY + " " + STORY, STORY + " " + STORY),
    (f"<nav><a href=/>Home</a></nav><p><a href=x>unclosed link<p>{STORY}</p><p>{STORY}</p>", f"{STORY}\n{STORY}"),
    (ARTICLE.format("<button>Click</button><object>No object</object><canvas>No canvas</canvas><video>No video</video><select><option>One</select><textarea>typed</textarea><p>More of it is here.</p>"),
     f"Head\n{STORY}\nMore of it is here."),
    (ARTICLE.format("<p>One <button>unclosed and more.</p><p>Last words of it.</p>"), f"Head\n{STORY}\nOne unclosed and more.\nLast words of it."),
    (ARTICLE.format("<p style='display:none'>Secret.</p><p hidden>Secret.</p><p>One <span style=\"visibility: hidden\">secret</span> two.</p><div aria-hidden='true'><p>Secret.</p></div><p>Last words of it.</p>"),
     f"Head\n{STORY}\nOne two.\nLast words of it."),
    (ARTICLE.format("") + "<div class='single-post-comments'><p>I like it.</p><p>I do not like it at all.</p></div>", f"Head\n{STORY}"),
    (f"<table><tr><td><a href=1>One</a><br><a href=2>Two</a></td><td><p>{STORY}</p></td></tr></table>", STORY),
    (ARTICLE.format("<pre>a  =\n 1</pre><!-- no --><script>var x = '<p>no</p>';</script><style>p{}</style>"), f"Head\n{STORY}\na = 1"),
])
def test_pages_of_many_kinds(page, text):
    assert text_of(page) == text


def article_of(source: str) -> str:
    """The text between the article's tags, for pages with one article and plain blocks in it."""
    inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    blocks = re.split(r"</?(?:p|h[1-6]|ul|ol|li|blockquote|div|table|tr|td|th)(?:\s[^>]*)?>", inner)
    texts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<(?!br)[^>]*>", "", b).replace("<br>", " "))).strip() for b in blocks]
    return "\n".join(t for t in texts if t)


def test_query_equals_a_plain_reading_of_the_article(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in table(spark, sf_dir, "pages").collect()}
    rows = queries.op1_html(spark, sf_dir).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        if pages[r["page_id"]] and pages[r["page_id"]].count("<article>") == 1:
            assert r["text"] == article_of(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


def test_edge_rows(spark):
    long = "<article><h1>Long</h1>" + f"<p>{STORY}</p>" * 20_000 + "</article>"
    pages = [(1, None), (2, ""), (3, "<<<"), (4, "<p>" * 3000), (5, ARTICLE.format("")), (5, ARTICLE.format("")), (None, ARTICLE.format("")), (6, long),
             (7, "<button>" * 20_000), (8, "<a " * 5000)]
    df = spark.createDataFrame(pages, "page_id long, html string").withColumns({"url": F.lit("u"), "text": F.lit(1), "_html": F.lit(2), "n_chars": F.lit(3)})
    got = [(r["page_id"], r["text"]) for r in html_extract.extract(df).collect()]
    assert sorted(i for i, _ in got if i) == [1, 2, 3, 4, 5, 5, 6, 7, 8] and all(t == "" for i, t in got if i in (1, 2, 4, 7))
    assert {t for i, t in got if i in (5, None)} == {f"Head\n{STORY}"}
    assert next(t for i, t in got if i == 6) == "Long" + f"\n{STORY}" * 20_000
    assert html_extract.extract(df.limit(0)).count() == 0
