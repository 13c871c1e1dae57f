import html
import re
import time

import pytest

from threadloom.llm import html_text as ht


def test_article_among_boilerplate():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <div id=cookie-notice>We use cookies, a lot of them, and many more words about cookies.</div><nav><ul><li><a href=/a>Home</a></ul></nav>
    <div class="wrap"><article><h1>Head &amp; line</h1><p>First   para <b>bold</b>, more text in it.<p>Second&nbsp;para &#233;.
    <form>Sign up</form><div class="ad">Buy</div><p>Third.</p></article><aside>Side text</aside><section class="comments"><p>Nice post, thank you very much for it!</p></section></div>
    <footer>&copy; x</footer></body></html>"""
    assert ht.extract(page) == "Head & line First para bold, more text in it. Second para é. Third."


def test_without_semantic_elements():
    links = "".join(f'<li><a href="/{i}">Link number {i}</a></li>' for i in range(30))
    paragraphs = "".join(f"<p>Paragraph {i} has a good many words that say something, and more of them.</p>" for i in range(8))
    page = f"<html><body><div class=menu><ul>{links}</ul></div><div><div>{paragraphs}</div></div><div>{'<a href=x>tag</a> ' * 30}</div></body></html>"
    text = ht.extract(page)
    assert text.startswith("Paragraph 0") and text.endswith("more of them.") and "Link number" not in text and text.count("Paragraph") == 8


def test_corpus(spark, sf_tiny):
    pages = spark.read.parquet(f"{sf_tiny}/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    for r in ht.main_texts(pages).collect():
        article = re.search("<article>(.*?)</article>", raw[r.page_id], re.S)[1]
        blocks = re.split(r"</?(?:p|h1|br)>", article)
        want = " ".join(" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in blocks if re.sub("<[^>]*>", "", b).strip())
        assert r.text == want and r.n_chars == len(want)


def test_edges(spark):
    rows = [(1, "u", None, "t"), (2, None, "", "t"), (None, "u", "plain text, &lt;no tags", "t"), (3, "u", "<p>a<p>b" * 20_000, "t"), (3, "u", "<div>" * 50_000 + "deep", "t"), (4, "u", "<script>x", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = ht.main_texts(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 20), (1, 0), (2, 0), (3, 4), (3, 79_999), (4, 0)]
    assert ht.main_texts(pages.limit(0)).count() == 0


def test_marked_wrappers_of_the_page():
    text = " ".join(f"Sentence {i} of the article says a good many words." for i in range(12))
    side = "<div class=sidebar><p>Side text of a few words.</p></div>"
    for kind in ("class='content has-sidebar'", "class=layout-with-sidebar-right", "id=no-comments", "class=main-side"):
        for inner in (f"<article><p>{text}</p></article>", f"<div><p>{text}</p></div>"):
            assert ht.extract(f"<html><body><div {kind}><div class=nav><a href=/>Home</a></div>{inner}{side}</div></body></html>") == text
    assert ht.extract(f"<body><form action=x><div class=menu><a href=/>Home</a></div><div><p>{text}</p></div>{side}<input name=q></form></body>") == text


def test_comments_do_not_count_as_article():
    text = "The article is short, but it is the article of this page."
    said = "".join(f"<article class='comment'><p>Reader {i} writes a long remark about it, and then some more words.</p></article>" for i in range(9))
    assert ht.extract(f"<body><article><p>{text}</p>{said}</article></body>") == text
    assert ht.extract(f"<body><article><p>{text}</p><section class=comments>{said}</section></article></body>") == text
    assert ht.extract(f"<body><article><p>{text}</p></article><section class=comments>{said.replace('article', 'div')}</section></body>") == text


@pytest.mark.parametrize("unit", ['<a "', "<td><b>", "<p><b>", "<div class='", "<", "<x ", "<!--", "&amp", "<a '> <b \"> ", "<title>", "</script "])
def test_malformed_pages_take_linear_time(unit):
    def took(n):
        start = time.process_time()
        ht.extract(unit * (n // len(unit)))
        return time.process_time() - start

    took(1 << 17)
    assert took(5 << 20) < max(15 * took(5 << 18), 5)


def test_nested_inline_elements_take_linear_time():
    start = time.process_time()
    ht.extract("<span>" * 200_000 + "<td>" * 200_000 + "<div></div>" * 200_000)
    assert time.process_time() - start < 30


def test_tags_whose_quotes_do_not_end():
    assert ht.extract("<p>one <b class='x>two</b> three</p>") == "one two three"
    assert ht.extract("<p>one <b class='x'>two</b> <i>three") == "one two three"
    assert ht.extract("<p>one <b title='a>b'>two</b> three</p>") == "one two three"
    assert ht.extract("<p>one < two <b three") == "one < two <b three"
