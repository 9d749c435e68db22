"""Whole articles of odd pages: titles outside containers, texts in several ones, comments and adverts under any class."""

import pytest

from strandline.llm import html_extract

LONG = "The article says many things of trees and of the birds that sing in them, one after the other. " * 6
BODY = f"<p>{LONG}</p><p>And more.</p>"
WHOLE = f"{LONG.strip()}\nAnd more."


def text(page):
    blocks = html_extract.blocks_of(page)
    return html_extract.text_by_path(blocks, html_extract.main_path(blocks))


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><h1>Headline</h1><article>{BODY}</article></body></html>",
        f"<html><body><h1>Headline</h1><div class=content>{BODY}</div></body></html>",
        f"<body><div><h1>Headline</h1></div><div><div class=content>{BODY}</div></div></body>",
f"<body><nav><a href=x>Start</a></nav><div><h1>Headline</h1></div><main>{BODY}</main><footer>2020</footer></body>",
    ],
)
def test_titles_outside_the_container_stay(page):
    assert text(page) == f"Headline\n{WHOLE}"


def test_leads_and_closing_words_beside_the_container_stay():
    assert text(f"<body><div class=lead>First words.</div><div class=content>{BODY}</div><div class=tail>Closing words.</div></body>") == f"First words.\n{WHOLE}\nClosing words."
    menu = "<div class=x><a href=1>one thing</a> <a href=2>another thing</a></div>"
    assert text(f"<body>{menu}<div class=lead>First words.</div><div class=content>{BODY}</div>{menu}</body>") == f"First words.\n{WHOLE}"


@pytest.mark.parametrize(
    "mark",
    ['id="user-comments"', 'class="comment-thread"', 'class="commentlist"', 'class="ad-slot"', 'class="sponsored-content"', 'class="box advert_top"', 'class="ads"', 'id=ad_1', 'class="postComments comments"', 'class="newsletter-box"'],
)
def test_comments_and_adverts_go(mark):
    page = f"<body><article><h1>Headline</h1>{BODY}<div {mark}><p>Nice one!</p></div></article><div {mark}><p>Buy now.</p></div></body>"
    assert text(page) == f"Headline\n{WHOLE}"
    assert text(page.replace("article>", "div>")) == f"Headline\n{WHOLE}"


@pytest.mark.parametrize("mark", ['class="no-ads"', 'class="with-comments"', 'class="has-sidebar"', 'class="commentary"', 'class="advice"', 'class="shadow add"', 'id="no-comments-page"'])
def test_classes_that_only_tell_of_them_stay(mark):
    assert text(f"<body><div {mark}><p>{LONG}</p></div><div {mark}><p>More of it.</p></div></body>") == f"{LONG.strip()}\nMore of it."


def test_a_host_path_reads_pages_with_two_templates(spark):
    """Most pages of the host have an article; the others keep what they hold outside one, and nulls and ties have defined results."""
    rows = [(i, "http://h.example/a", f"<body><h1>T{i}</h1><article>{BODY}</article><div class=ads>x</div></body>") for i in range(5)]
    rows += [(9, "http://h.example/b", f"<body><div class=lead>Lead.</div><div class=content>{BODY}</div></body>"), (10, None, None), (None, "http://h.example/c", "")]
    rows += [(11, "http://tie.example", f"<body><main>{BODY}</main></body>"), (12, "http://tie.example", f"<body><article>{BODY}</article></body>")]
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: f"T{i}\n{WHOLE}" for i in range(5)} | {9: f"Lead.\n{WHOLE}", 10: "", None: "", 11: WHOLE, 12: WHOLE}
    assert got == {k: (v, len(v)) for k, v in want.items()}
