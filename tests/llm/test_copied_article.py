"""Copies of an article with other menus are one page when a host's template is counted."""

from lexgrove.llm import html_text


def test_copies_with_other_menus_keep_their_text(spark):
    body = "<h1>A head</h1><p>First part of the article.</p><p>Second part of it.</p>"
    rows = [(i, "http://a.org/x", f"<title>{i}</title><nav>menu {i}</nav><article>{body}</article>") for i in range(20)]
    rows += [(100 + i, "http://b.org/x", f"<title>{i}</title><div class='advert'>buy {i}</div>{body}") for i in range(20)]
    rows += [(200 + i, "http://c.org/x", f"<article><p>Text number {i}.</p><p>Read more of us.</p></article>") for i in range(20)]
    got = {x["page_id"]: x["text"] for x in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = "A head\nFirst part of the article.\nSecond part of it."
    assert all(got[i] == whole for i in [*range(20), *range(100, 120)])
    assert all(got[200 + i] == f"Text number {i}." for i in range(20))  # a real template still goes
