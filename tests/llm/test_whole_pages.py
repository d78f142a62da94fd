"""Main texts of pages are whole: every block of the page, in the form that the query promises."""

from __future__ import annotations

import pytest

from monthmatch.llm.html_blocks import PATH_SIZE, WORD_SIZE, blocks_of, describe, extract_main_text
from monthmatch.llm.queries import op10_html_extraction

PARAGRAPHS = [
    "The title of it",
    "First paragraph of the article, with some words.",
    "Second paragraph of the article, with more of them.",
    "Third paragraph of the article, where it comes to its end.",
]
ARTICLE = "<article><h1>{}</h1><p>{}</p><p>{}</p><p>{}</p></article>".format(*PARAGRAPHS)


def test_query_has_an_empty_line_between_blocks(spark, tmp_path):
    page = f"<html><body><nav><a href='/'>Home</a></nav>{ARTICLE}<footer>Copyright 2024.</footer></body></html>"
    rows = [(1, "u", page), (2, "v", "<p>"), (3, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in op10_html_extraction(spark, str(tmp_path)).collect()}
    want = "\n\n".join(PARAGRAPHS)
    assert got == {1: (want, len(want)), 2: ("", 0), 3: ("", 0)}
    lines = {r.page_id: r.text for r in extract_main_text(df).collect()}
    assert lines[1] == "\n".join(PARAGRAPHS)


def texts(page):
    return [b.text for b in blocks_of(page)]


@pytest.mark.parametrize("tag", "noscript template select button svg iframe object canvas audio video".split())
def test_ignored_elements_hide_their_own_text_only(tag):
    assert texts(f"<div><{tag}/></div>{ARTICLE}") == PARAGRAPHS
    assert texts(f'<div><{tag} class="a" />{ARTICLE}</div>') == PARAGRAPHS
    assert texts(f"<div><{tag} a='b'>inner</div>{ARTICLE}") == PARAGRAPHS
    assert texts(f"<p>before <{tag}>inner <g>one</g></{tag}> after</p>{ARTICLE}") == ["before after", *PARAGRAPHS]
    assert texts(f"<p>before <{tag}>inner</p>{ARTICLE}<{tag}>last</{tag}>") == ["before", *PARAGRAPHS]
    assert texts(f"<b><div>x <{tag}>a</b>y</{tag}> z</div></b>") == ["x z"]
    # Without an end, the element around it ends it.
    assert texts(f"<section><p>x</p><{tag}>inner</section>{ARTICLE}") == ["x", *PARAGRAPHS]


def test_ignored_elements_within_each_other():
    assert texts("<p>a<object><p>x<object>y</object>z</object>b</p>") == ["ab"]
    assert texts("<p>a<object data=/x/>y</object>b</p>") == ["ab"]
    assert texts("<p>a <button>x<button>y</button>b</p>") == ["a b"]
    assert texts("<p>a<noscript><iframe src='x'></noscript>b</p>") == ["ab"]
    assert texts("<p>a<svg><title>t</title><path d='M0'><g/><style/><script/></svg>b</p>") == ["ab"]
    assert texts("<p>a<svg><style>p{}</style><script>if(a<b)c</script></svg>b</p>") == ["ab"]
    assert texts("<p>a<svg><foreignObject><div><p>x</p></div></foreignObject></svg>b</p>") == ["ab"]
    # A drawing without an end ends at an element that can not be in one.
    assert texts(f"<div><svg><title>t<g></div>{ARTICLE}") == PARAGRAPHS
    assert texts("<div><svg><path d='M0'><p>one<p>two</div>") == ["one", "two"]
    assert texts("<div><button>x<svg><path><p>y</button>z</div>") == ["z"]
    # Nothing but its own end tag ends raw text.
    assert texts("<div>a<textarea></div>b</textarea>c</div>") == ["ac"] and texts("a<script/>b</div>c") == ["a"]


def test_an_open_element_in_a_page_does_not_end_its_text(spark):
    broken = ARTICLE.replace("</p>", " <button>Share</p>", 1).replace("</h1>", "<svg viewBox='0 0 1 1'/></h1>")
    body = f"<nav><ul><li><a href='/'>Home</a></li></ul><select><option>en</nav>{broken}<footer>Copyright 2024.</footer>"
    df = spark.createDataFrame([(1, f"<html><body>{body}</body></html>")], "page_id long, html string")
    assert extract_main_text(df).first().text.split("\n") == PARAGRAPHS


def test_a_block_is_described_by_its_whole_text():
    block, other = blocks_of(f"<p>{'word ' * 50}{'1234 ' * 50}</p><p>{'word ' * 50}{'abcd ' * 50}</p>")
    n = len(block.text)
    digits = describe([block, other])[:, PATH_SIZE + WORD_SIZE + 6]
    assert digits[0] == pytest.approx(200 / n) and digits[1] == 0
