"""Main text of layouts written by hand, which the generator of training pages doesn't make: articles that nothing names, odd markup, nested lists."""

import random
import time

import pytest

from ledgerloom.llm import html_extract, html_pages

R = random.Random(9)


def _paragraph(n):
    return " ".join("".join(R.choice("abcdefghijklmno") for _ in range(R.randint(2, 9))) for _ in range(n)).capitalize() + "."


TEXTS = [_paragraph(23) for _ in range(4)]
FOUR, WANT = "".join(f"<p>{x}</p>" for x in TEXTS), "\n".join(TEXTS)
MENU = '<ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li><li><a href="/c">Contact</a></li></ul>'
LAYOUTS = {
    "bare paragraphs": f"<html><body>{FOUR}</body></html>", "one div": f"<html><body><div>{FOUR}</div></body></html>", "unknown words": f"<div id=wrap><div class=col-8>{FOUR}</div></div>", "more": f'<main><article><div class="more-text">{FOUR}</div></article></main>',
    "open anchor": f'<body><a name="top"><article>{FOUR}</article></body>', "open link": f'<body><a href="#x">Skip</a><a href="#y">To text<div>{FOUR}</div></body>', "empty comment": f"<body><!---><article>{FOUR}</article></body>", "emptier comment": f"<body><!--><article>{FOUR}</article></body>",
    "menu and footer": f"<body><nav>{MENU}</nav>{FOUR}<footer>© 2024 Somebody</footer></body>", "unnamed menu and footer": f"<body><div>{MENU}</div><div>{FOUR}</div><div>© 2024 Me, all rights reserved.</div></body>", "table": f"<body><table><tr><td>{MENU}</td><td>{FOUR}</td></tr></table></body>",
    "sidebar and comments": f'<body><div class="xq7">{FOUR}</div><aside><p>{_paragraph(20)}</p></aside><div id="comments"><p>{_paragraph(15)}</p><div><p>{_paragraph(30)}</p></div></div></body>', "notice": f'<body><div class="cookie-bar"><p>{_paragraph(12)}</p></div><section>{FOUR}</section></body>',
    "deep": f"<body>{'<div>' * 30}{FOUR}{'</div>' * 30}</body>",
}


@pytest.fixture(scope="module")
def model():
    return html_extract.train(html_pages.labelled_pages())


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(model, name):
    assert model.extract(LAYOUTS[name]) == WANT


def test_text_alone_and_headings(model):
    assert model.extract("plain &amp; bare") == "plain & bare"
    assert model.extract(f"<body><h1>A title here</h1>{FOUR}</body>") == f"A title here\n{WANT}"
    assert model.extract(f"<body><nav>{MENU}</nav></body>") == ""


def test_long_paragraphs_and_many(model):
    texts = [_paragraph(90) for _ in range(12)]
    assert model.extract("<body><div><div class='zz'>" + "".join(f"<p>{x}</p>" for x in texts) + "</div></div></body>") == "\n".join(texts)


def test_time_of_nested_lists_is_linear(model):
    def took(n):
        began = time.process_time()
        model.extract("<div>" * n + "<li>x</li>" * n)
        return time.process_time() - began

    took(2000)
    assert min(took(16000) for _ in range(2)) < 6 * min(took(4000) for _ in range(3))


def test_query_texts_equal_the_model_row_by_row(spark, model):
    """Repeated rows, nulls and a page of megabytes, spread by Spark over tasks."""
    rows = [(i, "u", h) for i, h in enumerate([*LAYOUTS.values(), None, "", "<body>" + FOUR * 3000 + "</body>"])] * 2
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == sorted((i, model.extract(h or "")) for i, _, h in rows)
    assert max(len(r["text"]) for r in got) == 3000 * (len(WANT) + 1) - 1
