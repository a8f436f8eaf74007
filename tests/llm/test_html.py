"""Hand-made pages for the renderer: tables, visibility, tags that never end, long pages."""

import time

from ledgerline.llm.html_text import COLUMN, extract, render


def test_tables():
    assert render("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>") == "a  b\n   c\nd  e"
    assert render("<table><tr><td>x<td rowspan=0>y<td>z<tr><td>1<td>2<tbody><tr><td>3<td>4</table>") == "x  y  z\n1     2\n3  4"
    assert render("<table><tr><td colspan=2>wide<td>r<tr><td>1<td>2<td>3</table>") == "wide     r\n1     2  3"
    assert render("<table><tr><td colspan=99999999>a<td rowspan=99999999>b</table>c").split() == ["a", "b", "c"]


def test_long_cells_stay_aligned():
    words = "word " * 40
    lines = render(f"<table><tr><td>a<td>b<tr><td>cccc<td>d<tr><td>{words}<td>e</table>").split("\n")
    assert {x.index(c) for x, c in zip(lines, "bde", strict=False)} == {COLUMN - 60 + lines[0].index("b")}
    assert " ".join(lines).split().count("word") == 40 and max(map(len, lines)) <= COLUMN + 3
    long = "x" * 500
    assert render(f"<table><tr><td>{long}<td>b<tr><td>c<td>d</table>").split("\n") == [f"{long}  b", "c".ljust(COLUMN) + "  d"]


def test_visibility():
    assert render("<p style='visibility: hidden'>no <b style='visibility:visible'>yes</b> no</p>x") == "yes\n\nx"
    assert render("<ul style='visibility:hidden'><li>a<li style='visibility:visible'>b</ul>") == "- b"
    assert render("<div style='display:none'><b style='visibility:visible'>no</b></div>y") == "y"
    assert render("<table><tr style='visibility:collapse'><td>no<tr><td>yes</table>") == "yes"


def test_what_never_ends():
    assert render("a<b") == "a<b" and render("x<!-- no") == "x" and render("<p>x<!-- no <b>") == "x" and render("<p>x <a <!-- no") == "x <a"
    assert render("<p>x<!-- a --> y<!-- b -->") == "x y"
    began = time.time()
    for page in ("<a " * 350_000, "<a '" * 300_000, "<b>" + "<i " * 300_000, "<!--" * 250_000, '<a "' * 200_001 + ">", "<td>" * 250_000, "<table><tr><td>" * 60_000, "<script>" * 100_000):
        render(page)
    assert time.time() - began < 60
    assert len(render("<a " * 350_000)) == 350_000 * 3 - 1


def test_empty_table(spark):
    assert not extract(spark.createDataFrame([], "page_id long, html string, text string")).count()


def test_all_text_is_kept(spark):
    """Words outside of tags come out once each and in order, from whole pages of paragraphs, lists and tables."""
    parts = [f"<p>p{i} <b>q{i}</b>" if i % 3 == 0 else f"<ul><li>l{i}<li>m{i}</ul>" if i % 3 == 1 else f"<table><tr><td>c{i}<td>d{i}<tr><td>e{i}</table>" for i in range(900)]
    want = [w for i in range(900) for w in ([f"p{i}", f"q{i}"] if i % 3 == 0 else [f"l{i}", f"m{i}"] if i % 3 == 1 else [f"c{i}", f"d{i}", f"e{i}"])]
    (row,) = extract(spark.createDataFrame([(1, "".join(parts))], "page_id long, html string")).collect()
    assert [w for w in row.text.split() if w != "-"] == want
