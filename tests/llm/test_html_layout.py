"""What is shown of a page, how deep it may nest, and its layout against one that the test makes up from the same data."""

import random
import time

import pytest

from gaugeworks.llm import html_text


def shown(page: str) -> str:
    return html_text.render(html_text.tree(page))


@pytest.mark.parametrize(("page", "text"), [
    ("a<xmp>1 <b>\n  2</xmp>c", "a\n1 <b>\n  2\nc"), ("<math><mi>x</mi><mo>=</mo><mn>2</mn></math>", "x=2"), ("<svg><title>no</title><g><text>drawn</text></g><defs><text>no</text></defs></svg>", "drawn"),
    ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>", "yes"), ("<div style='display:none'>no<b style='visibility:visible'>no</b></div>x", "x"),
    ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"), ("<head><title>t</title>text<p>p", "text\n\np"), ("<head><div>x</div>", "x"), ("a<plaintext><b>c", "a\n<b>c"), ("<ruby>k<rp>(</rp><rt>r</rt><rp>)</rp></ruby>", "kr"),
    ("<a title='x'\">seen</a> \" <b>b</b>", "seen \" b"), ("<table><tr><td>b<thead><tr><td>h<tfoot><tr><td>f<tbody><tr><td>c</table>", "h\nb\nc\nf"),
    ("<table><tr><td colspan=2>wide cell<td>x<tr><td>a<td>b<td>y</table>", "wide cell  x\na  b       y"), ("<table><tr><td rowspan=2>r<td>1<tr><td>2<tr><td>s<td>3</table>", "r  1\n   2\ns  3"),
    ("<table><tr><td rowspan=0>r<td>1<tr><td>2<tbody><tr><td>n</table>", "r  1\n   2\nn"), ("<table><tr style='visibility:collapse'><td>no<td style='visibility:visible'>yes</table>", "  yes"),
    ("<table><tr><td colspan=9999999>a<td rowspan=99999>b</table>", None),
])
def test_what_is_visible(page, text):
    got = shown(page)
    assert got == text if text is not None else got.split() == ["a", "b"]


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "deep", "<table><tr><td>" * 20_000 + "deep", "<p><table><tr><td>" + "<div>" * 100_000 + "deep", "<b><p>" * 50_000 + "deep", "<ul><li>" * 2_000 + "deep", "<a '" * 100_000 + ">deep"])
def test_deep_pages_take_seconds(page):
    began = time.perf_counter()
    assert shown(page).split()[-1] in ("deep", "'>deep")
    assert time.perf_counter() - began < 20


def block(rng: random.Random, depth: int) -> tuple[str, list[str]]:
    """Markup and the lines that it must give, made side by side."""
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
    kind = rng.choice(["p", "div", "list", "table"] if depth else ["p", "div", "table"])
    if kind == "p":
        t = " ".join(word() for _ in range(rng.randint(1, 5)))
        return f"<p>{t.replace(' ', rng.choice([' ', chr(10) + '  ', ' <i> </i> ']))}" + rng.choice(["", "</p>"]), ["", *[t], ""]
    if kind == "div":
        inner = [block(rng, 0) for _ in range(rng.randint(1, 3))]
        return "<div>" + "".join(m for m, _ in inner) + "</div>", [x for _, ls in inner for x in ls]
    if kind == "list":
        ordered, first = rng.random() < 0.5, rng.randint(1, 99)
        items = [word() for _ in range(rng.randint(1, 4))]
        lines = [(f"{first + k}. " if ordered else "- ") + x for k, x in enumerate(items)]
        end = rng.choice(["", "</li>"])
        return (f"<ol start={first}>" if ordered else "<ul>") + "".join(f"<li>{x}{end}" for x in items) + ("</ol>" if ordered else "</ul>"), ["", *lines, ""]
    n, m = rng.randint(1, 4), rng.randint(1, 4)
    owner = [[None] * m for _ in range(n)]
    cells = {}
    for i in range(n):
        for j in range(m):
            if owner[i][j] is None:
                wide = 1
                while j + wide < m and owner[i][j + wide] is None and rng.random() < 0.3:
                    wide += 1
                tall = 1
                while i + tall < n and rng.random() < 0.25:
                    tall += 1
                for a in range(i, i + tall):
                    for b in range(j, j + wide):
                        owner[a][b] = (i, j)
                cells[i, j] = (wide, tall, word())
    started = sorted({j for _, j in cells})  # only where a cell starts there is a gap
    room = lambda j, wide: (started.index(j), sum(j <= k < j + wide for k in started))
    width = [0] * len(started)
    for (_, j), (wide, _, t) in sorted(cells.items(), key=lambda c: (room(c[0][1], c[1][0])[1], c[0])):
        k, over = room(j, wide)
        lack = len(t) - (sum(width[k : k + over]) + 2 * (over - 1))
        if lack > 0:
            width[k + over - 1] += lack
    lines, markup = [], "<table>"
    for i in range(n):
        line, j = "", 0
        markup += "<tr>"
        while j < m:
            wide, tall, t = cells[owner[i][j]]
            mine = owner[i][j] == (i, j)
            if mine:
                markup += f"<td colspan={wide} rowspan='{tall}'>{t}" + rng.choice(["", "</td>"])
            else:
                wide = 1
            if j in started:
                k, over = room(j, wide)
                line += (t if mine else "").ljust(sum(width[k : k + over]) + 2 * (over - 1)) + "  "
            j += wide
        if any(k[0] == i for k in cells):
            lines.append(line.rstrip())
    return markup + "</table>", ["", *lines, ""]


@pytest.mark.parametrize("seed", range(300))
def test_layout_is_the_one_made_beside_it(seed):
    rng = random.Random(seed)
    parts = [block(rng, 1) for _ in range(rng.randint(1, 5))]
    want = []
    for line in (x for _, ls in parts for x in ls):
        if line or (want and want[-1]):
            want.append(line)
    assert shown("".join(m for m, _ in parts)).split("\n") == "\n".join(want).strip("\n").split("\n")


@pytest.mark.parametrize(("page", "text"), [
    ("<ol><li value=7>a<li>b</ol>", "7. a\n8. b"), ("<ol reversed><li>a<li>b<li>c</ol>", "3. a\n2. b\n1. c"), ("<ol reversed start=2><li>a<li>b<li value=-5>c<li>d</ol>", "2. a\n1. b\n-5. c\n-6. d"),
    ("<table><tr><td colspan=1000>a<td>b<tr><td>c</table>", "a  b\nc"), ("<ul><li>x<table><tr><td>a<td>b<tr><td>cc<td>d</table></ul>", "- x\n\n  a   b\n  cc  d"),
    ("<table><tr><td><table><tr><td>1<td>2<tr><td>3</table><td>x<br>y<br>z</table>", "1  2  x\n3     y\n      z"),
])
def test_numbers_of_items_and_gaps_of_columns(page, text):
    assert shown(page) == text


def nested(n, before, after):
    return "".join(f"{before}w{k} " for k in range(n)) + after * n


@pytest.mark.parametrize("page", [
    "<table><tr>" + "<td colspan=1000 rowspan=0>a" * 200 + "<tr><td>b" * 1000 + "</table>",
    "<table><tr>" + "<td rowspan=0>a" * 3000 + "<tr><td>b" * 5000 + "</table>",
    "<table><tr>" + "".join(f"<td rowspan={k % 900 + 2}>a" for k in range(1500)) + "<tr><td>b" * 3000 + "</table>",
    nested(20_000, "<table><tr><td>", "</table>"), nested(20_000, "<table><tr><td>x<td>", "</table>"), "".join(f"<table><tr><td>w{k}<table><tr><td>x</table>" for k in range(5000)),
    nested(10_000, "<table><tr><td><table><tr><td>", "</table><td>x<tr><td>y</table>"), nested(20_000, "<ul><li>", "</ul>"), nested(20_000, "<ol><li>", ""), nested(5_000, "<ul><li><table><tr><td>", "</table></ul>"),
    nested(5_000, "<table><caption>", "</table>"), "<pre>" + " " * 200_000 + "x</pre>", "<table><tr><td>" + "x" * 100_000 + "<td>y" + "<tr><td>a<td>b" * 3000 + "</table>",
])
def test_work_and_text_stay_in_proportion_to_the_page(page):
    began = time.perf_counter()
    text = shown(page)
    assert time.perf_counter() - began < 6
    assert len(text) <= 40 * len(page) and len(text) < 8_000_000
    # all words are there
    assert sorted(text.replace("-", " ").split())[-1:] == sorted(html_text.html.unescape(html_text.re.sub("<[^>]*>", " ", page)).split())[-1:]


def test_no_word_is_lost_where_tables_are_not_aligned():
    page = nested(3000, "<table><tr><td>x<td>", "</table>")
    words = shown(page).split()
    assert sorted(words) == sorted(["x"] * 3000 + [f"w{k}" for k in range(3000)])
