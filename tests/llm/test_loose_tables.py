"""Loose table markup: rows are implied, and what can't stand in a table moves to before it."""

import pytest

from gaugeworks.llm import html_text


@pytest.mark.parametrize(("page", "text"), [
    ("<table><tbody><td>x</td><td>y</tbody></table>", "x  y"), ("<table><tbody><tr><td>a</td></tr><td>b</td></tbody></table>", "a\nb"),
    ("<table><tbody><form><tr><td>x</td></tr></form></tbody></table>", "x"), ("<table><tr><form><td>x</td></form></tr></table>", "x"),
    ("<table><form><tr><td>x<td>y</form></table>z", "x  y\n\nz"), ("<table><tbody>bare<tr><td>x</table>", "bare\n\nx"), ("p<table><tr>text<td>x</table>q", "ptext\n\nx\n\nq"),
    ("<table><tr><div>text</div><td>x</td></tr></table>", "text\n\nx"), ("<table>one <b>two</b> three<tr><td>x</table>", "one two three\n\nx"), ("<table><div>a<tr><td>x</table>", "a\n\nx"),
    ("<table><caption>c<td>x</table>", "c\nx"), ("<table> <tr> <td>a</td> <td>b</td> </tr> </table>", "a  b"), ("<table><tr><td>o<table><tbody>n<td>i</table></td><td>p</table>", "on  p\n\ni"),
    ("<table hidden>seen<tr><td>no</table>", "seen"), ("<tr>loose<td>x", "loose x"), ("<table><tr><td>a<tr><table>x<td>y</table>z", "a\n\nx\n\ny\n\nz"),
])
def test_nothing_in_a_table_is_lost(page, text):
    assert html_text.render(html_text.tree(page)) == text
