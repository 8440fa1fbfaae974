"""Lines parsed one by one say what one parse of the whole page says."""

import pytest

from vinolake.llm import boilerplate as bp

PAGES = [
    "<ul>\n<li><a href='/x'>Home &amp; more</a></li>\n<li>Wines</li>\n</ul>\n<h1>Clos <b>A</b></h1>\n12,00&nbsp;&euro;\n<a href='/y'>\nlinked\n</a> after\n<br/><img src='x'/> end",
    "<div>\r\n<script>var a = '<b>x</b>';</script>\r\nshown\r\n<style>p {}</style>\r\n</div>",
    "<p>one\ntwo</p>\n</a></a>\n<p>&lt;three&gt; a < b</p>",
    "<div\nclass='x'>split tag</div>\n<!-- a\ncomment --> out\n<script>\nvar x = '<p>no</p>';\n</script>\nyes",
    "plain\n\n  text  of  lines\n",
    "",
]


@pytest.mark.parametrize("body", PAGES)
def test_page_lines(body):
    whole = bp._Lines()
    text = body.replace("\r", " ")
    whole.feed(text)
    whole.close()
    want = [(k, t, whole.tags.get(k, 0), min(whole.linked.get(k, 0), len(t))) for k in sorted(whole.text) if (t := " ".join(" ".join(whole.text[k]).split()))]
    assert bp.page_lines(body) == want
