"""Operator 13: pages read by hand, consensus of a host, and an independent reading of the given pages."""

import html
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerline.llm.html_text import best_path, extract_text, host_of, host_paths, main_text

LONG = "This sentence is long enough to count as the text of an article, and it goes on for a while. "


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""),
        ("", ""),
        ("   \n ", ""),
        ("plain text only", "plain text only"),
        ("<nav>menu</nav><footer>f</footer>", ""),
        ("<p>a<p>b<br>c  \n d<p>", "a\nb c d"),
        ("<p>A &amp; B &lt;tag&gt; &#65;&#x42;&nbsp;&copy; &unknown; &amp;amp;</p>", "A & B <tag> AB © &unknown; &amp;"),
        ("<div>one <b>two</b><i>three</i> <a href=x>four</a></div>", "one twothree four"),
        ("<script>var t = '<p>no</p>';</script><style>p{}</style><p>yes</p><!-- <p>no</p> -->", "yes"),
        ("<p>unclosed <b>bold<p>next <i>it</article> end", "unclosed bold\nnext it end"),
        ("<ul><li>one<li>two<ul><li>in</ul><li>three</ul>", "one\ntwo\nin\nthree"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<article><h1>T</h1><div><p>" + LONG + "</p></div></article>", "T\n" + LONG.strip()),
        ("<div class=post><h1>T</h1><div class=body><p>" + LONG + "</p></div></div><div class=foo-sidebar>s</div>", "T\n" + LONG.strip()),
        ("<header><h1>Site</h1></header><article><header><h1>Title</h1><nav>x</nav></header><p>" + LONG + "</p><div class='comments'><article class='comment'><p>" + LONG * 3 + "</p></article></div></article>", "Title\n" + LONG.strip()),
        ("<div id=cookie-notice>We use cookies</div><main><p>" + LONG + "</p><form><p>Your mail</p><input></form><div class='adBanner'>buy</div></main><aside>" + LONG * 4 + "</aside>", LONG.strip()),
        ("<form id=all><div><p>" + LONG + "</p><p>" + LONG + "</p><p>three</p><button>send</button></div></form>", "\n".join([LONG.strip()] * 2 + ["three"])),
        ("<body class='has-sidebar'><div class='with-sidebar'><p>" + LONG + "</p></div></body>", LONG.strip()),
        ("<p title='a > b' data-x=\"<p>\">quoted</p>", "quoted"),
        ("<p>5 < 6 and <3</p>", "5 < 6 and <3"),
        ("<p hidden>no</p><p style='display: none'>no</p><div role=navigation>no</div><p>yes</p>", "yes"),
        ("<title>t</title><textarea><p>x</textarea><p>after", "after"),
        ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_one_page(source, text):
    assert main_text(source, None) == text


def pages(n=12):
    """A host whose article stands in an unnamed part, with a page on which an unnamed list of teasers is longer."""
    for i in range(n):
        side = "<div class='x9'><p>" + (LONG * 40 if i == 3 else "short side") + "</p></div>"
        yield f"http://WWW.a.example:80/{i}", f"<div class='k{i}'><div class='t-{i}'><p>Text {i}. {LONG * 3}</p><p>End.</p></div></div>{side}", f"Text {i}. {(LONG * 3).strip()}\nEnd."


def test_consensus_puts_a_page_right(spark):
    rows = [(i, u, h, "kept", i) for i, (u, h, _) in enumerate(pages())] + [(100, None, "<p>no host</p>", None, 1), (101, "http://b.example/", "<div class=q><p>other layout</p></div>", None, 1), (102, "http://www.a.example/odd", "<section><p>odd page of the host</p></section>", None, 1), (103, "http://www.a.example/", None, None, 1)]
    df = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string, host string, paths int")
    assert best_path(next(h for k, (_, h, _) in enumerate(pages()) if k == 3))[0] == "body>div.x0"
    found = {r.host: r.paths for r in host_paths(df).collect()}
    votes = Counter()
    for _, u, h, *_ in rows[:12]:
        path, n = best_path(h)
        votes[path] += n
    assert found["www.a.example"][0] == max(votes, key=votes.get) == "body>div.k0"
    out = extract_text(df)
    assert out.columns == ["page_id", "url", "host", "paths", "text"]
    got = sorted((r.page_id, r.text, r.host, r.paths) for r in out.where("page_id < 100").collect())
    want = [(i, t, "kept", i) for i, (_, _, t) in enumerate(pages())]
    assert got == sorted(want + want[:1])
    assert {r.page_id: r.text for r in out.where("page_id >= 100").collect()} == {100: "no host", 101: "other layout", 102: "odd page of the host", 103: ""}
    assert extract_text(df.limit(0)).count() == 0


def test_hosts(spark):
    urls = {"https://user:pw@Sub.Example.com:8080/a?b#c": "sub.example.com", "http://x": "x", "/relative": "", "": "", None: "", "mailto:a@b.c": "", "http:///p": ""}
    df = spark.createDataFrame([(u,) for u in urls], "url string").select("url", host_of(F.col("url")).alias("host"))
    assert {r.url: r.host for r in df.collect()} == urls


def test_given_pages_by_another_reading(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")

    def other(source):
        inner = re.search("<article>(.*?)</article>", source, re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)[^>]*>", inner))
        return "\n".join(p for p in parts if p)

    want = {r.page_id: other(r.html) for r in df.collect()}
    assert {r.page_id: r.text for r in extract_text(df).collect()} == want
    assert Path("/root/testdata/sf0.01").exists() and len(want) == df.count()
