import html
import re

import pytest
from pyspark.sql import types as T

from quayline.llm import html_text
from tests.llm.data import HAVE_DATA, SF, SF2

PAGES = T.StructType([T.StructField(n, t) for n, t in (
    ("page_id", T.LongType()), ("url", T.StringType()), ("html", T.StringType()), ("text", T.IntegerType()), ("n_chars", T.StringType()))])
TREE = html_text.trained_tree()


def text(page):
    return html_text.main_text(page, TREE)


def test_the_tree_knows_its_table():
    x, y = html_text.labelled_blocks()
    assert len(y) > 150 and (html_text.main_blocks(TREE, x) == (y > 0.5)).mean() > 0.97


def words(n, tag="w"):
    return " ".join(f"{tag}{i}" for i in range(n))


# pages that are not in the labelled table: each part that has to go says "gone"
HELD_OUT = [
    "<html><body><header class='site-header'><a href=/>gone logo</a> gone tagline</header><nav id=mainNav><ul><li><a>gone</a><li>"
    "<a>gone two</a></ul></nav><main><article><h1>Kept title</h1><p class=byline>By kept author</p><p>%s</p><p>Kept.</p>"
    "<div class='ad-slot'>gone buy this now</div><h2>Kept part</h2><p>%s</p></article><section id=comments><h3>gone 3 replies</h3>"
    "<ol><li><p>gone what a fine long remark by a reader who has much to say on it</p></ol></section></main>"
    "<footer>gone &copy; 2020 by someone</footer></body></html>",
    "<body><div class='cookieNotice'>gone we use cookies to make this page better for all of you</div><div role=navigation><a>gone</a> "
    "<a>gone</a></div><div role=main><h1>Kept</h1><p>%s</p><form action=/s><label>gone mail</label><input><button>gone send</button></form>"
    "<p>%s</p></div><div role=complementary><h4>gone latest</h4><p>gone some text of a side box that is rather long to read</p></div>"
    "<div role=contentinfo>gone imprint</div>",
    "<div><a>gone home</a></div><div><a>gone news</a></div><div><a>gone sport</a></div><h1>Kept headline here</h1><div>%s</div><div>%s</div>"
    "<div><a>gone first</a></div><div><a>gone second one</a></div><div>gone legal</div>",
    "<aside><p>gone aside words</p></aside><article><p>%s</p><aside>gone pull quote</aside><p>%s</p><footer>gone filed under</footer></article>"
    "<section class='related-posts'><article><h3><a>gone other story</a></h3><p>gone teaser of another story</p></article></section>",
]


@pytest.mark.parametrize("page", HELD_OUT)
def test_held_out_pages(page):
    got = text(page % (words(40), words(25, "v")))
    assert "gone" not in got and words(40) in got and words(25, "v") in got
    assert "Kept" not in page or got.lower().count("kept") == page.lower().count("kept")


def test_markup_is_read_as_browsers_read_it():
    def inner(body):
        return text(f"<article>{body}</article>")

    assert inner("<p>a&amp;b &lt;c&gt; &eacute;&#233;&#xe9; &copy &nosuch; x&nbsp;&nbsp;y") == "a&b <c> ééé © &nosuch; x y"
    assert inner("<p>  one\n two<br>three<b>four</b> five <p>six</p>") == "one two threefour five\nsix"
    assert inner("<p>a<!-- b <p>c --> d<script>if (a<b) '</p>'</script>e<style>p{}</style>") == "a d e"
    assert inner("<p>a<script>never ends <p>b") == "a"
    assert inner("<p title='a > b' data-x=\"</p>\">text <i>in</i>line</P>") == "text inline"
    assert inner("<p title=5' tall>ok</p><p>1 < 2 and 3<4") == "ok\n1 < 2 and 3<4"
    assert inner("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == "a\nb\nc\nd"
    assert inner("<p>shown<span hidden>not</span></p><p style='display: none'>not</p><p>end <a href=x") == "shown\nend"
    assert text(None) == text("") == text(" \n") == text("<nav><a>x</a></nav>") == ""
    assert inner("<p>same<p>same") == "same\nsame"


def test_rows_are_kept_as_they_are(spark):
    page = "<article><p>" + "long word " * 60_000 + "</article>"
    rows = [(1, "u", "<article><p>é日本 &amp;</article>"), (1, "u", None), (None, None, "<article>x</article>"), (2, None, ""), (3, "v", page), (3, "v", page)]
    df = spark.createDataFrame([(*r, 7, "n") for r in rows], PAGES).repartition(3)
    got = sorted((tuple(r) for r in html_text.extract(df).collect()), key=repr)
    long = " ".join(["long word"] * 60_000)
    assert got == sorted([(1, "u", "é日本 &", 5), (1, "u", "", 0), (None, None, "x", 1), (2, None, "", 0), (3, "v", long, len(long)),
                          (3, "v", long, len(long))], key=repr)
    assert html_text.extract(df.limit(0)).collect() == []


@pytest.mark.skipif(not HAVE_DATA, reason="driver tables absent")
@pytest.mark.parametrize("folder", [SF, SF2])
def test_driver_pages_give_their_article(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    for row in pages.collect():
        body = re.search(r"<article>(.*?)</article>", row.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:h1|p)>", body))
        want = "\n".join(p for p in parts if p)
        assert (got[row.page_id].url, got[row.page_id].text, got[row.page_id].n_chars) == (row.url, want, len(want))
