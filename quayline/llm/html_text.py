"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is read once from front to back into flat blocks (what stands between two
block-level tags). A block has its number of words and the share of them inside
links, the same of the block before and after, and where it stands: inside an
article, inside a container that its tag, class, id or role names as boilerplate,
a heading, outside of the article that the page has. A decision tree (Gini index, grown
to ``DEPTH``) is trained on the blocks of the labelled pages below and says which
blocks are main text. Nothing is shuffled; every task reads its own pages.

Defined results: a null page is empty and gives an empty text; text before the first
tag, unclosed and misnested tags, references without semicolon and cut off markup
are read as browsers read them (an unclosed comment, script or style reaches to the
end of the page); white space is what Unicode says, so a no-break space counts;
``<br>`` is white space, not the end of a block; the header of an article belongs to
it, its footer does not; rows that repeat a page_id and null ids are rows like any
other; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import html
import re

import numpy as np
from pyspark.sql import DataFrame

from quayline.llm.common import prepare

DEPTH, LEAST = 8, 2  # of the tree: levels, and rows on each side of a split
# Tag names of the HTML standard by what they mean here.
RAW = "script|style|title|textarea|iframe|noembed|noframes|noscript|xmp|template|svg|object|video|audio|canvas"
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section select summary table tbody td tfoot th thead tr ul button".split())
CONTAINERS = frozenset(
    "article aside button details dialog div dl fieldset figure footer form header main menu nav ol search section select table "
    "ul td span p h1 h2 h3 h4 h5 h6 li blockquote".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK_TAGS - {"body", "html", "head", "button", "option", "optgroup", "select", "td", "th", "tr", "tbody", "thead", "tfoot"}
NOT_TEXT = frozenset("aside button dialog footer form menu nav search select".split())  # never part of an article
MAIN_TAGS = frozenset(("article", "main"))
# Words in classes, ids and roles, and what they say of a container.
NEVER = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion comment comments reply "
    "replies respond disqus related recommended recommendations cookie cookies consent gdpr popup modal overlay newsletter subscribe "
    "subscription share sharing social notice notices notification alert complementary contentinfo search login signup".split())
LAYOUT = frozenset(
    "nav navbar navigation navi menu menubar sidebar side footer header breadcrumb breadcrumbs crumbs pagination pager paging toolbar "
    "widget widgets masthead topbar topnav bottom skip legal copyright banner tags meta toc".split())
MAIN_NAMES = frozenset("article content main post entry story articlebody text body".split())

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    rf"|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"'=]|=\s*(?:\"[^\"]*\"|'[^']*')?|[\"'])*+)>"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-z/][^<>]*\Z", re.I | re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?=[\s=/]|$)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
CAMEL = re.compile(r"([a-z])([A-Z])")
LETTERS = re.compile(r"[a-z]+")
FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after",
            "in_article", "boilerplate", "heading", "outside_article")


def _names(attributes: str) -> tuple[set[str], bool]:
    """The words of class, id and role, and whether the element is hidden."""
    words, hidden = set(), False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        else:
            words.update(LETTERS.findall(CAMEL.sub(r"\1 \2", value).lower()))
    return words, hidden


def _inside(tag: str, attributes: str, article: int, junk: int) -> tuple[int, int]:
    """Whether a container's text is of an article, and how surely it is boilerplate (0, 1, 2)."""
    words, hidden = _names(attributes) if attributes and not attributes.isspace() else ((), False)
    if tag in NOT_TEXT or hidden or (words and not NEVER.isdisjoint(words)):
        return article, 2
    if tag in MAIN_TAGS:
        return 1, 2 if junk == 2 else 0
    if tag == "header":
        return article, junk or 1 - article
    if words and not LAYOUT.isdisjoint(words):
        return article, max(junk, 1)
    if words and tag in ("div", "section", "td") and not MAIN_NAMES.isdisjoint(words) and not junk:
        return 1, 0
    return article, junk


def blocks(page: str) -> list[tuple[str, int, int, int, int, int]]:
    """The flat blocks of a page: text, words, words in links, in article, boilerplate, heading."""
    out, parts = [], []
    links = 0  # words inside links of the block at hand
    stack: list[tuple[str, int, int]] = []
    article = junk = heading = linked = 0
    at = 0

    def close() -> None:
        nonlocal links
        words = "".join(parts).split()
        if words:
            out.append((" ".join(words), len(words), min(links, len(words)), article, junk, heading))
        parts.clear()
        links = 0

    def take(raw: str) -> None:
        nonlocal links
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if linked:
            links += len(text.split())

    def back_to(depth: int) -> None:
        nonlocal article, junk, heading
        del stack[depth:]
        article, junk = stack[-1][1:] if stack else (0, 0)
        heading = int(any(s[0] in HEADINGS for s in stack[-3:]))

    for token in TOKEN.finditer(page):
        if token.start() > at:
            take(page[at : token.start()])
        at = token.end()
        name = token[3]
        if name is None:
            if token[1]:  # a raw element ends no word
                parts.append(" ")
            continue
        name = name.lower()
        if name == "a":
            linked = 0 if token[2] else 1
            continue
        if name == "br":
            parts.append(" ")
            continue
        block = name in BLOCK_TAGS
        if token[2]:  # closing
            if block:
                close()
                linked = 0 if name in ("li", "nav", "td", "div") else linked
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    if not block and junk == 2:
                        close()
                    back_to(depth)
                    break
                if not block and stack[depth][0] in BLOCK_TAGS:
                    break  # an inline end tag closes nothing outside its block
        else:
            if block:
                close()
                if name in CLOSES_P and stack and stack[-1][0] == "p":
                    back_to(len(stack) - 1)
                elif name == "li" and stack and stack[-1][0] == "li":
                    back_to(len(stack) - 1)
            attributes = token[4]
            if name in CONTAINERS and name not in VOID and not (name == "span" and not attributes):
                inside = _inside(name, attributes, article, junk)
                if not block and inside[1] == 2 and junk < 2:
                    close()  # inline, but hidden or named as boilerplate: a block of its own
                article, junk = inside
                stack.append((name, article, junk))
                heading = int(heading or name in HEADINGS)
    if at < len(page):
        take(page[at:])
    close()
    return out


def features(found: list[tuple]) -> np.ndarray:
    """One row per block in the order of ``FEATURES``; beyond the page there are no words."""
    rows = np.zeros((len(found), len(FEATURES)))
    if not found:
        return rows
    table = np.array([b[1:] for b in found], float)
    density = table[:, 1] / table[:, 0]
    rows[:, 0], rows[:, 1] = table[:, 0], density
    rows[1:, 2], rows[1:, 3] = table[:-1, 0], density[:-1]
    rows[:-1, 4], rows[:-1, 5] = table[1:, 0], density[1:]
    rows[:, 6:9] = table[:, 2:5]
    rows[:, 9] = (table[:, 2] == 0) & (table[:, 2] > 0).any()
    return rows


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH):
    """A decision tree: (feature, limit, tree at or below, tree above), or the share of main text in a leaf."""
    if depth == 0 or len(y) < 2 * LEAST or y.min() == y.max():
        return float(y.mean())
    best = (None,)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        value, label = x[order, f], y[order]
        n = np.arange(1, len(y))
        ones, all_ones = np.cumsum(label)[:-1], label.sum()
        cut = (value[1:] > value[:-1]) & (n >= LEAST) & (len(y) - n >= LEAST)
        if not cut.any():
            continue
        left, right = ones / n, (all_ones - ones) / (len(y) - n)
        impure = n * left * (1 - left) + (len(y) - n) * right * (1 - right)
        impure[~cut] = np.inf
        i = int(np.argmin(impure))
        if best[0] is None or impure[i] < best[0] - 1e-12:
            best = (impure[i], f, (value[i] + value[i + 1]) / 2)
    if best[0] is None or best[0] > len(y) * y.mean() * (1 - y.mean()) - 1e-9:
        return float(y.mean())
    low = x[:, best[1]] <= best[2]
    return best[1], float(best[2]), grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def main_blocks(tree, x: np.ndarray) -> np.ndarray:
    """Which rows of ``x`` the tree takes for main text."""
    out = np.zeros(len(x), bool)

    def walk(node, rows):
        if not isinstance(node, tuple):
            out[rows] = node >= 0.5
        elif len(rows):
            low = x[rows, node[0]] <= node[1]
            walk(node[2], rows[low])
            walk(node[3], rows[~low])

    walk(tree, np.arange(len(x)))
    return out


# The labelled table: pages in short form, {n} n words of main text, [n] n words of anything else.
LABELLED = (
    "<title>[6]</title><nav><ul><li><a>[1]</a><li><a>[1]</a><li><a>[2]</a></ul></nav><div class=ad>[7]</div><article><h1>{9}</h1>"
    "<p>{60}<p>{1}<p>{35}<p>{3}<p>{1}</article><footer>[9]</footer>",
    "<nav><a>[1]</a></nav><div class=ad>[12]</div><main><h1>{1}</h1><p>{120}</p><p>{2}</p></main><footer>[14]</footer>",
    "<header><h2><a>[3]</a></h2><p>[8]</p></header><main><article><header><h1>{7}</h1><p>{5}</p></header><p>{80}</p><h2>{4}</h2><p>{44}</p>"
    "<ul><li>{5}<li>{7}<li>{3}</ul><footer>[8]</footer></article><aside><h3>[2]</h3><p>[25]</p><ul><li><a>[5]</a><li><a>[6]</a></ul></aside>"
    "</main><footer><p>[30]</p></footer>",
    "<div id=header><a>[2]</a> [5]</div><div id=menu><a>[1]</a><a>[1]</a></div><div id=content><h1>{6}</h1><p>{50}</p><p>{9}</p><p>{70}</p></div>"
    "<div id=sidebar><h3>[2]</h3><p>[20]</p></div><div id=footer>[10]</div>",
    "<div><a>[1]</a> <a>[1]</a> <a>[2]</a></div><div><h1>{8}</h1><div>{75}</div><div>{42}</div><div>{6}</div><div>{66}</div></div>"
    "<div><a>[3]</a></div><div><a>[4]</a></div><div>[7]</div>",
    "<table><tr><td><a>[2]</a><td><a>[1]</a><td><a>[2]</a></table><table><tr><td>{90}<td><a>[3]</a><br><a>[2]</a></table><p>[6]",
    "<article><h1>{5}</h1><p>{30}</p><div class=advert>[15]</div><p>{28}</p><div class=share><a>[1]</a><a>[1]</a></div><p>{4}</p>"
    "<section class=comments><h2>[2]</h2><article><p>[22]</p></article><article><p>[40]</p></article><form>[6]</form></section></article>",
    "<div class='cookie notice'><p>[24]</p><button>[2]</button></div><article><h1>{4}</h1><p>{15}</p><p>{5}</p></article>"
    "<section class=related><h2>[2]</h2><ul><li><a>[7]</a><li><a>[9]</a></ul></section><form><label>[2]</label><p>[14]</p></form>",
    "<p><a>[1]</a> | <a>[1]</a> | <a>[1]</a></p><h1>{6}</h1><p>{55}</p><p>{60}</p><h2>{3}</h2><p>{48}</p><blockquote>{25}</blockquote><p>{52}</p>"
    "<p><a>[4]</a></p><p><a>[5]</a></p><p>[5]</p>",
    "<main><h1>{3}</h1><p>{18} <a>{6}</a> {10}</p><p><a>{9}</a></p><p>{21}</p><nav><a>[1]</a> <a>[1]</a></nav></main><aside><p>[60]</p></aside>",
    "<article><h1>{10}</h1><ul><li><a>{3}</a><li><a>{4}</a></ul><table><tr><td>{1}<td>{1}<tr><td>{2}<td>{1}</table><figure><figcaption>{7}"
    "</figcaption></figure><p>{33}</p><pre>{20}</pre><aside><p>[18]</p></aside><div class=newsletter><p>[11]</p></div></article><p>[9]</p>",
    "<div class=topbar>[4]</div><div class=post><h2>{6}</h2><div class=meta>[5]</div><p>{65}</p><p>{2}</p></div><div class=comments>"
    "<p>[50]</p><p>[35]</p></div><div class=widget><a>[3]</a></div><p>[40]</p>",
    "<p>[3]</p><p>[2]</p><article><p>{40}</p><p>{3}</p></article><p>[30]</p><p>[5]</p>",
    "<p>{85}</p><p>{40}</p><p>{12}</p><p>{50}</p>",
    "<p>{30}</p><p>{45}</p>",
    "<h1>{4}</h1><p>{14}</p><p>{70}</p><ul><li><a>[2]</a><li><a>[2]</a><li><a>[3]</a></ul>",
    "<div><div><a>[2]</a></div><div><a>[2]</a></div></div><div>{110}</div><div>{16}</div><div>{95}</div><div><a>[2]</a> [3]</div><div>[4]</div>",
    "<nav>[12]</nav><aside>[70]</aside><main><p>{25}</p></main><footer><p>[50]</p><p>[4]</p></footer>",
    "<form><p>[40]</p></form><dialog><p>[30]</p></dialog><article><h2>{2}</h2>{14}<p>{26}</p></article><menu><li>[2]<li>[3]</menu>",
    "<div class=sidebar><p>[45]</p></div><div class=breadcrumb><a>[1]</a> [1] <a>[1]</a></div><article><p>{64}</p><h3>{5}</h3></article>",
    "<div class=navbar>[6]</div><div><p>{70}</p><p>{30}</p></div><div class=footer><p>[30]</p><p>[12]</p></div>",
    "<div><p>[20]</p><p>[8]</p></div><main><h1>{5}</h1><p>{40}</p><p>{12}</p></main><div><p>[15]</p><p>[9]</p><p>[22]</p><p>[6]</p></div>",
    "<div>[6]</div><div>[14]</div><article><p>{22}</p><p>{6}</p><p>{30}</p></article><div>[12]</div><div>[25]</div><div>[8]</div>",
    "<p>[30]</p><p>[24]</p><article><h1>{3}</h1><p>{9}</p></article><p>[40]</p><p>[33]</p><p>[18]</p>",
    "<p><a>[1]</a></p><p><a>[2]</a></p><h1>{5}</h1><p>{34}</p><p>{22}</p><h3>{2}</h3><p>{18}</p><p>{38}</p><p><a>[3]</a></p><p><a>[2]</a></p><p>[4]</p>",
    "<div><a>[1]</a> <a>[2]</a></div><h2>{7}</h2><div>{28}</div><div>{3}</div><div>{24}</div><div>{40}</div><div>[6] <a>[3]</a></div><div><a>[1]</a></div>",
    "<p><a>[2]</a></p><p><a>[2]</a></p><p><a>[1]</a></p><p>{26}</p><p>{30} <a>{3}</a> {8}</p><p>{20}</p><div><a>[5]</a></div><div>[8]</div><div>[3]</div>",
    "<div>[3]</div><div><a>[2]</a></div><div><a>[2]</a></div><h1>{4}</h1><p>{45}</p><p>{32}</p><p>{27}</p><div><a>[2]</a></div><div>[2]</div>",
    "<article><p>{7}</p></article>",
    "<article>{2}</article>",
    "<article><h1>{3}</h1><p>{4}</p></article>",
    "<main><p>{2}</p><p>{1}</p></main>",
    "<nav><a>[1]</a></nav><article><p>{30}</p><p>{2}</p><p>{1}</p></article>",
    "<nav><a>[1]</a></nav><article><p>{3}</p><p>{2}</p></article>",
    "<article><p><a>{2}</a></p><p>{1}</p></article>",
    "<article><p>{1}</p><div class=ad>[3]</div><p>{1}</p><p><a>{1}</a></p></article><div class=comments>[3]</div>",
    "<div class=sponsored><p>[60]</p></div><div><p>{55}</p><p>{62}</p></div><div class=legal>[45]</div>",
)


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: main text) of the labelled table's blocks."""
    rows, labels = [], []
    for short in LABELLED:
        page = re.sub(r"[\[{](\d+)([\]}])", lambda m: " ".join(["main" if m[2] == "}" else "other"] * int(m[1])), short)
        found = blocks(page)
        rows.append(features(found))
        labels += [float(b[0].startswith("main")) for b in found]
    return np.concatenate(rows), np.array(labels)


def trained_tree():
    return grow(*labelled_blocks())


def main_text(page: str | None, tree) -> str:
    found = blocks(page or "")
    keep = main_blocks(tree, features(found))
    return "\n".join(b[0] for b, k in zip(found, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    import pyarrow as pa

    prepare(pages.sparkSession)
    tree = trained_tree()

    def read(batches):
        for batch in batches:
            texts = [main_text(page, tree) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"),
                        pages["html"].cast("string").alias("html"))
    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")
