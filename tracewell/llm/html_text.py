"""Main text of web pages by tag-path ratios.

A page is a sequence of text nodes, each with the path of open tags from the
root. Per path, text length and punctuation are summed and divided by the number
of nodes; both ratios are smoothed over paths with the same parent, fused into
one score, and compared with a threshold from the page itself. The nodes of the
paths above it show where the content is: every ``article`` and ``main`` with some
of them if these hold half of the content, or else the innermost sectioning tag
around all of them that has no text of its own. All blocks of those containers
are kept, and content paths outside, except what is never content by its tag,
role, style, class or id (menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles, reader comments). A class or id counts if it says nothing
else, and not on what holds the article. Where the container is no article,
blocks without a content path go too if they are links for the most part or come
behind all content. Sections of the page and cells of a row carry their place in
the path, so that a menu and prose under like tags are different paths.

White space in a block becomes one space, character references are decoded,
blocks are joined by a newline in page order.

Cases: null or empty html, and pages without content, give empty text; broken
markup is read as far as it goes (an unclosed tag ends with its container); a
page without ``article`` or ``main`` is judged by its paths alone. Repeated rows
are handled each for itself; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of HTML: tags that start or end a block, and tags without an end.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset(
    "nav header footer aside form script style noscript template button select textarea iframe svg head "
    "title menu dialog object audio video canvas".split()
)
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion "
    "promotions nav navbar navigation menu menus sidebar sidebars sidenav header masthead footer breadcrumb "
    "breadcrumbs cookie cookies consent gdpr notice notices banner banners popup popups modal modals newsletter "
    "subscribe subscription share sharing social related comment comments commentlist respond replies disqus "
    "widget widgets toolbar pagination pager skip login signup".split()
)
#: Parts that a name may be compounded with: site-header, comments_list, ad-2. Others (no-, has-, -work) make it another name.
BESIDE = frozenset(
    "site page main top bottom left right global primary secondary sub mobile sticky fixed area bar box block "
    "wrapper wrap container list section inner outer links buttons link form count thread posts post articles".split()
)
COMMENTS = frozenset("comment comments commentlist respond replies disqus".split())
TOKEN_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[^-_\sA-Za-z]+")
UNSEEN = re.compile(r"style\s*=\s*(?:\"[^\"]*|'[^']*)(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
#: What may stand in a head; any other tag ends it.
HEAD = frozenset("head title meta link script style base noscript template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags whose place among the page's sections or a row's cells is part of the path.
PLACED = frozenset("center div section td".split())
#: Tags that may be the container of a page without articles.
SECTIONS = frozenset("article body center div html main section td".split())
CLOSES_P = BLOCKS - {"body", "html", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"}
PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?"
    r"|[^<]+|<",
    re.S,
)
NAMED = re.compile(r"""(?:^|\s)(role|class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
RAW = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.I) for tag in ("script", "style", "textarea", "title", "noscript", "iframe")}
PUNCTUATION = re.compile(r"[.,;:!?…]")
SCHEMA = "page_id long, url string, text string, n_chars long"


def _is_name(token: str, names: frozenset) -> bool:
    """Does a class or id say nothing but one of these names?"""
    parts = [p.lower() for p in TOKEN_PARTS.findall(token) if p[0].isalpha()]
    return any(p in names for p in parts) and all(p in names or p in BESIDE for p in parts)


def _never(tag: str, attributes: str) -> tuple[bool, bool]:
    """Is it no content by its tag, role or style? And is it said to be none by its class or id?"""
    if tag in NEVER:
        return True, False
    if not attributes or tag in ("html", "body"):
        return False, False
    if "hidden" in attributes.split() or UNSEEN.search(attributes):
        return True, False
    named, names = False, COMMENTS if tag in ("article", "main") else NAMES
    for name, a, b, c in NAMED.findall(attributes):
        value = a or b or c
        if name.lower() == "role":
            if value.strip().lower() in NEVER_ROLES:
                return True, False
        elif any(_is_name(token, names) for token in value.split()):
            named = True
    return False, named


class _Open:
    __slots__ = ("tag", "never", "number", "path", "named", "inner")

    def __init__(self, tag, never, number, path, named=False):
        self.tag, self.never, self.number, self.path, self.named, self.inner = tag, never, number, path, named, 0


def text_nodes(page: str) -> list[tuple[int, list[_Open], str]]:
    """(block number, open tags, text) of every text node that may be content."""
    root = _Open("", False, 0, "")
    stack, nodes, block, number, at = [root], [], 0, 0, 0

    def close(tag: str, stop: frozenset = frozenset()) -> bool:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                del stack[k:]
                return True
            if stack[k].tag in stop:
                break
        return False

    while at < len(page):
        m = PIECE.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if page[m.start()] == "<" and m.end() - m.start() > 1:
                if not m[0].startswith("<![CDATA["):
                    continue
                words = m[0][9:].removesuffix("]]>")
            else:
                words = html_lib.unescape(m[0])
            if not stack[-1].never and words:
                nodes.append((block, stack[:], words))
            continue
        tag, ending, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in BLOCKS:
            block += 1
        if ending:
            if tag in BLOCKS or tag not in VOID:
                # an inline end tag does not reach beyond its block
                close(tag, frozenset() if tag in BLOCKS else BLOCKS)
            continue
        if tag == "br":
            if not stack[-1].never:
                nodes.append((block, stack[:], " "))
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            close("p", BLOCKS - {"p"})
        if tag in ("li", "dt", "dd", "option", "tr", "td", "th"):
            close(tag, frozenset({"ul", "ol", "dl", "table", "select"}))
        if tag in RAW:
            end = RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag not in HEAD:
            close("head")
        number += 1
        top = stack[-1]
        never, named = _never(tag, attributes)
        if tag in ("h1", "main", "article") and not (never or named):
            for around in stack:
                around.named = False  # what holds the article is no sidebar, whatever it is called
        top.inner += 1
        place = f"[{top.inner}]" if tag in PLACED and top.tag in ("", "html", "body", "tr") else ""
        stack.append(_Open(tag, top.never or never, number, f"{top.path}/{tag}{place}", named))
    return [node for node in nodes if not any(tag.named for tag in node[1])]


def path_scores(nodes) -> dict[str, float]:
    """The fused score of each path: smoothed text ratio times smoothed punctuation ratio."""
    count, chars, marks = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, stack, words in nodes:
        path = stack[-1].path
        if size := len(words.strip()):
            count[path] += 1
            chars[path] += size
            marks[path] += len(PUNCTUATION.findall(words))
    parents = defaultdict(list)
    for path in count:
        parents[path.rpartition("/")[0]].append(path)
    scores = {}
    for path, n in count.items():
        near = parents[path.rpartition("/")[0]]
        nodes_near = sum(count[x] for x in near)
        text = (chars[path] / n + sum(chars[x] for x in near) / nodes_near) / 2
        punctuation = (marks[path] / n + sum(marks[x] for x in near) / nodes_near) / 2
        scores[path] = math.log1p(text) * math.log1p(1 + punctuation)
    return scores


def main_text(page: str | None) -> str:
    if not page:
        return ""
    nodes = text_nodes(page)
    scores = path_scores(nodes)
    if not scores:
        return ""
    weight = defaultdict(int)
    for _, stack, words in nodes:
        weight[stack[-1].path] += len(words.strip())
    total = sum(weight[x] for x in scores)
    mean = sum(scores[x] * weight[x] for x in scores) / total
    spread = math.sqrt(sum(weight[x] * (scores[x] - mean) ** 2 for x in scores) / total)
    # where one path has nearly all text there is no spread; prose of a few lines is content beside it
    content = {x for x in scores if scores[x] >= min(mean - spread, mean / 3)}
    keep = _containers(nodes, content)
    lines, block_now = [], None
    for block, stack, words in nodes:
        if not keep(stack):
            continue
        if block != block_now:
            lines.append([])
            block_now = block
        lines[-1].append(words)
    texts = (" ".join("".join(line).split()) for line in lines)
    return "\n".join(text for text in texts if text)


def _containers(nodes, content: set[str]):
    """A test of open tags: inside what holds the content?"""
    held, inside, total = defaultdict(int), 0, 0
    spine, holders = None, set()
    for _, stack, words in nodes:
        if not (size := len(words.strip())):
            continue
        holders.add(next((tag.number for tag in reversed(stack) if tag.tag in BLOCKS), 0))
        if stack[-1].path in content:
            total += size
            around = {tag.number for tag in stack if tag.tag in ("article", "main")}
            inside += size if around else 0
            for number in around:
                held[number] += size
            shared = stack if spine is None else [a for a, b in zip(spine, stack, strict=False) if a is b]
            spine = shared
    if held and 2 * inside >= total:
        return lambda stack: stack[-1].path in content or any(tag.number in held for tag in stack)
    number = next((tag.number for tag in reversed(spine) if tag.tag in SECTIONS and tag.number not in holders), 0)
    dropped = _bare_blocks(nodes, content, number)
    return lambda stack: any(tag.number == number for tag in stack) and not any(tag.number in dropped for tag in stack)


def _bare_blocks(nodes, content: set[str], number: int) -> set[int]:
    """Blocks in a container without any content path that are links for the most part, or come behind all content."""
    held, last = set(), 0
    for k, (_, stack, words) in enumerate(nodes):
        if stack[-1].path in content and words.strip():
            held.update(tag.number for tag in stack)
            last = k
    size, links, late = defaultdict(int), defaultdict(int), defaultdict(lambda: True)
    for k, (_, stack, words) in enumerate(nodes):
        bare = next((tag for tag in stack if tag.number not in held and tag.tag in BLOCKS), None)
        if bare is None or bare.tag in HEADINGS or not any(tag.number == number for tag in stack):
            continue
        n = len(words.strip())
        size[bare.number] += n
        links[bare.number] += n if any(tag.tag == "a" for tag in stack) else 0
        late[bare.number] &= k > last
    return {x for x in size if late[x] or 2 * links[x] >= size[x] > 0}


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py()) for page in batch.column("html")]
        sizes = [len(text) for text in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points of the text) of every page."""
    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(_extract, SCHEMA)
