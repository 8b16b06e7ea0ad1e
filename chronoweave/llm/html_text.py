"""Main text of web pages by site template removal.

Each page is parsed into elements; every element's subtree, anywhere on the page, has a hash of its place (the path of
tags and class names above it), tags and text. Hashes are counted per host over all pages (pages of the same main text
count once, so copies of an article are no evidence against it), and subtrees that recur in one place on pages with
different articles are deleted as the host's template. What is left goes through the usual signs of a page's furniture
(tags, roles, names), and the text of the article's blocks is joined.

A sentence that several articles share isn't a template: inside an article element (or main), headings, paragraphs,
other running text and what stands in it go only with a box (div, section, list, table) that recurs as a whole, and the
article element itself stays. An inline element amid running text is counted in its block's subtree and not by itself:
a sentence loses no words.

The two passes are one parse each. Between them travel a row per page with its subtrees' hashes, and back only the
hashes to delete, by page; hot hosts and hot subtrees are counted by partial sums.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

#: A subtree is template if it recurs in one place of so many pages of its host, with as many different main texts,
#: however many pages the host has.
MIN_PAGES = 3

# Fixed values of HTML: elements without content, elements whose text isn't shown, elements of a page's furniture,
# blocks, and elements that a block's start tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSHOWN = frozenset("script style noscript template iframe object svg math canvas audio video head title select option datalist textarea button dialog".split())
FURNITURE = frozenset("nav header footer aside form menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSED_BY_BLOCK = frozenset("p".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = frozenset("ul ol dl table tbody thead tfoot body html div section article main select".split())
ARTICLES = frozenset("article main".split())
#: Elements that may be a template's box inside an article; everything else there is its running text.
BOXES = frozenset("div section ul ol dl menu table figure details fieldset form aside nav header footer address center dir".split())

#: Names (class, id, role, aria-label) that mark furniture: whole words between separators.
MARKS = re.compile(
    r"(?:^|[\s_\-:])(?:ad|ads|advert|adverts|advertisement|advertising|adbox|adslot|sponsor|sponsored|promo|promotion|banner|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|"
    r"sidebar|side-bar|aside|widget|footer|header|masthead|topbar|cookie|cookies|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|"
    r"comment|comments|commentlist|disqus|respond|reply|replies|discussion|share|sharing|social|related|recommended|recommendations|more-stories|pagination|pager|search|searchbox|"
    r"complementary|contentinfo|toolbar|skip-link|tags|byline-share|legal|copyright|disclaimer)(?:$|[\s_\-:])",
    re.I,
)
#: Names that keep an element whatever its other names: the article itself.
KEEPS = re.compile(r"(?:^|[\s_\-:])(?:article|article-body|articlebody|post-body|post-content|entry-content|main-content|story-body)(?:$|[\s_\-:])", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar dialog alert alertdialog form".split())
_DIGITS = re.compile(r"[0-9]+")


class _Node:
    __slots__ = ("tag", "kids", "drop", "shown", "digest", "length", "step")

    def __init__(self, tag: str, drop: bool, shown: bool = True, step: str = ""):
        self.tag, self.drop, self.shown, self.kids, self.step = tag, drop, shown, [], step
        self.digest, self.length = b"", 0


def _furniture(tag: str, attrs: list, inside_article: bool) -> bool:
    if tag in UNSHOWN:
        return True
    if tag == "header" and inside_article:
        return False  # an article's header has its title
    if tag in FURNITURE:
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    names = []
    for k, v in attrs:
        if k == "hidden" or (k == "aria-hidden" and (v or "").lower() == "true"):
            return True
        if k == "style" and v and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I):
            return True
        if k == "role" and (v or "").lower().strip() in _ROLES:
            return True
        if k in ("class", "id") and v:
            names.append(v)
    names = " ".join(names)
    return bool(names) and not KEEPS.search(names) and bool(MARKS.search(names))


def _step(tag: str, attrs: list) -> str:
    """An element's part of a path: tag and class names, without the numbers that sites put into them."""
    names = next((v for k, v in attrs if k == "class" and v), "")
    return f"{tag} {_DIGITS.sub('', names)}" if names else tag


def _drops(tag: str, attrs: list) -> tuple[bool, bool]:
    """Whether an element is furniture outside and inside an article."""
    out = _furniture(tag, attrs, False)
    return out, _furniture(tag, attrs, True) if tag == "header" else out


#: Start and end tags in the plain form that most have, and what such start tags say: sites repeat them on every page.
#: Other forms, and elements whose content is no markup, are the parser's own.
_PLAIN = re.compile(r'<([A-Za-z][A-Za-z0-9]*)((?: [A-Za-z][A-Za-z\-]*="[^"<>&]*")*) ?(/?)>')
_PLAIN_ATTR = re.compile(r' ([A-Za-z\-]+)="([^"]*)"')
_PLAIN_END = re.compile(r"</([A-Za-z][A-Za-z0-9]*)>")
_OWN = UNSHOWN | frozenset("xmp noembed noframes plaintext".split())
_said: dict[str, tuple] = {}
_SAID, _SAID_LENGTH = 4096, 256


class _Tree(HTMLParser):
    """A forgiving tree: unclosed elements end with their parent, stray end tags are passed over."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("html", False)
        self.stack = [self.root]
        self.articles = 0

    def _pop(self) -> None:
        if self.stack.pop().tag in ("article", "main"):
            self.articles -= 1

    def updatepos(self, i, j):
        return j  # lines aren't counted

    def parse_starttag(self, i):
        m = _PLAIN.match(self.rawdata, i) if self.cdata_elem is None else None
        if m is None or m.end() - i > _SAID_LENGTH:
            return super().parse_starttag(i)
        said = _said.get(m[0])
        if said is None:
            tag = m[1].lower()
            if tag in _OWN:
                return super().parse_starttag(i)
            attrs = [(k.lower(), v) for k, v in _PLAIN_ATTR.findall(m[2])]
            if len(_said) >= _SAID:
                _said.clear()
            said = _said[m[0]] = tag, _drops(tag, attrs), _step(tag, attrs), bool(m[3])
        tag, drops, step, empty = said
        self._begin(tag, drops, step)
        if empty and tag in ("path", "g"):
            self.handle_endtag(tag)
        return m.end()

    def parse_endtag(self, i):
        m = _PLAIN_END.match(self.rawdata, i) if self.cdata_elem is None else None
        if m is None:
            return super().parse_endtag(i)
        self.handle_endtag(m[1].lower())
        return m.end()

    def handle_starttag(self, tag, attrs):
        self._begin(tag, _drops(tag, attrs), _step(tag, attrs))

    def _begin(self, tag: str, drops: tuple[bool, bool], step: str) -> None:
        if tag in ("html", "body"):
            return
        if tag in BLOCKS:
            for at in range(len(self.stack) - 1, 0, -1):
                open_ = self.stack[at].tag
                if open_ in CLOSED_BY_BLOCK and tag != "br" or open_ in SAME_CLOSES.get(tag, ()):
                    while len(self.stack) > at:
                        self._pop()
                    if tag not in SAME_CLOSES:
                        break
                elif open_ in BLOCKS and (open_ in STOPS or tag not in SAME_CLOSES):
                    break
        node = _Node(tag, drops[self.articles > 0], tag not in UNSHOWN, step)
        self.stack[-1].kids.append(node)
        if tag not in VOID:
            self.stack.append(node)
            if tag in ("article", "main"):
                self.articles += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("script", "style") and tag in ("svg", "math", "path", "g"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].tag == tag:
                while len(self.stack) > at:
                    self._pop()
                return
            if self.stack[at].tag in ("article", "main", "td", "th") and tag not in BLOCKS:
                return

    def handle_data(self, data):
        self.stack[-1].kids.append(data)


    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # "<![" and no section that the parser knows: a comment up to ">", as in browsers
            return self.parse_bogus_comment(i)


def parse(html: str | None) -> _Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def _walk(root: _Node):
    """Nodes with text that a page can show, children first, without recursion (pages may nest thousands deep)."""
    stack = [(root, False)]
    while stack:
        node, done = stack.pop()
        if done:
            yield node
        else:
            stack.append((node, True))
            stack.extend((k, False) for k in node.kids if isinstance(k, _Node) and k.shown)


def _hash_tree(root: _Node) -> None:
    """Digests and text lengths of all subtrees; furniture is part of them."""
    for node in _walk(root):
        h = xxhash.xxh64(node.tag)
        length = 0
        for k in node.kids:
            if isinstance(k, str):
                if text := " ".join(k.split()):
                    h.update(b"\x01" + text.encode("utf-8", "replace"))
                    length += len(text)
            elif k.shown:
                h.update(b"\x02" + k.digest)
                length += k.length
        node.digest, node.length = h.digest(), length


def _has_text(root: _Node) -> bool:
    """Whether an element has text besides furniture."""
    stack = [root]
    while stack:
        for k in stack.pop().kids:
            if isinstance(k, str):
                if not k.isspace() and k:
                    return True
            elif not k.drop:
                stack.append(k)
    return False


def main_root(root: _Node) -> list[_Node]:
    """The elements that hold the article: the outermost article elements, else main, else the page."""
    for wanted in ("article", "main"):
        found, stack = [], [root]
        while stack:
            node = stack.pop()
            if node.tag == wanted and not node.drop:
                if _has_text(node):
                    found.append(node)
                continue
            stack.extend(k for k in reversed(node.kids) if isinstance(k, _Node) and not k.drop)
        if found:
            return found
    return [root]


def template_candidates(root: _Node) -> set[bytes]:
    """Hashes of all elements with text, with their places: what is counted."""
    _hash_tree(root)
    return {key for _, key, _ in _units(root)}


def _units(root: _Node):
    """Elements below root that are counted, blocks and inline elements that aren't amid running text; their hashes with
    place; and whether each goes if it recurs: not what is furniture or in it, which goes anyway, nor an article, nor
    what isn't a box inside one."""
    stack = [(root, False, False, False, b"")]
    while stack:
        node, amid, dropped, article, path = stack.pop()
        kids = [k for k in node.kids if isinstance(k, _Node) and k.shown and k.length]
        if kids:
            amid = (amid and node.tag not in BLOCKS) or any(isinstance(k, str) and not k.isspace() for k in node.kids)
            article = article or node.tag in ARTICLES
            for k in kids:
                out = dropped or k.drop
                here = xxhash.xxh64_digest(path + k.step.encode("utf-8", "replace"))
                if k.tag in BLOCKS or not amid:
                    yield k, xxhash.xxh64_digest(here + k.digest), not out and (k.tag in BOXES if article else k.tag not in ARTICLES)
                stack.append((k, amid, out, article, here))


def main_text(root: _Node, template: frozenset | set = frozenset()) -> str:
    """The article's text without subtrees of the template: blocks in page order, white space inside a block turned
    into one space, joined by one."""
    deleted: set[int] = set()
    if template:
        _hash_tree(root)
        deleted = {id(node) for node, key, goes in _units(root) if goes and key in template}
    blocks: list[str] = []
    open_: list[str] = []

    def end() -> None:
        if text := " ".join("".join(open_).split()):
            blocks.append(text)
        open_.clear()

    for top in main_root(root):
        stack: list = [top]
        while stack:
            item = stack.pop()
            if item is None:
                end()
            elif isinstance(item, str):
                open_.append(item)
            elif not item.drop and id(item) not in deleted:
                block = item.tag in BLOCKS
                if block:
                    end()
                    stack.append(None)
                stack.extend(reversed(item.kids))
        end()
    return " ".join(blocks)


def host(url: Column) -> Column:
    """The host of a URL, lower-cased; null or odd URLs share the host ''."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, keys, texts, hashes = batch.column(0), batch.column(1), [], []
        for html in batch.column(2).to_pylist():
            root = parse(html)
            texts.append(xxhash.xxh3_128_digest(main_text(root).encode("utf-8", "replace")))
            hashes.append([int.from_bytes(x, "big", signed=True) for x in template_candidates(root)])
        yield pa.RecordBatch.from_arrays([hosts, keys, pa.array(texts, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))], ["host", "page_key", "main_text", "subtrees"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, urls, pages, drops = (batch.column(c).to_pylist() for c in range(4))
        texts = [main_text(parse(html), {x.to_bytes(8, "big", signed=True) for x in drop or ()}) for html, drop in zip(pages, drops, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, scratch: Scratch | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    A null or empty html has an empty text; a null url is of a host without a name; repeated rows are extracted each;
    an empty table gives an empty result; other columns aren't read.
    """
    scratch = scratch or Scratch(pages.sparkSession, "html")
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    key = F.unhex(F.md5(F.concat_ws("\x00", host(F.col("url")), F.coalesce("html", F.lit("")))))
    keyed = narrow.withColumn("host", host(F.col("url"))).withColumn("page_key", key)
    found = scratch.table(keyed.select("host", "page_key", "html").mapInArrow(_candidates, "host string, page_key binary, main_text binary, subtrees array<long>"), "subtrees")
    each = found.select("host", "page_key", "main_text", F.explode("subtrees").alias("subtree"))
    # pages of a host with the same main text count once, whatever stands around it
    counted = each.select("host", "main_text", "subtree").distinct().groupBy("host", "subtree").agg(F.count("*").alias("n"))
    template = scratch.table(counted.where(F.col("n") >= min_pages).select("host", "subtree"), "template")
    if template.limit(1).count() == 0:
        done = narrow.withColumn("drops", F.lit(None).cast("array<long>"))
    else:
        drops = each.join(template, ["host", "subtree"]).groupBy("page_key").agg(F.collect_set("subtree").alias("drops"))
        done = keyed.join(drops, "page_key", "left")
    return done.select("page_id", "url", "html", "drops").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
