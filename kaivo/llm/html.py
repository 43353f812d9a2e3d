"""Main text of web pages by equivalence-class template deduction.

Pages of one host are compared in groups. Each page becomes a sequence of tokens: tags with their path, and
text blocks with their path. Tokens that occur equally often on each page of the group share an occurrence
vector and so form an equivalence class. Classes that occur on most pages, in one order and properly nested,
are the host's template; what lies between neighbouring template tokens are a page's slots. Text that is itself a
template token (a menu, a notice on every page) is in no slot, and of the slots those inside the host's
content element are extracted, without blocks that their elements mark as something else: that is left to
names where a template can't tell, as with comments. Copies of one content count as one page, and template text never
fills a whole slot. A host with too few contents has no template: there the page is one slot, and names alone decide.
"""

from __future__ import annotations

import html
import pickle
import re
import tempfile
from bisect import bisect
from collections import Counter, defaultdict
from collections.abc import Hashable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kaivo.llm.scratch import bounded, small, written

#: Different pages of a host that are compared with each other: all up to 2 * GROUP, else on average from GROUP to 2 * GROUP, whatever
#: their size; beyond BYTES their blocks lie in a temporary file.
GROUP, BYTES = 64, 1 << 24
#: A class needs so many pages, and a share of the group's.
SUPPORT, SHARE = 4, 0.6
#: Pages that share so much of their unmarked text are copies of one content, which counts once towards a class.
SAME = 0.9

# Element names of HTML.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
ENDS_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "dd", "dt", "li", "legend", "summary", "figcaption"} | {"li", "dd", "dt"}
NEVER = {"head", "nav", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "button", "select", "svg", "math", "object", "canvas", "audio", "video", "menu", "dialog", "textarea", "title", "search", "noembed", "noframes", "xmp"}
#: Class, id and role names that mark what isn't the article; a name may join several, as in cookie-notice.
NOT_MAIN = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "sidebar", "side", "aside",
    "complementary", "footer", "contentinfo", "masthead", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "comment", "comments",
    "commentlist", "respond", "replies", "reply", "disqus", "discussion", "related", "recommended", "recommendations", "share", "sharing", "social", "widget", "widgets", "pagination", "pager", "search", "toolbar", "dialog", "tags",
}
_NAME, _STOP = re.compile(r"[a-zA-Z][^\s/>]*"), re.compile(r"[>\"']")
_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
#: Elements whose class and id may mark them, and names that inside an article are part of its text (callouts, kinds of section).
CONTAINER = {"div", "section", "center", "header", "details", "fieldset", "hgroup", "ul", "ol", "dl", "dir", "table"}
OF_ARTICLE = {"notice", "notices", "alert", "side", "discussion", "menu", "dialog", "search", "banner"}
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}


class Block:
    """A text block: its words, the place of its token on the page, whether it lies in an element that is never main text, and whether in an article or main element."""

    __slots__ = ("text", "at", "off", "main")

    def __init__(self, text: str, at: int, off: bool, main: bool):
        self.text, self.at, self.off, self.main = text, at, off, main


def _names(value: str, of_article: bool) -> bool:
    """Whether one of the names in a class or id value consists of NOT_MAIN words only."""
    for name in value.split():
        words = [x for x in re.split(r"[-_\d]+", name) if x]
        if words and NOT_MAIN.issuperset(words) and not (of_article and OF_ARTICLE.issuperset(words)):
            return True
    return False


def _marked(name: str, attributes: str, in_article: bool) -> tuple[bool, str]:
    """Whether the element isn't main text by its attributes; its role in a path. In an article ids are its sections' anchors and mark nothing."""
    off, label = False, name
    if "=" in attributes or "hidden" in attributes:
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"' ").lower()
            if key == "style":
                off |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
            elif key == "hidden":
                off = True
            elif key == "aria-hidden":
                off |= value == "true"
            elif key == "role":
                off |= not NOT_MAIN.isdisjoint(value.split())
                if value == "main":
                    label = "main"
            elif key in ("class", "id"):
                if name in CONTAINER and not (key == "id" and in_article):
                    off |= _names(value, in_article)
                if key == "class":
                    label += "." + re.sub(r"\d+", "#", value)
    return off and name not in ("html", "body", "article", "main"), label


def scan(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", name, attributes) and ("close", name, "") in order; no comments, and nothing of raw elements.

    In time proportional to the page, whatever it holds: where a quote stays open, tags up to there end at their first ``>``.
    """
    at, plain, last = 0, 0, page.rfind(">")

    def end(start: int) -> int:
        nonlocal plain
        p = start
        while start >= plain:
            m = _STOP.search(page, p)
            if m and m[0] == ">":
                return m.start()
            q = page.find(m[0], m.end()) if m else -1
            if q < 0:
                plain = m.start() if m else len(page)
                break
            p = q + 1
        return page.find(">", start)

    while True:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if page.startswith("<!--", lt):
            yield "text", page[at:lt], ""
            to = page.find("-->", lt + 4)
            if to < 0:
                return
            at = to + 3
            continue
        if lt > last:  # no tag ends any more
            yield "text", page[at:], ""
            return
        kind = page[lt + 1 : lt + 2]
        m = _NAME.match(page, lt + 2 if kind == "/" else lt + 1)
        if not m and kind not in "!?":
            yield "text", page[at : lt + 1], ""
            at = lt + 1
            continue
        yield "text", page[at:lt], ""
        to = page.find(">", m.end() if m else lt) if kind in "/!?" else end(m.end())
        if to < 0:
            return
        at = to + 1
        if kind == "/":
            yield "close", m[0].lower(), ""
        elif m:
            name = m[0].lower()
            if name in RAW:
                close = _END[name].search(page, at)
                to = page.find(">", close.end()) if close else -1
                if to < 0:
                    return
                at = to + 1
            else:
                yield "open", name, page[m.end() : to]


class _Open:
    """An open element: its name, whether it or one around it isn't main text, is main text, or is an article, and its path."""

    __slots__ = ("name", "off", "main", "article", "path")

    def __init__(self, name: str, off: bool, main: bool, article: bool, path: int):
        self.name, self.off, self.main, self.article, self.path = name, off, main, article, path


def parse(page: str) -> tuple[list[Block], list[int]]:
    """Text blocks of a page in order, and its tokens: hashes of tags with their paths, and of blocks with theirs."""
    blocks: list[Block] = []
    tokens: list[int] = []
    stack = [_Open("", False, False, False, 0)]
    count: Counter = Counter()
    held: list[str] = []
    mains = 0

    def end_block() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            blocks.append(Block(text, len(tokens), stack[-1].off, stack[-1].main))
            tokens.append(hash((stack[-1].path, text)))

    def push(name: str, off: bool, label: str) -> None:
        top = stack[-1]
        main = name in ("article", "main") or label.startswith("main")
        stack.append(_Open(name, top.off or off, top.main or main, top.article or name == "article", hash((top.path, label))))
        count[name] += 1

    def pop() -> _Open:
        count[stack[-1].name] -= 1
        return stack.pop()

    for kind, name, attributes in scan(page):
        if kind == "text":
            held.append(name)
        elif name == "br":
            held.append(" ")
        elif kind == "open":
            if name in BLOCK or name in NEVER:
                end_block()
                if name in ENDS_P and count["p"]:
                    k = len(stack) - 1
                    while stack[k].name not in ("p", "article", "section", "div", "td", "li", "aside", "button", "object"):
                        k -= 1
                    if stack[k].name == "p":
                        while len(stack) > k:
                            pop()
                if name == "li" and stack[-1].name == "li" or name in ("dt", "dd") and stack[-1].name in ("dt", "dd") or name in ("td", "th") and stack[-1].name in ("td", "th"):
                    pop()
                if name == "tr":
                    while stack[-1].name in ("td", "th", "tr"):
                        pop()
                if name not in VOID and not attributes.endswith("/"):
                    off, label = _marked(name, attributes, stack[-1].article)
                    off |= name in NEVER or name == "header" and not stack[-1].main
                    if name in ("article", "main"):
                        mains += 1
                        label = f"{label}#{mains}" if mains > 1 else label
                    push(name, off, label)
                    tokens.append(stack[-1].path)
            elif name not in VOID and attributes and not attributes.endswith("/"):
                off, label = _marked(name, attributes, False)  # no container: its class and id don't count
                if off:
                    end_block()
                    push(name, True, label)
        elif count[name] > 0:
            end_block()
            while True:
                top = pop()
                tokens.append(~top.path)
                if top.name == name:
                    break
        elif name in BLOCK:
            end_block()
    end_block()
    return blocks, tokens


def nested(a: Sequence[int], b: Sequence[int]) -> bool:
    """Whether one of two classes lies in a single gap of the other on a page: in, around or beside it, never across; places ascend."""
    return bisect(a, b[0]) == bisect(a, b[-1]) or bisect(b, a[0]) == bisect(b, a[-1])


def template(pages: Sequence[Sequence[Hashable]]) -> set:
    """Tokens of the template of these pages' token sequences: the valid, nested equivalence classes.

    A token's occurrence vector is its count on each page. A class is valid if its tokens stand in the same order on
    each page. Of two classes one must lie within a single gap of the other on every page that has both, or the one on fewer
    pages is left out.
    """
    n = len(pages)
    if n < SUPPORT:
        return set()
    vectors: dict[Hashable, dict[int, int]] = defaultdict(dict)
    for k, tokens in enumerate(pages):
        for token, count in Counter(tokens).items():
            vectors[token][k] = count
    classes: dict[tuple, list[Hashable]] = defaultdict(list)
    for token, vector in vectors.items():
        if len(vector) >= max(SUPPORT, SHARE * n):
            classes[tuple(sorted(vector.items()))].append(token)
    out: set = set()
    frame: list[dict[int, list[int]]] = []  # the places of each class, by page
    for vector, members in sorted(classes.items(), key=lambda x: (-len(x[0]), -len(x[1]))):
        if any(count != vector[0][1] for _, count in vector):
            continue  # a list item or paragraph: repeated, but not of fixed number
        belongs, order = set(members), None
        valid = True
        for k, count in vector:
            seen = [t for t in pages[k] if t in belongs]
            unit = seen[: len(seen) // count]
            if order is None:
                order = unit
            if unit != order or seen != unit * count:
                valid = False
                break
        if valid:
            places = {k: [i for i, t in enumerate(pages[k]) if t in belongs] for k, _ in vector}
            if all(nested(other[k], spots) for other in frame for k, spots in places.items() if k in other):
                frame.append(places)
                out |= belongs
    return out


def distinct(keys: list[np.ndarray], sizes: list[np.ndarray]) -> list[int]:
    """The first page of each content: copies, be they exact or with another line beside the article, add no support.

    keys, sizes: each page's different unmarked blocks and their characters; a page without any has no content.
    """
    out: list[int] = []
    values, codes = np.unique(np.concatenate(keys), return_inverse=True)
    off = np.cumsum([0, *map(len, keys)])
    own = np.zeros(len(values), dtype=np.int64)
    totals = np.array([x.sum() for x in sizes])
    kept_codes, kept_sizes, starts, n = np.empty_like(codes), np.empty(len(codes), dtype=np.int64), [], 0
    for k, size in enumerate(sizes):
        if not len(size):
            continue
        mine = codes[off[k] : off[k + 1]]
        if out:
            own[mine] = size
            shared = np.add.reduceat(np.minimum(own[kept_codes[:n]], kept_sizes[:n]), starts)
            own[mine] = 0
            if (shared >= SAME * np.maximum(totals[out], totals[k])).any():
                continue
        out.append(k)
        starts.append(n)
        kept_codes[n : n + len(mine)], kept_sizes[n : n + len(mine)] = mine, size
        n += len(mine)
    return out


def slots(tokens: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """The slot of each token of a page: what lies between two tokens of the template, numbered in order; -1 for the template's own."""
    own = np.isin(tokens, fixed)
    return np.where(own, -1, np.cumsum(own))


def main_text(blocks: list[tuple[str, int, bool]], slot: np.ndarray) -> str:
    """The main text of one page: all unmarked blocks of its content slots, without the template's own text, which never is all of them.

    blocks: text, place of its token, and whether in a main or article element. Content slots are those that lie in such
    elements; of a page without unmarked text in them, all.
    """
    content = [b for b in blocks if b[2]] or blocks
    return "\n\n".join(b[0] for b in [b for b in content if slot[b[1]] >= 0] or content)


class Group:
    """Pages of one host: hashes of their tokens, and their unmarked blocks in memory or in a temporary file."""

    def __init__(self) -> None:
        self.tokens: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.blocks = tempfile.SpooledTemporaryFile(max_size=BYTES)

    def add(self, page: str) -> None:
        blocks, tokens = parse(page)
        free = [(b.text, b.at, b.main) for b in blocks if not b.off]
        own: Counter = Counter()
        for text, at, _ in free:
            own[tokens[at]] += len(text)
        self.tokens.append(np.array(tokens, dtype=np.int64))
        self.keys.append(np.array(list(own.keys()), dtype=np.int64))
        self.sizes.append(np.array(list(own.values()), dtype=np.int64))
        pickle.dump(free, self.blocks, pickle.HIGHEST_PROTOCOL)

    def texts(self) -> Iterator[str]:
        """Main texts of the pages in turn; closes the group."""
        fixed = np.zeros(0, dtype=np.int64)
        some = [self.tokens[k] for k in distinct(self.keys, self.sizes)] if len(self.tokens) >= SUPPORT else []
        if len(some) >= SUPPORT:  # tokens on too few pages form no class
            values, n = np.unique(np.concatenate([np.unique(t) for t in some]), return_counts=True)
            often = values[n >= max(SUPPORT, SHARE * len(some))]
            fixed = np.array(sorted(template([t[np.isin(t, often)].tolist() for t in some])), dtype=np.int64)
        with self.blocks:
            self.blocks.seek(0)
            for tokens in self.tokens:
                yield main_text(pickle.load(self.blocks), slots(tokens, fixed))


def extract_group(pages: list[str | None]) -> list[str]:
    """Main texts of some pages of one host."""
    group = Group()
    for p in pages:
        group.add(p or "")
    return list(group.texts())


def extract(pages: DataFrame, group: int = GROUP) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages`` (page_id, url, html).

    Null HTML is an empty page, whose text is empty. A null or odd URL makes a host of its own kind. Repeated rows give
    repeated rows; other columns are ignored. Each host's different pages are dealt by their hash to buckets of from
    ``group`` to twice as many on average, and a bucket is compared as a whole: texts depend on the host's pages alone, not
    on partitions or sizes, and a host with a third of all pages spreads over many tasks. Equal pages of a host share a bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, last = None, None
        held: list[tuple] = []  # page_id, url, number of the page in the group
        pages = Group()

        def table(some: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in some], pa.int64()), pa.array([x[1] for x in some], pa.string()), pa.array([x[2] for x in some], pa.string()), pa.array([len(x[2]) for x in some], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

        def done() -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            size, at, text = 0, -1, ""
            texts = pages.texts()
            for page_id, url, k in held:
                if k != at:
                    at, text = k, next(texts)
                out.append((page_id, url, text))
                size += len(text) + 100
                if size > BYTES // 4:
                    yield table(out)
                    out, size = [], 0
            if out:
                yield table(out)

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(5)), strict=True):
                host, b, page_id, url, page = (x.as_py() for x in row)
                if held and bucket != (host, b):
                    yield from done()
                    held, pages = [], Group()
                if not held or page != last:
                    pages.add(page or "")
                bucket, last = (host, b), page
                held.append((page_id, url, len(pages.tokens) - 1))
        if held:
            yield from done()

    host = F.lower(F.coalesce(F.regexp_extract("url", r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    rows = bounded(pages).select(host.alias("host"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    different = rows.select("host", F.xxhash64("html").alias("h")).distinct().groupBy("host").agg(F.floor(F.count("*") / group).alias("n"))
    many = written(different.where("n > 1").select(F.col("host").alias("of"), "n"), "hosts")
    dealt = rows.join(small(many, 2 * many.count()), rows["host"] == many["of"], "left")
    dealt = dealt.select("host", F.pmod(F.xxhash64("html"), F.coalesce("n", F.lit(1))).alias("bucket"), "page_id", "url", "html")
    dealt = dealt.repartition("host", "bucket").sortWithinPartitions("host", "bucket", F.xxhash64("html"))
    return dealt.mapInArrow(run, "page_id long, url string, text string, n_chars long")
