"""Main text of web pages by template deduction: equivalence classes of tokens on the pages of a host.

Tokens are tags with the path of elements around them, and pieces of text from one block tag to the next, inside
articles as well; copies of a page count once for its pieces.  Tokens with
the same occurrence vector over the pages of a host form a class; a class is valid if its tokens occur once in
each page that has them, on enough of the host's pages.  Valid classes, nested by their place on the page, are
the host's template; what lies between its tokens are slots.  Slots under menus, notices, forms and the like,
and repeated pieces of text, belong to the frame; of the others those in the article are the main text, or where
no article is marked all slots that are not mostly links, and those within the element that holds them.

Occurrence vectors are sums of page fingerprints, added up in partial sums, so a hot host is no hot key; a
template is one short row per host.

Defined results: NULL and empty pages have the text ''.  Pages without a URL share the host ''.  Hosts with
one page have no template, their pages are read by their elements alone.  Repeated pages are read alike, very
long ones whole.  An empty table gives an empty result; columns named like a result column are replaced.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewarden.llm.urlrules import host_and_path
from linewarden.llm.words import mix
from linewarden.session import work_folder

#: A class is in the template if it is on this share of a host's pages, and on two at least.
SUPPORT = 0.5
#: A piece of text is of the frame if it stands on this share of at least so many pages of a host.
TEXT_SUPPORT, TEXT_PAGES = 0.5, 4
#: Within articles it is if it stands on this share: some of a host's articles may well quote the same.
ARTICLE_SUPPORT = 0.8
#: An article with so many times more repeated text than other text is a copy of others.
COPY = 2
#: Templates of up to this many hosts and tokens are sent to every task; more are joined by a shuffle, in which a
#: host's pages are dealt to so many parts.
BROADCAST_HOSTS, BROADCAST_TOKENS, PARTS = 20_000, 1_000_000, 32

_U = np.uint64
#: Attributes up to the end of a tag; what is quoted does not end it.
_ATTRIBUTES = r"(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+"
_RAW = "script|style|noscript|template|svg|math|iframe|textarea|title|xmp|noembed|noframes|object"
#: After so many tags that never end, quotes and ``<`` in tags count for nothing on a page.
ENDLESS = 16


def _token_pattern(attributes: str) -> re.Pattern:
    return re.compile(
        r"<!--.*?(?:-->|$)"
        rf"|<(?P<raw>{_RAW})\b{attributes}>.*?(?:</(?P=raw)\s*>|$)"
        rf"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>{attributes})>"
        r"|<[!?/][^>]*>"
        r"|(?P<text>[^<]+|<)",
        re.S | re.I,
    )


_TOKEN, _PLAIN_TOKEN = _token_pattern(_ATTRIBUTES), _token_pattern(r"[^<>]*+")
#: Behind the last ``>`` there are no tags.
_TAIL = re.compile(r"<!--.*|(?P<text>[^<]+|<)(?P<name>(?!))?(?P<close>(?!))?(?P<attributes>(?!))?", re.S)


def _matches(page: str) -> Iterator[re.Match]:
    """The tokens of a page in one way forward; a tag that has no end is read as text."""
    last, at, endless, pattern = page.rfind(">"), 0, 0, _TOKEN
    while at < len(page):
        now = pattern if at <= last else _TAIL
        for m in now.finditer(page, at):
            yield m
            at = m.end()
            if now is _TAIL:
                continue
            if m["text"] == "<" and page[at : at + 1].isalpha() and pattern is _TOKEN:
                endless += 1
                if endless == ENDLESS:
                    pattern = _PLAIN_TOKEN
                    break
            if at > last:
                break


_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that hold nothing open unless they are marked as frame.
_PLAIN = frozenset("p b i em strong span u font small".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_FRAME = frozenset("head nav footer aside form button select menu dialog noscript fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
_FRAME_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|sponsored|promo|banner|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|cookies?|"
    r"consent|notice|comments?|replies|newsletter|subscribe|popup|modal|share|social|related|widget|masthead|site-header|page-header)(?:$|[\s_-])",
    re.I,
)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_SPACE = re.compile(r"\s+")


class Token:
    """A tag or a piece of text, with what it stands in."""

    __slots__ = ("key", "name", "text", "block", "frame", "article", "link", "within", "heading", "depth")

    def __init__(self, key: str, name: str, text: str, block: bool, frame: bool, article: bool, link: bool, within: int, heading: bool, depth: int):
        self.key, self.name, self.text, self.block = key, name, text, block
        self.frame, self.article, self.link = frame, article, link
        self.within = within  # the place of the tag that opens the innermost element around it, or -1
        self.heading, self.depth = heading, depth


def _is_frame(name: str, attributes: str, in_article: bool) -> bool:
    if name in _FRAME or (name == "header" and not in_article):
        return True
    if name in ("html", "body", "main", "article") or not attributes:
        return False
    for kind, a, b, c in _NAMED.findall(attributes):
        value = a or b or c
        if kind.lower() == "role" and value.lower() in _ROLES or kind.lower() != "role" and _FRAME_NAME.search(value):
            return True
    return bool(_HIDDEN.search(attributes))


def tokens(page: str) -> list[Token]:
    """The page as tokens; an element that is never closed ends with the one around it."""
    found = list(_matches(page))
    closes: dict[str, int] = {}
    for m in found:
        if m["name"] and m["close"]:
            closes[m["name"].lower()] = closes.get(m["name"].lower(), 0) + 1
    out: list[Token] = []
    stack: list[tuple[str, bool, bool, int]] = []  # name, frame, article, place
    frame = article = link = depth = 0
    path, within, marked = "", -1, False  # whether a plain element was ever opened
    opened: Counter[str] = Counter()  # open elements by name
    headings = 0

    def pop() -> str:
        nonlocal frame, article, link, headings
        top, was_frame, was_article, _ = stack.pop()
        frame, article, link = frame - was_frame, article - was_article, link - (top == "a")
        opened[top] -= 1
        headings -= top in _HEADINGS
        return top

    for m in found:
        if len(stack) != depth or (stack and stack[-1][3] != within):
            depth, path, within = len(stack), "/".join(s[0] for s in stack[-4:]), stack[-1][3] if stack else -1
        if m["text"] is not None:
            out.append(Token(f"{path}#{m['text']}", "", m["text"], False, frame > 0, article > 0, link > 0, within, headings > 0, depth))
            continue
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["close"]:
            closes[name] = closes.get(name, 0) - 1
            out.append(Token(f"{path}</{name}>", name, "", name in _BLOCKS, frame > 0, article > 0, False, within, headings > 0, depth))
            if opened[name]:
                while pop() != name:
                    pass
            continue
        if marked and name in _BLOCKS and opened["p"]:  # a marked paragraph ends at the next block
            while pop() != "p":
                pass
            depth, path, within = len(stack), "/".join(s[0] for s in stack[-4:]), stack[-1][3] if stack else -1
        out.append(Token(f"{path}<{name}>", name, "", name in _BLOCKS, frame > 0, article > 0, False, within, headings > 0, depth))
        if name in _VOID or m["attributes"].endswith("/"):
            continue
        is_frame = _is_frame(name, m["attributes"], article > 0)
        # Unclosed elements hold nothing open, but for marked paragraphs; nor do plain paragraphs and inline elements.
        if closes.get(name, 0) <= 0 and not (name == "p" and is_frame):
            continue
        if name in _PLAIN and not is_frame and not (marked and opened[name]):
            continue
        marked = marked or name in _PLAIN
        is_article = name in ("article", "main") and not is_frame
        stack.append((name, is_frame, is_article, len(out) - 1))
        opened[name] += 1
        headings += name in _HEADINGS
        frame, article, link = frame + is_frame, article + is_article, link + (name == "a")
    return out


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


#: Tags with their paths are few and come again on every page.
_tag_hash = lru_cache(16_384)(_hash)


def _pieces(listed: list[Token]) -> list[tuple[int, list[int]]]:
    """The page's pieces of text from one block tag to the next, as hashes of path and text, with the places they hold."""
    pieces: list[tuple[int, list[int]]] = []
    open_piece: list[int] = []

    def close() -> None:
        said = [k for k in open_piece if listed[k].text.strip()]
        if said:
            first = listed[said[0]]
            path = first.key[: len(first.key) - len(first.text)]
            pieces.append((_hash(path + _SPACE.sub(" ", "".join(listed[k].text for k in open_piece)).strip()), list(open_piece)))
        open_piece.clear()

    for k, t in enumerate(listed):
        if t.text:
            if not t.frame:
                open_piece.append(k)
        elif t.block and not t.frame:
            close()
    close()
    return pieces


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums per host and token: pages, occurrences, vector fingerprint, place, whether it is text.

    Pieces of text stand once for each ``content`` they are part of, and their occurrences are those in articles; token 0 stands for the content itself.
    """
    schema = pa.schema(
        [("host", pa.string()), ("token", pa.int64()), ("is_text", pa.bool_()), ("content", pa.int64()), ("pages", pa.int64()), ("times", pa.int64()), ("vector", pa.int64()), ("place", pa.float64())]
    )
    for batch in batches:
        sums: dict[tuple[str, int, bool, int], list] = {}
        for host, row, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts: dict[tuple[int, bool], list] = {}
            listed = tokens(page or "")
            found = [(_tag_hash(t.key), False, k) for k, t in enumerate(listed) if t.name]
            pieces = _pieces(listed)
            content = _hash(" ".join(str(piece) for piece, at in pieces if listed[at[0]].article) or " ".join(str(piece) for piece, _ in pieces))
            found += [(piece, True, at[0]) for piece, at in pieces] + ([(0, True, 0)] if pieces else [])
            for token, is_text, k in found:
                c = counts.setdefault((token, is_text), [0, k / len(listed)])
                c[0] += not is_text or listed[k].article
            stamp = int(mix(np.array([row & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])
            for (token, is_text), (times, place) in counts.items():
                s = sums.setdefault((host, token, is_text, content if is_text else 0), [0, 0, 0, 0.0])
                s[0] += 1
                s[1] += times
                s[2] = (s[2] + stamp * times) & 0xFFFFFFFFFFFFFFFF
                s[3] += place
        rows = [
            (h, np.uint64(t).astype(np.int64), x, np.uint64(c).astype(np.int64), s[0], s[1], np.uint64(s[2]).astype(np.int64), s[3])
            for (h, t, x, c), s in sums.items()
        ]
        columns = list(zip(*rows, strict=True)) or [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def deduce_templates(pages: DataFrame) -> DataFrame:
    """(host, template tokens in the order of their place, texts of the frame) from pages (host, row, html)."""
    fields = "host string, token long, is_text boolean, content long, pages long, times long, vector long, place double"
    parts = pages.select("host", "row", "html").mapInArrow(_vectors, fields)
    # Copies of a page count once for its texts, so that they do not make its article a frame.
    once = parts.groupBy("host", "token", "is_text", "content").agg(
        F.sum("pages").alias("pages"), F.sum("times").alias("times"), F.expr("bit_xor(vector)").alias("vector"), F.sum("place").alias("place")
    )
    each = once.groupBy("host", "token", "is_text").agg(
        F.sum(F.when(F.col("is_text"), 1).otherwise(F.col("pages"))).alias("pages"), F.sum("times").alias("times"), F.expr("bit_xor(vector)").alias("check"), F.sum("place").alias("place")
    )
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("all"))
    each = each.join(sizes, "host").where((F.col("pages") >= 2) & (F.col("is_text") | (F.col("pages") >= SUPPORT * F.col("all"))))
    folder = work_folder(pages.sparkSession, "template-tokens")
    each.write.parquet(folder)  # read twice below; the pages are parsed once
    each = pages.sparkSession.read.parquet(folder)
    # Equal vectors make a class; a valid class has each token once on each of its pages.
    tags = each.where("NOT is_text AND times = pages")
    tags = tags.select("host", "token", "pages", (F.col("place") / F.col("pages")).alias("place"), "check")
    contents = each.where("is_text AND token = 0").select("host", F.col("pages").alias("contents"))
    texts = each.where("is_text AND token <> 0").join(contents, "host")
    support = F.when(F.col("times") > 0, ARTICLE_SUPPORT).otherwise(TEXT_SUPPORT)
    texts = texts.where((F.col("contents") >= TEXT_PAGES) & (F.col("pages") >= support * F.col("contents")))
    classes = tags.groupBy("host", "pages", "check").agg(F.sort_array(F.collect_list(F.struct("place", "token"))).alias("members"))
    # Classes with more pages contain those with fewer: a nested template, read off in the order of places.
    template = classes.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("pages")).alias("p"), "members"))).alias("nested"))
    ordered = F.flatten(F.transform("nested", lambda c: c["members"]))
    template = template.select("host", F.transform(F.array_sort(ordered), lambda m: m["token"]).alias("template"))
    # Each is on half of the pages at least, so a host has twice the mean of a page at most.
    frame = texts.groupBy("host").agg(F.sort_array(F.collect_list("token")).alias("frame"))
    return template.join(frame, "host", "full")


def _blocks(listed: list[Token], kept: set[int]) -> list[str]:
    """Texts of the page's blocks, of the kept pieces of text."""
    blocks, open_block = [], []

    def close() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(open_block))).strip()
        if text:
            blocks.append(text)
        open_block.clear()

    for k, t in enumerate(listed):
        if t.text:
            if k in kept:
                open_block.append(t.text)
        elif t.frame:
            continue
        elif t.block:
            close()
        elif t.name == "br":
            open_block.append(" ")
    close()
    return blocks


class _Common:
    """The innermost element around all tokens that were added, by its place; -1 is the page.

    The deeper end of two ways climbs, and ways stop at elements that are known to lie in the common one, so no
    way is gone twice.
    """

    def __init__(self, listed: list[Token]):
        self.listed, self.top, self.below = listed, None, set()

    def _depth(self, element: int) -> int:
        return self.listed[element].depth + 1 if element >= 0 else 0

    def add(self, k: int) -> None:
        at, way = self.listed[k].within, []
        if self.top is None:
            self.top = at
        while at != self.top and at not in self.below:
            if self._depth(at) >= self._depth(self.top):
                way.append(at)
                at = self.listed[at].within
            else:
                self.below.add(self.top)
                self.top = self.listed[self.top].within
        self.below.update(way)

    def holds(self, k: int) -> bool:
        at, way = self.listed[k].within, []
        while at != self.top and at not in self.below and self._depth(at) > self._depth(self.top):
            way.append(at)
            at = self.listed[at].within
        inside = at == self.top or at in self.below
        if inside:
            self.below.update(way)
        return inside


def _content(listed: list[Token], slots: list[list[int]]) -> set[int]:
    """Pieces of text of the slots that are no menus: not mostly links, or within the element that holds the others.

    ``slots`` has the places of the slots' texts without those of the frame.
    """

    def is_menu(slot: list[int]) -> bool:
        if any(listed[k].heading for k in slot):
            return False
        sizes = [(len(listed[k].text.strip()), listed[k].link) for k in slot]
        return 2 * sum(n for n, link in sizes if link) > sum(n for n, _ in sizes)

    filled = [s for s in slots if any(listed[k].text.strip() for k in s)]
    menus = [is_menu(s) for s in filled]
    kept = {k for s, m in zip(filled, menus, strict=True) if not m for k in s}
    common = _Common(listed)
    for k in kept:
        if listed[k].text.strip():
            common.add(k)
    if common.top is not None and common.top >= 0 and listed[common.top].name not in ("html", "body"):
        kept |= {k for s, m in zip(filled, menus, strict=True) if m for k in s if common.holds(k)}
    return kept


def _article(listed: list[Token], pieces: list[tuple[int, list[int]]], skip: frozenset[int]) -> set[int]:
    """Pieces of text of the article without those that the host repeats, unless the article is a copy of others.

    It is a near copy if far more of its plain text is repeated than not, in more pieces.
    """
    rest = [at for piece, at in pieces if piece not in skip]
    repeated = [at for piece, at in pieces if piece in skip]

    def plain(of: list[list[int]]) -> int:
        return sum(len(listed[k].text.strip()) for at in of for k in at if not listed[k].link)

    if not rest or (len(repeated) > len(rest) and plain(repeated) > COPY * plain(rest)):
        rest = rest + repeated
    return {k for at in rest for k in at}


def main_text(page: str, template: list[int] | None, frame: list[int] | None) -> str:
    """The main text of a page, by its slots between the template's tokens."""
    listed = tokens(page)
    wanted = {t & 0xFFFFFFFFFFFFFFFF for t in template or ()}
    skip = frozenset(t & 0xFFFFFFFFFFFFFFFF for t in frame or ())
    pieces = _pieces(listed)
    inside = [(piece, at) for piece, at in pieces if listed[at[0]].article]
    if inside:
        # What lies between two of the article's slots ends a block only if a block tag does.
        return "\n\n".join(_blocks(listed, _article(listed, inside, skip)))
    repeated = {k for piece, at in pieces if piece in skip for k in at}
    slots: list[list[int]] = [[]]
    for k, t in enumerate(listed):
        if t.name and t.name != "br" and wanted and _tag_hash(t.key) in wanted:
            slots.append([])
        elif t.text and not t.frame and k not in repeated:
            slots[-1].append(k)
    kept = _content(listed, slots) or _content(listed, [at for _, at in pieces])  # where all is repeated, the page is a copy
    return "\n\n".join(_blocks(listed, kept))


def extract(pages: DataFrame, html_column: str = "html", url: str = "url") -> DataFrame:
    """The pages without their html, with ``text`` and ``n_chars``.

    ``pages`` must be a stored table: its rows are read twice and named by their place.
    """
    spark = pages.sparkSession
    host, _ = host_and_path(F.col(url))
    named = pages.withColumn("__row", F.monotonically_increasing_id()).withColumn("__host", host)
    plain = named.select(F.col("__host").alias("host"), F.col("__row").alias("row"), F.col(html_column).cast("string").alias("html"))
    folder = work_folder(spark, "templates")
    deduce_templates(plain).write.parquet(folder)
    templates = spark.read.parquet(folder)
    held = sum((F.coalesce(F.array_size(c), F.lit(0)) for c in ("template", "frame")), F.lit(0))
    hosts, held_tokens = templates.agg(F.count(F.lit(1)), F.coalesce(F.sum(held), F.lit(0))).first()
    if hosts <= BROADCAST_HOSTS and held_tokens <= BROADCAST_TOKENS:
        templates, named = F.broadcast(templates.withColumn("__part", F.lit(0))), named.withColumn("__part", F.lit(0))
    else:
        templates = templates.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        named = named.withColumn("__part", F.pmod("__row", F.lit(PARTS)).cast("int"))
    results = ("text", "n_chars")
    kept = [c for c in pages.columns if c != html_column and c not in results]
    return _with_texts(named, templates, kept, html_column)


def _with_texts(named: DataFrame, templates: DataFrame, kept: list[str], html_column: str) -> DataFrame:
    @F.pandas_udf("string")
    def text(pages, templates, frames):
        import pandas as pd

        def listed(x):
            return None if x is None else [int(v) for v in x]

        made = [main_text(p or "", listed(t), listed(f)).encode("utf-8", "replace").decode() for p, t, f in zip(pages, templates, frames, strict=True)]
        return pd.Series(made, dtype=object)

    templates = templates.withColumnsRenamed({"host": "__host", "template": "__template", "frame": "__frame"})
    joined = named.join(templates, ["__host", "__part"], "left")
    out = joined.select(*kept, text(F.col(html_column).cast("string"), "__template", "__frame").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
