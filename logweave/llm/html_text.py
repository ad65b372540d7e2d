"""Main text of web pages: site templates recur across a host's pages and are removed."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_lookup, bitmap_of, discard, free_name, materialise, ship

#: Pages of one host, with different main text, on which a subtree has to stand to count as
#: template: so many at least, and so large a share of the host's pages.
MANY_PAGES, SHARE = 5, 0.1
#: The share for what stands in an article or main element, and for longer prose anywhere.
MAIN_SHARE = 0.5
#: Words from which on a paragraph counts as longer prose.
LONG = 25

_TAG = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup, and no text of the page.
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt li figcaption td th tr table tbody thead tfoot ul ol dl".split())
#: Opening one of the values ends an open element of the key's kind, unless a limit stands between.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
#: What counting cannot find where it differs from page to page, or on hosts of few pages:
#: elements and roles that HTML reserves for other things than the article, and names of
#: parts that change with the page. A name is one whole word of a class or an id.
_REMOVED = frozenset("head nav footer aside form button select dialog menu search datalist object audio video map fieldset input label".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsored promo notice notices alert newsletter subscribe share sharing share-buttons social-share "
    "cookie-banner cookie-notice cookie-consent comments comment-list commentlist disqus_thread replies related-posts related-articles recommended pagination breadcrumb breadcrumbs".split()
)
#: Names that count outside an article or main element only.
_OUTER = frozenset("banner cookies consent gdpr popup overlay modal social sidebar side-bar menu nav navbar navigation topbar masthead site-header page-header header site-footer page-footer footer comment related widget login signup toolbar skip-link".split())


class _Element:
    __slots__ = ("tag", "removed", "inside", "prose", "first", "parts", "holds_main", "words")

    def __init__(self, tag: str, removed: bool, inside: bool, prose: bool, first: int, parts: list[str] | None, holds_main: bool):
        self.tag, self.removed, self.inside, self.prose, self.first, self.parts, self.holds_main, self.words = tag, removed, inside, prose, first, parts, holds_main, 0


@dataclass
class Page:
    """blocks: (text, whether rules remove it, whether it stands in the main container); subtrees: (hash, first block, last block + 1, whether it takes the larger share)."""

    blocks: list[tuple[str, bool, bool]] = field(default_factory=list)
    subtrees: list[tuple[int, int, int, bool]] = field(default_factory=list)

    def template(self, gone: frozenset[int] | set[int]) -> list[bool]:
        """Per block, whether it lies in a subtree whose hash is in ``gone``."""
        change = [0] * (len(self.blocks) + 1)
        for h, a, b, _ in self.subtrees:
            if h in gone:
                change[a] += 1
                change[b] -= 1
        out, depth = [], 0
        for c in change[:-1]:
            depth += c
            out.append(depth > 0)
        return out

    def text(self, gone: frozenset[int] | set[int] = frozenset()) -> str:
        """The blocks of the main text: no template, not removed by rules, and of the main container if there is one."""
        main = any(inside for _, _, inside in self.blocks)
        return "\n\n".join([t for (t, removed, inside), out in zip(self.blocks, self.template(gone)) if not (out or removed) and (inside or not main)])


def _attributes(text: str) -> dict[str, str]:
    return {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTRIBUTE.findall(text)} if text and not text.isspace() else {}


def _is_removed(tag: str, at: dict[str, str], inside: bool) -> bool:
    """Whether an element is no part of an article, by its kind, role, names or visibility."""
    if tag in _REMOVED or (tag == "header" and not inside):
        return True
    if not at or tag in ("html", "body"):
        return False
    if "hidden" in at or at.get("aria-hidden") == "true" or "display:none" in at.get("style", "").replace(" ", "").lower():
        return True
    if at.get("role", "").lower() in _ROLES:
        return True
    names = {*at.get("class", "").lower().split(), *at.get("id", "").lower().split()}
    if tag in ("article", "main"):
        return not names.isdisjoint({"comment", "comments"})
    return not names.isdisjoint(_NAMES) or (not inside and not names.isdisjoint(_OUTER))


def parse(source: str | None) -> Page:
    """Blocks and element subtrees of a page, however broken its markup, in time linear in its length. None: no blocks.

    A quotation mark that is never closed ends no tag: from there on tags end at the first >.
    A last tag without > is text.
    """
    page = Page()
    root = _Element("", False, False, False, 0, [], False)
    stack, block_stack = [root], [root]
    depths: dict[str, list[int]] = {}  # positions in the stack of the open elements of each kind
    held: list[str] = []
    quotes = True

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            top = block_stack[-1]
            page.blocks.append((text, top.removed, top.inside))
            top.parts.append(text)
            top.words += text.count(" ") + 1

    def hold(text: str) -> None:
        # Of a block that stays, the text of inline elements that rules remove is left out.
        if block_stack[-1].removed or not stack[-1].removed:
            held.append(text)

    def close(n: int) -> None:
        """Close the innermost elements until ``n`` are left."""
        while len(stack) > n:
            e = stack[-1]
            if e.parts is not None:
                flush()
                block_stack.pop()
                digest = hashlib.blake2b("\0".join(e.parts).encode("utf-8", "surrogatepass"), digest_size=8).digest()
                if not e.holds_main and e.first < len(page.blocks):
                    page.subtrees.append((int.from_bytes(digest, "little", signed=True), e.first, len(page.blocks), e.inside or (e.prose and e.words >= LONG)))
                top = block_stack[-1]
                top.parts.append(digest.hex())
                top.holds_main |= e.holds_main
                top.words += e.words if e.prose else 0
            stack.pop()
            depths[e.tag].pop()

    source, at = source or "", 0
    while m := _TAG.search(source, at):
        if m.start() > at:
            hold(source[at : m.start()])
        if m[1]:
            at = source.find("-->", m.end())
            at = len(source) if at < 0 else at + 3
            continue
        tag = (m[3] or "").lower()
        rest = (quotes and tag and _REST.match(source, m.end())) or None
        if rest:
            given, at = rest[1], rest.end()
        else:
            quotes = quotes and not tag
            end = source.find(">", m.end())
            if end < 0:
                at = m.start() if m[3] else len(source)
                break
            given, at = source[m.end() : end], end + 1
        if not tag:
            continue
        if m[2]:
            if depths.get(tag):
                close(depths[tag][-1])
            elif tag in _BLOCK:
                flush()
            continue
        if tag in _VOID:
            if tag == "br":
                hold(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            at = source.find(">", end.end()) + 1 if end else 0
            at = at or len(source)
            continue
        block = tag in _BLOCK
        if block:
            if tag not in ("html", "head", "body") and depths.get("p"):
                close(depths["p"][-1])
            if tag in _ENDS:
                kinds, limits = _ENDS[tag]
                kind, limit = (max((depths[k][-1] for k in some if depths.get(k)), default=-1) for some in (kinds, limits))
                if kind > limit:
                    close(kind)
            if tag == "body" and depths.get("head"):
                close(depths["head"][0])
            flush()
        a, top = _attributes(given.rstrip("/")), stack[-1]
        main = block and (tag in ("article", "main") or a.get("role", "").lower() == "main" or a.get("itemprop", "").lower() == "articlebody")
        removed = top.removed or _is_removed(tag, a, top.inside)
        if given.endswith("/") and not block:
            continue
        depths.setdefault(tag, []).append(len(stack))
        e = _Element(tag, removed, top.inside or (main and not removed), top.prose or tag in _PROSE, len(page.blocks), [f"{tag} {a.get('id', '')} {a.get('class', '')}"] if block else None, main and not removed)
        stack.append(e)
        if block:
            block_stack.append(e)
    hold(source[at:])
    close(1)
    flush()
    return page


def main_text(pages: DataFrame, html_col: str = "html", url_col: str = "url", many: int = MANY_PAGES) -> DataFrame:
    """The main text of every page: ``text``, ``n_chars`` and ``n_template`` beside the page's other columns (less the html).

    Method: all subtrees of block elements are hashed (kind, names, text, children) and
    counted per host over pages of different main text, so that copies of one article count
    once. Subtrees on at least ``many`` such pages and ``SHARE`` of the host's are site
    template and are deleted; in an article or main element, and for longer prose, it takes
    ``MAIN_SHARE``, as articles of one host may share passages. What no article holds and
    counting may miss (hosts of few pages, parts that change with the page) is removed by
    element kind, role and whole names as well; if a page has a main container, only its
    text counts. Blocks are trimmed, their white space is made one blank, and they are joined
    by two newlines. ``n_template`` is the number of a page's blocks in deleted subtrees.

    Counts are combined before each shuffle, so a host may hold any share of the pages. Null
    html gives an empty text; a null url counts as one more host; repeated rows are kept;
    columns named as those returned are replaced, others of any name are kept; an empty
    table gives an empty result.
    """
    ship(pages.sparkSession)
    key = F.xxhash64(url_col, html_col)
    host = F.xxhash64(F.lower(F.coalesce(F.regexp_extract(url_col, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit(""))))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hosts, hashes, prints, wide = [], [], [], [], []
            for k, h, source in zip(*(batch.column(c).to_pylist() for c in ("key", "host", "html"))):
                page = parse(source)
                content = int.from_bytes(hashlib.blake2b(page.text().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
                found = {x: main for x, _, _, main in page.subtrees}
                keys += [k] * len(found)
                hosts += [h] * len(found)
                prints += [content] * len(found)
                hashes += found
                wide += found.values()
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "host": pa.array(hosts, pa.int64()), "hash": pa.array(hashes, pa.int64()), "content": pa.array(prints, pa.int64()), "main": pa.array(wide, pa.bool_())})

    seen = pages.select(key.alias("key"), host.alias("host"), F.col(html_col).alias("html")).mapInArrow(hashed, "key bigint, host bigint, hash bigint, content bigint, main boolean")
    seen = materialise(seen, "subtrees")
    sizes = seen.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    counts = seen.groupBy("host", "hash", "content").agg(F.max("main").alias("main")).groupBy("host", "hash").agg(F.count("*").alias("n"), F.max("main").alias("main"))
    share = F.when(F.col("main"), MAIN_SHARE).otherwise(SHARE)
    template = counts.where(F.col("n") >= many).join(sizes, "host").where(F.col("n") >= share * F.col("pages")).select("host", "hash")
    gone = seen.select("key", "host", "hash").join(template, ["host", "hash"]).groupBy("key").agg(F.collect_set("hash").alias("gone"))

    replaced = {html_col.lower(), "text", "n_chars", "n_template"}
    others = [c for c in pages.columns if c.lower() not in replaced]
    own = {n: free_name(pages, f"_{n}") for n in ("key", "html", "gone")}
    kept = pages.select(*[F.col(f"`{c}`") for c in others], F.col(html_col).alias(own["html"]), key.alias(own["key"]))
    gone = materialise(gone.select(F.col("key").alias(own["key"]), F.col("gone").alias(own["gone"])), "gone")
    discard(seen)
    # Pages without a deleted subtree stay where they are read; a bitmap of fixed size tells most of them.
    marked = bit_lookup(pages.sparkSession, bitmap_of(gone, own["key"]))
    here = kept.where(~marked(F.col(own["key"]))).withColumn(own["gone"], F.lit(None).cast("array<bigint>"))
    there = kept.where(marked(F.col(own["key"]))).join(gone, own["key"], "left").select(here.columns)
    kept = here.union(there)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, removed = [], []
            for source, hashes in zip(batch.column(own["html"]).to_pylist(), batch.column(own["gone"]).to_pylist()):
                page, hashes = parse(source), set(hashes or ())
                found.append(page.text(hashes))
                removed.append(sum(page.template(hashes)))
            arrays = [batch.column(c) for c in others]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(found, pa.string()), pa.array(map(len, found), pa.int64()), pa.array(removed, pa.int64())], [*others, "text", "n_chars", "n_template"])

    schema = pages.select(*[F.col(f"`{c}`") for c in others]).schema.add("text", "string").add("n_chars", "long").add("n_template", "long")
    return kept.mapInArrow(texts, schema)
