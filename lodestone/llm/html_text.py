"""HTML extraction by a site style tree.

A tolerant parser, linear in the page, turns a page into elements and blocks of text. Pages
of one host share a tree: its nodes are paths of tags with their classes and ids. For each
node the corpus gives the pages that have it, how they present it (the sequences of its
children) and what it holds (the texts of the blocks below it). With m pages, the importance
of presentation is the entropy of the presentations to base m, that of content one less the
mean over the texts of log(pages with the text) to base m. A node's importance is the larger
one, smoothed by PRIOR pages of importance 1, so that few pages prove little and every
further page counts: at a bound of 0.75 and the same branch on every page that takes nine
different pages of a host. Branches of low importance are noise of the site, and go from each page.

Equal pages of a host count once, so that copies of a page do not remove each other's text.

What names itself goes as well: navigation, asides, forms, scripts and the like by tag, and
elements of which a class or the id is a word such as ad, menu or comments, or is put together
from such words and plain ones (cookie-notice, related-posts). Longer names that only contain
such a word (notice-period, has-sidebar) are left to the style tree. Names of paragraphs
and headings say nothing within an article, those of links and other phrases only if they are
those of adverts or share buttons, and ids of all these say nothing anywhere. Names never remove main and article elements or what these stand in, but for reader
comments: what is named so goes with all in it, articles too. An article within an article is a
comment or the like and has no such right. A page with a main element is read from that; one with
articles from those and from paragraphs and headings beside them (a teaser may be the only
article). The plain text elements of main and articles are never low branches.

Counts of nodes and texts are combined on the map side, so a host with a third of all pages
is no hot key; each host's list of removed branches is as long as its templates have nodes.

Defined results: a null or empty page has an empty text; a null or unreadable url is a host
of its own; repeated rows get equal results; an empty table gives an empty table; columns of
the input named text or n_chars are replaced. Elements nested deeper than MOST_DEPTH become
siblings there, as in browsers, and keep their text; a page is held whole by one task.
"""

from __future__ import annotations

import html
import re
from collections.abc import Container, Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.bpe import texts_of
from lodestone.llm.common import written

#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
NOISE = frozenset("head nav footer aside form button select option optgroup datalist label fieldset legend output progress meter menu dialog object canvas audio video noscript template svg".split()) | RAW
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th figure figcaption".split())
#: Elements of running text, whose names say little: a heading's id is made of its words.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th figcaption".split())
PHRASES = frozenset("a abbr b bdi bdo cite code data del dfn em i ins kbd mark q s samp small strong sub sup time u var".split())
CLOSES = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
SCOPES = frozenset("ul ol dl table article section div body main aside nav footer header form".split())
#: Words of classes and ids that mark what is no part of an article, plain words that may stand beside them, and such roles.
NOISE_WORDS = frozenset("ad ads advert advertisement advertising adsense banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice popup promo promoted related share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split())
NEUTRAL_WORDS = frozenset("area bar block body bottom box button buttons container form global icons inner item items left link links list main message outer overlay page panel post posts right section site slot thread top unit wrap wrapper".split())
PHRASE_WORDS = frozenset("ad ads advert advertisement share sharing social sponsor sponsored".split())
COMMENT_WORDS = frozenset("comment commentlist comments disqus".split())
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Nesting of elements, as browsers bound it.
MOST_DEPTH = 512
#: Pages of full importance that every node is taken to have besides its own.
PRIOR = 25.0

_SIMPLE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*+)>")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*+(?:([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+([\"']?))?+|=++)")
_VALUE = re.compile(r"[^\s>]*+")
_WORDS = re.compile(r"[a-z]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I) for tag in RAW}


class Node:
    __slots__ = ("tag", "path", "up", "tagged", "named", "comment", "content", "main", "low", "plain", "running", "children")

    def __init__(self, tag: str, path: int, up: Node | None) -> None:
        self.tag, self.path, self.up = tag, path, up
        self.tagged = self.named = self.comment = self.content = self.main = self.low = self.plain = self.running = False
        self.children: list[str] = []


def _hash(*parts: object) -> int:
    return int.from_bytes(blake2b("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Paths:
    """Numbers of paths, remembered; the memory is bounded and forgetting changes no number."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, str], int] = {}

    def of(self, parent: int, name: str) -> int:
        if (key := (parent, name)) not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[key] = _hash(parent, name)
        return self.known[key]


@lru_cache(maxsize=10_000)
def noise_name(name: str) -> bool:
    """Whether a class or id is put together from words of noise and plain ones alone."""
    words = _WORDS.findall(name)
    return any(w in NOISE_WORDS for w in words) and all(w in NOISE_WORDS or w in NEUTRAL_WORDS for w in words)


@lru_cache(maxsize=10_000)
def comment_name(name: str) -> bool:
    return noise_name(name) and not COMMENT_WORDS.isdisjoint(_WORDS.findall(name))


def tokens(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, what, attributes): text, start, empty (a start tag closed at once) and end, in page order. Comments and raw elements' contents are left out."""
    at, n, unclosed, nothing = 0, len(page), set(), {}
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], nothing
            return
        if lt > at:
            yield "text", page[at:lt], nothing
        if m := _SIMPLE.match(page, lt):
            tag, at = m[2].lower(), m.end()
            yield "end" if m[1] else "start", tag, nothing
            if tag in RAW and not m[1]:
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else n
            continue
        after = page[lt + 1 : lt + 2]
        if after in "!?" or (after == "/" and not page[lt + 2 : lt + 3].isalpha()):
            ends = (("<!--", "-->"), ("<![CDATA[", "]]>"))
            end = next((e for b, e in ends if page.startswith(b, lt)), ">") if after else ""
            if not after:
                yield "text", "<", nothing
                return
            to = page.find(end, lt + 2)
            at = n if to < 0 else to + len(end)
            continue
        closing = after == "/"
        m = _NAME.match(page, lt + 1 + closing)
        if not m:
            yield "text", "<", nothing
            at = lt + 1
            continue
        tag, at = m[0].lower(), m.end()
        attributes: dict[str, str] = {}
        while at < n and page[at] != ">":
            m = _ATTRIBUTE.match(page, at)
            if not m:  # white space or slashes before the end
                at += 1
                continue
            at = m.end()
            if m[1] and m[2] is not None:
                quote, value = m[2], None
                if quote and quote not in unclosed:
                    if (to := page.find(quote, at)) >= 0:
                        value, at = page[at:to], to + 1
                    else:
                        unclosed.add(quote)
                if value is None:
                    v = _VALUE.match(page, at)
                    value, at = v[0], v.end()
                attributes.setdefault(m[1].lower(), value)
        if at >= n:
            return  # the page ends within a tag
        empty = page[at - 1] == "/" and not closing
        at += 1
        yield "end" if closing else "empty" if empty else "start", tag, attributes
        if tag in RAW and not closing:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else n


def parse(page: str, low: frozenset[int], paths: Paths, names: bool = True) -> tuple[list[Node], list[tuple[str, Node]]]:
    """Elements in page order, and blocks of text with the elements they stand in; neither text nor elements of noise are among the blocks."""
    root = Node("", 0, None)
    stack, nodes, blocks = [root], [], []
    pieces: list[str] = []

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                blocks.append((text, stack[-1]))
            pieces.clear()

    def close(depth: int) -> None:
        if any(n.tag in BLOCKS for n in stack[depth:]):
            flush()
        del stack[depth:]

    def innermost(tags: Container[str], stop: Container[str] = ()) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return i
            if stack[i].tag in stop:
                break
        return 0

    for kind, what, attributes in tokens(page):
        if kind == "text":
            if not (stack[-1].tagged or stack[-1].named):
                pieces.append(html.unescape(what) if "&" in what else what)
            continue
        tag = what
        if kind == "end":
            if depth := innermost((tag,)):
                close(depth)
            elif tag in BLOCKS:
                flush()
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            if depth := innermost(("p",), SCOPES):
                close(depth)
        if tag == "body" and (depth := innermost(("head",))):
            close(depth)
        if tag in CLOSES and (depth := innermost(CLOSES[tag], ("table",) if tag in ("tr", "td", "th") else SCOPES)):
            close(depth)
        named = [x for a in ("class", "id") for x in attributes.get(a, "").lower().split()] if attributes else []
        counted = named
        if named and (tag in RUNNING or tag in PHRASES):
            counted = attributes.get("class", "").lower().split()
            if stack[-1].content:
                counted = [x for x in counted if tag in PHRASES and not PHRASE_WORDS.isdisjoint(_WORDS.findall(x))]
        role = attributes.get("role", "").lower() if attributes else ""
        up = stack[-1]
        name = f"{tag}.{' '.join(_WORDS.findall(' '.join(named)))}" if named else tag
        up.children.append(name)
        if tag in RAW or tag in VOID or kind == "empty" or len(stack) > MOST_DEPTH:
            continue
        node = Node(tag, paths.of(up.path, name), up)
        inside = up.content
        node.main = up.main or tag == "main" or role == "main"
        node.content = inside or node.main or tag == "article" or role == "article"
        node.plain = inside and tag in PLAIN
        node.running = up.running or tag in RUNNING
        node.tagged = up.tagged or (names and (tag in NOISE or role in NOISE_ROLES or (not inside and (tag == "header" or "header" in named))))
        node.comment = up.comment or (names and any(map(comment_name, counted)))
        if tag == "main" or (tag == "article" and not node.comment and not innermost(("article",))):
            node.named = False  # nor does the name of what it stands in count
        elif names:
            node.named = node.comment or (tag not in ("html", "body") and any(map(noise_name, counted)))
            node.named |= up.named and not (node.content and not inside)
        free = tag not in ("html", "body", "main", "article") and not node.plain
        node.low = up.low or (free and node.path in low)
        nodes.append(node)
        stack.append(node)
    flush()
    return nodes, blocks


def main_text(page: str, low: frozenset[int], paths: Paths, names: bool = True) -> str:
    blocks = [(text, node) for text, node in parse(page, low, paths, names)[1] if not node.low]
    if any(node.main for _, node in blocks):
        blocks = [b for b in blocks if b[1].main]
    elif any(node.content for _, node in blocks):
        blocks = [b for b in blocks if b[1].content or b[1].running]
    return "\n".join(text for text, _ in blocks)


def host_of(url_col: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def style_tree(pages: DataFrame, *, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """host (its hash), path, pages, presentation and content: every node of the hosts' trees with its importance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = Paths()
        for batch in batches:
            hosts = batch.column(batch.schema.get_field_index("host")).to_pylist()
            out: dict[str, list] = {"host": [], "path": [], "kind": [], "value": [], "share": []}
            shares = batch.column(batch.schema.get_field_index("share")).to_pylist()
            for host, share, page in zip(hosts, shares, texts_of(batch, "html"), strict=True):
                nodes, blocks = parse(page.decode(), frozenset(), paths, names=False)
                shown: dict[int, set[str]] = {}
                for n in nodes:
                    shown.setdefault(n.path, set()).add(" ".join(n.children))
                held = set()
                for text, node in blocks:
                    t = _hash(text)
                    while node is not None and node.tag not in ("", "html", "body"):
                        held.add((node.path, t))
                        node = node.up
                rows = [(p, 0, _hash(*sorted(s))) for p, s in shown.items()] + [(p, 1, t) for p, t in held]
                out["host"] += [host] * len(rows)
                out["share"] += [share] * len(rows)
                for k, name in enumerate(("path", "kind", "value")):
                    out[name] += [r[k] for r in rows]
            yield pa.RecordBatch.from_pydict({n: pa.array(v, {"kind": pa.int32(), "share": pa.float64()}.get(n, pa.int64())) for n, v in out.items()})

    rows = pages.select(F.xxhash64(host_of(url_col)).alias("host"), F.col(html_col).alias("html"), F.xxhash64(html_col).alias("page"))
    # the n copies of a page count 1/n each; written for the same reason as the lists of branches
    copies = written(rows.groupBy("host", "page").agg(F.count("*").alias("n")).where("n > 1").select(F.col("host").alias("of"), F.bitwise_not("page").alias("copied"), (1 / F.col("n")).alias("share")), "copied-pages", narrow=True)
    rows = rows.join(copies, (F.col("host") == F.col("of")) & (F.col("page") == F.bitwise_not("copied")), "left").select("host", "html", F.coalesce("share", F.lit(1.0)).alias("share"))
    seen = rows.mapInArrow(run, "host long, path long, kind int, value long, share double")
    counts = seen.groupBy("host", "path", "kind", "value").agg(F.round(F.sum("share")).cast("long").alias("k"))
    shown, k = F.col("kind") == 0, F.col("k")
    sums = counts.groupBy("host", "path").agg(
        F.sum(F.when(shown, k)).alias("pages"),
        F.sum(F.when(shown, k * F.log(k.cast("double")))).alias("klogk"),
        F.avg(F.when(~shown, F.log(k.cast("double")))).alias("logk"),
    )
    base = F.log(F.col("pages").cast("double"))
    many = F.col("pages") > 1
    return sums.select(
        "host",
        "path",
        "pages",
        F.when(many, (base - F.col("klogk") / F.col("pages")) / base).otherwise(1.0).alias("presentation"),
        F.when(F.col("logk").isNull(), 0.0).when(many, 1 - F.col("logk") / base).otherwise(1.0).alias("content"),
    )


def importance_of() -> Column:
    """Of a row of style_tree, smoothed by its pages."""
    return (F.col("pages") * F.greatest("presentation", "content") + PRIOR) / (F.col("pages") + PRIOR)


def extract_main_text(pages: DataFrame, *, html_col: str = "html", url_col: str = "url", keep: tuple[str, ...] | None = None, importance: float = 0.75, names: bool = True) -> DataFrame:
    """The columns to keep (all by default), text and n_chars. Branches below that importance go.

    names: whether what names itself noise goes too; without it the style tree decides alone.
    """
    added = {"text": T.StringType(), "n_chars": T.LongType()}
    kept = [pages.schema[c] for c in (pages.columns if keep is None else keep) if c not in added]
    low = style_tree(pages, html_col=html_col, url_col=url_col).where(importance_of() < importance)
    # written, so that its size is known when the join is planned: small lists are broadcast, others joined
    lists = written(low.groupBy("host").agg(F.collect_list("path").alias("low")), "low-branches")
    rows = pages.select(F.struct(*[f.name for f in kept]).alias("row"), F.col(html_col).alias("html"), F.xxhash64(host_of(url_col)).alias("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, sets = Paths(), {}
        for batch in batches:
            row, low = (batch.column(batch.schema.get_field_index(c)) for c in ("row", "low"))
            texts = []
            for i, (page, host) in enumerate(zip(texts_of(batch, "html"), batch.column(batch.schema.get_field_index("host")).to_pylist(), strict=True)):
                if host not in sets:  # one for each host, while few are remembered
                    if len(sets) > 1000:
                        sets.clear()
                    sets[host] = frozenset(low[i].as_py() or ())
                texts.append(main_text(page.decode(), sets[host], paths, names))
            columns = {f.name: row.field(i) for i, f in enumerate(kept)}
            yield pa.RecordBatch.from_pydict(columns | {"text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    schema = T.StructType(kept + [T.StructField(k, t) for k, t in added.items()])
    return rows.join(lists, "host", "left").select("row", "html", "host", "low").mapInArrow(run, schema)
