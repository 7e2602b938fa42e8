"""HTML extraction by a site style tree.

Pages of one host are merged: a style node is a host and a path of elements (with class and id). Its
importance joins two entropies over the host's pages, article and main branches included. Contents: a
text that stands on d of the node's P pages is log d / log P common; menus, adverts, notices and footers
repeat a few texts, articles do not. Presentation: whether the node's number of blocks varies from page
to page. A text is also judged by itself, wherever it stands: by the share of the host's pages that hold
it, which is free of the host's size and finds a notice among an article's paragraphs. Elements that are
chrome by name (nav, footer, aside, form, ...) or by class have no importance. Article and main are a
prior: text inside is more important than the entropies say; text outside is less so on a page most of
whose text is inside. Unimportant blocks are removed from each page.

Copies of a page count once. Only hashes are shuffled; pages' hashes spread by content, counts are
pre-aggregated, so a host with a third of all pages is no single group of pages anywhere. What comes back
is one row per host, of bounded size: nodes on at least a thousandth of its pages, of which there are at
most a thousand times as many as a page has, and texts on about a quarter of its pages, at most some
four times as many. Rarer nodes are judged alike, but told to the pages that have them only, by a join
on what a page consists of.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, drop_cut, if_small, text_slices
from .op9_url_filter import host_and_path

#: What a "<" may begin: a comment, a CDATA section, a declaration, or a tag whose quotes open a value only
#: after "=". Every repeat is possessive, so a tag is read once whatever it holds.
OPENING = re.compile(
    r"<!--(?:-?>|.*?(?:-->|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>", re.S
)
#: A tag that ends at the next ">", for pages whose quotes leave no end to a tag.
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Fixed values of the HTML standard: elements without end tags, elements whose content is no markup,
#: elements inside a line of text, and what an open p or item is closed by.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noframes xmp svg annotation annotation-xml".split())
ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I) for tag in RAW}
IN_HEAD = frozenset("head base basefont link meta noframes noscript script style template title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr "
    "math mfrac mi mn mo mover mpadded mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
LISTS = frozenset("ul ol dl table article main body".split())
PARTS = frozenset("article main body td div section".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that are never part of an article.
CHROME = frozenset("head nav footer aside form button select dialog menu canvas audio video object applet".split()) | RAW
#: Words of a class, id or role that say the same, where the whole name is made of them and of words of
#: place: no-sidebar, has-comments or comments-open say something else.
CHROME_WORD = frozenset(
    "ad ads advert adverts advertisement advertisements adsense sponsor sponsored promo promos promotion promotions nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer footers masthead cookie cookies consent gdpr popup popups modal modals newsletter subscribe comment comments disqus share sharing social widget widgets pagination pager toolbar copyright skip skiplink contentinfo complementary".split()
)
#: Words that boilerplate and articles both use: the style tree decides.
EITHER_WORD = frozenset("header headers banner banners notice notices alert alerts search login related recommended replies respond toc".split())
PLACE_WORD = frozenset("site page main primary secondary global top bottom left right upper lower slot box area block bar wrap wrapper container inner outer list item items section unit google link links button buttons icon icons".split())
#: Comments are often articles of their own, so an element of comments may contain some.
COMMENT_WORD = frozenset("comment comments disqus".split())
#: A form around one of these is the page's frame.
FRAMED = frozenset("article main nav header footer aside h1".split())
NEVER_CHROME = frozenset("html body main article".split())
MAIN = ("article", "main")
#: Elements open at once; deeper ones leave no trace, as in browsers.
DEEPEST = 512
#: Blocks of importance below this go. Nodes and texts on fewer pages of the host are not evidence.
LEAST_IMPORTANCE, LEAST_PAGES = 0.6, 3
#: Nodes on fewer than one in so many of its pages are not told to all pages of a host.
RAREST = 1000
#: Importance of a node without evidence, and weight of the presentation in one with evidence.
UNKNOWN, PRESENTATION = 0.75, 0.2
#: Priors: by how much article and main close the gap to full importance, and the share that is left to
#: text outside on a page that has at least half of its text inside.
INSIDE, OUTSIDE = 0.5, 0.78


def label(tag: str, attributes: str) -> str:
    """Element name with its class and id: the presentation of a style node."""
    found = {m[1].lower(): " ".join((m[2] or m[3] or m[4] or "").split()) for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
    return tag + "".join(f"{mark}{found[k]}" for k, mark in (("class", "."), ("id", "#"), ("role", "@")) if found.get(k))


def name_parts(node: str) -> list[list[str]]:
    """The words of each class, id and role of a style node."""
    names = " ".join(re.split(r"[.#@]", node)[1:]).lower().replace("side-bar", "sidebar").split()
    return [[w for w in (x.rstrip("0123456789") for x in re.split(r"[-_]+", name)) if w] for name in names]


def named_chrome(node: str, tag: str) -> list[str] | None:
    """The words of the name that marks an element as chrome, if one does."""
    if tag in NEVER_CHROME or node == tag:
        return None
    for parts in name_parts(node):
        if not CHROME_WORD.isdisjoint(parts) and all(w in CHROME_WORD or w in EITHER_WORD or w in PLACE_WORD for w in parts):
            return parts
    return None


def content_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def pieces(page: str) -> Iterator[tuple[str, str, str | None, str]]:
    """A page as runs (text, "", None, "") and tags ("", slash, name, attributes). Raw elements are left
    out with their content; where the end tag of one is missing, a script or style reaches to the
    page's end and other tags are skipped. Time is linear in the page: what was not found ahead is not
    searched for again."""
    at, last, lenient, endless = 0, page.rfind(">"), False, set()
    while True:
        begin = page.find("<", at)
        if begin > at:
            yield page[at:begin], "", None, ""
        if begin < 0 or begin > last:
            if not page.startswith("<!--", begin):
                yield page[max(begin, at) :], "", None, ""
            return
        m = PLAIN_TAG.match(page, begin) if lenient else None
        m = m or OPENING.match(page, begin)
        if not m and (m := PLAIN_TAG.match(page, begin)):
            lenient = True
        if not m:
            yield "<", "", None, ""
            at = begin + 1
            continue
        at, tag = m.end(), (m[2] or "").lower()
        if tag not in RAW or m[1]:
            if tag:
                yield "", m[1], tag, m[3]
            continue
        if tag in endless or tag == "svg" and m[3].endswith("/"):
            continue
        end = ENDS[tag].search(page, at)
        if end:
            at = end.end()
        elif tag in ("script", "style"):
            return
        else:
            endless.add(tag)


class Mark:
    """An element that a name, or being a form, makes chrome until something inside speaks against it."""

    def __init__(self, form: bool, lasting: bool):
        self.on, self.form, self.lasting, self.prose, self.size = True, form, lasting, False, 0


def blocks(page: str) -> list[tuple[int, str, bool, bool]]:
    """Text blocks in page order: hash of the style path, text (references decoded, white space
    joined), whether it stands in chrome, whether inside article or main. A name marks no element that
    contains an article or main as chrome. A form is none if it frames the page: it contains one of
    those, a header, footer, menu or main heading, or paragraphs and at least half of the page's text.
    Unclosed and misplaced tags are handled as browsers do for head, p and list items; an end tag
    without its element is skipped."""
    out, stack, text, forms = [], [], [], []
    opened: Counter[str] = Counter()
    # Of the open elements: hash of the path, stands in chrome by tag, inside main, marks.
    states: list[tuple[int, bool, bool, tuple[Mark, ...]]] = [(0, False, False, ())]

    def flush() -> None:
        if text:
            joined = " ".join(html_lib.unescape("".join(text)).split())
            text.clear()
            if joined:
                out.append((joined, *states[-1]))

    def close_to(depth: int) -> None:
        opened.subtract(stack[depth:])
        del stack[depth:], states[depth + 1 :]

    for words, slash, tag, attributes in pieces(page):
        if tag is None:
            text.append(words)
            continue
        inline = tag in INLINE
        if slash:
            for depth in range(len(stack) - 1, -1, -1) if opened[tag] > 0 else ():
                if stack[depth] == tag:
                    if not inline:
                        flush()
                    close_to(depth)
                    break
                if inline and stack[depth] not in INLINE:
                    break
            continue
        if opened["head"] > 0 and tag not in IN_HEAD:
            flush()
            close_to(stack.index("head"))
        if tag in VOID:
            if tag in ("br", "hr"):
                text.append(" ")
            if tag == "hr":
                flush()
            continue
        if not inline:
            flush()
            closes = SIBLINGS.get(tag) or ({"p"} if tag in CLOSES_P else ())
            limit = LISTS if tag in SIBLINGS else PARTS
            for depth in range(len(stack) - 1, -1, -1) if any(opened[t] > 0 for t in closes) else ():
                if stack[depth] in closes:
                    close_to(depth)
                    break
                if stack[depth] in limit:
                    break
        path, chrome, main, marks = states[-1]
        node = label(tag, attributes)
        if not inline:
            path = content_hash(f"{path}/{node}")
        starts_main = tag in MAIN or "@main" in node
        for mark in marks:
            if starts_main or mark.form and tag in FRAMED:
                mark.on = mark.on and mark.lasting
            mark.prose |= tag == "p"
        named = None if starts_main else named_chrome(node, tag)
        if named or tag == "form" and not opened["form"] > 0:
            mark = Mark(not named, bool(named) and not COMMENT_WORD.isdisjoint(named))
            marks = (*marks, mark)
            if mark.form:
                forms.append(mark)
        if len(stack) < DEEPEST:
            stack.append(tag)
            opened[tag] += 1
            inner = chrome and tag != "main" or tag in CHROME and tag != "form" or tag == "header" and not main
            states.append((path, inner, main or starts_main, marks))
    flush()
    if forms:
        total = 0
        for joined, _, chrome, _, marks in out:
            if not chrome:
                total += len(joined)
                for mark in marks:
                    mark.size += len(joined)
        for mark in forms:
            mark.on = mark.on and not (mark.prose and 2 * mark.size >= total)
    return [(path, joined, chrome or any(mark.on for mark in marks), main) for joined, path, chrome, main, marks in out]


def page_nodes(pages: DataFrame) -> DataFrame:
    """(host, nodes, texts) of each distinct page: (path, number of blocks, distinct contents) of every
    style node outside chrome, and the distinct contents of the page, as hashes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "html"):
                digests, nodes, texts = [], [], []
                for page in batch.column("html").to_pylist():
                    found: dict[int, list[int]] = {}
                    for path, text, chrome, _ in blocks(page or ""):
                        if not chrome:
                            found.setdefault(path, []).append(content_hash(text))
                    digests.append(content_hash(repr(sorted(found.items()))))
                    nodes.append([{"path": k, "n": len(v), "contents": sorted(set(v))} for k, v in found.items()])
                    texts.append(sorted({c for v in found.values() for c in v}))
                node = pa.struct([("path", pa.int64()), ("n", pa.int32()), ("contents", pa.list_(pa.int64()))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("host"), pa.array(digests, pa.int64()), pa.array(nodes, pa.list_(node)), pa.array(texts, pa.list_(pa.int64()))], ["host", "digest", "nodes", "texts"]
                )

    kind = "host string, digest long, nodes array<struct<path:long,n:int,contents:array<long>>>, texts array<long>"
    rows = pages.select("host", "html").mapInArrow(read, kind).filter("size(texts) > 0")
    return rows.dropDuplicates(["host", "digest"])


def page_digest(page: str | None) -> int:
    """The digest of a page's nodes and contents outside chrome, by which ``page_nodes`` knows copies."""
    found: dict[int, list[int]] = {}
    for path, text, chrome, _ in blocks(page or ""):
        if not chrome:
            found.setdefault(path, []).append(content_hash(text))
    return content_hash(repr(sorted(found.items())))


def node_importance(pages: DataFrame, least_pages: int, rare: bool = False) -> DataFrame:
    """(host, key, importance) of the style nodes of ``page_nodes`` that stand on enough pages: on at least
    one in RAREST of the host's pages, or with ``rare`` on fewer."""
    nodes = pages.select("host", F.explode("nodes").alias("node")).select("host", "node.*")
    sizes = pages.groupBy("host").agg(F.count("*").alias("of"))
    told = RAREST * F.col("pages") >= F.col("of")
    some = (F.col("pages") >= least_pages) & (~told if rare else told)
    logs = F.log(F.col("pages").cast("double"))
    f = F.col("f").cast("double")
    shapes = nodes.groupBy("host", "path", "n").agg(F.count("*").alias("f")).groupBy("host", "path")
    shapes = shapes.agg(F.sum("f").alias("pages"), F.sum(f * F.log(f)).alias("flogf")).join(sizes, "host").filter(some)
    shapes = shapes.select("host", "path", "pages", ((logs - F.col("flogf") / F.col("pages")) / logs).alias("shape"))
    d = F.col("d").cast("double")
    contents = nodes.select("host", "path", F.explode("contents").alias("content")).groupBy("host", "path", "content").agg(F.count("*").alias("d"))
    contents = contents.groupBy("host", "path").agg((F.sum(d * F.log(d)) / F.sum(d)).alias("common"))
    both = shapes.join(contents, ["host", "path"])
    return both.select("host", F.col("path").alias("key"), ((1 - PRESENTATION) * (1 - F.col("common") / logs) + PRESENTATION * F.col("shape")).alias("importance"))


def text_importance(pages: DataFrame, least_pages: int, least: float) -> DataFrame:
    """(host, key, importance) of texts on so large a share of the host's pages that they may go."""
    sizes = pages.groupBy("host").agg(F.count("*").alias("pages"))
    texts = pages.select("host", F.explode("texts").alias("key")).groupBy("host", "key").agg(F.count("*").alias("d")).filter(F.col("d") >= least_pages)
    out = texts.join(sizes, "host").select("host", "key", (1 - F.col("d") / F.col("pages")).alias("importance"))
    return out.filter(OUTSIDE * F.col("importance") < least)


def kept_blocks(page: str, nodes: dict[int, float], texts: dict[int, float], least: float) -> list[str]:
    """Texts of the important blocks of a page, by its host's importance of nodes and of texts."""
    found = [b for b in blocks(page) if not b[2]]
    within = sum(len(b[1]) for b in found if b[3])
    mostly = 2 * within >= sum(len(b[1]) for b in found)
    out = []
    for path, text, _, inside in found:
        importance = min(nodes.get(path, UNKNOWN), texts.get(content_hash(text), 1.0))
        if inside:
            importance += INSIDE * (1 - importance)
        elif mostly:
            importance *= OUTSIDE
        if importance >= least:
            out.append(text)
    return out


def extract_main_text(pages: DataFrame, least: float = LEAST_IMPORTANCE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``pages`` (page_id, url, html, ...) plus ``text``: the blocks kept, joined by newlines.

    Kept are blocks outside chrome whose importance is ``least`` or more: the lesser of their style
    node's and their own text's, moved by the prior of article and main. Of nodes and texts on fewer
    than ``least_pages`` distinct pages of the host nothing is concluded. Null or empty html gives an
    empty text. Null urls share one empty host. A column named text is replaced.
    """
    host, _ = host_and_path(F.col("url"))
    hosted = bounded_batches(pages).withColumn("_host", host)
    read = cut(page_nodes(hosted.select(F.col("_host").alias("host"), "html")), "page_nodes")
    # Keys of both kinds are 64-bit hashes; those of nodes and of texts are told apart by the kind.
    every = node_importance(read, least_pages).withColumn("node", F.lit(True)).union(text_importance(read, least_pages, least).withColumn("node", F.lit(False)))
    known = every.groupBy("host").agg(F.collect_list(F.struct("node", "key", "importance")).alias("_known"))
    known = cut(known.withColumnRenamed("host", "_known_host"), "style_nodes")
    # Nodes on few pages, beside the distinct pages that have them.
    rare = read.select("host", "digest", F.explode("nodes.path").alias("key")).join(node_importance(read, least_pages, rare=True), ["host", "key"])
    rare = rare.groupBy(F.col("host").alias("_rare_host"), F.col("digest").alias("_rare_digest")).agg(F.collect_list(F.struct("key", "importance")).alias("_rare"))
    rare = cut(rare, "rare_nodes")
    told = rare.agg(F.count("*").alias("pages"), F.sum(F.size("_rare")).alias("nodes")).first()
    drop_cut(read)
    size = known.agg(F.sum(F.size("_known"))).first()[0] or 0
    hosts = max(1, known.count())
    joined = hosted.join(if_small(known, 256 + 32 * size // hosts), F.col("_host") == F.col("_known_host"), "left")

    if told.pages:

        @F.arrow_udf("long")
        def digest(htmls: pa.Array) -> pa.Array:
            return pa.array([page_digest(page.as_py()) for page in htmls], pa.int64())

        joined = joined.withColumn("_digest", digest("html"))
        joined = joined.join(if_small(rare, 256 + 24 * told.nodes // told.pages), F.col("_host").eqNullSafe(F.col("_rare_host")) & (F.col("_digest") == F.col("_rare_digest")), "left")
    else:
        joined = joined.withColumn("_rare", F.lit(None).cast("array<struct<key:long,importance:double>>"))

    @F.arrow_udf("string")
    def keep(htmls: pa.Array, hosts: pa.Array, known: pa.Array, rare: pa.Array) -> pa.Array:
        out, of_host = [], {}
        for i, (page, host) in enumerate(zip(htmls, hosts.to_pylist())):
            if host not in of_host:
                found = known[i].as_py() or ()
                of_host[host] = [{k["key"]: k["importance"] for k in found if k["node"] == kind} for kind in (True, False)]
            nodes, texts = of_host[host]
            own = {k["key"]: k["importance"] for k in rare[i].as_py() or ()}
            out.append("\n".join(kept_blocks(page.as_py() or "", {**nodes, **own} if own else nodes, texts, least)))
        return pa.array(out, pa.string())

    own = [c for c in pages.columns if c != "text"]
    return joined.select(*own, keep("html", "_host", "_known", "_rare").alias("text"))


def op10_html_main_text(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    out = extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
