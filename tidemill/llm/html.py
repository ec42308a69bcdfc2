"""Operator 6: main text of pages by site style trees.

Pages of one host are merged into a tree of style nodes (tag, classes and id along the path from
the root). Two entropies weigh a node: how differently its children are laid out from page to
page, and how evenly its contents repeat over the pages. The importance of a branch is that of all text
in it; branches and nodes of low importance are removed from each page. So is text under elements that HTML
or their names mark as menus, headers, footers, sidebars, notices, adverts, forms or comments, unless the
page shows that they hold its main part. Whole pages are copied on this kind of corpus, so pages of one
host with the same unmarked text count as one page.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import arrow_batches, map_rows, pieces, written
from tidemill.llm.urlrules import host_of

#: Weight of a node's own contents against its parent's layout; a node or branch of less importance than LEAST is dropped.
GAMMA, LEAST = 0.9, 0.2
#: A branch stays, whatever else it holds, if this part of the important text of its host is in it.
SHARE = 0.1
#: Levels above a text that its branches are looked at, at most; style nodes that a task remembers to have sent.
LEVELS, SENT = 64, 1 << 16
#: Parts into which the pages of a host are dealt at most.
SALTS = 1024
#: The style node of a whole page. Others are numbered by a hash of their path, which does not grow with its depth.
ROOT = 0

RAW = "script|style|noscript|template|svg|iframe|textarea|title"
#: An attribute: its value ends at its closing quote; a quote that is never closed, and a value without quotes, at white space or ``>``.
ATTRIBUTE = r"""[^\s/>][^\s/>=]*(?:\s*=\s*(?>"[^"]*"|'[^']*'|[^\s>]*))?"""
TAG = re.compile(rf"""<!--.*?(?:-->|\Z)|<svg\b[^>]*/>|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[\s/]+|{ATTRIBUTE})*+)(?:>|\Z)|<[!?][^>]*>""", re.S | re.I)
NAMED = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?>"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
BLOCKS = frozenset("html head body p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th caption section article main header footer nav aside form blockquote pre figure figcaption address fieldset details summary hr dialog menu".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
#: Tags that mark what is below them; a form, like a name, may be around a whole page.
BOILERPLATE_TAGS = frozenset("head nav header footer aside form button select option label input menu dialog".split())
#: Words that mark an element wherever they stand in one of its names, those that do so as the last word only, and those that say that it has or lacks something.
BOILERPLATE_WORDS = re.compile(r"ads?|advert\w*|adbox|adslot|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|masthead|footer|sidebar|aside|widgets?|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscri\w*|signup|comments?|disqus|replies|related|recommend\w*|pagination|pager|toolbar|complementary|contentinfo", re.I)
LAST_WORDS = re.compile(r"banner|header|foot|side|notices?|alerts?|login|search|forms?|respond|share|sharing|social", re.I)
STATES = frozenset("has no with without is not hide show".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Opening one of these ends an open paragraph.
ENDS_P = BLOCKS - {"html", "head", "body", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "summary", "figcaption"}
SCOPES = frozenset(("ul", "ol", "dl", "table", "article", "main", "section", "div", "body", "blockquote", "td", "th"))


@lru_cache(maxsize=1 << 14)
def below(path: int, step: str) -> int:
    """The style node of a child."""
    return stable(f"{path}/{step}")


@lru_cache(maxsize=1 << 14)
def marked_by_name(names: str) -> bool:
    """Whether a class, id or role says that an element is no main text."""
    for name in names.split():
        words = re.split(r"[-_]+", name.lower().strip("-_"))
        if STATES.isdisjoint(words) and (LAST_WORDS.fullmatch(words[-1]) or any(map(BOILERPLATE_WORDS.fullmatch, words))):
            return True
    return False


@lru_cache(maxsize=1 << 14)
def names_of(attributes: str) -> str:
    """Class, id and role of a tag."""
    return " ".join(a or b or c for name, a, b, c in NAMED.findall(attributes) if name.lower() in ("class", "id", "role"))


#: What an element is marked by: a tag, or a tag or name that may be around a whole page.
BY_TAG, BY_NAME = 1, 2
Block = tuple[int, int, bool, str]


def walk(html: str) -> tuple[list[Block], dict[int, list[str]], dict[int, int]]:
    """Blocks of a page (style node, its parent, marked as boilerplate, text), the children of each style node, in order, and the parent of each."""
    children: dict[int, list[str]] = {}
    above: dict[int, int] = {}
    # of each element: the one it stands in, what marks it, whether it may be the page's main part, its own text's length
    inside, marks, mains, sizes = [0], [0], [0], [0]
    stack: list[tuple[str, int, int, int]] = [("", ROOT, ROOT, 0)]  # tag, style node, its parent, element
    buffer: list[tuple[int, str]] = []
    raw: list[tuple[int, int, list[tuple[int, str]]]] = []

    def flush() -> None:
        nonlocal buffer
        if buffer:
            raw.append((stack[-1][1], stack[-1][2], buffer))
            buffer = []

    def close(names: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                flush()
                del stack[k:]
                return
            if stack[k][0] in SCOPES:
                return

    def text(piece: str) -> None:
        buffer.append((stack[-1][3], piece))
        sizes[stack[-1][3]] += len(piece.strip())

    at = 0
    for m in TAG.finditer(html):
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        if not (tag := m[3]):
            continue
        tag = tag.lower()
        if m[2]:  # an end tag
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    if tag in BLOCKS:
                        flush()
                    del stack[k:]
                    break
            continue
        if tag == "br":
            buffer.append((stack[-1][3], "\n"))
        if tag in ENDS_P:
            close(("p",))
        if tag in CLOSES and tag != "p":
            close(CLOSES[tag])
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        names = names_of(m[4]) if m[4] else ""
        _, path, parent, element = stack[-1]
        named = bool(names) and tag not in ("html", "body") and marked_by_name(names)
        mark = BY_TAG if tag in BOILERPLATE_TAGS and tag != "form" else BY_NAME if named or tag == "form" else 0
        main = 0 if mark else 2 if tag == "main" or "main" in names.split() else 1 if tag == "article" else 0
        if tag in BLOCKS:
            flush()
            step = tag + ("." + re.sub(r"\d+", "0", names) if names else "")
            children.setdefault(path, []).append(step)
            path, parent = below(path, step), path
            above[path] = parent
        if m[4].rstrip().endswith("/") and tag not in BLOCKS:
            continue
        if mark or main:
            inside.append(element)
            marks.append(mark)
            mains.append(main)
            sizes.append(0)
            element = len(inside) - 1
        stack.append((tag, path, parent, element))
    if at < len(html):
        text(html[at:])
    flush()
    dead = boilerplate(inside, marks, mains, sizes)
    blocks: list[Block] = []
    for path, parent, parts in raw:
        alive = [not dead[element] for element, _ in parts]
        kept = " ".join(entities.unescape("".join(piece for (_, piece), on in zip(parts, alive, strict=True) if on)).split()) if any(alive) else ""
        if kept:
            blocks.append((path, parent, False, kept))
        if not all(alive) and (gone := " ".join(entities.unescape("".join(piece for (_, piece), on in zip(parts, alive, strict=True) if not on)).split())):
            blocks.append((path, parent, True, gone))
    return blocks, children, above


def boilerplate(inside: list[int], marks: list[int], mains: list[int], sizes: list[int]) -> list[bool]:
    """Which elements stand under a mark that counts.

    The main part is the unmarked ``main`` with the most text, else such an ``article``. A mark around it does not count; on
    a page without one, a name or a form does not count around more than half of the text. Elements come after those they stand in.
    """
    whole = list(sizes)
    for e in range(len(whole) - 1, 0, -1):
        whole[inside[e]] += whole[e]
    main = max((e for e in range(1, len(whole)) if mains[e] and whole[e]), key=lambda e: (mains[e], whole[e], -e), default=0)
    holds, e = set(), main
    while e:
        holds.add(e)
        e = inside[e]
    dead = [False] * len(whole)
    for e in range(1, len(whole)):
        counts = marks[e] and e not in holds and (marks[e] == BY_TAG or main or 2 * whole[e] <= whole[0])
        dead[e] = dead[inside[e]] or bool(counts)
    return dead


def unmarked(html: str | None) -> list[tuple[int, str]]:
    """The blocks of a page that nothing marks as boilerplate: style node and text."""
    return [(path, text) for path, _, boiler, text in walk(html or "")[0] if not boiler]


def main_text(html: str | None, dropped: frozenset[int] = frozenset()) -> str:
    """The main text of a page, without blocks at the ``dropped`` style nodes; blocks are joined by line ends."""
    return "\n".join(text for path, text in unmarked(html) if path not in dropped)


FEATURE = {"path": pa.int64(), "parent": pa.int64(), "kind": pa.int32(), "feature": pa.int64(), "size": pa.int64()}
#: Kinds of features: a node's contents, its layout, the page itself, a branch (``parent``) that a node stands in.
CONTENT, LAYOUT, PAGE, BRANCH = range(4)


def page_features(html: str | None) -> tuple[int, list[dict], dict[int, int]]:
    """What identifies a page among its copies, its unmarked text, what the page adds to the tree of its host, and the parents of its style nodes."""
    blocks, children, above = walk(html or "")
    own = [(path, parent, text) for path, parent, boiler, text in blocks if not boiler]
    features = {(path, parent, CONTENT, stable(text), len(text)) for path, parent, text in own} | {(path, path, LAYOUT, stable("\n".join(steps)), 0) for path, steps in children.items()} | {(ROOT, ROOT, PAGE, 0, 0)}
    return stable("\n".join(f"{path}\t{text}" for path, _, text in own)), [dict(zip(FEATURE, x, strict=True)) for x in sorted(features)], above


def branches(path: int, above: dict[int, int]) -> list[int]:
    """The style nodes that a node stands in, from itself up."""
    out = [path]
    while out[-1] in above and len(out) < LEVELS:
        out.append(above[out[-1]])
    return out


def style_nodes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """The merged trees of all hosts: host, path, parent, pages, importance, chars (of all different pages), and the branches: host, path, branch.

    Copies of a page count once for each host. They, and what different pages have in common, are
    put together in each task before the shuffle, so a host with a third of all pages does no harm.
    """
    feature = pa.struct(list(FEATURE.items()))
    schema = pa.schema([("host", pa.string()), ("copy", pa.int64()), ("features", pa.list_(feature))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[str, int]] = set()
        for batch in pieces(batches):
            rows = []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                copy, features, above = page_features(html)
                rows.append((host, copy, features))
                # the branches of a node hang on the node alone, so a task sends them once
                for path in {f["path"] for f in features if f["kind"] == CONTENT}:
                    if (host, path) not in sent:
                        if len(sent) >= SENT:
                            sent.clear()
                        sent.add((host, path))
                        rows.append((host, path, [dict(zip(FEATURE, (path, branch, BRANCH, 0, 0), strict=True)) for branch in branches(path, above)]))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    rows = arrow_batches(pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))).mapInArrow(run, "host string, copy bigint, features array<struct<path:bigint,parent:bigint,kind:int,feature:bigint,size:bigint>>")
    # copies may differ in what is marked: the least list stands for all of them, in whatever order they come
    distinct = rows.groupBy("host", "copy", (F.element_at("features", 1)["kind"] == BRANCH).alias("branch")).agg(F.min("features").alias("features"))
    features = distinct.select("host", F.inline("features")).groupBy("host", "path", "parent", "kind", "feature").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    log_n = F.log(F.col("n").cast("double"))
    nodes = features.groupBy("host", "path", "parent", "kind").agg(F.sum("n").alias("total"), F.avg(log_n).alias("log_n"), F.sum(F.col("n") * log_n).alias("n_log_n"), F.sum(F.col("n") * F.col("size")).alias("chars"))
    nodes = written(nodes, "style-nodes")
    sizes = nodes.where(F.col("kind") == PAGE).select("host", F.col("total").alias("pages"))
    own = nodes.join(sizes, "host").withColumn("log_m", F.log(F.greatest(F.col("pages"), F.lit(2)).cast("double")))
    # contents: 1 where each stands on one page, 0 where each stands on all; layout: the entropy of the child lists
    content = own.where(F.col("kind") == CONTENT).select("host", "path", "parent", "pages", "chars", (1 - F.col("log_n") / F.col("log_m")).alias("content"))
    layout = own.where(F.col("kind") == LAYOUT).select("host", F.col("path").alias("parent"), ((F.log(F.col("total").cast("double")) - F.col("n_log_n") / F.col("total")) / F.col("log_m")).alias("layout"))
    # m pages speak with a weight of 1 - 1 / m: one page says nothing about what repeats, few say little
    repeats = 1 - (1 - GAMMA) * F.coalesce("layout", F.lit(0.0)) - GAMMA * F.col("content")
    weighed = content.join(layout, ["host", "parent"], "left").withColumn("importance", 1 - (1 - 1 / F.col("pages")) * repeats)
    return weighed, nodes.where(F.col("kind") == BRANCH).select("host", "path", F.col("parent").alias("branch"))


def unimportant(weighed: DataFrame, within: DataFrame, least: float = LEAST) -> DataFrame:
    """(host, path) of the style nodes whose text goes: their own importance is low, or that of a branch they stand in.

    A branch weighs as its text does: the mean importance by length. One that holds a good part of what is important on the
    host stays and only its nodes are judged.
    """
    text = F.col("chars").cast("double")
    important = F.when(F.col("importance") >= least, text).otherwise(0.0)
    sums = within.join(weighed, ["host", "path"]).groupBy("host", "branch").agg(F.sum(F.col("importance") * text).alias("weight"), F.sum(text).alias("text"), F.sum(important).alias("important"))
    host = weighed.groupBy("host").agg(F.sum(important).alias("all"))
    low = sums.join(host, "host").where((F.col("weight") < least * F.col("text")) & (F.col("important") < SHARE * F.col("all"))).select("host", "branch")
    gone = within.join(low, ["host", "branch"]).select("host", "path")
    return weighed.where(F.col("importance") < least).select("host", "path").unionByName(gone).distinct()


def stable(text: str) -> int:
    """A 64-bit hash that is the same in every process."""
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: float = LEAST) -> DataFrame:
    """Returns ``id_col``, ``url``, ``text`` and ``n_chars`` for every row.

    A null page counts as empty; a page without main text gives an empty text. A null URL or one
    without a host joins the pages of the empty host. Repeated rows give one row each; further
    columns are left out; an empty table gives an empty one.
    """
    dropped = unimportant(*style_nodes(pages, url_col, html_col), least).groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("dropped"))
    id_type = pages.schema[id_col].dataType.simpleString()
    block = pa.list_(pa.struct([("path", pa.int64()), ("text", pa.string())]))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            blocks = [[{"path": path, "text": text} for path, text in unmarked(html)] for html in batch.column(4).to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(blocks, block)], [id_col, "url", "host", "salt", "blocks"])

        return each

    # a hot host goes to as many tasks as it has salts; what it drops is sent to those only, and no HTML is shuffled
    salted = pages.select(F.col(id_col), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.pmod(F.xxhash64(id_col, url_col), F.lit(SALTS)).alias("salt"), F.col(html_col).alias("html"))
    parts = salted.select("host", "salt").distinct().join(dropped, "host")
    rows = map_rows(salted, make, f"{id_col} {id_type}, url string, host string, salt bigint, blocks array<struct<path:bigint,text:string>>").join(parts, ["host", "salt"], "left")
    kept = F.when(F.col("dropped").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda b: ~F.array_contains("dropped", b["path"])))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return rows.select(id_col, "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
