"""Main text of pages by a site style tree.

The elements of all pages of a host are merged by their path of labels (tag, classes and id
without digits). Two entropies, over a host's pages, say how much a node varies: of the child
labels it shows (presentation) and of the text it holds (content). A menu or notice that is the
same everywhere scores near 0, an article near 1. The importance of a branch blends a
node's own with the mean of its children's, the nearer the more; nodes that few pages show are
drawn towards 1, for nothing is known about them. Texts of prose have an importance of their own: the share of the
host's different pages that lack them, so a notice without a class of its own is found among paragraphs.
Each page then loses what has low importance.

What the markup says is a weight on that importance: full in an article or on a page without one, less
beside an article, so that repeated text there goes earlier, and little for menus, adverts, forms or comments. That last weight is
lifted from a branch that holds nearly all of a page: a page wrapped in a form or in an element named `has-sidebar` keeps its text.
"""

from __future__ import annotations

import html as html_library
import re
from collections import Counter
from collections.abc import Container, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from claimspark.llm.common import bounded_batches, materialize, text_of
from claimspark.llm.url_filter import host_of

#: Weighed importance below which a block goes.
THRESHOLD = 0.3
#: Uses of a node, and share of its host's pages, at which its entropy and the initial 1 count alike. The share also bounds how many
#: nodes of a host can have low importance: 1 / PRIOR_SHARE times the nodes of a page.
PRIOR_USES = 4
PRIOR_SHARE = 0.005
#: Share of a node's own importance is 1 - DECAY ** children.
DECAY = 0.9
#: Weights by markup: menus, adverts and the like; what stands beside an article.
NOISE_WEIGHT = 0.25
BESIDE = 0.6
#: Prose of an article goes if all but this share of the host's different pages hold it (with `PRIOR_USES` pages that lack it added).
PROSE_THRESHOLD = 0.15
#: A branch with this share of a page's text isn't taken for a menu or the like if it holds the article, or if all else is.
MOST = 0.8
#: Levels of a path that are blended; a deeper element is a branch of its own below its ancestor at this level.
DEPTH = 24

# HTML's own element groups and the usual names of page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg math canvas object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
ARTICLE = frozenset("article main".split())
NOISE = frozenset("nav footer aside button menu dialog".split())
WRAPS = frozenset("form fieldset".split())
UNSEEN = frozenset("head select audio video map datalist".split())
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar widget menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices alert newsletter subscribe subscription popup modal overlay "
    "social share sharing related recommended comment comments disqus respond replies reply pagination pager toolbar skip login signin signup search copyright "
    "contentinfo complementary hidden".split()
)
ARTICLE_NAMES = frozenset("article main".split())
#: Elements that a name alone doesn't drop, but for an article within an article, such as a comment.
WHOLE = frozenset("html body main article".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

_TAG = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[!?/][^>]*>)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

NOISE_KIND, ARTICLE_KIND, PLAIN_KIND, NAMED_KIND, WRAP_KIND, HIDDEN_KIND = range(6)


@lru_cache(20_000)
def describe(tag: str, attributes: str) -> tuple[str, int]:
    """Label and kind of an element: noise, article, plain, an article or page with a name of noise, noise that may wrap a page, hidden."""
    of_tag = HIDDEN_KIND if tag in UNSEEN else WRAP_KIND if tag in WRAPS else NOISE_KIND if tag in NOISE else ARTICLE_KIND if tag in ARTICLE else PLAIN_KIND
    if not attributes.strip(" /\t\r\n"):
        return tag, of_tag
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    names = sorted({re.sub(r"\d+", "", n) for n in (found.get("class", "") + " " + found.get("id", "")).split()})
    words = {w.lower() for w in _NAME.findall(" ".join(names) + " " + found.get("role", ""))}
    label = ".".join([tag, *names]).replace("/", "|")
    style = found.get("style", "").replace(" ", "").lower()
    if tag in UNSEEN or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style:
        return label, HIDDEN_KIND
    if of_tag in (NOISE_KIND, WRAP_KIND):
        return label, of_tag
    if words & NOISE_NAMES:
        return label, NAMED_KIND if tag in WHOLE else WRAP_KIND
    if tag in ARTICLE or words & ARTICLE_NAMES:
        return label, ARTICLE_KIND
    return label, PLAIN_KIND


class _Node:
    __slots__ = ("tag", "path", "depth", "article", "noise", "children")

    def __init__(self, tag: str, path: str, depth: int, article: bool, noise: tuple[int, ...]):
        self.tag, self.path, self.depth, self.article, self.noise, self.children = tag, path, depth, article, noise, []


@dataclass(frozen=True)
class Block:
    """A run of text: where it stands, and the numbers of the noise branches it lies in, outermost first; negative if none may wrap a page."""

    path: str
    article: bool
    prose: bool
    noise: tuple[int, ...]
    text: str


def parse(page: str) -> tuple[list[Block], list[tuple[str, tuple]]]:
    """Blocks in page order, and (path, child labels) of every element closed.

    Tolerates what browsers do: paragraphs, list items and cells end where the next begins, stray end tags
    are ignored, open elements end with the page.
    """
    root = _Node("", "", 0, False, ())
    stack, blocks, shapes, text, branches = [root], [], [], [], 0
    at, end = 0, len(page)

    def flush() -> None:
        if text:
            words = html_library.unescape("".join(text)).split()
            text.clear()
            node = stack[-1]
            if words:
                blocks.append(Block(node.path, node.article, node.tag in PROSE, node.noise, " ".join(words)))

    def close(count: int) -> None:
        flush()
        for _ in range(count):
            node = stack.pop()
            shapes.append((node.path, tuple(node.children)))

    while at < end:
        found = _TAG.search(page, at)
        if found is None:
            text.append(page[at:])
            break
        if found.start() > at:
            text.append(page[at : found.start()])
        at = found.end()
        closing, tag, attributes = found.group(1, 2, 3) if found[2] else found.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if not closing and attributes and ("class" in attributes or "hidden" in attributes or "style" in attributes or "id=" in attributes) and describe(tag, attributes)[1] in (WRAP_KIND, HIDDEN_KIND):
                tag = "noise-" + tag  # an advert or hidden part in a line of text is a branch of its own
            elif closing and len(stack) > 1 and stack[-1].tag == "noise-" + tag:
                close(1)
                continue
            else:
                continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(len(stack) - k)
                    break
            else:
                if tag in ("p", "br"):
                    text.append(" ")
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(page, at)
            if not attributes.rstrip().endswith("/") or tag not in ("svg", "math"):
                at = stop.end() if stop else end
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(len(stack) - k)
                    break
                if stack[k].tag in ("td", "th", "button", "table"):
                    break
        elif tag in SIBLINGS:
            ends, within = SIBLINGS[tag]
            deepest = 0
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in within:
                    break
                if stack[k].tag in ends:
                    deepest = k
            if deepest:
                close(len(stack) - deepest)
        flush()
        if tag == "body":
            while len(stack) > 1 and stack[-1].tag == "head":
                close(1)
        parent = stack[-1]
        label, kind = describe(tag.removeprefix("noise-"), attributes)
        if kind == NAMED_KIND:
            kind = NOISE_KIND if parent.article else ARTICLE_KIND if tag in ARTICLE else PLAIN_KIND
        noise = parent.noise
        if kind in (NOISE_KIND, WRAP_KIND, HIDDEN_KIND) or (tag == "header" and not parent.article):
            branches += 1
            noise = (*noise, branches if kind == WRAP_KIND else -branches)
        if parent.depth < DEPTH:
            path = f"{parent.path}/{label}"
        else:
            path = f"{parent.path.partition('//')[0]}//{label}"
        if not parent.children or parent.children[-1] != label:
            parent.children.append(label)
        stack.append(_Node(tag, path, min(parent.depth + 1, DEPTH + 1), parent.article or kind == ARTICLE_KIND, noise))
    flush()
    if len(stack) > 1:
        close(len(stack) - 1)
    return blocks, shapes


def _digest(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass")) - 2**63


def lifted(blocks: list[Block]) -> list[Block]:
    """Blocks with the noise mark taken from branches that wrap most of the page, one after the other from outside.

    Such a branch is noise by its name or as a form only, holds `MOST` of the page's text, and in it, outside further noise,
    the article or, where nothing else is left, prose.
    """
    total = sum(len(b.text) for b in blocks)
    while True:
        clean = [b for b in blocks if not b.noise]
        if any(b.article for b in clean):
            return blocks
        sizes: Counter[int] = Counter()
        for b in blocks:
            if b.noise and b.noise[0] > 0:
                sizes[b.noise[0]] += len(b.text)
        branch = max(sizes, key=lambda k: (sizes[k], -k), default=0)
        direct = [b for b in blocks if b.noise[:1] == (branch,) and all(k > 0 for k in b.noise)]
        if sizes[branch] < MOST * total or not any(b.article or (b.prose and not clean) for b in direct):
            return blocks
        blocks = [replace(b, noise=b.noise[1:]) if b.noise[:1] == (branch,) else b for b in blocks]


def _signature(blocks: list[Block]) -> int:
    """Equal for pages with the same text, so that copies of a page count once."""
    return _digest("\n".join(b.text for b in blocks if not b.noise))


_VALUES = "host string, path string, kind int, value long, page long"


def _node_values(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shapes (kind 0) and texts (kind 1) of the nodes of each page, its prose (kind 2), and the page (kind 3)."""
    for frame in frames:
        found: set = set()
        for host, page in zip(frame["host"], frame["html"]):
            blocks, shapes = parse(page or "")
            blocks = lifted(blocks)
            number = _signature(blocks)
            found.add((host, "", 3, number, number))
            found.update((host, path, 0, _digest(" ".join(labels)), number) for path, labels in shapes)
            for block in blocks:
                value = _digest(block.text)
                found.add((host, block.path, 1, value, number))
                if block.prose and not block.noise:
                    found.add((host, "", 2, value, number))
        yield pd.DataFrame(list(found), columns=["host", "path", "kind", "value", "page"])


def site_values(pages: DataFrame, host: Column, html: Column) -> DataFrame:
    """The values of all nodes of all hosts and on how many different pages (`n`) each is; written once. Copies of a page are one page."""
    bounded_batches(pages.sparkSession)
    values = pages.select(host.alias("host"), html.alias("html")).mapInPandas(_node_values, _VALUES)
    # Equal values meet first, so a host with a third of all pages is spread by value.
    counted = values.distinct().groupBy("host", "path", "kind", "value").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return materialize(counted, "site-values")


def repeated_prose(values: DataFrame, threshold: float = PROSE_THRESHOLD, prior: float = PRIOR_USES) -> DataFrame:
    """(host, value) of texts that nearly all different pages of a host hold. At most as many per host as a few pages have blocks."""
    pages = values.where("kind = 3").groupBy("host").agg(F.sum("n").alias("pages"))
    # a text on fewer pages can't pass below; most texts are on one page
    texts = values.where((F.col("kind") == 2) & (F.col("n") > (1 - threshold) * prior)).select("host", "value", F.col("n").alias("holding"))
    lacking = (F.col("pages") - F.col("holding") + prior) / (F.col("pages") + prior)
    return texts.join(pages, "host").where(lacking < threshold).select("host", "value")


def style_tree(values: DataFrame, decay: float = DECAY, prior: float = PRIOR_USES, share: float = PRIOR_SHARE) -> DataFrame:
    """One row per host and path of `site_values`: uses, own and importance, both 0 to 1."""
    sizes = values.where("kind = 3").groupBy("host").agg(F.sum("n").alias("host_pages"))
    values = values.where("kind < 2")
    sums = values.groupBy("host", "path", "kind").agg(F.sum("n").alias("uses"), F.sum(F.col("n") * F.log("n")).alias("weighted"))
    entropy = F.when(F.col("uses") > 1, (F.log("uses") - F.col("weighted") / F.col("uses")) / F.log("uses")).otherwise(1.0)
    nodes = sums.groupBy("host", "path").agg(F.max("uses").alias("uses"), F.max(entropy).alias("own"))
    # drawn towards 1 where few pages show the node
    weight = F.greatest(F.lit(float(prior)), F.col("host_pages") * F.lit(share))
    nodes = nodes.join(sizes, "host").withColumn("own", (F.col("uses") * F.col("own") + weight) / (F.col("uses") + weight)).drop("host_pages")
    parent = F.regexp_replace("path", r"/+[^/]*\z", "")
    tree = materialize(nodes.withColumn("parent", parent).withColumn("depth", F.length("path") - F.length(F.replace("path", F.lit("/")))), "style-tree")
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    # From the leaves up: the branch below counts for more where a node has more children.
    level = tree.filter(F.col("depth") == deepest).withColumn("importance", F.col("own"))
    done = [level]
    for depth in range(deepest - 1, -1, -1):
        below = level.groupBy("host", F.col("parent").alias("path")).agg(F.avg("importance").alias("mean"), F.count(F.lit(1)).alias("n"))
        here = tree.filter(F.col("depth") == depth).join(below, ["host", "path"], "left")
        kept = F.pow(F.lit(decay), F.coalesce("n", F.lit(0)))
        blended = F.when(F.col("mean").isNull(), F.col("own")).otherwise((1 - kept) * F.col("own") + kept * F.col("mean"))
        level = materialize(here.withColumn("importance", blended).drop("mean", "n"), "style-level")
        done.append(level)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("host", "path", F.col("uses").cast("long").alias("uses"), "own", "importance")


def main_text(page: str, low: dict[str, float] | None = None, repeated: Container[int] = (), threshold: float = THRESHOLD) -> str:
    """The page's blocks joined by newlines, without those of low weighed importance.

    `low` has the importance of the host's unimportant branches, others count as 1; `repeated` the digests of its repeated
    prose. A block takes the importance of its own branch: a branch above it is only noise if all branches in it are. Prose of an
    article has that of its text alone, because one path holds all paragraphs.
    """
    blocks = lifted(parse(page)[0])
    low = low or {}
    has_article = any(b.article and not b.noise for b in blocks)
    kept = []
    for block in blocks:
        weight = NOISE_WEIGHT if block.noise else 1.0 if block.article or not has_article else BESIDE
        if block.prose and repeated and _digest(block.text) in repeated:
            weight = 0.0
        if not (block.article and block.prose):
            weight *= low.get(block.path, 1.0)
        if weight >= threshold:
            kept.append(block.text)
    return "\n".join(kept)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """One row per page: id_col, url, text, n_chars.

    Null html and pages without main text give the empty text. Pages without a host share one tree.
    Repeated rows are extracted each; pages of a host with the same text count once, so a host with one article many
    times keeps it. Other input columns are ignored.
    """
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text_of(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    values = site_values(rows, F.col("host"), F.col("html"))
    # Only what is unimportant is looked up: per host a list that the prior share and a page's size bound, next to each page.
    low = style_tree(values).where(F.col("importance") * F.lit(BESIDE) < threshold)
    branches = low.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("path", "importance"))).alias("low"))
    texts = repeated_prose(values).groupBy("host").agg(F.collect_list("value").alias("repeated"))
    lists = materialize(branches.join(texts, "host", "full"), "low-branches")

    def extracted(texts: pd.Series, lows: pd.Series, repeats: pd.Series) -> pd.Series:
        found = [
            main_text(t or "", dict(low) if low is not None else None, frozenset(map(int, repeated)) if repeated is not None else (), threshold)
            for t, low, repeated in zip(texts, lows, repeats)
        ]
        return pd.Series(found, dtype=object)

    joined = rows.join(lists, "host", "left").select("id", "url", pandas_udf(extracted, "string")("html", "low", "repeated").alias("text"))
    return joined.select(F.col("id").alias(id_col), "url", "text", F.length("text").cast("long").alias("n_chars"))
