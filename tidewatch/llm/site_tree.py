"""HTML extraction with a site style tree.

The pages of one host are merged into a tree of element paths. A branch where pages lay out their children in
many ways (presentation), hold texts that few other pages hold (content) and much of their text matters; a
branch with the same layout and the same texts on page after page is furniture. The first two are entropies over
the host's distinct pages. Branches of low importance go from each page. What elements and classes are called is
a prior: it lowers a branch's importance, and decides alone only where a host has too few pages to tell.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import Scratch, text_slices
from tidewatch.llm.dom import Block, Element, read

#: Elements and roles that are never text of an article, and those that seldom are.
NEVER_TAGS = frozenset("nav form button select menu dialog search head svg".split())
NEVER_ROLES = frozenset("navigation search dialog alert menu menubar toolbar".split())
SELDOM_TAGS = frozenset("header footer aside".split())
SELDOM_ROLES = frozenset("banner contentinfo complementary".split())
#: Words of class and id names of what isn't the article, and words that say nothing beside them.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie"
    " cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices popup promo"
    " related share sharing sidebar skip social sponsor sponsored subscribe widget".split()
)
PLAIN_WORDS = frozenset(
    "area article author bar block body bottom box btn button buttons col column container content date form global group inner"
    " item items left link links list main meta middle outer page panel post posts primary reply right row secondary section"
    " site slot text thread title top unit wrap wrapper # js".split()
)
_CLASS_TAGS = frozenset("div section ul ol dl table p span article aside figure main".split())
_CONTAINERS = frozenset("div section ul ol dl table figure article main aside header footer blockquote".split())
_ARTICLES = ("article", "main")
#: A branch below this importance goes; a path on fewer distinct pages of its host tells nothing.
LEAST_IMPORTANCE, LEAST_PAGES = 0.3, 8
#: Weights of content, presentation and share of the text in a branch's importance; a share of FULL_SHARE counts full.
CONTENT, LAYOUT, SHARE, FULL_SHARE = 0.4, 0.2, 0.4, 0.5
#: Priors: of branches whose name speaks against them, unless they hold MOST of their pages' text, and of branches
#: outside the article on hosts whose pages mark one.
NAMED, MOST, OUTSIDE = 0.25, 0.7, 0.5
#: Verdicts on branches up to this number are told to all tasks (some 100 bytes each); beyond, pages get theirs by a join.
BROADCAST_PATHS = 100_000
#: Bytes of pages parsed at once (a longer page alone), and rows.
SLICE_BYTES, SLICE_ROWS = 2_000_000, 256
HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)"


def _never(e: Element) -> bool:
    return e.tag in NEVER_TAGS or e.attrs.get("role", "").lower() in NEVER_ROLES or "hidden" in e.attrs


def _named(e: Element) -> bool:
    """Whether an element's name, role or class speaks against it: a class of noise words and words that say nothing."""
    if e.tag in SELDOM_TAGS or e.attrs.get("role", "").lower() in SELDOM_ROLES:
        return True
    if e.tag in _CLASS_TAGS and "." in e.step:
        for name in e.step.partition(".")[2].split():
            words = {w.rstrip("#") or "#" for w in name.replace("-", " ").replace("_", " ").split()}
            if words & NOISE_WORDS and words <= NOISE_WORDS | PLAIN_WORDS:
                return True
    return False


def _article_at(block: Block) -> int:
    """Place of the outermost article or main element in the block's path, -1 if there is none."""
    return next((k for k, e in enumerate(block.path) if e.tag in _ARTICLES), -1)


def _own_title(block: Block, k: int) -> bool:
    """Whether the element at place k is the header of an article, and the block a heading in it."""
    return block.path[k].tag == "header" and 0 <= _article_at(block) < k and any(e.tag in ("h1", "h2", "h3") for e in block.path[k:])


def _branches(block: Block) -> list[tuple[str, int]]:
    """(path, place of its last element) of the branches that hold this block, the widest first.

    Branches are containers, elements with a name, and, for a block in none of these, its own path.
    """
    out, path = [], ""
    for k, e in enumerate(block.path):
        path = f"{path}/{e.step}" if path else e.step
        if e.tag not in ("html", "body") and (e.tag in _CONTAINERS or "." in e.step or _named(e)):
            out.append((path, k))
    return out or ([(path, len(block.path) - 1)] if block.path else [])


def _hash(text: str, seed: int = 0) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"), seed)


def page_facts(blocks: list[Block]) -> list[tuple[str, int, int, float, float, bool, bool]]:
    """(path, hash of texts, hash of layout, share of the page's text, share of links, named, outside) of each branch."""
    blocks = [b for b in blocks if not any(map(_never, b.path))]
    total = sum(len(b.text) for b in blocks)
    marked = any(_article_at(b) >= 0 for b in blocks)
    facts: dict[str, list] = {}
    for b in blocks:
        below = "/".join(e.tag for e in b.path)
        for path, k in _branches(b):
            own = facts.setdefault(path, [0, 0, 0, 0, False, marked])
            own[4] = own[4] or _named(b.path[k]) and not _own_title(b, k)
            own[5] = own[5] and _article_at(b) < 0  # with the article in it, a branch isn't outside
            own[0], own[1] = _hash(b.text, own[0]), _hash(below, own[1])
            own[2] += len(b.text)
            own[3] += min(b.linked, len(b.text))
    return [(path, t, lay, n / total, linked / n, named, outside) for path, (t, lay, n, linked, named, outside) in facts.items()]


_FACTS = "host string, row long, page long, path string, text long, layout long, share double, links double, named boolean, outside boolean"


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _FACTS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_()]
    for piece, pages in text_slices(batches, SLICE_BYTES, SLICE_ROWS, "html"):
        rows = []
        for host, row, page in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), pages):
            blocks = read(page.decode())[0]
            whole = _hash("\n".join(b.text for b in blocks))
            rows += [(host, row, whole, *fact) for fact in page_facts(blocks)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def _source(pages: DataFrame, url: str, html: str) -> DataFrame:
    """host, row (equal for equal pages), html."""
    return pages.select(F.regexp_extract(F.coalesce(F.lower(url), F.lit("")), HOST, 1).alias("host"), F.xxhash64(url, html).alias("row"), F.col(html).alias("html"))


def _importance(facts: DataFrame) -> DataFrame:
    """The tree: host, path, pages, importance, named, outside of every branch on enough distinct pages of a host.

    Content: 1 less the entropy, over the host's pages, of where a branch's text occurs (a text on all pages has
    none), less the share of links outside articles. Layout: the entropy of the branch's layouts. Both to the base
    of its pages. A page counts once for each distinct whole text, so copies weigh nothing. Counts are
    pre-aggregated per (host, path, hash), so a host with any share of all pages is never gathered in one task.
    """
    distinct = facts.filter("host <> ''").groupBy("host", "path", "page").agg(
        *[F.min(c).alias(c) for c in ("text", "layout", "share", "links")], F.max("named").alias("named"), F.max("outside").alias("outside"))
    kinds = F.explode(F.array(F.struct(F.lit("text").alias("kind"), F.col("text").alias("h")), F.struct(F.lit("layout").alias("kind"), F.col("layout").alias("h"))))
    sums = [F.sum(F.col(c).cast("double")).alias(c) for c in ("share", "links", "named", "outside")]
    counts = distinct.select("host", "path", kinds.alias("x"), "share", "links", "named", "outside").groupBy("host", "path", "x.kind", "x.h").agg(F.count("*").alias("n"), *sums)
    n, text, layout = F.col("n"), F.col("kind") == "text", F.col("kind") == "layout"
    tree = counts.groupBy("host", "path").agg(
        F.sum(F.when(text, n)).alias("pages"), F.sum(F.when(text, n * F.log(n))).alias("spread"), F.sum(F.when(layout, n * F.log(n))).alias("same"),
        *[F.sum(F.when(text, F.col(c))).alias(c) for c in ("share", "links", "named", "outside")],
    ).filter(F.col("pages") >= LEAST_PAGES)
    m, log_m = F.col("pages"), F.log("pages")
    outside, named, share = F.col("outside") / m >= 0.5, F.col("named") / m >= 0.5, F.col("share") / m
    content = (1 - F.col("spread") / m / log_m) * F.when(F.col("path").rlike(r"(^|/)(article|main)([./]|$)"), 1.0).otherwise(1 - F.col("links") / m)
    layouts = (log_m - F.col("same") / m) / log_m
    prior = F.when(named & (share < MOST), NAMED).otherwise(1.0) * F.when(outside, OUTSIDE).otherwise(1.0)
    value = CONTENT * content + LAYOUT * layouts + SHARE * F.least(F.lit(1.0), share / FULL_SHARE)
    return tree.select("host", "path", "pages", (prior * value).alias("importance"), named.alias("named"), outside.alias("outside"))


def style_tree(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The site style trees of all hosts: host, path, pages, importance (0 to 1), named, outside.

    Pages without a host (null or other urls) belong to no tree; null and empty pages have no branches.
    """
    return _importance(_source(pages, url, html).mapInArrow(_facts, _FACTS))


def main_text(page: str | None, tree: Mapping[str, bool] | None = None) -> str:
    """The main text of a page, given verdicts of its host's tree: path -> whether the branch stays.

    Without a verdict, branches go whose name speaks against them, and, on a page that marks an article, all
    outside it.
    """
    tree = tree or {}
    blocks = [b for b in read(page)[0] if not any(map(_never, b.path))]
    marked = any(_article_at(b) >= 0 for b in blocks)

    def stays(block: Block, with_tree: bool) -> bool:
        judged = False
        for path, k in _branches(block):
            verdict = tree.get(path) if with_tree else None
            if verdict is None and _named(block.path[k]) and not _own_title(block, k):
                verdict = False
            if verdict is False:
                return False
            judged = judged or bool(verdict)
        return judged or not marked or _article_at(block) >= 0

    kept = [b for b in blocks if stays(b, True)]
    if not kept and marked:  # a page's only article is never pruned away
        kept = [b for b in blocks if stays(b, False)]
    return "\n\n".join(b.text for b in kept)


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars.

    Branches whose importance on their host is low go, the others stay; names of elements decide where the host
    has too few pages. Null and empty pages, and pages without an article, give the empty text. Repeated rows give
    equal rows; an empty table an empty result. Pages are parsed SLICE_BYTES at a time, very long ones alone.
    Other columns are not read.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "pages")
    facts = scratch.keep(_source(pages, url, html).mapInArrow(_facts, _FACTS), "facts", shuffled=False)
    # the verdicts that say other than what a page says without its host
    plain = ~F.col("named") & ~F.col("outside")
    verdicts = _importance(facts).withColumn("stays", F.col("importance") >= LEAST_IMPORTANCE).filter(F.col("stays") != plain).select("host", "path", "stays")
    verdicts = scratch.keep(verdicts, "verdicts")
    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    keyed = source.withColumns({"host": F.regexp_extract(F.coalesce(F.lower("url"), F.lit("")), HOST, 1), "row": F.xxhash64("url", "html")})
    told = None
    if verdicts.count() <= BROADCAST_PATHS:
        by_host: dict[str, dict[str, bool]] = {}
        for r in verdicts.collect():  # at most BROADCAST_PATHS
            by_host.setdefault(r.host, {})[r.path] = r.stays
        told = spark.sparkContext.broadcast(by_host)
        keyed = keyed.withColumns({"paths": F.lit(None).cast("array<string>"), "stays": F.lit(None).cast("array<boolean>")})
    else:  # each page gets the verdicts on its own branches; a row of pages is a key of its own, so no host is one task's
        own = facts.select("host", "path", "row").distinct().join(verdicts, ["host", "path"])
        own = own.groupBy("row").agg(F.collect_list(F.struct("path", "stays")).alias("v")).select("row", F.col("v.path").alias("paths"), F.col("v.stays").alias("stays"))
        keyed = keyed.join(own, "row", "left")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, raw in text_slices(batches, SLICE_BYTES, SLICE_ROWS, "html"):
            hosts, paths, stays = (piece.column(k).to_pylist() for k in (2, 3, 4))
            texts = []
            for host, p, s, page in zip(hosts, paths, stays, raw):
                texts.append(main_text(page.decode(), told.value.get(host) if told is not None else dict(zip(p or (), s or ()))))
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    schema = T.StructType([T.StructField("page_id", pages.schema[page_id].dataType), T.StructField("url", T.StringType()),
                           T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return keyed.select("page_id", "url", "host", "paths", "stays", "html").mapInArrow(extract, schema)
