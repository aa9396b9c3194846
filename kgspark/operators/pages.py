"""Pages to documents: content blocks, links, digests and a bounded crawl.

A page is (page_id, url, html).  HTML is cut into tokens by one regular
expression (``functions.markup``); elements are pairs of tokens, found with windows over a page, and
running sums say what lies between their ends.  ``innerText`` is taken as all text within an element, white space collapsed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.functions import markup as M
from kgspark.functions import text as T
from kgspark.functions import urls as U
from kgspark.functions import vocabulary as V

Store = Callable[[DataFrame], DataFrame]

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCKS = (*HEADINGS, "p", "pre", "code", "ul", "ol")
#: Tags that end an open paragraph or heading.
BREAKING = (*HEADINGS, "p", "pre", "ul", "ol", "li", "div", "article", "section", "main", "nav", "footer", "header", "aside", "table", "tr", "td", "th", "blockquote", "form", "body", "html")
CONTAINER_CLASSES = ("article-content", "post-content", "entry-content")
MIN_DENSE_TEXT = 500


def page_titles(pages: DataFrame) -> DataFrame:
    """Title of each page, "Untitled" where there is none."""
    found = T.collapse(M.unescape(M.title(F.col("html"))))
    return pages.select("page_id", F.coalesce(F.nullif(found, F.lit("")), F.lit("Untitled")).alias("title"))


def tokens(pages: DataFrame) -> DataFrame:
    """Tags and texts in order: page_id, pos, kind (open, close, text), tag, attrs, text."""
    rows = pages.select("page_id", F.posexplode(M.cut(F.coalesce("html", F.lit("")))).alias("pos", "token"))
    tag = F.lower(F.regexp_extract("token", r"^</?([A-Za-z][^\s/>]*+)", 1))
    kind = F.when(tag == "", "text").when(F.startswith("token", F.lit("</")), "close").otherwise("open")
    attrs = F.regexp_extract("token", r"(?s)^<[A-Za-z][^\s/>]*+(.*)>$", 1)
    return rows.select("page_id", "pos", kind.alias("kind"), tag.alias("tag"), F.when(kind == "open", attrs).otherwise("").alias("attrs"), F.when((kind == "text") & ~F.startswith("token", F.lit("<!")), M.unescape(F.col("token"))).otherwise("").alias("text"))


def elements(toks: DataFrame) -> DataFrame:
    """Open tags and what the element holds: page_id, tag, attrs, begin, stop,
    texts_begin, texts_stop (numbers of the page's texts), chars, children.

    Tags of one name nest; an open one ends at the next token of its level.  A
    paragraph or heading also ends where any other block begins or ends.
    """
    page, by_page = W.partitionBy("page_id"), W.partitionBy("page_id").orderBy("pos")
    before, ahead = by_page.rowsBetween(W.unboundedPreceding, -1), by_page.rowsBetween(1, W.unboundedFollowing)
    counts = {"texts": (F.col("kind") == "text").cast("long"), "chars": F.length(T.collapse(F.col("text"))).cast("long"), "opens": (F.col("kind") == "open").cast("long")}
    summed = toks.withColumns({f"n_{k}": F.coalesce(F.sum(c).over(before), F.lit(0)) for k, c in counts.items()} | {f"all_{k}": F.sum(c).over(page) for k, c in counts.items()})
    here = F.struct("pos", *(f"n_{k}" for k in counts))
    last = F.struct(F.lit(2**31 - 1).alias("pos"), *(F.col(f"all_{k}").alias(f"n_{k}") for k in counts))
    tags = summed.where("kind <> 'text'").withColumn("next_block", F.min(F.when(F.col("tag").isin(*BREAKING), here)).over(ahead))
    step = F.when(F.col("kind") == "open", 1).otherwise(-1)
    depth = F.sum(step).over(W.partitionBy("page_id", "tag").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    tags = tags.withColumn("level", depth + F.when(F.col("kind") == "close", 1).otherwise(0))
    own_end = F.lead(here).over(W.partitionBy("page_id", "tag", "level").orderBy("pos"))
    end = F.coalesce(F.when(F.col("tag").isin("p", *HEADINGS), F.col("next_block")).otherwise(F.col("own_end")), last)
    opened = tags.withColumn("own_end", own_end).where("kind = 'open'").withColumn("end", end)
    return opened.select("page_id", "tag", "attrs", F.col("pos").alias("begin"), F.col("end.pos").alias("stop"), F.col("n_texts").alias("texts_begin"), F.col("end.n_texts").alias("texts_stop"), (F.col("end.n_chars") - F.col("n_chars")).alias("chars"), (F.col("end.n_opens") - F.col("n_opens") - 1).alias("children"))


def containers(toks: DataFrame, els: DataFrame | None = None) -> DataFrame:
    """The main content of each page: page_id, begin, stop, texts_stop.

    The first hit of article, main, role=main and three classes, in this order;
    else the densest text; else the body, else the whole page.
    """
    els = elements(toks) if els is None else els
    named = F.concat(F.lit(" "), F.lower(M.attribute(F.col("attrs"), "class")), F.lit(" "))
    rank = F.when(F.col("tag") == "article", 1).when(F.col("tag") == "main", 2).when(M.attribute(F.col("attrs"), "role") == "main", 3)
    for k, name in enumerate(CONTAINER_CLASSES):
        rank = rank.when(F.contains(named, F.lit(f" {name} ")), 4 + k)
    span = ("begin", "stop", "texts_stop")
    hits = els.withColumn("rank", rank.when(F.col("tag") == "body", 20)).where("rank is not null").select("page_id", "rank", *span)
    dense = densest(els).select("page_id", F.lit(10).alias("rank"), *span)
    whole = toks.groupBy("page_id").agg(F.count_if(F.col("kind") == "text").alias("texts_stop")).select("page_id", F.lit(30).alias("rank"), F.lit(-1).alias("begin"), F.lit(2**31 - 1).alias("stop"), "texts_stop")
    every = hits.unionByName(dense).unionByName(whole)
    return every.groupBy("page_id").agg(F.min(F.struct("rank", *span)).alias("c")).select("page_id", *(f"c.{c}" for c in span))


def densest(els: DataFrame) -> DataFrame:
    """Of divs, sections, articles and mains with over 500 characters, the one
    with most text per element in it: page_id, begin, stop, texts_stop, density."""
    sized = els.where(F.col("tag").isin("div", "section", "article", "main") & (F.col("chars") > MIN_DENSE_TEXT)).withColumn("density", F.col("chars") / F.greatest("children", F.lit(1)))
    first = F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("density"), "begin"))
    return sized.withColumn("k", first).where("k = 1").select("page_id", "begin", "stop", "texts_stop", "density")


def _with_texts(spans: DataFrame, toks: DataFrame) -> DataFrame:
    """Adds ``text`` to spans (page_id, begin, texts_begin, texts_stop, ...), each page's texts and spans in one row."""
    texts = toks.where("kind = 'text'").groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("texts"))
    others = [c for c in spans.columns if c not in ("page_id", "begin")]
    listed = spans.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("begin", *others))).alias("spans"))
    rows = listed.join(texts, "page_id", "left").withColumn("texts", F.transform(F.coalesce("texts", F.array().cast("array<struct<pos:int,text:string>>")), lambda t: t["text"]))
    text = lambda s: T.collapse(F.array_join(F.slice(F.col("texts"), s["texts_begin"].cast("int") + 1, F.greatest(F.lit(0), (s["texts_stop"] - s["texts_begin"]).cast("int"))), " "))
    return rows.select("page_id", F.inline(F.transform("spans", lambda s: F.struct(s["begin"].alias("begin"), *(s[c].alias(c) for c in others), text(s).alias("text")))))


def is_ignored(tag: Column, attrs: Column) -> Column:
    """Navigation and the like by tag, or by a part of the class name."""
    return tag.isin(*V.IGNORED_TAGS) | T.contains_any(F.lower(M.attribute(attrs, "class")), V.IGNORED_CLASSES)


def content_blocks(pages: DataFrame, store: Store | None = None) -> DataFrame:
    """Blocks in reading order: page_id, position, type, tag, text.

    Elements within the main content that aren't ignored themselves and hold
    text; nested lists and code in pre come twice.  With ``store`` the tokens,
    which several joins read, are written once instead of being cut again.
    """
    toks = tokens(pages) if store is None else store(tokens(pages))
    els = elements(toks) if store is None else store(elements(toks))
    own = els.where(F.col("tag").isin(*BLOCKS) & ~is_ignored(F.col("tag"), F.col("attrs")))
    main = containers(toks, els).withColumnsRenamed({"begin": "main_begin", "stop": "main_stop", "texts_stop": "main_texts"})
    own = own.join(main, "page_id").where("begin > main_begin and begin < main_stop")
    held = _with_texts(own.select("page_id", "begin", "tag", "texts_begin", F.least("texts_stop", "main_texts").alias("texts_stop")), toks)
    kind = F.when(F.col("tag").isin(*HEADINGS), "heading").when(F.col("tag").isin("pre", "code"), "code").when(F.col("tag").isin("ul", "ol"), "list").otherwise("paragraph")
    kept = held.select("page_id", "begin", "tag", kind.alias("type"), "text").where("text <> ''")
    position = F.row_number().over(W.partitionBy("page_id").orderBy("begin")) - 1
    return kept.select("page_id", position.alias("position"), "type", "tag", "text")


def links(pages: DataFrame, main_only: bool = True, clean: bool = False, store: Store | None = None) -> DataFrame:
    """Links: page_id, ordinal, target_url, anchor_text, is_internal."""
    toks = tokens(pages) if store is None else store(tokens(pages))
    els = elements(toks) if store is None else store(elements(toks))
    anchors = els.where("tag = 'a'").withColumn("href", M.unescape(M.attribute(F.col("attrs"), "href"), in_attribute=True)).where("href <> ''")
    if main_only:
        main = containers(toks, els).select("page_id", F.col("begin").alias("main_begin"), F.col("stop").alias("main_stop"))
        anchors = anchors.join(main, "page_id").where("begin > main_begin and begin < main_stop")
    based = _with_texts(anchors.select("page_id", "begin", "texts_begin", "texts_stop", "href"), toks).join(pages.select("page_id", "url"), "page_id")
    target = U.normalize(F.col("href"), F.col("url"))
    if clean:
        target = U.strip_tracking(target)
    rows = based.withColumn("target_url", target).where(U.is_valid(F.col("target_url")))
    ordinal = F.row_number().over(W.partitionBy("page_id").orderBy("begin")) - 1
    return rows.select("page_id", ordinal.alias("ordinal"), "target_url", F.col("text").alias("anchor_text"), U.same_domain(F.col("target_url"), F.col("url")).alias("is_internal"))


def section_texts(blocks: DataFrame, tree: DataFrame) -> DataFrame:
    """Text of each section, its blocks joined by newlines; empty ones are left out.

    ``blocks`` has doc_id, section, position, text; ``tree`` is ``sections``.
    """
    gathered = blocks.groupBy("doc_id", F.col("section").alias("order_index")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\n").alias("content"))
    return gathered.join(tree, ["doc_id", "order_index"]).where(T.strip(F.col("content")) != "").select("doc_id", "order_index", "heading", "level", T.strip(F.col("content")).alias("content"))


def digest(texts: DataFrame, most: int | None = 8, cut: int | None = 700) -> DataFrame:
    """Sections as one text per document: doc_id, content, n_sections.

    With ``most`` and ``cut`` the short form; None for the full one.
    """
    rows = texts.withColumn("k", F.row_number().over(W.partitionBy("doc_id").orderBy("order_index")))
    if most is not None:
        rows = rows.where(F.col("k") <= most)
    body = F.left("content", F.lit(cut)) if cut is not None else F.col("content")
    rows = rows.withColumn("piece", F.concat(F.lit("## "), "heading", F.lit("\n"), body))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "piece"))), lambda x: x["piece"]), "\n\n").alias("content"), F.count("*").alias("n_sections"))


#: Fixed values of the short form: sections and characters of each, sections
#: listed, links and characters of their texts; characters of a listed section
#: of the full form.
SHORT = {"most": 8, "cut": 700, "listed": 10, "links": 20, "anchor": 100}
LISTED_CUT = 2000


def readings(texts: DataFrame, titles: DataFrame, links_: DataFrame, short: bool = True, with_errors: bool = True) -> DataFrame:
    """What a reader gets of each document: doc_id, title, content, sections, links, is_error.

    ``texts`` is ``section_texts``, ``titles`` (doc_id, title), ``links_``
    (doc_id, ordinal, target_url, anchor_text).  ``sections`` has heading, level
    and in the full form the content, cut; ``links`` has url and text.  Pages
    that look like errors are marked, or left out without ``with_errors``.
    """
    rows = texts.withColumn("k", F.row_number().over(W.partitionBy("doc_id").orderBy("order_index")))
    if short:
        rows = rows.where(F.col("k") <= min(SHORT["most"], SHORT["listed"]))
    parts = [F.col("heading"), F.col("level")] if short else [F.col("heading"), F.col("level"), F.left("content", F.lit(LISTED_CUT)).alias("content")]
    listed = lambda part, order: F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("x")))), lambda s: s["x"])
    sections = rows.groupBy("doc_id").agg(listed(F.struct(*parts), "k").alias("sections"))
    text = F.left("anchor_text", F.lit(SHORT["anchor"])) if short else F.col("anchor_text")
    some = links_.where(F.col("ordinal") < SHORT["links"]) if short else links_
    out = some.groupBy("doc_id").agg(listed(F.struct(F.col("target_url").alias("url"), text.alias("text")), "ordinal").alias("links"))
    whole = digest(texts, SHORT["most"], SHORT["cut"]) if short else digest(texts, None, None)
    found = whole.join(sections, "doc_id").join(titles, "doc_id").join(out, "doc_id", "left").withColumn("is_error", T.is_error_page(F.col("title"), F.col("content")))
    found = found if with_errors else found.where("not is_error")
    return found.select("doc_id", "title", "content", "sections", F.coalesce("links", F.array().cast("array<struct<url:string,text:string>>")).alias("links"), "is_error")


def documents(pages: DataFrame, store: Store | None = None) -> DataFrame:
    """One row per page: id, url, title, domain, n_blocks, n_links, n_internal."""
    blocks = content_blocks(pages, store).groupBy("page_id").agg(F.count("*").alias("n_blocks"))
    out = links(pages, store=store).groupBy("page_id").agg(F.count("*").alias("n_links"), F.count_if("is_internal").alias("n_internal"))
    rows = pages.select("page_id", "url").join(page_titles(pages), "page_id").join(blocks, "page_id", "left").join(out, "page_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("page_id", U.document_id(F.col("url")).alias("id"), "url", "title", U.domain(F.col("url")).alias("domain"), zero("n_blocks"), zero("n_links"), zero("n_internal"))


def crawl_graph(pages: DataFrame, links_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored pages by cleaned URL, and their internal links between such: (node, page_id), (src, dst, ordinal).

    Of pages with one cleaned URL the first counts.  Links may lead to pages
    that are not stored.
    """
    clean = lambda c: U.strip_tracking(U.normalize(F.col(c)))
    nodes = pages.select(clean("url").alias("node"), "page_id").where(U.is_valid(F.col("node"))).groupBy("node").agg(F.min("page_id").alias("page_id"))
    inner = links_.where("is_internal").select("page_id", "ordinal", clean("target_url").alias("dst"))
    return nodes, inner.join(nodes, "page_id").select(F.col("node").alias("src"), "dst", "ordinal")


def crawl(links_: DataFrame, roots: DataFrame, max_depth: int, max_pages: int | None, store: Store) -> DataFrame:
    """Pages reached from the roots breadth first: node, depth, parent.

    ``links_`` rows are (src, dst, ordinal); ``roots`` has node.  A page's
    parent is the first one visited of those that link to it.  Within a depth
    pages are taken in the order of parent, then link, at most ``max_pages`` in
    all.  That order is that of the ways from the roots, so nothing is numbered
    over all pages.
    """
    way = lambda root, steps: F.struct(root.alias("root"), steps.alias("steps"))
    first = roots.select("node").distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast(roots.schema["node"].dataType).alias("parent"), way(F.col("node"), F.array().cast("array<long>")).alias("way"))
    visited = frontier = store(first if max_pages is None else first.orderBy("node").limit(max_pages))
    for depth in range(1, max_depth + 1):
        room = None if max_pages is None else max_pages - visited.count()
        if room is not None and room <= 0:
            break
        ahead = links_.join(frontier.select(F.col("node").alias("src"), "way"), "src").groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("way", F.col("ordinal").cast("long").alias("ordinal"), "src")).alias("m"))
        ahead = ahead.join(visited.select("node"), "node", "left_anti")
        if room is not None:
            ahead = ahead.orderBy("m", "node").limit(room)
        frontier = store(ahead.select("node", F.lit(depth).alias("depth"), F.col("m.src").alias("parent"), way(F.col("m.way.root"), F.concat("m.way.steps", F.array("m.ordinal"))).alias("way")))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited.select("node", "depth", "parent")


def crawl_each(links_: DataFrame, roots: DataFrame, max_depth: int, max_pages: int | None, store: Store) -> DataFrame:
    """A crawl from every root by itself: root, node, depth, parent, place.

    Each is bounded by ``max_depth`` steps and ``max_pages`` pages, and place
    numbers its pages in the order of the visit: breadth first, by parent, then
    link, then name.  All crawls go on together, one step at a time; numbers are
    given within a root, to no more pages than its last step leads to.
    """
    kind = roots.schema["node"].dataType
    frontier = roots.select(F.col("node").alias("root")).distinct().select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("parent"), F.lit(1).cast("long").alias("place"), F.lit(1).cast("long").alias("n"))
    visited = frontier = store(frontier)
    steps = store(links_.groupBy("src", "dst").agg(F.min("ordinal").cast("long").alias("ordinal")))
    for depth in range(1, max_depth + 1):
        open_ = frontier if max_pages is None else frontier.where(F.col("n") < max_pages)
        by = F.struct("place", "ordinal", F.col("node").alias("src"))
        ahead = open_.join(steps, F.col("node") == F.col("src")).groupBy("root", "dst").agg(F.min(by).alias("m"), F.first("n").alias("n"))
        ahead = ahead.withColumnRenamed("dst", "node").join(visited.select("root", "node"), ["root", "node"], "left_anti")
        place = F.col("n") + F.row_number().over(W.partitionBy("root").orderBy("m", "node"))
        ahead = ahead.withColumn("place", place)
        if max_pages is not None:
            ahead = ahead.where(F.col("place") <= max_pages)
        # The last place given is how many pages the root has by now.
        now = F.max("place").over(W.partitionBy("root"))
        frontier = store(ahead.select("root", "node", F.lit(depth).alias("depth"), F.col("m.src").alias("parent"), "place", now.alias("n")))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited.drop("n")


def crawl_summary(crawled: DataFrame, documents_: DataFrame) -> DataFrame:
    """Per depth: pages met, and blocks, links and internal links of those stored.

    ``documents_`` is (node, n_blocks, n_links, n_internal).
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return crawled.join(documents_, "node", "left").groupBy("depth").agg(F.count("*").alias("n_pages"), total("n_blocks"), total("n_links"), total("n_internal"))
