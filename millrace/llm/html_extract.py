"""Main text of web pages: markup rules, and differences to the page with the nearest URL.

A page is cut into blocks (lines of text). Blocks in navigation, footers, sidebars, forms, adverts, notices, comment
sections and the like are out, by element or by class, id, role or label (marks; hidden elements stay, as they may be the article's). The lines that are left are compared with those of the pages with the
nearest other URL paths of the host: lines are aligned by longest common subsequence, and shared ones are the template.

* On pages without article or main shared lines go. A neighbour which shares at least half of a page's text is another copy of the page
  and says nothing of the template; it is passed over for the neighbour on the other side.
* Where article or main hold the text, articles of a host may quote the same paragraphs, so a shared line within them goes only if at least
  ``often`` of the host's pages (five at least) hold it. What stands outside is left out, unless it is more than twice as long: then article
  or main is a teaser, and the page counts as one without.
* A class or id is a mark if all its parts are words of marks or of layout, so that site-nav is one and related-work isn't. The id of a section
  in an article is a target of links: there only words for comments count. Other attributes, and values of attributes, say nothing.
* A navigation, footer, sidebar or menu that is never closed ends at the next heading, paragraph, section, article or the like.
* Null html counts as empty; a page without main text gives an empty string. Pages without a URL are compared with none.
* All pages of one host and path have the same neighbours, found among the distinct paths. Those are dealt out by ranges,
  so that a host of any size is spread over tasks; partitions don't change results. Lines are compared by 64-bit hashes. Html is
  shuffled only for pages in a bucket with some from which a line goes; it is parsed twice, and memory is in proportion to one page.
* Rows that repeat id, URL and html get the same text.
"""

from __future__ import annotations

import html as entities
import re
import uuid
from bisect import bisect_left
from collections import defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket, cut, map_arrow, shared_dir, small_batches

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg annotation object canvas audio video".split())
DROPPED = frozenset("nav footer aside form menu dialog select button fieldset option search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, id, role or label that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent dialog disqus "
    "discussion footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification popup promo promoted promotion "
    "recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toc toolbar widget "
    "complementary contentinfo alert rail".split()
)
KEPT = frozenset("main body html h1 h2 h3 h4 h5 h6".split())
#: Words of layout, which change nothing in a mark: page-footer, comment-list.
LAYOUT = frozenset(
    "area article banner bar bottom box button buttons col column container content count desktop entry fixed form global group header holder horizontal "
    "inline inner item items js left link links list main mobile module outer page panel placeholder post primary reader readers region right row secondary section site "
    "slot small sticky sub thread top unit user users vertical wrap wrapper zone".split()
)
#: Of an article only these say that it is none.
NO_ARTICLE = frozenset("ad advert advertisement comment comments promo promoted reply replies sponsored teaser".split())
#: Words for what readers write.
TALK = frozenset("comment comments discussion disqus replies reply respond".split())
#: Words before a mark that make it say something of the element around it: with-sidebar, has-share-buttons.
AROUND = frozenset("with without has have no is not js can show hide".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
PART = re.compile(r"[^a-z]+")
ENDS_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "title"}

#: Elements that can't stand in an open navigation, footer or the like whose end is missing.
ENDS_LOOSE = frozenset("article aside blockquote figure footer h1 h2 h3 h4 h5 h6 header main nav p pre section table".split())

OPEN, MAIN, OUT = 0, 1, 2


def _is_mark(token: str) -> bool:
    """Whether a class token is made of marks, or of marks and words of layout."""
    parts = [x for x in PART.split(re.sub(r"([a-z])([A-Z])", r"\1-\2", token).lower()) if x]
    return bool(parts) and parts[0] not in AROUND and not MARKS.isdisjoint(parts) and all(x in MARKS or x in LAYOUT for x in parts)


def _marked(name: str, attrs: str, zone: int) -> bool:
    if name in KEPT:
        return False
    seen = set()
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key not in ("class", "id", "role", "aria-label") or key in seen:
            continue
        seen.add(key)
        if key == "aria-label":
            if name != "article" and value.strip().lower() in MARKS:
                return True
        elif name == "article":
            if NO_ARTICLE & set(value.lower().split()):
                return True
        elif any(map(_is_mark, value.split())):
            if key != "id" or name != "section" or zone != MAIN or not TALK.isdisjoint(PART.split(value.lower())):
                return True
    return False


def blocks(page: str) -> list[tuple[int, str]]:
    """(zone, line) of the page's blocks in order; lines are decoded, with white space runs as one space, never empty."""
    out: list[tuple[int, str]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements that change the zone, or hold one that does
    zone, at = OPEN, 0
    low = None
    unclosed: set[str] = set()  # names without an end tag from here on

    def flush() -> None:
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if line:
                out.append((zone, line))

    while m := TAG.search(page, at):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                text.append(entities.escape(m[0][9:-3]))
            continue
        name, attrs = name.lower(), m[3]
        if m[1]:
            if name in BLOCKS:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name not in BLOCKS and any(x in BLOCKS for x, _ in stack[k + 1 :]):
                        break  # an inline end tag doesn't close blocks opened within
                    flush()
                    zone = stack[k][1]
                    del stack[k:]
                    break
            continue
        if name in RAW and not attrs.endswith("/"):
            if name in BLOCKS:
                flush()
            if low is None:
                low = page.lower()
            end = low.find(f"</{name}", at)
            at = len(page) if end < 0 else end
            continue
        if name == "br":
            text.append(" ")
        if name in VOID or attrs.endswith("/"):
            if name in BLOCKS:
                flush()
            continue
        if name in BLOCKS:
            flush()
            if name in ENDS_LOOSE:
                loose = next((k for k, x in enumerate(stack) if x[0] in unclosed), None)
                if loose is not None:
                    zone = stack[loose][1]
                    del stack[loose:]
            if name in ENDS_P and stack and stack[-1][0] == "p":
                zone = stack.pop()[1]
        inner = zone
        if zone != OUT:
            if name in DROPPED or name == "header" and zone != MAIN or _marked(name, attrs, zone) and not (name == "header" and zone == MAIN):
                inner = OUT
                if name in DROPPED and name not in unclosed:
                    if low is None:
                        low = page.lower()
                    if low.find(f"</{name}", at) < 0:
                        unclosed.add(name)
            elif name in ("article", "main"):
                inner = MAIN
        if inner != zone and name not in BLOCKS:
            flush()
        if name in BLOCKS or inner != zone:
            stack.append((name, zone))
            zone = inner
    if at < len(page) and not (at == 0 and not page):
        rest = page[at:]
        cut = rest.rfind("<")
        if cut >= 0 and re.match(r"<[a-zA-Z/!?]", rest[cut:]) and ">" not in rest[cut:]:
            rest = rest[:cut]  # a tag that the page ends in
        text.append(rest)
    flush()
    return out


def shared_lines(a: list, b: list) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``, by the matches of each line in order."""
    where: dict[object, list[int]] = defaultdict(list)
    for j in range(len(b) - 1, -1, -1):
        where[b[j]].append(j)
    tops: list[int] = []
    links: list[tuple | None] = []
    for i, line in enumerate(a):
        for j in where.get(line, ()):
            k = bisect_left(tops, j)
            link = (i, links[k - 1] if k else None)
            if k == len(tops):
                tops.append(j)
                links.append(link)
            else:
                tops[k], links[k] = j, link
    found, at = set(), links[-1] if links else None
    while at is not None:
        found.add(at[0])
        at = at[1]
    return found


def has_main(own: list[tuple[int, str]]) -> bool:
    """Whether article or main hold the page's text: what is outside is at most twice as long."""
    size = [0, 0, 0]
    for zone, line in own:
        size[zone] += len(line)
    return 0 < size[MAIN] and size[OPEN] <= 2 * size[MAIN]


def content(own: list[tuple[int, str]]) -> list[str]:
    """The lines of a page that may be its text."""
    if has_main(own):
        return [line for zone, line in own if zone == MAIN]
    return [line for zone, line in own if zone == OPEN]


def template_lines(lines: list, sizes: list[int], main: bool, near: list[list], frequent: set) -> set[int]:
    """Places of the lines (or their hashes) that go, given those of the neighbours, the nearest first."""
    if main:
        return {i for other in near for i in shared_lines(lines, other) if lines[i] in frequent}
    for other in near:
        gone = shared_lines(lines, other)
        if 2 * sum(sizes[i] for i in gone) < sum(sizes):
            return gone
    return set()


def main_text(own: list[tuple[int, str]], near: list[list[str]], frequent: set[str] = frozenset()) -> str:
    """The text of a page, from its blocks, the lines of its neighbours and the lines that many pages of its host hold."""
    lines = content(own)
    gone = template_lines(lines, list(map(len, lines)), has_main(own), near, frequent)
    return "\n".join(x for i, x in enumerate(lines) if i not in gone)


def _common(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _nearest(parsed: DataFrame) -> DataFrame:
    """(host, path, before, first, after, last): the nearest other paths of the host, and keys of the pages that stand for them.

    The page with the largest id stands for the path before, that with the least for the path after. Paths are
    dealt by ranges, and the ends of ranges meet those of the next ones, so it doesn't matter where ranges end.
    """
    spark = parsed.sparkSession
    page = F.struct("id", "h", "key")
    paths = parsed.filter("host IS NOT NULL").groupBy("host", "path").agg(F.min(page).alias("lo"), F.max(page).alias("hi"))
    paths = paths.select("host", "path", F.col("lo.key").alias("lo"), F.col("hi.key").alias("hi"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    paths = cut(paths.repartitionByRange(n, "host", "path").withColumn("range", F.spark_partition_id()))
    ends = paths.groupBy("range").agg(F.min(F.struct("host", "path", "lo")).alias("a"), F.max(F.struct("host", "path", "hi")).alias("b")).orderBy("range").collect()
    edges = [(x["range"], *(ends[k - 1]["b"] if k else (None,) * 3), *(ends[k + 1]["a"] if k + 1 < len(ends) else (None,) * 3)) for k, x in enumerate(ends)]
    edges = spark.createDataFrame(edges, "range int, bh string, bp string, bk long, ah string, ap string, ak long")
    w = Window.partitionBy("range").orderBy("host", "path")
    near = paths.withColumns({k: f(c).over(w) for k, f, c in (("h1", F.lag, "host"), ("p1", F.lag, "path"), ("k1", F.lag, "hi"), ("h2", F.lead, "host"), ("p2", F.lead, "path"), ("k2", F.lead, "lo"))})
    near = near.join(F.broadcast(edges), "range")
    own_before, own_after = F.coalesce("h1", "bh") == F.col("host"), F.coalesce("h2", "ah") == F.col("host")
    return near.select(
        "host", "path",
        F.when(own_before, F.coalesce("p1", "bp")).alias("before"), F.when(own_before, F.coalesce("k1", "bk")).alias("k1"),
        F.when(own_after, F.coalesce("p2", "ap")).alias("after"), F.when(own_after, F.coalesce("k2", "ak")).alias("k2"),
    )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", often: float = 0.5) -> DataFrame:
    """One row per input row: ``id_col``, ``url_col``, text, n_chars (code points)."""
    spark = pages.sparkSession
    small_batches(spark, 64)
    bare = F.regexp_replace(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://|[?#].*$", "")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("host", F.lower(F.substring_index(bare, "/", 1))).withColumn("path", F.regexp_replace(bare, r"^[^/]*|/$|\.html?$", ""))
    rows = rows.withColumn("h", F.xxhash64("html")).withColumn("key", F.xxhash64("host", "path", "id", "h"))
    kind = dict(pages.dtypes)[id_col]
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())

    def parse(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines, sizes, main = [], [], []
        for page in batch.column(5).to_pylist():
            own = blocks(page)
            held = content(own)
            lines.append([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x in held])
            sizes.append(list(map(len, held)))
            main.append(has_main(own))
        return pa.record_batch([*batch.columns[:5], pa.array(main), pa.array(lines, longs), pa.array(sizes, ints)], names=["id", "host", "path", "h", "key", "main", "lines", "sizes"])

    found = map_arrow(rows.select("id", "host", "path", "h", "key", "html"), parse, f"id {kind}, host string, path string, h long, key long, main boolean, lines array<long>, sizes array<int>")
    path = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    found.filter("host IS NOT NULL").write.parquet(path)
    parsed = spark.read.parquet(path)

    many = parsed.groupBy("host").agg(F.count("*").alias("n"))
    held = parsed.filter("main").select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    frequent = held.filter("n >= 5").join(many.withColumnRenamed("n", "pages"), "host").filter(F.col("n") >= often * F.col("pages"))
    frequent = frequent.groupBy("host").agg(F.collect_list("line").alias("frequent"))
    near = cut(_nearest(parsed).join(frequent, "host", "left"))
    keys = near.select(F.col("k1").alias("key")).unionByName(near.select(F.col("k2").alias("key"))).distinct()
    lines = cut(parsed.select("key", "lines").join(keys, "key").dropDuplicates(["key"]))
    near = near.join(lines.select(F.col("key").alias("k1"), F.col("lines").alias("l1")), "k1", "left").join(lines.select(F.col("key").alias("k2"), F.col("lines").alias("l2")), "k2", "left")
    compared = parsed.join(near.select("host", "path", "before", "l1", "after", "l2", "frequent"), ["host", "path"]).select("key", "path", "lines", "sizes", "main", "before", "l1", "after", "l2", "frequent")

    def settle(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, gone = [], []
        for key, own_path, own, sizes, main, before, l1, after, l2, often_held in zip(*(c.to_pylist() for c in batch.columns)):
            others = [(p, x) for p, x in ((before, l1), (after, l2)) if p is not None]
            others.sort(key=lambda x: -_common(x[0], own_path))
            places = template_lines(own, sizes, main, [x for _, x in others], set(often_held or ()))
            if places:
                keys.append(key)
                gone.append(sorted(places))
        return pa.record_batch([pa.array(keys, pa.int64()), pa.array(gone, ints)], names=["key", "gone"])

    templates = cut(map_arrow(compared, settle, "key long, gone array<int>").dropDuplicates(["key"]))
    buckets = templates.select(bucket(18, F.col("key")).alias("bucket")).distinct().withColumn("near", F.lit(True))
    marked = rows.select("id", "url", "key", "html").withColumn("bucket", bucket(18, F.col("key"))).join(F.broadcast(buckets), "bucket", "left")
    quiet = marked.filter("near IS NULL").select("id", "url", "html", F.lit(None).cast("array<int>").alias("gone"))
    rest = marked.filter("near").join(templates, "key", "left").select("id", "url", "html", "gone")

    def settle_text(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for page, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            out = set(gone or ())
            texts.append("\n".join(x for i, x in enumerate(content(blocks(page))) if i not in out))
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return map_arrow(quiet.unionByName(rest), settle_text, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")
