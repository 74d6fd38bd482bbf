"""Main text of web pages by nearest-URL page differencing, helped by the pages' own marks.

Each page is cut into text lines (the text of a block). Pages stand in order of host, URL path and
page_id. Pages that follow each other and agree almost wholly (mirrors, repeats) are a run; a page's
partner is the last page of the run before its own in its host, or, in a host's first run, the first page
of the run after. Lines of page and partner are aligned by longest common subsequence, unless these two
agree almost wholly as well: then nothing is deleted. A line that both share is a template's and is
deleted. Articles quote and copy each other, so one shared line of the article's own prose (a heading,
paragraph, list item, quotation, table cell or preformatted text inside <article> or <main>) proves
nothing: it is deleted where the host's other pairs share it too, at least TEMPLATE_SHARE of them and no
fewer than TEMPLATE_PAIRS. Menus and adverts that differ from page to page share nothing with a neighbour, so
what is marked as such (nav, header, footer, aside, form, script ..., or a class or id that says so)
is deleted too, and what lies outside the article where a page has one. Marks are judged for each part of
a block's text: an advert inside a sentence goes, the sentence stays. On the article's prose, words that
also name its topics (WEAK_WORDS) are a hint only: such a line is deleted if the partner has it.

Order and alignment work on line hashes and lengths, never on texts. The order is dealt in ranges; runs
that reach a range's ends find their partners in other ranges, so the result doesn't depend on the ranges.

Defined results: a null or empty html gives an empty text; a null url is a host of its own, without
a path; pages with equal URLs are ordered by page_id, then content; repeated rows are paired as one page and
each reported; pages of a host that has one run keep all that isn't marked, while equal stubs of
under LEAST_SAME characters delete each other's text; an empty table gives an empty table; further columns are ignored; unclosed and stray tags are closed where
the next block or the end requires it; texts of any length are read whole.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import broadcast_if_small, fan_out, in_slices, small_batches, table, written

#: Kinds of lines: of a marked block; the article's prose; other text in the article; other text of the page.
MARKED, PROSE, INSIDE, UNSURE = 0, 1, 2, 3
TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>?", re.S)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
SPACES = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template svg math".split())
MARKS = frozenset("head nav header footer aside form button select dialog menu object canvas audio video".split()) | RAW
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
PROSE_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption".split())
CLOSES_P = BLOCKS - {"option", "legend", "summary"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
#: Words of a class, id or role that mark a block as no part of the article.
MARK_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay "
    "nav navigation navbar menu breadcrumb breadcrumbs sidebar sidebars aside widget footer masthead topbar toolbar pagination pager "
    "comment comments commentlist reply replies disqus share sharing social follow related recommended recommendations newsletter subscribe subscription signup login "
    "search complementary contentinfo".split()
)
HEADS = frozenset({"header", "masthead"})
#: Of these, the words that on a paragraph, heading or list item of an article may as well name its topic.
WEAK_WORDS = frozenset("search menu follow related recommended recommendations social share sharing header alert widget reply replies banner promotion".split())
#: Share of the longer page's characters, marked blocks aside, from which two pages agree almost wholly.
SAME_PAGE = 0.9
#: Characters that two pages must share to agree: less is a stub ("Not found") that a template repeats, no mirrored text.
LEAST_SAME = 60
#: An article's line is a template's if it is shared in this share of a host's pairs of pages, and in so many.
TEMPLATE_SHARE, TEMPLATE_PAIRS = 0.5, 2


NOT_MARKED, IS_MARKED, HINT = range(3)


def marked(tag: str, attributes: str, prose: bool) -> int:
    """Whether an element is marked. ``prose``: it is of the article's prose, where some words are a hint only."""
    if tag in MARKS:
        return IS_MARKED
    if tag in ("html", "body", "main") or not attributes:
        return NOT_MARKED
    found = NOT_MARKED
    for m in NAMED.finditer(attributes):
        words = {*re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", m[1] or m[2] or m[3] or "").lower())} & (MARK_WORDS | HEADS)
        if words and not (prose and words <= WEAK_WORDS):
            return IS_MARKED
        found = HINT if words else found
    return IS_MARKED if re.search(r"\bhidden\b(?!\s*=\s*[\"']?until)|aria-hidden\s*=\s*[\"']?true", attributes) else found


def lines_of(page: str) -> tuple[list[str], list[int]]:
    """The text lines of a page, one for each block with text, and the kind of each. Marked parts of a block that has others are left out."""
    texts: list[str] = []
    kinds: list[int] = []
    stack: list[tuple[str, int]] = []  # open elements, and whether they are marked
    held: list[tuple[int, str]] = []
    deep = hints = articles = 0  # marked, hinted and article elements that are open
    ends: dict[str, tuple[list[int], list[int]]] = {}  # where a tag opens and closes in the page

    def left_open() -> bool:
        """Whether a marked element that is open is never closed: then it ended before what begins here."""
        k = next(k for k, (_, own) in enumerate(stack) if own == IS_MARKED)
        tag = stack[k][0]
        if tag not in ends:
            ends[tag] = tuple([x.start() for x in re.finditer(rf"<{slash}{re.escape(tag)}(?=[\s/>])", page, re.I)] for slash in ("", "/"))
        opens, closes = (len(places) - bisect_left(places, at) for places in ends[tag])
        return closes - opens < sum(t == tag for t, _ in stack[k:])

    def close_block() -> None:
        if held:
            own = [x for x in held if x[0] != MARKED and x[1].strip()]
            for kind, parts in ((own[0][0] if own else MARKED, [x for k, x in held if k != MARKED]), (MARKED, [x for _, x in held])):
                if text := SPACES.sub(" ", html_lib.unescape("".join(parts))).strip():
                    texts.append(text)
                    kinds.append(kind)
                    break
            held.clear()

    def pop() -> None:
        nonlocal deep, hints, articles
        tag, own = stack.pop()
        deep -= own == IS_MARKED
        hints -= own == HINT
        articles -= tag in ("article", "main")

    def text(part: str) -> None:
        if part:
            held.append((MARKED if deep else UNSURE if not articles else PROSE if not hints and any(t in PROSE_TAGS for t, _ in stack) else INSIDE, part))

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag == "br":
            text(" ")
            continue
        if m[1]:
            if any(t == tag for t, _ in stack):
                if tag in BLOCKS:
                    close_block()
                while stack[-1][0] != tag:
                    if stack[-1][0] in BLOCKS:
                        close_block()
                    pop()
                pop()
            elif tag == "p":
                close_block()
            continue
        if tag in VOID:
            if tag == "hr":
                close_block()
            continue
        if tag in BLOCKS:
            close_block()
        if tag in ("article", "main", "body"):  # whatever stood before it and was left open ends here
            while deep and (tag == "body" or left_open()):
                pop()
        elif tag in CLOSES_P and any(t == "p" for t, _ in stack):
            while stack[-1][0] != "p":
                pop()
            pop()
        if tag in SAME:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in STOPS[tag]:
                    break
                if stack[k][0] in SAME[tag]:
                    while len(stack) > k:
                        pop()
                    break
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if m[3].rstrip().endswith("/") and tag not in BLOCKS:
            continue
        own = marked(tag, m[3], articles > 0 and tag in PROSE_TAGS)
        stack.append((tag, own))
        deep += own == IS_MARKED
        hints += own == HINT
        articles += tag in ("article", "main")
    close_block()
    return texts, kinds


def common_places(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence of ``a`` and ``b``."""
    both = set(a) & set(b)
    at = [k for k, x in enumerate(a) if x in both]
    x, y = [a[k] for k in at], [k for k in b if k in both]
    return [at[k] for k in _lcs(x, y)]


def _lcs(x: list[int], y: list[int]) -> list[int]:
    head = 0
    while head < len(x) and head < len(y) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    out = list(range(head))
    u, v = np.array(x[head : len(x) - tail], np.int64), np.array(y[head : len(y) - tail], np.int64)
    out += [head + k for k in _hirschberg(u, v)]
    return out + list(range(len(x) - tail, len(x)))


def _row(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of u and each beginning of v."""
    row = np.zeros(len(v) + 1, np.int32)
    for x in u:
        row[1:] = np.maximum(row[1:], np.where(v == x, row[:-1] + 1, 0))
        np.maximum.accumulate(row, out=row)
    return row


def _hirschberg(u: np.ndarray, v: np.ndarray) -> list[int]:
    """In space linear in the lines."""
    if not len(u) or not len(v):
        return []
    if len(u) == 1:
        return [0] if (v == u[0]).any() else []
    half = len(u) // 2
    cut = int(np.argmax(_row(u[:half], v) + _row(u[half:][::-1], v[::-1])[::-1]))
    return _hirschberg(u[:half], v[:cut]) + [half + k for k in _hirschberg(u[half:], v[cut:])]


def place(url: str | None) -> tuple[str, str]:
    """Host and path of a URL, without query, fragment, a last slash and a file ending."""
    if not url:
        return "", ""
    try:
        parts = urlsplit(url if "//" in url else f"//{url}")
        host = (parts.hostname or "").lower()
    except ValueError:
        return url, ""
    return host, re.sub(r"\.(html?|php|aspx?)$", "", parts.path.rstrip("/"))


ORDER = ["host", "path", "page_id", "key"]


def page_key() -> Column:
    return F.xxhash64("page_id", "url", "html")


def page_lines(pages: DataFrame) -> DataFrame:
    """key, page_id, host, path, line hashes and line lengths (0 in marked blocks); ``open``: places of lines that a partner may delete.

    A task gives each of its repeated rows once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in in_slices(batches, "html", 8 << 20):
            new = [k for k, key in enumerate(batch.column("key").to_pylist()) if not (key in seen or seen.add(key))]
            batch = batch.take(pa.array(new, pa.int64()))
            hosts, paths, hashes, sizes, unsure = [], [], [], [], []
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                texts, kinds = lines_of(page or "")
                host, path = place(url)
                hosts.append(host)
                paths.append(path)
                hashes.append([xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in texts])
                sizes.append([len(t) if kind != MARKED else 0 for t, kind in zip(texts, kinds, strict=True)])
                unsure.append([k for k, kind in enumerate(kinds) if kind != PROSE])
            columns = [pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())), pa.array(unsure, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("page_id"), *columns], ["key", "page_id", "host", "path", "lines", "sizes", "open"])

    rows = pages.select(page_key().alias("key"), F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "key long, page_id long, host string, path string, lines array<long>, sizes array<int>, open array<int>")


def agree(a: dict, b: dict) -> bool:
    """Whether two pages are almost wholly the same, in whatever order."""
    most = max(sum(a["sizes"]), sum(b["sizes"]))
    rest = Counter(b["lines"])
    both = 0
    for line, size in zip(a["lines"], a["sizes"], strict=True):
        if size and rest[line] > 0:
            rest[line] -= 1
            both += size
    return both >= max(LEAST_SAME, SAME_PAGE * most)


def shared(page: dict, partner: dict) -> tuple[list[int], list[int]]:
    """Places of the page's lines that it shares with its partner: of those that one partner may delete, and of the article's prose."""
    if agree(page, partner):
        return [], []
    both, open_ = set(common_places(page["lines"], partner["lines"])), set(page["open"])
    return sorted(both & open_), sorted(both - open_)


#: Rows of the pass over the ranges: a page and what it shares with its partner; a page whose partner isn't known yet; a run's
#: first page that has a partner; the first page of the run after ``run``, which had no run of its host before it; a range's
#: first and last page; and the partner of its last run.
SHARED, OPEN, PAIR, AHEAD, FIRST, LAST, BACK = range(7)
#: ``back``: the partner, where it is of the run before; ``prose``: places of prose lines.
RESULT = "spot int, part int, run int, key long, host string, back long, gone array<int>, prose array<int>, prose_lines array<long>, lines array<long>, sizes array<int>, open array<int>"
NAMES = [x.split()[0] for x in RESULT.split(", ")]
ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
KINDS = [ARROW[x.split()[1]] for x in RESULT.split(", ")]


def row_of(spot: int, page: dict, number: int, **more) -> dict:
    return {"spot": spot, "part": page["part"], "run": number, "key": page["key"], "host": page["host"]} | more


def whole_row(spot: int, page: dict, number: int) -> dict:
    return row_of(spot, page, number, **{c: page[c] for c in ("lines", "sizes", "open")})


def shared_row(page: dict, number: int, partner: dict, back: int | None) -> dict | None:
    gone, prose = shared(page, partner)
    return row_of(SHARED, page, number, back=back, gone=gone, prose=prose, prose_lines=[page["lines"][k] for k in prose]) if gone or prose else None


def batch_of(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], k) for c, k in zip(NAMES, KINDS, strict=True)], NAMES)


def template_lines(rows: DataFrame) -> DataFrame:
    """key, gone (places of template lines) of each page with any. ``rows``: from page_lines, written."""
    spark = rows.sparkSession
    ordered = rows.repartitionByRange(fan_out(spark), *ORDER).sortWithinPartitions(*ORDER).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = back = None
        number = 0
        for batch in batches:
            out = []
            for page in batch.to_pylist():
                if last is None:
                    out.append(whole_row(FIRST, page, 0))
                elif page["key"] == last["key"]:  # a repeated row
                    continue
                elif page["host"] != last["host"]:
                    number, back = number + 1, None
                elif not agree(last, page):
                    if back is None:
                        out.append(whole_row(AHEAD, page, number))
                    number, back = number + 1, last
                    out.append(row_of(PAIR, page, number, back=back["key"]))
                if back is None:
                    out.append(whole_row(OPEN, page, number))
                elif found := shared_row(page, number, back, back["key"]):
                    out.append(found)
                last = page
            if out:
                yield batch_of(out)
        if last is not None:
            yield batch_of([whole_row(LAST, last, number)] + ([whole_row(BACK, {**back, "part": last["part"]}, number)] if back is not None else []))

    found = written(ordered.mapInArrow(run, RESULT), "page-pairs")
    # At most four rows for each range.
    ends = found.filter(F.col("spot").isin(FIRST, LAST, BACK) | ((F.col("spot") == AHEAD) & (F.col("run") == 0))).collect()
    across = [(part, number, page["host"], page["key"] if is_back else None, list(page["lines"]), list(page["sizes"])) for (part, number), (page, is_back) in partners_across(ends).items()]
    across = spark.createDataFrame(across, "part int, run int, host string, partner_back long, partner array<long>, partner_sizes array<int>")
    inside = found.filter((F.col("spot") == AHEAD) & (F.col("run") > 0)).select("part", "run", "host", F.lit(None).cast("long").alias("partner_back"), F.col("lines").alias("partner"), F.col("sizes").alias("partner_sizes"))
    partners = written(inside.unionByName(across), "page-partners")
    left = found.filter(F.col("spot") == OPEN).join(broadcast_if_small(partners.drop("host")), ["part", "run"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shared_row(page, page["run"], {"lines": page["partner"], "sizes": page["partner_sizes"]}, page["partner_back"]) for page in batch.to_pylist()]
            yield batch_of([x for x in out if x])

    late = left.select(*NAMES, "partner_back", "partner", "partner_sizes").mapInArrow(settle, RESULT)
    columns = ["key", "host", "back", "gone", "prose", "prose_lines"]
    both = written(found.filter(F.col("spot") == SHARED).unionByName(late).select(*columns), "page-shared")
    pairs = found.filter(F.col("spot") == PAIR).select("host", "back").unionByName(partners.filter("partner_back IS NOT NULL").select("host", F.col("partner_back").alias("back")))
    prose = both.select("key", "host", "back", F.inline(F.arrays_zip(F.col("prose").alias("place"), F.col("prose_lines").alias("line"))))
    templates = host_templates(prose, pairs)
    more = prose.join(templates, ["host", "line"]).groupBy("key").agg(F.collect_list("place").alias("gone"))
    return both.filter(F.size("gone") > 0).select("key", "gone").unionByName(more).groupBy("key").agg(F.flatten(F.collect_list("gone")).alias("gone"))


def host_templates(prose: DataFrame, pairs: DataFrame) -> DataFrame:
    """host, line of the article's prose lines that enough of the host's pairs share. ``pairs``: host, back of every pair."""
    known = pairs.distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pairs"))
    support = prose.filter("back IS NOT NULL").select("host", "line", "back").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= TEMPLATE_PAIRS)
    return support.join(known, "host").filter(F.col("n") >= TEMPLATE_SHARE * F.col("pairs")).select("host", "line")


def partners_across(ends: list) -> dict[tuple[int, int], tuple[dict, bool]]:
    """The partner of each run (part, run) that has none inside its range, or that a range before may have one for, and whether it is of the run before."""
    parts: dict[int, dict] = {}
    for e in ends:
        parts.setdefault(e["part"], {})[e["spot"]] = e
    partner: dict[tuple[int, int], tuple[dict, bool]] = {}
    last = back = None  # the last page so far, and the partner of its run
    waiting: list[tuple[int, int]] = []  # the parts of the last run, if no run of its host is before it
    for part, own in sorted(parts.items()):
        first = own[FIRST]
        if last is None or last["host"] != first["host"]:
            waiting, back = [], None
        elif not agree(last, first):
            partner.update(dict.fromkeys(waiting, (first, False)))
            waiting, back = [], last
        if back is None:
            waiting.append((part, 0))
        else:
            partner[part, 0] = back, True
        if (number := own[LAST]["run"]) > 0:
            if AHEAD in own:
                partner.update(dict.fromkeys(waiting, (own[AHEAD], False)))
            back = own.get(BACK)
            waiting = [(part, number)] if back is None else []
        last = own[LAST]
    return partner


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of (page_id, url, html)."""
    small_batches(pages.sparkSession)
    gone = written(template_lines(written(page_lines(pages), "page-lines")), "page-gone")
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), page_key().alias("key"))
    rows = rows.join(broadcast_if_small(gone), "key", "left").select("page_id", "url", "html", "gone")
    schema = rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "html", 8 << 20):
            texts = []
            for page, gone in zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                lines, kinds = lines_of(page or "")
                drop = set(gone or ())
                kept = {PROSE, INSIDE} if PROSE in kinds or INSIDE in kinds else {UNSURE}  # without an article: what is neither marked nor shared
                texts.append("\n".join(t for k, (t, kind) in enumerate(zip(lines, kinds, strict=True)) if k not in drop and kind in kept))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, schema)


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
