"""Main text of web pages: block structure first, then a host's repeated token runs.

A page is cut into blocks at block-level tags. Blocks in menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments go, by element, role, class or id. Inside an article
names count only as whole classes of containers, since sections and headings are named by their subject.
A page keeps the blocks of its article (or main) element, as parsed, whole. Boilerplate without markup
of its own is found by a host's suffix array: the pages' token streams are laid end to end, suffixes
are ranked by their first ``RUN`` tokens, and runs whose rank occurs on distinct pages of the host are
covered and removed outside of articles, on every page; unique runs stay. Where repeats cover most of a page without an article,
those whose articles are empty or dropped included, as on copied pages, only the
runs that more rows have than the page's median repeated run are taken for boilerplate, and the rest stays.

Articles are whole since they share lines and whole texts, which must stay; but they are in the array, so a teaser
of one beside another goes. Only a host without any text outside of articles is not in it, as there is nothing to decide there. The
suffix array is sorted over the cluster, by host, then by the tokens' hashes, and stands in slices, one a task.
Runs of at least ``RUN`` tokens are covered by their stretches of ``RUN``, so it is sorted to that depth, and
neighbours that share so many tokens make an interval. A slice decides its intervals itself; those
at its two edges are put together over slices by a table of two rows a slice.

Defined results: a null or empty html gives an empty text; null ids, null or odd urls (all one host),
repeated rows and other columns are allowed; rows are kept one by one.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import materialise, text_groups
from quillframe.llm.words import Words

#: Tokens of the shortest repeated run.
RUN = 8
#: Repeated tokens from which a page they mostly fill counts as copied; where nothing else is left, any number does.
COPIED = 40
_RAW = "script|style|noscript|template|textarea|svg|iframe|object|math|title|select|option|canvas|audio|video"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({_RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>", re.S | re.I)
_ATTRIBUTE = re.compile(r"([a-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split()
)
_DROPPED = frozenset("nav header footer aside form head dialog menu button label input".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_WORDS = (
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|pop-?up|modal|overlay|newsletter|subscribe|subscription|sidebar|side-bar|"
    r"menu|nav|navbar|navigation|breadcrumbs?|footer|comments?|commentlist|disqus|reply|replies|share|sharing|social|related|recommended|widget|login|signup|search|pagination|pager|toolbar|masthead|skip-link)"
)
_NAMES = re.compile(rf"(?:^|[^a-z]){_WORDS}(?:$|[^a-z])")
#: A whole class that names chrome: such words alone, or with words for its shape or its items.
_CLASS = re.compile(rf"(?:{_WORDS}|comment)(?:[-_]+(?:{_WORDS}|area|articles|bar|block|body|box|buttons?|container|form|icons|inner|items?|links?|list|panel|posts|slot|stories|thread|unit|wrap|wrapper))*")
#: Classes that tell what a page has or lacks, not what the element is.
_STATES = re.compile(r"(?:^|(?<=\s))(?:has|with|without|no)[-_]\S*")
_CONTAINERS = frozenset("article div section ul ol dl table details figure".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_OUTSIDE_ONLY = re.compile(r"(?:^|[^a-z])(?:header|top-bar|topbar)(?:$|[^a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CLOSES_P = _BLOCKS - frozenset(["body", "html"])


def _is_chrome(name: str, attributes: str, in_article: bool) -> bool:
    if name in _DROPPED:
        return True
    if not attributes.strip():
        return False
    values = {k.lower(): (a or b or c).lower() for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    if values.get("role") in _ROLES or values.get("aria-hidden") == "true" or _HIDDEN.search(values.get("style", "")) or re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes, re.I):
        return True
    classes = values.get("class", "")
    if in_article or name == "article":
        return name in _CONTAINERS and any(_CLASS.fullmatch(c) for c in classes.split())
    if name in ("html", "body", "main"):
        return False
    named = _STATES.sub("", classes if name in _HEADINGS else f"{classes} {values.get('id', '')}")
    return bool(_NAMES.search(named) or _OUTSIDE_ONLY.search(named))


def blocks(page: str) -> tuple[list[str], list[str]]:
    """The text blocks of a page inside its article or main element, and outside any dropped element at all."""
    found = _blocks(page)
    return [b for b, inside in found if inside], [b for b, _ in found]


def _blocks(page: str) -> list[tuple[str, bool]]:
    """The text blocks of a page outside any dropped element, and whether each is inside an article or main element."""
    found: list[tuple[str, bool]] = []
    pieces: list[str] = []
    stack: list[tuple[str, bool, bool, int]] = []  # name, dropped here or above, in an article here or above, depth of the nearest block
    dropped = in_article = False

    def text(raw: str) -> None:
        if not dropped and raw:
            pieces.append(entities.unescape(raw) if "&" in raw else raw)

    def close() -> None:
        if pieces:
            if block := " ".join("".join(pieces).split()):
                found.append((block, in_article))
            pieces.clear()

    def pop_to(depth: int) -> None:
        nonlocal dropped, in_article
        del stack[depth:]
        dropped, in_article = stack[-1][1:3] if stack else (False, False)

    at = 0
    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name == "br":
            text(" ")
            continue
        if name in _BLOCKS:
            close()
        if m[2]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    pop_to(depth)
                    break
            continue
        if name in _VOID:
            continue
        if name == "body":
            pop_to(0)
        elif name in _CLOSES_P and stack and (depth := stack[-1][3]) >= 0 and stack[depth][0] == "p":
            pop_to(depth)  # the nearest block is a paragraph that is still open, however many other elements are within
        if not m[4].rstrip().endswith("/") or name in _BLOCKS:
            main = name in ("article", "main") or "role" in m[4] and re.search(r"role\s*=\s*[\"']?(?:article|main)\b", m[4], re.I) is not None
            dropped = dropped or _is_chrome(name, m[4], in_article)
            in_article = in_article or main
            stack.append((name, dropped, in_article, len(stack) if name in _BLOCKS else stack[-1][3] if stack else -1))
    text(page[at:])
    close()
    return found


def _texts(pages: DataFrame) -> DataFrame:
    """Each page's text outside any dropped element, and whether some of it is ``open``, as it stands in no article.

    ``inside`` tells the lines in articles of pages that have both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, group in text_groups(batch, "html"):
                found = [_blocks(h) for h in group]
                texts = pa.array(["\n".join(b for b, _ in page) for page in found], pa.string())
                flags = [[inside for _, inside in page] for page in found]
                inside = pa.array([f if any(f) and not all(f) else None for f in flags], pa.list_(pa.bool_()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(start, len(group)) for k in range(3)), texts, inside, pa.array([not all(f) for f in flags], pa.bool_())], names=["page_id", "url", "row", "text", "inside", "open"])

    return pages.mapInArrow(run, "page_id long, url string, row long, text string, inside array<boolean>, open boolean")


def host(url):
    """A page's host, in lower case; empty where the url has none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _host_key():
    return F.xxhash64(host(F.col("url"))).alias("host")


def _heads(hashes: np.ndarray, at: np.ndarray, skip: int, run: int) -> np.ndarray:
    """Four tokens of each suffix as one number that orders it by them: 16 bits of each, none beyond the run."""
    found = np.zeros(len(at), np.uint64)
    for k in range(skip, skip + 4):
        found = (found << np.uint64(16)) | (hashes[at + k] >> np.uint64(48) if k < run else np.uint64(0))
    return found.view(np.int64)


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A slice of the suffix array, by neighbours: suffixes whose neighbours share the run, where several pages have it.

    Only the first and the last interval of a slice may go on in other slices; they are told as they are, with the slice's number.
    """
    number = TaskContext.get().partitionId()

    def told(table: np.ndarray, starts: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff(np.concatenate([starts, [len(table)]]))
        row = table[:, 4]
        other = np.concatenate([[True], row[1:] != row[:-1]])
        other[starts] = True
        n = np.add.reduceat(other.astype(np.int64), starts)
        held = np.repeat((n > 1) | edges, sizes)
        spread = lambda x: np.repeat(x, sizes)[held]
        columns = [table[held, 0], table[held, 3], row[held], table[held, 5].astype(np.int32), spread(n), spread(row[starts]), spread(row[starts + sizes - 1])]
        slices = pa.array(np.full(int(held.sum()), number, np.int32), mask=~spread(edges))
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), slices], names=["host", "rank", "row", "at", "n", "least", "most", "slice"])

    tail, first = np.zeros((0, 6), np.int64), True
    for batch in batches:
        table = np.concatenate([tail, np.column_stack([c.to_numpy().astype(np.int64) for c in batch.columns])])
        if not len(table):
            continue
        starts = np.flatnonzero(np.concatenate([[True], (table[1:, :4] != table[:-1, :4]).any(axis=1)]))
        if len(starts) > 1:
            edges = np.zeros(len(starts) - 1, bool)
            edges[0], first = first, False
            yield told(table[: starts[-1]], starts[:-1], edges)
        tail = table[starts[-1] :]
    if len(tail):
        yield told(tail, np.zeros(1, np.int64), np.ones(1, bool))


def drop_host_repeats(pages: DataFrame, run: int = RUN, beside: DataFrame | None = None) -> DataFrame:
    """Remove from each text (page_id, url, row, text) the token runs that other pages of its host also have.

    ``row`` tells rows apart, from 0 on; a run counts as repeated when it occurs in two of them, or in one and in the texts of another
    table, ``beside`` (url, row, text), that are not returned. On a page that repeats mostly fill (``COPIED``), only the runs that more rows have than its median
    repeated run go. A text with ``inside``, a flag for each line, keeps the lines that are, and loses all repeats from the others.
    """
    if "inside" not in pages.columns:
        pages = pages.withColumn("inside", F.lit(None).cast("array<boolean>"))

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, group in text_groups(batch):
                words = Words(group)
                hashes, inside = words.windows(run)
                at = np.flatnonzero(inside)
                doc = words.doc_of_word()[at]
                take = pa.array(doc + start)
                ahead, behind = _heads(words.hashes, at, 0, run), _heads(words.hashes, at, 4, run)
                yield pa.RecordBatch.from_arrays([batch.column("host").take(take), pa.array(ahead), pa.array(behind), pa.array(hashes[at].view(np.int64)), batch.column("row").take(take), pa.array((at - words.first[doc]).astype(np.int32))], names=["host", "ahead", "behind", "rank", "row", "at"])

    def spread(starts: list[dict]) -> set[int]:
        return {k for s in starts for k in range(s["at"], s["at"] + run)}

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, starts, inside in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "inside")), strict=True):
                starts = starts or []
                gone, whole = spread(starts), len((text or "").split())
                if starts and not inside and 2 * len(gone) > whole and (len(gone) >= COPIED or len(gone) == whole):
                    usual = sorted(s["n"] for s in starts)[len(starts) // 2]
                    gone = spread([s for s in starts if s["n"] > usual])
                kept, seen = [], 0
                for at, line in enumerate((text or "").split("\n")):
                    tokens = line.split(" ") if line else []
                    kept.append(line if inside and inside[at] else " ".join(t for k, t in enumerate(tokens, seen) if k not in gone))
                    seen += len(tokens)
                out.append("\n".join(x for x in kept if x))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    texts = pages.select(_host_key(), "row", "text")
    if beside is not None:
        texts = texts.unionByName(beside.select(_host_key(), (-1 - F.col("row")).alias("row"), "text"))
    suffixes = texts.mapInArrow(ranks, "host long, ahead long, behind long, rank long, row long, at int")
    # rows are part of the range, so a run that a host has on every page is spread over tasks; one page's equal suffixes stay together
    order = ["host", "ahead", "behind", "rank", "row"]
    array = suffixes.repartitionByRange(*order).sortWithinPartitions(*order)
    found = materialise(array.mapInArrow(_intervals, "host long, rank long, row long, at int, n long, least long, most long, slice int"), "suffix_intervals")
    edges = found.where("slice is not null")
    parts = edges.groupBy("host", "rank", "slice").agg(F.first("n").alias("n"), F.first("least").alias("least"), F.first("most").alias("most"))
    whole = parts.groupBy("host", "rank").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).where("least <> most").select("host", "rank", "n")
    # two intervals a slice at most, so the broadcast is small at any size
    starts = found.where("slice is null").select("row", "at", "n").unionByName(edges.drop("n").join(F.broadcast(whole), ["host", "rank"]).select("row", "at", "n"))
    covered = starts.where("row >= 0").groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("starts"))
    return pages.join(covered, "row", "left").select("page_id", "url", "text", "starts", "inside").mapInArrow(keep, "page_id long, url string, text string")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every page."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.monotonically_increasing_id().alias("row"), F.col(html_col).alias("html"))
    found = _texts(rows)
    undecided = materialise(found.where("open").drop("open"), "undecided")
    # other pages of their hosts have no text outside of articles: they are evidence, and stay as they are
    hosts = undecided.select(_host_key()).distinct()
    beside = _texts(rows.withColumn("host", _host_key()).join(hosts, "host", "left_semi").drop("host")).where("not open")
    return found.where("not open").select("page_id", "url", "text").unionByName(drop_host_repeats(undecided, beside=beside))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
