"""HTML extraction by nearest-URL page differencing.

Pages are sorted by URL path within their host. A page's partner is the neighbour in that order whose path shares the
longest prefix with its own (the one before it on a tie), so pages of one section are compared. Pages of one host and path
are one page under several addresses, and so are pages of one host with the same lines: the page of the smallest id of a path,
and of these the first path of the same lines, finds the partner, and the others have the same. Only where a host has no other
page are such pages compared with each other. The text lines of both are
aligned by a longest common subsequence, and the page keeps the lines that aren't in it: what both share is the template.

The order is a range partitioning of (host, path, id), not one window a host: neighbours across two partitions are found
from the partitions' first and last rows, so a host may be larger than a task. Only 64-bit line hashes of the partner are
moved to a page, never its text.

Defined results. A line is the text between block-level tags with entities decoded and white space collapsed; empty lines
don't count. The alignment is the one found from the first lines on, leaving out a line of the partner where that loses
nothing and else one of the page. A page that is alone on its host keeps all its lines. A page whose html is null or has no text has
null respectively empty text. A null url, or one without a host, is alone, as is a row with a null id. Rows repeating an id
are pages of their own unless they also repeat url and html: such rows are one page, given once a row. Of exact copies that are
alone on their host nothing remains. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

_OPEN = re.compile(r"<!--|<(script|style|title|noscript|template|svg)\b[^<>]*>", re.I)
_CLOSE = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "title", "noscript", "template", "svg")}
_BLOCK = re.compile(
    r"<(?:/|!)?(?:address|article|aside|blockquote|body|br|button|caption|dd|details|div|dl|doctype|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|"
    r"legend|li|main|nav|ol|option|p|pre|section|select|summary|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^<>]*>", re.I,
)
_TAG = re.compile(r"</?[a-zA-Z!?][^<>]*>")


def _visible(page: str) -> str:
    """The page without comments and elements whose text isn't shown.

    As browsers have it, what isn't closed of a comment, script or style goes to the end. The others are left out only if they
    are closed, and stand as plain tags if not or if they close themselves; the text of an unclosed head is the page's text.
    """
    out, at, start, unclosed = [], 0, 0, set()
    while (m := _OPEN.search(page, start)) is not None:
        name = (m[1] or "").lower()
        if name in unclosed or (name in ("noscript", "template", "svg") and m[0].endswith("/>")):
            start = m.end()
            continue
        if name:
            close = _CLOSE[name].search(page, m.end())
            end = close.end() if close else len(page)
        else:
            close = (i := page.find("-->", m.end())) >= 0
            end = i + 3 if close else len(page)
        if not close and name not in ("", "script", "style"):
            unclosed.add(name)
            start = m.end()
            continue
        out += (page[at : m.start()], "\n")
        at = start = end
    return "".join((*out, page[at:]))


def text_lines(page: str) -> list[str]:
    """The visible text of a page, a line for each block."""
    lines = _TAG.sub("", _BLOCK.sub("\n", " ".join(_visible(page).split()))).split("\n")
    return [line for raw in lines if (line := " ".join(entities.unescape(raw).split()))]


# ---- longest common subsequence


def _rows(a: list[int], where: dict[int, int], full: int, start: int) -> Iterator[int]:
    """Bit-parallel table of suffixes, from a's last line on: a zero bit says that LCS(a[i:], b[j:]) > LCS(a[i:], b[j+1:])."""
    v = start
    for x in reversed(a):
        m = where.get(x, 0)
        u = v & m
        v = ((v + u) | (v - u)) & full
        yield v


def lcs_keep(a: list[int], b: list[int]) -> list[bool]:
    """For each line of ``a`` whether it is outside the canonical longest common subsequence with ``b``.

    The walk goes from the first lines: equal lines are shared; else a line of b goes if the subsequence of the rest is as
    long without it; else a line of a. Rows of the table are kept at every ``step``-th line only and made again in between,
    so memory is O(sqrt(len(a)) * len(b) / 8) bytes.
    """
    n, keep = len(a), [True] * len(a)
    lead = 0
    while lead < min(n, len(b)) and a[lead] == b[lead]:
        keep[lead] = False
        lead += 1
    a, b = a[lead:], b[lead:]
    common = set(a) & set(b)
    at = [i for i, x in enumerate(a) if x in common]
    a = [a[i] for i in at]
    b = [x for x in b if x in common]
    if not a:
        return keep
    width = len(b)
    full = (1 << width) - 1
    where: dict[int, int] = {}
    for j, x in enumerate(b):  # bit width-1-j, as the table runs from the last line of b
        where[x] = where.get(x, 0) | 1 << (width - 1 - j)
    step = max(1, int(len(a) ** 0.5))
    saved = {len(a): full}
    for k, v in enumerate(_rows(a, where, full, full)):
        i = len(a) - 1 - k
        if i % step == 0:
            saved[i] = v
    i = j = 0
    block: dict[int, int] = {}
    while i < len(a) and j < width:
        if a[i] == b[j]:
            keep[lead + at[i]] = False
            i += 1
            j += 1
            continue
        if i not in block:
            low = i // step * step
            high = min(len(a), low + step)
            block = {high - 1 - k: v for k, v in enumerate(_rows(a[low:high], where, full, saved[high]))}
        # a zero bit marks a step of the table: the subsequence is shorter without b's line
        if block[i] >> (width - 1 - j) & 1:
            j += 1
        else:
            i += 1
    return keep


# ---- pairing


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (lower case, without port and user) and path (without query, fragment, trailing slash) of a URL."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")
    return F.when(host != "", host), path


def _shared(a: Column, b: Column) -> Column:
    """How much of the beginning of two paths is alike: whole segments first, then characters."""

    def alike(x: Column, y: Column) -> Column:
        wrong = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False)
        return F.when(wrong > 0, wrong - 1).otherwise(F.size(x))

    return alike(F.split(a, "/", -1), F.split(b, "/", -1)) * (1 << 32) + alike(F.split(a, ""), F.split(b, ""))


def nearest_pages(keys: DataFrame) -> DataFrame:
    """(page_id, mark, partner, partner_mark) for distinct (page_id, mark, host, path): each page's nearest neighbour on its host; pages without any are left out."""
    order = ["host", "path", "page_id", "mark"]
    ranged = keys.filter("host is not null and page_id is not null").repartitionByRange(*order).sortWithinPartitions(*order)
    ranged, _ = written(ranged.select(*order, F.spark_partition_id().alias("part")), "ranged")
    ends = ranged.groupBy("part").agg(F.min(F.struct(*order)).alias("first"), F.max(F.struct(*order)).alias("last"))
    # one row a range partition: their number is bounded by the shuffle partitions, not by the data
    parts = Window.orderBy("part")
    ends = ends.select("part", F.lag("last").over(parts).alias("last"), F.lead("first").over(parts).alias("first"))
    inside = Window.partitionBy("part").orderBy(*order)
    near = ranged.select("*", F.lag(F.struct(*order)).over(inside).alias("up"), F.lead(F.struct(*order)).over(inside).alias("down"))
    near = near.join(ends, "part", "left").select(*order, F.coalesce("up", "last").alias("up"), F.coalesce("down", "first").alias("down"))
    score = lambda side: F.when(F.col(f"{side}.host") == F.col("host"), _shared(F.col("path"), F.col(f"{side}.path"))).otherwise(F.lit(-1))
    near = near.select("page_id", "mark", "up", "down", score("up").alias("above"), score("down").alias("below")).filter("above >= 0 or below >= 0")
    best = F.when(F.col("above") >= F.col("below"), F.col("up")).otherwise(F.col("down"))
    return near.select("page_id", "mark", best.alias("best")).select("page_id", "mark", F.col("best.page_id").alias("partner"), F.col("best.mark").alias("partner_mark"))


def partner_pages(keys: DataFrame) -> DataFrame:
    """``nearest_pages`` for (page_id, mark, host, path, content), by other path and other content if the host has such a page."""
    paths = keys.filter("host is not null and page_id is not null").groupBy("host", "path").agg(F.min(F.struct("page_id", "mark", "content")).alias("r")).select("host", "path", "r.*")
    heads = paths.groupBy("host", "content").agg(F.min(F.struct("path", "page_id", "mark")).alias("g")).select("host", "content", "g.*")
    near = nearest_pages(heads.select("page_id", "mark", "host", "path")).join(heads.select("page_id", "mark", "host", "content"), ["page_id", "mark"])
    near = paths.select("host", "path", "content").join(near.select("host", "content", "partner", "partner_mark"), ["host", "content"]).select("host", "path", "partner", "partner_mark")
    own, _ = written(keys.join(near, ["host", "path"], "left").select("page_id", "mark", "host", "path", "partner", "partner_mark"), "partners")
    found = own.filter("partner is not null").select("page_id", "mark", "partner", "partner_mark")
    return found.unionByName(nearest_pages(own.filter("partner is null").select("page_id", "mark", "host", "path")))


def _hash(lines: list[str]) -> np.ndarray:
    return np.frombuffer(b"".join(blake2b(x.encode(), digest_size=8).digest() for x in lines), np.int64)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = [_hash(text_lines(page.as_py() or "")) for page in batch.column(4)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(hashes, pa.list_(pa.int64()))], names=["page_id", "mark", "host", "path", "hashes"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        lines = [None if (page := x.as_py()) is None else pack("\n".join(text_lines(page)).encode()) for x in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lines, pa.binary())], names=["page_id", "mark", "url", "lines"])


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        texts, kept, total = [], [], []
        for packed, other in zip(batch.column(3), batch.column(4)):
            packed, other = packed.as_py(), other.as_py()
            lines = None if packed is None else [x for x in unpack(packed).decode().split("\n") if x]
            keep = None if lines is None else [True] * len(lines) if other is None else lcs_keep(_hash(lines).tolist(), other)
            texts.append(None if keep is None else "\n".join(x for x, k in zip(lines, keep) if k))
            kept.append(None if keep is None else sum(keep))
            total.append(None if keep is None else len(keep))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(total, pa.int32()), pa.array(kept, pa.int32()), pa.array(texts, pa.string())], names=["page_id", "url", "partner_id", "n_lines", "n_kept", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, partner_id, n_lines, n_kept, text): each page's own lines.

    Pages are parsed twice, so that between the two only hashes of lines are kept, and then each page's lines move once, compressed.
    """
    host, path = url_parts(F.col(url_col))
    named = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.xxhash64(url_col, html_col).alias("mark"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    named_keys = named.filter("page_id is not null and host is not null").select("page_id", "mark", "host", "path", "html")
    hashed, _ = written(named_keys.mapInArrow(_hashed, "page_id bigint, mark bigint, host string, path string, hashes array<bigint>"), "hashes")
    near = partner_pages(hashed.select("page_id", "mark", "host", "path", F.xxhash64("hashes").alias("content")).distinct())
    other = hashed.select(F.col("page_id").alias("partner"), F.col("mark").alias("partner_mark"), F.col("hashes").alias("other")).dropDuplicates(["partner", "partner_mark"])
    paired = near.join(other, ["partner", "partner_mark"]).select("page_id", "mark", F.col("partner").alias("partner_id"), "other")
    lines = named.select("page_id", "mark", "url", "html").mapInArrow(_packed, "page_id bigint, mark bigint, url string, lines binary")
    both = lines.join(paired, ["page_id", "mark"], "left").select("page_id", "url", "partner_id", "lines", "other")
    return both.mapInArrow(_difference, "page_id bigint, url string, partner_id bigint, n_lines int, n_kept int, text string")
