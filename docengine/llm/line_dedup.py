"""Line dedup by site-relative frequency; DataFrame and SQL functions only.

Within a host, a line's frequency is the share of the host's pages that contain it. Lines above the ratio, on at least
``min_pages`` pages, are boilerplate and are dropped from every page of that host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, maybe_broadcast

RATIO, MIN_PAGES = 0.3, 3
#: What is cut out of a page, and the tags that end a line.
HIDDEN = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
BLOCKS = r"(?i)</?(?:address|article|aside|blockquote|body|br|div|footer|h[1-6]|head|header|hr|html|li|main|nav|ol|p|section|table|td|th|title|tr|ul)(?:[ \t\r\n/][^>]*)?>"
TAG = r"<[^>]*>"
BLANK = r"[ \t\r\n\x0B\f]+"


def page_host(url: Column) -> Column:
    """The lower-cased host; empty for null or a url without one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def page_lines(html: Column) -> Column:
    """Lines of visible text: block tags and line ends end a line, other tags vanish, white space is single; empty lines are left out."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " ")
    text = F.regexp_replace(F.regexp_replace(text, BLOCKS, "\n"), TAG, "")
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.trim(F.regexp_replace(x, BLANK, " ")))
    return F.filter(lines, lambda x: x != "")


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, marks): digests of each host's boilerplate lines; from rows (host, lines).

    A host has at most (lines a page) / ratio of them, however many pages it has. Lines are counted by digest, once a
    page, before the shuffle.
    """
    marks = pages.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.unhex(F.md5(x))))).alias("mark"))
    counted = marks.groupBy("host", "mark").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    over = counted.join(totals, "host").filter(F.col("n") > F.col("pages") * F.lit(ratio))
    return over.groupBy("host").agg(F.collect_list("mark").alias("marks"))


def dedup_lines(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, host, n_lines, n_dropped, text): a row for each row of ``pages``; ``text`` has the lines that stay, one a line.

    Pages without a host (null or malformed urls) form one group. A null page has no lines; its text is empty. Repeated
    rows count as pages each. A line on a page twice counts once and is dropped or kept twice. Other columns aren't read.
    """
    own = pages.select(pages[id_col].alias("page_id"), page_host(pages[url_col]).alias("host"), page_lines(pages[html_col].cast("string")).alias("lines"))
    found = materialize(boilerplate(own.select("host", "lines"), ratio, min_pages), "boilerplate")
    rows = found.select(F.coalesce(F.sum(F.size("marks")), F.lit(0)).alias("n")).first()["n"]  # 16 bytes a digest
    joined = own.join(maybe_broadcast(found, rows, BROADCAST_ROWS), "host", "left")
    stay = F.when(F.col("marks").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("marks"), F.unhex(F.md5(x)))))
    out = joined.withColumn("stay", stay)
    return out.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("stay")).cast("long").alias("n_dropped"), F.array_join("stay", "\n").alias("text"))
