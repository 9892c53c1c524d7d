"""Site-relative line deduplication (operator 6), in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfline.shared import discard, join_hot, materialize

RATIO = 0.1
#: A line of a single page is never boilerplate; above that the ratio decides.
LEAST_PAGES = 2
#: Bytes of hosts and line hashes that a task may be given whole.
COMMON_BYTES = 16 << 20

# The patterns by which markup becomes lines.
UNSEEN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<head\b.*?</head>"
BREAKS = r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|article|section|nav|header|footer|main|body|html)\b[^>]*>"
TAGS = r"<[^>]*>"
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"
BLANKS = " \t\r\f"


def html_lines(html: Column) -> Column:
    """The text of a page with a line for each block of its markup."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, UNSEEN, ""), BREAKS, "\n"), TAGS, "")
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: _bare(x) != ""), "\n")


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; null without one."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def drop_boilerplate(pages: DataFrame, *, host_col: str, text_col: str, ratio: float = RATIO, min_pages: int = LEAST_PAGES, counts: bool = True, length_col: str | None = None) -> DataFrame:
    """``pages`` with ``text_col`` freed of lines that more than ``ratio`` of the pages of their host contain, on ``min_pages`` pages at least.

    Adds n_lines and n_dropped unless ``counts`` is false; ``length_col`` names a column that holds the length of the
    text, set anew where lines go.  Lines are compared without white space at their ends; blank lines never count and
    stay.  A page counts once for a line, however often it repeats it; repeated rows are pages of their own.  Pages
    without a host (null) are left as they are, a null text stays null with 0 lines.  Further columns pass
    through; the two counts replace columns of those names.  An empty table stays empty.
    """
    host, text = F.col(f"`{host_col}`"), F.col(f"`{text_col}`")
    keys = lambda lines: F.transform(F.filter(F.transform(lines, _bare), lambda x: x != ""), lambda x: F.xxhash64(x))
    seen = pages.where(host.isNotNull()).select(host.alias("site"), text.alias("text"))
    totals = materialize(seen.groupBy("site").agg(F.count("*").alias("pages")), "totals")
    found = seen.select("site", F.explode(F.array_distinct(keys(F.split("text", "\n")))).alias("line")).groupBy("site", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    # a host has at most (distinct lines of a page / ratio) such lines, so an array of them stays small
    kept = join_hot(found, totals, "site", many=F.col("pages")).where(F.col("n") > ratio * F.col("pages"))
    common = materialize(kept.groupBy("site").agg(F.collect_set("line").alias("common"), F.first("pages").alias("pages")), "common")
    discard(totals)
    width = F.octet_length("site") + 8 * F.size("common") + 64
    size = common.agg(F.sum(width)).first()[0] or 0
    # the names inside this join can't meet those of the table: its columns travel in a struct
    rows = pages.select(host.alias("site"), F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row"))
    # measured to be small, they go to the tasks and the texts stay where they are; else those of large hosts do, and the others are joined by a shuffle
    rows = rows.join(F.broadcast(common), "site", "left") if size <= COMMON_BYTES else join_hot(rows, common, "site", many=F.col("pages"), width=width, how="left", hot_bytes=COMMON_BYTES)
    lines = F.split(F.col("row")[text_col], "\n")
    left = F.filter(lines, lambda x: ~F.coalesce(F.array_contains("common", F.xxhash64(_bare(x))) & (_bare(x) != ""), F.lit(False)))
    out = rows.select("row", lines.alias("lines"), F.when(F.col("common").isNull(), lines).otherwise(left).alias("kept"))
    same = F.col("row")[text_col].isNull() | (F.size("lines") == F.size("kept"))
    cleaned = F.when(same, F.col("row")[text_col]).otherwise(F.array_join("kept", "\n"))
    changed = {text_col: cleaned} | ({length_col: F.when(same, F.col("row")[length_col]).otherwise(F.length(cleaned)).cast(pages.schema[length_col].dataType)} if length_col else {})
    many = lambda c: F.when(F.col("lines").isNull(), 0).otherwise(F.size(c)).cast("long")
    added = {"n_lines": many("lines"), "n_dropped": many("lines") - many("kept")} if counts else {}
    return out.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in pages.columns if c not in added), *(v.alias(k) for k, v in added.items()))
