"""Site-relative line frequency, JVM-side throughout.

The lines of a page are counted once per page and host; a line on more than ``RATIO``
of its host's pages is boilerplate of that host and is dropped from them. Counts
combine before the shuffle and are keyed by host and line, so a large host is spread
over its lines. A host has at most (mean lines of a page / RATIO) boilerplate lines,
whatever its size, so they are kept as one array per host; Spark sends that table to
the pages if its written size allows, or else joins by host and splits hot hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelume.llm.names import Held
from tracelume.llm.scratch import Scratch

RATIO = 0.3
#: Left out with their content, then inline tags; what other tags part are lines.
SILENT = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|</?(?:a|b|i|em|strong|span|u|small|sup|sub|code)(?:\s[^<>]*)?>"
BREAK = r"<[^<>]*>|\n"
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host(url: Column) -> Column:
    """Lower-cased host; empty for null and for what is no URL with a host."""
    return F.coalesce(F.regexp_extract(F.lower(url), HOST, 1), F.lit(""))


def html_lines(html: Column) -> Column:
    """Text lines of HTML, trimmed of spaces; none for null."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), SILENT, "")
    return F.filter(F.transform(F.split(bare, BREAK, -1), lambda x: F.trim(x)), lambda x: x != "")


def text_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.trim(x)), lambda x: x != "")


def drop_site_lines(rows: DataFrame, host_col: str, lines_col: str, ratio: float = RATIO) -> DataFrame:
    """``rows`` with ``kept_lines``: the array ``lines_col`` without its host's boilerplate.

    A line is boilerplate if it stands on two pages of its host at least, as one page shows
    no frequency, and on more than ``ratio`` of them. A line that a page repeats counts once
    for it, and all its copies go or stay. Null hosts are one host; null
    arrays have no lines and give an empty array. Repeated rows count each time. An
    empty table gives an empty result. Lines of any length are compared by 64-bit hash. Other columns
    come back as they are, whatever their names; a column ``kept_lines`` is replaced.
    """
    held, scratch = Held(rows, ("kept_lines",)), Scratch(rows.sparkSession)
    lines = held.at(lines_col)
    own = scratch.table(held.df.withColumn("host", F.coalesce(F.col(held.at(host_col)), F.lit(""))), "lines")
    slim = own.select("host", F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x))).alias("keys"))
    hosts = scratch.table(slim.groupBy("host").agg(F.count("*").alias("pages")), "hosts")
    counts = slim.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).where("n >= 2")
    often = scratch.table(counts.join(hosts, "host").where(F.col("n") > ratio * F.col("pages")).select("host", "key"), "often")
    bars = scratch.table(often.groupBy("host").agg(F.collect_list("key").alias("bars")), "bars")
    kept = F.when(F.col("bars").isNull(), F.col(lines)).otherwise(F.filter(lines, lambda x: ~F.array_contains("bars", F.xxhash64(x))))
    return held.back(own.join(bars, "host", "left").withColumn("kept", F.coalesce(kept, F.array().cast("array<string>"))), {"kept_lines": "kept"})


def dedup_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ratio: float = RATIO) -> DataFrame:
    """``page_id, host, n_lines, n_kept, text`` of each page; ``text`` is its kept lines, newline-joined."""
    rows = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), html_lines(F.col(html_col)).alias("lines"))
    out = drop_site_lines(rows, "host", "lines", ratio)
    return out.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), F.size("kept_lines").cast("long").alias("n_kept"), F.array_join("kept_lines", "\n").alias("text"))
