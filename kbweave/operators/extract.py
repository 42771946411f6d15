"""Page extraction: pages -> text, markdown, title, content, links, sections,
chunks. All row-local: no shuffle; a page never leaves the task that read it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbweave.config import Params
from kbweave.functions import html as H
from kbweave.functions import urls as U


def page_scan(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.length("html").alias("html_chars"),
                        F.md5(F.encode("html", "UTF-8")).alias("html_md5"))


def source_keys(pages: DataFrame, params: Params = Params()) -> DataFrame:
    """Markdown file key of each page; ``page_key`` adds the page id, since two
    pages of one host fetched in the same second would share ``source_key``."""
    sk = U.source_key("url", params.run_ts)
    return pages.select(
        "page_id", "url", U.netloc("url").alias("netloc"), sk.alias("source_key"),
        F.concat(sk, F.lit("_"), F.col("page_id").cast("string")).alias("page_key"),
        U.with_prefix("url", params.reader_prefix).alias("fetch_url"))


def page_text(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", H.html_to_text("html").alias("text"))


def page_markdown(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", H.html_to_markdown("html").alias("md"))


def page_entries(pages: DataFrame) -> DataFrame:
    """Deterministic structured entry per page: title, main content, links."""
    return pages.select("page_id", "url", H.entry_parts("html").alias("_e")).select(
        "page_id", "url", "_e.title", "_e.content", "_e.links")


# Markdown: a link is [text](url), an image the same behind "!"; headings begin with #.
MD_LINK = r"(?:^|[^!])\[([^\]\[]*)\]\(([^)\s]*)\)"
MD_TARGET = r"!?\[([^\]\[]*)\]\([^)\s]*\)"
MD_HEADING = r"(?m)^#{1,6} +(.*)$"


def markdown_entries(files: DataFrame, key: str = "page_id", md: str = "md") -> DataFrame:
    """Structured entry of each markdown text: the first heading (else the first line) as
    title, the text without heading marks and link targets as content, all links in
    order. Built-in expressions only; a null text gives null parts."""
    def plain(c):
        return F.regexp_replace(c, MD_TARGET, "$1")
    head = F.regexp_extract(md, MD_HEADING, 1)
    title = F.trim(plain(F.when(head != "", head).otherwise(F.split(md, "\n")[0])))
    content = F.regexp_replace(plain(F.col(md)), r"(?m)^#{1,6} +", "")
    links = F.transform(F.arrays_zip(F.regexp_extract_all(md, F.lit(MD_LINK), 1).alias("text"),
                                     F.regexp_extract_all(md, F.lit(MD_LINK), 2).alias("url")),
                        lambda x: F.struct(x["text"].alias("text"), x["url"].alias("url")))
    return files.select(key, title.alias("title"), content.alias("content"), links.alias("links"))


def page_links(pages: DataFrame) -> DataFrame:
    return (pages.select("page_id", F.explode(H.links("html")).alias("l"))
            .select("page_id", F.col("l.pos").alias("link_pos"), "l.text", "l.url"))


def nav_links(pages: DataFrame) -> DataFrame:
    """Links flagged by whether they sit inside a ``<nav>`` block, numbered within each kind."""
    def kind(nav: bool):
        own = F.filter("_l", lambda x: x["is_nav"] == F.lit(nav))
        return F.transform(own, lambda x, i: F.struct(x["is_nav"].alias("is_nav"), i.cast("int").alias("link_pos"),
                                                      x["text"].alias("text"), x["url"].alias("url")))
    return (pages.select("page_id", H.links("html").alias("_l"))
            .select("page_id", F.inline(F.concat(kind(True), kind(False)))))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _parents(levels: pd.Series) -> pd.Series:
    """Parent section of each heading: the nearest earlier heading of a lower
    level, else the root (0). One stack pass per page, linear in headings."""
    out = []
    for lv in levels:
        if lv is None:
            out.append(None)
            continue
        stack, par = [], []
        for i, level in enumerate(lv, start=1):
            while stack and stack[-1][0] >= level:
                stack.pop()
            par.append(stack[-1][1] if stack else 0)
            stack.append((level, i))
        out.append(par)
    return pd.Series(out)


def sections(md_df: DataFrame, md_col: str = "md", key: str = "page_id") -> DataFrame:
    """Heading hierarchy of a markdown column, computed inside the row.

    Section 0 is the root (text before the first heading, level 0); a heading's
    parent is the nearest earlier heading of a lower level, else the root.
    """
    lines = F.split(F.col(md_col), "\n")
    heads = F.filter(
        F.transform(lines, lambda l, i: F.struct(
            i.alias("pos"),
            F.length(F.regexp_extract(l, r"^(#{1,6}) ", 1)).alias("level"),
            F.regexp_replace(l, r"^#{1,6} ", "").alias("title"))),
        lambda h: h["level"] > 0)
    heads = F.transform(heads, lambda h, j: F.struct(h["pos"].alias("pos"), h["level"].alias("level"),
                                                     h["title"].alias("title"), (j + 1).alias("sec")))
    df = md_df.select(key, lines.alias("_lines"), heads.alias("_h"))
    df = df.withColumn("_p", _parents(F.transform("_h", lambda h: h["level"])))
    n = F.size("_lines")

    def body(start0, stop0):  # lines [start0, stop0) joined, outer newlines trimmed
        return F.regexp_replace(
            F.array_join(F.slice("_lines", start0 + 1, F.greatest(stop0 - start0, F.lit(0))), "\n"),
            r"^\n+|\n+$", "")

    first = F.coalesce(F.get("_h", F.lit(0))["pos"], n)
    root = F.struct(F.lit(0).alias("sec_idx"), F.lit(0).alias("level"),
                    F.lit(None).cast("string").alias("title"),
                    F.lit(None).cast("int").alias("parent_idx"),
                    body(F.lit(0), first).alias("body"))
    secs = F.transform("_h", lambda h, j: F.struct(
        (j + 1).alias("sec_idx"), h["level"].alias("level"), h["title"].alias("title"),
        F.get("_p", j).alias("parent_idx"),
        body(h["pos"] + 1, F.coalesce(F.get("_h", j + 1)["pos"], n)).alias("body")))
    return df.select(key, F.inline(F.concat(F.array(root), secs)))


def page_sections(pages: DataFrame) -> DataFrame:
    md = pages.select("page_id", H.main_markdown("html").alias("md"))
    return sections(md)


# Chunking: running character offset over lines; a line is never split, and
# chunk_id = floor(start offset / chunk_chars). The running sum is linear per
# text, so it runs as an Arrow-batched pandas function inside the row's task
# instead of exploding every line through a shuffle.
CHUNK = T.ArrayType(T.StructType([
    T.StructField("chunk_id", T.IntegerType()),
    T.StructField("n_lines", T.IntegerType()),
    T.StructField("text", T.StringType()),
]))


def _chunker(limit: int):
    @F.pandas_udf(CHUNK)
    def chunk(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            ls = t.split("\n")
            lens = np.fromiter((len(x) + 1 for x in ls), dtype=np.int64, count=len(ls))
            cid = (np.cumsum(lens) - lens) // limit
            cuts = np.r_[0, np.flatnonzero(np.diff(cid)) + 1, len(ls)]
            out.append([{"chunk_id": int(cid[a]), "n_lines": int(b - a), "text": "\n".join(ls[a:b])}
                        for a, b in zip(cuts[:-1], cuts[1:])])
        return pd.Series(out)
    return chunk


def text_chunks(df: DataFrame, key: str = "doc_id", text_col: str = "text",
                limit: int = Params().chunk_chars) -> DataFrame:
    return df.select(key, F.inline(_chunker(limit)(F.col(text_col))))
