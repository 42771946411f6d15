"""HTML as columns: text, markdown, title, main content and links of pages.

Every function is one Arrow-batched pass of ``functions.markup`` over the column,
inside the task that read the page. Null stays null.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbweave.functions.markup import Page
from kbweave.schemas import LINK

PAGE_LINK = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("text", T.StringType()),
                          T.StructField("url", T.StringType()), T.StructField("is_nav", T.BooleanType())])
PARTS = T.StructType([T.StructField("title", T.StringType()), T.StructField("content", T.StringType()),
                      T.StructField("links", T.ArrayType(LINK))])


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _strings(of: Callable[[Page], str]):
    @F.arrow_udf(T.StringType())
    def run(col: pa.Array) -> pa.Array:
        return pa.array([None if s is None else of(Page(s)) for s in col.to_pylist()], pa.string())
    return run


def html_to_text(col) -> Column:
    return _strings(Page.text)(_c(col))


def html_to_markdown(col) -> Column:
    return _strings(Page.markdown)(_c(col))


def page_title(col) -> Column:
    """``<title>`` text, falling back to the first ``<h1>``."""
    return _strings(Page.title)(_c(col))


def main_text(col) -> Column:
    """Text of all articles, else of the body, else of the page."""
    return _strings(Page.main_text)(_c(col))


def main_markdown(col) -> Column:
    return _strings(Page.main_markdown)(_c(col))


def links(col) -> Column:
    """``ARRAY<STRUCT<pos, text, url, is_nav>>`` in document order."""
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("text", pa.string()), ("url", pa.string()), ("is_nav", pa.bool_())]))

    @F.arrow_udf(T.ArrayType(PAGE_LINK))
    def run(col: pa.Array) -> pa.Array:
        return pa.array([None if s is None else [{"pos": i, "text": t, "url": u, "is_nav": nav}
                                                 for i, (t, u, nav) in enumerate(Page(s).links)] for s in col.to_pylist()], kind)
    return run(_c(col))


def entry_parts(col) -> Column:
    """``STRUCT<title, content, links>`` of a page in one pass."""
    kind = pa.struct([("title", pa.string()), ("content", pa.string()),
                      ("links", pa.list_(pa.struct([("text", pa.string()), ("url", pa.string())])))])

    @F.arrow_udf(PARTS)
    def run(col: pa.Array) -> pa.Array:
        out = []
        for s in col.to_pylist():
            if s is None:
                out.append(None)
                continue
            p = Page(s)
            out.append({"title": p.title(), "content": p.main_text(), "links": [{"text": t, "url": u} for t, u, _ in p.links]})
        return pa.array(out, kind)
    return run(_c(col))
