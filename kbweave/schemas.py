"""Schemas of the tables the jobs read and write."""

from pyspark.sql import types as T

LINK = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("url", T.StringType()),
])

# Structured entry {title, content, links[]} produced from one page.
ENTRY = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("links", T.ArrayType(LINK)),
])

# Knowledge-base document row: one per title, content and link of an entry. The
# key is (page_id, ord); ``doc_id`` spells it as one string, so any page id and
# any number of links fit. ``embedding`` is made at ingest and searched as stored.
KB_DOCUMENT = T.StructType([
    T.StructField("doc_id", T.StringType(), False),
    T.StructField("page_id", T.LongType()),
    T.StructField("ord", T.IntegerType()),
    T.StructField("doc_type", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

CONVERSATIONS = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
])
