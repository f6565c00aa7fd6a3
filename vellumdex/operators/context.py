"""Context texts that apply to documents by scope and path prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_path(path: Column) -> Column:
    """A relative path without blanks around it, leading ``./`` or ``/``, doubled or final slashes."""
    flat = F.regexp_replace(F.regexp_replace(F.trim(path), r"^\./", ""), r"/+", "/")
    return F.regexp_replace(F.when(flat == ".", F.lit("")).otherwise(flat), r"^/+|/+$", "")


def prefix_matches(path: Column, prefix: Column) -> Column:
    """Whether the prefix is empty, the path itself, or one of its folders."""
    return (prefix == "") | (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))


def folders_of(path: Column) -> Column:
    """The path, each folder above it and the empty path: all prefixes that can match."""
    parts = F.split(path, "/")
    tops = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.array_distinct(F.concat(F.array(F.lit("")), tops))


def applying_contexts(documents: DataFrame, contexts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``doc, found``: for each document and each of its folders that has contexts, an array of ``length, scoped, made, text``.

    Two equi-joins on the document's own folders: global contexts by path, those of a collection by
    collection and path, so that no document meets another collection's contexts. The contexts of one
    scope and path are one row before they are joined: the empty path, which every
    document has, brings one row a document, and its partition can be split by skew handling.
    """
    paths = documents.select(doc, "collection_id", F.explode(folders_of(clean_path(F.coalesce("relative_path", F.lit(""))))).alias("prefix"))
    texts = contexts.where(F.trim("text") != "").select(F.col("collection_id").alias("scope"), clean_path(F.coalesce("path_prefix", F.lit(""))).alias("prefix"), F.trim("text").alias("text"), F.coalesce(F.col("created_at").cast("string"), F.lit("")).alias("made"))
    item = F.struct(F.length("prefix").alias("length"), F.col("scope").isNotNull().cast("int").alias("scoped"), "made", "text")
    grouped = texts.groupBy("scope", "prefix").agg(F.collect_list(item).alias("found"))
    everywhere = paths.join(grouped.where("scope is null").drop("scope"), "prefix")
    inside = paths.join(grouped.where("scope is not null").withColumnRenamed("scope", "collection_id"), ["collection_id", "prefix"])
    return everywhere.select(doc, "found").unionByName(inside.select(doc, "found"))


def context_texts(documents: DataFrame, contexts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``doc, context_text``: all texts that apply to a document, the more general first, joined by blank lines.

    Global contexts and those of the document's collection apply where their prefix
    matches. Order: shorter prefix first, global before collection, then creation. Documents to
    which nothing applies have an empty text; a null path matches only empty prefixes.
    """
    all_of = F.array_sort(F.flatten(F.collect_list("found")))
    found = applying_contexts(documents, contexts, doc).groupBy(doc).agg(F.array_join(F.transform(all_of, lambda x: x["text"]), "\n\n").alias("context_text"))
    return documents.select(doc).join(found, doc, "left").select(doc, F.coalesce("context_text", F.lit("")).alias("context_text"))
