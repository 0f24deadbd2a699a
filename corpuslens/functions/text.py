"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_text(c: Column) -> Column:
    """White space of any script collapsed to one blank, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def id_and_version(url: Column) -> Column:
    """(base, version) of the last path segment of an entry's URL; both null without a version."""
    last = F.substring_index(F.rtrim(url, F.lit("/")), "/", -1)
    base = F.regexp_extract(last, r"^(.+?)v(\d+)$", 1)
    number = F.regexp_extract(last, r"^(.+?)v(\d+)$", 2)
    found = F.length(base) > 0
    return F.struct(F.when(found, base).alias("base_id"), F.when(found, number.try_cast("int")).alias("version"))


def search_text(c: Column) -> Column:
    """Wildcards removed, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[?*]", " "), r"\s+", " "))


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, " "), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token arrays; 0 where either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)))


#: Headings of an embedded text, and what stands for no category.
HEADINGS = ("Title: ", "\n\nAbstract: ", "\n\nPrimary Category: ")
NO_CATEGORY = "Unknown"


def tidy(c: Column) -> Column:
    """White space of any script collapsed to one blank, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def headed_text(title: Column, abstract: Column, category: Column) -> Column:
    """Tidy title, tidy abstract and category under headings, blank ones too; null where one is null."""
    return F.concat(F.lit(HEADINGS[0]), tidy(title), F.lit(HEADINGS[1]), tidy(abstract), F.lit(HEADINGS[2]), category)


def canonical_text(title: Column, abstract: Column, category: Column) -> Column:
    """What is embedded: headed_text() with a category for none; null where title or abstract is blank."""
    whole = headed_text(title, abstract, F.coalesce(F.nullif(tidy(category), F.lit("")), F.lit(NO_CATEGORY)))
    return F.when((F.length(tidy(title)) > 0) & (F.length(tidy(abstract)) > 0), whole)


def short_abstract(c: Column, limit: int = 500) -> Column:
    """At most ``limit`` characters and a mark: cut after the last sentence that ends past half, else before the last blank."""
    head = F.substring(c, 1, limit)
    back = F.instr(F.reverse(head), " .")  # ". " read backwards
    point = limit - 1 - back  # where the last sentence's point stands, from 0
    blank = limit - F.instr(F.reverse(head), " ")
    sentence = F.concat(F.substring(head, F.lit(1), point + 1), F.lit(".."))
    word = F.concat(F.when((blank > 0) & (blank < limit), F.substring(head, F.lit(1), blank)).otherwise(head), F.lit("..."))
    return F.when(F.length(c) <= limit, c).when((back > 0) & (point > limit / 2), sentence).otherwise(word)


#: Fixed value: a connection string with credentials.
CONNECTION_STRING = r"[a-zA-Z][a-zA-Z0-9+.\-]*://[^\s]*@[^\s]*"


def redact(c: Column, limit: int = 1000) -> Column:
    """Connection strings removed, at most ``limit`` characters."""
    return F.substring(F.regexp_replace(c, CONNECTION_STRING, "[redacted-connection-string]"), 1, limit)
