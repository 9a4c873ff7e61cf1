"""The section tree of a page by its headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvana.functions.texts import collapse, trim
from corvana.functions.vectors import let

# Character references that are decoded; the ampersand comes last, so that nothing is decoded twice.
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}
HIDDEN = r"(?is)<!--.*?-->|<script[\s>].*?</script\s*>|<style[\s>].*?</style\s*>|<head[\s>].*?</head\s*>"
HEADING = r"(?i)(<h[1-6][\s>])"
MARK = "\u0001"


def plain(html: Column) -> Column:
    """Text without tags, white space collapsed."""
    text = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for name, sign in REFERENCES.items():
        text = F.replace(text, F.lit(name), F.lit(sign))
    return trim(collapse(text))


def sections(html: Column) -> Column:
    """array<struct<section, level, title, parent, path, text>>: a page's sections in order.

    Section 0, of level 0, is what stands before the first heading; each heading opens a section of its
    level, from 1 to 6. Its parent is the nearest section before it of a smaller level, and path the titles
    from the outermost one down to its own, without section 0. text is what stands up to the next heading.
    Comments, scripts, styles and the head are left out. Null for null; an empty page has section 0 alone.
    All of it happens within the row: nothing is shuffled.
    """
    pieces = F.split(F.regexp_replace(F.regexp_replace(F.regexp_replace(html, MARK, " "), HIDDEN, " "), HEADING, f"{MARK}$1"), MARK)
    end = r"(?is)^<h[1-6][\s>].*?</h[1-6]\s*>"

    def one(piece: Column, n: Column) -> Column:
        level = F.when(n == 0, 0).otherwise(F.substring(piece, 3, 1).cast("int"))
        heading = F.regexp_extract(piece, f"({end})", 1)
        return F.struct(
            level.alias("level"), F.when(n == 0, F.lit("")).otherwise(plain(F.when(heading == "", piece).otherwise(heading))).alias("title"),
            F.when(n == 0, plain(piece)).when(heading == "", F.lit("")).otherwise(plain(F.regexp_replace(piece, end, " "))).alias("text"),
        )

    def placed(found: Column) -> Column:
        before = lambda n: F.slice(found, 1, n)

        def parent(x: Column, n: Column) -> Column:
            smaller = F.transform(before(n), lambda y, k: F.when(y["level"] < x["level"], k).otherwise(-1))
            return F.when(n == 0, -1).otherwise(F.array_max(smaller)).cast("int")

        return F.transform(found, lambda x, n: F.struct(n.cast("int").alias("section"), x["level"].alias("level"), x["title"].alias("title"), parent(x, n).alias("parent"), x["text"].alias("text")))

    def pathed(found: Column) -> Column:
        def path(x: Column) -> Column:
            """Six levels at most lie above a section, each the parent of the one below."""
            at, titles = x["section"], F.array().cast("array<string>")
            for _ in range(7):
                titles = F.when(at > 0, F.concat(F.array(F.get(found, at)["title"]), titles)).otherwise(titles)
                at = F.when(at > 0, F.get(found, at)["parent"]).otherwise(at)
            return titles

        return F.transform(found, lambda x: F.struct(x["section"].alias("section"), x["level"].alias("level"), x["title"].alias("title"), x["parent"].alias("parent"), path(x).alias("path"), x["text"].alias("text")))

    return let(let(F.transform(pieces, one), placed), pathed)
