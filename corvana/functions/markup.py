"""Markup to plain text."""

from __future__ import annotations

import re
from collections.abc import Collection
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SILENT = frozenset({"script", "style", "template", "noscript", "head"})
BREAKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())


class Lines(HTMLParser):
    """Collects the visible text; block elements part lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.silent = [[]], 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in SILENT
        if tag in BREAKS:
            self.lines.append([])
        elif tag in ("td", "th"):
            self.lines[-1].append(" ")

    def handle_endtag(self, tag):
        self.silent = max(0, self.silent - (tag in SILENT))
        if tag in BREAKS:
            self.lines.append([])

    def handle_data(self, data):
        if not self.silent:
            self.lines[-1].append(data)


def html_to_text(html: Column | str, bare: Collection[str] | None = None) -> Column:
    """All visible text of a page: links as their text, no images, a line for each block; null for null.

    bare: names of the character references that count without their semicolon too, by default those of
    HTML; others stay as they are written there, as at the end of a title that was cut.
    """
    written = bare is not None and re.compile(rf"&(?!#[0-9]+;|#[xX][0-9a-fA-F]+;{''.join(f'|{re.escape(name)}' for name in sorted(bare))})([0-9a-zA-Z]+;)?")

    def one(page):
        if page is None:
            return None
        parser = Lines()
        parser.feed(written.sub(lambda m: m[0] if m[1] in html5 else f"&amp;{m[0][1:]}", page) if written else page)
        parser.close()
        return "\n".join(line for line in (" ".join("".join(parts).split()) for parts in parser.lines) if line)

    def texts(pages: pd.Series) -> pd.Series:
        return pages.map(one)

    return F.pandas_udf(texts, T.StringType())(html)
