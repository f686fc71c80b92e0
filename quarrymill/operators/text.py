"""Documents as chunks and token sets, and ranking by overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


#: Characters that part words.
BETWEEN = r"[^\p{L}\p{N}_]"


def tokens(text: Column) -> Column:
    """Distinct lower-cased word tokens of more than two characters, of any alphabet."""
    return F.array_distinct(F.filter(F.split(F.lower(text), f"{BETWEEN}+"), lambda t: F.length(t) > 2))


def chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row a markdown section: the columns of ``docs`` without the text, and position, heading and body. What
    stands before the first heading is a section without one."""
    marked = F.regexp_replace(F.concat(F.lit("\n"), F.col(text)), r"\n(#{1,6} )", "\u0001$1")
    parts = docs.select("*", F.posexplode(F.split(marked, "\u0001")).alias("position", "_part")).where(F.trim(F.regexp_replace("_part", r"\s+", " ")) != "")
    heading = F.nullif(F.regexp_extract("_part", r"^#{1,6} ([^\n]*)", 1), F.lit(""))
    return parts.select(*[c for c in docs.columns if c != text], "position", heading.alias("heading"), F.trim(F.regexp_replace("_part", r"^#{1,6} [^\n]*\n?|^\n", "")).alias("body"))


def overlap(docs: DataFrame, query: str, text: str = "text", k: int = 10, key: str = "doc_id") -> DataFrame:
    """The ``k`` rows that share most tokens with ``query``, ties by key."""
    wanted = sorted({t for t in re.split(r"\W+", query.lower()) if len(t) > 2})
    low = F.lower(F.col(text))
    # a plain search first: most texts lack most words, and only those that have the letters are looked at closely
    found = [F.when(F.contains(low, F.lit(t)), low.rlike(f"(^|{BETWEEN}){re.escape(t)}($|{BETWEEN})")).otherwise(False).cast("int") for t in wanted]
    score = reduce(lambda a, b: a + b, found, F.lit(0))
    return docs.select(key, score.alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(k)


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.out.append(data.strip())


def strip_html(html: str | None) -> str | None:
    """Text nodes outside of scripts and styles, one a line."""
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    return "\n".join(parser.out)


@F.pandas_udf(StringType())
def html_text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for html in parts:
        yield html.map(strip_html)
