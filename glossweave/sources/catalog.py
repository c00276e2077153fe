"""Catalog search results from their JSON."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The catalog's address and the seconds to wait for it.
CATALOG, TIMEOUT = "https://gutendex.com/books", 20
RESULT = "count long, next string, results array<struct<id:long,title:string,authors:array<struct<name:string>>,languages:array<string>,download_count:long,formats:map<string,string>>>"


def parse_results(replies: DataFrame, column: str = "reply") -> DataFrame:
    """count, has_next, id, title, authors, languages, downloads, has_text of every result of every reply."""
    parsed = replies.select(F.from_json(column, RESULT).alias("r"))
    each = parsed.select(F.coalesce("r.count", F.lit(0)).alias("count"), (F.coalesce("r.next", F.lit("")) != "").alias("has_next"), F.explode("r.results").alias("b"))
    return each.select("count", "has_next", *[c.alias(n) for n, c in book(F.col("b")).items()])


def book(b: Column) -> dict[str, Column]:
    named = F.array_join(F.transform(b["authors"], lambda a: a["name"]), ", ")
    return {
        "id": b["id"],
        "title": F.coalesce(b["title"], F.lit("(untitled)")),
        "authors": F.coalesce(F.nullif(named, F.lit("")), F.lit("Unknown")),
        "languages": F.coalesce(b["languages"], F.array().cast("array<string>")),
        "downloads": F.coalesce(b["download_count"], F.lit(0)),
        "has_text": F.coalesce(F.exists(F.map_keys(b["formats"]), lambda k: F.startswith(k, F.lit("text/plain"))), F.lit(False)),
    }


def search(spark: SparkSession, query: str, language: str | None = None, page: int = 1, get: Callable[[str], str] | None = None) -> DataFrame:
    """Results of one page of a catalog search."""
    parameters = {"search": query, "page": page} | ({"languages": language} if language else {})
    url = f"{CATALOG}?{urllib.parse.urlencode(parameters)}"
    if get is None:
        with urllib.request.urlopen(url, timeout=TIMEOUT) as reply:
            body = json.dumps(json.load(reply))
    else:
        body = get(url)
    return parse_results(spark.createDataFrame([(body,)], "reply string"))
