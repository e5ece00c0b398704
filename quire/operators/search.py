"""Queries of the API: filters, text search, paging, top-k, coverage."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import ascii_fold

#: Queries of at most this many characters search for a substring.
SHORT = 3


def folded(c: Column) -> Column:
    return F.lower(ascii_fold(c))


def sanitize(query: str | None) -> str:
    """Word characters and blanks of a query."""
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", query or "")).strip()


def fold_query(query: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFKD", query) if not unicodedata.combining(c)).lower()


def text_search(df: DataFrame, query: str | None, *columns: str) -> DataFrame:
    """Rows where every term of the query is a prefix of some word of the columns; short queries search for a substring.

    Words are runs of letters, digits and ``_`` of the folded text: no stop words, no least length.
    An empty query finds nothing, and the table is not read for it.
    """
    q = fold_query(sanitize(query))
    if not q:
        return df.limit(0)
    if len(q) <= SHORT:
        cond = None
        for c in columns:
            one = F.contains(folded(F.col(c)), F.lit(q))
            cond = one if cond is None else cond | one
        return df.filter(cond)
    words = F.split(folded(F.concat_ws(" ", *columns)), r"(?U)[^\w]+")
    return reduce(lambda d, term: d.filter(F.exists(words, lambda w: F.startswith(w, F.lit(term)))), q.split(), df)


def year_range(df: DataFrame, low: int | None = None, high: int | None = None, swap: bool = False) -> DataFrame:
    """Inclusive bounds, each optional (0 counts as absent); ``swap`` mends an inverted range."""
    if swap and low and high and low > high:
        low, high = high, low
    if low:
        df = df.filter(F.col("year") >= low)
    return df.filter(F.col("year") <= high) if high else df


def parse_ids(raw: str, limit: int = 20, numeric: bool = True) -> list:
    """Ids of a comma-separated list, those that are none dropped, at most ``limit``."""
    found = [x.strip() for x in (raw or "").split(",")]
    found = [int(x) for x in found if re.fullmatch(r"[0-9]+", x)] if numeric else [x for x in found if x.isalnum()]
    if not found:
        raise ValueError("no valid id")
    return found[:limit]


def clamp_page(page: int, per_page: int, most: int = 100) -> tuple[int, int]:
    return max(1, page), max(1, min(per_page, most))


def page_of(df: DataFrame, order: list, page: int = 1, per_page: int = 50, most: int = 200) -> DataFrame:
    """A page in a total order: ``order`` has to end in a key."""
    page, per_page = clamp_page(page, per_page, most)
    return df.orderBy(*order).offset((page - 1) * per_page).limit(per_page)


def pagination(df: DataFrame, page: int, per_page: int, most: int = 200) -> dict:
    page, per_page = clamp_page(page, per_page, most)
    total = df.count()
    return {"page": page, "per_page": per_page, "total": total, "total_pages": math.ceil(total / per_page)}


def category_code(code: str) -> str:
    """A six-digit category searches by its first four."""
    return code[:4] if re.fullmatch(r"[0-9]{6}", code) else code


def with_coverage(venues: DataFrame, papers: DataFrame, key: str) -> DataFrame:
    """Adds whether the venue has any paper."""
    has = papers.filter(F.col(key).isNotNull()).select(F.col(key).alias("_has")).distinct()
    return venues.join(has, venues[key] == has["_has"], "left").withColumn("has_coverage", F.col("_has").isNotNull()).drop("_has")


def only_covered(venues: DataFrame, papers: DataFrame, key: str) -> DataFrame:
    return venues.join(papers.select(key), key, "left_semi")


def venue_search(venues: DataFrame, papers: DataFrame, key: str, query: str, columns: list[str], facets: dict | None = None, covered: bool = False) -> DataFrame:
    """Text search and facets with the coverage flag, covered venues first, then by title."""
    df = text_search(venues, query, *columns)
    for c, v in (facets or {}).items():
        df = df.filter(F.contains(folded(F.col(c)), F.lit(fold_query(v))) if c == "publisher" else F.col(c) == v)
    df = only_covered(df, papers, key) if covered else df
    return with_coverage(df, papers, key).orderBy(F.desc("has_coverage"), "title", key)


def top_authors(papers: DataFrame, links: DataFrame, authors: DataFrame, key: str, venue: int, limit: int = 10) -> DataFrame:
    limit = max(1, min(limit, 100))
    own = papers.filter(F.col(key) == venue).select("paper_id")
    per = links.join(own, "paper_id").groupBy("author_id").agg(F.count(F.lit(1)).alias("paper_count"))
    return per.join(authors.select("author_id", "name"), "author_id").orderBy(F.desc("paper_count"), "name", "author_id").limit(limit)


def with_venue_names(papers: DataFrame, conferences: DataFrame, journals: DataFrame) -> DataFrame:
    """Left joins to the two kinds of venue, of which at most one can match."""
    c, j = conferences.select("conf_id", F.col("title").alias("conf_title")), journals.select("journal_id", F.col("title").alias("journal_title"))
    return papers.join(c, "conf_id", "left").join(j, "journal_id", "left").withColumn("venue", F.coalesce("conf_title", "journal_title"))


def author_papers(papers: DataFrame, links: DataFrame, conferences: DataFrame, journals: DataFrame, author: int) -> DataFrame:
    own = papers.join(links.filter(F.col("author_id") == author).select("paper_id", "author_order"), "paper_id")
    return with_venue_names(own, conferences, journals)


def year_papers(papers: DataFrame, links: DataFrame, year: int, conf_id: int | None = None, journal_id: int | None = None, author: int | None = None) -> DataFrame:
    df = papers.filter(F.col("year") == year)
    df = df.filter(F.col("conf_id") == conf_id) if conf_id else df
    df = df.filter(F.col("journal_id") == journal_id) if journal_id else df
    return df.join(links.filter(F.col("author_id") == author).select("paper_id"), "paper_id", "left_semi") if author else df


def venues_bar(profiles: DataFrame, key: str, ids: list[int]) -> DataFrame:
    """Chosen venues with the product of their averages; the ids reach the tables below the aggregate."""
    return profiles.filter(F.col(key).isin(ids)).select(key, "title", F.coalesce("total_papers", F.lit(0)).alias("total_papers"), F.round(F.coalesce(F.col("avg_authors_per_paper") * F.col("avg_papers_per_year"), F.lit(0.0)), 1).alias("score"))


def metrics_scatter(journals: DataFrame, top: int = 500) -> DataFrame:
    return journals.filter(F.col("sjr_index").isNotNull() & F.col("h_index").isNotNull()).select("journal_id", "title", "sjr_index", "h_index").orderBy(F.desc("sjr_index"), "journal_id").limit(top)
