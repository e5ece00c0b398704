"""Aggregate views over papers, links and venues.

papers (paper_id, title, year, type, conf_id, journal_id), links (paper_id, author_id,
author_order). The fan-out from papers to links is joined once: a paper carries its
number of links n, from which sums over links follow (average of n over links is
sum(n * n) / sum(n)); only distinct authors need the links themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def paper_author_count(links: DataFrame) -> DataFrame:
    return links.groupBy("paper_id").agg(F.count(F.lit(1)).alias("author_count"))


def venue_yearly(papers: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Per venue and year, over papers with links: papers, author slots, distinct authors, average per slot."""
    own = papers.filter(F.col(key).isNotNull()).select("paper_id", key, "year")
    counted = own.join(paper_author_count(links), "paper_id").groupBy(key, "year").agg(
        F.count(F.lit(1)).alias("paper_count"), F.sum("author_count").alias("total_author_slots"), (F.sum(F.col("author_count") * F.col("author_count")) / F.sum("author_count")).alias("avg_authors_per_paper")
    )
    distinct = own.join(links.select("paper_id", "author_id"), "paper_id").groupBy(key, "year").agg(F.count_distinct("author_id").alias("distinct_authors"))
    return counted.join(distinct, [key, "year"])


def venue_profile(venues: DataFrame, papers: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """One row per venue, also without papers: totals, years, averages."""
    own = papers.filter(F.col(key).isNotNull()).select("paper_id", key, "year")
    n = F.coalesce("author_count", F.lit(0))
    per = own.join(paper_author_count(links), "paper_id", "left").groupBy(key).agg(
        F.count(F.lit(1)).alias("total_papers"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.count_distinct("year").alias("active_years"),
        F.sum(n).alias("total_author_slots"),
        (F.sum(n * n) / F.nullif(F.sum(n), F.lit(0))).alias("avg_authors_per_paper"),
    )
    distinct = own.join(links.select("paper_id", "author_id"), "paper_id").groupBy(key).agg(F.count_distinct("author_id").alias("distinct_authors"))
    out = venues.join(per, key, "left").join(distinct, key, "left")
    zero = ["total_papers", "active_years", "total_author_slots", "distinct_authors"]
    out = out.fillna(0, zero)
    return out.withColumns({"avg_authors_per_paper": F.round("avg_authors_per_paper", 2), "avg_papers_per_year": F.round(F.col("total_papers") / F.nullif(F.col("active_years"), F.lit(0)), 2)})


def author_profile(authors: DataFrame, papers: DataFrame, links: DataFrame) -> DataFrame:
    per = links.join(papers.select("paper_id", "year", "type"), "paper_id").groupBy("author_id").agg(
        F.count(F.lit(1)).alias("total_papers"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_distinct("year").alias("active_years"),
        F.count_if(F.col("type") == "conference").alias("conference_papers"), F.count_if(F.col("type") == "journal").alias("journal_papers"),
    )
    return authors.join(per, "author_id")


def author_yearly(papers: DataFrame, links: DataFrame) -> DataFrame:
    return links.join(papers.select("paper_id", "year", "type"), "paper_id").groupBy("author_id", "year", "type").agg(F.count(F.lit(1)).alias("paper_count"))


def year_profile(papers: DataFrame, links: DataFrame) -> DataFrame:
    """Papers without links count; measures of papers and of links are taken apart and joined on the year."""
    of_papers = papers.groupBy("year").agg(F.count(F.lit(1)).alias("total_papers"), F.count_distinct("conf_id").alias("distinct_conferences"), F.count_distinct("journal_id").alias("distinct_journals"))
    of_links = links.join(papers.select("paper_id", "year"), "paper_id").groupBy("year").agg(F.count_distinct("author_id").alias("distinct_authors"), F.count(F.lit(1)).alias("total_author_slots"))
    return of_papers.join(of_links, "year", "left").fillna(0, ["distinct_authors", "total_author_slots"])


def publisher_stats(journals: DataFrame) -> DataFrame:
    """Journals by quartile; a publisher whose quartiles are all unknown has null, not 0."""
    q = lambda n: F.sum((F.col("best_quartile") == n).cast("int")).cast("long").alias(f"{n.lower()}_count")
    return journals.filter(F.col("publisher").isNotNull()).groupBy("publisher").agg(F.count(F.lit(1)).alias("journal_count"), *[q(f"Q{k}") for k in range(1, 5)])


def publisher_bar(journals: DataFrame, top: int = 15) -> DataFrame:
    """The same as counts from 0, blank publishers left out, the largest first."""
    q = lambda n: F.count_if(F.coalesce(F.col("best_quartile") == n, F.lit(False))).alias(f"{n.lower()}_count")
    per = journals.filter(F.col("publisher").isNotNull() & (F.col("publisher") != "")).groupBy("publisher").agg(F.count(F.lit(1)).alias("journal_count"), *[q(f"Q{k}") for k in range(1, 5)])
    return per.orderBy(F.desc("journal_count"), "publisher").limit(top)


def category_yearly(papers: DataFrame, venues: DataFrame, categories: DataFrame, key: str, category: str) -> DataFrame:
    """Papers and venues per category and year. venues: key, category; categories: category, description."""
    j = papers.filter(F.col(key).isNotNull()).join(venues.select(key, category), key).join(categories, category)
    return j.groupBy(category, "description", "year").agg(F.count_distinct("paper_id").alias("paper_count"), F.count_distinct(key).alias("venue_count"))


def nested_by_category(yearly: DataFrame, category: str) -> DataFrame:
    """One row per category with its years in order, as an array."""
    rows = F.array_sort(F.collect_list(F.struct("year", "paper_count", "venue_count")))
    return yearly.groupBy(category, "description").agg(rows.alias("yearly_data"))


def author_yearly_split(papers: DataFrame, links: DataFrame, author_id: int) -> DataFrame:
    own = links.filter(F.col("author_id") == author_id).join(papers.select("paper_id", "year", "type"), "paper_id")
    return own.groupBy("year").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("type") == "conference").alias("conference"), F.count_if(F.col("type") == "journal").alias("journal"))


def yearly_totals(papers: DataFrame, first: int = 1900) -> DataFrame:
    return papers.filter(F.col("year").between(first, F.year(F.current_date()))).groupBy("year").agg(F.count(F.lit(1)).alias("paper_count"))


def global_counts(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias(f"total_{name}"))
        out = one if out is None else out.crossJoin(one)  # one row by one row
    return out


def duplicate_identities(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def ordered_list(df: DataFrame, group: str, order: str, value: str, sep: str = ",") -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct(order, value)))
    return df.groupBy(group).agg(F.array_join(F.transform(pairs, lambda p: p[value].cast("string")), sep).alias("listed"))


def frequency(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.lower(value), value)


def mode_per_group(df: DataFrame, group: str, value: str, seq: str) -> DataFrame:
    """The commonest value of each group; of ties the one met first."""
    per = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("_seq"))
    return per.groupBy(group).agg(F.max_by(value, F.struct("n", -F.col("_seq"))).alias("mode"), F.max("n").alias("n"))


def top_per_group(df: DataFrame, group: str, value: str, seq: str, k: int = 5) -> DataFrame:
    """The k commonest values of each group with their place; of ties the one met first."""
    from pyspark.sql import Window

    per = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("_seq"))
    return per.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "_seq"))).filter(F.col("place") <= k).drop("_seq")


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation, means and extents over rows where both are numbers; null if a variance is zero or one row is left."""
    ok = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    n = F.count(F.lit(1))
    cov = F.sum(F.col("x") * F.col("y")) - F.sum("x") * F.sum("y") / n
    var = (F.sum(F.col("x") * F.col("x")) - F.sum("x") * F.sum("x") / n) * (F.sum(F.col("y") * F.col("y")) - F.sum("y") * F.sum("y") / n)
    return ok.agg(n.alias("n"), F.when((n > 1) & (var > 0), cov / F.sqrt(var)).alias("r"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def axis_domain(df: DataFrame, *measures: str) -> DataFrame:
    """The greatest of several measures, with a tenth of air."""
    return df.agg((F.max(F.greatest(*[F.col(m).cast("double") for m in measures])) * 1.1).alias("domain_max"))


def busiest(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(1)


def condition(c: Column, name: str) -> Column:
    return F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("long").alias(name)


#: Counts that a load is held against, in the order of the report.
COUNTS = ["papers_total", "papers_conference", "papers_journal", "authors", "paper_authors", "matched_conference_rows", "unmatched_conference_rows", "matched_journal_rows", "unmatched_journal_rows"]


def validation_checks(papers: DataFrame, links: DataFrame, authors: DataFrame, raw: list[str], expected: dict[str, int] | None = None) -> DataFrame:
    """The thirteen checks (check_name, actual, expected, ok), each table read once.

    Structure: (type, raw id) is unique and how many rows repeat it, links without a paper or
    an author. Counts: the load's, against ``expected``; a count without an expectation is ok.
    """
    kind = lambda k: F.col("type") == k
    of_papers = papers.agg(
        F.count(F.lit(1)).alias("papers_total"), condition(kind("conference"), "papers_conference"), condition(kind("journal"), "papers_journal"),
        condition(kind("conference") & F.col("conf_id").isNotNull(), "matched_conference_rows"), condition(kind("conference") & F.col("conf_id").isNull(), "unmatched_conference_rows"),
        condition(kind("journal") & F.col("journal_id").isNotNull(), "matched_journal_rows"), condition(kind("journal") & F.col("journal_id").isNull(), "unmatched_journal_rows"),
    )
    twice = papers.groupBy("type", *raw).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_papers"))
    people = authors.agg(F.count(F.lit(1)).alias("authors"))
    pairs = links.agg(F.count(F.lit(1)).alias("paper_authors"))
    lost = links.join(papers, "paper_id", "left_anti").agg(F.count(F.lit(1)).alias("links_without_paper"))
    nobody = links.join(authors, "author_id", "left_anti").agg(F.count(F.lit(1)).alias("links_without_author"))
    row = reduce(lambda x, y: x.crossJoin(y), [of_papers, twice, people, pairs, lost, nobody])  # one row each
    row = row.withColumn("papers_not_unique", (F.col("duplicate_papers") > 0).cast("long"))
    names = ["papers_not_unique", "duplicate_papers", "links_without_paper", "links_without_author", *COUNTS]
    wanted = dict.fromkeys(names[:4], 0) | (expected or {})
    table = F.create_map(*[x for k, v in wanted.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    df = row.unpivot([], names, "check_name", "actual").withColumn("expected", table[F.col("check_name")])
    return df.withColumn("ok", F.coalesce(F.col("actual") == F.col("expected"), F.lit(True)))


def lookups(categories: DataFrame, ranks: list[str]) -> DataFrame:
    """kind, id and name of what venues can be filtered by."""
    own = categories.select(F.lit("category").alias("kind"), F.col("primary_for").cast("string").alias("id"), F.col("description").alias("name"))
    fixed = categories.sparkSession.createDataFrame([("rank", r, r) for r in ranks], "kind string, id string, name string")
    return own.unionByName(fixed)


def profile_years(profile: DataFrame, yearly: DataFrame, key: str) -> DataFrame:
    """A venue's profile beside each of its years, which are null for a venue without any."""
    return profile.join(yearly, key, "left")


def venue_total(conferences: DataFrame, journals: DataFrame) -> DataFrame:
    """How many venues there are of both kinds together: one row."""
    n = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    return n(conferences).unionByName(n(journals)).agg(F.sum("n").alias("venues"))


def series_by_code(points: DataFrame, categories: DataFrame, code: str) -> DataFrame:
    """Points of a chart with the series that their code names; codes compare as text."""
    c = categories.select(F.col(code).cast("string").alias("_code"), "description")
    return points.join(c, F.col(code).cast("string") == F.col("_code")).drop("_code")
