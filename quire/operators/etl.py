"""Cleaning, lookups and loading: filters, merges and keyed writes as DataFrame operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X

RANKS, QUARTILES = ["A*", "A", "B", "C"], ["Q1", "Q2", "Q3", "Q4"]


def clean_papers(raw: DataFrame, venue: str) -> DataFrame:
    """Stripped columns and a valid year; rows without id, title, venue or year go."""
    df = raw.select(*[X.clean_text(F.col(c)).alias(c) if c != "year" else X.clean_year(F.col(c)).alias(c) for c in raw.columns])
    return df.dropna(subset=["id", "title", venue, "year"])


def skipped_rows(raw: DataFrame, venue: str) -> DataFrame:
    """How many rows ``clean_papers`` keeps and drops, in one pass."""
    ok = X.clean_text(F.col("id")).isNotNull() & X.clean_text(F.col("title")).isNotNull() & X.clean_text(F.col(venue)).isNotNull() & X.clean_year(F.col("year")).isNotNull()
    return raw.agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("skipped"))


def author_links(raw: DataFrame, paper: str = "id", authors: str = "author") -> DataFrame:
    """paper_id, author_name and 1-based author_order; blanks do not take a place."""
    return raw.select(F.col(paper).alias("paper_id"), F.posexplode(X.split_authors(F.col(authors))).alias("_p", "author_name")).select("paper_id", "author_name", (F.col("_p") + 1).alias("author_order"))


def first_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return _one(df, keys, F.col(seq).asc())


def last_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return _one(df, keys, F.col(seq).desc())


def _one(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Existing rows, and of the new ones the first per key that is not there yet."""
    fresh = first_wins(new, keys, seq).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def numbered(df: DataFrame, order: str, ties: list[str], out: str, buckets: int = 1024) -> DataFrame:
    """Adds numbers from 1 on in the order of a numeric column and the ties.

    Rows fall into ranges of equal width; a range is numbered by itself and goes on from
    the counts of those before, so no task orders all rows.
    """
    ends = df.agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    place = F.floor((F.col(order) - F.col("_lo")) * (buckets - 1) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1))).cast("int")
    ranged = df.join(F.broadcast(ends)).withColumn("_range", place).drop("_lo", "_hi")
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # as many rows as ranges
    before = counts.select(F.col("_range"), F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(order, *ties))
    return ranged.withColumn("_k", within).join(F.broadcast(before), "_range").withColumn(out, F.col("_k") + F.col("_before")).drop("_range", "_k", "_before")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], seq: str, updated: list[str], kept_id: str) -> DataFrame:
    """Last new row per key wins for ``updated``; rows that are there keep their id.

    Keys that are not there yet get ids that go on from the greatest, in the order in which
    they first come (a numeric ``seq``), then of the keys.
    """
    first = F.min(seq).over(Window.partitionBy(*keys))
    n, o = last_wins(new.withColumn("_first", first), keys, seq).alias("n"), existing.alias("o")
    same = reduce(lambda x, y: x & y, [F.col(f"n.{k}") == F.col(f"o.{k}") for k in keys])
    j = o.join(n, same, "left")
    is_new = F.col(f"n.{keys[0]}").isNotNull()
    was = j.select(f"o.{kept_id}", *[F.col(f"o.{k}") for k in keys], *[F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in updated])
    fresh = numbered(n.join(o, same, "left_anti").select(*[F.col(f"n.{k}") for k in keys], *[F.col(f"n.{c}") for c in updated], "_first"), "_first", keys, "_number")
    top = existing.agg(F.coalesce(F.max(kept_id), F.lit(0)).alias("_top"))
    added = fresh.join(F.broadcast(top)).select((F.col("_top") + F.col("_number")).alias(kept_id), *keys, *updated)
    return was.unionByName(added)


def missing(rows: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Rows whose folded key is not present."""
    have = present.select(F.lower(X.ascii_fold(F.col(key))).alias("_k")).distinct()
    return rows.withColumn("_k", F.lower(X.ascii_fold(F.col(key)))).join(have, "_k", "left_anti").drop("_k")


def backfill(df: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """Fills the column where it is null or blank."""
    u = updates.select(F.col(key).alias("_key"), F.col(column).alias("_value"))
    j = df.join(u, df[key] == u["_key"], "left")
    empty = F.col(column).isNull() | (F.trim(column) == "")
    return j.withColumn(column, F.when(empty, F.coalesce("_value", column)).otherwise(F.col(column))).drop("_key", "_value")


def update_from(df: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """Sets the column where an update has a value."""
    u = updates.select(F.col(key).alias("_key"), F.col(column).alias("_value"))
    return df.join(u, df[key] == u["_key"], "left").withColumn(column, F.coalesce("_value", column)).drop("_key", "_value")


def row_id(*columns: Column) -> Column:
    """16 hex digits of the SHA-1 of the values between bars."""
    return F.substring(F.sha1(F.concat_ws("|", *[c.cast("string") for c in columns])), 1, 16)


def audit_replace(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same keys; every row gets its id."""
    kept = old.join(new.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(new).withColumn("id", row_id(*[F.col(k) for k in keys]))


def canonical_row(df: DataFrame) -> DataFrame:
    """Per acronym: best rank, has a field of research, longest title, earliest line."""
    rank = F.array_position(F.array(*[F.lit(r) for r in RANKS]), F.coalesce("rank", F.lit("")))
    order = [F.when(rank == 0, 99).otherwise(rank).asc(), F.col("primary_for").isNull().asc(), F.length("title").desc(), F.col("line_no").asc()]
    return _one(df, ["acronym"], *order)


def classify_groups(df: DataFrame) -> DataFrame:
    """Per acronym: single, exact-duplicate, variant (equal titles by fingerprint) or ambiguous."""
    fp = X.title_fingerprint(F.col("title"))
    per = df.groupBy("acronym").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(fp).alias("titles"), F.count_distinct(F.struct("title", "rank", "primary_for")).alias("variants"))
    kind = F.when(F.col("n") == 1, "single").when(F.col("titles") > 1, "ambiguous").when(F.col("variants") > 1, "variant").otherwise("exact-duplicate")
    return per.withColumn("status", kind)


def merge_sources(sources: list[DataFrame], identity: list[str], candidates: str) -> DataFrame:
    """One row per identity: first value that is not blank per column, candidates in order without repeats.

    Every source has a ``line_no``; earlier sources win.
    """
    parts = [s.withColumn("_source", F.lit(k)) for k, s in enumerate(sources)]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    seq = F.struct("_source", "line_no")
    rest = [c for c in df.columns if c not in (*identity, "_source", "line_no")]
    first = [F.min_by(F.when(F.trim(c) != "", F.col(c)), F.when(F.trim(c) != "", seq)).alias(c) for c in rest if c != candidates]
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_source", "line_no", candidates))), lambda x: F.trim(x[candidates]))
    both = F.array_join(F.array_sort(F.collect_set("_source")), "+").alias("sources")
    return df.groupBy(*identity).agg(*first, F.array_distinct(F.filter(listed, lambda x: x != "")).alias(candidates), both)


def valid_candidate(candidates: Column, valid: Column) -> Column:
    """First candidate that is valid, and whether there were only invalid ones."""
    good = F.filter(candidates, lambda x: F.array_contains(valid, x))
    return F.struct(F.get(good, 0).alias("value"), ((F.size(candidates) > 0) & (F.size(good) == 0)).alias("only_invalid"))


def in_domain(c: Column, domain: list[str]) -> Column:
    return F.when(c.isin(domain), c)


def load_facts(papers: DataFrame, venue_map: DataFrame, venue: str, key: str) -> DataFrame:
    """Papers with the id that their venue's name maps to, or null."""
    m = venue_map.select(F.col("name").alias("_name"), F.col("venue_id").alias(key))
    return papers.join(m, X.clean_text(F.col(venue)) == m["_name"], "left").drop("_name")


def all_facts(sources: dict[str, tuple[DataFrame, DataFrame, str, str]]) -> DataFrame:
    """Papers of every kind in one table with their kind and the venue's id, null in the other kinds' columns.

    sources: kind to (papers, venue map, column of the venue's name, column of the id).
    """
    parts = [load_facts(papers, m, venue, key).drop(venue).withColumn("type", F.lit(kind)) for kind, (papers, m, venue, key) in sources.items()]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def renumbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``line_no``: dense numbers from 2 on, as lines under a header. For lookups of a few thousand rows: one task orders them."""
    return rows.withColumn("line_no", F.row_number().over(Window.orderBy(*order)) + 1)


def ordered_dedup(explicit: DataFrame, derived: DataFrame, key: str) -> DataFrame:
    """Rows of both without repeats of the key; explicit rows come before derived ones."""
    both = explicit.withColumn("_p", F.lit(0)).unionByName(derived.withColumn("_p", F.lit(1)))
    return first_wins(both, [key], "_p").drop("_p")


def resolve_links(links: DataFrame, papers: DataFrame, authors: DataFrame) -> DataFrame:
    """(raw_id, author_name, author_order) to ids; links that lack either end go, and the first of equal pairs stays."""
    j = links.join(papers.select("raw_id", "paper_id"), "raw_id").join(authors.select(F.col("name_exact").alias("author_name"), "author_id"), "author_name")
    return first_wins(j.select("paper_id", "author_id", "author_order"), ["paper_id", "author_id"], "author_order")


def override(persistent: DataFrame, manual: DataFrame, key: str) -> DataFrame:
    """Both sets of overrides; manual ones win."""
    both = persistent.withColumn("_p", F.lit(0)).unionByName(manual.withColumn("_p", F.lit(1)))
    return _one(both, [key], F.desc("_p")).drop("_p")


def distinct_union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()


def latest_batch(names: DataFrame, column: str = "name") -> DataFrame:
    """The greatest by (date, number) as written in the name."""
    c = F.col(column)
    key = F.struct(F.regexp_extract(c, r"(\d{4}-\d{2}-\d{2})", 1), F.coalesce(F.regexp_extract(c, r"batch[-_]?(\d+)", 1).try_cast("int"), F.lit(0)))
    return names.agg(F.max_by(c, key).alias(column))
