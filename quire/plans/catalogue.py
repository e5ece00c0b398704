"""Every query of the engine on the driver's tables, with the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import etl, matching, search, views
from quire.plans.proxy import SQL as P
from quire.plans.proxy import Roles
from quire.streaming.rate_limit import over_limit

_ENTRIES: dict[str, tuple[Callable[[Roles], DataFrame], str | None]] = {}


def add(name: str, run: Callable[[Roles], DataFrame], sql: str | None) -> None:
    _ENTRIES[name] = run, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=run: f(Roles(spark, sf_dir))) for name, (run, _) in _ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ENTRIES.items() if sql}


# --- views ---------------------------------------------------------------------------

add("view_paper_author_count", lambda r: views.paper_author_count(r.links), P + "SELECT paper_id, author_count FROM pac")

_YEARLY = "SELECT p.{k}, p.year, count(DISTINCT p.paper_id) AS paper_count, count(*) AS total_author_slots, avg(c.author_count) AS avg_authors_per_paper, count(DISTINCT l.author_id) AS distinct_authors FROM papers p JOIN links l USING (paper_id) JOIN pac c USING (paper_id) WHERE p.{k} IS NOT NULL GROUP BY 1, 2"
add("view_conf_yearly", lambda r: views.venue_yearly(r.papers, r.links, "conf_id"), P + _YEARLY.format(k="conf_id"))
add("view_journal_yearly", lambda r: views.venue_yearly(r.papers, r.links, "journal_id"), P + _YEARLY.format(k="journal_id"))

_PROFILE = (
    "SELECT v.{k}, v.title, {c}, count(DISTINCT p.paper_id) AS total_papers, min(p.year) AS first_year, max(p.year) AS last_year, count(DISTINCT p.year) AS active_years, "
    "count(l.author_id) AS total_author_slots, round(avg(c.author_count), 2) AS avg_authors_per_paper, count(DISTINCT l.author_id) AS distinct_authors, "
    "round(count(DISTINCT p.paper_id) / nullif(count(DISTINCT p.year), 0), 2) AS avg_papers_per_year FROM {t} v LEFT JOIN papers p ON p.{k} = v.{k} LEFT JOIN links l USING (paper_id) LEFT JOIN pac c USING (paper_id) GROUP BY ALL"
)
add("view_conf_profile", lambda r: views.venue_profile(r.conferences.select("conf_id", "title", "rank"), r.papers, r.links, "conf_id"), P + _PROFILE.format(k="conf_id", c="v.rank", t="conferences"))
add("view_journal_profile", lambda r: views.venue_profile(r.journals.select("journal_id", "title", "best_quartile"), r.papers, r.links, "journal_id"), P + _PROFILE.format(k="journal_id", c="v.best_quartile", t="journals"))
add("view_author_profile", lambda r: views.author_profile(r.authors, r.papers, r.links), P + "SELECT a.author_id, a.name, count(*) AS total_papers, min(year) AS first_year, max(year) AS last_year, count(DISTINCT year) AS active_years, count(*) FILTER (type = 'conference') AS conference_papers, count(*) FILTER (type = 'journal') AS journal_papers FROM authors a JOIN links USING (author_id) JOIN papers USING (paper_id) GROUP BY 1, 2")
add("view_author_yearly", lambda r: views.author_yearly(r.papers, r.links), P + "SELECT author_id, year, type, count(*) AS paper_count FROM links JOIN papers USING (paper_id) GROUP BY ALL")
add("view_year_profile", lambda r: views.year_profile(r.papers, r.links), P + "SELECT year, count(DISTINCT p.paper_id) AS total_papers, count(DISTINCT conf_id) AS distinct_conferences, count(DISTINCT journal_id) AS distinct_journals, count(DISTINCT author_id) AS distinct_authors, count(author_id) AS total_author_slots FROM papers p LEFT JOIN links USING (paper_id) GROUP BY 1")
_QS = ", ".join(f"sum((best_quartile = 'Q{k}')::INTEGER)::BIGINT AS q{k}_count" for k in range(1, 5))
add("view_publisher_stats", lambda r: views.publisher_stats(r.journals), P + f"SELECT publisher, count(*) AS journal_count, {_QS} FROM journals WHERE publisher IS NOT NULL GROUP BY 1")
_CAT = "SELECT {c}, description, year, count(DISTINCT paper_id) AS paper_count, count(DISTINCT p.{k}) AS venue_count FROM papers p JOIN {t} USING ({k}) JOIN {d} USING ({c}) GROUP BY 1, 2, 3"
add("view_cat_yearly_conf", lambda r: views.category_yearly(r.papers, r.conferences, r.categories, "conf_id", "primary_for"), P + _CAT.format(c="primary_for", k="conf_id", t="conferences", d="categories"))
_AREAS = ", areas AS (SELECT DISTINCT p_type AS area, upper(p_type) AS description FROM part) "
add("view_cat_yearly_journal", lambda r: views.category_yearly(r.papers, r.journals, r.journals.select("area", F.upper("area").alias("description")).distinct(), "journal_id", "area"), P + _AREAS + _CAT.format(c="area", k="journal_id", t="journals", d="areas"))
add(
    "category_nested",
    lambda r: views.nested_by_category(views.category_yearly(r.papers, r.conferences, r.categories, "conf_id", "primary_for"), "primary_for").select("primary_for", "description", F.posexplode("yearly_data").alias("pos", "x")).select("primary_for", "description", "pos", "x.year", "x.paper_count"),
    P + ", y AS (" + _CAT.format(c="primary_for", k="conf_id", t="conferences", d="categories") + ") SELECT primary_for, description, (row_number() OVER (PARTITION BY primary_for ORDER BY year) - 1)::INTEGER AS pos, year, paper_count FROM y",
)

# --- charts and aggregates -----------------------------------------------------------

_QC = ", ".join(f"count(*) FILTER (best_quartile = 'Q{k}') AS q{k}_count" for k in range(1, 5))
add("chart_publishers_bar", lambda r: views.publisher_bar(r.journals), P + f"SELECT publisher, count(*) AS journal_count, {_QC} FROM journals WHERE publisher IS NOT NULL AND publisher != '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
add("author_yearly_split", lambda r: views.author_yearly_split(r.papers, r.links, 5), P + "SELECT year, count(*) AS total, count(*) FILTER (type = 'conference') AS conference, count(*) FILTER (type = 'journal') AS journal FROM links JOIN papers USING (paper_id) WHERE author_id = 5 GROUP BY 1")
add("chart_overview", lambda r: views.yearly_totals(r.papers), P + "SELECT year, count(*) AS paper_count FROM papers WHERE year BETWEEN 1900 AND year(current_date) GROUP BY 1")
add("stats_overview", lambda r: views.global_counts(papers=r.papers, authors=r.authors, conferences=r.conferences, journals=r.journals), P + "SELECT (SELECT count(*) FROM papers) AS total_papers, (SELECT count(*) FROM authors) AS total_authors, (SELECT count(*) FROM conferences) AS total_conferences, (SELECT count(*) FROM journals) AS total_journals")
add("dup_identities", lambda r: views.duplicate_identities(r.table("lineitem"), "l_orderkey", "l_suppkey"), "SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
add("ordered_listagg", lambda r: views.ordered_list(r.links.withColumn("k", F.col("author_order") * 100000 + F.col("author_id")), "paper_id", "k", "author_id"), P + "SELECT paper_id, string_agg(author_id::VARCHAR, ',' ORDER BY author_order * 100000 + author_id) AS listed FROM links GROUP BY 1")
add("venue_frequency", lambda r: views.frequency(r.papers.join(r.conferences.select("conf_id", F.col("title").alias("venue")), "conf_id"), "venue"), P + "SELECT c.title AS venue, count(*) AS n FROM papers JOIN conferences c USING (conf_id) GROUP BY 1")
add("mode_per_group", lambda r: views.mode_per_group(r.papers.withColumn("p", F.substring("title", 1, 1)), "year", "p", "paper_id"), P + ", g AS (SELECT year, title[1:1] AS p, count(*) AS n, min(paper_id) AS s FROM papers GROUP BY 1, 2) SELECT year, arg_max(p, (n, -s)) AS mode, max(n) AS n FROM g GROUP BY 1")
add("topk_per_group", lambda r: views.top_per_group(r.papers.filter("conf_id IS NOT NULL"), "year", "conf_id", "paper_id", 5), P + ", g AS (SELECT year, conf_id, count(*) AS n, min(paper_id) AS s FROM papers WHERE conf_id IS NOT NULL GROUP BY 1, 2) SELECT year, conf_id, n, row_number() OVER (PARTITION BY year ORDER BY n DESC, s)::INTEGER AS place FROM g QUALIFY place <= 5")
add("pearson", lambda r: views.pearson(r.table("part"), "p_size", "p_retailprice").select("n", F.round("r", 9).alias("r"), F.round("mean_x", 6).alias("mean_x"), "min_x", "max_x", "min_y", "max_y"), "SELECT count(*) AS n, round(corr(p_size, p_retailprice), 9) AS r, round(avg(p_size), 6) AS mean_x, min(p_size)::DOUBLE AS min_x, max(p_size)::DOUBLE AS max_x, min(p_retailprice) AS min_y, max(p_retailprice) AS max_y FROM part")
add("axis_domain", lambda r: views.axis_domain(views.venue_yearly(r.papers, r.links, "conf_id"), "paper_count", "distinct_authors"), P + ", y AS (" + _YEARLY.format(k="conf_id") + ") SELECT max(greatest(paper_count::DOUBLE, distinct_authors::DOUBLE)) * 1.1::DOUBLE AS domain_max FROM y")
add("busiest_venue", lambda r: views.busiest(r.papers, "conf_id"), P + "SELECT conf_id, count(*) AS n FROM papers WHERE conf_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
add(
    "validation_checks",
    lambda r: views.validation_checks(r.papers.withColumn("raw_id", F.col("paper_id") % 1000), r.links, r.authors.filter("author_id % 10 != 0"), ["raw_id"], {"papers_total": 5}),
    P + """, a AS (SELECT * FROM authors WHERE author_id % 10 != 0), d AS (SELECT (count(*) - count(DISTINCT (type, paper_id % 1000)))::BIGINT AS n FROM papers),
 c AS (SELECT CASE WHEN (SELECT n FROM d) > 0 THEN 1 ELSE 0 END::BIGINT AS papers_not_unique, (SELECT n FROM d) AS duplicate_papers, (SELECT count(*) FROM links WHERE paper_id NOT IN (SELECT paper_id FROM papers)) AS links_without_paper,
 (SELECT count(*) FROM links WHERE author_id NOT IN (SELECT author_id FROM a)) AS links_without_author, count(*) AS papers_total, count(*) FILTER (type = 'conference') AS papers_conference, count(*) FILTER (type = 'journal') AS papers_journal,
 (SELECT count(*) FROM a) AS authors, (SELECT count(*) FROM links) AS paper_authors, count(*) FILTER (type = 'conference' AND conf_id IS NOT NULL) AS matched_conference_rows, count(*) FILTER (type = 'conference' AND conf_id IS NULL) AS unmatched_conference_rows,
 count(*) FILTER (type = 'journal' AND journal_id IS NOT NULL) AS matched_journal_rows, count(*) FILTER (type = 'journal' AND journal_id IS NULL) AS unmatched_journal_rows FROM papers),
u AS (UNPIVOT c ON COLUMNS(*) INTO NAME check_name VALUE actual), w AS (SELECT *, CASE WHEN check_name = 'papers_total' THEN 5 WHEN check_name IN ('papers_not_unique', 'duplicate_papers', 'links_without_paper', 'links_without_author') THEN 0 END::BIGINT AS expected FROM u)
SELECT *, coalesce(actual = expected, TRUE) AS ok FROM w""",
)

# --- API shapes ----------------------------------------------------------------------

add("venue_papers_page", lambda r: search.page_of(search.year_range(r.papers.filter("conf_id = 7"), 1994, 1997), [F.desc("year"), "title", "paper_id"], 1, 20).select("paper_id", "title", "year"), P + "SELECT paper_id, title, year FROM papers WHERE conf_id = 7 AND year BETWEEN 1994 AND 1997 ORDER BY year DESC, title, paper_id LIMIT 20")
add("venue_list_page", lambda r: search.page_of(r.conferences, ["title", "conf_id"], 2, 50), P + "SELECT * FROM conferences ORDER BY title, conf_id LIMIT 50 OFFSET 50")
add("venue_papers_count", lambda r: r.papers.filter("conf_id = 7").agg(F.count(F.lit(1)).alias("total")), P + "SELECT count(*) AS total FROM papers WHERE conf_id = 7")
add("year_range_swapped", lambda r: search.year_range(r.papers, 1997, 1995, swap=True).groupBy("year").agg(F.count(F.lit(1)).alias("n")), P + "SELECT year, count(*) AS n FROM papers WHERE year BETWEEN 1995 AND 1997 GROUP BY 1")
add("venue_top_authors", lambda r: search.top_authors(r.papers, r.links, r.authors, "conf_id", 7), P + "SELECT author_id, name, count(*) AS paper_count FROM papers JOIN links USING (paper_id) JOIN authors USING (author_id) WHERE conf_id = 7 GROUP BY 1, 2 ORDER BY 3 DESC, 2, 1 LIMIT 10")
add("journal_top_authors", lambda r: search.top_authors(r.papers, r.links, r.authors, "journal_id", 11, 1000), P + "SELECT author_id, name, count(*) AS paper_count FROM papers JOIN links USING (paper_id) JOIN authors USING (author_id) WHERE journal_id = 11 GROUP BY 1, 2 ORDER BY 3 DESC, 2, 1 LIMIT 100")
_NAMES = "LEFT JOIN conferences c ON p.conf_id = c.conf_id LEFT JOIN journals j ON p.journal_id = j.journal_id"
add("author_papers_page", lambda r: search.page_of(search.author_papers(r.papers, r.links, r.conferences, r.journals, 5), [F.desc("year"), "title", "paper_id"], 2, 10).select("paper_id", "title", "year", "author_order", "venue"), P + f"SELECT p.paper_id, p.title, p.year, l.author_order, coalesce(c.title, j.title) AS venue FROM papers p JOIN links l USING (paper_id) {_NAMES} WHERE l.author_id = 5 ORDER BY p.year DESC, p.title, p.paper_id LIMIT 10 OFFSET 10")
add("year_papers_filtered", lambda r: search.page_of(search.year_papers(r.papers, r.links, 1996, author=5), ["title", "paper_id"], 1, 50).select("paper_id", "title", "conf_id", "journal_id"), P + "SELECT paper_id, title, conf_id, journal_id FROM papers WHERE year = 1996 AND paper_id IN (SELECT paper_id FROM links WHERE author_id = 5) ORDER BY title, paper_id LIMIT 50")
add("year_papers_both_venues", lambda r: search.year_papers(r.papers, r.links, 1996, conf_id=7, journal_id=8).select("paper_id"), P + "SELECT paper_id FROM papers WHERE year = 1996 AND conf_id = 7 AND journal_id = 8")
add("year_profile_one", lambda r: views.year_profile(r.papers.filter("year = 1996"), r.links), P + "SELECT year, count(DISTINCT p.paper_id) AS total_papers, count(DISTINCT conf_id) AS distinct_conferences, count(DISTINCT journal_id) AS distinct_journals, count(DISTINCT author_id) AS distinct_authors, count(author_id) AS total_author_slots FROM papers p LEFT JOIN links USING (paper_id) WHERE year = 1996 GROUP BY 1")
add("venues_bar", lambda r: search.venues_bar(views.venue_profile(r.conferences.select("conf_id", "title").filter(F.col("conf_id").isin(*search.parse_ids("1,2,x,7,9"))), r.papers, r.links, "conf_id"), "conf_id", [1, 2, 7, 9]), P + ", v AS (" + _PROFILE.format(k="conf_id", c="v.rank", t="conferences") + ") SELECT conf_id, title, total_papers, round(coalesce(avg_authors_per_paper * avg_papers_per_year, 0), 1) AS score FROM v WHERE conf_id IN (1, 2, 7, 9)")
add("scatter_metrics", lambda r: search.metrics_scatter(r.journals), P + "SELECT journal_id, title, sjr_index, h_index FROM journals WHERE sjr_index IS NOT NULL AND h_index IS NOT NULL ORDER BY sjr_index DESC, journal_id LIMIT 500")
add("category_selected", lambda r: views.category_yearly(r.papers, r.conferences.filter(F.col("primary_for").isin(*search.parse_ids("3,4"))), r.categories, "conf_id", "primary_for"), P + ", y AS (" + _CAT.format(c="primary_for", k="conf_id", t="conferences", d="categories") + ") SELECT * FROM y WHERE primary_for IN (3, 4)")
add("category_list", lambda r: r.conferences.select("primary_for").distinct().join(r.categories, "primary_for"), P + "SELECT DISTINCT primary_for, description FROM conferences JOIN categories USING (primary_for)")


def _prefix_sql(table: str, column: str, terms: list[str], columns: str) -> str:
    words = f"regexp_split_to_array(lower(strip_accents({column})), " + r"'[^\p{L}\p{N}_]+')"
    return f"SELECT {columns} FROM {table} WHERE " + " AND ".join(f"len(list_filter({words}, lambda w: starts_with(w, '{t}'))) > 0" for t in terms)


add("conf_search", lambda r: search.venue_search(r.conferences, r.papers, "conf_id", "custom 00000", ["title"], {"rank": "BUILDING"}).select("conf_id", "title", "has_coverage"), P + _prefix_sql("conferences", "title", ["custom", "00000"], "conf_id, title, conf_id IN (SELECT conf_id FROM papers WHERE conf_id IS NOT NULL) AS has_coverage") + " AND rank = 'BUILDING'")
add("journal_search", lambda r: search.venue_search(r.journals, r.papers, "journal_id", "wid re", ["title"], {"best_quartile": "Q1", "publisher": "brand#1"}, covered=True).select("journal_id", "title", "has_coverage"), P + _prefix_sql("journals", "title", ["wid", "re"], "journal_id, title, true AS has_coverage") + " AND best_quartile = 'Q1' AND contains(lower(publisher), 'brand#1') AND journal_id IN (SELECT journal_id FROM papers)")
add("author_search", lambda r: search.text_search(r.authors, "SUPPLIER 00000", "name").orderBy("name", "author_id").limit(15), P + _prefix_sql("authors", "name", ["supplier", "00000"], "author_id, name") + " ORDER BY name, author_id LIMIT 15")
add("short_search", lambda r: search.text_search(r.journals, "in!", "title").groupBy("title").agg(F.count(F.lit(1)).alias("n")), P + "SELECT title, count(*) AS n FROM journals WHERE contains(lower(title), 'in') GROUP BY 1")
add("paper_search", lambda r: search.page_of(search.with_venue_names(search.text_search(r.papers, "medium 12", "title"), r.conferences, r.journals), [F.desc("year"), "title", "paper_id"], 1, 25).select("paper_id", "title", "year", "venue"), P + _prefix_sql(f"papers p {_NAMES}", "p.title", ["medium", "12"], "p.paper_id, p.title, p.year, coalesce(c.title, j.title) AS venue") + " ORDER BY p.year DESC, p.title, p.paper_id LIMIT 25")
add("text_search_accents", lambda r: search.text_search(r.table("documents"), "meñt élle", "text").select("doc_id"), _prefix_sql("documents", "text", ["ment", "elle"], "doc_id"))
add("coverage_semi", lambda r: search.only_covered(r.conferences, r.papers, "conf_id"), P + "SELECT * FROM conferences WHERE EXISTS (SELECT 1 FROM papers p WHERE p.conf_id = conferences.conf_id)")
add("coverage_flag", lambda r: search.with_coverage(r.journals, r.papers, "journal_id").select("journal_id", "has_coverage"), P + "SELECT journal_id, journal_id IN (SELECT journal_id FROM papers WHERE journal_id IS NOT NULL) AS has_coverage FROM journals")

# --- loading -------------------------------------------------------------------------

add("required_fields", lambda r: etl.skipped_rows(r.table("orders").select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).otherwise("  ").alias("title"), F.col("o_orderstatus").alias("venue"), F.when(F.col("o_orderkey") % 5 != 0, F.year("o_orderdate").cast("string")).otherwise("19x5").alias("year")), "venue"), "SELECT count(*) FILTER (o_orderkey % 7 != 0 AND o_orderkey % 5 != 0) AS kept, count(*) FILTER (o_orderkey % 7 = 0 OR o_orderkey % 5 = 0) AS skipped FROM orders")
_RAW = ", raw AS (SELECT paper_id, string_agg(name, ' | ' ORDER BY author_order, author_id) AS author FROM links JOIN authors USING (author_id) GROUP BY 1)"


def _raw_authors(r: Roles) -> DataFrame:
    named = r.links.join(r.authors, "author_id").withColumn("k", F.struct("author_order", "author_id"))
    return views.ordered_list(named, "paper_id", "k", "name", " | ").select(F.col("paper_id").alias("id"), F.col("listed").alias("author"))


add("author_split", lambda r: etl.author_links(_raw_authors(r)), P + _RAW + "SELECT paper_id, trim(u.name) AS author_name, u.k::INTEGER AS author_order FROM raw, unnest(string_split(author, '|')) WITH ORDINALITY AS u(name, k)")
add("anti_missing", lambda r: etl.missing(r.authors.withColumn("name", F.upper("name")), r.authors.filter("author_id % 3 = 0"), "name").select("author_id"), P + "SELECT author_id FROM authors WHERE author_id % 3 != 0")
add("fact_venue_map", lambda r: etl.load_facts(r.papers.join(r.conferences.select("conf_id", F.col("title").alias("booktitle")), "conf_id", "left").drop("conf_id"), r.conferences.filter("conf_id % 2 = 0").select(F.col("title").alias("name"), F.col("conf_id").alias("venue_id")), "booktitle", "conf_id").select("paper_id", "conf_id"), P + "SELECT paper_id, CASE WHEN conf_id % 2 = 0 THEN conf_id END AS conf_id FROM papers")
add("link_resolution", lambda r: etl.resolve_links(r.table("lineitem").join(r.authors, F.col("l_suppkey") == F.col("author_id")).select(F.col("l_orderkey").cast("string").alias("raw_id"), F.col("name").alias("author_name"), F.col("l_linenumber").alias("author_order")), r.papers.filter("type = 'journal'").select(F.col("paper_id").cast("string").alias("raw_id"), "paper_id"), r.authors.select(F.col("name").alias("name_exact"), "author_id")), P + "SELECT paper_id, author_id, author_order FROM links JOIN papers USING (paper_id) WHERE type = 'journal'")
add("insert_ignore", lambda r: etl.insert_ignore(r.authors.filter("author_id < 20"), r.authors.withColumn("name", F.concat("name", F.lit("+"))), ["author_id"], "name"), P + "SELECT author_id, CASE WHEN author_id < 20 THEN name ELSE name || '+' END AS name FROM authors")
_UPSERT = ", n AS (SELECT l_orderkey AS k, max(l_linenumber) AS y, min(l_linenumber) AS f FROM lineitem GROUP BY 1), o AS (SELECT paper_id, year FROM papers WHERE conf_id IS NOT NULL), m AS (SELECT coalesce(max(paper_id), 0) AS top FROM o) "
add(
    "upsert_last_wins",  # papers of one status are there, all lines are new
    lambda r: etl.upsert(r.papers.filter("conf_id IS NOT NULL").select(F.col("paper_id").alias("id"), F.col("paper_id").cast("string").alias("raw_id"), "year"), r.table("lineitem").select(F.col("l_orderkey").cast("string").alias("raw_id"), F.col("l_linenumber").alias("year")), ["raw_id"], "year", ["year"], "id"),
    P + _UPSERT + "SELECT paper_id AS id, paper_id::VARCHAR AS raw_id, coalesce(y, year) AS year FROM o LEFT JOIN n ON paper_id = k UNION ALL SELECT top + row_number() OVER (ORDER BY f, k::VARCHAR), k::VARCHAR, y FROM n, m WHERE k NOT IN (SELECT paper_id FROM o)",
)
add("backfill_where_null", lambda r: etl.backfill(r.journals.select("journal_id", "best_quartile"), r.journals.filter("journal_id % 2 = 0").select("journal_id", F.lit("Q9").alias("best_quartile")), "journal_id", "best_quartile"), P + "SELECT journal_id, CASE WHEN best_quartile IS NULL AND journal_id % 2 = 0 THEN 'Q9' ELSE best_quartile END AS best_quartile FROM journals")
add("update_by_join", lambda r: etl.update_from(r.papers.select("paper_id", "journal_id"), r.papers.filter("paper_id % 4 = 0").select("paper_id", (F.col("paper_id") + 1).alias("journal_id")), "paper_id", "journal_id"), P + "SELECT paper_id, CASE WHEN paper_id % 4 = 0 THEN paper_id + 1 ELSE journal_id END AS journal_id FROM papers")
add("audit_replace", lambda r: etl.audit_replace(r.conferences.select(F.lit("2026-01-01").alias("run_date"), F.col("title").alias("normalized_name"), F.lit("old").alias("stage")), r.conferences.filter("conf_id % 3 = 0").select(F.lit("2026-01-01").alias("run_date"), F.col("title").alias("normalized_name"), F.lit("new").alias("stage")), ["run_date", "normalized_name"]), P + "SELECT '2026-01-01' AS run_date, title AS normalized_name, CASE WHEN conf_id % 3 = 0 THEN 'new' ELSE 'old' END AS stage, sha1('2026-01-01|' || title)[1:16] AS id FROM conferences")


def _ranked_rows(r: Roles) -> DataFrame:
    return r.conferences.select((F.col("conf_id") % 40).cast("string").alias("acronym"), "title", F.element_at(F.array(*[F.lit(x) for x in ("A", "B", "C", "A*", "zz")]), (F.col("conf_id") % 5 + 1).cast("int")).alias("rank"), F.when(F.col("primary_for") > 5, F.col("primary_for")).alias("primary_for"), F.col("conf_id").alias("line_no"))


_RR = ", rr AS (SELECT (conf_id % 40)::VARCHAR AS acronym, title, ['A', 'B', 'C', 'A*', 'zz'][conf_id % 5 + 1] AS rank, CASE WHEN primary_for > 5 THEN primary_for END AS primary_for, conf_id AS line_no FROM conferences) "
add("canonical_row", lambda r: etl.canonical_row(_ranked_rows(r)), P + _RR + "SELECT * FROM rr QUALIFY row_number() OVER (PARTITION BY acronym ORDER BY CASE rank WHEN 'A*' THEN 1 WHEN 'A' THEN 2 WHEN 'B' THEN 3 WHEN 'C' THEN 4 ELSE 99 END, primary_for IS NULL, length(title) DESC, line_no) = 1")
add("group_classification", lambda r: etl.classify_groups(_ranked_rows(r).withColumn("acronym", (F.col("line_no") % 900).cast("string")).withColumn("title", F.concat(F.lit("Int. Conf. "), (F.col("line_no") % 450).cast("string")))), P + _RR + ", s AS (SELECT (line_no % 900)::VARCHAR AS acronym, line_no % 450 AS t, rank, primary_for FROM rr) SELECT acronym, count(*) AS n, count(DISTINCT t) AS titles, count(DISTINCT (t, rank, primary_for)) AS variants, CASE WHEN count(*) = 1 THEN 'single' WHEN count(DISTINCT t) > 1 THEN 'ambiguous' WHEN count(DISTINCT (t, rank, primary_for)) > 1 THEN 'variant' ELSE 'exact-duplicate' END AS status FROM s GROUP BY 1")
add(
    "merge_sources",
    lambda r: etl.merge_sources([x.select(F.col("title").alias("acronym"), F.when(F.col("conf_id") % 4 != 0, F.col("rank")).otherwise(" ").alias("rank"), F.lit(code).alias("code"), F.col("conf_id").alias("line_no")) for x, code in ((r.conferences, " c1 "), (r.conferences.filter("conf_id % 3 = 0"), " c3 "))], ["acronym"], "code").select("acronym", "rank", F.array_join("code", ",").alias("code"), "sources"),
    P + "SELECT title AS acronym, CASE WHEN conf_id % 4 != 0 THEN rank END AS rank, CASE WHEN conf_id % 3 = 0 THEN 'c1,c3' ELSE 'c1' END AS code, CASE WHEN conf_id % 3 = 0 THEN '0+1' ELSE '0' END AS sources FROM conferences",
)
add("override_precedence", lambda r: etl.override(r.conferences.select("title", F.lit("memory").alias("action")), r.conferences.filter("conf_id % 5 = 0").select("title", F.lit("manual").alias("action")), "title"), P + "SELECT title, CASE WHEN conf_id % 5 = 0 THEN 'manual' ELSE 'memory' END AS action FROM conferences")
add("distinct_union", lambda r: etl.distinct_union(r.authors.select("name"), r.authors.filter("author_id > 3").select("name")), P + "SELECT name FROM authors GROUP BY 1")

# --- scalar functions ----------------------------------------------------------------

_FOLD = "strip_accents(coalesce({c}, ''))"
_CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(lower(strip_accents({c})), 'ß', 'ss'), '&', ' and '), '[/-]', ' ', 'g'), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_WHOLE = "coalesce(text, '')"
add("ascii_fold", lambda r: r.table("documents").select("doc_id", X.ascii_fold(F.col("text")).alias("folded")), "SELECT doc_id, " + _FOLD.format(c="text") + " AS folded FROM documents")
add("clean_for_match", lambda r: r.table("documents").select("doc_id", X.clean_for_match(F.col("text")).alias("cleaned")), "SELECT doc_id, " + _CLEAN.format(c=_WHOLE) + " AS cleaned FROM documents")
add("compact_key", lambda r: r.table("documents").select("doc_id", X.compact_key(F.col("text")).alias("k"), X.hyphen_key(F.col("text")).alias("h")), "WITH c AS (SELECT doc_id, " + _CLEAN.format(c=_WHOLE) + " AS c FROM documents) SELECT doc_id, regexp_replace(c, '[^a-z0-9]', '', 'g') AS k, array_to_string(regexp_extract_all(c, '[a-z0-9]+'), '-') AS h FROM c")
add("abbrev_expand", lambda r: r.table("part").select("p_partkey", X.expand_journal_abbreviations(F.concat_ws(" ", F.lit("Trans Int J"), "p_name", F.lit("Syst"))).alias("expanded")), "SELECT p_partkey, 'transactions international journal ' || p_name || ' systems' AS expanded FROM part")
add("initialisms", lambda r: r.table("part").select("p_partkey", F.array_join(X.derived_initialisms(F.concat_ws(" ", F.lit("ACM Conference on the"), "p_name")), ",").alias("found")), "WITH w AS (SELECT p_partkey, regexp_extract_all(lower(p_name), '[a-z0-9]+') AS ws FROM part), i AS (SELECT p_partkey, array_to_string(list_transform(ws, lambda x: x[1:1]), '') AS s, len(ws) AS n FROM w) SELECT p_partkey, CASE WHEN n >= 1 THEN 'ac' || s || ',c' || s ELSE '' END AS found FROM i")
add("acronyms", lambda r: r.table("part").select("p_partkey", F.array_join(X.acronym_candidates(F.concat(F.lit("HLT-NAACL "), "p_type", F.lit(" x Yz"))), ",").alias("found")), "SELECT p_partkey, array_to_string(list_sort(list_distinct(['hltnaacl', 'hlt', 'naacl', lower(p_type)])), ',') AS found FROM part")
add("issn_norm", lambda r: r.table("part").select("p_partkey", X.normalize_issn(F.concat(F.lit("1-"), F.col("p_partkey").cast("string"), F.lit("-123x "))).alias("issn")), "SELECT p_partkey, '1' || p_partkey || '123X' AS issn FROM part")
add("series_key", lambda r: r.table("part").select("p_partkey", X.series_key(F.concat_ws("/", F.lit("/conf"), "p_type", "p_name")).alias("k"), X.canonical_venue_id(F.concat_ws("/", F.lit("conf"), "p_type", "p_name")).alias("v")), "SELECT p_partkey, 'conf/' || p_type AS k, 'dblp-conf-' || array_to_string(regexp_extract_all(lower(p_type), '[a-z0-9]+'), '-') AS v FROM part")
add("year_parse", lambda r: r.table("orders").select("o_orderkey", X.clean_year(F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" "), F.year("o_orderdate").cast("string"))).otherwise(F.col("o_orderkey").cast("string"))).alias("y")), "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN year(o_orderdate)::INTEGER WHEN length(o_orderkey::VARCHAR) = 4 THEN o_orderkey::INTEGER END AS y FROM orders")
add("safe_numeric", lambda r: r.table("part").select("p_partkey", X.safe_decimal(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit(",25"))).otherwise("n/a")).cast("double").alias("d"), X.safe_int(F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).otherwise("x")).alias("i")), "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size + 0.25::DOUBLE END AS d, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS i FROM part")
add("domain_whitelist", lambda r: _ranked_rows(r).select("line_no", etl.in_domain(F.col("rank"), etl.RANKS).alias("rank")), P + _RR + "SELECT line_no, CASE WHEN rank IN ('A*', 'A', 'B', 'C') THEN rank END AS rank FROM rr")
add("row_hash", lambda r: r.conferences.select("conf_id", etl.row_id(F.col("title"), F.col("rank")).alias("id"), F.substring(F.sha2("title", 256), 1, 16).alias("fingerprint")), P + "SELECT conf_id, sha1(title || '|' || rank)[1:16] AS id, sha256(title)[1:16] AS fingerprint FROM conferences")
add("match_stage", lambda r: r.table("part").select("p_partkey", X.match_stage(F.element_at(F.array(*[F.lit(x) for x in ("manual-skip", "exact-title", "segment-acronym", "openalex-issn", "dblp-api", "")]), (F.col("p_partkey") % 6 + 1).cast("int"))).alias("stage")), "SELECT p_partkey, ['explicit skip / non_venue', 'exact normalized local match', 'parent-series / variant stripping', 'OpenAlex', 'DBLP online fallback', 'conservative fuzzy fallback'][p_partkey % 6 + 1] AS stage FROM part")

# --- matching ------------------------------------------------------------------------


def _noisy(r: Roles) -> DataFrame:
    """Names of every venue: in wrappers, with a mark, with a label in parentheses, by acronym; and some of nobody."""
    k = F.col("conf_id") % 4
    noisy = F.when(k == 0, F.concat(F.lit("Proceedings of the 1998 "), F.upper("title"))).when(k == 1, F.concat("title", F.lit("!"))).when(k == 2, F.concat("title", F.lit(" (Workshop)"))).otherwise(F.concat(F.lit("CU"), F.col("conf_id").cast("string")))
    return r.conferences.select(noisy.alias("name")).unionByName(r.authors.select("name"))


def _venues(r: Roles) -> DataFrame:
    return r.conferences.select(F.col("conf_id").alias("venue_id"), "title", F.concat(F.lit("CU"), F.col("conf_id").cast("string")).alias("acronym"), F.array().cast("array<string>").alias("aliases"))


# By the rules: without its wrappers a name is a variant, without its label a parent series; one that only
# loses punctuation has its title, one that is an acronym has that; and nothing else comes near.
_NOISY = """, n AS (SELECT conf_id, CASE conf_id % 4 WHEN 0 THEN 'Proceedings of the 1998 ' || upper(title) WHEN 1 THEN title || '!' WHEN 2 THEN title || ' (Workshop)' ELSE 'CU' || conf_id END AS name,
  CASE conf_id % 4 WHEN 0 THEN 'variant-strip' WHEN 1 THEN 'exact-title' WHEN 2 THEN 'parent-series' ELSE 'exact-acronym' END AS match_type, CASE conf_id % 4 WHEN 0 THEN 0.97 WHEN 2 THEN 0.96 ELSE 0.99 END::DOUBLE AS score FROM conferences)
"""
add("match_decision", lambda r: matching.match_venues(_noisy(r), _venues(r)).select("name", "status", "venue_id", "match_type", "score", "confidence"), P + _NOISY + "SELECT name, 'matched' AS status, conf_id AS venue_id, match_type, score, 'high' AS confidence FROM n UNION ALL SELECT name, 'unmatched', NULL, 'unmatched', 0, 'unmatched' FROM authors")
add(
    "match_override",
    lambda r: matching.match_venues(_noisy(r), _venues(r), r.conferences.filter("conf_id % 4 = 0").select(X.compact_key(F.col("title")).alias("name_key"), F.element_at(F.array(*[F.lit(x) for x in ("match", "skip", "non_venue", "unmatch", "match")]), (F.col("conf_id") % 5 + 1).cast("int")).alias("action"), F.when(F.col("conf_id") % 5 == 0, F.lit(7).cast("long")).alias("venue_id"))).select("name", "status", "venue_id", "match_type", "confidence"),
    P + _NOISY + "SELECT name, CASE WHEN conf_id % 4 != 0 THEN 'matched' ELSE ['matched', 'skipped', 'non_venue', 'skipped', 'review'][conf_id % 5 + 1] END AS status, CASE WHEN conf_id % 4 != 0 THEN conf_id WHEN conf_id % 5 = 0 THEN 7 END AS venue_id, CASE WHEN conf_id % 4 != 0 THEN match_type ELSE ['manual-match', 'manual-skip', 'manual-non-venue', 'manual-unmatch', 'manual-review'][conf_id % 5 + 1] END AS match_type, CASE WHEN conf_id % 4 != 0 THEN 'high' ELSE ['high', 'skipped', 'non_venue', 'skipped', 'review'][conf_id % 5 + 1] END AS confidence FROM n UNION ALL SELECT name, 'unmatched', NULL, 'unmatched', 'unmatched' FROM authors",
)
add("contains_join", lambda r: matching.contained_names(r.journals.select("title").distinct().select(F.concat_ws(" ", F.expr("substring(title, 3)"), F.lit("ltd")).alias("name")).unionByName(r.journals.select(F.col("title").alias("name"))).unionByName(r.journals.select(F.expr("substring(title, 2)").alias("name"))), r.journals.select(F.col("journal_id").alias("venue_id"), F.concat_ws(" ", "title", "publisher").alias("title"))).select("name", "venue_id"), P + ", n AS (SELECT title[3:] || ' ltd' AS name FROM journals UNION SELECT title FROM journals UNION SELECT title[2:] FROM journals), k AS (SELECT name, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS c FROM n WHERE len(list_distinct(regexp_extract_all(lower(name), '[a-z0-9]+'))) >= 2) SELECT name, journal_id AS venue_id FROM k JOIN journals ON contains(regexp_replace(lower(title || publisher), '[^a-z0-9]', '', 'g'), c)")
_TOK = "list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+'))"
add("token_overlap_join", lambda r: matching.overlapping_names(r.journals.select(F.concat_ws(" ", "title", F.lit("extra")).alias("name")).distinct(), r.journals.select(F.col("journal_id").alias("venue_id"), "title"), 0.6).select("name", "venue_id", F.round("score", 6).alias("score")), P + f", n AS (SELECT DISTINCT title || ' extra' AS name FROM journals), m AS (SELECT name, journal_id AS venue_id, len(list_intersect({_TOK.format(c='name')}, {_TOK.format(c='title')})) / greatest(len({_TOK.format(c='name')}), len({_TOK.format(c='title')})) AS s FROM n, journals) SELECT name, venue_id, round(0.80::DOUBLE + s * 0.10::DOUBLE, 6) AS score FROM m WHERE s >= 0.6")
add("prefix_overlap_join", lambda r: matching.prefix_matches(r.journals.select(F.concat(F.substring("title", 1, 4), F.lit(" "), F.element_at(F.split("title", " "), -1)).alias("name")).distinct(), r.journals.select(F.col("journal_id").alias("venue_id"), "title")).select("name", "venue_id", "score"), P + ", n AS (SELECT DISTINCT title[1:4] || ' ' || string_split(title, ' ')[-1] AS name FROM journals), t AS (SELECT name, journal_id AS v, list_distinct(regexp_extract_all(lower(name), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')) AS b FROM n, (SELECT min(journal_id) AS journal_id, title FROM journals GROUP BY title)), s AS (SELECT name, v, len(list_filter(a, lambda x: len(list_filter(b, lambda y: starts_with(x, y) OR starts_with(y, x))) > 0)) / greatest(len(a), len(b)) AS score, greatest(len(a), len(b)) AS m FROM t) SELECT name, v AS venue_id, score FROM s WHERE score >= CASE WHEN m <= 2 THEN 0.70 ELSE 0.40 END QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, v) = 1")
add("top2_margin", lambda r: matching.ranked(r.papers.filter("conf_id IS NOT NULL").groupBy(F.col("year").cast("string").alias("name"), F.col("conf_id").alias("venue_id")).agg((F.count(F.lit(1)) / 100).alias("score")).withColumns({"title": F.col("venue_id").cast("string"), "match_type": F.lit("t")}), 2).select("name", "venue_id", "place", F.round("margin", 6).alias("margin")), P + ", c AS (SELECT year::VARCHAR AS name, conf_id AS venue_id, count(*) / 100 AS score FROM papers WHERE conf_id IS NOT NULL GROUP BY 1, 2), w AS (SELECT *, row_number() OVER o AS place, score - coalesce(lead(score) OVER o, 0) AS margin FROM c WINDOW o AS (PARTITION BY name ORDER BY score DESC, venue_id::VARCHAR, venue_id)) SELECT name, venue_id, place::INTEGER AS place, round(margin, 6) AS margin FROM w WHERE place <= 2")
add("stage_metrics", lambda r: matching.stage_metrics(r.papers.select(F.when(F.col("conf_id").isNotNull(), "exact-title").otherwise("unmatched").alias("match_type"), F.when(F.col("conf_id").isNotNull(), "matched").otherwise("unmatched").alias("status"), F.lit(2).alias("n"))), P + "SELECT CASE WHEN conf_id IS NOT NULL THEN 'exact normalized local match' ELSE 'conservative fuzzy fallback' END AS stage, CASE WHEN conf_id IS NOT NULL THEN 'matched' ELSE 'unmatched' END AS status, count(*) AS names, 2 * count(*)::BIGINT AS row_count FROM papers GROUP BY 1, 2")
add("regression_diff", lambda r: matching.regression(r.papers.select(F.col("title").alias("name"), F.col("conf_id").alias("venue_id")), r.papers.filter("paper_id % 10 != 0").select(F.col("title").alias("name"), F.col("conf_id").alias("venue_id"))), P + "SELECT title AS name, conf_id AS previous_id FROM papers WHERE conf_id IS NOT NULL AND paper_id % 10 = 0")
_SERIES = ", b AS (SELECT 'conf/' || lower(rank) AS series, conferences.title AS name, count(*) AS c FROM papers JOIN conferences USING (conf_id) GROUP BY 1, 2)"


def _named(r: Roles) -> DataFrame:
    """Papers with the title of their conference as book title and its rank as the series of their key."""
    return r.papers.join(r.conferences.withColumnRenamed("title", "booktitle"), "conf_id").select("booktitle", F.concat_ws("/", F.lit("conf"), F.lower("rank"), F.col("paper_id").cast("string")).alias("key"))


add("registry_build", lambda r: matching.build_registry(_named(r)).select("series", "row_count", "distinct_names", "dominant", "representative", F.array_join("names", ",").alias("names"), "venue_key"), P + _SERIES + ", o AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY c DESC, name) AS k, row_number() OVER (PARTITION BY series ORDER BY c DESC, length(name) DESC, lower(name) DESC) AS best FROM b) SELECT series, sum(c)::BIGINT AS row_count, count(*) AS distinct_names, min(name) FILTER (k = 1) AS dominant, min(name) FILTER (best = 1) AS representative, string_agg(name, ',' ORDER BY k) FILTER (k <= 10) AS names, 'dblp-' || replace(series, '/', '-') AS venue_key FROM o GROUP BY series")
add("series_votes", lambda r: matching.series_of_names(r.conferences.select(F.concat("title", F.lit("!")).alias("name")), _named(r)), P + _SERIES + ", v AS (SELECT name, series, c, row_number() OVER (PARTITION BY name ORDER BY c DESC, series) AS k FROM b) SELECT name || '!' AS name, series FROM v WHERE k = 1")
add("series_bridge", lambda r: matching.registry_bridge(matching.match_venues(r.conferences.select(F.col("title").alias("name")), _venues(r).filter("venue_id % 2 = 0")), matching.series_of_names(r.conferences.select(F.col("title").alias("name")), _named(r)), r.conferences.groupBy(F.concat(F.lit("conf/"), F.lower("rank")).alias("series")).agg(F.min("conf_id").alias("venue_id"))).select("name", "status", "venue_id", "match_type"), P + _SERIES + ", m AS (SELECT 'conf/' || lower(rank) AS series, min(conf_id) AS v FROM conferences GROUP BY 1) SELECT title AS name, CASE WHEN conf_id % 2 = 0 OR series IS NOT NULL THEN 'matched' ELSE 'unmatched' END AS status, CASE WHEN conf_id % 2 = 0 THEN conf_id ELSE v END AS venue_id, CASE WHEN conf_id % 2 = 0 THEN 'exact-title' WHEN series IS NOT NULL THEN 'dblp-local-csv-registry' ELSE 'unmatched' END AS match_type FROM conferences LEFT JOIN b ON b.name = title LEFT JOIN m USING (series)")
add("journal_registry", lambda r: matching.match_journal_registry(r.conferences.select(F.concat(F.upper("title"), F.when(F.col("conf_id") % 2 == 0, "").otherwise(" (Part 2)")).alias("name")).unionByName(r.authors.select("name")), r.conferences.select("title", F.concat(F.lit("journals/x"), F.col("conf_id").cast("string"), F.lit("/y")).alias("key")), r.conferences.filter("conf_id % 3 != 0").select(F.col("conf_id").alias("venue_id"), "title", F.array().cast("array<string>").alias("aliases")), name="title", key="key"), P + "SELECT upper(title) || CASE WHEN conf_id % 2 = 0 THEN '' ELSE ' (Part 2)' END AS name, CASE WHEN conf_id % 3 != 0 THEN 'matched' ELSE 'unmatched' END AS status, CASE WHEN conf_id % 3 != 0 THEN conf_id END AS venue_id, CASE WHEN conf_id % 3 != 0 THEN 'dblp-local-csv-registry' ELSE 'unmatched' END AS match_type, CASE WHEN conf_id % 3 != 0 THEN 0.95 ELSE 0 END::DOUBLE AS score FROM conferences UNION ALL SELECT name, 'unmatched', NULL, 'unmatched', 0 FROM authors")
add("blocked_reasons", lambda r: matching.match_venues(_noisy(r), _venues(r)).groupBy(matching.blocked_reason().alias("reason")).agg(F.count(F.lit(1)).alias("n")), P + "SELECT '' AS reason, count(*) AS n FROM conferences UNION ALL SELECT 'no conservative candidate found', count(*) FROM authors")
add("review_split", lambda r: r.conferences.select("conf_id", matching.review_split(False, F.col("conf_id") % 5 == 0, F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("conf_id") % 3 + 1).cast("int"))).alias("pile")), P + "SELECT conf_id, CASE WHEN conf_id % 5 = 0 THEN 'approve' WHEN conf_id % 3 = 2 THEN 'lookup_enrichment' ELSE 'collision_review_only' END AS pile FROM conferences")
add("proposals", lambda r: matching.proposals(*[df.select("name", "n", F.when(F.col("n") % 3 == 0, "metadata-alias").otherwise("token-overlap").alias("match_type"), (F.col("n") % 10 / 10).alias("score")) for df in (r.conferences.select(F.col("title").alias("name"), F.col("conf_id").alias("n")), r.journals.select(F.col("title").alias("name"), F.col("journal_id").alias("n")))]).select("venue_type", "name", "n"), P + ", a AS (SELECT 'conference' AS venue_type, title AS name, conf_id AS n FROM conferences UNION ALL SELECT 'journal', title, journal_id FROM journals) SELECT * FROM a WHERE n % 3 = 0 OR n % 10 = 9")
add("variant_rows", lambda r: matching.variant_rows(r.journals.select((F.col("journal_id") % 50).alias("journal_id"), F.concat(F.lit(" "), F.when(F.col("journal_id") % 2 == 0, F.upper("title")).otherwise(F.col("title"))).alias("variant"), F.lit("title").alias("variant_type"), F.lit("local").alias("source"), F.lit("").alias("issn"), F.lit("").alias("issn_l"), F.col("journal_id").alias("seq")), "seq").select("journal_id", "variant", "seq"), P + "SELECT journal_id % 50 AS journal_id, arg_max(CASE WHEN journal_id % 2 = 0 THEN upper(title) ELSE title END, journal_id) AS variant, max(journal_id) AS seq FROM journals GROUP BY journal_id % 50, title")
add("regression_report", lambda r: matching.regression_report(r.conferences.select(F.col("title").alias("name"), F.col("conf_id").alias("venue_id")), r.conferences.select(F.col("title").alias("name"), F.when(F.col("conf_id") % 3 != 0, F.col("conf_id")).alias("venue_id"), F.lit("unmatched").alias("match_type")), r.conferences.filter("conf_id % 5 = 0").select(F.col("title").alias("name"), F.lit("held").alias("reason"), F.lit("x").alias("candidate")), _venues(r), r.conferences.filter("conf_id % 2 = 0").select(F.col("title").alias("name"), F.lit("gone").alias("justification"))), P + "SELECT title AS name, conf_id AS previous_id, title AS previous_title, 'unmatched' AS match_type, CASE WHEN conf_id % 5 = 0 THEN 'x' END AS candidate, CASE WHEN conf_id % 5 = 0 THEN 'held' END AS reason, CASE WHEN conf_id % 2 = 0 THEN 'gone' END AS justification FROM conferences WHERE conf_id % 3 = 0")
add("audit_merge", lambda r: matching.audit_rows(*[r.conferences.filter(f).select(F.lit(i).alias("id"), F.lit("2020-01-01").alias("run_date"), F.lit("conference").alias("venue_type"), F.lower("title").alias("normalized_name"), F.lit(i).alias("stage")) for f, i in (("conf_id % 2 = 0", "old"), ("conf_id % 3 = 0", ""))]), P + "SELECT CASE WHEN conf_id % 3 = 0 THEN sha1('2020-01-01|conference|' || lower(title))[1:16] ELSE 'old' END AS id, '2020-01-01' AS run_date, 'conference' AS venue_type, lower(title) AS normalized_name, CASE WHEN conf_id % 3 = 0 THEN '' ELSE 'old' END AS stage FROM conferences WHERE conf_id % 2 = 0 OR conf_id % 3 = 0")
add("facts_union", lambda r: etl.all_facts({kind: (r.papers.filter(F.col("type") == kind).select("paper_id", "year", F.concat(F.lit(kind), F.col(key).cast("string")).alias("venue")), r.conferences.select(F.concat(F.lit(kind), F.col("conf_id").cast("string")).alias("name"), F.col("conf_id").alias("venue_id")), "venue", key) for kind, key in (("conference", "conf_id"), ("journal", "journal_id"))}), P + "SELECT paper_id, year, type, CASE WHEN conf_id IN (SELECT conf_id FROM conferences) THEN conf_id END AS conf_id, CASE WHEN journal_id IN (SELECT conf_id FROM conferences) THEN journal_id END AS journal_id FROM papers")
add("lookups", lambda r: views.lookups(r.categories, etl.RANKS), P + "SELECT 'category' AS kind, primary_for::VARCHAR AS id, description AS name FROM categories UNION ALL SELECT 'rank', r, r FROM (SELECT unnest(['A*', 'A', 'B', 'C']) AS r)")
add("venue_total", lambda r: views.venue_total(r.conferences, r.journals), P + "SELECT ((SELECT count(*) FROM conferences) + (SELECT count(*) FROM journals))::BIGINT AS venues")
add("series_by_code", lambda r: views.series_by_code(r.conferences.groupBy("primary_for").agg(F.count(F.lit(1)).alias("n")), r.categories, "primary_for"), P + "SELECT primary_for, count(*) AS n, description FROM conferences JOIN categories USING (primary_for) GROUP BY ALL")
add("profile_years", lambda r: views.profile_years(views.venue_profile(r.conferences.select("conf_id", "title"), r.papers, r.links, "conf_id").select("conf_id", "title", "total_papers"), views.venue_yearly(r.papers, r.links, "conf_id"), "conf_id"), P + ", y AS (" + _YEARLY.format(k="conf_id") + ") SELECT v.conf_id, v.title, (SELECT count(*) FROM papers p WHERE p.conf_id = v.conf_id) AS total_papers, y.* EXCLUDE (conf_id) FROM conferences v LEFT JOIN y USING (conf_id)")
add("aliases_of_names", lambda r: r.table("part").select("p_partkey", *[f(F.concat(F.lit("Proceedings of the 1998 "), F.col("p_name"), F.lit(" Workshops, 2001"))).alias(k) for k, f in (("child", X.child_alias), ("parent", X.parent_alias))]), "SELECT p_partkey, p_name || ' workshops' AS child, p_name AS parent FROM part")
add("conference_series", lambda r: r.table("part").select("p_partkey", X.conference_series(F.when(F.col("p_partkey") % 2 == 0, F.concat_ws("/", F.lit("conf"), "p_brand", F.lit("1998"))).otherwise("journals/x/1"), F.when(F.col("p_partkey") % 3 == 0, F.concat_ws("/", F.lit(" conf"), "p_type", F.lit("y")))).alias("k")), "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'conf/' || p_brand WHEN p_partkey % 3 = 0 THEN 'conf/' || p_type ELSE '' END AS k FROM part")
add("issn_split", lambda r: r.table("part").select("p_partkey", F.array_join(X.split_issns(F.concat(F.lit("12-"), F.col("p_partkey").cast("string"), F.lit("; ;x-9"))), ",").alias("issns")), "SELECT p_partkey, '12' || p_partkey || ',X9' AS issns FROM part")
add("map_default", lambda r: r.table("part").select("p_partkey", X.map_get(F.create_map(F.lit("SMALL"), F.lit("s"), F.lit("LARGE"), F.lit("l")), F.col("p_type"), F.lit("?")).alias("v")), "SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 's' WHEN 'LARGE' THEN 'l' ELSE '?' END AS v FROM part")
add("renumbered", lambda r: etl.renumbered(r.categories, "description", "primary_for"), P + "SELECT *, 1 + row_number() OVER (ORDER BY description, primary_for) AS line_no FROM categories")
add("ordered_dedup", lambda r: etl.ordered_dedup(*[r.journals.filter(f).groupBy("title").agg(F.lit(w).alias("origin")) for f, w in (("journal_id % 7 = 0", "explicit"), ("journal_id > 0", "derived"))], "title"), P + "SELECT title, CASE WHEN bool_or(journal_id % 7 = 0) THEN 'explicit' ELSE 'derived' END AS origin FROM journals WHERE journal_id % 7 = 0 OR journal_id > 0 GROUP BY 1")
add("review_pivot", lambda r: matching.review_rows(matching.indexed_candidates(_noisy(r), matching.build_index(_venues(r)))).select("name", "candidate_1_venue_id", "candidate_1_score", "candidate_2_venue_id", "score_gap"), P + _NOISY + "SELECT name, conf_id AS candidate_1_venue_id, score AS candidate_1_score, NULL::BIGINT AS candidate_2_venue_id, score AS score_gap FROM n")
add("audit_sample", lambda r: matching.audit_sample(r.papers.filter("conf_id IS NOT NULL").groupBy(F.col("conf_id").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n"))), None)
add("rate_limit", lambda r: over_limit(r.table("events"), 1, "1 day").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd")), "SELECT user_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, count(*) AS requests FROM events GROUP BY 1, 2 HAVING count(*) > 1")
