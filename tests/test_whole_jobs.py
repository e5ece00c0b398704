"""Queries over whole columns and tables, where a prefix or a filter would give less."""

import pytest

from quire.plans import catalogue


@pytest.mark.parametrize("name, column, tail", [("ascii_fold", "folded", " Elan & a/B"), ("clean_for_match", "cleaned", " elan and a b"), ("compact_key", "k", "elanandab"), ("compact_key", "h", "-elan-and-a-b")])
def test_text_functions_reach_the_end_of_a_long_text(spark, tmp_path, name, column, tail):
    spark.createDataFrame([(1, "x" * 500 + " Élan & a/B"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r[column] for r in catalogue.queries()[name](spark, str(tmp_path)).collect()}
    assert got == {1: "x" * 500 + tail, 2: ""}


def test_upsert_sees_every_line_and_paper_of_its_sides(spark, sf):
    keys = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey").distinct().count()
    got = catalogue.queries()["upsert_last_wins"](spark, sf)
    assert got.count() >= keys > 1000
    assert got.filter("id IS NULL").count() == 0 and got.select("id").distinct().count() == got.count()


@pytest.mark.parametrize("name, column", [("match_decision", "venue_id"), ("review_pivot", "candidate_1_venue_id"), ("merge_sources", "acronym")])
def test_every_conference_is_matched_reviewed_and_merged(spark, sf, name, column):
    conferences = spark.read.parquet(f"{sf}/customer.parquet").count()
    assert catalogue.queries()[name](spark, sf).filter(f"{column} IS NOT NULL").select(column).distinct().count() == conferences


def test_only_counts_are_broadcast_to_find_names_in_titles(spark, sf):
    plan = catalogue.queries()["contains_join"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 1 and plan.count("SortMergeJoin") == 2
