"""The matcher on small dimensions with known answers."""

import pytest
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import matching as M


def venues(spark, *rows):
    return spark.createDataFrame([(i, t, a, list(al)) for i, t, a, al in rows], "venue_id long, title string, acronym string, aliases array<string>")


def names(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "name string")


def decided(df):
    return {r["name"]: r for r in df.collect()}


def test_exact_title_and_acronym(spark):
    v = venues(spark, (1, "International Conference on Software Engineering", "ICSE", ()), (2, "Conference on Information Systems", "CAISE", ()))
    d = decided(M.match_venues(names(spark, "ICSE", "Proceedings of the 1998 Conference on Information Systems"), v))
    assert (d["ICSE"]["venue_id"], d["ICSE"]["match_type"], d["ICSE"]["status"]) == (1, "exact-acronym", "matched")
    assert [(x["venue_id"], x["match_type"], x["score"]) for k, x in d.items() if k != "ICSE"] == [(2, "variant-strip", 0.97)]


def test_forms_of_a_name(spark):
    """Lower-case acronyms are looked up whole; one word inside a title is no candidate; a label makes a parent series."""
    v = venues(spark, (1, "International Conference on Software Engineering", "ICSE", ()), (2, "Conference on Information Systems", "CAISE", ("Advanced Systems Engineering",)))
    d = decided(M.match_venues(names(spark, "icse", "Systems", "Conference on Information Systems (Workshops)", "Information Systems", "Advanced Systems Engineering"), v))
    assert (d["icse"]["venue_id"], d["icse"]["match_type"]) == (1, "exact-acronym")
    assert (d["Systems"]["status"], d["Systems"]["venue_id"], d["Systems"]["confidence"]) == ("unmatched", None, "unmatched")
    assert d["Conference on Information Systems (Workshops)"]["match_type"] == "parent-series"
    assert (d["Information Systems"]["status"], d["Information Systems"]["match_type"]) == ("review", "title-contains-query")
    assert (d["Advanced Systems Engineering"]["venue_id"], d["Advanced Systems Engineering"]["match_type"]) == (2, "metadata-alias")


@pytest.mark.parametrize("least", [0.5, 0.7])
def test_rare_tokens_lose_no_overlap(spark, least):
    words = "data base systems theory logic web mining vision".split()
    titles = [" ".join(words[k % 8 : k % 8 + 2 + k % 4] + words[: k % 3]) for k in range(60)]
    asked = [" ".join(words[k % 5 : k % 5 + 4]) for k in range(20)]
    v = spark.createDataFrame(list(enumerate(titles)), "venue_id long, title string")
    got = {(r["name"], r["venue_id"]) for r in M.overlapping_names(names(spark, *asked), v, least).collect()}
    share = lambda a, b: len(set(a.split()) & set(b.split())) / max(len(set(a.split())), len(set(b.split())))
    assert got == {(a, k) for a in asked for k, t in enumerate(titles) if share(a, t) >= least}


def test_names_in_titles_by_their_rarest_piece(spark):
    titles = ["Data Base Systems", "Database Theory", "a b", "Systems of Data", "x"]
    asked = ["data base", "base systems", "a b", "base", "s of d", "no such name", "ta bas"]
    v = spark.createDataFrame(list(enumerate(titles)), "venue_id long, title string")
    got = {(r["name"], r["venue_id"]) for r in M.contained_names(names(spark, *asked), v).collect()}
    compact = lambda t: "".join(c for c in t.lower() if c.isalnum())
    assert got == {(a, k) for a in asked for k, t in enumerate(titles) if len(a.split()) >= 2 and compact(a) in compact(t)}


def test_tokens_that_begin_each_other(spark):
    titles = ["Acta Informatica", "Acta Numerica", "J Comput", "Inf Sci", "Informatics"]
    asked = ["Acta Inf", "a informatica", "Journal Computing", "Information Science", "In"]
    v = spark.createDataFrame(list(enumerate(titles)), "venue_id long, title string")
    got = {r["name"]: (r["venue_id"], round(r["score"], 6), r["confidence"]) for r in M.prefix_matches(names(spark, *asked), v).collect()}
    tokens = lambda t: {w for w in t.lower().split() if w not in X.JOURNAL_STOPWORDS}

    def score(a, b):
        a, b = tokens(a), tokens(b)
        return sum(any(x.startswith(y) or y.startswith(x) for y in b) for x in a) / max(len(a), len(b), 1), max(len(a), len(b))

    for a in asked:
        best = max(((s, -k) for k, t in enumerate(titles) for s, n in [score(a, t)] if s >= (0.7 if n <= 2 else 0.4)), default=None)
        assert (got.get(a) or (None,))[0] == (-best[1] if best else None)


def test_external_sources(spark):
    v = spark.createDataFrame([(1, "Journal of Things", ["Things J"], ["1234-5678"]), (2, "Other", [], [])], "venue_id long, title string, aliases array<string>, issns array<string>")
    e = spark.createDataFrame([("A", "openalex", "Journal of Things", [], []), ("B", "crossref", "x", ["THINGS-J"], []), ("C", "openalex", "y", [], ["12345678"])], "name string, source string, display_name string, other_titles array<string>, issns array<string>")
    assert {(r["name"], r["venue_id"], r["match_type"], r["score"]) for r in M.external_candidates(e, v).collect()} == {("A", 1, "openalex-title", 0.92), ("B", 1, "crossref-alt-title", 0.96), ("C", 1, "openalex-issn", 1.0)}


def test_risky_journals_freeze(spark):
    rows = [("JCP", "matched", 1, "exact-title", 0.99, 0.5, "high", 2), ("JCP", "matched", 1, "openalex-issn", 1.0, 0.5, "high", 1), ("JCM", "matched", 1, "exact-title", 0.99, 0.02, "high", 2), ("JCM Journal of Much", "matched", 1, "exact-title", 0.99, 0.02, "high", 2)]
    d = spark.createDataFrame(rows, "name string, status string, venue_id long, match_type string, score double, margin double, confidence string, n_candidates long")
    got = [tuple(r) for r in M.freeze_risky(d).select("status", "venue_id", M.blocked_reason(True).alias("why")).collect()]
    assert got[0][:2] == ("review", None) and got[1] == ("matched", 1, "") and got[2] == ("review", None, "risky-abbreviation-near-tie") and got[3] == ("matched", 1, "")


def test_review_buckets_and_advice(spark):
    rows = [("CARS", "review", "metadata-alias", 0.96, 0.0, 2, None, "A"), ("ICEC", "review", "title-contains-query", 0.86, 0.0, 1, None, "B"), ("Ein deutscher Titel", "unmatched", "unmatched", 0.0, 0.0, 0, None, "C"), ("EGC", "unmatched", "unmatched", 0.0, 0.0, 0, "conf/egc", "C")]
    d = spark.createDataFrame(rows, "name string, status string, match_type string, score double, margin double, n_candidates long, series string, wanted string")
    assert [r[0] == r[1] for r in d.select(M.conference_bucket(F.col("series")), "wanted").collect()] == [True] * 4
    j = spark.createDataFrame([("IWBS Report", "unmatched", "unmatched", 0.0, 0), ("J Good Things", "review", "metadata-alias", 0.97, 1), ("Other", "review", "exact-title", 0.97, 1)], "name string, status string, match_type string, score double, n_candidates long")
    got = [tuple(r) for r in j.select(M.journal_action(), M.approval_ready(), M.variant_type()).collect()]
    assert got == [("intentional null / likely not rankable", False, "report-like"), ("approve alias", True, "title-variant"), ("review manually", False, "abbreviation")]


def test_series_reconciled_and_inferred(spark):
    v = venues(spark, (1, "Alpha Beta Gamma Conference", "ABG", ()), (2, "Delta Epsilon Zeta Symposium", "DEZ", ()))
    papers = spark.createDataFrame([("Alpha Beta Gamma Conference", f"conf/abg/{k}") for k in range(6)] + [("DEZ", f"conf/dez/{k}") for k in range(6)] + [("DEZ", "conf/few/1")], "booktitle string, key string")
    registry = M.build_registry(papers)
    known = spark.createDataFrame([("conf/abg", 9)], "series string, venue_id long")
    assert tuple(M.reconcile_series(known, registry, v).first()) == ("conf/abg", 1, 9)
    assert [tuple(r) for r in M.infer_series(known, registry, v).collect()] == [("conf/dez", 2)]


def test_journal_series_that_disagree(spark):
    v = spark.createDataFrame([(1, "Things", []), (2, "Other Matters", [])], "venue_id long, title string, aliases array<string>")
    papers = spark.createDataFrame([("Things", "journals/a/1"), ("Things", "journals/a/2"), ("Things (Old)", "journals/b/1"), ("Other Matters", "journals/c/1"), ("Matters", "journals/c/2"), ("Matters", "journals/d/2")], "journal string, key string")
    got = {r["name"]: (r["status"], r["venue_id"], r["match_type"]) for r in M.match_journal_registry(names(spark, "Things", "Matters", "Nothing"), papers, v, name="journal", key="key").collect()}
    assert got["Nothing"] == ("unmatched", None, "unmatched")
    assert got["Things"][:2] == ("matched", 1)
    assert got["Matters"] == ("review", None, "dblp-local-csv-registry")


def test_historical_alias(spark):
    v = venues(spark, (522, "Theory and Practice of Digital Libraries (previously ECDL until 2010)", "TPDL", ()))
    r = decided(M.match_venues(names(spark, "ECDL"), v))["ECDL"]
    assert (r["venue_id"], r["match_type"], r["status"]) == (522, "historical-alias", "matched")


def test_segment_acronym(spark):
    v = venues(spark, (264, "North American Chapter of the Computational Linguistics Society", "NAACL", ()))
    r = decided(M.match_venues(names(spark, "HLT-NAACL"), v))["HLT-NAACL"]
    assert (r["venue_id"], r["match_type"]) == (264, "segment-acronym")


def test_frozen_and_conflicting_acronyms_go_to_review(spark):
    v = venues(spark, (10, "Advances in Computer Entertainment", "ACE", ()), (11, "Intelligent Computing", "ICIC", ()))
    d = decided(M.match_venues(names(spark, "ACE", "ICIC"), v, conflicts=["ace"]))
    assert {(d[k]["status"], d[k]["match_type"]) for k in d} == {("review", "ambiguous-acronym")}
    assert {(d[k]["venue_id"], d[k]["confidence"]) for k in d} == {(None, "review")}


@pytest.mark.parametrize("action, status", [("match", "matched"), ("skip", "skipped"), ("non_venue", "non_venue"), ("unmatch", "skipped")])
def test_manual_override(spark, action, status):
    v = venues(spark, (1, "Some Venue", "SVE", ()))
    manual = spark.createDataFrame([("somevenue", action, 7)], "name_key string, action string, venue_id long")
    for name in ("Some Venue", "Proceedings of the 1998 Some Venue", "Some Venue (Workshops)"):
        r = decided(M.match_venues(names(spark, name), v, manual))[name]
        assert (r["status"], r["venue_id"], r["match_type"]) == (status, 7 if action == "match" else None, "manual-" + action.replace("_", "-"))


def test_manual_match_without_an_id_is_for_review(spark):
    manual = spark.createDataFrame([("somevenue", "match", None)], "name_key string, action string, venue_id long")
    r = decided(M.match_venues(names(spark, "Some Venue"), venues(spark, (1, "Some Venue", "SVE", ())), manual))["Some Venue"]
    assert (r["status"], r["venue_id"], r["match_type"], r["score"], r["confidence"]) == ("review", None, "manual-review", 0.0, "review")


def test_unmatched_and_empty(spark):
    v = venues(spark, (1, "Some Venue", None, ()))
    assert decided(M.match_venues(names(spark, "Zzz"), v))["Zzz"]["status"] == "unmatched"
    assert M.match_venues(names(spark, "x").limit(0), v).count() == 0


def test_issn_beats_title(spark):
    n = spark.createDataFrame([("J X", "openalex", "J X?", [], ["1234-5678"])], "name string, source string, display_name string, other_titles array<string>, issns array<string>")
    v = spark.createDataFrame([(1, "Other", [], ["12345678"]), (2, "J Y", [], [])], "venue_id long, title string, aliases array<string>, issns array<string>")
    found = M.external_candidates(n, v).unionByName(n.select("name", F.lit(2).cast("long").alias("venue_id"), F.lit("J X").alias("title"), F.lit("openalex-title").alias("match_type"), F.lit(0.92).alias("score"), F.lit(9).alias("step")))
    r = decided(M.decide(n, found, journal=True))["J X"]
    assert (r["venue_id"], r["match_type"], r["status"]) == (1, "openalex-issn", "matched")


def test_prefix_fallback(spark):
    v = spark.createDataFrame([(1, "Acta Informatica"), (2, "Acta Numerica")], "venue_id long, title string")
    assert M.prefix_matches(names(spark, "Acta Inf."), v).first()["venue_id"] == 1


def test_registry_and_bridge(spark):
    papers = spark.createDataFrame([("ICSE", "conf/icse/1"), ("ICSE", "conf/icse/2"), ("International Conference on Engineering", "conf/icse/3"), ("Other", "journals/x/1")], "booktitle string, key string")
    registry = M.build_registry(papers)
    r = registry.first()
    assert registry.count() == 1 and (r["series"], r["row_count"], r["dominant"], r["representative"], r["venue_key"]) == ("conf/icse", 3, "ICSE", "International Conference on Engineering", "dblp-conf-icse")
    d = spark.createDataFrame([("Icse", "unmatched", None, "unmatched", 0.0, 0.0, "low"), ("ICSE", "review", None, "token-overlap", 0.8, 0.0, "review")], "name string, status string, venue_id long, match_type string, score double, margin double, confidence string")
    got = M.registry_bridge(d, M.series_of_names(d, papers), spark.createDataFrame([("conf/icse", 9)], "series string, venue_id long"))
    assert {(r["status"], r["venue_id"], r["match_type"], r["score"]) for r in got.collect()} == {("matched", 9, "dblp-local-csv-registry", 0.96)}


def test_votes_need_a_clear_winner_and_own_rows_come_first(spark):
    papers = spark.createDataFrame([("Big Data Days", "conf/a/1"), ("Big Data Days", "conf/a/2"), ("Proceedings of Big Data Days", "conf/b/1"), ("Proceedings of Big Data Days", "conf/b/2")], "booktitle string, key string")
    asked = names(spark, "big data days!", "Big Data Days", "Nothing")
    assert {r["name"]: r["series"] for r in M.series_of_names(asked, papers).collect()} == {"big data days!": "conf/a", "Big Data Days": "conf/a"}
    assert {r["name"]: r["series"] for r in M.series_of_names(asked, papers, ["bdd"]).collect()} == {"Big Data Days": "conf/a"}


def test_backfill_takes_each_record_and_series_once(spark):
    d = spark.createDataFrame([("a", 9, "s1", 1, "matched", 0.99), ("b", 5, "s2", 1, "matched", 0.99), ("c", 4, "s1", 2, "matched", 0.99), ("d", 3, "s3", 3, "review", 0.99)], "name string, n long, series string, venue_id long, status string, score double")
    assert [tuple(r) for r in M.backfill_series(d).collect()] == [(1, "s1", "a")]


def test_review_sync(spark):
    memory = spark.createDataFrame([("a", "pending", None), ("b", "rejected", 3), ("c", "approved", 4)], "name string, status string, venue_id long")
    d = spark.createDataFrame([("a", "matched", 1), ("b", "matched", 2), ("e", "review", 5), ("f", "matched", 6)], "name string, status string, venue_id long")
    assert {tuple(r) for r in M.sync_review(memory, d).collect()} == {("a", "approved", 1), ("b", "rejected", 3), ("c", "approved", 4), ("e", "pending", 5)}


def test_regression_gate(spark):
    before, after = (spark.createDataFrame(x, "name string, venue_id long") for x in ([("a", 1), ("b", 2)], [("a", 1), ("b", None)]))
    with pytest.raises(ValueError):
        M.require_no_regression(before, after, names(spark, "z"))
    M.require_no_regression(before, after, names(spark, "b"))


@pytest.mark.parametrize("score, core, journal", [(0.96, "high", "high"), (0.70, "low", "high"), (0.60, "low", "medium"), (0.45, "low", "low"), (0.8, "medium", "high")])
def test_confidence(spark, score, core, journal):
    assert tuple(spark.range(1).select(M.confidence(F.lit(score)), M.journal_confidence(F.lit(score))).first()) == (core, journal)
