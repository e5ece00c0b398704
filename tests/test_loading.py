"""Cleaning, sources, keyed writes and the request limit."""

import gzip

import pytest

from quire.operators import etl, search
from quire.sources import readers
from quire.streaming.rate_limit import load_increment, loaded, over_limit


def test_conference_papers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id;author;booktitle;title;year\n1;A|B| ;X;"T; ""q""";1998\n2;C;;U;1999\n3;D;Y;V;19x\n')
    raw = readers.conference_papers(spark, str(tmp_path / "a.csv"))
    assert raw.columns == readers.CONFERENCE_PAPERS
    clean = etl.clean_papers(raw, "booktitle").collect()
    assert [(r["id"], r["title"], r["year"]) for r in clean] == [("1", 'T; "q"', 1998)]
    assert tuple(etl.skipped_rows(raw, "booktitle").first()) == (1, 2)
    assert [tuple(r) for r in etl.author_links(raw.filter("id = 1")).collect()] == [("1", "A", 1), ("1", "B", 2)]


def test_bad_utf8_is_replaced(spark, tmp_path):
    (tmp_path / "b.csv").write_bytes(b"id;title\n1;a\xffb\n")
    assert readers.delimited(spark, str(tmp_path / "b.csv")).first()["title"] == "a�b"


def test_optional_and_sniffed(spark, tmp_path):
    assert readers.optional(spark, str(tmp_path / "none.csv"), ["a"]).count() == 0
    (tmp_path / "p.csv").write_text("version https://git-lfs.github.com/spec/v1\n")
    assert readers.optional(spark, str(tmp_path / "p.csv"), ["a"]).count() == 0
    (tmp_path / "t.tsv").write_text("Title\tH index\nX\t5\n")
    assert readers.sniffed(spark, str(tmp_path / "t.tsv")).first()["H index"] == "5"


def test_ragged_ranks(spark, tmp_path):
    (tmp_path / "x.csv").write_text('1,"A, B",AB,S,A*,yes,4605,4606\n2,C,CC\n')
    r = readers.ragged_ranks(spark, str(tmp_path)).orderBy("line_no").collect()
    assert (r[0]["title"], r[0]["for_codes"], r[1]["acronym"], r[1]["for_codes"]) == ("A, B", ["4605", "4606"], "CC", [])


def test_xml_snapshot(spark, tmp_path):
    xml = b'<dblp><article key="journals/a/1"><journal>A</journal></article><proceedings key="conf/x/1"><booktitle>X</booktitle><title>T</title></proceedings></dblp>'
    (tmp_path / "s.xml.gz").write_bytes(gzip.compress(xml))
    assert readers.xml_snapshot(spark, str(tmp_path / "s.xml.gz"), "article").first()["key"] == "journals/a/1"
    assert readers.xml_snapshot(spark, str(tmp_path / "s.xml.gz"), "proceedings").first()["title"] == "T"


def test_payloads(spark):
    p = spark.createDataFrame([("n", '{"results":[{"display_name":"J","issn":["1"],"issn_l":"1"}]}'), ("m", "broken")], "name string, payload string")
    assert [r["display_name"] for r in readers.payload_candidates(p, "source").collect()] == ["J"]


def test_pick_source():
    assert readers.pick_source(["d/input_b.csv", "d/input_article.csv", "d/other.csv"], "article", "input_article.csv") == "d/input_article.csv"
    assert readers.pick_source([], "a", "b") is None


def test_insert_ignore_and_upsert(spark):
    old = spark.createDataFrame([(1, "a", 5)], "id long, k string, v long")
    new = spark.createDataFrame([("a", 7, 1), ("a", 8, 2), ("b", 9, 3)], "k string, v long, seq long")
    got = {tuple(r) for r in etl.upsert(old, new, ["k"], "seq", ["v"], "id").select("id", "k", "v").collect()}
    assert got == {(1, "a", 8), (2, "b", 9)}
    many = spark.createDataFrame([(f"k{k % 50}", k, k) for k in range(200, 0, -1)], "k string, v long, seq long").repartition(5)
    got = {r["k"]: (r["id"], r["v"]) for r in etl.upsert(old, many, ["k"], "seq", ["v"], "id").collect()}
    assert got["a"] == (1, 5) and all(got[f"k{k % 50}"] == (k + 1, k + 150) for k in range(1, 51))
    assert etl.upsert(old.limit(0), many.limit(0), ["k"], "seq", ["v"], "id").count() == 0
    first = {tuple(r) for r in etl.first_wins(new, ["k"], "seq").select("k", "v").collect()}
    assert first == {("a", 7), ("b", 9)}


def test_latest_batch_and_valid_candidate(spark):
    from pyspark.sql import functions as F

    n = spark.createDataFrame([("r-2026-01-02-batch2",), ("r-2026-01-02-batch10",), ("r-2025-09-09",)], "name string")
    assert etl.latest_batch(n).first()[0] == "r-2026-01-02-batch10"
    c = spark.createDataFrame([(["x", "4605"], ["4605"])], "c array<string>, v array<string>")
    assert tuple(c.select(etl.valid_candidate(F.col("c"), F.col("v")).alias("x")).select("x.*").first()) == ("4605", False)


def test_paging():
    assert search.clamp_page(-3, 1000, 100) == (1, 100)
    assert search.parse_ids("1,x, 2") == [1, 2]
    with pytest.raises(ValueError):
        search.parse_ids("a,b")
    assert search.category_code("460501") == "4605" and search.category_code("4605") == "4605"


def test_pagination(spark):
    assert search.pagination(spark.range(3), 2, 1) == {"page": 2, "per_page": 1, "total": 3, "total_pages": 3}
    assert search.text_search(spark.createDataFrame([("a",)], "t string"), "?!", "t").count() == 0


def test_rate_limit_on_a_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    wanted = {(r["user_id"], r["requests"]) for r in over_limit(events, 2, "1 day").collect()}
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parquet*")
    q = over_limit(stream, 2, "1 day").writeStream.format("memory").queryName("over").outputMode("complete").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    assert {(r["user_id"], r["requests"]) for r in spark.table("over").collect()} == wanted


def test_increments_keep_what_was_there(spark, tmp_path):
    at = f"{tmp_path}/target"
    rows = lambda *x: spark.createDataFrame(x, "k string, v long, seq long")
    for k, batch in enumerate([rows(("a", 1, 1), ("b", 2, 1)), rows(("a", 3, 2), ("a", 4, 3))]):
        load_increment(batch, k, at, ["k"], "seq")
        load_increment(batch, k, at, ["k"], "seq")
    assert {(r["k"], r["v"]) for r in loaded(spark, at, ["k"], "seq").collect()} == {("a", 4), ("b", 2)}
