"""The pipeline stage by stage, each held against what brute force makes of its own input."""

from collections import Counter

import corpus_pipeline
from tests.llm.test_operators import contamination, linked, measures


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, {}
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        before = rows.get("last") or [tuple(r) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, out, sf)
        if name != "sharding":
            assert out.columns == columns
        if name == "quality rules":
            got = Counter(r[0] for r in out.collect())
            assert not [d for d, t in before if d in got and measures(t)[-1]]
        elif name == "n-gram Jaccard join":
            assert sorted(r["doc_id"] for r in out.collect()) == sorted({c for _, c in linked(before, 5, 80).values()})
        elif name == "benchmark decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            assert sorted(r["doc_id"] for r in out.collect()) == sorted(d for d, _, n, _ in contamination(before, items) if not n)
        elif name == "sharding":
            assert Counter(r["doc_id"] for r in out.collect()) == Counter(d for d, _ in before)
            assert {r["law"] for r in out.collect()} == {"bytes"}
        if name != "sharding":
            rows["last"] = [(r["doc_id"], r["text"]) for r in out.collect()]


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
