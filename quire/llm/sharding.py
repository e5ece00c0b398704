"""Sharding by a k-d tree over document metadata.

A node with k leaves is cut along its widest dimension at the value that leaves
floor(k/2)/k of its bytes on the left. All nodes of a level are cut together: histograms
of bytes are taken for every node at once, and only the bin that holds the cut is
refined, until it is narrow enough. The driver holds the tree and one level's histograms,
both bounded by the number of shards; the documents are never gathered or sorted.

A cut value is (dimension, row hash), so even a group of documents with the same metadata
can be cut anywhere, and one hot source or text cannot make a leaf too large.

Edge cases: a null text has no bytes and still has its 16; null metadata counts as the
lowest value; repeated rows share one place in the tree, so only they cannot be cut
apart; an empty table gives no rows. Only the id, text, lang and source are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import bucket_bits, checkpointed, prefix_sums, row_hash, table

SHARDS, OVERHEAD, DIMS, BINS = 40, 16, 4, 2048
#: A cut stands once the bin around it holds less than this part of a shard's bytes.
TOLERANCE = 1 / 2000
_HALF = 1 << 31


@dataclass
class Node:
    leaves: int
    dim: int = 0
    low: int = 0
    high: int = 0
    #: bytes wanted on the left; bytes known to lie left of ``low``
    want: float = 0.0
    below: int = 0
    cut: int | None = None
    kids: list[Node] = field(default_factory=list)


def _at(values: list, index: Column, kind: str) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(v).cast(kind) for v in values]), index.cast("int")), F.lit(0).cast(kind))


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, row_hash and the dimensions (31 bits each, as an array) of every document.

    Dimensions are the id, the logarithm of the size, and the language's and the source's
    place in the alphabet (by their first four bytes), each spread evenly between its least
    and its greatest value, so widths can be compared.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    place = lambda c: F.coalesce(F.conv(F.rpad(F.hex(F.substring(F.col(c).cast("string").cast("binary"), 1, 4)), 8, "0"), 16, 10).cast("double") + 1, F.lit(0.0))
    size = F.octet_length(text).cast("long") + OVERHEAD
    df = docs.select(
        "doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), row_hash(F.col("doc_id"), F.col("text")).alias("row_hash"),
        F.col("doc_id").cast("double").alias("_d0"), F.log2(size).alias("_d1"), place("lang").alias("_d2"), place("source").alias("_d3"),
    )
    df = checkpointed(df)
    ends = df.agg(*[f(f"_d{k}") for k in range(DIMS) for f in (F.min, F.max)]).first()
    dims = []
    for k in range(DIMS):
        lo, hi = (float(x or 0.0) for x in ends[2 * k : 2 * k + 2])
        dims.append(F.coalesce(((F.col(f"_d{k}") - lo) / max(hi - lo, 1e-9) * (_HALF - 1)).cast("long"), F.lit(0).cast("long")))
    return df.select("doc_id", "size", "text_crc32", "row_hash", F.array(*dims).alias("_dims"))


def build_tree(meta: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[list[Node]]:
    """The levels of the tree, from the root; every node but the leaves has a cut."""
    levels = [[Node(shards)]]
    total = None
    while any(n.leaves > 1 for n in levels[-1]):
        nodes = levels[-1]
        placed = assign(meta, levels[:-1], "_node")
        shape = placed.groupBy("_node").agg(F.sum("size").alias("b"), *[f(F.get(F.col("_dims"), F.lit(d))).alias(f"{k}{d}") for d in range(DIMS) for k, f in (("lo", F.min), ("hi", F.max))])
        for row in shape.collect():  # one row per node
            n = nodes[row["_node"]]
            n.dim = max(range(DIMS), key=lambda d: (row[f"hi{d}"] - row[f"lo{d}"], -d))
            n.low, n.high = row[f"lo{n.dim}"] * _HALF, (row[f"hi{n.dim}"] + 1) * _HALF - 1
            n.want = row["b"] * (n.leaves // 2) / n.leaves
            total = row["b"] if total is None else total
        placed = placed.withColumn("_key", cut_key(_at([n.dim for n in nodes], F.col("_node"), "int")))
        while open_nodes := [k for k, n in enumerate(nodes) if n.leaves > 1 and n.cut is None]:
            width = [max(1, -(-(n.high - n.low + 1) // BINS)) for n in nodes]
            low, high = (_at([getattr(n, x) for n in nodes], F.col("_node"), "long") for x in ("low", "high"))
            wide = _at(width, F.col("_node"), "long")
            # rows outside the range have no bin: a filter would be pushed below the tree's projections and copy them
            inside = (F.col("_key") >= F.col("_low")) & (F.col("_key") <= F.col("_high"))
            part = placed.withColumns({"_low": low, "_high": high, "_wide": wide}).withColumn("_bin", F.when(inside, F.expr("(_key - _low) div _wide")))
            bins = part.groupBy("_node", "_bin")
            by: dict[int, dict[int, tuple[int, int]]] = {}
            for node, b, size, count in bins.agg(F.sum("size"), F.count(F.lit(1))).collect():  # nodes x bins at most
                if b is not None:
                    by.setdefault(node, {})[b] = size, count
            for k in open_nodes:
                n, sums = nodes[k], by.get(k, {})
                below = n.below
                chosen = None
                for b in sorted(sums):
                    chosen = b
                    if below + sums[b][0] >= n.want:
                        break
                    below += sums[b][0]
                if chosen is None:
                    n.cut = n.low
                    continue
                size, count = sums[chosen]
                begin = n.low + chosen * width[k]
                end = min(begin + width[k] - 1, n.high)
                if width[k] == 1 or count == 1 or size <= tolerance * (total or 0) / shards:
                    n.cut = end if below + size - n.want <= n.want - below else begin - 1
                else:
                    n.low, n.high, n.below = begin, end, below
        below_level = []
        for n in nodes:
            n.kids = [Node(n.leaves // 2), Node(n.leaves - n.leaves // 2)] if n.leaves > 1 else [Node(1), Node(0)]
            below_level += n.kids
        levels.append(below_level)
    return levels


def cut_key(dim: Column) -> Column:
    """The dimension's 31 bits, then the leading 31 bits of the row hash."""
    return F.get(F.col("_dims"), dim.cast("int")) * _HALF + F.shiftright("row_hash", 32)


def assign(df: DataFrame, levels: list[list[Node]], out: str) -> DataFrame:
    """Adds the node of the level below the last of ``levels`` that a row belongs to.

    One projection a level: each reads the node of the level before more than once, so the
    optimizer keeps them apart.
    """
    df = df.withColumn(out, F.lit(0))
    for nodes in levels:
        node = F.col(out)
        df = df.withColumn("_cut_dim", _at([n.dim for n in nodes], node, "int"))
        right = (_at([n.leaves for n in nodes], node, "int") > 1) & (cut_key(F.col("_cut_dim")) > _at([n.cut if n.cut is not None else 0 for n in nodes], node, "long"))
        df = df.withColumn(out, node * 2 + right.cast("int")).drop("_cut_dim")
    return df


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document."""
    meta = metadata(docs)
    levels = build_tree(meta, shards, tolerance)
    number, numbers = 0, []
    for n in levels[-1]:
        numbers.append(number if n.leaves else -1)
        number += n.leaves
    df = assign(meta, levels[:-1], "_leaf").withColumn("shard", _at(numbers, F.col("_leaf"), "int"))
    n_rows = meta.count()
    df = df.select("doc_id", "size", "text_crc32", "shard", "row_hash", F.lit(1).cast("long").alias("_one"), bucket_bits(F.lit(n_rows / shards)).alias("_bits"))
    df = prefix_sums(df, "shard", "row_hash", "_one", "_bits", "slot")
    return df.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


QUERIES = {"op5_kd_sharding": op5_kd_sharding}
SQL: dict[str, str] = {}
