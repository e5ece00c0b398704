"""Benchmark decontamination over a distributed positional inverted index.

The training text is indexed once and the index is stored (``build_index``): documents
are cut into pieces of a bounded size, and a piece's row holds its terms, how often each
occurs, and the places of every term in order (its postings). The test windows are the
queries. How rare a test term is comes from the stored postings of all pieces. For each
window a task takes the postings of its rarest term in a piece, shifts them by the term's
offset, and intersects them with the shifted postings of the next rarest terms until all
terms of the window stand in place: an exact match. An item is near by where its rarest
terms all stand close to an occurrence of the rarest. No document is shuffled.

The queries pass in blocks of a bounded size (``block_bytes`` of item text), one after
the other: a block's queries are broadcast, searched for in all pieces, and let go; what
the blocks found is merged per document. So neither side is ever gathered whole.

Edge cases: null or empty texts have no words and no hits; items without words match
nothing; an item of fewer words than the width is one window; equal items and repeated
documents count one by one, whatever their ids, null included; an empty benchmark leaves
all documents clean; an empty table gives no rows. Only the id and text columns are read,
so other columns cannot clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import letter_words, stored, table

WIDTH = 10
BLOCK_BYTES = 16 << 20
#: Text that a task indexes at a time, and candidate places that it holds at a time.
INDEX_BYTES, CANDIDATES = 4 << 20, 1 << 20
#: Proximity: so many of an item's rarest terms within its length plus the slack.
NEAR_TERMS, NEAR_SLACK = 4, 5


class Queries:
    """Windows and rare terms of a block of items, as arrays."""

    def __init__(self, items: list[tuple[str, bytes | None]], width: int = WIDTH):
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], list[int]] = {}
        holders: dict[int, int] = {}
        words = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in letter_words(text)] for _, text in items]
        for k, own in enumerate(words):
            for t in set(own):
                holders[t] = holders.get(t, 0) + 1
            for p in range(max(1, len(own) - width + 1) if own else 0):
                windows.setdefault(tuple(own[p : p + width]), []).append(k)
        self.terms = np.full((len(windows), width), -1, np.int64)
        for r, w in enumerate(windows):
            self.terms[r, : len(w)] = w
        self.lengths = np.array([len(w) for w in windows], np.int64)
        held = [sorted(set(v)) for v in windows.values()]
        self.owner_at = np.cumsum([0, *map(len, held)])
        self.owners = np.array([k for v in held for k in v], np.int64)
        spelled = {v: k for k, v in self.vocabulary.items()}
        self._spelled, self._words = spelled, [set(own) for own in words]
        self.spans = [len(own) + NEAR_SLACK for own in words]
        self.rank(holders)

    def rank(self, counts: dict[int, int]) -> None:
        """Chooses each item's rarest terms by the counts of terms; ties go by spelling."""
        self.rare = [sorted(own, key=lambda t: (counts.get(t, 0), self._spelled[t]))[:NEAR_TERMS] for own in self._words]


class Postings:
    """Positional index of some documents: composite keys term * size + place, in order.

    Documents follow each other with one empty place between, so no window reaches over an end.
    """

    def __init__(self, n_words: list[int], terms: np.ndarray, counts: np.ndarray, places: np.ndarray, n_terms: int):
        """``terms`` ascending, with ``counts`` places each; numbers of terms are those of the queries."""
        self.n_words = n_words
        self.at = np.cumsum([0, *(n + 1 for n in n_words)])
        self.size = int(self.at[-1])
        self.counts = np.zeros(n_terms, np.int64)
        self.counts[terms] = counts
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.keys = np.repeat(terms, counts) * self.size + places

    @classmethod
    def of_texts(cls, texts: list[bytes | None], vocabulary: dict[bytes, int]) -> Postings:
        piece = Piece(texts, vocabulary)
        return cls(piece.n_words, np.arange(len(vocabulary)), piece.counts, piece.places, len(vocabulary))

    @classmethod
    def of_stored(cls, n_words: list[int], words: list[bytes], counts: np.ndarray, places: np.ndarray, vocabulary: dict[bytes, int]) -> Postings:
        """Only the lists of terms that the queries use."""
        get = vocabulary.get
        numbers = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        own = np.flatnonzero(numbers >= 0)
        own = own[np.argsort(numbers[own])]
        begin = np.cumsum(counts, dtype=np.int64) - counts
        lists = [places[b : b + n] for b, n in zip(begin[own].tolist(), counts[own].tolist(), strict=True)]
        return cls(n_words, numbers[own], counts[own].astype(np.int64), np.concatenate(lists) if lists else np.array([], np.int64), len(vocabulary))

    def shifted(self, terms: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of each term less its offset, with the number of the term in the call."""
        n = self.counts[terms]
        row = np.repeat(np.arange(len(terms)), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        return row, self.keys[self.first[terms][row] + nth] - terms[row] * self.size - offsets[row]

    def holds(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Whether the term's list has the place: one step of an intersection."""
        inside = (places >= 0) & (places < self.size)
        key = terms * self.size + np.where(inside, places, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return inside & (self.keys[at] == key)

    def phrases(self, q: Queries) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, start) of all exact occurrences, in pieces."""
        if not len(self.keys) or not len(q.terms):
            return
        n = np.where(q.terms >= 0, self.counts[q.terms], self.size + 1)
        live = np.flatnonzero(n.min(axis=1) > 0)
        order = np.argsort(n[live], axis=1, kind="stable")
        rarest = q.terms[live, order[:, 0]]
        upto = np.cumsum(self.counts[rarest])
        cuts = np.searchsorted(upto, np.arange(CANDIDATES, upto[-1] + CANDIDATES, CANDIDATES)) + 1 if len(live) else []
        begin = 0
        for end in cuts:
            end = min(int(end), len(live))
            if begin >= end:
                continue
            row, start = self.shifted(rarest[begin:end], order[begin:end, 0])
            row += begin
            for k in range(1, q.terms.shape[1]):
                offset = order[row, k]
                term = q.terms[live[row], offset]
                ok = (term < 0) | self.holds(np.maximum(term, 0), start + offset)
                row, start = row[ok], start[ok]
            ok = start >= 0
            yield live[row[ok]], start[ok]
            begin = end

    def near(self, q: Queries) -> list[tuple[int, int]]:
        """(document, item) where all rare terms of the item stand close to its rarest one."""
        found = []
        for item, terms in enumerate(q.rare):
            if not terms or not len(self.keys) or min(self.counts[t] for t in terms) == 0:
                continue
            _, places = self.shifted(np.array(terms[:1]), np.array([0]))
            doc = np.searchsorted(self.at, places, side="right") - 1
            ok = np.ones(len(places), bool)
            for t in terms[1:]:
                low = np.maximum(places - q.spans[item], self.at[doc])
                high = np.minimum(places + q.spans[item], self.at[doc + 1] - 1)
                ok &= np.searchsorted(self.keys, t * self.size + high, side="right") > np.searchsorted(self.keys, t * self.size + low)
            found += [(int(d), item) for d in np.unique(doc[ok])]
        return found


class Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Piece:
    """Terms of some texts, how often each occurs, and the places of each in order, one term after the other.

    Terms are those of a given vocabulary, or all terms in the order of their first places.
    """

    def __init__(self, texts: list[bytes | None], vocabulary: dict[bytes, int] | None = None):
        numbers: dict[bytes, int] = Numbers() if vocabulary is None else vocabulary
        self.n_words, found, places, at = [], [], [], 0
        for text in texts:
            words = letter_words(text)
            if vocabulary is None:
                own, here = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)), np.arange(len(words))
            else:
                get = numbers.get
                own = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
                here = np.flatnonzero(own >= 0)
                own = own[here]
            found.append(own)
            places.append(here + at)
            self.n_words.append(len(words))
            at += len(words) + 1
        terms = np.concatenate(found) if found else np.array([], np.int32)
        self.words = list(numbers)
        self.counts = np.bincount(terms, minlength=len(numbers)).astype(np.int64)
        order = np.argsort(terms.astype(np.uint16) if len(numbers) <= 1 << 16 else terms, kind="stable")  # short keys sort by digits
        self.places = (np.concatenate(places) if places else np.array([], np.int64))[order]


def _pieces(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    begin, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or b"")
        if size >= INDEX_BYTES or k + 1 == len(texts):
            yield begin, k + 1
            begin, size = k + 1, 0


def _found(index: Postings, q: Queries, near: bool) -> Iterator[tuple[np.ndarray, set[int], set[int]]]:
    """Per document of the piece: which of its words are hit, items found exactly, items found near by."""
    delta = np.zeros(index.size + 1, np.int64)
    items: list[set[int]] = [set() for _ in index.n_words]
    for window, start in index.phrases(q):
        np.add.at(delta, start, 1)
        np.add.at(delta, start + q.lengths[window], -1)
        doc = np.searchsorted(index.at, start, side="right") - 1
        for d, w in set(zip(doc.tolist(), window.tolist(), strict=True)):
            items[d].update(q.owners[q.owner_at[w] : q.owner_at[w + 1]].tolist())
    hit = np.cumsum(delta) > 0
    close: list[set[int]] = [set() for _ in index.n_words]
    for d, item in index.near(q) if near else ():
        close[d].add(item)
    for d in range(len(index.n_words)):
        yield hit[index.at[d] : index.at[d + 1] - 1], items[d], close[d]


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes | None]]]:
    """Items in blocks of a bounded size; the driver holds one at a time."""
    block, size = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).toLocalIterator():
        block.append((item, bytes(text) if text is not None else None))
        size += len(text or b"") + 64
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


INDEX = "piece string, doc_ids array<long>, n_words array<long>, words binary, counts binary, places binary"


def build_index(docs: DataFrame) -> DataFrame:
    """The positional index of all words of all texts, one row a piece, stored in the shared folder."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
            for begin, end in _pieces(texts):
                p = Piece(texts[begin:end])
                row = [uuid.uuid4().hex], [ids[begin:end].to_pylist()], [p.n_words], [b" ".join(p.words)], [p.counts.astype(np.int32).tobytes()], [p.places.astype(np.int32).tobytes()]
                kinds = pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], names=["piece", "doc_ids", "n_words", "words", "counts", "places"])

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(index, INDEX), "postings")


def term_counts(index: DataFrame, vocabulary: dict[bytes, int]) -> dict[int, int]:
    """How often the terms of the vocabulary occur in all pieces: one row a term comes back, for a block's vocabulary."""
    held = index.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(held.value), np.int64)
        get = held.value.get
        for batch in batches:
            for words, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                numbers = np.fromiter((get(w, -1) for w in words.split()), np.int64)
                known = numbers >= 0
                total[numbers[known]] += np.frombuffer(counts, np.int32)[known]
        terms = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(total[terms], pa.int64())], names=["term", "n"])

    rows = index.select("words", "counts").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    held.unpersist()
    return {r["term"]: r["n"] for r in rows}


def search_index(index: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """piece, nth (document of the piece), hits (runs of hit words), item_ids and near_ids, where a block of items found any."""
    found = None
    for block in _blocks(benchmark, block_bytes):
        queries = Queries(block, width)
        queries.rank(term_counts(index, queries.vocabulary))
        held = index.sparkSession.sparkContext.broadcast(queries)

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            q = held.value
            for batch in batches:
                for piece, n_words, words, counts, places in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    own = Postings.of_stored(n_words, words.split(), np.frombuffer(counts, np.int32), np.frombuffer(places, np.int32), q.vocabulary)
                    out: list[list] = [[], [], [], [], []]
                    for d, (hit, items, close) in enumerate(_found(own, q, True)):
                        if items or close:
                            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                            row = piece, d, [{"first": int(b), "end": int(e)} for b, e in edge.reshape(-1, 2)], [q.ids[i] for i in sorted(items)], [q.ids[i] for i in sorted(close)]
                            for c, v in zip(out, row, strict=True):
                                c.append(v)
                    kinds = pa.string(), pa.int32(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string()), pa.list_(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["piece", "nth", "hits", "item_ids", "near_ids"])

        schema = "piece string, nth int, hits array<struct<first:long,end:long>>, item_ids array<string>, near_ids array<string>"
        part = stored(index.select("piece", "n_words", "words", "counts", "places").mapInArrow(search, schema), "matches")
        held.unpersist()
        found = part if found is None else found.unionByName(part)
    if found is None:
        none = F.array().cast("array<string>")
        return index.limit(0).select("piece", F.lit(0).alias("nth"), F.array().cast("array<struct<first:long,end:long>>").alias("hits"), none.alias("item_ids"), none.alias("near_ids"))
    return found


def find_matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (exact) and near_ids (proximity) of every document; ids distinct and in order."""
    index = build_index(docs)
    found = search_index(index, benchmark, width, block_bytes)
    per = found.groupBy("piece", "nth").agg(*[F.array_sort(F.flatten(F.collect_list(c))).alias(c) for c in ("hits", "item_ids", "near_ids")])
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    joined = F.aggregate("hits", start, lambda s, x: F.struct(F.greatest(s["end"], x["end"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["end"], x["first"]))).alias("n")), lambda s: s["n"])
    per = per.select(F.col("piece").alias("_piece"), F.col("nth").alias("_nth"), joined.alias("_hit"), F.array_distinct("item_ids").alias("_items"), F.array_distinct("near_ids").alias("_near"))
    rows = index.select("piece", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("nth", "d")).select("piece", "nth", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").alias("n_words"))
    none = F.array().cast("array<string>")
    j = rows.join(per, (F.col("piece") == F.col("_piece")) & (F.col("nth") == F.col("_nth")), "left")
    return j.select("doc_id", "n_words", F.coalesce("_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("_items", none).alias("item_ids"), F.coalesce("_near", none).alias("near_ids"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no window of any item occurs, with the columns they came with.

    The rows pass by, so each batch is indexed on the way and only the decision is kept.
    """
    spark, schema, at, block = docs.sparkSession, docs.schema, docs.columns.index("text"), None
    for b in _blocks(benchmark, block_bytes):
        if block:  # a further block works on what the one before has left, and that one's queries go
            docs = stored(docs, "clean")
            block.unpersist()
        block = spark.sparkContext.broadcast(Queries(b, width))

        def clean(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, keep = batch.column(at).cast(pa.binary()).to_pylist(), []
                for begin, end in _pieces(texts):
                    keep += [not items for _, items, _ in _found(Postings.of_texts(texts[begin:end], block.value.vocabulary), block.value, False)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(clean, schema)
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    said = lambda c: F.sha2(F.array_join(c, ","), 256)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), said("item_ids").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_ids").cast("long").alias("n_near"), said("near_ids").alias("near_sha256"),
    )


QUERIES = {"op3_decontamination": op3_decontamination}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = {
    "op3_decontamination": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT row_number() OVER () AS bid, item_id, {_WORDS} AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[p:p + 9], ' ') AS gram
  FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS u(p) WHERE len(ws) > 0),
lens AS (SELECT DISTINCT n FROM w),
g AS (SELECT rid, p, lens.n, array_to_string(ws[p:p + lens.n - 1], ' ') AS gram
  FROM d, lens, unnest(range(1, greatest(len(ws) - lens.n + 1, 0) + 1)) AS u(p)),
m AS (SELECT g.rid, g.p, g.n, w.item_id FROM g JOIN w ON g.n = w.n AND g.gram = w.gram),
h AS (SELECT rid, count(DISTINCT q) AS n_hit FROM m, unnest(range(p, p + n)) AS u(q) GROUP BY rid),
i AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM m GROUP BY rid),
t AS (SELECT DISTINCT bid, item_id, len(ws) + 5 AS span, unnest(ws) AS word FROM b),
p AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS at FROM d),
c AS (SELECT word, count(*) AS n FROM p WHERE word IN (SELECT word FROM t) GROUP BY word),
r AS (SELECT bid, item_id, span, word, row_number() OVER (PARTITION BY bid ORDER BY coalesce(n, 0), word) AS k FROM t LEFT JOIN c USING (word) QUALIFY k <= 4),
k AS (SELECT bid, count(*) AS terms FROM r GROUP BY bid),
x AS (SELECT r.bid, r.item_id, r.span, p.rid, p.at FROM r JOIN p USING (word) WHERE r.k = 1),
y AS (SELECT x.bid, x.item_id, x.rid, x.at, count(DISTINCT p.word) AS met FROM x JOIN r USING (bid)
  JOIN p ON p.rid = x.rid AND p.word = r.word AND p.at BETWEEN x.at - x.span AND x.at + x.span GROUP BY ALL),
z AS (SELECT rid, count(DISTINCT item_id) AS n_near, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM y JOIN k USING (bid) WHERE met = terms GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near, sha256(coalesce(z.ids, '')) AS near_sha256
FROM d LEFT JOIN h USING (rid) LEFT JOIN i USING (rid) LEFT JOIN z USING (rid)"""
}
