"""N-gram Jaccard join by vertical partitioning.

Word shingles are hashed to 64 bits; the order of the hashes is the global n-gram order.

1. Documents with the same set are one class (its set hash); only classes go on.
2. Candidates. The order is cut into fragments, more of them than two linked sets of that
   size can differ in n-grams. Then at least one fragment of a linked pair is equal, so a
   class is filed once per fragment, under the hash of the n-grams it has there. The
   number of fragments depends on the size range of the larger set, so a class is filed
   for its own range and for the next. Empty fragments prove nothing: where they leave too
   few others, the class is filed under twice as many fragments as well, and so on. There
   are some fragments to spare, and each class leaves out as many, the commonest first:
   passages that unrelated documents share make no candidates.
3. Verification. The order is cut into ``FRAGMENTS`` fragments. Of every candidate pair the
   n-grams of both sets in one fragment meet in one task, the partial overlap is counted
   there by itself, and the partial overlaps are summed per pair.
4. Not every candidate pair has to be verified. First every class is held against one
   other, the first class of the key that it shares most. What is linked is one component.
   Then only keys are open whose classes are not in one component yet. Under an open key
   of few classes all pairs between components are verified one by one. Open keys of many
   classes that share classes are a crowd. In a crowd the classes outside its largest
   component are held against all others, block by block: a task has the n-grams of two
   blocks in one fragment and counts a table of partial overlaps, and the tables of two
   blocks are summed. Of the linked pairs of two blocks only those leave the task that join
   components. So thousands of near copies cost a few comparisons a class, and no link
   between components is missed.
5. Components of the links, and back to the documents by their classes.

Edge cases: null texts, empty texts and texts without a word have an empty set, are
linked with nothing and keep their own id; a text of fewer words than a shingle is one
n-gram; repeated rows fall into one class; rows without an id are linked with nothing;
ids are taken for unique: if the smallest id of a class has other texts too, links of one
of its texts count for all of them; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import checkpointed, small_batches, space_words, stored, table
from quire.llm.components import connected_components

WORDS, PERCENT = 4, 85
#: Fragments that overlaps are counted in, each by itself.
FRAGMENTS = 8
#: Sets that are held against one other in one task; classes of an open key from which on it goes by blocks; sets of a block.
SALT, CROWD, BLOCK = 512, 16, 1024
#: Hashes that a task counts at a time.
HELD = 1 << 20
#: Fragments above the least number, as a share of it, and from what number on a key is just common.
SPARE, COMMON = 0.2, 1024
#: Documents whose filings go out together.
PIECE = 512
#: Words whose hashes a task keeps.
KNOWN = 100_000
#: Members up to this number are broadcast to the scan of the texts; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MUL[0]
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Sets of shingle hashes of texts; the hashes of words are kept while there are few."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, {}

    def _hash(self, w: bytes) -> int:
        h = self.known[w] = xxhash.xxh64_intdigest(w)
        return h

    def sets(self, text: bytes | None) -> np.ndarray:
        tokens = space_words(text)
        if not tokens:
            return np.array([], np.uint64)
        if len(self.known) > KNOWN:
            self.known.clear()
        get, new = self.known.get, self._hash
        h = np.array([get(t) or new(t) for t in tokens], np.uint64)
        k = min(self.words, len(h))
        n = len(h) - k + 1
        out = np.full(n, k, np.uint64)
        for j in range(k):
            out = out * _MUL[1 + j % 5] + h[j : j + n]
        return np.unique(mixed(out))


@cache
def range_starts(percent: int) -> np.ndarray:
    """Where ranges of set sizes start; sizes of linked sets lie in the same range or in the next."""
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(starts[-1] * 100 // percent + 1)
    return np.array(starts)


def differences(top: int, percent: int) -> int:
    """Most n-grams in which two linked sets of at most ``top`` can differ."""
    return (100 - percent) * 2 * top // (100 + percent)


def filings(hashes: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The keys that a set is filed under, and how many of the commonest of each range and level may be left out.

    The last 12 bits of a key tell its range and level. Of the fragments that are not
    empty, ``most`` at most can differ between linked sets; the rest are equal. So each of
    two linked sets may leave out all but ``most + 1``, if both choose by the same order.
    """
    starts, n, keys, spare = range_starts(percent), len(hashes), [], []
    own = int(np.searchsorted(starts, n, side="right")) - 1
    for r in (own, own + 1):
        most = differences(int(starts[r + 1]) - 1, percent)
        fragments = most + 1 + int(SPARE * (most + 1)) + 2
        for level in range(16):
            # fragment = the hash's place in the order, scaled to the number of fragments
            of = ((hashes >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            sums = np.add.reduceat(mixed(hashes + np.uint64(1)), first)
            key = mixed(sums * _MUL[2] + of[first] * _MUL[3] + np.uint64(fragments * int(_MUL[4]) + r & 0xFFFFFFFFFFFFFFFF))
            keys.append((key & ~np.uint64(0xFFF)) | np.uint64((r & 0xFF) << 4 | level))
            spare.append(np.full(len(key), max(0, len(key) - most - 1), np.int32))
            if len(first) > most:
                break
            fragments *= 2
    return np.concatenate(keys), np.concatenate(spare)


def set_key(hashes: np.ndarray) -> bytes | None:
    return xxhash.xxh128_digest(hashes.tobytes()) if len(hashes) else None


def _texts(batch: pa.RecordBatch, at: int = 1) -> list[bytes | None]:
    return batch.column(at).cast(pa.binary()).to_pylist()


def document_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and set_key of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler(words)
        for batch in batches:
            sets = [own.sets(t) for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.binary())], names=["doc_id", "n_shingles", "set_key"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_key binary")


def filed_together(docs: DataFrame, head_of: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """key, id, head, nth: classes filed under the same key, by their ids, the smallest of them and the place in their order.

    head_of (doc_id, head): documents that another one of the same set stands for.
    """

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = Shingler(words), set()
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), _texts(batch)
            for begin in range(0, len(texts), PIECE):
                keys, spare, owners = [], [], []
                for k in range(begin, min(begin + PIECE, len(texts))):
                    s = own.sets(texts[k])
                    if len(s) and (key := set_key(s)) not in seen:  # copies in one task are filed once
                        seen.add(key)
                        filed = filings(s, percent)
                        keys.append(filed[0].view(np.int64))
                        spare.append(filed[1])
                        owners.append(np.full(len(keys[-1]), ids[k], np.int64))
                if len(seen) > 1_000_000:
                    seen.clear()
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, owners, spare)], names=["key", "doc_id", "spare"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of key; keeps those whose key is found again, with its frequency up to ``COMMON``."""
        held, flushed = [np.array([], np.int64)] * 3, False
        for batch in batches:
            rows = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
            if not len(rows[0]):
                continue
            yield from counted(rows, tail := int(np.searchsorted(rows[0], rows[0][-1])), flushed)
            flushed = flushed and tail == 0
            held = [c[tail:] for c in rows]
            if len(held[0]) > COMMON:  # a key that common needs no exact count
                yield from counted([c[:-1] for c in held], len(held[0]) - 1, True)
                held, flushed = [c[-1:] for c in held], True
        yield from counted(held, len(held[0]), flushed)

    def counted(rows: list[np.ndarray], end: int, common: bool) -> Iterator[pa.RecordBatch]:
        """common: rows of the first key have gone out before."""
        k = rows[0][:end]
        if end:
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            n = np.diff(np.append(first, end))
            n[0] = COMMON if common else n[0]
            n = np.repeat(np.minimum(n, COMMON), np.diff(np.append(first, end)))
            yield pa.RecordBatch.from_arrays([pa.array(x[:end][n > 1]) for x in rows[:2]] + [pa.array(rows[2][:end][n > 1].astype(np.int32)), pa.array(n[n > 1].astype(np.int32))], names=["key", "doc_id", "spare", "n"])

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of key and id: drops equal ones and keys of a single id, adds the first id and the place."""
        last, head, nth = None, 0, 0  # the last row, its key's first id, its place
        for batch in batches:
            k, d = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if last is not None:
                k, d = np.concatenate([[last[0]], k]), np.concatenate([[last[1]], d])
            if not len(k):
                continue
            keep = np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])
            k, d = k[keep], d[keep]
            fresh = np.concatenate([[last is None], k[1:] != k[:-1]])
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(k)), -1))
            heads = np.where(begin >= 0, d[np.maximum(begin, 0)], head)
            places = np.where(begin >= 0, np.arange(len(k)) - begin, np.arange(len(k)) + nth)
            more = places > 0
            more[:-1] |= k[1:] == k[:-1]  # the first of a key goes out when the second has come
            if last is not None and nth > 0:
                more[0] = False  # has gone out before
            out = more.copy()
            out[-1] &= places[-1] > 0
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (k, d, heads, places)], names=["key", "id", "head", "nth"])
            last, head, nth = (k[-1], d[-1]), heads[-1], int(places[-1])

    filed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL").mapInArrow(file, "key long, doc_id long, spare int")
    again = filed.repartition("key").sortWithinPartitions("key").mapInArrow(shared, "key long, doc_id long, spare int, n int")
    rank = F.row_number().over(Window.partitionBy("doc_id", F.expr("key & 4095")).orderBy(F.desc("n"), F.desc("key")))
    kept = again.withColumn("_rank", rank).filter("_rank > spare").select("key", F.col("doc_id").alias("id"))
    small = F.broadcast(head_of) if head_of.count() <= BROADCAST_ROWS else head_of
    kept = kept.join(small, kept["id"] == head_of["doc_id"], "left").select("key", F.coalesce("head", "id").alias("id"))
    return kept.repartition("key").sortWithinPartitions("key", "id").mapInArrow(ranked, "key long, id long, head long, nth long")


def partial_overlaps(own: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """How many n-grams of ``own`` (in order) each of the sets has."""
    if not len(own) or not sets:
        return np.zeros(len(sets), np.int64)
    h = np.concatenate(sets)
    hit = own[np.minimum(np.searchsorted(own, h), len(own) - 1)] == h
    return np.bincount(np.repeat(np.arange(len(sets)), [len(x) for x in sets])[hit], minlength=len(sets))


def linked_pairs(docs: DataFrame, pairs: DataFrame, words: int = WORDS, percent: int = PERCENT, fragments: int = FRAGMENTS) -> DataFrame:
    """Those of the pairs (a, b) of ids that are linked: partial overlaps per fragment, summed per pair."""
    # the sets that are held against b meet it in as many tasks as it takes
    salts = stored(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SALT).cast("int").alias("salts")), "salts")
    one = pairs.join(salts, "b").select(F.col("a").alias("id"), F.col("b").alias("unit"), F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"))
    other = salts.select(F.col("b").alias("id"), F.col("b").alias("unit"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    at = one.unionByName(other).groupBy(F.col("id").alias("_id")).agg(F.collect_list(F.struct("unit", "salt")).alias("at"))
    at = F.broadcast(at) if pairs.count() <= BROADCAST_ROWS else at
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(at, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "at")
    schema = "unit long, salt int, fragment int, other boolean, id long, own long, n long, hashes binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets cut into fragments, sent to every task that needs them."""
        shingler = Shingler(words)
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            size = 0
            for id_, text, units in zip(batch.column(0).to_pylist(), _texts(batch), batch.column(2).to_pylist(), strict=True):
                s = shingler.sets(text)
                if not len(s):
                    continue
                own = xxhash.xxh64_intdigest(s.tobytes()) >> 1
                of = (s >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)
                ends = np.searchsorted(of, np.arange(fragments), side="right").tolist()
                for f, (b, e) in enumerate(zip([0, *ends], ends)):
                    if e > b:
                        part = s[b:e].tobytes()
                        for u in units:
                            for c, v in zip(out, (u["unit"], u["salt"], f, u["unit"] != id_, id_, own, len(s), part), strict=True):
                                c.append(v)
                            size += len(part)
                        if size > 4 << 20:
                            yield sent(out)
                            out, size = [[] for _ in range(8)], 0
            yield sent(out)

    def sent(out: list[list]) -> pa.RecordBatch:
        kinds = pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a unit come together, the set that the others are held against first."""
        unit: tuple | None = None
        centre: dict[int, tuple[int, np.ndarray]] = {}
        held: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
        size = 0

        def counted() -> pa.RecordBatch:
            cols: list[list] = [[] for _ in range(7)]
            for own, (n, hashes) in centre.items():
                c = partial_overlaps(hashes, [x[1] for x in held.values()])
                for ((id_, other), (m, _)), overlap in zip(held.items(), c.tolist(), strict=True):
                    if overlap:
                        for col, v in zip(cols, (id_, other, unit[0], own, m, n, overlap), strict=True):
                            col.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "own_a", "b", "own_b", "n_a", "n_b", "overlap"])

        for batch in batches:
            for u, salt, f, other, id_, own, n, hashes in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (u, salt, f) != unit:
                    if held:
                        yield counted()
                    unit, centre, held, size = (u, salt, f), {}, {}, 0
                row = n, np.frombuffer(hashes, np.uint64)
                if not other:
                    centre[own] = row
                    continue
                if (id_, own) not in held and size > HELD:  # rows of an id and set come together: equal ones count once
                    yield counted()
                    held, size = {}, 0
                held[id_, own] = row
                size += len(row[1])
        if held:
            yield counted()

    parts = rows.mapInArrow(cut, schema).repartition("unit", "salt", "fragment").sortWithinPartitions("unit", "salt", "fragment", "other", "id", "own")
    sums = parts.mapInArrow(count, "a long, own_a long, b long, own_b long, n_a long, n_b long, overlap long").groupBy("a", "own_a", "b", "own_b").agg(F.sum("overlap").alias("o"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    return sums.filter(F.col("o") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("o")) * percent).select("a", "b").distinct()


def named(rows: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """Adds the component of the id in a column; ids without a label are their own."""
    labels = F.broadcast(labels) if labels.count() <= BROADCAST_ROWS else labels
    return rows.join(labels, rows[column] == labels["node"], "left").withColumn(f"{column}_in", F.coalesce("component", column)).drop("node", "component")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (node, component) after some more links (a, b) of ids."""
    joined = named(named(links, "a", labels), "b", labels).select(F.col("a_in").alias("a"), F.col("b_in").alias("b"))
    to = stored(connected_components(joined).select(F.col("node").alias("_from"), F.col("component").alias("_to")), "merged")
    known = labels.join(to, F.col("component") == F.col("_from"), "left").select("node", F.coalesce("_to", "component").alias("component"))
    fresh = to.join(labels, F.col("_from") == F.col("node"), "left_anti").select(F.col("_from").alias("node"), F.col("_to").alias("component"))
    return stored(known.unionByName(fresh), "labels")


def still_open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """key, id, nth, id_in (its component), last (the last place) of keys whose ids are not in one component."""
    rows = named(rows.select("key", "id", "nth"), "id", labels)
    keys = rows.groupBy("key").agg(F.min("id_in").alias("_least"), F.max("id_in").alias("_most"), F.max("nth").alias("last")).filter("_least < _most").select("key", "last")
    return stored(rows.join(stored(keys, "open"), "key"), "rows")


def linked_components(docs: DataFrame, together: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(node, component) of all linked ids; together: rows of ``filed_together``."""
    stars = together.filter("id != head").groupBy("id", "head").agg(F.count(F.lit(1)).alias("n"))
    stars = stored(stars.groupBy(F.col("id").alias("a")).agg(F.max_by("head", F.struct(F.col("n"), -F.col("head"))).alias("b")), "pairs")
    labels = stored(connected_components(linked_pairs(docs, stars, words, percent)), "labels")
    rows = still_open(together, labels)
    few = rows.filter(F.col("last") < CROWD)
    ahead = few.select("key", F.col("id").alias("a"), F.col("id_in").alias("a_in"), F.explode(F.sequence(F.col("nth") + 1, F.col("nth") + CROWD)).alias("nth"))
    met = ahead.join(few.select("key", "nth", F.col("id").alias("b"), F.col("id_in").alias("b_in")), ["key", "nth"]).filter("a_in != b_in")
    pairs = stored(met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().join(stars, ["a", "b"], "left_anti"), "pairs")
    if not pairs.isEmpty():
        labels = merged(labels, linked_pairs(docs, pairs, words, percent))
    crowds = rows.filter(F.col("last") >= CROWD)
    if crowds.isEmpty() or (crowds := still_open(crowds, labels)).isEmpty():
        return labels
    return merged(labels, crowd_links(docs, crowds, words, percent))


def crowd_links(docs: DataFrame, rows: DataFrame, words: int = WORDS, percent: int = PERCENT, fragments: int = FRAGMENTS) -> DataFrame:
    """(a, b): enough linked pairs to join what the crowds' links join; rows of ``still_open``."""
    crowds = stored(connected_components(rows.filter("nth > 0").join(rows.filter("nth = 0").select("key", F.col("id").alias("b")), "key").select(F.col("id").alias("a"), "b")), "crowds")
    ids = rows.select(F.col("id").alias("node"), "id_in").distinct().join(crowds, "node").withColumnRenamed("component", "crowd")
    per = ids.groupBy("crowd", "id_in").agg(F.count(F.lit(1)).alias("n"))
    per = stored(per.groupBy("crowd").agg(F.sum("n").alias("n_all"), F.max("n").alias("_n"), F.max_by("id_in", F.struct("n", "id_in")).alias("largest")), "sizes")
    ids = ids.join(per, "crowd").withColumns({"_left": F.ceil((F.col("n_all") - F.col("_n")) / BLOCK).cast("int"), "_right": F.ceil(F.col("n_all") / BLOCK).cast("int")})
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    left = ids.filter("id_in != largest").select("node", "crowd", place("_left").alias("i"), F.explode(F.sequence(F.lit(0), F.col("_right") - 1)).alias("j"), F.lit(True).alias("mine"))
    right = ids.select("node", "crowd", F.explode(F.sequence(F.lit(0), F.col("_left") - 1)).alias("i"), place("_right").alias("j"), F.lit(False).alias("mine"))
    at = left.unionByName(right).groupBy(F.col("node").alias("_id")).agg(F.collect_list(F.struct("crowd", "i", "j", "mine")).alias("at"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(stored(at, "places"), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "at")
    cut_schema = "crowd long, i int, j int, fragment int, mine boolean, id long, own long, n long, hashes binary"
    table_schema = "crowd long, i int, j int, ids_a binary, ids_b binary, overlaps binary, wide int"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        kinds = pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()
        names = [x.split()[0] for x in cut_schema.split(", ")]
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            size = 0
            for id_, text, units in zip(batch.column(0).to_pylist(), _texts(batch), batch.column(2).to_pylist(), strict=True):
                s = shingler.sets(text)
                own = xxhash.xxh64_intdigest(s.tobytes()) >> 1
                of = (s >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)
                ends = np.searchsorted(of, np.arange(fragments), side="right").tolist()
                for f, (b, e) in enumerate(zip([0, *ends], ends)):
                    if e > b:
                        part = s[b:e].tobytes()
                        for u in units:
                            for c, v in zip(out, (u["crowd"], u["i"], u["j"], f, u["mine"], id_, own, len(s), part), strict=True):
                                c.append(v)
                            size += len(part)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)
                            out, size = [[] for _ in kinds], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tables of partial overlaps of two blocks in one fragment; rows of a unit come together."""
        unit, sides = None, ({}, {})

        def counted() -> pa.RecordBatch:
            a, b = sides
            table_ = table_of_overlaps([x[1] for x in a.values()], [x[1] for x in b.values()])
            wide = int(table_.max(initial=0) > 0xFFFF)
            ids = [np.array([(*k, n) for k, (n, _) in x.items()], np.int64).reshape(-1, 3).tobytes() for x in (a, b)]
            row = [unit[0]], [unit[1]], [unit[2]], [ids[0]], [ids[1]], [table_.astype(np.uint32 if wide else np.uint16).tobytes()], [wide]
            kinds = pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in table_schema.split(", ")])

        for batch in batches:
            for crowd, i, j, f, mine, id_, own, n, hashes in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (crowd, i, j, f) != unit:
                    if sides[0] and sides[1]:
                        yield counted()
                    unit, sides = (crowd, i, j, f), ({}, {})
                sides[0 if mine else 1][id_, own] = n, np.frombuffer(hashes, np.uint64)
        if sides[0] and sides[1]:
            yield counted()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums the tables of two blocks and keeps the linked pairs that it takes."""
        unit, total = None, None
        seen: tuple[dict, dict] = ({}, {})

        def linked() -> pa.RecordBatch:
            rows_, cols = (np.array(list(x), np.int64).reshape(-1, 3) for x in seen)
            t = total[: len(rows_), : len(cols)]
            union = rows_[:, 2][:, None] + cols[:, 2][None, :] - t
            x, y = np.nonzero((100 * t >= percent * union) & (rows_[:, 0][:, None] != cols[:, 0][None, :]))
            pairs = spanning(rows_[x, 0].tolist(), cols[y, 0].tolist())
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for crowd, i, j, a, b, overlaps, wide in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (crowd, i, j) != unit:
                    if unit:
                        yield linked()
                    unit, seen, total = (crowd, i, j), ({}, {}), np.zeros((0, 0), np.int64)
                at = [[x.setdefault(tuple(k), len(x)) for k in np.frombuffer(ids, np.int64).reshape(-1, 3).tolist()] for x, ids in zip(seen, (a, b), strict=True)]
                if total.shape[0] < len(seen[0]) or total.shape[1] < len(seen[1]):
                    total = np.pad(total, ((0, max(0, len(seen[0]) - total.shape[0])), (0, max(0, len(seen[1]) - total.shape[1]))))
                total[np.ix_(*at)] += np.frombuffer(overlaps, np.uint32 if wide else np.uint16).reshape(len(at[0]), len(at[1]))
        if unit:
            yield linked()

    parts = rows.mapInArrow(cut, cut_schema).repartition("crowd", "i", "j", "fragment").sortWithinPartitions("crowd", "i", "j", "fragment")
    tables = parts.mapInArrow(count, table_schema).repartition("crowd", "i", "j").sortWithinPartitions("crowd", "i", "j")
    return stored(tables.mapInArrow(link, "a long, b long"), "links")


def table_of_overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b``."""
    total = np.zeros((len(a), len(b)), np.int64)
    (ha, ra), (hb, rb) = ((np.concatenate(x), np.repeat(np.arange(len(x)), [len(s) for s in x])) for x in (a, b))
    shared = np.intersect1d(ha, hb)
    sides = []
    for h, r, n in ((ha, ra, len(a)), (hb, rb, len(b))) if len(shared) else ():
        at = np.minimum(np.searchsorted(shared, h), len(shared) - 1)
        in_ = shared[at] == h
        sides.append((r[in_], at[in_], n))
    for begin in range(0, len(shared), 2048):  # columns of a dense strip
        strip = []
        for r, at, n in sides:
            own = (at >= begin) & (at < begin + 2048)
            m = np.zeros((n, min(2048, len(shared) - begin)), np.float32)
            m[r[own], at[own] - begin] = 1
            strip.append(m)
        total += np.rint(strip[0] @ strip[1].T).astype(np.int64)
    return total


def spanning(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Of some links as many as it takes to join what they join."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    out = []
    for u, v in zip(a, b, strict=True):
        p, q = find(u), find(v)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((u, v))
    return out


def join_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, set_key and component_id of every document."""
    with small_batches(docs.sparkSession):
        sets = checkpointed(document_sets(docs, words))
        classes = checkpointed(sets.filter("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n")))
        head_of = stored(sets.join(classes.filter("n > 1"), "set_key").filter("doc_id != head").select("doc_id", "head").distinct(), "heads")
        together = stored(filed_together(docs, head_of, words, percent), "together")
        found = linked_components(docs, together, words, percent)
        labels = stored(classes.join(found, classes["head"] == found["node"], "left").select("set_key", F.coalesce("component", "head").alias("component")), "classes")
    return sets.join(labels, "set_key", "left").select("doc_id", "n_shingles", "set_key", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each component, that of the smallest id, with the columns it came with.

    Of rows that share an id, which repeated rows do, one stays; rows without an id all stay.
    """
    found = stored(join_components(docs, words, percent).select("doc_id", "component_id"), "components")
    drop = stored(found.filter("component_id != doc_id").select(F.col("doc_id").alias("_dropped")).distinct(), "dropped")
    drop = F.broadcast(drop) if drop.count() <= BROADCAST_ROWS else drop
    kept = docs.join(drop, docs["doc_id"] == drop["_dropped"], "left_anti")
    again = stored(found.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_again")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_again"), "again")
    if again.isEmpty():
        return kept
    again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    same = kept["doc_id"] == again["_again"]
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id"]))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op8_jaccard_join": op8_jaccard_join}
SQL: dict[str, str] = {}
