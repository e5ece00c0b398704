"""Language identification by prediction by partial matching.

Each language has a variable-order context tree over bytes: for every context of up to
``ORDER`` bytes the counts of the bytes that followed it in the learning texts. A byte
costs -log2 of its probability in the longest known context that has seen it, and every
longer known context that has not adds its escape cost (method C: distinct followers
over all followers plus distinct). Statistics are frozen: scoring changes nothing, so a
text has one exact code length per language, and the shortest wins.

Learning takes a bounded sample (``SAMPLE_DOCS`` documents and ``LANGUAGE_BYTES`` bytes a
language, the first by a hash of the id, whole texts, ``ALL_BYTES`` in all); the trees are merged into sorted tables of contexts and
broadcast, which that bound also bounds. Scoring looks the bytes of whole texts up in
those tables, many at a time; no document moves.

Edge cases: null texts and texts without a letter are ``und`` with score 0, and so is
everything if nothing could be learned; ties go to the first language by name; repeated
rows count one by one. Language, source and id are never read for a prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import table

ORDER = 4
#: Bounds of the learning sample: documents and bytes of one language, bytes of all languages.
SAMPLE_DOCS, LANGUAGE_BYTES, ALL_BYTES = 150, 2 << 20, 32 << 20
LETTER = re.compile(r"[^\W\d_]")
#: Bytes scored at a time.
PIECE = 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Lookup:
    """Keys to row numbers by open addressing; keys are at least 1."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(len(keys) + 1))) + 2)
        self.slots = np.zeros(1 << self.bits, np.uint64)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        at, left = self._hash(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.slots[at[left]] == 0
            taker = np.full(1 << self.bits, -1, np.int64)
            taker[at[left[free]]] = left[free]
            won = left[free][taker[at[left[free]]] == left[free]]
            self.slots[at[won]], self.rows[at[won]] = keys[won], won
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        at = self._hash(keys)
        out = np.where(self.slots[at] == keys, self.rows[at], -1)
        todo = np.flatnonzero((out < 0) & (self.slots[at] != 0))
        for _ in range(self.probes):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            hit = self.slots[at[todo]] == keys[todo]
            out[todo[hit]] = self.rows[at[todo[hit]]]
            todo = todo[~hit & (self.slots[at[todo]] != 0)]
        return out


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """Key of the ``order`` bytes before each byte and the byte itself; texts start in zero bytes."""
    key = np.zeros(len(data), np.uint64)
    for k in range(order, -1, -1):
        key <<= np.uint64(8)
        key[k:] |= data[: max(0, len(data) - k)].astype(np.uint64)
    return key | np.uint64(1 << 8 * (order + 1))


class Trees:
    """The context trees of all languages, as tables of code lengths and escape costs."""

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER):
        self.languages, self.order = sorted(texts), order
        self.gram, self.cost, self.context, self.escape = [], [], [], []
        if not self.languages:
            return
        n = len(self.languages)
        counts: list[dict[str, tuple[np.ndarray, np.ndarray]]] = []
        for k in range(order + 1):
            counts.append({})
            for lang in self.languages:
                keys = np.concatenate([grams(np.frombuffer(t, np.uint8), k) for t in texts[lang] if t] or [np.array([], np.uint64)])
                counts[k][lang] = np.unique(keys, return_counts=True)
        for k in range(order + 1):
            keys = np.unique(np.concatenate([counts[k][lang][0] for lang in self.languages]))
            contexts = np.unique(keys >> np.uint64(8))
            cost, escape = np.zeros((len(keys), n)), np.zeros((len(contexts), n))
            lower = self._below(keys, k, n)
            for j, lang in enumerate(self.languages):
                own, c = counts[k][lang]
                at = np.searchsorted(contexts, own >> np.uint64(8))
                total, distinct = np.bincount(at, c, len(contexts)), np.bincount(at, minlength=len(contexts))
                known = total > 0
                escape[known, j] = -np.log2(distinct[known] / (total[known] + distinct[known]))
                cost[:, j] = lower[:, j] + escape[np.searchsorted(contexts, keys >> np.uint64(8)), j]
                cost[np.searchsorted(keys, own), j] = -np.log2(c / (total[at] + distinct[at]))
            self.gram.append(Lookup(keys))
            self.cost.append(cost)
            self.context.append(Lookup(contexts))
            self.escape.append(escape)

    def _below(self, keys: np.ndarray, k: int, n: int) -> np.ndarray:
        """Cost of the same bytes at the order below ``k``; below order 0 all bytes are alike."""
        if k == 0:
            return np.full((len(keys), n), 8.0)
        keys = (keys & np.uint64((1 << 8 * k) - 1)) | np.uint64(1 << 8 * k)
        row = self.gram[k - 1].find(keys)
        out = self.cost[k - 1][np.maximum(row, 0)].copy() if len(self.cost[k - 1]) else np.zeros((len(keys), n))
        todo = np.flatnonzero(row < 0)
        if len(todo):
            context = self.context[k - 1].find(keys[todo] >> np.uint64(8))
            rest = self._below(keys[todo], k - 1, n)
            known = context >= 0
            rest[known] += self.escape[k - 1][context[known]]
            out[todo] = rest
        return out

    def lengths(self, text: bytes) -> np.ndarray:
        """Code length in bits of the text for each language."""
        data = np.frombuffer(text, np.uint8)
        total = np.zeros(len(self.languages))
        for begin in range(0, len(data), PIECE):
            from_ = max(0, begin - self.order)
            keys = grams(data[from_ : begin + PIECE], self.order)[begin - from_ :]
            # the top order first; what it lacks goes down the tree
            row = self.gram[-1].find(keys)
            hit = row >= 0
            total += np.bincount(row[hit], minlength=len(self.cost[-1])) @ self.cost[-1] if hit.sum() > len(self.cost[-1]) else self.cost[-1][row[hit]].sum(axis=0)
            rest = keys[~hit]
            if len(rest):
                context = self.context[-1].find(rest >> np.uint64(8))
                total += self.escape[-1][context[context >= 0]].sum(axis=0) + self._below(rest, self.order, len(self.languages)).sum(axis=0)
        return total

    def predict(self, text: bytes | None) -> tuple[str, float]:
        """The language of the shortest code, and its share of the probability at one bit per 16 of difference."""
        if not text or not self.languages or not LETTER.search(text.decode("utf-8", "replace")):
            return "und", 0.0
        bits = self.lengths(text)
        best = int(np.argmin(bits))
        return self.languages[best], float(1 / np.exp2(np.maximum((bits[best] - bits) / 16, -1000)).sum())


def learning_sample(labelled: DataFrame, docs_per_language: int = SAMPLE_DOCS, language_bytes: int = LANGUAGE_BYTES, all_bytes: int = ALL_BYTES) -> dict[str, list[bytes]]:
    """Whole texts of the first documents of each language by a hash of their ids, bounded in number and in bytes.

    One pass ranks ids and sizes (ranks are cut off before the shuffle, so no language is
    gathered), a second fetches the texts that were chosen. Texts above an eighth of a
    language's bytes are not learned from; of rows that share an id one counts.
    """
    key, size = F.xxhash64(F.col("doc_id").cast("string")), F.octet_length(F.col("text").cast("binary")).cast("long")
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), key.alias("h"), size.alias("size"), F.col("text").cast("string").alias("text"))
    n = rows.agg(F.approx_count_distinct("lang", 0.01)).first()[0]
    room = min(language_bytes, all_bytes // max(1, n))
    fit = rows.filter(F.col("size") <= room // 8).select("lang", "h", "size")
    # of each language only a range of hashes that holds some twice the sample goes on, so a language's ids never meet
    share = F.least(F.lit(1.0), F.lit(2.0 * docs_per_language + 64) / F.approx_count_distinct("h"))
    ends = fit.groupBy("lang").agg((share * float(1 << 64) - float(1 << 63)).cast("long").alias("end"))
    ids = fit.join(F.broadcast(ends), "lang").filter("h <= end").groupBy("lang", "h").agg(F.max("size").alias("size"))
    by = Window.partitionBy("lang").orderBy("h")
    first = ids.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= docs_per_language)
    first = first.withColumn("sum", F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("sum") <= room)
    last = first.groupBy("lang").agg(F.max("h").alias("last"))  # one row a language
    chosen = rows.join(F.broadcast(last), "lang").filter((F.col("h") <= F.col("last")) & (F.col("size") <= room // 8))
    texts: dict[str, list[bytes]] = {}
    for lang, _, text in chosen.groupBy("lang", "h").agg(F.min("text").alias("text")).orderBy("lang", "h").collect():
        texts.setdefault(lang, []).append(text.encode())
    return texts


def identify(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    held = docs.sparkSession.sparkContext.broadcast(trees)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held.value.predict(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, lang_pred string, score double")


def op10_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    trees = Trees(learning_sample(docs.filter(~held_out)))
    return identify(docs, trees).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op10_ppm_language": op10_ppm_language}
SQL: dict[str, str] = {}
