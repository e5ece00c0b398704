"""Removal of long repeated byte strings by a hash-compared suffix sort.

A string of ``LENGTH`` bytes is repeated if it also starts anywhere else. Suffixes of all
texts are far too many to sort, so the sort is sparse and grouped:

1. Anchors. Every window of ``LENGTH`` bytes has one anchor, its smallest (by hash, then
   leftmost) ``GRAM``-byte string; equal windows have equal anchors at equal places. An
   anchor answers for a run of window starts. Anchors whose hash no other anchor has
   answer for no repeated window and are dropped.
2. Contexts. The bytes that the windows of an anchor span are gathered by anchor hash.
3. Suffix sort. In each group the suffixes that begin at the anchors are sorted by
   mergesort. Suffixes are compared by their common extension, which a binary search over
   prefix polynomial hashes finds in a logarithmic number of steps; neighbours' common
   extensions come out of it. Two windows at distance r before their anchors are equal if
   no neighbour in between has an extension below LENGTH - r, and the r bytes on the left
   have equal hashes. Every match found is verified byte by byte before it counts.
4. Starts of repeated windows become removed spans.

A group too large for one task (``GROUP_BYTES`` of contexts) is split first. A window at
distance r before its anchor is filed under the range of distances r falls in and the
bytes that all windows of that range have in common, so equal windows stay together and
contexts that differ there part. What is still too large is split by narrower ranges
(``LEVELS``), down to single windows, of which a task reads one after the other. Anchors
with more than ``HOT`` occurrences are split before they are shuffled at all, and a task
sends one of equal contexts only.

Copies are worked on once: a text whose SHA-256 occurs more than once is removed wholly
if it has LENGTH bytes. On the way texts are told apart by 120 bits of it.

Edge cases: null texts are empty; texts below LENGTH bytes keep everything, as do empty
tables their emptiness; overlapping repeats count; ties between equal hashes go to the
leftmost; repeated rows, and rows of a null or repeated id, are copies or different texts
like any others. Only the id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import stored, table

LENGTH, GRAM = 400, 128
GROUP_BYTES = 12 << 20
#: Contexts that are sorted together, if their groups are small.
SORT_BYTES = 1 << 20
#: Distances that one group answers for: all of an anchor's first, then narrower ranges.
LEVELS = (1 << 10, 64, 8, 1)
#: Occurrences of an anchor from which on its contexts are split before the shuffle.
HOT = 4096
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1


class Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as they have been asked for."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) <= n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_INVERSE, k, 1 << 64))])
        return self.up, self.down


POWERS = Powers()


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes, the empty one first."""
    up, _ = POWERS.upto(len(data))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def window_hashes(prefix: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes from every place on."""
    n = len(prefix) - length
    _, down = POWERS.upto(n)
    return mixed((prefix[length:] - prefix[:n]) * down[:n])


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of every anchor, first and last start of the windows it answers for."""
    data = np.frombuffer(text, np.uint8)
    g = window_hashes(prefix_hashes(data), gram)
    w, starts = length - gram + 1, len(data) - length + 1
    bits = max(1, int(len(g)).bit_length())
    order = (g >> np.uint64(bits)) << np.uint64(bits) | np.arange(len(g), dtype=np.uint64)
    # sliding minimum: the least of the rest of one block and of the beginning of the next
    padded = np.full(-(-len(order) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(order)] = order
    blocks = padded.reshape(-1, w)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(tail[:starts], head[w - 1 : w - 1 + starts]) & np.uint64((1 << bits) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return g[at[first]], at[first], first, np.append(first[1:], starts) - 1


class Suffixes:
    """Suffixes of contexts that begin at their anchors.

    Powers count from the beginning of each context, so their tables stay as short as the
    longest context; the sums run over all contexts in place.
    """

    def __init__(self, contexts: list[bytes], before: np.ndarray):
        self.size = np.array([len(c) for c in contexts], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64)
        self.buffer = b"".join(contexts)
        self.data = np.frombuffer(self.buffer, np.uint8)
        up, self.down = POWERS.upto(int(self.size.max(initial=0)))
        self.prefix = np.zeros(len(self.data) + 1, np.uint64)
        terms = self.prefix[1:]
        terms[:] = self.data
        terms += np.uint64(1)
        for b, n in zip(self.begin.tolist(), self.size.tolist(), strict=True):
            terms[b : b + n] *= up[:n]
        np.cumsum(terms, out=terms)
        self.before, self.after = before, self.size - before
        self.anchor = self.begin + before

    def hash(self, row: np.ndarray, offset: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Hash of ``length`` bytes of each row's context, from ``offset`` on."""
        at = self.begin[row] + offset
        return (self.prefix[at + length] - self.prefix[at]) * self.down[offset]

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common extension of pairs of suffixes, by binary search over prefix hashes."""
        low, high = np.zeros(len(x), np.int64), np.minimum(self.after[x], self.after[y])
        ax, ay = self.before[x], self.before[y]
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            same = self.hash(x, ax, mid) == self.hash(y, ay, mid)
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        return low

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether suffix x comes before suffix y; equal ones stand in the order of their numbers."""
        e = self.extension(x, y)
        in_x, in_y = e < self.after[x], e < self.after[y]
        last = len(self.data) - 1
        cx = np.where(in_x, self.data[np.minimum(self.anchor[x] + e, last)].astype(np.int64), -1)
        cy = np.where(in_y, self.data[np.minimum(self.anchor[y] + e, last)].astype(np.int64), -1)
        return (cx < cy) | ((cx == cy) & (x < y))

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Mergesort of all groups at once; ``group`` is ascending. Runs of a level merge side by side."""
        n = len(group)
        order = np.arange(n)
        start = np.searchsorted(group, group)
        size = np.bincount(group, minlength=int(group[-1]) + 1)[group] if n else np.array([], np.int64)
        place = np.arange(n) - start  # within the group
        width = 1
        while width < (int(size.max()) if n else 0):
            active = np.flatnonzero(size > width)
            p, s, z = place[active], start[active], size[active]
            run = p // width
            other = np.where(run % 2 == 0, run + 1, run - 1) * width
            low, high = np.minimum(other, z), np.minimum(other + width, z)
            end0, mine = low.copy(), order[active]
            while (open_ := low < high).any():  # rank in the other run
                mid = (low + high) // 2
                goes = np.zeros(len(active), bool)
                k = np.flatnonzero(open_)
                goes[k] = self.less(order[s[k] + mid[k]], mine[k])
                low, high = np.where(open_ & goes, mid + 1, low), np.where(open_ & ~goes, mid, high)
            to = s + (run // 2) * 2 * width + (p - run * width) + (low - end0)
            merged = order.copy()
            merged[to] = mine
            order, width = merged, width * 2
        return order


def repeated_starts(group: np.ndarray, contexts: list[bytes], pos: np.ndarray, low: np.ndarray, high: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """(rows x distances) whether the window that begins r bytes before the row's anchor is repeated in its group.

    Row k's context are the bytes from low[k] to high[k] + length of its text.
    """
    n, top = len(group), length - gram + 1
    found = np.zeros((n, top), bool)
    if n < 2:
        return found
    s = Suffixes(contexts, pos - low)
    order = s.sort(group)
    extension = np.zeros(n, np.int64)
    extension[1:] = s.extension(order[:-1], order[1:])
    fresh = np.concatenate([[True], group[order][1:] != group[order][:-1]])
    low_r, high_r = (pos - high)[order], (pos - low)[order]
    partner = np.full((top, n), -1, np.int32)
    for r in range(max(0, int(low_r.min())), min(top - 1, int(high_r.max())) + 1):
        rows = np.flatnonzero((low_r <= r) & (r <= high_r))
        if len(rows) < 2:
            continue
        right = np.cumsum(fresh | (extension < length - r))[rows]
        x = order[rows]
        left = s.hash(x, s.before[x] - r, np.full(len(x), r))
        by = np.lexsort((left, right))
        same = (right[by][1:] == right[by][:-1]) & (left[by][1:] == left[by][:-1])
        first = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(by)), 0))
        members = np.flatnonzero(np.concatenate([[False], same]))
        partner[r, x[by[members]]] = x[by[first[members]]]
    # verification: runs of distances with one partner are compared as one stretch of bytes
    for k in np.flatnonzero((partner >= 0).any(axis=0)):
        p = partner[:, k]
        cut = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        for b, e in zip(cut, np.append(cut[1:], top), strict=True):
            if (o := int(p[b])) < 0:
                continue
            at, to, size = int(s.anchor[k]) - int(e) + 1, int(s.anchor[o]) - int(e) + 1, length + int(e) - 1 - int(b)
            if s.buffer[at : at + size] == s.buffer[to : to + size]:
                found[k, b:e] = found[o, b:e] = True
            else:  # hashes collided: windows one by one, against the whole group
                for r in range(b, e):
                    own = s.buffer[s.anchor[k] - r : s.anchor[k] - r + length]
                    for j in np.flatnonzero((group == group[k]) & (pos - high <= r) & (r <= pos - low)):
                        if j != k and s.buffer[s.anchor[j] - r : s.anchor[j] - r + length] == own:
                            found[k, r] = found[j, r] = True
    return found


def _key(text: bytes) -> tuple[int, int]:
    digest = hashlib.sha256(text).hexdigest()
    return int(digest[:15], 16), int(digest[15:30], 16)


def keyed(text: Column) -> dict[str, Column]:
    """``k1`` and ``k2``, 60 bits each of the SHA-256 of a text: what texts are told apart by on the way."""
    digest = F.sha2(text.cast("binary"), 256)
    return {f"k{k}": F.conv(F.substring(digest, 15 * k - 14, 15), 16, 10).cast("long") for k in (1, 2)}


def _texts(batch: pa.RecordBatch, at: int) -> list[bytes | None]:
    return batch.column(at).cast(pa.binary()).to_pylist()


def text_table(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, n_bytes and own_sha256 of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(k) for k, c in keyed(text).items()], F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("own_sha256"))


def shared_anchors(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """anchor, k1, k2, place (pos << 20 | pos - low << 10 | high - low) and hot of anchors whose hash occurs again.

    An anchor occurs again if not all that is known of it is one place of one text. The
    counts are summed before the shuffle, and the rows come back by a plain join, which
    Spark may split, so no anchor's rows have to meet in one task.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            size = 0
            for t in _texts(batch, 0):
                if not t or len(t) < length or (key := _key(t)) in seen:
                    continue
                seen.add(key)
                h, pos, low, high = anchors(t, length, gram)
                for c, v in zip(out, (h.view(np.int64), *[np.full(len(h), k, np.int64) for k in key], pos << 20 | (pos - low) << 10 | (high - low)), strict=True):
                    c.append(v)
                size += len(h)
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["anchor", "k1", "k2", "place"])
                    out, size = [[], [], [], []], 0
            if len(seen) > 500_000:
                seen.clear()
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["anchor", "k1", "k2", "place"])

    found = stored(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(find, "anchor long, k1 long, k2 long, place long"), "anchors")
    per = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}_{c}") for c in ("k1", "place") for k, f in (("lo", F.min), ("hi", F.max))])
    again = per.filter("lo_k1 < hi_k1 OR lo_place < hi_place").select("anchor", (F.col("n") > hot).alias("hot"))
    return found.join(stored(again, "again"), "anchor")


def _by_text(docs: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """k1, k2, text and the gathered column of the texts that the rows (k1, k2, column) name."""
    own = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumns(keyed(F.col("text")))
    packed = rows.groupBy("k1", "k2").agg(F.collect_set(column).alias(column))
    return own.join(packed, ["k1", "k2"]).select("k1", "k2", "text", column)


CONTEXT = "group long, k1 long, k2 long, place long, level int, bytes binary"
_CONTEXT_KINDS = dict(zip("group k1 k2 place level bytes".split(), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True))


class Sender:
    """Rows that leave a task: contexts, and (without bytes, place first << 32 | last) runs of starts that are settled.

    Of equal contexts a task sends one: all windows of both are repeated, whatever else there is.
    """

    def __init__(self):
        self.rows: list[list] = [[] for _ in _CONTEXT_KINDS]
        self.size = 0
        #: where the first of equal contexts stands, or None once that is known to be repeated
        self.first: dict[bytes, tuple[int, int, int, int] | None] = {}

    def put(self, *row) -> None:
        for c, v in zip(self.rows, row, strict=True):
            c.append(v)
        self.size += 64 + len(row[-1] or b"")

    def settle(self, k1: int, k2: int, first: int, last: int) -> None:
        self.put(k1, k1, k2, first << 32 | last, 0, None)

    def known(self, group: int, k1: int, k2: int, place: int, level: int, data: bytes) -> bool:
        """Whether an equal context has gone out; if not, this one goes."""
        pos, low, span = _unpack(place)
        same = hashlib.sha256(data + b"%d" % (pos - low)).digest()
        if same in self.first:
            if (one := self.first[same]) is not None:
                self.settle(*one)
                self.first[same] = None
            return True
        if len(self.first) > 400_000:
            self.first.clear()
        self.first[same] = k1, k2, low, low + span
        self.put(group, k1, k2, place, level, data)
        return False

    def split(self, anchor: int, k1: int, k2: int, place: int, level: int, data: bytes, length: int) -> None:
        """The context in parts, filed for the next level: see the module's text."""
        pos, low, span = _unpack(place)
        wide, near, far = LEVELS[level + 1], pos - low - span, pos - low
        for j in range(near // wide, far // wide + 1):
            first, last = pos - min(far, j * wide + wide - 1), pos - max(near, j * wide)
            common = data[far - j * wide : far + length - (j + 1) * wide + 1]
            group = xxhash.xxh64_intdigest(common + b"%d %d" % (anchor, j * wide + level))
            part = pos << 20 | (pos - first) << 10 | (last - first)
            if self.known(group - (1 << 63), k1, k2, part, level + 1, data[first - low : last - low + length]):
                self.settle(k1, k2, first, last)

    def batch(self) -> pa.RecordBatch:
        rows, self.rows, self.size = self.rows, [[] for _ in _CONTEXT_KINDS], 0
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, _CONTEXT_KINDS.values(), strict=True)], names=list(_CONTEXT_KINDS))


def contexts(docs: DataFrame, found: DataFrame, length: int = LENGTH) -> DataFrame:
    """The bytes that the windows of every shared anchor span (CONTEXT rows); those of hot anchors are split at once."""
    rows = found.select("k1", "k2", F.struct("anchor", "place", "hot").alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a text that is worked on twice is a copy, which is removed wholly: nothing depends on how many are remembered
        seen: set[tuple[int, int]] = set()
        out = Sender()
        for batch in batches:
            for k1, k2, text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch, 2), batch.column(3).to_pylist(), strict=True):
                if (k1, k2) in seen:
                    continue
                seen.add((k1, k2))
                again: list[tuple[int, int]] = []
                for x in at:
                    pos, low, span = _unpack(x["place"])
                    data = text[low : low + span + length]
                    if x["hot"]:
                        out.split(x["anchor"], k1, k2, x["place"], 0, data, length)
                    elif out.known(x["anchor"], k1, k2, x["place"], 0, data):
                        again.append((low, low + span))
                for low, high in _merged(again):
                    out.settle(k1, k2, low, high)
                if out.size > 4 << 20:
                    yield out.batch()
            if len(seen) > 500_000:
                seen.clear()
        yield out.batch()

    return _by_text(docs, rows, "at").mapInArrow(cut, CONTEXT)


def _merged(runs: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for low, high in sorted(runs):
        if out and low <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


def _unpack(place):
    pos = place >> 20
    return pos, pos - ((place >> 10) & 1023), place & 1023


def solved(rows: list[tuple], out: Sender, length: int, gram: int) -> None:
    """Settles whole groups by the suffix sort."""
    if not rows:
        return
    a = np.array([r[0] for r in rows], np.int64)
    group = np.cumsum(np.concatenate([[0], (a[1:] != a[:-1]).astype(np.int64)]))
    pos, low, span = _unpack(np.array([r[3] for r in rows], np.int64))
    found = repeated_starts(group, [r[5] for r in rows], pos, low, low + span, length, gram)
    edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rise, fall = np.argwhere(edge == 1), np.argwhere(edge == -1)
    # distances r from the anchor: starts are pos - r
    for (k, b), (_, e) in zip(rise, fall, strict=True):
        out.settle(rows[k][1], rows[k][2], int(pos[k]) - int(e) + 1, int(pos[k]) - int(b))


def settled(batches: Iterator[pa.RecordBatch], length: int, gram: int, group_bytes: int) -> Iterator[pa.RecordBatch]:
    """One task of ``settle``; rows come in order of their groups."""
    out, held, size, large = Sender(), [], 0, None
    alone: tuple[int | None, dict[bytes, tuple[int, int, int] | None]] = (None, {})

    def single(row: tuple) -> None:
        """A group of the last level: single windows, equal if their bytes are."""
        nonlocal alone
        if alone[0] != row[0]:
            alone = row[0], {}
        group, k1, k2, place, _, data = row
        _, start, _ = _unpack(place)
        if data not in alone[1]:
            alone[1][data] = k1, k2, start
            return
        if (one := alone[1][data]) is not None:
            out.settle(*one, one[2])
            alone[1][data] = None
        out.settle(k1, k2, start, start)

    for batch in batches:
        done = batch.filter(batch.column(5).is_null())
        if len(done):
            yield done
        for row in zip(*[c.to_pylist() for c in batch.filter(batch.column(5).is_valid()).columns], strict=True):
            if out.size > 4 << 20:
                yield out.batch()
            if row[4] == len(LEVELS) - 1:
                single(row)
                continue
            if held and row[0] != held[-1][0] and size > SORT_BYTES:
                solved(held, out, length, gram)
                held, size = [], 0
            if row[0] == large:
                out.split(*row, length)
                continue
            large = None
            held.append(row)
            size += len(row[5])
            if size > group_bytes and held[0][0] == row[0]:  # one group alone is too large
                large = row[0]
                for one in held:
                    out.split(*one, length)
                    if out.size > 4 << 20:
                        yield out.batch()
                held, size = [], 0
            elif size > group_bytes:  # groups before the last are whole
                k = next(i for i, x in enumerate(held) if x[0] == row[0])
                solved(held[:k], out, length, gram)
                held, size = held[k:], sum(len(x[5]) for x in held[k:])
    solved(held, out, length, gram)
    yield out.batch()


def settle(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """CONTEXT rows to CONTEXT rows: settled runs, and the contexts of groups too large, split for the next level."""
    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(lambda batches: settled(batches, length, gram, group_bytes), CONTEXT)


def repeated_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_bytes: int = GROUP_BYTES, hot: int = HOT) -> DataFrame:
    """k1, k2, first, last: runs of starts of repeated windows."""
    rows, done = contexts(docs, shared_anchors(docs, length, gram, hot), length), None
    for _ in LEVELS:
        out = stored(settle(rows, length, gram, group_bytes), "runs")
        runs = out.filter("bytes IS NULL").select("k1", "k2", F.shiftright("place", 32).alias("first"), F.col("place").bitwiseAND(0xFFFFFFFF).alias("last"))
        done = runs if done is None else done.unionByName(runs)
        rows = out.filter("bytes IS NOT NULL")
        if rows.isEmpty():
            break
    return done


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_bytes: int = GROUP_BYTES, keep_text: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes, if asked for) of every document."""
    texts = stored(text_table(docs), "texts")
    copied = stored(texts.groupBy("own_sha256").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "copied")
    runs = repeated_runs(docs, length, gram, group_bytes, hot)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            rows = []
            for k1, k2, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch, 2), batch.column(3).to_pylist(), strict=True):
                if (k1, k2) in seen:
                    continue
                seen.add((k1, k2))
                delta = np.zeros(len(text) + 1, np.int32)
                np.add.at(delta, [x["first"] for x in spans], 1)
                np.add.at(delta, [x["last"] + length for x in spans], -1)
                gone = np.cumsum(delta[:-1]) > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append((k1, k2, int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            if len(seen) > 500_000:
                seen.clear()  # the rows of one text are made one below
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["k1", "k2", "n_removed", "n_spans", "kept_sha256", "kept"])

    partly = _by_text(docs, runs.select("k1", "k2", F.struct("first", "last").alias("span")), "span").mapInArrow(cut, "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    partly = partly.groupBy("k1", "k2").agg(*[F.first(c).alias(c) for c in ("n_removed", "n_spans", "kept_sha256", "kept")])
    # a text that stands in more than one row is repeated as a whole
    whole = F.col("copies").isNotNull() & (F.col("n_bytes") >= length)
    j = texts.join(copied, "own_sha256", "left").join(stored(partly, "partly"), ["k1", "k2"], "left")
    out = j.select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"), F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha256", "own_sha256")).alias("kept_sha256"), F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )
    return out if keep_text else out.drop("kept")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
SQL: dict[str, str] = {}
