"""Every operator against brute force, on rows of all awkward kinds and on none."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import decontamination, jaccard_join, language_id, license_scan, mixing, quality_rules, secret_scan, sharding, substring_dedup, web_archive
from quire.llm.components import connected_components


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def letters(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def by_row(frame):
    return Counter(tuple(r) for r in frame.collect())


# 1 -------------------------------------------------------------------------------------


def base_licences(t):
    w, starts, labels = letters(t), [], set()
    for phrase, label in license_scan.BASE.items():
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                starts.append(k)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_scan(edge_docs, edge_rows, no_docs):
    got = license_scan.scan(edge_docs)
    assert by_row(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) == Counter((d, *base_licences(t)) for d, t, _, _ in edge_rows)
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in got.collect()}
    assert labels[13] == ("cc-by,cc-by-nc-4.0,gpl", 1.0) and labels[10][0] == "mit,mit-release"
    assert license_scan.scan(no_docs).count() == 0


def test_license_kelvin_sign_is_no_k(spark):
    df = spark.createDataFrame([(1, "worK under the MIT License")], "doc_id long, text string")
    assert license_scan.scan(df).first()["n_words"] == len(letters("worK under the MIT License"))


# 2 -------------------------------------------------------------------------------------


def test_web_archive_round_trip(spark):
    page = "x\r\n\r\nWARC/1.0\r\n" * 20
    rows = [(None, "a b", None), (1, None, page), (3, "u", page), (3, "u", page), (4, "u", "é"), (5, "u", "é"), (6, "u", "\x00\n"), (7, "http://x/\n y", page + "!")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' AS digest", "1 AS payload")
    digest = lambda s: hashlib.sha256((s or "").encode()).hexdigest()
    size = lambda s: len((s or "").encode())
    wanted = Counter((p, size(h), digest(h), "revisit" if p == 3 else "response", 1 if p == 3 else None) for p, _, h in rows)
    assert by_row(web_archive.convert(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == wanted
    assert web_archive.convert(df.limit(0)).count() == 0


def test_arc_versions_and_lengths():
    v1 = b"filedesc://a 0.0.0.0 20010203040506 text/plain 9\n1 0 quire\nhttp://x 1.2.3.4 20020304050607 text/html 5\nab\ncd\nhttp://y 1.2.3.4 2003 text/html 0\n\n"
    heads = [(h, c) for h, c in web_archive.arc_records(v1) if "filedesc" not in h]
    assert [(h["url"], c) for h, c in heads] == [("http://x", b"ab\ncd"), ("http://y", b"")]
    assert web_archive.iso_date(heads[0][0]["date"]) == "2002-03-04T05:06:07Z"
    v2 = b"filedesc://a 0.0.0.0 20010203040506 text/plain 200 - - 0 f 9\n2 0 quire\nhttp://x 1.2.3.4 20020304050607 text/html 200 C - 0 f 2\nab\n"
    assert [h["code"] for h, _ in web_archive.arc_records(v2) if "filedesc" not in h] == ["200"]
    with pytest.raises(ValueError):
        list(web_archive.arc_records(b"http://x 1.2.3.4 text/html 2\nab\n"))


# 3 -------------------------------------------------------------------------------------


def contamination(rows, items, width=10):
    grams = defaultdict(set)
    for i, t in items:
        w = letters(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            grams[tuple(w[k : k + width])].add(i)
    out = Counter()
    for d, t, *_ in rows:
        w, hit, found = letters(t), set(), set()
        for g, ids in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    found |= ids
        out[d, len(w), len(hit), tuple(sorted(map(str, found)))] += 1
    return out


def nearby(rows, items):
    """Per document, the items whose rarest terms all stand close to an occurrence of the rarest one."""
    counts = Counter(w for _, t, *_ in rows for w in letters(t))
    out = Counter()
    for d, t, *_ in rows:
        places, found = defaultdict(list), set()
        for k, w in enumerate(letters(t)):
            places[w].append(k)
        for i, text in items:
            own = letters(text)
            rare = sorted(set(own), key=lambda w: (counts[w], w.encode()))[: decontamination.NEAR_TERMS]
            span = len(own) + decontamination.NEAR_SLACK
            if rare and any(all(any(abs(p - q) <= span for q in places[w]) for w in rare) for p in places[rare[0]]):
                found.add(str(i))
        out[d, tuple(sorted(found))] += 1
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 1])
def test_decontamination(spark, edge_docs, edge_rows, no_docs, block_bytes):
    items = [(1, "three four five"), (2, None), (3, ""), (10, "ONE two three four five six seven eight nine ten, eleven!"), (11, "same words of the same line same words of the same"), (12, "three four five"), (13, edge_rows[6][1][:300]), (13, "eleven ten three")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_matches(edge_docs, bench, block_bytes=block_bytes)
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in got.collect()) == contamination(edge_rows, items)
    near = Counter((r["doc_id"], tuple(r["near_ids"])) for r in got.collect())
    assert near == nearby(edge_rows, items) and near[17, ("1", "10", "12", "13")] == 1
    clean = decontamination.remove_contaminated(edge_docs, bench, block_bytes=block_bytes)
    assert clean.columns == edge_docs.columns
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(d for (d, _, n, _), c in contamination(edge_rows, items).items() for _ in range(c) if not n)
    assert decontamination.find_matches(no_docs, bench).count() == 0
    assert {r["n_hit"] for r in decontamination.find_matches(edge_docs, bench.limit(0)).collect()} == {0}


def test_postings_of_small_pieces(spark, edge_docs, edge_rows, monkeypatch):
    """The index is cut anywhere between documents; what is found stays the same."""
    texts = [(t or "").encode() for _, t, *_ in edge_rows]
    q = decontamination.Queries([("1", texts[17]), ("2", texts[6][:200])])
    whole = list(decontamination._found(decontamination.Postings.of_texts(texts, q.vocabulary), q, True))
    for k, t in enumerate(texts):
        p = decontamination.Piece([t])
        one = decontamination.Postings.of_stored(p.n_words, p.words, p.counts, p.places, q.vocabulary)
        hit, items, close = next(decontamination._found(one, q, True))
        assert hit.tolist() == whole[k][0].tolist() and items == whole[k][1] and close == whole[k][2]


# 4 -------------------------------------------------------------------------------------


def test_mix_reaches_targets(edge_docs, edge_rows, no_docs):
    got = mixing.mix(edge_docs).collect()
    size = {}
    for d, t, _, s in edge_rows:
        size[s] = size.get(s, 0) + len(spaced(t))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(size.values())
    while True:  # share, cap, share again
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not above:
            break
        for s in above:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= above
    target |= {s: level * weight[s] for s in open_}
    assert {(r["source_size"], round(r["target"], 6)) for r in got} == {(size[s], round(target[s], 6)) for s in names}
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["position"] is None) == (r["taken"] == 0)
        taken[r["target"]] += r["taken"]
    assert all(abs(v - t * len([s for s in names if target[s] == t])) <= 1 for t, v in taken.items())
    positions = [r["position"] for r in got if r["position"] is not None]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
    assert sorted(map(tuple, mixing.mix(edge_docs).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    assert mixing.mix(no_docs).count() == 0
    stream = mixing.training_stream(edge_docs)
    assert stream.columns == edge_docs.columns
    order = sorted((p, r["row_hash"], r["doc_id"]) for r in got for p in (r["position"], r["position_again"]) if p is not None)
    assert [r["doc_id"] for r in stream.collect()] == [d for _, _, d in order]
    assert mixing.training_stream(no_docs).count() == 0


@pytest.mark.parametrize("schedule", mixing.SCHEDULES)
def test_inverse_integral(spark, schedule):
    from pyspark.sql import functions as F

    grid = np.linspace(0, 1, 2001)
    weight = np.interp(grid, [t for t, _ in schedule], [w for _, w in schedule])
    total = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2 * np.diff(grid))])
    shares = [0.0, 0.1, 0.3, 0.5, 0.77, 1.0]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in shares], "s double").select(mixing.inverse_integral(schedule, F.col("s"))).collect()]
    assert np.allclose(got, np.interp(shares, total / total[-1], grid), atol=1e-3)


# 5 -------------------------------------------------------------------------------------


def test_sharding(spark, sf, edge_docs, edge_rows, no_docs):
    got = sharding.shard(edge_docs, 4).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t, *_ in edge_rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(4))
    assert sharding.shard(no_docs, 4).count() == 0
    many = spark.createDataFrame([(k, "same text", "en", "s") for k in range(4000)], "doc_id long, text string, lang string, source string")
    sizes = Counter(r["shard"] for r in sharding.shard(many, 7).collect())
    assert len(sizes) == 7 and max(sizes.values()) <= 1.05 * min(sizes.values())


def tree_shards(rows, shards, first=0):
    """The k-d tree by recursion: rows are (size, dims, row_hash); gives each row's shard."""
    if shards == 1 or not rows:
        return [first] * len(rows)
    wide = max(range(4), key=lambda d: (max(r[1][d] for r in rows) - min(r[1][d] for r in rows), -d))
    key = [(r[1][wide] << 31) + (r[2] >> 32) for r in rows]
    per = Counter()
    for k, r in zip(key, rows, strict=True):
        per[k] += r[0]
    want, below, cut = sum(r[0] for r in rows) * (shards // 2) / shards, 0, None
    for k in sorted(per):
        if below + per[k] >= want:
            cut = k if below + per[k] - want <= want - below else k - 1
            break
        below += per[k]
    left = [k <= cut for k in key]
    sides = [iter(tree_shards([r for r, x in zip(rows, left, strict=True) if x == side], shards // 2 if side else shards - shards // 2, first if side else first + shards // 2)) for side in (False, True)]
    return [next(sides[x]) for x in left]


@pytest.mark.parametrize("shards", [2, 5, 13])
def test_sharding_is_the_tree_by_recursion(spark, shards):
    rng = random.Random(shards)
    rows = [(rng.randrange(10**6), "x" * int(rng.paretovariate(0.7) * 20 % 40_000), rng.choice(["en", "de", None]), rng.choice(["a", "b", "", "longer"])) for _ in range(600)]
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, lang string, source string")
    meta = sharding.metadata(df).collect()
    wanted = Counter(zip([r["doc_id"] for r in meta], tree_shards([(r["size"], r["_dims"], r["row_hash"]) for r in meta], shards), strict=True))
    got = sharding.shard(df, shards, tolerance=0.0).collect()
    assert Counter((r["doc_id"], r["shard"]) for r in got) == wanted
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes[k] for k in range(shards)) <= 2 * max(r["size"] for r in got)


# 6 -------------------------------------------------------------------------------------


def repeats(rows, length):
    texts = [(d, (t or "").encode()) for d, t, *_ in rows]
    seen = Counter(t[k : k + length] for _, t in texts for k in range(len(t) - length + 1))
    out = Counter()
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        out[d, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("length, gram, group_bytes", [(400, 128, 1 << 20), (400, 128, 3000), (60, 20, 1 << 20), (60, 20, 500)])
def test_substring_dedup(edge_docs, edge_rows, no_docs, length, gram, group_bytes):
    got = substring_dedup.remove_repeats(edge_docs, length, gram, group_bytes)
    assert by_row(got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == repeats(edge_rows, length)
    assert substring_dedup.remove_repeats(no_docs).count() == 0


def passages(rng, n):
    """Texts with planted passages of 399, 400 and 401 bytes and of more, one in most of them, and a line in all of them."""
    line = "".join(rng.choices("abcdefgh ", k=300))
    planted = ["".join(rng.choices("abcdefgh ", k=k)) for k in (399, 400, 401, 450, 900)]
    own = lambda: "".join(rng.choices("ijklmnop ", k=rng.randint(0, 300)))
    return [(k, own() + line + own() + "|" + rng.choice(planted) + "|" + own() + (line if k % 3 else "")) for k in range(n)]


@pytest.mark.parametrize("group_bytes, hot", [(12 << 20, 4096), (20_000, 4096), (2_000, 20), (1, 1)])
def test_substring_dedup_of_large_groups(spark, group_bytes, hot):
    rows = passages(random.Random(group_bytes), 120)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = by_row(substring_dedup.remove_repeats(df, group_bytes=group_bytes, hot=hot))
    assert got == repeats(rows, 400)


@pytest.mark.parametrize("group_bytes", [1, 5_000, 1 << 20])
def test_substring_dedup_with_colliding_hashes(monkeypatch, group_bytes):
    """All contexts and subgroups have one hash, level after level: bytes decide."""
    import pyarrow as pa

    monkeypatch.setattr(substring_dedup.xxhash, "xxh64_intdigest", lambda data: 1 << 63)
    texts = [t.encode() for _, t in passages(random.Random(1), 25)]
    rows = []
    for k, t in enumerate(texts):
        for _, pos, low, high in zip(*(c.tolist() for c in substring_dedup.anchors(t)), strict=True):
            rows.append((0, k, k, pos << 20 | (pos - low) << 10 | (high - low), 0, t[low : high + 400]))
    starts = [set() for _ in texts]
    while rows:
        batch = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), substring_dedup._CONTEXT_KINDS.values(), strict=True)], names=list(substring_dedup._CONTEXT_KINDS))
        out = [tuple(r.values()) for b in substring_dedup.settled(iter([batch]), 400, 128, group_bytes) for r in b.to_pylist()]
        for r in out:
            if r[5] is None:
                starts[r[1]].update(range(r[3] >> 32, (r[3] & 0xFFFFFFFF) + 1))
        rows = sorted((r for r in out if r[5] is not None), key=lambda r: (r[4], r[0]))
    seen = Counter(t[k : k + 400] for t in texts for k in range(len(t) - 399))
    assert starts == [{k for k in range(len(t) - 399) if seen[t[k : k + 400]] > 1} for t in texts]


def test_suffix_sort_is_lexicographic():
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab", k=rng.randint(5, 60))).encode() for _ in range(200)]
    group = np.sort(np.array([rng.randrange(9) for _ in texts]))
    s = substring_dedup.Suffixes(texts, np.zeros(len(texts), np.int64))
    order = s.sort(group)
    assert [texts[k] for k in order] == [texts[k] for k in sorted(range(len(texts)), key=lambda k: (group[k], texts[k], k))]


def test_collisions_are_verified(monkeypatch):
    """With hashes that are all alike, only bytes decide."""
    monkeypatch.setattr(substring_dedup.Suffixes, "hash", lambda self, row, offset, length: np.zeros(len(row), np.uint64))
    texts = [b"aaaabbbb", b"aaaacccc", b"aaaabbbb"]
    at = np.zeros(3, np.int64)
    found = substring_dedup.repeated_starts(np.zeros(3, np.int64), texts, at, at, at, length=8, gram=4)
    assert found[:, 0].tolist() == [True, False, True]


# 7 -------------------------------------------------------------------------------------


def measures(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in quality_rules.SYMBOLS for c in t), len(lines) - len(set(lines)), len(covered), failed


def test_quality_rules(edge_docs, edge_rows, no_docs):
    got = quality_rules.judge(edge_docs)
    q = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert by_row(got.select("doc_id", *[f"_q.{c}" for c in q])) == Counter((d, *measures(t)) for d, t, *_ in edge_rows)
    kept = Counter(r["doc_id"] for r in got.collect() if r["_q"]["kept"])
    assert not [r for r in got.collect() if r["_q"]["kept"] and r["_q"]["base_failed"]]
    good = quality_rules.keep_good(edge_docs)
    assert good.columns == edge_docs.columns and Counter(r["doc_id"] for r in good.collect()) == kept
    assert quality_rules.judge(no_docs).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange hash" not in plan


# 8 -------------------------------------------------------------------------------------


def linked(rows, words=4, percent=85):
    sets = {}
    for d, t, *_ in rows:
        w = spaced(t)
        sets[d] = frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()
    root = {d: d for d in sets}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_jaccard_join(edge_docs, edge_rows, no_docs):
    wanted = linked(edge_rows)
    got = jaccard_join.join_components(edge_docs).select("doc_id", "n_shingles", "component_id")
    assert by_row(got) == Counter((d, *wanted[d]) for d, *_ in edge_rows)
    assert jaccard_join.join_components(no_docs).count() == 0


def test_jaccard_join_hands_small_batches_to_python(spark, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(key)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    def watched(df):
        rows = spark.range(0, 3000, 1, 1).selectExpr("repeat('x', 10000) AS text").mapInArrow(sizes, "n long")
        seen.extend(r["n"] for r in rows.collect())
        return jaccard_join_checkpointed(df)

    jaccard_join_checkpointed = jaccard_join.checkpointed
    monkeypatch.setattr(jaccard_join, "checkpointed", watched)
    df = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    assert {r["component_id"] for r in jaccard_join.join_components(df).collect()} == {1}
    assert sum(seen) >= 2 * 30_000_000 and max(seen) < 6 << 20 and spark.conf.get(key) == before


@pytest.mark.parametrize("words, percent, salt, crowd, block", [(4, 85, 7, 1, 7), (5, 80, 512, 16, 1024), (2, 50, 64, 3, 20)])
def test_jaccard_join_of_many_near_copies(spark, monkeypatch, words, percent, salt, crowd, block):
    monkeypatch.setattr(jaccard_join, "SALT", salt)
    monkeypatch.setattr(jaccard_join, "CROWD", crowd)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(words)
    rows, base = [], [[f"w{rng.randrange(5000)}" for _ in range(rng.choice([6, 40, 120]))] for _ in range(6)]
    for k in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 5])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = linked(rows, words, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join_components(df, words, percent).collect()} == wanted
    assert {r["doc_id"] for r in jaccard_join.one_of_each(df, words, percent).collect()} == {c for _, c in wanted.values()}


def test_rows_without_an_id_and_repeated_ids(spark):
    body = " ".join(f"w{k}" for k in range(80))
    rows = [(None, body), (None, body), (4, body), (2, body), (2, body), (9, "other words of its own here"), (9, "other words of its own here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_row(jaccard_join.join_components(df).select("doc_id", "component_id"))[2, 2] == 2
    assert sorted((r["doc_id"] or 0) for r in jaccard_join.one_of_each(df).collect()) == [0, 0, 2, 9]


def test_no_edges_no_components(spark):
    assert connected_components(spark.createDataFrame([(3, 3), (None, 1)], "a long, b long")).count() == 0


@pytest.mark.parametrize(("held", "batch"), [(100_000, 10_000), (100_000, 2), (3, 2)])
def test_connected_components(spark, monkeypatch, held, batch):
    """All edges in one task, in one task by several batches, and hung together piece by piece before the rounds."""
    monkeypatch.setattr("quire.llm.components.FILE_EDGES", held)
    edges = [(k, k + 1) for k in range(30)] + [(100, 5), (5, 100), (200, 201), (201, 202), (201, 202)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r["node"]: r["component"] for r in found}
    assert len(found) == len(got)
    assert got == {**dict.fromkeys([*range(31), 100], 0), 200: 200, 201: 200, 202: 200}


# 9 -------------------------------------------------------------------------------------


def test_secret_scan(edge_docs, edge_rows, no_docs):
    def wanted(t):
        t, spans = t or "", []
        for m in re.finditer(r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
            spans += [(m.start(), 0, m.end())] * (len(m[2]) >= 8)
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        said = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
        return (*[sum(x[1] == k for x in spans) for k in range(3)], hashlib.sha256(said.encode()).hexdigest())

    got = secret_scan.find_secrets(edge_docs)
    assert by_row(got.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")) == Counter((d, *wanted(t)) for d, t, *_ in edge_rows)
    assert "markov:" in {r["doc_id"]: r["spans"] for r in got.collect()}[14]
    assert secret_scan.find_secrets(no_docs).count() == 0


def test_models_tell_held_out_samples_apart():
    models = secret_scan.made_models()
    secrets, names = secret_scan.labelled_samples(1000, seed=99)
    assert np.mean([models.is_secret(x) for x in secrets]) > 0.98
    assert np.mean([models.is_secret(x) for x in names]) < 0.01
    rng = random.Random(4)
    for alphabet in secret_scan.ALPHABETS[1:]:  # short ones, and ones without a digit, as well
        assert np.mean([models.is_secret("".join(rng.choices(alphabet, k=16))) for _ in range(200)]) > 0.95


def test_secrets_in_texts(spark, sf):
    """Keys planted into the documents are found where they stand, and nothing else is."""
    rng = random.Random(6)
    rows, planted = [], {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 3000").orderBy("doc_id").limit(100).collect():
        key = "".join(rng.choices(secret_scan.ALPHABETS[rng.randrange(1, len(secret_scan.ALPHABETS) - 2)], k=rng.randint(18, 40)))
        at = r["text"].find(" ") + 1
        rows.append((r["doc_id"], r["text"][:at] + "path/" + key + " " + r["text"][at:]))
        planted[r["doc_id"]] = key
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hit = 0
    for r in secret_scan.find_secrets(df).join(df, "doc_id").collect():
        found = [r["text"][int(s) : int(e)] for k, s, e in (x.split(":") for x in r["spans"].split(",") if x) if k == "markov"]
        good = [x for x in found if len(set(range(len(x)))) and (x in "path/" + planted[r["doc_id"]] or planted[r["doc_id"]] in x)]
        hit += bool(good)
        assert len(found) - len(good) <= 1
    assert hit >= 95


def test_what_a_fixed_span_leaves_of_a_run():
    models = secret_scan.made_models()
    text = "x " + "Zx8Qp2Lm9Vt4Rk7Nw3Yb6Hc1Gd5" + "0123456789abcdef" * 2 + "/Zx8Qp2Lm9Vt4Rk7Nw3Yb6Hc1Gd5"
    base = secret_scan.base_spans(text)
    found = [text[s:e] for s, _, e in secret_scan.model_spans(text, base, models)]
    assert len(base) == 1 and len(found) == 2 and all("Zx8Qp2Lm9Vt4Rk7Nw3Yb6Hc1G" in x for x in found)


# 10 ------------------------------------------------------------------------------------


def code_length(text, samples, order):
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for s in samples:
        p = b"\0" * order + s
        for i in range(len(s)):
            for k in range(order + 1):
                counts[k][p[i + order - k : i + order]][p[i + order]] += 1
    p, bits = b"\0" * order + text, 0.0
    for i in range(len(text)):
        for k in range(order, -1, -1):
            if (c := counts[k].get(p[i + order - k : i + order])) is None:
                continue
            n, b = sum(c.values()) + len(c), c.get(p[i + order])
            bits -= math.log2((b or len(c)) / n)
            if b:
                break
        else:
            bits += 8
    return bits


@pytest.mark.parametrize("order", [1, 3, 4])
def test_code_lengths_are_exact(order):
    texts = {"a": ["the cat and the dog".encode(), b"an", b""], "b": ["der Hund über die Straße".encode()], "c": [b"zzzz"]}
    trees = language_id.Trees(texts, order)
    for t in ("the dog über", "zzz the", "qx", "ß"):
        assert np.allclose(trees.lengths(t.encode()), [code_length(t.encode(), texts[k], order) for k in trees.languages])


def test_pieces_do_not_change_a_length(monkeypatch):
    trees = language_id.Trees({"a": [b"the cat and the dog"], "b": [b"abcabc"]})
    whole = trees.lengths(b"the abc cat " * 20)
    monkeypatch.setattr(language_id, "PIECE", 7)
    assert np.allclose(trees.lengths(b"the abc cat " * 20), whole)


def test_language_id(edge_docs, no_docs):
    trees = language_id.Trees(language_id.learning_sample(edge_docs))
    got = {r["doc_id"]: r for r in language_id.identify(edge_docs, trees).collect()}
    assert {got[k]["lang_pred"] for k in (0, 1, 2, 12)} == {"und"} and all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.identify(no_docs, trees).count() == 0
    nothing = language_id.Trees(language_id.learning_sample(no_docs))
    assert {r["lang_pred"] for r in language_id.identify(edge_docs, nothing).collect()} == {"und"}


def test_learning_sample_is_bounded(spark):
    rows = [(k, "word " * (k % 7 + 1), "en" if k % 3 else "de") for k in range(200)] + [(7, "word " * 4, "en")] * 50 + [(999, "x" * 100_000, "fr"), (None, "nur so", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = language_id.learning_sample(df, docs_per_language=30, language_bytes=4000, all_bytes=6000)
    assert sorted(got) == ["de", "en"] and all(len(v) <= 30 and sum(map(len, v)) <= 2000 for v in got.values())
    assert got == language_id.learning_sample(df.repartition(2), docs_per_language=30, language_bytes=4000, all_bytes=6000)


def test_held_out_accuracy(spark, sf):
    rows = language_id.op10_ppm_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
