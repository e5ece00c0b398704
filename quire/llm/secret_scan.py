"""Secret scans by character Markov models.

Two models of character chains are trained from labelled samples: random strings (keys,
tokens, digests) and ordinary identifiers and words. In every run of key characters the
stretch with the greatest log-likelihood ratio is taken; it is a secret if the ratio is
above a threshold. A short stretch has to be the more improbable for that, a long one
need not be random throughout, and no length or alphabet is shut out but stretches below
``SHORTEST`` characters. Fixed patterns of known kinds are found beside it and stay
whatever the models say.

The samples: (a) made ones of a fixed number, random strings from a seeded generator over
the usual alphabets, identifiers from common programming words joined in the usual
styles; (b) a bounded sample of the texts themselves (``SAMPLE_DOCS`` documents, the first
by a hash of the id, of at most ``SAMPLE_BYTES`` bytes each), labelled by the fixed
patterns: what they find is a secret, every other run of letters and digits is ordinary.
Runs of the text that the models of (a) alone call random are no samples of either kind.

Edge cases: null and empty texts have no spans; spans of different kinds may overlap and
are all given, a model's span only in what fixed ones leave of a run; repeated rows are
scanned one by one, whatever their ids; an empty table gives no rows, and its models are
those of the made samples. Only the id and the text are read.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "markov")
#: Runs of key characters; letters beyond ASCII on either side make them parts of words.
RUN = re.compile(r"(?<![^\W\d_a-zA-Z])[A-Za-z0-9+/_=-]{10,}(?![^\W\d_a-zA-Z])")
SHORTEST = 10
#: Made samples of each kind, and the bounds of the sample of texts.
SAMPLES, SEED = 4000, 20240601
SAMPLE_DOCS, SAMPLE_BYTES = 2000, 8192
#: Least log-likelihood ratio (in nats) of a secret.
THRESHOLD = 12.0
ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_")
IDENTIFIER_WORDS = (
    "get set add remove update delete create read write load save open close init start stop run test main user name value key item list map index count size type "
    "file path data node tree table row column field string number config option default error message request response server client session cache buffer stream "
    "parse format convert encode decode encrypt hash sort filter merge split join find search match replace insert append copy move check validate handle process "
    "event listener callback handler manager factory builder service model view controller page form button image color width height position start end min max "
    "first last next previous current total average result output input source target parent child root left right top bottom version number date time zone year"
).split()


MARKS = "".join(sorted({c for a in ALPHABETS for c in a} | {"="}))
_AT = {c: k for k, c in enumerate(MARKS)}


def transitions(samples: list[str]) -> list[list[int]]:
    """How often each character follows each other one."""
    n = [[0] * len(MARKS) for _ in MARKS]
    for s in samples:
        at = [_AT[c] for c in s]
        for a, b in zip(at, at[1:]):
            n[a][b] += 1
    return n


def labelled_samples(n: int = SAMPLES, seed: int = SEED) -> tuple[list[str], list[str]]:
    """(random strings, identifiers), made."""
    rng = random.Random(seed)
    secrets = ["".join(rng.choices(ALPHABETS[k % len(ALPHABETS)], k=rng.randint(16, 64))) for k in range(n)]
    names = []
    for _ in range(n):
        parts = rng.choices(IDENTIFIER_WORDS, k=rng.randint(2, 7))
        style = rng.randrange(5)
        name = ("_".join(parts), "-".join(parts), "/".join(parts), parts[0] + "".join(p.title() for p in parts[1:]), "_".join(parts).upper())[style]
        names.append(name + (str(rng.randint(1, 2030)) if rng.random() < 0.3 else ""))
    return secrets, names


class Models:
    """Log-likelihood ratio of every transition: how much more a random string than an ordinary word it is."""

    def __init__(self, secrets: list[str], names: list[str]):
        def log(samples: list[str]) -> list[list[float]]:
            return [[math.log((c + 0.5) / (sum(of) + 0.5 * len(MARKS))) for c in of] for of in transitions(samples)]

        self.ratio = {a: dict(zip(MARKS, (x - y for x, y in zip(s, n, strict=True)), strict=True)) for a, s, n in zip(MARKS, log(secrets), log(names), strict=True)}
        self.known: dict[str, tuple[float, int, int]] = {}

    def best(self, run: str) -> tuple[float, int, int]:
        """(ratio, start, end) of the stretch of the run with the greatest ratio."""
        if (found := self.known.get(run)) is not None:
            return found
        best, total, begin, found = 0.0, 0.0, 0, (0.0, 0, 0)
        ratio = self.ratio
        for k in range(1, len(run)):
            total += ratio[run[k - 1]][run[k]]
            if total <= 0.0:
                total, begin = 0.0, k
            elif total > best:
                best, found = total, (total, begin, k + 1)
        if len(self.known) > 200_000:
            self.known.clear()
        self.known[run] = found
        return found

    def is_secret(self, run: str, threshold: float = THRESHOLD) -> bool:
        score, begin, end = self.best(run)
        return score > threshold and end - begin >= SHORTEST


def made_models() -> Models:
    return Models(*labelled_samples())


def text_samples(texts: list[str]) -> tuple[list[str], list[str]]:
    """(secrets, ordinary runs) of texts, labelled by the fixed patterns."""
    first, secrets, names = made_models(), [], []
    for text in texts:
        base = base_spans(text)
        secrets += [x for s, _, e in base for x in RUN.findall(text[s:e])[-1:]]
        names += [x for x in re.findall(r"[A-Za-z0-9+/_=-]{4,}", text) if not first.is_secret(x)] if not base else []
    return secrets, names


def trained(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Models:
    """Models of the made samples and of a bounded sample of the texts, of which every distinct run counts once."""
    size = F.octet_length(F.col("text").cast("binary"))
    rows = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string")).alias("h")).filter(size <= sample_bytes)
    # a range of hashes that holds a little more than the sample, so no task sends more than its share of it
    n = rows.agg(F.approx_count_distinct("h")).first()[0]
    last = min((1 << 63) - 1, int(-(1 << 63) + 1.3 * sample_docs / max(1, n) * (1 << 64)))
    chosen = rows.filter(F.col("h") <= last).groupBy("h").agg(F.min("text").alias("text")).orderBy("h")
    texts = [r["text"] for r in chosen.collect()][:sample_docs]
    secrets, names = labelled_samples()
    more = text_samples(texts)
    return Models(secrets + sorted(set(more[0])), names + sorted(set(more[1])))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed kinds."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def model_spans(text: str, base: list[tuple[int, int, int]], models: Models, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """Secrets in the runs of the text, or in what the fixed spans leave of them."""
    found, cuts = [], sorted((s, e) for s, _, e in base)
    for m in RUN.finditer(text):
        at, pieces = m.start(), []
        for s, e in cuts:
            if s < m.end() and at < e:
                pieces.append((at, s))
                at = max(at, e)
        for b, e in [*pieces, (at, m.end())]:
            if e - b >= SHORTEST:
                score, first, last = models.best(text[b:e])
                if score > threshold and last - first >= SHORTEST:
                    found.append((b + first, 3, b + last))
    return found


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_secrets(docs: DataFrame, models: Models | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, n_markov and spans of every document."""
    held = docs.sparkSession.sparkContext.broadcast(models or trained(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                more = model_spans(text or "", base, held.value, threshold)
                row = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                for c, v in zip(out, [*row, hashlib.sha256(spelled(base).encode()).hexdigest(), len(more), spelled(base + more)], strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "n_markov", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, n_markov long, spans string")


def op9_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


QUERIES = {"op9_markov_secrets": op9_markov_secrets}
SQL: dict[str, str] = {}
