"""Quality rules: a threshold table compiled into one projection.

Every measure is a built-in expression over the row's own text, so the whole operator is
one narrow stage: no shuffle, no user function, nothing gathered across rows.

Edge cases: a null text has no words and all its measures are 0 (it fails); an empty
text likewise. Ties do not arise. Repeated rows are judged one by one. Columns besides
the text are carried along untouched; measures go into one struct column whose name the
caller may choose, so that they cannot clash with columns of the input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import SPACE_WORD, SPACES, lower_ascii, table

SYMBOLS = "#*$%&|<>"
#: Function words of the corpus languages (en, de, es, fr); a text with none of them is no prose.
STOP_WORDS = (
    "the of and to in is that for it as with on by an at "
    "der die das und den von zu mit sich des auf ist im dem nicht ein eine "
    "de la que el en y a los se del las un por con no una su "
    "le et les des du est dans il au par sur ne pas une"
).split()

#: (measure, comparison that rejects, bound). Measures are those of ``measures``.
THRESHOLDS = (
    ("n_words", "<", 50),
    ("repeat_word_ratio", ">", 0.5),
    ("mean_word_length", "<", 1.5),
    ("mean_word_length", ">", 20.0),
    ("symbol_ratio", ">", 0.5),
    ("dup_line_ratio", ">", 0.7),
    ("stop_word_ratio", "<", 0.01),
)


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SPACE_WORD), F.lit(0))


def _sorted_grams(grams: Column) -> Column:
    """(hash, place) of every three-word window in order, or nothing if all hashes differ."""
    pairs = F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), F.sort_array(pairs)).otherwise(F.slice(pairs, 1, 0))


def _repeated(words: Column, ordered: Column) -> Column:
    """Words inside three-word windows that occur at least twice.

    Neighbours in the order of ``_sorted_grams`` count if their words are equal, not only their hashes.
    """
    same = lambda i, j: reduce(lambda x, y: x & y, [F.get(words, i + k) == F.get(words, j + k) for k in range(3)])
    places = F.transform(
        ordered,
        lambda x, k: F.when((F.get(ordered, k + 1)["g"] == x["g"]) & same(x["i"], F.get(ordered, k + 1)["i"]), True).when(
            (F.get(ordered, k - 1)["g"] == x["g"]) & same(x["i"], F.get(ordered, k - 1)["i"]), True
        ),
    )
    marked = F.filter(F.zip_with(ordered, places, lambda x, m: F.when(m, x["i"])), lambda i: i.isNotNull())
    return F.size(F.array_distinct(F.flatten(F.transform(marked, lambda p: F.array(p, p + 1, p + 2))))).cast("long")


def with_measures(docs: DataFrame, text: str = "text", out: str = "_q") -> DataFrame:
    """Adds struct ``out`` with counts and ratios of ``text``.

    Each step is a flat column of its own, named after ``out``: the optimizer copies the
    fields of a struct into every use, flat columns it computes once.
    """
    own = lambda c: f"{out}__{c}"
    col = lambda c: F.col(own(c))
    df = docs.withColumn(own("text"), F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns({own("words"): word_list(col("text")), own("lines"): F.filter(F.split(col("text"), "\n", -1), lambda s: F.length(F.translate(s, SPACES, "")) > 0)})
    words = col("words")
    grams = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    df = df.withColumns({own("n_words"): F.size(words).cast("long"), own("n_lines"): F.size(col("lines")).cast("long"), own("grams"): F.slice(grams, 1, F.greatest(F.size(words) - 2, F.lit(0)))})
    df = df.withColumn(own("grams"), _sorted_grams(col("grams")))
    counts = {
        "word_chars": F.length(F.translate(col("text"), SPACES, "")).cast("long"),
        "n_symbols": (F.length(col("text")) - F.length(F.translate(col("text"), SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (col("n_lines") - F.size(F.array_distinct(col("lines")))).cast("long"),
        "n_repeat_words": _repeated(words, col("grams")),
        "n_stop_words": F.size(F.filter(words, lambda w: lower_ascii(w).isin(*STOP_WORDS))).cast("long"),
    }
    df = df.withColumns({own(k): v for k, v in counts.items()})
    ratio = lambda a, b: F.coalesce(col(a) / F.nullif(col(b), F.lit(0)), F.lit(0.0))
    ratios = {
        "mean_word_length": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "repeat_word_ratio": ratio("n_repeat_words", "n_words"),
        "stop_word_ratio": ratio("n_stop_words", "n_words"),
    }
    fields = [col(c).alias(c) for c in ("n_words", "n_lines", *counts)] + [v.alias(k) for k, v in ratios.items()]
    return df.withColumn(out, F.struct(*fields)).drop(*[own(c) for c in ("text", "words", "lines", "grams", "n_words", "n_lines", *counts)])


def compile_rules(rules=THRESHOLDS, source: str = "_q") -> Column:
    """One boolean expression, true where any rule of the table rejects the row."""
    ops = {"<": lambda m, b: m < b, ">": lambda m, b: m > b}
    return reduce(lambda x, y: x | y, [ops[op](F.col(f"{source}.{m}"), F.lit(bound)) for m, op, bound in rules])


def judge(docs: DataFrame, text: str = "text", rules=THRESHOLDS, out: str = "_q") -> DataFrame:
    """Adds struct ``out``: the measures, ``base_failed`` and ``kept``.

    To keep the good rows use ``keep_good``: a filter right on this struct would be pushed
    below the projections and copy the measures into itself.
    """
    df = with_measures(docs, text, out)
    q = lambda c: F.col(f"{out}.{c}")
    base = (q("n_words") < 50) | (100 * q("n_repeat_words") > 50 * q("n_words"))
    return df.withColumn(out, F.struct(f"{out}.*", base.alias("base_failed"), (~(base | compile_rules(rules, out))).alias("kept")))


def keep_good(docs: DataFrame, text: str = "text", rules=THRESHOLDS) -> DataFrame:
    """The rows that no rule rejects, with the columns they came with.

    The optimizer would push the filter below all projections and copy every measure into
    it many times over; it does not push a filter below a column that is not deterministic.
    """
    df = judge(docs, text, rules, "_quality_of_text").withColumn("_quality_row", F.monotonically_increasing_id())
    return df.filter(F.col("_quality_of_text.kept") & (F.col("_quality_row") >= 0)).drop("_quality_of_text", "_quality_row")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "_q.n_words", "_q.word_chars", "_q.n_symbols", "_q.n_dup_lines", "_q.n_repeat_words", "_q.base_failed", "_q.kept")


QUERIES = {"op7_quality_rules": op7_quality_rules}

_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
SQL = {
    "op7_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
m AS (
  SELECT rid, doc_id, t, ws, len(ws) AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    len(list_filter(ws, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN ({_STOP}))) AS n_stop
  FROM w),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM m, unnest(range(1, n_words - 1)) AS u(i)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, unnest([0, 1, 2]) AS v(k) GROUP BY rid),
a AS (
  SELECT doc_id, n_words, word_chars, n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, n_stop
  FROM m LEFT JOIN c USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words
    OR word_chars / n_words < 1.5 OR word_chars / n_words > 20.0 OR n_symbols / n_words > 0.5
    OR coalesce(n_dup_lines / nullif(n_lines, 0), 0) > 0.7 OR n_stop / n_words < 0.01) AS kept
FROM a"""
}
