"""Venue matching: distinct names, a long index, scored candidates, one decision each.

Names are matched once, with their frequencies. The index of the ranked venues is a long
table (key kind, key, venue, type, score), so every exact kind of match is an equi-join.
Set similarity joins on the rarest tokens of a name only (as many as a similar name can
lack, plus one), and a name inside a title is looked for by its rarest piece of three
characters, so neither compares all names with all venues.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X

# Scores, thresholds, names of types and states, and frozen names.
ACCEPT, REVIEW, MARGIN, OVERLAP, BRIDGE_MARGIN = 0.88, 0.60, 0.08, 0.70, 1.10
FROZEN_CONFERENCES = ["ias", "icec", "icic", "iceis", "icca", "dft", "nems", "tsd"]
FROZEN_JOURNALS = ["jcp"]
TITLE, ACRONYM, DERIVED, FORMER = ("exact-title", 0.99), ("exact-acronym", 0.99), ("derived-acronym", 0.90), ("historical-alias", 0.94)
ALIAS, ALIAS_ACRONYM, LOOSE, PARENT, SEGMENT = ("metadata-alias", 0.97), ("metadata-alias", 0.96), ("variant-strip", 0.97), ("parent-series", 0.96), ("segment-acronym", 1.0)
CONTAINS, TOKENS, REGISTRY, JOURNAL_REGISTRY, JOURNAL_SERIES = ("title-contains-query", 0.86), "token-overlap", ("dblp-local-csv-registry", 0.96), ("dblp-local-csv-registry", 0.95), ("dblp-local-csv-exact-series", 0.95)
EXTERNAL = (("issn", 1.0), ("title", 0.92), ("alt-title", 0.96))
CERTAIN, CERTAIN_SCORE = ["exact-title", "exact-acronym", "metadata-alias"], 0.97
AMBIGUOUS = ["exact-acronym", "derived-acronym", "segment-acronym"]
BRIDGED, BRIDGED_SCORE = ["manual-match", "exact-title", "exact-acronym", "historical-alias", "segment-acronym", "metadata-alias"], 0.94
RECONCILED, RECONCILED_SCORE = ["manual-match", "exact-title", "exact-acronym", "segment-acronym"], 0.98
# End of fixed values.

CANDIDATE = ("name", "venue_id", "title", "match_type", "score", "step")


def with_forms(df: DataFrame, name: str, journal: bool = False) -> DataFrame:
    return df.withColumns({f"f_{k}": v for k, v in X.venue_forms(F.col(name), journal).items()})


def _typed(kind: str, key: Column, match: tuple[str, float] | tuple[Column, Column]) -> Column:
    match_type, score = (x if isinstance(x, Column) else F.lit(x) for x in match)
    return F.struct(F.lit(kind).alias("kind"), key.alias("key"), match_type.alias("match_type"), score.alias("score"))


def build_index(venues: DataFrame, journal: bool = False) -> DataFrame:
    """kind, key, venue_id, title, match_type, score. venues: venue_id, title, acronym, aliases array<string>."""
    df = with_forms(venues, "title", journal)
    derived = X.derived_initialisms(F.col("title"))
    derived = F.array_distinct(F.concat(derived, X.derived_initialisms(X.expand_journal_abbreviations(F.col("title"))))) if journal else derived
    acronym = X.compact_key(F.col("acronym"))
    forms = F.array("f_strict", "f_loose", "f_parent")
    own = F.concat(
        F.transform(forms, lambda k: _typed("variant", k, TITLE)),
        F.array(_typed("compact", X.compact_key(F.col("title")), TITLE), _typed("acronym", acronym, ACRONYM)),
        F.transform(F.filter(derived, lambda d: d != acronym), lambda k: _typed("acronym", k, DERIVED)),
    )
    said = F.concat(F.transform(X.historical_aliases(F.col("title")), lambda a: F.struct(a.alias("alias"), F.lit(True).alias("former"))), F.transform("aliases", lambda a: F.struct(a.alias("alias"), F.lit(False).alias("former"))))
    other = with_forms(venues.select("venue_id", "title", F.explode(said).alias("a")).select("venue_id", "title", "a.*"), "alias", journal)
    pick = lambda k: (F.when(F.col("former"), FORMER[0]).otherwise(ALIAS[0]), F.when(F.col("former"), FORMER[1]).otherwise(k))
    more = F.concat(F.transform(forms, lambda k: _typed("variant", k, pick(ALIAS[1]))), F.transform("f_acronyms", lambda k: _typed("acronym", k, pick(ALIAS_ACRONYM[1]))))
    rows = df.select("venue_id", "title", F.explode(own).alias("e")).unionByName(other.select("venue_id", "title", F.explode(more).alias("e")))
    return rows.select("venue_id", "title", "e.*").filter("key != ''").distinct()


def query_keys(names: DataFrame, journal: bool = False) -> DataFrame:
    """name, step, kind, key, as_type and as_score of every name: what it is looked up by, best evidence first.

    ``as_type`` replaces the index's type: a name that is found without its wrappers or
    variant labels, or by a piece of it. ``former`` keys only find former names.
    """
    df = with_forms(names.select("name").distinct(), "name", journal)
    whole = X.compact_key(F.col("name"))
    composite = F.col("name").rlike("[-/]")

    def entry(step: int, kind: str, key: Column, how: tuple[str, float] | None = None, former: Column | None = None) -> Column:
        return F.struct(
            F.lit(step).alias("step"), F.lit(kind).alias("kind"), key.alias("key"), F.lit(how[0] if how else None).cast("string").alias("as_type"), F.lit(how[1] if how else None).cast("double").alias("as_score"),
            (former if former is not None else F.lit(False)).alias("former"),
        )

    def variant(step: int, form: str, how: tuple[str, float] | None) -> list[Column]:
        key = F.when(F.col(form) != F.col("f_strict"), F.col(form)).otherwise("") if how else F.col(form)
        return [entry(step, "variant", key, how), entry(step, "compact", X.compact_key(key), how)]

    pieces = F.filter(F.flatten(F.transform("f_segments", lambda s: F.split(s, "-"))), lambda p: F.length(p) >= 5)
    keys = F.concat(
        F.array(*variant(0, "f_strict", None), *variant(1, "f_loose", LOOSE), *variant(2, "f_parent", PARENT)),
        F.array(entry(3, "acronym", F.when(F.length(whole).between(2, 24), whole).otherwise(""))),
        F.transform(pieces, lambda k: entry(4, "acronym", k, SEGMENT)),
        F.transform("f_acronyms", lambda k: entry(5, "acronym", k, None, composite & (k != whole) & (F.length(k) < 5))),
    )
    return df.select("name", F.explode(F.array_distinct(keys)).alias("e")).select("name", "e.*").filter("key != ''")


def indexed_candidates(names: DataFrame, index: DataFrame, journal: bool = False) -> DataFrame:
    """Candidates by equal keys."""
    j = query_keys(names, journal).join(index, ["kind", "key"]).filter(~F.col("former") | (F.col("match_type") == FORMER[0]))
    keeps = (F.col("step") == 4) & (F.col("match_type") == FORMER[0])
    kind = F.when(keeps, F.col("match_type")).otherwise(F.coalesce("as_type", "match_type"))
    return j.select("name", "venue_id", "title", kind.alias("match_type"), F.coalesce("as_score", "score").alias("score"), "step")


def _pieces(key: Column, size: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(key) - size + 1)), lambda k: F.substring(key, k, size)))


def contained_names(names: DataFrame, venues: DataFrame) -> DataFrame:
    """Names of two tokens and more whose compact form stands inside that of a title.

    A title that holds a name holds its rarest piece of three characters (two for shorter names).
    Names meet each title once, then the venues that have it. Pieces and venues are many more
    bytes than their files let Spark expect, so neither is broadcast; the counts are, as there
    are no more than 36**2 + 36**3 pieces.
    """
    n = names.groupBy("name").agg(F.count(F.lit(1)).alias("_rows"))
    n = n.withColumns({"_n": X.compact_key(F.col("name")), "_k": F.size(F.array_distinct(X.venue_forms(F.col("name"))["tokens"]))})
    # with the number of rows among them, the forms are not moved ahead of the grouping, to every row
    n = n.filter(F.least(F.col("_k"), F.length("_n"), F.col("_rows") + 1) >= 2).withColumn("_size", F.least(F.lit(3), F.length("_n")))
    titles = venues.select("title").distinct().withColumn("_t", X.compact_key(F.col("title")))
    held = F.concat(*[_pieces(F.col("_t"), F.lit(k)) for k in (2, 3)])
    pieces = titles.select("title", "_t", F.explode(F.array_distinct(held)).alias("_piece"))
    df = pieces.groupBy("_piece").agg(F.count(F.lit(1)).alias("_df"))
    own = n.select("name", "_n", F.explode(_pieces(F.col("_n"), F.col("_size"))).alias("_piece")).join(F.broadcast(df), "_piece", "left")
    rarest = own.groupBy("name", "_n").agg(F.min_by("_piece", F.struct(F.coalesce("_df", F.lit(0)), F.col("_piece"))).alias("_piece"))
    met = rarest.join(pieces.hint("merge"), "_piece").filter(F.contains(F.col("_t"), F.col("_n"))).select("name", "title")
    found = met.join(venues.select("venue_id", "title").hint("merge"), "title")
    return found.select("name", "venue_id", "title", F.lit(CONTAINS[0]).alias("match_type"), F.lit(CONTAINS[1]).alias("score"), F.lit(6).alias("step"))


def overlapping_names(names: DataFrame, venues: DataFrame, least: float = OVERLAP) -> DataFrame:
    """Names and titles whose tokens (of their parent forms) overlap enough.

    Sets of a and b tokens that share ``least`` of the larger one share one of the
    a - ceil(least * a) + 1 rarest tokens of either, so only those are joined.
    """
    tokens = lambda df, c, *keep: df.select(*keep, F.array_distinct(X.venue_forms(F.col(c))["tokens"]).alias("_tokens")).filter(F.size("_tokens") > 0)
    n, v = tokens(names.select("name").distinct(), "name", "name"), tokens(venues, "title", "venue_id", "title")
    df = v.select(F.explode("_tokens").alias("_token")).groupBy("_token").agg(F.count(F.lit(1)).alias("_df"))

    def rare(side: DataFrame, *keys: str) -> DataFrame:
        per = side.withColumn("_token", F.explode("_tokens")).join(df, "_token", "left").groupBy(*keys, "_tokens").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_df", F.lit(0)).alias("d"), F.col("_token").alias("t")))).alias("_o"))
        size = F.size("_tokens")
        return per.withColumn("_token", F.explode(F.slice(F.transform("_o", lambda x: x["t"]), F.lit(1), size - F.ceil(size * least - 1e-9).cast("int") + 1))).drop("_o")

    pairs = rare(n, "name").join(rare(v, "venue_id", "title").withColumnRenamed("_tokens", "_other"), "_token").drop("_token").distinct()
    scored = pairs.withColumn("_s", X.token_overlap(F.col("_tokens"), F.col("_other"))).filter(F.col("_s") >= least)
    return scored.select("name", "venue_id", "title", F.lit(TOKENS).alias("match_type"), (0.80 + F.col("_s") * 0.10).alias("score"), F.lit(7).alias("step"))


def prefix_matches(names: DataFrame, venues: DataFrame, least: float = 0.40, least_short: float = 0.70) -> DataFrame:
    """Best venue of each name by tokens that are prefixes of each other, with its confidence.

    Of two such tokens the shorter one's first three characters (or all it has) begin the other.
    """
    n = names.select("name", X.journal_tokens(F.col("name")).alias("_a")).distinct()
    v = venues.select("venue_id", "title", X.journal_tokens(F.col("title")).alias("_b"))
    short = lambda c: F.array_distinct(F.transform(c, lambda t: F.substring(t, 1, 3)))
    every = lambda c: F.array_distinct(F.flatten(F.transform(c, lambda t: F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.length(t))), lambda k: F.substring(t, F.lit(1), k)))))
    met = lambda a, b: n.withColumn("_f", F.explode(a("_a"))).join(v.withColumn("_f", F.explode(b("_b"))), "_f").drop("_f")
    pairs = met(short, every).unionByName(met(every, short)).distinct()
    scored = pairs.withColumn("score", X.prefix_overlap(F.col("_a"), F.col("_b")))
    bound = F.when(F.greatest(F.size("_a"), F.size("_b")) <= 2, least_short).otherwise(least)
    best = Window.partitionBy("name").orderBy(F.desc("score"), "venue_id")
    first = scored.filter(F.col("score") >= bound).withColumn("_n", F.row_number().over(best)).filter("_n = 1")
    return first.select("name", "venue_id", "title", F.lit("prefix-overlap").alias("match_type"), "score", journal_confidence(F.col("score")).alias("confidence"))


def external_candidates(external: DataFrame, venues: DataFrame) -> DataFrame:
    """Candidates that outside sources speak for: by ISSN, by title, by another title.

    external: name, source, display_name, other_titles array, issns array (all forms).
    venues: venue_id, title, aliases array, issns array.
    """
    issn = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), X.normalize_issn), lambda x: x != "")
    keys = lambda c: F.filter(F.transform(c, X.compact_key), lambda x: x != "")
    titles = F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))
    v_issn = venues.select("venue_id", "title", F.explode(issn(F.col("issns"))).alias("_key")).distinct()
    v_title = venues.select("venue_id", "title", X.compact_key(F.col("title")).alias("_key"))
    v_any = venues.select("venue_id", "title", F.explode(keys(titles)).alias("_key")).distinct()
    name = external.select("name", "source", X.compact_key(F.col("display_name")).alias("_key"))
    any_ = external.select("name", "source", F.explode(F.concat(keys(F.array("display_name")), keys(F.coalesce("other_titles", F.array().cast("array<string>"))))).alias("_key"))
    by_issn = external.select("name", "source", F.explode(issn(F.col("issns"))).alias("_key")).join(v_issn, "_key")
    by_title = name.filter("_key != ''").join(v_title, "_key")
    by_other = any_.join(v_any, "_key").join(by_title.select("name", "source", "venue_id"), ["name", "source", "venue_id"], "left_anti")
    parts = [df.select("name", "venue_id", "title", F.concat(F.col("source"), F.lit("-" + kind)).alias("match_type"), F.lit(score).alias("score"), F.lit(8 + k).alias("step")).distinct() for k, (df, (kind, score)) in enumerate(zip((by_issn, by_title, by_other), EXTERNAL, strict=True))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def ranked(candidates: DataFrame, keep: int = 5) -> DataFrame:
    """Best candidate per venue, places by score and title, number of venues, runner-up and margin."""
    order = ["step"] if "step" in candidates.columns else []
    per = Window.partitionBy("name", "venue_id").orderBy(F.desc("score"), *order, "match_type")
    best = candidates.withColumn("_n", F.row_number().over(per)).filter("_n = 1").drop("_n")
    w = Window.partitionBy("name").orderBy(F.desc("score"), F.lower("title"), "venue_id")
    df = best.withColumns({"place": F.row_number().over(w), "runner_up": F.coalesce(F.lead("score").over(w), F.lit(0.0)), "runner_up_type": F.lead("match_type").over(w), "n_candidates": F.count(F.lit(1)).over(Window.partitionBy("name"))})
    return df.withColumn("margin", F.col("score") - F.col("runner_up")).filter(F.col("place") <= keep)


def confidence(score: Column) -> Column:
    return F.when(score >= 0.95, "high").when(score >= 0.75, "medium").otherwise("low")


def journal_confidence(score: Column) -> Column:
    return F.when(score >= 0.70, "high").when(score >= 0.55, "medium").otherwise("low")


def base_key(name: Column) -> Column:
    """Compact form without a number in parentheses at the end."""
    return X.compact_key(F.trim(F.regexp_replace(X.text(name), r"(?i)\(\s*\d+[\w\s-]*\)$", "")))


def overridden(names: DataFrame, manual: DataFrame, journal: bool = False) -> DataFrame:
    """name and the decision about it of names that people have decided on.

    manual: name_key (compact), action (match, skip, non_venue, unmatch), venue_id. A name is
    looked up by its own compact form, then by those of its strict, loose and parent forms.
    """
    keys = with_forms(names.select("name").distinct(), "name", journal).select("name", F.posexplode(F.transform(F.array("name", "f_strict", "f_loose", "f_parent"), X.compact_key)).alias("_p", "_key"))
    m = manual.select(F.col("name_key").alias("_key"), F.lower("action").alias("_action"), F.col("venue_id").alias("_venue")).filter("_key != ''")
    found = keys.join(m, "_key").groupBy("name").agg(F.min_by(F.struct("_action", "_venue"), F.struct("_p", "_action")).alias("m")).select("name", "m.*")
    a, known = F.col("_action"), F.col("_venue").isNotNull()
    off = a.isin("non_venue", "skip", "unmatch")
    status = F.when(a == "non_venue", "non_venue").when(off, "skipped").when(known, "matched").otherwise("review")
    kind = F.when(off, F.concat(F.lit("manual-"), F.replace("_action", F.lit("_"), F.lit("-")))).when(known, "manual-match").otherwise("manual-review")
    return found.select("name", status.alias("status"), F.when(~off, F.col("_venue")).alias("venue_id"), kind.alias("match_type"), F.when(~off & ~known, 0.0).otherwise(1.0).alias("score"), F.when(off, status).when(known, "high").otherwise("review").alias("confidence"))


DECISION = ("name", "status", "venue_id", "match_type", "score", "margin", "confidence", "n_candidates")


def decide(names: DataFrame, candidates: DataFrame, manual: DataFrame | None = None, conflicts: list[str] | None = None, journal: bool = False) -> DataFrame:
    """name, status, venue_id (of matched names only), match_type, score, margin, confidence and n_candidates of every name.

    The confidence of a name that is not matched is its state.
    """
    df = names.select("name").distinct().join(ranked(candidates, 1), "name", "left")
    acronyms = X.venue_forms(F.col("name"), journal)["acronyms"]
    clash = F.arrays_overlap(acronyms, F.array(*[F.lit(x) for x in conflicts])) if conflicts else F.lit(False)
    if not journal:
        clash = clash | (X.looks_acronym_like(F.col("name")) & base_key(F.col("name")).isin(FROZEN_CONFERENCES))
    t, s, margin = F.col("match_type"), F.coalesce("score", F.lit(0.0)), F.coalesce("margin", F.lit(0.0))
    issn = t.endswith("-issn") & ~F.coalesce(F.col("runner_up_type").endswith("-issn"), F.lit(False))
    ambiguous = ~issn & clash & t.isin(AMBIGUOUS)
    certain = t.isin(CERTAIN) & (s >= CERTAIN_SCORE)
    status = F.when(t.isNull(), "unmatched").when(issn, "matched").when(ambiguous, "review").when(certain | ((s >= ACCEPT) & (margin >= MARGIN)), "matched").when(s >= REVIEW, "review").otherwise("unmatched")
    df = df.withColumn("status", status)
    matched = F.col("status") == "matched"
    kind = F.when(F.col("status") == "unmatched", "unmatched").when(ambiguous, "ambiguous-acronym").otherwise(t)
    df = df.select(
        "name", "status", F.when(matched, F.col("venue_id")).alias("venue_id"), kind.alias("match_type"), s.alias("score"), margin.alias("margin"),
        F.when(matched & issn, "high").when(matched, confidence(s)).otherwise(F.col("status")).alias("confidence"), F.coalesce("n_candidates", F.lit(0).cast("long")).alias("n_candidates"),
    )
    if manual is None:
        return df
    said = overridden(names, manual, journal)
    rest = df.join(said.select("name"), "name", "left_anti")
    return rest.unionByName(said.select("*", F.lit(0.0).alias("margin"), F.when(F.col("match_type") == "manual-match", 1).otherwise(0).cast("long").alias("n_candidates")).select(*DECISION))


def match_venues(names: DataFrame, venues: DataFrame, manual: DataFrame | None = None, conflicts: list[str] | None = None, journal: bool = False, external: DataFrame | None = None) -> DataFrame:
    """Index, candidates and decision in one plan. Substrings and token overlap are for conferences only."""
    distinct = names.select("name").distinct()
    found = indexed_candidates(distinct, build_index(venues, journal), journal)
    if not journal:
        found = found.unionByName(contained_names(distinct, venues)).unionByName(overlapping_names(distinct, venues))
    if external is not None:
        found = found.unionByName(external_candidates(external, venues))
    return decide(distinct, found, manual, conflicts, journal)


def risky(name: Column) -> Column:
    """Short abbreviations of journals, and the frozen ones."""
    key = X.compact_key(name)
    return X.looks_acronym_like(name) & ((F.length(key) <= 6) | key.isin(FROZEN_JOURNALS))


def freeze_risky(decisions: DataFrame) -> DataFrame:
    """Matched journal names that go back to review: frozen ones unless by ISSN, and short abbreviations with a near tie."""
    frozen = X.compact_key(F.col("name")).isin(FROZEN_JOURNALS) & ~F.col("match_type").endswith("-issn")
    tie = (F.col("n_candidates") > 1) & (F.col("margin") < MARGIN) & risky(F.col("name"))
    back = (F.col("status") == "matched") & (frozen | tie)
    put = lambda c, v: F.when(back, v).otherwise(F.col(c)).alias(c)
    return decisions.select("name", put("status", F.lit("review")), F.when(~back, F.col("venue_id")).alias("venue_id"), "match_type", "score", "margin", put("confidence", F.lit("review")), "n_candidates")


def blocked_reason(journal: bool = False, series: Column | None = None) -> Column:
    """Why a decision is not a match, in words; empty for matched names."""
    status, kind = F.col("status"), F.col("match_type")
    near = (F.col("n_candidates") > 1) & (F.col("margin") < MARGIN)
    out = F.when(status == "non_venue", "explicitly marked non-rankable").when(status == "skipped", "explicitly skipped by review policy")
    out = out.when(kind == "ambiguous-acronym", "blocked by acronym collision; requires constrained candidate evidence")
    if journal:
        out = out.when((status == "review") & near & risky(F.col("name")), "risky-abbreviation-near-tie")
    out = out.when((status == "review") & near, "blocked by low margin between top candidates")
    out = out.when((status == "review") & kind.isin("metadata-alias", "derived-acronym", "segment-acronym", "exact-acronym"), "blocked pending reviewed alias approval")
    out = out.when(status == "review", "blocked by conservative acceptance threshold")
    if journal:
        out = out.when((status == "unmatched") & X.looks_non_rankable(F.col("name")), "likely non-rankable publication family")
    elif series is not None:
        out = out.when((status == "unmatched") & (F.coalesce(series, F.lit("")) != ""), "blocked because the DBLP series still has no approved local canonical row or alias")
    return out.when(status == "unmatched", "no conservative candidate found").otherwise("")


def conference_bucket(series: Column) -> Column:
    """A near certain, B ambiguous, C without an approved candidate."""
    name, kind = F.col("name"), F.col("match_type")
    good = (F.col("n_candidates") > 0) & ((F.col("score") >= 0.90) | kind.isin("metadata-alias", "derived-acronym", "segment-acronym"))
    absent = (F.col("status") == "unmatched") & (F.coalesce(series, F.lit("")) != "") & ~name.contains("(")
    return F.when((kind == "ambiguous-acronym") | base_key(name).isin(FROZEN_CONFERENCES), "B").when(absent, "C").when(good, "A").when(X.looks_acronym_like(name), "B").otherwise("C")


def journal_action() -> Column:
    """What a reviewer is advised to do."""
    null = F.col("status").isin("non_venue", "skipped") | X.looks_non_rankable(F.col("name"))
    sure = (F.col("status") == "review") & (F.col("n_candidates") == 1) & (F.col("score") >= 0.90) & F.col("match_type").isin("metadata-alias", "dblp-local-csv-registry")
    return F.when(null, "intentional null / likely not rankable").when(sure, "approve alias").otherwise("review manually")


def approval_ready() -> Column:
    """Whether a journal's proposal can be approved as it stands."""
    return (journal_action() == "approve alias") & (F.col("n_candidates") == 1) & (F.col("score") >= 0.95) & F.col("match_type").isin("metadata-alias", "dblp-local-csv-registry", "dblp-local-csv-exact-series")


def variant_type() -> Column:
    """What kind of name a journal's name is, for the cache of variants."""
    lowered, key = X.clean_for_match(F.col("name")), X.compact_key(F.col("name"))
    null = journal_action() == "intentional null / likely not rankable"
    kind = F.when(lowered.contains("magazine"), "magazine-like").when(lowered.rlike("newsletter|report"), "report-like").otherwise("non-rankable-likely")
    return F.when(null, kind).when((key == F.replace(lowered, F.lit(" "), F.lit(""))) & (F.length(key) <= 8), "abbreviation").otherwise("title-variant")


def review_split(journal: bool, ready: Column, label: Column) -> Column:
    """Which pile a review row goes to: by readiness, then by bucket (conferences) or advice (journals); else null."""
    if journal:
        return F.when(ready | (label == "approve alias"), "approve").when(label == "intentional null / likely not rankable", "intentional_null")
    return F.when(ready, "approve").when(label == "C", "lookup_enrichment").otherwise("collision_review_only")


def proposals(conferences: DataFrame, journals: DataFrame) -> DataFrame:
    """Review rows of both kinds that are nearly certain, by kind, frequency and name. Both: name, n, match_type, score."""
    sure = (F.col("score") >= 0.90) | F.col("match_type").isin("metadata-alias", "derived-acronym")
    both = conferences.withColumn("venue_type", F.lit("conference")).unionByName(journals.withColumn("venue_type", F.lit("journal")))
    return both.filter(sure).orderBy("venue_type", F.desc("n"), F.lower("name"), "name")


def variant_rows(rows: DataFrame, seq: str) -> DataFrame:
    """Rows of the cache of variants: blank ones go, of those that differ in case only the last stays.

    rows: journal_id, variant, variant_type, source, issn, issn_l and an order.
    """
    df = rows.withColumn("variant", X.clean_text(F.col("variant"))).filter("journal_id IS NOT NULL AND variant IS NOT NULL")
    w = Window.partitionBy("journal_id", F.lower("variant"), "variant_type", "source", "issn", "issn_l").orderBy(F.desc(seq))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def title_keys(*titles: Column) -> Column:
    """What journal titles are compared by: strict, loose and parent forms, and the title without parentheses."""
    def keys(t: Column) -> Column:
        f = X.venue_forms(t, True)
        return F.array(f["strict"], f["loose"], f["parent"], X.clean_for_match(X.strip_parentheses(t)))

    return F.array_distinct(F.filter(F.concat(*[keys(t) for t in titles]), lambda k: k != ""))


def audit_rows(before: DataFrame, new: DataFrame) -> DataFrame:
    """The audit table after a run: its rows replace older ones of the same date, kind and normalised name, and get an id.

    Both: id, run_date, venue_type, normalized_name and more columns alike.
    """
    keys = ["run_date", "venue_type", "normalized_name"]
    fresh = new.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), F.substring(F.sha1(F.concat_ws("|", *keys)), 1, 16)))
    return before.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def named_series(papers: DataFrame, name: str, key: str, crossref: str | None = None, journal: bool = False) -> DataFrame:
    """series, name and c (rows) of every pair; conferences by crossref before key, journals without a key by their name."""
    of = X.series_key(F.coalesce(F.nullif(F.trim(crossref), F.lit("")), F.col(key)) if crossref else F.col(key))
    s = papers.select(of.alias("series"), X.clean_text(F.col(name)).alias("name")).filter("name IS NOT NULL")
    s = s.withColumn("series", F.when(F.col("series") == "", F.concat(F.lit("journal/"), X.hyphen_key(F.col("name")))).otherwise(F.col("series"))) if journal else s.filter("startswith(series, 'conf/')")
    return s.groupBy("series", "name").agg(F.count(F.lit(1)).alias("c"))


def build_registry(papers: DataFrame, name: str = "booktitle", key: str = "key", crossref: str | None = None, journal: bool = False) -> DataFrame:
    """Per series: rows, distinct names, dominant and representative name, commonest names, acronyms, parents, abbreviated names.

    The representative is the commonest name that is not abbreviated, then the one of the
    longest key, the longest, the last by alphabet.
    """
    per = named_series(papers, name, key, crossref, journal)
    long_ = X.clean_for_match(X.expand_journal_abbreviations(F.col("name"))) if journal else X.parent_alias(F.col("name"))
    per = per.withColumns({"_short": X.looks_abbreviated(F.col("name")), "_long": F.length(long_), "_parent": X.parent_alias(F.col("name")), "_acronyms": X.venue_forms(F.col("name"), journal)["acronyms"]})
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), F.col("name").alias("n"))))
    best = F.max_by("name", F.struct(~F.col("_short"), F.col("c"), F.col("_long"), F.length("name"), F.lower("name")))
    every = lambda c: F.array_sort(F.collect_set(c))
    df = per.groupBy("series").agg(F.sum("c").alias("row_count"), F.count(F.lit(1)).alias("distinct_names"), best.alias("representative"), F.transform(ordered, lambda x: x["n"]).alias("_names"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_acronyms")))).alias("acronyms"), every(F.nullif("_parent", F.lit(""))).alias("parents"), every(F.when(F.col("_short"), F.col("name"))).alias("_abbreviated"))
    return df.select("series", "row_count", "distinct_names", F.get("_names", 0).alias("dominant"), "representative", F.slice("_names", 1, 10).alias("names"), "acronyms", "parents", F.array_except("_abbreviated", F.array("representative")).alias("abbreviated"), X.canonical_venue_id(F.col("series")).alias("venue_key"))


def series_aliases(papers: DataFrame, name: str = "booktitle", key: str = "key", crossref: str | None = None, journal: bool = False) -> DataFrame:
    """alias, series and count: every key that a series' names are known by, and how many rows speak for it."""
    per = with_forms(named_series(papers, name, key, crossref, journal), "name", journal)
    more = F.array(X.clean_for_match(X.strip_parentheses(F.col("name")))) if journal else F.concat(F.array(X.child_alias(F.col("name")), X.parent_alias(F.col("name"))), F.col("f_segments"))
    keys = F.array_distinct(F.filter(F.concat(F.array("f_strict", "f_loose", "f_parent"), more, F.col("f_acronyms")), lambda k: k != ""))
    return per.select("series", "c", F.explode(keys).alias("alias")).groupBy("alias", "series").agg(F.sum("c").alias("count"))


def series_of_names(names: DataFrame, papers: DataFrame, conflicts: list[str] | None = None, **columns: str) -> DataFrame:
    """name and series: what the name's own rows say most often, else a clear winner of the votes of its keys.

    A winner has more than 1.1 times the votes of the next. Acronyms vote unless one of them is in conflict.
    """
    own = named_series(papers, **({"name": "booktitle", "key": "key"} | columns)).groupBy("name").agg(F.max_by("series", F.struct("c", "series")).alias("_own"))
    df = with_forms(names.select("name").distinct(), "name")
    clash = F.arrays_overlap("f_acronyms", F.array(*[F.lit(x) for x in conflicts])) if conflicts else F.lit(False)
    acronyms = F.when(~clash, F.col("f_acronyms")).otherwise(F.array().cast("array<string>"))
    keys = F.array_distinct(F.filter(F.concat(F.array("f_strict", "f_loose", "f_parent"), "f_segments", acronyms), lambda k: k != ""))
    votes = df.select("name", F.explode(keys).alias("alias")).join(series_aliases(papers, **columns), "alias").groupBy("name", "series").agg(F.sum("count").alias("votes"))
    w = Window.partitionBy("name").orderBy(F.desc("votes"), "series")
    best = votes.withColumns({"_n": F.row_number().over(w), "_next": F.coalesce(F.lead("votes").over(w), F.lit(0))}).filter((F.col("_n") == 1) & (F.col("votes") > F.col("_next") * BRIDGE_MARGIN))
    j = names.select("name").distinct().join(own, "name", "left").join(best.select("name", "series"), "name", "left")
    return j.select("name", F.coalesce("_own", "series").alias("series")).filter("series IS NOT NULL")


def registry_bridge(decisions: DataFrame, name_series: DataFrame, series_venues: DataFrame) -> DataFrame:
    """Names not matched yet whose series (``series_of_names``) has a venue. series_venues: series, venue_id."""
    found = name_series.join(series_venues.select("series", F.col("venue_id").alias("_venue")), "series").select("name", "_venue")
    use = (F.col("status") != "matched") & F.col("_venue").isNotNull()
    put = lambda c, v: F.when(use, v).otherwise(F.col(c)).alias(c)
    cols = {"status": "matched", "match_type": REGISTRY[0], "score": REGISTRY[1], "confidence": "high"}
    j = decisions.join(found, "name", "left")
    return j.select(*[put(c, F.lit(cols[c])) if c in cols else put(c, F.col("_venue")) if c == "venue_id" else F.col(c) for c in decisions.columns])


def reconcile_series(series_venues: DataFrame, registry: DataFrame, venues: DataFrame, **how) -> DataFrame:
    """series, venue_id, previous_id: a series' venue gives way to what its representative name matches for certain."""
    titles = registry.select("series", F.coalesce("representative", "dominant").alias("name")).join(series_venues, "series")
    d = match_venues(titles, venues, **how).filter((F.col("status") == "matched") & F.col("match_type").isin(RECONCILED) & (F.col("score") >= RECONCILED_SCORE)).select("name", F.col("venue_id").alias("_new"))
    j = series_venues.join(titles.select("series", "name"), "series", "left").join(d, "name", "left")
    return j.select("series", F.coalesce("_new", "venue_id").alias("venue_id"), F.when(F.col("_new") != F.col("venue_id"), F.col("venue_id")).alias("previous_id"))


def infer_series(series_venues: DataFrame, registry: DataFrame, venues: DataFrame, least: int = 5, **how) -> DataFrame:
    """series and venue_id of series without a venue and with ``least`` rows: the first accepted of their representative, dominant and three commonest names."""
    open_ = registry.filter(F.col("row_count") >= least).join(series_venues, "series", "left_anti")
    tries = open_.select("series", F.posexplode(F.concat(F.array("representative", "dominant"), F.slice("names", 1, 3))).alias("_p", "name"))
    d = match_venues(tries, venues, **how).filter((F.col("status") == "matched") & F.col("match_type").isin(BRIDGED) & (F.col("score") >= BRIDGED_SCORE)).select("name", "venue_id")
    return tries.join(d, "name").groupBy("series").agg(F.min_by("venue_id", "_p").alias("venue_id"))


def journal_registry_map(papers: DataFrame, venues: DataFrame, **columns: str) -> DataFrame:
    """series and venue_id of journal series whose names meet the keys of one venue only. venues: venue_id, title, aliases."""
    names = named_series(papers, **columns, journal=True).select("series", F.explode(title_keys(F.col("name"))).alias("key"))
    own = venues.select("venue_id", F.explode(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("t")).select("venue_id", F.explode(title_keys(F.col("t"))).alias("key"))
    per = names.join(own, "key").groupBy("series").agg(F.min("venue_id").alias("venue_id"), F.max("venue_id").alias("_other"))
    return per.filter("venue_id = _other").select("series", "venue_id")


def match_journal_registry(names: DataFrame, papers: DataFrame, venues: DataFrame, **columns: str) -> DataFrame:
    """name, status, venue_id, match_type and score of journal names by the series that know them.

    One series with a venue is a match. Of several, those whose representative name is the
    name decide if they agree on one venue; otherwise the name goes to review.
    """
    df = with_forms(names.select("name").distinct(), "name", True)
    keys = F.array_distinct(F.filter(F.concat(F.array("f_strict", "f_loose", "f_parent", X.clean_for_match(X.strip_parentheses(F.col("name"))), X.clean_for_match(F.col("name"))), F.col("f_acronyms")), lambda k: k != ""))
    hits = df.select("name", F.explode(keys).alias("alias")).join(series_aliases(papers, **columns, journal=True), "alias").groupBy("name", "series").agg(F.sum("count").alias("votes"))
    registry = build_registry(papers, **columns, journal=True).select("series", F.col("representative").alias("_dominant"))
    j = hits.join(registry, "series").join(journal_registry_map(papers, venues, **columns).withColumnRenamed("venue_id", "_venue"), "series", "left")
    exact = (X.compact_key(F.col("_dominant")) == X.compact_key(F.col("name"))) & F.col("_venue").isNotNull()
    per = j.groupBy("name").agg(F.count(F.lit(1)).alias("_series"), F.min("_venue").alias("_least"), F.max("_venue").alias("_most"), F.min(F.when(exact, F.col("_venue"))).alias("_e1"), F.max(F.when(exact, F.col("_venue"))).alias("_e2"))
    series = (F.col("_series") > 1) & (F.col("_e1") == F.col("_e2"))
    single = (F.col("_series") == 1) & (F.col("_least") == F.col("_most"))
    status = F.when(series | single, "matched").when(F.col("_least").isNotNull(), "review").otherwise("unmatched")
    kind = F.when(series, JOURNAL_SERIES[0]).when(F.col("_least").isNotNull(), JOURNAL_REGISTRY[0]).otherwise("unmatched")
    out = per.select("name", status.alias("status"), F.when(series, F.col("_e1")).when(single, F.col("_least")).alias("venue_id"), kind.alias("match_type"), F.when(F.col("_least").isNotNull(), JOURNAL_REGISTRY[1]).otherwise(0.0).alias("score"))
    none = names.select("name").distinct().join(out.select("name"), "name", "left_anti")
    return out.unionByName(none.select("name", F.lit("unmatched").alias("status"), F.lit(None).cast("long").alias("venue_id"), F.lit("unmatched").alias("match_type"), F.lit(0.0).alias("score")))


def backfill_series(decisions: DataFrame, least: float = 0.96) -> DataFrame:
    """Series that a record takes over: in order of frequency, each record and each series once.

    decisions: name, n, series, venue_id, status, score. Of a record's eligible names the
    most frequent one counts, then of a series' records likewise; the order of the fold is
    kept by ranking twice, as a name only loses to a more frequent one.
    """
    ok = decisions.filter((F.col("status") == "matched") & (F.col("score") >= least) & (F.col("series") != ""))
    order = [F.desc("n"), F.lower("name"), "name"]
    one = ok.withColumn("_r", F.row_number().over(Window.partitionBy("venue_id").orderBy(*order))).filter("_r = 1")
    return one.withColumn("_r", F.row_number().over(Window.partitionBy("series").orderBy(*order))).filter("_r = 1").select("venue_id", "series", "name")


def stage_metrics(decisions: DataFrame) -> DataFrame:
    """Distinct names and rows per stage and status. decisions: match_type, status, n."""
    return decisions.groupBy(X.match_stage(F.col("match_type")).alias("stage"), "status").agg(F.count(F.lit(1)).alias("names"), F.sum("n").alias("row_count"))


def evidence(*columns: str) -> Column:
    """JSON of the columns, keys in order."""
    return F.to_json(F.struct(*sorted(columns)))


def review_rows(candidates: DataFrame, top: int = 3) -> DataFrame:
    """One wide row per name: ids, titles and scores of its best candidates, and the gap between the first two."""
    r = ranked(candidates, top)
    pick = lambda c, k: F.max(F.when(F.col("place") == k, F.col(c)))
    cols = [pick(c, k).alias(f"candidate_{k}_{c}") for k in range(1, top + 1) for c in ("venue_id", "title", "score")]
    return r.groupBy("name").agg(*cols, F.max(F.when(F.col("place") == 1, F.col("margin"))).alias("score_gap"))


def regression_report(baseline: DataFrame, current: DataFrame, review: DataFrame, titles: DataFrame, justified: DataFrame) -> DataFrame:
    """Every name that had a venue and has none now, with that venue's title, what the review says, and a reason given for it.

    baseline: name, venue_id; current: name, venue_id, match_type; review: name, reason,
    candidate; titles: venue_id, title; justified: name, justification.
    """
    lost = regression(baseline, current).join(current.select("name", "match_type"), "name", "left").join(review.select("name", "reason", "candidate"), "name", "left")
    t = titles.select(F.col("venue_id").alias("previous_id"), F.col("title").alias("previous_title"))
    return lost.join(t, "previous_id", "left").join(justified.select("name", "justification"), "name", "left").select("name", "previous_id", "previous_title", "match_type", "candidate", "reason", "justification")


def sync_review(memory: DataFrame, decisions: DataFrame) -> DataFrame:
    """Review memory by name: what people decided stays (rejected for good), pending rows that now match are approved."""
    m, d = memory.select("name", F.col("status").alias("_was"), F.col("venue_id").alias("_had")), decisions.select("name", "status", "venue_id")
    j = m.join(d, "name", "full_outer")
    status = F.when(F.col("_was").isin("approved", "rejected"), F.col("_was")).when(F.col("status") == "matched", "approved").otherwise("pending")
    keep = F.col("_was").isNotNull() | (F.col("status") == "review")
    return j.filter(keep).select("name", status.alias("status"), F.when(F.col("_was").isin("approved", "rejected"), F.col("_had")).otherwise(F.coalesce("venue_id", "_had")).alias("venue_id"))


def regression(before: DataFrame, after: DataFrame) -> DataFrame:
    """Names that had a venue and have none now. Both: name, venue_id."""
    b, a = before.filter("venue_id IS NOT NULL").select("name", F.col("venue_id").alias("previous_id")), after.filter("venue_id IS NOT NULL").select("name")
    return b.join(a, "name", "left_anti")


def require_no_regression(before: DataFrame, after: DataFrame, justified: DataFrame) -> None:
    """Raises if a lost name has no justification."""
    if n := regression(before, after).join(justified.select("name"), "name", "left_anti").count():
        raise ValueError(f"{n} names lost their venue without justification")


def audit_sample(decisions: DataFrame, seed: int = 7, top: int = 20, middle: int = 10, chance: int = 10) -> DataFrame:
    """The most frequent names, some from the middle of the rest, and some by a seeded hash. A report of fixed size."""
    w, every = Window.orderBy(F.desc("n"), "name"), Window.partitionBy()
    df = decisions.withColumns({"_r": F.row_number().over(w), "_all": F.count(F.lit(1)).over(every)})
    mid = ((F.col("_all") - top) / 2).cast("int") + top
    head = F.col("_r") <= top
    centre = ~head & (F.col("_r") > mid - middle // 2) & (F.col("_r") <= mid + middle - middle // 2)
    df = df.withColumn("stratum", F.when(head, "top").when(centre, "middle").otherwise("random"))
    of = Window.partitionBy("stratum").orderBy(F.xxhash64("name", F.lit(seed)))
    return df.withColumn("_h", F.row_number().over(of)).filter((F.col("stratum") != "random") | (F.col("_h") <= chance)).drop("_r", "_all", "_h")
