"""Venue text functions as column expressions.

Order of steps is part of each function's meaning. All of them treat null as empty
unless they say otherwise.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Word lists and patterns that results depend on.
STOPWORDS = ["a", "an", "and", "for", "in", "of", "on", "the", "to", "with"]
JOURNAL_STOPWORDS = ["of", "on", "the", "and", "in", "for", "to", "a", "an", "with", "its", "at", "by", "from"]
SPONSORS = ["acm", "gi", "ieee", "ifip", "siam"]
ROMAN = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x"]
JOURNAL_ABBREVIATIONS = [
    ("trans", "transactions"), ("j", "journal"), ("int", "international"), ("intl", "international"), ("knowl", "knowledge"),
    ("eng", "engineering"), ("comput", "computer"), ("comp", "computer"), ("syst", "systems"), ("appl", "applications"),
    ("geom", "geometry"), ("behav", "behaviour"), ("artif", "artificial"), ("intell", "intelligence"), ("inf", "information"),
]
TITLE_ABBREVIATIONS = [(r"int'l\b", "international"), (r"intl\b\.?", "international"), (r"int\b\.?", "international"), (r"confs\b\.?", "conferences"), (r"conf\b\.?", "conference"), (r"symp\b\.?", "symposium"), (r"proc\b\.?", "proceedings")]
NON_RANKABLE = ["magazine", "bulletin", "newsletter", "report", "technical report", "crossroads", "queue", "news", "notes"]
WRAPPERS = (
    r"proceedings(?: of)?|adjunct proceedings(?: of)?|selected papers(?: of)?|companion(?: to)?|satellite activities(?: of)?|tutorial abstracts(?: of)?|"
    r"workshop(?:s)?(?: on| of)?|short papers(?: of)?|posters?(?: of)?|demonstrations?(?: of)?|demos?(?: of)?|doctoral consortium(?: of)?|"
    r"student research workshop(?: of)?|proceedings of the"
)
VARIANT_LABELS = (
    r"adjunct proceedings|selected papers|short papers|demo(?:nstration)?s?|posters?|doctoral consortium|student research workshop|tutorial abstracts|"
    r"workshops?|companion|satellite activities|industrial and tool volume|special sessions?|special session|supplement|volume|vol\.?|part"
)
ALIAS_MARKERS = r"was|previous|prior|former|merged|combined|until"
# End of fixed values.

#: Latin letters with their bases: the fast form of folding. Built by rule from Unicode itself.
_FOLDED = {chr(c): b for c in range(0xC0, 0x250) if len(b := "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) == 1 and b != chr(c)}


def _sub(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, pattern, to)


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def clean_text(c: Column) -> Column:
    """Stripped of all white space at the ends; blank becomes null."""
    return F.nullif(_sub(c, r"(?U)^\s+|\s+$"), F.lit(""))


def clean_year(c: Column) -> Column:
    """Four ASCII digits as a number, else null."""
    return F.when(F.trim(c).rlike(r"^[0-9]{4}$"), F.trim(c).cast("int"))


def split_authors(c: Column) -> Column:
    """Names between bars, stripped, blanks dropped, in order."""
    return F.filter(F.transform(F.split(text(c), r"\|"), lambda x: _sub(x, r"(?U)^\s+|\s+$")), lambda x: x != "")


def ascii_fold(c: Column) -> Column:
    """Latin letters without their marks; ``ascii_fold_exact`` decomposes everything."""
    return F.translate(text(c), "".join(_FOLDED), "".join(_FOLDED.values()))


@F.pandas_udf(T.StringType())
def ascii_fold_exact(values: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks; for distinct names only."""
    return values.map(lambda v: "".join(x for x in unicodedata.normalize("NFKD", v or "") if not unicodedata.combining(x)))


def normalize_spaces(c: Column) -> Column:
    return F.trim(_sub(text(c), r"(?U)\s+", " "))


def roman_volumes(c: Column) -> Column:
    """``vol iv`` becomes ``4``; a numeral beyond ten loses only the marker."""
    out = c
    for n, roman in enumerate(ROMAN, 1):
        out = _sub(out, rf"(?i)\bvol(?:ume)?\.?\s*{roman}\b", str(n))
    return _sub(out, r"(?i)\bvol(?:ume)?\.?\s*([ivxlcdm]+)\b", "$1")


def normalize_issn(c: Column) -> Column:
    return _sub(F.upper(text(c)), "[^0-9X]")


def split_issns(c: Column) -> Column:
    """Normalised numbers between semicolons, blanks dropped."""
    return F.filter(F.transform(F.split(text(c), ";"), normalize_issn), lambda x: x != "")


def map_get(entries: Column, key: Column, default: Column) -> Column:
    """Value of a key in a map, or the default."""
    return F.coalesce(F.element_at(entries, key), default)


def clean_for_match(c: Column) -> Column:
    """Folded, lower case, ``&`` spelled out, volumes in digits, punctuation to blanks."""
    lowered = roman_volumes(F.replace(F.replace(F.lower(ascii_fold(c)), F.lit("ß"), F.lit("ss")), F.lit("&"), F.lit(" and ")))
    return normalize_spaces(_sub(_sub(lowered, "[/-]", " "), r"(?U)[^\w\s]", " "))


def ascii_words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("[a-z0-9]+"), F.lit(0))


def hyphen_key(c: Column) -> Column:
    return F.array_join(ascii_words(clean_for_match(c)), "-")


def compact_key(c: Column) -> Column:
    return _sub(clean_for_match(c), "[^a-z0-9]")


def strip_ends(c: Column) -> Column:
    return F.btrim(c, F.lit(" ,:-"))


def strip_trailing_year(c: Column) -> Column:
    return normalize_spaces(strip_ends(_sub(text(c), r"(?:^|[\s,:\-])(?:18|19|20)\d{2}$")))


def strip_known_prefixes(c: Column) -> Column:
    """Wrappers, "the" and leading years or ordinals, as often as they follow each other.

    One anchored repetition stands for the loop until nothing changes.
    """
    lead = rf"(?i)^(?:[\s,:\-]*(?:(?:{WRAPPERS})\b|the\b|(?:(?:18|19|20)\d{{2}}|\d+(?:st|nd|rd|th))\b))+[\s,:\-]*"
    return strip_ends(_sub(F.trim(text(c)), lead))


# Patterns that results depend on.
_VOLUME = r"(?i)(?:\bvol(?:ume)?\.?\s*(?:\d+|[ivxlcdm]+)\b|\bpart\s+(?:\d+|[ivxlcdm]+)\b|\(\s*(?:\d+|[ivxlcdm]+)\s*\))$"


_CAPITALS = r"\b[A-Z][A-Z0-9/&\-]{1,24}\b"
# End of fixed values.


def strip_variant_noise(c: Column) -> Column:
    """Trailing volumes and variant labels go; parentheses go with a label in them, else they are opened."""
    v = strip_ends(_sub(c, _VOLUME))
    v = _sub(v, rf"(?i)\((?=[^)]*\b(?:{VARIANT_LABELS})\b)[^)]*\)")
    v = _sub(v, r"\(([^)]*)\)", " $1 ")
    v = _sub(v, rf"(?i)\b(?:{VARIANT_LABELS})\b", " ")
    return normalize_spaces(strip_ends(_sub(v, _VOLUME)))


def child_alias(c: Column) -> Column:
    """Key of a name without wrappers and years."""
    return clean_for_match(_sub(strip_trailing_year(strip_known_prefixes(normalize_spaces(c))), r"\b(?:18|19|20)\d{2}\b", " "))


def parent_alias(c: Column) -> Column:
    """Key of a name without wrappers, variant labels, volumes and years."""
    return clean_for_match(_sub(strip_trailing_year(strip_variant_noise(strip_known_prefixes(normalize_spaces(c)))), r"\b(?:18|19|20)\d{2}\b", " "))


def conference_series(crossref: Column, key: Column) -> Column:
    """The first two parts of the first of both that is a conference's; else empty."""
    of = lambda c: F.when(F.startswith(F.trim(c), F.lit("conf/")), F.array_join(F.slice(F.split(F.trim(c), "/"), 1, 2), "/"))
    return F.coalesce(of(crossref), of(key), F.lit(""))


def strip_parentheses(c: Column) -> Column:
    return normalize_spaces(_sub(text(c), r"\([^)]*\)", " "))


def series_key(c: Column) -> Column:
    """The first two parts of a slash-separated key."""
    return F.array_join(F.slice(F.filter(F.split(text(c), "/"), lambda x: x != ""), 1, 2), "/")


def canonical_venue_id(c: Column) -> Column:
    slug = F.array_join(ascii_words(F.lower(ascii_fold(series_key(c)))), "-")
    return F.concat(F.lit("dblp-"), F.when(slug == "", "unknown").otherwise(slug))


def looks_acronym_like(c: Column) -> Column:
    raw = ascii_fold(normalize_spaces(c))
    return (F.length(compact_key(raw)).between(1, 12)) & raw.rlike(r"^[A-Z0-9 .()/+\-]+$")


def looks_non_rankable(c: Column) -> Column:
    return clean_for_match(c).rlike("|".join(NON_RANKABLE))


def looks_abbreviated(c: Column) -> Column:
    """A dot, or all capitals of 2 to 16 characters, or at most three tokens of at most five."""
    t = normalize_spaces(c)
    tokens = F.split(t, " ")
    short = (F.size(tokens) <= 3) & F.forall(tokens, lambda x: F.length(x) <= 5)
    return (t != "") & (t.contains(".") | ((t == F.upper(t)) & t.rlike("(?U)\\p{L}") & F.length(t).between(2, 16)) | short)


def split_segments(c: Column) -> Column:
    return F.filter(F.transform(F.split(text(c), r"[/:,&+|]"), normalize_spaces), lambda x: x != "")


def acronym_candidates(c: Column) -> Column:
    """Compact forms (2 to 24) of capital tokens and of their parts at ``-`` and ``/``, in order of the alphabet."""
    tokens = F.regexp_extract_all(text(c), F.lit(_CAPITALS), F.lit(0))
    parts = F.flatten(F.transform(tokens, lambda t: F.concat(F.array(t), F.split(t, "[-/]"))))
    keys = F.transform(parts, compact_key)
    return F.array_sort(F.array_distinct(F.filter(keys, lambda k: F.length(k).between(2, 24))))


def derived_initialisms(c: Column) -> Column:
    """First letters of at least three words that matter; also without a leading sponsor."""
    words = F.filter(ascii_words(clean_for_match(strip_parentheses(c))), lambda w: ~w.isin(STOPWORDS))
    first = lambda ws: F.array_join(F.transform(ws, lambda w: F.substring(w, 1, 1)), "")
    trimmed = F.when(F.get(words, 0).isin(SPONSORS), first(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))))).otherwise("")
    found = F.array_sort(F.array_distinct(F.filter(F.array(first(words), trimmed), lambda x: F.length(x).between(2, 24))))
    return F.when(F.size(words) < 3, F.array().cast("array<string>")).otherwise(found)


def token_overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the larger set."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.greatest(F.size(a), F.size(b)), F.lit(0)), F.lit(0.0))


def prefix_overlap(source: Column, target: Column) -> Column:
    """Source tokens of which a target token is a prefix, or the other way round, over the larger set."""
    met = F.filter(source, lambda s: F.exists(target, lambda t: F.startswith(t, s) | F.startswith(s, t)))
    return F.coalesce(F.size(met) / F.nullif(F.greatest(F.size(source), F.size(target)), F.lit(0)), F.lit(0.0))


def expand_journal_abbreviations(c: Column) -> Column:
    return reduce(lambda x, rule: _sub(x, rf"(?i)\b{rule[0]}\.?\b", rule[1]), JOURNAL_ABBREVIATIONS, text(c))


def journal_tokens(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(ascii_words(clean_for_match(c)), lambda w: ~w.isin(JOURNAL_STOPWORDS))))


def title_fingerprint(c: Column) -> Column:
    """Lower case, ``&`` spelled out, abbreviations of titles expanded, punctuation to blanks."""
    v = F.replace(F.lower(text(c)), F.lit("&"), F.lit(" and "))
    v = reduce(lambda x, rule: _sub(x, rf"\b{rule[0]}", rule[1]), TITLE_ABBREVIATIONS, v)
    return normalize_spaces(_sub(v, r"[^a-z0-9\s]", " "))


def safe_decimal(c: Column) -> Column:
    """Comma or dot decimals with three places; bad values become null."""
    return F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("decimal(10,3)")


def safe_int(c: Column) -> Column:
    return F.trim(c).try_cast("int")


def area_name(c: Column) -> Column:
    return F.trim(F.btrim(F.trim(text(c)), F.lit('"')))


def truthy(c: Column) -> Column:
    """A flag of a file: anything but a few ways of saying no."""
    return ~F.lower(F.trim(text(c))).isin("", "0", "false", "no", "off", "n")


def match_stage(c: Column) -> Column:
    """Stage of the pipeline that a match type belongs to."""
    t = F.lower(F.trim(text(c)))
    return (
        F.when(t.startswith("manual-") & t.rlike("skip|non-venue|unmatch"), "explicit skip / non_venue")
        .when(t.startswith("manual-"), "manual aliases")
        .when(t.isin("exact-title", "exact-acronym", "derived-acronym", "metadata-alias"), "exact normalized local match")
        .when(t.isin("historical-alias", "segment-acronym", "parent-series", "parent-series-fallback"), "parent-series / variant stripping")
        .when(t.rlike("^dblp|dblp-series-key|dblp-local") & t.rlike("api|online"), "DBLP online fallback")
        .when(t.rlike("^dblp|dblp-series-key|dblp-local"), "DBLP local CSV registry")
        .when(t.startswith("openalex"), "OpenAlex")
        .when(t.startswith("crossref"), "Crossref")
        .otherwise("conservative fuzzy fallback")
    )


def historical_aliases(c: Column) -> Column:
    """Names in parentheses that speak of a former, merged or combined venue: capital tokens, phrases and their parts."""
    groups = F.filter(F.transform(F.regexp_extract_all(text(c), F.lit(r"\(([^)]*)\)"), F.lit(1)), normalize_spaces), lambda g: F.lower(g).rlike(ALIAS_MARKERS))
    own = lambda xs: F.filter(xs, lambda x: (x != "") & ~F.lower(x).isin(SPONSORS))
    tokens = F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(_CAPITALS), F.lit(0))))
    parts = F.flatten(F.transform(tokens, lambda t: F.split(t, "[-/]")))
    said = r"(?i)\b(?:was|previously|prior to \d{4}|prior to|formerly|changed in \d{4}|changed|until \d{4}|until|merged with|merged|combined from \d{4}|combined from|combined)\b"
    phrases = F.filter(F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, "[;,]"))), lambda p: normalize_spaces(_sub(p, said, " "))), lambda p: p != "")
    pieces = F.flatten(F.transform(phrases, lambda p: F.transform(F.split(p, r"\band\b|/|-"), normalize_spaces)))
    return F.array_sort(F.array_distinct(F.concat(own(tokens), own(parts), phrases, own(pieces))))


def venue_forms(c: Column, journal: bool = False) -> dict[str, Column]:
    """strict, loose, parent, tokens, acronyms, segments and variants of a venue name."""
    raw = normalize_spaces(c)
    expanded = expand_journal_abbreviations(raw) if journal else raw
    loose_source = strip_known_prefixes(expanded)
    strict, loose = clean_for_match(expanded), clean_for_match(loose_source)
    parent = clean_for_match(strip_variant_noise(strip_parentheses(loose_source)))
    segment_source = strip_variant_noise(strip_known_prefixes(raw))
    raw_segments = F.when(segment_source.rlike("[-/]"), F.concat(F.array(segment_source), split_segments(segment_source))).otherwise(F.array().cast("array<string>"))
    segments = F.array_sort(F.array_distinct(F.filter(F.transform(raw_segments, hyphen_key), lambda k: k != "")))
    pieces = F.flatten(F.transform(raw_segments, lambda s: F.concat(F.array(s), F.split(s, "[-/]"))))
    of_pieces = F.filter(F.transform(pieces, compact_key), lambda k: F.length(k).between(2, 24))
    acronyms = F.array_sort(F.array_distinct(F.concat(acronym_candidates(raw), derived_initialisms(raw), of_pieces)))
    variants = F.array_sort(F.array_distinct(F.filter(F.concat(F.array(strict, loose, parent, F.replace(parent, F.lit(" "), F.lit("-"))), segments), lambda v: v != "")))
    tokens = ascii_words(F.coalesce(F.nullif(parent, F.lit("")), F.nullif(loose, F.lit("")), strict))
    return {"strict": strict, "loose": loose, "parent": parent, "tokens": tokens, "acronyms": acronyms, "segments": segments, "variants": variants}
