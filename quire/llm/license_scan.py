"""License scans by a positional index of rare licence words.

Each licence has a template (opening words of its notice) and mandatory key phrases. The
index maps every word of a template or phrase to its postings (which template, which
place). How rare a word is comes from the scanned corpus itself: one pass counts in how
many texts each licence word occurs.

Per text, all inside one projection:

1. its licence words with their places;
2. phrases: the places of a phrase's rarest word, shifted by its offset, are intersected
   with the shifted places of the phrase's other words, rarest first;
3. templates: every word's places vote for where the template would start; the start with
   most votes gives the share of the template's words that stand in place;
4. a label counts if its template stands well enough and its mandatory phrases occur, and
   if no label stands in its way (``UNLESS``).

Rarity only decides in which order postings are looked up and which texts are indexed at
all, so a text's labels do not depend on the texts beside it.

Edge cases: null and empty texts have no words and no labels; ties between starts do not
matter, as only the number of votes counts; repeated rows are scanned one by one; an
empty table gives no rows. Only the id and the text are read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import LETTER_GAP, among, lower_text, table

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label, or label/variant: (template, mandatory phrases). Notices in common use, cut to the words that tell them; a
#: label counts if any of its variants does.
TEMPLATES = {
    "agpl-3.0": ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license", ["gnu affero general public license"]),
    "apache-2.0": ("licensed under the apache license version 2 0", ["apache license version 2 0"]),
    "bsd-3-clause": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "names of its contributors may be used to endorse or promote products"]),
    "bsd-3-clause/author": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "name of the author may not be used to endorse or promote products"]),
    "cc-by-4.0": ("this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    "cc-by-nc-4.0/deed": ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial 4 0"]),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    "cc-by-sa-4.0/deed": ("this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike 4 0"]),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    "cc0-1.0": ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright"]),
    "gpl-2.0/header": ("gnu general public license as published by the free software foundation either version 2 of the license", ["gnu general public license as published by the free software foundation either version 2 of the license"]),
    "gpl-2.0/only": ("gnu general public license as published by the free software foundation version 2", ["gnu general public license as published by the free software foundation version 2"]),
    "gpl-2.0/named": ("under the terms of the gnu general public license version 2 as published by the free software foundation", ["gnu general public license version 2"]),
    "gpl-2.0/text": ("gnu general public license version 2 june 1991", ["gnu general public license version 2"]),
    "gpl-2.0": ("this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    "gpl-3.0/header": ("gnu general public license as published by the free software foundation either version 3 of the license", ["gnu general public license as published by the free software foundation either version 3 of the license"]),
    "gpl-3.0/only": ("gnu general public license as published by the free software foundation version 3", ["gnu general public license as published by the free software foundation version 3"]),
    "gpl-3.0/named": ("under the terms of the gnu general public license version 3 as published by the free software foundation", ["gnu general public license version 3"]),
    "gpl-3.0/text": ("gnu general public license version 3 29 june 2007", ["gnu general public license version 3"]),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["distribute this software for any purpose"]),
    "lgpl-3.0": ("this library is free software under the terms of the gnu lesser general public license version 3", ["gnu lesser general public license version 3"]),
    "lgpl-3.0/header": ("gnu lesser general public license as published by the free software foundation either version 3 of the license", ["gnu lesser general public license as published by the free software foundation either version 3 of the license"]),
    "lgpl-3.0/text": ("gnu lesser general public license version 3 29 june 2007", ["gnu lesser general public license version 3"]),
    "mit-notice": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    "mit-release": ("released under the mit license", ["mit license"]),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    "proprietary": ("all rights reserved no part of this work may be reproduced without prior written permission", ["all rights reserved"]),
    "unlicense": ("this is free and unencumbered software released into the public domain", ["released into the public domain"]),
}
TEMPLATES |= {
    "bsd-2-clause": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "redistributions in binary form must reproduce the above copyright notice"]),
    "lgpl-2.1": ("under the terms of the gnu lesser general public license version 2 1", ["gnu lesser general public license version 2 1"]),
    "lgpl-2.1/header": ("gnu lesser general public license as published by the free software foundation either version 2 1 of the license", ["gnu lesser general public license as published by the free software foundation either version 2 1 of the license"]),
    "lgpl-2.1/text": ("gnu lesser general public license version 2 1 february 1999", ["gnu lesser general public license version 2 1"]),
    "zlib": ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["in no event will the authors be held liable", "altered source versions must be plainly marked as such"]),
}
#: Identifiers of SPDX tags that give a label; "-only" and "-or-later" may follow.
SPDX = "AGPL-3.0 Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0 GPL-3.0 ISC LGPL-2.1 LGPL-3.0 MIT MPL-2.0 Unlicense Zlib".split()
TEMPLATES |= {f"{x.lower()}/spdx": (tag := "spdx license identifier " + " ".join(x.lower().replace(".", "-").split("-")), [tag]) for x in SPDX}
#: A label whose notice is part of another's does not count beside that one.
UNLESS = {"bsd-2-clause": ["bsd-3-clause"]}
#: Share of a template's words that must stand in place.
COVERAGE = 0.75


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for t, phrases in templates.values() for x in (t, *phrases) for w in x.split()} | {w for p in BASE for w in p.split()})


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_text(F.coalesce(text, F.lit(""))), LETTER_GAP), "")


def document_frequencies(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many texts each licence word occurs. One row per word of the vocabulary comes back."""
    held = F.array_distinct(F.filter(words_of(F.col("text")), lambda w: among(w, words)))
    return {r["w"]: r["n"] for r in docs.select(F.explode(held).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}


def _places(hits: str, word: str, offset: int) -> Column:
    """Places of a word, shifted back by its offset in the phrase."""
    return F.transform(F.filter(F.col(hits), lambda h: h["w"] == word), lambda h: h["i"] - offset)


def rarest_first(words: list[str], rarity: dict[str, float]) -> list[int]:
    return sorted(range(len(words)), key=lambda k: (-rarity[words[k]], k))


def phrase_starts(hits: str, anchors: str, phrase: str, rarity: dict[str, float]) -> Column:
    """Where the phrase's words stand in a row: shifted postings intersected, rarest word first."""
    words = phrase.split()
    order = rarest_first(words, rarity)
    starts = reduce(F.array_intersect, [_places(hits, words[k], k) for k in order])
    return F.when(F.array_contains(anchors, words[order[0]]), starts).otherwise(F.array().cast("array<int>"))


def template_votes(hits: str, template: str, rarity: dict[str, float]) -> tuple[Column, int]:
    """Most words of the template that agree on one start, and how many there are."""
    words = template.split()
    starts = F.sort_array(reduce(lambda x, y: F.concat(x, y), [_places(hits, words[k], k) for k in rarest_first(words, rarity)]))
    zero = F.struct(F.lit(None).cast("int").alias("at"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(s["at"] == x, s["run"] + 1).otherwise(1)
        return F.struct(x.cast("int").alias("at"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(starts, zero, step, lambda s: s["best"]), len(words)


def scan(docs: DataFrame, templates=TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document."""
    words = vocabulary(templates)
    seen = document_frequencies(docs, words)
    rarity = {w: -math.log1p(seen.get(w, 0)) for w in words}
    phrases = sorted({p for _, ps in templates.values() for p in ps} | set(BASE))
    rarest = sorted({p.split()[rarest_first(p.split(), rarity)[0]] for p in phrases})
    df = docs.select("doc_id", words_of(F.col("text")).alias("_words"))
    df = df.withColumn("_anchors", F.array_distinct(F.filter("_words", lambda w: among(w, rarest))))
    # the index of a text is only built if it has the rarest word of some phrase
    indexed = F.filter(F.transform("_words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: among(h["w"], words))
    df = df.select("doc_id", F.size("_words").cast("long").alias("n_words"), "_anchors", F.when(F.size("_anchors") > 0, indexed).otherwise(F.array().cast("array<struct<w:string,i:int>>")).alias("_hits"))
    df = df.withColumns({f"_p{k}": phrase_starts("_hits", "_anchors", p, rarity) for k, p in enumerate(phrases)})
    at = lambda p: F.col(f"_p{phrases.index(p)}")
    votes = {}
    for k, (label, (template, mandatory)) in enumerate(sorted(templates.items())):
        verified = reduce(lambda x, y: x & y, [F.size(at(p)) > 0 for p in mandatory])
        best, n = template_votes("_hits", template, rarity)
        # a template is only lined up where its phrases are
        votes[label] = F.when(verified, best / n).otherwise(0.0)
    df = df.withColumns({f"_t{k}": v for k, v in enumerate(votes.values())})
    stands = {label: F.col(f"_t{k}") for k, label in enumerate(votes)}
    base = F.flatten(F.array(*[at(p) for p in BASE]))
    base_labels = [F.when(F.size(at(p)) > 0, F.lit(label)) for p, label in BASE.items()]
    own = [F.when(c >= coverage, F.lit(label.split("/")[0])) for label, c in stands.items()]
    in_way = {label: [c for other, c in stands.items() if other.split("/")[0] in others] for label, others in UNLESS.items() if label in stands}
    for k, label in enumerate(stands):
        for c in in_way.get(label, ()):
            own[k] = F.when(c < coverage, own[k])
    joined = lambda cs: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*cs)))), ",")
    score = F.greatest(*[F.when(c >= coverage, c).otherwise(0.0) for c in stands.values()], F.when(F.size(base) > 0, F.lit(1.0)).otherwise(0.0))
    return df.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base).cast("long").alias("first_word"), F.array_max(base).cast("long").alias("last_word"), joined(base_labels).alias("base_labels"), joined(base_labels + own).alias("labels"), score.alias("score"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op1_license_scan": op1_license_scan}
SQL: dict[str, str] = {}
