"""License scans with a positional index of rare tokens, in DataFrame operations alone.

Each template is a run of words, a phrase or a sentence of a licence, with one mandatory
key phrase. A file's licence words are ranked by their inverse document frequency over the
corpus, and open the templates all of whose key words are among them; of each, its highest-ranked
key word is looked up in the templates' postings (word to template and
place). Two words that agree on where the template would start are an alignment, and an
alignment counts if the key phrase stands there word for word and, for a sentence, half of
its words stand in place. Everything but the counts is a projection of the row, so nothing
is shuffled.

Defined results: a null text counts as empty; texts without words, or without licence
words, have no labels and score 0; every place of a phrase counts, also in very long
texts; equal texts get equal answers; repeated rows stay; an empty table gives an empty
result. Other columns are kept, and one named like a result is replaced.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import with_struct

FIELDS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and labels that must be found wherever they stand.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Sentences of well-known licences with their key phrase and label.
SENTENCES = (
    ("redistribution and use in source and binary forms with or without modification are permitted", "use in source and binary forms", "bsd"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "source code must retain the above copyright notice", "bsd"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "binary form must reproduce the above copyright notice", "bsd"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included in all copies", "mit"),
    ("permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify", "isc"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version 2 0", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "terms of the gnu general public license as published", "gpl"),
    ("this source code form is subject to the terms of the mozilla public license", "mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "free and unencumbered software", "unlicense"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable", "zlib"),
    ("boost software license version 1 0", "boost software license", "boost"),
    ("everyone is permitted to copy and distribute verbatim or modified copies of this license document", "everyone is permitted to copy and distribute verbatim", "wtfpl"),
    ("gnu lesser general public license", "gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "gnu affero general public license", "agpl"),
    ("eclipse public license", "eclipse public license", "epl"),
    ("creative commons attribution", "creative commons attribution", "cc-by"),
    ("all rights reserved no part of this may be reproduced without permission", "all rights reserved no part", "proprietary"),
)
#: A sentence's label counts only if so much of the sentence stands in place; base phrases stand whole.
LEAST_SHARE = 0.5


@dataclass(frozen=True)
class Template:
    words: tuple[str, ...]
    key: tuple[str, ...]
    label: str
    base: bool

    @property
    def key_at(self) -> int:
        n = len(self.key)
        return next(i for i in range(len(self.words)) if self.words[i : i + n] == self.key)


def templates() -> list[Template]:
    base = [Template(tuple(p.split()), tuple(p.split()), label, True) for p, label in BASE.items()]
    return base + [Template(tuple(s.split()), tuple(k.split()), label, False) for s, k, label in SENTENCES]


def words(text: Column) -> Column:
    """Words in lower case. Lower-casing letters outside ASCII too is much faster than A to Z alone and changes no result: they are word characters before and after, and the one that becomes an ASCII letter (the Kelvin sign, k) is in no template."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def frequencies(docs: DataFrame, text: str = "text", known: list[Template] | None = None) -> dict[str, int]:
    """Document frequency of each template word; as many rows as the templates have words."""
    vocabulary = sorted({w for t in known or templates() for w in t.words})
    own = F.array_intersect(words(F.col(text)), F.array(*map(F.lit, vocabulary)))
    found = docs.select(F.explode(own).alias("w")).groupBy("w").agg(F.count("*").alias("df")).collect()
    return dict.fromkeys(vocabulary, 0) | {r.w: r.df for r in found}


def anchors(t: Template, df: dict[str, int]) -> list[int]:
    """Places of the key phrase's two words of highest inverse document frequency (one, if it has no other)."""
    at = t.key_at
    return sorted(sorted(range(at, at + len(t.key)), key=lambda i: (df.get(t.words[i], 0), i))[:2])


def scan(docs: DataFrame, df: dict[str, int], text: str = "text", known: list[Template] | None = None) -> DataFrame:
    """Append n_words, n_base, first_word, last_word, base_labels, labels and score (the share of the best template's words that stand in place)."""
    known = known or templates()
    lit = lambda xs: F.array(*map(F.lit, xs))
    vocabulary = sorted({w for t in known for w in t.words}, key=lambda w: (df.get(w, 0), w))
    mark = uuid.uuid4().hex[:8]
    w_, places_, found_, open_ = (f"_{n}_{mark}" for n in ("w", "places", "found", "open"))
    table = F.array(*[F.struct(lit(t.words).alias("words"), lit(t.key).alias("key"), F.lit(t.key_at).alias("key_at"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base")) for t in known])
    postings = []
    for i, t in enumerate(known):
        a = anchors(t, df)
        postings.append(F.struct(F.lit(i).alias("t"), F.lit(t.words[a[0]]).alias("lead"), F.lit(a[0]).alias("rel"), F.lit(a[-1] - a[0]).alias("gap"), F.lit(t.words[a[-1]]).alias("mate"), lit(sorted(set(t.key))).alias("key")))
    kept = [c for c in docs.columns if c not in FIELDS]
    got = docs.select(*[docs[f"`{c}`"] for c in kept], words(F.col(text)).alias(w_))
    w = F.col(w_)
    # the file's licence words, those of highest inverse document frequency first; a template is open to it only if they hold all its key words
    ranked = F.array_intersect(lit(vocabulary), w)
    got = got.withColumn(open_, F.transform(F.array(ranked), lambda own: F.filter(F.array(*postings), lambda p: F.size(F.array_except(p["key"], own)) == 0))[0])
    opened = F.col(open_)
    lead = F.transform(opened, lambda p: p["lead"])
    indexed = F.when(F.size(opened) > 0, F.filter(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda s: F.array_contains(lead, s["w"])))
    got = got.withColumn(places_, F.coalesce(indexed, F.array().cast("array<struct<w: string, i: int>>")))
    at = lambda i: F.get(w, i)
    aligned = F.flatten(
        F.transform(places_, lambda s: F.transform(F.filter(opened, lambda p: (p["lead"] == s["w"]) & (at(s["i"] + p["gap"]) == p["mate"])), lambda p: F.struct(p["t"].alias("t"), (s["i"] - p["rel"]).alias("start"))))
    )

    def stands(c: Column) -> Column:
        t = F.element_at(table, c["t"] + 1)
        begin = c["start"] + t["key_at"]
        return (begin >= 0) & (F.slice(w, F.greatest(begin, F.lit(0)) + 1, F.size(t["key"])) == t["key"])

    def share(c: Column) -> Column:
        t = F.element_at(table, c["t"] + 1)
        hit = F.transform(t["words"], lambda x, i: F.when((c["start"] + i >= 0) & (F.get(w, c["start"] + i) == x), 1.0).otherwise(0.0))
        return F.aggregate(hit, F.lit(0.0), lambda s, x: s + x) / F.size(t["words"])

    whole = F.transform(F.array_distinct(F.filter(aligned, stands)), lambda c: F.struct(c["t"].alias("t"), c["start"].alias("start"), share(c).alias("share")))
    enough = F.filter(whole, lambda c: (c["share"] >= LEAST_SHARE) | F.element_at(table, c["t"] + 1)["base"])
    none = F.array().cast("array<struct<t: int, start: int, share: double>>")
    got = got.withColumn(found_, F.coalesce(F.when(F.size(places_) > 0, enough), none))
    base = F.filter(found_, lambda c: F.element_at(table, c["t"] + 1)["base"])
    starts = F.transform(base, lambda c: c["start"])
    names = lambda cs: F.array_join(F.array_sort(F.array_distinct(F.transform(cs, lambda c: F.element_at(table, c["t"] + 1)["label"]))), ",")
    value = F.struct(
        F.size(w).cast("bigint").alias("n_words"),
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"),
        F.array_max(starts).cast("bigint").alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col(found_)).alias("labels"),
        F.coalesce(F.array_max(F.transform(found_, lambda c: c["share"])), F.lit(0.0)).alias("score"),
    )
    return with_struct(got, "licence", value, FIELDS).drop(w_, places_, found_, open_)
