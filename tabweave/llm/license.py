"""License scan: base phrases, and a positional index of the rare words of licence templates.

Document frequencies of all template words are counted over the whole corpus; each template is indexed
by its rarest words, and the two rarest of its key phrase, with their positions. All indexed words of a document
are looked up (the index is a constant of the code); a posting gives an alignment (template, start). Only alignments on which
the postings of two words or more agree stay, and are verified word by word: one counts if at least half of the
template's words stand in place and all of its mandatory key phrase does. As the key phrase's two rarest words are
indexed, no such alignment is missed.

Defined cases: a null or empty text has no words: counts 0, positions null, labels empty, score 0.
Repeated rows are judged alike. Texts of any length are scanned whole. With an empty corpus all words
are equally rare and the result is empty. Ties in rarity go by the word. An input column named like an output is replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PLAIN_GAP, let, plain_words

# The base phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Well-known licence notices and paragraphs of licence texts: label, words, mandatory key phrase.
TEMPLATES = (
    ("agpl-3.0", "under the terms of the GNU Affero General Public License version 3", "gnu affero general public license"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache license version 2 0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", "redistribution and use in source and binary forms"),
    ("cc-by-4.0", "Licensed under CC BY 4.0", "cc by 4 0"),
    ("cc-by-4.0", "Licensed under the Creative Commons Attribution 4.0 International License", "creative commons attribution 4 0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", "cc by sa 4 0"),
    ("cc0-1.0", "Dedicated to the public domain under CC0 1.0 Universal", "cc0 1 0"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", "gnu general public license version 2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", "gnu general public license version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute"),
    ("lgpl", "under the terms of the GNU Lesser General Public License", "gnu lesser general public license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("mit", "Released under the MIT License", "mit license"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "free and unencumbered software"),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "apache org licenses license 2 0",
    ),
    (
        "gpl-2.0",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
        "either version 2 of the license",
    ),
    (
        "gpl-3.0",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "either version 3 of the license",
    ),
    (
        "mit",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "use copy modify merge publish distribute sublicense and or sell copies",
    ),
    (
        "bsd",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "redistributions of source code must retain the above copyright notice",
    ),
    (
        "zlib",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
        "including commercial applications and to alter it and redistribute it freely",
    ),
)

#: Indexed words of a template, besides the rarest of its key phrase: a verified alignment holds all of these.
RARE_WORDS, KEY_WORDS = 4, 2
#: Share of a template's words that must stand in place.
SHARE = 0.5


def _words(text: str) -> list[str]:
    return [w for w in re.split(PLAIN_GAP, text.lower()) if w]


def _key_start(words: list[str], key: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


def document_frequencies(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, int]:
    """How many documents hold each word; one number for each word of the (fixed) vocabulary."""
    words = F.array(*[F.lit(w) for w in vocabulary])
    rows = docs.select(F.explode(F.array_intersect(words, plain_words(F.col(text)))).alias("w")).groupBy("w").count().collect()
    return {w: 0 for w in vocabulary} | {r["w"]: r["count"] for r in rows}


def base_hits(words: Column) -> Column:
    """Array of (p: first word's place, label) for every place of a base phrase."""
    kinds = None
    for phrase, label in BASE:
        first, *rest = phrase.split()

        def found(w, i, first=first, rest=rest):
            cond = F.get(w, i) == first
            for k, x in enumerate(rest, 1):
                cond = cond & (F.get(w, i + k) == x)
            return cond

        kinds = [*(kinds or []), (found, label)]

    def hits(w: Column) -> Column:
        def label_at(i: Column) -> Column:
            out = None
            for found, label in kinds:
                out = F.when(found(w, i), F.lit(label)) if out is None else out.when(found(w, i), F.lit(label))
            return out

        return F.filter(F.transform(w, lambda _, i: F.struct(i.alias("p"), label_at(i).alias("label"))), lambda x: x["label"].isNotNull())

    firsts = F.array(*[F.lit(p.split()[0]) for p, _ in BASE])
    none = F.array().cast("array<struct<p:int,label:string>>")
    return F.when(F.arrays_overlap(firsts, words), let(words, hits)).otherwise(none)


def template_hits(words: Column, frequencies: dict[str, int]) -> Column:
    """Array of (label, share) for every verified alignment of a template."""
    parsed = [(label, _words(notice), _words(key)) for label, notice, key in TEMPLATES]
    rarest = lambda ws, n: sorted(set(ws), key=lambda w: (frequencies[w], w))[:n]
    index = [(w, t, p) for t, (_, ws, key) in enumerate(parsed) for w in sorted({*rarest(ws, RARE_WORDS), *rarest(key, KEY_WORDS)}) for p in (i for i, x in enumerate(ws) if x == w)]
    rare_lit = F.array(*[F.lit(w) for w in sorted({w for w, _, _ in index})])
    index_lit = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(t).alias("t"), F.lit(p).alias("p")) for w, t, p in index])
    templates = F.array(
        *[
            F.struct(F.lit(label).alias("label"), F.array(*[F.lit(x) for x in ws]).alias("words"), F.lit(_key_start(ws, key)).alias("key_at"), F.lit(len(key)).alias("key_len"))
            for label, ws, key in parsed
        ]
    )

    def verified(w: Column, a: Column) -> Column:
        def judged(t: Column) -> Column:
            same = F.transform(t["words"], lambda x, j: F.coalesce(F.get(w, a["at"] + j) == x, F.lit(False)))
            return let(
                same,
                lambda s: F.struct(
                    t["label"].alias("label"),
                    (F.size(F.filter(s, lambda x: x)) / F.size(s)).alias("share"),
                    F.forall(F.slice(s, t["key_at"] + 1, t["key_len"]), lambda x: x).alias("key"),
                ),
            )

        return let(F.get(templates, a["t"]), judged)

    def aligned(w: Column, looked: Column) -> Column:
        posts = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda x: F.array_contains(looked, x["w"]))
        starts = F.flatten(
            F.transform(posts, lambda x: F.transform(F.filter(index_lit, lambda e: e["w"] == x["w"]), lambda e: F.struct(e["t"].alias("t"), (x["i"] - e["p"]).alias("at"))))
        )
        # sorted, the postings of one alignment are neighbours: the second of them stands for all
        agreed = let(
            F.array_sort(starts),
            lambda s: F.filter(s, lambda a, i: a.eqNullSafe(F.get(s, i - 1)) & ~a.eqNullSafe(F.get(s, i - 2))),
        )
        return F.filter(F.transform(agreed, lambda a: verified(w, a)), lambda x: x["key"] & (x["share"] >= SHARE))

    none = F.array().cast("array<struct<label:string,share:double,key:boolean>>")
    return let(
        words,
        lambda w: let(
            F.array_intersect(rare_lit, w),
            lambda looked: F.when(F.size(looked) > 0, aligned(w, looked)).otherwise(none),
        ),
    )


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, base (places), found (templates), and the labels and score from both."""
    vocabulary = sorted({w for _, notice, _ in TEMPLATES for w in _words(notice)})
    frequencies = document_frequencies(docs, vocabulary, text)
    out = docs.withColumn("__w", plain_words(F.col(text)))
    out = out.withColumns({"n_words": F.size("__w").cast("long"), "base": base_hits(F.col("__w")), "found": template_hits(F.col("__w"), frequencies)}).drop("__w")
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"])))
    labels = F.array_sort(F.array_union(F.transform("base", lambda x: x["label"]), F.transform("found", lambda x: x["label"])))
    best = F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0))
    return out.withColumns(
        {
            "n_base": F.size("base").cast("long"),
            "first_word": F.array_min(F.transform("base", lambda x: x["p"])).cast("long"),
            "last_word": F.array_max(F.transform("base", lambda x: x["p"])).cast("long"),
            "base_labels": F.array_join(base_labels, ","),
            "labels": F.array_join(labels, ","),
            # a base phrase outside any verified notice is weaker evidence
            "score": F.greatest(best, F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0))),
        }
    )
