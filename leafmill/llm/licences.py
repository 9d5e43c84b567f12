"""Licence scan by a positional rare-token index, with DataFrame functions only.

The index tells for each of the rarest words of the mandatory phrases of licence templates where it stands in which template. A text's
words are looked up in it; a place at which a template would begin is a candidate if the postings of its two rarest words meet there, and
it counts if all its mandatory phrases stand at it. So only texts with such a word, and in them only such places, are looked at closely,
and none is missed. A row needs no other row: nothing is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

APART = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Phrases that are labels wherever their words stand one after the other.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Fixed values: (label, words of a licence's text or notice, mandatory phrases).
TEMPLATES = [
    ("agpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("under the apache license", "in compliance with the license")),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("required by applicable law or agreed to in writing",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use",)),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("must retain the above copyright notice",)),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("to endorse or promote products derived from this software",)),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("any person or organization obtaining",)),
    ("cc-by", "this work is licensed under cc by 4 0", ("cc by",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license", ("eclipse public license",)),
    ("gpl", "this work is licensed under the gnu general public license", ("general public license",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license", "version 3")),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("under the terms of the gnu general public license", "version 3 of the license")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", ("lesser general public license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted free of charge to any person obtaining", "to deal in the software without restriction")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("mozilla public license",)),
    ("proprietary", "copyright all rights reserved", ("all rights reserved",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("will the authors be held liable",)),
]
#: A vote for a template's place is one number: the template's, times STEP, plus the place, plus EARLY (a place may be before the text).
STEP, EARLY = 1 << 40, 1 << 10
OWN = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def idf() -> dict[str, float]:
    sets = [set(t.split()) for _, t, _ in TEMPLATES]
    return {w: round(math.log(len(sets) / sum(w in s for s in sets)) + 1, 6) for w in set().union(*sets)}


def mandatory(template: int) -> list[tuple[str, int]]:
    """Words of the mandatory phrases with their place in the template."""
    _, words, phrases = TEMPLATES[template]
    words, out = words.split(), set()
    for p in phrases:
        p = p.split()
        at = next(i for i in range(len(words)) if words[i : i + len(p)] == p)
        out |= {(w, at + k) for k, w in enumerate(p)}
    return sorted(out, key=lambda x: x[1])


def entries() -> list[tuple[str, list[tuple[str, int]], list[tuple[str, int]]]]:
    """(label, words with their places, mandatory ones) of the templates, and then of the base phrases, which are mandatory as a whole."""
    found = [(label, [*((w, j) for j, w in enumerate(words.split()))], mandatory(n)) for n, (label, words, _) in enumerate(TEMPLATES)]
    return found + [(label, own := [(w, j) for j, w in enumerate(p.split())], own) for p, label in BASE.items()]


def rarest(must: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The two highest-IDF words of mandatory phrases, with their places; of equals the longer ones."""
    weight = idf()
    return sorted(must, key=lambda x: (-weight.get(x[0], 9.0), -len(x[0]), x[1]))[:2]


def _literal(rows: list[tuple[str, int]]) -> Column:
    return F.array(*(F.struct(F.lit(w).alias("w"), F.lit(j).alias("j")) for w, j in rows))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score, which take the place of columns of these names.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. ``score`` is the share of a template's words that
    stand in their places, of the best verified one; 0.5 if there is none but a base phrase; else 0. Null texts are empty, texts of any length are
    read whole. Rows come out as they went in, repeated ones too; empty tables give none.
    """
    known = entries()
    posts: list[dict[str, list[tuple[int, int]]]] = [{}, {}]  # of the rarest words, and of the second: where in which template
    for t, (_, _, must) in enumerate(known):
        for which, (w, j) in zip(posts, rarest(must), strict=True):
            which.setdefault(w, []).append((t, j))
    body = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = F.split(body, APART)
    split_, words_, votes_, found_ = (next(n for k in range(99) if (n := "_" * k + c) not in docs.columns) for c in ("_split", "_words", "_votes", "_found"))
    out = docs.withColumn(split_, split)
    # text between two marks is empty only at either end
    n_words = F.size(split_) - F.when(F.get(split_, F.lit(0)) == "", 1).otherwise(0) - F.when((F.size(split_) > 1) & (F.get(split_, F.size(split_) - 1) == ""), 1).otherwise(0)
    asked = F.arrays_overlap(F.col(split_), F.lit(sorted(posts[0]))) & F.arrays_overlap(F.col(split_), F.lit(sorted(posts[1])))
    out = out.withColumn("n_words", n_words.cast("long")).withColumn(words_, F.when(asked, F.filter(split_, lambda w: w != "")).otherwise(F.array().cast("array<string>")))
    out = out.withColumn(votes_, F.array_intersect(*(_votes(F.col(words_), p) for p in posts)))

    w = F.col(words_)
    must, whole = (F.array(*(_literal(e[n]) for e in known)) for n in (2, 1))

    def stand(rows: Column, at: Column) -> Column:
        """Those of the words of a template that stand in their places."""
        return F.filter(rows, lambda m: F.coalesce(F.get(w, (at + m["j"]).cast("int")) == m["w"], F.lit(False)))

    def place(v: Column) -> Column:
        return v % STEP - EARLY

    def checked(v: Column) -> Column:
        t = F.floor(v / STEP).cast("int")
        own, all_ = F.get(must, t), F.get(whole, t)
        return F.struct(t.alias("t"), place(v).alias("at"), (F.size(stand(own, place(v))) == F.size(own)).alias("holds"), (F.size(stand(all_, place(v))) / F.size(all_)).alias("share"))

    out = out.withColumn(found_, F.filter(F.transform(votes_, checked), lambda x: x["holds"]))
    templates, phrases = (F.filter(found_, f) for f in (lambda x: x["t"] < len(TEMPLATES), lambda x: x["t"] >= len(TEMPLATES)))
    names = F.lit([e[0] for e in known])
    places, base_labels = F.transform(phrases, lambda x: x["at"]), F.transform(phrases, lambda x: F.get(names, x["t"]))
    n_base = F.size(phrases).cast("long")
    best = F.coalesce(F.array_max(F.transform(templates, lambda x: x["share"])), F.lit(0.0))
    return out.select(
        *(c for c in docs.columns if c not in OWN),
        "n_words",
        n_base.alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(found_, lambda x: F.get(names, x["t"])))), ",").alias("labels"),
        F.round(F.greatest(best, F.when(n_base > 0, F.lit(0.5)).otherwise(0.0)), 6).alias("score"),
    )


def _votes(words: Column, posts: dict[str, list[tuple[int, int]]]) -> Column:
    """For each place of an indexed word, where the templates that have it would begin, as numbers."""
    index = F.create_map(*(x for word, rows in sorted(posts.items()) for x in (F.lit(word), F.lit([t * STEP + EARLY - j for t, j in rows]).cast("array<bigint>"))))
    listed = F.filter(F.transform(words, lambda w, i: F.struct(F.try_element_at(index, w).alias("p"), i.alias("i"))), lambda x: x["p"].isNotNull())
    return F.flatten(F.transform(listed, lambda x: F.transform(x["p"], lambda p: p + x["i"])))
