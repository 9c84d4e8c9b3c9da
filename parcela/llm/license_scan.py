"""License scans: exact set-similarity join of text blocks with license templates.

A block matches a template where it contains at least its share of the template's distinct words.
Words stand in one global order, rarest in the corpus first. A template of m words that needs o of
them must share a word of its first m - o + 1 (prefix filter) with the block; the block needs o words
of the template vocabulary (length filter); the words that can still follow the first shared one must
be enough (positional filter); then the overlap is counted. DataFrame expressions only. A block is
joined by its prefix words with a table of the templates' prefix words, whose size is fixed by the
templates; documents themselves are never shuffled.

Blocks follow from the templates. A notice of up to n words (with slack) is looked for in blocks twice
as long, at every n-th word, where n is a power of two, so each passage lies in some block as a whole.
A short statement must stand in a block of its own length, at any word, with all its words.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

# The phrases of the base rule with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# What public licenses have their users say, lower-cased words only.
STATEMENTS = {
    "agpl-3.0": ("this program is licensed under the gnu affero general public license version 3",),
    "apache-2.0": ("licensed under the apache license version 2 0",),
    "cc-by-4.0": ("this work is licensed under a creative commons attribution 4 0 international license",),
    "cc-by-nc-4.0": ("creative commons attribution noncommercial 4 0 international", "licensed under cc by nc 4 0"),
    "cc-by-nc-sa-4.0": ("creative commons attribution noncommercial sharealike 4 0 international", "licensed under cc by nc sa 4 0"),
    "cc-by-nd-4.0": ("creative commons attribution noderivatives 4 0 international", "licensed under cc by nd 4 0"),
    "cc-by-sa-4.0": ("creative commons attribution sharealike 4 0 international", "licensed under cc by sa 4 0"),
    "cc0-1.0": ("has waived all copyright and related or neighboring rights to this work", "cc0 1 0 universal"),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3",),
    "mit": ("released under the mit license", "licensed under the mit license"),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
}
# Licenses whose tag in a source file is looked for.
TAGGED = ("agpl-3.0", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "cc-by-4.0", "cc-by-sa-4.0", "cc0-1.0", "gpl-3.0", "isc", "lgpl-3.0", "mit", "mpl-2.0", "unlicense", "zlib")
# The notices of public licenses, lower-cased words only.
NOTICES = {
    "agpl-3.0": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-3-clause": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl-3.0": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl-3.0": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
}
# Words that a notice's block must have, and words of its relatives that it must not have.
REQUIRED = {"agpl-3.0": ["affero"], "apache-2.0": ["apache"], "gpl-3.0": ["gnu"], "lgpl-3.0": ["lesser"], "mpl-2.0": ["mozilla"]}
EXCLUDED = {"gpl-3.0": ["affero", "lesser"]}
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spdx_tags(labels: tuple[str, ...] = TAGGED) -> dict[str, str]:
    """The words of ``SPDX-License-Identifier: <label>``."""
    return {x: "spdx license identifier " + re.sub("[-.]", " ", x) for x in labels}


def _statements() -> dict[str, tuple[str, ...]]:
    tags = spdx_tags()
    return {x: (*STATEMENTS.get(x, ()), *([tags[x]] if x in tags else [])) for x in sorted({*STATEMENTS, *tags})}


@dataclass(frozen=True)
class LicenseConfig:
    """``threshold``: the share of a notice's distinct words that a block needs; ``slack``: words between a notice's own, as a share of them.

    A label has any number of statements and of notices. ``required`` and ``excluded``: words that a block of a label's notice must and must not have.
    """

    threshold: float = 0.85
    slack: float = 0.25
    statements: dict[str, tuple[str, ...]] = field(default_factory=_statements)
    notices: dict[str, tuple[str, ...]] = field(default_factory=lambda: {x: (t,) for x, t in NOTICES.items()})
    required: dict[str, list[str]] = field(default_factory=lambda: dict(REQUIRED))
    excluded: dict[str, list[str]] = field(default_factory=lambda: dict(EXCLUDED))


def read_templates(table: DataFrame, threshold: float = 0.85, slack: float = 0.25, most_words: int = 500_000) -> LicenseConfig:
    """A configuration from a table of ``label, kind ('statement' or 'notice'), text``, in place of the given one.

    Texts are whole license texts as published; words are cut as in documents. An optional column
    ``required`` and one ``excluded`` (arrays of words) tell relatives apart. Rows with a null label
    or without a word are left out. Templates are broadcast, so a table of more than ``most_words``
    words is an error.
    """
    extra = [c for c in ("required", "excluded") if c in table.columns]
    rows = table.where(F.col("label").isNotNull()).select("label", "kind", _words(F.col("text")).alias("words"), *extra).where(F.size("words") > 0)
    total = rows.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("n")).first()["n"]
    if total > most_words:
        raise ValueError(f"templates have {total} words, more than {most_words}")
    made: dict[str, dict] = {k: {} for k in ("statement", "notice", "required", "excluded")}
    for r in sorted(rows.collect(), key=lambda r: (r["label"], r["words"])):
        made[r["kind"]][r["label"]] = (*made[r["kind"]].get(r["label"], ()), " ".join(r["words"]))
        for k in extra:
            made[k][r["label"]] = sorted({*made[k].get(r["label"], ()), *(r[k] or ())})
    return LicenseConfig(threshold, slack, made["statement"], made["notice"], made["required"], made["excluded"])


@dataclass(frozen=True)
class Template:
    """``block`` words from every ``step``-th word on are compared."""

    label: str
    words: tuple[str, ...]
    need: int
    block: int
    step: int
    required: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()


def templates(config: LicenseConfig) -> list[Template]:
    out = []
    for label, text in sorted((x, t) for x, many in config.statements.items() for t in many):
        words = tuple(sorted(set(text.split())))
        out.append(Template(label, words, len(words), len(text.split()), 1))
    for label, text in sorted((x, t) for x, many in config.notices.items() for t in many):
        words = tuple(sorted(set(text.split())))
        step = 1 << math.ceil(math.log2(len(text.split()) * (1 + config.slack)))
        out.append(Template(label, words, math.ceil(round(config.threshold * len(words), 9)), 2 * step, step, tuple(config.required.get(label, ())), tuple(config.excluded.get(label, ()))))
    return out


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), "")


def _vocabulary_order(docs: DataFrame, text_col: str, vocabulary: list[str]) -> list[str]:
    """The template words by their number of occurrences in all documents, the rarest first; ties by spelling. As many rows as template words."""
    listed = F.filter(_words(F.col(text_col)), lambda w: w.isin(*vocabulary))
    counted = docs.select(F.explode(listed).alias("__w")).groupBy("__w").count().collect()
    count = {r["__w"]: r["count"] for r in counted}
    return sorted(vocabulary, key=lambda w: (count.get(w, 0), w))


def _prefix_rows(order: list[str], known: list[Template]) -> list[tuple]:
    """(word, block, number and label of the template, place in it, words, needed words, its words in global order, required and excluded ones) of every prefix word."""
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for number, t in enumerate(known):
        words = sorted(t.words, key=rank.__getitem__)
        rows += [(words[i], t.block, number, t.label, i, len(words), t.need, words, list(t.required), list(t.excluded)) for i in range(len(words) - t.need + 1)]
    return rows


def _base(text: Column) -> dict[str, Column]:
    """Columns of the base rule over an array of words in ``__words`` and its padded text in ``__norm``."""
    norm, n = F.col("__norm"), F.size("__words").cast("long")

    def spaces(t: Column) -> Column:
        return (F.char_length(t) - F.char_length(F.replace(t, F.lit(" ")))).cast("long")

    def count(phrase: str) -> Column:
        return F.when(F.contains(norm, F.lit(f" {phrase} ")), F.regexp_count(norm, F.lit(f" {phrase}(?= )"))).otherwise(F.lit(0)).cast("long")

    def first(phrase: str) -> Column:
        return F.when(F.contains(norm, F.lit(f" {phrase} ")), spaces(F.substring_index(norm, f" {phrase} ", 1)))

    def last(phrase: str) -> Column:
        tail = F.reverse(F.substring_index(F.reverse(norm), f" {phrase} "[::-1], 1))
        return F.when(F.contains(norm, F.lit(f" {phrase} ")), n - spaces(tail) - len(phrase.split()))

    found = F.array(*[F.when(F.contains(norm, F.lit(f" {p} ")), F.lit(label)) for p, label in PHRASES.items()])
    return {
        "n_words": n,
        "n_base": sum((count(p) for p in list(PHRASES)[1:]), count(next(iter(PHRASES)))),
        "first_word": F.least(*map(first, PHRASES)),
        "last_word": F.greatest(*map(last, PHRASES)),
        "__base": F.array_sort(F.array_distinct(F.array_compact(found))),
    }


def scan_licenses(docs: DataFrame, config: LicenseConfig = LicenseConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks`` of each row of ``docs``.

    ``labels`` joins the base labels and those of the templates that some block contains;
    ``n_blocks`` counts pairs of block and template; ``score`` is 1 with a base phrase, else the
    largest containment of a match, else 0. A null or empty text has no words and no labels.
    Rows are scanned one by one: null and repeated ids are kept. Empty in, empty out. Other
    columns of ``docs`` are ignored.
    """
    spark: SparkSession = docs.sparkSession
    known = templates(config)
    vocabulary = sorted({w for t in known for w in (*t.words, *t.required, *t.excluded)})
    order = _vocabulary_order(docs, text_col, vocabulary)
    rows = _prefix_rows(order, known)
    index = F.broadcast(spark.createDataFrame(rows, "w string, c int, t int, label string, i int, m int, need int, words array<string>, required array<string>, excluded array<string>").alias("t"))
    constant = lambda x: F.from_json(F.lit(json.dumps(sorted(x))), "array<string>")  # noqa: E731  one folded literal
    prefix = constant({r[0] for r in rows})
    ordered = F.from_json(F.lit(json.dumps(order)), "array<string>")

    def blocks_of(words: Column, block: int, step: int) -> Column:
        """Blocks of one length that have a prefix word of a template of that length."""
        own = constant({r[0] for r in rows if r[1] == block})
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - (block if step == 1 else 1), F.lit(0)), F.lit(step))
        cut = F.transform(starts, lambda s: F.struct(F.lit(block).alias("c"), F.slice(words, s + 1, F.lit(block)).alias("b")))
        return F.when(F.arrays_overlap(words, own), F.filter(cut, lambda x: F.arrays_overlap(x["b"], own))).otherwise(empty)

    def blocks(words: Column) -> Column:
        return F.concat(empty, *[blocks_of(words, *x) for x in sorted({(t.block, t.step) for t in known})])

    empty = F.array().cast("array<struct<c:int,b:array<string>>>")
    words = docs.select(F.col(id_col), _words(F.col(text_col)).alias("__words"), F.monotonically_increasing_id().alias("__row"))
    norm = words.withColumn("__norm", F.concat(F.lit(" "), F.array_join("__words", " "), F.lit(" ")))
    hits = let(F.col("__words"), lambda w: F.when(F.arrays_overlap(w, prefix), blocks(w)).otherwise(empty))
    based = norm.select(id_col, "__row", *[c.alias(k) for k, c in _base(F.col("__norm")).items()], hits.alias("__blocks"))
    digest = [id_col, "__row", "n_words", "n_base", "first_word", "last_word", "__base"]
    block = based.select(*digest, F.posexplode_outer("__blocks").alias("__b", "__block"))
    block = block.select(*digest, "__b", F.col("__block.c").alias("__c"), F.array_intersect(ordered, F.col("__block.b")).alias("__known"))
    probe = block.select(*digest, "__b", "__c", "__known", F.explode_outer(F.array_intersect(F.col("__known"), prefix)).alias("__w"))
    pair = probe.join(index, (F.col("__w") == F.col("t.w")) & (F.col("__c") == F.col("t.c")), "left")
    place = F.array_position(F.col("__known"), F.col("__w")) - 1
    first = ~F.arrays_overlap(F.slice(F.col("t.words"), F.lit(1), F.col("t.i")), F.col("__known"))  # each pair once, by its first shared word
    length = F.size("__known") >= F.col("t.need")
    position = F.least(F.col("t.m") - F.col("t.i"), F.size("__known") - place) >= F.col("t.need")
    shared = F.size(F.array_intersect(F.col("t.words"), F.col("__known")))
    own = (F.size(F.array_except(F.col("t.required"), F.col("__known"))) == 0) & (F.size(F.array_intersect(F.col("t.excluded"), F.col("__known"))) == 0)
    overlap = F.when(F.col("t.label").isNotNull() & length & position & first & own, shared)
    match = pair.select(*digest, F.when(overlap >= F.col("t.need"), F.struct(F.col("t.label").alias("label"), (overlap / F.col("t.m")).alias("share"))).alias("__m"))
    total = match.groupBy(*digest).agg(F.collect_set("__m.label").alias("__labels"), F.max("__m.share").alias("__share"), F.count("__m").alias("n_blocks"))
    return total.select(
        id_col, "n_words", "n_base", "first_word", "last_word", F.array_join("__base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("__base", "__labels")), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.round("__share", 6), F.lit(0.0))).alias("score"), F.col("n_blocks").cast("long").alias("n_blocks"),
    )
