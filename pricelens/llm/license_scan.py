"""License scans with a positional rare-token index, in DataFrame functions only.

Templates are licence phrases, notices and whole texts. The index holds the postings (template, place) of each template's
rarest words, by inverse document frequency over the templates, as a literal map; the plan is the same however many
templates there are. A file's words are looked up in the index, which finds its highest-IDF licence words; each posting of
each occurrence fixes an alignment, a template and the word of the file at the template's place 0. Alignments are sorted,
and equal neighbours counted: those stay at which enough of the template's rare words stand at their relative places
(all of a phrase's, NEED of a longer template's). Of these the mandatory key phrases are verified word by word at their
places, and the share of the template's IDF weight that stands at its place is measured.

Rows are handled on their own: no shuffle, no join, no state that grows with the table. The cost of a row is in proportion
to its words and its alignments.

Defined results: null text counts as empty; a text without words has no places, empty labels and score 0; repeated rows
and null ids give one row each; columns of df named like an output are replaced, all others pass by.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, documents

#: A word: a run of ASCII digits and letters and of characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rare words of a template that are indexed, and the share of them that must agree on an alignment of a longer template.
RARE, NEED = 8, 0.5


@dataclass(frozen=True)
class Template:
    """words: the licence words in order; phrases: the mandatory key phrases among them (none: all words); least: share of
    the IDF weight that must stand at its place; base: counted as a base place."""

    label: str
    words: str
    phrases: tuple[str, ...] = ()
    least: float = 1.0
    base: bool = False


BASE = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
)
#: Phrases that name a licence.
NAMES = (
    Template("gpl-3", "gnu general public license version 3"),
    Template("gpl-2", "gnu general public license version 2"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("apache-2.0", "apache license version 2 0"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc0", "creative commons cc0"),
    Template("mpl", "mozilla public license"),
    Template("epl", "eclipse public license"),
    Template("bsl-1.0", "boost software license"),
    Template("isc", "isc license"),
    Template("bsd", "bsd license"),
    Template("all-rights-reserved", "all rights reserved"),
)
#: Notices and texts of licences, which may differ from these outside their key phrases.
TEXTS = (
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        ("free of charge to any person obtaining a copy", "deal in the software without restriction"),
        0.6,
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ("for any purpose with or without fee is hereby granted",),
        0.6,
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        ("use in source and binary forms with or without modification",),
        0.5,
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        ("will the authors be held liable for any damages arising from the use of this software", "to alter it and redistribute it freely"),
        0.6,
    ),
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        ("under the apache license version 2 0", "except in compliance with the license"),
        0.6,
    ),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version",
        ("redistribute it and or modify it under the terms of the gnu general public license",),
        0.6,
    ),
    Template(
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version",
        ("under the terms of the gnu lesser general public license",),
        0.6,
    ),
    Template(
        "agpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version",
        ("under the terms of the gnu affero general public license",),
        0.6,
    ),
    Template(
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        ("subject to the terms of the mozilla public license",),
        0.6,
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ("unencumbered software released into the public domain",),
        0.5,
    ),
    Template("unlicense", "unencumbered software released into the public domain", ("unencumbered software released",), 0.7),
    Template("bsd", "redistribution and use in source and binary forms with or without modification", ("use in source and binary",), 0.7),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("free of charge to any person obtaining a copy",), 0.7),
    Template(
        "bsl-1.0",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software",
        ("to any person or organization obtaining a copy of the software and accompanying documentation",),
        0.6,
    ),
    Template(
        "cc0",
        "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide this software is distributed without any warranty",
        ("copyright and related and neighboring rights", "to the public domain worldwide"),
        0.6,
    ),
)
TEMPLATES = BASE + NAMES + TEXTS


@dataclass(frozen=True)
class Entry:
    """A template in the index. idf: thousandths; rare: places of its indexed words; need: how many of them must agree;
    phrases: places and words of its key phrases."""

    template: Template
    words: tuple[str, ...]
    idf: tuple[int, ...]
    rare: tuple[int, ...]
    need: int
    phrases: tuple[tuple[int, tuple[str, ...]], ...]


def index(templates: tuple[Template, ...] = TEMPLATES) -> list[Entry]:
    """Words, IDF, rarest places and phrases of the templates; of equally rare words the first are indexed."""
    split = [tuple(t.words.split()) for t in templates]
    df = Counter(w for words in split for w in set(words))
    out = []
    for t, words in zip(templates, split, strict=True):
        idf = tuple(round(1000 * math.log((1 + len(split)) / df[w])) for w in words)
        rare = tuple(sorted(sorted(range(len(words)), key=lambda k: (-idf[k], k))[:RARE]))
        phrases = []
        for phrase in t.phrases or (t.words,):
            p = tuple(phrase.split())
            at = next((k for k in range(len(words)) if words[k : k + len(p)] == p), None)
            if at is None:
                raise ValueError(f"{phrase!r} is no phrase of its template")
            phrases.append((at, p))
        out.append(Entry(t, words, idf, rare, len(rare) if t.least == 1 else math.ceil(NEED * len(rare)), tuple(phrases)))
    return out


def postings(entries: list[Entry]) -> dict[str, list[tuple[int, int]]]:
    """Indexed word to its postings (template, place)."""
    out: dict[str, list[tuple[int, int]]] = {}
    for t, e in enumerate(entries):
        for k in e.rare:
            out.setdefault(e.words[k], []).append((t, k))
    return out


def _literal(value: object, kind: str) -> Column:
    """A constant of a nested type, which the optimizer folds."""
    return F.from_json(F.lit(json.dumps({"v": value})), f"v {kind}")["v"]


def _bound(value: Column, use) -> Column:
    """use(value) with the value computed once, as the variable of a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: An alignment as one long: the template above, the first word below.
_PLACE = 32
COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _alignments(words: Column, entries: list[Entry]) -> Column:
    """Alignments at which enough rare words agree, each once, in order."""
    by_word = postings(entries)
    places = _literal({w: [{"t": t, "k": k} for t, k in p] for w, p in by_word.items()}, "map<string,array<struct<t:bigint,k:int>>>")
    need = _literal([e.need for e in entries], "array<int>")
    found = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(sorted(by_word)), i)))

    def of(i: Column) -> Column:
        inside = F.filter(F.element_at(places, F.element_at(words, i + 1)), lambda p: p["k"] <= i)
        return F.transform(inside, lambda p: F.shiftleft(p["t"], _PLACE) + (i - p["k"]))

    def enough(x: Column, j: Column, keys: Column) -> Column:
        last = F.try_element_at(keys, j + F.element_at(need, F.shiftright(x, _PLACE).cast("int") + 1))
        return ((j == 0) | (F.try_element_at(keys, F.greatest(j, F.lit(1))) != x)) & F.coalesce(last == x, F.lit(False))

    return _bound(F.array_sort(F.flatten(F.transform(found, of))), lambda keys: F.filter(keys, lambda x, j: enough(x, j, keys)))


def _verified(words: Column, key: Column, entries: list[Entry]) -> Column:
    """label, base, start, share and full of an alignment."""
    kind = "array<struct<label:string,base:boolean,least:double,total:bigint,words:array<struct<w:string,idf:bigint>>,phrases:array<struct<at:int,words:array<string>>>>>"
    rows = [
        {
            "label": e.template.label,
            "base": e.template.base,
            "least": e.template.least,
            "total": sum(e.idf),
            "words": [{"w": w, "idf": x} for w, x in zip(e.words, e.idf, strict=True)],
            "phrases": [{"at": at, "words": p} for at, p in e.phrases],
        }
        for e in entries
    ]
    table = _literal(rows, kind)
    start = key.bitwiseAND(F.lit((1 << _PLACE) - 1).cast("long"))

    def verify(t: Column) -> Column:
        own = F.slice(words, start.cast("int") + 1, F.size(t["words"]))
        weight = F.aggregate(F.zip_with(own, t["words"], lambda a, b: F.when(a == b["w"], b["idf"]).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda acc, x: acc + x)
        whole = F.forall(t["phrases"], lambda p: F.slice(words, (start + p["at"]).cast("int") + 1, F.size(p["words"])) == p["words"])
        return _bound(weight / t["total"], lambda share: F.struct(t["label"].alias("label"), t["base"].alias("base"), start.alias("start"), share.alias("share"), (whole & (share >= t["least"])).alias("full")))

    return _bound(F.element_at(table, F.shiftright(key, _PLACE).cast("int") + 1), verify)


def scan(df: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """df with n_words, n_base, first_word, last_word, base_labels, labels and score; see the module's notes.

    score: 1 where some template stands whole, else the largest share of a template's IDF weight found at one alignment.
    """
    entries = index(templates)
    # lower() would also fold letters beyond ASCII.
    low = F.translate(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), ASCII_UPPER, ASCII_LOWER)
    labels = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["label"]))), ",")

    def summed(words: Column, found: Column, full: Column, base: Column) -> Column:
        starts = F.transform(base, lambda x: x["start"])
        best = F.coalesce(F.array_max(F.transform(found, lambda x: x["share"])), F.lit(0.0))
        values = (F.size(words).cast("long"), F.size(base).cast("long"), F.array_min(starts), F.array_max(starts), labels(base), labels(full), F.when(F.size(full) > 0, F.lit(1.0)).otherwise(F.round(best, 6)))
        return F.struct(*(v.alias(n) for n, v in zip(COLUMNS, values, strict=True)))

    def whole(words: Column) -> Column:
        found = F.transform(_alignments(words, entries), lambda key: _verified(words, key, entries))
        return _bound(found, lambda f: _bound(F.filter(f, lambda x: x["full"]), lambda full: summed(words, f, full, F.filter(full, lambda x: x["base"]))))

    result = _bound(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), whole)
    name = "scanned"
    while name in df.columns:
        name += "_"
    keep = [F.col(f"`{c}`") for c in df.columns if c not in COLUMNS]
    return df.select(*keep, result.alias(name)).select(*keep, f"{name}.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).select("doc_id", *COLUMNS)


def sql() -> str:
    """The same rows in DuckDB, by joining the words' places with the postings."""
    entries = index()
    quoted = lambda x: "'" + x + "'"
    posts = ", ".join(f"({quoted(w)}, {t}, {k})" for w, found in sorted(postings(entries).items()) for t, k in found)
    kinds = ", ".join(f"({t}, {quoted(e.template.label)}, {str(e.template.base).lower()}, {e.template.least!r}::DOUBLE, {e.need}, {sum(e.idf)}, {len({k for at, p in e.phrases for k in range(at, at + len(p))})})" for t, e in enumerate(entries))
    spots = ", ".join(f"({t}, {k}, {quoted(w)}, {e.idf[k]}, {str(any(at <= k < at + len(p) for at, p in e.phrases)).lower()})" for t, e in enumerate(entries) for k, w in enumerate(e.words))
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '{word}') AS w FROM documents
), x AS (
  SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM t
), post(w, t, k) AS (VALUES {posts}
), kind(t, label, base, least, need, total, mandatory) AS (VALUES {kinds}
), spot(t, k, w, idf, must) AS (VALUES {spots}
), a AS (
  SELECT doc_id, t, i - k AS start FROM x JOIN post USING (w) JOIN kind USING (t) WHERE i >= k GROUP BY doc_id, t, start HAVING count(*) >= any_value(need)
), v AS (
  SELECT a.doc_id, a.t, a.start, coalesce(sum(idf) FILTER (x.w IS NOT NULL), 0) AS weight, count(*) FILTER (must AND x.w IS NOT NULL) AS there
  FROM a JOIN spot USING (t) LEFT JOIN x ON x.doc_id = a.doc_id AND x.i = a.start + spot.k AND x.w = spot.w GROUP BY ALL
), f AS (
  SELECT doc_id, start, label, base, weight::DOUBLE / total AS share, there = mandatory AND weight::DOUBLE / total >= least AS whole FROM v JOIN kind USING (t)
), g AS (
  SELECT doc_id, count(*) FILTER (whole AND base) AS n, min(start) FILTER (whole AND base) AS lo, max(start) FILTER (whole AND base) AS hi,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole AND base) AS b, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole) AS l,
    CASE WHEN bool_or(whole) THEN 1.0::DOUBLE ELSE round(max(share), 6) END AS score
  FROM f GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
  coalesce(b, '') AS base_labels, coalesce(l, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM t LEFT JOIN g USING (doc_id)"""
