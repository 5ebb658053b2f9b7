"""License labels by a positional index of rare license words.

A template is a label, a passage and its mandatory key phrases.  Words get
their inverse document frequency over the scanned corpus, and the index holds
postings: under the highest-IDF word of each template's rarest key phrase, the
template, the word's place in the phrase, and the next rare word with its
relative place.  A file's words that the index knows are looked up from the
highest IDF to the lowest; every posting gives the place at which the phrase
would start, the next rare word must stand at the matching relative position,
and the key phrases are then verified word for word.  A template is accepted at
a place where all its key phrases stand at their relative positions and a large
enough share of its passage's words stands at theirs.

Everything is DataFrame functions on one row; the index is one constant, so
the plan does not grow with the templates.  Only the document frequencies of
the key phrases' words (bounded by the templates) reach the driver.
"""

from __future__ import annotations

import json
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base phrases and their labels.
BASE_PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# Passages of well-known license notices (label, passage, key phrases).
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("hereby granted free of charge",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("under the apache license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("the gnu general public license",)),
    ("gpl", "released under the gnu general public license", ("gnu general public license",)),
    ("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by", "this work is licensed under a creative commons attribution license", ("creative commons attribution",)),
    ("cc-by-sa", "this work is licensed under cc by sa", ("cc by sa",)),
    ("proprietary", "all rights reserved", ("all rights reserved",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("to deal in the software without restriction", "substantial portions of the software")),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ("unless required by applicable law or agreed to in writing",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions of source code must retain", "redistributions in binary form must reproduce")),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", ("as published by the free software foundation", "the gnu general public license")),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("if a copy of the mpl was not distributed",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("for any purpose with or without fee",)),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ("free and unencumbered software",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("any person or organization obtaining a copy",)),
    ("cc0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work", ("associated cc0 with this work",)),
)

_PLACE = "array<struct<start:int,template:int,share:double>>"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def templates(base=BASE_PHRASES, notices=NOTICES) -> list[dict]:
    """Base phrases and notices as templates: label, base flag, words, and keys as (position, words)."""
    out = [{"label": label, "base": True, "words": phrase.split(), "keys": [(0, phrase.split())]} for label, phrase in base]
    for label, passage, keys in notices:
        words = passage.split()
        placed = []
        for key in keys:
            key = key.split()
            at = next((i for i in range(len(words)) if words[i : i + len(key)] == key), None)
            if at is None:
                raise ValueError(f"the passage of {label} lacks its key phrase")
            placed.append((at, key))
        out.append({"label": label, "base": False, "words": words, "keys": placed})
    return out


def inverse_frequencies(words: DataFrame, wanted: list[str]) -> dict[str, float]:
    """Inverse document frequency of the wanted words over all rows of ``words(words array)``."""
    found = F.array_intersect("words", F.lit(wanted)) if wanted else F.array().cast("array<string>")
    counts = words.select(F.explode(F.array_append(found, F.lit(""))).alias("word")).groupBy("word").count().collect()  # an empty word counts the rows
    n = {r["word"]: r["count"] for r in counts}
    return {w: log((n.get("", 0) + 1) / (n.get(w, 0) + 1)) for w in wanted}


def postings(known: list[dict], idf: dict[str, float]) -> dict[str, list[dict]]:
    """The index: postings under the highest-IDF word of each template's rarest key phrase.

    A posting has the template's number, the key phrase and the place of its
    rare word in it, the next rare word and its place, the passage, the key
    phrase's place in the passage, and the other key phrases with theirs.
    """
    index: dict[str, list[dict]] = {}
    for number, t in enumerate(known):
        at, key = max(t["keys"], key=lambda k: max(idf[w] for w in k[1]))
        rare = sorted(range(len(key)), key=lambda i: (-idf[key[i]], i))
        also = rare[1] if len(rare) > 1 else rare[0]
        others = [{"at": k - at, "key": words} for k, words in t["keys"] if k != at]
        entry = {"template": number, "key": key, "place": rare[0], "next": key[also], "next_place": also, "passage": t["words"], "at": at, "others": others}
        index.setdefault(key[rare[0]], []).append(entry)
    return index


_POSTING = "struct<template:int,key:array<string>,place:int,next:string,next_place:int,passage:array<string>,at:int,others:array<struct<at:int,key:array<string>>>>"


def _stands(words: Column, start: Column, phrase: Column) -> Column:
    """Whether the phrase stands word for word from place ``start`` (from 0) on."""
    return (start >= 0) & (F.slice(words, F.greatest(start, F.lit(0)) + 1, F.size(phrase)) == phrase)


def _places(words: Column, index: dict[str, list[dict]], idf: dict[str, float], share: float) -> Column:
    """Places (start of the key phrase, template, share) of all accepted templates."""
    anchors = sorted(index, key=lambda w: (-idf[w], w))
    if not anchors:
        return F.array().cast(_PLACE)
    posted = F.from_json(F.lit(json.dumps(index)), f"map<string,array<{_POSTING}>>")
    rank = {w: i for i, w in enumerate(anchors)}
    ranked = F.from_json(F.lit(json.dumps(rank)), "map<string,int>")
    met = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: x["word"].isin(anchors))
    met = F.array_sort(F.transform(met, lambda x: F.struct(F.element_at(ranked, x["word"]).alias("rank"), x["at"].alias("at"), x["word"].alias("word"))))

    def agreeing(x):
        """The postings of one word of the file whose next rare word stands at its relative place."""
        starts = F.transform(F.element_at(posted, x["word"]), lambda p: F.struct((x["at"] - p["place"]).alias("start"), p.alias("p")))
        return F.filter(starts, lambda c: F.coalesce(F.get(words, c["start"] + c["p"]["next_place"]) == c["p"]["next"], F.lit(False)))

    def verified(c):
        whole = _stands(words, c["start"], c["p"]["key"])
        return whole & F.forall(c["p"]["others"], lambda o: _stands(words, c["start"] + o["at"], o["key"]))

    def place(c):
        standing = F.filter(F.transform(c["p"]["passage"], lambda w, i: F.coalesce(F.get(words, c["start"] - c["p"]["at"] + i) == w, F.lit(False))), lambda ok: ok)
        return F.struct(c["start"].alias("start"), c["p"]["template"].alias("template"), (F.size(standing) / F.size(c["p"]["passage"])).alias("share"))

    found = F.transform(F.filter(F.flatten(F.transform(met, agreeing)), verified), place)
    return F.when(F.arrays_overlap(words, F.lit(anchors)), F.filter(found, lambda p: p["share"] >= share)).otherwise(F.array().cast(_PLACE))


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def _summary(found: DataFrame, known: list[dict]) -> DataFrame:
    names = F.array(*[F.lit(t["label"]) for t in known])
    base = [i for i, t in enumerate(known) if t["base"]]
    places = F.col("places")
    base_places = F.filter(places, lambda p: p["template"].isin(base))
    starts = F.transform(base_places, lambda p: p["start"])
    label = lambda p: F.get(names, p["template"])
    return found.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "n_base": F.size(base_places).cast("long"),
            "first_word": F.array_min(starts).cast("long"),
            "last_word": F.array_max(starts).cast("long"),
            "base_labels": _joined(F.transform(base_places, label)),
            "labels": _joined(F.transform(places, label)),
            "score": F.coalesce(F.array_max(F.transform(places, lambda p: p["share"])), F.lit(0.0)),
        }
    )


def scan(docs: DataFrame, known: list[dict] | None = None, share: float = 0.6) -> DataFrame:
    """License labels and places of every text.

    ``docs`` needs ``text``; its other columns are kept, except that words,
    places, n_words, n_base, first_word, last_word, base_labels, labels and
    score are replaced.  places lists (start word, template number) of every
    accepted template.  score is the largest share of a template's words
    standing in place among the accepted ones, 0 without any.  labels and
    base_labels are distinct, sorted and comma-joined.

    Null and empty texts have no words and no labels.  Repeated rows are
    scanned like others; an empty table gives an empty result.
    """
    known = templates() if known is None else known
    worded = docs.withColumn("words", words_of(F.col("text")))
    vocabulary = sorted({w for t in known for _, key in t["keys"] for w in key})
    idf = inverse_frequencies(worded.select("words"), vocabulary)

    return _summary(worded.withColumn("places", _places(F.col("words"), postings(known, idf), idf, share)), known)
