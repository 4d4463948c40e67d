"""Licence scan by a positional rare-token index.

All words of all licence templates form one positional index: word -> (template, position). Word weights are
inverse document frequencies over the whole corpus. Of each file, its rarest licence words are looked up; a
posting at position j met by a file's word at position i says that the template begins at i - j. Postings of
different words are intersected by that relative position, give or take a tolerance for words put in or left
out, and where enough of them agree the mandatory key phrase must stand, word for word, near its place.

Base phrases are templates that are all key phrase, without tolerance, of which every word must agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_TABLE, tidied

#: Base phrases and their labels (fixed by the query's contract).
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label, mandatory key phrase, and the words in which it stands.
TEMPLATES = [
    ("mit-text", "permission is hereby granted free of charge to any person", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("zlib", "this software is provided as is without any express or implied warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl-text", "under the terms of the gnu general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("lgpl", "gnu lesser general public license", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2.0", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("gpl-2.0", "gnu general public license version 2", "this work is licensed under the gnu general public license version 2"),
    ("gpl-3.0", "gnu general public license version 3", "this work is licensed under the gnu general public license version 3"),
    ("cc-by-4.0", "cc by 4 0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "cc by sa 4 0", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", "cc by nc 4 0", "licensed under cc by nc 4 0"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
]
#: Of each template, so many of the file's highest-weight words are looked up, and so many must agree (or as
#: many as there are), on a place give or take so many words.
RARE, AGREE, TOLERANCE = 6, 3, 8


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(ALNUM_TABLE).split() if text else []


class Template:
    def __init__(self, label: str, key: str, text: str, base: bool, weight: dict[bytes, float]):
        self.label, self.base, self.words, self.phrase = label, base, text.encode().split(), key.encode().split()
        self.start = next(i for i in range(len(self.words)) if self.words[i : i + len(self.phrase)] == self.phrase)
        self.weights = [weight.get(w, 0.0) + 1e-9 for w in self.words]
        self.positions: dict[bytes, list[int]] = {}
        for i, w in enumerate(self.words):
            self.positions.setdefault(w, []).append(i)
        # The rarest first; ties by the word itself.
        self.ranked = sorted(self.positions, key=lambda w: (-weight.get(w, 0.0), w))
        self.tolerance = 0 if base else TOLERANCE
        self.looked = len(self.ranked) if base else RARE
        self.agree = len(self.ranked) if base else AGREE


class Index:
    """The templates' positional postings, queried by a file's words."""

    def __init__(self, base: dict[str, str], templates: list[tuple[str, str, str]], weight: dict[bytes, float]):
        self.weight = weight
        self.templates = [*(Template(v, k, k, True, weight) for k, v in base.items()), *(Template(*t, False, weight) for t in templates)]
        self.vocabulary = frozenset(w for t in self.templates for w in t.words)
        self.mandatory = [frozenset(t.phrase) for t in self.templates]

    def places(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, position of its key phrase, share of its weight found in place), each place once, in order."""
        held = self.vocabulary.intersection(words)
        open_ = [t for t, phrase in enumerate(self.mandatory) if phrase <= held]
        if not open_:
            return []
        asked = {t: [w for w in self.templates[t].ranked if w in held][: self.templates[t].looked] for t in open_}
        wanted = frozenset(w for t in open_ for w in asked[t])
        at: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in wanted:
                at.setdefault(w, []).append(i)
        found = []
        for t in open_:
            template = self.templates[t]
            for key in self._verified(words, template, asked[t], at):
                found.append((t, key, self._share(words, template, key - template.start)))
        return found

    @staticmethod
    def _verified(words: list[bytes], template: Template, asked: list[bytes], at: dict[bytes, list[int]]) -> list[int]:
        """Places of the key phrase, if enough of the asked words put the template's beginning there, give or take the tolerance."""
        about = np.arange(-template.tolerance, template.tolerance + 1)
        told = []
        for w in asked:
            begins = np.unique(np.subtract.outer(at[w], template.positions[w]))
            told.append(np.unique(np.add.outer(begins, about)))
        begin, agree = np.unique(np.concatenate(told), return_counts=True)
        places = begin[(agree >= min(template.agree, len(asked))) & (begin + template.start >= 0)] + template.start
        return [p for p in places.tolist() if words[p : p + len(template.phrase)] == template.phrase]

    @staticmethod
    def _share(words: list[bytes], template: Template, begin: int) -> float:
        """Share, by weight, of the template's words that stand within the tolerance of their place."""
        wide = template.tolerance
        found = sum(
            v for k, (w, v) in enumerate(zip(template.words, template.weights)) if w in words[max(0, begin + k - wide) : max(0, begin + k + wide + 1)]
        )
        return min(1.0, found / sum(template.weights))


def vocabulary(base: dict[str, str], templates: list[tuple[str, str, str]]) -> list[str]:
    return sorted({w for text in [*base, *(t for _, _, t in templates)] for w in text.split()})


def document_frequencies(docs: DataFrame, words: list[str]) -> tuple[int, dict[bytes, float]]:
    """Number of documents, and for each word the inverse document frequency over all of them."""
    known = frozenset(w.encode() for w in words)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, dict.fromkeys(known, 0)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for text in batch.slice(at, 500).column(0).cast(pa.binary()).to_pylist():
                    n += 1
                    for w in known.intersection(words_of(text)):
                        df[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([*(w.decode() for w in df), ""]), pa.array([*df.values(), n])], ["word", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"].encode(): r["n"] for r in counted.collect()}  # one row per licence word
    total = found.pop(b"", 0)
    return total, {w: math.log((total + 1) / (n + 1)) + 1e-6 for w, n in found.items()}


def scan(docs: DataFrame, base: dict[str, str] = BASE, templates: list[tuple[str, str, str]] = TEMPLATES) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    n_base counts all places of base phrases, first_word and last_word are the smallest and largest word
    number where one starts (null without one). labels are the base labels and those of the templates found;
    score is the largest share, by weight, of a template found in place (0 without any). places lists (label,
    word number of the key phrase). A template whose key phrase has a changed word is not found. Null or empty
    text has no words. Rows that repeat a doc_id (null too) are scanned one by one; whole texts are scanned,
    however long; other columns are ignored; an empty table gives an empty result.
    """
    _, weight = document_frequencies(docs, vocabulary(base, templates))
    index = Index(base, templates, weight)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())])))
        names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places")
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                part, rows = whole.slice(k, 500), []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                    words = words_of(text)
                    found = [(index.templates[t], at, share) for t, at, share in index.places(words)]
                    starts = [at for t, at, _ in found if t.base]
                    rows.append((
                        doc, len(words), len(starts), min(starts, default=None), max(starts, default=None),
                        ",".join(sorted({t.label for t, _, _ in found if t.base})), ",".join(sorted({t.label for t, _, _ in found})),
                        max((s for _, _, s in found), default=0.0), [{"label": t.label, "word": at} for t, at, _ in found],
                    ))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], list(names))

    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return text.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label:string,word:long>>")
