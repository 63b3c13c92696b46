"""License scans: a positional index of rare licence words, and mandatory key phrases.

Every licence template is a text with a key phrase. Its words' inverse document frequencies come from all documents (one
count for each word of the templates). A file is looked up by its licence words, the highest IDF first: each posting of
such a word in a template votes for the place in the file where that template would start. Common words have no
postings: a word is indexed in a template while it is among the rarer half there, or in the key phrase. For a place with the votes of at least
``votes`` of a template's rare words (all of them, if it has fewer), the key phrase is verified word for word, near where it
would stand; if it is there, the file has that label, and the share of the template's words (weighted by IDF) found at their relative
positions is its score.

The base labels are those of three phrases, wherever their words stand consecutively.

Edge cases: a null or empty text has no words, no labels and score 0. Repeated rows are scanned each.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonewatch.llm.text import utf8

# Phrases of the base labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Label, key phrase, and words of public licence notices.
TEMPLATES = [
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache", "apache license", "licensed under the apache license version 2 0"),
    ("apache", "apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl", "general public license", "licensed under the gnu general public license version 3"),
    ("gpl", "general public license", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "lesser general public license", "under the terms of the gnu lesser general public license"),
    ("agpl", "affero general public license", "under the terms of the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "cc by 4 0", "licensed under cc by 4 0"),
    ("cc-by", "creative commons attribution 4 0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "cc0 1 0", "released under cc0 1 0 universal public domain dedication"),
]

_KEPT = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words of digits, letters and all characters beyond ASCII; A-Z in lower case."""
    return (text or b"").translate(_KEPT).split()


@dataclass
class Index:
    """Postings of the templates' rare words; ``idf`` covers all their words."""

    idf: dict[bytes, float]
    votes: int = 2
    #: Words by which a key phrase may stand off its place, for words put in or left out before it.
    slack: int = 3
    templates: list[tuple[str, list[bytes], list[bytes], int]] = field(default_factory=list)
    postings: dict[bytes, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))
    rare: list[int] = field(default_factory=list)

    def __post_init__(self):
        for k, (label, phrase, text) in enumerate(TEMPLATES):
            words, key = text.encode().split(), phrase.encode().split()
            at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
            self.templates.append((label, words, key, at))
            middle = sorted((self.idf[w] for w in words), reverse=True)[(len(words) - 1) // 2]
            rare = [i for i, w in enumerate(words) if self.idf[w] >= middle or at <= i < at + len(key)]
            self.rare.append(len(rare))
            for i in rare:
                self.postings[words[i]].append((k, i))

    def scan(self, words: list[bytes]) -> dict[str, float]:
        """Labels with the best score of their templates."""
        places: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.postings:
                places[w].append(i)
        votes: dict[tuple[int, int], int] = defaultdict(int)
        for w in sorted(places, key=lambda w: -self.idf[w]):
            for k, i in self.postings[w]:
                for p in places[w]:
                    votes[k, p - i] += 1
        found: dict[str, float] = {}
        for (k, start), n in votes.items():
            label, template, key, at = self.templates[k]
            if n < min(self.votes, self.rare[k]):
                continue
            around = range(max(0, start + at - self.slack), start + at + self.slack + 1)
            if not any(words[p : p + len(key)] == key for p in around):
                continue
            weight = sum(self.idf[w] for w in template)
            hit = sum(self.idf[w] for i, w in enumerate(template) if 0 <= start + i < len(words) and words[start + i] == w)
            found[label] = max(found.get(label, 0.0), hit / weight)
        return found


def document_frequencies(documents: DataFrame, text: str = "text") -> tuple[int, dict[bytes, int]]:
    """All documents, and for each word of the templates those that hold it."""
    known = frozenset(w for _, _, t in TEMPLATES for w in t.encode().split())

    def run(batches):
        for batch in batches:
            seen: dict[bytes, int] = dict.fromkeys(known, 0)
            for t in utf8(batch.column(0)):
                for w in known.intersection(words_of(t)):
                    seen[w] += 1
            yield pa.RecordBatch.from_arrays([pa.array([*seen, b""], pa.binary()), pa.array([*seen.values(), batch.num_rows], pa.int64())], names=["word", "n"])

    counted = documents.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = {bytes(r.word): r.n for r in counted.collect()}  # one for each word of the templates
    return rows.pop(b"", 0), {w: rows.get(w, 0) for w in known}


_SCAN = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()),
])
_PHRASES = [(p.encode().split(), label) for p, label in BASE.items()]


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """Where a base phrase starts, with its label."""
    out = []
    for i in [i for i, w in enumerate(words) if w == b"license"]:
        for phrase, label in _PHRASES:
            start = i - len(phrase) + 1
            if start >= 0 and words[start : i + 1] == phrase:
                out.append((start, label))
    return out


def scanned(documents: DataFrame, text: str = "text", into: str = "licence") -> DataFrame:
    """``documents`` with a struct column ``into`` of counts, places, labels and score."""
    total, frequency = document_frequencies(documents, text)
    idf = {w: math.log((total + 1) / (n + 1)) + 1e-3 for w, n in frequency.items()}

    def scan(texts: pa.Array) -> pa.Array:
        index, rows = Index(idf), []
        for t in utf8(texts):
            words = words_of(t)
            base = base_places(words)
            found = index.scan(words)
            mine = {label for _, label in base}
            starts = [p for p, _ in base]
            rows.append((
                len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(mine)),
                ",".join(sorted(mine | set(found))), max(found.values(), default=0.0)))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_SCAN)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], _SCAN.names)

    fn = F.arrow_udf(scan, _SCAN).asNondeterministic()
    return documents.withColumn(into, fn(F.col(f"`{text}`")))
