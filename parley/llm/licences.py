"""License scans over a positional rare-token index.

Words are runs of ASCII letters and digits and of non-ASCII characters, after
A-Z are lower-cased. Fixed phrases give base labels at their places. Templates
(opening words of well-known licenses) give more: the inverse document
frequencies of all template words are counted over the whole corpus, each
template is indexed under its rarest words with their positions, a file looks up
the indexed words that it has, and postings that agree on where the template
would start (within ``SLACK`` words) make a candidate. A candidate is verified
by its share of aligned words and by every mandatory key phrase of the template
near its place.

Defined results: a null or empty text has no words, no label and score 0; a
null doc_id stays null; repeated rows give equal results; an empty table gives
an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm import text as tx

# Phrases and labels of the base scan.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Opening words of well-known public license notices, and the phrases each must have.
TEMPLATES: list[tuple[str, str, list[str]]] = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["general public license version 2"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["general public license version 3"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["free software", "general public license"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted", "free of charge"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc0", "licensed under cc0 1 0 universal", ["cc0 1 0"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
]

ANCHORS = 4  # indexed words of a template
SLACK = 3  # words that may be missing or added before a place
MIN_SHARE = 0.7  # of a template's words, aligned in order

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def places(words: list[bytes], phrases: list[bytes]) -> list[list[int]]:
    """The positions at which each phrase's words stand one after the other."""
    line = b" " + b" ".join(words) + b" "
    out = []
    for phrase in phrases:
        found, at, counted, n = [], line.find(b" " + phrase + b" "), 0, 0
        while at >= 0:
            n += line.count(b" ", counted, at)
            counted = at
            found.append(n)
            at = line.find(b" " + phrase + b" ", at + 1)
        out.append(found)
    return out


VOCABULARY = sorted({w for _, t, _ in TEMPLATES for w in t.encode().split()})


def document_frequencies(docs: DataFrame) -> tuple[int, dict[bytes, int]]:
    """How many of all texts there are, and in how many each template word stands (one row for each word comes back)."""
    vocabulary = frozenset(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = defaultdict(int)
        for b in batches:
            column = tx.filled(b.column("text"))
            counts[b""] += len(column)
            for x, y in tx.slices(column):
                data, offsets = tx.raw(column.slice(x, y - x))
                whole = data.tobytes()
                for a, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    for w in vocabulary.intersection(words_of(whole[a:e])):
                        counts[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    got = {r.word.encode(): r.n for r in rows}
    return got.pop(b"", 0), got


@dataclass
class Index:
    postings: dict[bytes, list[tuple[int, int]]]  # rare word -> (template, position)
    words: list[list[bytes]]
    keys: list[list[bytes]]
    labels: list[str]
    need: list[int]  # postings of a template that must agree


def build_index(total: int, frequency: dict[bytes, int], anchors: int = ANCHORS) -> Index:
    """Each template under its words of highest inverse document frequency (ties: longer words, then their order)."""
    idf = lambda w: math.log((total + 1) / (frequency.get(w, 0) + 1))
    postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    words, need = [], []
    for i, (_, text, _) in enumerate(TEMPLATES):
        own = text.encode().split()
        rare = set(sorted(set(own), key=lambda w: (-idf(w), -len(w), own.index(w)))[:anchors])
        for p, w in enumerate(own):
            if w in rare:
                postings[w].append((i, p))
        words.append(own)
        need.append(min(3, len(rare)))
    return Index(dict(postings), words, [[k.encode() for k in keys] for _, _, keys in TEMPLATES], [x for x, _, _ in TEMPLATES], need)


def _aligned(template: list[bytes], words: list[bytes], start: int, slack: int) -> float:
    """Share of the template's words met in order from ``start`` on, up to ``slack`` words out of step."""
    at, met = max(0, start), 0
    for w in template:
        for j in range(at, min(at + slack + 1, len(words))):
            if words[j] == w:
                met, at = met + 1, j + 1
                break
    return met / len(template)


def matches(words: list[bytes], index: Index, slack: int = SLACK, min_share: float = MIN_SHARE) -> dict[str, float]:
    """Label -> best verified share."""
    own = index.postings.keys() & set(words)
    if not own:
        return {}
    votes: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
    for p, w in enumerate(words):
        if w in own:
            for t, q in index.postings[w]:
                votes[t].append((p - q, w))
    found: dict[str, float] = {}
    for t, starts in votes.items():
        starts.sort()
        lead, seen, tried = 0, defaultdict(int), None
        for start, w in starts:  # a window of starts within the slack
            seen[w] += 1
            while starts[lead][0] < start - slack:
                gone = starts[lead][1]
                seen[gone] -= 1
                if not seen[gone]:
                    del seen[gone]
                lead += 1
            at = starts[lead][0]
            if len(seen) < index.need[t] or at == tried:
                continue
            tried = at
            share = max(_aligned(index.words[t], words, at + k, slack) for k in range(slack + 1))
            if share < min_share or share <= found.get(index.labels[t], 0):
                continue
            near = words[max(0, at - slack) : max(0, at) + len(index.words[t]) + 2 * slack]
            if all(places(near, index.keys[t])):
                found[index.labels[t]] = share
    return found


def scan(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document."""
    kinds = {"n_words": T.LongType(), "n_base": T.LongType(), "first_word": T.LongType(), "last_word": T.LongType(), "base_labels": T.StringType(), "labels": T.StringType(), "score": T.DoubleType()}
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(k, v) for k, v in kinds.items())])
    arrow = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    phrases = [p.encode() for p in PHRASES]
    names = list(PHRASES.values())

    def one(text: bytes) -> tuple:
        words = words_of(text)
        at = places(words, phrases)
        every = [x for found in at for x in found]
        base = {name for name, found in zip(names, at) if found}
        more = matches(words, index)
        score = max([*more.values(), 0.5 if base else 0.0])
        return len(words), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(base)), ",".join(sorted(base | more.keys())), score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = tx.filled(b.column("text"))
            for x, y in tx.slices(column):
                data, offsets = tx.raw(column.slice(x, y - x))
                whole = data.tobytes()
                rows = [one(whole[a:e]) for a, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(x, y - x), *(pa.array(c, kind) for c, kind in zip(zip(*rows), arrow))], schema.fieldNames())

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op7_licences(spark, sf_dir: str) -> DataFrame:
    """Query: license labels and places of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, build_index(*document_frequencies(docs)))
