"""Base places against plain Python, templates under insertions and decoys, odd rows."""

import re

import pytest

from parley.llm import licences as li

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for phrase, label in li.PHRASES.items():
        own = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(own)] == own]
        at += found
        if found:
            labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def check(rows, texts):
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(","))))) and 0 <= r.score <= 1


def test_query_against_plain_python(spark, sf, docs):
    rows = li.op7_licences(spark, sf).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    check(rows, texts)
    by = {r.doc_id: set(r.labels.split(",")) for r in rows}
    for d, t in texts.items():
        if "Licensed under the Apache License, Version 2.0" in t:
            assert "apache-2.0" in by[d]
        if "CC BY-NC 4.0" in t:
            assert "cc-by-nc" in by[d]
        if not re.search("(?i)licen|permi|redistrib|reserved|cc|creative|software|source", t):
            assert by[d] == {""}


INDEX = li.build_index(10, {})


def labels(text):
    return set(li.matches(li.words_of(text.encode()), INDEX))


@pytest.mark.parametrize("label,text", sorted({(a, b) for a, b, _ in li.TEMPLATES}))
def test_templates_are_found_anywhere(label, text):
    filler = "lorem ipsum dolor sit amet " * 40
    assert label in labels(text) and label in labels(filler + text.upper() + "\n" + filler)
    words = text.split()
    if len(words) > 12:  # a word more, away from the key phrases
        assert label in labels(" ".join([*words[:-1], "very", words[-1]]))


def test_decoys():
    assert labels("the apache helicopter needs no license in version 2 of 0 rules") == set()
    assert labels("version license apache the under licensed 2 0") == set()
    assert labels("license " * 500) == set() and labels("") == set()
    assert "gpl-3.0" not in labels("licensed under the gnu general public license version 2")


def test_repeated_and_overlapping_phrases():
    words = li.words_of(b"CC BY cc-by, All Rights Reserved; all rights reserved. cc\xc3\xa9 by")
    assert li.places(words, [b"cc by", b"all rights reserved"]) == [[0, 2], [4, 7]]


def test_rare_words_follow_the_corpus(spark, docs):
    total, frequency = li.document_frequencies(docs)
    assert total == 1000
    texts = [set(WORD.findall(r.text.lower())) for r in docs.collect()]
    for w in ("license", "the", "mit"):
        assert frequency.get(w.encode(), 0) == sum(w in t for t in texts)
    index = li.build_index(total, frequency)
    assert b"the" not in index.postings and b"apache" in index.postings


def test_odd_rows(spark, odd, no_docs):
    from tests.llm.conftest import odd_rows

    rows = li.scan(odd, li.build_index(*li.document_frequencies(odd))).collect()
    texts = odd_rows()
    assert sorted((r.n_words, r.n_base, r.base_labels) for r in rows) == sorted((p[0], p[1], p[4]) for p in (plain(x[1]) for x in texts))
    assert li.scan(no_docs, li.build_index(*li.document_frequencies(no_docs))).count() == 0
