"""Candidates of the license scan against alignment alone."""

import random
import time

import pytest

from fundloom.llm import licenses


def aligned(index, name, words):
    """Whether some diagonal's alignment reaches the coverage."""
    own = index.words[name, 0]
    found = (index._align(name, own, words, d - licenses.BAND, d + licenses.BAND) for d in range(-len(own), len(words)))
    return any(m and m[4] >= licenses.COVERAGE for m in found)


def test_every_edit_of_one_word_is_found():
    for name, text in licenses.TEMPLATES.items():
        index, own = licenses.Index({name: text}), text.split()
        for k in range(len(own) + 1):
            for edited in (own[:k] + ["zzz"] + own[k + 1 :], own[:k] + own[k + 1 :], own[:k] + ["zzz"] + own[k:]):
                words = ["aa"] * 9 + edited + ["bb"] * 9
                text_of = " ".join(words).encode()
                assert bool(index.scan(text_of)) == aligned(index, name, licenses.words_of(text_of)), (name, edited)
    assert licenses.Index(licenses.TEMPLATES).scan(b"Licensed under the MIT License")[0][0] == "mit"


HEADER = """/* Copyright 2019 J. Doe
 * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details. */ int main() {}"""


def test_texts_headers_and_spdx_lines(spark):
    texts = [(name, text) for name, texts in licenses.PRODUCTION.items() for text in texts]
    cases = [(name, "# some code\n" + text.replace(". ", ".\n\n * ") + "\nmore code") for name, text in texts] + [("gpl-2.0", HEADER)]
    cases.append(("mit", "Copyright (c) 2020 Foo\n" + licenses.TEXTS["mit"].replace("AUTHORS OR COPYRIGHT HOLDERS", "FOO CORPORATION").replace("(the \"Software\")", "")))
    docs = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(cases)], "doc_id long, text string")
    got = [(r.doc_id, r.license) for r in licenses.scan_licenses(docs).collect()]
    assert sorted(got) == [(k, name) for k, (name, _) in enumerate(cases)]


@pytest.mark.parametrize("kind", ["replaced", "left out", "put in"])
def test_recall_of_edited_templates(kind):
    """Of templates with one word in ten changed, nine of ten at least are found; those of which too little is left don't count."""
    rng = random.Random(kind)
    texts = [(name, text.split()) for name, texts in licenses.PRODUCTION.items() for text in texts if len(text.split()) >= 10]
    index, found, n = licenses.Index(licenses.PRODUCTION), 0, 0
    for name, own in texts:
        for _ in range(10):
            edited = []
            for word in own:
                hit = rng.random() < 0.1
                edited += [[word], {"replaced": ["zzz"], "left out": [], "put in": ["zzz", word]}[kind]][hit]
            left = len(edited) if kind == "left out" else sum(w != "zzz" for w in edited)
            if left >= 0.85 * len(own):
                n += 1
                found += any(m[0] == name for m in index.scan(" ".join(["aa"] * 50 + edited + ["bb"] * 50).encode()))
    assert n > 100 and found >= 0.95 * n


@pytest.mark.parametrize("fragment", ["including but not limited to the implied warranties of merchantability ", "all rights reserved ", "of this license "])
def test_a_long_text_of_fragments(fragment):
    index = licenses.Index(licenses.PRODUCTION)
    began = time.time()
    found = index.scan((fragment * (1_000_000 // len(fragment))).encode())
    assert time.time() - began < 60 and len(found) == (1_000_000 // len(fragment) if "all rights" in fragment else 0)


def test_pruned_regions_hold_no_match():
    """Every diagonal's alignment that reaches the coverage lies in a region that is left."""
    rng = random.Random(5)
    own = licenses.words_of(licenses.TEXTS["isc"].encode())
    index = licenses.Index({"isc": licenses.TEXTS["isc"]})
    for _ in range(30):
        a, b = sorted(rng.sample(range(len(own)), 2))
        words = own[a:b] + [b"x"] * rng.randrange(9) + [rng.choice(own) for _ in range(100)] + own[: rng.randrange(len(own))] + own[rng.randrange(20) :]
        whole = any(m and m[4] >= 0.8 for m in (index._align("isc", own, words, d - 4, d + 4) for d in range(-len(own), len(words), 3)))
        assert not whole or index.scan(b" ".join(words))
