"""Notices inside longer texts, wrapped or in the middle of a line, and full licence texts."""

import textwrap

import pytest

from dewfall.llm import licenses

SHORT = {n: t for n, t in licenses.TEMPLATES}
FULL = dict(licenses.FULL_TEXTS)
PROSE = "".join(f"Word{k} of moon{k} and sea{k} with sand{k}, shore{k}, tide{k}, boat{k}, net{k} or cod{k}.\n" for k in range(5))
GPL = next(t for n, t in licenses.TEMPLATES if n == "GPL-3.0" and "redistribute" in t)
CASES = [
    (PROSE + "\n".join(textwrap.wrap(GPL, 78)) + "\n" + PROSE, "GPL-3.0", 6),
    ("Copyright (c) 2020 Ann\n\n" + "\n".join(textwrap.wrap(FULL["MIT"], 78)), "MIT", 3),
    (PROSE + "This dataset is licensed under CC BY 4.0. Please cite our paper on the moon when you use it for your work.", "CC-BY-4.0", 6),
    ("Released under the MIT License.", "MIT", 1),
    (PROSE, None, None),
    ("Copyright 2021\n" + "\n".join(textwrap.wrap(FULL["BSD-3-Clause"], 70)) + "\n" + PROSE, "BSD-3-Clause", 2),
    (None, None, None),
]


def test_notices_are_found(spark):
    docs = spark.createDataFrame([(k, text) for k, (text, _, _) in enumerate(CASES)], "doc_id long, text string")
    got = {r.doc_id: (r.license, r.line) for r in licenses.scan(docs).collect()}
    assert got == {k: (name, line) for k, (_, name, line) in enumerate(CASES)}
    counts = {r.doc_id: r.n_matches for r in licenses.scan(docs).collect()}
    assert counts[3] == 1 and counts[4] == 0


PHRASES = [
    ("// SPDX-License-Identifier: MIT\nint main;", "MIT", 1),
    ("# SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0", 1),
    (PROSE + "It is licensed under the MIT license, as ever.", "MIT", 6),
    (PROSE + "Note: licensed under the Apache License 2.0 since May.", "Apache-2.0", 6),
    ("The moon is licensed to shine under the sea.", None, None),
]


def test_phrases_and_tags(spark):
    docs = spark.createDataFrame([(k, text) for k, (text, _, _) in enumerate(PHRASES)], "doc_id long, text string")
    assert {r.doc_id: (r.license, r.line) for r in licenses.scan(docs).collect()} == {k: (name, line) for k, (_, name, line) in enumerate(PHRASES)}


@pytest.mark.parametrize("times", [1, 2, 3])
def test_every_copy_of_a_text_counts(spark, times):
    """Copies inside a text, wrapped and with prose in between; a list of templates given by the caller brings no full texts of its own."""
    wrapped = "\n".join(textwrap.wrap(FULL["MIT"], 78)) + "\n"
    docs = spark.createDataFrame([(1, PROSE + (wrapped + PROSE) * times)], "doc_id long, text string")
    mit = [("MIT", FULL["MIT"])]
    assert licenses.scan(docs, licenses.TEMPLATES[11:12], full_texts=mit).first().n_matches == times
    assert licenses.scan(docs, list(licenses.TEMPLATES)).first().n_matches == licenses.scan(docs).first().n_matches
    assert licenses.scan(docs, list(licenses.TEMPLATES), full_texts=[]).first().n_matches < licenses.scan(docs).first().n_matches
