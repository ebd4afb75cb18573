"""Notices inside long lines, two in a line, and wrapped over lines."""

from __future__ import annotations

import random
import textwrap

import pytest

from revlens.llm import licenses

PROSE = "the morning people of a small river town went over to the market and bought bread for their winter table in this new year".split()


def confirmed(text):
    scanner = licenses.Scanner()
    return [row[0] for _, block in licenses.blocks(text) for row in scanner.scan(block) if row[4]]


@pytest.mark.parametrize("template", range(len(licenses.TEMPLATES)))
@pytest.mark.parametrize("n", [0, 20, 60, 300])
def test_notices_inside_lines(n, template):
    rng = random.Random(n)
    name, notice = licenses.TEMPLATES[template]
    before, after = (" ".join(rng.choice(PROSE) for _ in range(n)) for _ in "ab")
    assert confirmed(f"{before} {notice} {after}") == [name]


def test_both_licenses_of_a_line():
    text = "Licensed under the MIT License. Licensed under the Apache License, Version 2.0."
    assert confirmed(text) == ["MIT", "Apache-2.0"]
    assert confirmed(f"{text} {text}") == ["MIT", "Apache-2.0"] * 2


@pytest.mark.parametrize("template", [2, 7, 10])
@pytest.mark.parametrize("mark", ["# ", " * ", "// ", ""])
@pytest.mark.parametrize("width", [30, 72])
def test_wrapped_notices(width, mark, template):
    name, notice = licenses.TEMPLATES[template]
    lines = textwrap.wrap(notice, width)
    text = "\n".join(["import os", mark.strip(), *[mark + x for x in lines], mark.strip(), "x = 1"])
    assert confirmed(text) == [name]


def test_wrapped_cue_reaches_the_scan(spark):
    docs = spark.createDataFrame([(1, "# Redistribution and\n# use in source and binary forms, with or without modification,\n# are permitted provided that the following conditions are\n# met:")], "doc_id long, text string")
    assert [(r.license, r.confirmed) for r in licenses.scan_licenses(docs).collect()] == [("BSD-3-Clause", True)]


def test_other_licenses_stay_unconfirmed():
    assert confirmed("text before. Licensed under CC BY-NC 5.0. and text after it") == []
    assert confirmed("the driver lost his license again yesterday") == []
