"""Licenses told by their texts, headers and addresses, and the cost of long lists."""

from __future__ import annotations

import random
import re
import time

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quaestor.llm import license_texts, licenses
from quaestor.llm.textops import blocks
from tests.llm.test_scans import detected, sample

MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so"""
MIT_REST = """, subject to the following conditions:

The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software."""
BSD_TWO = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
NO_NAME = """
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software"""
ADVERTS = """
3. All advertising materials mentioning features or use of this software must
   display the following acknowledgement: this product includes software"""
DISCLAIMER = "\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS \"AS IS\""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted"""
ISC_REST = """, provided that the above
copyright notice and this permission notice appear in all copies."""
ZLIB = """In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""
GPL = """This program is free software; you can redistribute it and/or modify it under
the terms of the GNU {}General Public License as published by the Free Software
Foundation; either version 2 of the License, or (at your option) any later version."""


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        (MIT_GRANT + MIT_REST, ["mit"]),
        (MIT_GRANT + '.\n\nTHE SOFTWARE IS PROVIDED "AS IS"', ["mit-0"]),
        (BSD_TWO + DISCLAIMER, ["bsd-2-clause"]),
        (BSD_TWO + NO_NAME + DISCLAIMER, ["bsd-3-clause"]),
        (BSD_TWO + ADVERTS + DISCLAIMER, ["bsd-4-clause"]),
        (ISC + ISC_REST, ["isc"]),
        (ISC + '.\n\nTHE SOFTWARE IS PROVIDED "AS IS"', ["0bsd"]),
        (ZLIB, ["zlib", "zlib"]),
        ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ["cc0"]),
        (
            'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file'
            " except in compliance with the License. You may obtain a copy at\n\n    http://www.apache.org/licenses/LICENSE-2.0",
            ["apache", "apache"],
        ),
        (GPL.format(""), ["gpl"]),
        (GPL.format("Lesser "), ["lgpl"]),
        (GPL.format("Affero "), ["agpl"]),
        ("see https://creativecommons.org/licenses/by-nc-sa/4.0/", ["cc-by-nc-sa"]),
        ("at http://www.gnu.org/copyleft/lesser.html", ["lgpl"]),
        ("Permission is hereby granted to enter the building.", []),
        ("Redistribution of wealth and use in binary forms", []),
    ],
)
def test_texts_without_a_name(text, labels):
    got, every = detected(text)
    assert [label for _, _, label in got] == labels
    assert [d[:3] for d in every] == got


def test_gates_of_written_rules_lose_nothing():
    rng = random.Random(5)
    table = (*license_texts.BODIES, *license_texts.LINKS)
    assert len(table) == len(licenses.written_rules()) > 100
    for (label, text, _), rule in zip(table, licenses.written_rules()):
        plain = text.replace(" ... ", " between ").replace("[^ ]+", "open").replace(r"\w", "3")
        plain = re.sub(r"\(\?![^)]*\)", "", plain)
        for _ in range(4):
            some = sample(plain, rng)
            assert rule.pattern.search(" " + some), some
            got, every = detected(some)
            assert got == [d[:3] for d in every], some
            assert got, some


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(1, 6)), max_size=30))
def test_suppression_against_all_pairs(spans):
    kept, fast = [], licenses.Intervals()
    for start, length in spans:
        inside = any(a <= start and start + length <= b for a, b in kept)
        assert fast.add(start, start + length) != inside
        if not inside:
            kept.append((start, start + length))
    assert fast.starts == sorted(fast.starts) and fast.ends == sorted(fast.ends)


@pytest.mark.parametrize("unit", ["the mit license and ", "apache license mit license bsd license ", ISC + " "])
def test_long_lists_take_linear_time(unit):
    def taken(times):
        (block,) = blocks(pa.array([unit * times]))
        data = licenses.LOWER[block.data]
        starts, ends, document = block.runs(licenses.WORD[data])
        scan = licenses.scanner()
        held = scan.keywords(licenses.hash_runs(data, starts, ends), document, 1)[0]
        begin = time.perf_counter()
        assert len(scan.detect(data.tobytes(), held)) >= times
        return time.perf_counter() - begin

    small = taken(4000)
    assert taken(32000) < 8 * 2.5 * small + 1
