"""License rules: the derived gate, anchors and window lose nothing; names, expressions and license sentences get their labels."""

from __future__ import annotations

import itertools
import re

from tapline.llm import license_rules as L


RULES = [(number, priority, label, re.compile(f"(?:{pattern}) ")) for number, (_, _, priority, label, pattern) in enumerate(L._unnumbered())]


def plain_labels(norm: str) -> set[str]:
    """Labels of every rule tried at every word, without gate, anchors or window, after suppression."""
    words = norm.split()
    found = []
    for number, priority, label, pattern in RULES:
        for i in range(len(words)):
            hit = pattern.match(" ".join(words[i:]) + " ")
            if hit:
                found.append((i, i + len(hit.group().split()), (priority, len(hit.group().split()), -number), label))
    return {label for s, e, rank, label in found if not any(a <= s and b >= e and r > rank and r[0] > L.EXPRESSION for a, b, r, _ in found)}


def labels_of(spark, texts: list[str]) -> list[set[str]]:
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [{m["label"] for m in r["found"]} for r in L.detections(df).orderBy("doc_id").collect()]


def test_every_name_alone_equals_the_ungated_rules(spark):
    names = sorted(set().union(*(itertools.islice(sorted(L.expansions(name)), 12) for _, name in L.NAMES)))
    texts = names + [f"{x} license" for x in names[::3]] + [f"licensed under the {x}" for x in names[::5]]
    for text, got in zip(texts, labels_of(spark, texts)):
        assert got == plain_labels(text), text


def test_names_that_a_gate_could_lose(spark):
    cases = {"MIT-0": {"mit-0"}, "MIT No Attribution": {"mit-0"}, "BSL 1.0": {"boost-1.0"}, "CC Attribution 4.0": {"cc-by"}, "GPL2": {"gpl-2.0"},
             "Apache2": {"apache-2.0"}, "GNU Free Documentation License 1.3": {"gfdl-1.3"}, "NCSA Open Source License": {"ncsa"},
             "Apache-2.0 OR MIT": {"apache-2.0", "mit"}, "MIT OR Apache-2.0": {"apache-2.0", "mit"}, "BSD-3-Clause AND Zlib": {"bsd-3-clause", "zlib"},
             "SPDX-License-Identifier: (MIT OR ISC)": {"mit", "isc"},
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this": {"mit"},
             "Redistribution and use in source and binary forms, with or without modification, are": {"bsd"},
             "we permit a zlib or a bsd course at mit": set(), "": set()}
    for (text, want), got in zip(cases.items(), labels_of(spark, list(cases))):
        assert got == want, (text, got)


def test_window_holds_the_longest_match_and_the_gate_every_key():
    for anchors, size, _, _, pattern in L._unnumbered():
        assert size <= L.WINDOW and all(len(a.split()) == 1 for a in anchors)
    for _, name in L.NAMES:
        for x in L.expansions(name):
            assert re.fullmatch(name, x) and re.search(L.GATE, x), x
    for _, _, sentence in L.SIGNATURES:
        for x in L.expansions(sentence):
            assert re.search(L.GATE, f"so {x} then"), x


def test_expansions():
    assert L.expansions("a(?: b|c)? ?[1-2][xy]?") == {a + b + s + n + t for a in "a" for b in ("", " b", "c") for s in ("", " ") for n in "12" for t in ("", "x", "y")}
