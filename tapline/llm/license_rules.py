"""License detection by ordered signature rules, in DataFrame functions only.

A text is normalised to words (runs of digits, a-z and non-ASCII characters,
A-Z lower-cased) parted by single spaces.  A rule is a hand-written regular
expression over the normalised words that begins at one of its anchor words.

1. Keyword prefilter: every match of a rule holds a name or a signature as whole
   words, so texts without any of those (``GATE``) go no further.  In the others
   only positions that hold an anchor word, the first word of a rule, are looked
   at.  Gate, anchors and ``WINDOW`` are derived from the rules themselves.
2. At an anchor, the rules of that word are matched against the next
   ``WINDOW`` words, the longest match there is; a match is an interval of word
   positions.
3. A match whose interval is contained in that of a match with a higher rank
   (priority, then length, then rule order) is suppressed; expressions suppress
   none.

All of this happens inside the row: no shuffle, no join, no Python.  As a match
spans at most ``WINDOW`` words, only that many neighbours can contain it, so
the work is linear in the length of a text.

Names that are ordinary words (``WEAK``) count with the word license behind
them, after a phrase such as "licensed under", or beside another identifier in
an expression ("Apache-2.0 OR MIT").  Signatures are sentences of the license
texts themselves.

The base phrases (``BASE``) are counted apart and their labels always stay.

Rows: null text counts as empty (0 words, no labels, score 0); repeated rows
and null ids are scanned like any others; only the two named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Fixed values: (label, regular expression of the name in normalised words).  Only words, (?:a|b), x? and [..] are used.
NAMES = (
    ("mit", r"mit|expat|x11"),
    ("mit-0", r"mit 0|mit no attribution"),
    ("apache-2.0", r"apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("apache-1.1", r"apache(?: software)?(?: license)?(?: version| v)? ?1 1"),
    ("gpl-2.0", r"(?:gnu )?(?:general public license|gpl)(?: version| v| gplv2| 2)? ?2(?: 0)?|gplv2"),
    ("gpl-3.0", r"(?:gnu )?(?:general public license|gpl)(?: version| v)? ?3(?: 0)?|gplv3"),
    ("gpl", r"(?:gnu )?general public license|gnu gpl|gpl"),
    ("lgpl-2.1", r"(?:gnu )?(?:lesser|library) general public license(?: version| v)? ?2(?: [01])?|lgpl(?:v2| 2)(?: 1)?|lgplv2 1"),
    ("lgpl-3.0", r"(?:gnu )?lesser general public license(?: version| v)? ?3(?: 0)?|lgplv3|lgpl 3(?: 0)?"),
    ("lgpl", r"(?:gnu )?lesser general public license|(?:gnu )?lgpl"),
    ("agpl-3.0", r"(?:gnu )?affero general public license(?:(?: version| v)? ?3(?: 0)?)?|agplv3|agpl(?: 3(?: 0)?)?"),
    ("bsd-2-clause", r"bsd 2 clause|2 clause bsd|simplified bsd|freebsd"),
    ("bsd-3-clause", r"bsd 3 clause|3 clause bsd|new bsd|modified bsd"),
    ("bsd-4-clause", r"bsd 4 clause|4 clause bsd|original bsd"),
    ("bsd", r"bsd(?: style)?"),
    ("mpl-2.0", r"mozilla public license(?: version| v)? ?2(?: 0)?|mpl(?: v)? ?2(?: 0)?"),
    ("mpl-1.1", r"mozilla public license(?: version| v)? ?1 1|mpl(?: v)? ?1 1"),
    ("mpl", r"mozilla public license|mpl"),
    ("epl-2.0", r"eclipse public license(?: version| v)? ?2(?: 0)?|epl(?: v)? ?2(?: 0)?"),
    ("epl-1.0", r"eclipse public license(?: version| v)? ?1(?: 0)?|epl(?: v)? ?1(?: 0)?"),
    ("cddl-1.0", r"common development and distribution license(?:(?: version| v)? ?1(?: [01])?)?|cddl(?: 1(?: [01])?)?"),
    ("cpl-1.0", r"common public license(?:(?: version| v)? ?1(?: 0)?)?"),
    ("eupl-1.2", r"european union public licen[cs]e(?:(?: version| v)? ?1 [12])?|eupl(?: 1 [12])?"),
    ("isc", r"isc"),
    ("zlib", r"zlib(?: libpng)?"),
    ("unlicense", r"unlicense"),
    ("wtfpl", r"wtfpl|do what the fuck you want to public license"),
    ("artistic-2.0", r"artistic license(?: version| v)? ?2(?: 0)?"),
    ("artistic-1.0", r"artistic license(?:(?: version| v)? ?1(?: 0)?)?|perl artistic"),
    ("boost-1.0", r"boost software license(?:(?: version| v)? ?1(?: 0)?)?|bsl 1 0"),
    ("busl-1.1", r"business source license(?:(?: version| v)? ?1 1)?|busl(?: 1 1)?"),
    ("sspl-1.0", r"server side public license(?:(?: version| v)? ?1(?: 0)?)?|sspl"),
    ("elastic-2.0", r"elastic license(?:(?: version| v)? ?2(?: 0)?)?"),
    ("psf-2.0", r"python software foundation license|psf license(?: agreement)?|python license"),
    ("php-3.01", r"php license(?:(?: version| v)? ?3(?: 01)?)?"),
    ("ruby", r"ruby license"),
    ("openssl", r"openssl(?: license)?"),
    ("ofl-1.1", r"(?:sil )?open font license(?:(?: version| v)? ?1 [01])?|ofl(?: 1 [01])?"),
    ("odbl-1.0", r"open database license(?:(?: version| v)? ?1(?: 0)?)?|odbl"),
    ("cc0-1.0", r"cc0(?: 1 0)?|creative commons zero(?:(?: version| v)? ?1(?: 0)?)?|cc zero"),
    ("cc-by-nc-nd", r"(?:cc|creative commons) (?:by nc nd|attribution noncommercial noderivatives|attribution non commercial no derivatives)(?: [1-4] [05])?"),
    ("cc-by-nc-sa", r"(?:cc|creative commons) (?:by nc sa|attribution noncommercial sharealike|attribution non commercial share alike)(?: [1-4] [05])?"),
    ("cc-by-nc", r"(?:cc|creative commons) (?:by nc|attribution noncommercial|attribution non commercial)(?: [1-4] [05])?"),
    ("cc-by-nd", r"(?:cc|creative commons) (?:by nd|attribution noderivatives|attribution no derivatives)(?: [1-4] [05])?"),
    ("cc-by-sa", r"(?:cc|creative commons) (?:by sa|attribution sharealike|attribution share alike)(?: [1-4] [05])?"),
    ("cc-by", r"(?:cc|creative commons) (?:by|attribution)(?: [1-4] [05])?"),
    ("public-domain", r"public domain(?: dedication)?"),
    ("proprietary", r"all rights reserved|proprietary and confidential"),
    ("gfdl-1.3", r"gnu free documentation license(?:(?: version| v)? ?1 [1-3])?|gfdl(?: ?1 [1-3])?"),
    ("ncsa", r"ncsa open source license|university of illinois ncsa|uiuc license"),
    ("0bsd", r"0bsd|zero clause bsd|bsd zero clause|bsd 0 clause"),
    ("afl-3.0", r"academic free license(?:(?: version| v)? ?[1-3] [01])?|afl 3 0"),
    ("osl-3.0", r"open software license(?:(?: version| v)? ?[1-3] [01])?|osl 3 0"),
    ("ecl-2.0", r"educational community license(?:(?: version| v)? ?2 0)?|ecl 2 0"),
    ("ms-pl", r"microsoft public license|ms pl"),
    ("ms-rl", r"microsoft reciprocal license|ms rl"),
    ("upl-1.0", r"universal permissive license(?:(?: version| v)? ?1 0)?|upl 1 0"),
    ("postgresql", r"postgresql licen[cs]e"),
    ("mulan-psl-2.0", r"mulan permissive software license(?:(?: version| v)? ?2)?|mulanpsl 2 0"),
    ("cecill-2.1", r"cecill(?: free software license agreement)?(?: ?2 [01])?"),
    ("lppl-1.3c", r"latex project public license(?:(?: version| v)? ?1 [0-3]c?)?|lppl(?: 1 [0-3]c?)?"),
    ("apsl-2.0", r"apple public source license(?:(?: version| v)? ?[12] [0-2])?|apsl 2 0"),
    ("w3c", r"w3c software(?: notice and)? license|w3c software and document (?:notice and )?license"),
    ("vim", r"vim license"),
    ("curl", r"curl license"),
    ("json", r"json license"),
    ("beerware", r"beer ?ware license"),
    ("blueoak-1.0.0", r"blue oak model license(?: 1 0 0)?|blueoak 1 0 0"),
    ("hippocratic-2.1", r"hippocratic license(?: ?2 1)?"),
    ("commons-clause", r"commons clause"),
    ("openrail", r"openrail(?: ?m)?|open rail m|responsible ai license"),
    ("sleepycat", r"sleepycat license"),
    ("qpl-1.0", r"q public license|qpl 1 0"),
    ("ntp", r"ntp license"),
    ("python-2.0", r"python 2 0 license"),
)

#: Fixed values: (priority, phrase around a name); {} is the name.
PHRASES = (
    (100, r"spdx license identifier (?:{})(?: or later| only)?"),
    (90, r"licensed under (?:the terms of )?(?:the |an? )?(?:{})(?: licen[cs]e)?(?: or later| or any later version)?"),
    (85, r"released (?:under|into) (?:the terms of )?(?:the |an? )?(?:{})(?: licen[cs]e)?"),
    (85, r"distributed under (?:the terms of )?(?:the |an? )?(?:{})(?: licen[cs]e)?"),
    (80, r"(?:available|provided|published) under (?:the terms of )?(?:the |an? )?(?:{})(?: licen[cs]e)?"),
    (80, r"(?:covered by|subject to|governed by) (?:the terms of )?(?:the |an? )?(?:{})(?: licen[cs]e)?"),
)
#: Names that are no license without the word license (or dedication) behind them.
WEAK = frozenset({"mit", "bsd", "isc", "zlib", "openssl", "artistic-1.0", "public-domain"})

#: Fixed values: (priority, label, sentence of the license text in normalised words).
SIGNATURES = (
    (95, "mit", r"permission is hereby granted free of charge to any person obtaining a copy"),
    (95, "boost-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    (95, "bsd", r"redistribution and use in source and binary forms with or without modification"),
    (96, "bsd-3-clause", r"neither the name of the copyright holder nor the names of its contributors may be used"),
    (96, "bsd-4-clause", r"all advertising materials mentioning features or use of this software must display"),
    (95, "isc", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    (95, "apache-2.0", r"you may not use this file except in compliance with the license"),
    (95, "gpl", r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    (95, "lgpl", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    (95, "agpl-3.0", r"you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    (95, "mpl-2.0", r"this source code form is subject to the terms of the mozilla public license"),
    (95, "zlib", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    (95, "unlicense", r"this is free and unencumbered software released into the public domain"),
    (95, "wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    (95, "cc0-1.0", r"waived all copyright and related or neighboring rights"),
    (95, "gfdl-1.3", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    (95, "beerware", r"you can buy me a beer in return"),
    (95, "postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee"),
)

#: Identifiers that stand beside a weak name in an expression.
IDENTIFIERS = r"mit|isc|zlib|bsd [2-4] clause|apache 2 0|mpl [12] [01]|epl [12] 0|[al]?gpl [23] [01](?: only| or later)?|cc0 1 0|unlicense|bsl 1 0|0bsd"
#: Priority of expressions, the lowest; a match of this priority suppresses none, as both names of an expression count.
EXPRESSION = 40


def expansions(pattern: str) -> set[str]:
    """All strings a pattern of words, (?:a|b), x? and [..] stands for."""

    def branch(i: int) -> tuple[set[str], int]:
        done, run = set(), {""}
        while i < len(pattern) and pattern[i] != ")":
            if pattern[i] == "|":
                done, run, i = done | run, {""}, i + 1
                continue
            if pattern.startswith("(?:", i):
                items, i = branch(i + 3)
                i += 1
            elif pattern[i] == "[":
                end = pattern.index("]", i)
                inner = pattern[i + 1:end]
                items = {chr(c) for c in range(ord(inner[0]), ord(inner[2]) + 1)} if inner[1:2] == "-" else set(inner)
                i = end + 1
            else:
                items, i = {pattern[i]}, i + 1
            if pattern[i:i + 1] == "?":
                items, i = items | {""}, i + 1
            run = {a + b for a in run for b in items}
        return done | run, i

    return branch(0)[0]


def _reach(pattern: str) -> tuple[set[str], int]:
    """(first words, most words) of a pattern."""
    parts = [x.split() for x in expansions(pattern)]
    return {x[0] for x in parts}, max(map(len, parts))


def _unnumbered() -> list[tuple[set[str], int, int, str, str]]:
    """(anchor words, most words, priority, label, pattern) of every rule, in rule order."""
    around = [(priority, phrase, *_reach(phrase.replace("{}", "x"))) for priority, phrase in PHRASES]
    beside, beside_size = _reach(IDENTIFIERS)
    out = []
    for label, name in NAMES:
        first, size = _reach(name)
        for priority, phrase, anchors, words in around:
            out.append((anchors, words - 1 + size, priority, label, phrase.replace("{}", name)))
        weak = label in WEAK and label != "public-domain"
        out.append((first, size + weak, 50, label, f"(?:{name})" + " licen[cs]e" * weak))
        if weak:
            out.append((beside, beside_size + 1 + size, EXPRESSION, label, f"(?:{IDENTIFIERS}) (?:or|and) (?:{name})"))
            out.append((first, beside_size + 1 + size, EXPRESSION, label, f"(?:{name}) (?:or|and) (?:{IDENTIFIERS})"))
        else:
            out.append((first, size + 1, 60, label, f"(?:{name}) licen[cs]e"))
    for priority, label, sentence in SIGNATURES:
        out.append((*_reach(sentence), priority, label, sentence))
    return out


def rules() -> list[tuple[str, int, int, str, str]]:
    """(anchor word, rule number, priority, label, regular expression), in rule order; an anchored rule ends at a word's end."""
    return [(anchor, number, priority, label, f"^(?:{pattern}) ")
            for number, (anchors, _, priority, label, pattern) in enumerate(_unnumbered()) for anchor in sorted(anchors)]


def _factored(keys: set[str]) -> str:
    """One expression for a set of literals that shares their beginnings."""
    by: dict[str, set[str]] = {}
    for key in keys:
        by.setdefault(key[:1], set()).add(key[1:])
    parts = [c + _factored(rest) for c, rest in sorted(by.items()) if c]
    if not parts:
        return ""
    body = parts[0] if len(parts) == 1 and "" not in by else f"(?:{'|'.join(parts)})"
    return body + "?" * ("" in by)


def _gate() -> str:
    """Expression that finds, as whole words, one of the shortest names or signatures that every match holds."""
    keys = set().union(*(expansions(name) for _, name in NAMES), *(expansions(x) for _, _, x in SIGNATURES))

    def inner(key: str) -> set[str]:
        words = key.split()
        return {" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)} - {key}

    return f"(?:^| ){_factored({k for k in keys if not inner(k) & keys})}(?: |$)"


#: Longest match in words; with the most rules that share an anchor it bounds a match's neighbours.
WINDOW = max(size for _, size, *_ in _unnumbered())
GATE = _gate()


UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normalised(text: Column) -> Column:
    """Words parted by single spaces; empty for null."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, SMALL), NOT_WORD, " "))


def _bytes(text: Column) -> Column:
    return F.octet_length(text)


def _spaces(text: Column) -> Column:
    return _bytes(text) - _bytes(F.replace(text, F.lit(" "), F.lit("")))


def base_columns(norm: Column, wide: Column, n_words: Column) -> dict[str, Column]:
    """Counts and first and last starts of the base phrases; ``wide`` has two spaces between words and one at either end."""
    count, first, last, labels = F.lit(0), [], [], []
    gate = norm.contains("license")
    for phrase, label in BASE:
        size = phrase.count(" ") + 1
        pattern = " " + phrase.replace(" ", "  ") + " "
        n = F.when(gate, ((_bytes(wide) - _bytes(F.replace(wide, F.lit(pattern), F.lit("")))) / len(pattern)).cast("long")).otherwise(F.lit(0))
        found = gate & wide.contains(pattern)
        count = count + n
        first.append(F.when(found, (_spaces(F.substring_index(wide, pattern, 1)) / 2).cast("long")))
        last.append(F.when(found, n_words - size - (_spaces(F.substring_index(wide, pattern, -1)) / 2).cast("long")))
        labels.append(F.when(found, F.lit(label)))
    return {"n_base": count.cast("long"), "first_word": F.least(*first), "last_word": F.greatest(*last),
            "_base": F.array_compact(F.array(*labels))}


def anchors() -> dict[str, list[tuple[int, int, str, str]]]:
    """(rule number, priority, label, regular expression) by anchor word."""
    by: dict[str, list] = {}
    for anchor, *rule in rules():
        by.setdefault(anchor, []).append(tuple(rule))
    return by


def _rule_map() -> Column:
    """The literal map anchor -> array of rules."""
    quote = lambda s: "'" + s.replace("'", "\\'") + "'"
    entries = ", ".join(
        f"{quote(a)}, array(" + ", ".join(f"named_struct('no', {n}, 'priority', {p}, 'label', {quote(label)}, 'pattern', {quote(x)})"
                                          for n, p, label, x in rs) + ")" for a, rs in anchors().items())
    return F.expr(f"map({entries})")


def _matches(words: Column) -> Column:
    """Matches of all rules at the anchor words: array of (start, end, rank, no, label), by start."""
    table = _rule_map()
    at = F.filter(F.transform(words, lambda w, i: F.when(w.isin(list(anchors())), i).otherwise(F.lit(-1))), lambda i: i >= 0)

    def here(i: Column) -> Column:
        window = F.concat(F.array_join(F.slice(words, i + 1, WINDOW), " "), F.lit(" "))

        def one(r: Column) -> Column:
            n = _spaces(F.call_function("regexp_extract", window, r["pattern"], F.lit(0)))
            return F.struct(i.alias("start"), (i + n).alias("end"), r["priority"].alias("priority"), n.alias("n"), (-r["no"]).alias("order"),
                            r["label"].alias("label"))

        return F.filter(F.transform(F.element_at(table, F.element_at(words, i + 1)), one), lambda m: m["n"] > 0)

    return F.flatten(F.transform(at, here))


def _kept(matches: Column) -> Column:
    """Matches that no higher-ranked match contains."""
    reach = WINDOW * max(map(len, anchors().values()))
    rank = lambda m: F.struct(m["priority"], m["n"], m["order"])

    def alone(m: Column, i: Column) -> Column:
        near = F.slice(matches, F.greatest(i + 1 - reach, F.lit(1)), F.lit(2 * reach))
        return F.exists(near, lambda e: (e["start"] <= m["start"]) & (e["end"] >= m["end"]) & (rank(e) > rank(m)) & (e["priority"] > EXPRESSION))

    flagged = F.transform(matches, lambda m, i: F.struct(m.alias("m"), alone(m, i).alias("inside")))
    return F.transform(F.filter(flagged, lambda x: ~x["inside"]), lambda x: x["m"])


def detections(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: n_words, the base columns, and ``found``: array of (start, end, priority, n, order, label)."""
    df = docs.select(F.col(id_column).alias("doc_id"), normalised(F.col(text_column)).alias("_norm"))
    norm = F.col("_norm")
    n_words = F.when(norm == "", F.lit(0)).otherwise(_spaces(norm) + 1).cast("long")
    wide = F.concat(F.lit(" "), F.replace(norm, F.lit(" "), F.lit("  ")), F.lit(" "))
    df = df.select("doc_id", "_norm", n_words.alias("n_words"), F.when(norm.contains("license"), wide).otherwise(F.lit("")).alias("_wide"),
                   F.when(norm.rlike(GATE), F.split(norm, " ")).otherwise(F.array().cast("array<string>")).alias("_words"))
    base = base_columns(norm, F.col("_wide"), F.col("n_words"))
    df = df.select("doc_id", "n_words", *[c.alias(n) for n, c in base.items()], _matches(F.col("_words")).alias("_all"))
    return df.select("doc_id", "n_words", "n_base", "first_word", "last_word", "_base",
                     F.when(F.size("_all") > 0, _kept(F.col("_all"))).otherwise(F.col("_all")).alias("found"))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Digest: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is the highest priority of a match over 100, at least 0.6 where a base phrase stands, else 0.
    """
    found = detections(docs, id_column, text_column)
    labels = F.array_sort(F.array_distinct(F.concat(F.col("_base"), F.transform(F.col("found"), lambda m: m["label"]))))
    best = F.coalesce(F.array_max(F.transform(F.col("found"), lambda m: m["priority"])), F.lit(0)) / 100.0
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                        F.array_join(F.array_sort("_base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
                        F.greatest(best, F.when(F.col("n_base") > 0, F.lit(0.6)).otherwise(F.lit(0.0))).alias("score"))
