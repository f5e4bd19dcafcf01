"""License scans: ordered signature rules behind a keyword prefilter.

A text is reduced to lower-case words with single spaces. A rule is a pattern
of words, written by hand, with the words that must stand before it where its
own words would say too little (a bare ``EPL 2.0`` is also a score). Each rule
has gate words, its rarest: only texts that hold some gate word are looked at.
In those a rule is tried where its key word stands, on a window of words to
both sides. Of the detections that begin at one word the best counts (highest
priority, then longest, then by label), and one that lies within another, or
around it, is suppressed if the other is better. All of it is built-in
expressions over one row: no shuffle, no Python.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common as C

#: What separates words once A-Z is lower case.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Words that say little: a rule is not looked up by them if it has another one.
COMMON = frozenset(
    "a above all and any are as be but by can code copies copy document documentation file for forms free from general granted held his if in including is it its license licence licensed licenced made "
    "may mit modified modify must name names new nor not notice of on open or original old permission permitted person program provided public purpose released software source terms text that the their "
    "this to use under university version versions with without work you".split()
)

# Named licenses: label, name, short name, versions, and whether the short name with a version needs more around it.
_NAMED = (
    ("gpl", "gnu general public license|licence", "gpl", ("1", "2", "3"), False),
    ("lgpl", "gnu lesser|library general public license|licence", "lgpl", ("2", "2 1", "3"), False),
    ("agpl", "gnu affero general public license|licence", "agpl", ("1", "3"), False),
    ("gfdl", "gnu free documentation license|licence", "gfdl", ("1 1", "1 2", "1 3"), False),
    ("apache", "apache [software] license|licence", "apache", ("1 0", "1 1", "2 0"), True),
    ("mpl", "mozilla public license|licence", "mpl", ("1 0", "1 1", "2 0"), True),
    ("epl", "eclipse public license|licence", "epl", ("1 0", "2 0"), True),
    ("cddl", "common development and distribution license|licence", "cddl", ("1 0", "1 1"), False),
    ("eupl", "european union public license|licence", "eupl", ("1 0", "1 1", "1 2"), False),
    ("artistic", "artistic license|licence", "artistic", ("1 0", "2 0"), True),
    ("bsl", "boost software license|licence", "bsl", ("1 0",), True),
    ("afl", "academic free license|licence", "afl", ("2 1", "3 0"), True),
    ("osl", "open software license|licence", "osl", ("1 0", "2 1", "3 0"), True),
    ("apsl", "apple public source license|licence", "apsl", ("1 0", "2 0"), True),
    ("ofl", "sil open font license|licence", "ofl", ("1 0", "1 1"), True),
    ("ecl", "educational community license|licence", "ecl", ("1 0", "2 0"), True),
    ("ms-pl", "microsoft public license|licence", "mspl", ("1 0",), True),
    ("zpl", "zope public license|licence", "zpl", ("1 1", "2 0", "2 1"), True),
    ("lppl", "latex project public license|licence", "lppl", ("1 0", "1 2", "1 3"), False),
    ("upl", "universal permissive license|licence", "upl", ("1 0",), True),
    ("sspl", "server side public license|licence", "sspl", ("1",), False),
    ("busl", "business source license|licence", "busl", ("1 1",), True),
    ("odbl", "open [data] [commons] [open] database license|licence", "odbl", ("1 0",), False),
    ("psf", "python software foundation license|licence", "psf", ("2",), True),
    ("wtfpl", "do what the fuck you want to public license|licence", "wtfpl", ("1", "2"), False),
    ("mit", "mit|expat license|licence", "mit", (), True),
    ("isc", "isc license|licence", "isc", (), True),
    ("zlib", "zlib license|licence", "zlib", (), True),
    ("ncsa", "university of illinois ncsa open source license|licence", "ncsa", (), True),
    ("unlicense", "unlicense", "unlicense", (), True),
    ("bsd-2-clause", "2|two clause bsd license|licence", "bsd 2 clause", (), True),
    ("bsd-2-clause", "simplified|freebsd bsd license|licence", "freebsd", (), True),
    ("bsd-3-clause", "3|three clause bsd license|licence", "bsd 3 clause", (), True),
    ("bsd-3-clause", "modified|revised|new bsd license|licence", "new bsd", (), True),
    ("bsd-4-clause", "4|four clause bsd license|licence", "bsd 4 clause", (), True),
    ("bsd-4-clause", "original|old bsd license|licence", "original bsd", (), True),
    ("bsd", "bsd [style] license|licence", "bsd", (), True),
)

# Notices known by their wording: label, priority and words.
_WORDED = (
    ("mit", 70, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 65, "the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", 55, "the software is provided as is without warranty of any kind express or implied"),
    ("bsl-1.0", 75, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("isc", 70, "permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted"),
    ("hpnd", 68, "permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("bsd", 70, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 66, "redistributions of source code must retain the above copyright notice"),
    ("bsd", 66, "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", 62, "this software is provided by the copyright holders and contributors as is"),
    ("bsd", 62, "this software is provided by the author|regents <3> as is and any express or implied warranties"),
    ("bsd-3-clause", 72, "neither the name of <12> nor the names of its|his|her|their contributors"),
    ("bsd-4-clause", 72, "all advertising materials mentioning features or use of this software must display"),
    ("unlicense", 75, "this is free and unencumbered software released into the public domain"),
    ("unlicense", 70, "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("zlib", 70, "permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("zlib", 66, "altered source versions must be plainly marked as such"),
    ("zlib", 60, "this software is provided as is without any express or implied warranty"),
    ("gpl", 70, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", 64, "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", 64, "you should have received a copy of the gnu general public license"),
    ("lgpl", 70, "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser|library general public license"),
    ("lgpl", 64, "this library is distributed in the hope that it will be useful but without any warranty"),
    ("lgpl", 64, "you should have received a copy of the gnu lesser|library general public license"),
    ("agpl", 64, "you should have received a copy of the gnu affero general public license"),
    ("gnu-or-later", 60, "either version <2> of the license or at your option any later version"),
    ("gnu-text", 60, "everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("gnu-all-permissive", 70, "copying and distribution of this file with or without modification are permitted in any medium"),
    ("wtfpl", 75, "everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("apache", 70, "you may not use this file except in compliance with the license"),
    ("apache", 66, "unless required by applicable law or agreed to in writing software distributed under the license"),
    ("apache", 66, "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("mpl-2.0", 85, "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", 75, "if a copy of the mpl was not distributed with this file"),
    ("mpl-1.1", 80, "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl", 70, "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", 70, "the contents of this file are subject to the terms of the common development and distribution license"),
    ("ofl", 70, "this font software is licensed under the sil open font license"),
    ("psf", 70, "this license agreement is between the python software foundation"),
    ("cc0-1.0", 70, "has dedicated the work to the public domain by waiving all of his or her rights"),
    ("cc", 58, "this work is licensed under a creative commons"),
    ("public-domain", 60, "released in|into|to the public domain"),
    ("public-domain", 60, "dedicated to the public domain"),
    ("public-domain", 60, "this work is in the public domain"),
    ("proprietary", 50, "all rights reserved"),
    ("proprietary", 50, "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", 50, "confidential and proprietary"),
)

# Addresses of licenses, as words.
_ADDRESSES = (
    ("apache-2.0", "apache org licenses license 2 0"),
    ("gpl-2", "gnu org licenses gpl 2 0"),
    ("gpl-2", "gnu org licenses old licenses gpl 2 0"),
    ("gpl-3", "gnu org licenses gpl 3 0"),
    ("lgpl-2.1", "gnu org licenses lgpl 2 1"),
    ("lgpl-3", "gnu org licenses lgpl 3 0"),
    ("agpl-3", "gnu org licenses agpl 3 0"),
    ("gfdl", "gnu org licenses fdl"),
    ("mit", "opensource org licenses mit"),
    ("bsd-2-clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "opensource org licenses bsd 3 clause"),
    ("isc", "opensource org licenses isc"),
    ("mpl-2.0", "mozilla org mpl 2 0"),
    ("mpl-2.0", "mozilla org en us mpl 2 0"),
    ("epl-2.0", "eclipse org legal epl 2 0"),
    ("bsl-1.0", "boost org license 1 0"),
    ("unlicense", "unlicense org"),
    ("cc0-1.0", "creativecommons org publicdomain zero 1 0"),
)

_EXCEPTIONS = ("classpath", "autoconf", "bison", "gcc", "llvm", "font", "linux syscall note", "openssl")
_CC = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
_CC_NAMES = {"by": "attribution", "sa": "sharealike", "nc": "noncommercial", "nd": "noderivs|noderivatives"}
_CC_SPLIT = {"by": "attribution", "sa": "share alike", "nc": "non commercial", "nd": "no derivs|derivatives"}
_CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
WINDOW = 26
CONTEXT = 24
_GRANTED = ("licensed", "licenced", "license", "licence", "licensing", "released", "distributed", "available", "published", "provided")
#: What stands before a short name that is meant as a license.
_BEFORE = rf"(?:^| )(?:{'|'.join(_GRANTED)})(?: (?:under|is|are))?(?: the)?(?: terms of)?(?: the)?(?: gnu)?$"


#: Says of a rule that it holds for a later part of an SPDX expression, however long that is.
PART = "part of an expression"
_TAG = "spdx license identifier"
#: What an expression may be made of besides numbers.
EXPRESSION = tuple(sorted({w for _, _, short, _, _ in _NAMED for w in re.findall(r"\w+", short)} | {"cc", "by", "sa", "nc", "nd", "cc0", "exception", "later", "only", "or", "and", "with", "clause"} | {w for x in _EXCEPTIONS for w in x.split()}))


@dataclass(frozen=True)
class Rule:
    """``pattern`` over single-spaced words; its word number ``back`` is one of ``keys``.

    A text must hold one of ``gates``; ``before``, where not empty, must be
    found in the words before the match, or is ``PART``.
    """

    keys: tuple[str, ...]
    back: int
    pattern: str
    label: str
    priority: int
    gates: tuple[str, ...]
    before: str = ""


def _items(words: str) -> list[str]:
    """The items of a pattern: a word, alternatives of one, ``[words that may be missing]`` or ``<up to n words>``."""
    return re.findall(r"\[[^\]]*\]|<\d+>|\S+", words)


def _regex(words: str) -> str:
    out = []
    for k, item in enumerate(_items(words)):
        gap = " " if k else ""
        if item.startswith("["):
            out.append("(?:" + "".join(f"{gap}(?:{w})" for w in item[1:-1].split()) + ")?")
        elif item.startswith("<"):
            out.append(rf"(?:{gap}\S+){{0,{item[1:-1]}}}")
        else:
            out.append(f"{gap}(?:{item})")
    return "".join(out)


def rule(label: str, priority: int, words: str, before: str = "", gates: tuple[str, ...] = ()) -> Rule:
    """A rule looked up by its rarest word among those at a fixed place: the longest that is not common, else the longest."""
    fixed: list[str] = []
    for item in _items(words):
        if item[0] in "[<":
            break
        fixed.append(item)
    rare = [k for k, item in enumerate(fixed) if not any(w in COMMON or w.isdigit() for w in item.split("|"))]
    back = max(rare or range(len(fixed)), key=lambda k: len(fixed[k].split("|")[0]))
    keys = tuple(fixed[back].split("|"))
    return Rule(keys, back, f"^{_regex(words)}(?= |$)", label, priority, gates or keys, before)


def _dash(label: str, version: str) -> str:
    return f"{label}-{version.replace(' ', '.')}"


def _number(version: str) -> str:
    """A version in words; whole numbers may be followed by a nought."""
    first, *rest = version.split()
    return f"v{first}|{first} {' '.join(rest)}" if rest else f"v{first}|{first} [0]"


def rules() -> tuple[Rule, ...]:
    """All rules in order: highest priority first."""
    later = "[or] [any] [later|only] [version]"
    out: list[Rule] = []

    def declared(label: str, words: str) -> None:
        """An identifier after the SPDX tag, alone or as a part of an expression."""
        out.append(rule(label, 95, f"spdx license identifier {words}"))
        out.append(rule(label, 94, words, PART, ("spdx",)))

    for label, name, short, versions, vague in _NAMED:
        out.append(rule(label, 60, name))
        if short != name:
            out.append(rule(label, 58, short, _BEFORE, _GRANTED))
            out.append(rule(label, 58, f"{short} license|licence|licensed"))
        for v in versions:
            out.append(rule(_dash(label, v), 80, f"{name} [version|v|ver] {_number(v)} {later}"))
            numbered = f"{short} [version|v|ver] {_number(v)} {later}"
            out.append(rule(_dash(label, v), 75, numbered, _BEFORE if vague else "", _GRANTED if vague else ()))
            if vague:
                out.append(rule(_dash(label, v), 75, f"{short} [version|v|ver] {_number(v)} license|licence"))
            out.append(rule(_dash(label, v), 75, f"{short}v{v}"))
            declared(_dash(label, v), f"{short} {_number(v)} {later}")
        if not versions:
            declared(label, short)
    for kind in _CC:
        label = "cc-" + kind.replace(" ", "-")
        for names in (_CC_NAMES, _CC_SPLIT) if " " in kind else (_CC_NAMES,):
            name = " ".join(names[x] for x in kind.split())
            out.append(rule(label, 60, f"creative commons {name}"))
            out += [rule(_dash(label, v), 80, f"creative commons {name} {v} [international|unported|generic]") for v in _CC_VERSIONS]
        out.append(rule(label, 55, f"cc {kind}"))
        for v in _CC_VERSIONS:
            out.append(rule(_dash(label, v), 75, f"cc {kind} {v}"))
            out.append(rule(_dash(label, v), 85, f"creativecommons org licenses {kind} {v}"))
            declared(_dash(label, v), f"cc {kind} {v}")
    for words in ("cc0 [1] [0] [universal]", "cc zero", "creative commons zero"):
        out.append(rule("cc0-1.0", 80, words))
    declared("cc0-1.0", "cc0 1 0")
    for name in _EXCEPTIONS:
        out.append(rule(name.replace(" ", "-") + "-exception", 93, f"{name} [exception]", PART, ("spdx",)))
    out += [rule(label, 85, words) for label, words in _ADDRESSES]
    out += [rule(label, priority, words) for label, priority, words in _WORDED]
    return tuple(sorted(set(out), key=lambda r: (-r.priority, r.label, r.pattern)))


RULES = rules()
KEYWORDS = tuple(sorted({g for r in RULES for g in r.gates}))
KEYS = tuple(sorted({k for r in RULES for k in r.keys}))


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _expressions(trimmed: Column) -> Column:
    """``struct(first, end)`` of every SPDX expression of a text: its first word, and the word after its last.

    The text is cut at the tags; how many words stand before a piece is summed up
    along the pieces, and the expression is as long as the piece goes on in its words.
    """
    pieces = F.split(F.concat(trimmed, F.lit(" ")), f"(?:^|(?<= )){_TAG} ")
    size = lambda p: _count(p, " ")  # noqa: E731  a piece ends with a space after its last word
    none = F.array().cast("array<struct<first:int,end:int>>")
    # The first word that is none of them ends it; there is one, as nothing follows the last space.
    long = lambda p: F.array_position(F.transform(F.split(p, " "), lambda x: x.isin(*EXPRESSION) | F.rlike(x, F.lit("^[0-9]+$"))), False) - 1

    def step(held: Column, p: Column) -> Column:
        first = held["before"] + len(_TAG.split())
        return F.struct((first + size(p)).cast("int").alias("before"), F.concat(held["found"], F.array(F.struct(first.cast("int").alias("first"), (first + long(p)).cast("int").alias("end")))).alias("found"))

    start = F.struct(size(F.get(pieces, F.lit(0))).cast("int").alias("before"), none.alias("found"))
    return F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), start, step, lambda held: held["found"])


def _detections(trimmed: Column) -> Column:
    """Surviving ``struct(start, priority, n, label)`` of a single-spaced text, by start."""
    by_key: dict[str, list[dict]] = {}
    for r in RULES:
        for k in r.keys:
            by_key.setdefault(k, []).append({"pattern": r.pattern, "label": r.label, "priority": r.priority, "back": r.back, "before": r.before})
    # One literal, folded to a map when the plan is optimised.
    known = F.from_json(F.lit(json.dumps(by_key)), "map<string,array<struct<pattern:string,label:string,priority:int,back:int,before:string>>>")

    def at(w: Column, i: Column, inside: Column) -> Column:
        def tried(r: Column) -> Column:
            start = i - r["back"]
            window = F.array_join(F.slice(w, start + 1, F.lit(WINDOW)), " ")
            before = F.array_join(F.slice(w, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT))), " ")
            part = F.get(w, start - 1).isin("or", "and", "with") & F.exists(inside, lambda e: (e["first"] < start) & (start <= e["end"]))
            meant = F.when(r["before"] == "", True).when(r["before"] == PART, F.coalesce(part, F.lit(False))).otherwise(F.rlike(before, r["before"]))
            stands = lambda x: F.when(x.isNotNull() & meant, F.struct(start.alias("start"), r["priority"].alias("priority"), (_count(x, " ") + 1).alias("n"), r["label"].alias("label")))
            return F.when(start >= 0, C.let(F.regexp_substr(window, r["pattern"]), stands))

        return F.filter(F.transform(F.try_element_at(known, F.get(w, i)), tried), lambda x: x.isNotNull())

    def best(d: Column) -> Column:
        """The last of those that share a start: they are in order of priority, length and label."""
        return F.filter(d, lambda x, k: F.coalesce(F.get(d, k + 1)["start"] != x["start"], F.lit(True)))

    def kept(d: Column) -> Column:
        end = lambda x: x["start"] + x["n"]
        within = lambda x, y: (x["start"] >= y["start"]) & (end(x) <= end(y))
        worth = lambda x: F.struct(x["priority"], x["n"], x["label"])

        def stays(x: Column, k: Column) -> Column:
            near = F.slice(d, F.greatest(k + 1 - WINDOW, F.lit(1)), F.lit(2 * WINDOW + 1))
            return ~F.exists(near, lambda y: (within(x, y) | within(y, x)) & (worth(y) > worth(x)))

        return F.filter(d, stays)

    def scan(w: Column) -> Column:
        places = F.filter(F.transform(w, lambda x, i: F.when(x.isin(*KEYS), i)), lambda i: i.isNotNull())
        # Most texts have no tag and so no expression to look for.
        tagged = F.when(F.contains(trimmed, F.lit(f"{_TAG} ")), _expressions(trimmed)).otherwise(F.array().cast("array<struct<first:int,end:int>>"))
        return C.let(tagged, lambda inside: C.let(C.let(F.sort_array(F.flatten(F.transform(places, lambda i: at(w, i, inside)))), best), kept))

    return C.let(F.split(trimmed, " "), scan)


def scan(text: Column) -> Column:
    """A struct of everything that the scan of one text finds (null: empty)."""
    bare = F.trim(F.regexp_replace(C.ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, " "))
    kind = "array<struct<start:int,priority:int,n:int,label:string>>"

    def found(t: Column) -> Column:
        padded = F.concat(F.lit(" "), t, F.lit(" "))

        def rest(s: Column) -> Column:
            has = {p: F.contains(s, F.lit(f" {p} ")) for p in BASE}
            n = {p: F.when(has[p], F.regexp_count(s, F.lit(f"(?<= ){p}(?= )"))).otherwise(0) for p in BASE}
            word_at = lambda pos: _count(F.substring(s, F.lit(1), pos), " ") - 1
            first = F.least(*[F.when(has[p], F.locate(f" {p} ", s)) for p in BASE])
            last = F.greatest(*[F.when(has[p], F.length(s) - F.locate(f" {p} "[::-1], F.reverse(s)) - (len(p) + 2) + 2) for p in BASE])
            gate = F.rlike(s, F.lit(f" (?:{'|'.join(KEYWORDS)}) "))
            return F.struct(
                F.when(t == "", 0).otherwise(_count(t, " ") + 1).cast("long").alias("n_words"),
                sum(n.values(), F.lit(0)).cast("long").alias("n_base"),
                F.when(first.isNotNull(), word_at(first)).cast("long").alias("first_word"),
                F.when(last.isNotNull(), word_at(last)).cast("long").alias("last_word"),
                F.array_compact(F.array(*[F.when(has[p], F.lit(x)) for p, x in BASE.items()])).alias("base"),
                F.when(gate, _detections(t).cast(kind)).otherwise(F.array().cast(kind)).alias("detections"),
            )

        return C.let(padded, rest)

    return C.let(bare, found)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: ``doc_id`` and the fields of :func:`scan`."""
    return docs.select(F.col(id_col).alias("doc_id"), scan(F.col(text_col)).alias("s")).select("doc_id", "s.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: licenses of every document.

    Null or empty text: no words, no labels (empty strings), score 0. Repeated
    rows stay, very long texts are scanned whole, and an empty table gives no
    rows. score is the highest priority of what was found, as a share of 100; a
    base phrase counts 60.
    """
    got = scan_licenses(C.table(spark, sf_dir, "documents"))
    all_labels = F.array_union(F.col("base"), F.transform("detections", lambda d: d["label"]))
    top = F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda d: d["priority"])), F.lit(0)), F.when(F.col("n_base") > 0, 60).otherwise(0))
    return got.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(F.array_sort(all_labels), ",").alias("labels"),
        (top / 100.0).cast("double").alias("score"),
    )
