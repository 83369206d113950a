"""License scans by ordered signature rules.

Texts are lower-cased (A-Z) and reduced to their words, one space apart; every rule is a
regular expression over that string and begins and ends at words. A rule names keywords of
which one must occur before its expression is tried. Detections are taken in the order of
priority, then length; one whose interval of words lies inside a detection already taken is
suppressed, so a full notice hides the names in it and a version hides its family.

Base phrases are plain places of consecutive words and are never suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quern.llm.common import doc_columns

BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

_V = r"(?:v|version )?"

#: label | names as an expression | SPDX identifiers as words | web paths as words
LICENSES = [row.split(" | ") for row in rf"""
mit | (?:the )?(?:mit|expat) licen[cs]e | mit | opensource org licenses? mit
mit-0 | mit no attribution(?: licen[cs]e)? | mit 0 | opensource org licenses? mit 0
x11 | x11 licen[cs]e | x11 | xfree86 org 3 3 6 copyright2
apache-1.0 | apache (?:software )?licen[cs]e {_V}1 0 | apache 1 0 | apache org licenses license 1 0
apache-1.1 | apache (?:software )?licen[cs]e {_V}1 1 | apache 1 1 | apache org licenses license 1 1
apache-2.0 | apache (?:software |public )?licen[cs]e {_V}2(?: 0)? | apache 2 0 | apache org licenses license 2 0
gpl-1.0 | gnu (?:general public licen[cs]e|gpl) {_V}1(?: 0)? | gpl 1 0(?: only| or later)? | gnu org licenses old licenses gpl 1 0
gpl-2.0 | (?:gnu )?(?:general public licen[cs]e|gpl) ?{_V}2(?: 0)? | gpl 2 0(?: only| or later)? | gnu org licenses (?:old licenses )?gpl 2 0
gpl-3.0 | (?:gnu )?(?:general public licen[cs]e|gpl) ?{_V}3(?: 0)? | gpl 3 0(?: only| or later)? | gnu org licenses gpl 3 0
lgpl-2.0 | gnu (?:library general public licen[cs]e|lgpl) {_V}2(?: 0)? | lgpl 2 0(?: only| or later)? | gnu org licenses old licenses lgpl 2 0
lgpl-2.1 | (?:gnu )?(?:lesser general public licen[cs]e|lgpl) ?{_V}2 1 | lgpl 2 1(?: only| or later)? | gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3.0 | (?:gnu )?(?:lesser general public licen[cs]e|lgpl) ?{_V}3(?: 0)? | lgpl 3 0(?: only| or later)? | gnu org licenses lgpl 3 0
agpl-3.0 | (?:gnu )?(?:affero general public licen[cs]e|agpl) ?{_V}3(?: 0)? | agpl 3 0(?: only| or later)? | gnu org licenses agpl 3 0
gfdl-1.1 | gnu free documentation licen[cs]e {_V}1 1 | gfdl 1 1(?: only| or later)? | gnu org licenses old licenses fdl 1 1
gfdl-1.2 | gnu free documentation licen[cs]e {_V}1 2 | gfdl 1 2(?: only| or later)? | gnu org licenses old licenses fdl 1 2
gfdl-1.3 | gnu free documentation licen[cs]e(?: {_V}1 3)? | gfdl 1 3(?: only| or later)? | gnu org licenses fdl 1 3
bsd-1-clause | (?:bsd 1 clause|1 clause bsd)(?: licen[cs]e)? | bsd 1 clause | opensource org licenses? bsd 1 clause
bsd-2-clause | (?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[cs]e)? | bsd 2 clause | opensource org licenses? bsd 2 clause
bsd-3-clause | (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)? | bsd 3 clause | opensource org licenses? bsd 3 clause
bsd-4-clause | (?:bsd 4 clause|4 clause bsd|original bsd|old bsd)(?: licen[cs]e)? | bsd 4 clause | directory fsf org wiki license bsd 4clause
0bsd | (?:zero clause bsd|bsd zero clause|0bsd)(?: licen[cs]e)? | 0bsd | opensource org licenses? 0bsd
isc | isc licen[cs]e | isc | opensource org licenses? isc
zlib | (?:zlib|zlib libpng) licen[cs]e | zlib | opensource org licenses? zlib
libpng-2.0 | (?:png reference library|libpng) licen[cs]e(?: {_V}2)? | libpng 2 0 | libpng org pub png src libpng license
mpl-1.0 | mozilla public licen[cs]e {_V}1 0 | mpl 1 0 | mozilla org mpl 1 0
mpl-1.1 | (?:mozilla public licen[cs]e|mpl) {_V}1 1 | mpl 1 1 | mozilla org mpl 1 1
mpl-2.0 | (?:mozilla public licen[cs]e|mpl) {_V}2(?: 0)? | mpl 2 0 | mozilla org mpl 2 0
epl-1.0 | (?:eclipse public licen[cs]e|epl) {_V}1(?: 0)? | epl 1 0 | eclipse org legal epl v10
epl-2.0 | (?:eclipse public licen[cs]e|epl) {_V}2(?: 0)? | epl 2 0 | eclipse org legal epl (?:2 0|v20)
cddl-1.0 | (?:common development and distribution licen[cs]e|cddl)(?: {_V}1 0)? | cddl 1 0 | opensource org licenses? cddl 1 0
cddl-1.1 | (?:common development and distribution licen[cs]e|cddl) {_V}1 1 | cddl 1 1 | glassfish java net public cddl
cpl-1.0 | common public licen[cs]e(?: {_V}1 0)? | cpl 1 0 | opensource org licenses? cpl 1 0
ipl-1.0 | ibm public licen[cs]e(?: {_V}1 0)? | ipl 1 0 | opensource org licenses? ibmpl
apsl-2.0 | apple public source licen[cs]e(?: {_V}2(?: 0)?)? | apsl 2 0 | opensource apple com license apsl
eupl-1.1 | european union public licen[cs]e {_V}1 1 | eupl 1 1 | joinup ec europa eu software page eupl
eupl-1.2 | (?:european union public licen[cs]e|eupl)(?: {_V}1 2)? | eupl 1 2 | eupl eu 1 2
cecill-2.1 | cecill(?: free software)? licen[cs]e(?: agreement)?(?: {_V}2 1)? | cecill 2 1 | cecill info licences licence cecill v2 1
cecill-b | cecill b licen[cs]e(?: agreement)? | cecill b | cecill info licences licence cecill b
cecill-c | cecill c licen[cs]e(?: agreement)? | cecill c | cecill info licences licence cecill c
artistic-1.0 | artistic licen[cs]e {_V}1(?: 0)? | artistic 1 0 | opensource org licenses? artistic 1 0
artistic-2.0 | artistic licen[cs]e(?: {_V}2(?: 0)?)? | artistic 2 0 | opensource org licenses? artistic 2 0
boost-1.0 | boost software licen[cs]e(?: {_V}1 0)? | bsl 1 0 | boost org license 1 0
busl-1.1 | business source licen[cs]e(?: {_V}1 1)? | busl 1 1 | mariadb com bsl11
unlicense | (?:the )?unlicense | unlicense | unlicense org
wtfpl | (?:do what the (?:\w+) you want to public licen[cs]e|wtfpl) | wtfpl | wtfpl net
cc0-1.0 | (?:cc0|creative commons zero)(?: {_V}1 0)?(?: universal)? | cc0 1 0 | creativecommons org publicdomain zero 1 0
cc-by-1.0 | (?:creative commons attribution|cc by) 1 0(?: generic)? | cc by 1 0 | creativecommons org licenses by 1 0
cc-by-2.0 | (?:creative commons attribution|cc by) 2 0(?: generic)? | cc by 2 0 | creativecommons org licenses by 2 0
cc-by-2.5 | (?:creative commons attribution|cc by) 2 5(?: generic)? | cc by 2 5 | creativecommons org licenses by 2 5
cc-by-3.0 | (?:creative commons attribution|cc by) 3 0(?: unported)? | cc by 3 0 | creativecommons org licenses by 3 0
cc-by-4.0 | (?:creative commons attribution|cc by) 4 0(?: international)? | cc by 4 0 | creativecommons org licenses by 4 0
cc-by-sa-2.0 | (?:creative commons attribution share ?alike|cc by sa) 2 0(?: generic)? | cc by sa 2 0 | creativecommons org licenses by sa 2 0
cc-by-sa-2.5 | (?:creative commons attribution share ?alike|cc by sa) 2 5(?: generic)? | cc by sa 2 5 | creativecommons org licenses by sa 2 5
cc-by-sa-3.0 | (?:creative commons attribution share ?alike|cc by sa) 3 0(?: unported)? | cc by sa 3 0 | creativecommons org licenses by sa 3 0
cc-by-sa-4.0 | (?:creative commons attribution share ?alike|cc by sa) 4 0(?: international)? | cc by sa 4 0 | creativecommons org licenses by sa 4 0
cc-by-nc-2.0 | (?:creative commons attribution non ?commercial|cc by nc) 2 0(?: generic)? | cc by nc 2 0 | creativecommons org licenses by nc 2 0
cc-by-nc-3.0 | (?:creative commons attribution non ?commercial|cc by nc) 3 0(?: unported)? | cc by nc 3 0 | creativecommons org licenses by nc 3 0
cc-by-nc-4.0 | (?:creative commons attribution non ?commercial|cc by nc) 4 0(?: international)? | cc by nc 4 0 | creativecommons org licenses by nc 4 0
cc-by-nd-3.0 | (?:creative commons attribution no ?deriv(?:ative)?s|cc by nd) 3 0(?: unported)? | cc by nd 3 0 | creativecommons org licenses by nd 3 0
cc-by-nd-4.0 | (?:creative commons attribution no ?deriv(?:ative)?s|cc by nd) 4 0(?: international)? | cc by nd 4 0 | creativecommons org licenses by nd 4 0
cc-by-nc-sa-3.0 | (?:creative commons attribution non ?commercial share ?alike|cc by nc sa) 3 0(?: unported)? | cc by nc sa 3 0 | creativecommons org licenses by nc sa 3 0
cc-by-nc-sa-4.0 | (?:creative commons attribution non ?commercial share ?alike|cc by nc sa) 4 0(?: international)? | cc by nc sa 4 0 | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-3.0 | (?:creative commons attribution non ?commercial no ?deriv(?:ative)?s|cc by nc nd) 3 0(?: unported)? | cc by nc nd 3 0 | creativecommons org licenses by nc nd 3 0
cc-by-nc-nd-4.0 | (?:creative commons attribution non ?commercial no ?deriv(?:ative)?s|cc by nc nd) 4 0(?: international)? | cc by nc nd 4 0 | creativecommons org licenses by nc nd 4 0
odbl-1.0 | (?:open database licen[cs]e|odbl)(?: {_V}1 0)? | odbl 1 0 | opendatacommons org licenses odbl
odc-by-1.0 | open data commons attribution licen[cs]e(?: {_V}1 0)? | odc by 1 0 | opendatacommons org licenses by
pddl-1.0 | (?:public domain dedication and licen[cs]e|pddl)(?: {_V}1 0)? | pddl 1 0 | opendatacommons org licenses pddl
ofl-1.1 | (?:sil )?open font licen[cs]e(?: {_V}1 1)? | ofl 1 1 | scripts sil org ofl
psf-2.0 | (?:python software foundation|psf) licen[cs]e(?: agreement)?(?: {_V}2)? | psf 2 0 | docs python org license
php-3.01 | php licen[cs]e(?: {_V}3 01)? | php 3 01 | php net license 3 01
ruby | ruby(?: s)? licen[cs]e | ruby | ruby lang org en about license
postgresql | postgresql licen[cs]e | postgresql | postgresql org about licence
openssl | openssl licen[cs]e | openssl | openssl org source license
ms-pl | microsoft public licen[cs]e | ms pl | opensource org licenses? ms pl
ms-rl | microsoft reciprocal licen[cs]e | ms rl | opensource org licenses? ms rl
osl-3.0 | open software licen[cs]e(?: {_V}3 0)? | osl 3 0 | opensource org licenses? osl 3 0
afl-3.0 | academic free licen[cs]e(?: {_V}3 0)? | afl 3 0 | opensource org licenses? afl 3 0
ncsa | (?:university of illinois )?ncsa(?: open source)? licen[cs]e | ncsa | opensource org licenses? ncsa
upl-1.0 | universal permissive licen[cs]e(?: {_V}1 0)? | upl 1 0 | oss oracle com licenses upl
sspl-1.0 | server side public licen[cs]e(?: {_V}1)? | sspl 1 0 | mongodb com licensing server side public license
elastic-2.0 | elastic licen[cs]e(?: {_V}2(?: 0)?)? | elastic 2 0 | elastic co licensing elastic license
""".strip().split("\n")]

#: label | expression: families without a version, whole notices, and statements of rights.
FAMILIES = [row.split(" | ") for row in r"""
gpl | (?:gnu )?(?:general public licen[cs]e|gpl)
lgpl | (?:gnu )?(?:lesser|library) general public licen[cs]e
agpl | (?:gnu )?affero general public licen[cs]e
apache | apache (?:software )?licen[cs]e
bsd | bsd(?: style)? licen[cs]e
mpl | mozilla public licen[cs]e
epl | eclipse public licen[cs]e
gfdl | free documentation licen[cs]e
cc-by | (?:creative commons attribution|cc by)(?: licen[cs]e)?
cc-by-sa | (?:creative commons attribution share ?alike|cc by sa)(?: licen[cs]e)?
cc-by-nc | (?:creative commons attribution non ?commercial|cc by nc)(?: licen[cs]e)?
cc-by-nd | (?:creative commons attribution no ?deriv(?:ative)?s|cc by nd)(?: licen[cs]e)?
cc | creative commons(?: licen[cs]e)?
""".strip().split("\n")]

NOTICES = [row.split(" | ") for row in r"""
mit | permission is hereby granted free of charge to any person obtaining a copy
isc | permission to use copy modify and or distribute this software for any purpose
bsd | redistribution and use in source and binary forms with or without modification
bsd-3-clause | neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors
bsd-4-clause | all advertising materials mentioning features or use of this software
zlib | this software is provided as is without any express or implied warranty in no event will the authors
gpl | this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
gpl-3.0 | either version 3 of the licen[cs]e or at your option any later version
gpl-2.0 | either version 2 of the licen[cs]e or at your option any later version
lgpl | this library is free software you can redistribute it and or modify it
apache-2.0 | you may not use this file except in compliance with the licen[cs]e
mpl-2.0 | this source code form is subject to the terms of the mozilla public licen[cs]e
boost-1.0 | permission is hereby granted free of charge to any person or organization
unlicense | this is free and unencumbered software released into the public domain
public-domain | (?:released|dedicated|placed|put) (?:in|into|to) the public domain
all-rights-reserved | all rights reserved
proprietary | (?:proprietary and confidential|unauthori[sz]ed (?:copying|reproduction|use) (?:[^ ]+ ){0,6}(?:is )?(?:strictly )?prohibited)
""".strip().split("\n")]

_GRANT = r"(?:licen[cs]ed|released|distributed|published|available|made available|provided|covered) (?:under|by) (?:the )?(?:terms of (?:the )?)?(?:gnu )?"
#: For rules whose every alternative has words of its own: one of these is in each.
_GENERAL = tuple(w.encode() for w in (
    "gpl", "bsd", "mpl", "epl", "cddl", "eupl", "cc0", "cc by", "creative", "general public", "library", "lesser", "affero", "mozilla",
    "eclipse", "development and distribution", "european union", "proprietary", "unauthori", "wtfpl", "do what the", "odbl", "pddl",
    "open database", "public domain dedication", "psf", "python software"))


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    priority: int
    confidence: float
    keywords: tuple[bytes, ...]
    expression: re.Pattern


def _keywords(expression: str) -> tuple[bytes, ...]:
    """Strings of which every match holds one: the longest run outside all groups, or else the general ones."""
    plain = re.sub(r"\(\?:(?:[^()]|\([^()]*\))*\)\??|\[[^\]]*\]\??", "|", expression)
    runs = [w for part in re.split(r"[|]", plain) for w in re.findall(r"[a-z0-9]{3,}(?!\?)", part)]
    return (max(runs, key=len).encode(),) if runs else _GENERAL


def rules() -> list[Rule]:
    """All rules, first the ones that decide."""
    made = []

    def add(label, kind, priority, confidence, expression):
        made.append(Rule(label, kind, priority, confidence, _keywords(expression),
                         re.compile(rb"(?<![^ ])(?:" + expression.encode() + rb")(?![^ ])")))

    for label, expression in NOTICES:
        add(label, "notice", 5, 0.95, expression)
    for label, names, spdx, web in LICENSES:
        add(label, "spdx", 6, 0.99, rf"spdx licen[cs]e identifier {spdx}")
        add(label, "web", 4, 0.9, rf"(?:https? )?(?:www )?{web}")
        add(label, "grant", 4, 0.95, _GRANT + names)
        add(label, "name", 3, 0.8, names)
    for label, names in FAMILIES:
        add(label, "family-grant", 2, 0.85, _GRANT + names)
        add(label, "family", 1, 0.6, names)
    return sorted(made, key=lambda r: -r.priority)


RULES = rules()
#: Every byte that is no word's becomes a space, and A-Z becomes a-z.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_FIRST = sorted({k for r in RULES for k in r.keywords})


def stay(found: list[tuple[int, int, int, str, Rule]]) -> list[tuple[int, int, Rule]]:
    """(begin, end, rule) of the detections that stay. found: -priority, -length, begin, label, rule.

    Only the outermost intervals taken so far can contain another. Sorted by begin their ends
    rise, so one search tells; detections of one priority and length cannot contain each other
    unless they are the same place, so they join the others together."""
    kept, begins, ends = [], [], []
    for (_, minus), group in groupby(sorted(found, key=itemgetter(0, 1, 2, 3)), key=itemgetter(0, 1)):
        fresh, last = [], -1
        for _, _, begin, _, rule in group:
            at = bisect_right(begins, begin) - 1
            if begin != last and not (at >= 0 and ends[at] >= begin - minus):
                fresh.append((begin, begin - minus))
                kept.append((begin, begin - minus, rule))
                last = begin
        if fresh:
            outer, far = [], -1
            for begin, end in sorted([*zip(begins, ends), *fresh], key=lambda x: (x[0], -x[1])):
                if end > far:
                    outer.append((begin, end))
                    far = end
            begins, ends = [b for b, _ in outer], [e for _, e in outer]
    return kept


def scan(text: str | None, gated: bool = True) -> dict:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, detections of one
    text. Without the gate every rule is tried; the result is the same."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
    line = b" ".join(words)
    padded = b" " + line + b" "
    spots, base = [], set()
    if b" license " in padded:
        for phrase, label in BASE:
            key, at = b" " + phrase.encode() + b" ", -1
            while (at := padded.find(key, at + 1)) >= 0:
                spots.append(at)
                base.add(label)
    hits: list[tuple[int, int, Rule]] = []
    have = {k for k in _FIRST if k in line}
    if have or not gated:
        for rule in RULES:
            if not gated or not have.isdisjoint(rule.keywords):
                hits += [(m.start(), m.end(), rule) for m in rule.expression.finditer(line)]
    kept: list[tuple[int, int, Rule]] = []
    places: list[int] = []
    if spots or hits:
        # The number of a word is the number of spaces before it.
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        places = np.searchsorted(spaces, spots).tolist()
        begins, lasts = (np.searchsorted(spaces, [h[k] for h in hits]).tolist() for k in (0, 1))
        kept = stay([(-r.priority, b - e - 1, b, r.label, r) for b, e, (_, _, r) in zip(begins, lasts, hits)])
    labels = base | {r.label for _, _, r in kept}
    score = 0.9 if base else 0.0
    for _, _, r in kept:
        score = max(score, r.confidence)
    return {"n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": score,
            "detections": [(b, e, r.label, r.kind) for b, e, r in sorted(kept, key=lambda k: k[:2])]}


def scanned(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text) with the fields of scan; detections is an
    array of structs (begin and end word, label, kind of rule).

    A null or empty text has no words, no labels and score 0. Long texts are scanned whole.
    Rows that repeat are scanned alike; a null doc_id stays null. Extra columns are ignored;
    an empty table gives an empty result."""

    def run(batches):
        for pdf in batches:
            out = pd.DataFrame([scan(t) for t in pdf["text"]], columns=["n_words", "n_base", "first_word", "last_word",
                                                                      "base_labels", "labels", "score", "detections"])
            out["first_word"], out["last_word"] = out["first_word"].astype("Int64"), out["last_word"].astype("Int64")
            out["detections"] = [[{"begin": b, "end": e, "label": label, "kind": k} for b, e, label, k in d] for d in out["detections"]]
            yield out.assign(doc_id=pdf["doc_id"].astype("Int64").to_numpy() if len(pdf) else [])

    return doc_columns(docs, "doc_id", "text").mapInPandas(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
             "score double, detections array<struct<begin: int, end: int, label: string, kind: string>>")
