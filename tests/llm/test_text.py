import math
import random
import time
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import language, licenses, toxicity
from quern.llm.grams import grams
from tests.llm.fixtures import documents, empty, prose, rows


def test_gate_changes_nothing():
    names = [r.expression.pattern.decode()[10:-9] for r in licenses.RULES]
    samples = [n.replace("(?:", "").replace(")?", "").replace(")", "").replace("licen[cs]e", "license").split("|") for n in names]
    texts = [t for parts in samples for t in parts][:1500] + [
        "SPDX-License-Identifier: GPL-3.0-or-later", "cc by 4.0", "GPLv2", "gpl v3", "Licensed under CC BY-NC 4.0.", "the unlicense", "All rights reserved.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this MIT License thing", "wtfpl", "psf license version 2"]
    for t in texts:
        assert licenses.scan(t) == licenses.scan(t, gated=False), t
    assert len(licenses.RULES) > 300


def test_license_priority_and_containment():
    got = licenses.scan("This work is licensed under the GNU General Public License, version 3.")
    assert got["labels"] == "gpl,gpl-3.0" and got["base_labels"] == "gpl" and got["first_word"] == 7
    assert [d[2] for d in got["detections"]] == ["gpl-3.0"]
    got = licenses.scan("MIT license, mit LICENSE")
    assert (got["n_base"], got["first_word"], got["last_word"]) == (2, 0, 2)
    assert licenses.scan("mitlicense submit license")["n_base"] == 0
    assert licenses.scan("émit license")["n_base"] == 0


def slow_base(text):
    """Base places by a plain walk over the words."""
    words, place, now = [], [], ""
    for c in (text or "") + " ":
        low = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if low in "0123456789abcdefghijklmnopqrstuvwxyz" or ord(c) >= 0x80:
            now += low
        elif now:
            words.append(now)
            now = ""
    labels = set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        parts = phrase.split()
        for i in range(len(words)):
            if words[i: i + len(parts)] == parts:
                place.append(i)
                labels.add(label)
    return len(words), len(place), min(place, default=None), max(place, default=None), ",".join(sorted(labels))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("MIT mit license License, LICENSE; apache-license general public gnu the under é İ {x} \x00 _ 0 version 2.0 é".split(" ")), max_size=25),
       st.sampled_from([" ", ".", "\n", ""]))
def test_base_columns_against_a_plain_walk(parts, joint):
    text = joint.join(parts)
    got = licenses.scan(text)
    assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == slow_base(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(0, 15), st.integers(1, 8), st.sampled_from("abc")), max_size=30))
def test_suppression_against_all_pairs(found):
    found = [(-p, -n, b, label, (p, label)) for p, b, n, label in found]
    kept = []
    for priority, length, begin, _, rule in sorted(found, key=lambda f: f[:4]):
        if not any(b <= begin and begin - length <= e for b, e, _ in kept):
            kept.append((begin, begin - length, rule))
    assert licenses.stay(found) == kept


def test_long_texts_are_scanned_in_time_proportional_to_their_length():
    began = time.process_time()
    got = licenses.scan("under the mit license and " * 60_000)
    assert got["n_base"] == 60_000 and time.process_time() - began < 20


def test_licenses_table(spark):
    got = {(r["doc_id"], r["n_words"]): r for r in licenses.scanned(documents(spark)).collect()}
    assert len(licenses.scanned(documents(spark)).collect()) == len(rows())
    for r in rows():
        one = licenses.scan(r[1])
        g = got[r[0], one["n_words"]]
        assert (g["n_base"], g["first_word"], g["labels"], g["score"]) == (one["n_base"], one["first_word"], one["labels"], one["score"])
    assert licenses.scanned(empty(spark)).count() == 0


def foreign(seed, words):
    rng = random.Random(seed)
    parts = "sch ung ei keit lich ver ge zu au ü ö ß pf tz ach".split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(words))


def test_language_by_rank_order(spark):
    data = [(i, prose(i, 60), "en") for i in range(60)] + [(100 + i, foreign(i, 60), "de") for i in range(60)]
    data += [(500, None, "en"), (501, "", None), (502, "123 !! 😀😀", None), (503, prose(7, 60), None), (None, foreign(8, 30), "de")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    profiles = language.fit(docs.where("doc_id is null or doc_id % 3 <> 1"))
    got = language.predicted(docs, profiles).collect()
    by = {r["doc_id"]: r for r in got}
    held = [r for r in data if r[0] is not None and r[0] < 500 and r[0] % 3 == 1]
    assert sum(by[r[0]]["lang_pred"] == r[2] for r in held) >= 0.95 * len(held)
    assert [by[k]["lang_pred"] for k in (500, 501, 502, 503, None)] == ["und", "und", "und", "en", "de"]
    assert all(0 <= r["score"] <= 1 for r in got)
    kept = language.identified(docs, profiles)
    assert kept.columns == docs.columns and {r["doc_id"] for r in data and kept.collect()} == {r[0] for r in data} - {500, 501, 502}
    assert language.predicted(empty(spark), profiles).count() == 0
    assert language.fit(empty(spark)).names == []
    assert {r["lang_pred"] for r in language.predicted(docs, language.fit(empty(spark))).collect()} == {"und"}


def test_out_of_place_distance_by_hand():
    ranks = {"a": np.array([5, 3, 9], np.uint32), "b": np.array([9, 5, 1], np.uint32)}
    far = language.Profiles(ranks, most=3).distances(np.array([3, 5, 7], np.uint32))
    assert far.tolist() == [1 + 1 + 3, 3 + 0 + 3]


def slow_profile(texts, most):
    counts = Counter()
    for text in texts:
        for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            closed = " " + word + " "
            counts.update(word)
            counts.update(closed[i: i + n] for n in (2, 3, 4) for i in range(len(closed) - n + 1) if closed[i: i + n].strip())
    return counts


def test_language_against_plain_counting(spark):
    """Ranks, distances and the decision by dictionaries of n-grams, ties broken by the same hash."""
    data = [(i, prose(i, 40), "en") for i in range(12)] + [(50 + i, foreign(i, 40), "de") for i in range(12)]
    profiles = language.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"))

    def hash_of(gram):
        code = np.array([0 if c == " " else ord(c) for c in gram], np.uint32)
        at, h = grams(code, len(code))
        return int(h[0])

    def order(counts, most=language.RANKS):
        return [h for h, _ in sorted(((hash_of(g), n) for g, n in counts.items()), key=lambda x: (-x[1], x[0]))][:most]

    ranks = {lang: order(slow_profile([t for _, t, k in data if k == lang], language.RANKS)) for lang in ("de", "en")}
    for text in [prose(500, 30), foreign(501, 30), "sch ung", "a", prose(502, 5) + " " + foreign(503, 5)]:
        own = order(slow_profile([text], language.RANKS))
        far = {lang: sum(abs(r.index(h) - k) if h in r else language.RANKS for k, h in enumerate(own)) for lang, r in ranks.items()}
        best = min(sorted(far), key=far.get)
        name, score = profiles.predict([text])
        assert name == [best] and abs(score[0] - (1 - far[best] / (language.RANKS * len(own)))) < 1e-12


def test_language_of_long_and_plain_tables(spark):
    profiles = language.fit(documents(spark))
    assert language.predicted(documents(spark), profiles).count() == len(rows())


def toxic_texts():
    rng, bad = random.Random(4), "glumpfy snarkle vexodor brimbat".split()
    data = []
    for i in range(400):
        words = prose(1000 + i, 80).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(bad))
        data.append((i, " ".join(words), int(toxic)))
    return data


def test_toxicity_held_out_and_misspelt():
    data = toxic_texts()
    learn = [r for r in data if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    test = [r for r in data if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    model = toxicity.train([r[1] for r in learn], np.array([r[2] for r in learn]))
    score = model.score([r[1] for r in test])
    assert np.mean((score >= 0.7) == np.array([r[2] for r in test])) >= 0.95
    clean = [prose(5000 + i, 60) for i in range(20)]
    misspelt = [c + " glumpfyy snarkles vexodors" for c in clean]
    assert model.score(misspelt).mean() > model.score(clean).mean() + 0.3
    long = " ".join([prose(9, 30_000), "glumpfy snarkle", prose(10, 30_000)])
    assert model.score([long])[0] >= 0.7


def slow_score(model, text):
    """Scores by a plain loop: words, segments of four, subwords one at a time."""
    def mix(h):
        h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
        h = (h ^ h >> 12) * 0x297A2D39 & 0xFFFFFFFF
        return h ^ h >> 15

    factors = [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0x8DA6B343]

    def gram(points):
        h = len(points) * 0x01000193 & 0xFFFFFFFF
        for j, p in enumerate(points):
            h = h + (p + j * 7919 + 1) * factors[j] & 0xFFFFFFFF
            h ^= h >> 13
        return mix(h)

    words, now = [], []
    for c in text.lower() + "\0":
        if c.isalnum():
            now.append(ord(c))
        elif now:
            words.append(now)
            now = []
    if not words:
        return model.prior
    best = -math.inf
    for at in range(0, len(words), 4):
        values = []
        for word in words[at: at + 4]:
            closed = [0, *word, 0]
            values += [gram(closed[i: i + n]) for n in (3, 4, 5, 6) for i in range(len(closed) - n + 1)]
            total = sum(mix((p * 0x9E3779B1 + k * 0x85EBCA77) & 0xFFFFFFFF) for k, p in enumerate(word))
            values.append(mix(total + 77 & 0xFFFFFFFF))
        logit = sum(float(model.table[v & toxicity.BUCKETS - 1]) for v in values) / len(values) + model.bias
        best = max(best, logit)
    return 1 / (1 + math.exp(-max(-30, min(30, best))))


def test_toxicity_scores_against_a_plain_loop():
    model = toxicity.train([r[1] for r in toxic_texts()], np.array([r[2] for r in toxic_texts()]))
    texts = [r[1] for r in toxic_texts()[:25]] + ["", " .,! ", "a", "x y z", "Ünïcode ŉ 漢字 wörds glumpfy", "é" * 9, "one two three four five"]
    for text, score in zip(texts, model.score(texts)):
        assert abs(slow_score(model, text) - score) < 1e-6, text


def test_toxicity_table(spark):
    data = toxic_texts()
    docs = spark.createDataFrame([(a, b) for a, b, _ in data] + [(None, "x"), (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(a, c, 1) for a, _, c in data] + [(None, 1, 1), (900, 1, 1), (3, None, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, labels)
    got = toxicity.scored(docs, model).collect()
    assert len(got) == len(data) + 3 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    again = toxicity.fit(docs.repartition(5), labels.repartition(3))
    assert np.array_equal(again.table, model.table)
    assert toxicity.scored(empty(spark), model).count() == 0
    none = toxicity.fit(docs, labels.where("false"))
    assert {round(r["score"], 3) for r in toxicity.scored(docs, none).collect()} <= {0.0, 0.5}
