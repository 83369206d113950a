"""Small inputs with the hard cases: nulls, empty and long texts, ties, copies, clashing columns."""

import random

SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
EXTRA = "fp string, node long, component long, component_id long, cuts string, salt long, copies long, k long, n int, bucket int, score double, ids binary"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(words))


def rows():
    shared, base = prose(1, 70), prose(2, 200)
    texts = [
        base, base, base.replace(" ", "  "), base.upper(), base + " tail", None, "", "   \n\t", "one", "one two", "one two three",
        prose(3, 90) + " " + shared + " " + prose(4, 60), shared, prose(5, 49), prose(6, 50), prose(6, 50), "same " * 120, "same " * 150,
        prose(7, 10) + " " + shared, "Ünïcode wörds " * 30, "x" * 50_000, prose(8, 20_000), "    nbsp", "!!! 123 ...",
        "Released under the MIT License. " + prose(9, 30), "licensed under the GNU General Public License, version 2", "0 1 2 3",
    ] + [prose(20 + i, 40 + i) for i in range(25)] + [prose(99, 80)] * 12
    out = []
    for i, t in enumerate(texts):
        source = None if i % 11 == 0 else f"s{i % 3}" if i % 2 else "hot"
        lang = None if i % 7 == 0 else "en"
        out.append((i * 2 + 1, t, lang, source, len(t or "")) + ("x", 1, 2, 3, "c", 4, 5, 6, 7, 8, 0.5, b"z"))
    out.append(out[3])  # a repeated row
    out.append((None, base, "en", "s1", 5) + out[0][5:])
    out.append((None, None, None, None, None) + (None,) * 12)
    return out


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((x is not None, x) for x in row)


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=key)
