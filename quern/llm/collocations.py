"""Phrase collocations: phrases of two to four words, by how much of their parts' occurrences they are.

Candidates are Apriori-safe: a phrase is one only if its words, and for more than two words
the pairs in it, are frequent, and if the occurrences of its hash reach the least count, which
no phrase of that count can fail. A minimal perfect hash gives each candidate a slot; stored
keys tell other phrases apart. Tasks count into numpy arrays by slot, a tree of sums adds the
arrays, and the counts of the two sides of a cut are read by slot.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from quern.llm.common import BitTable, ascii_lower, discard, splitmix, staged, text_batches
from quern.llm.mphf import PerfectHash

LONGEST = 4
WORD = re.compile(r"[^\x20\x09.,;:!?\x0A-\x0D]+")
TOKEN = re.compile(r"[.,;:!?\x0A-\x0D]+|[^\x20\x09.,;:!?\x0A-\x0D]+")
DELIMITERS = frozenset(".,;:!?\n\x0b\x0c\r")
#: Characters of a text, and words of a block, that a task looks at together.
SLICE, BLOCK = 1 << 20, 1_000_000
MOST_WORDS = 800_000
#: Slots of one array that tasks hand on.
CHUNK = 4096


class Hashes(dict):
    """word -> hash, for one language; delimiters and ends of texts are 0."""

    def __init__(self, lang: str):
        self.seed = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"), 12)

    def __missing__(self, word: str) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        h = 0 if not word or word[0] in DELIMITERS else xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"), self.seed) or 1
        self[word] = h
        return h


class Block:
    """Words of some texts in a row: the words, their hashes (0: none may cross it), and whether
    a phrase that ends at it counts here (the words that a slice repeats do not)."""

    def __init__(self):
        self.words, self.hashes, self.fresh, self.langs = [], [], [], []
        self.size = 0

    def add(self, words: list[str], again: int, table: Hashes, lang: str) -> None:
        self.words += words
        self.words.append("")
        self.hashes.append(np.fromiter(map(table.__getitem__, words), np.uint64, len(words)))
        self.hashes.append(np.zeros(1, np.uint64))
        fresh = np.ones(len(words) + 1, bool)
        fresh[:again] = False
        self.fresh.append(fresh)
        self.langs.append((self.size, lang))
        self.size = len(self.words)

    def phrases(self, longest: int, words: BitTable | None = None, pairs: BitTable | None = None):
        """(n, start, key) of the phrases of n words. Phrases with a word that is not in ``words``, or a pair not in ``pairs``, are left out."""
        if not self.size:
            return
        h, fresh = np.concatenate(self.hashes), np.concatenate(self.fresh)
        inside = h != 0
        if words is not None:
            inside[inside] = words.has(h[inside])
        g, ok, linked = h, inside, None
        with np.errstate(over="ignore"):
            for n in range(1, longest + 1):
                if n > 1:
                    if len(h) < n:
                        return
                    last = h[n - 1:]
                    ok = ok[:-1] & inside[n - 1:]
                    g = splitmix(g[:-1] * np.uint64(3) + last)
                    if n == 2 and pairs is not None:
                        ok[ok] = pairs.has(g[ok])
                        linked = ok
                    elif linked is not None:
                        ok &= linked[n - 2:]
                at = np.nonzero(ok & fresh[n - 1:])[0]
                yield n, at, g[at]


def _blocks(batches):
    """Blocks of the rows (text, lang) of a task; long texts come in slices that repeat three tokens."""
    tables: dict[str, Hashes] = {}
    block = Block()
    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
            table, text = tables.setdefault(lang, Hashes(lang)), text.as_py()
            at, carried = 0, []
            while at < len(text):
                end = at + SLICE
                if end < len(text):
                    inside = WORD.match(text, end - 1)
                    end = inside.end() if inside else end
                words = carried + TOKEN.findall(ascii_lower(text[at:end]))
                block.add(words, len(carried), table, lang)
                carried, at = words[1 - LONGEST:], end
                if block.size > BLOCK:
                    yield block
                    block = Block()
    if block.size:
        yield block


def _words_of(batches):
    held: dict[str, Counter] = {}

    def out():
        for lang, n in held.items():
            words = list(n)
            for i in range(0, len(words), 50_000):
                part = words[i: i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.string()),
                                                  pa.array(np.fromiter(map(n.__getitem__, part), np.int64, len(part)))], ["lang", "word", "n"])
        held.clear()

    size = 0
    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
            n, text = held.setdefault(lang, Counter()), text.as_py()
            before, at = len(n), 0
            while at < len(text):
                end = at + SLICE
                if end < len(text):
                    inside = WORD.match(text, end - 1)
                    end = inside.end() if inside else end
                n.update(WORD.findall(ascii_lower(text[at:end])))
                at = end
            size += len(n) - before
            if size > MOST_WORDS:
                yield from out()
                size = 0
    yield from out()


def _keys_of(lengths: tuple[int, ...], words: BitTable, pairs: BitTable | None):
    def run(batches):
        for block in _blocks(batches):
            g = [key for n, _, key in block.phrases(max(lengths), words, pairs) if n in lengths]
            if g and sum(map(len, g)):
                found, n = np.unique(np.concatenate(g), return_counts=True)
                part = TaskContext.get().partitionId()
                for i in range(0, len(found), 100_000):
                    keys = found[i: i + 100_000].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n[i: i + 100_000]), pa.array(np.full(len(keys), part, np.int32))], ["g", "n", "part"])

    return run


def _word_keys(batches):
    tables: dict[str, Hashes] = {}
    for batch in batches:
        h = np.array([tables.setdefault(lang, Hashes(lang))[word] for lang, word in zip(batch.column("lang").to_pylist(), batch.column("word").to_pylist())], np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column("n")], ["g", "n"])


#: Rows of a counting pass: arrays of counts, and names of phrases.
SHAPE = "chunk int, part int, counts binary, slot long, lang string, phrase string"
_COUNTS = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("counts", pa.binary()), ("slot", pa.int64()), ("lang", pa.string()), ("phrase", pa.string())])


def _rows(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _COUNTS], schema=_COUNTS)


def _named(block: Block, begins: np.ndarray, n: int, slots: np.ndarray, starts: np.ndarray):
    """Rows of the language and words of the phrases of n words at ``starts``."""
    for i in range(0, len(slots), 50_000):
        start = starts[i: i + 50_000]
        owner = np.searchsorted(begins, start, "right") - 1
        yield _rows(len(start), slot=slots[i: i + 50_000], lang=[block.langs[o][1] for o in owner.tolist()],
                    phrase=[" ".join(block.words[k: k + n]) for k in start.tolist()])


def _counted(look, words: BitTable, pairs: BitTable):
    """Counts by slot, in chunks, and the language and words of the phrases that this task is to name.
    Single words are counted already."""
    def run(batches):
        table, namer = look.value
        part = TaskContext.get().partitionId()
        counts, named = np.zeros(table.n, np.int64), namer != part
        for block in _blocks(batches):
            begins = np.array([b for b, _ in block.langs])
            for n, at, g in block.phrases(LONGEST, words, pairs):
                if n == 1:
                    continue
                slot = table.find(g)
                at, slot = at[slot >= 0], slot[slot >= 0]
                counts += np.bincount(slot, minlength=table.n)
                fresh = ~named[slot]
                new, first = np.unique(slot[fresh], return_index=True)
                named[new] = True
                yield from _named(block, begins, n, new, at[fresh][first])
        for chunk in range(0, table.n, CHUNK):
            here = counts[chunk: chunk + CHUNK]
            if here.any():
                narrow = here.astype(np.uint32) if here.max() < 1 << 32 else here
                yield _rows(1, chunk=[chunk // CHUNK], part=[part], counts=[narrow.tobytes()])

    return run


def _names(look, words: BitTable, pairs: BitTable):
    """(slot, lang, phrase) of the phrases in ``look``, once for each task that holds them."""
    def run(batches):
        table = look.value
        named = np.zeros(table.n, bool)
        for block in _blocks(batches):
            begins = np.array([b for b, _ in block.langs])
            for n, at, g in block.phrases(LONGEST, words, pairs):
                slot = table.find(g) if n > 1 else np.full(len(g), -1)
                at, slot = at[slot >= 0], slot[slot >= 0]
                fresh = ~named[slot]
                new, first = np.unique(slot[fresh], return_index=True)
                named[new] = True
                yield from _named(block, begins, n, new, at[fresh][first])

    return run


def _array(blob: bytes, size: int) -> np.ndarray:
    return np.frombuffer(blob, np.uint32 if len(blob) == 4 * size else np.int64).astype(np.int64)


def _summed(n: int):
    def run(key, pdf):
        size = min(CHUNK, n - CHUNK * key[0])
        total = np.zeros(size, np.int64)
        for blob in pdf["counts"]:
            total += _array(blob, size)
        return pd.DataFrame({"chunk": [key[0]], "part": [key[1]], "counts": [total.tobytes()]})

    return run


def _tree_sum(rows: DataFrame, n: int) -> np.ndarray:
    """The sum of the tasks' arrays, at most as many as the root of their number at a time."""
    part = rows.where("chunk is not null").select("chunk", "part", "counts")
    fan, three = max(1, round((1 + (part.agg(F.max("part")).first()[0] or 0)) ** 0.5)), "chunk int, part int, counts binary"
    once = part.withColumn("part", F.expr(f"part % {fan}")).groupBy("chunk", "part").applyInPandas(_summed(n), three)
    twice = once.withColumn("part", F.lit(0)).groupBy("chunk", "part").applyInPandas(_summed(n), three)
    total = np.zeros(n, np.int64)
    found = twice.select("chunk", "counts").toArrow()
    for chunk, counts in zip(found["chunk"].to_pylist(), found["counts"].to_pylist()):
        total[chunk * CHUNK: chunk * CHUNK + len(counts) // 8] = np.frombuffer(counts, np.int64)
    return total


def _sides(look):
    """Fills in the counts of the left and right side of each cut whose key is in ``look``."""
    def run(batches):
        table, total = look.value
        tables: dict[str, Hashes] = {}
        for pdf in batches:
            block, sizes = Block(), []
            for lang, phrase in zip(pdf["lang"], pdf["phrase"]):
                words = phrase.split(" ")
                block.add(words, 0, tables.setdefault(lang, Hashes(lang)), lang)
                sizes.append(len(words))
            begins, sizes = np.array([b for b, _ in block.langs]), np.array(sizes)
            found = {}
            for n, at, g in block.phrases(LONGEST - 1):
                slot = table.find(g)
                found[n] = np.full(block.size, -1, np.int64)
                found[n][at[slot >= 0]] = total[slot[slot >= 0]]
            left, right = [list(x) for x in pdf["l"]], [list(x) for x in pdf["r"]]
            for i, (begin, size) in enumerate(zip(begins, sizes)):
                for k in range(1, size):
                    if found[k][begin] >= 0:
                        left[i][k - 1] = int(found[k][begin])
                    if found[size - k][begin + k] >= 0:
                        right[i][k - 1] = int(found[size - k][begin + k])
            yield pd.DataFrame({"lang": pdf["lang"], "phrase": pdf["phrase"], "a": pdf["a"], "l": left, "r": right})

    return run


def mined(docs: DataFrame, least: int = 30, covered: int = 80, top: int = 2000, most_keys: int = 4_000_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of each language of docs (text, lang).

    A phrase of two to four words within a piece of text that occurs ``a`` >= ``least`` times is
    cut in two parts of l and r occurrences where 2000000 * a / (l + r) is least, its score.
    It goes if a longer candidate that holds it has ``covered`` % of its occurrences or more.
    Then the first ``top`` of each language stay, n being the language's words.

    At most ``most_keys`` candidates are counted in one pass over the texts; more take more passes,
    so that no task or driver holds more. Keys are hashes of 64 bits. A null text is empty, a null
    lang ``und``; repeated rows count each time; long texts are read to their end; empty tables give
    an empty result; extra columns are ignored."""
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    words = staged(rows.mapInArrow(_words_of, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    single = staged(words.where(F.col("n") >= least).mapInArrow(_word_keys, "g long, n long"), "keys")
    frequent = BitTable(single, "g", 28)
    double = _frequent_keys(rows, (2,), frequent, None, least)
    pairs = BitTable(double, "g", 28)
    none = F.lit(0).cast("long").alias("n")
    keys = (single.withColumn("part", F.lit(-1)).unionByName(double.withColumn("n", none))
            .unionByName(_frequent_keys(rows, (3, 4), frequent, pairs, least).withColumn("n", none)))
    groups = max(1, -(-keys.count() // most_keys))
    tables, found = [], None
    for group in range(groups):
        look, total, namer = _table(keys.where(F.expr(f"pmod(g, {groups}) = {group}")), "n", "part")
        spread = spark.sparkContext.broadcast((look, namer))
        out = staged(rows.mapInArrow(_counted(spread, frequent, pairs), SHAPE), "counts")
        total += _tree_sum(out, look.n)
        spread.unpersist()
        slots = staged(spark.createDataFrame(pa.table({"slot": np.arange(look.n), "g": look.keys.view(np.int64), "n": total, "part": namer})), "slots")
        tables.append(slots)
        phrases = slots.where((F.col("n") >= least) & (F.col("part") >= 0)).select("slot", "g", F.col("n").alias("a"))
        named = out.where("slot is not null").select("slot", "lang", "phrase")
        named = staged(phrases.join(named, "slot", "left").select("g", "lang", "phrase", "a"), "phrases")
        discard(out)
        named = named.where("phrase is not null").drop("g").unionByName(_late(rows, named.where("phrase is null"), frequent, pairs))
        found = named if found is None else found.unionByName(named)
    cuts = F.expr("transform(sequence(2, size(split(phrase, ' '))), x -> 0L)")
    scored = found.select("lang", "phrase", "a", cuts.alias("l"), cuts.alias("r"))
    for slots in tables:
        scored = staged(scored.mapInPandas(_sides(spark.sparkContext.broadcast(_table(slots, "n"))), "lang string, phrase string, a long, l array<long>, r array<long>"), "sides")
    return _ranked(scored, words, covered, top)


def _late(rows: DataFrame, unnamed: DataFrame, words: BitTable, pairs: BitTable) -> DataFrame:
    """Names for phrases (g, a) whose task did not meet them when it counted, as can be when rows
    are dealt to other tasks than before: each task names what it sees, in a pass of its own."""
    if unnamed.isEmpty():
        return unnamed.select("lang", "phrase", "a")
    look, a = _table(unnamed, "a")
    out = rows.mapInArrow(_names(rows.sparkSession.sparkContext.broadcast(look), words, pairs), SHAPE)
    once = out.groupBy("slot").agg(F.first("lang").alias("lang"), F.first("phrase").alias("phrase"))
    return staged(once.join(rows.sparkSession.createDataFrame(pa.table({"slot": np.arange(look.n), "a": a})), "slot").select("lang", "phrase", "a"), "late")


def _table(keys: DataFrame, *values: str) -> tuple:
    """The perfect hash of the keys g, and each of the values by slot."""
    held = keys.select("g", *values).toArrow()
    g = held["g"].to_numpy().view(np.uint64)
    look = PerfectHash(g)
    order, found = look.find(g), [look]
    for name in values:
        column = held[name].to_numpy()
        found.append(np.empty(len(g), column.dtype))
        found[-1][order] = column
    return tuple(found)


def _frequent_keys(rows: DataFrame, lengths: tuple[int, ...], words: BitTable, pairs: BitTable | None, least: int) -> DataFrame:
    """(g, part): keys of the phrases of these lengths that occur ``least`` times or more, and the
    first task that holds each, which will name it."""
    seen = rows.mapInArrow(_keys_of(lengths, words, pairs), "g long, n long, part int")
    # Tasks have summed already, so rows are dealt as they are.
    return staged(seen.repartition("g").groupBy("g").agg(F.sum("n").alias("n"), F.min("part").alias("part"))
                  .where(F.col("n") >= least).select("g", "part"), "keys")


def _ranked(scored: DataFrame, words: DataFrame, covered: int, top: int) -> DataFrame:
    """The lowest-scoring cut of each phrase that no longer one covers, best first."""
    cut = F.expr("""array_min(transform(l, (x, i) -> struct(
        (cast(a as decimal(19,0)) * 2000000) div cast(x + r[i] as decimal(20,0)) as score, i as k, x as l, r[i] as r)))""")
    inner = F.expr("""explode(flatten(transform(sequence(2, size(w) - 1), n ->
        transform(sequence(1, size(w) - n + 1), i -> array_join(slice(w, i, n), ' ')))))""")
    longer = (scored.select("lang", "a", F.split("phrase", " ").alias("w")).where("size(w) > 2")
              .select("lang", "a", inner.alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most")))
    stay = (scored.join(longer, ["lang", "phrase"], "left").where(F.expr(f"most is null or 100 * cast(most as decimal(19,0)) < {covered} * cast(a as decimal(19,0))"))
            .withColumn("cut", cut).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = stay.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    n = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
