import hashlib
import math
import random

import numpy as np
import xxhash

from quern.llm import common, multi_index, simhash, substring
from tests.llm.fixtures import documents, empty, prose, rows, table


def test_components_and_forest(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = common.components(spark.createDataFrame(edges + [(None, 3)], "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i: i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def test_simhash_against_brute_force(spark):
    data = rows()
    prints = [brute_fingerprint(r[1]) for r in data]
    label = list(range(len(data)))
    for _ in data:
        for i in range(len(data)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    groups = {}
    for k, r in zip(label, data):
        if r[0] is not None:
            groups[k] = min(groups.get(k, 10**9), r[0])
    want = sorted([(r[0], simhash_signed(p), groups.get(k)) for r, p, k in zip(data, prints, label)], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    got = sorted([tuple(r) for r in simhash.near_duplicates(documents(spark)).collect()], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert got == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


def simhash_signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_links_lose_nothing_in_a_dense_bucket(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    prints = {base}
    while len(prints) < 700:
        x = base
        for b in rng.sample(range(64), rng.randint(1, 4)):
            x ^= 1 << b
        prints.add(x)
    prints |= {rng.getrandbits(64) for _ in range(300)}
    prints = sorted(prints)
    df = spark.createDataFrame([(i, simhash_signed(p)) for i, p in enumerate(prints)], "id long, fp long")
    want = {(i, j) for j in range(len(prints)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 3}
    got = {tuple(sorted(r)) for r in simhash.links(df).collect()}
    assert got == want


def test_deduplicated_keeps_columns_and_one_of_each_group(spark):
    docs = documents(spark)
    out = simhash.deduplicated(docs)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert 1 in ids and 3 not in ids and ids.count(None) == 2


def brute_near_copies(data):
    """The least id of each id's group over all pairs with a 5-word Jaccard similarity of 0.8 or more."""
    sets = {}
    for i, text in data:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k: k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    least = {i: i for i in sets}
    near = [(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in near:
            least[a] = least[b] = min(least[a], least[b])
    return least


def test_deduplicated_against_brute_force(spark):
    rng, data = random.Random(5), []
    passage = prose(77, 60)
    for group in range(12):
        base = prose(300 + group, rng.randint(20, 160)).split() + (passage.split() if group % 2 else [])
        for _ in range(8):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = "changed" + str(rng.randrange(1000))
            data.append((len(data), " ".join(words)))
    data += [(len(data) + i, t) for i, t in enumerate([None, "", "a b", "A  b", "a b c", passage, passage + " more"])]
    want = brute_near_copies(data)
    assert len(set(want.values())) < len(want) - 20
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in simhash.deduplicated(docs).collect()} == set(want.values())


def test_stage_links_confirmed_fingerprints(spark):
    """Near copies of the pipeline's stage: fingerprints connected over 3 bits and a similarity of 0.5, or one of 0.8."""
    import corpus_pipeline

    rng, data = random.Random(3), []
    for group in range(8):
        base, often = prose(500 + group, 100).split(), (prose(600 + group, 60) + " ") * 6
        for _ in range(6):
            words = list(base)
            for _ in range(rng.randint(0, 14)):
                words[rng.randrange(len(words))] = "changed" + str(rng.randrange(1000))
            data.append((len(data), often + " ".join(words)))
    hollow = [prose(900 + i % 4, 60) + " same" * 200 + (" more" if i > 3 else "") for i in range(6)]  # one fingerprint, four texts
    data += [(len(data) + i, t) for i, t in enumerate([None, "", "a b", "A  b", "a b c", *hollow])]
    words = {i: (t or "").encode().lower().split() for i, t in data}
    sets = {i: {tuple(w[k: k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    prints = {i: brute_fingerprint(t) for i, t in data}

    def least(linked):
        low, pairs = {i: i for i in sets}, [(a, b) for a in sets for b in sets if a < b and linked(a, b)]
        for _ in sets:
            for a, b in pairs:
                low[a] = low[b] = min(low[a], low[b])
        return low

    alike = lambda a, b, percent: 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    connected = least(lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    want = set(least(lambda a, b: alike(a, b, 80) or connected[a] == connected[b] and alike(a, b, 50)).values())
    by_shingles = set(brute_near_copies(data).values())
    first = len(data) - 6
    assert want < by_shingles and len(by_shingles) - len(want) > 2 and len({connected[first + i] for i in range(6)}) == 1 and {first + i for i in range(4)} <= want
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want
    assert {r["doc_id"] for r in simhash.deduplicated(docs).collect()} == by_shingles


def brute_substring(data, window=50):
    first = {}
    words = [(r[1] or "").encode().split() for r in data]
    for r, w in zip(data, words):
        if r[0] is not None:
            for k in range(len(w) - window + 1):
                s = tuple(w[k: k + window])
                first[s] = min(first.get(s, r[0]), r[0])
    out = []
    for r, w in zip(data, words):
        gone, starts = [False] * len(w), set()
        if r[0] is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k: k + window])] < r[0]:
                    starts.add(k)
                    gone[k: k + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((r[0], len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), sum(k - 1 not in starts for k in starts)))
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, x[1:]))


def test_substring_against_brute_force(spark):
    got = sorted([tuple(r) for r in substring.digests(documents(spark)).collect()], key=lambda x: (x[0] is not None, x[0] or 0, x[1:]))
    assert got == brute_substring(rows())
    assert substring.digests(empty(spark)).count() == 0


def test_substring_random_repeats(spark):
    rng = random.Random(9)
    pool = [str(rng.randint(0, 3)) for _ in range(2000)]
    data = []
    for i in range(40):
        text = []
        for _ in range(rng.randint(0, 6)):
            a = rng.randint(0, 1900)
            text += pool[a: a + rng.randint(5, 100)]
        data.append((rng.randint(0, 10**6), " ".join(text)))
    got = sorted(tuple(r) for r in substring.digests(spark.createDataFrame(data, "doc_id long, text string")).collect())
    assert got == brute_substring(data)


def test_maximal_repeats(spark):
    shared, other = prose(1, 80).split(), prose(2, 60).split()
    data = [(1, " ".join(shared)), (2, " ".join(other)), (5, " ".join(prose(3, 7).split() + shared[5:75] + ["x"] + other)), (6, " ".join(shared[:49]))]
    got = substring.repeats(spark.createDataFrame(data, "doc_id long, text string")).select("doc_id", "begin", "n_words")
    assert sorted(tuple(r) for r in got.collect()) == [(5, 7, 70), (5, 78, 60)]


def test_hot_stretches_are_broadcast(spark, monkeypatch):
    """Stretches of very many documents take another way to the same result."""
    real = common.with_classes
    data = [(i, prose(100 + i % 3, 15) + " " + prose(1, 70)) for i in range(40)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = sorted(tuple(r) for r in substring.digests(df).collect())

    def all_hot(rows_, classes, key, size):
        return real(rows_, classes.withColumn(size, common.F.col(size) * 1_000_000), key, size)

    monkeypatch.setattr(substring, "with_classes", all_hot)
    assert sorted(tuple(r) for r in substring.digests(df).collect()) == want == brute_substring(data)


def test_full_depth_nodes_by_hand():
    rng = np.random.default_rng(1)
    for depth in (1, 2, 3, 5, 8, 50):
        spans = [rng.integers(0, 2, rng.integers(depth, depth + 30)).astype(np.uint64) for _ in range(40)]
        counts = np.array([len(s) - depth + 1 for s in spans])
        owner, node = substring._full_depth(spans, counts, depth)
        suffixes = [tuple(s[i: i + depth]) for s in spans for i in range(len(s) - depth + 1)]
        assert owner.tolist() == [k for k, n in enumerate(counts) for _ in range(n)]
        names = {}
        assert all(names.setdefault(n, s) == s for n, s in zip(node.tolist(), suffixes)) and len(names) == len(set(suffixes))


def test_lengthened_prefixes_give_the_same_cuts(spark):
    shared = prose(1, 70)
    data = [(i, prose(100 + i, 20) + " " + shared + " " + prose(300 + i, 20)) for i in range(30)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    show = lambda r: sorted((x["doc_id"], sorted((c["place"], c["mask"]) for c in x["cuts"])) for x in r.collect())
    whole = show(substring.removals(df))
    assert len(whole) == 29 and whole == show(substring.removals(df, group_rows=3)) == show(substring.removals(df, most_bits=20, group_rows=1))


def test_stages_take_tables_with_names_of_their_own(spark):
    from quern.llm import language, mixing

    names = "__hash __salt __lang __cuts __id __key __copies __copy __cut_hash ___lang".split()
    docs = documents(spark)
    for n in names:
        docs = docs.withColumn(n, common.F.concat(common.F.lit(n), common.F.col("doc_id").cast("string")))
    for out in (language.identified(docs, language.fit(docs)), simhash.deduplicated(docs), substring.deduplicated(docs), mixing.mixed(docs)):
        assert out.columns == docs.columns
        for r in out.where("doc_id is not null").limit(20).collect():
            assert all(r[n] == f"{n}{r['doc_id']}" for n in names)


def test_long_paths_are_one_component(spark):
    rng = random.Random(6)
    ids = rng.sample(range(10_000), 300)
    got = common.components(spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")).collect()
    assert {r["node"] for r in got} == set(ids) and {r["component"] for r in got} == {min(ids)}


def test_substring_text_keeps_the_rest(spark):
    docs = documents(spark)
    out = substring.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    want = {x[0]: x[3] for x in brute_substring(rows()) if x[0] is not None}
    for r in out.where("doc_id is not null").collect():
        assert hashlib.sha256(b" ".join((r["text"] or "").encode().split())).hexdigest() == want[r["doc_id"]]


def vectors():
    rng = np.random.default_rng(3)
    out, n = [], 0

    def add(v, label):
        nonlocal n
        out.append((n, None if v is None else [None if x is None else float(x) for x in v], label, 7, "x"))
        n += 1

    for label in (0, 1, None):
        centre = rng.standard_normal(16)
        for _ in range(60):
            add(rng.standard_normal(16), label)
        for _ in range(40):
            add(centre + rng.standard_normal(16) * 0.06, label)
        for _ in range(5):
            add(centre * 2, label)
    add([0.0] * 16, 0)
    add(None, 0)
    add([], 0)
    add([math.nan] + [1.0] * 15, 0)
    add([math.inf] + [1.0] * 15, 0)
    add([None] + [1.0] * 15, 1)
    add([1.0, 0.0], 1)
    add([2.0, 0.0], 1)
    add([3.0], 1)
    out.append(out[5])
    return out


def test_multi_index_against_brute_force(spark):
    data = vectors()
    fine = [v is not None and len(v) > 0 and None not in v and all(map(math.isfinite, v)) and any(v) and label is not None for _, v, label, *_ in data]
    links = [set() for _ in data]
    for i in range(len(data)):
        for j in range(i):
            if fine[i] and fine[j] and data[i][2] == data[j][2] and len(data[i][1]) == len(data[j][1]):
                a, b = np.array(data[i][1]), np.array(data[j][1])
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
                    links[i].add(j)
                    links[j].add(i)
    label = [r[0] for r in data]
    for _ in data:
        label = [min([label[i]] + [label[j] for j in links[i]]) for i in range(len(data))]
    want = sorted((r[0], len(links[i]), label[i], r[0] == label[i]) for i, r in enumerate(data))
    df = spark.createDataFrame(data + [(None, [1.0] * 16, 0, 1, "x")], "vec_id long, embedding array<float>, label int, n int, unit string")
    got = sorted(tuple(r) for r in multi_index.near_vectors(df).collect() if r[0] is not None)
    exact = sum(x[1] for x in got) / sum(x[1] for x in want)
    assert exact >= 0.99 and all(a[1] <= b[1] for a, b in zip(got, want))
    assert [x for x in got if x[1] == 0] == [x for x in want if x[1] == 0]
    assert sum(a == b for a, b in zip(got, want)) >= 0.99 * len(want)
    assert [tuple(r) for r in multi_index.near_vectors(df).where("vec_id is null").collect()] == [(None, 0, None, False)]
    assert multi_index.near_vectors(df.where("false")).count() == 0


def test_traversal_visits_cells_in_order():
    rng = np.random.default_rng(2)
    for _ in range(30):
        first, second = rng.random(rng.integers(1, 12)), rng.random(rng.integers(1, 12))
        first[0] = second[-1] = 0
        far = rng.random() * 1.5
        got = multi_index.traverse(first, second, far)
        want = {(i, j) for i in range(len(first)) for j in range(len(second)) if first[i] + second[j] <= far}
        assert len(got) == len(set(got)) and set(got) == want
        sums = [first[i] + second[j] for i, j in got]
        assert sums == sorted(sums)


def test_multi_index_with_tiles_and_real_near_pairs(spark, monkeypatch):
    """Perturbed vectors around many centres; cells of more rows than a tile holds."""
    monkeypatch.setattr(multi_index, "TILE", 16)
    monkeypatch.setattr(multi_index, "CUT", 1)
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((60, 24))
    x = np.concatenate([c + rng.standard_normal((rng.integers(1, 40), 24)) * 0.11 for c in centres] + [rng.standard_normal((300, 24))]).astype(np.float32)
    label = rng.integers(0, 2, len(x))
    data = [(int(i), v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))]
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r for r in multi_index.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")).collect()}
    links = near.sum(axis=1)
    assert links.sum() > 1500 and all(got[i]["n_links"] <= links[i] for i in got)
    assert sum(r["n_links"] for r in got.values()) >= 0.99 * links.sum()


def test_multi_index_under_label_skew(spark, monkeypatch):
    """One label of 3,000 vectors, one of 300, 500 of one or two: cells stay as small as with one label alone."""
    monkeypatch.setattr(multi_index, "TILE", 32)
    fits = []
    plain = multi_index.fit
    monkeypatch.setattr(multi_index, "fit", lambda sample, rows, *rest: fits.append((rows, plain(sample, rows, *rest))) or fits[-1][1])
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((400, 24))
    label = np.array([0] * 3000 + [1] * 300 + list(range(2, 502)) + list(range(2, 252)))
    x = (centres[rng.integers(0, 400, len(label))] + rng.standard_normal((len(label), 24)) * 0.1).astype(np.float32)
    x[-250:] = x[3300:3550] * 2  # each of these meets its double in a label of two
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))], "vec_id long, embedding array<float>, label int")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    links = near.sum(axis=1)
    got = {r["vec_id"]: r for r in multi_index.near_vectors(df).collect()}
    assert links[3300:].sum() == 500 and links[:3000].sum() > 1500
    assert all(got[i]["n_links"] <= links[i] for i in got) and all(got[i]["n_links"] == links[i] for i in range(3300, len(x)))
    assert sum(r["n_links"] for r in got.values()) >= 0.99 * links.sum()
    assert sorted(rows for rows, _ in fits) == [300, 3000]
    for rows, grid in fits:
        own, _ = grid.visit(multi_index._units(x[:3000] if rows == 3000 else x[3000:3300]))
        assert np.bincount(own).max() <= 8 * 32


def test_classes_of_many_rows_are_spread(spark):
    rows = spark.createDataFrame([(i, 0 if i < 20_000 else i % 50) for i in range(30_000)], "id long, k long")
    classes = rows.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "k * 2 AS v")
    out = common.with_classes(rows, classes.where("k <> 7"), ["k"], "n")
    assert out.count() == 30_000 and out.where("v is null").count() == rows.where("k = 7").count()
    assert out.where("v <> 2 * k").count() == 0 and "BroadcastHashJoin" in out._jdf.queryExecution().toString()


def test_plans_have_no_cross_join(spark):
    plan = simhash.near_duplicates(documents(spark))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_tables_are_whole(spark):
    assert len(table(simhash.near_duplicates(documents(spark)))) == len(rows())
