"""Golden cases of the rules, in languages that the test tables lack."""

import math
import random

from pyspark.sql import functions as F

from quern.functions import scope, text as t, vectors as v
from quern.operators import answering, conversation, documents, grouping, hierarchy, lifecycle, retrieval
from quern.plans import registry
from quern.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_language_and_tokens(spark):
    assert [one(spark, t.language(F.lit(x))) for x in ("привет", "是否支持", "hello", "12", "ab вг")] == ["ru", "zh", "en", "und", "ru"]
    assert set(one(spark, t.tokens(F.lit("F-X 是否 DS-1 ds-1 Привет")))) == {"f-x", "是", "否", "ds-1", "привет"}


def test_identifiers_versions_and_scope(spark):
    assert one(spark, t.identifiers(F.lit("ds-k1t320 and 208E/2, abc, H.265"))) == ["DS-K1T320", "208E/2", "H.265"]
    assert one(spark, t.scope_models(F.lit("asks H.264 and DS-K1T320 5.6.11 30 20230427"))) == ["DS-K1T320"]
    got = one(spark, t.version_tokens(F.lit("V5 7.2 build 230427, было 5.6.11")))
    assert {"72", "5611", "230427"} <= set(got)
    assert set(one(spark, t.explicit_models(F.lit("TandemVu TEST-TANDEM-X 7a-b")))) == {"test-tandem-x", "7a-b"}


def test_scope_relations(spark):
    arrays = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    assert one(spark, scope.scope_match(arrays("DS-1"), arrays("DS1"))) == "exact"
    assert one(spark, scope.scope_match(arrays("DS-1"), arrays("DS1T"))) == "family"
    assert one(spark, scope.scope_match(arrays("DS-1"), arrays("DS1", "XX"))) == "conflict"
    assert one(spark, scope.scope_match(arrays(), arrays("A1"))) == "unspecified"
    assert one(spark, scope.verified_scope_match(arrays("DS-1"), arrays())) == "generic"
    assert one(spark, scope.verified_scope_match(arrays("DS-1", "X9"), arrays("DS1"))) == "conflict"


def test_routes_and_aliases(spark):
    ask = lambda q: one(spark, t.route(F.lit(q), t.identifiers(F.lit(q))))
    assert [ask(q) for q in ("есть в наличии?", "Не работает панель", "как сбросить", "DS-K1T320", "ok")] == ["inventory", "fault", "operation", "parameter", "unknown"]
    assert one(spark, t.alias_terms(F.lit("Сброс пароля, палец"))) == ["password", "reset", "forgot", "fingerprint", "fingerprints"]
    assert one(spark, t.context_only(F.lit(" Hik-Connect! "))) and not one(spark, t.context_only(F.lit("hikvision camera")))
    assert one(spark, t.question_parts(F.lit("a? b?\nc?"))) == ["a?", "b?", "c?"]
    assert one(spark, t.redacted(F.lit("x /bot12:AbC_d/send topsecret top"), ["top", "topsecret"])) == "x /bot[REDACTED]/send [REDACTED] [REDACTED]"


def thread(spark, *said):
    rows = [(1, i, a, "u", x) for i, (a, x) in enumerate(said)]
    return spark.createDataFrame(rows, "conv_id long, idx int, author string, root_author string, text string")


def test_roles_and_pairs(spark):
    m = thread(spark, ("u", "Как сбросить пароль"), ("e", "Возможно, проверьте кабель"), ("e", "Нажмите сброс"), ("u", "не работает"), ("e", "ок"), ("u", "Спасибо, заработало"), ("u", "А где кнопка?"))
    assert [r["r"] for r in m.orderBy("idx").select(conversation.role().alias("r")).collect()] == [
        "user_report", "engineer_hypothesis", "engineer_instruction", "observed_result", "unconfirmed_claim", "confirmed_resolution", "user_report"]
    assert sorted(tuple(r)[1:4] for r in conversation.result_relations(m).collect()) == [(3, 2, "confirm_failure"), (5, 4, "confirm_success")]
    qa = conversation.atomic_qa(m).orderBy("position").collect()
    assert [(r["n_replies"], r["n_feedback"], r["status"]) for r in qa] == [(3, 2, "confirmed_resolution"), (0, 0, "unanswered")]
    assert conversation.thread_status(m).first()["status"] == "confirmed_resolution"


def test_lexical_against_python(spark):
    rng = random.Random(1)
    words = "reset admin password device model camera f-x f-y".split()
    q = [(i, " ".join(rng.choices(words, k=rng.randint(0, 5)))) for i in range(12)]
    k = [(i, " ".join(rng.choices(words, k=rng.randint(0, 6))), rng.choice(["f-x", "f-y", "zz", ""])) for i in range(20)]
    want = {}
    for qid, question in q:
        for kid, content, entity in k:
            a, b = set(question.split()), set(content.split()) | ({entity} - {""})
            if a and b:
                s = min(2.0, len(a & b) / math.sqrt(len(a) * len(b)) + (1.0 if entity and entity in question else 0.0))
                if s > 0:
                    want[qid, kid] = round(s, 9)
    got = retrieval.lexical_scores(spark.createDataFrame(q, "qid long, question string"), spark.createDataFrame(k, "id long, content string, entity_name string"),
                                   F.concat_ws(" ", "content", "entity_name"))
    assert {(r["qid"], r["id"]): round(r["lexical"], 9) for r in got.collect()} == want


def test_vectors(spark):
    a, b = F.array(*[F.lit(x) for x in (3.0, 4.0)]), F.array(*[F.lit(x) for x in (4.0, 3.0)])
    assert abs(one(spark, v.cosine(a, b)) - 0.96) < 1e-12
    assert one(spark, v.cosine(a, F.array(F.lit(1.0)))) is None and one(spark, v.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) is None


def test_components_of_a_long_chain(spark):
    spark.sparkContext.setCheckpointDir("/tmp/quern-test-checkpoint")
    chain = [(i, i + 1) for i in range(1000, 1060)] + [(1060, 0), (7, 8), (9, 9)]
    got = {tuple(r) for r in grouping.label_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {(i, 0) for i in [0, *range(1000, 1061)]} | {(7, 7), (8, 7), (9, 9)}


def test_contexts_reset_at_the_budget(spark):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate([4, 4, 4, 20, 1, 9])], "g long, o long, n long")
    assert [tuple(r) for r in documents.packed_contexts(df, "g", "o", "n", 10).orderBy("o").select("o", "part").collect()] == [(0, 1), (1, 1), (2, 2), (3, 3), (4, 4), (5, 4)]


def test_html_blocks(spark):
    html = "<html><script>var p='<p>no</p>'</script><h1>Title <b>x</b></h1><p>one\n two</p><ul><li>a</li></ul><table><tr><td>1</td><td>2</td></tr></table>"
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert [(r["kind"], r["text"]) for r in documents.html_blocks(df).orderBy("block_no").collect()] == [("heading", "Title x"), ("paragraph", "one two"), ("list_item", "a"), ("table", "1 2")]


def test_cycles_and_moves(spark):
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "parent string, child string")
    assert {r["node"] for r in hierarchy.cycles(ring).collect()} == {"a", "b", "c"}
    tree = spark.createDataFrame([("a", "b"), ("b", "c")], "parent string, child string")
    moves = spark.createDataFrame([("c", "a"), ("a", "c")], "parent string, child string")
    assert {tuple(r) for r in hierarchy.would_cycle(tree, moves).collect()} == {("c", "a", True), ("a", "c", False)}


def test_walks_have_no_limit_of_depth(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(11)], "parent string, child string")
    assert {tuple(r) for r in hierarchy.subtree(chain, "n0").collect()} == {(f"n{i}", i) for i in range(12)}
    ring = chain.unionByName(spark.createDataFrame([("n11", "n0")], "parent string, child string"))
    assert hierarchy.cycles(ring).count() == 12 and hierarchy.subtree(ring, "n0").count() == 12
    counts = spark.createDataFrame([("n11", 3)], "node string, n long")
    assert {r["total"] for r in hierarchy.subtree_counts(chain, counts).collect()} == {3}
    assert hierarchy.would_cycle(chain, spark.createDataFrame([("n11", "n0")], "parent string, child string")).first()["would_cycle"]
    versions = spark.createDataFrame([(i, i - 1 if i else None) for i in range(9)] + [(20, 21), (21, 22), (22, 21)], "doc_id long, previous_id long")
    want = {(i, j, i - j) for i in range(9) for j in range(i + 1)} | {(20, 20, 0), (20, 21, 1), (20, 22, 2), (21, 21, 0), (21, 22, 1), (22, 22, 0), (22, 21, 1)}
    got = [tuple(r) for r in documents.lineage(versions).collect()]
    assert len(got) == len(want) and set(got) == want


def test_affected_when_a_global_section_changed(spark):
    cites = spark.createDataFrame([(1, "x"), (2, "y")], "knowledge_id long, section string")
    some = spark.createDataFrame([("x", "changed"), ("z", "added")], "section string, change string")
    every = spark.createDataFrame([("global", "changed")], "section string, change string")
    assert {r[0] for r in documents.affected(cites, some).collect()} == {1}
    assert {r[0] for r in documents.affected(cites, every).collect()} == {1, 2}


def test_decisions(spark):
    arr = F.array(*[F.lit(i) for i in (3, 1, 9, 1, 0)])
    assert one(spark, answering.valid_citations(arr, F.lit(3))) == [1, 3]
    assert one(spark, answering.ceiling(F.lit("verified"), F.lit("family"), F.lit(0.99))) == 0.8
    assert one(spark, lifecycle.retry_at(F.lit(4), F.lit("2024-01-01 00:00:00").cast("timestamp"))) is None


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "q": "x"}\n{"id": 1, "q": "y"}\n{"id": 2}\n{"id": 3, "q": "z"}\n')
    good, bad = files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id long, q string", ["q"], "id")
    assert [r["id"] for r in good.collect()] == [3] and sorted(r["reason"] for r in bad.collect()) == ["missing_field", "repeated_key", "repeated_key"]
    assert one(spark, files.last_json(F.lit('x {"a": 1} then {"b": 2} {no}'))) == '{"b": 2}'


def test_long_lineages_are_not_stored(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "STRETCH", 4)
    monkeypatch.setattr(documents, "reachable", None)  # the closure, which holds every pair, is not needed
    links = [(i, i - 1 if i else None) for i in range(11)] + [(20, 21), (40, None), (30, 31), (31, 32)]
    versions = spark.createDataFrame(links, "doc_id long, previous_id long")
    want = {(i, j, i - j) for i in range(11) for j in range(i + 1)} | {(20, 20, 0), (20, 21, 1), (40, 40, 0), (30, 30, 0), (30, 31, 1), (30, 32, 2), (31, 31, 0), (31, 32, 1)}
    got = [tuple(r) for r in documents.lineage(versions).collect()]
    assert len(got) == len(want) and set(got) == want
    fork = spark.createDataFrame([(1, 0), (2, 0)], "node long, previous long")
    assert hierarchy.places(fork) is None


def test_numbered_lineages_take_no_rounds(spark, monkeypatch):
    """Numbers that are the links' own save the numbering; wrong ones, gaps, forks and nulls do not pass."""
    monkeypatch.setattr(hierarchy, "STRETCH", 4)
    good = [(i * 3 % 31, (i * 3 - 3) % 31 if i else None, "a", i + 1) for i in range(11)] + [(100, None, "b", 1), (99, 100, "b", 2)]
    wrong = {"turned": [(1, 2, "a", 1), (2, None, "a", 2)], "gap": [(1, None, "a", 1), (2, None, "a", 3)], "from 2": [(1, None, "a", 2)], "null root": [(1, None, None, 1)],
             "twice": [(1, None, "a", 1), (1, None, "b", 1)], "no version": [(1, 7, "a", 1)], "same number": [(1, None, "a", 1), (2, None, "a", 1)], "null": [(None, None, "a", 1)]}
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, previous_id long, source string, version_no int")
    links = lambda rows: frame(rows).selectExpr("doc_id node", "previous_id previous", "source root", "version_no number")
    assert [name for name, rows in wrong.items() if hierarchy.numbered_places(links(rows)) is not None] == []
    want = sorted(tuple(r) for r in documents.lineage(frame(good)).collect())
    turned = sorted(tuple(r) for r in documents.lineage(frame(wrong["turned"]), numbered=("source", "version_no")).collect())
    assert turned == [(1, 1, 0), (1, 2, 1), (2, 2, 0)]
    monkeypatch.setattr(documents, "places", None)  # rounds of joins are not needed
    assert sorted(tuple(r) for r in documents.lineage(frame(good), numbered=("source", "version_no")).collect()) == want and len(want) == 69
    assert registry.QUERIES["d08_whole_lineage"](spark, "/root/testdata/sf0.001").count() > 200
