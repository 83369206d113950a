"""Golden cases of the operators on records: literal rows in, literal rows out."""

import io
import random
import zipfile

from pyspark.sql import functions as F

from quern.functions import phrases
from quern.operators import answering, documents, grouping, hierarchy, knowledge, learning, lifecycle, organization, retrieval, review, workflow
from quern.sources import files, slides


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


BLOCKS = "version_id long, block_id long, ord long, section string, state string, text string"


def blocks(spark):
    return spark.createDataFrame([
        (1, 10, 1, "Setup", "pending", "a" * 60), (1, 11, 2, "Setup", "pending", "b" * 60), (1, 12, 3, "Use", "pending", "c" * 500),
        (1, 13, 4, "Use", "evidence_only", "d"), (1, 14, 5, "Use", "needs_review", "e"), (2, 20, 1, "Setup", "knowledge", "f")], BLOCKS)


def test_one_job_for_each_context_and_key(spark):
    jobs = spark.createDataFrame([("learn:1:use#1", "learn", "completed")], "idempotency_key string, stage string, status string")
    got = rows(learning.queued_jobs(blocks(spark), jobs, 100).select("context_key", "block_ids", "n_chars", "idempotency_key"))
    assert got == [("Setup#1", [10], 60, "learn:1:setup#1"), ("Setup#2", [11], 60, "learn:1:setup#2")]
    again = learning.queued_jobs(blocks(spark), jobs.unionByName(learning.queued_jobs(blocks(spark), jobs, 100).select("idempotency_key", F.lit("learn").alias("stage"), F.lit("queued").alias("status"))), 100)
    assert again.count() == 0
    anew = learning.queued_jobs(blocks(spark), jobs, 100, reset=True).select("context_key", "block_ids")
    assert rows(anew) == [("Setup#1", [10]), ("Setup#2", [11]), ("Use#1", [12]), ("Use#2", [13])]
    running = spark.createDataFrame([("learn:1:use#1", "learn", "processing")], "idempotency_key string, stage string, status string")
    assert "Use#1" not in [r[0] for r in rows(learning.queued_jobs(blocks(spark), running, 100, reset=True).select("context_key"))]


def test_job_blocks_are_those_of_its_version(spark):
    jobs = spark.createDataFrame([(7, 1, [11, 10, 10, 20, 99])], "job_id long, version_id long, block_ids array<long>")
    assert [r[:3] for r in rows(learning.job_blocks(jobs, blocks(spark)), "ord")] == [(7, 10, 1), (7, 11, 2)]


def test_outcomes_of_jobs(spark):
    jobs = spark.createDataFrame([(1, "learn", 0, None, ""), (2, "learn", 0, "OSError", "x" * 3000), (3, "parse", 4, "OSError", ""), (4, "learn", 0, "DocumentLearnError", "no units")],
                                 "job_id long, stage string, attempts int, error string, message string")
    got = rows(learning.job_outcomes(jobs).select("job_id", "next_status", "delay", "version_status", F.length("said")))
    assert got == [(1, "completed", None, None, 0), (2, "queued", 60, None, 2000), (3, "failed", None, "failed", 0), (4, "failed", None, "learning_failed", 8)]


def test_unused_blocks_are_shelved_and_versions_complete(spark):
    b = blocks(spark)
    after = learning.shelved(b, b.where("version_id = 1").select("block_id"), b.where("block_id = 11").select("block_id"))
    assert {r["block_id"]: r["state"] for r in after.collect()} == {10: "evidence_only", 11: "pending", 12: "evidence_only", 13: "evidence_only", 14: "needs_review", 20: "knowledge"}
    assert {r["block_id"]: r["reason"] for r in after.collect()}[14] is None
    versions = spark.createDataFrame([(1, "learning"), (2, "learning"), (3, "parsed"), (4, "learning")], "version_id long, status string")
    jobs = spark.createDataFrame([(4, "learn", "queued"), (2, "learn", "completed"), (2, "parse", "queued")], "version_id long, stage string, status string")
    assert rows(learning.completed_versions(versions, jobs, b)) == [(1, "learning"), (2, "complete"), (3, "parsed"), (4, "learning")]


def test_confirming_a_unit_is_idempotent_and_moves_its_blocks(spark):
    source = [(10, "first"), (11, "second"), (10, "again")]
    p = spark.createDataFrame([
        (1, "pending_confirmation", 1, "confirmed_copy", "", " Line one\nLine two ", None, source), (2, "confirmed", 1, "x", "T", "f", None, source), (3, "pending_confirmation", None, "x", "T", "f", None, source),
        (4, "rejected", 1, "x", "T", "f", None, source), (5, "pending_confirmation", 1, "x", "T", "f", "  ", source), (6, "pending_confirmation", 1, "x", "T", "f", None, [])],
        "proposal_id long, status string, version_id long, authenticity string, unit_title string, fact_text string, edited string, sources array<struct<block_id:long,excerpt:string>>")
    c = learning.confirmations(p)
    assert rows(c.select("proposal_id", "outcome")) == [(1, "ok"), (2, "already"), (3, "not_a_document_proposal"), (4, "not_pending"), (5, "empty_content"), (6, "no_source")]
    assert rows(c.where("proposal_id = 1").select("title", "content", "source_kind")) == [("Line one", "Line one\nLine two", "official_document")]
    links = learning.confirmed_links(c)
    assert rows(links) == [(1, 10, "official_document", "first"), (1, 11, "official_document", "second")]
    assert rows(learning.known_blocks(blocks(spark), links).where("state = 'knowledge'").select("block_id")) == [(10,), (11,), (20,)]


def test_guards_of_new_records(spark):
    known = spark.createDataFrame([(1, 5, "supports")], "knowledge_id long, evidence_id long, relation string")
    new = spark.createDataFrame([(1, 5, "supports", 1, "a"), (1, 5, "contradicts", 2, "y" * 5000), (1, 5, "contradicts", 3, "z"), (2, 5, "supports", 4, "b")],
                                "knowledge_id long, evidence_id long, relation string, seq int, excerpt string")
    got = rows(learning.linked_sources(known, new))
    assert [(r[0], r[2], len(r[3])) for r in got] == [(1, "contradicts", 4000), (2, "supports", 1)]
    facts = spark.createDataFrame([("CONFLICT", "pending_confirmation"), ("GUESS", "pending_confirmation"), ("NEW", "confirmed")], "decision string, status string")
    assert [(r["error"], r["proposed_trust"]) for r in learning.opened_proposals(facts).collect()] == [("ok", "conflicted"), ("unknown_decision", "provisional"), ("invalid_status", "provisional")]
    made = learning.created_knowledge(spark.createDataFrame([("provisional",), ("conflicted",), (None,)], "trust string")).collect()
    assert [(r["error"], r["active"]) for r in made] == [("ok", True), ("ok", False), ("unknown_trust", None)]


def test_batches(spark):
    facts = spark.createDataFrame([(1, 1, "NEW", "clear"), (1, 2, "CONFLICT", "uncertain"), (1, 3, "NEW", "vague_version"), (1, 4, "UNCLEAR", "clear"), (1, 1, "ENRICH", "clear")],
                                  "batch_id long, segment_no int, decision string, clarity string")
    assert rows(learning.bulk_lists(facts)) == [(1, [1], [3, 4], [2])]
    p = spark.createDataFrame([(1, 1, "pending_confirmation", False, False, False), (1, 2, "pending_confirmation", False, True, False), (1, 3, "pending_clarification", False, False, False),
                               (1, 4, "pending_confirmation", True, False, False), (1, 5, "pending_confirmation", False, False, False), (2, 1, "pending_confirmation", False, False, False)],
                              "batch_id long, segment_no int, status string, paused boolean, derived boolean, individual boolean")
    assert rows(learning.batch_counts(p)) == [(1, 2, 2), (2, 1, 0)]
    some = spark.createDataFrame([(1, [5, 2])], "batch_id long, numbers array<int>")
    assert [(r[0], r[1]) for r in rows(learning.batch_confirmed(p, some)) if r[2] == "confirmed"] == [(1, 5)]
    every = spark.createDataFrame([(1, None)], "batch_id long, numbers array<int>")
    assert [(r[0], r[1]) for r in rows(learning.batch_confirmed(p, every)) if r[2] == "confirmed"] == [(1, 1), (1, 5)]


def test_evidence_goes_on_as_copies_in_order(spark):
    hits = spark.createDataFrame([("q", 2, 8, "B" * 600, "c" * 3000, "e", [("manual", "x" * 1500, None, "p. 2")]), ("q", 1, 9, " A ", None, None, None)],
                                 "qid string, rank int, id long, title string, content string, entity_name string, sources array<struct<source_kind:string,excerpt:string,source_label:string,source_locator:string>>")
    p = answering.evidence_payload(hits)
    got = p.orderBy("index").collect()
    assert [(r["index"], r["knowledge_id"], len(r["title"]), len(r["content"]), len(r["sources"])) for r in got] == [(0, 9, 1, 0, 0), (1, 8, 500, 2000, 1)]
    assert len(got[1]["sources"][0]["excerpt"]) == 1000 and got[1]["sources"][0]["source_label"] == ""
    cited = spark.createDataFrame([("q", [1, 7, 0])], "qid string, indexes array<int>")
    snapshot = answering.evidence_snapshot(p, cited)
    assert [(r["place"], r["evidence_index"], r["knowledge_id"]) for r in snapshot.orderBy("place").collect()] == [(0, 1, 8), (2, 0, 9)]
    originals = spark.createDataFrame([("q", 0, "block"), ("z", 0, "alone")], "qid string, evidence_index long, title string")
    both = answering.joined_snapshots(snapshot.select("qid", "evidence_index", "title"), originals)
    assert [(r["qid"], r["evidence_index"]) for r in both.orderBy("qid", "evidence_index").collect()] == [("q", 0), ("q", 1), ("q", 2), ("z", 0)]


def test_reading_originals_never_lowers_an_answer(spark):
    def after(status, n, large, failed, decision, conflict, reason=""):
        return tuple(one(spark, answering.after_originals(*[F.lit(x) for x in (status, n, large, failed, decision, conflict, reason)])))

    assert after("answered", 0, False, False, "unsupported", True) == ("answered", None)
    assert after("answered", 2, False, True, "unsupported", True) == ("answered", None)
    assert after("answered", 2, False, False, "unsupported", False) == ("answered", None)
    assert after("answered", 2, False, False, "answered", False) == ("answered", "document_verified_answer")
    assert after("unsupported", 2, False, False, "answered", False) == ("answered", "grounded_document_fallback")
    assert after("answered", 2, False, False, "unsupported", True) == ("unsupported", "knowledge_document_conflict")
    assert after("unsupported", 2, False, False, "unsupported", False, "language_mismatch") == ("unsupported", "language_mismatch")
    assert after("unsupported", 1, True, False, "answered", False) == ("needs_clarification", "document_section_too_large")
    reason = lambda e, s, m: one(spark, answering.failure_reason(F.lit(e), F.lit(s).cast("int"), F.lit(m)))
    assert [reason("APITimeoutError", None, ""), reason("StatusError", 429, ""), reason("ValueError", None, "no JSON"), reason("ValueError", None, "x")] == [
        "llm_timeout", "llm_rate_limited", "llm_bad_response", "llm_error"]


def test_asking_for_the_model(spark):
    hits = spark.createDataFrame([(1, "DS-1"), (1, "ds-2"), (1, ""), (2, "DS-1"), (2, "ds-1"), (3, "A"), (3, "B")], "qid int, scope string")
    asked = spark.createDataFrame([(1, []), (2, []), (3, ["A"])], "qid int, models array<string>")
    assert rows(answering.ask_for_model(hits, asked)) == [(1, ["DS-1", "DS-2"])]


def proposal(spark, **changes):
    base = dict(action="CREATE_RELATION", subject="DS-K1", target="Access Panels", new_entity=None, evidence_quote="DS-K1 belongs to Access Panels", confidence="explicit", reason="said",
                content="We note: ds-k1 belongs to access  panels.", excerpts=["DS-K1 is part"], current_entity="ds-k1", current_parent=None, target_known=True, target_active=True)
    schema = ("action string, subject string, target string, new_entity string, evidence_quote string, confidence string, reason string, content string, excerpts array<string>, "
              "current_entity string, current_parent string, target_known boolean, target_active boolean")
    row = base | changes
    return organization.checked(spark.createDataFrame([tuple(row.values())], schema)).first()["error"]


def test_proposals_need_stated_evidence(spark):
    assert proposal(spark) == "ok"
    assert proposal(spark, action="GUESS") == "unknown_action"
    assert proposal(spark, confidence="sure") == "invalid_confidence"
    assert proposal(spark, target=" ") == "relation_needs_both_names"
    assert proposal(spark, action="CREATE_ENTITY", subject="") == "entity_needs_a_name"
    assert proposal(spark, evidence_quote="") == "no_quote"
    assert proposal(spark, confidence="ambiguous") == "ambiguous"
    assert proposal(spark, reason=" ") == "no_reason"
    assert proposal(spark, action="NO_CHANGE", evidence_quote="", reason="", confidence="ambiguous") == "unchanged"
    assert proposal(spark, content="other", excerpts=["x"]) == "quote_not_in_evidence"
    assert proposal(spark, content="other", excerpts=["He said DS-K1 belongs to Access Panels!"]) == "ok"
    assert proposal(spark, current_entity="DS-K2") == "subject_out_of_scope"
    assert proposal(spark, evidence_quote="DS-K1 and Access Panels", content="DS-K1 and Access Panels") == "no_parent_relation_said"
    assert proposal(spark, evidence_quote="DS-K1. It is Access Panels", content="DS-K1. It is Access Panels") == "no_parent_relation_said"
    assert proposal(spark, evidence_quote="DS-K1属于Access Panels", content="DS-K1属于Access Panels") == "ok"
    assert proposal(spark, target_known=False) == "unknown_target"
    assert proposal(spark, target_known=False, new_entity="access panels") == "ok"
    assert proposal(spark, new_entity="Doors") == "new_entity_not_in_quote"
    assert proposal(spark, target_active=False) == "inactive_target"
    assert proposal(spark, current_parent="Doors") == "needs_a_move"
    assert proposal(spark, action="MOVE_RELATION") == "nothing_to_move"
    assert proposal(spark, action="MOVE_RELATION", current_parent="ACCESS panels") == "already_there"
    assert proposal(spark, action="MOVE_RELATION", current_parent="Doors") == "ok"


def test_provenance_rules(spark):
    def error(kind, text, source, trust, active=True):
        return one(spark, organization.provenance_error(F.lit(kind), F.lit(text), F.lit(source).cast("long"), F.lit(trust).cast("string"), F.lit(active)))

    assert error("explicit_user_confirmation", "said", None, None) == "ok"
    assert error("official_source", "said", None, None) == "needs_a_source"
    assert error("official_source", "said", 3, None) == "source_not_found"
    assert error("official_source", "said", 3, "user_confirmed") == "needs_official_source"
    assert error("explicit_user_confirmation", "said", 3, "official_source") == "needs_user_confirmed"
    assert error("user_confirmed", "said", 3, "official_source") == "ok"
    assert error("user_confirmed", "said", 3, "provisional") == "untrusted_source"
    assert error("user_confirmed", "said", 3, "official_source", False) == "inactive_source"
    assert error("user_confirmed", " ", 3, "official_source") == "no_text" and error("guess", "x", 3, "official_source") == "unknown_kind"


def test_moves_refuse_cycles_of_any_length(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(12)]
    edges = spark.createDataFrame(chain, "parent string, child string")
    moves = spark.createDataFrame([("n0", "n12", "ok", 1), ("n5", "n5", "ok", 1), ("n7", "n6", "ok", 1), ("n9", "n2", "ok", 1), ("n9", "n1", "ok", 2), ("x", "n3", "ok", 1), ("n4", "n0", "no_text", 1)],
                                  "child string, parent string, error string, seq int")
    decided = organization.moved(edges, moves)
    assert {r["child"]: r["decision"] for r in decided.collect()} == {"n0": "cycle", "n5": "cycle", "n7": "unchanged", "n9": "moved", "x": "created", "n4": "no_text"}
    after = {r["child"]: r["parent"] for r in organization.after_moves(edges, decided).collect()}
    assert after["n9"] == "n1" and after["x"] == "n3" and after["n4"] == "n3" and len(after) == 13


def test_entities_are_made_once_for_each_name(spark):
    kn = spark.createDataFrame([(1, "DS K1", "user_confirmed", True), (2, "ds-k1", "official_source", True), (3, "dsk1 ", "user_confirmed", True), (4, "new", "provisional", True),
                                (5, "old", "user_confirmed", False), (6, " ", "user_confirmed", True), (7, "Panel", "official_source", True)], "id long, entity_name string, trust string, active boolean")
    new, links = organization.entity_links(kn, spark.createDataFrame([(40, "PANEL")], "entity_id long, name string"))
    names = {r["entity_id"]: r["name"] for r in new.collect()}
    assert sorted(names.values()) == ["DS K1", "ds-k1"] and sorted(names) == [41, 42]
    by = {r["id"]: r["entity_id"] for r in links.collect()}
    assert set(by) == {1, 2, 3, 7} and by[1] == by[3] != by[2] and by[7] == 40


def test_reviews_prefer_stated_chains(spark):
    act = lambda trust, chain, error: one(spark, organization.review(F.lit(trust), F.lit(chain).cast("array<string>") if chain is None else F.array(*[F.lit(x) for x in chain]), F.lit(error)))
    assert [act("provisional", ["a", "b"], "ok"), act("official_source", ["a", "b"], "ok"), act("user_confirmed", None, "ok"), act("user_confirmed", ["a"], "no_quote")] == [
        "NO_CHANGE", "APPLY_CHAIN", "APPLY_PROPOSAL", "LINK_ONLY"]


def test_group_aggregates_lose_nothing(spark):
    schema = "group_id string, id long, position int, knowledge_key string, title string, frequency int, values map<string,array<string>>"
    m = spark.createDataFrame([
        ("g", 1, 0, "reset", "Reset", 2, {"conditions": ["On  site", "b"]}), ("g", 2, 1, "setup", "Setup", 5, {"conditions": ["on site"], "warnings": ["w"]}),
        ("g", 3, 2, "telegram.case.9", "Other", 5, {"conditions": ["c"]}), ("h", 4, 0, "telegram.case.1", "  Zwei ", 1, {}), ("h", 5, 1, "", "eins", 1, {})], schema)
    got = {r["group_id"]: r for r in review.aggregated(m).collect()}
    assert (got["g"]["knowledge_key"], got["g"]["title"], got["g"]["frequency"], got["g"]["mixed"]) == ("reset", "Setup", 12, True)
    import hashlib

    assert got["h"]["knowledge_key"] == "telegram.group." + hashlib.sha1(b"eins|zwei").hexdigest()[:16]
    all_facts = review.facts(m)
    assert all_facts.count() == 5
    assert {(r["group_id"], r["fact_type"]): r["values"] for r in review.unions(all_facts).collect()} == {("g", "conditions"): ["On  site", "b", "c"], ("g", "warnings"): ["w"]}


def test_fact_cards_and_conflicts(spark):
    f = spark.createDataFrame([("g", "claim", "k", 2, "later", True, False, 8), ("g", "claim", "k", 1, "first", False, True, 7), ("g", "claim", "x", 3, "y", None, None, 7)],
                              "group_id string, fact_type string, fact_key string, fact_id int, value string, selected boolean, conflict boolean, source_id long")
    assert rows(review.fact_cards(f)) == [("g", "claim", "k", "first", False, True, [7, 8]), ("g", "claim", "x", "y", True, False, [7])]
    cases = spark.createDataFrame([("g", 1), ("g", 2), ("g", 2), ("h", 1)], "group_id string, case_id long")
    examples = spark.createDataFrame([(5, [1, 2, 9]), (6, [2, 2, 3]), (7, None)], "example_id long, case_ids array<long>")
    assert rows(review.negative_conflicts(cases, examples)) == [("g", 5, [1, 2])]


def test_groups_events_and_queues(spark):
    groups = spark.createDataFrame([("a", "open"), ("b", "open"), ("c", "published"), ("d", "open")], "group_id string, status string")
    members = spark.createDataFrame([("a", "included", False), ("b", "removed", False), ("c", "included", True), ("d", "included", True)], "group_id string, membership string, conflict boolean")
    assert rows(review.recomputed(groups, members)) == [("a", "open", 1, False, True), ("b", "closed", 0, False, False), ("c", "published", 1, True, False), ("d", "open", 1, True, False)]
    versions = spark.createDataFrame([(1, 1, "published"), (1, 2, "draft"), (2, 1, "draft"), (2, 2, "published"), (3, 1, "draft")], "id long, version_no int, status string")
    queue = review.publication_queue(spark.createDataFrame([(1, "approved"), (2, "approved"), (3, "pending")], "id long, review string"), versions)
    assert rows(queue) == [(1, 2)]
    before = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k long, t string, u string")
    after = spark.createDataFrame([(1, "a", "new"), (2, "c", None)], "k long, t string, u string")
    assert rows(review.changed_fields(before, after, "k", ["t", "u"])) == [(1, "u", None, "new"), (2, "t", "b", "c"), (2, "u", "x", None)]
    known = spark.createDataFrame([("x", 4)], "k string, seq int")
    new = spark.createDataFrame([("x", 10), ("x", 11), ("y", 12)], "k string, event_id int")
    assert [r["seq"] for r in review.appended_events(known, new, "k", "event_id").orderBy("event_id").collect()] == [5, 6, 1]
    cases = spark.createDataFrame([(1, "CASE-000001", 1), (1, "GROUP-AB-C", 9), (2, "CASE-000002", 2)], "case_id long, candidate_id string, id long")
    assert rows(review.preferred_case(cases)) == [(1, "GROUP-AB-C"), (2, "CASE-000002")]


def test_request_starts_keep_their_distance(spark):
    rng = random.Random(3)
    came = [(k, rng.choice("ab"), rng.randint(0, 90)) for k in range(60)]
    wait = {"a": 30.0}
    got = {r["id"]: r["starts"] for r in workflow.limited_starts(
        spark.createDataFrame(came, "id int, key string, came int"), "key", "came", "id", 20, spark.createDataFrame([("a", 30.0)], "key string, until double")).collect()}
    for key in "ab":
        following = wait.get(key, 0.0)
        for k, _, at in sorted((c for c in came if c[1] == key), key=lambda c: (c[2], c[0])):
            start = max(at, following)
            assert abs(got[k] - start) < 1e-9
            following = start + 3.0
    failures = spark.createDataFrame([("a", 100, "HTTP 429"), ("a", 400, "HTTP 500"), ("b", 5, "429 too many")], "key string, at int, message string")
    assert rows(workflow.cooldowns(failures, "key", "at", "message")) == [("a", 400.0), ("b", 305.0)]


def test_runs_stop_at_the_first_rate_limit(spark):
    r = spark.createDataFrame([(1, 1, None), (1, 2, "bad"), (1, 3, "error 429"), (1, 4, None), (2, 1, None)], "run int, id int, error string")
    assert [x["outcome"] for x in workflow.until_limited(r, "run", "id", "error").orderBy("run", "id").collect()] == ["saved", "failed", "pending", "pending", "saved"]
    left = workflow.unfinished(spark.createDataFrame([(1, "h1"), (2, "h2")], "id int, hash string"), spark.createDataFrame([(1, "h0"), (2, "h2")], "id int, hash string"), ["id", "hash"])
    assert rows(left) == [(1, "h1")]
    import hashlib

    known = spark.createDataFrame([("001", hashlib.sha256(b"a;").hexdigest()), ("002", "0" * 64)], "name string, checksum string")
    assert [x[2] for x in rows(workflow.migrations(spark.createDataFrame([("001", "a;"), ("002", "b;"), ("003", "c;")], "name string, sql string"), known))] == ["applied", "mismatch", "apply"]


def test_long_paths_trees_and_cycles(spark):
    from quern.session import checkpointed

    checkpointed(spark)
    rng = random.Random(1)
    ids = rng.sample(range(5000), 200)
    found = grouping.label_components(spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")).collect()
    assert len(found) == 200 and {r["component"] for r in found} == {min(ids)}
    tree = spark.createDataFrame([(f"t{i}", f"t{i + 1}") for i in range(12)] + [(f"c{i}", f"c{(i + 1) % 8}") for i in range(8)], "parent string, child string")
    assert hierarchy.subtree(tree, "t0").count() == 13
    assert sorted(r["node"] for r in hierarchy.cycles(tree).collect()) == [f"c{i}" for i in range(8)]


def test_contexts_pack_greedily(spark):
    b = spark.createDataFrame([(1, k, n) for k, n in enumerate([5, 5, 1, 20, 4, 6, 1])], "g int, o long, n long")
    assert [r["part"] for r in documents.packed_contexts(b, "g", "o", "n", 10).orderBy("o").collect()] == [1, 1, 2, 3, 4, 4, 5]


def test_clarity_and_stems(spark):
    clear = lambda x: one(spark, knowledge.clarity(F.lit(x)))
    assert [clear(x) for x in ("应该支持", "Probably yes", "老版不支持", "以前可以", "两者不同", "有差异", "supports PoE", "看情况", "新版本")] == [
        "uncertain", "uncertain", "vague_version", "vague_version", "vague_difference", "vague_difference", "clear", "uncertain", "vague_version"]
    stem = lambda x: one(spark, knowledge.stem(F.lit(x)))
    assert [stem(x) for x in ("«Камерами»,", "камера", "ещё", "мёдом", "настройки.", "да")] == ["камер", "камер", "еще", "медом", "настройк", "да"]


def test_dumps_and_types(spark):
    lines = ["INSERT INTO \"t\" VALUES(1,'O''Brien, (x)',NULL,'');", "insert into t values (2, 'a;b', 'null', '1'), (3, '''', 4.5, 'yes');", "CREATE TABLE t(x);", "INSERT INTO t2 VALUES(9,'','','');", None]
    got = files.dump_rows(spark.createDataFrame([(x,) for x in lines], "statement string"), "t", ["a", "b", "c", "d"])
    assert rows(got, "a") == [("1", "O'Brien, (x)", None, ""), ("2", "a;b", "null", "1"), ("3", "'", "4.5", "yes")]
    kinds = files.typed(got, {"a": "int", "c": "double", "d": "bool"}, {"d": "flag"})
    assert kinds.columns == ["a", "b", "c", "flag"] and rows(kinds.select("a", "c", "flag"), "a") == [(1, None, None), (2, None, True), (3, 4.5, True)]


def test_vector_caches_are_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    one_, two = ([("a", [1.0]), ("b", [2.0])], [("b", [3.0])])
    for data in (one_, two):
        files.save_cache(spark.createDataFrame(data, "key string, vector array<double>"), path)
    have, missing = files.cached(spark.createDataFrame([("a",), ("b",)], "key string"), spark.read.parquet(path), "key")
    assert rows(have) == [("b", [3.0])] and rows(missing) == [("a",)]


def test_slides_tables_notes_and_damage(spark):
    data = slides.deck([("Title", ["one", "two\nlines", "Notes: said aloud"]), ("", [])])
    assert [(r[1], r[2], r[3], r[4], r[9]) for r in slides.parse(data)] == [
        (1, "heading", "Title", "Title", None), (1, "paragraph", "Title", "one", None), (1, "paragraph", "Title", "two\nlines", None), (1, "note", "Title", "said aloud", None),
        (2, "other", "Slide 2", "", "empty_slide")]
    cell = lambda text, extra="": f"<a:tc{extra}><a:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></a:txBody></a:tc>"
    table = ('<p:graphicFrame><p:xfrm><a:off x="0" y="500"/></p:xfrm><a:graphic><a:graphicData><a:tbl><a:tblGrid><a:gridCol/><a:gridCol/></a:tblGrid>'
             f'<a:tr>{cell("head", " gridSpan=" + chr(34) + "2" + chr(34))}{cell("", " hMerge=" + chr(34) + "1" + chr(34))}</a:tr><a:tr>{cell("x")}{cell("y")}</a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
             '<p:pic><p:spPr><a:xfrm><a:off x="0" y="600"/></a:xfrm></p:spPr></p:pic><p:cxnSp/>')
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            body = old.read(name)
            new.writestr(name, body.replace(b"</p:spTree>", table.encode() + b"</p:spTree>") if name == "ppt/slides/slide2.xml" else body)
    got = [r for r in slides.parse(out.getvalue()) if r[1] == 2]
    assert [(r[2], r[4], r[5], r[6], r[7], r[8], r[9]) for r in got] == [
        ("other", "", None, None, [], None, "unexplained_graphic"), ("table", "head\nx | y", 2, 2, ["0,0:1x2"], 1, None), ("image", "", None, None, [], None, None)]
    bad = slides.slide_blocks(spark.createDataFrame([(1, b"no zip"), (2, None)], "key long, content binary")).collect()
    assert [r["review_reason"] for r in bad] == ["unreadable_file"] * 2


def texts(*values):
    return F.array(*[F.lit(x) for x in values]).cast("array<string>")


def test_topic_tokens_and_families(spark):
    ask = lambda x: one(spark, phrases.topic_tokens(F.lit(x)))
    assert ask("Добрый день! Как сбросить пароль на камере? https://x.ru/камера") == ["password", "reset", "камере"]
    assert ask("NVR pwd forgot, a www") == ["password", "recorder", "reset"] and ask("") == []
    assert one(spark, phrases.focus_tokens(F.lit("DS K1 reset camera"), texts("DS-K1"))) == ["camera", "reset"]
    assert one(spark, phrases.model_families(texts("DS-K1T320", "7", "Панель 2"))) == ["ds k t", "панель"]
    both = lambda a, b: one(spark, phrases.families_compatible(texts(*a), texts(*b)))
    assert both([], ["x"]) and both(["x", "y"], ["y"]) and not both(["x"], ["y"])
    assert one(spark, phrases.stable_markers(F.lit("PoE, onvif DS-K1. Wi-Fi H.265!"))) == ["ds-k1", "h.265", "poe", "wi-fi"]


def test_prose_and_context(spark):
    good = lambda x: one(spark, phrases.russian_qualifier(F.lit(x)))
    assert [good(x) for x in ("при питании по PoE", "with PoE", "при питании with PoE", "при 供电", "PoE", "")] == [True, False, False, False, False, False]
    needs = lambda x, *m: one(spark, phrases.needs_context(F.lit(x), texts(*m)))
    assert needs("Сервер настроить может помочь?") and needs("Подойдёт ли для этого блок?") and not needs("Подойдёт ли для этого блок?", "DS-1")
    assert not needs("Как настроить камеру?") and not needs("Эталон")


def test_sentences_spans_and_conditions(spark):
    split = lambda x: one(spark, phrases.conjoined_parts(F.lit(x)))
    assert split("DS-1 supports PoE and has a speaker.") == ["DS-1 supports PoE.", "DS-1 has a speaker."]
    assert split("Камера поддерживает PoE и не поддерживает Wi-Fi") == ["Камера поддерживает PoE.", "Камера не поддерживает Wi-Fi."]
    assert split("red and blue") == ["red and blue"] and split("DS-1 supports PoE and Wi-Fi.") == ["DS-1 supports PoE and Wi-Fi."]
    span = lambda source, *said: one(spark, phrases.covering_span(F.lit(source), texts(*said)))
    assert span("one two three four", "three", " two ") == "two three" and span("one two", "two", "x") == "" and span("one", " ") == ""
    assert one(spark, phrases.composed_conditions(texts(" On  site ", "b"), texts("on site", "", "c"))) == ["On  site", "b", "c"]
    full = lambda c, s, *v: one(spark, phrases.composed_content(F.lit(c), F.lit(s), texts(*v)))
    assert full("Works on site.", "DS-1", "On  Site", "at night", "At night") == "Works on site — DS-1; at night"
    assert full("Works with DS-1", "ds-1") == "Works with DS-1"


def test_unseen_and_rendered(spark):
    missing = lambda x, pool: one(spark, phrases.unseen(F.lit(x), F.lit(pool)))
    assert missing("DS-K2 holds 4000 and 12", "ds-k2 holds 500") == ["4000", "4000"] and missing("ds-k2", "DS-K2") == []
    d = {"models": texts("A", "B"), "conditions": texts("cold"), "ordered_steps": texts(" open ", "", "close"), "expected_result": F.lit(" ok "), "warnings": texts("hot")}
    assert one(spark, phrases.rendered_unit(F.lit("T"), F.lit("procedure"), d)) == "T\n适用范围：models: A, B；conditions: cold\n警告：hot\n1. open\n2. close\n预期结果：ok"
    assert one(spark, phrases.rendered_unit(F.lit("T"), F.lit("rule"), {"trigger": F.lit("t"), "result": F.lit("r")})) == "T\n触发条件：t\n结论：r"
    assert one(spark, phrases.rendered_unit(F.lit("T"), F.lit("fact"), d | {"warnings": texts()})) == "T\n适用范围：models: A, B；conditions: cold"


def test_contracts_and_hashes(spark):
    import hashlib
    import json

    error = lambda x, *m: one(spark, phrases.signature_error(F.lit(x), texts(*m)))
    assert [error("  ", "a"), error("x" * 241), error("reset DS-K1 panel", "ds-k1"), error("open 10.0.0.1 page"), error("reset  a panel", "", "DS-K1"), error("v1.2.3")] == [
        "empty", "too_long", "model", "address", "ok", "ok"]
    said = json.dumps(["a ", " ", {"claim": " b", "claim_type": "limit", "evidence": [{"x": 1}]}, {"claim": ""}, {"claim": "c", "claim_type": " "}])
    assert [tuple(r) for r in one(spark, phrases.claims(F.lit(said)))] == [("a", "other"), ("b", "limit"), ("c", "other")]
    assert one(spark, phrases.claims(F.lit("no json"))) == [] and one(spark, phrases.claims(F.lit(None).cast("string"))) == []
    text, layout = 'a "quote"\n\tТекст', {"b": 1, "a": [2]}
    want = hashlib.sha256(json.dumps({"text": text, "layout": layout}, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
    assert one(spark, phrases.content_hash(F.lit(text), F.lit(json.dumps(layout, sort_keys=True)))) == want
    assert one(spark, phrases.fingerprint(F.lit(" A  b"), F.lit("C\n"))) == hashlib.sha256(b"a b\nc").hexdigest()


def test_units_are_checked_against_their_blocks(spark):
    b = spark.createDataFrame([(1, 10, "The DS-K1 panel holds 4000 cards."), (2, 20, "Other")], "version_id long, block_id long, text string")
    heads = spark.createDataFrame([(1, "Manual 2024 for DS-K9")], "version_id long, heading string")
    schema = "unit_id int, version_id long, title string, kind string, content string, steps array<string>, trigger string, result string, sources array<struct<block_id:long,excerpt:string>>"
    ok = [(10, "holds  4000 CARDS")]
    units = spark.createDataFrame([
        (1, 1, "T", "fact", "DS-K1 holds 4000, as in 2024 for ds-k9", None, None, None, ok), (2, 1, " ", "fact", "c", None, None, None, ok), (3, 1, "T", "guess", "c", None, None, None, ok),
        (4, 1, "T", "procedure", "c", [" "], None, None, ok), (5, 1, "T", "rule", "c", None, "t", " ", ok), (6, 1, "T", "fact", "c", None, None, None, []), (7, 1, "T", "fact", "c", None, None, None, [(20, "Other")]),
        (8, 1, "T", "fact", "c", None, None, None, [(10, " ")]), (9, 1, "T", "fact", "c", None, None, None, [(10, "holds 5000")]), (10, 1, "T", "fact", "holds 9999", None, None, None, ok),
        (11, 1, "DS-X2", "fact", "c", None, None, None, ok), (12, 1, "T", "fact", None, None, None, None, ok)], schema)
    got = {r["unit_id"]: r["error"] for r in learning.unit_errors(units, b, heads).collect()}
    assert got == {1: "ok", 2: "no_title", 3: "unknown_kind", 4: "no_steps", 5: "incomplete_rule", 6: "no_source", 7: "block_of_another_version", 8: "empty_excerpt", 9: "not_verbatim",
                   10: "unseen_identifier", 11: "unseen_identifier", 12: "no_content"}


def test_answers_and_scores(spark):
    said = lambda s, a, q, u: one(spark, answering.customer_text(*[F.lit(x).cast("string") for x in (s, a, q, u)], "F", "U", "E"))
    assert [said("answered", " a ", None, None), said("answered", "", None, None), said("needs_clarification", "", None, None), said("unsupported", "", "", ""), said("unsupported", "a", "", "u"), said("x", "a", "", "")] == [
        "a", "E", "U", "F", "u", "E"]
    assert one(spark, answering.qualified(F.lit("do it "), texts(), texts("DS-1", "DS-2"))) == "Если речь о DS-1, порядок такой: do it Если у вас другая модель, укажите её — порядок может отличаться."
    assert one(spark, answering.qualified(F.lit("do it"), texts("DS-1"), texts("DS-1"))) == "do it"
    rows_ = [(False, False, "answered", ["k"], None, "answered", [1], ["k", "z"], ["exact"], True), (False, False, "answered", [], 2, "answered", [1], [], ["exact"], True),
             (True, False, "unsupported", [], None, "unsupported", [1], [], ["conflict"], False), (False, True, "needs_clarification", [], None, "needs_clarification", [1], [], ["exact"], False),
             (False, False, "answered", [], None, "answered", [1], [], ["conflict"], False)]
    df = spark.createDataFrame(rows_, "refuse boolean, clarify boolean, expected_status string, expected_keys array<string>, expected_id long, actual_status string, ids array<long>, keys array<string>, scopes array<string>, supported boolean")
    assert [(r["selection_pass"], r["golden_pass"], r["applicability_pass"]) for r in answering.scored(df).collect()] == [
        (True, True, True), (False, False, False), (True, True, False), (False, False, False), (True, False, False)]


def test_golden_sets_and_quotas(spark):
    samples = spark.createDataFrame([("a", "q", "answered"), ("a", "q", "answered"), (" ", "q", "maybe"), ("b", None, "unsupported")], "sample_key string, question string, expected_answer_status string")
    assert rows(answering.golden_errors(samples, ["question"])) == [(" ", "empty_key"), (" ", "unexpected_status"), ("a", "repeated_key"), ("a", "repeated_key"), ("b", "missing question")]
    cases = spark.createDataFrame([("a", "answerable", "unsupported"), ("z", "clarify", "x"), ("b", "odd", "unsupported")], "sample_key string, category string, expected_answer_status string")
    assert rows(answering.sidecar_errors(cases, samples)) == [("a", "category_and_status"), ("a", "disagrees"), ("b", "unknown_category"), ("z", "unknown_sample")]
    assert rows(answering.quota_errors(cases, {"answerable": 1, "clarify": 2, "boundary": 1})) == [("boundary", 0, 1), ("clarify", 1, 2)]


def test_cases_relations_and_retirement(spark):
    have = spark.createDataFrame([(1, "", None, []), (2, "x", 5, ["m"])], "k int, t string, n int, l array<string>")
    more = spark.createDataFrame([(1, "new", 7, ["z"]), (2, "new", 7, ["z"])], "k int, t string, n int, l array<string>")
    assert rows(knowledge.filled(have, more, "k")) == [(1, "new", 7, ["z"]), (2, "x", 5, ["m"])]
    cases = spark.createDataFrame([(7,), (7,), (12345678,), (9,)], "case_id long")
    assert rows(knowledge.fallback_candidates(cases, spark.createDataFrame([(9,)], "case_id long"))) == [("CASE-000007", 7), ("CASE-12345678", 12345678)]
    m = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "case_id long, message_id string")
    requests = spark.createDataFrame([(1, "a", "b", "answers"), (1, "a", "a", "answers"), (1, "a", "c", "answers"), (1, "a", "b", "likes")], "case_id long, source string, target string, relation string")
    known = spark.createDataFrame([(1, "a", "b", "answers", "inferred", 0.5), (2, "c", "d", "answers", "inferred", 0.5)], "case_id long, source string, target string, relation string, origin string, confidence double")
    checked, after = knowledge.manual_relations(requests, m, known)
    assert sorted(r["error"] for r in checked.collect()) == ["not_of_this_case", "ok", "same_message", "unknown_relation"]
    assert rows(after) == [(1, "a", "b", "answers", "manual", 1.0), (2, "c", "d", "answers", "inferred", 0.5)]
    kn = spark.createDataFrame([(1, "provisional", True), (2, "provisional", True), (3, "user_confirmed", True), (4, "provisional", True)], "id long, trust string, active boolean")
    sources = spark.createDataFrame([(1, 11, "supports", True, "unresolved"), (2, 12, "supports", True, "unresolved"), (2, 13, "supports", True, "accepted"), (3, 14, "supports", True, "unresolved")],
                                    "knowledge_id long, evidence_id long, relation string, active boolean, resolution string")
    corrections = spark.createDataFrame([(1, 11), (2, 12), (3, 14)], "knowledge_id long, evidence_id long")
    assert rows(knowledge.retired(kn, sources, corrections)) == [(1, "provisional", False), (2, "provisional", True), (3, "user_confirmed", True), (4, "provisional", True)]
    assert {(r["evidence_id"], r["resolution"]) for r in knowledge.corrected_sources(sources, corrections).collect()} == {(11, "rejected"), (12, "rejected"), (13, "accepted"), (14, "rejected")}


def test_sessions_claims_and_recovery(spark):
    s = spark.createDataFrame([(1, 10), (2, 0)], "thread_id int, started_at int")
    p = spark.createDataFrame([(1, 5, "confirmed", "old", 9), (1, 7, "confirmed", "A  b", 11), (1, 6, "confirmed", "second", 12), (1, 8, "confirmed", "a B", 13), (1, 9, "skipped", "", 14), (1, 10, "corrected", "", 15)],
                              "thread_id int, proposal_id int, status string, content string, at int")
    b = spark.createDataFrame([(1, 4, 3, 1, 12), (1, 9, 9, 0, 1)], "thread_id int, total int, processed int, failed int, at int")
    assert rows(knowledge.session_summary(s, p, b)) == [(1, ["second", "A  b"], 1, 1, 4, 3, 1), (2, [], 0, 0, 0, 0, 0)]
    inbox = spark.createDataFrame([("w", 1, "done", 1), ("w", 3, "queued", 5), ("w", 2, "queued", 5), ("x", 4, "done", 1)], "worker string, id int, status string, at int")
    jobs = spark.createDataFrame([("w", 9, "queued", 0), ("x", 8, "queued", 90), ("x", 7, "queued", 30), ("y", 6, "queued", 99)], "worker string, id int, status string, at int")
    assert rows(lifecycle.claimed(inbox, jobs, F.lit(50), "worker")) == [("w", "message", 2), ("x", "document", 7)]
    beats = spark.createDataFrame([("w", 10), ("w", 100), ("x", 30)], "worker string, at int")
    up = lifecycle.alive(beats, F.lit(120), 60)
    assert rows(up) == [("w", 100, True), ("x", 30, False)]
    work = spark.createDataFrame([("w", "processing"), ("x", "processing"), ("x", "done"), (None, "processing")], "worker string, status string")
    assert sorted((r["worker"] or "", r["status"]) for r in lifecycle.recovered(work, up.where("alive")).collect()) == [("", "queued"), ("w", "processing"), ("x", "done"), ("x", "queued")]


def test_reranking_and_title_fallback(spark):
    hits = spark.createDataFrame([(1, 1, False, 0.9), (1, 2, True, 0.1), (1, 3, False, 0.2), (1, 4, False, 0.9)], "qid int, id long, exact boolean, rrf double")
    scores = spark.createDataFrame([(1, 3, 0.5)], "qid int, id long, score double")
    assert [r["id"] for r in retrieval.reranked(hits, scores).orderBy("rank").collect()] == [2, 3, 1, 4]
    q = spark.createDataFrame([(1, "how to RESET a panel"), (2, "nothing")], "qid int, question string")
    known = spark.createDataFrame([(5, "Reset"), (3, "Panel"), (1, "Door"), (2, ""), (4, "Gate")], "id long, title string")
    got = retrieval.by_title(q, known, 3)
    assert [(r["qid"], r["id"], r["hit"]) for r in got.orderBy("qid", "rank").collect()] == [(1, 3, 1), (1, 5, 1), (1, 1, 0), (2, 1, 0), (2, 2, 0), (2, 3, 0)]


def test_sources_aliases_and_usable_rows(spark):
    sources = spark.createDataFrame([(2, 1, 9, "k", "b", "supports", "accepted", True), (1, 1, 8, "k", "a", "supports", "accepted", True), (3, 1, 7, "k", "c", "supports", "accepted", True),
                                     (4, 1, 8, "k", "d", "contradicts", "accepted", True), (5, 1, 8, "k", "e", "supports", "rejected", True), (6, 2, 8, "k", "f", "supports", "accepted", False)],
                                    "source_id long, knowledge_id long, evidence_id long, source_kind string, excerpt string, relation string, resolution string, active boolean")
    evidence = spark.createDataFrame([(9, "active", "l", "p1"), (8, "active", "l", "p2"), (7, "redacted", "l", "p3")], "evidence_id long, status string, label string, locator string")
    got = retrieval.answer_sources(sources, evidence).collect()
    assert [(r["knowledge_id"], [x["source_id"] for x in r["sources"]]) for r in got] == [(1, [1, 2])]
    q = spark.createDataFrame([(1, "my HIK connect app"), (2, "other")], "qid int, question string")
    aliases = spark.createDataFrame([("hik Connect", "k1", True), ("app", "k2", False), ("my", "", True), ("oth", "k3", True)], "alias string, knowledge_key string, approved boolean")
    assert rows(retrieval.alias_keys(q, aliases)) == [(1, "k1"), (2, "k3")]


def test_failures_retests_and_votes(spark):
    import datetime as dt

    now = dt.datetime(2024, 5, 10)
    runs = spark.createDataFrame([(1, "completed", "unsupported", None, now, 3), (2, "failed", "", "fail", now, 0), (3, "failed", "", "pass", now, 0), (4, "completed", "answered", None, now, 1),
                                  (5, "completed", "service_error", None, now - dt.timedelta(days=9), 0)], "run_id int, status string, answer_status string, verdict string, at timestamp_ntz, n_candidates int")
    feedback = spark.createDataFrame([(8, 1, "missing", "open"), (7, 1, "wrong_scope", "open"), (9, 2, "missing", "closed")], "feedback_id int, run_id int, kind string, status string")
    got = answering.recent_failures(runs, feedback, F.lit(now), 7)
    assert rows(got.select("run_id", "feedback_id", "category", "action")) == [(1, 8, "missing_knowledge", "add_knowledge"), (2, None, "technical", "retry")]
    asked = spark.createDataFrame([(1, "q", {"a": "b", "feedback_id": "0"}), (2, "r", None)], "run_id int, question string, context map<string,string>")
    again = answering.retests(spark.createDataFrame([(5, 1, "it is 7"), (6, 2, "x"), (7, 99, "y")], "feedback_id int, run_id int, correction string"), asked)
    assert [(r["question"], r["context"], r["retest_of"]) for r in again.orderBy("feedback_id").collect()] == [
        ("q", {"a": "b", "retest_of": "1", "feedback_id": "5"}, 1), ("r", {"retest_of": "2", "feedback_id": "6"}, 2)]
    members = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 9)], "cluster string, id long")
    assert rows(grouping.vote_errors(members, spark.createDataFrame([(1,), (2,), (3,)], "id long"))) == [(1, "repeated"), (3, "missing"), (9, "unknown")]


def test_versions_blocks_and_roles(spark):
    versions = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "version_id long, document_key string")
    links = spark.createDataFrame([(2, 1), (3, 1), (1, 1), (2, 9)], "version_id long, previous_id long")
    changes = spark.createDataFrame([(2, "Use", "changed"), (2, "New", "added")], "version_id long, section string, change string")
    touched = spark.createDataFrame([(2, 70)], "version_id long, knowledge_id long")
    got = {(r["version_id"], r["previous_id"]): r for r in documents.stored_diffs(versions, links, changes, touched).collect()}
    assert {k: r["error"] for k, r in got.items()} == {(2, 1): "ok", (3, 1): "another_document", (1, 1): "itself", (2, 9): "not_found"}
    assert (got[2, 1]["added"], got[2, 1]["changed"], got[2, 1]["removed"], got[2, 1]["affected"]) == (["New"], ["Use"], [], [70]) and got[3, 1]["added"] is None
    b = spark.createDataFrame([(1, "k", 2, None, 4, "later", 1, ""), (1, "k", 1, 7, None, "first", 0, ""), (1, "m", 3, None, None, "", 2, "unexplained")],
                              "version_id long, block_key string, ord int, page_no int, slide_no int, text string, n_assets int, review_reason string")
    kept, counts = documents.persisted(b)
    assert rows(kept.select("block_key", "text", "locator")) == [("k", "first", "doc:1:page 7"), ("m", "", "doc:1:unknown position")] and rows(counts) == [(1, 2, 1, 2, 1)]
    entries = spark.createDataFrame([(1, "2", 1, "guess", "r" * 500), (1, "2", 2, "user_report", None), (1, "x", 3, "user_report", ""), (None, "1", 4, "user_report", "")], "case_id long, message_index string, seq int, role string, reason string")
    assert rows(workflow.imported_roles(entries, ("user_report",))) == [(1, -1, "user_report", ""), (1, 2, "user_report", "")]
