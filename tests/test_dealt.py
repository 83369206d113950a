from quern import session
from quern.plans import registry
from quern.operators import intents, retrieval, workflow


def test_tasks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS", 10)
    df = spark.range(300)
    assert session.dealt(df, 300, "id").rdd.getNumPartitions() == 30
    rows = spark.createDataFrame([(g, i) for g in range(40) for i in (g % 4, 5, 5)] + [(None, 1), (1, None)], "g int, i int")
    assert {tuple(r) for r in workflow.repeated_pairs(rows, "g", "i").collect()} == {(i, 5, 10) for i in range(4)}


def test_substrings_meet_names_before_they_are_grouped(spark):
    texts = spark.createDataFrame([(1, "An acme NVR"), (2, "none"), (1, "acme acme")], "qid long, question string")
    names = spark.createDataFrame([("ACME",), ("nvr",), ("",), (None,)], "name string")
    found = retrieval.contained(texts, "qid", "question", names, "name")
    assert sorted(tuple(r) for r in found.collect()) == [(1, "ACME"), (1, "nvr")]
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    aggregates, join = [i for i, x in enumerate(lines) if "Aggregate" in x], next(i for i, x in enumerate(lines) if "Join" in x)
    assert min(aggregates) < join and not [x for i, x in enumerate(lines) if i > join and "Aggregate [qid" in x]


def test_replies_of_one_file_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(intents, "REPLIES", 10)
    replies = spark.range(95).coalesce(1).selectExpr("id", "'{}' AS reply", "'What?' AS question", "array('x') AS models")
    found = intents.intents(replies)
    assert found.rdd.getNumPartitions() == 10 and found.count() == 95


def test_a_task_sorts_the_list_of_a_question(spark):
    """Both lists of a question are ranked by one sort, dealt over as many tasks as there are questions."""
    found = registry.QUERIES["r10_whole_running_rank"](spark, "/root/testdata/sf0.001")
    asked = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id % 50 = 0").count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert asked > 4 and "hashpartitioning(qid#" in plan and f", {asked})" in plan and plan.count("Window [") == 1
