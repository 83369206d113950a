"""Golden cases of the intent contract."""

import json

from quern.operators import intents as i

GOOD = {"family": "feature_capability", "action": "check_support", "feature": None, "feature_evidence": None, "problem": None,
        "problem_evidence": None, "relation": None, "relation_evidence": None, "source_object": None, "target_object": None,
        "object_type": "camera", "context_status": "standalone", "key_specificity": "generic"}


def checked(spark, *cases):
    rows = [(n, reply if isinstance(reply, str) else json.dumps({**GOOD, **reply}, ensure_ascii=False), question, models)
            for n, (reply, question, models) in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, reply string, question string, models array<string>")
    return [(r["error"], r["intent"] and r["intent"].asDict()) for r in i.intents(df).orderBy("id").collect()]


def test_intents_that_count(spark):
    got = checked(
        spark,
        ({}, "Какая камера лучше?", []),
        ({"feature": "ONVIF", "feature_evidence": "onvif"}, "Есть ли  ONVIF у камеры?", None),
        ("Sure:\n" + json.dumps({**GOOD, "feature": "face", "feature_evidence": "распознавания лиц"}, ensure_ascii=False) + " done",
         "Работает  распознавание лица?", ["DS-1"]),
        ({"family": "integration", "action": "connect", "relation": "camera to NVR", "relation_evidence": "attach", "source_object": "camera",
          "target_object": "NVR", "key_specificity": "generic"}, "Как подключить камеру к регистратору?", ["DS-1"]),
        ({"source_object": "camera", "target_object": "nvr", "key_specificity": "specific"}, "А этот лучше?", []),
        ({"family": "Firmware", "action": "find or get", "feature": "firmware"}, "Где взять новую версию?", ["X"]))
    assert [e for e, _ in got] == [None] * 6
    first, onvif, face, linked, pointing, firmware = [x for _, x in got]
    assert first["knowledge_key"] == "feature_capability.check_support" and first["key_specificity"] == "generic"
    assert (onvif["feature"], onvif["feature_evidence"], onvif["key_specificity"]) == ("onvif", "onvif", "specific")
    assert onvif["knowledge_key"] == "feature_capability.check_support.onvif"
    assert (face["feature"], face["feature_evidence"]) == ("face_recognition", "распознавание лица")
    assert (linked["relation"], linked["relation_evidence"]) == ("connects_to", "подключить")
    assert linked["knowledge_key"] == "integration.connect.camera_to_nvr" and linked["key_specificity"] == "specific"
    assert (pointing["source_object"], pointing["target_object"], pointing["context_status"]) == (None, None, "context_required")
    assert pointing["key_specificity"] == "generic"
    assert firmware["feature"] is None and firmware["knowledge_key"] == "firmware.find_or_get"


def test_the_first_broken_rule_is_named(spark):
    less = json.dumps({k: v for k, v in GOOD.items() if k != "problem"})
    cases = [
        ("no json", "q", "fields are wrong"), (None, "q", "fields are wrong"), ("[1]", "q", "fields are wrong"), (less, "q", "fields are wrong"),
        ({"extra": 1}, "q", "fields are wrong"),
        ({"family": 5}, "q", "family is not a string"), ({"family": "x" * 49}, "q", "family is too long"), ({"family": "toys"}, "q", "family is unknown"),
        ({"action": None}, "q", "action is unknown"), ({"object_type": "none"}, "q", "object_type is unknown"),
        ({"family": "toys", "object_type": "toy"}, "q", "object_type is unknown"),
        ({"feature": ["a"]}, "q", "feature is not a string"), ({"relation": "near"}, "q", "relation is unknown"),
        ({"problem": "offline", "problem_evidence": "  "}, "q", "problem_evidence is empty or not a string"),
        ({"feature_evidence": "q"}, "q", "feature_evidence has no feature"), ({"feature": "zoom"}, "q", "feature has no evidence"),
        ({"feature": "zoom", "feature_evidence": "big zoom"}, "Is it small?", "feature is not in the question"),
        ({"feature": "zoom", "feature_evidence": "zoom"}, None, "feature is not in the question"),
        ({"feature": "zoom ds1", "feature_evidence": "zoom"}, "zoom", "feature names a model or an address"),
        ({"source_object": "cat"}, "q", "source_object is unknown"),
        ({"relation": "controls", "relation_evidence": "q", "source_object": "camera"}, "q", "relation lacks an object"),
        ({"context_status": "maybe"}, "q", "context_status is unknown"), ({"key_specificity": None}, "q", "key_specificity is unknown"),
        ({}, "Почему камера offline?", "generic, but the question is specific"),
        ({}, "Можно подключить камеру к регистратору?", "generic, but the question is specific")]
    df = [(reply if reply is not None else "", question, ["", "DS1"]) for reply, question, _ in cases]
    got = checked(spark, *df)
    assert [e for e, _ in got] == [e for _, _, e in cases] and all(x is None for _, x in got)


def test_an_empty_table(spark):
    df = spark.createDataFrame([], "reply string, question string, models array<string>")
    assert i.intents(df).count() == 0 and i.intents(df.selectExpr("*", "1 AS id")).columns[-2:] == ["error", "intent"]
