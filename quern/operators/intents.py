"""The contract that a model's reply about a question must keep before its intent is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import phrases as p
from quern.operators.knowledge import stem
from quern.sources.files import last_json

# The fields of a reply, what they may say, other words for a label, and the beginnings of words that speak of one.
FIELDS = ("family", "action", "feature", "feature_evidence", "problem", "problem_evidence", "relation", "relation_evidence",
          "source_object", "target_object", "object_type", "context_status", "key_specificity")
FAMILIES = ("firmware", "password_access", "compatibility", "feature_capability", "capacity_limit", "configuration", "troubleshooting",
            "integration", "recording_storage", "network", "mobile_cloud", "documentation_certificate", "software", "accessory",
            "pricing_commercial", "other")
ACTIONS = ("find_or_get", "check_latest", "update_install", "rollback_recover", "reset", "configure", "connect", "add", "remove", "bind",
           "unbind", "check_support", "check_compatibility", "check_limit", "check_specification", "diagnose", "fix", "select", "replace",
           "download", "view", "export_import", "compare", "find_analog", "check_bundle", "check_availability", "other")
OBJECTS = ("camera", "nvr", "dvr", "intercom_monitor", "door_station", "access_terminal", "access_controller", "alarm_hub", "sensor",
           "turnstile", "barrier", "software", "mobile_app", "accessory", "generic_device", "other")
RELATIONS = ("connects_to", "communicates_with", "integrates_with", "controls", "replaces", "compatible_with", "other")
STATUSES = ("standalone", "context_required")
SPECIFICITIES = ("specific", "generic")
FEATURE_WORDS = {
    "hikconnect": "hik_connect", "lpr": "anpr", "auto_tracking": "autotracking", "microphone": "audio", "face": "face_recognition",
    "rfid": "card", "hevc": "h265", "rack": "rack_ears", "rack_ear": "rack_ears", "wi_fi": "wifi", "motion": "motion_detection"}
PROBLEM_WORDS = {
    "not_online": "offline", "no_sound": "no_audio", "no_audio_recording": "no_audio", "sound_missing": "no_audio",
    "not_added": "cannot_add", "cannot_connect": "connection_failure", "connection_error": "connection_failure",
    "auth_failure": "authentication_failure", "update_failure": "firmware_failure", "firmware_update_failure": "firmware_failure",
    "upgrade_failure": "firmware_failure", "no_time_sync": "time_sync_failure"}
RELATION_WORDS = {
    "door_station_monitor": "connects_to", "door_station_to_monitor": "connects_to", "door_station_to_indoor_monitor": "connects_to",
    "camera_nvr": "connects_to", "camera_to_nvr": "connects_to", "camera_to_barrier": "connects_to", "device_hikconnect": "integrates_with",
    "device_to_hikconnect": "integrates_with", "device_app": "integrates_with", "device_to_mobile_app": "integrates_with",
    "sensor_hub": "connects_to", "sensor_to_hub": "connects_to", "camera_camera": "connects_to", "camera_to_camera": "connects_to",
    "monitor_panel": "connects_to", "panel_monitor": "connects_to", "connect": "connects_to", "connection": "connects_to",
    "connected_to": "connects_to", "compatible": "compatible_with"}
SPOKEN = {
    "resolution": ("разреш",), "face_recognition": ("распозна", "лиц"), "no_video": ("фото", "видео", "изображ"),
    "performance_degradation": ("ухудш",), "time_sync_failure": ("синхронизац", "ntp", "времен"),
    "connection_failure": ("подключ", "соедин", "связ", "отвяз", "проблем"), "firmware_failure": ("ошиб", "upgrade", "прошив"),
    "no_audio": ("аудио", "звук", "микроф"), "offline": ("offline", "офлайн", "сети"), "hik_connect": ("hikconnect", "hik", "хик"),
    "ptz": ("ptz",), "schedule": ("расписан",), "audio_codec": ("кодек", "аудио"), "rack_ears": ("уш", "стойк", "rack"),
    "mounting_hood": ("козыр",)}
SPOKEN_RELATION = ("подключ", "соедин", "совмест", "привяз", "переадрес", "замен", "отвяз")
FEATURE_SIGNS = ("onvif", "rtsp", "sip", "rack", "уши", "стойк", "козыр", "аудио", "звук", "микроф", "кодек", "poe", "wi-fi", "wifi", "анпр",
                 "anpr", "lpr", "распознаван", "карта памяти", "motion", "движен", "разреш", "расписан", "ntp", "ptz", "кабел")
PROBLEM_SIGNS = ("offline", "офлайн", "не в сети", "нет звука", "нет аудио", "не работает", "перестал", "перестало", "ошиб", "не подключ",
                 "не добавля", "не видит", "не открыва", "upgrade fail", "firmware failure", "после прошив")
CONNECTS = r"(?U)\b(?:подключ|соедин|связ|совмест|привяз)"
PAIRS = ((r"(?U)камер|\bcamera\b", r"(?U)регистратор|\bnvr\b"), ("монитор", "панел"), ("датчик", "хаб"))
NOTHING = ("null", "none")
WORD = r"(?U)[^\W_]+"
LONGEST = 48
#: Replies of a task: a reply takes about a millisecond, so files of small rows hold too many.
REPLIES = 20_000


def _sql(values) -> str:
    """An array of fixed strings as SQL, which makes one expression of it."""
    return "array(" + ", ".join(f"'{x}'" for x in values) + ")"


def _array(values) -> Column:
    return F.expr(_sql(values) if values else "cast(array() AS array<string>)")


def label(value: Column, words: dict[str, str] | None = None) -> Column:
    """A label as Latin letters, digits and single underscores, other words for it replaced; null if nothing is left."""
    joined = F.regexp_replace(F.replace(F.lower(F.trim(value)), F.lit("ё"), F.lit("е")), r"(?U)[\s\-/]+", "_")
    token = F.trim(F.regexp_replace(F.regexp_replace(joined, "[^a-z0-9_]+", ""), "_+", "_"), F.lit("_"))
    token = F.when((token != "") & ~token.isin(*NOTHING), token)
    if not words:
        return token
    known = F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in words.items()) + ")")
    return F.coalesce(F.element_at(known, token), token)


def _folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("ё"), F.lit("е")), r"(?U)\s+", " "))


def _says(text: Column, beginnings) -> Column:
    return F.exists(_array(beginnings), lambda x: F.contains(text, x))


def specific_signal(question: Column) -> Column:
    """Does a question name a feature, a problem, or two kinds of objects and that they connect?"""
    q = _folded(question)
    pair = None
    for one, other in PAIRS:
        both = q.rlike(one) & q.rlike(other)
        pair = both if pair is None else pair | both
    return _says(q, FEATURE_SIGNS + PROBLEM_SIGNS) | (q.rlike(CONNECTS) & pair)


def grounded(name: Column, evidence: Column, question: Column, words: Column, gaps: Column, stems: Column, relation: bool = False) -> Column:
    """The part of the question that supports a label: the evidence if the question holds it, else the first run of
    words with its stems, else the first word that speaks of the label; null without one. words are the question's,
    gaps what stands before each and after the last, stems those of words."""
    wanted = F.transform(F.regexp_extract_all(evidence, F.lit(WORD), 0), stem)
    m, n = F.size(wanted), F.size(words)
    starts = F.when((m > 0) & (m <= n), F.sequence(F.lit(1), n - m + 1))

    def fits(start: Column) -> Column:
        near = F.zip_with(F.slice(stems, start, m), wanted, lambda q, e: F.contains(q, e) | F.contains(e, q))
        return F.forall(near, lambda x: x)

    start = F.try_element_at(F.filter(starts, fits), F.lit(1))
    spaced = F.zip_with(F.slice(gaps, start, m), F.slice(words, start, m), lambda g, w: F.concat(g, w))
    run = F.concat(F.element_at(words, start), F.array_join(F.slice(spaced, F.lit(2), m), ""))
    spoken = F.expr("map(" + ", ".join(f"'{k}', {_sql(v)}" for k, v in SPOKEN.items()) + ")")
    terms = F.coalesce(F.element_at(spoken, name), _array(()))
    if relation:
        terms = F.concat(terms, _array(SPOKEN_RELATION))
    word = F.try_element_at(F.filter(words, lambda w: F.exists(terms, lambda x: F.contains(_folded(w), x))), F.lit(1))
    return F.when(F.contains(_folded(question), _folded(evidence)), evidence).otherwise(F.coalesce(run, word))


def intents(replies: DataFrame, reply: str = "reply", question: str = "question", models: str = "models") -> DataFrame:
    """replies with ``error``, the first rule that a reply breaks, and ``intent``, null then: the thirteen fields as they
    count, and knowledge_key.

    A reply must hold exactly the thirteen fields. Labels must be strings or null, of at most 48 characters; families, actions,
    kinds of objects, relations, states and specificities must be known. A feature, problem or relation needs evidence that
    the question holds, if only inflected, and what it holds replaces it; none may name a model or an address. A relation needs
    two objects; without one they are dropped. Questions that only point need context whatever the reply says. An intent is
    specific if it has a feature, problem or relation; a generic one is refused if the question names one. Null questions hold
    nothing, null models are none. Replies are dealt anew, REPLIES a task."""
    replies = replies.repartition(max(1, -(-replies.count() // REPLIES)))
    v = F.try_parse_json("__json")
    out = (replies.withColumn("__json", last_json(F.col(reply))).withColumn("__v", v)
           .withColumn("__q", F.coalesce(F.col(question), F.lit(""))).withColumn("__m", F.coalesce(F.col(models).cast("array<string>"), _array(())))
           .withColumn("__words", F.regexp_extract_all("__q", F.lit(WORD), 0)).withColumn("__gaps", F.split("__q", WORD, -1))
           .withColumn("__stems", F.transform("__words", stem)))
    kinds = F.create_map(*[x for f in FIELDS for x in (F.lit(f), F.schema_of_variant(F.try_variant_get("__v", f"$.{f}", "variant")))])
    said = F.create_map(*[x for f in FIELDS for x in (F.lit(f), F.try_variant_get("__v", f"$.{f}", "string"))])
    out = out.withColumn("__kind", kinds).withColumn("__said", said)

    def kind(field: str) -> Column:
        return F.coalesce(F.element_at("__kind", field), F.lit("VOID"))

    words = {"feature": FEATURE_WORDS, "problem": PROBLEM_WORDS, "relation": RELATION_WORDS}
    labels = [f for f in FIELDS if not f.endswith("_evidence")]
    out = out.withColumn("__label", F.struct(*[label(F.element_at("__said", f), words.get(f)).alias(f) for f in labels]))
    out = out.withColumn("__evidence", F.struct(*[
        F.trim(F.regexp_replace(F.element_at("__said", f"{f}_evidence"), r"(?U)\s+", " ")).alias(f) for f in words]))
    named = {f: F.col(f"__label.{f}") for f in labels}
    # The family already says firmware.
    named["feature"] = F.when((named["feature"] == "firmware") & (named["family"] == "firmware"), None).otherwise(named["feature"])
    out = out.withColumn("__found", F.struct(*[
        grounded(named[f], F.col(f"__evidence.{f}"), F.col("__q"), F.col("__words"), F.col("__gaps"), F.col("__stems"), f == "relation").alias(f)
        for f in words]))

    rules: list[tuple[Column, str]] = []

    def form(field: str) -> None:
        rules.append((~kind(field).isin("STRING", "VOID"), f"{field} is not a string"))
        rules.append((F.length(F.col(f"__label.{field}")) > LONGEST, f"{field} is too long"))

    def known(field: str, values: tuple[str, ...], needed: bool = True) -> None:
        strange = ~F.array_contains(_array(values), F.col(f"__label.{field}"))
        rules.append((F.coalesce(strange, F.lit(needed)), f"{field} is unknown"))

    keys = F.array_sort(F.json_object_keys(F.to_json("__v")))
    rules.append((F.coalesce(keys != _array(sorted(FIELDS)), F.lit(True)), "fields are wrong"))
    for field in ("family", "action", "object_type"):
        form(field)
    for field, values in (("object_type", OBJECTS), ("family", FAMILIES), ("action", ACTIONS)):
        known(field, values)
    for field in words:
        form(field)
    known("relation", RELATIONS, needed=False)
    for f in words:
        given = F.trim(F.regexp_replace(F.element_at("__said", f"{f}_evidence"), r"(?U)\s+", " "))
        rules.append((~kind(f"{f}_evidence").isin("STRING", "VOID") | (given == ""), f"{f}_evidence is empty or not a string"))
    for f in words:
        given = F.col(f"__evidence.{f}")
        rules.append((named[f].isNull() & given.isNotNull(), f"{f}_evidence has no {f}"))
        rules.append((named[f].isNotNull() & given.isNull(), f"{f} has no evidence"))
        rules.append((named[f].isNotNull() & F.col(f"__found.{f}").isNull(), f"{f} is not in the question"))
    for f in words:
        model = F.exists(F.col("__m"), lambda x: (x != "") & F.contains(F.lower(named[f]), F.lower(x)))
        rules.append((model | named[f].rlike(p.ADDRESS), f"{f} names a model or an address"))
    for field in ("source_object", "target_object"):
        form(field)
        known(field, OBJECTS, needed=False)
    related = named["relation"].isNotNull()
    rules.append((related & (named["source_object"].isNull() | named["target_object"].isNull()), "relation lacks an object"))
    for field, values in (("context_status", STATUSES), ("key_specificity", SPECIFICITIES)):
        form(field)
        known(field, values)
    specific = named["feature"].isNotNull() | named["problem"].isNotNull() | related
    rules.append((~specific & specific_signal(F.col("__q")), "generic, but the question is specific"))
    error = F.coalesce(*[F.when(broken, F.lit(said_of)) for broken, said_of in rules])

    ends = {f: F.when(related, named[f]) for f in ("source_object", "target_object")}
    pair = F.concat_ws("_to_", ends["source_object"], ends["target_object"])
    key = F.concat_ws(".", named["family"], named["action"], named["feature"], named["problem"], F.when(related, pair))
    value = {**named, **ends,
             **{f"{f}_evidence": F.when(named[f].isNotNull(), F.col(f"__found.{f}")) for f in words},
             "context_status": F.when(p.needs_context(F.col("__q"), F.col("__m")), "context_required").otherwise(named["context_status"]),
             "key_specificity": F.when(specific, "specific").otherwise("generic")}
    intent = F.struct(*[value[f].alias(f) for f in FIELDS], key.alias("knowledge_key"))
    out = out.withColumn("error", error)
    return out.withColumn("intent", F.when(F.col("error").isNull(), intent)).drop(*[c for c in out.columns if c.startswith("__")])
