"""Scalar functions over documents, questions and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import scope, text as t
from quern.operators import overlay
from quern.plans import sql as s
from quern.plans.common import registry
from quern.session import table

QUERIES, SQL, query = registry()

_IDS = r"list_distinct(list_transform(list_filter(regexp_extract_all({0}, '[A-Za-z0-9][A-Za-z0-9./()\-]{{2,}}'), lambda x: regexp_matches(x, '[0-9]')), lambda x: upper(x)))"
_KEY = "regexp_replace(upper({0}), '[^A-Z0-9]', '', 'g')"


def ids(text: str) -> str:
    return _IDS.format(text)


def scope_models(text: str) -> str:
    listed = ", ".join(f"'{x}'" for x in t.STANDARDS)
    key = _KEY.format("x")
    return (f"list_filter({ids(text)}, lambda x: NOT regexp_matches({key}, '^[0-9]*$') AND "
            rf"NOT regexp_matches(x, '(?i)^(?:V?[0-9]+(?:[.,][0-9]+)+|BUILD\s*[0-9]+|[0-9]{{6,8}})$') AND {key} NOT IN ({listed}))")


@query("f01_language", "SELECT lang_class, count(*) AS n FROM (SELECT CASE WHEN greatest(ru,zh,en)=0 THEN 'und' WHEN ru=greatest(ru,zh,en) THEN 'ru' WHEN zh=greatest(ru,zh,en) THEN 'zh' ELSE 'en' END AS lang_class FROM (SELECT len(regexp_extract_all(text,'[А-Яа-яЁё]')) AS ru, len(regexp_extract_all(text,'[\\x{3400}-\\x{9fff}]')) AS zh, len(regexp_extract_all(text,'[A-Za-z]')) AS en FROM documents)) GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "documents").groupBy(t.language(F.col("text")).alias("lang_class")).agg(F.count("*").alias("n"))


@query("f02_identifiers", f"SELECT doc_id, len(i) AS n_ids, coalesce(array_to_string(list_sort(i), ','), '') AS ids FROM (SELECT doc_id, {ids('text')} AS i FROM documents) WHERE len(i) > 0")
def _(spark, sf):
    return (table(spark, sf, "documents").select("doc_id", t.identifiers(F.col("text")).alias("i")).where(F.size("i") > 0)
            .select("doc_id", F.size("i").cast("long").alias("n_ids"), F.array_join(F.array_sort("i"), ",").alias("ids")))


@query("f03_version_tokens", r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(k, list_filter(list_transform(k, lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: x <> '')))), ',') AS versions FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '(?i)V?[0-9]+(?:[.,][0-9]+)+|\bBUILD\s*[0-9]+|\b[0-9]{6,8}\b'), lambda x: regexp_replace(upper(x), '[^A-Z0-9]', '', 'g')), lambda x: x <> '') AS k FROM documents) WHERE len(k) > 0")
def _(spark, sf):
    return (table(spark, sf, "documents").select("doc_id", t.version_tokens(F.col("text")).alias("v")).where(F.size("v") > 0)
            .select("doc_id", F.array_join("v", ",").alias("versions")))


@query("f04_scope_models", f"SELECT p_partkey, array_to_string(list_sort({scope_models('label')}), ',') AS models FROM (SELECT p_partkey, p_name || ' DS-' || p_size || 'K1 5.6.' || p_size || ' H.265 ' || p_brand AS label FROM part)")
def _(spark, sf):
    label = F.concat_ws(" ", "p_name", F.concat(F.lit("DS-"), "p_size", F.lit("K1")), F.concat(F.lit("5.6."), "p_size"), F.lit("H.265"), "p_brand")
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(t.scope_models(label)), ",").alias("models"))


_PAIRS = "(SELECT p_partkey, list_value('DS-'||p_size, 'DS-K'||(p_size % 7)) AS u, list_value('DS-'||(p_size + p_partkey % 2), 'DS-K'||(p_size % 7)||'T') AS d FROM part)"
_RANK = "CASE WHEN {a}={b} THEN 0 WHEN starts_with({a},{b}) OR starts_with({b},{a}) THEN 1 ELSE 2 END"


def _worst(outer, inner):
    rank = _RANK.format(a=_KEY.format("i"), b=_KEY.format("o"))
    return f"list_transform({outer}, lambda o: list_min(list_transform({inner}, lambda i: {rank})))"


def _pairs(spark, sf):
    part = table(spark, sf, "part")
    return part.select("p_partkey", F.array(F.concat(F.lit("DS-"), "p_size"), F.concat(F.lit("DS-K"), F.col("p_size") % 7)).alias("u"),
                       F.array(F.concat(F.lit("DS-"), F.col("p_size") + F.col("p_partkey") % 2), F.concat(F.lit("DS-K"), F.col("p_size") % 7, F.lit("T"))).alias("d"))


@query("f05_f06_scope_match", f"SELECT p_partkey, CASE WHEN list_max(w)=2 THEN 'conflict' WHEN list_max(w)=0 THEN 'exact' ELSE 'family' END AS scope FROM (SELECT p_partkey, {_worst('d', 'u')} AS w FROM {_PAIRS})")
def _(spark, sf):
    return _pairs(spark, sf).select("p_partkey", scope.scope_match(F.col("u"), F.col("d")).alias("scope"))


@query("f07_verified_scope", f"SELECT p_partkey, CASE WHEN list_max(w)=2 THEN 'conflict' WHEN list_max(w)=0 THEN 'exact' ELSE 'family' END AS scope FROM (SELECT p_partkey, {_worst('u', 'd')} AS w FROM {_PAIRS})")
def _(spark, sf):
    return _pairs(spark, sf).select("p_partkey", scope.verified_scope_match(F.col("u"), F.col("d")).alias("scope"))


@query("f09_expanded_alias_terms", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'face ' || p_name || ' карт' || ' card access' WHEN p_size % 3 = 1 THEN p_name || ' добавить лицо add adding face' ELSE p_name END AS question FROM part")
def _(spark, sf):
    asked = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("face "), "p_name", F.lit(" карт"))).when(
        F.col("p_size") % 3 == 1, F.concat("p_name", F.lit(" добавить лицо"))).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", t.expanded(asked).alias("question"))


@query("f10_context_only", "SELECT p_partkey, p_size % 2 = 0 AS context_only FROM part")
def _(spark, sf):
    asked = F.when(F.col("p_size") % 2 == 0, "  Hik-Connect! ").otherwise(F.concat(F.lit("hik connect "), "p_name"))
    return table(spark, sf, "part").select("p_partkey", F.coalesce(t.context_only(asked), F.lit(False)).alias("context_only"))


_ROUTE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(question), '{p}') THEN '{n}'" for n, p in (
    ("inventory", "available|availability|stock|price"), ("compatibility", r"compatible|\bconnect(?:ed|ion)?\b|\bintegrat\w*\b"),
    ("fault", "troubleshoot|error|doesn.?t work"), ("operation", "how to|configure|reset|update"), ("parameter", "what|which|support"))) + \
    f" WHEN len({ids('question')}) > 0 THEN 'parameter' ELSE 'unknown' END"


@query("f11_route_question", s.with_(s.QUESTIONS) + f"SELECT route, count(*) AS n FROM (SELECT {_ROUTE_SQL} AS route FROM (SELECT question FROM questions UNION ALL SELECT p_name || (CASE p_size % 5 WHEN 0 THEN ' price' WHEN 1 THEN ' how to reset' WHEN 2 THEN ' error' WHEN 3 THEN ' DS-1' ELSE ' connected' END) FROM part)) GROUP BY 1")
def _(spark, sf):
    ending = F.element_at(F.array(*[F.lit(x) for x in (" price", " how to reset", " error", " DS-1", " connected")]), F.col("p_size") % 5 + 1)
    asked = overlay.questions(spark, sf).select("question").unionByName(table(spark, sf, "part").select(F.concat("p_name", ending).alias("question")))
    return asked.groupBy(t.route(F.col("question"), t.identifiers(F.col("question"))).alias("route")).agg(F.count("*").alias("n"))


@query("f12_token_sets", f"SELECT doc_id, len(k) AS n_tokens, list_min(k) AS least_token FROM (SELECT doc_id, {s.tokens('text')} AS k FROM documents)")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.tokens(F.col("text")).alias("k")).select(
        "doc_id", F.size("k").cast("long").alias("n_tokens"), F.array_min("k").alias("least_token"))


@query("f16_slug_keys", "SELECT p_type, trim(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g'), '_') AS slug, count(*) AS n FROM part GROUP BY 1, 2")
def _(spark, sf):
    return table(spark, sf, "part").groupBy("p_type", t.slug(F.col("p_type")).alias("slug")).agg(F.count("*").alias("n"))


@query("f18_knowledge_key", "SELECT p_partkey, CASE WHEN p_brand = p_type THEN p_brand ELSE trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') || '.' || trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') END AS knowledge_key FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.array_distinct(F.array(t.slug(F.col("p_brand")), t.slug(F.col("p_type")))), ".").alias("knowledge_key"))


@query("f21_bulk_detection", r"SELECT doc_id, (len(regexp_extract_all(text, '(?m)^\s*(?:[0-9]+[.)]|[-*•])\s')) >= 4 OR length(text) >= 600) AS is_bulk, greatest(1, len(regexp_extract_all(text, '(?m)^\s*[0-9]+[.)]\s')), len(regexp_extract_all(text, '(?m)^\s*[-*•]\s')), len(regexp_extract_all(text, '[.!?](?:\s|$)'))) AS min_claims FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.is_bulk(F.col("text")).alias("is_bulk"), t.claims_at_least(F.col("text")).cast("long").alias("min_claims"))


@query("f26_question_parts", r"SELECT conv_id, turn, CASE WHEN trim(t)='' THEN 0 WHEN len(list_filter(regexp_extract_all(trim(t), '[^?\n]*\?'), lambda x: trim(x) <> '')) <= 1 THEN 1 ELSE least(12, len(list_filter(regexp_extract_all(trim(t), '[^?\n]*\?'), lambda x: trim(x) <> ''))) END AS n_parts FROM (SELECT conv_id, turn, text || ' a? b? ' || text AS t FROM conversations)")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(t.question_parts(F.concat("text", F.lit(" a? b? "), "text"))).cast("long").alias("n_parts"))


@query("f28_verbatim_excerpt", r"SELECT doc_id, contains(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), trim(regexp_replace(lower(substr(text, 5, 40)), '\s+', ' ', 'g'))) AS verbatim FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.contains(t.squeezed(F.col("text")), t.squeezed(F.substring("text", 5, 40))).alias("verbatim"))


@query("f30_redact_secrets", "SELECT doc_id, md5(regexp_replace(regexp_replace(text, '/bot[0-9]+:[A-Za-z0-9_-]+', '/bot[REDACTED]', 'g'), 'AKIA[0-9A-Z]{16}', '[REDACTED]', 'g')) AS digest FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(t.redacted(F.col("text"))).alias("digest"))


@query("f37_explicit_models", r"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(list_concat(list_filter(regexp_extract_all(l, '[A-Za-z0-9][A-Za-z0-9./()\-]{2,}'), lambda x: regexp_matches(x, '[0-9]')), list_filter(regexp_extract_all(l, '[A-Za-z0-9][A-Za-z0-9./()_-]*'), lambda x: length(x) >= 3 AND contains(x, '-') AND x = upper(x) AND regexp_matches(x, '[A-Z]'))), lambda x: lower(x)))), ',') AS models FROM (SELECT p_partkey, p_brand || ' TEST-X ' || 'DS-' || p_size || ' abc-d' AS l FROM part)")
def _(spark, sf):
    label = F.concat_ws(" ", "p_brand", F.lit("TEST-X"), F.concat(F.lit("DS-"), "p_size"), F.lit("abc-d"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(t.explicit_models(label), ",").alias("models"))


@query("f40_request_hash", "SELECT conv_id, turn, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) || '|conv_id=' || conv_id || ';role=' || role) AS request_hash FROM conversations")
def _(spark, sf):
    context = F.array_sort(F.array(F.concat(F.lit("role="), "role"), F.concat(F.lit("conv_id="), "conv_id")))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(F.concat_ws("|", t.squeezed(F.col("text")), F.array_join(context, ";")), 256).alias("request_hash"))


@query("f42_section_signature", r"SELECT source, sha256(string_agg(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), chr(10) ORDER BY doc_id)) AS signature FROM documents GROUP BY source")
def _(spark, sf):
    return (table(spark, sf, "documents").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", t.squeezed(F.col("text")).alias("x")))).alias("l"))
            .select("source", F.sha2(F.array_join(F.col("l.x"), "\n"), 256).alias("signature")))


@query("f45_group_key", "SELECT p_type, 'group.' || left(sha1(string_agg(title, chr(10) ORDER BY title)), 16) AS group_key FROM (SELECT DISTINCT p_type, p_name AS title FROM part) GROUP BY 1")
def _(spark, sf):
    return (table(spark, sf, "part").groupBy("p_type").agg(F.array_sort(F.collect_set("p_name")).alias("l"))
            .select("p_type", F.concat(F.lit("group."), F.left(F.sha1(F.array_join("l", "\n")), F.lit(16))).alias("group_key")))


@query("p15_keyword_triggers", "SELECT doc_id, (" + " OR ".join(f"contains(lower(text), '{w}')" for w in t.SOURCE_WORDS) + ") AS asks_source, (" + " OR ".join(f"contains(lower(text), '{w}')" for w in t.RISK_WORDS) + ") AS high_risk FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.mentions(F.col("text"), t.SOURCE_WORDS).alias("asks_source"), t.mentions(F.col("text"), t.RISK_WORDS).alias("high_risk"))
