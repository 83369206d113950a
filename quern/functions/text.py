"""Identifiers, tokens and classes of short texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, vocabularies and word lists that decide results.
MODEL = r"[A-Za-z0-9][A-Za-z0-9./()\-]{2,}"
TOKEN = r"[A-Za-z0-9][A-Za-z0-9./()_-]*|[\x{0400}-\x{04ff}]+|[\x{4e00}-\x{9fff}]"
VERSION = r"(?i)V?\d+(?:[.,]\d+)+|\bBUILD\s*\d+|\b\d{6,8}\b"
VERSION_ONLY = r"(?i)^(?:V?\d+(?:[.,]\d+)+|BUILD\s*\d+|\d{6,8})$"
STANDARDS = ["H264", "H265", "H266", "H264P", "H265P", "ONVIF", "POE", "POEP", "WIFI", "IP66", "IP67", "IP68", "IK10", "RTSP", "RTP",
             "RTCP", "HTTP", "HTTPS", "TCP", "UDP", "X8021", "8021X", "GB28181", "12V", "24V", "48V", "220V", "12VDC", "24VAC"]
CONTEXT_ONLY = ["iflow", "hikvision", "hiwatch", "hik connect", "hikconnect", "guardingvision", "guarding vision"]
ROUTES = [
    ("inventory", r"налич|доступ\w*|есть в наличии|на складе|купить|цена|стоимост|available|availability|stock|price"),
    ("compatibility", r"совместим|подключ\w*|работать вместе|интеграц|подходит|compatible|\bconnect(?:ed|ion)?\b|\bintegrat\w*\b"),
    ("fault", r"не работает|ошиб|проблем|почему|завис|не видит|не открыва|не отправля|слом|troubleshoot|error|doesn.?t work"),
    ("operation", r"как |как сделать|настро|добав|удал|сброс|восстанов|прошив|скачать|войти|how to|configure|reset|update"),
    ("parameter", r"сколько|какой|какие|есть ли|поддержива|характерист|разрешен|канал|размер|протокол|what|which|support"),
]
ALIAS_TERMS = [
    (r"сброс|восстанов(?:ить|ление)|забыл.*парол|парол.*забыл", "password reset forgot password"),
    (r"\bhik[\s-]?connect\b|хик[\s-]?коннект|хикконнект", "Hik-Connect hikconnect hcserver server address server IP"),
    (r"hikvision|хиквижн|хика|hiwatch|хайвоч|iflow|айфлоу", "Hikvision HiWatch iFlow"),
    (r"пальц|палец|отпечат", "fingerprint fingerprints"),
    (r"добав|добавл", "add adding"),
    (r"оборудован|устройств|терминал|панел", "device terminal equipment panel"),
    (r"лиц|фейс", "face"),
    (r"карт|пропуск", "card access card"),
]
SOURCE_WORDS = ["原文", "核对", "核查", "手册", "表格", "第几页", "哪一页", "幻灯片", "说明书", "截图", "界面", "original", "source", "manual", "table",
                "page", "slide", "провер", "оригинал", "таблиц", "руководств", "страниц"]
RISK_WORDS = ["恢复出厂", "factory reset", "升级", "firmware", "прошив", "密码", "password", "пароль", "反潜回", "联动"]


def _has(text: Column, pattern: str) -> Column:
    return text.rlike("(?iuU)" + pattern)


def language(text: Column) -> Column:
    """Most frequent of Cyrillic, CJK and Latin letters; ru, zh, en in case of ties; und without any."""
    text = F.coalesce(text, F.lit(""))
    ru, zh, en = (F.regexp_count(text, F.lit(p)) for p in ("[А-Яа-яЁё]", "[\\x{3400}-\\x{9fff}]", "[A-Za-z]"))
    most = F.greatest(ru, zh, en)
    return F.when(most == 0, "und").when(ru == most, "ru").when(zh == most, "zh").otherwise("en")


def by_length(values: Column) -> Column:
    """Distinct, longest first, then by value."""
    keyed = F.transform(F.array_distinct(values), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("v")))
    return F.transform(F.array_sort(keyed), lambda s: s["v"])


def identifiers(text: Column) -> Column:
    """Model-like tokens that hold a digit, in capitals."""
    found = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MODEL), F.lit(0)), lambda x: x.rlike("[0-9]"))
    return by_length(F.transform(found, F.upper))


def scope_key(value: Column) -> Column:
    return F.regexp_replace(F.upper(value), "[^A-Z0-9]", "")


def scope_models(text: Column) -> Column:
    """Identifiers that can be product models: no bare numbers, versions, codecs or standards."""
    return F.filter(identifiers(text), lambda x: ~scope_key(x).rlike("^[0-9]*$") & ~x.rlike(VERSION_ONLY) & ~scope_key(x).isin(STANDARDS))


def version_tokens(text: Column) -> Column:
    """Versions and builds as letters and digits, each also as digits alone; sorted."""
    keys = F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(VERSION), F.lit(0)), scope_key), lambda x: x != "")
    digits = F.filter(F.transform(keys, lambda x: F.regexp_replace(x, "[^0-9]", "")), lambda x: x != "")
    return F.array_sort(F.array_union(keys, digits))


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens: Latin runs, Cyrillic runs and single CJK characters."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower))


def explicit_models(text: Column) -> Column:
    """Model tokens and all-capital hyphenated tokens with a letter, lower case, sorted."""
    models = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MODEL), F.lit(0)), lambda x: x.rlike("[0-9]"))
    capital = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9][A-Za-z0-9./()_-]*"), F.lit(0)),
                       lambda x: x.rlike("^.{3,}$") & x.contains("-") & (x == F.upper(x)) & x.rlike("[A-Z]"))
    return F.array_sort(F.array_distinct(F.transform(F.concat(models, capital), F.lower)))


def route(question: Column, models: Column) -> Column:
    """First rule that matches, else parameter if a model is named, else unknown."""
    out = None
    for name, pattern in ROUTES:
        out = F.when(_has(question, pattern), name) if out is None else out.when(_has(question, pattern), name)
    return out.when(F.size(models) > 0, "parameter").otherwise("unknown")


def context_only(text: Column) -> Column:
    """Is the text nothing but a brand or platform name?"""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[\W_]+", " ")).isin(CONTEXT_ONLY)


def alias_terms(text: Column) -> Column:
    """Retrieval terms of built-in terminology, first occurrence kept."""
    parts = [F.when(_has(text, p), F.split(F.lit(e), " ")).otherwise(F.array().cast("array<string>")) for p, e in ALIAS_TERMS]
    return F.array_distinct(F.concat(*parts))


def expanded(text: Column) -> Column:
    terms = alias_terms(text)
    return F.when(F.size(terms) > 0, F.concat_ws(" ", text, F.array_join(terms, " "))).otherwise(text)


def mentions(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(text), w))


def question_parts(text: Column, most: int = 12) -> Column:
    """Parts that end in a question mark if there are several, else the whole text."""
    whole = F.trim(text)
    parts = F.filter(F.transform(F.regexp_extract_all(whole, F.lit(r"[^?\n]*\?"), F.lit(0)), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(whole == "", F.array().cast("array<string>")).when(F.size(parts) <= 1, F.array(whole)).otherwise(F.slice(parts, 1, most))


def slug(text: Column) -> Column:
    """Lower case, runs of other characters as one underscore."""
    return F.trim(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), F.lit("_"))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def redacted(text: Column, secrets: list[str] = ()) -> Column:
    """Registered secrets, longest first, then bot tokens in paths and key-like assignments."""
    for s in sorted(secrets, key=lambda s: (-len(s), s)):
        text = F.replace(text, F.lit(s), F.lit("[REDACTED]"))
    text = F.regexp_replace(text, r"/bot[0-9]+:[A-Za-z0-9_-]+", "/bot[REDACTED]")
    return F.regexp_replace(text, r"AKIA[0-9A-Z]{16}", "[REDACTED]")


def claims_at_least(text: Column) -> Column:
    """Lower bound of explicit claims: the largest of numbered lines, bullet lines and sentences, one at least."""
    counts = [F.regexp_count(text, F.lit(p)) for p in (r"(?m)^\s*\d+[.)]\s", r"(?m)^\s*[-*•]\s", r"[.!?](?:\s|$)")]
    return F.greatest(F.lit(1), *counts)


def is_bulk(text: Column, lines: int = 4, chars: int = 600) -> Column:
    return (F.regexp_count(text, F.lit(r"(?m)^\s*(?:\d+[.)]|[-*•])\s")) >= lines) | (F.length(text) >= chars)
