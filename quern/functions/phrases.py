"""Rules over sentences and facts: tokens of topics, prose checks, splits, spans, composition, contracts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import identifiers, squeezed

# Words that carry no topic, and words that mean the same.
STOP_WORDS = (
    "а", "б", "бы", "в", "во", "вы", "да", "для", "до", "если", "же", "за", "и", "из", "или",
    "как", "к", "ко", "ли", "на", "но", "о", "об", "от", "по", "под", "при", "про", "с", "со",
    "так", "то", "у", "уже", "что", "это", "этот", "эти", "я", "мы", "они", "не", "нет", "есть",
    "добрый", "день", "здравствуйте", "вечер", "утро", "коллеги", "пожалуйста", "подскажите",
    "можно", "нужен", "нужна", "нужно", "который", "которая", "какой", "какая", "какие", "где", "куда",
    "почему", "когда", "всем", "просьба", "вопрос", "вопроса", "вопросу", "телеграм", "telegram", "case",
    "http", "https", "www", "ru", "com", "org", "net",
)
SYNONYMS = {
    "пароль": "password", "пароля": "password", "паролей": "password", "паролю": "password", "pwd": "password", "pass": "password",
    "сброс": "reset", "сбросить": "reset", "сбрасывать": "reset", "восстановить": "reset", "восстановления": "reset", "forgot": "reset", "forgotten": "reset", "change": "reset",
    "админ": "admin", "администратор": "admin", "administrator": "admin",
    "устройство": "device", "устройстве": "device", "устройства": "device", "аппарат": "device",
    "подключение": "connect", "подключить": "connect", "подключается": "connect", "соединить": "connect", "connection": "connect",
    "прошивка": "firmware", "прошивки": "firmware", "прошивку": "firmware", "прошивкой": "firmware",
    "ошибка": "error", "ошибки": "error", "ошибку": "error",
    "неработает": "failure",
    "работает": "work",
    "регистратор": "recorder", "регистратора": "recorder", "регистратору": "recorder", "регистраторы": "recorder", "nvr": "recorder",
    "камера": "camera", "камеры": "camera", "камеру": "camera", "камерой": "camera",
    "панель": "panel", "панели": "panel", "панелью": "panel",
    "монитор": "monitor", "монитора": "monitor", "мониторы": "monitor",
    "разрешение": "resolution", "разрешения": "resolution", "разрешении": "resolution",
    "питание": "power", "питания": "power",
    "скачать": "download", "скачивания": "download", "скачивать": "download", "скачивание": "download",
    "актуальная": "current", "актуальную": "current", "последняя": "current", "последнюю": "current", "latest": "current",
    "тревога": "alarm", "тревоги": "alarm", "тревог": "alarm",
    "сеть": "network", "сети": "network", "сетевой": "network",
}
ENGLISH_PROSE = (
    "a", "an", "the", "when", "if", "used", "use", "using", "with", "for", "from", "compatible", "compatibility", "source", "sourcing", "power", "device",
    "devices", "outdoor", "indoor", "installation", "installations", "only", "under", "during", "before", "after", "and", "or", "not", "does", "on",
    "support", "supports", "supported", "can", "cannot", "must", "guarantee", "guarantees", "guaranteed", "according", "to", "this", "that", "model",
    "configured", "configuration", "enabled", "option", "options", "available", "depending", "depends", "required", "requires", "provides", "providing",
)
CHINESE_PROSE = ("在", "使用", "兼容", "设备", "供电", "时", "如果", "当", "支持", "采用", "条件", "来源", "仅", "不能", "不支持", "摄像机", "相机")
PREDICATES = (
    r"has|have|supports?|provides?|uses?|includes?|offers?|features?|is|are|поддерживает|поддерживают|имеет|имеют|использует|используют|предоставляет|"
    r"предоставляют|включает|включают|оснащен|оснащена|содержит|является|являются|обеспечивает|может"
)
DENIALS = r"does\s+not\s+support|не\s+(?:поддерживает|может|гарантирует)"
CHINESE_PREDICATES = "支持|具备|采用|提供|包括"
CONJUNCTIONS = "and|以及|并且|并|и|а также|также"
CONTEXT_QUESTIONS = ("каким методом к камере подключались", "сервер настроить может помочь", "что для этого нужно докупить", "что может быть")
DEICTIC = r"(?U)\b(?:этот|это|данн\w*|такой|такое|с него|с нее|с неe|с неё|к этому|для этого|на этот)\b"
ADDRESS = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"


def normalised(text: Column) -> Column:
    """Lower case, everything but letters, digits and underscores as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s]+", " "), r"(?U)\s+", " "))


def _strings(values) -> Column:
    return F.array(*[F.lit(x) for x in values])


def topic_tokens(text: Column) -> Column:
    """Distinct tokens that name a topic, synonyms as one, sorted; addresses of pages are left out."""
    same = F.create_map(*[F.lit(x) for word, name in SYNONYMS.items() for x in (word, name)])
    words = F.split(normalised(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)https?://\S+", " ")), " ")
    kept = F.filter(words, lambda x: (F.length(x) > 1) & ~x.isin(*STOP_WORDS))
    return F.array_sort(F.array_distinct(F.filter(F.transform(kept, lambda x: F.coalesce(same[x], x)), lambda x: ~x.isin(*STOP_WORDS))))


def focus_tokens(text: Column, models: Column) -> Column:
    """Topic tokens without those of the models."""
    return F.array_except(topic_tokens(text), topic_tokens(F.array_join(models, " ")))


def model_families(models: Column) -> Column:
    """The letters of each model name, words apart, distinct and sorted; names without letters have none."""
    letters = F.transform(models, lambda m: F.array_join(F.regexp_extract_all(normalised(m), F.lit("[a-zа-яё]+"), F.lit(0)), " "))
    return F.array_sort(F.array_distinct(F.filter(letters, lambda x: x != "")))


def families_compatible(left: Column, right: Column) -> Column:
    """Two lists of families can belong together: one is empty, or they share one."""
    return (F.size(left) == 0) | (F.size(right) == 0) | F.arrays_overlap(left, right)


def stable_markers(text: Column) -> Column:
    """Tokens that a translation keeps: those with a digit or two capitals, in lower case, sorted."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9][A-Za-z0-9./()_-]*"), F.lit(0)), lambda x: F.rtrim(x, F.lit(".,;:!?")))
    kept = F.filter(found, lambda x: x.rlike("[0-9]") | (F.length(F.regexp_replace(x, "[^A-Z]", "")) >= 2))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda x: F.lower(x))))


def russian_prose(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[А-Яа-яЁё]")) >= 3


def russian_qualifier(text: Column) -> Column:
    """Russian prose without ordinary English or Chinese words; names, norms and numbers may stand in it."""
    english = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z]+"), F.lit(0)), lambda x: F.lower(x))
    chinese = F.exists(_strings(CHINESE_PROSE), lambda w: F.contains(F.coalesce(text, F.lit("")), w))
    return russian_prose(text) & ~chinese & ~F.arrays_overlap(english, _strings(ENGLISH_PROSE))


def _phrase(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ё"), F.lit("е")), r"(?U)\s+", " "))


def needs_context(question: Column, models: Column) -> Column:
    """Is a question of no use on its own: a known one of that kind, or one that only points, without a model?"""
    q = F.trim(_phrase(question), F.lit(" .!?…"))
    return F.exists(_strings(CONTEXT_QUESTIONS), lambda x: F.startswith(q, x)) | ((F.size(models) == 0) & q.rlike(DEICTIC))


def conjoined_parts(content: Column) -> Column:
    """A sentence with two predicates as two sentences with its subject; any other as it is."""
    whole = F.trim(content)
    joined = rf"(?iu)^(.+?)\s+(?:{CONJUNCTIONS})\s+((?:(?:{DENIALS})|{PREDICATES}|{CHINESE_PREDICATES}).+?)[.!。！？?]*$"
    left, right = (F.trim(F.regexp_extract(whole, joined, k)) for k in (1, 2))
    predicate = rf"(?iuU)\b(?:{PREDICATES}|поддерживаются|поддерживается)\b|{CHINESE_PREDICATES}"
    at = F.regexp_instr(left, F.lit(predicate))
    subject = F.trim(F.left(left, at - 1))
    sentence = lambda x: F.concat(F.rtrim(x, F.lit(".。")), F.lit("."))
    second = F.when(subject == "", right).otherwise(F.concat_ws(" ", subject, right))
    return F.when((left != "") & (at > 0), F.array(sentence(left), sentence(second))).otherwise(F.array(whole))


def covering_span(source: Column, excerpts: Column) -> Column:
    """The smallest part of source that covers the first place of every excerpt; empty if one is not in it, or none is given."""
    said = F.filter(F.transform(excerpts, lambda x: F.trim(x)), lambda x: x != "")
    places = F.transform(said, lambda x: F.struct(F.position(x, source).alias("a"), (F.position(x, source) + F.length(x)).alias("b")))
    first, last = F.array_min(F.transform(places, lambda p: p["a"])), F.array_max(F.transform(places, lambda p: p["b"]))
    return F.when((F.size(said) == 0) | (first == 0), "").otherwise(F.substr(source, first, last - first))


def first_seen(values: Column) -> Column:
    """Values that are not empty, each once by its squeezed lower-case form, in the wording seen first."""
    trimmed = F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")
    keys = F.transform(trimmed, squeezed)
    return F.filter(trimmed, lambda x, i: F.array_position(keys, squeezed(x)) == i + 1)


def composed_conditions(left: Column, right: Column) -> Column:
    none = F.array().cast("array<string>")
    return first_seen(F.concat(F.coalesce(left, none), F.coalesce(right, none)))


def composed_content(content: Column, scope: Column, conditions: Column) -> Column:
    """The content with the scope and conditions that it does not hold yet."""
    key = squeezed(F.trim(content))
    wanted = F.concat(F.filter(F.array(F.trim(scope)), lambda x: x != ""), first_seen(conditions))
    missing = F.filter(wanted, lambda x: ~F.contains(key, squeezed(x)))
    return F.when(F.size(missing) > 0, F.concat(F.rtrim(F.trim(content), F.lit(" .;")), F.lit(" — "), F.array_join(missing, "; "))).otherwise(F.trim(content))


def unseen(text: Column, pool: Column) -> Column:
    """Identifiers, then numbers of three or more digits, of a text that its pool of sources does not hold."""
    upper = lambda a: F.transform(a, lambda x: F.upper(x))
    digits = lambda c: F.regexp_extract_all(c, F.lit("[0-9]{3,}"), F.lit(0))
    return F.concat(F.array_sort(F.array_except(upper(identifiers(text)), upper(identifiers(pool)))), F.array_sort(F.array_except(digits(text), digits(pool))))


def rendered_unit(title: Column, kind: Column, d: dict[str, Column]) -> Column:
    """The readable text of a unit from its fields. d: models, versions, regions, conditions, prerequisites, warnings, exceptions,
    ordered_steps (arrays), expected_result, trigger, result, observation (text); missing ones may be left out."""
    none = F.lit(None).cast("array<string>")
    full = lambda name: F.filter(F.transform(F.coalesce(d.get(name, none), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    said = lambda label, name: F.when(F.trim(d.get(name, F.lit(None).cast("string"))) != "", F.concat(F.lit(label), F.trim(d.get(name, F.lit(None).cast("string")))))
    listed = lambda label, name: F.when(F.size(full(name)) > 0, F.concat(F.lit(label), F.array_join(full(name), "；")))
    scope = F.filter(F.array(*[F.when(F.size(full(n)) > 0, F.concat(F.lit(f"{n}: "), F.array_join(full(n), ", "))) for n in ("models", "versions", "regions", "conditions")]), lambda x: x.isNotNull())
    head = F.array(F.trim(title), F.when(F.size(scope) > 0, F.concat(F.lit("适用范围："), F.array_join(scope, "；"))), listed("前置条件：", "prerequisites"), listed("警告：", "warnings"), listed("例外：", "exceptions"))
    steps = F.concat(F.transform(full("ordered_steps"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), F.array(said("预期结果：", "expected_result")))
    body = F.when(kind == "procedure", steps).when(kind == "rule", F.array(said("触发条件：", "trigger"), said("结论：", "result"))) \
        .when(kind == "experience", F.array(said("现象与结果：", "observation"))).otherwise(F.array().cast("array<string>"))
    return F.trim(F.array_join(F.filter(F.concat(head, body), lambda x: x != ""), "\n"))


def signature_error(signature: Column, models: Column, most: int = 240) -> Column:
    """Why a topic signature cannot be kept, or ok: it names nothing, is too long, or holds a model or an address of its case."""
    s = F.trim(F.regexp_replace(signature, r"(?U)\s+", " "))
    named = F.exists(models, lambda m: (m != "") & F.contains(F.lower(s), F.lower(m)))
    return F.when(F.coalesce(s, F.lit("")) == "", "empty").when(F.length(s) > most, "too_long").when(named, "model").when(s.rlike(ADDRESS), "address").otherwise("ok")


def claims(text: Column) -> Column:
    """array<struct<claim, claim_type>> of a JSON list of texts and objects; empty claims go, the type is other if none is stated."""
    field = lambda x, name: F.get_json_object(x, f"$.{name}")
    items = F.transform(F.from_json(text, "array<string>"), lambda x: F.when(F.startswith(F.ltrim(x), F.lit("{")), F.struct(
        F.trim(field(x, "claim")).alias("claim"), F.coalesce(F.nullif(F.trim(field(x, "claim_type")), F.lit("")), F.lit("other")).alias("claim_type"))).otherwise(
            F.struct(F.trim(x).alias("claim"), F.lit("other").alias("claim_type"))))
    return F.coalesce(F.filter(items, lambda x: F.coalesce(x["claim"], F.lit("")) != ""), F.array().cast("array<struct<claim:string,claim_type:string>>"))


def fingerprint(title: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws("\n", squeezed(title), squeezed(content)), 256)


def content_hash(text: Column, layout: Column) -> Column:
    """The hash of a block's text and layout, the layout as JSON text with sorted keys."""
    quoted = F.regexp_extract(F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    return F.sha2(F.concat(F.lit('{"layout": '), F.coalesce(layout, F.lit("{}")), F.lit(', "text": '), quoted, F.lit("}")), 256)
