"""Packages of cases for one piece of knowledge: selection by rules, thread payloads, forced keys, rows of failed packages, evidence."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_KEY = "cast(array() as array<string>)"


@dataclass(frozen=True)
class Package:
    """The cases of a package have a key that begins with ``prefix``, one of ``keys``, or one of ``words`` in key or question.
    ``key`` is the key of its knowledge; the knowledge may keep one of ``keys`` if it has it already."""

    name: str
    key: str
    prefix: str | None = None
    keys: tuple[str, ...] = ()
    words: tuple[str, ...] = ()
    kind: str = "other"

    def holds(self, key: Column, question: Column) -> Column:
        key, question = F.coalesce(key, F.lit("")), F.lower(F.coalesce(question, F.lit("")))
        rules = [key.isin(*self.keys)] if self.keys else []
        if self.prefix is not None:
            rules.append(key.startswith(self.prefix))
        rules += [F.lower(key).contains(w) | question.contains(w) for w in self.words]
        return reduce(lambda a, b: a | b, rules, F.lit(False))


def selected(items: DataFrame, packages: dict[str, Package]) -> DataFrame:
    """(package, case_id, position): the cases of each package, numbered from 0 by case_id; a case can be in several.
    items: case_id, knowledge_key, question."""
    codes = F.array(*[F.when(p.holds(F.col("knowledge_key"), F.col("question")), code) for code, p in packages.items()])
    rows = items.select("case_id", F.explode(F.filter(codes, lambda x: x.isNotNull())).alias("package")).distinct()
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("package").orderBy("case_id")) - 1)


def thread_payloads(cases: DataFrame, messages: DataFrame) -> DataFrame:
    """(case_id, messages): the thread of each case as array<struct<message_index, actor, text, attachments>>. The
    root's author is the user, all others are engineers; without a root author the first message is the user's. Only the kinds of
    attachments are told. A case without messages has its question as the only one, or none.

    cases: case_id, root_author, root_question. messages: case_id, message_index, author, text, file, photo."""
    kinds = F.filter(F.array(*[F.when(F.coalesce(F.col(k), F.lit("")) != "", k) for k in ("file", "photo")]), lambda x: x.isNotNull())
    author, root = F.coalesce("author", F.lit("")), F.coalesce("root_author", F.lit(""))
    user = ((author != "") & (author == root)) | ((root == "") & (F.col("message_index") == 0))
    told = F.struct("message_index", F.when(user, "user").otherwise("engineer").alias("actor"), F.coalesce("text", F.lit("")).alias("text"), kinds.alias("attachments"))
    threads = messages.join(cases.select("case_id", "root_author"), "case_id").groupBy("case_id").agg(F.array_sort(F.collect_list(told)).alias("told"))
    question = F.array(F.struct(F.lit(0).alias("message_index"), F.lit("user").alias("actor"), F.col("root_question").alias("text"), F.expr(NO_KEY).alias("attachments")))
    alone = F.when(F.coalesce("root_question", F.lit("")) != "", question).otherwise(F.array())
    return cases.join(threads, "case_id", "left").select("case_id", F.coalesce("told", alone).alias("messages"))


def forced_key(package: Column, key: Column, packages: dict[str, Package]) -> Column:
    """The key of a package's knowledge, whatever the model said, but for the other keys that the package allows."""
    out = key
    for code, p in packages.items():
        out = F.when(package == code, F.when(key.isin(*p.keys), key).otherwise(p.key) if p.keys else F.lit(p.key)).otherwise(out)
    return out


def with_failed(drafts: DataFrame, cases: DataFrame, failures: DataFrame, packages: dict[str, Package]) -> DataFrame:
    """drafts (package, knowledge_key, title, kind, case_ids, confidence, note) and a row for each package that failed:
    all its cases, no claims, low confidence, to be looked at by an engineer. Failed packages keep no draft.
    cases: package, case_id. failures: package, failure (the least counts)."""
    failed = failures.groupBy("package").agg(F.min("failure").alias("failure"))
    ids = cases.groupBy("package").agg(F.array_sort(F.collect_set("case_id")).alias("case_ids"))
    rows = failed.where(F.col("package").isin(*packages)).join(ids, "package", "left")
    named = {code: (p.name, p.kind) for code, p in packages.items()}
    label = reduce(lambda c, code: F.when(F.col("package") == code, named[code][0]).otherwise(c), named, F.lit(""))
    kind = reduce(lambda c, code: F.when(F.col("package") == code, named[code][1]).otherwise(c), named, F.lit("other"))
    rows = rows.select("package", forced_key(F.col("package"), F.lit(""), packages).alias("knowledge_key"), F.concat(label, F.lit(" — engineer review required")).alias("title"), kind.alias("kind"),
                       F.coalesce("case_ids", F.array()).alias("case_ids"), F.lit("low").alias("confidence"), F.concat(F.lit("needs_engineer: "), "failure").alias("note"))
    return drafts.join(failed, "package", "left_anti").select(*rows.columns).unionByName(rows)


def cited_evidence(citations: DataFrame, sources: DataFrame, cases: DataFrame) -> DataFrame:
    """(package, evidence): what the drafts' citations name, each once, in the order first named, as (source_type, evidence_id, case_id,
    message_indexes, role). A citation of a known source counts as that source; else one of a case of the package, as a
    message with its role; others go. Indexes that are no numbers go.

    citations: package, position, evidence_id, case_id, message_indexes array<string>, role. sources: evidence_id, source_type. cases: package, case_id."""
    known = sources.groupBy("evidence_id").agg(F.min("source_type").alias("source_type"))
    own = cases.select("package", "case_id", F.lit(True).alias("own")).distinct()
    rows = citations.join(known, "evidence_id", "left").join(own, ["package", "case_id"], "left").where("source_type is not null or own")
    source = F.col("source_type").isNotNull()
    numbers = F.filter(F.transform(F.coalesce("message_indexes", F.expr(NO_KEY)), lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    item = F.struct(F.coalesce("source_type", F.lit("telegram")).alias("source_type"), F.when(source, F.col("evidence_id")).alias("evidence_id"), F.when(~source, F.col("case_id")).alias("case_id"),
                    F.when(~source, numbers).alias("message_indexes"), F.when(~source, F.coalesce("role", F.lit("unconfirmed_claim"))).alias("role"))
    once = rows.select("package", "position", item.alias("e")).groupBy("package", "e").agg(F.min("position").alias("at"))
    return once.groupBy("package").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "e"))), lambda x: x["e"]).alias("evidence"))
