"""Hybrid retrieval for many questions at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as t
from quern.functions import vectors as v
from quern.operators import counted, tiles

#: Asked tokens up to which questions are counted where rows are read.
ASKED = 200_000
#: Names up to which they are broadcast.
FEW = 100_000


def eligible(knowledge: DataFrame, sources: DataFrame, trusted: tuple[str, ...] = ("official_source", "user_confirmed")) -> DataFrame:
    """Active, trusted, with an accepted supporting source and no accepted contradicting one."""
    accepted = sources.where("resolution = 'accepted'")
    return (knowledge.where("active").where(F.col("trust").isin(*trusted))
            .join(accepted.where("relation = 'supports'"), F.col("id") == F.col("knowledge_id"), "left_semi")
            .join(accepted.where("relation = 'contradicts'"), F.col("id") == F.col("knowledge_id"), "left_anti"))


def contained(texts: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """(key, name) where a name occurs in a text, ignoring case: an equality join on all
    substrings of the lengths that names have, for short texts and many names."""
    lengths = names.agg(F.collect_set(F.length(name)).alias("n")).scalar()
    parts = texts.select(key, F.lower(text).alias("__t")).withColumn("__n", F.explode(lengths)).where("__n > 0 and __n <= length(__t)") \
        .select(key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("__t") - F.col("__n") + 1), lambda i: F.substr("__t", i, F.col("__n"))))).alias("__p"))
    wanted = names.where(F.length(name) > 0).select(F.col(name), F.lower(name).alias("__p")).distinct()
    # Only substrings that are names are told apart; up to FEW names are broadcast, so no other one is held or shuffled.
    if wanted.limit(FEW + 1).count() <= FEW:
        wanted = F.broadcast(wanted)
    return parts.join(wanted, "__p").select(key, name).distinct()


def matched(held: DataFrame, asked: DataFrame, most: int = 200_000) -> DataFrame:
    """held (id, token, ...) joined with asked (token, ...). Up to ``most`` asked rows are broadcast:
    tokens that nobody asks for then never leave their task, and what is left is dealt out by id, so
    that all pairs of a row meet in one task and are counted without another shuffle."""
    if asked.limit(most + 1).count() > most:
        return held.join(asked, "token")
    wanted = held.join(F.broadcast(asked.select("token").distinct()), "token", "left_semi")
    return wanted.repartition("id").join(F.broadcast(asked), "token")


def lexical_scores(questions: DataFrame, rows: DataFrame, text: Column, entity: str | None = "entity_name", k: int | None = None) -> DataFrame:
    """(qid, id, lexical, same_model) of all pairs with a positive score. questions: qid,
    question. rows: id and what text and entity name. With ``k`` only what can be among a question's k
    best, the same model first, then by score rounded to 9 digits, then id.

    Pairs come from shared tokens and from entities named in the question, which travel as tokens of a kind of
    their own; no other pair can score. Up to ASKED asked tokens pairs are counted where the rows are read,
    more are joined on the token."""
    q = questions.select("qid", "question", t.tokens(F.col("question")).alias("qt"))
    asked = q.select("qid", F.size("qt").alias("n_q"), F.explode("qt").alias("token"))
    # Row sizes travel with the tokens, so that texts are read and tokenised once.
    held = rows.select("id", t.tokens(text).alias("rt"), (F.col(entity) if entity else F.lit(None).cast("string")).alias("__entity"))
    tokens = F.col("rt")
    if entity:
        mark = F.concat(F.lit("\0"), "__entity")
        named = contained(q, "qid", "question", rows.select(F.col(entity).alias("__entity")).distinct(), "__entity")
        asked = asked.unionByName(named.join(q.select("qid", F.size("qt").alias("n_q")), "qid").select("qid", "n_q", mark.alias("token")))
        tokens = F.when(F.col("__entity") != "", F.array_append("rt", mark)).otherwise(tokens)
    held = held.select("id", F.size("rt").alias("n_row"), tokens.alias("tokens"))
    few = _few(asked)
    if few is None:
        one = held.select("id", "n_row", F.explode("tokens").alias("token"))
        is_name = F.col("token").startswith("\0")
        pairs = matched(one, asked).groupBy("qid", "id", "n_q", "n_row").agg(F.count_if(~is_name).alias("shared"), F.bool_or(is_name).alias("same_model"))
    else:
        pairs = counted.matches(few, held, _type(asked, "qid"), _lexical_key, k)
    score = v.lexical(F.col("shared"), F.col("n_q"), F.col("n_row"), F.col("same_model"))
    return pairs.select("qid", "id", score.alias("lexical"), "same_model").where("lexical > 0")


def _few(asked: DataFrame):
    """The asked tokens as they are broadcast, or None if there are more than ASKED."""
    found = asked.where("qid is not null").distinct().limit(ASKED + 1).toPandas()
    return found if len(found) <= ASKED else None


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _lexical_key(shared, uses, named, n_q, n_row):
    """The order of scores: the same model first, then the score in units of the ninth digit; without one -inf."""
    score = np.minimum(2.0, shared / np.sqrt(np.maximum(n_q * n_row, 1)) + named)
    score = np.where((n_q == 0) | (n_row == 0), 0.0, score)
    return np.where(score > 0, np.floor(score * 1e9 + 0.5) + named * 4e9, -np.inf)


def _share_key(shared, uses, named, n_q, n_row):
    return np.where(shared == n_q, np.floor(uses / n_row * 1e9 + 0.5), -np.inf)


def top(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def vector_scores(queries: DataFrame, rows: DataFrame, k: int | None = None) -> DataFrame:
    """(qid, id, cosine) of every query with every row of the same label: the exact scan, tile by tile.
    queries: qid, label, q_vector. rows: id, label, vector. With ``k`` only what can be among a query's k best."""
    return tiles.cosines(queries, rows, k).where("cosine is not null")


def fused(lists: list[DataFrame], constant: int = 60) -> DataFrame:
    """(qid, id, rrf) over ranked lists (qid, id, rank): the sum of 1 / (constant + rank)."""
    both = lists[0].select("qid", "id", "rank")
    for other in lists[1:]:
        both = both.unionByName(other.select("qid", "id", "rank"))
    return both.groupBy("qid", "id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("rrf"))


def within_budget(df: DataFrame, by: str, order: list[Column], size: Column, budget: int) -> DataFrame:
    """The leading rows whose running size stays within the budget; too_large marks a first row that alone exceeds it."""
    w = Window.partitionBy(by).orderBy(*order)
    running = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = df.withColumn("used", running).withColumn("too_large", (F.row_number().over(w) == 1) & (size > budget))
    return marked.where((F.col("used") <= budget) | F.col("too_large"))


def scoped(hits: DataFrame) -> DataFrame:
    """Drops conflicts; if a question has exact hits only those stay. hits: qid, id, scope, rrf."""
    kept = hits.where("scope <> 'conflict'")
    exact = F.max((F.col("scope") == "exact").cast("int")).over(Window.partitionBy("qid"))
    return kept.withColumn("any_exact", exact).where((F.col("any_exact") == 0) | (F.col("scope") == "exact")).drop("any_exact")


def every_term(questions: DataFrame, rows: DataFrame, text: str, k: int | None = None) -> DataFrame:
    """(qid, id, rank_value): rows that hold every word of the question; the value is matched
    occurrences over words of the row. With ``k`` only what can be among a question's k best by the
    value rounded to 9 digits, then id."""
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != "")
    q = questions.select("qid", F.array_distinct(words(F.col("question"))).alias("w")).where(F.size("w") > 0)
    asked = q.select("qid", F.size("w").alias("n_q"), F.explode("w").alias("token"))
    r = rows.select("id", words(F.col(text)).alias("tokens")).select("id", F.size("tokens").alias("n_row"), "tokens")
    few = _few(asked)
    if few is None:
        one = r.select("id", "n_row", F.explode("tokens").alias("token"))
        hit = (matched(one, asked).groupBy("qid", "id", "n_q", "n_row", "token").agg(F.count("*").alias("tf"))
               .groupBy("qid", "id", "n_q", "n_row").agg(F.count("*").alias("shared"), F.sum("tf").alias("uses")))
    else:
        hit = counted.matches(few, r, _type(asked, "qid"), _share_key, k)
    return hit.where("shared = n_q").select("qid", "id", (F.col("uses") / F.col("n_row")).alias("rank_value"))


def reranked(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """hits (qid, id, exact, rrf) with rank: exact ones first, then by the reranker's score (-1 without one), then rrf, then id.
    scores: qid, id, score."""
    w = Window.partitionBy("qid").orderBy(F.desc("exact"), F.desc(F.coalesce("score", F.lit(-1.0))), F.desc("rrf"), F.asc("id"))
    return hits.join(scores, ["qid", "id"], "left").withColumn("rank", F.row_number().over(w)).drop("score")


def by_title(questions: DataFrame, rows: DataFrame, k: int = 12) -> DataFrame:
    """(qid, id, hit, rank): the local fallback without vectors: rows whose title occurs in the question, then the
    others, by id; ``k`` in all. Only the k least ids can follow the hits, so no other pair is formed."""
    titled = contained(questions, "qid", "question", rows.select("title").distinct(), "title").join(rows.select("id", "title"), "title")
    found = top(titled.select("qid", "id").distinct(), ["qid"], [F.asc("id")], k).select("qid", "id", F.lit(1).alias("hit"))
    least = [r["id"] for r in rows.select("id").orderBy("id").limit(k).collect()]
    rest = questions.select("qid", F.explode(F.array(*[F.lit(x) for x in least]).cast("array<long>")).alias("id")).join(titled, ["qid", "id"], "left_anti").select("qid", "id", F.lit(0).alias("hit"))
    return top(found.unionByName(rest), ["qid"], [F.desc("hit"), F.asc("id")], k)


def answer_sources(sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """(knowledge_id, sources): the active, accepted supports of each row whose raw evidence is active too, by id; what was
    superseded or redacted never shows. sources: source_id, knowledge_id, evidence_id, source_kind, excerpt, relation,
    resolution, active; evidence: evidence_id, status, label, locator."""
    live = evidence.where("status = 'active'").select("evidence_id", "label", "locator")
    kept = sources.where("active and relation = 'supports' and resolution = 'accepted'").join(live, "evidence_id")
    return kept.groupBy("knowledge_id").agg(F.array_sort(F.collect_list(F.struct("source_id", "source_kind", "excerpt", "label", "locator"))).alias("sources"))


def usable_knowledge(rows: DataFrame) -> DataFrame:
    """Published rows that may answer customers (publication, answer_allowed)."""
    return rows.where("publication = 'published' and answer_allowed")


def usable_memory(rows: DataFrame) -> DataFrame:
    """Case memory that may answer customers: verified and allowed (source_status, answer_allowed)."""
    return rows.where("source_status = 'verified' and answer_allowed")


def alias_keys(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(qid, knowledge_key): the keys of approved aliases (alias, knowledge_key, approved) that a question names."""
    ok = aliases.where("approved and knowledge_key <> ''").select("alias", "knowledge_key")
    return contained(questions, "qid", "question", ok.select("alias").distinct(), "alias").join(ok, "alias").select("qid", "knowledge_key").distinct()
