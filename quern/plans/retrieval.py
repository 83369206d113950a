"""Retrieval queries over benchmark questions, documents and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import scope, text as t, vectors as v
from quern.operators import lists, overlay, postings, retrieval as r, tiles
from quern.plans import sql as s
from quern.plans.common import registry
from quern.plans.text import scope_models
from quern.session import kept, shared_path, table

QUERIES, SQL, query = registry()

#: Pairs of a question and a row that one window ranks, and ids of vectors that are sent to the texts.
PAIRS, IDS = 10_000, 1_000_000

ELIGIBLE = """eligible AS (SELECT * FROM knowledge k WHERE active AND trust IN ('official_source','user_confirmed')
 AND EXISTS (SELECT 1 FROM sources x WHERE x.knowledge_id=k.id AND x.relation='supports' AND x.resolution='accepted')
 AND NOT EXISTS (SELECT 1 FROM sources x WHERE x.knowledge_id=k.id AND x.relation='contradicts' AND x.resolution='accepted'))"""


def lexical_sql(rows: str, text: str, entity: str | None) -> str:
    same = f"coalesce({entity} <> '' AND contains(lower(question), lower({entity})), false)" if entity else "false"
    return (f"q AS (SELECT qid, question, {s.tokens('question')} AS qt FROM questions), kt AS (SELECT id, {s.tokens(text)} AS rt{', ' + entity if entity else ''} FROM {rows}), "
            f"scored AS (SELECT * FROM (SELECT qid, id, {same} AS same_model, CASE WHEN len(qt)=0 OR len(rt)=0 THEN 0 ELSE least(2.0, len(list_intersect(qt, rt)) / sqrt(len(qt)::DOUBLE * len(rt)) + CASE WHEN {same} THEN 1.0 ELSE 0.0 END) END AS lexical FROM q, kt) WHERE lexical > 0)")


@query("p01_eligible_knowledge", s.with_(s.KNOWLEDGE, s.SOURCES, ELIGIBLE) + "SELECT id, entity_name, trust FROM eligible")
def _(spark, sf):
    return r.eligible(overlay.knowledge(spark, sf), overlay.sources(spark, sf)).select("id", "entity_name", "trust")


@query("p01_ineligible_reasons", s.with_(s.KNOWLEDGE, s.SOURCES) + """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN NOT active THEN 'inactive' WHEN trust NOT IN ('official_source','user_confirmed') THEN 'untrusted'
 WHEN NOT EXISTS (SELECT 1 FROM sources x WHERE x.knowledge_id=k.id AND x.relation='supports' AND x.resolution='accepted') THEN 'unsupported' ELSE 'eligible' END AS reason FROM knowledge k) GROUP BY 1""")
def _(spark, sf):
    ok = overlay.sources(spark, sf).where("relation = 'supports' and resolution = 'accepted'").select(F.col("knowledge_id").alias("id")).distinct().withColumn("ok", F.lit(True))
    reason = F.when(~F.col("active"), "inactive").when(~F.col("trust").isin("official_source", "user_confirmed"), "untrusted").when(F.col("ok").isNull(), "unsupported").otherwise("eligible")
    return overlay.knowledge(spark, sf).join(ok, "id", "left").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("inv_conflicted_not_active", s.with_(s.KNOWLEDGE) + "SELECT id FROM knowledge WHERE trust='conflicted' AND active")
def _(spark, sf):
    return overlay.knowledge(spark, sf).where("trust = 'conflicted' and active").select("id")


def _knowledge_text():
    return F.concat_ws(" ", "title", "content", "entity_name")


_RANKED = "row_number() OVER (PARTITION BY qid ORDER BY same_model DESC, round(lexical, 9) DESC, id) AS rank"


@query("r02_answer_retrieval", s.with_(s.KNOWLEDGE, s.SOURCES, ELIGIBLE, s.QUESTIONS, lexical_sql("eligible", "concat_ws(' ', title, content, entity_name)", "entity_name"))
       + f"SELECT qid, id, rank, round(lexical, 6) AS lexical FROM (SELECT *, {_RANKED} FROM scored) WHERE rank <= 5")
def _(spark, sf):
    ok = r.eligible(overlay.knowledge(spark, sf), overlay.sources(spark, sf))
    scored = r.lexical_scores(overlay.questions(spark, sf), ok, _knowledge_text(), k=5)
    order = [F.desc("same_model"), F.desc(F.round("lexical", 9)), F.asc("id")]
    return r.top(scored, ["qid"], order, 5).select("qid", "id", "rank", F.round("lexical", 6).alias("lexical"))


@query("r01_lexical_same_model_first", s.with_("questions AS (SELECT item_id AS qid, 'src' || (item_id % 20) || ' ' || left(text, 40) AS question FROM benchmark)", s.KNOWLEDGE,
       lexical_sql("(SELECT * FROM knowledge WHERE active)", "concat_ws(' ', title, content, entity_name)", "entity_name"))
       + f"SELECT qid, id, rank, same_model, round(lexical, 6) AS lexical FROM (SELECT *, {_RANKED} FROM scored) WHERE rank <= 5")
def _(spark, sf):
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.concat(F.lit("src"), F.col("item_id") % 20, F.lit(" "), F.substring("text", 1, 40)).alias("question"))
    scored = r.lexical_scores(asked, overlay.knowledge(spark, sf).where("active"), _knowledge_text(), k=5)
    order = [F.desc("same_model"), F.desc(F.round("lexical", 9)), F.asc("id")]
    return r.top(scored, ["qid"], order, 5).select("qid", "id", "rank", "same_model", F.round("lexical", 6).alias("lexical"))


_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "label", F.col("embedding").alias("q_vector"))
    return q, e.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))


@query("o06_vector_topk", f"SELECT qid, id, rank, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(cosine, 9) DESC, id) AS rank FROM (SELECT a.vec_id AS qid, b.vec_id AS id, {_COS} AS cosine FROM embeddings a JOIN embeddings b ON a.label=b.label WHERE a.vec_id % 50 = 0)) WHERE rank <= 10")
def _(spark, sf):
    scored = r.vector_scores(*_vectors(spark, sf), 10)
    return r.top(scored, ["qid"], [F.desc(F.round("cosine", 9)), F.asc("id")], 10).select("qid", "id", "rank", F.round("cosine", 6).alias("cosine"))


@query("f50_f53_cosine_pairs", "SELECT a.vec_id AS a, b.vec_id AS b, round(greatest(-1, least(1, " + _COS + ")), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.label=b.label AND a.vec_id % 50 = 0 AND b.vec_id > a.vec_id WHERE " + _COS + " >= 0.3")
def _(spark, sf):
    q, e = _vectors(spark, sf)
    return tiles.cosines(q, e, threshold=0.3).select(F.col("qid").alias("a"), F.col("id").alias("b"), F.round("cosine", 6).alias("cosine"))


@query("f50_all_cosine_pairs", "SELECT a.vec_id AS a, b.vec_id AS b, round(greatest(-1, least(1, " + _COS + ")), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.label=b.label AND b.vec_id > a.vec_id WHERE " + _COS + " >= 0.3")
def _(spark, sf):
    """Every pair of a label once."""
    e = _vectors(spark, sf)[1]
    q = e.select(F.col("id").alias("qid"), "label", F.col("vector").alias("q_vector"))
    return tiles.cosines(q, e, threshold=0.3).select(F.col("qid").alias("a"), F.col("id").alias("b"), F.round("cosine", 6).alias("cosine"))


@query("f52_unit_vectors", "SELECT vec_id, round(list_sum(list_transform(u, lambda x: x*x)), 6) AS squared, round(u[1], 6) AS first FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y*y)))) AS u FROM embeddings)")
def _(spark, sf):
    u = table(spark, sf, "embeddings").select("vec_id", v.unit(F.col("embedding")).alias("u"))
    return u.select("vec_id", F.round(v.dot(F.col("u"), F.col("u")), 6).alias("squared"), F.round(F.col("u")[0], 6).alias("first"))


_FTS = r"""words AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda x: x <> '')) AS word FROM knowledge),
 tf AS (SELECT id, word, count(*) AS tf FROM words GROUP BY 1, 2), sz AS (SELECT id, count(*) AS n FROM words GROUP BY 1),
 qw AS (SELECT DISTINCT qid, unnest(list_filter(regexp_split_to_array(lower(question), '[^a-z0-9]+'), lambda x: x <> '')) AS word FROM short),
 qn AS (SELECT qid, count(*) AS n_q FROM qw GROUP BY 1),
 fts AS (SELECT h.qid, h.id, h.tf / sz.n AS rank_value FROM (SELECT qid, id, count(*) AS m, sum(tf) AS tf FROM qw JOIN tf USING (word) GROUP BY 1, 2) h JOIN qn ON qn.qid=h.qid AND qn.n_q=h.m JOIN sz ON sz.id=h.id)"""
_SHORT = "short AS (SELECT qid, array_to_string(list_slice(string_split(question, ' '), 2, 3), ' ') AS question FROM questions)"


def _short(spark, sf):
    return overlay.questions(spark, sf).select("qid", F.array_join(F.slice(F.split("question", " "), 2, 2), " ").alias("question"))


@query("fts_every_term", s.with_(s.KNOWLEDGE, s.QUESTIONS, _SHORT, _FTS) + "SELECT qid, id, round(rank_value, 6) AS rank_value FROM fts")
def _(spark, sf):
    return r.every_term(_short(spark, sf), overlay.knowledge(spark, sf), "content").withColumn("rank_value", v.rounded(F.col("rank_value"), 6))


@query("r07_rrf_fusion", s.with_(s.KNOWLEDGE, s.QUESTIONS, _SHORT, _FTS, lexical_sql("knowledge", "content", None),
       "l1 AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(lexical, 9) DESC, id) AS rank FROM scored)",
       "l2 AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(rank_value, 9) DESC, id) AS rank FROM fts)",
       "u AS (SELECT qid, id, sum(1.0/(60+rank)) AS rrf FROM (SELECT * FROM l1 WHERE rank <= 20 UNION ALL SELECT * FROM l2 WHERE rank <= 20) GROUP BY 1, 2)")
       + "SELECT qid, id, rank, round(rrf, 9) AS rrf FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 12) DESC, id) AS rank FROM u) WHERE rank <= 5")
def _(spark, sf):
    k = overlay.knowledge(spark, sf)
    first = r.top(r.lexical_scores(overlay.questions(spark, sf), k, F.col("content"), None, 20), ["qid"], [F.desc(F.round("lexical", 9)), F.asc("id")], 20)
    second = r.top(r.every_term(_short(spark, sf), k, "content", 20), ["qid"], [F.desc(F.round("rank_value", 9)), F.asc("id")], 20)
    both = r.fused([first, second])
    return r.top(both, ["qid"], [F.desc(F.round("rrf", 12)), F.asc("id")], 5).select("qid", "id", "rank", F.round("rrf", 9).alias("rrf"))


@query("r05_document_evidence", s.with_(s.BLOCKS, s.QUESTIONS, lexical_sql("(SELECT doc_id * 1000000000 + block_no AS id, text FROM blocks)", "text", None))
       + "SELECT qid, id, rank, round(lexical, 6) AS lexical FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(lexical, 9) DESC, id) AS rank FROM scored) WHERE rank <= 3")
def _(spark, sf):
    b = overlay.blocks(spark, sf).select((F.col("doc_id") * 1000000000 + F.col("block_no")).alias("id"), "text")
    scored = r.lexical_scores(overlay.questions(spark, sf), b, F.col("text"), None, 3)
    return r.top(scored, ["qid"], [F.desc(F.round("lexical", 9)), F.asc("id")], 3).select("qid", "id", "rank", F.round("lexical", 6).alias("lexical"))


@query("r06_evidence_budget", s.with_(s.BLOCKS) + """SELECT doc_id, block_no, used, too_large FROM (SELECT doc_id, block_no, length(text) AS n, CAST(sum(length(text)) OVER w AS BIGINT) AS used, row_number() OVER w = 1 AND length(text) > 600 AS too_large FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY block_no ROWS UNBOUNDED PRECEDING)) WHERE used <= 600 OR too_large""")
def _(spark, sf):
    return r.within_budget(overlay.blocks(spark, sf), "doc_id", [F.asc("block_no")], F.length("text"), 600).select("doc_id", "block_no", "used", "too_large")


_SCOPED = "hits AS (SELECT p_size AS qid, p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN 'exact' WHEN 1 THEN 'conflict' WHEN 2 THEN 'family' ELSE 'unspecified' END AS scope, p_retailprice AS rrf FROM part)"


def _hits(spark, sf):
    kind = F.when(F.col("p_partkey") % 7 == 0, "exact").when(F.col("p_partkey") % 7 == 1, "conflict").when(F.col("p_partkey") % 7 == 2, "family").otherwise("unspecified")
    return table(spark, sf, "part").select(F.col("p_size").alias("qid"), F.col("p_partkey").alias("id"), kind.alias("scope"), F.col("p_retailprice").alias("rrf"))


@query("r12_scoped_hits", s.with_(_SCOPED) + "SELECT qid, id, scope FROM (SELECT *, max(CASE WHEN scope='exact' THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS e FROM hits WHERE scope <> 'conflict') WHERE e = 0 OR scope = 'exact'")
def _(spark, sf):
    return r.scoped(_hits(spark, sf)).select("qid", "id", "scope")


@query("r03_exclusion_reasons", f"""SELECT p_partkey, CASE WHEN len(u) > 0 AND len(d) > 0 AND NOT list_has_any(list_transform(u, lambda x: regexp_replace(x,'[^A-Z0-9]','','g')), list_transform(d, lambda x: regexp_replace(x,'[^A-Z0-9]','','g'))) THEN 'model_conflict' ELSE 'ok' END AS reason
 FROM (SELECT p_partkey, {scope_models("'XK' || p_size || 'A ' || p_type")} AS u, {scope_models("'XK' || (p_size - p_partkey % 2) || 'A H.265'")} AS d FROM part)""")
def _(spark, sf):
    u = t.scope_models(F.concat(F.lit("XK"), "p_size", F.lit("A "), "p_type"))
    d = t.scope_models(F.concat(F.lit("XK"), F.col("p_size") - F.col("p_partkey") % 2, F.lit("A H.265")))
    keys = lambda a: F.transform(a, t.scope_key)
    return table(spark, sf, "part").select("p_partkey", F.when(~scope.applicable(keys(u), keys(d)), "model_conflict").otherwise("ok").alias("reason"))


@query("r11_product_facts", """SELECT p_partkey, kind, fact, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY priority, fact) AS rank FROM (
 SELECT p_partkey, 1 AS priority, 'attribute' AS kind, 'max_quantity=' || CAST(CAST(max(l_quantity) AS BIGINT) AS VARCHAR) AS fact FROM part JOIN lineitem ON l_partkey=p_partkey GROUP BY p_partkey
 UNION ALL SELECT p_partkey, 2, 'size', 'size=' || p_size FROM part
 UNION ALL SELECT p_partkey, 3, 'feature', unnest(list_distinct(string_split(p_type, ' '))) FROM part)) WHERE rank <= 3""")
def _(spark, sf):
    part, items = table(spark, sf, "part"), table(spark, sf, "lineitem")
    a = (items.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_quantity").cast("long").alias("m")).join(part.select("p_partkey"), "p_partkey", "left_semi")
         .select("p_partkey", F.lit(1).alias("priority"), F.lit("attribute").alias("kind"), F.concat(F.lit("max_quantity="), "m").alias("fact")))
    b = part.select("p_partkey", F.lit(2).alias("priority"), F.lit("size").alias("kind"), F.concat(F.lit("size="), "p_size").alias("fact"))
    c = part.select("p_partkey", F.lit(3).alias("priority"), F.lit("feature").alias("kind"), F.explode(F.array_distinct(F.split("p_type", " "))).alias("fact"))
    return r.top(a.unionByName(b).unionByName(c), ["p_partkey"], [F.asc("priority"), F.asc("fact")], 3).select("p_partkey", "kind", "fact", "rank")


@query("j05_alias_in_text", s.with_(s.QUESTIONS) + "SELECT qid, alias FROM questions, (SELECT DISTINCT lower(left(n_name, 2)) AS alias FROM nation) WHERE contains(lower(question), alias)")
def _(spark, sf):
    names = table(spark, sf, "nation").select(F.lower(F.left("n_name", F.lit(2))).alias("alias")).distinct()
    return r.contained(overlay.questions(spark, sf), "qid", "question", names, "alias")


@query("r16_vector_merge", f"""WITH l AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id % 17, vec_id) AS rank FROM embeddings),
 w AS (SELECT b.vec_id AS id, row_number() OVER (ORDER BY round({_COS}, 9) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.label=b.label WHERE a.vec_id=0),
 l2 AS (SELECT * FROM l WHERE rank <= 40), w2 AS (SELECT * FROM w WHERE rank <= 40)
 SELECT coalesce(l2.id, w2.id) AS id, coalesce(l2.rank, 0) AS lexical_rank, coalesce(w2.rank, 0) AS vector_rank, CASE WHEN l2.rank IS NULL THEN 'embedding' WHEN w2.rank IS NULL THEN 'lexical' ELSE 'both' END AS found_by
 FROM l2 FULL JOIN w2 ON l2.id = w2.id""")
def _(spark, sf):
    q, e = _vectors(spark, sf)
    hits = r.top(r.vector_scores(q.where("qid = 0"), e, 40), ["qid"], [F.desc(F.round("cosine", 9)), F.asc("id")], 40, "vector_rank").select("id", "vector_rank")
    words = e.select("id", F.lit(0).alias("qid"))
    words = r.top(words, ["qid"], [F.col("id") % 17, F.col("id")], 40, "lexical_rank").select("id", "lexical_rank")
    found = F.when(F.col("lexical_rank").isNull(), "embedding").when(F.col("vector_rank").isNull(), "lexical").otherwise("both")
    return words.join(hits, "id", "full").select("id", F.coalesce("lexical_rank", F.lit(0)).alias("lexical_rank"), F.coalesce("vector_rank", F.lit(0)).alias("vector_rank"), found.alias("found_by"))


_EMBEDDED = "(SELECT doc_id AS id, text FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings))"
_LISTS = s.with_("questions AS (SELECT doc_id AS qid, array_to_string(list_slice(regexp_split_to_array(text, '\\s+'), 1, 12), ' ') AS question FROM documents WHERE doc_id % 50 = 0 AND doc_id IN (SELECT vec_id FROM embeddings))",
                 lexical_sql(_EMBEDDED, "text", None),
                 "l AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(lexical, 9) DESC, id) AS rank FROM scored)",
                 f"w AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(cosine, 9) DESC, id) AS rank FROM (SELECT a.vec_id AS qid, b.vec_id AS id, {_COS} AS cosine FROM embeddings a JOIN embeddings b ON a.label=b.label WHERE a.vec_id % 50 = 0) WHERE cosine IS NOT NULL)").rstrip()


def _texts(spark, sf, ids):
    """(qid, question) and (id, text) of the documents that have a vector."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi")
    return d.where("id % 50 = 0").select(F.col("id").alias("qid"), F.array_join(F.slice(F.split("text", r"\s+"), 1, 12), " ").alias("question")), d


def _lists(spark, sf, k=None):
    """(qid, id, cosine) and (qid, id, lexical), of which the ``k`` best of each question, for all vectors with an id divisible by 50. A vector's
    text is the document of its id; the first 12 words of it are the question."""
    q, e = _vectors(spark, sf)
    asked, d = _texts(spark, sf, e.select("id"))
    return r.vector_scores(q, e, k).select("qid", "id", "cosine"), r.lexical_scores(asked, d, F.col("text"), None, k).select("qid", "id", "lexical")


@query("r16_whole_vector_merge", _LISTS + """, l2 AS (SELECT * FROM l WHERE rank <= 40), w2 AS (SELECT * FROM w WHERE rank <= 40)
 SELECT coalesce(l2.qid, w2.qid) AS qid, coalesce(l2.id, w2.id) AS id, coalesce(l2.rank, 0) AS lexical_rank, coalesce(w2.rank, 0) AS vector_rank, CASE WHEN l2.rank IS NULL THEN 'embedding' WHEN w2.rank IS NULL THEN 'lexical' ELSE 'both' END AS found_by
 FROM l2 FULL JOIN w2 ON l2.qid = w2.qid AND l2.id = w2.id""")
def _(spark, sf):
    rank = lambda by: F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round(by, 9)), "id"))
    vector, words = _lists(spark, sf, 40)
    vector, words = vector.select("qid", "id", rank("cosine").alias("vector_rank")), words.select("qid", "id", rank("lexical").alias("lexical_rank"))
    found = F.when(F.col("lexical_rank").isNull(), "embedding").when(F.col("vector_rank").isNull(), "lexical").otherwise("both")
    both = words.where("lexical_rank <= 40").join(vector.where("vector_rank <= 40"), ["qid", "id"], "full")
    return both.select("qid", "id", F.coalesce("lexical_rank", F.lit(0)).alias("lexical_rank"), F.coalesce("vector_rank", F.lit(0)).alias("vector_rank"), found.alias("found_by"))


@query("r10_whole_running_rank", _LISTS + "SELECT qid, id, kind, row_number() OVER (PARTITION BY qid ORDER BY kind, own) AS rank FROM (SELECT qid, id, 0 AS kind, rank AS own FROM w UNION ALL SELECT qid, id, 1, rank FROM l)")
def _(spark, sf):
    """The result has a row for each question and row; a task scores and sorts the whole lists of some questions. Few
    pairs, null ids, and repeated or very many questions are scored first and meet by a shuffle."""
    q, e = _vectors(spark, sf)
    (n, named), asked = e.agg(F.count("*"), F.count("id")).first(), q.select("qid").distinct().count()
    twice = lambda df: not df.groupBy("qid").count().where("count > 1").isEmpty()
    if n == named and n * asked > PAIRS and not twice(q):
        # Texts stay where they are read as long as the ids can be sent to them.
        questions, d = _texts(spark, sf, F.broadcast(e.select("id")) if n <= IDS else e.select("id"))
        vector, lengths = lists.by_vector(q, e)
        words = None if twice(questions.select("qid")) else lists.by_words(questions, d, F.col("text"), lengths)
        if words is not None:
            one = lambda df, kind: df.select("qid", "id", F.lit(kind).alias("kind"), "rank")
            return one(vector, 0).unionByName(one(words, 1))
    vector, words = _lists(spark, sf)
    both = vector.select("qid", "id", F.lit(0).alias("kind"), F.round("cosine", 9).alias("by")).unionByName(words.select("qid", "id", F.lit(1).alias("kind"), F.round("lexical", 9).alias("by")))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("kind", F.desc("by"), "id"))
    return both.repartition(max(1, asked), "qid").select("qid", "id", "kind", rank.alias("rank"))


def _index(spark, sf, name, rows):
    """The stored index of a table: built once for a folder of tables in a session's shared folder, then read."""
    key = spark.sparkContext.applicationId, sf, name
    if key not in _INDEXES:
        _INDEXES[key] = shared_path(spark, f"postings-{name}")
        return postings.build(rows(), _INDEXES[key])
    return postings.Index(spark, _INDEXES[key])


_INDEXES: dict = {}


def _asked(questions, tokens):
    """(qid, token, boost, n): the distinct tokens of each question; all count once."""
    q = questions.select("qid", F.array_distinct(tokens).alias("t"))
    return q.select("qid", F.explode("t").alias("token"), F.lit(1.0).alias("boost"), F.size("t").alias("n"))


#: A row of the asked entity comes before all others, so its mark counts more than words can.
_MARK = 1000.0


def _parts(n_q):
    """The parts of a sum in which an entity's mark counts _MARK: same_model, and the lexical score."""
    same = F.col("score") >= _MARK
    shared = F.when(same, F.col("score") - _MARK).otherwise(F.col("score"))
    return same, F.least(F.lit(2.0), shared / F.sqrt(n_q.cast("double")) + F.when(same, 1.0).otherwise(0.0))


def _marked_key(score, n):
    """The order of _parts: the same model first, then the lexical score."""
    same = score >= _MARK
    return postings.lexical_key(score - same * _MARK, n) + same * 4e9


@query("r02_indexed_retrieval", SQL["r02_answer_retrieval"])
def _(spark, sf):
    """r02 from the stored index: only segments whose block maxima reach the fifth best score are scored."""
    ok = r.eligible(overlay.knowledge(spark, sf), overlay.sources(spark, sf))
    index = _index(spark, sf, "knowledge", lambda: postings.lexical_rows(ok, t.tokens(_knowledge_text()), F.lit(None).cast("string"), F.col("entity_name")))
    q = overlay.questions(spark, sf)
    asked = _asked(q, t.tokens(F.col("question")))
    named = r.contained(q, "qid", "question", ok.select("entity_name").distinct(), "entity_name").select(
        "qid", F.concat(F.lit("\0"), "entity_name").alias("token"), F.lit(_MARK).alias("boost"), F.lit(0).alias("n"))
    sizes = kept(q.select("qid", F.size(t.tokens(F.col("question"))).alias("n_q")), "sizes")
    hits = index.best(asked.unionByName(named).join(sizes, "qid").select("qid", "token", "boost", F.col("n_q").alias("n")), 5, key=_marked_key).join(sizes, "qid")
    same, lexical = _parts(F.col("n_q"))
    scored = hits.select("qid", "id", same.alias("same_model"), lexical.alias("lexical"))
    order = [F.desc("same_model"), F.desc(F.round("lexical", 9)), F.asc("id")]
    return r.top(scored, ["qid"], order, 5).select("qid", "id", "rank", F.round("lexical", 6).alias("lexical"))


@query("r05_indexed_evidence", SQL["r05_document_evidence"])
def _(spark, sf):
    def rows():
        b = overlay.blocks(spark, sf).select((F.col("doc_id") * 1000000000 + F.col("block_no")).alias("id"), "text")
        return postings.lexical_rows(b, t.tokens(F.col("text")), F.lit(None).cast("string"))

    asked = _asked(overlay.questions(spark, sf), t.tokens(F.col("question")))
    hits = _index(spark, sf, "blocks", rows).best(asked, 3, key=postings.lexical_key).join(asked.select("qid", "n").distinct(), "qid")
    scored = hits.select("qid", "id", F.least(F.lit(2.0), F.col("score") / F.sqrt(F.col("n").cast("double"))).alias("lexical"))
    return r.top(scored, ["qid"], [F.desc(F.round("lexical", 9)), F.asc("id")], 3).select("qid", "id", "rank", F.round("lexical", 6).alias("lexical"))


@query("r07_indexed_fusion", SQL["r07_rrf_fusion"])
def _(spark, sf):
    k = overlay.knowledge(spark, sf)
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != "")
    lexical = _index(spark, sf, "content", lambda: postings.lexical_rows(k, t.tokens(F.col("content")), F.lit(None).cast("string")))
    terms = _index(spark, sf, "terms", lambda: postings.term_rows(k, words(F.col("content")), F.lit(None).cast("string")))
    asked = _asked(overlay.questions(spark, sf), t.tokens(F.col("question")))
    first = lexical.best(asked, 20, key=postings.lexical_key).join(asked.select("qid", "n").distinct(), "qid")
    first = first.select("qid", "id", (F.col("score") / F.sqrt(F.col("n").cast("double"))).alias("lexical"))
    second = terms.best(_asked(_short(spark, sf), words(F.col("question"))), 20, every=True).withColumnRenamed("score", "rank_value")
    both = r.fused([r.top(first, ["qid"], [F.desc(F.round("lexical", 9)), F.asc("id")], 20), r.top(second, ["qid"], [F.desc(F.round("rank_value", 9)), F.asc("id")], 20)])
    return r.top(both, ["qid"], [F.desc(F.round("rrf", 12)), F.asc("id")], 5).select("qid", "id", "rank", F.round("rrf", 9).alias("rrf"))
