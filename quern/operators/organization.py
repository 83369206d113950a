"""Entities and their parents: names, links, proposals checked against evidence, provenance, moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.hierarchy import would_cycle
from quern.operators.workflow import first_error

# Vocabularies and words that decide results.
TRUSTED = ("official_source", "user_confirmed")
KINDS = ("explicit_user_confirmation", "official_source", "user_confirmed")
ACTIONS = ("NO_CHANGE", "CREATE_ENTITY", "CREATE_RELATION", "MOVE_RELATION", "UNCLEAR")
PARENT_WORDS = r"(?i)属于|归属于|归到|是|为|belongs?to|partof|memberof|under|beneath|categorized|classified|归类"
SENTENCE_ENDS = "[。.!！?？;；]"


def name_key(name: Column) -> Column:
    """Lower case without white space. (Names of one width; ``workflow.nfkc_name`` folds widths first.)"""
    return F.lower(F.regexp_replace(F.trim(name), r"(?U)\s+", ""))


def entity_links(knowledge: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities to add, links): each trusted, active knowledge row with an entity name gets the
    entity of that name's key; names without one get a new entity, once for each key, numbered after
    the largest id in order of the key and named as its least knowledge id says.

    knowledge: id, entity_name, trust, active. entities: entity_id, name. links: id, entity_id."""
    rows = knowledge.where(F.col("active") & F.col("trust").isin(*TRUSTED)).where(F.trim("entity_name") != "").select("id", "entity_name", name_key(F.col("entity_name")).alias("key"))
    have = entities.groupBy(name_key(F.col("name")).alias("key")).agg(F.min("entity_id").alias("entity_id"))
    named = rows.groupBy("key").agg(F.min_by("entity_name", "id").alias("name")).join(have, "key", "left_anti")
    # Numbers come from ranks within hash buckets and the sizes of the buckets before them, not from one sorted task.
    bucket = named.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(256)).cast("int"))
    before = F.sum("m").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))  # one row a bucket
    bases = bucket.groupBy("bucket").agg(F.count("*").alias("m")).select("bucket", F.coalesce(before, F.lit(0)).alias("base"))
    last = entities.agg(F.coalesce(F.max("entity_id"), F.lit(0))).scalar()
    number = F.row_number().over(Window.partitionBy("bucket").orderBy("key")) + F.col("base")
    new = bucket.join(F.broadcast(bases), "bucket").withColumn("r", number).withColumn("last", last).select((F.col("r") + F.col("last")).cast("long").alias("entity_id"), "name", "key")
    links = rows.join(have.unionByName(new.select("key", "entity_id")), "key").select("id", "entity_id")
    return new.select("entity_id", "name"), links


def _holds(text: Column, part: Column) -> Column:
    return F.coalesce((name_key(part) != "") & F.contains(name_key(text), name_key(part)), F.lit(False))


def says_parent(subject: Column, parent: Column, quote: Column) -> Column:
    """Does the quote name the subject, then the parent, with a word of belonging and no end of a
    sentence between them? Two names in one sentence are not enough."""
    line, a, b = name_key(quote), name_key(subject), name_key(parent)
    at = F.position(a, line)
    rest = F.substr(line, at + F.length(a))
    to = F.position(b, rest)
    between = F.left(rest, to - 1)
    return F.coalesce((a != "") & (b != "") & (at > 0) & (to > 0) & ~between.rlike(SENTENCE_ENDS) & between.rlike(PARENT_WORDS), F.lit(False))


def shape_error(p: DataFrame) -> Column:
    """The first rule of form that a proposal (action, subject, target, new_entity, evidence_quote, confidence, reason) breaks."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    changes = ~F.col("action").isin("NO_CHANGE", "UNCLEAR")
    relation = F.col("action").isin("CREATE_RELATION", "MOVE_RELATION")
    return first_error([
        ("unknown_action", ~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False))),
        ("invalid_confidence", ~F.coalesce(F.col("confidence").isin("explicit", "ambiguous"), F.lit(False))),
        ("relation_needs_both_names", relation & (empty("subject") | empty("target"))),
        ("entity_needs_a_name", (F.col("action") == "CREATE_ENTITY") & empty("subject") & empty("new_entity")),
        ("no_quote", changes & empty("evidence_quote")),
        ("ambiguous", changes & (F.col("confidence") != "explicit")),
        ("no_reason", changes & empty("reason"))])


def evidence_error(p: DataFrame) -> Column:
    """The first rule of scope and evidence that a well-formed proposal breaks. Besides the fields of
    ``shape_error``: content, excerpts array<string> (accepted), current_entity, current_parent,
    target_known boolean, target_active boolean."""
    changes = ~F.col("action").isin("NO_CHANGE", "UNCLEAR")
    relation = F.col("action").isin("CREATE_RELATION", "MOVE_RELATION")
    quote = F.col("evidence_quote")
    in_scope = F.exists(F.concat(F.array("content"), F.coalesce("excerpts", F.array().cast("array<string>"))), lambda x: _holds(x, quote))
    same = lambda a, b: F.coalesce(name_key(F.col(a)) == name_key(F.col(b)), F.lit(False))
    new, parent = F.col("new_entity").isNotNull(), F.coalesce(F.trim("current_parent"), F.lit("")) != ""
    same_parent = parent & same("current_parent", "target")
    known = F.coalesce("target_known", F.lit(False))
    return first_error([(name, changes & broken) for name, broken in [
        ("quote_not_in_evidence", ~in_scope), ("subject_out_of_scope", ~same("subject", "current_entity")), ("subject_not_in_quote", ~_holds(quote, F.col("subject"))),
        ("new_entity_not_in_quote", new & ~_holds(quote, F.col("new_entity"))),
        ("new_entity_is_not_the_target", new & F.col("target").isNotNull() & ~same("new_entity", "target")),
        ("target_not_in_quote", relation & ~_holds(quote, F.col("target"))),
        ("no_parent_relation_said", relation & ~says_parent(F.col("subject"), F.col("target"), quote)),
        ("unknown_target", relation & ~known & ~new), ("inactive_target", relation & known & ~F.coalesce("target_active", F.lit(True))),
        ("nothing_to_move", (F.col("action") == "MOVE_RELATION") & ~parent), ("needs_a_move", (F.col("action") == "CREATE_RELATION") & parent & ~same_parent),
        ("already_there", (F.col("action") == "MOVE_RELATION") & same_parent)]])


def checked(proposals: DataFrame) -> DataFrame:
    """proposals with error, ok if it can be applied, and unchanged for actions that change nothing."""
    shape, evidence = shape_error(proposals), evidence_error(proposals)
    return proposals.withColumn("error", F.when(shape != "ok", shape).when(F.col("action").isin("NO_CHANGE", "UNCLEAR"), "unchanged").otherwise(evidence))


def provenance_error(kind: Column, text: Column, source_id: Column, trust: Column, active: Column) -> Column:
    """Why a relation has no valid provenance. trust and active are those of the source; null if it is not found."""
    given = source_id.isNotNull()
    return first_error([
        ("unknown_kind", ~F.coalesce(kind.isin(*KINDS), F.lit(False))), ("no_text", F.coalesce(F.trim(text), F.lit("")) == ""),
        ("source_not_found", given & trust.isNull()), ("untrusted_source", given & ~trust.isin(*TRUSTED)), ("inactive_source", given & ~active),
        ("needs_user_confirmed", given & (kind == "explicit_user_confirmation") & (trust != "user_confirmed")),
        ("needs_official_source", given & (kind == "official_source") & (trust != "official_source")),
        ("needs_a_source", ~given & (kind != "explicit_user_confirmation"))])


def moved(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """(child, parent, decision) of each move (child, parent, error of its provenance): refused for
    that error, for the child itself as its parent or for a cycle; unchanged if the parent is the
    same; created without a parent before; else moved. The last move of a child counts (seq)."""
    last = moves.groupBy("child").agg(F.max_by(F.struct("parent", "error"), "seq").alias("m")).select("child", "m.*")
    loops = would_cycle(edges, last.select("parent", "child")).where("would_cycle").select(F.col("parent").alias("lp"), F.col("child").alias("lc")).distinct().withColumn("loops", F.lit(True))
    now = edges.select(F.col("child").alias("c"), F.col("parent").alias("before"))
    j = last.join(now, F.col("child") == F.col("c"), "left").join(loops, (F.col("child") == F.col("lc")) & (F.col("parent") == F.col("lp")), "left")
    decision = F.when(F.col("error") != "ok", F.col("error")).when((F.col("parent") == F.col("child")) | F.coalesce("loops", F.lit(False)), "cycle") \
        .when(F.col("before") == F.col("parent"), "unchanged").when(F.col("before").isNull(), "created").otherwise("moved")
    return j.select("child", "parent", "before", decision.alias("decision"))


def after_moves(edges: DataFrame, decided: DataFrame) -> DataFrame:
    """(parent, child) after the moves that ``moved`` accepts."""
    done = decided.where("decision in ('moved', 'created')").select(F.col("child").alias("c"), F.col("parent").alias("to"))
    return edges.join(done, F.col("child") == F.col("c"), "full").select(F.coalesce("to", "parent").alias("parent"), F.coalesce("child", "c").alias("child"))


def review(trust: Column, chain: Column, proposal_error: Column) -> Column:
    """What a review of one knowledge row does: nothing for untrusted rows, a stated chain before
    anything else, a checked proposal, or only the link of the row to its entity."""
    return (F.when(~F.coalesce(trust.isin(*TRUSTED), F.lit(False)), "NO_CHANGE").when(F.size(F.coalesce(chain, F.array().cast("array<string>"))) > 1, "APPLY_CHAIN")
            .when(proposal_error == "ok", "APPLY_PROPOSAL").otherwise("LINK_ONLY"))
