"""The named queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bitplane, collocations, divergence, language, licenses, mixing, mpeg_audio, multi_index, packing, quality, simhash, substring, toxicity
from quern.llm.sql import COLLOCATIONS, DIVERGENCE
from quern.session import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(by: int = 3):
    """crc32 of doc_id as text, mod ``by``; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % by


def held_out(df: DataFrame, by: int = 3, kept: int = 1) -> DataFrame:
    return df.withColumn("held_out", F.coalesce(remainder(by) == kept, F.lit(False)))


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(remainder() != 1))
    return held_out(toxicity.scored(docs, model)).select("doc_id", "held_out", "score", "predicted")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents")).drop("detections")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language.fit(docs.where(remainder() != 1))
    return held_out(language.predicted(docs, profiles)).select("doc_id", "held_out", "lang_pred", "score")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path(), length=2048, end=0)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op7_bitplane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplane.read(bitplane.write(table(spark, sf_dir, "documents"), tokenizer_path(), end=2))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"))


def op10_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.probed(mpeg_audio.written(table(spark, sf_dir, "documents")))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mined(table(spark, sf_dir, "documents"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(remainder(4) != 2))
    return held_out(quality.scored(docs, model), 4, 2).select("doc_id", "held_out", "score", "predicted")


QUERIES = {
    "op1_multi_index": op1_multi_index,
    "op2_toxicity": op2_toxicity,
    "op3_licenses": op3_licenses,
    "op4_language": op4_language,
    "op5_packing": op5_packing,
    "op6_simhash": op6_simhash,
    "op7_bitplane": op7_bitplane,
    "op8_mixing": op8_mixing,
    "op9_substring": op9_substring,
    "op10_mpeg_audio": op10_mpeg_audio,
    "op11_divergence": op11_divergence,
    "op12_collocations": op12_collocations,
    "op13_quality": op13_quality,
}

SQL: dict[str, str] = {
    "op11_divergence": DIVERGENCE,
    "op12_collocations": COLLOCATIONS,
    "op1_multi_index": """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, l.b FROM reach JOIN l ON l.a = reach.r)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, c.m AS component_id, c.m = e.vec_id AS kept
FROM embeddings e JOIN (SELECT vec_id, min(r) AS m FROM reach GROUP BY 1) c ON c.vec_id = e.vec_id""",
    "op9_substring": r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, i, sha256(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 48))) AS i FROM d)),
cut AS (SELECT k.doc_id, k.i FROM k JOIN (SELECT h, min(doc_id) AS least FROM k GROUP BY 1) m ON m.h = k.h WHERE least < k.doc_id),
runs AS (SELECT doc_id, count(*) AS n FROM cut a WHERE NOT EXISTS (SELECT 1 FROM cut b WHERE b.doc_id = a.doc_id AND b.i = a.i - 1) GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM (SELECT doc_id, i, unnest(range(0, 50)) AS o FROM cut)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS t, count(*) AS n FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p WHERE gone.p IS NULL GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256, coalesce(runs.n, 0) AS n_repeats
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN runs ON runs.doc_id = d.doc_id""",
}
