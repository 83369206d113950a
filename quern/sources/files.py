"""Reading and writing of files and records."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def read_jsonl(spark: SparkSession, path: str, schema: str, required: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """(rows, violations): records with all required fields and an unrepeated key; the others with a reason."""
    rows = spark.read.schema(schema).json(path)
    n = F.count("*").over(Window.partitionBy(key))
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull()
    reason = F.when(missing, "missing_field").when(n > 1, "repeated_key")
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def append_checkpoint(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def file_type(content: Column, name: Column) -> Column:
    """By magic bytes, then, for archives, by the name's ending."""
    head = F.hex(F.substring(content, 1, 4))
    return (F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), F.when(F.lower(name).endswith(".pptx"), "pptx").otherwise("zip"))
            .when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpeg").otherwise("unknown"))


def intake(files: DataFrame, known: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Decision for each file (key, label, content) against known versions (key, label, hash) and those before it
    in the same batch: created, duplicate (same bytes) or conflict (other bytes under a taken label). The
    first file of a label, by ``order`` (else by its hash), is the one that takes it."""
    k = known.select(F.col("key").alias("k"), F.col("label").alias("l"), F.col("hash").alias("known_hash")).distinct()
    h = files.withColumn("hash", F.sha2("content", 256))
    w = Window.partitionBy("key", "label").orderBy(*(order or []), F.asc("hash"))
    h = h.select("key", "label", "hash", F.row_number().over(w).alias("place"), F.first("hash").over(w).alias("first_hash"))
    j = h.join(k, F.col("key").eqNullSafe(F.col("k")) & F.col("label").eqNullSafe(F.col("l")), "left")
    taken = F.coalesce("known_hash", F.when(F.col("place") > 1, F.col("first_hash")))
    return j.select("key", "label", "hash", F.when(taken.isNull(), "created").when(taken == F.col("hash"), "duplicate").otherwise("conflict").alias("decision"))


class Versions:
    """Immutable document versions under a folder. A batch's rows become visible with its marker, a numbered file that
    is created, at most once, when they are all written: a job that fails leaves nothing that a reader sees, and
    of two writers that take the same number one decides anew. A marker without a name belongs to a
    writer that died in between, and counts for nothing."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _committed(self) -> list[str]:
        """The names in the markers, in their order; there is one for each batch."""
        marks = self._path(f"{self.folder}/committed")
        self._fs.mkdirs(marks)
        found = sorted((f.getPath().getName(), f.getPath()) for f in self._fs.listStatus(marks))
        names = []
        for _, path in found:
            stream = self._fs.open(path)
            names.append(bytes(stream.readAllBytes()).decode())
            stream.close()
        return names

    def table(self) -> DataFrame:
        """(key, label, hash, content) of all visible versions."""
        folders = [f"{self.folder}/data/{n}" for n in self._committed() if n]
        schema = "key string, label string, hash string, content binary"
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def admit(self, files: DataFrame, order: list[Column] | None = None) -> DataFrame:
        """Stores the created ones of files (key, label, content) and returns all decisions, as in ``intake``."""
        while True:
            number, name = len(self._committed()), uuid.uuid4().hex
            intake(files, self.table().select("key", "label", "hash"), order).write.parquet(f"{self.folder}/decisions/{name}")
            found, same = self.spark.read.parquet(f"{self.folder}/decisions/{name}"), ["key", "label", "hash"]
            new = found.where("decision = 'created'").select(*same).distinct()
            content = files.withColumn("hash", F.sha2("content", 256)).dropDuplicates(same)
            content.join(new, same, "left_semi").select(*same, "content").write.parquet(f"{self.folder}/data/{name}")
            if self._commit(number, name):
                return found

    def _commit(self, number: int, name: str) -> bool:
        """Creates marker ``number``; False if another writer has it."""
        try:
            marker = self._fs.create(self._path(f"{self.folder}/committed/{number:09d}"), False)
        except Py4JJavaError:  # it is there
            return False
        marker.write(bytearray(name.encode()))
        marker.close()
        return True


def upsert(current: DataFrame, new: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """Rows of new replace those of current with their key. Of several new rows of a key the last by ``order``
    stays (else the largest by all columns). A null key replaces nothing and is replaced by nothing."""
    by = F.struct(*(order or []), *[c for c in new.columns if c not in (order or [])])
    last = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(by).alias("_row")).select(*[(F.col(key) if c == key else F.col(f"_row.{c}").alias(c)) for c in new.columns])
    whole = last.unionByName(new.where(F.col(key).isNull()))
    return current.join(last.select(key), key, "left_anti").unionByName(whole)


def _last_value(text: str | None) -> str | None:
    text = (text or "").strip()
    decoder = json.JSONDecoder()
    try:
        json.loads(text)
        return text
    except (ValueError, RecursionError):
        for at in range(len(text) - 1, -1, -1):
            if text[at] in "[{":
                try:
                    return text[at: decoder.raw_decode(text, at)[1]]
                except (ValueError, RecursionError):
                    continue
    return None


@F.pandas_udf(StringType())
def last_json(texts: pd.Series) -> pd.Series:
    """The JSON value of a reply, as it stands there: all of it if it is one, else the object or array that
    begins last among those that can be read; null without one."""
    return texts.map(_last_value)


def markdown(df: DataFrame, columns: list[str]) -> DataFrame:
    """One line of a Markdown table for each row."""
    return df.select(F.concat(F.lit("| "), F.array_join(F.array(*[F.col(c).cast("string") for c in columns]), " | "), F.lit(" |")).alias("line"))


def embedding_backlog(rows: DataFrame, cache: DataFrame, text: str) -> DataFrame:
    """Rows whose text has no cached vector yet. cache: hash."""
    return rows.withColumn("hash", F.sha2(text, 256)).join(cache.select("hash"), "hash", "left_anti")


def _values(statement: str) -> list[list[str | None]]:
    """The rows of one INSERT statement: quoted strings with doubled quotes, numbers, NULL."""
    at = statement.upper().find("VALUES")
    rows, row, part, quoted, deep, was = [], [], [], False, 0, False
    for k, c in enumerate(statement[at + 6:] if at >= 0 else ""):
        if quoted:
            part.append(c)
            quoted = c != "'"
        elif c == "'":
            # A quote right behind a closed string is a quote inside it.
            quoted, was = True, True
            part.append(c)
        elif c == "(" and not deep:
            deep, row, part, was = 1, [], [], False
        elif c in ",)" and deep == 1:
            text = "".join(part).strip()
            if was:
                row.append(text[1:-1].replace("''", "'"))
            else:
                row.append(None if text.upper() == "NULL" else text)
            part, was = [], False
            if c == ")":
                deep = 0
                rows.append(row)
        else:
            part.append(c)
    return rows


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def inserted_rows(statements: pd.Series) -> pd.Series:
    """The value lists of INSERT statements as text; null for other statements."""
    return pd.Series([_values(x) if x and x.lstrip().upper().startswith("INSERT") else None for x in statements], dtype=object)


def dump_rows(statements: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """Rows of ``table`` in a dump, one statement a row (statement), as text columns, in any order."""
    named = statements.where(F.col("statement").rlike(rf"(?i)^\s*INSERT\s+INTO\s+[\"`]?{table}[\"`]?\b"))
    return named.select(F.explode(inserted_rows("statement")).alias("v")).select(*[F.col("v")[k].alias(c) for k, c in enumerate(columns)])


def typed(rows: DataFrame, kinds: dict[str, str], names: dict[str, str] | None = None) -> DataFrame:
    """Text columns as their kinds (a type, ``json`` or ``bool``: 1, true, yes) under new names; what does not parse is null."""
    def one(c: str) -> Column:
        kind, text = kinds.get(c, "string"), F.trim(F.col(c))
        if kind == "bool":
            value = F.when(F.lower(text).isin("1", "true", "t", "yes"), True).when(F.lower(text).isin("0", "false", "f", "no"), False)
        elif kind == "json":
            value = F.when(F.try_parse_json(text).isNotNull(), text)
        else:
            value = F.col(c) if kind == "string" else text.try_cast(kind)
        return value.alias((names or {}).get(c, c))

    return rows.select(*[one(c) for c in rows.columns])


def save_cache(vectors: DataFrame, path: str) -> None:
    """Writes (key, vector) as Parquet beside ``path`` and renames it into place, so that readers see the old
    cache or the new one, never a part."""
    spark = vectors.sparkSession
    beside = f"{path}-{uuid.uuid4().hex}"
    vectors.write.parquet(beside)
    new, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (beside, path))
    files = new.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(old):
        files.delete(old, True)
    if not files.rename(new, old):
        raise OSError(f"could not rename {beside}")


def cached(rows: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their vector, rows without one); of a repeated key any vector will do, for keys name texts."""
    c = cache.groupBy(key).agg(F.first("vector").alias("vector"))
    return rows.join(c, key), rows.join(c, key, "left_anti")
