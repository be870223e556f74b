"""Storage of entries and their embeddings."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.operators import retention, search
from engram.operators.retention import latest
from engram.schema import EMBEDDING, ENTRY, InvalidEntry
from engram.sources.log import Log


class Storage(ABC):
    """Where entries are kept; embeddings are optional."""

    @abstractmethod
    def save(self, entries: DataFrame) -> None: ...

    @abstractmethod
    def entries(self) -> DataFrame: ...

    @abstractmethod
    def delete(self, entry_id: str) -> bool: ...

    @abstractmethod
    def clear(self) -> int: ...

    @abstractmethod
    def clear_scope(self, scope: str) -> int: ...

    @abstractmethod
    def count(self) -> int: ...

    def save_embeddings(self, vectors: DataFrame) -> None:
        """Does nothing unless embeddings are supported."""

    def embeddings(self) -> DataFrame | None:
        return None

    def unembedded(self, limit: int | None = None) -> DataFrame:
        return self.entries().limit(0)

    def index(self) -> search.Index | None:
        """A kept index for lexical search, if there is one."""
        return None

    def newest(self, k: int) -> DataFrame:
        return self.entries().orderBy(F.desc("timestamp"), F.desc("id")).limit(k)

    def all(self) -> DataFrame:
        return self.entries().orderBy(F.desc("timestamp"), F.desc("id"))


class Searcher(ABC):
    """Where candidates come from: (query_id, id, score, rank) rows for (query_id, text) or (query_id, embedding)."""

    @abstractmethod
    def search(self, queries: DataFrame, k: int, scope: str | None = None) -> DataFrame: ...

    def search_semantic(self, queries: DataFrame, k: int, scope: str | None = None) -> DataFrame | None:
        return None


def checked(entries: DataFrame) -> DataFrame:
    """Rows in the entries' columns. A null where none may be, an empty content or a negative token count is an error as the
    rows are written; metadata without keys become null."""
    own = entries.select(*[(F.col(f.name) if f.name in entries.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in ENTRY])
    wrong = F.coalesce(F.col("content") == "", F.lit(False)) | F.coalesce(F.col("token_count") < 0, F.lit(False))
    for f in ENTRY:
        if not f.nullable:
            wrong = wrong | F.col(f.name).isNull()
    own = own.withColumn("content", F.when(wrong, F.raise_error(F.lit("invalid entry: empty content, a missing field or a negative token count"))).otherwise(F.col("content")))
    return own.withColumn("metadata", F.when(F.size(F.json_object_keys("metadata")) == 0, None).otherwise(F.col("metadata")))


class Store(Storage, Searcher):
    """Entries in one log, embeddings in another. An embedding belongs to the entry as it was when it was written: saving
    the entry again takes it away."""

    def __init__(self, spark: SparkSession, path: str, max_entries: int | None = 10_000):
        self.spark, self.path, self.max_entries = spark, path, max_entries
        self._entries, self._vectors = Log(spark, f"{path}/entries", ENTRY), Log(spark, f"{path}/embeddings", T.StructType([*EMBEDDING, T.StructField("entry_v", T.LongType())]))

    def _rows(self) -> DataFrame:
        return self._entries.read()

    def entries(self) -> DataFrame:
        return self._rows().drop("_v")

    def save(self, entries: DataFrame, ordinal: str | None = None) -> None:
        """Inserts or replaces by id; of rows of one id the one with the greatest ``ordinal`` counts, without it the last in the table's
        order. If there are more than ``max_entries`` then, the oldest go."""
        if ordinal is None:
            entries, ordinal = entries.withColumn("_ordinal", F.monotonically_increasing_id()), "_ordinal"
        rows = checked(latest(entries, "id", ordinal))
        try:
            self._entries.append(rows)
        except Exception as e:
            if "invalid entry" in str(e):
                raise InvalidEntry(str(e).split("invalid entry: ")[1].split("\n")[0]) from e
            raise
        if self.max_entries is not None and not self._rows().select("id").offset(self.max_entries).isEmpty():
            self._entries.replace(retention.newest(self._rows(), self.max_entries))

    def delete(self, entry_id: str) -> bool:
        own = self.entries().where(F.col("id") == entry_id)
        if own.isEmpty():
            return False
        self._entries.append(own, gone=True)
        return True

    def _remove(self, rows: DataFrame) -> int:
        n = rows.count()
        if n:
            self._entries.append(rows.select("id"), gone=True)
        return n

    def clear(self) -> int:
        return self._remove(self.entries())

    def clear_scope(self, scope: str) -> int:
        """Of that very scope; entries without one never go."""
        return self._remove(self.entries().where(F.col("scope") == scope))

    def count(self) -> int:
        return self._rows().count()

    def save_embeddings(self, vectors: DataFrame) -> None:
        """(id, embedding); ids that aren't there are left out."""
        known = vectors.select("id", F.col("embedding").cast("array<float>").alias("embedding")).dropDuplicates(["id"])
        self._vectors.append(known.join(self._rows().select("id", F.col("_v").alias("entry_v")), "id"))

    def embeddings(self) -> DataFrame:
        """(id, scope, embedding) of entries that have one."""
        own = self._rows().select("id", "scope", F.col("_v").alias("entry_v"))
        return own.join(self._vectors.read(), ["id", "entry_v"]).select("id", "scope", "embedding")

    def unembedded(self, limit: int | None = None) -> DataFrame:
        return retention.unembedded(self.entries(), self.embeddings(), limit)

    def index(self) -> search.Index:
        """The kept index: a segment beside each folder of the log, made once, when it is first searched, from the folder's rows alone. Rows
        that were replaced or deleted since are left out as it is read."""
        folders = self._entries.folders()
        fs, path = self._entries._fs()
        for _, name in folders:
            at = f"{self.path}/index/{name}"
            if not fs.exists(path(f"{at}/documents/_SUCCESS")):
                rows = self.spark.read.schema(self._entries.full).parquet(f"{self._entries.path}/{name}").where("not _gone")
                made = search.Index.counted(rows, "_v")
                made.postings.repartitionByRange("term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{at}/postings")
                made.documents.write.mode("overwrite").parquet(f"{at}/documents")
        if fs.exists(path(f"{self.path}/index")):
            held = {name for _, name in folders}
            for status in fs.listStatus(path(f"{self.path}/index")):
                if status.getPath().getName() not in held:
                    fs.delete(status.getPath(), True)
        if not folders:
            return search.Index.counted(self.entries())
        parts = [self.spark.read.parquet(*[f"{self.path}/index/{name}/{kind}" for _, name in folders]) for kind in ("postings", "documents")]
        live = self._rows().select("id", "_v")
        postings, documents = (p.join(live, ["id", "_v"], "left_semi").drop("_v") for p in parts)
        return search.Index(postings, documents)

    def search(self, queries: DataFrame, k: int, scope: str | None = None) -> DataFrame:
        return search.lexical(self.entries(), queries, k, scope, self.index())

    def search_semantic(self, queries: DataFrame, k: int, scope: str | None = None) -> DataFrame:
        return search.semantic(self.embeddings(), queries, k, scope)
