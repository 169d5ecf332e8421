"""Relations laid out by key: lookups read one bucket, joins on the key read the relation where it lies.

Each relation is written once for each key that it is asked by, hashed into buckets and sorted by the
key within them.  One value's rows are found in one bucket, by row groups' ranges; many keys meet a
layout in a join that shuffles the keys and never the relation.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .index import Relations

#: The keys by which each relation is laid out.
LAYOUTS = {"files": ("id", "path"), "symbols": ("id", "name", "file_id"), "imports": ("file_id",), "calls": ("caller_symbol_id", "callee_name"), "edges": ("target_file_id", "source_file_id"), "metadata": ("key",)}
#: Rows in a bucket, about, and buckets at least.
BUCKET_ROWS, LEAST_BUCKETS = 2_000_000, 8


def _name(folder: str, relation: str, key: str) -> str:
    return f"keyed_{zlib.crc32(folder.rstrip('/').encode()):08x}_{relation}_by_{key}"


def write(rel: Relations, folder: str, *, buckets: int | None = None) -> None:
    """All layouts of the relations that rel has, below folder; a table ``layouts`` there names them."""
    spark = rel["files"].sparkSession
    made = []
    for relation, keys in LAYOUTS.items():
        if relation not in rel:
            continue
        df = rel[relation]
        n = buckets or max(LEAST_BUCKETS, 1 << (-(-df.count() // BUCKET_ROWS) - 1).bit_length())
        for key in keys:
            name, path = _name(folder, relation, key), f"{folder}/{relation}_by_{key}"
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
            made.append((relation, key, n, df.schema.toDDL()))
    spark.createDataFrame(made, "relation string, key string, buckets int, columns string").coalesce(1).write.parquet(f"{folder}/layouts")


@dataclass
class Keyed:
    """Layouts by relation and key."""

    layouts: dict[tuple[str, str], DataFrame]

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Keyed:
        """The layouts below folder; a session that doesn't know them yet takes them into its catalog."""
        out = {}
        for r in spark.read.parquet(f"{folder}/layouts").collect():  # a row a layout
            name = _name(folder, r.relation, r.key)
            if not spark.catalog.tableExists(name):
                spark.sql(f"CREATE TABLE {name} ({r.columns}) USING parquet CLUSTERED BY ({r.key}) SORTED BY ({r.key}) INTO {r.buckets} BUCKETS LOCATION '{folder}/{r.relation}_by_{r.key}'")
            out[r.relation, r.key] = spark.table(name)
        return cls(out)

    def table(self, relation: str, key: str) -> DataFrame:
        return self.layouts[relation, key]

    def one(self, relation: str, key: str, value) -> DataFrame:
        """The rows of one value of a key, from its bucket."""
        return self.table(relation, key).filter(F.col(key) == F.lit(value))

    def many(self, relation: str, key: str, keys: DataFrame) -> DataFrame:
        """The rows whose key is in keys (its only column), which may repeat."""
        asked = keys.toDF(key).distinct()
        return self.table(relation, key).join(asked, key, "left_semi")

    # --- point lookups and keyed scans

    def file(self, *, id: int | None = None, path: str | None = None) -> DataFrame:
        return self.one("files", "id", id) if path is None else self.one("files", "path", path)

    def metadata(self, key: str) -> DataFrame:
        return self.one("metadata", "key", key)

    def symbols_of(self, files: DataFrame) -> DataFrame:
        return self.many("symbols", "file_id", files)

    def imports_of(self, files: DataFrame) -> DataFrame:
        return self.many("imports", "file_id", files)

    def calls_of(self, symbols: DataFrame) -> DataFrame:
        return self.many("calls", "caller_symbol_id", symbols)

    def edges_to(self, files: DataFrame, kind: str) -> DataFrame:
        return self.many("edges", "target_file_id", files).filter(F.col("kind") == kind)

    def edges_from(self, files: DataFrame, kind: str) -> DataFrame:
        return self.many("edges", "source_file_id", files).filter(F.col("kind") == kind)

    def shown_file(self, path: str) -> DataFrame:
        """Symbols of a file, in order."""
        found = self.file(path=path).select(F.col("id").alias("file_id"), "path")
        return self.table("symbols", "file_id").join(found, "file_id").orderBy("line_start", "id")

    def shown_symbol(self, name: str) -> DataFrame:
        """Symbols of a name, with their files and how many call them."""
        callers = self.one("calls", "callee_name", name).agg(F.count_distinct("caller_symbol_id").alias("n_callers"))
        hit = self.one("symbols", "name", name)
        held = self.table("files", "id").select(F.col("id").alias("file_id"), "path")
        return hit.join(held, "file_id").crossJoin(callers)
