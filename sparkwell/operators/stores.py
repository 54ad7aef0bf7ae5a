"""Stores as tables: key-value, documents, vectors, indexes, chats. Each is a folder of parquet with a version file.

A write puts a new version beside the old one and then names it in `_current` through Spark's file system, so a reader
sees one version or the other and a lost executor only repeats its tasks.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Table:
    """A versioned table in a folder that Spark can read."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType | str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def _file(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_current")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> str | None:
        path, fs = self._file()
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            name = bytes(stream.readAllBytes()).decode().strip()
            if not name:
                raise ValueError(f"{self.folder}/_current is empty")
            return name
        finally:
            stream.close()

    def read(self) -> DataFrame:
        v = self.version()
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{v}") if v else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame) -> None:
        name = f"v-{uuid.uuid4().hex}"
        df.select(*self.schema.fieldNames()).write.parquet(f"{self.folder}/{name}")
        path, fs = self._file()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        new = hadoop.Path(f"{self.folder}/_next-{name}")
        out = fs.create(new, True)
        try:
            out.write(name.encode())
        finally:
            out.close()
        # a rename that replaces: readers see the old pointer or the new one, never an empty file
        over = self.spark._sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        over[0] = getattr(hadoop, "Options$Rename").OVERWRITE
        context = hadoop.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(context.makeQualified(new), context.makeQualified(path), over)

    def upsert(self, new: DataFrame, keys: list[str]) -> None:
        """Rows of the keys in `new` give way to them."""
        old = self.read().join(new.select(*keys), keys, "left_anti")
        self.write(old.unionByName(new.select(*self.schema.fieldNames())))

    def delete(self, ids: DataFrame, keys: list[str]) -> None:
        self.write(self.read().join(ids.select(*keys), keys, "left_anti"))


def last_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: of several, the one whose values, written as JSON, come last."""
    own = rows.withColumn("__row", F.to_json(F.struct(*rows.columns)))
    w = Window.partitionBy(*keys).orderBy(F.col("__row").desc())
    return own.withColumn("__i", F.row_number().over(w)).where("__i = 1").drop("__i", "__row")


class KeyValueStore(Table):
    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder, "collection string, key string, value string")

    def put(self, rows: DataFrame) -> None:
        self.upsert(last_of(rows, ["collection", "key"]), ["collection", "key"])

    def get(self, key: str, collection: str = "data") -> dict | None:
        row = self.read().where((F.col("collection") == collection) & (F.col("key") == key)).first()
        return json.loads(row.value) if row else None

    def all(self, collection: str = "data") -> DataFrame:
        return self.read().where(F.col("collection") == collection)


class DocumentStore(Table):
    """Nodes with their hash and source document."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder, "node_id string, text string, metadata map<string,string>, source_id string, hash string")

    def add(self, nodes: DataFrame, allow_update: bool = True) -> None:
        if not allow_update and not nodes.join(self.read(), "node_id", "left_semi").isEmpty():
            raise ValueError("a node exists already and updates are not allowed")
        self.upsert(last_of(nodes, ["node_id"]), ["node_id"])

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """Rows of (pos, node_id) in order of pos; missing ids are left out."""
        return wanted.join(self.read(), "node_id").orderBy("pos")

    def hashes(self) -> DataFrame:
        return self.read().select("hash", "node_id")

    def set_hash(self, changes: DataFrame) -> None:
        new = self.read().drop("hash").join(changes.select("node_id", "hash"), "node_id")
        self.upsert(new, ["node_id"])

    def source_info(self) -> DataFrame:
        return source_info(self.read())

    def delete_nodes(self, ids: DataFrame) -> None:
        self.delete(ids, ["node_id"])

    def delete_source(self, ids: DataFrame) -> None:
        self.delete(ids, ["source_id"])


def source_info(nodes: DataFrame) -> DataFrame:
    """(source_id, node_ids): the nodes of each source document, in order of id."""
    return nodes.where(F.col("source_id").isNotNull()).groupBy("source_id").agg(F.array_sort(F.collect_list("node_id")).alias("node_ids"))


class VectorStore(Table):
    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder, "node_id string, text string, metadata map<string,string>, embedding array<float>")

    def add(self, nodes: DataFrame) -> None:
        if not nodes.where("node_id is null or node_id = ''").isEmpty():
            raise ValueError("every node needs an id")
        nodes = last_of(nodes.withColumn("embedding", F.col("embedding").cast("array<float>")), ["node_id"])
        self.upsert(nodes, ["node_id"])

    def delete_nodes(self, ids: DataFrame) -> None:
        self.delete(ids, ["node_id"])


@dataclass(frozen=True)
class IndexStruct:
    """What an index is: its id, kind and summary, the place of its rows, and the ids of its nodes by name."""

    index_id: str
    kind: str
    summary: str = ""
    location: str = ""
    nodes: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> IndexStruct:
        known = {f.name for f in fields(IndexStruct)}
        return IndexStruct(**{k: v for k, v in json.loads(text).items() if k in known})


class IndexStore(Table):
    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder, "index_id string, kind string, summary string, location string, struct string")

    def put_structs(self, structs: list[IndexStruct]) -> None:
        rows = [(x.index_id, x.kind, x.summary, x.location, x.to_json()) for x in structs]
        self.put(self.spark.createDataFrame(rows, self.schema))

    def struct(self, index_id: str | None = None) -> IndexStruct | None:
        row = self.get(index_id)
        return IndexStruct.from_json(row.struct) if row and row.struct else None

    def put(self, rows: DataFrame) -> None:
        rows = rows if "struct" in rows.columns else rows.withColumn("struct", F.lit(None).cast("string"))
        self.upsert(last_of(rows, ["index_id"]), ["index_id"])

    def get(self, index_id: str | None = None):
        rows = self.read() if index_id is None else self.read().where(F.col("index_id") == index_id)
        found = rows.take(2)
        return found[0] if len(found) == 1 else None  # without an id only when there is exactly one


class ChatStore(Table):
    """Messages by key and position."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder, "key string, pos int, role string, text string")

    def set_messages(self, rows: DataFrame) -> None:
        self.upsert(rows, ["key"]) if not rows.isEmpty() else None

    def messages(self, key: str) -> DataFrame:
        return self.read().where(F.col("key") == key).orderBy("pos")

    def keys(self) -> DataFrame:
        return self.read().select("key").distinct()

    def _renumbered(self, rows: DataFrame) -> DataFrame:
        w = Window.partitionBy("key").orderBy("__p")
        return rows.withColumn("pos", F.row_number().over(w) - 1).drop("__p")

    def add(self, key: str, role: str, text: str, at: int | None = None) -> None:
        """At the end, or before position `at`."""
        place = F.lit(float("inf")) if at is None else F.lit(at - 0.5)
        new = self.spark.range(1).select(F.lit(key).alias("key"), place.alias("__p"), F.lit(role).alias("role"), F.lit(text).alias("text"))
        old = self.read().withColumn("__p", F.col("pos").cast("double")).drop("pos")
        self.write(self._renumbered(old.unionByName(new)))

    def delete_message(self, key: str, at: int) -> None:
        rows = self.read().where(~((F.col("key") == key) & (F.col("pos") == at)))
        self.write(self._renumbered(rows.withColumn("__p", F.col("pos").cast("double")).drop("pos")))

    def delete_last(self, key: str) -> None:
        last = self.read().where(F.col("key") == key).agg(F.max("pos")).first()[0]
        if last is not None:
            self.delete_message(key, last)

    def delete_key(self, key: str) -> None:
        self.write(self.read().where(F.col("key") != key))


class StorageContext:
    """The stores of one folder; named vector stores are kept too."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.documents = DocumentStore(spark, f"{self.folder}/documents")
        self.indexes = IndexStore(spark, f"{self.folder}/indexes")
        self.chats = ChatStore(spark, f"{self.folder}/chats")
        self.graph = Table(spark, f"{self.folder}/graph", "subject string, relation string, object string")

    def vectors(self, name: str = "default") -> VectorStore:
        return VectorStore(self.spark, f"{self.folder}/vectors/{name}")
