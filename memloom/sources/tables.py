"""Memory tables, JSON lists, traces and flat files."""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MEMORY_SCHEMA = (
    "id string, user_id string, status string, level int, summary string, metadata struct<source:string,memory_key:string,event:string,source_session_index:int,source_session_time:string,"
    "anchor_time:string,event_anchor:string,type:string,fact_type:string>, embedding array<float>, created_at timestamp, updated_at timestamp"
)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_json_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON array file; a missing or broken file, or one without an array, gives no rows, and elements that are no objects are dropped."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    items = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("item"))
    return items.where(F.ltrim("item").startswith("{")).select(F.from_json("item", schema).alias("r")).select("r.*")


def read_score_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of an array, or of an object whose values are arrays."""
    raw = spark.read.text(path, wholetext=True)
    as_list = F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<string>"))
    as_map = F.flatten(F.transform(F.map_values(F.from_json("value", "map<string,string>")), lambda v: F.coalesce(F.from_json(v, "array<string>"), F.array().cast("array<string>"))))
    return raw.select(F.explode(F.coalesce(as_list, as_map)).alias("item")).select(F.from_json("item", schema).alias("r")).select("r.*")


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Overwrite for stage results, append for traces."""
    df.write.mode(mode).json(path)


def write_flat(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a header of exactly these columns."""
    df.select(*columns).write.mode("overwrite").csv(path, header=True)


class MemoryTable:
    """A memory table of base and delta rows, bucketed by user and merged on read.

    ``path/data`` holds Parquet in one folder per commit, hashed into ``buckets`` by user: a user's scan reads one bucket, and
    grouping or joining by user needs no shuffle. A write appends rows in proportion to its batch: memories that are put, embeddings that are
    set, users that are cleared. ``path/log`` has one numbered file per commit, created only if nobody else has
    the number, so concurrent writers get different versions, and rows of writers that failed are never seen. Readers keep the version they
    opened. ``compact`` folds a snapshot into a new base; ``vacuum`` deletes what no version since the base needs.

    A memory is known by (user_id, id), neither of them null. Of puts the latest commit, then updated_at, wins; created_at
    and the embedding stay the first's until an embedding is set.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        self.name = "memories_" + hashlib.md5(self.path.encode()).hexdigest()
        self._record(0, {"kind": "new", "buckets": buckets})
        self.refresh()

    # the log

    def _log(self, version: int):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/{version:020}.json")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _record(self, version: int, entry: dict) -> bool:
        """Take the number for a commit; false if another writer has it."""
        fs, p = self._log(version)
        try:
            out = fs.create(p, False)
        except Py4JJavaError:
            if fs.exists(p):
                return False
            raise
        out.write(json.dumps(entry).encode())
        out.close()
        return True

    def refresh(self) -> "MemoryTable":
        """Open the latest version."""
        fs, p = self._log(0)
        numbers = sorted(int(f.getPath().getName()[:20]) for f in fs.listStatus(p.getParent()) if f.getPath().getName().endswith(".json"))
        found = {r.value: r.path for r in self.spark.read.text(f"{self.path}/log/*.json", wholetext=True).select("value", F.input_file_name().alias("path")).collect()}
        # a writer that was lost before it wrote its entry has taken a number and nothing else
        self.log = {int(path.rsplit("/", 1)[1][:20]): json.loads(text) for text, path in found.items() if text.strip()}
        self.version, self.buckets = max(numbers), self.log[0]["buckets"]
        spark = self.spark
        if not spark.catalog.tableExists(self.name):
            columns = f"{MEMORY_SCHEMA}, op string, commit string"
            fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in StructType.fromDDL(columns))
            spark.sql(f"CREATE TABLE {self.name} ({fields}) USING parquet OPTIONS (path '{self.path}/data') PARTITIONED BY (commit) CLUSTERED BY (user_id) SORTED BY (user_id, id) INTO {self.buckets} BUCKETS")
        fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data"))
        spark.catalog.recoverPartitions(self.name)  # commits of other sessions
        return self

    def _append(self, kind: str, rows: DataFrame, **more) -> None:
        """Write rows (op and columns of the schema) as one commit."""
        commit, known = uuid.uuid4().hex, set(rows.columns)
        for c in ("user_id", *(["id"] if kind != "clear" else [])):
            rows = rows.withColumn(c, F.coalesce(F.col(c), F.raise_error(F.lit(f"a memory without {c}"))))
        full = [F.col(f.name) if f.name in known else F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(f"{MEMORY_SCHEMA}, op string")]
        # a table of its own, so that writers don't share a folder for unfinished files; its files become a partition of this one
        own = f"{self.name}_{commit}"
        dealt = rows.select(*full).repartition(self.buckets, "user_id")
        dealt.write.bucketBy(self.buckets, "user_id").sortBy("user_id", "id").option("path", f"{self.path}/data/commit={commit}").saveAsTable(own)
        self.spark.sql(f"DROP TABLE {own}")
        version = self.version + 1
        while not self._record(version, {"kind": kind, "commit": commit, **more}):
            version += 1
        self.refresh()

    # reading

    def _live(self, version: int | None) -> tuple[int, dict[str, int], bool]:
        """(base version, version by commit, whether users were cleared) of a snapshot; a base counts as the version it folds."""
        version = self.version if version is None else version
        log = {v: e for v, e in self.log.items() if 0 < v <= version}
        base = max((v for v, e in log.items() if e["kind"] == "base"), default=0)
        upto = log[base]["upto"] if base else 0
        live = {e["commit"]: v for v, e in log.items() if v > upto and e["kind"] != "base"}
        cleared = any(log[v]["kind"] == "clear" for v in live.values())
        return base, live | ({log[base]["commit"]: upto} if base else {}), cleared

    def read(self, user_id: str | None = None, version: int | None = None) -> DataFrame:
        """Rows of a version (the one opened last), of one user or all."""
        _, live, cleared = self._live(version)
        if not live:
            return self.spark.createDataFrame([], MEMORY_SCHEMA)
        rows = self.spark.table(self.name).where(F.col("commit").isin(sorted(live)))
        if user_id is not None:
            rows = rows.where(F.col("user_id") == user_id)
        number = F.create_map(*[F.lit(x) for item in sorted(live.items()) for x in item])
        rows = rows.withColumn("v", number[F.col("commit")])
        if cleared:
            last = rows.where("op = 'clear'").groupBy("user_id").agg(F.max("v").alias("gone"))
            rows = rows.join(last, "user_id", "left").where("gone IS NULL OR v > gone")
        put, embed = F.col("op") == "put", F.col("op") == "embed"
        kept = F.struct("status", "level", "summary", "metadata", "updated_at")
        order = F.struct("v", "updated_at")
        vector = F.struct("embedding")
        out = rows.where("op <> 'clear'").groupBy("user_id", "id").agg(
            F.max_by(F.when(put, kept), F.when(put, order)).alias("p"),
            F.min(F.when(put, F.col("created_at"))).alias("created_at"),
            F.max(F.when(embed, F.col("updated_at"))).alias("embedded_at"),
            F.coalesce(F.max_by(F.when(embed, vector), F.when(embed, F.col("v"))), F.min_by(F.when(put, vector), F.when(put, order))).alias("e"),
        )
        return out.where("p IS NOT NULL").select("id", "user_id", "p.status", "p.level", "p.summary", "p.metadata", "e.embedding", "created_at", F.greatest("p.updated_at", "embedded_at").alias("updated_at"))

    def items(self, user_id: str) -> DataFrame:
        """A user's memories in order of creation; their id is the memory key, else the row's."""
        rows = self.read(user_id)
        key = F.coalesce(F.nullif(F.trim("metadata.memory_key"), F.lit("")), "id")
        return rows.select(key.alias("id"), F.col("summary").alias("text"), "created_at", "metadata").orderBy("created_at", "id")

    # writing

    def upsert(self, incoming: DataFrame) -> None:
        self._append("put", incoming.withColumn("op", F.lit("put")))

    def clear_user(self, user_id: str) -> None:
        """What the user had before is gone; one row is written."""
        self._append("clear", self.spark.createDataFrame([(user_id, "clear")], "user_id string, op string"))

    def set_embeddings(self, vectors: DataFrame) -> None:
        """Set the embeddings of ``vectors(user_id, id, embedding)``; a null one is to be filled in again."""
        self._append("embed", vectors.select("user_id", "id", F.col("embedding").cast("array<float>").alias("embedding"), F.current_timestamp().alias("updated_at"), F.lit("embed").alias("op")))

    def backfill(self, embed) -> None:
        """Fill in missing embeddings; ``embed`` is a function from a text column to a vector column."""
        self.set_embeddings(self.read().where("embedding IS NULL").select("user_id", "id", embed(F.col("summary")).alias("embedding")))

    def compact(self) -> None:
        """Fold the opened version into a base. Commits that come meanwhile stay beside it."""
        self._append("base", self.read().withColumn("op", F.lit("put")), upto=self.version)

    def vacuum(self) -> None:
        """Delete the rows of commits that the latest base has folded; versions before it can't be read any more."""
        base, live, _ = self._live(None)
        for version, entry in self.log.items():
            if 0 < version < base and entry["commit"] not in live:
                self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (commit = '{entry['commit']}')")
                p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/commit={entry['commit']}")
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def provision_database(spark: SparkSession, name: str, reset: bool = False) -> bool:
    """Create the workspace's database; true if it is new or was reset."""
    existed = spark.catalog.databaseExists(name)
    if existed and not reset:
        return False
    if existed:
        spark.sql(f"DROP DATABASE `{name}` CASCADE")
    spark.sql(f"CREATE DATABASE `{name}`")
    return True


def memory_export(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of every session, rows of each user's last session)."""
    last = snapshots.groupBy("user_id").agg(F.max("session").alias("session"))
    return snapshots, snapshots.join(last, ["user_id", "session"])


def rubric_sections(text: str, labels: list[str]) -> dict[str, list[dict]]:
    """Rubric lists of a text file: each label's section holds one JSON array."""
    out = {}
    for i, label in enumerate(labels):
        start = text.index(label) + len(label)
        ends = [text.find(other, start) for other in labels[i + 1 :] if text.find(other, start) >= 0]
        section = text[start : min(ends, default=len(text))]
        found = re.search(r"\[.*\]", section, re.S)
        out[label] = json.loads(found.group()) if found else []
    return out
