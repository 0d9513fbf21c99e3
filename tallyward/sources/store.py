"""The four tables as versioned folders: a new version is written beside the old one and a pointer row names the current one, so no input is overwritten while it is read."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns of the tables.
TABLES = {
    "files": "id long, rand double, path binary, modification_time timestamp, file_size long, last_seen long, to_be_read boolean, to_be_compared boolean, checksum binary, last_read long",
    "inventory": "path binary, modification_time timestamp, file_size long",
    "runs": "id long, snapshot_name string, snapshot_id long, run_at timestamp, sync_mode string, state string",
    "checksum_warnings": "id long, file_id long, path binary, modification_time timestamp, file_size long, expected_checksum binary, actual_checksum binary, discovered long, last_read long, created timestamp",
}


_POINTER = "n long, folders array<string>, partition_by array<string>, schema string"


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder that the cluster names. Unnamed, a temporary one serves where all is one process; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tallyward-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept_table(rows: DataFrame, name: str) -> DataFrame:
    """rows, computed once, written to a new shared folder and read again: lineage is cut, all uses agree, and it survives lost executors."""
    folder = work_folder(rows.sparkSession, name)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


class BatchFolder:
    """Folders of a stream's micro-batches: name/batch_id=n below a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def place(self, name: str, batch: int) -> str:
        return f"{self.folder}/{name}/batch_id={batch}"

    def done(self, name: str) -> list[int]:
        """The batches whose folder is whole."""
        new = self.spark._jvm.org.apache.hadoop.fs.Path
        path = new(f"{self.folder}/{name}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        found = [x.getPath() for x in files.listStatus(path)]
        return sorted(int(x.getName().split("=")[1]) for x in found if "=" in x.getName() and files.exists(new(x, "_SUCCESS")))

    def newest_before(self, name: str, batch: int, schema: StructType | str) -> tuple[DataFrame, int]:
        """(the table of the newest batch before the given one, its number); without one, an empty table and -1."""
        older = [n for n in self.done(name) if n < batch]
        if not older:
            return self.spark.createDataFrame([], schema), -1
        return self.spark.read.schema(schema).parquet(self.place(name, older[-1])), older[-1]

    def remove(self, name: str, batch: int) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.place(name, batch))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class Store:
    """Tables below a folder, created if absent. Writers of one table must take turns."""

    def __init__(self, spark: SparkSession, folder: str, prefix: str = "") -> None:
        self.spark, self.folder, self.prefix = spark, folder, prefix

    def _place(self, table: str) -> str:
        return f"{self.folder}/{self.prefix}{table}"

    def _pointers(self, table: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._place(table)}/pointer")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.schema(_POINTER).json(str(path.toString()))

    def _current(self, table: str) -> Row | None:
        """The pointer's newest row: n, folders of the version, partition_by, schema."""
        found = self._pointers(table)
        return found and found.orderBy(F.desc("n")).first()

    def read(self, table: str, schema: str | None = None) -> DataFrame:
        """The current version; an absent table is empty, with the given or the fixed columns."""
        now = self._current(table)
        if now is None:
            return self.spark.createDataFrame([], schema or TABLES[table])
        return self._at(now.folders, StructType.fromJson(json.loads(now.schema)))

    def _at(self, folders: list[str], schema: StructType) -> DataFrame:
        """The rows of a version; columns that are folders have the order and type they were written with."""
        return self.spark.read.schema(schema).option("basePath", folders[0].rsplit("/", 1)[0]).parquet(*folders).select(*schema.names)

    def _next(self, table: str, rows: DataFrame, kept: list[str], old: Row | None, partition_by: list[str]) -> DataFrame:
        """Writes rows to a folder of their own, which with those kept is the next version."""
        folders = [*kept, f"{self._place(table)}/data/part_of={uuid.uuid4().hex}"]
        rows.write.partitionBy(*partition_by).parquet(folders[-1])
        row = [(0 if old is None else old.n + 1, folders, partition_by, rows.schema.json())]
        self.spark.createDataFrame(row, _POINTER).coalesce(1).write.mode("append").json(f"{self._place(table)}/pointer")
        return self._at(folders, rows.schema)

    def write(self, table: str, rows: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        """Makes rows the table's next version and returns it."""
        return self._next(table, rows, [], self._current(table), partition_by or [])

    def append(self, table: str, rows: DataFrame) -> DataFrame:
        """A new version: the folders of the current one and another with rows, partitioned alike. Nothing that is there is read or written again, and readers of the current version go on with it."""
        now = self._current(table)
        if now is None:
            return self.write(table, rows)
        schema = StructType.fromJson(json.loads(now.schema))
        return self._next(table, rows.select(*(F.col(f.name).cast(f.dataType) for f in schema)), now.folders, now, now.partition_by)

    def forget(self, table: str, keep: int = 1) -> None:
        """Removes folders that the newest `keep` versions don't name."""
        found = self._pointers(table)
        if found is None:
            return
        kept = {f for r in found.orderBy(F.desc("n")).limit(keep).collect() for f in r.folders}
        for folder in {f for r in found.collect() for f in r.folders} - kept:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def replace(self, table: str, rows: DataFrame, key: str = "id") -> DataFrame:
        """Rows of the same key give way to the new ones; ids that are not there are an error. A new version, partitioned as the one before."""
        now, old = self._current(table), self.read(table, rows.schema)
        if missing := rows.join(old, key, "left_anti").limit(1).collect():
            raise ValueError(f"not in {table}: {missing[0][key]}")
        return self.write(table, old.join(rows.select(key), key, "left_anti").select(*old.columns).unionByName(rows), now.partition_by if now else None)


def write_bucketed(rows: DataFrame, name: str, folder: str, buckets: int, key: str = "path") -> DataFrame:
    """rows as a table of the session's catalog, stored below a folder in buckets of a key: joins by it leave the table where it is. buckets should be spark.sql.shuffle.partitions or more."""
    rows.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").option("path", folder).saveAsTable(name)
    return rows.sparkSession.table(name)


def open_bucketed(spark: SparkSession, name: str, folder: str, schema: StructType, buckets: int, key: str = "path") -> DataFrame:
    """A table that write_bucketed wrote, in a session whose catalog doesn't know it."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE `{name}` ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{folder}'")
    return spark.table(name)


def read_database(spark: SparkSession, url: str, table: str, *, lower: int, upper: int, partitions: int, key: str = "id") -> DataFrame:
    """A table of a database in ranges of its key (needs the database's driver on the class path)."""
    return spark.read.jdbc(url, table, column=key, lowerBound=lower, upperBound=upper, numPartitions=partitions)
