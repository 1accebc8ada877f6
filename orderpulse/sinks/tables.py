"""Table sinks: versioned snapshot tables, keyed tables, append tables, JDBC.

All three kinds are folders of Parquet files and a commit log. A commit is one
small file, ``_log/<number>.json``, created only if no writer has created that
number (compare and swap); it appears whole. A reader follows the newest entry,
so it sees one state of the table; of two writers with the same number the
loser reads the log again and tries the next one, so none is lost. Data files
are written beforehand into a folder that only this writer has claimed.

An entry holds what a reader needs (the version, or the list of folders) and
the tags of the last ``TAGS`` commits. A tag names a write (query and batch):
writing a committed tag again does nothing, which makes a replayed micro-batch
harmless. The newest ``LOG_ENTRIES`` entries are kept.

The folder must lie on a file system with an atomic rename or link that refuses
an existing target (a local or mounted disk, HDFS); see ``create_file``.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderpulse.session import create_file, delete_path, file_sizes, list_dirs, list_files, path_exists, read_file

TAGS = 64
LOG_ENTRIES = 64
#: seconds after which a folder that no entry names belongs to a writer that died
ORPHAN_AGE = 24 * 3600


class CommitLog:
    """The log of one table: numbered entries, each a JSON object."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.path = f"{root}/_log"

    def numbers(self) -> list[int]:
        names = (name.removesuffix(".json") for name, _ in list_files(self.spark, self.path) if name.endswith(".json"))
        return sorted(int(n) for n in names if n.isdigit())

    def read(self, number: int) -> dict | None:
        text = read_file(self.spark, f"{self.path}/{number:020d}.json")
        return None if text is None else json.loads(text)

    def head(self) -> tuple[int, dict]:
        """(number, entry) of the newest entry; (-1, {}) of an empty log."""
        while numbers := self.numbers():
            entry = self.read(numbers[-1])
            if entry is not None:
                return numbers[-1], entry
        return -1, {}

    def last(self, count: int) -> list[dict]:
        """The newest entries, newest first."""
        return [e for n in reversed(self.numbers()[-count:]) if (e := self.read(n)) is not None]

    def add(self, number: int, entry: dict) -> bool:
        """Create entry ``number``; False if another writer has."""
        if not create_file(self.spark, f"{self.path}/{number:020d}.json", json.dumps(entry)):
            return False
        there = self.numbers()
        if there[-1] > number and number - 1 not in there and number > 0:
            # the log went on while this writer slept, and its number was cleared away
            delete_path(self.spark, f"{self.path}/{number:020d}.json")
            return False
        for n in there[:-LOG_ENTRIES]:
            delete_path(self.spark, f"{self.path}/{n:020d}.json")
        return True


def _with_tag(entry: dict, tag: str | None, value: int) -> dict:
    """The tags of ``entry`` and, newest, ``tag``."""
    tags = {t: v for t, v in entry.get("tags", {}).items() if t != tag}
    if tag is not None:
        tags[tag] = value
    return dict(list(tags.items())[-TAGS:])


class VersionedTable:
    """A table that is replaced as a whole::

        versions/version=<n>/*.parquet        one folder per version
        claims/<n>                            who writes into a version's folder
        staging/snapshot=<key>/part=<p>/      parts of snapshots not yet whole
        _log/<number>.json                    the commits

    Version numbers are handed out here, greater than every folder's, so the
    table outlives checkpoints and restarted producers. Of the committed
    versions the newest ``keep`` are kept.

    A commit may have a ``key`` (a snapshot's time and arrival): the log keeps
    the greatest, and a commit at or below it is refused. So a snapshot that
    arrives late, in a later batch or after a restart, never replaces a newer
    one.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | None = None,
                 keep: int = 3):
        if keep < 1:
            raise ValueError("keep must be at least 1")
        self.spark = spark
        self.keep = keep
        self.root = root.rstrip("/")
        self.versions = f"{self.root}/versions"
        self.staging = f"{self.root}/staging"
        self.pointer = f"{self.root}/_log"
        self.log = CommitLog(spark, self.root)
        self.schema = schema

    # -- writing ---------------------------------------------------------
    def _claim(self) -> int:
        """A version number, and so a folder, that no other writer has."""
        taken = [v for v, _ in self._folders()]
        version = 1 + max([-1, self.log.head()[1].get("version", -1), *taken])
        while not create_file(self.spark, f"{self.root}/claims/{version}", ""):
            version += 1
        return version

    def write_version(self, rows: DataFrame, tag: object = None, key: str | None = None) -> int | None:
        """Write ``rows`` as a new version and commit it; with a ``tag`` that
        is committed already, do nothing. Returns the version, or None when
        the table has a snapshot with that ``key`` or a greater one."""
        tag = None if tag is None else str(tag)
        head = self.log.head()[1]
        if tag is not None and tag in head.get("tags", {}):
            return head["tags"][tag]
        if self._is_late(head, key):
            return None
        version = self._claim()
        rows.write.mode("overwrite").parquet(f"{self.versions}/version={version}")
        if key is None:
            self.commit(version, tag)
        elif not self.commit(version, tag, key):
            delete_path(self.spark, f"{self.versions}/version={version}")
            return None
        return version

    @staticmethod
    def _is_late(head: dict, key: str | None) -> bool:
        return key is not None and head.get("key") is not None and key <= head["key"]

    def commit(self, version: int, tag: str | None = None, key: str | None = None) -> bool:
        """Make ``version`` the current one, then drop what is no longer
        needed. False when a snapshot with a greater or equal key is there."""
        while True:
            number, head = self.log.head()
            if self._is_late(head, key):
                return False
            entry = {"version": version, "key": key if key is not None else head.get("key"),
                     "tags": _with_tag(head, tag, version)}
            if self.log.add(number + 1, entry):
                self.vacuum()
                return True

    def _folders(self) -> list[tuple[int, str]]:
        found = []
        for name, path in list_dirs(self.spark, self.versions):
            if name.startswith("version=") and name[8:].isdigit():
                found.append((int(name[8:]), path))
        return found

    @staticmethod
    def _named(entry: dict) -> set[int]:
        """The version folders that an entry's readers read."""
        return {entry["version"]}

    def vacuum(self, enough: int | None = None) -> int:
        """Delete version folders that earlier entries name and the ``keep``
        newest do not, once there are twice as many (metadata only). Readers
        of a just-replaced version keep ``keep - 1`` versions of grace. A
        folder that no entry names may be another writer's; it goes when it is
        ``ORPHAN_AGE`` seconds old. Returns the number of folders removed."""
        folders = self._folders()
        if len(folders) < (2 * self.keep if enough is None else enough):
            return 0
        entries = self.log.last(LOG_ENTRIES)
        if len(entries) < self.keep:
            return 0
        kept = set().union(*(self._named(e) for e in entries[:self.keep]))
        known = set().union(*(self._named(e) for e in entries))
        removed = 0
        for v, path in folders:
            if v not in kept and v < max(kept) and (v in known or self._age(path) > ORPHAN_AGE):
                delete_path(self.spark, path)
                delete_path(self.spark, f"{self.root}/claims/{v}")
                removed += 1
        return removed

    def _age(self, path: str) -> float:
        jvm = self.spark.sparkContext._jvm
        hpath = jvm.org.apache.hadoop.fs.Path(path)
        fs = hpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return time.time() - fs.getFileStatus(hpath).getModificationTime() / 1000

    # -- snapshots in parts ------------------------------------------------
    def stage(self, parts: DataFrame) -> None:
        """Write parts of snapshots: rows with ``snapshot`` (sortable text),
        ``part``, ``parts`` and ``data`` (array of table rows, maybe empty).
        A part written again replaces itself."""
        (parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("snapshot", "part").parquet(self.staging))

    def commit_complete(self) -> int | None:
        """Commit the newest staged snapshot that has all its parts and is
        newer than the committed one, then drop it and everything staged up to
        it. Only the staged folders are read; one small row a snapshot reaches
        the driver."""
        done = self.log.head()[1].get("key")
        names = []
        for name, path in list_dirs(self.spark, self.staging):
            if done is not None and name.startswith("snapshot=") and name[9:] <= done:
                delete_path(self.spark, path)  # late: the table is newer
            elif name.startswith("snapshot="):
                names.append((name[9:], path))
        if not names:
            return None
        staged = self.spark.read.option("basePath", self.staging).schema(
            "snapshot string, part int, parts int, data array<struct<category:string,count:bigint,timestamp:timestamp_ntz,"
            "updated_at:timestamp>>").parquet(*[p for _, p in names])
        whole = (staged.groupBy("snapshot").agg(F.countDistinct("part").alias("have"), F.max("parts").alias("need"))
                 .where("have >= need").agg(F.max("snapshot").alias("s")).first())["s"]
        if whole is None:
            return None
        entries = staged.where(F.col("snapshot") == whole).select("part", F.posexplode("data").alias("at", "row"))
        # one row a category: of several entries the last
        rows = entries.groupBy("row.category").agg(F.max_by("row", F.struct("part", "at")).alias("row")).select("row.*")
        version = self.write_version(rows, f"snapshot {whole}", whole)
        for name, path in names:
            if name <= whole:
                delete_path(self.spark, path)
        return version

    # -- reading ---------------------------------------------------------
    def current_version(self) -> int | None:
        return self.log.head()[1].get("version")

    def read(self) -> DataFrame:
        """The committed snapshot (empty with ``schema`` if none yet). Reads
        the one version folder."""
        v = self.current_version()
        if v is None:
            if self.schema is None:
                raise FileNotFoundError(f"no committed version under {self.root}")
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(self.schema) if self.schema is not None else self.spark.read
        return reader.parquet(f"{self.versions}/version={v}")


class KeyedTable(VersionedTable):
    """A table of one row per ``key`` (a column or several), in buckets by
    extendible hashing: a bucket holds the rows whose key hash ends with its
    bits, and one that would pass ``max_rows`` is split by more bits when it is
    written. An update writes the buckets that it touches, each of at most
    about ``max_rows`` rows, so it costs what it touches however large the
    table is, and readers still see one whole version. An entry of the log is
    the directory: each bucket's bits, rows, and the version that holds it.

        versions/version=<n>/bucket=<bits>-<value>/*.parquet

    The directory grows with the table's rows by one short line per
    ``max_rows``. ``buckets`` is the number to start with (a power of two).
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str | list[str], buckets: int = 64,
                 keep: int = 3, max_rows: int = 500_000):
        super().__init__(spark, root, schema, keep)
        self.key = [key] if isinstance(key, str) else list(key)
        self.buckets, self.max_rows = buckets, max_rows
        self.bits = max(0, buckets - 1).bit_length()

    def hash(self) -> Column:
        return F.xxhash64(*self.key)

    def _directory(self, head: dict) -> list[list[int]]:
        """[bits, value, rows, version] of every bucket; version -1: no rows yet."""
        return head.get("buckets") or [[self.bits, v, 0, -1] for v in range(1 << self.bits)]

    def _named_buckets(self, rows: DataFrame, directory: list[list[int]]) -> DataFrame:
        """``rows`` with ``bucket``, the name of theirs. The slots (one for
        each ending of the longest bits) are a small table of their own."""
        deepest = max(b for b, *_ in directory)
        slots = [(low << b | v, f"{b}-{v}") for b, v, *_ in directory for low in range(1 << deepest - b)]
        table = self.spark.createDataFrame(slots, "_slot long, bucket string")
        slot = self.hash().bitwiseAND(F.lit((1 << deepest) - 1))
        return rows.withColumn("_slot", slot).join(table, "_slot").drop("_slot")

    def _rows(self, directory: list[list[int]]) -> DataFrame:
        paths = [f"{self.versions}/version={at}/bucket={b}-{v}" for b, v, _, at in directory if at >= 0]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def merge(self, updates: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], tag: object = None) -> int | None:
        """Replace the buckets that ``updates`` touch by ``combine(current
        rows of those buckets, updates)``. Returns the number of buckets
        written, or None when ``tag`` is committed already. When another
        writer commits meanwhile, the merge starts again from its rows."""
        tag = None if tag is None else str(tag)
        while True:
            number, head = self.log.head()
            if tag is not None and tag in head.get("tags", {}):
                return None
            directory = self._directory(head)
            keys = self._named_buckets(updates.select(*self.key).distinct(), directory)
            touched = {r["bucket"]: r["n"] for r in keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
            if not touched:
                return 0
            stay, old, new = [], [], []
            for b, v, rows, at in directory:
                more = touched.get(f"{b}-{v}")
                if more is None:
                    stay.append([b, v, rows, at])
                    continue
                old.append([b, v, rows, at])
                # split to three quarters of the bound, as the halves of a bucket are not quite equal
                extra = 0 if rows + more <= self.max_rows else max(1, -(-4 * (rows + more) // (3 * self.max_rows)) - 1).bit_length()
                new += [[b + extra, high << b | v, 0, -1] for high in range(1 << extra)]
            version = self._claim()
            path = f"{self.versions}/version={version}"
            merged = self._named_buckets(combine(self._rows(old), updates), [*stay, *new])
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
            there = {name.removeprefix("bucket="): p for name, p in list_dirs(self.spark, path) if name.startswith("bucket=")}
            sizes = {r["bucket"]: r["n"] for r in self.spark.read.schema("bucket string").parquet(path).groupBy("bucket").agg(
                F.count(F.lit(1)).alias("n")).collect()} if there else {}
            new = [[b, v, sizes[f"{b}-{v}"], version] if f"{b}-{v}" in sizes else [b, v, 0, -1] for b, v, *_ in new]
            entry = {"version": version, "buckets": stay + new, "tags": _with_tag(head, tag, version)}
            if self.log.add(number + 1, entry):
                self.vacuum(2 * self.keep + self.buckets)
                return len(sizes)
            delete_path(self.spark, path)

    @staticmethod
    def _named(entry: dict) -> set[int]:
        return {entry["version"], *(at for *_, at in entry["buckets"] if at >= 0)}

    def read(self) -> DataFrame:
        head = self.log.head()[1]
        return self._rows(self._directory(head))


class AppendTable:
    """A table that only grows, batch by batch::

        folder=<id>/*.parquet      the rows of one batch, or of several compacted ones
        _log/<number>.json         the folders, each with its level

    A batch is one commit under the tag (run, batch), and a replay of it adds
    nothing. ``FAN_IN`` folders of one level are compacted into one of the next,
    so a row is rewritten once a level, and ``n`` batches leave about
    ``FAN_IN * log(n)`` folders. A reader reads the folders of one entry, before
    or after a compaction, and so each row once. Replaced folders stay for
    ``GRACE`` further commits for readers that still use them.
    """

    FAN_IN = 8
    GRACE = 16
    FILE_BYTES = 128 << 20

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.log = CommitLog(spark, self.root)

    def _entry(self, head: dict, folders: list, gone: list, number: int, tag: str | None = None) -> dict:
        old = [g for g in head.get("gone", [])]
        return {"folders": folders, "gone": old + [[number, f] for f in gone], "tags": _with_tag(head, tag, number)}

    def _commit(self, change: Callable[[dict], tuple[list, list] | None], tag: str | None = None) -> bool:
        """Apply ``change`` (entry to folders and replaced folders; None: no
        longer wanted) to the newest entry, again when another writer was first."""
        while True:
            number, head = self.log.head()
            if tag is not None and tag in head.get("tags", {}):
                return False
            changed = change(head)
            if changed is None:
                return False
            entry = self._entry(head, *changed, number + 1, tag)
            clear = [f for n, f in entry["gone"] if n + self.GRACE <= number]
            entry["gone"] = [g for g in entry["gone"] if g[1] not in clear]
            if self.log.add(number + 1, entry):
                for f in clear:
                    delete_path(self.spark, f"{self.root}/folder={f}")
                return True

    def _write(self, rows: DataFrame) -> str:
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/folder={folder}")
        return folder

    def append(self, rows: DataFrame, batch_id: int, run: str = "") -> bool:
        """Add the rows with the ``run`` and ``batch_id`` that wrote them;
        False if that batch is in the table. Batches of another run (a fresh
        checkpoint counts from 0 again) are other batches."""
        tag = f"{run} {batch_id}"
        if tag in self.log.head()[1].get("tags", {}):
            return False
        folder = self._write(rows.select("*", F.lit(run).alias("run"), F.lit(batch_id).cast("long").alias("batch_id")))
        if not self._commit(lambda head: ([*head.get("folders", []), [0, folder]], []), tag):
            delete_path(self.spark, f"{self.root}/folder={folder}")
            return False
        self.compact()
        return True

    def compact(self) -> int:
        """Compact every level that is full; returns the number of folders replaced."""
        replaced = 0
        while True:
            folders = self.log.head()[1].get("folders", [])
            full = next((lv for lv in sorted({lv for lv, _ in folders}) if sum(x == lv for x, _ in folders) >= self.FAN_IN), None)
            if full is None:
                return replaced
            old = [f for lv, f in folders if lv == full]
            paths = [f"{self.root}/folder={f}" for f in old]
            files = max(1, -(-sum(sum(file_sizes(self.spark, p)) for p in paths) // self.FILE_BYTES))
            folder = self._write(self.spark.read.parquet(*paths).coalesce(files))

            def swap(head: dict, old=old, folder=folder, full=full) -> tuple[list, list] | None:
                now = head.get("folders", [])
                if not {*old} <= {f for _, f in now}:
                    return None  # another writer has compacted them
                rest = [x for x in now if x[1] not in old]
                return [[full + 1, folder], *rest], old

            if not self._commit(swap):
                delete_path(self.spark, f"{self.root}/folder={folder}")
                return replaced
            replaced += len(old)

    def ensure(self, schema: T.StructType) -> None:
        """Create the table without rows if it has no commit yet (SNK-09)."""
        if not self.log.numbers():
            self.append(self.spark.createDataFrame([], schema), -1, "none")

    def read(self, schema: T.StructType) -> DataFrame:
        """Rows with their ``run`` and ``batch_id``; empty, with the schema, before the first batch."""
        full = T.StructType([*schema.fields, T.StructField("run", T.StringType()), T.StructField("batch_id", T.LongType())])
        folders = self.log.head()[1].get("folders", [])
        if not folders:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(*[f"{self.root}/folder={f}" for _, f in folders])


def append_batch(rows: DataFrame, root: str, batch_id: int, run: str = "") -> None:
    """Append rows to the table at ``root`` under ``run`` and ``batch_id``;
    replaying a batch adds nothing (SNK-06)."""
    AppendTable(rows.sparkSession, root).append(rows, batch_id, run)


def read_appended(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """Rows of an append table (with their ``batch_id``); empty, with the
    schema, when no batch has written rows yet."""
    return AppendTable(spark, root).read(schema).drop("run")


def ensure_table(spark: SparkSession, root: str, schema: T.StructType) -> None:
    """Create an empty table with ``schema`` at ``root`` if none exists (SNK-09)."""
    if not path_exists(spark, root):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(root)


def _jdbc(rows: DataFrame, url: str, table: str, properties: dict[str, str] | None):
    w = rows.write.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        w = w.option(k, v)
    return w


def write_jdbc_snapshot(rows: DataFrame, url: str, table: str,
                        properties: dict[str, str] | None = None,
                        column_types: str | None = None) -> None:
    """Replace a relational table's rows in one overwrite; ``truncate`` keeps
    the table definition (SNK-08 against a database). Atomicity is whatever
    the database gives one such statement sequence."""
    w = _jdbc(rows, url, table, properties).option("truncate", "true")
    if column_types:
        w = w.option("createTableColumnTypes", column_types)
    w.mode("overwrite").save()


def append_jdbc(rows: DataFrame, url: str, table: str, batch_id: int, run: str = "",
                properties: dict[str, str] | None = None, execute: Callable[[list[str]], None] | None = None) -> None:
    """Append rows with the ``run`` and ``batch_id`` that wrote them. Tasks
    commit one by one, so they fill a staging table of this batch; then one
    transaction deletes the batch's rows from ``table`` (a replay), inserts the
    staged ones and drops nothing else. A batch that failed half-way is whole
    after its retry. ``execute`` runs the statements of one transaction (the
    database's driver on the Spark driver, by default)."""
    stage = f"{table}_stage_{uuid.uuid5(uuid.NAMESPACE_OID, f'{run} {batch_id}').hex[:12]}"
    columns = ", ".join([*rows.columns, "run", "batch_id"])
    tagged = rows.select("*", F.lit(run).alias("run"), F.lit(batch_id).cast("long").alias("batch_id"))
    _jdbc(tagged, url, stage, properties).mode("overwrite").save()
    literal = run.replace("'", "''")
    execute = execute or (lambda statements: _transaction(rows.sparkSession, url, properties, statements))
    execute([f"DELETE FROM {table} WHERE run = '{literal}' AND batch_id = {int(batch_id)}",
             f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {stage}"])
    execute([f"DROP TABLE {stage}"])


def _transaction(spark: SparkSession, url: str, properties: dict[str, str] | None, statements: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    info = jvm.java.util.Properties()
    for k, v in (properties or {}).items():
        info.setProperty(k, v)
    connection = jvm.java.sql.DriverManager.getConnection(url, info)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        for text in statements:
            statement.executeUpdate(text)
        connection.commit()
    finally:
        connection.close()
