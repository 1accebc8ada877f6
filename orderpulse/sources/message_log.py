"""An append-only message table with partitions and offsets, and its stream.

Without a broker this is how a stream can have a start policy and offsets that
can be read and handed on (SRC-06): messages are appended in segments, and a
streaming source reads them from ``earliest``, ``latest`` or given offsets.
The start applies only when the checkpoint has no stored progress. It is a
reader of files, not a broker: there is no server, no group and no retention.

::

    segment=<id>/partition=<p>/*.parquet    (place, value, ts), sorted by place
    _log/<number>.json                      the segments with their first offsets

A row's offset is its segment's first offset in the partition plus its place,
so appends that race keep their files and take the next offsets.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from orderpulse.session import list_dirs
from orderpulse.sinks.tables import CommitLog

SCHEMA = "value string, seq bigint, source string, block bigint, line bigint"
FORMAT = "message_log"


class MessageLog:
    """The writing side."""

    def __init__(self, spark: SparkSession, root: str, partitions: int = 4):
        self.spark, self.root, self.partitions = spark, root.rstrip("/"), partitions
        self.log = CommitLog(spark, self.root)

    def append(self, messages: DataFrame, value: str = "value") -> dict[str, int]:
        """Append the messages as one segment; returns the next offset of each
        partition. Messages are dealt by a hash, and a partition's messages
        are numbered in one task, as a broker's partition takes them one by one."""
        segment = uuid.uuid4().hex
        path = f"{self.root}/segment={segment}"
        dealt = messages.select(F.col(value).alias("value")).withColumn(
            "partition", F.pmod(F.xxhash64("value"), F.lit(self.partitions)).cast("int"))
        order = Window.partitionBy("partition").orderBy("value")
        (dealt.withColumns({"place": (F.row_number().over(order) - 1).cast("long"), "ts": F.unix_micros(F.current_timestamp())})
         .sortWithinPartitions("partition", "place").write.partitionBy("partition").parquet(path))
        sizes = {}
        if list_dirs(self.spark, path):
            rows = self.spark.read.schema("place long, partition int").parquet(path).groupBy("partition").agg(F.count(F.lit(1)).alias("n"))
            sizes = {str(r["partition"]): r["n"] for r in rows.collect()}  # one row a partition
        while True:
            number, head = self.log.head()
            first = head.get("next") or {str(p): 0 for p in range(self.partitions)}
            entry = {"segments": [*head.get("segments", []), [segment, {p: [first[p], n] for p, n in sizes.items()}]],
                     "next": {p: n + sizes.get(p, 0) for p, n in first.items()}}
            if self.log.add(number + 1, entry):
                return entry["next"]


def _file_system(path: str):
    import pyarrow.fs as fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


class _Range(InputPartition):
    def __init__(self, partition: int, pieces: list):
        self.partition, self.pieces = partition, pieces


class MessageLogReader(DataSourceStreamReader):
    def __init__(self, root: str, start: str):
        self.root, self.start = root.rstrip("/"), start

    def _head(self) -> dict:
        import pyarrow.fs as fs

        files, path = _file_system(f"{self.root}/_log")
        found = [f.path for f in files.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".json")]
        if not found:
            return {"segments": [], "next": {}}
        with files.open_input_stream(max(found)) as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        head = self._head()["next"]
        if self.start == "latest":
            return head
        if self.start == "earliest":
            return dict.fromkeys(head, 0)
        return {**dict.fromkeys(head, 0), **{str(p): int(n) for p, n in json.loads(self.start).items()}}

    def latestOffset(self) -> dict:
        return self._head()["next"]

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """One task for each partition with news: the pieces of segments that it reads."""
        out = []
        for p, last in sorted(end.items()):
            first = start.get(p, 0)
            pieces = []
            for segment, sizes in self._head()["segments"]:
                base, n = sizes.get(p, (0, 0))
                low, high = max(first, base), min(last, base + n)
                if low < high:
                    pieces.append((segment, base, low - base, high - base))
            if pieces:
                out.append(_Range(int(p), pieces))
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        import pyarrow.dataset as ds

        for segment, base, low, high in partition.pieces:
            files, path = _file_system(f"{self.root}/segment={segment}/partition={partition.partition}")
            rows = ds.dataset(path, filesystem=files, format="parquet").to_batches(
                columns=["place", "value", "ts"], filter=(ds.field("place") >= low) & (ds.field("place") < high))
            for batch in rows:
                for place, value, ts in zip(*(batch.column(c).to_pylist() for c in ("place", "value", "ts")), strict=True):
                    yield value, ts, str(partition.partition), 0, base + place

    def commit(self, end: dict) -> None:
        """Nothing to let go of: the table keeps all messages."""


class MessageLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return MessageLogReader(self.options["path"], self.options.get("startingoffsets", "latest"))


def read_message_log(spark: SparkSession, root: str, starting_offsets: str | dict = "latest") -> DataFrame:
    """The stream of a message table, in the columns of ``read_topic_stream``.
    ``starting_offsets``: ``earliest``, ``latest``, or {partition: offset}."""
    if isinstance(starting_offsets, dict):
        starting_offsets = json.dumps(starting_offsets)
    elif starting_offsets not in ("earliest", "latest"):
        raise ValueError("starting_offsets must be earliest, latest or offsets by partition")
    spark.dataSource.register(MessageLogSource)
    return spark.readStream.format(FORMAT).option("startingOffsets", starting_offsets).load(root)


def committed_offsets(spark: SparkSession, checkpoint: str) -> dict[str, int]:
    """The offsets after the last committed batch of a query over one message
    table, from its checkpoint."""
    commits = [int(n) for n in _names(spark, f"{checkpoint.rstrip('/')}/commits") if n.isdigit()]
    if not commits:
        return {}
    lines = spark.read.text(f"{checkpoint.rstrip('/')}/offsets/{max(commits)}", wholetext=True).first()[0].splitlines()
    return json.loads(lines[-1])


def _names(spark: SparkSession, path: str) -> list[str]:
    from orderpulse.session import list_files

    return [name for name, _ in list_files(spark, path)]
