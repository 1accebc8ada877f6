"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderpulse.session import checkpoint_root, delete_path, scratch_path

#: shuffle files end with their query (Spark 4.1; without effect before)
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage through a compressed table in the shared checkpoint
    folder, so that later jobs neither recompute ``df`` nor lose it with an
    executor."""
    return _written(df, name)[0]


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    checkpoint_root(spark)
    path = scratch_path(spark, f"llm-{name}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Materialized tables of one job, which end with it or before: ``keep``
    writes one, ``drop`` deletes the files of those that nothing reads any
    more. The shuffle files of a table go as soon as it is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            table, path = _written(df, name)
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        self.paths[id(table)] = table, path
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            delete_path(self.spark, self.paths.pop(id(table))[1])

    def drop_all(self) -> None:
        self.drop(*[table for table, _ in list(self.paths.values())])


def materialize_bucketed(df: DataFrame, name: str, key: str) -> tuple[DataFrame, Callable[[], None]]:
    """Like ``materialize``, in files bucketed by ``key``: later joins and
    groups by the key read them without a shuffle of this side. The second
    value removes the table once nothing reads it any more."""
    spark = df.sparkSession
    checkpoint_root(spark)
    path = scratch_path(spark, f"llm-{name}")
    called = path.rsplit("/", 1)[1].replace("-", "_")
    (df.write.option("compression", "zstd").option("path", path)
     .bucketBy(shuffle_partitions(spark), key).saveAsTable(called))

    def drop() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {called}")
        delete_path(spark, path)

    return spark.table(called), drop


def isolate(docs: DataFrame, **roles: str) -> DataFrame:
    """The columns that an operator reads under its own names, and all other
    columns in the struct ``rest``, so that no name of theirs can clash."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in roles.values()]
    rest = F.struct(*others) if others else F.struct(F.lit(None).cast("int").alias("none"))
    return docs.select(*[F.col(f"`{c}`").alias(r) for r, c in roles.items()], rest.alias("rest"))


def restore(done: DataFrame, docs: DataFrame, roles: dict[str, str], drop: tuple[str, ...] = (),
            **added: Column) -> DataFrame:
    """The columns of ``docs`` again (without ``drop``), then ``added``, which
    replace columns of the same name."""
    role_of = {c: r for r, c in roles.items()}
    back = [F.col(role_of[c]).alias(c) if c in role_of else F.col("rest").getField(c).alias(c)
            for c in docs.columns if c not in added and c not in drop]
    return done.select(*back, *[v.alias(n) for n, v in added.items()])


def spread(small: DataFrame) -> DataFrame:
    """Gives the small side of a skewed join an exchange of its own, so that
    both sides of the join are shuffle stages, which adaptive execution can
    split when one key holds many rows."""
    return small.repartition(shuffle_partitions(small.sparkSession))


def salt(*columns: Column | str) -> Column:
    """A 64-bit row hash for dealing rows out evenly."""
    return F.xxhash64(*columns)


def rank_within(df: DataFrame, key: str, order: list[str], buckets: int, out: str, bucket: Column | None = None) -> DataFrame:
    """Number the rows of each ``key`` 0, 1, 2, … without gathering a key in
    one task: rows are dealt into ``buckets`` by a hash of ``order``,
    numbered inside (key, bucket), and shifted by the sizes of the key's
    earlier buckets. With ``bucket``, a number that never falls along
    ``order``, the numbers follow ``order`` over the whole key. ``df`` must
    give the same rows when read again."""
    dealt = F.pmod(salt(*order), F.lit(buckets)) if bucket is None else bucket
    # one struct, in which nulls are equal, is the key of the window and of the join: rows are shuffled once
    spread = df.withColumn("_rg", F.struct(F.col(key).alias("k"), dealt.alias("b")))
    sizes = spread.groupBy("_rg").agg(F.count(F.lit(1)).alias("_rn"))
    before = Window.partitionBy("_rg.k").orderBy("_rg.b").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(F.col("_rg").alias("_rs"), F.coalesce(F.sum("_rn").over(before), F.lit(0)).alias("_r0"))
    inside = Window.partitionBy("_rg").orderBy(*order)
    numbered = spread.withColumn("_ri", F.row_number().over(inside) - 1)
    joined = numbered.join(shift, F.col("_rg") == F.col("_rs"))
    return joined.withColumn(out, F.col("_r0") + F.col("_ri")).drop("_rg", "_rs", "_r0", "_ri")
