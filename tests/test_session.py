"""Scratch locations come from the session's checkpoint folder."""

from orderpulse.session import checkpoint_root, delete_path, list_dirs, path_exists, scratch_path


def test_scratch_paths_live_under_the_checkpoint_root(spark):
    root = checkpoint_root(spark)
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        assert root == conf.rstrip("/")
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(root + "/x-") and b.startswith(root + "/x-")


def test_file_system_helpers(spark):
    base = scratch_path(spark, "fs")
    spark.range(3).write.parquet(f"{base}/a=1")
    spark.range(3).write.parquet(f"{base}/a=2")
    assert path_exists(spark, base)
    assert sorted(n for n, _ in list_dirs(spark, base)) == ["a=1", "a=2"]
    delete_path(spark, f"{base}/a=1")
    assert sorted(n for n, _ in list_dirs(spark, base)) == ["a=2"]
    assert list_dirs(spark, f"{base}/missing") == []
