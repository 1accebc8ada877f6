"""The runnable jobs chained end to end on message folders."""

from orderpulse import jobs
from orderpulse.schemas import CATEGORY_STATS
from orderpulse.sinks.tables import KeyedTable, VersionedTable


def test_publish_count_reload_upsert_chain(spark, scratch, capsys):
    from orderpulse.session import local_path

    base = scratch("jobs")
    csv = f"{base}/items.csv"
    import os
    os.makedirs(local_path(csv))
    with open(local_path(csv) + "/part-0.csv", "w", encoding="utf-8") as fh:
        fh.write("item_id,Category,price\n1,A,1\n2,\u3000B\t,2\n3,,3\n4,A,4\n5\n")
    jobs.main(["publish", "--csv", csv, "--out", f"{base}/msgs"], spark)
    jobs.main(["count", "--messages", f"{base}/msgs", "--checkpoint", f"{base}/ck1",
               "--table", f"{base}/stats", "--results", f"{base}/res", "--available-now",
               "--state-partitions", "2", "--console"], spark)
    stats = {r.category: r["count"] for r in VersionedTable(spark, f"{base}/stats").read().collect()}
    assert stats == {"A": 2, "B": 1}
    assert "-- batch 0" in capsys.readouterr().out
    jobs.main(["reload", "--messages", f"{base}/res", "--checkpoint", f"{base}/ck2",
               "--table", f"{base}/reloaded", "--available-now"], spark)
    assert {r.category: r["count"] for r in VersionedTable(spark, f"{base}/reloaded").read().collect()} == stats
    jobs.main(["append", "--messages", f"{base}/res", "--checkpoint", f"{base}/ck4", "--table", f"{base}/log",
               "--quarantine", f"{base}/bad", "--available-now", "--max-per-trigger", "1"], spark)
    assert {(r.Category, r["count"]) for r in spark.read.parquet(f"{base}/log").collect()} == {("A", 2), ("B", 1)}
    jobs.main(["listen", "--messages", f"{base}/res", "--checkpoint", f"{base}/ck5", "--available-now"], spark)
    assert '"Category":"B"' in capsys.readouterr().out
    jobs.main(["upsert", "--messages", f"{base}/res", "--checkpoint", f"{base}/ck3",
               "--table", f"{base}/keyed", "--available-now"], spark)
    assert {r.category: r["count"] for r in KeyedTable(spark, f"{base}/keyed", CATEGORY_STATS, "category").read().collect()} == stats


def test_kpis_job_prints(spark, scratch, capsys):
    from orderpulse.plans.io import export_order_items

    path = scratch("items")
    export_order_items(spark, "/root/testdata/sf0.001", path)
    jobs.main(["kpis", "--items", path], spark)
    out = capsys.readouterr().out
    assert "total_orders" in out and "Category" in out and "Working_Date" in out
    days = spark.read.option("header", True).csv(path).select("Working_Date").distinct().count()
    assert len(out.split("Working_Date\torders\n")[1].strip().split("\n")) == days     # every day


def test_publish_plain(spark, scratch):
    import os

    from orderpulse.session import local_path

    base = scratch("plain-job")
    os.makedirs(local_path(f"{base}/csv"))
    with open(local_path(f"{base}/csv") + "/part-0.csv", "w", encoding="utf-8") as fh:
        fh.write("a,b,c,d,e,f,g,h,i,gender\n1,2,3,4,5,6,7,8,9,F\n")
    jobs.main(["publish", "--csv", f"{base}/csv", "--out", f"{base}/sex", "--plain"], spark)
    assert [r.value for r in spark.read.text(f"{base}/sex").collect()] == ["F"]


def test_publish_strict_fails_on_bad_id(spark, scratch):
    import os

    import pytest

    from orderpulse.session import local_path

    base = scratch("strict")
    os.makedirs(local_path(f"{base}/csv"))
    with open(local_path(f"{base}/csv") + "/part-0.csv", "w", encoding="utf-8") as fh:
        fh.write("item_id,Category\n1,A\nx1,B\n")
    with pytest.raises(Exception, match="invalid item_id: x1"):
        jobs.main(["publish", "--csv", f"{base}/csv", "--out", f"{base}/strict-out", "--strict"], spark)
    jobs.main(["publish", "--csv", f"{base}/csv", "--out", f"{base}/lenient-out"], spark)
    sent = sorted(r.value for r in spark.read.text(f"{base}/lenient-out").collect())
    assert sent == ['{"Category":"B"}', '{"item_id":1,"Category":"A"}']
