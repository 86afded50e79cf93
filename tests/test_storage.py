"""What stored tables leave on disk."""

import time

from geomatch import storage


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {n for n in names if n.startswith("shuffle_")}


def test_shuffles_of_a_stored_table_go_when_it_is_written(spark):
    spark.conf.unset("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    before = shuffle_files(spark)
    # Held, so that nothing is collected as garbage.
    rows = spark.range(20000).selectExpr("id % 5000 as k", "id as v").groupBy("k").sum("v")
    table = storage.stored(rows, dense=True)
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert table.count() == 5000 and sorted(table.collect()) == sorted(rows.collect())
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert spark.conf.get("spark.sql.parquet.compression.codec") == "snappy"


def test_a_removed_table_is_gone(spark):
    path = storage.scratch(spark)
    files = spark._jvm.java.io.File(path.removeprefix("file:"))
    assert storage.stored(spark.range(3), path=path).count() == 3 and files.exists()
    storage.remove(spark, path)
    assert not files.exists()
