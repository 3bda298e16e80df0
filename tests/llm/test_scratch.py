"""What a written table leaves behind: no shuffle files, no long plan strings in the driver."""

import time

from pyspark.sql import functions as F

from framelake.llm import toxicity
from framelake.llm.common import written


def shuffle_files(spark) -> set[str]:
    names = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {n for n in names if "/shuffle_" in n}


def test_shuffle_files_go_with_the_query_that_made_them(spark):
    before = shuffle_files(spark)
    conf = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    rows = spark.range(10_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.sum("id").alias("s"))
    found = written(rows.join(rows.withColumnRenamed("s", "t"), "k"), "test-shuffles")
    end = time.time() + 20
    while shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert found.count() == 1000 and rows.count() == 1000  # the rows can be asked for again
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == conf


def test_the_driver_keeps_no_long_plans(spark):
    docs = spark.createDataFrame([(i, "you fool" if i % 3 else "a kind word") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id long, toxic int")
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    known = store.executionsCount()
    assert toxicity.fit(docs, labels).compares
    bus.waitUntilEmpty(30_000)
    new = store.executionsList().drop(known)
    plans = [new.apply(i).physicalPlanDescription() for i in range(new.size()) if "parquet at" in new.apply(i).description()]
    assert plans and max(map(len, plans)) < 10_000
