"""What the reviewer's third round found, second part: disk of stored tables."""

import os

from pyspark.sql import functions as F

from hubbub.plans import store


def test_shuffles_of_stored_tables_are_removed(spark):
    """What was shuffled for a table goes when it is written; other queries' shuffles and settings stay."""

    def shuffled() -> set[str]:
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(blocks.size()) if (name := os.path.basename(blocks.apply(i).getPath())).startswith("shuffle_")}

    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    rows.collect()
    before, setting = shuffled(), spark.conf.get(store._CLEANUP, None)
    assert sorted(r.n for r in store.stored(rows, "counts").collect()) == [142] + [143] * 6
    assert before and shuffled() <= before
    assert spark.conf.get(store._CLEANUP, None) == setting
