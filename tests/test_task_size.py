"""A task's share of a shuffle stays small however much is shuffled."""

from pyspark.sql import functions as F

from dossier.operators import identity


def test_partitions_are_merged_to_a_small_size(spark):
    # as on a large input: more is shuffled than the cores can hold at the merged size
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        refs = spark.range(1_000_000).select(
            F.col("id").alias("ref_id"), F.sha2(F.col("id").cast("string"), 256).alias("external_id"), F.lit("c").alias("connector_id"),
            F.lit(1).alias("subscription_id"), F.lit("seen").alias("status"), F.lit(True).alias("fetch_ok"),
        )
        outcome, _ = identity.manual_downloads(refs)
        # about 45 MB are shuffled: one partition before, when they were merged to 64 MB
        assert outcome.rdd.getNumPartitions() >= 3
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
