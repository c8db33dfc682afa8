from pyspark.sql import functions as F

from mnemora.runtime import hot_keys, lookup_join


def test_lookup_join_with_a_hot_key_keeps_all_rows(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit(7)).when(F.col("id") == 0, None).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    assert hot_keys(left, "k", least=100) == [7]
    for how in ("inner", "left"):
        got = sorted(map(str, lookup_join(left, right, "k", how, least=100).select("k", "v", "w").collect()))
        assert got == sorted(map(str, left.join(right, "k", how).select("k", "v", "w").collect()))


def test_no_key_is_hot_in_few_rows(spark):
    assert hot_keys(spark.range(10).select(F.lit(1).alias("k")), "k") == []
