"""The cascade's order, and columns that carry an operator's own names."""

from pyspark.sql import functions as F

from gridloom.llm import near_copies, quality_rules


def test_the_order_of_rules_is_the_same_each_time(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = [[r.name for r in quality_rules.order_for(docs, (*quality_rules.BASE, *quality_rules.RULES))] for _ in range(5)]
    assert all(f == found[0] for f in found) and sorted(found[0]) == sorted(r.name for r in (*quality_rules.BASE, *quality_rules.RULES))
    assert found[0].index("few_words") < found[0].index("repeats")


def test_dear_rules_come_last_where_none_rejects(spark):
    sample = spark.createDataFrame([("a plain text of some words " * 9,)], "text string")
    order = [r.name for r in quality_rules.ordered((*quality_rules.STAGE_BASE, *quality_rules.RULES), sample)]
    assert set(order[:2]) == {"repeats", "no_words"} and order[0] == "repeats"  # the text repeats itself, the rest goes by cost
    assert quality_rules.ordered(quality_rules.RULES, sample.where("false"))


def test_key_names_of_the_input_stay_as_they_are(spark):
    rows = spark.createDataFrame([(1, "a b c d e f g", 7, 8), (2, "a b c d e f g", 9, 10), (3, "x y z v w q r", 11, 12)], "doc_id long, text string, _k1 long, _K2 long").withColumn("_k2_", F.lit(5))
    got = near_copies.one_of_each(rows)
    assert got.columns == rows.columns and sorted(map(tuple, got.collect())) == [(1, "a b c d e f g", 7, 8, 5), (3, "x y z v w q r", 11, 12, 5)]
