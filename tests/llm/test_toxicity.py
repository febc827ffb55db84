"""Toxicity is learned from all labelled rows, in shards."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from kestrel.llm import toxicity


def test_rows_beyond_any_first_thousands_are_learned_from(spark):
    ids = spark.range(18000).where(~toxicity.held_out("id")).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    rank = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id")))
    word = F.when(F.col("toxic") == 0, "fine").otherwise(F.when(rank <= 4000, "vile").otherwise("grobian"))
    docs = ids.select("doc_id", F.concat(F.lit("alpha beta "), word).alias("text"), F.lit("en").alias("lang"))
    asked = spark.createDataFrame([(2_000_000, "alpha beta grobian", "en"), (2_000_001, "alpha beta fine", "en")], docs.schema)
    got = toxicity.toxicity(docs.unionByName(asked), ids).where("doc_id >= 2000000").orderBy("doc_id").collect()
    assert [r["predicted"] for r in got] == [1, 0]


def test_the_order_and_partitions_of_the_rows_do_not_show(spark):
    rows = [(i, f"w{i % 13} w{i % 7} " + ("vile" if i % 3 == 0 else "fine"), "de" if i % 2 else "en") for i in range(200)]
    docs = spark.createDataFrame([*rows, *rows[:20]], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")
    assert toxicity.learnable(docs, labels).agg(F.sum("n")).first()[0] == docs.where(~toxicity.held_out("doc_id")).count()
    one, two = (toxicity.train(d, lab, shard_rows=30) for d, lab in ((docs.coalesce(1), labels), (docs.repartition(7).orderBy(F.desc("text")), labels.repartition(3))))
    assert all(np.array_equal(one.net.p[k], two.net.p[k]) for k in one.net.p)
    assert one.shift == two.shift and one.by_lang == two.by_lang and set(one.by_lang) == {"de", "en"}


def test_a_state_is_the_whole_net():
    net = toxicity.Net(3)
    net.m["b"][1] += 2
    net.sq[5] = 4
    again = toxicity.Net(4).restore(net.state(), 9)
    assert again.t == 9 and np.array_equal(again.state(), net.state()) and all(np.array_equal(again.p[k], net.p[k]) for k in net.p)


def test_best_threshold_counts_rows():
    value, hits, n = np.array([0.0, 3.0, 1.0, 2.0]), np.array([0, 5, 0, 1]), np.array([9, 5, 4, 1])
    assert toxicity.best_threshold(value, hits, n) == 1.5
    assert toxicity.best_threshold(value, n, n) == toxicity.best_threshold(value[:0], n[:0], n[:0]) == 0.0
