"""The bit table before the anti joins loses no wanted row."""
from pyspark.sql import functions as F

from kestrel.llm import native


def test_sift(spark, monkeypatch):
    rows = spark.range(2000).select("id", F.xxhash64("id").alias("h"), F.lit(1).alias("_x"))
    for bits in (23, 10):                       # a full table sends more rows on, never fewer
        monkeypatch.setattr(native, "SIEVE_BITS", bits)
        keys = spark.range(0, 2000, 7).select(F.xxhash64("id").alias("k"))
        others, suspects = native.sift(rows, "h", keys, "k")
        assert others.columns == suspects.columns == rows.columns
        sure, maybe = {r["id"] for r in others.collect()}, {r["id"] for r in suspects.collect()}
        assert not sure & maybe and sure | maybe == set(range(2000)) and not any(i % 7 == 0 for i in sure)
        assert len(maybe) < 400 if bits == 23 else len(maybe) >= 286
        plan = suspects.join(keys, suspects.h == keys.k, "left_anti")._jdf.queryExecution().optimizedPlan().toString()
        assert "Cross" not in plan
    monkeypatch.setattr(native, "SIEVE_BITS", 23)
    others, suspects = native.sift(rows, "h", keys.where("false"), "k")
    assert others.count() == 2000 and suspects.count() == 0


def test_any_type_and_back(spark):
    df = spark.sql("""SELECT map('a', array(map(1, 2D)), 'b', null) AS m, named_struct('x y', map('k', 1), 'z.w', null) AS s,
                      array(named_struct('p', map('q', date'2024-01-01'))) AS a, cast(null AS map<string,int>) AS n, 5 AS i""")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    packed = df.select(*[native.plain(df[c], k).alias(c) for c, k in kinds.items()])
    assert "map" not in packed.schema.simpleString()
    back = packed.select(*[native.unplain(packed[c], k).alias(c) for c, k in kinds.items()])
    assert back.collect() == df.collect() and [f.dataType.simpleString() for f in back.schema] == [k.simpleString() for k in kinds.values()]
