"""Merged metadata, artifact types, upserts with ties, runs with artifacts."""
import json
import random

from pyspark.sql import functions as F

from kestrel.operators import ledger as LG

R = random.Random(8)


def value(depth):
    kind = R.random()
    if depth and kind < 0.45:
        return {R.choice("abc"): value(depth - 1) for _ in range(R.randint(0, 3))}
    return R.choice([1, "x", None, True, [1, {"a": 2}], 2.5])


def merged(rows, deep):
    """Sequential: the reference's dict.update, or key by key."""
    out = {}

    def put(into, new):
        for k, v in new.items():
            if deep and isinstance(v, dict):
                if not isinstance(into.get(k), dict):
                    into[k] = {}
                put(into[k], v)
            else:
                into[k] = v
    for run, _, _, text in sorted((r for r in rows), key=lambda r: (r[1], r[2])):
        try:
            doc = json.loads(text) if text else None
        except ValueError:
            doc = None
        if isinstance(doc, dict):
            put(out.setdefault(run, {}), doc)

    def leaves(run, at, doc):
        for k, v in doc.items():
            if deep and isinstance(v, dict):
                yield from leaves(run, f"{at}{k}.", v)
            else:
                yield run, f"{at}{k}", json.dumps(v, sort_keys=True)
    return {x for run, doc in out.items() for x in leaves(run, "", doc)}


def test_metadata(spark):
    rows = [(R.choice("pq"), R.randint(0, 20), i, json.dumps({R.choice("abc"): value(2) for _ in range(R.randint(0, 3))})) for i in range(60)]
    rows += [("p", 5, 100, "[1]"), ("p", 5, 101, "no json"), ("p", 5, 102, None), ("z", 1, 103, "{}")]
    df = spark.createDataFrame(rows, "run string, ts int, id int, meta string")
    for deep in (False, True):
        got = {(r["run"], r["key"], json.dumps(json.loads(r["value"]), sort_keys=True))
               for r in LG.run_metadata(df, "run", "ts", "meta", "id", deep).collect()}
        assert got == merged(rows, deep)
    assert LG.run_metadata(df.where("false"), "run", "ts", "meta", "id").count() == 0


def test_artifacts(spark):
    paths = {"charts/x": "chart", "Charts/Final_Report.md": "chart", "a/qa_1.PNG": "chart", "qa_1.json": "json", "r/final_report.md": "markdown_report",
             "cleaned.csv": "cleaned_csv", "x/data_profile.json": "profile_json", "quality_report.json": "validation_json", "q.sql": "sql_query",
             "a.csv": "csv", "b.md": "markdown", "c.txt": "text", "d.parquet": "artifact", "": "artifact", "my_cleaned.csv": "csv", None: None}
    df = spark.createDataFrame([(p, t) for p, t in paths.items()], "p string, t string")
    assert all(r["a"] == r["t"] for r in df.select("p", "t", LG.artifact_type(F.col("p")).alias("a")).collect())
    rows = [(1, "a", 5, 1, "x"), (1, "a", 5, 2, "y"), (1, "a", 4, 9, "z"), (2, "b", 1, 1, "u"), (2, "b", 1, 1, "v")]
    for order in (rows, rows[::-1]):
        art = spark.createDataFrame(order, "run int, path string, ts int, id int, v string")
        got = {(r["run"], r["path"]): (r["v"], r["n_writes"]) for r in LG.artifact_upsert(art, "run", "path", "ts", "id").collect()}
        assert got == {(1, "a"): ("y", 3), (2, "b"): ("v", 2)}
    runs = spark.createDataFrame([(1, "ann", 3), (3, "ann", 4), (2, "bob", 5)], "run int, user string, ts int")
    got = [tuple(r) for r in LG.run_details(runs, art.select("run", "path", "ts"), "run", "user", "ann").collect()]
    assert sorted(got, key=repr) == sorted([(1, "ann", 3, "a", 5), (1, "ann", 3, "a", 5), (1, "ann", 3, "a", 4), (3, "ann", 4, None, None)], key=repr)
