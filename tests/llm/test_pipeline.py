"""Each stage against brute force on its own input."""
import corpus_pipeline as P
from test_operators import SF_SMALL, brute_contamination, brute_fp, brute_removal, rows


def test_stages(spark, tmp_path):
    docs = P._table(spark, SF_SMALL, "documents")
    items = [(r["item_id"], r["text"]) for r in P._table(spark, SF_SMALL, "benchmark").collect()]
    columns, held = docs.columns, {}
    for name, stage in P.STAGES:
        before = rows(docs)
        stage(spark, docs, SF_SMALL).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "packing":
            assert {r["doc_id"] for r in docs.collect()} == {d for d, _ in before}
            break
        assert docs.columns == columns
        held[name] = after = dict(rows(docs))
        if name == "near_dedup":
            fp = {d: brute_fp(t) for d, t in before}
            root = {d: d for d in fp}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x
            for a in fp:
                for b in fp:
                    if a < b and (fp[a] ^ fp[b]).bit_count() <= 2 and find(a) != find(b):
                        root[max(find(a), find(b))] = min(find(a), find(b))
            assert set(after) == {d for d in fp if find(d) == d}
        if name == "substring_dedup":
            for d, n, gone, _ in brute_removal(before):
                assert (after[d] == dict(before)[d]) if not gone else len(after[d].split()) == n - gone
        if name == "decontamination":
            assert set(after) == {r[0] for r in brute_contamination(before, items) if not r[5]}


def odd_docs(spark):
    """Rows whose other columns have the operators' internal names and any
    type; null and repeated ids, repeated rows, null, blank and long texts,
    copies, a benchmark passage."""
    import json
    item = rows_of_items(spark)[0][1]
    base = " ".join(f"w{i} v{i % 13}" for i in range(60))
    texts = [(1, base), (2, base), (2, base), (None, base), (None, "only one without id " + " ".join(map(str, range(30)))), (3, None), (4, ""), (5, " \n "),
             (6, item), (None, item), (6, "a row that shares an id with a contaminated one " + " ".join(f"x{i}" for i in range(40))),
             (7, " ".join(f"y{i}" for i in range(40)) + " " + base), (8, " ".join(f"z{i % 50}" for i in range(20000))),
             (9, " ".join(f"q{i}" for i in range(25))), (9, " ".join(f"r{i}" for i in range(25)))]
    names = ["_d", "_t1", "_t2", "_again", "_row", "_bad", "_text", "_removed", "_x", "_xd", "_xh", "kind", "part", "kept", "th", "fp", "c0"]
    rows = [(d, t, "en", "s", len(t or ""), *range(len(names)), {"k": i}, (i, {"m": [i]}), [({"z": 1.5},)], json.dumps({"a": i}).encode())
            for i, (d, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " +
                                 ", ".join(f"{n} int" for n in names) +
                                 ", a_map map<string,int>, a_struct struct<`a b`:int, `c.d`:map<string,array<int>>>, "
                                 "a_list array<struct<`e f`:map<string,double>>>, raw binary")


def rows_of_items(spark):
    return [(r["item_id"], r["text"]) for r in P._table(spark, SF_SMALL, "benchmark").collect()]


def test_odd_columns(spark, tmp_path):
    """Filtering stages on odd rows: other columns come back untouched, and
    each row is judged by its own text."""
    docs = odd_docs(spark)
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    before = docs.collect()
    stages = dict(P.STAGES)
    out = stages["near_dedup"](spark, docs, SF_SMALL)
    assert out.columns == docs.columns and out.schema == docs.schema
    left = sorted((repr(r["doc_id"]), r["text"] or "") for r in out.collect())
    fps = {}
    for r in before:
        fps.setdefault(brute_fp(r["text"]), []).append(r)
    assert len(left) == len(fps) and (repr(1), before[0]["text"]) in left
    assert (repr(None), before[4]["text"]) in left and sum(t == before[0]["text"] for _, t in left) == 1
    out = stages["decontamination"](spark, docs, SF_SMALL)
    assert out.columns == docs.columns
    bad = {i for i, r in enumerate(brute_contamination([(r["doc_id"], r["text"]) for r in before], rows_of_items(spark))) if r[5]}
    key = lambda r: (repr(r["doc_id"]), r["text"] or "", r["a_map"]["k"])
    assert sorted(map(key, out.collect())) == sorted(key(r) for i, r in enumerate(before) if i not in bad) and len(bad) == 2
    out = stages["substring_dedup"](spark, docs, SF_SMALL)
    assert out.columns == docs.columns and [f.dataType.simpleString() for f in out.schema] == [f.dataType.simpleString() for f in docs.schema]
    after = {r["a_map"]["k"]: r for r in out.collect()}
    assert len(after) == len(before)
    for i, r in enumerate(before):
        assert all(after[i][c] == r[c] for c in others)
    out.write.parquet(f"{tmp_path}/x")
    for name in ("near_dedup", "decontamination", "substring_dedup"):
        assert stages[name](spark, docs.where("false"), SF_SMALL).count() == 0


def test_batches_are_bounded(spark):
    P.run(spark, SF_SMALL)
    reader, arrow = "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxBytesPerBatch"
    assert int(spark.conf.get(reader)) <= 512 and spark.conf.get(arrow) == "1m"
    spark.conf.set(reader, "100")
    P._prepare(spark)
    assert spark.conf.get(reader) == "100"       # a lower one stays
    spark.conf.unset(reader)
