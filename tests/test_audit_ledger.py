import datetime as dt

from kestrel.operators import audit as AU
from kestrel.operators import ledger as LG

GOOD = """## 1) Executive Summary
Revenue grew to 8955 [1].
## 8) Evidence References
| [1] | EV-0123456789 | x |
"""
UNTAGGED = """## 1) Executive Summary
Revenue grew to 8955.
"""
MISSING = """## 1) Executive Summary
Revenue grew to 8955 [[EV:EV-aaaaaaaaaa]] and [2].
"""
SIG = "The lift is statistically significant (p-value 0.01)."
CAUSAL = "The campaign caused the lift."


def test_report_audits(spark):
    docs = spark.createDataFrame([(1, GOOD), (2, UNTAGGED), (3, MISSING), (4, SIG), (5, CAUSAL)], "id int, text string")
    unc = {r["id"]: r["n_uncited_lines"] for r in AU.uncited_claims(docs, "id", "text", AU.KEY_SECTIONS).collect()}
    assert unc == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0}
    ev = spark.createDataFrame([("EV-0123456789",)], "id string")
    refs = {(r["id"], r["kind"], r["ref"]) for r in AU.dangling_refs(docs, "id", "text", ev).collect()}
    assert refs == {(3, "unmapped_citation", "2"), (3, "missing_evidence", "EV-aaaaaaaaaa")}
    w = {r["id"]: r["verdict"] for r in AU.wording_flags(docs, "id", "text").collect()}
    assert w[4] == "fail" and w[5] == "fail" and w[1] == "pass"


def test_statement_audit(spark):
    stmts = spark.createDataFrame([(1, "SELECT 1 AS x;"), (2, "WITH t AS (SELECT 1) SELECT * FROM t"),
                                   (3, "DELETE FROM orders"), (4, "SELECT 1; DROP TABLE orders"),
                                   (5, "SELECT * FROM orders FOR UPDATE"), (6, "select a into b from c"),
                                   (7, "-- only a comment"), (8, "SELECT 'update' AS word")], "id int, q string")
    r = {x["id"]: (x["verdict"], x["rule"]) for x in AU.statement_audit(stmts, "id", "q").collect()}
    assert r[1] == ("accepted", None) and r[2] == ("accepted", None)
    assert r[3] == ("refused", "not_select") and r[4][1] == "multiple_statements"
    assert r[5][1] == "denied_keyword" or r[5][1] == "for_update"
    assert r[6][1] == "select_into" and r[7][1] == "empty"
    assert r[8] == ("refused", "denied_keyword")  # documented false positive


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "db postgres://alice:s3cret@host/db and Authorization: Bearer abc.def "
                                      "plus api_key=XYZ and OPENROUTER_API_KEY: k1")], "id int, text string")
    r = AU.redact_text(docs, "id", "text").collect()[0]
    assert "s3cret" not in r["redacted"] and "abc.def" not in r["redacted"] and "XYZ" not in r["redacted"]
    assert r["hits_url_credentials"] == 1 and r["hits_bearer_token"] == 1 and r["hits_api_key"] >= 1


def test_ledger(spark):
    t0 = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([
        (1, t0, "queued", None), (1, t0 + dt.timedelta(minutes=1), "running", None),
        (1, t0 + dt.timedelta(minutes=2), "failed", "boom"), (1, t0 + dt.timedelta(minutes=3), "completed", None),
        (2, t0, "queued", None), (2, t0 + dt.timedelta(minutes=5), "completed", None)],
        "run int, ts timestamp, status string, err string")
    tr = {(r["run"], r["from_status"], r["to_status"]): r["allowed"]
          for r in LG.run_transitions(ev, "run", "ts", "status").collect()}
    assert tr[(1, "failed", "completed")] is False and tr[(1, "queued", "running")] is True
    st = {r["run"]: r for r in LG.run_state(ev, "run", "ts", "status", "err").collect()}
    assert st[1]["status"] == "completed" and st[1]["last_error"] == "boom" and st[2]["started_at"] is None
    assert LG.artifact_type(__import__("pyspark.sql.functions", fromlist=["lit"]).lit("a/report.md")) is not None
