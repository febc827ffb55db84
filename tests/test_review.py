"""The in-row review: every rule fires and is absent, and nothing shuffles."""
from kestrel.operators import review as RV

MAP = "## 8) Evidence References\n| [1] | EV-0123456789 | a |\n | [2] | EV-aaaaaaaaaa | b |\n| [1] | EV-bbbbbbbbbb | later |\n"
HEAD = "## 1) Executive Summary\n"
STAT = "### Statistical Questions Evaluated\n"
LIMITS = "## 6) Limitations\nSmall.\n### Statistical Limitations\n"
OWN = [("EV-0123456789", "tables/a.csv"), ("EV-aaaaaaaaaa", "statistics/t.json"), ("EV-bbbbbbbbbb", "x")]


def run(spark, text, evidence=OWN):
    df = spark.createDataFrame([(7, text, evidence, 1)], "id int, text string, evidence array<struct<id:string,artifact_path:string>>, t int")
    return RV.review_reports(df, "id", "text", "evidence").first()


def test_rules(spark):
    cases = {
        HEAD + "Up 5 [2].\n" + LIMITS + MAP: ("pass", []),
        "": ("fail", ["empty_report", "no_evidence"]),
        HEAD + "Fine.\n": ("warn", ["no_evidence"]),
        HEAD + "Up 5 [2] and [9], [3].\n" + LIMITS + MAP: ("fail", ["unmapped_citations"]),
        HEAD + "Up 5.\n" + LIMITS + MAP: ("fail", ["uncited_numbers"]),
        HEAD + "| 5 | table |\n2024-x item-7 x9\n".replace("2024-x ", "") + LIMITS + MAP: ("pass", []),
        "## 3) Other\nUp 5.\n" + LIMITS + MAP: ("pass", []),
        HEAD + "Up [[EV:EV-cccccccccc]] 5.\n": ("fail", ["missing_evidence"]),
        HEAD + "Ok [2].\n" + MAP: ("fail", ["no_limitations", "no_statistical_limitations"]),
        HEAD + "Ok [2].\n## 6) Limitations\nfew\n" + MAP: ("warn", ["no_statistical_limitations"]),
        HEAD + "A significant lift [2].\n" + LIMITS + MAP: ("fail", ["unsupported_significance"]),
        HEAD + "A significant lift, p = 0.01 [2].\n### Confidence Intervals\n### Effect Sizes\n" + LIMITS + MAP: ("pass", []),
        HEAD + "It caused growth.\n" + STAT + LIMITS + "[[EV-0123456789]]": ("fail", ["causal_wording"]),
        HEAD + "Business Question: what causes growth?\n" + STAT + LIMITS + "[[EV-0123456789]]": ("pass", []),
        HEAD + "It caused growth.\n[[EV-0123456789]]": ("pass", []),
        HEAD + "Up 5 [1].\r\n## 9) Evidence References\r\n| [1] | EV-0123456789 |": ("pass", []),
    }
    for text, (verdict, rules) in cases.items():
        r = run(spark, text)
        assert (r["verdict"], r["rules"]) == (verdict, rules), text
    r = run(spark, HEAD + "Up 5 [9] [3].\n" + MAP, [])
    assert r["unmapped_citations"] == [3, 9] and r["missing_evidence"] == ["EV-bbbbbbbbbb", "EV-aaaaaaaaaa"]
    assert r["uncited_lines"] == ["Up 5 [9] [3]."]


def test_nulls_and_long(spark):
    df = spark.createDataFrame([(1, None), (None, HEAD + "Up 5 [1].\n" * 20000 + MAP), (2, " \n ")], "id int, text string")
    got = {r["id"]: r for r in RV.review_reports(df, "id", "text").collect()}
    assert got[1]["rules"] == got[2]["rules"] == ["empty_report", "no_evidence"] and got[None]["verdict"] == "pass"
    assert RV.review_reports(df.where("false"), "id", "text").count() == 0


def test_no_exchange(spark):
    df = spark.createDataFrame([(1, HEAD)], "id int, text string")
    plan = RV.review_reports(df, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Window", "Join", "Generate"))
