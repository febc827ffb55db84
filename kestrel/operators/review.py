"""AUD1-AUD3 inside the row: the whole review of a report as one expression.

Sections are cut out of the text, the citation map is read from its section
and the lines of the key sections are judged against it, all with functions
of one row: nothing is exploded, joined or shuffled, so a table of any
number of reports is reviewed in its scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.operators.audit import (CAUSAL, CI_HEADING, CITE, CITE_MAP_LINE, EFFECT_HEADING, EV_TAG, KEY_SECTIONS, LINE_BREAK,
                                     NUMBER, P_VALUE, REFERENCE_SECTIONS, SIGNIFICANCE, _strip)

# The rules, in the order in which they are reported, and what
# a report that breaks one gets; headings and texts that rules look for.
RULES = (
    ("empty_report", "fail"),
    ("no_evidence", "warn"),
    ("unmapped_citations", "fail"),
    ("missing_evidence", "fail"),
    ("uncited_numbers", "fail"),
    ("no_limitations", "fail"),
    ("no_statistical_limitations", "warn"),
    ("unsupported_significance", "fail"),
    ("causal_wording", "fail"),
)
LIMITATIONS = "6) Limitations"
STATISTICAL_LIMITATIONS = "### Statistical Limitations"
STATISTICAL_QUESTIONS = "### Statistical Questions Evaluated"
STATISTICS_PATH = "statistics/"
QUESTION_LINE = "business question"


def section(text: F.Column, heading: str) -> F.Column:
    """What follows the first ``## heading`` up to the next ``## `` at a
    line's start ('' without it)."""
    return F.regexp_extract(text, rf"(?s)## \Q{heading}\E(.*?)(?:\n## |\z)", 1)


def _lines(text: F.Column) -> F.Column:
    return F.split(text, LINE_BREAK)


def _numbers(text: F.Column) -> F.Column:
    return F.transform(F.regexp_extract_all(text, F.lit(CITE), 1), lambda n: n.cast("int"))


def review_reports(reports: DataFrame, id_col: str, text_col: str, evidence_col: str | None = None) -> DataFrame:
    """One row per report: id, verdict (``pass``, ``warn``, ``fail``), rules
    (those broken, in the order of ``RULES``), unmapped_citations (numbers),
    missing_evidence (ids), uncited_lines.

    ``evidence_col`` holds the report's evidence as
    array<struct<id, artifact_path>>; without it no reference can be
    missing. The last line of the citation map that defines a number counts.
    Rules on limitations, significance and causal wording apply to reports
    with statistical evidence: a referenced artifact under ``statistics/``,
    or the heading of statistical questions. Lines that state the business
    question may use causal words. Null and blank reports break
    ``empty_report`` and ``no_evidence``."""
    src = reports.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"),
                         (F.col(evidence_col) if evidence_col else F.lit(None).cast("array<struct<id:string,artifact_path:string>>")).alias("ev"))
    t = F.col("t")
    first, second = (section(t, h) for h in REFERENCE_SECTIONS)
    table = F.filter(F.transform(_lines(F.when(first != "", first).otherwise(second)), _strip), lambda x: x.rlike(CITE_MAP_LINE))
    src = src.withColumn("map", F.transform(table, lambda x: F.struct(F.regexp_extract(x, CITE_MAP_LINE, 1).cast("int").alias("n"),
                                                                      F.regexp_extract(x, CITE_MAP_LINE, 2).alias("ev"))))
    src = src.withColumn("cited", F.array_distinct(F.col("map.n")))
    last = F.transform("cited", lambda n: F.element_at(F.filter("map", lambda m: m["n"] == n), -1)["ev"])
    src = src.withColumn("tags", F.regexp_extract_all(t, F.lit(EV_TAG), 1)).withColumn("refs", F.concat("tags", last))
    known = F.coalesce(F.col("ev.id"), F.array().cast("array<string>"))
    key = F.concat_ws("\n", *[section(t, h) for h in KEY_SECTIONS])
    src = src.withColumn("key", _lines(key)).withColumn("unmapped", F.array_sort(F.array_except(_numbers(t), F.col("cited"))))
    src = src.withColumn("missing", F.array_except("refs", known) if evidence_col else F.array().cast("array<string>"))

    def uncited(x):
        tagged = x.contains("[[EV:") | x.contains("[[EV-")
        return (x != "") & ~x.startswith("|") & x.rlike(NUMBER) & ~tagged & ~F.arrays_overlap(_numbers(x), F.col("cited"))
    src = src.withColumn("bare", F.filter(F.transform("key", _strip), uncited))
    used = F.coalesce(F.exists("ev", lambda e: e["artifact_path"].startswith(STATISTICS_PATH) & F.array_contains(F.col("refs"), e["id"])), F.lit(False))
    src = src.withColumn("stat", used | t.contains(STATISTICAL_QUESTIONS))
    claims = F.array_join(F.filter("key", lambda x: ~F.lower(x).contains(QUESTION_LINE)), "\n")
    supported = t.rlike(P_VALUE) & t.contains(CI_HEADING) & t.contains(EFFECT_HEADING)
    stat = F.col("stat")
    broken = {
        "empty_report": _strip(t) == "",
        "no_evidence": (F.size("tags") == 0) & (F.size("map") == 0),
        "unmapped_citations": F.size("unmapped") > 0,
        "missing_evidence": F.size("missing") > 0,
        "uncited_numbers": F.size("bare") > 0,
        "no_limitations": stat & (_strip(section(t, LIMITATIONS)) == ""),
        "no_statistical_limitations": stat & ~t.contains(STATISTICAL_LIMITATIONS),
        "unsupported_significance": stat & t.rlike(SIGNIFICANCE) & ~supported,
        "causal_wording": stat & claims.rlike(CAUSAL),
    }
    src = src.withColumn("rules", F.filter(F.array(*[F.when(broken[r], F.lit(r)) for r, _ in RULES]), lambda r: r.isNotNull()))
    fails = F.array(*[F.lit(r) for r, v in RULES if v == "fail"])
    verdict = F.when(F.arrays_overlap("rules", fails), "fail").when(F.size("rules") > 0, "warn").otherwise("pass")
    return src.select(F.col("id").alias(id_col), verdict.alias("verdict"), "rules", F.col("unmapped").alias("unmapped_citations"),
                      F.col("missing").alias("missing_evidence"), F.col("bare").alias("uncited_lines"))
