"""AUD1-AUD5: audits of text and SQL-statement tables.

The reference checks one report or one statement at a time; here every
rule is a column expression over a table of texts, so a whole corpus is
audited in one job (split -> posexplode lines -> rlike flags -> counts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Report-audit patterns (evidence tags, citations, numbers,
# citation-map rows, causal and significance wording, p-value mentions).
EV_TAG = r"\[\[(?:EV:)?(EV-[a-f0-9]{10})\]\]"
CITE = r"\[(\d{1,4})\]"
CITE_MAP_LINE = r"^\|\s*\[(\d{1,4})\]\s*\|\s*(EV-[a-f0-9]{10})\s*\|"
# a word character is any letter or digit here, as for Unicode patterns elsewhere; the JVM's \w has ASCII only
NUMBER = r"(?<![\p{L}\p{N}_-])[0-9]"
CAUSAL = r"(?i)\b(caused|causes|proved|proves|guarantees|drives growth|causal(?:ly)?)\b"
SIGNIFICANCE = r"(?i)\b(statistically significant|significant improvement|significant lift)\b"
P_VALUE = r"(?i)\bp-value\b|\bp\s*=\s*\d"
CI_HEADING = "### Confidence Intervals"
EFFECT_HEADING = "### Effect Sizes"
KEY_SECTIONS = ("1) Executive Summary", "2) Question Answer (Evidence)", "5) Analysis Outputs")
REFERENCE_SECTIONS = ("8) Evidence References", "9) Evidence References")

# Statement-audit deny list (matched as whole words).
SQL_DENY_KEYWORDS = ("insert", "update", "delete", "drop", "alter", "truncate", "create", "grant", "revoke",
                     "merge", "call", "exec", "execute", "copy", "vacuum", "analyze", "attach", "detach",
                     "pragma", "set", "begin", "commit", "rollback")

# Secret-redaction rules (name, pattern, replacement), applied
# case-insensitively in this order.
REDACTIONS = (
    ("url_credentials", r"://([^:/?#\s]+):([^@/\s]+)@", "://$1:***@"),
    ("bearer_token", r"(authorization\s*:\s*bearer\s+)[^\s]+", "$1***"),
    ("openrouter_key", r"(openrouter_api_key\s*[=:]\s*)[^\s]+", "$1***"),
    ("api_key", r"(api[_-]?key\s*[=:]\s*)[^\s]+", "$1***"),
)

LINE_BREAK = r"\r\n|\n|\r"


def _strip(c):
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def text_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line, section): trimmed lines with the ``## `` section
    heading they fall under (a window inside one document, whose size is
    bounded by one row's text)."""
    lines = docs.select(id_col, F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), LINE_BREAK))
                        .alias("line_no", "_raw"))
    lines = lines.select(id_col, "line_no", F.col("_raw").alias("raw"), _strip(F.col("_raw")).alias("line"))
    heading = F.when(F.col("raw").startswith("## "), F.regexp_replace(F.col("raw"), r"^## ", ""))
    w = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(heading, ignorenulls=True).over(w))


def citation_map(lines: DataFrame, id_col: str) -> DataFrame:
    """(id, cite_numbers): numbers defined in the evidence-reference table
    of each document."""
    m = lines.where(F.col("section").isin(*REFERENCE_SECTIONS) & F.col("line").rlike(CITE_MAP_LINE))
    return m.groupBy(id_col).agg(F.collect_set(F.regexp_extract("line", CITE_MAP_LINE, 1).cast("int"))
                                 .alias("cite_numbers"))


def uncited_claim_lines(docs: DataFrame, id_col: str, text_col: str, sections=None) -> DataFrame:
    """AUD1 detail: lines with a number but no evidence tag and no mapped
    citation, table rows excluded. ``sections=None`` audits whole texts;
    pass ``KEY_SECTIONS`` for the reference's report sections."""
    lines = text_lines(docs, id_col, text_col)
    cmap = citation_map(lines, id_col)
    cand = lines.where((F.col("line") != "") & ~F.col("line").startswith("|") & ~F.col("raw").startswith("## ")
                       & F.col("line").rlike(NUMBER))
    if sections:
        cand = cand.where(F.col("section").isin(*sections))
    cand = cand.join(cmap, id_col, "left")
    cites = F.transform(F.regexp_extract_all("line", F.lit(CITE), 1), lambda s: s.cast("int"))
    tagged = F.col("line").contains("[[EV:") | F.col("line").contains("[[EV-")
    mapped = F.coalesce(F.arrays_overlap(cites, F.coalesce("cite_numbers", F.array().cast("array<int>"))),
                        F.lit(False))
    return cand.where(~tagged & ~mapped).select(id_col, "line_no", "line", "section")


def uncited_claims(docs: DataFrame, id_col: str, text_col: str, sections=None) -> DataFrame:
    """AUD1: per document (n_uncited_lines); documents with none included."""
    bad = uncited_claim_lines(docs, id_col, text_col, sections).groupBy(id_col) \
        .agg(F.count(F.lit(1)).alias("n_uncited_lines"))
    return docs.select(id_col).join(bad, id_col, "left").select(
        id_col, F.coalesce("n_uncited_lines", F.lit(0)).cast("long").alias("n_uncited_lines"))


def dangling_refs(docs: DataFrame, id_col: str, text_col: str, evidence: DataFrame | None = None,
                  evidence_id_col: str = "id") -> DataFrame:
    """AUD2: (id, kind, ref) for numeric citations without a citation-map
    row ('unmapped_citation') and evidence ids absent from the evidence
    table ('missing_evidence', a left_anti join)."""
    lines = text_lines(docs, id_col, text_col)
    cmap = citation_map(lines, id_col)
    cites = docs.select(id_col, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(CITE), 1)))
                        .alias("ref"))
    cites = cites.join(cmap, id_col, "left").where(
        ~F.coalesce(F.array_contains(F.col("cite_numbers"), F.col("ref").cast("int")), F.lit(False)))
    unmapped = cites.select(id_col, F.lit("unmapped_citation").alias("kind"), "ref")
    if evidence is None:
        return unmapped
    tags = docs.select(id_col, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(EV_TAG), 1)).alias("ref"))
    mapped = lines.where(F.col("section").isin(*REFERENCE_SECTIONS) & F.col("line").rlike(CITE_MAP_LINE)) \
        .select(id_col, F.regexp_extract("line", CITE_MAP_LINE, 2).alias("ref"))
    refs = tags.unionByName(mapped).distinct()
    ev = evidence.select(F.col(evidence_id_col).cast("string").alias("_ev"))
    missing = refs.join(ev, refs.ref == ev._ev, "left_anti").select(id_col, F.lit("missing_evidence").alias("kind"), "ref")
    return unmapped.unionByName(missing)


def wording_flags(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """AUD3: significance wording needs p-value, CI and effect-size support;
    causal wording is refused. One row per document with a verdict."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    sig, pv = t.rlike(SIGNIFICANCE), t.rlike(P_VALUE)
    ci, eff, causal = t.contains(CI_HEADING), t.contains(EFFECT_HEADING), t.rlike(CAUSAL)
    unsupported = sig & ~(pv & ci & eff)
    return docs.select(id_col, sig.alias("significance_wording"), pv.alias("has_p_value"), ci.alias("has_ci"),
                       eff.alias("has_effect_size"), causal.alias("causal_wording"),
                       F.when(causal | unsupported, "fail").otherwise("pass").alias("verdict"))


def statement_audit(stmts: DataFrame, id_col: str, sql_col: str) -> DataFrame:
    """AUD4: read-only statement rules over a table of SQL strings: after
    removing comments and trailing ';' - non-empty, one statement, starts
    with SELECT or WITH, no denied keyword (whole word), no FOR UPDATE, no
    SELECT ... INTO. Rows (id, verdict, rule, keyword)."""
    s = F.regexp_replace(F.coalesce(F.col(sql_col), F.lit("")), r"(?s)/\*.*?\*/", " ")
    s = F.regexp_replace(s, r"--[^\n\r]*", " ")
    q = _strip(F.regexp_replace(_strip(s), r";+$", ""))
    lq = F.lower(q)
    kw = F.coalesce(*[F.when(lq.rlike(rf"\b{k}\b"), F.lit(k)) for k in SQL_DENY_KEYWORDS])
    rule = (F.when(q == "", "empty")
            .when(q.contains(";"), "multiple_statements")
            .when(~(lq.startswith("select") | lq.startswith("with ")), "not_select")
            .when(kw.isNotNull(), "denied_keyword")
            .when(lq.rlike(r"\bfor\s+update\b"), "for_update")
            .when(lq.rlike(r"\bselect\b[\s\S]*\binto\b"), "select_into"))
    return stmts.select(id_col, F.when(rule.isNull(), "accepted").otherwise("refused").alias("verdict"),
                        rule.alias("rule"), F.when(rule == "denied_keyword", kw).alias("keyword"))


def redact_text(docs: DataFrame, id_col: str, text_col: str, collapse_whitespace: bool = False,
                max_chars: int | None = None) -> DataFrame:
    """AUD5: the four credential rules applied to whole texts, with the
    number of hits per rule. Optional whitespace collapse and truncation
    (the error-message form)."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    hits = [F.size(F.regexp_extract_all(t, F.lit("(?i)" + pat), 0)).alias(f"hits_{name}")
            for name, pat, _ in REDACTIONS]
    out = t
    for _, pat, rep in REDACTIONS:
        out = F.regexp_replace(out, "(?i)" + pat, rep)
    if collapse_whitespace:
        out = _strip(F.regexp_replace(out, r"\s+", " "))
    if max_chars:
        lim = max(80, int(max_chars))
        out = F.when(F.length(out) > lim, F.concat(F.rtrim(F.substring(out, 1, lim)), F.lit("..."))).otherwise(out)
    return docs.select(id_col, out.alias("redacted"), *hits)
