"""Benchmark decontamination by a prefix-filtered set join (operator 1).

Every benchmark item is cut into item-sized windows (``k`` words, or the
whole item if it is shorter). A window is a set of word shingles; ordered
by rarity in the documents, a window that is contained whole must share its
rarest shingle, so only that prefix is joined. Length and positional bounds
drop what cannot fit, and every shingle of the window is then looked up at
its place. DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.native import fresh, let, sift
from kestrel.session import cut_lineage

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BREAK = "".join(chr(c) for c in (*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)))
#: Distinct benchmark shingles (8 bytes each) up to which they are broadcast.
BROADCAST_SHINGLES = 1 << 20


def words(text):
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z
    lower-cased; null has none."""
    flat = F.translate(text, _UPPER + _BREAK, _UPPER.lower() + " " * len(_BREAK))
    return F.coalesce(F.array_remove(F.split(flat, " "), ""), F.array().cast("array<string>"))


def _shingle(w, at, size: int):
    """The ``size``-word shingle (text) of words ``w`` at place ``at``."""
    return F.array_join(F.slice(w, at + 1, size), " ")


def _shingles(text, size: int):
    """(h, g) of a text: first its number of words, then hash and text of
    the shingle that starts at each word (shorter at the end)."""
    def rows(w):
        count = F.struct(F.size(w).cast("long").alias("h"), F.lit(None).cast("string").alias("g"))
        grams = F.transform(w, lambda x, i: F.concat_ws(" ", x, *[F.get(w, i + j) for j in range(1, size)]))
        return F.concat(F.array(count), F.transform(grams, lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))
    return let(words(text), rows)


def windows(benchmark: DataFrame, item_id: str, text: str, k: int) -> DataFrame:
    """(item_id, wid, size): every item's windows; ``wid`` is the window's
    words joined by a space."""
    b = benchmark.select(F.col(item_id).cast("string").alias("item_id"), words(F.col(text)).alias("w"))
    b = b.where(F.size("w") > 0).withColumn("size", F.least(F.size("w"), F.lit(k)))
    at = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("at")
    return (b.select("item_id", "w", "size", at)
            .select("item_id", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("wid"), "size")
            .distinct())


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", k: int = 13, shingle: int = 3,
                  min_share: tuple[int, int] = (1, 20)) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit (words inside an
    occurrence of a window), n_items (items with an occurring window),
    items (their ids as strings, sorted), contaminated (n_hit > 0 and n_hit
    is at least ``min_share`` of n_words).

    Null or blank texts have no words and are never contaminated; items
    without words have no windows; a null item_id counts as the item "".
    Repeated rows come back as often, rows that share a doc_id are judged
    each by its own text. Empty documents give an empty result, an empty
    benchmark marks nothing."""
    return _judged(docs, benchmark, doc_id, text, item_id, item_text, k, shingle, min_share).drop("th")


def _judged(docs, benchmark, doc_id="doc_id", text="text", item_id="item_id", item_text="text", k=13, shingle=3,
            min_share=(1, 20)) -> DataFrame:
    """``contamination`` with ``th``, the hash of each row's text."""
    win = cut_lineage(windows(benchmark, item_id, item_text, k))
    shape = win.select("wid", "size").distinct()
    pieces = shape.select("wid", "size", F.split("wid", " ").alias("w")).withColumn("q", F.least("size", F.lit(shingle)))
    sizes = sorted(r[0] for r in pieces.select("q").distinct().collect())          # at most ``shingle`` values
    sh = None
    for q in sizes:
        one = pieces.where(F.col("q") == q).select("wid", "size", "q", F.posexplode(F.transform(
            F.sequence(F.lit(0), F.col("size") - q), lambda i: _shingle(F.col("w"), i, q))).alias("off", "g"))
        sh = one if sh is None else sh.unionByName(one)
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t"))
    key = F.xxhash64("t").alias("th")       # tells rows of one doc_id apart
    if sh is None:
        return src.select("doc_id", key, F.size(words(F.col("t"))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
                          F.lit(0).cast("long").alias("n_items"), F.array().cast("array<string>").alias("items"),
                          F.lit(False).alias("contaminated"))
    sh = cut_lineage(sh)
    known = cut_lineage(sh.select("q", F.xxhash64("g").alias("kh"), F.col("g").alias("kg")).distinct())
    small = known.count() <= BROADCAST_SHINGLES

    # one pass over the documents: a row per document (place 0, its word count) and its words that start a
    # benchmark shingle
    found = None
    for q in sizes:
        mine = known.where(F.col("q") == q).select("kh", "kg")
        # outer: an inner explode would have its "not empty" filter computed apart, twice
        rows = src.select("doc_id", key, F.posexplode_outer(_shingles(F.col("t"), q)).alias("p", "s"))
        rows = rows.select("doc_id", "th", "p", "s.h", "s.g")
        rows = rows.join(F.broadcast(mine) if small else mine, (rows.h == mine.kh) & (rows.g == mine.kg), "left")
        rows = rows.where("p = 0 OR kh IS NOT NULL").select(
            "doc_id", "th", "p", F.when(F.col("p") == 0, F.col("h")).alias("n_words"), "g", F.lit(q).alias("q"))
        found = rows if found is None else found.unionByName(rows.where("p > 0"))
    found = cut_lineage(found)
    hits = found.where("p > 0").select("doc_id", "th", (F.col("p") - 1).alias("p"), "g", "q")

    # rarity order: a window's prefix is its rarest shingle; one the documents lack rules the window out
    seen = hits.groupBy("g", "q").agg(F.count("*").alias("n"))
    prefix = (sh.join(seen, ["g", "q"], "left").groupBy("wid", "size", "q")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "g")).alias("r"))
              .where("r.n > 0").select("wid", "size", "q", "r.off", "r.g"))
    prefix = cut_lineage(prefix)
    # bounds: a window starts within the text, and its shingles (q words each, short of none) end there
    cand = (hits.join(prefix, ["g", "q"]).select("doc_id", "th", (F.col("p") - F.col("off")).alias("start"), "wid", "size", "q")
            .where("start >= 0").distinct())

    # exact containment: every shingle of the window stands at its place
    want = cand.select("doc_id", "th", "start", "wid", "size", "q", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.col("size") - F.col("q")),
        lambda i: F.array_join(F.slice(F.split("wid", " "), i + 1, F.col("q")), " "))).alias("off", "g"))
    want = want.withColumn("p", F.col("start") + F.col("off"))
    there = hits.select(F.col("doc_id").alias("hd"), F.col("th").alias("ht"), F.col("p").alias("hp"), F.col("g").alias("hg"),
                        F.col("q").alias("hq")).distinct()
    whole = (want.join(there, F.col("doc_id").eqNullSafe(F.col("hd")) & (F.col("th") == F.col("ht")) & (F.col("p") == F.col("hp")) &
                       (F.col("g") == F.col("hg")) & (F.col("q") == F.col("hq")))
             .groupBy("doc_id", "th", "start", "wid", "size", "q").agg(F.count("*").alias("n"))
             .where("n = size - q + 1"))
    # a document's windows: at most one start per word and item
    held = whole.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "size")).alias("c"), F.collect_set("wid").alias("wids"))
    places = F.array_distinct(F.flatten(F.transform("c", lambda x: F.sequence(x["start"], x["start"] + x["size"] - 1))))
    held = cut_lineage(held.select("doc_id", "th", F.size(places).alias("n_hit"), "wids"))
    items = (held.select("doc_id", "th", "n_hit", F.explode("wids").alias("wid"))
             .join(win.select("wid", F.coalesce("item_id", F.lit("")).alias("item_id")), "wid")
             .groupBy("doc_id", "th").agg(F.max("n_hit").alias("n_hit"), F.sort_array(F.collect_set("item_id")).alias("items")))
    marks = items.select(F.col("doc_id").alias("md"), F.col("th").alias("mt"), F.col("n_hit").alias("mh"), "items")
    rows = found.where("p = 0").select("doc_id", "th", "n_words")
    out = rows.join(marks, F.col("doc_id").eqNullSafe(F.col("md")) & (F.col("th") == F.col("mt")), "left")
    hit = F.coalesce(F.col("mh"), F.lit(0)).cast("long")
    num, den = min_share
    return out.select("doc_id", "th", "n_words", hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      ((hit > 0) & (hit * den >= F.col("n_words") * num)).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                        **options) -> DataFrame:
    """``docs`` without the contaminated rows. A row goes by its own text:
    others of its doc_id, or without one, stay. Null and blank texts stay;
    columns may have any name and type; an empty table gives an empty
    result.

    Only rows that a fixed-size bit table of those to drop does not clear
    are shuffled."""
    p = fresh(docs)
    bad = _judged(docs, benchmark, doc_id, text, **options).where("contaminated").select(
        F.col("doc_id").alias(f"{p}ad"), F.col("th").alias(f"{p}at")).distinct()
    bad = cut_lineage(bad)
    if bad.isEmpty():
        return docs
    rows = docs.select("*", docs[doc_id].alias(f"{p}d"), F.xxhash64(docs[text].cast("string")).alias(f"{p}t"))
    rows = rows.withColumn(f"{p}h", F.xxhash64(f"{p}d", f"{p}t"))
    others, suspects = sift(rows, f"{p}h", bad.select(F.xxhash64(f"{p}ad", f"{p}at").alias("h")), "h")
    on = F.col(f"{p}d").eqNullSafe(F.col(f"{p}ad")) & (F.col(f"{p}t") == F.col(f"{p}at"))
    return others.unionByName(suspects.join(bad, on, "left_anti")).drop(f"{p}d", f"{p}t", f"{p}h")


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns: the items as one SHA-256."""
    return result.select("doc_id", "n_words", "n_hit", "n_items",
                         F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS wid
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS wid
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw ON dw.wid = bw.wid),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
       FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
