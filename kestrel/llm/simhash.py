"""SimHash near-duplicate groups by pigeonhole blocks (operator 9)."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import U64, column, split_words, text_chunks
from kestrel.llm.components import components
from kestrel.llm.native import fresh, sift
from kestrel.session import cut_lineage

#: A block shared by more distinct fingerprints than this is searched by
#: probing (linear in the block) instead of by comparing its members.
PROBE_ABOVE = 8192


def _fingerprints(texts, shingle: int):
    """Unsigned 64-bit fingerprints of a string array."""
    import xxhash
    words, off = split_words(texts, lower=True)
    n = np.diff(off)
    out = np.zeros(len(n), U64)
    if len(words) == 0:
        return out
    # all words of all documents, each followed by one space
    raw = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_buffer()
    raw = raw.to_pybytes()
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    end = np.cumsum(size + 1) - 1
    start = end - size
    per_doc = np.where(n == 0, 0, np.maximum(n - shingle + 1, 1))
    at = np.concatenate([[0], np.cumsum(per_doc)])
    full = np.flatnonzero(per_doc)
    first = np.repeat(off[:-1][full], per_doc[full]) + np.arange(at[-1]) - np.repeat(at[:-1][full], per_doc[full])
    last = first + np.repeat(np.minimum(n[full], shingle), per_doc[full]) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[i:j], 42) for i, j in zip(start[first].tolist(), end[last].tolist())), U64, at[-1])
    # bit counts per document, in slices that bound the unpacked matrix
    ones = np.zeros((len(n), 64), np.int64)
    step = 1 << 18
    doc = np.repeat(full, per_doc[full])
    for s in range(0, len(h), step):
        part, owner = h[s:s + step], doc[s:s + step]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        ones[owner[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    set_bits = 2 * ones > per_doc[:, None]
    return np.packbits(set_bits, axis=1, bitorder="little").view(U64).ravel()


def _text_keys(text):
    """Two 64-bit hashes that tell the texts of one doc_id apart."""
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, keys: bool = False) -> DataFrame:
    """(doc_id, fp): the SimHash of every whole text as a signed long;
    with ``keys`` also t1 and t2, the hashes of ``_text_keys``.

    A-Z are lower-cased; words are runs without ASCII white space; every
    shingle of ``shingle`` words (repeats count) is hashed by XXH64 with
    seed 42; a bit is set if more than half of the hashes set it. Fewer
    words form one shingle; null and blank texts have fingerprint 0."""
    names = ["d", "t1", "t2"] if keys else ["d"]

    def run(batches):
        for b in text_chunks(batches, "t"):
            yield pa.record_batch([*[column(b, n) for n in names],
                                   pa.array(_fingerprints(column(b, "t"), shingle).view(np.int64))], names=[*names, "fp"])

    t = F.col(text).cast("string")
    src = docs.select(F.col(doc_id).cast("long").alias("d"), *[h.alias(n) for h, n in zip(_text_keys(t), names[1:])], t.alias("t"))
    return src.mapInArrow(run, ", ".join(f"{n} long" for n in [*names, "fp"])).withColumnRenamed("d", "doc_id")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(max_bits: int, pieces: int) -> list[int]:
    """The fingerprint is cut into ``pieces`` pieces. Two fingerprints that
    differ in at most ``max_bits`` bits agree on at least pieces - max_bits
    of them, so they share one of the blocks returned here (the unions of
    so many pieces), as masks."""
    cuts = [64 * i // pieces for i in range(pieces + 1)]
    piece = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(pieces)]
    return [sum(c) for c in combinations(piece, pieces - max_bits)]


def close_pairs(fps: DataFrame, max_bits: int = 2, pieces: int | None = None,
                probe_above: int = PROBE_ABOVE) -> DataFrame:
    """(a, b), a < b: all pairs of distinct ``fp`` values that differ in at
    most ``max_bits`` bits, each once.

    One row per fingerprint and block; an equi-join on the block with the
    Hamming distance checked inside the join (a pair is kept only in its
    first shared block). Blocks with more than ``probe_above`` members are
    not joined: each member probes for its neighbours, obtained by flipping
    bits outside the block, with an equi-join on the fingerprint, so the
    work stays linear however full a block is and no pair is lost."""
    pieces = pieces or max_bits + 3
    masks = block_masks(max_bits, pieces)
    rows = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
        for i, m in enumerate(masks)])).alias("s")).select("fp", "s.block", "s.key")
    rows = cut_lineage(rows)
    full = cut_lineage(rows.groupBy("block", "key").count().where(F.col("count") > probe_above).select("block", "key"))
    any_full = not full.isEmpty()
    thin = rows.join(full, ["block", "key"], "left_anti") if any_full else rows
    a = thin.select(F.col("block").alias("ab"), F.col("key").alias("ak"), F.col("fp").alias("a"))
    b = thin.select(F.col("block").alias("bb"), F.col("key").alias("bk"), F.col("fp").alias("b"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    first = F.coalesce(*[F.when(diff.bitwiseAND(F.lit(_signed(m))) == 0, F.lit(i)) for i, m in enumerate(masks)])
    pairs = a.join(b, (F.col("ab") == F.col("bb")) & (F.col("ak") == F.col("bk")) & (F.col("a") < F.col("b")) &
                   (F.bit_count(diff) <= max_bits) & (first == F.col("ab"))).select("a", "b")
    if not any_full:
        return pairs
    flips = []
    for i, m in enumerate(masks):
        free = [k for k in range(64) if not m >> k & 1]
        near = [_signed(reduce(lambda x, k: x | 1 << k, c, 0)) for r in range(1, max_bits + 1)
                for c in combinations(free, r)]
        flips.append((i, near))
    flips = fps.sparkSession.createDataFrame(flips, "block int, near array<long>")
    probes = (rows.join(full, ["block", "key"], "left_semi").join(flips, "block")
              .select(F.col("fp").alias("a"), F.explode(F.transform("near", lambda x: F.col("fp").bitwiseXOR(x))).alias("b"))
              .where("a < b"))
    found = probes.join(fps.select(F.col("fp").alias("b")), "b", "left_semi").select("a", "b")
    return pairs.unionByName(found).distinct()


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
                   max_bits: int = 2, pieces: int | None = None, probe_above: int = PROBE_ABOVE) -> DataFrame:
    """One row per input row: doc_id, fp (signed long), component_id (the
    smallest doc_id reachable over links of at most ``max_bits`` differing
    bits, its own included).

    Equal fingerprints are one node, so a group of copies of any size costs
    one row in the pair search. Repeated rows come back as often; a null
    doc_id is kept and is never a component_id unless its whole component
    has none. An empty table gives an empty result."""
    fp = cut_lineage(fingerprints(docs, doc_id, text, shingle))
    label = _least(fp.groupBy("fp").agg(F.min("doc_id").alias("low")), max_bits, pieces, probe_above)
    return fp.join(label.withColumnRenamed("low", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _least(nodes: DataFrame, max_bits: int, pieces: int | None, probe_above: int) -> DataFrame:
    """(fp, low): of each distinct fingerprint the smallest ``low`` of its
    component."""
    nodes = cut_lineage(nodes)
    root = cut_lineage(components(close_pairs(nodes.select("fp"), max_bits, pieces, probe_above)))
    linked = root.join(nodes, root.node == nodes.fp).select("root", "node", "low")
    low = linked.groupBy("root").agg(F.min("low").alias("m"))
    linked = linked.join(low, "root").select(F.col("node").alias("fp"), F.col("m").alias("linked_low"))
    return cut_lineage(nodes.join(linked, "fp", "left").select("fp", F.coalesce("linked_low", "low").alias("low")))


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
               max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest
    doc_id (a null one after all others), and of several texts of that
    doc_id the one with the smallest hash. Of rows that repeat both, the
    smallest as JSON. Rows are judged each by its own text; null and blank
    texts form one group. Columns may have any name and type and come back
    as they were; an empty table gives an empty result.

    Only rows that a fixed-size bit table of those to drop does not clear
    are shuffled."""
    fp = cut_lineage(fingerprints(docs, doc_id, text, shingle, keys=True))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")
    keys = fp.groupBy("doc_id", "t1", "t2", "fp").agg(F.count("*").alias("n")).withColumn("row", row)
    low = _least(keys.groupBy("fp").agg(F.min("row").alias("low")), max_bits, None, PROBE_ABOVE)
    p = fresh(docs)
    own, theirs = ([f"{p}{n}" for n in x] for x in (("d", "t1", "t2"), ("ad", "at1", "at2")))
    away = keys.join(low, "fp").where((F.col("row") != F.col("low")) | (F.col("n") > 1)).select(
        *[F.col(c).alias(a) for c, a in zip(("doc_id", "t1", "t2"), theirs)], (F.col("row") == F.col("low")).alias(f"{p}again"))
    away = cut_lineage(away)
    if away.isEmpty():
        return docs
    values = [docs[doc_id].cast("long"), *_text_keys(docs[text].cast("string"))]
    rows = docs.select("*", *[v.alias(n) for v, n in zip(values, own)]).withColumn(f"{p}h", F.xxhash64(*own))
    others, suspects = sift(rows, f"{p}h", away.select(F.xxhash64(*theirs).alias("h")), "h")
    on = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(own, theirs)]
    left = others.unionByName(suspects.join(away, on, "left_anti")).drop(*own, f"{p}h")
    again = away.where(F.col(f"{p}again"))        # kept rows that stand there more than once
    if again.isEmpty():
        return left
    whole = F.struct(*[suspects[c] for c in docs.columns])
    one = suspects.join(again, on).groupBy(*theirs).agg(F.min_by(whole, F.to_json(whole)).alias(f"{p}row"))
    return left.unionByName(one.select(f"{p}row.*"))


def digest(groups: DataFrame) -> DataFrame:
    """The contract's columns: the fingerprint as 16 lowercase hex digits."""
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
