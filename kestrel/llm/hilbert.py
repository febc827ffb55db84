"""Sharding along a Hilbert curve over document metadata (operator 4).

The metadata dimensions are quantised, the cells are numbered along a
Hilbert curve, rows are sorted by that number and the order is cut into
runs of equal row counts. Rows near each other in every dimension share a
shard, so a file's min/max statistics prune on any of them. DataFrame and
SQL functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.native import let
from kestrel.session import cut_lineage


def hilbert_index(cells: list, bits: int):
    """The index along the Hilbert curve of the cell (columns of integers
    0 .. 2**bits-1), by Skilling's transform: undo the rotations from the
    highest bit down, Gray-encode, interleave."""
    n = len(cells)

    def put(x, i, v):
        return F.transform(x, lambda e, k: F.when(k == i, v).otherwise(e))

    def undo(x, step):
        q, i = step["q"], step["i"]
        p = q - 1
        head, own = F.element_at(x, 1), F.element_at(x, i + 1)
        swap = head.bitwiseXOR(own).bitwiseAND(p)
        return F.when(own.bitwiseAND(q) != 0, put(x, 0, head.bitwiseXOR(p))).otherwise(
            F.transform(x, lambda e, k: F.when((k == 0) | (k == i), e.bitwiseXOR(swap)).otherwise(e)))

    steps = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i"))
                      for b in range(bits - 1, 0, -1) for i in range(n)])
    x = F.array(*[c.cast("long") for c in cells])
    x = F.aggregate(steps, x, undo) if bits > 1 else x

    def gray(v):
        return F.transform(v, lambda e, k: F.aggregate(F.slice(v, 1, k + 1), F.lit(0).cast("long"),
                                                       lambda a, y: a.bitwiseXOR(y)))

    def turned(v):
        last = F.element_at(v, n)
        turn = reduce(lambda a, c: a.bitwiseXOR(c), [
            F.when(last.bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1).cast("long")).otherwise(F.lit(0).cast("long"))
            for b in range(bits - 1, 0, -1)], F.lit(0).cast("long"))
        return let(turn, lambda t: F.transform(v, lambda e: e.bitwiseXOR(t)))

    def interleave(v):
        return reduce(lambda a, c: a.bitwiseOR(c), [
            F.shiftleft(F.shiftright(F.element_at(v, i + 1), b).bitwiseAND(F.lit(1)), b * n + n - 1 - i)
            for b in range(bits) for i in range(n)])

    return let(let(let(x, gray), turned), interleave)


def cells(lang: str, source: str, n_chars: str, bits: int) -> list:
    """The quantised dimensions: languages and sources by a hash (null is a
    value of its own), lengths by a quarter of a power of two."""
    top = (1 << bits) - 1
    name = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c), F.lit("\x00"))), F.lit(1 << bits))
    size = F.least(F.floor(F.log2(F.greatest(F.coalesce(F.col(n_chars), F.lit(0)), F.lit(0)) + 1.0) * 4), F.lit(top))
    return [name(lang), name(source), size.cast("long")]


def hilbert_shards(docs: DataFrame, n_shards: int = 24, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                   source: str = "source", bits: int = 7) -> DataFrame:
    """One row per input row: doc_id, size (UTF-8 bytes of the text, null:
    none, plus 8), text_crc32, hilbert (curve index), shard, slot.

    Rows are ordered by curve index (ties by doc_id, then text checksum and
    size; null doc_ids first) and cut into ``n_shards`` runs whose counts
    differ by at most one (law ``rows``); slot counts up from 0 within a
    shard. One range shuffle of narrow rows sorts them; positions come from
    a count per sorted partition, so no partition sees all rows and a cell
    that holds a third of them is split by its ties. Missing metadata is a
    value of its own; fewer rows than shards leave shards empty; an empty
    table gives an empty result."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t"),
                      F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"))
    narrow = src.select("doc_id", (F.coalesce(F.octet_length("t"), F.lit(0)) + 8).cast("long").alias("size"),
                        F.crc32(F.coalesce("t", F.lit("")).cast("binary")).alias("text_crc32"), "lang", "source")
    keyed = narrow.withColumn("hilbert", hilbert_index(cells("lang", "source", "size", bits), bits)).drop("lang", "source")
    keyed = cut_lineage(keyed)
    order = ["hilbert", "doc_id", "text_crc32", "size"]
    # the identifier holds the sorted partition and the position in it
    placed = cut_lineage(keyed.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("id", F.monotonically_increasing_id()))
    part, at = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    per = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = cut_lineage(per.select("part", F.coalesce(before, F.lit(0)).alias("base")))     # one row per partition
    total = base.join(per, "part").agg(F.max(F.col("base") + F.col("n"))).first()[0] or 0
    ranked = placed.withColumn("part", part).join(base, "part").withColumn("rank", F.col("base") + at)
    # the first ``more`` shards hold one row more than the others
    less, more = divmod(total, n_shards)
    cut = F.lit(more * (less + 1))
    r = F.col("rank")
    shard = F.when(r < cut, F.floor(r / (less + 1))).otherwise(more + F.floor((r - cut) / max(less, 1)))
    slot = F.when(r < cut, r % (less + 1)).otherwise((r - cut) % max(less, 1))
    return ranked.select("doc_id", "size", "text_crc32", "hilbert", shard.cast("int").alias("shard"),
                         slot.cast("long").alias("slot"))


def digest(shards: DataFrame) -> DataFrame:
    """The contract's columns."""
    return shards.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
