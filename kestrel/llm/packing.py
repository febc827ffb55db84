"""Best-fit packing planned on the histogram of lengths (operator 7)."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import column, text_chunks
from kestrel.llm.tokens import default_path, encoder, id_bytes
from kestrel.session import cut_lineage

PIECE = "part long, doc_id long, piece int, start long, length long, ids binary, ids_crc32 long, place long"


def _pieces(path, width, size, end_id):
    """Pieces of at most ``size`` ids, with the running number of each
    among the pieces of its length in this task (``place``)."""
    import zlib

    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        enc = encoder(path)
        seen = np.zeros(size + 1, np.int64)
        for b in text_chunks(batches, "t", 3 << 20):
            ids, off = enc.documents(column(b, "t"), end_id)
            n = np.diff(off)
            per = -(-n // size)
            doc = np.repeat(np.arange(len(n)), per)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
            start = piece * size
            length = np.minimum(n[doc] - start, size)
            at = off[:-1][doc] + start
            order = np.argsort(length, kind="stable")
            ls = length[order]
            head = np.flatnonzero(np.concatenate([[True], ls[1:] != ls[:-1]]))
            run_ = np.diff(np.append(head, len(ls)))
            place = np.empty(len(ls), np.int64)
            place[order] = np.arange(len(ls)) - np.repeat(head, run_) + seen[ls]
            seen[ls[head]] += run_
            wide = ids.astype("<u4")
            crc = [zlib.crc32(wide[a:a + m].data) for a, m in zip(at.tolist(), length.tolist())]
            kept = ids.astype("<u2") if width == 2 else wide
            blobs = [kept[a:a + m].tobytes() for a, m in zip(at.tolist(), length.tolist())]
            yield pa.record_batch(
                [pa.array(np.full(len(doc), part)), column(b, "d").take(pa.array(doc)), pa.array(piece.astype(np.int32)),
                 pa.array(start), pa.array(length), pa.array(blobs, pa.binary()), pa.array(crc, pa.int64()), pa.array(place)],
                names=["part", "doc_id", "piece", "start", "length", "ids", "ids_crc32", "place"])
    return run


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths.

    Rows (length, first, n, each, sequence, offset): the pieces of
    ``length`` with ranks first .. first+n-1 go ``each`` to a sequence,
    from ``sequence`` on, at ``offset``. Sequences with equal room are one
    class, handled in runs, so time and rows depend on the number of
    different lengths (at most ``size``) and not on the number of pieces."""
    rows, room, open_, used = [], {}, [], 0      # room: free ids -> runs (first sequence, n); open_: its sorted keys

    def put(free, first, n):
        if free and n:
            if free not in room:
                room[free] = []
                insort(open_, free)
            room[free].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            i = bisect_left(open_, length)
            if i < len(open_):
                free = open_[i]
                first, n = room[free].pop()
                if not room[free]:
                    del room[free]
                    open_.pop(i)
            else:
                free, first, n = size, used, -(-left // (size // length))
                used += n
            each = free // length
            whole = min(n, left // each)
            if whole:
                rows.append((length, rank, whole * each, each, first, size - free))
                rank, left = rank + whole * each, left - whole * each
                put(free - each * length, first, whole)
            rest = n - whole
            if rest and left and left < each:          # the last ones share one sequence
                rows.append((length, rank, left, left, first + whole, size - free))
                put(free - left * length, first + whole, 1)
                whole, rest, left = whole + 1, rest - 1, 0
            put(free, first + whole, rest)
    return rows


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4096, path: str | None = None,
         end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (16-bit little
    endian if the vocabulary fits, else 32-bit), ids_crc32 (of the ids as
    32-bit), sequence_id, offset.

    A document is its ids and ``end_id``; only a longer one than ``size``
    is cut. The histogram of lengths (at most ``size`` rows) is all that
    meets on the driver; pieces join their planned slots on length and rank
    within the length. Ranks come from a count per task and length, so no
    length gathers in one place however many pieces share it. Null texts
    are empty (one id); repeated rows and null doc_ids are packed like any
    other; an empty table gives an empty result."""
    spark = docs.sparkSession
    path = path or default_path()
    src = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).cast("string").alias("t"))
    pieces = cut_lineage(src.mapInArrow(_pieces(path, id_bytes(path), size, end_id), PIECE))
    per = cut_lineage(pieces.groupBy("length", "part").agg((F.max("place") + 1).alias("n")))
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(plan(counts, size), "length long, first long, n long, each long, sequence long, at long")
    from pyspark.sql import Window
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = cut_lineage(per.select("length", "part", F.coalesce(before, F.lit(0)).alias("base")))
    ranked = (pieces.join(base, ["length", "part"])
              .select("doc_id", "piece", "start", "length", "ids", "ids_crc32", (F.col("base") + F.col("place")).alias("rank")))
    slots = F.broadcast(slots.withColumnRenamed("length", "l"))      # at most some rows per length up to ``size``
    k = F.col("rank") - F.col("first")
    placed = ranked.join(slots, (F.col("length") == F.col("l")) & (k >= 0) & (k < F.col("n")))
    return placed.select("doc_id", "piece", "start", "length", "ids", "ids_crc32",
                         (F.col("sequence") + F.floor(k / F.col("each"))).cast("long").alias("sequence_id"),
                         (F.col("at") + (k % F.col("each")) * F.col("length")).cast("long").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_ids, ids): the packed sequences themselves. A
    sequence has at most ``size`` ids, so groups are bounded."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), parts.alias("p")).select(
        "sequence_id", "n_ids", F.expr("aggregate(p, X'', (a, x) -> a || x.ids)").alias("ids"))


def digest(packed: DataFrame) -> DataFrame:
    """The contract's columns (the ids themselves are left in the table)."""
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
