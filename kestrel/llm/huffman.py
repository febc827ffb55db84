"""Token ids in files, as length-limited canonical Huffman code (operator 6).

File format (a folder of two Parquet tables):

* ``codebook``: (id, length), the code lengths of every id in use; the codes
  are canonical (counted up by length, then id).
* ``blocks``: one row per block, an independently decodable run of whole
  documents: part and block (their order is ascending doc_id), first (ids of
  the part before the block), n_ids, payload (the codes, most significant
  bit first, from bit 0), checkpoints (little-endian 32-bit bit offsets of
  every ``STRIDE``-th id, 64-bit if the payload needs it), doc_ids, sizes
  (little-endian 64-bit ids and id counts of the block's documents; bit i
  of nulls marks a null doc_id).
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.llm.common import U64, column, text_chunks
from kestrel.llm.tokens import default_path, encoder, id_bytes
from kestrel.session import cut_lineage, ensure_checkpoint_dir

#: Longest code; a table of 2**MAX_LENGTH entries decodes it.
MAX_LENGTH = 18
#: Ids between two checkpoints, ids from which a block is full, ids per part.
STRIDE, BLOCK_IDS, PART_IDS = 256, 1 << 16, 1 << 22

BLOCK = ("part int, block int, first long, n_ids long, payload binary, checkpoints binary, doc_ids binary, "
         "sizes binary, nulls binary")


def code_lengths(counts, limit: int = MAX_LENGTH):
    """Optimal code lengths of at most ``limit`` bits (package-merge) for
    positive counts, in their order."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    limit = max(limit, int(n - 1).bit_length())
    order = np.argsort(counts, kind="stable")
    items = np.asarray(counts, np.float64)[order]
    row, kinds = items, [np.ones(n, bool)]
    for _ in range(limit - 1):
        m = len(row) // 2 * 2
        both = np.concatenate([items, row[:m:2] + row[1:m:2]])
        o = np.argsort(both, kind="stable")
        row = both[o]
        kinds.append(o < n)
    length, take = np.zeros(n, np.int64), 2 * n - 2
    for kind in reversed(kinds):
        used = int(kind[:take].sum())
        length[:used] += 1
        take = 2 * (take - used)
    out = np.empty(n, np.int64)
    out[order] = length
    return out


class Code:
    """Canonical code of (ids, lengths): encoding and decoding tables."""

    def __init__(self, ids, lengths):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = np.asarray(ids, np.int64)[order], np.asarray(lengths, np.int64)[order]
        self.longest = int(self.lengths.max()) if len(ids) else 1
        width = np.int64(1) << (self.longest - self.lengths)
        top = int(self.ids.max()) + 1 if len(ids) else 0
        self.code, self.size = np.zeros(top, U64), np.zeros(top, np.int64)
        self.code[self.ids] = ((np.cumsum(width) - width) >> (self.longest - self.lengths)).astype(U64)
        self.size[self.ids] = self.lengths

    def tables(self):
        """Id and length for each value of the next ``longest`` bits."""
        width = np.int64(1) << (self.longest - self.lengths)
        ids, size = np.zeros(1 << self.longest, np.uint32), np.ones(1 << self.longest, np.int64)
        ids[:width.sum()] = np.repeat(self.ids, width)
        size[:width.sum()] = np.repeat(self.lengths, width)
        return ids, size


def encode(code: Code, ids):
    """(payload bytes, bit offsets of every STRIDE-th id)."""
    size = code.size[ids]
    end = np.cumsum(size)
    start = end - size
    bits = int(end[-1]) if len(ids) else 0
    out = np.zeros((bits + 63) // 64 + 1, U64)
    if bits:
        word, over = start >> 6, (start & 63) + size - 64
        value = code.code[ids]
        left = np.where(over <= 0, value << np.maximum(-over, 0).astype(U64), value >> np.maximum(over, 0).astype(U64))
        head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[head]] = np.bitwise_or.reduceat(left, head)
        cross = np.flatnonzero(over > 0)
        out[word[cross] + 1] |= value[cross] << (64 - over[cross]).astype(U64)
    return out.astype(">u8").tobytes()[:(bits + 7) // 8], start[::STRIDE]


def decode(code: Code, payloads, checkpoints, counts, tables=None):
    """Ids of several blocks at once: all stretches between checkpoints
    advance together, one table lookup per id."""
    ids, size = tables or code.tables()
    raw = np.frombuffer(b"".join(payloads) + bytes(8), np.uint8).astype(np.uint32)
    ahead = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    base = np.cumsum([0] + [len(p) for p in payloads])[:-1] * 8
    pos = np.concatenate([c.astype(np.int64) + b for c, b in zip(checkpoints, base)])
    todo = np.concatenate([np.diff(np.append(np.arange(0, n, STRIDE), n)) for n in counts]).astype(np.int64)
    out = np.zeros((len(pos), STRIDE), np.uint32)
    down = np.uint32(32 - code.longest)
    full = todo == STRIDE
    for some in (np.flatnonzero(full), np.flatnonzero(~full)):
        if not len(some):
            continue
        p, limit, left = pos[some], int(todo[some].max()), todo[some]
        for j in range(limit):
            look = (ahead[np.minimum(p >> 3, len(ahead) - 1)] << (p & 7).astype(np.uint32)) >> down
            out[some, j] = ids[look]
            p += size[look]
    keep = np.arange(STRIDE)[None, :] < todo[:, None]
    return out[keep]


def token_table(docs: DataFrame, doc_id: str, text: str, path: str, end_id: int) -> DataFrame:
    """(doc_id, n, ids): every document's ids and ``end_id``, written once
    (16-bit little endian if the vocabulary fits, else 32-bit)."""
    width = "<u2" if id_bytes(path) == 2 else "<u4"

    def run(batches):
        enc = encoder(path)
        for b in text_chunks(batches, "t", 3 << 20):
            ids, off = enc.documents(column(b, "t"), end_id)
            raw, w = ids.astype(width).tobytes(), int(width[-1])
            yield pa.record_batch([column(b, "d"), pa.array(np.diff(off)),
                                   pa.array([raw[a * w:z * w] for a, z in zip(off[:-1].tolist(), off[1:].tolist())],
                                            pa.binary())], names=["doc_id", "n", "ids"])

    src = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).cast("string").alias("t"))
    spark = docs.sparkSession
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kestrel-tables/{uuid.uuid4().hex}"
    src.mapInArrow(run, "doc_id long, n long, ids binary").write.option("compression", "zstd").parquet(out)
    return spark.read.parquet(out)


def id_counts(tokens: DataFrame, width: str) -> DataFrame:
    """(id, n) over all documents; a task sends each id once."""
    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            got = np.bincount(np.frombuffer(b"".join(column(b, "ids").to_pylist()), width))
            if len(got) > len(total):
                got, total = total, got
            total[:len(got)] += got
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(docs: DataFrame, folder: str | None = None, doc_id: str = "doc_id", text: str = "text",
              path: str | None = None, end_id: int = 1) -> str:
    """Tokenises ``docs`` and writes the files; returns their folder.

    Documents lie in ascending doc_id order (null first; rows that share a
    doc_id by a hash of their ids). Null texts are empty documents; an
    empty table gives an empty codebook and no block. The global counts
    (at most one row per vocabulary id) are all that meets on the driver."""
    spark = docs.sparkSession
    path = path or default_path()
    width = "<u2" if id_bytes(path) == 2 else "<u4"
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/kestrel-tables/ids-{uuid.uuid4().hex}"
    tokens = token_table(docs, doc_id, text, path, end_id)
    counts = id_counts(tokens, width).orderBy("id").collect()
    ids = np.array([r["id"] for r in counts], np.int64)
    lengths = code_lengths(np.array([r["n"] for r in counts], np.int64))
    book = spark.createDataFrame([(int(i), int(n)) for i, n in zip(ids, lengths)], "id long, length int")
    book.coalesce(1).write.parquet(f"{folder}/codebook")
    code = spark.sparkContext.broadcast((ids, lengths))
    parts = max(1, -(-sum(r["n"] for r in counts) // PART_IDS))

    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        table = Code(*code.value)
        held, size, docs_, first, block = [], 0, [], 0, 0

        def flush():
            nonlocal held, size, docs_, first, block
            all_ids = np.frombuffer(b"".join(held), width)
            payload, marks = encode(table, all_ids)
            wide = "<u8" if len(payload) >= 1 << 29 else "<u4"
            row = (part, block, first, len(all_ids), payload, marks.astype(wide).tobytes(),
                   np.array([d or 0 for d, _ in docs_], "<i8").tobytes(), np.array([n for _, n in docs_], "<i8").tobytes(),
                   np.packbits([d is None for d, _ in docs_]).tobytes())
            first, block = first + len(all_ids), block + 1
            held, size, docs_ = [], 0, []
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, (
                pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5))],
                names=[c.split()[0] for c in BLOCK.split(", ")])

        for b in batches:
            for d, n, raw in zip(column(b, "doc_id").to_pylist(), column(b, "n").to_pylist(), column(b, "ids").to_pylist()):
                held.append(raw)
                docs_.append((d, n))
                size += n
                if size >= BLOCK_IDS:
                    yield flush()
        if docs_:
            yield flush()

    order = [F.col("doc_id"), F.xxhash64("ids")]
    (tokens.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, BLOCK)
     .write.option("compression", "none").parquet(f"{folder}/blocks"))
    return folder


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): the documents of a folder, decoded
    block by block; ids are little-endian unsigned 32-bit integers, start
    counts the ids of all documents before it."""
    book = spark.read.parquet(f"{folder}/codebook").orderBy("id").collect()
    code = spark.sparkContext.broadcast((np.array([r["id"] for r in book], np.int64),
                                         np.array([r["length"] for r in book], np.int64)))
    blocks = spark.read.schema(BLOCK).parquet(f"{folder}/blocks")
    per = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # one row per part; a table, so that its size decides how it is joined
    base = cut_lineage(per.select("part", F.coalesce(before, F.lit(0)).alias("base")))

    def run(batches):
        table = Code(*code.value)
        look = table.tables()
        for b in batches:
            rows = b.to_pylist()
            at, step = 0, 16
            while at < len(rows):
                some = rows[at:at + step]
                at += step
                marks = [np.frombuffer(r["checkpoints"], "<u8" if len(r["payload"]) >= 1 << 29 else "<u4") for r in some]
                ids = decode(table, [r["payload"] for r in some], marks, [r["n_ids"] for r in some], look)
                size = np.concatenate([np.frombuffer(r["sizes"], "<i8") for r in some])
                who = np.concatenate([np.frombuffer(r["doc_ids"], "<i8") for r in some])
                n_docs = [len(r["sizes"]) // 8 for r in some]
                null = np.concatenate([np.unpackbits(np.frombuffer(r["nulls"], np.uint8), count=n)
                                       for r, n in zip(some, n_docs)]).astype(bool)
                local = np.concatenate([[0], np.cumsum(size)])
                block0 = np.concatenate([[0], np.cumsum([r["n_ids"] for r in some])])[:-1]
                first = np.repeat([r["base"] + r["first"] for r in some] - block0, n_docs) + local[:-1]
                raw = ids.astype("<u4").tobytes()
                yield pa.record_batch(
                    [pa.array(who, mask=null), pa.array(first.astype(np.int64)), pa.array(size),
                     pa.array([raw[4 * a:4 * z] for a, z in zip(local[:-1].tolist(), local[1:].tolist())], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"])

    return blocks.join(base, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def digest(decoded: DataFrame) -> DataFrame:
    """The contract's columns."""
    return decoded.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
