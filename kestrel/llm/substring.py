"""Exact substring deduplication on a compacted de Bruijn graph (operator 3).

Edges are the token k-mers (windows of ``k`` words), nodes their (k-1)-word
overlaps; an edge is written as a 64-bit hash with its first source
coordinate, the smallest doc_id that holds it and its place there. Repeated
edges that follow one another without branching compact to paths along the
documents; ``paths`` cuts these at branching nodes by joins, for those who
ask for the graph (removal does not need it and does not run it). The
words of each path are compared between source and copy before anything is
removed.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.llm.common import (U64, bloom_contains, bloom_filter, column, encode_words, hash_strings, mix64,
                                odd_multipliers, planes, ragged_take, release, split_words, text_chunks, unplanes)
from kestrel.llm.native import fresh, plain, unplain
from kestrel.session import cut_lineage

#: Order of a null doc_id: after every other (shown as null in results).
NULL_ID = (1 << 63) - 1
#: Characters of text that one reducer's share of windows or texts comes from.
CHARS_PER_PART = 6 << 20
#: Bits of the fixed-size Bloom filter that thins the second reading of texts.
FILTER_BITS = 23


def window_hashes(words, offsets, k: int, hash_bits: int = 64):
    """Hashes of all k-word windows of a batch, the document index and the
    place of each, in text order."""
    codes, distinct = encode_words(words)
    wh = hash_strings(distinct)[codes]
    n = np.diff(offsets)
    per = np.maximum(n - k + 1, 0)
    doc = np.repeat(np.arange(len(n)), per)
    at = ragged_take(offsets[:-1], per)
    h = np.zeros(len(at), U64)
    if len(at):
        full = np.zeros(max(len(wh) - k + 1, 0), U64)
        for j, m in enumerate(odd_multipliers(k, 3)):
            full += wh[j:j + len(full)] * m
        h = mix64(full[at])
        if hash_bits < 64:     # tests: force collisions
            h = mix64(h >> U64(64 - hash_bits))
    return h, doc, at - offsets[:-1][doc]


def _ids(batch):
    """doc_ids with nulls as NULL_ID."""
    return column(batch, "d").fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _owner_pack(doc, edge, owner, place):
    """Claims as byte planes in one blob, ordered by document and place."""
    o = np.lexsort((place, owner, doc))
    doc, edge, owner, place = doc[o], edge[o], owner[o], place[o]
    step = np.diff(place, prepend=0)
    return [planes(np.diff(doc, prepend=0)), planes(edge), planes(np.diff(owner, prepend=0)), planes(step)]


def _owner_unpack(row):
    doc, edge, owner, place = row
    return (np.cumsum(unplanes(doc, np.int64)), unplanes(edge, U64), np.cumsum(unplanes(owner, np.int64)),
            np.cumsum(unplanes(place, np.int64)))


CLAIM = "part int, doc binary, edge binary, owner binary, place binary"


def _part_of(doc, parts: int):
    return (mix64(np.asarray(doc).astype(np.int64).view(U64)) % U64(parts)).astype(np.int64)


def _claim_rows(doc, edge, owner, place, parts):
    """One row of claims per part of the documents."""
    p = _part_of(doc, parts)
    rows = []
    for x in np.unique(p):
        m = p == x
        rows.append([int(x), *_owner_pack(doc[m], edge[m], owner[m], place[m])])
    return rows


def _batch(rows, schema_names):
    cols = list(zip(*rows)) if rows else [[] for _ in schema_names]
    arrays = [pa.array(cols[0], pa.int32())] + [pa.array(c, pa.binary()) for c in cols[1:]]
    return pa.record_batch(arrays, names=schema_names)


def _edges(k, bits, parts, hash_bits):
    """Map side of edge counting. Per cut of a few MB of text: every
    distinct edge once, with the smallest doc_id of the cut that holds it
    (map-side combine: an edge that a third of the documents share leaves a
    task a bounded number of times), and the claims that the cut itself
    already proves (a smaller doc_id of the cut holds the edge); these only
    pass through a bucket (``claim`` names their part)."""
    names = ["claim", "bucket", "edges", "doc", "gap", "edge", "owner", "place"]

    def run(batches):
        for b in text_chunks(batches, "t", 4 << 20):
            ids = _ids(b)
            b = b.take(pa.array(np.argsort(ids, kind="stable")))
            ids = np.sort(ids, kind="stable")
            words, off = split_words(column(b, "t"))
            h, doc, pos = window_hashes(words, off, k, hash_bits)
            if not len(h):
                continue
            order = np.argsort(h, kind="stable")
            hs = h[order]
            head = np.concatenate([[True], hs[1:] != hs[:-1]])
            rep = order[head][np.cumsum(head) - 1]           # first place of the edge in the cut
            same = np.empty(len(h), np.int64)
            same[order] = rep
            is_rep = same == np.arange(len(h))
            # edges, by bucket in text order
            at = np.flatnonzero(is_rep)
            # 16-bit numbers are sorted fastest; beyond 65 536 buckets they would wrap
            bucket = (h[at] >> U64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32) if bits else np.zeros(len(at), np.uint16)
            at = at[np.argsort(bucket, kind="stable")]
            bucket = (h[at] >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(at), np.int64)
            cut = np.searchsorted(bucket, np.arange((1 << bits) + 1))
            out = {n: [] for n in names}
            for x in np.flatnonzero(np.diff(cut)):
                a = at[cut[x]:cut[x + 1]]
                low = h[a].view(np.uint8).reshape(-1, 8)[:, :7 if bits >= 8 else 8]
                d = ids[doc[a]]
                gap = np.diff(pos[a], prepend=0)
                gap[np.flatnonzero(np.diff(doc[a], prepend=-1))] = pos[a][np.flatnonzero(np.diff(doc[a], prepend=-1))]
                for n, v in zip(names, (None, int(x), low.tobytes(), planes(np.diff(d, prepend=0)),
                                        planes(gap.astype(np.int32)), None, None, None)):
                    out[n].append(v)
            # claims within the cut
            e = np.flatnonzero(ids[doc] > ids[doc[same]])
            # an edge is claimed once per document
            e = e[np.unique(np.stack([ids[doc[e]].view(U64), h[e]]), axis=1, return_index=True)[1]] if len(e) else e
            for row in _claim_rows(ids[doc[e]], h[e], ids[doc[same[e]]], pos[same[e]], parts):
                for n, v in zip(names, (row[0], row[0] % (1 << bits), None, row[1], None, row[2], row[3], row[4])):
                    out[n].append(v)
            types = [pa.int32(), pa.int32()] + [pa.binary()] * 6
            yield pa.record_batch([pa.array(out[n], t) for n, t in zip(names, types)], names=names)
    return run


def _owners(bits, parts):
    """Reduce side of edge counting: for a bucket of edges, the claims of
    all documents but the smallest that holds the edge; claims that need
    no bucket go through."""
    def run(table):
        release()
        hs, ds, ps = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        bucket = table.column("bucket")[0].as_py()
        through = table.filter(pc.is_valid(table.column("claim"))).select(["claim", "doc", "edge", "owner", "place"])
        table = table.filter(pc.is_valid(table.column("edges")))
        for e, d, g in zip(*(table.column(n).to_pylist() for n in ("edges", "doc", "gap"))):
            width = 7 if bits >= 8 else 8
            raw = np.frombuffer(e, np.uint8).reshape(-1, width)
            h = np.zeros((len(raw), 8), np.uint8)
            h[:, :width] = raw
            doc = np.cumsum(unplanes(d, np.int64))
            gap = unplanes(g, np.int32).astype(np.int64)
            start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            run_ = np.cumsum(gap)
            pos = run_ - np.repeat(run_[start] - gap[start], np.diff(np.append(start, len(doc))))
            hs.append(h.view(U64).ravel())
            ds.append(doc)
            ps.append(pos)
        h, doc, pos = np.concatenate(hs), np.concatenate(ds), np.concatenate(ps)
        del hs, ds, ps
        order = np.argsort(h, kind="stable")
        h, doc, pos = h[order], doc[order], pos[order]
        same = h[1:] == h[:-1]
        rep = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
        h, doc, pos = h[rep], doc[rep], pos[rep]
        order = np.lexsort((pos, doc, h))
        h, doc, pos = h[order], doc[order], pos[order]
        head = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        first = np.flatnonzero(head)[np.cumsum(head) - 1] if len(h) else np.zeros(0, np.int64)
        m = doc > doc[first]
        if bits >= 8:      # the top byte of an edge is that of its bucket
            h = h | (U64(bucket >> (bits - 8)) << U64(56))
        rows = _claim_rows(doc[m], h[m], doc[first[m]], pos[first[m]], parts)
        cols = list(zip(*rows)) if rows else [[]] * 5
        names = ["part", "doc", "edge", "owner", "place"]
        found = pa.table([pa.array(cols[0], pa.int32())] + [pa.array(c, pa.binary()) for c in cols[1:]], names=names)
        return pa.concat_tables([found, through.rename_columns(names).cast(found.schema)])
    return run


BLOB = "part int, doc binary, size binary, texts binary, more binary"


def _texts(parts, keep=None, bits=FILTER_BITS, carry=()):
    """Documents dealt to parts as compressed blobs (ids, byte lengths,
    texts, an Arrow table of the carried columns); ``keep`` is a Bloom
    filter of wanted ids. A long text leaves in a blob of its own cut."""
    filt = keep

    def run(batches):
        for b in text_chunks(batches, "t", 4 << 20):
            ids = _ids(b)
            if filt is not None:
                m = bloom_contains(filt.value, ids, bits)
                if not m.any():
                    continue
                b, ids = b.filter(pa.array(m)), ids[m]
            p = _part_of(ids, parts)
            texts = column(b, "t")
            out = []
            for x in np.unique(p):
                at = np.flatnonzero(p == x)
                raw = [(t or "").encode() for t in texts.take(pa.array(at)).to_pylist()]
                null = np.array([not v for v in texts.take(pa.array(at)).is_valid().to_pylist()])
                size = np.array([len(r) for r in raw], np.int64)
                more = None
                if carry:
                    sink = pa.BufferOutputStream()
                    table = pa.table([column(b, c).take(pa.array(at)) for c in carry], names=list(carry))
                    with pa.ipc.new_stream(sink, table.schema) as w:
                        w.write_table(table)
                    more = zlib.compress(sink.getvalue(), 1)
                out.append((int(x), ids[at].tobytes(), np.where(null, -1, size).tobytes(),
                            zlib.compress(b"".join(raw), 1), more))
            yield pa.record_batch([pa.array([o[0] for o in out], pa.int32())] +
                                  [pa.array([o[i] for o in out], pa.binary()) for i in (1, 2, 3, 4)],
                                  names=["part", "doc", "size", "texts", "more"])
    return run


def _unpack_texts(table):
    """ids, texts (null texts stay null) and carried columns of a part."""
    ids, texts, more = [], [], []
    for d, s, t, m in zip(*(table.column(n).to_pylist() for n in ("doc", "size", "texts", "more"))):
        if t is None:
            continue
        ids.append(np.frombuffer(d, np.int64))
        raw, at = zlib.decompress(t), 0
        for n in np.frombuffer(s, np.int64).tolist():
            texts.append(None if n < 0 else raw[at:at + n].decode())
            at += max(n, 0)
        if m is not None:
            more.append(pa.ipc.open_stream(zlib.decompress(m)).read_all())
    return (np.concatenate(ids) if ids else np.zeros(0, np.int64)), texts, pa.concat_tables(more) if more else None


def _digest(words):
    return hashlib.blake2b(b"\x1f".join(words), digest_size=16).digest()


def _covered(claimed, n, k):
    """Words covered by claimed window places."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, claimed, 1)
    np.add.at(step, np.minimum(claimed + k, n), -1)
    return np.cumsum(step)[:n] > 0


def _resolve(k, hash_bits, with_text, carry):
    """Per part of the documents: claims meet texts. Claimed places that
    follow one another here and in their source compact to one span; the
    words under spans go. Emits a result row per document (kind 0) and a
    row per span (kind 1) with the digest of its words."""
    def run(table):
        release()
        doc, edge, owner, place = [], [], [], []
        for row in zip(*(table.column(n).to_pylist() for n in ("doc", "edge", "owner", "place"))):
            if row[1] is not None:
                for lst, v in zip((doc, edge, owner, place), _owner_unpack(row)):
                    lst.append(v)
        ids, texts, more = _unpack_texts(table)
        if doc:
            doc, edge, owner, place = (np.concatenate(x) for x in (doc, edge, owner, place))
            o = np.lexsort((place, owner, edge, doc))
            doc, edge, owner, place = doc[o], edge[o], owner[o], place[o]
            # of several claims on an edge of a document the smallest source counts
            head = np.concatenate([[True], (doc[1:] != doc[:-1]) | (edge[1:] != edge[:-1])])
            doc, edge, owner, place = doc[head], edge[head], owner[head], place[head]
        else:
            doc, edge, owner, place = (np.zeros(0, t) for t in (np.int64, U64, np.int64, np.int64))
        lo, hi = np.searchsorted(doc, ids), np.searchsorted(doc, ids, "right")
        res = {n: [] for n in ("kind", "doc_id", "n_words", "n_removed", "kept_sha256", "kept", "start", "windows",
                               "owner", "place", "digest")}

        source = []                     # of each row: its document, for the carried columns

        def emit(of=None, **v):
            source.append(of)
            for n, lst in res.items():
                lst.append(v.get(n))

        step = 512
        for s in range(0, len(ids), step):
            some = range(s, min(s + step, len(ids)))
            words, off = split_words(pa.array([texts[i] for i in some], pa.large_string()).cast(pa.string())
                                     if sum(len(texts[i] or "") for i in some) < 1 << 28 else
                                     pa.array([texts[i] for i in some], pa.large_string()))
            raw = words.cast(pa.large_binary()).to_pylist()
            h = where = None
            if (hi[s:s + step] > lo[s:s + step]).any():
                h, where, _ = window_hashes(words, off, k, hash_bits)
                first = np.searchsorted(where, np.arange(len(off)))
            for j, i in enumerate(some):
                w = raw[off[j]:off[j + 1]]
                d = int(ids[i])
                gone = 0
                if hi[i] > lo[i]:
                    mine = h[first[j]:first[j + 1]]
                    claims = edge[lo[i]:hi[i]]
                    x = np.searchsorted(claims, mine)
                    x[x == len(claims)] = 0
                    at = np.flatnonzero(claims[x] == mine)
                    if len(at):
                        x = x[at] + lo[i]
                        cut = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(owner[x]) != 0) |
                                                             (np.diff(place[x]) != 1)]))
                        size = np.diff(np.append(cut, len(at)))
                        for c, m in zip(cut.tolist(), size.tolist()):
                            p = int(at[c])
                            emit(kind=1, doc_id=d, start=p, windows=m, owner=int(owner[x[c]]), place=int(place[x[c]]),
                                 digest=_digest(w[p:p + m + k - 1]))
                        drop = _covered(at, len(w), k)
                        gone = int(drop.sum())
                        w = [v for v, g in zip(w, drop.tolist()) if not g]
                joined = b" ".join(w)
                kept = None if not with_text else texts[i] if not gone else joined.decode()
                emit(i, kind=0, doc_id=d, n_words=int(off[j + 1] - off[j]), n_removed=gone,
                     kept_sha256=hashlib.sha256(joined).hexdigest(), kept=kept)
        types = dict(zip(res, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(),
                               pa.int64(), pa.int64(), pa.int64(), pa.binary())))
        cols = [pa.array(v, types[n]) for n, v in res.items()]
        at = pa.array(source, pa.int64())
        if carry and more is None:                 # claims alone, no document: no row
            return pa.table([*cols, *[pa.nulls(0)] * len(carry)], names=[*res, *carry])
        cols += [more.column(c).combine_chunks().take(at) for c in carry]
        return pa.table(cols, names=[*res, *carry])
    return run


RESOLVED = ("kind int, doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, start long, "
            "windows long, owner long, place long, digest binary")


def _check(k):
    """Per part of the sources: which asked paths (source, place, windows,
    digest) do not hold the words they are said to hold."""
    def run(table):
        release()
        asked = table.column("asked").to_pylist()
        rows = [a for a in asked if a is not None]
        ids, texts, _ = _unpack_texts(table)
        held = {}
        for i, d in enumerate(ids.tolist()):
            held.setdefault(d, []).append(i)
        good, words = set(), {}
        for n, a in enumerate(rows):
            for i in held.get(a["owner"], ()):
                if i not in words:
                    if len(words) > 256:
                        words.clear()
                    words[i] = split_words(pa.array([texts[i]], pa.large_string()))[0].cast(pa.large_binary()).to_pylist()
                p = a["place"]
                if _digest(words[i][p:p + a["windows"] + k - 1]) == a["digest"]:
                    good.add(n)
                    break
        bad = [a for n, a in enumerate(rows) if n not in good]
        return pa.table([pa.array([a["owner"] for a in bad], pa.int64()), pa.array([a["place"] for a in bad], pa.int64()),
                         pa.array([a["windows"] for a in bad], pa.int64()),
                         pa.array([a["digest"] for a in bad], pa.binary())],
                        names=["owner", "place", "windows", "digest"])
    return run


def _part_counts(docs):
    """Number of parts for edges (a power of two) and for texts: both grow
    with the characters read, so a part's size does not."""
    chars = docs.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-chars // CHARS_PER_PART))
    return max(int(n - 1).bit_length(), 0), n


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 13,
                   with_text: bool = False, hash_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(results, spans).

    results: one row per input row: doc_id, n_words, n_removed,
    kept_sha256; ``with_text`` instead the input's columns, whatever they
    are, with the kept text (the input text where no word goes; else the
    kept words joined by a space) and n_removed as the last column, under a
    name that no column has. A word goes if a
    window of ``k`` words over it also starts in a document with a smaller
    doc_id.
    spans: doc_id, start, windows, owner, place: the compacted repeats, each
    with the source coordinate it was verified against.

    Words are runs without ASCII white space. Null or blank texts have no
    words; texts shorter than k no windows. A null doc_id counts as larger
    than any other. Rows that share a doc_id never remove words from each
    other. Empty tables give empty results."""
    spark = docs.sparkSession
    others = [c for c in docs.columns if c != text] if with_text else []
    carry = [f"c{i}" for i in range(len(others))]
    full = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).cast("string").alias("t"),
                       *[plain(docs[c], docs.schema[c].dataType).alias(a) for c, a in zip(others, carry)])
    src = full.select("d", "t")
    bits, parts = _part_counts(src)
    mapped = src.mapInArrow(_edges(k, bits, parts, hash_bits),
                            "claim int, bucket int, edges binary, doc binary, gap binary, edge binary, owner binary, "
                            "place binary")
    claims = mapped.repartition(1 << bits, "bucket").groupBy("bucket").applyInArrow(_owners(bits, parts), CLAIM)
    none = [F.lit(None).cast("binary").alias(n) for n in ("size", "texts", "more")]
    texts = full.mapInArrow(_texts(parts, carry=carry), BLOB)
    null = {n: F.lit(None).cast("binary").alias(n) for n in ("edge", "owner", "place")}
    together = (claims.select("part", "doc", "edge", "owner", "place", *none)
                .unionByName(texts.select("part", "doc", *null.values(), "size", "texts", "more")))
    shape = T.StructType([*T.StructType.fromDDL(RESOLVED).fields, *[T.StructField(a, full.schema[a].dataType) for a in carry]])
    resolved = cut_lineage(together.repartition(parts, "part").groupBy("part")
                           .applyInArrow(_resolve(k, hash_bits, with_text, carry), shape))
    spans = resolved.where("kind = 1").select("doc_id", "start", "windows", "owner", "place", "digest")
    failed = _failed(spark, src, spans, parts, k)
    if not failed.isEmpty():
        resolved = _repair(spark, full, resolved, spans, failed, k, with_text, hash_bits, carry, shape)
        spans = resolved.where("kind = 1").select("doc_id", "start", "windows", "owner", "place", "digest")
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    rows = resolved.where("kind = 0")
    if with_text:
        name = dict(zip(others, carry))
        results = rows.select(*[unplain(F.col(name[c]), docs.schema[c].dataType).alias(c) if c in name else F.col("kept").alias(c)
                                for c in docs.columns], F.col("n_removed").alias(f"{fresh(docs)}removed"))
    else:
        results = rows.select(back("doc_id"), "n_words", "n_removed", "kept_sha256")
    return results, spans.select(back("doc_id"), "start", "windows", back("owner"), "place")


def _failed(spark, src, spans, parts, k):
    """Paths whose source does not hold their words (hash collisions)."""
    asked = cut_lineage(spans.select("owner", "place", "windows", "digest").distinct())
    keep = spark.sparkContext.broadcast(bloom_filter(asked, "owner", FILTER_BITS))
    texts = src.mapInArrow(_texts(parts, keep), BLOB)

    def dealt(batches):
        for b in batches:
            yield pa.record_batch([pa.array(_part_of(column(b, "owner").to_numpy(), parts).astype(np.int32)),
                                   pa.StructArray.from_arrays([column(b, n) for n in b.schema.names],
                                                              names=b.schema.names)], names=["part", "asked"])

    ask = "struct<owner: long, place: long, windows: long, digest: binary>"
    rows = asked.mapInArrow(dealt, f"part int, asked {ask}")
    both = (rows.select("part", "asked", *[F.lit(None).cast("binary").alias(n) for n in ("doc", "size", "texts", "more")])
            .unionByName(texts.select("part", F.lit(None).cast(ask).alias("asked"), "doc", "size", "texts", "more")))
    return cut_lineage(both.repartition(parts, "part").groupBy("part").applyInArrow(
        _check(k), "owner long, place long, windows long, digest binary"))


def _repair(spark, src, resolved, spans, failed, k, with_text, hash_bits, carry, shape_):
    """Exact verdicts for documents with a span that failed: their claimed
    windows are looked up by their words instead of their hash."""
    bad = spans.join(failed, ["owner", "place", "windows", "digest"], "left_semi").select("doc_id").distinct()
    bad = cut_lineage(bad)

    def windows(wanted):
        def run(batches):
            for b in text_chunks(batches, "t", 1 << 20):
                ids = _ids(b)
                words, off = split_words(column(b, "t"))
                h, doc, pos = window_hashes(words, off, k, hash_bits)
                m = np.arange(len(h)) if wanted is None else np.flatnonzero(bloom_contains(wanted.value, h.view(np.int64), FILTER_BITS))
                raw = words.to_pylist()
                start = off[:-1][doc[m]] + pos[m]
                yield pa.record_batch([pa.array(ids[doc[m]]), pa.array(h[m].view(np.int64)),
                                       pa.array([" ".join(raw[x:x + k]) for x in start.tolist()], pa.string()),
                                       pa.array(pos[m].astype(np.int64))], names=["d", "h", "seq", "pos"])
        return run

    shape = "d long, h long, seq string, pos long"
    d = F.coalesce("d", F.lit(NULL_ID))
    theirs = src.join(bad, d == bad.doc_id, "left_semi")
    mine = cut_lineage(theirs.mapInArrow(windows(None), shape).select("d", "h", "seq", "pos"))
    wanted = spark.sparkContext.broadcast(bloom_filter(mine, "h", FILTER_BITS))
    first = (src.mapInArrow(windows(wanted), shape)
             .groupBy("h", "seq").agg(F.min(F.struct("d", "pos")).alias("o")))
    exact = (mine.join(first, ["h", "seq"]).where("o.d < d")
             .select("d", "h", "seq", F.col("o.d").alias("owner"), F.col("o.pos").alias("place")))

    def redo(key, docs_, claims):
        ids, texts = column(docs_, "d").to_pylist(), column(docs_, "t").to_pylist()
        owner = {s: (o, p) for s, o, p in zip(*(claims.column(n).to_pylist() for n in ("seq", "owner", "place")))}
        out, source = [], []
        for n, (i, t) in enumerate(zip(ids, texts)):
            w = split_words(pa.array([t], pa.string()))[0].to_pylist()
            at = [x for x in range(len(w) - k + 1) if " ".join(w[x:x + k]) in owner]
            for x in at:
                o, p = owner[" ".join(w[x:x + k])]
                out.append((1, i, None, None, None, None, x, 1, o, p, _digest([v.encode() for v in w[x:x + k]])))
            drop = _covered(np.array(at, np.int64), len(w), k)
            left = " ".join(v for v, g in zip(w, drop.tolist()) if not g)
            out.append((0, i, len(w), int(drop.sum()), hashlib.sha256(left.encode()).hexdigest(),
                        None if not with_text else left if drop.any() else t, None, None, None, None, None))
            source += [None] * len(at) + [n]
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(),
                 pa.int64(), pa.int64(), pa.binary())
        at = pa.array(source, pa.int64())
        cols = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
        return pa.table(cols + [column(docs_, c).take(at) for c in carry],
                        names=[c.split()[0] for c in RESOLVED.split(", ")] + carry)

    fixed = (theirs.select(d.alias("d"), "t", *carry).groupBy("d")
             .cogroup(exact.groupBy("d")).applyInArrow(redo, shape_))
    return cut_lineage(resolved.join(bad, "doc_id", "left_anti").unionByName(fixed))


def paths(spans: DataFrame) -> DataFrame:
    """The compacted graph: maximal nonbranching paths of repeated edges.

    A span is a walk over the edges place .. place+windows-1 of its owner.
    A node of the owner branches where a walk enters or leaves it, so the
    walks' ends cut each other: the cut nodes of an owner (grouped by
    partial aggregation, distinct) are joined to the walks, and a walk
    becomes one path per pair of neighbouring cuts inside it. Returns owner,
    place, windows (edges of the path) and n_copies (walks over it)."""
    ends = (spans.select("owner", F.explode(F.array("place", F.col("place") + F.col("windows"))).alias("node"))
            .distinct())
    cuts = ends.groupBy("owner").agg(F.sort_array(F.collect_set("node")).alias("nodes"))   # at most a node per word
    walk = spans.groupBy("owner", "place", "windows").agg(F.count("*").alias("n")).join(cuts, "owner")
    inside = F.expr("filter(nodes, x -> x >= place AND x <= place + windows)")
    piece = walk.select("owner", "n", inside.alias("c")).select(
        "owner", "n", F.explode(F.expr("transform(sequence(0, size(c) - 2), i -> struct(c[i] AS place, c[i + 1] - c[i] AS windows))")).alias("p"))
    return piece.groupBy("owner", "p.place", "p.windows").agg(F.sum("n").alias("n_copies"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 13,
                   n_chars: str | None = None) -> DataFrame:
    """``docs`` with the repeated words taken out of the texts (a text may
    be left empty; the row stays); ``n_chars`` names a length column to
    bring up to date. Null and blank texts stay as they are, a null doc_id
    counts as larger than any other, rows of one doc_id take no words from
    each other; columns may have any name and type; an empty table gives an
    empty result."""
    out = repeated_spans(docs, doc_id, text, k, with_text=True)[0]
    if n_chars:
        size = F.when(F.col(out.columns[-1]) > 0, F.length(text)).otherwise(F.col(n_chars))
        out = out.withColumn(n_chars, size.cast(docs.schema[n_chars].dataType))
    return out.select(*docs.columns)


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per input row; see
    ``repeated_spans``."""
    return repeated_spans(docs, doc_id, text, k)[0]


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS seq
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY seq) AS first FROM win) WHERE first < doc_id),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM gone),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS v FROM d),
kept AS (SELECT word.doc_id, string_agg(v, ' ' ORDER BY word.p) AS t, count(*) AS n
         FROM word LEFT JOIN hit ON word.doc_id = hit.doc_id AND word.p = hit.p WHERE hit.p IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
