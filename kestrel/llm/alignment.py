"""Alignment of two tokenizers' tokens by diagonal run skipping (operator 11).

Both tokenizers cut the same bytes; where a token of each ends at the same
byte, the text falls into groups. The end arrays are compared at the current
index shift: exponential probing jumps over one-to-one stretches, and where
the arrays part, the irregular group is resolved token by token and the
shift moves on.

Neither tokenizer merges across a space that follows a character other than
white space, so a text's tokens and groups are those of its segments (cut
there) one after another. A worker encodes and aligns every distinct segment
once and spreads the results by numpy.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
import uuid
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import (bound_batches, column, encode_words, planes, ragged_take, release, segment_sum,
                                text_chunks, unplanes)
from kestrel.session import cut_lineage

SPACE = "▁"
#: Segments, and tokens in them, above which a worker forgets what few cuts
#: have asked for, before the next cut.
CACHE, CACHE_TOKENS = 150_000, 1_000_000
#: Segments that are encoded and aligned at a time.
LEARN = 1 << 14
#: Rows of a cut, and of a batch of the Parquet reader.
CUT_ROWS, READER_ROWS = 10_000, 512


def default_paths() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def align(a, b):
    """The groups of two rising end arrays with the same last end: arrays of
    the groups' first places in ``a`` and in ``b``.

    At the current shift, slices of doubling length are compared (and
    halved after the first that differs), so a one-to-one stretch of n
    tokens takes O(log n) comparisons."""
    x, y = a.tolist(), b.tolist()
    i = j = 0
    n = len(x)
    at_a, at_b, size = [], [], []
    while i < n:
        first, second, step, rising = i, j, 1, True
        while step and i < n:
            piece = x[i:i + step]
            if piece == y[j:j + step]:
                i += len(piece)
                j += len(piece)
            else:
                rising = False
            step = step << 1 if rising else step >> 1
        if i > first:
            at_a.append(first)
            at_b.append(second)
            size.append(i - first)
        if i < n:                       # an irregular group: the end that lies behind moves on
            at_a.append(i)
            at_b.append(j)
            size.append(1)
            end, other = x[i], y[j]
            while end != other:
                if end < other:
                    i += 1
                    end = x[i]
                else:
                    j += 1
                    other = y[j]
            i += 1
            j += 1
    return ragged_take(at_a, size), ragged_take(at_b, size)


def links(a, b):
    """Places in ``a`` and ``b`` of the overlapping token pairs: each byte
    range between neighbouring ends of either array lies in one token of
    each, and no two ranges in the same two tokens."""
    ends = np.sort(np.concatenate([a, b]), kind="stable")
    ends = ends[np.append(ends[1:] != ends[:-1], True)] if len(ends) else ends
    return np.searchsorted(a, ends), np.searchsorted(b, ends)


def _cut_places(raw, start, end):
    """Places of spaces that follow a character other than white space and
    have another byte than a space behind them in their document. Characters
    that might be white space beyond ASCII count as such; documents own
    raw[start[i]:end[i]]."""
    space = raw == 0x20
    last = np.arange(len(raw), dtype=np.int32)                   # of each byte, the last other than a space up to it
    last[space] = -1
    np.maximum.accumulate(last, out=last)
    before = np.zeros((3, len(raw)), np.uint8)
    for k in range(3):
        before[k, k + 1:] = raw[:-k - 1]
    one, two, three = before
    white = (one <= 0x20) | ((two == 0xC2) & ((one == 0x85) | (one == 0xA0)))
    white |= ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE1) & (two == 0x9A)) | ((three == 0xE3) & (two == 0x80))
    at = np.flatnonzero(space & ~white)
    doc = np.searchsorted(start, at, "right") - 1
    return at[(at > start[doc]) & (at < last[end[doc] - 1])]


#: A space, Latin letters and then ASCII marks: to A's splitter the letters
#: are one chunk and the marks another (an apostrophe first could be a
#: contraction).
_PLAIN = re.compile("( [A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([!-&(-/:-@\\[-`{-~][!-/:-@\\[-`{-~]*)?")


class Aligner:
    """Tokens, groups and links of the segments of texts under a byte-level
    BPE file (A) and a SentencePiece file (B)."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        from kestrel.llm.tokens import _byte_letters
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.merge, self.letters = self.a.model.tokenize, _byte_letters()
        byte_of = {c: x for x, c in self.letters.items()}
        vocab = {i: bytes(byte_of[c] for c in w) if all(c in byte_of for c in w) else w.encode()
                 for w, i in self.a.get_vocab().items()}
        bytes_a = pa.array([vocab.get(i, b"") for i in range(max(vocab) + 1)], pa.binary())
        bytes_b = pa.array([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
                            for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))], pa.binary())
        self.bytes = {"a": bytes_a, "b": bytes_b}
        self.width = {k: pc.binary_length(v).to_numpy(zero_copy_only=False).astype(np.int64) for k, v in self.bytes.items()}
        ids = pa.array(range(max(len(bytes_a), len(bytes_b)))).cast(pa.string())
        self.names = pa.concat_arrays([pc.binary_join_element_wise(ids, end, "") for end in ",|;"])   # each id with what follows it
        self.ints = list(range(len(bytes_a)))                    # one object for each id that is kept
        self.clear()

    def clear(self):
        self.known, self.good, self.chunks = pa.array([], pa.string()), np.zeros(0, bool), {}
        self.label = pa.array([], pa.string())                   # the segment's groups as text
        self.asked = np.zeros(0, np.int32)                       # cuts that asked for it, halved when others are forgotten
        self.flat = {k: np.zeros(0, np.int64 if k == "link" else np.int32) for k in ("a", "b", "ga", "gb", "link")}
        self.size = {k: np.zeros(0, np.int32) for k in self.flat}

    def forget(self):
        """Keeps the segments most often asked for, up to half of the bounds."""
        keep = np.argsort(-self.asked, kind="stable")[:CACHE // 2]
        tokens = np.cumsum(np.maximum(self.size["a"], self.size["b"])[keep], dtype=np.int64)
        keep = np.sort(keep[tokens <= CACHE_TOKENS // 2])
        kept = {k: self.take(k, keep)[0] for k in self.flat}
        at = pa.array(keep)
        known, label, good, asked = self.known.take(at), self.label.take(at), self.good[keep], self.asked[keep] // 2
        size = {k: v[keep] for k, v in self.size.items()}
        self.clear()
        self.known, self.label, self.good, self.asked, self.flat, self.size = known, label, good, asked, kept, size

    def _chunk(self, w: str):
        """A's ids of one chunk of its splitter."""
        got = self.chunks.get(w)
        if got is None:
            ints = self.ints
            got = self.chunks[w] = tuple([ints[t.id] for t in self.merge(w.encode().decode("latin-1").translate(self.letters))])
        return got

    def _encode_a(self, texts):
        out, rest, plain, chunk = [None] * len(texts), [], _PLAIN.fullmatch, self._chunk
        for i, t in enumerate(texts):
            m = plain(t)
            if m is None:
                rest.append(i)
            else:
                body, tail = m.groups()
                out[i] = chunk(body) + chunk(tail) if tail else chunk(body)
        for i, e in zip(rest, self.a.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def _learn(self, names):
        """Encodes and aligns segments met for the first time, LEARN at a
        time: what they take meanwhile is many times what is kept of them."""
        parts = [self._aligned(names.slice(i, LEARN)) for i in range(0, len(names), LEARN)]
        self.known = pa.concat_arrays([self.known, names])
        self.asked = np.concatenate([self.asked, np.zeros(len(names), np.int32)])
        self.good = np.concatenate([self.good, *(x[0] for x in parts)])
        self.label = pa.concat_arrays([self.label, *(x[1] for x in parts)])
        for k in self.flat:
            self.flat[k] = np.concatenate([self.flat[k], *(x[2].pop(k) for x in parts)])
            self.size[k] = np.concatenate([self.size[k], *(x[3].pop(k) for x in parts)])

    def _aligned(self, names):
        """Of some segments: whether both spell them, their groups as text,
        and flat values and sizes of each kind."""
        on = gc.isenabled()
        gc.disable()                    # hundreds of thousands of small lists, none of them cyclic
        texts, n = names.to_pylist(), len(names)
        lists = {"a": self._encode_a(texts), "b": self.b.encode([t[1:] for t in texts], num_threads=1)}
        size = {k: np.fromiter(map(len, x), np.int64, n) for k, x in lists.items()}
        flat = {k: np.fromiter(chain.from_iterable(x), np.int64, int(size[k].sum())) for k, x in lists.items()}
        del lists, texts
        if on:
            gc.enable()
        length = pc.binary_length(names).to_numpy(zero_copy_only=False).astype(np.int64)
        raw = names.cast(pa.binary())
        good = np.ones(n, bool)
        for k in "ab":                  # both spell the segment
            spans = np.concatenate([[0], np.cumsum(size[k])])
            good &= segment_sum(self.width[k][flat[k]], spans) == length
            spelled = pc.binary_join(pa.ListArray.from_arrays(pa.array(spans.astype(np.int32)), self.bytes[k].take(pa.array(flat[k]))), b"")
            good &= pc.equal(spelled, raw).to_numpy(zero_copy_only=False)
        if not good.all():
            for k in "ab":
                flat[k] = flat[k][np.repeat(good, size[k])]
                size[k] = np.where(good, size[k], 0)
        # one end array over all new segments: a segment's end is an end of both
        end = {k: np.cumsum(self.width[k][flat[k]]) for k in "ab"}
        stop = {k: np.cumsum(size[k]) for k in "ab"}
        ga, gb = align(end["a"], end["b"])
        la, lb = links(end["a"], end["b"])
        owner = np.searchsorted(stop["a"], ga, "right")          # the segment of each group
        size["ga"] = size["gb"] = np.bincount(owner, minlength=n)
        # the groups as text: of each group A's ids, then B's, each with what follows it
        count = {k: np.diff(np.append(g, len(flat[k]))) for k, g in (("a", ga), ("b", gb))}
        place = {k: 2 * np.repeat(np.arange(len(ga)), c) + (k == "b") for k, c in count.items()}
        order = np.argsort(np.concatenate([place["a"], place["b"]]), kind="stable")
        after = {k: np.zeros(len(flat[k]), np.int64) for k in "ab"}
        after["a"][np.cumsum(count["a"]) - 1], after["b"][np.cumsum(count["b"]) - 1] = 1, 2
        which = np.concatenate([flat[k] + after[k] * (len(self.names) // 3) for k in "ab"])[order]
        spans = np.concatenate([[0], np.cumsum(size["a"] + size["b"])]).astype(np.int32)
        label = pc.binary_join(pa.ListArray.from_arrays(pa.array(spans), self.names.take(pa.array(which))), "")
        flat["ga"] = ga - np.concatenate([[0], stop["a"]])[owner]    # places within the segment
        flat["gb"] = gb - np.concatenate([[0], stop["b"]])[owner]
        flat["link"] = (flat["a"][la] << 32) | flat["b"][lb]
        size["link"] = np.bincount(np.searchsorted(stop["a"], la, "right"), minlength=n)
        return good, label, {k: flat[k].astype(v.dtype) for k, v in self.flat.items()}, {k: v.astype(np.int32) for k, v in size.items()}

    def documents(self, texts):
        """Of a string array: (codes, off, at) - document i is the distinct
        segments ``at[codes[off[i]:off[i + 1]]]`` of what is known now;
        documents without tokens own none."""
        texts = pc.fill_null(texts, "")
        full = pc.not_equal(texts, "")
        spaced = pc.if_else(full, pc.binary_join_element_wise("", texts, " "), "")
        if len(self.known) > CACHE or max(len(self.flat["a"]), len(self.flat["b"])) > CACHE_TOKENS:
            self.forget()
        spaced = pa.concat_arrays([spaced])                      # offsets from 0
        bound = np.frombuffer(spaced.buffers()[1], np.int32)[:len(spaced) + 1] if len(spaced) else np.zeros(1, np.int32)
        if bound[-1] == bound[0]:
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64)
        data = spaced.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[:bound[-1]]
        start, end = bound[:-1], bound[1:]
        some = end > start
        at = np.sort(np.concatenate([start[some], _cut_places(raw, start[some], end[some])])).astype(np.int32)
        segments = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, bound[-1]).astype(np.int32)), data)
        codes, distinct = encode_words(segments)
        off = np.searchsorted(at, bound)
        where = pc.index_in(distinct, value_set=self.known)
        new = where.is_null()
        first = len(self.known)
        if pc.any(new).as_py():
            self._learn(distinct.filter(new))
        where = where.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        new = new.to_numpy(zero_copy_only=False)
        where[new] = first + np.arange(new.sum())
        self.asked[where] += 1
        bad = segment_sum((~self.good[where])[codes].astype(np.int64), off) > 0
        if bad.any():                                            # a text whose bytes differ has no tokens
            codes = codes[np.repeat(~bad, np.diff(off))]
            off = np.concatenate([[0], np.cumsum(np.where(bad, 0, np.diff(off)))])
        return codes, off, where

    def take(self, kind: str, segments):
        """Flat values of ``kind`` of known segments, and offsets."""
        size = self.size[kind][segments].astype(np.int64)
        start = (np.cumsum(self.size[kind], dtype=np.int64) - self.size[kind])[segments]
        return self.flat[kind][ragged_take(start, size)], np.concatenate([[0], np.cumsum(size)])


_ALIGNERS: dict = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner for two vocabulary files."""
    key = (path_a, path_b)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*key)
    return _ALIGNERS[key]


def _source(docs, doc_id, text):
    return docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).cast("string").alias("t"))


def alignments(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path_a: str | None = None,
               path_b: str | None = None) -> DataFrame:
    """One row per input row: doc_id, a_ids and b_ids (the ids of both
    tokenizers), group_a and group_b (each group's first place in them).

    A reads a space and the text; B adds that space itself. Texts that are
    null or empty, or whose tokens do not spell space and text byte for byte
    (such as texts that hold U+2581), have empty arrays. Repeated rows come
    back as often and a null doc_id stays; nothing is shuffled. An empty
    table gives an empty result."""
    default = default_paths()
    paths = path_a or default[0], path_b or default[1]

    def run(batches):
        tool = aligner(*paths)
        for batch in text_chunks(batches, "t", 1 << 20):
            codes, off, at = tool.documents(column(batch, "t"))
            segments = at[codes]
            out = [column(batch, "d")]
            for ids, places in (("a", "ga"), ("b", "gb")):
                flat, cut = tool.take(ids, segments)
                base = cut[:-1] - np.repeat(cut[off[:-1]], np.diff(off))     # of a segment within its document
                group, gcut = tool.take(places, segments)
                group = group + np.repeat(base, np.diff(gcut))
                out += [pa.ListArray.from_arrays(pa.array(o[off].astype(np.int32)), pa.array(v.astype(np.int32)))
                        for v, o in ((flat, cut), (group, gcut))]
            yield pa.record_batch([out[0], out[1], out[3], out[2], out[4]], names=["doc_id", "a_ids", "b_ids", "group_a", "group_b"])

    return _source(docs, doc_id, text).mapInArrow(
        run, "doc_id long, a_ids array<int>, b_ids array<int>, group_a array<int>, group_b array<int>")


_CUT = ("cut long, doc array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
        "sha array<string>, words binary, off binary, pair_of binary, pair_off binary, pairs array<long>, n array<long>")


def _bound(spark):
    """Lowers the session's batches of rows: a cut is put together from
    many, and the executor holds each of them several times."""
    bound_batches(spark, size="1m")
    rows = "spark.sql.parquet.columnarReaderBatchSize"
    spark.conf.set(rows, str(min(int(spark.conf.get(rows)), READER_ROWS)))


def _gathered(batches, limit):
    """Rows of the session's batches put together, or cut, to ``limit`` bytes
    of text (a longer text stands alone) and CUT_ROWS rows."""
    held, total, rows = [], 0, 0
    for part in text_chunks(batches, "t", limit):
        size = pc.sum(pc.binary_length(column(part, "t"))).as_py() or 0
        if held and (total + size > limit or rows + part.num_rows > CUT_ROWS):
            yield pa.Table.from_batches(held)
            held, total, rows = [], 0, 0
            release()
        held.append(part)
        total, rows = total + size, rows + part.num_rows
    if held:
        yield pa.Table.from_batches(held)


#: A cut's row has megabytes: row groups and pages end after each row that
#: fills them, not after the 100 that Parquet writes before it looks.
_FILES = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def _cut(tool, batch):
    """One row of _CUT."""
    codes, off, at = tool.documents(column(batch, "t"))
    segments = at[codes]
    count = {k: segment_sum(tool.size[k][segments], off) for k in ("a", "b", "ga", "link")}
    labels = tool.label.take(pa.array(at))
    sha = []
    for i in range(len(off) - 1):
        mine = labels.take(pa.array(codes[off[i]:off[i + 1]]))
        one = pa.ListArray.from_arrays(pa.array([0, len(mine)], pa.int32()), mine)
        sha.append(hashlib.sha256(memoryview(pc.binary_join(one, "")[0].as_buffer())[:-1]).hexdigest() if len(mine) else "")
    link, cut = tool.take("link", at)
    which, pairs = pd.factorize(link)
    often = np.bincount(codes, minlength=len(at))
    n = np.bincount(which, np.repeat(often, np.diff(cut)), len(pairs)).astype(np.int64)
    return pa.record_batch(
        [pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([column(batch, "d").to_pylist()], pa.list_(pa.int64())),
         *[pa.array([count[k]], pa.list_(pa.int64())) for k in ("a", "b", "ga", "link")], pa.array([sha]),
         *[pa.array([planes(x.astype(np.uint32))], pa.binary()) for x in (codes, off, which, cut)],
         *[pa.array([x], pa.list_(pa.int64())) for x in (pairs, n)]],
        names=["cut", "doc", "n_a", "n_b", "n_groups", "n_links", "sha", "words", "off", "pair_of", "pair_off", "pairs", "n"])


def _cuts(paths, limit):
    """Documents as cuts of bounded size: each document's numbers and its
    segments as codes of the cut, the links of the cut's segments, and the
    cut's distinct id pairs with their links' number."""
    def run(batches):
        tool = aligner(*paths)
        for batch in _gathered(batches, limit):
            yield _cut(tool, batch)      # nothing of one cut is held while the next is made
    return run


_OUT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _answer(key, cuts, answers):
    """Sums of a cut's documents over their links' corpus-wide counts."""
    best = np.zeros(answers.num_rows, np.int64)
    total = np.zeros(answers.num_rows, np.int64)
    place = answers["pos"].to_numpy()
    best[place], total[place] = answers["best"].to_numpy(), answers["c"].to_numpy()
    codes, off, which, cut = [unplanes(cuts[k][0].as_py(), np.uint32).astype(np.int64) for k in ("words", "off", "pair_of", "pair_off")]
    sums = [segment_sum(segment_sum(x[which], cut)[codes], off) for x in (best, total)]
    whole = {k: cuts[k].combine_chunks().flatten() for k in ("doc", "n_a", "n_b", "n_groups", "n_links", "sha")}
    return pa.table([whole["doc"], whole["n_a"], whole["n_b"], whole["n_groups"], whole["n_links"],
                     pa.array(sums[0]), pa.array(sums[1]), whole["sha"]], names=_OUT)


def pair_counts(cuts: DataFrame) -> DataFrame:
    """(key, c, best): of every id pair ``a << 32 | b`` its number of links
    in all documents, and 1 where no pair of the same B id has more."""
    asks = cuts.select(F.explode(F.arrays_zip("pairs", "n")).alias("x")).select("x.pairs", "x.n")
    counts = cut_lineage(asks.groupBy(F.col("pairs").alias("key")).agg(F.sum("n").alias("c")).withColumn(
        "b", F.col("key").bitwiseAND(F.lit((1 << 32) - 1))))
    most = counts.groupBy("b").agg(F.max("c").alias("most"))
    return counts.join(most, "b").select("key", "c", (F.col("c") == F.col("most")).cast("long").alias("best"))


def alignment_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path_a: str | None = None,
                     path_b: str | None = None, cut_bytes: int = 4 << 20) -> DataFrame:
    """One row per input row: doc_id, n_a and n_b (tokens), n_groups,
    n_links (token pairs that overlap), n_best (links whose id pair has the
    most links of its B id in all documents, ties included), count_sum (of
    the links' pair counts) and groups_sha256 (of ``a1,a2|b1;a3|b2,b3``, ''
    without tokens).

    Documents are tokenised once, into a table of cuts of ``cut_bytes`` text;
    a cut asks for its distinct pairs, so a frequent pair costs one row per
    cut. Texts that are null or empty or not spelled byte for byte give
    zeros; repeated rows count and come back as often."""
    default = default_paths()
    paths = path_a or default[0], path_b or default[1]
    _bound(docs.sparkSession)
    cuts = cut_lineage(_source(docs, doc_id, text).mapInArrow(_cuts(paths, cut_bytes), _CUT), **_FILES)
    known = pair_counts(cuts)
    asks = cuts.select(F.col("cut").alias("of"), F.posexplode("pairs").alias("pos", "key"))
    answers = asks.join(known, "key").select("of", "pos", "c", "best")
    left = cuts.drop("pairs", "n")
    types = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return left.groupBy("cut").cogroup(answers.groupBy("of")).applyInArrow(_answer, types)
