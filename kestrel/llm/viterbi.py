"""Token counts of a unigram vocabulary without the tokens (operator 8).

An Aho-Corasick automaton enumerates the vocabulary pieces in a text; a
Viterbi pass over their ends carries the best score and its number of
pieces. Ties, unknown characters and byte fallback follow the unigram model
of the tokenizers library: candidates for an end are tried from the
earliest start on and only a strictly better one replaces the first.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import column, encode_words, segment_sum, text_chunks

SPACE = "▁"
#: What an unknown character costs below the worst piece.
UNKNOWN_PENALTY = 10.0
#: Segments (some 30 bytes each) above which a worker forgets those it knows.
CACHE = 400_000


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a SentencePiece file, in id order."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class Counter:
    """Best score and piece count of texts under a vocabulary."""

    def __init__(self, vocab, byte_fallback: bool = True):
        import ahocorasick
        self.auto = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece:
                self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        self.unknown = min((s for _, s in vocab), default=0.0) - UNKNOWN_PENALTY
        pieces = {p for p, _ in vocab}
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in pieces for b in range(256))
        # no piece goes on past a space mark that follows another character,
        # and scores are whole numbers (their sums exact): then the text falls
        # apart there, ties included
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces) and all(float(s).is_integer() for _, s in vocab)
        self.clear()

    def clear(self):
        self.known, self.count, self.score = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0)

    def viterbi(self, text: str) -> tuple[int, float]:
        """(pieces, score) of one prepared text."""
        n = len(text)
        best, count, run = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches = self.auto.iter(text)
        end, (size, gain) = next(matches, (n, (0, 0.0)))
        for i in range(n):
            top, pieces, single, unk = None, 0, False, False
            while end == i:                            # longest match, that is earliest start, first
                s = best[i + 1 - size] + gain
                if top is None or s > top:
                    top, pieces = s, count[i + 1 - size] + 1
                single = single or size == 1
                end, (size, gain) = next(matches, (n, (0, 0.0)))
            if not single:
                s = best[i] + self.unknown
                if top is None or s > top:
                    top, unk = s, True
                    # unknown neighbours are one piece unless they fall back to bytes
                    pieces = count[i] + (len(text[i].encode()) if self.bytes else 0 if run[i] else 1)
            best[i + 1], count[i + 1], run[i + 1] = top, pieces, unk
        return count[n], best[n]

    def segments(self, texts):
        """Prepared segments of a string array (spaces become space marks,
        one is put before a text that is not empty) and offsets."""
        texts = pc.fill_null(texts, "")
        n = len(texts)
        if not self.cuts:
            whole = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(SPACE, pc.replace_substring(texts, " ", SPACE), ""))
            full = pc.not_equal(whole, "")
            return whole.filter(full), np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        parts = pc.split_pattern(texts, " ")
        words = parts.flatten()
        off = parts.offsets.to_numpy().astype(np.int64)
        off = off - off[0]
        empty = pc.equal(words, "").to_numpy(zero_copy_only=False)
        segs = pc.binary_join_element_wise(SPACE, words, "")
        if empty.any():
            # runs of spaces: an empty word adds its mark to the segment behind it, or stands at the text's end
            last = np.zeros(len(words), bool)
            last[off[1:][off[1:] > off[:-1]] - 1] = True
            keep = ~empty | last
            ends = np.flatnonzero(keep)
            extra = np.diff(np.concatenate([[-1], ends])) - 1
            segs = segs.filter(pa.array(keep))
            more = np.flatnonzero(extra)
            if len(more):
                fix = [SPACE * int(extra[i]) + s for i, s in zip(more, segs.take(pa.array(more)).to_pylist())]
                mask = np.zeros(len(segs), bool)
                mask[more] = True
                segs = pc.replace_with_mask(segs, pa.array(mask), pa.array(fix, pa.string()))
            off = np.concatenate([[0], np.cumsum(keep)])[off]
            # an empty text has no segment at all
            none = pc.equal(texts, "").to_numpy(zero_copy_only=False)
            if none.any():
                stay = np.ones(len(segs), bool)
                stay[off[:-1][none]] = False
                segs = segs.filter(pa.array(stay))
                off = np.concatenate([[0], np.cumsum(stay)])[off]
        assert len(off) == n + 1
        return segs, off

    def counts(self, texts):
        """Pieces and score of every text of a string array."""
        segs, off = self.segments(texts)
        codes, distinct = encode_words(segs)
        if not len(codes):
            return np.zeros(len(off) - 1, np.int64), np.zeros(len(off) - 1)
        if len(self.known) > CACHE:
            self.clear()
        at = pc.index_in(distinct, value_set=self.known)
        missing = distinct.filter(at.is_null())
        where = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(missing):
            got = [self.viterbi(s) for s in missing.to_pylist()]
            where[at.is_null().to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(missing))
            self.known = pa.concat_arrays([self.known, missing])
            self.count = np.concatenate([self.count, np.array([c for c, _ in got], np.int64)])
            self.score = np.concatenate([self.score, np.array([s for _, s in got])])
        return segment_sum(self.count[where][codes], off), segment_sum(self.score[where][codes], off)


_COUNTERS: dict = {}


def counter(path: str) -> Counter:
    """The worker's counter for a vocabulary file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(vocabulary(path))
    return _COUNTERS[path]


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_tokens, score (of the best
    segmentation of the whole text under the vocabulary read as a unigram
    model). Null and empty texts have no tokens; repeated rows come back as
    often; nothing is shuffled, so no key can be hot."""
    path = path or default_path()

    def run(batches):
        c = counter(path)
        for b in text_chunks(batches, "t", 3 << 20):
            n, s = c.counts(column(b, "t"))
            yield pa.record_batch([column(b, "d"), pa.array(n), pa.array(s)], names=["doc_id", "n_tokens", "score"])

    src = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).cast("string").alias("t"))
    return src.mapInArrow(run, "doc_id long, n_tokens long, score double")
