"""Exact token ids of a public BPE tokenizer at dictionary speed.

``word_bpe`` style tokenizers drop white space and never merge across it, so
a text's ids are those of its white-space separated chunks one after
another. A batch's distinct chunks are encoded once and spread by numpy.
"""

from __future__ import annotations

import gc
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from kestrel.llm.common import encode_words, ragged_take, split_words

#: Chunks (some 30 bytes each) above which a worker forgets those it knows
#: before the next batch.
CACHE = 400_000
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def id_bytes(path: str) -> int:
    """2 if every id of the vocabulary fits 16 bits, else 4."""
    from tokenizers import Tokenizer
    return 2 if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def _byte_letters() -> dict:
    """The byte-level alphabet: printable bytes stand for themselves, the
    rest for the characters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in plain]
    return {x: chr(x) for x in plain} | {x: chr(0x100 + i) for i, x in enumerate(rest)}


class Encoder:
    """ids(texts): all ids of an Arrow string array, and offsets."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.merge = self.tok.model.tokenize
        self.letters = _byte_letters()
        self.clear()

    def clear(self):
        """The chunks known so far: names, and their ids as flat/size."""
        self.known, self.flat, self.size = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _new(self, names):
        """Ids of chunks met for the first time. A run of Latin letters is
        one piece to the tokenizer's splitter and its normal form is its
        lower case, so it goes to the merge model at once (two to three
        times the speed); other chunks take the whole tokenizer."""
        out, rest = [None] * len(names), []
        merge, letters = self.merge, self.letters
        for i, w in enumerate(names):
            if w.isalpha() and max(w) < "\u0250" and "\u0130" not in w:
                w = w if w.isascii() else w.lower().encode().decode("latin-1").translate(letters)
                out[i] = [t.id for t in merge(w)]
            else:
                rest.append(i)
        for i, e in zip(rest, self.tok.encode_batch_fast([names[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def _ragged(self, chunks):
        """Flat ids, starts and lengths of distinct chunks (Arrow array)."""
        if len(self.known) > CACHE:
            self.clear()
        at = pc.index_in(chunks, value_set=self.known)
        new = at.is_null()
        missing = chunks.filter(new)
        at = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(missing):
            on = gc.isenabled()
            gc.disable()          # hundreds of thousands of small lists, none of them cyclic
            lists = self._new(missing.to_pylist())
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum()))
            del lists
            if on:
                gc.enable()
            at[new.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(missing))
            self.known = pa.concat_arrays([self.known, missing])
            self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
        return self.flat, (np.cumsum(self.size) - self.size)[at], self.size[at]

    def ids(self, texts):
        words, off = split_words(texts)
        codes, distinct = encode_words(words)
        if not len(codes):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        # the tokenizer lower-cases anyway, but finds its special tokens before it does
        special = pc.match_substring(distinct, "<|")
        plain = pc.if_else(special, distinct, pc.ascii_lower(distinct))
        # a run of punctuation after a letter is a token chunk of its own
        body = pc.utf8_rtrim(plain, characters=_TAIL)
        body = pc.if_else(pc.and_(pc.match_substring_regex(body, r"\pL$"), pc.invert(special)), body, plain)
        cut = pc.utf8_length(body).to_numpy(zero_copy_only=False)
        full = pc.utf8_length(plain).to_numpy(zero_copy_only=False)
        has = np.flatnonzero(full > cut)
        tails = pa.array([w[c:] for w, c in zip(plain.take(pa.array(has)).to_pylist(), cut[has].tolist())], pa.string())
        bcode, bodies = encode_words(body)
        tcode, tails = encode_words(tails)
        flat, start, size = self._ragged(pa.concat_arrays([bodies, tails]))
        second = np.full(len(distinct), -1)
        second[has] = tcode + len(bodies)
        # each distinct word is a body piece and perhaps a tail piece
        piece = np.stack([bcode, second], 1).ravel()
        real = piece >= 0
        n = np.where(real, size[piece], 0)
        table = flat[ragged_take(np.where(real, start[piece], 0), n)]
        wsize = n.reshape(-1, 2).sum(1)
        wstart = np.concatenate([[0], np.cumsum(wsize)])[:-1]
        count = wsize[codes]
        out = table[ragged_take(wstart[codes], count)]
        return out, np.concatenate([[0], np.cumsum(count)])[off]

    def documents(self, texts, end_id: int):
        """As ids(), with ``end_id`` after each document."""
        flat, off = self.ids(texts)
        n = len(off) - 1
        out = np.empty(len(flat) + n, np.uint32)
        end = off[1:] + np.arange(n)
        keep = np.ones(len(out), bool)
        keep[end] = False
        out[keep] = flat
        out[end] = end_id
        return out, off + np.arange(n + 1)


_ENCODERS: dict = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
