"""Quality rules with an n-gram perplexity band (operator 2).

A character n-gram model per language, with modified Kneser-Ney smoothing:
Spark counts the n-grams of all documents and derives continuation counts,
discounts and probabilities by joins over full (language, n-gram) keys.
n-grams run over the whole text, across words. The corpus's distinct
n-grams are looked up in the model bucket by bucket and the answers joined
back to the texts that asked, so the model is never held in one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import (U64, column, encode_words, hash_strings, mix64, planes, ragged_take, release, segment_sum,
                                split_words, text_chunks, unplanes)
from kestrel.session import cut_lineage

#: Units of an n-gram; each takes CHAR_BITS of a packed 64-bit n-gram.
ORDER, CHAR_BITS = 5, 12
_START, _END, _SPACE = 1, 2, 35
#: Characters below _WIDE are one unit (3 + code point); the others are a
#: leading and a trailing unit of their own ranges, so none are folded.
_WIDE, _LEAD, _TRAIL = 0x700, 0x703, 0x703 + 0x440
#: Bytes of text that one bucket of the model answers for, and its n-grams.
BYTES_PER_BUCKET, GRAMS_PER_BUCKET = 16 << 20, 1 << 19
SYMBOLS = "[#*$%&|<>]"


def _mask(k: int) -> int:
    return (1 << CHAR_BITS * k) - 1


def _units(words):
    """The units of all characters of an Arrow array of words, and the
    number of units of each word."""
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "")[0].as_buffer()
    raw = np.frombuffer(raw.to_pybytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = raw >= _WIDE
    if not wide.any():
        return raw + np.uint32(3), size
    width = 1 + wide.astype(np.int64)
    at = np.cumsum(width) - width
    out = np.empty(int(width.sum()), np.uint32)
    out[at] = np.where(wide, _LEAD + (raw >> np.uint32(10)), raw + np.uint32(3))
    out[at[wide] + 1] = _TRAIL + (raw[wide] & np.uint32(1023))
    return out, segment_sum(width, np.concatenate([[0], np.cumsum(size)]))


def text_grams(words, off):
    """For every unit, space and end of every text (its words, as from
    ``split_words``): the packed n-gram of up to ORDER units that ends there
    (shorter at the text's start), and the ends of the texts' runs of
    n-grams (texts without words have none)."""
    unit, size = _units(words) if len(words) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    full = np.diff(off) > 0
    first = np.zeros(len(words), bool)
    first[off[:-1][full]] = True
    start = np.cumsum(size + 1) - size - 1 + np.cumsum(first) - 1       # of each word, with the mark before it
    total = int((size + 1).sum() + full.sum())
    seq = np.zeros(total, U64)
    seq[start] = np.where(first, _START, _SPACE)
    seq[ragged_take(start + 1, size)] = unit
    begin = start[first]
    seq[np.append(begin[1:], total)[:len(begin)] - 1] = _END
    gram = seq.copy()
    for j in range(1, ORDER):
        gram[j:] |= seq[:-j] << U64(CHAR_BITS * j)
    for j in range(ORDER - 1):                                          # a text's first units have only j before them
        at = (begin + j)[begin + j < np.append(begin[1:], total)[:len(begin)]]
        gram[at] &= U64(_mask(j + 1))
    ends = np.ones(total, bool)
    ends[begin] = False
    per = np.zeros(len(off) - 1, np.int64)
    per[full] = np.diff(np.append(begin, total)) - 1
    return gram[ends].view(np.int64), np.concatenate([[0], np.cumsum(per)])


def _distinct(grams):
    """The distinct n-grams in order, and each n-gram's place among them;
    only the distinct ones are sorted."""
    d = pa.array(grams).dictionary_encode()
    keys = d.dictionary.to_numpy()
    order = np.argsort(keys)
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    return keys[order], place[d.indices.to_numpy()]


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all documents (columns t, lang). A task adds up
    its own n-grams before anything is shuffled."""
    def run(batches):
        held = {}

        def rows(grams, n):
            order = np.argsort(grams, kind="stable")
            grams, n = grams[order], n[order]
            head = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
            return grams[head], np.add.reduceat(n, head)

        def send(lang):
            g, n = rows(*(np.concatenate(x) for x in zip(*held.pop(lang))))
            for i in range(0, len(g), 1 << 18):
                m = min(len(g) - i, 1 << 18)
                yield pa.record_batch([pa.array([lang] * m, pa.string()), pa.array(g[i:i + m]), pa.array(n[i:i + m])],
                                      names=["lang", "gram", "n"])

        for b in text_chunks(batches, "t", 2 << 20):
            langs = column(b, "lang")
            for lang in langs.unique().to_pylist():
                grams, _ = text_grams(*split_words(column(b.filter(pc.equal(langs, lang)), "t")))
                if not len(grams):
                    continue
                held.setdefault(lang, []).append(np.unique(grams, return_counts=True))
                if sum(len(g) for g, _ in held[lang]) > 2_000_000:
                    merged = rows(*(np.concatenate(x) for x in zip(*held[lang])))
                    held[lang] = [merged]
                    if len(merged[0]) > 1_000_000:
                        yield from send(lang)
        for lang in list(held):
            yield from send(lang)

    return docs.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _order(gram):
    """Characters of a packed n-gram."""
    return sum(F.when(gram.bitwiseAND(F.lit(_mask(k) ^ _mask(k - 1))) != 0, 1).otherwise(0) for k in range(1, ORDER + 1))


def _levels(counts: DataFrame, min_count: int):
    """Per order 1 .. ORDER: lang, gram, ctx, n (its occurrences), p, weight
    (log back-off weight of ctx), begun (raw count: a longest n-gram, or one
    that begins a text) and s. ``s`` is the log probability with which the
    model scores the n-gram: its own, where it occurs ``min_count`` times;
    else the weight of its context, where that does, and ``s`` of its
    suffix. All n-grams, single ones too, are in the estimates of p."""
    g = F.col("gram")
    top = cut_lineage(counts.withColumn("k", _order(g).cast("int")))
    raw = lambda k: top.where(f"k = {k}").select("lang", "gram", F.col("n").alias("c"), "n", F.lit(True).alias("begun"))
    level = {ORDER: raw(ORDER)}
    for k in range(ORDER - 1, 0, -1):
        below = level[k + 1].groupBy("lang", g.bitwiseAND(F.lit(_mask(k))).alias("gram")).agg(
            F.count("*").alias("c"), F.sum("n").alias("n")).withColumn("begun", F.lit(False))
        level[k] = cut_lineage(below.unionByName(raw(k)))
    lower = None
    for k in range(1, ORDER + 1):
        rows = level[k]
        cc = rows.groupBy("lang").agg(*[F.sum((F.col("c") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)],
                                      F.count("*").alias("types"))
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        enough = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
        ratio = lambda i: F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}"))
        d = cc.select("lang", "types", *[
            F.when(enough, F.greatest(F.least(i - (i + 1) * y * ratio(i), F.lit(float(i))), F.lit(0.05))).otherwise(0.5 * i)
            .alias(f"d{i}") for i in (1, 2, 3)])
        rows = rows.join(cut_lineage(d), "lang")       # a row per language, as a table: its size decides the join
        rows = rows.withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        rows = rows.withColumn("ctx", F.shiftright("gram", CHAR_BITS))
        ctx = rows.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.sum("d").alias("mass"), F.sum("n").alias("seen"))
        rows = rows.join(ctx, ["lang", "ctx"])
        own, gamma = (F.col("c") - F.col("d")) / F.col("total"), F.col("mass") / F.col("total")
        weight = F.log(gamma)
        if lower is None:
            p, rest = own + gamma / (F.col("types") + 1), F.log(gamma / (F.col("types") + 1))
        else:
            low = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q"), F.col("s").alias("qs"))
            rows = rows.withColumn("suffix", F.col("gram").bitwiseAND(F.lit(_mask(k - 1)))).join(low, ["lang", "suffix"])
            p, rest = own + gamma * F.col("q"), F.when(F.col("seen") >= min_count, weight).otherwise(0.0) + F.col("qs")
        s = F.when(F.col("n") >= min_count, F.log(p)).otherwise(rest)
        lower = cut_lineage(rows.select("lang", "gram", "ctx", "n", p.alias("p"), weight.alias("weight"), "types", "begun", s.alias("s")))
        yield k, lower


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(k, lang, gram, logp, backoff): interpolated modified Kneser-Ney
    probabilities, with the back-off weight of each n-gram as a context.

    Counts of the longest n-grams (and of those that begin a text, which
    nothing precedes) are raw; the others count the distinct units
    before them. Discounts come from the counts of counts of their
    language and order; where these are too few, 0.5, 1 and 1.5."""
    out, last = None, None
    for k, rows in _levels(counts, 1):
        weight = rows.groupBy("lang", F.col("ctx").alias("gram")).agg(F.max("weight").alias("backoff"))
        if last is None:
            out = rows.groupBy("lang").agg(F.first(F.col("weight") - F.log(F.col("types") + 1)).alias("logp")).select(
                F.lit(0).alias("k"), "lang", F.lit(0).cast("long").alias("gram"), "logp", F.lit(0.0).alias("backoff"))
        else:
            # an n-gram's own probability, and its weight as a context of this order
            # (a text's start mark is a context only)
            done = last.select("lang", "gram", "p").join(weight, ["lang", "gram"], "full")
            out = out.unionByName(done.select(F.lit(k - 1).alias("k"), "lang", "gram", F.coalesce(F.log("p"), F.lit(-100.0)).alias("logp"),
                                              F.coalesce("backoff", F.lit(0.0)).alias("backoff")))
        last = rows
    return out.unionByName(last.select(F.lit(ORDER).alias("k"), "lang", "gram", F.log("p").alias("logp"),
                                       F.lit(0.0).alias("backoff")))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = 2) -> DataFrame:
    """(lang, gram, s): the log probability of the last unit of every n-gram
    that ends somewhere in the documents. An n-gram that occurs less than
    ``min_count`` times counts in every estimate, but is scored as if it
    were unseen: it would only vouch for the text that it is from."""
    src = docs.select(F.col(text).cast("string").alias("t"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"))
    out = None
    for _, rows in _levels(count_grams(src), min_count):
        rows = rows.where("begun").select("lang", "gram", "s")
        out = rows if out is None else out.unionByName(rows)
    return out


def _bucket(grams, lang: str, buckets: int):
    own = hash_strings(pa.array([lang]), 11)[0]
    return (mix64(grams.view(U64) ^ own) % U64(buckets)).astype(np.int64)


def _dealt(grams, lang, buckets):
    """(bucket, places) of sorted n-grams."""
    b = _bucket(grams, lang, buckets)
    order = np.argsort(b, kind="stable")
    ends = np.flatnonzero(np.concatenate([b[order][1:] != b[order][:-1], [True]])) + 1
    for i, j in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()):
        yield int(b[order[i]]), order[i:j]


def _repeat_words(codes, off, n_distinct):
    """Words in 3-word windows that the document holds twice or more."""
    n = np.diff(off)
    per = np.maximum(n - 2, 0)
    at = ragged_take(off[:-1], per)
    doc = np.repeat(np.arange(len(n)), per)
    mark = np.zeros(len(codes) + 2, bool)
    if len(at):
        pair = codes[at] * n_distinct + codes[at + 1]
        if n_distinct >= 1 << 21:                 # too many words to pack three
            pair = np.unique(pair, return_inverse=True)[1]
            key = pair.astype(np.int64) * n_distinct + codes[at + 2]
        else:
            key = pair * n_distinct + codes[at + 2]
        order = np.argsort(key, kind="stable")    # equal windows of a document end up side by side
        k, d = key[order], doc[order]
        same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
        twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        first = at[order[twice]]
        mark[first] = mark[first + 1] = mark[first + 2] = True
    return segment_sum(mark[:len(codes)].astype(np.int64), off)


def _dup_lines(texts):
    """Lines (split at \\n) with a word that equal an earlier line."""
    parts = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    lines = parts.flatten()
    off = parts.offsets.to_numpy().astype(np.int64)
    off = off - off[0]
    full = pc.binary_length(pc.ascii_trim_whitespace(lines)).to_numpy(zero_copy_only=False) > 0
    codes, distinct = encode_words(lines)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[full]
    pair = np.unique(doc * max(len(distinct), 1) + codes[full])
    own = np.bincount(pair // max(len(distinct), 1), minlength=len(off) - 1)
    return np.bincount(doc, minlength=len(off) - 1) - own


SCORED = ("doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, log_ppl double")
_CUT = "cut long, lang string, rules binary, texts binary, size long"
#: Bytes of one language's text in a cut, and of all text that a task holds.
CUT_BYTES, HELD_BYTES = 6 << 20, 20 << 20


def _rules(part):
    """The rule counts of a batch (SCORED without log_ppl), its words and
    their offsets."""
    texts = column(part, "t")
    words, off = split_words(texts)
    codes, distinct = encode_words(words)
    if len(codes):
        chars = segment_sum(pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)[codes], off)
        symbols = segment_sum(pc.count_substring_regex(distinct, SYMBOLS).to_numpy(zero_copy_only=False)[codes].astype(np.int64), off)
    else:
        chars = symbols = np.zeros(len(off) - 1, np.int64)
    table = pa.table([column(part, "d"), column(part, "lang"), pa.array(np.diff(off)), pa.array(chars), pa.array(symbols),
                      pa.array(_dup_lines(texts).astype(np.int64)), pa.array(_repeat_words(codes, off, max(len(distinct), 1)))],
                     names=[c.split()[0] for c in SCORED.split(", ")][:-1])
    return table, words, off


def _parts(batches):
    """(cut, language, texts) of a task: a few MB of one language each, numbered
    alike whenever the same rows are read again."""
    cut = TaskContext.get().partitionId() << 32
    held, size = {}, {}

    def take(name):
        size.pop(name)
        return name, pa.Table.from_batches(held.pop(name)).combine_chunks().to_batches()[0]

    for b in text_chunks(batches, "t", 2 << 20):
        ready = []
        for name in column(b, "lang").unique().to_pylist():
            part = b.filter(pc.equal(column(b, "lang"), name))
            held.setdefault(name, []).append(part)
            size[name] = size.get(name, 0) + part.nbytes
            if size[name] >= CUT_BYTES:
                ready.append(take(name))
        while sum(size.values()) > HELD_BYTES:
            ready.append(take(max(size, key=size.get)))
        for name, part in ready:
            yield cut, name, part
            cut += 1
    for name in list(held):
        yield cut, *take(name)
        cut += 1


def _cuts(batches):
    """Per cut: the rule counts of its texts and their words, compressed."""
    for cut, name, part in _parts(batches):
        table, words, _ = _rules(part)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(table)
        flat = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_buffer() \
            if len(words) else pa.py_buffer(b"")
        row = (cut, name, sink.getvalue().to_pybytes(), pa.Codec("zstd", compression_level=7).compress(flat, asbytes=True), flat.size)
        names = [c.split()[0] for c in _CUT.split(", ")]
        types = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int64()]
        yield pa.record_batch([pa.array([c], t) for c, t in zip(row, types)], names=names)


def _body(row):
    """Rule counts, words and offsets of a cut."""
    rules = pa.ipc.open_stream(row["rules"]).read_all()
    raw = pa.Codec("zstd").decompress(row["texts"], row["size"], asbytes=True) if row["size"] else b""
    words, _ = split_words(pa.array([raw.decode()]))
    return rules, words, np.concatenate([[0], np.cumsum(rules["n_words"].to_numpy())])


def _asks(buckets):
    """The distinct n-grams of each cut, dealt to the model's buckets. Cuts
    are read from the texts once more here, which costs less than a table of
    them would."""
    def run(batches):
        for cut, lang, part in _parts(batches):
            grams = np.unique(text_grams(*split_words(column(part, "t")))[0])
            rows = [(cut, x, lang, planes(np.diff(grams[at], prepend=0))) for x, at in _dealt(grams, lang, buckets)] if len(grams) else []
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.string(), pa.binary()))],
                                      names=["cut", "bucket", "lang", "grams"])
    return run


def _model_rows(buckets):
    """The model dealt to buckets, as sorted arrays."""
    def run(batches):
        held = {}

        def send():
            rows = []
            for lang, x in held.items():
                g, s = (np.concatenate(v) for v in zip(*x))
                order = np.argsort(g)
                g, s = g[order], s[order]
                rows += [(b, lang, planes(np.diff(g[at], prepend=0)), s[at].tobytes()) for b, at in _dealt(g, lang, buckets)]
            held.clear()
            cols = zip(*rows)
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.binary(), pa.binary()))],
                                   names=["bucket", "lang", "grams", "s"])

        n = 0
        for b in batches:
            langs, g, s = column(b, "lang"), column(b, "gram").to_numpy(), column(b, "s").to_numpy()
            for lang in langs.unique().to_pylist():
                m = pc.equal(langs, lang).to_numpy(zero_copy_only=False)
                held.setdefault(lang, []).append((g[m], s[m]))
            n += b.num_rows
            if n > 1 << 20:
                yield send()
                n = 0
        if held:
            yield send()
    return run


def _answer(table):
    """One bucket: the scores of the asked n-grams, in the order of asking."""
    release()
    model = {}
    asked = table.filter(pc.is_valid(table["cut"]))
    for lang, g, s in zip(*(table.filter(pc.is_null(table["cut"])).column(n).to_pylist() for n in ("lang", "grams", "s"))):
        model.setdefault(lang, []).append((np.cumsum(unplanes(g, np.int64)), np.frombuffer(s, np.float64)))
    for lang, x in model.items():
        g, s = (np.concatenate(v) for v in zip(*x))
        order = np.argsort(g)
        model[lang] = g[order], s[order].astype(np.float32)
    out = []
    for lang, g in zip(asked["lang"].to_pylist(), asked["grams"].to_pylist()):
        grams = np.cumsum(unplanes(g, np.int64))
        keys, s = model[lang]
        at = np.searchsorted(keys, grams)
        if (at == len(keys)).any() or (keys[at] != grams).any():
            raise ValueError("an n-gram of the texts is not in the model of these texts")
        out.append(planes(s[at]))
    return pa.table([asked["cut"], asked["bucket"], pa.array(out, pa.binary())], names=["cut", "bucket", "s"])


def _scored(buckets):
    """One cut: its texts meet the scores of their n-grams."""
    def run(table):
        release()
        body = table.filter(pc.is_valid(table["rules"])).to_pylist()[0]
        rules, words, off = _body(body)
        grams, ends = text_grams(words, off)
        distinct, code = _distinct(grams)
        each = np.zeros(len(distinct))
        got = table.filter(pc.is_valid(table["s"]))
        answers = dict(zip(got["bucket"].to_pylist(), got["s"].to_pylist()))
        for x, at in _dealt(distinct, body["lang"], buckets) if len(distinct) else []:
            each[at] = unplanes(answers[x], np.float32)
        n = rules["n_words"].to_numpy()
        chars = rules["word_chars"].to_numpy() + n              # with the spaces between words and the end
        ppl = -segment_sum(each[code], ends) / np.maximum(chars, 1)
        return rules.append_column("log_ppl", pa.array(ppl, mask=n == 0))
    return run


def score(docs: DataFrame, model: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rule counts of every text and its log perplexity per character
    (null without words). ``model`` is ``train`` of the same documents."""
    src = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).cast("string").alias("t"),
                      F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"))
    size = src.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    model = cut_lineage(model)
    buckets = max(1, -(-size // BYTES_PER_BUCKET), -(-model.count() // GRAMS_PER_BUCKET))
    cuts = src.mapInArrow(_cuts, _CUT)
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    dealt = model.mapInArrow(_model_rows(buckets), "bucket int, lang string, grams binary, s binary")
    asks = src.mapInArrow(_asks(buckets), "cut long, bucket int, lang string, grams binary")
    both = (asks.select("cut", "bucket", "lang", "grams", none("binary", "s"))
            .unionByName(dealt.select(none("long", "cut"), "bucket", "lang", "grams", "s")))
    answers = both.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_answer, "cut long, bucket int, s binary")
    mine = cuts.select("cut", none("int", "bucket"), "lang", "rules", "texts", "size", none("binary", "s")).unionByName(
        answers.select("cut", "bucket", none("string", "lang"), none("binary", "rules"), none("binary", "texts"), none("long", "size"), "s"))
    return mine.repartition(buckets, "cut").groupBy("cut").applyInArrow(_scored(buckets), SCORED)


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", min_words: int = 50,
                  max_repeat: float = 0.5, tail: float = 0.001, fence: float = 5.0, short: float = 100.0) -> DataFrame:
    """One row per input row: doc_id, lang, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, log_ppl, lower, upper, kept.

    base_failed: fewer than ``min_words`` words, or repeats above
    ``max_repeat``. A document whose log perplexity lies outside its
    language's band is not kept. The band is in deviations from the median
    over sqrt(1 + ``short`` / n_words), as short texts vary more: of the
    documents that pass the base rules, those within ``fence``
    interquartile ranges of the quartiles are the language's core, and the
    core's percentiles ``tail`` and 1 - ``tail`` are the band, so that junk
    does not widen it however far out it lies. A null language is a
    language of its own; null and empty texts fail the base rules; repeated
    rows come back as often; an empty table gives an empty result."""
    rows = cut_lineage(score(docs, train(docs, text, lang), doc_id, text, lang))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    wide = F.sqrt(1 + short / F.greatest("n_words", F.lit(1)))
    rows = rows.withColumn("base_failed", failed).withColumn("wide", wide)
    passed = rows.where(~F.col("base_failed"))
    middle = cut_lineage(passed.groupBy("lang").agg(F.percentile_approx("log_ppl", 0.5, 10000).alias("mid")))
    z = passed.join(middle, "lang").select("lang", "mid", ((F.col("log_ppl") - F.col("mid")) / F.col("wide")).alias("z"))
    q = cut_lineage(z.groupBy("lang").agg(F.percentile_approx("z", [0.25, 0.75], 10000).alias("q")))
    reach = fence * (F.col("q")[1] - F.col("q")[0]) + 1e-6        # sums of equal texts differ in their last digits
    core = z.join(q, "lang").where(F.col("z").between(F.col("q")[0] - reach, F.col("q")[1] + reach))
    band = cut_lineage(core.groupBy("lang").agg(F.first("mid").alias("mid"), F.percentile_approx("z", [tail, 1 - tail], 100000).alias("b")))
    edge = lambda i, more: F.col("mid") + F.col("b")[i] * F.col("wide") + more
    out = rows.join(band, "lang", "left").withColumn("lower", edge(0, -1e-6)).withColumn("upper", edge(1, 1e-6))
    inside = F.coalesce(F.col("log_ppl").between(F.col("lower"), F.col("upper")), F.lit(False))
    return out.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "log_ppl", "lower", "upper", (~F.col("base_failed") & inside).alias("kept"))


def digest(rules: DataFrame) -> DataFrame:
    """The contract's columns, then the score and its band."""
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                        "kept", "log_ppl", "lower", "upper")
