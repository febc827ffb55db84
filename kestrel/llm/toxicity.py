"""Toxicity by a small convolutional text classifier (operator 10).

Hashed word embeddings (a word is the sum of its own and its prefixes'
vectors), filters of several widths over neighbouring words, the maximum of
each filter over the whole text, and a logistic output; trained on Spark on
all labelled rows that may be learned from, and applied to every text.
Shards of these rows train from the same parameters and what they changed is
averaged, over a few rounds (local SGD). Decision thresholds are calibrated
per language, on all calibration rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import U64, column, encode_words, hash_strings, release, split_words, text_chunks
from kestrel.llm.native import sift
from kestrel.session import cut_lineage

#: Hash buckets of the embedding, its width, filters per width, widths.
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 17, 8, 8, (1, 2, 3)
#: Prefix lengths that share their vector between words; 0 is the word.
PREFIXES = (0, 3, 4, 5, 6)
#: Rows and bytes of text that a shard holds on average; rounds of averaging, if there is more than one shard.
SHARD_ROWS, SHARD_BYTES, ROUNDS = 4000, 8 << 20, 4
#: Changes of parameters are summed as multiples of 1 / SCALE, so that no order of summing shows.
SCALE = float(1 << 44)
#: Calibration tells logits apart to 1 / GRID; those beyond 30 count as 30.
GRID = 4096
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def features(words):
    """(n words x len(PREFIXES)) hash buckets of an array of words, which
    are lower-cased and freed from punctuation at their ends."""
    w = pc.utf8_trim(pc.utf8_lower(words), characters=_EDGE)
    cols = []
    for seed, k in enumerate(PREFIXES):
        part = w if k == 0 else pc.utf8_slice_codeunits(w, 0, k)
        codes, distinct = encode_words(part)
        h = (hash_strings(distinct, 20 + seed) >> U64(64 - 17)).astype(np.int64)
        cols.append(h[codes] if len(codes) else np.zeros(0, np.int64))
    return np.stack(cols, 1)


def _windows(off, width):
    """First words of all windows of a width, per document at least one
    (a shorter document is padded behind)."""
    n = np.diff(off)
    per = np.maximum(n - width + 1, 1)
    at = np.cumsum(per) - per
    start = np.arange(per.sum()) - np.repeat(at, per) + np.repeat(off[:-1], per)
    return start, at, np.repeat(off[1:], per)


class Net:
    """Parameters, the forward pass and one training step (Adam)."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {"E": (r.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32),
                  "b": np.full(FILTERS * len(WIDTHS), -0.1, np.float32),
                  "out": (r.random(FILTERS * len(WIDTHS)) * 0.5 + 0.25).astype(np.float32),
                  "bias": np.zeros(1, np.float32)}
        for w in WIDTHS:
            self.p[f"W{w}"] = (r.standard_normal((w, DIM, FILTERS)) * 0.5 / w).astype(np.float32)
        self.m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items() if k != "E"}
        self.sq = np.zeros(BUCKETS, np.float32)
        self.t = 0

    def state(self):
        """All that training changes, as rows of DIM + 1 numbers: of each
        bucket its vector and its squares, then the rest with its moments."""
        rest = np.concatenate([x.ravel() for k, v in self.p.items() if k != "E" for x in (v, *self.m[k])])
        rest = np.append(rest, np.zeros(-len(rest) % (DIM + 1), np.float32))
        return np.vstack([np.hstack([self.p["E"], self.sq[:, None]]), rest.reshape(-1, DIM + 1)]).astype(np.float64)

    def restore(self, state, t: int):
        """This net in such a state, after t steps."""
        state = state.astype(np.float32)
        self.p["E"], self.sq, self.t = state[:BUCKETS, :DIM].copy(), state[:BUCKETS, DIM].copy(), t
        rest, at = state[BUCKETS:].ravel(), 0
        for k, v in self.p.items():
            if k != "E":
                v[...], self.m[k] = rest[at:at + v.size].reshape(v.shape), [
                    rest[at + i * v.size:at + (i + 1) * v.size].reshape(v.shape).copy() for i in (1, 2)]
                at += 3 * v.size
        return self

    def pooled(self, feats, codes, off, want=False):
        """Maximum of every filter over each document; with ``want`` also
        the window (first word) it came from. ``feats``: distinct words."""
        p = self.p
        vec = p["E"][feats].sum(1) if len(feats) else np.zeros((1, DIM), np.float32)
        vec = np.vstack([vec, np.zeros((1, DIM), np.float32)])          # the last row pads
        pad = len(vec) - 1
        out, where = [], []
        for i, w in enumerate(WIDTHS):
            start, at, end = _windows(off, w)
            acc = None
            for j in range(w):
                x = start + j
                c = np.where(x < end, codes[np.minimum(x, len(codes) - 1)], pad) if len(codes) else np.full(len(x), pad)
                part = (vec @ p[f"W{w}"][j])[c]
                acc = part if acc is None else acc + part
            best = np.maximum.reduceat(acc, at, axis=0)
            out.append(best + p["b"][i * FILTERS:(i + 1) * FILTERS])
            if want:
                n = np.diff(np.append(at, len(acc)))
                doc = np.repeat(np.arange(len(at)), n)
                first = np.empty((len(at), FILTERS), np.int64)
                for f in range(FILTERS):
                    hit = np.flatnonzero(acc[:, f] == best[doc, f])
                    d, k = np.unique(doc[hit], return_index=True)
                    first[d, f] = start[hit[k]]
                where.append(first)
        return np.hstack(out), where, vec, pad

    def logit(self, feats, codes, off):
        z = self.pooled(feats, codes, off)[0]
        return np.maximum(z, 0) @ self.p["out"] + self.p["bias"][0]

    def step(self, feats, codes, off, y, weight, rate):
        z, where, vec, pad = self.pooled(feats, codes, off, want=True)
        a = np.where(z > 0, z, 0.05 * z)              # leaky in training, so no filter dies
        s = a @ self.p["out"] + self.p["bias"][0]
        err = ((1 / (1 + np.exp(-s)) - y) * weight / weight.sum()).astype(np.float32)
        g = {"out": a.T @ err, "bias": np.array([err.sum()], np.float32)}
        back = err[:, None] * self.p["out"][None] * np.where(z > 0, 1, 0.05)
        g["b"] = back.sum(0)
        gv = np.zeros_like(vec)
        for i, w in enumerate(WIDTHS):
            bw = back[:, i * FILTERS:(i + 1) * FILTERS]
            gw = np.zeros_like(self.p[f"W{w}"])
            for j in range(w):
                x = where[i] + j
                c = np.where(x < off[1:][:, None], codes[np.minimum(x, len(codes) - 1)], pad) if len(codes) else np.full(x.shape, pad)
                for f in range(FILTERS):
                    gw[j, :, f] = vec[c[:, f]].T @ bw[:, f]
                np.add.at(gv, c.ravel(), (bw[:, :, None] * self.p[f"W{w}"][j].T[None]).reshape(-1, DIM))
            g[f"W{w}"] = gw
        self.t += 1
        for k, v in g.items():
            m, u = self.m[k]
            m += 0.1 * (v - m)
            u += 0.01 * (v * v - u)
            self.p[k] -= rate * (m / (1 - 0.9 ** self.t)) / (np.sqrt(u / (1 - 0.99 ** self.t)) + 1e-8)
        hit = np.flatnonzero(np.abs(gv[:-1]).sum(1))
        if len(hit):                                   # Adagrad on the touched buckets
            rows = feats[hit].ravel()
            grad = np.repeat(gv[hit], len(PREFIXES), axis=0)
            np.add.at(self.sq, rows, (grad ** 2).mean(1))
            np.add.at(self.p["E"], rows, -rate * 3 * grad / (np.sqrt(self.sq[rows])[:, None] + 1e-6))


def _prepare(texts):
    words, off = split_words(texts)
    codes, distinct = encode_words(words)
    return features(distinct), codes, off


PACKED = "shard long, feats binary, codes binary, off binary, y binary, n binary"


def _pack(table):
    """One row of a shard: its words' features and the rest of what its
    training reads, in an order that rests on the rows alone."""
    table = table.sort_by([("d", "ascending"), ("lang", "ascending"), ("t", "ascending")])
    feats, codes, off = _prepare(column(table, "t"))
    out = pa.table([table["shard"].slice(0, 1)] + [pa.array([x.tobytes()], pa.binary()) for x in (
        feats.astype(np.int32), codes.astype(np.int32), off, table["y"].to_numpy().astype(np.float32), table["n"].to_numpy().astype(np.float32))],
        names=[c.split()[0] for c in PACKED.split(", ")])
    del table, feats, codes, off
    release()
    return out


def fit(net: Net, feats, codes, off, y, weight, epochs, whole: int, seed, batch: int = 64, rate: float = 0.02) -> Net:
    """Trains the net for some ``epochs`` (their numbers) out of ``whole``."""
    r = np.random.default_rng(seed)
    for e in epochs:
        order = r.permutation(len(y))
        for s in range(0, len(order), batch):
            some = order[s:s + batch]
            own = np.concatenate([codes[off[i]:off[i + 1]] for i in some])
            # half of the words are left out, so that the net learns every telling word and not one per text
            stay = r.random(len(own)) < 0.5
            o = np.concatenate([[0], np.cumsum(stay)])[np.concatenate([[0], np.cumsum(off[some + 1] - off[some])])]
            used, local = np.unique(own[stay], return_inverse=True)
            net.step(feats[used], local, o, y[some], weight[some], rate / (1 + 4 * e / whole))
    return net


def _round(packed: DataFrame, state, t: int, share: float, epochs, whole: int, seed: int):
    """The mean state after every shard trained from ``state``; a bucket's
    mean is over the shards that have it."""
    start = packed.sparkSession.sparkContext.broadcast(state)
    names = [f"v{i}" for i in range(DIM + 1)]

    def run(batches):
        total, times = None, np.zeros(len(start.value), np.int64)
        for b in batches:
            for row in b.to_pylist():
                get = lambda k, dtype: np.frombuffer(row[k], dtype)  # noqa: E731, B023
                y = get("y", np.float32)
                weight = np.where(y > 0, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)).astype(np.float32) * get("n", np.float32)
                net = fit(Net(seed).restore(start.value, t), get("feats", np.int32).reshape(-1, len(PREFIXES)), get("codes", np.int32),
                          get("off", np.int64), y, weight, epochs, whole, (seed, row["shard"], epochs[0]))
                change = np.rint((net.state() - start.value) * SCALE).astype(np.int64)
                times += change.any(1) | (np.arange(len(change)) >= BUCKETS)
                total = change if total is None else total + change
        at = np.flatnonzero(times)
        if len(at):
            yield pa.record_batch([pa.array(at), pa.array(times[at]), *[pa.array(np.ascontiguousarray(x)) for x in total[at].T]],
                                  names=["at", "n", *names])
        release()

    got = (packed.mapInArrow(run, ", ".join(f"{c} long" for c in ["at", "n", *names])).groupBy("at")
           .agg(*[F.sum(c).alias(c) for c in ["n", *names]]).toArrow())
    start.destroy()
    new, at = state.copy(), got["at"].to_numpy()
    new[at] += np.stack([got[c].to_numpy() for c in names], 1) / SCALE / got["n"].to_numpy()[:, None]
    return new


def fit_all(rows: DataFrame, n_rows: int, n_bytes: int, share: float, steps: int = 1500, batch: int = 64, least: int = 12,
            seed: int = 7, shard_rows: int = SHARD_ROWS) -> Net:
    """A net trained on all ``rows`` (d, t, lang, y and how often each is
    there, n) for about ``steps`` steps, ``least`` epochs at least; classes
    are weighted to equal sums. ``n_rows``, ``n_bytes``, ``share``: count,
    bytes of text and share of label 1 of the rows."""
    net = Net(seed)
    if not n_rows:
        return net
    shards = max(-(-n_rows // shard_rows), -(-n_bytes // SHARD_BYTES))
    # of a shard one row is left, and about one row in a file
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("d", "lang", "t"), F.lit(shards))).repartition(shards, "shard")
    packed = cut_lineage(dealt.groupBy("shard").applyInArrow(_pack, PACKED))
    epochs = min(max(-(-steps * batch // n_rows), least), 60)
    state, t = net.state(), 0
    for some in np.array_split(np.arange(epochs), ROUNDS if shards > 1 else 1):
        some = some.tolist()
        state = _round(packed, state, t, share, some, epochs, seed)
        t += len(some) * -(-n_rows // (shards * batch))
    return net.restore(state, t)


def predict(net: Net, texts):
    feats, codes, off = _prepare(texts)
    return net.logit(feats, codes, off)


def best_threshold(value, hits, n) -> float:
    """The cut with the best F1, in the middle of its gap (0 if a class is
    missing). ``hits`` of the ``n`` rows with a value (each there once) have
    label 1."""
    o = np.argsort(-value)
    s, hit, all_ = value[o], np.cumsum(hits[o]), np.cumsum(n[o])
    if not len(s) or hit[-1] in (0, all_[-1]):
        return 0.0
    k = int(np.argmax(2 * hit / (all_ + hit[-1])))
    return float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k] - 1.0)


def held_out(doc_id):
    """True for rows whose labels are never learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def _score(logit, shift, cut):
    return 1 / (1 + np.exp(-np.clip(logit - shift + np.log(cut / (1 - cut)), -30, 30)))


class Classifier:
    """A trained net, the shift that puts its best cut at score 0.3, and a
    threshold on the score per language."""

    def __init__(self, net, shift, by_lang):
        self.net, self.shift, self.by_lang = net, shift, by_lang

    def score(self, texts):
        return _score(predict(self.net, texts), self.shift, 0.3)


def learnable(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
              label: str = "toxic") -> DataFrame:
    """(d, t, lang, y, n): every labelled row of ``docs`` that is not held
    out; equal ones are one row, there n times."""
    lab = (labels.select(F.col(doc_id).cast("long").alias("d"), F.col(label).cast("int").alias("y"))
           .where(F.col("d").isNotNull() & F.col("y").isNotNull() & ~F.coalesce(held_out("d"), F.lit(True)))
           .groupBy("d").agg((F.max("y") == 1).cast("int").alias("y")))
    texts = docs.select(F.col(doc_id).cast("long").alias("d"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"),
                        F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"))
    # most texts without a label stay where they are
    near = sift(texts.withColumn("h", F.xxhash64("d")), "h", lab.select(F.xxhash64("d").alias("h")), "h")[1].drop("h")
    return near.join(lab, "d").groupBy("d", "t", "lang", "y").agg(F.count("*").alias("n"))


def calibrate(net: Net, rows: DataFrame, cut: float) -> Classifier:
    """The net with its thresholds from all ``rows`` (as ``learnable`` has
    them), whose logits are counted on a grid of fixed size."""
    model = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for b in text_chunks(batches, "t"):
            logit = np.clip(predict(model.value, column(b, "t")), -30, 30)
            yield pa.record_batch([column(b, "lang"), pa.array(np.rint(logit * GRID).astype(np.int64)), column(b, "y"), column(b, "n")],
                                  names=["lang", "at", "y", "n"])

    seen = cut_lineage(rows.select("t", "lang", "y", "n").mapInArrow(run, "lang string, at long, y int, n long")
                       .groupBy("lang", "at").agg(F.sum("n").alias("n"), F.sum(F.col("y") * F.col("n")).alias("hits")))
    model.destroy()
    whole = seen.groupBy("at").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).toArrow()       # 60 * GRID + 1 at most
    shift = best_threshold(*[whole[c].to_numpy() / k for c, k in (("at", GRID), ("hits", 1), ("n", 1))])

    def own(table):
        hits, n = table["hits"].to_numpy(), table["n"].to_numpy()
        mixed = int(0 < hits.sum() < n.sum())
        value = best_threshold(_score(table["at"].to_numpy() / GRID, shift, cut), hits, n)
        return pa.table([table["lang"].slice(0, mixed), pa.array([value] * mixed, pa.float64())], names=["lang", "cut"])

    found = seen.groupBy("lang").applyInArrow(own, "lang string, cut double").collect()
    return Classifier(net, shift, {r["lang"]: r["cut"] for r in found})


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          label: str = "toxic", calibration_share: float = 0.2, cut: float = 0.3, **options) -> Classifier:
    """Learns from all labelled rows that are not held out; a share of them,
    by doc_id, only calibrates: the cut with the best F1 goes to score
    ``cut``, and each language with both classes gets a threshold of its
    own. Without both classes in that share, all rows do both. Only the text
    is an input of the score."""
    side = F.crc32(F.concat(F.lit("side"), F.col("d").cast("string")).cast("binary")) % 1000 < 1000 * calibration_share
    rows = cut_lineage(learnable(docs, labels, doc_id, text, lang, label).withColumn("side", side))
    found = rows.groupBy("side").agg(F.count("*").alias("rows"), F.sum(F.octet_length("t").cast("long")).alias("bytes"), F.sum("n").alias("n"),
                                     F.sum(F.col("y") * F.col("n")).alias("hits")).collect()
    by = {r["side"]: r for r in found}
    split = len(by) == 2 and 0 < by[True]["hits"] < by[True]["n"]
    learn = [by[False]] if split else found
    total = {k: sum(r[k] for r in learn) for k in ("rows", "bytes", "n", "hits")}
    net = fit_all(rows.where(~F.col("side")) if split else rows, total["rows"], total["bytes"], total["hits"] / max(total["n"], 1), **options)
    return calibrate(net, rows.where("side") if split else rows, cut)


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
             cut: float = 0.3, **options) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1; the cut that
    does best overall is at ``cut``), predicted (score >= cut), threshold
    (calibrated for the row's language; ``cut`` where the language had no
    labels of both classes) and flagged (score >= threshold).

    Null and empty texts get the score of a text without words. A null
    doc_id has no checksum and counts as held out; repeated
    rows come back as often; without labels every score is that of the
    untrained net; an empty table gives an empty result."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, labels, doc_id, text, lang, cut=cut, **options))

    def run(batches):
        for b in text_chunks(batches, "t", 4 << 20):
            score = model.value.score(column(b, "t"))
            cuts = np.array([model.value.by_lang.get(g, cut) for g in column(b, "lang").to_pylist()])
            yield pa.record_batch([column(b, "d"), column(b, "held_out"), pa.array(score.astype(np.float64)),
                                   pa.array((score >= cut).astype(np.int32)), pa.array(cuts.astype(np.float64)),
                                   pa.array(score >= cuts)],
                                  names=["doc_id", "held_out", "score", "predicted", "threshold", "flagged"])

    src = docs.select(F.col(doc_id).cast("long").alias("d"), F.coalesce(held_out(doc_id), F.lit(True)).alias("held_out"),
                      F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("lang"))
    return src.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, threshold double, flagged boolean")


def digest(scored: DataFrame) -> DataFrame:
    """The contract's columns, then the language's threshold and verdict."""
    return scored.select("doc_id", "held_out", "score", "predicted", "threshold", "flagged")
