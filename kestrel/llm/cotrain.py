"""Quality classifier by co-training (operator 5).

Two views of a document: its content (hashed words, word endings and word
shapes) and its page metadata (source, language, declared length, layout).
Each view's classifier labels the unlabelled rows it is sure of for the
other, over several rounds; the calibrated views are combined to score
every document. The models are fitted in numpy on bounded samples; features
and scores of all documents are computed on Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import U64, column, encode_words, hash_strings, segment_sum, split_words, text_chunks

#: Hash bits of the content features; bins of a layout figure; hash slots of
#: sources and languages.
CONTENT_BITS, BINS, SOURCE_SLOTS, LANG_SLOTS = 16, 16, 64, 16


def content_features(distinct):
    """(n x 3) buckets of distinct words: the word, its last three
    characters, its shape (runs of upper, lower, digit, other)."""
    shape = pc.replace_substring_regex(distinct, r"\p{Lu}+", "A")
    shape = pc.replace_substring_regex(shape, r"\p{Ll}+", "a")
    shape = pc.replace_substring_regex(shape, r"[0-9]+", "0")
    cols = []
    for seed, part in enumerate((pc.utf8_lower(distinct), pc.utf8_slice_codeunits(distinct, -3), shape)):
        codes, names = encode_words(part)
        h = (hash_strings(names, 40 + seed) >> U64(64 - CONTENT_BITS)).astype(np.int64)
        cols.append(h[codes] if len(codes) else np.zeros(0, np.int64))
    return np.stack(cols, 1)


def _count(distinct, pattern):
    return pc.count_substring_regex(distinct, pattern).to_numpy(zero_copy_only=False).astype(np.int64)


def layout(texts, words, codes, distinct, off, declared):
    """(documents x figures): lengths, lines, character classes, repeats."""
    n = np.diff(off)
    per = np.maximum(n, 1)
    size = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    add = lambda v: segment_sum(v[codes], off) if len(codes) else np.zeros(len(n), np.int64)
    chars = np.maximum(add(size), 1)
    lines = pc.fill_null(pc.count_substring(texts, "\n"), 0).to_numpy(zero_copy_only=False) + 1
    if len(codes):
        doc = np.repeat(np.arange(len(n)), n)
        pair, times = np.unique(doc * len(distinct) + codes, return_counts=True)
        owner = pair // len(distinct)
        own = np.bincount(owner, minlength=len(n))
        top = np.zeros(len(n), np.int64)
        np.maximum.at(top, owner, times)
    else:
        own = top = np.zeros(len(n), np.int64)
    return np.stack([np.log1p(np.maximum(declared, 0)), np.log1p(n), np.log1p(lines), n / lines, chars / per,
                     add(_count(distinct, r"\p{Lu}")) / chars, add(_count(distinct, "[0-9]")) / chars,
                     add(_count(distinct, r"[#*$%&|<>]")) / chars, add(_count(distinct, r"[.,;:!?]")) / chars,
                     own / per, top / per, n], 1).astype(np.float64)


#: Words without evidence that the content view adds to every text, so that
#: a few words do not decide.
NEUTRAL = 20
FIGURES = 11        # the last column of layout() is the word count itself


class Features:
    """Both views of a batch (columns t, lang, source, n_chars)."""

    def __init__(self, batch):
        texts = pc.fill_null(column(batch, "t"), "")
        words, self.off = split_words(texts)
        self.codes, distinct = encode_words(words)
        self.feats = content_features(distinct)
        declared = pc.fill_null(column(batch, "n_chars"), -1).to_numpy(zero_copy_only=False).astype(np.float64)
        figures = layout(texts, words, self.codes, distinct, self.off, declared)
        self.figures, self.n = figures[:, :FIGURES], figures[:, FIGURES]
        slot = lambda name, seed, k: (hash_strings(pc.fill_null(column(batch, name), "\x00"), seed) % U64(k)).astype(np.int64)
        self.names = np.stack([slot("source", 51, SOURCE_SLOTS), slot("lang", 52, LANG_SLOTS)], 1)


    def content(self, w):
        """Per document the summed weights of its features over its words
        and NEUTRAL."""
        if not len(self.codes):
            return np.zeros(len(self.n))
        return segment_sum(w[self.feats].sum(1)[self.codes], self.off) / (np.diff(self.off) + NEUTRAL)

    def sparse(self):
        """The same as rows: (row ends, feature, share)."""
        n = np.diff(self.off)
        doc = np.repeat(np.arange(len(n)), n)
        cols, rows = self.feats[self.codes].ravel(), np.repeat(doc, self.feats.shape[1])
        pair, times = np.unique(rows * (1 << CONTENT_BITS) + cols, return_counts=True)
        row = pair >> CONTENT_BITS
        at = np.searchsorted(row, np.arange(len(n) + 1))
        return at, (pair & ((1 << CONTENT_BITS) - 1)).astype(np.int32), (times / (n + NEUTRAL)[row]).astype(np.float32)


class Sample:
    """Both views of sampled documents in the compact form in which they
    reach the driver."""

    def __init__(self, figures, n, names, at, cols, vals):
        self.figures, self.n, self.names, self.at, self.cols, self.vals = figures, n, names, at, cols, vals

    @classmethod
    def of(cls, f: Features):
        return cls(f.figures, f.n, f.names, *f.sparse())

    @classmethod
    def rows(cls, table):
        """From rows of ``SAMPLED`` (an Arrow table)."""
        def joined(name, dtype):
            return np.frombuffer(b"".join(table[name].to_pylist()), dtype)
        size = pc.binary_length(table["cols"]).to_numpy().astype(np.int64) // 4
        return cls(joined("figures", np.float64).reshape(-1, FIGURES), table["n"].to_numpy().astype(float),
                   np.stack([table["source"].to_numpy(), table["lang"].to_numpy()], 1),
                   np.concatenate([[0], np.cumsum(size)]), joined("cols", np.int32), joined("vals", np.float32))

    def content(self, w):
        total = np.concatenate([[0.0], np.cumsum(self.vals * w[self.cols])])
        return total[self.at[1:]] - total[self.at[:-1]]


SAMPLED = "d long, y int, n long, source long, lang long, figures binary, cols binary, vals binary"


def _sampled(batches):
    """Features of labelled and pooled rows, computed where the rows are."""
    for b in text_chunks(batches, "t", 2 << 20):
        f = Features(b)
        at, cols, vals = f.sparse()
        cut = list(zip(at[:-1].tolist(), at[1:].tolist()))
        yield pa.record_batch(
            [column(b, "d"), column(b, "y"), pa.array(f.n.astype(np.int64)), pa.array(f.names[:, 0]), pa.array(f.names[:, 1]),
             pa.array([r.tobytes() for r in f.figures], pa.binary()), pa.array([cols[x:z].tobytes() for x, z in cut], pa.binary()),
             pa.array([vals[x:z].tobytes() for x, z in cut], pa.binary())], names=[c.split()[0] for c in SAMPLED.split(", ")])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Content:
    """Logistic regression on the mean of hashed word features."""

    def __init__(self):
        self.w, self.b = np.zeros(1 << CONTENT_BITS), 0.0

    def logit(self, f):
        return f.content(self.w) + self.b

    def fit(self, m, rows, y, weight, epochs: int = 15, rate: float = 0.5, seed: int = 5):
        at, cols, vals = m
        self.__init__()
        sq, sqb, r = np.full(1 << CONTENT_BITS, 1e-8), 1e-8, np.random.default_rng(seed)
        for _ in range(epochs):
            order = r.permutation(len(rows))
            for s in range(0, len(order), 64):
                k = order[s:s + 64]
                d = rows[k]
                n = at[d + 1] - at[d]
                i = np.arange(n.sum()) + np.repeat(at[d] - (np.cumsum(n) - n), n)
                own = np.repeat(np.arange(len(k)), n)
                z = np.bincount(own, vals[i] * self.w[cols[i]], len(k)) + self.b
                err = (_sigmoid(z) - y[k]) * weight[k]
                used, inv = np.unique(cols[i], return_inverse=True)
                g = np.bincount(inv, vals[i] * err[own], len(used)) / len(k) + 1e-6 * self.w[used]
                sq[used] += g * g
                self.w[used] -= rate * g / np.sqrt(sq[used])
                gb = err.mean()
                sqb += gb * gb
                self.b -= 0.1 * gb / np.sqrt(sqb)
        return self


class Metadata:
    """Logistic regression on binned layout figures, source and language."""

    def __init__(self, edges):
        self.edges = edges
        self.w = np.zeros(FIGURES * BINS + SOURCE_SLOTS + LANG_SLOTS + 1)

    def columns(self, f):
        """Column numbers of the set features, one row per document."""
        out = [np.searchsorted(e, f.figures[:, i], "right") + i * BINS for i, e in enumerate(self.edges)]
        base = FIGURES * BINS
        out += [f.names[:, 0] + base, f.names[:, 1] + base + SOURCE_SLOTS, np.full(len(f.n), len(self.w) - 1)]
        return np.stack(out, 1)

    def logit(self, f):
        return self.w[self.columns(f)].sum(1)

    def fit(self, cols, rows, y, weight, epochs: int = 60, rate: float = 0.3):
        self.w[:] = 0
        x, sq = cols[rows], np.full(len(self.w), 1e-8)
        for _ in range(epochs):
            err = (_sigmoid(self.w[x].sum(1)) - y) * weight / max(len(rows), 1)
            g = np.bincount(x.ravel(), np.repeat(err, x.shape[1]), len(self.w)) + 1e-5 * self.w
            sq += g * g
            self.w -= rate * g / np.sqrt(sq)
        return self


def _logistic(z, y, prior):
    """Coefficients (the last an intercept) of a logistic regression of y on
    the columns of z, drawn to ``prior``; Newton steps, each halved until
    it helps."""
    prior = np.asarray(prior, float)
    x = np.hstack([np.clip(z, -30, 30), np.ones((len(z), 1))])
    if not len(y) or y.min() == y.max():
        return prior
    ridge = 0.1
    loss = lambda t: np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ t)).sum() + ridge / 2 * ((t - prior) ** 2).sum()
    t = prior.copy()
    for _ in range(30):
        p = _sigmoid(x @ t)
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(prior))
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * (t - prior))
        while loss(t - step) > loss(t) and np.abs(step).max() > 1e-9:
            step /= 2
        t = t - step
    return t


class CoTrained:
    """Both views, their calibration and the rejection threshold."""

    def __init__(self, content, metadata, cal, threshold, history):
        self.content, self.metadata, self.cal, self.threshold, self.history = content, metadata, cal, threshold, history
        self.mix = np.array([0.5, 0.5, 0.0])

    def views(self, f):
        return [_sigmoid(a * v.logit(f) + b) for v, (a, b) in zip((self.content, self.metadata), self.cal)]

    def odds(self, f):
        return np.stack([np.clip(a * v.logit(f) + b, -12, 12)
                         for v, (a, b) in zip((self.content, self.metadata), self.cal)], 1)

    def score(self, f):
        """The calibrated log odds of both views, weighted by a logistic
        regression on the calibration rows; texts without words get 0."""
        return np.where(f.n > 0, _sigmoid(self.odds(f) @ self.mix[:2] + self.mix[2]), 0.0)


def cotrain(f: Sample, y, rounds: int = 3, sure: float = 0.97, give: int = 500, calibrate=None,
            clean_loss: float = 0.0005) -> CoTrained:
    """``y``: 1, 0 or -1 (unlabelled) per document of ``f``; ``calibrate``
    marks labelled rows that are kept for calibration. In each round a view
    hands the other at most ``give`` rows per class (in proportion to the
    classes) whose probability is at least ``sure``. The threshold rejects
    at most ``clean_loss`` of the calibration rows labelled good."""
    y = np.asarray(y)
    calibrate = np.zeros(len(y), bool) if calibrate is None else np.asarray(calibrate)
    base = np.flatnonzero((y >= 0) & ~calibrate)
    edges = [np.unique(np.quantile(f.figures[:, i], np.arange(1, BINS) / BINS)) if len(y) else np.zeros(0) for i in range(FIGURES)]
    content, metadata = Content(), Metadata(edges)
    m, cols = (f.at, f.cols, f.vals), metadata.columns(f)
    given = [{}, {}]                                  # pseudo-labels a view received: row -> label
    history = []
    for r in range(rounds + 1):
        for view, x, own in ((content, m, given[0]), (metadata, cols, given[1])):
            extra = np.fromiter(own, np.int64, len(own))
            rows = np.concatenate([base, extra])
            lab = np.concatenate([y[base], [own[int(e)] for e in extra]]).astype(float)
            if len(rows):
                view.fit(x, rows, lab, np.concatenate([np.ones(len(base)), np.full(len(extra), 0.5)]))
        if r == rounds or not len(base):
            break
        prob = [_sigmoid(view.logit(f)) for view in (content, metadata)]
        share = min(max(y[base].mean(), 0.02), 0.98)
        for own, p in ((given[1], prob[0]), (given[0], prob[1])):       # each view teaches the other
            free = (y < 0) & (f.n > 0)
            if own:
                free[np.fromiter(own, np.int64, len(own))] = False
            for label, q, k in ((1, p, int(give * share)), (0, 1 - p, int(give * (1 - share)) + 1)):
                best = np.flatnonzero(free & (q >= sure))
                best = best[np.argsort(-q[best], kind="stable")[:k]]
                own.update({int(i): label for i in best})
        history.append((len(given[0]), len(given[1])))
    at = np.flatnonzero(calibrate & (y >= 0))
    at = at if len(at) and y[at].min() != y[at].max() else base
    cal = [_logistic(view.logit(f)[at][:, None], y[at].astype(float), [1, 0]) for view in (content, metadata)]
    model = CoTrained(content, metadata, cal, 0.0, history)
    model.mix = np.maximum(_logistic(model.odds(f)[at], y[at].astype(float), [0.5, 0.5, 0]), [0, 0, -np.inf])
    good = np.sort(model.score(f)[at[y[at] == 1]]) if len(at) else np.zeros(0)
    # the score that all but clean_loss of the good calibration rows reach, and never above one in twenty
    model.threshold = float(min(good[int(clean_loss * len(good))], 0.05)) if len(good) else 0.0
    return model


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          source: str = "source", n_chars: str = "n_chars", label: str = "quality", max_labelled: int = 3000,
          max_pool: int = 3000, **options) -> CoTrained:
    """Fits on bounded, repeatable samples (order of a hash of doc_id): at
    most ``max_labelled`` labelled rows of each class and ``max_pool``
    unlabelled rows. Labels of rows whose crc32(doc_id as text) mod 4 is 2
    are not used; a fifth of the others only calibrates."""
    lab = (labels.select(F.col(doc_id).cast("long").alias("d"), F.col(label).cast("int").alias("y"))
           .where("d IS NOT NULL AND y IS NOT NULL").groupBy("d").agg(F.min("y").alias("y")))
    learn = lab.where(F.crc32(F.col("d").cast("string").cast("binary")) % 4 != 2).withColumn("h", F.xxhash64("d"))
    src = _source(docs, doc_id, text, lang, source, n_chars)
    ids = src.select("d").where("d IS NOT NULL")
    some = (learn.where("y = 1").orderBy("h").limit(max_labelled).unionByName(learn.where("y <> 1").orderBy("h").limit(max_labelled))
            .select("d", F.when(F.col("y") == 1, 1).otherwise(0).alias("y")))
    pool = (ids.join(lab.select("d"), "d", "left_anti").withColumn("h", F.xxhash64("d")).orderBy("h").limit(max_pool)
            .select("d", F.lit(-1).alias("y")))
    picked = F.broadcast(some.unionByName(pool))            # at most 2 * max_labelled + max_pool ids
    rows = src.join(picked, "d").mapInArrow(_sampled, SAMPLED).toArrow().combine_chunks()
    rows = rows.take(pa.array(np.lexsort((rows["y"].to_numpy(), rows["d"].to_numpy()))))
    side = (hash_strings(rows["d"].cast(pa.string()).combine_chunks(), 77) % U64(5) == 0) if rows.num_rows else np.zeros(0, bool)
    return cotrain(Sample.rows(rows), rows["y"].to_numpy(), calibrate=side, **options)


def _source(docs, doc_id, text, lang, source, n_chars):
    return docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).cast("string").alias("t"),
                       F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"),
                       F.col(n_chars).cast("long").alias("n_chars"))


def quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
            source: str = "source", n_chars: str = "n_chars", **options) -> DataFrame:
    """One row per input row: doc_id, text_score and page_score (each
    view's calibrated probability of good quality), score (combined) and
    kept (score at or above the threshold, and at least one word).

    Null metadata is a value of its own; null and blank texts score 0 and
    are not kept; repeated rows come back as often; without labels every
    text with words is kept; an empty table gives an empty result."""
    model = docs.sparkSession.sparkContext.broadcast(
        train(docs, labels, doc_id, text, lang, source, n_chars, **options))

    def run(batches):
        for b in text_chunks(batches, "t", 4 << 20):
            f = Features(b)
            one, two = model.value.views(f)
            s = model.value.score(f)
            yield pa.record_batch([column(b, "d"), pa.array(one), pa.array(two), pa.array(s),
                                   pa.array((f.n > 0) & (s >= model.value.threshold))],
                                  names=["doc_id", "text_score", "page_score", "score", "kept"])

    return _source(docs, doc_id, text, lang, source, n_chars).mapInArrow(
        run, "doc_id long, text_score double, page_score double, score double, kept boolean")


def keep_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows that ``quality`` rejects. The verdict is
    computed next to each row, so nothing is joined; other columns are
    carried through."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, doc_id, **options))
    names = {"text": "t", "lang": "lang", "source": "source", "n_chars": "n_chars"}

    def run(batches):
        for b in text_chunks(batches, "text", 4 << 20):
            f = Features(pa.record_batch([column(b, n) for n in names], names=list(names.values())))
            yield b.filter(pa.array((f.n > 0) & (model.value.score(f) >= model.value.threshold)))

    return docs.mapInArrow(run, docs.schema)
