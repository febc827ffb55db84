"""Hard negatives by threshold joins in the manner of L2AP (operator 13).

A search joins blocks of anchors with blocks of rows under a threshold per
anchor. A row block's index leaves out the dimensions whose suffix norm,
times the largest anchor norm behind the same place, stays below the
smallest threshold; partial scores accumulate dimension group by dimension
group, pairs are dropped once the remaining norms cannot lift them to their
threshold, and survivors are completed exactly. Thresholds start where few
rows are expected and go down, for the anchors whose lists or windows are
not full yet, until they are full or nothing is left below.
"""

from __future__ import annotations

import uuid
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import bound_batches, column, release
from kestrel.session import cut_lineage

#: Vectors, and bytes, of a block; anchors of a block; blocks of anchors that
#: are broadcast at once (at most some 16 MB, however many anchors there are).
ROWS, ROW_BYTES, ANCHORS, SLICE = 4096, 4 << 20, 512, 32
#: Dimensions of a group, and the share of pairs alive below which a block
#: goes on with the list of pairs instead of the matrix.
GROUP, SPARSE = 16, 0.05
#: Rows expected above the first threshold of a search.
EXPECT = 24
NOTHING = -(1 << 62)


def _matrix(vectors, scale):
    """Integer matrix of an Arrow list array (shorter vectors end in zeros)
    and which rows are whole: not null, no null or non-finite component."""
    n = len(vectors)
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)        # nulls come as NaN
    owner = np.repeat(np.arange(n), size)
    whole = pc.is_valid(vectors).to_numpy(zero_copy_only=False)
    whole[owner[~np.isfinite(flat)]] = False
    out = np.zeros((n, int(size.max(initial=0))))
    out[owner, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = np.floor(scale * np.where(np.isfinite(flat), flat, 0))
    if np.abs(out[whole]).max(initial=0) >= 1 << 50:
        raise OverflowError("components too large: scores would not fit 64 bits")
    return out, whole


def _pack(scale, rows=ROWS, room=ROW_BYTES):
    """(id, none, label, vec) rows as blocks: columns as bytes, the vectors
    as a matrix of 32-bit integers (64-bit where they don't fit)."""
    def run(batches):
        for batch in batches:
            vec, whole = _matrix(column(batch, "vec"), scale)
            whole &= pc.is_valid(column(batch, "label")).to_numpy(zero_copy_only=False)
            ids = column(batch, "id")
            none = pc.is_null(ids).to_numpy(zero_copy_only=False)[whole]
            ids = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)[whole]
            label = pc.fill_null(column(batch, "label"), 0).to_numpy(zero_copy_only=False)[whole]
            vec = vec[whole]
            kind = np.int32 if np.abs(vec).max(initial=0) < 1 << 31 else np.int64
            step = max(1, min(rows, room // max(1, 4 * vec.shape[1])))
            for i in range(0, len(ids), step):
                part = slice(i, i + step)
                cells = [ids[part].astype(np.int64), none[part], label[part].astype(np.int64), vec[part].astype(kind)]
                yield pa.record_batch([pa.array([vec.shape[1]]), pa.array([len(cells[0])]), pa.array([np.dtype(kind).itemsize]),
                                       *[pa.array([c.tobytes()], pa.binary()) for c in cells]],
                                      names=["width", "n", "item", "ids", "none", "labels", "vecs"])
        release()
    return run


_BLOCK = "width long, n long, item long, ids binary, none binary, labels binary, vecs binary"


def _unpack(row, width):
    vec = np.frombuffer(row["vecs"], np.dtype(f"i{row['item']}")).reshape(row["n"], row["width"])
    vec = np.pad(vec, ((0, 0), (0, max(0, width - row["width"])))) if row["width"] < width else vec
    return vec, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["none"], bool), np.frombuffer(row["labels"], np.int64)


def _moments(batches):
    """Per dimension: number of vectors, sum and sum of squares."""
    total = {}
    for batch in batches:
        for row in batch.to_pylist():
            x = np.frombuffer(row["vecs"], np.dtype(f"i{row['item']}")).reshape(row["n"], row["width"]).astype(np.float64)
            for j, (s, q) in enumerate(zip(x.sum(0), (x * x).sum(0))):
                a = total.setdefault(j, [0, 0.0, 0.0])
                a[0] += len(x)
                a[1] += s
                a[2] += q
    if total:
        yield pa.record_batch([pa.array(list(total), pa.int64()), *[pa.array([a[i] for a in total.values()]) for i in range(3)]],
                              names=["j", "n", "s", "q"])


def scores_above(q, x, t, order, allowed=None):
    """All pairs (i, k, q[i]·x[k]) with a score of t[i] or more, by the
    index described above. ``order`` is the order of dimensions, ``allowed``
    a boolean matrix of the pairs that count. Integer scores, exact."""
    norm = float(np.sqrt((q.astype(np.float64) ** 2).sum(1).max(initial=0) * (x.astype(np.float64) ** 2).sum(1).max(initial=0)))
    if norm >= 1 << 52:
        raise OverflowError("vectors too long: scores would not be exact")
    kind = np.float32 if norm < 1 << 23 else np.float64            # every partial score is then an exact integer
    slack = 2 + norm * 1e-6
    q, x = q[:, order].astype(kind), x[:, order].astype(kind)
    d = q.shape[1]
    groups = [(s, min(s + GROUP, d)) for s in range(0, d, GROUP)]
    rest_q, rest_x = [np.zeros((len(v), len(groups) + 1)) for v in (q, x)]
    for v, rest in ((q, rest_q), (x, rest_x)):
        for c, (s, e) in reversed(list(enumerate(groups))):
            rest[:, c] = rest[:, c + 1] + (v[:, s:e].astype(np.float64) ** 2).sum(1)
    rest_q, rest_x = np.sqrt(rest_q), np.sqrt(rest_x)
    # groups of each row that are indexed: behind them, no anchor can reach its threshold alone
    held = ((rest_x * rest_q.max(0, initial=0))[:, :-1] >= t.min(initial=1 << 62) - slack).sum(1)
    rank = np.argsort(-held, kind="stable")
    held, x, rest_x = held[rank], x[rank], rest_x[rank]
    left_x, floor = rest_x.astype(kind), (t - slack).astype(kind)[:, None]
    left_q = rest_q.astype(kind)
    part = np.zeros((len(q), int((held > 0).sum())), kind)           # rows without indexed dimensions match nothing
    alive = np.ones(part.shape, bool) if allowed is None else allowed[:, rank[:part.shape[1]]]
    pairs, done = None, 0
    for c, (s, e) in enumerate(groups):
        done = c + 1
        if pairs is None:
            head = int((held > c).sum())
            part[:, :head] += q[:, s:e] @ x[:head, s:e].T
            if 2 * done < len(groups):
                continue
            near = alive & (part + left_q[:, c + 1, None] * left_x[None, :part.shape[1], c + 1] >= floor)
            # a row's groups beyond its index are still to come
            for g in range(int(held[:part.shape[1]].min(initial=done)), done):
                some = slice(int((held > g).sum()), int((held >= g).sum()))
                near[:, some] = alive[:, some] & (part[:, some] + left_q[:, g, None] * left_x[None, some, g] >= floor)
            if near.mean() < SPARSE or done == len(groups):
                pairs = list(np.nonzero(near))
                pairs.append(part[pairs[0], pairs[1]].astype(np.float64))
                short = held[pairs[1]] < done
                for g in range(done):                                # what the index left out, for the pairs alive
                    want = np.flatnonzero(short & (held[pairs[1]] <= g))
                    pairs[2][want] += _dots(q, x, pairs[0][want], pairs[1][want], groups[g])
        else:
            pairs[2] += _dots(q, x, pairs[0], pairs[1], (s, e))
        if pairs is not None:
            keep = pairs[2] + rest_q[pairs[0], done] * rest_x[pairs[1], done] >= t[pairs[0]] - slack
            pairs = [p[keep] for p in pairs]
    if pairs is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    score = np.rint(pairs[2]).astype(np.int64)
    keep = score >= t[pairs[0]]
    return pairs[0][keep], rank[pairs[1][keep]], score[keep]


def _dots(q, x, i, k, group, step=1 << 17):
    s, e = group
    out = np.empty(len(i))
    for a in range(0, len(i), step):
        out[a:a + step] = np.einsum("ij,ij->i", q[i[a:a + step], s:e].astype(np.float64), x[k[a:a + step], s:e].astype(np.float64))
    return out


def _best(owner, score, none, ids, k):
    """Places of the first k of each owner: higher scores, then smaller ids."""
    order = np.lexsort((ids, none, -score, owner))
    own = owner[order]
    start = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own))))
    return order[rank < k]


def _threshold(vec, mean, spread, tail):
    """The score that a share ``tail`` of normal rows exceeds, by anchor."""
    q = vec.astype(np.float64)
    z = np.array([-NormalDist().inv_cdf(p) if p < 1 else -np.inf for p in np.atleast_1d(tail)])      # tails are above 0
    m, s = q @ mean, np.sqrt((q * q) @ spread)
    with np.errstate(invalid="ignore"):
        t = m + np.where(s > 0, s * z, np.where(np.isneginf(z), -np.inf, 0))
    return np.where(t > NOTHING, np.floor(np.maximum(t, NOTHING)), NOTHING).astype(np.int64)


def _tail(score, vec, mean, spread):
    """The share of normal rows that exceed a score, by anchor."""
    q = vec.astype(np.float64)
    m, s = q @ mean, np.sqrt((q * q) @ spread)
    return np.array([NormalDist().cdf((a - x) / b) if b > 0 else float(x < a) for x, a, b in zip(score, m, s)])


def _search(blocks, anchors, fields, kernel, schema, reduce):
    """``kernel`` over all pairs of anchor blocks and row blocks, each slice
    of anchors reduced by ``reduce`` and written. The anchors (ak, label, id,
    vec and ``fields``) are the stated query set; ``SLICE`` blocks of them at
    a time are broadcast to all row blocks, so what is broadcast does not
    grow. None if there are no anchors."""
    names = ["ak", "label", "id", *fields]
    anchors = cut_lineage(anchors.select("vec", *names))
    m = anchors.count()
    if not m:
        return None

    def pack(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, ANCHORS):
                part = batch.slice(i, ANCHORS)
                vec = column(part, "vec").to_pylist()
                yield pa.record_batch([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([part.num_rows], pa.int64()),
                                       pa.array([b"".join(vec)], pa.binary()),
                                       *[pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), column(part, f)) for f in names]],
                                      names=["block", "m", "q", *names])

    kinds = dict(anchors.dtypes)
    packed = cut_lineage(anchors.repartition(-(-m // ANCHORS)).mapInArrow(
        pack, "block long, m long, q binary, " + ", ".join(f"{f} array<{kinds[f]}>" for f in names)))
    # one row per ANCHORS anchors: numbered to cut them into slices of a fixed size
    number = F.row_number().over(Window.orderBy("block")) - 1
    numbered = cut_lineage(packed.select("block", number.alias("k")))
    n = numbered.count()
    found = None
    for first in range(0, n, SLICE):
        here = min(SLICE, n - first)
        part = packed.join(numbered.where((F.col("k") >= first) & (F.col("k") < first + here)), "block").withColumn(
            "slot", F.col("k") - first)
        each = blocks.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(here - 1))))
        one = each.join(F.broadcast(part), "slot").select("width", "n", "item", "ids", "none", "labels", "vecs", "m", "q", *names)
        one = cut_lineage(reduce(one.mapInArrow(kernel, schema)))
        found = one if found is None else found.unionByName(one)
    return found


def _pairs(order, width):
    """Rows of a search as (anchor matrix, anchor columns, row block)."""
    def each(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in ("width", "n", "item", "ids", "none", "labels", "vecs", "m", "q")}
                q = np.frombuffer(row["q"], np.int64).reshape(row["m"], width)
                cols = {name: batch.column(name)[k].values for name in batch.schema.names if name not in row}
                yield q, cols, _unpack(row, width)
        release()
    return each


def hard_negatives(vectors: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding",
                   anchors: str = "vec_id % 50 = 0", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): for each anchor and each of its first ``positives``
    other rows of the same label, the first ``negatives`` rows of other
    labels with low * p <= 100 * n <= high * p, p and n being the scores.

    ``anchors`` is an SQL condition over the column ``vec_id``. Each
    component x becomes floor(scale * x); a score is the integer inner
    product (a shorter vector ends in zeros, longer products raise
    OverflowError beyond 2**52); higher scores come first, ties by the
    smaller id, rows without an id last. Rows with a null label or vector or
    a null or non-finite component take no part. Labels are whole numbers.
    Other rows have another id: an anchor's repeated rows are one anchor and
    never its partners; repeated rows of other ids each take a rank. An
    anchor without positives, or a positive whose window is empty, gives no
    rows; an empty table gives an empty result."""
    spark = vectors.sparkSession
    bound_batches(spark)
    src = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                         F.col(vector).cast("array<double>").alias("vec"))
    blocks = cut_lineage(src.mapInArrow(_pack(scale), _BLOCK))
    sums = blocks.mapInArrow(_moments, "j long, n long, s double, q double").groupBy("j").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("j").collect()        # one row per dimension
    total = blocks.agg(F.sum("n")).first()[0] or 0
    width = max(len(sums), 1)
    mean, energy = np.zeros(width), np.zeros(width)
    for r in sums:
        mean[r["j"]], energy[r["j"]] = r["s"] / total, r["q"] / total
    spread = np.maximum(energy - mean ** 2, 0)
    order = np.argsort(-energy, kind="stable")

    def rows_of(batches):
        for batch in batches:
            for row in batch.to_pylist():
                vec, ids, none, labels = _unpack(row, width)
                yield pa.record_batch([pa.array(ids, mask=none), pa.array(labels), pa.array([v.tobytes() for v in vec.astype(np.int64)], pa.binary())],
                                      names=["id", "label", "vec"])

    who = src.withColumnRenamed("id", "vec_id").where(F.expr(anchors)).where("vec_id IS NOT NULL")
    an = who.withColumnRenamed("vec_id", "id").mapInArrow(_pack(scale), _BLOCK).mapInArrow(rows_of, "id long, label long, vec binary").distinct()
    an = cut_lineage(an.withColumn("ak", F.monotonically_increasing_id()))
    n_labels = max(an.select("label").distinct().count(), 1)
    each = _pairs(order, width)
    first = Window.partitionBy("ak").orderBy(F.desc("score"), F.col("id").asc_nulls_last())

    # positives: same label, thresholds go down until ``positives`` are found
    active, found = an, None
    for share in (EXPECT * positives * n_labels / max(total, 1), 32 * EXPECT * positives * n_labels / max(total, 1), 1.0):
        def kernel(batches, share=share):
            for q, cols, (x, ids, none, labels) in each(batches):
                mine, own = cols["label"].to_numpy(), cols["id"].to_numpy()
                ok = (mine[:, None] == labels) & ((own[:, None] != ids) | none)
                t = _threshold(q, mean, spread, share)
                i, k, s = scores_above(q, x, t, order, ok)
                top = _best(i, s, none[k], ids[k], positives)
                yield pa.record_batch([cols["ak"].take(pa.array(i[top])), pa.array(s[top]), pa.array(ids[k[top]], mask=none[k[top]])],
                                      names=["ak", "score", "id"])
        got = _search(blocks, active, [], kernel, "ak long, score long, id long",
                      lambda df: df.withColumn("r", F.row_number().over(first)).where(F.col("r") <= positives))
        if got is None:
            break
        full = got.groupBy("ak").count().where(F.col("count") >= positives).select("ak")
        last = share >= 1
        got_whole = got if last else got.join(full, "ak", "left_semi")
        found = got_whole if found is None else found.unionByName(got_whole)
        if last:
            break
        active = cut_lineage(active.join(full, "ak", "left_anti"))
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if found is None:
        return spark.createDataFrame([], out)

    # windows: caps, floors and the thresholds of the first two rounds
    def bounds(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            p = column(batch, "score").to_numpy()
            q = np.stack([np.frombuffer(v, np.int64) for v in column(batch, "vec").to_pylist()])
            cap, least = (high * p) // 100, -((-low * p) // 100)
            beyond = _tail(cap, q, mean, spread)
            t = [np.maximum(least, np.minimum(_threshold(q, mean, spread, np.minimum(beyond + EXPECT * k * negatives / max(total, 1), 1.0)), cap))
                 for k in (1, 32)]
            yield pa.record_batch([*[column(batch, c) for c in ("ak", "r", "pid", "score")], pa.array(cap), pa.array(least), *map(pa.array, t)],
                                  names=["ak", "r", "pid", "score", "cap", "least", "t0", "t1"])

    items = found.select("ak", "r", F.col("id").alias("pid"), "score").join(an.select("ak", "vec"), "ak").mapInArrow(
        bounds, "ak long, r int, pid long, score long, cap long, least long, t0 long, t1 long").where("least <= cap")
    items = cut_lineage(items)
    nth = Window.partitionBy("ak", "r").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    active, filled = items, None
    for now in ("t0", "t1", "least"):
        def kernel(batches):
            for q, cols, (x, ids, none, labels) in each(batches):
                t, cap, place = [np.array(cols[f].to_pylist()) for f in ("t", "cap", "r")]     # one column per positive
                mine = cols["label"].to_numpy()
                i, k, s = scores_above(q, x, t.min(1), order, mine[:, None] != labels)
                for c in range(t.shape[1]):
                    fits = np.flatnonzero((s >= t[i, c]) & (s <= cap[i, c]))
                    fits = fits[_best(i[fits], s[fits], none[k[fits]], ids[k[fits]], negatives)]
                    yield pa.record_batch([cols["ak"].take(pa.array(i[fits])), pa.array(place[i[fits], c].astype(np.int32)), pa.array(s[fits]),
                                           pa.array(ids[k[fits]], mask=none[k[fits]])], names=["ak", "r", "score", "id"])
        # the windows of an anchor side by side; a window that is full or absent asks for nothing
        side = active.groupBy("ak").agg(F.map_from_entries(F.collect_list(F.struct("r", F.struct(F.col(now).alias("t"), "cap")))).alias("w"))
        slots = F.sequence(F.lit(1), F.lit(positives))
        empty = F.struct(F.lit(-NOTHING).alias("t"), F.lit(NOTHING).alias("cap"))
        lists = F.transform(slots, lambda r: F.coalesce(F.try_element_at("w", r), empty))
        asks = side.select("ak", lists.alias("w")).select("ak", F.col("w.t").alias("t"), F.col("w.cap").alias("cap"),
                                                          F.sequence(F.lit(1), F.lit(positives)).alias("r"))
        got = _search(blocks, an.join(asks, "ak"), ["t", "cap", "r"], kernel, "ak long, r int, score long, id long",
                      lambda df: df.withColumn("rank", F.row_number().over(nth)).where(F.col("rank") <= negatives))
        if got is None:
            break
        whole = got.groupBy("ak", "r").count().where(F.col("count") >= negatives).select("ak", "r")
        whole = cut_lineage(whole.unionByName(active.where(F.col(now) == F.col("least")).select("ak", "r")).distinct())
        part = got.join(whole, ["ak", "r"], "left_semi")
        filled = part if filled is None else filled.unionByName(part)
        active = cut_lineage(active.join(whole, ["ak", "r"], "left_anti"))
    if filled is None:
        return spark.createDataFrame([], out)
    pos = items.select("ak", "r", "pid", F.col("score").alias("positive_score"))
    return (filled.join(pos, ["ak", "r"]).join(an.select("ak", F.col("id").alias("anchor_id")), "ak")
            .select("anchor_id", F.col("pid").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))


ORACLE_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, p.positive_score,
       s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score
  AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 3
"""
