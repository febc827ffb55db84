"""Token alignment against a brute force that encodes whole texts."""
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from kestrel.llm import alignment
from kestrel.session import cut_lineage

PIECES = ["a", "the", " ", "  ", "\n", "\t", " ", "é", "ß", "<s>", "<|endoftext|>", "123", "'s", "!?", "中文", "\u0085", "\x1c",
          "\x00", "word", "tion", " the", " of", "\u3000", "\u200b", "\U0001F600", "\u00a0", ",,"]


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer
    a, b = alignment.default_paths()
    tok = Tokenizer.from_file(a)
    tok.encode_special_tokens = True
    return tok, sentencepiece.SentencePieceProcessor(model_file=b)


def brute(tools, docs):
    """Tokens of the whole texts, groups by common ends, links by overlap."""
    tok, sp = tools
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(x): x for x in plain} | {chr(0x100 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}

    def spans(tokens):
        at, out = 0, []
        for i, raw in tokens:
            out.append((i, at, at + len(raw)))
            at += len(raw)
        return out
    per, counts = [], Counter()
    for d, t in docs:
        got = None
        if t:
            whole = tok.encode(" " + t, add_special_tokens=False)
            a = [(i, bytes(byte_of[c] for c in w)) for i, w in zip(whole.ids, whole.tokens)]
            b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode())
                 for i in sp.encode(t)]
            if b"".join(r for _, r in a) == (" " + t).encode() == b"".join(r for _, r in b):
                a, b = spans(a), spans(b)
                cuts = sorted({e for *_, e in a} & {e for *_, e in b})
                groups = ["|".join(",".join(str(i) for i, s, e in x if lo <= s and e <= hi) for x in (a, b))
                          for lo, hi in zip([0, *cuts], cuts)]
                links = [(i, j) for i, s, e in a for j, u, v in b if s < v and u < e]
                counts.update(links)
                got = len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()
        per.append((d, got))
    top = defaultdict(int)
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    return [(d, 0, 0, 0, 0, 0, 0, "") if g is None else
            (d, *g[:3], len(g[3]), sum(counts[x] == top[x[1]] for x in g[3]), sum(counts[x] for x in g[3]), g[4]) for d, g in per]


@pytest.fixture(scope="module")
def docs():
    r = random.Random(5)
    made = [(i, "".join(r.choice(PIECES) for _ in range(r.randint(1, 30)))) for i in range(120)]
    return made + [(None, "x y"), (200, None), (201, ""), (202, " "), (203, "  a "), (204, "the the\u2581 the"), (205, "same text"),
                   (205, "same text"), (206, "word " * 3000), (207, "x" * 5000)]


@pytest.mark.parametrize("cut", [300, 4 << 20])
def test_digest(spark, tools, docs, cut):
    """Counts reach over cuts, whatever their size."""
    df = spark.createDataFrame([(*r, 1, 2, "z") for r in docs], "doc_id long, text string, d int, cut int, pairs string")
    got = alignment.alignment_digest(df, cut_bytes=cut)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(tools, docs), key=repr)


def test_alignments(spark, tools, docs):
    got = alignment.alignments(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = {d: w for d, *w in brute(tools, docs)}
    for r in got:
        n_a, n_b, n_groups, *_, sha = want[r["doc_id"]]
        assert (len(r["a_ids"]), len(r["b_ids"]), len(r["group_a"]), len(r["group_b"])) == (n_a, n_b, n_groups, n_groups)
        a, b = [*r["group_a"], n_a], [*r["group_b"], n_b]
        text = ";".join(f"{','.join(map(str, r['a_ids'][a[i]:a[i + 1]]))}|{','.join(map(str, r['b_ids'][b[i]:b[i + 1]]))}"
                        for i in range(n_groups))
        assert (hashlib.sha256(text.encode()).hexdigest() if text else "") == sha


def test_runs_and_irregular_groups():
    """Groups are the common ends, also where irregular groups cancel out
    in the index and one comparison at a distance would see no change."""
    r = np.random.default_rng(3)
    cases = [([1, 3, 4], [2, 3, 4]), ([1, 2, 3], [3]), ([3], [1, 2, 3]), ([1, 3, 4, 6, 9], [2, 3, 5, 6, 9]), ([], [])]
    for n in (1, 2, 5, 40, 3000):
        for share in (0.02, 0.5):
            ends = np.flatnonzero(r.random(2 * n) < 0.7).tolist() + [2 * n]
            cases.append((ends, sorted({e for e in ends[:-1] if r.random() > share} | {2 * n})))
            cases.append((sorted({e for e in ends[:-1] if r.random() > share} | {2 * n}), ends))
    for a, b in cases:
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        ga, gb = alignment.align(a, b)
        cut = np.intersect1d(a, b)
        first = lambda x: np.append(0, np.searchsorted(x, cut)[:-1] + 1) if len(cut) else np.zeros(0)
        assert ga.tolist() == first(a).tolist() and gb.tolist() == first(b).tolist()


def test_empty(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").where("false")
    assert alignment.alignment_digest(df).count() == 0 and alignment.alignments(df).count() == 0
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {tuple(r) for r in alignment.alignment_digest(none).collect()} == {(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")}


def cuts_of(docs, rows, limit=4 << 20):
    """The worker's cuts of batches of so many rows, without their ids."""
    table = pa.table({"d": pa.array([d for d, _ in docs], pa.int64()), "t": pa.array([t for _, t in docs], pa.string())})
    got = alignment._cuts(alignment.default_paths(), limit)(iter(table.to_batches(rows)))
    return [{k: v for k, v in c.to_pylist()[0].items() if k != "cut"} for c in got]


def test_cuts_do_not_follow_batches(docs, monkeypatch):
    """Small batches give the same cuts; rows without text are bounded too."""
    assert len(cuts_of(docs, 3)) == 1 and cuts_of(docs, 3) == cuts_of(docs, len(docs))
    monkeypatch.setattr(alignment, "CUT_ROWS", 10)
    cuts = cuts_of([(i, None if i % 2 else "") for i in range(95)], 5)
    assert [len(c["doc"]) for c in cuts] == [10] * 9 + [5]


def test_worker_is_bounded(docs, monkeypatch):
    """What is encoded at a time and what stays known have bounds; what few
    cuts asked for goes first, and the cuts are the same."""
    r = random.Random(8)
    made = [(i, "the same " + " ".join(f"{r.choice(PIECES).strip()}{i}w{j}" for j in range(40))) for i in range(60)] + docs
    want = cuts_of(made, 4, 2000)
    monkeypatch.setattr(alignment, "_ALIGNERS", {})
    monkeypatch.setattr(alignment, "CACHE", 200)
    monkeypatch.setattr(alignment, "LEARN", 16)
    most, known, plain, learn = [], [], alignment.Aligner._encode_a, alignment.Aligner.documents

    def encode(self, texts):
        most.append(len(texts))
        return plain(self, texts)

    def documents(self, texts):
        had = set(self.known.to_pylist())
        out = learn(self, texts)
        known.append((len(had), " same" in had))
        return out
    monkeypatch.setattr(alignment.Aligner, "_encode_a", encode)
    monkeypatch.setattr(alignment.Aligner, "documents", documents)
    assert cuts_of(made, 4, 2000) == want
    assert max(most) <= 16
    tool = alignment.aligner(*alignment.default_paths())
    assert max(n for n, _ in known) > 200 and all(kept for _, kept in known[1:])
    tool.forget()
    assert len(tool.known) <= 100 and len(tool.flat["a"]) == tool.size["a"].sum() and len(tool.label) == len(tool.asked) == len(tool.good)


def test_cuts_have_row_groups_of_their_own(spark):
    """A row of megabytes fills a row group; Parquet looks after 100 rows otherwise."""
    words = "concat_ws('', transform(sequence(1, 60000), x -> sha2(concat(id, ' ', x), 256))) AS words"
    df = spark.range(12, numPartitions=1).selectExpr("id", words)
    got = cut_lineage(df, **alignment._FILES)
    files = [pq.ParquetFile(x.removeprefix("file:")).metadata for x in got.inputFiles()]
    assert sum(m.num_rows for m in files) == 12 and all(m.row_group(i).num_rows <= 4 for m in files for i in range(m.num_row_groups))
