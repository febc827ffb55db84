"""The operators against brute force on small tables."""
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from kestrel.llm import (cotrain, decontaminate, hilbert, huffman, packing, perplexity, simhash, substring, toxicity,
                         viterbi)
from kestrel.llm.components import components

SF_SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def small(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and
    columns whose names the operators use themselves."""
    base = [f"w{i % 97} v{i % 13} word{i}" for i in range(120)]
    long = " ".join(base)
    rows = [(1, long, "en", "a", 5), (2, long, "en", "a", 5), (2, long, "en", "a", 5), (3, None, None, None, None),
            (4, "", "de", "b", 0), (5, "  \n ", "de", "b", 4), (None, long + " tail", "en", None, 9),
            (7, "One two", "fr", "a", 7), (8, " ".join(base[10:40]) + " x y z", "en", "c", None),
            (9, " ".join(base * 30), "en", "a", 10**6), (10, "É A a, a; A a\na a a", "es", "c", 3)]
    rows = [(*r, 1, "t", 2) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "d int, t string, fp int")


@pytest.fixture(scope="session")
def empty(small):
    return small.where("false")


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def order(x):
    return sorted(x, key=repr)


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def brute_removal(docs, k=13):
    first = {}
    for d, t in docs:
        w = WORD.findall(t or "")
        for i in range(len(w) - k + 1):
            key = tuple(w[i:i + k])
            first[key] = min(first.get(key, 1 << 63), (1 << 63) - 1 if d is None else d)
    out = []
    for d, t in docs:
        w, drop = WORD.findall(t or ""), set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i:i + k])] < ((1 << 63) - 1 if d is None else d):
                drop |= set(range(i, i + k))
        left = " ".join(v for i, v in enumerate(w) if i not in drop)
        out.append((d, len(w), len(drop), hashlib.sha256(left.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("bits", [64, 10])
def test_substring(small, bits):
    """With 10 hash bits nearly every span collides and is repaired."""
    res, spans = substring.repeated_spans(small, hash_bits=bits)
    assert order(tuple(r) for r in res.collect()) == order(brute_removal(rows(small)))
    if bits == 64:
        assert spans.count() > 0
        p = substring.paths(spans).collect()
        assert p and all(r["windows"] > 0 for r in p)


@pytest.mark.parametrize("bits", [16, 18])
def test_substring_buckets(bits):
    """Every edge lies in its bucket, also where there are more than 65 536,
    and repeats across cuts are found there."""
    r = np.random.default_rng(2)
    text = " ".join(f"t{x}" for x in r.integers(0, 10**6, 3000))
    cut = lambda d: pa.record_batch([pa.array([d], pa.int64()), pa.array([text])], names=["d", "t"])
    got = [pa.Table.from_batches(list(substring._edges(13, bits, 1, 64)(iter([cut(d)])))) for d in (1, 2)]
    want = np.sort(substring.window_hashes(*substring.split_words(pa.array([text])), 13)[0])
    edges, claimed = [], []
    both = pa.concat_tables(got)
    for x in sorted(set(both["bucket"].to_pylist())):
        table = both.filter(pa.compute.equal(both["bucket"], x))
        for raw in table["edges"].to_pylist()[:1]:
            h = np.zeros((len(raw) // 7, 8), np.uint8)
            h[:, :7] = np.frombuffer(raw, np.uint8).reshape(-1, 7)
            edges += (h.view(np.uint64).ravel() | np.uint64((x >> (bits - 8)) << 56)).tolist()
        for row in substring._owners(bits, 1)(table).to_pylist():
            claimed += substring._owner_unpack([row[n] for n in ("doc", "edge", "owner", "place")])[1].tolist()
    assert sorted(edges) == want.tolist() and sorted(claimed) == want.tolist()


def test_substring_text_and_columns(small):
    out = substring.remove_repeats(small, n_chars="n_chars")
    assert out.schema.names == small.schema.names and out.count() == small.count()
    gone = {r["doc_id"]: r for r in out.collect()}
    assert gone[2]["text"] == "" and gone[2]["n_chars"] == 0 and gone[3]["text"] is None and gone[1]["n_chars"] == 5


def brute_contamination(docs, items, k=13):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    win = defaultdict(set)
    for i, t in items:
        w = rx.findall(lower(t))
        m = min(len(w), k)
        for s in range(len(w) - m + 1 if w else 0):
            win[tuple(w[s:s + m])].add(str(i))
    out = []
    for d, t in docs:
        w, hit, got = rx.findall(lower(t)), set(), set()
        for key, who in win.items():
            for s in range(len(w) - len(key) + 1):
                if tuple(w[s:s + len(key)]) == key:
                    hit |= set(range(s, s + len(key)))
                    got |= who
        out.append((d, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_contamination(spark, small):
    base = [f"w{i % 97} v{i % 13} word{i}" for i in range(120)]
    items = [(1, " ".join(base[3:9])), (2, "a A"), (3, None), (4, ""), (5, "ONE"), (11, " ".join(base[50:54]) + " nothing"), (5, "One")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.digest(decontaminate.contamination(small, bench)).collect()
    assert order(tuple(r) for r in got) == order(brute_contamination(rows(small), items))
    left = decontaminate.remove_contaminated(small, bench)
    assert left.columns == small.columns and 7 not in {r["doc_id"] for r in left.collect()}
    assert decontaminate.contamination(small, bench.where("false")).where("n_hit > 0").count() == 0


def brute_fp(t, n=3):
    import xxhash
    w = WORD.findall(lower(t))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + n]).encode(), 42) for i in range(max(len(w) - n + 1, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(small):
    got = {(r["doc_id"], r["fingerprint"]) for r in simhash.digest(simhash.simhash_groups(small)).collect()}
    assert got == {(d, f"{brute_fp(t):016x}") for d, t in rows(small)}


@pytest.mark.parametrize("probe", [0, 8192])
def test_close_pairs(spark, probe):
    """All pairs at a distance of 2, by joining and by probing."""
    r = np.random.default_rng(3)
    seeds = r.integers(0, 1 << 63, 12, dtype=np.int64)
    fps = sorted({int(s) ^ int(np.bitwise_or.reduce(1 << r.integers(0, 63, k))) for s in seeds for k in (1, 1, 2, 2, 3)} | set(seeds.tolist()))
    want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    assert {tuple(x) for x in simhash.close_pairs(df, probe_above=probe).collect()} == want and want


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (95, 90), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 90, 90: 90, 95: 90}


def test_near_dedup(small):
    left = simhash.near_dedup(small)
    assert left.columns == small.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert 1 in ids and 2 not in ids and 4 not in ids and 3 in ids


def test_rows_are_removed_each_by_its_own_text(spark):
    """Clean rows of a hot null or shared doc_id stay; of a group one row."""
    r = np.random.default_rng(4)
    text = [" ".join(f"t{x}" for x in r.integers(0, 10**6, 60)) for _ in range(6)]
    schema = "doc_id long, text string, source string"
    docs = spark.createDataFrame([(None, text[0], "a"), (None, text[1], "a"), (7, text[1], "a"), (7, text[2], "a"), (None, text[3], "b"),
                                  (None, text[3], "a"), (8, text[4], "a"), (9, text[4], "a"), (9, text[5], "a"), (None, None, "a")], schema)
    want = [(None, text[0]), (7, text[1]), (7, text[2]), (None, text[3]), (8, text[4]), (9, text[5]), (None, None)]
    assert order(rows(simhash.near_dedup(docs))) == order(want)
    bench = spark.createDataFrame([(1, text[0]), (2, text[2])], "item_id long, text string")
    left = decontaminate.remove_contaminated(docs, bench)
    assert left.columns == docs.columns and order(rows(left)) == order(x for x in rows(docs) if x[1] not in (text[0], text[2]))


def test_hilbert_curve(spark):
    g = spark.range(1 << 9).select(*[F.expr(f"(id >> {3 * i}) & 7").alias(f"c{i}") for i in range(3)])
    got = g.withColumn("h", hilbert.hilbert_index([F.col(f"c{i}") for i in range(3)], 3)).orderBy("h").toPandas()
    assert (got.h == np.arange(512)).all()
    assert (np.abs(np.diff(got[["c0", "c1", "c2"]].to_numpy(), axis=0)).sum(1) == 1).all()


def test_shards(small):
    got = hilbert.digest(hilbert.hilbert_shards(small, 4)).collect()
    want = order((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows(small))
    assert order((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def tokens(t):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")


def test_encoder_matches_tokenizer():
    from kestrel.llm.tokens import default_path, encoder
    texts = ["<|endoftext|> A<|STARTOFTEXT|>x,", "don't Say's it's, O'K.", "É ÉCOLE İ ß!? Σ ΑΣ word..,x 12a", "a\x1cb   c", "", "x###"]
    ids, off = encoder(default_path()).documents(pa.array(texts), 1)
    for i, t in enumerate(texts):
        assert ids[off[i]:off[i + 1]].tolist() == tokens(t).tolist()


def test_packing(small):
    got = packing.pack(small, size=64).collect()
    want = order((d, p // 64, p, zlib.crc32(ids[p:p + 64].tobytes())) for d, t in rows(small) for ids in [tokens(t)] for p in range(0, len(ids), 64))
    assert order((r["doc_id"], r["piece"], r["start"], r["ids_crc32"]) for r in got) == want
    seq = defaultdict(list)
    for r in got:
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seq.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 64
    assert len(seq) == -(-sum(r["length"] for r in got) // 64)
    assert sum(r["n_ids"] for r in packing.sequences(packing.pack(small, size=64)).collect()) == sum(r["length"] for r in got)


@pytest.mark.parametrize("seed", range(8))
def test_plan(seed):
    r = np.random.default_rng(seed)
    counts = Counter(r.integers(1, 300, int(r.integers(1, 2000))).tolist())
    use, seen = defaultdict(list), Counter()
    for n, first, m, each, seq, at in packing.plan(counts, 400):
        assert first == seen[n]
        seen[n] += m
        for k in range(m):
            use[seq + k // each].append((at + k % each * n, n))
    assert seen == counts
    for s in use.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 400


def test_huffman_lengths_and_round_trip():
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 400):
        counts = (r.pareto(0.5, n) * 9 + 1).astype(np.int64)
        size = huffman.code_lengths(counts, 10)
        assert size.max() <= 10 and (n == 1 or abs((0.5 ** size).sum() - 1) < 1e-12)
        ids = r.permutation(60000)[:n]
        code = huffman.Code(ids, size)
        blocks = [r.choice(ids, m) for m in (1, 255, 256, 257, 3000)]
        enc = [huffman.encode(code, b) for b in blocks]
        assert (huffman.decode(code, [e[0] for e in enc], [e[1] for e in enc], [len(b) for b in blocks]) == np.concatenate(blocks)).all()


def test_id_files(spark, small):
    got = sorted((tuple(r) for r in huffman.digest(huffman.read_ids(spark, huffman.write_ids(small))).collect()), key=lambda x: x[1])
    assert order((d, n, c) for d, _, n, c in got) == order((d, len(i), zlib.crc32(i.tobytes())) for d, t in rows(small) for i in [tokens(t)])
    at, last = 0, -1
    for d, start, n, _ in got:
        assert start == at and (d if d is not None else -1) >= last
        at, last = at + n, d if d is not None else -1


def test_quality_rules(small):
    got = perplexity.digest(perplexity.quality_rules(small)).collect()
    want = []
    for d, t in rows(small):
        w = WORD.findall(t or "")
        tri = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        rep = {j for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep),
                     len(w) < 50 or 100 * len(rep) > 50 * len(w)))
    assert order(tuple(r)[:7] for r in got) == order(want)
    assert all(not r["kept"] for r in got if r["base_failed"])


def test_kneser_ney_sums_to_one(spark):
    """For every context the probabilities of all next characters and the
    weight left for unseen ones add up to one."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where("lang = 'en'")
    src = docs.select(F.col("text").alias("t"), "lang")
    rows_ = perplexity.kneser_ney(perplexity.count_grams(src)).toPandas()
    uni = rows_[rows_.k == 1]
    unseen = np.exp(rows_[rows_.k == 0].logp.iloc[0])
    assert abs(np.exp(uni[uni.logp > -99].logp).sum() + unseen - 1) < 1e-6
    two = rows_[rows_.k == 2].copy()
    two["ctx"] = two.gram // (1 << perplexity.CHAR_BITS)
    p1 = dict(zip(uni.gram, np.exp(uni.logp)))
    back = dict(zip(uni.gram, np.exp(uni.backoff)))
    for ctx, g in list(two.groupby("ctx"))[:20]:
        low = sum(p1[x % (1 << perplexity.CHAR_BITS)] for x in g.gram)
        assert abs(np.exp(g.logp).sum() + back[ctx] * (1 - low) - 1) < 1e-6


def test_perplexity_rejects_noise(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    r = np.random.default_rng(0)
    noise = " ".join("".join(r.choice(list("qxzjkvw0579QXZ"), 7)) for _ in range(300))
    got = perplexity.quality_rules(docs.unionByName(spark.createDataFrame([(10**9, noise, "en")], docs.schema)))
    assert not got.where("doc_id = 1000000000").first()["kept"]
    assert got.where("kept").count() > 0.8 * docs.count()


def test_every_ngram_keeps_its_own_entry(spark, monkeypatch):
    """Over many buckets, every text is scored by its own n-grams of its own
    language (all occur twice, so by their own probabilities)."""
    monkeypatch.setattr(perplexity, "GRAMS_PER_BUCKET", 40)
    texts = [("a", "one two\n three"), ("z", "one twos 日本 tree"), ("", "x"), ("z", "  ")]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts * 2)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["log_ppl"] for r in perplexity.score(docs, perplexity.train(docs)).collect()}
    model = perplexity.train(docs)
    assert model.groupBy("lang", "gram").count().where("count > 1").count() == 0
    p = {(r["lang"], r["gram"]): r["logp"] for r in perplexity.kneser_ney(perplexity.count_grams(docs.withColumnRenamed("text", "t"))).collect()}
    for i, (lang, t) in enumerate(texts * 2):
        words, off = perplexity.split_words(pa.array([t]))
        grams = perplexity.text_grams(words, off)[0].tolist()
        want = -sum(p[lang, g] for g in grams) / (len(" ".join(t.split())) + 1) if grams else None
        assert got[i] == (pytest.approx(want, abs=1e-5) if grams else None)


def test_discounts_are_of_all_ngrams(spark):
    """Single n-grams are in the counts of counts; n-grams run across words
    and no two characters share a unit."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where("lang = 'en'").select(F.col("text").alias("t"), "lang")
    counts = perplexity.count_grams(docs).toPandas()
    n = Counter(counts[counts.gram // (1 << 4 * perplexity.CHAR_BITS) > 0].n.tolist())
    d1 = 1 - 2 * n[1] / (n[1] + 2 * n[2]) * n[2] / n[1]
    top = [rows_ for _, rows_ in perplexity._levels(perplexity.count_grams(docs), 2)][-1].toPandas()
    lone = top.groupby("ctx").filter(lambda g: len(g) == 1 and g.n.iloc[0] == 1)
    assert len(lone) and np.allclose(np.exp(lone.weight), d1) and abs(d1 - 0.5) > 1e-3
    words, off = perplexity.split_words(pa.array(["ab c"]))
    assert perplexity.text_grams(words, off)[0].tolist()[3] & 0xFFFFFF == (35 << 12) + ord("c") + 3
    every = [c for c in range(33, 0x110000) if not 0xD800 <= c < 0xE000]
    unit, size = perplexity._units(pa.array([chr(c) for c in every]))
    end = np.cumsum(size)
    assert len({tuple(unit[i:j]) for i, j in zip((end - size).tolist(), end.tolist())}) == len(every) and unit.max() < 1 << 12


def test_perplexity_rejects_moderate_junk(spark):
    """Letters shuffled in a third of the words, text under another
    language's name and random letters, of 50 to 300 words."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    r = np.random.default_rng(1)
    other = {"en": "fr", "fr": "de", "de": "es", "es": "en"}
    long = [x for x in docs.collect() if len(x["text"].split()) >= 60][:24]
    mixed = lambda w: "".join(r.permutation(list(w)))
    junk = []
    for i, x in enumerate(long):
        w, lang = x["text"].split()[:int(r.integers(50, 301))], x["lang"]
        if i % 3 == 0:
            w = [mixed(v) if r.random() < 0.33 else v for v in w]
        elif i % 3 == 1:
            lang = other[lang]
        else:
            w = ["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), int(r.integers(2, 10)))) for _ in w]
        junk.append((10**9 + i, " ".join(w), lang))
    got = perplexity.quality_rules(docs.unionByName(spark.createDataFrame(junk, docs.schema))).where("not base_failed").toPandas()
    planted = got.doc_id >= 10**9
    assert (~got[planted].kept).mean() > 0.9 and got[~planted].kept.mean() > 0.97


def test_viterbi_matches_library(small):
    from tokenizers import Tokenizer, models, normalizers
    vocab = viterbi.vocabulary(viterbi.default_path())
    tok = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    tok.normalizer = normalizers.Sequence([normalizers.Prepend(viterbi.SPACE), normalizers.Replace(" ", viterbi.SPACE)])
    got = viterbi.token_counts(small).collect()
    assert order((r["doc_id"], r["n_tokens"]) for r in got) == order((d, len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t in rows(small))
    texts = [" ", "  a  b ", "日本語 x🙂🙂y", "<0x41> <s>", "▁a ▁ b"]
    n, _ = viterbi.counter(viterbi.default_path()).counts(pa.array(texts))
    assert n.tolist() == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("seed", range(20))
def test_viterbi_ties(seed):
    from tokenizers import Tokenizer, models
    r = np.random.default_rng(seed)
    pieces = sorted({"".join(r.choice(list("ab▁c"), r.integers(1, 4))) for _ in range(12)})
    vocab = [("<unk>", 0.0)] + [(p, float(-r.integers(1, 4))) for p in pieces]
    text = "".join(r.choice(list("abc▁d"), 40))
    want = len(Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=False)).encode(text).ids)
    assert viterbi.Counter(vocab, False).viterbi(text)[0] == want


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    tox = toxicity.digest(toxicity.toxicity(docs, labels)).join(labels, "doc_id").toPandas()
    assert tox.score.between(0, 1).all() and ((tox.score >= 0.3) == (tox.predicted == 1)).all()
    held = tox[tox.held_out]
    assert (held[held.toxic == 0].predicted == 0).mean() > 0.95
    assert (tox[~tox.held_out & (tox.toxic == 1)].predicted == 1).mean() > 0.8
    q = cotrain.quality(docs, labels).join(labels, "doc_id").toPandas()
    held = q[[zlib.crc32(str(d).encode()) % 4 == 2 for d in q.doc_id]]
    assert held[held.quality == 1].kept.mean() > 0.98 and (~held[held.quality == 0].kept).mean() > 0.4


def test_classifiers_on_odd_rows(spark, small, empty):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (9, 0, 1), (10, 1, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.where("false")):
        assert toxicity.toxicity(small, lab).count() == small.count()
        assert cotrain.quality(small, lab).count() == small.count()
    kept = cotrain.keep_quality(small, labels.where("false"))
    assert kept.columns == small.columns and kept.where("trim(text) = ''").count() == 0


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (decontaminate.contamination(empty, bench), perplexity.quality_rules(empty), substring.substring_dedup(empty),
               hilbert.hilbert_shards(empty), cotrain.quality(empty, labels), huffman.read_ids(spark, huffman.write_ids(empty)),
               packing.pack(empty), viterbi.token_counts(empty), simhash.simhash_groups(empty), toxicity.toxicity(empty, labels),
               substring.remove_repeats(empty), simhash.near_dedup(empty), cotrain.keep_quality(empty, labels)):
        assert df.count() == 0
