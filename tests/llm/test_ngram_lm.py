import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from llm_cases import AWKWARD, frame

from gravelock.llm import ngram_lm
from gravelock.llm.elias_fano import EliasFano
from gravelock.llm.ngram_lm import lm_scores


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((1, 1), (5, 3), (1000, 50), (1000, 10**6), (70_000, 10**12), (300, 0), (20_000, 25_000)):
        v = np.sort(rng.integers(0, top + 1, n))
        e = EliasFano.build(v)
        assert (e.get(np.arange(n)) == v).all()
        begin = rng.integers(0, n + 1, 2000)
        end = np.minimum(n, begin + rng.integers(0, 60, 2000))
        target = np.where(rng.random(2000) < 0.5, v[np.minimum(begin, n - 1)] + rng.integers(0, 3, 2000), rng.integers(0, 2 * top + 2, 2000))
        want = [b + int(np.searchsorted(v[b:z], t)) for t, b, z in zip(target, begin, end, strict=True)]
        assert e.successor(target, begin, end).tolist() == want
    assert EliasFano.build(np.empty(0, np.int64)).n == 0


def brute(docs, class_tokens):
    """The same model by dictionaries of words; the choice among a frequent word's contexts is the operator's."""
    begin, end = b"<s>", b"</s>"
    split = lambda t: [*(t or "").encode().lower().split(), end]
    crc = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7
    training = [split(t) for i, t in docs if crc(i) != 2]
    c = Counter(w for t in training for w in t)
    n, v = sum(c.values()), len(c)
    known = ngram_lm.Digests()
    digest = lambda w: np.array([{begin: ngram_lm.BEGIN, end: ngram_lm.END}.get(w) or known[w]]).view(np.uint64)

    def history(t, k):
        u, s = (t[k - 2] if k > 1 else begin), (t[k - 3] if k > 2 else begin)
        kinds = 1 + c[t[k - 1]] // class_tokens
        far = digest(s) if c[u] >= class_tokens else np.zeros(1, np.uint64)
        return (t[k - 1], int(ngram_lm.mixed(digest(u), far)[0] % np.uint64(kinds)) if kinds > 1 else 0), u

    one, two = {}, {}  # context -> how often each word follows
    for t in training:
        for k in range(1, len(t)):
            h, u = history(t, k)
            one.setdefault(h, Counter())[t[k]] += 1
            two.setdefault((h, u), Counter())[t[k]] += 1
    p1 = lambda w: (c[w] + 1) / (n + v + 1)

    def after(follow, w, rest):
        if not follow:
            return rest
        total = sum(follow.values())
        return max(follow[w] - 0.75, 0) / total + 0.75 * len(follow) / total * rest

    p = lambda h, u, w: after(two.get((h, u)), w, after(one.get(h), w, p1(w)))
    rows = []
    for i, t in docs:
        t = split(t)
        log = [math.log10(p(*history(t, k), t[k]) if k else p1(t[k])) for k in range(len(t))]
        rows.append((i, crc(i) == 2, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10(p1(w)) for w in t), sum(log)))
    for h, u in list(two)[:20]:
        assert abs(sum(p(h, u, w) for w in c) + p(h, u, b"never seen") - 1) < 1e-9
    return rows


def test_scores_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    one = [(2, "held out only")] if zlib.crc32(b"2") % 7 == 2 else [(1, "one")]
    for rows, class_tokens, shard_tokens in ((docs, 1 << 18, 1 << 20), (docs, 40, 5000), ([r[:2] for r in AWKWARD], 100, 1000), (one, 5, 5)):
        got = sorted(lm_scores(frame(spark, rows).repartition(3), None, class_tokens, shard_tokens).collect(), key=str)
        want = sorted(brute(rows, class_tokens), key=str)
        for g, w in zip(got, want, strict=True):
            assert tuple(g)[:5] == w[:5]
            assert abs(g.base_score - w[5]) <= 1e-9 * abs(w[5]) + 1e-9
            assert abs(g.score - w[6]) <= 6e-4 * w[2], (g, w)
    assert lm_scores(frame(spark, [])).count() == 0


def test_scores_do_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    some = [sorted(map(tuple, lm_scores(docs.repartition(k), None, 1000, shards).select("doc_id", "score").collect())) for k, shards in ((1, 1 << 20), (7, 3000))]
    assert some[0] == some[1]


def test_scores_do_not_depend_on_what_is_frequent(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs += [(10**6 + k, f"the same beginning of many texts, and then {k}") for k in range(60)] + [(None, None), (7, "")]
    exact = sorted(brute(docs, 1 << 40), key=str)
    for shard_tokens, hot_tokens in ((1 << 20, 1 << 18), (3000, 1 << 18), (4000, 1000), (3000, 20), (2000, 1)):
        got = sorted(map(tuple, lm_scores(frame(spark, docs).repartition(3), shard_tokens=shard_tokens, hot_tokens=hot_tokens).collect()), key=str)
        if hot_tokens == 1 << 18 and shard_tokens > 3000:
            whole = got
            for g, w in zip(got, exact, strict=True):
                assert g[:5] == w[:5] and abs(g[6] - w[6]) <= 6e-4 * w[2], (g, w)
        assert [r[:5] + r[6:] for r in got] == [r[:5] + r[6:] for r in whole], (shard_tokens, hot_tokens)


def test_held_out_texts_and_copies_are_told_apart(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    r = lm_scores(docs).where("held_out").groupBy().sum("base_score", "score").first()
    assert r[1] > r[0]
    a, b, c = [i for i in range(10**7, 10**7 + 30) if not ngram_lm.held_out(i)][:3]
    twice = spark.createDataFrame([(k, " ".join(f"{'once' if k == c else 'twice'}{j}here" for j in range(80))) for k in (a, b, c)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_scores(docs.union(twice)).where(f"doc_id >= {10**7}").collect()}
    assert got[a] == got[b] > got[c] + 10


def test_long_text_and_extra_columns(spark):
    long = " ".join(f"w{i % 977} w{i % 31}" for i in range(200_000))
    got = {r.doc_id: r for r in lm_scores(frame(spark, [(1, long), (3, long), (4, "w1 w2")])).collect()}
    assert got[1].n_tokens == 400_001 and got[1].score == got[3].score > got[1].base_score


def test_trie_is_compact(spark, sf_dir, tmp_path):
    lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"file://{tmp_path}/model").count()
    tries = [ngram_lm.Trie(ngram_lm.mapped(f"file://{f}")) for f in (tmp_path / "model").iterdir() if f.suffix == ".trie"]
    for name, most in (("next", 6), ("both", 4)):
        kids = [getattr(t, name).kid for t in tries]
        n = sum(k.n for k in kids)
        assert n > 1000 and sum(len(k.low) + 8 * len(k.high) for k in kids) < most * n


class Here:
    """Stands for a table: gives back the function that a worker would run."""

    def mapInArrow(self, run, schema):
        return run


def shard(rng, batches, n, kinds):
    """A shard's lists of n random trigrams from each batch."""
    lists = []
    for _ in range(batches):
        context = np.sort((rng.random(n) ** 3 * kinds).astype(np.int64)) << 24
        edge = ngram_lm.heads(context)
        u, w, doc = rng.integers(0, 50, n), (rng.random(n) ** 2 * kinds).astype(np.int64), rng.integers(0, 2000, n)
        lists.append(ngram_lm.squeezed(context[edge], np.diff(edge, append=n), u, w, doc))
    return pa.RecordBatch.from_arrays([pa.array([0] * batches, pa.int32()), pa.array(range(batches), pa.int64()), pa.array(lists, pa.binary())], ["shard", "batch", "trigrams"])


def level_one(kinds):
    n = np.arange(1, 4, dtype=np.int64)
    return ngram_lm.Words("", 1, kinds, 10**6, (ngram_lm.band(n[::-1], 10**6 + kinds + 1), np.array([0, kinds // 3, kinds // 2])))


def test_memory_of_a_shard(tmp_path):
    lists, none = shard(np.random.default_rng(0), 40, 1 << 15, 30_000), np.empty(0, np.int64)
    run = ngram_lm.answered(Here(), level_one(30_000), ngram_lm.Successors("", 1, 1, none, none), f"file://{tmp_path}", False)
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in run(iter([lists]))) == 40
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 100 << 20, peak >> 20  # 1,310,720 trigrams


def test_pieces_of_a_shard_do_not_change_sums(tmp_path):
    rng, none = np.random.default_rng(1), np.empty(0, np.int64)
    lists = shard(rng, 7, 3000, 400)
    args = Here(), level_one(400), ngram_lm.Successors("", 1, 1, none, none), f"file://{tmp_path}", False
    whole, *parts = ([b.to_pydict() for b in ngram_lm.answered(*args, tokens)(iter([lists]))] for tokens in (1 << 40, 5000, 700, 1))
    assert parts == [whole] * 3 and not list(tmp_path.iterdir())
