"""The layouts that small tables never reach: many blocks, turns, parts and lists; full filters; very long words."""

import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("runledger.llm.queries")
import public_tokenizers  # noqa: E402
import tokenizers  # noqa: E402

from runledger.llm import bpe, exact_topk, graph_search, near_dedup, token_counts, toxicity, vectors  # noqa: E402
from runledger.llm.bytepairs import vocabulary  # noqa: E402
from runledger.llm.common import tuned  # noqa: E402
from tests.llm.test_operators import _components  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_searches_over_many_blocks_and_turns(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "DATA", 8 * 90)
    monkeypatch.setattr(exact_topk, "BLOCK", 7)
    monkeypatch.setattr(graph_search, "SHARD", 8 * 150)
    monkeypatch.setattr(vectors, "PART", 8 * 10)
    monkeypatch.setattr(vectors, "TURN", 8 * 20)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    x[200:420] = x[7]  # a third of all rows are equal
    rows = [(i, [float(v) for v in x[i]]) for i in range(700)] + [(2000 + i, [float(i), 1.0]) for i in range(3)] + [(5, [float(v) for v in x[5]])]
    table = tuned(spark).createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("dim", F.lit("clash"))
    near = graph_search.search(table, F.col("vec_id") % 20 == 0, 10).toPandas()
    top = exact_topk.search(table, F.col("vec_id") % 20 == 0, 5).toPandas()
    ids = np.array([r[0] for r in rows if len(r[1]) == 8])
    d64 = np.array([r[1] for r in rows if len(r[1]) == 8])
    z, hits, asked = np.floor(256 * d64), 0, 0
    for q in np.flatnonzero(ids % 20 == 0).tolist():
        others = np.delete(np.arange(len(ids)), q)
        s = (z @ z[q])[others]
        order = np.lexsort((ids[others], -s))[:5]
        mine = top[top.query_id == ids[q]].sort_values("rank")
        assert mine.vec_id.tolist() == ids[others][order].tolist() and mine.score.tolist() == s[order].astype(int).tolist()
        d = np.sqrt(((d64 - d64[q]) ** 2).sum(1))[others]
        hits += len(set(ids[others][np.lexsort((ids[others], d))[:10]]) & set(near[near.query_id == ids[q]].vec_id))
        asked += 10
    assert hits >= 0.9 * asked
    small = top[top.query_id == 2000].sort_values("rank")
    assert small.vec_id.tolist() == [2001, 2002] and not set(top[top.query_id != 2000].vec_id) & {2000, 2001, 2002}


def test_bounds_discard_pairs():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(50, 64))
    for name, x, most in (("clusters", centres[rng.integers(0, 50, 3000)] + rng.normal(size=(3000, 64)) / 10, 0.01),
                          ("sphere", rng.normal(size=(3000, 64)), 0.1)):
        x = np.floor(256 * x)
        ids, queries = np.arange(1500), x[:40]
        allowed, left = np.arange(40)[:, None] != ids[None, :], []
        _, _, score = exact_topk.best_pairs(queries, exact_topk.Block(x[:1500]), allowed, 5, ids, np.full(40, -np.inf))
        floor = score.reshape(40, 5)[:, 4]
        q, c, score = exact_topk.best_pairs(queries, exact_topk.Block(x[1500:]), np.ones_like(allowed), 5, ids, floor, left)
        assert left == sorted(left, reverse=True) and left[-1] < most, (name, left)
        full = queries @ x[1500:].T
        for i in range(40):
            want = [j for j in np.lexsort((ids, -full[i]))[:5] if full[i, j] >= floor[i]]
            assert c[q == i].tolist() == want and score[q == i].tolist() == full[i, want].tolist()


def test_near_dedup_with_full_filter_parts_and_lists(spark, monkeypatch):
    rng = np.random.default_rng(2)
    words = np.array([f"w{i}" for i in range(400)])
    base, rows = rng.choice(words, 100), []
    for i in range(110):
        text = list(base)
        for k in rng.integers(0, 100, rng.integers(0, 12)):
            text[k] = str(rng.choice(words))
        rows.append((i, " ".join(text)))
    rows += [(None, rows[3][1] + " end"), (500, None), (501, ""), (3, rows[3][1])]
    docs = tuned(spark).createDataFrame(rows, "doc_id long, text string")
    want = _components([r for r in rows if r[0] is not None], 2, 80)
    for size in (1, 1 << 20):  # one word: nearly all pass
        monkeypatch.setattr(near_dedup, "FILTER", size)
        monkeypatch.setattr(near_dedup, "PART", 300)
        monkeypatch.setattr(near_dedup, "SHORT_LIST", 1)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.link(docs, width=2).collect() if r.doc_id is not None}
        assert got == want


def test_filter_loses_no_wanted_id(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "FILTER", 16)
    texts = spark.range(3000).select(F.when(F.col("id") > 0, F.col("id")).alias("id"), F.lit("t").alias("text"))
    wanted = texts.where("id % 50 = 0 or id is null").select(F.col("id").alias("least"))
    kept = {r.id for r in near_dedup.passing(texts, wanted).collect()}
    assert {None, *range(50, 3000, 50)} <= kept and len(kept) < 600


def test_very_long_words(library):
    vocab, rng = vocabulary(PATH), np.random.default_rng(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choice(list(kind), n)) for kind, n in
             ((letters, 1_000_000), (letters + letters.upper(), 100_000), ("a", 50_000), ("etaoin", 20_000), ("中文字符的是", 20_000), ("ab", 9_000))]
    for word in words:
        begun = time.monotonic()
        ids = bpe.Encoder(vocab).encode([word])[0].tolist()
        count = token_counts.merged_counts(vocab, [word.encode()]).tolist()
        assert time.monotonic() - begun < 30
        want = library.encode(word, add_special_tokens=False).ids
        assert ids == want and count == [len(want)] and bpe.decode(vocab, ids) == word
    assert token_counts.merged_counts(vocab, []).tolist() == []


def test_token_queries_of_empty_tables(spark):
    none = tuned(spark).createDataFrame([], "doc_id long, text string")
    assert token_counts.count_tokens(none, PATH).count() == 0 == bpe.decode_ids(bpe.encode(none, PATH), PATH).count()


def test_training_holds_its_gates_once_and_gives_back_what_it_held(spark, monkeypatch):
    words = [f"word{i}" for i in range(200_000)]
    model = toxicity.train(["good word", "bad word"] * 3, [0, 1] * 3, epochs=1)
    tracemalloc.start()
    try:
        held = model.gates(words).nbytes
        assert tracemalloc.get_traced_memory()[1] < 1.6 * held
    finally:
        tracemalloc.stop()
    order, train = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda *a: (train(*a), order.append("trained"))[0])
    monkeypatch.setattr(toxicity, "give_back", lambda: order.append("given back"))
    docs = spark.createDataFrame([(i, "so so") for i in range(9)], "doc_id long, text string")
    toxicity.fit(docs, docs.select("doc_id", F.lit(0).alias("toxic")))
    assert order == ["trained", "given back"]


def test_near_dedup_merges_labels_with_new_links_only(spark, monkeypatch):
    rng, seen, of = np.random.default_rng(6), [], near_dedup.components
    words = [f"w{i}" for i in range(300)]
    base, rows = [str(rng.choice(words)) for _ in range(100)], []
    for i in range(40):
        text = list(base)
        for k in rng.integers(0, 100, 2):
            text[k] = str(rng.choice(words))
        rows.append((i, " ".join(text)))

    def spied(edges):
        labels = of(edges)
        seen.append((edges.distinct().count(), labels.where("node <> label").count()))
        return labels

    monkeypatch.setattr(near_dedup, "components", spied)
    docs = tuned(spark).createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.link(docs, width=2).collect()}
    assert got == _components(rows, 2, 80)
    # The first round finds all; those after it read one edge for each other node instead of the links again.
    assert len(seen) == near_dedup.STARS + 1 and seen[0][0] > seen[0][1] == len(rows) - 1 and all(x[0] == len(rows) for x in seen[1:])
