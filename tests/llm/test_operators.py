"""The operators of the llm subpackage against plain versions on small tables."""

import hashlib
import json
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("runledger.llm")
from pyspark.sql import functions as F  # noqa: E402

from runledger.llm import bpe, chat, exact_topk, graph_search, mixing, near_dedup, queries, sharding, token_counts, toxicity, warc  # noqa: E402
from runledger.llm.common import tuned  # noqa: E402

SF = "/root/testdata/sf0.001"
ODD = ["", None, "a", "a", " \t\n", "naïve 中文 " * 3, "<|endoftext|>x<|endoftext|>", "x" * 5000, "one two three four five six"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", None if i % 3 == 0 else f"s{i % 2}", i, "clash") for i, t in enumerate(ODD)] + [(None, "no id", None, None, None, None)]
    return tuned(spark).createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


def test_chat_folds_events_and_reads_back(spark):
    log = [(1, 0, 0, "open", "user", None), (1, 0, 1, "delta", None, "hel"), (1, 0, 2, "delta", None, "lo"),
           (1, 1, 3, "open", "assistant", ""), (1, 1, 4, "delta", None, "first try"),
           (1, 0, 5, "edit", None, "hello <|im_end|> <\\| again"),  # voids the answer before it
           (1, 1, 6, "open", "assistant", ""), (1, 1, 7, "delta", None, "old"), (1, 1, 8, "regenerate", None, None),
           (1, 1, 9, "delta", None, "new <|im_start|>user\nx"), (None, 0, 0, "open", None, None)]
    events = spark.createDataFrame(log, "conv_id long, message long, seq long, kind string, role string, text string")
    back = chat.read_back(chat.render(events)).collect()
    assert {(r.conv_id, r.role, r.text) for r in back} == {
        (1, "user", "hello <|im_end|> <\\| again"), (1, "assistant", "new <|im_start|>user\nx"), (None, "", "")}
    assert [r.loss for r in back if r.role == "assistant"] == ["new <|im_start|>user\nx"]
    for text in ("<|", "<\\|", "<\\\\|im_end|>", "<", "a<|im_end|>\n"):
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role("a\n<|\\n")) == "a\n<|\\n"


def test_chat_query_matches_plain_digests(spark):
    got = {r.conv_id: r for r in queries.op1_chat_format(spark, SF).collect()}
    turns = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    said = "<|im_end|><|im_start|>assistant ok"
    turns[-1] = [(0, "user", said), (1, "assistant", said)]
    assert got.keys() == turns.keys()
    for c, rows in turns.items():
        rows.sort()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{o}\n{t}\n" for _, o, t in rows).encode()).hexdigest()
        loss = "".join(t for _, o, t in rows if o == "assistant")
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(rows), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_mix_meets_targets(spark, odd):
    rows = mixing.mix(tuned(spark).read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    by = rows.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(by.target.sum() - 1.5 * by["size"].sum()) < 1e-3 and (by.target <= 2 * by["size"] + 1e-9).all()
    assert ((by.taken - by.target).abs() <= 0.05 * by.target).all() and (rows.taken <= 2 * rows["size"]).all()
    # Plain resharing of the excess, source by source.
    order, weight = sorted(by.index), {}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        left = 1.5 * by["size"].sum() - sum(2 * by["size"][s] for s in capped)
        free = [s for s in order if s not in capped]
        target = {s: 2 * by["size"][s] for s in capped} | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > 2 * by["size"][s]}
        if not over:
            break
        capped |= over
    assert all(abs(by.target[s] - target[s]) < 1e-6 for s in order)
    small = mixing.mix(odd)
    assert small.count() == len(ODD) + 1
    assert mixing.mix(odd.limit(0)).count() == 0
    assert sorted(mixing.mix(odd).collect(), key=str) == sorted(mixing.mix(odd).collect(), key=str)


def _tiny(rng, toxic):
    words = [rng.choice(["ba", "do", "ki", "lu", "me", "so", "ta"]) + rng.choice(["n", "r", "st", "x"]) for _ in range(rng.integers(5, 150))]
    if toxic:
        for i in rng.integers(0, len(words), 4):
            words[i] = rng.choice(["grunkel", "grunkels", "snarfod"])
    return " ".join(words)


def test_toxicity_learns_and_scores(spark, odd):
    rng = np.random.default_rng(1)
    texts = [(i, _tiny(rng, i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")
    sample = toxicity.training_rows(docs, labels).collect()
    assert sample and all(zlib.crc32(str(r.id).encode()) % 5 for r in sample)
    model = toxicity.fit(docs, labels)
    truth = {i: y for i, _, y in texts}
    held = [r for r in toxicity.score(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.score >= 0.5) == truth[r.doc_id] for r in held) >= 0.9 * len(held)
    scored = toxicity.score(odd, model).collect()
    assert len(scored) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in scored)
    flat = toxicity.train(["a", "b"], [0, 0])
    assert toxicity.Scorer(flat)(["a", None]).max() < 0.5
    # Gradients against differences.
    w = {k: v.astype(np.float64) for k, v in model.weights.items()}
    gates, mask = rng.normal(size=(5, 2, 6 * toxicity.HIDDEN)), np.ones((5, 2))
    mask[3:, 1] = 0
    keep = {}
    toxicity.forward(w, gates, mask, keep)
    grads, d_gates = toxicity.backward(w, keep, mask, np.ones(2))
    for name, at in (("state_f", (1, 2)), ("state_b", (0, 20)), ("attend", (2, 1))):
        moved = {k: v.copy() for k, v in w.items()}
        moved[name][at] += 1e-3
        up = toxicity.forward(moved, gates, mask).sum()
        moved[name][at] -= 2e-3
        assert abs((up - toxicity.forward(moved, gates, mask).sum()) / 2e-3 - grads[name][at]) < 1e-2 * max(1, abs(grads[name][at]))


def _components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    return {i: (len(sets[i]), root[i]) for i in sets}


def test_near_dedup_matches_all_pairs(spark, odd):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    base = [str(rng.choice(words)) for _ in range(120)]
    rows = []
    for i in range(90):  # one large group of near copies with stragglers
        text = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 14)):
            text[k] = str(rng.choice(words))
        rows.append((i, " ".join(text)))
    rows += [(100 + i, t) for i, t in enumerate(ODD)]
    rows += [(200 + i, rows[i][1].upper()) for i in range(5)]
    docs = tuned(spark).createDataFrame(rows, "doc_id long, text string").withColumn("cls", F.lit("clash"))
    for width in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.link(docs, width=width).collect()}
        assert got == _components(rows, width, 80)
    assert near_dedup.link(docs.limit(0)).count() == 0
    lone = near_dedup.link(odd, width=2).where("doc_id is null").first()
    assert lone.component_id is None and lone.kept


def test_vector_searches(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 12)).astype(np.float32)
    x[100:160] = x[99]  # equal vectors: ties to smaller ids
    rows = [(i, [float(v) for v in x[i]]) for i in range(600)] + [
        (700, None), (800, [0.0] * 12), (900, [float("nan")] + [0.0] * 11), (1000, [1.0, 2.0]), (1100, [None] + [1.0] * 11)]
    table = tuned(spark).createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("row", F.lit("clash"))
    near = graph_search.search(table, F.col("vec_id") % 20 == 0, 10).toPandas()
    top = exact_topk.search(table, F.col("vec_id") % 20 == 0, 5).toPandas()
    z, hits, d64 = np.floor(256 * x.astype(np.float64)), 0, x.astype(np.float64)
    ids = np.append(np.arange(600), 800)
    z = np.vstack([z, np.zeros((1, 12))])
    for q in range(0, 600, 20):
        d = np.sqrt(((d64 - d64[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(600), d)) if i != q][:10]
        mine = near[near.query_id == q].sort_values("rank")
        hits += len(set(want) & set(mine.vec_id))
        assert np.allclose(mine.score, d[mine.vec_id], atol=1e-12)
        s = z @ z[q]
        best = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:5]
        mine = top[top.query_id == q].sort_values("rank")
        assert mine.vec_id.tolist() == ids[best].tolist() and mine.score.tolist() == s[best].astype(int).tolist()
    assert hits >= 0.9 * 300
    assert not set(near.vec_id) & {700, 800, 900, 1100} and 1000 not in set(near.query_id)
    big = spark.createDataFrame([(0, [1e30]), (20, [1e30]), (1, [-1.0])], "vec_id long, embedding array<float>")
    assert {(r.query_id, r.vec_id, r.score) for r in exact_topk.search(big, F.col("vec_id") % 20 == 0, 1).collect()} == {
        (0, 20, (1 << 63) - 1), (20, 0, (1 << 63) - 1)}
    assert graph_search.search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0 == exact_topk.search(table.limit(0), F.lit(True)).count()


def test_shards_are_minimax(spark, odd):
    docs = tuned(spark).read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.shard(docs, 24).toPandas()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.size == len(texts[r.doc_id].encode()) + 8 for r in rows.itertuples())
    shard_of = {}
    for r in rows.itertuples():
        assert shard_of.setdefault(texts[r.doc_id], r.shard) == r.shard
    by = rows.groupby("shard").agg(size=("size", "sum"), n=("slot", "size"), last=("slot", "max"), different=("slot", "nunique"))
    assert (by.n == by["last"] + 1).all() and (by.n == by.different).all() and len(by) == 24
    units = {}
    for i, t in texts.items():
        unit = int(hashlib.md5(t.encode()).hexdigest()[:8], 16) >> 18
        units[unit] = units.get(unit, 0) + len(t.encode()) + 8
    sizes = [units[u] for u in sorted(units)]

    def fits(capacity):
        n, fill = 1, 0
        for s in sizes:
            n, fill = (n, fill + s) if fill + s <= capacity else (n + 1, s)
        return n <= 24

    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    assert by["size"].max() <= low
    small = sharding.shard(odd, 3).toPandas()
    assert len(small) == len(ODD) + 1 and small["size"].min() == 8 and sharding.shard(odd.limit(0)).count() == 0


def test_tokens_match_the_library(spark, odd):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary_path()
    library = tokenizers.Tokenizer.from_file(path)
    rng = np.random.default_rng(9)
    letters = list("aabbc eé  \n\t'sS1²_-.,中😀\u0085\u001c")
    texts = ["".join(rng.choice(letters, rng.integers(0, 80))) for _ in range(300)] + ODD + ["ab" * 4000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    both = {r.doc_id: r for r in bpe.decode_ids(bpe.encode(docs, path), path).collect()}
    counted = {r.doc_id: r for r in token_counts.count_tokens(docs, path).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert both[i].ids == want and both[i].decoded == library.decode(want, skip_special_tokens=False)
        assert (counted[i].n_tokens, counted[i].n_bytes) == (len(want), len((t or "").encode()))
    few = {r.doc_id: r.ids for r in bpe.encode(docs.repartition(1), path, kept=10).collect()}
    assert few == {i: r.ids for i, r in both.items()}
    assert bpe.encode(odd, path).count() == len(ODD) + 1 == token_counts.count_tokens(odd, path).count()


def test_packages_round_trip(spark, tmp_path):
    page = "<p>" + "x" * 2000
    rows = [(1, page), (2, page), (7, page), (3, "short"), (4, "short"), (5, None), (6, ""), (None, page), (8, "é" * 600)]
    pages = tuned(spark).createDataFrame(rows, "page_id long, html string").withColumn("digest", F.lit("clash"))
    packages = warc.write_packages(pages, str(tmp_path / "a"))
    back = {r.id: r for r in warc.read_packages(packages).collect()}
    assert {i: (r.type, r.refers_to) for i, r in back.items()} == {
        1: ("revisit", 7), 2: ("revisit", 7), 7: ("response", None), 3: ("response", None), 4: ("response", None),
        5: ("response", None), 6: ("response", None), None: ("revisit", 7), 8: ("response", None)}
    for i, html in rows:
        data = (html or "").encode()
        assert (back[i].payload_bytes, back[i].digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert warc.read_packages(warc.write_packages(pages.limit(0), str(tmp_path / "b"))).count() == 0


@pytest.mark.parametrize("wide", [False, True])
def test_own_directory_reader_agrees_with_zipfile(tmp_path, wide):
    import zipfile

    members = [("archive/data.warc.gz", b"abc" * 50), ("indexes/index.cdxj", json.dumps({"offset": 0}).encode())]
    path = tmp_path / "x.wacz"
    path.write_bytes(warc.zip_package(members, wide))
    with zipfile.ZipFile(path) as known:
        assert {n: known.read(n) for n in known.namelist()} == dict(members)
    with warc._open(str(path)) as file:
        found = warc.central_directory(file)
        assert {n: file.read_at(size, at) for n, (_, at, size) in found.items()} == dict(members)


def test_pipeline_keeps_what_each_stage_keeps(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = tuned(spark).read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    deduped = pipeline.drop_near_copies(spark, docs, SF)
    parts = _components(sorted(texts.items()), 5, 80)
    assert deduped.columns == docs.columns and sorted(r.doc_id for r in deduped.collect()) == sorted(i for i, (_, c) in parts.items() if c == i)
    mixed = pipeline.mix_sources(spark, docs, SF)
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {i: n for i, n in copies.items() if n}
    last = pipeline.run(spark, SF)
    assert last.columns == ["doc_id", "n_tokens", "ids"] and last.count() > 0
