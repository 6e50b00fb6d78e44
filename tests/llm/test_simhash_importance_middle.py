"""SimHash linking, importance resampling and fill-in-middle against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("runledger.llm")
import xxhash  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from runledger.llm import fill_middle, importance, queries, simhash  # noqa: E402
from runledger.llm.common import tuned  # noqa: E402

SF = "/root/testdata/sf0.001"
ODD = ["", None, "one two three four", "one two three four", " \t\n", "naïve 中文 ÀB C\x00d\x7fe " * 3, "A-b_c 9x", "word " * 30, "x" * 5000, "<P>marked <S>text",
       "one two", "The quick brown fox jumps over the lazy dog " * 4, " lead and  trail \n", "emoji 😀 text\x85\xa0end"]
DDL = "doc_id long, text string, source string, fp string, label long, score string, id string, bucket int"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 3 == 0 else "s", "clash", i, None, "x", 1) for i, t in enumerate(ODD)]
    return tuned(spark).createDataFrame(rows + [rows[7], (None, "no id here at all", None, None, None, None, None, None)], DDL)


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


# --- SimHash ---------------------------------------------------------------------------

def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    runs = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """The least fingerprint reachable from each, by comparing all with all."""
    fps = sorted(set(fps))
    label = {f: f for f in fps}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {f: find(f) for f in fps}


def check_links(spark, fps):
    signed = [f - (1 << 64) if f >> 63 else f for f in set(fps)]
    got = simhash.link_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in got]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    label = {f: f for f in set(fps)}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for a, b in links:
        x, y = sorted((find(a), find(b)))
        label[y] = x
    assert {f: find(f) for f in label} == plain_components(fps)
    return links


def test_fingerprints_match_plain_ones(spark, odd):
    got = simhash.fingerprints(odd).collect()
    want = sorted((str(r["doc_id"]), plain_fingerprint(r["text"])) for r in odd.collect())
    assert sorted((str(r["id"]), r["fp"] % (1 << 64)) for r in got) == want
    long = " ".join(f"w{i % 997}" for i in range(simhash.BLOCK + 500))  # more hashes than are counted at once
    assert simhash.fingerprint(simhash.shingle_hashes(long.encode())) % (1 << 64) == plain_fingerprint(long)


def test_links_match_all_pairs(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(200)]
    for base in fps[:40]:  # pairs at 1, 2 and 3 bits, also across all three families
        for d in (1, 2, 3):
            fps.append(base ^ sum(1 << b for b in rng.sample(range(64), d)))
    chain = rng.getrandbits(64)
    for k in range(30):  # linked only step by step
        chain ^= 3 << (2 * k)
        fps.append(chain)
    check_links(spark, fps + [0, 1, (1 << 64) - 1, (1 << 64) - 4])


def test_crowded_lists_lose_no_link(spark):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    crowd = [base ^ sum(1 << b for b in rng.sample(range(40), rng.randint(0, 4))) for _ in range(500)]  # 24 bits are always shared
    assert len(set(crowd)) > 4 * simhash.LIST
    check_links(spark, crowd + [rng.getrandbits(64) for _ in range(50)])


def test_pivot_distances_bound_the_distance(spark):
    rng = random.Random(5)
    pairs = [(a := rng.getrandbits(63), a ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 9)))) for _ in range(300)]
    pairs += [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(700)]
    rows = spark.createDataFrame(pairs, "a long, b long").select("a", "b", simhash.discarded(simhash.distances(F.col("a")), simhash.distances(F.col("b"))).alias("out")).collect()
    assert not any(r["out"] for r in rows if (r["a"] ^ r["b"]).bit_count() <= 2)
    assert sum(r["out"] for r in rows[300:]) >= 695  # unrelated pairs go before they are compared


def test_simhash_link_of_odd_documents(spark, odd):
    fps = [(r["doc_id"], plain_fingerprint(r["text"])) for r in odd.collect()]
    label, least = plain_components(f for _, f in fps), {}
    for i, f in fps:
        least[label[f]] = min((x for x in (least.get(label[f]), i) if x is not None), default=None)
    want = sorted(str((i, f"{f:016x}", least[label[f]])) for i, f in fps)
    assert sorted(str(tuple(r)) for r in simhash.link(odd).collect()) == want
    assert simhash.link(odd.limit(0)).count() == 0


# --- importance resampling ----------------------------------------------------------------

def plain_resample(docs, target):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        return len(words), [zlib.crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]
    found = [(i, *features(t)) for i, t in docs]
    s = collections.Counter(b for _, _, f in found for b in f)
    t = collections.Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(10000)]
    rows = []
    for i, n, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    order = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    drawn = order[:25 * len(order) // 100]
    return sorted(str((*r[:4], drawn.index(r) + 1 if r in drawn else None)) for r in rows)


def test_resample_matches_plain_version(spark, odd):
    docs, bench = (queries.table(spark, SF, n) for n in ("documents", "benchmark"))
    target = [r["text"] for r in bench.collect()]
    got = sorted(str(tuple(r)) for r in importance.resample(docs, bench).collect())
    assert got == plain_resample([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], target)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] != 7 or r["text"] is None]
    once = odd.where("doc_id is null or doc_id <> 7")
    assert sorted(str(tuple(r)) for r in importance.resample(once, bench).collect()) == plain_resample(rows, target)


def test_resample_of_repeated_rows_and_empty_tables(spark, odd):
    bench = queries.table(spark, SF, "benchmark")
    many = tuned(spark).createDataFrame([(5, "same words again and " * 8)] * 40, "doc_id long, text string")
    ranks = sorted(r["rank"] for r in importance.resample(many, bench).collect() if r["rank"])
    assert ranks == list(range(1, 11))
    assert importance.resample(odd.limit(0), bench).count() == 0
    assert importance.resample(odd, bench.limit(0)).count() == odd.count()


def test_bit_sliced_sums_are_exact():
    rng = np.random.default_rng(1)
    gain = rng.integers(-9000, 9000, 10000).tolist()
    counts = rng.integers(0, 3, (5, 10000)) * rng.integers(0, 70_000, (5, 10000))
    counts[3] = 0
    assert (importance.sums(counts, *importance.sliced_gains(gain)) == counts @ np.array(gain)).all()
    for few in ([0] * 10000, [-1] * 10000, [7] * 10000):
        assert (importance.sums(counts, *importance.sliced_gains(few)) == counts @ np.array(few)).all()


# --- fill in the middle -----------------------------------------------------------------

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_middle(i, text):
    text = text or ""
    units, d = UNIT.findall(text), hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return i, len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return i, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("offsets,kinds", [
    (list(range(0, 9000, 2)), {"bitmap"}), (list(range(0, 900, 3)), {"array"}), (list(range(5, 7000)), {"runs"}),
    (list(range(100)) + list(range(200, 140_000, 3)) + list(range(200_000, 270_000)), {"bitmap", "runs"}), ([0], {"array"})])
def test_boundary_sets_select_every_member(offsets, kinds):
    made = fill_middle.Boundaries(np.array(offsets, np.int64))
    assert {c[0] for c in made.containers} >= kinds and len(made) == len(offsets)
    assert [made.select(k) for k in range(len(offsets))] == offsets


def test_transform_and_restore_match_plain_version(spark, odd):
    rng = random.Random(2)
    long = "".join(rng.choice(["a ", "bb\n", "ç", " 😀", "<", "S>", "<P "]) for _ in range(120_000))  # several containers
    more = [(100 + i, long[:n] + "z") for i, n in enumerate((70_000, 140_000, 65_535, 65_536))] + [(200 + i, f"a{i} <S <P b> c ") for i in range(60)]
    docs = odd.select("doc_id", "text").unionByName(tuned(spark).createDataFrame(more, "doc_id long, text string"))
    made = fill_middle.transform(docs).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(str(tuple(r)[:6]) for r in made) == sorted(str(plain_middle(*r)) for r in rows)
    assert sorted(r["back"] for r in made) == sorted(t or "" for _, t in rows)
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}
    assert fill_middle.transform(odd.limit(0)).count() == 0
