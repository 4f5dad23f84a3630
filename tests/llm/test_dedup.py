import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from umbra.llm import exact_dedup, simhash
from umbra.llm.components import components

LONG = "Word and word. " * 20_000
EDGE = [(1, None), (2, ""), (3, "A b"), (4, "a B"), (4, "a B"), (5, "É"), (6, "é"), (None, "a b"), (7, LONG), (8, LONG.upper()), (9, "x"), (9, "y"), (10, "😀".encode("utf-16", "surrogatepass").decode("utf-16"))]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def exact_expected(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(lower(text), []).append(doc_id)
    top = {t: max((x for x in g if x is not None), default=None) for t, g in groups.items()}
    return sorted((str(d), str(top[lower(t)]), len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for d, t in rows)


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(300)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.4:
            words = rng.choice(out)[1].split(" ")
            if rng.random() < 0.7:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = rng.choices(vocabulary, k=rng.randint(0, 200)) or [""]
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize("rows", [EDGE, corpus(300), []])
def test_exact_groups_equal_brute_force(docs, rows):
    got = exact_dedup.exact_groups(docs(rows).withColumn("sha", F.lit(1)).withColumn("kept", F.lit(1))).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == exact_expected(rows)
    assert sum(r.kept for r in got) == len({lower(t) for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_stage_keeps_one_row_of_each_text(docs):
    rows = EDGE + corpus(60)
    kept = exact_dedup.stage(docs(rows).sparkSession, docs(rows), "").collect()
    assert sorted(lower(r.text) for r in kept) == sorted({lower(t) for _, t in rows})


def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 1000):
        for top in (2, 10**4, 2**48):
            values = np.unique(rng.integers(0, top, n, dtype=np.uint64))
            assert (exact_dedup.golomb_decode(exact_dedup.golomb_encode(values)) == values).all()


def brute_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower(text)) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def near_expected(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for (d, _), g in zip(rows, group):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    return sorted((str(d), f"{f:016x}", str(least.get(g))) for (d, _), f, g in zip(rows, fps, group))


@pytest.mark.parametrize("block", [1024, 1])
@pytest.mark.parametrize("rows", [EDGE, corpus(300), []])
def test_near_groups_equal_brute_force(docs, rows, block):
    got = simhash.near_groups(docs(rows).withColumn("fp", F.lit(1)).withColumn("component_id", F.lit(1)), block=block).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == near_expected(rows)


def test_near_stage_keeps_one_row_of_each_component(docs):
    rows = corpus(200)
    kept = simhash.stage(docs(rows).sparkSession, docs(rows), "").collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted({c for *_, c in near_expected(rows)})


def test_near_stage_tells_components_apart_without_their_ids(docs):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(40)) for _ in range(8)]
    fps = [brute_fingerprint(t) for t in texts]
    assert all((fps[i] ^ fps[j]).bit_count() > 2 for i in range(8) for j in range(i))
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1].upper()), (9, texts[2]), (9, texts[3]), (None, texts[4]), (4, texts[4].upper()), (9, texts[5]), (9, texts[5]), (None, texts[6]), (None, texts[6]), (12, texts[7])]
    kept = simhash.stage(docs(rows).sparkSession, docs(rows), "").collect()
    assert sorted(r.text.lower() for r in kept) == sorted(texts)
    ids = {r.text.lower(): r.doc_id for r in kept}
    assert [ids[t] for t in texts] == [None, None, 9, 9, 4, 9, None, 12]


@pytest.mark.parametrize("seed", range(3))
def test_bit_sliced_blocks_equal_pairwise_distances(seed):
    rng = random.Random(seed)
    fps, bucket = [], []
    for b, n in enumerate([1, 2, 3, 64, 65, 200, 1, 30, 40, 500]):
        base = rng.getrandbits(64)
        own = {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) * (rng.random() < 0.5) for _ in range(n)}
        own |= {rng.getrandbits(64) for _ in range(n // 2)}
        fps += sorted(own)
        bucket += [b] * len(own)
    got = simhash.block_links(np.array(bucket), np.array(fps, np.uint64))
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bucket[i] == bucket[j] and (fps[i] ^ fps[j]).bit_count() <= 2:
                label[max(root(i), root(j))] = min(root(i), root(j))
    want = sorted((fps[i], fps[root(i)]) for i in range(len(fps)) if root(i) != i)
    assert sorted((a % (1 << 64), b % (1 << 64)) for a, b in got) == want


@pytest.mark.parametrize("step", [1, 7, 64])
def test_blocks_keep_links_of_earlier_slices(monkeypatch, step):
    rng = random.Random(step)
    for _ in range(20):
        chain = [rng.getrandbits(64)]
        for bit in rng.sample(range(64), 60):
            chain.append(chain[-1] ^ (1 << bit))
        rng.shuffle(chain)
        chain = chain + [rng.getrandbits(64) for _ in range(90)]
        rng.shuffle(chain)
        bucket, fps = np.zeros(len(chain), int), np.array(chain, np.uint64)
        want = sorted(simhash.block_links(bucket, fps))
        assert len(want) == 60
        with monkeypatch.context() as m:
            m.setattr(simhash, "_STEP", step)
            assert sorted(simhash.block_links(bucket, fps)) == want


def test_components_of_chains_stars_and_random_edges(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(-5, 7), (9, 9)]
    rng.shuffle(edges)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "u long, v long").repartition(4)).collect()
    assert sorted(map(tuple, got)) == sorted((x, root(x)) for x in parent if root(x) != x)


def test_a_block_of_thousands_with_linked_and_unlinked_members(spark):
    """More than BLOCK fingerprints share two parts, so they go the other way."""
    rng = random.Random(8)
    high = 0x1234_5678 << 32
    fps = {high | rng.getrandbits(32) for _ in range(3000)}
    for base in list(fps)[:300]:
        fps.add(base ^ (1 << rng.randrange(32)))
        fps.add(base ^ (1 << rng.randrange(32)) ^ (1 << rng.randrange(32)))
    fps = sorted(fps)
    assert len(fps) > 3 * simhash.BLOCK
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3))).collect()
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = set(signed)
    for x in signed:
        for i in range(64):
            for j in range(i, 64):
                y = x ^ (1 << i) ^ ((1 << j) if j > i else 0)
                if y in known and y < x:
                    a, b = find(x), find(y)
                    root[max(a, b)] = min(a, b)
    assert sorted((r.u, r.root) for r in got) == sorted((x, find(x)) for x in signed if find(x) != x)
    assert 300 < len(got) < 2000
