import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from umbra.llm import lang_id, mixing, packing, sketch

LONG = "Langer Text und so. " * 15_000
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "!!! 123"), (5, "x"), (5, "x"), (None, "the cat"), (7, LONG), (8, " é ü"), (9, "<|endoftext|> a")]


def prose(n, seed=2):
    rng = random.Random(seed)
    syllables = {"en": "th er in on and the ing ea ou".split(), "de": "sch ein ung ver ch en ü ö keit".split(), "fr": "eau ou é è que ment oi les".split()}
    rows = []
    for i in range(n):
        lang = rng.choice(list(syllables))
        text = " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(1, 120)))
        rows.append((i, text + ".", lang if rng.random() < 0.9 else None, rng.choice(["a", "b", "c", None, "Z", "é"])))
    return rows


def test_language_accuracy_on_held_out_rows(docs):
    rows = prose(600)
    got = {r.doc_id: r for r in lang_id.identify(docs(rows)).collect()}
    held = [(got[i].lang_pred, lang) for i, _, lang, _ in rows if lang and got[i].held_out]
    assert len(held) > 80 and sum(a == b for a, b in held) / len(held) > 0.97
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_ignores_labels_of_the_scored_row(docs):
    rows = prose(200)
    train = docs(rows)
    a = lang_id.identify(docs(rows), train).collect()
    b = lang_id.identify(docs([(i, t, "xx", "other") for i, t, *_ in rows]), train).collect()
    assert [r.lang_pred for r in a] == [r.lang_pred for r in b]


def test_language_bounded_sample(docs):
    langs, _ = lang_id.fit(docs(prose(400)), sample=100)
    assert langs == ["de", "en", "fr"]


@pytest.mark.parametrize("rows", [EDGE, []])
def test_language_edges(docs, rows):
    got = lang_id.identify(docs(rows).withColumn("lang_pred", F.lit("x")), docs(prose(100))).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in (1, 2, 3, 4):
            assert (r.lang_pred, r.score) == ("und", 0)
    assert all(r.lang_pred == "und" for r in lang_id.identify(docs(rows)).collect() if not rows or r.doc_id == 1)
    assert lang_id.stage(docs(rows).sparkSession, docs(rows), "").columns == docs(rows).columns


def word_count(t):
    return len((t or "").encode().split())


def brute_targets(rows):
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + word_count(r[1])
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s] + 1e-9}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    return sizes, target


@pytest.mark.parametrize("rows", [prose(400), prose(3), [(i, t, "en", None) for i, t in EDGE], [(1, "a", "en", "x"), (2, "a b c d e f g h i j", "en", "y"), (3, "a " * 900, "en", "z")], [(1, None, "en", "q")], []])
def test_mixing_meets_its_targets(docs, rows):
    df = docs(rows).withColumn("size", F.lit(3)).withColumn("target", F.lit(3)).repartition(3)
    got = mixing.mix(df, blocks=32).collect()
    sizes, target = brute_targets(rows)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source], abs=1e-6)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in taken)
    again = mixing.mix(df.repartition(5), blocks=32).select("doc_id", "th", "taken").collect()
    assert sorted(str(tuple(x)) for x in again) == sorted(str((x.doc_id, x.th, x.taken)) for x in got)


def test_mixing_takes_what_the_tree_gives_to_shards(docs):
    rows = prose(400)
    sized = mixing.sized(docs(rows))
    _, _, plan = mixing.plan_draws(sized, 32, 2)
    plan = plan.collect()
    draws = {}
    for r in plan:
        assert len(r.shards) == r.full + (r.quota > 0) <= 3 and all(0 <= s < 4 for s in r.shards)
        for s in r.shards:
            draws[r.source, s] = draws.get((r.source, s), 0) + 1
    # quotas of the tree: exact halves of halves of all draws, and each source's own
    again = mixing.plan_draws(sized, 32, 2)[2]
    quotas = {r.source: list(r.ends) for r in mixing.split(again.select("source", "full", "quota"), 2).collect()}
    for source, ends in quotas.items():
        assert [draws.get((source, s), 0) for s in range(4)] == [b - a for a, b in zip([0, *ends], ends)]
    by_shard = [sum(n for (_, s), n in draws.items() if s == shard) for shard in range(4)]
    total = sum(by_shard)
    left = -(-total // 2)
    assert by_shard == [-(-left // 2), left // 2, -(-(total - left) // 2), (total - left) // 2]
    # words taken from a shard are those of the blocks it draws
    want = {}
    for r in plan:
        for i, s in enumerate(r.shards):
            want[r.source, s] = want.get((r.source, s), 0) + (r.held if i < r.full else r.quota)
    got = {}
    for r in mixing.mix(docs(rows), blocks=32, levels=2).collect():
        assert r.taken == sum(d.n for d in r.draws)
        for d in r.draws:
            got[r.source, d.shard] = got.get((r.source, d.shard), 0) + d.n
    assert got == want


def test_mixing_splits_sources_at_random(docs, spark):
    plan = spark.createDataFrame([(s, i, 1, 1, 0, 1) for s, n in (("a", 400), ("b", 100), (None, 300)) for i in range(n)], "source string, block long, full long, quota long, place long, held long")
    ends = {r.source: list(r.ends) for r in mixing.split(plan, 3).collect()}
    assert {s: e[-1] for s, e in ends.items()} == {"a": 800, "b": 200, None: 600}
    counts = {s: np.diff([0, *e]) for s, e in ends.items()}
    assert (sum(counts.values()) == 200).all()
    for s, c in counts.items():
        mean = ends[s][-1] / 8
        assert (abs(c - mean) < 5 * mean**0.5).all() and len(set(c.tolist())) > 1


@pytest.mark.parametrize("n", [0, 1, 50])
def test_running_sums(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice("abc"), i, rng.randint(0, 9)) for i in range(n)]
    df = spark.createDataFrame(rows, "s string, i long, x long").repartition(3)
    got = mixing.running(df, [F.col("s"), F.col("i")], {"before": F.col("x"), "nth": F.lit(1)}).collect()
    order = sorted(rows)
    assert sorted(tuple(r) for r in got) == [(*r, sum(x for *_, x in order[:k]), k) for k, r in enumerate(order)]


def test_mixing_stage_writes_what_was_taken(docs):
    rows = prose(300) + [(900, "a b c", "en", "a"), (900, "a b c", "en", "a"), (None, "d e", "en", "b")]
    out = mixing.stage(docs(rows).sparkSession, docs(rows), "")
    assert out.columns == docs(rows).columns
    _, target = brute_targets(rows)
    got = {}
    texts = {t for _, t, *_ in rows}
    parts = 0
    for r in out.collect():
        got[r.source] = got.get(r.source, 0) + word_count(r.text)
        parts += r.text not in texts
        assert r.n_chars == len(r.text)
    assert all(abs(got.get(s, 0) - t) <= 1 for s, t in target.items()) and parts <= len(target)


def test_mixing_stage_deals_rows_to_shards_and_shuffles_them(docs):
    rows = prose(300) + [(900 + i, f"few {i} words", "en", "a") for i in range(40)] + [(None, "d e", "en", "b"), (None, "d e", "en", "b")]
    df = docs(rows)
    out = mixing.stage(df.sparkSession, df, "").withColumn("file", F.spark_partition_id()).collect()
    assert len({(r.doc_id, r.text) for r in out}) < len(out)
    apart = [(a.doc_id, a.text) != (b.doc_id, b.text) for a, b in zip(out, out[1:]) if a.file == b.file]
    assert sum(apart) > 0.97 * len(apart)  # in order of joining all passes of a document are neighbours
    dealt = mixing.deal(df).withColumn("file", F.spark_partition_id()).collect()
    assert [(r.doc_id, r.text) for r in dealt] == [(r.doc_id, r.text) for r in out]
    shards = {}
    for r in dealt:
        shards.setdefault(r.file, set()).add(r.shard)
    assert all(len(x) == 1 for x in shards.values()) and set.union(*shards.values()) == set(range(8))
    want, got = {}, {}
    for r in mixing.mix(df).where("taken > 0").collect():
        for d in r.draws:
            want[r.source, d.shard] = want.get((r.source, d.shard), 0) + 1
    for r in dealt:
        got[r.source, r.shard] = got.get((r.source, r.shard), 0) + 1
    assert got == want
    again = mixing.stage(df.sparkSession, df.repartition(5), "").collect()
    assert [(r.doc_id, r.text) for r in again] == [(r.doc_id, r.text) for r in out]


def brute_cut_cost(length, allowed, window, hard):
    best = {0: 0}
    for j in range(1, length + 1):
        c = 0 if j == length else allowed.get(j, hard)
        best[j] = min(best[i] + c + window - (j - i) for i in range(max(0, j - window), j) if i in best)
    return best[length]


@pytest.mark.parametrize("seed", range(20))
def test_packing_cuts_are_the_cheapest(seed):
    rng = random.Random(seed)
    window, length = rng.choice([4, 8, 16]), rng.randint(1, 80)
    places = sorted(rng.sample(range(1, length), min(length - 1, rng.randint(length // 4, length))))
    while any(b - a > window for a, b in zip([0, *places], [*places, length])):  # no hard cuts, so that both have the same choice
        places = sorted({*places, rng.randrange(1, length)})
    cost = [rng.choice([0, 2, 3]) for _ in places]
    ends = packing.cuts(length, np.array(places, int), np.array(cost, int), window)
    assert ends[-1] == length and all(0 < b - a <= window for a, b in zip([0, *ends], ends))
    table = dict(zip(places, cost))
    spent = sum(window - (b - a) + (0 if b == length else table[b]) for a, b in zip([0, *ends], ends))
    assert spent == brute_cut_cost(length, table, window, 10**6)


@pytest.mark.parametrize("rows", [EDGE, [(i, t) for i, t, *_ in prose(300)], []])
def test_packing_holds_every_id_once(docs, rows):
    from tokenizers import Tokenizer

    got = packing.pack(docs(rows).withColumn("start", F.lit(0)).repartition(2)).collect()
    t = Tokenizer.from_file(packing.tokenizer_path())
    want = {}
    for d, x in rows:
        want.setdefault(d, []).append(t.encode(x or "", add_special_tokens=False).ids + [0])
    sequences = {}
    held = {}
    for r in got:
        ids = next(i for i in want[r.doc_id] if len(i) == r.doc_tokens)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        held[r.doc_id] = held.get(r.doc_id, 0) + r.length
    assert held == {d: sum(map(len, x)) for d, x in want.items()}
    padding = 0
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert 0 < end <= 1024
        padding += 0 if end & (end - 1) == 0 else 1024 - end
    assert padding <= 0.03 * max(1, sum(held.values()))


def test_packing_works_in_stretches(monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 3000)
    rng = np.random.default_rng(0)
    packer, rows, lengths = packing.Packer(), [], [int(x) for x in rng.integers(1, 5000, 60)]
    for i, n in enumerate(lengths):
        rows += packer.add(i, rng.integers(0, 50000, n).astype(np.uint32))
    rows += packer.finish()
    at = {}
    for doc, start, length, _, tokens, sequence, offset in rows:
        assert start == at.get(doc, 0) and tokens == lengths[doc]
        at[doc] = start + length
    assert at == dict(enumerate(lengths))


def test_encode_equals_tokenizers():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    texts = ["", " ", "a  b\n\n c", "don't <|endoftext|> x", "é" * 500, "\x00­​😀", "1234567 ½", LONG]
    assert packing.encode(texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]


def sketch_expected(rows):
    order = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0]))
    out = []
    for a, b in zip(order, order[1:] + order[:1]):
        t, n = a[1] or "", b[1] or ""
        k = len(t) // 4
        out.append((str(a[0]), len(t), hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()))
    return sorted(out)


def brute_edit(text, following):
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def brute_fingerprint(text):
    """Cells filled one digest at a time."""
    cells = [[0, 0] for _ in range(24)]
    items = [int(x) for x in sketch.pieces(text)]
    for x in items:
        for third in range(3):
            place = third * 8 + ((x >> 16 * third & 0xFFFF) * 8 >> 16)
            cells[place][0] += 1
            cells[place][1] ^= x
    raw = b"".join(((c + 128) % 256 - 128).to_bytes(1, "little", signed=True) + x.to_bytes(8, "little") for c, x in cells)
    return __import__("base64").b64encode(len(items).to_bytes(4, "little") + raw).decode()


def test_pieces_are_local_to_lines_and_words():
    lines = [" ".join(str(random.Random(i * 40 + j).random()) for j in range(30)) for i in range(20)]
    whole = sketch.pieces("\n".join(lines))
    assert len(whole) > 40
    first = set(sketch.pieces("\n".join(["changed words", *lines[1:]])).tolist())
    assert len(set(whole.tolist()) & first) > 0.9 * len(whole)
    unspaced = "".join(chr(0x4E00 + random.Random(7).randrange(3000) + i % 7 * 40 + i % 311) for i in range(4000))
    a, b = sketch.pieces(unspaced), sketch.pieces(unspaced[:2000] + "新" + unspaced[2000:])
    assert len(a) > 20 and sketch.likeness(a, b) > 0.8
    assert len(sketch.pieces("x" * 1_000_000)) == 1


def test_sketch_of_hot_ids_spreads_over_ranges(docs):
    rows = [(5, f"text {i}") for i in range(200)] + [(None, f"none {i}") for i in range(100)] + [(i, "same") for i in range(100, 150)] + [(7, "same again")] * 90
    got = sketch.version_sketches(docs(rows).repartition(3), ranges=16).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(d), len(t)) for d, t in rows)
    assert sum(r.near_next == 1 for r in got if r.doc_id == 7) == 89


@pytest.mark.parametrize("ranges", [1, 7, 40])
@pytest.mark.parametrize("rows", [[r for r in EDGE if r[0] != 5], [(i, t) for i, t, *_ in prose(60)], [(3, "just one")], []])
def test_sketch_versions(docs, rows, ranges):
    df = docs(rows).withColumn("rng", F.lit(1)).repartition(3)
    got = sketch.version_sketches(df, ranges=ranges).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sketch_expected(rows)
    text = {d: t or "" for d, t in rows}
    order = sorted(text, key=lambda d: -(1 << 63) if d is None else d)
    for r in got:
        a = sketch.pieces(text[r.doc_id])
        b = sketch.pieces(text[order[(order.index(r.doc_id) + 1) % len(order)]])
        a, b = set(a.tolist()), set(b.tolist())
        assert r.near_next == pytest.approx(len(a & b) / len(a | b) if a | b else 1)
        assert r.fingerprint == brute_fingerprint(text[r.doc_id])
        changed = brute_edit(text[r.doc_id], text[order[(order.index(r.doc_id) + 1) % len(order)]])
        assert r.edited_fingerprint == brute_fingerprint(changed)
        c, d = set(sketch.pieces(text[r.doc_id]).tolist()), set(sketch.pieces(changed).tolist())
        assert r.near_edited == pytest.approx(len(c & d) / len(c | d) if c | d else 1)


def test_sketch_of_repeated_rows(docs):
    got = sketch.version_sketches(docs([(5, "x y"), (5, "x y"), (6, "z")]), ranges=3).collect()
    assert len(got) == 3 and len({r.fingerprint for r in got if r.doc_id == 5}) == 1


@pytest.mark.parametrize("seed", range(10))
def test_peeling_recovers_the_difference(seed):
    rng = random.Random(seed)
    items = sketch.pieces("\n".join(str(rng.random()) for _ in range(400)))
    a, b = items[: rng.randint(0, 400)], items[rng.randint(0, 400) :]
    mine, theirs = sketch.difference(a, b)
    a, b = ({x & int(sketch.MASK) for x in y.tolist()} for y in (a, b))
    assert set(mine.tolist()) == a - b and set(theirs.tolist()) == b - a and len(mine) + len(theirs) == len(a ^ b)


def test_peeling_ends_on_any_cells():
    rng = np.random.default_rng(3)
    for _ in range(200):
        s = sketch.Sketch(24)
        s.count = rng.integers(-2, 3, 24)
        keys = rng.integers(0, 1 << 48, 24, dtype=np.uint64)
        s.xor = keys | sketch.check(keys) << np.uint64(48)
        s.peel()


def test_language_ties_and_repeated_rows(docs):
    same = [(i, "ab ab ab", lang) for i in range(40) for lang in ("x", "y")]
    got = lang_id.identify(docs(same)).collect()
    assert len(got) == 80 and {r.lang_pred for r in got} == {"x"} and {round(r.score, 6) for r in got} == {0.5}
    five = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 4 != 2)
    odd = [(five, "the cat", "en")] * 60 + [(five, "le chat", "fr")] * 60 + [(None, "the cat", "fr")] * 9
    got = lang_id.identify(docs(odd)).collect()
    assert {(r.lang_pred, r.held_out) for r in got if r.doc_id is None} == {("en", False)} and len(got) == 129
    assert len({(r.doc_id, r.lang_pred, r.score) for r in got if r.doc_id == five}) == 2


def test_language_sample_holds_rare_languages(docs):
    rows = [(i, f"the word number {i}", "en") for i in range(3000)] + [(5000 + i, f"das wort ist {i}", "de") for i in range(12)]
    langs, matrix = lang_id.fit(docs(rows), sample=200)
    assert langs == ["de", "en"] and matrix.shape == (lang_id.DIM + 2, 2)
    assert lang_id.predict(["das wort", "the word"], langs, matrix)[0] == ["de", "en"]


def test_language_matrix_is_bounded(docs, monkeypatch):
    assert [lang_id.height(n) for n in (0, 1, 128, 129, 1000)] == [1 << 16, 1 << 16, 1 << 16, 1 << 15, 1 << 13]
    monkeypatch.setattr(lang_id, "CELLS", 1 << 12)
    langs, matrix = lang_id.fit(docs(prose(400)))
    assert matrix.shape == (1026, 3)
    assert lang_id.predict(["the and ing", "sch keit"], langs, matrix)[0] == ["en", "de"]
