import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_dedup import brute_fingerprint, lower
from tests.llm.test_text import brute_targets, prose, word_count
from umbra.llm import lang_id, packing
from umbra.llm.common import made

CLASHES = {"__id": 1, "__th": "t", "___n": 2, "shard": "s", "__Size": 3, "umbra": "u", "copies": 4, "fp": 5, "root": 6}


def clashing(df):
    return df.withColumns({k: F.lit(v) for k, v in CLASHES.items()})


def corpus():
    rng = random.Random(11)
    rows = prose(150, seed=9)
    n = len(rows)
    rows += [(n + i, rows[i][1].upper() if i % 2 else rows[i][1], rows[i][2], rows[(i + 7) % n][3]) for i in range(30)]  # exact copies
    for i in range(30):  # near copies
        words = (rows[i][1] + " " + rows[i + 1][1]).split(" ") * 3
        rows.append((n + 40 + 2 * i, " ".join(words), "en", "a"))
        words[rng.randrange(len(words))] += "x"
        rows.append((n + 41 + 2 * i, " ".join(words), "en", "b"))
    rows += [(900, None, "en", "a"), (901, "", "de", None), (902, " \n\t", None, "b"), (903, "123 !!", "en", "a"), (904, "the and " * 40_000, "en", "c")]
    rows += [rows[3]] * 5 + [(None, "the ing on and the", "en", "a"), (None, "the ing on and the", "en", "a"), (None, "eau que ment les oi", "fr", None), (2, "eau que ment les oi ou", "fr", "c")]
    return rows


def near_kept(rows):
    """Of each group linked within 2 bits the smallest doc_id, null last."""
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sorted(str(min((r[0] is None, r[0] or 0, r[0]) for r, g in zip(rows, group) if g == x)[2]) for x in set(group))


@pytest.mark.parametrize("clash", [False, True])
def test_stages_one_by_one_equal_brute_force(docs, clash):
    df = docs(corpus()).repartition(3)
    df = clashing(df) if clash else df
    spark, columns = df.sparkSession, df.columns
    now = [tuple(r)[:5] for r in df.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, "")
        if name != "packing":
            assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
            got = [tuple(r)[:5] for r in out.collect()]
        if name == "language":
            langs, matrix = lang_id.fit(df)
            pred, score = lang_id.predict([t for _, t, *_ in now], langs, matrix)
            assert sorted(map(str, got)) == sorted(str(r) for r, p, s in zip(now, pred, score) if p != "und" and s >= 0.5)
            assert not {900, 901, 902, 903} & {r[0] for r in got} and 904 in {r[0] for r in got}
        elif name == "exact_dedup":
            best = {}
            for r in now:
                if lower(r[1]) not in best or (-1 if r[0] is None else r[0]) > (-1 if best[lower(r[1])][0] is None else best[lower(r[1])][0]):
                    best[lower(r[1])] = r
            assert sorted((str(r[0]), lower(r[1])) for r in got) == sorted((str(r[0]), t) for t, r in best.items())
        elif name == "near_dedup":
            assert sorted(str(r[0]) for r in got) == near_kept(now) and len(got) < len(now)
            assert {r[:2] for r in got} <= {r[:2] for r in now}
        elif name == "mixing":
            _, target = brute_targets(now)
            taken = {}
            for r in got:
                taken[r[3]] = taken.get(r[3], 0) + word_count(r[1])
                assert r[4] == len(r[1])
            assert all(abs(taken.get(s, 0) - t) <= 1 for s, t in target.items())
        else:
            check_pieces(now, out.collect())
            return
        df = spark.createDataFrame(out.collect(), out.schema).repartition(3)
        now = got


def check_pieces(rows, pieces):
    """Every id of every row lies in one piece; pieces tile their sequences."""
    ids = [np.array(x + [0], "<u4") for x in packing.encode([t for _, t, *_ in rows])]
    assert sum(r.length for r in pieces) == sum(map(len, ids))
    wholes = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        wholes.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in wholes.values():
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:])) and sum(n for _, n in held) <= 1024
    by_doc = {}
    for (doc_id, *_), own in zip(rows, ids):
        by_doc.setdefault((doc_id, len(own)), []).append(own)
    for r in pieces:
        assert any(zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for own in by_doc[r.doc_id, r.doc_tokens])


def test_run_reads_documents_and_leaves_one_table(docs, tmp_path):
    df = docs(corpus())
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    mark = made()
    got = corpus_pipeline.run(df.sparkSession, f"file://{tmp_path}").collect()
    assert got and len(made(mark)) == 1
    again = corpus_pipeline.run(df.sparkSession, f"file://{tmp_path}").collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)


def test_stages_of_an_empty_table(docs):
    df = clashing(docs([]))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(df.sparkSession, df, "")
        assert out.count() == 0 and (name == "packing" or out.columns == df.columns)


def test_stages_take_nulls_in_every_column(docs):
    df = docs([(None, None, None, None)] * 3 + [(1, None, None, None), (2, "the and", None, None)])
    for name, stage in corpus_pipeline.STAGES[1:]:
        rows = stage(df.sparkSession, df, "").collect()
        if name == "exact_dedup":
            assert sorted(str(r.doc_id) for r in rows) == ["1", "2"]
        elif name == "near_dedup":
            assert len(rows) == 2
        elif name == "mixing":
            assert [r.doc_id for r in rows] == [2]
        else:
            assert len({(str(r.doc_id), r.doc_tokens) for r in rows}) == 3
