"""The pipeline's stages on a small folder of tables, against plain versions where there is one."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from parley.llm import quality_rules

from . import brute


def tables(spark, path):
    rnd = random.Random(6)
    words = [a + b for a in ("tha", "ere", "ion", "ent", "ou") for b in ("nd", "st", "ly", "re", "wh")]
    make = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    docs = [(i, make(rnd.randrange(60, 200)), "en", f"s{i % 3}", 0) for i in range(300)]
    item = make(40)
    docs += [(1000, docs[0][1], "en", "s0", 0), (1001, docs[0][1], "en", "s1", 0), (1002, item + " " + make(60), "en", "s0", 0)]
    docs += [(1003, "short", "en", "s0", 0), (1004, make(80) + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end', "en", "s2", 0), (1005, None, None, None, None), (None, make(90), None, None, 0)]
    docs.append(docs[1])
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs


def test_stages(spark, tmp_path):
    docs = tables(spark, str(tmp_path))
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, str(tmp_path)).cache()
        seen[name] = df.collect()
        if name != "source mixing":
            assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    failed = lambda t: (q := brute.quality(t))[0] < 50 or 100 * q[4] > 50 * q[0]
    assert sorted(str(r.doc_id) for r in seen["quality rules"]) == sorted(str(d[0]) for d in docs if not failed(d[1]))
    ids = [r.doc_id for r in seen["near duplicates"]]
    assert {1000, 1001} & set(ids) == set() and ids.count(1) == 1 and {0, 1002, 1004, None} <= set(ids)
    assert 1002 not in [r.doc_id for r in seen["benchmark decontamination"]]
    assert len(seen["benchmark decontamination"]) == len(ids) - 1
    masked = {r.doc_id: r.text for r in seen["secret scan"]}
    assert "[secret]" in masked[1004] and sum("[secret]" in t for t in masked.values()) == 1
    assert len(seen["source mixing"]) == len(masked)
    total, taken = sum(r.size for r in seen["source mixing"]), sum(r.taken for r in seen["source mixing"])
    assert abs(total - taken) < 200


def test_outliers(spark):
    rnd = random.Random(8)
    docs = [(i, " ".join("word" + str(rnd.randrange(500)) for _ in range(rnd.randrange(80, 160))), "en", f"s{i % 2}") for i in range(600)]
    odd = [(1000 + i, " ".join("x" * 90 + str(j) + "###$$$%%%&&&***" * 4 for j in range(70)) + "\nq w\nq w" * 40, "en", "s0") for i in range(5)]
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(docs + odd, "doc_id bigint, text string, lang string, source string")).collect()}
    assert all(got[i] for i, *_ in docs) and not any(got[i] for i, *_ in odd)


def test_parted_words_are_outliers(spark):
    """Words parted by bars lie between the cutoff and 200."""
    rnd = random.Random(8)
    make = lambda: ["word" + str(rnd.randrange(500)) for _ in range(rnd.randrange(80, 160))]
    docs = [(i, " ".join(make()), "en", f"s{i % 2}") for i in range(600)] + [(1000 + i, " ".join(w + " |" * (k % 2) for k, w in enumerate(make())), "en", "s0") for i in range(5)]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")).collect()}
    assert all(got[i].kept for i in range(600))
    assert all(not got[i].kept and not got[i].base_failed and got[i].distance < 200 for i in range(1000, 1005))


def test_outliers_match_a_plain_estimate(spark):
    """Determinant, centre and outliers against NumPy: the best of many random starts, concentrated to the end."""
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9)))
    docs = [(i, " ".join(word() + ("," if rnd.random() < 0.1 else "") for _ in range(rnd.randrange(60, 400)))) for i in range(500)]
    docs += [(1000 + i, " ".join(word() * 6 + "###" for _ in range(rnd.randrange(60, 90)))) for i in range(60)]
    frame = spark.createDataFrame([(i, t, "en", "s") for i, t in docs], "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.judge(frame).collect()}
    x = frame.select("doc_id", quality_rules.statistics(F.col("text")).alias("s")).select("doc_id", "s.*").select("doc_id", *quality_rules.vector()).orderBy("doc_id").collect()
    ids, v = [r[0] for r in x], np.array([r[1:] for r in x], float) / quality_rules.GRID

    def estimate(rows, scale):
        return rows.mean(0), np.cov(rows.T, bias=True) * scale + np.eye(5) * quality_rules.RIDGE**2

    def distances(m, c):
        return np.einsum("ij,jk,ik->i", v - m, np.linalg.inv(c), v - m)

    best = None
    gen = np.random.default_rng(3)
    for _ in range(60):
        m, c = estimate(v[gen.choice(len(v), 30, replace=False)], 1.0)
        for _ in range(12):
            core = np.argsort(distances(m, c))[: int(quality_rules.H * len(v))]
            m, c = estimate(v[core], quality_rules.OF_CORE)
        if best is None or np.linalg.det(c) < np.linalg.det(best[1]):
            best = m, c
    inner = distances(*best) <= quality_rules.INNER
    want = distances(*estimate(v[inner], quality_rules.OF_INNER))
    assert {i for i, d in zip(ids, want) if d > quality_rules.CUTOFF} == {i for i in ids if got[i].distance > quality_rules.CUTOFF} == set(range(1000, 1060))
    clean = [(got[i].distance, d) for i, d in zip(ids, want) if i < 1000]
    assert np.corrcoef(np.array(clean).T)[0, 1] > 0.98


def test_run(spark, tmp_path):
    """The whole pipeline: every row is a document that its stages keep, and only the result's folder stays."""
    from parley.llm.common import WRITTEN

    docs = tables(spark, str(tmp_path))
    before = len(WRITTEN)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(WRITTEN) == before + 1 and {r.doc_id for r in got} < {d[0] for d in docs} and 1002 not in {r.doc_id for r in got}
