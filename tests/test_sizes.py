"""What queries take at size: memory of Python by text and by batch, calls of Python, and results that don't change with them."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from parley.functions import extract, speech, text, wer
from parley.operators import clean, evaluate, meetings, reports
from parley.plans import catalog


def peak_mb(call) -> float:
    tracemalloc.start()
    try:
        call()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def by_whole_table(a, b):
    """The alignment from a table of numbers, ties as documented."""
    table = np.array([[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)])
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i, j] = min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
    out, i, j = [], len(a), len(b)
    while i or j:
        if i and table[i, j] == table[i - 1, j] + 1:
            i, op = i - 1, "delete"
        elif j and table[i, j] == table[i, j - 1] + 1:
            j, op = j - 1, "insert"
        else:
            i, j = i - 1, j - 1
            op = "equal" if a[i] == b[j] else "substitute"
        out.append((op, i, j))
    return out[::-1]


def test_alignment_ties():
    draw = random.Random(3)
    for _ in range(400):
        a, b = ([draw.choice("abcd") for _ in range(draw.randrange(14))] for _ in range(2))
        want = by_whole_table(a, b)
        assert wer.align(a, b) == want
        assert wer.count(a, b) == tuple(sum(op == o for op, *_ in want) for o in ("substitute", "delete", "insert"))


def test_alignment_memory_of_long_texts():
    words = [str(i) for i in range(5000)]
    other = [w if k % 7 else "x" for k, w in enumerate(words)]
    assert peak_mb(lambda: wer.align(words, other)) < 20


def test_alignment_memory_of_a_batch():
    text = " ".join(f"w{i}" for i in range(80))
    batch = pa.array([text] * 4000)
    assert peak_mb(lambda: wer.alignment.func(batch, batch)) < 40 and peak_mb(lambda: wer.counts.func(batch, batch)) < 10


def test_python_runs_once_for_counts(spark):
    labels = spark.createDataFrame([("a", 1, "x y z", "g"), ("b", 2, " ", "g"), ("c", 3, None, "g"), ("d", 4, "p\x1cq\u00a0r", "g")], "id string, ord int, text string, nhom string")
    made = spark.createDataFrame([("a", "x z q"), ("b", "x"), ("c", None), ("d", "p q r")], "id string, du_doan string").selectExpr("*", "array('cut') as bi_loai")
    scored = evaluate.scored(labels, made)
    got = {r.id: (r.n, r["sub"], r["del"], r.ins, r.errors, len(r.ops)) for r in scored.collect()}
    assert got == {"a": (3, 0, 1, 1, 2, 4), "b": (0, 0, 0, 1, 1, 1), "c": (0, 0, 0, 0, 0, 0), "d": (3, 0, 0, 0, 0, 3)}
    most = reports.filtered_most(scored).select("id", "del", "n")
    assert [tuple(r) for r in most.collect()] == [("a", 1, 3), ("d", 0, 3)]
    plan = most._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "alignment(" not in plan


def test_sentences_memory_of_a_batch():
    words = [{"start": i * 0.4, "end": i * 0.4 + 0.35, "word": f" w{i}." if i % 9 == 8 else f" W{i}", "probability": 1.0} for i in range(80)]
    kind = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64()), ("word", pa.string()), ("probability", pa.float64())]))
    batch = pa.concat_arrays([pa.array([words, None, []], kind), *[pa.array([words] * 500, kind)] * 8])
    made = []
    assert peak_mb(lambda: made.append(speech.sentences_of.func(batch))) < 20
    assert made[0].slice(0, 3).to_pylist() == [speech.sentences(words), [], []] and len(made[0]) == 4003
    assert [s["text"][-3:] for s in speech.sentences(words)][:2] == ["w8.", "17."]


def test_many_meetings_share_a_batch(spark):
    said = catalog.SAID
    rows = [(f"m{k}", i, said[(k + i * (1 + k % 3)) % len(said)], False, 4.0 * i) for k in range(300) for i in range(k % 7)]
    cleaned = spark.createDataFrame(rows, "source string, stt int, sach string, xa_giao boolean, start double")
    made = meetings.tasks(cleaned)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "FlatMapGroups" not in plan
    want = set()
    for m in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == m]
        names = extract.order_names(n for r in own for n in extract.names_in(r[1]))
        want |= {(m, t["task"], t["owner"], t["deadline"], t["start"], n) for n, t in enumerate(extract.tasks_of(own, names))}
    got = [tuple(r) for r in made.collect()]
    assert set(got) == want and len(got) == len(want) > 200 and made.columns == ["source", "task", "owner", "deadline", "start", "n"]


def test_results_keep_meetings_together(spark):
    said = catalog.SAID
    rows = [(f"m{k}", i, i, "S", 4.0 * i, 4.0 * i + 3, t, t, t, False) for k in range(40) for i, t in enumerate(said[k % 5 :])]
    cleaned = spark.createDataFrame(rows, "source string, pos int, stt int, speaker string, start double, `end` double, goc string, sach string, tach_tu string, xa_giao boolean")
    found = meetings.results(cleaned, cleaned.select("source").distinct().selectExpr("source", "'' as summary"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan
    got = {r.source: [(t.task, t.owner, t.deadline) for t in r.tasks] for r in found.collect()}
    assert len(got) == 40 and got["m0"] == got["m35"] and any(o == "Lan" for _, o, _ in got["m0"])


def test_plain_text_is_not_searched_for_every_rewrite(monkeypatch):
    calls, sub = [], wer.re.sub
    stages = wer._SPOKEN, wer._SPELLING
    monkeypatch.setattr(wer.re, "sub", lambda *a, **b: (calls.append(a[0]), sub(*a, **b))[1])
    assert wer.normalise_for_scoring("Bạn Nam sẽ gửi báo cáo, nhé.") == "bạn nam sẽ gửi báo cáo nhé" and len(calls) <= 2
    # no rewrite is left out: all of them, needed or not, give the same
    draw = random.Random(4)
    parts = ["mươi tư", "mười nhăm", "mươi một", "ngàn", "tỉ", "trăm lẻ", "hai chục", "vaccine", "vắc xin", "Kỳ", "lý", "qui", "hoà", "thuỷ", "quý", "1.000.000", "3,5", "9h30", "7 h", "5km", "3 ha", "ki-lô-gam", "50%", "a-b", "2-3", "٣", "x"]
    for _ in range(500):
        text = "".join(draw.choice(parts) + draw.choice(["", " ", ", "]) for _ in range(6))
        want = wer.unicodedata.normalize("NFC", text.lower())
        for stage in stages:
            for _, pattern, by in stage:
                want = sub(pattern, by, want)
            want = " ".join(want.split())
        assert wer.normalise_for_scoring(text) == want


COUNTS_ONLY = ["q30_worst_segments", "q54_correction_effect", "q28_wer_grouping_sets", "q67_report_totals", "q57_groups_by_rate", "q59_against_parts", "q65_comparison", "q31_common_ids", "q27_wer_distance", "q33_config_spread", "q32_bootstrap_ci"]  # queries that need no operations
OPERATIONS = ["q53_position_class", "q29_confusions_topk"]  # queries that do


@pytest.mark.parametrize("name", [*COUNTS_ONLY, *OPERATIONS])
def test_alignments_are_made_where_needed(spark, name):
    made = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "counts(" in plan or name in OPERATIONS
    assert plan.count("ArrowEvalPython [alignment(") == (name in OPERATIONS)


def test_texts_are_cleaned_once(spark):
    plan = catalog.q03_clean_full(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2  # composition, fillers
    rows = [("m", 2 * i, "S", 0.0, 1.0, t) for i, t in enumerate(["...", "One.", None, " - ", "Two.", "Réservé."])] + [("n", 0, "S", 0.0, 1.0, "!")]
    got = clean.clean_sentences(spark.createDataFrame(rows, "source string, pos int, speaker string, start double, `end` double, text string"), catalog.ENGLISH)
    assert sorted((r.source, r.pos, r.stt, r.goc) for r in got.collect()) == [("m", 2, 0, "One."), ("m", 8, 1, "Two."), ("m", 10, 2, "Réservé.")]
    assert dict(got.dtypes)["stt"] == "int"


def test_compounds_in_a_row(spark):
    said = ["of the of the of the end", "In the  of_the\nin the", "of then of the", "xof the"]
    rows = spark.createDataFrame([(t,) for t in said], "t string")
    assert [r[0] for r in rows.select(text.join_compounds(rows.t, catalog.ENGLISH)).collect()] == ["of_the of_the of_the end", "In_the  of_the\nin_the", "of then of_the", "xof the"]
