"""Word error rates, numbers, folds over segments, samples, sound, sources: facts and properties."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.functions import audio, speech, wer
from parley.operators import evaluate, sampling, segments
from parley.sources import io


@pytest.mark.parametrize("digits,said", [("21", "hai mươi mốt"), ("105", "một trăm linh năm"), ("1005", "một nghìn không trăm linh năm"), ("2024", "hai nghìn không trăm hai mươi bốn"), ("20500", "hai mươi nghìn năm trăm"), ("15", "mười lăm"), ("0901", "không chín không một"), ("0", "không")])
def test_numbers(digits, said):
    assert wer.read_number(digits) == said


@pytest.mark.parametrize("a,b", [("20 tháng 10", "hai mươi tháng mười"), ("2,5%", "hai phẩy năm phần trăm"), ("1.000.000 đồng", "một triệu đồng"), ("9h30", "chín giờ ba mươi"), ("lý do", "lí do")])
def test_equal_after_normalising(a, b):
    assert wer.normalise_for_scoring(a) == wer.normalise_for_scoring(b)


def test_normalising_keeps_differences():
    assert wer.normalise_for_scoring("bả đi chợ") != wer.normalise_for_scoring("bà đi chợ") and wer.normalise_for_scoring("cái km") != wer.normalise_for_scoring("cái ki lô mét")
    assert wer.normalise("Mất 2-3 ngày") == "mất 2 3 ngày" and wer.normalise("Phần Front-end và back-end") == "phần frontend và backend"


def naive(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_alignment_costs_the_distance(a, b):
    ops = wer.align(a, b)
    assert sum(op != "equal" for op, *_ in ops) == naive(a, b) == sum(op != "equal" for op, *_ in wer.align(b, a))
    assert [a[i] for op, i, _ in ops if op != "insert"] == a and [b[j] for op, _, j in ops if op != "delete"] == b


def test_distance_expression(spark):
    data = [("a b c", "a x c d"), ("", "a b"), ("a", ""), ("", ""), ("a b a b", "b a b a")]
    df = spark.createDataFrame(data, "r string, h string").select("r", "h", wer.distance(wer.words(F.col("r")), wer.words(F.col("h"))).alias("d"))
    assert {(r.r, r.h): r.d for r in df.collect()} == {(a, b): naive(a.split(), b.split()) for a, b in data}


def test_errors_by_part_and_place(spark):
    ref, hyp = "bạn lan làm slide tuấn làm phần api nộp trước thứ sáu", "bạn lan làm slai nộp trước thứ sáu nha"
    rows = spark.createDataFrame([("f", ref, hyp)], "id string, text string, du_doan string").withColumn("ops", wer.alignment("text", "du_doan"))
    got = evaluate.by_part(rows, F.array(F.lit(4), F.lit(4), F.lit(4))).orderBy("part").collect()
    assert [(r.n, r.errors) for r in got] == [(4, 1), (4, 4), (4, 1)]
    eight = spark.createDataFrame([("a b c d e f g h i j k l m n o p", "a c d e X f g h i j k l m n o p")], "text string, du_doan string").withColumn("ops", wer.alignment("text", "du_doan"))
    assert {r.place: r.n for r in evaluate.by_position(eight, F.array(F.lit(8), F.lit(8))).collect()} == {"edge": 12, "middle": 4}


def test_bootstrap():
    diff, low, high = evaluate.interval(*zip(*[(10, 3, 1)] * 30, strict=True))
    assert diff == pytest.approx(-0.2) and high < 0
    assert evaluate.interval([10, 10], [0, 5], [5, 0], ["c", "c"])[1:] == (0.0, 0.0)
    diff, low, high = evaluate.interval(*zip(*([(10, 3, 1), (10, 1, 3)] * 15), strict=True))
    assert low < 0 < high


def test_slow_rows(spark):
    rows = [("a", 1.0, 1.0), ("b", 1.0, 1.1), ("c", 1.0, 1.2), ("d", 1.0, 1.3), ("e", 1.0, 9.0)]
    df = spark.createDataFrame(rows, "id string, do_dai double, thoi_gian double")
    assert [r.id for r in evaluate.slow(df).collect()] == ["e"] and evaluate.slow(df.filter("id <> 'a'")).count() == 0


def test_turns(spark):
    turns = [(0.0, 2.0), (3.0, 4.0), (5.0, 9.0), (30.0, 31.0), (32.0, 55.0)]
    df = spark.createDataFrame([(turns,), ([],)], f"t {segments.TURNS}")
    got = [[tuple(x) for x in r[0]] for r in df.select(segments.merge_turns(df.t, 20.0)).collect()]
    assert got == [[(0, 9), (30, 31), (32, 55)], []]
    assert [tuple(x) for x in df.select(segments.merge_turns(df.t, 0)).first()[0]] == turns


def test_repeats(spark):
    a, b = "một câu khá dài ở đây", "câu thứ hai cũng khá dài"
    cases = {(a, b, a, b): [True, True, False, False], ("Dạ.", "Ok.", "Dạ.", "Ok."): [True] * 4, (a, "Dạ.", a): [True] * 3, (a, b, "c d e f g", a): [True] * 4, (a, a): [True, False]}
    df = spark.createDataFrame([(list(k),) for k in cases], "t array<string>")
    assert {tuple(r.t): r.k for r in df.select("t", segments.drop_repeats(df.t).alias("k")).collect()} == cases


def words(*texts, start=0.0, step=0.4, length=0.35):
    return [{"start": start + i * step, "end": start + i * step + length, "word": " " + t, "probability": 1.0} for i, t in enumerate(texts)]


def test_sentences():
    join = lambda s: len(speech.sentences(words(*s.split())))
    assert join("Gặp ở TP. Cần Thơ lúc 9h.") == 1 and join("Làm báo cáo, slide, v.v. Bạn Lan làm demo.") == 2 and join("Thì... mình nghĩ là xong.") == 1
    assert len(speech.sentences([*words("Ok"), *words("rồi", start=10.0)])) == 2
    long = speech.sentences(words(*[f"từ{i}," if i == 12 else f"từ{i}" for i in range(30)], step=1.0, length=1.0))
    assert len(long) == 2 and long[0]["text"].endswith("từ12,")


def test_garbage_and_reasons(spark):
    bad, good = ["unk", "UNK,", "vnvnvnvnvnvnvnvn", "hoahoahoahoa", "aaaaaaaaaa."], ["hahaha", "mississippi", "unknown"]
    df = spark.createDataFrame([(w,) for w in bad + good], "w string")
    assert {r.w for r in df.filter(speech.is_garbage(df.w)).collect()} == set(bad)
    seg = "struct<start:double,end:double,text:string,avg_logprob:double,no_speech_prob:double,compression_ratio:double>"
    hot = "Frontend, backend, database, API."
    rows = [(0.0, 9.0, hot, -0.3, 0.1, 1.5), (0.0, 9.0, hot, -1.5, 0.1, 1.5), (0.0, 0.1, "một hai ba bốn", -0.3, 0.1, 1.5), (0.0, 9.0, "cảm ơn " * 30, -0.3, 0.1, 1.5), (0.0, 9.0, "Thanks for watching", -0.3, 0.1, 1.5), (0.0, 9.0, "Còn một số từ tiếng Anh.", -0.3, 0.1, 1.5), (0.0, 9.0, "", 0.0, 0.0, 1.0)]
    df = spark.createDataFrame([(r,) for r in rows], f"s {seg}")
    got = [r[0] for r in df.select(speech.reject_reason(df.s)).collect()]
    assert got == [None, "đọc lại từ khóa gợi ý", "tốc độ nói bất khả thi", "lặp chữ", "câu bịa kiểu YouTube", "đọc lại câu mở đầu", "rỗng"]
    assert [r[0] for r in df.select(speech.reject_reason(df.s, "khong")).collect()][1] is None


def test_word_ranges(spark):
    df = spark.createDataFrame([(words("một", "hai", "ba", "bốn", "năm", start=3.0),)], "w array<struct<start:double,end:double,word:string,probability:double>>")
    kept, rest = segments.words_before(df.w, 4.5)
    row = df.select(F.size(kept).alias("n"), rest.alias("r"), F.size(segments.words_between(df.w, 3.0, 4.0)).alias("m"), segments.sentence(df.w).alias("s")).first()
    assert (row.n, row.r, row.m, row.s.text) == (4, "năm", 3, "một hai ba bốn năm")


def test_quotas(spark):
    rows = [(i, i, "đủ ba chữ nhé" if i else "hai chữ", f"r{i % 3}", f"sp{i % 15}") for i in range(60)]
    df = spark.createDataFrame(rows, "ord bigint, row_idx bigint, text string, nhom string, nguon string")
    nine = sampling.two_quotas(df, 9, 3, 2)
    got = nine.collect()
    assert len(got) == 9 and all(sum(r.nhom == g for r in got) <= 3 for g in ("r0", "r1", "r2")) and 0 not in {r.row_idx for r in got}
    more = sampling.two_quotas(df, 12, 3, 2, taken=nine.select("row_idx", "nhom", "nguon")).collect()
    assert len(more) == 3 and not {r.row_idx for r in more} & {r.row_idx for r in got}
    assert sampling.fill_files([("a", 30.0), ("b", 40.0), ("c", 5.0)], 60, 3, lambda: 1.0) == [["a", "b"], ["c"]]


def tone(hz, level, seconds=5.0):
    return (level * np.sin(2 * np.pi * hz * np.arange(int(seconds * audio.RATE)) / audio.RATE)).astype(np.float32)


def power(x, hz):
    return np.abs(np.fft.rfft(x))[int(hz * len(x) / audio.RATE)]


def test_sound():
    x = tone(50, 0.05) + tone(200, 0.1)
    y = audio.remove_hum(x)
    assert len(y) == len(x) and power(y, 50) < power(x, 50) / 31 and abs(20 * np.log10(power(y, 200) / power(x, 200))) < 0.1
    quiet = np.concatenate([np.zeros(19 * audio.RATE, np.float32), tone(300, 0.001, 1.0)])
    z, gain = audio.normalise_loudness(quiet)
    assert gain <= 15.01 and np.abs(z).max() <= 0.951
    noise = np.random.default_rng(0).normal(0, 0.01, 5 * audio.RATE).astype(np.float32)
    assert audio.reduce_noise(tone(300, 0.2) + noise)[1] is False
    gate = (np.arange(5 * audio.RATE) // audio.RATE % 2 == 0).astype(np.float32)
    w, applied = audio.reduce_noise(tone(300, 0.3) * gate + noise)
    assert applied and np.std(w[audio.RATE + 4000 : 2 * audio.RATE - 4000]) < np.std(noise) / 2
    assert audio.warnings(tone(300, 0.2)) == [] and np.allclose(audio.decode_wav(audio.encode_wav(x)), x, atol=1e-4)
    for bad in (b"", b"RIFFxx", audio.encode_wav(tone(300, 0.2, 0.5)), audio.encode_wav(np.zeros(2 * audio.RATE))):
        with pytest.raises(audio.InputError):
            audio.decode_wav(bad)
    assert audio.suffix_of(b"fLaC..") == ".flac" and audio.suffix_of(b"??", "a.M4A") == ".m4a" and audio.suffix_of(b"??") == ".wav"


def test_sources(spark, tmp_path):
    good = [{"speaker": "A", "start": 0, "end": 1.5, "text": "xin chào"}, {"speaker": "B", "start": 2, "end": 3, "text": "vâng"}]
    (tmp_path / "ok.json").write_text("﻿" + json.dumps(good, ensure_ascii=False), encoding="utf-8")
    for name, bad in {"late": [{**good[0], "start": 9}], "type": [{**good[0], "start": True}], "none": [], "text": [{**good[0], "text": None}]}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(bad))
    (tmp_path / "broken.json").write_text("{")
    rows, faults = io.read_transcripts(spark, str(tmp_path))
    assert [(r.source, r.pos, r.start, r.text) for r in rows.orderBy("pos").collect()] == [("ok", 0, 0.0, "xin chào"), ("ok", 1, 2.0, "vâng")]
    assert {r.source for r in faults.collect()} == {"late", "type", "none", "text", "broken"}


def test_listings(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"audio": "x.wav", "t": "1"}, {"audio": "", "t": "2"}]))
    (tmp_path / "b.json").write_text('{"audio": "y.wav"}\n{"t": "3"}\n')
    assert sorted(r.r["audio"] for r in io.read_listing(spark, str(tmp_path)).collect()) == ["x.wav", "y.wav"]
    paths = spark.createDataFrame([("d/A.wav",), ("e/a.WAV",), ("f/c.mp3",), ("g.txt",)], "path string")
    done = spark.createDataFrame([("out/c.json",)], "path string")
    assert sorted(r.path for r in io.pending_audio(paths, done).collect()) == ["d/A.wav", "e/a.WAV"]
    assert [tuple(r) for r in io.colliding_stems(paths).collect()] == [("a", 2)]


def test_streaming_equals_batch(spark, tmp_path):
    from parley.operators import meetings
    from parley.streaming import live

    data = [("m", 0, 0, "S", 0.0, 1.0, "", "Còn một việc nữa là viết slide giới thiệu.", "", False), ("m", 1, 1, "S", 4.0, 5.0, "", "Việc này bạn Lan làm.", "", False)]
    schema = "source string, pos int, stt int, speaker string, start double, `end` double, goc string, sach string, tach_tu string, xa_giao boolean"
    batch = spark.createDataFrame(data, schema)
    for i in (1, 0):
        spark.createDataFrame(data[i : i + 1], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = live.read_sentences(spark, str(tmp_path / "in"), maxFilesPerTrigger="1")
    query = live.tasks(stream, str(tmp_path / "store")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    got = [(r.owner, r.task) for r in live.latest(spark, str(tmp_path / "store")).collect()]
    assert got == [(r.owner, r.task) for r in meetings.tasks(batch).collect()] == [("Lan", "viết slide giới thiệu")]


def test_number_words_column(spark):
    digits = ["0", "5", "10", "11", "15", "21", "24", "25", "105", "1005", "1015", "21001", "1000000", "1000005", "1234567890", "007", "1234567890123"]
    got = spark.createDataFrame([(x,) for x in digits], "x string").select("x", wer.number_words(F.col("x")).alias("w")).collect()
    assert {r.x: r.w for r in got} == {x: wer.read_number(x) for x in digits}
    assert wer.read_number("1015") == "một nghìn không trăm mười lăm" and wer.read_number("105") == "một trăm linh năm" and wer.read_number("007") == "không không bảy"


def test_draws_in_blocks_are_the_same(monkeypatch):
    rnd = np.random.default_rng(4)
    n, a, b, c = rnd.integers(1, 50, 300), rnd.integers(0, 9, 300), rnd.integers(0, 9, 300), rnd.integers(0, 70, 300)
    whole = evaluate.interval(n, a, b, c)
    monkeypatch.setattr(evaluate, "DRAWN", 500)
    assert evaluate.interval(n, a, b, c) == whole


def test_report_and_choices(spark, tmp_path):
    from parley.operators import reports

    rows = spark.createDataFrame([("u", 0, 9, False), ("u", 1, 12, False), ("u", 2, 3, True), ("v", 0, 5, True), ("v", 1, 7, False), ("v", 2, 7, False)], "k string, no int, words int, good boolean")
    assert {r.k: r.no for r in reports.best_hearing(rows, "k").collect()} == {"u": 2, "v": 1}
    df = spark.createDataFrame([("Thứ 6 An làm báo cáo", "báo cáo"), ("An làm báo cáom", "báo cáo"), ("x", "")], "t string, p string")
    assert [r.w for r in df.select(reports.whole_word(df.t, df.p).alias("w")).collect()] == [True, False, False]
    name = spark.range(1).select(reports.config_name(F.lit("models\\Pho-Medium/"), {"beam": 5, "gop": 0}, beam=F.lit(5), gop=F.lit(20)).alias("n")).first().n
    assert name == "pho-medium_gop20"
    assert reports.read_or(spark, str(tmp_path / "none"), "a int").count() == 0
    long = spark.createDataFrame([("a", ["1", "2"], 10, 3), ("b", ["2", "9"], 5, 1)], "id string, parts array<string>, n int, errors int")
    short = spark.createDataFrame([("1", 4, 1), ("2", 6, 0)], "id string, n int, errors int")
    pairs, rest = reports.against_parts(long, short)
    assert [tuple(r) for r in pairs.collect()] == [("a", 10, 3, 2, 10, 1)] and [r.id for r in rest.collect()] == ["b"]
    tasks = spark.createDataFrame([("m", 4.0, "x"), ("m", 9.0, "y")], "source string, start double, task string")
    said = spark.createDataFrame([("m", 1, 4.0, "one"), ("m", 2, 4.0, "two")], "source string, pos int, start double, sach string")
    assert {r.task: r.sentence for r in reports.source_sentences(tasks, said).collect()} == {"x": "one", "y": None}
