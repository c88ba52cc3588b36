"""Tasks, decisions, meetings, labels: facts at sentence and meeting level."""

import pytest

from parley.functions import extract as ex
from parley.operators import clean, evaluate, meetings, rank

# fixed input and expected facts: sentences, then (owner, keyword, deadline)
SENTENCES = [
    (["Theo anh thì nên gửi báo giá sớm hơn."], []),
    (["Nếu làm theo cách cũ thì sẽ mất thêm thời gian."], []),
    (["Tuần trước bạn Hùng đã gửi báo cáo rồi."], []),
    (["Phần tiếp theo sẽ là phần API."], []),
    (["Chị Lan sẽ gửi báo cáo trước thứ 6."], [("Lan", "báo cáo", "thứ 6")]),
    (["Bạn Nam sẽ nộp báo cáo vào ngày mai."], [("Nam", "báo cáo", "ngày mai")]),
    (["Em lo phần báo cáo nhé, hạn là thứ 6."], [("Người chủ trì", "báo cáo", "thứ 6")]),
    (["Còn một việc nữa là viết slide giới thiệu.", "Việc này bạn Lan làm."], [("Lan", "slide", None)]),
    (["Bạn Hùng phụ trách phần đăng nhập."], [("Hùng", "đăng nhập", None)]),
    (["Tiếp theo là phần giao diện.", "Hôm nay trời đẹp quá."], []),
    (["Chị Thanh Hà sẽ gửi báo cáo trước thứ 6."], [("Thanh Hà", "báo cáo", "thứ 6")]),
    (["Nếu mọi người đồng ý thì sẽ chốt luôn."], []),
]


@pytest.mark.parametrize("sentences,want", SENTENCES)
def test_tasks(sentences, want):
    rows = [(i, t, False, 4.0 * i) for i, t in enumerate(sentences)]
    names = ex.order_names(n for t in sentences for n in ex.names_in(t))
    got = ex.tasks_of(rows, names)
    assert [(t["owner"], t["deadline"]) for t in got] == [(o, h) for o, _, h in want]
    assert all(k in t["task"].lower() for t, (_, k, _) in zip(got, want, strict=True))


def test_shared_deadline_and_lists():
    texts = ["Bạn Hùng làm phần đăng nhập, bạn Lan làm phần thanh toán, hạn là thứ 6."]
    got = ex.tasks_of([(0, texts[0], False, 0.0)], ["Hùng", "Lan"])
    assert {t["owner"]: t["deadline"] for t in got}.get("Lan") == "thứ 6"


def test_deadlines():
    assert ex.deadlines("Nộp thứ 5, deadline là thứ 6 tuần này.") == ["thứ 6 tuần này", "thứ 5"]
    assert ex.deadlines("thứ 2 là phần API") == [] and ex.deadlines("Hạn cũ là thứ 4.") == [] and ex.deadlines("") == []
    assert ex.deadlines("Không để đến thứ 5.") == []


def test_names_are_ordered():
    assert ex.order_names(["Lan", "An", "Thanh Hà", "Bảo"]) == ["Thanh Hà", "Bảo", "Lan", "An"]
    assert ex.names_in("Chị Thanh Hà sẽ gửi báo cáo.") == {"Thanh Hà", "Hà"} and ex.names_in("Công ty Minh Phát gửi báo giá.") == set()
    assert ex.proper("bạn lan") == "Lan"


def sentences(spark, *texts, source="m"):
    return spark.createDataFrame([(source, i, i, "S", 4.0 * i, 4.0 * i + 3, t, t, t, False) for i, t in enumerate(texts)], "source string, pos int, stt int, speaker string, start double, `end` double, goc string, sach string, tach_tu string, xa_giao boolean")


def test_decisions(spark):
    df = sentences(spark, "Cả nhóm chốt dùng React, cuối cùng là KPI.", "Mỗi người phải đạt 10 đơn.", "Và miễn phí vận chuyển cho khách mới.", "Chưa chốt phương án màu.", "Hôm nay trời đẹp.")
    got = [r.text for r in meetings.decisions(df).orderBy("n").collect()]
    assert got == ["Cả nhóm chốt dùng React.", "KPI: Mỗi người phải đạt 10 đơn, và miễn phí vận chuyển cho khách mới."]


def test_next_meeting(spark):
    df = sentences(spark, "Họp tiếp theo thông báo lại sau.", "Họp tiếp theo là thứ 4.", "Họp online trên Google Meet.")
    assert [tuple(r) for r in meetings.next_meetings(df).collect()] == [("m", "thứ 4", "online trên Google Meet", 4.0)]


def test_tasks_frame_trace_and_result(spark):
    df = sentences(spark, "Chị Lan sẽ gửi báo cáo trước thứ 6.", "Cả nhóm chốt dùng React cho giao diện mới.", "Họp tiếp theo là thứ 2 tuần sau tại phòng họp 402.")
    t = meetings.tasks(df).collect()
    assert [(r.owner, r.task, r.deadline) for r in t] == [("Lan", "gửi báo cáo", "thứ 6")]
    assert meetings.trace(df).filter("rule = 'task'").count() == 1 and meetings.invariant_faults(meetings.tasks(df)).count() == 0
    decided = meetings.decisions(df)
    row = meetings.results(df, rank.summaries(df, decided), decided)
    md = meetings.markdown(row).first().markdown
    assert "| gửi báo cáo | Lan | thứ 6 |" in md and "- Thời gian: thứ 2 tuần sau" in md and "- Địa điểm: phòng họp 402" in md and "- Cả nhóm chốt" in md


def test_label_matching(spark):
    need = [{"chu": "Lan", "tu_khoa": ["báo cáo"], "han": "thứ 6"}, {"chu": "Nam", "tu_khoa": ["api"], "han": "ngày 5 tháng 11", "han_bi_thay": "thứ 3 tuần sau"}]
    spare, barred = [{"chu": "Hà", "tu_khoa": ["slide"]}], [{"chu": "Tuấn", "tu_khoa": []}]
    task = lambda o, t, h: {"owner": o, "task": t, "deadline": h}
    kinds = lambda *ts: sorted(k for k, *_ in evaluate.match_tasks(need, spare, barred, list(ts)))
    lan, nam = task("Lan", "gửi báo cáo", "trước thứ 6"), task("Nam", "làm API", "ngày 5 tháng 11")
    assert kinds(lan, nam) == ["ĐÚNG", "ĐÚNG"] and kinds(lan) == sorted(["ĐÚNG", "THIẾU"]) and kinds(lan, lan, nam) == sorted(["ĐÚNG", "ĐÚNG", "TRÙNG"])
    assert kinds(lan, task("Nam", "api", "thứ 3 tuần sau")) == sorted(["ĐÚNG", "HẠN_BỊ_THAY"]) and "CẤM" in kinds(task("Tuấn", "gì đó", None))
    assert kinds(lan, nam, task("Hà", "làm slide", None)).count("TÙY_CHỌN") == 1
    assert evaluate.match_decisions([["a"], ["b"]], [], ["a b", "c"]) == {"matched": 1, "required": 2, "missing": 1, "extra": 1}


def test_meeting_labels(spark):
    rows = [("both", {"thoi_gian_chua": "thứ 4", "noi_bang": None}, "Thứ 4  tuần sau", None, True), ("absent", {}, "x", "y", True), ("null", {"thoi_gian_chua": None}, "x", None, False), ("place", {"noi_bang": "phòng 1"}, None, "Phòng 2", False)]
    df = spark.createDataFrame([(k, m, t, p, w) for k, m, t, p, w in rows], "k string, label map<string,string>, time string, place string, want boolean")
    got = df.select("k", "want", evaluate.meeting_passes(df.label, df.time, df.place).alias("got")).collect()
    assert [(r.k, r.got) for r in got] == [(r.k, r.want) for r in got]


def test_pagerank_and_summary(spark):
    import numpy as np

    ranks = rank.pagerank(np.array([[1, 0.5, 0.0], [0.5, 1, 0.5], [0.0, 0.5, 1]]))
    assert ranks[1] == 1 and ranks[0] == pytest.approx(ranks[2]) and (rank.pagerank(np.eye(3)) == 1).all()
    text = rank.summary([f"Số {i} là kết quả mà nhóm {i} trình bày hôm nay" for i in range(9)], list(map(float, range(9))), [0.1 * i for i in range(9)])
    assert text.count(".") >= 2 and rank.shorten("về giao diện thì mình sẽ sửa lại") == "Giao diện: sẽ sửa lại."
    assert clean.renumber(sentences(spark, "a", "b").drop("stt")).count() == 2


def test_flagship_has_results(spark):
    """Meetings made of the catalogue's sentences have decisions, tasks and next meetings, and those that were said."""
    from parley.plans import catalog

    rows = catalog.flagship(spark, "/root/testdata/sf0.001").collect()
    assert sum(len(r.decisions) for r in rows) > 5 and sum(len(r.tasks) for r in rows) > 5 and sum(r.next_meeting is not None for r in rows) > 2
    tasks = {(t.owner, t.task, t.deadline) for r in rows for t in r.tasks}
    assert ("Lan", "gửi báo cáo", "thứ 6") in tasks and ("Tú", "viết tài liệu", "ngày 12 tháng 8") in tasks
    assert {r.next_meeting.time for r in rows if r.next_meeting} == {"tối chủ nhật lúc 9h"}
    assert all(r.summary for r in rows)


def test_summary_scores(spark):
    known = ["Cả nhóm chốt dùng MySQL cho kho."]
    texts = ["Cả nhóm chốt dùng MySQL cho kho.", "Mình chưa chốt phương án nào.", "Họp để thống nhất kế hoạch.", "Doanh số tăng 20% nhờ tập trung vào kho."]
    df = spark.createDataFrame([(t, known) for t in texts], "t string, known array<string>")
    got = df.select(rank.is_known(df.t, df.known).alias("k"), rank.bonus(df.t).alias("b"), rank.penalty(df.t, df.known).alias("p")).collect()
    assert [r.k for r in got] == [True, False, False, False]
    assert [round(r.b, 2) for r in got] == [0.35, 0.0, 0.0, 0.5] and [round(r.p, 2) for r in got] == [0.3, 0.0, 0.0, 0.0]


def test_command_line(spark, tmp_path, capsys):
    import json

    from parley.__main__ import main

    said = ["Chị Lan sẽ gửi báo cáo trước thứ 6.", "Cả nhóm chốt dùng MySQL cho kho."]
    row = lambda i, t: {"speaker": "S", "start": 4.0 * i, "end": 4.0 * i + 3, "text": t}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "m1.json").write_text(json.dumps([row(i, t) for i, t in enumerate(said)]), encoding="utf-8")
    (tmp_path / "in" / "m2.json").write_text("[]", encoding="utf-8")
    (tmp_path / "ref").mkdir()
    (tmp_path / "ref" / "m1.txt").write_text("\ufeffChị Lan gửi báo cáo trước thứ 6. Cả nhóm chốt dùng MySQL cho kho.", encoding="utf-8")
    where = lambda name: str(tmp_path / name)
    assert main(["clean", where("in"), where("out")], spark) == 1 and "m2" in capsys.readouterr().err
    assert sorted(r.sach for r in spark.read.json(where("out")).collect()) == sorted(said)
    assert main(["meetings", where("in"), where("made")], spark) == 1
    made = spark.read.json(where("made/json")).collect()
    assert [(t.owner, t.task) for t in made[0].tasks] == [("Lan", "gửi báo cáo")]
    capsys.readouterr()
    assert main(["wer", where("in"), where("ref")], spark) == 1
    assert capsys.readouterr().out.splitlines()[0].split("\t")[:5] == ["m1", "15", "0", "0", "1"]
    want = {"m1": {"tap": "a", "viec_bat_buoc": [{"chu": "Lan", "tu_khoa": ["báo cáo"], "han": "thứ 6"}]}}
    (tmp_path / "want.json").write_text(json.dumps(want), encoding="utf-8")
    assert main(["quality", where("want.json"), where("made/json")], spark) == 0
    assert capsys.readouterr().out.split() == ["a", "1.0", "1.0", "1.0"]
