"""Meeting extraction: people, tasks, decisions, next meeting, and the whole result row.

One exchange by meeting serves all of it.  People of a meeting are gathered by
a window over its sentences; tasks are a fold over a meeting's sentences, with
many meetings in an Arrow batch; decisions and the next meeting are window
expressions.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions import extract as ex
from ..functions import lexicon_meeting as lx
from ..functions import rx
from ..functions.batches import mapped, slices

# ---- predicates of one sentence, as expressions ----------------------------------------------


def is_next_meeting(text: Column) -> Column:
    return ~rx.search(text, lx.OPENING) & (rx.search(text, lx.NEXT_MEETING) | (rx.search(text, lx.DAYTIME_MEETING[0]) & rx.search(text, lx.DAYTIME_MEETING[1])))


def is_heading(text: Column) -> Column:
    text = F.trim(text)
    signal = rx.search(text, rf"\b(?:{rx.any_of(lx.ASSIGNMENT_SIGNALS)})\b")
    starts = rx.search(text, lx.HEADING_STARTS[0]) | rx.search(text, lx.HEADING_STARTS[1])
    return (text == "") | starts | (rx.search(text, lx.PART_START) & ~signal)


def lists_action_verb(text: Column, verbs=lx.ACTION_VERBS) -> Column:
    return rx.search(text, rf"\b(?:{rx.any_of(verbs)})\b")


def not_assigned(clause: Column, has_deadline: Column) -> Column:
    """Why a clause assigns nothing, else null."""
    past, forbidden, guess, reported = map(F.lit, lx.REASONS)
    return F.when(
        ~rx.search(clause, lx.STRONG_SIGNAL),
        F.when(rx.search(clause, lx.PAST), past)
        .when(rx.search(clause, lx.FORBIDDEN), forbidden)
        .when(rx.search(clause, lx.GUESS), guess)
        .when(rx.search(clause, lx.REPORTED) & ~has_deadline, reported),
    )


def truly_contains(text: Column, pattern: str, barred=(lx.NEGATED_BEFORE, lx.PURPOSE_BEFORE)) -> Column:
    """Does ``pattern`` occur somewhere that no barred left context precedes?"""
    java = rx.java(pattern)
    parts = F.split(text, java, -1)
    found = F.regexp_extract_all(text, F.lit(java), F.lit(0))
    # the text before occurrence i is what lies before it, occurrences included
    before = lambda i: F.array_join(F.concat(F.flatten(F.zip_with(F.slice(parts, F.lit(1), i), F.slice(found, F.lit(1), i), lambda p, f: F.array(p, f))), F.slice(parts, i + 1, F.lit(1))), "")
    free = lambda t: ~rx.search(t, barred[0]) & ~rx.search(t, barred[1])
    return F.when(F.size(found) > 0, F.exists(F.sequence(F.lit(0), F.size(found) - 1), lambda i: free(before(i)))).otherwise(F.lit(False))


def has_decision_term(text: Column) -> Column:
    return truly_contains(text, lx.DECISION_VERBS) | rx.search(text, lx.DECISION_TERMS)


def is_regulation(text: Column) -> Column:
    return rx.search(text, lx.REGULATION)


def is_decision(text: Column) -> Column:
    return has_decision_term(text) | is_regulation(text) | rx.search(text, lx.DISCOUNT)


TEXTS = pa.list_(pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def deadlines(text: pa.Array) -> pa.Array:
    return mapped(ex.deadlines, TEXTS, text.fill_null(""))


@F.arrow_udf(T.ArrayType(T.StringType()))
def names_in(text: pa.Array) -> pa.Array:
    return mapped(lambda t: sorted(ex.names_in(t)), TEXTS, text.fill_null(""))


@F.arrow_udf(T.StructType([T.StructField("owner", T.StringType()), T.StructField("acts", T.BooleanType())]))
def owner_and_action(text: pa.Array, names: pa.Array) -> pa.Array:
    parts = []
    for t, n in slices(text.fill_null(""), names):
        texts = t.to_pylist()
        owners = [ex.owner_of(x, known) for x, known in zip(texts, n.to_pylist(), strict=True)]
        parts.append(pa.StructArray.from_arrays([pa.array(owners, pa.string()), pa.array([ex.is_actionable(x) for x in texts], pa.bool_())], ["owner", "acts"]))
    return pa.concat_arrays(parts)


def ordered_names(names: Column) -> Column:
    """Longest first, then by code points."""
    keyed = F.array_sort(F.transform(F.array_distinct(names), lambda n: F.struct((-F.char_length(n)).alias("k"), n.alias("n"))))
    return F.transform(keyed, lambda x: x["n"])


# ---- operators -------------------------------------------------------------------------------


def with_known_names(cleaned: DataFrame, out: str = "names") -> DataFrame:
    """Each sentence with all names of its meeting."""
    meeting = Window.partitionBy("source")
    found = F.flatten(F.collect_set(names_in(F.col("sach"))).over(meeting))
    return cleaned.withColumn(out, ordered_names(found))


def _folded(cleaned: DataFrame, made, kind: str, arrow: pa.DataType) -> DataFrame:
    """(source, n, x): the structs that ``made`` makes of a meeting's sentences in order and the names in them; a batch holds many meetings."""

    @F.arrow_udf(f"array<{kind}>")
    def of(meetings: pa.Array) -> pa.Array:
        parts = []
        for (some,) in slices(meetings):
            found = []
            for rows in some.to_pylist():
                names = ex.order_names(n for r in rows for n in ex.names_in(r["sach"]))
                found.append(made([(r["stt"], r["sach"], r["xa_giao"], r["start"]) for r in rows], names))
            parts.append(pa.array(found, pa.list_(arrow)))
        return pa.concat_arrays(parts)

    listed = cleaned.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("stt", "sach", "xa_giao", "start"))).alias("xs"))
    return listed.select("source", F.posexplode(of("xs")).alias("n", "x"))


def tasks(cleaned: DataFrame) -> DataFrame:
    """(source, task, owner, deadline, start, n): tasks in the order of their making."""
    arrow = pa.struct([("task", pa.string()), ("owner", pa.string()), ("deadline", pa.string()), ("start", pa.float64())])
    return _folded(cleaned, ex.tasks_of, "struct<task:string,owner:string,deadline:string,start:double>", arrow).select("source", "x.*", "n")


def trace(cleaned: DataFrame) -> DataFrame:
    """(source, rule, stt, text, outcome): what the task fold decided, and why."""

    def notes(sentences: list[tuple], names: list[str]) -> list[dict]:
        out = []
        ex.tasks_of(sentences, names, lambda *note: out.append(dict(zip(("rule", "stt", "text", "outcome"), note, strict=True))))
        return out

    arrow = pa.struct([("rule", pa.string()), ("stt", pa.int32()), ("text", pa.string()), ("outcome", pa.string())])
    return _folded(cleaned, notes, "struct<rule:string,stt:int,text:string,outcome:string>", arrow).select("source", "x.*")


def carry_topics(sentences: DataFrame, accepted: Column, text: Column, topic: Column, continues: str = lx.CONTINUES) -> DataFrame:
    """Decisions of each source from sentences with stt, start: (source, text, start, n).

    ``topic``: what an accepted sentence's tail announces, for the immediately
    next sentence only.  An accepted sentence without such a title that
    ``continues`` matches is joined to the decision before it, however far.
    """
    order = Window.partitionBy("source").orderBy("stt")
    rows = sentences.withColumn("__ok", accepted).withColumn("__topic", F.when(F.col("__ok"), topic)).withColumn("__text", text)
    rows = rows.withColumn("__title", F.lag("__topic").over(order)).filter("__ok")
    rows = rows.withColumn("__first", F.row_number().over(order) == 1)
    joins = ~F.col("__first") & F.col("__title").isNull() & rx.search(F.col("__text"), continues)
    new = F.when(joins, 0).otherwise(1)
    rows = rows.withColumn("__new", new).withColumn("n", F.sum("__new").over(order).cast("int") - 1)
    has_title = F.col("__title").isNotNull() & ~F.contains(F.lower("__text"), F.lower("__title"))
    shown = F.when(has_title, F.concat(F.col("__title"), F.lit(": "), F.col("__text"))).otherwise(F.col("__text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("stt", F.trim(shown).alias("t")))), lambda x: x["t"])
    joined = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.element_at(parts, 1), join_decision)
    return rows.groupBy("source", "n").agg(joined.alias("text"), F.min_by("start", "stt").alias("start")).select("source", "text", "start", "n")


def join_decision(before: Column, after: Column) -> Column:
    """Two decision texts in one, the second without its capital unless it starts with an abbreviation."""
    after = F.trim(after)
    head = F.substring(after, 1, 2)
    abbreviation = (head == F.upper(head)) & (head != F.lower(head))
    lowered = F.when(abbreviation, after).otherwise(F.concat(F.lower(F.substring(after, 1, 1)), F.substring(after, 2, 2**31 - 1)))
    return F.concat(F.regexp_replace(before, r"[ .,;]+$", ""), F.lit(", "), lowered)


def decisions(cleaned: DataFrame) -> DataFrame:
    """(source, text, start, n): decisions with topics carried over and continuations joined."""
    named = with_known_names(cleaned).withColumn("__o", owner_and_action(F.col("sach"), F.col("names")))
    s, owner, acts = F.col("sach"), F.col("__o.owner"), F.col("__o.acts")
    assigned = owner.isNotNull() & acts & ~(is_regulation(s) & (owner == lx.CHAIR))
    accepted = ~is_next_meeting(s) & ~is_heading(s) & ~F.col("xa_giao") & is_decision(s) & ~assigned
    topic = F.trim(rx.extract(s, lx.TOPIC_TAIL, 1))
    body = F.when(topic.isNotNull(), F.concat(F.regexp_replace(rx.replace(s, lx.TOPIC_TAIL, ""), "[ ,;]+$", ""), F.lit("."))).otherwise(s)
    return carry_topics(named, accepted, body, topic)


def time_and_place(value: Column) -> tuple[Column, Column]:
    trimmed = F.regexp_replace(F.trim(value), "[,. ]+$", "")
    place = F.regexp_replace(F.trim(F.coalesce(rx.extract(trimmed, lx.TIME_AND_PLACE, 2), rx.extract(trimmed, lx.TIME_AND_PLACE, 3))), "[,. ]+$", "")
    time = F.when(place.isNotNull(), F.regexp_replace(F.trim(rx.extract(trimmed, lx.TIME_AND_PLACE, 1)), "[,. ]+$", "")).otherwise(trimmed)
    return time, place


def next_meetings(cleaned: DataFrame) -> DataFrame:
    """(source, time, place, start): the first sentence of a meeting that settles when or where the next one is."""
    order = Window.partitionBy("source").orderBy("stt")
    s = F.col("sach")
    rows = cleaned.select("source", "stt", "start", "sach", F.lead("sach").over(order).alias("then")).filter(is_next_meeting(s) & ~rx.search(s, lx.NOT_SETTLED))
    time, place = time_and_place(rx.extract(s, lx.MEETING_VALUE, 1))
    time2, place2 = time_and_place(rx.extract(s, lx.DAYTIME_VALUE, 0))
    time = F.nullif(time, F.lit(""))
    rows = rows.withColumn("t", F.coalesce(time, F.nullif(time2, F.lit("")))).withColumn("p", F.when(time.isNotNull(), place).otherwise(place2))
    then = F.trim(rx.replace(F.regexp_replace(F.trim("then"), r"\.+$", ""), lx.PLACE_START, ""))
    usable = rx.search(F.col("then"), lx.PLACE_SENTENCE) & (F.size(F.split(then, r"\s+")) <= lx.PLACE_WORDS)
    rows = rows.withColumn("p", F.coalesce("p", F.when(usable, F.nullif(then, F.lit("")))))
    found = rows.filter("t is not null or p is not null")
    return found.groupBy("source").agg(F.min_by(F.struct(F.col("t").alias("time"), F.col("p").alias("place"), "start"), "stt").alias("m")).select("source", "m.*")


def markdown(results: DataFrame) -> DataFrame:
    """(source, markdown) of result rows."""
    none, unsure = F.array(F.lit(lx.NOTHING)), F.lit(lx.UNSURE)
    shown = lambda c: F.coalesce(F.nullif(c, F.lit("")), unsure)
    decided = F.when(F.size("decisions") > 0, F.transform("decisions", lambda d: F.concat(F.lit("- "), d["text"]))).otherwise(none)
    table = F.concat(
        F.array(F.lit("| Việc | Người phụ trách | Hạn chót |"), F.lit("|---|---|---|")),
        F.transform("tasks", lambda t: F.concat(F.lit("| "), shown(t["task"]), F.lit(" | "), shown(t["owner"]), F.lit(" | "), shown(t["deadline"]), F.lit(" |"))),
    )
    listed = F.when(F.size("tasks") > 0, table).otherwise(none)
    meeting = F.when(
        F.col("next_meeting").isNotNull(),
        F.array(F.concat(F.lit("- Thời gian: "), shown(F.col("next_meeting.time"))), F.concat(F.lit("- Địa điểm: "), shown(F.col("next_meeting.place")))),
    ).otherwise(none)
    lines = F.concat(
        F.array(F.concat(F.lit("# Tóm tắt cuộc họp: "), F.col("source")), F.lit(""), F.lit("## Nội dung chính"), F.lit(""), F.trim("summary"), F.lit(""), F.lit("## Quyết định")),
        decided, F.array(F.lit(""), F.lit("## Việc cần làm")), listed, F.array(F.lit(""), F.lit("## Cuộc họp tiếp theo")), meeting, F.array(F.lit("")),
    )
    return results.select("source", F.array_join(lines, "\n").alias("markdown"))


def invariant_faults(tasks: DataFrame) -> DataFrame:
    """Tasks whose description breaks an output rule, with the rules broken."""
    squeeze = lambda c: F.trim(rx.replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))
    text, deadline, raw = squeeze(F.col("task")), squeeze(F.col("deadline")), F.trim(F.coalesce("task", F.lit("")))
    marks = lx.STRAY_MARKS
    faults = [
        (text == "", "no description"),
        (F.element_at(F.split(text, " "), 1).isin(*lx.BAD_FIRST_WORDS), "bad first word"),
        (F.substring(raw, 1, 1).isin(*marks) | F.substring(raw, -1, 1).isin(*marks), "stray punctuation at an end"),
        (F.contains(raw, F.lit(".,")) | F.contains(raw, F.lit(",.")), "stray punctuation inside"),
        ((deadline != "") & F.contains(text, deadline), "repeats its deadline"),
        ((deadline != "") & rx.search(text, rx.any_of(lx.DEADLINE_PHRASES)), "names a deadline"),
    ]
    only = F.when(text == "", F.array(F.lit("no description"))).otherwise(F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in faults[1:]]), lambda x: x.isNotNull()))
    return tasks.withColumn("faults", only).filter(F.size("faults") > 0)


def results(cleaned: DataFrame, summaries: DataFrame, decided: DataFrame | None = None) -> DataFrame:
    """One row for each meeting: source, summary, decisions, tasks, next_meeting."""
    listed = lambda df, *cols: df.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("n", F.struct(*cols).alias("x")))).alias("xs")).select("source", F.transform("xs", lambda r: r["x"]).alias("xs"))
    t = listed(tasks(cleaned), "task", "owner", "deadline", "start").withColumnRenamed("xs", "tasks")
    d = listed(decisions(cleaned) if decided is None else decided, "text", "start").withColumnRenamed("xs", "decisions")
    m = next_meetings(cleaned).select("source", F.struct("time", "place", "start").alias("next_meeting"))
    base = cleaned.select("source").distinct().join(summaries, "source", "left").join(d, "source", "left").join(t, "source", "left").join(m, "source", "left")
    return base.select(
        "source",
        F.coalesce("summary", F.lit("")).alias("summary"),
        F.coalesce("decisions", F.array().cast(f"array<{schema.DECISION}>")).alias("decisions"),
        F.coalesce("tasks", F.array().cast(f"array<{schema.TASK}>")).alias("tasks"),
        "next_meeting",
    )
