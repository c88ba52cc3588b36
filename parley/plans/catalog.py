"""Registered queries of the meeting and evaluation operators, with DuckDB SQL where SQL can say the same.

Driver tables stand in for meetings: ``conversations`` for transcripts, its
perturbed copies for recogniser output, ``events`` for turns.  Their text is
not Vietnamese, so operators get stand-in patterns, or Vietnamese sentences
chosen by conversation and turn (``spoken``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import extract as ex
from ..functions import lexicon_meeting as lx
from ..functions import rx
from ..functions import speech as sp
from ..functions import text as tx
from ..functions import wer
from ..functions.lexicon_clean import ENGLISH, VIETNAMESE, CleaningLexicon
from ..operators import clean, evaluate, meetings, rank, reports, sampling, segments
from ..sources import io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: A word boundary and a word that mean the same to both engines.
EDGE_L, EDGE_R, W = r"(?:^|[^\pL\pN_])", r"(?:$|[^\pL\pN_])", r"[\pL\pN_]+"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.from_conversations(table(spark, sf_dir, "conversations"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as clean sentences without any rewriting."""
    rows = transcript(spark, sf_dir).filter(~tx.is_blank(F.col("text")))
    return clean.renumber(rows).select("source", "pos", "stt", "speaker", "start", "end", F.col("text").alias("sach"), F.lit(False).alias("xa_giao"))


SENT = r"select cast(conv_id as varchar) as source, turn as pos, row_number() over (partition by conv_id order by turn) - 1 as stt, role as speaker, turn * 4.0 as start, text as sach from conversations where regexp_matches(text, '[\pL\pN_]')"


def spaced(text):
    return F.filter(F.split(text, r"[ \t\n\r\f\x0b]+"), lambda w: w != "")


def spoken(spark: SparkSession, sf_dir: str, templates: list) -> DataFrame:
    """(conv_id, turn, k, texts): Vietnamese sentences chosen by conversation and turn, as the tables hold none."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.pmod(F.col("conv_id") * 31 + F.col("turn") * 7, F.lit(len(templates))).cast("int").alias("k"))
    texts = F.array(*[F.array(*map(F.lit, [t] if isinstance(t, str) else t)) for t in templates])
    return rows.withColumn("texts", F.element_at(texts, F.col("k") + 1))


def small_meetings(spark: SparkSession, sf_dir: str, templates: list) -> DataFrame:
    """Every turn's sentences as a transcript of its own."""
    rows = spoken(spark, sf_dir, templates).select(F.concat_ws("-", "conv_id", "turn").alias("source"), F.posexplode("texts").alias("pos", "text"))
    return rows.select("source", "pos", F.lit("SPEAKER_00").alias("speaker"), (F.col("pos") * 4.0).alias("start"), (F.col("pos") * 4.0 + 3.0).alias("end"), "text")


def spoken_sql(templates: list) -> str:
    return f"spoken as (select *, (conv_id * 31 + turn * 7) % {len(templates)} as k, concat_ws('-', conv_id, turn) as source from conversations)"


SPACED = r"list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda w: w <> '')"


# ---- scan and cleaning -----------------------------------------------------------------------


@query("select cast(conv_id as varchar) as source, cast(turn as int) as pos, role as speaker, cast(turn * 4.0 as double) as start, cast(turn * 4.0 + 3.0 as double) as \"end\", text from conversations")
def q01_transcript_scan(spark, d):
    return transcript(spark, d)


PLAIN_TIDY = CleaningLexicon(tidy=((r"\s+", " "), (r"\s+([,.?!;:])", r"\1"), (r"\.{4,}", "...")))


@query(r"""select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '\s+([,.?!;:])', '\1', 'g'), '\.{4,}', '...', 'g')) as sach from documents""")
def q02_clean_whitespace(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.tidy(F.col("text"), PLAIN_TIDY).alias("sach"))


@query()
def q03_clean_full(spark, d):
    return clean.clean_sentences(transcript(spark, d), ENGLISH)


@query(f"select source, cast(pos as int) as pos, cast(stt as int) as stt, sach from ({SENT})")
def q04_stt_renumber(spark, d):
    return sentences(spark, d).select("source", "pos", "stt", "sach")


TALK = CleaningLexicon(greetings=("^(?:the|in|is|le|la|de|die|und|en)( |$)",), closers="^(?:of|to|et|der|y|a)( |$)", assigns="(?:tion|keit)", times=r"[0-9]", small_talk_words=15)


@query(r"""
with e as (select cast(conv_id as varchar) as source, cast(turn as int) as pos, regexp_split_to_array(text, '\.') as ps from conversations),
x as (select source, pos, unnest(ps) as text, unnest(range(len(ps))) as k from e),
c as (select *, list_filter(list_transform(regexp_split_to_array(text, '[,.?!;]'), lambda c: regexp_replace(c, '^\s+|\s+$', '', 'g')), lambda c: c <> '') as cs,
  len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) as n from x),
g as (select *, list_transform(cs, lambda c: not regexp_matches(c, '(?i)(?:tion|keit)') and regexp_matches(c, '(?i)^(?:the|in|is|le|la|de|die|und|en)( |$)')) as gs,
  list_transform(cs, lambda c: regexp_matches(c, '(?i)^(?:of|to|et|der|y|a)( |$)')) as ks from c)
select source, pos, cast(k as int) as k, n < 15 and not regexp_matches(text, '[0-9]') and len(list_filter(gs, lambda g: g)) > 0
  and len(list_filter(list_zip(gs, ks), lambda z: not (z[1] or z[2]))) = 0 as xa_giao from g""")
def q05_small_talk(spark, d):
    pieces = transcript(spark, d).select("source", "pos", F.posexplode(F.split("text", r"\.")).alias("k", "text"))
    return pieces.select("source", "pos", "k", tx.is_small_talk(F.col("text"), TALK).alias("xa_giao"))


@query("select doc_id, nfc_normalize(text) as text from documents")
def q06_nfc_normalise(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.nfc(F.col("text")).alias("text"))


@query(r"""with t as (select doc_id, regexp_replace(text, '(^|\s)(of)[\s_]+(the)(?:$|(\s))', '\1\2_\3\4', 'g') as a from documents),
u as (select doc_id, regexp_replace(a, '(^|\s)(of)[\s_]+(the)(?:$|(\s))', '\1\2_\3\4', 'g') as a from t), v as (select doc_id, regexp_replace(a, '(^|\s)(in)[\s_]+(the)(?:$|(\s))', '\1\2_\3\4', 'gi') as a from
(select doc_id, regexp_replace(a, '(^|\s)(of)[\s_]+(the)(?:$|(\s))', '\1\2_\3\4', 'gi') as a from u))
select doc_id, regexp_replace(a, '(^|\s)(in)[\s_]+(the)(?:$|(\s))', '\1\2_\3\4', 'gi') as tach_tu from v""")
def q07_compound_join(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.join_compounds(F.col("text"), ENGLISH).alias("tach_tu"))


MARKS = CleaningLexicon(rewrites=((r"\s*\|\s*", " / "), ("!!+", "!"), ("([#%&$*])([#%&$*])+", r"\1")))


@query(r"""select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\s*\|\s*', ' / ', 'g'), '!!+', '!', 'g'), '([#%&$*])([#%&$*])+', '\1', 'g') as text from documents""")
def q08_lexicon_fold(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.rewrite(F.col("text"), MARKS).alias("text"))


@query(r"""select page_id, 'THE sample ' || url || ' THE end' as text from pages""")
def q09_url_shield(spark, d):
    shield = CleaningLexicon(rewrites=((r"example", "sample"), (r"\bthe\b", "THE")))
    pages = table(spark, d, "pages")
    return pages.select("page_id", tx.rewrite(F.concat(F.lit("the example "), F.col("url"), F.lit(" the end")), shield).alias("text"))


@query(r"""select source, pos, cast(i - 1 as int) as clause_no, clause from (select cast(conv_id as varchar) as source, cast(turn as int) as pos, unnest(regexp_split_to_array(text, '\s*,\s*')) as clause, generate_subscripts(regexp_split_to_array(text, '\s*,\s*'), 1) as i from conversations)""")
def q10_clause_explode(spark, d):
    return transcript(spark, d).select("source", "pos", F.posexplode(F.split("text", r"\s*,\s*")).alias("clause_no", "clause"))


VERBS = ("the", "and", "les", "der", "que")


HEADS = ("Tiếp theo là ", "Thứ 2 là ", "Phần ", "Mục sẽ ", "")


@query(rf"""with t as (select *, [{", ".join(f"'{h}'" for h in HEADS)}][turn % {len(HEADS)} + 1] || text as said from conversations)
select cast(conv_id as varchar) as source, cast(turn as int) as pos, regexp_matches(said, '(?i){EDGE_L}(?:{"|".join(VERBS)}){EDGE_R}') as acts,
  turn % {len(HEADS)} < 2 or (turn % {len(HEADS)} = 2 and regexp_matches(trim(said), '(?i)^(?:phần|mục)\s+[^\n]*\n?$') and not regexp_matches(said, '(?i){EDGE_L}(?:giao cho|phụ trách|sẽ|phải|cần){EDGE_R}')) or trim(said) = '' as heading from t""")
def q11_verb_filter(spark, d):
    t = F.concat(F.element_at(F.array(*map(F.lit, HEADS)), (F.col("pos") % len(HEADS) + 1).cast("int")), F.col("text"))
    return transcript(spark, d).select("source", "pos", meetings.lists_action_verb(t, VERBS).alias("acts"), meetings.is_heading(t).alias("heading"))


# ---- extraction ------------------------------------------------------------------------------

DEADLINES = (
    ("Chị Lan sẽ gửi báo cáo trước thứ 6.", ["thứ 6"]),
    ("Hạn chót là ngày 20 tháng 10.", ["ngày 20 tháng 10"]),
    ("Bạn Nam sẽ nộp báo cáo vào ngày mai.", ["ngày mai"]),
    ("Thứ 2 là phần API.", []),
    ("Hạn cũ là thứ 4.", []),
    ("Nộp thứ 5, deadline là thứ 6 tuần này.", ["thứ 6 tuần này", "thứ 5"]),
)


def _values(rows) -> str:
    lit = lambda v: "null" if v is None else "[" + ", ".join(map(lit, v)) + "]::varchar[]" if isinstance(v, (list, tuple)) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


def _cases(rows) -> str:
    """Rows with the number of their template before them, as SQL values."""
    return _values([(k, *r) for k, rs in enumerate(rows) for r in rs])


@query(f"with {spoken_sql(DEADLINES)} select conv_id, turn, text, found from (select conv_id, turn, k from spoken) join (values {_cases([[r] for r in DEADLINES])}) t(k, text, found) using (k)")
def q12_deadline_extract(spark, d):
    rows = spoken(spark, d, [t for t, _ in DEADLINES]).select("conv_id", "turn", F.col("texts")[0].alias("text"))
    return rows.withColumn("found", meetings.deadlines("text"))


NAMED = (
    ("Chị Lan sẽ gửi báo cáo trước thứ 6.", ["Lan"]),
    ("Bạn Hùng phụ trách phần đăng nhập.", ["Hùng"]),
    ("Chị Thanh Hà sẽ gửi báo cáo.", ["Thanh Hà", "Hà"]),
    ("Hôm nay trời đẹp quá.", []),
    ("Phần này thì Minh sẽ làm.", ["Minh"]),
    ("Mọi người cùng xem lại.", []),
    ("Còn anh Tú làm slide.", ["Tú"]),
)


@query(f"""with {spoken_sql(NAMED)}, n as (select conv_id, unnest(names) as n from spoken join (values {_cases([[(ns,)] for _, ns in NAMED])}) t(k, names) using (k))
select cast(c.conv_id as varchar) as source, coalesce(list_transform(list_sort(list(distinct {{'k': -length(n), 'n': n}}) filter (where n is not null)), lambda x: x.n), []) as names
from (select distinct conv_id from conversations) c left join n using (conv_id) group by c.conv_id""")
def q13_known_names(spark, d):
    rows = spoken(spark, d, [t for t, _ in NAMED]).select(F.col("conv_id").cast("string").alias("source"), F.col("texts")[0].alias("sach"))
    return meetings.with_known_names(rows).groupBy("source").agg(F.first("names").alias("names"))


NAMES = ("the", "that", "with", "for", "les", "des", "und", "la")


@query(rf"""select cast(conv_id as varchar) as source, cast(turn as int) as pos,
  list_filter(list_sort(list_transform([{", ".join(f"'{n}'" for n in NAMES)}], lambda n: {{'k': -length(n), 'n': n}})), lambda x: regexp_matches(text, '(?i){EDGE_L}' || x.n || '{EDGE_R}'))[1].n as owner
from conversations""")
def q14_owner_first_match(spark, d):
    names = meetings.ordered_names(F.array(*map(F.lit, NAMES)))
    found = F.filter(names, lambda n: F.regexp_like(F.col("text"), F.concat(F.lit(r"(?iU)\b"), rx.quoted(n), F.lit(r"\b"))))
    return transcript(spark, d).select("source", "pos", F.get(found, 0).alias("owner"))


@query(rf"""with s as ({SENT}), o as (select *, regexp_matches(sach, '^[A-Z][a-z]+ ') as ok, nullif(regexp_extract(sach, '([a-z]+)\.$', 1), '') as topic from s),
t as (select *, lag(case when ok then topic end) over (partition by source order by stt) as title from o)
select source, trim(case when title is not null and not contains(lower(sach), lower(title)) then title || ': ' || sach else sach end) as text, cast(start as double) as start, cast(row_number() over (partition by source order by stt) - 1 as int) as n
from t where ok""")
def q15_decision_topic_carry(spark, d):
    s = F.col("sach")
    return meetings.carry_topics(sentences(spark, d), s.rlike("^[A-Z][a-z]+ "), s, F.nullif(F.regexp_extract(s, r"([a-z]+)\.$", 1), F.lit("")))


@query(rf"""with s as ({SENT}), o as (select *, case when stt > 0 and regexp_matches(sach, '(?i)^(?:the|in|of|le|la|de|die|en)( |$)') then 0 else 1 end as is_new from s),
i as (select *, sum(is_new) over (partition by source order by stt) - 1 as n, trim(sach) as t from o),
p as (select *, row_number() over (partition by source, n order by stt) = 1 as head, row_number() over (partition by source, n order by stt desc) = 1 as tail from i),
q as (select *, case when head or (left(t, 2) = upper(left(t, 2)) and left(t, 2) <> lower(left(t, 2))) then t else lower(left(t, 1)) || substr(t, 2) end as a from p)
select source, string_agg(case when tail then a else regexp_replace(a, '[ .,;]+$', '') end, ', ' order by stt) as text, cast(min(start) as double) as start, cast(n as int) as n from q group by source, n""")
def q16_decision_merge(spark, d):
    return meetings.carry_topics(sentences(spark, d), F.lit(True), F.col("sach"), F.lit(None).cast("string"), "^(?:the|in|of|le|la|de|die|en)( |$)")


MEETINGS = (
    (["Họp tiếp theo là tối chủ nhật lúc 9h."], [("tối chủ nhật lúc 9h", None)]),
    (["Buổi họp sau là thứ 2 tuần sau tại phòng họp 402."], [("thứ 2 tuần sau", "phòng họp 402")]),
    (["Họp tiếp theo thông báo lại sau."], []),
    (["Họp tiếp theo là thứ 4.", "Họp online trên Google Meet."], [("thứ 4", "online trên Google Meet")]),
    (["Hôm nay trời đẹp quá."], []),
)


@query(f"with {spoken_sql(MEETINGS)} select source, time, place, 0.0::double as start from spoken join (values {_cases([w for _, w in MEETINGS])}) t(k, time, place) using (k)")
def q17_next_meeting(spark, d):
    rows = small_meetings(spark, d, [t for t, _ in MEETINGS])
    return meetings.next_meetings(rows.select("source", F.col("pos").alias("stt"), "start", F.col("text").alias("sach"), F.lit(False).alias("xa_giao")))


TASKS = (
    (["Theo anh thì nên gửi báo giá sớm hơn."], []),
    (["Nếu làm theo cách cũ thì sẽ mất thêm thời gian."], []),
    (["Phần tiếp theo sẽ là phần API."], []),
    (["Chị Lan sẽ gửi báo cáo trước thứ 6."], [("gửi báo cáo", "Lan", "thứ 6")]),
    (["Bạn Hùng phụ trách phần đăng nhập."], [("phần đăng nhập", "Hùng", None)]),
    (["Tiếp theo là phần giao diện.", "Hôm nay trời đẹp quá."], []),
    (["Chị Thanh Hà sẽ gửi báo cáo trước thứ 6."], [("gửi báo cáo", "Thanh Hà", "thứ 6")]),
    (["Nếu mọi người đồng ý thì sẽ chốt luôn."], []),
)


@query(f"with {spoken_sql(TASKS)} select source, task, owner, deadline from spoken join (values {_cases([w for _, w in TASKS])}) t(k, task, owner, deadline) using (k)")
def q18_tasks(spark, d):
    found = meetings.tasks(clean.clean_sentences(small_meetings(spark, d, [t for t, _ in TASKS]), VIETNAMESE))
    return found.select("source", "task", "owner", "deadline")


CONTENT_STOP = ("the", "of", "and", "to", "in", "is", "de", "la", "le", "die", "der", "und", "en", "et")


def content(text):
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(W), F.lit(0)))
    return F.filter(F.array_except(words, F.array(*map(F.lit, CONTENT_STOP))), lambda w: ~w.rlike("^[0-9]+$"))


CONTENT = rf"list_filter(list_distinct(regexp_extract_all(lower(text), '{W}')), lambda w: not list_contains([{', '.join(repr(w) for w in CONTENT_STOP)}], w) and not regexp_matches(w, '^[0-9]+$'))"


@query(f"""with c as (select conv_id, turn, role, {CONTENT} as ws from conversations)
select cast(a.conv_id as varchar) as source, cast(a.turn as int) as i, cast(b.turn as int) as j, cast(len(list_intersect(a.ws, b.ws)) as int) as common,
  case when least(len(a.ws), len(b.ws)) > 0 then len(list_intersect(a.ws, b.ws)) / least(len(a.ws), len(b.ws)) else 0.0 end as ratio
from c a join c b on a.conv_id = b.conv_id and a.role = b.role and a.turn < b.turn""")
def q19_task_dedup_overlap(spark, d):
    rows = transcript(spark, d).withColumn("ws", content(F.col("text")))
    return overlap_pairs(rows, (F.col("a.speaker") == F.col("b.speaker")))


def overlap_pairs(rows: DataFrame, on) -> DataFrame:
    """Content overlap of earlier and later rows of a source."""
    pairs = rows.alias("a").join(rows.alias("b"), (F.col("a.source") == F.col("b.source")) & (F.col("a.pos") < F.col("b.pos")) & on)
    common, least = F.size(F.array_intersect("a.ws", "b.ws")), F.least(F.size("a.ws"), F.size("b.ws"))
    return pairs.select(F.col("a.source").alias("source"), F.col("a.pos").alias("i"), F.col("b.pos").alias("j"), common.alias("common"), F.when(least > 0, common / least).otherwise(0.0).alias("ratio"))


@query(f"""with c as (select conv_id, turn, {CONTENT} as ws from conversations), p as (
select cast(a.conv_id as varchar) as source, cast(a.turn as int) as i, cast(b.turn as int) as j, cast(len(list_intersect(a.ws, b.ws)) as int) as common,
  case when least(len(a.ws), len(b.ws)) > 0 then len(list_intersect(a.ws, b.ws)) / least(len(a.ws), len(b.ws)) else 0.0 end as ratio
from c a join c b on a.conv_id = b.conv_id and a.turn < b.turn and b.turn - a.turn <= 3)
select * from p where common >= 3 and ratio >= 0.05""")
def q20_deadline_band_join(spark, d):
    rows = transcript(spark, d).withColumn("ws", content(F.col("text")))
    return overlap_pairs(rows, F.col("b.pos") - F.col("a.pos") <= 3).filter("common >= 3 and ratio >= 0.05")


# ---- ranking ---------------------------------------------------------------------------------

TFIDF = rf"""w as (select conv_id, turn, regexp_extract_all(lower(text), '{W}') as ws from conversations),
terms as (select conv_id, turn, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) as term from w),
c as (select conv_id, turn, term, count(*) as c from terms group by all), items as (select conv_id, count(*) as items from conversations group by all),
df as (select conv_id, term, count(*) as df from c group by all),
raw as (select c.conv_id, turn, c.term, (1 + ln(c)) * (ln((1 + items) / (1 + df)) + 1) as w from c join df on df.conv_id = c.conv_id and df.term = c.term join items on items.conv_id = c.conv_id),
weights as (select conv_id, turn, term, w / sqrt(sum(w * w) over (partition by conv_id, turn)) as weight from raw)"""


def weights(spark, d):
    return rank.tfidf(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query(f"with {TFIDF} select conv_id, turn, term, round(weight, 6) as weight from weights")
def q21_tfidf(spark, d):
    return weights(spark, d).withColumn("weight", F.round("weight", 6))


@query(f"with {TFIDF} select a.conv_id, a.turn as i, b.turn as j, round(sum(a.weight * b.weight), 6) as sim from weights a join weights b on a.conv_id = b.conv_id and a.term = b.term and a.turn < b.turn group by all")
def q22_cosine_pairs(spark, d):
    return rank.cosine_pairs(weights(spark, d), "conv_id", "turn").withColumn("sim", F.round("sim", 6))


@query("""with x as (select vec_id, label, cast(unnest(embedding) as double) as x, generate_subscripts(embedding, 1) as i from embeddings), m as (select label, i, avg(x) as m from x group by all)
select vec_id, x.label, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 6) as sim from x join m on m.label = x.label and m.i = x.i group by all""")
def q23_cosine_embeddings(spark, d):
    rows = table(spark, d, "embeddings")
    own = rows.join(rank.centroids(rows, "label", "embedding"), "label")
    return own.select("vec_id", "label", F.round(rank.dense_cosine(F.col("embedding"), F.col("centroid")), 6).alias("sim"))


PAGERANK_ROUNDS = 60


@query(f"""with recursive {TFIDF}, pairs as (select a.conv_id, a.turn as i, b.turn as j, sum(a.weight * b.weight) as sim from weights a join weights b on a.conv_id = b.conv_id and a.term = b.term and a.turn < b.turn group by all),
edges as (select conv_id, i, j, sim from pairs where sim > 0 union all select conv_id, j, i, sim from pairs where sim > 0),
degree as (select conv_id, i, sum(sim) as degree from edges group by all), share as (select e.conv_id, e.i, e.j, sim / degree as p from edges e join degree d on d.conv_id = e.conv_id and d.i = e.i),
nodes as (select c.conv_id, c.turn as item, n, degree is null as alone from conversations c join (select conv_id, count(*) as n from conversations group by all) using (conv_id) left join degree on degree.conv_id = c.conv_id and degree.i = c.turn),
step as (select 0 as r, conv_id, item, n, alone, 1.0::double / n as rank from nodes union all
  select r + 1, s.conv_id, s.item, n, alone, 0.85 * (coalesce(got, 0) + lost / n) + 0.15 / n
  from (select *, coalesce(sum(case when alone then rank end) over (partition by conv_id), 0) as lost from step where r < {PAGERANK_ROUNDS}) s
  left join (select t.conv_id, h.j, sum(t.rank * h.p) as got from step t join share h on h.conv_id = t.conv_id and h.i = t.item group by all) g on g.conv_id = s.conv_id and g.j = s.item)
select conv_id, item, round(case when bool_and(alone) over (partition by conv_id) then 1 else rank / max(rank) over (partition by conv_id) end, 6) as rank from step where r = {PAGERANK_ROUNDS}""")
def q24_pagerank(spark, d):
    nodes = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("item"))
    ranked = rank.pagerank_table(rank.cosine_pairs(weights(spark, d), "conv_id", "turn"), nodes, "conv_id", rounds=PAGERANK_ROUNDS, tolerance=0.0)
    return ranked.withColumn("rank", F.round("rank", 6))


@query()
def q25_mmr_summary(spark, d):
    return rank.summaries(sentences(spark, d))


@query(rf"""with s as (select conv_id, turn, text, len({SPACED}) as n from conversations),
a as (select *, count(*) filter (where n >= 40) over (partition by conv_id) as k from s), b as (select * from a where n >= 40 or k < 3),
c as (select *, count(*) filter (where not contains(text, '|')) over (partition by conv_id) as m from b)
select conv_id, turn from c where not contains(text, '|') or m < 2""")
def q26_candidate_ladder(spark, d):
    rows = table(spark, d, "conversations")
    tests = [(F.size(spaced(F.col("text"))) >= 40, 3), (~F.contains("text", F.lit("|")), 2)]
    return rank.relaxing_filters(rows, "conv_id", tests).select("conv_id", "turn")


# ---- word error rates ------------------------------------------------------------------------
# A configuration's output is the text with every k-th word dropped or replaced by a word no text
# has: then the number of errors is known.

CONFIGS = (("drop7", 7, "drop"), ("sub5", 5, "sub"), ("sub9", 9, "sub"))


def perturbed(text, k: int, how: str):
    at = lambda i: (i + 1) % k == 0
    if how == "drop":
        return F.array_join(F.filter(spaced(text), lambda w, i: ~at(i)), " ")
    return F.array_join(F.transform(spaced(text), lambda w, i: F.when(at(i), F.lit("@@@")).otherwise(w)), " ")


def labels(spark, d):
    rows = table(spark, d, "conversations")
    ident = F.concat_ws("-", "conv_id", "turn").alias("id")
    return rows.select(ident, (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.array_join(spaced(F.col("text")), " ").alias("text"), F.col("role").alias("nhom"), "conv_id", "turn")


def gaps(text) -> dict:
    """What each configuration has a result for, where results are to be missing."""
    return {"drop7": F.size(spaced(text)) >= 12, "sub5": ~text.rlike("^[A-C]"), "sub9": ~F.contains(text, F.lit("x"))}


GAPS = "case cfg when 'drop7' then len(ws) >= 12 when 'sub5' then not regexp_matches(array_to_string(ws, ' '), '^[A-C]') else not contains(array_to_string(ws, ' '), 'x') end"


def outputs(spark, d, missing: bool = False):
    """Results of three configurations; with ``missing`` each lacks some texts."""
    base = labels(spark, d)
    has = gaps(F.col("text"))
    parts = [
        base.filter(has[cfg] if missing else F.lit(True)).select("id", F.lit(cfg).alias("cfg"), perturbed(F.col("text"), k, how).alias("du_doan"), (F.col("turn") + 1.0).alias("do_dai"), (F.col("turn") * 0.5 + 0.25 * k).alias("thoi_gian"))
        for cfg, k, how in CONFIGS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def scores(spark, d, missing: bool = False):
    return evaluate.scored(labels(spark, d), outputs(spark, d, missing))


SCORES = f"""base as (select concat_ws('-', conv_id, turn) as id, conv_id * 1000 + turn as ord, {SPACED} as ws, role as nhom, conv_id, turn from conversations),
cfgs as (select * from (values ('drop7', 7), ('sub5', 5), ('sub9', 9)) t(cfg, k)),
scores as (select id, ord, nhom, cfg, len(ws) as n, len(ws) // k as errors, turn + 1.0 as do_dai, turn * 0.5 + 0.25 * k as thoi_gian, ws, k, conv_id, turn from base, cfgs)"""
SCORES_GAPS = SCORES + f", had as (select * from scores where {GAPS})"


@query(f"with {SCORES} select id, cfg, cast(n as int) as n, cast(errors as int) as errors from scores")
def q27_wer_distance(spark, d):
    return scores(spark, d).select("id", "cfg", "n", "errors")


@query(f"""with {SCORES} select nhom, cast(grouping(nhom) as int) as is_total, count(*) as segments, cast(sum(n) as bigint) as n, cast(sum(errors) as bigint) as errors,
round(sum(errors) / sum(n), 9) as wer, round(sum(thoi_gian) / sum(do_dai), 9) as rtf from scores where cfg = 'sub5' group by grouping sets ((), (nhom))""")
def q28_wer_grouping_sets(spark, d):
    t = evaluate.totals(scores(spark, d).filter("cfg = 'sub5'"))
    return t.select("nhom", F.col("is_total").cast("int").alias("is_total"), "segments", "n", "errors", F.round("wer", 9).alias("wer"), F.round("rtf", 9).alias("rtf"))


@query(f"""with {SCORES}, e as (select ord, unnest(range(k, len(ws) + 1, k)) as p, ws from scores where cfg = 'sub5')
select ws[p] as ref, '@@@' as hyp, count(*) as count from e group by ws[p] order by count(*) desc, min({{'o': ord, 'p': p}}) limit 30""")
def q29_confusions_topk(spark, d):
    return evaluate.confusions(scores(spark, d).filter("cfg = 'sub5'"))


@query(f"with {SCORES} select id, cast(errors as int) as errors, cast(n as int) as n from scores where cfg = 'drop7' order by case when n > 0 then errors / n else 0 end desc, ord limit 15")
def q30_worst_segments(spark, d):
    return evaluate.worst(scores(spark, d).filter("cfg = 'drop7'")).select("id", "errors", "n")


@query(f"""with {SCORES_GAPS}, common as (select id from had group by id having count(distinct cfg) = 3), r as (select * from had where id in (select id from common))
select a.cfg, count(*) filter (where a.errors < b.errors) as better, count(*) filter (where a.errors > b.errors) as worse, count(*) filter (where a.errors = b.errors) as equal
from r a join r b on a.id = b.id and b.cfg = 'drop7' where a.cfg <> 'drop7' group by a.cfg""")
def q31_common_ids(spark, d):
    rows = scores(spark, d, True).select("cfg", "id", "errors")
    return evaluate.against_base(rows.join(evaluate.common_ids(rows), "id", "left_semi"), "drop7")


@query()
def q32_bootstrap_ci(spark, d):
    rows = scores(spark, d, True)
    a = rows.filter("cfg = 'drop7'").select("id", "n", F.col("errors").alias("a"), "ord", F.col("conv_id").alias("cluster"))
    pairs = rows.filter("cfg <> 'drop7'").select("id", "cfg", F.col("errors").alias("b")).join(a, "id")
    return evaluate.bootstrap(pairs)


@query(f"with {SCORES_GAPS} select id, round(max(errors / n) - min(errors / n), 9) as spread from had where n > 0 group by id having max(errors / n) - min(errors / n) >= 0.05")
def q33_config_spread(spark, d):
    return evaluate.spread(scores(spark, d, True).select("cfg", "id", "errors", "n"), 0.05).withColumn("spread", F.round("spread", 9))


@query("select doc_id, n_chars from documents where doc_id not in (select doc_id from labels)")
def q34_anti_resume(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("select doc_id, quality, toxic from labels where doc_id in (select doc_id from documents where n_chars > 0)")
def q35_label_semijoin(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").filter("n_chars > 0").select("doc_id"), "doc_id", "left_semi")


@query("""with j as (select lang, quality = 1 as q, n_chars > 500 as p from documents join labels using (doc_id))
select lang, case when count(*) filter (where p) > 0 then count(*) filter (where p and q) / count(*) filter (where p) else 0 end as precision,
case when count(*) filter (where q) > 0 then count(*) filter (where p and q) / count(*) filter (where q) else 0 end as recall from j group by lang""")
def q36_precision_recall(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")
    good, said = F.col("quality") == 1, F.col("n_chars") > 500
    kind = F.when(good & said, evaluate.RIGHT).when(said, evaluate.FALSE).when(good, evaluate.MISSING)
    return evaluate.precision_recall(rows.withColumn("kind", kind), "lang").select("lang", "precision", "recall")


GREEDY = (
    ("both", [("Lan", "gửi báo cáo", "thứ 6"), ("Nam", "làm api", "ngày 5 tháng 11")], {"ĐÚNG": 2}),
    ("one", [("Lan", "gửi báo cáo", "trước thứ 6")], {"ĐÚNG": 1, "THIẾU": 1}),
    ("twice", [("Lan", "gửi báo cáo", "thứ 6"), ("Lan", "viết báo cáo", None), ("Nam", "làm api", "ngày 5 tháng 11")], {"ĐÚNG": 2, "TRÙNG": 1}),
    ("old", [("Lan", "gửi báo cáo", "thứ 6"), ("Nam", "làm api", "thứ 3 tuần sau")], {"ĐÚNG": 1, "HẠN_BỊ_THAY": 1}),
    ("barred", [("Tuấn", "làm gì đó", None)], {"THIẾU": 2, "CẤM": 1}),
    ("spare", [("Hà", "làm slide", None), ("Lan", "gửi báo cáo", "thứ 6")], {"ĐÚNG": 1, "TÙY_CHỌN": 1, "THIẾU": 1}),
)


@query(f"with {spoken_sql(GREEDY)} select source, kind, n from spoken join (values {_cases([list(w.items()) for *_, w in GREEDY])}) t(k, kind, n) using (k)")
def q37_greedy_match(spark, d):
    need = "struct<chu:string,tu_khoa:array<string>,han:string,han_bi_thay:string>"
    label = ("x", [("Lan", ["báo cáo"], "thứ 6", None), ("Nam", ["api"], "ngày 5 tháng 11", "thứ 3 tuần sau")], [("Hà", ["slide"], None, None)], [("Tuấn", [], None, None)])
    rows = spoken(spark, d, [s for s, *_ in GREEDY]).select(F.concat_ws("-", "conv_id", "turn").alias("source"), "k")
    want = spark.createDataFrame([(label,)], f"label struct<tap:string,viec_bat_buoc:array<{need}>,viec_tuy_chon:array<{need}>,viec_cam:array<{need}>>")
    made = spark.createDataFrame([(k, [(t, o, h, 0.0) for o, t, h in ts]) for k, (_, ts, _) in enumerate(GREEDY)], "k int, xs array<struct<task:string,owner:string,deadline:string,start:double>>")
    # one label and a few lists of tasks, given above
    found = evaluate.task_outcomes(rows.select("source").crossJoin(F.broadcast(want)), rows.join(F.broadcast(made), "k").select("source", "xs"))
    return found.groupBy("source", "kind").agg(F.count(F.lit(1)).cast("int").alias("n"))


# ---- segments --------------------------------------------------------------------------------


def seconds():
    """Seconds since 1970 of ``ts``, a timestamp without time zone."""
    return F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) / 1e6D")


def user_turns(spark, d):
    """Turns of a minute at each event, in order, by user."""
    rows = table(spark, d, "events").select("user_id", seconds().alias("start"), (seconds() + 60.0).alias("end"), "event_id")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("start", "event_id", "end"))), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return rows.groupBy("user_id").agg(turns.alias("turns"))


@query("""with recursive e as (select user_id, epoch_us(ts) / 1e6 as s, epoch_us(ts) / 1e6 + 60.0 as e, row_number() over (partition by user_id order by ts, event_id) as r from events),
f as (select user_id, r, s, e, s as first, 1 as g from e where r = 1 union all
  select e.user_id, e.r, e.s, e.e, case when e.e - f.first <= 86400.0 then f.first else e.s end, case when e.e - f.first <= 86400.0 then f.g else f.g + 1 end from f join e on e.user_id = f.user_id and e.r = f.r + 1)
select user_id, first as start, max_by(e, r) as "end" from f group by user_id, g, first""")
def q38_turn_merge_20(spark, d):
    merged = user_turns(spark, d).select("user_id", F.explode(segments.merge_turns(F.col("turns"), 86400.0)).alias("t"))
    return merged.select("user_id", "t.start", "t.end")


def timed_words(text):
    """Words 0.4 s apart, 0.35 s long, with a pause after every twentieth."""
    start = lambda i: i * 0.4 + F.floor(i / 20) * 2.5
    return F.transform(spaced(text), lambda w, i: F.struct(start(i).alias("start"), (start(i) + 0.35).alias("end"), F.concat(F.lit(" "), w).alias("word"), F.lit(1.0).alias("probability")))


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query(rf"""with t as (select cast(conv_id as varchar) as source, cast(turn as int) as pos, {SPACED} as ws from conversations),
w as (select source, pos, unnest(range(len(ws))) as i, unnest(ws) as word, unnest(list_concat(ws[2:], [''])) as nxt from t),
e as (select *, rtrim(word, '"''”’»)]') as core, ltrim(nxt, '"''“‘«([') as after from w),
f as (select *, left(after, 1) <> '' and upper(left(after, 1)) = left(after, 1) and lower(left(after, 1)) <> left(after, 1) as capital from e),
g as (select *, regexp_matches(core, '[.?!…]$') and not (lower(core) in {_in(sp.ABBREVIATIONS)} and not (capital and lower(core) in {_in(sp.ENDING_ABBREVIATIONS)}))
  and not (regexp_matches(core, '(?:\.\.\.|…)$') and after <> '' and not capital) as closes from f),
h as (select *, coalesce(lag(closes) over o, true) as opens from g window o as (partition by source, pos order by i)),
s as (select *, opens or (i % 20 = 0 and i - 1 - max(case when opens then i end) over (partition by source, pos order by i rows between unbounded preceding and 1 preceding) >= 7) as starts from h),
n as (select *, sum(case when starts then 1 else 0 end) over (partition by source, pos order by i) as no, i * 0.4 + (i // 20) * 2.5 as t0 from s),
x as (select source, pos, no, string_agg(word, ' ' order by i) as text, round(min(t0), 2) as start, round(max(t0) + 0.35, 2) as "end" from n group by source, pos, no)
select source, pos, cast(row_number() over (partition by source, pos order by no) - 1 as int) as k, 'SPEAKER_00' as speaker, cast(start as double) as start, cast("end" as double) as "end", text
from x where regexp_matches(text, '[\pL\pN_]')""")
def q39_gap_sentences(spark, d):
    rows = transcript(spark, d).withColumn("words", timed_words(F.col("text")))
    return rows.select("source", "pos", F.posexplode(sp.sentences_of("words")).alias("k", "s")).select("source", "pos", "k", "s.*")


@query(r"""with recursive t as (select cast(conv_id as varchar) as source, row_number() over (partition by conv_id order by turn, c) - 1 as k, trim(regexp_replace(lower(text), '[^\pL\pM\pN_]+', ' ', 'g')) as p
  from conversations, (values (0), (1)) v(c)), l as (select *, len(list_filter(string_split(p, ' '), lambda w: w <> '')) >= 4 as long from t),
r as (select source, k, p as one, null::varchar as two, long as long1, true as kept from l where k = 0 union all
  select l.source, l.k, case when goes then one else p end, case when goes then two else one end, case when goes then long1 else long end, not goes
  from (select r.source, l.k, l.p, l.long, r.one, r.two, r.long1, l.long and (l.p = r.one or (coalesce(l.p = r.two, false) and r.long1)) as goes from r join l on l.source = r.source and l.k = r.k + 1) l)
select source, cast(k as int) as k, kept from r""")
def q40_dup_filter(spark, d):
    rows = transcript(spark, d).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("xs"))
    kept = segments.drop_repeats(F.flatten(F.transform("xs", lambda x: F.array(x["text"], x["text"]))))
    return rows.select("source", F.posexplode(kept).alias("k", "kept"))


@query("""with t as (select event_id, user_id, epoch_us(ts) / 1e6 as s, epoch_us(ts) / 1e6 + 3600.0 as e from events where event_type = 'purchase'), p as (select user_id, epoch_us(ts) / 1e6 as at from events)
select event_id, count(*) as n from t join p on p.user_id = t.user_id and p.at >= t.s and p.at < t.e + 0.5 group by event_id""")
def q41_interval_contain(spark, d):
    events = table(spark, d, "events").withColumn("at", seconds())
    turns = events.filter("event_type = 'purchase'").select("event_id", "user_id", F.col("at").alias("start"), (F.col("at") + 3600.0).alias("end"))
    return segments.contained(turns, events.select("user_id", "at"), "user_id").groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


#: Segments: text, seconds, compression, and why they look invented.
SEGMENTS = (
    ("", 8.0, 1.5, "rỗng"), ("unk unk", 8.0, 1.5, "chữ rác"), ("một hai ba bốn năm", 0.2, 1.5, "tốc độ nói bất khả thi"), ("kho hàng còn thiếu hai người làm", 8.0, 3.0, "lặp chữ"),
    ("Hãy subscribe cho kênh Ghiền Mì Gõ", 8.0, 1.5, "câu bịa kiểu YouTube"), ("deadline, project, meeting, slide, file", 8.0, 1.5, "đọc lại từ khóa gợi ý"),
    ("có dùng một số từ tiếng Anh", 8.0, 1.5, "đọc lại câu mở đầu"), ("Hương gửi hợp đồng cho khách.", 8.0, 1.5, None), ("Kho hàng còn thiếu hai người.", 8.0, 1.5, None),
)


def heard(spark, d):
    """(source, pos, s): a segment for each turn."""
    rows = spoken(spark, d, [t for t, *_ in SEGMENTS])
    of = lambda j: F.element_at(F.array(*[F.lit(x[j]) for x in SEGMENTS]), F.col("k") + 1)
    fields = F.lit(0.0).alias("start"), of(1).alias("end"), F.col("texts")[0].alias("text"), F.lit(-0.3).alias("avg_logprob"), F.lit(0.1).alias("no_speech_prob"), of(2).alias("compression_ratio")
    return rows.select(F.col("conv_id").cast("string").alias("source"), F.col("turn").cast("int").alias("pos"), F.struct(*fields).alias("s"))


HEARD = f"{spoken_sql(SEGMENTS)}, heard as (select cast(conv_id as varchar) as source, cast(turn as int) as pos, t.text, reason from (select conv_id, turn, k from spoken) join (values {_cases([[(x[0], x[3])] for x in SEGMENTS])}) t(k, text, reason) using (k))"


@query(f"with {HEARD} select source, pos, reason from heard")
def q42_hallucination_reason(spark, d):
    return heard(spark, d).select("source", "pos", sp.reject_reason(F.col("s"), ratio=F.col("s.compression_ratio")).alias("reason"))


# ---- samples and percentiles -----------------------------------------------------------------


@query("select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by doc_id) as r from documents) where r <= 20")
def q43_stratified_sample(spark, d):
    return sampling.quota(table(spark, d, "documents").select("doc_id", "lang"), "lang", ["doc_id"], 20)


@query(f"""with recursive pool as materialized (select doc_id, coalesce(lang, '') as g, coalesce(source, '') as s from (select *, row_number() over (partition by lang, source order by doc_id) as r from documents where len({SPACED}) >= 3) where r <= 8),
steps as materialized (select row_number() over (order by pass, doc_id) as k, doc_id, g, s, cap from pool, (values (1, 25), (2, 100)) p(pass, cap)),
f as (select 0::bigint as k, 0 as total, map([]::varchar[], []::int[]) as gs, map([]::varchar[], []::int[]) as ss, []::bigint[] as chosen union all
  select k, total + ok, case when ok = 1 then map_concat(gs, map([g], [coalesce(gs[g], 0) + 1])) else gs end, case when ok = 1 then map_concat(ss, map([s], [coalesce(ss[s], 0) + 1])) else ss end,
    case when ok = 1 then list_append(chosen, doc_id) else chosen end
  from (select t.k, t.doc_id, t.g, t.s, f.total, f.gs, f.ss, f.chosen, case when f.total < 100 and coalesce(f.gs[t.g], 0) < t.cap and coalesce(f.ss[t.s], 0) < 8 and not list_contains(f.chosen, t.doc_id) then 1 else 0 end as ok
    from f join steps t on t.k = f.k + 1 where f.total < 100) u),
last as (select chosen from f order by k desc limit 1)
select c.doc_id as row_idx, lang as nhom, source as nguon, cast(pick as int) as pick from (select unnest(chosen) as doc_id, unnest(range(len(chosen))) as pick from last) c join documents d on d.doc_id = c.doc_id""")
def q44_two_quota_sample(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.col("doc_id").alias("row_idx"), "text", F.col("lang").alias("nhom"), F.col("source").alias("nguon"))
    return sampling.two_quotas(rows, 100, 4, 8).select("row_idx", "nhom", "nguon", "pick")


@query("""select lang, list_sort(list(n_chars))[cast(least(count(*) - 1, floor(0.5 * count(*))) as bigint) + 1] as p50, list_sort(list(n_chars))[cast(least(count(*) - 1, floor(0.95 * count(*))) as bigint) + 1] as p95,
list_sort(list(n_chars))[cast(least(count(*) - 1, floor(0.99 * count(*))) as bigint) + 1] as p99, max(n_chars) as top, list_sort(list(n_chars))[count(*) // 2 + 1] as upper_median from documents group by lang""")
def q45_percentile_nearest(spark, d):
    rows = table(spark, d, "documents").select("lang", "n_chars")
    places = {f"p{int(p * 100)}": evaluate.nearest_rank(p) for p in (0.5, 0.95, 0.99)}
    return evaluate.order_statistics(rows, "lang", "n_chars", **places, top=F.col("n") - 1, upper_median=evaluate.upper_median())


SETTINGS = ((8.0, 10.0), (10.0, 10.0), (12.0, 20.0), (15.0, 20.0), (15.0, 30.0), (20.0, 30.0), (25.0, 30.0))


@query(rf"""with r as (select n_chars / 100.0 as seconds, len({SPACED}) as tokens from documents), s as (select * from (values {", ".join(f"({a}::double, {b}::double)" for a, b in SETTINGS)}) t(a, b)),
l as (select a, b, tokens, cast(floor(least(a * seconds + b, 380)) as bigint) as lim from r, s)
select a, b, count(*) filter (where tokens > lim) as "over", round(sum(lim) / sum(tokens), 9) as ratio from l group by a, b""")
def q46_what_if_limits(spark, d):
    rows = table(spark, d, "documents").select((F.col("n_chars") / 100.0).alias("seconds"), F.size(spaced(F.col("text"))).alias("tokens"))
    return evaluate.what_if(rows, list(SETTINGS)).withColumn("ratio", F.round("ratio", 9))


@query(r"""select lower(regexp_replace(regexp_replace(url, '^.*/', ''), '\.[^.]*$', '')) as stem, count(*) as n from pages group by 1 having count(*) > 1""")
def q47_dup_stems(spark, d):
    return io.colliding_stems(table(spark, d, "pages").select(F.col("url").alias("path")))


@query("""with t as (select cast(conv_id as varchar) as source, first(text order by turn) as summary, string_agg(case when turn < 2 then '- ' || text end, chr(10) order by turn) as dec,
string_agg(case when role = 'user' then '| ' || text || ' | ' || role || ' | Chưa rõ |' end, chr(10) order by turn) as tasks from conversations group by conv_id)
select source, '# Tóm tắt cuộc họp: ' || source || chr(10) || chr(10) || '## Nội dung chính' || chr(10) || chr(10) || trim(summary) || chr(10) || chr(10) || '## Quyết định' || chr(10) || coalesce(dec, 'Không có')
|| chr(10) || chr(10) || '## Việc cần làm' || chr(10) || coalesce('| Việc | Người phụ trách | Hạn chót |' || chr(10) || '|---|---|---|' || chr(10) || tasks, 'Không có')
|| chr(10) || chr(10) || '## Cuộc họp tiếp theo' || chr(10) || 'Không có' || chr(10) as markdown from t""")
def q48_markdown(spark, d):
    rows = transcript(spark, d).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "speaker"))).alias("xs"))
    made = rows.select(
        "source",
        F.col("xs")[0]["text"].alias("summary"),
        F.transform(F.filter("xs", lambda x: x["pos"] < 2), lambda x: F.struct(x["text"].alias("text"), F.lit(0.0).alias("start"))).alias("decisions"),
        F.transform(F.filter("xs", lambda x: x["speaker"] == "user"), lambda x: F.struct(x["text"].alias("task"), x["speaker"].alias("owner"), F.lit(None).cast("string").alias("deadline"))).alias("tasks"),
        F.lit(None).cast("struct<time:string,place:string,start:double>").alias("next_meeting"),
    )
    return meetings.markdown(made)


@query(r"""with t as (select cast(conv_id as varchar) as source, cast(turn as int) as pos, text as task, role as deadline from conversations),
n as (select *, trim(regexp_replace(lower(task), '\s+', ' ', 'g')) as x, trim(regexp_replace(lower(deadline), '\s+', ' ', 'g')) as h, trim(task) as raw from t)
select source, pos, list_filter([case when left(raw, 1) in ('.', ',', ';', ':') or right(raw, 1) in ('.', ',', ';', ':') then 'stray punctuation at an end' end,
case when contains(raw, '.,') or contains(raw, ',.') then 'stray punctuation inside' end, case when h <> '' and contains(x, h) then 'repeats its deadline' end], lambda f: f is not null) as faults
from n where len(faults) > 0""")
def q49_invariants(spark, d):
    rows = transcript(spark, d).select("source", "pos", F.col("text").alias("task"), F.col("speaker").alias("deadline"))
    return meetings.invariant_faults(rows).select("source", "pos", "faults")


def _three_sql(n: str) -> str:
    """A group of three digits in words, by its digits."""
    h, t, o = f"{n} // 100", f"({n} // 10) % 10", f"{n} % 10"
    digit = lambda x: f"[{', '.join(repr(w) for w in wer.DIGITS)}][({x}) + 1]"
    tens = f"case when {t} = 0 and {o} = 0 then '' when {t} = 0 then ' linh' when {t} = 1 then ' mười' else ' ' || {digit(t)} || ' mươi' end"
    ones = f"case when {o} = 0 then '' when {o} = 1 and {t} > 1 then ' mốt' when {o} = 5 and {t} > 0 then ' lăm' else ' ' || {digit(o)} end"
    return f"{digit(h)} || ' trăm' || {tens} || {ones}"


@query(f"""with a as (select distinct cast(l_orderkey as varchar) as digits from lineitem), p as (select digits, lpad(digits, 12, '0') as s from a),
g as (select digits, list_transform(range(4), lambda i: cast(substr(s, cast(i * 3 + 1 as bigint), 3) as int)) as ns from p),
t as (select digits, list_filter(list_transform(list_zip(ns, ['tỷ', 'triệu', 'nghìn', '']), lambda z: case when z[1] > 0 then trim({_three_sql("z[1]")} || ' ' || z[2]) end), lambda x: x is not null) as said from g)
select digits, case when digits = '0' then 'không' else regexp_replace(array_to_string(said, ' '), '^không trăm (?:linh )?', '') end as words from t""")
def q50_number_words(spark, d):
    amounts = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("digits")).distinct()
    return amounts.select("digits", wer.number_words("digits").alias("words"))


@query()
def q51_eval_normalise(spark, d):
    return table(spark, d, "documents").select("doc_id", wer.normalised("text").alias("plain"), wer.normalised_for_scoring("text").alias("scoring"))


@query()
def q52_garbage_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", sp.without_garbage(F.col("text")).alias("text"))


@query(f"""with {SCORES}, w as (select unnest(range(n)) as p, n // 2 as half, n from scores where cfg = 'sub5'), q as (select *, case when p < half then 0 else half end as a, case when p < half then half else n end as b from w)
select case when p - a < 3 or b - p <= 3 then 'edge' else 'middle' end as place, count(*) as n, count(*) filter (where (p + 1) % 5 = 0) as errors, 0::bigint as deleted from q group by 1""")
def q53_position_class(spark, d):
    rows = scores(spark, d).filter("cfg = 'sub5'")
    half = F.floor(F.col("n") / 2).cast("int")
    return evaluate.by_position(rows, F.array(half, F.col("n") - half))


@query(f"""with {SCORES} select cast(sum(n) as bigint) as n, cast(sum(errors) as bigint) as before, cast(sum(case when ord % 2 = 0 then 0 else errors end) as bigint) as after,
count(*) filter (where ord % 2 = 0 and errors > 0) as improved, 0::bigint as worsened, count(*) filter (where ord % 2 <> 0 or errors = 0) as neutral from scores where cfg = 'sub5'""")
def q54_correction_effect(spark, d):
    rows = scores(spark, d).filter("cfg = 'sub5'")
    fixed = F.when(F.col("ord") % 2 == 0, F.col("text")).otherwise(F.col("du_doan"))
    after = wer.counts(F.col("text"), fixed)
    rows = rows.select("n", F.col("errors").alias("before"), after.alias("c"))
    return evaluate.correction_effect(rows.select("n", "before", F.expr("c.sub + c.del + c.ins").alias("after")))


@query(f"""with {HEARD} select source, coalesce(string_agg(case when reason is null then text end, ' ' order by pos), '') as text, coalesce(list(text order by pos) filter (where reason is not null), []) as rejected,
cast(count(*) as int) as n, cast(count(*) * 1.5 as double) as shifted from heard group by source""")
def q55_rescore_filter(spark, d):
    rows = heard(spark, d).groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("xs"))
    text, rejected = segments.rescore(F.col("xs"), "day_du")
    moved = segments.shift(F.col("xs"), 1.5)
    return rows.select("source", text.alias("text"), rejected.alias("rejected"), F.size("xs").alias("n"), F.aggregate(moved, F.lit(0.0), lambda a, x: a + x["start"]).alias("shifted"))


#: What is said at meetings of which ``flagship`` makes results.
SAID = (
    "Xin chào mọi người.", "Chị Lan sẽ gửi báo cáo trước thứ 6.", "Cả nhóm chốt dùng MySQL cho kho hàng từ tuần sau.", "Kết quả kiểm kê cho thấy kho hàng còn thiếu hai trăm đơn so với tháng trước.",
    "Bạn Hùng phụ trách phần đăng nhập.", "Nguyên nhân là máy quét ở cửa số ba hỏng suốt cả tuần vừa rồi.", "Ừm, mọi người thống nhất không dùng bản cũ nữa.", "Họp tiếp theo là tối chủ nhật lúc 9h.",
    "Doanh số trên shopping tăng gấp đôi trong đợt khuyến mãi của tháng bảy.", "Anh Tú sẽ viết tài liệu trước ngày 12 tháng 8.", "Vấn đề lớn nhất hiện nay là khách chờ quá lâu ở quầy thu ngân.",
    "Mục tiêu của quý này là giảm một nửa số đơn giao trễ.", "Ok, vậy thôi, cảm ơn mọi người.",
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each meeting: summary, decisions, tasks and next meeting of cleaned transcripts."""
    rows = spoken(spark, sf_dir, SAID).select(F.col("conv_id").cast("string").alias("source"), F.col("turn").cast("int").alias("pos"), F.lit("SPEAKER_00").alias("speaker"), (F.col("turn") * 4.0).alias("start"), (F.col("turn") * 4.0 + 3.0).alias("end"), F.col("texts")[0].alias("text"))
    cleaned = clean.clean_sentences(rows, VIETNAMESE)
    decided = meetings.decisions(cleaned)
    return meetings.results(cleaned, rank.summaries(cleaned, decided), decided)


@query()
def q56_meeting_results(spark, d):
    return flagship(spark, d)


# ---- reports ---------------------------------------------------------------------------------


@query(f"""with {SCORES}, g as (select nhom, sum(n) as n, sum(errors) as errors from scores where cfg = 'sub9' group by nhom)
select cast(row_number() over (order by errors / n desc, nhom) as int) as place, nhom, cast(n as bigint) as n, cast(errors as bigint) as errors from g""")
def q57_groups_by_rate(spark, d):
    t = reports.by_rate(evaluate.totals(scores(spark, d).filter("cfg = 'sub9'")))
    return t.select(F.row_number().over(Window.orderBy(F.desc("wer"), "nhom")).alias("place"), "nhom", "n", "errors")


@query(f"with {SCORES} select id, cast(errors as int) as del, cast(n as int) as n from scores where cfg = 'drop7' and n > 0 and conv_id in (select conv_id from conversations where contains(text, 'x')) order by errors / n desc, ord limit 15")
def q58_filtered_most(spark, d):
    cut = table(spark, d, "conversations").filter(F.contains("text", F.lit("x"))).select("conv_id").distinct().withColumn("bi_loai", F.array(F.lit("cut")))
    rows = scores(spark, d).filter("cfg = 'drop7'").join(cut, "conv_id")
    return reports.filtered_most(rows).select("id", "del", "n")


@query(f"""with {SCORES_GAPS}, parts as (select conv_id, count(*) as n_parts, count(h.id) as c, sum(h.n) as n_short, sum(h.errors) as errors_short, sum(len(s.ws)) as n
  from scores s left join (select id, n, errors from had where cfg = 'sub5') h using (id) where s.cfg = 'drop7' group by conv_id)
select conv_id as id, cast(n as bigint) as n, cast(n_parts as int) as n_parts, cast(n_short as bigint) as n_short, cast(errors_short as bigint) as errors_short from parts where c = n_parts""")
def q59_against_parts(spark, d):
    short = scores(spark, d, True).filter("cfg = 'sub5'").select("id", "n", "errors")
    long = scores(spark, d).filter("cfg = 'drop7'").groupBy(F.col("conv_id").alias("id")).agg(F.collect_list("id").alias("parts"), F.sum("n").alias("n"), F.sum("errors").alias("errors"))
    pairs, _ = reports.against_parts(long, short)
    return pairs.select("id", "n", "n_parts", "n_short", "errors_short")


@query("""with t as (select cast(conv_id as varchar) as source, string_agg(text, ' ' order by turn) as du_doan from conversations group by conv_id), r as (select cast(doc_id as varchar) as source, text from documents)
select coalesce(t.source, r.source) as source, case when r.source is null or r.text is null then 'no reference' when t.source is null then 'no transcript' else 'blank reference' end as reason
from t full join r using (source) where r.source is null or t.source is null or trim(coalesce(r.text, '')) = ''""")
def q60_with_reference(spark, d):
    refs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), "text")
    return reports.with_reference(transcript(spark, d), refs)[1]


@query("""with h as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as no, length(event_type) as words, event_type = 'purchase' as good from events)
select user_id, cast(coalesce(min(no) filter (where good and no > 0), max_by(no, {'w': words, 'n': -no})) as int) as no from h group by user_id""")
def q61_best_hearing(spark, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").select("user_id", (F.row_number().over(order) - 1).alias("no"), F.char_length("event_type").alias("words"), (F.col("event_type") == "purchase").alias("good"))
    return reports.best_hearing(rows, "user_id")


@query("""with t as (select event_id, user_id, epoch_us(ts) / 1e6 as s, epoch_us(ts) / 1e6 + 3600.0 as e, lag(epoch_us(ts) / 1e6) over w as lo, lead(epoch_us(ts) / 1e6 + 3600.0) over w as hi from events window w as (partition by user_id order by ts, event_id)),
o as (select *, coalesce(lo, s) as a, coalesce(hi, e) as b from t)
select event_id, case when b - a <= 86400.0 then a when b - s <= 86400.0 then s when e - a <= 86400.0 then a else s end as start, case when b - a <= 86400.0 then b when b - s <= 86400.0 then b else e end as "end" from o""")
def q62_retry_window(spark, d):
    rows = table(spark, d, "events").withColumn("s", seconds()).withColumn("e", seconds() + 3600.0)
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = rows.withColumn("lo", F.lag("s").over(order)).withColumn("hi", F.lead("e").over(order))
    return rows.select("event_id", reports.retry_window(F.col("lo"), F.col("s"), F.col("e"), F.col("hi"), 86400.0).alias("w")).select("event_id", "w.start", "w.end")


@query("""select l_orderkey, l_linenumber, list_filter([case when l_discount > 0.6 / 10 and l_tax - 0.75 < -0.7 then 'no speech' end, case when l_quantity / 10 > 2.4 then 'loop' end, case when l_linenumber > 3 then 'retried' end,
case when l_tax - 0.75 < -1.0 then 'unsure' end], lambda x: x is not null) as flags from lineitem""")
def q63_diagnostic_flags(spark, d):
    fields = (F.col("l_discount") * 10).alias("no_speech_prob"), (F.col("l_tax") - 0.75).alias("avg_logprob"), (F.col("l_quantity") / 10).alias("compression_ratio"), F.when(F.col("l_linenumber") > 3, 0.2).alias("temperature")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", reports.flags(F.struct(*fields)).alias("flags"))


@query("""select o_custkey as source, lower(o_orderpriority) as deadline, count(*) as tasks, count(distinct lower(o_orderstatus)) as owners from orders group by all having count(*) > 1""")
def q64_shared_deadlines(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderpriority").alias("deadline"), F.col("o_orderstatus").alias("owner"))
    return reports.shared_deadlines(rows)


@query(f"with {SCORES_GAPS}, common as (select id from had group by id having count(distinct cfg) = 3) select cfg, nhom, cast(grouping(nhom) as int) as is_total, cast(sum(n) as bigint) as n, cast(sum(errors) as bigint) as errors from had where id in (select id from common) group by grouping sets ((cfg), (cfg, nhom))")
def q65_comparison(spark, d):
    t = reports.comparison(scores(spark, d, True).select("cfg", "id", "nhom", "n", "errors"))
    return t.select("cfg", "nhom", F.col("is_total").cast("int").alias("is_total"), "n", "errors")


@query("""with recursive c as (select lang, doc_id, row_number() over (partition by lang order by doc_id) as r, coalesce(n_chars, 0) / 10.0 as s from documents),
f as (select lang, doc_id, r, s as length, 0 as file, 0 as no from c where r = 1 union all
  select c.lang, c.doc_id, c.r, case when f.length >= 3600 then c.s else f.length + c.s + case when f.length <> 0 then 0.5 else 0 end end, case when f.length >= 3600 then f.file + 1 else f.file end, case when f.length >= 3600 then 0 else f.no + 1 end
  from f join c on c.lang is not distinct from f.lang and c.r = f.r + 1)
select lang, cast(file as int) as file, cast(no as int) as no, doc_id as id from f""")
def q66_long_files(spark, d):
    clips = table(spark, d, "documents").select("lang", F.col("doc_id").alias("ord"), F.col("doc_id").alias("id"), (F.coalesce("n_chars", F.lit(0)) / 10.0).alias("do_dai"), F.lit(0.5).alias("silence"))
    return reports.long_files(clips, 3600.0, "lang")


@query(f"""with {SCORES}, t as (select nhom, grouping(nhom) as is_total, count(*) as segments, sum(n) as n, sum(errors) as sub from scores where cfg = 'sub5' group by grouping sets ((), (nhom)))
select case when is_total = 1 then 'total' else 'groups' end as section, cast(case when is_total = 1 then 0 else row_number() over (partition by is_total order by sub / n desc, nhom) - 1 end as int) as no,
printf('%s: %.1f %% of %d words (%d wrong, 0 missing, 0 more), %d segments', coalesce(nhom, 'all'), cast(sub * 100 / n as double), cast(n as bigint), cast(sub as bigint), segments) as line from t""")
def q67_report_totals(spark, d):
    return reports.report(scores(spark, d).filter("cfg = 'sub5'")).filter("section in ('total', 'groups')")


@query("""select 'pages' as bo, html as text, regexp_extract(url, '//([^/]*)', 1) as nhom, regexp_extract(url, '^([a-z]+):', 1) as nguon, page_id from pages where contains(url, '/en/') and trim(coalesce(html, '')) <> ''""")
def q68_data_set(spark, d):
    kind = reports.DataSet("pages", "html", "regexp_extract(url, '//([^/]*)', 1)", "regexp_extract(url, '^([a-z]+):', 1)", "contains(url, '/en/')")
    return kind.rows(table(spark, d, "pages")).select("bo", "text", "nhom", "nguon", "page_id")
