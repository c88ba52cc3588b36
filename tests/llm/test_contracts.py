"""The contract queries' operators against plain Python, over the hard cases."""

import re

import pytest
from pyspark.sql import functions as F

from parley.llm import decontaminate, licenses, quality_rules, secrets, simhash, url_filters

from . import brute
from .docs import COLUMNS, frame, rows


def keyed(df, *cols):
    return sorted((tuple(r[c] for c in ("doc_id", *cols)) for r in df.collect()), key=repr)


def expected(f):
    return sorted(((r[0], *f(r[1])) for r in rows()), key=repr)


def test_licenses(spark):
    got = licenses.verdicts(licenses.scan(frame(spark).select("doc_id", "text"))).cache()
    assert keyed(got, "n_words", "n_base", "first_word", "last_word", "base_labels") == expected(brute.licenses)
    for r in got.collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert any("mpl-2" in r.labels for r in got.collect())


def test_license_suppression(spark):
    words = F.split(F.lit("licensed under the gnu general public license version 3 and cc by nc sa"), " ")
    kept = spark.range(1).select(licenses.resolve(licenses.detect(words, licenses.rules())).alias("d")).first().d
    assert [(d.start, d.end, d.label) for d in kept] == [(0, 9, "gpl-3"), (10, 14, "cc-by-nc-sa")]


def test_license_signatures(spark):
    """Every written signature is found in a text that holds it, and prose holds none."""
    lines = [x.split(" | ") for x in licenses.SIGNATURES.strip().splitlines()]
    plain = lambda t: re.sub(r"\[[0-9-]+\]\*?", "4", re.sub(r"\(\?:([^)|]*)[^)]*\)\?|[*?]", r"\1", t)).replace("..", "acme tools")
    data = [(i, f"Tools of acme. {plain(text)} And more.") for i, (_, text) in enumerate(lines)] + [(-1, "The quick brown fox reads a free book by the lake and pays for it.")]
    got = {r.doc_id: r.labels.split(",") for r in licenses.verdicts(licenses.scan(spark.createDataFrame(data, "doc_id bigint, text string"))).collect()}
    assert got[-1] == [""]
    empty = [(lines[i][1], got[i]) for i in range(len(lines)) if got[i] == [""]]
    assert not empty and sum(label.strip() in got[i] for i, (label, _) in enumerate(lines)) > 0.8 * len(lines)


def test_quality_counts(spark):
    got = frame(spark).select("doc_id", quality_rules.statistics(F.col("text")).alias("s")).select("doc_id", "s.*")
    assert keyed(got, *quality_rules.STATS) == expected(brute.quality)


def test_secrets(spark):
    got = secrets.scan(frame(spark).select("doc_id", "text"), sample_docs=20).withColumn("base", F.filter("secrets", lambda s: s["kind"] != "markov"))
    got = got.withColumn("spans", F.transform("base", secrets.span_text))
    want = sorted(((r[0], brute.secrets(r[1])[4]) for r in rows()), key=repr)
    assert keyed(got, "spans") == want


def test_simhash(spark):
    data = rows()
    got = keyed(simhash.link(frame(spark).select("doc_id", "text")), "fp", "component_id")
    fps = [brute.fingerprint(r[1]) for r in data]
    roots = brute.components(fps, [r[0] for r in data])
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    assert got == sorted(((r[0], f, c) for r, f, c in zip(data, signed, roots, strict=True)), key=repr)


@pytest.mark.parametrize("slots", [1, 10_000])
def test_decontamination(spark, slots):
    texts = [r[1] for r in rows()]
    long = texts[-9].split()
    items = [(1, " ".join(long[5:40])), (2, "one two"), (10, " ".join(long[100:113])), (10, "absent words only here"), (3, None), (4, " ... "), (None, texts[6]), (11, texts[6]), (12, "a b c")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.annotate(frame(spark), bench, keep=["doc_id"], block_bytes=200 if slots == 1 else 1 << 20)
    got = keyed(decontaminate.verdicts(found), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == expected(lambda t: brute.contamination(t, items))


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "gamma x beta y alpha"), (2, "alpha beta gamma"), (3, "alpha " + "x " * 50 + "beta gamma"), (4, "beta gamma")], "doc_id bigint, text string")
    got = decontaminate.annotate(docs, bench, proximity=6).select("doc_id", "contamination.items", "contamination.near_items")
    assert keyed(got, "items", "near_items") == [(1, [], ["1"]), (2, ["1"], []), (3, [], []), (4, [], [])]


def test_decontaminated_rows(spark):
    """A long document with one passage goes, whatever its share; short items have to make up a twentieth."""
    passage = " ".join(f"p{i}" for i in range(13))
    bench = spark.createDataFrame([(1, passage), (2, "two words")], "item_id bigint, text string")
    filler = " ".join(f"w{i}" for i in range(2000))
    data = [(1, f"{filler} {passage} {filler}"), (2, f"{filler} two words {filler}"), (3, "here are two words"), (4, filler), (4, passage), (None, None), (4, filler)]
    kept = decontaminate.decontaminate(spark.createDataFrame(data, "doc_id bigint, text string"), bench).collect()
    assert sorted((str(r.doc_id), (r.text or "")[:9]) for r in kept) == sorted([("2", data[1][1][:9]), ("4", filler[:9]), ("4", filler[:9]), ("None", "")])


URLS = [
    None, "", "no scheme", "http://a.net/x", "HTTP://A.B.NET/en/1?q=net/", "https://example.net/en/", "https://www.example.net/en/x#y", "https://notexample.net/en/x",
    "http://example.com/de/1", "http://example.com/DE/1", "http://m.example.com/de", "ftp://x.org/fr/z", "http://org/fr/", "http://net", "http://net/", "://net/", "http://a://b.net/",
    "http://x.com/spam-farm/1", "http://spam-farm.example.org/en/", "http://x.com/spamfarm", "http://é.net/ü", "http://a.net:80/", "http://a.net?x", "http://x.org/FR/", "a\nb://q.net/p",
]


def test_urls(spark):
    data = [(i, u) for i, u in enumerate(URLS)] + [(3, URLS[3]), (None, URLS[4])]
    got = url_filters.judge(spark.createDataFrame(data, "page_id bigint, url string")).collect()
    want = {}
    for i, u in data:
        want.setdefault(i, []).append(brute.url(u))
    assert len(got) == len(data)
    for r in got:
        host, path, rule, verdict = want[r.page_id][0]
        assert (r.host, r.path, r.rule) == (host, path, rule), r
        assert verdict is None or r.verdict == verdict
    own = {
        "http://ads7.shop.example.com/x": "block", "http://dev.to/x": "allow", "http://x.com/Login/": "block", "http://x.com/logins": "allow", "http://x.com/a/b.PDF": "allow", "http://x.com/a.Zip": "block",
        "http://x.com/cart": "block", "http://x.com/cartoon": "allow", "http://best-casino.x.com/": "block", "http://occasino.x.com/": "allow", "http://x.com/buy-essay/1": "block", "http://x.com/utm-feed": "block",
    }
    frame = spark.createDataFrame(list(enumerate(own)), "page_id bigint, url string")
    assert {r.page_id: r.verdict for r in url_filters.judge(frame).collect()} == dict(enumerate(own.values()))
    assert {r.page_id: r.verdict for r in got}[17] == "block" and {r.page_id: r.verdict for r in got}[19] == "allow"


def test_empty_tables(spark):
    docs = frame(spark, [])
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert licenses.scan(docs).count() == 0
    assert secrets.redact(docs).columns == docs.columns and secrets.scan(docs).count() == 0
    assert simhash.link(docs).count() == 0 and simhash.deduplicate(docs).columns == docs.columns
    assert decontaminate.decontaminate(docs, bench).count() == 0
    assert quality_rules.filter_rows(docs).columns == [c.split()[0] for c in COLUMNS.split(", ")]
    assert decontaminate.decontaminate(frame(spark), bench).count() == frame(spark).count()
    assert url_filters.judge(spark.createDataFrame([], "page_id bigint, url string")).count() == 0
