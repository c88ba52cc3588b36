"""Operators without a row-by-row answer: against plain versions, identities and held-out figures."""

import math
import random
import string
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import kneser_ney, mixing, secrets, simhash, stupid_backoff, token_counts
from parley.llm.components import connected_components
from parley.llm.ngram_exchange import Chunk, pack, unpack, word_hash

from . import brute
from .docs import COLUMNS, frame, rows


def test_targets(spark):
    """Water level against the stated procedure: share, cap, reshare the excess until none is above."""
    sizes = {"a": 10, "b": 500, "c": 3, "d": 100, "é": 7, "B": 40, None: 25, "z": 0}
    got = mixing.targets(spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "source string, source_size bigint, n_docs bigint")).collect()
    order = sorted((k for k in sizes if k is not None), key=str) + [None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    target, open_, rest = {}, set(order), float(sum(sizes.values()))
    while True:
        share = {k: rest * weight[k] / sum(weight[x] for x in open_) for k in open_}
        over = {k for k in open_ if share[k] > 3 * sizes[k]}
        if not over:
            target |= share
            break
        for k in over:
            target[k] = 3.0 * sizes[k]
            rest -= target[k]
        open_ -= over
    for r in got:
        assert r.target == pytest.approx(target[r.source]), r
    assert sum(r.target for r in got) == pytest.approx(sum(sizes.values()))


def test_mix(spark):
    got = mixing.mix(frame(spark), block=16).collect()
    again = mixing.mix(frame(spark).repartition(3), block=16).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows())
    by = {}
    for r in got:
        assert r.size == len(brute.SPACE.findall(dict((x[0], x[1]) for x in rows())[r.doc_id] or "")) or r.doc_id is None
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.size * r.copies
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        assert own[0].source_size == sum(r.size for r in own)
    assert abs(sum(r.taken for r in got) - sum(r.size for r in got)) < max(r.size for r in got)


def test_mix_is_near_its_targets(spark):
    rnd = random.Random(3)
    data = [(i, f"s{i % 3 if i % 2 else 0}", "w " * rnd.randrange(5, 60)) for i in range(6000)]
    got = mixing.mix(spark.createDataFrame(data, "doc_id bigint, source string, text string"), block=256).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("want"), F.sum("copies").alias("c"), F.count("*").alias("n"), F.first("source_size").alias("s")).collect()
    for r in got:
        assert abs(r.t - r.want) < 60 and abs(r.c - r.n * r.want / r.s) < 8


def test_giants_leave_sources_near_their_targets(spark):
    """Sources of which a few documents hold most words: within one per cent of the target, unless nothing can come nearer."""
    rnd = random.Random(5)
    data = [(i, f"s{i % 6}", "w " * (rnd.randrange(3000, 6000) if i % 53 == 0 else rnd.randrange(5, 200))) for i in range(900)]
    got = mixing.mix(spark.createDataFrame(data, "doc_id bigint, source string, text string")).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("want")).collect()
    assert len(got) == 6 and all(abs(r.t - r.want) <= 0.01 * r.want for r in got)


def test_flight_keeps_its_sums():
    rnd = np.random.default_rng(1)
    size, p = rnd.integers(1, 90, 500).astype(float), np.full(500, 0.37)
    q = mixing.flight(size, p, rnd.random(501))
    assert ((q > 0) & (q < 1)).sum() <= 2 and q.sum() == pytest.approx(p.sum()) and q @ size == pytest.approx(p @ size)


def test_empty(spark):
    docs = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert mixing.mix(docs).count() == 0 and stupid_backoff.score(docs).count() == 0 and token_counts.count(docs).count() == 0
    assert kneser_ney.classify(docs, labels).count() == 0
    assert all(r.kept for r in kneser_ney.classify(frame(spark), labels).collect())


@pytest.mark.parametrize("block", [7, 64, 1 << 18])
def test_token_counts(spark, block):
    docs = frame(spark, [r for r in rows() if len(r[1] or "") < 5000])
    files = token_counts.write_files(docs, block=block)
    found = token_counts.ids(files, "bigint").join(token_counts.scan(files, group=4), ["file", "ordinal"])
    encode = token_counts.encoder(token_counts.vocabulary()).encode_ordinary
    want = sorted((str(r[0]), len(encode(r[1] or ""))) for r in rows() if len(r[1] or "") < 5000)
    assert sorted((str(r.doc_id), r.n_tokens) for r in found.collect()) == want
    # the files hold every text: an exact round trip
    streams = {}
    for r in sorted(files.filter("block is not null").collect(), key=lambda r: (r.file, r.block)):
        streams.setdefault(r.file, []).append(np.frombuffer(r.tokens, "<u2"))
    decode = token_counts.encoder(token_counts.vocabulary()).decode
    back = []
    for s in map(np.concatenate, streams.values()):
        back += [decode(x[x != token_counts.EOD].tolist()) for x in np.split(s, np.flatnonzero(s == token_counts.EOD) + 1)[:-1]]
    assert sorted(back) == sorted(r[1] or "" for r in rows() if len(r[1] or "") < 5000)


def backoff(texts):
    docs = [brute.ALNUM.findall(brute.lower(t)) for t in texts]
    grams = {n: [Counter(tuple(d[i : i + n]) for i in range(len(d) - n + 1)) for d in docs] for n in (1, 2, 3)}
    total = {n: sum(grams[n], Counter()) for n in grams}
    words = sum(map(len, docs))
    out = []
    for k, d in enumerate(docs):
        c = lambda g: total[len(g)][g] - grams[len(g)][k][g]  # noqa: B023, E731
        s = 0.0
        for i in range(len(d)):
            u, v, w = tuple(d[max(0, i - 2) : i + 1]), tuple(d[max(0, i - 1) : i + 1]), tuple(d[i : i + 1])
            if len(u) == 3 and c(u) > 0:
                s += math.log(c(u) / c(u[:2]))
            elif len(v) == 2 and c(v) > 0:
                s += math.log(0.4 * c(v) / c(v[:1]))
            else:
                s += math.log(0.16 * max(c(w), 1) / max(words - len(d), 1))
        out.append((len(d), s))
    return out


@pytest.mark.parametrize("shard_bytes", [5000, 1 << 24])
def test_backoff(spark, shard_bytes):
    data = rows()
    got = sorted(((str(r.doc_id), r.n_words, r.log_score) for r in stupid_backoff.score(frame(spark), shard_bytes=shard_bytes).collect()))
    want = sorted((str(r[0]), *s) for r, s in zip(data, backoff([r[1] for r in data]), strict=True))
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], rel=1e-9, abs=1e-9)


def test_packing():
    x = np.sort(np.random.default_rng(0).integers(0, 2**64, 1000, np.uint64))
    assert (unpack(pack(x)) == x).all() and len(unpack(pack(x[:0]))) == 0


def kneser(train):
    """Dictionary version of the trigram model: probability function."""
    tri = Counter()
    for t in train:
        d = [None, None, *brute.ALNUM.findall(brute.lower(t))]
        tri.update(zip(d, d[1:], d[2:], strict=False))
    bi = Counter((v, w) for _, v, w in tri)
    uni = Counter(w for _, w in bi)

    def level(counts):
        n = Counter(counts.values())
        d = kneser_ney.discounts(n[1], n[2], n[3], n[4])
        total, off = Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            off[g[:-1]] += d[min(c, 3) - 1]
        return d, total, off

    d1, _, _ = level({(w,): c for w, c in uni.items()})
    t1, off1 = sum(uni.values()), sum(d1[min(c, 3) - 1] for c in uni.values())
    d2, t2, o2 = level(bi)
    d3, t3, o3 = level(tri)

    def p(u, v, w):
        q = (max(uni[w] - d1[min(uni[w], 3) - 1], 0) / t1 if uni[w] else 0) + off1 / t1 / (2 * len(uni))
        if t2[(v,)]:
            q = (bi[(v, w)] - d2[min(bi[(v, w)], 3) - 1] if bi[(v, w)] else 0) / t2[(v,)] + o2[(v,)] / t2[(v,)] * q
        if t3[(u, v)]:
            q = (tri[(u, v, w)] - d3[min(tri[(u, v, w)], 3) - 1] if tri[(u, v, w)] else 0) / t3[(u, v)] + o3[(u, v)] / t3[(u, v)] * q
        return q

    return p, list(uni)


def test_kneser_ney(spark):
    rnd = random.Random(5)
    words = "a b c d e f g h".split()
    train = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 30))) for _ in range(40)]
    p, seen = kneser(train)
    assert sum(p("a", "b", w) for w in seen) + len(seen) * p("a", "b", "unseen") == pytest.approx(1)
    docs = spark.createDataFrame(list(enumerate(train)), "doc_id bigint, text string")
    model = kneser_ney.collect_model(kneser_ney.fit(docs))
    tests = ["a b c", "", None, "unseen words a b", "h", *train[:5]]
    got = kneser_ney.score(spark.createDataFrame(list(enumerate(tests)), "doc_id bigint, text string"), model, keep=["doc_id"]).orderBy("doc_id").collect()
    for r, t in zip(got, tests, strict=True):
        d = [None, None, *brute.ALNUM.findall(brute.lower(t))]
        if len(d) == 2:
            assert r.perplexity is None
            continue
        want = -sum(math.log(p(*x)) for x in zip(d, d[1:], d[2:], strict=False)) / (len(d) - 2)
        assert math.log(r.perplexity) == pytest.approx(want, rel=1e-4)


def test_kneser_ney_shards(spark):
    """Counts in many shards, with hot words dealt over several of them, give the probabilities of one; models of two folds stay apart."""
    rnd = random.Random(6)
    words = ["the", "of", *(f"w{i}" for i in range(30))]
    make = lambda: " ".join(rnd.choice(words[: rnd.choice((2, 32))]) for _ in range(rnd.randrange(1, 40)))
    train, tests = [(i, make(), i % 2) for i in range(60)], [(i, make() + " unseen", i % 2) for i in range(30)]
    columns = "doc_id bigint, text string, fold int"
    hot = {word_hash(b"the"): 5, word_hash(b"of"): 2}
    model = kneser_ney.collect_model(kneser_ney.fit(spark.createDataFrame(train, columns), fold_col="fold", shards=7, hot=hot))
    got = {r.doc_id: r.perplexity for r in kneser_ney.score(spark.createDataFrame(tests, columns), model, keep=["doc_id"], fold_col="fold").collect()}
    p = [kneser([t for _, t, f in train if f == fold])[0] for fold in (0, 1)]
    for i, t, f in tests:
        d = [None, None, *t.split()]
        want = -sum(math.log(p[f](*x)) for x in zip(d, d[1:], d[2:], strict=False)) / (len(d) - 2)
        assert math.log(got[i]) == pytest.approx(want, rel=1e-4)


def test_all_trusted_documents_train(spark):
    """Of many trusted documents each trains: words that one pair of them alone shares are known to both and to no threshold's surprise."""
    docs = [(i, " ".join(f"q{i // 2}x{j}" for j in range(20)), "en") for i in range(9000)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(9000)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.perplexity for r in kneser_ney.classify(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), labels).collect()}
    # a pair that is parted by the halves is known; that is every second one
    known = sum(got[i] < 100 and got[i + 1] < 100 for i in range(0, 9000, 2))
    assert len(got) == 9000 and 2000 < known < 2500


def test_parts_leave_no_exchanges(spark, monkeypatch):
    """When the counts or a part of the documents' perplexities are written, the exchanges that it took are no longer on disk."""
    manager, write, left = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), kneser_ney.materialize, []

    def shuffles():
        files = manager.getAllFiles()
        return {x for i in range(files.size()) if (x := files.apply(i).getName()).startswith("shuffle_") and x.endswith(".data")}

    def watched(df, tag):
        before, out = shuffles(), write(df, tag)
        if tag in ("counts", "perplexity"):
            for _ in range(50):  # they go within moments, though not at once
                if not (now := shuffles() - before):
                    break
                time.sleep(0.1)
            left.append(now)
        return out

    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(words[(i * j) % 40] for j in range(1, 60)), "en") for i in range(300)], "doc_id bigint, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id bigint, quality int, toxic int")
    whole = {r.doc_id: r.perplexity for r in kneser_ney.classify(docs, labels).collect()}
    monkeypatch.setattr(kneser_ney, "SLICED", 0)
    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", 10_000)
    monkeypatch.setattr(kneser_ney, "materialize", watched)
    got = {r.doc_id: r.perplexity for r in kneser_ney.classify(docs, labels).collect()}
    assert got == pytest.approx(whole, rel=1e-6) and len(got) == 300
    assert len(left) == 1 + kneser_ney.SLICES and not any(left), left


def test_classifier_tells_junk(spark):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    good = [(i, " ".join(words[(j * 7 + i) % 60] for j in range(rnd.randrange(30, 90))), "en") for i in range(400)]
    junk = [(1000 + i, " ".join("".join(rnd.choice("qxzjkv#") for _ in range(6)) for _ in range(40)), "en") for i in range(20)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.kept for r in kneser_ney.classify(spark.createDataFrame(good + junk, "doc_id bigint, text string, lang string"), labels).collect()}
    assert not any(got[i] for i, *_ in junk) and sum(got[i] for i, *_ in good) >= 390


def test_thresholds_cover_all_trusted_documents(spark):
    """A language of 1 % of the labels, but of over MIN_HELD documents, has its own bar."""
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(40)]
    rare = lambda i: i % 100 == 0
    docs = [(i, " ".join(f"{rnd.random()}" if rare(i) else rnd.choice(words) for _ in range(8)), "xx" if rare(i) else "en") for i in range(9000)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(9000)], "doc_id bigint, quality int, toxic int")
    got = kneser_ney.classify(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), labels, train_docs=40, quantile=0.5, margin=1.0).collect()
    bar = {r.lang: r.threshold for r in got}
    assert bar["xx"] > 2 * bar["en"]


def test_markov_model_held_out(spark):
    rnd = random.Random(2)
    prose = (
        "the quick response parser reads every header of a message and keeps the list of items in one batch with its maximum size while a "
        "worker gets tokens from the next queue and writes what the brown fox jumps over to the shared table of words and other things found"
    ).split()
    docs = spark.createDataFrame([(i, " ".join(rnd.choice(prose) for _ in range(200)), None, None, 0, None, None, None, None) for i in range(20)], COLUMNS)
    samples = secrets.labelled_samples(docs, "doc_id", "text", 50)
    table = secrets.train(samples)
    bar = secrets.calibrate(samples, table)
    model = F.from_json(F.lit(table), "array<double>")
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    random_ = ["".join(rnd.choice(alphabet) for _ in range(32)) for _ in range(200)]
    names = ["get_word_list_of_items", "parseResponseHeaders2", "the-quick-brown-fox-jumps", "max_tokens_per_batch_size", "thingWordListTau12345x"]
    judged = spark.createDataFrame([(s,) for s in random_ + names], "s string").select("s", secrets.score(F.col("s"), model).alias("x")).collect()
    hit = {r.s: r.x > bar for r in judged}
    assert sum(hit[s] for s in random_) >= 190 and sum(hit[s] for s in names) <= 1


def test_unkeyed_secrets_are_found(spark):
    """Random tokens without a key word before them, by the models alone; identifiers of the same texts are left alone."""
    rnd = random.Random(12)
    words = [a + b for a in ("tha", "ere", "ion", "ent", "ou", "bo", "mi", "sta") for b in ("nd", "st", "ly", "re", "wh", "nne", "to", "lia")]
    kinds = (string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "+/")
    secret = lambda i: "".join(rnd.choice(kinds[i % 3]) for _ in range(rnd.randrange(20, 44)))
    name = lambda i: rnd.choice("_-/").join(rnd.choice(words) for _ in range(5)) + str(rnd.randrange(100))
    text = lambda token: " ".join([*(rnd.choice(words) for _ in range(60)), token, *(rnd.choice(words) for _ in range(5))])
    planted = {i: secret(i) if i < 300 else name(i) for i in range(600)}
    got = secrets.scan(spark.createDataFrame([(i, text(t)) for i, t in planted.items()], "doc_id bigint, text string")).collect()
    found = {r.doc_id for r in got if any(s.kind == "markov" and s.value == planted[r.doc_id] for s in r.secrets)}
    assert sum(i < 300 for i in found) >= 280 and sum(i >= 300 for i in found) <= 6


def test_redact(spark):
    data = [(1, 'é token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end'), (2, None), (3, "plain words"), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in data], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r.text for r in secrets.redact(docs, sample_docs=5).collect()}
    assert got == {1: 'é [secret]" end', 2: None, 3: "plain words", 4: ""}


def test_redact_masks_a_token_around_a_base_span(spark):
    """A random token that contains a hex run is masked whole, not only its run."""
    rnd = random.Random(2)
    prose = "the quick response parser reads every header of a message and keeps the list of items in one batch".split()
    token = "Xk9Qz7LmP2vRgK5tW04dbebab91ab8568Tz5WqB3nYJ4hU8sQ1x"
    data = [(i, " ".join(rnd.choice(prose) for _ in range(200))) for i in range(20)] + [(99, f"see {token} there")]
    got = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame(data, "doc_id bigint, text string"), sample_docs=50).collect()}
    assert got[99] == "see [secret] there" and sum("[secret]" in t for t in got.values()) == 1


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2100)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_vantage_point_search_is_exact():
    rnd = np.random.default_rng(8)
    base = rnd.integers(0, 2**63, 400, np.uint64)
    near = [b ^ np.uint64(1 << int(rnd.integers(64))) ^ np.uint64(1 << int(rnd.integers(64))) for b in np.repeat(base[:150], 3)]
    values = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    tree = simhash.shard_tree(values[::3], 8)
    idx, shard, home = simhash.route(values, tree, 2)
    assert home.sum() == len(values)
    links = set()
    for s in np.unique(shard):
        mine = idx[shard == s]
        root = simhash.search_shard(values[mine], home[shard == s], 2, leaf=16)
        links |= {(int(mine[a]), int(mine[b])) for a, b in enumerate(root) if a != b}
    label = list(range(len(values)))
    for _ in range(len(values)):
        before = list(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    want = brute.components([int(v) for v in values], list(range(len(values))))
    assert label == want


def test_chunk_grams():
    chunk = Chunk([b"a b a", b"", b"A-b"])
    assert chunk.lengths.tolist() == [3, 0, 2] and len(chunk.grams(2)[0]) == 3 and len(set(chunk.grams(2)[0].tolist())) == 2
