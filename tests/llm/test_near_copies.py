"""Near copies against all pairs compared in plain Python."""

import random

from parley.llm import near_copies, simhash

COLUMNS = "doc_id bigint, text string, lang string"


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def roots(texts):
    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


def corpus():
    """Texts with copies on both sides of the bar, of many lengths, and one passage in most of them."""
    rnd = random.Random(7)
    make = lambda n: [f"w{rnd.randrange(4000)}" for _ in range(n)]
    passage, out = make(12), []
    for k in range(60):
        base = make(rnd.randrange(6, 400)) + passage * (k % 3 > 0)
        out.append(" ".join(base))
        for share in (0.005, 0.015, 0.021, 0.024, 0.03):
            copy = list(base)
            for at in rnd.sample(range(len(copy)), round(len(copy) * share) or k % 2):
                copy[at] = f"x{rnd.randrange(10**6)}"
            out.append(" ".join(copy))
        out.append(" ".join(base[: len(base) * (78 + k % 5) // 100]))
    return [*out, None, "", "one two", "One  two", "one two three"]


def test_links_are_those_of_all_pairs(spark):
    texts = corpus()
    rows = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], COLUMNS)
    found = near_copies.components(rows, key=["doc_id"], keep=["lang"]).collect()
    want, by = roots(texts), {}
    for r in found:
        by.setdefault(r.root, set()).add(r.doc_id)
    expected = {}
    for i, r in enumerate(want):
        expected.setdefault(r, set()).add(i)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, expected.values()))
    kept = {r.doc_id for r in simhash.deduplicate(rows).collect()}
    assert kept == {min(x) for x in expected.values()}


def test_one_row_of_each_component(spark):
    """Ids that are null or repeat neither lose a text nor keep a copy."""
    rnd = random.Random(3)
    make = lambda: " ".join(f"w{rnd.randrange(4000)}" for _ in range(80))
    a, b, c, d, e = (make() for _ in range(5))
    data = [(None, a, "en"), (None, b, "fr"), (None, b, "fr"), (1, c, "en"), (1, d, "en"), (1, d, "en"), (None, c, "en"), (2, d, "en"), (None, e, None), (3, e, "en")]
    kept = simhash.deduplicate(spark.createDataFrame(data, COLUMNS)).collect()
    want = [(None, a, "en"), (None, b, "fr"), (1, c, "en"), (1, d, "en"), (3, e, "en")]
    assert sorted(map(tuple, kept), key=str) == sorted(want, key=str)


def test_repeated_ids_lose_no_text(spark):
    """(1, A), (5, A), (5, B): one A and B stay, twenty times over."""
    rnd = random.Random(9)
    make = lambda: " ".join(f"w{rnd.randrange(4000)}" for _ in range(60))
    data, texts = [], set()
    for k in range(20):
        a, b = make(), make()
        texts |= {a, b}
        data += [(10 * k + 1, a, "en"), (10 * k + 5, a, "en"), (10 * k + 5, b, "en")]
    kept = simhash.deduplicate(spark.createDataFrame(data, COLUMNS)).collect()
    assert sorted(r.text for r in kept) == sorted(texts)


def test_a_large_group_costs_its_size(spark):
    """Copies of one text, each with its own few changes: one component, and far fewer pairs than the square of the group."""
    rnd = random.Random(10)
    base = [f"w{rnd.randrange(4000)}" for _ in range(200)]
    data = []
    for i in range(400):
        copy = list(base)
        for at in rnd.sample(range(200), 2):
            copy[at] = f"x{rnd.randrange(10**6)}"
        data.append((i, " ".join(copy), "en"))
    rows = spark.createDataFrame(data, COLUMNS)
    described = near_copies.describe(rows, ["doc_id"], "text", 5)
    met = near_copies.shared_bands(described)
    assert near_copies.leaders(met).count() <= 400 * near_copies.BANDS
    assert [r.doc_id for r in simhash.deduplicate(rows).collect()] == [0]


def test_texts_that_are_alike_but_not_similar_make_no_rows(spark):
    """A large group below the bar, with a few similar pairs in it: all links are found, and the comparisons leave no more rows than links."""
    rnd = random.Random(12)
    base = [f"w{rnd.randrange(4000)}" for _ in range(300)]
    texts = []
    for _ in range(120):
        copy = list(base)
        for at in rnd.sample(range(300), 6):
            copy[at] = f"x{rnd.randrange(10**6)}"
        texts.append(copy)
    texts += [[*t[:-1], "end"] for t in texts[:5]]
    texts = [" ".join(t) for t in texts]
    rows = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], COLUMNS)
    described = near_copies.describe(rows, ["doc_id"], "text", 5)
    met, sketches = near_copies.shared_bands(described), described.select("node", "sketch")
    sets = near_copies.shingle_sets(rows, described.select("doc_id", "node"), ["doc_id"], "text", 5)
    links = near_copies.rest(met, spark.createDataFrame([], "node bigint, grp bigint"), sketches, sets).collect()
    want = roots(texts)
    name = dict(described.select("node", "doc_id").collect())
    found = list(range(len(texts)))
    for r in links:
        a, b = found[name[r.u]], found[name[r.v]]
        found = [min(a, b) if x in (a, b) else x for x in found]
    assert found == want and len(set(want)) > 20
    assert len(links) <= near_copies.BANDS * (len(texts) - len(set(want)))
