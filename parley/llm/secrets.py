"""Secret scan: exact base patterns plus character Markov models.

Two first-order character models are trained, one on random strings and one on
ordinary identifiers; a token is a secret when the mean log-likelihood ratio
of its character pairs is above a threshold.  Labelled samples: random strings
are digests in hex, base64 and alphanumeric form together with the values that
the base patterns find in the sampled documents; identifiers are the letter
runs that stand alone in the same documents, as they are and joined the way code joins them.  The
sample is bounded: SAMPLE_DOCS documents, chosen by a hash of their id.  The
models are two tables over pairs of ASCII characters, so their size is fixed.

Everything on the scan path is a built-in expression.  Positions are code
points; they come from the lengths of the parts between matches.

Defined results.  Null text counts as empty: no spans.  Repeated rows are
scanned alike.  Extra columns pass through ``scan``; one that bears the name
of the result column is replaced.  An empty table trains on digests alone and
gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, prefix_sums

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Every text with an assign span matches this; for the other two kinds a lower bound in the
#: pattern finds the same maximal runs as a filter on their lengths.
ASSIGN_GATE = ASSIGN.removesuffix("+)") + "{12})"
KINDS = ("assign", "access", "hex", "markov")
#: Candidates for the models: whole runs of token characters with a digit and a letter.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
SAMPLE_DOCS, DIGESTS = 2000, 2000
#: A candidate counts as random from the mean log-likelihood ratio per character pair that all but MISSED of the random
#: samples reach; at least LEAST and at most MOST (figures in the README).
MISSED, LEAST, MOST = 0.02, 0.7, 1.6
ALPHABET = 128


def spans(text: Column, pattern: str, kind: str, gate: Column, keep=None) -> Column:
    """array<struct<start,end,kind,value>> of the leftmost non-overlapping matches, in code points.

    ``keep``: a filter on the matched string, applied after matching.
    """
    kind_of = "array<struct<start:bigint,end:bigint,kind:string,value:string>>"

    def located(parts: Column) -> Column:
        return let(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
            lambda found: let(
                prefix_sums(F.zip_with(parts, found, lambda p, m: (F.char_length(p) + F.coalesce(F.char_length(m), F.lit(0))).cast("bigint"))),
                lambda offs: F.transform(
                    found,
                    lambda m, i: F.struct(
                        (F.element_at(offs, i + 1) + F.char_length(F.element_at(parts, i + 1))).alias("start"),
                        (F.element_at(offs, i + 1) + F.char_length(F.element_at(parts, i + 1)) + F.char_length(m)).alias("end"),
                        F.lit(kind).alias("kind"),
                        m.alias("value"),
                    ),
                ),
            ),
        )

    all_spans = let(F.split(text, pattern, -1), located).cast(kind_of)
    if keep is not None:
        all_spans = F.filter(all_spans, lambda s: keep(s["value"]))
    return F.when(gate, all_spans).otherwise(F.array().cast(kind_of))


def base_spans(text: Column) -> dict[str, Column]:
    value = lambda m: F.regexp_extract(m, ASSIGN, 2)
    return {
        "assign": spans(text, ASSIGN, "assign", text.rlike(ASSIGN_GATE), lambda m: F.char_length(value(m)) >= 12),
        "access": spans(text, ACCESS, "access", F.contains(text, F.lit("AKIA"))),
        "hex": spans(text, HEX, "hex", text.rlike(HEX)),
    }


def digests(spark: SparkSession, n: int) -> DataFrame:
    """(random) strings of the usual alphabets: hex in either case, base64, letters and digits."""
    raw = spark.range(n).select(F.sha2(F.concat(F.lit("parley"), F.col("id").cast("string")), 256).alias("h"))
    wide = F.base64(F.unhex("h"))
    return raw.select(F.explode(F.array(F.substring("h", 1, 40), F.upper(F.substring("h", 24, 40)), F.substring(wide, 1, 40), F.regexp_replace(wide, "[^A-Za-z0-9]", ""))).alias("s"))


def labelled_samples(docs: DataFrame, id_col: str, text_col: str, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(s, random): labelled strings from digests and from at most ``sample_docs`` documents."""
    spark = docs.sparkSession
    order = F.xxhash64(F.col(id_col).cast("string"))
    ids = [r[0] for r in docs.filter(F.col(id_col).isNotNull()).select(id_col).orderBy(order, id_col).limit(sample_docs).collect()]
    mine = docs.filter(F.col(id_col).isin(ids)) if ids else docs.filter(F.lit(False))
    mine = mine.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    found = base_spans(F.col("t"))
    secret = mine.select(F.explode(F.flatten(F.array(*[F.transform(found[k], lambda s: s["value"]) for k in ("assign", "access", "hex")]))).alias("m"))
    secret = secret.select(F.regexp_extract("m", r"[A-Za-z0-9+/_.=-]+$", 0).alias("s"))
    # words that stand alone: a random token's letters must not train the model of identifiers
    words = F.regexp_extract_all(F.col("t"), F.lit("(?<![^\\s(\"'])[A-Za-z]{3,}(?![^\\s.,;:!?)\"'])"), F.lit(0))
    snake = let(words, lambda w: F.transform(F.filter(w, lambda _, i: i % 3 == 0), lambda a, i: F.concat_ws("_", F.slice(w, i * 3 + 1, F.lit(3)))))
    camel = let(words, lambda w: F.transform(F.filter(w, lambda _, i: i % 3 == 0), lambda a, i: F.array_join(F.transform(F.slice(w, i * 3 + 1, F.lit(3)), lambda x: F.initcap(x)), "")))
    path = F.transform(snake, lambda x: F.translate(x, "_", "/"))
    numbered = let(words, lambda w: F.transform(F.filter(w, lambda _, i: i % 5 == 0), lambda a, i: F.concat(a, F.lit("-"), (i % 100).cast("string"))))
    plain = mine.select(F.explode(F.concat(words, snake, camel, path, numbered)).alias("s"))
    return (
        digests(spark, DIGESTS).unionByName(secret).select("s", F.lit(True).alias("random"))
        .unionByName(plain.select("s", F.lit(False).alias("random")))
    )


def codes(s: Column) -> Column:
    """Character codes, 0 for those outside ASCII."""
    return F.transform(F.split(s, ""), lambda c: F.when(F.ascii(c) < ALPHABET, F.ascii(c)).otherwise(F.lit(0)))


def train(samples: DataFrame) -> str:
    """JSON array of ALPHABET * ALPHABET log ratios log P_random(b|a) - log P_identifier(b|a), add-one-half smoothed.

    At most ALPHABET * ALPHABET * 2 counted rows reach the driver.
    """
    pairs = samples.filter(F.char_length("s") > 1).select("random", codes(F.col("s")).alias("c"))
    pairs = pairs.select("random", F.explode(F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: a * ALPHABET + b)).alias("pair"))
    import math

    seen: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for r in pairs.groupBy("random", "pair").count().collect():
        seen[r[0]][r[1]] = r[2]
    alphabet = 66
    table = [0.0] * (ALPHABET * ALPHABET)
    rows = {k: [0] * ALPHABET for k in seen}
    for k, counts in seen.items():
        for pair, n in counts.items():
            rows[k][pair // ALPHABET] += n
    for pair in range(ALPHABET * ALPHABET):
        p = {k: (counts.get(pair, 0) + 0.5) / (rows[k][pair // ALPHABET] + 0.5 * alphabet) for k, counts in seen.items()}
        table[pair] = round(math.log(p[True] / p[False]), 4)
    return json.dumps(table)


def calibrate(samples: DataFrame, model: str) -> float:
    """The threshold that the random ones of the bounded labelled samples set."""
    scores = samples.filter(F.col("random") & (F.char_length("s") >= 16)).select(score(F.col("s"), F.from_json(F.lit(model), "array<double>")).alias("x"))
    found = scores.agg(F.percentile("x", MISSED)).first()[0]
    return LEAST if found is None else min(max(found, LEAST), MOST)


def score(s: Column, model: Column) -> Column:
    """Mean log-likelihood ratio per character pair."""
    return let(
        codes(s),
        lambda c: F.aggregate(
            F.sequence(F.lit(1), F.size(c) - 1),
            F.lit(0.0),
            lambda acc, i: acc + F.coalesce(F.element_at(model, F.element_at(c, i) * ALPHABET + F.element_at(c, i + 1) + 1), F.lit(0.0)),
        )
        / (F.size(c) - 1),
    )


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float | None = None, sample_docs: int = SAMPLE_DOCS, out: str = "secrets") -> DataFrame:
    """``docs`` plus ``out``: array of struct(start, end, kind, value), by start and kind order; base kinds first.

    ``threshold``: of the mean log-likelihood ratio, ``calibrate``'s where not given.
    """
    samples = labelled_samples(docs, id_col, text_col, sample_docs)
    table = train(samples)
    threshold = calibrate(samples, table) if threshold is None else threshold
    model = F.from_json(F.lit(table), "array<double>")
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = base_spans(text)
    base = F.concat(found["assign"], found["access"], found["hex"])
    mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
    candidates = F.filter(spans(text, CANDIDATE, "markov", text.rlike(CANDIDATE)), mixed)
    rank = lambda k: F.array_position(F.array(*map(F.lit, KINDS)), k)

    def judged(base: Column) -> Column:
        free = F.filter(candidates, lambda c: ~F.exists(base, lambda b: (b["start"] <= c["start"]) & (c["end"] <= b["end"])))
        random = F.when(F.size(candidates) > 0, let(model, lambda m: F.filter(free, lambda c: score(c["value"], m) > threshold))).otherwise(free)
        keyed = F.transform(F.concat(base, random), lambda s: F.struct(s["start"], rank(s["kind"]).alias("rank"), s["end"], s["kind"], s["value"]))
        return F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"], s["end"], s["kind"], s["value"]))

    keep = [c for c in docs.columns if c != out]
    return docs.select(*keep, let(base, judged).alias(out))


def span_text(s: Column) -> Column:
    return F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))


def redact(docs: DataFrame, *, text_col: str = "text", mask: str = "[secret]", **options) -> DataFrame:
    """``docs`` with every span replaced by ``mask`` (overlapping spans by one); documents stay, columns unchanged.

    ``n_chars``, where documents have it, follows the new text.
    """
    found = scan(docs, text_col=text_col, out="__secrets", **options)
    text = F.col(text_col)

    def masked(s: Column) -> Column:
        # spans are sorted; a span is joined to those before it when it starts inside them
        merged = F.aggregate(
            s,
            F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts")),
            lambda a, x: F.when(x["end"] <= a["at"], a).otherwise(
                F.struct(
                    x["end"].alias("at"),
                    F.when(x["start"] < a["at"], a["parts"]).otherwise(
                        F.concat(a["parts"], F.array(F.substring(text, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.lit(mask)))
                    ).alias("parts"),
                )
            ),
            lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, (a["at"] + 1).cast("int"), F.lit(2**31 - 1))),
        )
        return merged

    clean = F.when(F.size("__secrets") > 0, masked(F.col("__secrets"))).otherwise(text)
    columns = [clean.alias(text_col) if c == text_col else F.col(c) for c in docs.columns]
    result = found.select(*columns)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        result = result.withColumn("n_chars", F.coalesce(F.char_length(text_col), F.col("n_chars")).cast(kind))
    return result
