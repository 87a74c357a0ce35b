"""Operator 1, secret scans by character Markov models, in DataFrame functions alone.

Three patterns give base spans. The method adds tokens that look random: maximal runs of token characters,
of LEAST or more and with a digit among them, that touch no base span and whose first-order Markov
log-likelihood ratio of random strings against ordinary identifiers reaches BAR nats. Both models are counted
from labelled samples: the random ones are digests in the usual alphabets; the ordinary ones are all words of
all documents, as often as they occur, in the shapes of identifiers.

Positions come from splitting a text by the same pattern that finds the matches: a match starts after the
pieces and matches before it. Running sums go in blocks, characters are split off once and overlaps found by
bisection, so that the cost stays near linear in the lengths of texts and tokens and the number of matches.

Defined results: null text counts as empty and has no spans; texts and tokens of any length are scanned whole;
repeated rows are judged each; no rows give no rows, and models of no samples add no spans (the ratio is 0).
Offsets count code points. Being column expressions, detection touches no other column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stanzaflow.functions.arrays import let, running
from stanzaflow.llm.scratch import materialise
from stanzaflow.llm.spans import SPANS, digest_columns

BASE = ["assign", "access", "hex"]
ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: A run that is too short fails as a whole, so that the minimum can stand in the pattern.
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
LEAST, BAR = 20, 12.0
#: Random samples.
RANDOM = 4000
TOKEN = rf"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{{{LEAST},}}+"
_CODES = 128


def found(text: Column, pattern: str, group: int, rank: int, kind: str, least: int = 0) -> Column:
    """Spans of a pattern's matches whose group has at least `least` characters, in order, each with its match as `token`."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    pieces = F.split(text, pattern, -1)
    parts = F.arrays_zip(F.transform(pieces, F.length).alias("gap"), matches.alias("token"), F.transform(groups, F.length).alias("inner"))

    def spans(parts: Column) -> Column:
        # The last piece has no match after it.
        ends = running(F.transform(parts, lambda p: (p["gap"] + F.coalesce(F.length(p["token"]), F.lit(0))).cast("long")))

        def span(p: Column, end: Column) -> Column:
            return F.when(
                p["inner"] >= least,
                F.struct(
                    (end - F.length(p["token"])).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"),
                    F.lit(1.0).alias("score"), p["token"].alias("token"),
                ),
            )

        return F.filter(F.zip_with(parts, ends, span), lambda s: s.isNotNull())

    none = F.array().cast(SPANS.replace("score:double", "score:double,token:string"))
    return F.coalesce(F.when(text.rlike(pattern), let(parts, spans)), none)


def base_spans(text: Column) -> list[Column]:
    """The three kinds of base spans of a text column, each in order."""
    return [found(text, ASSIGN, 2, 0, "assign", 12), found(text, ACCESS, 0, 1, "access"), found(text, HEX, 0, 2, "hex")]


def random_samples(spark: SparkSession, n: int = RANDOM) -> DataFrame:
    """sample, random=true, n=1: digests of n numbers as hexadecimal, base64, and capitals with digits."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    text = F.when(F.col("id") % 3 == 0, F.substring(digest, 1, 40))
    text = text.when(F.col("id") % 3 == 1, F.rtrim(F.base64(F.unhex(F.substring(digest, 1, 60)))))
    text = text.otherwise(F.upper(F.substring(F.translate(F.base64(F.unhex(digest)), "+/=", "XYZ"), 1, 32)))
    return spark.range(n).select(text.alias("sample"), F.lit(True).alias("random"), F.lit(1).cast("long").alias("n"))


def ordinary_samples(documents: DataFrame, text: str) -> DataFrame:
    """sample, random=false, n: every word of all documents in five shapes of identifiers, and how often it occurs."""
    words = documents.select(F.explode(F.regexp_extract_all(text, F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("w"))
    words = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    year = (1990 + F.pmod(F.xxhash64("w"), F.lit(50))).cast("string")
    shapes = F.array("w", F.concat_ws("_", "w", "w"), F.concat("w", F.initcap("w")), F.concat_ws("-", "w", year), F.concat_ws("/", "w", "w"))
    return words.select(F.explode(shapes).alias("sample"), F.lit(False).alias("random"), "n")


def _codes(text: Column) -> Column:
    """The codes of a text's characters."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


def _pairs(text: Column) -> Column:
    """_CODES times a code plus the next one's, for each character; null for the last."""
    return let(_codes(text), lambda codes: F.transform(codes, lambda c, i: c * _CODES + F.get(codes, i + 1)))


def train(samples: DataFrame, smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratios of all transitions, random against ordinary, from samples (sample, random, n).

    Place 128 a + b of the result holds the ratio for code b after code a; other characters have none.
    """
    text = F.regexp_replace("sample", "[^\\x00-\\x7F]", "")
    pairs = samples.select("random", "n", F.explode(_pairs(text)).alias("pair")).filter("pair IS NOT NULL")
    counted = pairs.groupBy("pair").agg(
        F.sum(F.when(F.col("random"), F.col("n")).otherwise(0)).alias("r"), F.sum(F.when(F.col("random"), 0).otherwise(F.col("n"))).alias("o")
    )
    counted = materialise(counted.withColumn("first", F.floor(F.col("pair") / _CODES)))
    # 64 symbols may follow any: smoothing spreads over them. Unseen pairs are smoothed as well.
    totals = counted.groupBy("first").agg(F.sum("r").alias("all_r"), F.sum("o").alias("all_o"))
    grid = totals.withColumn("next", F.explode(F.sequence(F.lit(0), F.lit(_CODES - 1))))
    grid = grid.withColumn("pair", F.col("first") * _CODES + F.col("next")).join(counted.drop("first"), "pair", "left")

    def logp(c: str) -> Column:
        return F.log((F.coalesce(c, F.lit(0)) + smooth) / (F.col(f"all_{c}") + 64 * smooth))

    table = [0.0] * _CODES**2
    for x in grid.select("pair", F.round(logp("r") - logp("o"), 4).alias("ratio")).collect():  # 128^2 rows at most
        table[x.pair] = x.ratio
    return table


def ratio(token: Column, table: list[float]) -> Column:
    """The log-likelihood ratio of a token: the sum over its transitions."""
    # One text literal that folds to an array, instead of 128^2 literals.
    values = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")
    return F.aggregate(_pairs(token), F.lit(0.0), lambda total, pair: total + F.coalesce(F.get(values, pair), F.lit(0.0)))


def _touches(span: Column, others: Column) -> Column:
    """Whether a span overlaps one of others, which are in order and apart: the first that ends after its start is looked at."""
    state = "struct<low:int,high:int>"

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        ended = F.get(others, middle)["end"] <= span["start"]
        nearer = F.when(ended, F.struct((middle + 1).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), middle.alias("high")))
        return F.when(s["low"] < s["high"], nearer).otherwise(s).cast(state)

    start = F.struct(F.lit(0).alias("low"), F.size(others).alias("high")).cast(state)
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(others) + 1)).cast("int"))
    return F.coalesce(F.get(others, F.aggregate(steps, start, halve, lambda s: s["low"]))["start"] < span["end"], F.lit(False))


def secret_spans(text: Column, table: list[float], bar: float = BAR) -> Column:
    """All spans of a text column: the base spans, and random-looking tokens that touch none of them."""
    text = F.coalesce(text, F.lit(""))

    def plain(s: Column, score: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), score.alias("score"))

    scored = F.transform(found(text, TOKEN, 0, len(BASE), "markov"), lambda s: plain(s, ratio(s["token"], table)))
    random = F.filter(scored, lambda s: s["score"] >= bar)

    def together(all_: Column) -> Column:
        kinds = [all_[kind] for kind in BASE]
        base = F.concat(*[F.transform(k, lambda s: plain(s, s["score"])) for k in kinds])
        touched = lambda s: _touches(s, kinds[0]) | _touches(s, kinds[1]) | _touches(s, kinds[2])
        return F.concat(base, F.filter(all_["random"], lambda s: ~touched(s)))

    return let(F.struct(*[x.alias(k) for k, x in zip(BASE, base_spans(text), strict=True)], random.alias("random")), together)


def op1(documents: DataFrame) -> DataFrame:
    """Counts and digests of secrets for each document."""
    samples = random_samples(documents.sparkSession).unionByName(ordinary_samples(documents, "text"))
    spans = documents.select("doc_id", secret_spans(F.col("text"), train(samples)).alias("found"))
    return spans.select("doc_id", *digest_columns(F.col("found"), BASE))
