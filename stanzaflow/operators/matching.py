"""Greedy lexicon matching: longest forms first, left to right, no character used twice.

Three plans for the same result. `fold` walks the ordered forms inside one expression: a narrow stage without a
shuffle, for lexicons of some hundred forms. `match_positions` runs an automaton over Arrow batches, a narrow stage as well, for
thousands of forms or where positions are wanted. Beyond what may be broadcast, `match_by_grams` joins the texts' n-grams with the forms by
equality. Substring semantics: a match may straddle what normalisation has removed.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from stanzaflow.functions.arrays import let
from stanzaflow.functions.numeric import ratio100
from stanzaflow.functions.text import IDEOGRAPHS, normalise
from stanzaflow.operators import automaton
from stanzaflow.operators.lexicon import Lexicon
from stanzaflow.sources.scratch import bounded_batches

#: Stands for used characters; must be outside the normalised alphabet.
USED = "#"
HITS = "array<struct<ord:int,entry_id:string,n:int>>"
#: Characters of a text that one row's n-grams begin in.
PIECE = 256
#: Columns that scoring adds.
SCORE = ["n_chars", *[f"{side}_{c}" for side in ("signal", "control") for c in ("weighted", "tokens", "entries", "density100")]]


def fold(text: Column, lexicon: Lexicon) -> Column:
    """Hits of normalised text by form, in form order."""
    ordered = [(o, f, e) for o, f, e in lexicon.ordered() if f]
    if not ordered:
        return F.array().cast(HITS)
    # What takes a form's place is of another length in bytes, so that the text's length tells how often it did.
    used = {f: USED * (2 if len(f.encode()) == 1 else 1) for _, f, _ in ordered}
    forms = F.array(*[
        F.struct(F.lit(o).alias("ord"), F.lit(f).alias("form"), F.lit(e.id).alias("entry_id"), F.lit(used[f]).alias("used"), F.lit(len(f.encode()) - len(used[f])).alias("less"))
        for o, f, e in ordered
    ])

    def step(acc: Column, f: Column) -> Column:
        def replaced(rest: Column) -> Column:
            n = F.call_function("div", F.octet_length(acc["rest"]) - F.octet_length(rest), f["less"]).cast("int")
            hit = F.struct(f["ord"].alias("ord"), f["entry_id"].alias("entry_id"), n.alias("n"))
            return F.struct(rest.alias("rest"), F.array_append(acc["hits"], hit).alias("hits"))

        found = let(F.replace(acc["rest"], f["form"], f["used"]), replaced)
        return F.when(F.contains(acc["rest"], f["form"]), found).otherwise(acc)

    start = F.struct(text.alias("rest"), F.array().cast(HITS).alias("hits"))
    return F.aggregate(forms, start, step, lambda acc: acc["hits"])


def entries_hit(hits: Column) -> Column:
    """Entry ids in first-hit order."""
    return F.array_distinct(F.transform(hits, lambda h: h["entry_id"]))


def counts(hits: Column) -> Column:
    """Tokens by entry."""
    return F.map_from_entries(
        F.transform(
            entries_hit(hits),
            lambda e: F.struct(e, F.aggregate(F.filter(hits, lambda h: h["entry_id"] == e), F.lit(0), lambda a, h: a + h["n"])),
        )
    )


def raw_tokens(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0), lambda a, h: a + h["n"])


def weighted_presence(hits: Column, lexicon: Lexicon, category: str | None = None) -> Column:
    """Specificities of the distinct entries hit, summed; of one category after shared matching, if named.

    They are added in the lexicon's order, whichever hit first, so that equal sets of entries have equal sums to the last bit.
    """
    weights = [(e.id, e.specificity) for e in lexicon.entries if category in (None, e.category)]
    if not weights:
        return F.lit(0.0)
    table = F.create_map(*[F.lit(x) for pair in weights for x in pair])
    found = F.array_intersect(F.array(*[F.lit(e) for e, _ in weights]), F.transform(hits, lambda h: h["entry_id"]))
    return F.aggregate(found, F.lit(0.0), lambda a, e: a + F.coalesce(F.try_element_at(table, e), F.lit(0.0)))


def detect(text: Column, lexicon: Lexicon, keep: str = IDEOGRAPHS) -> Column:
    """struct<n_chars, entries_hit, weighted_presence, raw_tokens> of one lexicon."""
    plain = normalise(text, keep)
    hits = fold(plain, lexicon)
    return F.struct(
        F.length(plain).alias("n_chars"), counts(hits).alias("entries_hit"),
        weighted_presence(hits, lexicon).alias("weighted_presence"), raw_tokens(hits).alias("raw_tokens"),
    )


def with_dual_score(
    df: DataFrame, text: str, signal: Lexicon, control: Lexicon, min_specificity: float = 0.0, exclude: Iterable[str] = (), keep: str = IDEOGRAPHS
) -> DataFrame:
    """df with n_chars and, for either lexicon, weighted, tokens, entries and density100 (SCORE).

    Columns of df with these names give way: a stored length, say, is recomputed.
    The lexicons match independently. Filters act on the signal alone; its density counts presence by weight,
    the control's counts tokens.
    """
    used = signal.keep(min_specificity, exclude)
    plain = df.withColumn("_plain", normalise(F.col(text), keep))
    plain = plain.withColumn("_s", fold(F.col("_plain"), used)).withColumn("_c", fold(F.col("_plain"), control))
    n = F.length("_plain")
    out = plain.select(
        *[c for c in df.columns if c not in SCORE], n.alias("n_chars"),
        weighted_presence(F.col("_s"), used).alias("signal_weighted"), raw_tokens(F.col("_s")).alias("signal_tokens"),
        entries_hit(F.col("_s")).alias("signal_entries"),
        weighted_presence(F.col("_c"), control).alias("control_weighted"), raw_tokens(F.col("_c")).alias("control_tokens"),
        entries_hit(F.col("_c")).alias("control_entries"),
    )
    return out.withColumn("signal_density100", ratio100(F.col("signal_weighted"), F.col("n_chars"))).withColumn(
        "control_density100", ratio100(F.col("control_tokens"), F.col("n_chars"))
    )


def joined_entries(hits: Column, separator: str = ";") -> Column:
    """Entry ids in first-hit order as one text."""
    return F.array_join(entries_hit(hits), separator)


def contains_count(text: Column, forms: Iterable[str]) -> Column:
    """How many of the forms a raw text contains: no normalisation, no consumption."""
    forms = list(forms)
    if not forms:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(f) for f in forms]), lambda f: F.contains(F.coalesce(text, F.lit("")), f)))


def match_by_grams(df: DataFrame, key: str, plain: str, forms: DataFrame) -> DataFrame:
    """key, ord, entry_id, pos (from 0) of accepted matches of normalised text with a form table, by an equi-join.

    A text's n-grams, one for each position and as long as the longest form, meet the forms by their first characters, as many as the least form
    has; what begins with the form is an occurrence. Forms that may be broadcast meet them where they are, so that only occurrences are shuffled. A fold
    over a text's sorted occurrences accepts those that touch no accepted one. A text's occurrences share a row: they are bounded by its length.
    """
    bounded_batches(df.sparkSession)
    forms = forms.filter("form_len > 0")
    least, most = forms.agg(F.min("form_len"), F.max("form_len")).first()
    if least is None:
        return df.select(key).limit(0).selectExpr(f"`{key}`", "0 AS ord", "'' AS entry_id", "0 AS pos")
    # Pieces first: taking a substring walks a text from its beginning, which would be quadratic in its length.
    begin = F.sequence(F.lit(0), F.greatest(F.length(plain) - 1, F.lit(0)), F.lit(PIECE))
    pieces = df.select(key, F.col(plain).alias("_text"), F.explode(begin).alias("begin"))
    pieces = pieces.select(key, "begin", F.substr("_text", F.col("begin") + 1, F.lit(PIECE + most - 1)).alias("piece"))
    starts = F.sequence(F.lit(1), F.greatest(F.least(F.length("piece"), F.lit(PIECE)), F.lit(1)))
    grams = pieces.select(key, "begin", "piece", F.explode(starts).alias("start"))
    grams = grams.select(key, (F.col("begin") + F.col("start") - 1).alias("pos"), F.substr("piece", F.col("start"), F.lit(most)).alias("gram"))
    heads = forms.select(F.substring("form", 1, least).alias("head"), "form", "ord", "form_len", "entry_id")
    heads = F.broadcast(heads) if automaton.fits(forms) else heads
    found = grams.withColumn("head", F.substring("gram", 1, least)).join(heads, "head").filter(F.startswith("gram", "form"))
    spans = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "pos", "form_len", "entry_id"))).alias("spans"))
    accepted = _accept(F.col("spans"))
    return spans.select(key, F.explode(accepted).alias("s")).select(key, "s.ord", "s.entry_id", "s.pos")


def match_positions(df: DataFrame, key: str, plain: str, forms: DataFrame) -> DataFrame:
    """key, ord, entry_id, pos of accepted matches: by an automaton in one narrow stage, or, where the forms are too many to broadcast, by an equi-join."""
    if not automaton.fits(forms):
        return match_by_grams(df, key, plain, forms)
    hits = automaton.with_hits(df.select(key, plain), plain, forms, "_hits")
    return hits.select(key, F.explode("_hits").alias("h")).select(key, "h.ord", "h.entry_id", "h.pos")


def convert_script(df: DataFrame, key: str, text: str, source: str, target: str, phrases: DataFrame) -> DataFrame:
    """key and text, converted: phrases (form, becomes), longest first and left to right, then characters from source to target.

    One narrow stage with an automaton of the phrases; where they are too many to broadcast, they meet the texts' n-grams by equality, and
    then key must name a row. Where a form repeats, the least replacement counts. Null texts stay null.
    """
    once = phrases.filter("form <> ''").groupBy("form").agg(F.min("becomes").alias("becomes"))
    if automaton.fits(once):
        longest = F.concat(F.lpad((F.lit(1 << 30) - F.length("form")).cast("string"), 10, "0"), "form")  # longer forms first
        return automaton.converted(df.select(key, text), text, source, target, once.withColumn("ord", longest))
    return _convert_by_grams(df, key, text, source, target, phrases)


def _convert_by_grams(df: DataFrame, key: str, text: str, source: str, target: str, phrases: DataFrame) -> DataFrame:
    once = phrases.groupBy("form").agg(F.min("becomes").alias("entry_id")).filter("form <> ''")
    forms = once.select(F.dense_rank().over(Window.orderBy(F.length("form").desc(), "form")).alias("ord"), "form", F.length("form").alias("form_len"), "entry_id")
    found = match_by_grams(df.select(key, text).filter(F.col(text).isNotNull()), key, text, forms).join(forms.select("ord", "form_len"), "ord")
    places = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "form_len", F.col("entry_id").alias("becomes")))).alias("_at"))
    joined = df.select(key, text).join(places, key, "left")

    def between(chars: Column, at: Column, end: Column) -> Column:
        return F.translate(F.array_join(F.slice(chars, at + 1, end - at), ""), source, target)

    def pieces(x: Column) -> Column:
        chars, spans = x["chars"], x["spans"]

        def piece(s: Column, i: Column) -> Column:
            last = F.get(spans, i - 1)
            return F.concat(between(chars, F.when(i > 0, last["pos"] + last["form_len"]).otherwise(0), s["pos"]), s["becomes"])

        end = F.element_at(spans, -1)
        return F.concat(F.array_join(F.transform(spans, piece), ""), between(chars, end["pos"] + end["form_len"], F.size(chars)))

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    with_phrases = let(F.struct(chars.alias("chars"), F.col("_at").alias("spans")), pieces)
    return joined.select(key, F.when(F.col("_at").isNull(), F.translate(text, source, target)).otherwise(with_phrases).alias(text))


def _accept(spans: Column) -> Column:
    """Of a text's occurrences in form order those that touch no accepted one, in time linear in their lengths."""

    @arrow_udf("array<struct<ord:int,pos:int,entry_id:string>>")
    def accept(texts: pa.Array) -> pa.Array:
        out = []
        for row in texts:
            found = row.as_py() or []
            used = bytearray(max((s["pos"] + s["form_len"] for s in found), default=0))
            kept = []
            for s in found:
                a, b = s["pos"], s["pos"] + s["form_len"]
                if not any(used[a:b]):
                    used[a:b] = b"\1" * (b - a)
                    kept.append({"ord": s["ord"], "pos": a, "entry_id": s["entry_id"]})
            out.append(kept)
        kind = pa.struct([("ord", pa.int32()), ("pos", pa.int32()), ("entry_id", pa.string())])
        return pa.array(out, pa.list_(kind))

    return accept(spans)

