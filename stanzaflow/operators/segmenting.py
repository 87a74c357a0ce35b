"""Segmentation: positions of pattern matches, dated sections, quoted spans, verse runs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from stanzaflow.functions.arrays import let, running
from stanzaflow.functions.text import DIGITS, IDEOGRAPHS, LINE_IDEOGRAPHS, NUMERALS, count_in_set, kept_length, numeral_year
from stanzaflow.operators.scans import carried

#: Dating words and the years they stand for.
MARKERS = [
    ("鄭氏", 1665), ("延平", 1665), ("國姓", 1665), ("東寧", 1675), ("永曆", 1660), ("寧靖", 1680), ("克塽", 1683),
    ("康熙", 1700), ("雍正", 1730), ("乾隆", 1760), ("嘉慶", 1805), ("道光", 1835), ("咸豐", 1855), ("同治", 1868),
    ("光緒", 1888), ("甲午", 1894), ("乙未", 1896), ("割臺", 1896), ("割台", 1896), ("馬關", 1895), ("內渡", 1896),
    ("臺灣民主國", 1895), ("明治", 1900), ("大正", 1918), ("丙午", 1906), ("民國", 1916),
]
#: Clause ends; characters that speak of prose.
CLAUSE_ENDS = "[，。！？；、\n\r　]+"
PROSE = "矣也焉哉夫蓋故者歟耳乎兮乃皆是凡蒙據茲爰惟粵撰序跋誌纂輯"
#: The header of a dated section; group 1 the cyclic date, group 2 the year in numerals.
_CYCLE = "[甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥]"
_REIGN = "(?:光緒|光绪|宣統|宣统|同治|咸豐|咸丰|中華民國|中华民国|民國|民国)"
_NUMERAL = "[〇○零０Ｏ一二三四五六七八九]"
SECTION_HEADER = (
    rf"({_CYCLE}{_CYCLE}(?:[至、]{_CYCLE}{_CYCLE})?[^\n（(]{{0,8}})"
    rf"[（(][^）)]*?{_REIGN}[^）)]*?([一二三四五六七八九][八九]{_NUMERAL}{_NUMERAL})[^）)]*[）)]"
)
QUOTE = "『([^』]+)』"


def matches(text: Column, pattern: str, groups: tuple[int, ...] = (0,)) -> Column:
    """array<struct<start, end, g0, .., after>> of all matches: code points from 0, end exclusive; what stands between
    a match and the next one or the text's end.

    Spark has no match positions: the pieces between matches, from splitting by the same pattern, give them.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = [hits if g == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in groups]

    def placed(x: Column) -> Column:
        sizes = F.transform(x["pieces"], lambda p, i: (F.length(p) + F.coalesce(F.length(F.get(x["hits"], i)), F.lit(0))).cast("long"))

        def match(hit: Column, i: Column, ends: Column) -> Column:
            end = F.get(ends, i).cast("int")
            own = [F.get(x[f"g{g}"], i).alias(f"g{g}") for g in groups]
            return F.struct((end - F.length(hit)).alias("start"), end.alias("end"), *own, F.get(x["pieces"], i + 1).alias("after"))

        return let(running(sizes), lambda ends: F.transform(x["hits"], lambda hit, i: match(hit, i, ends)))

    parts = F.struct(F.split(text, pattern, -1).alias("pieces"), hits.alias("hits"), *[f.alias(f"g{g}") for g, f in zip(groups, found, strict=True)])
    return F.when(text.rlike(pattern), let(parts, placed))


def occurrences(df: DataFrame, key: list[str], text: str, pattern: str, groups: tuple[int, ...] = (0,)) -> DataFrame:
    """key, seq, start, end and g0, g1, .. of all matches, in one narrow stage; null texts have none."""
    rows = df.select(*key, F.posexplode(matches(F.col(text), pattern, groups)).alias("seq", "m"))
    return rows.select(*key, "seq", "m.start", "m.end", *[f"m.g{g}" for g in groups])


def dated_sections(
    pages: DataFrame, key: str, text: str, header: str = SECTION_HEADER, numerals: str = NUMERALS, digits: str = DIGITS
) -> DataFrame:
    """key, offset, year_raw, ganzhi, year, text: from a header's end to the next header or the text's end.

    A header whose year can't be read gives no section, but still ends the one before it. The body is the piece
    behind the header, so that a page is cut up where it stands.
    """
    heads = pages.select(key, F.explode(matches(F.col(text), header, (0, 1, 2))).alias("m"))
    out = heads.select(
        key, F.col("m.end").alias("offset"), F.trim("m.g0").alias("year_raw"), F.trim("m.g1").alias("ganzhi"),
        numeral_year(F.col("m.g2"), numerals, digits).alias("year"), F.col("m.after").alias("text"),
    )
    return out.filter("year IS NOT NULL")


def dated_within(pages: DataFrame, key: str, text: str, low: int = 1600, high: int = 1950, **header: str) -> DataFrame:
    """Dated sections of pages without their front matter; years outside low..high go after that cut, not before it."""
    return cut_front_matter(dated_sections(pages, key, text, **header), key).filter(F.col("year").between(low, high))


def cut_front_matter(sections: DataFrame, key: str) -> DataFrame:
    """Sections from the first one of a page's earliest year on."""
    page = Window.partitionBy(key)
    earliest = sections.withColumn("_least", F.min("year").over(page))
    begin = F.min(F.when(F.col("year") == F.col("_least"), F.col("offset"))).over(page)
    return earliest.withColumn("_begin", begin).filter("offset >= _begin").drop("_least", "_begin")


def quoted_spans(df: DataFrame, key: list[str], text: str, quote: str = QUOTE, keep: str = IDEOGRAPHS, least: int = 12) -> DataFrame:
    """key, offset (of the opening mark), text, n_chars of quotations with `least` kept characters."""
    spans = occurrences(df, key, text, quote, (1,))
    spans = spans.select(*key, F.col("start").alias("offset"), F.col("g1").alias("text"))
    return spans.withColumn("n_chars", kept_length(F.col("text"), keep)).filter(F.col("n_chars") >= least)


def marker_scan(df: DataFrame, key: list[str], text: str, markers: list[tuple[str, int]] = MARKERS) -> DataFrame:
    """key, pos, marker, year of all markers, those inside quotations too."""
    pattern = "|".join(re.escape(m) for m, _ in markers)
    hits = occurrences(df, key, text, pattern).select(*key, F.col("start").alias("pos"), F.col("g0").alias("marker"))
    years = F.create_map(*[F.lit(x) for m in dict(markers).items() for x in m])
    return hits.withColumn("year", years[F.col("marker")])


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], on: str, carry: list[str], cuts: int | None = None) -> DataFrame:
    """left with the carried columns of the last right row at or before it, null where there is none.

    One sort of both sides together instead of a range join, cut by position so that a key of any size is spread over
    tasks. A right row on a tie comes first; of several the greatest by the carried columns counts. A null key is a key; a null position
    comes before all others. Both sides are read three times, for bounds, summaries and rows: write out what is dear to make.
    """
    value = F.struct(*carry)
    shape = value.alias("_carried")
    rows = right.select(*by, on, shape, F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_row"))
    ours = left.select(*by, on, F.lit(None).cast(right.select(shape).schema[0].dataType).alias("_carried"), F.lit(1).alias("_side"), F.struct("*").alias("_row"))
    both = carried(ours.union(rows.select(ours.columns)), by, [on], "_carried", ["_side"], cuts)
    return both.filter("_side = 1").select("_row.*", *[F.col(f"_carried.{c}").alias(c) for c in carry])


def clauses(df: DataFrame, key: list[str], text: str, ends: str = CLAUSE_ENDS, keep: str = LINE_IDEOGRAPHS) -> DataFrame:
    """key, pos, clause, n: non-blank clauses in order with their kept lengths."""
    pieces = df.select(*key, F.posexplode(F.split(F.col(text), ends, -1)).alias("raw", "clause"))
    pieces = pieces.filter(F.col("clause").rlike(r"(?U)\S"))
    order = Window.partitionBy(*key).orderBy("raw")
    return pieces.select(*key, (F.row_number().over(order) - 1).alias("pos"), "clause", kept_length(F.col("clause"), keep).alias("n"))


def equal_runs(lines: DataFrame, key: list[str], lengths: tuple[int, ...] = (5, 7)) -> DataFrame:
    """key, start, n, lines, text: maximal runs of clauses of one length among those given."""
    by = Window.partitionBy(*key).orderBy("pos")
    changed = F.coalesce((F.lag("n").over(by) != F.col("n")).cast("int"), F.lit(1))
    marked = lines.withColumn("_new", changed).withColumn("_run", F.sum("_new").over(by))
    runs = marked.filter(F.col("n").isin(list(lengths))).groupBy(*key, "_run").agg(
        F.min("pos").alias("start"), F.first("n").alias("n"), F.count(F.lit(1)).alias("lines"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "clause"))), lambda s: s["clause"]), "").alias("text"),
    )
    return runs.drop("_run")


def verses(
    df: DataFrame, key: list[str], text: str, lengths: tuple[int, ...] = (5, 7), least: int = 4, most: int = 24,
    prose: str = PROSE, per_line: float = 0.2, ends: str = CLAUSE_ENDS, keep: str = LINE_IDEOGRAPHS,
) -> DataFrame:
    """Runs of `least` to `most` lines with few prose characters; a longer run is rejected whole."""
    runs = equal_runs(clauses(df, key, text, ends, keep), key, lengths).filter(F.col("lines").between(least, most))
    return runs.filter(prose_share(F.col("text"), F.col("lines"), prose) <= per_line)


def prose_share(text: Column, lines: Column, prose: str = PROSE) -> Column:
    """Prose characters by line."""
    return count_in_set(text, prose) / lines


def joined_passages(tree: DataFrame, key: list[str], order: str, text: str, separator: str = "\n") -> DataFrame:
    """key, text: passages in order."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return tree.groupBy(*key).agg(F.array_join(F.transform(parts, lambda p: p[text]), separator).alias(text))
