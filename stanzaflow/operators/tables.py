"""Table functions for SQL: SELECT * FROM dated_sections(TABLE(pages)).

Each takes a table with a text in every row, keeps the columns named in `key` (all but the text, if none are named) and
gives rows for what it finds there. A row is a whole page or volume, so that nothing is shuffled, carried from row to row
or held back: a function is one narrow stage with one scan of each text. The DataFrame functions of the same names stay
the way for tables whose volumes are spread over rows.

Defined results: a null or empty text gives no rows; a repeated row gives its rows twice; an unknown column, a constant
that is none, or a kept column with a name that the function gives itself, is an error when the query is analysed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby, pairwise

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, SelectedColumn

from stanzaflow.functions.text import DIGITS, IDEOGRAPHS, LINE_IDEOGRAPHS, NUMERALS
from stanzaflow.operators.segmenting import CLAUSE_ENDS, MARKERS, PROSE, QUOTE, SECTION_HEADER
from stanzaflow.sources.scratch import bounded_batches


@dataclass
class Scan(AnalyzeResult):
    """What the analysis of a call hands to its tasks."""

    key: list[str] = field(default_factory=list)
    text: str = "text"
    settings: dict = field(default_factory=dict)


def _columns(**types: str) -> StructType:
    """A schema, made without a session: the analysis runs in a process that has none."""
    out = StructType()
    for name, kind in types.items():
        out.add(name, kind)
    return out


def _analysis(own: StructType, **defaults):
    """The analysis of a function that gives the columns `own` and has these settings."""

    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument | None = None, text: AnalyzeArgument | None = None, **settings: AnalyzeArgument) -> Scan:
        if not rows.isTable:
            raise ValueError("the first argument is a table: TABLE(name)")
        given = {"key": key, "text": text, **settings}
        for name, a in given.items():
            if name not in ("key", "text", *defaults):
                raise ValueError(f"no setting is called {name}; there are key, text, {', '.join(defaults)}")
            if a is not None and not a.isConstantExpression:
                raise ValueError(f"{name} must be a constant")
        told = {name: a.value for name, a in given.items() if a is not None and a.value is not None}
        table = rows.dataType
        body = told.pop("text", "text")
        kept = list(told.pop("key", [f.name for f in table.fields if f.name != body]))
        for name in [*kept, body]:
            if name not in table.fieldNames():
                raise ValueError(f"the table has no column {name}; there are {', '.join(table.fieldNames())}")
        for name in kept:
            if name in own.fieldNames():
                raise ValueError(f"{name} is a column of the function's own; name the columns to keep by key => array(..)")
        schema = StructType([*[table[name] for name in kept], *own.fields])
        needed = [SelectedColumn("`" + name.replace("`", "``") + "`") for name in dict.fromkeys([*kept, body])]
        return Scan(schema=schema, select=needed, key=kept, text=body, settings={**defaults, **told})

    return staticmethod(analyze)


class _Function:
    def __init__(self, scan: Scan) -> None:
        self.key, self.text = scan.key, scan.text
        self.begin(**scan.settings)

    def eval(self, rows: Row, **_) -> Iterator[tuple]:
        """The rows of one text; the settings are those of the analysis."""
        text = rows[self.text]
        if text:
            kept = tuple(rows[k] for k in self.key)
            for found in self.scan(text):
                yield (*kept, *found)


class DatedSections(_Function):
    """offset, year_raw, ganzhi, year, text: operators.segmenting.dated_sections."""

    analyze = _analysis(
        _columns(offset="integer", year_raw="string", ganzhi="string", year="integer", text="string"),
        header=SECTION_HEADER, numerals=NUMERALS, digits=DIGITS,
    )

    def begin(self, header: str, numerals: str, digits: str) -> None:
        self.header, self.other = re.compile(header), re.compile(f"[^{numerals}]")
        self.digit = {ord(n): digits[i] if i < len(digits) else None for i, n in reversed(list(enumerate(numerals)))}

    def year(self, numeral: str) -> int | None:
        only = self.other.sub("", numeral).translate(self.digit)
        return int(only) if re.fullmatch("[0-9]{4}", only) else None

    def scan(self, text: str) -> Iterator[tuple]:
        for h, following in pairwise([*self.header.finditer(text), None]):
            end = following.start() if following else len(text)
            year = self.year(h[2] or "")
            if year is not None:
                yield h.end(), h[0].strip(" "), (h[1] or "").strip(" "), year, text[h.end() : end]


class DatedQuotes(_Function):
    """offset, text, n_chars, marker, year: quotations, each with the last dating word that begins at or before it."""

    analyze = _analysis(
        _columns(offset="integer", text="string", n_chars="integer", marker="string", year="integer"),
        quote=QUOTE, keep=IDEOGRAPHS, least=12, markers=[m for m, _ in MARKERS], years=[y for _, y in MARKERS],
    )

    def begin(self, quote: str, keep: str, least: int, markers: list[str], years: list[int]) -> None:
        self.quote, self.dropped, self.least = re.compile(quote), re.compile(f"[^{keep}]"), least
        self.years = dict(zip(markers, years, strict=True))
        self.marker = re.compile("|".join(map(re.escape, markers)) or "(?!)")

    def scan(self, text: str) -> Iterator[tuple]:
        marks, last = self.marker.finditer(text), None
        ahead = next(marks, None)
        for q in self.quote.finditer(text):
            while ahead and ahead.start() <= q.start():
                last, ahead = ahead[0], next(marks, None)
            n = len(self.dropped.sub("", q[1]))
            if n >= self.least:
                yield q.start(), q[1], n, last, self.years.get(last)


class Verses(_Function):
    """start, n, lines, text: operators.segmenting.verses."""

    analyze = _analysis(
        _columns(start="integer", n="integer", lines="long", text="string"),
        lengths=[5, 7], least=4, most=24, prose=PROSE, per_line=0.2, ends=CLAUSE_ENDS, keep=LINE_IDEOGRAPHS,
    )

    def begin(self, lengths: list[int], least: int, most: int, prose: str, per_line: float, ends: str, keep: str) -> None:
        self.lengths, self.least, self.most = set(lengths), least, most
        self.prose, self.per_line = set(prose), float(per_line)
        self.ends, self.dropped = re.compile(ends), re.compile(f"[^{keep}]")

    def scan(self, text: str) -> Iterator[tuple]:
        # Blank is what has only white space; the four separators at 1C to 1F aren't white space in Unicode.
        said = [c for c in self.ends.split(text) if re.search(r"[^\s]|[\x1c-\x1f]", c)]
        lines = [(pos, c, len(self.dropped.sub("", c))) for pos, c in enumerate(said)]
        for n, run in groupby(lines, key=lambda line: line[2]):
            if n not in self.lengths:
                continue
            run = list(run)
            if self.least <= len(run) <= self.most:
                whole = "".join(c for _, c, _ in run)
                if sum(c in self.prose for c in whole) / len(run) <= self.per_line:
                    yield run[0][0], n, len(run), whole


#: The functions by their SQL names.
FUNCTIONS = {"dated_sections": DatedSections, "dated_quotes": DatedQuotes, "verses": Verses}


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL, and have texts come to them in batches of a few MB."""
    bounded_batches(spark)
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, udtf(function, useArrow=True))
