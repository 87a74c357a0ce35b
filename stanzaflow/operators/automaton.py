"""Greedy matching with lexicons of thousands of forms: one automaton, broadcast, and a narrow stage over Arrow batches.

All occurrences of all forms are found in one pass over a text, whatever the number of forms; a sweep in form order, left to right, then keeps
those that touch no kept one. The automaton is built once in each worker from the forms, whose size is checked before they are
broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from stanzaflow.sources.scratch import bounded_batches

#: Characters of all forms together that are broadcast, at most.
BROADCAST_CHARS = 16 << 20
HIT = StructType([StructField("ord", IntegerType()), StructField("entry_id", StringType()), StructField("pos", IntegerType())])


@lru_cache(maxsize=4)
def _automaton(forms: tuple[str, ...]) -> ahocorasick.Automaton:
    """The automaton of forms in their order; of a repeated form the first counts."""
    out = ahocorasick.Automaton()
    for place, form in enumerate(forms):
        if form and form not in out:
            out.add_word(form, (place, len(form)))
    out.make_automaton()
    return out


def accepted(text: str, machine: ahocorasick.Automaton) -> list[tuple[int, int]]:
    """(place of the form, position) of the accepted matches of a text, in form order and then left to right."""
    if not text or not len(machine):
        return []
    found = sorted((place, end - size + 1, size) for end, (place, size) in machine.iter(text))
    used, kept = bytearray(len(text)), []
    for place, at, size in found:
        if used.find(1, at, at + size) < 0:
            used[at : at + size] = b"\1" * size
            kept.append((place, at))
    return kept


def fits(forms: DataFrame) -> bool:
    """Whether a form table may be broadcast."""
    return (forms.agg(F.sum(F.length("form"))).first()[0] or 0) <= BROADCAST_CHARS


def shared_forms(forms: DataFrame, *values: str) -> Callable[[], tuple]:
    """The forms (form, values) in the order of `ord`, broadcast; their size has been checked."""
    rows = forms.select("ord", "form", *values).orderBy("ord").collect()
    held = forms.sparkSession.sparkContext.broadcast(tuple(zip(*rows, strict=True)) if rows else ((),) * (2 + len(values)))
    return lambda: held.value


def with_hits(df: DataFrame, plain: str, forms: DataFrame, name: str = "hits") -> DataFrame:
    """df with an array of (ord, entry_id, pos) of the accepted matches of normalised text, in form order; null counts as empty.

    The forms must fit (see fits); operators.matching.match_positions takes another way where they don't.
    """
    bounded_batches(df.sparkSession)
    held = shared_forms(forms, "entry_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ords, words, entries = held()
        machine = _automaton(words)
        kind = pa.list_(pa.struct([("ord", pa.int32()), ("entry_id", pa.string()), ("pos", pa.int32())]))
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(plain)).to_pylist()
            hits = [[{"ord": ords[p], "entry_id": entries[p], "pos": at} for p, at in accepted(t or "", machine)] for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, kind)], [*batch.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, ArrayType(HIT))]))


def converted(df: DataFrame, text: str, source: str, target: str, phrases: DataFrame) -> DataFrame:
    """df with its text converted: phrases (ord, form, becomes) first, what lies between them by character. Null stays null."""
    bounded_batches(df.sparkSession)
    held = shared_forms(phrases, "becomes")
    letters: dict[int, str | None] = {}
    for i, c in enumerate(source):
        letters.setdefault(ord(c), target[i] if i < len(target) else None)

    def one(t: str, machine: ahocorasick.Automaton, words: tuple[str, ...], becomes: tuple[str, ...]) -> str:
        out, end = [], 0
        for at, place in sorted((at, place) for place, at in accepted(t, machine)):
            out += [t[end:at].translate(letters), becomes[place]]
            end = at + len(words[place])
        return "".join([*out, t[end:].translate(letters)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, words, becomes = held()
        machine = _automaton(words)
        for batch in batches:
            i = batch.schema.get_field_index(text)
            new = pa.array([None if t is None else one(t, machine, words, becomes) for t in batch.column(i).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if j == i else c for j, c in enumerate(batch.columns)], batch.schema.names)

    return df.mapInArrow(run, df.schema)
