"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The characters that matching keeps, and the narrower set that counts in a verse line.
IDEOGRAPHS = "㐀-䶿一-鿿豈-﫿"
LINE_IDEOGRAPHS = "㐀-䶿一-鿿"
#: Numerals and the digits they stand for.
NUMERALS, DIGITS = "〇○零０Ｏｏ一二三四五六七八九", "000000123456789"


def normalise(text: Column, keep: str = IDEOGRAPHS) -> Column:
    """Only the characters of the class `keep`; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{keep}]", "")


def kept_length(text: Column, keep: str = LINE_IDEOGRAPHS) -> Column:
    """How many characters of the class `keep` a text has."""
    return F.length(normalise(text, keep))


def count_in_set(text: Column, characters: str) -> Column:
    """How many characters of a text are in a set, repeats counted."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def translate_script(text: Column, source: str, target: str) -> Column:
    """Character by character from source to target; with phrases, operators.matching.convert_script."""
    return F.translate(text, source, target)


def numeral_year(text: Column, numerals: str = NUMERALS, digits: str = DIGITS) -> Column:
    """The year that four numerals write, other characters ignored; null unless there are exactly four."""
    only = F.translate(F.regexp_replace(text, f"[^{numerals}]", ""), numerals, digits)
    return F.when(F.length(only) == 4, only.try_cast("int"))


def clean_templates(text: Column, depth: int = 3) -> Column:
    """Without {{..}} templates, innermost first, `depth` levels."""
    for _ in range(depth):
        text = F.regexp_replace(text, r"\{\{[^{}]*\}\}", "")
    return text


def clean_markup(text: Column) -> Column:
    """Without header blocks, templates, link targets and editorial notes; tags become line ends."""
    text = clean_templates(F.regexp_replace(text, r"(?s)\{\{header.*?\}\}", ""))
    text = F.regexp_replace(text, r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1")
    return F.regexp_replace(F.regexp_replace(text, r"</?[^>]+>", "\n"), r"（按[^）]*）", "")


def fixed(x: Column, places: int = 3) -> Column:
    """A number with three or fewer decimals, rounding its exact binary value half to even; `nan`, `inf` and `-inf` by name.

    The fraction, which a double holds apart from its whole part without loss, is taken as two whole numbers of 44 bits
    behind the point each: every bit down to 2^-88. What remains is compared with one half in whole numbers. From 9 x 10^18 on, where no
    fraction is left, the shortest digits that name the double are followed by zeros.
    """
    unit, half, size = 1 << 44, 1 << 43, F.abs(x)
    calm = F.when(size < 9e18, size)
    whole = calm.cast("long")
    scaled = (calm - whole.cast("double")) * float(unit)
    high = F.floor(scaled)
    low = F.floor((scaled - high) * float(unit))
    wide, carried = high * 10**places, low * 10**places
    rest = wide % unit + F.call_function("div", carried, F.lit(unit))
    below = carried % unit
    n = F.call_function("div", wide, F.lit(unit)) + F.call_function("div", rest, F.lit(unit))
    rest = rest % unit
    odd = (n + whole % 2 * 10**places) % 2 == 1
    up = (rest > half) | ((rest == half) & ((below > 0) | odd))
    n = n + up.cast("long")
    over = n >= 10**places
    digits = (whole + over.cast("long")).cast("string")
    behind = F.lpad((n - F.when(over, 10**places).otherwise(0)).cast("string"), places, "0")
    text = F.concat(digits, F.lit("."), behind) if places else digits
    huge = F.format_string(f"%.{places}f", size)
    text = F.when(size.isNull(), None).when(F.isnan(size), "nan").when(size == float("inf"), "inf").when(size >= 9e18, huge).otherwise(text)
    return F.when(((x < 0) | (x.cast("string") == "-0.0")) & ~F.isnan(x), F.concat(F.lit("-"), text)).otherwise(text)
