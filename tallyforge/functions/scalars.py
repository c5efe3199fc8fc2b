"""Scalar expressions on columns; all stay inside code generation."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def numeric(c: Column | str, fill: float | None = None) -> Column:
    """A number from any text; what is none, NaN or infinite is NULL (or `fill`)."""
    x = col(c).try_cast("double")
    x = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    return x if fill is None else F.coalesce(x, F.lit(float(fill)))


def safe_divide(a: Column | str, b: Column | str) -> Column:
    """a / b; 0.0 where b is 0 or either is missing, NaN or infinite."""
    return F.coalesce(F.try_divide(numeric(a), F.nullif(numeric(b), F.lit(0.0))), F.lit(0.0))


def clamp(c: Column | str, low: float, high: float) -> Column:
    """c within [low, high]; NULL stays NULL."""
    return F.when(col(c).isNotNull(), F.greatest(F.least(col(c), F.lit(float(high))), F.lit(float(low))))


def sigmoid(c: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-clamp(c, -35, 35)))


def logit(c: Column | str, eps: float = 1e-12) -> Column:
    p = clamp(c, eps, 1 - eps)
    return F.log(p / (1 - p))


def round_half_up(c: Column | str) -> Column:
    """floor(x + 0.5), the rule for counts of events."""
    return F.floor(col(c) + 0.5)


def weighted_score(weights: dict[str, float], digits: int = 2) -> Column:
    """Sum of columns times weights, missing ones 0, rounded half to even."""
    return F.bround(reduce(lambda a, b: a + b, [numeric(n, 0) * w for n, w in weights.items()]), digits)


def tiers(c: Column | str, steps: list[tuple[float, float]], rest: float) -> Column:
    """The value of the first step whose upper bound (inclusive) holds c, else `rest`; NULL for NULL."""
    out = reduce(lambda acc, s: acc.when(col(c) <= s[0], F.lit(float(s[1]))), steps, F.when(col(c).isNull(), F.lit(None).cast("double")))
    return out.otherwise(float(rest))


def band(c: Column | str, steps: list[tuple[float, str]], rest: str) -> Column:
    """The label of the first step whose upper bound (exclusive) c is under, else `rest`; NULL for NULL."""
    return reduce(lambda acc, s: acc.when(col(c) < s[0], s[1]), steps, F.when(col(c).isNull(), F.lit(None).cast("string"))).otherwise(rest)


def mapped(c: Column | str, table: dict[str, str]) -> Column:
    """The table's value for c, c itself where the table has none."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), col(c)), col(c))


def null_text(c: Column | str) -> Column:
    """Trimmed text; words that stand for nothing become the empty text."""
    text = F.trim(F.coalesce(col(c), F.lit("")))
    return F.when(F.lower(text).isin("nan", "none", "null", "<na>", "n/a", ""), "").otherwise(text)


def _plain(c: int) -> str:
    """A character without its marks, as its compatibility decomposition has it; itself where that says nothing."""
    bare = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))
    return bare if bare.isalnum() else chr(c)


#: Every letter and digit of the basic plane that is written as another with marks or in another form.
_FORMS = {chr(c): _plain(c) for c in range(0x80, 0x10000) if chr(c).isalnum() and not 0xAC00 <= c < 0xD7A4 and _plain(c) != chr(c)}
#: Letters that have no decomposition, as they are written without special letters.
_FORMS |= {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ı": "i", "ŋ": "n", "ħ": "h", "Ħ": "H", "ŧ": "t", "Ŧ": "T", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th"}
_SINGLE = {x: p for x, p in _FORMS.items() if len(p) == 1}
_SEVERAL = {x: p for x, p in _FORMS.items() if len(p) > 1 and p.isascii()}


def unaccented(c: Column | str) -> Column:
    """Text with letters and digits without marks and in their plain form; marks that stand alone are left out."""

    def plain(text: Column) -> Column:
        text = F.translate(text, "".join(_SINGLE), "".join(_SINGLE.values()))
        text = F.when(text.rlike(f"[{''.join(_SEVERAL)}]"), reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), _SEVERAL.items(), text)).otherwise(text)
        return F.regexp_replace(text, r"\p{Mn}", "")

    return F.when(col(c).rlike(r"[^\x00-\x7f]"), plain(col(c))).otherwise(col(c))


def alnum_key(c: Column | str) -> Column:
    """Letters without marks and digits, lower case, nothing else."""
    return F.regexp_replace(F.lower(unaccented(c)), "[^a-z0-9]", "")


def strip_suffix(c: Column | str) -> Column:
    """A name without a generation suffix at its end."""
    return F.regexp_replace(F.trim(col(c)), r"(?i)[\s,]+(jr|sr|ii|iii|iv|v)\.?$", "")


def initial_key(c: Column | str) -> Column:
    """`f.last` of a display name; NULL where there is no second word."""
    words = F.split(F.lower(strip_suffix(c)), r"\s+")
    return F.when(F.size(words) > 1, F.concat(F.substring(words[0], 1, 1), F.lit("."), F.regexp_replace(F.element_at(words, -1), "[^a-z0-9]", "")))


def slug(c: Column | str, sep: str = "_") -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", sep), f"^{sep}+|{sep}+$", "")


def money(c: Column | str) -> Column:
    """A number from text with currency signs and thousands commas; bad text is NULL."""
    return F.regexp_replace(col(c), r"[$,\s]", "").try_cast("double")


def away_home(c: Column | str) -> Column:
    """struct(away, home) of AWY@HOM, NULL for other text."""
    text = F.upper(F.trim(col(c)))
    return F.when(text.rlike("^[A-Z]{2,3}@[A-Z]{2,3}$"), F.struct(F.split_part(text, F.lit("@"), F.lit(1)).alias("away"), F.split_part(text, F.lit("@"), F.lit(2)).alias("home")))


def season_of(date: Column | str) -> Column:
    """The season that a date belongs to: its year from March on, else the year before."""
    return F.year(col(date)) - F.when(F.month(col(date)) >= 3, 0).otherwise(1)


def canonical(*cols: str) -> Column:
    """A row's columns in the given order as JSON with their names and NULLs, so that different rows are different texts."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def fingerprint(*cols: str) -> Column:
    """SHA-256 of a row's columns in the given order, as `canonical` writes them."""
    return F.sha2(canonical(*cols), 256)
