"""Scalar column expressions. All are built-in expressions, so they stay inside generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "POSITION_STANDARD", "bernoulli_weight", "bytes_for_people", "cast_rounded", "choose", "column_safe", "college_key", "fallback",
    "height_inches", "identity_hash", "json_scoring_type", "literal_map", "log10_or_null", "lookup", "lower_trim", "name_key", "name_key_plain",
    "one_line", "position_standard", "ratio_or_null", "roster_settings", "round_half_even", "row_count_present", "row_mean",
    "safe_identifier", "team_suffix", "to_int", "url_safe",
]

#: Positions that stand for another one.
POSITION_STANDARD = {"T": "OT", "LT": "OT", "RT": "OT", "LG": "OG", "RG": "OG", "G": "OG", "SAF": "S", "LB": "LB", "ILB": "LB", "EDGE": "EDGE", "OLB": "EDGE"}
#: Fixed value: name suffixes that do not tell people apart.
NAME_SUFFIX = r"(?i) (jr\.?|sr\.?|ii|iii|iv|v)$"


def column_safe(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lower_trim(c: Column | str) -> Column:
    """Key for joins on names as they are written."""
    return F.lower(F.trim(column_safe(c)))


def name_key(c: Column | str) -> Column:
    """Name without outer spaces, generational suffix and case."""
    return F.lower(F.regexp_replace(F.trim(column_safe(c)), NAME_SUFFIX, ""))


def name_key_plain(c: Column | str) -> Column:
    """Name key that also drops punctuation and joins runs of spaces."""
    bare = F.regexp_replace(column_safe(c), r"[^\p{L}\p{N} ]", "")
    return F.regexp_replace(name_key(bare), " +", " ")


def college_key(c: Column | str) -> Column:
    """College with its trailing abbreviation spelled out."""
    return F.regexp_replace(F.regexp_replace(F.trim(column_safe(c)), r"(?i) St\.?$", " State"), r"(?i) Col\.?$", " College")


def identity_hash(primary: Column | str, secondary: Column | str, name: Column | str, born: Column | str, college: Column | str, prefix: str = "YAMP_") -> Column:
    """``prefix`` (a fixed value) and twelve hex digits of the MD5 of the non-empty parts. A missing id or birth date counts as the text None; a missing college is left out."""
    parts = [F.coalesce(column_safe(c), F.lit("None")) for c in (primary, secondary, name, born)] + [F.coalesce(college_key(college), F.lit(""))]
    line = F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "|")
    return F.concat(F.lit(prefix), F.substring(F.md5(line), 1, 12))


def literal(value) -> str:
    """SQL text of a string, number or list of them. One parsed text is much cheaper to build than a call for each entry."""
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(map(literal, value))})"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else repr(value)


def literal_map(table: Mapping) -> Column:
    return F.expr(f"map({', '.join(literal(x) for kv in table.items() for x in kv)})")


def lookup(c: Column | str, table: Mapping, default: Column | None = None) -> Column:
    """Value of a literal mapping; the default, or the key itself, where it is missing."""
    c = column_safe(c)
    return F.coalesce(F.try_element_at(literal_map(table), c), c if default is None else default)


def position_standard(c: Column | str) -> Column:
    return lookup(c, POSITION_STANDARD)


def height_inches(c: Column | str) -> Column:
    """Inches of a "feet-inches" text; null for anything else."""
    parts = F.split(column_safe(c), "-")
    feet, inches = (parts[i].try_cast("int") for i in (0, 1))
    return F.when(F.size(parts) == 2, feet * 12 + inches)


def one_line(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(column_safe(c), r"[\r\n]+", " "))


def url_safe(c: Column | str) -> Column:
    return F.replace(column_safe(c), F.lit(","), F.lit("%2C"))


def safe_identifier(name: str) -> str:
    """Catalog identifier of a file or folder name."""
    return name.replace("-", "_").replace(" ", "_")


def team_suffix(c: Column | str, default: str = "FA") -> tuple[Column, Column]:
    """(name, team) of "First Last TEAM": the last word is the team; a single word is a name without one."""
    words = F.split(F.trim(column_safe(c)), r"\s+")
    several = F.size(words) > 1
    name = F.array_join(F.when(several, F.slice(words, F.lit(1), F.size(words) - 1)).otherwise(words), " ")
    return name, F.when(several, F.element_at(words, -1)).otherwise(F.lit(default))


def bytes_for_people(n: int) -> str:
    size, unit = float(n), "B"
    for unit in ("B", "KB", "MB", "GB", "TB"):  # noqa: B007
        if size < 1024 or unit == "TB":
            break
        size /= 1024
    return f"{size:.1f} {unit}"


def to_int(c: Column | str) -> Column:
    """Integer of a text; empty or malformed is null. A number with a zero fraction is an integer too."""
    return F.trim(column_safe(c)).try_cast("double").try_cast("int")


def cast_rounded(c: Column | str) -> Column:
    """Whole number by rounding half to even."""
    return F.bround(column_safe(c)).cast("bigint")


def round_half_even(c: Column | str) -> Column:
    return F.bround(column_safe(c))


def fallback(*cs: Column | str) -> Column:
    return F.coalesce(*[column_safe(c) for c in cs])


def choose(options: Mapping[str, Column | str], key: str, default: str | None = None) -> Column:
    """The expression for ``key``; that for ``default`` where it is unknown, or ValueError if there is none."""
    if key not in options and default is None:
        raise ValueError(f"unknown choice {key!r}; one of {', '.join(options)}")
    return column_safe(options.get(key, options.get(default)))


def ratio_or_null(a: Column | str, b: Column | str) -> Column:
    """True division; null where the divisor is zero."""
    return column_safe(a) / F.nullif(column_safe(b), F.lit(0))


def log10_or_null(c: Column | str) -> Column:
    c = column_safe(c)
    return F.when(c > 0, F.log10(c))


def bernoulli_weight(pick: Column | str, adp: Column | str, std: Column | str) -> Column:
    """Unnormalised Gaussian weight of a player at a pick; the deviation counts as one at least."""
    z = (column_safe(pick) - column_safe(adp)) / F.greatest(column_safe(std), F.lit(1.0))
    return F.exp(F.lit(-0.5) * z * z)


def row_mean(cs: Sequence[Column | str]) -> Column:
    """Mean over the columns that are not null; null if all are."""
    cs = [column_safe(c).cast("double") for c in cs]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cs[1:]), F.coalesce(cs[0], F.lit(0.0)))
    return total / F.nullif(row_count_present(cs), F.lit(0))


def row_count_present(cs: Sequence[Column | str]) -> Column:
    cs = [column_safe(c).isNotNull().cast("int") for c in cs]
    return sum(cs[1:], cs[0])


def json_scoring_type(doc: Column | str, path: str = "$.scoring_settings.rec") -> Column:
    """Scoring by points for a reception: 1 and more full, half and more half, else standard; a missing value counts as 1."""
    rec = F.coalesce(F.get_json_object(column_safe(doc), path).try_cast("double"), F.lit(1.0))
    return F.when(rec >= 1, "ppr").when(rec >= 0.5, "half_ppr").otherwise("standard")


#: Slot counts that a draft document may leave out.
SETTINGS_DEFAULT = {"qb": 1, "rb": 2, "wr": 2, "te": 1, "flex": 1, "k": 1, "def": 1}


def roster_settings(doc: Column | str, root: str = "$.settings") -> Column:
    """Struct of slot counts of a draft document; the bench is what rounds leave beyond starters, else its own setting, else six."""
    doc = column_safe(doc)

    def number(name: str) -> Column:
        return F.get_json_object(doc, f"{root}.{name}").try_cast("int")

    slots = {k: F.coalesce(number(f"slots_{k}"), F.lit(v)) for k, v in SETTINGS_DEFAULT.items()}
    starters = sum(list(slots.values())[1:], slots["qb"])
    bench = F.coalesce(F.when(number("rounds").isNotNull(), F.greatest(number("rounds") - starters, F.lit(0))), number("slots_bn"), F.lit(6))
    return F.struct(*[v.alias(k) for k, v in slots.items()], bench.alias("bench"))
