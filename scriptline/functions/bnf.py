"""Column functions over hierarchical medicine codes (chapter .. presentation, prefix = ancestor)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Levels of the hierarchy, the code length of each ancestor level, the shape of a code.
CHAPTER, SECTION, PARAGRAPH, SUBPARAGRAPH, CHEMICAL, PRODUCT, PRESENTATION = range(1, 8)
LEVEL_LABELS = ("Chapter", "Section", "Paragraph", "Subparagraph", "Chemical", "Product", "Presentation")
ANCESTOR_LENGTHS = (2, 4, 6, 7, 9)
PART_WIDTHS = (
    ("chapter", 2),
    ("section", 2),
    ("paragraph", 2),
    ("subparagraph", 1),
    ("chemical_substance", 2),
    ("product", 2),
    ("strength_and_formulation", 2),
    ("generic_equivalent", 2),
)
_BEHIND_SUBPARAGRAPH = [name for name, _ in PART_WIDTHS[4:]]
GENERIC_PRODUCT = "AA"
GENERIC_NAME_PREFIX = "Generic "


def parts(code: Column) -> Column:
    """Struct of the eight parts of a code; parts the code does not reach are NULL.

    Only the subparagraph has one character, so a code has it when its length is odd; the other parts follow in order.
    A text that is no code (under 2 or over 15 characters) has no parts.
    """
    length = F.length(code)
    odd = length % 2
    found, pairs = [], 0
    for name, width in PART_WIDTHS:
        if width == 1:
            there, start = odd == 1, F.least(F.lit(2 * pairs), length - 1)
        else:
            behind = odd if name in _BEHIND_SUBPARAGRAPH else F.lit(0)
            there, start = length - odd >= 2 * (pairs + 1), behind + 2 * pairs
            pairs += 1
        found.append(F.when(there & length.between(2, 15), F.substring(code, start + 1, F.lit(width))).alias(name))
    return F.struct(*found)


def is_generic(code: Column) -> Column:
    return F.substring(code, 10, 2) == GENERIC_PRODUCT


def chemical(code: Column) -> Column:
    return F.substring(code, 1, 9)


def generic_equivalent_code(code: Column) -> Column:
    """Code of the generic with the same chemical, strength and formulation."""
    return F.concat(chemical(code), F.lit(GENERIC_PRODUCT), F.right(code, F.lit(2)), F.right(code, F.lit(2)))


def strength_code(code: Column) -> Column:
    """``CCCCCCCCC_SS``: every presentation of a chemical in one strength and formulation."""
    return F.concat(chemical(code), F.lit("_"), F.right(code, F.lit(2)))


def strength_name(name: Column) -> Column:
    return F.regexp_replace(name, f"^{GENERIC_NAME_PREFIX}", "")


def is_ancestor(code: Column, other: Column) -> Column:
    return other.startswith(code) & (code != other)


def prefixes(code: Column, lengths: tuple[int, ...] = ANCESTOR_LENGTHS) -> Column:
    """Array of the proper prefixes of ``code`` at the given lengths."""
    candidates = F.array(*(F.when(F.length(code) > n, F.substring(code, 1, n)) for n in lengths))
    return F.array_compact(candidates)


def match_keys(code: Column) -> Column:
    """Every filter value that selects ``code``: all its prefixes (the empty one too) and its strength code.

    Turns "does the code start with the value" into an equi-join on the value.
    """
    all_prefixes = F.transform(F.sequence(F.lit(0), F.length(code)), lambda n: F.substring(code, F.lit(1), n))
    strength = F.when(F.length(code) >= 9, F.array(strength_code(code))).otherwise(F.array().cast("array<string>"))
    return F.concat(all_prefixes, strength)


def split_strength_code(value: str) -> tuple[str, str]:
    prefix, _, suffix = value.partition("_")
    if len(prefix) != 9 or len(suffix) != 2:
        raise ValueError(f"Invalid strength and formulation code: {value}")
    return prefix, suffix


def matches(code: Column, value: str) -> Column:
    """Whether ``code`` is selected by one filter value (a prefix, or a strength code)."""
    if "_" in value:
        prefix, suffix = split_strength_code(value)
        return code.startswith(prefix) & code.endswith(suffix)
    return code.startswith(value)


def matches_any(code: Column, values: tuple[str, ...]) -> Column:
    return reduce(or_, (matches(code, value) for value in values), F.lit(False))


def level_label(level: Column) -> Column:
    return F.element_at(F.array(*(F.lit(label) for label in LEVEL_LABELS)), level)
