"""Column expressions over text with the semantics of Unicode-aware string methods."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import unicode_classes as U


def named(column: str) -> str:
    """A reference to a column, whatever characters its name holds."""
    return "`" + column.replace("`", "``") + "`"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns, in place of any of the same name, that are computed once for each row.

    Plain projections are written into each other where they meet, so an expression
    that later ones use often is evaluated as often; a generated row is not.
    """
    kept = [F.col(named(c)) for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(U.WS_CHARACTERS))


def compact(text: Column) -> Column:
    """Without any white space."""
    return F.translate(text, U.WS_CHARACTERS, "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(U.NOT_WS)


def physical_lines(text: Column) -> Column:
    """Lines at every kind of line break; a break at the end adds no line, an empty text has none."""
    return let(F.split(text, U.LINE_BREAK, -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def field_lines(text: Column) -> Column:
    """Stripped lines that hold more than white space."""
    return F.filter(F.transform(physical_lines(text), strip), lambda line: line != "")


def characters(text: Column) -> Column:
    """One element for each code point; an empty text has none."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def quoted(literal: str) -> str:
    """A pattern that matches ``literal`` in Java and in RE2."""
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", literal)


def occurrences(text: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return F.regexp_count(text, F.lit(quoted(literal))).cast("long")


def matches(text: Column, pattern: str) -> Column:
    """How many characters or stretches a pattern matches."""
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def latin_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, U.LATIN_CHARACTERS, ""))


def reasons(rules: Iterable[tuple[str, Column]]) -> Column:
    """Names of the rules that hold, in rule order; an undecided rule does not hold."""
    return F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules)))
