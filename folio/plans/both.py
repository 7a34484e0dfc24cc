"""Expressions that exist as a Column and as the oracle's SQL at once, so that both are written in one place."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


class Both:
    """A Column, made when asked for, and its SQL. Patterns must mean the same to Java and to RE2."""

    def __init__(self, make: Callable[[], Column], sql: str) -> None:
        self.make, self.sql = make, sql

    @property
    def col(self) -> Column:
        return self.make()

    def has(self, pattern: str) -> Both:
        return Both(lambda: self.col.rlike(pattern), f"regexp_matches({self.sql}, {quoted(pattern)})")

    def count(self, pattern: str) -> Both:
        return Both(lambda: F.regexp_count(self.col, F.lit(pattern)).cast("bigint"), f"len(regexp_extract_all({self.sql}, {quoted(pattern)}))")

    def sub(self, pattern: str, to: str = "") -> Both:
        """Every match replaced; groups are written $1."""
        return Both(lambda: F.regexp_replace(self.col, pattern, to), f"regexp_replace({self.sql}, {quoted(pattern)}, {quoted(re.sub(r'[$]([0-9])', r'\\\1', to))}, 'g')")

    def subs(self, pairs) -> Both:
        out = self
        for pattern, to in pairs:
            out = out.sub(pattern, to)
        return out

    def lower(self) -> Both:
        return Both(lambda: F.lower(self.col), f"lower({self.sql})")

    def trim(self) -> Both:
        return Both(lambda: F.trim(self.col), f"trim({self.sql})")

    def left(self, n: int) -> Both:
        return Both(lambda: F.left(self.col, F.lit(n)), f"left({self.sql}, {n})")

    def length(self) -> Both:
        return Both(lambda: F.length(self.col).cast("bigint"), f"length({self.sql})")

    def letters(self) -> Both:
        return self.lower().sub("[^a-z]+")

    def capital(self) -> Both:
        return Both(lambda: F.concat(F.upper(F.left(self.col, F.lit(1))), F.substring(self.col, 2, 2147483647)), f"(upper(left({self.sql}, 1)) || substr({self.sql}, 2))")

    def or_(self, other: Both | str) -> Both:
        other = other if isinstance(other, Both) else lit(other)
        return Both(lambda: F.coalesce(self.col, other.col), f"coalesce({self.sql}, {other.sql})")

    def holds(self, other: Both) -> Both:
        return Both(lambda: F.contains(self.col, other.col), f"contains({self.sql}, {other.sql})")

    def is_in(self, *values: str) -> Both:
        return Both(lambda: self.col.isin(*values), f"({self.sql} in ({', '.join(map(quoted, values))}))")

    def is_null(self) -> Both:
        return Both(lambda: self.col.isNull(), f"({self.sql} is null)")

    def __add__(self, other: Both | str) -> Both:
        other = other if isinstance(other, Both) else lit(other)
        return Both(lambda: F.concat(self.col, other.col), f"({self.sql} || {other.sql})")

    def _op(self, other, f, sign: str) -> Both:
        other = other if isinstance(other, Both) else Both(lambda v=other: F.lit(v), quoted(other) if isinstance(other, str) else repr(other))
        return Both(lambda: f(self.col, other.col), f"({self.sql} {sign} {other.sql})")

    def __eq__(self, other) -> Both:  # type: ignore[override]
        return self._op(other, lambda a, b: a == b, "=")

    def __ne__(self, other) -> Both:  # type: ignore[override]
        return self._op(other, lambda a, b: a != b, "<>")

    __hash__ = None  # type: ignore[assignment]

    def __lt__(self, other) -> Both:
        return self._op(other, lambda a, b: a < b, "<")

    def __le__(self, other) -> Both:
        return self._op(other, lambda a, b: a <= b, "<=")

    def __gt__(self, other) -> Both:
        return self._op(other, lambda a, b: a > b, ">")

    def __ge__(self, other) -> Both:
        return self._op(other, lambda a, b: a >= b, ">=")

    def __mul__(self, other) -> Both:
        return self._op(other, lambda a, b: a * b, "*")

    def plus(self, other) -> Both:
        return self._op(other, lambda a, b: a + b, "+")

    def __and__(self, other: Both) -> Both:
        return Both(lambda: self.col & other.col, f"({self.sql} and {other.sql})")

    def __or__(self, other: Both) -> Both:
        return Both(lambda: self.col | other.col, f"({self.sql} or {other.sql})")

    def __invert__(self) -> Both:
        return Both(lambda: ~self.col, f"(not {self.sql})")


def c(name: str) -> Both:
    return Both(lambda: F.col(name), f'"{name}"')


def lit(text: str) -> Both:
    return Both(lambda: F.lit(text), quoted(text))


def case(*branches: tuple[Both, Both | str | float | None], other: Both | str | float | None = None) -> Both:
    """The value of the first branch whose condition is true."""

    def value(v) -> Both:
        return v if isinstance(v, Both) else Both(lambda: F.lit(v), "null" if v is None else quoted(v) if isinstance(v, str) else repr(v))

    pairs, o = [(condition, value(v)) for condition, v in branches], value(other)

    def make() -> Column:
        out = F.when(pairs[0][0].col, pairs[0][1].col)
        for condition, v in pairs[1:]:
            out = out.when(condition.col, v.col)
        return out.otherwise(o.col)

    return Both(make, "(case" + "".join(f" when {q.sql} then {v.sql}" for q, v in pairs) + f" else {o.sql} end)")


def points(*terms: tuple[Both, float]) -> Both:
    """The sum of the points of the conditions that are true."""
    parts = [case((condition, float(p)), other=0.0) for condition, p in terms]
    out = parts[0]
    for p in parts[1:]:
        out = out.plus(p)
    return out


def at_most(limit: float, each: float, count: Both) -> Both:
    return Both(lambda: F.least(F.lit(float(limit)), count.col * each), f"least({float(limit)}, {count.sql} * {each})")


def rounded(x: Both, digits: int = 4) -> Both:
    return Both(lambda: F.round(x.col, digits).cast("double"), f"cast(round({x.sql}, {digits}) as double)")


def columns(**named: Both) -> list[Column]:
    return [b.col.alias(n) for n, b in named.items()]


def select_list(**named: Both) -> str:
    return ", ".join(f'{b.sql} as "{n}"' for n, b in named.items())
