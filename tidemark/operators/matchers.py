"""Conditions on labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.labels import ALL, label


def _engine():  # noqa: ANN202
    """The JVM that runs the patterns."""
    return SparkSession.getActiveSession().sparkContext._jvm


@dataclass(frozen=True)
class Matcher:
    """A condition on one label's value; a series without the label has the value ''. Subclasses give `test` (a Column) and `accepts` (for one string)."""

    name: str

    def test(self, value: Column) -> Column:
        raise NotImplementedError

    def accepts(self, value: str) -> bool:
        raise NotImplementedError

    def condition(self, labels: Column) -> Column:
        return self.test(label(labels, self.name))


@dataclass(frozen=True)
class Equal(Matcher):
    """The value, byte for byte."""

    value: str

    def test(self, value: Column) -> Column:
        return value == self.value

    def accepts(self, value: str) -> bool:
        return value == self.value


@dataclass(frozen=True)
class AnyOf(Matcher):
    """One of several values."""

    values: tuple[str, ...]

    def test(self, value: Column) -> Column:
        return value.isin(list(self.values)) if self.values else F.lit(False)

    def accepts(self, value: str) -> bool:
        return value in self.values


@dataclass(frozen=True)
class Regex(Matcher):
    """The whole value matches the pattern, in the dialect of the engine (`java.util.regex`), by which patterns are also checked; one that isn't valid matches nothing."""

    pattern: str

    def whole(self) -> str | None:
        """The pattern for a whole value, null if it isn't valid, by itself and as a group. A comment at its end may not swallow the group's end."""
        compiler = _engine().java.util.regex.Pattern
        for end in (")\\z", "\n)\\z"):
            text = f"\\A(?:{self.pattern}{end}"
            try:
                compiler.compile(self.pattern)
                compiler.compile(text)
            except (Py4JJavaError, IllegalArgumentException):
                continue
            return text
        return None

    def valid(self) -> bool:
        return self.whole() is not None

    def test(self, value: Column) -> Column:
        whole = self.whole()
        return F.lit(False) if whole is None else value.rlike(whole)

    def accepts(self, value: str) -> bool:
        whole = self.whole()
        return whole is not None and bool(_engine().java.util.regex.Pattern.compile(whole).matcher(value).find())


@dataclass(frozen=True)
class Prefix(Matcher):
    """The value begins with a string."""

    prefix: str

    def test(self, value: Column) -> Column:
        return value.startswith(self.prefix)

    def accepts(self, value: str) -> bool:
        return value.startswith(self.prefix)


@dataclass(frozen=True)
class Range(Matcher):
    """A value from `lo` on and before `hi`, in the order of bytes; either may be null for no bound."""

    lo: str | None = None
    hi: str | None = None

    def test(self, value: Column) -> Column:
        least = F.lit(True) if self.lo is None else value >= self.lo
        return least if self.hi is None else least & (value < self.hi)

    def accepts(self, value: str) -> bool:
        raw = value.encode()
        return (self.lo is None or raw >= self.lo.encode()) and (self.hi is None or raw < self.hi.encode())


class Not(Matcher):
    """What another matcher refuses."""

    def __init__(self, inner: Matcher) -> None:
        super().__init__(inner.name)
        object.__setattr__(self, "inner", inner)

    def test(self, value: Column) -> Column:
        return ~self.inner.test(value)

    def accepts(self, value: str) -> bool:
        return not self.inner.accepts(value)


@dataclass(frozen=True)
class Custom(Matcher):
    """Any condition, given as a function of the value's Column; the extension point for matchers of one's own."""

    function: Callable[[Column], Column]

    def test(self, value: Column) -> Column:
        return self.function(value)


def everything() -> Matcher:
    """Selects every series."""
    return Equal(ALL, ALL)


def all_of(labels: Column, matchers: Sequence[Matcher]) -> Column:
    """All matchers hold. Without any matcher nothing is selected; to select everything, ask for it."""
    if not matchers:
        return F.lit(False)
    return reduce(lambda a, b: a & b, (F.lit(True) if m == everything() else m.condition(labels) for m in matchers))
