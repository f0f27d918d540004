"""Columns that name the range a number falls in."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions import if_between
from cohortspark.operators.filters import numeric_columns, quoted


@dataclass(frozen=True)
class Category:
    """A closed range, over one or two columns, and its name."""

    name: str
    low: float
    high: float
    low_other: float | None = None
    high_other: float | None = None


@dataclass(frozen=True)
class ColumnDefinition:
    """A derived column ``name`` over ``first`` and, with two variables, ``second``."""

    name: str
    first: str
    categories: tuple[Category, ...]
    second: str | None = None

    def __post_init__(self):
        if not self.name:
            raise ValueError("the derived column needs a name")
        if not self.first:
            raise ValueError(f"{self.name!r} needs a column to derive from")
        if not self.categories:
            raise ValueError(f"{self.name!r} needs at least one category")
        for category in self.categories:
            if not category.name:
                raise ValueError(f"{self.name!r} has a category without a name")
            bounds = [category.low, category.high]
            if self.second is not None:
                bounds += [category.low_other, category.high_other]
            if any(bound is None for bound in bounds):
                raise ValueError(f"category {category.name!r} needs a start and an end")

    @classmethod
    def from_spec(cls, name: str, spec: dict) -> ColumnDefinition:
        """From the stored form: ``usingTwoVars, firstColName, secondColName, categories``."""
        two = bool(spec.get("usingTwoVars"))
        if two and not spec.get("secondColName"):
            raise ValueError(f"{name!r} needs a second column")
        categories = []
        for entry in spec.get("categories", []):
            bounds = entry.get("Range", {})
            low, high = _number(bounds.get("From")), _number(bounds.get("To"))
            other = (_number(bounds.get("FromOther")), _number(bounds.get("ToOther")))
            categories.append(
                Category(entry.get("Name", ""), low, high, *(other if two else (None, None)))
            )
        return cls(
            name=name,
            first=spec.get("firstColName", ""),
            second=spec["secondColName"] if two else None,
            categories=tuple(categories),
        )

    @classmethod
    def all_from_json(cls, text: str) -> dict[str, ColumnDefinition]:
        return {name: cls.from_spec(name, spec) for name, spec in json.loads(text).items()}

    def matches(self) -> list[Column]:
        """Per category, its name where the row is inside, else NULL."""
        return [self._match(category) for category in self.categories]

    def _match(self, category: Category) -> Column:
        inside = if_between(quoted(self.first), category.low, category.high, category.name)
        if self.second is None:
            return inside
        other = quoted(self.second).between(category.low_other, category.high_other)
        return F.when(other, inside)


def _number(value: object) -> float | None:
    return None if value in (None, "", "NA") else float(value)


def derive_column(df: DataFrame, definition: ColumnDefinition) -> DataFrame:
    """Add the derived column.

    A row inside several ranges appears once per range, a row inside none is dropped, and
    an existing column of that name is replaced. One narrow pass: nothing is shuffled.
    """
    return df.withColumn(definition.name, F.explode(range_names(df, definition)))


def range_names(df: DataFrame, definition: ColumnDefinition) -> Column:
    """The names of all ranges that a row is inside, as an array."""
    usable = numeric_columns(df)
    for source in filter(None, (definition.first, definition.second)):
        if source not in usable:
            raise ValueError(f"{source!r} is not a numeric column")
    return F.filter(F.array(*definition.matches()), lambda name: name.isNotNull())


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """The rows of all ``frames``, columns matched by name."""
    return reduce(lambda top, bottom: top.unionByName(bottom), frames)
