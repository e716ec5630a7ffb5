"""Kept columns beside an operator's own: whatever their names are, none can clash with a working or a result column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


class Kept:
    """Columns that pass through an operator under numbers. Behind it they have their names again; one that bears the name of a result column
    is called that name with ``_kept`` (and again, until it is free)."""

    def __init__(self, names: Iterable[str], results: Iterable[str]):
        self.names, self.places = [*dict.fromkeys(names)], []
        taken = {r.lower() for r in results}
        self.shown = []
        for i, name in enumerate(self.names):
            others = {n.lower() for n in self.names if n != name}
            show = name
            while show.lower() in taken or (show != name and show.lower() in others):
                show += "_kept"
            taken.add(show.lower())
            self.places.append(f"__k{i}")
            self.shown.append(show)

    def held(self) -> list[Column]:
        return [named(n).alias(p) for n, p in zip(self.names, self.places, strict=True)]

    def back(self) -> list[Column]:
        return [F.col(p).alias(s) for p, s in zip(self.places, self.shown, strict=True)]
