"""Edits of outline drafts: chosen rows of each document are indented, outdented, moved, deleted or joined by new rows.

An edit is a function of (levels, chosen places) to the new order, as a list of (old place or None for a new row, level); None refuses it.
``edited`` runs one over a table, a document at a time; a refused edit leaves its document as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireline.operators.grouped import per_group
from quireline.operators.scans import level_clamp

Order = list[tuple[int | None, int]]


def block_end(levels: list[int], at: int) -> int:
    return next((j for j in range(at + 1, len(levels)) if levels[j] <= levels[at]), len(levels))


def heads(levels: list[int], chosen: set[int]) -> list[int]:
    """Chosen places that no chosen block covers."""
    out, free = [], 0
    for i in sorted(chosen):
        if i >= free:
            out.append(i)
            free = block_end(levels, i)
    return out


def _same(levels: list[int]) -> Order:
    return list(enumerate(levels))


def _shifted(levels: list[int], chosen: set[int], step: int, allowed: Callable[[list[int], int], bool]) -> Order | None:
    """Heads are taken in order, and each sees what the ones before it changed."""
    now, changed = list(levels), False
    for i in heads(levels, chosen):
        if allowed(now, i):
            for k in range(i, block_end(now, i)):
                now[k] += step
            changed = True
    return _same(now) if changed else None


def indent(levels: list[int], chosen: set[int]) -> Order | None:
    return _shifted(levels, chosen, 1, lambda now, i: i > 0 and now[i] <= now[i - 1])


def outdent(levels: list[int], chosen: set[int]) -> Order | None:
    return _shifted(levels, chosen, -1, lambda now, i: now[i] > 0)


def _unit(levels: list[int], chosen: set[int]) -> tuple[int, int] | None:
    """The span of chosen blocks if they are siblings next to each other."""
    found = heads(levels, chosen)
    if not found:
        return None
    end = found[0]
    for h in found:
        if h != end or levels[h] != levels[found[0]]:
            return None
        end = block_end(levels, h)
    return found[0], end


def move_up(levels: list[int], chosen: set[int]) -> Order | None:
    unit, rows = _unit(levels, chosen), _same(levels)
    if not unit:
        return None
    start, end = unit
    before = next((k for k in range(start - 1, -1, -1) if levels[k] <= levels[start]), None)
    if before is None or levels[before] != levels[start]:
        return None
    return rows[:before] + rows[start:end] + rows[before:start] + rows[end:]


def move_down(levels: list[int], chosen: set[int]) -> Order | None:
    unit, rows = _unit(levels, chosen), _same(levels)
    if not unit or unit[1] >= len(levels) or levels[unit[1]] != levels[unit[0]]:
        return None
    start, end = unit
    after = block_end(levels, end)
    return rows[:start] + rows[end:after] + rows[start:end] + rows[after:]


def insert_sibling(levels: list[int], chosen: set[int]) -> Order | None:
    """A new row behind the last chosen block, or at the end."""
    rows = _same(levels)
    if not chosen:
        return [*rows, (None, 0)]
    at = max(chosen)
    end = block_end(levels, at)
    return [*rows[:end], (None, levels[at]), *rows[end:]]


def insert_child(levels: list[int], chosen: set[int]) -> Order | None:
    if not chosen:
        return None
    rows, at = _same(levels), max(chosen)
    end = block_end(levels, at)
    return [*rows[:end], (None, levels[at] + 1), *rows[end:]]


def delete(levels: list[int], chosen: set[int]) -> Order | None:
    gone = {k for h in heads(levels, chosen) for k in range(h, block_end(levels, h))}
    return [(i, level) for i, level in enumerate(levels) if i not in gone] if gone else None


def delete_keeping_children(levels: list[int], chosen: set[int]) -> Order | None:
    """One target after the other: what is below it then moves up."""
    rows = _same(levels)
    for target in sorted(chosen):
        at = next(k for k, (i, _) in enumerate(rows) if i == target)
        end = block_end([level for _, level in rows], at)
        rows = rows[:at] + [(i, level - 1) for i, level in rows[at + 1 : end]] + rows[end:]
    return rows if chosen else None


EDITS = {f.__name__: f for f in (indent, outdent, move_up, move_down, insert_sibling, insert_child, delete, delete_keeping_children)}


def edited(df: DataFrame, doc: str, pos: str, level: str, edit: str, chosen: Column) -> DataFrame:
    """doc, old_pos (null: a new row), pos, level, changed."""
    kind, run_edit = df.schema[doc].dataType.simpleString(), EDITS[edit]

    def run(rows: list[tuple]) -> list[tuple]:
        order = run_edit([r[2] for r in rows], {i for i, r in enumerate(rows) if r[3]})
        changed = order is not None
        return [(rows[0][0], None if i is None else rows[i][1], place, level, changed) for place, (i, level) in enumerate(order if changed else _same([r[2] for r in rows]))]

    held = df.select(doc, F.col(pos).cast("long").alias("__pos"), F.col(level).cast("int").alias("__level"), F.coalesce(chosen, F.lit(False)).alias("__chosen"))
    return per_group(held, [doc], ["__pos"], run, f"{doc} {kind}, old_pos long, pos int, level int, changed boolean")


def merged(rows: DataFrame, more: DataFrame, doc: str, pos: str, level: str, mode: str, *, after: int | None = None) -> DataFrame:
    """Two drafts as one, positions from 0 and levels clamped: ``replace``, ``append``, or ``insert`` behind the row at ``after``."""
    if mode == "replace":
        both = more.withColumn("__k", F.lit(0))
    elif mode == "append":
        both = rows.withColumn("__k", F.lit(0)).unionByName(more.withColumn("__k", F.lit(1)))
    else:
        both = rows.withColumn("__k", F.when(F.col(pos) <= after, 0).otherwise(2)).unionByName(more.withColumn("__k", F.lit(1)))
    placed = both.withColumn(pos, F.row_number().over(Window.partitionBy(doc).orderBy("__k", pos)) - 1).drop("__k")
    return level_clamp(placed, doc, pos, level, out=level)
