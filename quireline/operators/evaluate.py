"""Scores of outlines against a truth: alignment of ordered lists, error rates and suite summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireline.functions.text import error_rate
from quireline.operators.grouped import per_group


def _distance(a: str, b: str) -> int:
    """Edit distance, a column of the table at a time: its steps up and down are the bits of two numbers."""
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    last, mask = 1 << len(a) - 1, (1 << len(a)) - 1
    up, down, score = mask, 0, len(a)
    for y in b:
        same = places.get(y, 0)
        level = (((same & up) + up) ^ up) | same | down
        more, less = down | ~(level | up) & mask, up & level
        score += (more & last > 0) - (less & last > 0)
        more, less = (more << 1 | 1) & mask, less << 1 & mask
        up, down = less | ~(level | more) & mask, more & level
    return score


def rate(got: str, truth: str) -> float:
    return min(1.0, _distance(got, truth) / len(truth)) if truth else float(bool(got))


def align(got: list[str], truth: list[str], *, gap: float = 1.0, most: float = 0.5) -> list[tuple[int | None, int | None, float]]:
    """Global alignment of two ordered lists: (place in got, place in truth, error rate); a pair needs a rate of at most ``most``."""
    n, m = len(got), len(truth)
    cost = [[0.0] * (m + 1) for _ in range(n + 1)]
    back = [[""] * (m + 1) for _ in range(n + 1)]
    rates = {}
    for i in range(n + 1):
        for j in range(m + 1):
            options = []
            if i and j:
                r = rates[i, j] = rate(got[i - 1], truth[j - 1])
                if r <= most:
                    options.append((cost[i - 1][j - 1] + r, "pair"))
            if i:
                options.append((cost[i - 1][j] + gap, "got"))
            if j:
                options.append((cost[i][j - 1] + gap, "truth"))
            if options:
                cost[i][j], back[i][j] = min(options, key=lambda o: o[0])
    out, i, j = [], n, m
    while i or j:
        step = back[i][j]
        if step == "pair":
            i, j = i - 1, j - 1
            out.append((i, j, rates[i + 1, j + 1]))
        elif step == "got":
            i -= 1
            out.append((i, None, 1.0))
        else:
            j -= 1
            out.append((None, j, 1.0))
    return out[::-1]


def _both(got: DataFrame, truth: DataFrame, doc: str, order: str, title: str) -> DataFrame:
    """Rows of both sides, told apart by ``__side`` (0: got)."""
    one = lambda df, n: df.select(doc, F.lit(n).alias("__side"), order, F.coalesce(title, F.lit("")).alias("__t"))
    return one(got, 0).unionByName(one(truth, 1))


def align_entries(got: DataFrame, truth: DataFrame, doc: str, order: str, title: str) -> DataFrame:
    """doc, got_pos, truth_pos, cer: the alignment of each document's titles. Documents of either side are there."""

    def run(rows: list[tuple]) -> list[tuple]:
        sides = [[r for r in rows if r[1] == n] for n in (0, 1)]
        at = lambda side, i: None if i is None else sides[side][i][2]
        return [(rows[0][0], at(0, i), at(1, j), float(cer)) for i, j, cer in align(*([r[3] for r in side] for side in sides))]

    held = _both(got, truth, doc, order, title)
    kind, document = (held.schema[c].dataType.simpleString() for c in (order, doc))
    return per_group(held, [doc], ["__side", order], run, f"{doc} {document}, got_pos {kind}, truth_pos {kind}, cer double")


def sequential_matches(got: DataFrame, truth: DataFrame, doc: str, order: str, title: str, *, ahead: int = 6, most: float = 0.5) -> DataFrame:
    """Each truth entry in turn takes the first of the next ``ahead`` unused titles with a rate of at most ``most``."""

    def run(rows: list[tuple]) -> list[tuple]:
        mine, out, at = [r for r in rows if r[1] == 0], [], 0
        for key, side, pos, text in rows:
            if side:
                hit = next((i for i in range(at, min(len(mine), at + ahead)) if rate(mine[i][3], text) <= most), None)
                out.append((key, pos, None if hit is None else mine[hit][2]))
                at = at if hit is None else hit + 1
        return out

    held = _both(got, truth, doc, order, title)
    kind, document = (held.schema[c].dataType.simpleString() for c in (order, doc))
    return per_group(held, [doc], ["__side", order], run, f"{doc} {document}, truth_pos {kind}, got_pos {kind}")


def outline_score(pairs: DataFrame, doc: str, *, got_title: str, truth_title: str, got_page: str, truth_page: str, got_level: str, truth_level: str, most: float = 0.05) -> DataFrame:
    """Per document of aligned rows (a missing side is null): entries, found, correct, extras, mean error rate, page and level shares, exact."""
    there, found = F.col(truth_title).isNotNull(), F.col(truth_title).isNotNull() & F.col(got_title).isNotNull()
    cer = F.when(found, error_rate(F.col(got_title), F.col(truth_title))).when(there, 1.0)
    right_page = found & F.col(got_page).eqNullSafe(F.col(truth_page))
    held = pairs.withColumn("__cer", cer).groupBy(doc).agg(
        F.count_if(there).alias("entries"),
        F.count_if(found).alias("found"),
        F.count_if(right_page & (F.col("__cer") <= most)).alias("correct"),
        F.count_if(~there).alias("extras"),
        F.round(F.avg("__cer"), 6).alias("mean_cer"),
        F.round(F.count_if(right_page) / F.count_if(there), 6).alias("page_share"),
        F.round(F.count_if(found & (F.col(got_level) == F.col(truth_level))) / F.count_if(there), 6).alias("level_share"),
    )
    return held.withColumn("exact", (F.col("correct") == F.col("entries")) & (F.col("extras") == 0))


def suite_summary(scores: DataFrame, *, least_pages: float = 0.97, least_levels: float = 0.95, most_cer: float = 0.03) -> DataFrame:
    """One row: means over documents, how many are exact or miss a goal, and the verdict."""
    missed = (F.col("page_share") < least_pages) | (F.col("level_share") < least_levels) | (F.col("mean_cer") > most_cer)
    held = scores.agg(
        F.count("*").alias("documents"),
        F.count_if("exact").alias("exact"),
        F.count_if(missed).alias("missed"),
        F.round(F.avg("mean_cer"), 6).alias("mean_cer"),
        F.round(F.avg("page_share"), 6).alias("page_share"),
        F.round(F.avg("level_share"), 6).alias("level_share"),
    )
    return held.withColumn("verdict", F.when(F.col("missed") == 0, "pass").otherwise("fail"))


def first_difference(left: DataFrame, right: DataFrame, doc: str, pos: str, columns: list[str]) -> DataFrame:
    """Per document, the first position at which two outlines differ, or null if they are equal."""
    a = left.select(doc, pos, F.struct(*columns).alias("__a"))
    b = right.select(doc, pos, F.struct(*columns).alias("__b"))
    both = a.join(b, [doc, pos], "full")
    return both.groupBy(doc).agg(F.min(F.when(~F.col("__a").eqNullSafe(F.col("__b")), F.col(pos))).alias("first_difference"))
