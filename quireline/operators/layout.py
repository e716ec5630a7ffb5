"""Geometry of recognised text: boxes with min_x, min_y, max_x, max_y (y grows down), lines, columns and skew.

Boxes of a page are few, so pages are the unit: joins within a page are equality joins, and greedy grouping is one Python call per page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Largest baseline angle of upright text, and largest skew that is corrected (radians).
UPRIGHT, LARGEST_SKEW = 3.141592653589793 / 3, 5 * 3.141592653589793 / 180


def area(box: str = "") -> Column:
    p = f"{box}." if box else ""
    return (F.col(f"{p}max_x") - F.col(f"{p}min_x")) * (F.col(f"{p}max_y") - F.col(f"{p}min_y"))


def overlap(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Shared length over the smaller length."""
    shared = F.greatest(F.lit(0.0), F.least(high_a, high_b) - F.greatest(low_a, low_b))
    return shared / F.least(high_a - low_a, high_b - low_b)


def shared_area(a: str, b: str) -> Column:
    wide = F.least(F.col(f"{a}.max_x"), F.col(f"{b}.max_x")) - F.greatest(F.col(f"{a}.min_x"), F.col(f"{b}.min_x"))
    tall = F.least(F.col(f"{a}.max_y"), F.col(f"{b}.max_y")) - F.greatest(F.col(f"{a}.min_y"), F.col(f"{b}.min_y"))
    return F.greatest(wide, F.lit(0.0)) * F.greatest(tall, F.lit(0.0))


def upright(df: DataFrame, angle: str = "angle") -> DataFrame:
    return df.filter(F.abs(angle) <= UPRIGHT)


def misoriented_share(df: DataFrame, page: list[str], *, angle: str = "angle") -> DataFrame:
    """Share of the text's width that is turned by more than 45 degrees."""
    width = F.col("max_x") - F.col("min_x")
    return df.groupBy(*page).agg((F.sum(F.when(F.abs(angle) > F.lit(3.141592653589793 / 4), width).otherwise(0.0)) / F.sum(width)).alias("misoriented"))


def drop_contained(df: DataFrame, page: list[str], key: str, text: str, *, least: float = 0.7) -> DataFrame:
    """Without observations whose text is part of another's and whose box is covered by it to ``least``; of equal texts the smallest key stays.

    Equal texts with equal boxes are one class, and classes are compared where ``contained`` finds that one text may be part of the other: pages may
    be large. This is done at once; texts and classes stay on the executors' disks, and the class and key of each row that stays."""
    from pyspark import StorageLevel

    from quireline.operators import contained

    sides = ["min_x", "min_y", "max_x", "max_y"]
    names = [f"__p{i}" for i in range(len(page))]
    place = F.to_json(F.struct(*(F.col(c).alias(n) for c, n in zip(page, names, strict=True)))).cast("binary")
    usable = F.col(key).isNotNull() & F.col(text).isNotNull()
    for c in page:
        usable = usable & F.col(c).isNotNull()
    tid = F.unhex(F.sha2(F.concat(place, F.lit(b"\0"), F.col(text).cast("binary")), 256))
    cid = F.unhex(F.sha2(F.concat(F.col("__tid"), F.to_json(F.struct(*sides)).cast("binary")), 256))
    named = df.withColumn("__tid", F.when(usable, tid)).withColumn("__cid", cid)
    rows = named.filter(F.col("__tid").isNotNull()).select("__cid", "__tid", F.col(key).alias("key"), *(F.col(c).alias(n) for c, n in zip(page, names, strict=True)), F.octet_length(text).alias("size"), *sides)
    same = [*names, "size", *sides]
    classes = rows.groupBy("__cid", "__tid").agg(*(F.first(c).alias(c) for c in same), F.min("key").alias("low"), F.max("key").alias("high")).persist(StorageLevel.DISK_ONLY)
    texts = named.filter(F.col("__tid").isNotNull()).select(F.col("__tid").alias("id"), F.xxhash64(*page).alias("grp"), F.col(text).alias("text")).dropDuplicates(["id"]).persist(StorageLevel.DISK_ONLY)
    covered = lambda a, b: F.coalesce(shared_area(a, b) >= least * area(a), F.lit(False))
    own = classes.alias("a").withColumn("whole", covered("a", "a"))
    odd = own.filter(~F.col("whole")).select("__cid").join(rows, "__cid").select("__cid", "__tid", "key", *same).distinct()
    asked = own.filter("whole").select("__cid", "__tid", F.col("low").alias("key"), *same).unionByName(odd).persist(StorageLevel.DISK_ONLY)

    def of(a: DataFrame, b: DataFrame, met: Column) -> DataFrame:
        """Rows of both whose boxes and pages fit."""
        for n in names:
            met = met & (F.col(f"a.{n}") == F.col(f"b.{n}"))
        return a.alias("a").join(b.alias("b"), met & covered("a", "b")).select(F.col("a.__cid").alias("__cid"), F.col("a.key").alias("key"), F.col("a.__tid").alias("tid_a"), F.col("b.__tid").alias("tid_b"))

    def inside(pairs: DataFrame, left: DataFrame) -> DataFrame:
        """Class and key of those of ``left`` whose text is part of the other of its ``pairs`` (tid_a, tid_b)."""
        met = (F.col("a.tid_b") == F.col("b.__tid")) & (F.col("a.size") < F.col("b.size")) & ((F.col("a.key") != F.col("b.low")) | (F.col("a.key") != F.col("b.high")))
        fit = of(left.join(pairs.withColumnRenamed("tid_a", "__tid"), "__tid"), classes, met)
        two = fit.select("tid_a", "tid_b").distinct().join(texts.select(F.col("id").alias("tid_a"), F.col("text").alias("x")), "tid_a").join(texts.select(F.col("id").alias("tid_b"), F.col("text").alias("y")), "tid_b")
        return fit.join(two.filter(F.col("y").contains(F.col("x"))).select("tid_a", "tid_b"), ["tid_a", "tid_b"]).select("__cid", "key").distinct()

    equal = of(asked, classes, (F.col("a.__tid") == F.col("b.__tid")) & (F.col("a.__cid") != F.col("b.__cid")) & (F.col("b.low") < F.col("a.key"))).select("__cid", "key").distinct()
    left = asked.join(equal, ["__cid", "key"], "left_anti").persist(StorageLevel.DISK_ONLY)
    anchors, marks = contained.candidates(texts, texts)
    marks = marks.join(anchors.select("anchor").distinct(), "anchor").persist(StorageLevel.DISK_ONLY)
    longest = marks.groupBy("anchor").agg(F.max(F.struct("size", "id")).alias("most"))
    asks = anchors.select(F.col("id").alias("tid_a"), "anchor")
    first = inside(asks.join(longest, "anchor").select("tid_a", F.col("most.id").alias("tid_b")), left)
    left = left.join(first, ["__cid", "key"], "left_anti").persist(StorageLevel.DISK_ONLY)
    sized = asks.join(left.select(F.col("__tid").alias("tid_a"), "size").distinct(), "tid_a")
    others = sized.alias("s").join(marks.alias("m"), (F.col("s.anchor") == F.col("m.anchor")) & (F.col("s.size") < F.col("m.size"))).select("tid_a", F.col("id").alias("tid_b"))
    stays = left.join(inside(others, left), ["__cid", "key"], "left_anti").select("__cid", F.col("key").alias("__key"), F.lit(True).alias("__stays")).persist(StorageLevel.DISK_ONLY)
    held = named.alias("a").join(stays.alias("b"), (F.col("a.__cid") == F.col("b.__cid")) & (F.col(f"a.{key}") == F.col("b.__key")), "left")
    return held.filter(F.col("__tid").isNull() | F.col("__stays")).select("a.*").drop("__tid", "__cid")


def estimate_skew(df: DataFrame, page: list[str], *, angle: str = "angle", long: float = 5.0) -> DataFrame:
    """Median angle of boxes at least ``long`` times as wide as high, three at least; 0 otherwise and beyond five degrees."""
    wide = df.filter((F.col("max_x") - F.col("min_x")) >= long * (F.col("max_y") - F.col("min_y")))
    found = wide.groupBy(*page).agg(F.median(angle).alias("m"), F.count("*").alias("n"))
    good = (F.col("n") >= 3) & (F.abs("m") <= LARGEST_SKEW)
    return df.select(*page).distinct().join(found, page, "left").select(*page, F.when(good, F.col("m")).otherwise(0.0).alias("skew"))


def theil_sen(df: DataFrame, group: list[str], x: str, y: str, key: str) -> DataFrame:
    """Median of the slopes of all pairs of points with different ``x`` (within a small group such as a page's number column)."""
    pairs = F.flatten(F.transform("p", lambda a, i: F.transform(F.slice("p", i + 2, F.greatest(F.size("p") - i - 1, F.lit(0))), lambda b: F.when(b["x"] != a["x"], (b["y"] - a["y"]) / (b["x"] - a["x"])))))
    held = df.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("p"))
    return held.select(*group, F.explode(pairs).alias("slope")).filter("slope IS NOT NULL").groupBy(*group).agg(F.median("slope").alias("slope"), F.count("*").alias("n_pairs"))


def number_column_skew(df: DataFrame, page: list[str], *, x: str, y: str, width: Column, height: Column, tolerance: Column) -> DataFrame:
    """Per page, the skew that its column of page numbers shows, in radians, or null. The numbers are those within a twentieth of the width of the
    rightmost; four at least, over a quarter of the height. The slope is the median over pairs a tenth of the height apart, and three
    quarters of the numbers have to lie within ``tolerance`` of the line; no more than five degrees."""
    from math import atan
    from statistics import median

    from quireline.operators.grouped import per_group

    held = df.select(*page, *(c.cast("double").alias(n) for c, n in ((F.col(x), "__x"), (F.col(y), "__y"), (width, "__w"), (height, "__h"), (tolerance, "__t"))))
    keys = len(page)

    def run(rows: list[tuple]) -> list[tuple]:
        w, h, reach = rows[0][keys + 2 :]
        right = max(r[keys] for r in rows)
        points = [r[keys : keys + 2] for r in rows if r[keys] >= right - 0.05 * w]
        tall = max(p[1] for p in points) - min(p[1] for p in points)
        skew = None
        if len(points) >= 4 and tall >= 0.25 * h:
            slopes = [(b[0] - a[0]) / (b[1] - a[1]) for i, a in enumerate(points) for b in points[i + 1 :] if abs(b[1] - a[1]) >= 0.1 * h]
            if slopes:
                slope = median(slopes)
                start = median(px - slope * py for px, py in points)
                near = sum(abs(px - (start + slope * py)) <= reach for px, py in points)
                skew = 0.0 - atan(slope) if 4 * near >= 3 * len(points) and abs(atan(slope)) <= LARGEST_SKEW else None
        return [(*rows[0][:keys], skew)]

    return per_group(held, page, ["__x", "__y"], run, held.select(*page, F.when(F.lit(False), 0.0).alias("skew")).schema)


def number_column(df: DataFrame, page: list[str], tolerance: float, *, least: int = 3) -> DataFrame:
    """Per page with one, ``left`` and ``right`` of the column of page numbers: the most boxes whose right edges (or, if they are more, left edges)
    lie within ``tolerance``, the leftmost of such sets; ``least`` of them and half of all at least."""
    w = Window.partitionBy(*page)
    held = df.select(*page, *(F.col(c).cast("double").alias(c) for c in ("min_x", "max_x"))).withColumn("__n", F.count("*").over(w))

    def widest(edge: str) -> DataFrame:
        span = f"OVER (PARTITION BY {', '.join(f'`{c}`' for c in page)} ORDER BY {edge} RANGE BETWEEN CURRENT ROW AND {float(tolerance)}D FOLLOWING)"
        each = held.select(*page, "__n", F.col(edge).alias("__from"), *(F.expr(f"{f} {span}").alias(n) for f, n in (("count(1)", "__size"), ("min(min_x)", "left"), ("max(max_x)", "right"))))
        best = F.max_by(F.struct("left", "right", F.col("__size").alias("size")), F.struct(F.col("__size"), -F.col("__from")))
        return each.groupBy(*page).agg(best.alias(f"__{edge}"), F.first("__n").alias(f"__n_{edge}"))

    both = widest("max_x").join(widest("min_x"), page)
    chosen = F.when(F.col("__max_x.size") >= F.col("__min_x.size"), F.col("__max_x")).otherwise(F.col("__min_x"))
    found = both.select(*page, chosen.alias("__c"), F.col("__n_max_x").alias("__n"))
    return found.filter((F.col("__c.size") >= least) & (2 * F.col("__c.size") >= F.col("__n"))).select(*page, "__c.left", "__c.right")


def cover_histogram(df: DataFrame, group: list[str], low: Column, high: Column, bins: int = 200) -> DataFrame:
    """How many boxes span each of ``bins`` equal parts of 0 to 1."""
    first = F.greatest(F.lit(0), F.floor(low * bins)).cast("int")
    last = F.least(F.lit(bins - 1), F.floor(high * bins)).cast("int")
    spread = df.filter(last >= first).select(*group, F.explode(F.sequence(first, last)).alias("bin"))
    return spread.groupBy(*group, "bin").agg(F.count("*").alias("n"))


def histogram_percentile(df: DataFrame, group: list[str], value: str, count: str, share: float) -> DataFrame:
    """First value whose cumulative count is over ``share`` of the total."""
    w = Window.partitionBy(*group)
    held = df.withColumn("__c", F.sum(count).over(w.orderBy(value))).withColumn("__t", F.sum(count).over(w))
    return held.filter(F.col("__c") > share * F.col("__t")).groupBy(*group).agg(F.min(value).alias("percentile"))


def mode_smallest(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Commonest value, the smallest of ties, with its count and its share of the rows."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*group)
    ranked = counts.withColumn("__r", F.row_number().over(w.orderBy(F.desc("n"), value))).withColumn("__t", F.sum("n").over(w))
    return ranked.filter("__r = 1").select(*group, F.col(value).alias("mode"), "n", (F.col("n") / F.col("__t")).alias("purity"))


def group_lines(df: DataFrame, page: list[str], key: str) -> DataFrame:
    """``line`` number of each box: boxes in the order of their middles join the line that they overlap most, vertically by half at least, unless
    they would cover a member horizontally by more than 0.3; else they begin a line."""
    from quireline.operators.grouped import per_group

    middle = (F.col("min_y") + F.col("max_y")) / 2
    held = df.select(*page, key, *(F.col(c).cast("double").alias(c) for c in ("min_x", "min_y", "max_x", "max_y")), middle.alias("__mid"))
    schema = held.drop("__mid").withColumn("line", F.lit(0).cast("int")).schema

    def ratio(a0, a1, b0, b1):
        small = min(a1 - a0, b1 - b0)
        return max(0.0, min(a1, b1) - max(a0, b0)) / small if small > 0 else 0.0

    def run(own: list[tuple]) -> list[tuple]:
        open_lines, out = [], []
        for *head, x0, y0, x1, y1, _ in own:
            best, at = 0.5, None
            for i, (top, bottom, spans) in enumerate(open_lines):
                share = ratio(y0, y1, top, bottom)
                if share >= best and (at is None or share > best) and all(ratio(x0, x1, a, b) <= 0.3 for a, b in spans):
                    best, at = share, i
            if at is None:
                at = len(open_lines)
                open_lines.append((y0, y1, []))
            top, bottom, spans = open_lines[at]
            open_lines[at] = (min(top, y0), max(bottom, y1), [*spans, (x0, x1)])
            out.append((*head, x0, y0, x1, y1, at))
        return out

    return per_group(held, page, ["__mid", "min_x", key], run, schema)


def column_gutter(df: DataFrame, page: list[str], *, bins: int = 200) -> DataFrame:
    """Per page with at least eight boxes: the middle of the widest empty strip between 30 and 70 % of the width, or null for one column.
    Boxes have coordinates as fractions of the page; at least three must lie on each side."""
    counts = cover_histogram(df, page, F.col("min_x"), F.col("max_x"), bins)
    low, high = bins * 3 // 10, bins * 7 // 10
    all_bins = df.groupBy(*page).agg(F.count("*").alias("boxes")).withColumn("bin", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
    empty = all_bins.join(counts, [*page, "bin"], "left_anti")
    w = Window.partitionBy(*page).orderBy("bin")
    strips = empty.withColumn("run", F.col("bin") - F.row_number().over(w)).groupBy(*page, "boxes", "run").agg(F.min("bin").alias("a"), (F.max("bin") + 1).alias("b"))
    middle = ((F.col("a") + F.col("b")) / (2.0 * bins)).alias("gutter")
    sided = df.join(strips.filter("boxes >= 8").select(*page, "a", "b", middle), page)
    scored = sided.groupBy(*page, "a", "b", "gutter").agg(F.count_if(F.col("max_x") <= F.col("gutter")).alias("left"), F.count_if(F.col("min_x") >= F.col("gutter")).alias("right"))
    good = scored.filter("left >= 3 AND right >= 3")
    best = good.groupBy(*page).agg(F.max_by("gutter", F.struct(F.col("b") - F.col("a"), F.col("right"), -F.col("a"))).alias("gutter"))
    return df.select(*page).distinct().join(best, page, "left")


def deskew(df: DataFrame, angle: Column, centre_x: Column, centre_y: Column) -> DataFrame:
    """Boxes turned back by ``angle`` about a centre; the box of the turned corners."""
    cos, sin = F.cos(-angle), F.sin(-angle)
    corners = F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x in ("min_x", "max_x") for y in ("min_y", "max_y")))
    xs = F.transform(corners, lambda c: centre_x + (c["x"] - centre_x) * cos - (c["y"] - centre_y) * sin)
    ys = F.transform(corners, lambda c: centre_y + (c["x"] - centre_x) * sin + (c["y"] - centre_y) * cos)
    held = df.withColumn("__x", xs).withColumn("__y", ys)
    return held.withColumns({"min_x": F.array_min("__x"), "max_x": F.array_max("__x"), "min_y": F.array_min("__y"), "max_y": F.array_max("__y")}).drop("__x", "__y")
