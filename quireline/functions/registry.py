"""Functions by name for SQL: ``register(spark)`` once, then ``SELECT toc_page(line).page.value FROM ...``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quireline.functions import headings, numerals, ocr, tokens


def _over(kind: str, one):
    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else one(v))

    return run


def register(spark: SparkSession) -> list[str]:
    """Names of what is now known to SQL."""

    @F.pandas_udf(tokens.SPLIT_TYPE)
    def toc_page(lines: pd.Series) -> pd.DataFrame:
        from dataclasses import asdict

        return pd.DataFrame([asdict(tokens.split_page(x or "")) for x in lines], columns=["title", "page", "noise", "gibberish", "wide"])

    @F.pandas_udf(headings.HEADING_TYPE)
    def toc_heading(titles: pd.Series) -> pd.DataFrame:
        from dataclasses import asdict

        rows = [asdict(headings.classify(x or "")) for x in titles]
        return pd.DataFrame([r | {"numbers": list(r["numbers"])} for r in rows], columns=["kind", "numbers", "keyword", "ocr", "circled"])

    own = {
        "toc_page": toc_page,
        "toc_heading": toc_heading,
        "chinese_number": _over("int", numerals.chinese_number),
        "chinese_numeral": _over("string", numerals.chinese_numeral),
        "roman_number": _over("int", numerals.roman_value),
        "roman_numeral": _over("string", numerals.roman_string),
        "english_number": _over("int", numerals.english_number),
        "any_number": _over("int", numerals.any_number),
        "title_key": _over("string", ocr.normalized),
        "clean_title": _over("string", ocr.clean_title),
    }
    for name, function in own.items():
        spark.udf.register(name, function)
    return sorted(own)
