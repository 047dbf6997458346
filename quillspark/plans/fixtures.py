"""Tables of the test data, and parameter tables in Latin script for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: SQL of cleaned and normalised text, as DuckDB writes it.
def sql_clean(x: str) -> str:
    return f"replace(regexp_replace({x}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), chr(12288), ' ')"


SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def sql_compact(x: str) -> str:
    return sql_strip(f"regexp_replace({sql_clean(x)}, '{SPACE}+', ' ', 'g')")


def sql_strip_heading(x: str) -> str:
    out = sql_strip(sql_clean(x))
    for pattern in (r"^\d+\s*、\s*", r"^\d+-[a-zA-Z]\s*", r"^\d+\s*[.-]\s*", r"^[(（]\d+[)）]\s*"):
        out = f"regexp_replace({out}, '{pattern}', '')"
    out = f"regexp_replace({out}, '^【|】$', '', 'g')"
    return sql_strip(f"regexp_replace({sql_strip(out)}, '[(（].*?[)）]', '', 'g')")
