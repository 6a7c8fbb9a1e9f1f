"""The functions of this library for Spark SQL: SQL functions, which the planner sees through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import page_check, text

_PLAIN = f"regexp_replace(lower(w), '{text.LIGATURES}', '')"
_WORDS = f"filter(transform(regexp_extract_all(t, '{text.WORD}', 0), w -> {_PLAIN}), w -> length(w) >= 3)"
_NUMBERS = f"flatten(transform(regexp_extract_all(t, r'{text.NUMBER}', 0), x -> CASE WHEN x RLIKE r'{text.THOUSANDS}' THEN array(replace(x, ',', '')) ELSE split(x, ',') END))"


def register(spark: SparkSession) -> None:
    """word_list, number_list (arrays), and bag_diff (a table function of two texts)."""
    for name, body in (("word_list", _WORDS), ("number_list", _NUMBERS)):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS ARRAY<STRING> RETURN {body}")
    count = "SELECT token, count(*) AS n FROM (SELECT explode({}) AS token) GROUP BY token"
    words = lambda c: _WORDS.replace("all(t,", f"all({c},")
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION bag_diff(native STRING, md STRING) RETURNS TABLE(token STRING, missing BIGINT, extra BIGINT)
        RETURN SELECT token, greatest(sum(a) - sum(b), 0) AS missing, greatest(sum(b) - sum(a), 0) AS extra FROM (
          SELECT token, n AS a, 0L AS b FROM ({count.format(words("native"))}) UNION ALL SELECT token, 0L AS a, n AS b FROM ({count.format(words("md"))})) GROUP BY token HAVING sum(a) <> sum(b)"""
    )


def check_view(spark: SparkSession, pages: str, name: str, image_on_page: str = "false") -> DataFrame:
    """Makes a temporary view of the pages of another (native, md, ...) with their checks."""
    checked = page_check.check_pages(spark.table(pages), F.expr(image_on_page))
    checked.createOrReplaceTempView(name)
    return checked
