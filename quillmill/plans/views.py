"""Inputs derived from the driver's tables: pages, pairs, spans, usage and events.

The tables hold no documents with layout or Markdown, so views build them by fixed rules over whole
tables; the SQL that oracles use builds the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables whose rows are worth more work than a shuffle, and the size up to which they are dealt out.
TEXTS, SPREAD_BYTES = ("documents", "pages"), 128 << 20


def size_hint(df: DataFrame) -> int:
    """The planner's estimate of df's bytes, without a job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in TEXTS and size_hint(df) < SPREAD_BYTES:
        # a small file is one row group, which one task would read and work on alone
        df = df.repartition(spark.sparkContext.defaultParallelism)
    return df


def pick(n: Column, options: list[str]) -> Column:
    """The option that n modulo their number selects."""
    return F.element_at(F.array(*(F.lit(x) for x in options)), (F.pmod(n, F.lit(len(options))) + 1).cast("int"))


#: A table that a transcription may have more than the text layer, as of an image on the page.
TABLE = "\n| tafelwort | 77,123 |\n| zusatzwort zusatzwort | 5 |"


def docpair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, native and md: a text and its transcription, changed in one of five ways, some with a table
    more, some marked as notes, OCR or cut off."""
    d, t = F.col("doc_id"), F.col("text")
    md = (
        F.when(d % 5 == 0, t)
        .when(d % 5 == 1, F.concat(t, F.lit(" 4,711")))
        .when(d % 5 == 2, F.expr("substr(text, instr(text, chr(10)) + 1)"))
        .when(d % 5 == 3, F.concat(t, F.lit(" zusatzwort")))
        .otherwise(F.concat(F.lit("<!-- page number: "), d.cast("string"), F.lit(" -->\n"), t, F.lit("\n$$ x = "), (d % 97).cast("string"), F.lit(" $$")))
    )
    md = F.when(d % 13 == 4, F.concat(md, F.lit(TABLE))).otherwise(md)
    mark = F.when(d % 17 == 0, "\n<!-- source: study notes -->").when(d % 23 == 0, "\n<!-- source: local OCR -->").when(d % 29 == 0, "\n<!-- truncated -->").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("native"), F.concat(md, mark).alias("md"))


#: Faults, and their faultless likes, that markup() appends to documents in turn.
MARKUP = [
    "plain closing line",
    "$$ a + b",
    "$$ a\n\nb $$",
    "$$ a *[sic: b]* $$",
    r"$$ a \tag{1} \\ b \tag{2} $$",
    r"\begin{aligned} x \end{aligned} \begin{cases} y",
    "[^1]: 1",
    "[^2]: text missing from image",
    "[^3]: A whole note with its own words.",
    "as shown.$^{12}$ and m$^2$",
    "[^8]Text of a note",
    r"| a | \multicolumn{2}{c}{b} |",
    "see [Exercise 9.29](Exercise 9.29) here",
    'see [site](http://x.y "title") here',
    "cost $ $12.50, later $7.10 and $x+1$",
    "> quoted (15A.2) Table D.5\n\nExample 15.7 <!-- note 3 --> $a_1$",
    "code `a $x$ b` and\n```\ncost $5\n```\nend <!-- $y$ --> after",
    r"paid \$7 and $\$8 + b$ here",
    "[^5]: \r",
    "[^6]: \t\r",
]


def markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a piece of markup at their end; every seventh is one line after an amount."""
    line = F.concat(F.lit("Price $5 "), F.translate("text", "\n", " "))
    whole = F.when(F.col("doc_id") % 7 == 3, line).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(whole, F.lit("\n\n"), pick(F.col("doc_id"), MARKUP)).alias("md"))


#: Models of calls: two that are listed, one local and one that no list has.
MODELS = ["gemini-3.6-flash", "gpt-5.4-mini", "local", "unheard-of"]


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, model, prompt, completion and total tokens of model calls; null for every 13th."""
    e, v = F.col("event_id"), F.floor(F.abs("value") * 10).cast("long")
    seen = e % 13 != 0
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", pick(e, MODELS).alias("model"), F.when(seen, 900 + e % 700).alias("prompt"), F.when(seen, 200 + v % 400).alias("completion"), F.when(seen, 1100 + e % 700 + v % 900).alias("total")
    )


def page_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, run, kind and page: a feed of page events for each run."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 50).alias("run"), pick(e, ["page_start", "page_done", "page_done", "page_failed", "image_done"]).alias("kind"), (e % 400 + 1).alias("page"))


def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_no, xref, x0, y0, x1, y1 in points."""
    k, p = F.col("l_orderkey"), F.col("l_partkey")
    x0, y0 = (p % 400).cast("double"), (F.col("l_suppkey") % 500).cast("double")
    return table(spark, sf_dir, "lineitem").select(
        (k % 997).alias("doc_id"), (k % 89 + 1).alias("page_no"), (k * 10 + F.col("l_linenumber")).alias("xref"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity") * 3 + p % 2).alias("x1"), (y0 + (p % 130)).alias("y1")
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, y, x0, x1, text, bold: positioned text."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    x0 = (F.col("l_suppkey") % 100).cast("double") * 5
    return table(spark, sf_dir, "lineitem").select(
        k.alias("page"), (F.floor((n - 1) / 2) * 12).cast("double").alias("y"), x0.alias("x0"), (x0 + F.col("l_quantity")).alias("x1"), F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("text"), (F.col("l_linestatus") == "O").alias("bold"), n.alias("n")
    )


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ord, level, title, start and text_above: bookmarks of documents."""
    c, t = F.col("conv_id"), F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        c.alias("doc_id"), t.alias("ord"), (F.when(F.col("role") == "user", 1).otherwise(2) + (c + t) % 2).cast("int").alias("level"), F.concat(F.lit("Section "), t.cast("string")).alias("title"), (t * 3 + 1).alias("start"), ((c + t) % 3 == 0).alias("text_above")
    )
