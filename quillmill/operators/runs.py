"""Run control: resumption, cost, budget, assembly, progress, replies and the catalog of models."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.page_check import CUT_MARK
from . import catalog

TOKENS_PER_PAGE = (1500, 600)
SHARED_MEMORY = 0.66
CAPS = (4096, 16384)
# What a server says to a cap beyond its own, and what marks a page that was cut off.
TOO_LARGE = r"(?i)max_tokens|context|too large"
CUT_OFF = f"\n\n{CUT_MARK}\n*[cut off: the model's answer ended before the page did]*"


def todo(selected: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The selected pages that have no output yet."""
    return selected.join(done.select(*keys), keys, "left_anti")


def billed_out(prompt: Column, completion: Column, total: Column) -> Column:
    """Output tokens billed: hidden ones show only in the total."""
    zero = F.lit(0)
    return F.greatest(F.coalesce(completion, zero), F.coalesce(total, zero) - F.coalesce(prompt, zero))


def meter(usage: DataFrame, keys: list[str]) -> DataFrame:
    """Calls and tokens; rows without usage don't count."""
    u = usage.filter("prompt is not null or completion is not null or total is not null")
    return u.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum(F.coalesce("prompt", F.lit(0))).alias("tokens_in"), F.sum(billed_out(F.col("prompt"), F.col("completion"), F.col("total"))).alias("tokens_out"))


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    return (tokens_in * price_in + tokens_out * price_out) / F.lit(1e6)


def within_budget(calls: DataFrame, keys: list[str], order: list, spent: Column, budget: float) -> DataFrame:
    """The calls of each run that are made before the spending so far is over the budget (0: none)."""
    if not budget:
        return calls
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return calls.withColumn("_before", F.coalesce(F.sum(spent).over(w), F.lit(0))).filter(F.col("_before") <= budget).drop("_before")


def assemble(pages: DataFrame, key: str, header: Column) -> DataFrame:
    """One document of each key: header, then the pages in order of number."""
    body = F.array_sort(F.collect_list(F.struct("page_no", "md")))
    return pages.groupBy(key).agg(F.concat(F.first(header), F.array_join(F.transform(body, lambda p: p["md"]), ""), F.lit("\n")).alias("document"))


def progress(events: DataFrame, key: str, order: list, total: Column, seconds: Column, prior: Column) -> DataFrame:
    """Each event with what is done, failed and spent so far, and the seconds left: measured from
    this run's own pages, or from a prior figure while there are none."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    count = lambda *kinds: F.sum(F.col("kind").isin(*kinds).cast("long")).over(w)
    e = events.withColumns({"done": count("page_done", "image_done"), "failed": count("page_failed"), "elapsed": seconds})
    ended = F.col("done") + F.col("failed")
    left = F.greatest(F.lit(0).cast("long"), total - ended)
    eta = F.when(ended > 0, left * (F.col("elapsed") / ended)).otherwise(left * prior)
    return e.withColumns({"remaining": left, "eta": F.bround(eta, 0).cast("long")})


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], gone: Column) -> DataFrame:
    """stored with new rows in place of those of their keys; new rows marked gone only delete."""
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(new.filter(~gone))


def newest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def free_names(names: DataFrame, order: list[str]) -> DataFrame:
    """names (name, ...) with folder: the name, or the first of `name (2)`, `name (3)`, ... that no
    folder before it in the order has, without regard to case.

    Equal names are numbered by a window. Only where a name that was given looks like a numbered one
    (`a (2)` beside `a`) do folders depend on each other; such families, few, are named one by one."""
    root = F.lower(F.regexp_replace("name", r"( \(\d+\))+$", ""))
    family, equal = Window.partitionBy("_root"), Window.partitionBy(F.lower("name")).orderBy(*order)
    n = names.withColumn("_root", root).withColumn("_mixed", F.min(F.lower("name")).over(family) != F.max(F.lower("name")).over(family))
    k = F.row_number().over(equal)
    plain = n.filter(~F.col("_mixed")).withColumn("folder", F.when(k == 1, F.col("name")).otherwise(F.concat("name", F.lit(" ("), k.cast("string"), F.lit(")"))))

    def one_by_one(group):
        group, taken, folders = group.sort_values(order), set(), []
        for name in group["name"]:
            free = next(x for x in (name if k == 1 else f"{name} ({k})" for k in itertools.count(1)) if x.lower() not in taken)
            taken.add(free.lower())
            folders.append(free)
        return group.assign(folder=folders)

    mixed = n.filter("_mixed").groupBy("_root").applyInPandas(one_by_one, plain.schema)
    return plain.unionByName(mixed).drop("_root", "_mixed")


def pulled(events: DataFrame, key: str) -> DataFrame:
    """Bytes of a download: each layer's latest figures, summed."""
    e = events.filter("digest is not null and total is not null")
    each = e.groupBy(key, "digest").agg(F.max(F.struct("seq", "completed", "total")).alias("last"))
    return each.groupBy(key).agg(F.sum("last.completed").alias("completed"), F.sum("last.total").alias("total"))


def integrated(vendor: Column, name: Column, dedicated: Column) -> Column:
    n = F.lower(F.concat(F.lit(" "), name, F.lit(" ")))
    return (dedicated < 1.0) | (vendor == "AMD") & ~n.contains(" rx ") & ~n.contains("pro w")


def recommend(systems: DataFrame) -> DataFrame:
    """The largest local model that fits each system (sys, ram_gb, card_gb, unified), and where it
    runs. The catalog is a constant of three rows."""
    models = F.broadcast(catalog.local_models(systems.sparkSession))
    where = F.when(F.col("card_gb") >= F.col("need_card"), "graphics card").when(F.col("unified") & (F.col("ram_gb") * SHARED_MEMORY >= F.col("need_card")), "shared memory").when(F.col("ram_gb") >= F.col("need_ram"), "processor")
    fits = systems.join(models, where.isNotNull()).withColumn("runs_on", where)
    best = fits.groupBy("sys").agg(F.max(F.struct("size", "model", "runs_on")).alias("b"))
    return systems.select("sys").join(best, "sys", "left").select("sys", F.col("b.model").alias("model"), F.col("b.runs_on").alias("runs_on"))


def gpu_rows(lines: DataFrame) -> DataFrame:
    """name, dedicated_gb and driver from `name, MiB, driver` lines; other lines are skipped."""
    p = F.transform(F.split("line", ","), lambda x: F.trim(x))
    rows = lines.select(p.alias("p")).filter(F.size("p") >= 3).select(F.col("p")[0].alias("name"), F.expr("try_cast(p[1] AS double)").alias("mib"), F.col("p")[2].alias("driver"))
    return rows.filter("mib is not null").select("name", F.bround(F.col("mib") / 1024, 2).alias("dedicated_gb"), "driver")


def resolve_replies(replies: DataFrame, max_attempts: int = 5) -> DataFrame:
    """key, text, outcome (ok, truncated, refused, failed) and attempts used, from rows of (key,
    attempt, text, finish_reason, and error: what a call failed with, if there is such a column): a fold
    over each key's replies in order. A cut-off reply asks again with the larger cap, which uses up an
    attempt; an empty or failed one asks again; a refusal ends. Where the larger cap is cut off too, or the
    server won't take it, the longest partial reply stands, under a mark."""
    error = F.col("error") if "error" in replies.columns else F.lit(None).cast("string")
    failed = error.isNotNull()
    body = F.when(failed, "").otherwise(T.strip_fence(F.coalesce("text", F.lit(""))))
    cut, no = ~failed & T.cut_off(F.col("finish_reason")), ~failed & T.refused(F.coalesce("finish_reason", F.lit("")))
    reply = F.struct("attempt", body.alias("text"), cut.alias("cut"), no.alias("refused"), T.has_content(body).alias("full"), F.coalesce(error.rlike(TOO_LARGE), F.lit(False)).alias("too_large"))
    seq = replies.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(reply)), 1, max_attempts).alias("r"))
    kind = "struct<text:string,partial:string,outcome:string,step:int,used:int>"
    start = F.from_json(F.lit('{"partial":"","step":0,"used":0}'), kind)

    def step(s, r):
        longer = F.when(r["cut"] & r["full"] & (F.length(r["text"]) > F.length(s["partial"])), r["text"]).otherwise(s["partial"])
        at_cap = r["cut"] & (s["step"] >= len(CAPS) - 1)
        outcome = (
            F.when(s["outcome"].isNotNull(), s["outcome"])
            .when(r["too_large"] & (s["step"] > 0) & (s["partial"] != ""), "truncated")
            .when(r["cut"] & ~at_cap, None)
            .when(at_cap & (longer != ""), "truncated")
            .when(~r["full"] & r["refused"], "refused")
            .when(~r["full"], None)
            .otherwise("ok")
        )
        open_ = s["outcome"].isNull()
        text = F.when(~open_, s["text"]).when(outcome == "truncated", F.concat(longer, F.lit(CUT_OFF))).when(outcome == "ok", r["text"])
        return F.struct(text.alias("text"), F.when(open_, longer).otherwise(s["partial"]).alias("partial"), outcome.alias("outcome"), F.when(open_ & r["cut"] & ~at_cap, s["step"] + 1).otherwise(s["step"]).alias("step"), (s["used"] + open_.cast("int")).alias("used"))

    done = seq.select("key", F.aggregate("r", start, step).alias("s"))
    return done.select("key", F.col("s.text").alias("text"), F.coalesce("s.outcome", F.lit("failed")).alias("outcome"), F.col("s.used").alias("attempts"))


def cacheable(text: Column, finish_reason: Column) -> Column:
    """Only whole replies with content may be kept."""
    return T.has_content(text) & ~T.cut_off(finish_reason)


def file_estimate(calls: Column, per_call: Column, seconds_per_call: Column) -> tuple[Column, Column]:
    """Dollars and seconds of a file's requests; null where the number, price or pace is unknown."""
    return F.bround(calls * per_call, 4), F.when(seconds_per_call != 0, F.bround(calls * seconds_per_call, 0).cast("long"))
