"""Queries on page selection, routing, cost, progress, assembly and catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog, layout, runs, schedule, triage
from . import views
from .registry import picked, query, quoted
from .text_queries import solid_sql

_IMAGES = """img AS (SELECT l_orderkey % 997 AS doc_id, l_orderkey % 89 + 1 AS page_no, l_orderkey * 10 + l_linenumber AS xref, l_quantity * 3 + l_partkey % 2 AS w, (l_partkey % 130)::DOUBLE AS h FROM lineitem),
  small AS (SELECT doc_id, page_no, count(*) AS n_small FROM img WHERE least(w, h) >= 2 AND least(w, h) < 60 GROUP BY ALL),
  figs AS (SELECT doc_id, page_no, count(DISTINCT xref) AS n_figures FROM img WHERE w >= 60 AND h >= 60 GROUP BY ALL)"""
# each document stands for a page of a file of 16 pages
_PAGES = f"""{_IMAGES}, pg AS (SELECT d.doc_id // 16 AS file_id, d.doc_id % 16 + 1 AS page_no, CASE WHEN {solid_sql("text")} < 120 THEN 'scanned' WHEN coalesce(n_small, 0) > 0 AND d.doc_id % 3 = 0 THEN 'equations' ELSE 'text' END AS page_class,
  coalesce(f.n_figures, 0) AS n_figures FROM documents d LEFT JOIN (SELECT doc_id, sum(n_small) AS n_small FROM small GROUP BY 1) s ON s.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, sum(n_figures)::BIGINT AS n_figures FROM figs GROUP BY 1) f ON f.doc_id = d.doc_id)"""
_INSPECT = "ins AS (SELECT file_id, count(*) AS pages, count(*) FILTER (page_class <> 'text') AS whole, coalesce(sum(n_figures) FILTER (page_class = 'text'), 0)::BIGINT AS figures FROM pg GROUP BY 1)"


def _pages(spark, sf_dir):
    images = views.page_images(spark, sf_dir)
    small = triage.small_images(images, ["doc_id", "page_no"]).groupBy("doc_id").agg(F.sum("n_small").alias("n_small"))
    figs = triage.figures(images, ["doc_id", "page_no"]).groupBy("doc_id").agg(F.sum("n_figures").alias("n_figures"))
    d = views.table(spark, sf_dir, "documents").select("doc_id", T.solid_chars(F.col("text")).alias("solid")).join(small, "doc_id", "left").join(figs, "doc_id", "left")
    n_small = F.when(F.col("doc_id") % 3 == 0, F.col("n_small"))
    return d.select(F.floor(F.col("doc_id") / 16).alias("file_id"), (F.col("doc_id") % 16 + 1).alias("page_no"), triage.page_class(F.col("solid"), n_small).alias("page_class"), F.coalesce("n_figures", F.lit(0)).cast("long").alias("n_figures"))


_SPECS = ["", "3", "1,5,9-12", "12-9", "0,2,99", "4-99"]


@query(f"""WITH s AS (SELECT o_orderkey AS key, {picked("o_orderkey", _SPECS)} AS spec, (o_custkey % 20 + 1)::INT AS total FROM orders),
  c AS (SELECT key, total, trim(unnest(string_split(CASE WHEN spec = '' THEN '1-' || total ELSE spec END, ','))) AS c FROM s),
  r AS (SELECT key, greatest(split_part(c, '-', 1)::INT, 1) AS a, least(CASE WHEN contains(c, '-') THEN split_part(c, '-', 2) ELSE c END::INT, total) AS z FROM c)
  SELECT DISTINCT key, unnest(range(a, z + 1))::INT AS page FROM r WHERE a <= z""")
def parse_pages(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    return triage.parse_pages(o.select(F.col("o_orderkey").alias("key"), views.pick(F.col("o_orderkey"), _SPECS).alias("spec"), (F.col("o_custkey") % 20 + 1).cast("int").alias("total")))


@query(f"SELECT class, count(*) AS n FROM (SELECT CASE WHEN {solid_sql('text')} < 1000000000 THEN 'scanned' ELSE 'text' END AS class FROM documents) GROUP BY 1")
def triage_every_page(spark, sf_dir):
    c = triage.page_class(T.solid_chars(F.col("text")), F.lit(0), triage.EVERY_PAGE)
    return views.table(spark, sf_dir, "documents").groupBy(c.alias("class")).agg(F.count("*").alias("n"))


@query(f"WITH {_IMAGES} SELECT * FROM small")
def small_images(spark, sf_dir):
    return triage.small_images(views.page_images(spark, sf_dir), ["doc_id", "page_no"])


@query(f"WITH {_PAGES} SELECT file_id, page_no, page_class, CASE WHEN page_class IN ('scanned', 'equations') THEN 'whole page' WHEN n_figures > 0 THEN 'text and figures' ELSE 'text' END AS route FROM pg")
def page_route(spark, sf_dir):
    return _pages(spark, sf_dir).select("file_id", "page_no", "page_class", triage.route(F.col("page_class"), F.col("n_figures")).alias("route"))


_LIST = "coalesce(string_agg(page_no::VARCHAR, ',' ORDER BY page_no) FILTER (page_class = '{}'), '')"


@query(f"WITH {_PAGES}, {_INSPECT} SELECT ins.file_id, ins.pages, ins.figures, {_LIST.format('scanned')} AS scanned, {_LIST.format('equations')} AS equations FROM ins JOIN pg USING (file_id) GROUP BY ALL")
def inspect(spark, sf_dir):
    i = triage.inspect(_pages(spark, sf_dir), "file_id")
    return i.select("file_id", "pages", "figures", *(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("scanned", "equations")))


@query(f"""WITH {_PAGES}, {_INSPECT}, ch AS (SELECT file_id, count(*) FILTER (page_class <> 'text' AND page_no % 3 > 0) AS w, count(*) FILTER (page_class = 'text' AND page_no % 3 > 0) AS t FROM pg GROUP BY 1)
  SELECT file_id, whole + figures AS calls_all, n AS calls_chosen, round_even(n * 0.003375::DOUBLE, 4) AS cost, CASE WHEN file_id % 4 > 0 THEN round_even(n * 1.75::DOUBLE, 0)::BIGINT END AS seconds FROM (SELECT *, w + round_even(figures * t / greatest(1, pages - whole), 0)::BIGINT AS n FROM ins JOIN ch USING (file_id))""")
def estimate_calls(spark, sf_dir):
    text, chosen = F.col("page_class") == "text", F.col("page_no") % 3 > 0
    count = lambda c: F.sum(c.cast("long"))
    g = _pages(spark, sf_dir).groupBy("file_id").agg(F.count("*").alias("pages"), count(~text).alias("whole"), F.sum(F.when(text, F.col("n_figures")).otherwise(0)).alias("figures"), count(~text & chosen).alias("w"), count(text & chosen).alias("t"))
    calls = triage.request_estimate(*(F.col(c) for c in ("pages", "whole", "figures", "w", "t")))
    cost, seconds = runs.file_estimate(calls, F.lit(0.003375), F.when(F.col("file_id") % 4 > 0, 1.75))
    return g.select("file_id", (F.col("whole") + F.col("figures")).alias("calls_all"), calls.alias("calls_chosen"), cost.alias("cost"), seconds.alias("seconds"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem d WHERE d.l_returnflag = 'R' AND d.l_orderkey = l.l_orderkey AND d.l_linenumber = l.l_linenumber)")
def resume_todo(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem")
    k = ["l_orderkey", "l_linenumber"]
    return runs.todo(li.select(*k), li.filter("l_returnflag = 'R'"), k)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def estimate_todo(spark, sf_dir):
    done = views.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return runs.todo(views.table(spark, sf_dir, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query(f"WITH {_PAGES} SELECT file_id, page_no FROM pg WHERE page_class = 'scanned' AND page_no IN (SELECT DISTINCT turn + 1 FROM conversations)")
def empty_pages(spark, sf_dir):
    written = views.table(spark, sf_dir, "conversations").select((F.col("turn") + 1).alias("page_no"))
    return _pages(spark, sf_dir).filter("page_class = 'scanned'").join(written, "page_no", "left_semi").select("file_id", "page_no")


_MODELS = views.MODELS
_USAGE = f"""u AS (SELECT event_id, ts, user_id, {picked("event_id", _MODELS)} AS model, CASE WHEN event_id % 13 <> 0 THEN 900 + event_id % 700 END AS prompt, CASE WHEN event_id % 13 <> 0 THEN 200 + floor(abs(value) * 10)::BIGINT % 400 END AS completion,
  CASE WHEN event_id % 13 <> 0 THEN 1100 + event_id % 700 + floor(abs(value) * 10)::BIGINT % 900 END AS total FROM events)"""
_PRICED = "CASE model WHEN 'gemini-3.6-flash' THEN {} WHEN 'gpt-5.4-mini' THEN {} ELSE {} END::DOUBLE"
_METER = f"{_USAGE}, m AS (SELECT user_id, model, count(*) AS calls, sum(prompt)::BIGINT AS tokens_in, sum(greatest(completion, total - prompt))::BIGINT AS tokens_out FROM u WHERE prompt IS NOT NULL GROUP BY 1, 2)"


@query(f"WITH {_METER} SELECT user_id, model, calls, tokens_in, tokens_out, (tokens_in * {_PRICED.format('0.75', '0.75', '0.0')} + tokens_out * {_PRICED.format('3.75', '4.5', '0.0')}) / 1e6::DOUBLE AS cost FROM m")
def token_cost(spark, sf_dir):
    m = catalog.priced(runs.meter(views.usage(spark, sf_dir), ["user_id", "model"]), F.lit("custom"))
    return m.select("user_id", "model", "calls", "tokens_in", "tokens_out", runs.cost(*(F.col(c) for c in ("tokens_in", "tokens_out", "price_in", "price_out"))).alias("cost"))


@query(f"WITH {_USAGE} SELECT user_id, event_id FROM u WHERE prompt IS NOT NULL QUALIFY coalesce(sum(prompt + greatest(completion, total - prompt)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= 6000")
def budget_stop(spark, sf_dir):
    u = views.usage(spark, sf_dir).filter("prompt is not null")
    spent = F.col("prompt") + runs.billed_out(F.col("prompt"), F.col("completion"), F.col("total"))
    return runs.within_budget(u, ["user_id"], ["ts", "event_id"], spent, 6000).select("user_id", "event_id")


@query(f"""WITH {_USAGE} SELECT event_id, model, coalesce(CASE WHEN user_id % 5 = 0 THEN 9.5 END, CASE WHEN model IN ('local', 'unheard-of') AND user_id % 2 = 0 THEN 0.75 ELSE {_PRICED.format('0.75', '0.75', '0.0')} END)::DOUBLE AS price_in,
  CASE WHEN model IN ('local', 'unheard-of') AND user_id % 2 = 0 THEN 3.75 ELSE {_PRICED.format('3.75', '4.5', '0.0')} END::DOUBLE AS price_out FROM u""")
def price_lookup(spark, sf_dir):
    u = views.usage(spark, sf_dir).select("event_id", "model", "user_id")
    service = F.when(F.col("user_id") % 2 == 0, "gemini").otherwise("custom")
    return catalog.priced(u, service, F.when(F.col("user_id") % 5 == 0, 9.5)).select("event_id", "model", "price_in", "price_out")


@query(f"WITH {_USAGE} SELECT event_id, CASE WHEN model IN ('gemini-3.6-flash', 'gpt-5.4-mini') THEN round_even((1500 * {_PRICED.format('0.75', '0.75', '0.0')} + 600 * {_PRICED.format('3.75', '4.5', '0.0')}) / 1e6::DOUBLE, 5) END AS per_page FROM u")
def price_per_page(spark, sf_dir):
    u = catalog.priced(views.usage(spark, sf_dir).select("event_id", "model"), F.lit("custom"))
    i, o = runs.TOKENS_PER_PAGE
    return u.select("event_id", F.when(F.col("listed"), F.bround(runs.cost(F.lit(i), F.lit(o), F.col("price_in"), F.col("price_out")), 5)).alias("per_page"))


_URLS = ["https://api.openai.com/v1/ ", "HTTP://127.0.0.1:11434/v1", "http://box:11434", "https://eu.api.anthropic.com/x", "https://generativelanguage.googleapis.com/v1beta/openai", "http://localhost:8080/v1"]


@query(f"""WITH u AS (SELECT event_id, lower(rtrim(trim({picked("event_id", _URLS)}), '/')) AS u FROM events), k(url, name) AS (VALUES {", ".join(f"('{u.rstrip('/').lower()}', '{n}')" for n, u in catalog.SERVICES)})
  SELECT event_id, coalesce(name, CASE WHEN u LIKE '%:11434/v1' OR u LIKE '%:11434' THEN 'ollama' WHEN contains(u, 'api.anthropic.com') THEN 'anthropic' ELSE 'custom' END) AS service FROM u LEFT JOIN k ON url = u""")
def infer_service(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select("event_id", catalog.service_of(views.pick(F.col("event_id"), _URLS)).alias("service"))


_CHOICES = ["4b", "HIGH", "qwen3-vl:2b-instruct", "other:7b", ""]


@query(f"""WITH c AS (SELECT event_id, {picked("event_id", _CHOICES)} AS c FROM events)
  SELECT event_id, CASE WHEN c = '' THEN 'none' WHEN lower(c) IN ('2b', 'basic', 'qwen3-vl:2b-instruct') THEN 'qwen3-vl:2b-instruct' WHEN lower(c) IN ('4b', 'standard', 'qwen3-vl:4b-instruct') THEN 'qwen3-vl:4b-instruct' WHEN lower(c) IN ('8b', 'high', 'qwen3-vl:8b-instruct') THEN 'qwen3-vl:8b-instruct' ELSE c END AS model FROM c""")
def resolve_model(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select("event_id", catalog.resolve_local(views.pick(F.col("event_id"), _CHOICES), F.lit("none")).alias("model"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS minute, strftime(ts, '%Y-%m-%d %H:%M:%S') AS second FROM events")
def date_stamp(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select("event_id", T.stamp(F.col("ts")).alias("minute"), T.stamp(F.col("ts"), True).alias("second"))


@query("""WITH g AS (SELECT s_nationkey AS box, CASE WHEN s_suppkey % 3 = 0 THEN 'NVIDIA' ELSE 'AMD' END AS vendor, s_name AS name FROM supplier), e AS (SELECT c_nationkey AS box, 'NVIDIA' AS vendor, c_name AS name FROM customer WHERE c_custkey % 50 = 0)
  SELECT * FROM e UNION ALL SELECT * FROM g WHERE vendor <> 'NVIDIA' OR box NOT IN (SELECT box FROM e)""")
def replace_vendor(spark, sf_dir):
    g = views.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("box"), F.when(F.col("s_suppkey") % 3 == 0, "NVIDIA").otherwise("AMD").alias("vendor"), F.col("s_name").alias("name"))
    e = views.table(spark, sf_dir, "customer").filter("c_custkey % 50 = 0").select(F.col("c_nationkey").alias("box"), F.lit("NVIDIA").alias("vendor"), F.col("c_name").alias("name"))
    return catalog.replace_vendor(g, e, ["box"])


@query(f"WITH {_IMAGES} SELECT doc_id, page_no, bool_or(w >= 60 AND h >= 60) AS image FROM img GROUP BY ALL")
def large_images(spark, sf_dir):
    return triage.holds_large_image(views.page_images(spark, sf_dir), ["doc_id", "page_no"])


@query("""WITH b AS (SELECT l_orderkey AS page, list({'bottom': (l_linenumber * 20)::DOUBLE, 'text': repeat('x', (l_partkey % 60)::INT)}) AS bs FROM lineitem GROUP BY 1)
  SELECT page, page % 9 = 0 OR len(list_filter(bs, lambda b: b.bottom <= (page % 140) - 2 AND length(b.text) >= 40)) > 0 AS above FROM b""")
def text_above(spark, sf_dir):
    block = F.struct((F.col("l_linenumber") * 20).cast("double").alias("bottom"), F.expr("repeat('x', cast(l_partkey % 60 as int))").alias("text"))
    b = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.collect_list(block).alias("bs"))
    y = F.when(F.col("page") % 9 != 0, (F.col("page") % 140).cast("double"))
    return b.select("page", triage.text_above(F.col("bs"), y).alias("above"))


@query("WITH p AS (SELECT l_partkey AS k, min(l_orderkey) AS page FROM lineitem GROUP BY 1) SELECT p_partkey, coalesce(p.page, CASE WHEN p_partkey % 2 = 0 THEN p_size END)::BIGINT AS page FROM part LEFT JOIN p ON k = p_partkey")
def page_of(spark, sf_dir):
    part = views.table(spark, sf_dir, "part")
    printed = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_orderkey").alias("page"))
    listed = part.filter("p_partkey % 2 = 0").select("p_partkey", F.col("p_size").cast("long").alias("page"))
    return layout.page_of(part.select("p_partkey"), printed, listed, "p_partkey")


@query(f"WITH {_IMAGES} SELECT doc_id, page_no, xref, least(w, h) >= 48 AS asked FROM img")
def picture_size(spark, sf_dir):
    i = views.page_images(spark, sf_dir)
    return i.select("doc_id", "page_no", "xref", triage.picture_worth_asking(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("asked"))


_EVENTS = f"e AS (SELECT event_id, ts, user_id % 50 AS run, {picked('event_id', ['page_start', 'page_done', 'page_done', 'page_failed', 'image_done'])} AS kind, event_id % 400 + 1 AS page FROM events)"


@query(f"""WITH {_EVENTS}, f AS (SELECT run, count(*) FILTER (kind IN ('page_done', 'image_done')) AS done, count(DISTINCT page) AS selected, coalesce(string_agg(DISTINCT page::VARCHAR, ',' ORDER BY page::VARCHAR) FILTER (kind = 'page_failed'), '') AS failed, count(*) * 2500 AS micros FROM e GROUP BY 1)
  SELECT run, done, selected, failed, micros // greatest(1, done) AS per_unit, micros // greatest(1, done) * greatest(0, selected - done) AS to_finish FROM f""")
def run_summary(spark, sf_dir):
    ended = F.col("kind").isin("page_done", "image_done")
    failed = F.array_sort(F.collect_set(F.when(F.col("kind") == "page_failed", F.col("page").cast("string"))))
    e = views.page_events(spark, sf_dir).groupBy("run").agg(F.sum(ended.cast("long")).alias("done"), F.count_distinct("page").alias("selected"), F.array_join(failed, ",").alias("failed"), (F.count("*") * 2500).alias("micros"))
    unit = F.floor(F.col("micros") / F.greatest(F.lit(1), F.col("done")))
    return e.select("run", "done", "selected", "failed", unit.alias("per_unit"), (unit * F.greatest(F.lit(0), F.col("selected") - F.col("done"))).alias("to_finish"))


@query(f"""WITH {_EVENTS}, w AS (SELECT *, sum((kind IN ('page_done', 'image_done'))::BIGINT) OVER o AS done, sum((kind = 'page_failed')::BIGINT) OVER o AS failed, epoch_us(ts) // 1000000 - epoch_us(first_value(ts) OVER o) // 1000000 AS elapsed FROM e WINDOW o AS (PARTITION BY run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  SELECT event_id, run, done::BIGINT AS done, failed::BIGINT AS failed, greatest(0, 500 - done - failed)::BIGINT AS remaining, round_even(CASE WHEN done + failed > 0 THEN greatest(0, 500 - done - failed) * (elapsed / (done + failed)) ELSE greatest(0, 500 - done - failed) * 30 END, 0)::BIGINT AS eta FROM w""")
def progress_eta(spark, sf_dir):
    from pyspark.sql import Window

    e = views.page_events(spark, sf_dir)
    first = F.first("ts").over(Window.partitionBy("run").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    seconds = F.unix_timestamp("ts") - F.unix_timestamp(first)
    return runs.progress(e, "run", ["ts", "event_id"], F.lit(500), seconds, F.lit(30)).select("event_id", "run", "done", "failed", "remaining", "eta")


@query("SELECT conv_id AS doc_id, sha256('# ' || conv_id || chr(10) || string_agg(chr(10) || '## Page ' || turn || chr(10) || text, '' ORDER BY turn, text) || chr(10)) AS digest FROM conversations GROUP BY 1")
def assemble(spark, sf_dir):
    md = F.concat(F.lit("\n## Page "), F.col("turn").cast("string"), F.lit("\n"), F.col("text"))
    pages = views.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), md.alias("md"))
    header = F.concat(F.lit("# "), F.col("doc_id").cast("string"), F.lit("\n"))
    return runs.assemble(pages, "doc_id", header).select("doc_id", F.sha2("document", 256).alias("digest"))


@query(f"""WITH {_EVENTS} SELECT event_id, '{{"event":"' || kind || '","page":' || page || ',"run":' || run || '}}' AS line FROM e""")
def event_json(spark, sf_dir):
    line = F.to_json(F.struct(F.col("kind").alias("event"), "page", "run"))
    return views.page_events(spark, sf_dir).select("event_id", line.alias("line"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY 1 LIMIT 5")
def trial_limit(spark, sf_dir):
    return estimate_todo(spark, sf_dir).orderBy("o_orderkey").limit(5)


@query("SELECT o_custkey, o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) = 1")
def find_doc(spark, sf_dir):
    return runs.newest(views.table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], [F.desc("o_orderdate"), "o_orderkey"]).select("o_custkey", "o_orderstatus", "o_orderkey")


@query("""WITH n AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN upper(p_brand) WHEN 1 THEN p_brand ELSE p_brand || ' ' || p_size END AS name FROM part)
  SELECT p_partkey, CASE WHEN n = 1 THEN name ELSE name || ' (' || n || ')' END AS folder FROM (SELECT p_partkey, name, row_number() OVER (PARTITION BY lower(name) ORDER BY p_partkey) AS n FROM n)""")
def unique_folder(spark, sf_dir):
    k, b = F.col("p_partkey"), F.col("p_brand")
    name = F.when(k % 3 == 0, F.upper(b)).when(k % 3 == 1, b).otherwise(F.concat(b, F.lit(" "), F.col("p_size").cast("string")))
    return runs.free_names(views.table(spark, sf_dir, "part").select("p_partkey", name.alias("name")), ["p_partkey"]).select("p_partkey", "folder")


_OUTLINE = """o AS (SELECT conv_id AS doc_id, turn AS ord, (CASE role WHEN 'user' THEN 1 ELSE 2 END + (conv_id + turn) % 2)::INT AS level, 'Section ' || turn AS title, turn * 3 + 1 AS start, (conv_id + turn) % 3 = 0 AS above FROM conversations),
  p AS (SELECT doc_id, max(start) + 4 AS n_pages FROM o GROUP BY 1)"""


@query(f"""WITH {_OUTLINE}, n AS (SELECT a.doc_id, a.ord, a.level, a.title, a.start, min(b.ord) AS nxt FROM o a LEFT JOIN o b ON a.doc_id = b.doc_id AND b.ord > a.ord AND b.level <= a.level GROUP BY ALL)
  SELECT n.doc_id, n.ord, n.level, n.title, n.start AS first, greatest(n.start, CASE WHEN nxt IS NULL THEN n_pages WHEN b.above THEN b.start ELSE b.start - 1 END) AS last FROM n JOIN p USING (doc_id) LEFT JOIN o b ON b.doc_id = n.doc_id AND b.ord = n.nxt""")
def outline_ranges(spark, sf_dir):
    o = views.outline(spark, sf_dir)
    return triage.outline_ranges(o, o.groupBy("doc_id").agg((F.max("start") + 4).alias("n_pages")))


@query("""WITH n AS (SELECT doc_id, 'new ' || quality AS note, toxic = 1 AS gone FROM labels), s AS (SELECT doc_id, 'old ' || lang AS note FROM documents)
  SELECT doc_id, note FROM s WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT doc_id, note FROM n WHERE NOT gone""")
def upsert_notes(spark, sf_dir):
    new = views.table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("new "), F.col("quality").cast("string")).alias("note"), (F.col("toxic") == 1).alias("gone"))
    stored = views.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("old "), F.col("lang")).alias("note"))
    return runs.upsert(stored.withColumn("gone", F.lit(False)), new, ["doc_id"], F.col("gone")).select("doc_id", "note")


_ADDRESSES = [*(u for _, u in catalog.SERVICES), "http://192.168.0.4:11434", "https://models.example.org/v1/"]
_SET = [["OPENAI_API_KEY"], ["GOOGLE_API_KEY", "GEMINI_API_KEY"], [], ["KIMI_API_KEY"], ["ANTHROPIC_API_KEY", "OPENAI_API_KEY", "OPENROUTER_API_KEY"]]


@query(
    f"""WITH c(service, protocol, keys, needs, model) AS (VALUES {", ".join(f"({quoted(n)}, {quoted(p)}, {[*k]}::VARCHAR[], {needs}, {'NULL' if m is None else quoted(m)})" for n, p, k, needs, m in catalog.CONNECTIONS)}),
    e AS (SELECT event_id, {picked("event_id", [*(n for n, _ in catalog.SERVICES), "ollama", "custom"])} AS service, {_SET}[event_id % 5 + 1] AS variables, CASE WHEN event_id % 3 = 0 THEN 'own-model' END AS own FROM events)
    SELECT event_id, service, protocol, list_filter(keys, lambda k: list_contains(variables, k))[1] AS key_variable, coalesce(own, model) AS model, coalesce(own, model) IS NOT NULL AND (NOT needs OR key_variable IS NOT NULL) AS ready FROM e JOIN c USING (service)"""
)
def connections(spark, sf_dir):
    e = F.col("event_id")
    variables = F.get(F.array(*(F.array(*map(F.lit, x)).cast("array<string>") for x in _SET)), (e % 5).cast("int"))
    called = views.table(spark, sf_dir, "events").select("event_id", views.pick(e, _ADDRESSES).alias("url"), variables.alias("variables"), F.when(e % 3 == 0, "own-model").alias("model"))
    return catalog.connected(called).select("event_id", "service", "protocol", "key_variable", "model", "ready")


_REPLIES = """r AS (SELECT conv_id AS key, turn AS attempt, CASE (conv_id + turn) % 4 WHEN 0 THEN '<!-- page number: -->' WHEN 1 THEN '' ELSE text END AS text, CASE (conv_id * 3 + turn) % 5 WHEN 0 THEN 'length' WHEN 1 THEN 'content_filter' ELSE 'stop' END AS reason, CASE (conv_id + turn * 3) % 7 WHEN 3 THEN 'Context window exceeded' WHEN 5 THEN 'connection reset' END AS error FROM conversations)"""


def _replies(spark, sf_dir):
    c, t = F.col("conv_id"), F.col("turn")
    text = F.when((c + t) % 4 == 0, "<!-- page number: -->").when((c + t) % 4 == 1, "").otherwise(F.col("text"))
    reason = F.when((c * 3 + t) % 5 == 0, "length").when((c * 3 + t) % 5 == 1, "content_filter").otherwise("stop")
    error = F.when((c + t * 3) % 7 == 3, "Context window exceeded").when((c + t * 3) % 7 == 5, "connection reset")
    return views.table(spark, sf_dir, "conversations").select(c.alias("key"), t.alias("attempt"), text.alias("text"), reason.alias("finish_reason"), error.alias("error"))


@query(f"WITH {_REPLIES} SELECT key, attempt FROM r WHERE trim(regexp_replace(text, '<!--.*?-->', '', 'g')) <> '' AND reason <> 'length'")
def cache_policy(spark, sf_dir):
    return _replies(spark, sf_dir).filter(runs.cacheable(F.col("text"), F.col("finish_reason"))).select("key", "attempt")


_FOLD = rf"""{_REPLIES}, q AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY attempt, text, reason) AS k, CASE WHEN error IS NULL THEN trim(text, ' ' || chr(10) || chr(9) || chr(13)) ELSE '' END AS text, error IS NULL AND reason = 'length' AS cut, error IS NULL AND reason = 'content_filter' AS refused,
    error IS NULL AND {solid_sql("regexp_replace(text, '(?s)<!--.*?-->', '', 'g')")} > 0 AS full_, coalesce(error LIKE 'Context%', false) AS large FROM r),
  f AS (SELECT DISTINCT key, 0::BIGINT AS k, NULL::VARCHAR AS text, '' AS partial, NULL::VARCHAR AS outcome, 0 AS step, 0 AS used FROM q UNION ALL
    SELECT key, k, CASE WHEN o = 'truncated' THEN longer || {quoted(runs.CUT_OFF)} WHEN o = 'ok' THEN body END, longer, o, step + (cut AND step < 1)::INT, used + 1 FROM (
      SELECT f.key, q.k, q.text AS body, cut, step, used, CASE WHEN cut AND full_ AND length(q.text) > length(partial) THEN q.text ELSE partial END AS longer,
        CASE WHEN large AND step > 0 AND partial <> '' THEN 'truncated' WHEN cut AND step < 1 THEN NULL WHEN cut AND longer <> '' THEN 'truncated' WHEN NOT full_ AND refused THEN 'refused' WHEN NOT full_ THEN NULL ELSE 'ok' END AS o
      FROM f JOIN q ON q.key = f.key AND q.k = f.k + 1 WHERE outcome IS NULL AND f.k < 5))"""


@query(f"WITH RECURSIVE {_FOLD} SELECT key, text, coalesce(outcome, 'failed') AS outcome, used AS attempts FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY k DESC) = 1")
def resolve_reply(spark, sf_dir):
    return runs.resolve_replies(_replies(spark, sf_dir))


@query("""SELECT doc_id, coalesce(CASE WHEN doc_id % 3 <> 0 THEN 'transcription' END, CASE WHEN doc_id % 2 = 0 THEN 'notes' END, CASE WHEN doc_id % 5 = 0 THEN 'ocr' END, 'failed') AS source FROM documents""")
def fallback_order(spark, sf_dir):
    d = F.col("doc_id")
    ranked = F.coalesce(F.when(d % 3 != 0, "transcription"), F.when(d % 2 == 0, "notes"), F.when(d % 5 == 0, "ocr"), F.lit("failed"))
    return views.table(spark, sf_dir, "documents").select("doc_id", ranked.alias("source"))


@query("""WITH e AS (SELECT user_id % 20 AS pull, event_id % 7 AS digest, event_id AS seq, CASE WHEN event_id % 3 > 0 THEN 100000 END AS total, event_id % 99991 AS completed FROM events),
  l AS (SELECT pull, digest, arg_max(completed, seq) AS c, arg_max(total, seq) AS t FROM e WHERE total IS NOT NULL GROUP BY 1, 2) SELECT pull, sum(c)::BIGINT AS completed, sum(t)::BIGINT AS total FROM l GROUP BY 1""")
def pull_progress(spark, sf_dir):
    e = F.col("event_id")
    d = views.table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("pull"), (e % 7).alias("digest"), e.alias("seq"), F.when(e % 3 > 0, F.lit(100000).cast("long")).alias("total"), (e % 99991).alias("completed"))
    return runs.pulled(d, "pull")


@query("""WITH s AS (SELECT c_custkey AS sys, (c_custkey % 9 * 6 + 2)::DOUBLE AS ram, CASE WHEN c_custkey % 4 = 0 THEN (c_custkey % 11)::DOUBLE ELSE 0.5 END AS vram, c_custkey % 6 = 1 AS unified FROM customer),
  c(size, model, need_card, need_ram) AS (VALUES (1, 'qwen3-vl:2b-instruct', 3.5::DOUBLE, 8.0::DOUBLE), (2, 'qwen3-vl:4b-instruct', 5.0, 16.0), (3, 'qwen3-vl:8b-instruct', 8.0, 32.0)),
  f AS (SELECT sys, size, model, CASE WHEN vram >= 1 AND vram >= need_card THEN 'graphics card' WHEN unified AND ram * 0.66::DOUBLE >= need_card THEN 'shared memory' WHEN ram >= need_ram THEN 'processor' END AS runs_on FROM s, c)
  SELECT s.sys, arg_max(model, size) FILTER (runs_on IS NOT NULL) AS model, arg_max(runs_on, size) FILTER (runs_on IS NOT NULL) AS runs_on FROM s JOIN f USING (sys) GROUP BY 1""")
def recommend(spark, sf_dir):
    k = F.col("c_custkey")
    vram = F.when(k % 4 == 0, (k % 11).cast("double")).otherwise(0.5)
    card = F.when(~runs.integrated(F.lit("NVIDIA"), F.lit("card"), vram), vram)
    return runs.recommend(views.table(spark, sf_dir, "customer").select(k.alias("sys"), (k % 9 * 6 + 2).cast("double").alias("ram_gb"), card.alias("card_gb"), (k % 6 == 1).alias("unified")))


_LINES = ["{}, 8192, 551.2", "bad line {}", "Card {}, none, 550.1", "Card {} , 12282 , 560.9"]


@query(f"""WITH l AS (SELECT string_split(replace({picked("s_suppkey", _LINES)}, '{{}}', s_suppkey::VARCHAR), ',') AS p FROM supplier)
  SELECT trim(p[1]) AS name, round_even(try_cast(trim(p[2]) AS DOUBLE) / 1024, 2) AS dedicated_gb, trim(p[3]) AS driver FROM l WHERE len(p) >= 3 AND try_cast(trim(p[2]) AS DOUBLE) IS NOT NULL""")
def nvidia_smi(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    line = views.pick(F.col("s_suppkey"), _LINES)
    return runs.gpu_rows(views.table(spark, sf_dir, "supplier").select(F.replace(line, F.lit("{}"), k).alias("line")))


@query("""SELECT page_id, len(regexp_extract_all(html, '<img[^>]*src="[^"]*"'))::BIGINT AS n_pictures FROM pages""")
def office_pictures(spark, sf_dir):
    src = F.regexp_extract_all("html", F.lit(r'<img[^>]*src="([^"]*)"'), F.lit(1))
    return views.table(spark, sf_dir, "pages").select("page_id", F.size(src).cast("long").alias("n_pictures"))


_LANES, _RATE = 4, 120.0
_BEAT = 60.0 * _LANES / _RATE


def _due_sql(most: int) -> str:
    """The rounds one after the other; lanes go by the key, as lane_of() can't be said in SQL."""
    slot = lambda k, ready, source: f"""r{k} AS (SELECT key, lane, greatest({ready}, lane * {60.0 / _RATE}) AS ready FROM {source}), n{k} AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY ready, key) AS n FROM r{k}),
  d{k} AS (SELECT key, lane, n * {_BEAT} + max(ready - n * {_BEAT}) OVER (PARTITION BY lane ORDER BY n) AS due FROM n{k})"""  # noqa: E731
    parts = ["a AS (SELECT DISTINCT conv_id AS key, turn + 1 AS attempt, conv_id % 4 AS lane, CASE WHEN (conv_id + turn) % 3 = 0 THEN (conv_id % 50)::DOUBLE END AS retry_after FROM conversations)", slot(1, "0.0", "a WHERE attempt = 1")]
    for k in range(2, most + 1):
        parts.append(f"j{k} AS (SELECT a.key, a.lane, greatest(d.due + coalesce(CASE WHEN retry_after > 0 THEN retry_after END, {4.0 * 2 ** (k - 2)}), (SELECT max(due) + {_BEAT} FROM d{k - 1} f WHERE f.lane = a.lane)) AS again FROM a JOIN d{k - 1} d USING (key) WHERE attempt = {k})")
        parts.append(slot(k, "again", f"j{k}"))
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT key, {k}::BIGINT AS attempt, lane::INT AS lane, round(due, 3) AS due FROM d{k}" for k in range(1, most + 1))


@query(_due_sql(schedule.ATTEMPTS))
def attempt_schedule(spark, sf_dir):
    c, t = F.col("conv_id"), F.col("turn")
    tries = views.table(spark, sf_dir, "conversations").select(c.alias("key"), (t + 1).alias("attempt"), F.when((c + t) % 3 == 0, (c % 50).cast("double")).alias("retry_after")).distinct()
    due = schedule.attempts_due(tries, "key", _RATE, _LANES, lane=F.col("key") % 4)
    return due.select("key", "attempt", F.col("lane").cast("int").alias("lane"), F.round("due", 3).alias("due"))
