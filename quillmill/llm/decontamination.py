"""Exact benchmark decontamination by a distributed positional inverted index.

The index holds a posting (term, document, position) for each place where a term of the test items
stands in the training documents; terms that no item has can match nothing and are not stored. A
test phrase is looked up by intersecting its terms' posting lists, shifted by the terms' offsets in
the phrase, from the rarest term on: the two rarest lists meet first, so the candidates are as few
as the rarer of the two allows, and the longer lists are only probed around the candidates'
positions. What is found there decides both exact occurrences and proximity matches: spans a few
words longer than the phrase that hold all its words, in any order.

DataFrame functions only. Lists are joined on (document, term, block of 32 positions) as maps of
bits, so a frequent term's list is spread over all documents and a key holds one number.

Words are lower-cased (A-Z) runs of what is neither an ASCII control, space nor punctuation
character. Defined cases: null has no words; an item without words matches nothing; a null id is a
document of its own; rows that share an id are told apart by a hash of their text, and full copies
of a row keep their rows; empty tables give no hits; other columns are not read, and clean() leaves
them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, forget_since, made, scratch, size_hint

#: Fixed pattern: what parts words (all of ASCII but digits and letters).
PARTS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Words that may stand between those of a phrase in a proximity match.
SLACK = 3
#: A phrase and the slack together: what the map of the places around a word can hold.
MAX_SPAN = 31
#: The test vocabulary is broadcast up to this planned size; beyond, the join is dealt by term.
MAX_BROADCAST = 32 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    cut = F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), PARTS)
    return F.filter(cut, lambda w: w != "")


def _small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its size, known from its table, is within the bound."""
    return F.broadcast(df) if size_hint(df) <= MAX_BROADCAST else df


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("version"), F.col("text"))


def build_index(docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """The postings term, doc_id, version, pos of docs, as a table; of the terms of vocabulary
    (term, term_id) only, if given, then with term_id in place of term."""
    spread = _keyed(docs).select("doc_id", "version", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    if vocabulary is not None:
        spread = spread.join(_small(vocabulary), "term").select("term_id", "doc_id", "version", "pos")
    return scratch(spread, "postings")


def phrases(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of the test side: vocabulary (term, term_id), windows' terms (phrase, offset, term_id,
    size), and which items hold a phrase (phrase, item_id)."""
    items = benchmark.select(F.col("item_id"), words(F.col("text")).alias("ws")).filter(F.size("ws") > 0).distinct()
    n = F.least(F.size("ws"), F.lit(window))
    cut = items.select("item_id", "ws", n.alias("size"), F.explode(F.sequence(F.lit(1), F.size("ws") - n + 1)).alias("at"))
    cut = cut.select("item_id", "size", F.expr("slice(ws, at, size)").alias("ws"))
    # a phrase is its words; they cannot hold the joining space
    held = scratch(cut.select("item_id", "size", "ws", F.sha2(F.array_join("ws", " "), 256).alias("digest")).distinct(), "phrases")
    named = scratch(held.dropDuplicates(["digest"]).select("digest", "size", "ws", F.monotonically_increasing_id().alias("phrase")), "named")
    vocabulary = scratch(held.select(F.explode("ws").alias("term")).distinct().withColumn("term_id", F.xxhash64("term")), "vocabulary")
    terms = named.select("phrase", "size", F.posexplode("ws").alias("offset", "term")).withColumn("term_id", F.xxhash64("term"))
    return vocabulary, scratch(terms.select("phrase", "size", "offset", "term_id", "term"), "terms"), held.join(named.select("digest", "phrase"), "digest").select("phrase", "item_id")


def _bits(index: DataFrame) -> DataFrame:
    """The postings as maps: of each block of 32 places, which ones hold the term. Full copies of a
    row fall together."""
    return index.groupBy("doc_id", "version", "term_id", F.shiftright("pos", 5).alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, pos & 31)")).alias("bits"))


#: Of bits, the places within reach of pos: the lowest bit is that of pos - reach.
_AROUND = (
    "CASE WHEN block * 32 - pos + reach >= 0 THEN shiftleft(bits, block * 32 - pos + reach)"
    " ELSE shiftright(bits, pos - reach - block * 32) END & (shiftleft(1L, 2 * reach + 1) - 1)"
)
#: As a set of bits, the spans of reach + 1 places that hold pos and at least k of seen.
_SPANS = "aggregate(sequence(0, reach), 0L, (a, s) -> a | IF(bit_count(seen & shiftleft(shiftleft(1L, reach + 1) - 1, s)) >= k, shiftleft(1L, s), 0L))"


def matches(index: DataFrame, terms: DataFrame, slack: int = SLACK) -> DataFrame:
    """A table of doc_id, version, phrase, size, near_start and start for every place near_start of a
    phrase's rarest term that lies in a span of size + slack words which holds all the phrase's
    words, each as often as the phrase does, in any order. exact tells whether the phrase itself
    begins at start; every occurrence is among these rows, once."""
    if (terms.agg(F.max("size")).first()[0] or 0) + slack > MAX_SPAN:
        raise ValueError(f"a phrase and the slack may have {MAX_SPAN} words together")
    lists = terms.select("term_id").distinct().join(index.groupBy("term_id").agg(F.count("*").alias("n")), "term_id", "left")
    each = terms.groupBy("phrase", "size", "term_id").agg(F.collect_list("offset").alias("offsets")).join(lists, "term_id", "left")
    by_phrase = Window.partitionBy("phrase")  # at most `window` rows each
    rank = F.row_number().over(by_phrase.orderBy(F.coalesce("n", F.lit(0)), "term_id"))
    each = each.withColumn("kinds", F.count("*").over(by_phrase)).withColumn("least", F.min(F.coalesce("n", F.lit(0))).over(by_phrase)).withColumn("rank", rank)
    each = scratch(each.filter("least > 0").withColumn("reach", F.col("size") + F.lit(slack) - 1).drop("n", "least"), "ranked")
    rarest = each.filter("rank = 1").select("phrase", "size", "reach", "kinds", "term_id", F.array_min("offsets").alias("first"))
    second = each.filter("rank = 2").select("phrase", F.col("term_id").alias("second"))
    rarest = scratch(rarest.join(second, "phrase", "left"), "rarest")
    place = ["doc_id", "version", "phrase", "pos"]
    blocks = F.explode(F.expr("sequence(shiftright(greatest(pos - reach, 0), 5), shiftright(pos + reach, 5))")).alias("block")

    # the rarest list meets the second rarest; then all terms are looked up around what is left
    anchors = index.join(_small(rarest), "term_id").select(*place, "size", "reach", "kinds", "first", "second")
    seconds = _small(scratch(rarest.select(F.col("second").alias("term_id")).dropna().distinct(), "second"))
    met = anchors.filter("kinds > 1").select("*", blocks).withColumnRenamed("second", "term_id")
    met = met.join(_bits(index.join(seconds, "term_id", "left_semi")), ["doc_id", "version", "term_id", "block"]).filter(F.expr(_AROUND) != 0)
    found = [*place, "size", "reach", "kinds", "first"]
    candidates = scratch(met.select(*found).unionByName(anchors.filter("kinds = 1").select(*found)).distinct(), "candidates")

    probes = candidates.join(_small(scratch(each.select("phrase", "term_id", "offsets"), "probes")), "phrase").select("*", blocks)
    where = _small(scratch(candidates.select("doc_id", "version").distinct(), "where"))
    seen = probes.join(_bits(index.join(where, ["doc_id", "version"], "left_semi")), ["doc_id", "version", "term_id", "block"])
    # both groupings below use this one exchange; `want` is the bits that an exact occurrence sets
    seen = seen.select(*found, "term_id", "offsets", F.expr(_AROUND).alias("seen")).repartition("doc_id", "version", "phrase")
    seen = seen.groupBy(*found, "term_id", F.size("offsets").alias("k"), F.expr("aggregate(offsets, 0L, (a, o) -> a | shiftleft(1L, o - first + reach))").alias("want")).agg(F.bit_or("seen").alias("seen"))
    judged = seen.select(*found, F.expr(_SPANS).alias("spans"), (F.col("seen").bitwiseAND(F.col("want")) == F.col("want")).alias("all"))
    judged = judged.groupBy(*found).agg(F.count("*").alias("met"), F.bit_and("spans").alias("spans"), F.every("all").alias("exact")).filter("met = kinds AND spans != 0")
    return scratch(judged.select("doc_id", "version", "phrase", "size", F.col("pos").alias("near_start"), (F.col("pos") - F.col("first")).alias("start"), "exact"), "matches")


def occurrences(index: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, version, start, size and phrase of every exact occurrence of a phrase."""
    return exact(matches(index, terms, 0))


def exact(found: DataFrame) -> DataFrame:
    """The exact occurrences among matches."""
    return found.filter("exact").select("doc_id", "version", "phrase", "start", "size")


def proximity(index: DataFrame, terms: DataFrame, slack: int = SLACK) -> DataFrame:
    """doc_id, version, phrase and near_start of the matches with that slack, exact ones included."""
    return matches(index, terms, slack).select("doc_id", "version", "phrase", "near_start")


def covered(found: DataFrame) -> DataFrame:
    """doc_id, version and n_hit: the number of words inside any occurrence."""
    w = Window.partitionBy("doc_id", "version").orderBy("start", "stop")
    runs = found.select("doc_id", "version", "start", (F.col("start") + F.col("size")).alias("stop")).distinct()
    reached = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), F.coalesce(reached, F.lit(0))))
    return runs.withColumn("_new", new).groupBy("doc_id", "version").agg(F.sum("_new").cast("long").alias("n_hit"))


def _found(docs: DataFrame, benchmark: DataFrame, slack: int) -> tuple[DataFrame, DataFrame]:
    vocabulary, terms, items = phrases(benchmark)
    return matches(build_index(docs, vocabulary), terms, slack), items


def contamination(docs: DataFrame, benchmark: DataFrame, slack: int = SLACK) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and n_near of every document:
    n_near counts the items of which a window's words stand near each other, exact ones included."""
    found, items = _found(docs, benchmark, slack)
    item = F.col("item_id").cast("string").alias("item")
    named = found.groupBy("doc_id", "version", "phrase").agg(F.some("exact").alias("exact")).join(items, "phrase").groupBy("doc_id", "version", item).agg(F.some("exact").alias("exact"))
    # collect_list leaves out the nulls of items that are near only
    named = named.groupBy("doc_id", "version").agg(F.array_sort(F.collect_list(F.when(F.col("exact"), F.col("item")))).alias("items"), F.count("*").cast("long").alias("n_near"))
    named = named.select("doc_id", "version", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "n_near")
    hits = scratch(named.join(covered(exact(found)), ["doc_id", "version"], "left"), "hits")
    sized = _keyed(docs).select("doc_id", "version", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return sized.join(hits, ["doc_id", "version"], "left").select(
        F.nullif(F.col("doc_id"), F.lit(NO_ID)).alias("doc_id"), "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), zero("n_near")
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, as they are, that hold no occurrence of a benchmark window."""
    mark = made()
    found, _ = _found(docs, benchmark, 0)
    bad = scratch(found.filter("exact").select(F.col("doc_id").alias("_quillmill_id"), F.col("version").alias("_quillmill_version")).distinct(), "contaminated")
    forget_since(mark, bad)
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == bad["_quillmill_id"]) & (F.xxhash64(docs["text"]) == bad["_quillmill_version"])
    return docs.join(_small(bad), same, "left_anti")
