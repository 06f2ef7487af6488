"""Benchmark passages in training text, found through a positional inverted index. DataFrame functions only.

The index stores (term, document, position) for the terms that the benchmark is looked up by: of each window of an item its
two rarest terms, by counts over the whole corpus. A lookup shifts each posting by the term's place in the item; where both
rare terms of a window fall on one shift, the alignment is read against the document itself, word for word. Proximity matches
(near_hits) come from the same index: shifts may differ by the words put in or left out, and what is met is read by edits.

Words are runs of digits, letters a-z (A-Z lower-cased) and everything outside ASCII. The index keys terms by Spark's
lower(), which joins a few more words; the reading at the end is exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barwise.llm.common import joined, table, written

WINDOW = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes up to which a derived table is broadcast; they are added up before. Beyond it the join is shuffled.
BROADCAST_BYTES = 24_000_000
_ROW_BYTES = 64


def _raw_words(text) -> F.Column:
    """Words before lower-casing."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _GAP), "")


def _words(text) -> F.Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _GAP), "")


def _sized(df: DataFrame, *more: F.Column) -> DataFrame:
    """df with a broadcast hint if its rows, with ``more`` bytes each, stay within the bound."""
    size = df.agg(F.sum(reduce(lambda a, b: a + b, more, F.lit(_ROW_BYTES).cast("long")))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _lengths(words: str) -> F.Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + 16 + F.octet_length(w))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item, item_id, iw, at) for each window of items; an item of fewer words is one window."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), _words(F.col("text")).alias("iw")).where(F.size("iw") > 0).distinct()
    words = words.withColumn("item", F.xxhash64("item_id", "iw"))
    return words.withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(F.size("iw") - window, F.lit(0)))))


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (term, doc_id, row, pos) of docs (doc_id, row, text) for the given terms."""
    places = docs.select("doc_id", "row", F.posexplode(_raw_words(F.col("text"))).alias("pos", "word"))
    return places.select("doc_id", "row", "pos", F.lower("word").alias("term")).join(_sized(terms, F.octet_length("term")), "term", "left_semi")


def alignments(postings: DataFrame, windows: DataFrame, rare: DataFrame) -> DataFrame:
    """(doc_id, row, item, shift) where both rare terms of some window of the item fall on one shift."""
    places = rare.select("item", "term", F.col("pos").alias("place")).distinct()
    met = postings.join(_sized(places, F.octet_length("term")), "term").select("doc_id", "row", "item", (F.col("pos") - F.col("place")).alias("shift"), "place")
    met = met.groupBy("doc_id", "row", "item", "shift").agg(F.collect_set("place").alias("places"))
    pairs = rare.groupBy("item", "at").agg(F.collect_set("pos").alias("both")).groupBy("item").agg(F.collect_set("both").alias("pairs"))
    met = met.join(_sized(pairs, 48 * F.size("pairs")), "item")
    return met.where(F.exists("pairs", lambda p: F.size(F.array_except(p, "places")) == 0)).select("doc_id", "row", "item", "shift")


def rarest_terms(docs: DataFrame, windows: DataFrame, window: int, places: int | F.Column) -> DataFrame:
    """(item, at, pos, term): of each window the ``places`` terms that are rarest over all docs."""
    placed = windows.select("item", "at", F.posexplode(F.slice("iw", F.col("at") + 1, window)).alias("k", "word"))
    placed = placed.select("item", "at", (F.col("at") + F.col("k")).alias("pos"), F.lower("word").alias("term"))
    vocabulary = placed.select("term").distinct()
    counts = docs.select(F.explode(_raw_words(F.col("text"))).alias("word")).select(F.lower("word").alias("term"))
    counts = written(counts.join(_sized(vocabulary, F.octet_length("term")), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n")), "decon-counts")
    own = W.partitionBy("item", "at")
    ranked = placed.join(counts, "term", "left").withColumn("rank", F.row_number().over(own.orderBy(F.coalesce("n", F.lit(0)), "pos")))
    if not isinstance(places, int):
        ranked = ranked.withColumn("words", F.count("*").over(own))
    return written(ranked.where(F.col("rank") <= places).select("item", "at", "pos", "term"), "decon-rare")


def phrase_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, row, hits) for each row of docs (doc_id, row, text) with an occurring window; hits hold item_id, first word, words."""
    windows = written(item_windows(items, window), "decon-windows")
    rare = rarest_terms(docs, windows, window, 2)
    postings = written(index(docs, rare.select("term").distinct()), "decon-postings")
    found = written(alignments(postings, windows, rare), "decon-alignments")
    texts = windows.where("at = 0").select("item", "item_id", "iw", F.size("iw").alias("size"))
    # to the documents go places alone; what stands there meets the items' words after that
    places = F.collect_list(F.struct("item", "shift", "size"))
    per_row = written(found.join(_sized(texts.select("item", "size")), "item").groupBy("doc_id", "row").agg(places.alias("found")), "decon-found")
    read = joined(docs, _sized(per_row, 32 * F.size("found")), ["doc_id", "row"]).select("doc_id", "row", _words(F.col("text")).alias("dw"), "found")

    def stretch(x):
        first = F.greatest(x["shift"], F.lit(0))
        return F.struct(x["item"].alias("item"), x["shift"].alias("shift"), first.alias("first"), F.slice("dw", first + 1, F.greatest(x["shift"] + x["size"] - first, F.lit(0))).alias("part"))

    parts = read.select("doc_id", "row", F.explode(F.transform("found", stretch)).alias("x")).select("doc_id", "row", "x.*").distinct()
    parts = parts.join(_sized(texts, _lengths("iw")), "item")
    size = F.least(F.col("size"), F.lit(window))
    starts = F.filter(
        F.sequence(F.lit(0), F.col("size") - size),
        lambda s: (F.col("shift") + s >= F.col("first")) & (F.slice("part", F.greatest(F.col("shift") + s - F.col("first"), F.lit(0)) + 1, size) == F.slice("iw", s + 1, size)),
    )
    hits = F.transform(starts, lambda s: F.struct(F.col("item_id"), (F.col("shift") + s).alias("first"), size.alias("words")))
    hits = parts.select("doc_id", "row", hits.alias("hits")).where(F.size("hits") > 0)
    return hits.groupBy("doc_id", "row").agg(F.flatten(F.collect_list("hits")).alias("hits"))


def _edits(words, part) -> F.Column:
    """(edits, last): the least number of words put in, left out or changed between ``words`` and a stretch of the array ``part``,
    and where in part the first such stretch ends (its last word's place, -1 if it is empty)."""
    zero = F.transform(F.sequence(F.lit(0), F.size(part)), lambda _: F.lit(0))

    def row(before, word):
        def cell(done, j):
            change = F.element_at(before, j) + (F.element_at(part, j) != word).cast("int")
            return F.concat(done, F.array(F.least(change, F.element_at(before, j + 1) + 1, F.element_at(done, j) + 1)))

        places = F.filter(F.sequence(F.lit(0), F.size(part)), lambda j: j > 0)
        return F.aggregate(places, F.array(F.element_at(before, 1) + 1), cell)

    ends = F.aggregate(words, zero, row)
    return F.struct(F.array_min(ends).alias("edits"), (F.array_position(ends, F.array_min(ends)) - 2).cast("int").alias("last"))


def near_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, slack: int = 2) -> DataFrame:
    """Proximity matches: (doc_id, row, item_id, at, edits, last) for each window of items that stands in a row of docs (doc_id,
    row, text) but for a few words put in, left out or changed: one for every five words of the window, ``slack`` at most.

    at is the window's first word in its item, edits the least that any stretch of the text needs (0: the exact phrase), last
    the place of that stretch's last word in the text, the first of several. Texts and items without words have no match.

    e edits leave all but e words of a window, shifted by e at most among themselves. So of its e + 2 rarest terms two are
    found within e of one shift; each posting is listed under the e + 1 shifts that it may be counted to.
    """
    allowed = F.least(F.lit(slack), F.floor(F.least(F.size("iw"), F.lit(window)) / 5)).cast("int")
    windows = written(item_windows(items, window).withColumn("allowed", allowed), "decon-windows")
    rare = rarest_terms(docs, windows, window, F.least(F.lit(slack), F.floor(F.col("words") / 5)) + 2)
    postings = written(index(docs, rare.select("term").distinct()), "decon-postings")
    places = rare.select("item", "term", F.col("pos").alias("place")).distinct()
    places = places.join(windows.select("item", "allowed").distinct(), "item")
    met = postings.join(_sized(places, F.octet_length("term")), "term").withColumn("shift", F.explode(F.sequence(F.col("pos") - F.col("place") - F.col("allowed"), F.col("pos") - F.col("place"))))
    met = met.groupBy("doc_id", "row", "item", "shift").agg(F.collect_set("place").alias("places"))
    wanted = rare.groupBy("item", "at").agg(F.collect_set("pos").alias("pos"))
    wanted = wanted.groupBy("item").agg(F.collect_list(F.struct("at", "pos")).alias("wanted")).join(windows.where("at = 0").select("item", "item_id", "iw", "allowed"), "item")
    met = met.join(_sized(wanted, _lengths("iw") + 64 * F.size("wanted")), "item")
    enough = F.filter("wanted", lambda x: F.size(F.array_intersect(x["pos"], "places")) >= F.least(F.size(x["pos"]), F.lit(2)))
    found = met.select("doc_id", "row", "item_id", "iw", "allowed", "shift", F.explode(enough).alias("x"))
    found = found.select("doc_id", "row", F.struct("item_id", F.col("x.at").alias("at"), F.slice("iw", F.col("x.at") + 1, window).alias("words"), "allowed", "shift").alias("x"))
    per_row = written(found.groupBy("doc_id", "row").agg(F.collect_list("x").alias("found")), "decon-found")
    read = joined(docs, _sized(per_row, F.aggregate("found", F.lit(0).cast("long"), lambda n, x: n + 64 + 32 * F.size(x["words"]))), ["doc_id", "row"]).select("doc_id", "row", _words(F.col("text")).alias("dw"), "found")

    def stretch(x):
        first = F.greatest(x["shift"] + x["at"] - x["allowed"], F.lit(0))
        stop = F.greatest(x["shift"] + x["at"] + F.size(x["words"]) + 2 * x["allowed"], first)
        return F.struct(*(x[k].alias(k) for k in ("item_id", "at", "words", "allowed")), first.alias("first"), F.slice("dw", first + 1, stop - first).alias("part"))

    tried = read.select("doc_id", "row", F.explode(F.transform("found", stretch)).alias("x")).select("doc_id", "row", "x.*").distinct()
    tried = tried.withColumn("best", _edits(F.col("words"), F.col("part"))).where("best.edits <= allowed")
    best = tried.groupBy("doc_id", "row", "item_id", "at", "words").agg(F.min(F.struct("best.edits", (F.col("first") + F.col("best.last")).alias("last"))).alias("best"))
    return best.select("doc_id", "row", "item_id", "at", "best.edits", "best.last")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each row of docs (doc_id, text) against items (item_id, text).

    n_words, n_hit (words inside occurring windows), n_items, items_sha256 (digest of the sorted item_ids) and contaminated.
    A null or wordless text has no words and is clean; an item without words has no window. Rows that repeat a doc_id are
    judged each by their text; equal items count once. Other columns of docs and items are left out.
    """
    docs = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    hits = phrase_hits(docs, items.select("item_id", "text"), window).dropDuplicates(["doc_id", "row"])
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["first"], h["first"] + h["words"] - 1))))
    names = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"])))
    found = hits.select("doc_id", "row", F.size(covered).cast("long").alias("n_hit"), names.alias("names"))
    counted = docs.select("doc_id", "row", F.size(_raw_words(F.col("text"))).cast("long").alias("n_words"))
    out = joined(counted, found, ["doc_id", "row"], "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size("names").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "names"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that hold no window of items; null doc_ids stay if their text is clean."""
    key = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    found = phrase_hits(key, items.select("item_id", "text"), window).select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"))
    return docs.join(_sized(written(found.distinct(), "decon-hit"), F.octet_length(F.col("_doc").cast("string"))), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_row")), "left_anti")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql_words(t: str) -> str:
    return f"regexp_extract_all(translate(coalesce({t}, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


ORACLE = {
    "op3_decontaminate": rf"""WITH d AS (SELECT doc_id, {_sql_words("text")} AS w FROM documents),
i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, {_sql_words("text")} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[s : s + least(len(w), {WINDOW}) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT DISTINCT doc_id, item_id, s, dw.n FROM dw JOIN iw ON iw.n = dw.n AND iw.g = dw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id"""
}
QUERIES = {"op3_decontaminate": op3_decontaminate}
