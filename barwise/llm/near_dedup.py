"""Near-duplicate documents by MinHash with tensored banding, verified on full shingle sets.

``COLLECTIONS`` small collections of ``ROWS`` minhashes each are computed per document. A table key joins two collections,
so 8 collections of 2 (16 minhashes) serve 28 tables of 4, where separate bands would take 112 minhashes. Two documents
meet unless fewer than two collections agree: at similarity 0.85 that happens to one pair in about 1,300, at 0.9 to one in
about 26,000.

Documents with one shingle set are one class, named by the least doc_id. Within a table's group every class is compared
with the group's most central class (the one that meets the most others over all tables) and PIVOTS more instead of with
every other; groups whose members are then connected are finished. What stays apart is compared across components, all of
it in groups of up to GROUP classes. The classes of larger groups are joined anew, exactly: each is listed under the rarest
of its shingles (by counts in buckets, a bounded table), as many as it takes for two sets that reach the similarity to share
one, and pairs meet only where what is left behind the shared shingle can still suffice. A rare shingle's list is short even
where thousands of texts share a template. Lists of over GROUP classes are compared with pivots first; what is apart even
then is compared in full, block by block. So no pair that a table brings together is given up.

Every class carries a sketch of SKETCH_BITS: of each bucket of its shingles whether their number is odd. The bits in which two
sketches differ are at most the shingles in which the sets differ, so pairs too far apart by them cannot be links and are left
out where they meet, before any text is read. What a long list that falls into many components costs by its square is the
comparison of sketches; texts are read for pairs that are links or nearly so.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.llm.common import LOWER, U64, Rolling, checkpointed, dealt, flat, hot_keys, mixed, pieces, signed, table, written

COLLECTIONS, ROWS = 8, 2
#: Classes that a group compares across components in one block, and pivots beside the most central one.
GROUP, PIVOTS = 64, 3
#: Bits of a class's sketch, in longs.
SKETCH_BITS = 512
_SKETCH = [f"w{i}" for i in range(SKETCH_BITS // 64)]
_SKETCH_TYPE = f"struct<{','.join(f'{w}:long' for w in _SKETCH)}>"
#: Buckets by which the rarity of shingles is known, as a power of two; their counts come to the driver.
RARITY_BITS = 18
_RARITY_SHIFT = U64(64 - RARITY_BITS)
_WORD = Rolling(21)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_R = np.random.default_rng(22)
_MUL = (_R.integers(1, 2**62, COLLECTIONS * ROWS).astype(U64) << U64(1)) | U64(1)
_STEP = [U64(int(x)) for x in _R.integers(1, 2**62, 16) * 2 + 1]


def shingle_sets(data: np.ndarray, ends: np.ndarray, width: int) -> list[np.ndarray]:
    """For each document the sorted distinct 64-bit shingle hashes: words lower-cased in A-Z and split at ASCII white space."""
    data = LOWER[data]
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    start = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    stop = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1 if len(data) else start
    words = mixed(_WORD.of(_WORD.sums(data), start, stop) + (stop - start).astype(U64))
    first = np.searchsorted(start, ends[:-1])
    last = np.searchsorted(start, ends[1:])
    n = max(0, len(words) - width + 1)
    wide = np.zeros(n, U64)
    for k in range(width):
        wide += words[k : k + n] * _STEP[k]
    wide = mixed(wide)
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(wide[a : b - width + 1]))
        elif b > a:
            short = np.array([b - a], U64)
            for k in range(b - a):
                short = short * _STEP[15] + words[a + k]
            out.append(mixed(short))
        else:
            out.append(np.zeros(0, U64))
    return out


def sketches(sets: list[np.ndarray]) -> pa.Array:
    """The parities of the shingles' buckets: two of them differ in no more bits than their sets in shingles."""
    size = [len(s) for s in sets]
    at = np.repeat(np.arange(len(sets)), size) * SKETCH_BITS
    if len(at):
        at += (np.concatenate(sets) & U64(SKETCH_BITS - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=len(sets) * SKETCH_BITS) & 1).astype(np.uint8)
    words = np.packbits(odd).view(np.int64).reshape(len(sets), len(_SKETCH))
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(words[:, i])) for i in range(len(_SKETCH))], _SKETCH)


def _signatures(width: int):
    def run(batches):
        for batch in pieces(batches, "text"):
            sets = shingle_sets(*flat(batch.column("text")), width)
            size = np.array([len(s) for s in sets])
            full = np.flatnonzero(size)
            keys = np.zeros((len(sets), COLLECTIONS), U64)
            one, two = np.zeros(len(sets), U64), np.zeros(len(sets), U64)
            if len(full):
                every = np.concatenate([sets[i] for i in full])
                at = np.concatenate([[0], size[full].cumsum()[:-1]])
                one[full], two[full] = np.add.reduceat(every, at), np.add.reduceat(mixed(every), at)
                for c in range(COLLECTIONS):
                    for r in range(ROWS):
                        low = np.minimum.reduceat(mixed(every * _MUL[c * ROWS + r]), at)
                        keys[full, c] = mixed(keys[full, c] * _STEP[14] + low + U64(c))
            columns = [signed(np.ascontiguousarray(keys[:, c])) for c in range(COLLECTIONS)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), signed(one), signed(two), *columns, sketches(sets)], ["doc_id", "n_shingles", "s1", "s2", *(f"k{c}" for c in range(COLLECTIONS)), "sketch"])

    return run


def _seen(width: int):
    """How often the shingles of a bucket occur, for buckets by hash."""

    def run(batches):
        total = np.zeros(1 << RARITY_BITS, np.int64)
        for batch in pieces(batches, "text"):
            sets = shingle_sets(*flat(batch.column("text")), width)
            if sets:
                np.add.at(total, (np.concatenate(sets) >> _RARITY_SHIFT).astype(np.int64), 1)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["bucket", "n"])

    return run


def _rarest(width: int, similarity_pct: int, often: np.ndarray):
    """Of each class the shingles that come first in one order for all, rare ones first: as many as two sets that reach the
    similarity need to share one. after counts a shingle and those behind it; what occurs once has no partner and is left out."""

    def run(batches):
        for batch in pieces(batches, "text"):
            keys = []
            for s in shingle_sets(*flat(batch.column("text")), width):
                count = often[(s >> _RARITY_SHIFT).astype(np.int64)]
                order = np.lexsort((s, count))
                after = len(s) - np.arange(len(s))
                own = (100 * after >= similarity_pct * len(s)) & (count[order] > 1)
                keys.append([{"key": k, "after": a, "n": len(s)} for k, a in zip(s[order][own].view(np.int64).tolist(), after[own].tolist(), strict=True)])
            kind = pa.list_(pa.struct([("key", pa.int64()), ("after", pa.int64()), ("n", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("weight"), pa.array(keys, kind)], ["node", "weight", "keys"])

    return run


def _overlaps(width: int, similarity_pct: int):
    """Keeps the pairs (a, b) whose sets reach the similarity; rows of one a follow each other, so its set is made once."""

    def run(batches):
        last, left = None, None
        for big in batches:
            for batch in pieces(iter([big]), "text_b"):
                right = shingle_sets(*flat(batch.column("text_b")), width)
                ids = batch.column("a").to_pylist()
                keep = []
                for i, a in enumerate(ids):
                    if left is None or a != last:
                        left = shingle_sets(*flat(batch.column("text_a").slice(i, 1)), width)[0]
                        last = a
                    both = len(np.intersect1d(left, right[i], assume_unique=True))
                    if both and 100 * both >= similarity_pct * (len(left) + len(right[i]) - both):
                        keep.append(i)
                yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _components(links: DataFrame) -> DataFrame:
    """(node, component): least node reachable over links (a, b). Large-star and small-star rounds, checkpointed each."""

    def toward_least(rows: DataFrame, total: int) -> DataFrame:
        """rows (u, v) with m, the least v of u; the rows of a node with very many links are dealt over tasks."""
        low = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("links"))
        return dealt(rows, low.drop("links"), "u", "v", hot_keys(low, "u", "links", total))

    edges = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = None
    while True:
        # a round that leaves the edges as they were is the last; equal count and sum of hashes stand for equal edges
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = toward_least(both, 2 * now[0]).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u != v").distinct()
        small = toward_least(large, now[0]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.where("u != v").distinct())


def near_classes(docs: DataFrame, width: int = 5, similarity_pct: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text); width words a shingle, links from similarity_pct % on.

    A null or blank text has an empty set and is linked with nothing. Fewer words than width make one shingle of all words.
    Of rows that repeat a doc_id each takes the component of its own text; rows without a doc_id have a component only if
    another document has their shingle set. Other columns of docs are left out.
    """
    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keys = [f"k{c}" for c in range(COLLECTIONS)]
    signatures = written(texts.mapInArrow(_signatures(width), f"doc_id {kind}, n_shingles long, s1 long, s2 long, " + ", ".join(f"{k} long" for k in keys) + f", sketch {_SKETCH_TYPE}"), "near-signatures")
    filled = signatures.where("n_shingles > 0")
    classes = filled.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("node"), *(F.min(k).alias(k) for k in keys))
    tables = F.array(*(F.xxhash64(F.lit(t), keys[i], keys[j]) for t, (i, j) in enumerate(combinations(range(COLLECTIONS), 2))))
    slots = classes.select("node", F.col("n_shingles").alias("n"), F.explode(tables).alias("key"))
    sizes = written(slots.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "near-sizes")
    crowded = hot_keys(sizes, "key", "members", sizes.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0])
    # from here a class is one row, with the keys of its groups; rows by key are made of it where groups are formed
    met = dealt(slots, sizes, "key", "node", crowded)
    central = met.groupBy("node").agg(F.sum("members").alias("weight"), F.collect_list(F.struct("key", "n")).alias("keys"))
    central = written(central.join(filled.select(F.col("doc_id").alias("node"), "sketch").distinct(), "node"), "near-nodes")
    # the texts that any table brings together, once for all rounds
    bodies = written(texts.join(central.select(F.col("node").alias("doc_id"), "weight").distinct(), "doc_id"), "near-texts")

    def verified(candidates: DataFrame) -> DataFrame:
        candidates = written(candidates, "near-candidates")
        often = candidates.groupBy("a").agg(F.count("*").alias("pairs"))
        right = candidates.join(bodies.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        left = bodies.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
        both = dealt(right, left.join(often.select("a"), "a", "left_semi"), "a", "b", hot_keys(often, "a", "pairs", candidates.count()))
        return written(both.select("a", "text_a", "b", "text_b").mapInArrow(_overlaps(width, similarity_pct), f"a {kind}, b {kind}"), "near-links")

    most = F.struct("weight", F.xxhash64("node"))
    as_pivot = F.struct(F.col("node").alias("p"), F.col("n").alias("n_p"), F.col("component").alias("c_p"))
    with_sketch = F.struct(F.col("node").alias("p"), F.col("n").alias("n_p"), F.col("component").alias("c_p"), F.col("sketch").alias("sketch_p"))
    sized = F.expr(f"100 * least(n, n_p) >= {similarity_pct} * greatest(n, n_p)")
    gap = sum((F.bit_count(F.col(f"sketch.{w}").bitwiseXOR(F.col(f"sketch_p.{w}"))) for w in _SKETCH), F.lit(0))
    near = F.lit(100 + similarity_pct) * gap <= F.lit(100 - similarity_pct) * (F.col("n") + F.col("n_p"))

    def with_pivots(groups: DataFrame, by: str, spread: int, hot: DataFrame) -> DataFrame:
        """Every member against the group's most central one and ``spread`` arbitrary ones."""
        chosen = [F.max_by(as_pivot, most), *(F.max_by(as_pivot, F.xxhash64("node", F.lit(i))) for i in range(spread))]
        pivots = groups.groupBy(by).agg(F.array_distinct(F.array(*chosen)).alias("x"))
        met = dealt(groups.select(by, "node", "n", "component"), pivots, by, "node", hot).select("node", "n", "component", F.inline("x"))
        met = met.where("component != c_p").where(sized).select("p", "n_p", "node", "n").distinct()
        own = central.select(F.col("node").alias("p"), F.col("sketch").alias("sketch_p"))
        return paired(met.join(central.select("node", "sketch"), "node").join(own, "p"))

    def close(groups: DataFrame, others: DataFrame, by: list[str], more: str) -> DataFrame:
        """The rows of groups with others of the same group (p, n_p, c_p, sketch_p) in other components."""
        return paired(groups.join(others, by).where("component != c_p" + more).where(sized))

    def paired(met: DataFrame) -> DataFrame:
        """Those that the sketches let reach the similarity."""
        return met.where(near).select(F.col("p").alias("a"), F.col("node").alias("b")).distinct()

    def sketched(rows: DataFrame) -> DataFrame:
        return rows.join(central.select("node", "sketch"), "node")

    def across(groups: DataFrame, by: str) -> DataFrame:
        """The members of each group of GROUP at most against those of other components."""
        groups = sketched(groups)
        return close(groups, groups.select(by, with_sketch.alias("x")).select(by, "x.*"), [by], " AND p < node")

    def listed(nodes: DataFrame) -> DataFrame:
        """Each class (node, weight) with its rarest shingles (key, after, n)."""
        rows = written(bodies.join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi"), "near-large-texts")
        often = np.zeros(1 << RARITY_BITS, np.int64)
        for r in rows.mapInArrow(_seen(width), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
            often[r["bucket"]] = r["n"]
        return rows.mapInArrow(_rarest(width, similarity_pct, often), f"node {kind}, weight long, keys array<struct<key:long,after:long,n:long>>")

    def across_listed(groups: DataFrame) -> DataFrame:
        """As across() for lists of any length. Those outside a list's largest component meet all of it, a part of about GROUP at a time."""
        parts = F.ceil(F.col("members") / GROUP).cast("int")
        held = groups.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("main"))
        groups = sketched(groups)
        shares = groups.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))
        shares = shares.select("key", "part", with_sketch.alias("y"), F.col("after").alias("after_p")).select("key", "part", "y.*", "after_p")
        outside = groups.join(held, "key").where("component != main").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        return close(outside, shares, ["key", "part"], f" AND {100 + similarity_pct} * least(after, after_p) >= {similarity_pct} * (n + n_p)")

    def still_apart(nodes: DataFrame, parts: DataFrame, listed: bool = False) -> tuple[DataFrame, DataFrame]:
        """The members of the groups that hold several components yet, with those and the number of members; and the hot keys.

        In a list a member needs a partner of at most (100 + pct) / pct * after - n shingles; one for whom even the smallest set
        of the list is too large is not among its members.
        """
        named = nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
        rows = named.select("node", "weight", "component", F.inline("keys"))
        whole = [F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("members")]
        fits = F.lit(True)
        if listed:
            fits = F.expr(f"{100 + similarity_pct} * after >= {similarity_pct} * (n + least)")
            whole.append(F.min("n").alias("least"))
        open_ = written(rows.groupBy("key").agg(*whole).where("c0 != c1").drop("c0", "c1"), "near-open")
        hot = hot_keys(open_, "key", "members", open_.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0])
        apart = written(dealt(rows, open_, "key", "node", hot).where(fits).drop("least"), "near-apart")
        if listed:
            left = apart.drop("members").groupBy("key").agg(*whole[:3]).where("c0 != c1").drop("c0", "c1")
            apart = written(dealt(apart.drop("members"), left, "key", "node", hot), "near-apart")
        return apart, hot

    alone = central.select("node", "weight", F.col("node").alias("component"), F.inline("keys"))
    links = verified(with_pivots(alone, "key", PIVOTS, crowded))
    parts = written(_components(links), "near-components")
    apart, _ = still_apart(central, parts)
    if apart.limit(1).count():
        rest = across(apart.where(F.col("members") <= GROUP), "key")
        large = written(apart.where(F.col("members") > GROUP).select("node").distinct(), "near-large")
        lists = None
        if large.limit(1).count():
            listings = written(listed(large), "near-lists")
            lists, hot = still_apart(listings, parts, True)
            rest = rest.unionByName(across_listed(lists.where(F.col("members") <= GROUP))).unionByName(with_pivots(lists.where(F.col("members") > GROUP), "key", PIVOTS, hot))
        links = links.unionByName(verified(rest.distinct()))
        parts = written(_components(links), "near-components")
        if lists is not None:
            lists, _ = still_apart(listings, parts, True)
            lists = lists.where(F.col("members") > GROUP)
            if lists.limit(1).count():
                links = links.unionByName(verified(across_listed(lists)))
                parts = written(_components(links), "near-components")
    found = classes.select("s1", "s2", "n_shingles", "node").join(parts, "node", "left")
    found = found.select("s1", "s2", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    own = filled.select("doc_id", "s1", "s2", "n_shingles").join(found, ["s1", "s2", "n_shingles"]).select("doc_id", "n_shingles", "component_id")
    return own.unionByName(signatures.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def near_dedup(docs: DataFrame, width: int = 5, similarity_pct: int = 80) -> DataFrame:
    """The rows of docs whose document stands for its component; rows without a doc_id stay, as do all that repeat a kept one."""
    keep = near_classes(docs, width, similarity_pct).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_classes(table(spark, sf_dir, "documents"), width=3, similarity_pct=85)
    return got.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


_SHINGLES = r"""
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
r AS (SELECT DISTINCT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
"""
ORACLE = {
    "op6_near_dedup": f"""WITH RECURSIVE {_SHINGLES.strip()}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT u, min(v) AS component_id FROM r GROUP BY u) c ON c.u = d.doc_id"""
}
QUERIES = {"op6_near_dedup": op6_near_dedup}
