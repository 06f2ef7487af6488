"""Groups of spelling variants: words one edit apart, found by composing the vocabulary's acceptor with a one-edit transducer and with the acceptor again.

Two words are near if one inserted, deleted or replaced code point turns one into the other. Where they first differ lies in
some range of places; words that may differ there share what stands before the range and what stands after it. A shared
beginning is a state of the vocabulary's acceptor, a shared end one of its reversal, and such a state is the initial state of one
partition: its acceptor reads what lies between. It is built minimal from the partition's sorted words and numbers them by the
words that it accepts before each arc. The composition then walks it twice at once: both in one state until the edit, after it
in two, as long as both have the next arc. Every pair differs first at one place, so it comes out of one partition, once.

At first each word has two ranges, its first and its second half. Partitions of too many words, or characters, split their range
in two and are formed anew, with more of the words shared, down to single places, where what lies between is one or two code
points and so bounded by the alphabet.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.llm.common import dealt, hot_keys, table, written

#: Words and characters of one partition; beyond either its range of places is split.
WORDS, CHARS = 4_096, 200_000
#: Pairs that leave a worker at once.
_OUT = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Acceptor:
    """The minimal acyclic automaton of sorted, distinct strings. arcs[s][c] is the next state and the number of words of s before it."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        size: list[int] = []
        known: dict[tuple, int] = {}
        path: list[list] = [[False, []]]  # states that may still get arcs, from the first one along the last word
        last = ""

        def close() -> int:
            """The state of the path's end: one that is known already if it accepts the same."""
            final, out = path.pop()
            key = (final, tuple(out))
            state = known.get(key)
            if state is None:
                state = known[key] = len(self.arcs)
                steps, n = {}, int(final)
                for c, to in out:
                    steps[c] = (to, n)
                    n += size[to]
                self.arcs.append(steps)
                self.final.append(final)
                size.append(n)
            return state

        for w in [*words, ""]:
            same = 0
            for a, b in zip(last, w, strict=False):
                if a != b:
                    break
                same += 1
            while len(path) > same + 1:
                state = close()
                path[-1][1].append((last[len(path) - 1], state))
            for _ in range(len(w) - same):
                path.append([False, []])
            path[-1][0] |= bool(words) and (w != "" or words[0] == "")
            last = w
        self.first = close()


def near_pairs(words: list[str], behind: bool = True) -> list[tuple[int, int, bool]]:
    """Numbers (i, j) of the sorted, distinct words that one edit turns into each other, and whether j has a code point more.

    behind: whether that code point may stand behind the whole of the shorter word.
    """
    machine = Acceptor(words)
    arcs, final = machine.arcs, machine.final
    out: list[tuple[int, int, bool]] = []
    before = [(machine.first, 0)]
    while before:
        s, i = before.pop()
        steps = list(arcs[s].items())
        after = []
        for k, (a, (to, n)) in enumerate(steps):
            before.append((to, i + n))
            after += [(to, to_b, i + n, i + n_b, False) for _, (to_b, n_b) in steps[k + 1 :]]
            # a stands in the longer word only; were the next of both a again, the words would differ first further on
            if behind and final[s] and final[to]:
                out.append((i, i + n, True))
            after += [(arcs[to][c][0], to_b, i + n + arcs[to][c][1], i + n_b, True) for c, (to_b, n_b) in steps if c != a and c in arcs[to]]
        while after:
            s1, s2, i1, i2, longer = after.pop()
            if final[s1] and final[s2]:
                out.append((i2, i1, True) if longer else (i1, i2, False))
            one, two = arcs[s1], arcs[s2]
            for c in one if len(one) <= len(two) else two:
                if c in one and c in two:
                    after.append((one[c][0], two[c][0], i1 + one[c][1], i2 + two[c][1], longer))
    return out


def _pairs(batches):
    """Rows arrive sorted by partition: near words as (a, n_a, b, n_b)."""
    columns = ("key", "word", "n", "size", "lo", "hi")
    found: list[tuple] = []

    def solve(rows: list[tuple]) -> None:
        size, lo, hi = rows[0][3:]
        tail = max(0, size - hi)
        by = {r[1][lo : len(r[1]) - tail]: r for r in rows}
        if len(by) < 2:
            return
        words = sorted(by)
        for i, j, longer in near_pairs(words, hi > size):  # a place behind the range belongs to the next one
            # two words of the greater size belong to the partition of that size
            if longer or len(words[i]) == size - tail - lo:
                a, b = by[words[i]], by[words[j]]
                found.append((a[1], a[2], b[1], b[2]))

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), (pa.string(), pa.int64()) * 2, strict=True)], ["a", "n_a", "b", "n_b"])
        found.clear()
        return batch

    own: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if own and own[0][0] != row[0]:
                if len(own) > 1:
                    solve(own)
                own = []
                if len(found) >= _OUT:
                    yield flush()
            own.append(row)
    if len(own) > 1:
        solve(own)
    if found:
        yield flush()


def _keyed(rows: DataFrame) -> DataFrame:
    """Names each row's partition: size of its shorter words, range of places, what its words share before and after it."""
    tail = F.greatest(F.lit(0), F.col("size") - F.col("hi"))
    shared = [F.substring("word", F.lit(1), F.col("lo")), F.when(tail > 0, F.substring("word", F.char_length("word") - tail + 1, tail)).otherwise("")]
    return rows.withColumn("key", F.concat_ws("|", "size", "lo", "hi", *shared))


def _halved(lo: Column, hi: Column) -> Column:
    middle = F.floor((lo + hi) / 2).cast("int")
    return F.array(F.struct(lo.alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), hi.alias("hi")))


def near_words(words: DataFrame, shortest: int, limit: int = WORDS, chars: int = CHARS) -> DataFrame:
    """Pairs (a, n_a, b, n_b) of near words among distinct (word, n) of at least ``shortest`` code points, each pair once."""
    # a word meets those of its own size and one more, as the shorter one, and those of one less, as the longer one
    sizes = F.expr(f"filter(array(char_length(word), char_length(word) - 1), x -> x >= {shortest})")
    rows = words.select("word", "n", F.explode(sizes).alias("size")).withColumn("r", F.explode(_halved(F.lit(0), F.col("size") + 1)))
    rows = written(_keyed(rows.select("word", "n", "size", "r.lo", "r.hi")), "spelling-partitions")
    small = []
    while True:
        counts = written(rows.groupBy("key").agg(F.count("*").alias("members"), F.sum(F.char_length("word")).alias("chars"), F.first(F.col("hi") - F.col("lo")).alias("places")).where("members > 1"), "spelling-counts")
        total = counts.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
        large = (F.col("places") > 1) & ((F.col("members") > limit) | (F.col("chars") > chars))
        # partitions of one word end here
        met = written(dealt(rows, counts.select("key", "members", large.alias("large")), "key", "word", hot_keys(counts, "key", "members", total)), "spelling-met")
        small.append(met.where("not large"))
        rest = met.where("large").select("word", "n", "size", F.explode(_halved(F.col("lo"), F.col("hi"))).alias("r"))
        if not met.where("large").limit(1).count():
            break
        rows = written(_keyed(rest.select("word", "n", "size", "r.lo", "r.hi")), "spelling-partitions")
    every = small[0]
    for s in small[1:]:
        every = every.unionByName(s)
    every = every.select("key", "word", "n", "size", "lo", "hi")
    return every.repartition("key").sortWithinPartitions("key").mapInArrow(_pairs, "a string, n_a long, b string, n_b long")


def vocabulary(docs: DataFrame, shortest: int = 7, least: int = 2, noise: int = 31) -> DataFrame:
    """(word, n): words of docs (doc_id, text) with how often they occur, of at least shortest code points and least occurrences.

    Words are maximal runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased. Where noise divides the crc32 of
    ``<doc_id>:<run>`` the run loses the code point at crc32 % length. A null text has no words; a null doc_id is written as nothing.
    """
    letters = f"[a-z\\u00C0-\\u00FF]{{{shortest},}}"
    low = F.translate("text", _UPPER, _LOWER)
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(low, F.lit(letters), F.lit(0))).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    runs = runs.select("run", h.alias("h"))
    at = F.pmod("h", F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run"))
    counted = runs.select(word.alias("word")).where(F.char_length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least)


def variants(words: DataFrame, shortest: int = 7, times: int = 10, limit: int = WORDS, chars: int = CHARS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for distinct (word, n).

    form is the near word of largest n, the smallest of equals, if that is at least ``times`` the word's own n; root follows
    forms to the last and is the word itself without one. Forms grow in n, so they make no circle.
    """
    pairs = near_words(words, shortest, limit, chars)
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("n_other")), F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("n_other")))
    best = F.min(F.struct((-F.col("n_other")).alias("less"), F.col("other"))).alias("best")
    near = pairs.select(F.inline(sides)).groupBy("word").agg(F.first("n").alias("n"), F.count("*").alias("n_near"), best)
    takes = -F.col("best.less") >= times * F.col("n")
    near = written(near.select("word", "n_near", F.when(takes, F.col("best.other")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n")), "spelling-near")
    # roots by doubling: each round follows a word's root as far as that one's is known
    roots = written(near.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        # many words share a form, so the rows of one are dealt over tasks
        shared = roots.groupBy("root").agg(F.count("*").alias("c"))
        onward = dealt(roots, on, "root", "word", hot_keys(shared, "root", "c", roots.count()))
        onward = written(onward.select("word", F.col("next").alias("root")), "spelling-onward")
        if not onward.limit(1).count():
            break
        roots = written(roots.join(onward.withColumnRenamed("root", "next"), "word", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
    got = words.join(near, "word", "left").join(roots, "word", "left")
    return got.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(written(vocabulary(table(spark, sf_dir, "documents")), "spelling-words"))


#: crc32 by its table, a byte at a time; near words by what is left when one code point is taken out.
_CRC = """t0 AS (SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) x(i) UNION ALL
  SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM t0 WHERE k < 8),
t AS (SELECT list(c ORDER BY i) AS crc FROM t0 WHERE k = 8)"""
ORACLE = {
    "op11_spelling": rf"""WITH RECURSIVE {_CRC},
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]{{7,}}')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n, doc_id || ':' || run AS s FROM r GROUP BY ALL),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(s))), lambda i: ('0x' || substr(hex(encode(s)), 2 * i + 1, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255::BIGINT) + 1])), 4294967295::BIGINT) AS h FROM d, t),
c AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM c WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
x AS (SELECT word, n, i AS place, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM v)),
p AS (SELECT a.word, a.n, b.word AS other, b.n AS n_other FROM x a JOIN x b ON a.rest = b.rest AND a.place = b.place AND a.word <> b.word
  UNION SELECT x.word, x.n, v.word, v.n FROM x JOIN v ON v.word = x.rest UNION SELECT v.word, v.n, x.word, x.n FROM x JOIN v ON v.word = x.rest),
m AS (SELECT word, count(*) AS n_near, min({{'less': -n_other, 'other': other}}) AS best FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 10 * v.n THEN best.other END AS form, CASE WHEN -best.less >= 10 * v.n THEN -best.less END AS form_n FROM v LEFT JOIN m ON m.word = v.word),
w AS (SELECT word, word AS root, 0 AS k FROM f UNION ALL SELECT w.word, f.form, k + 1 FROM w JOIN f ON f.word = w.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, g.root, f.n, f.n_near, f.form_n::BIGINT AS form_n FROM f JOIN (SELECT word, arg_max(root, k) AS root FROM w GROUP BY word) g ON g.word = f.word"""
}
QUERIES = {"op11_spelling": op11_spelling}
