"""How far the sources of a language differ in their words, and which words set a source apart.

Each group (a language and a source) gives every kept term of the language a smoothed share in billionths, and two groups differ
by the sum over all kept terms of (p - q)^2 / (p + q), rounded down term by term. Summing over the whole vocabulary for each
pair of groups would visit mostly terms that neither has. So the sum is priced by inclusion and exclusion over the supports:

- a term that one side alone has costs the same for all terms of one count, so each group's histogram (count, number of terms)
  prices its whole support against the other side's share of an unseen term;
- a term that both have was thus priced twice, at the wrong share: a join of the posting lists (term, group, count) of kept
  terms puts right each such overlap, and nothing but overlaps;
- the terms that neither has are a number times a constant.

Pairs of groups are taken once and mirrored. Overlaps are summed within each task of the join before they are shuffled, so a
term that all sources share costs rows of that join and no shuffle. Terms are counted per task before the one shuffle of
postings, and a frequent term is then a row per task and group at most.

Defined cases: null lang, source and text are ''; a text without terms makes its group occur; repeated rows are documents each;
an empty table gives an empty result; a language without kept terms gives pairs of value 0; other columns are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vireo.llm.common import materialize, read_table, small_batches

MIN_DOCS = 10  # documents of a language that a kept term is in
SMOOTHING = 2  # added to every count
SCALE = 1_000_000_000
TOP_TERMS = 10
HELD_TERMS = 300_000  # terms that a task counts before it passes them on

POSTINGS = "lang string, source string, term string, n long, docs long"
#: ASCII letters in lower case, other ASCII bytes as blanks, all bytes of other letters as they are.
_FOLD = bytes((k + 32 if 65 <= k <= 90 else k) if k >= 128 or 65 <= k <= 90 or 97 <= k <= 122 else 32 for k in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of letters: A-Z (folded), a-z and whatever isn't ASCII."""
    return text.translate(_FOLD).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents) of what this task has read, in portions; each group also as the term '' with 0."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def portion() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            words = [b"", *n]
            arrays = [pa.array([x] * len(words)) for x in (lang, source)]
            arrays += [pa.array(words, pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[w] for w in n)], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"])
        groups.clear()

    for batch in batches:
        found: dict[tuple[str, str], list[list[bytes]]] = {}
        for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            found.setdefault((lang, source), []).append(terms(text))
        for key, texts in found.items():
            n, docs = groups.setdefault(key, (Counter(), Counter()))
            n.update(chain.from_iterable(texts))
            docs.update(chain.from_iterable(map(set, texts)))
        if sum(len(n) for n, _ in groups.values()) > HELD_TERMS:
            yield from portion()
    yield from portion()


def share(count: Column, total: Column, v: Column) -> Column:
    """The share of a term in billionths: 1 + floor(1e9 (count + 2) / (total + 2 V)), exact in longs. Where V is 0 there is nothing to share, and no use is made of it."""
    one = F.lit(1).cast("long")
    top = (count + F.lit(SMOOTHING).cast("long")) * F.lit(SCALE).cast("long")
    return F.call_function("div", top, F.greatest(total + v * F.lit(SMOOTHING).cast("long"), one)) + one


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)): below 2^63, since shares are at most a billion and one."""
    return F.call_function("div", (p - q) * (p - q), p + q)


class Audit:
    """Postings of kept terms and totals of groups, as written tables, with what is asked of them.

    kept: lang, source, term, n, and all (the term's count in its language). groups: lang, source, total, support, lang_total and
    v, for every group that occurs.
    """

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS) -> None:
        small_batches(docs.sparkSession)
        text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        rows = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
        # one shuffle, by term: counts of groups, of languages and the choice of terms all follow from it
        dealt = rows.mapInArrow(_count, POSTINGS).repartition(F.col("lang"), F.col("term"))
        postings = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        of_term = Window.partitionBy("lang", "term")
        postings = postings.withColumn("all", F.sum("n").over(of_term)).withColumn("all_docs", F.sum("docs").over(of_term)).withColumn("first", F.min("source").over(of_term) == F.col("source"))
        held = materialize(postings.filter((F.col("all_docs") >= min_docs) | (F.col("term") == "")).drop("docs", "all_docs"))
        self.kept = held.filter("term <> ''")
        real = F.col("term") != ""
        languages = held.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if(real & F.col("first")).alias("v"))
        sums = held.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(real).alias("support"))
        self.groups = materialize(sums.join(languages, "lang"))

    def one_sided(self) -> DataFrame:
        """lang, source, other and value: a group's whole support, each term priced against the other's share of a term it lacks."""
        bars = self.kept.groupBy("lang", "source", "n").agg(F.count("*").alias("terms"))
        bars = bars.join(self.groups, ["lang", "source"]).select("lang", "source", "terms", share(F.col("n"), F.col("total"), F.col("v")).alias("p"))
        others = self.groups.select("lang", F.col("source").alias("other"), share(F.lit(0).cast("long"), F.col("total"), F.col("v")).alias("zero"))
        met = bars.join(others, "lang").filter("source <> other")
        return met.groupBy("lang", "source", "other").agg(F.sum(F.col("terms") * gap(F.col("p"), F.col("zero"))).alias("value"))

    def overlaps(self) -> DataFrame:
        """lang, a < b and value: what the two one-sided prices and the constant get wrong for the terms that both have."""
        zero = share(F.lit(0).cast("long"), F.col("total"), F.col("v"))
        priced = self.kept.join(self.groups, ["lang", "source"]).select("lang", "term", "source", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), zero.alias("zero"))
        x = priced.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("zero").alias("za"))
        y = priced.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("zero").alias("zb"))
        right = gap(F.col("pa"), F.col("pb")) - gap(F.col("pa"), F.col("zb")) - gap(F.col("za"), F.col("pb")) + gap(F.col("za"), F.col("zb"))
        return x.join(y, ["lang", "term"]).filter("a < b").groupBy("lang", "a", "b").agg(F.sum(right).alias("value"))

    def pairs(self) -> DataFrame:
        """lang, source, item (another source of the language), value and rank."""
        zero = share(F.lit(0).cast("long"), F.col("total"), F.col("v"))
        ends = self.groups.select("lang", "source", "support", zero.alias("zero"), "v")
        x, y = (ends.select("lang", F.col("source").alias(s), F.col("support").alias(f"k{s}"), F.col("zero").alias(f"z{s}"), *(["v"] if s == "a" else [])) for s in "ab")
        neither = F.coalesce((F.col("v") - F.col("ka") - F.col("kb")) * gap(F.col("za"), F.col("zb")), F.lit(0).cast("long"))
        base = x.join(y, "lang").filter("a < b").select("lang", "a", "b", neither.alias("value"))  # the rows of the result, halved
        ordered = self.one_sided().select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), "value")
        summed = base.unionByName(ordered).unionByName(self.overlaps()).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
        both = summed.withColumn("way", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))))
        both = both.select("lang", "way.source", "way.item", "value")
        return both.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    def distinctive(self, top: int = TOP_TERMS) -> DataFrame:
        """lang, source, item (a term more frequent here than in the language), value and rank, to the given rank."""
        rows = self.kept.join(self.groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("all"), F.col("lang_total"), F.col("v")).alias("q"))
        rows = rows.filter("p > q").select("lang", "source", "item", gap(F.col("p"), F.col("q")).alias("value"))
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).filter(F.col("rank") <= top)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts ``pair`` and ``term`` of the audit of all documents: lang, source, part, item, value and rank."""
    audit = Audit(read_table(spark, sf_dir, "documents"))
    parts = (audit.pairs().withColumn("part", F.lit("pair")), audit.distinctive().withColumn("part", F.lit("term")))
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", "rank")


#: Every kept term of every pair, as the definition says.
ORACLE = r"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 10),
grp AS (SELECT DISTINCT lang, source FROM d), v AS (SELECT lang, count(*) AS v, sum(c)::BIGINT AS n FROM kept GROUP BY lang),
held AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
tot AS (SELECT grp.lang, grp.source, coalesce(sum(c), 0)::BIGINT AS n FROM grp LEFT JOIN held USING (lang, source) GROUP BY grp.lang, grp.source),
p AS (SELECT tot.lang, tot.source, kept.term, coalesce(held.c, 0) AS c, 1 + 1000000000 * (coalesce(held.c, 0) + 2) // (tot.n + 2 * v) AS p, 1 + 1000000000 * (kept.c + 2) // (v.n + 2 * v) AS q
  FROM tot JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN held ON held.lang = tot.lang AND held.source = tot.source AND held.term = kept.term),
s AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p))::BIGINT AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pr AS (SELECT x.lang, x.source, y.source AS item, coalesce(value, 0) AS value FROM grp x JOIN grp y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
t AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pr
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM t) WHERE rank <= 10"""
