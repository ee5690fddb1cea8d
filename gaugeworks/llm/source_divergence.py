"""Operator 13: audit of how far sources differ in the words they use.

Each language keeps the terms that stand in enough of its documents. A group is a language and a source; its share of
a term is smoothed and rounded down to integers of 10^-9, so that all sums are exact. Two sources of a language differ
by the sum over all kept terms of the absolute differences of their shares.

Pairs are summed in a cube. The terms of a language are dealt into blocks by hash, its sources into blocks by order. A
slice holds the shares of one block of sources over one block of terms, as one row; it is copied to the cells (source
block, source block, term block) that need it, which is as many as there are source blocks. A cell joins its two
slices, adds up the partial differences of its pairs of sources, and the partial sums are then added along the terms.
The size of slices and cells is fixed by `GROUPS` and `TERMS`, however large the tables are; a term that no source of a
slice has still counts, with the share of a term that never occurs.

Texts are counted where they are read, by language and source in tables of bounded size, so a source with a third of
all rows is shuffled as its counts. Nulls in text, language and source are empty strings. Groups without kept terms
are in: they differ from others by 0 if the language keeps no term, and like any other if it does. Repeated rows
count each as a document. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.shared import saved, slices

#: Documents that a kept term stands in, at least; what is added to each count; one as an integer share.
LEAST, ADDED, ONE = 30, 5, 1_000_000_000
#: Sources and terms of a slice; ranks of the terms that tell a source from its language.
GROUPS, TERMS, TOP = 64, 4096, 50
#: Entries that a task counts before it hands them on.
HELD = 300_000

#: Letters of ASCII in lower case; all its other characters part terms, and bytes of longer characters belong to terms.
_TERM = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 0x20 for b in range(256))


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", held: int = HELD) -> DataFrame:
    """Rows (lang, source, term, count, docs), and one with a null term for each group, whose docs are all of the group's."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}
        texts: Counter[tuple[str, str]] = Counter()
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (count, n_docs) in groups.items():
                n = len(count) + 1
                terms = pa.array([*count, None], pa.binary()).cast(pa.string())
                columns = [pa.repeat(pa.scalar(lang), n), pa.repeat(pa.scalar(source), n), terms, pa.array([*count.values(), 0], pa.int64()), pa.array([*(n_docs[t] for t in count), texts[lang, source]], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "count", "docs"])
            groups.clear()
            texts.clear()

        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                for lang, source, text in zip(*(part.column(i).to_pylist() for i in range(2)), part.column(2).cast(pa.large_binary()).to_pylist(), strict=True):
                    count, n_docs = groups.setdefault((lang, source), (Counter(), Counter()))
                    before = len(count)
                    words = text.translate(_TERM).split()
                    count.update(words)
                    n_docs.update(set(words))
                    texts[lang, source] += 1
                    size += len(count) - before + 1
                    if size > held:
                        yield from out()
                        size = 0
        yield from out()

    counted = docs.mapInArrow(run, "lang string, source string, term string, count long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (n + 5 v)), in decimals, which hold counts of any size that a long has."""
    whole = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(ONE).cast("decimal(10,0)") * whole(count + ADDED), whole(n + ADDED * v)) + 1


class Audit:
    """Tables of one audit: kept terms (lang, term, block, t, p, N, V), groups (lang, source, g, N, V, zero) and shares (of
    the terms that occur in a group)."""

    def __init__(self, counts: DataFrame, least: int = LEAST, groups: int = GROUPS, terms: int = TERMS) -> None:
        counts = saved(counts, "terms")
        self.groups_of, self.terms_of = groups, terms
        found = counts.where(F.col("term").isNotNull())
        kept = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("count")).where(F.col("docs") >= least).drop("docs")
        kept = saved(kept, "kept")
        totals = kept.groupBy("lang").agg(F.count("*").alias("V"), F.sum("count").alias("N"), F.ceil(F.count("*") / terms).alias("blocks"))  # a row for each language
        # As a table its size is known, so the planner sends it to the terms while it is small and deals them out by block alone.
        totals = saved(totals, "totals")
        block = F.pmod(F.xxhash64("term"), F.col("blocks"))
        placed = kept.join(totals, "lang").withColumn("block", block)
        #: A block has about `terms` terms: its window is bounded.
        order = Window.partitionBy("lang", "block").orderBy("term")
        self.kept = saved(placed.select("lang", "term", "block", (F.row_number().over(order) - 1).alias("t"), share(F.col("count"), F.col("N"), F.col("V")).alias("q")), "placed")
        self.totals = totals.select("lang", "V", "blocks")
        here = found.join(self.kept, ["lang", "term"]).select("lang", "source", "term", "block", "t", "q", "count")
        here = saved(here, "counts")
        sums = here.groupBy("lang", "source").agg(F.sum("count").alias("N"))
        names = counts.where(F.col("term").isNull()).select("lang", "source").join(sums, ["lang", "source"], "left").join(self.totals, "lang", "left")
        names = names.fillna(0, ["N", "V", "blocks"])
        zero = F.when(F.col("V") > 0, share(F.lit(0), F.col("N"), F.col("V"))).otherwise(F.lit(0))
        #: A row for each source of a language, never for each document.
        at = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        self.groups = saved(names.select("lang", "source", at.alias("g"), "N", "V", "blocks", zero.cast("long").alias("zero")), "groups")
        self.shares = here.join(self.groups.select("lang", "source", "g", "N", "V"), ["lang", "source"]).select("lang", "source", "g", "term", "block", "t", "q", share(F.col("count"), F.col("N"), F.col("V")).alias("p"))

    def slices(self) -> DataFrame:
        """Rows (lang, groups, block, size, first, zeros, g, t, p): the shares of one block of sources over one block of
        terms. size: terms of the block; zeros: each source's share of a term that it doesn't have."""
        by = ["lang", "groups", "block"]
        part = F.floor(F.col("g") / self.groups_of)
        entries = self.shares.groupBy("lang", part.alias("groups"), "block").agg(F.collect_list(F.struct("g", "t", "p")).alias("e"))
        row = self.groups.groupBy("lang", part.alias("groups")).agg(F.sort_array(F.collect_list(F.struct("g", "zero"))).alias("z"))
        sizes = self.kept.groupBy("lang", "block").agg(F.count("*").alias("size"))
        return row.join(sizes, "lang").join(entries, by, "left").select(
            *by, "size", F.col("z")[0]["g"].alias("first"), F.col("z.zero").alias("zeros"), *[F.coalesce(F.col(f"e.{c}"), F.array().cast(f"array<{k}>")).alias(c) for c, k in (("g", "int"), ("t", "int"), ("p", "bigint"))]
        )

    def pairs(self) -> DataFrame:
        """Rows (lang, g, h, value), g < h, for all pairs of sources of a language that keeps a term."""
        found = saved(self.slices(), "slices")
        n = self.groups.groupBy("lang").agg((F.floor(F.max("g") / self.groups_of) + 1).alias("n"))  # a row for each language
        found = found.join(n, "lang")
        left = found.withColumn("other", F.explode(F.sequence("groups", F.col("n") - 1))).drop("n")
        right = found.withColumn("other", F.explode(F.sequence(F.lit(0), "groups"))).drop("n")
        cell = ["lang", "i", "j", "block"]
        left = left.withColumnsRenamed({"groups": "i", "other": "j"})
        right = right.select("lang", F.col("other").alias("i"), F.col("groups").alias("j"), "block", *[F.col(c).alias(f"{c}_2") for c in ("first", "zeros", "g", "t", "p")])
        partial = left.join(right, cell).mapInArrow(_cells, "lang string, g int, h int, value long")
        return partial.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))

    def divergences(self) -> DataFrame:
        """Rows (lang, source, item, value) for each source and each other source of its language, both ways round."""
        one = self.pairs()
        both = one.select("lang", F.explode(F.array(F.struct("g", "h"), F.struct(F.col("h").alias("g"), F.col("g").alias("h")))).alias("x"), "value").select("lang", "x.g", "x.h", "value")
        names = self.groups.select("lang", "source", "g")
        found = both.join(names, ["lang", "g"]).join(names.select("lang", F.col("source").alias("item"), F.col("g").alias("h")), ["lang", "h"])
        bare = self.groups.where("V = 0")  # languages without a kept term
        none = bare.select("lang", "source").join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
        return found.select("lang", "source", "item", "value").unionByName(none.withColumn("value", F.lit(0).cast("long")))

    def telling_terms(self, top: int = TOP) -> DataFrame:
        """Rows (lang, source, item, value, rank): the terms that a source has most beyond its language's share. First the
        best of each block of terms, then of all blocks."""
        order = [F.desc("value"), F.asc("item")]
        more = self.shares.where("p > q").select("lang", "source", "block", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        best = more.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "block").orderBy(*order))).where(F.col("rank") <= top)
        return best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= top).drop("block")

    def report(self, top: int = TOP) -> DataFrame:
        """Rows (lang, source, part, item, value, rank)."""
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))  # a row for each other source
        pairs = self.divergences().withColumn("rank", rank).withColumn("part", F.lit("pair"))
        return pairs.unionByName(self.telling_terms(top).withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")


def dense(size: int, first: int, zeros: list[int], g: np.ndarray, t: np.ndarray, p: np.ndarray) -> np.ndarray:
    """A slice as a matrix: sources by terms."""
    out = np.repeat(np.asarray(zeros, np.int64)[:, None], size, axis=1)
    out[g - first, t] = p
    return out


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partial sums of each cell. They are below 64 x 10^9 x terms of a block, so a long holds them; so it does their
    sums, as a source's shares add up to about 10^9 and one for each term."""
    for batch in batches:
        column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        for k in range(batch.num_rows):
            of = lambda c: column[c][k].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
            size, first, second = (column[c][k].as_py() for c in ("size", "first", "first_2"))
            a = dense(size, first, of("zeros"), of("g"), of("t"), of("p"))
            same = first == second
            b = a if same else dense(size, second, of("zeros_2"), of("g_2"), of("t_2"), of("p_2"))
            sums = np.stack([np.abs(b - x).sum(axis=1) for x in a])
            g, h = np.triu_indices(len(a), 1) if same else (x.ravel() for x in np.indices(sums.shape))
            lang = pa.repeat(column["lang"][k].cast(pa.string()), len(g))
            yield pa.RecordBatch.from_arrays([lang, pa.array(first + g, pa.int32()), pa.array(second + h, pa.int32()), pa.array(sums[g, h])], names=["lang", "g", "h", "value"])


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, groups: int = GROUPS, terms: int = TERMS) -> DataFrame:
    return Audit(term_counts(docs), least, groups, terms).report(top)


def sql() -> str:
    return r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
l AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 30),
lt AS (SELECT lang, sum(n) AS n, count(*) AS v FROM l GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN l USING (lang, term) GROUP BY ALL),
gt AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT gt.lang, gt.source, l.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (gt.n + 5 * lt.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (l.n + 5)) // (lt.n + 5 * lt.v)::HUGEINT AS q
  FROM gt JOIN l USING (lang) JOIN lt USING (lang) LEFT JOIN c ON c.lang = gt.lang AND c.source = gt.source AND c.term = l.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
r AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 50"""
