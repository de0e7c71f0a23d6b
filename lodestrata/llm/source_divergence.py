r"""Divergence of sources within a language by their terms, over a cube of (group block, group block, term block) cells.

Terms are runs of letters and of any characters beyond ASCII; only A-Z are lower-cased. A language keeps the terms that stand in
at least `least_docs` of its documents, V of them. A group is a language's source. For a group, and for its language as a whole, a kept
term has p = 1 + floor(10**9 * (count + 2) / (N + 2 * V)), N being the sum of its counts of kept terms. Two values of one term diverge by
floor((p - q)**2 / (p + q)). Whole numbers throughout: the quotients are taken digit by digit in base 1000.

1. Tasks count terms in bounded memories; Spark sums the counts by (language, source, term) and then, with a row per source at most, by
   (language, term).
2. Groups are numbered in blocks of GROUPS, kept terms dealt by hash into blocks of about TERMS. A slice is a group's values in one term
   block. Every slice is sent to each cell that pairs its group block with another or with itself; a cell sums the divergences of its
   pairs of groups over the terms that stand in any of its slices.
3. The cells' sums are added up along the term axis. A term in none of a cell's slices gives each pair one and the same amount, which is
   added at the end as often as there are such terms.

Defined results: null text, language and source are ''. A group without terms takes part, with counts of 0; where a language keeps no
term all its pairs have the value 0. A language's only source has no pairs. Equal rows are documents each. No documents give no rows.
Other columns are not read. Sums of counts are exact up to 9 * 10**15.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.llm._shared import LOWER, UPPER, small_batches, staged, table

GROUPS, TERMS = 16, 4096
LEAST_DOCS, TOP = 10, 10
#: Distinct terms that a task holds before it hands on its counts.
HELD = 200_000
KEY = ["lang", "source"]

#: To lower case, and all ASCII that is no letter to blanks. Bytes of characters beyond ASCII are from 128 on and stay.
FOLD = bytes(b if b > 127 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term (binary), n, docs: counts of each task, for docs of lang, source, text (binary)."""
    names = [*KEY, "term", "n", "docs"]

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (total, in_docs) in held.items():
            terms = list(total)
            for at in range(0, len(terms), 50_000):
                some = terms[at : at + 50_000]
                fixed = [pa.array([x] * len(some), pa.string()) for x in (lang, source)]
                own = [pa.array(list(map(c.__getitem__, some)), pa.int64()) for c in (total, in_docs)]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(some, pa.binary()), *own], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if words := text.translate(FOLD).split():
                    total, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                    total.update(words)
                    in_docs.update(set(words))
            if sum(len(total) for total, _ in held.values()) > HELD:
                yield from rows(held)
                held = {}
        yield from rows(held)

    return docs.mapInArrow(run, "lang string, source string, term binary, n long, docs long")


def share(part: str, whole: str) -> Column:
    """1 + floor(10**9 * part / whole) for whole numbers part <= whole up to 9 * 10**15."""
    rest, digits = f"({part})", []
    for _ in range(3):
        digits.append(f"(({rest} * 1000) div ({whole}))")
        rest = f"(({rest} * 1000) % ({whole}))"
    return F.expr(f"1 + ({digits[0]} * 1000 + {digits[1]}) * 1000 + {digits[2]}")


def apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def kept_terms(docs: DataFrame, least_docs: int) -> DataFrame:
    """lang, source, term, n, lang_n (its count in the language), first (1 in one row of each language's term)."""
    sums = counted(docs).groupBy(*KEY, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = W.partitionBy("lang", "term")
    every = sums.withColumns({"in_docs": F.sum("docs").over(same), "lang_n": F.sum("n").over(same), "row": F.row_number().over(same.orderBy("source"))})
    return every.where(F.col("in_docs") >= least_docs).select(*KEY, F.col("term").cast("string").alias("term"), "n", "lang_n", (F.col("row") == 1).cast("long").alias("first"))


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, g (number in the language), total, terms, lang_total, p0 (value of a term that the group has not), blocks of groups and terms."""
    own = kept.groupBy(*KEY).agg(F.sum("n").alias("total"))
    whole = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("first").alias("terms"))
    each = docs.select(*KEY).distinct().join(own, KEY, "left").join(whole, "lang", "left").fillna(0, ["total", "lang_total", "terms"])
    each = each.withColumn("g", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1)
    each = each.withColumn("group_blocks", F.ceil(F.count("*").over(W.partitionBy("lang")) / GROUPS).cast("int"))
    each = each.withColumn("term_blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") / TERMS)).cast("int"))
    return each.withColumn("p0", F.when(F.col("terms") > 0, share("2", "greatest(total + 2 * terms, 2)")))


def cell_sums(size: int) -> Callable[[pa.Table], pa.Table]:
    """The divergences of a cell's pairs of groups over the terms in its slices; `met` is how many terms that are. size: groups in a block."""

    def run(cell: pa.Table) -> pa.Table:
        a, b = cell["a"][0].as_py(), cell["b"][0].as_py()
        terms = cell["term"].combine_chunks()
        coded = terms.flatten().dictionary_encode()
        met, names = len(coded.dictionary), cell["g"].to_numpy()
        absent = cell["p0"].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        dense = np.repeat(absent[:, None], met, axis=1)
        row = np.repeat(np.arange(len(names)), np.diff(terms.offsets.to_numpy()))
        dense[row, coded.indices.to_numpy(zero_copy_only=False)] = cell["p"].combine_chunks().flatten().to_numpy()
        blocks = names // size
        out = [(np.zeros(0, np.int64),) * 3]
        for i in np.flatnonzero(blocks == a):
            others = np.flatnonzero((blocks == b) & (names > names[i]))
            gap, both = dense[others] - dense[i], dense[others] + dense[i]
            out.append((np.full(len(others), names[i]), names[others], (gap * gap // np.maximum(both, 1)).sum(1)))
        i, j, sums = map(np.concatenate, zip(*out, strict=True))
        lang = pa.array([cell["lang"][0].as_py()] * len(i), pa.string())
        numbers = [pa.array(x, t) for x, t in ((i, pa.int32()), (j, pa.int32()), (sums, pa.int64()), (np.full(len(i), met), pa.int64()))]
        return pa.Table.from_arrays([lang, *numbers], names=["lang", "i", "j", "value", "met"])

    return run


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value of all ordered pairs of a language's sources."""
    slim = groups.select(*KEY, "g", "total", "terms", "term_blocks")
    valued = kept.join(slim, KEY).select("lang", "g", F.pmod(F.xxhash64("term"), F.col("term_blocks")).cast("int").alias("t"), "term", share("n + 2", "total + 2 * terms").alias("p"))
    entries = valued.groupBy("lang", "g", "t").agg(F.collect_list(F.struct("term", "p")).alias("own"))
    grid = groups.select("lang", "g", "p0", "group_blocks", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)).alias("t"))
    none = F.array().cast("array<struct<term:string,p:bigint>>")
    slices = grid.join(entries, ["lang", "g", "t"], "left").withColumn("own", F.coalesce("own", none))
    own, other = F.floor(F.col("g") / GROUPS).cast("int"), F.col("other")
    sent = slices.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("group_blocks") - 1)))
    sent = sent.select("lang", "t", F.least(own, other).alias("a"), F.greatest(own, other).alias("b"), "g", "p0", F.col("own.term").alias("term"), F.col("own.p").alias("p"))
    parts = sent.groupBy("lang", "t", "a", "b").applyInArrow(cell_sums(GROUPS), "lang string, i int, j int, value long, met long")
    sums = parts.groupBy("lang", "i", "j").agg(F.sum("value").alias("sum"), F.sum("met").alias("met"))
    end = lambda n: groups.select("lang", F.col("g").alias(n), F.col("source").alias(f"{n}_source"), F.col("p0").alias(f"{n}_p0"))
    both = sums.join(end("i").join(groups.where("g = 0").select("lang", "terms"), "lang"), ["lang", "i"]).join(end("j"), ["lang", "j"])
    value = F.col("sum") + F.coalesce((F.col("terms") - F.col("met")) * apart("i_p0", "j_p0"), F.lit(0))
    ways = F.array(F.struct(F.col("i_source").alias("source"), F.col("j_source").alias("item")), F.struct(F.col("j_source").alias("source"), F.col("i_source").alias("item")))
    return both.select("lang", F.explode(ways).alias("way"), value.alias("value")).select("lang", "way.source", "way.item", "value")


def over_used_terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value of the terms that a group uses more than its language does."""
    each = kept.join(groups.select(*KEY, "total", "terms", "lang_total"), KEY)
    each = each.withColumns({"p": share("n + 2", "total + 2 * terms"), "q": share("lang_n + 2", "lang_total + 2 * terms")})
    return each.where("p > q").select(*KEY, F.col("term").alias("item"), apart("p", "q").alias("value"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: the other sources of the language (part `pair`, all), and the `top` terms (part `term`)."""
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    with small_batches(docs.sparkSession):
        kept = staged(kept_terms(read.select(*KEY, F.col("text").cast("binary").alias("text")), least_docs), "kept-terms")
    groups = staged(groups_of(read, kept), "groups")
    order = W.partitionBy(*KEY).orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.withColumn("rank", F.row_number().over(order)).select(*KEY, F.lit(part).alias("part"), "item", "value", "rank")
    return ranked(pair_values(kept, groups), "pair").unionByName(ranked(over_used_terms(kept, groups), "term").where(F.col("rank") <= top))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS lang_n FROM c GROUP BY ALL HAVING sum(docs) >= {LEAST_DOCS}),
l AS (SELECT lang, count(*) AS terms, sum(lang_n) AS lang_total FROM k GROUP BY lang),
o AS (SELECT c.lang, c.source, c.term, c.n, k.lang_n FROM c JOIN k USING (lang, term)),
g AS (SELECT e.lang, e.source, coalesce(s.total, 0) AS total, coalesce(l.terms, 0) AS terms, l.lang_total FROM (SELECT DISTINCT lang, source FROM d) e
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM o GROUP BY ALL) s USING (lang, source) LEFT JOIN l USING (lang)),
p AS (SELECT g.lang, g.source, k.term, 1 + 1000000000::HUGEINT * (coalesce(o.n, 0) + 2) // (g.total + 2 * g.terms) AS p, coalesce(o.n, 0) AS n,
  1 + 1000000000::HUGEINT * (k.lang_n + 2) // (g.lang_total + 2 * g.terms) AS q FROM g JOIN k USING (lang) LEFT JOIN o USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM
  (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM r) WHERE part = 'pair' OR rank <= {TOP}
"""
