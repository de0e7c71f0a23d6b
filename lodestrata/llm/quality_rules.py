"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of each whole text are computed from its bytes in Arrow batches. A small random forest is grown on labelled rows;
every path from a root to a node is a rule, a conjunction of bounds on statistics. A logistic regression under an L1 penalty
weighs the distinct rules, which leaves most at 0; the others are compiled into one Spark column expression, so scoring needs
no model object. All labelled rows are used, by Spark's own learners.

Defined results: null and empty texts have all statistics 0 and get a score like others. Labels that repeat for an id count
by their mean (1 from one half on); null labels and ids are left out. Labels of one value only give that value's share as every
score, none give 0.5. Rows are independent: repeated rows, null ids and clashing column names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm._shared import byte_chunks, staged, table, word_hashes, word_spans
from lodestrata.llm.language_id import held_out

#: What is measured of each text. Shares are of the thing named last.
STATISTICS = ["log_bytes", "log_words", "word_length", "upper_of_letters", "digits_of_bytes", "marks_of_bytes", "bare_of_words", "tailed_of_words", "distinct_of_words", "stuttered_of_words", "distinct_of_lines", "words_of_line", "wide_of_bytes"]


def distinct(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    fresh = np.ones(len(r), bool)
    fresh[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    return np.bincount(r[fresh], minlength=n)


def measure(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The STATISTICS of each row of a chunk."""
    n = len(offsets) - 1

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    digit, wide, blank = (data >= 48) & (data <= 57), data >= 128, data <= 32
    mark = ~(upper | lower | digit | wide | blank)
    starts, ends, row = word_spans(~blank, offsets)
    words = np.bincount(row, minlength=n)
    h = word_hashes(data, starts, ends)
    lettered = np.concatenate([[0], np.cumsum(upper | lower | wide, dtype=np.int64)])
    last = data[ends - 1] if len(ends) else data[:0]
    tailed = mark[ends - 1] & (last != 46) & (last != 44) if len(ends) else np.zeros(0, bool)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    l_starts, l_ends, l_row = word_spans(data != 10, offsets)
    lines = np.bincount(l_row, minlength=n)
    size = per_row(np.ones(len(data), bool))
    some = lambda x, of: x / np.maximum(of, 1)
    letters = per_row(upper | lower | wide)
    columns = [
        np.log1p(size), np.log1p(words), some(per_row(~blank), words), some(per_row(upper), letters), some(per_row(digit), size), some(per_row(mark), size),
        some(np.bincount(row, lettered[ends] == lettered[starts], n), words), some(np.bincount(row, tailed, n), words), some(distinct(row, h, n), words), some(np.bincount(row, again, n), words),
        some(distinct(l_row, word_hashes(data, l_starts, l_ends), n), lines), some(words, lines), some(per_row(wide), size),
    ]
    return np.stack(columns, 1)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the STATISTICS in place of the text."""
    kept = [f for f in docs.schema.fields if f.name != text and f.name not in STATISTICS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(data, offsets) for _, _, data, offsets in byte_chunks(batch.column(batch.schema.get_field_index(text)))]
            values = np.concatenate(found) if found else np.zeros((0, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)) for f in kept] + [pa.array(values[:, j]) for j in range(len(STATISTICS))], [f.name for f in kept] + STATISTICS)

    return docs.mapInArrow(run, T.StructType(kept + [T.StructField(s, T.DoubleType()) for s in STATISTICS]))


@dataclass(frozen=True)
class Bound:
    statistic: str
    over: bool
    value: float

    def column(self) -> Column:
        return F.col(self.statistic) > self.value if self.over else F.col(self.statistic) <= self.value


Rule = frozenset[Bound]


def rules_of(node, path: Rule = frozenset()) -> set[Rule]:
    """All root-to-node paths of a fitted tree, each bound the tightest on its side."""
    found = {path} if path else set()
    if node.subtreeDepth() == 0:
        return found
    name, value = STATISTICS[node.split().featureIndex()], float(node.split().threshold())
    for child, over in ((node.leftChild(), False), (node.rightChild(), True)):
        looser = {b for b in path if b.statistic == name and b.over == over}
        found |= rules_of(child, path - looser | {Bound(name, over, value)})
    return found


@dataclass
class RuleModel:
    weights: dict[Rule, float]
    intercept: float

    def score(self) -> Column:
        """The probability of label 1 as an expression over the STATISTICS."""
        parts = [F.when(holds(rule), w).otherwise(0.0) for rule, w in self.weights.items()]
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, parts, F.lit(self.intercept))))

    def described(self) -> list[str]:
        order = sorted(self.weights.items(), key=lambda x: -abs(x[1]))
        return [f"{w:+.3f} if " + " and ".join(f"{b.statistic} {'>' if b.over else '<='} {b.value:.4g}" for b in sorted(r, key=lambda b: (b.statistic, b.over))) for r, w in order]


def holds(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [b.column() for b in sorted(rule, key=lambda b: (b.statistic, b.over))])


def fit(labelled: DataFrame, label: str = "label", trees: int = 10, depth: int = 3, penalty: float = 2e-3, seed: int = 11) -> RuleModel:
    """labelled: STATISTICS and a 0/1 label."""
    shares = labelled.agg(F.avg(label), F.min(label), F.max(label)).head()
    if shares[0] is None or shares[1] == shares[2]:
        share = 0.5 if shares[0] is None else float(min(max(shares[0], 0.01), 0.99))
        return RuleModel({}, float(np.log(share / (1 - share))))
    rows = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(labelled.select(*STATISTICS, F.col(label).cast("double").alias("label")))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="onethird", subsamplingRate=0.7, seed=seed).fit(rows)
    rules = sorted({r for tree in forest.trees for r in rules_of(tree._call_java("rootNode"))}, key=lambda r: sorted(map(repr, r)))
    met = labelled.select(F.col(label).cast("double").alias("label"), *[holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    met = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(met).select("label", "features")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=40).fit(met)
    return RuleModel({r: float(w) for r, w in zip(rules, lasso.coefficients, strict=True) if w}, float(lasso.intercept))


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", cut: float = 0.3) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    stats = staged(statistics(source), "statistics")
    by_id = labels.where(F.col(quality).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg((F.avg(quality) >= 0.5).cast("int").alias("label"))
    labelled = staged(stats.where(~held_out("doc_id")).join(by_id, "doc_id").select("label", *STATISTICS), "labelled")
    score = fit(labelled).score()
    return stats.select("doc_id", held_out("doc_id").alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= cut).cast("int"))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
