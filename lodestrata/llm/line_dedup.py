r"""Line dedup by winnowing; DataFrame operations only.

Lines are the parts of a text between newlines, words the parts of a line between blanks. Offsets within a document are
counted in words. The *gram* of a line is the shortest run of whole lines from it on with at least `noise` words; its
hash stands for the run's content. The shortest run from a line on with at least `guarantee` words is a *window*: of the
grams inside it the one of least hash is chosen (the last of equals), so any repeated run of `guarantee` words has a
fingerprint that both its copies choose, and no match under `noise` words counts.

Positions of equal fingerprints are joined: with the one before it in the same document, or else with the first of all
(documents in order of doc_id, nulls first). That place may stand in a shorter match than a later one, so whole windows are joined
too: those that begin at a line, and the shortest runs of `guarantee` words that end at one, blank lines included, each with the first
place of all that holds the same run. Every line of a repeated run of `guarantee` words lies in such a window inside the run, so
the run goes from all places but the first. A joined pair lies on a diagonal of two documents; on it the match is extended
both ways, line by line, and runs of equal lines with at least `noise` words (of `guarantee` words, where only windows met) are
deleted from the later place. Lines without words stay. The first copy of any line survives, as each deletion points to an earlier place.

Defined results: a null text stays null, without lines; an empty text is one empty line and loses nothing; documents of
fewer than `guarantee` words lose nothing; equal rows are one document and come back as often as they went in; rows with
one doc_id and different texts are separate documents. A text may lose all its lines and is then empty. Other columns pass
through unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.llm._shared import sha256_of, staged, table, unused

NOISE, GUARANTEE = 25, 50
KEY = ["doc_id", "text_hash"]


def short_hash(text: Column) -> Column:
    """The first 60 bits of the MD5 as a number, which SQL engines agree on."""
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 15), 16, 10).cast("long")


def lines_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """A row per line: doc_id, text_hash, line (from 0), hash, words, start (words before it in the document)."""
    each = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")).where("text is not null").select(*KEY, F.posexplode(F.split("text", "\n")).alias("line", "content"))
    each = each.select(*KEY, "line", short_hash(F.col("content")).alias("hash"), F.size(F.array_remove(F.split("content", r"[ \t\r\f\x0B]+"), "")).cast("long").alias("words"))
    each = each.groupBy(*KEY, "line").agg(F.first("hash").alias("hash"), F.first("words").alias("words"))  # equal rows are one document
    so_far = W.partitionBy(*KEY).orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    return each.withColumn("start", F.coalesce(F.sum("words").over(so_far), F.lit(0)))


def fingerprints(lines: DataFrame, noise: int, guarantee: int) -> DataFrame:
    """A row per chosen gram: doc_id, text_hash, line, gram."""
    by_word = W.partitionBy(*KEY).orderBy("start")
    whole = W.partitionBy(*KEY)
    ahead = lambda n: by_word.rangeBetween(0, n)
    rows = lines.withColumn("total", F.sum("words").over(whole)).where(F.col("total") >= guarantee).where("words > 0")
    rows = rows.withColumn("left", F.col("total") - F.col("start")).withColumn("in_gram", F.collect_list("hash").over(ahead(noise - 1)))
    rows = rows.withColumn("gram", F.when(F.col("left") >= noise, short_hash(F.array_join(F.col("in_gram").cast("array<string>"), ",")))).drop("in_gram")
    least = F.min(F.when(F.col("gram").isNotNull(), F.struct("gram", (-F.col("line")).alias("back")))).over(ahead(guarantee - noise))
    chosen = rows.withColumn("least", F.when(F.col("left") >= guarantee, least)).where("least is not null")
    return chosen.select(*KEY, (-F.col("least.back")).alias("line"), F.col("least.gram").alias("gram")).distinct()


def windows(lines: DataFrame, guarantee: int) -> DataFrame:
    """A row per shortest run of whole lines with `guarantee` words that begins, or ends, at a line: doc_id, text_hash, line, gram.

    Lines without words before a line are one digest, of their contents in order: a run of them, however long, costs no more than a line.
    """
    rows = lines.withColumn("total", F.sum("words").over(W.partitionBy(*KEY))).where(F.col("total") >= guarantee)
    # lines without words have the `start` of the next line with words
    place = F.col("line") - F.min("line").over(W.partitionBy(*KEY, "start"))
    blank, worded = F.col("words") == 0, F.struct("line", "hash", "words", "total")
    rows = rows.withColumn("place", place).groupBy(*KEY, "start").agg(
        F.count(F.when(blank, 1)).alias("n_blank"),
        F.bit_xor(F.when(blank, F.xxhash64("place", "hash"))).alias("blanks"),
        F.max(F.when(~blank, worded)).alias("own"),
    )
    rows = rows.where("own is not null").select(*KEY, "start", "own.*", F.xxhash64("n_blank", "blanks", "own.hash").alias("link"))
    rows = rows.withColumn("end", F.col("start") + F.col("words")).withColumn("item", F.struct("hash", "link"))
    run = lambda key, a, b: F.collect_list("item").over(W.partitionBy(*KEY).orderBy(key).rangeBetween(a, b))
    rows = rows.withColumns({"ahead": run("start", 0, guarantee - 1), "behind": run("end", 1 - guarantee, 0)})
    links = lambda c: F.transform(F.slice(c, 2, F.size(c)), lambda x: x["link"])  # noqa: E731  what is before the first line does not count
    gram = lambda side, c: F.xxhash64(F.lit(side), F.get(c, F.lit(0))["hash"], links(c))
    rows = rows.withColumn("on", F.when(F.col("total") - F.col("start") >= guarantee, gram(0, "ahead")))
    rows = rows.withColumn("back", F.when(F.col("end") >= guarantee, gram(1, "behind")))
    return rows.select(*KEY, "line", F.explode(F.array("on", "back")).alias("gram")).where("gram is not null")


def with_first(places: DataFrame) -> DataFrame:
    """Pairs, as of diagonals, of each place with the first of all that has its gram."""
    place = F.struct("doc_id", "text_hash", "line")
    first = places.groupBy("gram").agg(F.min(place).alias("at"), F.max(place).alias("last")).where("at != last").select("gram", "at")
    return places.join(first, "gram").where(place != F.col("at")).select(*KEY, F.col("at.doc_id").alias("from_id"), F.col("at.text_hash").alias("from_hash"), (F.col("line") - F.col("at.line")).alias("shift"))


def diagonals(prints: DataFrame, runs: DataFrame, noise: int, guarantee: int) -> DataFrame:
    """Pairs of documents and the shift between their lines at which a fingerprint or a window matches: later place, earlier place, how many words count."""
    before = W.partitionBy(*KEY, "gram").orderBy("line")
    prints = prints.withColumn("previous", F.lag("line").over(before))
    inside = prints.where("previous is not null").select(*KEY, F.col("doc_id").alias("from_id"), F.col("text_hash").alias("from_hash"), (F.col("line") - F.col("previous")).alias("shift"))
    across = with_first(prints.where("previous is null").drop("previous"))
    each = inside.unionByName(across).withColumn("least", F.lit(noise)).unionByName(with_first(runs).withColumn("least", F.lit(guarantee)))
    return each.groupBy(*KEY, "from_id", "from_hash", "shift").agg(F.min("least").alias("least"))


def repeated_lines(docs: DataFrame, noise: int = NOISE, guarantee: int = GUARANTEE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per line to delete: doc_id, text_hash, line."""
    lines = staged(lines_of(docs, doc_id, text), "lines")
    pairs = diagonals(fingerprints(lines, noise, guarantee), windows(lines, guarantee), noise, guarantee)
    later = pairs.join(lines.withColumnRenamed("doc_id", "_id").withColumnRenamed("text_hash", "_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).drop("_id", "_hash")
    earlier = lines.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("line").alias("_line"), F.col("hash").alias("_same"))
    equal = later.join(earlier, F.col("from_id").eqNullSafe(F.col("_id")) & (F.col("from_hash") == F.col("_hash")) & (F.col("line") - F.col("shift") == F.col("_line")) & (F.col("hash") == F.col("_same")))
    on = [*KEY, "from_id", "from_hash", "shift"]
    run = equal.withColumn("run", F.col("line") - F.row_number().over(W.partitionBy(*on).orderBy("line")))
    kept = run.withColumn("run_words", F.sum("words").over(W.partitionBy(*on, "run"))).where((F.col("run_words") >= F.col("least")) & (F.col("words") > 0))
    return kept.select(*KEY, "line").distinct()


def dedup_lines(docs: DataFrame, noise: int = NOISE, guarantee: int = GUARANTEE, doc_id: str = "doc_id", text: str = "text", report: str | None = None) -> DataFrame:
    """The documents without the lines that repeat earlier runs. report: names a column of the deleted line numbers to add."""
    id_, hash_, gone_ = unused("gone_id", docs), unused("gone_hash", docs), unused("gone", docs)
    gone = repeated_lines(docs, noise, guarantee, doc_id, text).groupBy(*KEY).agg(F.array_sort(F.collect_list("line")).alias(gone_))
    gone = gone.withColumnRenamed("doc_id", id_).withColumnRenamed("text_hash", hash_)
    joined = docs.join(gone, docs[doc_id].eqNullSafe(gone[id_]) & (F.xxhash64(docs[text]) == gone[hash_]), "left")
    parts = F.split(docs[text], "\n")
    left = lambda p: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), gone_), lambda i: F.get(p, i)), "\n")
    clean = F.get(F.transform(F.array(parts), left), F.lit(0))  # the text is split once, not for each line
    columns = [F.when(F.col(gone_).isNull(), docs[c]).otherwise(clean).alias(c) if c == text else docs[c] for c in docs.columns]
    if report:
        columns.append(F.coalesce(gone_, F.array().cast("array<int>")).alias(report))
    return joined.select(*columns)


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: lines before and after, numbers of the deleted lines and the digest of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs, report="deleted")
    return out.select(
        "doc_id",
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_left_parts"),
        F.size("deleted").cast("long").alias("n_deleted"),
        F.array_join(F.col("deleted").cast("array<string>"), ",").alias("deleted_lines"),
        sha256_of(F.coalesce("text", F.lit(""))).alias("clean_sha256"),
    )


SQL = rf"""
WITH src AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents WHERE text IS NOT NULL),
l0 AS (SELECT doc_id, line, content, ('0x' || substr(md5(content), 1, 15))::BIGINT AS hash, len(list_filter(regexp_split_to_array(content, '[ \t\r\f\x0B]+'), lambda x: x <> ''))::BIGINT AS words FROM src),
l1 AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, sum(words) OVER (PARTITION BY doc_id)::BIGINT AS total FROM l0),
g0 AS (SELECT *, total - start AS remaining, list(hash) OVER (PARTITION BY doc_id ORDER BY start RANGE BETWEEN CURRENT ROW AND {NOISE - 1} FOLLOWING) AS in_gram FROM l1 WHERE total >= {GUARANTEE} AND words > 0),
g1 AS (SELECT *, CASE WHEN remaining >= {NOISE} THEN ('0x' || substr(md5(array_to_string(in_gram, ',')), 1, 15))::BIGINT END AS gram FROM g0),
g2 AS (SELECT *, min(CASE WHEN gram IS NOT NULL THEN {{'gram': gram, 'back': -line}} END) OVER (PARTITION BY doc_id ORDER BY start RANGE BETWEEN CURRENT ROW AND {GUARANTEE - NOISE} FOLLOWING) AS least FROM g1),
p AS (SELECT DISTINCT doc_id, -least.back AS line, least.gram AS gram FROM g2 WHERE remaining >= {GUARANTEE} AND least IS NOT NULL),
p1 AS (SELECT *, lag(line) OVER (PARTITION BY doc_id, gram ORDER BY line) AS previous FROM p),
f AS (SELECT gram, min({{'doc_id': doc_id, 'line': line}}) AS at FROM p1 WHERE previous IS NULL GROUP BY gram),
diag AS (SELECT doc_id, doc_id AS from_id, line - previous AS shift FROM p1 WHERE previous IS NOT NULL
  UNION SELECT p1.doc_id, f.at.doc_id, line - f.at.line FROM p1 JOIN f USING (gram) WHERE previous IS NULL AND (f.at.doc_id <> p1.doc_id OR f.at.line <> p1.line)),
eq AS (SELECT d.*, a.line, a.words FROM diag d JOIN l1 a ON a.doc_id = d.doc_id JOIN l1 b ON b.doc_id = d.from_id AND b.line = a.line - d.shift AND b.hash = a.hash),
r AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id, from_id, shift ORDER BY line) AS run FROM eq),
w0 AS (SELECT *, 2 * start - (words = 0)::INT AS begins, 2 * (start + words) + (words = 0)::INT AS ends FROM l1 WHERE total >= {GUARANTEE}),
w1 AS (SELECT *, list({{'line': line, 'hash': hash}}) OVER (PARTITION BY doc_id ORDER BY begins RANGE BETWEEN CURRENT ROW AND {2 * GUARANTEE - 2} FOLLOWING) AS f,
  list({{'line': line, 'hash': hash}}) OVER (PARTITION BY doc_id ORDER BY ends RANGE BETWEEN {2 * GUARANTEE - 2} PRECEDING AND CURRENT ROW) AS b FROM w0),
w2 AS (SELECT doc_id, list_sort(f) AS items FROM w1 WHERE words > 0 AND total - start >= {GUARANTEE} UNION ALL SELECT doc_id, list_sort(b) FROM w1 WHERE words > 0 AND start + words >= {GUARANTEE}),
w3 AS (SELECT doc_id, items, min({{'doc_id': doc_id, 'line': items[1].line}}) OVER (PARTITION BY list_transform(items, lambda x: x.hash)) AS first FROM w2),
w4 AS (SELECT doc_id, unnest(list_transform(items, lambda x: x.line)) AS line FROM w3 WHERE first <> {{'doc_id': doc_id, 'line': items[1].line}}),
gone AS (SELECT DISTINCT doc_id, line FROM (SELECT doc_id, line, words, sum(words) OVER (PARTITION BY doc_id, from_id, shift, run) AS run_words FROM r) WHERE run_words >= {NOISE} AND words > 0
  UNION SELECT doc_id, line FROM w4 JOIN l1 USING (doc_id, line) WHERE words > 0),
per AS (SELECT l.doc_id, count(*) FILTER (g.line IS NULL) AS n_left, count(g.line) AS n_deleted, string_agg(g.line::VARCHAR, ',' ORDER BY l.line) FILTER (g.line IS NOT NULL) AS deleted_lines,
  string_agg(content, chr(10) ORDER BY l.line) FILTER (g.line IS NULL) AS clean FROM l0 l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE greatest(coalesce(n_left, 0), 1) END::BIGINT AS n_left_parts, coalesce(n_deleted, 0)::BIGINT AS n_deleted,
  coalesce(deleted_lines, '') AS deleted_lines, sha256(coalesce(clean, '')) AS clean_sha256
FROM documents d LEFT JOIN per USING (doc_id)
"""
