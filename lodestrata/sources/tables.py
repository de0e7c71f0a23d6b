"""Readers: strict CSV, evaluation cases, paged text, admitted files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.sources.staging import staged

MAX_COLUMNS, MAX_NAME, PDF_WINDOW, MEDIA_WINDOW = 50, 128, 1024, 32


class InvalidDataset(ValueError):
    """A file that does not keep the rules for datasets."""


CSV = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
#: Ranges of files whose places may be broadcast, about 200 bytes each.
BROADCAST_RANGES = 500_000


def read_csv_dataset(spark: SparkSession, path: str, max_columns: int = MAX_COLUMNS) -> DataFrame:
    """SRC1: all columns as text, blanks as null, blank rows dropped. Rows must be as wide as the header.

    Only the header is read first; rows are checked as jobs read them. Files are read in ranges of bytes, also where quoted cells have
    line ends in them (see `csv_records`). A completely empty line is skipped.
    """
    lines = spark.read.options(header=False, inferSchema=False, multiLine=True, **CSV).csv(path).limit(1).collect()
    if not lines:
        raise InvalidDataset("the file is empty")
    header = [(x or "").lstrip("\ufeff").strip() for x in lines[0]]
    if any(not h for h in header) or len(set(header)) != len(header) or any(len(h) > MAX_NAME for h in header):
        raise InvalidDataset("column names must be non-empty, unique and of at most 128 characters")
    if len(header) > max_columns:
        raise InvalidDataset(f"at most {max_columns} columns are allowed")
    schema = T.StructType([T.StructField(h, T.StringType()) for h in header])
    parsed = F.from_csv("record", schema.toDDL(), {k: str(v).lower() for k, v in CSV.items()} | {"nullValue": "", "mode": "FAILFAST"})
    rows = csv_records(spark, path).where("is_head or trim(record) != ''").select("is_head", parsed.alias("row"))
    cell = lambda h: F.col("row").getField(h)
    same = F.lit(True)
    for h in header:
        same &= F.coalesce(F.trim(F.regexp_replace(cell(h), "^\ufeff", "")) == h, F.lit(False))
    rows = rows.where(~F.col("is_head") | F.when(~same, F.raise_error(F.lit("files have different headers"))).otherwise(False))
    df = rows.select(*[F.when(cell(h).rlike(r"\S"), cell(h)).alias(h) for h in header]).dropna("all")
    if df.limit(1).count() == 0:
        raise InvalidDataset("the file has no data rows")
    null_byte = F.raise_error(F.lit("null byte in a cell"))
    return df.select(*[F.when(F.contains(F.col(f"`{h}`"), F.lit("\u0000")), null_byte).otherwise(F.col(f"`{h}`")).cast("string").alias(h) for h in header])


QUOTED, PLAIN = r'\s*+"(?:[^"]|"")*+"[^,]*+', r'(?!\s*+")[^,]*+'
#: Whether a line that begins outside of quotes, or inside, ends inside. A quote counts where a cell begins with it.
OPENS = re.compile(rf'(?:(?:{QUOTED}|{PLAIN}),)*+\s*+"(?:[^"]|"")*+')
STAYS = re.compile(rf'(?:[^"]|"")*+(?:"[^,]*+,{OPENS.pattern})?')


class Lines:
    """Where records with line ends begin and end, line by line, from a state: inside of quotes or not, and how many such records began."""

    def __init__(self, inside: bool = False, begun: int = 0):
        self.inside, self.begun = inside, begun

    def take(self, lines: list[str]) -> list[int | None]:
        """Of each line, its record's number if that goes over a line end."""
        out: list[int | None] = []
        for line in lines:
            if self.inside:
                out.append(self.begun - 1)
                self.inside = '"' not in line or STAYS.fullmatch(line) is not None
            elif '"' in line and OPENS.fullmatch(line):
                out.append(self.begun)
                self.inside, self.begun = True, self.begun + 1
            else:
                out.append(None)
        return out


def by_range(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
    """(file and start, first row, end row) of the rows of one range of a file, in a batch whose columns 1 and 2 are those."""
    places = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
    first = 0
    for i in range(1, len(places) + 1):
        if i == len(places) or places[i] != places[first]:
            yield places[first], first, i
            first = i


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """record (text of one record), is_head (whether it is its file's first) of CSV files, read by many tasks a file.

    A record goes on over a line end inside quotes. Whether a line begins inside depends on all before it; so each range of bytes first
    tells what it comes to from either state, a row a range, and these are put together in order. Then each range is read from the
    state that it begins in, and only lines of records with line ends are shuffled.
    """
    source = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Lines, Lines]] = {}
        for batch in batches:
            for place, a, b in by_range(batch):
                values = batch.column(0).slice(a, b - a).to_pylist()
                for state in held.setdefault(place, (Lines(False), Lines(True))):
                    state.take(values)
        rows = [(*place, o.inside, o.begun, i.inside, i.begun) for place, (o, i) in held.items()]
        names = ["file", "start", "out_end", "out_begun", "in_end", "in_begun"]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    def chained(rows: pd.DataFrame) -> pd.DataFrame:
        inside, begun, out = False, 0, []
        for r in rows.sort_values("start").itertuples():
            out.append((r.file, r.start, inside, begun))
            inside, more = (r.in_end, r.in_begun) if inside else (r.out_end, r.out_begun)
            begun += more
        return pd.DataFrame(out, columns=["file", "start", "inside", "begun"]).assign(open=bool(inside))

    ranges = staged(source.mapInArrow(summed, "file string, start long, out_end boolean, out_begun long, in_end boolean, in_begun long"), "csv-ranges")
    states = staged(ranges.groupBy("file").applyInPandas(chained, "file string, start long, inside boolean, begun long, open boolean"), "csv-states")
    if states.where("open").limit(1).count():
        raise InvalidDataset("a quote is not closed")
    if states.limit(BROADCAST_RANGES + 1).count() > BROADCAST_RANGES:
        raise InvalidDataset("more ranges than may be broadcast; raise spark.sql.files.maxPartitionBytes")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, line = None, Lines(), 0  # the range that the last batch ended in
        for batch in batches:
            number: list[int] = []
            several: list[int | None] = []
            for place, a, b in by_range(batch):
                if place != at:
                    at, state, line = place, Lines(batch.column(3)[a].as_py(), batch.column(4)[a].as_py()), 0
                several += state.take(batch.column(0).slice(a, b - a).to_pylist())
                number += range(line, line + b - a)
                line += b - a
            columns = [*batch.columns[:3], pa.array(number, pa.int64()), pa.array(several, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["value", "file", "start", "line", "several"])

    placed = source.join(F.broadcast(states.drop("open")), ["file", "start"]).select("value", "file", "start", "inside", "begun")
    lines = placed.mapInArrow(numbered, "value string, file string, start long, line long, several long").withColumn("value", F.regexp_replace("value", "\r$", ""))
    first = (F.col("start") == 0) & (F.col("line") == 0)
    single = lines.where("several is null").select(F.col("value").alias("record"), first.alias("is_head"))
    own = F.array_sort(F.collect_list(F.struct("start", "line", "value")))
    joined = lines.where("several is not null").groupBy("file", "several").agg(own.alias("own"), F.bool_or(first).alias("is_head"))
    return single.unionByName(joined.select(F.array_join(F.transform("own", lambda x: x["value"]), "\n").alias("record"), "is_head"))


RETRIEVAL_CASES = "schema_version string, dataset_id string, documents array<struct<filename: string, path: string>>, cases array<struct<case_id: string, query: string, relevant_document: string, relevant_page: int, relevant_chunk_index: int>>"
SYSTEM_CASES = (
    "schema_version string, dataset_id string, retrieval struct<path: string>, datasets array<struct<filename: string, path: string>>, "
    "routing_cases array<struct<case_id: string, query: string, expected_route: string, expected_tool: string>>, generation_cases array<struct<case_id: string, query: string, relevance_terms: array<string>>>, "
    "input_guard_cases array<struct<case_id: string, query: string, injection_expected: boolean>>, grounding_guard_cases array<struct<case_id: string, evidence: string, answer: string, unsupported_claim_expected: boolean>>"
)


def read_eval_cases(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """SRC3: the cases of one kind: `cases` of a retrieval file, or routing_cases, generation_cases, input_guard_cases,
    grounding_guard_cases of a system file, with their dataset_id."""
    schema = RETRIEVAL_CASES if kind == "cases" else SYSTEM_CASES
    return spark.read.json(path, schema=schema, multiLine=True).select("schema_version", "dataset_id", F.explode(kind).alias("case")).select("schema_version", "dataset_id", "case.*")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: document_id, filename, page_number, paragraphs."""
    return spark.read.parquet(path).select(F.col("document_id").cast("string").alias("document_id"), "filename", F.col("page_number").cast("int").alias("page_number"), "paragraphs")


def pages_from_text(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", lines_per_page: int | None = None) -> DataFrame:
    """SRC4 of plain texts: lines are paragraphs, `lines_per_page` of them a page, all on one page without it."""
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: F.trim(x) != "")
    base = df.select(F.col(id_col).cast("string").alias("document_id"), F.concat(F.lit("doc-"), F.col(id_col).cast("string"), F.lit(".txt")).alias("filename"), lines.alias("lines"))
    if lines_per_page is None:
        return base.select("document_id", "filename", F.lit(1).alias("page_number"), F.col("lines").alias("paragraphs"))
    starts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("lines") / lines_per_page).cast("int") - 1, F.lit(0))), lambda i: i * lines_per_page)
    paged = base.select("document_id", "filename", "lines", F.posexplode(starts).alias("at", "start"))
    return paged.select("document_id", "filename", (F.col("at") + 1).alias("page_number"), F.slice("lines", F.col("start") + 1, lines_per_page).alias("paragraphs"))
