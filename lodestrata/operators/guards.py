"""Screens of question and answer tables: input, grounding, output, and the verdict. Reasons come in a fixed order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import seconds, without

# --- fixed values: limits, patterns, phrases and words that results depend on ---
MAX_QUERY, MIN_OUTPUT, MAX_OUTPUT = 4000, 20, 8000
MIN_RELEVANCE, MIN_CLAIMS, UNSUPPORTED_CLAIMS = 0.1, 0.55, 0.15
INJECTION = [
    r"(?i)\bignore\s+(?:all\s+)?(?:previous|prior|above)\s+instructions?\b",
    r"(?i)\b(?:override|bypass|disable)\s+(?:the\s+)?(?:rules|policy|guardrails?)\b",
    r"(?i)\b(?:act|behave)\s+as\s+(?:if\s+)?(?:there\s+are\s+)?no\s+rules\b",
]
EXTRACTION = [
    r"(?i)\b(?:reveal|show|print|repeat|expose)\b.{0,40}\bsystem\s+prompt\b",
    r"(?i)\b(?:developer|hidden)\s+(?:message|instructions?|prompt)\b",
    r"(?i)\b(?:chain[- ]of[- ]thought|private\s+reasoning)\b",
]
DANGEROUS_TOOL = [
    r"(?i)\b(?:run|execute|invoke|open)\b.{0,40}\b(?:shell|terminal|powershell|command\s+prompt|cmd\.exe)\b",
    r"(?i)\b(?:eval|exec)\s*\(",
    r"(?i)\b(?:delete|erase|wipe)\b.{0,40}\b(?:files?|database|disk|directory)\b",
]
MARKUP = r"(?i)<\s*/?\s*[a-z!][^>]*>|javascript\s*:|\bon[a-z]+\s*="
SECRETS = [
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bsk-[A-Za-z0-9_-]{20,}\b",
    r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    r"(?i)\b(?:api[_ -]?key|secret|password)\s*[:=]\s*['\"]?[A-Za-z0-9_./+=-]{12,}",
    r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{20,}\b",
]
CITATION_REF, PAGE_REF, CLAIM_TOKEN, NUMBER = r"(?i)\bcitation_[A-Za-z0-9_.:-]+\b", r"(?i)\bpage\s+(\d{1,6})\b", r"[a-z0-9]+(?:[._-][a-z0-9]+)*", r"(?<![\p{L}\p{N}_])-?\d+(?:\.\d+)?"
CLAIM_STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "document", "evidence", "for", "from", "in", "is", "it", "of", "on", "or", "retrieved", "states", "that", "the", "this", "timestamped", "to", "video", "was", "with"]
NO_EVIDENCE = ["no indexed document evidence", "no indexed timestamped video evidence", "no evidence was found", "could not find relevant evidence"]
# --- end of fixed values ---


def any_of(text: Column, patterns: list[str]) -> Column:
    """Java's \\b and \\s are made Unicode-aware, as the patterns are meant."""
    found = F.lit(False)
    for p in patterns:
        found = found | text.rlike("(?U)" + p)
    return F.coalesce(found, F.lit(False))


def reasons_of(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(code)) for test, code in pairs])) if pairs else F.array().cast("array<string>")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def screen_inputs(df: DataFrame, text_col: str) -> DataFrame:
    """GRD1: input_reasons, input_passed, injection_detected."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    out = df.withColumn("_injection", any_of(t, INJECTION)).withColumn("_extraction", any_of(t, EXTRACTION)).withColumn("_tool", any_of(t, DANGEROUS_TOOL))
    reasons = reasons_of((F.char_length(t) > MAX_QUERY, "INPUT_QUERY_TOO_LONG"), (F.col("_injection"), "INPUT_PROMPT_INJECTION"), (F.col("_extraction"), "INPUT_SYSTEM_PROMPT_EXTRACTION"), (F.col("_tool"), "INPUT_DANGEROUS_TOOL_INSTRUCTION"))
    out = out.withColumn("input_reasons", reasons).withColumn("input_passed", F.size("input_reasons") == 0).withColumn("injection_detected", F.col("_injection") | F.col("_extraction"))
    return out.drop("_injection", "_extraction", "_tool")


def screen_outputs(df: DataFrame, text_col: str) -> DataFrame:
    """GRD4: output_reasons, output_rewrite, output_block. A schema_valid column that is false adds its reason."""
    t = trimmed(F.col(text_col))
    short, long = F.char_length(t) < MIN_OUTPUT, F.char_length(t) > MAX_OUTPUT
    out = df.withColumn("_markup", any_of(t, [MARKUP])).withColumn("_secret", any_of(t, SECRETS))
    tests = [(short, "OUTPUT_TOO_SHORT"), (long, "OUTPUT_TOO_LONG"), (F.col("_markup"), "OUTPUT_SCRIPT_OR_HTML"), (F.col("_secret"), "OUTPUT_SECRET_PATTERN")]
    if "schema_valid" in df.columns:
        tests.append((~F.col("schema_valid"), "OUTPUT_GENUI_SCHEMA_INVALID"))
    out = out.withColumn("output_reasons", reasons_of(*tests)).withColumn("output_rewrite", short | long).withColumn("output_block", F.col("_markup") | F.col("_secret"))
    return out.drop("_markup", "_secret")


def claim_tokens(text: Column) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(CLAIM_TOKEN), F.lit(0)))
    return F.filter(without(words, CLAIM_STOP_WORDS), lambda t: F.length(t) > 1)


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)))


def match_citations(citations: DataFrame, contexts: DataFrame) -> DataFrame:
    """JOI6: citations with the context they match on every field, or null. Places of each kind are compared as one text."""
    c, x = "citation", "context"
    place = lambda: F.when(F.col("modality") == "document", F.col("page").cast("string")).otherwise(F.concat_ws("|", F.col("start_seconds").cast("string"), F.col("end_seconds").cast("string")))
    locator = F.when(F.col("modality") == "document", F.concat(F.col("filename"), F.lit(", page "), F.col("page").cast("string"))).otherwise(F.concat(F.col("filename"), F.lit(", "), seconds(F.col("start_seconds")), F.lit("s–"), seconds(F.col("end_seconds")), F.lit("s")))
    known = contexts.select("request_id", F.col("context_id").alias(x), F.col("modality").alias("kind"), F.col("owner_id"), "filename", place().alias("place"), F.concat(F.lit("citation_"), "ref_id").alias("citation_id"), "ref_id", locator.alias("locator"))
    known = known.groupBy(*[k for k in known.columns if k != x]).agg(F.min(x).alias(x))
    asked = citations.withColumn("modality", F.col("source_type")).withColumn("place", place()).withColumnRenamed("source_type", "kind")
    return asked.join(known, ["request_id", "citation_id", "kind", "owner_id", "filename", "place", "ref_id", "locator"], "left").withColumnRenamed(x, "matched_context").withColumnRenamed("kind", "source_type").drop("modality", "place").withColumn(c + "_matched", F.col("matched_context").isNotNull())


def evidence(answers: DataFrame, contexts: DataFrame, citations: DataFrame) -> DataFrame:
    """answers with what their contexts and citations come to. Contexts and citations per request are few by contract."""
    x = contexts.groupBy("request_id").agg(F.count("*").alias("n_contexts"), F.max("similarity_score").alias("relevance"), F.concat_ws(" ", F.collect_list("content")).alias("context_text"))
    matched = match_citations(citations, contexts)
    c = matched.groupBy("request_id").agg(
        F.count("*").alias("n_citations"), F.count_if(~F.col("citation_matched")).alias("n_unmatched"), F.count_distinct("matched_context").alias("n_matched"),
        F.collect_set(F.lower("citation_id")).alias("known_ids"), F.collect_set(F.when(F.col("source_type") == "document", F.col("page").cast("int"))).alias("pages"), F.concat_ws(" ", F.collect_list("locator")).alias("locators"),
    )
    out = answers.join(x, "request_id", "left").join(c, "request_id", "left")
    return out.fillna(0, ["n_contexts", "n_citations", "n_unmatched", "n_matched"]).fillna("", ["context_text", "locators"]).withColumn("draft_text", trimmed(F.col("draft")))


def coverage_of(facts: DataFrame) -> DataFrame:
    claims, known = claim_tokens(F.col("draft_text")), claim_tokens(F.concat_ws(" ", "context_text", "locators"))
    return facts.withColumn("_claims", claims).withColumn("claim_coverage", F.when(F.size("_claims") > 0, F.size(F.array_intersect("_claims", known)) / F.size("_claims")).otherwise(1.0)).drop("_claims")


def claim_coverage(answers: DataFrame, contexts: DataFrame, citations: DataFrame) -> DataFrame:
    """GRD2: request_id, claim_coverage."""
    return coverage_of(evidence(answers, contexts, citations)).select("request_id", "claim_coverage")


def screen_grounding(answers: DataFrame, contexts: DataFrame, citations: DataFrame, judgements: DataFrame | None = None) -> DataFrame:
    """GRD3: answers with groundedness, citation_coverage, claim_coverage, grounding_reasons, grounding_rewrite, grounding_block.

    judgements (request_id, supported boolean; null if the judge failed) decides claims of middling coverage.
    """
    f = coverage_of(evidence(answers, contexts, citations))
    f = f.join(judgements.select("request_id", "supported", F.lit(True).alias("judged")), "request_id", "left") if judgements is not None else f.withColumn("supported", F.lit(None).cast("boolean")).withColumn("judged", F.lit(None).cast("boolean"))
    any_context, any_citation = F.col("n_contexts") > 0, F.col("n_citations") > 0
    coverage = F.col("n_matched") / F.greatest("n_contexts", "n_citations", F.lit(1))
    f = f.withColumn("_coverage", coverage)
    empty = F.array().cast("array<string>")
    refs = F.array_distinct(F.transform(F.regexp_extract_all("draft_text", F.lit(CITATION_REF), F.lit(0)), F.lower))
    pages = F.array_distinct(F.transform(F.regexp_extract_all("draft_text", F.lit(PAGE_REF), F.lit(1)), lambda p: p.cast("int")))
    supported_numbers = numbers(F.concat_ws(" ", F.coalesce("user_query", F.lit("")), "context_text", "locators"))
    f = f.withColumn("_refs", F.size(F.array_except(refs, F.coalesce("known_ids", empty))) > 0).withColumn("_pages", F.size(F.array_except(pages, F.coalesce("pages", F.array().cast("array<int>")))) > 0)
    f = f.withColumn("_numbers", F.size(F.array_except(numbers(F.col("draft_text")), supported_numbers)) > 0)
    unsupported = any_context & (F.col("_numbers") | (F.col("claim_coverage") <= UNSUPPORTED_CLAIMS))
    middling = any_context & ~unsupported & (F.col("claim_coverage") < MIN_CLAIMS)
    irrelevant = any_context & (F.col("relevance") < MIN_RELEVANCE)
    review, failed = middling & F.col("judged").isNull(), middling & F.col("judged").isNotNull() & F.col("supported").isNull()
    rejected, accepted = middling & F.coalesce(~F.col("supported"), F.lit(False)), middling & F.coalesce("supported", F.lit(False))
    searched = ~any_context & F.col("route").isin("document_search", "video_search")
    silent = F.lit(False)
    for phrase in NO_EVIDENCE:
        silent = silent | F.contains(F.lower("draft_text"), F.lit(phrase))
    bare = searched & ~silent
    mismatch = ~any_context & (F.col("route") == "data_analytics") & F.coalesce((F.col("tool_status") == "completed") & (F.col("draft_text") != F.coalesce("tool_summary", F.lit(""))), F.lit(False))
    reasons = reasons_of(
        (F.col("n_unmatched") > 0, "GROUNDING_CITATION_NOT_IN_CONTEXT"), (any_context & (F.col("_coverage") < 1), "GROUNDING_CITATION_COVERAGE_INCOMPLETE"), (any_citation & ~any_context, "GROUNDING_CITATION_WITHOUT_CONTEXT"),
        (F.col("_refs"), "GROUNDING_UNKNOWN_CITATION_REFERENCE"), (F.col("_pages"), "GROUNDING_UNKNOWN_PAGE_REFERENCE"), (irrelevant, "GROUNDING_CONTEXT_IRRELEVANT"), (unsupported | bare, "GROUNDING_UNSUPPORTED_CLAIM"),
        (review, "GROUNDING_SEMANTIC_REVIEW_REQUIRED"), (failed, "GROUNDING_SEMANTIC_JUDGE_UNAVAILABLE"), (rejected, "GROUNDING_SEMANTIC_JUDGE_REJECTED"), (mismatch, "GROUNDING_ANALYTICS_RESULT_MISMATCH"),
    )
    claims = F.when(accepted, F.lit(MIN_CLAIMS)).otherwise(F.col("claim_coverage"))
    groundedness = F.when(any_context, F.round(F.least(F.lit(1.0), (F.col("_coverage") + claims + F.col("relevance")) / 3), 4)).when(bare | mismatch, 0.0).otherwise(1.0)
    shown = F.when(any_context | any_citation, F.col("_coverage")).otherwise(1.0)
    out = f.withColumn("grounding_reasons", reasons).withColumn("groundedness", groundedness).withColumn("citation_coverage", F.round(shown, 4)).withColumn("claim_coverage", claims)
    out = out.withColumn("grounding_block", (F.col("n_unmatched") > 0) | (any_context & (F.col("_coverage") < 1)) | (any_citation & ~any_context) | F.col("_refs") | F.col("_pages"))
    out = out.withColumn("grounding_rewrite", irrelevant | unsupported | review | failed | rejected | bare | mismatch)
    return out.select(*answers.columns, "groundedness", "citation_coverage", "claim_coverage", "grounding_reasons", "grounding_rewrite", "grounding_block")


def judge(df: DataFrame, fn: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """UDF2: judgements by a batch function of rows; only those of middling claim coverage are sent."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"request_id": part["request_id"], "supported": fn(part)})

    return df.where((F.col("claim_coverage") > UNSUPPORTED_CLAIMS) & (F.col("claim_coverage") < MIN_CLAIMS)).mapInPandas(run, "request_id string, supported boolean")


def verdicts(df: DataFrame) -> DataFrame:
    """GRD5: decision and reasons from the columns of the three screens."""
    block = ~F.col("input_passed") | F.col("grounding_block") | F.col("output_block")
    rewrite = F.col("grounding_rewrite") | F.col("output_rewrite")
    spent = F.col("rewrite_count") > 0
    decision = F.when(block | (rewrite & spent), "block").when(rewrite, "rewrite").otherwise("approve")
    own = F.array_distinct(F.concat("input_reasons", "grounding_reasons", "output_reasons"))
    default = F.when(block, "GUARDRAIL_BLOCKED").when(rewrite, "GUARDRAIL_REWRITE_REQUIRED").otherwise("GUARDRAILS_PASSED")
    limit = F.when(~block & rewrite & spent, F.array(F.lit("REWRITE_LIMIT_REACHED"))).otherwise(F.array().cast("array<string>"))
    found = F.array_distinct(F.concat(own, limit))
    return df.withColumn("decision", decision).withColumn("reasons", F.when(F.size(found) > 0, found).otherwise(F.array(default))).withColumn("keeps_citations", F.col("decision") != "block")


def screen_all(answers: DataFrame, contexts: DataFrame, citations: DataFrame, judgements: DataFrame | None = None) -> DataFrame:
    """W4: all screens and the verdict of each answer."""
    return verdicts(screen_outputs(screen_inputs(screen_grounding(answers, contexts, citations, judgements), "user_query"), "draft"))
