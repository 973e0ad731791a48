"""Generated answers: validation of the nested payload, grounding of quotes, and resolution of citations.

Payloads are variants, so that a number where a string is due is seen as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.python_text import typographic_normal
from lodestone.functions.text import contains_elision, match_normal, strict_normal

# Reasons for which an answer may abstain.
ABSTENTION_REASONS = ("ambiguous_question", "conflicting_sources", "insufficient_evidence", "outside_corpus", "verification_failed")


def kind(v: Column) -> Column:
    """object, array, string, boolean, number or null of a variant; null for a missing member."""
    t = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(F.is_variant_null(v), "null")
        .when(t.startswith("OBJECT"), "object")
        .when(t.startswith("ARRAY"), "array")
        .when(t == "STRING", "string")
        .when(t == "BOOLEAN", "boolean")
        .otherwise("number")
    )


def member(v: Column, path: str, cast: str = "variant") -> Column:
    return F.try_variant_get(v, path, cast)


def _text(v: Column, name: str) -> Column:
    """The member as a string if it is one."""
    return F.when(kind(member(v, f"$.{name}")) == "string", member(v, f"$.{name}", "string"))


def _filled(text: Column) -> Column:
    return F.coalesce(F.trim(text) != "", F.lit(False))


def _errors(*checks: tuple[Column, Column]) -> Column:
    return F.filter(F.array(*(F.when(bad, message) for bad, message in checks)), lambda e: e.isNotNull())


def _flag(answers: DataFrame) -> tuple[Column, Column, Column]:
    p = F.col("payload")
    is_object = F.coalesce(kind(p) == "object", F.lit(False))
    abstain = F.coalesce(F.when(kind(member(p, "$.abstain")) == "boolean", member(p, "$.abstain", "boolean")), F.lit(False))
    return is_object, abstain, F.coalesce(kind(member(p, "$.claims")) == "array", F.lit(False))


def claims_of(answers: DataFrame) -> DataFrame:
    """(qa_id, ci, claim): the claims of list payloads with their positions from 0."""
    is_object, _, listed = _flag(answers)
    whole = answers.where(is_object & listed).select("qa_id", member(F.col("payload"), "$.claims", "array<variant>").alias("claims"))
    return whole.select("qa_id", F.posexplode("claims").alias("ci", "claim"))


def supports_of(claims: DataFrame) -> DataFrame:
    """(qa_id, ci, claim, si, support) of object claims whose supports are a list."""
    good = claims.where((F.coalesce(kind(F.col("claim")) == "object", F.lit(False))) & (F.coalesce(kind(member(F.col("claim"), "$.supports")) == "array", F.lit(False))))
    return good.select("qa_id", "ci", "claim", F.posexplode(member(F.col("claim"), "$.supports", "array<variant>")).alias("si", "support"))


def validation_errors(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(qa_id, schema_errors): the errors of every payload in its order; answers: qa_id, payload variant; evidence: qa_id, source_id."""
    p = F.col("payload")
    is_object, abstain, listed = _flag(answers)
    reason, reason_kind = _text(p, "abstention_reason"), kind(member(p, "$.abstention_reason"))
    allowed = F.coalesce(reason.isin(*ABSTENTION_REASONS), F.lit(False))
    empty = F.coalesce(reason_kind.isin("null") | (reason == ""), reason_kind.isNull())
    clarification = kind(member(p, "$.clarification_question"))
    top = F.when(~is_object, F.array(F.lit("payload must be an object"))).otherwise(
        _errors(
            (_text(p, "answer_text").isNull(), F.lit("answer_text must be a string")),
            (F.coalesce(kind(member(p, "$.abstain")) != "boolean", F.lit(True)), F.lit("abstain must be a boolean")),
            (abstain & ~allowed, F.lit("abstention_reason is required and must be allowed")),
            (~abstain & ~empty, F.lit("abstention_reason must be empty when abstain is false")),
            (F.coalesce(~clarification.isin("string", "null"), F.lit(False)), F.lit("clarification_question must be a string or null")),
            (~listed, F.lit("claims must be a list")),
            (listed & ~abstain & (F.size(F.coalesce(member(p, "$.claims", "array<variant>"), F.array())) == 0), F.lit("non-abstaining answers require at least one claim")),
        )
    )
    claims = claims_of(answers)
    c, prefix = F.col("claim"), F.concat(F.lit("claims["), "ci", F.lit("]"))
    id_ = F.when(_filled(_text(c, "claim_id")), _text(c, "claim_id"))
    repeated = F.row_number().over(Window.partitionBy("qa_id", "id_").orderBy("ci")) > 1
    supports = member(c, "$.supports", "array<variant>")
    bad_list = F.coalesce(kind(member(c, "$.supports")) != "array", F.lit(True)) | (F.size(F.coalesce(supports, F.array())) == 0)
    no_object = F.coalesce(kind(c) != "object", F.lit(True))
    of_claims = claims.withColumn("id_", id_).withColumn("again", F.col("id_").isNotNull() & repeated)
    of_claims = of_claims.select(
        "qa_id",
        "ci",
        F.lit(-1).alias("si"),
        F.when(no_object, F.array(F.concat(prefix, F.lit(" must be an object")))).otherwise(
            _errors(
                (F.col("id_").isNull(), F.concat(prefix, F.lit(".claim_id must be a non-empty string"))),
                (F.col("again"), F.concat(prefix, F.lit(".claim_id must be unique"))),
                (~_filled(_text(c, "text")), F.concat(prefix, F.lit(".text must be a non-empty string"))),
                (bad_list, F.concat(prefix, F.lit(".supports must be a non-empty list"))),
            )
        ).alias("e"),
    )
    each = supports_of(claims)
    s, at = F.col("support"), F.concat(prefix, F.lit(".supports["), "si", F.lit("]"))
    known = evidence.select("qa_id", F.col("source_id").alias("known")).distinct()
    each = each.withColumn("source_id", _text(s, "source_id")).join(known, (each.qa_id == known.qa_id) & (F.col("source_id") == F.col("known")), "left").select(each["*"], "source_id", "known")
    of_supports = each.select(
        "qa_id",
        "ci",
        "si",
        F.when(F.coalesce(kind(s) != "object", F.lit(True)), F.array(F.concat(at, F.lit(" must be an object")))).otherwise(
            _errors((F.col("known").isNull(), F.concat(at, F.lit(".source_id is not allowed"))), (~_filled(_text(s, "quote")), F.concat(at, F.lit(".quote must be a non-empty string"))))
        ).alias("e"),
    )
    every = answers.select("qa_id", F.lit(-1).alias("ci"), F.lit(-1).alias("si"), top.alias("e")).union(of_claims).union(of_supports)
    listed_ = every.groupBy("qa_id").agg(F.array_sort(F.collect_list(F.struct("ci", "si", "e"))).alias("l"))
    return listed_.select("qa_id", F.flatten(F.transform("l", lambda x: x["e"])).alias("schema_errors"))


def grounded_supports(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(qa_id, ci, si, claim_id, source_id, usable, grounded, verbatim, elided) of every support."""
    each = supports_of(claims_of(answers))
    c, s = F.col("claim"), F.col("support")
    own = each.select("qa_id", "ci", "si", F.coalesce(_text(c, "claim_id"), F.lit("?")).alias("claim_id"), _text(s, "source_id").alias("source_id"), _text(s, "quote").alias("quote"))
    texts = evidence.select("qa_id", "source_id", F.col("text").alias("evidence"))
    joined = own.join(texts, ["qa_id", "source_id"], "left")
    usable = F.col("evidence").isNotNull() & _filled(F.col("quote"))
    return joined.withColumns({"tq": typographic_normal(F.col("quote")), "te": typographic_normal(F.col("evidence"))}).select(
        "qa_id",
        "ci",
        "si",
        "claim_id",
        "source_id",
        usable.alias("usable"),
        F.contains(match_normal(F.col("te")), match_normal(F.col("tq"))).alias("grounded"),
        F.contains(strict_normal(F.col("evidence")), strict_normal(F.col("quote"))).alias("verbatim"),
        contains_elision(F.col("quote")).alias("elided"),
    )


def verify(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """A report on every answer: decision, structural_pass, quote_pass, quote_pass_strict, the lists of errors, elided quotes, supported claims, and whether meaning is left to check."""
    _, abstain, _ = _flag(answers)
    each = grounded_supports(answers, evidence)

    def told(condition, text):
        rows = F.array_sort(F.collect_list(F.when(F.col("usable") & condition, F.struct("ci", "si", F.concat("claim_id", F.lit(text), "source_id").alias("m")))))
        return F.transform(rows, lambda x: x["m"])

    lists = each.groupBy("qa_id").agg(
        told(~F.col("grounded"), ": quote not found in ").alias("quote_errors"),
        told(~F.col("verbatim"), ": quote not byte-verbatim in ").alias("strict_quote_errors"),
        told(F.col("elided"), ": elided quote from ").alias("elided_quotes"),
    )
    by_claim = each.groupBy("qa_id", "ci").agg(F.bool_and(F.col("usable") & F.coalesce("grounded", F.lit(False))).alias("good"))
    claims = claims_of(answers).select("qa_id", "ci", _text(F.col("claim"), "claim_id").alias("claim_id")).join(by_claim, ["qa_id", "ci"], "left")
    good = F.when(_filled(F.col("claim_id")) & F.coalesce("good", F.lit(True)), F.struct("ci", "claim_id"))
    supported = claims.groupBy("qa_id").agg(F.transform(F.array_sort(F.collect_list(good)), lambda x: x["claim_id"]).alias("supported_claim_ids"))
    none = F.array().cast("array<string>")
    names = ["quote_errors", "strict_quote_errors", "elided_quotes", "supported_claim_ids"]
    joined = answers.select("qa_id", abstain.alias("abstain")).join(validation_errors(answers, evidence), "qa_id").join(lists, "qa_id", "left").join(supported, "qa_id", "left")
    joined = joined.withColumns({n: F.coalesce(n, none) for n in names}).withColumns({"structural_pass": F.size("schema_errors") == 0, "quote_pass": F.size("quote_errors") == 0})
    decision = F.when(F.col("structural_pass") & F.col("quote_pass"), F.when(F.col("abstain"), "abstain").otherwise("accept_structurally")).otherwise("retry_or_abstain")
    return joined.select(
        "qa_id", decision.alias("decision"), "structural_pass", "quote_pass", (F.size("strict_quote_errors") == 0).alias("quote_pass_strict"), "schema_errors", *names, (~F.col("abstain")).alias("semantic_verification_required")
    )


def resolve_citations(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(qa_id, position, source_id, canonical_citation, document_id, parent_id): known sources in the order of first mention."""
    each = supports_of(claims_of(answers)).select("qa_id", F.struct("ci", "si").alias("at"), _text(F.col("support"), "source_id").alias("source_id"))
    first = each.groupBy("qa_id", "source_id").agg(F.min("at").alias("at"))
    known = first.join(evidence.select("qa_id", "source_id", "canonical_citation", "document_id", "parent_id"), ["qa_id", "source_id"])
    position = F.row_number().over(Window.partitionBy("qa_id").orderBy("at"))
    return known.select("qa_id", position.alias("position"), "source_id", "canonical_citation", "document_id", "parent_id")


def generation_summary(reports: DataFrame) -> DataFrame:
    """One row of counts over reports."""
    size = F.size
    return reports.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("structural_pass").alias("structural"),
        F.count_if("quote_pass").alias("quote"),
        F.count_if("quote_pass_strict").alias("strict"),
        F.count_if(size("elided_quotes") > 0).alias("elided"),
        F.count_if(F.col("structural_pass") & F.col("quote_pass")).alias("both"),
        F.coalesce(F.sum(size("elided_quotes")), F.lit(0)).alias("elided_spans"),
        F.count_if(F.col("decision") == "abstain").alias("abstained"),
    )
