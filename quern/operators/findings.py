"""Findings: built from comparisons only while their sources stand, located in articles, reviewed as events, and the run over a whole plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import ids
from quern.functions import rules as RU
from quern.functions import text as T
from quern.operators import review as V

#: Versions that identities hold.
FINDING_VERSION = "v0.1-c.3-f1-source-grounded"
EVENT_VERSION = "v0.1-c.4-f1-stateless-review-event"
#: Fixed value: reviewers are who they say they are.
ASSURANCE = "CALLER_ASSERTED_UNVERIFIED"


def grounded(text: Column, start: Column, end: Column, digest: Column) -> Column:
    """Whether a citation's offsets fit its text's length and its digest is the text's."""
    return F.coalesce((end == start + F.length(text)) & (digest == ids.text_hash(text)), F.lit(False))


def finding_id(c: dict[str, Column]) -> Column:
    """Identity by comparison_id, decision, reason_code, decision_scope and document_sha256."""
    return ids.canonical_id("finding_", {"finding_version": F.lit(FINDING_VERSION)} | {k: c[k] for k in ("comparison_id", "decision", "reason_code", "decision_scope", "document_sha256")})


def summary(c: dict[str, Column]) -> Column:
    """What the plan says, what the standard says, and the outcome; missing_information is an array."""
    base = F.format_string('Plan evidence states: "%s". Standard requirement states: "%s". Local %s decision: %s. Reason: %s.', c["source_text"], c["requirement_text"], c["decision_scope"], c["decision"], c["reason_code"])
    more = F.array_join(c["missing_information"], "; ")
    return F.when(more == "", base).otherwise(F.concat(base, F.lit(" Missing or unresolved information: "), more))


def build(rows: DataFrame) -> DataFrame:
    """rows with finding_state, and finding_id and summary where it is FOUND.

    ``rows``: sha_before and sha_after (the plan's digest before and after the
    comparison), comparison_id, decision, reason_code, decision_scope (null
    without a comparison), evidence_id, requirement_text, page_start, page_end,
    source_text, char_start, char_end, source_sha256 and missing_information.
    The first failing condition names the state: SOURCE_CHANGED,
    AUTHORITY_UNAVAILABLE (no comparison), AUTHORITY_MISMATCH (no evidence,
    requirement or pages, or a citation that does not fit its text).
    """
    whole = F.col("evidence_id").isNotNull() & F.col("requirement_text").isNotNull() & F.col("page_start").isNotNull() & (F.col("page_end") >= F.col("page_start"))
    fits = grounded(F.col("source_text"), F.col("char_start"), F.col("char_end"), F.col("source_sha256"))
    state = (
        F.when(~F.col("sha_before").eqNullSafe(F.col("sha_after")), "SOURCE_CHANGED").when(F.col("comparison_id").isNull(), "AUTHORITY_UNAVAILABLE")
        .when(~F.coalesce(whole, F.lit(False)) | ~fits, "AUTHORITY_MISMATCH").otherwise("FOUND")
    )
    named = {k: F.col(k) for k in ("comparison_id", "decision", "reason_code", "decision_scope", "source_text", "requirement_text", "missing_information")} | {"document_sha256": F.col("sha_after")}
    out = rows.withColumn("finding_state", state)
    found = F.col("finding_state") == "FOUND"
    return out.withColumn("finding_id", F.when(found, finding_id(named))).withColumn("summary", F.when(found, summary(named)))


def review_events(findings: DataFrame, commands: DataFrame) -> DataFrame:
    """commands with event_state, reviewer_note_sha256 and review_event_id.

    ``commands``: document_id, finding_id, reviewer_id, disposition,
    report_inclusion, reviewer_note, occurred_at (timestamp); ``findings``:
    document_id and finding_id. A command for a finding that is not there, or not
    of that document, gives AUTHORITY_MISMATCH and no event.
    """
    known = findings.select("document_id", "finding_id").distinct().withColumn("__known", F.lit(True))
    rows = commands.join(known, ["document_id", "finding_id"], "left").withColumn("reviewer_note_sha256", ids.text_hash(F.coalesce("reviewer_note", F.lit(""))))
    at = F.date_format(F.to_utc_timestamp("occurred_at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    fields = {k: F.col(k) for k in ("document_id", "finding_id", "reviewer_id", "disposition", "report_inclusion", "reviewer_note_sha256")}
    fields |= {"review_event_version": F.lit(EVENT_VERSION), "reviewer_identity_assurance": F.lit(ASSURANCE), "occurred_at": at}
    return rows.select(*commands.columns, F.when(F.col("__known"), "RECORDED").otherwise("AUTHORITY_MISMATCH").alias("event_state"), "reviewer_note_sha256", F.when(F.col("__known"), ids.canonical_id("reviewevent_", fields)).alias("review_event_id"))


def locate(sources: DataFrame, articles: DataFrame) -> DataFrame:
    """sources with location: the first check that fails against the stored article, or LOCATED, and the article's pages where it is.

    ``sources``: standard_id, source_checksum, article_id, article_number,
    char_start, char_end, source_text, source_text_sha256; ``articles``:
    standard_id, article_id, article_number, source_checksum, article_text,
    page_start, page_end. Stored articles that share an identity locate nothing.
    """
    once = articles.groupBy("standard_id", "article_id").agg(
        F.count(F.lit(1)).alias("__n"), *(F.min(c).alias(f"__{c}") for c in ("article_number", "source_checksum", "article_text", "page_start", "page_end"))
    )
    met = sources.join(once, ["standard_id", "article_id"], "left")
    at = F.substring(F.col("__article_text"), F.col("char_start") + 1, F.length("source_text")) == F.col("source_text")
    spans = at & (F.col("char_end") == F.col("char_start") + F.length("source_text"))
    state = (
        F.when(F.col("__n").isNull(), "ARTICLE_MISSING").when(F.col("__n") > 1, "DUPLICATE_IDENTITY").when(~F.col("source_checksum").eqNullSafe(F.col("__source_checksum")), "CHECKSUM_MISMATCH")
        .when(~F.col("article_number").eqNullSafe(F.col("__article_number")), "ARTICLE_MISMATCH").when(~F.coalesce(spans, F.lit(False)), "SPAN_MISMATCH")
        .when(~F.col("source_text_sha256").eqNullSafe(ids.text_hash(F.col("source_text"))), "HASH_MISMATCH").otherwise("LOCATED")
    )
    out = met.withColumn("location", state)
    pages = [F.when(F.col("location") == "LOCATED", F.col(f"__{c}")).alias(c) for c in ("page_start", "page_end")]
    return out.select(*sources.columns, "location", *pages)


#: What must be equal between a binding's evidence, its route and the stored article.
BINDING_CHECKS = (
    "retrieval_decision = 'ACCEPT'", "article_type = 'NORMATIVE'", "standard_id = routed_standard_id", "evidence_standard_id = routed_standard_id", "stored_article_id is not null",
    "stored_standard_id = routed_standard_id", "stored_article_number = article_number", "stored_text = source_text", "stored_checksum = source_checksum",
)


def bindings(rows: DataFrame, articles: DataFrame) -> DataFrame:
    """rows with failed (numbers from 1 of BINDING_CHECKS that do not hold) and qualified.

    ``rows``: retrieval_decision, article_type, standard_id,
    evidence_standard_id, routed_standard_id, article_id, article_number,
    source_text, source_checksum; ``articles`` (one a standard and article):
    standard_id, article_id, article_number, article_text, source_checksum.
    """
    stored = articles.select(F.col("article_id").alias("stored_article_id"), F.col("standard_id").alias("stored_standard_id"), F.col("article_number").alias("stored_article_number"), F.col("article_text").alias("stored_text"), F.col("source_checksum").alias("stored_checksum"))
    met = rows.join(stored, (F.col("article_id") == F.col("stored_article_id")) & (F.col("evidence_standard_id") == F.col("stored_standard_id")), "left")
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(i)) for i, c in enumerate(BINDING_CHECKS, 1))))
    return met.select(*rows.columns, failed.alias("failed")).withColumn("qualified", F.size("failed") == 0)


def review_plan(spans: DataFrame, evidence: DataFrame, available: DataFrame, r: RU.ReviewRules = RU.REVIEW) -> DataFrame:
    """The run over a whole plan: a row for each candidate and bound article with trace_state, decision, reason, finding_state, finding_id and summary.

    ``spans``: document_id, sha_before, sha_after, span_id, char_start, text of
    a plan; ``evidence``: code, span_id, retrieval (ACCEPT or not), evidence_id,
    article_text, page_start, page_end; ``available``: codes of installed
    standards. Every candidate ends in a state of its own; none stops the run.
    """
    routed = V.route(V.discover(spans, "text", r), "text", available, r)
    own = evidence.select("code", "span_id", "retrieval", "evidence_id", "article_text", "page_start", "page_end")
    met = routed.withColumn("code", F.when(F.col("route") == "ROUTED", F.get("codes", F.lit(0)))).join(own, ["code", "span_id"], "left")
    met = met.withColumn("req", V.requirement(F.col("article_text"))).withColumn("fact", V.plan_fact(F.col("text")))
    proven = F.col("req.atomicity") == "PROVEN"
    decomposed = F.when(F.col("article_text").isNull(), "SOURCE_NOT_QUALIFIED").when(proven, "DECOMPOSED").otherwise("UNRESOLVED")
    met = met.withColumn("trace_state", V.terminal_state(F.col("route"), F.coalesce("retrieval", F.lit("NO_MATCH")), decomposed))
    n = F.when(F.col("fact.parsing_status") == "UNSUPPORTED", 0).when(F.col("fact.parsing_status") == "PROVEN", 1).otherwise(2)
    verdict = V.comparison({
        "atomicity": F.col("req.atomicity"), "modality": F.col("req.modality"), "operator": F.col("req.operator"), "limit": F.col("req.value"), "limit_unit": F.col("req.unit"), "n_facts": n, "n_proven": n, "actual": F.col("fact.value"), "unit": F.col("fact.unit"),
    })
    done = F.col("trace_state").isin("REQUIREMENTS_PROCESSED", "REQUIREMENT_UNRESOLVED")
    met = met.withColumn("verdict", F.when(done, verdict)).withColumn("char_end", F.col("char_start") + F.length("text")).withColumn("source_sha256", ids.text_hash(F.col("text")))
    parts = {"span_id": F.col("span_id").cast("string"), "evidence_id": F.col("evidence_id"), "decision": F.col("verdict.decision"), "reason": F.col("verdict.reason"), "value": T.decimal_text(F.col("fact.value"))}
    rows = met.select(
        "document_id", "span_id", "candidate_class", "route", "trace_state", "sha_before", "sha_after", F.when(done, ids.canonical_id("comparison_", parts)).alias("comparison_id"), F.col("verdict.decision").alias("decision"), F.col("verdict.reason").alias("reason_code"),
        F.lit("LOCAL_REQUIREMENT").alias("decision_scope"), "evidence_id", F.col("article_text").alias("requirement_text"), "page_start", "page_end", F.col("text").alias("source_text"), "char_start", "char_end", "source_sha256",
        F.when(F.col("verdict.decision") == "INSUFFICIENT_INFORMATION", F.array(F.col("verdict.reason"))).otherwise(F.array().cast("array<string>")).alias("missing_information"),
    )
    return build(rows)
