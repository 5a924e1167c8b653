"""Analysis and review verdicts from model replies, which are input data here.

`responses` has `repo_id, finding_id, stage, success, content` and token counts, one row per
finding and stage (`analyze`, `review`, `patch`). A missing row counts as a failed call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vulnloom import constants as c
from vulnloom.config import RuleConfig
from vulnloom.functions import replies
from vulnloom.operators.context import with_context, with_overview
from vulnloom.operators.skew import salted_join

ANALYSIS_PROMPT = """\
Is this possible vulnerability in repository "%s" real?

## Finding
- Type: %s
- File: %s
- Lines: %d-%d
- Found by: %s
- Rule: %s
- Message: %s

## Code
%s

## Repository
%s

Consider untrusted input, sanitizing, reachability from outside and impact. Answer with one JSON
object with the members is_vulnerable, confidence, severity (critical, high, medium, low),
cvss_estimate, reasoning, taint_chain, exploitability (confirmed, likely, possible, unlikely),
blast_radius and is_reachable."""

REVIEW_PROMPT = """\
Argue that this reported vulnerability is a false positive, then judge the argument.

## Finding
- Type: %s
- File: %s:%d
- Severity: %s
- CVSS: %s
- Reasoning: %s
- Taint chain: %s
- Exploitability: %s

## Code
%s

Answer with one JSON object with the members fp_argument, fp_argument_strength (strong, moderate,
weak), rebuttal, final_verdict (confirmed_vulnerable, likely_fp, uncertain) and
adjusted_confidence."""


def analysis_prompts(findings: DataFrame, sections: DataFrame, repos: DataFrame, exact_context: bool = False) -> DataFrame:
    """`repo_id, finding_id, stage, text`: finding, its context and the repository overview."""
    named = salted_join(findings, repos.select("repo_id", "repo_name"), ["repo_id"], ["id"], "left")
    ready = with_overview(with_context(named, sections, exact_context), sections)
    text = F.format_string(
        ANALYSIS_PROMPT, F.coalesce("repo_name", "repo_id"), F.col("vuln_type"), F.col("file_path"),
        F.col("line_start"), F.col("line_end"), F.col("detection_method"), F.coalesce("rule_id", F.lit("custom")),
        F.col("message"), F.col("context"), F.col("overview"),
    )
    return ready.select("repo_id", F.col("id").alias("finding_id"), F.lit("analyze").alias("stage"), text.alias("text"))


def review_prompts(enriched: DataFrame, sections: DataFrame, exact_context: bool = False) -> DataFrame:
    text = F.format_string(
        REVIEW_PROMPT, F.col("vuln_type"), F.col("file_path"), F.col("line_start"), F.col("severity"),
        F.col("cvss_estimate").cast("string"), F.col("reasoning"),
        F.coalesce(F.nullif(F.col("taint_chain"), F.lit("")), F.lit("Not specified")), F.col("exploitability"), F.col("context"),
    )
    ready = with_context(enriched, sections, exact_context)
    return ready.select("repo_id", F.col("id").alias("finding_id"), F.lit("review").alias("stage"), text.alias("text"))


def _evaluated(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later expressions read instead of recomputing: the optimizer does not
    inline the output of a generator."""
    return df.withColumn(name, F.explode(F.array(value)))


def _with_verdicts(findings: DataFrame, judged: DataFrame) -> DataFrame:
    """Findings joined to the verdict on each, by shuffles on both sides.

    Parsed replies are variants, which count as 2 KB each, so that the optimizer takes the few columns
    read from them for a small part of the replies' size and would send the verdicts on all findings
    to the driver and to every task. `judged` is already spread by the key.
    """
    return findings.join(judged.hint("merge"), ["repo_id", "id"], "left")


def stage_replies(responses: DataFrame, stage: str) -> DataFrame:
    """`repo_id, id, reply` of one stage, the JSON null when there is nothing to read.

    An empty object, list or text and a bare null, zero or false count as nothing. Verdicts are
    worked out on these rows, so that only their few columns are shuffled to the findings. Of the
    replies to a retried call one counts: a successful one, then that of the last `attempt` if
    there is such a column. Sets `spark.sql.variant.allowDuplicateKeys` in the session (`replies.lenient`).
    """
    replies.lenient(responses.sparkSession)
    rows = responses.filter(F.col("stage") == stage).select("*", F.col("finding_id").alias("id"))
    order = ["success", *(["attempt"] if "attempt" in responses.columns else []), "content"]
    last = F.max(F.struct(*order)).alias("r")
    rows = rows.groupBy("repo_id", "id").agg(last).select("repo_id", "id", "r.success", "r.content")
    rows = _evaluated(rows, "json", F.when(F.col("success"), replies.extract_json(F.col("content"))))
    rows = _evaluated(rows, "reply", F.when(~replies.falsy(F.col("json")), F.col("json")))
    return rows.select("repo_id", "id", "reply")


def analysis_outcome(reply: Column) -> Column:
    """missing, error, rejected or accepted.

    An error is a reply whose members do not have a usable type. That includes a rejection
    whose reasoning is neither text nor a list, because the reason is quoted when rejecting.
    """
    member = lambda name: replies.field(reply, name)
    reasoning = member("reasoning")
    quotable = reasoning.isNull() | replies.kind(reasoning).rlike("^(?:STRING|ARRAY)")
    unusable = (
        replies.is_container(member("severity"))
        | replies.is_container(member("exploitability"))
        | replies.number_field(reply, "cvss_estimate", F.lit(5.0)).isNull()
    )
    return (
        F.when(reply.isNull(), "missing")
        .when(~replies.is_object(reply), "error")
        .when(replies.falsy(member("is_vulnerable")), F.when(quotable, "rejected").otherwise("error"))
        .when(unusable, "error")
        .otherwise("accepted")
    )


def analyzed(findings: DataFrame, responses: DataFrame) -> DataFrame:
    """Findings with `outcome` and the enriched columns; rejected ones still included."""
    reply = F.col("reply")
    judged = _evaluated(stage_replies(responses, "analyze"), "_outcome", analysis_outcome(reply))
    judged = judged.select(
        "repo_id",
        "id",
        "_outcome",
        F.when(
            F.col("_outcome") == "accepted",
            F.struct(
                replies.word_field(reply, "severity", c.MODEL_SEVERITIES, "medium").alias("severity"),
                replies.number_field(reply, "cvss_estimate", F.lit(5.0)).alias("cvss_estimate"),
                replies.text_field(reply, "reasoning", c.NO_REASONING).alias("reasoning"),
                replies.text_field(reply, "taint_chain", None).alias("taint_chain"),
                replies.word_field(reply, "exploitability", c.EXPLOITABILITIES, "possible").alias("exploitability"),
                replies.text_field(reply, "blast_radius", c.NO_IMPACT).alias("blast_radius"),
                replies.boolean_field(reply, "is_reachable").alias("is_reachable"),
            ),
        ).alias("_verdict"),
    )
    accepted = F.col("outcome") == "accepted"
    fallback = F.when(F.col("outcome") == "error", c.ANALYSIS_ERROR).otherwise(c.ANALYSIS_MISSING)
    otherwise = {
        "severity": F.lit("medium"),
        "cvss_estimate": F.lit(5.0),
        "reasoning": fallback,
        "taint_chain": F.lit(None),
        "exploitability": F.lit("possible"),
        "blast_radius": F.lit(c.ANALYSIS_MISSING_IMPACT),
        "is_reachable": F.lit(None),
    }
    joined = _with_verdicts(findings, judged)
    joined = joined.withColumn("outcome", F.coalesce("_outcome", F.lit("missing")))
    columns = {n: F.when(accepted, F.col(f"_verdict.{n}")).otherwise(v) for n, v in otherwise.items()}
    return joined.withColumns(columns).drop("_outcome", "_verdict")


def apply_analysis(findings: DataFrame, responses: DataFrame) -> DataFrame:
    """Enriched findings; those the model rejected are gone, those it failed on stay as medium."""
    return analyzed(findings, responses).filter(F.col("outcome") != "rejected").drop("outcome")


def analysis_counts(analyzed_findings: DataFrame) -> DataFrame:
    rejected = F.col("outcome") == "rejected"
    return analyzed_findings.groupBy("repo_id").agg(
        F.count_if(~rejected).alias("confirmed"), F.count_if(rejected).alias("rejected")
    )


def severity_gate(enriched: DataFrame, config: RuleConfig) -> DataFrame:
    return enriched.filter(config.severe_enough(F.col("severity")))


def apply_reviews(enriched: DataFrame, responses: DataFrame, confidence_threshold: float | None = None) -> DataFrame:
    """Validated findings. Without a usable review a finding counts as confirmed.

    `confidence_threshold` is opt-in: confirmed findings below it become likely false positives.
    """
    reply = F.col("reply")
    given = replies.field(reply, "adjusted_confidence")
    confidence = replies.number_field(reply, "adjusted_confidence", F.lit(None).cast("double"))
    usable = (
        replies.is_object(reply)
        & ~replies.is_container(replies.field(reply, "final_verdict"))
        & (given.isNull() | confidence.isNotNull())
    )
    verdict = replies.word_field(reply, "final_verdict", list(c.REVIEW_STATUS), "confirmed_vulnerable")
    status = F.create_map(*[F.lit(x) for pair in c.REVIEW_STATUS.items() for x in pair])[verdict]
    judged = _evaluated(stage_replies(responses, "review"), "_usable", F.coalesce(usable, F.lit(False)))
    judged = judged.filter("_usable").select(
        "repo_id",
        "id",
        F.struct(
            status.alias("validation_status"),
            replies.text_field(reply, "fp_argument", c.NO_ARGUMENT).alias("fp_argument"),
            replies.text_field(reply, "rebuttal", c.NO_REBUTTAL).alias("fp_rebuttal"),
            confidence.alias("final_confidence"),
        ).alias("_review"),
    )
    reviewed = F.col("_review").isNotNull()
    columns = {
        "validation_status": F.when(reviewed, F.col("_review.validation_status")).otherwise("confirmed"),
        "fp_argument": F.when(reviewed, F.col("_review.fp_argument")).otherwise(c.REVIEW_MISSING_ARGUMENT),
        "fp_rebuttal": F.when(reviewed, F.col("_review.fp_rebuttal")).otherwise(c.REVIEW_MISSING_REBUTTAL),
        "final_confidence": F.coalesce("_review.final_confidence", "confidence"),
    }
    validated = _with_verdicts(enriched, judged).withColumns(columns).drop("_review")
    if confidence_threshold is None:
        return validated
    doubtful = (F.col("validation_status") == "confirmed") & (F.col("final_confidence") < confidence_threshold)
    return validated.withColumn("validation_status", F.when(doubtful, "likely_fp").otherwise(F.col("validation_status")))


def confirmed(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("validation_status") == "confirmed")


def status_counts(validated: DataFrame) -> DataFrame:
    status = F.col("validation_status")
    return validated.groupBy("repo_id").agg(
        *[F.count_if(status == s).alias(s) for s in ("confirmed", "likely_fp", "uncertain")]
    )


def token_usage(responses: DataFrame, by: list[str]) -> DataFrame:
    """Calls, failures and tokens; failed calls add no tokens."""
    used = lambda name: F.sum(F.when(F.col("success"), F.col(name)).otherwise(0))
    return responses.groupBy(*by).agg(
        F.count("*").alias("total_calls"),
        F.count_if(~F.col("success")).alias("failed_calls"),
        used("input_tokens").alias("total_input_tokens"),
        used("output_tokens").alias("total_output_tokens"),
        (used("input_tokens") + used("output_tokens")).alias("total_tokens"),
    )


def missing_responses(findings: DataFrame, responses: DataFrame, stage: str) -> DataFrame:
    """Findings without a reply of the stage."""
    answered = responses.filter(F.col("stage") == stage).select("repo_id", F.col("finding_id").alias("id"))
    missing = findings.join(answered, ["repo_id", "id"], "left_anti")
    return missing.select("repo_id", F.col("id").alias("finding_id"), F.lit(stage).alias("stage"))
