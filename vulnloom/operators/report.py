"""Per-repository results: counts, SARIF, JSON and text.

The product is rows: `json_rows` and `sarif_rows` have one row per finding, whatever the size of a
repository. `json_reports`, `sarif_reports` and `text_reports` assemble one document per repository,
the first of them as a stream of any size; with `findings_per_part` they make documents of at most so many
findings, for any size alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vulnloom import constants as c
from vulnloom.functions.paths import relative_uri
from vulnloom.operators.skew import cut, number_rows, salted_join
from vulnloom.sources import documents

SUMMARY_PROMPT = """\
Sum up the security audit of repository "%s" for its owners in two or three sentences of plain
text. Confirmed findings: %d. Kinds: %s. Severities: %s."""
SHOW_NULLS = {"ignoreNullFields": "false"}


def one_decimal(value: Column) -> Column:
    """One decimal, rounding the exact binary value, ties to even.

    Only a value whose twentieth is odd can sit near a tie; `error` is what the product by 20
    lost to rounding, and its sign tells on which side of the tie the value really lies.
    """
    high, low = value * 16, value * 4
    product = high + low
    part = product - high
    error = (high - (product - part)) + (low - part)
    near_tie = F.pmod(product, F.lit(2.0)) == 1
    rounded = (
        F.when(near_tie & (error > 0), (product + 1) / 20)
        .when(near_tie & (error < 0), (product - 1) / 20)
        .otherwise(F.bround(value, 1))
    )
    return F.format_string("%.1f", rounded)


def percent(value: Column) -> Column:
    return F.concat(F.bround(value * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")


def level_priority(level: Column) -> Column:
    return F.when(level == "error", 2).when(level == "warning", 1).otherwise(0)


def level_of_priority(priority: Column) -> Column:
    return F.when(priority == 2, "error").when(priority == 1, "warning").otherwise("note")


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence > 0.8, "high").when(confidence > 0.6, "medium").otherwise("low")


def reachability(is_reachable: Column) -> Column:
    return F.when(is_reachable, "Yes").when(~is_reachable, "No").otherwise("Unknown")


def executive_summary(confirmed: Column, repo_name: Column) -> Column:
    text = F.format_string(c.TOOL_NAME + c.SUMMARY_SENTENCE, confirmed, repo_name)
    return F.when(confirmed > 0, text).otherwise("")


def summary_prompts(results: DataFrame) -> DataFrame:
    """`repo_id, finding_id, stage, text` for each repository with confirmed findings."""
    text = F.format_string(
        SUMMARY_PROMPT, F.col("repo_name"), F.col("confirmed_count"),
        F.array_join("vuln_types", ", "), F.array_join("severities", ", "),
    )
    return results.filter(F.col("confirmed_count") > 0).select(
        "repo_id", F.lit(None).cast("string").alias("finding_id"), F.lit("summary").alias("stage"), text.alias("text")
    )


def _summary_replies(responses: DataFrame) -> DataFrame:
    """`repo_id, _summary`: the text of the reply that counts, empty if all calls failed."""
    order = ["success", *(["attempt"] if "attempt" in responses.columns else []), "content"]
    last = responses.filter(F.col("stage") == "summary").groupBy("repo_id").agg(F.max(F.struct(*order)).alias("r"))
    return last.select("repo_id", F.when(F.col("r.success"), F.col("r.content")).alias("_summary"))


def scan_results(
    repos: DataFrame,
    summary: DataFrame,
    findings: DataFrame,
    confirmed: DataFrame | None = None,
    patches: DataFrame | None = None,
    duration_seconds: float = 0.0,
    responses: DataFrame | None = None,
) -> DataFrame:
    """One row per repository: metadata, counts and executive summary.

    Without `confirmed` the scan was detection-only. `repos` has `repo_id, repo_name, repo_url,
    branch, commit_hash, scan_timestamp`. The summary is the reply of stage `summary` in
    `responses`, empty where there is none; without `responses` it is a fixed sentence.
    """
    out = repos.join(
        summary.select("repo_id", F.col("files_included").alias("files_analyzed"), "total_lines"), "repo_id", "left"
    ).join(findings.groupBy("repo_id").agg(F.count("*").alias("raw_findings_count")), "repo_id", "left")
    stage, empty = "detect", F.array().cast("array<string>")
    if confirmed is not None:
        stage, severity = "report", F.col("severity")
        out = out.join(
            confirmed.groupBy("repo_id").agg(
                F.count("*").alias("confirmed_count"),
                F.count_if(severity == "critical").alias("critical_count"),
                F.count_if(severity == "high").alias("high_count"),
                F.sort_array(F.collect_set("vuln_type")).alias("vuln_types"),
                F.sort_array(F.collect_set("severity")).alias("severities"),
            ),
            "repo_id", "left",
        )
    else:
        out = out.withColumns(
            {n: F.lit(0).cast("bigint") for n in ("confirmed_count", "critical_count", "high_count")}
            | {n: empty for n in ("vuln_types", "severities")}
        )
    if patches is not None:
        out = out.join(latest_patches(patches).groupBy("repo_id").agg(F.count("*").alias("patches_count")), "repo_id", "left")
    else:
        out = out.withColumn("patches_count", F.lit(0).cast("bigint"))
    counts = [
        "files_analyzed", "total_lines", "raw_findings_count", "confirmed_count", "critical_count", "high_count",
        "patches_count",
    ]
    out = out.na.fill(0, counts)
    summary = executive_summary(F.col("confirmed_count"), F.col("repo_name"))
    if responses is not None:
        out = out.join(_summary_replies(responses), "repo_id", "left")
        summary = F.when(F.col("confirmed_count") > 0, F.coalesce("_summary", F.lit(""))).otherwise("")
    return out.withColumns(
        {
            "vuln_types": F.coalesce("vuln_types", empty),
            "severities": F.coalesce("severities", empty),
            "executive_summary": summary,
            "scan_duration_seconds": F.lit(float(duration_seconds)),
            "last_stage": F.when(F.col("raw_findings_count") == 0, "detect").otherwise(stage),
        }
    ).drop("_summary")


def latest_patches(patches: DataFrame) -> DataFrame:
    """One patch per finding; of several the last counts."""
    rest = [n for n in patches.columns if n not in ("repo_id", "finding_id")]
    best = patches.groupBy("repo_id", "finding_id").agg(F.max_by(F.struct(*rest), "seq").alias("p"))
    return best.select("repo_id", "finding_id", *[f"p.{n}" for n in rest])


def _patch_struct() -> Column:
    return F.struct("finding_id", "diff", "explanation", "syntax_valid", "files_modified")


def parted(confirmed: DataFrame, findings_per_part: int | None = None) -> DataFrame:
    """Confirmed findings with `index` from 1 in finding order and the `part` they belong to.

    `confirmed` is a table of a scan that is written down; it is read twice.
    """
    numbered = number_rows(confirmed, ["repo_id"], ["seq"], "index", stored=True)
    part = F.lit(0) if findings_per_part is None else F.floor((F.col("index") - 1) / findings_per_part)
    return numbered.withColumn("part", part.cast("int"))


def _ordered(confirmed: DataFrame, findings_per_part: int | None) -> DataFrame:
    """`parted` where only the order of the findings matters: a single part needs no numbers."""
    if findings_per_part is not None:
        return parted(confirmed, findings_per_part)
    return confirmed.withColumns({"index": F.col("seq"), "part": F.lit(0)})


def _patches_by_finding(patches: DataFrame) -> DataFrame:
    return latest_patches(patches).select(
        "repo_id", F.col("finding_id").alias("id"), F.to_json(_patch_struct(), SHOW_NULLS).alias("patch")
    )


def _with_patches(confirmed: DataFrame, patches: DataFrame) -> DataFrame:
    """Confirmed findings joined to the JSON of their patch, by shuffles on both sides.

    The optimizer takes a patch for a short text and the table it is made from for as large as its
    file, so that it would send all patches to the driver and to every task. They are already spread by the key.
    """
    return confirmed.join(_patches_by_finding(patches).hint("merge"), ["repo_id", "id"], "left")


def json_rows(confirmed: DataFrame, patches: DataFrame) -> DataFrame:
    """`repo_id, seq, finding, patch`: a confirmed finding and its patch as JSON, a row each."""
    rows = _with_patches(confirmed, patches)
    return rows.select("repo_id", "seq", finding_json().alias("finding"), "patch")


def sarif_rows(confirmed: DataFrame, patches: DataFrame) -> DataFrame:
    """`repo_id, kind, seq, json`: the rules and results of SARIF logs, a row each."""
    rows = _with_patches(confirmed, patches)
    found = rows.select("repo_id", F.lit("result").alias("kind"), "seq", _sarif_result_json().alias("json"))
    rules = sarif_rules(confirmed)
    return found.unionByName(
        rules.select("repo_id", F.lit("rule").alias("kind"), F.col("first_seq").alias("seq"), _sarif_rule_json().alias("json"))
    )


def _frames(results: DataFrame, confirmed: DataFrame, findings_per_part: int | None) -> DataFrame:
    """`repo_id, part, result`: a row of results for each part of its documents, part 0 without findings too."""
    rows, last = results, F.lit(0)
    if findings_per_part is not None:
        last = F.floor((F.col("_count") - 1) / findings_per_part).cast("int")
        counts = confirmed.groupBy("repo_id").agg(F.count("*").alias("_count"))
        rows, last = results.join(counts, "repo_id", "left"), F.coalesce(last, F.lit(0))
    part = F.explode(F.sequence(F.lit(0), last)).alias("part")
    return rows.select("repo_id", part, F.struct(*results.columns).alias("result"))


def _documents(frames: DataFrame, rows: DataFrame, values: dict[str, Column], separator: str) -> DataFrame:
    """Results with their `part` and each value of its rows joined in `index` order, nulls left out.

    Frames are grouped with the rows, so that the texts of documents are never a side of a join.
    """
    found = rows.filter(F.col("repo_id").isNotNull()).select("repo_id", "part", "index", *[v.alias(n) for n, v in values.items()])
    item = lambda n: F.when(F.col("index").isNotNull(), F.struct("index", F.col(n).alias("v")))
    lists = [F.array_sort(F.collect_list(item(n))).alias(n) for n in values]
    both = found.unionByName(frames, allowMissingColumns=True).groupBy("repo_id", "part")
    grouped = both.agg(F.first("result", ignorenulls=True).alias("result"), *lists).filter(F.col("result").isNotNull())
    joined = [F.array_join(F.transform(n, lambda x: x["v"]), separator).alias(n) for n in values]
    return grouped.select("result.*", "part", *joined)


def finding_json() -> Column:
    """Nested JSON of a validated finding."""
    raw = F.struct(
        "id", "vuln_type", "file_path", "line_start", "line_end", "code_snippet", "detection_method", "confidence",
        "message", "rule_id", "metadata",
    )
    enriched = F.struct(
        raw.alias("raw"), "severity", "cvss_estimate", "reasoning", "taint_chain", "exploitability", "blast_radius",
        "is_reachable",
    )
    return F.to_json(
        F.struct(enriched.alias("enriched"), "validation_status", "fp_argument", "fp_rebuttal", "final_confidence"),
        SHOW_NULLS,
    )


def _json_frame() -> tuple[Column, Column, Column]:
    """What stands before the findings, between them and the patches, and after these, of a row of results."""
    head = F.to_json(
        F.struct(
            "repo_name", "repo_url", "branch", "commit_hash", _iso("scan_timestamp").alias("scan_timestamp"),
            "files_analyzed", "total_lines", "raw_findings_count",
        ),
        SHOW_NULLS,
    )
    tail = F.to_json(F.struct("executive_summary", "scan_duration_seconds"), SHOW_NULLS)
    last = F.concat(F.lit("],"), F.substring(tail, 2, F.length(tail)))
    return F.concat(_open(head), F.lit(',"confirmed_findings":[')), F.lit('],"patches":['), last


def _pieces(frame: DataFrame, lists: list[DataFrame]) -> DataFrame:
    """`repo_id, section, seq, text`: the fixed texts of `frame` (even sections) and the elements between them.

    `frame` has an array `texts` for each repository, `lists` are `repo_id, seq, text` for the sections
    in between. Every element but the first of its list brings its comma with it.
    """
    rows = frame.select("repo_id", F.posexplode("texts").alias("at", "text"))
    out = rows.select("repo_id", (F.col("at") * 2).alias("section"), F.lit(None).cast("bigint").alias("seq"), "text")
    for i, elements in enumerate(lists):
        firsts = elements.groupBy("repo_id").agg(F.min("seq").alias("first"))
        joined = salted_join(elements, firsts, ["repo_id"], ["seq"])
        comma = F.when(F.col("seq") > F.col("first"), ",").otherwise("")
        out = out.unionByName(joined.select("repo_id", F.lit(2 * i + 1).alias("section"), "seq", F.concat(comma, "text").alias("text")))
    return out


def json_pieces(results: DataFrame, confirmed: DataFrame, patches: DataFrame) -> DataFrame:
    """The JSON reports in pieces of a finding or patch each, for `sinks.write_documents`.

    In the order of (section, seq) the pieces of a repository are its report, byte by byte.
    """
    rows = cut(json_rows(confirmed, patches).withColumn("seq", F.col("seq").cast("bigint")))
    frame = results.select("repo_id", F.array(*_json_frame()).alias("texts"))
    found = rows.select("repo_id", "seq", F.col("finding").alias("text"))
    fixes = rows.filter(F.col("patch").isNotNull()).select("repo_id", "seq", F.col("patch").alias("text"))
    return _pieces(frame, [found, fixes])


def json_reports(
    results: DataFrame, confirmed: DataFrame, patches: DataFrame, findings_per_part: int | None = None
) -> DataFrame:
    """`repo_id, part, place, report`: result, its findings and their patches as one JSON text.

    Documents are streamed into files, and `place` says where each lies. Only the use of `report` makes
    a row hold a whole one; `documents.elements` reads them without that, whatever their size.
    """
    rows = _with_patches(_ordered(confirmed, findings_per_part), patches)
    rows = rows.filter(F.col("repo_id").isNotNull() & F.col("index").isNotNull())
    texts = [F.struct(F.lit(n).alias("section"), t.alias("text")) for n, t in enumerate((finding_json(), F.col("patch")), 1)]
    found = rows.select("repo_id", "part", "index", F.inline(F.array(*texts))).filter(F.col("text").isNotNull())
    frames = _frames(results, confirmed, findings_per_part).select("part", "result.*")
    frames = frames.select(
        "repo_id", "part", F.lit(None).alias("index"), F.lit(documents.FRAME).alias("section"), F.to_json(F.array(*_json_frame())).alias("text")
    )
    made = documents.streamed(frames.unionByName(found))
    return made.withColumn("report", documents.text_of(F.col("place")))


def _open(json_object: Column) -> Column:
    """JSON object text without its closing brace."""
    return F.substring(json_object, F.lit(1), F.length(json_object) - 1)


def _iso(timestamp: str) -> Column:
    """ISO form; microseconds only where there are any."""
    seconds, micros = F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(timestamp, "SSSSSS")
    return F.when(micros == "000000", seconds).otherwise(F.concat(seconds, F.lit("."), micros))


def sarif_rules(confirmed: DataFrame) -> DataFrame:
    """One rule per repository and vulnerability type: texts of the first finding, the highest
    level and score of all, and `first_seq` for the order of the rules."""
    return (
        confirmed.groupBy("repo_id", "vuln_type")
        .agg(
            F.min_by(F.struct("message", "reasoning"), "seq").alias("first"),
            F.max(level_priority(sarif_level(F.col("severity")))).alias("priority"),
            F.max("cvss_estimate").alias("cvss"),
            F.min("seq").alias("first_seq"),
        )
        .select(
            "repo_id",
            F.col("vuln_type").alias("rule_id"),
            F.coalesce(
                F.nullif(F.col("first.message"), F.lit("")),
                F.concat(F.lit("Potential "), "vuln_type", F.lit(" vulnerability")),
            ).alias("short_description"),
            F.col("first.reasoning").alias("full_description"),
            level_of_priority(F.col("priority")).alias("level"),
            one_decimal(F.col("cvss")).alias("security_severity"),
            "first_seq",
        )
    )


def _sarif_rule_json() -> Column:
    return F.to_json(
        F.struct(
            F.col("rule_id").alias("id"),
            F.col("rule_id").alias("name"),
            F.struct(F.col("short_description").alias("text")).alias("shortDescription"),
            F.struct(F.col("full_description").alias("text")).alias("fullDescription"),
            F.struct("level").alias("defaultConfiguration"),
            F.struct(
                F.array(F.lit("security")).alias("tags"), F.col("security_severity").alias("security-severity")
            ).alias("properties"),
        ),
        SHOW_NULLS,
    )


def _sarif_result_json() -> Column:
    region = F.struct(F.col("line_start").alias("startLine"), F.col("line_end").alias("endLine"))
    artifact = F.struct(relative_uri(F.col("file_path")).alias("uri"))
    location = F.struct(F.struct(artifact.alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    properties = F.to_json(
        F.struct(
            F.col("final_confidence").alias("confidence"),
            F.col("cvss_estimate").alias("cvss"),
            F.col("taint_chain").alias("taintChain"),
            F.col("validation_status").alias("validationStatus"),
            F.nullif(F.col("fp_argument"), F.lit("")).alias("fpArgument"),
            F.nullif(F.col("fp_rebuttal"), F.lit("")).alias("fpRebuttal"),
        ),
        SHOW_NULLS,
    )
    with_patch = F.when(
        F.col("patch").isNotNull(), F.concat(_open(properties), F.lit(',"patch":'), "patch", F.lit("}"))
    ).otherwise(properties)
    result = F.to_json(
        F.struct(
            F.col("vuln_type").alias("ruleId"),
            sarif_level(F.col("severity")).alias("level"),
            F.struct(F.col("reasoning").alias("text")).alias("message"),
            F.array(location).alias("locations"),
        ),
        SHOW_NULLS,
    )
    return F.concat(_open(result), F.lit(',"properties":'), with_patch, F.lit("}"))


# What stands before the rules of a SARIF log, between them and the results, and after these.
SARIF_FRAME = (
    f'{{"$schema":"{c.SARIF_SCHEMA}","version":"{c.SARIF_VERSION}","runs":[{{"tool":{{"driver":'
    f'{{"name":"{c.TOOL_NAME}","version":"{c.TOOL_VERSION}","rules":[',
    ']}},"results":[',
    "]}]}",
)


def sarif_pieces(results: DataFrame, confirmed: DataFrame, patches: DataFrame) -> DataFrame:
    """The SARIF logs in pieces of a rule or result each, for `sinks.write_documents`."""
    rows = cut(sarif_rows(confirmed, patches).withColumn("seq", F.col("seq").cast("bigint")))
    frame = results.select("repo_id", F.array(*map(F.lit, SARIF_FRAME)).alias("texts"))
    kinds = [rows.filter(F.col("kind") == k).select("repo_id", "seq", F.col("json").alias("text")) for k in ("rule", "result")]
    return _pieces(frame, kinds)


def sarif_reports(
    results: DataFrame, confirmed: DataFrame, patches: DataFrame, findings_per_part: int | None = None
) -> DataFrame:
    """`repo_id, part, file_name, report`: SARIF 2.1.0 logs, every part with all rules."""
    rows = _with_patches(_ordered(confirmed, findings_per_part), patches)
    rules = (
        sarif_rules(confirmed)
        .groupBy("repo_id")
        .agg(F.array_sort(F.collect_list(F.struct("first_seq", _sarif_rule_json().alias("rule")))).alias("rules"))
        .select("repo_id", F.array_join(F.transform("rules", lambda r: r["rule"]), ",").alias("rules"))
    )
    head, between, tail = map(F.lit, SARIF_FRAME)
    report = F.concat(head, F.coalesce("rules", F.lit("")), between, "findings", tail)
    stem = F.concat_ws(
        "_", F.translate("repo_name", "/", "_"), F.date_format("scan_timestamp", "yyyyMMdd_HHmmss"),
        F.when(F.col("part") > 0, F.concat(F.lit("part"), F.col("part").cast("string"))),
    )
    frames = _frames(results.join(rules, "repo_id", "left"), confirmed, findings_per_part)
    made = _documents(frames, rows, {"findings": _sarif_result_json()}, ",")
    return made.select("repo_id", "part", F.concat(stem, F.lit(".sarif.json")).alias("file_name"), report.alias("report"))


def text_reports(
    results: DataFrame, confirmed: DataFrame, findings_per_part: int | None = None
) -> DataFrame:
    """`repo_id, part, report`: plain text, a header and one block per finding.

    The header opens part 0; the parts in order, joined by newlines, are the whole report.
    """
    block = F.concat_ws(
        "\n",
        F.format_string("--- Finding %d ---", F.col("index")),
        F.concat(F.lit("Type: "), "vuln_type"),
        F.concat(F.lit("Severity: "), "severity"),
        F.concat(F.lit("File: "), "file_path", F.lit(":"), "line_start"),
        F.concat(F.lit("Reasoning: "), F.coalesce("reasoning", F.lit("None"))),
        F.concat(F.lit("Confidence: "), percent(F.col("final_confidence"))),
        F.lit(""),
    )
    frames = _frames(results, confirmed, findings_per_part)
    made = _documents(frames, parted(confirmed, findings_per_part), {"findings": block}, "\n")
    ruler = "=" * 60
    header = F.concat_ws(
        "\n",
        F.lit(ruler), F.lit("Security Report"), F.lit(ruler),
        F.concat(F.lit("Repository: "), "repo_name"),
        F.concat(F.lit("Branch: "), "branch", F.lit(" ("), F.substring("commit_hash", 1, 8), F.lit(")")),
        F.concat(F.lit("Scan Date: "), _iso("scan_timestamp")),
        F.concat(F.lit("Files Analyzed: "), F.col("files_analyzed").cast("string")),
        F.concat(F.lit("Lines of Code: "), F.format_number("total_lines", 0)),
        F.concat(F.lit("Duration: "), one_decimal(F.col("scan_duration_seconds")), F.lit("s")),
        F.lit(""),
        F.concat(F.lit("Raw Findings: "), F.col("raw_findings_count").cast("string")),
        F.concat(F.lit("Confirmed: "), F.col("confirmed_count").cast("string")),
        F.concat(F.lit("Patches: "), F.col("patches_count").cast("string")),
        F.lit(""),
        F.when(
            F.col("executive_summary") != "", F.concat(F.lit("Executive Summary:\n"), "executive_summary", F.lit("\n"))
        ),
    )
    body = F.nullif(F.col("findings"), F.lit(""))
    report = F.when(F.col("part") == 0, F.concat_ws("\n", header, body)).otherwise(body)
    return made.select("repo_id", "part", report.alias("report"))
