"""One query per operator. Each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.views import table, view
from vulnloom.config import RuleConfig
from vulnloom.functions import paths, replies, text
from vulnloom.operators import (
    context,
    dependencies,
    detection,
    digest,
    findings,
    manifest,
    patches,
    repo_config,
    report,
    rule_index,
    rules,
    scope,
    secrets,
    skew,
    structure,
    verdicts,
)
from vulnloom.plans import scan
from vulnloom.sources import documents, files as file_source, repos as repo_source, responses as response_source, scanner

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

STRICT = RuleConfig(checks={"deserialization": False}, min_severity="medium")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def code(spark: SparkSession, sf: str) -> DataFrame:
    return file_source.as_files(view(spark, sf, "v_code"))


def manifests(spark: SparkSession, sf: str) -> DataFrame:
    return file_source.as_files(view(spark, sf, "v_manifests"))


def sources(spark: SparkSession, sf: str) -> DataFrame:
    return structure.source_files(code(spark, sf))


def repos(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata rows for the repositories of v_event_findings."""
    ids = view(spark, sf, "v_event_findings").select("repo_id").distinct()
    return ids.select(
        "repo_id",
        F.concat(F.lit("owner/"), "repo_id").alias("repo_name"),
        F.concat(F.lit("https://github.com/owner/"), "repo_id").alias("repo_url"),
        F.lit("main").alias("branch"),
        F.lit("0123456789abcdef").alias("commit_hash"),
        F.lit("2024-01-02 03:04:05").cast("timestamp").alias("scan_timestamp"),
    )


# ---- Files and manifests ----------------------------------------------------


@query
def manifest_totals(spark: SparkSession, sf: str) -> DataFrame:
    files = code(spark, sf)
    summary = manifest.manifest_summary(files, manifest.manifest(files))
    return summary.drop("language_breakdown", "risk_breakdown")


@query
def manifest_maps(spark: SparkSession, sf: str) -> DataFrame:
    files = code(spark, sf)
    summary = manifest.manifest_summary(files, manifest.manifest(files))
    show = lambda m: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))
    return summary.select("repo_id", show("language_breakdown").alias("languages"), show("risk_breakdown").alias("risks"))


@query
def language_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.breakdown(manifest.manifest(code(spark, sf)), "language")


@query
def risk_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.breakdown(manifest.manifest(code(spark, sf)), "risk_level")


@query
def risk_topn(spark: SparkSession, sf: str) -> DataFrame:
    top = manifest.manifest(code(spark, sf), max_files=10)
    return top.select("repo_id", "rank", "relative_path", "language", "risk_level", "line_count", "estimated_tokens")


@query
def high_risk_files(spark: SparkSession, sf: str) -> DataFrame:
    high = manifest.files_at_risk(manifest.manifest(code(spark, sf)), "high")
    return high.select("repo_id", "relative_path", "line_count")


@query
def line_counts(spark: SparkSession, sf: str) -> DataFrame:
    content = F.col("content")
    return code(spark, sf).select(
        "repo_id",
        "relative_path",
        text.manifest_line_count(content).alias("manifest_lines"),
        text.parsed_line_count(content).alias("parsed_lines"),
        F.size(text.split_lines(content)).alias("split_lines"),
        text.manifest_tokens(text.manifest_line_count(content)).alias("manifest_tokens"),
        text.text_tokens(content).alias("text_tokens"),
        "size_bytes",
    )


@query
def path_normalize(spark: SparkSession, sf: str) -> DataFrame:
    url = F.regexp_replace("url", "^https?:/", "")
    odd = F.concat(F.when(F.col("page_id") % 3 == 0, "./").otherwise(""), url, F.when(F.col("page_id") % 2 == 0, "/.//x/").otherwise(""))
    return table(spark, sf, "pages").select("page_id", paths.normalize_path(odd).alias("path"))


@query
def path_excluded(spark: SparkSession, sf: str) -> DataFrame:
    config = RuleConfig(exclude_paths=["vendor/", "./docs"], exclude_patterns=["*.min.js", "f?.p[xy]", "[!f]*"])
    path = F.col("relative_path")
    return code(spark, sf).select("repo_id", "relative_path", config.excludes(path).alias("excluded"))


# ---- Scope ------------------------------------------------------------------


@query
def diff_scope(spark: SparkSession, sf: str) -> DataFrame:
    files = code(spark, sf)
    changed = scope.changed_paths(view(spark, sf, "v_changed"))
    return scope.in_diff(manifest.manifest(files), changed).select("repo_id", "relative_path", "risk_level")


@query
def scoped_totals(spark: SparkSession, sf: str) -> DataFrame:
    files = code(spark, sf)
    all_files = manifest.manifest(files)
    scoped = scope.in_diff(all_files, scope.changed_paths(view(spark, sf, "v_changed")))
    summary = manifest.scoped_summary(manifest.manifest_summary(files, all_files), scoped)
    return summary.drop("language_breakdown", "risk_breakdown", "fits_single_context")


@query
def scan_targets(spark: SparkSession, sf: str) -> DataFrame:
    changed = scope.changed_paths(view(spark, sf, "v_changed"))
    return scope.scan_targets(code(spark, sf), changed, RuleConfig()).select("repo_id", "relative_path")


@query
def secrets_scope_union(spark: SparkSession, sf: str) -> DataFrame:
    files = code(spark, sf)
    return scope.secret_targets(files, manifest.manifest(files), RuleConfig())


@query
def snapshot_changes(spark: SparkSession, sf: str) -> DataFrame:
    return scope.snapshot_changes(view(spark, sf, "v_files"), view(spark, sf, "v_code"))


# ---- Structure --------------------------------------------------------------


@query
def function_defs(spark: SparkSession, sf: str) -> DataFrame:
    found = structure.functions(sources(spark, sf))
    return found.select("repo_id", "file_path", "name", "line_start", F.array_join("parameters", "|").alias("parameters"))


@query
def function_lines(spark: SparkSession, sf: str) -> DataFrame:
    found = structure.functions(sources(spark, sf), exact_lines=True)
    return found.groupBy("language", "name").agg(
        F.count("*").alias("functions"), F.sum("line_start").alias("lines"), F.sum("line_end").alias("ends"), F.max("line_end").alias("last_line")
    )


@query
def imports_by_module(spark: SparkSession, sf: str) -> DataFrame:
    found = structure.imports(sources(spark, sf))
    return found.groupBy("repo_id", "language", "module").agg(F.count("*").alias("files"), F.sum("line").alias("lines"))


@query
def dangerous_calls(spark: SparkSession, sf: str) -> DataFrame:
    return structure.dangerous_calls(sources(spark, sf)).select("repo_id", "file_path", "name", "line", "arguments_text")


@query
def dangerous_names(spark: SparkSession, sf: str) -> DataFrame:
    endings = [".eval", ".document.write", "eval", ".innerHTML"]
    names = table(spark, sf, "events").select(
        "event_id",
        F.concat("event_type", F.element_at(F.array(*map(F.lit, endings)), (F.col("event_id") % 4 + 1).cast("int"))).alias("name"),
    )
    python, script = (structure.is_dangerous_name(F.col("name"), F.lit(x)) for x in ("python", "javascript"))
    return names.select("event_id", "name", python.alias("in_python"), script.alias("in_javascript"))


@query
def parse_summary(spark: SparkSession, sf: str) -> DataFrame:
    files, src = manifest.manifest(code(spark, sf)), sources(spark, sf)
    found = structure.in_manifest(structure.functions(src), files)
    return structure.parse_summary(files, found, structure.in_manifest(structure.dangerous_calls(src), files))


@query
def dependency_rows(spark: SparkSession, sf: str) -> DataFrame:
    return dependencies.dependencies(manifests(spark, sf))


@query
def dependency_rows_per_glob(spark: SparkSession, sf: str) -> DataFrame:
    rows = dependencies.dependencies(manifests(spark, sf), duplicate_per_glob=True)
    return rows.groupBy("ecosystem", "manifest_file").agg(F.count("*").alias("dependencies"))


@query
def manifest_files_found(spark: SparkSession, sf: str) -> DataFrame:
    files = manifests(spark, sf)
    return dependencies.manifest_files_found(files, dependencies.dependencies(files))


# ---- Detection --------------------------------------------------------------


@query
def rule_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = detection.detect(code(spark, sf), secret_patterns=[])
    return found.select("repo_id", "file_path", "line_start", "rule_id", "vuln_type", "confidence")


@query
def secret_tokens(spark: SparkSession, sf: str) -> DataFrame:
    found = detection.detect(code(spark, sf), rules=[])
    return found.select("repo_id", "file_path", "line_start", "rule_id", "detection_method", "confidence")


@query
def secret_suppressed(spark: SparkSession, sf: str) -> DataFrame:
    """Quoted credentials per repository, and how many lines of them are left to report."""
    lines = code(spark, sf).select("repo_id", "relative_path", F.explode(F.split("content", "\n")).alias("line"))
    line = F.col("line")
    pattern = secrets.SECRET_PATTERNS[-1]
    quoted = line.rlike(secrets.CREDENTIAL)
    return lines.groupBy("repo_id").agg(
        F.count_if(quoted).alias("quoted"),
        F.count_if(secrets.matches(pattern, line)).alias("reported"),
        F.count_if(quoted & line.rlike(secrets.ENVIRONMENT)).alias("environment"),
        F.count_if(quoted & paths.is_test_file(F.col("relative_path"))).alias("in_tests"),
    )


@query
def secret_entropy(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.round(text.shannon_entropy(F.col("text")), 6).alias("entropy"))


@query
def vuln_classify(spark: SparkSession, sf: str) -> DataFrame:
    docs = view(spark, sf, "v_code")
    found = rules.classify(F.concat(F.lit("rule."), "relative_path"), F.col("content"))
    return docs.select("doc_id", F.coalesce(found, F.lit("none")).alias("vuln_type"), rules.in_scope(found, ["sqli", "xss"]).alias("targeted"))


@query
def detection_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Detection, configuration filter and de-duplication, counted by type."""
    found = findings.dedup_findings(detection.detect(code(spark, sf), RuleConfig()))
    return findings.counts_by_type(found)


@query
def finding_filter(spark: SparkSession, sf: str) -> DataFrame:
    return findings.drop_counts(view(spark, sf, "v_raw_findings"), STRICT)


@query
def finding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = findings.filter_findings(view(spark, sf, "v_raw_findings"), STRICT)
    return findings.dedup_findings(kept)


@query
def finding_order(spark: SparkSession, sf: str) -> DataFrame:
    kept = findings.dedup_findings(view(spark, sf, "v_raw_findings"))
    return findings.numbered_findings(kept).select("repo_id", "seq", "file_path", "line_start")


@query
def finding_context(spark: SparkSession, sf: str) -> DataFrame:
    found = findings.with_snippets(view(spark, sf, "v_code_findings"), code(spark, sf))
    return found.select("id", "line_start", "code_snippet")


@query
def scanner_import(spark: SparkSession, sf: str) -> DataFrame:
    """One scanner document per user, with results that lack members here and there."""
    event = table(spark, sf, "events")
    odd = F.col("event_id") % 4
    result = F.struct(
        F.when(odd != 0, F.concat(F.lit("rules.xss-"), "event_type")).alias("check_id"),
        F.concat(F.lit("/work/repo/"), "event_type", F.lit(".js")).alias("path"),
        F.struct(F.col("event_id").alias("line")).alias("start"),
        F.when(odd != 1, F.struct((F.col("event_id") + 2).alias("line"))).alias("end"),
        F.struct(
            F.when(odd != 2, F.concat(F.lit("uses innerHTML on "), "event_type")).alias("message"),
            F.when(odd != 3, F.when(F.col("value") > 50, "ERROR").otherwise("INFO")).alias("severity"),
        ).alias("extra"),
    )
    docs = event.groupBy(F.concat(F.lit("u"), "user_id").alias("repo_id")).agg(
        F.to_json(F.struct(F.array_sort(F.collect_list(result)).alias("results"))).alias("document")
    )
    broken = docs.select(F.concat(F.lit("broken-"), "repo_id").alias("repo_id"), F.substring("document", 1, 5).alias("document"))
    found = scanner.scanner_findings(scanner.scanner_results(docs.unionByName(broken)), "/work/repo")
    return found.select(
        "repo_id", "vuln_type", "file_path", "line_start", "line_end", "confidence", "message", "rule_id",
        F.col("metadata")["semgrep_severity"].alias("severity"),
    )


# ---- Digest -----------------------------------------------------------------


@query
def containing_function(spark: SparkSession, sf: str) -> DataFrame:
    located = digest.containing_functions(
        view(spark, sf, "v_code_findings"), structure.functions(sources(spark, sf), exact_lines=True)
    )
    return located.filter(F.col("function").isNotNull()).select("id", "line_start", F.col("function.name").alias("function"))


@query
def structure_section(spark: SparkSession, sf: str) -> DataFrame:
    files = code(spark, sf)
    return digest.structure_sections(files, manifest.manifest(files)).select("repo_id", "heading", "content", "estimated_tokens")


@query
def dependency_section(spark: SparkSession, sf: str) -> DataFrame:
    files = manifests(spark, sf)
    return digest.dependency_sections(files, files).select("repo_id", "heading", "content", "estimated_tokens")


@query
def finding_section(spark: SparkSession, sf: str) -> DataFrame:
    functions = structure.functions(sources(spark, sf), exact_lines=True)
    sections = digest.finding_sections(view(spark, sf, "v_code_findings"), code(spark, sf), functions)
    return sections.select("repo_id", "pos", "heading", "content", "estimated_tokens")


@query
def file_section(spark: SparkSession, sf: str) -> DataFrame:
    files = code(spark, sf)
    plan = digest.file_section_plan(manifest.manifest(files), view(spark, sf, "v_some_findings"), files)
    return digest.file_sections(plan, files).select("repo_id", "priority", "heading", "content", "estimated_tokens")


def document_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a section of its source."""
    docs = table(spark, sf, "documents")
    return docs.select(
        F.col("source").alias("repo_id"),
        (F.col("doc_id") % 4).cast("int").alias("priority"),
        F.lit(2).alias("kind"),
        F.col("doc_id").alias("pos"),
        F.concat(F.lit("File: "), F.col("doc_id").cast("string")).alias("heading"),
        F.col("text").alias("content"),
        text.text_tokens(F.col("text")).alias("estimated_tokens"),
    )


@query
def digest_pack(spark: SparkSession, sf: str) -> DataFrame:
    return digest.pack_sections(document_sections(spark, sf), max_tokens=9000)


@query
def digest_pack_in_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """The same packing with every repository spread over many slices, as large ones are."""
    return digest.pack_sections(document_sections(spark, sf), max_tokens=9000, slices=40)


@query
def digest_totals(spark: SparkSession, sf: str) -> DataFrame:
    plan = document_sections(spark, sf)
    return digest.digest_totals(plan, digest.pack_sections(plan, max_tokens=9000))


@query
def digest_render(spark: SparkSession, sf: str) -> DataFrame:
    return digest.render(document_sections(spark, sf)).select("repo_id", "part", "text")


@query
def digest_build(spark: SparkSession, sf: str) -> DataFrame:
    """The whole digest of every repository under a tight budget."""
    files = code(spark, sf)
    sections, _ = digest.build_digest(
        files.select("repo_id").distinct(), manifest.manifest(files), files,
        structure.functions(structure.source_files(files)), view(spark, sf, "v_code_findings"), max_tokens=20_000,
    )
    return sections.select("repo_id", "priority", "kind", "pos", "heading", "estimated_tokens")


@query
def section_context(spark: SparkSession, sf: str) -> DataFrame:
    """First section whose heading contains a path, for the paths of files and their bare names."""
    found = view(spark, sf, "v_code_findings")
    headings = found.select(
        "repo_id", F.lit(2).alias("priority"), F.lit(2).alias("kind"), F.col("seq").alias("pos"),
        F.concat(F.lit("Finding Context: "), "vuln_type", F.lit(" in "), "file_path", F.lit(":"), "line_start").alias("heading"),
    )
    short = F.element_at(F.split("file_path", "/"), -1)
    wanted = found.select("repo_id", "file_path").unionByName(
        found.select("repo_id", F.regexp_replace(short, "^f[0-9]", "").alias("file_path"))
    ).unionByName(found.select("repo_id", F.concat(F.lit("in "), short).alias("file_path")))
    return context.first_section_containing(wanted.filter(F.col("file_path") != ""), headings).select("repo_id", "file_path", "pos")


# ---- Verdicts ---------------------------------------------------------------


@query
def json_extract(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "v_responses")
    rows = rows.withColumn("found", F.explode(F.array(replies.extract_json(F.col("content")))))
    found = F.col("found")
    return rows.select(
        "stage", "finding_id",
        F.coalesce(replies.is_object(found), F.lit(False)).alias("is_object"),
        F.when(replies.is_object(found), replies.text_field(found, "severity", None)).alias("severity"),
        F.when(replies.is_object(found), replies.text_field(found, "final_verdict", None)).alias("verdict"),
    )


def analyzed(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.analyzed(view(spark, sf, "v_event_findings"), view(spark, sf, "v_responses"))


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.apply_analysis(view(spark, sf, "v_event_findings"), view(spark, sf, "v_responses"))


def validated(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.apply_reviews(enriched(spark, sf), view(spark, sf, "v_responses"))


@query
def analysis_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return analyzed(spark, sf).select(
        "id", "outcome", "severity", F.round("cvss_estimate", 6).alias("cvss_estimate"), "reasoning", "taint_chain",
        "exploitability", "blast_radius", report.reachability(F.col("is_reachable")).alias("reachable"),
    )


@query
def analysis_counts(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.analysis_counts(analyzed(spark, sf))


@query
def severity_gate(spark: SparkSession, sf: str) -> DataFrame:
    gated = verdicts.severity_gate(enriched(spark, sf), STRICT)
    return gated.groupBy("repo_id", "severity").agg(F.count("*").alias("findings"))


@query
def review_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return validated(spark, sf).select(
        "id", "validation_status", "fp_argument", "fp_rebuttal", F.round("final_confidence", 6).alias("final_confidence"),
        report.confidence_band(F.col("final_confidence")).alias("band"),
    )


@query
def review_threshold(spark: SparkSession, sf: str) -> DataFrame:
    strict = verdicts.apply_reviews(enriched(spark, sf), view(spark, sf, "v_responses"), confidence_threshold=0.7)
    return verdicts.status_counts(strict)


@query
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.status_counts(validated(spark, sf))


@query
def token_usage(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.token_usage(view(spark, sf, "v_responses"), ["repo_id", "stage"])


@query
def missing_responses(spark: SparkSession, sf: str) -> DataFrame:
    answered = view(spark, sf, "v_responses").filter("success")
    return verdicts.missing_responses(view(spark, sf, "v_event_findings"), answered, "review")


@query
def raw_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Replies from API bodies, some without usage, some failed."""
    block = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("text"))
    body = F.to_json(
        F.struct(
            F.array(block("text", F.col("event_type")), block("tool_use", F.lit("skipped")), block("text", F.col("props"))).alias("content"),
            F.when(F.col("event_id") % 3 != 0, F.struct(F.col("user_id").alias("input_tokens"), F.lit(7).alias("output_tokens"))).alias("usage"),
        )
    )
    raw = table(spark, sf, "events").select(
        F.lit("r").alias("repo_id"), F.col("event_id").alias("finding_id"), F.lit("analyze").alias("stage"), body.alias("body"),
        F.when(F.col("event_id") % 5 == 0, "Rate limited").alias("error"), F.lit(1.0).alias("latency_ms"),
    )
    return response_source.responses(raw).select("finding_id", "content", "success", "input_tokens", "output_tokens")


def document_digest(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Findings of v_code and a digest for them, both with everything prompts need."""
    files = code(spark, sf)
    found = view(spark, sf, "v_code_findings").withColumns(
        {
            "detection_method": F.lit("semgrep"), "rule_id": F.lit(None).cast("string"),
            "message": F.concat(F.lit("found "), "vuln_type"), "code_snippet": F.lit("none"),
        }
    )
    functions = structure.functions(structure.source_files(files), exact_lines=True)
    sections = digest.structure_sections(files, manifest.manifest(files)).unionByName(
        digest.finding_sections(found, files, functions)
    )
    return found, sections


@query
def analysis_prompt(spark: SparkSession, sf: str) -> DataFrame:
    found, sections = document_digest(spark, sf)
    names = found.select("repo_id", F.concat(F.lit("owner/"), "repo_id").alias("repo_name")).distinct()
    return verdicts.analysis_prompts(found, skew.cut(sections), names)


@query
def review_prompt(spark: SparkSession, sf: str) -> DataFrame:
    found, sections = document_digest(spark, sf)
    judged = found.withColumns(
        {
            "severity": F.lit("high"), "cvss_estimate": F.lit(7.5), "reasoning": F.lit("because"),
            "taint_chain": F.lit(None).cast("string"), "exploitability": F.lit("likely"),
        }
    )
    return verdicts.review_prompts(judged, skew.cut(sections))


@query
def patch_prompt(spark: SparkSession, sf: str) -> DataFrame:
    found, _ = document_digest(spark, sf)
    judged = found.withColumns({"severity": F.lit("high"), "reasoning": F.lit("because"), "taint_chain": F.lit("a -> b")})
    return patches.patch_prompts(judged, code(spark, sf))


def patch_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every document patched with a new first line."""
    files = code(spark, sf)
    found = view(spark, sf, "v_code_findings")
    fixed = F.concat(F.lit("patched\n"), "content")
    reply = F.to_json(F.struct(fixed.alias("fixed_code"), F.lit("why").alias("explanation")))
    answers = files.select("repo_id", F.col("relative_path").alias("file_path"), reply.alias("content")).join(
        found.select("repo_id", "file_path", F.col("id").alias("finding_id")), ["repo_id", "file_path"]
    )
    answers = answers.withColumns({"stage": F.lit("patch"), "success": F.lit(True)})
    return patches.assemble_patches(found, answers, files)


@query
def patch_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """Every file patched; of the Python ones every second gets code that does not parse."""
    files = code(spark, sf)
    found = view(spark, sf, "v_code_findings")
    parses = F.when(F.length("content") % 2 == 0, "patched\nx = [1]\n").otherwise("patched\nx = [1\n")
    fixed = F.when(F.endswith("relative_path", F.lit(".py")), parses).otherwise(F.concat(F.lit("patched\n"), "content"))
    reply = F.to_json(F.struct(fixed.alias("fixed_code"), F.lit("why").alias("explanation")))
    answers = files.select("repo_id", F.col("relative_path").alias("file_path"), reply.alias("content")).join(
        found.select("repo_id", "file_path", F.col("id").alias("finding_id")), ["repo_id", "file_path"]
    )
    rows = patches.assemble_patches(found, answers.withColumns({"stage": F.lit("patch"), "success": F.lit(True)}), files)
    return rows.select(
        "repo_id", "finding_id", "explanation", F.element_at("files_modified", 1).alias("file"),
        F.substring_index("diff", "\n", 2).alias("header"),
        F.contains("diff", F.lit("\n+patched\n")).alias("adds_line"),
        "syntax_valid",
    )


@query
def patch_line_delta(spark: SparkSession, sf: str) -> DataFrame:
    return patches.line_delta(patch_rows(spark, sf))


# ---- Reports ----------------------------------------------------------------


def confirmed(spark: SparkSession, sf: str) -> DataFrame:
    """Written down once, as a scan does: every report reads it several times."""
    rows = skew.cut(verdicts.confirmed(verdicts.severity_gate(validated(spark, sf), RuleConfig())))
    return rows.withColumn("metadata", F.create_map(F.lit("rule"), F.col("rule_id")))


def event_patches(spark: SparkSession, sf: str) -> DataFrame:
    """Two patches for every event; the later one counts."""
    events = view(spark, sf, "v_event_findings")
    rows = events.select("repo_id", F.col("id").alias("finding_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
    return rows.select(
        "repo_id", "finding_id", F.concat(F.lit("+try "), F.col("seq").cast("string")).alias("diff"),
        F.lit("why").alias("explanation"), (F.col("seq") == 2).alias("syntax_valid"), F.array(F.lit("f.py")).alias("files_modified"), "seq",
    )


def results(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    found = view(spark, sf, "v_event_findings")
    summary = found.groupBy("repo_id").agg(
        F.countDistinct("file_path").alias("files_included"), F.sum("line_start").alias("total_lines")
    )
    return report.scan_results(repos(spark, sf), summary, found, rows, event_patches(spark, sf))


@query
def scan_result(spark: SparkSession, sf: str) -> DataFrame:
    return results(spark, sf, confirmed(spark, sf)).select(
        "repo_id", "repo_name", "files_analyzed", "total_lines", "raw_findings_count", "confirmed_count", "critical_count",
        "high_count", "patches_count", F.array_join("vuln_types", ",").alias("vuln_types"),
        F.array_join("severities", ",").alias("severities"), "executive_summary", "last_stage",
    )


@query
def sarif_rules(spark: SparkSession, sf: str) -> DataFrame:
    return report.sarif_rules(confirmed(spark, sf))


SARIF = (
    "`$schema` string, version string, runs array<struct<tool:struct<driver:struct<name:string, rules:array<struct<id:string,"
    "defaultConfiguration:struct<level:string>>>>>, results:array<struct<ruleId:string, level:string, message:struct<text:string>,"
    "locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>, region:struct<startLine:int,endLine:int>>>>,"
    "properties:struct<confidence:double,cvss:double,taintChain:string,validationStatus:string,fpArgument:string,patch:struct<diff:string>>>>>>"
)


@query
def sarif_results(spark: SparkSession, sf: str) -> DataFrame:
    """The SARIF documents, read back into one row per result."""
    rows = confirmed(spark, sf)
    logs = report.sarif_reports(results(spark, sf, rows), rows, event_patches(spark, sf), findings_per_part=300)
    runs = logs.select("repo_id", "part", "file_name", F.explode(F.from_json("report", SARIF)["runs"]).alias("run"))
    rows = runs.select("repo_id", "part", "file_name", F.size("run.tool.driver.rules").alias("rules"), F.explode("run.results").alias("r"))
    at = F.col("r.locations")[0]["physicalLocation"]
    return rows.select(
        "repo_id", "part", "file_name", "rules", "r.ruleId", "r.level", F.col("r.message.text").alias("text"),
        at["artifactLocation"]["uri"].alias("uri"), at["region"]["startLine"].alias("line"),
        F.round("r.properties.confidence", 6).alias("confidence"), F.col("r.properties.patch.diff").alias("diff"),
    )


@query
def json_findings(spark: SparkSession, sf: str) -> DataFrame:
    """The JSON reports, read back into counts and sums."""
    rows = confirmed(spark, sf)
    docs = report.json_reports(results(spark, sf, rows), rows, event_patches(spark, sf))
    read = documents.elements(docs)
    of = lambda member, schema: F.from_json(F.when(F.col("member").eqNullSafe(member), F.col("json")), schema)
    read = read.select(
        "repo_id", "part", "pos",
        of(None, "repo_name string, raw_findings_count bigint, executive_summary string").alias("d"),
        of("confirmed_findings", "enriched struct<raw:struct<id:string,line_start:bigint>,severity:string>, validation_status string").alias("f"),
        of("patches", "finding_id string").alias("p"),
    )
    is_finding, raw = F.col("f").isNotNull(), F.col("f.enriched.raw")
    return read.groupBy("repo_id", "part").agg(
        F.first("d", ignorenulls=True).alias("d"), F.count("f").alias("findings"), F.count("p").alias("patches"),
        F.coalesce(F.sum(raw["line_start"]), F.lit(0)).alias("lines"),
        F.min_by(raw["id"], F.when(is_finding, F.col("pos"))).alias("first_id"),
    ).select("d.repo_name", "part", "d.raw_findings_count", "findings", "patches", "lines", "first_id", "d.executive_summary")


@query
def text_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = confirmed(spark, sf)
    return report.text_reports(results(spark, sf, rows), rows)


@query
def findings_count(spark: SparkSession, sf: str) -> DataFrame:
    return confirmed(spark, sf).agg(F.count("*").alias("findings_count"))


# ---- Repositories -----------------------------------------------------------


def addresses(spark: SparkSession, sf: str) -> DataFrame:
    """Page addresses, most of them moved to the accepted host in one of its forms."""
    tail = F.regexp_replace("url", "^https?://[^/]*/", "")
    moved = F.concat(
        F.lit("  https://github.com/owner-"), F.col("page_id").cast("string"), F.lit("/"),
        F.regexp_extract(tail, "^([a-z]+)", 1), F.lit("."), F.col("page_id").cast("string"),
        F.when(F.col("page_id") % 4 == 0, ".git").when(F.col("page_id") % 4 == 1, "/").when(F.col("page_id") % 4 == 2, "/tree/feature/x/").otherwise("  "),
    )
    return table(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 5 == 0, F.col("url")).otherwise(moved).alias("url"))


@query
def repo_url_parse(spark: SparkSession, sf: str) -> DataFrame:
    accepted, rejected = repo_source.parsed_urls(addresses(spark, sf))
    none = F.lit(None).cast("string")
    rejected = rejected.select("page_id", none.alias("owner"), none.alias("repo"), none.alias("branch"), none.alias("repo_name"))
    return accepted.drop("url").unionByName(rejected)


@query
def repo_remote_name(spark: SparkSession, sf: str) -> DataFrame:
    remote = F.when(
        F.col("page_id") % 2 == 0, F.concat(F.lit("git@github.com:o/r"), F.col("page_id").cast("string"), F.lit(".git"))
    ).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", paths.repo_name(remote, F.lit("/work/checkout/")).alias("name"))


@query
def scan_end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    """A detection-only scan of every repository, limited to the changed files: all it finds, counted."""
    found = scan.detect(code(spark, sf), RuleConfig(), view(spark, sf, "v_changed"))

    def counted(rows: DataFrame, name: str, *sums: str) -> DataFrame:
        return rows.groupBy("repo_id").agg(F.count("*").alias(name), *[F.sum(c).alias(f"{name}_{c}") for c in sums])

    out = found.summary.select("repo_id", "files_included", "total_lines")
    by_type = found.findings.groupBy("repo_id").pivot("vuln_type", ["sqli", "hardcoded_secret", "xss"]).count()
    parts = [by_type, counted(found.functions, "functions", "line_start", "line_end"), counted(found.imports, "imports", "line"), counted(found.calls, "calls", "line")]
    for part in parts:
        out = out.join(part, "repo_id", "left")
    return out.na.fill(0)


@query
def large_file_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Rules on files of up to 1,500 bytes, and the files that this leaves out."""
    files = code(spark, sf)
    found = detection.detect(files, secret_patterns=[], max_bytes=1500)
    skipped = detection.skipped_files(files, max_bytes=1500)
    return found.select("repo_id", "file_path", "line_start", F.col("rule_id").alias("what")).unionByName(
        skipped.select("repo_id", F.col("path").alias("file_path"), F.lit(None).cast("int").alias("line_start"), F.col("reason").alias("what"))
    )


@query
def scanner_diff_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Results of an external scanner for every file, of which a diff scan keeps those in changed files."""
    files = code(spark, sf)
    at = view(spark, sf, "v_code_findings")
    result = F.struct(
        F.concat(F.lit("rules.xss-"), "id").alias("check_id"),
        F.concat(F.lit("/work/"), "file_path").alias("path"),
        F.struct(F.col("line_start").alias("line")).alias("start"),
        F.struct(F.lit("innerHTML").alias("message"), F.lit("ERROR").alias("severity")).alias("extra"),
    )
    docs = at.groupBy("repo_id").agg(F.to_json(F.struct(F.collect_list(result).alias("results"))).alias("document"))
    found = scanner.scanner_findings(scanner.scanner_results(docs), "/work")
    kept = scope.in_diff(found, scope.changed_paths(view(spark, sf, "v_changed")), "file_path")
    return findings.with_snippets(kept, files).select("repo_id", "file_path", "line_start", "line_end", "rule_id", "code_snippet")


@query
def rule_table_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A rule for every word that some document has before a comma: thousands of rules as data."""
    words = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(" [a-z]{4,},"), F.lit(0))).alias("needle")).distinct()
    languages = F.array(*[F.lit(x) for x in ("python", "javascript", "typescript", "go", "rust", "java")])
    rules_table = words.select(
        F.concat(F.lit("sqli-"), F.trim(F.translate("needle", ",", ""))).alias("rule_id"), languages.alias("languages"),
        F.concat("needle", F.lit("(?:[^,]|$)")).alias("regex"), F.lit("WARNING").alias("severity"), F.lit("a word").alias("message"), "needle",
    )
    found = rule_index.rule_findings(sources(spark, sf), rules_table)
    return found.select("repo_id", "file_path", "line_start", "rule_id", "vuln_type", "confidence")


@query
def file_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Every document written as a file of a tree, which is then listed and read as repositories."""
    files = view(spark, sf, "v_files")
    root = skew.checkpoint_path(spark)
    file_source.write_tree(files, root)
    read = file_source.read_trees(spark, root)
    return read.select("repo_id", "relative_path", F.md5(F.col("content").cast("binary")).alias("md5"), "size_bytes")


# ---- Limits, retries, odd input ---------------------------------------------


@query
def manifest_limit_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What a limit of seven files per repository leaves out."""
    files = code(spark, sf)
    return manifest.limit_counts(files, manifest.manifest(files, max_files=7))


def retried(spark: SparkSession, sf: str) -> DataFrame:
    """Every reply with a failed call of the same finding before and after it."""
    rows = view(spark, sf, "v_responses")
    failed = rows.withColumns({"success": F.lit(False), "content": F.lit("overloaded")})
    return failed.unionByName(rows).unionByName(failed)


@query
def retried_analysis(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.analyzed(view(spark, sf, "v_event_findings"), retried(spark, sf)).select(
        "id", "outcome", "severity", F.round("cvss_estimate", 6).alias("cvss_estimate"), "reasoning", "taint_chain",
        "exploitability", "blast_radius", report.reachability(F.col("is_reachable")).alias("reachable"),
    )


@query
def retried_review(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.status_counts(verdicts.apply_reviews(enriched(spark, sf), retried(spark, sf)))


@query
def json_lenient(spark: SparkSession, sf: str) -> DataFrame:
    """Replies that repeat a member and hold numbers that JSON has no word for."""
    replies.lenient(spark)
    odd = F.element_at(F.array(F.lit("NaN"), F.lit("Infinity"), F.lit("-Infinity")), (F.col("event_id") % 3 + 1).cast("int"))
    content = F.concat(
        F.lit('Sure: {"severity": "low", "severity": "'), "event_type", F.lit('", "cvss": '), odd, F.lit(', "note": "NaN, \\"-Infinity"}')
    )
    rows = table(spark, sf, "events").select("event_id", F.explode(F.array(replies.extract_json(content))).alias("found"))
    return rows.select("event_id", *[replies.text_field(F.col("found"), n, None).alias(n) for n in ("severity", "cvss", "note")])


@query
def scan_result_detection_only(spark: SparkSession, sf: str) -> DataFrame:
    """Results without verdicts, one repository without anything."""
    found = view(spark, sf, "v_event_findings")
    summary = found.groupBy("repo_id").agg(F.countDistinct("file_path").alias("files_included"), F.sum("line_start").alias("total_lines"))
    known = repos(spark, sf)
    known = known.unionByName(known.limit(1).withColumn("repo_id", F.lit("none")))
    return report.scan_results(known, summary, found).select(
        "repo_id", "files_analyzed", "raw_findings_count", "confirmed_count", "patches_count",
        F.array_join("vuln_types", ",").alias("vuln_types"), "executive_summary", "last_stage",
    )


@query
def scan_result_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Executive summaries from replies: r1 has none, r2 a failed one."""
    found, rows = view(spark, sf, "v_event_findings"), confirmed(spark, sf)
    asked = repos(spark, sf).filter("repo_id <> 'r1'").select(
        "repo_id", F.lit(None).cast("string").alias("finding_id"), F.lit("summary").alias("stage"),
        (F.col("repo_id") != "r2").alias("success"), F.concat(F.lit("All about "), "repo_id").alias("content"),
    )
    again = asked.withColumns({"success": F.lit(False), "content": F.lit("")})
    summary = found.groupBy("repo_id").agg(F.countDistinct("file_path").alias("files_included"), F.sum("line_start").alias("total_lines"))
    results = report.scan_results(repos(spark, sf), summary, found, rows, responses=asked.unionByName(again))
    return results.select("repo_id", "confirmed_count", "executive_summary")


def config_files(spark: SparkSession, sf: str) -> DataFrame:
    """A configuration per repository: one that turns a check off and names a day that does not exist, one with its own
    exclusions, one that is no YAML."""
    n = F.substring("repo_id", 4, 10).cast("int") % 3
    text = (
        F.when(n == 0, "checks: {sqli: false}\nsince: 2024-13-45\n")
        .when(n == 1, "exclude: {paths: [src/], patterns: []}\n")
        .otherwise("checks: [\n")
    )
    return view(spark, sf, "v_files").select("repo_id").distinct().select(
        "repo_id", F.lit(".vulnloom.yml").alias("relative_path"), text.alias("content")
    )


@query
def repo_config_filter(spark: SparkSession, sf: str) -> DataFrame:
    configs = repo_config.repo_configs(config_files(spark, sf))
    return repo_config.filter_findings(view(spark, sf, "v_code_findings"), configs, RuleConfig()).select("repo_id", "id")


@query
def config_rejects(spark: SparkSession, sf: str) -> DataFrame:
    rows = repo_config.config_rejects(config_files(spark, sf))
    return rows.select("repo_id", "path", "stage", (F.col("reason") != "").alias("explained"))


@query
def json_finding_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The product behind the JSON documents: a row per confirmed finding."""
    rows = report.json_rows(confirmed(spark, sf), event_patches(spark, sf))
    found = F.from_json("finding", "enriched struct<raw:struct<id:string,vuln_type:string>,severity:string>")
    rows = rows.select("repo_id", "seq", F.explode(F.array(found)).alias("f"), F.get_json_object("patch", "$.diff").alias("diff"))
    return rows.select("repo_id", "seq", F.col("f.enriched.raw.id").alias("id"), F.col("f.enriched.severity").alias("severity"), F.col("f.enriched.raw.vuln_type").alias("vuln_type"), "diff")
