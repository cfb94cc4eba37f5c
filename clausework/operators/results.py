"""Results and history (H-1 to H-16): counts, summaries, feeds, retention and transcripts."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausework.functions.dialect import SPARK
from clausework.operators.classify import validate_responses

SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
#: Terms that are highlighted.
TERMS = {
    "indemnify": r"(?i)\bindemnif(?:y|ies|ication)\b", "perpetual": r"(?i)\bperpetual\b", "unlimited liability": r"(?i)\bunlimited liability\b", "termination": r"(?i)\btermination\b",
    "exclusive jurisdiction": r"(?i)\bexclusive jurisdiction\b", "confidentiality survives": r"(?i)\bconfidentiality survives\b", "force majeure": r"(?i)\bforce majeure\b",
    "limitation of liability": r"(?i)\blimitation of liability\b", "governing law": r"(?i)\bgoverning law\b", "arbitration": r"(?i)\barbitration\b",
}


def severity_counts(issues: DataFrame) -> DataFrame:
    """H-1: findings of each document by severity, others as UNRATED."""
    named = issues.withColumn("s", F.when(F.col("severity").isin(*SEVERITIES), F.col("severity")).otherwise("UNRATED"))
    return named.groupBy("doc_id").pivot("s", [*SEVERITIES, "UNRATED"]).agg(F.count(F.lit(1))).na.fill(0)


def category_counts(issues: DataFrame) -> DataFrame:
    """H-1: findings of each document by category, blank ones as Uncategorized."""
    named = F.when(F.coalesce(F.trim("category"), F.lit("")) == "", "Uncategorized").otherwise(F.col("category"))
    return issues.groupBy("doc_id", named.alias("category")).agg(F.count("*").alias("n"))


def risk_level(issues: DataFrame, confidence: DataFrame) -> DataFrame:
    """H-2: SAFE, LOW_RISK, MODERATE_RISK or HIGH_RISK of every document of ``confidence`` (doc_id, score; null counts as 0).

    Critical and high findings are high risk, but moderate under a confidence of 0.45; medium ones are moderate, low ones
    low. A finding with contradiction_detected makes the first two high and the last moderate. Unrated findings are safe.
    """
    n = lambda *levels: F.count_if(F.col("severity").isin(*levels))
    seen = issues.groupBy("doc_id").agg(n("HIGH", "CRITICAL").alias("high"), n("MEDIUM").alias("medium"), n("LOW").alias("low"), F.coalesce(F.max("contradiction_detected"), F.lit(False)).alias("clash"))
    level = F.expr("""case when high > 0 then if(clash or coalesce(score, 0) >= 0.45, 'HIGH_RISK', 'MODERATE_RISK') when medium > 0 then if(clash, 'HIGH_RISK', 'MODERATE_RISK')
      when low > 0 then if(clash, 'MODERATE_RISK', 'LOW_RISK') else 'SAFE' end""")
    return confidence.join(seen, "doc_id", "left").select("doc_id", level.alias("risk_level"))


def document_summary(issues: DataFrame, risk: DataFrame, k: int = 5) -> DataFrame:
    """H-3: for every document of ``risk`` (doc_id, risk_level) one line, and up to k key findings.

    Key findings are contradictions by category, titles of critical and high findings, then each other category that no
    finding so far names, in the order of issue_no. A document's findings stay in one row: they are a list to show.
    """
    item = F.struct("issue_no", F.coalesce("issue_title", F.lit("")).alias("title"), F.coalesce("severity", F.lit("")).alias("severity"), F.coalesce("category", F.lit("")).alias("category"), F.coalesce("contradiction_detected", F.lit(False)).alias("clash"))
    lists = issues.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("f"))
    rows = risk.join(lists, "doc_id", "left").withColumn("f", F.expr("coalesce(f, array())"))
    rows = rows.withColumns({"severe": F.expr("filter(f, x -> x.severity in ('HIGH', 'CRITICAL'))"), "categories": F.expr("array_distinct(transform(f, x -> x.category))")})
    clashes = "transform(filter(f, x -> x.clash), x -> concat('Contradictory ', lower(x.category), ' clauses found'))"
    titles = "filter(transform(severe, x -> case when x.title = '' or endswith(x.title, 'detected') or endswith(x.title, 'found') then x.title else concat(x.title, ' detected') end), t -> t <> '')"
    named = "exists(acc, t -> contains(lower(t), lower(c)))"
    told = "case when size(filter(f, x -> x.category = c)) > 1 then concat('Multiple ', lower(c), ' issues found') else concat(c, ' concern identified') end"
    key = f"slice(aggregate(categories, array_distinct(concat({clashes}, {titles})), (acc, c) -> if({named}, acc, concat(acc, array({told})))), 1, {k})"
    line = """case when size(f) = 0 then 'No compliance issues detected in this document.'
      when risk_level = 'HIGH_RISK' and size(severe) > 0 then concat('High-risk ', lower(severe[0].category), ' and other critical concerns detected.')
      when risk_level = 'MODERATE_RISK' then concat(array_join(slice(categories, 1, 2), ' and '), ' concerns found. Review recommended before signing.')
      when risk_level = 'LOW_RISK' then 'Minor compliance observations. Document is generally sound.' else 'Document appears compliant. No significant issues found.' end"""
    return rows.select("doc_id", F.expr(line).alias("summary"), F.expr(f"array_join({key}, '; ')").alias("key_findings"))


def term_hits(docs: DataFrame) -> DataFrame:
    """H-4: occurrences of the highlighted terms, (doc_id, term, n) for terms that occur."""
    wide = docs.select("doc_id", *[F.expr(SPARK.count("coalesce(text, '')", p)).alias(t) for t, p in TERMS.items()])
    return wide.unpivot("doc_id", [F.col(f"`{t}`") for t in TERMS], "term", "n").where("n > 0")


#: What is said where a document is not audited.
MESSAGES = {
    "non_legal": "This document does not appear to be a legal contract or agreement and has been flagged as non-contract content: {}. Only contractual documents are processed through the legal-risk audit pipeline.",
    "suppressed": "Document quality too degraded for reliable legal analysis.",
    "unreadable": "Document quality appears degraded or corrupted. Results may be unreliable.",
}
ISSUE_FIELDS = ("issue_no", "issue_title", "severity", "category", "location", "quoted_text", "risk_explanation", "suggested_improvement")


def build_results(docs: DataFrame, issues: DataFrame, model: str = "model") -> DataFrame:
    """H-5: one JSON payload for each routed document (doc_id, route).

    Audits hold their findings in order; policies their type and explanation; non-legal texts their content type and its
    explanation; other routes a message and a failed parse. Columns of ``docs`` that are there (confidence_score,
    confidence_label, policy_type, policy_explanation, policy_confidence, content_type, content_explanation,
    domain_confidence, refusal_message) go in, also as metadata; a refusal_message stands instead of everything.
    """
    has = lambda c: F.col(c) if c in docs.columns else F.lit(None).cast("string")
    lists = issues.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*ISSUE_FIELDS))).alias("issues"))
    none = F.expr("cast(array() as array<struct<issue_no:int,issue_title:string,severity:string,category:string,location:string,quoted_text:string,risk_explanation:string,suggested_improvement:string>>)")
    joined = docs.join(lists, "doc_id", "left").withColumn("_audit", F.col("route") == "audit").withColumn("issues", F.when(F.col("_audit"), F.coalesce("issues", none)).otherwise(none))
    text = F.when(F.col("route") == "non_legal", F.concat(F.lit(MESSAGES["non_legal"].split("{}")[0]), F.coalesce(has("content_type"), F.lit("Uncategorized Non-Legal")), F.lit(MESSAGES["non_legal"].split("{}")[1])))
    text = text.when(F.col("route") == "suppressed", MESSAGES["suppressed"]).when(F.col("route") == "unreadable", MESSAGES["unreadable"]).otherwise("")
    kind = F.when(has("refusal_message").isNotNull(), "refusal").when(F.col("route").isin("policy", "non_legal"), F.col("route")).otherwise("audit")
    extra = [c for c in ("policy_type", "policy_explanation", "policy_confidence", "content_type", "content_explanation", "domain_confidence") if c in docs.columns]
    pairs = [x for c in ("route", *extra) for x in (F.lit(c), F.col(c).cast("string"))]
    metadata = F.map_filter(F.create_map(F.lit("model_name"), F.lit(model), *pairs), lambda _, v: v.isNotNull())
    payload = F.to_json(
        F.struct(
            has("refusal_message").isNull().alias("success"), F.lit(model).alias("model"), F.lit("AUDIT").alias("mode"), kind.alias("response_type"), F.lit(1).alias("schema_version"),
            F.size("issues").alias("issue_count"), "issues", F.col("route").isin("suppressed", "unreadable").alias("structured_parse_failed"), F.coalesce(has("refusal_message"), text).alias("legacy_text"),
            *[F.col(c) for c in ("confidence_score", "confidence_label") if c in docs.columns], metadata.alias("metadata"),
        )
    )
    return joined.select("doc_id", "route", payload.alias("payload"))


def span_starts(day: date) -> tuple[date, date, date]:
    """The first dates of the spans that a folder of a dated table with this day may hold: the day, its month, its year."""
    return day, day.replace(day=1), day.replace(month=1, day=1)


def within(history: DataFrame, since: datetime | None, until: datetime | None) -> DataFrame:
    """Records of a time span; where the table is laid out by ``date`` (of the day, or the first of its month or year), the span's dates are told to the scan, which a bound on ``ts`` alone is not."""
    dated = "date" in history.columns
    if since is not None:
        day, month, year = map(F.lit, span_starts(since.date()))
        held = (F.col("date") >= year) & ((F.col("date") >= day) | F.col("date").isin(month, year)) if dated else F.lit(True)
        history = history.where((F.col("ts") >= F.lit(since)) & held)
    if until is not None:
        history = history.where((F.col("ts") <= F.lit(until)) & (F.col("date") <= F.lit(until.date()) if dated else F.lit(True)))
    return history


def filter_history(history: DataFrame, filename: str | None = None, mode: str | None = None, severity: str | None = None, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """H-6: records by part of the file name, mode, severity and time; filters reach the scan, dates as partition filters.

    Audits in ADVISORY mode belong to the sessions and are left out; so are all ADVISORY rows of a table without record_type.
    """
    audit = F.col("record_type") == "audit" if "record_type" in history.columns else F.lit(True)
    history = history.where(~(audit & (F.coalesce("mode", F.lit("")) == "ADVISORY")))
    tests = [F.col("filename").contains(filename) if filename else None, F.col("mode") == mode if mode else None, F.col("severity_level") == severity if severity else None]
    for test in tests:
        history = history.where(test) if test is not None else history
    return within(history, since, until)


#: Which kinds of records a mode shows.
KINDS_OF_MODE = {"AUDIT": ("audit",), "REDACTION": ("audit", "redaction"), "ADVISORY": ("advisory",)}


def history_feed(audits: DataFrame, redactions: DataFrame, sessions: DataFrame, record_type: str = "all", mode: str | None = None) -> DataFrame:
    """H-7: the chosen kinds of records under the same columns.

    ``record_type`` chooses one kind; with "all" a ``mode`` chooses: AUDIT audits, REDACTION audits and redactions, ADVISORY
    sessions, another one nothing. Audits are those of the mode where one is given, and never ADVISORY ones.
    """
    parts = {"audit": audits, "redaction": redactions, "advisory": sessions}
    wanted = (record_type,) if record_type != "all" else KINDS_OF_MODE.get(mode.upper(), ()) if mode else tuple(parts)
    if "mode" in audits.columns:
        parts["audit"] = audits.where(F.coalesce("mode", F.lit("")) != "ADVISORY")
        parts["audit"] = parts["audit"].where(F.col("mode") == mode) if mode else parts["audit"]
    shown = {k: df.select("id", F.lit(k).alias("record_type"), "filename", "ts", "item_count") for k, df in parts.items()}
    chosen = [df for k, df in shown.items() if k in wanted] or [shown["audit"].where(F.lit(False))]
    out = chosen[0]
    for df in chosen[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def page(feed: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """H-8: a page of the newest records; ties by kind and falling id. A limit of 1 to 100 is the feature. For deep pages see ``page_after``."""
    return feed.orderBy(F.col("ts").desc(), "record_type", F.col("id").desc()).offset(offset).limit(min(100, max(1, limit)))


def page_after(feed: DataFrame, cursor: tuple[datetime, str, int] | None, limit: int = 20) -> DataFrame:
    """H-8: the page behind a record (its ts, record_type and id), in the order of ``page``; the first one without a cursor.

    The cursor is a filter on the scan, on the dates of a dated table too, so that any page costs a limit and no offset.
    Records without a time come last in ``page`` and have no cursor here.
    """
    if cursor is not None:
        ts, kind, record = cursor
        feed = within(feed, None, ts).where((F.col("ts") < F.lit(ts)) | (F.col("record_type") > kind) | ((F.col("record_type") == kind) & (F.col("id") < record)))
    return page(feed.where("ts is not null"), limit)


def get_record(feed: DataFrame, record_type: str, record_id: int) -> DataFrame:
    """H-9: one record."""
    return feed.where((F.col("record_type") == record_type) & (F.col("id") == record_id))


def delete_records(feed: DataFrame, keys: DataFrame) -> DataFrame:
    """H-9: the records that remain without ``keys`` (record_type, id)."""
    return feed.join(keys, ["record_type", "id"], "left_anti")


def retain(feed: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """H-10: records of the last ``days`` days before ``now``; null times go."""
    return feed.where(F.col("ts") >= now - F.expr(f"interval {days} days"))


def retention_report(feed: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """H-10: kept and deleted records of each kind."""
    keep = F.coalesce(F.col("ts") >= now - F.expr(f"interval {days} days"), F.lit(False))
    return feed.groupBy("record_type").agg(F.count_if(keep).alias("n_kept"), F.count_if(~keep).alias("n_deleted"))


def activity_summary(feed: DataFrame) -> DataFrame:
    """H-11: totals over all records, in one pass."""
    kind = lambda k: F.col("record_type") == k
    items = lambda k: F.coalesce(F.sum(F.when(kind(k), F.col("item_count"))), F.lit(0)).cast("long")
    return feed.agg(F.count_if(kind("audit")).alias("total_audits"), F.count_if(kind("redaction")).alias("total_redactions"), F.count_if(kind("advisory")).alias("total_sessions"), items("audit").alias("total_findings"), items("redaction").alias("total_entities"), F.count("*").alias("total_activities"))


def latest_per_mode(feed: DataFrame) -> DataFrame:
    """H-12: the newest record of each mode; partial maxima before the shuffle."""
    return feed.groupBy("mode").agg(F.max(F.struct("ts", "id", "filename")).alias("m")).select("mode", "m.id", "m.filename", "m.ts")


def recent_confidence(feed: DataFrame, n: int = 20) -> DataFrame:
    """H-13: mean confidence of the newest n records as a percentage; records without one count for n but not for the mean."""
    newest = feed.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(n)
    return newest.agg(F.round(F.avg("confidence") * 100, 0).cast("long").alias("percent"), F.count("confidence").alias("n_scored"))


def iso_timestamp(feed: DataFrame, column: str = "ts") -> DataFrame:
    """H-14: times as ISO-8601 text in UTC."""
    return feed.withColumn("iso", F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def transcripts(turns: DataFrame) -> DataFrame:
    """H-15: a conversation (conv_id, turn, role, text) as lines "User: ..." and "Assistant: ..." in order of turns."""
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.coalesce("text", F.lit("")))
    lists = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return lists.select("conv_id", F.array_join(F.expr("transform(l, x -> x.line)"), "\n").alias("transcript"))


def session_history(turns: DataFrame) -> DataFrame:
    """H-16: exchanges of a user's turn and the assistant's next, both not blank and the answer without a violation (P-6), by conversation:
    (conv_id, n_exchanges, first_turn, last_turn, exchanges), the exchanges in order as user and assistant."""
    w = W.partitionBy("conv_id").orderBy("turn")
    pairs = turns.withColumn("next_role", F.lead("role").over(w)).withColumn("response", F.lead("text").over(w))
    valid = pairs.where("role = 'user' and next_role = 'assistant' and trim(coalesce(text, '')) <> '' and trim(coalesce(response, '')) <> ''")
    checked = validate_responses(valid.select("conv_id", "turn", F.col("text").alias("query"), "response")).where("is_valid")
    lists = checked.groupBy("conv_id").agg(F.count("*").alias("n_exchanges"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.array_sort(F.collect_list(F.struct("turn", F.col("query").alias("user"), F.col("response").alias("assistant")))).alias("e"))
    return lists.withColumn("exchanges", F.expr("transform(e, x -> named_struct('user', x.user, 'assistant', x.assistant))")).drop("e")
