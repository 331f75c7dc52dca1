"""Decision log, explanations, audit reports and query-trace summaries."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.tables import table


def trace_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A natural-language query trace log derived from ``conversations``.

    Each user turn is a prompt; it took the model path when an assistant
    reply follows it (latency grows with reply length), else the fallback.
    """
    conv = table(spark, sf_dir, "conversations")
    u = conv.filter(F.col("role") == "user").alias("u")
    a = conv.filter(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("reply")).alias("a")
    j = u.join(a, (F.col("u.conv_id") == F.col("a.conv_id")) & (F.col("a.turn") == F.col("u.turn") + 1), "left")
    return j.select(
        F.concat(F.lit("trace_"), F.col("u.conv_id").cast("string"), F.lit("_"), F.col("u.turn").cast("string")).alias("trace_id"),
        F.col("u.text").alias("prompt"),
        F.when(F.col("reply").isNull(), "fallback").otherwise("llm").alias("path"),
        F.when(F.col("reply").isNull(), F.lit(0.0)).otherwise(F.length("reply").cast("double") / 250.0).alias("latency_seconds"),
        F.when(F.col("reply").isNull(), "no_response").otherwise("").alias("error"))


def query_trace_summary(traces: DataFrame) -> DataFrame:
    return traces.agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.count_if(F.col("path") == "llm").alias("llm_queries"),
        F.count_if(F.col("path") == "fallback").alias("fallback_queries"),
        F.round(F.coalesce(F.avg("latency_seconds"), F.lit(0.0)), 3).alias("avg_latency_seconds"),
        F.round(F.coalesce(F.max("latency_seconds"), F.lit(0.0)), 3).alias("max_latency_seconds"),
        F.count_if(F.col("error") != "").alias("error_count"))


# ---------------------------------------------------------------------------
# Decision log.  JSON is produced with keys in name order and numbers as
# fixed-scale decimals, so the text (and its hash) is engine independent.
from pyspark.sql import Column, Window  # noqa: E402

from ledgerlens.functions.columns import money_text, ts_text  # noqa: E402,F401

# Friendly names for explanation drivers (as in the reference).
FRIENDLY_NAMES = {
    "amount": "transaction amount",
    "distance_from_user_centroid_km": "distance from recent user locations",
    "user_txn_count_1h": "one-hour transaction velocity",
    "user_spend_24h": "24-hour spend",
    "devices_per_account": "number of devices seen on the account",
    "device_sharing_degree": "device sharing across users",
    "merchant_fraud_prevalence": "merchant fraud prevalence",
    "seconds_since_last_txn": "time since last transaction",
    "user_amount_zscore": "amount anomaly within user history",
    "is_new_device_for_user": "new device usage",
}
# Counterfactual rules (condition column, threshold, suggested action).
COUNTERFACTUAL_RULES = [
    ("is_new_device_for_user", 0.0, "use a previously seen device"),
    ("distance_from_user_centroid_km", 250.0, "transact closer to the user's normal locations"),
    ("user_txn_count_1h", 3.0, "reduce one-hour transaction velocity"),
    ("user_amount_zscore", 2.0, "lower the transaction amount toward the user's usual range"),
]
COUNTERFACTUAL_DEFAULT = "provide additional context for manual review"

PAYLOAD_FIELDS = ["account_id", "amount", "channel", "currency", "device_id", "lat", "lon", "mcc",
                  "merchant_id", "timestamp", "tx_id", "user_id"]


def _json_val(name: str) -> Column:
    c = F.col(name)
    if name == "amount":
        return c.cast("decimal(18,2)")
    if name in ("lat", "lon"):
        return c.cast("decimal(18,6)")
    if name == "timestamp":
        return ts_text(c)
    return c


def payload_struct() -> Column:
    return F.struct(*[_json_val(n).alias(n) for n in sorted(PAYLOAD_FIELDS)])


def prediction_struct() -> Column:
    return F.struct(F.col("score").cast("decimal(18,6)").alias("calibrated_probability"),
                    F.col("confidence").cast("decimal(18,6)").alias("confidence"),
                    F.col("confidence_band").alias("decision"), F.col("explanation").alias("explanation"),
                    F.col("raw_score").cast("decimal(18,6)").alias("raw_probability"))


def features_json(features: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(c).cast("decimal(18,6)").alias(c) for c in sorted(features)]), {"ignoreNullFields": "false"})


def replay_hash_col() -> Column:
    """sha256 of the stored fields a replay recomputes: scores, band, model and transaction id."""
    doc = F.struct(F.col("score").cast("decimal(18,6)").alias("calibrated_score"), F.col("confidence_band").alias("confidence_band"),
                   F.col("model_run_id").alias("model_type"), F.col("raw_score").cast("decimal(18,6)").alias("raw_score"),
                   F.col("tx_id").alias("tx_id"))
    return F.sha2(F.to_json(doc, {"ignoreNullFields": "false"}), 256)


def decision_hash_col() -> Column:
    """sha256 of the canonical JSON of run id + payload + prediction (keys sorted, nulls kept)."""
    doc = F.struct(F.col("model_run_id").alias("model_run_id"), payload_struct().alias("payload"),
                   prediction_struct().alias("prediction"))
    return F.sha2(F.to_json(doc, {"ignoreNullFields": "false"}), 256)


def percent_text(p: Column) -> Column:
    """``{p:.2%}`` computed on exact micro-units (half-up), e.g. 0.123456 -> '12.35%'."""
    centi = F.floor((F.round(p * 1_000_000).cast("long") + 50) / 100).cast("long")
    return F.concat((centi / 100).cast("long").cast("string"), F.lit("."),
                    F.lpad((centi % 100).cast("string"), 2, "0"), F.lit("%"))


def friendly(name: Column) -> Column:
    m = F.create_map(*[x for k, v in FRIENDLY_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, name), F.regexp_replace(name, "_", " "))


def top_drivers(df: DataFrame, features: list[str], k: int = 3, weights: dict[str, float] | None = None) -> Column:
    """Top-k (score desc, position desc) of |weight * value| (|value| without weights) -> feature names."""
    items = []
    for i, c in enumerate(features):
        w = (weights or {}).get(c)
        v = F.abs(F.col(c).cast("double") * F.lit(float(w))) if w is not None else F.abs(F.col(c).cast("double"))
        items.append(F.struct(v.alias("s"), F.lit(i).alias("pos"), F.lit(c).alias("name")))
    ranked = F.sort_array(F.array(*items), asc=False)
    return F.transform(F.slice(ranked, 1, k), lambda x: x["name"])


def counterfactual_text() -> Column:
    acts = F.array_compact(F.array(*[F.when(F.col(c) > F.lit(t), F.lit(a)) for c, t, a in COUNTERFACTUAL_RULES]))
    acts = F.when(F.size(acts) == 0, F.array(F.lit(COUNTERFACTUAL_DEFAULT))).otherwise(acts)
    return F.concat(F.lit("A lower-risk alternative would be to "), F.array_join(F.slice(acts, 1, 2), ", "), F.lit("."))


def explanation_text(band: Column, phrases: Column, prob: Column) -> Column:
    n = F.size(phrases)
    joined = F.when(n > 1, F.concat(F.array_join(F.slice(phrases, 1, n - 1), ", "), F.lit(", and "),
                                    F.element_at(phrases, -1))).otherwise(F.array_join(phrases, ", "))
    return F.concat(F.lit("This transaction was routed to "), band,
                    F.lit(" because the strongest signals were "), joined,
                    F.lit(". The calibrated fraud probability is "), percent_text(prob), F.lit("."))


def audit_markdown() -> Column:
    drivers = F.array_join(F.transform("top_drivers", lambda d: F.concat(F.lit("- "), d)), "\n")
    return F.concat_ws("\n",
                       F.concat(F.lit("# Audit Report: "), F.col("decision_id")), F.lit(""),
                       F.concat(F.lit("- Outcome: **"), F.col("confidence_band"), F.lit("**")),
                       F.concat(F.lit("- Confidence: **"), percent_text(F.col("confidence")), F.lit("**")),
                       F.concat(F.lit("- Calibrated fraud probability: **"), percent_text(F.col("score")), F.lit("**")),
                       F.lit(""), F.lit("## Top drivers"), drivers, F.lit(""), F.lit("## Explanation"),
                       F.col("explanation"), F.lit(""), F.lit("## Counterfactual summary"),
                       F.col("counterfactual_summary"), F.lit(""), F.lit("## Replay"),
                       F.concat(F.lit("`replay "), F.col("decision_id"), F.lit("`")))


def explained(scored: DataFrame, features: list[str]) -> DataFrame:
    """Add the top drivers (friendly names) and the explanation sentence."""
    d = scored.withColumn("top_drivers", F.transform(top_drivers(scored, features), friendly))
    return d.withColumn("explanation", explanation_text(F.col("confidence_band"), F.col("top_drivers"), F.col("score")))


def case_line(case: Column) -> Column:
    """A similar case as text: transaction, label, distance to three places."""
    distance = case["distance"].cast("decimal(18,6)").cast("decimal(18,3)").cast("string")
    return F.concat(case["tx_id"], F.lit(" | label="), case["label"].cast("string"), F.lit(" | distance="), distance)


def audit_reports(decisions: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Per explained decision: outcome, confidence, probability, counterfactual, replay instruction and markdown.

    ``cases(tx_id, nearest_similar_cases)``, see ``similar_cases``, adds the column and a section of the markdown;
    decisions without cases get an empty list and no section.
    """
    d = decisions.withColumns({
        "counterfactual_summary": counterfactual_text(),
        "replay_instructions": F.concat(F.lit("replay "), F.col("decision_id")),
    })
    d = d.withColumn("markdown", audit_markdown())
    if cases is None:
        return d
    known = cases.select(F.col("tx_id").alias("_tx"), F.col("nearest_similar_cases").alias("_cases"))
    none = F.array().cast(cases.schema["nearest_similar_cases"].dataType)
    d = d.join(known, F.col("tx_id") == F.col("_tx"), "left").withColumn("nearest_similar_cases", F.coalesce("_cases", none)).drop("_tx", "_cases")
    lines = F.array_join(F.transform("nearest_similar_cases", lambda x: F.concat(F.lit("- "), case_line(x))), "\n")
    section = F.concat(F.col("markdown"), F.lit("\n\n## Nearest similar prior cases\n"), lines)
    return d.withColumn("markdown", F.when(F.size("nearest_similar_cases") > 0, section).otherwise(F.col("markdown")))


def similar_cases(queries: DataFrame, reference: DataFrame, features: list[str], k: int = 3) -> DataFrame:
    """(tx_id, nearest_similar_cases): for every query row its ``k`` nearest reference rows by feature distance, as
    (tx_id, label, distance), the nearest first, ties to the smaller id.

    One batch search over all rows at once (``search.nearest_l2``: bounded cells, tiles opened by their distance).
    """
    from ledgerlens.operators.search import nearest_l2

    found = nearest_l2(queries, reference, features, k)
    case = F.struct(F.col("ref_id").alias("tx_id"), "label", "distance").alias("case")
    lists = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", case))).alias("_l"))  # k rows a query
    return lists.select(F.col("query_id").alias("tx_id"), F.transform("_l", lambda x: x["case"]).alias("nearest_similar_cases"))


def report_columns() -> list[Column]:
    return [F.col("decision_id"), F.col("confidence_band").alias("decision_outcome"),
            F.col("confidence").cast("decimal(18,6)").alias("confidence"), F.col("score").cast("decimal(18,6)").alias("fraud_probability"),
            *[F.col(c) for c in ("top_drivers", "explanation", "counterfactual_summary", "replay_instructions", "markdown")]]


# Redaction -----------------------------------------------------------------
# Identifier patterns and field names redacted from reports.
PII_PATTERNS = [r"U_\d{6}", r"D_\d{6}", r"A_\d{6}", r'"lat":\s*[\d.-]+', r'"lon":\s*[\d.-]+']
REDACT_FIELDS = ["user_id", "device_id", "account_id", "lat", "lon"]
REDACTED = "[REDACTED]"


def redact_text(c: Column) -> Column:
    for pat in PII_PATTERNS:
        c = F.regexp_replace(c, pat, REDACTED)
    return c


def _redacted(value: Column, kind, name: str | None) -> Column:
    if name in REDACT_FIELDS:
        return F.lit(REDACTED)
    if kind.typeName() == "string":
        return redact_text(value)
    if kind.typeName() == "struct":
        inner = F.struct(*[_redacted(value[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields])
        return F.when(value.isNull(), F.lit(None)).otherwise(inner)
    if kind.typeName() == "array":
        return F.transform(value, lambda x: _redacted(x, kind.elementType, None))
    if kind.typeName() == "map" and kind.keyType.typeName() == "string":
        mark = F.lit(REDACTED if kind.valueType.typeName() == "string" else None)  # other types cannot hold the mark
        return F.transform_values(value, lambda k, v: F.when(k.isin(REDACT_FIELDS), mark).otherwise(_redacted(v, kind.valueType, None)))
    return value


def redact_struct(df: DataFrame, col: str) -> Column:
    """Replace listed keys at any depth by ``[REDACTED]`` and regex-redact all strings (in structs, maps and lists of lists)."""
    return _redacted(F.col(col), df.schema[col].dataType, None)


class _Object(list):
    """A JSON object as its pairs: repeated keys stay."""


class _Number(str):
    """A JSON number as it was written."""


def redact_document(text: str | None, fields: frozenset, patterns: list) -> str | None:
    """One JSON text of any shape, redacted at every depth; see ``redact_json``."""
    def plain(value: str) -> str:
        for p in patterns:
            value = p.sub(REDACTED, value)
        return value

    def walk(v) -> str:
        if isinstance(v, _Object):
            return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{mark if k in fields else walk(x)}" for k, x in v) + "}"
        if isinstance(v, list):
            return "[" + ",".join(map(walk, v)) + "]"
        if isinstance(v, _Number):
            return v
        return json.dumps(plain(v) if isinstance(v, str) else v, ensure_ascii=False)

    if text is None:
        return None
    mark = json.dumps(REDACTED)
    try:
        return walk(json.loads(text, object_pairs_hook=_Object, parse_float=_Number, parse_int=_Number, parse_constant=_Number))
    except RecursionError:
        return mark
    except ValueError:
        return plain(text)


def redact_json(column: Column) -> Column:
    """Redaction of stored JSON whose shape nobody declared: objects, lists and lists of lists at any depth.

    Values of the listed keys become ``[REDACTED]`` whatever they are, strings are redacted by the patterns, numbers keep
    their digits, white space between values goes.  Text that is no JSON is redacted as text; JSON nested deeper than
    Python's stack is replaced whole.  Nulls stay null.  Runs in Arrow batches: no expression walks unknown keys.
    """
    fields, patterns = frozenset(REDACT_FIELDS), [re.compile(p, re.ASCII) for p in PII_PATTERNS]

    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        return pd.Series([redact_document(t, fields, patterns) for t in texts], dtype=object)

    return redact(column)
