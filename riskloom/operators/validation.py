"""Record validation: parse, check every field, split valid rows from rejects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import text
from riskloom.functions.nulls import col, is_true
from riskloom.functions.scalars import GRANTED, REFUSED
from riskloom.schemas import EXTRAS, REJECTED, REQUEST_RULES, SUCCESS, Rule


def _parsed(rule: Rule, raw: str) -> str:
    """Text to the rule's type; '12.0' is a whole number, '12.5' is not."""
    real = f"try_cast({raw} AS DOUBLE)"
    if rule.kind == "int":
        whole = f"CASE WHEN {real} = floor({real}) THEN try_cast({real} AS BIGINT) END"
        return f"coalesce(try_cast({raw} AS BIGINT), {whole})"
    return real if rule.kind == "float" else raw


def field_error(rule: Rule, raw: str, present: str) -> str:
    """SQL text of the first error of one field as ``type:field``, or NULL. ``raw`` is the
    text of the field, ``present`` whether the record names it at all."""

    def error(kind: str) -> str:
        return text.value(f"{kind}:{rule.name}")

    empty = {"int": "int_type", "float": "float_type", "choice": "literal_error"}.get(rule.kind, "string_type")
    absent = f"CASE WHEN {present} THEN {error(empty)} ELSE {error('missing')} END" if rule.required else "NULL"
    parsed = _parsed(rule, raw)
    checks = [(f"{raw} IS NULL", absent)]
    if rule.kind == "int":
        checks.append((f"{parsed} IS NULL AND try_cast({raw} AS DOUBLE) IS NOT NULL", error("int_from_float")))
        checks.append((f"{parsed} IS NULL", error("int_parsing")))
    if rule.kind == "float":
        checks.append((f"{parsed} IS NULL", error("float_parsing")))
    if rule.kind == "choice":
        choices = ", ".join(text.value(c) for c in rule.choices)
        checks.append((f"{raw} NOT IN ({choices})", error("literal_error")))
    if rule.gt is not None:
        checks.append((f"NOT {parsed} > {text.value(rule.gt)}", error("greater_than")))
    if rule.ge is not None:
        checks.append((f"NOT {parsed} >= {text.value(rule.ge)}", error("greater_than_equal")))
    if rule.le is not None:
        checks.append((f"NOT {parsed} <= {text.value(rule.le)}", error("less_than_equal")))
    return "CASE " + " ".join(f"WHEN {c} THEN {e}" for c, e in checks) + " END"


def _found(checks: Sequence[str]) -> str:
    return f"filter(array({', '.join(checks)}), e -> e IS NOT NULL)"


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row. A plain projection would be copied into
    every filter and column built on it, and with it the parsing of the whole record."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def validate_json(df: DataFrame, body: str, rules: Sequence[Rule] = REQUEST_RULES) -> DataFrame:
    """Check a JSON object column against the rules.

    Adds ``record`` (typed fields), ``extras`` (further fields as text), ``errors`` (all, in
    field order), ``error_type`` (the first) and ``status``. Every row comes out, valid or not.
    """
    texts = T.StructType([T.StructField(n, T.StringType()) for n in [*(r.name for r in rules), EXTRAS]])
    parse = F.struct(F.from_json(col(body), texts).alias("f"), F.json_object_keys(col(body)).alias("keys"))
    parsed = _once(df, "in_", parse)
    raw = {r.name: f"in_.f.{text.name(r.name)}" for r in rules}
    checks = [field_error(r, raw[r.name], f"array_contains(in_.keys, {text.value(r.name)})") for r in rules]
    broken = f"CASE WHEN try_parse_json({text.name(body)}) IS NULL THEN 'json_invalid' ELSE 'model_attributes_type' END"
    checked = _once(parsed, "errors", F.expr(f"CASE WHEN in_.keys IS NULL THEN array({broken}) ELSE {_found(checks)} END"))
    fields = ", ".join(f"{text.value(r.name)}, {_parsed(r, raw[r.name])}" for r in rules)
    extras = f"from_json(in_.f.{text.name(EXTRAS)}, 'map<string,string>')"
    return checked.withColumns(
        {
            "record": F.expr(f"named_struct({fields})"),
            "extras": F.expr(f"coalesce({extras}, CAST(map() AS MAP<STRING, STRING>))"),
            **_verdict(),
        }
    ).drop("in_")


def _verdict() -> dict[str, Column]:
    return {
        "error_type": F.expr("get(errors, 0)"),
        "status": F.expr(f"CASE WHEN size(errors) = 0 THEN {text.value(SUCCESS)} ELSE {text.value(REJECTED)} END"),
    }


def validate_columns(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The same checks on a table whose columns already carry the fields; a missing value in
    a required field is an absent field."""
    checks = [field_error(r, f"CAST({text.name(r.name)} AS STRING)", "false") for r in rules]
    return _once(df, "errors", F.expr(_found(checks))).withColumns(_verdict())


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid and rejected rows of one checked frame."""
    return checked.where(F.col("status") == SUCCESS), checked.where(F.col("status") == REJECTED)


def flatten_record(valid: DataFrame, contract: T.StructType, keep: Sequence[str] = ()) -> DataFrame:
    """One row per record in the contract's columns. Further fields are merged flat and win
    over a field of the same name."""
    names = set(valid.schema["record"].dataType.names)
    out = [text.name(k) for k in keep]
    for f in contract:
        kind = f.dataType.simpleString()
        own = f"CAST(record.{text.name(f.name)} AS {kind})" if f.name in names else "NULL"
        extra = f"try_cast(extras[{text.value(f.name)}] AS {kind})"
        given = f"map_contains_key(extras, {text.value(f.name)})"
        out.append(f"CASE WHEN {given} THEN {extra} ELSE {own} END AS {text.name(f.name)}")
    return valid.selectExpr(*out)


def error_counts(checked: DataFrame) -> DataFrame:
    """How often each first error occurs."""
    return (
        checked.where(F.col("error_type").isNotNull())
        .groupBy("status", "error_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "error_type")
    )


def reject_rows(rejected: DataFrame, body: str, key: str = "SK_ID_CURR") -> DataFrame:
    """Log fields of rejected records; the raw body is kept, an unreadable one becomes {}."""
    own = rejected.schema["record"].dataType.names
    return rejected.select(
        *[c for c in rejected.columns if c not in ("record", "extras", "errors", "error_type", "status", body)],
        (F.col("record").getField(key) if key in own else F.lit(None)).cast("long").alias("sk_id_curr"),
        "status",
        "error_type",
        F.when(F.json_object_keys(col(body)).isNotNull(), col(body)).otherwise(F.lit("{}")).alias("features"),
    )


def bad_outputs(scored: DataFrame, probability: str = "probability", decision: str = "decision") -> DataFrame:
    """Scored rows that break the output contract: probability in [0, 1], known decision."""
    p_ok = is_true((col(probability) >= 0) & (col(probability) <= 1))
    d_ok = is_true(col(decision).isin(REFUSED, GRANTED))
    return scored.where(~(p_ok & d_ok))
