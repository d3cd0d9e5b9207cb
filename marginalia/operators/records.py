"""Change records and evidence as JSON whose keys stand in a set order, nulls included."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fields of evidence and of a change record, in their order.
EVIDENCE = (
    "mentions", "unresolved", "literal_mismatch", "overlap", "signature_echo", "todo_tracker", "comment_age_days", "code_age_days", "code_newer_than_comment",
    "authored_by_agent", "agent", "unit_literal",
)
CHANGE = ("comment_new", "comment_modified", "scope_changed", "annotated_code_before", "changed_mentions")


def json_value(value: Column) -> Column:
    """A value's JSON text; null is ``null``."""
    whole = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def json_object(*objects: dict[str, Column], sort: bool = False) -> Column:
    """One object of several ones' fields (JSON texts): a key that an earlier one has wins; sorted by key if asked for."""
    fields: dict[str, Column] = {}
    for o in objects:
        for key, value in o.items():
            fields.setdefault(key, value)
    names = sorted(fields) if sort else list(fields)
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), fields[k]) for k in names]), F.lit("}"))


def change_record(tier: Column, before: Column, mentions: Column) -> Column:
    """struct of CHANGE; null for untouched items and without a change set. What the code was before is told for the
    second tier alone."""
    second = tier == "scope_changed"
    made = F.struct(
        (tier == "added").alias("comment_new"), (tier == "modified").alias("comment_modified"), second.alias("scope_changed"),
        F.when(second, before).alias("annotated_code_before"), F.when(second & before.isNotNull(), mentions).otherwise(F.array().cast("array<string>")).alias("changed_mentions"),
    )
    return F.when(tier.isNotNull() & (tier != "untouched"), made)


def evidence_json(row=F.col, change: Column | None = None) -> Column:
    """Evidence from columns named by EVIDENCE, in their order; with a change record the keys of all levels are sorted."""
    plain = {k: json_value(row(k)) for k in EVIDENCE}
    if change is None:
        return json_object(plain)
    mentions = F.transform(row("mentions"), lambda m: F.struct(m["resolved"].alias("resolved"), m["token"].alias("token")))
    record = json_object({k: json_value(change[k]) for k in CHANGE}, sort=True)
    merged = json_object(plain | {"mentions": json_value(mentions), "change": record}, sort=True)
    return F.when(change.isNull(), json_object(plain)).otherwise(merged)
