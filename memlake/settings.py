"""Tunables and the route policy, validated before a job starts."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Route, retrieval multiplier, max keep, min score, neighbours before and after.
ROUTE_POLICY = [
    ("CHITCHAT", 0.0, 0, 0.0, 0, 0),
    ("DIRECT", 1.0, 12, 0.76, 0, 2),
    ("PROCEDURAL", 1.5, 16, 0.75, 1, 3),
    ("EXPLORATORY", 2.0, 20, 0.72, 1, 4),
    ("SYNTHESIS", 2.5, 24, 0.72, 2, 4),
    ("OTHER", 1.75, 10, 0.75, 1, 2),
]
POLICY_SCHEMA = "route string, retrieval_multiplier double, max_keep int, min_score double, expansion_before int, expansion_after int"
RESOLUTIONS = ("ignore", "answer_local", "answer_remote")


@dataclass(frozen=True)
class Settings:
    """Defaults of the lake."""

    chunk_size: int = 600
    chunk_overlap: int = 80
    base_top_k: int = 6
    pair_limit: int = 3
    message_limit: int = 6
    max_tokens_per_batch: int = 180_000
    max_file_bytes: int = 10 << 20
    max_batch_bytes: int = 50 << 20
    max_project_bytes: int = 500 << 20
    max_result_chars: int = 25_000
    similarity_threshold: int = 90
    dims: int = 64

    def __post_init__(self) -> None:
        if self.chunk_overlap < 0 or self.pair_limit < 0 or self.base_top_k < 0 or self.dims <= 0:
            raise ValueError("settings must not be negative")


def route_policy(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """The policy table (six rows, safe to broadcast); ranges are checked here."""
    rows = ROUTE_POLICY if rows is None else rows
    for route, factor, keep, score, before, after in rows:
        if factor < 0 or keep < 0 or not 0 <= score <= 1 or before < 0 or after < 0:
            raise ValueError(f"policy of {route} is out of range")
    if "OTHER" not in {r[0] for r in rows}:
        raise ValueError("a policy needs the route OTHER")
    return spark.createDataFrame(rows, POLICY_SCHEMA)


def policy_rows(table: DataFrame, route: str = "route", value: str = "value") -> DataFrame:
    """Policy columns from one JSON object a route, and ``problem``: what is missing or out of range, null if nothing."""
    from pyspark.sql import functions as F

    number = lambda path, kind: F.get_json_object(value, path).try_cast(kind)
    fields = {"retrieval_multiplier": ("$.retrieval_multiplier", "double"), "max_keep": ("$.max_keep", "int"), "min_score": ("$.min_score", "double"), "expansion_before": ("$.expansion.max_before", "int"), "expansion_after": ("$.expansion.max_after", "int")}
    rows = table.select(F.upper(F.trim(route)).alias("route"), *(number(p, k).alias(n) for n, (p, k) in fields.items()))
    tests = [F.when(F.col(n).isNull(), F.lit(f"{n} missing")).when(F.col(n) < 0, F.lit(f"{n} below 0")) for n in fields]
    return rows.withColumn("problem", F.coalesce(*tests, F.when(F.col("min_score") > 1, "min_score above 1")))


def load_policy(spark: SparkSession, path: str) -> DataFrame:
    """The route policy of a JSON file (one object, a route a key); what is wrong with it stops the job before it starts."""
    whole = [r.value for r in spark.read.text(path, wholetext=True).limit(2).collect()]  # one small file
    data = json.loads(whole[0]) if len(whole) == 1 else None
    if not isinstance(data, dict) or not all(isinstance(v, dict) for v in data.values()):
        raise ValueError(f"{path} is no object of routes")
    checked = policy_rows(spark.createDataFrame([(k, json.dumps(v)) for k, v in data.items()], "route string, value string")).collect()
    if bad := [f"{r.route}: {r.problem}" for r in checked if r.problem]:
        raise ValueError("; ".join(bad))
    return route_policy(spark, [tuple(r)[:6] for r in checked])


def load_rules(spark: SparkSession, *paths: str) -> dict[str, tuple[str, ...]]:
    """Rule lists ``front`` and ``end`` of JSON files, united in order; keys that begin with ``_comment`` are left out."""
    found: dict[str, dict[str, None]] = {}
    for path in paths:
        data = json.loads(spark.read.text(path, wholetext=True).first().value)
        if not isinstance(data, dict):
            raise ValueError(f"{path} is no object")
        for side, rules in data.items():
            if side.startswith("_comment"):
                continue
            prefixes = rules.get("prefixes") if isinstance(rules, dict) else None
            if side not in ("front", "end") or not isinstance(prefixes, list) or not all(isinstance(p, str) and p.strip() for p in prefixes):
                raise ValueError(f"{path}: {side} needs a list of prefixes")
            found.setdefault(side, {}).update(dict.fromkeys(prefixes))
    if not found:
        raise ValueError("no rules for front or end")
    return {side: tuple(rules) for side, rules in found.items()}
