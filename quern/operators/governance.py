"""Governance of held-out evaluation: hashes, drift, quota, the decision ladder, the access log."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import fresh

ARTIFACTS = ("governance_config_hash", "manifest_hash", "model_hash", "label_mapping_hash")
#: Keys that a config must have.
REQUIRED = ("held_out_splits", "max_heldout_evals_per_day", "selection_metric")


@dataclass
class Config:
    held_out_splits: list[str]
    max_heldout_evals_per_day: int
    selection_metric: str
    require_manifest: bool = True
    require_label_mapping_hash: bool = True
    require_split_policy_frozen: bool = True
    more: dict = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Config:
        data = json.loads(text)
        if missing := sorted(set(REQUIRED) - set(data)):
            raise ValueError(f"config lacks {missing}")
        known = {k: v for k, v in data.items() if k in cls.__dataclass_fields__ and k != "more"}
        return cls(**known, more={k: v for k, v in data.items() if k not in known})


def label_mapping(text: str) -> dict[str, int]:
    """A validated mapping: a non-empty object of names to distinct whole numbers."""
    data = json.loads(text)
    if not isinstance(data, dict) or not data:
        raise ValueError("a label mapping is a non-empty object")
    if any(isinstance(v, bool) or not isinstance(v, int) for v in data.values()):
        raise ValueError("labels are whole numbers")
    if len(set(data.values())) != len(data):
        raise ValueError("labels must differ")
    return data


def mapping_hash(mapping: dict[str, int]) -> str:
    return hashlib.sha256(json.dumps(mapping, sort_keys=True).encode()).hexdigest()


def file_hashes(files: DataFrame) -> DataFrame:
    """(path, sha256) of a binaryFile frame."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


#: How reasons call the artifacts.
ARTIFACT_NAMES = {"governance_config_hash": "governance config", "manifest_hash": "manifest", "model_hash": "model", "label_mapping_hash": "label mapping"}


def drift_message(baseline: dict[str, Column], current: dict[str, Column]) -> Column:
    """The artifacts whose hash is there on both sides and differs, in one text; null where there is none."""
    parts = []
    for key, name in ARTIFACT_NAMES.items():
        old, new = baseline[key], current[key]
        said = F.concat(F.lit(f"{name} hash mismatch (baseline="), old, F.lit(", current="), new, F.lit(")"))
        parts.append(F.when((old != "") & (new != "") & (old != new), said))
    return F.nullif(F.concat_ws("; ", *parts), F.lit(""))


def hash_drift(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(artifact, baseline, current) of (artifact, hash) tables where both sides have a hash and they differ."""
    joined = current.alias("c").join(baseline.alias("b"), "artifact")
    return joined.where("c.hash is not null and b.hash is not null and c.hash <> b.hash").select("artifact", F.col("b.hash").alias("baseline"), F.col("c.hash").alias("current"))


def heldout_counts(log: DataFrame, held_out: list[str], ts: str = "timestamp") -> DataFrame:
    """(day, n): allowed evaluations of held-out splits a day. Timestamps are ISO text."""
    return log.where(F.col("allowed") & F.col("eval_split").isin(*held_out)).groupBy(F.substring(F.col(ts).cast("string"), 1, 10).alias("day")).agg(F.count("*").alias("n"))


def _ladder(config: Config, manifest: Column, label_hash: Column, frozen: Column, held: Column, tuning_held: Column, forbid: Column, drift: Column, messages: Column, today: Column, override: Column, compat: bool) -> Column:
    """struct(allowed, valid, reason) in the order of the rules. An override opens the later rules but marks the result.

    Overriding the tuning rule has a reason of its own here; compat gives it the drift's, as an older tool did.
    """
    say = lambda allowed, valid, reason: F.struct(F.lit(allowed).alias("allowed"), F.lit(valid).alias("valid"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    over_limit = held & (today >= config.max_heldout_evals_per_day)
    return (
        F.when(F.lit(config.require_manifest) & ~manifest, say(False, False, "manifest_required"))
        .when(F.lit(config.require_label_mapping_hash) & ~label_hash, say(False, False, "label_mapping_hash_required"))
        .when(F.lit(config.require_split_policy_frozen) & ~frozen, say(False, False, "split_policy_not_frozen"))
        .when(forbid & held & tuning_held & ~override, say(False, False, "held_out_tuning_forbidden"))
        .when(forbid & held & tuning_held, say(True, False, "override_used_hash_drift" if compat else "override_held_out_tuning"))
        .when(drift & ~override, say(False, False, F.concat_ws(": ", F.lit("hash_drift_blocked"), messages)))
        .when(over_limit & ~override, say(False, False, "daily_heldout_limit_exceeded"))
        .when(over_limit, say(True, False, "override_daily_heldout_limit"))
        .when(drift | override, say(True, False, "override_used_hash_drift"))
        .otherwise(say(True, True, "allowed"))
    )


def decide(requests: DataFrame, config: Config, compat: bool = False) -> DataFrame:
    """Replay a log of requests (manifest_path, label_mapping_hash, split_frozen, eval_split, tuning_split, forbid_test_tuning,
    drift, heldout_today, override): adds allowed, valid and reason. A column drift_message, where there is one, follows the
    reason of a block by drift; see drift_message()."""
    messages = F.col("drift_message") if "drift_message" in requests.columns else F.lit(None).cast("string")
    there = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    held = lambda c: F.coalesce(F.col(c).isin(*config.held_out_splits), F.lit(False))
    said = _ladder(config, there("manifest_path"), there("label_mapping_hash"), yes("split_frozen"), held("eval_split"), held("tuning_split"), yes("forbid_test_tuning"), yes("drift"), messages, F.coalesce("heldout_today", F.lit(0)), yes("override"), compat)
    (d,) = fresh(requests, "decided")
    return requests.withColumn(d, said).select(*[f"`{c}`" for c in requests.columns], f"{d}.allowed", f"{d}.valid", f"{d}.reason")


def access_record(spark, **values) -> DataFrame:
    """One row of the access log; missing hashes are null."""
    names = ("timestamp", "user_id", "eval_split", "tuning_split", "reason", *ARTIFACTS)
    row = tuple(values.get(n) for n in names) + (bool(values.get("allowed", False)), bool(values.get("valid", False)), bool(values.get("override", False)))
    return spark.createDataFrame([row], ", ".join(f"{n} string" for n in names) + ", allowed boolean, valid boolean, override boolean")


def baseline_pending(decided: DataFrame, baseline: DataFrame) -> DataFrame:
    """Add baseline_pending: the request is allowed and valid, no override was used, and no baseline is pinned yet."""
    (none_yet,) = fresh(decided, "none")
    none = baseline.agg((F.count("*") == 0).alias(none_yet))
    free = F.col("allowed") & F.col("valid") & ~F.coalesce("override", F.lit(False))
    return decided.crossJoin(none).withColumn("baseline_pending", free & F.col(none_yet)).drop(none_yet)


def finalize(decided: DataFrame, run_id: str, user_id: str, at: str) -> tuple[DataFrame, DataFrame]:
    """The records of a run (with run_id and baseline_created), and the baseline to write: (created_at_utc, created_by_user_id,
    run_id and the hashes) of the first pending request, no row where none is pending."""
    records = decided.withColumns({"run_id": F.lit(run_id), "baseline_created": F.col("baseline_pending")})
    pending = decided.where("baseline_pending").limit(1)
    made = pending.select(F.lit(at).alias("created_at_utc"), F.lit(user_id).alias("created_by_user_id"), F.lit(run_id).alias("run_id"), *ARTIFACTS)
    return records, made


def pin_baseline(log: DataFrame) -> DataFrame:
    """(artifact, hash) of the first valid run; later runs leave it as it is."""
    first = log.where("allowed and valid").agg(F.min_by(F.struct(*ARTIFACTS), "timestamp").alias("h"))
    pairs = ", ".join(f"'{a}', h.{a}" for a in ARTIFACTS)
    return first.selectExpr(f"stack({len(ARTIFACTS)}, {pairs}) as (artifact, hash)").where("hash is not null")


def cost_estimate(df: DataFrame, text: str = "text", tokens_per_word: float = 1.35, dollars_per_million: float = 1.0) -> DataFrame:
    """Rows, words and the estimated cost of sending them to a paid service."""
    from ..functions.text import word_count

    w = F.sum(word_count(F.col(text)))
    return df.agg(F.count("*").alias("rows"), w.alias("words"), F.round(w * tokens_per_word * dollars_per_million / 1e6, 6).alias("dollars"))


def with_retries(call, attempts: int = 3, wait: float = 0.0):
    """A function that tries again with doubling waits and gives None in the end, for calls inside Arrow functions."""
    import time

    def run(*args):
        for k in range(attempts):
            try:
                return call(*args)
            except Exception:  # noqa: BLE001  the service's errors are not known here
                time.sleep(wait * 2**k)
        return None

    return run
