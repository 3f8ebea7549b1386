"""The cleaning job: profile, normalize, impute, filter, flag, deduplicate, shape and score."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.contact import EMAIL
from siftline.operators import quality as Q
from siftline.operators.cells import normalized_and_counted
from siftline.operators.columns import (
    IMPUTED, ROW_ID, boolean_columns, col, content_columns, filled, order_columns, strip_artifacts, total_of,
)
from siftline.operators.dedupe import dedupe_by_keys
from siftline.operators.profile import collect_profile, critical_columns, dataset_type, dedup_keys

DEFAULT_PLACEHOLDER = "unknown@example.invalid"


@dataclass(frozen=True)
class CleaningConfig:
    """Cleaning policy; values outside the known ones fall back to the defaults."""

    mode: str = "safe"  # safe | strict
    email_strategy: str = "none"  # none | remove_row | placeholder
    email_placeholder: str = DEFAULT_PLACEHOLDER
    text_placeholder: str | None = None
    track_imputation: bool = True
    min_values: int = 3
    deduplicate: bool = True

    def __post_init__(self) -> None:
        def fix(name: str, value) -> None:
            object.__setattr__(self, name, value)

        if self.mode not in ("safe", "strict"):
            fix("mode", "safe")
        if self.email_strategy not in ("none", "remove_row", "placeholder"):
            fix("email_strategy", "none")
        if not re.match(EMAIL, self.email_placeholder.strip()):
            fix("email_placeholder", DEFAULT_PLACEHOLDER)
        fix("min_values", max(2, self.min_values))

    @staticmethod
    def from_env(prefix: str = "SIFTLINE_") -> "CleaningConfig":
        """The policy named by environment variables such as ``SIFTLINE_MODE``."""
        get = lambda name, default="": os.environ.get(prefix + name, default).strip()
        low = get("MIN_VALUES", "3")
        return CleaningConfig(
            mode=get("MODE", "safe").lower(),
            email_strategy=get("EMAIL_STRATEGY", "none").lower(),
            email_placeholder=get("EMAIL_PLACEHOLDER", DEFAULT_PLACEHOLDER),
            text_placeholder=get("TEXT_PLACEHOLDER") or None,
            track_imputation=get("TRACK_IMPUTATION", "1").lower() not in ("0", "false", "no", "off"),
            min_values=int(low) if low.lstrip("-").isdigit() else 3,
        )


@dataclass(frozen=True)
class FinalClean:
    """The cleaned rows, the one-row statistics (computed when asked for) and the decisions taken."""

    rows: DataFrame
    stats: DataFrame
    profile: list
    dataset_type: str
    keys: list[str] = field(default_factory=list)


def _names(profile: list, *types: str) -> list[str]:
    return [r["column"] for r in profile if r["inferred_type"] in types]


def _strings(names: list[str]):
    return F.array(*[F.lit(n) for n in sorted(names)]).cast("array<string>")


def final_clean(
    df: DataFrame, config: CleaningConfig | None = None, profiled: tuple[DataFrame, list] | None = None
) -> FinalClean:
    """Clean a table by what its columns hold.

    Entity and transactional data is normalized by type, imputed where that is safe, and
    deduplicated (within its document, if rows have one); analytical data only loses textual noise and duplicates. Two
    driver decisions need a job each: the profile (one row per column) and, if anything may be imputed, the medians.
    ``profiled`` is what ``collect_profile`` gives for these rows, where it is there already.
    """
    cfg = config or CleaningConfig()
    df = df.drop(IMPUTED)
    local_profile, profile = profiled or collect_profile(df)
    kind = dataset_type(local_profile).first()[0]
    critical = [r[0] for r in critical_columns(local_profile).collect()]
    keys = dedup_keys(profile) if cfg.deduplicate else None
    emails, dates = _names(profile, "email"), _names(profile, "date")
    texts = _names(profile, "text", "categorical")

    # Row counters travel with the rows, so all statistics come from one aggregate.
    work = normalized_and_counted(df.withColumn("__missing", Q.missing_cells(df)), profile, kind)
    if cfg.email_strategy == "placeholder":
        work = work.withColumn("__changed", col("__changed") + total_of([(~filled(work, c)).cast("int") for c in emails]))
        work = Q.fill_placeholders(work, emails, cfg.email_placeholder, "placeholder", cfg.track_imputation)
    fills = Q.imputation_medians(work, profile, kind, cfg.mode, cfg.min_values)
    work = work.withColumn("__medians", total_of([col(c).isNull().cast("int") for c in fills]))
    work = Q.fill_medians(work, fills, cfg.track_imputation)

    kept = Q.filter_rows(work, emails, kind, cfg.email_strategy)
    placing = bool(cfg.text_placeholder) and cfg.mode != "strict" and kind != "analytical"
    holes = total_of([(~filled(kept, c)).cast("int") for c in texts]) if placing else F.lit(0)
    removal = F.struct(
        F.count("*").alias("kept"), F.coalesce(F.sum(holes), F.lit(0)).alias("placed")
    )
    after_filter = kept.agg(removal.alias("kept"))
    if placing:
        kept = Q.fill_placeholders(kept, texts, cfg.text_placeholder, "text_placeholder", cfg.track_imputation)
    kept = kept.drop("__changed", "__nulled", "__missing", "__medians")
    flagged = Q.refresh_flags(kept, emails, dates).withColumn("is_anomaly", F.lit(False))
    unique = dedupe_by_keys(flagged, keys)

    rows = Q.fill_safe_defaults(unique, boolean_columns(unique), kind)
    imputed = [col(IMPUTED)] if cfg.track_imputation and IMPUTED in rows.columns else []
    content = strip_artifacts(rows)
    rows = order_columns(rows.select(*[col(c) for c in content.columns], *imputed))

    n_fields = len(content_columns(rows))
    before = work.agg(F.struct(
        F.count("*").alias("rows"),
        *[F.coalesce(F.sum(f"__{n}"), F.lit(0)).alias(n) for n in ("changed", "nulled", "missing", "medians")],
    ).alias("before"))
    after = rows.agg(F.struct(
        F.count("*").alias("rows"), F.coalesce(F.sum(Q.missing_cells(rows)), F.lit(0)).alias("missing"),
    ).alias("after"))

    def rate(of: str):
        cells = F.col(f"{of}.rows") * n_fields
        return F.coalesce(F.bround(F.try_divide(F.col(f"{of}.missing"), cells), 6), F.lit(0.0))

    filled_cells = F.col("before.medians") + F.col("kept.placed")
    types = {
        "numeric": ("numeric", "monetary"), "email": ("email",), "date": ("date",),
        "text": ("text", "categorical"), "phone": ("phone",), "identifier": ("identifier",),
        "boolean": ("boolean",),
    }
    stats = before.join(after_filter).join(after).select(
        F.col("before.rows").alias("rows_in"),
        F.col("after.rows").alias("rows_out"),
        F.lit(cfg.mode).alias("clean_mode"),
        F.lit(cfg.email_strategy).alias("email_invalid_strategy"),
        F.lit(kind).alias("dataset_type"),
        (F.col("before.nulled") > 0).alias("invalid_values_replaced"),
        ((filled_cells > 0) | F.lit(cfg.mode == "strict")).alias("missing_values_filled"),
        (F.col("before.rows") - F.col("kept.kept")).alias("low_quality_removed"),
        (F.col("kept.kept") - F.col("after.rows")).alias("duplicate_rows_removed"),
        _strings(critical).alias("critical_fields_detected"),
        _strings(keys or []).alias("dedup_keys"),
        F.struct(*[_strings(_names(profile, *t)).alias(n) for n, t in types.items()]).alias("field_types"),
        F.struct(
            (F.col("before.rows") - F.col("after.rows")).alias("rows_removed"),
            filled_cells.alias("values_filled"),
            F.col("before.changed").alias("invalid_values_fixed"),
            rate("before").alias("null_rate_before"),
            rate("after").alias("null_rate_after"),
            F.lit(n_fields).alias("schema_field_count"),
            Q.quality_score(
                rate("after"), F.col("before.rows"), F.col("after.rows"), F.col("before.changed"), F.lit(n_fields)
            ).alias("quality_score"),
        ).alias("cleaning_summary"),
    )
    return FinalClean(rows, stats, profile, kind, keys or [])
