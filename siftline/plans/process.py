"""From raw table or text rows to validated rows, cleaned rows and their statistics."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline import functions as X
from siftline.checkpoints import reliable
from siftline.operators import quality as Q
from siftline.operators.cells import clean_cells, prune_and_coerce, row_numeric_valid, settle_lanes
from siftline.operators.columns import DOCUMENT, ROW_ID, col, content_columns, drop_blank_rows
from siftline.operators.dedupe import dedupe_content
from siftline.operators.extract import extract_records
from siftline.operators.mapping import FieldMap, classify_fields, coerce_rows, field_map_of, merge_field_maps, sample_rows, semantic_rows
from siftline.operators.profile import collect_profile, confirmed_monetary, infer_critical_fields
from siftline.operators.ranks import cap_rows
from siftline.operators.summary import numeric_summary
from siftline.plans.final_clean import CleaningConfig, FinalClean, final_clean
from siftline.sources.memory import read_schema_memory, save_schema_map, signature_of


@dataclass(frozen=True)
class Processed:
    """Validated rows, cleaned rows, analytics and validation counts."""

    validated: DataFrame
    cleaned: FinalClean
    analytics: DataFrame
    field_map: FieldMap
    critical: list[str]
    staged: bool = True

    @property
    def validation(self) -> DataFrame:
        """Counts of valid cells in the cleaned rows; profiles them, so it is computed on request."""
        # The profile and the counts read the same rows: they are stored once instead of being cleaned twice.
        cleaned = reliable(self.cleaned.rows) if self.staged else self.cleaned.rows
        _, rows = collect_profile(cleaned)
        return Q.validation_summary(cleaned, rows)


def _shared_tail(rows: DataFrame, field_map: FieldMap, config: CleaningConfig | None, staged: bool) -> Processed:
    coerced = prune_and_coerce(dedupe_content(coerce_rows(rows)))
    coerced = coerced.withColumn("is_valid_numeric", row_numeric_valid(coerced))
    # What follows reads these rows several times: they are stored once instead of being rebuilt.
    coerced = reliable(coerced) if staged else coerced
    data = settle_lanes(coerced)
    content = data.drop("had_norm")
    # One profile for the critical fields, the rules and the cleaning: the steps between change flags only.
    profile, profile_rows = collect_profile(content)
    critical = [r[0] for r in infer_critical_fields(content, profile).collect()]
    of = lambda kind: [r["column"] for r in profile_rows if r["inferred_type"] == kind]
    marked = Q.detect_anomalies(data, critical, of("email"), of("date"))
    sure = Q.adaptive_confidence(marked, critical, col("had_norm"))
    validated = marked.withColumn("confidence", sure).drop("had_norm", "anomaly_reason")
    money = [r[0] for r in confirmed_monetary(profile).collect()]
    lanes = [c for c in validated.columns if c.startswith("__")]
    shown = validated.drop(*lanes)
    same = content_columns(shown) == content_columns(content)
    return Processed(
        shown,
        final_clean(shown, config, (profile, profile_rows) if same else None),
        numeric_summary(validated, money or None),
        field_map,
        critical,
        staged,
    )


def process_table(
    df: DataFrame,
    config: CleaningConfig | None = None,
    field_map: FieldMap | None = None,
    max_rows: int | None = None,
    staged: bool = True,
    memory: str | None = None,
    role_rows: int | None = None,
) -> Processed:
    """The tabular job. ``field_map`` is given, or comes from the profile of all rows.

    With ``role_rows`` the profile sees that many filled rows, out of five times as many first ones, instead.
    ``memory`` is the folder of a schema memory: a map remembered for the same columns adds to the one found, and
    a map for unknown columns is remembered. All rows are processed unless ``max_rows`` caps them.
    """
    # Blank rows go before the cells are cleaned: the test reads the raw cells only.
    raw = drop_blank_rows(df if max_rows is None else cap_rows(df, max_rows))
    cells = clean_cells(raw)
    if field_map is None:
        # The profile and the rows both read the cleaned cells.
        cells = reliable(cells) if staged and role_rows is None else cells
        seen = cells if role_rows is None else clean_cells(sample_rows(df, role_rows, 5 * role_rows))
        field_map = field_map_of(classify_fields(seen))
        if memory is not None:
            field_map = remembered(df, memory, field_map)
    rows = semantic_rows(cells, field_map, clean=False)
    return _shared_tail(rows, field_map, config, staged)


def remembered(df: DataFrame, folder: str, found: FieldMap) -> FieldMap:
    """``found`` with the map that the memory holds for the columns of ``df``; new columns are remembered."""
    spark, columns = df.sparkSession, content_columns(df)
    signature = signature_of(columns)
    known = read_schema_memory(spark, folder).filter(F.col("signature") == signature).first()
    if known is None:
        save_schema_map(spark, folder, signature, json.dumps(found))
        return found
    pairs = lambda fields: spark.createDataFrame(
        [(r, c, k) for k, (r, names) in enumerate(fields.items()) for c in names], "role string, column string, position int"
    )
    valid = spark.createDataFrame([(c.strip(),) for c in columns], "column string")
    merged = {(r["role"], r["column"]) for r in merge_field_maps(pairs(found), pairs(json.loads(known["mapping"])), valid).collect()}
    out: FieldMap = {}
    for fields in (found, json.loads(known["mapping"])):
        for role, names in fields.items():
            for name in names:
                if (role, name) in merged and name not in out.get(role, []):
                    out.setdefault(role, []).append(name)
    return out


def process_documents(
    docs: DataFrame, config: CleaningConfig | None = None, kind: str = "txt", most: int | None = None,
    max_chars: int | None = None, staged: bool = True, id_col: str = ROW_ID,
) -> Processed:
    """The text job: clean the text, extract rows from it, then as for tables.

    ``docs`` has ``text`` and an id of any type. Rows carry it as ``_document``, and ``_row_id`` is their place in
    their document. They are deduplicated within their document only, so every document keeps at least one validated
    row. Rows of ``docs`` with one id are one document; null ids are one document, too.
    """
    clean = docs.select(col(id_col).alias(DOCUMENT), X.clean_text(F.col("text"), kind).alias("text"))
    found = extract_records(clean, most=most, max_chars=max_chars)
    return _shared_tail(found.withColumnRenamed("place", ROW_ID), {}, config, staged)
