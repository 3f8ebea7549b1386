"""Entity tables: one row per value found in a document or a table row.

Columns: ``doc_id, entity_type, pos, value, number, confidence, currency, label``, and on the way
``original``, ``flag`` and ``id``. ``pos`` orders the entities of one type within a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline import functions as X
from siftline.functions.text import bound
from siftline.operators.columns import FLAGS, ROW_ID, col, content_columns, filled, numeric_columns, string_columns

# Id prefixes of known types (other types use their first two letters), and their order.
ID_PREFIXES = {"pe": "p", "or": "o", "da": "d", "am": "a", "pa": "pm"}
TYPE_ORDER = ["person_names", "organizations", "dates", "amounts"]
PAYMENTS = "payment_methods"

# Positions per chunk when ranks are computed without gathering a whole group.
CHUNK = 100_000


def extract_row_entities(df: DataFrame) -> DataFrame:
    """Entities of every table row by value pattern: dates, amounts, and all other cells as extras.

    The filled cells of a row are laid out first, so the detectors are compiled and run once per cell, however many
    columns there are.
    """
    texts, numbers = set(string_columns(df)), set(numeric_columns(df))
    cell = lambda c: F.struct(
        F.lit(c).alias("name"), F.lit(X.field_name(c) or "value").alias("measure"),
        X.strip(col(c).cast("string")).alias("value"), F.lit(c in texts).alias("is_text"),
        (col(c).cast("double") if c in numbers else F.lit(None).cast("double")).alias("number"),
    )
    laid = F.array_compact(F.array(*[F.when(filled(df, c), cell(c)) for c in content_columns(df)]))
    cells = df.select(col(ROW_ID).alias("doc_id"), F.posexplode(laid).alias("pos", "cell")).select("doc_id", "pos", "cell.*")
    text = F.when(F.col("is_text"), F.col("value"))
    judged = cells.withColumns({
        "number": F.coalesce(F.col("number"), X.parse_number(text)),
        "email": F.coalesce(X.looks_like_email(text, trimmed=True), F.lit(False)),
        "phone": F.coalesce(X.looks_like_phone(text), F.lit(False)),
        "date": F.coalesce((F.length(text) >= 6) & X.looks_like_date(text, trimmed=True), F.lit(False)),
    })
    kind, number = F.col("entity_type"), F.col("number")
    return judged.withColumn(
        "entity_type",
        F.when(F.col("email") | F.col("phone"), F.lit("extra_fields")).when(F.col("date"), F.lit("dates"))
        .when((F.abs(number) >= 100) | (number != F.floor(number)), F.lit("amounts")).otherwise(F.lit("extra_fields")),
    ).select(
        "doc_id", "pos", "entity_type", F.when(F.col("email"), F.lower("value")).otherwise(F.col("value")).alias("value"),
        F.when(kind == "amounts", number).alias("number"),
        F.when(kind == "dates", F.lit(0.72)).when(kind == "amounts", F.lit(0.82)).alias("confidence"),
        F.when(kind == "amounts", F.col("measure")).when(kind != "dates", F.col("name")).alias("label"),
        F.lit("").alias("currency"),
    )


# Confidences of an item and of a row without items, by the kind of document.
CONFIDENCES = {"entities": (0.85, 0.75), "generic": (0.8, 0.7)}


def _flagged(rows: DataFrame) -> DataFrame:
    """Rows made from entities begin without a mark and as valid; later steps judge them."""
    valid = {f: F.lit(f.startswith("is_valid")) for f in FLAGS if f != "confidence"}
    return rows.withColumns(valid)


def entity_maps(entities: DataFrame, documents: DataFrame | None = None, kind: str = "entities") -> DataFrame:
    """Entities aligned by position: ``(doc_id, pos, values, confidence)`` and the row flags.

    ``values`` maps entity types to values, so any number of types needs no list of them. ``confidence`` is the mean of
    the items. A document without any value gives one row of confidence 0.5. ``documents`` (``doc_id``) adds those
    without entities, one row each: 0.5 for ``kind`` "generic", 0.75 otherwise. Of several items of one type and
    position the least value counts; a type is a key also where its value is NULL.
    """
    item, row = CONFIDENCES[kind]
    sure = F.coalesce(F.col("confidence"), F.lit(item))
    wide = (
        entities.groupBy("doc_id", "pos", "entity_type")
        .agg(F.min("value").alias("value"), F.sum(sure).alias("sum"), F.count("*").alias("n"))
        .groupBy("doc_id", "pos").agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "value")))).alias("values"),
            F.coalesce(F.sum("sum") / F.sum("n"), F.lit(row)).alias("confidence"),
        )
    )
    known = entities.groupBy("doc_id").agg(F.bool_or(F.coalesce(F.col("value") != "", F.lit(False))).alias("known"))
    empty = known.filter(~F.col("known")).select("doc_id", F.lit(0.5).alias("confidence"))
    rows = wide.join(empty.select("doc_id"), "doc_id", "left_anti")
    if documents is not None:
        bare = documents.select("doc_id").distinct().join(known, "doc_id", "left_anti")
        empty = empty.unionByName(bare.select("doc_id", F.lit(0.5 if kind == "generic" else 0.75).alias("confidence")))
    none = F.lit(None).cast("string")
    blank = empty.select(
        "doc_id", F.lit(0).cast(entities.schema["pos"].dataType).alias("pos"),
        F.map_filter(F.create_map(F.lit(""), none), lambda k, v: F.lit(False)).alias("values"), "confidence",
    )
    return _flagged(rows.unionByName(blank))


def entities_to_rows(
    entities: DataFrame, types: list[str] | None = None, documents: DataFrame | None = None, kind: str = "entities"
) -> DataFrame:
    """``entity_maps`` with one column per entity type.

    Columns must be known before a job runs: without ``types`` their names are read first, one row per type.
    ``entity_maps`` needs no such list.
    """
    if types is None:
        types = sorted(r[0] for r in entities.select("entity_type").distinct().collect())
    rows = entity_maps(entities.filter(F.col("entity_type").isin(types)) if types else entities, documents, kind)
    return rows.select(
        "doc_id", "pos", *[F.try_element_at("values", F.lit(t)).alias(t) for t in types], *FLAGS
    )


def first_entities_to_rows(entities: DataFrame, types: list[str]) -> DataFrame:
    """One row per document with the first entity of each type; confidence 0.75, and the row flags."""
    return _flagged(entities.groupBy("doc_id").agg(
        *[
            F.min_by(F.when(F.col("entity_type") == t, F.col("value")),
                     F.when(F.col("entity_type") == t, F.col("pos"))).alias(t)
            for t in types
        ],
        F.lit(0.75).alias("confidence"),
    ))


def _only(df: DataFrame, kind: str) -> Column:
    return F.col("entity_type") == kind


def clean_entity_dates(entities: DataFrame, unread: str | None = None) -> DataFrame:
    """Dates become ISO; others than dates stay; unreadable dates go; a changed text is kept as ``original``.

    ``unread`` names a column that marks the unreadable dates, which then stay.
    """
    date = _only(entities, "dates")
    # A column of its own, so that a date is read once for its three uses.
    iso = bound(X.strip_column(F.col("value")), lambda v: X.parse_date(v, trimmed=True))
    read = entities.withColumn("__iso", F.when(F.coalesce(date, F.lit(True)), iso))
    mark, iso = unread or "__unread", F.col("__iso")
    marked = read.withColumns({
        "original": F.when(date & (F.col("value") != iso), F.col("value")),
        "value": F.when(date, iso).otherwise(F.col("value")),
        mark: ~F.coalesce(~date | iso.isNotNull(), F.lit(False)),
    }).drop("__iso")
    return marked if unread else marked.filter(~F.col(mark)).drop(mark)


def clean_entity_amounts(entities: DataFrame) -> DataFrame:
    """Currency code, label and a mark on negative amounts."""
    amount = _only(entities, "amounts")
    return entities.withColumns({
        "currency": F.when(amount, X.detect_currency(F.col("currency"))).otherwise(F.col("currency")),
        "label": F.when(amount, X.normalize_label(F.col("label"))).otherwise(F.col("label")),
        "flag": F.when(amount & (F.col("number") < 0), F.lit("negative_value")),
    })


def split_payment_methods(entities: DataFrame) -> DataFrame:
    """Organizations that name a payment channel get a type of their own, title-cased."""
    payment = _only(entities, "organizations") & X.is_payment_method(F.col("value"))
    return entities.withColumns({
        "entity_type": F.when(payment, F.lit(PAYMENTS)).otherwise(F.col("entity_type")),
        "value": F.when(payment, X.title_case(X.strip(F.col("value")))).otherwise(F.col("value")),
    })


def rank_within(
    df: DataFrame, keys: list[str], order: str, name: str, chunk: int = CHUNK, sizes: DataFrame | None = None
) -> DataFrame:
    """1-based rank by an integer column within a group; rows without a key or a position are left out.

    Rows of groups of more than ``chunk`` are ranked within chunks of ``chunk`` positions, and the chunk sizes give the
    offsets, so a group that holds a third of all rows is spread over many tasks. All other groups are ranked whole.
    ``sizes`` has some of the keys and a number ``n`` that their rows do not exceed; then only rows of large ``n`` are counted.
    """
    columns = [*keys, *[c for c in df.columns if c not in keys], name]
    placed = df
    for c in (*keys, order):
        placed = placed.filter(F.col(c).isNotNull())
    counted, heavy = placed, None
    if sizes is not None:
        some = [k for k in keys if k in sizes.columns]
        heavy = sizes.filter(F.col("n") > chunk).select(*some)
        counted = placed.join(heavy, some, "left_semi")
    large = counted.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > chunk).select(*keys, F.lit(True).alias("__large"))
    if (heavy is not None and heavy.isEmpty()) or large.isEmpty():
        here = Window.partitionBy(*keys).orderBy(order)
        return placed.withColumn(name, F.row_number().over(here).cast("long")).select(*columns)
    # There is at most one large group for ``chunk`` rows, so they can be sent everywhere.
    parted = placed.join(F.broadcast(large), keys, "left").withColumn(
        "__part", F.when(F.col("__large"), F.floor(F.col(order) / chunk)).otherwise(F.lit(0))
    )
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parted.filter("__large").groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
        .withColumn("__before", F.sum("__n").over(before)).drop("__n")
    )
    here = Window.partitionBy(*keys, "__part").orderBy(order)
    return (
        parted.withColumn("__here", F.row_number().over(here))
        .join(offsets, [*keys, "__part"], "left")
        .withColumn(name, F.coalesce(F.col("__before"), F.lit(0)) + F.col("__here"))
        .select(*columns)
    )


def assign_entity_ids(entities: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Short ids: a prefix for the type and the rank within the document and type.

    ``documents`` may tell how many rows ``n`` each ``doc_id`` has at most, so that only large ones are counted by type.
    """
    head = F.lower(F.left(F.col("entity_type"), F.lit(2)))
    known = F.create_map(*[F.lit(w) for pair in ID_PREFIXES.items() for w in pair])
    prefix = F.coalesce(F.try_element_at(known, head), F.nullif(head, F.lit("")), F.lit("x"))
    ranked = rank_within(entities, ["doc_id", "entity_type"], "pos", "__rank", sizes=documents)
    return ranked.withColumn("id", F.concat(prefix, F.col("__rank").cast("string"))).drop("__rank")


def _type_place() -> Column:
    """Known types first, then the others by name, payment methods last."""
    place = F.array_position(F.array(*[F.lit(t) for t in TYPE_ORDER]), F.col("entity_type"))
    kind = F.when(place > 0, place).when(F.col("entity_type") == PAYMENTS, F.lit(1000)).otherwise(F.lit(100))
    return F.struct(kind, F.col("entity_type"), F.col("pos"))


def map_relationships(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Endpoints ``from`` and ``to`` as entity ids: by exact text, then by lower case, else unchanged.

    ``relationships`` has ``doc_id, rel_id, type, from, to, confidence``; of entities with equal text
    the last one counts. All endpoints go through one join.
    """
    names = entities.select("doc_id", "id", "value", _type_place().alias("place")).select(
        "doc_id", "id", "place", F.explode(F.array_distinct(F.array("value", F.lower("value")))).alias("key")
    )
    ids = names.groupBy("doc_id", "key").agg(F.max_by("id", "place").alias("id"))
    probes = relationships.select("doc_id", "rel_id", F.inline(F.array(*[
        F.struct(F.lit(end).alias("end"), F.lit(turn).alias("turn"), key.alias("key"))
        for end in ("from", "to")
        for turn, key in ((0, F.col(end)), (1, F.lower(F.col(end))))
    ])))
    hits = probes.join(ids, ["doc_id", "key"]).groupBy("doc_id", "rel_id").agg(*[
        F.min_by(F.when(F.col("end") == end, F.col("id")), F.when(F.col("end") == end, F.col("turn"))).alias(f"__{end}")
        for end in ("from", "to")
    ])
    return (
        relationships.join(hits, ["doc_id", "rel_id"], "left")
        .withColumns({
            "from": F.coalesce("__from", "from"),
            "to": F.coalesce("__to", "to"),
            "type": F.coalesce("type", F.lit("unknown")),
            "confidence": F.coalesce("confidence", F.lit(0.0)),
        })
        .drop("__from", "__to")
    )


def document_confidence(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """Mean confidence of a document's entities, two digits; 0 without entities."""
    means = entities.groupBy("doc_id").agg(F.avg("confidence").alias("mean"))
    return docs.select("doc_id").join(means, "doc_id", "left").select(
        "doc_id", F.coalesce(F.bround(F.round("mean", 9), 2), F.lit(0.0)).alias("confidence_overall")
    )
