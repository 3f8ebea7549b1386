"""The entity job: clean, merge, number and score the entities of documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.checkpoints import reliable
from siftline.operators import entities as E
from siftline.operators.fuzzy import fuzzy_dedupe


@dataclass(frozen=True)
class PostProcessed:
    entities: DataFrame
    relationships: DataFrame | None
    confidence: DataFrame


def post_process(entities: DataFrame, relationships: DataFrame | None = None, types: list[str] | None = None) -> PostProcessed:
    """Dates and amounts cleaned, other types merged, payment methods split off and merged, ids assigned.

    ``types`` names the entity types that are merged; by default all but dates and amounts.
    """
    # The cleaned entities are read for the documents, for each step of merging and for the types that are not merged: they
    # are stored once, with the unreadable dates, whose documents count.
    stored = reliable(E.clean_entity_amounts(E.clean_entity_dates(entities, unread="__unread")))
    # One count for all steps: only documents with many rows, or with rows that have no place, are looked at by type.
    docs = reliable(stored.groupBy("doc_id").agg(F.count("*").alias("n"), F.count("pos").alias("placed")))
    clean = stored.filter(~F.col("__unread")).drop("__unread")
    text = ~F.col("entity_type").isin("dates", "amounts")
    mergeable = clean.filter(text if types is None else F.col("entity_type").isin(types))
    others = clean.filter(~text if types is None else ~F.col("entity_type").isin(types))
    # The merged entities are read several times below; they are stored instead of being merged again.
    split = reliable(E.split_payment_methods(fuzzy_dedupe(mergeable, documents=docs)))
    # Only the payment methods are stored again; all other rows are there already.
    payment = F.col("entity_type") == E.PAYMENTS
    paid = reliable(fuzzy_dedupe(split.filter(payment), only=[E.PAYMENTS], documents=docs))
    numbered = E.assign_entity_ids(paid.unionByName(split.filter(~payment)).unionByName(others), documents=docs)
    related = None if relationships is None else E.map_relationships(relationships, numbered)
    return PostProcessed(numbered, related, E.document_confidence(docs, numbered))
