"""Address books: several sources with different columns, one profile per identifier."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import normalize_identifier, profile_name
from ..functions.redaction import safe_labels
from ..operators.filters import any_contains

PROFILE = ("name", "nickname", "company", "job_title", "department")
OPTIONAL = ("nickname", "organization", "job_title", "department")


def load_contacts(sources: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """`identifier_key` and profile from (people, identifiers) pairs; the first source wins.

    people: id, first_name, last_name and any of nickname, organization,
    job_title, department. identifiers: owner, value (phones before e-mails).
    """
    parts = []
    for number, (people, identifiers) in enumerate(sources):
        for column in OPTIONAL:
            if column not in people.columns:
                people = people.withColumn(column, F.lit(None).cast("string"))
        profile = people.select(
            F.col("id").alias("owner"),
            profile_name(
                F.col("first_name"), F.col("last_name"), F.col("nickname"), F.col("organization")
            ).alias("name"),
            "nickname",
            F.col("organization").alias("company"),
            "job_title",
            "department",
        ).filter(F.col("name").isNotNull())
        keys = identifiers.select(
            "owner",
            normalize_identifier(F.col("value")).alias("identifier_key"),
            F.col("value").contains("@").alias("is_mail"),
        ).filter(F.col("identifier_key") != "")
        parts.append(keys.join(profile, "owner").withColumn("source", F.lit(number)))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    first = Window.partitionBy("identifier_key").orderBy("source", "is_mail", "owner")
    return (
        every.withColumn("__n", F.row_number().over(first))
        .filter("__n = 1")
        .select("identifier_key", *PROFILE)
    )


def enrich_people(people: DataFrame, contacts: DataFrame) -> DataFrame:
    """`person_id` with safe profile fields; the identifier itself never leaves.

    people: identifier, person_id. Contacts join on the normalised key; Spark
    broadcasts them while their measured size allows it.
    """
    keyed = people.withColumn("identifier_key", normalize_identifier(F.col("identifier")))
    joined = keyed.join(contacts, "identifier_key", "left").withColumn(
        "__safe", safe_labels(*[F.col(c) for c in PROFILE])
    )
    shown = {c: F.col("__safe")[i] for i, c in enumerate(PROFILE)}
    shown["name"] = F.coalesce(shown["name"], F.lit("Unknown person"))
    shown["nickname"] = F.when(shown["nickname"] != shown["name"], shown["nickname"])
    return joined.withColumns(shown).drop("__safe", "identifier", "identifier_key")


def match_contacts(contacts: DataFrame, needle: str) -> DataFrame:
    """Profiles with the needle in any field, ignoring case."""
    return contacts.filter(any_contains(list(PROFILE), needle))
