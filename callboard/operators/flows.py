"""The write flows as a caller runs them: rules first, then rows, ids, times and audit rows.

Each flow takes the current tables and a batch of requests and returns the next tables and
the requests that a rule turned down, with their violations. Nothing is written here.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callboard.operators import changes as C
from callboard.operators import quality as Q
from callboard.sources.model import TABLES


@dataclass(frozen=True)
class Outcome:
    """Next tables by name, and the requests turned down with ``violations``."""

    tables: dict[str, DataFrame]
    rejected: DataFrame


def _all_of(table: str, parents: DataFrame, now: dt.datetime) -> DataFrame:
    return C.fill_defaults(parents, TABLES[table], now)


def add_films(film: DataFrame, requests: DataFrame, order_by: Sequence[str], now: dt.datetime) -> Outcome:
    """New films (``genres`` is a list as text) with their genre rows; the budget has a minimum."""
    # Genre and status that a new film starts with.
    start = {"primary_genre": "Drama", "production_status": "Pre-Production"}
    accepted, rejected = Q.validate(requests, Q.business_rules("film", now.date()))
    films, genres = C.ingest_with_list(film, accepted, "film_id", order_by, "genres", "genre", start)
    return Outcome({"film": _all_of("film", films, now), "film_genre": _all_of("film_genre", genres, now)}, rejected)


def add_actors(actor: DataFrame, requests: DataFrame, order_by: Sequence[str], now: dt.datetime) -> Outcome:
    """New actors (``languages`` is a list as text) with a row per language; they are of age.

    An actor without languages gets no language row.
    """
    accepted, rejected = Q.validate(requests, Q.business_rules("actor", now.date()))
    actors, languages = C.ingest_with_list(actor, accepted, "actor_id", order_by, "languages", "language")
    return Outcome({"actor": _all_of("actor", actors, now), "actor_language": _all_of("actor_language", languages, now)}, rejected)


def add_roles(role: DataFrame, requests: DataFrame, order_by: Sequence[str], now: dt.datetime) -> Outcome:
    """New castings with ids; salaries aren't negative, a casting is unique."""
    key = Q.Unique("role_uq", "Duplicate unique key", ("actor_id", "film_id", "character_name"))
    accepted, rejected = Q.validate(requests, [*Q.business_rules("role", now.date()), key])
    numbered = C.with_ids(role, accepted, "role_id", order_by)
    return Outcome({"role": _all_of("role", numbered, now)}, rejected)


def set_film_status(film: DataFrame, film_audit: DataFrame, updates: DataFrame, now: dt.datetime, moment: Column | None = None) -> Outcome:
    """Bulk status change with its audit rows, for films that the film rules let be changed.

    ``updated_date`` moves where the status does. An update of a film under the minimum
    budget is turned down, and so is one of a film that isn't there.
    """
    budgets = film.select(F.col("film_id").alias("_k"), F.col("budget").alias("_b"))
    # An update's own columns travel in one, so that none meets the film's budget.
    given = updates.select(F.struct(*updates.columns).alias("_u"))
    met = given.join(budgets, F.col("_u.film_id") == F.col("_k"), "left")
    missing = Q.Rule("film_exists", "No such film", lambda: F.col("_k").isNull())
    minimum = Q.business_rules("film", now.date())
    judged = met.withColumn("budget", F.col("_b"))
    accepted, rejected = Q.validate(judged, [missing, *minimum])
    accepted, rejected = accepted.select("_u.*"), rejected.select("_u.*", "violations")
    moment = F.lit(now) if moment is None else moment
    after, audit = C.status_update(
        film, accepted, "film_id", "production_status", "title", "budget", True, "updated_date", moment
    )
    log = C.append_audit(film_audit, audit, TABLES["film_audit"], ["film_id", "action"], now)
    return Outcome({"film": after, "film_audit": log}, rejected)


def set_equipment_status(equipment: DataFrame, equipment_audit: DataFrame, updates: DataFrame, now: dt.datetime) -> Outcome:
    """Bulk availability change with its audit rows; unknown states are turned down."""
    domain = TABLES["equipment"].column("availability").domain
    accepted, rejected = Q.validate(updates, [Q.one_of("availability", domain)])
    last = C.one_per_key(accepted, ["equipment_id"], ["availability"])
    after = C.apply_updates(equipment, last, ["equipment_id"], ["availability"])
    asked = last.select(F.col("equipment_id").alias("_k"), F.col("availability").alias("new_availability"))
    hit = equipment.join(asked, F.col("equipment_id") == F.col("_k")).where(F.col("availability") != F.col("new_availability"))
    audit = hit.select(
        "equipment_id", F.col("name").alias("equipment_name"), F.col("availability").alias("old_availability"),
        "new_availability", F.lit("UPDATE").alias("action"),
    )
    log = C.append_audit(equipment_audit, audit, TABLES["equipment_audit"], ["equipment_id"], now)
    return Outcome({"equipment": after, "equipment_audit": log}, rejected)
