"""The production catalogue: tables, keys, defaults, domains and references as data.

Parquet does not enforce any of this. The declared schema is used for scans; the rest
feeds the validation rules, default filling and cascading deletes.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

NO_DEFAULT = object()
NOW = object()
"""Default that stands for the load time, which the caller passes explicitly."""


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    required: bool = False
    default: object = NO_DEFAULT
    domain: tuple[str, ...] = ()
    length: int | None = None


@dataclass(frozen=True)
class Ref:
    """Foreign key; ``on_delete`` is ``cascade`` or ``set null``."""

    column: str
    table: str
    parent: str
    on_delete: str = "cascade"


@dataclass(frozen=True)
class Table:
    name: str
    key: tuple[str, ...]
    columns: tuple[Column, ...]
    refs: tuple[Ref, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    generated: bool = False

    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(", ".join(f"`{c.name}` {c.type}" for c in self.columns))

    def column(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)


def _id(name: str) -> Column:
    return Column(name, "int", required=True)


def _int(name: str, default: object = NO_DEFAULT) -> Column:
    return Column(name, "int", default=default)


def _text(name: str, length: int | None = None, required: bool = False, default: object = NO_DEFAULT) -> Column:
    return Column(name, "string", required, default, (), length)


def _dec(name: str, precision: int, scale: int, default: object = NO_DEFAULT) -> Column:
    return Column(name, f"decimal({precision},{scale})", default=default)


def _date(name: str, required: bool = False) -> Column:
    return Column(name, "date", required)


def _enum(name: str, default: str, *domain: str) -> Column:
    return Column(name, "string", default=default, domain=domain)


def _flag(name: str, default: bool) -> Column:
    return Column(name, "boolean", default=default)


# The catalogue's columns, lengths, defaults, domains and keys.
_GENDER = ("Other", "M", "F", "Other")

TABLES: dict[str, Table] = {
    t.name: t
    for t in (
        Table("director", ("director_id",), (
            _id("director_id"), _text("name", 120, True), _date("dob"), _enum("gender", *_GENDER),
            _text("nationality", 80)), generated=True),
        Table("producer", ("producer_id",), (
            _id("producer_id"), _text("name", 120, True), _text("company", 120), _text("contact", 50),
            _text("email", 120), _date("dob")), generated=True),
        Table("studio", ("studio_id",), (
            _id("studio_id"), _text("name", 120, True), _text("location", 200), _int("established_year"),
            _int("capacity"), _text("facilities")), generated=True),
        Table("distributor", ("distributor_id",), (
            _id("distributor_id"), _text("name", 120, True), _text("region", 80),
            _dec("market_share", 5, 2, "0.00")), generated=True),
        Table("actor", ("actor_id",), (
            _id("actor_id"), _text("first_name", 60, True), _text("last_name", 60, True), _date("dob"),
            _enum("gender", *_GENDER), _text("nationality", 80), _text("stage_name", 120)), generated=True),
        Table("crew", ("crew_id",), (
            _id("crew_id"), _text("name", 120, True), _text("role", 60, True), _date("dob"),
            _int("experience_years", 0), _text("department", 60), _int("supervisor_id")),
            (Ref("supervisor_id", "crew", "crew_id", "set null"),), generated=True),
        Table("equipment", ("equipment_id",), (
            _id("equipment_id"), _text("name", 120, True), _text("type", 60), _dec("cost", 12, 2, "0"),
            _date("purchase_date"), _text("condition", 30, default="Good"),
            _enum("availability", "Available", "Available", "In Use", "Under Maintenance")), generated=True),
        Table("shooting_location", ("location_id",), (
            _id("location_id"), _text("name", 120, True), _text("city", 80), _text("state", 80),
            _text("country", 80), _dec("cost_per_day", 12, 2, "0"), _text("area", 80), _text("amenities")),
            generated=True),
        Table("film", ("film_id",), (
            _id("film_id"), _text("title", 200, True), _date("release_date"), _dec("budget", 15, 2, "0"),
            _int("duration"), _text("language", 80), _dec("boxoffice_collection", 15, 2, "0"), _dec("rating", 3, 1),
            _int("fk_director_id"), _text("primary_genre", 60),
            _enum("production_status", "Pre-Production",
                  "Pre-Production", "In Progress", "Post-Production", "Released"),
            Column("created_date", "timestamp", default=NOW), Column("updated_date", "timestamp", default=NOW)),
            (Ref("fk_director_id", "director", "director_id", "set null"),), generated=True),
        Table("role_audit", ("audit_id",), (
            _id("audit_id"), _id("actor_id"), _id("film_id"), _text("character_name", 120), _dec("salary", 14, 2),
            _text("action", 20), Column("timestamp", "timestamp_ntz", default=NOW)), generated=True),
        Table("equipment_audit", ("audit_id",), (
            _id("audit_id"), _id("equipment_id"), _text("equipment_name", 120), _text("old_availability", 50),
            _text("new_availability", 50), _text("action", 20), Column("timestamp", "timestamp_ntz", default=NOW)),
            generated=True),
        Table("film_audit", ("audit_id",), (
            _id("audit_id"), _id("film_id"), _text("film_title", 200), _text("old_status", 50),
            _text("new_status", 50), _dec("old_budget", 15, 2), _dec("new_budget", 15, 2), _text("action", 20),
            Column("timestamp", "timestamp_ntz", default=NOW)), generated=True),
        Table("actor_language", ("actor_id", "language"), (
            _id("actor_id"), _text("language", 80, True),
            _enum("fluency_level", "Conversational", "Basic", "Conversational", "Fluent", "Native")),
            (Ref("actor_id", "actor", "actor_id"),)),
        Table("film_genre", ("film_id", "genre"), (
            _id("film_id"), _text("genre", 60, True), _flag("is_primary", False)),
            (Ref("film_id", "film", "film_id"),)),
        Table("director_specialization", ("director_id", "specialization"), (
            _id("director_id"), _text("specialization", 80, True), _int("years_experience", 0)),
            (Ref("director_id", "director", "director_id"),)),
        Table("film_certificate", ("certificate_id",), (
            _id("certificate_id"), _id("film_id"), _text("rating_board", 80, True),
            _text("certificate_rating", 20, True), _date("issue_date", True), _date("expiry_date"),
            _text("content_warnings")),
            (Ref("film_id", "film", "film_id"),), unique=(("film_id",),), generated=True),
        Table("scene", ("scene_id",), (
            _id("scene_id"), _id("film_id"), _text("location", 200), _text("description"), _int("duration")),
            (Ref("film_id", "film", "film_id"),), generated=True),
        Table("role", ("role_id",), (
            _id("role_id"), _id("actor_id"), _id("film_id"), _text("character_name", 120), _int("screen_time"),
            _enum("importance", "Supporting", "Lead", "Supporting", "Cameo"), _dec("salary", 14, 2, "0")),
            (Ref("actor_id", "actor", "actor_id"), Ref("film_id", "film", "film_id")),
            unique=(("actor_id", "film_id", "character_name"),), generated=True),
        Table("produced_by", ("film_id", "producer_id"), (
            _id("film_id"), _id("producer_id"), _dec("investment", 15, 2, "0")),
            (Ref("film_id", "film", "film_id"), Ref("producer_id", "producer", "producer_id"))),
        Table("distributes", ("distributor_id", "film_id"), (
            _id("distributor_id"), _id("film_id"), _dec("distribution_fee", 15, 2, "0"), _date("distribution_date"),
            _text("territory", 120)),
            (Ref("distributor_id", "distributor", "distributor_id"), Ref("film_id", "film", "film_id"))),
        Table("hosts", ("studio_id", "film_id"), (
            _id("studio_id"), _id("film_id"), _dec("rental_cost", 15, 2, "0"), _date("rental_start"),
            _date("rental_end")),
            (Ref("studio_id", "studio", "studio_id"), Ref("film_id", "film", "film_id"))),
        Table("works_on", ("crew_id", "film_id"), (
            _id("crew_id"), _id("film_id"), _date("start_date"), _date("end_date"), _text("department", 80)),
            (Ref("crew_id", "crew", "crew_id"), Ref("film_id", "film", "film_id"))),
        Table("shot_at", ("film_id", "location_id"), (
            _id("film_id"), _id("location_id"), _date("shooting_start"), _date("shooting_end"),
            _dec("total_cost", 15, 2, "0")),
            (Ref("film_id", "film", "film_id"), Ref("location_id", "shooting_location", "location_id"))),
        Table("scene_filming", ("filming_id",), (
            _id("filming_id"), _id("film_id"), _id("scene_id"), _id("crew_id"), _int("equipment_id"),
            _date("filming_date"), _int("duration_minutes"), _text("notes")),
            (Ref("film_id", "film", "film_id"), Ref("scene_id", "scene", "scene_id"),
             Ref("crew_id", "crew", "crew_id"), Ref("equipment_id", "equipment", "equipment_id", "set null")),
            unique=(("film_id", "scene_id", "crew_id", "equipment_id"),), generated=True),
        Table("film_crew_equipment", ("film_id", "crew_id", "equipment_id"), (
            _id("film_id"), _id("crew_id"), _id("equipment_id"), _int("days_used", 0),
            _dec("efficiency_rating", 3, 1, "0.0"), _flag("maintenance_required", False)),
            (Ref("film_id", "film", "film_id"), Ref("crew_id", "crew", "crew_id"),
             Ref("equipment_id", "equipment", "equipment_id"))),
        Table("usage", ("film_id", "equipment_id"), (
            _id("film_id"), _id("equipment_id"), _date("usage_start"), _date("usage_end")),
            (Ref("film_id", "film", "film_id"), Ref("equipment_id", "equipment", "equipment_id"))),
        *(
            Table(f"{who}_award", (f"{who}_id", "award_name", "award_year"), (
                _id(f"{who}_id"), _text("award_name", 200, True), _id("award_year")),
                (Ref(f"{who}_id", who, f"{who}_id"),))
            for who in ("actor", "director", "crew")
        ),
        Table("user_metadata", ("username",), (
            _text("username", 50, True), _text("full_name", 120, True), _text("email", 120),
            _enum("role", "viewer", "admin", "manager", "viewer"), _flag("is_active", True),
            Column("created_at", "timestamp", default=NOW), _text("created_by", 50),
            Column("last_login", "timestamp")), unique=(("email",),)),
        Table("user_activity_log", ("log_id",), (
            _id("log_id"), _text("username", 50, True), _text("action_type", 50, True), _text("action_description"),
            _text("ip_address", 45), Column("timestamp", "timestamp", default=NOW)), generated=True),
    )
}


def load_catalogue(spark: SparkSession, folder: str, names: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """Scan catalogue tables stored as ``<folder>/<table>`` with their declared schema."""
    return {n: spark.read.schema(TABLES[n].schema()).parquet(f"{folder}/{n}") for n in names or TABLES}


def references(names: Iterable[str] | None = None) -> list[tuple[str, Ref]]:
    """(child table, foreign key) pairs, parents before their children.

    A table comes after every table it would be cascaded from; set-null keys, the
    self-reference among them, do not order anything.
    """
    chosen = list(names or TABLES)
    ordered: list[str] = []
    while len(ordered) < len(chosen):
        ready = [
            n
            for n in chosen
            if n not in ordered
            and all(
                r.table in ordered or r.table not in chosen
                for r in TABLES[n].refs
                if r.on_delete == "cascade"
            )
        ]
        ordered += ready
    return [(n, r) for n in ordered for r in TABLES[n].refs]
