"""The catalogue's seed rows, loaded through the declared model."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callboard.operators.changes import fill_defaults
from callboard.sources.model import TABLES

# The seed rows that the golden results are derived from.
ROWS: dict[str, tuple[str, list[tuple]]] = {
    "director": ("director_id name dob gender nationality", [
        (1, "Christopher Nolan", "1970-07-30", "M", "British"),
        (2, "Greta Gerwig", "1983-08-04", "F", "American"),
        (3, "Ava DuVernay", "1972-08-24", "F", "American"),
        (4, "Denis Villeneuve", "1967-10-03", "M", "Canadian")]),
    "producer": ("producer_id name company", [
        (1, "Emma Thomas", "Syncopy"), (2, "Scott Rudin", "Rudin Productions"),
        (3, "Dede Gardner", "Plan B Entertainment")]),
    "distributor": ("distributor_id name region market_share", [
        (1, "Warner Distribution", "Worldwide", "22.50"), (2, "Universal Pictures", "Worldwide", "24.30"),
        (3, "Sony Pictures", "North America", "12.00")]),
    "actor": ("actor_id first_name last_name dob gender nationality stage_name", [
        (1, "Leonardo", "DiCaprio", "1974-11-11", "M", "American", "Leo"),
        (2, "Emma", "Stone", "1988-11-06", "F", "American", "Emma Stone"),
        (3, "Robert", "Downey Jr.", "1965-04-04", "M", "American", "RDJ"),
        (4, "Tessa", "Thompson", "1983-10-03", "F", "American", "Tessa")]),
    "crew": ("crew_id name role dob experience_years department supervisor_id", [
        (1, "Sam Carter", "Cinematographer", "1982-04-15", 15, "Camera", None),
        (2, "Alex Kim", "Gaffer", "1985-10-10", 12, "Lighting", 1),
        (3, "Priya Patel", "Editor", "1990-02-21", 8, "Editing", None),
        (4, "Miguel Sanchez", "Sound Designer", "1978-06-30", 18, "Sound", None)]),
    "equipment": ("equipment_id name type cost availability", [
        (1, "Arri Alexa Mini", "Camera", "120000", "Available"), (2, "RED Helium", "Camera", "90000", "In Use"),
        (3, "Dolly Track Set", "Grip", "15000", "Available"), (4, "Boom Microphone Kit", "Sound", "4000", "Available")]),
    "shooting_location": ("location_id name city state country cost_per_day area", [
        (1, "Old Factory", "Detroit", "MI", "USA", "2500", "Large indoor"),
        (2, "Seaside Cliff", "Santa Monica", "CA", "USA", "3500", "Outdoor"),
        (3, "Central Park", "New York", "NY", "USA", "5000", "Large outdoor")]),
    "film": ("film_id title release_date budget duration language boxoffice_collection rating primary_genre "
             "fk_director_id production_status", [
        (1, "Quantum Dreams", "2024-06-01", "50000000", 130, "English", "120000000", "8.2", "Sci-Fi", 1, "Released"),
        (2, "Tiny Stories", "2023-11-10", "12000000", 95, "English", "30000000", "7.1", "Drama", 2, "Released"),
        (3, "Echoes of Home", "2025-03-20", "15000000", 110, "English", "0", None, "Drama", 3, "Post-Production"),
        (4, "Desert Horizon", "2024-12-05", "80000000", 145, "English", "400000000", "9.0", "Action", 4, "Released")]),
    "film_genre": ("film_id genre is_primary", [
        (1, "Sci-Fi", True), (1, "Adventure", False), (2, "Drama", True), (2, "Comedy", False), (3, "Drama", True),
        (3, "Family", False), (4, "Action", True), (4, "Thriller", False)]),
    "scene": ("scene_id film_id location duration", [
        (1, 1, "Space Station Interior", 9), (2, 1, "Bridge", 12), (3, 2, "Café", 6), (4, 4, "Desert Dunes", 20),
        (5, 4, "Helicopter LZ", 8)]),
    "actor_language": ("actor_id language fluency_level", [
        (1, "English", "Native"), (1, "Italian", "Conversational"), (2, "English", "Native"), (3, "English", "Native"),
        (4, "English", "Native"), (4, "Spanish", "Conversational")]),
    "director_specialization": ("director_id specialization years_experience", [
        (1, "Sci-Fi", 20), (1, "Thriller", 12), (2, "Indie Drama", 10), (3, "Social Drama", 15), (4, "Thriller", 18),
        (4, "Action", 14)]),
    "role": ("role_id actor_id film_id character_name screen_time importance salary", [
        (1, 1, 1, "Commander Ray", 40, "Lead", "2000000"), (2, 3, 1, "Engineer Mark", 25, "Supporting", "800000"),
        (3, 2, 2, "Maya", 50, "Lead", "450000"), (4, 4, 4, "Agent Rivers", 60, "Lead", "3000000")]),
    "produced_by": ("film_id producer_id investment", [
        (1, 1, "25000000"), (1, 2, "15000000"), (1, 3, "10000000"), (2, 2, "8000000"), (4, 1, "30000000"),
        (4, 3, "25000000")]),
    "distributes": ("distributor_id film_id distribution_fee distribution_date territory", [
        (1, 1, "40000000", "2024-02-01", "Worldwide"), (2, 1, "0", "2024-02-01", "Domestic"),
        (3, 4, "50000000", "2024-11-01", "North America")]),
    "works_on": ("crew_id film_id start_date end_date department", [
        (1, 1, "2023-04-01", "2023-08-15", "Camera"), (2, 1, "2023-04-01", "2023-07-30", "Lighting"),
        (3, 1, "2023-06-01", "2023-09-01", "Editing"), (1, 4, "2024-01-05", "2024-06-30", "Camera"),
        (4, 4, "2024-02-01", "2024-06-15", "Sound")]),
    "shot_at": ("film_id location_id shooting_start shooting_end total_cost", [
        (1, 1, "2023-05-20", "2023-06-05", "200000"), (1, 2, "2023-06-10", "2023-06-20", "150000"),
        (4, 2, "2024-02-01", "2024-03-15", "800000"), (4, 3, "2024-03-16", "2024-04-05", "300000")]),
    "scene_filming": ("filming_id film_id scene_id crew_id equipment_id filming_date duration_minutes", [
        (1, 1, 1, 1, 1, "2023-05-20", 480), (2, 1, 2, 2, 3, "2023-05-22", 360), (3, 2, 3, 3, 2, "2023-10-12", 120),
        (4, 4, 4, 1, 2, "2024-02-20", 1200), (5, 4, 5, 4, 4, "2024-03-01", 480)]),
    "film_crew_equipment": ("film_id crew_id equipment_id days_used efficiency_rating maintenance_required", [
        (1, 1, 1, 45, "9.1", False), (1, 2, 3, 20, "8.0", False), (4, 1, 2, 60, "8.8", True)]),
    "actor_award": ("actor_id award_name award_year", [
        (1, "Best Actor - Sci-Fi Fest", 2024), (3, "Best Supporting Actor", 2020)]),
    "director_award": ("director_id award_name award_year", [
        (1, "Visionary Director", 2023), (4, "Best Director - Int. Festival", 2022)]),
    "crew_award": ("crew_id award_name award_year", [(1, "Best Cinematography", 2024), (3, "Best Editing", 2021)]),
    "user_metadata": ("username full_name role is_active", [("admin", "System Administrator", "admin", True)]),
    "user_activity_log": ("log_id username action_type", []),
}


def tables(spark: SparkSession) -> dict[str, DataFrame]:
    loaded = {}
    for name, (names, values) in ROWS.items():
        table = TABLES[name]
        columns = [table.column(c) for c in names.split()]
        loose = ", ".join(f"`{c.name}` {c.type if c.type in ('int', 'boolean') else 'string'}" for c in columns)
        frame = spark.createDataFrame(values, loose)
        frame = frame.select(*[F.col(c.name).cast(c.type).alias(c.name) for c in columns])
        loaded[name] = fill_defaults(frame, table, dt.datetime(2024, 12, 31, 12, 0, 0))
    return loaded
