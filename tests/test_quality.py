import datetime as dt
import random

from conftest import rows
from pyspark.sql import functions as F

from callboard.operators import quality as Q
from callboard.sources.model import TABLES, references

AS_OF = dt.date(2024, 12, 31)


def broken_ids(df, rule, key):
    return [r[0] for r in rows(Q.broken_rows(df, rule, [key]), key)]


def test_null_passes_every_comparison_rule(make):
    df = make([(1, None, None, None)], "id int, x decimal(5,2), s string, d date")
    rules = [
        Q.at_least("x", 0), Q.in_range("x", 0, 10), Q.above("x", 0), Q.one_of("s", ["a"]), Q.max_length("s", 1),
        Q.min_age("d", 18, AS_OF, "age", "m"), Q.ordered_dates("d", "d", "dates", "m"), Q.same_value("s", "s"),
    ]
    assert [broken_ids(df, rule, "id") for rule in rules] == [[]] * len(rules)
    assert broken_ids(df, Q.not_null("x"), "id") == [1]
    assert broken_ids(df, Q.filled_in("s"), "id") == [1]


def test_business_rules_and_their_messages(make):
    films = make([(1, "99999.99"), (2, "100000"), (3, None)], "id int, budget decimal(15,2)")
    (rule,) = Q.business_rules("film", AS_OF)
    assert broken_ids(films, rule, "id") == [1] and rule.message == "Minimum film budget is $100,000"
    actors = make([(1, "2007-01-01"), (2, "2006-12-31"), (3, None)], "id int, dob date")
    assert broken_ids(actors, Q.business_rules("actor", AS_OF)[0], "id") == [1]
    shot = make([(1, "2024-01-02", "2024-01-01"), (2, "2024-01-01", None), (3, "2024-01-01", "2024-01-01")],
                "id int, shooting_start date, shooting_end date")
    assert broken_ids(shot, Q.business_rules("shot_at", AS_OF)[0], "id") == [1]
    assert Q.business_rules("studio", AS_OF) == []


def test_keys_with_a_null_never_collide(make):
    df = make([(1, "x"), (1, "x"), (2, None), (2, None)], "a int, b string")
    assert rows(Q.duplicate_keys(df, ["a", "b"])) == [(1, "x", 2)]
    marked = Q.check(df, [Q.Unique("uq", "dup", ("a", "b"))])
    assert rows(marked, "a", "is_valid") == [(1, False), (1, False), (2, True), (2, True)]


def test_orphans_leave_null_keys_alone(make):
    child = make([(1, 1), (2, 9), (3, None)], "id int, p int")
    parent = make([(1,), (1,)], "k int")
    assert rows(Q.orphans(child, ["p"], parent, ["k"])) == [(2, 9)]
    rule = Q.Reference("fk", "No such parent", ("p",), "parent", ("k",))
    assert rows(Q.violations(child, [rule], ["id"], {"parent": parent})) == [(2, "fk", "No such parent")]


def test_a_row_lists_all_the_rules_it_breaks(make):
    df = make([(1, "-1", "zzz"), (2, "5", "a")], "id int, x decimal(5,2), s string")
    rules = [Q.at_least("x", 0, "low", "too low"), Q.max_length("s", 2, "long")]
    assert rows(Q.violations(df, rules, ["id"])) == [(1, "long", "s is longer than 2"), (1, "low", "too low")]
    valid, bad = Q.validate(df, rules)
    assert rows(valid) == [(2, "5.00", "a")] and bad.columns == ["id", "x", "s", "violations"]


def test_seed_satisfies_all_declared_and_business_rules(seed):
    for name, frame in seed.items():
        rules = [*Q.declared_rules(TABLES[name]), *Q.business_rules(name, AS_OF)]
        assert Q.validate(frame, rules, seed)[1].count() == 0, name


def test_declared_rules_catch_each_kind_of_fault(seed, make):
    table = TABLES["film"]
    bad = make(
        [(1, None, "1", 0, "11.0", 9, "Lost"), (1, "t" * 201, "-5", 5, "5.0", None, "Released")],
        "film_id int, title string, budget decimal(15,2), duration int, rating decimal(3,1), fk_director_id int, "
        "production_status string",
    )
    from callboard.operators.changes import fill_defaults

    frame = fill_defaults(bad, table, dt.datetime(2024, 1, 1))
    found = rows(Q.violations(frame, Q.declared_rules(table), ["film_id"], seed), "rule_id")
    assert [r[0] for r in found] == sorted([
        "budget_check", "duration_range", "film_fk_director_id_fk", "film_pk", "film_pk", "production_status_domain",
        "rating_range", "title_length", "title_required"])


def test_valid_and_quarantined_rows_add_up(spark):
    pick = random.Random(3)
    data = [(i, pick.choice([None, -1.0, 3.0, 12.0]), pick.choice("abc")) for i in range(500)]
    df = spark.createDataFrame(data, "id int, x double, s string")
    rules = [Q.in_range("x", 0, 10), Q.one_of("s", ["a", "b"]), Q.Unique("u", "m", ("id",))]
    valid, bad = Q.validate(df, rules)
    assert rows(valid.unionByName(bad.drop("violations"))) == rows(df)
    expected = [i for i, x, s in data if (x is None or 0 <= x <= 10) and s in "ab"]
    assert sorted(r.id for r in valid.collect()) == expected


def test_model_has_all_tables_keys_and_references():
    assert len(TABLES) == 31
    refs = references()
    assert len(refs) == 31 and sum(r.on_delete == "set null" for _, r in refs) == 3
    assert sum(len(t.key) > 1 for t in TABLES.values()) == 13
    assert sum(len(t.unique) for t in TABLES.values()) == 4
    order = list(dict.fromkeys(c for c, _ in refs))
    assert order.index("scene") < order.index("scene_filming")


def test_reconcile_is_exact_and_null_safe(make):
    stored = make([(1, "10.00"), (2, "10.01"), (3, None), (4, "0.00"), (5, None)], "id int, cost decimal(6,2)")
    wanted = F.when(F.col("id") < 3, F.lit(10)).when(F.col("id") == 3, F.lit(7)).when(F.col("id") == 4, F.lit(10**7))
    found = rows(Q.reconcile(stored, ["id"], {"cost": wanted}))
    assert found == [(2, "10.01", "10.00", "0.01"), (3, None, "7.00", None), (4, "0.00", None, None)]
