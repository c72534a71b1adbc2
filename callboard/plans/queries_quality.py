"""Data-quality rules on the driver tables."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from callboard.operators import quality as Q
from callboard.plans import bindings as B
from callboard.plans.registry import Data, query

AS_OF = dt.date(2010, 12, 31)


@query(
    "dq_unique",
    "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def _(d):
    return Q.duplicate_keys(d["lineitem"], ["l_orderkey", "l_linenumber"])


@query(
    "dq_orphans",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0)""",
)
def _(d):
    solvent = d["customer"].where("c_acctbal >= 0")
    return Q.orphans(d["orders"], ["o_custkey"], solvent, ["c_custkey"]).select("o_orderkey", "o_custkey")


def _expected(keys: str, rule_id: str, message: str, source: str, broken: str) -> str:
    return f"SELECT {keys}, '{rule_id}' AS rule_id, '{message}' AS message FROM {source} WHERE {broken}"


@query(
    "dq_not_null",
    "SELECT o_orderkey, 'shipped_required' AS rule_id, 'shipped cannot be null' AS message "
    "FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY l_orderkey) "
    "ON l_orderkey = o_orderkey WHERE shipped IS NULL",
)
def _(d):
    shipped = d["lineitem"].groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    rows = d["orders"].join(shipped, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return Q.broken_rows(rows, Q.not_null("shipped"), ["o_orderkey"])


@query(
    "dq_range",
    _expected("c_custkey", "c_acctbal_min", "c_acctbal cannot be below 0", "customer", "c_acctbal < 0"),
)
def _(d):
    return Q.broken_rows(d["customer"], Q.at_least("c_acctbal", 0), ["c_custkey"])


@query(
    "dq_domain",
    _expected(
        "o_orderkey", "o_orderstatus_domain", "o_orderstatus must be one of O, F", "orders",
        "o_orderstatus NOT IN ('O', 'F')",
    ),
)
def _(d):
    return Q.broken_rows(d["orders"], Q.one_of("o_orderstatus", ["O", "F"]), ["o_orderkey"])


@query(
    "dq_length",
    _expected("p_partkey", "p_name_length", "p_name is longer than 9", "part", "length(p_name) > 9"),
)
def _(d):
    return Q.broken_rows(d["part"], Q.max_length("p_name", 9), ["p_partkey"])


@query(
    "dq_min_value",
    _expected(
        "film_id", "film_budget_minimum", "Minimum film budget is $100,000",
        "(SELECT o_orderkey AS film_id, CAST(o_totalprice AS DECIMAL(15,2)) AS budget FROM orders)",
        "budget < 100000",
    ),
)
def _(d):
    (rule,) = Q.business_rules("film", AS_OF)
    return Q.broken_rows(B.film_plain(d), rule, ["film_id"])


@query(
    "dq_min_age",
    _expected(
        "o_orderkey", "actor_min_age", "Actor must be at least 18 years old", "orders",
        "2010 - year(o_orderdate) < 18",
    ),
)
def _(d):
    (rule,) = Q.business_rules("actor", AS_OF)
    return Q.broken_rows(d["orders"].withColumnRenamed("o_orderdate", "dob"), rule, ["o_orderkey"])


@query(
    "dq_date_order",
    """SELECT l_orderkey, l_linenumber, 'shooting_dates' AS rule_id,
  'Shooting end date cannot be before start date' AS message
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate""",
)
def _(d):
    (rule,) = Q.business_rules("shot_at", AS_OF)
    rows = d["lineitem"].join(d["orders"], F.col("o_orderkey") == F.col("l_orderkey")).select(
        "l_orderkey",
        "l_linenumber",
        F.col("o_orderdate").alias("shooting_start"),
        F.col("l_shipdate").alias("shooting_end"),
    )
    return Q.broken_rows(rows, rule, ["l_orderkey", "l_linenumber"])


@query(
    "dq_required",
    """WITH f AS (SELECT c_custkey, c_name AS username, CASE WHEN c_acctbal < 0 THEN ' ' ELSE c_mktsegment END AS given,
  c_mktsegment AS repeated FROM customer)
SELECT c_custkey, 'required_fields' AS rule_id, 'username, given must be filled in' AS message FROM f
WHERE username IS NULL OR given IS NULL OR trim(username) = '' OR trim(given) = ''
UNION ALL SELECT c_custkey, 'given_matches_repeated', 'given and repeated do not match' FROM f
WHERE given <> repeated""",
)
def _(d):
    form = d["customer"].select(
        "c_custkey",
        F.col("c_name").alias("username"),
        F.when(F.col("c_acctbal") < 0, F.lit(" ")).otherwise(F.col("c_mktsegment")).alias("given"),
        F.col("c_mktsegment").alias("repeated"),
    )
    rules = [Q.filled_in("username", "given"), Q.same_value("given", "repeated")]
    return Q.violations(form, rules, ["c_custkey"])


def order_rules() -> list[Q.AnyRule]:
    return [
        Q.at_least("o_totalprice", Decimal(100000), "price_minimum", "Price below 100000"),
        Q.one_of("o_orderstatus", ["O", "F"], "status_domain"),
        Q.not_null("o_custkey", "customer_required"),
        Q.Reference("customer_fk", "No such customer", ("o_custkey",), "customer", ("c_custkey",)),
    ]


@query(
    "dq_quarantine",
    """SELECT o_orderkey, rule_id, message FROM (
  SELECT *, unnest(['price_minimum', 'status_domain', 'customer_required', 'customer_fk']) AS rule_id,
    unnest(['Price below 100000', 'o_orderstatus must be one of O, F', 'o_custkey cannot be null',
      'No such customer']) AS message,
    unnest([o_totalprice < 100000, o_orderstatus NOT IN ('O', 'F'), o_custkey IS NULL,
      o_custkey IS NOT NULL AND c_custkey IS NULL]) AS broken
  FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) ON c_custkey = o_custkey)
WHERE broken""",
)
def _(d):
    refs = {"customer": d["customer"].where("c_acctbal >= 0")}
    return Q.violations(d["orders"], order_rules(), ["o_orderkey"], refs)


@query(
    "dq_valid_rows",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM orders JOIN customer ON c_custkey = o_custkey AND c_acctbal >= 0
WHERE coalesce(o_totalprice >= 100000, true) AND coalesce(o_orderstatus IN ('O', 'F'), true)""",
)
def _(d):
    valid, _ = Q.validate(d["orders"], order_rules(), {"customer": d["customer"].where("c_acctbal >= 0")})
    return valid


def event_rules() -> list[Q.AnyRule]:
    """Row rules for arriving events, shared by the batch and the streaming form."""
    return [
        Q.at_least("value", 5, "value_minimum", "Value below 5"),
        Q.one_of("event_type", ["view", "click", "purchase", "signup"], "event_domain"),
        Q.not_null("user_id", "user_required"),
    ]


EVENT_VIOLATIONS = """SELECT event_id, rule_id, message FROM (
  SELECT *, unnest(['value_minimum', 'event_domain', 'user_required']) AS rule_id,
    unnest(['Value below 5', 'event_type must be one of view, click, purchase, signup',
      'user_id cannot be null']) AS message,
    unnest([value < 5, event_type NOT IN ('view', 'click', 'purchase', 'signup'), user_id IS NULL]) AS broken
  FROM events) WHERE broken"""


@query("dq_events", EVENT_VIOLATIONS)
def _(d: Data):
    return Q.violations(d["events"], event_rules(), ["event_id"])
