"""Registered queries of the engine's own operators, and the DuckDB SQL that gives the same rows.

Each query sets up an engine over the tables of a folder and asks it through the interface it is about: typed row queries, graphs,
SQL, files or versioned tables.
"""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.calendar import TimeContext
from marlstone.plans import catalog as C
from marlstone.session import Engine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


# -- set-up -----------------------------------------------------------------------------------------------------

CENTS = "cast(round({} * 100) as bigint)"
#: Views as the engine has them, and as DuckDB does (fixed pairs).
LINES = "select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus, cast(l_quantity as bigint) as quantity, cast(round(l_extendedprice * 100) as bigint) as cents, l_extendedprice as price, l_shipdate from lineitem"
ORDERS = "select o_orderkey, o_custkey, o_orderstatus, cast(round(o_totalprice * 100) as bigint) as cents, o_orderdate from orders"
DUCK = f"with lines as ({LINES}), sales as ({ORDERS})"


def policy(field: str, operator: str, kind: str, value) -> tuple[C.Filter, ...]:
    return (C.Filter(field, operator, {"type": kind, "value": value}),)


def engine(spark: SparkSession, sf: str, *names: str, lines: C.Meaning | None = None, sales: C.Meaning | None = None, customer: C.Meaning | None = None, nation: C.Meaning | None = None, events: C.Meaning | None = None) -> Engine:
    e = Engine(spark)
    meanings = {"customer": customer, "nation": nation}
    base = {"lines": "lineitem", "sales": "orders", "happenings": "events"}
    for n in names:
        source = base.get(n, n)
        e.register(source, e.spark.read.parquet(f"{sf}/{source}.parquet"), meanings.get(source))
        if n == "lines":
            e.view("lines", LINES, lines)
        if n == "sales":
            e.view("sales", "select o_orderkey, o_custkey, o_orderstatus, cast(round(o_totalprice * 100) as bigint) as cents, cast(o_orderdate as timestamp) as ordered_at, cast(o_orderdate as date) as ordered_on from orders", sales)
        if n == "happenings":
            e.view("happenings", "select event_id, user_id, event_type, cast(round(value * 100) as bigint) as amount, cast(ts as timestamp) as at, cast(ts as date) as on_day from events", events)
    return e


def proposal(relation: str, **operations) -> dict:
    """A row query from requirements by id."""
    return {"version": 1, "input": {"relation": relation, "instance": "x"}, "unresolved": [], "requirements": [{"id": k, "source_text": k, "operation": o} for k, o in operations.items()]}


def fld(name: str, instance: str = "x") -> dict:
    return {"instance": instance, "field": name}


def project(name: str, alias: str | None = None) -> dict:
    return {"kind": "project", "field": fld(name), "alias": alias or name}


def group(name: str, alias: str | None = None) -> dict:
    return {"kind": "group", "field": fld(name), "alias": alias or name}


def agg(function: str, name: str | None, alias: str, distinct: bool = False) -> dict:
    return {"kind": "aggregate", "function": function, "field": fld(name) if name else None, "distinct": distinct, "alias": alias}


def compare(name: str, operator: str, kind: str, value, ref: dict | None = None) -> dict:
    return {"kind": "compare", "field": ref or fld(name), "operator": operator, "value": {"type": kind, "value": value}}


def where(predicate: dict) -> dict:
    return {"kind": "filter", "predicate": predicate}


def by(slot: str, direction: str = "asc", nulls: str = "last") -> dict:
    return {"kind": "order_output", "slot": slot, "direction": direction, "nulls": nulls}


def by_field(name: str, direction: str = "asc", nulls: str = "last") -> dict:
    return {"kind": "order", "field": fld(name), "direction": direction, "nulls": nulls}


def q18(n: str, d: str, zero: str = "null") -> str:
    """DuckDB: n / d with 18 decimals, cut toward zero."""
    q = f"((({n})::hugeint * 1000000000000000000::hugeint) // nullif(({d})::hugeint, 0))"
    text = f"((case when {q} < 0 then '-' else '' end) || (abs({q}) // 1000000000000000000::hugeint)::varchar || '.' || lpad((abs({q}) % 1000000000000000000::hugeint)::varchar, 18, '0'))::decimal(38,18)"
    return f"case when ({d}) = 0 and ({n}) is not null then 0::decimal(38,18) else {text} end" if zero == "zero" else text


# -- rows -------------------------------------------------------------------------------------------------------


@query("select c_custkey, c_name, c_acctbal from customer where c_mktsegment = 'BUILDING' and (c_acctbal > 0 or c_acctbal < -500) and not c_nationkey = 3 order by c_custkey limit 50 offset 10")
def typed_project_filter_page(spark, sf):
    e = engine(spark, sf, "customer")
    kind = {"bigint": "int64", "int": "int32"}[e.catalog.current.relation("customer").schema["c_nationkey"].dataType.simpleString()]
    return e.rows(proposal(
        "customer",
        only=where({"kind": "all", "predicates": [
            compare("c_mktsegment", "eq", "utf8", "BUILDING"),
            {"kind": "any", "predicates": [compare("c_acctbal", "gt", "float64", 0.0), compare("c_acctbal", "lt", "float64", -500.0)]},
            {"kind": "not", "predicate": compare("c_nationkey", "eq", kind, 3)},
        ]}),
        k=project("c_custkey"), n=project("c_name"), b=project("c_acctbal"), o=by_field("c_custkey"), p={"kind": "page", "offset": 10, "fetch": 50},
    )).result()


@query(f"{DUCK} select l_returnflag, l_linestatus, count(*)::bigint as n, count(distinct l_suppkey)::bigint as suppliers, sum(cents)::bigint as total, min(l_shipdate) as first_day, max(cents) as most from lines group by all")
def group_checked_sum(spark, sf):
    e = engine(spark, sf, "lines")
    return e.rows(proposal("lines", f=group("l_returnflag"), s=group("l_linestatus"), n=agg("count", None, "n"), d=agg("count", "l_suppkey", "suppliers", True), t=agg("sum", "cents", "total"), a=agg("min", "l_shipdate", "first_day"), z=agg("max", "cents", "most"))).result()


@query(f"{DUCK} select l_returnflag, {q18('sum(cents)', 'count(cents)')} as mean_cents from lines group by 1")
def exact_mean(spark, sf):
    return engine(spark, sf, "lines").rows(proposal("lines", f=group("l_returnflag"), m=agg("avg", "cents", "mean_cents"))).result()


@query(f"{DUCK} select l_returnflag, {q18('sum(cents)', 'sum(quantity)')} as unit_cents from lines group by 1")
def exact_ratio(spark, sf):
    part = lambda f: {"function": "sum", "field": fld(f), "distinct": False}
    return engine(spark, sf, "lines").rows(proposal("lines", f=group("l_returnflag"), r={"kind": "ratio", "numerator": part("cents"), "denominator": part("quantity"), "zero": "null", "alias": "unit_cents"})).result()


METRICS = C.Meaning(
    metrics=(
        C.Metric("line_count", "count", dimensions=frozenset({"l_returnflag"})),
        C.Metric("revenue", "sum", "cents", aliases=("sales",), dimensions=frozenset({"l_returnflag", "l_linestatus"}), rollup=frozenset({"l_linestatus"}), unit="cents"),
        C.Metric("open_revenue", "sum", "cents", dimensions=frozenset({"l_returnflag"}), filters=policy("l_linestatus", "eq", "utf8", "O")),
        C.Metric("mean_cents", "avg", "cents", dimensions=frozenset({"l_returnflag"}), state=("sum_count_average",)),
        C.Metric("price_per_item", "avg", "cents", dimensions=frozenset({"l_returnflag"}), state=("weighted_average", "cents", "quantity", "null")),
        C.Metric("parts", "count", "l_partkey", distinct=True, dimensions=frozenset({"l_returnflag"}), state=("exact_distinct", "l_partkey")),
    ),
    ratios=(C.Ratio("cents_per_line", "revenue", "line_count"),),
)


@query(f"{DUCK} select l_returnflag, {q18('sum(cents::hugeint * quantity)', 'sum(quantity)')} as weighted from lines group by 1")
def weighted_mean(spark, sf):
    return engine(spark, sf, "lines", lines=METRICS).rows(proposal("lines", f=group("l_returnflag"), m={"kind": "metric", "name": "price_per_item", "alias": "weighted"})).result()


@query(f"{DUCK} select l_returnflag, sum(cents)::bigint as revenue, (sum(cents) filter (where l_linestatus = 'O'))::bigint as open_revenue, {q18('sum(cents)', 'count(*)')} as per_line from lines group by 1")
def metric_local_filter(spark, sf):
    m = lambda name, alias: {"kind": "metric", "name": name, "alias": alias}
    return engine(spark, sf, "lines", lines=METRICS).rows(proposal("lines", f=group("l_returnflag"), r=m("sales", "revenue"), o=m("open_revenue", "open_revenue"), p=m("cents_per_line", "per_line"))).result()


@query(f"{DUCK} select l_returnflag, count(distinct l_partkey)::bigint as parts from lines group by 1")
def exact_distinct(spark, sf):
    return engine(spark, sf, "lines", lines=METRICS).rows(proposal("lines", f=group("l_returnflag"), m={"kind": "metric", "name": "parts", "alias": "parts"})).result()


@query("select c_mktsegment, count(*)::bigint as n from customer where c_acctbal >= 0 and c_mktsegment <> 'MACHINERY' group by 1")
def row_policy(spark, sf):
    e = engine(spark, sf, "customer", customer=C.Meaning(policies=(("solvent", policy("c_acctbal", "gt_eq", "float64", 0.0)), ("visible", policy("c_mktsegment", "not_eq", "utf8", "MACHINERY")))))
    return e.rows(proposal("customer", s=group("c_mktsegment"), n=agg("count", None, "n"))).result()


@query("select c_custkey from customer where c_mktsegment = 'BUILDING' and c_acctbal > 100.0")
def concept_and_mapping(spark, sf):
    e = engine(spark, sf, "customer", customer=C.Meaning(
        fields={"c_mktsegment": C.FieldMeaning(enum_domain="segment")}, mappings={"segments": ("segment", {"builders": "BUILDING"})},
        concepts=(C.Concept("rich", {"kind": "compare", "field": "c_acctbal", "operator": "gt", "value": {"parameter": "least", "type": "float64"}}, ("wealthy",), {"least": "float64"}),),
    ))
    return e.rows(proposal("customer", c={"kind": "concept_filter", "concept": "wealthy", "arguments": {"least": {"type": "float64", "value": 100.0}}}, m=where({"kind": "compare_mapped", "field": fld("c_mktsegment"), "operator": "eq", "mapping": "segments", "phrase": "builders"}), k=project("c_custkey"))).result()


@query("select c_custkey from customer where c_acctbal < 250.0 and c_name is not null")
def prepared_parameter(spark, sf):
    e = engine(spark, sf, "customer")
    q = proposal("customer", f=where({"kind": "all", "predicates": [{"kind": "compare_parameter", "field": fld("c_acctbal"), "operator": "lt", "parameter": "most"}, {"kind": "is_null", "field": fld("c_name"), "negated": True}]}), k=project("c_custkey"))
    return e.prepare(q, {"most": "float64"}).bind({"most": {"type": "float64", "value": 250.0}}).result()


# -- joins ------------------------------------------------------------------------------------------------------

TO_ORDERS = C.Meaning(relationships=(C.Relationship("orders", "sales", "buyer", (("c_custkey", "o_custkey"),)), C.Relationship("home", "nation", "home", (("c_nationkey", "n_nationkey"),))))
TO_CUSTOMER = C.Meaning(relationships=(C.Relationship("buyer", "customer", "buyer", (("o_custkey", "c_custkey"),)),), metrics=(C.Metric("turnover", "sum", "cents", lookup_dimensions=frozenset({("buyer", "c_mktsegment")})),))


def _related(spark, sf, mode):
    e = engine(spark, sf, "nation", "sales", "customer", customer=TO_ORDERS)
    pred = compare("cents", "gt", "int64", 10_000_000, fld("cents", "o"))
    return e.rows(proposal("customer", r={"kind": "related", "relationship": "orders", "role": "buyer", "instance": "o", "mode": mode, "predicate": pred}, k=project("c_custkey"))).result()


@query(f"{DUCK} select c_custkey from customer where exists (select 1 from sales where o_custkey = c_custkey and cents > 10000000)")
def related_exists(spark, sf):
    return _related(spark, sf, "exists")


@query(f"{DUCK} select c_custkey from customer where not exists (select 1 from sales where o_custkey = c_custkey and cents > 10000000)")
def related_absent(spark, sf):
    return _related(spark, sf, "absent")


def _lookup(spark, sf, missing):
    e = engine(spark, sf, "nation", "customer", "sales", customer=C.Meaning(relationships=TO_ORDERS.relationships[1:], policies=(("north", policy("c_acctbal", "gt", "float64", 0.0)),)), sales=TO_CUSTOMER)
    return e.rows(proposal("sales", l={"kind": "lookup", "relationship": "buyer", "role": "buyer", "instance": "c", "field": "c_name", "alias": "buyer", "missing": missing}, k=project("o_orderkey"))).result()


@query("select c_name as buyer, o_orderkey from orders left join (select * from customer where c_acctbal > 0) on o_custkey = c_custkey")
def lookup_null(spark, sf):
    return _lookup(spark, sf, "null")


@query("select c_name as buyer, o_orderkey from orders join customer on o_custkey = c_custkey where c_acctbal > 0")
def lookup_exclude(spark, sf):
    return _lookup(spark, sf, "exclude")


@query(f"{DUCK} select c_mktsegment as segment, sum(cents)::bigint as turnover from sales left join customer on o_custkey = c_custkey group by 1")
def grouped_lookup(spark, sf):
    e = engine(spark, sf, "nation", "customer", "sales", customer=C.Meaning(relationships=TO_ORDERS.relationships[1:]), sales=TO_CUSTOMER)
    return e.rows(proposal("sales", l={"kind": "lookup", "relationship": "buyer", "role": "buyer", "instance": "c", "field": "c_mktsegment", "alias": "segment", "missing": "null", "usage": "group"}, t={"kind": "metric", "name": "turnover", "alias": "turnover"})).result()


@query("select o_orderkey, n_name as nation from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey")
def path_lookup(spark, sf):
    e = engine(spark, sf, "nation", "customer", "sales", customer=C.Meaning(relationships=TO_ORDERS.relationships[1:]), sales=TO_CUSTOMER)
    hops = [{"relationship": "buyer", "role": "buyer", "instance": "c"}, {"relationship": "home", "role": "home", "instance": "n"}]
    return e.rows(proposal("sales", k=project("o_orderkey"), n={"kind": "path_lookup", "hops": hops, "field": "n_name", "alias": "nation", "missing": "null"})).result()


SPANS = "select user_id, since as valid_from, lead(since) over (partition by user_id order by since) as valid_to, mark from (select user_id, {ts} as since, max(event_id) as mark from {t} where event_type = 'purchase' group by 1, 2)"


@query(f"with spans as ({SPANS.format(ts='ts', t='events')}) select e.event_id, s.mark as last_purchase from events e left join spans s on e.user_id = s.user_id and e.ts >= s.valid_from and e.ts < s.valid_to")
def asof_interval(spark, sf):
    e = engine(spark, sf, "happenings", events=C.Meaning(relationships=(C.Relationship("last", "spans", "last", (("user_id", "user_id"),), interval=("valid_from", "valid_to")),)))
    e.view("spans", SPANS.format(ts="at", t="happenings"))
    hop = {"relationship": "last", "role": "last", "instance": "s", "as_of": {"fact_time": "at", "valid_from": "valid_from", "valid_to": "valid_to", "timezone": "UTC"}}
    return e.rows(proposal("happenings", k=project("event_id"), p={"kind": "path_lookup", "hops": [hop], "field": "mark", "alias": "last_purchase", "missing": "null"})).result()


# -- windows, output filters ------------------------------------------------------------------------------------


def window(function: str, alias: str, partition: list, order: list, frame: str, value=None) -> dict:
    return {"kind": "window", "function": function, "input": value, "partition_by": partition, "order_by": order, "frame": frame, "alias": alias}


def out(slot: str) -> dict:
    return {"kind": "output", "slot": slot}


def at_field(name: str) -> dict:
    return {"kind": "field", "field": fld(name)}


def ordered(x: dict, direction: str = "asc") -> dict:
    return {"input": x, "direction": direction, "nulls": "last"}


MONTHLY = f"{DUCK}, m as (select o_orderstatus as status, date_trunc('month', o_orderdate) as month, sum(cents)::bigint as total from sales group by 1, 2)"


def _monthly(**more):
    return proposal("sales", s=group("o_orderstatus", "status"), m={"kind": "calendar_group", "field": fld("ordered_at"), "grain": "month", "timezone": "UTC", "alias": "month"}, t=agg("sum", "cents", "total"), **more)


def _naive(df, *names):
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@query(f"{MONTHLY} select status, month, total, rank() over (partition by status order by total desc)::bigint as place, dense_rank() over (order by status)::bigint as block from m")
def window_rank(spark, sf):
    q = _monthly(r=window("rank", "place", [out("s")], [ordered(out("t"), "desc")], "through_current_peer"), d=window("dense_rank", "block", [], [ordered(out("s"))], "through_current_peer"))
    return _naive(engine(spark, sf, "sales").rows(q).result(), "month")


@query(f"{DUCK} select o_orderkey, (sum(cents) over (partition by o_custkey order by o_orderdate range between unbounded preceding and current row))::bigint as so_far, (count(*) over (partition by o_custkey))::bigint as orders, max(cents) over (partition by o_custkey) as most from sales")
def window_running_peer(spark, sf):
    p = [at_field("o_custkey")]
    q = proposal("sales", k=project("o_orderkey"), s=window("sum", "so_far", p, [ordered(at_field("ordered_at"))], "through_current_peer", at_field("cents")), n=window("count", "orders", p, [], "entire_partition"), m=window("max", "most", p, [], "entire_partition", at_field("cents")))
    return engine(spark, sf, "sales").rows(q).result()


@query(f"{MONTHLY} select status, month, total, (sum(total) over (partition by status order by month rows between unbounded preceding and current row))::bigint as running from m")
def cumulative_rows(spark, sf):
    q = _monthly(w=window("sum", "running", [out("s")], [ordered(out("m"))], "rows_through_current", out("t")))
    return _naive(engine(spark, sf, "sales").rows(q).result(), "month")


@query(f"{DUCK} select o_custkey, sum(cents)::bigint as total from sales group by 1 having sum(cents) > 100000000")
def having(spark, sf):
    return engine(spark, sf, "sales").rows(proposal("sales", c=group("o_custkey"), t=agg("sum", "cents", "total"), h={"kind": "filter_output", "stage": "after_aggregate", "predicate": compare("", "gt", "int64", 100_000_000, {"slot": "t"})})).result()


@query("select n, c_custkey, c_acctbal from (select c_nationkey as n, c_custkey, c_acctbal, rank() over (partition by c_nationkey order by c_custkey desc) as r from customer) where r <= 3")
def qualify(spark, sf):
    q = proposal("customer", n=project("c_nationkey", "n"), k=project("c_custkey"), b=project("c_acctbal"), r=window("rank", "r", [at_field("c_nationkey")], [ordered(at_field("c_custkey"), "desc")], "through_current_peer"), f={"kind": "filter_output", "stage": "after_window", "predicate": compare("", "lt_eq", "int64", 3, {"slot": "r"})})
    return engine(spark, sf, "customer").rows(q).result().drop("r")


@query("select event_id, value from events where value is not null order by value desc nulls last, event_id limit 25")
def top_k(spark, sf):
    e = engine(spark, sf, "events")
    return e.rows(proposal("events", f=where({"kind": "is_null", "field": fld("value"), "negated": True}), i=project("event_id"), v=project("value"), a=by_field("value", "desc"), b=by_field("event_id"), l={"kind": "limit", "count": 25})).result()


# -- calendars, rates, conversions ------------------------------------------------------------------------------

AT = TimeContext(dt.datetime(1996, 5, 17, 12, tzinfo=dt.timezone.utc), "UTC")


@query("select o_orderkey from orders where o_orderdate >= timestamp '1996-02-01' and o_orderdate < timestamp '1996-05-01'")
def calendar_filter(spark, sf):
    q = proposal("sales", f={"kind": "calendar_filter", "field": fld("ordered_at"), "period": {"unit": "month", "offset": -3, "count": 3}}, k=project("o_orderkey"))
    return engine(spark, sf, "sales").rows(q, context=AT).result()


@query("select date_trunc('month', o_orderdate) as month, count(*)::bigint as n from orders group by 1")
def calendar_group(spark, sf):
    q = proposal("sales", m={"kind": "calendar_group", "field": fld("ordered_at"), "grain": "month", "timezone": "UTC", "alias": "month"}, n=agg("count", None, "n"))
    return _naive(engine(spark, sf, "sales").rows(q).result(), "month")


@query("select s.month, coalesce(n, 0)::bigint as n from (select unnest(generate_series(timestamp '1998-01-01', timestamp '1999-12-01', interval 1 month)) as month) s left join (select date_trunc('month', o_orderdate) as month, count(*) as n from orders group by 1) o on s.month = o.month")
def calendar_fill(spark, sf):
    us = lambda y: int(dt.datetime(y, 1, 1, tzinfo=dt.timezone.utc).timestamp()) * 10**6
    q = proposal("sales", m={"kind": "calendar_group", "field": fld("ordered_at"), "grain": "month", "timezone": "UTC", "alias": "month"}, n=agg("count", None, "n"), z={"kind": "calendar_fill", "month_slot": "m", "count_slot": "n", "start_us": us(1998), "end_us": us(2000), "fill": 0})
    return _naive(engine(spark, sf, "sales").rows(q).result(), "month")


@query("select user_id, amount as balance from (select user_id, cast(round(value * 100) as bigint) as amount, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def snapshot_balance(spark, sf):
    m = C.Metric("balance", "max", "amount", dimensions=frozenset({"user_id"}), state=("snapshot_balance", "amount", "at", "event_id"))
    return engine(spark, sf, "happenings", events=C.Meaning(metrics=(m,))).rows(proposal("happenings", u=group("user_id"), b={"kind": "metric", "name": "balance", "alias": "balance"})).result()


@query(f"{DUCK} select o_orderkey, {q18('cents::hugeint * 3', '7')} as converted from sales")
def unit_convert(spark, sf):
    c = C.Conversion("thirds", "cents", 3, 7, "sevenths")
    return engine(spark, sf, "sales", sales=C.Meaning(conversions=(c,))).rows(proposal("sales", k=project("o_orderkey"), c={"kind": "convert", "conversion": "thirds", "alias": "converted"})).result()


#: Yearly rates and a calendar, as fixed rules: rate (year - 1990) / 7; fiscal years begin in October.
RATES = "select 'USD' as source, 'CHF' as target, {start} as valid_from, {end} as valid_to, cast({y} - 1990 as bigint) as numerator, cast(7 as bigint) as denominator from {years}"


@query(f"{DUCK} select o_orderkey, {q18('cents::hugeint * (extract(year from o_orderdate)::bigint - 1990)', '7')} as francs from sales")
def currency_convert(spark, sf):
    e = Engine(spark)
    e.register("orders", e.spark.read.parquet(f"{sf}/orders.parquet"))
    e.register("years", e.spark.range(1991, 2030).withColumnRenamed("id", "y"))
    e.view("rates", RATES.format(start="make_timestamp(cast(y as int), 1, 1, 0, 0, 0)", end="make_timestamp(cast(y as int) + 1, 1, 1, 0, 0, 0)", y="y", years="years"))
    r = C.Rates("dated", "cents", "currency", "ordered_at", "rates", "source", "target", "CHF", "valid_from", "valid_to", "numerator", "denominator")
    e.view("sales", "select o_orderkey, cast(round(o_totalprice * 100) as bigint) as cents, 'USD' as currency, cast(o_orderdate as timestamp) as ordered_at from orders", C.Meaning(rates=(r,)))
    return e.rows(proposal("sales", k=project("o_orderkey"), c={"kind": "currency_convert", "rate": "dated", "alias": "francs"})).result()


@query("select o_orderkey, (extract(year from o_orderdate) + case when extract(month from o_orderdate) >= 10 then 1 else 0 end)::int as fiscal_year, (isodow(o_orderdate) < 6) as business_day from orders")
def business_calendar(spark, sf):
    e = Engine(spark)
    e.register("orders", e.spark.read.parquet(f"{sf}/orders.parquet"))
    days = e.spark.range(0, 14_000).selectExpr("date_add(date '1990-01-01', cast(id as int)) as date")
    e.register("days", days.selectExpr("date", "cast(year(date) + if(month(date) >= 10, 1, 0) as int) as fiscal_year", "cast(month(date) as smallint) as fiscal_period", "weekday(date) < 5 as business_day"))
    e.view("sales", "select o_orderkey, cast(o_orderdate as date) as ordered_on from orders", C.Meaning(calendars=(C.BusinessCalendar("fiscal", "ordered_on", "days", "date"),)))
    b = lambda f: {"kind": "business_calendar", "calendar": "fiscal", "field": f, "alias": f}
    return e.rows(proposal("sales", k=project("o_orderkey"), y=b("fiscal_year"), d=b("business_day"))).result()


@query("""with b as (select l_orderkey, l_suppkey, sum(cast(l_quantity as bigint))::bigint as w from lineitem group by 1, 2),
s as (select l_orderkey, sum(w)::hugeint as sw from b group by 1),
x as (select b.l_suppkey, b.l_orderkey, b.w, sw, cast(round(o_totalprice * 100) as bigint) as a from b join s using (l_orderkey) join orders on o_orderkey = b.l_orderkey),
y as (select *, (a::hugeint * w) // sw as f, (a::hugeint * w) % sw as r from x),
z as (select *, f + case when row_number() over (partition by l_orderkey order by r desc, l_suppkey) <= a - sum(f) over (partition by l_orderkey) then 1 else 0 end as share from y)
select l_suppkey as supplier, sum(share)::bigint as cents from z group by 1""")
def allocation(spark, sf):
    e = engine(spark, sf, "lines")
    e.register("orders", e.spark.read.parquet(f"{sf}/orders.parquet"))
    e.view("parts_of", "select l_orderkey, l_suppkey, cast(sum(quantity) as bigint) as weight from lines group by l_orderkey, l_suppkey")
    e.view("expected", "select l_orderkey as k, count(*) as members, cast(sum(weight) as bigint) as whole from parts_of group by l_orderkey")
    a = C.Allocation("by_supplier", (("o_orderkey", "l_orderkey"),), "cents", "members", "whole", "parts_of", ("l_suppkey",), "weight")
    e.view("amounts", "select o_orderkey, cast(round(o_totalprice * 100) as bigint) as cents, members, whole from orders join expected on o_orderkey = k", C.Meaning(allocations=(a,)))
    return e.rows(proposal("amounts", a={"kind": "allocate", "allocation": "by_supplier", "target_aliases": ["supplier"], "amount_alias": "cents"})).result()


# -- graphs -----------------------------------------------------------------------------------------------------


def graph(nodes: dict, root: str, ordering=(), limit=None) -> dict:
    return {"version": 1, "nodes": [{"id": k, "source_text": k, "operation": o} for k, o in nodes.items()], "root": root, "ordering": list(ordering), "limit": limit, "unresolved": []}


def _set(spark, sf, operator, duplicates):
    e = engine(spark, sf, "lines", "sales")
    a = proposal("lines", k=project("l_linestatus", "status"), q=where(compare("quantity", "lt", "int64", 3)))
    b = proposal("sales", k=project("o_orderstatus", "status"))
    return e.graph(graph({"a": {"kind": "rows", "query": a}, "b": {"kind": "rows", "query": b}, "s": {"kind": "set", "left": "a", "right": "b", "operator": operator, "duplicates": duplicates, "columns": [{"id": "c", "left": "k", "right": "k", "alias": "status"}]}}, "s")).result()


def _register_sets():
    for op in ("union", "intersect", "except"):
        for dup in ("all", "distinct"):
            def run(spark, sf, op=op, dup=dup):
                return _set(spark, sf, op, dup)

            run.__name__ = f"{op}_{dup}"
            query(f"select l_linestatus as status from lineitem where cast(l_quantity as bigint) < 3 {op} {'all' if dup == 'all' else ''} select o_orderstatus as status from orders")(run)


_register_sets()

PER_STATUS = f"{DUCK}, a as (select l_linestatus as status, sum(cents)::bigint as line_cents from lines where quantity > 10 group by 1), b as (select o_orderstatus as status, sum(cents)::bigint as order_cents, count(*)::bigint as orders from sales group by 1)"


def _composed(keys=True, domain="union"):
    a = proposal("lines", q=where(compare("quantity", "gt", "int64", 10)), **({"s": group("l_linestatus", "status")} if keys else {}), t=agg("sum", "cents", "line_cents"))
    b = proposal("sales", **({"s": group("o_orderstatus", "status")} if keys else {}), t=agg("sum", "cents", "order_cents"), n=agg("count", None, "orders"))
    measure = lambda oid, side, slot, alias, missing="zero": {"id": oid, "side": side, "slot": slot, "alias": alias, "missing": missing}
    return {
        "a": {"kind": "rows", "query": a}, "b": {"kind": "rows", "query": b},
        "c": {"kind": "compose", "left": "a", "right": "b", **dict.fromkeys(("relationship", "role"), "status" if keys else ""), "relationship_relation": "lines" if keys else "", "domain": domain, "null_alignment": "match",
              "keys": [{"id": "k", "left": "s", "right": "s", "alias": "status"}] if keys else [], "outputs": [measure("l", "left", "t", "line_cents"), measure("o", "right", "t", "order_cents", "null"), measure("n", "right", "n", "orders")]},
    }


#: The grain at which lines and sales may be put side by side.
SIDE_BY_SIDE = C.Meaning(relationships=(C.Relationship("status", "sales", "status", (("l_linestatus", "o_orderstatus"),)),))


def _side_by_side(spark, sf) -> Engine:
    return engine(spark, sf, "sales", "lines", lines=SIDE_BY_SIDE)


@query(f"{PER_STATUS} select coalesce(a.status, b.status) as status, case when a.status is null then 0 else line_cents end as line_cents, order_cents, coalesce(orders, 0)::bigint as orders from a full join b on a.status is not distinct from b.status")
def compose_full(spark, sf):
    return _side_by_side(spark, sf).graph(graph(_composed(), "c")).result()


@query(f"{PER_STATUS} select a.status, line_cents, order_cents, orders from a join b on a.status = b.status")
def compose_intersection(spark, sf):
    return _side_by_side(spark, sf).graph(graph(_composed(domain="intersection"), "c")).result()


@query(f"{DUCK} select (select sum(cents)::bigint from lines where quantity > 10) as line_cents, (select sum(cents)::bigint from sales) as order_cents, (select count(*)::bigint from sales) as orders")
def compose_scalar(spark, sf):
    return engine(spark, sf, "lines", "sales").graph(graph(_composed(False), "c")).result()


JOINED = f"{PER_STATUS}, c as (select coalesce(a.status, b.status) as status, case when a.status is null then 0 else line_cents end as l, order_cents as o, coalesce(orders, 0)::bigint as n from a full join b on a.status is not distinct from b.status)"


@query(f"{JOINED} select status, {q18('l', 'n', 'zero')} as per_order from c where n > 0 or l > 0")
def post_calculate(spark, sf):
    nodes = _composed() | {
        "f": {"kind": "filter", "input": "c", "predicate": {"kind": "any", "predicates": [compare("", "gt", "int64", 0, {"slot": "n"}), compare("", "gt", "int64", 0, {"slot": "l"})]}},
        "d": {"kind": "calculate", "input": "f", "passthrough": [{"id": "k2", "slot": "k", "alias": "status"}], "ratios": [{"id": "r", "numerator": "l", "denominator": "n", "zero": "zero", "alias": "per_order"}]},
    }
    return _side_by_side(spark, sf).graph(graph(nodes, "d", [{"slot": "k2", "direction": "asc", "nulls": "last"}])).result()


def _after(spark, sf, kind, **body):
    nodes = _composed() | {"d": {"kind": kind, "input": "c", "passthrough": [{"id": "k2", "slot": "k", "alias": "status"}], **body}}
    return _side_by_side(spark, sf).graph(graph(nodes, "d")).result()


@query(f"{JOINED} select status, case when n > 100 then 'many' else 'few' end as size from c")
def post_conditional(spark, sf):
    text = lambda v: {"type": "utf8", "value": v}
    return _after(spark, sf, "conditional", outputs=[{"id": "x", "alias": "size", "when": compare("", "gt", "int64", 100, {"slot": "n"}), "then_value": text("many"), "else_value": text("few")}])


@query(f"{JOINED} select status, l::decimal(38,0) as wide from c")
def post_cast(spark, sf):
    return _after(spark, sf, "cast", casts=[{"id": "x", "slot": "l", "target": "decimal128_38_0", "alias": "wide"}])


@query(f"{JOINED} select status, o is null as lacks from c")
def post_null_test(spark, sf):
    return _after(spark, sf, "null_test", tests=[{"id": "x", "slot": "o", "operator": "is_null", "alias": "lacks"}])


@query(f"{JOINED} select status, l < o as less from c")
def post_compare_slots(spark, sf):
    return _after(spark, sf, "compare_slots", comparisons=[{"id": "x", "left": "l", "right": "o", "operator": "lt", "alias": "less"}])


# -- SQL, files, versioned tables -------------------------------------------------------------------------------


@query("select o_orderstatus, count(*)::bigint as n from orders where o_totalprice > 1000 and o_orderstatus <> 'P' group by 1")
def sql_view_chain(spark, sf):
    e = engine(spark, sf, "orders")
    e.view("dear", "select * from orders where o_totalprice > 1000")
    e.view("settled", "select * from dear where o_orderstatus <> 'P'")
    return e.sql("select o_orderstatus, count(*) as n from settled group by 1")


@query("with big as (select o_custkey, count(*) as n from orders group by 1 having count(*) > 1) select c_custkey, upper(c_name) as name, (select max(n) from big)::bigint as most from customer where c_custkey in (select o_custkey from big) and c_acctbal between -100 and 5000")
def sql_cte_subquery(spark, sf):
    e = engine(spark, sf, "orders", "customer")
    return e.sql("with big as (select o_custkey, count(*) as n from orders group by 1 having count(*) > 1) select c_custkey, upper(c_name) as name, (select max(n) from big) as most from customer where c_custkey in (select o_custkey from big) and c_acctbal between $1 and $2", [-100, 5000])


@query("select l_returnflag, l_linestatus, count(*)::bigint as n, (count(*) filter (where l_quantity > 25))::bigint as large from lineitem group by cube (l_returnflag, l_linestatus)")
def sql_cube(spark, sf):
    return engine(spark, sf, "lineitem").sql("select l_returnflag, l_linestatus, count(*) as n, count(*) filter (where l_quantity > 25) as large from lineitem group by cube (l_returnflag, l_linestatus)")


@query("select o.o_orderkey, c.c_name, row_number() over (partition by o_custkey order by o_orderkey)::int as nth, date_trunc('year', o_orderdate) as year, coalesce(nullif(o_orderstatus, 'P'), 'open') as status from orders o join customer c on o_custkey = c_custkey where c_name like 'Customer%' and not exists (select 1 from nation where n_nationkey = c_nationkey and n_nationkey > 20)")
def sql_joins_windows(spark, sf):
    e = engine(spark, sf, "orders", "customer", "nation")
    return _naive(e.sql("select o.o_orderkey, c.c_name, row_number() over (partition by o_custkey order by o_orderkey) as nth, date_trunc('year', o_orderdate) as year, coalesce(nullif(o_orderstatus, 'P'), 'open') as status from orders o join customer c on o_custkey = c_custkey where c_name like 'Customer%' and not exists (select 1 from nation where n_nationkey = c_nationkey and n_nationkey > 20)"), "year")


# -- what the rest leaves out -----------------------------------------------------------------------------------


@query(f"{DUCK} select l_returnflag, {q18('sum(cents)', 'count(cents)')} as mean from lines group by 1")
def mean_metric(spark, sf):
    return engine(spark, sf, "lines", lines=METRICS).rows(proposal("lines", f=group("l_returnflag"), m={"kind": "metric", "name": "mean_cents", "alias": "mean"})).result()


@query("select l_linestatus, sum(l_extendedprice::decimal(15,2))::decimal(25,2) as total, sum(l_quantity) as items, avg(l_quantity) as mean_items from lineitem group by 1")
def decimal_and_float_sums(spark, sf):
    e = engine(spark, sf, "lineitem")
    e.view("wide", "select l_linestatus, cast(l_extendedprice as decimal(15,2)) as price, cast(l_quantity as double) as items from lineitem")
    return e.rows(proposal("wide", s=group("l_linestatus"), t=agg("sum", "price", "total"), i=agg("sum", "items", "items"), m=agg("avg", "items", "mean_items"))).result()


@query("select count(*)::bigint as n, sum(c_custkey)::bigint as total, min(c_name) as least from customer where c_custkey < 0")
def global_on_empty(spark, sf):
    e = engine(spark, sf, "customer")
    e.view("some", "select cast(c_custkey as bigint) as c_custkey, c_name from customer")
    return e.rows(proposal("some", f=where(compare("c_custkey", "lt", "int64", 0)), n=agg("count", None, "n"), t=agg("sum", "c_custkey", "total"), m=agg("min", "c_name", "least"))).result()


def _null_keys(spark, sf, null_keys_match: bool) -> Engine:
    e = engine(spark, sf, "nation", "customer")
    e.view("places", "select n_name, nullif(n_nationkey, 3) as place from nation")
    e.view("people", "select c_custkey, nullif(c_nationkey, 3) as place from customer", C.Meaning(relationships=(C.Relationship("home", "places", "home", (("place", "place"),), null_keys_match),)))
    return e


@query("select c_custkey from customer")
def null_keys_match(spark, sf):
    q = proposal("people", r={"kind": "related", "relationship": "home", "role": "home", "instance": "p", "mode": "exists"}, k=project("c_custkey"))
    return _null_keys(spark, sf, True).rows(q).result()


@query("select c_custkey, case when c_nationkey <> 3 then n_name end as home from customer join nation on c_nationkey = n_nationkey")
def null_keys_differ(spark, sf):
    q = proposal("people", k=project("c_custkey"), l={"kind": "lookup", "relationship": "home", "role": "home", "instance": "p", "field": "n_name", "alias": "home", "missing": "null"})
    return _null_keys(spark, sf, False).rows(q).result()


@query("select event_id, (extract(year from t) + case when extract(month from t) >= 10 then 1 else 0 end)::int as fiscal_year, (isodow(t) < 6) as business_day from (select event_id, ts - interval 5 hour as t from events)")
def zoned_business_calendar(spark, sf):
    e = Engine(spark)
    e.register("events", e.spark.read.parquet(f"{sf}/events.parquet"))
    days = e.spark.range(0, 20_000).selectExpr("date_add(date '1990-01-01', cast(id as int)) as date")
    e.register("days", days.selectExpr("date", "cast(year(date) + if(month(date) >= 10, 1, 0) as int) as fiscal_year", "cast(month(date) as smallint) as fiscal_period", "weekday(date) < 5 as business_day"))
    e.view("happenings", "select event_id, cast(ts as timestamp) as at from events", C.Meaning(calendars=(C.BusinessCalendar("fiscal", "at", "days", "date", "Etc/GMT+5"),)))
    b = lambda f: {"kind": "business_calendar", "calendar": "fiscal", "field": f, "alias": f}
    return e.rows(proposal("happenings", k=project("event_id"), y=b("fiscal_year"), d=b("business_day"))).result()


@query("select o_orderkey from orders where o_orderdate >= timestamp '1996-04-01' and o_orderdate < timestamp '1996-05-01'")
def view_coverage(spark, sf):
    q = proposal("sales", f={"kind": "calendar_filter", "field": fld("ordered_at"), "period": {"unit": "month", "offset": -1, "count": 1}}, k=project("o_orderkey"))
    return engine(spark, sf, "sales", sales=C.Meaning(coverage=("month", dt.date(1995, 1, 1), dt.date(1997, 1, 1)))).rows(q, context=AT).result()


@query(f"{DUCK} select l_returnflag, l_linestatus, sum(cents)::bigint as revenue, (sum(sum(cents)) over (partition by l_returnflag))::bigint as of_flag from lines group by 1, 2")
def window_metric_rollup(spark, sf):
    q = proposal("lines", f=group("l_returnflag"), s=group("l_linestatus"), m={"kind": "metric", "name": "revenue", "alias": "revenue"}, w=window("sum", "of_flag", [out("f")], [], "entire_partition", out("m")))
    return engine(spark, sf, "lines", lines=METRICS).rows(q).result()


@query("select c_custkey, rank() over (order by c_nationkey desc)::bigint as place, dense_rank() over (order by c_mktsegment, c_nationkey)::bigint as block from customer")
def window_over_all_rows(spark, sf):
    q = proposal("customer", k=project("c_custkey"), r=window("rank", "place", [], [ordered(at_field("c_nationkey"), "desc")], "through_current_peer"), d=window("dense_rank", "block", [], [ordered(at_field("c_mktsegment")), ordered(at_field("c_nationkey"))], "through_current_peer"))
    return engine(spark, sf, "customer").rows(q).result()


@query(f"{DUCK} select o_custkey, sum(cents)::bigint as total from sales group by 1 order by total desc, o_custkey limit 20")
def order_by_output(spark, sf):
    return engine(spark, sf, "sales").rows(proposal("sales", c=group("o_custkey"), t=agg("sum", "cents", "total"), a=by("t", "desc"), b=by("c"), l={"kind": "limit", "count": 20})).result()


@query(f"{PER_STATUS} select status, orders from b order by orders desc, status limit 2")
def graph_order_limit(spark, sf):
    rows = proposal("sales", s=group("o_orderstatus", "status"), n=agg("count", None, "orders"))
    keys = [{"slot": "n", "direction": "desc", "nulls": "last"}, {"slot": "s", "direction": "asc", "nulls": "last"}]
    return engine(spark, sf, "sales").graph(graph({"a": {"kind": "rows", "query": rows}}, "a", keys, 2)).result()


def _register_differences():
    for dup in ("all", "distinct"):
        def run(spark, sf, dup=dup):
            e = engine(spark, sf, "lines", "sales")
            a = proposal("sales", k=project("o_orderstatus", "status"), q=where(compare("o_orderkey", "lt", "int64", 4000)))
            b = proposal("lines", k=project("l_linestatus", "status"), q=where(compare("quantity", "lt", "int64", 3)))
            return e.graph(graph({"a": {"kind": "rows", "query": a}, "b": {"kind": "rows", "query": b}, "s": {"kind": "set", "left": "a", "right": "b", "operator": "except", "duplicates": dup, "columns": [{"id": "c", "left": "k", "right": "k", "alias": "status"}]}}, "s")).result()

        run.__name__ = f"except_{dup}_rows_left"
        query(f"select o_orderstatus as status from orders where o_orderkey < 4000 except {'all' if dup == 'all' else ''} select l_linestatus as status from lineitem where cast(l_quantity as bigint) < 3")(run)


_register_differences()


@query("select coalesce(n_name, 'none') as nation, coalesce(c_name, 'nobody') as name from customer full join (select * from nation where n_nationkey < 10) on c_nationkey = n_nationkey")
def sql_full_join(spark, sf):
    return engine(spark, sf, "nation", "customer").sql("select coalesce(n_name, 'none') as nation, coalesce(c_name, 'nobody') as name from customer full join (select * from nation where n_nationkey < 10) on c_nationkey = n_nationkey")


@query("select n_name, r_name, c_custkey from customer right join nation on c_nationkey = n_nationkey and c_acctbal > 5000 cross join (select r_name from region where r_regionkey < 2)")
def sql_right_and_cross_joins(spark, sf):
    return engine(spark, sf, "nation", "customer", "region").sql("select n_name, r_name, c_custkey from customer right join nation on c_nationkey = n_nationkey and c_acctbal > 5000 cross join (select r_name from region where r_regionkey < 2)")


@query("select l_returnflag, l_linestatus, count(*)::bigint as n, 'rollup' as kind from lineitem group by rollup (l_returnflag, l_linestatus) union all select l_returnflag, l_linestatus, count(*)::bigint, 'sets' from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())")
def sql_rollup_and_grouping_sets(spark, sf):
    return engine(spark, sf, "lineitem").sql("select l_returnflag, l_linestatus, count(*) as n, 'rollup' as kind from lineitem group by rollup (l_returnflag, l_linestatus) union all select l_returnflag, l_linestatus, count(*), 'sets' from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())")


@query("select c_custkey, sqrt(c_custkey::double) as root, (c_custkey // 7)::bigint as whole, abs(c_acctbal) as size, c_custkey % 7 as rest, upper(substr(c_name, 1, 3)) || lower(c_mktsegment) as tag, length(trim(c_name))::int as n, case when c_name like '%1' then 'one' when c_nationkey in (1, 2) then 'some' else 'other' end as kind from customer")
def sql_scalars(spark, sf):
    return engine(spark, sf, "customer").sql("select c_custkey, sqrt(c_custkey) as root, c_custkey div 7 as whole, abs(c_acctbal) as size, c_custkey % 7 as rest, upper(substr(c_name, 1, 3)) || lower(c_mktsegment) as tag, length(trim(c_name)) as n, case when c_name like '%1' then 'one' when c_nationkey in (1, 2) then 'some' else 'other' end as kind from customer")


@query("select extract(year from o_orderdate)::int as y, extract(quarter from o_orderdate)::int as q, count(*)::bigint as n, count(distinct extract(month from o_orderdate))::bigint as months from orders group by 1, 2")
def sql_extract(spark, sf):
    return engine(spark, sf, "orders").sql("select extract(year from o_orderdate) as y, extract(quarter from o_orderdate) as q, count(*) as n, count(distinct extract(month from o_orderdate)) as months from orders group by 1, 2")


@query("select v.id, v.label, n_name from (values (1, 'a'), (2, null), (7, 'c')) v(id, label) left join nation on n_nationkey = v.id")
def typed_values(spark, sf):
    return engine(spark, sf, "nation").sql("select v.id, v.label, n_name from (values (1, 'a'), (2, null), (7, 'c')) as v(id, label) left join nation on n_nationkey = v.id")


@query("""with a as (select c_custkey, c_acctbal < 0 and c_custkey >= 10 as hit, c_acctbal, c_mktsegment from customer),
b as (select c_custkey, case when hit then c_acctbal + 1 else c_acctbal end as c_acctbal, case when hit then 'back' else c_mktsegment end as segment from a)
select c_custkey, case when c_custkey % 3 = 0 then 0.5 else c_acctbal end as c_acctbal, case when c_custkey % 3 = 0 then 'third' else segment end as segment from b where not c_acctbal > 9000
union all select -c_custkey, c_acctbal, 'new' from customer where c_custkey between 1 and 10""")
def sql_writes(spark, sf):
    from marlstone.sources.generations import Generations

    e = engine(spark, sf, "customer")
    e.view("accounts", "select cast(c_custkey as bigint) as c_custkey, cast(c_acctbal as double) as c_acctbal, c_mktsegment as segment from customer")
    table = Generations(e.spark, _folder(spark))
    table.create(e.sql("select * from accounts").schema, ("c_custkey",))
    e.bind("balances", table)
    e.write("insert into balances select * from accounts")
    e.write("update balances set c_acctbal = c_acctbal + 1, segment = $1 where c_acctbal < 0 and c_custkey >= $2", ["back", 10])
    e.write("delete from balances where c_acctbal > $1", [9000.0])
    e.view("thirds", "select c_custkey, cast(0.5 as double) as c_acctbal, 'third' as segment from accounts where c_custkey % 3 = 0")
    merge = "require idempotent merge into balances t using thirds s on t.c_custkey = s.c_custkey when matched then update set c_acctbal = s.c_acctbal, segment = s.segment"
    if not e.write(merge).rows or e.write(merge).rows:
        raise RuntimeError("a merge isn't idempotent")
    e.view("fresh", "select -c_custkey as c_custkey, c_acctbal, 'new' as segment from accounts where c_custkey between 1 and 10")
    e.write("merge into balances t using fresh s on t.c_custkey = s.c_custkey when matched then update set c_acctbal = s.c_acctbal, segment = s.segment when not matched then insert (c_custkey, c_acctbal, segment) values (s.c_custkey, s.c_acctbal, s.segment)")
    return e.sql("select * from balances")


def _folder(spark: SparkSession) -> str:
    """A new folder that all machines see: under the checkpoint folder, or a local one where there is none."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all machines see")
    return f"{shared.rstrip('/')}/tables-{uuid.uuid4().hex}" if shared else "file://" + tempfile.mkdtemp(prefix="marlstone-")


@query("select n_nationkey, n_name from nation")
def files_round_trip(spark, sf):
    from marlstone.sources.files import FileSource, read

    place = _folder(spark)
    rows = spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", "n_name")
    rows.write.option("header", True).csv(f"{place}/csv")
    rows.write.json(f"{place}/json")
    a = read(spark, FileSource(f"{place}/csv", "csv", rows.schema, null_regex="NULL"))
    b = read(spark, FileSource(f"{place}/json", "ndjson", rows.schema))
    return a.intersectAll(b)


@query("select c_custkey, case when c_custkey % 2 = 0 then c_acctbal + 1 else c_acctbal end as c_acctbal from customer where c_custkey % 5 <> 0 union all select -c_custkey, c_acctbal from customer where c_custkey % 7 = 0")
def merge_idempotent(spark, sf):
    from marlstone.sources.generations import Generations

    rows = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_acctbal")
    table = Generations(spark, _folder(spark))
    table.create(rows.schema, ("c_custkey",))
    table.insert(rows, rows.columns)
    table.delete("c_custkey % 5 = 0")
    change = rows.where("c_custkey % 2 = 0 and c_custkey % 5 <> 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    change = change.unionByName(rows.where("c_custkey % 7 = 0").withColumn("c_custkey", -F.col("c_custkey")))
    table.merge(change)
    again = table.merge(change)
    if again.rows:
        raise RuntimeError("a merge isn't idempotent")
    return table.read()


@query("select o_orderpriority_is_set, n from (select true as o_orderpriority_is_set, count(*)::bigint as n from orders where o_totalprice > 5000)")
def materialized_view(spark, sf):
    from marlstone.sources.generations import Materialized

    e = engine(spark, sf, "orders")
    kept = Materialized(spark, _folder(spark))
    build = lambda: e.sql("select true as o_orderpriority_is_set, count(*) as n from orders where o_totalprice > 5000")
    kept.get("big", e.catalog.current.id, build, 60)
    return kept.get("big", e.catalog.current.id, build, 60)
