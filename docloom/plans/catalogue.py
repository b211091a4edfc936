"""The registered queries: a request in the query language for each operator, and equivalent SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Collection, Index, Relation
from ..engine import Engine
from ..functions import arrays, crdt
from ..operators import lens, mutate
from ..sources import backup
from ..sources import commits as log
from ..sources.storage import shared_dir
from ..spec import Plain, Select
from ..streaming import merge
from ..types import QueryError

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "labels": "doc_id", "conversations": "conv_id", "pages": "page_id"}
#: name, target, several, own column, other column
RELATIONS = {
    "region": [("nations", "nation", True, "r_regionkey", "n_regionkey")],
    "nation": [("region", "region", False, "n_regionkey", "r_regionkey"), ("customers", "customer", True, "n_nationkey", "c_nationkey"), ("suppliers", "supplier", True, "n_nationkey", "s_nationkey")],
    "customer": [("nation", "nation", False, "c_nationkey", "n_nationkey"), ("orders", "orders", True, "c_custkey", "o_custkey")],
    "supplier": [("nation", "nation", False, "s_nationkey", "n_nationkey"), ("items", "lineitem", True, "s_suppkey", "l_suppkey")],
    "orders": [("customer", "customer", False, "o_custkey", "c_custkey"), ("items", "lineitem", True, "o_orderkey", "l_orderkey"), ("next", "orders", False, "o_next", "o_orderkey")],
    "lineitem": [("order", "orders", False, "l_orderkey", "o_orderkey"), ("part", "part", False, "l_partkey", "p_partkey")],
    "patchy": [("customer", "customer", False, "o_custkey", "c_custkey")],
    "documents": [("label", "labels", False, "doc_id", "doc_id")],
}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """The driver's tables as collections. `patchy` is orders with nulls, and orders refer to the next order of ten."""

    def read(name: str) -> Callable[[], DataFrame]:
        if name == "orders":
            return lambda: spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("o_next", F.when(F.col("o_orderkey") % 10 == 0, F.col("o_orderkey") + 1))
        if name == "patchy":
            raw = lambda: spark.read.parquet(f"{sf_dir}/orders.parquet")
            return lambda: raw().select("o_orderkey", F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("o_custkey"), F.nullif("o_orderstatus", F.lit("F")).alias("o_orderstatus"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("o_orderpriority"), "o_orderdate")
        return lambda: spark.read.parquet(f"{sf_dir}/{name}.parquet")

    out = []
    for name, key in {**KEYS, "patchy": "o_orderkey"}.items():
        relations = {r[0]: Relation(*r) for r in RELATIONS.get(name, ())}
        out.append(Collection(name, key, relations=relations, json=frozenset({"props"} if name == "events" else ()), read=read(name)))
    return Engine(spark, out)


PATCHY = "(select o_orderkey, case when o_custkey % 5 <> 0 then o_custkey end as o_custkey, nullif(o_orderstatus, 'F') as o_orderstatus, case when o_orderkey % 7 <> 0 then o_totalprice end as o_totalprice, nullif(o_orderpriority, '1-URGENT') as o_orderpriority, o_orderdate from orders)"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _exploded(df: DataFrame, column: str, **names: str) -> DataFrame:
    """A list of structs as rows; none where the list is empty."""
    rest = [F.col(c) for c in df.columns if c != column]
    df = df.select(*rest, F.explode(column).alias("x"))
    return df.select(*rest, *[F.col(f"x.{k}").alias(v) for k, v in names.items()])


def request(name: str, text: str, sql: str, after: Callable[[DataFrame], DataFrame] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        (df,) = engine(spark, sf_dir).request(text).values()
        return after(df) if after else df

    QUERIES[name], ORACLE[name] = run, sql


def operation(name: str, sql: str | None) -> Callable:
    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return register


# Scans and projection
request("scan_project", "{ orders { o_orderkey o_totalprice } }", "select o_orderkey, o_totalprice from orders")
request("scan_alias_typename", "{ nation { id: _docID name: n_name kind: __typename gone: _deleted } }", "select n_nationkey as id, n_name as name, 'nation' as kind, false as gone from nation")
request("scan_fragments_variables", "query Q($s: String = \"O\") { orders(filter: {o_orderstatus: {_eq: $s}}) { ...Base ... on orders { o_orderstatus } } } fragment Base on orders { o_orderkey }", "select o_orderkey, o_orderstatus from orders where o_orderstatus = 'O'")
request("docid_lookup", "{ orders(docID: [1, 2, 3, 7, 7, 32]) { o_orderkey o_totalprice } }", "select o_orderkey, o_totalprice from orders where o_orderkey in (1, 2, 3, 7, 32)")
request("related_id", "{ orders { o_orderkey customer_id } }", "select o_orderkey, o_custkey as customer_id from orders")

# Filters, over a table with nulls
_W = {
    "filter_eq": ('o_orderstatus: {_eq: "O"}', "o_orderstatus is not distinct from 'O'"),
    "filter_eq_null": ("o_orderstatus: {_eq: null}", "o_orderstatus is null"),
    "filter_ne": ('o_orderstatus: {_ne: "O"}', "o_orderstatus is distinct from 'O'"),
    "filter_gt": ("o_totalprice: {_gt: 200000}", "coalesce(o_totalprice > 200000, false)"),
    "filter_ge": ("o_totalprice: {_ge: 200000.5}", "coalesce(o_totalprice >= 200000.5, false)"),
    "filter_lt": ("o_totalprice: {_lt: 50000}", "coalesce(o_totalprice < 50000, false)"),
    "filter_le": ("o_totalprice: {_le: 50000}", "coalesce(o_totalprice <= 50000, false)"),
    "filter_gt_null": ("o_totalprice: {_gt: null}", "o_totalprice is not null"),
    "filter_ge_null": ("o_totalprice: {_ge: null}", "true"),
    "filter_le_null": ("o_totalprice: {_le: null}", "o_totalprice is null"),
    "filter_datetime": ('o_orderdate: {_ge: "1995-06-01T00:00:00Z", _lt: "1996-01-01T00:00:00Z"}', "o_orderdate >= timestamp '1995-06-01' and o_orderdate < timestamp '1996-01-01'"),
    "filter_in": ('o_orderstatus: {_in: ["O", null]}', "coalesce(o_orderstatus = 'O', false) or o_orderstatus is null"),
    "filter_nin": ('o_orderstatus: {_nin: ["O"]}', "not coalesce(o_orderstatus = 'O', false)"),
    "filter_nin_null": ('o_orderstatus: {_nin: ["O", null]}', "not (coalesce(o_orderstatus = 'O', false) or o_orderstatus is null)"),
    "filter_like_prefix": ('o_orderpriority: {_like: "2%"}', "coalesce(starts_with(o_orderpriority, '2'), false)"),
    "filter_like_suffix": ('o_orderpriority: {_like: "%LOW"}', "coalesce(ends_with(o_orderpriority, 'LOW'), false)"),
    "filter_like_contains": ('o_orderpriority: {_like: "%-%"}', "coalesce(contains(o_orderpriority, '-'), false)"),
    "filter_like_inner": ('o_orderpriority: {_like: "3%M"}', "coalesce(starts_with(o_orderpriority, '3') and ends_with(o_orderpriority, 'M'), false)"),
    "filter_like_literal": ('o_orderpriority: {_like: "_-HIGH"}', "coalesce(o_orderpriority = '_-HIGH', false)"),
    "filter_nlike": ('o_orderpriority: {_nlike: "%LOW"}', "not coalesce(ends_with(o_orderpriority, 'LOW'), false)"),
    "filter_ilike": ('o_orderpriority: {_ilike: "%low"}', "coalesce(ends_with(lower(o_orderpriority), 'low'), false)"),
    "filter_nilike": ('o_orderpriority: {_nilike: "%low"}', "not coalesce(ends_with(lower(o_orderpriority), 'low'), false)"),
    "filter_and_or_not": ('_or: [{_and: [{o_totalprice: {_gt: 100000}}, {_not: {o_orderstatus: {_eq: "O"}}}]}, {o_orderpriority: {_eq: null}}]', "(coalesce(o_totalprice > 100000, false) and o_orderstatus is distinct from 'O') or o_orderpriority is null"),
    "filter_implicit_and": ('o_orderstatus: {_ne: "O"}, o_totalprice: {_gt: 1000, _lt: 150000}', "o_orderstatus is distinct from 'O' and coalesce(o_totalprice > 1000 and o_totalprice < 150000, false)"),
    "filter_empty_or": ("_or: []", "false"),
    "filter_related_one": ('customer: {c_mktsegment: {_eq: "BUILDING"}}', "coalesce((select c_mktsegment from customer where c_custkey = o_custkey) = 'BUILDING', false)"),
    "filter_related_one_missing": ('customer: {c_mktsegment: {_ne: "BUILDING"}}', "(select c_mktsegment from customer where c_custkey = o_custkey) is distinct from 'BUILDING'"),
    "filter_related_two_levels": ('customer: {nation: {n_name: {_like: "%A%"}}}', "coalesce((select contains(n_name, 'A') from customer join nation on c_nationkey = n_nationkey where c_custkey = o_custkey), false)"),
}
for _name, (_condition, _sql) in _W.items():
    request(_name, "{ patchy(filter: {%s}) { o_orderkey o_orderstatus o_totalprice } }" % _condition, f"select o_orderkey, o_orderstatus, o_totalprice from {PATCHY} p where {_sql}")
request("filter_related_many_exists", "{ customer(filter: {orders: {o_totalprice: {_gt: 300000}, o_orderstatus: {_eq: \"O\"}}}) { c_custkey c_name } }", "select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000 and o_orderstatus = 'O')")
request("filter_related_many_each", "{ customer(filter: {_and: [{orders: {o_totalprice: {_gt: 300000}}}, {orders: {o_orderstatus: {_eq: \"P\"}}}]}) { c_custkey } }", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000) and exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
request("filter_related_many_not", "{ customer(filter: {_not: {orders: {items: {l_quantity: {_gt: 49}}}}}) { c_custkey } }", "select c_custkey from customer where not exists (select 1 from orders join lineitem on l_orderkey = o_orderkey where o_custkey = c_custkey and l_quantity > 49)")

# Joins
request("join_to_one", "{ orders { o_orderkey customer { c_name c_acctbal } } }", "select o_orderkey, c_name, c_acctbal from orders left join customer on o_custkey = c_custkey", lambda df: df.select("o_orderkey", "customer.c_name", "customer.c_acctbal"))
request("join_to_one_filtered", "{ orders { o_orderkey customer(filter: {c_acctbal: {_gt: 5000}}) { c_name } } }", "select o_orderkey, c_name from orders left join customer on o_custkey = c_custkey and c_acctbal > 5000", lambda df: df.select("o_orderkey", "customer.c_name"))
request("join_to_many", "{ customer { c_custkey orders(order: [{o_totalprice: DESC}]) { o_orderkey o_totalprice } } }", "select c_custkey, o_orderkey, o_totalprice, row_number() over (partition by c_custkey order by o_totalprice desc, o_orderkey) as place from customer join orders on o_custkey = c_custkey", lambda df: df.select("c_custkey", F.posexplode("orders").alias("p", "x")).select("c_custkey", "x.o_orderkey", "x.o_totalprice", (F.col("p") + 1).cast("long").alias("place")))
request("join_to_many_sizes", "{ customer { c_custkey orders(filter: {o_totalprice: {_gt: 250000}}) { o_orderkey } } }", "select c_custkey, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey and o_totalprice > 250000 group by c_custkey", lambda df: df.select("c_custkey", F.size("orders").cast("long").alias("n")))
request("join_two_level", "{ region { r_name nations { n_name customers { c_custkey } } } }", "select r_name, n_name, c_custkey from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey", lambda df: _exploded(_exploded(df, "nations", n_name="n_name", customers="customers"), "customers", c_custkey="c_custkey"))
request("join_chain_to_one", "{ supplier { s_suppkey nation { n_name region { r_name } } } }", "select s_suppkey, n_name, r_name from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey", lambda df: df.select("s_suppkey", "nation.n_name", "nation.region.r_name"))
request("join_self_fk", "{ orders(filter: {o_orderkey: {_lt: 2000}}) { o_orderkey next { o_orderkey o_orderstatus } } }", "select a.o_orderkey, b.o_orderkey as next_key, b.o_orderstatus as next_status from orders a left join orders b on a.o_orderkey % 10 = 0 and b.o_orderkey = a.o_orderkey + 1 where a.o_orderkey < 2000", lambda df: df.select("o_orderkey", F.col("next.o_orderkey").alias("next_key"), F.col("next.o_orderstatus").alias("next_status")))
request("join_self_fk_whole", "{ orders { o_orderkey next { o_orderkey o_orderstatus } } }", "select a.o_orderkey, b.o_orderkey as next_key, b.o_orderstatus as next_status from orders a left join orders b on a.o_orderkey % 10 = 0 and b.o_orderkey = a.o_orderkey + 1", lambda df: df.select("o_orderkey", F.col("next.o_orderkey").alias("next_key"), F.col("next.o_orderstatus").alias("next_status")))
request("rel_child_limit", "{ customer { c_custkey orders(order: [{o_totalprice: DESC}], offset: 1, limit: 2) { o_orderkey } } }", "select c_custkey, o_orderkey from (select c_custkey, o_orderkey, row_number() over (partition by c_custkey order by o_totalprice desc, o_orderkey) as r from customer join orders on o_custkey = c_custkey) where r in (2, 3)", lambda df: _exploded(df, "orders", o_orderkey="o_orderkey"))

# Aggregates over relations
_REL = "from customer left join orders on o_custkey = c_custkey"
request("rel_count", "{ customer { c_custkey n: _count(orders: {filter: {o_orderstatus: {_eq: \"O\"}}}) } }", f"select c_custkey, count(o_orderkey) as n {_REL} and o_orderstatus = 'O' group by c_custkey")
request("rel_sum", "{ orders { o_orderkey q: _sum(items: {field: l_linenumber}) } }", "select o_orderkey, coalesce(sum(l_linenumber), 0)::bigint as q from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey")
request("rel_avg", "{ orders { o_orderkey q: _avg(items: {field: l_quantity, filter: {l_quantity: {_gt: 45}}}) } }", "select o_orderkey, coalesce(avg(l_quantity), 0.0) as q from orders left join lineitem on l_orderkey = o_orderkey and l_quantity > 45 group by o_orderkey")
request("rel_min", "{ customer { c_custkey x: _min(orders: {field: o_totalprice}) } }", f"select c_custkey, min(o_totalprice) as x {_REL} group by c_custkey")
request("rel_max", "{ customer { c_custkey x: _max(orders: {field: o_totalprice}) } }", f"select c_custkey, max(o_totalprice) as x {_REL} group by c_custkey")
request("rel_agg_limit", "{ customer { c_custkey x: _max(orders: {field: o_orderkey, order: {o_totalprice: ASC}, limit: 2}) n: _count(orders: {limit: 3}) } }", f"select c_custkey, max(case when r <= 2 then o_orderkey end) as x, least(count(o_orderkey), 3) as n from (select c_custkey, o_orderkey, row_number() over (partition by c_custkey order by o_totalprice, o_orderkey) as r {_REL}) group by c_custkey")
request("rel_agg_pooled", "{ nation { n_name n: _count(customers: {}, suppliers: {}) lo: _min(customers: {field: c_acctbal}, suppliers: {field: s_acctbal}) hi: _max(customers: {field: c_acctbal}, suppliers: {field: s_acctbal}) } }", "select n_name, count(b) as n, min(b) as lo, max(b) as hi from nation left join (select c_nationkey as k, c_acctbal as b from customer union all select s_nationkey, s_acctbal from supplier) on k = n_nationkey group by n_name")
request("rel_agg_having", "{ customer(filter: {_alias: {n: {_gt: 15}}}) { c_custkey n: _count(orders: {}) } }", f"select c_custkey, count(o_orderkey) as n {_REL} group by c_custkey having count(o_orderkey) > 15")
request("rel_agg_one_to_none", "{ documents(filter: {_alias: {n: {_eq: 0}}}) { doc_id n: _count(label: {}) } }", "select doc_id, 0::bigint as n from documents where doc_id not in (select doc_id from labels)")

# Aggregates over whole collections
request("top_count", "{ n: _count(patchy: {filter: {o_orderstatus: {_eq: null}}}) }", f"select count(*) as n from {PATCHY} where o_orderstatus is null")
request("top_sum", "{ s: _sum(lineitem: {field: l_linenumber}) }", "select sum(l_linenumber)::bigint as s from lineitem")
request("top_avg", "{ s: _avg(lineitem: {field: l_linenumber, filter: {l_returnflag: {_eq: \"R\"}}}) }", "select avg(l_linenumber) as s from lineitem where l_returnflag = 'R'")
request("top_min", "{ s: _min(patchy: {field: o_totalprice}) }", f"select min(o_totalprice) as s from {PATCHY}")
request("top_max", "{ s: _max(orders: {field: o_totalprice}, customer: {field: c_acctbal}) }", "select greatest((select max(o_totalprice) from orders), (select max(c_acctbal) from customer)) as s")
request("top_empty", "{ s: _sum(orders: {field: o_orderkey, filter: {o_orderkey: {_lt: -5}}}) }", "select 0::bigint as s")

# Groups
_G = f"from {PATCHY} group by o_orderstatus"
request("group_keys", "{ patchy(groupBy: [o_orderstatus, o_orderpriority]) { o_orderstatus o_orderpriority } }", f"select distinct o_orderstatus, o_orderpriority from {PATCHY}")
request("group_count", "{ patchy(groupBy: [o_orderstatus]) { o_orderstatus n: _count(_group: {}) big: _count(_group: {filter: {o_totalprice: {_gt: 200000}}}) } }", f"select o_orderstatus, count(*) as n, count(*) filter (where o_totalprice > 200000) as big {_G}")
request("group_sum", "{ patchy(groupBy: [o_orderstatus]) { o_orderstatus s: _sum(_group: {field: o_orderkey}) } }", f"select o_orderstatus, sum(o_orderkey)::bigint as s {_G}")
request("group_avg", "{ lineitem(groupBy: [l_returnflag, l_linestatus]) { l_returnflag l_linestatus a: _avg(_group: {field: l_linenumber}) } }", "select l_returnflag, l_linestatus, avg(l_linenumber) as a from lineitem group by 1, 2")
request("group_min", "{ patchy(groupBy: [o_orderstatus]) { o_orderstatus x: _min(_group: {field: o_totalprice}) } }", f"select o_orderstatus, min(o_totalprice) as x {_G}")
request("group_max", "{ patchy(groupBy: [o_orderstatus]) { o_orderstatus x: _max(_group: {field: o_totalprice}) } }", f"select o_orderstatus, max(o_totalprice) as x {_G}")
request("group_having_alias", "{ orders(groupBy: [o_custkey], filter: {_alias: {n: {_ge: 15}}}, order: [{_alias: {n: DESC}}]) { o_custkey n: _count(_group: {}) } }", "select o_custkey, count(*) as n from orders group by 1 having count(*) >= 15")
request("group_by_relation", "{ orders(groupBy: [customer]) { customer_id n: _count(_group: {}) } }", "select o_custkey as customer_id, count(*) as n from orders group by 1")
request("group_all", "{ orders(groupBy: []) { n: _count(_group: {}) hi: _max(_group: {field: o_orderkey}) } }", "select count(*) as n, max(o_orderkey) as hi from orders")
request("group_inner_limit", "{ patchy(groupBy: [o_orderpriority]) { o_orderpriority _group(order: [{o_totalprice: DESC}], limit: 3) { o_orderkey } } }", f"select o_orderpriority, o_orderkey from (select o_orderpriority, o_orderkey, row_number() over (partition by o_orderpriority order by o_totalprice desc nulls last, o_orderkey) as r from {PATCHY}) where r <= 3", lambda df: _exploded(df, "_group", o_orderkey="o_orderkey"))
request("group_inner_filter", "{ orders(groupBy: [o_orderstatus]) { o_orderstatus _group(filter: {o_orderkey: {_lt: 500}}) { o_orderkey o_totalprice } } }", "select o_orderstatus, o_orderkey, o_totalprice from orders where o_orderkey < 500", lambda df: _exploded(df, "_group", o_orderkey="o_orderkey", o_totalprice="o_totalprice"))
request("group_inner_filter_scaled", "{ orders(groupBy: [o_orderstatus]) { o_orderstatus _group(filter: {o_totalprice: {_gt: 250000}}) { o_orderkey o_totalprice } } }", "select o_orderstatus, o_orderkey, o_totalprice from orders where o_totalprice > 250000", lambda df: _exploded(df, "_group", o_orderkey="o_orderkey", o_totalprice="o_totalprice"))
request("group_agg_limit", "{ orders(groupBy: [o_orderstatus]) { o_orderstatus x: _min(_group: {field: o_orderkey, order: {o_totalprice: DESC}, limit: 5}) } }", "select o_orderstatus, min(o_orderkey) as x from (select *, row_number() over (partition by o_orderstatus order by o_totalprice desc, o_orderkey) as r from orders) where r <= 5 group by 1")
request("group_nested", "{ lineitem(groupBy: [l_returnflag]) { l_returnflag _group(groupBy: [l_linestatus]) { l_linestatus n: _count(_group: {}) } } }", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by 1, 2", lambda df: _exploded(df, "_group", l_linestatus="l_linestatus", n="n"))
request("group_nested_sum_of_avg", "{ lineitem(groupBy: [l_returnflag]) { l_returnflag s: _max(_group: {field: _avg}) _group(groupBy: [l_linestatus]) { l_linestatus _avg(_group: {field: l_linenumber}) } } }", "select l_returnflag, max(a) as s from (select l_returnflag, l_linestatus, avg(l_linenumber) as a from lineitem group by 1, 2) group by 1", lambda df: df.select("l_returnflag", "s"))
request("rel_group", "{ customer { c_custkey orders(groupBy: [o_orderstatus]) { o_orderstatus n: _count(_group: {}) } } }", "select c_custkey, o_orderstatus, count(*) as n from customer join orders on o_custkey = c_custkey group by 1, 2", lambda df: _exploded(df, "orders", o_orderstatus="o_orderstatus", n="n"))

# Order and limit
request("order_multi", "{ patchy(order: [{o_orderstatus: ASC}, {o_totalprice: DESC}], limit: 50) { o_orderkey o_orderstatus } }", f"select o_orderkey, o_orderstatus from {PATCHY} order by o_orderstatus nulls first, o_totalprice desc nulls last, o_orderkey limit 50")
request("order_related", "{ orders(order: [{customer: {nation: {n_name: DESC}}}, {o_orderkey: ASC}], limit: 40) { o_orderkey } }", "select o_orderkey from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey order by n_name desc nulls last, o_orderkey limit 40")
request("order_alias", "{ customer(order: [{_alias: {n: DESC}}, {c_custkey: ASC}], limit: 25) { c_custkey n: _count(orders: {}) } }", f"select c_custkey, count(o_orderkey) as n {_REL} group by 1 order by n desc, c_custkey limit 25")
request("limit_offset", "{ orders(order: [{o_orderkey: ASC}], limit: 20, offset: 30) { o_orderkey } }", "select o_orderkey from orders order by o_orderkey limit 20 offset 30")
request("topk", "{ orders(filter: {o_totalprice: {_gt: 1000}}, order: [{o_totalprice: DESC}], limit: 10) { o_orderkey o_totalprice o_orderstatus } }", "select o_orderkey, o_totalprice, o_orderstatus from orders where o_totalprice > 1000 order by o_totalprice desc nulls last, o_orderkey limit 10")

# Inline arrays: the parts of embeddings as whole numbers, which are exact
_V = "list_transform(embedding, lambda x: floor(x * 100)::bigint)"


def _scaled(spark: SparkSession, sf_dir: str) -> Engine:
    e = engine(spark, sf_dir)
    base = e.catalog["embeddings"].read
    e.catalog.put("embeddings", lambda: base().withColumn("v", F.transform("embedding", lambda x: F.floor(x.cast("double") * 100).cast("long"))))
    return e


def on_arrays(name: str, text: str, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: next(iter(_scaled(spark, sf_dir).request(text).values()))
    ORACLE[name] = sql.replace("V!", "list_transform(embedding, lambda x: floor(x::double * 100)::bigint)")


on_arrays("array_any", "{ embeddings(filter: {v: {_any: {_gt: 30}}}) { vec_id } }", "select vec_id from embeddings where len(list_filter(V!, lambda x: x > 30)) > 0")
on_arrays("array_all", "{ embeddings(filter: {v: {_all: {_gt: -35, _lt: 35}}}) { vec_id } }", "select vec_id from embeddings where len(list_filter(V!, lambda x: not (x > -35 and x < 35))) = 0")
on_arrays("array_none", "{ embeddings(filter: {v: {_none: {_gt: 30}}}) { vec_id } }", "select vec_id from embeddings where len(list_filter(V!, lambda x: x > 30)) = 0")
on_arrays("array_count", "{ embeddings { vec_id n: _count(v: {filter: {_gt: 10}}) } }", "select vec_id, len(list_filter(V!, lambda x: x > 10)) as n from embeddings")
on_arrays("array_sum", "{ embeddings { vec_id s: _sum(v: {}) } }", "select vec_id, list_sum(V!)::bigint as s from embeddings")
on_arrays("array_avg", "{ embeddings { vec_id s: _avg(v: {filter: {_gt: 1000}}) } }", "select vec_id, 0.0::double as s from embeddings")
on_arrays("array_avg_all", "{ embeddings { vec_id s: _avg(v: {}) } }", "select vec_id, list_sum(V!)::bigint / len(V!)::double as s from embeddings")
on_arrays("array_min", "{ embeddings { vec_id s: _min(v: {filter: {_or: [{_gt: 5}, {_eq: -1}]}}) } }", "select vec_id, list_min(list_filter(V!, lambda x: x > 5 or x = -1)) as s from embeddings")
on_arrays("array_max", "{ embeddings { vec_id s: _max(v: {}) } }", "select vec_id, list_max(V!) as s from embeddings")
on_arrays("array_sum_order_limit", "{ embeddings { vec_id s: _sum(v: {order: DESC, offset: 1, limit: 3}) } }", "select vec_id, list_sum(list_sort(V!, 'DESC')[2:4])::bigint as s from embeddings")
_Q = [1, -2, 3, 0] * 16
on_arrays("similarity_dot", "{ embeddings { vec_id s: _similarity(v: {vector: %s}) } }" % _Q, f"select vec_id, list_dot_product(V!::double[], {_Q}::double[]) as s from embeddings")
on_arrays("similarity_filter", "{ embeddings(filter: {_alias: {s: {_gt: 100}}}) { vec_id s: _similarity(v: {vector: %s}) } }" % _Q, f"select vec_id, list_dot_product(V!::double[], {_Q}::double[]) as s from embeddings where list_dot_product(V!::double[], {_Q}::double[]) > 100")
on_arrays("similarity_topk", "{ embeddings(order: [{_alias: {s: DESC}}, {vec_id: ASC}], limit: 15) { vec_id s: _similarity(v: {vector: %s}) } }" % _Q, f"select vec_id, list_dot_product(V!::double[], {_Q}::double[]) as s from embeddings order by s desc, vec_id limit 15")

# JSON
_K = "try_cast(json_extract_string(props, '$.k') as double)"
request("json_eq", "{ events(filter: {props: {k: {_eq: 7}}}) { event_id } }", f"select event_id from events where coalesce({_K} = 7, false)")
request("json_gt", "{ events(filter: {props: {k: {_gt: 50}}}) { event_id } }", f"select event_id from events where coalesce({_K} > 50, false)")
request("json_ne", "{ events(filter: {props: {k: {_ne: 7}}}) { event_id } }", f"select event_id from events where coalesce({_K} <> 7, false)")
request("json_ne_missing", "{ events(filter: {props: {nope: {_ne: 7}}}) { event_id } }", "select event_id from events where false")
request("json_not_in", "{ events(filter: {_not: {props: {k: {_in: [1, 2, 3]}}}}) { event_id } }", f"select event_id from events where not coalesce({_K} in (1, 2, 3), false)")
request("json_wrong_kind", "{ events(filter: {props: {k: {_like: \"%7%\"}}}) { event_id } }", "select event_id from events where false")


# A commit log made of events: a user is a document, the type of event its field, the event's number the height.
def commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    cid = F.concat(F.lit("c"), F.col("event_id").cast("string"))
    from pyspark.sql.window import Window

    before = F.lag(cid).over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    return e.select(
        cid.alias("cid"), F.col("user_id").cast("string").alias("docID"), F.lit("users").alias("collection"), F.col("event_type").alias("fieldName"), F.col("event_id").alias("height"), F.col("value").cast("string").alias("delta"),
        F.when(F.col("event_type") == "error", "deleted").alias("status"), F.lit("v1").alias("schemaVersionId"), F.when(before.isNull(), F.array().cast("array<string>")).otherwise(F.array(before)).alias("heads"), F.array().cast("array<struct<name:string,cid:string>>").alias("links"),
    )


@operation("crdt_lww", "select user_id, event_type, arg_max(value, event_id) as value from events group by 1, 2")
def crdt_lww(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id", "event_type").agg(crdt.lww(F.col("value"), F.col("event_id")).alias("value"))


@operation("crdt_pncounter", "select user_id, sum(floor(value)::bigint)::bigint as value from events group by 1")
def crdt_pncounter(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(crdt.pn_counter(F.floor("value").cast("long")).alias("value"))


@operation("crdt_composite_delete", "select user_id, bool_or(event_type = 'error') as gone from events group by 1")
def crdt_composite_delete(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(crdt.deleted(F.when(F.col("event_type") == "error", "deleted")).alias("gone"))


@operation("crdt_fold", "select user_id::varchar as id, arg_max(value, event_id) filter (where event_type = 'click') as click, arg_max(value, event_id) filter (where event_type = 'view') as view from events group by 1")
def crdt_fold(spark, sf_dir):
    return crdt.fold(commit_log(spark, sf_dir), {"click": ("lww", "double"), "view": ("lww", "double")}).select(F.col("_docID").alias("id"), "click", "view")


@operation("commits_by_field", "select 'c' || event_id as cid, event_id as height from events where event_type = 'click' and user_id = (select min(user_id) from events)")
def commits_by_field(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.load_commits(commit_log(spark, sf_dir))
    first = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.min("user_id")).first()[0]
    return e.request(f'{{ commits(docID: "{first}", fieldName: "click") {{ cid height }} }}')["commits"]


@operation("commits_latest", "select 'c' || max(event_id) as cid, user_id::varchar as doc, event_type as field from events group by user_id, event_type")
def commits_latest(spark, sf_dir):
    return log.latest(commit_log(spark, sf_dir)).select("cid", F.col("docID").alias("doc"), F.col("fieldName").alias("field"))


@operation("commits_depth", "select 'c' || event_id as cid from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as r from events) where r <= 2")
def commits_depth(spark, sf_dir):
    return log.query(commit_log(spark, sf_dir), depth=2).select("cid")


@operation("commits_group", "select event_type as \"fieldName\", count(*) as n from events group by 1")
def commits_group(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.load_commits(commit_log(spark, sf_dir))
    return e.request("{ commits(groupBy: [fieldName]) { fieldName n: _count(_group: {}) } }")["commits"]


@operation("time_travel", "with t as (select max(event_id) as x from events where user_id = (select min(user_id) from events) and event_type = 'view') select user_id::varchar as id, arg_max(value, event_id) as view from events, t where event_type = 'view' and user_id = (select min(user_id) from events) and event_id <= x group by 1")
def time_travel(spark, sf_dir):
    commits = commit_log(spark, sf_dir)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    first = events.agg(F.min("user_id")).first()[0]
    last = events.where((F.col("user_id") == first) & (F.col("event_type") == "view")).agg(F.max("event_id")).first()[0]
    return crdt.fold(log.ancestors(commits, f"c{last}"), {"view": ("lww", "double")}).select(F.col("_docID").alias("id"), "view")


# Views and transforms
_VIEW = "{ orders(filter: {o_totalprice: {_gt: 150000}}) { key: o_orderkey status: o_orderstatus total: o_totalprice } }"
_VIEW_SQL = "select key, status from (select o_orderkey as key, o_orderstatus as status, o_totalprice as total from orders where o_totalprice > 150000) where status <> 'F'"


def _shared(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/view-{uuid.uuid4().hex}"


@operation("view_cacheless", _VIEW_SQL)
def view_cacheless(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.add_view("Big", _VIEW)
    return e.request('{ Big(filter: {status: {_ne: "F"}}) { key status } }')["Big"]


@operation("view_materialized", _VIEW_SQL)
def view_materialized(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.add_view("Big", _VIEW, path=_shared(spark))
    e.refresh_view("Big")
    return e.request('{ Big(filter: {status: {_ne: "F"}}) { key status } }')["Big"]


@operation("lens_remove_default_filter", "select o_orderkey as key, o_orderstatus as status, 'new' as mark, o_orderstatus as copied from orders where o_totalprice > 150000 and o_orderstatus = 'O'")
def lens_view(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.add_view("Big", _VIEW, lens.chain(lens.remove("total"), lens.set_default("mark", "new"), lens.copy("status", "copied"), lens.keep("status", "O")))
    return e.request("{ Big { key status mark copied } }")["Big"]


@operation("lens_prepend", "select -1 as key, 'first' as status union all select o_orderkey, o_orderstatus from orders where o_totalprice > 150000")
def lens_prepend(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.add_view("Big", _VIEW, lens.chain(lens.remove("total"), lens.prepend({"key": -1, "status": "first"})))
    return e.request("{ Big { key status } }")["Big"]


@operation("lens_versions", "select n_nationkey as id, n_name as name, case when n_nationkey % 2 = 0 then 'old' else 'kept' end as tag from nation")
def lens_versions(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    h = lens.History()
    h.migrate("1", "2", lens.set_default("extra", 1))
    h.migrate("2", "3", lens.chain(lens.remove("extra"), lens.set_default("tag", "old")))
    return h.read({"1": n.where("id % 2 = 0"), "3": n.where("id % 2 = 1").withColumn("tag", F.lit("kept"))}, "3")


@operation("lens_write_back", "select n_nationkey as id, n_name as name, case when n_nationkey % 2 = 0 then 'old' else 'kept' end as tag from nation where n_nationkey <> 3")
def lens_write_back(spark, sf_dir):
    """Migrated documents are stored; then one version is left, which is read both as it is and as the one before it."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    h = lens.History()
    h.migrate("1", "2", lens.set_default("tag", "old"), lens.remove("tag"))
    stored = h.write_back({"1": n.where("id % 2 = 0"), "2": n.where("id % 2 = 1").withColumn("tag", F.lit("kept"))}, "2", _shared(spark))
    before = h.read(stored, "1").where("id <> 3")
    return h.read(stored, "2").join(before, ["id", "name"])


# Mutations: as new states of a table
@operation("mutate_update", "select o_orderkey, case when coalesce(o_totalprice > 200000, false) then 'X' else o_orderstatus end as o_orderstatus from " + PATCHY)
def mutate_update(spark, sf_dir):
    from ..catalog import Field
    from ..functions.predicate import compile_filter

    e = engine(spark, sf_dir)
    c = e.catalog["patchy"]
    c = Collection(c.name, c.key, {"o_orderstatus": Field("o_orderstatus", "String")}, c.relations, read=c.read)
    frame = e.planner.frame("patchy")
    return mutate.update(c, frame.df, compile_filter({"o_totalprice": {"_gt": 200000}}, frame), {"o_orderstatus": "X"}).select("o_orderkey", "o_orderstatus")


@operation("mutate_soft_delete", "select o_orderkey, o_orderstatus = 'F' as gone from orders")
def mutate_soft_delete(spark, sf_dir):
    e = engine(spark, sf_dir)
    df = mutate.delete(e.catalog["orders"].documents(), F.col("o_orderstatus") == "F")
    return e.planner.plan(Select("orders", (Plain("o_orderkey"), Plain("_deleted", "gone")), show_deleted=True), df)


@operation("mutate_deleted_hidden", "select o_orderkey from orders where o_orderstatus <> 'F'")
def mutate_deleted_hidden(spark, sf_dir):
    e = engine(spark, sf_dir)
    df = mutate.delete(e.catalog["orders"].documents(), F.col("o_orderstatus") == "F")
    return e.planner.plan(Select("orders", (Plain("o_orderkey"),)), df)


@operation("mutate_upsert", "select name, age from (values ('Ann', 31::bigint), ('Bob', 40::bigint), ('Cid', 5::bigint)) t(name, age)")
def mutate_upsert(spark, sf_dir):
    e = Engine(spark)
    e.add_schema("type User { name: String age: Int }")
    e.request('mutation { create_User(input: [{name: "Ann", age: 30}, {name: "Bob", age: 40}]) { name } }')
    for name, age in (("Ann", 31), ("Cid", 5)):
        e.request(f'mutation {{ upsert_User(filter: {{name: {{_eq: "{name}"}}}}, create: {{name: "{name}", age: {age}}}, update: {{age: {age}}}) {{ name }} }}')
    return e.request("{ User { name age } }")["User"]


@operation("permissioned", "select o_orderkey from orders where o_custkey % 3 = 0")
def permissioned(spark, sf_dir):
    e = engine(spark, sf_dir)
    grants = e.catalog["orders"].documents().where("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("docID"), F.lit("me").alias("identity"))
    e.permitted("orders", grants, "me")
    return e.request("{ orders { o_orderkey } }")["orders"]


@operation("backup_export", "select 'region' as collection, r_regionkey as key, r_name as name from region")
def backup_export(spark, sf_dir):
    e = engine(spark, sf_dir)
    at = _shared(spark)
    backup.write_folder({"region": e.catalog["region"].read()}, at)
    back = backup.read_folder(spark, at, {"region": e.catalog["region"].read().schema})["region"]
    return back.select(F.lit("region").alias("collection"), F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))


@operation("backup_file", "select n_name as name, n_regionkey as region, r_name as of from nation join region on n_regionkey = r_regionkey")
def backup_file(spark, sf_dir):
    """One file with all collections, restored into another engine whose relations still hold."""
    at, schema = _shared(spark), "type Region { key: Int name: String nations: [Nation] } type Nation { name: String region_key: Int region: Region }"
    e = Engine(spark)
    e.add_schema(schema)
    region, nation = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("region", "nation"))
    e.load("Region", region.select(F.concat(F.lit("bae-r"), F.col("r_regionkey").cast("string")).alias("_docID"), F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")))
    e.load("Nation", nation.select(F.concat(F.lit("bae-n"), F.col("n_nationkey").cast("string")).alias("_docID"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region_key"), F.concat(F.lit("bae-r"), F.col("n_regionkey").cast("string")).alias("region_id")))
    e.export(at, ["Region", "Nation"])
    back = Engine(spark)
    back.add_schema(schema)
    back.restore(at, ["Region", "Nation"])
    return back.request("{ Nation { name region_key region { name } } }")["Nation"].select("name", F.col("region_key").alias("region"), F.col("region.name").alias("of"))


@operation("backup_self_reference", "select a.n_name as name, b.n_name as neighbour from nation a left join nation b on b.n_nationkey = a.n_nationkey - 1")
def backup_self_reference(spark, sf_dir):
    """Documents that point to others of their collection, whose content changed since their ids were made."""
    at, schema = _shared(spark), "type Nation { name: String neighbour: Nation }"
    e = Engine(spark)
    e.add_schema(schema)
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    name = lambda k: F.concat(F.lit("bae-"), k.cast("string"))
    e.load("Nation", nation.select(name(F.col("n_nationkey")).alias("_docID"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") > 0, name(F.col("n_nationkey") - 1)).alias("neighbour_id")))
    e.export(at, ["Nation"])
    back = Engine(spark)
    back.add_schema(schema)
    back.restore(at, ["Nation"])
    return back.request("{ Nation { name neighbour { name } } }")["Nation"].select("name", F.col("neighbour.name").alias("neighbour"))


_USERS = 'mutation { create_User(input: [{name: "Ann", age: 30, points: 1}, {name: "Bob", age: 40}]) { name } }'


def _users(spark: SparkSession) -> Engine:
    """Two users; Ann's age is changed, her points grow, Bob goes."""
    e = Engine(spark)
    e.add_schema("type User { name: String age: Int points: Int @crdt(type: pncounter) }")
    e.request(_USERS)
    e.request('mutation { update_User(filter: {name: {_eq: "Ann"}}, input: {age: 31, points: 4}) { name } }')
    e.request('mutation { delete_User(filter: {name: {_eq: "Bob"}}) { name } }')
    return e


@operation("mutation_commits", """select * from (values ('_C', 1::bigint, 2::bigint, 5::bigint), ('_C', 2, 2, 2), ('age', 1, 2, 0), ('age', 2, 1, 0), ('name', 1, 2, 0), ('points', 1, 1, 0), ('points', 2, 1, 0)) t("fieldName", height, n, links)""")
def mutation_commits(spark, sf_dir):
    """Creates, updates and deletes write commits of fields and documents that link up."""
    return _users(spark).request("{ commits { fieldName height links { cid } } }")["commits"].groupBy("fieldName", "height").agg(F.count("*").alias("n"), F.sum(F.size("links")).cast("long").alias("links"))


@operation("mutation_version", "select 'Ann' as name, 31::bigint as age, 5::bigint as points, 2::bigint as height, 2::bigint as links")
def mutation_version(spark, sf_dir):
    got = _users(spark).request("{ User { name age points _version { height links { name } } } }")["User"]
    return got.select("name", F.col("age").cast("long").alias("age"), F.col("points").cast("long").alias("points"), F.col("_version")[0]["height"].alias("height"), F.size(F.col("_version")[0]["links"]).cast("long").alias("links"))


@operation("mutation_time_travel", "select 'Ann' as name, 30::bigint as age, 1::bigint as points")
def mutation_time_travel(spark, sf_dir):
    """A document as it was at its first commit."""
    e = _users(spark)
    first = e.commits.where("fieldName = 'age' and delta = '30'").select("docID").first()[0]
    cid = e.commits.where((F.col("docID") == first) & (F.col("fieldName") == "_C") & (F.col("height") == 1)).first()["cid"]
    return e.request(f'{{ User(cid: "{cid}") {{ name age points }} }}')["User"].select("name", F.col("age").cast("long").alias("age"), F.col("points").cast("long").alias("points"))


@operation("merge_repeated", "select user_id::varchar as id, sum(floor(value)::bigint) filter (where event_type = 'view')::bigint as view from events group by 1 having count(*) filter (where event_type = 'view') > 0")
def merge_repeated(spark, sf_dir):
    """Commits that come twice, in one batch and in two, count once."""
    e = Engine(spark)
    e.add_schema("type users { view: Int @crdt(type: pncounter) }")
    commits = commit_log(spark, sf_dir).where("fieldName = 'view'").withColumn("delta", F.floor(F.col("delta").cast("double")).cast("string"))
    e.merge("users", commits.union(commits))
    e.merge("users", commits)
    return e.catalog["users"].documents().select(F.col("_docID").alias("id"), F.col("view").cast("long").alias("view"))


@operation("one_to_one", "select 'Ann' as author, 'target document of author is already linked to another document' as refused")
def one_to_one(spark, sf_dir):
    """A document of a one-to-one relation is held by one other only."""
    e = Engine(spark)
    e.add_schema("type Author { name: String address: Address } type Address { street: String author: Author @primary }")
    e.create("Author", {"name": "Ann"})
    ann = e.doc_ids("Author").first()[0]
    e.create("Address", {"street": "A", "author": ann})
    refused = ""
    try:
        e.create("Address", {"street": "B", "author": ann})
    except QueryError as x:
        refused = str(x)
    return e.request("{ Author { name address { street } } }")["Author"].select(F.col("name").alias("author"), F.lit(refused).alias("refused"))


@operation("embedding_on_write", "select * from (values ('Ann', 3.0::double), ('Bo', 2.0), ('Own', 9.0)) t(name, v)")
def embedding_on_write(spark, sf_dir):
    """Embeddings that documents lack are made when they are written, by a function that the caller gives, in one batch."""
    e = Engine(spark)
    e.add_schema('type User { name: String v: [Float32!] @embedding(fields: ["name"], provider: "own", model: "m") }')
    e.embed_with("own", lambda texts, model: [[float(len(t))] for t in texts])
    e.create_many("User", [{"name": "Ann"}, {"name": "Bo"}, {"name": "Own", "v": [9.0]}])
    return e.request("{ User { name v } }")["User"].select("name", F.col("v")[0].cast("double").alias("v"))


@operation("several_roots", "select 'region' as root, r_name as name from region union all select 'nation', n_name from nation where n_regionkey = 1")
def several_roots(spark, sf_dir):
    got = engine(spark, sf_dir).request("{ region { r_name } few: nation(filter: {n_regionkey: {_eq: 1}}) { n_name } }")
    return got["region"].select(F.lit("region").alias("root"), F.col("r_name").alias("name")).union(got["few"].select(F.lit("nation"), "n_name"))


@operation("commits_count_links", "select 'c' || event_id as cid, case when event_id = first then 0 else 1 end::bigint as n from (select event_id, min(event_id) over (partition by user_id, event_type) as first from events)")
def commits_count_links(spark, sf_dir):
    """Commits with their parents as links, which are counted."""
    e = engine(spark, sf_dir)
    e.load_commits(commit_log(spark, sf_dir).withColumn("links", F.transform("heads", lambda h: F.struct(F.lit("before").alias("name"), h.alias("cid")))))
    return e.request("{ commits { cid n: _count(field: links) } }")["commits"].select("cid", F.col("n").cast("long").alias("n"))


@operation("index_lookup", "select o_orderkey, o_totalprice from orders where o_totalprice between 200000 and 210000")
def index_lookup(spark, sf_dir):
    """A collection laid out by its index; the filter is pushed to the scan, which skips files and row groups by their extremes."""
    e = engine(spark, sf_dir)
    e.create_index("orders", Index((("o_totalprice", False),)))
    e.write("orders", _shared(spark))
    return e.request("{ orders(filter: {o_totalprice: {_ge: 200000, _le: 210000}}) { o_orderkey o_totalprice } }")["orders"]


@operation("explain_execute", "select count(*)::bigint as rows from orders where o_totalprice > 200000")
def explain_execute(spark, sf_dir):
    got = engine(spark, sf_dir).request("query @explain(type: execute) { orders(filter: {o_totalprice: {_gt: 200000}}) { o_orderkey } }")["orders"]
    return spark.range(1).select(F.lit(got["sizeOfResult"]).cast("long").alias("rows"))


@operation("subscription_batch", "select event_id, user_id from events where event_type = 'purchase'")
def subscription_batch(spark, sf_dir):
    """Changed documents arrive as files; the subscription's results are gathered and read back."""
    at = _shared(spark)
    e = engine(spark, sf_dir)
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(f"{at}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{at}/in").schema).parquet(f"{at}/in")
    q = e.subscribe('subscription { events(filter: {event_type: {_eq: "purchase"}}) { event_id user_id } }', stream, lambda df, n: df.write.mode("append").parquet(f"{at}/out"), f"{at}/state", once=True)
    q.awaitTermination()
    return spark.read.schema("event_id long, user_id long").parquet(f"{at}/out")


@operation("stream_merge", "select user_id::varchar as doc, event_type as field, sum(floor(value)::bigint)::bigint as value from events group by 1, 2")
def stream_merge(spark, sf_dir):
    """Counter deltas merged by a stream that keeps the sums."""
    at = _shared(spark)
    commit_log(spark, sf_dir).withColumn("delta", F.floor(F.col("delta").cast("double")).cast("string")).write.parquet(f"{at}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{at}/in").schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    out = f"{at}/out"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = merge.merge_counters(stream, "long").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).groupBy(F.col("docID").alias("doc"), F.col("fieldName").alias("field")).agg(F.max_by("value", "batch").alias("value"))


@operation("similarity_cosine", "select vec_id, round(list_cosine_similarity(embedding::double[], [1.0, 2.0, 3.0, 4.0] || list_transform(range(60), lambda x: 0.0)), 6) as s from embeddings")
def similarity_cosine(spark, sf_dir):
    q = [1.0, 2.0, 3.0, 4.0] + [0.0] * 60
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.round(arrays.cosine(F.col("embedding"), q), 6).alias("s"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
