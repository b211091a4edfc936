"""Two-valued filters, with nulls, over every kind of field."""

import pytest

from docloom.engine import Engine
from docloom.types import QueryError

SDL = """
type Users {
  name: String  age: Int  height: Float  verified: Boolean  created: DateTime  data: Blob  custom: JSON
  ints: [Int]  floats: [Float!]  words: [String]  flags: [Boolean]
}
"""
ROWS = [
    ("a", "John", 21, 1.8, True, "2020-01-01T00:00:00Z", "00FF", '{"tree": "oak", "age": 450, "deep": {"x": [1, 2]}}', [1, None, 3], [0.5], ["x", None], [True]),
    ("b", "Bob", 32, None, False, "2021-01-01T00:00:00Z", "AB", '{"tree": "maple", "age": 250}', [], [], ["y"], [None]),
    ("c", None, None, 1.5, None, None, None, "null", None, None, None, None),
    ("d", "Alice %", 21, 2.0, True, "2020-06-01T00:00:00Z", "ff", "{}", [5, 6], [2.5, -1.0], ["xx", "x"], [False, True]),
    ("e", "john", 0, 0.0, False, None, None, None, [-1], [1e9], [], []),
]


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.add_schema(SDL)
    e.load("Users", spark.createDataFrame(ROWS, "_docID string, name string, age long, height double, verified boolean, created string, data string, custom string, ints array<long>, floats array<double>, words array<string>, flags array<boolean>"))
    return e


@pytest.mark.parametrize(
    "condition,want",
    [
        ("age: {_eq: 21}", "ad"), ("age: {_eq: null}", "c"), ("age: {_ne: 21}", "bce"), ("age: {_ne: null}", "abde"), ("age: {_eq: 21.0}", "ad"),
        ("age: {_gt: 21}", "b"), ("age: {_gt: null}", "abde"), ("age: {_ge: 21}", "abd"), ("age: {_ge: null}", "abcde"), ("age: {_lt: 21}", "e"), ("age: {_lt: null}", ""), ("age: {_le: 21}", "ade"), ("age: {_le: null}", "c"),
        ("age: {_in: [21, null]}", "acd"), ("age: {_in: []}", ""), ("age: {_nin: [21]}", "bce"), ("age: {_nin: [21, null]}", "be"),
        ("height: {_ge: 2}", "d"), ("height: {_gt: 1, _lt: 2}", "ac"), ("verified: {_eq: true}", "ad"), ("verified: {_ne: true}", "bce"), ("verified: {_in: [false, null]}", "bce"),
        ('name: {_like: "J%"}', "a"), ('name: {_like: "%n"}', "ae"), ('name: {_like: "%oh%"}', "ae"), ('name: {_like: "J%n"}', "a"), ('name: {_like: "%"}', ""), ('name: {_like: "%%"}', "abde"), ('name: {_like: "B_b"}', ""), ('name: {_like: "Bob"}', "b"),
        ('name: {_nlike: "J%"}', "bcde"), ('name: {_ilike: "j%N"}', "ae"), ('name: {_nilike: "j%"}', "bcd"), ('data: {_ilike: "%ff"}', "ad"), ('name: {_like: "J%h%n"}', ""),
        ('created: {_gt: "2020-03-01T00:00:00Z"}', "bd"), ('created: {_eq: "2020-01-01T00:00:00+00:00"}', "a"), ('created: {_le: null}', "ce"),
        ("_not: {age: {_eq: 21}}", "bce"), ("_or: [{age: {_eq: 0}}, {name: {_eq: null}}]", "ce"), ("_or: []", ""), ("_and: []", "abcde"), ("_and: null", "abcde"), ("_and: [{age: {_ge: 21}}, {_not: {name: {_like: \"B%\"}}}]", "ad"),
        ("age: {_or: [{_eq: 0}, {_gt: 30}]}", "be"), ("age: {_not: {_gt: 20}}", "ce"), ('name: {_eq: 5}', ""), ('name: {_ne: 5}', "abcde"),
        ("ints: {_any: {_gt: 2}}", "ad"), ("ints: {_any: {_eq: null}}", "a"), ("ints: {_all: {_gt: 0}}", "bd"), ("ints: {_none: {_lt: 0}}", "abd"), ("ints: {_all: {_ne: 5}}", "abe"),
        ('words: {_any: {_like: "x%"}}', "ad"), ("flags: {_all: {_eq: true}}", "ae"), ("floats: {_none: {_lt: 0}}", "abe"), ("floats: {_any: {_ge: 2.5, _lt: 3}}", "d"),
        ('custom: {tree: {_eq: "oak"}}', "a"), ("custom: {age: {_gt: 300}}", "a"), ("custom: {age: {_ne: 450}}", "b"), ("custom: {age: {_ge: 250}}", "ab"), ("custom: {age: {_in: [250, 1]}}", "b"), ("custom: {age: {_nin: [250]}}", "a"), ("custom: {_eq: null}", "ce"),
        ("custom: {_ne: null}", "abd"), ('custom: {_ne: {tree: "oak", age: 450, deep: {x: [1, 2]}}}', "bcde"), ('custom: {_eq: {age: 250, tree: "maple"}}', "b"), ("custom: {deep: {x: {_any: {_gt: 1}}}}", "a"), ("custom: {deep: {x: {_all: {_gt: 1}}}}", ""), ('custom: {tree: {_like: "m%"}}', "b"), ('custom: {age: {_eq: "450"}}', ""), ("custom: {nope: {_eq: null}}", "abcde"),
    ],
)
def test_filters(engine, condition, want):
    got = engine.request("{ Users(filter: {%s}) { _docID } }" % condition)["Users"].collect()
    assert "".join(sorted(r._docID for r in got)) == want


def test_errors(engine):
    for bad in ("nope: {_eq: 1}", "age: {_what: 1}", "name: {_like: null}", "age: 5"):
        with pytest.raises(QueryError):
            engine.request("{ Users(filter: {%s}) { name } }" % bad)


def test_filters_reach_the_scan(spark, tmp_path):
    from docloom.catalog import Collection

    spark.range(100).selectExpr("id", "id * 2 as x", "cast(id as string) as s").write.parquet(f"{tmp_path}/t")
    e = Engine(spark, [Collection("T", "id", read=lambda: spark.read.parquet(f"{tmp_path}/t"))])
    plan = e.request("query @explain(type: debug) { T(filter: {x: {_gt: 150}}) { id } }")["T"]
    assert "GreaterThan(x,150)" in plan and "s:string" not in plan.split("ReadSchema")[1]
