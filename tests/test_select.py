"""Relations, groups, aggregates, order and limits, with childless and orphaned documents."""

import pytest

from docloom.engine import Engine
from docloom.types import QueryError

SDL = """
type Author { name: String  age: Int  scores: [Float]  published: [Book]  articles: [Article] }
type Book { name: String  rating: Float  pages: Int  author: Author }
type Article { title: String  points: Int  author: Author }
"""


@pytest.fixture(scope="module")
def e(spark):
    e = Engine(spark)
    e.add_schema(SDL)
    e.load("Author", spark.createDataFrame([("a1", "Ann", 30, [1.0, None, 4.0, 2.0]), ("a2", "Bob", None, []), ("a3", "Cid", 30, None)], "_docID string, name string, age long, scores array<double>"))
    e.load("Book", spark.createDataFrame([("b1", "One", 4.5, 100, "a1"), ("b2", "Two", None, 50, "a1"), ("b3", "Three", 3.0, None, "a2"), ("b4", "Lost", 9.0, 1, None), ("b5", "Orphan", 8.0, 2, "zz"), ("b6", "Four", 2.0, 70, "a1")], "_docID string, name string, rating double, pages long, author_id string"))
    e.load("Article", spark.createDataFrame([("c1", "A", 10, "a1"), ("c2", "B", 20, "a3")], "_docID string, title string, points long, author_id string"))
    return e


def run(e, text, **variables):
    (df,) = e.request(text, variables).values()
    return [r.asDict(True) for r in df.collect()]


def test_to_one_keeps_all_and_filters_to_null(e):
    got = {r["name"]: r["author"] for r in run(e, "{ Book { name author { name } } }")}
    assert got == {"One": {"name": "Ann"}, "Two": {"name": "Ann"}, "Three": {"name": "Bob"}, "Lost": None, "Orphan": None, "Four": {"name": "Ann"}}
    got = {r["name"]: r["author"] for r in run(e, '{ Book { name author(filter: {name: {_eq: "Bob"}}) { name } } }')}
    assert got["One"] is None and got["Three"] == {"name": "Bob"}


def test_to_many(e):
    got = {r["name"]: [b["name"] for b in r["published"]] for r in run(e, "{ Author { name published(order: [{rating: DESC}]) { name } } }")}
    assert got == {"Ann": ["One", "Four", "Two"], "Bob": ["Three"], "Cid": []}
    got = {r["name"]: [b["name"] for b in r["x"]] for r in run(e, "{ Author { name x: published(order: [{rating: ASC}], limit: 1, offset: 1) { name } } }")}
    assert got == {"Ann": ["Four"], "Bob": [], "Cid": []}
    deep = run(e, '{ Author(filter: {name: {_eq: "Ann"}}) { published(order: [{name: ASC}]) { name author { name published { name } } } } }')
    assert len(deep[0]["published"][0]["author"]["published"]) == 3


def test_filters_on_relations(e):
    names = lambda text: sorted(r["name"] for r in run(e, text))
    assert names("{ Author(filter: {published: {rating: {_gt: 4}}}) { name } }") == ["Ann"]
    assert names("{ Author(filter: {published: {rating: {_gt: 4}, pages: {_lt: 80}}}) { name } }") == []
    assert names("{ Author(filter: {_and: [{published: {rating: {_gt: 4}}}, {published: {pages: {_lt: 80}}}]}) { name } }") == ["Ann"]
    assert names("{ Author(filter: {_not: {published: {rating: {_ne: null}}}}) { name } }") == ["Cid"]
    assert names('{ Book(filter: {author: {name: {_ne: "Ann"}}}) { name } }') == ["Lost", "Orphan", "Three"]
    assert names("{ Book(filter: {author: {age: {_eq: null}}}) { name } }") == ["Lost", "Orphan", "Three"]
    assert names("{ Book(filter: {author: {articles: {points: {_gt: 5}}}}) { name } }") == ["Four", "One", "Two"]
    assert names('{ Book(filter: {_or: [{author: {name: {_eq: "Bob"}}}, {rating: {_gt: 8.5}}]}) { name } }') == ["Lost", "Three"]
    assert names('{ Book(filter: {author_id: {_eq: "a2"}}) { name } }') == ["Three"]


def test_relation_aggregates(e):
    got = {r["name"]: r for r in run(e, "{ Author { name n: _count(published: {}) s: _sum(published: {field: pages}) a: _avg(published: {field: rating}) lo: _min(published: {field: rating}) hi: _max(published: {field: pages, filter: {rating: {_lt: 3}}}) } }")}
    assert got["Ann"] == {"name": "Ann", "n": 3, "s": 220, "a": 3.25, "lo": 2.0, "hi": 70}
    assert got["Bob"] == {"name": "Bob", "n": 1, "s": 0, "a": 3.0, "lo": 3.0, "hi": None}
    assert got["Cid"] == {"name": "Cid", "n": 0, "s": 0, "a": 0.0, "lo": None, "hi": None}
    pooled = {r["name"]: r["a"] for r in run(e, "{ Author { name a: _avg(published: {field: rating}, articles: {field: points}) } }")}
    assert pooled == {"Ann": (4.5 + 2 + 10) / 3, "Bob": 3.0, "Cid": 20.0}
    top = {r["name"]: r["s"] for r in run(e, "{ Author { name s: _sum(published: {field: pages, order: {pages: DESC}, offset: 1, limit: 1}) } }")}
    assert top == {"Ann": 70, "Bob": 0, "Cid": 0}


def test_array_aggregates(e):
    got = {r["name"]: r for r in run(e, "{ Author { name n: _count(scores: {}) f: _count(scores: {filter: {_gt: 1}}) s: _sum(scores: {}) a: _avg(scores: {}) m: _min(scores: {order: DESC, limit: 2}) } }")}
    assert got["Ann"] == {"name": "Ann", "n": 4, "f": 2, "s": 7.0, "a": 7 / 3, "m": 2.0}
    assert got["Cid"] == {"name": "Cid", "n": 0, "f": 0, "s": 0.0, "a": 0.0, "m": None}


def test_groups(e):
    got = {r["age"]: r for r in run(e, "{ Author(groupBy: [age]) { age n: _count(_group: {}) _group(order: [{name: DESC}]) { name } } }")}
    assert got[30]["n"] == 2 and [x["name"] for x in got[30]["_group"]] == ["Cid", "Ann"] and got[None]["n"] == 1
    assert run(e, "{ Author(groupBy: []) { n: _count(_group: {}) } }") == [{"n": 3}]
    by = {r["author_id"]: r for r in run(e, "{ Book(groupBy: [author]) { author_id s: _sum(_group: {field: rating}) one: _max(_group: {field: rating, order: {name: ASC}, limit: 1}) a: _group(limit: 1) { name } b: _group(filter: {rating: {_gt: 8}}) { name } } }")}
    assert by["a1"]["s"] == 6.5 and by["a1"]["one"] == 2.0 and by["a1"]["a"] == [{"name": "One"}] and by["a1"]["b"] == [] and by[None]["b"] == [{"name": "Lost"}]
    nested = {r["age"]: r for r in run(e, "{ Author(groupBy: [age]) { age hi: _max(_group: {field: _count}) _group(groupBy: [name]) { name _count(_group: {}) } } }")}
    assert nested[30]["hi"] == 1 and sorted(x["name"] for x in nested[30]["_group"]) == ["Ann", "Cid"]
    having = run(e, "{ Author(groupBy: [age], filter: {_alias: {n: {_gt: 1}}}) { age n: _count(_group: {}) } }")
    assert having == [{"age": 30, "n": 2}]
    rel = {r["name"]: len(r["published"]) for r in run(e, "{ Author { name published(groupBy: [rating]) { rating } } }")}
    assert rel == {"Ann": 3, "Bob": 1, "Cid": 0}
    for bad in ("{ Author(groupBy: [age]) { name } }", "{ Author { _group { name } } }", "{ Author(groupBy: [published]) { age } }", "{ Author { n: _count(_group: {}) } }"):
        with pytest.raises(QueryError):
            run(e, bad)


def test_order_and_limit(e):
    names = lambda text: [r["name"] for r in run(e, text)]
    assert names("{ Author(order: [{age: ASC}, {name: DESC}]) { name } }") == ["Bob", "Cid", "Ann"]
    assert names("{ Author(order: [{age: DESC}, {name: ASC}]) { name } }") == ["Ann", "Cid", "Bob"]
    assert names("{ Book(order: [{author: {name: ASC}}, {name: ASC}]) { name } }") == ["Lost", "Orphan", "Four", "One", "Two", "Three"]
    assert names("{ Author(order: [{_alias: {n: DESC}}], limit: 2) { name n: _count(published: {}) } }") == ["Ann", "Bob"]
    assert names("{ Author(limit: 1, offset: 1) { name } }") == ["Bob"] and len(names("{ Author(limit: 0) { name } }")) == 3
    with pytest.raises(QueryError):
        names("{ Author(order: [{age: ASC, name: ASC}]) { name } }")


def test_top_level_aggregates_and_several_roots(e):
    out = e.request("{ n: _count(Book: {filter: {rating: {_eq: null}}}) s: _sum(Book: {field: pages}, Article: {field: points}) m: _min(Book: {field: rating, order: {rating: DESC}, limit: 2}) a: _avg(Author: {field: age, filter: {age: {_gt: 99}}}) Author { name } }")
    assert [out[k].first()[0] for k in "nsma"] == [1, 253, 8.0, 0.0] and out["Author"].count() == 3


def test_similarity(e):
    got = {r["name"]: r["s"] for r in run(e, "{ Author(filter: {scores: {_any: {_gt: 0}}}) { name s: _similarity(scores: {vector: [1, 1, 1, 0]}) } }")}
    assert got == {"Ann": 5.0}
    assert run(e, '{ Author(filter: {name: {_eq: "Cid"}}) { s: _similarity(scores: {vector: [1, 2]}) } }') == [{"s": 0.0}]
    with pytest.raises(Exception, match="elements"):
        run(e, "{ Author { s: _similarity(scores: {vector: [1]}) } }")
    with pytest.raises(QueryError):
        run(e, "{ Author { s: _similarity(name: {vector: [1]}) } }")


def test_language(e):
    (df,) = e.request("query A { Author { name } } query B($id: [String!] = [\"a1\"]) { Author(docID: $id) { ...F } } fragment F on Author { who: name __typename }", {"id": ["a2"]}, "B").values()
    assert [r.asDict() for r in df.collect()] == [{"who": "Bob", "__typename": "Author"}]
    for bad in ("{ Author { name", "{ Author(docID: $x) { name } }", "{ Nope { name } }", "{ Author { nope } }", "{ Author { ...G } }", "{ Author { x: name x: age } }"):
        with pytest.raises(QueryError):
            run(e, bad)
