"""Schemas, mutations, views, lenses, history, subscriptions, backup and explain."""

import pytest
from pyspark.sql import functions as F

from docloom.catalog import Index
from docloom.engine import Engine, to_json
from docloom.functions import crdt
from docloom.operators import lens
from docloom.parser.sdl import parse_schema
from docloom.sources import commits as log
from docloom.types import QueryError, SchemaError, check_value, spark_type

SDL = "type User @index(includes: [{field: \"name\"}, {field: \"age\", direction: DESC}]) { name: String @index(unique: true)  age: Int @default(int: 7)  points: Float @crdt(type: pncounter)  up: Int @crdt(type: pcounter)  tags: [String!] @constraints(size: 2)  data: Blob  meta: JSON }"


@pytest.fixture
def e(spark):
    e = Engine(spark)
    e.add_schema(SDL)
    e.request('mutation { create_User(input: [{name: "Ann", points: 1.5, tags: ["a", null]}, {name: "Bob", age: 3, meta: {k: 1}}]) { name } }')
    return e


def users(e, more=""):
    return sorted((tuple(r) for r in e.request("{ User%s { name age points _deleted } }" % more)["User"].collect()), key=str)


def test_schema():
    a, b = parse_schema("type A { x: [Int!]  bs: [B] @relation(name: \"r\") } type B { a: A @relation(name: \"r\")  me: Self @relation(name: \"s\") }")
    assert a.relations["bs"].many and b.relations["a"].own == "a_id" and a.relations["bs"].other == "a_id" and b.relations["me"].target == "B"
    one, two = parse_schema("type P { q: Q @primary } type Q { p: P }")
    assert one.relations["q"].own == "q_id" and two.relations["p"].other == "q_id" and not two.relations["p"].many
    for bad in ("type A { x: Nope }", "type A { x: String! }", "type A { x: [DateTime] }", "type A { bs: [B] } type B { as: [A] }", "type A { x: String @crdt(type: pncounter) }", "type A { b: B } type B { a: A }", "type A { x: Int } type A { y: Int }"):
        with pytest.raises((SchemaError, QueryError)):
            parse_schema(bad)
    assert spark_type("[Float32]").simpleString() == "array<float>"
    assert check_value("x", "Int", 2.9) == 2 and check_value("x", "[Int!]", [1, None]) == [1, 0]
    with pytest.raises(QueryError):
        check_value("x", "Blob", "xyz")


def test_mutations(e):
    assert users(e) == [("Ann", 7, 1.5, False), ("Bob", 3, None, False)]
    got = e.request('mutation { update_User(filter: {name: {_eq: "Ann"}}, input: {age: 8, points: 2}) { name age points } }')["update_User"].collect()
    assert [tuple(r) for r in got] == [("Ann", 8, 3.5)]
    out = e.request('mutation { delete_User(filter: {age: {_lt: 5}}) { name _deleted } }')["delete_User"].collect()
    assert [tuple(r) for r in out] == [("Bob", True)]
    assert users(e) == [("Ann", 8, 3.5, False)] and len(users(e, "(showDeleted: true)")) == 2
    with pytest.raises(QueryError):
        e.request('mutation { create_User(input: {name: "Ann"}) { name } }')  # the name must be unique
    with pytest.raises(QueryError):
        e.request('mutation { create_User(input: {name: "Cid", tags: ["a"]}) { name } }')
    with pytest.raises(QueryError):
        e.request("mutation { update_User(input: {up: -1}) { name } }")
    assert e.exists("User", e.doc_ids("User").first()[0]) and not e.exists("User", "nope")


def test_upsert(e):
    up = 'mutation { upsert_User(filter: {name: {_eq: "%s"}}, create: {name: "%s"}, update: {age: 50}) { name age } }'
    assert [tuple(r) for r in e.request(up % ("Ann", "Ann"))["upsert_User"].collect()] == [("Ann", 50)]
    assert [tuple(r) for r in e.request(up % ("Cid", "Cid"))["upsert_User"].collect()] == [("Cid", 7)]
    for bad in ('mutation { upsert_User(filter: {age: {_gt: 0}}, create: {name: "x"}, update: {age: 1}) { name } }', 'mutation { upsert_User(filter: {age: {_gt: 0}}, create: null, update: {age: 1}) { name } }'):
        with pytest.raises(QueryError):
            e.request(bad)


def test_views_agree(e, tmp_path):
    for kind in (None, f"file://{tmp_path}/view"):
        name = "Kept" if kind else "Live"
        e.add_view(name, "{ User { who: name age } }", lens.chain(lens.set_default("x", 1), lens.remove("age"), lens.prepend({"who": "first"})), kind)
        if kind:
            e.refresh_view(name)
        got = e.request("{ %s(filter: {who: {_ne: \"Bob\"}}) { who x } }" % name)[name].collect()
        assert sorted(map(tuple, got), key=str) == [("Ann", 1), ("first", None)]
    with pytest.raises(QueryError):
        e.refresh_view("Live")


def test_lens_history(spark):
    h = lens.History()
    h.migrate("1", "2", lens.set_default("b", 5), lens.remove("b"))
    h.migrate("2", "3", lens.copy("b", "c"), lens.remove("c"))
    one = spark.createDataFrame([(1,)], "a long")
    three = spark.createDataFrame([(2, 6, 7)], "a long, b long, c long")
    assert sorted(map(tuple, h.read({"1": one, "3": three}, "3").select("a", "b", "c").collect())) == [(1, 5, 5), (2, 6, 7)]
    assert sorted(map(tuple, h.read({"1": one, "3": three}, "1").collect())) == [(1,), (2,)]


LOG = [
    ("c1", "d", "name", 1, '"A"', None, [], []), ("c2", "d", "points", 1, "5", None, [], []), ("c3", "d", "_C", 1, None, None, [], [("name", "c1"), ("points", "c2")]),
    ("c4", "d", "name", 2, '"B"', None, ["c1"], []), ("c5", "d", "_C", 2, None, None, ["c3"], [("name", "c4")]),
    ("c6", "d", "name", 2, '"C"', None, ["c1"], []), ("c7", "d", "points", 2, "-2", None, ["c2"], []), ("c8", "d", "_C", 2, None, None, ["c3"], [("name", "c6"), ("points", "c7")]),
    ("c9", "x", "_C", 1, None, "deleted", [], []),
]


@pytest.fixture
def logged(spark):
    e = Engine(spark)
    e.add_schema("type User { name: String  points: Int @crdt(type: pncounter) }")
    df = spark.createDataFrame([(c, d, "User", f, h, v, s, "v", hs, ls, None) for c, d, f, h, v, s, hs, ls in LOG], log.SCHEMA)
    e.merge("User", df)
    return e


def test_merge_and_time_travel(logged):
    assert [tuple(r) for r in logged.request("{ User(showDeleted: true, order: [{_docID: ASC}]) { _docID name points _deleted } }")["User"].collect()] == [("d", "C", 3, False), ("x", None, 0, True)]
    at = lambda c: [tuple(r) for r in logged.request('{ User(cid: "%s") { name points } }' % c)["User"].collect()]
    assert at("c3") == [("A", 5)] and at("c5") == [("B", 5)] and at("c8") == [("C", 3)]


def test_commits(logged):
    cids = lambda text: sorted(r[0] for r in next(iter(logged.request(text).values())).collect())
    assert cids('{ commits(docID: "d", fieldName: "name") { cid } }') == ["c1", "c4", "c6"]
    assert cids('{ latestCommits(docID: "d") { cid } }') == ["c5", "c8"]
    assert cids('{ commits(docID: "d", fieldName: "_C", depth: 1) { cid } }') == ["c5", "c8"]
    assert cids('{ commits(cid: "c4", depth: 2) { cid } }') == ["c1", "c4"]
    assert cids("{ commits(order: [{height: DESC}], limit: 2, filter: {fieldName: {_eq: \"points\"}}) { cid } }") == ["c2", "c7"]
    n = {r.cid: r.n for r in logged.request("{ commits { cid n: _count(field: links) links { cid name } } }")["commits"].collect()}
    assert n["c8"] == 2 and n["c1"] == 0
    v = logged.request("{ User { name _version { cid height } } }")["User"].first()
    assert [x.cid for x in v._version] == ["c5", "c8"]
    with pytest.raises(QueryError):
        logged.request("{ latestCommits { cid } }")


def test_register_ties_and_counters(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (1, "z")], "h long, v string")
    assert df.agg(crdt.lww(F.col("v"), F.col("h"))).first()[0] == "c"
    with pytest.raises(Exception, match="negative"):
        df.agg(crdt.p_counter(F.lit(-1))).collect()


def test_subscription(e, spark, tmp_path):
    schema = "_docID string, name string, age long, points double, up long, tags array<string>, data string, meta string, _height long"
    rows = [("1", "Ann", 5, None, None, None, None, None, 1), ("1", "Ann", 50, None, None, None, None, None, 2), ("2", "Bob", 1, None, None, None, None, None, 1)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    got = []
    q = e.subscribe("subscription { User(filter: {age: {_gt: 10}}) { name age } }", spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), lambda df, n: got.extend(map(tuple, df.collect())), f"file://{tmp_path}/state", once=True)
    q.awaitTermination()
    assert got == [("Ann", 50)]
    with pytest.raises(QueryError):
        e.subscribe("subscription { User(limit: 1) { name } }", None, None, "")


def test_backup_index_and_explain(e, tmp_path):
    e.export(f"file://{tmp_path}/b")
    before = users(e)
    e.load("User", e.catalog["User"].documents().limit(0))
    assert users(e) == []
    e.restore(f"file://{tmp_path}/b", ["User"])
    assert users(e) == before
    e.create_index("User", Index((("age", False),), "by_age"))
    assert [i.name for i in e.indexes("User")][-1] == "by_age"
    e.drop_index("User", "by_age")
    e.write("User", f"file://{tmp_path}/t")
    assert users(e) == before
    assert "Filter" in e.request("query @explain { User(filter: {age: {_gt: 3}}) { name } }")["User"]
    assert e.request("query @explain(type: execute) { User { name } }")["User"]["sizeOfResult"] == 2
    assert '"name": "Ann"' in to_json(e.request("{ User(filter: {age: {_eq: 7}}) { name } }"))


def test_permissions(e, spark):
    one = e.request('{ User(filter: {name: {_eq: "Ann"}}) { _docID } }')["User"].first()[0]
    e.permitted("User", spark.createDataFrame([(one, "me"), (one, "you")], "docID string, identity string"), "me")
    assert [u[0] for u in users(e)] == ["Ann"]


def test_collection_methods(spark):
    e = Engine(spark)
    e.add_schema("type User { name: String @index(unique: true) age: Int }")
    assert [r.name for r in e.create("User", {"name": "A", "age": 1}, "name").collect()] == ["A"]
    e.create_many("User", [{"name": "B", "age": 2}, {"name": "C", "age": 3}])
    a = e.catalog["User"].documents().where("name = 'A'").first()["_docID"]
    assert e.update("User", a, {"age": 10}, "age").first().age == 10
    assert e.save("User", {"_docID": a, "age": 11}, "age").first().age == 11
    assert e.save("User", {"name": "D", "age": 4}, "name").first().name == "D"
    assert e.update_with_filter("User", {"age": {"_lt": 4}}, {"age": 0}, "name").count() == 2
    assert e.delete_with_filter("User", {"age": {"_eq": 0}}, "name").count() == 2
    assert e.delete("User", a) and not e.exists("User", a)
    with pytest.raises(QueryError):
        e.delete("User", a)
    with pytest.raises(QueryError):
        e.create("User", {"name": "D", "age": 5})
    assert [r.name for r in e.request("{ User { name } }")["User"].collect()] == ["D"]
    assert e.commits.where("fieldName = '_C' and status = 'deleted'").count() == 3


def test_commits_of_mutations_fold_to_the_documents(spark):
    e = Engine(spark)
    e.add_schema("type User { name: String points: Int @crdt(type: pncounter) at: DateTime tags: [String] }")
    e.create_many("User", [{"name": "A", "points": 1, "at": "2020-01-02T03:04:05Z", "tags": ["x", "y"]}, {"name": "B"}])
    for k in range(3):
        e.update_with_filter("User", {"name": {"_eq": "A"}}, {"points": k, "tags": [str(k)]})
    e.delete_with_filter("User", {"name": {"_eq": "B"}})
    now = sorted(e.catalog["User"].documents().select("_docID", "name", "at", "tags", "_deleted").collect())
    points = {r._docID: r.points for r in e.catalog["User"].documents().collect()}
    other = Engine(spark)
    other.add_schema("type User { name: String points: Int @crdt(type: pncounter) at: DateTime tags: [String] }")
    other.merge("User", e.commits.union(e.commits))
    other.merge("User", e.commits)
    back = other.catalog["User"].documents()
    assert sorted(back.select("_docID", "name", "at", "tags", "_deleted").collect()) == now
    assert {r._docID: r.points or None for r in back.collect()} == {k: v or None for k, v in points.items()}
    heads = log.latest(e.commits).groupBy("docID", "fieldName").count()
    assert heads.where("count > 1").isEmpty()


def test_one_to_one_holds_on_update_and_after_deletion(spark):
    e = Engine(spark)
    e.add_schema("type Author { name: String address: Address } type Address { street: String author: Author @primary }")
    e.create_many("Author", [{"name": "Ann"}, {"name": "Bob"}])
    ann, bob = (e.catalog["Author"].documents().where(f"name = '{n}'").first()["_docID"] for n in ("Ann", "Bob"))
    e.create("Address", {"street": "A", "author": ann})
    e.create("Address", {"street": "B", "author": bob})
    b = e.catalog["Address"].documents().where("street = 'B'").first()["_docID"]
    with pytest.raises(QueryError, match="already linked"):
        e.update("Address", b, {"author": ann})
    e.update("Address", b, {"author": None})
    e.create("Address", {"street": "C", "author": bob})
    e.update("Address", b, {"street": "D"})
    assert e.request("{ Author { name address { street } } }")["Author"].count() == 2


def test_embeddings_come_from_a_given_function(spark):
    e = Engine(spark)
    e.add_schema('type Note { title: String text: String v: [Float32!] @embedding(fields: ["title", "text"], provider: "own", model: "m") }')
    seen = []

    def embed(texts, model):
        seen.append((list(texts), model))
        return [[float(len(t)), 1.0] for t in texts]

    e.embed_with("own", embed)
    e.create_many("Note", [{"title": "a", "text": "bc"}, {"title": "x", "v": [9.0, 9.0]}])
    assert seen == [(["a\nbc"], "m")]
    assert sorted(r.v for r in e.request("{ Note { v } }")["Note"].collect()) == [[4.0, 1.0], [9.0, 9.0]]
    e.update_with_filter("Note", {"title": {"_eq": "a"}}, {"text": "bcdef"})
    assert seen[1] == (["bcdef"], "m")


def test_aggregates_over_one_target_are_joined_once(spark):
    e = Engine(spark)
    e.add_schema("type Author { name: String books: [Book] } type Book { rating: Float pages: Int author: Author }")
    e.load("Author", spark.createDataFrame([("a", "A"), ("b", "B")], "_docID string, name string"))
    e.load("Book", spark.createDataFrame([("1", 1.0, 10, "a"), ("2", 3.0, 30, "a")], "_docID string, rating double, pages int, author_id string"))
    df = e.request("{ Author(order: [{name: ASC}]) { name n: _count(books: {}) s: _sum(books: {field: rating}) p: _max(books: {field: pages}) few: _count(books: {filter: {pages: {_gt: 10}}}) } }")["Author"]
    assert [tuple(r) for r in df.collect()] == [("A", 2, 4.0, 30, 1), ("B", 0, 0.0, None, 0)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2


def test_index_lays_out_and_filters_reach_the_scan(spark, tmp_path):
    e = Engine(spark)
    e.add_schema("type User { name: String age: Int @index }")
    e.load("User", spark.range(2000).select(F.concat(F.lit("k"), "id").alias("_docID"), F.lit("x").alias("name"), (F.col("id") * 7919 % 2000).cast("int").alias("age")))
    e.write("User", f"file://{tmp_path}/u")
    df = e.request("{ User(filter: {age: {_ge: 10, _lt: 20}}) { name age } }")["User"]
    assert df.count() == 10
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(age,10)" in plan
    # Each file holds a range of ages of its own.
    files = spark.read.parquet(f"file://{tmp_path}/u").groupBy(F.input_file_name().alias("f")).agg(F.min("age").alias("lo"), F.max("age").alias("hi")).orderBy("lo").collect()
    assert all(a.hi < b.lo for a, b in zip(files, files[1:]))
