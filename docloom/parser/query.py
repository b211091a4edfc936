"""Requests in the query language, as selections."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..spec import Aggregate, Plain, Select, Similarity, Target
from ..types import QueryError
from .tokens import Tokens, Variable

AGGREGATES = ("_count", "_sum", "_avg", "_min", "_max")
_KNOWN = {"docID", "docIDs", "filter", "groupBy", "order", "limit", "offset", "showDeleted", "cid"}


@dataclass
class Operation:
    kind: str  # query, mutation, subscription
    name: str = ""
    roots: list = field(default_factory=list)  # Select, Aggregate or Mutation
    explain: str | None = None


@dataclass
class Mutation:
    action: str  # create, update, delete, upsert
    collection: str
    arguments: dict
    select: Select


def parse_request(text: str, variables: dict | None = None, operation: str | None = None) -> Operation:
    t = Tokens(text)
    raw, fragments = [], {}
    while t.kind() != "end":
        if t.has("fragment"):
            name = t.name()
            t.take("on")
            t.name()
            t.directives()
            fragments[name] = _selection(t)
            continue
        kind, name, defaults, marks = "query", "", {}, {}
        if t.peek() != "{":
            kind = t.name()
            if kind not in ("query", "mutation", "subscription"):
                raise QueryError(f"unknown operation {kind}")
            name = t.name() if t.kind() == "name" else ""
            if t.has("("):
                while not t.has(")"):
                    t.take("$")
                    var = t.name()
                    t.take(":")
                    while t.peek() not in ("=", "$", ")"):
                        t.take()
                    defaults[var] = t.value() if t.has("=") else None
            marks = t.directives()
        raw.append((kind, name, defaults, marks, _selection(t)))
    if not raw:
        raise QueryError("no operation")
    if operation:
        raw = [r for r in raw if r[1] == operation]
        if not raw:
            raise QueryError(f"no operation {operation}")
    kind, name, defaults, marks, nodes = raw[0]
    lower = _Lower({**defaults, **(variables or {})}, fragments)
    out = Operation(kind, name, explain=str(marks["explain"].get("type", "simple")) if "explain" in marks else None)
    for node in lower.flat(nodes):
        out.roots.append(lower.root(node, kind))
    return out


@dataclass
class _Node:
    name: str
    alias: str = ""
    arguments: dict = field(default_factory=dict)
    nodes: list | None = None
    spread: bool = False


def _selection(t: Tokens) -> list[_Node]:
    t.take("{")
    out = []
    while not t.has("}"):
        if t.has("..."):
            if t.has("on"):
                t.name()
                out.append(_Node("", nodes=_selection(t), spread=True))
            else:
                out.append(_Node(t.name(), spread=True))
            continue
        name, alias = t.name(), ""
        if t.has(":"):
            alias, name = name, t.name()
        node = _Node(name, alias, t.arguments())
        t.directives()
        if t.peek() == "{":
            node.nodes = _selection(t)
        out.append(node)
    return out


class _Lower:
    def __init__(self, variables: dict, fragments: dict) -> None:
        self.variables, self.fragments = variables, fragments

    def value(self, x):
        if isinstance(x, Variable):
            if x not in self.variables:
                raise QueryError(f"no variable ${x}")
            return self.variables[x]
        if isinstance(x, dict):
            return {k: self.value(v) for k, v in x.items()}
        return [self.value(v) for v in x] if isinstance(x, list) else str(x) if isinstance(x, str) else x

    def flat(self, nodes: list[_Node], seen: tuple = ()) -> list[_Node]:
        out = []
        for n in nodes:
            if not n.spread:
                out.append(n)
            elif n.nodes is not None:
                out += self.flat(n.nodes, seen)
            else:
                if n.name not in self.fragments or n.name in seen:
                    raise QueryError(f"no fragment {n.name}, or it contains itself")
                out += self.flat(self.fragments[n.name], (*seen, n.name))
        return out

    def root(self, node: _Node, kind: str):
        if node.name in AGGREGATES:
            return self.aggregate(node)
        if kind == "mutation":
            action, _, collection = node.name.partition("_")
            if action not in ("create", "update", "delete", "upsert") or not collection:
                raise QueryError(f"unknown mutation {node.name}")
            return Mutation(action, collection, {k: self.value(v) for k, v in node.arguments.items()}, Select(collection, self.items(node), alias=node.alias or node.name))
        return self.select(node)

    def aggregate(self, node: _Node) -> Aggregate:
        targets = []
        for host, a in node.arguments.items():
            if node.name == "_count" and host == "field":  # _count(field: links) of commits
                targets.append(Target(str(a)))
                continue
            a = self.value(a) or {}
            targets.append(Target(host, a.get("field"), a.get("filter"), a.get("order"), a.get("limit"), a.get("offset")))
        if not targets:
            raise QueryError(f"{node.name} needs something to run over")
        return Aggregate(node.name, tuple(targets), node.alias)

    def items(self, node: _Node) -> tuple:
        out, seen = [], {}
        for n in self.flat(node.nodes or []):
            if n.name in AGGREGATES:
                item = self.aggregate(n)
            elif n.name == "_similarity":
                if len(n.arguments) != 1:
                    raise QueryError("_similarity takes one field")
                (name, a), = n.arguments.items()
                item = Similarity(name, tuple(self.value(a)["vector"]), n.alias)
            else:
                item = self.select(n) if n.nodes is not None else Plain(n.name, n.alias)
            if item.out in seen:
                if seen[item.out] != item:
                    raise QueryError(f"two selections are called {item.out}")
                continue
            seen[item.out] = item
            out.append(item)
        return tuple(out)

    def select(self, node: _Node) -> Select:
        a = {k: self.value(v) for k, v in node.arguments.items()}
        ids = a.get("docID", a.get("docIDs"))
        order = a.get("order") or ()
        order = (order,) if isinstance(order, dict) else tuple(order)
        if any(len(x) != 1 for x in order):
            raise QueryError("one field for each order entry")
        group = a.get("groupBy")
        return Select(
            node.name, self.items(node), filter=a.get("filter"), group_by=None if group is None else tuple([group] if isinstance(group, str) else group), order=order, limit=a.get("limit"), offset=a.get("offset"),
            doc_ids=None if ids is None else tuple([ids] if isinstance(ids, str) else ids), show_deleted=bool(a.get("showDeleted", False)), cid=a.get("cid"), alias=node.alias, arguments={k: v for k, v in a.items() if k not in _KNOWN},
        )
