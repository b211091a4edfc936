"""Collections from type declarations."""

from __future__ import annotations

from ..catalog import Collection, Field, Index, Relation
from ..types import SchemaError, is_scalar, spark_type
from .tokens import Tokens


def parse_schema(text: str) -> list[Collection]:
    """Types and interfaces; relations are matched up by @relation name, or else by the two types."""
    t, raw = Tokens(text), []
    while t.kind() != "end":
        if t.kind() in ("string", "block"):
            t.take()
            continue
        word = t.name()
        if word not in ("type", "interface"):
            raise SchemaError(f"expected type, found {word}")
        name, directives, fields = t.name(), t.directives(), []
        t.take("{")
        while not t.has("}"):
            field = t.name()
            arguments = t.arguments()
            t.take(":")
            if t.has("["):
                kind = "[" + t.name() + ("!" if t.has("!") else "") + "]"
                t.take("]")
            else:
                kind = t.name()
            kind += "!" if t.has("!") else ""
            fields.append((field, kind, t.directives(), arguments))
        raw.append((name, word, directives, fields))
    names = {r[0] for r in raw}
    if len(names) != len(raw):
        raise SchemaError("a type is declared twice")
    ends: dict[str, list[tuple[str, str, str, bool, bool]]] = {}
    for name, _, _, fields in raw:
        for field, kind, directives, _ in fields:
            target = kind.strip("[]!")
            if not is_scalar(kind):
                target = name if target == "Self" else target
                if target not in names:
                    raise SchemaError(f"{name}.{field}: no type {target}")
                label = directives.get("relation", {}).get("name") or "_".join(sorted((name, target)))
                ends.setdefault(label, []).append((name, field, target, kind.startswith("["), "primary" in directives))
    links: dict[tuple[str, str], Relation] = {}
    for label, two in ends.items():
        if len(two) > 2:
            raise SchemaError(f"relation {label} has more than two ends")
        if len(two) == 1:
            name, field, target, many, _ = two[0]
            if many:
                raise SchemaError(f"{name}.{field} needs its other end")
            links[name, field] = Relation(field, target, False, f"{field}_id", "_docID")
            continue
        a, b = two
        if a[3] and b[3]:
            raise SchemaError(f"relation {label} is many to many")
        holder = a if b[3] or (not a[3] and a[4] and not b[4]) else b
        if not a[3] and not b[3] and a[4] == b[4]:
            raise SchemaError(f"relation {label} needs one @primary end")
        other = b if holder is a else a
        key = f"{holder[1]}_id"
        links[holder[0], holder[1]] = Relation(holder[1], holder[2], False, key, "_docID")
        links[other[0], other[1]] = Relation(other[1], other[2], other[3], "_docID", key)
    out = []
    for name, word, directives, fields in raw:
        plain, relations, indexes = {}, {}, []
        for field, kind, marks, _ in fields:
            if (r := links.get((name, field))) is not None:
                relations[field] = r
                if r.own != "_docID":
                    plain[r.own] = Field(r.own, "ID")
            else:
                spark_type(kind)
                default = next(iter(marks.get("default", {}).values()), None)
                plain[field] = Field(field, kind, str(marks.get("crdt", {}).get("type", "lww")), default, marks.get("constraints", {}).get("size"), marks.get("embedding"))
            if "index" in marks:
                indexes.append(_index(marks["index"], field))
        if "index" in directives:
            indexes.append(_index(directives["index"], None))
        options = {"policy": directives.get("policy"), "branchable": directives.get("branchable", {}).get("if", "branchable" in directives), "materialized": directives.get("materialized", {}).get("if", True)}
        out.append(Collection(name, fields=plain, relations=relations, indexes=tuple(indexes), json=frozenset(f for f, x in plain.items() if x.kind == "JSON"), options=options, embedded=word == "interface"))
    return out


def _index(marks: dict, field: str | None) -> Index:
    down = str(marks.get("direction", "ASC")).upper() == "DESC"
    parts = [(x["field"], str(x.get("direction", "DESC" if down else "ASC")).upper() == "DESC") for x in marks.get("includes", ())]
    if field is not None and field not in [n for n, _ in parts]:
        parts.insert(0, (field, down))
    return Index(tuple(parts), marks.get("name", ""), bool(marks.get("unique", False)))
