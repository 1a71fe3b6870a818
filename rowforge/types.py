"""Record types: a tree of nodes that says what a record must look like. Fields are kept in order of their names."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from typing import Any

KINDS = frozenset("string number bigint boolean date literal enum null array tuple object record union any never".split())


def name_order(name: str) -> bytes:
    """Names are ordered by UTF-16 units."""
    return name.encode("utf-16-be", "surrogatepass")


@dataclass(frozen=True)
class Node:
    kind: str
    optional: bool = False
    nullable: bool = False
    brand: str | None = None
    item: Node | None = None
    items: tuple[Node, ...] = ()
    fields: tuple[tuple[str, Node], ...] = ()
    literals: tuple[Any, ...] = ()

    def maybe(self) -> Node:
        """The field may be missing."""
        return replace(self, optional=True)

    def or_null(self) -> Node:
        return replace(self, nullable=True)

    def branded(self, brand: str) -> Node:
        if self.kind not in ("string", "number"):
            raise TypeError(f"a {self.kind} takes no brand")
        return replace(self, brand=brand)


string, number, bigint, boolean, date, null, any_, never = (Node(k) for k in ("string", "number", "bigint", "boolean", "date", "null", "any", "never"))
integer = number.branded("integer")


def literal(*values: Any) -> Node:
    return Node("literal", literals=tuple(v for v in values if v is not None), nullable=None in values)


def enum(*values: Any) -> Node:
    """As ``literal``, with a message of its own; null is never one of them."""
    return Node("enum", literals=values)


def array(item: Node) -> Node:
    return Node("array", item=item)


def tuple_(*items: Node) -> Node:
    """Optional items must stand last."""
    if any(a.optional and not b.optional for a, b in zip(items, items[1:], strict=False)):
        raise TypeError("a required item can't follow an optional one")
    return Node("tuple", items=items)


def object_(fields: Mapping[str, Node] | None = None, **more: Node) -> Node:
    return Node("object", fields=tuple(sorted({**(fields or {}), **more}.items(), key=lambda f: name_order(f[0]))))


def record(value: Node | None = None) -> Node:
    """Any keys, each with a value of one type."""
    return Node("record", item=value)


def union(*branches: Node, literals: tuple = ()) -> Node:
    """Literals are tried first, then the branches in order. Null branches make it nullable."""
    values = tuple(v for b in branches if b.kind == "literal" for v in b.literals) + tuple(literals)
    rest = tuple(b for b in branches if b.kind not in ("literal", "null"))
    nullable = any(b.kind == "null" or b.nullable for b in branches)
    if not rest:
        return Node("literal", literals=values, nullable=nullable)
    if len(rest) == 1 and not values:
        return replace(rest[0], nullable=nullable)
    if {b.kind for b in rest} & {"any", "never"}:
        return any_
    return Node("union", items=rest, literals=values, nullable=nullable)


def merge(*objects: Node) -> Node:
    """An intersection of object types: all their fields, of repeated ones the last."""
    return object_({k: v for o in objects for k, v in o.fields})


def partial(node: Node) -> Node:
    return replace(node, fields=tuple((k, v.maybe()) for k, v in node.fields))


def required(node: Node) -> Node:
    return replace(node, fields=tuple((k, replace(v, optional=False)) for k, v in node.fields))


def pick(node: Node, *names: str) -> Node:
    return replace(node, fields=tuple(f for f in node.fields if f[0] in names))


def omit(node: Node, *names: str) -> Node:
    return replace(node, fields=tuple(f for f in node.fields if f[0] not in names))
