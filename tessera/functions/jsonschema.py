"""JSON Pointer and JSON Schema (2020-12) over JSON columns."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from typing import Any
from urllib.parse import unquote, urldefrag, urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F


def pointer(document: Any, text: str) -> Any:
    """The value that an RFC 6901 pointer names; KeyError if there is none."""
    if text and not text.startswith("/"):
        raise KeyError(text)
    at = document
    for part in text.split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        if isinstance(at, list):
            if not re.fullmatch(r"0|[1-9]\d*", part) or int(part) >= len(at):
                raise KeyError(text)
            at = at[int(part)]
        elif isinstance(at, dict) and part in at:
            at = at[part]
        else:
            raise KeyError(text)
    return at


def pointer_column(source: Column, text: str, kind: str = "string") -> Column:
    """The same in the JVM: names as object keys, numbers as array places."""
    parts = [p.replace("~1", "/").replace("~0", "~") for p in text.split("/")[1:]]
    path = "$" + "".join(f"[{p}]" if re.fullmatch(r"0|[1-9]\d*", p) else f"['{p}']" for p in parts)
    return F.try_variant_get(F.try_parse_json(source), path, kind)


def walk(document: Any, at: str = "") -> Iterator[tuple[str, Any]]:
    """Every (pointer, value) of a document, parents first."""
    stack = [(at, document)]
    while stack:
        where, x = stack.pop()
        yield where, x
        inner = x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ()
        stack.extend(reversed([(f"{where}/{str(k).replace('~', '~0').replace('/', '~1')}", v) for k, v in inner]))


def same(a: Any, b: Any) -> bool:
    """JSON equality: numbers by value, booleans apart from numbers."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(v, b[k]) for k, v in a.items())
    return a == b


_TYPES = {
    "null": lambda x: x is None, "boolean": lambda x: isinstance(x, bool), "string": lambda x: isinstance(x, str), "array": lambda x: isinstance(x, list), "object": lambda x: isinstance(x, dict),
    "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool), "integer": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and float(x).is_integer(),
}


class Schema:
    """A compiled schema with its registry of ids and anchors."""

    def __init__(self, schema: Any, others: dict[str, Any] | None = None):
        self.root = schema
        self.ids: dict[str, Any] = {}
        self.dynamic: dict[str, list[Any]] = {}
        for base, s in [("", schema), *(others or {}).items()]:
            self._register(s, base)

    def _register(self, s: Any, base: str) -> None:
        self.ids.setdefault(base, s)
        stack = [(s, base)]
        while stack:
            x, b = stack.pop()
            if isinstance(x, dict):
                if isinstance(x.get("$id"), str):
                    b = urljoin(b, x["$id"])
                    self.ids[b.rstrip("#")] = x
                for key in ("$anchor", "$dynamicAnchor"):
                    if isinstance(x.get(key), str):
                        self.ids[f"{b}#{x[key]}"] = x
                        if key == "$dynamicAnchor":
                            self.dynamic.setdefault(x[key], []).append(x)
                stack += [(v, b) for k, v in x.items() if k not in ("enum", "const")]
            elif isinstance(x, list):
                stack += [(v, b) for v in x]

    def resolve(self, ref: str, base: str) -> tuple[Any, str]:
        full = urljoin(base, ref)
        if full in self.ids:
            return self.ids[full], urldefrag(full)[0]
        at, fragment = urldefrag(full)
        if at not in self.ids:
            raise KeyError(ref)
        return (pointer(self.ids[at], unquote(fragment)) if fragment else self.ids[at]), at

    def errors(self, value: Any) -> list[tuple[str, str]]:
        """(instance pointer, keyword) of everything that fails."""
        return self._check(self.root, value, "", "", 0)[0]

    def valid(self, value: Any) -> bool:
        return not self.errors(value)

    def _check(self, s: Any, v: Any, at: str, base: str, depth: int) -> tuple[list[tuple[str, str]], set]:
        """Errors, and the property names and indices that were evaluated."""
        if s is True:
            return [], set()
        if s is False:
            return [(at, "false")], set()
        if depth > 200:
            raise RecursionError("the schema refers to itself without end")
        if isinstance(s.get("$id"), str):
            base = urljoin(base, s["$id"])
        out: list[tuple[str, str]] = []
        seen: set = set()

        def fail(keyword: str) -> None:
            out.append((at, keyword))

        def inner(schema: Any, value: Any, where: str = at, b: str = base) -> tuple[list, set]:
            return self._check(schema, value, where, b, depth + 1)

        for key in ("$ref", "$dynamicRef"):
            if key in s:
                target, b = self.resolve(s[key], base)
                if key == "$dynamicRef" and self.dynamic.get(s[key].lstrip("#")):
                    target = self.dynamic[s[key].lstrip("#")][0]
                e, n = inner(target, v, at, b)
                out += e
                seen |= n
        if "type" in s and not any(_TYPES[t](v) for t in ([s["type"]] if isinstance(s["type"], str) else s["type"])):
            fail("type")
        if "enum" in s and not any(same(v, x) for x in s["enum"]):
            fail("enum")
        if "const" in s and not same(v, s["const"]):
            fail("const")
        if _TYPES["number"](v):
            for k, bad in (("minimum", lambda b: v < b), ("maximum", lambda b: v > b), ("exclusiveMinimum", lambda b: v <= b), ("exclusiveMaximum", lambda b: v >= b)):
                if k in s and bad(s[k]):
                    fail(k)
            if "multipleOf" in s and not math.isclose(v / s["multipleOf"], round(v / s["multipleOf"]), rel_tol=1e-12, abs_tol=1e-12):
                fail("multipleOf")
        if isinstance(v, str):
            if "minLength" in s and len(v) < s["minLength"]:
                fail("minLength")
            if "maxLength" in s and len(v) > s["maxLength"]:
                fail("maxLength")
            if "pattern" in s and not re.search(s["pattern"], v):
                fail("pattern")
        if isinstance(v, list):
            self._array(s, v, at, inner, fail, out, seen)
        if isinstance(v, dict):
            self._object(s, v, at, inner, fail, out, seen)
        for key in ("allOf", "anyOf", "oneOf"):
            if key in s:
                results = [inner(x, v) for x in s[key]]
                good = [n for e, n in results if not e]
                for n in good:
                    seen |= n
                if key == "allOf":
                    for e, _ in results:
                        out += e
                elif not good or key == "oneOf" and len(good) != 1:
                    fail(key)
        if "not" in s and not inner(s["not"], v)[0]:
            fail("not")
        if "if" in s:
            e, n = inner(s["if"], v)
            seen |= set() if e else n
            branch = s.get("else" if e else "then")
            if branch is not None:
                e, n = inner(branch, v)
                out += e
                seen |= n
        if isinstance(v, dict) and "unevaluatedProperties" in s:
            for k in v.keys() - seen:
                out += inner(s["unevaluatedProperties"], v[k], f"{at}/{k}")[0]
            seen |= v.keys()
        if isinstance(v, list) and "unevaluatedItems" in s:
            for k in set(range(len(v))) - seen:
                out += inner(s["unevaluatedItems"], v[k], f"{at}/{k}")[0]
            seen |= set(range(len(v)))
        return out, seen

    @staticmethod
    def _array(s, v, at, inner, fail, out, seen) -> None:
        if "minItems" in s and len(v) < s["minItems"]:
            fail("minItems")
        if "maxItems" in s and len(v) > s["maxItems"]:
            fail("maxItems")
        if s.get("uniqueItems") and any(same(a, b) for k, a in enumerate(v) for b in v[:k]):
            fail("uniqueItems")
        first = len(s.get("prefixItems", ()))
        for k, x in enumerate(v):
            sub = s["prefixItems"][k] if k < first else s.get("items")
            if sub is not None:
                out += inner(sub, x, f"{at}/{k}")[0]
                seen.add(k)
        if "contains" in s:
            hits = [k for k, x in enumerate(v) if not inner(s["contains"], x, f"{at}/{k}")[0]]
            seen.update(hits)
            if len(hits) < s.get("minContains", 1):
                fail("contains")
            if len(hits) > s.get("maxContains", len(hits)):
                fail("maxContains")

    @staticmethod
    def _object(s, v, at, inner, fail, out, seen) -> None:
        for k in s.get("required", ()):
            if k not in v:
                fail("required")
        if "minProperties" in s and len(v) < s["minProperties"]:
            fail("minProperties")
        if "maxProperties" in s and len(v) > s["maxProperties"]:
            fail("maxProperties")
        for k, x in v.items():
            known = False
            if k in s.get("properties", ()):
                out += inner(s["properties"][k], x, f"{at}/{k}")[0]
                known = True
            for p, sub in s.get("patternProperties", {}).items():
                if re.search(p, k):
                    out += inner(sub, x, f"{at}/{k}")[0]
                    known = True
            if not known and "additionalProperties" in s:
                out += inner(s["additionalProperties"], x, f"{at}/{k}")[0]
                known = True
            if known:
                seen.add(k)
            if "propertyNames" in s and inner(s["propertyNames"], k)[0]:
                fail("propertyNames")
        for k, names in s.get("dependentRequired", {}).items():
            if k in v and not all(n in v for n in names):
                fail("dependentRequired")
        for k, sub in s.get("dependentSchemas", {}).items():
            if k in v:
                e, n = inner(sub, v)
                out += e
                seen |= n


def validate(source: Column, schema: Any) -> Column:
    """ARRAY<STRUCT<at, keyword>> of the errors of each row's JSON; null for a null row, one error `json` for bad JSON."""

    @F.udf("array<struct<at:string,keyword:string>>", useArrow=True)
    def run(row: str | None):
        if row is None:
            return None
        try:
            value = json.loads(row)
        except ValueError:
            return [{"at": "", "keyword": "json"}]
        return [{"at": a, "keyword": k} for a, k in Schema(schema).errors(value)]

    return run(source)


def required(source: Column, kinds: dict[str, str]) -> Column:
    """The common case without Python: whether each name is there with a value of that Spark type."""
    parsed = F.try_parse_json(source)
    out = F.lit(True)
    for name, kind in kinds.items():
        out = out & F.try_variant_get(parsed, f"$.{name}", kind).isNotNull()
    return F.coalesce(out, F.lit(False))
