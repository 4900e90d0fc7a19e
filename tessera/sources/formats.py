"""RDF/XML, JSON-LD, JSON for terms, CBOR and content identifiers, a document at a time."""

from __future__ import annotations

import base64
import hashlib
import json
import math
import struct
import xml.etree.ElementTree as E
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions import terms as t

QUADS = "s string, p string, o string, g string"
_XML = "{http://www.w3.org/XML/1998/namespace}"
_R = "{" + t.RDF + "}"


def _documents(spark: SparkSession, path: str, parse: Callable[[str, str, str], list[tuple]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = parse(content.decode(), name, hashlib.md5(name.encode()).hexdigest()[:8])
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], names=["s", "p", "o", "g"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, QUADS)


# RDF/XML
def parse_rdfxml(text: str, base: str = "", scope: str = "") -> list[tuple]:
    """Quads of an RDF/XML document."""
    out: list[tuple] = []
    fresh = iter(range(1 << 60))

    def blank(name: str | None = None) -> str:
        return f"B{scope}n{name}" if name else f"B{scope}g{next(fresh)}"

    def name(tag: str) -> str:
        return t.iri(tag[1:].replace("}", "", 1))

    def node(e: E.Element, b: str, lang: str) -> str:
        b, lang = e.get(_XML + "base", b), e.get(_XML + "lang", lang)
        if e.get(_R + "about") is not None:
            s = t.iri(urljoin(b, e.get(_R + "about")))
        elif e.get(_R + "ID") is not None:
            s = t.iri(urljoin(b, "#" + e.get(_R + "ID")))
        else:
            s = blank(e.get(_R + "nodeID"))
        if e.tag != _R + "Description":
            out.append((s, t.iri(t.RDF + "type"), name(e.tag), None))
        attributes(e, s, b, lang)
        count = 0
        for child in e:
            if child.tag == _R + "li":
                count += 1
            prop(child, s, t.iri(f"{t.RDF}_{count}") if child.tag == _R + "li" else name(child.tag), b, lang)
        return s

    def attributes(e: E.Element, s: str, b: str, lang: str) -> None:
        for k, v in e.attrib.items():
            if k.startswith(_XML) or not k.startswith("{") or k in {_R + x for x in ("about", "ID", "nodeID", "resource", "datatype", "parseType")}:
                continue
            out.append((s, name(k), t.iri(urljoin(b, v)) if k == _R + "type" else t.literal(v, lang=lang), None))

    def prop(e: E.Element, s: str, p: str, b: str, lang: str) -> None:
        b, lang = e.get(_XML + "base", b), e.get(_XML + "lang", lang)
        kind = e.get(_R + "parseType")
        if kind == "Resource":
            o = blank()
            for child in e:
                prop(child, o, name(child.tag), b, lang)
        elif kind == "Collection":
            items = [node(c, b, lang) for c in e]
            cells = [blank() for _ in items]
            for k, (c, i) in enumerate(zip(cells, items)):
                out.append((c, t.iri(t.RDF + "first"), i, None))
                out.append((c, t.iri(t.RDF + "rest"), cells[k + 1] if k + 1 < len(cells) else t.iri(t.RDF + "nil"), None))
            o = cells[0] if cells else t.iri(t.RDF + "nil")
        elif kind is not None:
            o = t.literal((e.text or "") + "".join(E.tostring(c, encoding="unicode") for c in e), t.RDF + "XMLLiteral")
        elif len(e):
            o = node(e[0], b, lang)
        elif e.get(_R + "resource") is not None:
            o = t.iri(urljoin(b, e.get(_R + "resource")))
            attributes(e, o, b, lang)
        elif e.get(_R + "nodeID") is not None:
            o = blank(e.get(_R + "nodeID"))
        elif any(k.startswith("{") and not k.startswith((_XML, _R)) for k in e.attrib):
            o = blank()
            attributes(e, o, b, lang)
        else:
            dt = e.get(_R + "datatype")
            o = t.literal(e.text or "", urljoin(b, dt)) if dt else t.literal(e.text or "", lang=lang)
        out.append((s, p, o, None))
        if e.get(_R + "ID") is not None:
            r = t.iri(urljoin(b, "#" + e.get(_R + "ID")))
            for q, x in (("type", t.iri(t.RDF + "Statement")), ("subject", s), ("predicate", p), ("object", o)):
                out.append((r, t.iri(t.RDF + q), x, None))

    root = E.fromstring(text)
    base, lang = root.get(_XML + "base", base), root.get(_XML + "lang", "")
    for e in root if root.tag == _R + "RDF" else [root]:
        node(e, base, lang)
    return out


def read_rdfxml(spark: SparkSession, path: str) -> DataFrame:
    return _documents(spark, path, parse_rdfxml)


# JSON-LD
class Context:
    """An active context: prefixes and terms with their coercions; remote contexts come from a loader."""

    def __init__(self, base: str = "", loader: Callable[[str], Any] | None = None):
        self.base, self.vocab, self.lang, self.terms, self.loader = base, None, None, {}, loader

    def extended(self, local: Any) -> "Context":
        c = Context(self.base, self.loader)
        c.vocab, c.lang, c.terms = self.vocab, self.lang, dict(self.terms)
        for x in local if isinstance(local, list) else [local]:
            if x is None:
                c = Context(self.base, self.loader)
            elif isinstance(x, str):
                if self.loader is None:
                    raise ValueError(f"no loader for the context {x}")
                c = c.extended(self.loader(x)["@context"])
            else:
                if "@base" in x:
                    c.base = urljoin(c.base, x["@base"]) if x["@base"] else ""
                if "@vocab" in x:
                    c.vocab = x["@vocab"]
                if "@language" in x:
                    c.lang = x["@language"]
                for k in x:
                    if not k.startswith("@"):
                        c.define(k, x)
        return c

    def define(self, name: str, local: dict, seen: tuple = ()) -> None:
        if name in seen:
            raise ValueError("a cyclic term definition")
        v = local[name]
        if v is None:
            self.terms[name] = None
            return
        d = {"@id": v} if isinstance(v, str) else dict(v)
        ident = d.get("@id", d.get("@reverse", name))
        prefix = ident.split(":", 1)[0]
        for other in (ident, prefix):
            if other != name and other in local:
                self.define(other, local, (*seen, name))
        d["iri"] = ident if ident.startswith("@") else self.expand(ident, True, name)
        if isinstance(d.get("@type"), str) and not d["@type"].startswith("@"):
            d["@type"] = self.expand(d["@type"], True)
        self.terms[name] = d

    def expand(self, text: str, vocab: bool, defining: str | None = None) -> str | None:
        if text.startswith("@"):
            return text
        if vocab and text != defining and text in self.terms:
            return self.terms[text] and self.terms[text]["iri"]
        if ":" in text:
            prefix, rest = text.split(":", 1)
            if prefix == "_" or rest.startswith("//"):
                return text
            if self.terms.get(prefix):
                return self.terms[prefix]["iri"] + rest
            return text
        if vocab:
            return self.vocab + text if self.vocab is not None else None
        return urljoin(self.base, text)


def jsonld_expand(doc: Any, base: str = "", loader=None) -> list:
    """The expanded form: absolute IRIs, values as objects, arrays everywhere."""

    def value(x: Any, d: dict, c: Context) -> dict:
        kind = d.get("@type")
        if kind in ("@id", "@vocab") and isinstance(x, str):
            return {"@id": c.expand(x, kind == "@vocab") if kind == "@id" or c.expand(x, True) is None else c.expand(x, True)}
        out = {"@value": x}
        if kind and kind not in ("@id", "@vocab", "@none"):
            out["@type"] = kind
        elif isinstance(x, str):
            lang = d.get("@language", c.lang)
            if lang:
                out["@language"] = lang
        return out

    def element(x: Any, d: dict, c: Context) -> list:
        if x is None:
            return []
        if isinstance(x, list):
            return [y for i in x for y in element(i, d, c)]
        if not isinstance(x, dict):
            return [value(x, d, c)]
        if "@context" in x:
            c = c.extended(x["@context"])
        keys = {k: c.expand(k, True) for k in x if k != "@context"}
        if "@value" in keys.values():
            v = {keys[k]: x[k] for k in keys}
            if "@type" in v:
                v["@type"] = c.expand(v["@type"], True)
            return [v] if v["@value"] is not None else []
        for word in ("@list", "@set"):
            if word in keys.values():
                inner = element(next(x[k] for k in keys if keys[k] == word), d, c)
                return [{"@list": inner}] if word == "@list" else inner
        out: dict = {}
        for k, full in keys.items():
            v, td = x[k], c.terms.get(k) or {}
            if full == "@id":
                out["@id"] = c.expand(v, False)
            elif full == "@type":
                out["@type"] = [c.expand(i, True) or urljoin(c.base, i) for i in (v if isinstance(v, list) else [v])]
            elif full == "@graph":
                out["@graph"] = element(v, {}, c)
            elif full == "@reverse":
                for rk, rv in v.items():
                    out.setdefault("@reverse", {}).setdefault(c.expand(rk, True), []).extend(element(rv, {}, c))
            elif full is None or full.startswith("@") or ":" not in full:
                continue
            else:
                container = td.get("@container")
                if container == "@language" and isinstance(v, dict):
                    items = [{"@value": i, "@language": lang} for lang, vs in sorted(v.items()) for i in (vs if isinstance(vs, list) else [vs])]
                elif container == "@index" and isinstance(v, dict):
                    items = [i for _, vs in sorted(v.items()) for i in element(vs, td, c)]
                elif container == "@id" and isinstance(v, dict):
                    items = [{"@id": c.expand(i, False), **y} for i, vs in sorted(v.items()) for y in element(vs, td, c)]
                elif td.get("@type") == "@json":
                    items = [{"@value": v, "@type": "@json"}]
                else:
                    items = element(v, td, c)
                    if container == "@list" and not (len(items) == 1 and "@list" in items[0]):
                        items = [{"@list": items}]
                if "@reverse" in td:
                    out.setdefault("@reverse", {}).setdefault(full, []).extend(items)
                else:
                    out.setdefault(full, []).extend(items)
        return [out] if out else []

    found = element(doc, {}, Context(base, loader))
    if len(found) == 1 and set(found[0]) == {"@graph"}:
        found = found[0]["@graph"]
    return [x for x in found if isinstance(x, dict) and "@value" not in x and (set(x) - {"@id"})]


def parse_jsonld(text: str, base: str = "", scope: str = "", loader=None) -> list[tuple]:
    """Quads of a JSON-LD document."""
    out: list[tuple] = []
    fresh = iter(range(1 << 60))

    def ident(x: dict) -> str:
        i = x.get("@id")
        return f"B{scope}g{next(fresh)}" if i is None else f"B{scope}n{i[2:]}" if i.startswith("_:") else t.iri(i)

    def literal(x: dict) -> str:
        v, dt = x["@value"], x.get("@type")
        if dt == "@json":
            return t.literal(json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False), t.RDF + "JSON")
        if isinstance(v, bool):
            return t.literal(str(v).lower(), dt or t.XSD + "boolean")
        if isinstance(v, (int, float)):
            if isinstance(v, float) and (not v.is_integer() or abs(v) >= 1e21) or dt == t.XSD + "double":
                mantissa, exponent = f"{v:.15E}".split("E")
                mantissa = mantissa.rstrip("0")
                return t.literal(f"{mantissa}{'0' if mantissa.endswith('.') else ''}E{int(exponent)}", dt or t.XSD + "double")
            return t.literal(str(int(v)), dt or t.XSD + "integer")
        return t.literal(v, dt or t.XSD + "string", x.get("@language", ""))

    def obj(x: dict, g: str | None) -> str | None:
        if "@value" in x:
            return literal(x)
        if "@list" in x:
            items = [obj(i, g) for i in x["@list"]]
            head = t.iri(t.RDF + "nil")
            for i in reversed(items):
                cell = f"B{scope}g{next(fresh)}"
                out.append((cell, t.iri(t.RDF + "first"), i, g))
                out.append((cell, t.iri(t.RDF + "rest"), head, g))
                head = cell
            return head
        return node(x, g)

    def node(x: dict, g: str | None) -> str:
        s = ident(x)
        for k, vs in x.items():
            if k == "@type":
                out.extend((s, t.iri(t.RDF + "type"), f"B{scope}n{i[2:]}" if i.startswith("_:") else t.iri(i), g) for i in vs)
            elif k == "@graph":
                for i in vs:
                    node(i, s)
            elif k == "@reverse":
                for p, items in vs.items():
                    out.extend((node(i, g), t.iri(p), s, g) for i in items)
            elif not k.startswith("@"):
                out.extend((s, t.iri(k), obj(i, g), g) for i in vs)
        return s

    for x in jsonld_expand(json.loads(text), base, loader):
        node(x, None)
    return list(dict.fromkeys(out))


def read_jsonld(spark: SparkSession, path: str) -> DataFrame:
    return _documents(spark, path, parse_jsonld)


def to_jsonld(quads: list[tuple]) -> list:
    """Expanded JSON-LD of the quads of a document."""

    def value(o: str) -> dict:
        kind, lex, dt, lang = t.parse_term(o)
        if kind != "L":
            return {"@id": lex if kind == "I" else f"_:{lex}"}
        return {"@value": lex, **({"@language": lang} if lang else {} if dt == t.XSD + "string" else {"@type": dt})}

    graphs: dict[str | None, dict[str, dict]] = {}
    for s, p, o, g in quads:
        node = graphs.setdefault(g, {}).setdefault(s, value(s))
        if p == t.iri(t.RDF + "type"):
            node.setdefault("@type", []).append(value(o)["@id"])
        else:
            node.setdefault(p[1:], []).append(value(o))
    out = dict(graphs.pop(None, {}))
    for g, nodes in graphs.items():
        out.setdefault(g, value(g))["@graph"] = [nodes[k] for k in sorted(nodes)]
    return [out[k] for k in sorted(out)]


# JSON for terms and quads
def term_to_json(term: str) -> dict:
    kind, lex, dt, lang = t.parse_term(term)
    if kind == "T":
        s, p, o = lex.split("\x02", 2)
        return {"type": "triple", "value": {"subject": term_to_json(s), "predicate": term_to_json(p), "object": term_to_json(o)}}
    out = {"type": {"I": "uri", "B": "bnode", "L": "literal"}[kind], "value": lex}
    if kind == "L":
        out |= {"xml:lang": lang} if lang else {} if dt == t.XSD + "string" else {"datatype": dt}
    return out


def term_from_json(x: dict) -> str:
    if x["type"] == "triple":
        return t.triple(*(term_from_json(x["value"][k]) for k in ("subject", "predicate", "object")))
    if x["type"] == "literal":
        return t.literal(x["value"], x.get("datatype", t.XSD + "string"), x.get("xml:lang", ""))
    return ("I" if x["type"] == "uri" else "B") + x["value"]


# CBOR, deterministic: shortest heads, map keys by length and bytes
def cbor_encode(x: Any) -> bytes:
    def head(major: int, n: int) -> bytes:
        if n < 24:
            return bytes([major << 5 | n])
        for k, size in enumerate((1, 2, 4, 8)):
            if n < 1 << 8 * size:
                return bytes([major << 5 | 24 + k]) + n.to_bytes(size, "big")
        raise ValueError("the integer is too large")

    if x is None or isinstance(x, bool):
        return {None: b"\xf6", False: b"\xf4", True: b"\xf5"}[x]
    if isinstance(x, int):
        return head(0, x) if x >= 0 else head(1, -1 - x)
    if isinstance(x, float):
        if not math.isfinite(x):
            raise ValueError("only finite numbers")
        return b"\xfb" + struct.pack(">d", x)
    if isinstance(x, bytes):
        return head(2, len(x)) + x
    if isinstance(x, str):
        raw = x.encode()
        return head(3, len(raw)) + raw
    if isinstance(x, Cid):
        return head(6, 42) + cbor_encode(b"\x00" + x.data)
    if isinstance(x, (list, tuple)):
        return head(4, len(x)) + b"".join(map(cbor_encode, x))
    items = sorted((len(k.encode()), k.encode(), v) for k, v in x.items())
    return head(5, len(items)) + b"".join(cbor_encode(k.decode()) + cbor_encode(v) for _, k, v in items)


def cbor_decode(data: bytes, strict: bool = True) -> Any:
    """The value; strict refuses what cbor_encode would not write."""

    def item(at: int, depth: int) -> tuple[Any, int]:
        if depth > 200 or at >= len(data):
            raise ValueError("truncated or too deep")
        major, low = data[at] >> 5, data[at] & 31
        at += 1
        if major == 7:
            if low in (20, 21, 22):
                return {20: False, 21: True, 22: None}[low], at
            if low == 27 and at + 8 <= len(data):
                return struct.unpack(">d", data[at : at + 8])[0], at + 8
            raise ValueError("not a value of this profile")
        n = low
        if low >= 24:
            size = {24: 1, 25: 2, 26: 4, 27: 8}.get(low)
            if size is None or at + size > len(data):
                raise ValueError("a bad head")
            n = int.from_bytes(data[at : at + size], "big")
            at += size
            if strict and n < (24 if size == 1 else 1 << 4 * size):
                raise ValueError("not the shortest head")
        if major == 0:
            return n, at
        if major == 1:
            return -1 - n, at
        if major in (2, 3):
            if at + n > len(data):
                raise ValueError("truncated")
            raw = data[at : at + n]
            return (raw if major == 2 else raw.decode()), at + n
        if major == 4:
            out = []
            for _ in range(n):
                v, at = item(at, depth + 1)
                out.append(v)
            return out, at
        if major == 5:
            out, last = {}, None
            for _ in range(n):
                k, at = item(at, depth + 1)
                key = (len(k.encode()), k.encode()) if isinstance(k, str) else None
                if key is None or strict and last is not None and key <= last:
                    raise ValueError("map keys are not strings in order")
                last = key
                out[k], at = item(at, depth + 1)
            return out, at
        v, at = item(at, depth + 1)
        if n != 42 or not isinstance(v, bytes) or v[:1] != b"\x00":
            raise ValueError("only content identifiers are tagged")
        return Cid(v[1:]), at

    value, end = item(0, 0)
    if end != len(data):
        raise ValueError("bytes are left over")
    return value


class Cid:
    """A content identifier, version 1."""

    def __init__(self, data: bytes):
        self.data = data

    @staticmethod
    def of(content: bytes, codec: int = 0x71) -> "Cid":
        return Cid(bytes([1, codec, 0x12, 0x20]) + hashlib.sha256(content).digest())

    @staticmethod
    def parse(text: str) -> "Cid":
        if not text.startswith("b"):
            raise ValueError("only base 32 is read")
        body = text[1:].upper()
        return Cid(base64.b32decode(body + "=" * (-len(body) % 8)))

    def verify(self, content: bytes) -> bool:
        return self.data[4:] == hashlib.sha256(content).digest()

    def __str__(self) -> str:
        return "b" + base64.b32encode(self.data).decode().rstrip("=").lower()

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Cid) and self.data == other.data

    def __hash__(self) -> int:
        return hash(self.data)


def read_car(data: bytes) -> tuple[list[Cid], dict[Cid, bytes]]:
    """(roots, blocks) of a content-addressed archive; every block must be what its identifier says."""

    def varint(at: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            n |= (data[at] & 127) << shift
            at += 1
            if not data[at - 1] & 128:
                return n, at
            shift += 7

    n, at = varint(0)
    header = cbor_decode(data[at : at + n])
    at += n
    blocks = {}
    while at < len(data):
        n, at = varint(at)
        cid, content = Cid(data[at : at + 36]), data[at + 36 : at + n]
        if not cid.verify(content):
            raise ValueError(f"the block {cid} is damaged")
        blocks[cid] = content
        at += n
    return header["roots"], blocks


def write_car(roots: list[Cid], blocks: dict[Cid, bytes]) -> bytes:
    def varint(n: int) -> bytes:
        out = b""
        while True:
            n, low = n >> 7, n & 127
            out += bytes([low | (128 if n else 0)])
            if not n:
                return out

    head = cbor_encode({"roots": roots, "version": 1})
    return varint(len(head)) + head + b"".join(varint(36 + len(b)) + c.data + b for c, b in blocks.items())
