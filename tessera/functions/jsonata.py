"""JSONata over JSON columns: an interpreter behind one Arrow function, and plain column expressions where a path allows it."""

from __future__ import annotations

import base64
import functools
import json
import math
import random
import re
from datetime import datetime, timezone
from typing import Any
from urllib.parse import quote, unquote

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKENS = re.compile(
    r"""(?P<ws>\s+|/\*.*?\*/)|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<quoted>`[^`]*`)
  |(?P<var>\$\$|\$[A-Za-z_]\w*|\$)|(?P<name>[A-Za-z_À-￿][\wÀ-￿]*)|(?P<op>\*\*|:=|!=|<=|>=|~>|\.\.|\?:|\?\?|[.\[\]{}(),@\#;:?+\-*/%|=<>^&!])""",
    re.VERBOSE | re.DOTALL,
)


class JsonataError(ValueError):
    """An error of the expression or of its evaluation."""


class _Nothing:
    def __bool__(self) -> bool:
        return False

    def __reduce__(self):
        return "NOTHING"  # there is one, also in the workers


NOTHING = _Nothing()


class Sequence(list):
    """A result sequence, which a single item stands for; keep holds it together as an array."""

    keep = False


class Lambda:
    def __init__(self, names, body, env, focus):
        self.names, self.body, self.env, self.focus = names, body, env, focus


_POWER = {
    ".": 75, "[": 80, "{": 70, "(": 80, "@": 80, "#": 80, "*": 60, "/": 60, "%": 60, "+": 50, "-": 50, "&": 50, "=": 40, "!=": 40, "<": 40, ">": 40, "<=": 40, ">=": 40,
    "in": 40, "^": 40, "~>": 40, "and": 30, "or": 25, "..": 20, "?": 20, "?:": 20, "??": 20, ":=": 10,
}


class Parser:
    """Top-down operator precedence. Nodes are tuples (kind, …)."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            regex = text[at] == "/" and (not self.tokens or self.tokens[-1][1] in ("(", ",", "~>", "[", "{", ":", "=", "?"))
            if regex and (m := re.compile(r"/((?:[^/\\\n]|\\.)+)/([im]*)").match(text, at)):
                self.tokens.append(("regex", (m[1], m[2])))
                at = m.end()
                continue
            m = _TOKENS.match(text, at)
            if not m:
                raise JsonataError(f"S0204: cannot read {text[at : at + 10]!r}")
            if m.lastgroup != "ws":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at = 0

    def peek(self):
        return self.tokens[self.at]

    def take(self):
        self.at += 1
        return self.tokens[self.at - 1]

    def op(self, *ops) -> bool:
        if self.peek()[0] == "op" and self.peek()[1] in ops:
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.op(text):
            raise JsonataError(f"S0202: expected {text}, found {self.peek()[1] or 'the end'}")

    def parse(self):
        tree = self.expression(0)
        if self.peek()[0] != "end":
            raise JsonataError(f"S0201: unexpected {self.peek()[1]}")
        return tree

    def power(self) -> int:
        kind, text = self.peek()
        return _POWER.get(text, 0) if kind == "op" or kind == "name" and text in ("and", "or", "in") else 0

    def expression(self, least: int):
        left = self.prefix()
        while self.power() > least:
            left = self.infix(left)
        return left

    def items(self, end: str) -> list:
        out = []
        while not self.op(end):
            out.append(("hole",) if self.peek()[1] == "?" and self.tokens[self.at + 1][1] in (",", ")") and self.take() else self.expression(0))
            if not self.op(","):
                self.need(end)
                break
        return out

    def pairs(self) -> list:
        out = []
        while not self.op("}"):
            key = self.expression(0)
            self.need(":")
            out.append((key, self.expression(0)))
            if not self.op(","):
                self.need("}")
                break
        return out

    def prefix(self):
        kind, text = self.take()
        if kind == "number":
            n = float(text)
            return ("value", int(n) if n.is_integer() and abs(n) < 2**53 else n)
        if kind == "string":
            body = text[1:-1].replace("\\'", "'") if text[0] == "'" else text[1:-1]
            return ("value", json.loads('"' + (body.replace('"', '\\"') if text[0] == "'" else body) + '"', strict=False))
        if kind == "regex":
            return ("regex", text[0], text[1])
        if kind == "quoted":
            return ("name", text[1:-1])
        if kind == "var":
            return ("var", text[1:])
        if kind == "name":
            if text in ("true", "false", "null"):
                return ("value", {"true": True, "false": False, "null": None}[text])
            if text in ("function", "λ") and self.peek()[1] == "(":
                self.take()
                names = []
                while not self.op(")"):
                    names.append(self.take()[1][1:])
                    self.op(",")
                if self.op("<"):
                    depth = 1
                    while depth:
                        t = self.take()[1]
                        depth += (t == "<") - (t == ">")
                self.need("{")
                body = self.expression(0)
                self.need("}")
                return ("lambda", names, body)
            return ("name", text)
        if text == "-":
            return ("minus", self.expression(70))
        if text == "(":
            out = []
            while not self.op(")"):
                out.append(self.expression(0))
                if not self.op(";"):
                    self.need(")")
                    break
            return ("block", out)
        if text == "[":
            return ("array", self.items("]"))
        if text == "{":
            return ("object", self.pairs())
        if text in ("*", "**", "%"):
            return ({"*": "wild", "**": "deep", "%": "parent"}[text],)
        if text == "|":
            pattern = self.expression(0)
            self.need("|")
            change, gone = self.expression(0), None
            if self.op(","):
                gone = self.expression(0)
            self.need("|")
            return ("transform", pattern, change, gone)
        raise JsonataError(f"S0211: unexpected {text or 'end'}")

    def infix(self, left):
        _, op = self.take()
        if op == ".":
            return ("path", left, self.expression(75))
        if op == "[":
            if self.op("]"):
                return ("keep", left)
            test = self.expression(0)
            self.need("]")
            return ("filter", left, test)
        if op == "{":
            return ("group", left, self.pairs())
        if op == "(":
            return ("call", left, self.items(")"))
        if op in ("@", "#"):
            return ("bind" if op == "@" else "index", left, self.take()[1][1:])
        if op == "^":
            self.need("(")
            keys = []
            while True:
                down = self.op(">")
                self.op("<")
                keys.append((self.expression(0), down))
                if not self.op(","):
                    break
            self.need(")")
            return ("sort", left, keys)
        if op == "?":
            yes = self.expression(0)
            return ("if", left, yes, self.expression(0) if self.op(":") else None)
        if op in ("?:", "??"):
            return ("elvis" if op == "?:" else "coalesce", left, self.expression(20))
        if op == ":=":
            if left[0] != "var":
                raise JsonataError("S0212: only a variable can be assigned")
            return ("assign", left[1], self.expression(9))
        return ("op", op, left, self.expression(_POWER[op]))


@functools.lru_cache(1024)
def parse(text: str):
    return Parser(text).parse()


def truthy(x) -> bool:
    if isinstance(x, list):
        return truthy(x[0]) if len(x) == 1 else any(map(truthy, x))
    if isinstance(x, (dict, str)):
        return len(x) > 0
    if isinstance(x, bool):
        return x
    return isinstance(x, (int, float)) and x != 0


def unwrap(seq):
    if isinstance(seq, Sequence) and not seq.keep:
        return NOTHING if not seq else seq[0] if len(seq) == 1 else seq
    return seq


def many(x) -> list:
    return [] if x is NOTHING else x if isinstance(x, list) else [x]


def number_text(x) -> str:
    if isinstance(x, float):
        if not math.isfinite(x):
            raise JsonataError("D3001: not a finite number")
        x = float(f"{x:.15g}")
        if x.is_integer() and abs(x) < 1e21:
            return str(int(x))
        text = repr(x)
        return re.sub(r"e([+-])0*(\d)", r"e\1\2", text)
    return str(x)


def to_json(x, pretty: bool = False) -> str:
    def plain(v):
        if isinstance(v, Lambda) or callable(v):
            return ""
        if isinstance(v, float):
            t = number_text(v)
            return int(t) if re.fullmatch(r"-?\d+", t) else float(t)
        if isinstance(v, list):
            return [plain(i) for i in v]
        return {k: plain(i) for k, i in v.items()} if isinstance(v, dict) else v

    return json.dumps(plain(x), ensure_ascii=False, indent=2 if pretty else None, separators=None if pretty else (",", ":"))


def is_number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


class Frame:
    """An item of a path with the names bound on the way to it and its ancestors."""

    __slots__ = ("item", "env", "up")

    def __init__(self, item, env, up=None):
        self.item, self.env, self.up = item, env, up


class Interpreter:
    """Evaluates a tree; steps and depth are limited, so a worker can't be held up."""

    def __init__(self, root, steps: int = 1_000_000, depth: int = 250):
        self.root, self.steps, self.depth, self.level = root, steps, depth, 0
        self.now = datetime.now(timezone.utc)

    def run(self, tree, item, env):
        return unwrap(self.eval(tree, Frame(item, env)))

    def eval(self, n, f: Frame):
        self.steps -= 1
        self.level += 1
        if self.steps < 0 or self.level > self.depth:
            raise JsonataError("U1001: the evaluation is too long or too deep")
        try:
            return getattr(self, "_" + n[0])(n, f)
        finally:
            self.level -= 1

    def value(self, n, f):
        return unwrap(self.eval(n, f))

    # leaves
    def _value(self, n, f):
        return n[1]

    def _hole(self, n, f):
        return NOTHING

    def _var(self, n, f):
        if n[1] == "":
            return f.item
        if n[1] == "$":
            return self.root
        env = f.env
        while env is not None:
            if n[1] in env[0]:
                return env[0][n[1]]
            env = env[1]
        return FUNCTIONS.get(n[1], NOTHING)

    def _regex(self, n, f):
        flags = (re.IGNORECASE if "i" in n[2] else 0) | (re.MULTILINE if "m" in n[2] else 0)
        return re.compile(n[1], flags)

    def _lambda(self, n, f):
        return Lambda(n[1], n[2], f.env, f.item)

    def _name(self, n, f):
        out = Sequence()
        stack = [f.item]
        while stack:
            x = stack.pop(0)
            if isinstance(x, list):
                stack = list(x) + stack
            elif isinstance(x, dict) and n[1] in x:
                v = x[n[1]]
                out.extend(v) if isinstance(v, list) else out.append(v)
                if isinstance(v, list) and not isinstance(f.item, list):
                    return v if not isinstance(v, Sequence) and len(v) != 1 else self._seq(v)
        return unwrap(out)

    @staticmethod
    def _seq(v):
        s = Sequence(v)
        s.keep = True
        return s

    def _wild(self, n, f):
        out = Sequence()
        for x in many(f.item):
            if isinstance(x, dict):
                for v in x.values():
                    out.extend(self._flat(v)) if isinstance(v, list) else out.append(v)
        return out

    def _flat(self, v):
        for x in v:
            if isinstance(x, list):
                yield from self._flat(x)
            else:
                yield x

    def _deep(self, n, f):
        out, stack = Sequence(), [f.item]
        while stack:
            x = stack.pop()
            if isinstance(x, list):
                stack.extend(reversed(x))
            elif x is not NOTHING:
                out.append(x)
                if isinstance(x, dict):
                    stack.extend(reversed(list(x.values())))
        return out

    def _parent(self, n, f):
        return f.up.item if f.up is not None else NOTHING

    # paths: every step maps frames to frames
    def frames(self, n, f) -> tuple[list[Frame], bool]:
        """The frames that a step leads to from f, and whether an array is to be kept."""
        kind = n[0]
        if kind == "path":
            before, keep = self.frames(n[1], f)
            out = []
            for b in before:
                more, k = self.frames(n[2], b)
                out.extend(more)
                keep = keep or k
            return out, keep
        if kind == "filter":
            inner, keep = self.frames(n[1], f)
            return self.filtered(inner, n[2]), keep
        if kind == "keep":
            return self.frames(n[1], f)[0], True
        if kind in ("bind", "index"):
            inner, keep = self.frames(n[1], f)
            if kind == "bind":
                return [Frame(x.up.item if x.up else x.item, ({n[2]: x.item}, x.env), x.up.up if x.up else None) for x in inner], keep
            return [Frame(x.item, ({n[2]: k}, x.env), x.up) for k, x in enumerate(inner)], keep
        if kind == "sort":
            inner, keep = self.frames(n[1], f)
            return self.sorted(inner, n[2]), keep
        if kind == "parent":
            up = f.up
            return ([Frame(up.item, f.env, up.up)] if up is not None else []), False
        v = self.eval(n, f)
        if v is NOTHING:
            return [], False
        if isinstance(v, list) and kind != "array":
            return [Frame(x, f.env, f) for x in v], isinstance(v, Sequence) and v.keep and kind != "name"
        return [Frame(v, f.env, f)], False

    def filtered(self, inner: list[Frame], test) -> list[Frame]:
        if test[0] == "value" and is_number(test[1]) or test[0] == "minus" and test[1][0] == "value":
            k = math.floor(self.value(test, Frame(NOTHING, None)))
            k = k + len(inner) if k < 0 else k
            return [inner[k]] if 0 <= k < len(inner) else []
        out = []
        for k, x in enumerate(inner):
            r = self.value(test, x)
            if is_number(r) or isinstance(r, list) and r and all(map(is_number, r)):
                places = [math.floor(i) + (len(inner) if i < 0 else 0) for i in many(r)]
                if k in places:
                    out.append(x)
            elif r is not NOTHING and truthy(r):
                out.append(x)
        return out

    def sorted(self, inner: list[Frame], keys) -> list[Frame]:
        def compare(a: Frame, b: Frame) -> int:
            for k, down in keys:
                x, y = self.value(k, a), self.value(k, b)
                if x is NOTHING or y is NOTHING:
                    c = (x is NOTHING) - (y is NOTHING)
                    if c:
                        return c
                    continue
                if not (is_number(x) and is_number(y) or isinstance(x, str) and isinstance(y, str)):
                    raise JsonataError("T2008: sort keys must be numbers or strings of one kind")
                if x != y:
                    return (1 if x > y else -1) * (-1 if down else 1)
            return 0

        return sorted(inner, key=functools.cmp_to_key(compare))

    def gathered(self, n, f):
        found, keep = self.frames(n, f)
        out = Sequence()
        for x in found:
            v = x.item
            out.extend(v) if isinstance(v, list) and n[0] == "path" and n[2][0] != "array" else out.append(v)
        out.keep = keep
        return NOTHING if not out and not keep else out

    _path = _filter = _keep = _bind = _index = _sort = gathered

    # constructors
    def _array(self, n, f):
        out = []
        for x in n[1]:
            v = self.value(x, f)
            if v is not NOTHING:
                out.extend(v) if isinstance(v, list) and x[0] != "array" else out.append(v)
        return out

    def _object(self, n, f):
        return self.grouped([Frame(x, f.env, f.up) for x in f.item] if isinstance(f.item, list) else [f], n[1])

    def _group(self, n, f):
        return self.grouped(self.frames(n[1], f)[0], n[2])

    def grouped(self, frames, pairs):
        buckets: dict[str, tuple[Any, list[Frame]]] = {}
        for x in frames:
            for k, (key, value) in enumerate(pairs):
                name = self.value(key, x)
                if name is NOTHING:
                    continue
                if not isinstance(name, str):
                    raise JsonataError("T1003: a key must be a string")
                if name in buckets and buckets[name][0] is not value:
                    raise JsonataError(f"D1009: two values for the key {name}")
                buckets.setdefault(name, (value, []))[1].append(x)
        out = {}
        for name, (value, xs) in buckets.items():
            item = xs[0].item if len(xs) == 1 else Sequence(x.item for x in xs)
            v = self.value(value, Frame(item, xs[0].env, xs[0].up))
            if v is not NOTHING:
                out[name] = v
        return out

    def _transform(self, n, f):
        def change(x):
            copy = json.loads(json.dumps(x))
            hits = self.value(n[1], Frame(copy, f.env))
            for h in many(hits):
                if isinstance(h, dict):
                    new = self.value(n[2], Frame(h, f.env))
                    if isinstance(new, dict):
                        h.update(new)
                    for k in many(self.value(n[3], Frame(h, f.env))) if n[3] else ():
                        h.pop(k, None)
            return copy

        return change

    # control
    def _block(self, n, f):
        out, inner = NOTHING, Frame(f.item, ({}, f.env), f.up)
        for x in n[1]:
            out = self.eval(x, inner)
        return out

    def _assign(self, n, f):
        v = self.value(n[2], f)
        if f.env is None:
            f.env = ({}, None)
        f.env[0][n[1]] = v
        return v

    def _if(self, n, f):
        c = self.value(n[1], f)
        return self.eval(n[2], f) if c is not NOTHING and truthy(c) else self.eval(n[3], f) if n[3] else NOTHING

    def _elvis(self, n, f):
        v = self.value(n[1], f)
        return v if v is not NOTHING and truthy(v) else self.eval(n[2], f)

    def _coalesce(self, n, f):
        v = self.value(n[1], f)
        return v if v is not NOTHING else self.eval(n[2], f)

    def _minus(self, n, f):
        v = self.value(n[1], f)
        if v is NOTHING:
            return v
        if not is_number(v):
            raise JsonataError("D1002: only a number can be negated")
        return -v

    def _op(self, n, f):
        op = n[1]
        if op in ("and", "or"):
            a = self.value(n[2], f)
            a = a is not NOTHING and truthy(a)
            if a == (op == "or"):
                return a
            b = self.value(n[3], f)
            return b is not NOTHING and truthy(b)
        a = self.value(n[2], f)
        if op == "~>":
            return self.chain(a, n[3], f)
        b = self.value(n[3], f)
        if op == "&":
            return text_of(a) + text_of(b)
        if op == "..":
            if a is NOTHING or b is NOTHING:
                return NOTHING
            if not all(is_number(x) and float(x).is_integer() for x in (a, b)):
                raise JsonataError("T2003: a range needs integers")
            if b - a > 10_000_000:
                raise JsonataError("D2014: the range is too large")
            return Sequence(range(int(a), int(b) + 1))
        if op == "in":
            return False if a is NOTHING or b is NOTHING else a in many(b)
        if op in ("=", "!="):
            if a is NOTHING or b is NOTHING:
                return False if op == "=" else a is not b
            same = a == b and isinstance(a, bool) == isinstance(b, bool)
            return same == (op == "=")
        if op in ("<", ">", "<=", ">="):
            for x in (a, b):
                if x is not NOTHING and not (is_number(x) or isinstance(x, str)):
                    raise JsonataError("T2010: only numbers and strings are ordered")
            if a is NOTHING or b is NOTHING:
                return NOTHING
            if is_number(a) != is_number(b):
                raise JsonataError("T2009: both sides must be of one kind")
            return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
        for x, code in ((a, "T2001"), (b, "T2002")):
            if x is not NOTHING and not is_number(x):
                raise JsonataError(f"{code}: {op} needs numbers")
        if a is NOTHING or b is NOTHING:
            return NOTHING
        if op in ("/", "%") and b == 0:
            raise JsonataError("D1001: not a finite number")
        out = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: math.fmod(a, b)}[op]()
        return int(out) if isinstance(out, float) and out.is_integer() and abs(out) < 2**53 else out

    def chain(self, a, n, f):
        if n[0] == "call":
            return self.call(self.value(n[1], f), [a, *[self.value(x, f) for x in n[2]]], f)
        g = self.value(n, f)
        if callable(a) or isinstance(a, Lambda):
            return lambda *args: self.call(g, [self.call(a, list(args), f)], f)
        return self.call(g, [a], f)

    def _call(self, n, f):
        g = self.value(n[1], f) if n[1][0] != "name" else NOTHING
        if g is NOTHING:
            raise JsonataError("T1006: not a function")
        if any(x == ("hole",) for x in n[2]):
            given = [x if x == ("hole",) else self.value(x, f) for x in n[2]]
            return lambda *args: self.call(g, [next(it) if x == ("hole",) else x for it in [iter(args)] for x in given], f)
        return self.call(g, [self.value(x, f) for x in n[2]], f)

    def call(self, g, args, f):
        if isinstance(g, Lambda):
            return unwrap(self.eval(g.body, Frame(g.focus, (dict(zip(g.names, [*args, *[NOTHING] * len(g.names)])), g.env))))
        if isinstance(g, Builtin):
            return g.run(self, args, f)
        if isinstance(g, re.Pattern):
            return match_of(g, args[0])
        if callable(g):
            return g(*args)
        raise JsonataError("T1006: not a function")


def text_of(x) -> str:
    if x is NOTHING:
        return ""
    if isinstance(x, str):
        return x
    if isinstance(x, (Lambda, Builtin)) or callable(x) and not isinstance(x, (dict, list)):
        return ""
    return number_text(x) if is_number(x) else to_json(x)


def match_of(pattern, text):
    m = pattern.search(text)
    return NOTHING if not m else {"match": m[0], "start": m.start(), "end": m.end(), "groups": [g or "" for g in m.groups()]}


class Builtin:
    """A library function; with focus the context stands for a missing first argument. Undefined in, undefined out."""

    def __init__(self, name, function, arity, focus=False, raw=False):
        self.name, self.function, self.arity, self.focus, self.raw = name, function, arity, focus, raw

    def run(self, it, args, f):
        if self.focus and len(args) < self.arity:
            args = [f.item, *args]
        if self.raw:
            return self.function(it, f, *args)
        if args and args[0] is NOTHING:
            return NOTHING
        return self.function(*[None if a is NOTHING else a for a in args])


FUNCTIONS: dict[str, Builtin] = {}


def register(name: str, arity: int = 1, focus: bool = False, raw: bool = False):
    def add(function):
        FUNCTIONS[name] = Builtin(name, function, arity, focus, raw)
        return function

    return add


def _numbers(name):
    def check(x):
        x = many(x)
        if not all(map(is_number, x)):
            raise JsonataError(f"T0412: ${name} needs numbers")
        return x

    return check


def _short(x):
    return int(x) if isinstance(x, float) and x.is_integer() and abs(x) < 2**53 else x


register("sum")(lambda x: _short(sum(_numbers("sum")(x))))
register("max")(lambda x: max(_numbers("max")(x), default=NOTHING))
register("min")(lambda x: min(_numbers("min")(x), default=NOTHING))
register("average")(lambda x: _short(sum(_numbers("average")(x)) / len(many(x))) if many(x) else NOTHING)
register("count", raw=True)(lambda it, f, x=NOTHING: len(many(x)))
register("reverse")(lambda x: many(x)[::-1])
register("append", raw=True)(lambda it, f, a, b: a if b is NOTHING else b if a is NOTHING else Sequence([*many(a), *many(b)]))
register("zip", raw=True)(lambda it, f, *xs: [list(t) for t in zip(*map(many, xs))])
register("shuffle")(lambda x: random.sample(many(x), len(many(x))))
register("boolean", focus=True)(lambda x: truthy(x))
register("not", focus=True)(lambda x: not truthy(x))
register("exists", raw=True)(lambda it, f, x=NOTHING: x is not NOTHING)
register("now", raw=True)(lambda it, f, *a: it.now.strftime("%Y-%m-%dT%H:%M:%S.") + f"{it.now.microsecond // 1000:03d}Z")
register("millis", raw=True)(lambda it, f: int(it.now.timestamp() * 1000))
register("base64encode", focus=True)(lambda s: base64.b64encode(s.encode("latin-1", "replace") if all(ord(c) < 256 for c in s) else s.encode()).decode())
register("base64decode", focus=True)(lambda s: base64.b64decode(s).decode("latin-1"))
register("encodeUrlComponent", focus=True)(lambda s: quote(s, safe="!'()*-._~"))
register("encodeUrl", focus=True)(lambda s: quote(s, safe="!#$&'()*+,-./:;=?@_~"))
register("decodeUrlComponent", focus=True)(unquote)
register("decodeUrl", focus=True)(unquote)
register("abs", focus=True)(lambda x: abs(x))
register("floor", focus=True)(lambda x: math.floor(x))
register("ceil", focus=True)(lambda x: math.ceil(x))
register("sqrt", focus=True)(lambda x: _short(math.sqrt(x)))
register("keys", focus=True)(lambda x: unwrap(Sequence(dict.fromkeys(k for o in many(x) if isinstance(o, dict) for k in o))))
register("type", raw=True)(
    lambda it, f, x=NOTHING: NOTHING if x is NOTHING else "null" if x is None else "boolean" if isinstance(x, bool) else "number" if is_number(x) else "string" if isinstance(x, str) else "array" if isinstance(x, list) else "object" if isinstance(x, dict) else "function"
)
register("uppercase", focus=True)(lambda s: s.upper())
register("lowercase", focus=True)(lambda s: s.lower())
register("length", focus=True)(lambda s: len(s))
register("trim", focus=True)(lambda s: re.sub(r"[ \t\n\r]+", " ", s).strip(" "))
register("substringBefore", 2, True)(lambda s, c: s.split(c, 1)[0] if c in s else s)
register("substringAfter", 2, True)(lambda s, c: s.split(c, 1)[1] if c in s else s)
register("join", 2)(lambda xs, sep="": (sep or "").join(_strings(xs)))
register("random", raw=True)(lambda it, f: random.random())
register("clone", focus=True)(lambda x: json.loads(json.dumps(x)))


def _strings(xs):
    if not all(isinstance(x, str) for x in many(xs)):
        raise JsonataError("T0412: $join needs strings")
    return many(xs)


@register("distinct")
def _distinct(x):
    if not isinstance(x, list):
        return x
    out = Sequence() if isinstance(x, Sequence) else []
    for v in x:
        if not any(v == o and type(v) is type(o) for o in out):
            out.append(v)
    return out


@register("string", focus=True, raw=True)
def _string(it, f, x=NOTHING, pretty=False):
    if x is NOTHING:
        return NOTHING
    return x if isinstance(x, str) else text_of(x) if is_number(x) or callable(x) or isinstance(x, (Lambda, Builtin)) else to_json(x, truthy(pretty))


@register("substring", 2, True)
def _substring(s, start, n=None):
    start = max(len(s) + start, 0) if start < 0 else start
    return s[int(start) :] if n is None else s[int(start) : int(start) + int(n)] if n > 0 else ""


@register("pad", 2, True)
def _pad(s, width, fill=" "):
    fill, n = fill or " ", abs(int(width)) - len(s)
    more = (fill * (n // len(fill) + 1))[: max(n, 0)]
    return s + more if width > 0 else more + s


@register("contains", 2, True)
def _contains(s, p):
    return p.search(s) is not None if isinstance(p, re.Pattern) else p in s


@register("split", 2, True)
def _split(s, p, limit=None):
    if limit is not None and limit < 0:
        raise JsonataError("D3020: the limit of $split is negative")
    parts = p.split(s) if isinstance(p, re.Pattern) else list(s) if p == "" else s.split(p)
    return parts if limit is None else parts[: int(limit)]


@register("match", 2, True)
def _match(s, p, limit=None):
    out = Sequence({"match": m[0], "index": m.start(), "groups": [g or "" for g in m.groups()]} for m in p.finditer(s))
    return unwrap(Sequence(out if limit is None else out[: int(limit)]))


@register("replace", 3, True, raw=True)
def _replace(it, f, s, pattern, with_, limit=NOTHING):
    if s is NOTHING:
        return NOTHING
    if pattern == "":
        raise JsonataError("D3010: the pattern of $replace is empty")
    n = 0 if limit is NOTHING else int(limit)
    if limit is not NOTHING and n == 0:
        return s
    if not isinstance(pattern, re.Pattern):
        return s.replace(pattern, with_, n or -1)

    def one(m):
        if not isinstance(with_, str):
            return it.call(with_, [{"match": m[0], "start": m.start(), "end": m.end(), "groups": [g or "" for g in m.groups()]}], f)

        def group(x):
            digits = x[1]
            if digits == "$":
                return "$"
            while digits and int(digits) > len(m.groups()) and len(digits) > 1:
                digits = digits[:-1]
            k = int(digits)
            return (m[k] or "" if k <= len(m.groups()) else "") + x[1][len(digits) :]

        return re.sub(r"\$(\$|\d+)", group, with_)

    return pattern.sub(one, s, count=n)


@register("number", focus=True)
def _number(x):
    if isinstance(x, bool):
        return int(x)
    if is_number(x):
        return x
    if isinstance(x, str):
        if re.fullmatch(r"-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?", x):
            return _short(float(x))
        if re.fullmatch(r"0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+", x):
            return int(x, 0)
    raise JsonataError("D3030: not a number")


@register("round", focus=True)
def _round(x, digits=0):
    from decimal import ROUND_HALF_EVEN, Decimal

    return _short(float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-int(digits or 0)), ROUND_HALF_EVEN)))


@register("power", 2, True)
def _power(x, n):
    try:
        out = x**n
    except (OverflowError, ZeroDivisionError):
        out = None
    if out is None or isinstance(out, complex) or math.isinf(out):
        raise JsonataError("D3061: the power is not a finite number")
    return _short(out)


@register("formatBase", focus=True)
def _format_base(x, base=10):
    base, n = int(base or 10), round(x)
    if not 2 <= base <= 36:
        raise JsonataError("D3100: the base lies between 2 and 36")
    digits, m = "", abs(n)
    while m or not digits:
        m, d = divmod(m, base)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
    return "-" * (n < 0) + digits


@register("formatNumber", 2, True)
def _format_number(x, picture, options=None):
    parts = picture.split(";")
    negative = x < 0
    p = parts[1] if negative and len(parts) > 1 else parts[0]
    m = re.search(r"[#0,.]+", p)
    if not m:
        raise JsonataError("D3085: the picture has no digits")
    body, prefix, suffix = m[0], p[: m.start()], p[m.end() :]
    v = abs(x) * (100 if "%" in suffix + prefix else 1000 if "‰" in suffix + prefix else 1)
    whole, _, frac = body.partition(".")
    least, most = frac.count("0"), len(frac.replace(",", ""))
    from decimal import ROUND_HALF_EVEN, Decimal

    text = format(Decimal(repr(v)).quantize(Decimal(1).scaleb(-most), ROUND_HALF_EVEN), "f")
    i, _, d = text.partition(".")
    d = d.rstrip("0").ljust(least, "0")
    i = i.lstrip("0").rjust(whole.count("0"), "0")
    if "," in whole:
        size = len(whole) - whole.rindex(",") - 1
        i = re.sub(rf"(?<=\d)(?=(\d{{{size}}})+$)", ",", i)
    return ("-" if negative and len(parts) == 1 else "") + prefix + i + ("." + d if d else "") + suffix


_ROMAN = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]


@register("formatInteger", 2, True)
def _format_integer(x, picture):
    n = math.floor(x)
    if picture in ("i", "I"):
        out = ""
        for v, s in _ROMAN:
            out, n = out + s * (n // v), n % v
        return out if picture == "i" else out.upper()
    if picture in ("a", "A"):
        out = ""
        while n > 0:
            n, d = divmod(n - 1, 26)
            out = chr(97 + d) + out
        return out if picture == "a" else out.upper()
    width = len(re.sub(r"[^0]", "", picture.split(";")[0]))
    text = str(abs(n)).rjust(width, "0")
    if "," in picture:
        text = re.sub(r"(?<=\d)(?=(\d{3})+$)", ",", text)
    if picture.endswith(";o"):
        text += "th" if n % 100 in (11, 12, 13) else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")
    return "-" * (n < 0) + text


@register("parseInteger", 2, True)
def _parse_integer(s, picture):
    if picture in ("i", "I"):
        out, rest = 0, s.lower()
        for v, r in _ROMAN:
            while rest.startswith(r):
                out, rest = out + v, rest[len(r) :]
        return out
    if picture in ("a", "A"):
        return functools.reduce(lambda n, c: n * 26 + ord(c.lower()) - 96, s, 0)
    return int(re.sub(r"[^\d-]", "", s))


@register("toMillis")
def _to_millis(s, picture=None):
    return int(datetime.fromisoformat(s.replace("Z", "+00:00")).replace(tzinfo=None if "T" in s and re.search(r"[+-]\d\d:?\d\d$|Z$", s) else timezone.utc).timestamp() * 1000) if not re.search(r"Z$|[+-]\d\d:?\d\d$", s) else int(datetime.fromisoformat(s.replace("Z", "+00:00")).timestamp() * 1000)


_FIELDS = {"Y": "%Y", "M": "%m", "D": "%d", "H": "%H", "m": "%M", "s": "%S", "d": "%j"}


@register("fromMillis", focus=True)
def _from_millis(n, picture=None, zone=None):
    at = datetime.fromtimestamp(n / 1000, timezone.utc)
    if picture is None:
        return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{int(n) % 1000:03d}Z"

    def one(m):
        mark = m[1].strip()
        if mark[0] == "f":
            return f"{int(n) % 1000:03d}"
        if mark[0] == "Z":
            return "Z" if "Z" in mark else "+00:00"
        if mark.startswith("MN"):
            return at.strftime("%B").upper() if mark.startswith("MN") and not mark.startswith("MNn") else at.strftime("%B")
        if mark[0] == "F":
            return at.strftime("%A") if "n" in mark or len(mark) == 1 else at.strftime("%A").upper()
        if mark[0] == "h":
            return str(int(at.strftime("%I")))
        if mark[0] == "P":
            return at.strftime("%p").lower()
        out = at.strftime(_FIELDS[mark[0]])
        return out if re.search(r"0\d|[YHms]\d?$|\d\d", mark) and mark[0] != "Y" and "1" != mark[1:] or mark[0] in "Ym s" else str(int(out))

    return re.sub(r"\[([^\]]+)\]", one, picture)


@register("lookup", 2, True)
def _lookup(x, key):
    out = Sequence(o[key] for o in many(x) if isinstance(o, dict) and key in o)
    return unwrap(out)


@register("merge")
def _merge(xs):
    out: dict = {}
    for x in many(xs):
        out.update(x)
    return out


@register("spread", focus=True)
def _spread(x):
    return unwrap(Sequence({k: v} for o in many(x) for k, v in o.items())) if isinstance(x, (dict, list)) else x


@register("error", raw=True)
def _error(it, f, message=NOTHING):
    raise JsonataError(f"D3137: {text_of(message) or '$error() function evaluated'}")


@register("assert", raw=True)
def _assert(it, f, condition, message=NOTHING):
    if not truthy(condition):
        raise JsonataError(f"D3141: {text_of(message) or '$assert() statement failed'}")
    return NOTHING


@register("eval", 2, raw=True)
def _eval(it, f, text=NOTHING, focus=NOTHING):
    return NOTHING if text is NOTHING else it.value(parse(text), Frame(f.item if focus is NOTHING else focus, f.env))


def _arity(g, most: int) -> int:
    return min(most, len(g.names)) if isinstance(g, Lambda) else min(most, g.arity) if isinstance(g, Builtin) else 1


@register("map", raw=True)
def _map(it, f, xs, g):
    out = Sequence(it.call(g, [x, k, many(xs)][: _arity(g, 3)], f) for k, x in enumerate(many(xs)))
    return unwrap(Sequence(x for x in out if x is not NOTHING))


@register("filter", raw=True)
def _filter(it, f, xs, g):
    return unwrap(Sequence(x for k, x in enumerate(many(xs)) if truthy(it.call(g, [x, k, many(xs)][: _arity(g, 3)], f))))


@register("single", raw=True)
def _single(it, f, xs, g=None):
    hits = [x for k, x in enumerate(many(xs)) if g is None or truthy(it.call(g, [x, k, many(xs)][: _arity(g, 3)], f))]
    if len(hits) != 1:
        raise JsonataError("D3138: more than one match" if hits else "D3139: no match")
    return hits[0]


@register("reduce", raw=True)
def _reduce(it, f, xs, g, init=NOTHING):
    if isinstance(g, Lambda) and len(g.names) < 2:
        raise JsonataError("D3050: the function of $reduce takes two arguments at least")
    rest = list(many(xs))
    if init is NOTHING:
        if not rest:
            return NOTHING
        init = rest.pop(0)
    for k, x in enumerate(rest):
        init = it.call(g, [init, x, k, many(xs)][: _arity(g, 4)], f)
    return init


@register("sort", raw=True)
def _sort(it, f, xs, g=None):
    if xs is NOTHING:
        return NOTHING
    if g is None:
        if not (all(map(is_number, many(xs))) or all(isinstance(x, str) for x in many(xs))):
            raise JsonataError("D3070: $sort without a function takes numbers or strings")
        return sorted(many(xs))
    return sorted(many(xs), key=functools.cmp_to_key(lambda a, b: 1 if truthy(it.call(g, [a, b], f)) else -1 if truthy(it.call(g, [b, a], f)) else 0))


@register("sift", 2, True, raw=True)
def _sift(it, f, x, g=None):
    x, g = (f.item, x) if g is None else (x, g)
    out = {k: v for k, v in x.items() if truthy(it.call(g, [v, k, x][: _arity(g, 3)], f))}
    return out or NOTHING


@register("each", 2, True, raw=True)
def _each(it, f, x, g=None):
    x, g = (f.item, x) if g is None else (x, g)
    return unwrap(Sequence(v for v in (it.call(g, [v, k, x][: _arity(g, 3)], f) for k, v in x.items()) if v is not NOTHING))


def evaluate(text: Any, data: Any, bindings: dict | None = None, steps: int = 1_000_000, depth: int = 250) -> Any:
    """The result of an expression (its text, or what parse gives of it) over a JSON value; NOTHING if it has none."""
    root = Interpreter._seq(data) if isinstance(data, list) else data
    it = Interpreter(data, steps, depth)
    return it.run(parse(text) if isinstance(text, str) else text, root, (dict(bindings or {}), None))


_SIMPLE = re.compile(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*|\[\d+\])*")


def column(text: str, json_column: Column | str) -> Column:
    """The result as JSON text, null where there is none or the row's JSON is null.

    A path of plain names stays in the JVM while each step is an object (arrays on the way go to the interpreter, by
    get_json_object's own rules they would not be mapped over); anything else runs in an Arrow function.
    """
    source = F.col(json_column) if isinstance(json_column, str) else json_column
    tree = parse(text)

    @F.udf("string", useArrow=True)
    def run(row: str | None) -> str | None:
        if row is None:
            return None
        out = evaluate(tree, json.loads(row))
        return None if out is NOTHING else to_json(out)

    return run(source)


def path_column(text: str, json_column: Column | str, kind: str = "string") -> Column:
    """A path of plain names and indices over objects as a typed column, without leaving the JVM."""
    if not _SIMPLE.fullmatch(text):
        raise JsonataError("not a plain path")
    source = F.col(json_column) if isinstance(json_column, str) else json_column
    return F.try_variant_get(F.try_parse_json(source), "$." + text, kind)
