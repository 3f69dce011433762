"""SQL/JSON path over parsed documents: lax and strict mode, filters, methods, arithmetic.

``query(document, path)`` returns the list of items.  The path is parsed once
by a small precedence parser into closures of (item, root) -> items.
"""

from __future__ import annotations

import decimal
import json
import re

_TOKEN = re.compile(
    r"""\s*(?:(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<str>"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<op>\*\*|==|!=|<>|<=|>=|&&|\|\||[$@.\[\]()?*,<>!+\-/%{}]))"""
)


class PathError(ValueError):
    pass


def _tokens(path: str) -> list[tuple[str, str]]:
    out, at = [], 0
    path = path.strip()
    while at < len(path):
        m = _TOKEN.match(path, at)
        if not m:
            raise PathError(f"syntax error in path at {path[at:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def _kind(x) -> str:
    return "null" if x is None else "boolean" if isinstance(x, bool) else "number" if isinstance(x, (int, float, decimal.Decimal)) else "string" if isinstance(x, str) else "array" if isinstance(x, list) else "object"


def _compare(op: str, a, b):
    """True, False, or None where the kinds cannot be compared."""
    if op in ("!=", "<>"):
        same = _compare("==", a, b)
        return None if same is None else not same
    if a is None or b is None:
        return (a is None and b is None) if op == "==" else None
    if _kind(a) != _kind(b) or _kind(a) in ("array", "object"):
        return None
    return {"==": a == b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


class _Parser:
    def __init__(self, path: str):
        self.tokens, self.at = _tokens(path), 0
        self.strict = self._word("strict")
        if not self.strict:
            self._word("lax")

    def _peek(self, n=0):
        return self.tokens[self.at + n][1] if self.at + n < len(self.tokens) else None

    def _take(self):
        self.at += 1
        return self.tokens[self.at - 1]

    def _word(self, w):
        if self._peek() == w:
            self.at += 1
            return True
        return False

    def _need(self, w):
        if not self._word(w):
            raise PathError(f"expected {w!r}, found {self._peek()!r}")

    # predicates: functions of (item, root) to True, False or None
    def predicate(self):
        left = self._and()
        while self._word("||"):
            right, old = self._and(), left
            left = lambda i, r, a=old, b=right: (lambda x, y: True if x or y else None if x is None or y is None else False)(a(i, r), b(i, r))
        return left

    def _and(self):
        left = self._not()
        while self._word("&&"):
            right, old = self._not(), left
            left = lambda i, r, a=old, b=right: (lambda x, y: False if x is False or y is False else None if x is None or y is None else True)(a(i, r), b(i, r))
        return left

    def _not(self):
        if self._word("!"):
            self._need("(")
            inner = self.predicate()
            self._need(")")
            return lambda i, r: (lambda x: None if x is None else not x)(inner(i, r))
        if self._peek() == "exists" and self._peek(1) == "(":
            self.at += 2
            inner = self.sum()
            self._need(")")
            return lambda i, r: bool(inner(i, r))
        if self._peek() == "(":  # a predicate, or the start of an expression
            mark = self.at
            self.at += 1
            try:
                inner = self.predicate()
                self._need(")")
                if self._peek() not in ("==", "!=", "<>", "<", "<=", ">", ">=", "+", "-", "*", "/", "%", "."):
                    if self._peek() == "is":
                        self.at += 1
                        self._need("unknown")
                        return lambda i, r: inner(i, r) is None
                    return inner
            except PathError:
                pass
            self.at = mark
        return self._comparison()

    def _comparison(self):
        left = self.sum()
        op = self._peek()
        if op in ("==", "!=", "<>", "<", "<=", ">", ">="):
            self.at += 1
            right = self.sum()

            def test(i, r):
                found = [_compare(op, a, b) for a in self._flat(left(i, r)) for b in self._flat(right(i, r))]
                return True if True in found else None if None in found else False

            return test
        if op == "starts":
            self.at += 1
            self._need("with")
            right = self.sum()
            return lambda i, r: any(isinstance(a, str) and a.startswith(b) for a in self._flat(left(i, r)) for b in right(i, r))
        if op == "like_regex":
            self.at += 1
            pattern, flags = json.loads(self._take()[1]), ""
            if self._word("flag"):
                flags = json.loads(self._take()[1])
            rx = re.compile(re.escape(pattern) if "q" in flags else pattern, sum({"i": re.I, "s": re.S, "m": re.M, "x": re.X}.get(f, 0) for f in flags))
            return lambda i, r: any(isinstance(a, str) and bool(rx.search(a)) for a in self._flat(left(i, r)))
        raise PathError(f"expected a comparison, found {op!r}")

    def _flat(self, items):
        if self.strict:
            return items
        return [y for x in items for y in (x if isinstance(x, list) else [x])]

    # expressions: functions of (item, root) to a list of items
    def sum(self):
        left = self._product()
        while self._peek() in ("+", "-"):
            left = self._arithmetic(self._take()[1], left, self._product())
        return left

    def _product(self):
        left = self._unary()
        while self._peek() in ("*", "/", "%"):
            left = self._arithmetic(self._take()[1], left, self._unary())
        return left

    def _arithmetic(self, op, left, right):
        def number(items):
            items = self._flat(items)
            if len(items) != 1 or _kind(items[0]) != "number":
                raise PathError("operand of arithmetic is not one number")
            return decimal.Decimal(str(items[0]))

        def value(i, r):
            a, b = number(left(i, r)), number(right(i, r))
            if op in "/%" and b == 0:
                raise PathError("division by zero")
            out = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b}[op]()
            return [int(out) if out == out.to_integral() else out]

        return value

    def _unary(self):
        if self._peek() in ("-", "+"):
            sign = -1 if self._take()[1] == "-" else 1
            inner = self._unary()
            return lambda i, r: [x * sign for x in inner(i, r)]
        return self._path()

    def _path(self):
        kind, text = self._take() if self.at < len(self.tokens) else (None, None)
        if text == "$":
            now = lambda i, r: [r]
        elif text == "@":
            now = lambda i, r: [i]
        elif kind == "num":
            value = int(text) if re.fullmatch(r"\d+", text) else decimal.Decimal(text)
            now = lambda i, r: [value]
        elif kind == "str":
            value = json.loads(text)
            now = lambda i, r: [value]
        elif text in ("true", "false", "null"):
            value = {"true": True, "false": False, "null": None}[text]
            now = lambda i, r: [value]
        elif text == "(":
            now = self.sum()
            self._need(")")
        else:
            raise PathError(f"unexpected {text!r}")
        while True:
            if self._peek() == ".":
                self.at += 1
                now = self._step(now)
            elif self._peek() == "[":
                self.at += 1
                now = self._subscripts(now)
            elif self._peek() == "?":
                self.at += 1
                self._need("(")
                test = self.predicate()
                self._need(")")
                now = lambda i, r, a=now, t=test: [x for x in self._flat(a(i, r)) if t(x, r) is True]
            else:
                return now

    def _step(self, before):
        kind, text = self._take()
        if text == "**":
            low, high = 0, None
            if self._word("{"):
                low = high = None if self._peek() == "last" else int(self._peek())
                self.at += 1
                if self._word("to"):
                    high = None if self._peek() == "last" else int(self._peek())
                    self.at += 1
                self._need("}")

            def deep(x, level=0):
                if level >= (low or 0) and (high is None or level <= high):
                    yield x
                for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
                    yield from deep(y, level + 1)

            return lambda i, r: [y for x in before(i, r) for y in deep(x)]
        if text == "*":
            return lambda i, r: [y for x in self._flat(before(i, r)) if isinstance(x, dict) for y in x.values()]
        if kind == "name" and self._peek() == "(":
            self.at += 1
            self._need(")")
            return self._method(text, before)
        name = json.loads(text) if kind == "str" else text

        def member(i, r):
            out = []
            for x in self._flat(before(i, r)):
                if isinstance(x, dict) and name in x:
                    out.append(x[name])
                elif self.strict:
                    raise PathError(f"no member {name!r}")
            return out

        return member

    def _subscripts(self, before):
        if self._word("*"):
            self._need("]")
            return lambda i, r: [y for x in before(i, r) for y in (x if isinstance(x, list) else self._bare(x))]
        spans = []
        while True:
            low = high = self._bound()
            if self._word("to"):
                high = self._bound()
            spans.append((low, high))
            if not self._word(","):
                break
        self._need("]")

        def pick(i, r):
            out = []
            for x in before(i, r):
                x = x if isinstance(x, list) else self._bare(x)
                for low, high in spans:
                    a, b = low(i, r, len(x)), high(i, r, len(x))
                    if self.strict and not (0 <= a <= b < len(x)):
                        raise PathError("subscript out of bounds")
                    out += x[max(a, 0) : b + 1] if b >= 0 else []
            return out

        return pick

    def _bare(self, x):
        if self.strict:
            raise PathError("not an array")
        return [x]

    def _bound(self):
        if self._word("last"):
            back = 0
            if self._word("-"):
                back = int(self._take()[1])
            return lambda i, r, n: n - 1 - back
        value = self.sum()
        return lambda i, r, n: int(value(i, r)[0])

    def _method(self, name, before):
        def number(x):
            try:
                return decimal.Decimal(str(x))
            except decimal.InvalidOperation as e:
                raise PathError(f"not a number: {x!r}") from e

        whole = lambda x: int(x) if x == x.to_integral() else x
        each = {
            "type": lambda x: _kind(x),
            "double": lambda x: whole(number(x)),
            "number": lambda x: whole(number(x)),
            "decimal": lambda x: whole(number(x)),
            "integer": lambda x: int(number(x).to_integral_value(decimal.ROUND_HALF_EVEN)),
            "bigint": lambda x: int(number(x).to_integral_value(decimal.ROUND_HALF_EVEN)),
            "abs": lambda x: abs(x),
            "ceiling": lambda x: int(number(x).to_integral_value(decimal.ROUND_CEILING)),
            "floor": lambda x: int(number(x).to_integral_value(decimal.ROUND_FLOOR)),
            "string": lambda x: x if isinstance(x, str) else json.dumps(x, default=str),
            "boolean": lambda x: x if isinstance(x, bool) else str(x).lower() in ("true", "t", "yes", "on", "1"),
        }
        if name == "size":
            return lambda i, r: [len(x) if isinstance(x, list) else 1 for x in before(i, r)]
        if name == "type":
            return lambda i, r: [_kind(x) for x in before(i, r)]
        if name == "keyvalue":
            return lambda i, r: [{"id": n, "key": k, "value": v} for n, x in enumerate(self._flat(before(i, r))) for k, v in x.items()]
        if name not in each:
            raise PathError(f"no method {name}()")
        return lambda i, r: [each[name](x) for x in self._flat(before(i, r))]

    def whole(self):
        mark = self.at
        try:
            found = self.sum()
            if self.at == len(self.tokens):
                return found
        except PathError:
            pass
        self.at = mark
        test = self.predicate()
        if self.at != len(self.tokens):
            raise PathError(f"unexpected {self._peek()!r}")
        return lambda i, r: [test(i, r)]


_compiled: dict[str, object] = {}


def compiled(path: str):
    if path not in _compiled:
        if len(_compiled) >= 256:
            _compiled.clear()
        _compiled[path] = _Parser(path).whole()
    return _compiled[path]


def query(document, path: str) -> list:
    return compiled(path)(document, document)
