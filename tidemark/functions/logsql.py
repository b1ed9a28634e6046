"""What a logged statement does to the rows of a table, as sets of primary keys.

A statement becomes a list of effects ``(table, kind, lo, hi)``: kind ``I`` inserts the keys ``lo..hi`` (or changes them
on a duplicate key), ``U`` touches those that exist and ``D`` removes them. Effects do not depend on the state of the
table, so they can be folded in any order.
"""

from __future__ import annotations

import json
import math
import re

from tidemark.functions import intervals as iv

_TOKEN = re.compile(
    r"""\s+|--[^\n]*|\#[^\n]*|/\*.*?\*/
    |(?P<str>[nNeE]?'(?:[^'\\]|''|\\.)*'|"(?:[^"\\]|""|\\.)*")
    |`(?P<quoted>(?:[^`]|``)*)`
    |(?P<num>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)
    |(?P<word>[^\W\d]\w*)
    |(?P<op><=|>=|<>|!=|[=<>(),.;*+\-/?@%])""",
    re.X | re.S,
)


class Unsupported(ValueError):
    """The statement's effect cannot be told from its text alone."""


def tokens(sql: str) -> list[tuple[str, object]]:
    """(kind, value) pairs: s text, q quoted name, n number, w lower-case word, o operator."""
    out, at = [], 0
    for m in _TOKEN.finditer(sql):
        if m.start() != at:
            raise Unsupported(f"character {sql[at]!r}")
        at = m.end()
        kind = m.lastgroup
        if kind == "word":
            out.append(("w", m.group().lower()))
        elif kind == "op":
            out.append(("o", m.group()))
        elif kind == "num":
            text = m.group()
            out.append(("n", int(text) if text.isdigit() else float(text)))
        elif kind == "str":
            out.append(("s", m.group()))
        elif kind == "quoted":
            out.append(("q", m.group("quoted").lower()))
    if at != len(sql):
        raise Unsupported(f"character {sql[at]!r}")
    return out


def compare(op: str, value: object, flipped: bool = False) -> tuple:
    """The integers ``n`` for which ``n op value`` holds (``value op n`` when flipped)."""
    if flipped:
        op = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op)
    if value is None:
        return iv.NONE
    if isinstance(value, (bool, str)):  # unlike types are never equal
        return iv.ALL if op in ("!=", "<>") else iv.NONE
    whole = float(value).is_integer() if isinstance(value, float) else True
    if op in ("=", "!=", "<>"):
        hit = iv.make(int(value), int(value)) if whole else iv.NONE
        return hit if op == "=" else iv.complement(hit)
    floor, ceil = (math.floor(value), math.ceil(value)) if not isinstance(value, int) else (value, value)
    return {
        "<": lambda: iv.make(iv.LOW, ceil - 1),
        "<=": lambda: iv.make(iv.LOW, floor),
        ">": lambda: iv.make(floor + 1, iv.HIGH),
        ">=": lambda: iv.make(ceil, iv.HIGH),
    }[op]()


class _Where:
    """Recursive descent over the tokens of a condition. A set stands for the keys for which it is TRUE, beside the
    set for which it is FALSE: keys in neither are UNKNOWN."""

    def __init__(self, toks: list, key: str):
        self.toks, self.at, self.key = toks, 0, key

    def peek(self, kind: str, value: object) -> bool:
        return self.at < len(self.toks) and self.toks[self.at] == (kind, value)

    def take(self, kind: str, value: object) -> bool:
        if self.peek(kind, value):
            self.at += 1
            return True
        return False

    def need(self, kind: str, value: object) -> None:
        if not self.take(kind, value):
            raise Unsupported(f"expected {value}")

    def whole(self) -> tuple:
        both = self.either()
        if self.at != len(self.toks):
            raise Unsupported("words after the condition")
        return both[0]

    def either(self) -> tuple:
        t, f = self.both()
        while self.take("w", "or"):
            t2, f2 = self.both()
            t, f = iv.union(t, t2), iv.intersect(f, f2)
        return t, f

    def both(self) -> tuple:
        t, f = self.negated()
        while self.take("w", "and"):
            t2, f2 = self.negated()
            t, f = iv.intersect(t, t2), iv.union(f, f2)
        return t, f

    def negated(self) -> tuple:
        if self.take("w", "not"):
            t, f = self.negated()
            return f, t
        if self.peek("o", "("):
            self.at += 1
            inner = self.either()
            self.need("o", ")")
            return inner
        return self.test()

    def operand(self) -> tuple[bool, object]:
        """(is the key, literal)."""
        sign = 1
        while self.at < len(self.toks) and self.toks[self.at] in (("o", "-"), ("o", "+")):
            sign = -sign if self.toks[self.at][1] == "-" else sign
            self.at += 1
        if self.at >= len(self.toks):
            raise Unsupported("the condition ends early")
        kind, value = self.toks[self.at]
        self.at += 1
        if kind == "n":
            return False, sign * value
        if kind == "s":
            return False, "text"
        if kind == "w" and value in ("null", "true", "false"):
            return False, {"null": None, "true": True, "false": False}[value]
        if kind in "wq":
            if self.take("o", "."):
                kind, value = self.toks[self.at]
                self.at += 1
            if value == self.key:
                return True, None
        raise Unsupported(f"operand {value}")

    def test(self) -> tuple:
        is_key, value = self.operand()
        if is_key:
            if self.take("w", "is"):
                negated = self.take("w", "not")
                self.need("w", "null")
                return (iv.ALL, iv.NONE) if negated else (iv.NONE, iv.ALL)
            negated = self.take("w", "not")
            if self.take("w", "in"):
                self.need("o", "(")
                hit, unknown = iv.NONE, False
                while True:
                    other, v = self.operand()
                    if other:
                        raise Unsupported("the key in a list")
                    unknown |= v is None
                    hit = iv.union(hit, compare("=", v))
                    if not self.take("o", ","):
                        break
                self.need("o", ")")
                miss = iv.NONE if unknown else iv.complement(hit)
                return (miss, hit) if negated else (hit, miss)
            if self.take("w", "between"):
                lo = self.operand()[1]
                self.need("w", "and")
                hi = self.operand()[1]
                hit = iv.intersect(compare(">=", lo), compare("<=", hi))
                miss = iv.union(compare("<", lo), compare(">", hi))
                return (miss, hit) if negated else (hit, miss)
        if self.at >= len(self.toks) or self.toks[self.at][1] not in ("=", "!=", "<>", "<", "<=", ">", ">="):
            raise Unsupported("a condition that is no comparison")
        op = self.toks[self.at][1]
        self.at += 1
        other, v = self.operand()
        if is_key == other:
            raise Unsupported("a comparison without the key and a literal")
        hit = compare(op, v if is_key else value, not is_key)
        return hit, (iv.NONE if (v if is_key else value) is None else iv.complement(hit))


def _name(toks: list, at: int) -> tuple[str, int]:
    if at >= len(toks) or toks[at][0] not in "wq":
        raise Unsupported("no table name")
    name, at = toks[at][1], at + 1
    while at + 1 < len(toks) and toks[at] == ("o", ".") and toks[at + 1][0] in "wq":
        name, at = toks[at + 1][1], at + 2
    return name, at


def _split(toks: list) -> list[list]:
    parts, depth = [[]], 0
    for t in toks:
        if t[0] == "o":
            depth += (t[1] == "(") - (t[1] == ")")
            if t[1] == "," and not depth:
                parts.append([])
                continue
        parts[-1].append(t)
    return parts


def _close(toks: list, at: int) -> int:
    depth = 0
    for i in range(at, len(toks)):
        if toks[i][0] == "o":
            depth += (toks[i][1] == "(") - (toks[i][1] == ")")
            if not depth:
                return i
    raise Unsupported("an open bracket")


def _integer(toks: list) -> int:
    sign = 1
    for i, (kind, v) in enumerate(toks):
        if kind == "o" and v in "+-":
            sign = -sign if v == "-" else sign
        elif kind == "n" and isinstance(v, int) and i == len(toks) - 1:
            return sign * v
        else:
            break
    raise Unsupported("a key that is no whole number")


def _assigned(toks: list, key: str, hit: tuple = ()) -> None:
    """Refuse assignments that would move a row to another key, and words that do not belong to assignments."""
    for part in _split(toks):
        name, at = _name(part, 0)
        if at >= len(part) or part[at] != ("o", "="):
            raise Unsupported("an assignment without =")
        value = part[at + 1 :]
        depth = 0
        for kind, v in value:
            depth += (v == "(") - (v == ")") if kind == "o" else 0
            if kind == "w" and not depth and v in ("order", "limit", "returning", "where", "from"):
                raise Unsupported(f"{v} after assignments")
        if not value:
            raise Unsupported("an assignment without a value")
        if name != key:
            continue
        bare = [v for k, v in value if (k, v) not in (("o", "("), ("o", ")"), ("w", "values"))]
        same = bare[-1:] == [key] and all(k in "wqo" and v in (key, ".", bare[0]) for k, v in value if v not in ("(", ")", "values"))
        if not same and not (len(hit) == 1 and hit[0][0] == hit[0][1] and len(value) == 1 and value[0] == ("n", hit[0][0])):
            raise Unsupported("an assignment to the key")


def _one(toks: list, key: str) -> list[tuple]:
    verb = toks[0]
    if verb == ("w", "insert"):
        at = 2 if len(toks) > 1 and toks[1] == ("w", "into") else 1
        name, at = _name(toks, at)
        place = 0
        if at < len(toks) and toks[at] == ("o", "("):
            end = _close(toks, at)
            columns = [v for k, v in toks[at + 1 : end] if k in "wq"]
            if key not in columns:
                raise Unsupported("an insert without the key")
            place, at = columns.index(key), end + 1
        if at >= len(toks) or toks[at][1] not in ("values", "value"):
            raise Unsupported("an insert without values")
        at, out = at + 1, []
        while at < len(toks) and toks[at] == ("o", "("):
            end = _close(toks, at)
            n = _integer(_split(toks[at + 1 : end])[place])
            out.append((name, "I", n, n))
            at = end + 1
            if at < len(toks) and toks[at] == ("o", ","):
                at += 1
        if at < len(toks):
            if toks[at : at + 4] != [("w", w) for w in ("on", "duplicate", "key", "update")]:
                raise Unsupported("words after the values")
            _assigned(toks[at + 4 :], key)
        return out
    if verb in (("w", "update"), ("w", "delete")):
        at = 1 if verb[1] == "update" else 2
        if verb[1] == "delete" and toks[1:2] != [("w", "from")]:
            raise Unsupported("a delete without from")
        name, at = _name(toks, at)
        depth, where, end = 0, None, len(toks)
        for i in range(at, len(toks)):
            if toks[i][0] == "o":
                depth += (toks[i][1] == "(") - (toks[i][1] == ")")
            elif toks[i] == ("w", "where") and not depth:
                where, end = toks[i + 1 :], i
                break
        hit = iv.ALL if where is None else _Where(where, key).whole()
        if verb[1] == "update":
            if toks[at : at + 1] != [("w", "set")]:
                raise Unsupported("an update without set")
            _assigned(toks[at + 1 : end], key, hit)
        elif at != end:
            raise Unsupported("words after the table's name")
        return [(name, verb[1][0].upper(), lo, hi) for lo, hi in hit]
    if verb in (("w", "create"), ("w", "set"), ("w", "begin"), ("w", "commit"), ("w", "start"), ("w", "select")):
        return []
    if verb == ("w", "drop") and len(toks) > 2 and toks[1] == ("w", "table"):
        return [(_name(toks, 4 if toks[2] == ("w", "if") else 2)[0], "D", iv.LOW, iv.HIGH)]
    raise Unsupported(f"statement {verb[1]}")


def sql_statements(sql: str, key: str = "id") -> list[list[tuple]]:
    """Effects of each statement of one SQL text; several may be parted by ``;``."""
    out, part = [], []
    for t in [*tokens(sql), ("o", ";")]:
        if t == ("o", ";"):
            if part:
                out.append(_one(part, key))
            part = []
        else:
            part.append(t)
    return out


def sql_effects(sql: str, key: str = "id") -> list[tuple]:
    """Effects of one SQL text, its statements one after another."""
    return [e for effects in sql_statements(sql, key) for e in effects]


#: The names of the comparison operators in a logged statement tree.
TREE_OPERATORS = {
    "Equal": "=",
    "NotEqual": "!=",
    "LessThan": "<",
    "LessThanOrEqual": "<=",
    "GreaterThan": ">",
    "GreaterThanOrEqual": ">=",
}


def _tree_literal(node: dict) -> object:
    if "Literal" in node:
        v = node["Literal"]
        return next(iter(v.values())) if isinstance(v, dict) else None
    if "Unary" in node and node["Unary"]["op"] in ("Negate", "Plus"):
        v = _tree_literal(node["Unary"]["expr"])
        return -v if node["Unary"]["op"] == "Negate" else v
    raise Unsupported("an operand that is no literal")


def _tree_is_key(node: dict, key: str) -> bool:
    return "Column" in node and str(node["Column"]["name"]).lower() == key


def _tree_where(node: dict, key: str) -> tuple:
    (kind, x), *_ = node.items()
    if kind == "Binary":
        if x["op"] in ("And", "Or"):
            (t, f), (t2, f2) = _tree_where(x["left"], key), _tree_where(x["right"], key)
            return (iv.intersect(t, t2), iv.union(f, f2)) if x["op"] == "And" else (iv.union(t, t2), iv.intersect(f, f2))
        op = TREE_OPERATORS.get(x["op"].get("Compare") if isinstance(x["op"], dict) else "")
        left, right = _tree_is_key(x["left"], key), _tree_is_key(x["right"], key)
        if op and left != right:
            value = _tree_literal(x["right"] if left else x["left"])
            hit = compare(op, value, right)
            return hit, (iv.NONE if value is None else iv.complement(hit))
    elif kind == "Unary" and x["op"] == "Not":
        t, f = _tree_where(x["expr"], key)
        return f, t
    elif kind == "InList" and _tree_is_key(x["expr"], key):
        values = [_tree_literal(v) for v in x["list"]]
        hit = iv.NONE
        for v in values:
            hit = iv.union(hit, compare("=", v))
        miss = iv.NONE if None in values else iv.complement(hit)
        return (miss, hit) if x["negated"] else (hit, miss)
    elif kind == "IsNull" and _tree_is_key(x["expr"], key):
        return (iv.ALL, iv.NONE) if x["negated"] else (iv.NONE, iv.ALL)
    raise Unsupported("a condition on more than the key")


def _tree_assigned(assignments: list | None, key: str) -> None:
    """Refuse assignments to the key other than of itself."""
    for name, value in assignments or ():
        if str(name).lower() == key and not _tree_is_key(value, key):
            raise Unsupported("an assignment to the key")


def tree_effects(node: dict | str, key: str = "id", columns: dict[str, list[str]] | None = None) -> list[tuple]:
    """Effects of a logged statement tree."""
    if isinstance(node, str):
        return []
    (kind, x), *_ = node.items()
    if kind == "Insert":
        name = x["table_name"].lower()
        order = [c.lower() for c in x["columns"]] if x.get("columns") else (columns or {}).get(name, [key])
        if key not in order or "Values" not in x["source"]:
            raise Unsupported("an insert without the key or without values")
        keys = [_tree_literal(row[order.index(key)]) for row in x["source"]["Values"]]
        if not all(type(k) is int for k in keys):
            raise Unsupported("a key that is no whole number")
        _tree_assigned(x.get("on_duplicate"), key)
        return [(name, "I", k, k) for k in keys]
    if kind in ("Update", "Delete"):
        hit = iv.ALL if x.get("selection") is None else _tree_where(x["selection"], key)[0]
        _tree_assigned(x.get("assignments"), key)
        return [(x["table_name"].lower(), kind[0], lo, hi) for lo, hi in hit]
    if kind == "DropTable":
        return [(x["table_name"].lower(), "D", iv.LOW, iv.HIGH)]
    return []


def list_effects(statements: str, key: str = "id") -> list[tuple]:
    """``(position, table, kind, lo, hi)`` of every statement of a logged JSON list, in the order they run."""
    out, place = [], 0
    for entry in json.loads(statements):
        for found in sql_statements(entry["Sql"], key) if "Sql" in entry else [tree_effects(entry["Bound"], key)]:
            out += [(place, *e) for e in found]
            place += 1
    return out
