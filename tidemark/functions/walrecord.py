"""Lines of log files: a strict reader and the reason why a line is no record.

The grammar is RFC 8259 with nothing added. A record's checksum is the CRC-32 of its numbers as little-endian 64-bit
integers followed by its operation or statements in compact form.
"""

from __future__ import annotations

import json
import re
import zlib

KV_FIELDS = ("format_version", "sequence", "timestamp_millis", "operation", "checksum")
SQL_FIELDS = ("format_version", "base_version", "commit_version", "timestamp_millis", "statements", "checksum")
BLANK = " \t\r\n"
VERSION = 2

_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_PLAIN = re.compile(r'[^"\\\x00-\x1f]*')
_HEX = re.compile(r"[0-9a-fA-F]{4}")
_WHOLE = re.compile(r"0|[1-9][0-9]*")
_ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


class Syntax(ValueError):
    pass


class Number(str):
    """A number as it is spelt."""


class Pairs(list):
    """An object as (name, value) pairs, repeated names and order kept."""


def _string(s: str, at: int) -> tuple[str, int]:
    out = []
    while True:
        m = _PLAIN.match(s, at)
        out.append(m.group())
        at = m.end()
        if at >= len(s) or s[at] not in '"\\':
            raise Syntax("string")
        if s[at] == '"':
            return "".join(out), at + 1
        c = s[at + 1 : at + 2]
        if c == "u":
            if not _HEX.match(s, at + 2):
                raise Syntax("escape")
            n, at = int(s[at + 2 : at + 6], 16), at + 6
            if 0xD800 <= n < 0xDC00 and s[at : at + 2] == "\\u" and _HEX.match(s, at + 2):
                low = int(s[at + 2 : at + 6], 16)
                if 0xDC00 <= low < 0xE000:
                    n, at = 0x10000 + ((n - 0xD800) << 10) + (low - 0xDC00), at + 6
            out.append(chr(n))
        elif c and c in _ESCAPES:
            out.append(_ESCAPES[c])
            at += 2
        else:
            raise Syntax("escape")


def _skip(s: str, at: int) -> int:
    return _SPACE.match(s, at).end()


def parse(s: str) -> object:
    """The value of one complete JSON text; numbers stay as spelt and objects keep every pair. Nesting is kept on a
    stack of its own, so depth is bounded only by the text."""
    stack: list = []  # (container, name waiting for a value)
    at = _skip(s, 0)
    while True:
        c = s[at : at + 1]
        if c == "{":
            at = _skip(s, at + 1)
            if s[at : at + 1] == "}":
                value, at = Pairs(), at + 1
            else:
                name, at = _name(s, at)
                stack.append((Pairs(), name))
                continue
        elif c == "[":
            at = _skip(s, at + 1)
            if s[at : at + 1] == "]":
                value, at = [], at + 1
            else:
                stack.append(([], None))
                continue
        elif c == '"':
            value, at = _string(s, at + 1)
        elif s.startswith("true", at) or s.startswith("null", at):
            value, at = (True if c == "t" else None), at + 4
        elif s.startswith("false", at):
            value, at = False, at + 5
        else:
            m = _NUMBER.match(s, at)
            if not m:
                raise Syntax("value")
            value, at = Number(m.group()), m.end()
        while True:  # the value is complete: put it in its place
            at = _skip(s, at)
            if not stack:
                if at != len(s):
                    raise Syntax("more text")
                return value
            box, name = stack[-1]
            is_object = isinstance(box, Pairs)
            box.append((name, value) if is_object else value)
            c = s[at : at + 1]
            if c == ",":
                at = _skip(s, at + 1)
                if is_object:
                    name, at = _name(s, at)
                    stack[-1] = (box, name)
                break
            if c != ("}" if is_object else "]"):
                raise Syntax("separator")
            stack.pop()
            value, at = box, at + 1


def _name(s: str, at: int) -> tuple[str, int]:
    if s[at : at + 1] != '"':
        raise Syntax("name")
    name, at = _string(s, at + 1)
    at = _skip(s, at)
    if s[at : at + 1] != ":":
        raise Syntax("colon")
    return name, _skip(s, at + 1)


def compact(text: str) -> str:
    """A string as the log writer spells it."""
    return json.dumps(text, ensure_ascii=False)


def _whole(value: object, bits: int) -> int | None:
    if not isinstance(value, Number) or not _WHOLE.fullmatch(value) or len(value) > 20:
        return None
    n = int(value)
    return n if n < 1 << bits else None


def _text_pairs(value: object, names: tuple[str, ...]) -> dict | None:
    """The pairs of an object that has exactly ``names``, each once, all plain texts."""
    if not isinstance(value, Pairs) or sorted(n for n, _ in value) != sorted(names):
        return None
    found = dict(value)
    return found if all(type(v) is str for v in found.values()) else None


def _operation(value: object) -> str | None:
    """The compact spelling of a key-value operation, or None if it is none."""
    if type(value) is str:
        return '"Clear"' if value == "Clear" else None
    if not isinstance(value, Pairs) or len(value) != 1:
        return None
    name, inner = value[0]
    if name == "Set" and (x := _text_pairs(inner, ("key", "value"))) is not None:
        return f'{{"Set":{{"key":{compact(x["key"])},"value":{compact(x["value"])}}}}}'
    if name == "Delete" and (x := _text_pairs(inner, ("key",))) is not None:
        return f'{{"Delete":{{"key":{compact(x["key"])}}}}}'
    return None


def _statements(value: object) -> str | None:
    if not isinstance(value, list) or isinstance(value, Pairs):
        return None
    texts = [_text_pairs(v, ("Sql",)) for v in value]
    return None if None in texts else "[" + ",".join(f'{{"Sql":{compact(t["Sql"])}}}' for t in texts) + "]"


def checksum(numbers: list[int], body: str) -> int:
    head = b"".join(n.to_bytes(8, "little") for n in numbers)
    return zlib.crc32(head + body.encode("utf-8", "surrogatepass"))


def diagnose(line: str, engine: str) -> tuple[str | None, dict | None]:
    """(reason, None) of a line that is no record of ``engine``, else (None, its fields)."""
    try:
        value = parse(line)
    except Syntax:
        return "syntax", None
    if not isinstance(value, Pairs):
        return "syntax", None
    fields = KV_FIELDS if engine == "kv" else SQL_FIELDS
    if sorted(n for n, _ in value) != sorted(fields):
        return "fields", None
    found = dict(value)
    body_name = "operation" if engine == "kv" else "statements"
    numbers = {n: _whole(found[n], 32 if n in ("format_version", "checksum") else 64) for n in fields if n != body_name}
    body = (_operation if engine == "kv" else _statements)(found[body_name])
    if body is None or None in numbers.values():
        return "value", None
    if numbers["format_version"] != VERSION:
        return "version", None
    counted = [numbers[n] for n in fields if n not in ("format_version", "checksum", body_name)]
    if checksum(counted, body) != numbers["checksum"]:
        return "checksum", None
    return None, numbers | {body_name: body}
