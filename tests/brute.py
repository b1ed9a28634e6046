"""Plain, slow versions of the operators, written without any of the library's code."""

from __future__ import annotations

import json
import re
import zlib


def sql_state(commits):
    """commits: (node, commit_version, statements JSON), repeated and in any order. Statements run one by one."""
    alive = {}
    seen = {}
    for node, version, text in commits:
        seen[node, version] = text
    for (node, version), text in sorted(seen.items()):
        for entry in json.loads(text):
            if "Bound" in entry:
                (kind, x), *_ = entry["Bound"].items()
                table = x["table_name"]
                if kind == "Insert":
                    at = x["columns"].index("id")
                    for row in x["source"]["Values"]:
                        alive[node, table, row[at]["Literal"]["Integer"]] = version
                    continue
                sel = x["selection"]
                if sel is None:
                    match = lambda n: True
                else:
                    value = sel["Binary"]["right"]["Literal"]["Integer"]
                    match = lambda n, v=value: n == v
            else:
                s = re.sub(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"", "0", entry["Sql"])
                s = re.sub(r"--[^\n]*\n|/\*.*?\*/", " ", s).replace("`", "").replace(";", " ").strip().lower()
                s = re.sub(r"\s+", " ", s)
                if s.startswith("create"):
                    continue
                m = re.match(r"(?:insert into|update|delete from) (?:\w+\.)?(\w+)", s)
                table = m.group(1)
                if s.startswith("insert"):
                    head, values = re.split(r"\bvalues\b", s, maxsplit=1)
                    columns = re.search(r"\(([^)]*)\)", head)
                    at = [c.strip() for c in columns.group(1).split(",")].index("id") if columns else 0
                    for row in re.findall(r"\(([^)]*)\)", values.split(" on duplicate")[0]):
                        alive[node, table, int(row.split(",")[at])] = version
                    continue
                kind = s.split()[0].capitalize()
                where = s.split(" where ")[1] if " where " in s else "1 = 1"
                where = re.sub(r"(?<![<>=!])=(?!=)", "==", where).replace("<>", "!=")
                where = re.sub(r"\bin \(([^)]*)\)", r"in (\1,)", where)
                match = lambda n, w=where: eval(w, {}, {"id": n})  # noqa: E731, S307
            for key in [k for k in alive if k[0] == node and k[1] == table and match(k[2])]:
                if kind == "Delete":
                    del alive[key]
                else:
                    alive[key] = version
    return alive


class _Twice(Exception):
    pass


def _pairs(pairs):
    names = [n for n, _ in pairs]
    return {"__names": names} | dict(pairs)


def reason(line, engine):
    """Reason by the standard parser, with its leniencies taken out."""

    def no(_):
        raise ValueError

    try:
        value = json.loads(line.strip(" \t\r\n"), object_pairs_hook=_pairs, parse_int=lambda s: ("n", s), parse_float=lambda s: ("n", s), parse_constant=no)
    except (ValueError, RecursionError):
        return "syntax"
    if not isinstance(value, dict):
        return "syntax"
    fields = (
        ["checksum", "format_version", "operation", "sequence", "timestamp_millis"]
        if engine == "kv"
        else ["base_version", "checksum", "commit_version", "format_version", "statements", "timestamp_millis"]
    )
    if sorted(value["__names"]) != fields:
        return "fields"
    numbers = {}
    for f in fields:
        if f in ("operation", "statements"):
            continue
        v = value[f]
        if not (isinstance(v, tuple) and re.fullmatch(r"\d+", v[1])):
            return "value"
        if int(v[1]) >= 2 ** (32 if f in ("format_version", "checksum") else 64):
            return "value"
        numbers[f] = int(v[1])

    def is_text(x):
        return isinstance(x, str)

    if engine == "kv":
        op = value["operation"]
        if op == "Clear":
            body = "Clear"
        elif isinstance(op, dict) and op["__names"] == ["Set"] and isinstance(op["Set"], dict) and sorted(op["Set"]["__names"]) == ["key", "value"]:
            if not (is_text(op["Set"]["key"]) and is_text(op["Set"]["value"])):
                return "value"
            body = {"Set": {"key": op["Set"]["key"], "value": op["Set"]["value"]}}
        elif isinstance(op, dict) and op["__names"] == ["Delete"] and isinstance(op["Delete"], dict) and op["Delete"]["__names"] == ["key"]:
            if not is_text(op["Delete"]["key"]):
                return "value"
            body = {"Delete": {"key": op["Delete"]["key"]}}
        else:
            return "value"
        order = ["sequence", "timestamp_millis"]
    else:
        st = value["statements"]
        if not isinstance(st, list):
            return "value"
        for x in st:
            if not (isinstance(x, dict) and x["__names"] == ["Sql"] and is_text(x["Sql"])):
                return "value"
        body = [{"Sql": x["Sql"]} for x in st]
        order = ["base_version", "commit_version", "timestamp_millis"]
    if numbers["format_version"] != 2:
        return "version"
    data = b"".join(numbers[n].to_bytes(8, "little") for n in order)
    data += json.dumps(body, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass")
    return None if zlib.crc32(data) == numbers["checksum"] else "checksum"
