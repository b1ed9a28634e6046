"""Command line: SQL and key-value shells, servers, backup, restore and pruning."""

from __future__ import annotations

import argparse
import atexit
import os
import shutil
import sys
import tempfile
from collections.abc import Callable, Iterable

from tidemark.engine import recovery
from tidemark.engine.errors import SqlError
from tidemark.engine.kv import KVStore
from tidemark.engine.session import Database, Session
from tidemark.session import local_session


def sql_shell(session: Session, lines: Iterable[str], say: Callable[[str], None] = print) -> None:
    """Statements that end with a semicolon, over as many lines as they take."""
    text = ""
    for line in lines:
        if not text and line.strip().lower() in ("exit", "quit", "\\q"):
            return
        text += line if line.endswith("\n") else line + "\n"
        if text.rstrip().endswith(";"):
            try:
                say(session.execute(text).text())
            except SqlError as error:
                say(f"Error: {error}")
            text = ""


def kv_shell(kv: KVStore, lines: Iterable[str], say: Callable[[str], None] = print) -> None:
    """GET, SET, DELETE, MGET, LEN, CLEAR, SNAPSHOT, FLUSH and INFO."""
    for line in lines:
        word, _, rest = line.strip().partition(" ")
        match word.lower():
            case "":
                continue
            case "exit" | "quit":
                return
            case "get":
                value = kv.get(rest.strip())
                say("(nil)" if value is None else value)
            case "set" if " " in rest.strip():
                key, _, value = rest.strip().partition(" ")
                kv.set(key, value)
                say("OK")
            case "del" | "delete":
                say("OK" if kv.delete(rest.strip()) else "(nil)")
            case "mget":
                say("\n".join(f"{k} = {v}" for k, v in kv.get_many(rest.split())))
            case "len":
                say(str(len(kv)))
            case "clear":
                kv.clear()
                say("OK")
            case "snapshot":
                say(f"sequence {kv.snapshot()}")
            case "flush":
                kv.flush()
                say("OK")
            case "info":
                say(f"keys {len(kv)}, log {kv.wal_size()}, sequence {kv.current_sequence}")
            case _:
                say(f"unknown command {word}")


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    parser.add_argument("--data", default="./data", help="folder of the database")
    parser.add_argument("--memory", action="store_true", help="keep nothing: a folder in memory, or else a temporary one, that goes at the end")
    sub = parser.add_subparsers(dest="command")
    for name in ("sql", "kv"):
        sub.add_parser(name)
    serve = sub.add_parser("serve")
    serve.add_argument("--port", type=int, default=8080)
    serve.add_argument("--mysql-port", type=int, default=3307)
    serve.add_argument("--user", default=os.environ.get("TIDEMARK_USER", "admin"))
    back = sub.add_parser("backup")
    back.add_argument("destination")
    bring = sub.add_parser("restore")
    bring.add_argument("source")
    bring.add_argument("--time")
    bring.add_argument("--point")
    cut = sub.add_parser("wal-prune")
    cut.add_argument("before")
    cut.add_argument("--apply", action="store_true")
    a = parser.parse_args(args)
    spark = local_session()
    if a.memory:
        if a.command in ("backup", "restore", "wal-prune"):
            parser.error(f"{a.command} needs a folder")
        a.data = tempfile.mkdtemp(prefix="tidemark-", dir="/dev/shm" if os.access("/dev/shm", os.W_OK) else None)
        atexit.register(shutil.rmtree, a.data, ignore_errors=True)
    sql_root, kv_root = os.path.join(a.data, "sql"), os.path.join(a.data, "kv")
    try:
        if a.command == "backup":
            print(recovery.backup(spark, a.data, a.destination))
        elif a.command == "restore":
            target: object = recovery.parse_rfc3339(a.time) if a.time else recovery.RecoveryPoint.parse(a.point) if a.point else "latest"
            print(recovery.restore(spark, a.source, a.data, target))
        elif a.command == "wal-prune":
            print("\n".join(recovery.prune(spark, a.data, recovery.parse_rfc3339(a.before), a.apply)))
        elif a.command == "kv":
            kv_shell(KVStore(spark, kv_root, 1000), sys.stdin)
        elif a.command == "serve":
            password = os.environ.get("TIDEMARK_PASSWORD")
            if not password:
                raise SqlError("set TIDEMARK_PASSWORD")
            from tidemark.engine import http, wire

            db = Database(spark, sql_root)
            wire.serve_background(db, a.user, password, port=a.mysql_port)
            http.server(db, KVStore(spark, kv_root, 1000), a.user, password, port=a.port).serve_forever()
        else:
            sql_shell(Database(spark, sql_root).session(), sys.stdin)
    except SqlError as error:
        print(f"Error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
