"""A small HTTP service: SPARQL protocol, administration and questions."""

from __future__ import annotations

import base64
import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .catalog import Catalog
from .sources import rdf, results
from .users import Denied, Users

#: path -> privilege; None asks for an administrator
NEEDS = {"/sparql": "query", "/update": "update", "/ask": "query", "/status": "query", "/build": "load", "/load": "load", "/unload": "unload", "/drop": None, "/show": "query", "/begin": "update", "/commit": "update", "/rollback": "update", "/checkpoint": "update", "/backup": "backup", "/restore": "restore", "/export": "export", "/batchInsert": "update", "/batchRemove": "update", "/monitor": "query", "/logs": None, "/user": None}


class Service:
    """Requests are served one at a time; ``solver`` answers /ask."""

    def __init__(self, catalog: Catalog, users: Users | None = None, default: str = "default", solver=None):
        self.catalog, self.users, self.default, self.solver = catalog, users, default, solver
        self.lock = threading.Lock()

    def handle(self, path: str, args: dict, headers: dict) -> tuple[int, str, object]:
        """(status, content type, text or an iterator of text)."""
        try:
            if path == "/health":
                return 200, "text/plain", "ok"
            if path == "/login":
                return 200, "application/json", json.dumps({"token": self.users.login(args["user"], args["password"])})
            if path == "/logout":
                return 200, "application/json", json.dumps({"done": self.users.logout(args["token"])})
            if path not in NEEDS:
                return 404, "text/plain", "not found"
            if self.users is not None:
                Users.require(self._user(args, headers), NEEDS[path])
            with self.lock:
                return self._run(path, args, headers)
        except Denied as x:
            return 401, "text/plain", str(x)
        except KeyError as x:
            return 400, "text/plain", f"missing parameter {x}"
        except Exception as x:
            return 400, "text/plain", str(x)[:2000]

    def _user(self, args, headers):
        if "token" in args:
            return self.users.of_session(args["token"])
        kind, _, value = headers.get("authorization", "").partition(" ")
        if kind.lower() != "basic":
            raise Denied("credentials are needed")
        name, _, password = base64.b64decode(value).decode().partition(":")
        return self.users.check(name, password)

    def _run(self, path, args, headers):
        c, name = self.catalog, args.get("db", self.default)
        done = lambda v=True: (200, "application/json", json.dumps(v))
        if path in ("/sparql", "/update"):
            answer = c.query(name, args.get("update") or args["query"])
            if answer.kind == "update":
                return done({"changed": answer.value}) if path == "/update" else (400, "text/plain", "updates go to /update")
            if answer.kind == "construct":
                return 200, "application/n-triples", rdf.ntriples_body(answer.value)
            fmt = results.negotiate(args.get("format"), headers.get("accept"))
            if answer.kind == "ask":
                return 200, results.TYPES[fmt], results.ask_text(answer.value, fmt)
            lines = results.lines_of_select(answer.value, fmt)
            return 200, results.TYPES[fmt], lines if args.get("stream") == "true" else "".join(lines)
        if path == "/ask":
            a = self.solver.ask(args["question"], args.get("mode", "auto"))
            return done({"answer": a.text, "confidence": a.confidence, "mode": a.mode, "query": a.query, "abstained": a.abstained})
        if path == "/status":
            return done({"stores": c.show(), "loaded": sorted(c.stores)})
        if path == "/show":
            return done(c.show())
        if path == "/build":
            c.build(name, [p for p in args.get("files", "").split(",") if p])
        elif path == "/user":
            op = args["op"]
            {"add": lambda: self.users.add(args["name"], args["password"]), "remove": lambda: self.users.remove(args["name"]), "grant": lambda: self.users.grant(args["name"], args["privilege"]), "revoke": lambda: self.users.grant(args["name"], args["privilege"], False), "password": lambda: self.users.set_password(args["name"], args["password"])}[op]()
        elif path in ("/batchInsert", "/batchRemove"):
            return done({"changed": c.batch(name, args["file"], path == "/batchRemove")})
        elif path in ("/begin", "/commit", "/rollback"):
            getattr(c.get(name), path[1:])()
        elif path in ("/backup", "/export", "/restore"):
            getattr(c, path[1:])(name, args["path"])
        elif path == "/monitor":
            return done(c.monitor(name))
        elif path == "/logs":
            return done(c.log[-100:])
        else:
            getattr(c, path[1:])(name)
        return done()

    def server(self, port: int = 0) -> ThreadingHTTPServer:
        service = self

        class Handler(BaseHTTPRequestHandler):
            def _serve(self, body: bytes):
                url = urllib.parse.urlsplit(self.path)
                args = dict(urllib.parse.parse_qsl(url.query))
                kind = self.headers.get("Content-Type", "")
                if body and kind.startswith("application/sparql"):
                    args["update" if "update" in kind else "query"] = body.decode()
                elif body:
                    args |= dict(urllib.parse.parse_qsl(body.decode()))
                status, mime, text = service.handle(url.path, args, {k.lower(): v for k, v in self.headers.items()})
                self.send_response(status)
                self.send_header("Content-Type", f"{mime}; charset=utf-8")
                self.end_headers()
                for piece in [text] if isinstance(text, str) else text:
                    self.wfile.write(piece.encode())

            def do_GET(self):
                self._serve(b"")

            def do_POST(self):
                self._serve(self.rfile.read(int(self.headers.get("Content-Length", 0))))

            def log_message(self, *args):
                pass

        return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def mcp_reply(solver, message: dict) -> dict | None:
    """One JSON-RPC message of the tool protocol: initialize, tools/list, tools/call for ask, sparql, schema, link."""
    tools = {"ask": "Answer a question", "sparql": "Run a read-only query", "schema": "Classes and properties", "link": "Entities for a mention"}
    reply = lambda value: {"jsonrpc": "2.0", "id": message.get("id"), "result": value}
    method, params = message.get("method"), message.get("params") or {}
    if method == "initialize":
        return reply({"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "tripleframe", "version": "1"}})
    if method == "tools/list":
        return reply({"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": {"text": {"type": "string"}}}} for n, d in tools.items()]})
    if method == "tools/call" and params.get("name") in tools:
        text, name = (params.get("arguments") or {}).get("text", ""), params["name"]
        try:
            if name == "ask":
                out = solver.ask(text).text
            elif name == "sparql":
                from .qa.solve import read_only, run_query

                if not read_only(text):
                    raise ValueError("only SELECT and ASK are allowed")
                out = json.dumps(run_query(solver.store, text))
            elif name == "schema":
                out = json.dumps([[r[0] for r in part.limit(200).collect()] for part in solver.store.schema()])
            else:
                out = json.dumps([[c.uri, c.text, round(c.score, 4)] for c in solver.linker.link_mention(text)])
            return reply({"content": [{"type": "text", "text": out}]})
        except Exception as x:
            return reply({"content": [{"type": "text", "text": str(x)}], "isError": True})
    if "id" not in message:
        return None
    return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": -32601, "message": f"unknown method {method}"}}
