"""Linking, subgraphs, solving with a scripted model, streaming, service, users and commands."""

import json
import threading
import urllib.error
import urllib.parse
import urllib.request

import pytest

from tripleframe.__main__ import main
from tripleframe.catalog import Catalog
from tripleframe.operators import strings
from tripleframe.qa import evaluate, solve, vectors
from tripleframe.qa.linking import Linker, citations, schema_context, subgraph
from tripleframe.service import Service, mcp_reply
from tripleframe.store import Store
from tripleframe.streaming import into_store, statements
from tripleframe.users import Denied, Users

TTL = """@prefix : <http://e/> . @prefix r: <http://www.w3.org/2000/01/rdf-schema#> .
:berlin r:label "Berlin"@en , "Berlin Stadt"@de ; a :City ; :capitalOf :germany . :germany r:label "Germany"@en ; a :Country ; :headOfState :frank .
:paris r:label "Paris"@en ; a :City ; :capitalOf :france . :france r:label "France"@en ; a :Country ."""
QUERY = "SELECT ?c WHERE { ?c <http://e/capitalOf> <http://e/germany> }"


@pytest.fixture(scope="module")
def store(spark):
    return Store.from_text(spark, TTL)


@pytest.fixture(scope="module")
def linker(store):
    return Linker(store.quads, languages=["en"])


def test_vectors(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 2.0]), (4, [1.0]), (5, [0.0, 0.0]), (6, [2.0, 2.0])], "id long, vec array<double>")
    assert [(r[0], round(r[1], 4)) for r in vectors.top_k(index, [1.0, 1.0], 3).collect()] == [(2, 1.0), (6, 1.0), (1, 0.7071)]
    queries = spark.createDataFrame([(7, [0.0, 1.0]), (8, [1.0])], "query_id long, vec array<double>")
    assert {(r["query_id"], r["id"]) for r in vectors.top_k_batch(index, queries, 1).collect()} == {(7, 3), (8, 4)}


def test_linking_and_context(store, linker):
    assert linker.link_mention("berlin")[0].uri == "http://e/berlin" and linker.link_predicate("head of state")[0].uri == "http://e/headOfState"
    assert len(linker.link_mention("zzz qqq")) == 1 and "Stadt" not in {c.text for c in linker.link_mention("Berlin Stadt", 9)}
    c = schema_context(store.quads, ["http://e/germany"], ["http://e/capitalOf"], sample=1)
    assert c.entities["http://e/germany"]["truncated"] and c.predicates["http://e/capitalOf"] == {"domain": ["<http://e/City>"], "range": ["<http://e/Country>"]}
    t = store.quads.select("s", "p", "o")
    assert subgraph(t, ["<http://e/berlin>"], 1).count() == 4 and subgraph(t, ["<http://e/berlin>"], 2, total=5).count() == 5 and subgraph(t, ["<http://e/berlin>"], 1, per_node=2).count() == 2
    assert [r["s"] for r in citations(t, ["http://e/paris", "http://e/france"], per_entity=1).collect()] == ["<http://e/paris>", "<http://e/france>"]


def test_solver(store, linker):
    intent = '{"mentions": ["Germany"], "relations": ["capital of"]}'
    model = solve.Scripted(intent, "```sparql\n" + QUERY + "\n```", "DELETE WHERE { ?s ?p ?o }", "nonsense")
    s = solve.Solver(store, model, linker)
    a = s.ask("What is the capital of Germany?")
    assert a.answers == [("<http://e/berlin>",)] and a.confidence == 1.0 and a.citations and s.ask("What is the capital of Germany?") is a
    broken = solve.Scripted(intent, "SELECT ?x WHERE { ?x <http://e/none> ?y }", "SELECT ?x WHERE { ?x <http://e/none> ?y }", "SELECT ?x WHERE { ?x <http://e/none> ?y }", QUERY)
    b = solve.Solver(store, broken, linker).ask("capital of Germany, please", "structured")
    assert b.answers and 0.8 < b.confidence <= 0.89
    none = solve.Solver(store, solve.Scripted(intent, "SELECT ?x WHERE { ?x <http://e/none> ?y }"), linker)
    assert none.ask("x", "structured").abstained and not none.cache
    rag = solve.Solver(store, solve.Scripted(intent, "Berlin."), linker).ask("about Germany", "graphrag")
    assert rag.text == "Berlin." and rag.mode == "graphrag"
    session = solve.Session(solve.Solver(store, solve.Scripted(intent, QUERY, QUERY, QUERY, "capital of Germany", intent, QUERY), linker))
    session.ask("first")
    assert session.ask("and again?").question == "capital of Germany" and len(session.turns) == 2
    assert solve.run_analytics(store, "shortest path", ["http://e/berlin", "http://e/frank"])[1] == ["<http://e/berlin>", "<http://e/germany>", "<http://e/frank>"]
    assert solve.classify_operation("most important city") == "pagerank" and solve.language_of("привет") == "ru" and solve.extract_intent(solve.Scripted("no json"), "q") == solve.Intent()
    assert solve.valid_candidates([QUERY, QUERY, "ASK { ?s ?p <http://e/unknown> }"], 5, {"http://e/capitalOf", "http://e/germany"}) == [QUERY]


def test_evaluation(spark, store, linker):
    assert evaluate.prf1(set(), set()) == (1, 1, 1) and evaluate.prf1({1}, set()) == (0, 0, 0) and evaluate.prf1({1, 2}, {2, 3, 4, 5})[:2] == (0.5, 0.25)
    qald = json.dumps({"questions": [{"id": 1, "question": [{"language": "en", "string": "capital?"}], "query": {"sparql": QUERY}, "answers": [{"head": {}, "results": {"bindings": [{"c": {"type": "uri", "value": "http://e/berlin"}}]}}]}]})
    s = solve.Solver(store, solve.Scripted("{}", QUERY), linker)
    assert evaluate.evaluate(s, evaluate.load_qald(qald))["f1"] == 1.0
    assert evaluate.load_lcquad('[{"_id": 5, "corrected_question": "q", "sparql_query": "s"}]')[0].query == "s"
    p = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, v long")
    g = spark.createDataFrame([("a", 2), ("c", 3)], "k string, v long")
    assert {r["k"]: round(r["f1"], 4) for r in evaluate.prf1_frame(p, g, "k", "v").collect()} == {"a": 0.6667, "b": 0.0, "c": 0.0}


def test_string_search(store):
    terms = strings.terms_of(store.quads)
    index = strings.trigram_index(terms)
    for needle in ("erl", "er", "Berlin Stadt", "zzz"):
        assert {r[0] for r in strings.contains(terms, needle, index).collect()} == {r["term"] for r in terms.collect() if needle in r["text"]}
    assert {r[0] for r in strings.prefix(terms, "http://e/f").collect()} == {"<http://e/france>", "<http://e/frank>"}


def test_stream_into_a_store(spark, tmp_path):
    store, folder = Store(spark), tmp_path / "in"
    folder.mkdir()
    (folder / "a.nt").write_text("<http://e/a> <http://e/p> <http://e/b> .\nbad line\n")
    for n, text in ((1, None), (2, "<http://e/a> <http://e/p> <http://e/b> .\n<http://e/c> <http://e/p> \"x\" <http://e/g> .\n")):
        if text:
            (folder / "b.nq").write_text(text)
        into_store(statements(spark, str(folder)), store, str(tmp_path / "check")).awaitTermination(60)
        assert store.quads.count() == n


def test_users():
    u = Users("secret")
    u.add("ann", "pw")
    with pytest.raises(Denied):
        u.check("ann", "no")
    token = u.login("ann", "pw")
    with pytest.raises(Denied):
        Users.require(u.of_session(token), "query")
    u.grant("ann", "query")
    Users.require(u.of_session(token), "query")
    other = Users("x")
    other.load_json(u.to_json())
    assert other.check("ann", "pw").privileges == ["query"] and u.logout(token) and not u.logout(token)


def test_service_and_commands(spark, tmp_path, store, linker, capsys):
    (tmp_path / "d.ttl").write_text(TTL)
    catalog = Catalog(spark, str(tmp_path / "root"))
    catalog.build("geo", [str(tmp_path / "d.ttl")])
    users = Users("pw")
    users.add("guest", "pw")
    server = Service(catalog, users, "geo", solve.Solver(store, solve.Scripted("{}", QUERY), linker)).server()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def get(path, **args):
        with urllib.request.urlopen(f"{base}{path}?{urllib.parse.urlencode(args)}") as r:
            return r.read().decode()

    try:
        token = json.loads(get("/login", user="root", password="pw"))["token"]
        assert len(json.loads(get("/sparql", query=QUERY, token=token))["results"]["bindings"]) == 1
        assert get("/sparql", query=QUERY, token=token, format="csv", stream="true").startswith("c\r\n")
        assert json.loads(get("/sparql", query="ASK { ?s ?p ?o }", token=token))["boolean"]
        assert json.loads(get("/update", query="INSERT DATA { <http://e/x> <http://e/y> 1 }", token=token)) == {"changed": 1}
        assert json.loads(get("/ask", question="capital?", token=token))["confidence"] == 1.0 and get("/health") == "ok"
        assert json.loads(get("/monitor", token=token))["triples"] == 13 and json.loads(get("/show", token=token)) == ["geo"]
        with pytest.raises(urllib.error.HTTPError):
            get("/sparql", query=QUERY)
        with pytest.raises(urllib.error.HTTPError):
            get("/drop", token=json.loads(get("/login", user="guest", password="pw"))["token"])
    finally:
        server.shutdown()
    call = lambda m, **p: mcp_reply(solve.Solver(store, solve.Scripted("{}", QUERY), linker), {"id": 1, "method": m, "params": p})
    assert len(call("tools/list")["result"]["tools"]) == 4 and "berlin" in call("tools/call", name="sparql", arguments={"text": QUERY})["result"]["content"][0]["text"]
    assert call("tools/call", name="sparql", arguments={"text": "CLEAR ALL"})["result"]["isError"] and "error" in call("nothing")
    root = ["--root", str(tmp_path / "cli")]
    main([*root, "build", "k", str(tmp_path / "d.ttl")], spark)
    (tmp_path / "more.nt").write_text("<http://e/q> <http://e/p> <http://e/r> .\n")
    main([*root, "add", "k", str(tmp_path / "more.nt")], spark)
    main([*root, "query", "k", "SELECT ?o WHERE { <http://e/q> ?p ?o }"], spark)
    main([*root, "export", "k", str(tmp_path / "out")], spark)
    main([*root, "show"], spark)
    assert "<http://e/r>" in capsys.readouterr().out
