"""Updates, transactions, versions, persistence, rules and formats."""

import io
import json

import pytest

from tripleframe.sources import rdf, results
from tripleframe.store import Conflict, Store, StoreError

PRE = "PREFIX : <http://e/> "
DATA = """@prefix : <http://e/> .
:a :age 30 ; :city :x . :b :age 40 ; :city :x . :c :age 50 ; :city :y .
"""


@pytest.fixture
def store(spark):
    return Store.from_text(spark, DATA)


def iri(name):
    return ("iri", "http://e/" + name)


def count(store):
    return store.quads.count()


def test_updates_count_changes(store):
    assert store.update(PRE + "INSERT DATA { :d :age 1 . :a :age 30 }") == 1
    assert store.update(PRE + "DELETE DATA { :d :age 1 . :zz :age 1 }") == 1
    assert store.update(PRE + "DELETE WHERE { ?s :age ?x }") == 3
    assert store.update(PRE + "INSERT { ?s :near ?o } WHERE { ?s :city ?c . ?o :city ?c }") == 5
    assert store.update(PRE + "DELETE { ?s :near ?o } INSERT { ?o :by ?s } WHERE { ?s :near ?o FILTER(?s != ?o) }") == 4
    assert store.update(PRE + "INSERT DATA { GRAPH :g { :q :r :s } } ; CLEAR DEFAULT") > 1
    assert [tuple(r) for r in store.select("SELECT ?g WHERE { GRAPH ?g { ?s ?p ?o } }").collect()] == [("http://e/g",)]
    assert store.update("DROP ALL") == 1 and count(store) == 0 and store.update("CREATE GRAPH <http://e/h>") == 0


def test_transactions_and_versions(store):
    first = store.version()
    store.begin()
    with pytest.raises(StoreError):
        store.begin()
    store.update(PRE + "DELETE WHERE { ?s :age ?x }")
    assert count(store) == 3
    store.rollback()
    assert count(store) == 6
    with pytest.raises(StoreError):
        store.commit()
    assert store.insert(iri("z"), iri("p"), iri("o")) and not store.insert(iri("z"), iri("p"), iri("o"))
    assert store.contains(iri("z"), iri("p"), iri("o"))
    assert store.at(first).select(PRE + "SELECT ?o WHERE { :z :p ?o }").count() == 0
    assert store.remove(iri("z"), iri("p"), iri("o"))
    store.collect_garbage(store.version())
    with pytest.raises(StoreError):
        store.at(first)


def test_optimistic_transactions(store):
    row = (iri("n"), iri("p"), iri("o"))
    a, b = store.transaction(), store.transaction()
    a.insert(*row)
    b.insert(*row)
    assert a.contains(*row) and not store.contains(*row)
    a.commit()
    with pytest.raises(Conflict):
        b.commit()
    c, d = store.transaction("serializable"), store.transaction("snapshot")
    assert c.read(*row)
    c.insert(iri("m"), iri("p"), iri("o"))
    store.remove(*row)
    with pytest.raises(Conflict):
        c.commit()
    d.insert(iri("k"), iri("p"), iri("o"))
    d.commit()
    e = store.transaction("read_committed")
    e.insert(*row)
    store.insert(*row)
    e.commit()
    assert store.run_transaction(lambda t: t.insert(iri("w"), iri("p"), iri("o")) or 5) == 5


def test_logs_and_snapshots(spark, store, tmp_path):
    store.enable_update_log()
    store.enable_redo_log()
    store.update(PRE + 'INSERT DATA { :n :t "REC 1 2\\nnew line" }')
    store.update(PRE + "DELETE WHERE { ?s :city ?c }")
    store.save_update_log(str(tmp_path / "log"))
    other, third = Store.from_text(spark, DATA), Store.from_text(spark, DATA)
    other.replay_updates(other.load_update_log(str(tmp_path / "log")))
    third.replay_redo(store.redo_log)
    want = sorted(map(repr, store.quads.collect()))
    assert sorted(map(repr, other.quads.collect())) == want == sorted(map(repr, third.quads.collect()))
    store.save(str(tmp_path / "db"))
    assert count(Store.load(spark, str(tmp_path / "db"))) == len(want)
    spark.createDataFrame([('{"quads": 99, "named": 0}',)], "value string").write.mode("overwrite").text(str(tmp_path / "db" / "meta"))
    with pytest.raises(StoreError):
        Store.load(spark, str(tmp_path / "db"))


def test_cache_and_metadata(store):
    text = PRE + "SELECT ?s WHERE { ?s :age ?x }"
    assert store.select(text) is store.select(text)
    assert store.select(PRE + "SELECT (RAND() AS ?r) WHERE { }") is not store.select(PRE + "SELECT (RAND() AS ?r) WHERE { }")
    before = store.select(text)
    store.update(PRE + "INSERT DATA { :q :age 1 }")
    assert store.select(text) is not before and store.select(text).count() == 4
    assert store.stats().first().asDict() == {"triples": 7, "subjects": 4, "objects": 6, "predicates": 2, "graphs": 0}
    assert {r["p"]: r["triples"] for r in store.predicate_stats().collect()} == {"<http://e/age>": 4, "<http://e/city>": 3}


def test_rdfs_and_rules(spark):
    s = Store.from_text(spark, """@prefix : <http://e/> . @prefix r: <http://www.w3.org/2000/01/rdf-schema#> .
    :Student r:subClassOf :Person . :Grad r:subClassOf :Student . :advises r:domain :Professor ; r:range :Grad . :mother r:subPropertyOf :parent .
    :alice a :Grad . :bob :advises :carol . :dave :mother :eve .""")
    added = s.materialize_rdfs()
    get = lambda q: sorted(r[0][9:] for r in s.select(PRE + q).collect())
    assert added > 0 and get("SELECT ?x WHERE { ?x a :Person }") == ["alice", "carol"] and get("SELECT ?x WHERE { ?x a :Professor }") == ["bob"]
    assert get("SELECT ?x WHERE { :dave :parent ?x }") == ["eve"] and s.materialize_rdfs() == 0
    classes, properties = s.schema()
    assert {"http://e/Grad", "http://e/Professor"} <= {r[0] for r in classes.collect()} and {"http://e/advises", "http://e/parent"} <= {r[0] for r in properties.collect()}

    s = Store.from_text(spark, "@prefix : <http://e/> . :a :p :b . :b :p :c . :c :p :d .")
    s.add_rule("up", "?x <http://e/p> ?y => ?x <http://e/q> ?y")
    s.add_rule("chain", "?x <http://e/q> ?y . ?y <http://e/q> ?z => ?x <http://e/q> ?z")
    with pytest.raises(StoreError):
        s.add_rule("up", "?x <http://e/p> ?y => ?x <http://e/q> ?y")
    assert s.run_rules() == 6 and [r[3] for r in s.list_rules()] == [3, 3] and s.run_rules() == 0
    s.enable_rule("chain", False)
    assert s.remove_rule("up") and not s.remove_rule("up")
    for bad in ("?x <p> ?y", "?x <p> ?y => ?x ?q ?y", "?x <p> ?y => ?x <q> ?w"):
        with pytest.raises(ValueError):
            s.add_rule("bad", bad)


def test_files_of_all_formats(spark, tmp_path):
    (tmp_path / "a.nt").write_text('# note\n<http://e/a>\t<http://e/p>\t"x \\u00e9 \\"q\\""@en .\n_:b <http://e/p> <http://e/c>\n\n')
    (tmp_path / "b.ttl").write_text("@prefix : <http://e/> . :a :p ( 1 2 ) ; a :T .")
    (tmp_path / "c.nq").write_text("<http://e/a> <http://e/p> <http://e/b> <http://e/g> .\n<http://e/a> <http://e/p> <http://e/b> .\n")
    (tmp_path / "d.trig").write_text("@prefix : <http://e/> . :g { :a :b :c } :d :e :f .")
    (tmp_path / "e.rdf").write_text('<r:RDF xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/"><r:Description r:about="http://e/a"><e:p r:resource="http://e/b"/><e:q r:datatype="http://e/t">5</e:q></r:Description></r:RDF>')
    want = {"a.nt": 2, "b.ttl": 6, "c.nq": 2, "d.trig": 2, "e.rdf": 2}
    for name, n in want.items():
        assert rdf.read(spark, str(tmp_path / name)).count() == n
    assert {tuple(r) for r in rdf.read(spark, str(tmp_path / "a.nt")).collect()} >= {(None, "<http://e/a>", "<http://e/p>", '"x é \\"q\\""@en')}
    assert {r["g"] for r in rdf.read(spark, str(tmp_path / "d.trig")).collect()} == {None, "<http://e/g>"}
    (tmp_path / "bad.nt").write_text("<http://e/a> nonsense .\n<http://e/a> <http://e/p> <http://e/b> .\n")
    with pytest.raises(Exception, match="not a statement"):
        rdf.read(spark, str(tmp_path / "bad.nt")).collect()
    assert rdf.read(spark, str(tmp_path / "bad.nt"), "ntriples") is not None and rdf.read_lines(spark, str(tmp_path / "bad.nt"), strict=False).count() == 1
    store = Store.from_files(spark, [str(tmp_path / "a.nt"), str(tmp_path / "c.nq")])
    assert count(store) == 4
    assert store.update(f"LOAD <file://{tmp_path}/b.ttl> INTO GRAPH <http://e/h>") == 6
    assert store.update("LOAD SILENT <http://e/none>") == 0
    rdf.write_ntriples(store.quads.where("g is null").select("s", "p", "o"), str(tmp_path / "out"))
    assert rdf.read(spark, str(tmp_path / "out"), "ntriples").count() == 3


def test_result_formats(spark):
    store = Store.from_text(spark, '@prefix : <http://e/> . :a :p "x,\\"y"@en , 5 .')
    df = store.select(PRE + "SELECT ?s ?o ?none WHERE { ?s :p ?o }", "ntriples")
    out = {f: io.StringIO() for f in results.TYPES}
    for f, o in out.items():
        results.write_select(df, f, o)
    parsed = json.loads(out["json"].getvalue())
    assert parsed["head"]["vars"] == ["s", "o", "none"] and len(parsed["results"]["bindings"]) == 2
    assert results.parse_json(out["json"].getvalue())[0]["s"] == ("iri", "http://e/a")
    assert '"x,""y"' in out["csv"].getvalue() and '"x,\\"y"@en' in out["tsv"].getvalue() and "<literal" in out["xml"].getvalue()
    assert results.negotiate(None, "text/csv;q=0.9") == "csv" and results.negotiate("xml", "text/csv") == "xml" and results.negotiate() == "json"
    assert results.ask_text(True, "json") == '{"head":{},"boolean":true}' and "?s" in results.table_text(df)
    assert rdf.ntriples_body(store.quads).count(" .\n") == 2
