import pytest
from pyspark.sql import functions as F

from quadlens.functions.canonical import canonical_form
from quadlens.operators import lookup as L
from quadlens.operators import patterns as P
from quadlens.operators import shapes as G
from quadlens.plans import runs
from quadlens.sources import graph, reports

QUADS = "s string, p string, o string, o_kind string, datatype string, lang string, g string"


@pytest.fixture(scope="module")
def quads(spark):
    rows = [("a", "p", "b"), ("a2", "p", "b2"), ("d", "q2", "e")]
    xsd = "http://www.w3.org/2001/XMLSchema#"
    literals = [("n1", "age", "42", "literal", xsd + "integer", None, "h2"), ("n2", "age", "7", "literal", xsd + "integer", None, "h2"),
                ("n1", "name", "Anna b", "literal", None, "en", "h2")]
    return spark.createDataFrame([(*r, "uri", None, None, "g") for r in rows] + literals, QUADS)


def log_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid long, query_text string")


VERDICTS = {
    "SELECT * { BIND ( <none> AS ?c ) ?o <p> ?c }": None,
    "SELECT * { ?o <p> ?c BIND ( STR ( ?o ) AS ?y ) }": True,
    "SELECT * FROM <h> { ?a <p> ?b }": None,
    "SELECT * { OPTIONAL { <a> <p> ?z } ?z <q2> ?c }": None,
    "SELECT * { ?z <q2> ?c OPTIONAL { <a> <p> ?z } }": True,
    "SELECT * { { OPTIONAL { ?x <none> ?y } } UNION { ?x <none2> ?y } }": True,
    "SELECT * { { } UNION { ?x <none2> ?y } }": True,
    "SELECT * { ?x <none> ?z { OPTIONAL { ?x <p> ?y } } UNION { ?x <none2> ?y } }": False,
    "SELECT * { ?x <p> ?z { OPTIONAL { ?x <none> ?y } } UNION { ?x <none2> ?y } }": True,
    "SELECT * { OPTIONAL { ?x <p> ?b } }": True,
    "ASK { }": True,
    "SELECT * { { ?a <none> ?b } UNION { ?a <none2> ?b } }": False,
    "SELECT * { ?s <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <c> . ?s <p> <b> }": False,
    "SELECT * { ?a <p> ?b } LIMIT 0": False,
    "SELECT ( COUNT ( * ) AS ?n ) { ?a <none> ?b } LIMIT 0": False,
    "SELECT * { ?a <p> ?b } OFFSET 9": None,
    "SELECT * { ?a <none> ?b } OFFSET 9": False,
    "DESCRIBE <a>": True,
    "DESCRIBE <b>": False,
    "DESCRIBE <b> <d>": True,
    "SELECT ?s { ?s ?p ?s }": False,
    "SELECT * { ?s ?p ?o . ?o ?q ?r }": False,
    "SELECT * { ?s ?p ?o . ?s ?q ?r }": True,
    "SELECT * { ?a <p> ?b FILTER ( ?a = <a2> ) }": True,
    "SELECT * { ?a <p> ?b FILTER ( ?a = <d> ) }": False,
    "SELECT * { ?a <p> ?b FILTER ( ?a != <a> && ?b != <b2> ) }": False,
    "SELECT * { ?a <p> ?b FILTER ( ?a IN ( <z> , <a> ) ) FILTER ( ?b NOT IN ( <b2> ) ) }": True,
    "SELECT * { ?a <p> ?b FILTER ( ?a = <a> || ?b = <none> ) }": True,
    "SELECT * { ?a <p> ?b FILTER ( ?a = ?b ) }": False,
    "SELECT * { ?a <p> ?b FILTER ( ?c = <a> ) }": None,
    "SELECT * { ?a <p> ?b FILTER ( STRLEN ( ?b ) > 3 ) }": None,
    "SELECT * { ?n <age> ?x FILTER ( ?x > 40 ) }": True,
    "SELECT * { ?n <age> ?x FILTER ( 42 < ?x ) }": False,
    "SELECT * { ?n <age> ?x FILTER ( ?x = 42.0 ) }": True,
    "SELECT * { ?n <name> ?x FILTER ( LANG ( ?x ) = \"en\" ) }": True,
    "SELECT * { ?n <name> ?x FILTER LANGMATCHES ( LANG ( ?x ) , \"FR\" ) }": False,
    "SELECT * { ?n <name> ?x FILTER REGEX ( ?x , \"^ann\" , \"i\" ) }": True,
    "SELECT * { ?n <name> ?x FILTER REGEX ( ?x , \"^nn\" ) }": False,
    "SELECT * { ?n <name> ?x FILTER REGEX ( ?x , \"a.*b\" ) }": None,
    "SELECT * { ?n <name> ?x FILTER CONTAINS ( LCASE ( STR ( ?x ) ) , \"anna\" ) }": True,
    "SELECT * { ?n <name> ?x FILTER ( ISIRI ( ?x ) ) }": False,
    "SELECT * { VALUES ?a { <a> <z> } ?a <p> ?b }": True,
    "SELECT * { VALUES ( ?a ?b ) { ( <a> <b2> ) ( <a2> <b> ) } ?a <p> ?b }": False,
    "SELECT * { VALUES ( ?a ?b ) { ( <a> UNDEF ) ( <a2> <b> ) } ?a <p> ?b }": True,
    "SELECT * { ?a <p> ?b } VALUES ?b { <none> }": False,
    "SELECT * { ?a <p> ?b MINUS { ?a <p> <b> } }": True,
    "SELECT * { ?a <p> ?b MINUS { ?a <p> ?c } }": False,
    "SELECT * { ?a <p> ?b MINUS { ?x <q2> ?y } }": True,
    "SELECT * { ?a <p> ?b MINUS { ?a <age> ?x } MINUS { ?b <q2> ?x } }": True,
    "SELECT * { ?a <p> ?b FILTER EXISTS { ?a <p> <b2> } }": True,
    "SELECT * { ?a <p> ?b FILTER EXISTS { ?a <q2> ?c } }": False,
    "SELECT * { ?a <p> ?b FILTER EXISTS { ?x <q2> ?y } }": True,
    "SELECT * { ?a <p> ?b FILTER NOT EXISTS { ?x <q2> ?y } }": False,
    "SELECT * { ?a <p> ?b FILTER NOT EXISTS { ?b <q2> ?y } FILTER NOT EXISTS { ?a <p> <b> } }": True,
    "SELECT * { ?a <p> ?b FILTER NOT EXISTS { ?b <q2> ?y . ?y <p> ?z } FILTER ( ?a = <a> ) }": True,
    "SELECT * { ?a <p> ?b FILTER NOT EXISTS { ?a <p> ?c FILTER ( ?c = <b> ) } }": None,
    "SELECT * { { ?a <p> ?b FILTER ( ?a = <z> ) } UNION { ?a <q2> ?b FILTER ( ?a = <d> ) } }": True,
    "SELECT * { { ?a <p> ?b MINUS { ?a <p> ?c } } UNION { ?a <none> ?b } }": False,
    "SELECT * { GRAPH <g> { ?a <p> ?b } }": True,
    "SELECT * { GRAPH <h> { ?a <p> ?b } }": False,
    "SELECT * { GRAPH ?g { ?a <p> ?b . ?n <age> ?x } }": False,
    "SELECT * { GRAPH ?g { ?a <p> ?b . ?c <q2> ?d } }": True,
    "SELECT * { ?a <p> ?b OPTIONAL { ?a <age> ?x FILTER ( ?x > 99 ) } }": True,
    "SELECT * { ?a <p> ?b OPTIONAL { ?a <age> ?x } FILTER ( ?x > 99 ) }": None,
    "ASK { FILTER NOT EXISTS { <a> <p> <b2> } }": True,
    "ASK { FILTER EXISTS { <a> <p> <b2> } }": False,
}


def test_verdicts_of_clauses_that_change_the_answer(spark, quads):
    unique = P.unique_queries(log_of(spark, VERDICTS))
    got = {r.uq_id: r.valid for r in L.validity(unique, P.unique_triples(unique), quads).collect()}
    assert got == dict(enumerate(VERDICTS.values()))


def test_answers_follow_the_form_and_the_result_variables(spark, quads):
    texts = ["SELECT ?a { ?a <p> ?b }", "SELECT ?b { ?a <p> ?b }", "SELECT (COUNT(?b) AS ?n) { ?a <p> ?b }", "CONSTRUCT { ?a <r> ?b } { ?a <p> ?b }",
             "SELECT DISTINCT ?x { ?x <p> ?y }", "SELECT ?a ?c { ?a <p> ?b OPTIONAL { ?b <q> ?c } }", "SELECT ?a { ?a <p> ?b OPTIONAL { ?b <q> ?c } }",
             "SELECT * { ?a <p> ?b }", "ASK { ?a <p> ?b }"]
    unique = P.unique_queries(log_of(spark, texts))
    found = {}
    for r in L.bindings(unique, P.unique_triples(unique), quads).collect():
        found.setdefault(r.uq_id, set()).add(tuple((v["var"], v["val"]) for v in r.vals))
    assert found == {0: {(("a", "<a>"),), (("a", "<a2>"),)}, 1: {(("b", "<b>"),), (("b", "<b2>"),)}, 4: {(("x", "<a>"),), (("x", "<a2>"),)},
                     6: {(("a", "<a>"),), (("a", "<a2>"),)}, 7: {(("a", "<a>"), ("b", "<b>")), (("a", "<a2>"), ("b", "<b2>"))}}


def test_smallest_answers_of_apart_patterns_and_of_the_whole_graph(spark, quads):
    texts = ["SELECT * { ?s ?p ?o }", "SELECT * { ?a <p> ?b . ?c <q2> ?d }", "SELECT ?c ?a { ?a <p> ?b . ?c <p> ?d FILTER ( ?a != <a> ) }",
             "SELECT ?a { ?a <p> ?b . ?c <none> ?d }", "SELECT * { ?a <p> ?b . <d> <q2> <e> MINUS { ?b <p> ?c } MINUS { ?x <none> ?y } }",
             "SELECT * { ?o <p> ?c BIND ( STR ( ?o ) AS ?y ) }", "SELECT ?a { ?a <p> ?b } LIMIT 0"]
    unique = P.unique_queries(log_of(spark, texts))
    found = {}
    for r in L.bindings(unique, P.unique_triples(unique), quads, most=2).collect():
        found.setdefault(r.uq_id, []).append({v["var"]: v["val"] for v in r.vals})
    found = {k: sorted(v, key=str) for k, v in found.items()}
    assert found == {
        0: found[0],
        1: [{"a": "<a2>", "b": "<b2>", "c": "<d>", "d": "<e>"}, {"a": "<a>", "b": "<b>", "c": "<d>", "d": "<e>"}],
        2: [{"a": "<a2>", "c": "<a2>"}, {"a": "<a2>", "c": "<a>"}], 4: [{"a": "<a2>", "b": "<b2>"}, {"a": "<a>", "b": "<b>"}]}
    assert len(found[0]) == 2 and {r["s"] for r in found[0]} == {"<n1>", "<n2>"}


def test_simplified_keys_hold_the_number_of_triples(spark):
    unique = P.unique_queries(log_of(spark, ["SELECT * { ?x <p> ?y }", "SELECT * { ?x <p> ?y . ?x <p> ?z }", "SELECT * { ?u <p> ?v . ?w <p> ?v }"]))
    rows = {r.uq_id: (r.n_simple, r.key) for r in G.simplified_key(P.unique_triples(unique)).collect()}
    assert [rows[i][0] for i in range(3)] == [1, 2, 2] and rows[0][1] != rows[1][1] == rows[2][1]


def test_verdicts_are_kept_by_text_over_logs_with_the_same_ids(spark, quads, tmp_path):
    first = ["SELECT * { ?a <p> ?b }", "SELECT * { ?a <none> ?b }", "SELECT * { ?a <p> ?b { SELECT ?b { ?b <q> ?c } } }"]
    second = ["SELECT * { ?a <none> ?b }", "SELECT * { ?a <p> ?b }", "SELECT * { <a> <p> ?c }"]
    path = str(tmp_path / "cache")
    known = spark.createDataFrame([], "text_key string, valid boolean")
    for texts, want in ((first, {0: True, 1: False, 2: None}), (second, {0: False, 1: True, 2: True})):
        unique = P.unique_queries(log_of(spark, texts))
        verdicts = L.validity_incremental(unique, P.unique_triples(unique), quads, known)
        assert {r.uq_id: r.valid for r in verdicts.collect()} == want
        reports.append_validity(verdicts.join(unique, "uq_id").select(L.text_key(F.col("norm_text")).alias("text_key"), "valid"), path)
        known = reports.load_validity(spark, path)
    assert known.count() == 3  # undecided ones are tried again


def test_equal_parts_side_by_side_cost_no_search():
    def triangles(n, order):
        edges = [[3 * order[i] + k, 3 * order[i] + (k + 1) % 3, "e"] for i in range(n) for k in range(3)]
        return '{"g": %s, "e": %s}' % ([1] * (3 * n), str(edges).replace("'", '"'))
    assert canonical_form(triangles(12, list(range(12)))) == canonical_form(triangles(12, list(range(11, -1, -1))))
    assert canonical_form(triangles(4, range(4))) != canonical_form(triangles(3, range(3)))


def test_lines_that_are_no_quads_are_listed(spark):
    lines = spark.createDataFrame([("<s> <p> <o> <g> .",), ("# note",), ("",), ("<s> <p> broken",), ("  ",)], "value string")
    assert [r.value for r in graph.rejected_nquads(lines).collect()] == ["<s> <p> broken"]
    assert graph.parse_nquads(lines).count() == 1


def test_a_ranking_run_keeps_verdicts(spark, quads, tmp_path):
    log = log_of(spark, ["SELECT * { ?a <p> ?b }", "SELECT ?x { ?x <p> ?y }", "ASK { <a> <p> <b> }", "SELECT * { ?a <none> ?b }"])
    out = runs.run_pattern_ranking(log, quads, str(tmp_path), n=3, top=2)
    assert out["selected"].filter("func = 'frequency'").count() == 3
    assert reports.load_validity(spark, str(tmp_path / "validity")).count() == 4
