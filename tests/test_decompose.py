import pytest

from checks.catalog import TEMPLATES, full
from checks.oracle import split_triple, term
from quadlens.operators import decompose as C
from quadlens.operators import patterns as P

CONSTANTS = {"$CU": "<http://c/1>", "$NA": "<http://n/2>", "$OK": "<http://o/3>", "$ST": "F", "$N3": "1", "$N5": "2",
             "$N7": "4", "$BS": "\\", "$NL": "\n"}


def fill(text):
    for mark, value in CONSTANTS.items():
        text = text.replace(mark, value)
    return text


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame([(i, fill(full(t.text))) for i, t in enumerate(TEMPLATES)], "qid long, query_text string")


def test_triples_of_every_template(log):
    got = {}
    for r in C.flat_triples(C.triple_patterns(log)).collect():
        got.setdefault(r.qid, []).append((r.pos, r.bgp_id, r.ctx, r.s, r.p, r.o))
    for i, t in enumerate(TEMPLATES):
        want = []
        for pos, line in enumerate(t.triples):
            bgp, ctx, *spo = split_triple(line)
            want.append((pos, int(bgp), ctx, *(fill(term(x)[1]).strip("<>") for x in spo)))
        if i == 20:  # its nation comes from a prefixed name
            want = [w[:5] + ("http://ex.org/nation/2",) for w in want]
        assert sorted(got.get(i, [])) == want, t.text


def test_malformed_queries_are_kept_and_flagged(log):
    rows = {r.qid: (r.is_ok, r.n_triples) for r in C.parse_or_keep(log).collect()}
    assert len(rows) == len(TEMPLATES)
    for i, t in enumerate(TEMPLATES):
        assert rows[i] == (t.ok, len(t.triples) if t.ok else None), t.text


@pytest.mark.parametrize("text", [
    "SELECT ?x { ?x <p> }", "SELECT ?x { ?x <p> ?y ?z }", "SELECT ?x { ?x <p> ?y", "SELECT ?x { ?x un:known ?y }",
    'SELECT ?x { ?x <p> "open }', "FOO { ?x <p> ?y }", "SELECT ?x { ( ?x <p> ?y }", "SELECT ?x { } } {"])
def test_not_well_formed(spark, text):
    df = spark.createDataFrame([(1, text)], "qid long, query_text string")
    assert not C.parse_or_keep(df).first().is_ok


def test_traversal_rules(spark):
    texts = [
        ("SELECT * { ?a <p>/<q> ?b ; <r> ?c . ?d ^<p> ?e . ?f <p>* ?g }", [("a", "r", "c")]),
        ("SELECT * { [ <p> ?x ; <q> [ <r> ?y ] ] <s> ?z }", [("anon3", "p", "x"), ("anon3", "q", "anon8"),
                                                            ("anon8", "r", "y"), ("anon3", "s", "z")]),
        ("SELECT * { ?a <p> ?b FILTER ( ?b > 3 && EXISTS { ?b <q> ?c } ) ?b <r> ?d }", [("a", "p", "b"), ("b", "r", "d")]),
        ("SELECT (MAX(?b) AS ?m) ?a ?b ?c { ?a <p> true } ORDER BY ?a ?b ?c", [("a", "p", "true")]),
        ("ASK { VALUES ?a { <x> <y> <z> } ?a <p> 1, 2 ; . }", [("a", "p", "1"), ("a", "p", "2")]),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "qid long, query_text string")
    got = {}
    for r in C.flat_triples(C.triple_patterns(df)).orderBy("qid", "pos").collect():
        got.setdefault(r.qid, []).append((r.s, r.p, r.o))
    for i, (text, want) in enumerate(texts):
        assert sorted(got.get(i, [])) == sorted(want), text


def test_patterns_ignore_names_and_layout(spark):
    rows = [(1, "SELECT ?s { ?s a <C> ; <p> <x> } LIMIT 5"), (2, "select $t\n{ ?t a <C> ;\n <p> <y> }\nlimit 100"),
            (3, "SELECT ?s { ?s a <D> ; <p> <x> } LIMIT 5")]
    df = spark.createDataFrame(rows, "qid long, query_text string")
    got = {r.uq_id: r.pattern_id for r in P.generalise(P.unique_queries(df)).collect()}
    assert got[1] == got[2] != got[3]


def test_one_query_holding_most_of_the_log(spark):
    hot = spark.range(3000).selectExpr("id as qid", "'SELECT ?s { ?s <p> <o> }' as query_text")
    rest = spark.range(1500).selectExpr("id + 3000 as qid", "concat('SELECT ?s { ?s <p> <', id, '> }') as query_text")
    unique = P.unique_queries(hot.union(rest))
    assert unique.count() == 1501
    stats = P.pattern_statistics(P.generalise(unique)).collect()
    assert [(r.n_unique, r.n_log) for r in stats] == [(1501, 4500)]


def test_a_repeated_text_is_tokenised_once(spark):
    # the tokeniser ran when the distinct texts were written, so no row of the log meets it again
    df = spark.createDataFrame([(1, "SELECT ?x { ?x a <c> BIND(1 AS ?y) }"), (2, "SELECT ?x { ?x a <c> BIND(1 AS ?y) }"), (3, None), (4, "nothing")],
                               "qid long, query_text string")
    for out in (C.iri_mentions(df), C.bind_vars(df), C.role_terms(C.triple_patterns(df)), C.parse_or_keep(df)):
        assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, C.bind_vars(df).collect())) == [(1, "y"), (2, "y")]
    assert sorted(map(tuple, C.iri_mentions(df).collect())) == [(q, i, "triple", 1) for q in (1, 2) for i in ("c", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type")]
    assert sorted((r.qid, r.is_ok) for r in C.parse_or_keep(df).collect()) == [(1, True), (2, True), (3, False), (4, False)]
