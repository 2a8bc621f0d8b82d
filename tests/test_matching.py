import itertools
import random

from pyspark.sql import functions as F

from quadlens.operators import lookup as L
from quadlens.operators import matching as M
from quadlens.operators import patterns as P


def brute(triples, graph, nodes):
    names = sorted({x for t in triples for x in t if x.startswith("?")})
    for combo in itertools.product(nodes, repeat=len(names)):
        env = dict(zip(names, combo))
        if all(tuple(env.get(x, x) for x in t) in graph for t in triples):
            yield tuple((n[1:], env[n]) for n in names)


def test_validity_and_bindings_equal_brute_force(spark):
    rng = random.Random(3)
    nodes = [f"<n{i}>" for i in range(5)]
    preds = ["<p>", "<q>"]
    graph = {(rng.choice(nodes), rng.choice(preds), rng.choice(nodes)) for _ in range(9)}
    quads = spark.createDataFrame(
        [(s[1:-1], p[1:-1], o[1:-1], "uri", None, None, "g") for s, p, o in sorted(graph)],
        "s string, p string, o string, o_kind string, datatype string, lang string, g string")
    queries = []
    for i in range(24):
        names = ["?a", "?b", "?c"]
        ts = [(rng.choice(names + nodes[:1]), rng.choice(preds), rng.choice(names + nodes[:2])) for _ in range(rng.randint(1, 3))]
        queries.append((i, ts))
    log = spark.createDataFrame(
        [(i, "SELECT * { " + " . ".join(" ".join(t) for t in ts) + " }") for i, ts in queries], "qid long, query_text string")
    unique = P.unique_queries(log)
    triples = P.unique_triples(unique)
    valid = {r.uq_id: r.valid for r in L.validity(unique, triples, quads).collect()}
    answers = {}
    for r in L.bindings(unique, triples, quads).distinct().collect():
        answers.setdefault(r.uq_id, set()).add(tuple((v["var"], v["val"]) for v in r.vals))
    by_id = dict(queries)
    for uq, verdict in valid.items():
        want = set(brute(by_id[uq], graph, nodes))
        assert verdict == bool(want), by_id[uq]
        assert answers.get(uq, set()) == want, by_id[uq]


def test_undecided_queries_are_null_and_decided_ones_right(spark):
    quads = spark.createDataFrame([("a", "p", "b", "uri", None, None, "g")],
                                  "s string, p string, o string, o_kind string, datatype string, lang string, g string")
    texts = {1: ("SELECT * { ?a <p> ?b FILTER ( STRLEN ( ?a ) = 3 ) }", None), 2: ("SELECT * { ?a ?p ?b . ?b ?q ?c }", False),
             3: ("SELECT * { ?a ?p ?b }", True), 4: ("SELECT (COUNT(*) AS ?n) { ?a <none> ?b }", True),
             5: ("SELECT * { { ?a <none> ?b } UNION { <a> <p> ?b } }", True), 6: ("ASK { <a> <p> <c> }", False),
             7: ("SELECT * { ?a <p> ?b OPTIONAL { ?b <none> ?c } }", True), 8: ("SELECT * { ?a <p> ?a }", False)}
    log = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "qid long, query_text string")
    unique = P.unique_queries(log)
    got = {r.uq_id: r.valid for r in L.validity(unique, P.unique_triples(unique), quads).collect()}
    assert got == {i: v for i, (_, v) in texts.items()}


def test_closure_of_a_chain_with_a_loop(spark):
    edges = [(f"<n{i}>", "<p>", f"<n{i + 1}>", "g") for i in range(9)] + [("<n9>", "<p>", "<n5>", "g")]
    quads = spark.createDataFrame(edges, "s string, p string, o string, g string")
    got = {(r.x, r.y) for r in M.path_closure(quads, "<p>").collect()}
    step = {(s, o) for s, _, o, _ in edges}
    want = set(step)
    while True:
        more = want | {(a, d) for a, b in want for c, d in step if b == c}
        if more == want:
            break
        want = more
    assert got == want


def test_groups_and_condensed_closure_give_the_closure(spark):
    """Two cycles joined by a way, one of them with a chord, a tail, a loop on one node and a cycle of its own."""
    links = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 6), (6, 4), (5, 4), (6, 7), (7, 8), (8, 8), (10, 11), (11, 10), (0, 1)]
    quads = spark.createDataFrame([(f"<n{a:02}>", "<p>", f"<n{b:02}>", "g") for a, b in links], "s string, p string, o string, g string")
    groups = M.path_groups(quads, "<p>")
    of = {r.node: r.grp for r in groups.collect()}
    right = {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 4, 7: 7, 8: 8, 10: 10, 11: 10}
    assert of == {f"<n{k:02}>": f"<n{v:02}>" for k, v in right.items()} and groups.count() == len(of)
    pairs = {(r.x, r.y) for r in M.condensed_closure(quads, "<p>", groups).collect()}
    assert {(a, b) for a in of for b in of if (of[a], of[b]) in pairs} == {(r.x, r.y) for r in M.path_closure(quads, "<p>").collect()}
    assert M.path_groups(quads, "<none>").count() == 0


def test_closure_from_a_start_and_with_zero_steps(spark):
    edges = [(f"<n{i}>", "<p>", f"<n{i + 1}>", "g") for i in range(6)] + [("<n6>", "<p>", "<n4>", "g"), ("<m>", "<q>", "<n0>", "g")]
    quads = spark.createDataFrame(edges, "s string, p string, o string, g string")
    start = spark.createDataFrame([("<n2>",), ("<m>",)], "x string")

    def pairs(**more):
        return sorted((r.x, r.y) for r in M.path_closure(quads, "<p>", **more).collect())
    assert pairs(start=start) == [("<n2>", f"<n{i}>") for i in (3, 4, 5, 6)]
    assert pairs(start=start, steps=2) == [("<n2>", "<n3>"), ("<n2>", "<n4>")]
    assert pairs(start=start, zero=True, steps=1) == [("<m>", "<m>"), ("<n2>", "<n2>"), ("<n2>", "<n3>")]
    assert sorted(set(pairs(zero=True)) - set(pairs())) == [(f"<n{i}>", f"<n{i}>") for i in range(4)]


def test_label_prefers_title_then_smallest(spark):
    rows = [("a", "http://purl.org/dc/terms/title", "T", "literal"), ("a", "http://www.w3.org/2000/01/rdf-schema#label", "A", "literal"),
            ("b", "http://www.w3.org/2000/01/rdf-schema#label", "z", "literal"),
            ("b", "http://www.w3.org/2000/01/rdf-schema#label", "y", "literal"), ("c", "http://purl.org/dc/terms/title", "x", "uri")]
    quads = spark.createDataFrame(rows, "s string, p string, o string, o_kind string")
    assert {(r.term, r.label) for r in L.labels(quads).collect()} == {("a", "T"), ("b", "y")}
    assert L.labels(quads, spark.createDataFrame([("b",)], "term string")).select(F.count("*")).first()[0] == 1


def test_a_hot_predicate_is_not_where_a_join_starts(spark):
    # a third of the graph says the same of everything; each query also names something rare
    rows = [(f"x{i}", "in", "all") for i in range(4000)] + [(f"x{i}", "code", f"c{i % 2000}") for i in range(4000)]
    quads = spark.createDataFrame([(*r, "uri", None, None, "g") for r in rows], "s string, p string, o string, o_kind string, datatype string, lang string, g string")
    texts = [f"SELECT ?x {{ ?x <in> <all> . ?x <in> ?all . ?x <code> <c{i}> }}" for i in range(300)]
    unique = P.unique_queries(spark.createDataFrame(list(enumerate(texts)), "qid long, query_text string"))
    needed = L.match_units(unique.select(F.col("uq_id").cast("string").alias("unit"), "uq_id"), P.unique_triples(unique))
    keyed = L.restricted(quads, needed)
    sized = M.with_sizes(needed, keyed)
    none = F.array().cast("array<string>")
    patterns = sized.groupBy("unit").agg(F.collect_list(F.struct("pos", *M.ROLES, "n", "subjects", "objects")).alias("todo")).select(
        "unit", "todo", F.array().cast("array<struct<op:string,vars:array<string>,args:array<string>>>").alias("conds"), none.alias("given"),
        F.lit(None).cast("array<string>").alias("terms"), F.array(F.lit("?vx")).alias("keep"), F.lit(None).cast("string").alias("apart"))
    ordered = M.ordered_patterns(patterns)
    assert [r.p for r in ordered.select(F.get("steps", F.lit(0))["p"].alias("p")).distinct().collect()] == ["<code>"]
    assert M.match_all(ordered, keyed).count() == 600


def test_a_hot_key_is_dealt_out_on_both_sides(spark, monkeypatch):
    monkeypatch.setattr(M, "PART", 20)
    a = spark.range(400).select(F.when(F.col("id") < 300, "hot").otherwise(F.col("id").cast("string")).alias("key"), F.col("id").alias("x"))
    b = spark.range(350).select(F.when(F.col("id") < 50, "hot").otherwise(F.col("id").cast("string")).alias("key"), F.col("id").alias("y"))
    of_a, of_b = M.bucket_counts(a), M.bucket_counts(b)
    left, right = M.dealt(a, of_a, of_b, ["x"], ("m", "n")), M.dealt(b, of_b, of_a, ["y"], ("n", "m"))
    got = left.join(right, ["key", "m", "n"]).select("key", "x", "y")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, a.join(b, "key").collect()))
    assert left.groupBy("key", "m", "n").count().agg(F.max("count")).first()[0] <= 60


def test_a_first_try_follows_few_bindings_and_loses_no_answer(spark, monkeypatch):
    # one of 400 has a code, so the first bindings of a pattern need not lead to it
    rows = [(f"x{i}", "in", f"a{i % 7}") for i in range(400)] + [("x77", "code", "c"), ("x78", "code", "d")]
    keyed = spark.createDataFrame([tuple(f"<{x}>" for x in r) + ("<g>",) for r in rows], "s string, p string, o string, g string")
    # unit, place and triple; the sizes that order the triples come from the graph
    own = [("far", 0, "?x", "<in>", "?a"), ("far", 1, "?x", "<code>", "?c"), ("none", 0, "?x", "<in>", "?a"), ("none", 1, "?y", "<code>", "?a"),
           ("near", 0, "?x", "<in>", "<a3>")]
    own = spark.createDataFrame([(*r, None) for r in own], "unit string, pos long, s string, p string, o string, g string")
    conditions = spark.createDataFrame([], "unit string, kind string, grp int, op string, vars array<string>, args array<string>, bound array<string>, open boolean")
    wanted = own.select("unit", F.array().cast("array<string>").alias("keep")).distinct()
    monkeypatch.setattr(M, "PROBE", 2)
    monkeypatch.setattr(M, "SMALL", 0)
    # against the sizes, so that the many bindings come first
    monkeypatch.setattr(M, "with_sizes", lambda triples, _: triples.select("*", F.col("pos").cast("double").alias("n"), F.lit(1.0).alias("subjects"), F.lit(1.0).alias("objects")))
    followed, match_some = [], M.match_some

    def watched(ordered, keyed):
        found, more = match_some(ordered, keyed)
        followed.append((found.count(), more.count()))
        return found, more
    monkeypatch.setattr(M, "match_some", watched)
    assert sorted(r.unit for r in L.with_answer(own, conditions, wanted, keyed).collect()) == ["far", "near"]
    assert followed == [(1, 2)]


def test_closure_of_cycles_hubs_and_chains_makes_each_pair_of_a_tree_once(spark, monkeypatch):
    monkeypatch.setattr(M, "PART", 5)
    tree = [(f"t{i}", f"t{i // 2}") for i in range(1, 64)]  # t0 has no parent, t1 is on most ways
    links = tree + [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d")]
    reach, front = set(links), set(links)
    while front:
        front = {(x, z) for x, y in front for y2, z in links if y == y2} - reach
        reach |= front
    made, old = [], M.linked

    def counted(a, b):
        out = old(a, b)
        made.append(out.count())
        return out
    monkeypatch.setattr(M, "linked", counted)

    def closure(rows):
        quads = spark.createDataFrame([(a, "up", b) for a, b in rows], "s string, p string, o string")
        return [tuple(r) for r in M.path_closure(quads, "up").collect()]
    got = closure(links)
    assert len(got) == len(set(got)) and set(got) == reach
    made.clear()
    # ways of 2 ** k steps are also made in the last step of the round before
    pairs = closure(tree)
    assert sum(made) + len(tree) == len(pairs)
    assert closure([]) == []
