import datetime
import gzip

from pyspark.sql import functions as F

from quadlens.operators import decompose as C
from quadlens.plans import runs
from quadlens.sources import graph, logs, reports

TS = datetime.datetime(2024, 5, 1, 12, 0, 0)


def test_access_log_csv(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text('url,agent,domain,@timestamp\n"/sparql?query=ASK%7B%7D",bot,d.org,2024-05-01 12:00:00\n')
    row = logs.read_access_log(spark, str(path)).first()
    assert (row.url, row.domain, row.agent, row.ts) == ("/sparql?query=ASK%7B%7D", "d.org", "bot", TS)


def test_gzip_tsv_takes_the_first_column_and_is_spread(spark, tmp_path):
    path = tmp_path / "log.tsv.gz"
    with gzip.open(path, "wt") as f:
        f.write("anonymizedQuery\tother\n" + "".join(f'ASK%20"{i}\tx\n' for i in range(50)))
    df = logs.read_query_tsv(spark, str(path), 4)
    assert df.rdd.getNumPartitions() == 4
    assert sorted(r.raw for r in df.collect()) == sorted(f'ASK%20"{i}' for i in range(50))


def test_delimited_queries_round_trip(spark, tmp_path):
    texts = ["SELECT ?x\nWHERE { ?x ?p ?o }", "ASK { }", "# note\nASK {}"]
    path = str(tmp_path / "q.rq")
    logs.write_delimited_queries(spark.createDataFrame([(t,) for t in texts], "query_text string"), path)
    assert sorted(r.query_text for r in logs.read_delimited_queries(spark, path).collect()) == sorted(texts)


def test_clean_csv_round_trip_with_quotes_and_newlines(spark, tmp_path):
    rows = [('SELECT "a,b"\n{ ?x ?p "q""" }', "d", "a", TS), ("\\ASK \\\"x\\\"", "d", "a", TS)]
    path = str(tmp_path / "clean.csv")
    logs.write_clean_csv(spark.createDataFrame(rows, logs.CLEAN_LOG_SCHEMA), path)
    assert sorted(tuple(r) for r in logs.read_clean_csv(spark, path).collect()) == sorted(rows)


def test_statement_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'SELECT ?x { ?x <p> "a" . <s> ?q ?x }')], "qid long, query_text string")
    path = str(tmp_path / "st.json")
    logs.write_statement_json(C.statement_rows(C.triple_patterns(df)), path)
    assert [tuple(r) for r in logs.read_statement_json(spark, path).orderBy("pos").collect()] == [
        (1, 0, None, "p", "a"), (1, 1, "s", None, None)]


def test_nquads_round_trip(spark, tmp_path):
    rows = [("http://s", "http://p", 'a "b" \\ \n c', "literal", "http://t", None, "http://g"),
            ("_:b1", "http://p", "x", "literal", None, "en-GB", "http://g"), ("http://s", "http://p", "_:b2", "blank", None, None, None),
            ("http://s", "http://p", "http://o", "uri", None, None, "http://g")]
    quads = spark.createDataFrame(rows, "s string, p string, o string, o_kind string, datatype string, lang string, g string")
    path = str(tmp_path / "q.nq")
    graph.nquad_lines(quads).write.text(path)
    got = graph.read_nquads(spark, path).withColumn("o", F.when(F.col("o_kind") == "blank", F.concat(F.lit("_:"), "o"))
                                                    .otherwise(F.col("o")))
    assert sorted(map(str, got.collect())) == sorted(map(str, quads.collect()))


def test_a_folder_of_gzip_logs_becomes_a_query_table(spark, tmp_path):
    for k in (1, 2):
        with gzip.open(tmp_path / f"log{k}.tsv.gz", "wt") as f:
            f.write("anonymizedQuery\tother\nASK%20%7B%7D\tx\n" + f"SELECT+%2A+%7B+%3Fs+%3Fp+{k}+%7D\tx\n")
    raw = logs.read_query_tsv(spark, str(tmp_path), 3)
    rows = logs.query_table(raw).collect()
    assert raw.rdd.getNumPartitions() == 3
    assert sorted(r.query_text for r in rows) == ["ASK {}", "ASK {}", "SELECT * { ?s ?p 1 }", "SELECT * { ?s ?p 2 }"]
    assert len({r.qid for r in rows}) == 3


def test_cleaning_and_statistics_runs(spark, tmp_path):
    hits = spark.createDataFrame([("/sparql?query=SELECT+%2A+%7B+%3Fs+%3Cp%3E+%3Fo+%7D", "d.org", "bot", TS), ("/about", "d.org", "bot", TS)],
                                 "url string, domain string, agent string, ts timestamp")
    assert runs.run_cleaning(hits, str(tmp_path)).count() > 0
    log = spark.createDataFrame([(1, "SELECT * { ?s <p> ?o }"), (2, "ASK { <s> <q> ?o }")], "qid long, query_text string")
    quads = spark.createDataFrame([("s", "p", "o", "uri", None, None, "g")], "s string, p string, o string, o_kind string, datatype string, lang string, g string")
    reports_ = runs.run_statistics(log, quads, str(tmp_path))
    assert {r.term for r in reports_["predicates"].collect()} <= {"p", "q"} and reports_["vocabulary"].count() > 0
    assert runs.run_summary(quads, str(tmp_path), "http://d").count() >= 0
    assert spark.read.text(str(tmp_path / "metadata.nt")).count() >= 0


def test_reports_and_validity_cache(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", 3)], "term string, n long")
    reports.write_ranked_report(df, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first()[0] == "a\\nb & 3"
    path = str(tmp_path / "valid")
    for rows in ([("a", True), ("b", None)], [("b", False)]):
        reports.append_validity(spark.createDataFrame(rows, "text_key string, valid boolean"), path)
    assert {tuple(r) for r in reports.load_validity(spark, path).collect()} == {("a", True), ("b", False)}


def test_isomorphism_run(spark, tmp_path):
    texts = ["SELECT * { ?a <p> ?b . ?b <p> ?c }", "SELECT * { ?y <q> ?z . ?x <q> ?y }", "ASK { ?a <p> ?b . ?a <p> ?c }", "ASK {"]
    log = spark.createDataFrame(list(enumerate(texts)), "qid long, query_text string")
    out = runs.run_isomorphism(log, str(tmp_path), threshold=1)
    assert [r.n for r in out["clusters"].collect()] == [2]
    assert tuple(out["failures"].first()) == (3, 1)
