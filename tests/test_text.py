from pyspark.sql import functions as F

from quadlens.functions import text as X


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


def test_decoding_survives_bad_escapes_and_bytes(spark):
    assert one(spark, X.unquote_plus, "a+b%20c%zz%") == "a b c%zz%"
    assert one(spark, X.repair_and_decode, "x%3Fy%2") == "x?y%2"
    assert one(spark, X.unquote_plus, "%E9x") == "�x"


def test_query_param_is_the_text_after_the_first_mark(spark):
    assert one(spark, X.extract_query_param, "/sparql?query=a&query=b") == "a&query=b"
    assert one(spark, X.extract_query_param, "/about") == "/about"


def test_layout_case_comments_and_prefixes_do_not_matter(spark):
    same = [
        "SELECT ?x WHERE { ?x <http://e/p> <http://e/o> . }",
        "select ?x\n{ ?x <http://e/p> # note } \n <http://e/o> }",
        "PREFIX e: <http://e/> SELECT $x WHERE{?x e:p e:o.}",
        "BASE <http://e/> SELECT ?x WHERE { ?x <p> <o> }",
    ]
    assert len({one(spark, X.normalise_query, q) for q in same}) == 1


def test_literals_keep_their_text(spark):
    q = 'SELECT ?x { ?x <p> "select { # where" ; <q> \'a\' }'
    assert one(spark, X.normalise_query, q) == 'SELECT ?x { ?x <p> "select { # where" ; <q> \'a\' }'


def test_very_long_literal_is_one_token(spark):
    body = 'a\\"' * 40_000
    assert one(spark, lambda c: F.size(X.raw_tokens(c)), f'SELECT ?x {{ ?x <p> "{body}" }}') == 7


def test_strip_limit_offset_leaves_literals_alone(spark):
    q = 'SELECT ?x { ?x <p> "LIMIT 5" } LIMIT 10 OFFSET 3'
    assert one(spark, X.strip_limit_offset, q) == 'SELECT ?x { ?x <p> "LIMIT 5" }'


def test_query_form(spark):
    assert one(spark, X.query_form, "# c\nPREFIX a: <b> BASE <c> ask {}") == "ASK"
    assert one(spark, X.query_form, "INSERT DATA {}") == "other"


def test_term_struct(spark):
    assert tuple(one(spark, X.term_struct, '"a\\n\\"b\\""@en')) == (
        "literal", 'a\n"b"', "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString", "en")
    assert tuple(one(spark, X.term_struct, "'5'^^<t>")) == ("literal", "5", "t", None)
    assert tuple(one(spark, X.term_struct, "-1.5"))[2].endswith("decimal")
