"""Query templates of the fixture log, each with its answers worked out by hand.

The DuckDB oracles are built from these answers, so they share no logic with the Spark operators.

Short forms inside the texts: ``~`` is ``http://ex.org/``, ``LABEL`` / ``TYPE`` / ``XSD`` inside angle
brackets are the usual vocabularies, and ``$CU $NA $OK $ST $N3 $N5 $N7`` are filled in from the order row.
``$BS`` is a backslash and ``$NL`` a newline (the two engines disagree on escapes in string literals).
"""

from __future__ import annotations

from dataclasses import dataclass, field

EX = "http://ex.org/"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
DCT_TITLE = "http://purl.org/dc/terms/title"
XSD = "http://www.w3.org/2001/XMLSchema#"
LANG_STRING = "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"


def full(text: str) -> str:
    return (text.replace("<LABEL>", f"<{RDFS_LABEL}>").replace("<TYPE>", f"<{RDF_TYPE}>")
            .replace("<XSD:", f"<{XSD}").replace("<~", f"<{EX}"))


@dataclass
class Template:
    text: str
    norm: str
    pattern: str
    triples: list[str] = field(default_factory=list)  # "bgp ctx subject predicate object"
    ok: bool = True
    form: str = "SELECT"
    lim: str | None = None  # LIMIT and OFFSET as written
    off: str | None = None
    binds: list[str] = field(default_factory=list)
    aggs: list[str] = field(default_factory=list)  # "agg alias n"
    filters: list[str] = field(default_factory=list)  # equality constants
    values: list[str] = field(default_factory=list)  # "row var term"
    filter_iris: list[str] = field(default_factory=list)
    levels: list[int] = field(default_factory=lambda: [0])
    ops: dict[str, int] = field(default_factory=dict)
    mods: str = ""  # flags of C15: "distinct reduced slice order group having" + counts "proj=..,order=..,group=..,agg=.."


T = Template
TEMPLATES: list[Template] = [
    T("SELECT ?n WHERE { $CU <~p/nation> ?n . }",
      "SELECT ?n { $CU <~p/nation> ?n }",
      "SELECT ?variable1 { ?ent1 <~p/nation> ?variable1 }",
      ["0 required $CU <~p/nation> ?n"], mods="proj=1"),
    T("select  *  where { ?s a <~class/Customer> ; <~p/nation> $NA . } LIMIT 1$N3",
      "SELECT * { ?s <TYPE> <~class/Customer> ; <~p/nation> $NA } LIMIT 1$N3",
      "SELECT * { ?variable1 <TYPE> <~class/Customer> ; <~p/nation> ?ent1 } LIMIT 1",
      ["0 required ?s <TYPE> <~class/Customer>", "0 required ?s <~p/nation> $NA"],
      lim="1$N3", ops={"slice": 1}, mods="slice proj=0"),
    T("SELECT ?o ?l WHERE { ?o <~p/customer> $CU . OPTIONAL { ?o <LABEL> ?l } }",
      "SELECT ?o ?l { ?o <~p/customer> $CU . OPTIONAL { ?o <LABEL> ?l } }",
      "SELECT ?variable1 ?variable2 { ?variable1 <~p/customer> ?ent1 . OPTIONAL { ?variable1 <LABEL> ?variable2 } }",
      ["0 required ?o <~p/customer> $CU", "1 optional ?o <LABEL> ?l"], ops={"leftjoin": 1}, mods="proj=2"),
    T("SELECT ?a WHERE { { ?a <~p/nation> $NA } UNION { ?b <~p/customer> ?a } }",
      "SELECT ?a { { ?a <~p/nation> $NA } UNION { ?b <~p/customer> ?a } }",
      "SELECT ?variable1 { { ?variable1 <~p/nation> ?ent1 } UNION { ?variable2 <~p/customer> ?variable1 } }",
      ["0 union ?a <~p/nation> $NA", "1 union ?b <~p/customer> ?a"], ops={"union": 1}, mods="proj=1"),
    T('SELECT ?s WHERE { ?s <LABEL> ?l . FILTER ( LANG ( ?l ) = "en" ) }',
      'SELECT ?s { ?s <LABEL> ?l . FILTER ( LANG ( ?l ) = "en" ) }',
      'SELECT ?variable1 { ?variable1 <LABEL> ?variable2 . FILTER ( LANG ( ?variable2 ) = "en" ) }',
      ["0 required ?s <LABEL> ?l"], filters=['"en"'], ops={"filter": 1}, mods="proj=1"),
    T("SELECT (COUNT(?o) AS ?x) WHERE { ?o <~p/customer> ?c . ?c <~p/nation> $NA . } GROUP BY ?c",
      "SELECT ( COUNT ( ?o ) AS ?x ) { ?o <~p/customer> ?c . ?c <~p/nation> $NA } GROUP BY ?c",
      "SELECT ( COUNT ( ?variable1 ) AS ?count1 ) { ?variable1 <~p/customer> ?variable2 . "
      "?variable2 <~p/nation> ?ent1 } GROUP BY ?variable2",
      ["0 required ?o <~p/customer> ?c", "0 required ?c <~p/nation> $NA"],
      aggs=["count x 1"], ops={"group": 1}, mods="group proj=1,group=1,agg=1"),
    T('ASK WHERE { $OK <~p/status> "$ST" }',
      'ASK { $OK <~p/status> "$ST" }',
      "ASK { ?ent1 <~p/status> ?str1 }",
      ['0 required $OK <~p/status> "$ST"'], form="ASK", levels=[], mods="proj=0"),
    T("SELECT ?x WHERE { ?x ( <~p/nation> / <~p/region> ) ?r . ?x ?p $NA . } LIMIT 1000 OFFSET 20",
      "SELECT ?x { ?x ( <~p/nation> / <~p/region> ) ?r . ?x ?p $NA } LIMIT 1000 OFFSET 20",
      "SELECT ?variable1 { ?variable1 ( <~p/nation> / <~p/region> ) ?r . ?variable1 ?predicate1 ?ent1 } "
      "LIMIT 1 OFFSET 1",
      ["0 required ?x ?p $NA"], lim="1000", off="20", ops={"path": 1, "slice": 1}, mods="slice proj=1"),
    T("SELECT ?x WHERE { ?x ?p ", "", "", ok=False),
    T('SELECT ?v ?vLabel WHERE { ?v <~p/nation> $NA . SERVICE <~svc#label> '
      '{ <~svc#param> <~svc#language> "en" . } }',
      'SELECT ?v ?vLabel { ?v <~p/nation> $NA . SERVICE <~svc#label> { <~svc#param> <~svc#language> "en" } }',
      "SELECT ?variable1 ?vLabel { ?variable1 <~p/nation> ?ent1 . SERVICE <~svc#label> "
      "{ ?ent2 <~svc#language> ?str1 } }",
      ["0 required ?v <~p/nation> $NA", '1 service <~svc#param> <~svc#language> "en"'],
      ops={"service": 1}, mods="proj=2"),
    T('SELECT ?c ?y WHERE { ?c <~p/balance> "$N7"^^<XSD:integer> . BIND ( STR ( ?c ) AS ?y ) }',
      'SELECT ?c ?y { ?c <~p/balance> "$N7"^^<XSD:integer> . BIND ( STR ( ?c ) AS ?y ) }',
      "SELECT ?variable1 ?bind1 { ?variable1 <~p/balance> ?str1 . BIND ( STR ( ?variable1 ) AS ?bind1 ) }",
      ['0 required ?c <~p/balance> "$N7"^^<XSD:integer>'], binds=["y"], ops={"extend": 1}, mods="proj=2"),
    T("CONSTRUCT { ?s <~p/in> ?r } WHERE { ?s <~p/nation> ?n . ?n <~p/region> ?r }",
      "CONSTRUCT { ?s <~p/in> ?r } { ?s <~p/nation> ?n . ?n <~p/region> ?r }",
      "CONSTRUCT { ?variable1 <~p/in> ?variable2 } { ?variable1 <~p/nation> ?variable3 . "
      "?variable3 <~p/region> ?variable2 }",
      ["0 required ?s <~p/nation> ?n", "0 required ?n <~p/region> ?r"], form="CONSTRUCT", levels=[], mods="proj=0"),
    # 12: further shapes, one residue class of the order key each
    T("DESCRIBE $CU", "DESCRIBE $CU", "DESCRIBE $CU", form="DESCRIBE", levels=[], mods="proj=0"),
    T("SELECT ?c WHERE { VALUES ( ?n ?k ) { ( $NA 1 ) ( <~nation/7> UNDEF ) } ?c <~p/nation> ?n . }",
      "SELECT ?c { VALUES ( ?n ?k ) { ( $NA 1 ) ( <~nation/7> UNDEF ) } ?c <~p/nation> ?n }",
      "SELECT ?variable1 { VALUES ( ?variable2 ?k ) { ( $NA 1 ) ( <~nation/7> UNDEF ) } "
      "?variable1 <~p/nation> ?variable2 }",
      ["0 required ?c <~p/nation> ?n"],
      values=["1 n $NA", "1 k 1", "2 n <~nation/7>", "2 k UNDEF"], ops={"table": 1}, mods="proj=1"),
    T("SELECT ?c WHERE { ?c a <~class/Customer> . MINUS { ?c <~p/nation> $NA . } }",
      "SELECT ?c { ?c <TYPE> <~class/Customer> . MINUS { ?c <~p/nation> $NA } }",
      "SELECT ?variable1 { ?variable1 <TYPE> <~class/Customer> . MINUS { ?variable1 <~p/nation> ?ent1 } }",
      ["0 required ?c <TYPE> <~class/Customer>", "1 minus ?c <~p/nation> $NA"], ops={"minus": 1}, mods="proj=1"),
    T('SELECT ?o WHERE { ?o <~p/customer> $CU . FILTER EXISTS { ?o <~p/status> "F" } }',
      'SELECT ?o { ?o <~p/customer> $CU . FILTER EXISTS { ?o <~p/status> "F" } }',
      'SELECT ?variable1 { ?variable1 <~p/customer> ?ent1 . FILTER EXISTS { ?variable1 <~p/status> "F" } }',
      ["0 required ?o <~p/customer> $CU"], ops={"filter": 1, "exists": 1}, mods="proj=1"),
    T('SELECT ?o WHERE { ?o <~p/customer> $CU . FILTER NOT EXISTS { ?o <~p/status> "P" } ?o a <~class/Order> }',
      'SELECT ?o { ?o <~p/customer> $CU . FILTER NOT EXISTS { ?o <~p/status> "P" } ?o <TYPE> <~class/Order> }',
      'SELECT ?variable1 { ?variable1 <~p/customer> ?ent1 . FILTER NOT EXISTS { ?variable1 <~p/status> "P" } '
      "?variable1 <TYPE> <~class/Order> }",
      ["0 required ?o <~p/customer> $CU", "0 required ?o <TYPE> <~class/Order>"],
      ops={"filter": 1, "notexists": 1}, mods="proj=1"),
    T("SELECT ?c (COUNT(DISTINCT ?o) AS ?n) (MAX(?o) AS ?m) WHERE { ?o <~p/customer> ?c } GROUP BY ?c "
      "HAVING (COUNT(DISTINCT ?o) > $N7) ORDER BY DESC(?n) LIMIT 5",
      "SELECT ?c ( COUNT ( DISTINCT ?o ) AS ?n ) ( MAX ( ?o ) AS ?m ) { ?o <~p/customer> ?c } GROUP BY ?c "
      "HAVING ( COUNT ( DISTINCT ?o ) > $N7 ) ORDER BY DESC ( ?n ) LIMIT 5",
      "SELECT ?variable1 ( COUNT ( DISTINCT ?variable2 ) AS ?count1 ) ( MAX ( ?variable2 ) AS ?max1 ) "
      "{ ?variable2 <~p/customer> ?variable1 } GROUP BY ?variable1 "
      "HAVING ( COUNT ( DISTINCT ?variable2 ) > $N7 ) ORDER BY DESC ( ?count1 ) LIMIT 1",
      ["0 required ?o <~p/customer> ?c"], lim="5", aggs=["count n 1", "max m 1"],
      ops={"group": 1, "having": 1, "order": 1, "slice": 1},
      mods="slice order group having proj=3,order=1,group=1,agg=3"),
    T('SELECT ?c (GROUP_CONCAT(?s ; SEPARATOR = ";") AS ?all) WHERE { ?o <~p/customer> ?c ; <~p/status> ?s . } '
      "GROUP BY ?c",
      'SELECT ?c ( GROUP_CONCAT ( ?s ; SEPARATOR = ";" ) AS ?all ) { ?o <~p/customer> ?c ; <~p/status> ?s } '
      "GROUP BY ?c",
      'SELECT ?variable1 ( GROUP_CONCAT ( ?variable2 ; SEPARATOR = ";" ) AS ?group_concat1 ) '
      "{ ?variable3 <~p/customer> ?variable1 ; <~p/status> ?variable2 } GROUP BY ?variable1",
      ["0 required ?o <~p/customer> ?c", "0 required ?o <~p/status> ?s"],
      aggs=["group_concat all 1"], ops={"group": 1}, mods="group proj=2,group=1,agg=1"),
    T("SELECT ?c ?n WHERE { ?c <~p/nation> $NA . { SELECT ?c ?n WHERE { ?c <LABEL> ?n } LIMIT 3 } }",
      "SELECT ?c ?n { ?c <~p/nation> $NA . { SELECT ?c ?n { ?c <LABEL> ?n } LIMIT 3 } }",
      "SELECT ?variable1 ?variable2 { ?variable1 <~p/nation> ?ent1 . "
      "{ SELECT ?variable1 ?variable2 { ?variable1 <LABEL> ?variable2 } LIMIT 1 } }",
      ["0 required ?c <~p/nation> $NA", "1 subselect ?c <LABEL> ?n"], lim="3", levels=[0, 1],
      ops={"slice": 1, "subselect": 1}, mods="proj=2"),
    T("PREFIX p: <~p/> PREFIX : <~nation/> SELECT ?c WHERE { ?c p:nation :$N5 . }",
      "SELECT ?c { ?c <~p/nation> $NA }",
      "SELECT ?variable1 { ?variable1 <~p/nation> ?ent1 }",
      ["0 required ?c <~p/nation> $NA"], mods="proj=1"),
    T("SELECT ?r WHERE { _:b <~p/customer> $CU . _:b <~p/status> ?r }",
      "SELECT ?r { _:b <~p/customer> $CU . _:b <~p/status> ?r }",
      "SELECT ?variable1 { ?ent1 <~p/customer> ?ent2 . ?ent1 <~p/status> ?variable1 }",
      ["0 required _:b <~p/customer> $CU", "0 required _:b <~p/status> ?r"], mods="proj=1"),
    T("SELECT ?x WHERE { ?o <~p/customer> [ <~p/nation> $NA ; <LABEL> ?x ] . }",
      "SELECT ?x { ?o <~p/customer> [ <~p/nation> $NA ; <LABEL> ?x ] }",
      "SELECT ?variable1 { ?variable2 <~p/customer> [ <~p/nation> ?ent1 ; <LABEL> ?variable1 ] }",
      ["0 required ?o <~p/customer> _:anon5", "0 required _:anon5 <~p/nation> $NA",
       "0 required _:anon5 <LABEL> ?x"], mods="proj=1"),
    T('SELECT ?c WHERE { ?c <~p/tag> <~t/1> , <~t/2> , "$N7" . }',
      'SELECT ?c { ?c <~p/tag> <~t/1> , <~t/2> , "$N7" }',
      "SELECT ?variable1 { ?variable1 <~p/tag> ?ent1 , ?ent2 , ?str1 }",
      ["0 required ?c <~p/tag> <~t/1>", "0 required ?c <~p/tag> <~t/2>", '0 required ?c <~p/tag> "$N7"'],
      mods="proj=1"),
    T('SELECT ?c WHERE { # a { comment ; .$NL ?c <LABEL> "Customer#00000000$N7"@en . }',
      'SELECT ?c { ?c <LABEL> "Customer#00000000$N7"@en }',
      "SELECT ?variable1 { ?variable1 <LABEL> ?str1 }",
      ['0 required ?c <LABEL> "Customer#00000000$N7"@en'], mods="proj=1"),
    T('SELECT ?c WHERE { ?c <~p/note> "a { b } . $BS"q$BS" ; $N7" . ?c ?p ?o }',
      'SELECT ?c { ?c <~p/note> "a { b } . $BS"q$BS" ; $N7" . ?c ?p ?o }',
      "SELECT ?variable1 { ?variable1 <~p/note> ?str1 . ?variable1 ?predicate1 ?variable2 }",
      ['0 required ?c <~p/note> "a { b } . $BS"q$BS" ; $N7"', "0 required ?c ?p ?o"], mods="proj=1"),
    T("SELECT ?a WHERE { ?a <~p/customer> ?b . ?a <~p/likes> ?b . }",
      "SELECT ?a { ?a <~p/customer> ?b . ?a <~p/likes> ?b }",
      "SELECT ?variable1 { ?variable1 <~p/customer> ?variable2 . ?variable1 <~p/likes> ?variable2 }",
      ["0 required ?a <~p/customer> ?b", "0 required ?a <~p/likes> ?b"], mods="proj=1"),
    T("SELECT ?a WHERE { ?a <~p/knows> ?a . FILTER ( ?a = $CU ) }",
      "SELECT ?a { ?a <~p/knows> ?a . FILTER ( ?a = $CU ) }",
      "SELECT ?variable1 { ?variable1 <~p/knows> ?variable1 . FILTER ( ?variable1 = $CU ) }",
      ["0 required ?a <~p/knows> ?a"], filters=["$CU"], filter_iris=["$CU"], ops={"filter": 1}, mods="proj=1"),
    T("SELECT * WHERE { ?a <~p/e> ?b . ?b <~p/e> ?c . ?c <~p/e> ?a }",
      "SELECT * { ?a <~p/e> ?b . ?b <~p/e> ?c . ?c <~p/e> ?a }",
      "SELECT * { ?variable1 <~p/e> ?variable2 . ?variable2 <~p/e> ?variable3 . ?variable3 <~p/e> ?variable1 }",
      ["0 required ?a <~p/e> ?b", "0 required ?b <~p/e> ?c", "0 required ?c <~p/e> ?a"], mods="proj=0"),
    T("SELECT * WHERE { ?a <~p/e> ?b . ?a <~p/e> ?c . ?a <~p/e> ?d }",
      "SELECT * { ?a <~p/e> ?b . ?a <~p/e> ?c . ?a <~p/e> ?d }",
      "SELECT * { ?variable1 <~p/e> ?variable2 . ?variable1 <~p/e> ?variable3 . ?variable1 <~p/e> ?variable4 }",
      ["0 required ?a <~p/e> ?b", "0 required ?a <~p/e> ?c", "0 required ?a <~p/e> ?d"], mods="proj=0"),
    T("SELECT * WHERE { ?z <~p/e> ?x . ?y <~p/e> ?z . ?x <~p/e> ?y }",
      "SELECT * { ?z <~p/e> ?x . ?y <~p/e> ?z . ?x <~p/e> ?y }",
      "SELECT * { ?variable1 <~p/e> ?variable2 . ?variable3 <~p/e> ?variable1 . ?variable2 <~p/e> ?variable3 }",
      ["0 required ?z <~p/e> ?x", "0 required ?y <~p/e> ?z", "0 required ?x <~p/e> ?y"], mods="proj=0"),
    T("SELECT * WHERE { $p <~p/f> $q . $r <~p/f> $p . $q <~p/f> $r }",
      "SELECT * { ?p <~p/f> ?q . ?r <~p/f> ?p . ?q <~p/f> ?r }",
      "SELECT * { ?variable1 <~p/f> ?variable2 . ?variable3 <~p/f> ?variable1 . ?variable2 <~p/f> ?variable3 }",
      ["0 required ?p <~p/f> ?q", "0 required ?r <~p/f> ?p", "0 required ?q <~p/f> ?r"], mods="proj=0"),
    T("", "", "", ok=False, form="other"),
    T("SELECT ?s ?g WHERE { GRAPH ?g { ?s <~p/region> <~region/$N5> } } ORDER BY DESC(?s) ?g",
      "SELECT ?s ?g { GRAPH ?g { ?s <~p/region> <~region/$N5> } } ORDER BY DESC ( ?s ) ?g",
      "SELECT ?variable1 ?g { GRAPH ?g { ?variable1 <~p/region> ?ent1 } } ORDER BY DESC ( ?variable1 ) ?g",
      ["0 graph ?s <~p/region> <~region/$N5>"], ops={"graph": 1, "order": 1}, mods="order proj=2,order=2"),
    T('SELECT DISTINCT ?type WHERE { ?s <TYPE> ?type ; <~p/nation> $NA FILTER regex ( STR ( ?s ) , "customer" ) '
      "?s <LABEL> ?l OPTIONAL { ?s <~p/balance> 12.5 } }",
      'SELECT DISTINCT ?type { ?s <TYPE> ?type ; <~p/nation> $NA FILTER REGEX ( STR ( ?s ) , "customer" ) '
      "?s <LABEL> ?l OPTIONAL { ?s <~p/balance> 12.5 } }",
      'SELECT DISTINCT ?variable1 { ?variable2 <TYPE> ?variable1 ; <~p/nation> ?ent1 '
      'FILTER REGEX ( STR ( ?variable2 ) , "customer" ) ?variable2 <LABEL> ?variable3 '
      "OPTIONAL { ?variable2 <~p/balance> ?str1 } }",
      ["0 required ?s <TYPE> ?type", "0 required ?s <~p/nation> $NA", "0 required ?s <LABEL> ?l",
       "1 optional ?s <~p/balance> 12.5"],
      ops={"distinct": 1, "filter": 1, "leftjoin": 1}, mods="distinct proj=1"),
    T("SELECT ?x WHERE { ?x <~p/nation> $NA . } }", "", "", ok=False),
]
