"""Vocabulary IRIs and keyword lists the results depend on."""

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDF_LANG_STRING = "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
DCT_TITLE = "http://purl.org/dc/terms/title"
XSD = "http://www.w3.org/2001/XMLSchema#"
VOID = "http://rdfs.org/ns/void#"
VOID_EXT = "http://ldf.fi/void-ext#"
P31_QUALIFIER = "http://www.wikidata.org/prop/qualifier/P31"

# predicates whose objects are types
TYPE_PREDICATES = (RDF_TYPE, P31_QUALIFIER)

# defaults of the term statistics
NO_TYPE = "no-type"
NO_LANGUAGE = "no-language-tag"

# record separator of query corpora, separator of ranked reports
RECORD_SEPARATOR = "##########"
REPORT_SEPARATOR = " & "

# words that mark spam requests
SPAM_WORDS = ("herbalife",)

# words a request must contain one of
REQUEST_FORMS = ("select", "ask", "construct", "insert")

QUERY_FORMS = ("SELECT", "ASK", "CONSTRUCT", "DESCRIBE")

# words that start a clause and so end the triple statement before them
CLAUSE_WORDS = (
    "SELECT", "ASK", "CONSTRUCT", "DESCRIBE", "FROM", "WHERE", "OPTIONAL", "FILTER", "UNION", "SERVICE", "GRAPH",
    "BIND", "VALUES", "MINUS", "EXISTS", "GROUP", "ORDER", "HAVING", "LIMIT", "OFFSET",
)

AGGREGATES = ("COUNT", "SUM", "MIN", "MAX", "AVG", "SAMPLE", "GROUP_CONCAT")
