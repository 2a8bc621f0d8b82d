"""Query texts to rows: tokens, triple patterns, terms, clauses.

The structure of a query depends only on its *skeleton* (the classes of its tokens), and a log holds far fewer
skeletons than texts. So the set-based analysis below (running sums over token positions) runs once per distinct
skeleton and yields token positions; every text then picks its own tokens at those positions. A log also repeats its
texts: each distinct text is tokenised once and written, and its rows of the log, known by a digest, get what was found
for it. A skeleton or text that holds a large share of the rows is split by AQE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadlens import vocab
from quadlens.functions import text as X
from quadlens.session import cut

TERM_CLASSES = ("i", "l", "n", "v", "b", "x", "]")
PATH_SIGNS = ("/", "|", "*", "+", "^", "!", "?")
STRAY_SIGNS = ('"', "'", "\\", "`", "x", "@", "%")


def tokenised(queries: DataFrame, text: str = "query_text") -> DataFrame:
    """Add ``tokens`` (canonical), ``skeleton`` and its key ``shape``."""
    rows = queries.withColumn("joined", X.canonical(F.col(text)))
    return rows.select(*queries.columns, X.split_tokens(F.col("joined")).alias("tokens"),
                       X.skeleton(F.col("joined")).alias("skeleton")).withColumn("shape", F.md5("skeleton"))


def _is_clause(t: Column) -> Column:
    return t.isin(*vocab.CLAUSE_WORDS)


def _change(up: Column, down: Column) -> Column:
    return F.when(up, 1).when(down, -1).otherwise(0)


def stored_tokens(queries: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``tokenised``, written once: both the skeletons and the texts' own rows are read from it."""
    return cut(tokenised(queries, text).select(*keep, "tokens", "skeleton", "shape"), "tokens")


def shapes_of(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("shape").agg(F.first("skeleton").alias("skeleton"))


def distinct_texts(queries: DataFrame, text: str = "query_text") -> DataFrame:
    """text_key, tokens, skeleton, shape of every distinct text, written once. Repeated texts go first (map-side)."""
    texts = queries.select(text).filter(F.col(text).isNotNull()).distinct()
    return stored_tokens(texts.withColumn("text_key", F.md5(text)), text, ["text_key"])


def per_row(queries: DataFrame, text: str, keep: list[str], found: DataFrame) -> DataFrame:
    """Give every row of a log what was found for its text: columns ``keep`` and those of ``found`` but text_key.

    What was found is packed into one array per text first, so the join is many-to-one and moves a digest for each row.
    """
    fields = [name for name in found.columns if name != "text_key"]
    packed = found.groupBy("text_key").agg(F.collect_list(F.struct(*fields)).alias("found"))
    return (queries.select(*keep, F.md5(text).alias("text_key")).join(packed, "text_key")
            .select(*keep, F.explode("found").alias("r")).select(*keep, "r.*"))


def annotated(shapes: DataFrame) -> DataFrame:
    """One row per token of every skeleton, with its place in the query.

    pd / bd / sd are paren, brace and bracket depth; stmt numbers statements and ``head`` is the clause word that
    opened the statement (null for triples); ``frame`` is the opening bracket of a property list; seg and rank place
    a term between ``;`` and ``,``; ctx says which kind of group the token is in; brk separates basic graph patterns.
    """
    c = F.col
    seq = W.partitionBy("shape").orderBy("pos")
    upto = seq.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = seq.rowsBetween(W.unboundedPreceding, -1)
    t = c("t")

    # The exchange on the shape key is the last one of the analysis: every window below starts with that key.
    rows = shapes.select("shape", F.posexplode(F.split("skeleton", " ")).alias("pos", "t"))

    rows = rows.select(
        "*",
        F.sum(_change(t == "(", t == ")")).over(upto).alias("pd"),
        F.sum(_change(t == "{", t == "}")).over(upto).alias("bd"),
        F.sum(_change(t == "[", t == "]")).over(upto).alias("sd"),
        F.lag("t").over(seq).alias("prev"), F.lead("t").over(seq).alias("next"), F.lag("t", 2).over(seq).alias("prev2"))

    # braces: the block a token is in and what kind of group it is
    at_top = c("pd") == 0
    brace = t.isin("{", "}")
    rows = rows.withColumn("opened_by", F.last(F.when(
        brace | (_is_clause(t) & (at_top | (t == "EXISTS"))), t), True).over(before))
    rows = rows.withColumn("lvl", F.when(t == "}", c("bd") + 1).otherwise(c("bd")))
    level = W.partitionBy("shape", "lvl").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("block", F.coalesce(F.last(F.when(t == "{", c("pos")), True).over(level), F.lit(-1)))
    kind = (F.when(c("prev") == "CONSTRUCT", "template")
            .when(c("opened_by").isin("EXISTS", "VALUES", "OPTIONAL", "MINUS", "SERVICE", "GRAPH"),
                  F.lower("opened_by")).otherwise("group"))
    block = W.partitionBy("shape", "block")
    rows = rows.select(
        "*", F.max(F.when(t == "{", kind)).over(block).alias("kind"),
        F.max(F.when(t == "{", c("opened_by") == "UNION").when(t == "}", c("next") == "UNION")).over(block).alias("alt"),
        F.max(F.when(t == "{", c("next") == "SELECT")).over(block).alias("sub"))

    def inside(cond: Column) -> Column:
        cond = F.coalesce(cond, F.lit(False))
        return F.sum(_change((t == "{") & cond, (t == "}") & cond)).over(upto)

    rows = rows.select(
        "*", inside(c("kind").isin("exists", "values", "template")).alias("hidden"),
        inside(c("kind") == "minus").alias("in_minus"), inside(c("kind") == "service").alias("in_service"),
        inside(c("sub") & (c("lvl") > 1)).alias("in_sub"), inside(c("kind") == "graph").alias("in_graph"),
        inside(c("kind") == "optional").alias("in_opt"), inside(c("alt")).alias("in_alt"),
        inside(c("kind") == "exists").alias("in_exists"), inside(c("kind").isin("exists", "minus")).alias("in_test"),
        # statements open at a clause word, brace or dot outside parentheses
        F.sum(F.when(at_top & (brace | (t == ".") | _is_clause(t)), 1).otherwise(0)).over(upto).alias("lead"))
    lead = W.partitionBy("shape", "lead").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.select(
        "*", F.last(F.when((t == "{") & c("alt") & (c("in_alt") == 1), c("pos")), True).over(upto).alias("alt_open"),
        F.when(c("in_test") > 0, F.last(F.when((t == "{") & c("kind").isin("exists", "minus") & (c("in_test") == 1), F.struct(
            c("pos").alias("open"), F.when(c("kind") == "minus", "minus").when(c("prev2") == "NOT", "notexists").otherwise("exists").alias("sign"))),
            True).over(upto)).alias("test"),
        F.when(c("in_graph") > 0, F.last(F.when((t == "{") & (c("kind") == "graph"), c("pos")), True).over(upto) - 1).alias("graph_at"),
        F.first("t").over(lead).alias("lead_t"),
        F.sum(F.when((t == ")") & at_top, 1).otherwise(0)).over(lead).alias("closed"))
    # ... and after the closing parenthesis of a FILTER or BIND
    closes = (t == ")") & at_top & (c("closed") == 1) & c("lead_t").isin("FILTER", "BIND")
    rows = rows.withColumn("stmt", c("lead") + F.sum(F.when(closes, 1).otherwise(0)).over(upto))
    statement = W.partitionBy("shape", "stmt").orderBy("pos")
    rows = rows.withColumn("first_t", F.first("t").over(statement))
    rows = rows.withColumn("head", F.when(_is_clause(c("first_t")) | (c("stmt") == 0), c("first_t")))

    # property lists: tokens belong to the innermost open bracket, the closing bracket stands for its node
    depth = W.partitionBy("shape", "sd").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("inner_sd", F.when(t == "]", c("sd") + 1).otherwise(c("sd")))
    inner = W.partitionBy("shape", "inner_sd").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    opener = F.last(F.when(t == "[", c("pos")), True)
    rows = rows.select(
        "*", F.when(c("sd") > 0, opener.over(depth)).otherwise(-1).alias("frame"),
        F.when(t == "]", opener.over(inner)).otherwise(c("pos")).alias("idx"))

    # the triples of an EXISTS test are no patterns of the query, but its test needs them
    is_triple = c("head").isNull() & (c("hidden") == c("in_exists"))
    shown = c("hidden") == 0
    # a path cannot be part of a plain pattern; parentheses inside a triple statement are paths too
    path_sign = is_triple & ((at_top & t.isin(*PATH_SIGNS)) | ((t == "(") & (c("pd") == 1)))
    rows = rows.select(
        "*", (is_triple & at_top & t.isin(*TERM_CLASSES)).alias("is_term"), path_sign.alias("path_sign"))
    breaks = (brace & at_top & (c("kind") != "exists")) | (at_top & t.isin("BIND", "VALUES")) | (shown & c("path_sign"))
    rows = rows.withColumn("brk", F.sum(F.when(breaks, 1).otherwise(0)).over(upto))

    scope = W.partitionBy("shape", "stmt", "frame")
    in_scope = scope.orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.select(
        "*", F.sum(F.when(t == ";", 1).otherwise(0)).over(in_scope).alias("seg"),
        F.when(c("frame") >= 0, c("frame")).otherwise(F.min_by("idx", F.when(c("is_term"), c("pos"))).over(scope))
        .alias("subj"))
    segment = W.partitionBy("shape", "stmt", "frame", "seg")
    in_segment = segment.orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.select(
        "*", F.sum(F.when(c("is_term"), 1).otherwise(0)).over(in_segment).alias("rank"),
        F.when((c("frame") < 0) & (c("seg") == 0), 2).otherwise(1).alias("base"),
        F.max("path_sign").over(segment).alias("is_path"))
    checked = W.partitionBy("shape")
    plain = c("head").isNull() & (c("hidden") == 0) & at_top
    rows = rows.select(
        "*", F.max(F.when(c("is_term") & (c("rank") == c("base")), c("idx"))).over(segment).alias("pred"),
        F.max("rank").over(segment).alias("terms"), F.max(c("is_term") & (t == "]")).over(segment).alias("anon"),
        F.sum(F.when(plain & (t == ","), 1).otherwise(0)).over(segment).alias("commas"))
    # well-formed: a known form, balanced nesting, no stray signs or words, and complete triple statements
    complete = (~shown | c("is_path") | (c("terms") - c("base") == c("commas") + 1)
                | ((c("commas") == 0) & ((c("terms") == 0) | ((c("terms") == 1) & c("anon") & (c("base") == 2)))))
    stray = t.isin(*STRAY_SIGNS) | (plain & t.rlike("^[A-Z_]{2,}$"))
    end = F.max_by(F.abs("pd") + F.abs("bd") + F.abs("sd"), "pos").over(checked)
    form = F.max(F.when(c("pos") == 0, t)).over(checked)
    rows = rows.withColumn("is_ok", (
        F.min(complete & ~stray & (F.least("pd", "bd", "sd") >= 0)).over(checked) & (end == 0)
        & form.isin(*vocab.QUERY_FORMS) & (F.max(t == "{").over(checked) | (form == "DESCRIBE"))))
    ctx = (F.when(c("in_service") > 0, "service").when(c("in_minus") > 0, "minus").when(c("in_sub") > 0, "subselect")
           .when(c("in_graph") > 0, "graph").when(c("in_opt") > 0, "optional").when(c("in_alt") > 0, "union")
           .otherwise("required"))
    return rows.select(
        "shape", "pos", "t", "prev", "next", "pd", "bd", "sd", "block", "kind", "hidden", "stmt", "head", "frame", "idx", "is_term",
        "in_opt", "in_alt", "in_graph", "in_test", "in_service", "in_sub", "alt_open", "test", "graph_at", (shown & c("path_sign")).alias("path_sign"), "is_path", "is_ok", "seg", "rank", "base", "subj", "pred", "brk", ctx.alias("ctx"),
        F.when(c("in_alt") > 0, c("alt_open")).alias("branch"))


def shape_triples(annotated: DataFrame) -> DataFrame:
    """Positions of the triple patterns of each well-formed skeleton: shape, bgp_id, pos, s_at, p_at, o_at, ctx, branch, part, graph_at.

    ctx is the kind of group a triple stands in; part says what it is for the answers, whatever graph it stands in: required, of a
    union's branch, optional, or not part of them (aside). graph_at is the place of the name of its graph.
    """
    c = F.col
    found = annotated.filter(c("is_ok") & (c("hidden") == 0) & c("is_term") & (c("rank") > c("base")) & ~c("is_path"))
    part = (F.when((c("in_test") > 0) | (c("in_service") > 0) | (c("in_sub") > 0), "aside").when(c("in_opt") > 0, "optional")
            .when(c("in_alt") > 0, "union").otherwise("required"))
    return found.select(
        "shape", (F.dense_rank().over(W.partitionBy("shape").orderBy("brk")) - 1).cast("bigint").alias("bgp_id"),
        (F.row_number().over(W.partitionBy("shape").orderBy("idx")) - 1).cast("bigint").alias("pos"),
        c("subj").alias("s_at"), c("pred").alias("p_at"), c("idx").alias("o_at"), "ctx", "branch", part.alias("part"), "graph_at")


# clauses whose meaning the tests of ``conditions`` do not cover
UNCOVERED = ("FROM", "SERVICE", "HAVING")


def shape_checks(annotated: DataFrame) -> DataFrame:
    """shape, is_ok, n, covered, one_row, branches, binds: facts about each skeleton.

    n counts triple patterns; covered says that plain patterns with their conditions, optional parts and at most one union decide
    whether the query has an answer (filters: see ``conditions.shape_conditions``); one_row marks aggregates that always have one;
    branches counts those of the union; binds says that a BIND occurs.
    """
    c = F.col
    t = c("t")
    triple = c("is_ok") & (c("hidden") == 0) & c("is_term") & (c("rank") > c("base")) & ~c("is_path")
    opens_test = (t == "{") & c("kind").isin("exists", "minus")
    # a test holds triples alone and stands at the outermost level or directly in a branch
    bad_test = (c("in_opt") == 0) & (
        ((c("in_test") > 0) & (c("head").isNotNull() | ((t == "{") & ~opens_test) | (c("in_test") > 1) | (c("in_graph") > 0)))
        | (opens_test & (c("bd") - c("in_alt") != 2)) | (c("in_alt") > 1) & (c("in_test") > 0))
    at_level = (c("bd") == 1) | ((c("bd") == 2) & (((c("in_alt") == 1) & (c("block") == c("alt_open"))) | (c("in_graph") == 1)))
    uncovered = (t.isin(*UNCOVERED) | c("path_sign") | ((c("in_test") > 0) & c("is_path")) | ((t == "SELECT") & (c("bd") > 0)) | ((t == "EXISTS") & (c("pd") > 0)) | bad_test
                 | ((t == "FILTER") & (c("in_opt") == 0) & (c("in_test") == 0) & ~at_level)
                 | ((t == "VALUES") & (c("in_opt") == 0) & (c("bd") > 1))
                 | ((t == "{") & (c("kind") == "graph") & ~c("prev").isin("i", "v"))
                 | c("ctx").isin("service", "subselect"))
    unions = F.count(F.when(t == "UNION", 1))
    return annotated.groupBy("shape").agg(
        F.first("is_ok").alias("is_ok"), F.count(F.when(triple, 1)).alias("n"),
        ((F.max(t == "{") | F.max((c("head") == "DESCRIBE") & (t == "i")))
         & ~F.max(F.coalesce(uncovered, F.lit(False))) & ((unions == 0) | (F.count_distinct("branch") == unions + 1))).alias("covered"),
        (F.max((c("head") == "SELECT") & t.isin(*vocab.AGGREGATES)) & ~F.max(t == "GROUP")).alias("one_row"),
        F.count_distinct("branch").alias("branches"), F.max(t == "BIND").alias("binds"))


def at(position: Column, tokens: Column | None = None) -> Column:
    """The token of a text at a position found for its skeleton; brackets stand for a fresh blank node."""
    token = F.get(tokens if tokens is not None else F.col("tokens"), position)
    return F.when(token == "[", F.concat(F.lit("_:anon"), position.cast("string"))).otherwise(token)


def per_query(tokens: DataFrame, shape_rows: DataFrame, keep: list[str]) -> DataFrame:
    """Give every text the rows found for its skeleton: columns ``keep``, ``tokens`` and those of ``shape_rows``.

    The rows are packed into one array per skeleton first (bounded by the length of one text), so the join is
    many-to-one and its text side can be split freely.
    """
    fields = [name for name in shape_rows.columns if name != "shape"]
    packed = shape_rows.groupBy("shape").agg(F.collect_list(F.struct(*fields)).alias("found"))
    return (tokens.select(*keep, "tokens", "shape").join(packed, "shape")
            .select(*keep, "tokens", F.explode("found").alias("r")).select(*keep, "tokens", "r.*"))


# --- operators ----------------------------------------------------------------------------------------------------

def token_rows(queries: DataFrame) -> DataFrame:
    """qid, pos, tok, kind of the raw tokens."""
    kind = X.token_class
    return (queries.select("qid", F.posexplode(X.raw_tokens(F.col("query_text"))).alias("pos", "tok"))
            .select("qid", F.col("pos").cast("bigint").alias("pos"), "tok", kind(F.col("tok")).alias("kind")))


def _terms(rows: DataFrame, keep: list[str]) -> DataFrame:
    places = ["ctx", "branch", "s_at", "p_at", "o_at", "part"]
    picked = rows.select(*keep, "bgp_id", "pos", *[at(F.col(f"{r}_at")).alias(r) for r in ("s", "p", "o")], *places, at(F.col("graph_at")).alias("graph"))
    return picked.select(*keep, "bgp_id", "pos", *[X.term_struct(F.col(r)).alias(r) for r in ("s", "p", "o")], *places, "graph")


def triple_patterns(queries: DataFrame, key: str = "qid", text: str = "query_text",
                    carry: tuple[str, ...] = (), repeated: bool = True) -> DataFrame:
    """Every triple pattern of every well-formed query: key, bgp_id, pos, s, p, o (term structs), ctx, branch, and for the
    answers part and graph (token of the graph's name, null outside GRAPH). repeated: whether texts may occur several times."""
    keep = ["text_key"] if repeated else [key, *carry]
    tok = distinct_texts(queries, text) if repeated else stored_tokens(queries, text, keep)
    rows = _terms(per_query(tok, shape_triples(annotated(shapes_of(tok))), keep), keep)
    return per_row(queries, text, [key, *carry], rows) if repeated else rows


def flat_triples(triples: DataFrame) -> DataFrame:
    """Triple patterns with the term structs spread into plain columns."""
    out = [F.col(name) for name in triples.columns if name not in ("s", "p", "o", "part", "graph")]
    for role in ("s", "p", "o"):
        out += [F.col(f"{role}.value").alias(role), F.col(f"{role}.kind").alias(f"{role}_kind")]
    return triples.select(*out, F.col("o.datatype").alias("o_datatype"), F.col("o.lang").alias("o_lang"))


def parse_or_keep(queries: DataFrame) -> DataFrame:
    """Every row with is_ok, and the number of its triple patterns (null when it is not well formed)."""
    tok = distinct_texts(queries)
    checks = tok.select("text_key", "shape").join(shape_checks(annotated(shapes_of(tok))), "shape").select("text_key", "is_ok", "n")
    return queries.withColumn("text_key", F.md5("query_text")).join(checks, "text_key", "left").select(
        *queries.columns, F.coalesce("is_ok", F.lit(False)).alias("is_ok"),
        F.when(F.col("is_ok"), F.col("n")).alias("n_triples"))


def parse_failures(checked: DataFrame) -> DataFrame:
    return checked.agg(F.coalesce(F.sum(F.col("is_ok").cast("bigint")), F.lit(0)).alias("n_ok"),
                       F.coalesce(F.sum((~F.col("is_ok")).cast("bigint")), F.lit(0)).alias("n_failed"))


def triple_count(checked: DataFrame, key: str = "qid") -> DataFrame:
    """Complexity: triple patterns per query, 0 for a query that is not well formed."""
    return checked.select(key, F.coalesce("n_triples", F.lit(0)).alias("n"))


def _clauses(queries: DataFrame, rows, pick) -> DataFrame:
    """qid and rows of well-formed queries: ``rows`` maps annotated skeleton tokens to the wanted positions, ``pick`` the tokens of
    each distinct text at these positions to text_key and the columns wanted."""
    tok = distinct_texts(queries)
    found = per_query(tok, rows(annotated(shapes_of(tok)).filter("is_ok")), ["text_key"])
    return per_row(queries, "query_text", ["qid"], pick(found))


def iri_mentions(queries: DataFrame) -> DataFrame:
    """qid, iri, place (triple / filter), n: IRIs in triple patterns and inside filter expressions."""
    def rows(a: DataFrame) -> DataFrame:
        triples = shape_triples(a)
        slots = triples.select("shape", F.explode(F.array("s_at", "p_at", "o_at")).alias("at")) \
            .withColumn("place", F.lit("triple"))
        filters = a.filter("t = 'i' and head = 'FILTER' and pd > 0 and hidden = 0") \
            .select("shape", F.col("pos").alias("at"), F.lit("filter").alias("place"))
        return slots.unionByName(filters)

    def pick(found: DataFrame) -> DataFrame:
        return (found.withColumn("iri", at(F.col("at"))).filter(F.col("iri").startswith("<"))
                .groupBy("text_key", X.term_struct(F.col("iri"))["value"].alias("iri"), "place").agg(F.count("*").alias("n")))
    return _clauses(queries, rows, pick).groupBy("qid", "iri", "place").agg(F.sum("n").alias("n"))


def values_cells(annotated: DataFrame) -> DataFrame:
    """shape, block, row, col, var_at, term_at of the cells of inline data."""
    c = F.col
    data = annotated.filter("kind = 'values'")
    cells = data.withColumn("tuple", F.sum(F.when(c("t") == "(", 1).otherwise(0)).over(
        W.partitionBy("shape", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)))
    cells = cells.filter(c("t").isin("i", "l", "n", "UNDEF")).withColumn(
        "col", F.row_number().over(W.partitionBy("shape", "block", "tuple").orderBy("pos")))
    single = c("tuple") == 0
    cells = cells.select("shape", "stmt", "block", F.when(single, c("col")).otherwise(c("tuple")).alias("row"),
                         F.when(single, 1).otherwise(c("col")).alias("col"), c("pos").alias("term_at"))
    names = annotated.filter("head = 'VALUES' and t = 'v'").select(
        "shape", (c("stmt") + 1).alias("stmt"), c("pos").alias("var_at"),
        F.row_number().over(W.partitionBy("shape", "stmt").orderBy("pos")).alias("col"))
    return cells.join(names, ["shape", "stmt", "col"]).select("shape", "block", "row", "col", "var_at", "term_at")


def values_blocks(queries: DataFrame) -> DataFrame:
    """qid, block, row, var, term of inline VALUES data, wherever it stands in the query."""
    return _clauses(queries, values_cells, lambda found: found.select(
        "text_key", F.col("block").cast("bigint").alias("block"), F.col("row").cast("bigint").alias("row"),
        X.term_struct(at(F.col("var_at")))["value"].alias("var"), at(F.col("term_at")).alias("term")))


def bind_vars(queries: DataFrame) -> DataFrame:
    def rows(a: DataFrame) -> DataFrame:
        return a.filter("t = 'v' and prev = 'AS' and head = 'BIND'").select("shape", F.col("pos").alias("at"))
    return _clauses(queries, rows, lambda found: found.select(
        "text_key", X.term_struct(at(F.col("at")))["value"].alias("var")).distinct()).distinct()


def slice_numbers(queries: DataFrame) -> DataFrame:
    """qid, level, lim, off: one row per query level that has a LIMIT or an OFFSET."""
    def rows(a: DataFrame) -> DataFrame:
        return a.filter("t = 'n' and prev in ('LIMIT', 'OFFSET')").groupBy("shape", "bd").agg(
            F.max(F.when(F.col("prev") == "LIMIT", F.col("pos"))).alias("lim_at"),
            F.max(F.when(F.col("prev") == "OFFSET", F.col("pos"))).alias("off_at"))
    return _clauses(queries, rows, lambda found: found.select(
        "text_key", F.col("bd").cast("bigint").alias("level"), at(F.col("lim_at")).try_cast("bigint").alias("lim"),
        at(F.col("off_at")).try_cast("bigint").alias("off")))


def _aggregate_rows(a: DataFrame) -> DataFrame:
    opened = F.last(F.when((F.col("t") == "(") & (F.col("pd") == 1), F.col("next")), True).over(
        W.partitionBy("shape", "stmt").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow))
    hits = a.withColumn("agg", opened).filter(
        (F.col("t") == "v") & (F.col("prev") == "AS") & (F.col("head") == "SELECT")
        & F.col("agg").isin(*vocab.AGGREGATES))
    return hits.select("shape", F.lower("agg").alias("agg"), F.col("pos").alias("at"),
                       F.row_number().over(W.partitionBy("shape", "agg").orderBy("pos")).cast("bigint").alias("n"))


def aggregate_uses(queries: DataFrame) -> DataFrame:
    """qid, agg, alias, n: aggregates with an output name, numbered per aggregate."""
    return _clauses(queries, _aggregate_rows, lambda found: found.select(
        "text_key", "agg", X.term_struct(at(F.col("at")))["value"].alias("alias"), "n"))


def filter_constants(queries: DataFrame) -> DataFrame:
    """qid, kind, value: constant on the right of a filter that is one equality."""
    def rows(a: DataFrame) -> DataFrame:
        c = F.col
        joined = F.max(c("t").isin("&&", "||") & (c("pd") == 1)).over(W.partitionBy("shape", "stmt"))
        return a.withColumn("joined", joined).filter(
            "head = 'FILTER' and hidden = 0 and not joined and pd = 1 and t in ('i', 'l', 'n') and prev = '=' "
            "and next = ')'").select("shape", c("pos").alias("at"))
    term = X.term_struct(at(F.col("at")))
    return _clauses(queries, rows, lambda found: found.select("text_key", term["kind"].alias("kind"), term["value"].alias("value")))


def type_objects(triples: DataFrame, key: str = "qid") -> DataFrame:
    """key, type, kind: objects of rdf:type and of the class qualifier."""
    return triples.filter((F.col("p.kind") == "uri") & F.col("p.value").isin(*vocab.TYPE_PREDICATES)).select(
        key, F.col("o.value").alias("type"), F.col("o.kind").alias("kind"))


def role_terms(triples: DataFrame, roles: tuple[str, ...] = ("s", "o"), key: str = "qid") -> DataFrame:
    """key, pos, role, term: bound (non-variable) terms, one row each."""
    cells = F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{r}.kind").alias("kind"),
                               F.col(f"{r}.value").alias("term")) for r in roles])
    return (triples.select(key, "pos", F.explode(cells).alias("c")).filter("c.kind != 'variable'")
            .select(key, "pos", "c.role", "c.term"))


def statement_rows(triples: DataFrame, key: str = "qid") -> DataFrame:
    """key, statements: the triple patterns of a query as a JSON array, variables as null.

    An array holds the statements of one text, so its size is bounded by that text.
    """
    def value(role: str) -> Column:
        return F.when(F.col(f"{role}.kind") != "variable", F.col(f"{role}.value"))
    rows = F.struct("pos", value("s").alias("subjectValue"), value("p").alias("predicateValue"),
                    value("o").alias("objectValue"))
    packed = triples.groupBy(key).agg(F.array_sort(F.collect_list(rows)).alias("r"))
    return packed.select(key, F.transform("r", lambda r: F.struct(
        r["subjectValue"].alias("subjectValue"), r["predicateValue"].alias("predicateValue"),
        r["objectValue"].alias("objectValue"))).alias("statements"))


def _per_text(queries: DataFrame, per_shape, columns: list[str]) -> DataFrame:
    tok = distinct_texts(queries)
    found = tok.select("text_key", "shape").join(per_shape(annotated(shapes_of(tok)).filter("is_ok")), "shape")
    return per_row(queries, "query_text", ["qid"], found.select("text_key", *columns))


def modifier_profile(queries: DataFrame) -> DataFrame:
    """Solution modifiers of the outermost query level, one row per well-formed query."""
    def per_shape(a: DataFrame) -> DataFrame:
        c = F.col
        t = c("t")

        def n(cond: Column) -> Column:
            return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
        plain, grouped = (t == "v") & (c("pd") == 0), (t == "(") & (c("pd") == 1)
        named = (t == "v") & (c("pd") == 1) & (c("prev") == "AS")
        return a.filter("bd = 0").groupBy("shape").agg(
            F.max(t.isin("LIMIT", "OFFSET")).alias("has_slice"),
            F.max(F.coalesce((t == "DISTINCT") & (c("prev") == "SELECT"), F.lit(False))).alias("has_distinct"),
            F.max(F.coalesce((t == "REDUCED") & (c("prev") == "SELECT"), F.lit(False))).alias("has_reduced"),
            F.max(t == "ORDER").alias("has_order"), F.max(t == "GROUP").alias("has_group"),
            F.max(t == "HAVING").alias("has_having"),
            n((c("head") == "SELECT") & (plain | named)).alias("n_project"),
            n((c("head") == "ORDER") & (plain | grouped)).alias("n_order"),
            n((c("head") == "GROUP") & (plain | grouped)).alias("n_group"),
            n(t.isin(*vocab.AGGREGATES)).alias("n_agg"))
    return _per_text(queries, per_shape, ["has_slice", "has_distinct", "has_reduced", "has_order", "has_group",
                                          "has_having", "n_project", "n_order", "n_group", "n_agg"])


def operator_profile(queries: DataFrame) -> DataFrame:
    """qid, op, n: algebra operators a query uses beyond basic graph patterns and projection."""
    def per_shape(a: DataFrame) -> DataFrame:
        t, prev = F.col("t"), F.coalesce(F.col("prev"), F.lit(""))
        op = (F.when(t == "OPTIONAL", "leftjoin")
              .when(t.isin("UNION", "FILTER", "MINUS", "SERVICE", "GRAPH", "GROUP", "ORDER", "HAVING"), F.lower(t))
              .when((t == "EXISTS") & (prev == "NOT"), "notexists").when(t == "EXISTS", "exists")
              .when(t == "BIND", "extend").when(t == "VALUES", "table")
              .when(t.isin("DISTINCT", "REDUCED") & (prev == "SELECT"), F.lower(t))
              .when(t.isin("LIMIT", "OFFSET"), "slice").when((t == "SELECT") & (F.col("bd") > 0), "subselect")
              .when(F.col("path_sign"), "path"))
        # a path and a slice are several tokens but one operator
        unit = (F.when(op == "path", F.concat_ws("-", "stmt", "frame", "seg"))
                .when(op == "slice", F.col("block").cast("string")).otherwise(F.col("pos").cast("string")))
        return (a.select("shape", op.alias("op"), unit.alias("unit")).filter("op is not null").distinct()
                .groupBy("shape", "op").agg(F.count("*").alias("n")))
    return _per_text(queries, per_shape, ["op", "n"])


def subquery_levels(queries: DataFrame) -> DataFrame:
    """qid, level, n: SELECT clauses per nesting level (0 = the query itself)."""
    def per_shape(a: DataFrame) -> DataFrame:
        rank = F.dense_rank().over(W.partitionBy("shape").orderBy("bd"))
        return a.filter("t = 'SELECT'").withColumn("level", (rank - 1).cast("bigint")).groupBy(
            "shape", "level").agg(F.count("*").alias("n"))
    return _per_text(queries, per_shape, ["level", "n"])
