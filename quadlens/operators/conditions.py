"""What a query asks of its bindings beyond triples: filters, inline data, MINUS and EXISTS.

Like the triples, conditions are found once per skeleton, as token positions; a text then picks its own terms. A condition is a
word for the test, the variables it looks at and the terms it compares with, so one column expression (``holds``) tests the
bindings of all queries at once, whatever their filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadlens import vocab
from quadlens.functions import text as X
from quadlens.operators import decompose as D

#: Forms of one part of a filter, as token classes, and the test they stand for. A closing bracket at the end may be missing.
_TEXT = r"(?:v|STR \( v \)|LCASE \( v \)|LCASE \( STR \( v \) \))"
FORMS = (
    (r"v = [iln]|[iln] = v", "eq"), (r"v != [iln]|[iln] != v", "ne"), (r"v = v", "same"), (r"v != v", "differ"),
    (r"v < [ln]|[ln] > v", "lt"), (r"v <= [ln]|[ln] >= v", "le"), (r"v > [ln]|[ln] < v", "gt"), (r"v >= [ln]|[ln] <= v", "ge"),
    (r"v IN \( [iln](?: , [iln])*(?: \))?", "in"), (r"v NOT IN \( [iln](?: , [iln])*(?: \))?", "notin"),
    (r"v = [iln](?: \|\| v = [iln])+", "eqany"),
    (r"LANG \( v \) = l", "lang"), (r"LANG \( v \) != l", "notlang"), (r"LANGMATCHES \( LANG \( v \) , l(?: \))?", "langmatches"),
    (r"STR \( v \) = l", "text"), (r"STR \( v \) != l", "nottext"),
    (r"(?:ISIRI|ISURI) \( v(?: \))?", "iri"), (r"ISLITERAL \( v(?: \))?", "literal"), (r"ISBLANK \( v(?: \))?", "blank"),
    (r"! (?:ISIRI|ISURI) \( v(?: \))?", "notiri"), (r"! ISLITERAL \( v(?: \))?", "notliteral"), (r"! ISBLANK \( v(?: \))?", "notblank"),
    (r"BOUND \( v(?: \))?", "bound"), (r"! BOUND \( v(?: \))?", "notbound"),
    (rf"CONTAINS \( {_TEXT} , l(?: \))?", "contains"), (rf"STRSTARTS \( {_TEXT} , l(?: \))?", "starts"),
    (rf"STRENDS \( {_TEXT} , l(?: \))?", "ends"), (rf"REGEX \( {_TEXT} , l(?: , l)?(?: \))?", "regex"),
)
#: Tests on the text of a term.
ON_TEXT = ("contains", "starts", "ends", "regex")


def shape_conditions(annotated: DataFrame) -> DataFrame:
    """shape, conditions: array of (kind, branch, grp, op, v_at, c_at) of the well-formed skeletons that have some.

    kind ``filter``: a part of a filter (parts are joined by &&); op null if no form fits. ``values``: a block of inline data, v_at its
    variables, c_at its cells row by row. ``test``: a triple (v_at: its three places) inside a MINUS or EXISTS group grp, op is its
    sign. ``describe``: resources named by DESCRIBE. ``bind``: a variable that BIND sets, anywhere. branch is the union's branch, null outside. Optional parts are left out: what they
    ask never decides whether there is an answer.
    """
    c = F.col
    t = c("t")
    a = annotated.filter(c("is_ok") & (c("in_opt") == 0) & (c("in_service") == 0) & (c("in_sub") == 0))
    none = F.array().cast("array<int>")

    def rows(df: DataFrame, kind: str, op: Column, grp: Column, v_at: Column, c_at: Column) -> DataFrame:
        return df.select("shape", F.struct(
            F.lit(kind).alias("kind"), c("branch").cast("int").alias("branch"), grp.cast("int").alias("grp"), op.cast("string").alias("op"),
            v_at.alias("v_at"), c_at.alias("c_at")).alias("one"))

    # filters, part by part
    inside = W.partitionBy("shape", "stmt").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    f = a.filter((c("head") == "FILTER") & (c("hidden") == 0) & (c("in_test") == 0))
    f = f.withColumn("part_no", F.sum(F.when((t == "&&") & (c("pd") == 1), 1).otherwise(0)).over(inside))
    f = f.filter((t != "FILTER") & ~((t == "&&") & (c("pd") == 1)) & ~((t == "(") & (c("prev") == "FILTER")))
    f = f.groupBy("shape", "stmt", "part_no").agg(
        F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("toks"), F.first("branch").alias("branch"))
    words = F.array_join(F.transform("toks", lambda x: x["t"]), " ")
    f = f.withColumn("words", F.regexp_replace(words, r"^\( ([^()]*(?:\([^()]*\)[^()]*)*) \)$", "$1")).filter("words <> 'NOT'")
    op = F.lit(None).cast("string")
    for form, name in reversed(FORMS):
        if name in ON_TEXT:
            fold = F.when(F.contains("words", F.lit("LCASE")), F.concat(F.lit(name), F.lit(":lower"))).otherwise(F.lit(name))
            fold = F.when(F.contains("words", F.lit("STR (")), F.concat(fold, F.lit(":str"))).otherwise(fold)
            op = F.when(F.col("words").rlike(f"^(?:{form})$"), fold).otherwise(op)
        else:
            op = F.when(F.col("words").rlike(f"^(?:{form})$"), F.lit(name)).otherwise(op)

    def places(*classes: str) -> Column:
        return F.transform(F.filter("toks", lambda x: x["t"].isin(*classes)), lambda x: x["pos"])
    out = rows(f, "filter", op, F.lit(None), places("v"), places("i", "l", "n"))

    # inline data; a block without cells has no solution
    outer = annotated.filter((t == "{") & (c("kind") == "values") & (c("in_opt") == 0) & (c("in_service") == 0) & (c("in_sub") == 0)) \
        .select("shape", "block", "branch")
    cells = D.values_cells(annotated.filter("is_ok")).groupBy("shape", "block").agg(
        F.array_sort(F.collect_list(F.struct("row", "col", "term_at"))).alias("cells"),
        F.array_sort(F.collect_set(F.struct("col", "var_at"))).alias("vars"))
    blocks = outer.join(cells, ["shape", "block"], "left")
    out = out.unionByName(rows(blocks, "values", F.lit("rows"), c("block"), F.coalesce(F.transform("vars", lambda v: v["var_at"]), none),
                               F.coalesce(F.transform("cells", lambda v: v["term_at"]), none)))

    # triples of MINUS and EXISTS groups
    tests = a.filter((c("in_test") == 1) & c("is_term") & (c("rank") > c("base")) & ~c("is_path"))
    out = out.unionByName(rows(tests, "test", c("test.sign"), c("test.open"), F.array("subj", "pred", "idx").cast("array<int>"), none))
    named = annotated.filter(c("is_ok") & (c("head") == "DESCRIBE") & (t == "i"))
    out = out.unionByName(rows(named, "describe", F.lit(None), F.lit(None), none, F.array(c("pos")).cast("array<int>")))
    binds = annotated.filter(c("is_ok") & (t == "v") & (c("prev") == "AS") & (c("head") == "BIND"))
    out = out.unionByName(rows(binds, "bind", F.lit(None), F.lit(None), F.array(c("pos")).cast("array<int>"), none))
    return out.groupBy("shape").agg(F.collect_list("one").alias("conditions"))


def slot(term: Column) -> Column:
    """Name of a variable or blank node (?v..., ?b...), or the key of a constant."""
    return F.when(term["kind"].isin("variable", "blank"), F.concat(F.lit("?"), F.substr(term["kind"], F.lit(1), F.lit(1)), term["value"])) \
        .otherwise(X.term_key(term["kind"], term["value"], term["datatype"], term["lang"]))


def text_conditions(unique: DataFrame) -> DataFrame:
    """uq_id, kind, branch, grp, op, vars, args: the conditions of each text, with its own names and terms; UNDEF is empty."""
    rows = unique.filter("size(conditions) > 0").select(
        "uq_id", "conditions", X.split_tokens(X.canonical(F.col("norm_text"))).alias("tokens"))
    rows = rows.select("uq_id", "tokens", F.inline("conditions"))

    def named(places: Column) -> Column:
        return F.transform(places, lambda p: F.when(F.get(F.col("tokens"), p) == "UNDEF", "").otherwise(
            slot(X.term_struct(D.at(p, F.col("tokens"))))))
    return rows.select("uq_id", "kind", "branch", "grp", "op", named(F.col("v_at")).alias("vars"), named(F.col("c_at")).alias("args"))


# --- tests on term keys -----------------------------------------------------------------------------------------------

def lexical(key: Column) -> Column:
    """Lexical form of a literal, text of an IRI."""
    return (F.when(key.startswith("<"), F.substr(key, F.lit(2), F.length(key) - 2))
            .otherwise(F.regexp_extract(key, r"(?s)^\x22(.*)\x22(?:@[A-Za-z0-9\-]+|\^\^[^\x22]*)$", 1)))


def language(key: Column) -> Column:
    return F.regexp_extract(key, r"(?s)^\x22.*\x22@([A-Za-z0-9\-]+)$", 1)


def datatype(key: Column) -> Column:
    return F.regexp_extract(key, r"(?s)^\x22.*\x22\^\^([^\x22]*)$", 1)


NUMERIC = tuple(vocab.XSD + n for n in ("integer", "decimal", "double", "float", "int", "long", "short", "byte", "nonNegativeInteger",
                                        "positiveInteger", "negativeInteger", "nonPositiveInteger", "unsignedInt", "unsignedLong"))
#: Datatypes whose lexical forms are in the order of their values; times with the same zone.
ORDERED = tuple(vocab.XSD + n for n in ("string", "dateTime", "date", "gYear"))


def number(key: Column) -> Column:
    return F.when(datatype(key).isin(*NUMERIC), lexical(key).try_cast("double"))


def compared(a: Column, b: Column, op: str) -> Column:
    def test(x: Column, y: Column) -> Column:
        return {"lt": x < y, "le": x <= y, "gt": x > y, "ge": x >= y}[op]
    return X.let(_numbers(a, b), lambda v: F.when(v["m"].isNotNull() & v["n"].isNotNull(), test(v["m"], v["n"])).when(
        (datatype(v["x"]) == datatype(v["a"])) & datatype(v["x"]).isin(*ORDERED), test(lexical(v["x"]), lexical(v["a"]))).otherwise(False))


def plain_pattern(pattern: Column) -> Column:
    """Whether a regular expression is plain text, perhaps anchored at its ends."""
    return pattern.rlike(r"^\^?[\p{L}\p{N} _,:;/#@\-]*\$?$")


def decidable(kind: Column, op: Column, args: Column) -> Column:
    """Whether ``holds`` can test a condition: a known form, and a plain pattern without flags but ``i``."""
    pattern, flags = lexical(F.get(args, F.lit(0))), lexical(F.get(args, F.lit(1)))
    return (kind != "filter") | (op.isNotNull() & (~op.startswith("regex") | (plain_pattern(pattern) & F.coalesce(flags.isin("", "i"), F.lit(True)))))


def _numbers(x: Column, a: Column) -> Column:
    return F.struct(x.alias("x"), a.alias("a"), number(x).alias("m"), number(a).alias("n"))


def _same(x: Column, a: Column) -> Column:
    return X.let(_numbers(x, a), lambda v: (v["x"] == v["a"]) | F.coalesce(v["m"] == v["n"], F.lit(False)))


def _rows(condition: Column, value) -> Column:
    args, columns = condition["args"], F.size(condition["vars"])
    return (F.size(args) > 0) & (columns > 0) & F.exists(F.sequence(F.lit(0), F.floor(F.size(args) / columns).cast("int") - 1), lambda r: F.forall(
        F.transform(condition["vars"], lambda v, i: F.struct(v.alias("v"), F.get(args, r * columns + i).alias("a"))),
        lambda cell: (cell["a"] == "") | F.coalesce(cell["a"] == value(cell["v"]), F.lit(True))))


def _on_text(name: str, op: Column, x: Column, args: Column) -> Column:
    fold = F.coalesce(lexical(F.get(args, F.lit(1))) == "i", F.lit(False)) if name == "regex" else F.lit(False)
    lower = F.contains(op, F.lit(":lower"))
    pattern = lexical(F.get(args, F.lit(0)))
    pair = F.struct(F.when(lower | fold, F.lower(lexical(x))).otherwise(lexical(x)).alias("text"),
                    F.when(fold, F.lower(pattern)).otherwise(pattern).alias("a"))

    def found(v: Column) -> Column:
        if name != "regex":
            return {"contains": F.contains, "starts": F.startswith, "ends": F.endswith}[name](v["text"], v["a"])
        core = F.regexp_replace(v["a"], r"^\^|\$$", "")
        head, tail = v["a"].startswith("^"), v["a"].endswith("$")
        return (F.when(head & tail, v["text"] == core).when(head, F.startswith(v["text"], core))
                .when(tail, F.endswith(v["text"], core)).otherwise(F.contains(v["text"], core)))
    return (x.startswith('"') | F.contains(op, F.lit(":str"))) & X.let(pair, found)


def holds(condition: Column, value, ops: list[str]) -> Column:
    """Whether a condition (op, vars, args) is true; value: from a variable's name to the key of its term; ops: those that occur.

    What is an error in a filter counts as false, as it does there. Language tags are compared in lower case.
    """
    op, args = condition["op"], condition["args"]

    def test(name: str, x: Column, y: Column) -> Column:
        arg, literal = F.get(args, F.lit(0)), x.startswith('"')
        tag = F.lower(lexical(arg))
        if name in ON_TEXT:
            return _on_text(name, op, x, args)
        if name in ("lt", "le", "gt", "ge"):
            return compared(x, arg, name)
        return {
            "eq": lambda: _same(x, arg), "ne": lambda: ~_same(x, arg), "same": lambda: _same(x, y), "differ": lambda: ~_same(x, y),
            "in": lambda: F.exists(args, lambda a: _same(x, a)), "notin": lambda: ~F.exists(args, lambda a: _same(x, a)),
            # one term for each variable, any of them
            "eqany": lambda: F.exists(F.transform(condition["vars"], lambda v, i: F.struct(value(v).alias("x"), F.get(args, i).alias("a"))), lambda c: _same(c["x"], c["a"])),
            "lang": lambda: literal & (language(x) == tag), "notlang": lambda: literal & (language(x) != tag),
            "langmatches": lambda: literal & X.let(language(x), lambda got: F.when(tag == "*", got != "").otherwise(
                (got == tag) | F.startswith(got, F.concat(tag, F.lit("-"))))),
            "text": lambda: lexical(x) == lexical(arg), "nottext": lambda: lexical(x) != lexical(arg),
            "iri": lambda: x.startswith("<"), "literal": lambda: literal, "blank": lambda: x.startswith("_:"),
            "notiri": lambda: ~x.startswith("<"), "notliteral": lambda: ~literal, "notblank": lambda: ~x.startswith("_:"),
            "bound": lambda: F.lit(True), "notbound": lambda: F.lit(False), "rows": lambda: _rows(condition, value),
        }[name]()

    def verdict(terms: Column) -> Column:
        out = F.lit(None).cast("boolean")
        for name in sorted({o.split(":")[0] for o in ops}):
            is_it = F.startswith(op, F.lit(name)) if name in ON_TEXT else op == name
            out = F.when(is_it, test(name, terms["x"], terms["y"])).otherwise(out)
        return F.coalesce(out, F.lit(False))
    return X.let(F.struct(value(F.get(condition["vars"], F.lit(0))).alias("x"), value(F.get(condition["vars"], F.lit(1))).alias("y")), verdict)
