"""Look-ups of terms and queries in the graph: labels, existence, validity, bindings, equivalence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadlens import vocab
from quadlens.functions import text as X
from quadlens.operators import decompose as D
from quadlens.operators import matching as M
from quadlens.operators.conditions import decidable, slot, text_conditions
from quadlens.session import cut


def labels(quads: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """term, label: dct:title, else rdfs:label; the smallest literal when there are several."""
    rows = quads.filter(F.col("p").isin(vocab.DCT_TITLE, vocab.RDFS_LABEL) & (F.col("o_kind") == "literal"))
    if terms is not None:
        rows = rows.join(terms.select(F.col("term").alias("s")).distinct(), "s", "left_semi")
    return rows.groupBy(F.col("s").alias("term")).agg(F.coalesce(
        F.min(F.when(F.col("p") == vocab.DCT_TITLE, F.col("o"))),
        F.min(F.when(F.col("p") == vocab.RDFS_LABEL, F.col("o")))).alias("label"))


def exists_in_role(terms: DataFrame, quads: DataFrame, role: str) -> DataFrame:
    """Terms that occur in the graph as s, p or o (IRIs only).

    The terms are the small side: they thin out the quads, and what is left is reduced to distinct values (map-side), so a
    predicate that fills a third of the graph is one row at the second join.
    """
    rows = quads.filter("o_kind = 'uri'") if role == "o" else quads
    present = rows.select(F.col(role).alias("term")).join(terms.select("term").distinct(), "term", "left_semi").distinct()
    return terms.join(present, "term", "left_semi")


# --- validity -------------------------------------------------------------------------------------------------------

def decided(unique: DataFrame, triples: DataFrame, binds: DataFrame) -> DataFrame:
    """The unique queries that plain patterns with conditions decide, with their facts (see ``shape_checks``); binds: uq_id, var.

    Left out are queries whose BIND fixes a variable of a triple, and those where a variable that an optional part binds
    first is needed by a later triple.
    """
    covered = unique.filter("covered")
    terms = F.array_distinct(F.array(*[F.struct(F.col(f"{r}.kind").alias("kind"), F.col(f"{r}.value").alias("value")) for r in ("s", "p", "o")]))
    used = triples.select("uq_id", "pos", "part", "branch", F.explode(terms).alias("t")).filter("t.kind in ('variable', 'blank')")
    # places of a variable, as many as the text has; one branch does not see what another binds
    late = used.groupBy("uq_id", "t").agg(F.collect_list(F.struct("pos", "part", "branch")).alias("at")).filter("""exists(at, o ->
        o.part = 'optional' and exists(at, n -> n.part <> 'optional' and n.pos > o.pos and (n.part = 'required' or o.branch is null or n.branch = o.branch))
        and not exists(at, e -> e.part <> 'optional' and e.pos < o.pos and (e.part = 'required' or e.branch = o.branch)))""")
    fixed = binds.join(used.select("uq_id", "t.value").distinct(), "uq_id").filter("var = value")
    return covered.join(late.select("uq_id").unionByName(fixed.select("uq_id")).distinct(), "uq_id", "left_anti")


def query_units(queries: DataFrame, triples: DataFrame) -> DataFrame:
    """unit, uq_id, branch: a unit for each query, or for each branch of its union, also for those without a triple."""
    seen = triples.filter("branch is not null").select("uq_id", "branch").distinct()
    bare = queries.join(seen.groupBy("uq_id").agg(F.count("*").alias("n")), "uq_id", "left").filter(
        "branches > coalesce(n, 0)").select("uq_id", F.lit(-2).alias("branch"))
    branches = seen.withColumn("branch", F.col("branch").cast("int")).unionByName(bare)
    return queries.select("uq_id").join(branches, "uq_id", "left").select(
        F.concat_ws("/", "uq_id", F.coalesce("branch", F.lit(-1))).alias("unit"), "uq_id", "branch")


def match_units(units: DataFrame, triples: DataFrame) -> DataFrame:
    """Triples that must match for a unit to have an answer, by name or key: unit, pos, s, p, o, g.

    OPTIONAL parts never decide whether there is an answer. A branch has its own triples and those outside the union. g is null
    outside GRAPH.
    """
    graph = F.when(F.col("graph").isNotNull(), slot(X.term_struct(F.col("graph"))))
    columns = ("unit", "pos", *[slot(F.col(r)).alias(r) for r in ("s", "p", "o")], graph.alias("g"))
    fixed = units.join(triples.filter("part = 'required'").drop("branch"), "uq_id").select(*columns)
    own = triples.filter("part = 'union'").withColumn("unit", F.concat_ws("/", "uq_id", F.coalesce("branch", F.lit(-1)))) \
        .join(units.select("unit"), "unit", "left_semi").select(*columns)
    return fixed.unionByName(own)


def unit_conditions(units: DataFrame, conditions: DataFrame, own: DataFrame, triples: DataFrame, binds: DataFrame) -> DataFrame:
    """unit, kind, grp, op, vars, args, open: the conditions of each unit; open marks those that cannot be decided.

    A filter has to look at variables that the unit's own triples bind; inline data and tests must not share a variable with optional
    parts or BIND alone.
    """
    def names(df: DataFrame, *terms: Column) -> DataFrame:
        return df.select(df.columns[0], F.explode(F.array(*terms)).alias("v")).filter(F.col("v").startswith("?"))
    bound = names(own, *[F.col(r) for r in M.ROLES]).groupBy("unit").agg(F.collect_set("v").alias("bound"))
    loose = names(triples.filter("part = 'optional'").select("uq_id", "s", "p", "o"), *[slot(F.col(r)) for r in ("s", "p", "o")]) \
        .unionByName(binds.select("uq_id", F.concat(F.lit("?v"), "var").alias("v"))).groupBy("uq_id").agg(F.collect_set("v").alias("loose"))
    rows = units.join(conditions.withColumnRenamed("branch", "at"), "uq_id").filter("at is null or at = branch")
    rows = rows.join(bound, "unit", "left").join(loose, "uq_id", "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumn("bound", F.coalesce("bound", none)).withColumn("loose", F.coalesce("loose", none))
    unknown = F.when(F.col("kind") == "filter", F.exists("vars", lambda v: ~F.array_contains("bound", v))).otherwise(
        F.exists("vars", lambda v: ~F.array_contains("bound", v) & F.array_contains("loose", v)))
    return rows.select("unit", "kind", "grp", "op", "vars", "args", "bound", (unknown | ~decidable(F.col("kind"), F.col("op"), F.col("args"))).alias("open"))


def _texts(unique: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conditions of the covered texts, and uq_id, var of what they BIND."""
    of_text = cut(text_conditions(unique.filter("covered")), "of_text")
    binds = of_text.filter("kind = 'bind'").select("uq_id", F.substr(F.get("vars", F.lit(0)), F.lit(3)).alias("var"))
    return of_text.filter("kind <> 'bind'"), binds


def _packed(own: DataFrame, units: DataFrame) -> DataFrame:
    """unit, todo of every unit; empty where there is no triple."""
    fields = ("pos", *M.ROLES, "n", "subjects", "objects")
    packed = own.groupBy("unit").agg(F.collect_list(F.struct(*fields)).alias("todo"))
    empty = F.array().cast("array<struct<pos:bigint,s:string,p:string,o:string,g:string,n:double,subjects:double,objects:double>>")
    return units.select("unit").join(packed, "unit", "left").withColumn("todo", F.coalesce(F.col("todo"), empty))


def smallest(rows: DataFrame, key: str, order: Column, most: int | None) -> DataFrame:
    """The `most` first rows of each key; Spark limits each task's groups before they are exchanged."""
    if most is None:
        return rows
    ranked = rows.withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy(order)))
    return ranked.filter(F.col("_rank") <= most).drop("_rank")


def with_answer(own: DataFrame, conditions: DataFrame, wanted: DataFrame, quads: DataFrame) -> DataFrame:
    """unit: those that have an answer (parameters as of ``solutions``).

    One answer is enough, so a first try follows a bounded number of bindings of each pattern; what it finds holds. Units without
    an answer there whose pattern had more bindings are matched in whole.
    """
    more: list[DataFrame] = []
    found = solutions(own, conditions, wanted, quads, more=more).select("unit").distinct()
    rest = cut(wanted.join(more[0], "unit", "left_semi").join(found, "unit", "left_anti"), "rest")
    if rest.isEmpty():
        return found
    whole = solutions(own.join(rest, "unit", "left_semi"), conditions.join(rest, "unit", "left_semi"), rest, quads)
    return found.unionByName(whole.select("unit").distinct())


def solutions(own: DataFrame, conditions: DataFrame, wanted: DataFrame, quads: DataFrame, most: int | None = None,
              more: list[DataFrame] | None = None) -> DataFrame:
    """unit, vals: the distinct bindings of the wanted variables of each unit that has an answer.

    own: ``match_units``; conditions: ``unit_conditions`` without open ones; wanted: unit, keep (names in the order of the result); most: how
    many rows of a pattern are wanted, the smallest in that order. They are picked before equal patterns of many units get theirs;
    units with a MINUS or EXISTS group keep all rows until the group is tested. more: gets a table of the units (unit) that may have more
    than the bounded number of bindings followed then (``match_some``); groups are always tested in whole.
    A variable with a list of terms (=, IN, VALUES) starts from them. MINUS and EXISTS groups are matched from the bindings of the
    variables they share with the rest, for all units at once, one group of each unit after the other.
    """
    none = F.array().cast("array<string>")
    inner = conditions.filter("kind = 'test'").select(
        F.concat_ws("#", "unit", "grp").alias("unit"), F.monotonically_increasing_id().alias("pos"),
        *[F.get("vars", F.lit(i)).alias(r) for i, r in enumerate(("s", "p", "o"))], F.lit(None).cast("string").alias("g"))
    own = cut(M.with_sizes(own.unionByName(inner), quads), "triples")
    tested = conditions.filter("kind = 'test'").select("unit", "grp", "op", F.array_intersect("vars", "bound").alias("shared"))
    shared = tested.groupBy("unit").agg(F.array_distinct(F.flatten(F.collect_set("shared"))).alias("shared"))
    plain = conditions.filter("kind in ('filter', 'values')").groupBy("unit").agg(F.collect_list(F.struct("op", "vars", "args")).alias("conds"))

    # the shortest list of terms a variable is limited to
    columns = F.size("vars")
    listed = (F.when((F.col("op") == "rows") & (columns > 0), F.transform(F.filter(F.sequence(F.lit(0), F.size("args") - 1), lambda i: i % columns == 0),
                                                                          lambda i: F.get("args", i)))
              .when(F.col("op").isin("eq", "in") & F.forall("args", lambda a: a.startswith("<")), F.col("args")))
    lists = conditions.filter("kind in ('filter', 'values') and size(args) > 0").select("unit", F.get("vars", F.lit(0)).alias("var"), listed.alias("terms"), "bound").filter(
        F.col("terms").isNotNull() & F.array_contains("bound", F.col("var")) & ~F.array_contains("terms", ""))
    lists = lists.groupBy("unit").agg(F.min(F.struct(F.size("terms").alias("n"), "var", F.array_sort(F.array_distinct("terms")).alias("terms"))).alias("list"))

    struct = "array<struct<op:string,vars:array<string>,args:array<string>>>"
    patterns = _packed(own, wanted).join(wanted, "unit").join(plain, "unit", "left").join(lists, "unit", "left").join(shared, "unit", "left").select(
        "unit", "todo", F.coalesce("conds", F.array().cast(struct)).alias("conds"),
        F.when(F.col("list").isNull(), none).otherwise(F.array("list.var")).alias("given"), F.col("list.terms").alias("terms"),
        F.array_union("keep", F.coalesce("shared", none)).alias("keep"), F.when(F.col("shared").isNotNull(), F.col("unit")).alias("apart"))
    ordered = cut(M.ordered_patterns(patterns), "ordered")
    if more is None:
        matched = M.match_all(ordered, quads)
    else:
        matched, bounded = M.match_some(ordered, quads)
        more.append(ordered.select("unit", "bgp").join(bounded, "bgp", "left_semi").select("unit"))
    if most is not None:
        kept = ordered.filter("apart is null").groupBy("bgp").agg(F.first("keep").alias("keep"))
        value = M.value_in(F.col("vals"))
        few = smallest(matched.join(kept, "bgp"), "bgp", F.transform("keep", value), most).select("bgp", "vals")
        matched = few.unionByName(matched.join(kept, "bgp", "left_anti"))
    found = _named(ordered, matched)
    if tested.isEmpty():
        return found
    found = cut(found, "found")
    groups = cut(tested.groupBy("unit", "grp", "op").agg(F.array_distinct(F.flatten(F.collect_set("shared"))).alias("shared"))
                 .withColumn("nth", F.row_number().over(W.partitionBy("unit").orderBy("grp"))), "groups")
    for nth in range(1, groups.agg(F.max("nth")).first()[0] + 1):
        now = groups.filter(F.col("nth") == nth)
        asked = found.join(now, "unit")
        part = F.array_sort(F.filter("vals", lambda v: F.array_contains("shared", v["var"])))
        asked = cut(asked.select("unit", "vals", "op", "shared", F.concat_ws("#", "unit", "grp").alias("test"), part.alias("part")), "asked")
        plans = now.select(F.concat_ws("#", "unit", "grp").alias("unit"), F.array_sort("shared").alias("given"))
        plans = _packed(own.join(plans, "unit", "left_semi"), plans).join(plans, "unit").select(
            "unit", "todo", F.array().cast(struct).alias("conds"), "given", F.lit(None).cast("array<string>").alias("terms"), F.col("given").alias("keep"),
            F.col("unit").alias("apart"))
        plans = cut(M.ordered_patterns(plans), "ordered")
        starts = asked.select(F.col("test").alias("unit"), "part").distinct().join(plans.select("unit", "bgp", "names"), "unit").select(
            "bgp", F.transform("part", lambda v: F.struct(F.concat(F.lit("?"), F.array_position("names", v["var"]).cast("string")).alias("var"), v["val"].alias("val"))).alias("vals"))
        holds_for = _named(plans, M.match_all(plans, quads, starts)).select(F.col("unit").alias("test"), F.array_sort("vals").alias("part")).distinct()
        yes = asked.join(holds_for, ["test", "part"], "left_semi").filter("op = 'exists'")
        no = asked.join(holds_for, ["test", "part"], "left_anti").filter("op <> 'exists'")
        # without a common variable MINUS takes nothing away
        apart = asked.filter("op = 'minus' and size(shared) = 0")
        kept = yes.unionByName(no).unionByName(apart).select("unit", "vals").unionByName(found.join(now, "unit", "left_anti"))
        found = cut(kept.distinct(), "found")
    return found


def _named(ordered: DataFrame, matched: DataFrame) -> DataFrame:
    """unit, vals with the names of each unit."""
    return ordered.select("unit", "bgp", "names").join(matched, "bgp").select("unit", F.transform("vals", lambda v: F.struct(
        F.get(F.col("names"), F.substr(v["var"], F.lit(2)).cast("int") - 1).alias("var"), v["val"].alias("val"))).alias("vals"))


#: Slices at the end of a text; a number of rows to skip is not counted, but a LIMIT of 0 leaves none.
NO_ROWS, SKIPS = r" LIMIT 0+(?: OFFSET [0-9]+)?$", r" OFFSET 0*[1-9][0-9]*(?: LIMIT [0-9]+)?$"


def restricted(quads: DataFrame, *triples: DataFrame) -> DataFrame:
    """Quads as keys, written once: those of the predicates that some triple names, or all if one has a variable there."""
    keyed = M.keyed_quads(quads)
    used = triples[0].select("p")
    for more in triples[1:]:
        used = used.unionByName(more.select("p"))
    used = cut(used.distinct(), "predicates")
    if used.filter(M.is_variable(F.col("p"))).isEmpty():
        keyed = keyed.join(used, "p", "left_semi")
    return cut(keyed.select("s", "p", "o", F.concat(F.lit("<"), "g", F.lit(">")).alias("g")), "quads")


def validity(unique: DataFrame, triples: DataFrame, quads: DataFrame) -> DataFrame:
    """uq_id, valid: does the query have an answer in the graph; null where patterns and conditions cannot decide it."""
    of_text, binds = _texts(unique)
    known = decided(unique, triples, binds).select(
        "uq_id", "one_row", "branches", F.col("norm_text").rlike(NO_ROWS).alias("no_rows"), F.col("norm_text").rlike(SKIPS).alias("skips"),
        (~F.contains("norm_text", F.lit("{"))).alias("bare"))
    known = cut(known, "decided")
    asked = known.filter("not one_row and not no_rows and not bare")
    own = triples.join(asked.select("uq_id"), "uq_id", "left_semi")
    units = cut(query_units(asked, own), "units")
    needed = cut(match_units(units, own), "needed")
    of_text = of_text.join(known.filter("not one_row and not no_rows"), "uq_id", "left_semi")
    conditions = cut(unit_conditions(units, of_text.filter("kind <> 'describe'"), needed, own, binds), "unit_conditions")
    open_units = conditions.filter("open").select("unit").distinct()
    keyed = restricted(quads, needed, conditions.filter("kind = 'test'").select(F.get("vars", F.lit(1)).alias("p")))
    todo = units.join(open_units, "unit", "left_anti").select("unit", F.array().cast("array<string>").alias("keep"))
    found = with_answer(needed.join(todo, "unit", "left_semi"), conditions.join(todo, "unit", "left_semi"), todo, keyed)
    status = units.select("unit", "uq_id").join(found.withColumn("hit", F.lit(True)), "unit", "left") \
        .join(open_units.withColumn("open", F.lit(True)), "unit", "left")
    # one branch with an answer is enough; without one, an undecided branch leaves the query undecided
    verdict = status.groupBy("uq_id").agg(F.max(F.coalesce("hit", F.lit(False))).alias("hit"), F.max(F.coalesce("open", F.lit(False))).alias("open"))
    named = of_text.filter("kind = 'describe'").select("uq_id", F.explode("args").alias("s"))
    described = named.join(M.keyed_quads(quads).select("s").join(named.select("s").distinct(), "s", "left_semi").distinct(), "s", "left_semi") \
        .select("uq_id", F.lit(True).alias("described")).distinct()
    rows = unique.select("uq_id").join(known.select("uq_id", "one_row", "no_rows", "skips", "bare"), "uq_id", "left") \
        .join(verdict, "uq_id", "left").join(described, "uq_id", "left")
    valid = (F.when(F.col("no_rows"), False).when(F.col("one_row"), ~F.col("skips")).when(F.col("described"), True)
             .when(F.col("bare"), False).when(F.col("hit"), F.when(~F.col("skips"), True)).when(~F.col("open"), False))
    return rows.select("uq_id", valid.alias("valid"))


def text_key(text: Column) -> Column:
    """The name a verdict is kept under: ids differ from log to log, texts do not."""
    return F.md5(text)


def validity_incremental(unique: DataFrame, triples: DataFrame, quads: DataFrame, cache: DataFrame) -> DataFrame:
    """Known verdicts from ``cache`` (text_key, valid), the others computed now."""
    named = unique.withColumn("text_key", text_key(F.col("norm_text")))
    todo = cut(named.join(cache, "text_key", "left_anti"), "todo")
    fresh = validity(todo, cut(triples.join(todo.select("uq_id"), "uq_id", "left_semi"), "todo_triples"), quads)
    return named.select("uq_id", "text_key").join(cache, "text_key").select("uq_id", "valid").unionByName(fresh)


# --- answers --------------------------------------------------------------------------------------------------------

def _parts(units: DataFrame, needed: DataFrame, conditions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """units (unit, whole, keep), triples and conditions with each unit split into parts that share no variable.

    A variable in two triples, in one condition or in one MINUS or EXISTS group ties them together. What has no variable goes
    to the first part.
    """
    def variables(*terms: Column) -> Column:
        return F.array_distinct(F.filter(F.array(*terms), lambda v: v.isNotNull() & v.startswith("?")))
    ties = needed.select("unit", variables(*[F.col(r) for r in M.ROLES]).alias("vs")).unionByName(
        conditions.filter("kind <> 'test'").select("unit", F.array_intersect("vars", "bound").alias("vs"))).unionByName(
        conditions.filter("kind = 'test'").groupBy("unit", "grp").agg(F.array_distinct(F.flatten(F.collect_list(F.array_intersect("vars", "bound")))).alias("vs"))
        .select("unit", "vs"))

    def merge(parts: Column, vs: Column) -> Column:
        return F.when(F.size(vs) == 0, parts).otherwise(F.array_append(
            F.filter(parts, lambda p: ~F.arrays_overlap(p, vs)),
            F.array_union(vs, F.flatten(F.filter(parts, lambda p: F.arrays_overlap(p, vs))))))
    parts = ties.groupBy("unit").agg(F.collect_list("vs").alias("ties")).select("unit", F.array_sort(F.transform(F.aggregate(
        "ties", F.array().cast("array<array<string>>"), merge), lambda p: F.array_sort(p))).alias("parts"))
    parts = cut(units.join(parts, "unit", "left").withColumn("parts", F.when(F.size("parts") > 0, F.col("parts")).otherwise(
        F.array(F.array().cast("array<string>")))), "parts")

    def named(vs: Column) -> Column:
        """The unit's name with the number of the part that holds the first of these variables."""
        first = F.array_position(F.transform("parts", lambda p: F.arrays_overlap(p, vs)), F.lit(True))
        return F.concat_ws("~", "unit", F.greatest(first, F.lit(1)).cast("string"))
    split = parts.select("unit", "keep", F.posexplode("parts").alias("nth", "own")).select(
        F.concat_ws("~", "unit", (F.col("nth") + 1).cast("string")).alias("unit"), F.col("unit").alias("whole"), (F.col("nth") + 1).alias("nth"),
        F.filter("keep", lambda v: F.array_contains("own", v)).alias("keep"))
    of = parts.select("unit", "parts")
    triples = needed.join(of, "unit").withColumn("unit", named(variables(*[F.col(r) for r in M.ROLES]))).drop("parts")
    # all triples of a group go where its first shared variable is
    shared = conditions.filter("kind = 'test'").groupBy("unit", "grp").agg(F.flatten(F.collect_list(F.array_intersect("vars", "bound"))).alias("shared"))
    rows = conditions.join(shared, ["unit", "grp"], "left").join(of, "unit")
    rows = rows.withColumn("unit", named(F.coalesce(F.col("shared"), F.array_intersect("vars", "bound")))).drop("parts", "shared")
    return split, triples, rows.select(*conditions.columns)


def bindings(unique: DataFrame, triples: DataFrame, quads: DataFrame, most: int | None = None) -> DataFrame:
    """uq_id, vals (array of var, val sorted by var): the distinct rows of the result variables of decided SELECT queries.

    most: how many rows of a query are wanted, the smallest ones (None: all). Parts of a pattern that share no variable are matched apart,
    and only their smallest rows are combined: a row that is not among the first of its part cannot be among the first of the whole.

    Left out are queries with a union, with expressions among the result variables, with BIND under ``*``, with a LIMIT of 0 or an
    OFFSET, or with a result variable that the triples outside optional parts do not bind.
    """
    head = F.regexp_extract("norm_text", r"(?s)^SELECT (?:DISTINCT |REDUCED )?(.*?) ?(?:WHERE )?\{", 1)
    of_text, binds = _texts(unique)
    plain = decided(unique, triples, binds).filter("form = 'SELECT' and branches = 0 and not one_row").filter(
        ~F.col("norm_text").rlike(NO_ROWS) & ~F.col("norm_text").rlike(SKIPS)).withColumn("head", head).filter(
        ~F.col("head").contains("(") & ((F.col("head") != "*") | ~F.col("binds")))
    terms = F.array(*[F.struct(F.col(f"{r}.kind").alias("kind"), F.col(f"{r}.value").alias("value")) for r in ("s", "p", "o")],
                    F.struct(X.term_struct(F.col("graph"))["kind"].alias("kind"), X.term_struct(F.col("graph"))["value"].alias("value")))
    used = triples.filter("part in ('required', 'optional')").select("uq_id", "part", F.explode(terms).alias("t")).filter("t.kind = 'variable'").groupBy("uq_id").agg(
        F.collect_set("t.value").alias("every"), F.collect_set(F.when(F.col("part") == "required", F.col("t.value"))).alias("bound"))
    none = F.array().cast("array<string>")
    shown = F.when(F.col("head") == "*", F.coalesce("every", none)).otherwise(
        F.transform(F.split("head", " "), lambda v: F.substr(v, F.lit(2))))
    asked = plain.join(used, "uq_id", "left").withColumn("shown", F.array_sort(F.array_distinct(shown))).filter(
        F.size(F.array_except("shown", F.coalesce("bound", none))) == 0)
    asked = cut(asked.select("uq_id", "shown"), "asked")
    own = triples.join(asked.select("uq_id"), "uq_id", "left_semi")
    units = asked.select(F.col("uq_id").cast("string").alias("unit"), "uq_id", F.lit(None).cast("int").alias("branch"), F.transform(
        "shown", lambda v: F.concat(F.lit("?v"), v)).alias("keep"))
    needed = cut(match_units(units.select("unit", "uq_id"), own), "needed")
    conditions = cut(unit_conditions(units.select("unit", "uq_id", "branch"), of_text, needed, own, binds), "unit_conditions")
    todo = units.join(conditions.filter("open").select("unit").distinct(), "unit", "left_anti").select("unit", "uq_id", "keep")
    keyed = restricted(quads, needed, conditions.filter("kind = 'test'").select(F.get("vars", F.lit(1)).alias("p")))
    parts, own, of_part = _parts(todo.select("unit", "keep"), needed.join(todo, "unit", "left_semi"), conditions.join(todo, "unit", "left_semi"))
    parts = cut(parts, "parts")
    found = solutions(own, of_part, parts.select("unit", "keep"), keyed, most).join(parts, "unit")
    found = found.select("whole", "nth", F.array_sort(F.filter("vals", lambda v: F.array_contains("keep", v["var"]))).alias("vals")).distinct()
    found = cut(smallest(found.withColumn("part", F.concat_ws("~", "whole", F.col("nth").cast("string"))), "part", F.col("vals"), most), "found")
    out = found.filter("nth = 1").select("whole", "vals")
    for nth in range(2, (parts.agg(F.max("nth")).first()[0] or 1) + 1):
        # a unit without this part keeps its rows; one whose part has no row has no answer
        more = parts.filter(F.col("nth") == nth).select("whole")
        joined = out.join(found.filter(F.col("nth") == nth).select("whole", F.col("vals").alias("with")), "whole")
        joined = smallest(joined.select("whole", F.array_sort(F.concat("vals", "with")).alias("vals")), "whole", F.col("vals"), most)
        out = cut(out.join(more, "whole", "left_anti").unionByName(joined), "combined")
    plain = F.transform("vals", lambda v: F.struct(F.substr(v["var"], F.lit(3)).alias("var"), v["val"].alias("val")))
    return out.join(todo, out["whole"] == todo["unit"]).select("uq_id", plain.alias("vals"))


def first_binding(answers: DataFrame) -> DataFrame:
    """uq_id, var, value: one answer per query, the smallest; folded map-side, never collected."""
    first = answers.groupBy("uq_id").agg(F.min("vals").alias("vals"))
    return first.select("uq_id", F.inline("vals")).withColumnRenamed("val", "value")


def result_signature(answers: DataFrame, top: int = 5) -> DataFrame:
    """uq_id, n_vars, sig: the number of variables and the first ``top`` distinct rows of the answer, ordered."""
    text = F.array_join(F.transform("vals", lambda v: F.concat(v["var"], F.lit(" "), v["val"])), ", ")
    rows = answers.select("uq_id", F.size("vals").alias("n_vars"), "vals", text.alias("row")).distinct()
    rank = F.row_number().over(W.partitionBy("uq_id").orderBy("vals"))
    kept = rows.withColumn("rank", rank).filter(F.col("rank") <= top)
    return kept.groupBy("uq_id").agg(F.max("n_vars").cast("bigint").alias("n_vars"), F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "row"))), lambda r: r["row"]), "; ").alias("sig"))


def equivalent_queries(keys: DataFrame, signatures: DataFrame) -> DataFrame:
    """uq_id, same_as: queries with the same simplified triples and answers, each with the smallest id of its class.

    A class of n queries gives n rows, not n * n pairs.
    """
    rows = keys.join(signatures, "uq_id")
    first = rows.groupBy("key", "n_vars", "sig").agg(F.min("uq_id").alias("same_as"), F.count("*").alias("size"))
    return rows.join(first.filter("size > 1"), ["key", "n_vars", "sig"]).select("uq_id", "same_as")


# --- term to query --------------------------------------------------------------------------------------------------

def touching(triples: DataFrame, ranked: DataFrame) -> DataFrame:
    """Triple patterns with a ranked term in any role; each role is tested by its own semi-join and kept once."""
    out = None
    for role in ("s", "p", "o"):
        part = triples.withColumn("term", F.when(F.col(f"{role}.kind") == "uri", F.col(f"{role}.value"))).join(
            ranked.select("term").distinct(), "term", "left_semi").drop("term")
        out = part if out is None else out.unionByName(part)
    return out.dropDuplicates(["uq_id", "pos"])


def iri_query_index(triples: DataFrame, valid: DataFrame, ranked: DataFrame, key: str = "subject") -> DataFrame:
    """term, uq_id, n: valid queries per IRI, one count per touching triple; keyed by the subject or by any role."""
    rows = touching(triples, ranked).join(valid.filter("valid"), "uq_id", "left_semi")
    roles: Sequence[str] = ("s",) if key == "subject" else ("s", "p", "o")
    terms = F.array_distinct(F.array(*[F.struct(F.col(f"{r}.kind").alias("kind"), F.col(f"{r}.value").alias("term"))
                                       for r in roles]))
    return (rows.select("uq_id", F.explode(terms).alias("c")).filter("c.kind = 'uri'")
            .groupBy("c.term", "uq_id").agg(F.count("*").alias("n")))


def stripped(unique: DataFrame) -> DataFrame:
    """uq_id, query without LIMIT and OFFSET."""
    return unique.select("uq_id", X.strip_limit_offset(F.col("norm_text")).alias("query"))
