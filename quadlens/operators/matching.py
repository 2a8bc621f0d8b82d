"""Matching graph patterns against quads with joins.

``bgp_match`` answers one pattern shape for a table of constants. ``match_all`` answers many different basic graph patterns with
their conditions in one set of joins: step k joins the k-th triple of every pattern, whatever its shape.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadlens.functions import text as X
from quadlens.operators.conditions import holds
from quadlens.session import cut


def keyed_quads(quads: DataFrame) -> DataFrame:
    """s, p, o as comparable term keys (IRIs in angle brackets, literals with datatype or language), and g."""
    def iri(name: str) -> Column:
        return F.concat(F.lit("<"), name, F.lit(">"))
    return quads.select(iri("s").alias("s"), iri("p").alias("p"), X.term_key(
        F.col("o_kind"), F.col("o"), F.col("datatype"), F.col("lang")).alias("o"), "g")


# --- one shape ----------------------------------------------------------------------------------------------------

def triple(quads: DataFrame, s: str, p: str, o: str) -> DataFrame:
    """Matches of one triple pattern: ``?x`` names a column, anything else is a constant; repeated names must agree."""
    places: dict[str, list[str]] = {}
    for column, term in (("s", s), ("p", p), ("o", o)):
        if term.startswith("?"):
            places.setdefault(term[1:], []).append(column)
        else:
            quads = quads.filter(F.col(column) == term)
    for columns in places.values():
        for other in columns[1:]:
            quads = quads.filter(F.col(columns[0]) == F.col(other))
    return quads.select(*[F.col(columns[0]).alias(name) for name, columns in places.items()])


def bgp_match(patterns: Sequence[tuple[str, str, str]], quads: DataFrame, constants: DataFrame | None = None) -> DataFrame:
    """Bindings of a basic graph pattern; columns of ``constants`` act as variables bound per row (``?name``).

    The pattern starts from the constants, so each row only meets quads that share a term with it.
    """
    todo = list(patterns)
    out = constants
    while todo:
        bound = set(out.columns) if out is not None else set()
        nxt = max(todo, key=lambda t: sum(not x.startswith("?") or x[1:] in bound for x in t))
        todo.remove(nxt)
        rows = triple(quads, *nxt)
        shared = [name for name in rows.columns if name in bound]
        if out is None:
            out = rows
        elif shared:
            out = out.join(rows, shared)
        else:
            raise ValueError("patterns must be connected")
    return out


def optional(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on), "left")


def union_branches(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def minus(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on), "left_anti")


def exists(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on), "left_semi")


def values_join(df: DataFrame, data: DataFrame) -> DataFrame:
    return df.join(data, [c for c in data.columns if c in df.columns])


def is_iri(term: Column) -> Column:
    return term.startswith("<")


def is_literal(term: Column) -> Column:
    return term.startswith('"')


def lang(term: Column) -> Column:
    return F.regexp_extract(term, r"(?s)^\x22.*\x22@([A-Za-z0-9\-]+)$", 1)


def lang_matches(term: Column, tag: str) -> Column:
    return (lang(term) == tag.lower()) | lang(term).startswith(tag.lower() + "-")


def str_value(term: Column) -> Column:
    """Lexical form of a literal, text of an IRI."""
    return (F.when(term.startswith("<"), F.substr(term, F.lit(2), F.length(term) - 2))
            .otherwise(F.regexp_extract(term, r"(?s)^\x22(.*)\x22(?:@[A-Za-z0-9\-]+|\^\^[^\x22]*)$", 1)))


def str_after(value: Column, mark: str) -> Column:
    at = F.instr(value, mark)
    return F.when(at > 0, F.substr(value, at + len(mark))).otherwise(F.lit(""))


def graph(quads: DataFrame, name: str) -> DataFrame:
    return quads.filter(F.col("g") == name)


def path_sequence(quads: DataFrame, first: str, second: str) -> DataFrame:
    """x, y linked by first/second."""
    return bgp_match([("?x", first, "?z"), ("?z", second, "?y")], quads).select("x", "y")


def path_alternative(quads: DataFrame, predicates: Sequence[str]) -> DataFrame:
    return quads.filter(F.col("p").isin(*predicates)).select(F.col("s").alias("x"), F.col("o").alias("y")).distinct()


def path_closure(quads: DataFrame, predicate: str, start: DataFrame | None = None, zero: bool = False, steps: int | None = None) -> DataFrame:
    """x, y linked by one or more steps of ``predicate``; with ``zero`` also each node with itself.

    ``start`` (column x) asks only for what its nodes reach, at most ``steps`` steps away: each round follows the new pairs
    of the last one. Without it, paths double in length each round, so a chain of length n takes log2(n) rounds; a node that many
    ways go through is dealt out to several tasks. Every round is written to shared storage. The loop ends with the first round
    that finds no new pair.
    """
    edges = quads.filter(F.col("p") == predicate).select(F.col("s").alias("x"), F.col("o").alias("y")).distinct()
    if start is None and steps is None:
        # known: less than 2 ** k steps apart; far: the pairs whose shortest way has 2 ** k. A longer way begins with a far pair and goes on
        # with a known one, so in a tree each pair is made once
        known, far = None, cut(edges, "far")
        while not far.isEmpty():
            fresh = far if known is None else far.unionByName(_lacking(cut(linked(far, known), "longer"), far, known))
            longer = cut(linked(far, far), "longer")
            known = cut(fresh, "closure") if known is None else known.unionByName(cut(fresh, "closure"))
            far = cut(_lacking(longer, known), "far", [longer])
        known = edges if known is None else known
        nodes = known.select("x").union(known.select("y"))
    else:
        nodes = (edges.select("x").union(edges.select("y")) if start is None else start.select("x")).distinct()
        edges = cut(edges, "edges")
        known = front = cut(nodes.join(edges, "x").select("x", "y"), "closure")
        done = 1
        while (steps is None or done < steps) and not front.isEmpty():
            found = front.join(edges.select(F.col("x").alias("y"), F.col("y").alias("z")), "y").select("x", F.col("z").alias("y")).distinct()
            front = cut(found.join(known, ["x", "y"], "left_anti"), "closure")
            known, done = known.unionByName(front), done + 1
    return known.union(nodes.select("x", F.col("x").alias("y"))).distinct() if zero else known


def linked(first: DataFrame, second: DataFrame) -> DataFrame:
    """x, y of the pairs x, z of the first table and z, y of the second, with repeats; a z of many pairs is dealt out to several tasks."""
    a, b = first.select(F.col("y").alias("key"), "x"), second.select(F.col("x").alias("key"), "y")
    of_a, of_b = bucket_counts(a), bucket_counts(b)
    on = ["key", "a_part", "b_part"]
    tasks = max(8, -(-(first.count() + second.count()) // TASK))
    a = dealt(a, of_a, of_b, ["x"], ("a_part", "b_part")).repartition(tasks, *on)
    b = dealt(b, of_b, of_a, ["y"], ("b_part", "a_part")).repartition(tasks, *on)
    return a.join(b, on).select("x", "y")


def _lacking(pairs: DataFrame, *known: DataFrame) -> DataFrame:
    """The distinct pairs x, y that no other table has; the number of tasks follows the rows."""
    tasks = max(8, -(-(pairs.count() + sum(k.count() for k in known)) // TASK))
    out = pairs.repartition(tasks, "x", "y").distinct()
    for k in known:
        out = out.join(k.repartition(tasks, "x", "y"), ["x", "y"], "left_anti")
    return out


def path_groups(quads: DataFrame, predicate: str) -> DataFrame:
    """node, grp: nodes that reach each other by ``predicate`` have the same group, named by its smallest member.

    Nodes without a link in or without one out are groups of their own and go, round by round. In what is left every node
    learns the smallest node that reaches it; a node that learns only itself is the smallest of its group, and the group is what
    reaches it among the nodes that learned the same. These go too, until no link is left. A cycle of n nodes costs n rows, not
    n * n pairs. Rounds are as many as the longest way a label has to go; each is written to shared storage.
    """
    links = quads.filter(F.col("p") == predicate).select(F.col("s").alias("x"), F.col("o").alias("y")).distinct()
    whole = cut(links, "links")
    edges = cut(whole.filter("x <> y"), "links")
    groups = None
    while not edges.isEmpty():
        inner = edges.select("x").intersect(edges.select("y"))
        kept = cut(_among(edges, inner.withColumnRenamed("x", "node")), "links")
        if kept.count() < edges.count():
            edges = kept
            continue
        label = cut(inner.select(F.col("x").alias("node"), F.col("x").alias("label"), F.lit(True).alias("new")), "labels")
        while not label.filter("new").isEmpty():
            # only labels that changed are passed on
            sent = edges.join(label.filter("new").select(F.col("node").alias("x"), "label"), "x").groupBy(F.col("y").alias("node")).agg(F.min("label").alias("sent"))
            smaller = F.col("sent") < F.col("label")
            label = cut(label.join(sent, "node", "left").select("node", F.when(smaller, F.col("sent")).otherwise(F.col("label")).alias("label"),
                                                               F.coalesce(smaller, F.lit(False)).alias("new")), "labels", [label])
        of = label.select("node", "label")
        inside = edges.join(of.toDF("x", "label"), "x").join(of.toDF("y", "label"), ["y", "label"])
        inside = cut(inside.select("x", "y", "label"), "inside")
        found = front = cut(of.filter("node = label"), "reached")
        while not front.isEmpty():
            before = inside.join(front.toDF("y", "label"), ["y", "label"]).select(F.col("x").alias("node"), "label").distinct()
            front = cut(before.join(found, ["node", "label"], "left_anti"), "reached")
            found = found.unionByName(front)
        found = cut(found, "groups")
        groups = found if groups is None else groups.unionByName(found)
        edges = cut(_among(edges, label.select("node").join(found, "node", "left_anti")), "links")
    nodes = whole.select(F.col("x").alias("node")).union(whole.select("y")).distinct()
    if groups is None:
        return nodes.select("node", F.col("node").alias("grp"))
    return nodes.join(groups, "node", "left").select("node", F.coalesce("label", "node").alias("grp"))


def _among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links with both ends among the nodes."""
    return edges.join(nodes.toDF("x"), "x", "left_semi").join(nodes.toDF("y"), "y", "left_semi").select("x", "y")


def condensed_closure(quads: DataFrame, predicate: str, groups: DataFrame) -> DataFrame:
    """x, y: groups (see ``path_groups``) whose members are linked by one or more steps; a group with a cycle is linked with itself.

    Joined with the groups on both sides this is ``path_closure`` without having been written pair by pair of nodes.
    """
    groups = cut(groups, "groups")
    links = quads.filter(F.col("p") == predicate).select(F.col("s").alias("x"), F.col("o").alias("y"))
    links = links.join(groups.toDF("x", "s"), "x").join(groups.toDF("y", "o"), "y")
    return path_closure(links.select("s", F.lit(predicate).alias("p"), "o"), predicate)


def construct(bindings: DataFrame, template: Sequence[tuple[Column, Column, Column]]) -> DataFrame:
    """s, p, o triples of a template for every binding, without repeats or incomplete triples."""
    rows = F.array(*[F.struct(s.alias("s"), p.alias("p"), o.alias("o")) for s, p, o in template])
    return bindings.select(F.inline(rows)).dropna().distinct()


def ask(matches: DataFrame) -> DataFrame:
    return matches.limit(1).agg((F.count("*") > 0).alias("answer"))


def describe(quads: DataFrame, resources: DataFrame, as_object: bool = False) -> DataFrame:
    """Quads about the resources (column term), as subject and optionally as object."""
    side = "o" if as_object else "s"
    found = quads.join(resources.select(F.col("term").alias(side)).distinct(), side, "left_semi")
    return found if not as_object else found.unionByName(describe(quads, resources)).distinct()


# --- many shapes at once --------------------------------------------------------------------------------------------

ROLES = ("s", "p", "o", "g")
VALS = "array<struct<var:string,val:string>>"


def is_variable(term: Column) -> Column:
    return term.startswith("?")


def graph_sizes(quads: DataFrame) -> DataFrame:
    """p, n_p, n_s, n_o of each predicate, and of the whole graph under a null p: quads, and estimates of their distinct subjects and
    objects (partial aggregations, no exchange of the quads)."""
    of_p = cut(quads.groupBy("p").agg(F.count("*").alias("n_p"), F.approx_count_distinct("s").alias("n_s"), F.approx_count_distinct("o").alias("n_o")), "sizes")
    return of_p.unionByName(of_p.agg(F.lit(None).cast("string").alias("p"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_p", "n_s", "n_o")]))


def with_sizes(triples: DataFrame, quads: DataFrame) -> DataFrame:
    """Triples (s, p, o as names or keys) with what the graph holds for their constants: n, subjects, objects.

    Quads of a predicate and an object are counted where both are constants.
    """
    pairs = triples.filter(~is_variable(F.col("p")) & ~is_variable(F.col("o"))).select("p", "o").distinct()
    of_po = quads.select("p", "o").join(pairs, ["p", "o"], "left_semi").groupBy("p", "o").agg(F.count("*").alias("n_po"))
    of_p = graph_sizes(quads).withColumnRenamed("p", "of")
    rows = triples.join(of_p, F.when(~is_variable(F.col("p")), F.col("p")).eqNullSafe(F.col("of")), "left").join(of_po, ["p", "o"], "left")

    def size(name: str) -> Column:
        return F.coalesce(name, F.lit(0)).cast("double")
    n = (F.when(is_variable(F.col("o")), size("n_p")).when(is_variable(F.col("p")), size("n_p") / F.greatest(size("n_o"), F.lit(1.0)))
         .otherwise(size("n_po")))
    n = F.when(is_variable(F.col("s")), n).otherwise(n / F.greatest(size("n_s"), F.lit(1.0)))
    return rows.select(*triples.columns, n.alias("n"), F.greatest(size("n_s"), F.lit(1.0)).alias("subjects"),
                       F.greatest(size("n_o"), F.lit(1.0)).alias("objects"))


def ordered_patterns(patterns: DataFrame) -> DataFrame:
    """unit, names, bgp, steps, conds, given, keep: the triples of each pattern in join order.

    patterns: unit, todo (array of pos, s, p, o, g, n, subjects, objects), conds (array of op, vars, args), given (variables bound at the
    start), terms (of the first given one, null if a table gives them), keep (variables to return, in this order) and apart (null, or a
    key of patterns that must not be folded). The next triple is the one that is expected to multiply the bindings least, by the
    sizes of its constants and the variables bound so far. Variables are renamed by first use, so equal patterns of
    different queries get the same ``bgp`` and are matched once.
    """
    def variables(t: Column) -> Column:
        return F.filter(F.array(*[t[r] for r in ROLES]), lambda x: x.isNotNull() & is_variable(x))

    def pick(acc: Column, _: Column) -> Column:
        def score(t: Column) -> Column:
            def known(r: str) -> Column:
                return is_variable(t[r]) & F.array_contains(acc["bound"], t[r])
            size = t["n"] / F.when(known("s"), t["subjects"]).otherwise(1.0) / F.when(known("o"), t["objects"]).otherwise(1.0)
            return F.struct(size.alias("size"), t["pos"].alias("first"), t.alias("t"))
        best = F.array_min(F.transform(acc["todo"], score))["t"]
        return X.let(best, lambda b: F.struct(
            F.filter(acc["todo"], lambda t: t["pos"] != b["pos"]).alias("todo"),
            F.array_append(acc["done"], b).alias("done"),
            F.array_union(acc["bound"], variables(b)).alias("bound")))

    start = F.struct(F.col("todo").alias("todo"), F.slice("todo", 1, 0).alias("done"), F.col("given").alias("bound"))
    rows = patterns.withColumn("plan", F.aggregate(F.transform("todo", lambda t: t["pos"]), start, pick))

    def renamed(x: Column) -> Column:
        place = F.array_position(F.col("plan.bound"), x)
        return F.when(x.isNotNull() & is_variable(x), F.when(place > 0, F.concat(F.lit("?"), place.cast("string"))).otherwise("?0")).otherwise(x)
    rows = rows.select(
        "unit", F.col("plan.bound").alias("names"),
        F.transform("plan.done", lambda t: F.struct(*[renamed(t[r]).alias(r) for r in ROLES])).alias("steps"),
        F.transform("conds", lambda c: F.struct(c["op"].alias("op"), F.transform(c["vars"], renamed).alias("vars"), c["args"].alias("args"))).alias("conds"),
        F.transform("given", renamed).alias("given"), "terms", F.transform("keep", renamed).alias("keep"), "apart")
    return rows.withColumn("bgp", F.md5(F.to_json(F.struct("steps", "conds", "given", "terms", "keep", "apart"))))


def starts_of(ordered: DataFrame) -> DataFrame:
    """bgp, vals: the bindings each distinct pattern starts with: none, or one row for each term of its first given variable."""
    none = F.array(F.array().cast(VALS))
    rows = F.when(F.col("terms").isNull(), none).otherwise(F.transform(
        "terms", lambda t: F.array(F.struct(F.get("given", F.lit(0)).alias("var"), t.alias("val")))))
    return ordered.groupBy("bgp").agg(F.first("given").alias("given"), F.first("terms").alias("terms")).select("bgp", F.explode(rows).alias("vals"))


def pattern_steps(ordered: DataFrame) -> DataFrame:
    """One row per distinct pattern and step, with the lookup mask: which of s, p, o, g are constants or bound."""
    once = ordered.groupBy("bgp").agg(*[F.first(c).alias(c) for c in ("steps", "conds", "given", "keep")])

    def variables(steps: Column) -> Column:
        return F.array_distinct(F.filter(F.flatten(F.transform(steps, lambda t: F.array(*[t[r] for r in ROLES]))), lambda x: x.isNotNull() & is_variable(x)))

    def ready(c: Column, bound: str) -> Column:
        return F.forall(c["vars"], lambda v: F.array_contains(bound, v) | ~F.array_contains("every", v))
    rows = once.select("*", F.size("steps").alias("n_steps"), F.array_union("given", variables(F.col("steps"))).alias("every"),
                       F.posexplode("steps").alias("step", "t"))
    rows = rows.select("*", F.array_union("given", variables(F.slice("steps", F.lit(1), F.col("step")))).alias("before"))
    rows = rows.select("*", F.array_union("before", variables(F.array("t"))).alias("after"))
    waiting = F.filter("conds", lambda c: ~ready(c, "after"))
    rows = rows.select(
        "bgp", "n_steps", "step", "t.*", "before", "keep",
        F.filter("conds", lambda c: ready(c, "after") & ((F.col("step") == 0) | ~ready(c, "before"))).alias("conds"),
        F.array_union(F.array_union("keep", F.flatten(F.transform(waiting, lambda c: c["vars"]))),
                      variables(F.slice("steps", F.col("step") + 2, F.greatest(F.col("n_steps") - F.col("step") - 1, F.lit(0))))).alias("later"))
    for r in ROLES:
        rows = rows.withColumn(f"has_{r}", F.col(r).isNotNull() & (~is_variable(F.col(r)) | F.array_contains("before", F.col(r))))
    new = F.filter(F.array(*[F.when(F.col(r).isNotNull() & ~F.col(f"has_{r}"), F.col(r)) for r in ROLES]), lambda x: x.isNotNull())
    wanted = F.array_union("later", F.flatten(F.transform("conds", lambda c: c["vars"])))
    mask = F.concat(*[F.when(F.col(f"has_{r}"), r).otherwise("") for r in ROLES])
    # a repeated fresh variable (?a p ?a) has to be compared, so it needs the quad itself
    needs = (F.size(new) > F.size(F.array_distinct(new))) | (F.size(F.array_intersect(new, wanted)) > 0)
    return rows.select("bgp", "n_steps", "step", *ROLES, *[f"has_{r}" for r in ROLES], "conds", "later", mask.alias("mask"), needs.alias("needs"))


def value_in(vals: Column):
    return lambda name: F.get(F.filter(vals, lambda v: v["var"] == name), F.lit(0))["val"]


#: Rows of one key that go to one part of a join, rows a task of a join takes, and rows of a side that is copied to all tasks.
PART, TASK, SMALL = 200_000, 500_000, 20_000
BUCKETS = 1 << 16


def bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS))


def bucket_counts(rows: DataFrame) -> DataFrame:
    """bucket, n: rows (column key) in each bucket of keys, counted map-side; at most BUCKETS rows."""
    return cut(rows.groupBy(bucket(F.col("key")).alias("bucket")).agg(F.count("*").alias("n")), "buckets")


def dealt(rows: DataFrame, own: DataFrame, other: DataFrame, by: Sequence[str], parts: tuple[str, str]) -> DataFrame:
    """Rows with two more columns for a join on key and both: rows of a bucket with more than PART rows are dealt out by a hash of ``by``,
    and go to each part of what the other side deals out. Buckets with more are at most one for each PART rows of a table."""
    def hot(counts: DataFrame, name: str) -> DataFrame:
        return F.broadcast(counts.filter(F.col("n") > PART).select("bucket", F.ceil(F.col("n") / PART).alias(name)))
    rows = rows.withColumn("bucket", bucket(F.col("key"))).join(hot(own, "n_own"), "bucket", "left").join(hot(other, "n_other"), "bucket", "left")
    rows = rows.withColumn(parts[0], F.pmod(F.xxhash64(*by), F.coalesce("n_own", F.lit(1)))).withColumn(
        parts[1], F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("n_other", F.lit(1)) - 1)))
    return rows.drop("bucket", "n_own", "n_other")


#: Bindings of a pattern that a first try follows; Spark cuts groups of up to 1000 rows before they are exchanged.
PROBE = 500


def match_some(ordered: DataFrame, quads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bindings as of ``match_all``, but every step follows at most PROBE of each pattern; and bgp of the patterns that had more.

    What is found holds. A pattern of the second table may have further bindings, also if none was found.
    """
    more: list[DataFrame] = []
    found = match_all(ordered, quads, most=PROBE, more=more)
    out = ordered.select("bgp").limit(0)
    for part in more:
        out = out.unionByName(part)
    return found, out.distinct()


def match_all(ordered: DataFrame, quads: DataFrame, starts: DataFrame | None = None, most: int | None = None, more: list[DataFrame] | None = None) -> DataFrame:
    """bgp, vals for every distinct pattern that matches: the distinct bindings of the variables it keeps.

    A variable is dropped as soon as no later step or condition needs it and equal bindings are folded, so a step without needed
    variables is a semi-join and a pattern never multiplies its rows by matches nobody asked for. Every quad offers one key for each
    lookup mask of a step. Masks with few bindings are copied to all tasks and share one scan, so the quads stay where they are; for a
    mask with many, only quads of the predicates that its bindings name are exchanged. Conditions are tested
    at the first step that has all their variables. A key that many quads or many bindings share is dealt out to several tasks, and the
    number of tasks follows the rows, not their packed bytes, so no task holds more for a larger graph. most, more: see ``match_some``.
    """
    state = starts_of(ordered) if starts is None else starts
    bare = ordered.filter("size(steps) = 0").groupBy("bgp").agg(F.first("conds").alias("conds"))
    # a pattern without triples binds nothing that a filter could look at; what may be left is inline data
    done = state.join(bare, "bgp").filter(F.forall("conds", lambda c: F.size(c["args"]) > 0)).select("bgp", "vals")
    steps = cut(pattern_steps(ordered), "steps")
    # which kinds of lookups and tests occur: at most 32 rows per step, and 30 tests, whatever the number of patterns
    kinds = sorted(tuple(r) for r in steps.select("step", "mask", "needs").distinct().collect())
    tests = steps.select("step", F.explode(F.transform("conds", lambda c: c["op"])).alias("op")).distinct().collect()

    def key(mask: str, prefix: str) -> Column:
        return F.concat_ws("\x1f", F.lit(mask), *[F.col(f"{prefix}{r}") for r in mask])

    def offers(masks: Sequence[str], rows: DataFrame | None) -> DataFrame:
        """The quads under their keys for these masks; with rows (bindings) only those of the predicates that rows of the mask name."""
        def of(quads: DataFrame, masks: Sequence[str]) -> DataFrame:
            keyed = quads.select(*ROLES, F.explode(F.array(*[key(m, "") for m in masks])).alias("key"))
            return keyed.select("key", *[F.col(r).alias(f"q_{r}") for r in ROLES])
        if rows is None:
            return of(quads, masks)
        out = None
        for m in masks:
            named = rows.filter(F.col("mask") == m).select(F.col("k_p").alias("p")).distinct()
            part = of(quads.join(cut(named, "predicates"), "p", "left_semi") if "p" in m else quads, [m])
            out = part if out is None else out.unionByName(part)
        return out

    for step in range(max((k[0] for k in kinds), default=-1) + 1):
        here = state.join(steps.filter(F.col("step") == step), "bgp")
        bound = value_in(F.col("vals"))
        here = here.select("*", *[F.when(is_variable(F.col(r)), bound(F.col(r))).otherwise(F.col(r)).alias(f"k_{r}") for r in ROLES])
        own = F.lit(None)
        for mask in sorted({k[1] for k in kinds if k[0] == step}):
            own = F.when(F.col("mask") == mask, key(mask, "k_")).otherwise(own)
        here = cut(here.withColumn("key", own), "asked")
        sizes = {(r["mask"], r["needs"]): r["count"] for r in here.groupBy("mask", "needs").count().collect()}  # at most 32 rows
        lots: dict[tuple[bool, bool], list[str]] = {}
        copied = 0
        for (mask, needs), n in sorted(sizes.items(), key=lambda x: (x[1], x[0])):
            copied += n
            lots.setdefault((needs, copied > SMALL), []).append(mask)
        parts = []
        for (needs, large), masks in lots.items():
            rows = here.filter((F.col("needs") == needs) & F.col("mask").isin(masks))
            offered = offers(masks, rows if large else None)
            on = ["key"]
            if large:
                asked, crowd = bucket_counts(rows), bucket_counts(offered)
                n_offered = crowd.agg(F.sum("n")).first()[0] or 0
                n_tasks = max(8, -(-(n_offered + sum(sizes[m, needs] for m in masks)) // TASK))
                on = ["key", "part", "row_part"]
                offered = dealt(offered, crowd, asked, [f"q_{r}" for r in ROLES], ("part", "row_part")).repartition(n_tasks, *on)
            if needs:
                rows = dealt(rows, asked, crowd, ["bgp", "vals"], ("row_part", "part")).repartition(n_tasks, *on) if large else F.broadcast(rows)
                found = offered.join(rows, on)
                for i, a in enumerate(ROLES):
                    for b in ROLES[i + 1:]:
                        fresh = ~F.col(f"has_{a}") & ~F.col(f"has_{b}") & F.coalesce(F.col(a) == F.col(b), F.lit(False))
                        found = found.filter(~fresh | (F.col(f"q_{a}") == F.col(f"q_{b}")))
                new = F.filter(F.array(*[F.struct(F.when(~F.col(f"has_{r}"), F.col(r)).alias("var"), F.col(f"q_{r}").alias("val")) for r in ROLES]),
                               lambda v: v["var"].isNotNull())
                rows = found.withColumn("vals", F.concat("vals", F.array_distinct(new).cast(VALS)))
            else:
                # the patterns' keys are the small side: they thin out the quads, and what is left of these answers
                if large:
                    # each key once for each part of its quads; the parts of the bindings are those of the second join
                    rows = dealt(rows, asked, crowd, ["bgp", "vals"], ("row_part", "part")).repartition(n_tasks, *on)
                    known = offered.select(*on).join(rows.select(*on).distinct(), on, "left_semi").select("key", "row_part").distinct()
                    rows = rows.filter("part = 0").join(known, ["key", "row_part"], "left_semi")
                else:
                    known = offered.select("key").join(F.broadcast(rows.select("key").distinct()), "key", "left_semi").distinct()
                    rows = rows.join(F.broadcast(known), "key", "left_semi")
            parts.append(rows.select("bgp", "n_steps", "conds", "later", "vals"))
        if not parts:
            break  # no binding is left
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        if ops := [r["op"] for r in tests if r["step"] == step]:
            out = out.filter((F.size("conds") == 0) | F.forall("conds", lambda c: holds(c, value_in(F.col("vals")), ops)))
        out = out.select("bgp", "n_steps", F.array_sort(F.filter("vals", lambda v: F.array_contains("later", v["var"]))).alias("vals"))
        if most is None:
            out = cut(out.distinct(), "bindings")
        else:
            rank = F.row_number().over(W.partitionBy("bgp").orderBy(F.xxhash64("vals")))
            out = out.withColumn("rank", rank).filter(F.col("rank") <= most)
            out = cut(out.groupBy("bgp", "n_steps", "vals").agg((F.max("rank") == most).alias("cut")), "bindings")
            more.append(out.filter("cut").select("bgp"))
        done = done.unionByName(out.filter(F.col("n_steps") == step + 1).select("bgp", "vals"))
        state = out.filter(F.col("n_steps") > step + 1).select("bgp", "vals")
    return done
