"""Personal data by boosted candidates, with column expressions only.

Strict patterns give the base spans. Two generators with high recall propose further, overlapping spans: number-like runs,
and mail addresses with spelled-out signs. Boosted trees score each candidate for each kind from its format and the words
before it. They are fitted on all candidates of all documents: Spark folds candidates with equal features into one row with
counts, and sums gradients by kind, node, feature and value, which the patterns keep to some hundred values a feature. Labels
are the base spans, without the one feature that defines the
strict rule (the plus of a phone, the check digit of a card, the range of address parts, the literal @), so they carry over
to spans that miss only that. A kind's threshold is the lowest score at which enough of a calibration part, a fifth, are base
spans. A kind with fewer than 5 * HITS positive candidates in the whole table, or that nowhere reaches the precision, adds
nothing to its base spans, and fit() warns of it.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadlens.session import cut

KINDS = ("email", "ip", "card", "phone")
# Java forms of the base patterns: possessive where nothing can be given back, started only where a run starts
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be tried, as regular expressions.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]",
        "spelled": r"@|[\[({](?:at|AT)[\])}]", "numbers": "[0-9]"}
LOOSE = {
    "spelled": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}\x20?(?:@|[\[({](?:at|AT)[\])}])\x20?[A-Za-z0-9-]{1,63}"
               r"(?:\x20?(?:\.|[\[({](?:dot|DOT)[\])}])\x20?[A-Za-z0-9-]{1,63}){1,8}",
    "numbers": r"(?<![0-9A-Za-z])[+(]{0,2}[0-9][0-9\x20().-]{6,30}[0-9](?![0-9A-Za-z])",
}
CONTEXT = 24  # characters before a candidate that its features see
WORDS = {"email": "mail|contact|contacto|kontakt|courriel|correo|write", "ip": "ip|host|server|addr|adresse|login|from",
         "card": "card|visa|credit|karte|carte|tarjeta|pay|amex", "phone": "phone|tel|call|fax|mobile|cell|ruf|appel|llama"}
ROUNDS, DEPTH, RATE, PRECISION, HITS = 15, 2, 0.4, 0.98, 20
#: Leaves are drawn towards 0 as by one candidate in so many.
PULL = 10_000
#: Gradients and curvatures are summed as whole multiples of 1 / UNIT, so that sums do not depend on their order.
UNIT = 1 << 32

FEATURES = ("length", "digits", "groups", "longest", "dots", "dashes", "spaces", "parens", "letters", "marks",
            *(f"near_{k}" for k in KINDS))


def _spans(df: DataFrame, patterns: dict[str, str], text: str) -> DataFrame:
    """Adds for each pattern an array of (s, e, t): start, end and text of its leftmost matches, in code points.

    Lengths of what lies between matches give the places. Matches and gaps are columns of their own, so that no step of the
    fold evaluates a pattern again; gaps are only cut out where there is a match.
    """
    none = F.expr("cast(array() as array<string>)")
    df = df.withColumns({f"_m_{n}": F.when(F.col(text).rlike(HINT[n]), F.regexp_extract_all(text, F.lit(p), 0)).otherwise(none)
                         for n, p in patterns.items()})
    df = df.withColumns({f"_g_{n}": F.when(F.size(f"_m_{n}") > 0, F.split(text, p, -1)).otherwise(none) for n, p in patterns.items()})
    fold = """case when size({m}) = 0 then cast(array() as array<struct<s: int, e: int, t: string>>) else aggregate(
        sequence(0, size({m}) - 1), struct(0 as at, cast(array() as array<struct<s: int, e: int, t: string>>) as o),
        (a, i) -> struct(a.at + length({g}[i]) + length({m}[i]) as at, concat(a.o, array(struct(
            a.at + length({g}[i]) as s, a.at + length({g}[i]) + length({m}[i]) as e, {m}[i] as t))) as o), a -> a.o) end"""
    df = df.withColumns({f"_{n}": F.expr(fold.format(m=f"_m_{n}", g=f"_g_{n}")) for n in patterns})
    return df.drop(*(f"_{x}_{n}" for x in "mg" for n in patterns))


_DIGITS = "regexp_replace(x.t, '[^0-9]', '')"
_LUHN = ("aggregate(sequence(1, length({d})), 0, (a, i) -> a + case when i % 2 = 1 then int(substr({d}, -i, 1)) "
         "when int(substr({d}, -i, 1)) > 4 then 2 * int(substr({d}, -i, 1)) - 9 else 2 * int(substr({d}, -i, 1)) end) % 10 = 0")
VALID = {
    "email": "true",
    "ip": "forall(split(x.t, '[.]'), p -> cast(p as double) <= 255)",
    "card": f"length({_DIGITS}) between 12 and 19 and " + _LUHN.format(d=_DIGITS),
    "phone": f"length({_DIGITS}) between 9 and 15",
}


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """Adds `_base`: array of (s, k, e) sorted by start, then kind (its place in KINDS from 1)."""
    df = _spans(df, STRICT, text)
    parts = [F.expr(f"transform(filter(_{n}, x -> {VALID[n]}), x -> struct(x.s as s, {k} as k, x.e as e))") for k, n in enumerate(KINDS, 1)]
    return df.withColumn("_base", F.array_sort(F.concat(*parts))).drop(*(f"_{n}" for n in KINDS))


def candidates(df: DataFrame, text: str) -> DataFrame:
    """Adds `_spelled` and `_numbers`: arrays of (s, e, and the features) of what the generators propose."""
    df = _spans(df, LOOSE, text)
    count = "cast(length(x.t) - length(regexp_replace(x.t, '{c}', '')) as double)"
    before = f"lower(substring({text}, greatest(1, x.s + 1 - {CONTEXT}), least(x.s, {CONTEXT})))"
    fields = {
        "length": "cast(length(x.t) as double)", "digits": count.format(c="[0-9]"),
        "groups": "cast(size(filter(split(x.t, '[^0-9]+'), p -> p <> '')) as double)",
        "longest": "cast(array_max(transform(split(x.t, '[^0-9]+'), p -> length(p))) as double)",
        "dots": count.format(c="[.]"), "dashes": count.format(c="-"), "spaces": count.format(c=" "), "parens": count.format(c="[()]"),
        "letters": count.format(c="[A-Za-z]"), "marks": count.format(c="[%_]"),
    } | {f"near_{k}": f"cast({before} rlike '(?:{w})' as double)" for k, w in WORDS.items()}
    row = ", ".join(f"{v} as {k}" for k, v in fields.items())
    return df.withColumns({f"_{n}": F.expr(f"transform(_{n}, x -> struct(x.s as s, x.e as e, {row}))") for n in LOOSE})


@dataclass
class Boosted:
    """trees: for each, (feature, cut, ...) of a node or a leaf's value; start: score without trees; threshold: of probability."""

    start: float
    trees: list[tuple]
    threshold: float | None

    def score(self, x: str) -> str:
        """SQL of the score of candidate x."""
        return " + ".join([f"{self.start!r}D", *(_sql(t, x) for t in self.trees)])


#: Of a node: for each feature its values in order, and the sums of gradients and curvatures at each.
Sums = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _never() -> Boosted:
    return Boosted(-10.0, [], None)


def _sql(tree: tuple, x: str) -> str:
    if len(tree) == 1:
        return f"{float(tree[0])!r}D"
    feature, cut, low, high = tree
    return f"case when {x}.{FEATURES[feature]} <= {float(cut)!r}D then {_sql(low, x)} else {_sql(high, x)} end"


def _value(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    return np.where(x[:, tree[0]] <= tree[1], _value(tree[2], x), _value(tree[3], x))


def _put(tree: tuple, leaves: dict[int, tuple]) -> tuple:
    """The tree with others in place of its numbered leaves."""
    if len(tree) == 1:
        return leaves.get(int(tree[0]), tree)
    return (*tree[:2], _put(tree[2], leaves), _put(tree[3], leaves))


def _split(node: Sums, pull: float) -> tuple | None:
    """The cut that gains most, as (feature, cut, sums of the low side, sums of the high side)."""
    best, split = 1e-6 * pull, None
    for f, (values, g, h) in enumerate(node):
        g, h = np.cumsum(g), np.cumsum(h)
        low, high = (g[:-1], h[:-1]), (g[-1] - g[:-1], h[-1] - h[:-1])
        gain = low[0] ** 2 / (low[1] + pull) + high[0] ** 2 / (high[1] + pull) - g[-1] ** 2 / (h[-1] + pull)
        if len(gain) and gain.max() > best:
            i = int(gain.argmax())
            best, split = gain[i], (f, float(values[i]), *((float(side[0][i]), float(side[1][i])) for side in (low, high)))
    return split


def grown(models: dict[str, Boosted], sums: Callable[[dict[str, Boosted], dict[str, tuple]], dict[str, dict[int, Sums]]],
          pull: float) -> None:
    """Add ROUNDS trees to each model, level by level.

    sums: from the models so far and each kind's unfinished tree, whose leaves are numbers, to the sums of its nodes by number.
    """
    for _ in range(ROUNDS):
        trees, whole = {k: (0.0,) for k in models}, {k: {} for k in models}
        for depth in range(DEPTH):
            found = sums(models, trees)
            for k in models:
                leaves = {}
                for n, node in found.get(k, {}).items():
                    whole[k].setdefault(n, (node[0][1].sum(), node[0][2].sum()))
                    split = _split(node, pull) if n >= 2 ** depth - 1 else None
                    if split:
                        leaves[n] = (*split[:2], (float(2 * n + 1),), (float(2 * n + 2),))
                        whole[k][2 * n + 1], whole[k][2 * n + 2] = split[2:]
                trees[k] = _put(trees[k], leaves)
        for k, model in models.items():
            model.trees.append(_put(trees[k], {n: (float(-RATE * g / (h + pull)),) for n, (g, h) in whole[k].items()}))


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, fit: np.ndarray | None = None, pull: float = 1.0) -> Boosted:
    """Logistic boosting on four fifths; the threshold from the rest. Without both labels the kind selects nothing.

    The same as fit() for candidates in arrays. w: how many candidates each row stands for; fit: which rows are of the four fifths.
    """
    fit = np.arange(len(y)) % 5 > 0 if fit is None else fit
    if len(y) < 50 or len(set(y[fit].tolist())) < 2:
        return _never()
    w = np.ones(len(y)) if w is None else w / w.mean()
    mean = np.average(y[fit], weights=w[fit])
    model = Boosted(float(np.log(mean / (1 - mean))), [], None)
    places = [np.unique(x[fit, f], return_inverse=True) for f in range(x.shape[1])]

    def score() -> np.ndarray:
        return sum((_value(t, x) for t in model.trees), np.full(len(y), model.start))

    def sums(models: dict[str, Boosted], trees: dict[str, tuple]) -> dict[str, dict[int, Sums]]:
        p, at = 1 / (1 + np.exp(-score()[fit])), _value(trees[""], x[fit])
        g, h = w[fit] * (np.rint(p * UNIT) - y[fit] * UNIT), w[fit] * np.rint(p * (1 - p) * UNIT)
        out = {}
        for n in np.unique(at):
            own = at == n
            out[int(n)] = []
            for values, place in places:
                there = np.flatnonzero(np.bincount(place[own], minlength=len(values)))
                out[int(n)].append((values[there], *(np.bincount(place[own], z[own], len(values))[there] / UNIT for z in (g, h))))
        return {"": out}

    grown({"": model}, sums, pull)
    rest = ~fit
    order = np.argsort(-score()[rest], kind="stable")
    s, hits, weight = score()[rest][order], y[rest][order], w[rest][order]
    share = np.cumsum(hits * weight) / np.cumsum(weight)
    # scores that tie stand or fall together
    last = np.r_[s[1:] != s[:-1], True]
    good = np.flatnonzero(last & (share >= PRECISION) & (np.cumsum(hits) >= HITS))
    model.threshold = float(s[good[-1]]) if len(good) else None
    return model


def labelled(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every candidate of all documents: c (place and features), for each kind whether it is a base span, and `fit`.

    fit: whether it is of the four fifths the trees learn from, by a hash of its place.
    """
    texts = docs.select(F.col(key).alias("_key"), F.coalesce(text, F.lit("")).alias("_text"))
    found = candidates(base_spans(texts, "_text"), "_text")
    # most of a base span of the kind lies in the candidate, and little else does
    label = "exists(_base, b -> b.k = {k} and least(b.e, c.e) - greatest(b.s, c.s) >= 0.8 * greatest(b.e - b.s, c.e - c.s))"
    return found.select("_key", "_base", F.explode(F.concat("_spelled", "_numbers")).alias("c")).select(
        "c", (F.pmod(F.xxhash64("_key", "c.s", "c.e"), F.lit(5)) > 0).alias("fit"),
        *(F.expr(label.format(k=k)).alias(f"is_{n}") for k, n in enumerate(KINDS, 1)))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> dict[str, Boosted]:
    """Boosted trees for each kind, learned from four fifths of all candidates of all documents, thresholds from the rest.

    Only sums come to the driver: by kind, node, feature and value for a level of trees, one threshold a kind at the end.
    """
    rows = labelled(docs, key, text).select(F.struct(*(f"c.{f}" for f in FEATURES)).alias("c"), "fit", *(f"is_{k}" for k in KINDS))
    counted = cut(rows.groupBy("c", "fit").agg(F.count("*").alias("n"), *(F.count_if(f"is_{k}").alias(k) for k in KINDS)), "profiles")
    totals = {r["fit"]: r for r in counted.groupBy("fit").agg(F.sum("n").alias("n"), *(F.sum(k).alias(k) for k in KINDS)).collect()}
    every = {c: sum(r[c] for r in totals.values()) for c in ("n", *KINDS)}
    models = {k: _never() for k in KINDS}
    live = {}
    for k in KINDS:
        if every["n"] >= 50 and True in totals and 0 < totals[True][k] < totals[True]["n"]:
            mean = totals[True][k] / totals[True]["n"]
            live[k] = models[k] = Boosted(float(np.log(mean / (1 - mean))), [], None)
    if live:
        grown(live, lambda known, trees: _summed(counted.where("fit"), known, trees), max(1.0, totals[True]["n"] / PULL))
        for k, threshold in _thresholds(counted.where("not fit"), live).items():
            models[k].threshold = threshold
    for kind in KINDS:
        if models[kind].threshold is None:
            warnings.warn(f"{kind}: no span is added to the base spans; {every[kind]} of {every['n']} candidates are base spans, "
                          f"and the calibration fifth needs {HITS} at a precision of {PRECISION}", stacklevel=2)
    return models


def _summed(counted: DataFrame, models: dict[str, Boosted], trees: dict[str, tuple]) -> dict[str, dict[int, Sums]]:
    """For each kind and node of its unfinished tree, the sums of gradients and curvatures by feature and value."""
    each = ", ".join(f"struct('{k}' as kind, {_sql(trees[k], 'c')} as node, 1 / (1 + exp(-({m.score('c')}))) as p, {k} as hits)" for k, m in models.items())
    rows = counted.select("c", "n", F.expr(f"inline(array({each}))")).selectExpr(
        "kind", "cast(node as int) as node", f"n * cast(rint(p * {UNIT}) as long) - hits * {UNIT} as g", f"n * cast(rint(p * (1 - p) * {UNIT}) as long) as h",
        f"stack({len(FEATURES)}, {', '.join(f'{i}, c.{f}' for i, f in enumerate(FEATURES))}) as (feature, value)")
    found = rows.groupBy("kind", "node", "feature", "value").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
    out: dict[str, dict[int, list]] = {}
    for r in sorted(found):
        out.setdefault(r["kind"], {}).setdefault(r["node"], [[] for _ in FEATURES])[r["feature"]].append((r["value"], r["g"] / UNIT, r["h"] / UNIT))
    return {k: {n: [tuple(np.array(c, float) for c in zip(*f)) for f in node] for n, node in nodes.items()} for k, nodes in out.items()}


def _thresholds(counted: DataFrame, models: dict[str, Boosted]) -> dict[str, float]:
    """For each kind the lowest score from which on enough candidates are base spans; kinds without one are left out.

    Counts run down within ranges of scores, after the counts of the ranges above, of which a kind has some thousand at most.
    """
    each = ", ".join(f"struct('{k}' as kind, {m.score('c')} as score, {k} as hits)" for k, m in models.items())
    scores = counted.select("n", F.expr(f"inline(array({each}))")).groupBy("kind", "score").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    scores = scores.withColumn("range", F.expr("cast(floor(greatest(-64D, least(64D, score)) * 8) as int)"))
    above = Window.partitionBy("kind").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = scores.groupBy("kind", "range").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).select(
        "kind", "range", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("n", "hits")))
    down = Window.partitionBy("kind", "range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = scores.join(ranges, ["kind", "range"]).select("kind", "score", *((F.col(f"{c}_above") + F.sum(c).over(down)).alias(c) for c in ("n", "hits")))
    good = summed.where((F.col("hits") >= HITS) & (F.col("hits") / F.col("n") >= PRECISION))
    return {r["kind"]: r["score"] for r in good.groupBy("kind").agg(F.min("score").alias("score")).collect()}


def find(docs: DataFrame, models: dict[str, Boosted], text: str = "text") -> DataFrame:
    """Adds `_base` and `_spans`, arrays of (s, k, e) sorted by start, then kind: the base spans, and with them those added.

    Null and empty texts have none. A candidate is added if its best kind reaches that kind's threshold and it meets no base
    span; a number-like one must not meet an added address either.
    """
    df = candidates(base_spans(docs.withColumn("_text", F.coalesce(F.col(text), F.lit(""))), "_text"), "_text")
    for name, kinds in (("spelled", ("email",)), ("numbers", ("ip", "card", "phone"))):
        live = [(KINDS.index(k) + 1, models[k]) for k in kinds if models[k].threshold is not None]
        if not live:
            df = df.withColumn(f"_{name}", F.expr("cast(array() as array<struct<s: int, k: int, e: int>>)"))
            continue
        met = "exists({a}, b -> b.s < c.e and c.s < b.e)"
        others = ["_base"] + (["_spelled"] if name == "numbers" else [])
        clear = " and ".join("not " + met.format(a=a) for a in others)
        # the best kind among those over their threshold, by the margin
        best = "array_max(array(" + ", ".join(f"struct({m.score('c')} - ({m.threshold!r}D) as d, {k} as k)" for k, m in live) + "))"
        df = df.withColumn(f"_{name}", F.expr(
            f"filter(transform(filter(_{name}, c -> {clear}), c -> struct(c.s as s, c.e as e, {best} as b)), c -> c.b.d >= 0)"))
        df = df.withColumn(f"_{name}", F.expr(f"transform(_{name}, c -> struct(c.s as s, c.b.k as k, c.e as e))"))
    return df.withColumn("_spans", F.array_sort(F.concat("_base", "_spelled", "_numbers"))).drop("_text", "_spelled", "_numbers")


def listed(spans: str) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat(element_at(array({names}), x.k), ':', x.s, ':', x.e)), ',')")


def report(docs: DataFrame, models: dict[str, Boosted], key: str = "doc_id") -> DataFrame:
    found = find(docs.select(key, "text"), models)
    return found.select(key, *(F.expr(f"cast(size(filter(_base, x -> x.k = {k})) as long)").alias(f"n_{n}") for k, n in enumerate(KINDS, 1)),
                        F.sha2(listed("_base"), 256).alias("base_sha256"), listed("_spans").alias("spans"))


def redacted(docs: DataFrame, models: dict[str, Boosted], text: str = "text") -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets; of spans that meet, the first names what they cover."""
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    fold = f"""aggregate(_spans, struct(0 as at, '' as o), (a, x) -> case when x.e <= a.at then a
        when x.s < a.at then struct(x.e as at, a.o as o)
        else struct(x.e as at, concat(a.o, substring(_in, a.at + 1, x.s - a.at), element_at(array({names}), x.k)) as o) end,
        a -> concat(a.o, substring(_in, a.at + 1)))"""
    # the columns travel as one, so that none can clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(f"`{text}`").alias("_in"))
    found = find(rows, models, "_in").withColumn("_out", F.when(F.size("_spans") > 0, F.expr(fold)).otherwise(F.col("_in")))
    return found.select(*(F.col("_out").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
