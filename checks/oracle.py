"""DuckDB oracles. Query answers come from the hand-worked catalog, graph answers from plain SQL over the quads."""

from __future__ import annotations

import re

from checks.catalog import DCT_TITLE, EX, LANG_STRING, RDF_TYPE, RDFS_LABEL, TEMPLATES, XSD, full
from checks.fixtures import EQUIV, ORDER_KEYS, TABLES, derived_sql, fill, quote, values

VOID, VOID_EXT = "http://rdfs.org/ns/void#", "http://ldf.fi/void-ext#"

# shape class of every basic graph pattern, worked out by hand: template -> classes by bgp_id, as (class, edges, nodes)
SHAPES = {
    0: ["E>V"], 1: ["V>EE"], 2: ["V>E", "V>V"], 3: ["V>E", "V>V"], 4: ["V>V"], 5: ["V>V>E"], 6: ["E>L"], 7: ["V~E"],
    9: ["V>E", "E>L"], 10: ["V>L"], 11: ["V>V>V"], 13: ["V>V"], 14: ["V>E", "V>E"], 15: ["V>E"], 16: ["V>EE"],
    17: ["V>V"], 18: ["V>VV"], 19: ["V>E", "V>V"], 20: ["V>E"], 21: ["E>EV"], 22: ["V>E>EV"], 23: ["V>EEL"],
    24: ["V>L"], 25: ["V>L~V"], 26: ["V>V"], 27: ["V>self"], 28: ["cycle3"], 29: ["V>VVV"], 30: ["cycle3"],
    31: ["cycle3"], 33: ["V>E"], 34: ["V>EVV", "V>L"],
}
SHAPE_SIZES = {  # class -> edges, nodes
    "E>V": (1, 2), "V>EE": (2, 3), "V>E": (1, 2), "V>V": (1, 2), "V>V>E": (2, 3), "E>L": (1, 2), "V~E": (1, 2),
    "V>L": (1, 2), "V>V>V": (2, 3), "V>VV": (2, 3), "E>EV": (2, 3), "V>E>EV": (3, 4), "V>EEL": (3, 4),
    "V>L~V": (2, 3), "V>self": (1, 1), "cycle3": (3, 3), "V>VVV": (3, 4), "V>EVV": (3, 4),
}


def term(token: str) -> tuple:
    """kind, value, datatype, lang of a catalog token (placeholders stay in)."""
    if token.startswith("?"):
        return "variable", token[1:], None, None
    if token.startswith("_:"):
        return "blank", token[2:], None, None
    if token.startswith("<"):
        return "uri", token[1:-1], None, None
    if token in ("$CU", "$NA", "$OK"):
        return "uri", token, None, None
    m = re.match(r'^"(.*)"(?:@(\w+)|\^\^<(.*)>)?$', token, re.S)
    if m:
        dt = m.group(3) or (LANG_STRING if m.group(2) else XSD + "string")
        return "literal", m.group(1).replace("$BS\"", '"'), dt, m.group(2)
    return "literal", token, XSD + ("decimal" if "." in token else "integer"), None


def split_triple(text: str) -> list[str]:
    """bgp ctx s p o; only the object may hold spaces."""
    return full(text).split(" ", 4)


def _catalog() -> str:
    return values([(i, full(t.norm), full(t.pattern), t.form, int(t.ok), len(t.triples)) for i, t in enumerate(TEMPLATES)],
                  "tmpl, norm, pattern, form, ok_, n_triples")


def _triples() -> str:
    rows = []
    for i, t in enumerate(TEMPLATES):
        for pos, line in enumerate(t.triples):
            bgp, ctx, s, p, o = split_triple(line)
            (sk, sv, *_), (pk, pv, *_), (ok, ov, dt, lang) = term(s), term(p), term(o)
            rows.append((i, int(bgp), pos, ctx, sk, sv, pk, pv, ok, ov, dt, lang))
    return values(rows, "tmpl, bgp_id, pos, ctx, s_kind, s_, p_kind, p_, o_kind, o_, o_datatype, o_lang")


def _bare(column: str) -> str:
    """Filled value; IRI placeholders lose their brackets."""
    return f"CASE WHEN {column} IN ('$CU', '$NA', '$OK') THEN trim({fill(column)}, '<>') ELSE {fill(column)} END"


def _per_template(rows: list[tuple], columns: str) -> str:
    return values(rows, columns)


def base() -> str:
    """CTEs shared by all oracles."""
    d = derived_sql({t: t for t in TABLES})
    terms = f"{_bare('s_')} AS s, {_bare('p_')} AS p, {_bare('o_')} AS o"
    cols = "bgp_id, pos, ctx, s_kind, p_kind, o_kind, o_datatype, o_lang"
    return f"""
ord AS ({ORDER_KEYS.replace('{orders}', 'orders')}),
cat AS ({_catalog()}),
trip AS ({_triples()}),
log AS ({d['query_log']}),
hits AS ({d['http_log']}),
quads AS ({d['quads']}),
parsed AS (SELECT o.*, c.form, c.ok_ = 1 AS is_ok, c.n_triples, {fill('c.norm')} AS norm_text,
  {fill('c.pattern')} AS pattern FROM ord o JOIN cat c ON o.tmpl = c.tmpl),
lt AS (SELECT qid, o.tmpl, {cols}, {terms} FROM ord o JOIN trip t ON o.tmpl = t.tmpl),
u AS (SELECT min(qid) AS uq_id, norm_text, tmpl, count(*) AS freq, min(form) AS form, min(pattern) AS pattern,
  min(n_triples) AS n_triples, min(k) AS k, min(ok) AS ok, min(st) AS st FROM parsed WHERE is_ok GROUP BY norm_text, tmpl),
t AS (SELECT uq_id, freq, u.tmpl, {cols}, {terms} FROM u JOIN trip ON u.tmpl = trip.tmpl),
uri AS (SELECT uq_id, freq, tmpl, 's' AS role, s AS term FROM t WHERE s_kind = 'uri'
  UNION ALL SELECT uq_id, freq, tmpl, 'p', p FROM t WHERE p_kind = 'uri'
  UNION ALL SELECT uq_id, freq, tmpl, 'o', o FROM t WHERE o_kind = 'uri'),
ent AS (SELECT term, sum(freq) AS n FROM uri GROUP BY term),
labels AS (SELECT s AS term, coalesce(min(CASE WHEN p = '{DCT_TITLE}' THEN o END),
  min(CASE WHEN p = '{RDFS_LABEL}' THEN o END)) AS label FROM quads
  WHERE o_kind = 'literal' AND p IN ('{DCT_TITLE}', '{RDFS_LABEL}') GROUP BY s),
key AS (SELECT '<' || s || '>' AS s, '<' || p || '>' AS p, CASE WHEN o_kind = 'uri' THEN '<' || o || '>'
  WHEN lang IS NOT NULL THEN '"' || o || '"@' || lang ELSE '"' || o || '"^^' || datatype END AS o, g FROM quads),
score AS (SELECT uq_id, round(CASE WHEN sum(nv) = 0 THEN sum(nu) ELSE sum(nu) / sum(nv) END, 6) AS score FROM (
  SELECT uq_id, cast(((s_kind = 'uri')::int + (p_kind = 'uri')::int + (o_kind = 'uri')::int) as double) AS nu,
    cast(((s_kind = 'variable')::int + (p_kind = 'variable')::int + (o_kind = 'variable')::int) as double) AS nv FROM t)
  GROUP BY uq_id)"""


def _answers() -> str:
    """Matches of the queries plain patterns can decide, one SELECT per template, variables in name order; and answers: the
    result variables of those that are SELECT queries without aggregates whose variables the required triples bind."""
    nation, region, customer, status = (f"<{EX}p/{n}>" for n in ("nation", "region", "customer", "status"))
    cu, na, ok = FILL["$CU"], FILL["$NA"], FILL["$OK"]
    xs = f"^^{XSD}string"

    def part(tmpl: int, names: list[str], cols: list[str], joins: str) -> str:
        pad = 3 - len(names)
        vals = ", ".join([f"{quote(n)}, {c}" for n, c in zip(names, cols)] + ["NULL, NULL"] * pad)
        return (f"SELECT uq_id, {len(names)}, {vals} FROM u {joins} AND u.tmpl = {tmpl}")
    label = f"<{RDFS_LABEL}>"
    parts = [
        part(0, ["n"], ["a.o"], f"JOIN key a ON a.s = {cu} AND a.p = '{nation}'"),
        part(1, ["s"], ["a.s"], f"JOIN key a ON a.o = {na} AND a.p = '{nation}' JOIN key b ON b.s = a.s AND "
             f"b.p = '<{RDF_TYPE}>' AND b.o = '<{EX}class/Customer>'"),
        part(2, ["o"], ["a.s"], f"JOIN key a ON a.o = {cu} AND a.p = '{customer}'"),
        part(5, ["c", "o"], ["a.s", "b.s"],
             f"JOIN key a ON a.o = {na} AND a.p = '{nation}' JOIN key b ON b.o = a.s AND b.p = '{customer}'"),
        part(6, [], [], f"JOIN key a ON a.s = {ok} AND a.p = '{status}' AND a.o = '\"' || st || '\"{xs}'"),
        part(11, ["n", "r", "s"], ["a.o", "b.o", "a.s"],
             f"JOIN key a ON a.p = '{nation}' JOIN key b ON b.s = a.o AND b.p = '{region}'"),
        part(18, ["c", "o", "s"], ["a.o", "a.s", "b.o"],
             f"JOIN key a ON a.p = '{customer}' JOIN key b ON b.s = a.s AND b.p = '{status}'"),
        part(20, ["c"], ["a.s"], f"JOIN key a ON a.o = {na} AND a.p = '{nation}'"),
        part(21, ["r"], ["b.o"],
             f"JOIN key a ON a.o = {cu} AND a.p = '{customer}' JOIN key b ON b.s = a.s AND b.p = '{status}'"),
        part(22, ["o", "x"], ["c.s", "b.o"],
             f"JOIN key a ON a.o = {na} AND a.p = '{nation}' JOIN key b ON b.s = a.s AND b.p = '{label}' "
             f"JOIN key c ON c.o = a.s AND c.p = '{customer}'"),
        part(24, ["c"], ["a.s"], f"JOIN key a ON a.p = '{label}' AND a.o = "
             "'\"Customer#00000000' || cast(k % 7 as string) || '\"@en'"),
        part(4, ["s"], ["a.s"], f"JOIN key a ON a.p = '{label}' AND a.o LIKE '%\"@en'"),
        part(13, ["c"], ["a.s"], f"JOIN key a ON a.p = '{nation}' AND (a.o = {na} OR a.o = '<{EX}nation/7>')"),
        # every customer has one nation, every order one status
        part(14, ["c"], ["a.s"], f"JOIN key a ON a.p = '{nation}' AND a.o <> {na}"),
        part(15, ["o"], ["a.s"], f"JOIN key a ON a.o = {cu} AND a.p = '{customer}' JOIN key b ON b.s = a.s AND b.p = '{status}' "
             f"AND b.o = '\"F\"{xs}'"),
        part(16, ["o"], ["a.s"], f"JOIN key a ON a.o = {cu} AND a.p = '{customer}' JOIN key b ON b.s = a.s AND b.p = '{status}' "
             f"AND b.o <> '\"P\"{xs}'"),
        part(33, ["g", "s"], ["'<' || a.g || '>'", "a.s"], f"JOIN key a ON a.p = '{region}' AND a.o = '<{EX}region/' || cast(k % 5 as string) || '>'"),
        part(34, ["type"], ["b.o"], f"JOIN key a ON a.o = {na} AND a.p = '{nation}' AND contains(a.s, 'customer') JOIN key b ON b.s = a.s "
             f"AND b.p = '<{RDF_TYPE}>' JOIN key c ON c.s = a.s AND c.p = '{label}'"),
    ]
    names = "uq_id, n_vars, n1, v1, n2, v2, n3, v3"
    return f"""matches({names}) AS ({' UNION ALL '.join(parts)}),
answers AS (SELECT DISTINCT {names} FROM matches JOIN u USING (uq_id) WHERE tmpl IN (0, 1, 4, 13, 14, 15, 16, 20, 21, 24, 33, 34)
  UNION ALL SELECT DISTINCT uq_id, 1, n2, v2, NULL, NULL, NULL, NULL FROM matches JOIN u USING (uq_id) WHERE tmpl = 22)"""


def _valid() -> str:
    """Templates without an answer whatever the constants, with an undecided one, and those in ``answers``."""
    never = "10, 23, 25, 26, 27, 28, 29, 30, 31"
    undecided = "7, 9, 17, 19"
    either = (f"EXISTS (SELECT 1 FROM key WHERE p = '<{EX}p/customer>') OR "
              f"EXISTS (SELECT 1 FROM key WHERE p = '<{EX}p/nation>' AND o = {FILL['$NA']})")
    return f"""{_answers()},
valid AS (SELECT uq_id, CASE WHEN tmpl IN ({never}) THEN false WHEN tmpl IN ({undecided}) THEN NULL
  WHEN tmpl = 3 THEN {either} WHEN tmpl = 12 THEN {FILL['$CU']} IN (SELECT s FROM key) ELSE uq_id IN (SELECT uq_id FROM matches) END AS valid FROM u)"""


from checks.fixtures import FILLERS as FILL  # noqa: E402


def _shapes() -> str:
    rows = [(i, b, c, *SHAPE_SIZES[c]) for i, cs in SHAPES.items() for b, c in enumerate(cs)]
    return f"""shp AS ({values(rows, 'tmpl, bgp_id, class, n_edges, n_nodes')}),
bgps AS (SELECT u.uq_id, u.freq, s.* FROM u JOIN shp s ON u.tmpl = s.tmpl)"""


def _node(r: str) -> str:
    extra = " || coalesce(' ' || o_datatype, '') || coalesce(' ' || o_lang, '')" if r == "o" else ""
    return f"{r}_kind || ' ' || {r}{extra}"


EDGES = f"""edges AS (SELECT * FROM (SELECT uq_id, bgp_id, pos, {_node('s')} AS src, {_node('o')} AS dst,
  CASE WHEN s_kind IN ('uri', 'blank') THEN 'entity' ELSE s_kind END AS src_group,
  CASE WHEN o_kind IN ('uri', 'blank') THEN 'entity' ELSE o_kind END AS dst_group, p AS pval,
  CASE WHEN p_kind = 'variable' THEN 'variable' ELSE 'property' END AS pgrp FROM t)
  QUALIFY row_number() OVER (PARTITION BY uq_id, bgp_id, src, dst ORDER BY pos) = 1)"""

SIMPLE = """simple AS (SELECT uq_id, cast(sum(m) as bigint) AS n_simple,
  md5(cast(sum(m) as varchar) || chr(10) || string_agg(line, chr(10) ORDER BY line)) AS key FROM (SELECT uq_id, line, count(*) AS m FROM (
  SELECT uq_id, CASE WHEN s_kind IN ('uri', 'blank') THEN 'entity' ELSE s_kind END || ' ' || p_kind || ':' || p
    || ' ' || CASE WHEN o_kind IN ('uri', 'blank') THEN 'entity' ELSE o_kind END AS line FROM t) GROUP BY 1, 2) GROUP BY uq_id)"""

SIGNATURES = """sigs AS (SELECT uq_id, max(n_vars) AS n_vars, string_agg(row_, '; ' ORDER BY v1, v2, v3) AS sig FROM (
  SELECT * FROM (SELECT DISTINCT uq_id, n_vars, v1, v2, v3, coalesce(n1 || ' ' || v1, '') || coalesce(', ' || n2 || ' ' || v2, '')
    || coalesce(', ' || n3 || ' ' || v3, '') AS row_ FROM answers)
  QUALIFY row_number() OVER (PARTITION BY uq_id ORDER BY v1, v2, v3) <= 5) GROUP BY uq_id)"""

SUMMARY = f"""types AS (SELECT DISTINCT s AS node, o AS type, g FROM quads WHERE p = '{RDF_TYPE}'),
summary AS (SELECT q.p, a.type AS stype, b.type AS otype, count(DISTINCT q.s) AS scount, count(DISTINCT q.o) AS ocount
  FROM quads q JOIN types a ON q.s = a.node JOIN types b ON q.o = b.node WHERE q.o_kind = 'uri' GROUP BY 1, 2, 3),
lab AS (SELECT s, min(o) AS label FROM quads WHERE p = '{RDFS_LABEL}' GROUP BY s),
labelled AS (SELECT p, stype, otype, scount, ocount, a.label AS slabel, b.label AS olabel FROM summary
  LEFT JOIN lab a ON a.s = stype LEFT JOIN lab b ON b.s = otype)"""

BY_LENGTH = """stats AS (SELECT pattern, min(n_triples) AS n_triples, sum(freq) AS freq,
  min(CASE WHEN valid THEN uq_id END) AS uq_id, min(tmpl) AS tmpl FROM u JOIN valid USING (uq_id)
  WHERE n_triples BETWEEN 1 AND 25 GROUP BY pattern),
pscore AS (SELECT u.pattern, min(p_uri) AS uris, min(n) * 3 - min(p_uri) - min(anon) AS vars FROM (
  SELECT uq_id, count(*) AS n, sum((s LIKE 'anon%' AND s_kind = 'blank')::int + (o LIKE 'anon%' AND o_kind = 'blank')::int)
    AS anon, sum((p_kind = 'uri')::int + (p = 'RDFTYPE' AND o_kind = 'uri')::int) AS p_uri FROM t
  GROUP BY uq_id) c JOIN u USING (uq_id) GROUP BY u.pattern),
by_length AS (SELECT n_triples, rank, stats.pattern, uq_id, freq, rank = 1 AS emitted, round(uris / vars, 6) AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY n_triples ORDER BY freq DESC, pattern) AS rank FROM stats
  WHERE uq_id IS NOT NULL) stats JOIN pscore ON pscore.pattern = stats.pattern WHERE rank <= 10)""".replace(
    "RDFTYPE", RDF_TYPE)

RANKED = "ranked AS (SELECT term, n, label FROM ent JOIN labels USING (term) ORDER BY n DESC, term LIMIT 10)"

TOUCH = """touch AS (SELECT * FROM t WHERE (s_kind = 'uri' AND s IN (SELECT term FROM ranked))
  OR (p_kind = 'uri' AND p IN (SELECT term FROM ranked)) OR (o_kind = 'uri' AND o IN (SELECT term FROM ranked)))"""

INDEX = """idx AS (SELECT s AS term, uq_id, count(*) AS n FROM touch JOIN valid USING (uq_id)
  WHERE valid AND s_kind = 'uri' GROUP BY s, uq_id),
idx_any AS (SELECT term, uq_id, count(*) AS n FROM (
  SELECT DISTINCT uq_id, pos, s AS term FROM touch WHERE s_kind = 'uri'
  UNION SELECT uq_id, pos, p FROM touch WHERE p_kind = 'uri'
  UNION SELECT uq_id, pos, o FROM touch WHERE o_kind = 'uri') JOIN valid USING (uq_id) WHERE valid GROUP BY 1, 2)"""

TOPS = """tops AS (SELECT role, term FROM (SELECT role, term, row_number() OVER (PARTITION BY role ORDER BY n DESC, term)
  AS r FROM (SELECT role, term, sum(freq) AS n FROM (SELECT role, term, freq FROM uri UNION ALL SELECT 'type', o, freq FROM t
  WHERE o_kind = 'uri' AND p = '""" + RDF_TYPE + """') GROUP BY 1, 2) JOIN labels USING (term)) WHERE r <= 5)"""


def _shuffle(column: str) -> str:
    return f"md5('7:' || cast({column} as varchar))"


SELECTED = f"""pick_top AS (SELECT uq_id FROM u JOIN valid USING (uq_id) WHERE valid ORDER BY freq DESC, uq_id LIMIT 50),
pick_random AS (SELECT uq_id FROM valid WHERE valid ORDER BY {_shuffle('uq_id')}, uq_id LIMIT 50),
filled AS (SELECT uq_id, min((phase, place)) AS f FROM (
  SELECT uq_id, CASE WHEN emitted THEN 1 ELSE 2 END AS phase,
    lpad(cast(n_triples as varchar), 6, '0') || lpad(cast(rank as varchar), 6, '0') AS place FROM by_length
  UNION ALL SELECT uq_id, 3, {_shuffle('uq_id')} FROM valid WHERE valid) GROUP BY uq_id),
pick_length AS (SELECT uq_id, f[1] AS phase FROM filled ORDER BY f, uq_id LIMIT 50),
pick_entity AS (SELECT term, min(uq_id) AS uq_id FROM idx GROUP BY term ORDER BY {_shuffle('term')}, term LIMIT 50),
selected AS (SELECT 'frequency' AS func, uq_id FROM pick_top UNION ALL SELECT 'random', uq_id FROM pick_random
  UNION ALL SELECT 'length', uq_id FROM pick_length UNION ALL SELECT 'entity', uq_id FROM pick_entity),
zsel AS (SELECT func, uq_id, score, n_triples, round((score - avg(score) OVER w)
  / nullif(round(stddev_pop(score) OVER w, 12), 0), 6) AS z
  FROM selected LEFT JOIN score USING (uq_id) LEFT JOIN u USING (uq_id) WINDOW w AS (PARTITION BY func)),
sel_stats AS (SELECT func, count(*) AS n, round(avg(score), 6) AS mean_score, round(sum(coalesce(z, 0.0)), 3) + 0.0 AS z_sum,
  count(DISTINCT n_triples) AS n_lengths, count(*) <> 50 AS short FROM zsel GROUP BY func),
cover AS (SELECT func, round(n_lengths / nullif((SELECT count(DISTINCT n_triples) FROM by_length WHERE emitted), 0), 6)
  AS coverage FROM sel_stats)"""

RAW_TOKEN = "|".join([
    r"[?$][0-9A-Za-z_\x{80}-\x{10FFFF}]+", r"<[^<>\s\x22{}|^`\\]*>",
    r"(?:\x22(?:[^\x22\\\n\r]|\\.)*\x22|\x27(?:[^\x27\\\n\r]|\\.)*\x27)"
    r"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^<[^<>\s]*>)?",
    r"#[^\n\r]*", r"_:[0-9A-Za-z_\-]+",
    r"(?:[A-Za-z](?:[\w\-]|\.+[\w\-])*)?:(?:[\w:%\-]|\\.|\.+[\w:%\-])*",
    r"[+-]?(?:[0-9]*\.)?[0-9]+(?:[eE][+-]?[0-9]+)?", r"[A-Za-z_][A-Za-z0-9_]*", r"&&|\|\||!=|<=|>=", r"\S"])


def _flags(t) -> tuple:
    flags, _, counts = t.mods.rpartition("proj=")
    n = {"proj": 0, "order": 0, "group": 0, "agg": 0} | {
        k: int(v) for k, v in (x.split("=") for x in ("proj=" + counts).split(",") if x)}
    return (*(f in flags.split() for f in ("slice", "distinct", "reduced", "order", "group", "having")), *n.values())


def _joined(rows: list[tuple], columns: str, select: str) -> str:
    """Catalog rows per template, joined to the log."""
    return f"SELECT {select} FROM ord JOIN ({values(rows, 'tmpl, ' + columns)}) v ON ord.tmpl = v.tmpl"


def _with(body: str, *ctes: str) -> str:
    used = "WITH " + ",\n".join([base(), *ctes]) + "\n" + body
    return re.sub(r"\bas string\b", "as varchar", used)


def oracles() -> dict[str, str]:
    valid, shapes = _valid(), _shapes()
    sel = (valid, RANKED, TOUCH, INDEX, BY_LENGTH, SELECTED)
    each = list(enumerate(TEMPLATES))
    ranked = lambda sql, n: f"SELECT * FROM ({sql}) ORDER BY n DESC, term LIMIT {n}"
    lit = "SELECT {0} AS term, sum(freq) AS n FROM t WHERE o_kind = 'literal' GROUP BY 1"
    role = "SELECT {0} AS term, sum(freq) AS n FROM t WHERE {0}_kind = 'uri' GROUP BY 1"
    decoded = "replace(replace({0}, '+', ' '), '%zz', '%25zz')"
    after = "CASE WHEN strpos(url, 'query=') > 0 THEN substr(url, strpos(url, 'query=') + 6) ELSE url END"
    clean = f"SELECT url_decode({decoded.format(after)}) AS query, domain, agent, ts FROM hits"
    clean = f"SELECT * FROM ({clean}) WHERE NOT contains(lower(query), 'buynow')"
    lang = "coalesce(o_lang, 'no-language-tag')"
    flat = "bgp_id, pos, ctx, s, s_kind, p, p_kind, o, o_kind, o_datatype, o_lang"
    iso = ("SELECT sum(freq) AS n, count(*) AS n_unique, min((uq_id, bgp_id))[1] AS uq_id, min((uq_id, bgp_id))[2] AS bgp_id, "
           "min(n_edges) AS n_edges, min(n_nodes) AS n_nodes FROM {0} GROUP BY {1}")
    clusters = f"clusters AS (SELECT class, {iso.format('bgps', 'class')[7:]})"
    preds = ("bp AS (SELECT uq_id, bgp_id, string_agg(p_kind || p, ' ' ORDER BY p_kind || p) AS preds FROM "
             "(SELECT t.* FROM t QUALIFY row_number() OVER (PARTITION BY uq_id, bgp_id, s_kind, s, o_kind, o ORDER BY pos) = 1) "
             "GROUP BY 1, 2), bgps2 AS (SELECT * FROM bgps JOIN bp USING (uq_id, bgp_id))")
    nodes = ("nodes AS (SELECT DISTINCT uq_id, bgp_id, src AS node, src_group AS grp FROM edges UNION "
             "SELECT uq_id, bgp_id, dst, dst_group FROM edges)")
    cls = ("coalesce((SELECT class FROM equiv WHERE {0}_kind = 'uri' AND term = {0}), CASE WHEN {0}_kind IN ('uri', 'blank') "
           "THEN '{1}' ELSE {0}_kind END)")
    key = "SELECT {0} FROM key"
    p = {n: f"<{EX}p/{n}>" for n in ("nation", "region", "customer", "status", "parent", "in", "has")}
    stmt = "CASE WHEN {0}_kind <> 'variable' THEN {0} END AS {0}"
    edge_group = ("CASE WHEN {0} LIKE '?ent%' THEN 'entity' WHEN {0} LIKE '?str%' THEN 'literal' "
                  "WHEN {0} LIKE '?%' THEN 'variable' ELSE 'entity' END")
    graph_rows = _pattern_edges()
    search = "SELECT norm_text AS question, pattern, uq_id AS instance FROM u WHERE contains(lower(norm_text), 'customer')"

    out = {
        "a5_read_nquads": ("SELECT * FROM quads",),
        "a11_pattern_docs": (
            "SELECT s.n_triples AS num, rank, s.pattern, norm_text AS instance, s.freq FROM (SELECT *, row_number() OVER "
            "(PARTITION BY n_triples ORDER BY freq DESC, pattern) AS rank FROM (SELECT pattern, min(n_triples) AS n_triples, "
            "sum(freq) AS freq, min(uq_id) AS uq_id FROM u GROUP BY pattern)) s JOIN u USING (uq_id) WHERE rank <= 10",),
        "a12_validity_cache": ("SELECT * FROM valid", valid),
        "a14_sample_head": ("SELECT * FROM hits ORDER BY ts, hit_id LIMIT 50",),
        "b1_log_selector": (
            "SELECT * FROM hits WHERE (domain = 'bio.example.org' OR domain LIKE '%.bio.example.org') AND url LIKE '%sparql%' "
            "AND url LIKE '%query%' AND regexp_matches(lower(url), 'select|ask|construct|insert')",),
        "b2_extract_query_param": (f"SELECT hit_id, {after} AS query FROM hits",),
        "b3_unquote_plus": (f"SELECT hit_id, url_decode({decoded.format('url')}) AS url FROM hits",),
        "b4_repair_and_decode": (f"SELECT hit_id, url_decode({decoded.format(after)}) AS query FROM hits",),
        "b5_drop_spam": ("SELECT hit_id FROM hits WHERE url NOT ILIKE '%buynow%'",),
        "b6_clean_log": (clean,),
        "b7_query_form": ("SELECT qid, form FROM parsed",),
        "b8_parse_or_keep": ("SELECT qid, query_text, is_ok, CASE WHEN is_ok THEN n_triples END AS n_triples "
                             "FROM parsed JOIN log USING (qid)",),
        "b9_parse_failures": ("SELECT sum(is_ok::int) AS n_ok, sum((NOT is_ok)::int) AS n_failed FROM parsed",),
        "b10_normalise_query": ("SELECT qid, norm_text FROM parsed WHERE is_ok",),
        "b10b_expand_prefixes": ("SELECT qid, tmpl = 20 AS expanded, norm_text FROM parsed WHERE is_ok",),
        "b11_strip_limit_offset": (
            "SELECT uq_id, regexp_replace(norm_text, ' (LIMIT|OFFSET) [0-9]+', '', 'g') AS query FROM u",),
        "b12_escape_newlines": ("SELECT qid, replace(query_text, chr(10), chr(92) || 'n') AS line FROM log",),
        "b13_faq_search": (search,),
        "b14_exclude_resource_types": (
            f"SELECT term, n, label FROM (SELECT o AS term, sum(freq) AS n FROM t WHERE o_kind = 'uri' AND p = '{RDF_TYPE}' "
            "GROUP BY 1) JOIN labels USING (term) ORDER BY n DESC, term LIMIT 10",),
        "b15_row_audit": ("SELECT 'read' AS step, count(*) AS n FROM hits UNION ALL "
                          f"SELECT 'kept', count(*) FROM ({clean})",),
        "c1_tokenise": (
            "SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY i) - 1 AS pos, tok, kind FROM (SELECT qid, i, toks[i] AS "
            "tok, CASE WHEN regexp_full_match(toks[i], '<[^ ]*>') THEN 'iri' WHEN toks[i][1] IN ('\"', '''') THEN 'literal' "
            "WHEN regexp_matches(toks[i], '^[?$].') THEN 'variable' WHEN toks[i] LIKE '\\_:%' ESCAPE '\\' THEN 'blank' "
            "WHEN regexp_matches(toks[i], '^[+-]?[.]?[0-9]') THEN 'number' WHEN contains(toks[i], ':') THEN 'prefixed' "
            "WHEN regexp_matches(toks[i], '^[A-Za-z_]') THEN 'word' ELSE 'sign' END AS kind FROM (SELECT qid, toks, "
            f"unnest(range(1, len(toks) + 1)) AS i FROM (SELECT qid, regexp_extract_all(query_text, {quote(RAW_TOKEN)}) AS toks "
            "FROM log))) WHERE tok NOT LIKE '#%'",),
        "c2_triple_patterns": (f"SELECT qid, {flat} FROM lt",),
        "c3_classify_terms": ("SELECT s_kind, p_kind, o_kind, o_datatype, o_lang, count(*) AS n FROM lt GROUP BY ALL",),
        "c4_triple_count": ("SELECT qid, CASE WHEN is_ok THEN n_triples ELSE 0 END AS n FROM parsed",),
        "c5_iri_mentions": (
            "SELECT qid, iri, place, count(*) AS n FROM (SELECT qid, s AS iri, 'triple' AS place FROM lt WHERE s_kind = 'uri' "
            "UNION ALL SELECT qid, p, 'triple' FROM lt WHERE p_kind = 'uri' UNION ALL SELECT qid, o, 'triple' FROM lt "
            "WHERE o_kind = 'uri' UNION ALL "
            + _joined([(i, x) for i, t in each for x in t.filter_iris], "x", f"qid, {_bare('x')}, 'filter'")
            + ") GROUP BY ALL",),
        "c6_values_blocks": (_joined(
            [(i, int(r.split()[0]), r.split()[1], full(r.split()[2])) for i, t in each for r in t.values],
            "row, var, x", f"qid, row, var, {fill('x')} AS term"),),
        "c7_bind_vars": (_joined([(i, b) for i, t in each for b in t.binds], "var", "qid, var"),),
        "c8_slice_numbers": (_joined(
            [(i, t.lim, t.off) for i, t in each if t.lim or t.off], "lim_, off_",
            f"qid, cast({fill('lim_')} as bigint) AS lim, cast({fill('off_')} as bigint) AS off"),),
        "c9_aggregate_uses": (_joined(
            [(i, a.split()[0], a.split()[1], int(a.split()[2])) for i, t in each for a in t.aggs], "agg, alias, n",
            "qid, agg, alias, n"),),
        "c10_filter_constants": (_joined(
            [(i, *term(x)[:2]) for i, t in each for x in t.filters], "kind, x", f"qid, kind, {_bare('x')} AS value"),),
        "c11_type_objects": (f"SELECT qid, o AS type, o_kind AS kind FROM lt WHERE p_kind = 'uri' AND p = '{RDF_TYPE}'",),
        "c12_bound_terms": ("SELECT qid, pos, 's' AS role, s AS term FROM lt WHERE s_kind <> 'variable' UNION ALL "
                            "SELECT qid, pos, 'o', o FROM lt WHERE o_kind <> 'variable'",),
        "c13_whole_terms": ("SELECT qid, pos, 's' AS role, s AS term FROM lt WHERE s_kind <> 'variable' UNION ALL "
                            "SELECT qid, pos, 'p', p FROM lt WHERE p_kind <> 'variable' UNION ALL "
                            "SELECT qid, pos, 'o', o FROM lt WHERE o_kind <> 'variable'",),
        "c14_statement_rows": (f"SELECT qid, pos, {', '.join(stmt.format(r) for r in 'spo')} FROM lt",),
        "c15_modifier_profile": (_joined(
            [(i, *map(int, _flags(t))) for i, t in each if t.ok], "a, b, c, d, e, f, g, h, i, j",
            "qid, a = 1 AS has_slice, b = 1 AS has_distinct, c = 1 AS has_reduced, d = 1 AS has_order, e = 1 AS has_group, "
            "f = 1 AS has_having, g AS n_project, h AS n_order, i AS n_group, j AS n_agg"),),
        "c16_operator_profile": (_joined([(i, op, n) for i, t in each for op, n in t.ops.items()], "op, n", "qid, op, n"),),
        "c17_subquery_levels": (_joined(
            [(i, lv) for i, t in each if t.ok for lv in t.levels], "level", "qid, level, 1 AS n"),),
        "d1_subject_freq": (role.format("s"),), "d2_predicate_freq": (role.format("p"),),
        "d3_object_freq": (role.format("o"),), "d4_literal_freq": (lit.format("o"),),
        "d5_datatype_freq": (lit.format("o_datatype"),), "d6_language_freq": (lit.format(lang),),
        "d7_literal_label_freq": (lit.format(f"o_datatype || '---' || {lang}"),),
        "d8_rdf_type_freq": (f"SELECT o AS term, sum(freq) AS n FROM t WHERE o_kind = 'uri' AND p = '{RDF_TYPE}' GROUP BY 1",),
        "d9_entity_freq": ("SELECT * FROM ent",),
        "d10_distinct_terms": ("SELECT role, count(DISTINCT term) AS n_distinct, sum(freq) AS n_total FROM uri GROUP BY 1 "
                               "UNION ALL SELECT 'all', count(DISTINCT term), sum(freq) FROM uri",),
        "d11_word_count": ("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS word "
                           "FROM documents) WHERE word <> '' GROUP BY 1",),
        "d11_top_words": ("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS word "
                          "FROM documents) WHERE word <> '' GROUP BY 1 ORDER BY n DESC, word LIMIT 15",),
        "d12_type_statistics": (f"SELECT o AS type, o_kind AS kind, count(*) AS n, arg_max(norm_text, uq_id) AS sample FROM t "
                                f"JOIN u USING (uq_id) WHERE p = '{RDF_TYPE}' GROUP BY 1, 2",),
        "d12_valid_type_statistics": (
            f"SELECT o AS type, o_kind AS kind, count(*) AS n, arg_max(norm_text, uq_id) AS sample FROM t JOIN u USING (uq_id) "
            f"JOIN valid USING (uq_id) WHERE valid AND p = '{RDF_TYPE}' GROUP BY 1, 2", valid),
        "d13_unique_queries": ("SELECT uq_id, norm_text, freq, form FROM u",),
        "d13b_top_queries": ("SELECT row_number() OVER (ORDER BY freq DESC, uq_id) AS rank, norm_text AS query, freq FROM u "
                             "ORDER BY rank LIMIT 100",),
        "h1_generalise_query": ("SELECT uq_id, pattern, n_triples FROM u",),
        "h1_generalise_filters": (
            "SELECT CASE tmpl WHEN 4 THEN replace(pattern, '\"en\"', '?str1') WHEN 27 THEN "
            "regexp_replace(pattern, '<[^>]*customer/[0-9]+>', '?ent1') ELSE pattern END AS pattern, count(*) AS n FROM u "
            "GROUP BY 1",),
        "h2_slot_guards": (
            "SELECT uq_id, array_to_string(list_concat(" + ", ".join(
                f"['FILTER {test}(?{slot}' || i || ')' FOR i IN range(1, 1 + {n})]" for n, test, slot in
                (("(SELECT n_ent FROM slots s WHERE s.tmpl = u.tmpl)", "isIRI", "ent"),
                 ("(SELECT n_str FROM slots s WHERE s.tmpl = u.tmpl)", "isLiteral", "str")))
            + "), ' ') AS guards FROM u",
            "slots AS (" + values([(i, len(set(re.findall(r"\?ent\d+", t.pattern))), len(set(re.findall(r"\?str\d+", t.pattern))))
                                   for i, t in each], "tmpl, n_ent, n_str") + ")"),
        "h3_keep_type_objects": ("SELECT uq_id, pattern, tmpl IN (1, 14, 16) AS has_type FROM u",),
        "h4_patterns_by_form": ("SELECT form, count(DISTINCT pattern) AS n_patterns, count(*) AS n_queries FROM u GROUP BY 1",),
        "d14_pattern_instances": ("SELECT md5(pattern) AS pattern_id, uq_id FROM u",),
        "d15_pattern_freq": ("SELECT pattern, count(*) AS n_unique FROM u GROUP BY 1",),
        "d16_pattern_freq_weighted": ("SELECT pattern, sum(freq) AS n_log FROM u GROUP BY 1",),
        "d17_pattern_statistics": ("SELECT pattern, count(*) AS n_unique, sum(freq) AS n_log FROM u GROUP BY 1",),
        "d18_pattern_listing": ("SELECT pattern, uq_id, norm_text AS instance FROM u",),
        "d19_length_hist_queries": ("SELECT n_triples, sum(freq) AS n FROM u GROUP BY 1",),
        "d20_length_hist_patterns": ("SELECT n_triples, count(DISTINCT pattern) AS n FROM u GROUP BY 1",),
        "d21_max_length": ("SELECT max(n_triples) AS max_length FROM u",),
        "d22_length_by_form": ("SELECT form, n_triples, count(*) AS n FROM parsed WHERE is_ok GROUP BY 1, 2",),
        "e1_top_labelled": ("SELECT * FROM ranked", RANKED),
        "e2_top_labelled_types": (
            "SELECT term, n, label FROM (" + role.format("o") + ") JOIN labels USING (term) "
            "WHERE NOT contains(term, ':Resource') ORDER BY n DESC, term LIMIT 10",),
        "e3_ranked_with_label": (
            "SELECT term, label, n FROM (" + role.format("s") + ") LEFT JOIN labels USING (term) "
            "WHERE label IS NOT NULL OR term IN (SELECT s FROM quads) ORDER BY n DESC, term LIMIT 100",),
        "e4_ranked_plain": (ranked(lit.format("o"), 100),),
        "e4b_ranked_optional_label": ("SELECT term, label, n FROM ent LEFT JOIN labels USING (term)",),
        "e5_select_top_valid": ("SELECT uq_id, norm_text, freq FROM u JOIN pick_top USING (uq_id)", *sel),
        "e6_select_random_valid": ("SELECT uq_id, norm_text, freq FROM u JOIN pick_random USING (uq_id)", *sel),
        "e7_select_by_length": ("SELECT * FROM by_length", valid, BY_LENGTH),
        "e8_fill_selection": ("SELECT uq_id, phase FROM pick_length", *sel),
        "e9_select_by_entity": ("SELECT term, uq_id FROM pick_entity", *sel),
        "e10_queries_for_top_terms": (
            "SELECT DISTINCT tops.role, tops.term, uri.uq_id FROM tops JOIN uri ON uri.term = tops.term "
            "JOIN valid ON valid.uq_id = uri.uq_id WHERE valid", valid, TOPS),
        "e11_sort_by_value": ("SELECT pattern, count(*) AS n_unique FROM u GROUP BY 1",),
        "e12_cluster_report": ("SELECT count(*) AS n_clusters, sum((n > 500)::int) AS n_shown, sum((n <= 500)::int) AS "
                               "n_skipped FROM clusters", shapes, clusters),
        "e12_first_small_cluster": (
            "SELECT uq_id, bgp_id FROM bgps WHERE class = (SELECT class FROM clusters WHERE n < 500 ORDER BY uq_id, bgp_id "
            "LIMIT 1)", shapes, clusters),
        "s1_informativeness": ("SELECT * FROM score",),
        "s2_z_scores": ("SELECT uq_id, form, score, round((score - avg(score) OVER w) / nullif(round(stddev_pop(score) OVER w, "
                        "12), 0), 6) AS z FROM score JOIN u USING (uq_id) WINDOW w AS (PARTITION BY form)",),
        "s3_selection_statistics": ("SELECT * FROM sel_stats", *sel),
        "s4_complexity_coverage": ("SELECT * FROM cover", *sel),
        "s5_usefulness": (
            "SELECT func, z, coverage, round(coalesce(z, 0.0) + coverage, 6) AS usefulness FROM (SELECT func, round((mean_score "
            "- avg(mean_score) OVER ()) / nullif(round(stddev_pop(mean_score) OVER (), 12), 0), 6) AS z FROM sel_stats) "
            "JOIN cover USING (func)", *sel),
        "s6_ratio_threshold": ("SELECT * FROM score WHERE score > 1.0",),
        "f1_label_lookup": ("SELECT * FROM labels",),
        "f2_exists_in_role": (
            "SELECT DISTINCT role, term FROM uri WHERE (role = 's' AND term IN (SELECT s FROM quads)) OR (role = 'p' AND term IN "
            "(SELECT p FROM quads)) OR (role = 'o' AND term IN (SELECT o FROM quads WHERE o_kind = 'uri'))",),
        "f3_validity": ("SELECT * FROM valid", valid),
        "f5_memoised_validity": ("SELECT * FROM valid", valid),
        "f6_first_binding": (
            "SELECT uq_id, unnest(['n1', 'n2', 'n3'][:n_vars]) AS slot, unnest([n1, n2, n3][:n_vars]) AS var, "
            "unnest([v1, v2, v3][:n_vars]) AS value FROM (SELECT * FROM answers QUALIFY row_number() OVER (PARTITION BY uq_id "
            "ORDER BY v1, v2, v3) = 1)", valid),
        "f7_ranked_entity_filter": ("SELECT uq_id, pos FROM touch", RANKED, TOUCH),
        "f8_iri_query_index": ("SELECT * FROM idx", valid, RANKED, TOUCH, INDEX),
        "f8_iri_query_index_any": ("SELECT * FROM idx_any", valid, RANKED, TOUCH, INDEX),
        "f10_result_signature": ("SELECT * FROM sigs", valid, SIGNATURES),
        "f11_equivalent_queries": (
            "SELECT uq_id, min(uq_id) OVER w AS same_as FROM simple JOIN sigs USING (uq_id) "
            "WINDOW w AS (PARTITION BY simple.key, n_vars, sig) QUALIFY count(*) OVER w > 1", valid, SIGNATURES, SIMPLE),
        "g1_bgp_edges": ("SELECT * FROM edges", EDGES),
        "g1_bgp_nodes": ("SELECT * FROM nodes", EDGES, nodes),
        "g1_bgp_multigraph": ("SELECT uq_id, bgp_id, count(*) AS n_edges FROM t GROUP BY 1, 2",),
        "g2_shape_signature": (
            "SELECT uq_id, bgp_id, cast(sum(d) / 2 as bigint) AS n_edges, count(*) AS n_nodes, sum((grp = 'entity')::int) AS "
            "n_entity, sum((grp = 'variable')::int) AS n_variable, sum((grp = 'literal')::int) AS n_literal, "
            "string_agg(d, ',' ORDER BY d DESC) AS degrees FROM (SELECT uq_id, bgp_id, node, grp, count(*) AS d FROM "
            "(SELECT uq_id, bgp_id, src AS node, src_group AS grp FROM edges UNION ALL SELECT uq_id, bgp_id, dst, dst_group "
            "FROM edges) GROUP BY ALL) GROUP BY 1, 2", EDGES),
        "g3_iso_clusters": (iso.format("bgps", "class"), shapes),
        "g4_iso_clusters_by_predicate": (iso.format("bgps2", "class, preds"), shapes, preds),
        "g5_equivalence_classes": (
            f"SELECT uq_id, pos, {cls.format('s', 'entity')} AS s_class, {cls.format('p', 'property')} AS p_class, "
            f"{cls.format('o', 'entity')} AS o_class FROM t", f"equiv AS ({EQUIV})"),
        "g6_simplified_triples": ("SELECT * FROM simple", SIMPLE),
        "g7_pattern_graph": (
            f"SELECT md5(pattern) AS pattern_id, pos, '( ' || {edge_group.format('s')} || ' ' || trim(trim(p, '<>'), '?') || ' ' "
            f"|| {edge_group.format('o')} || ' )' AS edge_text FROM (SELECT DISTINCT tmpl, pattern FROM u) JOIN pe USING (tmpl)",
            f"pe AS ({graph_rows})"),
        "g8_cluster_members": (
            "SELECT bgps.uq_id, bgps.bgp_id, clusters.uq_id AS rep_uq_id, clusters.bgp_id AS rep_bgp_id FROM bgps "
            "JOIN clusters USING (class)", shapes, clusters),
        "n1_type_predicate_type": ("SELECT * FROM summary", SUMMARY),
        "n1_one_graph": (
            "SELECT q.p, a.type AS stype, b.type AS otype, count(DISTINCT q.s) AS scount, count(DISTINCT q.o) AS ocount FROM "
            f"quads q JOIN types a ON q.s = a.node AND a.g = '{EX}graph/geo' JOIN types b ON q.o = b.node AND "
            f"b.g = '{EX}graph/geo' WHERE q.o_kind = 'uri' AND q.g = '{EX}graph/geo' GROUP BY 1, 2, 3", SUMMARY),
        "n2_summary_with_labels": ("SELECT * FROM labelled", SUMMARY),
        "n3_void_partitions": (_void(), SUMMARY),
        "n4_property_profile": ("SELECT p, count(*) AS n, count(DISTINCT s) AS ns, count(DISTINCT (o, o_kind, datatype, lang)) "
                                "AS no FROM quads GROUP BY 1",),
        "n5_class_profile": ("SELECT type AS class, count(*) AS n FROM types GROUP BY 1", SUMMARY),
        "n6_graph_profile": ("SELECT g, count(*) AS n FROM quads GROUP BY 1",),
        "i1_bgp_match": (
            f"SELECT a.s AS o, a.o AS c, b.o AS n, r.o AS r FROM key a JOIN key b ON a.o = b.s JOIN key r ON b.o = r.s "
            f"WHERE a.p = '{p['customer']}' AND b.p = '{p['nation']}' AND r.p = '{p['region']}'",),
        "i2_optional": (f"SELECT a.s AS x, a.o AS t, b.o AS l FROM key a LEFT JOIN key b ON a.s = b.s AND "
                        f"b.p = '<{RDFS_LABEL}>' WHERE a.p = '<{RDF_TYPE}>'",),
        "i3_union": (f"SELECT s AS c, o AS n, NULL AS o FROM key WHERE p = '{p['nation']}' UNION ALL "
                     f"SELECT o, NULL, s FROM key WHERE p = '{p['customer']}'",),
        "i4_minus": (f"SELECT s AS o, o AS c FROM key WHERE p = '{p['customer']}' AND o NOT IN (SELECT s FROM key WHERE "
                     f"p = '{p['nation']}' AND o = '<{EX}nation/1>')",),
        "i5_exists": (f"SELECT s AS c, o AS n FROM key WHERE p = '{p['nation']}' AND s IN (SELECT o FROM key WHERE "
                      f"p = '{p['customer']}')",),
        "i6_filter": (f"SELECT '<' || s || '>' AS x, '\"' || o || '\"@' || lang AS l FROM quads WHERE p = '{RDFS_LABEL}' AND "
                      "lang = 'en' AND regexp_matches(o, '[02468]$')",),
        "i7_values_join": (f"SELECT s AS c, o AS n FROM key JOIN nation ON o = '<{EX}nation/' || n_nationkey || '>' WHERE "
                           f"p = '{p['nation']}' AND n_regionkey = 1",),
        "i8_bind": (f"SELECT s AS o, regexp_extract(s, 'order/([0-9]+)', 1) AS nr, trim(o, '<>') || '#it' AS iri, CASE WHEN o "
                    f"LIKE '%0>' THEN 'zero' ELSE 'other' END AS last FROM key WHERE p = '{p['customer']}'",),
        "i9_group_aggregate": (
            f"SELECT a.o AS c, count(*) AS n, count(DISTINCT b.o) AS n_status, min(a.s) AS first, max(a.s) AS last, "
            f"string_agg(DISTINCT b.o, '; ' ORDER BY b.o) AS all_s FROM key a JOIN key b ON a.s = b.s WHERE "
            f"a.p = '{p['customer']}' AND b.p = '{p['status']}' GROUP BY 1 HAVING count(*) > 5",),
        "i10_modifiers": (f"SELECT DISTINCT o AS nation FROM key WHERE p = '{p['nation']}' ORDER BY 1 DESC LIMIT 10 OFFSET 3",),
        "i11_graph_clause": (f"SELECT g, s, p, o FROM key WHERE g = '{EX}graph/geo'",),
        "i12_path_sequence": (f"SELECT a.s AS x, b.o AS y FROM key a JOIN key b ON a.o = b.s WHERE a.p = '{p['customer']}' AND "
                              f"b.p = '{p['nation']}'",),
        "i12_path_alternative": (f"SELECT DISTINCT s AS x, o AS y FROM key WHERE p IN ('{p['nation']}', '{p['region']}')",),
        "i13_path_closure": ("SELECT x, y FROM reach",),
        "i13_path_star": ("SELECT x, y FROM reach WHERE x NOT IN (SELECT y FROM reach) UNION SELECT x, x FROM reach WHERE x NOT IN (SELECT y FROM reach)",),
        "i13_path_depth": (
            "SELECT x, y FROM link WHERE x NOT IN (SELECT y FROM link) "
            "UNION SELECT a.x, b.y FROM link a JOIN link b ON a.y = b.x WHERE a.x NOT IN (SELECT y FROM link)",
            f"link AS (SELECT DISTINCT s AS x, o AS y FROM key WHERE p = '{p['parent']}')"),
        "i13_path_groups": (
            "SELECT n.x AS node, least(n.x, coalesce(min(b.x), n.x)) AS grp FROM (SELECT x FROM reach UNION SELECT y FROM reach) n "
            "LEFT JOIN reach a ON a.x = n.x LEFT JOIN reach b ON b.x = a.y AND b.y = n.x GROUP BY n.x",),
        "i13_path_condensed": (
            "SELECT DISTINCT gx.grp AS x, gy.grp AS y FROM reach JOIN grouped gx ON gx.node = x JOIN grouped gy ON gy.node = y",),
        "i14_subselect": (
            f"SELECT s AS c, o AS n, orders FROM key JOIN (SELECT o AS c, count(*) AS orders FROM key WHERE "
            f"p = '{p['customer']}' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) ON c = s WHERE p = '{p['nation']}'",),
        "i15_blank_property_list": (
            f"SELECT a.s AS o, l.o AS l FROM key a JOIN key b ON a.o = b.s JOIN key l ON l.s = b.s WHERE "
            f"a.p = '{p['customer']}' AND b.p = '{p['nation']}' AND b.o = '<{EX}nation/2>' AND l.p = '<{RDFS_LABEL}>'",),
        "i16_construct": (
            f"SELECT DISTINCT a.s AS s, '{p['in']}' AS p, b.o AS o FROM key a JOIN key b ON a.o = b.s WHERE a.p = "
            f"'{p['nation']}' AND b.p = '{p['region']}' UNION SELECT b.o, '{p['has']}', a.o FROM key a JOIN key b ON a.o = b.s "
            f"WHERE a.p = '{p['nation']}' AND b.p = '{p['region']}'",),
        "i17_ask": (f"SELECT count(*) > 0 AS answer FROM key a JOIN key b ON a.s = b.s WHERE a.p = '{p['status']}' AND "
                    f"a.o = '\"F\"^^{XSD}string' AND b.p = '{p['customer']}'",),
        "i18_describe": ("SELECT DISTINCT s, p, o, g FROM key WHERE regexp_full_match(s, '.*nation/[0-9]+>') OR "
                         "regexp_full_match(o, '.*nation/[0-9]+>')",),
        "x1_collectors": (
            f"SELECT 'languages' AS collector, * FROM ({lit.format(lang)}) UNION ALL SELECT 'datatypes', * FROM "
            f"({lit.format('o_datatype')}) UNION ALL SELECT 'types', o, sum(freq) FROM t WHERE o_kind = 'uri' AND "
            f"p = '{RDF_TYPE}' GROUP BY o",),
        "x2_visitor_rows": (f"SELECT qid, {flat} FROM lt WHERE ctx IN ('service', 'optional')",),
        "j1_stream_clean_log": (clean,),
        "j2_stream_term_counts": (
            "SELECT norm_text, count(*) AS n FROM events e JOIN parsed s ON e.event_id = s.qid "
            "WHERE event_type NOT IN ('error', 'signup', 'click') AND is_ok GROUP BY 1",),
        "j3_windowed_counts": ("SELECT date_trunc('hour', ts) AS start, domain, count(*) AS n FROM hits GROUP BY 1, 2",),
    }
    out["f6_first_binding"] = ("SELECT uq_id, var, value FROM (" + out["f6_first_binding"][0] + ")", valid)
    sqls = {name: _with(body, *ctes) for name, (body, *ctes) in out.items()}
    reach = f"""reach AS (SELECT s AS x, o AS y FROM key WHERE p = '{p['parent']}'
  UNION SELECT reach.x, key.o FROM reach JOIN key ON key.s = reach.y AND key.p = '{p['parent']}')"""
    grouped = f"grouped AS ({out['i13_path_groups'][0]})"
    for name, more in (("closure", [reach]), ("star", [reach]), ("groups", [reach]), ("condensed", [reach, grouped])):
        body = out[f"i13_path_{name}"][0]
        sqls[f"i13_path_{name}"] = sqls[f"i13_path_{name}"].replace("WITH ", "WITH RECURSIVE ", 1).replace("\n" + body, ",\n" + ",\n".join(more) + "\n" + body)
    return sqls


def _pattern_edges() -> str:
    """Triples of the expected patterns: catalog triples with the slots of the catalog pattern put in by position."""
    rows = []
    for i, t in enumerate(TEMPLATES):
        if not t.triples:
            continue
        names = dict(zip(_words(full(t.norm)), _words(full(t.pattern)), strict=True))
        for pos, line in enumerate(t.triples):
            _, _, s, p, o = split_triple(line)
            rows.append((i, pos, *(names.get(x, x) for x in (s, p, o))))
    return values(rows, "tmpl, pos, s, p, o")


def _words(text: str) -> list[str]:
    return re.findall(r'"(?:[^"$]|\$BS"|\$)*"\S*|\S+', text)


def _void() -> str:
    key = "p || ' ' || stype || ' ' || otype"
    ds = EX + "dataset"

    def part(s: str, p: str, o: str, kind: str) -> str:
        return f"SELECT {s} AS s, '{p}' AS p, {o} AS o, '{kind}' AS o_kind FROM labelled"
    a, b, c = (f"'_:{x}' || md5({key})" for x in "pco")
    return "SELECT * FROM (" + " UNION ".join([
        part(f"'{ds}'", RDF_TYPE, f"'{VOID}Dataset'", "uri"), part(f"'{ds}'", VOID + "propertyPartition", a, "blank"),
        part(a, VOID + "property", "p", "uri"), part(a, VOID + "classPartition", b, "blank"),
        part(b, VOID + "class", "stype", "uri"), part(b, VOID + "distinctSubjects", "cast(scount as varchar)", "literal"),
        part(a, VOID_EXT + "objectClassPartition", c, "blank"), part(c, VOID + "class", "otype", "uri"),
        part(c, VOID + "distinctObjects", "cast(ocount as varchar)", "literal"),
        part("stype", RDFS_LABEL, "slabel", "literal"), part("otype", RDFS_LABEL, "olabel", "literal"),
    ]) + ") WHERE o IS NOT NULL"
