"""Column functions on request urls and query texts (no UDFs: everything stays in the JVM)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadlens import vocab

# One alternative per lexical class. Possessive quantifiers keep long literals iterative and words free of backtracking;
# the look-ahead skips blanks before any alternative is tried.
TOKEN_PATTERN = r"(?=\S)(?:" + "|".join([
    r"[?$][0-9A-Za-z_\x{80}-\x{10FFFF}]++",                                  # variable
    r"<[^<>\s\x22{}|^`\\]*+>",                                               # IRI
    r"(?:\x22{3}(?:\x22{0,2}(?:[^\x22\\]|\\.))*+\x22{3}"                     # literals: long forms first
    r"|\x27{3}(?:\x27{0,2}(?:[^\x27\\]|\\.))*+\x27{3}"
    r"|\x22(?:[^\x22\\\n\r]++|\\.)*+\x22|\x27(?:[^\x27\\\n\r]++|\\.)*+\x27)"
    r"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^<[^<>\s]*>|\^\^[A-Za-z][\w.\-]*:[\w\-]+)?",
    r"#[^\n\r]*+",                                                            # comment
    r"_:[0-9A-Za-z_\-]++",                                                    # blank node
    r"(?:[A-Za-z][\w\-\x{80}-\x{10FFFF}]*+(?:\.++[\w\-]++)*+)?:"              # prefixed name
    r"(?:[\w:%\-\x{80}-\x{10FFFF}]++|\\.|\.++[\w:%\-])*+",
    r"[+-]?(?:[0-9]*\.)?[0-9]++(?:[eE][+-]?[0-9]+)?",                         # number
    r"[A-Za-z_][A-Za-z0-9_]*+",                                               # word
    r"&&|\|\||!=|<=|>=",
    r"\S",
]) + ")"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --- requests -----------------------------------------------------------------------------------------------------

def extract_query_param(url: Column) -> Column:
    """Text after the first ``query=``; the url itself when there is none."""
    at = F.instr(url, "query=")
    return F.when(at > 0, F.substr(url, at + 6)).otherwise(url)


def escape_stray_percent(col: Column) -> Column:
    return F.regexp_replace(col, "%(?![0-9A-Fa-f]{2})", "%25")


def unquote_plus(col: Column) -> Column:
    """``+`` to space, then percent-decoding; malformed escapes stay as they are, bad bytes become U+FFFD."""
    return F.try_url_decode(escape_stray_percent(F.replace(col, F.lit("+"), F.lit(" "))))


def repair_and_decode(col: Column) -> Column:
    """Decode a log cell whose ``%`` signs may not start a valid escape."""
    return F.url_decode(escape_stray_percent(F.replace(col, F.lit("+"), F.lit(" "))))


def escape_newlines(col: Column) -> Column:
    return F.replace(F.replace(col, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))


def restore_newlines(col: Column) -> Column:
    return F.replace(F.replace(col, F.lit("\\r"), F.lit("\r")), F.lit("\\n"), F.lit("\n"))


def contains_any(col: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(F.lower(col), F.lit(word.lower()))
    return hit


# --- tokens -------------------------------------------------------------------------------------------------------
#
# Canonical tokens travel as one string with SEP around every token: rules that look at neighbouring tokens are then
# plain regular expressions over the row, which cost far less than a lambda per token.

SEP = "\x1f"
_EDGE = rf"(?<={SEP})"


def raw_tokens(text: Column) -> Column:
    """Lexical tokens of a query text without its comments."""
    return F.filter(F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0)), lambda t: ~t.startswith("#"))


def _is_prefixed(t: Column) -> Column:
    return t.rlike(r"^(?:[A-Za-z][^:\s]*)?:")


def _resolve(t: Column, prefixes: Column, base: Column) -> Column:
    """Full IRI for a prefixed name, typed literal with a prefixed datatype, or relative IRI."""
    def iri(name: Column) -> Column:
        declared = F.filter(prefixes, lambda d: d["name"] == F.concat(F.substring_index(name, ":", 1), F.lit(":")))
        return F.when(F.size(declared) > 0, F.concat(
            F.rtrim(F.try_element_at(declared, F.lit(-1))["iri"], F.lit(">")),
            F.replace(F.substr(name, F.instr(name, ":") + 1), F.lit("\\"), F.lit("")), F.lit(">")))

    datatype = F.substring_index(t, "^^", -1)
    return (F.when(_is_prefixed(t), F.coalesce(iri(t), t))
            .when(t.rlike(r"(?s)^[\x22\x27].*\^\^[A-Za-z][^<>\x22\x27\s]*$"),
                  F.concat(F.substr(t, F.lit(1), F.length(t) - F.length(datatype)), F.coalesce(iri(datatype), datatype)))
            .when(base.isNotNull() & t.startswith("<") & t.endswith(">") & ~t.rlike(r"^<[A-Za-z][A-Za-z0-9+.\-]*:"),
                  F.concat(F.rtrim(base, F.lit(">")), F.substr(t, F.lit(2))))
            .otherwise(t))


def _expand_prologue(toks: Column) -> Column:
    """Resolve every name against the PREFIX and BASE declarations of the text and drop the declarations."""
    rows = F.transform(toks, lambda t, i: F.struct(
        F.upper(F.get(toks, i - 2)).alias("before2"), F.get(toks, i - 1).alias("before"), t.alias("tok")))

    def with_rows(rows: Column) -> Column:
        declared = F.transform(F.filter(rows, lambda r: r["before2"] == "PREFIX"),
                               lambda r: F.struct(r["before"].alias("name"), r["tok"].alias("iri")))
        base = F.try_element_at(F.filter(rows, lambda r: F.upper(r["before"]) == "BASE"), F.lit(-1))["tok"]
        length = 3 * F.size(F.filter(rows, lambda r: F.upper(r["tok"]) == "PREFIX")) \
            + 2 * F.size(F.filter(rows, lambda r: F.upper(r["tok"]) == "BASE"))
        return let(F.struct(declared.alias("p"), base.alias("b"), length.alias("n")), lambda pro: F.transform(
            F.slice(toks, pro["n"] + 1, F.greatest(F.size(toks) - pro["n"], F.lit(0))),
            lambda t: _resolve(t, pro["p"], pro["b"])))
    return let(rows, with_rows)


def _joined(toks: Column) -> Column:
    return F.concat(F.lit(SEP), F.array_join(toks, SEP), F.lit(SEP))


def _upper_words(joined: Column) -> Column:
    def spelling(t: Column) -> Column:
        return F.when(t.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.when(
            F.lower(t).isin("true", "false"), F.lower(t)).when(t == "a", t).otherwise(F.upper(t))).otherwise(t)
    return _joined(F.transform(split_tokens(joined), spelling))


def canonical(text: Column) -> Column:
    """Canonical tokens of a text, joined by SEP: prefixes expanded, prologue removed, optional syntax dropped.

    Two texts that differ only in layout, comments, keyword case, prefixes, ``WHERE`` or a trailing dot agree.
    """
    toks = raw_tokens(F.translate(text, SEP, " "))
    expanded = let(toks, lambda ts: _joined(F.when(
        F.exists(ts, lambda t: t.rlike("(?i)^(?:prefix|base)$")), let(ts, _expand_prologue)).otherwise(ts)))
    spelled = let(expanded, lambda j: F.when(
        j.rlike(rf"{_EDGE}(?!a{SEP}|true{SEP}|false{SEP})[A-Z0-9_]*[a-z][A-Za-z0-9_]*{SEP}"), _upper_words(j)).otherwise(j))
    for pattern, value in (
            (rf"{_EDGE}a(?={SEP})", f"<{vocab.RDF_TYPE}>"),
            (rf"{_EDGE}\$(?=\w)", "?"),
            (rf"(?<!{SEP}CONSTRUCT{SEP})(?<={SEP})WHERE{SEP}(?=\{{{SEP})", ""),
            (rf"{_EDGE}\.{SEP}(?=\}}{SEP})", "")):
        spelled = F.regexp_replace(spelled, pattern, value)
    return spelled


def split_tokens(joined: Column) -> Column:
    return F.split(F.substr(joined, F.lit(2), F.length(joined) - 2), SEP)


def skeleton(joined: Column) -> Column:
    """The token classes of a canonical text; equal for queries that differ only in their terms.

    i IRI, l literal, n number or boolean, v variable, b blank node, x undeclared prefix, else the token itself.
    """
    for pattern, cls in (
            (rf"{_EDGE}[\x22\x27][^{SEP}]+", "l"),
            (rf"{_EDGE}<[^{SEP}]*>(?={SEP})", "i"),
            (rf"{_EDGE}\?[^{SEP}]+", "v"),
            (rf"{_EDGE}_:[^{SEP}]*", "b"),
            (rf"{_EDGE}(?:[0-9][^{SEP}]*|[+.\-][^{SEP}]+|true|false)(?={SEP})", "n"),
            (rf"{_EDGE}[^{SEP}]*:[^{SEP}]*", "x")):
        joined = F.regexp_replace(joined, pattern, cls)
    return F.trim(F.replace(joined, F.lit(SEP), F.lit(" ")))


def normal_text(joined: Column) -> Column:
    return F.replace(F.substr(joined, F.lit(2), F.length(joined) - 2), F.lit(SEP), F.lit(" "))


def normalise_query(text: Column) -> Column:
    return normal_text(canonical(text))


def token_class(t: Column) -> Column:
    """Class of one raw token, for token tables."""
    return (F.when(t.rlike(r"^<[^\s]*>$"), "iri")
            .when(t.rlike(r"(?s)^[\x22\x27]."), "literal")
            .when(t.rlike(r"^[?$]."), "variable")
            .when(t.startswith("_:"), "blank")
            .when(t.rlike(r"^[+-]?\.?[0-9]"), "number")
            .when(_is_prefixed(t), "prefixed")
            .when(t.rlike(r"^[A-Za-z_]"), "word")
            .otherwise("sign"))


def query_form(text: Column) -> Column:
    """SELECT / ASK / CONSTRUCT / DESCRIBE, the first word after the prologue; anything else is ``other``."""
    body = F.regexp_replace(
        text, r"(?i)^(?:\s|#[^\n\r]*|prefix\s+[^\s:]*:\s*<[^>]*>|base\s*<[^>]*>)*+", "")
    word = F.upper(F.regexp_extract(body, r"^([A-Za-z]+)", 1))
    return F.when(word.isin(*vocab.QUERY_FORMS), word).otherwise("other")


def strip_limit_offset(norm_text: Column) -> Column:
    """Drop LIMIT and OFFSET clauses of a normalised query; literals and IRIs are skipped over untouched."""
    guarded = r"(\x22(?:[^\x22\\]|\\.)*+\x22|\x27(?:[^\x27\\]|\\.)*+\x27|<[^<>\s]*>)|\s?\b(?:LIMIT|OFFSET) [0-9]+"
    return F.regexp_replace(norm_text, guarded, "$1")


# --- terms --------------------------------------------------------------------------------------------------------

def unescape(col: Column) -> Column:
    out = F.replace(col, F.lit("\\\\"), F.lit("\u0000"))
    for mark, char in (('\\"', '"'), ("\\'", "'"), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
        out = F.replace(out, F.lit(mark), F.lit(char))
    return F.when(F.contains(col, F.lit("\\")), F.replace(out, F.lit("\u0000"), F.lit("\\"))).otherwise(col)


def escape(col: Column) -> Column:
    out = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    for char, mark in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(char), F.lit(mark))
    return out


def term_kind(t: Column) -> Column:
    return (F.when(t.startswith("<"), "uri").when(t.startswith("?"), "variable")
            .when(t.startswith("_:"), "blank").when(t.isNotNull(), "literal"))


_LITERAL = r"(?s)^(\x22{3}|\x27{3}|\x22|\x27)(.*)\1(@[A-Za-z0-9\-]+|\^\^<.*>)?$"


def term_struct(t: Column) -> Column:
    """struct(kind, value, datatype, lang) of a token; plain literals are xsd:string, tagged ones rdf:langString."""
    quoted = t.rlike(r"^[\x22\x27]")
    suffix = F.regexp_extract(t, _LITERAL, 3)
    value = (F.when(t.startswith("<"), F.substr(t, F.lit(2), F.length(t) - 2))
             .when(t.startswith("?"), F.substr(t, F.lit(2)))
             .when(t.startswith("_:"), F.substr(t, F.lit(3)))
             .when(quoted, unescape(F.regexp_extract(t, _LITERAL, 2)))
             .otherwise(t))
    datatype = (F.when(quoted & suffix.startswith("^^"), F.substr(suffix, F.lit(4), F.length(suffix) - 4))
                .when(quoted & suffix.startswith("@"), F.lit(vocab.RDF_LANG_STRING))
                .when(quoted, F.lit(vocab.XSD + "string"))
                .when(t.isin("true", "false"), F.lit(vocab.XSD + "boolean"))
                .when(t.rlike(r"^[+-]?[0-9]+$"), F.lit(vocab.XSD + "integer"))
                .when(t.rlike(r"^[+-]?[0-9]*\.[0-9]+$"), F.lit(vocab.XSD + "decimal"))
                .when(t.rlike(r"^[+-]?[0-9.]+[eE]"), F.lit(vocab.XSD + "double")))
    lang = F.when(quoted & suffix.startswith("@"), F.substr(suffix, F.lit(2)))
    return F.struct(term_kind(t).alias("kind"), value.alias("value"), datatype.alias("datatype"), lang.alias("lang"))


def term_key(kind: Column, value: Column, datatype: Column, lang: Column) -> Column:
    """One string per term, so that constants and graph nodes can be compared by equality."""
    return (F.when(kind == "uri", F.concat(F.lit("<"), value, F.lit(">")))
            .when(kind == "blank", F.concat(F.lit("_:"), value))
            .when(lang.isNotNull(), F.concat(F.lit('"'), value, F.lit('"@'), F.lower(lang)))
            .otherwise(F.concat(F.lit('"'), value, F.lit('"^^'), datatype)))
