"""Declarations per line, by tables of patterns; the first pattern that fits a line decides.

One pattern per table finds the lines that any of its patterns fits; for these few lines the tables are data, walked
by one expression, so that the plan's code doesn't grow with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_N = r"([$_A-Za-z][$\w]*)"
_I = r"([A-Za-z_]\w*)"
_W = r"\s+"


def _maybe(*words: str) -> str:
    """Words that may come first, each with blanks behind it."""
    return "".join(f"(?:{w}{_W})?" for w in words)


def _any(words: str, least: str = "*") -> str:
    """Any number of the words, each with blanks behind it."""
    return f"(?:(?:{'|'.join(words.split())}){_W}){least}"


_AT = r"^\s*"
_SEEN = "protected private public"
_PUB = _AT + _maybe(r"pub(?:\([^)]*\))?")
#: language: (kind or None to take it from group 1, pattern, group of the name)
PATTERNS: dict[str, list[tuple[str | None, str, int]]] = {
    "js": [
        ("class", _AT + _maybe("export", "default", "abstract") + f"class{_W}{_N}", 1),
        ("function", _AT + _maybe("export", "default", "async") + rf"function(?:{_W}|\s*\*\s*){_N}", 1),
        ("function", _AT + _maybe("export") + rf"const{_W}{_N}\s*=\s*" + r"(?:async\s*)?\(", 1),
        ("interface", _AT + _maybe("export") + f"interface{_W}{_N}", 1),
        ("type", _AT + _maybe("export") + f"type{_W}{_N}", 1),
        ("method", _AT + _any(_SEEN, "?") + _N + r"\s*\([^)]*\)" + r"\s*[{:]", 1),
        ("function", _AT + _maybe("async") + rf"def{_W}{_I}\s*\(", 1),
    ],
    "py": [("class", _AT + f"class{_W}{_N}", 1), ("function", _AT + _maybe("async") + rf"def{_W}{_I}\s*\(", 1)],
    "markdown": [("heading", r"^\s{0,3}" + f"#{{1,6}}{_W}" + "(.+)", 1)],
    "go": [
        ("method", _AT + rf"func{_W}\([^)]*\)\s*{_I}\s*[(\[]", 1), ("function", _AT + rf"func{_W}{_I}\s*[(\[]", 1),
        *((kind, _AT + f"type{_W}{_I}{rest}", 1) for kind, rest in (("class", _W + r"struct\b"), ("interface", _W + r"interface\b"), ("type", r"\b"))),
    ],
    "rs": [
        ("function", _PUB + _any(r'extern(?:\s*"[^"]*")? const unsafe async') + f"fn{_W}{_I}", 1),
        *((kind, _PUB + f"{word}{_W}{_I}", 1) for word, kind in (("struct", "class"), ("enum", "type"), ("trait", "interface"), ("type", "type"))),
    ],
    "java": [
        (None, _AT + _any("sealed static final abstract " + _SEEN) + f"(record|enum|interface|class){_W}{_I}", 2),
        ("method", _AT + _any(_SEEN, "") + _any("default native synchronized abstract final static") + rf"[\w.,?<>\[\]]+{_W}{_I}\s*\([^;{{]*\)\s*(?:throws [\s\w,.]+)?\{{?\s*$", 1),
    ],
    "kt": [
        ("function", _AT + _any("operator tailrec abstract final inline suspend override open internal " + _SEEN) + rf"fun{_W}(?:<[^>]*>\s*)?{_I}\s*[(<]", 1),
        (None, _AT + _any("value inner annotation enum data final abstract sealed open internal " + _SEEN) + f"(object|interface|class){_W}{_I}", 2),
    ],
    "rb": [
        ("method", _AT + rf"def{_W}(?:self\.)?([A-Za-z_]\w*[=?!]?)", 1), ("class", _AT + rf"class{_W}([A-Za-z_][:\w]*)", 1), ("module", _AT + rf"module{_W}([A-Za-z_][:\w]*)", 1),
    ],
    "php": [
        (None, _AT + _any("final abstract") + f"(enum|trait|interface|class){_W}{_I}", 2),
        ("method", _AT + _any("abstract final static " + _SEEN, "+") + rf"function{_W}&?\s*{_I}\s*\(", 1), ("function", _AT + rf"function{_W}&?\s*{_I}\s*\(", 1),
    ],
    "c": [
        (None, _AT + _maybe("typedef") + rf"(struct|union|enum|class){_W}{_I}\b[^;]*\{{", 2),
        ("c", _AT + rf"([A-Za-z_][~:,<>&*\w\s]*?[>:&*\s]){_I}\s*\(", 2),
    ],
}
TABLE = {"typescript": "js", "javascript": "js", "python": "py", "cpp": "c"}
_AGGREGATES = {"enum": "type", "trait": "interface", "interface": "interface", "module": "module"}
_CONTROL = "loop match when do else sizeof catch return switch while for if".split()


#: Tables whose comment lines declare nothing.
_COMMENTED = [t for t in PATTERNS if t not in ("js", "py", "markdown")]


def _declaration(table: Column, line: Column) -> Column:
    """A struct of name and kind, from the first rule of the table that fits; null if none does."""
    rule = lambda k, rx, group: F.struct(F.lit(k).alias("kind"), F.lit(rx).alias("rx"), F.lit(group).alias("group"))
    tables = F.create_map(*[x for t, rules in PATTERNS.items() for x in (F.lit(t), F.array(*[rule(*r) for r in rules]))])
    known = F.create_map(*[F.lit(x) for p in _AGGREGATES.items() for x in p])
    trimmed = F.trim(line)

    def read(r: Column) -> Column:
        group = lambda n: F.call_function("regexp_extract", line, r["rx"], F.lit(n))
        first, c = group(1), r["kind"] == "c"
        name = F.trim(F.when(r["group"] == 1, first).otherwise(group(2)))
        kind = F.when(r["kind"].isNull(), F.when(table == "c", first).otherwise(F.coalesce(known[first], F.lit("class"))))
        kind = kind.when(c, F.when(F.contains(first, F.lit("::")), "method").otherwise("function")).otherwise(r["kind"])
        ok = (name != "") & ~name.isin(*_CONTROL) & ~(F.coalesce(c, F.lit(False)) & trimmed.endswith(";"))
        return F.when(ok, F.struct(name.alias("name"), kind.alias("kind")))

    return F.get(F.filter(F.transform(tables[table], read), lambda x: x.isNotNull()), F.lit(0))


def _declares(table: Column, line: Column) -> Column:
    """Whether any pattern of the table fits the line."""
    out = F.lit(False)
    for t, rules in PATTERNS.items():
        out = F.when(table == t, line.rlike("|".join(f"(?:{rx})" for _, rx, _ in rules))).otherwise(out)
    trimmed = F.trim(line)
    comment = trimmed.rlike(r"^(?:#|//|\*|/\*)") | (trimmed == "")
    return out & ~(table.isin(*_COMMENTED) & comment)


def extract(df: DataFrame, key: list[str], text_col: str = "text", language_col: str = "language") -> DataFrame:
    """(key, name, kind, start_line, signature) of every declaration; one pass over lines."""
    table = F.coalesce(F.create_map(*[F.lit(x) for p in TABLE.items() for x in p])[F.col(language_col)], F.col(language_col))
    rows = df.select(*key, table.alias("_t"), text_col).filter(F.col("_t").isin(*PATTERNS))
    rows = rows.select(*key, "_t", F.posexplode(F.split(text_col, r"\r?\n", -1)).alias("_i", "_line")).filter(_declares(F.col("_t"), F.col("_line")))
    out = rows.withColumn("_d", _declaration(F.col("_t"), F.col("_line")))
    return out.filter("_d is not null").select(*key, "_d.name", "_d.kind", (F.col("_i") + 1).alias("start_line"), F.substring(F.trim("_line"), 1, 240).alias("signature"))


def duplicates(symbols: DataFrame) -> DataFrame:
    """Groups of symbols with one file, name and line."""
    return symbols.groupBy("file_id", "name", "start_line").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
