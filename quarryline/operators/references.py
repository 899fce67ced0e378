"""References from file to file: extraction by patterns, candidate paths in order, the first existing one wins."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

_QUOTE = "['\"]"
_Q = _QUOTE + r"([^'\"]+)" + _QUOTE
_HEAD = r"(?:^|\n)\s*"
_FROM = r"\b(?:export|import)\s+" + "(?:type" + r"\s+)?(?:.|\n){0,500}?\bfrom\s*" + _Q
_CALL = r"\b{0}\(\s*" + _Q + r"\s*\)"
_JS = [re.compile(rx) for rx in (_FROM, _HEAD + r"import\s*" + _Q, _CALL.replace("{0}", "require"), _CALL.replace("{0}", "import"))]
_PY = re.compile(_HEAD + r"from\s+(\.+)" + r"([A-Za-z_][.\w]*)?" + r"\s+import\s+" + r"([^#\n]+)")
_C = re.compile(_HEAD + r"#\s*include\s*" + r'"([^"]+)"')
IMPORTED = "ts tsx js jsx mjs cjs json yaml yml md py".split()
INCLUDED = "h hh hpp hxx c cc cpp cxx".split()
EXTENSION = r"\.[^/.]+$"
#: What may follow a path without an extension, best first, by the form of a reference.
ENDINGS = {"include": [f".{e}" for e in INCLUDED], "py": [".py", "/__init__.py"], "js": [*(f".{e}" for e in IMPORTED), "/__init__.py", *(f"/index.{e}" for e in IMPORTED)]}
#: What may be meant by a path that ends in .js.
TYPED = [".ts", ".tsx"]
#: References in a batch that leaves a task's Python.
BATCH = 10_000


def family(language: str, path: str) -> str | None:
    p = path.lower()
    if language in ("javascript", "typescript") or re.search(r"\.[cm]?[jt]sx?$", p):
        return "js"
    if language in ("py", "python") or p.endswith(".py"):
        return "py"
    if language in ("c", "cpp", "h", "hpp") or re.search(r"\.(?:hxx|hpp|hh|h|cxx|cpp|cc|c)$", p):
        return "c"
    return None


def extract_one(text: str, language: str, path: str) -> list[tuple[str, str, int, int]]:
    """(kind, specifier, first line, last line), one per kind and specifier: the first pattern's first match."""
    out: dict[tuple[str, str], tuple[int, int]] = {}
    kind = family(language or "", path)
    at, line = 0, 1

    def add(what: str, spec: str, m: re.Match) -> None:
        nonlocal at, line
        if m.start() < at:  # another pattern starts over
            at, line = 0, 1
        line, at = line + text.count("\n", at, m.start()), m.start()
        out.setdefault((what, spec), (line, line + m[0].count("\n")))

    clean = lambda s: re.split(r"[?#]", s, maxsplit=1)[0].strip()
    if kind == "js":
        for rx in _JS:
            for m in rx.finditer(text):
                spec = clean(m[1])
                if spec and spec[0] != "/" and not re.match(r"[a-zA-Z]+:", spec):
                    add("import", spec, m)
    elif kind == "py":
        for m in _PY.finditer(text):
            up = "../" * (len(m[1]) - 1) or "./"
            if m[2]:
                add("import", up + m[2].replace(".", "/"), m)
                continue
            for part in m[3].split(","):
                name = re.split(r"\s+as\s+", part.strip())[0]
                if re.fullmatch(r"[A-Za-z_]\w*", name):
                    add("import", up + name, m)
    elif kind == "c":
        for m in _C.finditer(text):
            spec = clean(m[1])
            if spec and spec[0] != "/":
                add("include", spec, m)
    return [(w, s, a, b) for (w, s), (a, b) in out.items()]


def inside(path: str) -> str | None:
    p = posixpath.normpath(path)
    return None if p in (".", "") or p.startswith(("../", "/")) or p == ".." else p


def _has_extension(path: str) -> bool:
    return bool(re.search(EXTENSION, path))


def form(kind: str, path: str, language: str) -> str:
    """Which endings a reference's paths may get."""
    return "include" if kind == "include" else "py" if family(language, path) == "py" else "js"


def bases(kind: str, path: str, spec: str, aliases: list[str] | None = None) -> list[str]:
    """The paths that a reference names, before any ending: one, or several by aliases, best first."""
    if kind != "include" and not spec.startswith("."):
        return list(dict.fromkeys(aliases or []))
    local = inside(posixpath.join(posixpath.dirname(path), spec))
    return [local] if local else []


def candidates(kind: str, path: str, language: str, spec: str, aliases: list[str] | None = None) -> list[str]:
    """Paths that a reference may mean, best first."""
    f, out = form(kind, path, language), []
    for b in bases(kind, path, spec, aliases):
        out += [b] if _has_extension(b) else [b, *(b + e for e in ENDINGS[f])]
        if f == "js" and b.endswith(".js"):
            out += [b[:-3] + e for e in TYPED]
    return list(dict.fromkeys(out))


def strip_comments(text: str) -> str:
    """JSON with comments and trailing commas to JSON."""
    plain = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*[\s\S]*?\*/', lambda m: m[1] or "", text)
    return re.sub(r",\s*([}\]])", r"\1", plain)


def alias_rules(path: str, text: str) -> list[dict]:
    """Alias rules of a compiler configuration file."""
    try:
        options = (json.loads(strip_comments(text)) or {}).get("compilerOptions") or {}
        table = options.get("paths") or {}
    except (ValueError, AttributeError):
        return []
    if not isinstance(table, dict):
        return []
    folder = posixpath.dirname(path)
    base = inside(posixpath.join(folder, options.get("baseUrl") or ".")) or folder
    out = []
    for pattern, targets in table.items():
        targets = [t for t in targets if isinstance(t, str)] if isinstance(targets, list) else []
        if targets:
            head, star, tail = pattern.partition("*")
            out.append({"config_dir": folder, "base_dir": base, "pattern": pattern, "prefix": head, "suffix": tail if star else "", "targets": targets})
    return out


def alias_paths(rules: list[dict], path: str, spec: str) -> list[str]:
    """Paths by the rules of the nearest configuration above ``path``, longest prefix first."""
    if spec[:1] in "./" or re.match(r"[a-zA-Z]+:", spec):
        return []
    hits = []
    for r in rules:
        d = r["config_dir"]
        if d and not (path == d or path.startswith(d + "/")):
            continue
        if "*" not in r["pattern"]:
            if spec == r["pattern"]:
                hits.append((r, ""))
        elif spec.startswith(r["prefix"]) and spec.endswith(r["suffix"]):
            hits.append((r, spec[len(r["prefix"]) : len(spec) - len(r["suffix"])]))
    deepest = max((len(r["config_dir"]) for r, _ in hits), default=-1)
    near = sorted((x for x in hits if len(x[0]["config_dir"]) == deepest), key=lambda x: (-len(x[0]["prefix"]), x[0]["pattern"]))
    found = [inside(posixpath.join(r["base_dir"], t.replace("*", wild, 1))) for r, wild in near for t in r["targets"]]
    return [p for p in dict.fromkeys(found) if p]


def extract(df: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """(path, kind, specifier, line_start, line_end, ref, form, bases) of files (path, language, text).

    Texts are read one by one, and what is found leaves in batches, however much a file refers to.
    """
    names = ["path", "kind", "specifier", "line_start", "line_end", "ref", "form", "bases"]
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in names]

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
            for c in cols:
                c.clear()
            return made

        for f in batches:
            for path, language, text in zip(*(f.column(c) for c in ("path", "language", "text"))):
                path, language = path.as_py(), language.as_py() or ""
                js = rules and family(language, path) == "js"
                for ref, (kind, spec, a, b) in enumerate(extract_one(text.as_py() or "", language, path)):
                    aliases = alias_paths(rules, path, spec) if js else None
                    for c, x in zip(cols, (path, kind, spec, a, b, ref, form(kind, path, language), bases(kind, path, spec, aliases))):
                        c.append(x)
                    if len(cols[0]) >= BATCH:
                        yield batch()
        yield batch()

    schema = "path string, kind string, specifier string, line_start int, line_end int, ref int, form string, bases array<string>"
    return df.select("path", "language", "text").mapInArrow(run, schema)


def named_by(files: DataFrame) -> DataFrame:
    """(form, base, target): for each form of references, the first existing file that a base means: ``candidates`` read backwards."""
    p = F.col("path")
    row = lambda f, base, n: F.struct(F.lit(f).alias("form"), base.alias("base"), F.lit(n).alias("n"))
    cutting = lambda end: F.substring(p, F.lit(1), F.length(p) - len(end))

    def ending(f: str, n: int, end: str) -> Column:
        return F.when(F.endswith(p, F.lit(end)) & (cutting(end) != "") & ~cutting(end).rlike(EXTENSION), row(f, cutting(end), n))

    rows = [row(f, p, 0) for f in ENDINGS] + [ending(f, n, e) for f, ends in ENDINGS.items() for n, e in enumerate(ends, 1)]
    rows += [F.when(F.endswith(p, F.lit(e)), row("js", F.concat(cutting(e), F.lit(".js")), n)) for n, e in enumerate(TYPED, 1)]
    x = files.select("path", F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("x"))
    return x.groupBy("x.form", "x.base").agg(F.min(F.struct("x.n", "path")).alias("m")).select("form", "base", F.col("m.path").alias("target"))


def resolve(references: DataFrame, files: DataFrame, aliased: bool = True) -> DataFrame:
    """References with ``target``, the first candidate that exists; others are left out.

    Files say which bases they are meant by, so that a reference meets one row for each of its bases, not one for each candidate.
    aliased: whether references may have several bases (those of aliases); such ones are read once more.
    """
    rows = ["path", "kind", "specifier", "line_start", "line_end", "ref"]
    meant = named_by(files)
    found = lambda refs, *more: refs.join(meant, ["base", "form"]).select(*rows, *more, "base", "form", "target").distinct().select(*rows, *more, "target")
    one = references.filter("size(bases) = 1") if aliased else references
    out = found(one.select(*rows, "form", F.explode("bases").alias("base")))
    if not aliased:
        return out
    several = found(references.filter("size(bases) > 1").select(*rows, "form", F.posexplode("bases").alias("ord", "base")), "ord")
    first = W.partitionBy("path", "ref").orderBy("ord")
    return out.unionByName(several.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn", "ord"))


def edges(resolved: DataFrame) -> DataFrame:
    """(src, dst, kind, specifier, line_start, line_end): edges by natural key, no loops. resolved: ``resolve``, which has a key once."""
    kind = F.when(F.col("kind") == "include", "includes").otherwise("imports")
    return resolved.filter("path <> target").select(F.col("path").alias("src"), F.col("target").alias("dst"), kind.alias("kind"), "specifier", "line_start", "line_end")
