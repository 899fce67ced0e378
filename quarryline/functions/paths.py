"""What a file's path tells: language, roles, neighbourhood. All as column expressions over ``path`` and ``size``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryline.functions.text import first_of

#: Extension to language; what is missing is not indexed.
LANGUAGES = (
    {e: "markdown" for e in ("md", "mdx")} | {e: "typescript" for e in ("ts", "tsx")} | {e: "javascript" for e in ("js", "jsx", "mjs", "cjs")}
    | {e: "yaml" for e in ("yml", "yaml")} | {e: "c" for e in ("c", "h")} | {e: "cpp" for e in ("cc", "cpp", "cxx", "hh", "hpp", "hxx")}
    | {e: e for e in "json txt toml sql css scss html py go rs java kt sh bash zsh rb php".split()}
)
LARGEST_FILE = 1_000_000
LARGE_JSON = 64_000
SKIPPED_DIRS = (
    ".venv venv env __pycache__ .pytest_cache .mypy_cache .ruff_cache .tox site-packages .gradle .parcel-cache "
    "vendor coverage .next target build dist node_modules .git .vscode .idea .cache .turbo"
).split()
CODE = r"\.(?:[cm]?[jt]sx?|swift|scala|sql|sh|kt|hpp|h|cpp|cs|c|php|rb|java|rs|go|py)$"
DOC_INTENTS = ["agent_instructions", "decision_record", "documentation", "overview"]
COMPOSE = r"^docker-compose([-.].*)?[.]ya?ml$"
NOISE_ROLES = ["large_json", "minified", "build_output", "generated", "lockfile"]


def _word(word: str) -> str:
    """A word between dots, dashes or underscores."""
    return f"(?:^|[-_.]){word}(?:[-_.]|$)"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def stem(path: Column) -> Column:
    """Base name in lower case without its last extension."""
    return F.lower(F.regexp_replace(basename(path), r"\.[^.]+$", ""))


def bare_stem(path: Column) -> Column:
    """Base name in lower case without all its extensions."""
    return F.regexp_replace(F.lower(basename(path)), r"(?:\.[^.]+)+$", "")


def test_stem(path: Column) -> Column:
    return F.regexp_replace(stem(path), r"(?i)[-_.](test|spec)$|(test|spec)[-_.]$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"\.([^.]+)$", 1)


def language(path: Column) -> Column:
    """Language of an indexable file, else an empty string."""
    table = F.create_map(*[F.lit(x) for e, lang in LANGUAGES.items() for x in (e, lang)])
    return F.coalesce(table[extension(path)], F.lit(""))


def in_prefix(path: Column, prefix: str) -> Column:
    """Case-insensitive scope, as for searching; deletions use ``startswith`` (case matters there)."""
    return F.lower(path).startswith(prefix.lower()) if prefix else F.lit(True)


def normalize_prefix(prefix: str | None) -> str:
    """A folder prefix with one trailing slash, or nothing."""
    parts: list[str] = []
    for p in (prefix or "").replace("\\", "/").strip("/").split("/"):
        if p == ".." and parts and parts[-1] != "..":
            parts.pop()
        elif p not in ("", "."):
            parts.append(p)
    return "/".join(parts) + "/" if parts else ""


def is_secret(path: Column) -> Column:
    b = basename(path)
    return b.rlike(r"^\.env($|\.)") | path.rlike(r"(?i)secret|private[-_]?key")


def is_binary_name(path: Column) -> Column:
    return basename(path).rlike(r"(?i)(?:\.min\.js|\.zip|\.pdf|\.webp|\.gif|\.jpe?g|\.png|\.sqlite(?:-shm|-wal)?)$")


def in_skipped_dir(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIPPED_DIRS)))


def skip_reason(path: Column, size: Column, binary: Column | None = None, ignored: Column | None = None) -> Column:
    """Why a file is not indexed, null if it is; the first reason wins."""
    rules: list[tuple[Column, object]] = [
        (in_skipped_dir(path), "ignored directory"),
        (is_binary_name(path), "binary/generated extension"),
        (is_secret(path), "secret-like file"),
    ]
    if ignored is not None:
        rules.append((ignored.isNotNull(), ignored))
    rules += [(size > LARGEST_FILE, "too large"), (language(path) == "", "unsupported extension")]
    if binary is not None:
        rules.append((binary, "binary content"))
    return first_of(rules)


def is_code(path: Column) -> Column:
    return F.lower(path).rlike(CODE)


def is_markdown(path: Column) -> Column:
    return F.lower(path).rlike(r"\.mdx?$")


def is_test(path: Column) -> Column:
    p = F.lower(path)
    return p.rlike(r"(?:^|/)(?:spec|tests?|__tests__)(?:/|$)") | basename(p).rlike(_word("(?:spec|test)"))


def is_lockfile(path: Column) -> Column:
    p = F.lower(path)
    return basename(p).rlike(r"^(?:npm-shrinkwrap|package-lock)\.json$|^pnpm-lock\.ya?ml$|\.lock$")


def is_route(path: Column) -> Column:
    return path.rlike(r"(?i)(?:^|/)app/api/.+/route\.[cm]?[jt]sx?$")


def is_handler(path: Column) -> Column:
    return F.lower(basename(path)).rlike(_word("handler"))


def roles(path: Column, size: Column) -> Column:
    """The roles of a file, in a fixed order without repeats."""
    p = F.lower(path)
    b, parts = basename(p), F.split(p, "/")
    lock = is_lockfile(p)
    one = lambda cond, *names: [F.when(cond, F.lit(n)) for n in names]
    found = [
        *one(b == "readme.md", "overview"),
        *one(b.isin("claude.md", "agents.md", "program.md"), "agent_instructions"),
        *one(p == ".claude/settings.local.json", "local_agent_settings"),
        *one(p.rlike("(?:^|/)src/"), "implementation"),
        *one(F.array_contains(parts, "providers") | b.rlike(_word("provider")), "provider"),
        *one(b.isin("index.js", "index.ts", "main.py", "train.py"), "implementation", "implementation/main"),
        *one(b.isin("setup.py", "prepare.py"), "setup/utility"),
        *one(p.rlike("(?:^|/)scripts/"), "tooling"),
        *one(p.rlike("(?:^|/)(?:__tests__|tests?)/"), "tests"),
        *one(p.rlike("(?:^|/)docs/archive/"), "archived_documentation"),
        *one(p.rlike("(?:^|/)docs/adr/"), "decision_record"),
        *one(p.rlike("(?:^|/)docs/") | b.rlike(r"\.(?:txt|rst|mdx|md)$"), "documentation"),
        *one(b.isin("go.mod", "cargo.toml", "requirements.txt", "package.json", "pyproject.toml"), "dependencies", "configuration"),
        *one(b.rlike(r"\.(?:env|ini|toml|ya?ml|json)$") & ~lock, "configuration"),
        *one(lock, "lockfile"),
        *one(F.arrays_overlap(parts, F.array(*map(F.lit, ["vendor", "coverage", ".next", "build", "dist"]))), "build_output"),
        *one(F.exists(parts, lambda x: F.contains(x, F.lit("generated"))) | b.rlike(_word("generated")), "generated"),
        *one(b.rlike(r"\.min\.[cm]?js$"), "minified"),
        *one(b.rlike(r"\.json$") & (F.coalesce(size, F.lit(0)) >= LARGE_JSON), "large_json"),
    ]
    return F.array_distinct(F.array_compact(F.array(*found)))


def role_boost(role_list: Column, intents: Column) -> Column:
    both = lambda r: F.array_contains(role_list, r) & F.array_contains(intents, r)
    return first_of([(both("implementation/main"), 24), (both("setup/utility"), 22), (F.arrays_overlap(role_list, intents), 15)], 0)


def role_penalty(role_list: Column, intents: Column, path_like: Column, normalized: Column, terms: Column) -> Column:
    """Points off for noise, fewer if the query asks for such files."""
    has = lambda r: F.array_contains(role_list, r)
    wants = lambda r: F.array_contains(intents, r)
    said = F.concat_ws(" ", normalized, F.array_join(terms, " "))
    lock = said.rlike(r"\b(?:lockfile|\S+[.]lock|npm-shrinkwrap[.]json|package-lock[.]json|pnpm-lock[.]ya?ml)\b")
    generated = path_like & said.rlike(r"\b(?:__generated__|generated)\b")
    built = path_like & said.rlike(r"(?:^|[\\/])(?:vendor|build|dist)(?:$|[\\/])|[.]min[.][mc]?js\b")
    json = said.rlike(r"\blarge json\b|\.json\b")
    off = lambda cond, points: F.when(cond, points).otherwise(0)
    return (
        off(has("agent_instructions") & ~wants("agent_instructions"), F.lit(18))
        + off(has("local_agent_settings") & ~path_like & ~wants("agent_instructions") & ~wants("configuration"), F.lit(18))
        + off(has("lockfile") & ~lock, F.lit(60))
        + off(has("generated"), F.when(generated, 8).otherwise(60))
        + off(has("build_output") | has("minified"), F.when(built, 12).otherwise(48))
        + off(has("large_json"), F.when(json, 12).otherwise(36))
        + off(has("archived_documentation") & ~normalized.rlike(r"\barchive[ds]?\b"), F.lit(14))
    )


def is_noisy(path: Column, size: Column) -> Column:
    return F.arrays_overlap(roles(path, size), F.array(*map(F.lit, NOISE_ROLES)))


def is_config(path: Column, size: Column) -> Column:
    b = F.lower(basename(path))
    return F.array_contains(roles(path, size), "configuration") | b.rlike(_word("config")) | b.rlike(r"\.config\.[cm]?[jt]sx?$")


def module(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return first_of([(F.size(parts) == 0, "."), (parts[0].isin("apps", "packages") & (F.size(parts) > 1), F.concat_ws("/", parts[0], F.get(parts, F.lit(1))))], parts[0])


def stem_affinity(a: Column, b: Column) -> Column:
    """Whether one stem continues the other behind a dot, dash or underscore."""
    grows = lambda x, y: (F.length(y) > F.length(x)) & F.startswith(y, x) & F.array_contains(F.array(F.lit("."), F.lit("-"), F.lit("_")), F.substr(y, F.length(x) + 1, F.lit(1)))
    return (a != b) & (grows(a, b) | grows(b, a))


def locality(base: Column, path: Column) -> Column:
    """Ten points per leading folder shared, five for the same folder, one off per level apart."""
    folders = lambda p: F.slice(F.split(p, "/"), 1, F.size(F.split(p, "/")) - 1)
    a, b = folders(base), folders(path)
    n = F.least(F.size(a), F.size(b))
    spine = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    shared = F.aggregate(spine, F.lit(0), lambda acc, i: F.when((acc == i) & (F.get(a, i) == F.get(b, i)), acc + 1).otherwise(acc))
    return shared * 10 + F.when((F.size(a) == F.size(b)) & (shared == F.size(a)), 5).otherwise(0) - F.abs(F.size(a) - F.size(b))


ROUTE_NOISE = "server lib web src handler route api app".split()


def singular(term: Column) -> Column:
    return F.when(term.endswith("s") & (F.length(term) > 4), F.substr(term, F.lit(1), F.length(term) - 1)).otherwise(term)


def path_terms(path: Column) -> Column:
    parts = F.transform(F.split(F.lower(path), "[^a-z0-9]+"), singular)
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) >= 3))


def route_terms(path: Column) -> Column:
    inner = F.regexp_extract(F.lower(path), r"(?:^|/)app/api/(.+)/route\.[cm]?[jt]sx?$", 1)
    return F.filter(path_terms(inner), lambda t: ~t.isin(*ROUTE_NOISE))


def affinity(path: Column, target: Column) -> Column:
    """Path terms that both share."""
    noise = F.array(*map(F.lit, "web tests test route lib src api app".split()))
    terms = lambda p: F.array_except(F.array_distinct(F.filter(F.split(F.lower(p), "[^a-z0-9]+"), lambda t: F.length(t) > 2)), noise)
    return F.size(F.array_intersect(terms(path), terms(target)))
