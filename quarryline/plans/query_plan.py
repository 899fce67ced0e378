"""Keyword queries to plans: terms, intents and tiers of index queries. Queries are short; a batch is a small table."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
import regex
from pyspark.sql import DataFrame

from quarryline.functions.text import CASE_BOUNDARY

STOP = set("with to the put post or on of into in get from for by api and an a".split())
CODE_TERMS = set("service pipeline orchestrator method macro lock implemented handler function endpoint delivery class aggregator".split())
ENDPOINT_NOISE = set("should shows show returns return".split())
#: Tuned rows, as data, so that they can be switched off: joined words, words that stand for a path term, pairs.
COMPOUNDS = {"localstorage"}
PATH_TERMS = {"preload": ["retrieval"]}
SCOPE_PAIR = ("session", "repo", "scope")
#: (words, roles), in order; words with a blank are looked for in the query text, others among its terms.
INTENTS: list[tuple[str, str]] = [
    ("readme|purpose|project about|what is this project", "overview"),
    ("claude|program|instructions|agents|agent", "agent_instructions"),
    ("edit", "overview agent_instructions implementation/main"),
    ("run|provider|pipeline|orchestrator|used|model|architecture|defined|source|implementation|implemented", "implementation"),
    ("providers|provider", "provider"),
    ("orchestrator|entrypoint|entry|main", "implementation implementation/main"),
    ("configuration|config", "configuration"),
    ("documentation|doc|docs", "documentation"),
    ("scopes|scope|decision|adr", "decision_record"),
    ("testing|test|tests", "tests"),
    ("computed", "setup/utility"),
    ("prepare|preparation|setup|data", "setup/utility"),
    ("do not modify|not modified|not be modified", "overview setup/utility"),
    ("pyproject|package|dependency|dependencies", "dependencies"),
]
SCHEMA = (
    "query_id string, query string, normalized string, terms array<string>, core_terms array<string>, phrases array<string>, path_like boolean, path_needle string, code_intent boolean, "
    "role_intents array<string>, path_terms array<string>, endpoint_terms array<string>, tiers array<struct<ord:int,kind:string,words:array<string>,boost:int,text:string>>"
)


def unique(items: list[str]) -> list[str]:
    return list(dict.fromkeys(items))


def split_term(term: str) -> list[str]:
    """A term and its parts at case changes and punctuation."""
    s = re.sub(CASE_BOUNDARY, " ", term)
    return [p for p in [term, *re.sub(r"[.$/\\_-]+", " ", s).split()] if p]


def compounds(raw: list[str]) -> list[str]:
    """Neighbouring words that may be one identifier."""
    last = [x[-1].lower() for x in map(split_term, raw) if x]
    out = []
    for a, b in zip(last, last[1:]):
        joined = a + b
        if not {a, b} & STOP and (min(len(a), len(b)) == 1 or joined in COMPOUNDS) and 5 <= len(joined) <= 32 and regex.fullmatch(r"[\p{L}\p{N}]+", joined):
            out.append(joined)
    return unique(out)


def expand(terms: list[str], raw: list[str]) -> list[str]:
    out = [p.lower() for t in terms for p in split_term(t) if len(p) > 1]
    if SCOPE_PAIR[0] in out and SCOPE_PAIR[1] in out:
        out.append(SCOPE_PAIR[2])
    return unique(out + compounds(raw))[:16]


def intents(normalized: str, terms: list[str]) -> list[str]:
    out: list[str] = []
    for words, roles in INTENTS:
        hit = any(w in normalized if " " in w else w in terms for w in words.split("|"))
        if roles == "overview":  # a bare "overview" asks for overviews only if little else is asked
            hit = hit or ("overview" in terms and len(terms) <= 2)
        if hit:
            out += roles.split()
    return unique(out)


def endpoint_terms(terms: list[str]) -> list[str]:
    """The two terms before each "endpoint" and the one after."""
    near = [t for i, x in enumerate(terms) if x == "endpoint" for t in terms[max(0, i - 2) : i] + terms[i + 1 : i + 2]]
    return unique([t for t in near if len(t) > 2 and t not in STOP and t not in ENDPOINT_NOISE])


def prefix_of(term: str) -> str:
    m = regex.search(r"[\p{L}\p{N}_]+", term)
    return m[0] if m and len(m[0]) > 2 else ""


def quoted(words: list[str], glue: str = " ") -> str:
    return glue.join('"' + w.replace('"', '""') + '"' for w in words)


@dataclass
class Plan:
    query: str
    normalized: str = ""
    terms: list[str] = field(default_factory=list)
    core_terms: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    path_like: bool = False
    path_needle: str = ""
    code_intent: bool = False
    role_intents: list[str] = field(default_factory=list)
    path_terms: list[str] = field(default_factory=list)
    endpoint_terms: list[str] = field(default_factory=list)
    tiers: list[dict] = field(default_factory=list)


def plan_query(query: str) -> Plan:
    """The plan of one query; a query without terms and phrases is an error."""
    raw = query.strip()
    phrases = [x for x in (m.strip() for m in re.findall(r'"([^"]+)"', raw)) if x]
    words = regex.findall(r"[_.$/\-\p{N}\p{L}]+", raw)
    first = words[:12]
    if not first and not phrases:
        raise ValueError("the query has nothing to search for")
    needle = re.sub(r'^"|"$', "", raw)
    p = Plan(query, needle.lower(), expand(first, words), phrases=phrases, path_needle=needle)
    p.core_terms = [t for t in p.terms if t not in STOP][:16]
    p.path_like = bool(re.search(r"[-\\./]|\.[0-9a-zA-Z]{1,8}$", raw))
    p.code_intent = any(t in CODE_TERMS for t in p.core_terms)
    p.role_intents = intents(p.normalized, p.core_terms)
    p.path_terms = unique([x for t in p.core_terms for x in PATH_TERMS.get(t, [])])
    p.endpoint_terms = endpoint_terms(p.terms)
    broad = p.terms if len(first) > 1 else [t.lower() for t in first]
    prefixes = [x for x in map(prefix_of, broad) if x]
    tiered = bool(phrases) or len(p.terms) > 1
    tiers = [("phrase", [x], 24, quoted([x])) for x in phrases]
    tiers += [("all", first, 18, quoted(first)), ("all", p.core_terms, 16, quoted(p.core_terms))]
    if SCOPE_PAIR[0] in p.core_terms and SCOPE_PAIR[1] in p.core_terms:
        tiers.append(("all", list(SCOPE_PAIR[:2]), 14, quoted(list(SCOPE_PAIR[:2]))))
    tiers += [("all", p.terms, 12, quoted(p.terms)), ("prefix", prefixes, 8, " OR ".join(x + "*" for x in prefixes)), ("any", broad, 0, quoted(broad, " OR "))]
    best: dict[str, dict] = {}
    for kind, w, boost, text in tiers:
        boost = boost if tiered else 0
        if text and (text not in best or boost > best[text]["boost"]):
            best[text] = {"kind": kind, "words": w, "boost": boost, "text": text}  # a repeated text keeps its first place
    p.tiers = [{"ord": i, **t} for i, t in enumerate(best.values())]
    return p


def plan(queries: DataFrame) -> DataFrame:
    """Plans of (query_id, query) rows; rows without anything to search for are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for qid, q in f[["query_id", "query"]].itertuples(index=False):
                try:
                    rows.append({"query_id": qid, **asdict(plan_query(q or ""))})
                except ValueError:
                    continue
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in "query_id query normalized terms core_terms phrases path_like path_needle code_intent role_intents path_terms endpoint_terms tiers".split()])

    return queries.select("query_id", "query").mapInPandas(run, SCHEMA)
