"""Merging search results with context into one list of files to read, by buckets. Lists are short: one query each."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from quarryline.functions.paths import COMPOSE

BACKED = {"near_config", "related_doc", "test_of", "sibling_test", "reverse_test", "reverse_import"}
NOISE = set("web tests test route lib src api app".split())


def _test(p: str) -> bool:
    return bool(re.search(r"(?i)(?:^|/)(?:specs?|tests?|__tests__)(?:/|$)|\.(?:spec|test)\.", p))


def _doc(p: str) -> bool:
    return bool(re.search(r"(?i)\.(?:txt|rst|mdx|md)$", p))


def _stem(p: str) -> str:
    name = p.rsplit("/", 1)[-1].lower()
    return re.sub(r"\.[^.]+$", "", re.sub(r"\.(?:spec|test)(?=\.)", "", name, count=1))


def _terms(p: str) -> set[str]:
    return {t for t in re.split(r"[^a-z0-9]+", p.lower()) if len(t) > 2} - NOISE


def plan(search: list[str], context: list[tuple[str, list[tuple[str, str | None]]]], limit: int) -> list[tuple[str, str]]:
    """(path, bucket) in reading order. context: (path, [(reason, its target)])."""
    if limit <= 0:
        return []
    context = [c for c in context if c[0]]
    why = {p: {r for r, _ in rs} for p, rs in context}
    first, later = (search[0] if search else ""), search[1:]
    shown = set(search)
    backed = lambda p: bool(why.get(p, set()) & BACKED)
    route = bool(re.search(r"(?i)(?:^|/)app/api/.+/route\.[cm]?[jt]sx?$", first))

    def test_for(c: tuple, among: set[str]) -> bool:
        return bool(why[c[0]] & {"test_of", "reverse_test"}) or any(r == "sibling_test" and t in among for r, t in c[1])

    def paired(p: str) -> bool:
        return not backed(p) and any(q != p and _test(q) != _test(p) and _stem(q) == _stem(p) and not backed(q) for q in later)

    compose = lambda p: bool(re.match(COMPOSE, p.rsplit("/", 1)[-1]))
    config = [p for p, _ in context if compose(p) and "near_config" in why[p] and p not in shown]
    tests = [c[0] for c in context if test_for(c, shown) and c[0] not in shown]
    crowded = any(map(_doc, later)) or any({"related_doc", "near_config"} & w for w in why.values())
    direct = [p for p, _ in context if "import" in why[p] and (route or p not in shown)]
    if route:
        target = _terms(first)
        direct = sorted(direct, key=lambda p: (-len(_terms(p) & target), p))[:1]
    else:
        direct = direct[:1] if not (config or tests or crowded) else []
    known = shown | set(direct)
    direct_tests = [c[0] for c in context if test_for(c, known) and c[0] not in shown and c[0] not in direct][:1] if route and direct else []
    ahead = {*config, *tests, *direct, *direct_tests}
    alone = [p for p in later if _test(p) and not backed(p) and not any(q != p and not _test(q) and _stem(q) == _stem(p) for q in later)]
    rest = [p for p in later if not backed(p)]
    archive = lambda p: bool(re.search(r"(?i)(?:^|/)docs/archive/", p))
    groups = [
        ("first_search", [first]), ("visible_search_pair", [p for p in later if paired(p)]), ("uncovered_visible_test", alone),
        ("route_direct_import", direct if route else []), ("route_direct_import_test", direct_tests if route else []), ("prioritized_config", [] if route else config),
        ("prioritized_test", tests), ("context_backed_search", [p for p in later if backed(p)]), ("direct_import", [] if route else direct), ("direct_import_test", [] if route else direct_tests),
        ("active_search", [p for p in rest if not archive(p)]), ("prioritized_config", config if route else []), ("remaining_context", [p for p, _ in context if p not in ahead]), ("archived_search", [p for p in rest if archive(p)]),
    ]
    out: dict[str, str] = {}
    for bucket, members in groups:
        for p in members:
            if p:
                out.setdefault(p, bucket)
    return list(out.items())


def merge(lists: DataFrame, limit: int) -> DataFrame:
    """(query_id, place, path, bucket, selected) of (query_id, search array<string>, context array<struct(path, reasons array<struct(kind, target)>)>)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for qid, search, context in f[["query_id", "search", "context"]].itertuples(index=False):
                c = [(x["path"], [(r["kind"], r["target"]) for r in x["reasons"]]) for x in (context if context is not None else [])]
                rows += [(qid, i + 1, p, b, i < limit) for i, (p, b) in enumerate(plan(list(search if search is not None else []), c, limit))]
            yield pd.DataFrame(rows, columns=["query_id", "place", "path", "bucket", "selected"])

    return lists.select("query_id", "search", "context").mapInPandas(run, "query_id string, place int, path string, bucket string, selected boolean")
