"""Ignore rules: the last matching line decides, a leading ``!`` takes a path back in."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """``*`` and ``?`` stay within a folder, ``**`` crosses folders."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i]) or re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", glob[i])
        i += 1
    return f"^{out}$"


def rules_of(text: str) -> list[str]:
    lines = (x.strip() for x in re.split(r"\r?\n", text))
    return [x for x in lines if x and not x.startswith("#")]


def matches(path: Column, rule: str) -> Column:
    """Whether one rule (without its ``!``) names a path."""
    body = rule.removeprefix("/")
    name = F.substring_index(path, "/", -1)
    if not body:
        return F.lit(False)
    if body.endswith("/"):
        return (path == body[:-1]) | path.startswith(body)
    if re.search(r"[*?]", body):
        rx = glob_regex(body)
        return path.rlike(rx) | name.rlike(rx)
    return (path == body) | path.startswith(body + "/") | (name == body)


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether the rules leave a path out. Rules are few, so they fold into one expression."""
    out = F.lit(False)
    for raw in rules:
        negated = raw.startswith("!")
        out = F.when(matches(path, raw[1:] if negated else raw), F.lit(not negated)).otherwise(out)
    return out


def ignored_by(path: Column, git: list[str], own: list[str]) -> Column:
    """The file whose rules leave a path out, or null."""
    return F.when(ignored(path, git), ".gitignore").when(ignored(path, own), ".quarryignore")


def rule_table(df: DataFrame, text_col: str = "content") -> DataFrame:
    """(ord, rule) of ignore files read as rows of text."""
    lines = df.select(F.posexplode(F.split(text_col, r"\r?\n")).alias("ord", "rule"))
    return lines.withColumn("rule", F.trim("rule")).filter("rule <> '' and not startswith(rule, '#')")
