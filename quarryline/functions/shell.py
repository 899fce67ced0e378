"""Whether a shell command is a broad search through files (grep, rg, find) that an index would answer better."""

from __future__ import annotations

import re
import shlex

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

_RG_VALUE = set("-A -B -C -e -f -g -m -t -T".split()) | {"--" + x for x in (
    "type-clear type-add type sortr sort replace regexp pre path-separator max-depth max-count iglob glob field-match-separator field-context-separator engine context-separator context before-context after-context"
).split()}
_GREP_VALUE = set("-A -B -C -D -d -e -f -m".split()) | {"--" + x for x in "regexp max-count label include file exclude-from exclude-dir exclude directories context binary-files before-context after-context".split()}
_PLAIN = set("TODO README NOTICE Makefile LICENSE Dockerfile CHANGELOG AGENTS".split())


def segments(command: str) -> list[tuple[str, bool]]:
    """Commands between separators outside quotes, and whether each reads from a pipe."""
    out, piped, last = [], False, 0
    quote = ""
    i = 0
    while i <= len(command):
        c = command[i : i + 1]
        two = command[i : i + 2]
        sep = "" if quote else "&&" if two == "&&" else "||" if two == "||" else c if c and c in ";\n|" else ""
        if i == len(command) or sep:
            if command[last:i].strip():
                out.append((command[last:i].strip(), piped))
            piped, last = sep == "|", i + max(1, len(sep))
            i = last
            continue
        if c == "\\":
            i += 1
        elif quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        i += 1
    return out


def words(segment: str) -> list[str]:
    try:
        return [w for w in shlex.split(segment) if w]
    except ValueError:
        return segment.replace("'", " ").replace('"', " ").split()


def unwrap(tokens: list[str]) -> list[str]:
    """Without assignments and commands that only start another one."""
    assign = re.compile(r"[A-Za-z_]\w*=")
    i = 0
    while i < len(tokens):
        t = tokens[i]
        if assign.match(t) or t in ("noglob", "builtin", "command"):
            i += 1
        elif t in ("env", "sudo"):
            i += 1
            while i < len(tokens) and (tokens[i].startswith("-") or (t == "env" and assign.match(tokens[i]))):
                i += 1
        else:
            break
    return tokens[i:]


def concrete(path: str) -> bool:
    """Whether a path looks like one file."""
    if not path or path in (".", "..") or path.endswith("/") or re.search(r"[*?\[\]{}]", path):
        return False
    name = [p for p in path.replace("\\", "/").split("/") if p][-1:] or [path]
    return name[0] in _PLAIN or bool(re.search(r"\.[A-Za-z0-9][\w-]*$", name[0]))


def _operands(args: list[str], values: set[str], short: str) -> tuple[list[str], set[str]]:
    found, flags, i, plain, pattern = [], set(), 0, False, False
    while i < len(args):
        a = args[i]
        if a == "--":
            plain = True
        elif not plain and a.startswith("-"):
            name = a.split("=", 1)[0] if a.startswith("--") else (re.match(r"-[A-Za-z]", a) or [a])[0]
            flags.add(name)
            pattern = pattern or name in ("-e", "--regexp")
            if (name in values or re.fullmatch(f"-[{short}]", name)) and not (re.match(f"-[{short}].", a) or "=" in a):
                i += 1
        elif not pattern and "--files" not in flags:
            pattern = True
        else:
            found.append(a)
        i += 1
    return found, flags


def broad(command: str | None) -> bool:
    for seg, _ in segments(command or ""):
        t = unwrap(words(seg))
        if not t:
            continue
        name, args = ([p for p in t[0].split("/") if p] or [t[0]])[-1], t[1:]
        recursive = False
        if name == "git" and "grep" in args:
            name, args, recursive = "grep", args[args.index("grep") + 1 :], True
        if name == "rg":
            files, _ = _operands(args, _RG_VALUE, "ABCefgmtT")
            if not files or not all(map(concrete, files)):
                return True
        elif name == "grep":
            files, flags = _operands(args, _GREP_VALUE, "ABCDefm")
            recursive = recursive or bool(flags & {"-r", "-R", "--recursive"})
            if (recursive and not files) or not all(map(concrete, files)):
                return True
        elif name == "find" and not {"-okdir", "-ok", "-execdir", "-exec", "-delete"} & set(args):
            roots = []
            for a in args:
                if a in ("(", ")", "!") or a.startswith("-"):
                    break
                roots.append(a)
            if not all(map(concrete, roots or ["."])):
                return True
    return False


@F.pandas_udf(BooleanType())
def is_broad_search(commands: pd.Series) -> pd.Series:
    return commands.map(broad)
