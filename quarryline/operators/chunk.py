"""Texts to line chunks. Fixed windows are pure column expressions; Markdown and code need a pass over the lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import lines_of

SIZE, OVERLAP = 80, 10
STRUCTURED = set("py python jsx tsx javascript typescript".split())


def fixed(df: DataFrame, text: Column, size: int = SIZE, overlap: int = OVERLAP, kind: str = "text") -> DataFrame:
    """A row per window of ``size`` lines, the next one starting ``size - overlap`` later, until one reaches the end."""
    step = size - overlap
    ls = lines_of(text)
    rows = df.withColumn("_lines", ls).withColumn("_n", F.size("_lines"))
    last = F.when(F.col("_n") <= size, 0).otherwise(F.ceil((F.col("_n") - size) / step).cast("int"))
    rows = rows.withColumn("ordinal", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("ordinal") * step
    return rows.select(
        *df.columns, "ordinal", (start + 1).alias("start_line"), F.least(start + size, F.col("_n")).alias("end_line"), F.lit(kind).alias("kind"),
        F.array_join(F.slice("_lines", start + 1, F.lit(size)), "\n").alias("chunk"),
    )


def reconstruct(chunks: DataFrame, key: list[str]) -> DataFrame:
    """Texts from overlapping chunks: of the chunks with a line the first one gives it; lines no chunk has are empty."""
    ls = chunks.select(*key, "ordinal", "start_line", "end_line", F.posexplode(F.split("chunk", r"\r?\n", -1)).alias("i", "line"))
    ls = ls.withColumn("no", F.col("start_line") + F.col("i")).filter("no <= end_line")
    first = ls.groupBy(*key, "no").agg(F.min(F.struct("ordinal", "line")).alias("x"))
    whole = first.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("no", F.col("x.line").alias("line")))).alias("m"), F.max("no").alias("n"))
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.coalesce(F.col("m")[i], F.lit(""))), "\n")
    return whole.select(*key, text.alias("text"))


def _windows(lines: list[str], start: int, kind: str = "text") -> Iterator[tuple[int, int, str, str]]:
    at = 0
    while True:
        end = min(len(lines), at + SIZE)
        yield start + at + 1, start + end, kind, "\n".join(lines[at:end])
        if end == len(lines):
            return
        at += SIZE - OVERLAP


_FENCE = re.compile(r"\s{0,3}(~{3,}|`{3,})")


def markdown(lines: list[str]) -> Iterator[tuple[int, int, str, str]]:
    """Sections from heading to heading (levels 1 to 3, outside fences), none shorter than nine lines."""
    start, fence = 0, ""
    for i, line in enumerate(lines):
        m = _FENCE.match(line)
        if fence:
            if m and not line[m.end() :].strip() and m[1][0] == fence[0] and len(m[1]) >= len(fence):
                fence = ""
        elif m:
            fence = m[1]
        elif i - start > 8 and re.match(r"#{1,3}\s+", line):
            yield start + 1, i, "markdown", "\n".join(lines[start:i])
            start = i
    yield start + 1, len(lines), "markdown", "\n".join(lines[start:])


_NAME = r"[A-Za-z_$][\w$]*"
_OPEN = r"\s*(?:export\s+)?"
_GENERIC = rf"(?:\s+{_NAME})?(?:<.*>)?"
_ARGS = rf"(?:{_NAME}|\([^)]*\))\s*=>"
_JS_CLASS = re.compile(_OPEN + r"(?:default\s+)?" + r"(?:abstract\s+)?" + "class" + _GENERIC + r"\b")
_JS_FUNCTION = re.compile(_OPEN + r"(?:default\s+)?" + r"(?:async\s+)?" + "function" + _GENERIC + r"\s*\(")
_JS_DEFAULT = re.compile(r"\s*export\s+default\s+" + r"(?:async\s*)?" + _ARGS)
_JS_CONST = re.compile(_OPEN + r"const\s+" + _NAME)
_ARROW = re.compile(r"(?:async\s*)?" + r"(?:<.*>\s*)?" + _ARGS)


def declares(line: str, python: bool) -> str | None:
    """``class`` or ``function`` if a declaration starts on the line."""
    if python:
        m = re.match(r"\s*(?:(class)|(?:async\s+)?def)\s+[A-Za-z_]\w*", line)
        return None if not m else "class" if m[1] else "function"
    if _JS_CLASS.match(line):
        return "class"
    if _JS_FUNCTION.match(line) or _JS_DEFAULT.match(line):
        return "function"
    if m := _JS_CONST.match(line):
        rest = line[m.end() :]
        eq = re.search(r"=(?!>)", rest)
        if eq and _ARROW.match(rest[eq.end() :].strip()):
            return "function"
    return None


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def indented_end(lines: list[str], start: int) -> int:
    """Last line with text before one that is indented no deeper than the first."""
    base, last = _indent(lines[start]), start
    for i in range(start + 1, len(lines)):
        if lines[i].strip():
            if _indent(lines[i]) <= base:
                break
            last = i
    return last


class Braces:
    """Counts braces outside strings, comments and regular expressions, line by line."""

    def __init__(self) -> None:
        self.comment, self.quote = False, ""

    def line(self, s: str) -> tuple[int, bool]:
        depth, opened, i = 0, False, 0
        while i < len(s):
            c, two = s[i], s[i : i + 2]
            if self.comment:
                if two == "*/":
                    self.comment, i = False, i + 1
            elif self.quote:
                if c == "\\":
                    i += 1
                elif c == self.quote:
                    self.quote = ""
            elif two == "//":
                break
            elif two == "/*":
                self.comment, i = True, i + 1
            elif c == "/" and self._regex(s[:i].rstrip()):
                i = self._regex_end(s, i)
            elif c in "'\"`":
                self.quote = c
            elif c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
            i += 1
        if self.quote != "`":
            self.quote = ""
        return depth, opened

    @staticmethod
    def _regex(before: str) -> bool:
        return not before or bool(re.search(r"\b(?:yield|throw|return)$|=>$", before)) or before[-1] in "&|,;:?!{[(="

    @staticmethod
    def _regex_end(s: str, at: int) -> int:
        i, group = at + 1, False
        while i < len(s):
            if s[i] == "\\":
                i += 1
            elif s[i] == "[":
                group = True
            elif s[i] == "]":
                group = False
            elif s[i] == "/" and not group:
                return i
            i += 1
        return at


_BODY = re.compile(r"\)\s*(?::.*)?\{|=>\s*\{|\b(?:enum|interface|class)\b.*\{")


def brace_end(lines: list[str], start: int) -> int:
    """Last line of the block that starts at a declaration."""
    braces, depth, body = Braces(), 0, False
    for i in range(start, len(lines)):
        d, opened = braces.line(lines[i])
        depth += d
        if i == start and not opened and "=>" in lines[i]:
            return indented_end(lines, i) if re.search(r"=>\s*$", lines[i]) else i
        body = body or (opened and bool(_BODY.search(lines[i])))
        if body and depth <= 0:
            return i
    return start


def structured(lines: list[str], python: bool) -> Iterator[tuple[int, int, str, str]]:
    """Declarations as chunks of their own, what lies between in fixed windows."""
    done = i = 0
    while i < len(lines):
        kind = declares(lines[i], python)
        if kind:
            if i > done:
                yield from _windows(lines[done:i], done)
            end = indented_end(lines, i) if python else brace_end(lines, i)
            yield i + 1, end + 1, kind, "\n".join(lines[i : end + 1])
            done, i = end + 1, end
        i += 1
    if done < len(lines):
        yield from _windows(lines[done:], done)


def chunks_of(text: str | None, language: str | None) -> list[tuple[int, int, str, str]]:
    lines = re.split(r"\r?\n", text or "")
    if language == "markdown":
        return list(markdown(lines))
    if language in STRUCTURED:
        return list(structured(lines, language in ("py", "python")))
    return list(_windows(lines, 0))


def chunk(df: DataFrame, key: list[str], text_col: str = "text", language_col: str = "language") -> DataFrame:
    """(key, ordinal, start_line, end_line, kind, chunk) of every text, by its language. A text is one row of a task."""
    kinds = dict(df.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(*k, n, *c) for *k, t, lang in f[[*key, text_col, language_col]].itertuples(index=False) for n, c in enumerate(chunks_of(t, lang))]
            yield pd.DataFrame(rows, columns=[*key, "ordinal", "start_line", "end_line", "kind", "chunk"])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), "ordinal int, start_line int, end_line int, kind string, chunk string"])
    return df.mapInPandas(run, schema)
