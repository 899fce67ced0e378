"""Quality rules as weak supervision, in DataFrame functions alone.

Every rule votes for quality (1), against it (-1) or abstains (0). Votes depend on the text alone. The numbers of
documents by vote pattern (at most 3^rules rows, partial counts before the shuffle) are all that
expectation-maximisation needs: it estimates each rule's accuracies and the share of good documents under
conditional independence, and a document is kept if its posterior probability of quality is at least ``KEEP``.
The iterations run inside one SQL expression over the collected patterns, on one executor row. No estimate is held
within bounds: a prior worth ten documents (``PRIOR_SHARE``, ``PRIOR_ON_GOOD``, ``PRIOR_ON_BAD``: right and wrong ones)
keeps them off 0 and 1 where nothing was seen. Which of the two classes is the good one is decided afterwards: the one
on which the rules say yes more often.

Words are runs of characters other than blank and U+0009 to U+000D. Null and empty texts have no words and fail
the base rules. Repeated rows get equal verdicts; an empty table gives no rows; a null id stays null; other
columns are not read. If there are no votes at all, the start values decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import materialize

WS = r"[\x20\x09-\x0D]"
KEEP = 0.5
ITERATIONS = 40
#: Where the estimation starts: the share of good documents, every rule's accuracy on them and on the others.
START_GOOD, START_ON_GOOD, START_ON_BAD = 0.85, 0.98, 0.4
PRIOR_SHARE, PRIOR_ON_GOOD, PRIOR_ON_BAD = (8, 2), (9.5, 0.5), (4, 6)
#: Words beyond which a text needs no further different ones.
VARIED = 2000
RULES = ["length", "word_length", "symbols", "dup_lines", "repeats", "distinct", "stops", "capitals"]


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", others: list[str] | None = None) -> DataFrame:
    """doc_id, the columns ``others`` and the measures of each text, row by row, without a shuffle."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split("text", WS + "+"), lambda w: w != "")
    others = others or []
    a = df.select(F.col(id_col).cast("long").alias("doc_id"), t.alias("text"), *others).withColumn("words", words)
    a = a.withColumn("n_words", F.size("words").cast("long"))
    # Hashes of all windows of three words, with their places; sorting brings equal ones together.
    h = F.transform("words", lambda w: F.xxhash64(w))
    a = a.withColumn("h", h)
    tri = F.when(F.col("n_words") >= 3, F.expr("transform(sequence(1, cast(n_words as int) - 2), i -> xxhash64(h[i-1], h[i], h[i+1]))")).otherwise(F.array().cast("array<bigint>"))
    a = a.withColumn("tri", tri)
    a = a.withColumn("uniq", F.size(F.array_distinct("tri")))
    sorted_ = F.expr("array_sort(transform(tri, (x, i) -> named_struct('x', x, 'i', i)))")
    a = a.withColumn("s", F.when(F.col("uniq") < F.size("tri"), sorted_))
    # Only texts with a repeated window need the places: those next to an equal one, each covering three words.
    hit = F.expr("filter(transform(s, (v, j) -> if((j > 0 and s[j-1].x = v.x) or (j < size(s) - 1 and s[j+1].x = v.x), v.i, -1)), p -> p >= 0)")
    covered = F.size(F.array_distinct(F.flatten(F.transform(hit, lambda p: F.array(p, p + 1, p + 2)))))
    a = a.withColumn("n_repeat_words", F.when(F.col("s").isNull(), F.lit(0)).otherwise(covered).cast("long"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = a.withColumn("lines", lines)
    spaces = F.translate("text", " \t\n\x0b\x0c\r", "")
    symbols = F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))
    upper = F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}", ""))
    letters = F.length("text") - F.length(F.regexp_replace("text", r"\p{L}+", ""))
    return a.select(
        "doc_id", "n_words", F.length(spaces).cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        F.size("lines").alias("n_lines"), upper.alias("n_upper"), letters.alias("n_letters"),
        F.size(F.array_distinct("h")).alias("n_distinct"),
        F.size(F.filter("words", lambda w: (F.length(w) <= 3) & (F.lower(w) != F.upper(w)))).alias("n_short"), *others,
    )


def vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def votes(m: DataFrame) -> DataFrame:
    """The measures with a vote per rule; ratios are integer comparisons, so that every engine agrees."""
    c = F.col
    w = c("n_words")
    return m.select(
        "*",
        vote(w >= 60, w < 50).alias("v_length"),
        vote((c("word_chars") >= 3 * w) & (c("word_chars") <= 9 * w), (c("word_chars") < 2 * w) | (c("word_chars") > 12 * w)).alias("v_word_length"),
        vote(20 * c("n_symbols") <= w, 4 * c("n_symbols") > w).alias("v_symbols"),
        vote(10 * c("n_dup_lines") <= c("n_lines"), 3 * c("n_dup_lines") > c("n_lines")).alias("v_dup_lines"),
        vote(10 * c("n_repeat_words") <= w, 3 * c("n_repeat_words") > w).alias("v_repeats"),
        vote(5 * c("n_distinct") >= F.least(w, F.lit(VARIED)), 8 * c("n_distinct") < F.least(w, F.lit(VARIED))).alias("v_distinct"),
        vote(20 * c("n_short") >= 3 * w, 100 * c("n_short") < 5 * w).alias("v_stops"),
        vote(5 * c("n_upper") <= c("n_letters"), 2 * c("n_upper") > c("n_letters")).alias("v_capitals"),
    )


def estimate(v: DataFrame, iterations: int = ITERATIONS) -> list[float]:
    """[share of good documents, per rule its accuracy on good ones, per rule its accuracy on bad ones], from the counts of vote patterns.

    An accuracy is the share of right votes among those cast on documents of the class.
    """
    names = [f"v_{r}" for r in RULES]
    m = len(names)
    patterns = v.groupBy(F.array(*names).alias("p")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    one = patterns.agg(F.array_sort(F.collect_list(F.struct("p", "n"))).alias("s"))  # at most 3^rules entries
    fold = f"aggregate(sequence(1, {m}), cast({{}} as double), (a, j) -> a * case t.p[j-1] when 1 then {{}} when -1 then {{}} else 1.0D end)"
    g1, g0 = fold.format("x[0]", "x[j]", "1 - x[j]"), fold.format("1 - x[0]", f"1 - x[j+{m}]", f"x[j+{m}]")
    post = f"transform(s, t -> named_struct('p', t.p, 'n', t.n, 'g', ({g1}) / ({g1} + {g0})))"
    total = lambda of: f"aggregate(q, 0.0D, (a, t) -> a + {of})"
    mean = lambda right, all_, prior: f"({total(right)} + {prior[0]}D) / ({total(all_)} + {sum(prior)}D)"
    share = mean("t.n * t.g", "t.n", PRIOR_SHARE)
    on_good = mean("if(t.p[j-1] = 1, t.n * t.g, 0.0D)", "if(t.p[j-1] <> 0, t.n * t.g, 0.0D)", PRIOR_ON_GOOD)
    on_bad = mean("if(t.p[j-1] = -1, t.n * (1 - t.g), 0.0D)", "if(t.p[j-1] <> 0, t.n * (1 - t.g), 0.0D)", PRIOR_ON_BAD)
    good_part, bad_part = (f"transform(sequence(1, {m}), j -> {x})" for x in (on_good, on_bad))
    step = f"transform(array({post}), q -> concat(array({share}), {good_part}, {bad_part}))[0]"
    start = "array(" + ", ".join([f"{START_GOOD}D", *[f"{START_ON_GOOD}D"] * m, *[f"{START_ON_BAD}D"] * m]) + ")"
    row = one.select(F.expr(f"aggregate(sequence(1, {iterations}), {start}, (x, it) -> {step})").alias("x")).first()
    return ordered(list(row.x))


def ordered(x: list[float]) -> list[float]:
    """The estimate with its classes named by what the rules say of them, which the likelihood leaves open."""
    m = len(RULES)
    good, bad = x[1 : 1 + m], x[1 + m :]
    if sum(good) >= sum(1 - b for b in bad):
        return x
    return [1 - x[0], *(1 - b for b in bad), *(1 - g for g in good)]


def posterior(x: list[float]) -> Column:
    """Probability of quality of a row with votes."""
    good, bad, m = F.lit(x[0]), F.lit(1 - x[0]), len(RULES)
    for j, r in enumerate(RULES):
        v = F.col(f"v_{r}")
        good = good * F.when(v == 1, x[1 + j]).when(v == -1, 1 - x[1 + j]).otherwise(1.0)
        bad = bad * F.when(v == 1, 1 - x[1 + m + j]).when(v == -1, x[1 + m + j]).otherwise(1.0)
    return good / (good + bad)


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", others: list[str] | None = None) -> DataFrame:
    """One row per document: the measures, the columns ``others``, base_failed, the votes, p_quality and kept.

    Measures and votes (some 60 bytes a document) are written once, so that texts are read in one pass.
    """
    v = materialize(votes(measured(df, id_col, text_col, others)), "measures")
    x = estimate(v)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return v.withColumn("base_failed", failed).withColumn("p_quality", posterior(x)).withColumn("kept", ~failed & (F.col("p_quality") >= KEEP))
