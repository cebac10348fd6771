"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Measures are array and string functions over one row, so no word is ever shuffled. The rules run as one
CASE in an order found on a bounded sample: what each rule would read of each sampled row, weighted with the time that its kind of
reading takes, is its cost there, and the rule with most rejections per cost among the rows that are left goes first. Costs are
counted, not timed, so the order does not depend on how busy the machine is. A row that one rule rejects costs no more.
The order changes the cost, never the verdict.

Where nothing but the verdict is asked for (:func:`keep_good`), the base rules are rules of the cascade like the others, and the
dear one, words in repeated windows, is only counted for rows that a bound on it does not decide.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torrentine.llm.common import id_text, words_of

SYMBOLS = r"[#*$%&|<>]"
#: Rows on which costs and rejections are estimated; they decide the order of rules alone.
SAMPLE_ROWS = 1000

Rules = dict[str, Callable[[], Column]]

#: A rule is true of what it rejects. Sizes are of whole texts that have passed the base rules.
RULES: Rules = {
    "symbols": lambda: F.col("n_symbols") * 10 > F.col("n_words"),
    "word_length": lambda: (F.col("word_chars") < 3 * F.col("n_words")) | (F.col("word_chars") > 10 * F.col("n_words")),
    "repeated_lines": lambda: F.col("n_dup_lines") * 2 > F.col("n_lines"),
    "shouting": lambda: F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")) * 2 > F.col("word_chars"),
    "exclamations": lambda: (F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit("")))) * 2 > F.col("n_words"),
    "no_letters": lambda: F.size(F.filter("words", lambda w: w.rlike(r"\p{L}"))) * 10 < 6 * F.col("n_words"),
}
BASE: Rules = {
    "few_words": lambda: F.col("n_words") < 50,
    "repeated_words": lambda: mostly_repeated(F.col("words"), F.size("words")),
}
#: Cost of a rule on a row, in nanoseconds about: one for a rule that compares measures which are there anyway.
WORK: Rules = {
    "shouting": lambda: F.length("text") * 6,
    "exclamations": lambda: F.length("text"),
    "no_letters": lambda: F.size("words") * 100,
    "repeated_words": lambda: F.size("words") * 400,
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _window_hashes(words: Column, n: Column, width: int) -> Column:
    return let(words, lambda w: F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])))


def _in_repeated_windows(words: Column, n: Column, width: int) -> Column:
    """The exact count: the windows are sorted with their places, so equal ones stand together, and the places covered are added up."""
    gram = lambda w, i: F.struct(F.concat_ws(" ", *[F.get(w, i + k) for k in range(width)]).alias("g"), i.alias("i"))
    grams = let(words, lambda w: F.sort_array(F.transform(F.sequence(F.lit(0), n - width), lambda i: gram(w, i))))

    def places(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k).getField("g") == x.getField("g"), F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x.getField("i")))

    def covered(p: Column) -> Column:
        step = lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(width)), F.lit(width))
        return F.aggregate(F.transform(p, step), F.lit(0), lambda a, x: a + x)

    return let(let(grams, places), covered)


def repeated_window_words(words: Column, n: Column, width: int = 3) -> Column:
    """Words that lie in a window of ``width`` words which comes twice or more in the array; hashes tell whether any can."""
    repeats = let(_window_hashes(words, n, width), lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(n < width, F.lit(0)).when(repeats, _in_repeated_windows(words, n, width)).otherwise(F.lit(0)).cast("long")


def mostly_repeated(words: Column, n: Column, width: int = 3) -> Column:
    """Whether more than half of the words lie in such windows.

    If d windows come again, at most 2d windows have an equal, which cover ``2 * width * d`` words at most; only where that is more than half
    are they counted.
    """
    again = let(_window_hashes(words, n, width), lambda h: F.size(h) - F.size(F.array_distinct(h)))
    return F.when(n < width, F.lit(False)).when(again * 4 * width <= n, F.lit(False)).otherwise(_in_repeated_windows(words, n, width) * 100 > n * 50)


def measure(docs: DataFrame, keep_row: bool = False) -> DataFrame:
    """doc_id, text, words and the measures of each whole text; a null text is empty. keep_row adds the input row as a struct."""
    rows = docs.select(*["doc_id", "text"], F.struct("*").alias("row")) if keep_row else id_text(docs)
    rows = rows.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = rows.withColumn("words", words_of(F.col("text"))).withColumn("n_words", F.size("words").cast("long"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("lines", lines)
    return rows.select(
        *["row"] * keep_row,
        "doc_id",
        "text",
        "words",
        "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("words"), F.size("words")).alias("n_repeat_words"),
    )


def order_rules(docs: DataFrame, rules: Rules, sample_rows: int = SAMPLE_ROWS, past: Column | None = None) -> list[str]:
    """Names of the rules, most rejections per cost first, on the first ``sample_rows`` rows that a take() finds.

    take() reads one partition and goes on only if it must, so the sample costs the same at any size; what comes to the driver is a
    verdict and a cost for each rule and row. Each rule is judged by the rows that those before it leave; rows of which ``past`` is true count
    for none. Ties go to the cheaper rule, then by name.
    """
    names = sorted(rules)
    verdicts = [F.coalesce(rules[x](), F.lit(False)).alias(f"r{i}") for i, x in enumerate(names)]
    costs = [(WORK[x]() if x in WORK else F.lit(1)).cast("double").alias(f"c{i}") for i, x in enumerate(names)]
    rows = measure(id_text(docs)).select((F.lit(False) if past is None else past).alias("past"), *verdicts, *costs).take(sample_rows)
    left, order, waiting = [r for r in rows if not r.past], [], list(range(len(names)))
    while waiting:

        def worth(i: int) -> tuple[float, float, str]:
            cost = sum(r[f"c{i}"] for r in left)
            return -sum(r[f"r{i}"] for r in left) / max(cost, 1.0), cost, names[i]

        best = min(waiting, key=worth)
        waiting.remove(best)
        order.append(names[best])
        left = [r for r in left if not r[f"r{best}"]]
    return order


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def cascade(rules: Rules, order: list[str]) -> Column:
    """False as soon as one rule rejects."""
    verdict = F.when(F.lit(False), F.lit(False))
    for name in order:
        verdict = verdict.when(F.coalesce(rules[name](), F.lit(False)), F.lit(False))
    return verdict.otherwise(F.lit(True))


def quality(docs: DataFrame, rules: Rules | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept: one row for each input row.

    A null or empty text has no words and fails the base rules (fewer than 50 words, or more than half
    of them in repeated windows). Null identifiers and repeated rows are kept as they are; an empty table
    gives no rows; columns other than doc_id and text are not read.
    """
    rules = RULES if rules is None else rules
    order = order_rules(docs, rules, sample_rows, base_failed()) if rules else []
    measured = measure(docs).withColumn("base_failed", base_failed())
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(rules, order))
    return measured.withColumn("kept", kept).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, rules: Rules | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that :func:`quality` keeps, all columns as they were, whatever their names.

    Rows with null or empty texts go; null identifiers and repeated rows are judged by their text like any other; an empty table stays empty.
    The verdict becomes rows by a generator, not by a filter, which would be moved below the measures and
    compute each of them once for every use.
    """
    rules = (RULES if rules is None else rules) | BASE
    kept = cascade(rules, order_rules(docs, rules, sample_rows))
    return measure(docs, keep_row=True).select("row", F.explode(F.when(kept, F.array(F.lit(1))))).select("row.*")
