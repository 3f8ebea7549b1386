"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.tables import BLANK_CHARS, BLANKS

WINDOW = 8

# Frequent function words of the four languages.
STOP_WORDS = (
    "the be to of and that have with is in it for as on was are at by this from or an "
    "le la les de des du et en un une que qui dans pour sur est au "
    "der die das und ist von den mit für ein eine zu nicht auf im "
    "el los las del y una por con para su es se no lo"
).split()


@dataclass(frozen=True)
class Rule:
    """A text fails when ``measure`` lies outside ``least`` .. ``most``; None leaves that side open."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


# The measures are columns of ``measured``. Short clean texts must pass, so the ratios are lenient.
RULES = (
    Rule("too_short", "n_words", least=20),
    Rule("mean_word_length", "mean_word_chars", least=2, most=15),
    Rule("symbols", "symbol_ratio", most=0.1),
    Rule("repeated_words", "repeat_ratio", most=0.3),
    Rule("repeated_lines", "dup_line_ratio", most=0.3),
    Rule("stop_words", "stop_ratio", least=0.02),
    Rule("bulleted_lines", "bullet_ratio", most=0.9),
    Rule("ellipsis_lines", "ellipsis_ratio", most=0.3),
)


def _ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the measures of every text.

    ``n_repeat_words`` is found inside the row: window hashes are sorted beside their places, equal neighbours are
    windows that occur twice or more, and the places covered by them are summed over sorted starts. That takes
    n log n steps for n words and no shuffle.
    """
    blank = F.lit(BLANK_CHARS)
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    split = base.select(
        "_id", "_text",
        F.filter(F.split("_text", BLANKS + "+"), lambda w: w != "").alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, blank) != "").alias("_lines"),
    )
    n = F.size("_words")
    hashed = split.withColumn("_windows", F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)),
    )))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = hashed.withColumn("_sorted", F.when(repeats, F.array_sort(F.transform(
        "_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")),
    ))))
    again = placed.withColumn("_starts", F.when(F.col("_sorted").isNotNull(), F.sort_array(F.transform(F.filter(
        F.transform("_sorted", lambda x, k: F.struct(
            x.i.alias("i"),
            (x.h.eqNullSafe(F.get("_sorted", k - 1).h) | x.h.eqNullSafe(F.get("_sorted", k + 1).h)).alias("again"),
        )), lambda x: x.again), lambda x: x.i))))
    covered = F.aggregate(
        F.transform("_starts", lambda s, k: F.least(F.coalesce(F.get("_starts", k + 1) - s, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0).cast("bigint"), lambda total, x: total + x,
    )
    stop = F.array(*map(F.lit, STOP_WORDS))
    counted = again.select(
        "_id",
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("bigint")).alias("n_repeat_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        # Function words that occur at all, against the distinct words that a short text could hold.
        F.size(F.array_intersect(F.transform("_words", lambda w: F.lower(F.rtrim(w, F.lit(".,!?;:")))), stop)).alias("n_stop"),
        F.size(F.filter("_lines", lambda x: F.btrim(x, blank).rlike(r"^[-*\u2022]"))).alias("_bullets"),
        F.size(F.filter("_lines", lambda x: F.btrim(x, blank).rlike(r"(?:\.\.\.|\u2026)$"))).alias("_ellipses"),
    )
    return counted.select(
        "*", _ratio("word_chars", "n_words").alias("mean_word_chars"), _ratio("n_symbols", "word_chars").alias("symbol_ratio"),
        _ratio("n_repeat_words", "n_words").alias("repeat_ratio"), _ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        F.when(F.col("n_words") > 0, F.col("n_stop") / F.least(F.col("n_words"), F.lit(50))).otherwise(F.lit(0.0)).alias("stop_ratio"),
        _ratio("_bullets", "n_lines").alias("bullet_ratio"), _ratio("_ellipses", "n_lines").alias("ellipsis_ratio"),
    ).drop("_bullets", "_ellipses")


def failed_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table of thresholds as one expression: the names of the rules that a text fails."""
    broken = []
    for rule in rules:
        value, wrong = F.col(rule.measure), F.lit(False)
        if rule.least is not None:
            wrong = wrong | (value < rule.least)
        if rule.most is not None:
            wrong = wrong | (value > rule.most)
        broken.append(F.when(wrong, F.lit(rule.name)))
    return F.array_compact(F.array(*broken))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """Measures, ``base_failed``, the failed rules and ``kept`` for every row of ``docs``.

    Null and blank texts have no words and fail the base rule. Ids may be null or repeated; each row is judged by
    itself. Texts are read whole; other columns are ignored, so their names cannot clash. No rows give no rows.
    """
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measured(docs, id_col, text_col).select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_lines", "mean_word_chars", "symbol_ratio", "dup_line_ratio", "stop_ratio",
        base.alias("base_failed"), failed_rules(rules).alias("failed"),
    ).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
