"""Quality rules: a threshold table compiled into one projection.

Every measure and every verdict is a column expression; no user function runs.
The table of rules is data: ``compile_rules`` turns it into a single projection.

Defined results for odd rows: a null or empty text has zero words, all measures
zero, fails ``min_words`` and is not kept; repeated rows and ties each get their
own (equal) result; other columns of the input are ignored by
``quality_measures`` and returned untouched by ``keep_good``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import SPACE, let

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it as with be by on are this at or from not "
    "der die und das den von zu mit ist des sich im nicht ein eine auf für dem als auch "
    "le la les de et en un une du que qui est pour dans au par sur pas il "
    "el los las y del se con por una para su al lo como más o"
)

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``name`` fails where ``numerator / denominator`` leaves [low, high] and the
    text has at least ``min_words`` words.  Compared by cross-multiplication.  With
    ``langs`` only texts that their row says are in one of them can fail."""

    name: str
    numerator: str
    denominator: str | None = None
    low: float | None = None
    high: float | None = None
    min_words: int = 0
    langs: tuple[str, ...] = ()


#: Languages that the stop words cover; other and unknown ones are not judged by them.
STOP_WORD_LANGS = ("en", "de", "fr", "es")
BASE_RULES = (
    Rule("min_words", "n_words", low=10),
    Rule("repeated_windows", "n_repeat_words", "n_words", high=0.20),
)
METHOD_RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=2.0, high=12.0),
    Rule("symbols", "n_symbols", "word_chars", high=0.05),
    Rule("exclamations", "n_exclamations", "n_words", high=0.30),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02, min_words=40, langs=STOP_WORD_LANGS),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.50, min_words=10),
)


def repeat_words(words: Column) -> Column:
    """Words that lie in a 5-word window found twice or more in the text.

    Windows are compared by a 64-bit hash.  Where no hash repeats the answer is
    zero at once; otherwise hashes and positions are sorted together, repeated
    starts are kept and the lengths of the union of their windows are summed,
    so that the cost is n log n however often a window repeats.
    """

    def windows(h: Column) -> Column:
        n = F.size(h)
        at = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(F.slice(h, i, WINDOW)))

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        starts = let(
            placed,
            lambda z: F.sort_array(
                F.transform(
                    F.filter(z, lambda s, i: (F.get(z, i - 1)["h"] == s["h"]).eqNullSafe(True) | (F.get(z, i + 1)["h"] == s["h"]).eqNullSafe(True)),
                    lambda s: s["i"],
                )
            ),
        )
        widths = let(starts, lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(widths, F.lit(0).cast("long"), lambda a, x: a + x)

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return let(let(hashed, windows), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def measures(text: Column) -> Column:
    """Struct of the measures of a text."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    length = lambda c: F.length(c).cast("long")

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            length(F.concat_ws("", w)).alias("word_chars"),
            (length(text) - length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).alias("n_symbols"),
            (length(text) - length(F.replace(text, F.lit("!"), F.lit("")))).alias("n_exclamations"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("lines"),
            F.size(F.filter(F.split(F.lower(F.concat_ws(" ", w)), " "), lambda x: x.isin(*dict.fromkeys(STOP_WORDS.split())))).cast("long").alias("n_stop_words"),
            repeat_words(w).alias("n_repeat_words"),
        )

    return let(words, of_words)


def compile_rules(rules, at) -> dict[str, Column]:
    """A boolean column for each rule: true where the text breaks it."""
    out = {}
    for r in rules:
        value = at(r.numerator).cast("double")
        scale = at(r.denominator).cast("double") if r.denominator else F.lit(1.0)
        broken = F.lit(False)
        if r.low is not None:
            broken = broken | (value < r.low * scale)
        if r.high is not None:
            # in whole hundredths where the threshold is one, so that no rounding decides
            hundred = round(r.high * 100)
            exact = abs(hundred - r.high * 100) < 1e-9
            broken = broken | ((value * 100 > F.lit(float(hundred)) * scale) if exact else (value > r.high * scale))
        if r.langs:
            broken = broken & F.coalesce(F.lower(at("lang")).isin(*r.langs), F.lit(False))
        out[r.name] = broken & (at("n_words") >= r.min_words)
    return out


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_exclamations", "n_stop_words", "n_lines")


def quality_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE_RULES, method=METHOD_RULES, lang_col: str = "lang") -> DataFrame:
    """One row per document: ``id_col``, the measures, ``base_failed``, ``kept``
    and ``reasons`` (names of the broken rules)."""
    m = docs.select(F.col(id_col), measures(F.col(text_col)).alias("m"), _lang(docs, lang_col).alias("_lang"))
    at = lambda c: {"n_lines": F.col("m.lines.n"), "n_dup_lines": F.col("m.lines.d"), "lang": F.col("_lang")}.get(c, F.col(f"m.{c}"))
    b, r = compile_rules(base, at), compile_rules(method, at)
    any_of = lambda xs: F.array_contains(F.array(*xs), True) if xs else F.lit(False)
    failed = any_of([*b.values()])
    return m.select(
        id_col,
        *[at(c).alias(c) for c in COLUMNS],
        failed.alias("base_failed"),
        (~any_of([*b.values(), *r.values()])).alias("kept"),
        F.array_compact(F.array(*[F.when(x, F.lit(k)) for k, x in {**b, **r}.items()])).alias("reasons"),
    )


def _lang(docs: DataFrame, lang_col: str) -> Column:
    """The rows' language; null where the table has none."""
    return F.col(f"`{lang_col}`").cast("string") if lang_col in docs.columns else F.lit(None).cast("string")


def keep_good(docs: DataFrame, text_col: str = "text", base=BASE_RULES, method=METHOD_RULES, lang_col: str = "lang") -> DataFrame:
    """The documents that break no rule, with their own columns."""
    own = "_netloom_quality"
    m = docs.withColumn(own, measures(F.col(text_col)))
    at = lambda c: {"n_lines": F.col(f"{own}.lines.n"), "n_dup_lines": F.col(f"{own}.lines.d"), "lang": _lang(docs, lang_col)}.get(c, F.col(f"{own}.{c}"))
    broken = [*compile_rules((*base, *method), at).values()]
    return m.where(~F.array_contains(F.array(*broken), True)).select(*[F.col(f"`{c}`") for c in docs.columns])
