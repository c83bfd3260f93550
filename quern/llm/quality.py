"""Operator 8, quality rules as a short-circuit cascade.

Each rule is a column expression. Its cost and the share of rows it rejects
are measured on a sample of stated size; the rules are then asked in the order
of rejections per cost, in one CASE, so that a rejected text costs no further
rule. The order changes the cost only, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import staged

#: Rows that costs and selectivities are measured on; results do not depend on it.
SAMPLE_ROWS = 2000
WINDOW = 5
SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"


def split_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.array_remove(F.split(text, SPACE_RUN), "")


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]")))
    return _with(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """Use a value several times and work it out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeat_words(words: Column) -> Column:
    """Words inside five-word windows that occur twice or more."""

    def covered(keys: Column) -> Column:
        ranked = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        return _with(ranked, positions)

    def positions(ranked: Column) -> Column:
        def tied(x: Column, i: Column) -> Column:
            return F.when(
                (F.get(ranked, i - 1)["k"] == x["k"]) | (F.get(ranked, i + 1)["k"] == x["k"]), x["i"]
            )

        return _with(F.sort_array(F.array_compact(F.transform(ranked, tied))), spread)

    def spread(at: Column) -> Column:
        reach = F.transform(
            at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)))
        )
        return F.aggregate(reach, F.lit(0), lambda a, b: a + b)

    def windows(hashes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(hashes) - WINDOW),
            lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]),
        )

    keys = _with(F.transform(words, lambda w: F.xxhash64(w)), windows)
    counted = _with(
        keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(covered(k))
    )
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(counted)


def echoes(words: Column) -> Column:
    """Words equal to the word before them."""
    return _with(words, lambda x: F.size(F.filter(x, lambda w, i: F.coalesce(F.get(x, i - 1) == w, F.lit(False)))))


#: What rules may ask of a text; ``words`` and ``n_words`` are there for all of them.
METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "word_chars": lambda text, words: F.char_length(F.array_join(words, "")),
    "n_symbols": lambda text, words: F.regexp_count(text, F.lit(SYMBOL)),
    "n_dup_lines": lambda text, words: dup_lines(text),
    "n_repeat_words": lambda text, words: repeat_words(words),
    "n_echoes": lambda text, words: echoes(words),
    "n_upper": lambda text, words: F.regexp_count(text, F.lit(r"\p{Lu}")),
    "n_digits": lambda text, words: F.regexp_count(text, F.lit("[0-9]")),
    "n_lines": lambda text, words: F.size(F.split(text, "\n")),
}


@dataclass(frozen=True)
class Rule:
    """A text fails where ``fails`` holds for its metrics."""

    name: str
    needs: tuple[str, ...]
    fails: Callable[[dict[str, Column]], Column]
    base: bool = False


RULES = (
    Rule("few_words", (), lambda m: m["n_words"] < 10, base=True),
    Rule("repetition", ("n_repeat_words",), lambda m: m["n_repeat_words"] * 100 > m["n_words"] * 20, base=True),
    Rule("symbols", ("n_symbols",), lambda m: m["n_symbols"] * 10 > m["n_words"]),
    Rule("word_length", ("word_chars",), lambda m: (m["word_chars"] < m["n_words"] * 2) | (m["word_chars"] > m["n_words"] * 15)),
    Rule("upper_case", ("n_upper", "word_chars"), lambda m: m["n_upper"] * 10 > m["word_chars"] * 4),
    Rule("echoes", ("n_echoes",), lambda m: m["n_echoes"] * 10 > m["n_words"] * 3),
    Rule("digits", ("n_digits", "word_chars"), lambda m: m["n_digits"] * 10 > m["word_chars"] * 7),
    Rule("dup_lines", ("n_dup_lines", "n_lines"), lambda m: m["n_dup_lines"] * 10 > m["n_lines"] * 5),
)


def _prepared(docs: DataFrame, text_col: str, keep: Sequence[Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(*keep, text.alias("__text")).withColumn("__words", split_words(F.col("__text")))


def _metrics(names: Sequence[str]) -> dict[str, Column]:
    text, words = F.col("__text"), F.col("__words")
    return {"n_words": F.size(words)} | {n: METRICS[n](text, words) for n in names}


def cascade_order(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejection per cost, both measured on up to ``rows`` rows; an empty table keeps the given order."""
    sample = staged(docs.select(F.col(text_col).alias("__t")).limit(rows), "quality-sample")
    ready = _prepared(sample, "__t", [])

    def timed(condition: Column) -> tuple[float, float]:
        began = time.perf_counter()
        share = ready.agg(F.avg(condition.cast("int"))).first()[0] or 0.0
        return time.perf_counter() - began, share

    timed(F.size("__words") < 0)  # the first job also compiles
    idle, _ = timed(F.size("__words") < 0)
    ranked = []
    for place, rule in enumerate(rules):
        cost, rejected = timed(rule.fails(_metrics(rule.needs)))
        ranked.append((-rejected / max(cost - idle, 1e-3), place, rule))
    return [rule for *_, rule in sorted(ranked, key=lambda r: r[:2])]


def first_failure(rules: Sequence[Rule], metrics: Callable[[Rule], dict[str, Column]]) -> Column:
    """The name of the first rule that fails, null if none does; later rules are not worked out."""
    return F.coalesce(*[F.when(rule.fails(metrics(rule)), F.lit(rule.name)) for rule in rules])


def quality_metrics(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ``keep`` columns, counts of every text, base_failed and kept.

    A null text has no words and fails. Empty texts fail ``few_words``. Rows
    are judged one by one, so repeated rows and ids do not matter; an empty
    table gives no rows, and columns outside ``keep`` are ignored.
    """
    shown = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    ordered = cascade_order(docs, [r for r in rules if not r.base], text_col)
    ready = _prepared(docs, text_col, [F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)])
    counts = _metrics(shown)
    counted = ready.select("*", *[c.cast("long").alias(f"__{n}") for n, c in counts.items()])
    given = {n: F.col(f"__{n}") for n in counts}
    base = [r for r in rules if r.base]
    lazily = lambda rule: {**_metrics([n for n in rule.needs if n not in given]), **given}
    failed = first_failure(base, lazily).isNotNull()
    verdict = F.when(failed, F.lit(False)).otherwise(first_failure(ordered, lazily).isNull())
    return counted.select(
        *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)],
        *[given[n].alias(n) for n in ("n_words", *shown)],
        failed.alias("base_failed"),
        verdict.alias("kept"),
    )


def keep_good(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Rows that no rule rejects, with all their columns; nulls and empty texts go."""
    ordered = cascade_order(docs, rules, text_col)
    columns = docs.columns
    ready = _prepared(docs, text_col, [F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(columns)])
    kept = ready.filter(first_failure(ordered, lambda rule: _metrics(rule.needs)).isNull())
    return kept.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(columns)])


def oracle() -> str:
    """DuckDB SQL for :func:`quality_metrics` of ``documents`` under ``RULES``."""
    word = r"[^\x20\x09-\x0D]"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{word}+') AS ws FROM d),
windows AS (SELECT r, i, ws[i:i + 4] AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
inside AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, i + unnest([0, 1, 2, 3, 4]) AS p FROM twice) GROUP BY r),
dups AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d)
         WHERE regexp_matches(l, '{word}') GROUP BY r),
echo AS (SELECT r, count(*) FILTER (ws[i] = ws[i - 1]) AS n FROM (SELECT r, ws, unnest(range(2, len(ws) + 1)) AS i FROM w) GROUP BY r),
m AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines,
         coalesce(inside.n, 0) AS n_repeat_words, coalesce(echo.n, 0) AS n_echoes, len(string_split(text, chr(10))) AS n_lines,
         len(regexp_extract_all(text, '\p{{Lu}}')) AS n_upper, len(regexp_extract_all(text, '[0-9]')) AS n_digits
  FROM w LEFT JOIN inside USING (r) LEFT JOIN dups USING (r) LEFT JOIN echo USING (r)
),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 10 > n_words OR word_chars < n_words * 2 OR word_chars > n_words * 15
            OR n_upper * 10 > word_chars * 4 OR n_echoes * 10 > n_words * 3 OR n_digits * 10 > word_chars * 7
            OR n_dup_lines * 10 > n_lines * 5) AS kept
FROM judged
"""
