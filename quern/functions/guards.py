"""Rules on SQL text: one set for columns of logged statements, the same for a single statement."""

from __future__ import annotations

import re

from pyspark.errors import ParseException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quern.functions import fixed
from quern.functions.columns import stripped

RULES: dict[str, tuple[str, ...]] = {
    "token": fixed.TOKEN_WORDS,
    "substring": fixed.SUBSTRING_WORDS,
    "strict": fixed.STRICT_WORDS,
    "injection": fixed.INJECTION_PATTERNS,
}
EMPTY = "empty"


def prepared(col: Column, rule: str) -> Column:
    """The text a rule looks at. Put it into a column of its own so that it is made once per row."""
    if rule == "token":
        return F.concat(F.lit(" "), F.upper(stripped(col)), F.lit(" "))
    return col if rule == "injection" else F.upper(col)


def _is_empty(col: Column, rule: str) -> Column:
    missing = col.isNull() | (col == "")
    if rule == "substring":
        return missing | (stripped(col) == "")
    return missing if rule == "token" else F.lit(False)


def first_hit(col: Column, rule: str, text: Column | None = None) -> Column:
    """The first word or pattern of the rule found in the text, ``empty`` for rejected blanks, else NULL."""
    text = prepared(col, rule) if text is None else text
    hits = [
        F.when(F.contains(text, F.lit(f" {word} " if rule == "token" else word)), F.lit(word)) for word in RULES[rule]
    ]
    return F.coalesce(F.when(_is_empty(col, rule), F.lit(EMPTY)), *hits)


def normalised(col: Column) -> Column:
    """Trimmed text with one closing semicolon; empty stays empty."""
    text = stripped(col)
    return F.when(col.isNull() | (col == ""), F.lit("")).when(F.endswith(text, F.lit(";")), text).otherwise(
        F.concat(text, F.lit(";"))
    )


def read_only_problem(sql: str | None) -> str | None:
    """Why a statement may not be run, or None.

    White space is collapsed first so that a line break cannot hide a word, and
    the statement has to be a query.
    """
    if not sql or not sql.strip():
        return EMPTY
    text = f" {' '.join(sql.split()).upper()} "
    for word in RULES["token"]:
        if f" {word} " in text:
            return word
    body = re.sub(r"^(\s|--[^\n]*(\n|$)|/\*.*?\*/|\()+", "", sql, flags=re.S)
    start = re.match(r"[A-Za-z]+", body)
    if not start or start.group(0).upper() not in ("SELECT", "WITH", "VALUES"):
        return "not a query"
    return None


# functions that call into the JVM, and relations that read files past the catalogue
_CALLS = re.compile(r"['.](?:(?:try_)?reflect|java_method)\(", re.I)
_FILES = re.compile(r"'UnresolvedRelation \[(?:parquet|json|csv|orc|text|avro|xml|binaryfile|delta)\s*,", re.I)
_SCRIPT = re.compile(r"ScriptTransformation", re.I)


def plan_problem(spark: SparkSession, sql: str) -> str | None:
    """What a statement's parsed plan shows that no query needs: shell scripts, JVM calls, direct file reads.

    The parser's own tree is searched, so comments, quoting and white space
    hide nothing. A statement that does not parse is left to Spark's error.
    """
    width = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(width)
    spark.conf.set(width, str(2**31 - 1))  # long lists are shown in full
    try:
        text = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).toString()
    except ParseException:
        return None
    finally:
        spark.conf.set(width, before)
    for pattern, problem in ((_SCRIPT, "script transformation"), (_CALLS, "JVM call"), (_FILES, "direct file read")):
        if pattern.search(text):
            return problem
    return None
