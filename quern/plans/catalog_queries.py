"""Queries on metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import fixed
from quern.operators import catalog as C
from quern.operators.results import page
from quern.plans.registry import query
from quern.plans.views import view
from quern.sources.tables import read_table


def _joined(col: str, sep: str = ","):
    return F.array_join(col, sep).alias(col)


def _four(spark, d):
    return [view(spark, d, v) for v in ("theme", "mtable", "mfield", "glossary")]


@query(
    "d01_list_themes",
    """
    SELECT theme_id, theme_name, sort_order, (SELECT count(*) FROM table_theme l WHERE l.theme_id = t.theme_id) AS table_count
    FROM theme t WHERE NOT is_public AND (theme_name ILIKE '%r#_0%1%' OR theme_description ILIKE '%r#_0%1%')
    ORDER BY sort_order, theme_id LIMIT 5
    """,
    views=("theme", "table_theme"),
)
def _themes(spark, d):
    found = C.list_themes(view(spark, d, "theme"), view(spark, d, "table_theme"), is_public=False, keyword="R#_0%1")
    return page(found, C.theme_order(found), 1, 5).select("theme_id", "theme_name", "sort_order", "table_count")


@query(
    "d02_theme_table_counts",
    """
    SELECT t.theme_id, count(l.table_id) AS table_count FROM every_theme t
    LEFT JOIN table_theme l ON t.theme_id = l.theme_id GROUP BY 1
    """,
    views=("every_theme", "table_theme"),
)
def _theme_counts(spark, d):
    return C.theme_table_counts(view(spark, d, "every_theme"), view(spark, d, "table_theme")).select("theme_id", "table_count")


@query(
    "d03_table_overview",
    """
    SELECT t.table_id, coalesce(n, 0) AS field_count, coalesce(themes, '') AS themes FROM mtable t
    LEFT JOIN (SELECT table_id, count(*) AS n FROM mfield WHERE is_active GROUP BY 1) f ON f.table_id = t.table_id
    LEFT JOIN (SELECT table_id, string_agg(DISTINCT theme_name, ',' ORDER BY theme_name) AS themes
               FROM table_theme JOIN theme USING (theme_id) GROUP BY 1) h ON h.table_id = t.table_id
    """,
    views=("mtable", "mfield", "table_theme", "theme"),
)
def _overview(spark, d):
    out = C.table_overview(
        view(spark, d, "mtable"), view(spark, d, "mfield").filter("is_active"), view(spark, d, "table_theme"), view(spark, d, "theme")
    )
    return out.select("table_id", "field_count", _joined("themes"))


@query(
    "d04_field_overview",
    """
    SELECT field_id, field_name_en, table_name_cn, table_name_en FROM mfield f
    LEFT JOIN (SELECT * FROM mtable WHERE is_active) t ON f.table_id = t.table_id
    """,
    views=("mfield", "mtable"),
)
def _fields(spark, d):
    out = C.field_overview(view(spark, d, "mfield"), view(spark, d, "mtable").filter("is_active"))
    return out.select("field_id", "field_name_en", "table_name_cn", "table_name_en")


@query(
    "d05_list_tables",
    """
    SELECT table_id, table_name_en FROM mtable WHERE is_active AND (contains(lower(table_name_en), 'red') OR
        contains(lower(table_name_cn), 'red')) AND table_id IN (SELECT table_id FROM table_theme WHERE theme_id = 2)
    """,
    views=("mtable", "table_theme"),
)
def _tables(spark, d):
    out = C.list_tables(view(spark, d, "mtable"), view(spark, d, "table_theme"), 2, "Red", True)
    return out.select("table_id", "table_name_en")


@query(
    "d06_list_fields",
    """
    SELECT field_id, table_id, field_name_en FROM mfield WHERE is_active AND (contains(lower(field_name_en), 'd 3') OR
        contains(lower(field_name_cn), 'd 3'))
    """,
    views=("mfield",),
)
def _list_fields(spark, d):
    return C.list_fields(view(spark, d, "mfield"), keyword="D 3", active=True).select("field_id", "table_id", "field_name_en")


@query(
    "d07_list_glossary",
    """
    SELECT term_id, term_name FROM (SELECT *, term_type AS category, term_id % 2 = 0 AS is_active FROM glossary)
    WHERE category = 'user' AND is_active AND (contains(lower(term_name), 'brand#1') OR
        contains(lower(term_description), 'brand#1'))
    """,
    views=("glossary",),
)
def _list_glossary(spark, d):
    terms = view(spark, d, "glossary").selectExpr("*", "term_type AS category", "term_id % 2 = 0 AS is_active")
    return C.list_glossary(terms, "user", "BRAND#1", True).select("term_id", "term_name")


@query(
    "d08_search_metadata",
    """
    SELECT * FROM (
      SELECT 'theme' AS kind, theme_id AS id, theme_name AS name, theme_description AS text FROM theme UNION ALL
      SELECT 'table', table_id, table_name_cn, table_name_en FROM mtable UNION ALL
      SELECT 'field', field_id, field_name_cn, field_name_en FROM mfield UNION ALL
      SELECT 'glossary', term_id, term_name, term_description FROM glossary)
    WHERE contains(lower(name), 'a') OR contains(lower(text), 'a')
    """,
    views=("theme", "mtable", "mfield", "glossary"),
)
def _search(spark, d):
    return C.search_metadata(*_four(spark, d), keyword="A")


@query(
    "d09_metadata_stats",
    """
    SELECT 'theme' AS kind, count(*) AS n FROM theme UNION ALL SELECT 'table', count(*) FROM mtable UNION ALL
    SELECT 'field', count(*) FROM mfield UNION ALL SELECT 'glossary', count(*) FROM glossary
    """,
    views=("theme", "mtable", "mfield", "glossary"),
)
def _stats(spark, d):
    return C.metadata_stats(*_four(spark, d))


@query(
    "d10_check_unique",
    "SELECT term_name, term_description, count(*) AS n FROM glossary GROUP BY 1, 2 HAVING count(*) > 1",
    views=("glossary",),
)
def _unique(spark, d):
    return C.check_unique(view(spark, d, "glossary"), ["term_name", "term_description"])


@query(
    "d10_already_taken",
    """
    SELECT term_id, term_name FROM glossary WHERE term_type = 'user'
      AND term_name IN (SELECT term_name FROM glossary WHERE term_type = 'admin' AND term_description LIKE 'red%')
    """,
    views=("glossary",),
)
def _taken(spark, d):
    terms = view(spark, d, "glossary")
    existing = terms.filter("term_type = 'admin' AND term_description LIKE 'red%'")
    return C.already_taken(terms.filter("term_type = 'user'"), existing, ["term_name"]).select("term_id", "term_name")


@query(
    "d11_deletable_themes",
    "SELECT theme_id, theme_name FROM every_theme WHERE theme_id NOT IN (SELECT theme_id FROM table_theme)",
    views=("every_theme", "table_theme"),
)
def _deletable(spark, d):
    return C.deletable_themes(view(spark, d, "every_theme"), view(spark, d, "table_theme")).select("theme_id", "theme_name")


@query(
    "d12_orphan_fields",
    "SELECT field_id, table_id FROM mfield WHERE table_id NOT IN (SELECT table_id FROM mtable WHERE is_active)",
    views=("mfield", "mtable"),
)
def _orphans(spark, d):
    return C.orphan_fields(view(spark, d, "mfield"), view(spark, d, "mtable").filter("is_active")).select("field_id", "table_id")


@query(
    "d13_upsert_metadata",
    """
    WITH ch AS (
      SELECT term_id + 300 AS term_id, 'one' AS term_name, CAST(NULL AS VARCHAR) AS term_description, 1 AS step
      FROM glossary WHERE term_type = 'user'
      UNION ALL SELECT term_id + 300, NULL, concat('new ', term_description), 2 FROM glossary),
    last AS (SELECT term_id, max(term_name) AS term_name, max(term_description) AS term_description FROM ch GROUP BY 1)
    SELECT coalesce(g.term_id, l.term_id) AS term_id, coalesce(l.term_name, g.term_name) AS term_name,
           coalesce(l.term_description, g.term_description) AS term_description, g.term_type
    FROM glossary g FULL JOIN last l ON g.term_id = l.term_id
    """,
    views=("glossary",),
)
def _upsert(spark, d):
    base = view(spark, d, "glossary").select("term_id", "term_name", "term_description", "term_type")
    changes = base.filter("term_type = 'user'").selectExpr(
        "term_id + 300 AS term_id", "'one' AS term_name", "CAST(NULL AS STRING) AS term_description", "1 AS step"
    ).unionByName(
        base.selectExpr(
            "term_id + 300 AS term_id", "CAST(NULL AS STRING) AS term_name",
            "concat('new ', term_description) AS term_description", "2 AS step",
        )
    )
    return C.upsert_metadata(base, changes, "term_id", "step")


@query(
    "d14_theme_scope",
    """
    SELECT DISTINCT table_id FROM table_theme JOIN theme USING (theme_id) WHERE is_public OR theme_id = 3
    """,
    views=("table_theme", "theme"),
)
def _scope(spark, d):
    return C.theme_scope(view(spark, d, "theme"), view(spark, d, "table_theme"), 3)


@query(
    "d15_effective_glossary",
    """
    SELECT term_id, term_name, term_type FROM (
      SELECT *, row_number() OVER (PARTITION BY term_name ORDER BY CASE WHEN term_type = 'user' THEN 0 ELSE 1 END, term_id) AS rn
      FROM glossary WHERE term_type <> 'user' OR user_id = 3) WHERE rn = 1
    """,
    views=("glossary",),
)
def _glossary(spark, d):
    return C.effective_glossary(view(spark, d, "glossary"), 3).select("term_id", "term_name", "term_type")


@query(
    "d16_association_join",
    """
    SELECT r_name, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size FROM
      (SELECT 'Brand#1' AS prefix, 'first' AS r_name UNION ALL SELECT 'Brand#2', 'second') a
      JOIN part ON a.prefix = left(p_brand, 7) GROUP BY 1
    """,
)
def _association(spark, d):
    """Two brand families stand for the short side; every part is on the long side."""
    families = (
        read_table(spark, d, "part")
        .select(F.left("p_brand", F.lit(7)).alias("prefix"))
        .filter("prefix IN ('Brand#1', 'Brand#2')")
        .distinct()
        .withColumn("r_name", F.expr("IF(prefix = 'Brand#1', 'first', 'second')"))
    )
    joined = C.association_join(families, read_table(spark, d, "part"), "prefix", "p_brand", 7)
    return joined.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("size"))


@query(
    "d17_relation_join",
    """
    SELECT c_mktsegment, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
    """,
)
def _relation(spark, d):
    """The recorded relation is found in a catalogue made from the live schemas of both tables."""
    orders, customer = read_table(spark, d, "orders"), read_table(spark, d, "customer")
    fields = C.live_schema({"orders": orders, "customer": customer}).select(
        F.xxhash64("table_name", "column_name").alias("field_id"), F.col("column_name").alias("field_name_en")
    )

    def key(table, column):
        return F.xxhash64(F.lit(table), F.lit(column))

    relations = spark.range(1).select(
        F.lit(7).alias("relation_id"), key("orders", "o_custkey").alias("source_field_id"),
        key("customer", "c_custkey").alias("target_field_id"), F.lit(True).alias("is_active"),
    )
    joined = C.relation_join(relations, fields, 7, orders, customer)
    return joined.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("amount")
    )


@query(
    "d18_relation_cardinality",
    """
    SELECT (SELECT max(n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_custkey)) AS source_max,
           (SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)) AS target_max,
           'one_to_one' AS declared, 'one_to_many' AS observed
    """,
)
def _cardinality(spark, d):
    return C.relation_cardinality(
        read_table(spark, d, "customer"), "c_custkey", read_table(spark, d, "orders"), "o_custkey", "one_to_one"
    )


@query(
    "d19_lineage_edges",
    "SELECT * FROM (SELECT lineage_id, trim(unnest(string_split(input_tables, ','))) AS input_table, output_table FROM lineage) WHERE input_table <> ''",
    views=("lineage",),
)
def _lineage(spark, d):
    return C.lineage_edges(view(spark, d, "lineage"))


_PLAIN, _DOUBLE = "CAST({} AS VARCHAR)", "regexp_replace(CAST({} AS VARCHAR), '\\.0$', '')"
_TIME = "strftime({}, '%Y-%m-%dT%H:%M:%S')"


def _shown(profile):
    """Lengths as text: they are NULL for columns without text."""
    return profile.withColumn("max_length", F.col("max_length").cast("string"))


def _profile_sql(table: str, columns: dict[str, str]) -> str:
    """Checking text: column name to the expression that shows a value."""
    parts = []
    for name, shown in columns.items():
        numeric = "true" if name in ("p_partkey", "p_size", "p_retailprice") else "false"
        text = f"max(length({name}))" if shown == _PLAIN and numeric == "false" else "NULL"
        lo, hi = (shown.format(f"{f}({name})") for f in ("min", "max"))
        parts.append(
            f"SELECT '{name}' AS column_name, count(*) AS row_count, count(DISTINCT {name}) AS distinct_count, "
            f"count(*) - count({name}) AS null_count, {lo} AS min_value, {hi} AS max_value, "
            f"CAST({text} AS VARCHAR) AS max_length, {numeric} AS is_numeric FROM {table}"
        )
    return " UNION ALL ".join(parts)


def _exact(df):
    return C.profile_columns(df, exact=df.columns)


@query(
    "d20_profile_columns",
    _profile_sql(
        "part",
        {"p_partkey": _PLAIN, "p_name": _PLAIN, "p_brand": _PLAIN, "p_type": _PLAIN, "p_size": _PLAIN, "p_retailprice": _DOUBLE},
    ),
)
def _profile(spark, d):
    return _shown(_exact(read_table(spark, d, "part")))


@query(
    "d20_profile_columns_with_nulls",
    _profile_sql("(SELECT generated_sql, status, created_at FROM hist)", {"generated_sql": _PLAIN, "status": _PLAIN, "created_at": "{}"})
    .replace("min(created_at) AS min_value", "min(strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f')) AS min_value")
    .replace("max(created_at) AS max_value", "max(strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f')) AS max_value"),
    views=("hist",),
)
def _profile_nulls(spark, d):
    return _shown(_exact(view(spark, d, "hist").select("generated_sql", "status", "created_at")))


_SKETCHED = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
             "l_returnflag", "l_linestatus", "l_shipdate")


@query(
    "d20_profile_columns_approximate",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS row_count, count(DISTINCT {c}) >= 0 AS near FROM lineitem" for c in _SKETCHED),
)
def _profile_approx(spark, d):
    """Sketched distinct counts, held against exact ones: within five per cent."""
    lines = read_table(spark, d, "lineitem").select(*_SKETCHED)
    rough = C.profile_columns(lines).select("column_name", "row_count", F.col("distinct_count").alias("rough"))
    sure = _exact(lines).select("column_name", F.col("distinct_count").alias("sure"))
    near = F.abs(F.col("rough") - F.col("sure")) <= 0.05 * F.col("sure")
    return rough.join(sure, "column_name").select("column_name", "row_count", near.alias("near"))


@query(
    "d21_sample_values",
    """
    SELECT column_name, string_agg(value, ',' ORDER BY rn) AS sample_values FROM (
      SELECT column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY count(*) DESC, value) AS rn FROM (
        SELECT 'p_name' AS column_name, p_name AS value FROM part UNION ALL SELECT 'p_brand', p_brand FROM part UNION ALL
        SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part
        UNION ALL SELECT 'p_partkey', CAST(p_partkey AS VARCHAR) FROM part UNION ALL SELECT 'p_retailprice', CAST(p_retailprice AS VARCHAR) FROM part)
      GROUP BY 1, 2) WHERE rn <= 5 GROUP BY 1
    """,
)
def _samples(spark, d):
    out = C.sample_values(read_table(spark, d, "part"), 5)
    return out.select("column_name", _joined("sample_values"))

@query(
    "d21_sample_values_summaries",
    """
    SELECT column_name, string_agg(value, ',' ORDER BY rn) AS sample_values FROM (
      SELECT column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY count(*) DESC, value) AS rn FROM (
        SELECT 'p_name' AS column_name, p_name AS value FROM part UNION ALL SELECT 'p_brand', p_brand FROM part UNION ALL
        SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part
        UNION ALL SELECT 'p_partkey', CAST(p_partkey AS VARCHAR) FROM part UNION ALL SELECT 'p_retailprice', CAST(p_retailprice AS VARCHAR) FROM part)
      GROUP BY 1, 2) WHERE rn <= 5 GROUP BY 1
    """,
)
def _samples_summaries(spark, d):
    """d21 from one scan with bounded summaries per task and one exact recount of the candidates."""
    out = C.frequent_values(read_table(spark, d, "part"), 5)
    return out.select("column_name", _joined("sample_values"))



_DDL_CASE = "CASE field_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.DDL_TYPES.items()) + f" ELSE '{fixed.DDL_DEFAULT_TYPE}' END"


@query(
    "d23_table_ddl",
    f"""
    SELECT t.table_id, table_name_en, 'CREATE TABLE ' || table_name_en || ' (' || chr(10) ||
           coalesce(string_agg('    ' || field_name_en || ' ' || {_DDL_CASE}, ',' || chr(10) ORDER BY field_id), '')
           || chr(10) || ');' AS ddl
    FROM mtable t LEFT JOIN mfield f ON f.table_id = t.table_id GROUP BY 1, 2
    """,
    views=("mtable", "mfield"),
)
def _ddl(spark, d):
    return C.table_ddl(view(spark, d, "mtable"), view(spark, d, "mfield"))


@query(
    "d24_table_docs",
    """
    SELECT t.table_id, table_name_en, '表名: ' || table_name_cn || ' (' || table_name_en || ')' || chr(10) || '描述: ' ||
           CASE WHEN t.table_id % 2 = 0 THEN 'about ' || table_name_en ELSE '无描述' END ||
           coalesce(chr(10) || '字段说明:' || chr(10) || string_agg('- ' || field_name_cn || ' (' || field_name_en || '): '
           || field_type, chr(10) ORDER BY field_id), '') AS doc
    FROM mtable t LEFT JOIN mfield f ON f.table_id = t.table_id GROUP BY 1, 2, table_name_cn
    """,
    views=("mtable", "mfield"),
)
def _docs(spark, d):
    tables = view(spark, d, "mtable").withColumn(
        "table_description", F.expr("CASE WHEN table_id % 2 = 0 THEN concat('about ', table_name_en) WHEN table_id % 3 = 0 THEN '' END")
    )
    return C.table_docs(tables, view(spark, d, "mfield"))


@query(
    "d25_schema_prompt",
    """
    SELECT t.table_id, table_name_en, '表' || table_name_cn || '(' || table_name_en || '): ' ||
           coalesce(string_agg(field_name_cn || '(' || field_name_en || ')', ', ' ORDER BY field_id), '') AS prompt_line
    FROM mtable t LEFT JOIN mfield f ON f.table_id = t.table_id GROUP BY 1, 2, table_name_cn
    """,
    views=("mtable", "mfield"),
)
def _prompt(spark, d):
    return C.schema_prompt(view(spark, d, "mtable"), view(spark, d, "mfield"))


@query(
    "d26_changed_since",
    "SELECT id, status FROM hist WHERE created_at > TIMESTAMP '2024-01-20 00:00:00'",
    views=("hist",),
)
def _changed(spark, d):
    return C.changed_since(view(spark, d, "hist"), "2024-01-20 00:00:00", "created_at").select("id", "status")


@query(
    "d26_sync_status",
    """
    SELECT '2024-01-20 00:00:00' AS last_sync_time, count(*) AS pending_sync_count FROM hist
    WHERE created_at > TIMESTAMP '2024-01-20 00:00:00'
    """,
    views=("hist",),
)
def _sync(spark, d):
    return C.sync_status(view(spark, d, "hist"), "2024-01-20 00:00:00", "created_at")
