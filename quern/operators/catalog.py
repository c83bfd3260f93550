"""Metadata: themes, tables, fields, glossary, profiles, relations and generated texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from quern.functions import fixed
from quern.functions.columns import cell_text, contains_any, like_any
from quern.functions.keys import keys_of
from quern.operators.history import latest_supplied


# -- lists ----------------------------------------------------------------------


def theme_table_counts(theme: DataFrame, links: DataFrame) -> DataFrame:
    """Tables per theme, 0 for empty themes; links are counted before the join."""
    counts = links.groupBy("theme_id").agg(F.count("table_id").alias("table_count"))
    return theme.join(counts, "theme_id", "left").withColumn("table_count", F.coalesce("table_count", F.lit(0)))


def theme_order(theme: DataFrame, sort_by: str | None = None, sort_order: str = "asc") -> list[Column]:
    """By name, or by sort order with the newest first; always closed by the key."""
    if sort_by == "name":
        return [F.desc("theme_name") if sort_order == "desc" else F.asc("theme_name"), F.asc("theme_id")]
    newest = [F.desc("created_at")] if "created_at" in theme.columns else []
    return [F.asc("sort_order"), *newest, F.asc("theme_id")]


def list_themes(
    theme: DataFrame, links: DataFrame, is_public: bool | None = None, keyword: str | None = None
) -> DataFrame:
    """Filtered themes with their table count; page the result by ``theme_order``."""
    if is_public is not None:
        theme = theme.filter(F.col("is_public") == is_public)
    if keyword:
        theme = theme.filter(like_any(keyword, "theme_name", "theme_description"))
    return theme_table_counts(theme, links)


def table_overview(tables: DataFrame, fields: DataFrame, links: DataFrame, theme: DataFrame) -> DataFrame:
    """Field count and sorted theme names per table."""
    counts = fields.groupBy("table_id").agg(F.count(F.lit(1)).alias("field_count"))
    themes = (
        links.join(theme.select("theme_id", "theme_name"), "theme_id")
        .groupBy("table_id")
        .agg(F.sort_array(F.collect_set("theme_name")).alias("themes"))
    )
    empty = F.array().cast("array<string>")
    return (
        tables.join(counts, "table_id", "left")
        .join(themes, "table_id", "left")
        .withColumns({"field_count": F.coalesce("field_count", F.lit(0)), "themes": F.coalesce("themes", empty)})
    )


def field_overview(fields: DataFrame, tables: DataFrame) -> DataFrame:
    return fields.join(tables.select("table_id", "table_name_cn", "table_name_en"), "table_id", "left")


def _filtered(df: DataFrame, keyword: str | None, names: Sequence[str], active: bool | None) -> DataFrame:
    if keyword:
        df = df.filter(contains_any(keyword, *names))
    if active is not None:
        df = df.filter(F.col("is_active") == active)
    return df


def list_tables(
    tables: DataFrame, links: DataFrame, theme_id: int | None = None, keyword: str | None = None, active: bool | None = None
) -> DataFrame:
    if theme_id:
        tables = tables.join(keys_of(links.filter(F.col("theme_id") == theme_id), "table_id"), "table_id", "left_semi").select(
            *tables.columns
        )
    return _filtered(tables, keyword, ["table_name_en", "table_name_cn"], active)


def list_fields(
    fields: DataFrame, table_id: int | None = None, keyword: str | None = None, active: bool | None = None
) -> DataFrame:
    if table_id:
        fields = fields.filter(F.col("table_id") == table_id)
    return _filtered(fields, keyword, ["field_name_en", "field_name_cn"], active)


def list_glossary(
    glossary: DataFrame, category: str | None = None, keyword: str | None = None, active: bool | None = None
) -> DataFrame:
    if category:
        glossary = glossary.filter(F.col("category") == category)
    return _filtered(glossary, keyword, ["term_name", "term_description"], active)


def _kinds(theme: DataFrame, tables: DataFrame, fields: DataFrame, glossary: DataFrame) -> list[DataFrame]:
    """The four metadata tables in one shape: kind, id, name, second text."""
    shapes = [
        ("theme", theme, "theme_id", "theme_name", "theme_description"),
        ("table", tables, "table_id", "table_name_cn", "table_name_en"),
        ("field", fields, "field_id", "field_name_cn", "field_name_en"),
        ("glossary", glossary, "term_id", "term_name", "term_description"),
    ]
    return [
        df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(name).alias("name"), F.col(text).alias("text"))
        for kind, df, key, name, text in shapes
    ]


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def search_metadata(theme: DataFrame, tables: DataFrame, fields: DataFrame, glossary: DataFrame, keyword: str) -> DataFrame:
    return _union(_kinds(theme, tables, fields, glossary)).filter(contains_any(keyword, "name", "text"))


def metadata_stats(theme: DataFrame, tables: DataFrame, fields: DataFrame, glossary: DataFrame) -> DataFrame:
    """Rows per kind; each count is taken on its own table, so empty kinds show 0."""
    counts = [
        df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
        for kind, df in (("theme", theme), ("table", tables), ("field", fields), ("glossary", glossary))
    ]
    return _union(counts)


# -- rules for writing ----------------------------------------------------------


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def already_taken(new: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows whose key exists."""
    return new.join(keys_of(existing, *keys), list(keys), "left_semi").select(*new.columns)


def deletable_themes(theme: DataFrame, links: DataFrame) -> DataFrame:
    return theme.join(keys_of(links, "theme_id"), "theme_id", "left_anti").select(*theme.columns)


def orphan_fields(fields: DataFrame, tables: DataFrame) -> DataFrame:
    return fields.join(tables.select("table_id"), "table_id", "left_anti").select(*fields.columns)


def upsert_metadata(base: DataFrame, changes: DataFrame, key: str, seq: str) -> DataFrame:
    """Update known keys and add new ones; only supplied fields change, unknown fields of new rows are NULL."""
    fields = [c for c in base.columns if c != key and c in changes.columns]
    latest = latest_supplied(changes, [key], fields, seq).select(key, *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = base.join(latest, key, "full")

    def value(name: str) -> Column:
        if name not in fields:
            return F.col(name)
        return F.when(F.col(f"_new_{name}").isNotNull(), F.col(f"_new_{name}.v")).otherwise(F.col(name)).alias(name)

    return joined.select(*[value(c) for c in base.columns])


def theme_scope(theme: DataFrame, links: DataFrame, theme_id: int | None) -> DataFrame:
    """Tables of the selected theme and of every public theme, each once."""
    chosen = F.col("is_public") if theme_id is None else F.col("is_public") | (F.col("theme_id") == theme_id)
    return links.join(theme.filter(chosen), "theme_id", "left_semi").select("table_id").distinct()


def effective_glossary(glossary: DataFrame, user_id: int) -> DataFrame:
    """Own terms before admin terms of the same name; other users' terms are hidden.

    Spark cuts each task to one row per term before the shuffle (window group
    limit), so a term held by a third of all rows stays small.
    """
    own = F.col("term_type") == "user"
    visible = glossary.filter(~own | (F.col("user_id") == user_id))
    first = W.partitionBy("term_name").orderBy(F.when(own, 0).otherwise(1), "term_id")
    return visible.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


# -- relations ------------------------------------------------------------------


def association_join(a: DataFrame, b: DataFrame, a_key: str, b_key: str, length: int, how: str = "inner") -> DataFrame:
    """Join ``a`` to ``b`` where a's key equals the first characters of b's key; stays an equi-join."""
    return a.join(b, F.col(a_key) == F.left(F.col(b_key), F.lit(length)), how)


def relation_join(
    relations: DataFrame, fields: DataFrame, relation_id: int, source: DataFrame, target: DataFrame, how: str = "inner"
) -> DataFrame:
    """Join two tables by an active recorded relation. Reads one catalogue row to learn the key names."""
    names = fields.select("field_id", "field_name_en")
    pair = (
        relations.filter((F.col("relation_id") == relation_id) & F.col("is_active"))
        .join(names.select(F.col("field_id").alias("source_field_id"), F.col("field_name_en").alias("s")), "source_field_id")
        .join(names.select(F.col("field_id").alias("target_field_id"), F.col("field_name_en").alias("t")), "target_field_id")
        .select("s", "t")
        .first()
    )
    if pair is None:
        raise ValueError(f"no active relation {relation_id}")
    return source.join(target, source[pair.s] == target[pair.t], how)


def relation_cardinality(a: DataFrame, a_key: str, b: DataFrame, b_key: str, declared: str | None = None) -> DataFrame:
    """Most rows per key on each side and the kind of relation they amount to; NULL keys do not relate."""

    def most(df: DataFrame, key: str) -> Column:
        per_key = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        return per_key.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"))

    left, right = F.col("source_max"), F.col("target_max")
    observed = (
        F.when((left <= 1) & (right <= 1), "one_to_one")
        .when(left <= 1, "one_to_many")
        .when(right <= 1, "many_to_one")
        .otherwise("many_to_many")
    )
    return (
        most(a, a_key)
        .select(F.col("n").alias("source_max"), most(b, b_key).scalar().alias("target_max"))
        .select("*", F.lit(declared).cast("string").alias("declared"), observed.alias("observed"))
    )


def lineage_edges(lineage: DataFrame) -> DataFrame:
    edges = lineage.select(
        "lineage_id", F.explode(F.split("input_tables", ",")).alias("input_table"), "output_table"
    ).withColumn("input_table", F.trim("input_table"))
    return edges.filter("input_table <> ''")


# -- profiles -------------------------------------------------------------------


#: Standard error of the sketches that count distinct values.
SKETCH_ERROR = 0.01


def profile_columns(df: DataFrame, exact: Sequence[str] = ()) -> DataFrame:
    """One row per column: rows, distinct, nulls, min, max, length of the longest text, numeric or not.

    Distinct values are counted by sketches, one per column and task, in the
    same scan as everything else. Columns named in ``exact`` are counted
    exactly instead, each by a scan of that column alone that shuffles its
    distinct values.
    """
    aggregates, rows = [F.count(F.lit(1)).alias("rows")], []
    for i, field in enumerate(df.schema.fields):
        col, is_text = F.col(field.name), isinstance(field.dataType, T.StringType)
        aggregates += [F.count(col).alias(f"n{i}"), F.min(col).alias(f"lo{i}"), F.max(col).alias(f"hi{i}")]
        aggregates += [F.max(F.char_length(col)).alias(f"len{i}")] if is_text else []
        if field.name in exact:
            known = df.select(field.name).filter(col.isNotNull()).distinct().agg(F.count(F.lit(1))).scalar()
        else:
            aggregates.append(F.approx_count_distinct(col, SKETCH_ERROR).alias(f"d{i}"))
            known = F.col(f"d{i}")
        low, high = (
            F.when(F.col(f"{end}{i}").isNotNull(), cell_text(F.col(f"{end}{i}"), field.dataType)) for end in ("lo", "hi")
        )
        rows.append(
            F.struct(
                F.lit(field.name).alias("column_name"),
                F.col("rows").alias("row_count"),
                known.alias("distinct_count"),
                (F.col("rows") - F.col(f"n{i}")).alias("null_count"),
                low.alias("min_value"),
                high.alias("max_value"),
                (F.col(f"len{i}") if is_text else F.lit(None).cast("int")).alias("max_length"),
                F.lit(isinstance(field.dataType, T.NumericType)).alias("is_numeric"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def sample_values(df: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` most frequent values of each column as texts, most frequent first, equal ones by text.

    Each column is read alone and its typed values are counted in the map
    tasks first; every task then keeps ``n`` candidates.
    """
    whole = None
    for name in df.columns:
        value = F.col(f"`{name}`")
        counts = df.filter(value.isNotNull()).groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
        best = counts.select(F.col("v").cast("string").alias("value"), "n").orderBy(F.desc("n"), "value").limit(n)
        ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("r"), "value")))
        one = best.agg(ranked.alias("s")).filter(F.size("s") > 0)
        one = one.select(F.lit(name).alias("column_name"), F.transform("s", lambda x: x["value"]).alias("sample_values"))
        whole = one if whole is None else whole.unionByName(one)
    return whole


# -- generated texts --------------------------------------------------------------


def ddl_type(col: Column) -> Column:
    kinds = [F.when(col == kind, F.lit(text)) for kind, text in fixed.DDL_TYPES.items()]
    return F.coalesce(*kinds, F.lit(fixed.DDL_DEFAULT_TYPE))


def _lines(fields: DataFrame, line: Column, separator: str) -> DataFrame:
    """One text per table from its fields in id order; a table's fields are few."""
    ordered = F.array_sort(F.collect_list(F.struct("field_id", line.alias("line"))))
    return fields.groupBy("table_id").agg(
        F.array_join(F.transform(ordered, lambda s: s["line"]), separator).alias("field_lines")
    )


def table_ddl(tables: DataFrame, fields: DataFrame) -> DataFrame:
    line = F.concat(F.lit("    "), F.col("field_name_en"), F.lit(" "), ddl_type(F.col("field_type")))
    ddl = F.concat(
        F.lit("CREATE TABLE "), F.col("table_name_en"), F.lit(" (\n"), F.coalesce("field_lines", F.lit("")), F.lit("\n);")
    )
    return tables.join(_lines(fields, line, ",\n"), "table_id", "left").select("table_id", "table_name_en", ddl.alias("ddl"))


def table_docs(tables: DataFrame, fields: DataFrame, description: str = "table_description") -> DataFrame:
    """A description document per table."""
    name, field_name = (
        F.concat(F.col(cn), F.lit(" ("), F.col(en), F.lit(")"))
        for cn, en in (("table_name_cn", "table_name_en"), ("field_name_cn", "field_name_en"))
    )
    line = F.concat(F.lit("- "), field_name, F.lit(": "), F.col("field_type"))
    told = F.nullif(F.col(description), F.lit("")) if description in tables.columns else F.lit(None).cast("string")
    doc = F.concat_ws(
        "\n",
        F.concat(F.lit("表名: "), name),
        F.concat(F.lit("描述: "), F.coalesce(told, F.lit(fixed.NO_DESCRIPTION))),
        F.when(F.col("field_lines").isNotNull(), F.concat(F.lit("字段说明:\n"), F.col("field_lines"))),
    )
    return tables.join(_lines(fields, line, "\n"), "table_id", "left").select("table_id", "table_name_en", doc.alias("doc"))


def schema_prompt(tables: DataFrame, fields: DataFrame) -> DataFrame:
    """One schema line per table, as put before a question."""
    line = F.concat(F.col("field_name_cn"), F.lit("("), F.col("field_name_en"), F.lit(")"))
    text = F.concat(
        F.lit("表"), F.col("table_name_cn"), F.lit("("), F.col("table_name_en"), F.lit("): "),
        F.coalesce("field_lines", F.lit("")),
    )
    return tables.join(_lines(fields, line, ", "), "table_id", "left").select(
        "table_id", "table_name_en", text.alias("prompt_line")
    )


# -- changes ----------------------------------------------------------------------


def changed_since(df: DataFrame, last_scan: object, ts: str = "updated_at") -> DataFrame:
    return df.filter(F.col(ts) > F.lit(last_scan).cast(df.schema[ts].dataType))


def sync_status(df: DataFrame, last_scan: object, ts: str = "updated_at") -> DataFrame:
    """Last scan time and how many rows wait for the next one."""
    return changed_since(df, last_scan, ts).agg(
        F.lit(str(last_scan)).alias("last_sync_time"), F.count(F.lit(1)).alias("pending_sync_count")
    )


def live_schema(tables: dict[str, DataFrame]) -> DataFrame:
    """Column names and types of live tables as rows (catalogue-sized)."""
    rows = [(name, f.name, f.dataType.simpleString()) for name, df in tables.items() for f in df.schema.fields]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")


def schema_diff(live: DataFrame, recorded: DataFrame) -> DataFrame:
    """Added, removed and retyped columns between live tables and the recorded catalogue."""
    keys = ["table_name", "column_name"]
    both = live.select(*keys, F.col("data_type").alias("live_type")).join(
        recorded.select(*keys, F.col("data_type").alias("recorded_type")), keys, "full"
    )
    change = (
        F.when(F.col("recorded_type").isNull(), "added")
        .when(F.col("live_type").isNull(), "removed")
        .when(F.col("live_type") != F.col("recorded_type"), "retyped")
    )
    return both.withColumn("change", change).filter("change IS NOT NULL")


# -- frequent values by bounded summaries --------------------------------------------

#: Counters per column that each task keeps; a value outside every summary has at most rows / (COUNTERS + 1).
COUNTERS = 64


def _summaries(counters: int):
    """Per task and column a Misra-Gries summary (value, lower count) and the column's row count."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        held: dict[str, dict[str, int]] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for name in set(table.column("c").to_pylist()):
                values = table.filter(pc.equal(table.column("c"), name)).column("v")
                rows[name] = rows.get(name, 0) + len(values)
                summary = held.setdefault(name, {})
                for item in pc.value_counts(values).to_pylist():
                    summary[item["values"]] = summary.get(item["values"], 0) + item["counts"]
                if len(summary) > counters:  # the merge of summaries: lower all by the (counters + 1)-th count
                    cut = sorted(summary.values(), reverse=True)[counters]
                    held[name] = {v: c - cut for v, c in summary.items() if c > cut}
        out = [(n, v, c) for n, s in held.items() for v, c in s.items()] + [(n, None, -r) for n, r in rows.items()]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out]), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.int64())],
                ["c", "v", "n"],
            )

    return run


def frequent_values(df: DataFrame, n: int = 5, counters: int = COUNTERS) -> DataFrame:
    """The rows of :func:`sample_values` from one scan with bounded summaries and one exact recount.

    Candidates are the values of any task's summary; their counts are taken
    again exactly. A value in no summary has at most rows / (counters + 1)
    rows, so where the n-th recounted value has more, the top n is proven
    complete; other columns are counted exactly (ties at the bound included).
    """
    stacked = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in df.columns])).alias("s")
    ).select("s.c", "s.v").filter(F.col("v").isNotNull())
    found = stacked.mapInArrow(_summaries(counters), "c string, v string, n long")
    found = found.groupBy("c", "v").agg(F.sum("n").alias("n"))
    totals = found.filter(F.col("v").isNull()).select("c", (-F.col("n")).alias("rows"))
    candidates = found.filter(F.col("v").isNotNull()).select("c", "v")
    recount = stacked.join(candidates, ["c", "v"], "left_semi").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("c").orderBy(F.desc("n"), "v")
    best = recount.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= n)
    nth = best.groupBy("c").agg(F.min("n").alias("nth"), F.count(F.lit(1)).alias("got"))
    proven = nth.join(totals, "c").filter(
        (F.col("nth") > F.floor(F.col("rows") / (counters + 1))) & (F.col("got") == n)
    ).select("c")
    proven_names = {r.c for r in proven.collect()}  # one name per column
    rest = [c for c in df.columns if c not in proven_names]
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("r"), F.col("v").alias("value"))))
    shown = best.join(proven, "c").groupBy("c").agg(ranked.alias("s"))
    shown = shown.select(F.col("c").alias("column_name"), F.transform("s", lambda x: x["value"]).alias("sample_values"))
    if rest:
        shown = shown.unionByName(sample_values(df.select(*[F.col(f"`{c}`") for c in rest]), n))
    return shown
