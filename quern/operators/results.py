"""Result rows: running, capping, paging, searching, showing, masking, and common business queries."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from quern.functions import fixed
from quern.functions.columns import (
    any_of,
    cell_text,
    display_text,
    is_double,
    iso_text,
    mask_middle,
    money,
    scaled_hundredths,
)
from quern.functions.guards import first_hit, normalised, plan_problem, prepared, read_only_problem
from quern.functions.keys import keys_of

Order = Sequence[str | Column]


def run_sql(
    spark: SparkSession,
    sql: str,
    args: Mapping[str, object] | Sequence[object] | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Run a read-only statement with bound parameters; all rows, unless ``max_rows`` caps them."""
    problem = read_only_problem(sql) or plan_problem(spark, sql.strip().rstrip(";"))
    if problem:
        raise ValueError(f"statement refused: {problem}")
    result = spark.sql(sql.strip().rstrip(";"), args=args) if args else spark.sql(sql.strip().rstrip(";"))
    return result if max_rows is None else cap_rows(result, max_rows)


def cap_rows(df: DataFrame, n: int = fixed.RESULT_ROWS) -> DataFrame:
    """At most ``n`` rows. A smaller limit inside ``df`` stays in force; Spark merges the two."""
    return df.limit(n)


# rows are told apart by this many splitters at a time, until this many are left to sort
SPLITTERS = 31
SORTED_ROWS = 100_000
_ORDER_TEXT = re.compile(r"^(.*?)(?: (ASC|DESC)(?: NULLS (FIRST|LAST))?)?$", re.S)


def _parts_of(order: Order) -> list[tuple[Column, bool, bool]]:
    """Key, descending and nulls-first of every entry of an order."""
    parts = []
    for item in order:
        text = item if isinstance(item, str) else item._jc.toString()
        name, direction, nulls = _ORDER_TEXT.match(text).groups()
        descending = direction == "DESC"
        parts.append((F.expr(f"`{name}`" if isinstance(item, str) else name), descending, nulls == "FIRST" if nulls else not descending))
    return parts


def after_key(order: Order, key: Sequence[Column]) -> Column:
    """Rows that come after a key in an order: later in the first entry that differs."""
    later = F.lit(False)
    for (col, descending, nulls_first), value in reversed(list(zip(_parts_of(order), key))):
        beyond = F.coalesce(col < value if descending else col > value, F.lit(False))
        at_null = col.isNotNull() & value.isNull() if nulls_first else col.isNull() & value.isNotNull()
        later = beyond | at_null | (col.eqNullSafe(value) & later)
    return later


def page(df: DataFrame, order: Order, page: int = 1, size: int = fixed.PAGE_SIZE) -> DataFrame:
    """One page of rows; ``order`` has to end in a unique key.

    The rows before the page are counted, not sorted: splitters drawn by hash
    cut the rows into ranges, each task counts its rows per range, and the
    range that holds the page's first row is cut again until few rows are
    left. Only these are sorted. Nothing is written, and the driver sees the
    splitters and one count for each. Pages after a known row need no count:
    :func:`page_after`.
    """
    offset = (page - 1) * size
    start, stop, before = None, None, 0  # the page lies after start, which has so many rows up to it, and not after stop

    def rest() -> DataFrame:
        rows = df.filter(after_key(order, start)) if start else df
        return rows.filter(~after_key(order, stop)) if stop else rows

    left = df.count()
    while left > max(SORTED_ROWS, 2 * size):
        rows = rest()
        splitters = _splitters(rows, order)
        upto = list(rows.agg(*[F.count_if(~after_key(order, s)).alias(f"n{i}") for i, s in enumerate(splitters)]).first())
        low = max((n, i) for n, i in [(0, -1), *((n, i) for i, n in enumerate(upto) if before + n <= offset)])
        high = min((n, i) for n, i in [(left, -1), *((n, i) for i, n in enumerate(upto) if before + n >= offset + size)])
        if high[0] - low[0] == left:
            break
        start = splitters[low[1]] if low[1] >= 0 else start
        stop = splitters[high[1]] if high[1] >= 0 else stop
        before, left = before + low[0], high[0] - low[0]
    return rest().orderBy(*order).offset(offset - before).limit(size)


def _splitters(df: DataFrame, order: Order) -> list[list[Column]]:
    """Order keys of up to ``SPLITTERS`` rows drawn by hash; one candidate per task and draw is shuffled."""
    keys = [F.col(f"k{i}") for i in range(len(order))]
    drawn = df.select(*[col.alias(f"k{i}") for i, (col, _, _) in enumerate(_parts_of(order))])
    drawn = drawn.withColumn("h", F.xxhash64(*keys))
    drawn = drawn.groupBy(F.pmod("h", F.lit(SPLITTERS)).alias("b")).agg(F.min_by(F.struct(*keys), "h").alias("key"))
    types = drawn.schema["key"].dataType
    return [
        [F.lit(row.key[i]).cast(f.dataType) for i, f in enumerate(types.fields)] for row in drawn.select("key").collect()
    ]


def page_after(df: DataFrame, order: Order, key: Sequence[object], size: int = fixed.PAGE_SIZE) -> DataFrame:
    """The page that follows the row with this order key. Its cost does not depend on how far down the row is."""
    return df.filter(after_key(order, [F.lit(v) for v in key])).orderBy(*order).limit(size)


def page_info(df: DataFrame, size: int = fixed.PAGE_SIZE) -> DataFrame:
    """One row: total rows and number of pages (0 when size is 0)."""
    total = F.count(F.lit(1))
    pages = F.ceil(total / F.lit(size)).cast("long") if size > 0 else F.lit(0).cast("long")
    return df.agg(total.alias("total"), pages.alias("pages"))


def page_with_total(df: DataFrame, order: Order, page_no: int = 1, size: int = fixed.PAGE_SIZE) -> DataFrame:
    """A page whose rows also carry total and pages, through a one-row subquery."""
    info = page_info(df, size).select(F.struct("total", "pages").alias("info"))
    rows = page(df, order, page_no, size).withColumn("_info", info.scalar())
    return rows.select(*df.columns, F.col("_info.total").alias("total"), F.col("_info.pages").alias("pages"))


def preview(df: DataFrame, order: Order, n: int = fixed.PREVIEW_ROWS) -> DataFrame:
    """The first rows kept with a task."""
    return df.orderBy(*order).limit(n)


def search_rows(df: DataFrame, text: str) -> DataFrame:
    """Rows with a cell that holds the text, any case; NULL cells read as ``null``."""
    if not text:
        return df
    wanted = F.lit(text.lower())
    return df.filter(
        any_of([F.contains(F.lower(cell_text(F.col(f.name), f.dataType)), wanted) for f in df.schema.fields])
    )


def sort_key(df: DataFrame, col: str) -> Column:
    """Numbers as numbers; anything else as lower-case text in locale order, NULL as ``null``."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.NumericType):
        return F.col(col)
    return F.collate(F.lower(cell_text(F.col(col), dtype)), "UNICODE")


def sort_rows(df: DataFrame, col: str, direction: str = "asc", tie: Sequence[str] = ()) -> DataFrame:
    key = sort_key(df, col)
    return df.orderBy(key.desc() if direction == "desc" else key.asc(), *tie)


def toggled_direction(column: str, current: str | None, direction: str) -> str:
    """A second click on the same column turns the direction; another column starts ascending."""
    return "desc" if column == current and direction == "asc" else "asc"


def format_cells(df: DataFrame) -> DataFrame:
    """Every cell as the text of a result table."""
    fields = df.schema.fields
    scaled = {f"_scaled_{f.name}": scaled_hundredths(F.col(f.name)) for f in fields if is_double(f.dataType)}
    staged = df.withColumns(scaled)  # made once per row, used several times below
    return staged.select(
        *[display_text(F.col(f.name), f.dataType, F.col(f"_scaled_{f.name}") if is_double(f.dataType) else None).alias(f.name) for f in fields]
    )


def iso_datetimes(df: DataFrame) -> DataFrame:
    """Date-time columns as ISO text; NULL and all other columns unchanged."""
    timed = (T.TimestampType, T.TimestampNTZType)
    return df.select(
        *[
            iso_text(F.col(f.name)).alias(f.name) if isinstance(f.dataType, timed) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def audit_sql(df: DataFrame, col: str, rule: str) -> DataFrame:
    """Flag each logged statement, name the first hit and add the normalised text."""
    return (
        df.withColumn("_text", prepared(F.col(col), rule))
        .withColumns({"rule": F.lit(rule), "hit": first_hit(F.col(col), rule, F.col("_text"))})
        .withColumns({"rejected": F.col("hit").isNotNull(), "clean_sql": normalised(F.col(col))})
        .drop("_text")
    )


def audit_summary(df: DataFrame, col: str, rules: Sequence[str]) -> DataFrame:
    """Statements per rule and first hit: one pass, all rules at once.

    Statements are counted by their combination of hits first, so the rows
    that are spread over the rules are few.
    """
    texts = df.select(F.col(col), *[prepared(F.col(col), r).alias(f"_{r}") for r in rules])
    hits = texts.select(*[first_hit(F.col(col), r, F.col(f"_{r}")).alias(r) for r in rules])
    combined = hits.groupBy(*rules).agg(F.count(F.lit(1)).alias("n"))
    verdicts = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("hit"), "n") for r in rules])
    return combined.select(F.inline(verdicts)).groupBy("rule", "hit").agg(F.sum("n").alias("n"))


# -- business queries ---------------------------------------------------------


def since_latest(df: DataFrame, ts: str, days: int) -> DataFrame:
    """Rows of the last ``days`` days before the table's own newest day.

    The bound is a one-row subquery over a single column; the filter on it is
    pushed to the scan.
    """
    newest = df.agg(F.date_sub(F.max(ts).cast("date"), days).cast(df.schema[ts].dataType).alias("bound"))
    return df.filter(F.col(ts) >= newest.scalar())


def daily_order_stats(orders: DataFrame, days: int = 30, ts: str = "o_orderdate", amount: str = "o_totalprice") -> DataFrame:
    return (
        since_latest(orders, ts, days)
        .groupBy(F.to_date(ts).alias("day"))
        .agg(F.count(F.lit(1)).alias("order_count"), F.sum(money(F.col(amount))).alias("total_sales"))
        .orderBy(F.desc("day"))
    )


def daily_active_users(
    df: DataFrame, days: int = 30, ts: str = "ts", user: str = "user_id", approximate: bool = False
) -> DataFrame:
    """Distinct users per day. Exact counts first reduce to (day, user), so a busy user is one row."""
    count = F.approx_count_distinct(user) if approximate else F.count_distinct(F.col(user))
    return (
        since_latest(df, ts, days)
        .groupBy(F.to_date(ts).alias("day"))
        .agg(count.alias("active_users"))
        .orderBy(F.desc("day"))
    )


def top_products(
    lineitem: DataFrame, part: DataFrame, n: int = 10, month: str | None = None
) -> DataFrame:
    """A month's best sellers (``yyyy-MM``; the newest month by default).

    Quantities are summed per part before the join, so the join sees one row per part.
    """
    first_day = (
        F.lit(f"{month}-01").cast("timestamp_ntz")
        if month
        else lineitem.agg(F.trunc(F.max("l_shipdate").cast("date"), "MM").cast("timestamp_ntz")).scalar()
    )
    bound = lineitem.filter(F.col("l_shipdate") >= first_day)
    if month:
        bound = bound.filter(F.col("l_shipdate") < F.add_months(F.lit(f"{month}-01"), 1).cast("timestamp_ntz"))
    sold = bound.groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("quantity"))
    return (
        sold.join(part.select("p_partkey", "p_name"), sold.l_partkey == F.col("p_partkey"))
        .select("p_partkey", "p_name", "quantity")
        .orderBy(F.desc("quantity"), "p_partkey")
        .limit(n)
    )


def monthly_sales(orders: DataFrame, ts: str = "o_orderdate", amount: str = "o_totalprice") -> DataFrame:
    return (
        orders.groupBy(F.date_format(ts, "yyyy-MM").alias("month"))
        .agg(F.sum(money(F.col(amount))).alias("sales_amount"))
        .orderBy("month")
    )


def recent_rows(df: DataFrame, ts: str, order: Order, days: int = 30, n: int = 10) -> DataFrame:
    """First rows, in the given order, of the last ``days`` days before the newest row."""
    bound = df.agg((F.max(ts) - F.make_dt_interval(F.lit(days))).alias("bound")).scalar()
    return df.filter(F.col(ts) >= bound).orderBy(*order).limit(n)


# -- what a role may see ------------------------------------------------------


def mask_columns(
    df: DataFrame,
    spec: Mapping[str, str],
    enabled: bool = True,
    key: Column | None = None,
    replacement: str = "***",
) -> DataFrame:
    """Apply a masking kind per column: mask, hash, encrypt, replace or none."""
    if not enabled:
        return df

    def masked(name: str) -> Column:
        kind, text = spec.get(name, "none"), F.col(name).cast("string")
        if kind == "none":
            return F.col(name)
        if kind == "mask":
            return mask_middle(text)
        if kind == "hash":
            return F.sha2(text, 256)
        if kind == "replace":
            return F.when(F.col(name).isNotNull(), F.lit(replacement))
        if kind == "encrypt":
            if key is None:
                raise ValueError("encrypting needs a key column")
            return F.base64(F.aes_encrypt(text, key))
        raise ValueError(f"unknown masking kind {kind}")

    return df.select(*[masked(c).alias(c) for c in df.columns])


def row_filter(df: DataFrame, grants: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Only rows whose key is granted. Duplicated grants do not repeat rows."""
    names = [key] if isinstance(key, str) else list(key)
    return df.join(keys_of(grants, *names), names, "left_semi").select(*df.columns)


def column_filter(df: DataFrame, allowed: Sequence[str], keep_shape: bool = False) -> DataFrame:
    """Only allowed columns; with ``keep_shape`` the others stay as typed NULLs."""
    visible = set(allowed)
    if not keep_shape:
        return df.select(*[c for c in df.columns if c in visible])
    return df.select(
        *[F.col(f.name) if f.name in visible else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]
    )


def query_route(df: DataFrame, question: str, routes: Sequence[tuple[str, str]] = fixed.ROUTES) -> DataFrame:
    """Name the query a question goes to; the first key word found decides."""
    hits = [F.when(F.contains(F.col(question), F.lit(word)), F.lit(route)) for word, route in routes]
    return df.withColumn("route", F.coalesce(*hits, F.lit(fixed.ROUTE_OTHER)))


# --- text search through a trigram posting index ---

#: Folders of the index by a hash of the gram; a search reads only the folders of its grams.
GRAM_BUCKETS = 64

#: Rows whose grams one task of the build takes, about; a bucket's postings are cut for every 16 times as many rows.
POSTING_ROWS = 10_000


def _grams(text: Column) -> Column:
    """Distinct runs of three code points of a text."""
    return F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.char_length(text) - 2), lambda i: F.substring(text, i, 3))
    )


def build_text_index(df: DataFrame, key: str, path: str) -> DataFrame:
    """Postings (bucket, gram, key) of every cell's lower-case text as ``search_rows`` reads it.

    Written once to ``path``, partitioned by ``bucket``. Cells shorter than
    three characters make no gram; every row stays findable by the scan of
    :func:`indexed_search` for short texts.
    """
    cells = [F.lower(cell_text(F.col(f.name), f.dataType)) for f in df.schema.fields]
    grams = F.array_distinct(F.flatten(F.array(*[F.when(F.char_length(c) >= 3, _grams(c)).otherwise(F.array()) for c in cells])))
    rows = df.count()
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // POSTING_ROWS))
    # rows are dealt before they are cut, so that no task holds the grams of a whole file
    postings = df.repartition(parts).select(F.col(key).alias("key"), F.explode(grams).alias("gram"))
    postings = postings.repartition(parts, "key", "gram").distinct()
    postings = postings.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(GRAM_BUCKETS)).cast("int"))
    # a bucket of common grams is cut by key
    cut = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-rows // (16 * POSTING_ROWS)))))
    postings.repartition(parts, "bucket", cut).write.mode("overwrite").partitionBy("bucket").parquet(path)
    return df.sparkSession.read.parquet(path)


def indexed_search(df: DataFrame, index: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of :func:`search_rows`, found through the posting index.

    The text's grams pick their folders and postings; a row that holds every
    gram is a candidate, and the literal test of ``search_rows`` on the
    candidates decides. Texts of fewer than three characters (after lower
    case) have no gram and are answered by the scan itself.
    """
    if not text:
        return df
    spark = df.sparkSession
    lowered = spark.range(1).select(F.lower(F.lit(text)).alias("t")).first()["t"]
    if len(lowered) < 3:
        return search_rows(df, text)
    wanted = sorted({lowered[i : i + 3] for i in range(len(lowered) - 2)})
    buckets = [r["b"] for r in spark.createDataFrame([(g,) for g in wanted], "g string").select(
        F.pmod(F.xxhash64("g"), F.lit(GRAM_BUCKETS)).cast("int").alias("b")).distinct().collect()]
    hits = index.filter(F.col("bucket").isin(buckets) & F.col("gram").isin(wanted))
    keys = hits.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted)).select(F.col("key").alias(key))
    return search_rows(df.join(keys, key, "left_semi"), text)


# --- rolling distinct users ---

#: log2 of the registers of a day's sketch: relative standard error about 1.04 / sqrt(2^12) = 1.6 %.
SKETCH_BITS = 12


def day_sketches(df: DataFrame, ts: str = "ts", user: str = "user_id") -> DataFrame:
    """One mergeable distinct-count sketch of users per day, from one scan; store it and roll it later."""
    return df.filter(F.col(user).isNotNull() & F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(
        F.hll_sketch_agg(F.col(user).cast("long"), SKETCH_BITS).alias("sketch")
    )


def rolling_active_users(sketches: DataFrame, spans: Sequence[int] = (7, 30)) -> DataFrame:
    """Distinct users of the last 7 and 30 days (or ``spans``) up to every day, by unions of day sketches.

    The window runs over one row per day, so it holds days, never users.
    Days without activity hold no row; frames are ranges of days, so gaps
    are counted right.
    """
    order = W.orderBy(F.unix_date("day"))
    out = sketches
    for n in spans:
        frame = order.rangeBetween(-(n - 1), 0)
        out = out.withColumn(f"users_{n}d", F.hll_sketch_estimate(F.hll_union_agg("sketch", True).over(frame)))
    return out.drop("sketch")


def rolling_active_users_exact(df: DataFrame, spans: Sequence[int] = (7, 30), ts: str = "ts", user: str = "user_id") -> DataFrame:
    """The exact counts: each distinct (user, day) counts for the days it reaches; distinct users per day.

    Only days with activity are reported, as in :func:`rolling_active_users`.
    """
    days = df.filter(F.col(user).isNotNull() & F.col(ts).isNotNull()).select(F.col(user).alias("u"), F.to_date(ts).alias("seen")).distinct()
    active = days.select(F.col("seen").alias("day")).distinct()
    out = active
    for n in spans:
        reach = days.select("u", F.explode(F.sequence(F.col("seen"), F.date_add("seen", n - 1))).alias("day"))
        counted = reach.groupBy("day").agg(F.count_distinct("u").alias(f"users_{n}d"))
        out = out.join(counted, "day", "left")
    return out
