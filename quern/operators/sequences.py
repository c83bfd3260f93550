"""Ordered work inside groups, any of which may be very large.

A plain window puts a whole group into one task. Here every group is cut into
buckets that follow its order (hours, for example), whatever its size: one
aggregate per bucket, made in the map tasks first, a window over these bucket
rows, and a window inside each bucket. What a bucket takes over from the
earlier ones stands in a row in front of it. The plan is the same for all
groups: two scans, no counting, nothing broadcast.

``bucket`` may name several columns, each further along the order, so that a
bucket with very many rows (all at one instant, say) is cut again by the next.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from quern.session import ship_package

Names = Sequence[str]


def _with_front_rows(
    rows: DataFrame, keys: Names, bucket: Names, state: Mapping[str, Column], earlier: Mapping[str, Column]
) -> DataFrame:
    """Put one row in front of each bucket, holding what it takes over.

    ``state`` aggregates a bucket, ``earlier`` turns the states of the buckets
    before into the row's values.
    """
    per_bucket = rows.groupBy(*keys, *bucket).agg(*[c.alias(n) for n, c in state.items()])
    front = per_bucket.select(*keys, *bucket, *[c.alias(n) for n, c in earlier.items()], F.lit(False).alias("_real"))
    return rows.withColumn("_real", F.lit(True)).unionByName(front, allowMissingColumns=True)


def _windows(keys: Names, bucket: Names):
    groups = W.partitionBy(*keys).orderBy(*bucket)
    return groups, groups.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*keys, *bucket)


def _finish(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.filter("_real").select(*names)


def previous_row(
    df: DataFrame, keys: Names, bucket: Names, order: Names, values: Names, out: str = "previous"
) -> DataFrame:
    """A struct of ``values`` from the row before in the group's order, NULL for the first.

    ``bucket`` columns must never go down along ``order``.
    """
    groups, _, inside = _windows(keys, bucket)
    rows = df.withColumn("_held", F.struct(*values))
    whole = _with_front_rows(
        rows, keys, bucket, {"_held": F.max_by("_held", F.struct(*order))}, {"_held": F.lag("_held").over(groups)}
    )
    before = F.lag("_held").over(inside.orderBy("_real", *order))
    return _finish(whole.withColumn(out, before), [*df.columns, out])


def running_totals(
    df: DataFrame, keys: Names, bucket: Names, order: Names, values: Mapping[str, Column]
) -> DataFrame:
    """Sums of ``values`` from the group's first row to this one, several in one pass."""
    _, earlier, inside = _windows(keys, bucket)
    parts = {f"_part_{out}": value for out, value in values.items()}
    whole = _with_front_rows(
        df.withColumns(parts), keys, bucket, {n: F.sum(n) for n in parts}, {n: F.sum(n).over(earlier) for n in parts}
    )
    near = inside.orderBy("_real", *order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return _finish(whole.withColumns({out: F.sum(f"_part_{out}").over(near) for out in values}), [*df.columns, *values])


def latest_before(
    df: DataFrame, keys: Names, bucket: Names, ts: str, is_source: Column, values: Names, out: str = "latest"
) -> DataFrame:
    """As-of join of a table with marked rows of itself: the newest source row strictly earlier in time.

    Source rows of the same instant are told apart by ``values``. ``bucket``
    columns have to follow from ``ts``.
    """
    _, earlier, inside = _windows(keys, bucket)
    rows = df.withColumn("_source", F.when(is_source, F.struct(F.col(ts).alias("ts"), *values)))
    whole = _with_front_rows(rows, keys, bucket, {"_source": F.max("_source")}, {"_source": F.max("_source").over(earlier)})
    instant = F.unix_micros(F.when(F.col("_real"), F.col(ts)).otherwise(F.col("_source.ts")).cast("timestamp"))
    near = inside.orderBy("_at").rangeBetween(W.unboundedPreceding, -1)
    found = whole.withColumn("_at", instant).withColumn(out, F.max("_source").over(near))
    return _finish(found, [*df.columns, out])


def range_join(
    points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float, how: str = "inner"
) -> DataFrame:
    """Rows of ``points`` with ``low <= point < high``, as an equi-join on cells of the given width.

    A range is copied once per cell it touches, so the width should be near the
    usual length of a range; no pairs outside a cell are made.
    """
    cells = ranges.withColumn(
        "_cell",
        F.explode(F.sequence(F.floor(F.col(low) / width).cast("long"), F.floor(F.col(high) / width).cast("long"))),
    )
    placed = points.withColumn("_cell", F.floor(F.col(point) / width).cast("long"))
    inside = (F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))
    return placed.alias("p").join(cells.alias("r"), (F.col("p._cell") == F.col("r._cell")) & inside, how).drop("_cell")


#: Start rows of one cell that one task of an interval join takes at most.
CELL_ROWS = 50_000


def interval_join(
    left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], base: float = 1.0,
    totals: tuple[Names, str] | None = None,
) -> DataFrame:
    """Pairs of rows whose intervals overlap: ``l.start < r.end AND r.start < l.end``, each pair once.

    Every interval of positive length gets a level, the smallest ``L`` with
    ``base * 2^L`` at least its length, and is copied to the at most three
    cells of that width it touches ("covers"). Of two overlapping intervals,
    the one with the later start has that start inside the other, so each
    pair is made in one cell only: the other side's start, placed at every
    level in use, meets the covers of the interval that started first (left
    first on equal starts). No interval is copied for its length.

    A cell that many starts fall into (a hot instant, or a cell of a very
    long interval) is cut into salts of at most ``CELL_ROWS`` starts, and the
    covers of that cell are copied to each salt; so no cell lands in one task.

    Rows with a null start or end, and intervals whose end does not lie after
    the start, never cover; a null bound makes the predicate unknown, so such
    rows meet nothing (as in SQL). Both sides keep all their columns; names
    they share come out as they would from ``left.join(right)``.

    The pairs of dense intervals grow with the square of the rows. With
    ``totals``, columns of the left side and a whole-number column of the
    right side, the result is what these columns' groups of the pairs give:
    ``n``, the pairs, and ``first``, the least value. No pair is made for it
    (see :func:`_overlap_totals`); the bounds have to be whole numbers.
    """
    if totals:
        return _overlap_totals(left, right, left_span, right_span, base, *totals)
    first = _covered_starts(left, right, *left_span, *right_span, base, True)
    second = _covered_starts(right, left, *right_span, *left_span, base, False)
    return first.union(second)


def _side_names(df: DataFrame, side: str) -> list[Column]:
    return [F.col(f"{side}.{c}") for c in df.columns]


def _covered_starts(
    cover: DataFrame, start: DataFrame, cs: str, ce: str, ss: str, se: str, base: float, cover_first: bool
) -> DataFrame:
    """Pairs whose later start is the ``start`` side's, lying inside a ``cover`` interval."""
    length = F.col(ce) - F.col(cs)
    level = F.greatest(F.lit(0), F.ceil(F.log2(length / F.lit(base)))).cast("int")
    covers = cover.filter(F.col(cs).isNotNull() & F.col(ce).isNotNull() & (length > 0)).withColumn("_level", level)
    levels = sorted(r[0] for r in covers.select("_level").distinct().collect())  # at most some tens of levels
    order = (cover, "_c", start, "_s") if cover_first else (start, "_s", cover, "_c")
    if not levels:  # nothing covers: no pairs
        fields = [*order[0].schema.fields, *order[2].schema.fields]
        return cover.sparkSession.createDataFrame([], T.StructType(fields))
    width = F.lit(base) * F.pow(F.lit(2.0), F.col("_level"))
    covers = covers.withColumn(
        "_cell", F.explode(F.sequence(F.floor(F.col(cs) / width), F.floor(F.col(ce) / width)))
    )
    placed = F.array(*[F.struct(F.lit(v).alias("l"), F.floor(F.col(ss) / (base * 2.0**v)).alias("c")) for v in levels])
    starts = start.filter(F.col(ss).isNotNull() & F.col(se).isNotNull()).withColumn("_at", F.explode(placed))
    starts = starts.select("*", F.col("_at.l").alias("_level"), F.col("_at.c").alias("_cell")).drop("_at")
    starts = starts.withColumn("_row", F.xxhash64(*[F.col(c) for c in start.columns], F.monotonically_increasing_id()))
    # cells with many starts are cut into salts; covers go to every salt of their cell
    crowd = starts.groupBy("_level", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    crowd = crowd.filter(F.col("_n") > CELL_ROWS).select("_level", "_cell", F.ceil(F.col("_n") / CELL_ROWS).cast("int").alias("_salts"))
    starts = starts.join(crowd, ["_level", "_cell"], "left").withColumn(
        "_salt", F.pmod(F.col("_row"), F.coalesce("_salts", F.lit(1))).cast("int")
    )
    covers = covers.join(crowd, ["_level", "_cell"], "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    )
    c, s = covers.alias("_c"), starts.alias("_s")
    later = (F.col(f"_c.{cs}") <= F.col(f"_s.{ss}")) if cover_first else (F.col(f"_c.{cs}") < F.col(f"_s.{ss}"))
    overlap = (F.col(f"_s.{ss}") < F.col(f"_c.{ce}")) & (F.col(f"_c.{cs}") < F.col(f"_s.{se}"))
    on = [F.col(f"_c.{k}") == F.col(f"_s.{k}") for k in ("_level", "_cell", "_salt")]
    joined = c.join(s, on[0] & on[1] & on[2] & later & overlap)
    return joined.select(*_side_names(order[0], order[1]), *_side_names(order[2], order[3]))


#: Stands for "no value" where least values are taken.
_NONE = np.iinfo("int64").max


def _least_table(values: np.ndarray) -> list[np.ndarray]:
    """Least values of all runs of 1, 2, 4, ... neighbours."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    return table


def _log2(n: np.ndarray) -> np.ndarray:
    return np.frexp(n.astype("float64"))[1] - 1


def _least_between(table: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of ``values[low:high]`` for many ranges, by two runs each."""
    out = np.full(len(low), _NONE)
    k = np.where(high > low, _log2(np.maximum(high - low, 1)), -1)
    for level in np.unique(k[k >= 0]):
        at = k == level
        out[at] = np.minimum(table[level][low[at]], table[level][high[at] - (1 << level)])
    return out


def _least_of_covers(size: int, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Per slot the least value of the ranges ``low:high`` (none empty) that hold it."""
    k = _log2(high - low)
    carried = np.full(size, _NONE)
    for level in range(int(k.max(initial=0)), -1, -1):
        at = k == level
        np.minimum.at(carried, low[at], value[at])
        np.minimum.at(carried, high[at] - (1 << level), value[at])
        if level:  # a run of 2^level slots hands its value to its two halves
            half = 1 << (level - 1)
            halves = carried.copy()
            np.minimum(halves[half:], carried[:-half], out=halves[half:])
            carried = halves
    return carried


def _range_pieces(cuts: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Stretches that hold the first and the last point of each range that is not empty."""
    return np.searchsorted(cuts, low, "right"), np.searchsorted(cuts, high - 1, "right")


def _overlap_totals(
    left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], base: float, keys: Names, value: str
) -> DataFrame:
    """Per group of left rows the number of overlapping right rows and their least ``value``, without pairs.

    A right row overlaps a left one if it starts inside it, or covers its
    start from before. The line is cut into stretches of about ``CELL_ROWS``
    bounds (quantiles). A range is a piece of its first stretch, a piece of
    its last one and whole stretches between; the whole ones are answered from
    one row per stretch, pieces in their stretch by sorted arrays. Left rows
    make two pieces at most, right rows three, equal right pieces are merged,
    and a stretch with many left pieces (a hot instant) is cut into salts.
    Right rows that end where they start lie strictly inside a left row;
    rows that end before they start are joined as pairs.
    """
    ship_package(left.sparkSession)
    (ls, le), (rs, re) = left_span, right_span
    l = left.select(*keys, F.col(ls).cast("long").alias("_s"), F.col(le).cast("long").alias("_e")).dropna(subset=["_s", "_e"])
    r = right.select(F.col(value).cast("long").alias("_v"), F.col(rs).cast("long").alias("_s"), F.col(re).cast("long").alias("_e")).dropna(subset=["_s", "_e"])
    bounds = l.select(F.explode(F.array("_s", "_e")).alias("t")).unionByName(r.select(F.explode(F.array("_s", "_e")).alias("t")))
    back = F.col("_e") < F.col("_s")
    (n_l, back_l), (n_r, back_r) = (d.agg(F.count(F.lit(1)), F.count_if(back)).first() for d in (l, r))
    parts = max(1, -(-2 * (n_l + n_r) // CELL_ROWS))
    shares = [k / parts for k in range(1, parts)]
    cuts = np.unique(np.array(bounds.approxQuantile("t", shares, 0.25 / parts) if shares else [], dtype="float64").astype("int64"))
    size = len(cuts) + 1

    def right_pieces(batches):
        for batch in batches:
            v, s, e = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_v", "_s", "_e"))
            if batch.column("_v").null_count:
                v = batch.column("_v").fill_null(_NONE).to_numpy(zero_copy_only=False)
            rows = []  # stretch, kind, low, high, n, least

            def add(stretch, kind, low, high, v, n=1):
                rows.append([stretch, np.full(len(v), kind), low, high, np.full(len(v), n), v])

            starts = np.searchsorted(cuts, s, "right")
            for kind, at in ((0, e > s), (1, e == s)):
                add(starts[at], kind, s[at], s[at], v[at])
            at = e > s + 1
            low, high, w = s[at] + 1, e[at], v[at]
            a, b = _range_pieces(cuts, low, high)
            one = a == b
            add(a[one], 2, low[one], high[one], w[one])
            two = ~one
            a, b, low, high, w = a[two], b[two], low[two], high[two], w[two]
            add(a, 2, low, cuts[a], w)
            add(b, 2, cuts[b - 1], high, w)
            whole = b > a + 1
            a, b, w = a[whole] + 1, b[whole], w[whole]
            k = _log2(np.maximum(b - a, 1))
            none = np.full(len(w), _NONE)
            add(a, 3, k, k, w, 0)
            add(b - (1 << k), 3, k, k, w, 0)
            add(a, 4, a, a, none)
            add(b, 4, b, b, none, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c).astype("int64")) for c in zip(*rows)], names=["part", "kind", "low", "high", "n", "least"]
            )

    pieces = (
        r.filter(~back).mapInArrow(right_pieces, "part long, kind long, low long, high long, n long, least long")
        .groupBy("part", "kind", "low", "high").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    )
    # one row per stretch and kind of start; whole covers as runs of 2^low stretches and as steps of their number
    known = pieces.filter("kind <> 2").withColumn("level", F.when(F.col("kind") == 3, F.col("low")).otherwise(0))
    known = known.groupBy("part", "kind", "level").agg(F.sum("n").alias("n"), F.min("least").alias("least")).toPandas()
    inside = []  # starts and empty rows: pieces before each stretch, least values
    for kind in (0, 1):
        n, least, of = np.zeros(size + 1, "int64"), np.full(size, _NONE), known[known["kind"] == kind]
        n[of["part"].to_numpy() + 1], least[of["part"].to_numpy()] = of["n"], of["least"]
        inside.append((np.cumsum(n), _least_table(least)))
    steps, runs = known[known["kind"] == 4], known[known["kind"] == 3]
    over_n = np.zeros(size + 1, "int64")
    np.add.at(over_n, steps["part"].to_numpy(), steps["n"].to_numpy())
    over_n, at = np.cumsum(over_n), runs["part"].to_numpy()
    over_least = _least_of_covers(size, at, at + (1 << runs["level"].to_numpy()), runs["least"].to_numpy())

    def left_pieces(batches):
        for batch in batches:
            s, e = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_s", "_e"))
            a, b = _range_pieces(cuts, s, np.maximum(e, s + 1))
            two = np.flatnonzero(b > a)
            high = e.copy()
            high[two] = cuts[a[two]]
            rows = np.append(np.arange(len(s)), two)
            numbers = [np.append(a, b[two]), np.append(s, cuts[b[two] - 1]), np.append(high, e[two]), np.append(b, np.full(len(two), -1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pa.array(rows)) for c in key_names] + [pa.array(x.astype("int64")) for x in numbers],
                names=[*key_names, "part", "low", "high", "until"],
            )

    key_names = [f"_k{i}" for i in range(len(keys))]
    kinds = [T.StructField(name, l.schema[key].dataType) for name, key in zip(key_names, keys)]
    longs = lambda *names: [T.StructField(name, T.LongType()) for name in names]
    asked = l.filter(~back).select(*[F.col(k).alias(n) for n, k in zip(key_names, keys)], "_s", "_e").mapInArrow(
        left_pieces, T.StructType([*kinds, *longs("part", "low", "high", "until")])
    )
    crowds = asked.groupBy("part").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > 4 * CELL_ROWS)
    crowds = crowds.select("part", F.ceil(F.col("c") / (4 * CELL_ROWS)).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    asked = asked.join(F.broadcast(crowds), "part", "left").withColumn("salt", F.floor(F.rand(1) * salts).cast("int")).drop("salts")
    held = pieces.filter("kind <= 2").join(F.broadcast(crowds), "part", "left")
    held = held.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")

    def answer(key, ask: pa.Table, have: pa.Table) -> pa.Table:
        part, low, high, until = (ask.column(c).to_numpy() for c in ("part", "low", "high", "until"))
        kind, p_low, p_high, p_n, p_least = (have.column(c).to_numpy() for c in ("kind", "low", "high", "n", "least"))
        n, least, first = np.zeros(len(low), "int64"), np.full(len(low), _NONE), until >= 0
        for k in (0, 1):
            at = np.flatnonzero(kind == k)
            at = at[np.argsort(p_low[at])]
            before, table = np.append(0, np.cumsum(p_n[at])), _least_table(p_least[at])
            i = np.searchsorted(p_low[at], low + (first if k else 0), "left")  # an empty row at the left one's start is not inside
            j = np.maximum(np.searchsorted(p_low[at], high, "left"), i)
            n += before[j] - before[i]
            least = np.minimum(least, _least_between(table, i, j))
            n_before, whole = inside[k]  # the stretches between
            i, j = np.where(first, part + 1, 0), np.where(first, np.maximum(until, part + 1), 0)
            n += n_before[j] - n_before[i]
            least = np.minimum(least, _least_between(whole, i, j))
        # covers of the left row's start: of the whole stretch, and pieces
        least[first] = np.minimum(least[first], over_least[part[first]])
        n[first] += over_n[part[first]]
        at = kind == 2
        if at.any() and first.any():
            slots = np.unique(np.append(p_low[at], p_high[at]))
            i, j = np.searchsorted(slots, p_low[at]), np.searchsorted(slots, p_high[at])
            number = np.zeros(len(slots), "int64")
            np.add.at(number, i, p_n[at])
            np.add.at(number, j, -p_n[at])
            number, lowest = np.cumsum(number), _least_of_covers(len(slots), i, j, p_least[at])
            slot = np.searchsorted(slots, low[first], "right") - 1
            n[first] += np.where(slot >= 0, number[slot], 0)
            least[first] = np.minimum(least[first], np.where(slot >= 0, lowest[slot], _NONE))
        met = np.flatnonzero(n)
        columns = [ask.column(c).take(pa.array(met)) for c in key_names]
        return pa.table([*columns, pa.array(n[met]), pa.array(least[met], mask=least[met] == _NONE)], names=[*key_names, "n", "least"])

    found = asked.groupBy("part", "salt").cogroup(held.groupBy("part", "salt")).applyInArrow(
        answer, T.StructType([*kinds, *longs("n", "least")])
    )
    found = found.select(*[F.col(n).alias(k) for n, k in zip(key_names, keys)], "n", "least")
    if back_l or back_r:
        turned = lambda df, span: F.col(span[1]) < F.col(span[0])
        pairs = interval_join(left.filter(turned(left, left_span)), right, left_span, right_span, base).union(
            interval_join(left.filter(~turned(left, left_span)), right.filter(turned(right, right_span)), left_span, right_span, base)
        )
        names = [f"_{i}" for i in range(len(pairs.columns))]
        at = [names[left.columns.index(k)] for k in keys]
        pairs = pairs.toDF(*names).select(
            *[F.col(n).alias(k) for n, k in zip(at, keys)], F.lit(1).cast("long").alias("n"),
            F.col(names[len(left.columns) + right.columns.index(value)]).cast("long").alias("least"),
        )
        found = found.unionByName(pairs)
    return found.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("least").alias("first"))
