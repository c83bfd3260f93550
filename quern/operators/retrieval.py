"""Nearest stored items by cosine similarity, and replacing documents by id."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quern.functions.keys import keys_of
from quern.session import ship_package

# questions and items of one score matrix
QUESTIONS = 512
ITEMS = 8192
# rows, and numbers in their vectors, of a block of questions and of a chunk of items
BLOCK_ROWS = 8192
BLOCK_NUMBERS = 4_000_000


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column of one width as rows of unit length, in double; zero vectors stay zero."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    norm = np.linalg.norm(flat, axis=1, keepdims=True)
    return np.divide(flat, norm, out=np.zeros_like(flat), where=norm > 0)


def _top(questions: np.ndarray, items: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and similarities of each question's k best items; equal ones by position.

    Similarities are whole millionths, so ties do not hang on the order of
    summation; position and similarity make one number that is ranked at once.
    """
    best = np.empty((len(questions), 0), np.int64)
    n = len(items)
    for a in range(0, n, ITEMS):
        score = np.rint(questions @ items[a : a + ITEMS].T * 1e6).astype(np.int64)
        ranked = score * n + (n - 1 - np.arange(a, a + score.shape[1]))
        both = np.concatenate([best, ranked], axis=1)
        best = np.partition(both, both.shape[1] - k, axis=1)[:, -k:] if both.shape[1] > k else both
    return n - 1 - best % n, np.floor_divide(best, n) / 1e6


def unusable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows with ``usable``: false for vectors that are NULL, empty or hold a NULL, NaN or infinite number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(vector) > 0)
    return df.withColumn("usable", F.coalesce(fine, F.lit(False)))


def _ready(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Keys and vectors that can be compared, with their width."""
    kept = unusable(df, vector).filter(F.col("usable") & F.col(key).isNotNull())
    return kept.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), F.size(vector).alias("width"))


def _parts() -> Column:
    """Number of parts of bounded size that the rows of a width make."""
    n = F.count(F.lit(1))
    return F.ceil(F.greatest(n / F.lit(BLOCK_ROWS), n * F.first("width") / F.lit(BLOCK_NUMBERS))).cast("long")


def similar_items(
    queries: DataFrame,
    items: DataFrame,
    k: int = 5,
    query_id: str = "query_id",
    item_id: str = "item_id",
    vector: str = "embedding",
) -> DataFrame:
    """The k most similar items per query, with similarity and rank.

    Questions are dealt into blocks of a bounded size and items into chunks of
    a bounded size, at least as many as the session has shuffle partitions. Each
    block meets each chunk in a task of its own, which returns k candidates per
    question, so no pair rows exist and no task holds a whole side. Vectors of
    different width are never compared, and vectors that :func:`unusable`
    marks are left out.
    """
    ship_package(items.sparkSession)
    least = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored, wanted = _ready(items, item_id, vector), _ready(queries, query_id, vector)
    # one row per width of vectors
    sizes = F.broadcast(
        wanted.groupBy("width").agg(_parts().alias("blocks"))
        .join(stored.groupBy("width").agg(F.greatest(_parts(), F.lit(least).cast("long")).alias("chunks")), "width")
    )
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    stored = stored.join(sizes, "width").withColumn("chunk", dealt("chunks")).withColumn("block", every("blocks"))
    wanted = wanted.join(sizes, "width").withColumn("block", dealt("blocks")).withColumn("chunk", every("chunks"))
    columns = ("id", "vector", "width", "block", "chunk")
    met = wanted.select(*columns).groupBy("block", "chunk", "width").cogroup(stored.select(*columns).groupBy("block", "chunk", "width"))
    found = met.applyInArrow(
        lambda asked, given: _search(asked, given, k), "query_id long, item_id long, similarity double"
    )
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("query_id").alias(query_id), F.col("item_id").alias(item_id), "similarity", "rank")


_FOUND = pa.schema([("query_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64())])


def _search(asked: pa.Table, given: pa.Table, k: int) -> pa.Table:
    if not asked.num_rows or not given.num_rows:
        return _FOUND.empty_table()
    given = given.sort_by("id")
    width = given.column("width")[0].as_py()
    ids, items = given.column("id").to_numpy(), _matrix(given.column("vector"), width)
    parts = []
    for a in range(0, asked.num_rows, QUESTIONS):
        some = asked.slice(a, QUESTIONS)
        at, score = _top(_matrix(some.column("vector"), width), items, k)
        names = np.repeat(some.column("id").to_numpy(), at.shape[1])
        parts.append(pa.table([names, ids[at.ravel()], score.ravel()], schema=_FOUND))
    return pa.concat_tables(parts)


def similar_allowed(
    queries: DataFrame, items: DataFrame, allowed: DataFrame, k: int = 5, item_id: str = "item_id", **options: object
) -> DataFrame:
    """The same among permitted items only. The filter comes before the ranking, so k rows are found when k are permitted."""
    return similar_items(queries, items.join(keys_of(allowed, item_id), item_id, "left_semi"), k, item_id=item_id, **options)


def replace_documents(store: DataFrame, changed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Delete by id, then write the new versions; a change given twice is kept once per distinct row."""
    kept = store.join(keys_of(changed, key), key, "left_anti").select(*store.columns)
    return kept.unionByName(changed.select(*store.columns))


# --- inverted-file index: coarse centres, every row in the list of its nearest centre ---

#: Rows that the coarse centres are fitted on, at most (a documented, bounded sample).
FIT_ROWS = 20_000
#: Rounds of k-means on that sample.
FIT_ROUNDS = 12
#: Lists probed per question unless calibrated.
PROBES = 8
#: Questions that the number of probes is calibrated on, at most, and the recall it has to reach there.
CALIBRATION_ROWS = 200
CALIBRATION_RECALL = 0.95


def fit_centres(items: DataFrame, lists: int | None = None, vector: str = "embedding", seed: int = 7) -> np.ndarray:
    """Unit centres of ``lists`` lists (default about the square root of the rows), fitted on at most FIT_ROWS rows.

    The sample is drawn by a seeded random number, so a rerun fits the same
    centres. Centres take the commonest width of vector; vectors of another
    width are not indexed (they are never compared with this width anyway).
    """
    usable = unusable(items, vector).filter("usable")
    widths = usable.groupBy(F.size(vector).alias("w")).count().orderBy(F.desc("count"), "w").first()
    if widths is None:
        return np.zeros((0, 0))
    usable = usable.filter(F.size(vector) == widths["w"])  # centres have one width; other widths are not indexed
    n = widths["count"]
    lists = lists or max(1, int(round(n**0.5)))
    share = min(1.0, FIT_ROWS / max(n, 1))
    sample = usable.filter(F.rand(seed) < share).select(vector).limit(FIT_ROWS)  # the bound is the feature here
    table = pa.Table.from_pylist([{"v": r[0]} for r in sample.collect()]) if n else None
    if table is None or not table.num_rows:
        return np.zeros((0, 0))
    width = len(table.column("v")[0].as_py())
    points = _matrix(table.column("v"), width)
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), size=min(lists, len(points)), replace=False)]
    for _ in range(FIT_ROUNDS):
        nearest = np.argmax(points @ centres.T, axis=1)
        for c in range(len(centres)):
            members = points[nearest == c]
            if len(members):
                total = members.sum(axis=0)
                norm = np.linalg.norm(total)
                centres[c] = total / norm if norm > 0 else centres[c]
    return centres


def _nearest_lists(centres: np.ndarray, probes: int, id_col: str, vector: str):
    """Per Arrow batch: each row's ``probes`` nearest lists (one for stored rows), ranked by similarity."""

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            width = centres.shape[1]
            fine = pc.equal(pc.list_value_length(table.column(vector)), width)
            table = table.filter(pc.fill_null(fine, False))
            if not table.num_rows:
                continue
            sims = _matrix(table.column(vector), width) @ centres.T
            take = min(probes, len(centres))
            best = np.argsort(-sims, axis=1, kind="stable")[:, :take]
            ids = np.repeat(table.column(id_col).to_numpy(zero_copy_only=False), take)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(best.ravel(), pa.int32())], ["id", "list"])

    return run


def build_ivf(items: DataFrame, path: str, centres: np.ndarray, item_id: str = "item_id", vector: str = "embedding") -> DataFrame:
    """Every usable row with the list of its nearest centre, written to ``path`` range-partitioned and sorted by list."""
    ship_package(items.sparkSession)
    ready = _ready(items, item_id, vector)
    placed = ready.select("id", "vector").mapInArrow(_nearest_lists(centres, 1, "id", "vector"), "id long, list int")
    rows = ready.join(placed, "id").select("list", "id", "vector", "width")
    rows.repartitionByRange("list").sortWithinPartitions("list", "id").write.mode("overwrite").parquet(path)
    return items.sparkSession.read.parquet(path)


def search_ivf(
    queries: DataFrame, index: DataFrame, centres: np.ndarray, k: int = 5, probes: int = PROBES,
    query_id: str = "query_id", item_id: str = "item_id", vector: str = "embedding",
) -> DataFrame:
    """The k most similar rows among the ``probes`` lists nearest to each question.

    A list is cut into chunks of bounded size; each question meets the chunks
    of its lists only, in tasks of one block of questions and one chunk, as in
    :func:`similar_items`. Only probed lists are read.
    """
    ship_package(queries.sparkSession)
    wanted = _ready(queries, query_id, vector)
    asked = wanted.select("id", "vector").mapInArrow(_nearest_lists(centres, probes, "id", "vector"), "id long, list int")
    asked = asked.join(wanted, "id")
    probed = [r[0] for r in asked.select("list").distinct().collect()]  # at most the number of lists
    stored = index.filter(F.col("list").isin(probed))
    sizes = stored.groupBy("list").agg(_parts().alias("chunks"))
    stored = stored.join(sizes, "list").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
    blocks = asked.groupBy("list").agg(_parts().alias("blocks"))
    asked = asked.join(blocks, "list").join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    stored = stored.join(blocks, "list").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    columns = ("id", "vector", "width", "list", "block", "chunk")
    met = asked.select(*columns).groupBy("list", "block", "chunk", "width").cogroup(
        stored.select(*columns).groupBy("list", "block", "chunk", "width")
    )
    found = met.applyInArrow(lambda a, g: _search(a, g, k), "query_id long, item_id long, similarity double")
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("query_id").alias(query_id), F.col("item_id").alias(item_id), "similarity", "rank")


def recall(found: DataFrame, exact: DataFrame, query_id: str = "query_id", item_id: str = "item_id") -> float:
    """Share of the exact answers that ``found`` holds."""
    hit = exact.join(found, [query_id, item_id], "left_semi").count()
    return hit / max(exact.count(), 1)


def calibrate_probes(
    items: DataFrame, index: DataFrame, centres: np.ndarray, k: int = 5, item_id: str = "item_id", vector: str = "embedding",
    seed: int = 11,
) -> int:
    """The smallest power of two of probes whose recall on a bounded sample of questions reaches CALIBRATION_RECALL.

    The questions are at most CALIBRATION_ROWS rows picked by a seeded random
    number; their exact answers come from :func:`similar_items` over all rows.
    """
    n = index.count()
    share = min(1.0, CALIBRATION_ROWS / max(n, 1))
    sample = items.filter(F.rand(seed) < share).limit(CALIBRATION_ROWS).withColumnRenamed(item_id, "query_id")
    exact = similar_items(sample, items, k, item_id=item_id, vector=vector)
    probes = 1
    while probes < len(centres):
        found = search_ivf(sample, index, centres, k, probes, item_id=item_id, vector=vector)
        if recall(found, exact, item_id=item_id) >= CALIBRATION_RECALL:
            return probes
        probes *= 2
    return len(centres)
