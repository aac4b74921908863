"""Compression of vectors to codes: each part of a vector becomes the number of an entry of that part's codebook.

Codebooks are learnt by Lloyd's rounds, as Hamerly runs them. With each part a row keeps the entry it is assigned to, an upper
bound of the distance to it and a lower bound of the distance to the second nearest. When entries move, the bounds move with
them; only where the upper bound isn't strictly below what keeps every other entry away are all entries scanned, in integers, of
equally near ones the first wins. Bounds are rounded away from each other, so a part that isn't scanned is where a scan
would have put it.

A round reads the table of rows from the shared folder and writes it anew, with the sums of each task's parts; the sums are added
up by Spark and only the codebooks reach the driver. The table of the round before then goes. A lost task or executor is a
task run again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.common import drop_path, joined_by_key, new_path, small_batches, stage

PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: A component becomes the integer below this many times itself.
SCALE = 4096
#: Rows whose distances are worked out at a time.
SCANNED_ROWS = 4096
#: Bounds are worked out in floating point; so much more than its error are they widened by.
SLACK = 2.0**-40

STATE = "vec_id long, label string, vector array<int>, codes binary, upper array<double>, lower array<double>, errors array<long>, sums array<long>, scanned long"
_LIST = pa.list_(pa.float64())


class Codebooks:
    """The entries of each part (parts x entries x width integers), how far each has moved and how far its nearest neighbour is."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        of = lambda a: np.sqrt((a.astype(np.float64) ** 2).sum(-1))
        self.moved = of(entries - before) * (1 + SLACK) if before is not None else np.zeros(entries.shape[:2])
        apart = of(entries[:, :, None] - entries[:, None])
        apart[:, np.arange(entries.shape[1]), np.arange(entries.shape[1])] = np.inf
        self.clear = apart.min(-1) / 2 * (1 - SLACK)  # nearer to an entry than this, and no other can be as near
        order = np.argsort(-self.moved, axis=1, kind="stable")
        self.farthest, rest = order[:, 0], np.take_along_axis(self.moved, order, 1)
        self.most, self.second = rest[:, 0], rest[:, 1] if rest.shape[1] > 1 else np.zeros(len(rest))


def scan(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry, of equally near ones the first, and the bounds: distance to it from above, to the second nearest from below."""
    near, upper, lower = np.zeros(len(parts), np.int64), np.zeros(len(parts)), np.full(len(parts), np.inf)
    for at in range(0, len(parts), SCANNED_ROWS):
        rows = slice(at, at + SCANNED_ROWS)
        d = ((parts[rows, None] - entries[None]) ** 2).sum(-1)
        near[rows] = d.argmin(1)
        if d.shape[1] > 1:
            two = np.partition(d, 1, axis=1)
            lower[rows] = np.sqrt(two[:, 1].astype(np.float64)) * (1 - SLACK)
        upper[rows] = np.sqrt(d.min(1).astype(np.float64)) * (1 + SLACK)
    return near, upper, lower


def assign(parts: np.ndarray, books: Codebooks, p: int, codes: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Moves the codes and bounds of part p (n x width integers) to where the codebooks are now; returns how many were scanned."""
    entries = books.entries[p]
    upper += books.moved[p][codes]
    upper *= 1 + SLACK
    lower -= np.where(codes == books.farthest[p], books.second[p], books.most[p])
    lower *= 1 - np.copysign(SLACK, lower)
    guard = np.maximum(lower, books.clear[p][codes])
    doubtful = np.flatnonzero(~(upper < guard))
    upper[doubtful] = np.sqrt(((parts[doubtful] - entries[codes[doubtful]]) ** 2).sum(-1).astype(np.float64)) * (1 + SLACK)
    doubtful = doubtful[~(upper[doubtful] < guard[doubtful])]
    codes[doubtful], upper[doubtful], lower[doubtful] = scan(parts[doubtful], entries)
    return len(doubtful)


def finite(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    there = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce(F.forall(vector, there), F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int"))


def matrix(column: pa.ListArray, width: int, dtype: type) -> np.ndarray:
    """The lists, all of this length, as rows; a copy."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    if len(flat) != len(column) * width or not (column.value_lengths().to_numpy(zero_copy_only=False) == width).all():
        raise ValueError(f"a vector hasn't {width} components")
    return flat.reshape(len(column), width)


def lists(rows: np.ndarray, value: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, max(1, rows.shape[1]), dtype=np.int32) if rows.shape[1] else np.zeros(len(rows) + 1, np.int32), pa.array(rows.ravel(), value))


def stepped(books: Codebooks, first: bool):
    """One round over batches of STATE: rows assigned anew, and after a task's last row one with the sums and counts of its parts."""
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, scanned, rows = np.zeros((parts, entries, width + 1), np.int64), 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            vectors = matrix(batch.column("vector"), parts * width, np.int64).reshape(n, parts, width)
            if first:
                codes, upper, lower = np.zeros((n, parts), np.int64), np.zeros((n, parts)), np.zeros((n, parts))
            else:
                codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
                upper, lower = (matrix(batch.column(c), parts, np.float64) for c in ("upper", "lower"))
            errors = np.zeros((n, parts), np.int64)
            for p in range(parts):
                own = vectors[:, p]
                if first:
                    codes[:, p], upper[:, p], lower[:, p] = scan(own, books.entries[p])
                    scanned += n
                else:
                    moved = [np.ascontiguousarray(x[:, p]) for x in (codes, upper, lower)]
                    scanned += assign(own, books, p, *moved)
                    codes[:, p], upper[:, p], lower[:, p] = moved
                errors[:, p] = ((own - books.entries[p][codes[:, p]]) ** 2).sum(-1)
                np.add.at(sums[p], codes[:, p], np.concatenate([own, np.ones((n, 1), np.int64)], 1))
            rows += n
            none = [pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64())]
            packed = pa.array([r.tobytes() for r in codes.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("vector"), packed, lists(upper, pa.float64()), lists(lower, pa.float64()), lists(errors, pa.int64()), *none], NAMES)
        if rows:
            nothing = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.binary(), _LIST, _LIST, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array([sums.ravel().tolist()], pa.list_(pa.int64())), pa.array([scanned], pa.int64())], NAMES)

    return run


NAMES = [c.split()[0] for c in STATE.split(", ")]


def limits(kept: DataFrame, scale: int) -> None:
    """Refuses vectors of several lengths, and components whose squared distances might pass 64 bits."""
    largest = F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double") * scale)))
    top = kept.agg(F.max(largest).alias("most"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("width")).first()
    if top["least"] != top["width"]:
        raise ValueError("vectors must all have one length")
    if (2 * (top["most"] or 0) + 2) ** 2 * (top["width"] or 1) >= 1 << 62:
        raise ValueError("components are too large for exact distances in 64 bits")


def moved_entries(state: DataFrame, entries: np.ndarray) -> tuple[np.ndarray, int]:
    """Each entry at the floored mean of its parts, or where it was if it has none; and how many parts were scanned."""
    told = state.where("sums is not null")
    cells = told.select(F.posexplode("sums").alias("cell", "x")).groupBy("cell").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    parts, k, width = entries.shape
    total = np.zeros(parts * k * (width + 1), object)
    for row in cells.toLocalIterator():  # of the codebooks' size
        total[row["cell"]] = int(row["x"])
    total = total.reshape(parts, k, width + 1)
    out = entries.copy()
    for p, e in np.argwhere(total[:, :, width] > 0):
        out[p, e] = [x // total[p, e, width] for x in total[p, e, :width]]
    return out, told.agg(F.sum("scanned")).first()[0] or 0


class Compressed:
    """The result of compress(): rows (vec_id, label, code, error), the codebooks and how many parts each round has scanned."""

    def __init__(self, rows: DataFrame, entries: np.ndarray, scanned: list[int]):
        self.rows, self.entries, self.scanned = rows, entries, scanned

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Compressed:
    """vec_id, label, codes (a byte for each part) and error (squared distance to what the codes stand for) of each whole, finite vector.

    Codebooks begin as the parts of the rows of smallest vec_id; fewer rows than entries make fewer entries. A null vec_id comes
    after all others, and of rows with equal vec_id the vector that is less comes first. Rows whose vector is null or has a null,
    NaN or infinite component are left out; repeated rows are each returned. All other vectors must have one length, a multiple
    of parts, and components small enough for 64-bit distances, else a ValueError is raised. Only vec_id, label (null stays null)
    and the vector are read, so other columns may have any name. An empty table gives no row.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col(vector).alias("vector")).where(finite(F.col("vector")))
    limits(kept, scale)
    kept = kept.withColumn("vector", integers(F.col("vector"), scale))
    blank = {"codes": "binary", "upper": "array<double>", "lower": "array<double>", "errors": "array<long>", "sums": "array<long>", "scanned": "long"}
    state = kept.select("*", *[F.lit(None).cast(t).alias(c) for c, t in blank.items()])
    seeds = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()  # as many rows as a codebook has entries
    if not seeds:
        return Compressed(spark.createDataFrame([], "vec_id long, label string, codes binary, error long"), np.zeros((parts, 0, 0), np.int64), [])
    width = len(seeds[0]["vector"])
    if width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    books = Codebooks(np.array([r["vector"] for r in seeds], np.int64).reshape(len(seeds), parts, width // parts).transpose(1, 0, 2))
    held, scanned = None, []
    for step in range(rounds + 1):
        path = new_path(spark, f"codes-{step}")
        state.mapInArrow(stepped(books, first=not step), STATE).write.parquet(path)
        if held:
            drop_path(spark, held)
        held, state = path, spark.read.schema(STATE).parquet(path)
        moved, n = moved_entries(state, books.entries)
        scanned.append(n)
        state = state.where("sums is null")
        if step < rounds:
            books = Codebooks(moved, books.entries)
    rows = state.select("vec_id", "label", F.col("codes"), F.aggregate("errors", F.lit(0).cast("long"), lambda a, x: a + x).alias("error"))
    return Compressed(rows, books.entries, scanned)


def with_label_errors(rows: DataFrame) -> DataFrame:
    """rows with label_error, the error summed over equal labels; those without a label count together."""
    keyed = rows.withColumn("label_key", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")))
    sums = stage(keyed.groupBy("label_key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("label_rows")), "label-errors")
    return joined_by_key(keyed, sums, "label_key", "label_rows").drop("label_key", "label_rows")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = with_label_errors(found.rows)
    return rows.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


#: Components of a part of the given tables' vectors, for the SQL.
_WIDTH = 8
_SUMS = ", ".join(f"floor(sum(part[{i}]) / count(*))::BIGINT" for i in range(1, _WIDTH + 1))
_STEPS = ",".join(
    f"""
    a{k} AS MATERIALIZED (SELECT row, x.p, part, min(list_sum(list_transform(range(1, {_WIDTH + 1}), lambda i: (part[i] - entry[i]) * (part[i] - entry[i]))) * {ENTRIES} + e)::BIGINT AS m FROM x JOIN c{k} c ON x.p = c.p GROUP BY row, x.p, part)"""
    + (f""",
    c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(n.entry, c.entry) AS entry FROM c{k} c LEFT JOIN (SELECT p, m % {ENTRIES} AS e, [{_SUMS}] AS entry FROM a{k} GROUP BY ALL) n ON c.p = n.p AND c.e = n.e)""" if k < ROUNDS else "")
    for k in range(ROUNDS + 1)
)
#: Lloyd's rounds with every distance worked out.
ORACLE_SQL = f"""WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    x AS MATERIALIZED (SELECT row, p, v[p * {_WIDTH} + 1:(p + 1) * {_WIDTH}] AS part FROM (SELECT row, v, unnest(range({PARTS})) AS p FROM kept)),
    c0 AS MATERIALIZED (SELECT p, row - 1 AS e, part AS entry FROM x WHERE row <= {ENTRIES}),{_STEPS},
    rows AS (SELECT row, string_agg(printf('%02x', m % {ENTRIES}), '' ORDER BY p) AS code, sum(m // {ENTRIES})::BIGINT AS error FROM a{ROUNDS} GROUP BY row)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) FROM c{ROUNDS}) AS codebooks_sha256
    FROM rows JOIN kept USING (row)"""
