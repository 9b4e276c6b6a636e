"""Structural similarity and warping distance between truth and fill."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from panelfill.functions.keys import CELL, SERIES
from panelfill.operators.scan import date_ordinal
from panelfill.sources.storage import stored

# Fixed values of the similarity index: window edge and stabilising constants.
EDGE, K1, K2 = 7, 0.01, 0.03


TILE = 128  # inner edge of the square tiles the matrices are cut into


def box_sums(a: np.ndarray, edge: int) -> np.ndarray:
    """Sum over every full edge x edge square."""
    c = np.zeros((a.shape[0] + 1, a.shape[1] + 1))
    c[1:, 1:] = a.cumsum(axis=0).cumsum(axis=1)
    return c[edge:, edge:] - c[:-edge, edge:] - c[edge:, :-edge] + c[:-edge, :-edge]


def local_similarity(x: np.ndarray, x_sums: tuple, y: np.ndarray, value_range: float) -> np.ndarray:
    """Similarity index of every full square of two matrices of the same shape; x_sums = ``own_moments(x)``."""
    n = EDGE * EDGE
    unbiased = n / (n - 1)
    mx, vx = x_sums
    my, vy = own_moments(y)
    vxy = (box_sums(x * y, EDGE) / n - mx * my) * unbiased
    c1, c2 = (K1 * value_range) ** 2, (K2 * value_range) ** 2
    return ((2 * mx * my + c1) * (2 * vxy + c2)) / ((mx * mx + my * my + c1) * (vx + vy + c2))


def own_moments(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample variance of every full square."""
    n = EDGE * EDGE
    mean = box_sums(a, EDGE) / n
    return mean, (box_sums(a * a, EDGE) / n - mean * mean) * (n / (n - 1))


# Header rows of a tile carry these in place of a time position, and their number as the value.
RANGE, N_DATES, N_STATIONS = -1, -2, -3


def _tile_similarity(table: pa.Table) -> pa.Table:
    """Per method the sum and number of the index values whose centre lies in this tile's own part."""
    half = EDGE // 2
    first = {c: table[c][0].as_py() for c in ("Feature", "ti", "si")}
    codes = table["method"].combine_chunks().dictionary_encode()
    owner = codes.indices.to_numpy(zero_copy_only=False)
    t, s, v = (table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("t", "s", "v"))
    cell = t >= 0
    names, totals, counts = [], [], []
    size = [v[t == kind] for kind in (N_DATES, N_STATIONS)]
    # No header: all values of the feature are equal in every method, so there is nothing to compare.
    nt, ns = (int(n[0]) if len(n) else 0 for n in size)
    t0, s0 = max(first["ti"] * TILE - half, 0), max(first["si"] * TILE - half, 0)
    shape = (min((first["ti"] + 1) * TILE + half, nt) - t0, min((first["si"] + 1) * TILE + half, ns) - s0)

    def matrix(rows):
        m = np.zeros(shape)
        m[t[rows] - t0, s[rows] - s0] = v[rows]
        return m

    # The truth is the rows without a method.
    is_truth = np.isnan(owner) if owner.dtype.kind == "f" else np.zeros(len(t), dtype=bool)
    if min(shape) >= EDGE:
        x = matrix(cell & is_truth)
        x_sums = own_moments(x)
        for i, name in enumerate(codes.dictionary.to_pylist()):
            mine = owner == i
            value_range = v[mine & (t == RANGE)]
            if len(value_range):
                index = local_similarity(x, x_sums, matrix(mine & cell), float(value_range[0]))
                names.append(name)
                totals.append(float(index.sum()))
                counts.append(index.size)
    return pa.table({"method": pa.array(names, pa.string()), "Feature": pa.array([first["Feature"]] * len(names), pa.string()),
                     "total": pa.array(totals, pa.float64()), "n": pa.array(counts, pa.int64())})


def _tiles(position, count, half: int):
    """Tiles that need a cell at this position: its own and, next to a border, the neighbours inside the matrix."""
    low, high = F.greatest(position - half, F.lit(0)), F.least(position + half, count - 1)
    return F.explode(F.sequence(F.floor(low / TILE).cast("int"), F.floor(high / TILE).cast("int")))


def ssim(truth: DataFrame, m: DataFrame) -> DataFrame:
    """Mean structural similarity of the Date x Station matrices per (method, Feature).

    Unknown cells count as 0. Null when a side has 7 cells or fewer or all values are equal. The matrices are
    cut into square tiles that overlap by half a window. Truth and fills meet inside a tile, so there is no join
    between them, every cell is shuffled once, and a task's work is bounded by the tile whatever the length of the
    series or the number of stations.
    """
    half = EDGE // 2
    zero = F.lit(0.0)
    # Positions and tiles come from the short lists of dates and stations. A date next to a tile border is listed
    # for both tiles, so the join with the list also makes the copies the halo needs.
    dates = date_ordinal(truth.select("Feature", "Date").distinct(), ["Feature"], out="t", total="nt")
    dates = dates.select("Feature", "Date", (F.col("t") - 1).cast("int").alias("t"), F.col("nt").cast("int").alias("nt"))
    by_name = W.partitionBy("Feature")
    stations = truth.select("Feature", "Station").distinct().select(
        "Feature", "Station", (F.row_number().over(by_name.orderBy("Station")) - 1).alias("s"),
        F.count(F.lit(1)).over(by_name).cast("int").alias("ns"))
    dates = dates.where(F.col("nt") > EDGE).withColumn("ti", _tiles(F.col("t"), F.col("nt"), half))
    stations = stations.where(F.col("ns") > EDGE).withColumn("si", _tiles(F.col("s"), F.col("ns"), half))

    def placed(df, method):
        return (df.select(method.alias("method"), *CELL, F.coalesce("Value", zero).alias("v"))
                .join(dates, ["Feature", "Date"]).join(stations, ["Feature", "Station"])
                .select("method", "Feature", "t", "s", "nt", "ns", "v", "ti", "si"))

    x, y = placed(truth, F.lit(None).cast("string")), placed(m, F.col("method"))

    def extremes(df, *by):
        # A cell without a row counts as 0. Copies in neighbouring tiles are not counted.
        home = (F.floor(F.col("t") / TILE) == F.col("ti")) & (F.floor(F.col("s") / TILE) == F.col("si"))
        full = F.count_if(home) == F.max(F.col("nt").cast("bigint") * F.col("ns"))
        lo, hi = F.min("v"), F.max("v")
        return df.groupBy(*by).agg(F.when(full, lo).otherwise(F.least(lo, zero)).alias("lo"),
                                   F.when(full, hi).otherwise(F.greatest(hi, zero)).alias("hi"),
                                   F.max("nt").alias("nt"), F.max("ns").alias("ns"))

    tx, ty = extremes(x, "Feature"), extremes(y, "method", "Feature")
    ranges = (ty.withColumnsRenamed({"lo": "lo_y", "hi": "hi_y"}).drop("nt", "ns").join(tx, "Feature")
              .withColumn("v", F.greatest("hi", "hi_y") - F.least("lo", "lo_y")).where(F.col("v") > 0))
    tiles = lambda n: F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / TILE).cast("int")))
    kinds = F.array(*[F.struct(F.lit(kind).alias("t"), value.cast("double").alias("v")) for kind, value in (
        (RANGE, F.col("v")), (N_DATES, F.col("nt")), (N_STATIONS, F.col("ns")))])
    headers = (ranges.select("method", "Feature", "ns", kinds.alias("kinds"), tiles("nt").alias("ti"))
               .select("method", "Feature", "kinds", "ti", tiles("ns").alias("si"))
               .select("method", "Feature", "ti", "si", F.explode("kinds").alias("h"))
               .select("method", "Feature", F.col("h.t").alias("t"), F.lit(RANGE).alias("s"), F.col("h.v").alias("v"), "ti", "si"))
    cells = x.unionByName(y).drop("nt", "ns")
    parts = (cells.unionByName(headers).groupBy("ti", "si", "Feature")
             .applyInArrow(_tile_similarity, "method string, Feature string, total double, n bigint"))
    return parts.groupBy("method", "Feature").agg((F.sum("total") / F.sum("n")).alias("SSIM"))


# --- warping distance -------------------------------------------------------------------------------
#
# The banded distance is a walk over rows i with the state D[i, i-band .. i+band]. Going through a chunk
# of rows is a (min, +) linear map of that state, so each chunk can be worked out on its own as a small
# square matrix and the matrices of a series are multiplied afterwards. Any length of series is
# therefore split over many tasks, and the result is the exact banded distance.

STEPS_PER_CHUNK = 512
CHUNKS_PER_FOLD = 256


def _walk(first: int, n: int, x: np.ndarray, y: np.ndarray, y_first: int, band: int, state: np.ndarray) -> np.ndarray:
    """Advance ``state`` (starts x offsets) over rows first .. first+len(x)-1 (1-based) of a series of length n."""
    width = 2 * band + 1
    rows = np.arange(first, first + len(x))[:, None]
    cols = rows - band + np.arange(width)[None, :]
    known = (cols >= 1) & (cols <= n)
    cost = np.zeros(cols.shape)
    at = np.clip(cols - y_first, 0, len(y) - 1)
    cost[known] = np.abs(x[:, None] - y[at])[known]
    run = np.cumsum(cost, axis=1)
    before = run - cost
    closed = ~known
    for r in range(len(x)):
        step = state.copy()
        np.minimum(step[:, :-1], state[:, 1:], out=step[:, :-1])
        step[:, closed[r]] = np.inf
        step -= before[r]
        np.minimum.accumulate(step, axis=1, out=step)
        step += run[r]
        step[:, closed[r]] = np.inf
        state = step
    return state


def _start(band: int) -> np.ndarray:
    state = np.full((1, 2 * band + 1), np.inf)
    state[0, band] = 0.0
    return state


def _identity(width: int) -> np.ndarray:
    state = np.full((width, width), np.inf)
    np.fill_diagonal(state, 0.0)
    return state


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.min(a[:, :, None] + b[None, :, :], axis=1)


def banded_distance(x: np.ndarray, y: np.ndarray, band: int) -> float:
    """Distance of two equally long arrays; also the check value for the split computation."""
    return float(_walk(1, len(x), x, y, 1, band, _start(band))[0, band])


def _chunk_map(band: int):
    width = 2 * band + 1

    def advance(chunk: pd.Series, total: pd.Series, pos: pd.Series, truth: pd.Series, fill: pd.Series) -> pd.Series:
        out = []
        for c, n, at, x, y in zip(chunk, total, pos, truth, fill):
            first = c * STEPS_PER_CHUNK + 1
            home = slice(first - at, first - at + STEPS_PER_CHUNK)
            inside = min(STEPS_PER_CHUNK, n - first + 1)
            state = _start(band) if c == 0 else _identity(width)
            x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
            out.append(_walk(first, n, x[home][:inside], y, at, band, state).ravel())
        return pd.Series(out)

    return F.pandas_udf(advance, "array<double>")


def _fold(keys: list[str], width: int):
    names = [*keys, "chunk", "map"]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        maps = [np.asarray(v, dtype=float).reshape(-1, width) for v in pdf["map"]]
        total = maps[0]
        for nxt in maps[1:]:
            total = _times(total, nxt)
        first = pdf.iloc[0]
        return pd.DataFrame([[*[first[k] for k in keys], first["_group"], total.ravel()]], columns=names)

    return fold


# Without a band, the whole matrix of a pair of series is cut into square tiles. A tile needs the last row of the tile
# above it and the last column of the one to its left, so all tiles on one diagonal, of all series, are one job, and
# what goes from job to job is the edges of that diagonal: two rows a tile, never the matrix.

STEPS_PER_TILE = 1024


def _tile_edges(x: np.ndarray, y: np.ndarray, top: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last row and last column of a tile. Edges begin with the cell across the corner: top[0] == left[0]."""
    before, right = top, np.empty(len(x) + 1)
    right[0] = top[-1]
    for r in range(len(x)):
        cost = np.abs(x[r] - y)
        run = np.cumsum(cost)
        step = np.minimum(before[:-1], before[1:])  # from above, straight or across
        row = np.empty(len(y) + 1)
        row[0] = left[r + 1]
        # Walks along the row: the best way in, less the cost up to there, plus the cost up to here.
        ways = np.concatenate([[row[0]], step - (run - cost)])
        row[1:] = np.minimum.accumulate(ways)[1:] + run
        before, right[r + 1] = row, row[-1]
    return before, right


def _diagonal(batches):
    for batch in batches:
        bottoms, rights = [], []
        for i, j, x, y, above, beside in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "x", "y", "above", "beside"))):
            corner = 0.0 if i == j == 0 else np.inf
            top = np.array(above, float) if above is not None else np.concatenate([[corner], np.full(len(y), np.inf)])
            left = np.array(beside, float) if beside is not None else np.concatenate([[top[0]], np.full(len(x), np.inf)])
            bottom, right = _tile_edges(np.array(x, float), np.array(y, float), top, left)
            bottoms.append(bottom)
            rights.append(right)
        names = [n for n in batch.schema.names if n not in ("x", "y", "above", "beside")]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(e, pa.list_(pa.float64())) for e in (bottoms, rights)],
                                         names=names + ["bottom", "right"])


def dtw_unbanded(cells: DataFrame, keys=("method", *SERIES), tile: int = STEPS_PER_TILE) -> DataFrame:
    """Exact warping distance (absolute cost) over all alignments. The work grows with the square of a series' length."""
    keys = list(keys)
    placed = date_ordinal(cells.select(*keys, "Date", "truth", "fill"), keys, total="_total")
    cell = F.struct(F.col("_pos").alias("pos"), "truth", "fill")
    parts = stored(placed.groupBy(*keys, "_total", F.floor((F.col("_pos") - 1) / tile).cast("int").alias("i"))
                   .agg(F.sort_array(F.collect_list(cell)).alias("c")), "warping-segments")
    rows = parts.select(*keys, "i", F.floor((F.col("_total") - 1) / tile).cast("int").alias("end"), F.transform("c", lambda c: c["truth"]).alias("x"))
    columns = parts.select(*keys, F.col("i").alias("j"), F.transform("c", lambda c: c["fill"]).alias("y"))
    schema = f"{', '.join(f'{k} string' for k in keys)}, i int, j int, `end` int, bottom array<double>, right array<double>"
    longest = rows.agg(F.max("end")).first()[0] or 0
    edges, out = None, None
    for wave in range(2 * longest + 1):
        tiles = rows.withColumn("j", F.lit(wave) - F.col("i")).join(columns, [*keys, "j"])
        if edges is None:
            tiles = tiles.withColumns({c: F.lit(None).cast("array<double>") for c in ("above", "beside")})
        else:
            tiles = (tiles.join(edges.select(*keys, (F.col("i") + 1).alias("i"), "j", F.col("bottom").alias("above")), [*keys, "i", "j"], "left")
                     .join(edges.select(*keys, "i", (F.col("j") + 1).alias("j"), F.col("right").alias("beside")), [*keys, "i", "j"], "left"))
        edges = stored(tiles.select(*keys, "i", "j", "end", "x", "y", "above", "beside").mapInArrow(_diagonal, schema), "warping-edges")
        done = edges.where((F.col("i") == F.col("end")) & (F.col("j") == F.col("end"))).select(*keys, F.element_at("bottom", -1).alias("dtw_distance"))
        out = done if out is None else out.unionByName(done) if wave % 2 == 0 else out
    return out


def dtw(cells: DataFrame, band: int | None = 10, keys=("method", *SERIES)) -> DataFrame:
    """Exact warping distance (absolute cost) of the hidden cells, in Date order: within a band, or of all alignments for None."""
    if band is None:
        return dtw_unbanded(cells, keys)
    keys = list(keys)
    width = 2 * band + 1
    if not 0 < band < STEPS_PER_CHUNK:
        raise ValueError(f"band must lie between 1 and {STEPS_PER_CHUNK - 1}")
    placed = date_ordinal(cells.select(*keys, "Date", "truth", "fill"), keys, total="_total")
    p = F.col("_pos") - 1

    def chunk(c):
        return F.floor(c / STEPS_PER_CHUNK).cast("int")

    last_chunk = chunk(F.col("_total") - 1)
    # Rows next to a border also serve the neighbouring chunk, but no chunk outside the series.
    spread = placed.withColumn("chunk", F.explode(F.sequence(
        chunk(F.greatest(p - band, F.lit(0))), F.least(chunk(p + band), last_chunk))))
    cell = F.struct(F.col("_pos").alias("pos"), "truth", "fill")
    packed = spread.groupBy(*keys, "_total", "chunk").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    # Positions are dense, so the first one places the whole chunk.
    maps = packed.select(*keys, "_total", "chunk", _chunk_map(band)(
        F.col("chunk"), F.col("_total"), F.col("cells")[0]["pos"],
        F.transform("cells", lambda c: c["truth"]), F.transform("cells", lambda c: c["fill"])).alias("map"))
    is_short = F.col("_total") <= STEPS_PER_CHUNK
    short = maps.where(is_short).select(*keys, F.col("map")[band].alias("dtw_distance"))
    schema = ", ".join(f"{k} string" for k in keys) + ", chunk int, map array<double>"
    long = maps.where(~is_short).select(*keys, "chunk", "map")
    for _ in range(2):
        long = (long.withColumn("_group", F.floor(F.col("chunk") / CHUNKS_PER_FOLD).cast("int"))
                .groupBy(*keys, "_group").applyInPandas(_fold(keys, width), schema))
    # The first chunk carries the start state, so group 0 has folded to a single row.
    final = long.groupBy(*keys).applyInPandas(_final(keys, width, band), ", ".join(f"{k} string" for k in keys) + ", dtw_distance double")
    return short.unionByName(final)


def _final(keys: list[str], width: int, band: int):
    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        state = None
        for v in pdf["map"]:
            step = np.asarray(v, dtype=float).reshape(-1, width)
            state = step if state is None else _times(state, step)
        first = pdf.iloc[0]
        return pd.DataFrame([[*[first[k] for k in keys], float(state[0, band])]], columns=[*keys, "dtw_distance"])

    return finish
