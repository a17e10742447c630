"""Many rows times many posterior draws, block by block.

A fitted model is a table with one record per draw and part (coefficient matrix of a group, tree, dispersion), as long as there are draws. Neither it nor
the rows pass the driver or lie whole in one task: rows are dealt into blocks of bounded size, draws into chunks of bounded size (all parts of a draw
together), and a task multiplies one block with one chunk. What a task returns is reduced over its draws already (sums, totals, moments), and partial
results of the chunks are added by key. The driver learns the number and the bytes of the rows and of the model's records. A block is sent once for each
chunk and a chunk once for each block; both numbers are chosen so that the two together move least for as many products as the cores need, so what is
moved grows with the input and not with the product. The model is written once, since several jobs read it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridpanel.operators.trees import LEAF, forest, right_children, settle
from gridpanel.session import written

POOLED = "__pooled__"  # group label of the pooled coefficients
BLOCK_ROWS, BLOCK_BYTES, CHUNK_BYTES = 2_000_000, 256 * 2**20, 192 * 2**20  # at most
WAVES, LEAST_WORK = 6, 50_000_000  # products for each core; row-record pairs that are worth a product
WORK, DRAWS = 1 << 18, 64  # doubles in a working array, which a core's cache holds; draws in it
NEAR_DRAWS = 256  # draws in it where rows should be few, since trees are settled for rows that lie close
EXPONENT = 700.0  # exponentials of more come near the largest double
PARTS = "draw bigint, kind string, a string, b string, ints array<int>, vals array<double>"


def np_softmax(u: np.ndarray) -> np.ndarray:
    e = np.exp(u - u.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def shares(x: np.ndarray, b: np.ndarray, terms: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]] = ()) -> np.ndarray:
    """Softmax [class, draw, row] of the utilities of matrices [draw, class, column], rows side by side, and of tree terms (``Grown.at``) if given.

    Every class is set against the first one, so a class has one exponential less and no maximum is taken; where an exponential would leave the doubles, or
    something is not a number, the maximum is.
    """
    draws, classes, _ = b.shape
    if classes > 1:
        gap = b[:, 1:] - b[:, :1]
        if terms:  # terms that hold for all rows are one more column; a term of all classes, such as their mean, is the same for the softmax
            flat = np.stack([t[0] for t in terms], axis=1)
            gap, design = np.concatenate((gap, (flat[:, 1:] - flat[:, :1])[:, :, None]), axis=2), np.column_stack((x, np.ones(len(x))))
        else:
            design = x
        u = np.empty((classes, draws, len(x)))
        np.matmul(gap.transpose(1, 0, 2).reshape(-1, gap.shape[2]), design.T, out=u[1:].reshape(-1, len(x)))
        for i, (_, some, value) in enumerate(terms):
            if len(some) and i:
                u[i, some] += value
            elif len(some):
                for k in range(1, classes):
                    u[k, some] -= value
        if u[1:].max(initial=-np.inf) < EXPONENT:
            np.exp(u[1:], out=u[1:])
            np.add(u[1], 1.0, out=u[0])
            for k in range(2, classes):
                u[0] += u[k]
            np.reciprocal(u[0], out=u[0])
            u[1:] *= u[0]
            return u
    u = linear(x, b)
    for k, (flat, some, value) in enumerate(terms):
        u[k] += flat[:, None]
        u[k, some] += value
    u -= u.max(axis=0)
    np.exp(u, out=u)
    u /= u.sum(axis=0)
    return u


def expand(u: np.ndarray, class_map: Sequence[int] | None) -> np.ndarray:
    """Fitted utilities → output classes; siblings share −log(count)."""
    if class_map is None:
        return u
    m = np.asarray(class_map)
    return u[..., m] - np.log(np.bincount(m)[m])


# ---- the model as a table ------------------------------------------------------------------------------------------------


def _part(kind: str, a: Column, b: Column, ints: Column, vals: Column, draw: str) -> list[Column]:
    return [F.col(draw).cast("bigint").alias("draw"), F.lit(kind).alias("kind"), a.cast("string").alias("a"), b.cast("string").alias("b"),
            ints.cast("array<int>").alias("ints"), vals.cast("array<double>").alias("vals")]


def matrix_parts(coef: DataFrame, group: str, draw: str, b: str = "b", kind: str = "coef") -> DataFrame:
    """Records of ready matrices ``b[class][covariate]`` per (group, draw)."""
    none = F.lit(None)
    return coef.select(*_part(kind, F.col(group), none, none, F.flatten(b), draw))


def coefficient_parts(
    draws: DataFrame, group: str, draw: str, cov: str, cls: str, value: str, covs: Sequence[str], classes: Sequence[str], kind: str = "coef", name: Column | None = None
) -> DataFrame:
    """Records of long draws: a matrix per (group, draw), kept as places and values, so no column is made per coefficient.

    ``name`` names the matrix within its group (the node of a nested model).
    """
    place = (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(cls)) - 1) * len(covs) + F.array_position(F.array(*[F.lit(c) for c in covs]), F.col(cov)) - 1
    known = draws.where(F.col(cls).isin(*classes) & F.col(cov).isin(*covs))
    cells = known.groupBy(F.col(draw).alias("draw"), F.col(group).alias("a"), (F.lit(None) if name is None else name).cast("string").alias("b"), place.cast("int").alias("i")).agg(F.avg(value).alias("v"))
    lists = cells.groupBy("draw", "a", "b").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("e"))  # a matrix
    return lists.select(*_part(kind, F.col("a"), F.col("b"), F.transform("e", lambda e: e["i"]), F.transform("e", lambda e: e["v"]), "draw"))


def tree_parts(nodes: DataFrame) -> DataFrame:
    """Records of pre-order node tables (draw, ensemble, tree, node, var, value), one per tree."""
    trees = nodes.groupBy("draw", "ensemble", "tree").agg(F.array_sort(F.collect_list(F.struct("node", "var", "value"))).alias("n"))
    return trees.select(*_part("tree", F.col("ensemble"), F.col("tree"), F.transform("n", lambda n: n["var"]), F.transform("n", lambda n: n["value"]), "draw"))


def vector_parts(df: DataFrame, draw: str, vals: str, kind: str, a: str | None = None, b: str | None = None) -> DataFrame:
    """Records of a vector per draw, such as the dispersions of the classes."""
    column = lambda c: F.lit(None) if c is None else F.col(c)
    return df.select(*_part(kind, column(a), column(b), F.lit(None), F.col(vals), draw))


def _lists(column: pa.ChunkedArray, dtype: type) -> list[np.ndarray | None]:
    """The entries of an array column as numpy views; None for null."""
    held = column.combine_chunks()
    if isinstance(held, pa.ChunkedArray):
        held = pa.concat_arrays(held.chunks) if held.num_chunks else pa.array([], held.type)
    values = held.values.to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    ends, null = held.offsets.to_numpy(), held.is_null().to_numpy(zero_copy_only=False)
    return [None if null[i] else values[ends[i] : ends[i + 1]] for i in range(len(held))]


class Chunk:
    """The draws that a task holds."""

    def __init__(self, table: pa.Table):
        self.draws = sorted(set(table.column("draw").to_pylist()))
        self.parts: dict[tuple, list] = {}
        names = (table.column(c).to_pylist() for c in ("draw", "kind", "a", "b"))
        for d, kind, a, b, ints, vals in zip(*names, _lists(table.column("ints"), np.int64), _lists(table.column("vals"), float), strict=True):
            self.parts.setdefault((kind, a), []).append((d, b, ints, vals))
        self._stacks: dict[tuple, tuple[list[int], np.ndarray]] = {}
        self._forests: dict[str, list[tuple]] = {}
        self._vectors: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    def matrices(self, kind: str, group: str, rows: int, cols: int, name: str | None = None) -> tuple[list[int], np.ndarray]:
        """Draws and matrices [draw, row, column] of a group; none if the chunk holds no draw of it."""
        key = (kind, group, name)
        if key not in self._stacks:
            found = sorted((p for p in self.parts.get((kind, group), []) if p[1] == name), key=lambda p: p[0])
            out = np.zeros((len(found), rows * cols))
            for i, (_, _, ints, vals) in enumerate(found):
                out[i, slice(None) if ints is None else ints] = np.nan if vals is None else vals
            self._stacks[key] = [p[0] for p in found], out.reshape(len(found), rows, cols)
        return self._stacks[key]

    def vectors(self, kind: str, a: str | None = None, draws: Sequence[int] = ()) -> np.ndarray | None:
        """The vectors [draw, entry] of ``draws``; None if the chunk has none of the kind."""
        key = (kind, a)
        if key not in self._vectors:
            found = {d: vals for d, _, _, vals in self.parts.get(key, [])}
            width = max((len(v) for v in found.values() if v is not None), default=1)
            self._vectors[key] = np.array(sorted(found), np.int64), np.array([np.full(width, np.nan) if found[d] is None else found[d] for d in sorted(found)])
        held, values = self._vectors[key]
        if not len(held):
            return None
        at = np.minimum(np.searchsorted(held, draws), len(held) - 1)
        if (held[at] != draws).any():
            raise KeyError(f"draws without {kind} {a or ''}")
        return values[at]

    def _forest(self, ensemble: str) -> list[tuple]:
        """Trees of one shape side by side: (variables, right children, draws, values [tree, node]), with a draw once at most in each."""
        if ensemble not in self._forests:
            shapes: dict[tuple, list] = {}
            seen: dict[tuple, int] = {}
            for d, _, var, value in sorted(self.parts.get(("tree", ensemble), []), key=lambda p: p[0]):
                shape = var.tobytes()
                turn = seen[shape, d] = seen.get((shape, d), 0) + 1
                shapes.setdefault((shape, turn), []).append((d, var, value))
            self._forests[ensemble] = [
                (trees[0][1], right_children(trees[0][1]), np.array([t[0] for t in trees]), np.stack([t[2] for t in trees])) for trees in shapes.values()
            ]
        return self._forests[ensemble]

    def split_on(self, ensembles: Sequence[str]) -> list[int]:
        """The columns that the trees split on, the one of most trees first."""
        uses: dict[int, int] = {}
        for e in ensembles:
            for var, _, held, _ in self._forest(e):
                for v in var[var != LEAF].tolist():
                    uses[v] = uses.get(v, 0) + len(held)
        return sorted(uses, key=lambda v: (-uses[v], v))

    def ensemble(self, x: np.ndarray, ensembles: Sequence[str], draws: Sequence[int], cap: float | None) -> np.ndarray:
        """Sums of trees [row, draw, ensemble], each capped; ``draws`` ascend."""
        out = np.zeros((len(ensembles), len(draws), len(x)))
        if len(x):
            for j, (flat, some, value) in enumerate(Grown(self, x, ensembles, draws, cap).at(slice(0, len(draws)))):
                out[j] = flat[:, None]
                out[j, some] = value
        return out.transpose(2, 1, 0)


class Grown:
    """The tree ensembles of ``draws`` (ascending) on a few rows.

    A tree whose splits all lie outside the range of the rows has one value for them. The others are open and walked row by row, so rows that lie close
    (``nearby``) leave few of them.
    """

    def __init__(self, chunk: Chunk, x: np.ndarray, ensembles: Sequence[str], draws: Sequence[int], cap: float | None):
        self.x, self.cap, wanted = x, cap, np.asarray(draws, np.int64)
        low, high = np.fmin.reduce(x, axis=0), x.max(axis=0)  # a row without a value goes right: it has no upper end
        self.terms = []
        for e in ensembles:
            flat, open_, walked = np.zeros(len(wanted)), np.zeros(len(wanted), bool), []
            for var, right, held, value in chunk._forest(e):
                at = np.searchsorted(wanted, held)
                mine = at < len(wanted)
                mine[mine] = wanted[at[mine]] == held[mine]
                if not mine.all():
                    at, value = at[mine], value[mine]
                one, settled = settle(low, high, var, right, value)
                flat[at[settled]] += one[settled]
                if not settled.all():
                    left = ~settled
                    open_[at[left]] = True
                    walked.append((var, right, at[left], value[left]))
            self.terms.append((flat, np.flatnonzero(open_), walked))

    def _capped(self, v: np.ndarray) -> np.ndarray:
        return v if self.cap is None else np.clip(v, -self.cap, self.cap)

    def at(self, part: slice) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of every ensemble, for draws ``part``: the sums [draw] that hold for all rows (0 for open ones), the places of open draws, their sums [place, row]."""
        out = []
        for flat, open_, walked in self.terms:
            within = lambda at: slice(*np.searchsorted(at, [part.start, part.stop]))
            some = open_[within(open_)]
            value = np.repeat(flat[some][:, None], len(self.x), axis=1)
            for var, right, at, trees in walked:
                now = within(at)
                if now.stop > now.start:
                    value[np.searchsorted(some, at[now])] += forest(self.x, var, right, trees[now])
            whole = self._capped(flat[part])
            whole[some - part.start] = 0.0
            out.append((whole, some - part.start, self._capped(value)))
        return out


def nearby(x: np.ndarray, columns: Sequence[int], rows: int) -> np.ndarray:
    """An order of the rows of ``x`` in which every ``rows`` of them lie close: halves along one of the columns after the other."""
    order = np.arange(len(x))
    parts = [(0, len(x), 0)] if len(columns) else []
    while parts:
        i, j, k = parts.pop()
        if j - i > rows:
            half = rows * -(-(j - i) // (2 * rows))
            some = order[i:j]
            order[i:j] = some[np.argpartition(x[some, columns[k % len(columns)]], half)]
            parts += [(i, i + half, k + 1), (i + half, j, k + 1)]
    return order


# ---- the product ---------------------------------------------------------------------------------------------------------


def mark_fitted(rows: DataFrame, model: DataFrame, group: str, kind: str = "coef") -> DataFrame:
    """Add ``_fit``: the group whose coefficients serve the row, its own if it was fitted, else the pooled one; without pooled ones that is an error."""
    mine = model.where(F.col("kind") == kind)
    fitted = mine.where(F.col("a") != POOLED).select(F.col("a").alias("_a")).distinct()
    other = F.lit(POOLED)
    if mine.where(F.col("a") == POOLED).isEmpty():
        other = F.raise_error(F.lit("a group was not fitted and there are no pooled coefficients")).cast("string")
    return rows.join(fitted, F.col(group).cast("string") == F.col("_a"), "left").withColumn("_fit", F.coalesce("_a", other)).drop("_a")


def _bytes(rows: DataFrame) -> Column:
    """About the bytes of a row when it is sent, and of as much that comes back."""
    size = F.lit(64)
    for f in rows.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            size = size + F.coalesce(F.size(f.name), F.lit(0)) * 16
        else:
            size = size + 16
    return size


def dealt(n: int, row_bytes: int, records: int, model_bytes: int, cores: int, block_rows: int, chunk_bytes: int) -> tuple[int, int]:
    """Numbers of blocks and chunks: enough products for the cores, the copies of both sides together as few bytes as may be, and each bounded."""
    tasks = max(1, min(WAVES * cores, ceil(n * records / LEAST_WORK)))
    blocks = min(tasks, max(1, round((tasks * row_bytes / max(1, model_bytes)) ** 0.5)))
    chunks = ceil(tasks / blocks)
    return max(blocks, ceil(n / block_rows), ceil(row_bytes / BLOCK_BYTES)), max(chunks, ceil(model_bytes / chunk_bytes))


def _placed(spark: SparkSession, n: int) -> list[int]:
    """A number for each of ``n`` products, such that a shuffle by it into ``n`` partitions gives every product its own."""
    tried = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(20 * n + 100)), lambda i: F.pmod(F.hash(i), F.lit(n))).alias("to")).first()["to"]
    first = {to: i for i, to in reversed(list(enumerate(tried)))}
    return sorted(first.values()) + list(range(len(tried), len(tried) + n - len(first)))  # a partition that no number meets stays empty


def product(
    rows: DataFrame, model: DataFrame, kernel: Callable[[pa.Table, Chunk], Iterator[dict]], schema: str, block_rows: int = BLOCK_ROWS,
    chunk_bytes: int = CHUNK_BYTES,
) -> tuple[DataFrame, int]:
    """Run ``kernel(rows, chunk)`` on every block of rows and chunk of draws; the number of chunks tells whether results need adding."""
    size = F.coalesce(F.size("vals"), F.lit(0)) * 8 + F.coalesce(F.size("ints"), F.lit(0)) * 4 + 64
    n, row_bytes = rows.agg(F.count(F.lit(1)), F.sum(_bytes(rows))).first()
    records, total = model.agg(F.count(F.lit(1)), F.sum(size)).first()
    blocks, chunks = dealt(n, row_bytes or 0, records, total or 0, rows.sparkSession.sparkContext.defaultParallelism, block_rows, chunk_bytes)
    # the row's values deal it out: a recomputed task sends every row to the same place again
    simple = [f.name for f in rows.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    number = lambda k: F.sequence(F.lit(0), F.lit(k - 1))
    tasks = blocks * chunks
    place = F.lit(_placed(rows.sparkSession, tasks))
    left = rows.withColumn("_chunk", F.explode(number(chunks))).withColumn("_task", F.get(place, F.pmod(F.xxhash64(*simple), F.lit(blocks)).cast("int") * chunks + F.col("_chunk")))
    right = model.withColumn("_block", F.explode(number(blocks))).withColumn("_task", F.get(place, F.col("_block") * chunks + F.pmod(F.xxhash64("draw"), F.lit(chunks)).cast("int")))
    target = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if a.num_rows and b.num_rows:
            out = [pa.table({f.name: part[f.name] for f in target}, schema=target) for part in kernel(a, Chunk(b))]
        return pa.concat_tables(out) if out else target.empty_table()

    spread = lambda df, extra: df.drop(extra).repartition(tasks, "_task").groupBy("_task")
    return spread(left, "_chunk").cogroup(spread(right, "_block")).applyInArrow(run, schema), chunks


def _column(a: pa.Table, name: str) -> np.ndarray:
    return a.column(name).to_numpy()


def array_column(a: pa.Table, name: str) -> np.ndarray:
    """An array column of equal lengths as a matrix."""
    values = a.column(name).combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(values), -1)


def by_group(a: pa.Table) -> Iterator[tuple[str, np.ndarray]]:
    label = a.column("_fit").to_numpy(zero_copy_only=False)
    for g in sorted(set(label)):
        yield g, np.flatnonzero(label == g)


def slices(n_rows: int, n_draws: int, width: int, at_once: int = DRAWS) -> Iterator[tuple[slice, slice]]:
    """Rows and draws of which a working array of ``width`` doubles each stays below ``WORK``: few draws and many rows, which are the inner loops."""
    d = max(1, min(n_draws, at_once))
    r = max(1, WORK // max(1, d * width))
    for i in range(0, n_rows, r):
        for j in range(0, n_draws, d):
            yield slice(i, i + r), slice(j, min(j + d, n_draws))


def lists(values: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as an array column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def linear(x: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Utilities [class, draw, row] of matrices [draw, class, column]; rows lie side by side in memory, so that what follows runs along them."""
    draws, classes, columns = b.shape
    return (b.transpose(1, 0, 2).reshape(-1, columns) @ x.T).reshape(classes, draws, len(x))


def _matched(a: pa.Table, chunk: Chunk, x: str, classes: int, trees: dict | None) -> Iterator[tuple]:
    """(rows, draws, place of the draws in their group, design, matrices, tree terms or ()) for all rows and their draws, slice by slice; draws run faster."""
    design = array_column(a, x)
    grown = array_column(a, trees["x"]) if trees else None
    for g, at in by_group(a):
        draws, b = chunk.matrices("coef", g, classes, design.shape[1])
        if trees and draws:
            at = at[nearby(grown[at], chunk.split_on(trees["ensembles"]), max(1, WORK // (min(len(draws), NEAR_DRAWS) * classes)))]
        mine = design[at]
        for r, d in slices(len(at), len(draws), classes, NEAR_DRAWS if trees else DRAWS):
            if d.start == 0:
                here, terms = at[r], Grown(chunk, grown[at[r]], trees["ensembles"], draws, trees.get("cap")) if trees else None
            yield here, draws[d], mine[r], b[d], terms.at(d) if trees else ()


def _utilities(a: pa.Table, chunk: Chunk, x: str, classes: int, trees: dict | None) -> Iterator[tuple[np.ndarray, list[int], np.ndarray]]:
    """(rows, draws, utilities [class, draw, row]) for all rows and their draws; the utilities may be overwritten."""
    for at, draws, design, b, terms in _matched(a, chunk, x, classes, trees):
        u = linear(design, b)
        if terms:
            f = np.stack([np.repeat(flat[:, None], len(at), axis=1) for flat, _, _ in terms])
            for k, (_, some, value) in enumerate(terms):
                f[k, some] = value
            u += f - f.mean(axis=0) if trees.get("centre", True) else f
        yield at, draws, u


SAME = "_id bigint, _copy bigint"  # tells a row, and its copies, from others with its key


def identified(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_id", F.xxhash64(*[f.name for f in rows.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]))


def same(a: pa.Table) -> dict[str, pa.Array]:
    """``_id`` and ``_copy`` of a block, which holds all copies of a row: they are numbered alike for every chunk."""
    ids = a.column("_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.diff(ids[order], prepend=ids[order[:1]] ^ 1)) if len(ids) else order
    copy = np.empty(len(ids), np.int64)
    copy[order] = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
    return {"_id": pa.array(ids), "_copy": pa.array(copy)}


def _added(parts: DataFrame, chunks: int, key: Sequence[str], width: int) -> DataFrame:
    """Sum ``n`` and the array ``s`` over the chunks; rows that repeat a key stay apart."""
    if chunks == 1:
        return parts
    return parts.groupBy(*key, "_id", "_copy").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(width)]).alias("s"))


def _schema(rows: DataFrame, key: Sequence[str], rest: str) -> str:
    return ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key) + f", {rest}"


def _row_sums(rows: DataFrame, model: DataFrame, key: Sequence[str], group: str, x: str, width: int, pieces: Callable, trees: dict | None, extra: Sequence[str], sizes: dict) -> DataFrame:
    """key, n and s: per row the number of its draws and the sum over them of what ``pieces(block, given, chunk)`` yields: (rows, draws, sums [width, row]).

    ``given`` holds the columns ``extra`` of the rows.
    """
    def kernel(a: pa.Table, chunk: Chunk) -> Iterator[dict]:
        s, n = np.zeros((width, a.num_rows)), np.zeros(a.num_rows, np.int64)
        given = {c: array_column(a, c) if pa.types.is_list(a.schema.field(c).type) else _column(a, c).astype(float) for c in extra}
        for at, draws, sums in pieces(a, given, chunk):
            s[:, at] += sums
            n[at] += len(draws)
        yield {**{k: a.column(k) for k in key}, **same(a), "n": pa.array(n), "s": lists(s.T)}

    columns = list(dict.fromkeys([*key, x, "_fit", *([trees["x"]] if trees else []), *extra]))
    model = written(model)
    source = identified(mark_fitted(rows, model, group).select(*columns))
    parts, chunks = product(source, model, kernel, _schema(source, key, f"{SAME}, n bigint, s array<double>"), **sizes)
    return _added(parts, chunks, key, width)


def predictive_shares(
    rows: DataFrame, model: DataFrame, key: Sequence[str], group: str, classes: int, x: str = "x", class_map: Sequence[int] | None = None,
    trees: dict | None = None, out: str = "p", **sizes: int,
) -> DataFrame:
    """Posterior-predictive shares: key, n_draws and the mean over draws of the softmax; ``key`` identifies a row.

    A fitted group uses its own draws, any other the pooled ones. ``trees`` (x, ensembles, cap, centre) adds the tree ensembles of the same draw to the
    linear utilities: capped, and centred over the classes unless told otherwise, which the softmax does not see. It is taken per draw, then averaged.
    ``class_map`` gives the fitted class of every output class; siblings share its probability evenly.
    """
    fitted, place = np.unique(range(classes) if class_map is None else np.asarray(class_map), return_inverse=True)
    siblings = np.bincount(place)[place]

    def pieces(a: pa.Table, given: dict, chunk: Chunk) -> Iterator[tuple]:
        for at, draws, design, b, terms in _matched(a, chunk, x, classes, trees):
            p = shares(design, b[:, fitted], [terms[k] for k in fitted] if terms else ())
            yield at, draws, p.sum(axis=1)[place] / siblings[:, None]

    sums = _row_sums(rows, model, key, group, x, len(place), pieces, trees, [], sizes)
    return sums.select(*key, F.col("n").alias("n_draws"), F.transform("s", lambda v: v / F.col("n")).alias(out))


def ensemble_means(
    rows: DataFrame, model: DataFrame, key: Sequence[str], x: str, ensembles: Sequence[str], cap: float | None = None, out: str = "f", **sizes: int
) -> DataFrame:
    """key and the sum over trees per ensemble, each draw's sum capped at ±cap, averaged over the draws; zeros without any draw."""
    def kernel(a: pa.Table, chunk: Chunk) -> Iterator[dict]:
        design = array_column(a, x)
        s, draws = np.zeros((len(ensembles), a.num_rows)), len(chunk.draws)
        order = nearby(design, chunk.split_on(ensembles), max(1, WORK // (min(draws, NEAR_DRAWS) * len(ensembles))))
        for r, d in slices(len(design), draws, len(ensembles), NEAR_DRAWS):
            at = order[r]
            if d.start == 0:
                grown = Grown(chunk, design[at], ensembles, chunk.draws, cap)
            for k, (flat, _, value) in enumerate(grown.at(d)):
                s[k, at] += flat.sum() + value.sum(axis=0)
        yield {**{k: a.column(k) for k in key}, **same(a), "n": pa.array(np.full(a.num_rows, draws)), "s": lists(s.T)}

    model = written(model)
    source = identified(rows.select(*dict.fromkeys([*key, x])))
    parts, chunks = product(source, model, kernel, _schema(source, key, f"{SAME}, n bigint, s array<double>"), **sizes)
    sums = _added(parts, chunks, key, len(ensembles))
    mean = F.transform("s", lambda v: v / F.col("n"))
    if model.isEmpty():
        return source.select(*key, F.array(*[F.lit(0.0)] * len(ensembles)).alias(out))
    return sums.select(*key, mean.alias(out))


def predictive_counts(
    rows: DataFrame, model: DataFrame, key: Sequence[str], group: str, offset: str, classes: int, x: str = "x", cap: str | None = None,
    trees: dict | None = None, density: bool = False, out: str = "mu", **sizes: int,
) -> DataFrame:
    """Posterior-predictive counts per class: key, n_draws and the mean over draws of r·exp(η + offset).

    Records of kind ``dispersion`` give r per draw and class (1 without them: the mean parameterisation). ``cap`` is an array column of density caps
    per class; it acts on every draw's density, so one exploded draw cannot drag the mean.
    """
    def pieces(a: pa.Table, given: dict, chunk: Chunk) -> Iterator[tuple]:
        for at, draws, u in _utilities(a, chunk, x, classes, trees):
            rate = np.exp(u, out=u)
            if (r := chunk.vectors("dispersion", None, draws)) is not None:
                rate *= r.T[:, :, None]
            if cap:
                np.minimum(rate, given[cap][at].T[:, None, :], out=rate)
            sums = rate.sum(axis=1)
            yield at, draws, sums if density else sums * np.exp(given[offset][at])

    trees = trees and {"centre": False, **trees}
    sums = _row_sums(rows, model, key, group, x, classes, pieces, trees, [offset, *([cap] if cap else [])], sizes)
    return sums.select(*key, F.col("n").alias("n_draws"), F.transform("s", lambda v: v / F.col("n")).alias(out))


def stored_cap(rows: DataFrame, quantiles: DataFrame, which: str, classes: Sequence[str], out: str = "cap") -> DataFrame:
    """Attach the density cap of each class: the stored training quantile ``which`` of ``quantiles(class, quantile, density)``; a missing one is an error."""
    picks = [F.max(F.when((F.col("class") == c) & (F.col("quantile") == which), F.col("density"))) for c in classes]
    checked = [F.coalesce(p, F.raise_error(F.lit(f"no stored quantile {which} for class {c}")).cast("double")) for p, c in zip(picks, classes, strict=True)]
    caps = quantiles.agg(F.array(*checked).alias(out)).withColumn("_one", F.lit(1))  # one row
    return rows.withColumn("_one", F.lit(1)).join(caps, "_one").drop("_one")


def predictive_totals(
    rows: DataFrame, model: DataFrame, by: str, group: str, weight: str, classes: Sequence[str], key: Sequence[str], x: str = "x", **sizes: int,
) -> DataFrame:
    """Weighted class totals per (by, class, draw): every task reduces its block to totals before anything is shuffled again."""
    def kernel(a: pa.Table, chunk: Chunk) -> Iterator[dict]:
        label = a.column("_by").to_numpy(zero_copy_only=False)
        names, code = np.unique(label.astype(str), return_inverse=True)
        w, design = _column(a, "_w").astype(float), array_column(a, x)
        for g, at in by_group(a):
            draws, b = chunk.matrices("coef", g, len(classes), design.shape[1])
            at = at[np.argsort(code[at], kind="stable")]
            for some in np.split(at, np.flatnonzero(np.diff(code[at])) + 1):  # the rows of a name
                total = np.zeros((len(draws), len(classes)))
                for r, d in slices(len(some), len(draws), len(classes)):
                    p = shares(design[some[r]], b[d])
                    total[d] += (p.reshape(-1, p.shape[2]) @ w[some[r]]).reshape(p.shape[:2]).T
                seen = np.flatnonzero(total.any(axis=1))
                yield {by: pa.array(np.repeat(names[code[some[:1]]], len(seen)).astype(str)), "draw": pa.array(np.asarray(draws, np.int64)[seen]), "t": lists(total[seen])}

    model = written(model)
    source = mark_fitted(rows, model, group).select(*key, F.col(by).cast("string").alias("_by"), F.col(weight).cast("double").alias("_w"), "_fit", x)
    parts, _ = product(source, model, kernel, f"`{by}` string, draw bigint, t array<double>", **sizes)
    sums = parts.groupBy(by, "draw").agg(*[F.sum(F.get("t", F.lit(i))).alias(f"_{i}") for i in range(len(classes))])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"_{i}").alias("total")) for i, c in enumerate(classes)]))
    return sums.select(by, "draw", pairs.alias("_e")).select(by, "_e.class", "draw", "_e.total")


def pointwise_moments(rows: DataFrame, model: DataFrame, key: Sequence[str], group: str, classes: int, loglik: Callable, extra: Sequence[str], x: str = "x", **sizes: int) -> DataFrame:
    """key, n, lpd and p: per row the log of the mean likelihood over its draws and the sample variance of the log-likelihood.

    ``loglik(values)`` takes the row values of the columns ``extra`` and gives a function from utilities [class, draw, row], which it may overwrite, to
    [draw, row]. The rows × draws table is never built: a task keeps a
    running maximum, sum of exponentials, mean and sum of squares per row, and chunks are merged by key.
    """
    def kernel(a: pa.Table, chunk: Chunk) -> Iterator[dict]:
        m = a.num_rows
        n, top, s, mean, m2 = np.zeros(m), np.full(m, -np.inf), np.zeros(m), np.zeros(m), np.zeros(m)
        given, last = {c: _column(a, c).astype(float) for c in extra}, None
        for at, draws, u in _utilities(a, chunk, x, classes, None):
            if last is not at:  # draws run faster than rows
                last, of = at, loglik({c: v[at] for c, v in given.items()})
            ll = of(u)
            high = np.maximum(top[at], ll.max(axis=0))
            s[at] = s[at] * np.exp(top[at] - high) + np.exp(ll - high).sum(axis=0)
            top[at] = high
            k, mu = len(ll), ll.mean(axis=0)
            ll -= mu
            np.square(ll, out=ll)
            before, delta = n[at], mu - mean[at]
            m2[at] += ll.sum(axis=0) + delta**2 * before * k / (before + k)
            mean[at] += delta * k / (before + k)
            n[at] += k
        yield {**{c: a.column(c) for c in key}, "n": pa.array(n), "top": pa.array(top), "s": pa.array(s), "mean": pa.array(mean), "m2": pa.array(m2)}

    model = written(model)
    source = mark_fitted(rows, model, group).select(*list(dict.fromkeys([*key, x, "_fit", *extra])))
    parts, _ = product(source, model, kernel, _schema(source, key, "n double, top double, s double, mean double, m2 double"), **sizes)
    merged = parts.where("n > 0").groupBy(*key).agg(F.collect_list(F.struct("n", "top", "s", "mean", "m2")).alias("q"), F.max("top").alias("top"), F.sum("n").alias("n"),
                                                    (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"))  # an entry per chunk
    add = lambda f: F.aggregate("q", F.lit(0.0), lambda t, q: t + f(q))
    lpd = F.col("top") + F.log(add(lambda q: q["s"] * F.exp(q["top"] - F.col("top"))) / F.col("n"))
    spread = add(lambda q: q["m2"] + q["n"] * (q["mean"] - F.col("mean")) * (q["mean"] - F.col("mean")))
    return merged.select(*key, F.col("n").cast("bigint").alias("n"), lpd.alias("lpd"), F.when(F.col("n") > 1, spread / (F.col("n") - 1)).alias("p"))


def partial_dependence(
    rows: DataFrame, model: DataFrame, cols: Sequence[str], var: str, group: str, classes: int, points: int = 50, trees: dict | None = None, **sizes: int
) -> DataFrame:
    """group, point, value and the mean shares over all draws (and their trees) along a grid of one covariate, the others at their means.

    Every fitted group is followed, and the pooled coefficients under the name ``POOLED``.
    """
    means = rows.agg(*[F.avg(c).alias(c) for c in cols if c != var], F.min(var).alias("_lo"), F.max(var).alias("_hi"))  # one row
    grid = means.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    grid = grid.withColumn("value", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("point") / F.lit(float(points - 1)))
    grid = grid.withColumn("x", F.array(*[F.col("value") if c == var else F.col(c) for c in cols])).select("point", "value", "x", F.lit(1).alias("_one"))
    groups = model.where(F.col("kind") == "coef").select(F.col("a").alias(group)).distinct().withColumn("_one", F.lit(1))
    return predictive_shares(grid.join(groups, "_one"), model, [group, "point", "value"], group, classes, trees=trees, **sizes)
