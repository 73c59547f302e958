"""Embedding near-deduplication by int8 tile products with error bounds.

A unit vector is kept as int8 codes with a scale and the norm of its quantisation error. Codes are routed to cells by
random hyperplanes: in each of ``tables`` hash tables a vector's cell is the sign pattern of ``bits`` projections of its
codes, in whole numbers, so that every task finds the same cells. The bits grow with the logarithm of the table, so a
cell of unrelated vectors keeps its size, and the number of tables follows from the bits so that a pair at the threshold
is missed with probability ``MISS`` (nearer pairs far less often). Vectors meet those of their own length alone.

Within a cell, blocks of at most ``tiles.LIMIT`` vectors meet in tiles. A tile multiplies int8 codes, exactly, and
bounds the error of each product. Pairs certainly above the threshold are linked, pairs certainly below it are not;
of the pairs between, the tile names the vectors, and a second pass over these alone fetches them in double precision
and computes those pairs again. A pair that several tables find is counted in the first of them. Tiles return
counts and spanning links, never pairs.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do rows with a null id
(component: their own id). Equal vectors are one class; its members count as each other's links. Rows that share a
vec_id are one node, and each counts. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm import tiles
from marketlens.llm.common import packed, runs, written
from marketlens.llm.graph import components

CELL = 512  # members of a cell, were vectors spread evenly
MISS = 1e-5
NEAR = 0.005  # how much nearer than the threshold codes are still looked for, as rounding turns vectors a little
SLACK = 1e-9  # for the rounding of the bounds themselves


def shape(n: int, threshold: float) -> tuple[int, int]:
    """(bits, tables) for n vectors."""
    agree = 1 - math.acos(max(threshold - NEAR, 0.0)) / math.pi
    bits = max(4, math.ceil(math.log2(max(n, 2) / CELL)))
    return bits, math.ceil(math.log(MISS) / math.log(1 - agree**bits))


def scaled(x: np.ndarray) -> np.ndarray:
    """Finite non-zero vectors times powers of two, so that squares neither vanish nor overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of scaled codes, norms of errors."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None])
    near = codes * scale[:, None]
    return codes.astype(np.int8), scale, np.linalg.norm(near, axis=1), np.linalg.norm(unit - near, axis=1)


def _planes(dim: int, columns: int) -> np.ndarray:
    return np.rint(np.random.default_rng([11, dim]).standard_normal((dim, columns)) * 64)


def cells(codes: np.ndarray, bits: int, tables: int, upto: int | None = None) -> np.ndarray:
    """(n, tables) cells of int8 codes, of the first ``upto`` tables where given; sums of whole numbers, so exact."""
    planes = _planes(codes.shape[1], bits * tables)[:, : bits * (tables if upto is None else upto)]
    signs = (codes.astype(float) @ planes >= 0).reshape(len(codes), -1, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


Side = dict[str, np.ndarray]  # q: codes, s: scales, a: norms of scaled codes, e: norms of errors


def judged(x: Side, y: Side, threshold: float, want: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Gives ``want`` the positions (i, j) of pairs that may reach the threshold, and whether they certainly do."""
    kind = np.float32 if x["q"].shape[1] <= 1024 else float  # in which the products of codes are exact
    qx, qy = x["q"].astype(kind), y["q"].astype(kind)
    for at in range(0, len(qx), 256):
        p = slice(at, at + 256)
        product = (qx[p] @ qy.T).astype(float) * (x["s"][p, None] * y["s"][None, :])
        # |u.v - u'.v'| <= |u'| |e_v| + |e_u| |v|, with |v| = 1
        bound = x["a"][p, None] * y["e"][None, :] + x["e"][p, None] + SLACK
        i, j = np.nonzero(product + bound >= threshold)
        want(i + at, j, (product - bound)[i, j] >= threshold)


def exact(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosines of the rows' pairs reach the threshold, in double precision."""
    return np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)) >= threshold


def _usable(v: Column) -> Column:
    every = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & v.isNotNull() & every & F.exists(v, lambda x: x != 0), F.lit(False))


CODED = "member long, d int, q binary, s double, a double, e double, cells array<long>"


def coded(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """Codes and cells of (member, v); ``cells`` has one of each table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("v")
            sizes = np.diff(np.asarray(vectors.offsets))
            for d in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == d)
                for at in range(0, len(mine), 4096):
                    rows = mine[at : at + 4096]
                    x = scaled(np.asarray(vectors.take(pa.array(rows)).flatten()).reshape(-1, d))
                    q, s, a, e = quantised(x / np.linalg.norm(x, axis=1)[:, None])
                    found = cells(q, bits, tables)
                    lists = pa.ListArray.from_arrays(np.arange(len(q) + 1, dtype=np.int32) * tables, pa.array(found.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column("member").take(pa.array(rows)), pa.array(np.full(len(q), d, np.int32)), packed(q), pa.array(s), pa.array(a), pa.array(e), lists], [f.split()[0] for f in CODED.split(", ")])

    return classes.select("member", "v").mapInArrow(work, CODED)


def _tiled(rows: DataFrame, doubles: bool, threshold: float, bits: int, tables: int, schema: str) -> DataFrame:
    """Tiles over (key, lo, hi, block, t, member, rep, copies, d, q, s, a, e), with v where ``doubles``.

    Without doubles: (member, links, a, b) of certain links, and (key, lo, hi, block, t, member) of vectors with a pair
    in doubt. With them: the links of the pairs in doubt.
    """
    plain = ["key", "lo", "hi", "block", "t", "member", "rep", "copies", "d", "s", "a", "e"]
    names = [f.split()[0] for f in schema.split(", ")]

    def load(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        cols = {k: np.asarray(batch.column(k)) for k in plain}
        for k in ["q", *(["v"] if doubles else [])]:
            cols[k] = np.empty(batch.num_rows, object)
            cols[k][:] = batch.column(k).to_pylist()
        return cols

    def tile(c: dict[str, np.ndarray]) -> list[tuple]:
        lo, hi, t = int(c["lo"][0]), int(c["hi"][0]), int(c["t"][0])
        c = c | {"q": np.frombuffer(b"".join(c["q"]), np.int8).reshape(len(c["q"]), -1)}
        x, y = tiles.sides(c["block"], lo, hi)
        if not len(x) or not len(y):
            return []
        full = scaled(np.array(c["v"].tolist(), float)) if doubles else None
        sure: list[np.ndarray] = []
        doubt = np.zeros(len(c["member"]), bool)

        def first(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Whether no table before this one has the pair in one cell."""
            some, place = np.unique(np.concatenate([i, j]), return_inverse=True)
            own = cells(c["q"][some], bits, tables, t)
            i, j = place[: len(i)], place[len(i) :]
            return np.concatenate([~(own[i[k : k + 65536]] == own[j[k : k + 65536]]).any(axis=1) for k in range(0, len(i), 65536)])

        def take(i: np.ndarray, j: np.ndarray, certain: np.ndarray) -> None:
            i, j = x[i], y[j]
            if lo == hi:
                once = i < j
                i, j, certain = i[once], j[once], certain[once]
            if t and len(i):
                new = first(i, j)
                i, j, certain = i[new], j[new], certain[new]
            open_i, open_j = i[~certain], j[~certain]
            if doubles:
                yes = exact(full[open_i], full[open_j], threshold) if len(open_i) else np.zeros(0, bool)
                sure.append(np.stack([open_i[yes], open_j[yes]]))
            else:
                doubt[open_i] = doubt[open_j] = True
                sure.append(np.stack([i[certain], j[certain]]))

        side = lambda at: {k: c[k][at] for k in "qsae"}
        judged(side(x), side(y), threshold, take)
        i, j = np.concatenate(sure, axis=1)
        n = len(c["member"])
        links = np.bincount(i, c["copies"][j], n) + np.bincount(j, c["copies"][i], n)
        root = tiles.spanning(n, i, j)
        some = np.flatnonzero(links)
        out = {"member": c["member"][some], "links": links[some].astype(np.int64), "a": c["rep"][some], "b": c["rep"][root[some]]}
        more = {k: c[k][doubt] for k in ("key", "lo", "hi", "block", "t", "member")}
        return [z for z in (out, more) if len(z["member"])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = dict(f.split() for f in schema.split(", "))
        for cols, bounds in runs(batches, ["key", "d", "t", "lo", "hi"], load):
            out = [z for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()) if e - s > 1 for z in tile({k: v[s:e] for k, v in cols.items()})]
            for z in out:
                n = len(z["member"])
                types = {"int": pa.int32(), "long": pa.int64()}
                yield pa.RecordBatch.from_arrays([pa.array(z[k], types[kinds[k]]) if k in z else pa.nulls(n, types[kinds[k]]) for k in names], names)

    order = ["key", "d", "t", "lo", "hi"]
    return rows.repartition("key", "lo", "hi").sortWithinPartitions(*order).mapInArrow(work, schema)


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each vector."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"))
    good = rows.filter(_usable(F.col("v")))
    alike = good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = written(alike.select(F.monotonically_increasing_id().alias("member"), "rep", "copies", "v"), "vector-classes")  # numbered once, as they are written
    bits, tables = shape(classes.count(), threshold)
    codes = written(coded(classes, bits, tables), "vector-codes")

    narrow = codes.select("member", "d", F.posexplode("cells").alias("t", "cell")).withColumn("key", F.xxhash64("d", "t", "cell"))
    dealt = tiles.dealt(narrow.select("key", "member", "t"), "key", "member")
    facts = codes.drop("cells").join(classes.select("member", "rep", "copies"), "member")
    marks = "key long, lo int, hi int, block int, t int"
    first = written(_tiled(dealt.join(facts.hint("merge"), "member"), False, threshold, bits, tables, f"member long, links long, a long, b long, {marks}"), "vector-links")
    doubtful = first.filter("key is not null").select("key", "lo", "hi", "block", "t", "member")
    again = doubtful.join(facts.join(classes.select("member", "v"), "member").hint("merge"), "member")
    second = written(_tiled(again, True, threshold, bits, tables, "member long, links long, a long, b long"), "vector-doubts")
    found = first.filter("key is null").select("member", "links", "a", "b").unionByName(second)

    counts = found.groupBy("member").agg(F.sum("links").alias("links"))
    links = found.select("a", "b")
    parts = components(_same_rows(good).unionByName(links) if _repeats(good) else links)
    totals = classes.join(counts, "member", "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    totals = totals.select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = good.join(totals, "v").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~_usable(F.col("v"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _repeats(good: DataFrame) -> bool:
    return bool(good.groupBy("vec_id").count().filter("count > 1").head(1))


def _same_rows(good: DataFrame) -> DataFrame:
    """Links between the vectors of rows that share an id."""
    first = good.groupBy("v").agg(F.min("vec_id").alias("b"))
    return good.select(F.col("vec_id").alias("a"), "v").join(first, "v").select("a", "b")
