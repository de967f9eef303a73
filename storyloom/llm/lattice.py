"""Near-duplicate embeddings by lattice hashing with E8 points.

Each of ``TABLES`` tables projects the unit vectors on ``BLOCKS`` times 8 random orthonormal
directions, scales them and decodes every 8 coordinates to the nearest point of the E8
lattice; the points together name a cell.  A vector enters its own cell and those in which
one block is replaced by the nearest point of the other coset (or, where nearer, the second
point of its own coset), so neighbours across a cell's face still meet.

Only cells with several members count, and of cells with the same members one.  In cells of at most ``SMALL`` members every pair is made
on the JVM from the cell rows, which carry ``SIGNS`` sign bits of random directions: pairs of
which more than ``DIFFER`` bits differ are far from the threshold (over five standard errors) and
go at once.  The pairs left, each once, fetch their vectors and are verified by cosine in double
precision.  In larger cells, whose pairs would grow with the square, members are compared in
blocks of at most ``BLOCK_ROWS``, and a block hands on a spanning forest of its links.

Components are those of all links found.  A vector's links are counted in two parts: pairs of
which one is in no large cell were all verified one by one; pairs of two members of large cells
are compared again inside their component, block by block, so none is missing.  A long chain of
vectors in small cells so costs its links, not the square of its length.  Equal vectors are one
row with a multiplicity throughout.  ``tests/llm`` measures the recall of the cells at cosine
0.95 (above 0.995 of pairs at the very threshold) and holds links and components against brute force.

Defined results: null or zero vectors and vectors with null or non-finite components link with
nothing; vectors link within their length, each length by a join of its own; repeated rows link
with each other, and rows that repeat a vec_id with other vectors are vectors of their own; a
null vec_id links like any other but is never a least id; of equal cosines all that reach the
threshold link; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .cluster import components, staged

TABLES, BLOCKS, SCALE, BLOCK_ROWS = 12, 3, 3.0, 1024
#: Cells up to this size give pairs; sign bits of a vector, and how many may differ in a pair.
#: At cosine 0.95 a bit differs with chance 0.101: 12.9 of 128 are expected, 3.4 the standard error.
SMALL, SIGNS, DIFFER = 16, 128, 32


def decode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Twice the nearest E8 point of each row, and twice the runner-up."""
    n = np.arange(len(x))

    def even(y):
        near = np.rint(y)
        gap = y - near
        order = np.argsort(-np.abs(gap), axis=1)
        way = np.where(gap >= 0, 1.0, -1.0)
        flip, both = near.copy(), near.copy()
        k = order[:, 0]
        flip[n, k] += way[n, k]
        odd = near.sum(axis=1) % 2 != 0
        # The second point of the same coset turns the two least certain coordinates.
        k2 = order[:, 1]
        both[n, k] += way[n, k]
        both[n, k2] += way[n, k2]
        other = near.copy()
        other[n, k2] += way[n, k2]
        return np.where(odd[:, None], flip, near), np.where(odd[:, None], other, both)

    a, a2 = even(x)
    b, b2 = even(x - 0.5)
    points = np.stack([2 * a, 2 * a2, 2 * b + 1, 2 * b2 + 1])
    far = ((points / 2 - x) ** 2).sum(axis=2)
    order = np.argsort(far, axis=0, kind="stable")
    return points[order[0], n].astype(np.int64), points[order[1], n].astype(np.int64)


def _project(dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    width = 8 * BLOCKS
    out = np.empty((TABLES, dim, width))
    for t in range(TABLES):
        g = rng.standard_normal((max(dim, width), width))
        out[t] = np.linalg.qr(g)[0][:dim] * SCALE * np.sqrt(dim / 64)
    return out, rng.random((TABLES, width))


def _units(column: pa.Array, dim: int) -> np.ndarray:
    """Unit rows in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _cells(dim: int):
    def of(batches):
        from . import words

        directions, shift = _project(dim)
        signs = np.random.default_rng(13).standard_normal((dim, SIGNS))
        for batch in batches:
            if not len(batch):
                continue
            unit = _units(batch.column(1), dim)
            out = np.empty((len(unit), TABLES, BLOCKS + 1), np.uint64)
            for t in range(TABLES):
                y = unit @ directions[t] + shift[t]
                code = np.empty((2, BLOCKS, len(unit)), np.uint64)
                for b in range(BLOCKS):
                    for k, point in enumerate(decode(y[:, 8 * b : 8 * b + 8])):
                        code[k, b] = words.combine([point[:, j].astype(np.uint64) for j in range(8)])
                table = np.full(len(unit), t, np.uint64)
                for probe in range(BLOCKS + 1):
                    out[:, t, probe] = words.combine([table, *(code[int(b + 1 == probe), b] for b in range(BLOCKS))])
            # Cells of one vector are told apart, else it would meet itself.
            flat = np.sort(out.reshape(len(unit), -1), axis=1)
            keep = np.concatenate([np.ones((len(unit), 1), bool), flat[:, 1:] != flat[:, :-1]], axis=1)
            count = keep.sum(axis=1)
            bits = np.packbits(unit @ signs > 0, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[keep].view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), count)), *(pa.array(np.repeat(bits[:, k], count)) for k in range(SIGNS // 64))],
                names=["cell", "id", *(f"s{k}" for k in range(SIGNS // 64))],
            )

    return of


def _in_blocks(rows: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """Rows dealt to block pairs (key, x, y): any two rows of a key meet in one pair of at most 2 * BLOCK_ROWS rows."""
    parts = sizes.select(key, F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("parts"))
    cut = rows.join(parts, key).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    cut = cut.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return cut.withColumn("x", F.least("part", "mate")).withColumn("y", F.greatest("part", "mate")).drop("mate", "parts")


def _pairs(members: DataFrame) -> DataFrame:
    """(a, b), a < b, each once: members of one small cell whose sign bits do not rule a link out."""
    names = ["id", *(f"s{k}" for k in range(SIGNS // 64))]
    x, y = (members.select("cell", *(F.col(c).alias(f"{side}_{c}") for c in names)) for side in "xy")
    differ = sum((F.bit_count(F.col(f"x_s{k}").bitwiseXOR(F.col(f"y_s{k}"))) for k in range(SIGNS // 64)), F.lit(0))
    met = x.join(y, (x["cell"] == y["cell"]) & (F.col("x_id") < F.col("y_id")) & (differ <= DIFFER))
    return met.select(F.col("x_id").alias("a"), F.col("y_id").alias("b")).distinct()


def _verified(dim: int, least: float):
    """Pairs (a, b, va, vb, ...) whose cosine reaches the threshold, without the vectors."""

    def of(batches):
        for batch in batches:
            if len(batch):
                near = (_units(batch.column(2), dim) * _units(batch.column(3), dim)).sum(axis=1) >= least
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near))

    return of


def _table(table: pa.Table, dim: int):
    ids, part = table.column("id").to_numpy(), table.column("part").to_numpy()
    x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
    unit = _units(table.column("v").combine_chunks(), dim)
    return ids, unit, np.flatnonzero(part == x), np.flatnonzero(part == y), x == y


def _forest(dim: int, least: float):
    def of(table: pa.Table) -> pa.Table:
        ids, unit, left, right, _ = _table(table, dim)
        root = np.arange(len(ids))

        def find(k):
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        a, b = [], []
        for at in range(0, len(left), 256):
            part = left[at : at + 256]
            i, j = np.nonzero(unit[part] @ unit[right].T >= least)
            for p, q in zip(part[i].tolist(), right[j].tolist(), strict=True):
                p0, q0 = find(p), find(q)
                if p0 != q0:
                    root[max(p0, q0)] = min(p0, q0)
                    a.append(ids[p])
                    b.append(ids[q])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return of


def _count(dim: int, least: float):
    def of(table: pa.Table) -> pa.Table:
        ids, unit, left, right, same = _table(table, dim)
        weight = table.column("copies").to_numpy()
        total = np.zeros(len(ids), np.int64)
        for at in range(0, len(left), 256):
            part = left[at : at + 256]
            near = unit[part] @ unit[right].T >= least
            # A row always links with itself, whatever rounding says.
            if same:
                near[part[:, None] == right[None, :]] = True
            total[part] += near @ weight[right]
            if not same:
                total[right] += weight[part] @ near
        return pa.table({"id": pa.array(ids), "n": pa.array(total)})

    return of


def near_vectors(rows: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links (other rows of cosine >= least), component_id, kept."""
    source = rows.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("v"))
    inf = F.lit(float("inf")).cast("double")
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e).cast("double") < inf)) & F.exists("v", lambda e: e != 0)
    source = source.withColumn("fine", F.coalesce(fine, F.lit(False)))
    lengths = [r["dim"] for r in source.filter("fine").select(F.size("v").alias("dim")).distinct().orderBy("dim").collect()]
    out = source.filter(~F.col("fine")).select(F.col("_id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"), F.lit(True).alias("kept"))
    for dim in lengths:
        out = _of_length(source.filter(F.col("fine") & (F.size("v") == dim)), dim, least).union(out)
    return out


def _of_length(source: DataFrame, dim: int, least: float) -> DataFrame:
    """The same of vectors that are all of length ``dim`` and none of them zero."""
    good = staged(source.withColumn("key", F.sha2(F.transform("v", lambda e: e + F.lit(0.0).cast("float")).cast("string").cast("binary"), 256)).select("_id", "key", "v"), "lattice-rows")
    classes = good.groupBy("key").agg(F.min("_id").alias("low"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = staged(classes.withColumn("id", F.monotonically_increasing_id()), "lattice-classes")
    vectors = classes.select("id", "copies", "v")
    schema = ", ".join(["cell long, id long", *(f"s{k} long" for k in range(SIGNS // 64))])
    cells = staged(vectors.select("id", "v").mapInArrow(_cells(dim), schema), "lattice-cells")
    members = F.xxhash64("id")
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"), F.bit_xor(members).alias("mark"), F.min("id").alias("lo"), F.max("id").alias("hi")).filter("n > 1")
    # Tables often give one and the same set of members: each set is compared in one of its cells.
    sizes = staged(sizes.groupBy("n", "mark", "lo", "hi").agg(F.min("cell").alias("cell")).select("cell", "n"), "lattice-sizes")
    leads = staged(_pairs(cells.join(sizes.filter(F.col("n") <= SMALL).select("cell"), "cell")), "lattice-pairs")
    both = leads.join(vectors.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(vectors.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    pairs = staged(both.select("a", "b", "va", "vb").mapInArrow(_verified(dim, least), "a long, b long"), "lattice-near")

    large = sizes.filter(F.col("n") > SMALL)
    crowded = staged(cells.select("cell", "id").join(large, "cell").drop("n"), "lattice-crowded")
    met = _in_blocks(crowded, "cell", large).join(vectors.select("id", "v"), "id").select("cell", "id", "part", "x", "y", "v")
    forest = met.groupBy("cell", "x", "y").applyInArrow(_forest(dim, least), "a long, b long")
    links = staged(pairs.union(forest.select(F.least("a", "b"), F.greatest("a", "b"))).distinct(), "lattice-links")
    labels = staged(components(links, "lattice-components"), "lattice-labels").withColumnRenamed("node", "id")

    dense = staged(crowded.select("id").distinct().join(labels, "id"), "lattice-dense")
    inner = staged(dense.groupBy("comp").agg(F.count("*").alias("n")), "lattice-dense-sizes")
    again = _in_blocks(dense, "comp", inner).join(vectors, "id").select("comp", "id", "part", "x", "y", "v", "copies")
    counted = again.groupBy("comp", "x", "y").applyInArrow(_count(dim, least), "id long, n long")
    marks = dense.select("id", F.lit(True).alias("dense"))
    ends = pairs.join(marks.select(F.col("id").alias("a"), F.col("dense").alias("da")), "a", "left").join(marks.select(F.col("id").alias("b"), F.col("dense").alias("db")), "b", "left")
    ends = ends.filter("da IS NULL OR db IS NULL").select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("mate")), F.struct(F.col("b").alias("id"), F.col("a").alias("mate")))).alias("e")).select("e.*")
    ends = ends.join(vectors.select(F.col("id").alias("mate"), "copies"), "mate").select("id", F.col("copies").alias("n"))
    # A block counts a row among its own links; of a row that is in no block the copies are added here.
    own = vectors.select("id", "copies").join(marks, "id", "left").select("id", F.when(F.col("dense"), F.lit(0)).otherwise(F.col("copies")).alias("n"))
    total = own.unionByName(counted).unionByName(ends).groupBy("id").agg(F.sum("n").alias("n"))
    lows = labels.join(classes.select("id", "low"), "id").groupBy("comp").agg(F.min("low").alias("least"))
    of_class = classes.select("key", "id", "low").join(total, "id").join(staged(labels.join(lows, "comp").select("id", "least"), "lattice-least"), "id", "left")
    of_class = of_class.select("key", (F.col("n") - 1).alias("n_links"), F.coalesce("least", "low").alias("component_id"))
    return good.select("_id", "key").join(of_class, "key").select(F.col("_id").alias("vec_id"), "n_links", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))
