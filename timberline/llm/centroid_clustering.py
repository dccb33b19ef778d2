"""Exact k-means over integer vectors, with geometric drift tightening.

Every vector carries a lower bound on its distance to all centroids but its own. A vector that is nearer to its own
centroid than the bound keeps it unseen by the others; only ambiguous vectors are held against every centroid. When
centroids move, the bound has to be loosened. Full drift would take the longest way any centroid went. Here the members
of a cluster lie in a sphere around its old centroid, on its side of the bisector to any other centroid. That other
centroid's way is looked at in the plane of the way and the sphere's centre: seen from where it stood, the members lie in
a cone, whose sides touch the sphere or meet it in the bisector, and the distance to none of them shrinks by more than
the way times the cosine of the smallest angle between the way and that cone. A centroid that goes sideways or away
loosens little, or even tightens. Distances are whole numbers; the bound is rounded down,
and a vector passes only if it is strictly nearer, so ties always go to the scan and to the smaller number.

Each round is one pass over the written state (vector, cluster, bound) without shuffle; tasks send sums per cluster
and component, so the driver holds k centroids and never a vector. The state of a round is removed once the next one is
written. A cluster may hold any share of the vectors.

Vectors that are null, of another length, or hold a null, a NaN or an infinity are left out. Components beyond 2^27 after
scaling raise an error, as squared distances would not fit a long. Repeated rows and ids count each; equal hashes are
taken in the order of the vectors' bytes; a null id counts as the text ''. With fewer vectors than k, each is a
centroid; without any, the result is empty. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.session import scratch_path
from timberline.sources import storage

MOST = 1 << 27
# Far above the rounding of a few operations on doubles, far below one unit of any bound that decides.
SLACK = 1e-11
POINTS = "vec_id bigint, v binary"
STATE = f"{POINTS}, cluster int, distance bigint, bound double, scanned boolean"
# Items of a cluster's sums after its components.
COUNT, FARTHEST, INERTIA, SCANNED = range(-4, 0)


@dataclass(frozen=True)
class Clustering:
    """``assigned``: ``vec_id, cluster, distance``; the rest by cluster number, ``scanned`` by pass."""

    assigned: DataFrame
    centroids: list[list[int]]
    sizes: list[int]
    inertia: list[int]
    scanned: list[int]


def points(embeddings: DataFrame, dim: int, scale: int) -> DataFrame:
    """Usable vectors as whole numbers ``floor(scale * x)``, little-endian 32-bit."""
    def work(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            whole = pc.equal(pc.list_value_length(batch.column("embedding")), dim).fill_null(False)
            batch = batch.filter(whole)
            flat = batch.column("embedding").flatten().cast(pa.float64())
            x = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)
            usable = np.isfinite(x).all(1)
            v = np.floor(scale * x[usable])
            if v.size and np.abs(v).max() > MOST:
                raise ValueError(f"a scaled component is beyond {MOST}")
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").filter(pa.array(usable)), _rows(v.astype("<i4"))], names=["vec_id", "v"]
            )

    return embeddings.select("vec_id", "embedding").mapInArrow(work, POINTS)


def _rows(matrix):
    """One binary value per row of a matrix."""
    import pyarrow as pa

    width = matrix.shape[1] * matrix.itemsize
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(matrix), [None, pa.py_buffer(matrix.tobytes())])
    return fixed.cast(pa.binary())


def _matrix(column, dim: int):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dim).astype(np.int64)


def loosening(centroids, moved, radii):
    """By how much the distance from any member of cluster i to centroid j may have shrunk: row i, column j.

    Members are those nearer to ``centroids[i]`` than to any other, within ``radii[i]`` of it.
    """
    import numpy as np

    c, way = np.asarray(centroids, float), np.asarray(moved, float) - np.asarray(centroids, float)
    drift = np.sqrt((way ** 2).sum(1))
    out = np.zeros((len(c), len(c)))
    for i, radius in enumerate(radii):
        for j in np.flatnonzero(drift):
            toward = c[i] - c[j]
            apart = np.sqrt((toward ** 2).sum())
            if not apart:
                out[i, j] = drift[j]
                continue
            # The cone that holds the members, by half its opening: its sides touch the sphere, or meet it in the bisector.
            if 2 * radius ** 2 <= apart ** 2:
                sine = radius / apart
                cosine = np.sqrt(1 - sine ** 2)
            else:
                cosine = apart / (2 * radius)
                sine = np.sqrt(1 - cosine ** 2)
            along = (toward @ way[j]) / (drift[j] * apart)  # the way against the cone's axis, in their plane
            beside = np.sqrt(max(0.0, 1 - along ** 2))
            out[i, j] = drift[j] * (1.0 if along >= cosine else along * cosine + beside * sine)
    return out + SLACK * (np.abs(out) + drift.max(initial=0.0))


def full_drift(centroids, moved, radii):
    """The plain bound: every centroid's whole way."""
    import numpy as np

    drift = np.sqrt(((np.asarray(moved, float) - np.asarray(centroids, float)) ** 2).sum(1))
    return np.tile(drift, (len(radii), 1))


def _looser(loosen):
    """What the members of each cluster lose: the largest loss against another centroid."""
    import numpy as np

    others = np.where(np.eye(len(loosen), dtype=bool), -np.inf, loosen)
    return others.max(1) if len(loosen) > 1 else np.zeros(len(loosen))


def assign(v, centroids, cluster, bound):
    """New cluster, squared distance, bound, and which vectors were held against all centroids."""
    import numpy as np

    distance = ((v - centroids[np.maximum(cluster, 0)]) ** 2).sum(1)
    scan = (cluster < 0) | ~(np.sqrt(distance) * (1 + SLACK) < bound)
    if scan.any():
        every = np.stack([((v[scan] - c) ** 2).sum(1) for c in centroids], axis=1)
        nearest = every.argmin(1)
        row = np.arange(len(every))
        cluster, distance, bound = cluster.copy(), distance.copy(), bound.copy()
        cluster[scan], distance[scan] = nearest, every[row, nearest]
        if every.shape[1] > 1:
            bound[scan] = np.sqrt(np.partition(every, 1, axis=1)[:, 1]) * (1 - SLACK)
        else:
            bound[scan] = np.inf
    return cluster, distance, bound, scan


def _pass(state: DataFrame, centroids, loss, dim: int) -> DataFrame:
    """One assignment of every vector; ``loss`` is None in the first."""
    def work(batches):
        import numpy as np
        import pyarrow as pa

        c = np.asarray(centroids, np.int64)
        for batch in batches:
            v = _matrix(batch.column("v"), dim)
            if loss is None:
                before, bound = np.full(len(v), -1), np.zeros(len(v))
            else:
                before = batch.column("cluster").to_numpy().astype(np.int64)
                bound = batch.column("bound").to_numpy()
                bound = bound - loss[before] - SLACK * np.abs(bound)
            cluster, distance, bound, scan = assign(v, c, before, bound)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()),
                 pa.array(bound, pa.float64()), pa.array(scan)],
                names=["vec_id", "v", "cluster", "distance", "bound", "scanned"],
            )

    return state.mapInArrow(work, STATE)


def _sums(state: DataFrame, k: int, dim: int):
    """Per cluster: sums of the components, count, largest distance, summed distance, vectors scanned."""
    def work(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros((k, dim + 4), np.int64)
        for batch in batches:
            v, cluster = _matrix(batch.column("v"), dim), batch.column("cluster").to_numpy()
            distance, scanned = batch.column("distance").to_numpy(), np.asarray(batch.column("scanned").to_pylist(), np.int64)
            for i in np.unique(cluster):
                mine = cluster == i
                total[i, :dim] += v[mine].sum(0)
                total[i, COUNT] += mine.sum()
                total[i, FARTHEST] = max(total[i, FARTHEST], distance[mine].max())
                total[i, INERTIA] += distance[mine].sum()
                total[i, SCANNED] += scanned[mine].sum()
        at, item = np.indices(total.shape)
        used = total.ravel() != 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(x.ravel()[used], pa.int64()) for x in (at, item, total)], names=["cluster", "item", "value"]
        )

    rows = state.select("v", "cluster", "distance", "scanned").mapInArrow(work, "cluster bigint, item bigint, value bigint")
    found = rows.groupBy("cluster", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("sum"), F.max("value").alias("most"))
    out = [[0] * (dim + 4) for _ in range(k)]
    for r in found.collect():  # at most k * (dim + 4) rows
        out[r.cluster][r.item] = int(r.most if r.item == dim + 4 + FARTHEST else r["sum"])
    return out


def cluster(
    embeddings: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, loosen=loosening
) -> Clustering:
    """``rounds`` rounds from the ``k`` vectors of smallest SHA-256 of ``seed:vec_id``, then one more assignment."""
    import numpy as np

    spark = embeddings.sparkSession

    def written(df: DataFrame) -> tuple[DataFrame, str]:
        path = scratch_path(spark, "clusters")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    state, path = written(points(embeddings, dim, scale))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = state.select(drawn.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    if not first:
        return Clustering(spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), [], [], [], [])
    centroids = [np.frombuffer(r.v, "<i4").tolist() for r in first]
    loss, scanned = None, []
    for step in range(rounds + 1):
        state, fresh = written(_pass(state, centroids, loss, dim))
        storage.remove(spark, path)
        path = fresh
        sums = _sums(state, len(centroids), dim)
        scanned.append(sum(s[SCANNED] for s in sums))
        if step < rounds:
            moved = [[x // s[COUNT] for x in s[:dim]] if s[COUNT] else c for s, c in zip(sums, centroids)]
            loss = _looser(loosen(centroids, moved, [np.sqrt(s[FARTHEST]) * (1 + SLACK) for s in sums]))
            centroids = moved
    return Clustering(
        state.select("vec_id", "cluster", "distance"), centroids,
        [s[COUNT] for s in sums], [s[INERTIA] for s in sums], scanned,
    )
