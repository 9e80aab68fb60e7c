"""Approximate nearest neighbours by score-aware (anisotropic) quantisation.

Vectors are cut into subspaces of a few dimensions, each quantised to one of 16 centroids, so a code takes four bits. Codes are chosen to
lessen a weighted error: the part of the residual parallel to the vector, which changes inner products of near vectors most, weighs more than the rest. Scans
add up, for each vector, 16-entry tables of the query's inner products; the best of each block are ranked again by exact Euclidean
distance. Least distance is greatest inner product less half the squared norm, so the search is one for inner products.

Codebooks are fitted on a bounded sample. Queries and vectors travel in blocks of rows, every block of queries meets every block of vectors, and
each meeting leaves the nearest few for each query.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import column, materialize

#: Bound of the sample that codebooks are fitted on: the vectors of least hash.
SAMPLE = 16_384
SUBSPACE = 2
CENTROIDS = 16
#: Weight of the residual's parallel part against the rest.
PARALLEL = 4.0
ROUNDS = 8
SEED = 11
#: Rows of a block of vectors and of queries, and how many of a block's distinct vectors are ranked again for each query.
BLOCK, QUERIES = 4096, 256
AGAIN = 160


@dataclass(frozen=True)
class Codebooks:
    """dim, and centroids by subspace: (subspaces, 16, SUBSPACE); the last subspace is padded with zeros."""

    dim: int
    centroids: np.ndarray


def _cut(x: np.ndarray) -> np.ndarray:
    pad = -x.shape[1] % SUBSPACE
    return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, SUBSPACE)


def encode(x: np.ndarray, books: Codebooks, weight: float = PARALLEL, passes: int = 2) -> np.ndarray:
    """Codes (rows, subspaces): least plain error first, then each subspace in turn to lessen the weighted error."""
    parts, c = _cut(x), books.centroids
    norm = np.maximum(np.sqrt((x * x).sum(1)), 1e-30)
    unit = _cut(x / norm[:, None])
    codes = np.empty(parts.shape[:2], np.uint8)
    along = np.zeros(len(x))
    for s in range(parts.shape[1]):
        codes[:, s] = (-2 * parts[:, s] @ c[s].T + (c[s] ** 2).sum(1)).argmin(1)
        along += ((parts[:, s] - c[s][codes[:, s]]) * unit[:, s]).sum(1)
    for _ in range(passes):
        for s in range(parts.shape[1]):
            rest = along - ((parts[:, s] - c[s][codes[:, s]]) * unit[:, s]).sum(1)
            residual = parts[:, s, None, :] - c[s][None]
            mine = (residual * unit[:, s, None, :]).sum(2)
            error = (residual**2).sum(2) + (weight - 1) * (rest[:, None] + mine) ** 2
            codes[:, s] = error.argmin(1)
            along = rest + mine[np.arange(len(x)), codes[:, s]]
    return codes


def fit(x: np.ndarray, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks by alternating weighted codes and means; deterministic in the sample's order."""
    rng = np.random.default_rng(SEED)
    parts = _cut(x)
    pick = rng.choice(len(x), CENTROIDS, replace=len(x) < CENTROIDS)
    books = Codebooks(x.shape[1], np.ascontiguousarray(parts[pick].transpose(1, 0, 2)))
    for r in range(rounds):
        codes = encode(x, books, PARALLEL if r >= rounds // 2 else 1.0, 1)
        for s in range(parts.shape[1]):
            n = np.bincount(codes[:, s], minlength=CENTROIDS)
            for d in range(SUBSPACE):
                total = np.bincount(codes[:, s], parts[:, s, d], CENTROIDS)
                books.centroids[s, :, d] = np.where(n > 0, total / np.maximum(n, 1), books.centroids[s, :, d])
    return books


def nearest(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, codes: np.ndarray, books: Codebooks, k: int, again: int) -> list[tuple[int, int, float]]:
    """(place of the query, id, distance) of each query's k nearest ids in a block whose ids are sorted and whose pairs of id and vector are distinct.

    Equal vectors are scanned once; each has its k least ids (and one) ranked. Of the vectors of one id the nearest counts: where ids stand more
    than once, as many vectors are ranked again as hold `again` ids.
    """
    kinds, first, kind = np.unique(x, axis=0, return_index=True, return_inverse=True)
    kind = kind.reshape(-1)
    order = np.argsort(kind, kind="stable")
    starts = np.searchsorted(kind[order], np.arange(len(kinds) + 1))
    tables = np.einsum("qsd,scd->qsc", _cut(queries), books.centroids)
    scores = np.zeros((len(queries), len(kinds)))
    for s in range(codes.shape[1]):
        scores += tables[:, s][:, codes[first, s]]
    scores -= (kinds * kinds).sum(1) / 2
    best = np.argpartition(-scores, again - 1, axis=1)[:, :again] if again < len(kinds) else np.broadcast_to(np.arange(len(kinds)), scores.shape)
    wanted = min(again, len(np.unique(ids)))
    repeated = len(np.unique(ids)) < len(ids)
    out = []
    for place, (q, own, some, score) in enumerate(zip(queries, query_ids, best, scores, strict=True)):
        rows = np.concatenate([order[starts[j] : min(starts[j + 1], starts[j] + k + 1)] for j in some])
        while repeated and len(some) < len(kinds) and len(np.unique(ids[rows])) < wanted:
            some = np.argsort(-score, kind="stable")[: 2 * len(some)]
            rows = np.concatenate([order[starts[j] : min(starts[j + 1], starts[j] + k + 1)] for j in some])
        distance = np.sqrt(((kinds[some] - q) ** 2).sum(1))
        far = np.repeat(distance, [min(starts[j + 1] - starts[j], k + 1) for j in some])
        other = ids[rows] != own
        rows, far = rows[other], far[other]
        ranked = np.lexsort((ids[rows], far))
        if repeated:
            ranked = ranked[np.sort(np.unique(ids[rows[ranked]], return_index=True)[1])]
        for i in ranked[:k]:
            out.append((place, int(ids[rows[i]]), float(far[i])))
    return out


def _usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, x): ids with vectors that aren't null, empty or zero, and hold neither null nor non-finite components."""
    x = F.transform(column(vector), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = df.select(column(vec_id).cast("long").alias("id"), x.alias("x"), fine.alias("fine"))
    return rows.where("id is not null and fine and size(x) > 0").where(F.exists("x", lambda v: v != 0)).select("id", "x")


def search(df: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", *, k: int = 10, sample: int = SAMPLE, again: int = AGAIN, block_rows: int = BLOCK) -> DataFrame:
    """The k nearest rows of df (all, if fewer) to each row of queries, other ids than its own: query_id, rank from 1, vec_id, score.

    score is the exact Euclidean distance in double precision; ties go to the smaller vec_id. Vectors that are null, empty or zero, or hold a null or
    non-finite component, take no part. A query meets the vectors of as many components as its own; each such number is searched by itself, so the work
    grows with how many of them queries have. Rows with equal vectors are all candidates; a row repeated with its id is one candidate, and an id with several
    vectors stands once, with the nearest. A query repeated with its vector is one query; of an id with several vectors each is searched, with ranks of
    its own under the one query_id. Empty tables give no rows. Other columns aren't used, whatever their names.
    """
    asked = materialize(_usable(queries, vec_id, vector).dropDuplicates(["id", "x"]), "queries")
    usable = _usable(df, vec_id, vector)
    lengths = sorted(r["d"] for r in asked.select(F.size("x").alias("d")).distinct().collect())
    parts = [_of_length(usable.where(F.size("x") == d), asked.where(F.size("x") == d), d, k, sample, again, block_rows) for d in lengths]
    schema = "query_id long, rank int, vec_id long, score double"
    found = [part for part in parts if part is not None]
    return reduce(DataFrame.union, found) if found else df.sparkSession.createDataFrame([], schema)


def _of_length(usable: DataFrame, asked: DataFrame, dim: int, k: int, sample: int, again: int, block_rows: int) -> DataFrame | None:
    """The search among vectors of `dim` components; None without any."""
    spark = usable.sparkSession
    rows = materialize(usable.dropDuplicates(["id", "x"]), "vectors")
    drawn = rows.select("x", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(sample).collect()
    if not drawn:
        return None
    books = fit(np.array([r["x"] for r in drawn]))
    shared = spark.sparkContext.broadcast(books)

    def blocks(frame: DataFrame, size: int, name: str) -> DataFrame:
        def packed(batches):
            held: list[pd.DataFrame] = []
            n = 0
            for pdf in batches:
                held.append(pdf)
                n += len(pdf)
                while n >= size:
                    whole = pd.concat(held)
                    yield block(whole.iloc[:size])
                    held, n = [whole.iloc[size:]], n - size
            if n:
                yield block(pd.concat(held))

        def block(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id")
            x = np.array(pdf["x"].tolist(), float).reshape(len(pdf), dim)
            codes = encode(x, shared.value)
            low = codes if codes.shape[1] % 2 == 0 else np.pad(codes, ((0, 0), (0, 1)))
            return pd.DataFrame({"ids": [pdf["id"].to_numpy(np.int64).tobytes()], "keys": [pdf["key"].to_numpy(np.int64).tobytes()], "vectors": [x.tobytes()], "codes": [(low[:, ::2] | low[:, 1::2] << 4).tobytes()]})

        # Vectors of one id are told apart by their hash.
        keyed = frame.withColumn("key", F.xxhash64("x"))
        return keyed.mapInPandas(packed, "ids binary, keys binary, vectors binary, codes binary").select(*[F.col(c).alias(f"{name}_{c}") for c in ("ids", "keys", "vectors", "codes")])

    def met(batches):
        books = shared.value
        width = books.centroids.shape[0]
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids, own = np.frombuffer(row.v_ids, np.int64), np.frombuffer(row.q_ids, np.int64)
                x, q = np.frombuffer(row.v_vectors).reshape(-1, dim), np.frombuffer(row.q_vectors).reshape(-1, dim)
                half = np.frombuffer(row.v_codes, np.uint8).reshape(len(ids), -1)
                codes = np.stack([half & 15, half >> 4], 2).reshape(len(ids), -1)[:, :width]
                near = pd.DataFrame(nearest(q, own, x, ids, codes, books, k, again), columns=["place", "vec_id", "score"])
                place = near["place"].to_numpy(np.int64)
                yield pd.DataFrame({"query_id": own[place], "key": np.frombuffer(row.q_keys, np.int64)[place], "vec_id": near["vec_id"], "score": near["score"]})

    vectors = materialize(blocks(rows, block_rows, "v"), "vector-blocks")
    asked = materialize(blocks(asked, QUERIES, "q"), "query-blocks")
    pairs = vectors.drop("v_keys").crossJoin(asked.select("q_ids", "q_keys", "q_vectors"))
    near = pairs.mapInPandas(met, "query_id long, key long, vec_id long, score double")
    best = near.groupBy("query_id", "key", "vec_id").agg(F.min("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "key").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
