"""Exact top-k search by inner product: columnar branch and bound.

Vectors are stored in blocks, one dimension after another (vertical layout). A block of queries meets
every block of candidates. Within a pair of blocks partial scores are added up dimension block by
dimension block; the lengths of what remains of query and candidate bound what can still be added
(Cauchy-Schwarz), and candidates that can no longer reach a query's k-th best score are compacted
away. Candidates go from long to short, a few at a time, so later ones meet higher bounds.

Blocks of queries are dealt to ``g`` groups and blocks of candidates to ``s`` groups; a cell (g, s)
holds every pair of its blocks. A candidate is copied once a group of queries and a query once a group
of candidates, and both numbers follow the cells that the cores need. Cells give each query's k best,
which are ranked after a shuffle by query.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import map_batches, stored, stream_batches

#: Components of a block of queries and of one of candidates.
QUERY_CELLS, CANDIDATE_CELLS = 1 << 16, 1 << 19
#: Dimensions added at once, candidates compared at once, and the multiplications of a cell.
DIMENSIONS, AT_ONCE, CELL_WORK = 16, 1024, 1 << 33
#: Share of survivors up to which they are compacted; above, whole blocks are added.
SPARSE = 0.05


def quantised(vectors: DataFrame, scale: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, vector (floor of each component times ``scale``, as long). Vectors that are null or hold
    null or non-finite components, and null keys, take no part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    usable = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite)
    return usable.select(F.col(key).cast("long").alias(key), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("vector"))


_BLOCK = "block bigint, ids binary, size int, dims int, data binary"


def _blocks(vectors: DataFrame, key: str, cells: int, name: str) -> DataFrame:
    """Blocks of the vectors that a task holds; data is (dims, size) of 64-bit numbers. Shorter vectors
    end in zeros."""

    def make():
        state = {"rows": [], "ids": [], "dims": 0, "n": TaskContext.get().partitionId() << 33}

        def put(out: dict[str, list]) -> None:
            size, dims = len(state["ids"]), state["dims"]
            data = np.zeros((dims, size), np.int64)
            for i, row in enumerate(state["rows"]):
                data[: len(row), i] = row
            for column, v in zip(out.values(), (state["n"], np.array(state["ids"], np.int64).tobytes(), size, dims, data.tobytes())):
                column.append(v)
            state.update(rows=[], ids=[], dims=0, n=state["n"] + 1)

        def add(b: dict[str, list]) -> dict[str, list]:
            out = {"block": [], "ids": [], "size": [], "dims": [], "data": []}
            for i, row in zip(b["id"], b["vector"]):
                dims = max(state["dims"], len(row))
                if state["ids"] and (len(state["ids"]) + 1) * dims > cells:
                    put(out)
                state["rows"].append(row)
                state["ids"].append(i)
                state["dims"] = max(state["dims"], len(row))
            return out

        def rest() -> dict[str, list]:
            out = {"block": [], "ids": [], "size": [], "dims": [], "data": []}
            if state["ids"]:
                put(out)
            return out

        return add, rest

    return stored(stream_batches(vectors.select(F.col(key).alias("id"), "vector"), make, _BLOCK), name)


class Block:
    """Ids and vertical vectors, the longest vectors first, and the length of what remains of each
    vector after each block of dimensions."""

    def __init__(self, ids: bytes, size: int, dims: int, data: bytes, width: int):
        self.ids = np.frombuffer(ids, np.int64)
        whole = np.zeros((width, size), np.int64)
        whole[:dims] = np.frombuffer(data, np.int64).reshape(dims, size)
        squares = whole.astype(np.float64) ** 2
        self.cuts = list(range(0, width, DIMENSIONS)) or [0]
        remains = np.sqrt(np.stack([squares[c:].sum(0) for c in self.cuts] + [np.zeros(size)]))
        order = np.argsort(-remains[0], kind="stable")
        self.order, self.ids, self.whole, self.remains = order, self.ids[order], whole[:, order], remains[:, order]
        self.longest = float(remains[0].max(initial=0.0))


def _number(bound: float) -> type:
    """The kind of numbers whose sums of products are exact up to ``bound``."""
    return np.float32 if bound < 2**23 else np.float64 if bound < 2**52 else object


class Best:
    """The k best of each query of a block so far: parallel arrays by query, score and id."""

    def __init__(self, size: int, k: int):
        self.k, self.least = k, np.full(size, -np.inf)
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, s, i = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((i, ~s, q))  # ~s falls as s rises, without overflow
        q, s, i = q[order], s[order], i[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
        kept = rank < self.k
        self.query, self.score, self.id = q[kept], s[kept], i[kept]
        last = rank == self.k - 1
        self.least[q[last]] = s[last]


def meet(queries: Block, candidates: Block, best: Best) -> None:
    """Adds to ``best`` what of ``candidates`` is among a query's k best."""
    kind = _number(queries.longest * candidates.longest)
    asked, given = queries.whole.astype(kind), candidates.whole.astype(kind)
    slack = 1 + 1e-9
    for at in range(0, len(candidates.ids), AT_ONCE):
        part = slice(at, at + AT_ONCE)
        vectors, remains, least = given[:, part], candidates.remains[:, part], best.least
        n = vectors.shape[1]
        score = np.zeros((len(queries.ids), n), kind)
        q = c = None  # all pairs, until few are left
        for b, cut in enumerate(queries.cuts):
            dims = slice(cut, cut + DIMENSIONS)
            if q is None:
                score = score + asked[dims].T @ vectors[dims]
                open_ = score + slack * queries.remains[b + 1][:, None] * remains[b + 1] >= least[:, None]
                if np.count_nonzero(open_) <= SPARSE * open_.size or b == len(queries.cuts) - 1:
                    q, c = np.nonzero(open_)
                    score = score[q, c]
            else:
                score = score + (asked[dims][:, q] * vectors[dims][:, c]).sum(0)
                open_ = score + slack * queries.remains[b + 1][q] * remains[b + 1][c] >= least[q]
                q, c, score = q[open_], c[open_], score[open_]
        ids = candidates.ids[part][c]
        other = ids != queries.ids[q]
        bound = 2**63 - 1
        exact = np.clip(score, -bound - 1, bound) if kind is object else score
        best.add(q[other], exact[other].astype(np.int64), ids[other])


def _cells(pairs: DataFrame, k: int) -> DataFrame:
    """Each query's k best within a cell: query_block, place, query_id, vec_id, score."""
    schema = "query_block bigint, place int, query_id bigint, vec_id bigint, score bigint"

    def make():
        def work(b: dict[str, list]) -> dict[str, list]:
            out = {c.split()[0]: [] for c in schema.split(", ")}
            for row in zip(*(b[c] for c in ("query_block", "q_ids", "q_size", "q_dims", "q_data", "c_ids", "c_size", "c_dims", "c_data"))):
                block, q, c = row[0], row[1:5], row[5:9]
                width = max(q[2], c[2])
                asked, given = Block(*q, width), Block(*c, width)
                best = Best(q[1], k)
                meet(asked, given, best)
                out["query_block"] += [block] * len(best.query)
                for name, v in (("place", asked.order[best.query]), ("query_id", asked.ids[best.query]), ("vec_id", best.id), ("score", best.score)):
                    out[name] += v.tolist()
            return out

        return work

    return map_batches(pairs, make, schema)


def top_k(queries: DataFrame, candidates: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of ``queries`` its k highest inner products
    with rows of ``candidates`` of other keys (all, if fewer), ties to the smaller key.

    Both have key and vector (see quantised). Repeated rows are queries and candidates of their own.
    Vectors of unlike lengths are compared as if the shorter one ended in zeros. Scores beyond 64 bits
    are stated, and tie, as the largest or smallest 64-bit number. Other columns are left out, so none can
    clash; empty tables give no rows.
    """
    asked, given = _blocks(queries, key, QUERY_CELLS, "search-queries"), _blocks(candidates, key, CANDIDATE_CELLS, "search-candidates")
    size = lambda df: df.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("dims"), F.lit(0))).first()
    (n_asked, q, d), (n_given, c, _) = size(asked), size(given)
    cells = max(4 * asked.sparkSession.sparkContext.defaultParallelism, math.ceil(q * c * max(1, d) / CELL_WORK))
    # copies of candidates are as many as groups of queries: g groups at g x c = s x q
    groups = max(1, min(n_asked, round(math.sqrt(cells * q / max(1, c)))))
    parts = max(1, min(n_given, math.ceil(cells / groups)))
    group = lambda n: F.pmod(F.xxhash64("block"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    named = lambda p: [F.col(x).alias(f"{p}_{x}") for x in ("ids", "size", "dims", "data")]
    left = asked.select(F.col("block").alias("query_block"), *named("q"), group(groups).alias("g"), every(parts).alias("s")).repartition(groups * parts, "g", "s")
    right = given.select(*named("c"), group(parts).alias("s"), every(groups).alias("g")).repartition(groups * parts, "g", "s")
    found = _cells(left.hint("shuffle_hash").join(right, ["g", "s"]), k)
    by_query = Window.partitionBy("query_block", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(scale: int, each: int, k: int) -> str:
    """The same result in DuckDB's SQL."""
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % {each} = 0 AND q.vec_id <> c.vec_id)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= {k}"""
