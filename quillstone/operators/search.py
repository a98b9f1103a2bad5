"""Search over vectors and texts. Filters come before ranking, so as many rows as asked for come back if there are any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.scalars import cosine
from quillstone.storage import materialize


def similar_to(vectors: DataFrame, key: str, vector: str, query: object, top: int = 5, condition: Column | None = None) -> DataFrame:
    """The vectors nearest to that of one row, itself left out."""
    one = vectors.where(F.col(key) == query).select(F.col(vector).alias("_q")).limit(1)
    rows = vectors.where(F.col(key) != query)
    rows = rows.where(condition) if condition is not None else rows
    scored = rows.crossJoin(F.broadcast(one)).select(key, F.round(cosine(F.col(vector), F.col("_q")), 6).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(top)


def unit(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return vectors.select(key, F.transform(vector, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12))).alias("v"))


def nearest(queries: DataFrame, vectors: DataFrame, key: str, vector: str, top: int = 3, least: float = 0.0, block: int = 512) -> DataFrame:
    """(query, key, score): the top vectors for each row of a stated query set, exactly.

    Queries and vectors are packed into blocks, and each block of queries is multiplied with each block of vectors; a pair
    of blocks gives at most top rows for each query. Nothing goes through the driver, and no row is shuffled but these.
    """
    import numpy as np
    import pandas as pd

    kind = dict(vectors.dtypes)[key]

    def pack(size: int):
        def run(batches):
            for pdf in batches:
                for start in range(0, len(pdf), size):
                    some = pdf.iloc[start : start + size]
                    yield pd.DataFrame({"ids": [some[key].to_numpy(np.int64).tobytes()], "m": [np.stack(some["v"].to_numpy()).astype(np.float64).tobytes()]})

        return run

    asked = unit(queries, key, vector).mapInPandas(pack(block), "ids binary, m binary").withColumnsRenamed({"ids": "q_ids", "m": "q"})
    # Written, so that a block is packed once however many pairs it is in.
    packed = materialize(unit(vectors, key, vector).mapInPandas(pack(4096), "ids binary, m binary"), "vector-blocks")
    pairs = packed.crossJoin(materialize(asked, "query-blocks"))

    def best(batches):
        for pdf in batches:
            for ids, m, q_ids, q in pdf[["ids", "m", "q_ids", "q"]].itertuples(index=False):
                ids, names = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                s = np.frombuffer(q).reshape(len(names), -1) @ np.frombuffer(m).reshape(len(ids), -1).T
                s = np.where(names[:, None] == ids[None, :], -2.0, s)
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s.round(9)), axis=1)[:, :top]
                scores = np.take_along_axis(s, order, 1)
                keep = scores > -1.5
                yield pd.DataFrame({"query": np.repeat(names, keep.sum(axis=1)), key: ids[order][keep], "score": scores[keep]})

    out = pairs.mapInPandas(best, f"query {kind}, {key} {kind}, score double")
    out = out.withColumn("score", F.round("score", 5)).where(F.col("score") >= least)
    return out.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key))).where(F.col("r") <= top).drop("r")


def text_search(df: DataFrame, key: str, columns: list[str], words: list[str], top: int = 10) -> DataFrame:
    """Rows that hold any of the words, by the number of distinct ones."""
    text = F.lower(F.concat_ws(" ", *columns))
    score = sum((F.contains(text, F.lit(w.lower())).cast("int") for w in words), F.lit(0))
    return df.select(key, score.alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(top)


def inner_product(vectors: DataFrame, key: str, vector: str, query: list[float], top: int = 5) -> DataFrame:
    """The rows with the largest inner product with a vector, exactly."""
    q = F.array(*(F.lit(float(x)) for x in query))
    score = F.aggregate(F.zip_with(F.col(vector), q, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return vectors.select(key, F.round(score, 5).alias("score")).orderBy(F.desc("score"), key).limit(top)
