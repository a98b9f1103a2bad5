"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text's features are the hashes of its distinct tokens (lower-cased words, and runs of other signs). One weight vector is
shared by all grades; ordered thresholds cut its score: P(grade >= k) = sigmoid(score - threshold[k]). The expected grade
and the tail probability at a grade are what selection uses.

Fitting takes at most ``sample_rows`` rated rows, chosen by a hash of their identifier, and of these, in the order of that
hash, as many as have ``sample_features`` features together (always one); features, not texts, reach the driver, 4 bytes
each. A feature gets a weight only where its occurrence depends on the grade beyond doubt (a likelihood-ratio
test against ``evidence``), so that rare words by themselves move no text. Scoring reads every row and
whole text in place, without a shuffle.

Defined cases: a null or empty text has no features and is scored by the thresholds alone; ratings with a null grade are
not learned from; several ratings of one row each count; without ratings every row gets the top grade; texts whose
identifier is null can't be rated but are scored; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.storage import materialize, read_table, ship

_TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+|[^\sa-z0-9\x80-\xff]+")


def features(text: bytes | None, buckets: int) -> np.ndarray:
    """The distinct buckets of a text's tokens."""
    if not text:
        return np.zeros(0, np.int64)
    found = set(_TOKEN.findall(text.lower()))
    return np.unique(np.fromiter(map(zlib.crc32, found), np.int64, len(found)) % buckets)


class OrdinalModel:
    """weights by bucket; thresholds[k - 1] is the one between the grades below k and those from k on."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, text: bytes | None) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        score = self.weights[features(text, len(self.weights))].sum()
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds - score, -500, 500)))


def dependence(flat: np.ndarray, of_grade: np.ndarray, grades: np.ndarray, n_grades: int, buckets: int) -> np.ndarray:
    """The likelihood-ratio statistic of each bucket's occurrence against the grade."""
    n = np.bincount(grades, minlength=n_grades).astype(float)[:, None]
    have = np.stack([np.bincount(flat[of_grade == k], minlength=buckets) for k in range(n_grades)]).astype(float)
    share = have.sum(axis=0) / n.sum()

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-300) / np.maximum(expected, 1e-300)), 0.0).sum(axis=0)

    return 2 * (part(have, n * share) + part(n - have, n * (1 - share)))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, buckets: int, evidence: float = 25.0, l2: float = 1e-3, steps: int = 250, rate: float = 0.1) -> OrdinalModel:
    """Maximum likelihood with an L2 penalty by full-batch Adam, over the features that pass the test."""
    weights = np.zeros(buckets)
    if not len(rows):
        return OrdinalModel(weights, np.full(n_grades - 1, -30.0))
    lengths = np.array([len(x) for x in rows])
    flat = np.concatenate(rows).astype(np.int32)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), lengths)
    common = np.nonzero(dependence(flat, grades[owner], grades, n_grades, buckets) >= evidence)[0]
    place = np.full(buckets, -1)
    place[common] = np.arange(len(common))
    used = place[flat] >= 0
    flat, owner = place[flat[used]], owner[used]
    share = np.array([(np.sum(grades < k) + 0.5) / (len(grades) + 1) for k in range(1, n_grades)])
    first = np.log(share / (1 - share))
    # The thresholds are a first one and logarithms of the steps up from it, so they stay in order.
    x = np.concatenate([np.zeros(len(common)), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    m, v = np.zeros_like(x), np.zeros_like(x)
    n, d = len(rows), len(common)
    for step in range(1, steps + 1):
        score = np.bincount(owner, x[flat], n)
        gaps = np.exp(x[d + 1 :])
        cuts = np.concatenate([[-np.inf], x[d] + np.concatenate([[0.0], np.cumsum(gaps)]), [np.inf]])
        upper, lower = 1 / (1 + np.exp(-np.clip(cuts[grades + 1] - score, -500, 500))), 1 / (1 + np.exp(-np.clip(cuts[grades] - score, -500, 500)))
        mass = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / mass, lower * (1 - lower) / mass
        g = np.zeros_like(x)
        g[:d] = np.bincount(flat, ((du - dl) / n)[owner], d) + l2 * x[:d]
        by_cut = np.array([(dl[grades == k].sum() - du[grades == k - 1].sum()) / n for k in range(1, n_grades)])
        g[d] = by_cut.sum()
        g[d + 1 :] = gaps * np.cumsum(by_cut[::-1])[::-1][1:]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights[common] = x[:d]
    return OrdinalModel(weights, x[d] + np.concatenate([[0.0], np.cumsum(np.exp(x[d + 1 :]))]))


def fit(docs: DataFrame, ratings: DataFrame, grade: Column, n_grades: int = 3, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 20_000, sample_features: int = 8_000_000, buckets: int = 1 << 18) -> OrdinalModel:
    """Fit on rated rows; grade is a column over ratings with values 0 .. n_grades - 1 or null."""
    ship(docs.sparkSession)
    rated = ratings.select(F.col(id_col).alias("rated_id"), grade.cast("int").alias("grade")).where("rated_id is not null and grade is not null")
    sample = rated.orderBy(F.xxhash64("rated_id"), "rated_id", "grade").limit(sample_rows)  # at most sample_rows short rows, so it can be broadcast
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(sample), F.col("id") == F.col("rated_id")).select("grade", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t, buckets).tolist() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["grade", "id", "features"])

    kind = dict(docs.dtypes)[id_col]
    found = materialize(joined.mapInArrow(run, f"grade int, id {kind}, features array<int>"), "rated-features")
    # One task orders the sizes of the sample's rows, not their features.
    place = F.struct(F.xxhash64("id"), "id", "grade")
    upto = F.sum(F.col("n") * F.col("size")).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    sizes = found.groupBy("id", "grade").agg(F.count("*").alias("n"), F.max(F.size("features")).alias("size")).withColumn("place", place)
    end = sizes.withColumn("upto", upto).where(F.col("upto") > sample_features).agg(F.min("place").alias("end")).first().end
    if end is not None:
        least = sizes.agg(F.min("place").alias("least")).first().least
        cut, only = (F.struct(*(F.lit(x) for x in row)).cast(sizes.schema["place"].dataType) for row in (end, least))
        found = found.where((place < cut) | (place == only))
    rows = found.toArrow().sort_by([("id", "ascending"), ("grade", "ascending")])
    column = rows.column("features").combine_chunks()
    flat, ends = column.flatten().to_numpy(), np.cumsum(pc.list_value_length(column).to_numpy())
    lists = np.split(flat, ends[:-1]) if len(ends) else []
    return fit_ordinal(lists, rows.column("grade").to_numpy().astype(np.int64), n_grades, buckets)


def _tails(df: DataFrame, model: OrdinalModel):
    return df.sparkSession.sparkContext.broadcast(pickle.dumps(model))


def score(df: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(identifier, expected_grade, tails) for every row; tails[k] is P(grade >= k + 1)."""
    ship(df.sparkSession)
    state, kind = _tails(df, model), dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(state.value)
        for batch in batches:
            found = [own.tails(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([float(x.sum()) for x in found], pa.float64()), pa.array([x.tolist() for x in found], pa.list_(pa.float64()))], ["id", "expected_grade", "tails"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, expected_grade double, tails array<double>").withColumnRenamed("id", id_col)


def select(df: DataFrame, model: OrdinalModel, grade: int, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of df, as they are, whose P(grade >= grade) is at least least."""
    ship(df.sparkSession)
    state, at = _tails(df, model), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(state.value)
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([bool(own.tails(t)[grade - 1] >= least) for t in texts], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def label_grade() -> Column:
    """Grades of the labels table: 0 toxic, 1 poor, 2 good; null where it tells neither."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, read_table(spark, sf_dir, "labels"), label_grade())
    found = score(docs, model)
    return found.select("doc_id", "expected_grade", F.col("tails")[0].alias("p_not_toxic"), F.col("tails")[1].alias("p_good"), (F.col("tails")[1] >= 0.5).alias("selected"))
