"""Language identification by segmentation-marginalised unigrams.

A language is a probability for each piece of a fixed public vocabulary. A word's probability is the sum over *all* its
segmentations into pieces, by the forward algorithm; a text's score is the product over its words (runs of letters,
lower-cased) and the share of the language among the training rows. Piece probabilities come from expectation
maximisation: forward-backward counts of pieces over every segmentation of the training words.

Training reads at most about ``sample_per_lang`` rows of each language, chosen by a hash of identifier and text (the bound
is on the expected number; the row with the least hash is always read); counting the rows of each language covers all of
them. What reaches the driver is one number for each
language and piece. Prediction covers all rows and whole texts; words are scored once and kept in a bounded cache.

Defined cases: a text that is null, empty or without letters is ``und`` with score 0; so is every text if no row can be
learned from; of languages that score the same the first in the alphabet is taken; rows with a null language are not
learned from; letters are what Unicode calls so (no digits, fractions or enclosed numbers); more than ``MAX_LANGUAGES``
languages are an error; letters outside the vocabulary are unknown pieces of one letter; a run of over ``MAX_WORD`` letters is
scored in stretches of that length; a null identifier reads as an empty text in the split; repeated rows count each
time; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.storage import read_table, ship

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
START = "▁"  # how the vocabulary marks the start of a word
MAX_WORD = 24
MAX_LANGUAGES = 500
UNKNOWN_LETTERS = 10_000  # letters that share the unknown piece's probability
_LETTERS = re.compile(r"[^\W\d_]+")


def load_pieces(path: str = VOCABULARY) -> list[str]:
    """The pieces of a SentencePiece model, without its control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]


def words_of(text: str | None) -> list[str]:
    found = _LETTERS.findall(text.lower()) if text else []
    if found and not "".join(found).isalpha():
        found = "".join(c if c.isalpha() else " " for c in " ".join(found)).split()
    if any(len(w) > MAX_WORD for w in found):
        found = [w[k : k + MAX_WORD] for w in found for k in range(0, len(w), MAX_WORD)]
    return found


class Lattice:
    """Pieces that can stand in a word; the piece after the last of the vocabulary is the unknown letter."""

    def __init__(self, pieces: list[str]):
        self.index = {p: k for k, p in enumerate(pieces)}
        self.unknown = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        #: Of two letters, the length of the longest piece that starts with them.
        self.reach: dict[str, int] = {}
        for piece in pieces:
            self.reach[piece[:2]] = max(self.reach.get(piece[:2], 1), len(piece))

    def edges(self, word: str) -> list[tuple[int, int, int]]:
        """(start, end, piece), ordered by end."""
        text, get = START + word, self.index.get
        out = []
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - self.longest), end):
                piece = get(text[start:end])
                if piece is not None:
                    out.append((start, end, piece))
                elif end - start == 1:
                    out.append((start, end, self.unknown))
        return out

    def forward(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """The log probability of each word in each language, for words of one length together.

        table has a row for each piece and the unknown letter, then a row of zeros for stretches that are no piece.
        """
        out = np.zeros((len(words), table.shape[1]))
        by_size: dict[int, list[int]] = defaultdict(list)
        for k, word in enumerate(words):
            by_size[len(word) + 1].append(k)
        for size, every in by_size.items():
            for at in range(0, len(every), 4096):
                some = every[at : at + 4096]
                out[some] = np.log(np.maximum(self._forward([words[k] for k in some], size, table), 1e-300))
        return out

    def _forward(self, words: list[str], size: int, table: np.ndarray) -> np.ndarray:
        reach, get, places, found = min(size, self.longest), self.index.get, [], []
        for k, word in enumerate(words):
            text = START + word
            for start in range(size):
                base = (k * size + start) * reach - 1
                for length in range(1, min(self.reach.get(text[start : start + 2], 1), size - start) + 1):
                    piece = get(text[start : start + length])
                    if piece is not None:
                        places.append(base + length)
                        found.append(piece)
        pieces = np.full(len(words) * size * reach, self.unknown + 1)
        pieces.reshape(-1, reach)[:, 0] = self.unknown
        pieces[places] = found
        pieces = pieces.reshape(len(words), size, reach)
        alpha = np.zeros((size + 1, len(words), table.shape[1]))
        alpha[0] = 1.0
        for start in range(size):
            for length in range(1, min(reach, size - start) + 1):
                alpha[start + length] += alpha[start] * table[pieces[:, start, length - 1]]
        return alpha[size]

    def expected(self, word: str, p: np.ndarray | list[float], weight: float, into: dict[int, float]) -> None:
        """Adds each piece's expected number over all segmentations of a word, times weight."""
        edges = self.edges(word)
        size = len(word) + 1
        alpha, beta = [1.0] + [0.0] * size, [0.0] * size + [1.0]
        for start, end, piece in edges:
            alpha[end] += alpha[start] * p[piece]
        for start, end, piece in reversed(edges):
            beta[start] += beta[end] * p[piece]
        if alpha[-1] <= 0.0:
            return
        scale = weight / alpha[-1]
        for start, end, piece in edges:
            into[piece] += alpha[start] * p[piece] * beta[end] * scale


class Model:
    def __init__(self, languages: list[str], priors: list[float], pieces: list[str], probabilities: np.ndarray):
        """probabilities: a row for each piece and one for the unknown letter, a column for each language."""
        self.languages, self.priors, self.pieces, self.probabilities = languages, np.log(np.asarray(priors)), pieces, probabilities


class Scorer:
    """Scores texts with a model, keeping the scores of at most cache words."""

    def __init__(self, model: Model, cache: int = 500_000):
        self.model, self.cache = model, cache
        self.lattice = Lattice(model.pieces)
        self.table = np.vstack([model.probabilities, np.zeros(len(model.languages))])
        self.known: dict[str, int] = {}
        self.scores = np.zeros((cache, len(model.languages)))

    def learn(self, words: list[str]) -> None:
        first = len(self.known)
        self.scores[first : first + len(words)] = self.lattice.forward(words, self.table)
        self.known.update(zip(words, range(first, first + len(words)), strict=True))

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Scores the new words of many texts together where they fit into the cache."""
        many = [words_of(t) for t in texts]
        fresh = set().union(*many).difference(self.known) if self.model.languages else set()
        if len(self.known) + len(fresh) <= self.cache:
            self.learn(list(fresh))
        return [self.predict(w) for w in many]

    def predict(self, words: list[str]) -> tuple[str, float]:
        if not words or not self.model.languages:
            return "und", 0.0
        total = self.model.priors.copy()
        for k in range(0, len(words), self.cache // 2):
            total += self.sum(words[k : k + self.cache // 2])
        best = int(total.argmax())
        return self.model.languages[best], float(1.0 / np.exp(total - total[best]).sum())

    def sum(self, words: list[str]) -> np.ndarray:
        at = list(map(self.known.get, words))
        if None in at:
            fresh = {w for w, k in zip(words, at, strict=True) if k is None}
            if len(self.known) + len(fresh) > self.cache:
                self.known.clear()
                fresh = set(words)
            self.learn(list(fresh))
            at = list(map(self.known.get, words))
        return self.scores[at].sum(axis=0)


_SCORERS: dict[str, Scorer] = {}


def _piece_counts(rows: DataFrame, pieces: list[str], languages: list[str], probabilities: np.ndarray) -> np.ndarray:
    """Expected piece counts of rows (lang, text), a column for each language."""
    spark = rows.sparkSession
    state = spark.sparkContext.broadcast(pickle.dumps((pieces, languages, probabilities)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, langs, table = pickle.loads(state.value)
        lattice, column = Lattice(names), {x: table[:, k].tolist() for k, x in enumerate(langs)}
        totals: dict[str, dict[int, float]] = {x: defaultdict(float) for x in langs}
        words: dict[str, Counter] = {x: Counter() for x in langs}

        def settle() -> None:
            for lang, counts in words.items():
                for word, n in counts.items():
                    lattice.expected(word, column[lang], n, totals[lang])
                counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words[lang].update(words_of(text))
            if sum(map(len, words.values())) > 200_000:
                settle()
        settle()
        for lang, found in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.float64())], ["lang", "piece", "n"])

    counts = rows.mapInArrow(run, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    out = np.zeros(probabilities.shape)
    place = {x: k for k, x in enumerate(languages)}
    for row in counts.toLocalIterator():
        out[row.piece, place[row.lang]] = row.n
    return out


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str = VOCABULARY, sample_per_lang: int = 2000, rounds: int = 2, smoothing: float = 0.1) -> Model:
    """Learn piece probabilities from rows with a language."""
    spark = rows.sparkSession
    ship(spark)
    pieces = load_pieces(vocabulary)
    place = F.pmod(F.xxhash64(id_col, text_col), F.lit(1_000_003))
    known = rows.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), place.alias("place"))
    counts = sorted((r.lang, r.n, r.least) for r in known.groupBy("lang").agg(F.count("*").alias("n"), F.min("place").alias("least")).limit(MAX_LANGUAGES + 1).collect())
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    languages = [x for x, _, _ in counts]
    size = len(pieces) + 1
    probabilities = np.full((size, len(languages)), 1.0 / size)
    probabilities[-1] /= UNKNOWN_LETTERS
    if not languages:
        return Model([], [], pieces, probabilities)
    below = F.create_map(*(F.lit(x) for lang, n, least in counts for x in (lang, max(min(1.0, sample_per_lang / n) * 1_000_003, least + 1.0))))
    sample = known.where(F.col("place") < below[F.col("lang")]).select("lang", "text")
    for _ in range(rounds):
        found = _piece_counts(sample, pieces, languages, probabilities) + smoothing
        probabilities = found / found.sum(axis=0)
        probabilities[-1] /= UNKNOWN_LETTERS
    total = sum(n for _, n, _ in counts)
    return Model(languages, [n / total for _, n, _ in counts], pieces, probabilities)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(identifier, lang_pred, score) for every row."""
    spark = df.sparkSession
    ship(spark)
    kind = dict(df.dtypes)[id_col]
    state, name = spark.sparkContext.broadcast(pickle.dumps(model)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _SCORERS:  # a worker's tasks share the cache
            _SCORERS.clear()
            _SCORERS[name] = Scorer(pickle.loads(state.value))
        scorer = _SCORERS[name]
        for batch in batches:
            found = scorer.predict_all(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["id", "lang_pred", "score"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score")
