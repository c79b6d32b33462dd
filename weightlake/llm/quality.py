"""Quality rules scored by an isolation forest.

Each text gets counts that quality rules look at; an isolation forest over
their ratios scores how few random splits set a document apart, and labelled
rows say from which score on a document is dropped.

Defined results: a null or empty text has no words and fails the base rule;
a row is judged by its own text alone, so repeated rows and repeated ids get
equal verdicts; an empty table gives an empty result; of
conflicting labels of one id the least counts; without rows labelled good no
threshold is set and the base rule decides alone; other columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import find_words, hash_values, mix, pieces, row_of, text_bytes, whole_windows

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?.,;:'\"()[]{}")] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_distinct_words", "n_upper", "n_digits", "n_marks"]
#: Bound on the labelled rows that the forest is fitted on; rows with the least hash of their id are taken.
FIT_ROWS = 8192
#: Bytes of text that are counted at once; a worker's memory is about thirty times this.
PIECE = 2 << 20
#: The share of labelled good rows that the threshold may cost at most.
CLEAN_LOSS = 0.002


def _per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def text_counts(col: pa.Array) -> dict[str, np.ndarray]:
    """The counts of COUNTS and EXTRA for each text."""
    data, at = text_bytes(col)
    words = find_words(col)
    rows, n = words.rows, len(col)
    codes, distinct = words.encode()
    owner = row_of(rows)
    solid = np.zeros(len(data) + 1, np.int64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    np.cumsum(~space & ((data & 0xC0) != 0x80), out=solid[1:])
    out = {
        "n_words": np.diff(rows),
        "word_chars": solid[at[1:]] - solid[at[:-1]],
        "n_symbols": _per_row(_SYMBOL[data], at),
        "n_upper": _per_row(_UPPER[data], at),
        "n_digits": _per_row(_DIGIT[data], at),
        "n_marks": _per_row(_MARK[data], at),
    }
    # words in three-word windows that a text has twice
    repeat = np.zeros(len(codes) + 1, np.int64)
    m = len(codes) - 2
    if m > 0:
        h = mix(hash_values(distinct))[codes]
        key = mix(mix(mix(h[:m]) + h[1 : m + 1]) + h[2:]) + mix(owner[:m] + 1)
        whole = np.flatnonzero(whole_windows(rows, 3, len(codes)))
        _, back, times = np.unique(key[whole], return_inverse=True, return_counts=True)
        twice = whole[times[back] > 1]
        covered = np.zeros(len(codes), bool)
        for k in range(3):
            covered[twice + k] = True
        np.cumsum(covered, out=repeat[1:])
    out["n_repeat_words"] = repeat[rows[1:]] - repeat[rows[:-1]]
    # distinct words of each text
    if len(codes):
        pair = np.unique(owner * (len(distinct) + 1) + codes)
        out["n_distinct_words"] = np.bincount(pair // (len(distinct) + 1), minlength=n)
    else:
        out["n_distinct_words"] = np.zeros(n, np.int64)
    dup, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    raw = data.tobytes()
    for i in range(n):
        solid_lines = [x for x in raw[at[i] : at[i + 1]].split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
        lines[i] = len(solid_lines)
        dup[i] = len(solid_lines) - len(set(solid_lines))
    return out | {"n_dup_lines": dup, "n_lines": lines}


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """The rule statistics that the forest splits on: word length and shares of marks. Repeats are left to the base rule, as good texts quote."""
    n = np.maximum(c["n_words"], 1).astype(float)
    chars = np.maximum(c["word_chars"], 1).astype(float)
    return np.stack([c["word_chars"] / n, c["n_symbols"] / chars, c["n_upper"] / chars, c["n_marks"] / chars], axis=1)


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


@dataclass
class IsolationForest:
    """Random splits of small subsamples; points that few splits set apart are anomalous."""

    n_trees: int = 200
    sample: int = 256
    seed: int = 7
    trees: list = field(default_factory=list)

    def fit(self, x: np.ndarray) -> IsolationForest:
        rng = np.random.default_rng(self.seed)
        size = min(self.sample, len(x))
        self.size = size
        depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
        self.trees = [self._grow(x[rng.choice(len(x), size, replace=False)], depth, rng) for _ in range(self.n_trees)]
        return self

    @staticmethod
    def _path(n: float) -> float:
        """The mean path length of a search tree of n points."""
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, x: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        column, cut, left, right, length = [], [], [], [], []

        def node(part: np.ndarray, level: int) -> int:
            k = len(column)
            for a in (column, cut, left, right, length):
                a.append(0)
            wide = np.flatnonzero(part.max(0) > part.min(0)) if len(part) > 1 and level < depth else []
            if not len(wide):
                column[k], length[k] = -1, level + self._path(len(part))
                return k
            column[k] = f = int(rng.choice(wide))
            cut[k] = rng.uniform(part[:, f].min(), part[:, f].max())
            low = part[:, f] < cut[k]
            left[k], right[k] = node(part[low], level + 1), node(part[~low], level + 1)
            return k

        node(x, 0)
        return np.array(column), np.array(cut, float), np.array(left), np.array(right), np.array(length, float)

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1; higher is more anomalous."""
        if not self.trees or not len(x):
            return np.zeros(len(x))
        total = np.zeros(len(x))
        each = np.arange(len(x))
        for column, cut, left, right, length in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := column[at] >= 0).any():
                f = np.where(inner, column[at], 0)
                at = np.where(inner, np.where(x[each, f] < cut[at], left[at], right[at]), at)
            total += length[at]
        return np.exp2(-total / len(self.trees) / max(self._path(self.size), 1e-9))


@dataclass
class QualityModel:
    forest: IsolationForest
    threshold: float | None

    def keep(self, counts: dict[str, np.ndarray], score: np.ndarray) -> np.ndarray:
        good = ~base_failed(counts)
        return good if self.threshold is None else good & (score <= self.threshold)


def count_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its id and counts."""
    names = COUNTS + EXTRA
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "t", PIECE):
            c = text_counts(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c[k].astype(np.int64)) for k in names)], names=["id", *names])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {id_type}, " + ", ".join(f"{k} bigint" for k in names))


def fit_quality(counts: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", fit_rows: int = FIT_ROWS, clean_loss: float = CLEAN_LOSS) -> QualityModel:
    """Fits the forest on at most ``fit_rows`` labelled rows and sets the threshold from all of them.

    ``counts`` is read twice; pass a table or a checkpoint. The threshold is
    the least score (in steps of 1/2000) that costs at most ``clean_loss`` of
    the rows labelled 1; only a histogram of scores comes to the driver.
    """
    label = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("good"))
    known = counts.join(label, "id")
    # by a bound on the hash, so that no task sends more than its share; the order makes the rows the same on every run
    share = min(1.0, 1.1 * fit_rows / max(known.count(), 1))
    bound = int(share * (2**32 - 1))
    head = known.where(F.pmod(F.xxhash64("id"), F.lit(2**32)) <= bound).select(F.xxhash64("id").alias("_h"), *COUNTS, *EXTRA).toPandas()
    head = head.sort_values(["_h", *COUNTS, *EXTRA]).head(fit_rows).drop(columns="_h")
    forest = IsolationForest()
    if not len(head):
        return QualityModel(forest, None)
    forest.fit(features({k: head[k].to_numpy() for k in head}))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {k: b.column(k).to_numpy() for k in COUNTS + EXTRA}
            fair = ~base_failed(c)
            s = np.ceil(forest.score(features(c)) * 2000).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(s[fair]), b.column("good").filter(pa.array(fair))], names=["s", "good"])

    found = known.select(*COUNTS, *EXTRA, "good").mapInArrow(scored, "s int, good int").groupBy("s", "good").count().toPandas()
    good = found[found.good == 1].groupby("s")["count"].sum().sort_index()
    if good.empty:
        return QualityModel(forest, None)
    kept = good.cumsum() / good.sum()
    return QualityModel(forest, float(kept[kept >= 1 - clean_loss].index[0]) / 2000)


def judge_quality(counts: DataFrame, model: QualityModel, id_col: str = "doc_id") -> DataFrame:
    """One row for each row of ``counts``: id, counts, score, base_failed, kept."""
    names = COUNTS + EXTRA
    id_type = counts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {k: b.column(k).to_numpy() for k in names}
            s = model.forest.score(features(c))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ["id", *names]), pa.array(s), pa.array(base_failed(c)), pa.array(model.keep(c, s))], names=["id", *names, "score", "base_failed", "kept"])

    return counts.mapInArrow(run, f"id {id_type}, " + ", ".join(f"{k} bigint" for k in names) + ", score double, base_failed boolean, kept boolean").withColumnRenamed("id", id_col)


def keep_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The documents that the model keeps, with all their columns."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text_col, PIECE):
            c = text_counts(b.column(names.index(text_col)))
            yield b.filter(pa.array(model.keep(c, model.forest.score(features(c)))))

    return docs.mapInArrow(run, docs.schema)
