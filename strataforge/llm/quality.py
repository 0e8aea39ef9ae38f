"""Quality scores: ridge regression on random Fourier features, calibrated by isotonic regression.

Statistics of a whole text (byte classes, words, lines, repetition) are standardised and mapped to
random Fourier features, whose inner products approximate a Gaussian kernel. Each partition of the
labelled rows sums its normal equations by fold; Spark sums those cells, and their number depends
on the features alone. Scores of one fold under the other's weights, counted in fixed bins, give
the isotonic curve that turns a ridge score into a probability.

Only rows whose crc32(id as text) mod 3 is not 1 teach anything; labels, language, source and id
are never inputs of a score. Defined cases: a null text is an empty one and is scored like any
other; a null id has no label; repeated labels of an id count by their mean; without labels of both
kinds every score is one half; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.llm.pieces import cells
from strataforge.llm.store import RID, P, identified, is_scan, materialize
from strataforge.llm.textcore import LOWER, packed_rows, slices, span_hashes, words

#: Fourier features, kernel width in standard deviations of one statistic, ridge penalty, seed.
FOURIER, WIDTH, RIDGE, SEED = 192, 6.0, 1e-3, 7
#: Bins of the ridge score, over this range, in which the calibration counts.
BINS, RANGE = 4096, (-1.0, 2.0)


def _byte_classes() -> np.ndarray:
    table = np.zeros((256, 10))
    groups = [range(65, 91), range(97, 123), range(48, 58), b" ", b"\t\r\x0b\x0c", b"\n", b".,;:?'\"()-", b"!", b"#$%&*+/<=>@[\\]^_`{|}~", range(128, 256)]
    for k, group in enumerate(groups):
        table[list(group), k] = 1
    return table


_CLASSES = _byte_classes()


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of statistics for each text; zero for an empty one."""
    texts, size = len(offsets) - 1, np.diff(offsets)
    text = np.repeat(np.arange(texts), size)
    histogram = np.bincount(text * 256 + data, minlength=texts * 256).reshape(texts, 256).astype(float)
    share = histogram / np.maximum(size, 1)[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    starts, ends, first = words(data, offsets)
    count, owner, length = np.diff(first), np.repeat(np.arange(texts), np.diff(first)), (ends - starts).astype(float)
    per = lambda x: np.bincount(owner, weights=x, minlength=texts) / np.maximum(count, 1)
    mean = per(length)
    spread = np.sqrt(np.maximum(per(length**2) - mean**2, 0))
    sums = lambda mask: np.concatenate(([0], np.cumsum(mask)))
    inside = lambda mask: (lambda total: total[ends] - total[starts])(sums(mask))
    upper, letters = _CLASSES[data, 0] > 0, (_CLASSES[data, 0] + _CLASSES[data, 1] + _CLASSES[data, 9]) > 0
    symbol, mark = _CLASSES[data, 8] > 0, _CLASSES[data, 7] > 0
    n_upper, n_letters = inside(upper), inside(letters)
    hashes = span_hashes(LOWER[data], starts, ends)

    def repeated(keys: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Share of a text's keys that are distinct, and of its most frequent one."""
        order = np.lexsort((keys, who))
        k, w = keys[order], who[order]
        edge = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (w[1:] != w[:-1]))) if len(k) else np.zeros(0, np.int64)
        runs, total = np.diff(np.append(edge, len(k))), np.maximum(np.bincount(who, minlength=texts), 1)
        top = np.zeros(texts)
        np.maximum.at(top, w[edge], runs)
        return np.bincount(w[edge], minlength=texts) / total, top / total

    distinct, top = repeated(hashes, owner)
    pair = owner[1:] == owner[:-1]
    pairs, _ = repeated((hashes[:-1] * np.uint64(3) + hashes[1:])[pair], owner[1:][pair])
    breaks = np.concatenate((np.flatnonzero(data == 10) + 1, offsets[:-1]))
    line_start = np.unique(breaks[breaks < len(data)])
    line_end = np.append(line_start[1:], len(data))
    line_text = np.searchsorted(offsets, line_start, "right") - 1
    lines, _ = repeated(span_hashes(data, line_start, line_end), line_text)
    n_lines = np.bincount(line_text, minlength=texts)
    columns = [
        np.log1p(size), np.log1p(count), np.log1p(n_lines), np.log1p(count / np.maximum(n_lines, 1)), entropy, mean, spread, *(share @ _CLASSES).T,
        per(n_upper == np.maximum(n_letters, 1)), per(upper[starts] if len(starts) else length), per(inside(symbol) > 0), per(inside(mark) > 0), per(n_letters == 0), per(length <= 3), per(length >= 16),
        distinct, top, pairs, lines,
    ]
    return np.stack(columns, axis=1) * (size > 0)[:, None]


def _statistics_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    for i, j, data, offsets in slices(column):
        yield i, j, text_statistics(data, offsets)


STATISTICS = len(text_statistics(np.frombuffer(b"a b", np.uint8), np.array([0, 3]))[0])


@dataclass
class QualityModel:
    """What scoring needs; its size depends on FOURIER and the statistics alone."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    curve_at: np.ndarray
    curve: np.ndarray

    def fourier(self, statistics: np.ndarray) -> np.ndarray:
        return fourier(statistics, self.mean, self.scale)

    def score(self, statistics: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(statistics), 0.5)
        return np.interp(self.fourier(statistics) @ self.weights, self.curve_at, self.curve)


def fourier(statistics: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features and a constant one."""
    random = np.random.default_rng(SEED)
    frequency = random.normal(size=(STATISTICS, FOURIER)) / WIDTH
    phase = random.uniform(0, 2 * np.pi, FOURIER)
    x = np.clip((statistics - mean) / scale, -6, 6)
    return np.concatenate((np.sqrt(2 / FOURIER) * np.cos(x @ frequency + phase), np.ones((len(x), 1))), axis=1)


def quality_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, scan: bool | None = None) -> DataFrame:
    """Row identity, doc_id and statistics (binary doubles) of every whole text, as a written table."""
    scan = is_scan(docs) if scan is None else scan
    rows = identified(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(["_metadata"] if scan else [])), "doc_id", "text", scan=scan).select(*RID, "doc_id", "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, found in _statistics_of(batch.column(3)):
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(3)), packed_rows(np.full(j - i, STATISTICS), found)], [*RID, "doc_id", "statistics"])

    return materialize(rows.mapInArrow(measure, f"{RID[0]} long, {RID[1]} long, doc_id long, statistics binary"), "statistics")


def fold_of(id_col: str):  # noqa: ANN201
    """crc32 of the id as text, mod 3; 1 is held out."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)).cast("int")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(cells(column)[0]).view(np.float64).reshape(-1, STATISTICS)


def isotonic(at: np.ndarray, count: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing curve through weighted means (pool adjacent violators), by block centres."""
    blocks: list[list[float]] = []
    for x, n, s in zip(at.tolist(), count.tolist(), total.tolist(), strict=True):
        blocks.append([x * n, n, s])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    sums = np.array(blocks)
    # not quite sure at the ends: half an example of all is held against either
    doubt = 0.5 / (sums[:, 1].sum() + 1)
    return sums[:, 0] / sums[:, 1], np.clip(sums[:, 2] / sums[:, 1], doubt, 1 - doubt)


def fit_quality(statistics: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> QualityModel:
    """Fit on the labelled rows of ``statistics`` that aren't held out, all of them."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    rows = materialize(statistics.where(fold_of("doc_id") != 1).join(known, "doc_id").select("statistics", "label", fold_of("doc_id").alias("fold")), "training")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, STATISTICS))
        for batch in batches:
            x = _matrix(batch.column(0))
            total += [np.full(STATISTICS, len(x)), x.sum(axis=0), (x**2).sum(axis=0)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(STATISTICS), pa.int32()), *(pa.array(x) for x in total)], ["k", "n", "s", "q"])

    sums = np.array([tuple(r) for r in rows.select("statistics").mapInArrow(moments, "k int, n double, s double, q double").groupBy("k").agg(F.sum("n"), F.sum("s"), F.sum("q")).collect()])  # STATISTICS rows
    if not len(sums) or not sums[0, 1]:
        return QualityModel(*(np.zeros(0) for _ in range(5)))
    sums = sums[sums[:, 0].argsort()]
    mean = sums[:, 2] / sums[:, 1]
    scale = np.maximum(np.sqrt(np.maximum(sums[:, 3] / sums[:, 1] - mean**2, 0)), 1e-6)
    size = FOURIER + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x, label, fold = _matrix(batch.column(0)), batch.column(1).to_numpy().astype(float), batch.column(2).to_numpy()
            for f in np.unique(fold).tolist():
                z = fourier(x[fold == f], mean, scale)
                total[f] = total.get(f, 0) + z.T @ np.concatenate((z, label[fold == f][:, None]), axis=1)
        for f, cell in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(cell.size, f), pa.int32()), pa.array(np.arange(cell.size), pa.int32()), pa.array(cell.ravel())], ["fold", "cell", "value"])

    parts = rows.mapInArrow(equations, "fold int, cell int, value double").groupBy("fold", "cell").agg(F.sum("value").alias("value"))
    normal = {0: np.zeros((size, size + 1)), 2: np.zeros((size, size + 1))}
    for fold, cell, value in parts.collect():  # two folds of (FOURIER + 1) * (FOURIER + 2) cells
        normal[fold].ravel()[cell] = value
    solve = lambda m: np.linalg.solve(m[:, :size] + RIDGE * max(m[-1, size - 1], 1) * np.eye(size) / FOURIER, m[:, size])
    crossed = {0: solve(normal[2]), 2: solve(normal[0])}
    low, high = RANGE

    def crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, fold = _matrix(batch.column(0)), batch.column(2).to_numpy()
            raw = np.zeros(len(x))
            for f in np.unique(fold).tolist():
                raw[fold == f] = fourier(x[fold == f], mean, scale) @ crossed[f]
            yield pa.RecordBatch.from_arrays([pa.array(np.clip((raw - low) / (high - low) * BINS, 0, BINS - 1).astype(np.int32)), batch.column(1)], ["bin", "label"])

    binned = sorted(tuple(r) for r in rows.mapInArrow(crossing, "bin int, label int").groupBy("bin").agg(F.count("*"), F.sum("label")).collect())  # BINS rows at most
    bins, count, good = (np.array(x, float) for x in zip(*binned, strict=True))
    if good.sum() in (0, count.sum()):
        return QualityModel(*(np.zeros(0) for _ in range(5)))
    at, curve = isotonic(low + (bins + 0.5) / BINS * (high - low), count, good)
    return QualityModel(mean, scale, solve(normal[0] + normal[2]), at, curve)


def quality_scores(statistics: DataFrame, model: QualityModel) -> DataFrame:
    """Row identity, doc_id and score of every row of ``statistics``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(model.score(_matrix(batch.column(3))))], [*RID, "doc_id", "score"])

    return statistics.select(*RID, "doc_id", "statistics").mapInArrow(score, f"{RID[0]} long, {RID[1]} long, doc_id long, score double")


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is ``least`` or more."""
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, found in _statistics_of(batch.column(at)):
                yield batch.slice(i, j - i).filter(pa.array(model.score(found) >= least))

    return docs.mapInArrow(keep, docs.schema)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, from the labels of two thirds of the ids."""
    statistics = quality_statistics(spark.read.parquet(f"{sf_dir}/documents.parquet"), scan=True)
    scores = quality_scores(statistics, fit_quality(statistics, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scores.select("doc_id", F.coalesce(fold_of("doc_id") == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
