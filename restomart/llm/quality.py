"""Quality of messages: regularised quadratic discriminant over text statistics."""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from restomart.llm.common import contents, materialize

SHRINK_POOLED = 0.1  # weight of the covariance of both classes together
SHRINK_DIAGONAL = 0.1  # and of its diagonal alone within that

_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_SPACE = np.array([b in b" \t\n\r\x0b\x0c" for b in range(256)])
_STOP = np.array([b in b".,;:" for b in range(256)])
_LOUD = np.array([b in b"!?" for b in range(256)])
_SYMBOL = ~(_LETTER | _DIGIT | _SPACE | _STOP | _LOUD)


def _logit(share: float) -> float:
    return float(np.log((share + 1e-3) / (1 - share + 1e-3)))


def statistics(text: str) -> list[float]:
    """Transformed statistics of a whole text: counts as logarithms, shares as log odds."""
    seen = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size = max(1, int(seen.sum()))
    letters = max(1, int(seen[_LETTER].sum()))
    words, lines = text.split(), [x for x in text.split("\n") if x]
    n, rows = max(1, len(words)), max(1, len(lines))
    common = Counter(words).most_common(1)
    share = seen[seen > 0] / size
    return [
        float(np.log1p(len(words))),
        float(np.log1p(size / n)),
        float(np.log1p(size / rows)),
        _logit(seen[_UPPER].sum() / letters),
        _logit(seen[_DIGIT].sum() / size),
        _logit(seen[_SYMBOL].sum() / size),
        _logit(seen[_LOUD].sum() / size),
        _logit(seen[_STOP].sum() / size),
        _logit(seen[_SPACE].sum() / size),
        float(-(share * np.log(share)).sum()),
        _logit(len(set(words)) / n),
        _logit(sum(map(operator.eq, words, words[1:])) / n),
        _logit(1 - len(set(lines)) / rows if lines else 0.0),
        _logit(common[0][1] / n if common else 0.0),
    ]


SIZE = len(statistics(""))


def _statistics(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield pd.Series([statistics(text) for text in part], dtype=object)


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of products of each class in a partition; a leading one gives counts and sums too."""
    total = np.zeros((2, SIZE + 1, SIZE + 1))
    for batch in batches:
        for label in (0, 1):
            rows = batch["statistics"][batch["quality"] == label]
            if len(rows):
                x = np.column_stack([np.ones(len(rows)), np.stack(rows.to_numpy())])
                total[label] += x.T @ x
    label, i, j = np.indices(total.shape).reshape(3, -1)
    yield pd.DataFrame({"quality": label, "i": i, "j": j, "value": total.ravel()})


class Discriminant:
    """Log density difference of two normal classes, from cached Cholesky factors."""

    def __init__(self, moments: np.ndarray):
        n = moments[:, 0, 0]
        means = moments[:, 0, 1:] / n[:, None]
        scatter = moments[:, 1:, 1:] - n[:, None, None] * means[:, :, None] * means[:, None, :]
        pooled = scatter.sum(axis=0) / n.sum()
        target = (1 - SHRINK_DIAGONAL) * pooled + SHRINK_DIAGONAL * np.diag(np.diag(pooled))
        floor = 1e-6 * np.eye(SIZE)
        own = (1 - SHRINK_POOLED) * scatter / n[:, None, None] + SHRINK_POOLED * target + floor
        self.means = means
        self.inverse = [np.linalg.inv(np.linalg.cholesky(c)) for c in own]
        self.constant = [np.log(np.diag(f)).sum() + np.log(k / n.sum()) for f, k in zip(self.inverse, n)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        log = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1)
               for m, f, c in zip(self.means, self.inverse, self.constant)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def score_quality(messages: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Probability that a message is of good quality.

    Takes ``messages`` (``id``, ``content``) and ``labels`` (``id``, ``quality`` 1 or 0) to learn
    from; gives per message ``id``, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).
    Statistics of the whole content alone decide. They are taken once per message; means and
    covariances come from all labelled messages, summed in each partition before the shuffle. The
    class covariances are shrunk towards the pooled one and that towards its diagonal.

    Null content counts as empty, which has a score like any text. Labels that are null, neither 0
    nor 1, or of no message are ignored. If a class has no label, every score is the share of
    class 1 among the labels, or 0.5 without labels. Repeated messages stay as they are and, like
    repeated labels, count as often as they occur; a null id is scored; other columns are ignored;
    an empty table gives an empty result.
    """
    stats = F.pandas_udf(_statistics, "array<double>")
    rows = materialize(contents(messages).select("id", stats("content").alias("statistics")), "statistics")
    known = labels.filter("quality in (0, 1) and id is not null").select("id", F.col("quality").cast("int"))
    summed = rows.join(known, "id").select("quality", "statistics").mapInPandas(
        _moments, "quality int, i int, j int, value double").groupBy("quality", "i", "j").agg(
        F.sum("value").alias("value")).toPandas()
    moments = np.zeros((2, SIZE + 1, SIZE + 1))
    moments[summed["quality"], summed["i"], summed["j"]] = summed["value"]
    n = moments[:, 0, 0]
    model = Discriminant(moments) if n.min() > 0 else None
    share = float(n[1] / n.sum()) if n.sum() else 0.5

    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            if model is None or not len(part):
                yield pd.Series(np.full(len(part), share))
            else:
                yield pd.Series(model.score(np.stack(part.to_numpy())))

    out = rows.select("id", F.pandas_udf(score, "double")("statistics").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
