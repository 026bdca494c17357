"""Language of messages: sparse logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from restomart.llm.common import bounded_batches, contents

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16  # hashed n-grams
TRAIN_ROWS = 400  # examples of each language that the weights are fitted on
CHUNK = 200_000  # characters that one step works on
LOSS, LANGUAGE_LOSS = 0.001, 0.01  # share of held-out texts, and of those of one language, that a bound may cost
MARGIN = 0.1  # further way of a bound to what a text without a known n-gram has
LENGTHS = tuple(1 << k for k in range(1, 13))  # characters at which a length class begins
UNKNOWN = "und"

_ODD = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393], np.uint32)
_LETTER = regex.compile(r"\p{L}")


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased texts, each between two spaces, and where each text begins."""
    padded = [f" {t.lower()} " for t in texts]
    starts = np.cumsum([0, *map(len, padded)])
    return np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def _gram_ids(codes: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """Hashed n-gram at every place; ``BUCKETS`` where it would run over the text's end."""
    h = np.full(len(codes) - order + 1, _ODD[4] * np.uint32(order), np.uint32)
    for i in range(order):
        h += codes[i:len(codes) - order + 1 + i] * _ODD[i]
    h ^= h >> np.uint32(15)
    ids = ((h * _ODD[3]) >> np.uint32(16)).astype(np.int32)
    for i in range(1, order):
        over = starts[1:] - i
        ids[over[over < len(ids)]] = BUCKETS
    return ids


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a text and how often each occurs."""
    codes, starts = _codes([text])
    grams = np.concatenate([_gram_ids(codes, starts, n) for n in ORDERS])
    return np.unique(grams[grams < BUCKETS], return_counts=True)


def _document_frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total, seen, rows = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS + 1, bool), 0
    for batch in batches:
        for text in batch["content"]:
            codes, starts = _codes([text])
            grams = [_gram_ids(codes, starts, n) for n in ORDERS]
            for ids in grams:
                seen[ids] = True
            total += seen[:BUCKETS]
            for ids in grams:
                seen[ids] = False
            rows += 1
    found = np.flatnonzero(total)
    yield pd.DataFrame({"gram": [*found, -1], "n": [*total[found], rows]})


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counted = [gram_counts(t) for t in batch["content"]]
        yield pd.DataFrame({"language": batch["language"], "grams": [g for g, _ in counted],
                            "counts": [c for _, c in counted]})


@dataclass
class LanguageModel:
    """``weights`` hold the inverse document frequency, so a text's logits are means of rows.

    Their last column is the inverse document frequency alone: its mean over a text tells how
    strange the text's n-grams are to the examples, in whichever language.
    """
    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def _sums(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Summed rows, and number, of each text's n-grams."""
        logits, grams = np.zeros((len(starts) - 1, len(self.languages) + 1)), np.zeros(len(starts) - 1)
        for n in ORDERS:
            ids = _gram_ids(codes, starts, n)
            begin = np.minimum(starts[:-1], len(ids) - 1)
            logits += np.add.reduceat(self.weights[ids], begin, axis=0)
            grams += np.maximum(starts[1:] - starts[:-1] - n + 1, 0)
        return logits, grams

    def _long_sums(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The same of one text, in pieces of bounded length; each ends with the places its last n-grams need."""
        codes, _ = _codes([text])
        logits, grams = np.zeros((1, len(self.languages) + 1)), np.zeros(1)
        for n in ORDERS:
            for i in range(0, len(codes) - n + 1, CHUNK):
                piece = codes[i:i + CHUNK + n - 1]
                ids = _gram_ids(piece, np.array([0, len(piece)]), n)
                logits += self.weights[ids].sum(axis=0, dtype=np.float64)
                grams += len(ids)
        return logits, grams

    def measures(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each language, and strangeness, of texts."""
        logits, grams = self._sums(*_codes(texts)) if len(texts) > 1 else self._long_sums(texts[0])
        means = logits / grams[:, None]
        z = (means[:, :-1] + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True), means[:, -1]


class Ftrl:
    """Follow-the-regularised-leader for a softmax over sparse rows, with L1 and L2 penalties."""

    def __init__(self, features: int, classes: int, alpha=0.3, beta=1.0, l1=0.02, l2=0.01):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        step = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        return -np.sign(z) * np.maximum(np.abs(z) - self.l1, 0) / step

    def learn(self, rows: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(rows)
        logit = x @ w
        p = np.exp(logit - logit.max())
        p /= p.sum()
        p[label] -= 1
        g = np.outer(x, p)
        n = self.n[rows]
        self.z[rows] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[rows] = n + g * g


def fit_language(examples: DataFrame, train_rows: int = TRAIN_ROWS, rounds: int = 4) -> LanguageModel | None:
    """Learns from ``examples`` (``content``, ``language``); None without any labelled text.

    Document frequencies count all labelled examples: each partition sums its own, so at most
    ``BUCKETS`` rows come out of a partition and reach the driver. Weights are fitted on the driver
    from about ``train_rows`` examples of each language, drawn by hash; a fifth of them sets the
    temperature.
    """
    bounded_batches(examples.sparkSession)
    known = examples.filter("language is not null and content is not null").select(
        F.col("content").cast("string"), F.col("language").cast("string"))
    sizes = {r["language"]: r["n"] for r in known.groupBy("language").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    frequency = known.select("content").mapInPandas(_document_frequencies, "gram int, n long").groupBy(
        "gram").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS)
    df[frequency["gram"][frequency["gram"] >= 0]] = frequency["n"][frequency["gram"] >= 0]
    idf = np.log((1 + sum(sizes.values())) / (1 + df)) + 1

    lot = F.pmod(F.xxhash64("content", F.lit(4)), F.lit(1_000_000)) / 1_000_000
    chance = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, train_rows / n))])
    # Copies of one text share their lot, so the draw is by text; the limit bounds it.
    drawn = known.withColumn("lot", lot).filter(F.col("lot") < chance[F.col("language")]).dropDuplicates(
        ["content", "language"]).orderBy("lot", "content").limit(2 * train_rows * len(sizes))
    rows = drawn.mapInPandas(_vectors, "language string, grams array<int>, counts array<int>").toPandas()

    languages = sorted(sizes)
    order = np.random.default_rng(4).permutation(len(rows))
    vectors = [(np.asarray(rows["grams"].iloc[i]), np.asarray(rows["counts"].iloc[i], float),
                languages.index(rows["language"].iloc[i])) for i in order]
    vectors = [(np.append(g, BUCKETS), np.append(c / c.sum() * idf[g] * len(ORDERS), 1.0), y)
               for g, c, y in vectors]
    held = vectors[::5] if len(vectors) >= 50 else vectors
    model = Ftrl(BUCKETS + 1, len(languages), l1=1e-4, l2=1e-3, alpha=20.0)
    for _ in range(rounds):
        for i, (g, x, y) in enumerate(vectors):
            if i % 5 or len(vectors) < 50:
                model.learn(g, x, y)
    w = model.weights()
    logits = np.array([x @ w[g] for g, x, _ in held])
    truth = np.array([y for _, _, y in held])

    def loss(t: float) -> float:
        z = logits / t
        z -= z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]))

    temperature = min(np.geomspace(0.05, 20, 80), key=loss)
    scaled = np.vstack([np.column_stack([w[:BUCKETS] * idf[:, None] * len(ORDERS), idf]), np.zeros(len(languages) + 1)])
    return LanguageModel(languages, scaled.astype(np.float32), w[BUCKETS], float(temperature))


def language_udf(model: LanguageModel | None):
    """A column function from content to ``language``, ``score`` and ``strange``, the content's strangeness."""
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part.tolist()
            names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            strange = np.zeros(len(texts))
            lettered = [i for i, t in enumerate(texts) if _LETTER.search(t)]
            scores[:] = 1.0 if model else 0.0
            while model and lettered:
                size, n = 0, 0
                while n < len(lettered) and (n == 0 or size + len(texts[lettered[n]]) < CHUNK):
                    size += len(texts[lettered[n]])
                    n += 1
                now, lettered = lettered[:n], lettered[n:]
                p, strange[now] = model.measures([texts[i] for i in now])
                names[now] = np.array(model.languages, object)[p.argmax(axis=1)]
                scores[now] = p.max(axis=1)
            yield pd.DataFrame({"language": names, "score": scores, "strange": strange})

    return F.pandas_udf(predict, "language string, score double, strange double")


def held_out(content: Column) -> Column:
    """A fifth of the texts, by hash, so copies are on one side: not for weights but for bounds."""
    return F.pmod(F.xxhash64(content, F.lit(5)), F.lit(5)) == 0


def _outermost(counted: list[tuple[float, int]], allowed: int) -> float:
    """The first value with more than ``allowed`` rows up to it, of (value, rows) from the outermost inwards."""
    for value, n in counted:
        allowed -= n
        if allowed < 0:
            break
    return value


def clean_bounds(model: LanguageModel, held: DataFrame) -> dict[int, tuple[float, float]]:
    """Least score and greatest strangeness of texts in a learnt language, for each of ``LENGTHS``.

    A text's logits are means over its n-grams and the temperature fits whole texts, so a short
    clean text scores lower than a long one by chance alone, and one bound for all lengths costs
    clean short texts. The score alone does not do either: it compares the learnt languages with
    each other, and a few n-grams can make foreign text look sure. So ``held`` (``content``,
    ``language``, not seen by the fit) is measured again cut to each length. Either bound of a
    length loses at most ``LOSS`` of all and ``LANGUAGE_LOSS`` of any language, less what a
    ``MARGIN`` towards an even guess and towards text without a known n-gram gives back. Lengths
    with too few texts to measure the loss take the bounds below them; if all have too few, the
    bounds lie halfway instead.
    """
    rows = held.filter("content is not null and language is not null").select(
        F.col("content").cast("string"), F.col("language").cast("string"))

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, texts = batch["language"].tolist(), batch["content"].tolist()
            for length in LENGTHS:
                cut = [(g, t[:length]) for g, t in zip(names, texts) if len(t) >= length and _LETTER.search(t[:length])]
                for i in range(0, len(cut), 256):
                    part = cut[i:i + 256]
                    p, strange = model.measures([t for _, t in part])
                    yield pd.DataFrame({"language": [g for g, _ in part], "length": length,
                                        "score": np.floor(p.max(axis=1) * 1_000) / 1_000,
                                        "strange": np.ceil(strange * 100) / 100})

    # An even guess, and the greatest strangeness there is: no n-gram occurs in any example.
    even, most = 1 / len(model.languages), float(model.weights[:, -1].max())
    # Rounded measures: their number is bounded, however many texts there are.
    counts = rows.mapInPandas(measured, "language string, length int, score double, strange double").select(
        "language", "length", F.posexplode(F.array("score", "strange")).alias("which", "value")).groupBy(
        "language", "length", "which", "value").agg(F.count(F.lit(1)).alias("n")).toArrow().to_pandas()
    sizes = counts[counts["which"] == 0].groupby("length")["n"].sum().to_dict()
    enough = {length for length, n in sizes.items() if n * LOSS >= 1}
    out: dict[int, tuple[float, float]] = {}
    groups = [(int(length), int(which), LOSS, part) for (length, which), part in counts.groupby(["length", "which"])]
    groups += [(int(length), int(which), LANGUAGE_LOSS, part) for (length, which, _), part in counts.groupby(["length", "which", "language"])]
    for length, which, loss, part in groups:
        if enough and length not in enough:
            continue
        values = part.groupby("value")["n"].sum().sort_index(ascending=which == 0)
        bound = _outermost(list(zip(values.index.tolist(), values.tolist())), int(loss * values.sum()))
        bound += (MARGIN if enough else 0.5) * ((even, most)[which] - bound)
        score, strange = out.get(length, (1.0, 0.0))
        out[length] = (score, max(strange, bound)) if which else (min(score, bound), strange)
    return out


def identify_language(messages: DataFrame, examples: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Language of every message (``id``, ``content``), learnt from ``examples``.

    Gives per row ``id``, ``language`` (one of the learnt values) and ``score``, its calibrated
    probability. Only the content decides, and all of it. Null content or content without a letter
    is ``und`` with score 1; so is every message, with score 0, if nothing could be learnt.
    Repeated rows and null ids stay as they are; other columns are ignored; an empty table gives
    an empty result.
    """
    found = language_udf(fit_language(examples, train_rows))
    return contents(messages).select("id", found("content").alias("found")).select("id", "found.language", "found.score")
