"""Test questions inside messages: a positional inverted index, searched from the rarest terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from restomart.llm.common import contents, materialize

WINDOW = 10
SLACK = 2
# Rows of at most some 100 bytes that are sent to every executor; larger tables are joined by a shuffle.
BROADCAST_ROWS = 500_000

_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _parts(text: Column) -> Column:
    """Words between breaks, not yet in lower case; the first and last may be empty."""
    return F.split(text, _BREAKS)


def _lower(word: Column) -> Column:
    """A-Z in lower case and nothing else; a word of one byte per character needs no care."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(
        F.translate(word, _UPPER, _LOWER))


def word_count(text: Column) -> Column:
    parts = _parts(text)
    empty = lambda i: F.when(F.element_at(parts, i) == "", 1).otherwise(0)
    return F.when(F.size(parts) == 1, F.size(parts) - empty(1)).otherwise(
        F.size(parts) - empty(1) - empty(-1)).cast("long")


def _small(df: DataFrame) -> DataFrame:
    """Marks a stored table for broadcast if its counted rows allow it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def question_words(questions: DataFrame) -> DataFrame:
    """``question`` (a key of id and text), ``item_id`` as text, and ``words`` of every distinct
    question that has a word."""
    rows = contents(questions).distinct()
    words = F.filter(F.transform(_parts(F.col("content")), _lower), lambda w: w != "")
    return rows.select(F.xxhash64("id", "content").alias("question"), F.col("id").cast("string").alias("item_id"),
                       words.alias("words")).filter(F.size("words") > 0)


def positional_index(messages: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings ``id``, ``copy`` (a hash of the content), ``pos`` and ``word`` of every occurrence in the
    messages of a word of ``vocabulary``, stored."""
    rows = contents(messages).select("id", F.xxhash64("content").alias("copy"),
                                     F.posexplode(_parts(F.col("content"))).alias("pos", "part"))
    return materialize(rows.select("id", "copy", "pos", _lower(F.col("part")).alias("word")).join(
        _small(vocabulary), "word").select("id", "copy", "pos", "word"), "postings")


def rarest_pairs(items: DataFrame, postings: DataFrame, window: int, slack: int) -> DataFrame:
    """Places ``a`` and ``b`` in a question of the rarest and second rarest term of its windows, by
    frequency in the whole index. A question shorter than ``window`` is one window. Windows of
    which more than ``slack`` terms are in no message are left out."""
    frequency = postings.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    terms = items.select("question", F.size("words").alias("size"), F.posexplode("words").alias("p", "word"))
    terms = terms.join(frequency, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ahead = Window.partitionBy("question").orderBy("p").rowsBetween(0, window - 1)
    ranked = terms.withColumn("near", F.filter(F.array_sort(F.collect_list(
        F.struct("n", "p", "word")).over(ahead)), lambda t: t["n"] > 0))
    ranked = ranked.filter((F.col("p") <= F.greatest(F.lit(0), F.col("size") - window)) & (
        F.size("near") >= F.greatest(F.lit(1), F.least(F.col("size"), F.lit(window)) - slack)))
    first = F.element_at("near", 1)
    second = F.coalesce(F.get("near", F.lit(1)), first)
    return ranked.select(
        "question", first["p"].alias("a"), first["word"].alias("a_word"), second["p"].alias("b"),
        second["word"].alias("b_word")).distinct()


def _runs(places: Column, window: Column, slack: int) -> Column:
    """Runs of at least ``window`` sorted places with at most ``slack`` others between neighbours, each
    given by every place that ends ``window`` or more of them."""
    step = lambda acc, p: F.concat(acc, F.array(F.struct(
        p.alias("p"), F.when(p - F.element_at(acc, -1)["p"] <= 1 + slack, F.element_at(acc, -1)["run"] + 1)
        .otherwise(1).alias("run"))))
    start = F.array(F.struct(F.lit(-1_000_000).alias("p"), F.lit(0).alias("run")))
    return F.filter(F.aggregate(places, start, step), lambda r: r["run"] >= window)


def _compared(a: Column, window: int, slack: int) -> Column:
    """What an aligned question shares with the message's ``postings``: places of exact hits and the ends
    of near phrases."""
    size = F.least(F.size(a["words"]), F.lit(window))
    places = F.array_sort(F.transform(
        F.filter("postings", lambda x: F.get(a["words"], x["pos"] - a["shift"]) == x["word"]),
        lambda x: x["pos"] - a["shift"]))
    return F.struct(
        a["item_id"].alias("item_id"),
        F.flatten(F.transform(_runs(places, size, 0), lambda r: F.sequence(
            a["shift"] + r["p"] - size + 1, a["shift"] + r["p"]))).alias("hit"),
        F.transform(_runs(places, size, slack), lambda r: a["shift"] + r["p"]).alias("near"))


def find_contamination(messages: DataFrame, questions: DataFrame, window: int = WINDOW,
                       slack: int = SLACK) -> DataFrame:
    """Messages that hold passages of test questions.

    Takes ``messages`` and ``questions`` (both ``id``, ``content``). Gives per message ``id``, ``n_words``,
    ``n_hit`` (its words inside any occurrence of ``window`` consecutive words of a question, or of a
    whole shorter question), ``items`` (sorted ids, as text, of the questions that occur), ``n_near`` (its
    words that end a near phrase: ``window`` words of a question at their own distance, with at most
    ``slack`` other words between neighbours) and ``contaminated`` (``n_hit`` > 0). A-Z are lower-cased;
    words are runs of letters, digits and characters beyond ASCII.

    The index holds every occurrence of every question word with its place. Each window is searched
    by its rarest term: that list, adjusted by the term's place, is intersected with the list of the
    second rarest; for the places that remain, all postings of the message are compared with the
    whole question. All of it runs in SQL functions. Small tables are broadcast only after a count.

    Null content has no words, as has empty content. Repeated messages each get the same row.
    Questions without words are ignored; repeated questions count once; a question without an id
    marks words but is not listed. A null message id is kept. Other columns are ignored; without
    messages the result is empty, without questions nothing is contaminated.
    """
    items = materialize(question_words(questions), "questions")
    vocabulary = materialize(items.select(F.explode("words").alias("word")).distinct(), "vocabulary")
    postings = positional_index(messages, vocabulary)
    pairs = materialize(rarest_pairs(items, postings, window, slack), "rarest")

    doc = ["id", "copy"]
    start = F.col("pos") - F.col("a")
    rarest = postings.join(_small(pairs.withColumnRenamed("a_word", "word")), "word").select(
        "question", *doc, start.alias("shift"), (start + F.col("b")).alias("pos"), F.col("b_word").alias("word"))
    seconds = materialize(pairs.select(F.col("b_word").alias("word")).distinct(), "second-words")
    second = postings.join(_small(seconds), "word", "left_semi")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) if c == "id" else F.col(f"l.{c}") == F.col(f"r.{c}")
            for c in ("id", "copy", "pos", "word")]
    aligned = materialize(rarest.alias("l").join(second.alias("r"), same, "left_semi").select(
        "question", *doc, "shift").distinct(), "aligned")

    met = materialize(aligned.select(*doc).distinct(), "met")
    held = postings.alias("l").join(_small(met).alias("r"), (F.col("l.copy") == F.col("r.copy")) & F.col(
        "l.id").eqNullSafe(F.col("r.id")), "left_semi").groupBy(*doc).agg(
        F.collect_set(F.struct("pos", "word")).alias("postings"))
    # One row per message: a short question may lie in one message a thousand times.
    lists = aligned.join(items, "question").groupBy(*doc).agg(
        F.collect_list(F.struct("item_id", "words", "shift")).alias("aligned"))
    compared = lists.alias("l").join(
        held.alias("r"), (F.col("l.copy") == F.col("r.copy")) & F.col("l.id").eqNullSafe(F.col("r.id"))).select(
        "l.id", "l.copy", F.transform("aligned", lambda a: _compared(a, window, slack)).alias("found"))
    places = lambda name: F.size(F.array_distinct(F.flatten(F.transform(
        "found", lambda f: f[name])))).cast("long").alias(f"n_{name}")
    found = compared.select(*doc, places("hit"), places("near"), F.array_sort(F.array_distinct(F.array_compact(
        F.transform(F.filter("found", lambda f: F.size(f["hit"]) > 0), lambda f: f["item_id"])))).alias("items"))

    rows = contents(messages).select("id", F.xxhash64("content").alias("copy"),
                                     word_count(F.col("content")).alias("n_words"))
    out = rows.alias("l").join(found.alias("r"), (F.col("l.copy") == F.col("r.copy")) & F.col("l.id").eqNullSafe(
        F.col("r.id")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select("l.id", "n_words", zero("n_hit"), zero("n_near"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
