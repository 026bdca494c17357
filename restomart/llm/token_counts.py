"""Token counts of messages, with a shortcut for words that are one token by themselves."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from restomart.llm.common import contents

SPACE = "▁"  # how the vocabulary writes a space
REMEMBERED = 400_000  # counts of other words that one Python worker remembers


def whole_tokens(processor) -> dict[str, int]:
    """Words (without their space) that a sentence-piece model turns into exactly one token.

    Every vocabulary string of the form space + word is encoded alone; only those that come back
    as their own id are taken, since merge order can keep a string from being reached.
    """
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    words = [(i, p[1:]) for i, p in enumerate(pieces)
             if p[:1] == SPACE and len(p) > 1 and SPACE not in p[1:]
             and not (processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i))]
    encoded = processor.encode([w for _, w in words], num_threads=1)
    return {w: 1 for (i, w), ids in zip(words, encoded) if ids == [i]}


def words_are_separate(processor) -> bool:
    """No vocabulary string holds a space after another character, and texts are only escaped:
    then no merge crosses the border before a space, and words can be counted one by one."""
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    inner = any(SPACE in p.lstrip(SPACE) for p in pieces)
    probe = " a éﬁＡ  b "
    return not inner and processor.decode(processor.encode(probe)) == probe


class PieceCounter(dict):
    """Tokens of a word that follows a space; starts with the whole-token words."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.separate = words_are_separate(self.processor)
        super().__init__(whole_tokens(self.processor) if self.separate else {})
        self.limit = len(self) + REMEMBERED
        self.last_space = len(self.processor.encode("a ")) - len(self.processor.encode("a"))

    def __missing__(self, word: str) -> int:
        n = len(self.processor.encode(word))
        if len(self) < self.limit:
            self[word] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.separate:
            return len(self.processor.encode(text))
        words = text.replace(SPACE, " ").split(" ")
        if "" not in words:
            return sum(map(self.__getitem__, words))
        # A run of spaces belongs to the word that follows it.
        total, run = 0, 0
        for word in words:
            if word:
                total += len(self.processor.encode(" " * run + word)) if run else self[word]
                run = 0
            else:
                run += 1
        if run:
            total += self.last_space if run == 1 else len(self.processor.encode(" " * (run - 1)))
        return total


class JsonCounter:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def count(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)


_counters: dict[str, PieceCounter | JsonCounter] = {}


def counter(path: str) -> PieceCounter | JsonCounter:
    """The counter of a tokenizer file, made once per Python worker."""
    if path not in _counters:
        _counters[path] = (PieceCounter if path.endswith(".model") else JsonCounter)(path)
    return _counters[path]


def message_tokens(messages: DataFrame, tokenizer: str, limit: int = 4096) -> DataFrame:
    """Size of every message in UTF-8 bytes and in tokens of the file ``tokenizer``.

    ``tokenizer`` is a sentence-piece ``.model`` or a ``.json`` file that executors can open.
    Takes ``messages`` (``id``, ``content``); gives per row ``id``, ``n_bytes``, ``n_tokens`` and
    ``over_limit`` (more than ``limit`` tokens). Begin, end and added special tokens are left out;
    special strings inside a text are what the library makes of them. Whole texts are counted.

    Words that are one token are looked up; other words are merged by the library, once per
    worker as long as its memory of ``REMEMBERED`` words lasts. Null or empty content has 0 bytes
    and tokens. Repeated rows and null ids stay as they are; other columns are ignored; an empty
    table gives an empty result.
    """
    def tokens(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(tokenizer).count
        for part in parts:
            yield pd.Series([count(text) for text in part], dtype="int64")

    n_tokens = F.pandas_udf(tokens, "long")
    out = contents(messages).select("id", F.octet_length("content").cast("long").alias("n_bytes"),
                                    n_tokens("content").alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
