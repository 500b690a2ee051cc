"""Encoding with a public byte-level BPE tokenizer, by an automaton of frequent words.

The corpus' most frequent words (a blank and what follows up to the next one) are compiled, with
their id lists, into a minimal acyclic automaton: words with equal remainders share states, and the number of words below each state turns a path
into the word's number, under which its ids stand in one flat array (a transducer with outputs
pushed to numbers). The arrays are files that every task maps into memory. Words that the automaton
doesn't know are merged exactly by the tokenizer's ranks.
"""

from __future__ import annotations

import base64
import importlib.util
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataql.session import shared_dir

#: The words compiled into the automaton; all others are merged exactly.
LEXICON_WORDS = 60_000
#: Words of more bytes aren't compiled.
LONGEST_WORD = 48
#: Word ids kept in one task.
KEPT = 300_000
#: Longer words are not kept: they hardly come again.
KEPT_LENGTH = 200

#: Fixed value: the public pattern by which byte-level BPE cuts text into pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: what \s in it stands for.
BLANKS = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words of whole pieces: no piece goes across their ends, and the pieces of a word don't depend on what is around it.
WORD = re.compile(f" ?[^{BLANKS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")

DEFAULT_FOLDER = "/opt/tokenizers"


def tokenizer_folder() -> str:
    """Where the vocabulary files are: a parameter of every function, by default this folder."""
    if os.path.isdir(DEFAULT_FOLDER):
        return DEFAULT_FOLDER
    spec = importlib.util.find_spec("public_tokenizers")
    return os.path.dirname(spec.origin) if spec and spec.origin else DEFAULT_FOLDER


@lru_cache(maxsize=4)
def _merger(path: str):
    """The exact merger: tiktoken over the ranks of the file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def cut(text: str) -> list[str]:
    """The words of a text; they join to the text."""
    return WORD.findall(text)


def merge(word: str, path: str) -> list[int]:
    """The ids of one word by exact merging."""
    return _merger(path).encode_ordinary(word)


# ---------------------------------------------------------------------------------------------
# The automaton


class Lexicon:
    """Frequent words as a minimal acyclic automaton over bytes, with id outputs.

    Arrays: for state s its transitions are the entries first[s] to first[s+1] of label, target and
    skip; skip counts the words that sort before that transition below s. final[s] marks word ends.
    ids[start[n] to start[n+1]] are the ids of word number n.
    """

    NAMES = ("first", "label", "target", "skip", "final", "start", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        for name in self.NAMES:
            setattr(self, name, arrays[name])
        # One sorted key for each transition makes a step for many words at once a binary search.
        self.keys = np.repeat(np.arange(len(self.first) - 1, dtype=np.int64), np.diff(self.first)) * 256 + self.label

    @classmethod
    def build(cls, words: dict[bytes, list[int]]) -> Lexicon:
        """Compile words in sorted order, replacing finished states by equal earlier ones."""
        register: dict[tuple, int] = {}
        states: list[tuple] = []  # (final, ((label, target), ...))
        counts: list[int] = []  # words below each state

        def freeze(final: bool, out: list[tuple[int, int]]) -> int:
            key = (final, tuple(out))
            found = register.get(key)
            if found is None:
                found = register[key] = len(states)
                states.append(key)
                counts.append(int(final) + sum(counts[t] for _, t in out))
            return found

        path: list[list] = [[False, []]]  # unfinished states along the last word: final, transitions
        labels: list[int] = []
        previous = b""
        ordered = sorted(words)
        for word in ordered:
            k = 0
            while k < min(len(word), len(previous)) and word[k] == previous[k]:
                k += 1
            while len(labels) > k:
                final, out = path.pop()
                path[-1][1].append((labels.pop(), freeze(final, out)))
            for b in word[k:]:
                labels.append(b)
                path.append([False, []])
            path[-1][0] = True
            previous = word
        while labels:
            final, out = path.pop()
            path[-1][1].append((labels.pop(), freeze(final, out)))
        root = freeze(*path[0])
        first, label, target, skip = [0], [], [], []
        for final, out in states:
            before = int(final)
            for b, t in out:
                label.append(b)
                target.append(t)
                skip.append(before)
                before += counts[t]
            first.append(len(label))
        start, ids = [0], []
        for word in ordered:
            ids += words[word]
            start.append(len(ids))
        made = cls(
            {
                "first": np.array(first, np.int32),
                "label": np.array(label, np.uint8),
                "target": np.array(target, np.int32),
                "skip": np.array(skip, np.int32),
                "final": np.array([f for f, _ in states], np.bool_),
                "start": np.array(start, np.int32),
                "ids": np.array(ids, np.int32),
            }
        )
        assert root == len(states) - 1
        return made

    def to_bytes(self) -> bytes:
        """A small head with the lengths, then the arrays, each at a multiple of 8 bytes."""
        arrays = [np.ascontiguousarray(getattr(self, n)) for n in self.NAMES]
        out = bytearray(np.array([len(a) for a in arrays], np.int64).tobytes())
        for a in arrays:
            out += b"\0" * (-len(out) % 8)
            out += a.tobytes()
        return bytes(out)

    @classmethod
    def load(cls, path: str) -> Lexicon:
        """Map the file into memory; tasks on one machine share its pages."""
        raw = np.memmap(path, np.uint8, "r")
        lengths = raw[: 8 * len(cls.NAMES)].view(np.int64)
        kinds = {"label": np.uint8, "final": np.bool_}
        at, arrays = 8 * len(cls.NAMES), {}
        for name, n in zip(cls.NAMES, lengths):
            at += -at % 8
            kind = np.dtype(kinds.get(name, np.int32))
            arrays[name] = raw[at : at + int(n) * kind.itemsize].view(kind)
            at += int(n) * kind.itemsize
        return cls(arrays)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for those the automaton doesn't know; all words step together."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return out
        lengths = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        offsets = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        state = np.full(n, len(self.final) - 1, np.int64)
        number = np.zeros(n, np.int64)
        alive = np.flatnonzero((lengths > 0) & (lengths <= LONGEST_WORD))
        for k in range(LONGEST_WORD):
            going = alive[lengths[alive] > k]
            if not len(going):
                break
            key = state[going] * 256 + flat[offsets[going] + k]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[at] == key
            stays, at = going[known], at[known]
            number[stays] += self.skip[at]
            state[stays] = self.target[at]
            done = stays[(lengths[stays] == k + 1)]
            done = done[self.final[state[done]]]
            out[done] = number[done]
            alive = stays
        return out

    def ids_of(self, number: int) -> list[int]:
        return self.ids[self.start[number] : self.start[number + 1]].tolist()


@lru_cache(maxsize=4)
def _mapped(path: str) -> Lexicon:
    return Lexicon.load(path)


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from collections import Counter

    counts: Counter = Counter()
    for pdf in batches:
        for text in pdf["text"]:
            counts.update(w for w in cut(text) if len(w) <= LONGEST_WORD)
        if len(counts) > KEPT:
            yield pd.DataFrame(list(counts.items()), columns=["word", "n"])
            counts = Counter()
    yield pd.DataFrame(list(counts.items()), columns=["word", "n"])


def build_lexicon(texts: DataFrame, path: str, size: int = LEXICON_WORDS) -> Lexicon:
    """The automaton of the `size` most frequent words of the column `text`; size bounds what the driver gets."""
    counted = texts.filter("text IS NOT NULL").select("text").mapInPandas(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "word").limit(size).collect()
    words = {r["word"].encode(): merge(r["word"], path) for r in top if len(r["word"].encode()) <= LONGEST_WORD}
    return Lexicon.build(words)


def _ship(spark: SparkSession, lexicon: Lexicon) -> str:
    """Give the automaton's file to all executors, those that join later included; its name.

    It is written to the shared folder, from which each executor fetches it once.
    """
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{name}")
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = files.create(target)
    try:
        out.write(bytearray(lexicon.to_bytes()))
    finally:
        out.close()
    files.deleteOnExit(target)
    spark.sparkContext.addFile(files.makeQualified(target).toString())
    return name


class _Ids(dict):
    """Ids by word within one task; a part's new words are looked up in the automaton together."""

    def __init__(self, lexicon: Lexicon, path: str) -> None:
        super().__init__()
        self.lexicon, self.path = lexicon, path

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > KEPT:
            self.clear()
            new = list(words)
        for word, number in zip(new, self.lexicon.numbers([w.encode() for w in new])):
            self[word] = self.lexicon.ids_of(number) if number >= 0 else merge(word, self.path)

    def forget(self, words: set[str]) -> None:
        for word in words:
            if len(word) > KEPT_LENGTH:
                del self[word]


def _encoder(name: str, vocabulary: str, keep: list[str]):
    def lists(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[list[int]]]]:
        ids = _Ids(_mapped(SparkFiles.get(name)), SparkFiles.get(vocabulary))
        for pdf in batches:
            for at in range(0, len(pdf), 256):  # so that the lists of one batch stay small
                part = pdf.iloc[at : at + 256]
                words = [cut(t) if t else [] for t in part["text"]]
                distinct = {w for ws in words for w in ws}
                ids.learn(distinct)
                yield part[["id", *keep]].copy(), [[i for w in ws for i in ids[w]] for ws in words]
                ids.forget(distinct)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, found in lists(batches):
            part["ids"] = found
            yield part

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, found in lists(batches):
            part["n_tokens"] = [len(x) for x in found]
            yield part

    return encode, count


def _run(df: DataFrame, id_col: str, text_col: str, keep: list[str], folder: str | None, vocabulary: str, size: int, which: int, result: str) -> DataFrame:
    path = os.path.join(folder or tokenizer_folder(), vocabulary)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"kept_{k}") for k, c in enumerate(keep)])
    # The vocabulary goes from the driver to all executors, so that these need no folder of their own.
    df.sparkSession.sparkContext.addFile(path)
    name = _ship(df.sparkSession, build_lexicon(texts, path, size))
    kept = [f"kept_{k}" for k in range(len(keep))]
    types = ["id long", *[f"{k} {df.schema[c].dataType.simpleString()}" for k, c in zip(kept, keep)], result]
    out = texts.mapInPandas(_encoder(name, os.path.basename(path), kept)[which], ", ".join(types))
    return out.toDF("id", *keep, out.columns[-1])


def encode(df: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = (), folder: str | None = None, vocabulary: str = "byte_bpe_50k.tiktoken", size: int = LEXICON_WORDS) -> DataFrame:
    """id, the kept columns and ids (a list of ints) of every row, without special tokens.

    Null and empty texts give an empty list; what looks like a special token is ordinary text; texts
    are taken whole; repeated rows come out each; an empty table gives an empty result; columns that
    aren't kept are ignored.
    """
    return _run(df, id_col, text_col, list(keep), folder, vocabulary, size, 0, "ids array<int>")


def token_counts(df: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = (), folder: str | None = None, vocabulary: str = "byte_bpe_50k.tiktoken", size: int = LEXICON_WORDS) -> DataFrame:
    """id, the kept columns and n_tokens, the length of the list that encode gives, of every row."""
    return _run(df, id_col, text_col, list(keep), folder, vocabulary, size, 1, "n_tokens long")
