"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

A first pass counts the words of all documents; the frequent ones are encoded once and compiled
into a minimal acyclic transducer (`lexicon`), whose file every worker maps into memory. The second
pass splits each text, walks the transducer for the words it knows and merges all others exactly.
The lexicon only saves work: a word outside of it gets the same ids from its merges.
"""

from __future__ import annotations

import base64
import functools
import heapq
import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.lexicon import Lexicon, compile_lexicon
from quern.plans.scratch import scratch_path

#: Folder of the public vocabulary files.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: how the vocabulary's texts are split into words before merging.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same with white space as Unicode has it, for Java; used for counting only.
_JAVA_PATTERN = "(?U)" + WORD_PATTERN

#: A word is frequent from this many occurrences on; the lexicon holds at most LEXICON_WORDS of them.
LEXICON_LEAST = 8
LEXICON_WORDS = 100_000
#: Longer words are not worth a place in the lexicon (they are merged exactly like any unseen word).
LEXICON_LENGTH = 48
#: Words remembered per worker process.
_MEMO = 1 << 17


def load_ranks(path: str) -> dict[bytes, int]:
    """Byte pieces with their ids, which are also their merge ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the adjacent pair of lowest rank is merged until none is left, leftmost first among equals.

    A heap over a linked list of pieces: n log n in the length, so a word of a megabyte is no trap.
    """
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    end = list(range(1, n + 1))  # piece at i is word[i:end[i]]; 0 where merged away
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        r = ranks.get(word[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if j == 0 or j >= n or end[j] != stop:
            continue  # one of the two pieces has changed since
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            r = ranks.get(word[i : end[stop]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        p = before[i]
        if p >= 0:
            r = ranks.get(word[p:stop])
            if r is not None:
                heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Splits texts and looks words up: memo, then lexicon, then exact merges."""

    def __init__(self, ranks_path: str, lexicon_path: str | None) -> None:
        import regex

        self._ranks_path = ranks_path
        self._split = regex.compile(WORD_PATTERN).findall
        self._lexicon = Lexicon(lexicon_path) if lexicon_path else None
        self._memo: dict[str, list[int]] = {}

    @functools.cached_property
    def _ranks(self) -> dict[bytes, int]:
        return load_ranks(self._ranks_path)

    def word(self, w: str) -> list[int]:
        # a lone surrogate cannot be UTF-8; it reads as the replacement character
        b = w.encode("utf-8", "replace")
        ids = self._lexicon.get(b) if self._lexicon else None
        if ids is None:
            ids = merge_word(b, self._ranks)
        if len(self._memo) < _MEMO and len(w) <= LEXICON_LENGTH:
            self._memo[w] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; an empty list for an empty or null text."""
        if not text:
            return []
        memo, out = self._memo, []
        for w in self._split(text):
            ids = memo.get(w)
            out += self.word(w) if ids is None else ids
        return out


@functools.lru_cache(maxsize=2)
def _encoder(ranks_file: str, lexicon_file: str | None) -> Encoder:
    """One encoder per worker process and vocabulary; both files were handed to every executor."""
    return Encoder(SparkFiles.get(ranks_file), SparkFiles.get(lexicon_file) if lexicon_file else None)


def frequent_words(documents: DataFrame, text: str = "text", least: int = LEXICON_LEAST, most: int = LEXICON_WORDS) -> DataFrame:
    """(word, n): the words of all documents seen at least `least` times, the `most` frequent of them."""
    words = documents.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(_JAVA_PATTERN), F.lit(0))).alias("word")).where(F.length("word") <= LEXICON_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most)


def build_lexicon(spark: SparkSession, documents: DataFrame, ranks_path: str, text: str = "text") -> str:
    """Compile the frequent words and hand the file to every executor; returns its name for SparkFiles.

    What reaches the driver is bounded: at most LEXICON_WORDS words of at most LEXICON_LENGTH characters.
    """
    ranks = load_ranks(ranks_path)
    words = [r["word"].encode("utf-8", "replace") for r in frequent_words(documents, text).collect()]
    blob = compile_lexicon((w, tuple(merge_word(w, ranks))) for w in set(words))
    target = scratch_path(spark, "lexicon") + ".bin"
    # written through Spark's file system layer, so the shared folder may be of any kind
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(blob))
    out.close()
    spark.sparkContext.addFile(target)
    return os.path.basename(target)


def encode_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS, lengths: bool = False, keep: Sequence[Column] = ()) -> DataFrame:
    """`key` and `ids` (array of int) of every row, or `key` and `n_tokens` with `lengths`.

    `keep`: further columns (expressions on `documents`) that come along. No special tokens; their strings in a text are ordinary text. A null or empty text gives an
    empty list. Repeated rows are encoded each; other columns are not read. The result equals the
    vocabulary's own merges whatever the lexicon holds.
    """
    spark = documents.sparkSession
    ranks_path = f"{folder}/{vocabulary}.tiktoken"
    lexicon = build_lexicon(spark, documents, ranks_path, text)
    # only the driver needs the vocabulary's folder
    spark.sparkContext.addFile(ranks_path)
    ranks_file = os.path.basename(ranks_path)
    told = "n_tokens" if lengths else "ids"
    read = documents.select(key, *keep, F.col(text).alias("__text"))
    names = [*read.columns[:-1], told]
    result = T.StructType([*read.schema.fields[:-1], T.StructField(told, T.IntegerType() if lengths else T.ArrayType(T.IntegerType()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(ranks_file, lexicon)
        for b in batches:
            *kept, texts = b.columns
            ids = [enc.encode(t) for t in texts.to_pylist()]
            col = pa.array([len(x) for x in ids], pa.int32()) if lengths else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*kept, col], names)

    return read.mapInArrow(encode, result)
