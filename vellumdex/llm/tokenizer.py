"""Encoding a corpus with a public byte-level BPE vocabulary through a word lexicon.

The words that a corpus uses most are compiled, with their ids, into a minimal acyclic
transducer. It is written once to the shared folder, served by Spark to every executor
and memory-mapped by the Python workers, so that all workers of a machine share one copy.
A word that is not in it is merged exactly, by the ranks of the vocabulary. The ids are
the same whether a word is in the lexicon or not; the lexicon only saves merging.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumdex.llm.batches import bounded
from vellumdex.session import publish_bytes, written

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

# Fixed value: how the public vocabulary splits text before merging.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words compiled into the lexicon, and the longest that may enter it in bytes.
LEXICON_WORDS = 50_000
LEXICON_WORD_BYTES = 48
#: Entries a worker keeps of merged pieces and of a partition's word counts before it starts anew.
MEMO_ENTRIES = 200_000


@functools.lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}


class Merger:
    """Byte-pair merging of single words, exact for any bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.memo: dict[bytes, tuple[int, ...]] = {}
        # joinable[x, y]: some token holds byte x followed by y. Where no token does, no
        # merge can ever cross, so that a word may be cut there without changing its ids.
        self.joinable = np.zeros((256, 256), bool)
        for token in ranks:
            raw = np.frombuffer(token, np.uint8)
            self.joinable[raw[:-1], raw[1:]] = True

    def pieces(self, word: bytes) -> list[bytes]:
        raw = np.frombuffer(word, np.uint8)
        cuts = np.flatnonzero(~self.joinable[raw[:-1], raw[1:]]) + 1
        bounds = [0, *cuts.tolist(), len(word)]
        return [word[a:b] for a, b in zip(bounds, bounds[1:])]

    def encode(self, word: bytes) -> tuple[int, ...]:
        if (rank := self.ranks.get(word)) is not None:
            return (rank,)
        found: list[int] = []
        for piece in self.pieces(word):
            ids = self.memo.get(piece)
            if ids is None:
                ids = self.merge(piece)
                if len(self.memo) >= MEMO_ENTRIES:
                    self.memo.clear()
                if len(piece) <= 256:
                    self.memo[piece] = ids
            found += ids
        return tuple(found)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Repeatedly joins the adjacent pair of lowest rank, the leftmost first.

        A heap of candidate pairs over a linked list keeps a very long piece at
        n log n steps.
        """
        import heapq

        ranks = self.ranks
        if (rank := ranks.get(piece)) is not None:
            return (rank,)
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap = []
        for i in range(len(parts) - 1):
            if (rank := ranks.get(parts[i] + parts[i + 1])) is not None:
                heap.append((rank, i, parts[i], parts[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] is not left or j >= len(parts) or parts[j] is not right:
                continue
            parts[i] = left + right
            parts[j] = None
            after[i] = k = after[j]
            if k < len(parts):
                before[k] = i
                if (rank := ranks.get(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (rank, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (rank := ranks.get(parts[h] + parts[i])) is not None:
                heapq.heappush(heap, (rank, h, parts[h], parts[i]))
        return tuple(ranks[p] for p in parts if p is not None)


class Lexicon:
    """A minimal acyclic transducer from words to their ids, read from a mapped file.

    Each edge carries a number; the sum along a word's path is the word's place among all
    words in byte order, which leads to its ids. Shared suffixes are stored once.
    """

    FIELDS = ("keys", "target", "output", "final", "offset", "ids")
    TYPES = ("<i8", "<i4", "<i4", "<i1", "<i4", "<i4")

    def __init__(self, arrays: list[np.ndarray]):
        self.keys, self.target, self.output, self.final, self.offset, self.ids = arrays

    @classmethod
    def compile(cls, entries: dict[bytes, tuple[int, ...]]) -> bytes:
        """The file's content for a dictionary of words to ids."""
        register: dict[tuple, int] = {}
        edges: list[tuple[tuple[int, int], ...]] = []
        finals: list[bool] = []

        def settle(node: list) -> int:
            shape = (node[0], tuple(node[1]))
            if (known := register.get(shape)) is None:
                known = register[shape] = len(edges)
                edges.append(shape[1])
                finals.append(shape[0])
            return known

        words = sorted(entries)
        path: list[list] = [[False, []]]  # unfinished nodes along the last word
        last = b""
        for word in words:
            common = len(os.path.commonprefix([last, word]))
            while len(path) > common + 1:
                state = settle(path.pop())
                path[-1][1].append((last[len(path) - 1], state))
            path += [[False, []] for _ in range(len(word) - common)]
            path[-1][0] = True
            last = word
        while len(path) > 1:
            state = settle(path.pop())
            path[-1][1].append((last[len(path) - 1], state))
        root = settle(path.pop())

        size = [0] * len(edges)  # words below a state; targets settle before their sources
        keys, target, output = [], [], []
        for state, out in enumerate(edges):
            below = int(finals[state])
            for byte, to in out:
                keys.append(state << 8 | byte)
                target.append(to)
                output.append(below)
                below += size[to]
            size[state] = below
        ids = [entries[w] for w in words]
        arrays = [keys, target, output, finals, np.cumsum([0, *map(len, ids)]), [i for word in ids for i in word]]
        blocks = [np.asarray(a).astype(t).tobytes() for a, t in zip(arrays, cls.TYPES)]
        head = np.array([root, *[len(a) for a in arrays]], "<i8").tobytes()
        return head + b"".join(b + b"\0" * (-len(b) % 8) for b in blocks)

    @classmethod
    def open(cls, path: str) -> Lexicon:
        raw = np.memmap(path, np.uint8, "r")
        head = np.frombuffer(raw[:56], "<i8")
        arrays, at = [], 56
        for n, t in zip(head[1:], cls.TYPES):
            width = int(n) * np.dtype(t).itemsize
            arrays.append(raw[at : at + width].view(t))
            at += width + (-width % 8)
        lexicon = cls(arrays)
        lexicon.root = int(head[0])
        return lexicon

    def find(self, words: list[bytes]) -> np.ndarray:
        """The place of each word among the lexicon's words, -1 for one that is not there.

        All words step through the automaton together, one byte at a time.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths) - lengths
        text = np.frombuffer(b"".join(words), np.uint8)
        state = np.full(len(words), self.root, np.int64)
        place = np.zeros(len(words), np.int64)
        place[(lengths == 0) | (lengths > LEXICON_WORD_BYTES)] = -1
        live = np.flatnonzero(place == 0)
        step = 0
        while len(live) and len(self.keys):
            key = state[live] << 8 | text[starts[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            place[live[~hit]] = -1
            live, at = live[hit], at[hit]
            place[live] += self.output[at]
            state[live] = self.target[at]
            step += 1
            done = lengths[live] == step
            ended = live[done]
            place[ended[self.final[state[ended]] == 0]] = -1
            live = live[~done]
        if not len(self.keys):
            place[:] = -1
        return place


class Encoder:
    """Encodes batches of texts: split, look up each distinct word once, gather ids."""

    def __init__(self, vocabulary: str, lexicon: Lexicon | None):
        self.split = regex.compile(SPLIT_PATTERN).findall
        self.merger = Merger(load_ranks(vocabulary))
        self.lexicon = lexicon

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each text."""
        index: dict[str, int] = {}
        codes: list[int] = []
        counts = []
        for text in texts:
            before = len(codes)
            if text:
                codes += [index.setdefault(w, len(index)) for w in self.split(text)]
            counts.append(len(codes) - before)
        words = [w.encode("utf-8", "replace") for w in index]
        lengths, starts, pool = self._ids_of(words)
        code = np.asarray(codes, np.int64)
        size = lengths[code]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = pool[np.repeat(starts[code] - (ends - size), size) + np.arange(total)] if total else np.zeros(0, np.int32)
        bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        return ids, np.diff(np.concatenate([[0], ends])[bounds])

    def _ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: number of ids and where they start in the pool, and the pool."""
        found = self.lexicon.find(words) if self.lexicon is not None else np.full(len(words), -1)
        known = found >= 0
        lengths, starts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        pool = np.zeros(0, np.int32)
        if known.any():
            offset = self.lexicon.offset
            starts[known] = offset[found[known]]
            lengths[known] = offset[found[known] + 1] - offset[found[known]]
            pool = np.asarray(self.lexicon.ids)
        merged = [self.merger.encode(words[i]) for i in np.flatnonzero(~known)]
        lengths[~known] = [len(m) for m in merged]
        starts[~known] = len(pool) + np.cumsum([0, *map(len, merged)])[:-1]
        return lengths, starts, np.concatenate([pool, np.array([i for m in merged for i in m], np.int32)])


_encoders: dict[tuple, Encoder] = {}


def worker_encoder(vocabulary: str, lexicon_file: str | None) -> Encoder:
    """The encoder of this Python worker, made at its first use."""
    if (vocabulary, lexicon_file) not in _encoders:
        _encoders.clear()
        lexicon = Lexicon.open(SparkFiles.get(lexicon_file)) if lexicon_file else None
        _encoders[vocabulary, lexicon_file] = Encoder(vocabulary, lexicon)
    return _encoders[vocabulary, lexicon_file]


def count_words(documents: DataFrame, text: str = "text") -> DataFrame:
    """How often each pre-split word occurs in all texts: ``word, n``.

    Each task adds up its own words before anything is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        split, total = regex.compile(SPLIT_PATTERN).findall, Counter()

        def flush() -> pa.RecordBatch:
            rows = [(w, n) for w, n in total.items() if len(w) <= LEXICON_WORD_BYTES]
            total.clear()
            return pa.record_batch([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["word", "n"])

        for batch in batches:
            for value in batch.column(0).to_pylist():
                if value:
                    total.update(split(value))
                if len(total) >= MEMO_ENTRIES:
                    yield flush()
        yield flush()

    partial = documents.select(F.col(text).alias("text")).where("text is not null and text != ''").mapInArrow(count, "word string, n bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(documents: DataFrame, text: str = "text", words: int = LEXICON_WORDS, vocabulary: str | None = None) -> str:
    """Compiles the most frequent words of all texts and publishes the file; its name.

    Every text is counted, so that the words and the count from which they enter are those of the whole corpus.
    Words are binned by the logarithm of their count, and as many of the upper bins enter as
    hold no more than ``words`` together. Only these come to the driver.
    """
    merger = Merger(load_ranks(vocabulary or default_vocabulary()))
    counts = written(count_words(documents, text).withColumn("bin", F.floor(F.log2("n") * 16).cast("int")))
    first, left = None, words
    for r in sorted(counts.groupBy("bin").count().collect(), reverse=True):
        if r["count"] > left:
            break
        first, left = r["bin"], left - r["count"]
    top = counts.where(F.col("bin") >= first).select("word").collect() if first is not None else []
    entries = {w: merger.encode(w) for r in top if len(w := r["word"].encode("utf-8", "replace")) <= LEXICON_WORD_BYTES}
    data = Lexicon.compile(entries)
    return publish_bytes(documents.sparkSession, data, f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}.bin")


def default_vocabulary() -> str:
    return os.path.join(TOKENIZER_DIR, VOCABULARY)


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, words: int = LEXICON_WORDS, lexicon_file: str | None = None) -> DataFrame:
    """``key, ids``: the ids of every text, without special tokens.

    A null or empty text has an empty list; a null key is kept; repeated rows stay
    repeated; other columns are ignored. Strings that look like special tokens are
    ordinary text. ``vocabulary`` is a rank file that every worker can read.
    """
    vocabulary = vocabulary or default_vocabulary()
    file = lexicon_file or build_lexicon(documents, text, words, vocabulary)
    kind = documents.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary, file)
        for batch in bounded(batches, 1):
            ids, counts = encoder.encode(batch.column(1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
            yield pa.record_batch([batch.column(0), lists], ["key", "ids"])

    return documents.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(encode, f"key {kind}, ids array<int>").select(F.col("key").alias(key), "ids")


def token_counts(documents: DataFrame, columns: list[str], text: str = "text", vocabulary: str | None = None, words: int = LEXICON_WORDS, lexicon_file: str | None = None) -> DataFrame:
    """``columns`` and ``n_tokens``, the number of ids of each text (0 for null or empty)."""
    vocabulary = vocabulary or default_vocabulary()
    file = lexicon_file or build_lexicon(documents, text, words, vocabulary)
    kinds = [f"c{i} {documents.schema[c].dataType.simpleString()}" for i, c in enumerate(columns)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary, file)
        for batch in bounded(batches, len(columns)):
            _, counts = encoder.encode(batch.column(len(columns)).to_pylist())
            kept = [batch.column(i) for i in range(len(columns))]
            yield pa.record_batch([*kept, pa.array(counts, pa.int64())], [*[f"c{i}" for i in range(len(columns))], "n_tokens"])

    chosen = documents.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], F.col(text).alias("text"))
    out = chosen.mapInArrow(count, ", ".join([*kinds, "n_tokens bigint"]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], "n_tokens")
