"""Finding and removing markup residue with a recurrent block labeller.

A text is a sequence of leaf blocks: its lines, long ones in several overlapping blocks that
together hold the whole line. Each block becomes one vector: mean and maximum of the hashed
embeddings of its words, of the signs with what stands beside them, of the line's start and of
the tag path it stands in. A small bidirectional LSTM, written in numpy, reads the sequence
forwards and backwards and gives each block a probability for each markup kind and for
each shape (heading, list, code, formula, table), so that a block is judged in the context of
the whole text. A line has the highest probability of its blocks, and the labeller alone
decides; rules only say how the marks of a labelled line are taken out. It is fitted on made-up
documents whose markup is known (``markup_writer``).
"""

from __future__ import annotations

import io
import itertools
import os
import pkgutil
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumdex.llm import markup_rules as rules
from vellumdex.llm.batches import bounded

BUCKETS = 32768
EMBEDDING = 32
HIDDEN = 24
#: A label counts from this probability on.
THRESHOLD = 0.5
MEMO_TOKENS = 200_000
#: Characters of a line that one block holds, and those that it shares with the next one.
BLOCK_CHARS, SHARED_CHARS = 400, 120
WEIGHTS = os.path.join(os.path.dirname(__file__), "markup_lstm.npz")
#: What a token that the fit never met hashes to.
UNKNOWN = 0

# Whether a block holds anything beside words and the stops of prose.
_SIGNED = re.compile(r"[^\w\s.,;:!?()%/\"'\-–—。，、；：！？「」『』（）…’“”«»¿¡]|''|_|--|^\s*(?:-|\d{1,3}[.)]\s)")
_SIGN = re.compile(r"[^\w\s.,;:!?()%/\"\-–—。，、；：！？「」『』（）…’“”«»¿¡]|_|^.?[-\d]|-(?=[-|:])|(?<=[-|:])-")
_RUNS = re.compile(r"([^\W\d_]+)|(\d+)|(\s+)|([^\w\s]|_)\4{3,}")
_NEAR = re.compile(r"(?:</?|\\|&#?|\{\{|\[\[|__|\.)[A-Za-z]{1,16}\d?")


_COARSE = str.maketrans("cx0", "aaa")


def _class(m: re.Match) -> str:
    kind = m.lastindex
    if kind == 1:
        word = m.group()
        return "c" if word[0] >= "\u2e80" else "x" if len(word) == 1 else "a"
    return "0" if kind == 2 else " " if kind == 3 else m.group(4) * 4


class Features:
    """Hashed tokens of blocks; what a token hashes to is kept while the memo has room."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def bucket(self, token: str) -> int:
        found = self.memo.get(token)
        if found is None:
            if len(self.memo) >= MEMO_TOKENS:
                self.memo.clear()
            found = self.memo[token] = 1 + zlib.crc32(token.encode("utf-8", "replace")) % (BUCKETS - 1)
        return found

    def signs(self, text: str, first: bool, last: bool) -> list[int]:
        """Tokens of a block with signs: each sign with the classes of its neighbours, near and, more coarsely, farther, and the words that follow signs."""
        shape = ("\2" if first else "\1") + _RUNS.sub(_class, text) + ("\3" if last else "\1")
        coarse = shape.translate(_COARSE)
        out = []
        bucket = self.bucket
        for m in _SIGN.finditer(shape):
            i = m.end() - 1
            a = max(0, i - 2)
            out += [bucket(shape[max(0, i - 1) : i + 2]), bucket(shape[a : i + 3]), bucket("~" + coarse[a : i + 3]), bucket("~" + coarse[max(0, i - 3) : i + 4])]
        out += [bucket("w" + t.lower()) for t in _NEAR.findall(text)]
        return out

    def blocks(self, lines: list[str], paths: list[str]) -> tuple[list[list[int]], list[int]]:
        """The blocks of all lines, and how many each line has; every character of a line is in one."""
        out, counts = [], []
        bucket = self.bucket
        for line, path in zip(lines, paths):
            line = line.strip("\ufeff\u200b\r")
            bare = line.strip()
            head = _RUNS.sub(_class, bare[:8])[:2]
            head = "w" if head[:1] in "acx" else head
            size = len(bare).bit_length()
            every = [bucket("^" + head), bucket(f"#{size if size < 8 else 8}"), bucket("." + (bare[-1:] if not bare[-1:].isalnum() else "a"))]
            if path:
                every += [bucket("@" + p) for p in path.split(">")]
                every.append(bucket("@@" + path.rpartition(">")[2]))
            if not _SIGNED.search(line):
                out.append(every)
                counts.append(1)
            elif len(line) <= BLOCK_CHARS:
                out.append(every + self.signs(line, True, True))
                counts.append(1)
            else:
                starts = range(0, len(line) - SHARED_CHARS, BLOCK_CHARS - SHARED_CHARS)
                for a in starts:
                    out.append(every + self.signs(line[a : a + BLOCK_CHARS], a == 0, a + BLOCK_CHARS >= len(line)))
                counts.append(len(starts))
        return out, counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class BlockLabeller:
    """The two LSTMs and the output layer; ``parameters`` holds float32 arrays by name."""

    def __init__(self, parameters: dict[str, np.ndarray]):
        self.p = parameters

    @classmethod
    def fresh(cls, seed: int = 1) -> BlockLabeller:
        r = np.random.default_rng(seed)
        p = {"E": r.normal(0, 0.3, (BUCKETS, EMBEDDING))}
        for d in "fb":
            p[f"W{d}"] = r.normal(0, 0.2, (2 * EMBEDDING + HIDDEN, 4 * HIDDEN))
            p[f"b{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        p["V"] = r.normal(0, 0.2, (2 * HIDDEN + 2 * EMBEDDING, len(rules.LABELS)))
        p["c"] = np.full(len(rules.LABELS), -2.0)
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    @classmethod
    def load(cls) -> BlockLabeller:
        """The fitted labeller that lies beside this module, also where the package is a zip file."""
        with np.load(io.BytesIO(pkgutil.get_data(__package__, os.path.basename(WEIGHTS)))) as stored:
            return cls({k: stored[k].astype(np.float32) for k in stored.files})

    def save(self, path: str = WEIGHTS) -> None:
        np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in self.p.items()})

    def embed(self, blocks: list[list[int]]) -> np.ndarray:
        """Mean and maximum of each block's embeddings: a single sign among many words still shows in the maximum."""
        size = np.fromiter(map(len, blocks), np.int64, len(blocks))
        flat = np.fromiter(itertools.chain.from_iterable(blocks), np.int64, int(size.sum()))
        start = np.cumsum(size) - size
        e = self.p["E"][flat]
        return np.concatenate([np.add.reduceat(e, start, axis=0) / size[:, None].astype(e.dtype), np.maximum.reduceat(e, start, axis=0)], axis=1)

    def run(self, x: np.ndarray, lengths: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """Hidden states in the order of ``x``, whose sequences follow one another.

        Sequences are handled together, the longest first, so that those still running
        are always a leading slice.
        """
        w, b = self.p[f"W{way}"], self.p[f"b{way}"]
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        h = np.zeros((len(lengths), HIDDEN), np.float32)
        c = np.zeros_like(h)
        out = np.zeros((len(x), HIDDEN), np.float32)
        pre = x @ w[: 2 * EMBEDDING] + b
        recurrent = w[2 * EMBEDDING :]
        sorted_lengths, sorted_starts = lengths[order], starts[order]
        running = len(order)
        for t in range(int(lengths.max(initial=0))):
            while sorted_lengths[running - 1] <= t:
                running -= 1
            at = sorted_starts[:running] + (t if way == "f" else sorted_lengths[:running] - 1 - t)
            gates = pre[at] + h[:running] @ recurrent
            act = _sigmoid(gates[:, : 3 * HIDDEN])
            new = np.tanh(gates[:, 3 * HIDDEN :])
            i, f, o = act[:, :HIDDEN], act[:, HIDDEN : 2 * HIDDEN], act[:, 2 * HIDDEN :]
            before_h, before_c = h[:running].copy() if keep is not None else None, c[:running].copy() if keep is not None else None
            c[:running] = f * c[:running] + i * new
            squashed = np.tanh(c[:running])
            h[:running] = o * squashed
            out[at] = h[:running]
            if keep is not None:
                keep.append((at, i, f, o, new, squashed, before_h, before_c))
        return out

    def probabilities(self, blocks: list[list[int]], lengths: np.ndarray) -> np.ndarray:
        """One row per block, one column per label."""
        if not blocks:
            return np.zeros((0, len(rules.LABELS)), np.float32)
        x = self.embed(blocks)
        state = np.concatenate([self.run(x, lengths, "f"), self.run(x, lengths, "b"), x], axis=1)
        return _sigmoid(state @ self.p["V"] + self.p["c"])

    def line_probabilities(self, texts: list[tuple[list[list[int]], list[int]]]) -> np.ndarray:
        """One row per line of all texts, given as ``Features.blocks`` returns them: the highest of its blocks."""
        prob = self.probabilities([b for blocks, _ in texts for b in blocks], np.array([len(blocks) for blocks, _ in texts], np.int64))
        size = np.array([n for _, counts in texts for n in counts], np.int64)
        return np.maximum.reduceat(prob, np.cumsum(size) - size, axis=0) if len(size) else prob

    def gradients(self, blocks: list[list[int]], lengths: np.ndarray, truth: np.ndarray, counts: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Cross entropy of all labels, mean over the lines, and its gradients by backpropagation through time.

        ``counts`` has the number of blocks of each line (one by default). A line's probability is the
        highest of its blocks, so that only the block which shows a label learns it.
        """
        x = self.embed(blocks)
        kept: dict[str, list] = {"f": [], "b": []}
        states = {d: self.run(x, lengths, d, kept[d]) for d in "fb"}
        joined = np.concatenate([states["f"], states["b"], x], axis=1)
        prob = _sigmoid(joined @ self.p["V"] + self.p["c"])
        counts = np.ones(len(x), np.int64) if counts is None else counts
        first = np.cumsum(counts) - counts
        line = np.maximum.reduceat(prob, first, axis=0)
        n = len(line)
        loss = -np.sum(truth * np.log(line + 1e-7) + (1 - truth) * np.log(1 - line + 1e-7)) / n
        delta = (np.repeat(line - truth, counts, axis=0) * (prob == np.repeat(line, counts, axis=0))).astype(x.dtype) / n
        grads = {"V": joined.T @ delta, "c": delta.sum(axis=0)}
        back = delta @ self.p["V"].T
        width = 2 * EMBEDDING
        dx = back[:, 2 * HIDDEN :].copy()
        for k, d in enumerate("fb"):
            dh_out = back[:, k * HIDDEN : (k + 1) * HIDDEN]
            w = self.p[f"W{d}"]
            gw, gb = np.zeros_like(w), np.zeros_like(self.p[f"b{d}"])
            dh = np.zeros((len(lengths), HIDDEN), x.dtype)
            dc = np.zeros_like(dh)
            for at, i, f, o, new, squashed, before_h, before_c in reversed(kept[d]):
                m = len(at)
                down = dh_out[at] + dh[:m]
                dcell = down * o * (1 - squashed**2) + dc[:m]
                gate = np.concatenate([dcell * new * i * (1 - i), dcell * before_c * f * (1 - f), down * squashed * o * (1 - o), dcell * i * (1 - new**2)], axis=1)
                gw[:width] += x[at].T @ gate
                gw[width:] += before_h.T @ gate
                gb += gate.sum(axis=0)
                dx[at] += gate @ w[:width].T
                dh[:m] = gate @ w[width:].T
                dc[:m] = dcell * f
            grads[f"W{d}"], grads[f"b{d}"] = gw, gb
        size = np.fromiter(map(len, blocks), np.int64, len(blocks))
        flat = np.fromiter(itertools.chain.from_iterable(blocks), np.int64, int(size.sum()))
        e = self.p["E"][flat]
        top = np.repeat(x[:, EMBEDDING:], size, axis=0) == e
        per = np.repeat(dx[:, :EMBEDDING] / size[:, None], size, axis=0) + np.repeat(dx[:, EMBEDDING:], size, axis=0) * top
        ge = np.zeros_like(self.p["E"])
        order = np.argsort(flat, kind="stable")
        starts = np.flatnonzero(np.diff(flat[order], prepend=-1))
        ge[flat[order][starts]] = np.add.reduceat(per[order], starts, axis=0)
        grads["E"] = ge
        return float(loss), grads


def train(texts: Iterable[list[str]], truth: Iterable[np.ndarray], epochs: int = 6, batch: int = 48, rate: float = 0.01, seed: int = 1, unknown: float = 0.03) -> BlockLabeller:
    """Fits the labeller by Adam on sequences of lines and their 0/1 label matrices.

    In each step a part ``unknown`` of the tokens is taken for unknown, so that a token which the fit
    never meets has a meaning too: all buckets without a token get the embedding of the unknown one.
    """
    features = Features()
    data = []
    for lines, labels in zip(texts, truth):
        if lines:
            data.append((*features.blocks(lines, rules.tag_paths(lines)), labels.astype(np.float32)))
    met = np.zeros(BUCKETS, bool)
    for blocks, _, _ in data:
        for b in blocks:
            met[b] = True
    model = BlockLabeller.fresh(seed)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    r, step = np.random.default_rng(seed), 0
    total = epochs * max(1, len(data) // batch)
    for _ in range(epochs):
        for part in np.array_split(r.permutation(len(data)), max(1, len(data) // batch)):
            chosen = [data[i] for i in part]
            lengths = np.array([len(b) for b, _, _ in chosen], np.int64)
            blocks = [[UNKNOWN if z < unknown else t for t, z in zip(x, r.random(len(x)).tolist())] for b, _, _ in chosen for x in b]
            _, grads = model.gradients(blocks, lengths, np.concatenate([y for _, _, y in chosen]), np.array([c for _, n, _ in chosen for c in n], np.int64))
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            step += 1
            speed = rate * (1 - step / (total + 1)) ** 1.5
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.p[k] = (model.p[k] - speed * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    model.p["E"][~met] = model.p["E"][UNKNOWN]
    return model


_labeller: list = []


def worker_labeller() -> tuple[BlockLabeller, Features]:
    """The labeller of this Python worker, loaded at its first use."""
    if not _labeller:
        _labeller.append((BlockLabeller.load(), Features()))
    return _labeller[0]


def label_blocks(texts: list[str], model: BlockLabeller, features: Features, threshold: float = THRESHOLD) -> list[tuple[list[str], list[set[str]], np.ndarray]]:
    """Lines, labels and probabilities of each text; every block of every text goes through the labeller."""
    lines = [text.split("\n") for text in texts]
    prob = model.line_probabilities([features.blocks(own, rules.tag_paths(own)) for own in lines])
    names = rules.LABELS
    labels: list[set[str]] = [set() for _ in range(len(prob))]
    for i, j in zip(*(x.tolist() for x in np.nonzero(prob >= threshold))):
        labels[i].add(names[j])
    out, at = [], 0
    for own in lines:
        out.append((own, labels[at : at + len(own)], prob[at : at + len(own)]))
        at += len(own)
    return out


def clean_text(lines: list[str], labels: list[set[str]]) -> str:
    """The text without marks: headings, list items, code, formulas and table rows keep their own lines."""
    kept = []
    open_tag = False
    for line, own in zip(lines, labels):
        if open_tag:  # the rest of an element's tag that began on an earlier line
            open_tag, line = ">" not in line and bool(line.strip()), line.partition(">")[2]
        elif rules.HTML in own and (m := rules.OPEN_TAG.search(line)):
            open_tag, line = True, line[: m.start()]
            if not line.strip():
                continue
        text = rules.clean_line(line, own) if own else line
        if text.strip() or not line.strip():
            kept.append(text.rstrip() if own else text)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip("\n")


def find_markup(chunks: DataFrame, key: str = "id", fields: tuple[str, str] = ("text", "search_text")) -> DataFrame:
    """``key, kinds``: the kinds of markup in each row's two fields, sorted; empty if there is none.

    Where one field holds the other at its end, the longer one is read once for both. Null,
    empty and blank fields have no markup. Rows are handled one by one: repeated rows and
    keys give repeated results.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, features = worker_labeller()
        for batch in bounded(batches, 1):
            texts, owner = [], []
            for i, (text, search) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                parts = (search,) if text and search and search.endswith(text) else (text, search)
                for part in parts:
                    if part:
                        texts.append(part)
                        owner.append(i)
            kinds: list[set[str]] = [set() for _ in range(batch.num_rows)]
            for i, (_, labels, _) in zip(owner, label_blocks(texts, model, features)):
                kinds[i] |= rules.kinds_of(labels)
            yield pa.record_batch([batch.column(0), pa.array([sorted(k) for k in kinds], pa.list_(pa.string()))], ["key", "kinds"])

    kind = chunks.schema[key].dataType.simpleString()
    chosen = chunks.select(F.col(key).alias("key"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)])
    return chosen.mapInArrow(find, f"key {kind}, kinds array<string>").withColumnRenamed("key", key)


BLOCK_TYPE = "array<struct<shape:string,text:string>>"


def clean_markup(chunks: DataFrame, key: str = "id", fields: tuple[str, ...] = ("text", "search_text")) -> DataFrame:
    """``key``, each field cleaned, and ``blocks``: shape and clean text of each line of the first field that has one.

    Shapes are ``heading``, ``list``, ``code``, ``formula``, ``table``. Null fields stay
    null and empty ones empty; texts without markup come out unchanged except for blank
    lines at their ends. Repeated rows stay repeated.
    """
    n = len(fields)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, features = worker_labeller()
        for batch in bounded(batches, 1):
            columns, blocks = [], []
            for j in range(n):
                values = batch.column(j + 1).to_pylist()
                labelled = iter(label_blocks([v for v in values if v], model, features))
                cleaned = []
                for v in values:
                    if not v:
                        cleaned.append(v)
                        if j == 0:
                            blocks.append([])
                        continue
                    lines, labels, _ = next(labelled)
                    cleaned.append(clean_text(lines, labels))
                    if j == 0:
                        shaped = [(next((s for s in rules.SHAPES if s in own), None), rules.clean_line(line, own).strip()) for line, own in zip(lines, labels)]
                        blocks.append([{"shape": s, "text": t} for s, t in shaped if s and t])
                columns.append(pa.array(cleaned, pa.string()))
            shape = pa.list_(pa.struct([("shape", pa.string()), ("text", pa.string())]))
            yield pa.record_batch([batch.column(0), *columns, pa.array(blocks, shape)], ["key", *[f"f{j}" for j in range(n)], "blocks"])

    kind = chunks.schema[key].dataType.simpleString()
    chosen = chunks.select(F.col(key).alias("key"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)])
    out = chosen.mapInArrow(clean, f"key {kind}, " + ", ".join(f"f{j} string" for j in range(n)) + f", blocks {BLOCK_TYPE}")
    return out.withColumnsRenamed({"key": key} | {f"f{j}": f for j, f in enumerate(fields)})
