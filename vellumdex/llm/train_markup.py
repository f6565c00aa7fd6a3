"""Fits the block labeller: ``python -m vellumdex.llm.train_markup CHUNKS.parquet``.

Of the chunks only sentences without any sign are taken (at most ``--sentences``, in the order of
a hash); all markup around them is made up by ``markup_writer``, so that its kind is known. One
part of the sentences and documents made with another seed are held out; recall and precision on
them are printed, and how often the labeller and plain sign rules name the same kinds in the chunks themselves.
"""

from __future__ import annotations

import argparse
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from vellumdex.llm import markup, markup_rules, markup_signs
from vellumdex.llm.markup_writer import Writer, plain_sentences


def matrix(labels: list) -> np.ndarray:
    return np.array([[name in own for name in markup_rules.LABELS] for own in labels], np.float32)


def scores(model: markup.BlockLabeller, documents: list, threshold: float = markup.THRESHOLD) -> dict[str, tuple[float, float]]:
    """Recall and precision: of each label over lines, and of each kind over documents (``kind*``)."""
    features = markup.Features()
    lines = [d for d, _ in documents]
    named = model.line_probabilities([features.blocks(x, markup_rules.tag_paths(x)) for x in lines]) >= threshold
    right = np.concatenate([matrix(y) for _, y in documents]) > 0
    out = {}
    starts = np.cumsum([0, *map(len, lines)])[:-1]
    for j, name in enumerate(markup_rules.LABELS):
        for suffix, a, b in (("", named[:, j], right[:, j]), ("*", np.logical_or.reduceat(named[:, j], starts), np.logical_or.reduceat(right[:, j], starts))):
            if suffix and name not in markup_rules.KINDS:
                continue
            hit = (a & b).sum()
            out[name + suffix] = (hit / max(1, b.sum()), hit / max(1, a.sum()))
    return out


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("chunks")
    parser.add_argument("--sentences", type=int, default=20_000)
    parser.add_argument("--documents", type=int, default=16_000)
    parser.add_argument("--epochs", type=int, default=8)
    args = parser.parse_args()
    rows = pq.read_table(args.chunks, columns=["text", "search_text", "chunk_type"]).to_pylist()
    texts = sorted({r["text"] for r in rows if r["chunk_type"] == "text" and r["text"]}, key=lambda t: (zlib.crc32(t.encode()), t))
    pool = plain_sentences(texts, args.sentences)
    held = [s for s in pool if zlib.crc32(s.encode()) % 5 == 0]
    fitted = [s for s in pool if zlib.crc32(s.encode()) % 5]
    documents = Writer(fitted, 5).corpus(args.documents)
    model = markup.train([d for d, _ in documents], [matrix(y) for _, y in documents], args.epochs)
    model.save()
    model = markup.BlockLabeller.load()
    for name, (recall, precision) in scores(model, Writer(held, 77).corpus(max(1000, args.documents // 4))).items():
        print(f"{name}: recall {recall:.4f}, precision {precision:.4f}")
    missed(model, Writer(held, 78).corpus(2000))
    agree(model, rows)


def missed(model: markup.BlockLabeller, documents: list, shown: int = 25) -> None:
    """Prints some held-out lines whose kinds the labeller got wrong."""
    features = markup.Features()
    for lines, right in documents:
        ((_, labels, _),) = markup.label_blocks(["\n".join(lines)], model, features)
        for line, a, b in zip(lines, labels, right):
            if shown and (wrong := (a ^ b) & set(markup_rules.KINDS)):
                shown -= 1
                print("wrong", sorted(wrong), "written in", sorted(b), repr(line[:160]))


def agree(model: markup.BlockLabeller, rows: list[dict], shown: int = 6) -> None:
    """Prints in how many prose chunks labeller and sign rules name the same kinds, and some where not."""
    features = markup.Features()
    texts = sorted({t for r in rows if r["chunk_type"] == "text" for t in (r["text"], r["search_text"]) if t})
    both = only_rules = only_model = 0
    seen: Counter = Counter()
    for i in range(0, len(texts), 500):
        part = texts[i : i + 500]
        for text, (lines, labels, prob) in zip(part, markup.label_blocks(part, model, features)):
            signs = markup_signs.line_signs(lines)
            a, b = markup_rules.kinds_of(labels), markup_rules.kinds_of(signs)
            both, only_rules, only_model = both + len(a & b), only_rules + len(b - a), only_model + len(a - b)
            for kind in a ^ b:
                seen[kind in a, kind] += 1
                if seen[kind in a, kind] <= shown:
                    j = markup_rules.LABELS.index(kind)
                    k = int(prob[:, j].argmax()) if kind in a else next(n for n, s in enumerate(signs) if kind in s)
                    print(("labeller only" if kind in a else "rules only"), kind, round(float(prob[k, j]), 3), repr(lines[k][:160]))
    print(f"kinds of texts named by both {both}, by the rules only {only_rules}, by the labeller only {only_model}")


if __name__ == "__main__":
    main()
