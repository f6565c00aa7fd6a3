"""Languages of documents and of the passages of mixed documents, by rank-order profiles.

A profile lists the most frequent character n-grams of a language by rank. A text's own
n-grams are ranked the same way; the out-of-place distance adds up how far each of them
lies from its place in the profile, and the nearest profile names the language. The
confidence is how much nearer it is than the next one. N-grams are taken inside words
(with their borders); Chinese and Japanese characters are words of their own.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumdex.llm.batches import bounded

#: Most n-grams of a profile, and the lengths of n-grams.
PROFILE_SIZE = 3000
SHORTEST, LONGEST = 2, 4
#: The fit reads this many labelled documents of each language at most, each of them whole.
FIT_DOCUMENTS = 300
#: What a sentence in another language than its document needs: how much nearer it lies on average, as a part
#: of the profiles' length, and words.
FOREIGN_MARGIN = 0.03
LEAST_WORDS = 3
#: Bytes of text that are ranked together; the sorted arrays then fit into a core's cache.
RANKED_BYTES = 256 << 10
#: Distinct words whose n-grams a worker keeps before it starts anew.
MEMO_WORDS = 300_000
#: Longer words are cut into n-grams each time, so that the memo stays small.
MEMO_LENGTH = 64

_STOPS = frozenset(".!?…。！？")
_WIDE = "぀-ヿ㐀-䶿一-鿿豈-﫿"
# One Chinese or Japanese character, or a run of other letters that is no part of an identifier.
WORD = re.compile(rf"[{_WIDE}]|(?<![\d_-])[^\W\d_{_WIDE}]++(?:['’][^\W\d_{_WIDE}]++)?+(?![\d_-])")
_KANA_OR_HAN = re.compile(f"[{_WIDE}]")

# What is no running text: code, formulas, markup, addresses, headings. Each rule runs only
# on texts that hold one of its signs.
_MASKS = [
    (("```", "~~~"), re.compile(r"^[ \t]*(```+|~~~+)[^\n]*\n.*?(?:^[ \t]*\1[^\n]*$|\Z)", re.S | re.M)),
    (("`",), re.compile(r"(`+)[^`\n]+\1")),
    (("<!--", "<pre", "<code", "<script", "<style", "<h", "<title", "<PRE", "<CODE", "<H", "<TITLE"), re.compile(r"<!--.*?-->|<(pre|code|script|style|h[1-6]|title)\b[^>]*>.*?</\1\s*>", re.S | re.I)),
    (("<",), re.compile(r"</?[A-Za-z](?:[^<>\n]|\n(?![ \t\r]*\n))*>")),
    (("&",), re.compile(r"&#?\w+;")),
    (("\\begin", "\\[", "\\("), re.compile(r"\\begin\{(equation|align|verbatim|lstlisting|tabular|displaymath)\*?\}.*?\\end\{\1\*?\}|\\\[.*?\\\]|\\\(.*?\\\)", re.S)),
    (("$",), re.compile(r"\$\$[^$]+\$\$|(?<![\\$\w])\$(?=[^\s$])[^$\n]*?(?<=[^\s\\$(])\$(?![\d$])")),
    (("section", "chapter", "\\title", "\\paragraph"), re.compile(r"^[^\n]*\\(?:(?:sub)*section|chapter|title|(?:sub)?paragraph)\*?\{[^\n]*$", re.M)),
    (("\\",), re.compile(r"\\(?:label|ref|cite\w*|begin|end|includegraphics|usepackage|documentclass)(?:\[[^\]\n]*\])?\{[^}\n]*\}|\\[A-Za-z]+\*?")),
    (("{{", "{|"), re.compile(r"\{\{[^{}]*\}\}|\{\|.*?^\|\}", re.S | re.M)),
    (("](", "][", "]:", "[["), re.compile(r"(?<=\])\([^()\n]*\)|(?<=\])\[[^\[\]\n]*\]|^\[[^\]\n]+\]:[^\n]*$|\[\[[^\[\]|\n]*\||\[\[\w+:[^\[\]\n]*\]\]", re.M)),
    (("|\n", "||"), re.compile(r"^[ \t]*\|[^\n]*$", re.M)),
    (("#",), re.compile(r"^[ \t]*#{1,6}[ \t][^\n]*$|(?<!\w)#\w[\w-]*", re.M)),
    (("==",), re.compile(r"^={1,6}[^=\n][^\n]*={1,6}[ \t]*$|^[^\n]+\n=+[ \t]*$", re.M)),
    (("\n---",), re.compile(r"^(?![-*+>])[^\n.!?]+\n-{3,}[ \t]*$", re.M)),
    (("://",), re.compile(r"\b(?:https?|ftp|file)://\S+")),
    (("__",), re.compile(r"__[A-Z]+__")),
]
_END = re.compile(r"[.!?…][\"'»”’)\]*_~]*(?=\s|$)|[。！？][」』”）*_~]*|\n(?=\s*(?:[-*+#>|=:;{<\\&]|\d+[.)]\s|\n|$))|\Z")


def _blank(m: re.Match) -> str:
    found = m.group()
    return re.sub(r"[^\n]", " ", found) if "\n" in found else " " * len(found)


def masked(text: str) -> str:
    """``text`` with everything that is no running text blanked, all places kept."""
    for signs, rule in _MASKS:
        for sign in signs:
            if sign in text:
                text = rule.sub(_blank, text)
                break
    return text


def sentences(text: str) -> list[tuple[int, int, str, bool]]:
    """Start, end, running text and whether it is a whole sentence, of each sentence of ``text``."""
    plain = masked(text)
    out, start = [], 0
    for m in _END.finditer(plain):
        end = m.end()
        piece = plain[start:end]
        if len(piece) > 1 and not piece.isspace():
            out.append((start, end, piece, m.group()[:1] in _STOPS))
        start = end
    return out


def word_ngrams(word: str) -> list[str]:
    """N-grams of one word in lower case, borders as ``_``; longer ones up to ``LONGEST``."""
    word = word.lower()
    if _KANA_OR_HAN.fullmatch(word):
        return [word]
    padded = f"_{word}_"
    return [padded[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(padded) - n + 1)]


class Profiles:
    """Rank tables of several languages over one numbering of n-grams."""

    def __init__(self, ranked: Mapping[str, list[str]]):
        self.languages = sorted(ranked)
        union = sorted({g for grams in ranked.values() for g in grams})
        self.number = {g: i for i, g in enumerate(union)}
        self.absent = max((len(g) for g in ranked.values()), default=0)
        # a text has no more distinct known n-grams than the profiles together, so that all places fit into the type
        self.rank = np.full((len(union) + 1, len(self.languages)), self.absent, np.int16 if max(len(union), self.absent) < 2**15 else np.int32)
        for j, language in enumerate(self.languages):
            for r, g in enumerate(ranked[language]):
                self.rank[self.number[g], j] = r
        # ties of frequency inside a text are ordered by the best place in any profile
        best = self.rank[:-1].min(axis=1) if len(union) else np.zeros(0)
        self.order = np.empty(len(union), np.int64)
        self.order[np.argsort(best, kind="stable")] = np.arange(len(union))
        by_order = np.argsort(self.order)
        self.ranks = [np.ascontiguousarray(self.rank[by_order, j]) for j in range(len(self.languages))]
        self.memo: dict[str, list[int]] = {}
        single = np.array([_KANA_OR_HAN.fullmatch(g) is not None for g in union], bool)
        leading = self.rank[:-1] < 100
        #: Languages written in Chinese or Japanese characters, as the head of the profile shows.
        self.wide = (leading & single[:, None]).sum(axis=0) * 5 > leading.sum(axis=0)

    def dumps(self) -> str:
        return json.dumps({lang: [g for g, i in sorted(self.number.items(), key=lambda x: self.rank[x[1], j]) if self.rank[i, j] < self.absent] for j, lang in enumerate(self.languages)}, ensure_ascii=False)

    @classmethod
    def loads(cls, text: str) -> Profiles:
        return cls(json.loads(text))

    def grams(self, word: str) -> list[int]:
        """Places in ``order`` of the known n-grams of a word."""
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            number = self.number
            found = [int(self.order[number[g]]) for g in word_ngrams(word) if g in number]
            if len(word) <= MEMO_LENGTH:
                self.memo[word] = found
        return found

    def distances(self, texts: list[str], groups: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean out-of-place distance of each text to each language, its number of words, and the distances of each group of texts.

        ``groups`` numbers the texts' groups in rising order. All texts of a batch are
        ranked together by sorting integers.
        """
        k, n = len(self.languages), len(texts)
        many = int(groups[-1]) + 1 if groups is not None and len(groups) else 0
        nothing = np.full((n, k), float(self.absent)), np.zeros(n, np.int64), np.full((many, k), float(self.absent))
        index: dict[str, int] = {}
        codes_of, n_words = [], []
        for text in texts:
            found = WORD.findall(text)
            n_words.append(len(found))
            codes_of += [index.setdefault(w, len(index)) for w in found]
        if not codes_of or not len(self.number):
            return nothing
        codes = np.array(codes_of, np.int64)
        grams = [self.grams(w) for w in index]
        length = np.fromiter(map(len, grams), np.int64, len(grams))
        width = len(self.number)
        small = np.int32 if n * width < 2**31 else np.int64
        pool = np.array([g for gs in grams for g in gs], small)
        first = np.cumsum(length) - length
        size = length[codes]
        ends = np.cumsum(size)
        if not ends[-1]:
            return nothing
        place = np.arange(ends[-1]) + np.repeat(first[codes] - (ends - size), size)
        keys = pool[place] + np.repeat(np.repeat((np.arange(n) * width).astype(small), n_words), size)
        keys.sort()
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        count = np.diff(np.append(start, len(keys)))
        keys = keys[start].astype(np.int64)
        far, words = nothing[0], np.array(n_words)
        self._out_of_place(keys, count, far)
        # a profile of the other kind of script is out of the question
        is_wide = np.array([len(w) == 1 and w >= "぀" and _KANA_OR_HAN.match(w) is not None for w in index])
        wide = np.add.reduceat(np.append(is_wide[codes], False).astype(np.int64), np.minimum(np.cumsum(words) - words, len(codes)))
        wide = np.where(words > 0, wide, 0)
        far[np.ix_(2 * wide > words, ~self.wide)] = self.absent
        far[np.ix_((2 * wide <= words) & (words > 0), self.wide)] = self.absent
        if not many:
            return far, words, nothing[2]
        text = keys // width
        merged = groups[text] * width + (keys - text * width)
        bits = int(count.max()).bit_length()
        if int(merged.max()).bit_length() + bits < 63:
            packed = np.sort(merged << bits | count)  # sorting numbers is faster than sorting places
            merged, count = packed >> bits, packed & ((1 << bits) - 1)
        else:
            order = np.argsort(merged, kind="stable")
            merged, count = merged[order], count[order]
        start = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
        self._out_of_place(merged[start], np.add.reduceat(count, start), nothing[2])
        return far, words, nothing[2]

    def _out_of_place(self, keys: np.ndarray, count: np.ndarray, far: np.ndarray) -> None:
        """Fills ``far`` for the owners of ``keys`` (owner times width plus n-gram, each once)."""
        width, top = len(self.number), int(count.max()) + 1
        owner = keys // width
        gram = keys - owner * width
        if (int(owner[-1]) + 1) * top * width < 2**63:
            gram = np.sort((owner * top + (top - 1 - count)) * width + gram) % width
        else:
            gram = gram[np.lexsort((gram, -count, owner))]
        begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        distinct = np.diff(np.append(begin, len(owner)))
        place = (np.arange(len(owner)) - np.repeat(begin, distinct)).astype(self.rank.dtype)
        rows = owner[begin]
        for j, rank in enumerate(self.ranks):
            far[rows, j] = np.add.reduceat(np.abs(rank[gram] - place), begin, dtype=np.int64) / distinct


def profile_of(counts: Counter, size: int = PROFILE_SIZE) -> list[str]:
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]]


def fit_profiles(labelled: Iterable[tuple[str, str]], rounds: int = 2, size: int = PROFILE_SIZE) -> Profiles:
    """Profiles from ``(language, text)`` pairs.

    Labels may be wrong and texts mixed: after the first profiles are made from all
    sentences, each round makes them anew from those sentences that lie nearest to the
    profile of their own label.
    """
    known = [(lang, piece) for lang, text in labelled for _, _, piece, whole in sentences(text) if whole]
    words = [WORD.findall(piece) for _, piece in known]
    keep = np.ones(len(known), bool)
    profiles = Profiles({})
    for _ in range(rounds + 1):
        spoken: dict[str, Counter] = defaultdict(Counter)
        for (lang, _), found, kept in zip(known, words, keep):
            if kept:
                spoken[lang].update(found)
        ranked = {}
        for lang, of in spoken.items():
            counts: Counter = Counter()
            for word, n in of.items():
                for gram in word_ngrams(word):
                    counts[gram] += n
            ranked[lang] = profile_of(counts, size)
        profiles = Profiles(ranked)
        if known and profiles.languages:
            far = np.concatenate([profiles.distances([p for _, p in known[i : i + 2000]])[0] for i in range(0, len(known), 2000)])
            keep = np.array([profiles.languages[j] == lang for j, (lang, _) in zip(far.argmin(axis=1), known)])
    return profiles


def label_code(col: Column, codes: list[tuple[str, str, str]]) -> Column:
    """The language that a label names: trimmed, lower-cased, without a region, by code, code3 or name; else null."""
    bare = F.regexp_replace(F.lower(F.trim(F.regexp_replace(col, r"(?U)^\s+|\s+$", ""))), r"[-_].*$", "")
    named = F.lit(None).cast("string")
    for code, code3, name in codes:
        names = [x.lower() for x in (code, code3, name) if x]
        named = F.when(bare.isin(names), F.lit(code)).otherwise(named)
    return named


def language_codes(lang_codes: DataFrame) -> list[tuple[str, str, str]]:
    """The rows of the table of languages; it has one row per language."""
    return [(r["code"], r["code3"], r["name"]) for r in lang_codes.where("code is not null").orderBy("code").collect()]


def fit_from_documents(documents: DataFrame, codes: list[tuple[str, str, str]], key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = FIT_DOCUMENTS) -> Profiles:
    """Profiles fitted on at most ``most`` labelled documents of each language, chosen by hashes of key and text.

    One aggregation counts each language's documents; from the counts follows how small a
    hash must be so that about as many as needed pass. Of these each task keeps ``most`` of a
    language at the most, also where copies of one record are a great part of all rows;
    only the chosen ones come to the driver, whole, at any size of the corpus.
    """
    label = label_code(F.col(lang), codes)
    space = 1 << 40
    place = F.pmod(F.xxhash64(F.lit(11), F.col(key), F.col(text)), F.lit(space))
    usable = documents.where(F.col(text).isNotNull()).select(label.alias("lang"), place.alias("place"), F.col(text).alias("text"))
    counts = {r["lang"]: r["count"] for r in usable.where("lang is not null").groupBy("lang").count().collect()}
    if not counts:
        return Profiles({})
    wanted = most + 5 * most**0.5
    chosen = F.lit(False)
    for name, n in counts.items():
        chosen = chosen | ((F.col("lang") == name) & (F.col("place") < int(space * min(1.0, wanted / n))))
    first = Window.partitionBy("lang").orderBy("place")
    kept = usable.where(chosen).withColumn("n", F.row_number().over(first)).where(F.col("n") <= most)
    by_lang: dict[str, list] = defaultdict(list)
    for r in kept.select("lang", "place", "text").collect():
        by_lang[r["lang"]].append((r["place"], r["text"]))
    return fit_profiles((name, t) for name in sorted(by_lang) for _, t in sorted(by_lang[name]))


def passages_of(texts: list[str | None], profiles: Profiles, margin: float = FOREIGN_MARGIN, least: int = LEAST_WORDS) -> list[tuple[str | None, float, list[tuple[int, int, str, float, int]]]]:
    """Of each text: its language, the confidence, and its passages.

    A passage is ``start, end, language, confidence, whole sentences``. The document's
    language is that nearest to all its running text. A sentence keeps it unless another
    profile is nearer by ``margin``, a part of the profiles' length; neighbouring sentences of one language
    make one passage. Between two about equally near languages the one decides that other
    foreign sentences of the text clearly speak. Fewer than ``least`` words are no sentence.
    """
    split = [sentences(t) if t else [] for t in texts]
    number = np.array([len(found) for found in split], np.int64)
    if not len(profiles.languages) or not number.sum():
        return [(None, 0.0, []) for _ in texts]
    groups = np.repeat(np.arange(len(texts)), number)
    far, words, whole = profiles.distances([s[2] for found in split for s in found], groups)
    whole = np.concatenate([whole, np.full((len(texts) - len(whole), whole.shape[1]), float(profiles.absent))])
    main, best = whole.argmin(axis=1), far.argmin(axis=1)
    base = main[groups]
    rows = np.arange(len(far))
    foreign = (best != base) & (words >= least) & (far[rows, base] - far[rows, best] >= margin * profiles.absent)
    lang = np.where(foreign, best, base)
    # a foreign sentence that lies about as near to two languages takes the one that other sentences clearly speak
    near = far <= far[rows, best][:, None] + margin * profiles.absent
    unclear = foreign & (near.sum(axis=1) > 1)
    clear = np.zeros((len(texts), far.shape[1]), bool)
    sure_of = foreign & ~unclear
    clear[groups[sure_of], best[sure_of]] = True
    heard = near & clear[groups] & unclear[:, None]
    better = heard.any(axis=1)
    lang[better] = np.where(heard[better], far[better], np.inf).argmin(axis=1)
    sure, sure_main = _confidence(far, lang).tolist(), _confidence(whole, main).tolist()
    spoken = (np.bincount(groups, weights=words, minlength=len(texts)) > 0) & (whole.min(axis=1) < profiles.absent)
    lang, complete = lang.tolist(), (words >= least).tolist()
    out, at = [], 0
    for i, found in enumerate(split):
        if not spoken[i]:
            out.append((None, 0.0, []))
            at += len(found)
            continue
        passages: list[list] = []
        for j, (start, end, _, stop) in enumerate(found, at):
            if passages and passages[-1][2] == lang[j]:
                last = passages[-1]
                last[1], last[3], last[4] = end, max(last[3], sure[j]), last[4] + (stop and complete[j])
            else:
                passages.append([start, end, lang[j], sure[j], int(stop and complete[j])])
        at += len(found)
        out.append((profiles.languages[main[i]], sure_main[i], [(a, b, profiles.languages[g], c, int(w)) for a, b, g, c, w in passages]))
    return out


def _confidence(far: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """0 for no nearer than another profile, towards 1 the farther all others are."""
    if far.shape[1] < 2:
        return np.ones(len(far))
    rows = np.arange(len(far))
    others = far.copy()
    others[rows, chosen] = np.inf
    nearest = others.min(axis=1)
    return np.clip(1 - far[rows, chosen] / np.maximum(nearest, 1e-9), 0, 1)


_profiles: dict[int, Profiles] = {}


def identify_languages(documents: DataFrame, profiles: Profiles, key: str = "doc_id", text: str = "text", label: Column | None = None, margin: float = FOREIGN_MARGIN) -> DataFrame:
    """``key, label, doc_lang, doc_confidence, start, end, lang, confidence, sentences``, one row per passage.

    ``start`` and ``end`` are places in the text; ``sentences`` counts the whole sentences of
    the passage. A null, empty or blank text, or one without running text, gives one row
    with null languages and confidence 0. Repeated rows stay repeated. ``label`` is kept
    as it is given.
    """
    kind = documents.schema[key].dataType.simpleString()
    table = profiles.dumps()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (stored := _profiles.get(hash(table))) is None:
            _profiles.clear()
            stored = _profiles[hash(table)] = Profiles.loads(table)
        for batch in bounded(batches, 2, RANKED_BYTES):
            rows, columns = [], [[] for _ in range(7)]
            for i, (lang, sure, passages) in enumerate(passages_of(batch.column(2).to_pylist(), stored, margin)):
                for a, b, g, c, w in passages or [(None, None, None, 0.0, 0)]:
                    rows.append(i)
                    for column, value in zip(columns, (lang, sure, a, b, g, c, w)):
                        column.append(value)
            kinds = (pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32())
            at = pa.array(rows, pa.int64())
            yield pa.record_batch(
                [batch.column(0).take(at), batch.column(1).take(at), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["key", "label", "doc_lang", "doc_confidence", "start", "end", "lang", "confidence", "sentences"],
            )

    chosen = documents.select(F.col(key).alias("key"), (label if label is not None else F.lit(None).cast("string")).alias("label"), F.col(text).alias("text"))
    schema = f"key {kind}, label string, doc_lang string, doc_confidence double, start int, end int, lang string, confidence double, sentences int"
    return chosen.mapInArrow(find, schema).withColumnRenamed("key", key)
