"""Toxicity scores over text that a noisy-channel decoder has restored.

*Channel.* A writer may hide a word by look-alike characters (``1d10t``, ``a$$``), separators or blanks between its letters (``l.o.s.e.r``,
``m o r o n``, with any white space) and repeated letters (``stuuupid``). For a token that shows such signs a lattice is built: every character stands
for itself, for the letters it looks like, or for nothing (a separator, or one more of the same letter), each
at a price. Viterbi decoding finds the cheapest path under a trigram model over characters. The model is counted over all
documents. Runs of single letters are decoded as one lattice, in which a blank may stay or go.
In a token a separator goes in one reading and may end a word in another (``total-1d10t``); signs at a token's edges are read both as
punctuation and as letters. The strongest weight of all readings counts, once for each token.

*Score.* Words and word beginnings are weighted by how much more often they stand in toxic documents than in others; a document's
strongest weights go through a logistic regression. Both are learned from labelled documents that are not held
out, from at most ``TRAIN_DOCS`` of them (the first by a hash of doc_id).

* Null and empty texts have no words and get the score of a document without toxic words.
* Labels that are null, of unknown documents, or contradict each other are not learned from.
* Repeated rows get equal scores. Without any label of each kind every score is 0.
* Very long texts are scored as a whole. An empty table gives an empty result.
* Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricledger.llm.common import batches_from, handed_back, labelled, rows_of, slices, texts, written

#: Symbols of the character model: 0 a boundary, 1-26 a-z, then other letters by code point.
SYMBOLS = 64
#: Labelled documents learned from, at most.
TRAIN_DOCS = 40_000
#: Words and beginnings that carry a weight, at most: those with the strongest evidence.
LEXICON = 20_000
#: Toxic documents that a word must stand in, and the least weight (a difference of log odds) and evidence (the root of the likelihood ratio statistic).
LEAST_DOCS, LEAST_WEIGHT, LEAST_EVIDENCE = 4, 1.5, 4.4
PREFIXES = (3, 4, 5, 6)
#: Prices, as natural logarithms: a look-alike, a dropped separator or blank, a dropped repetition.
LOOK_ALIKE, DROPPED, REPEATED = -1.0, -0.5, -0.7
#: Prices of a blank that stays in a run of single characters, and of another separator that ends a word.
KEPT_BLANK, KEPT_SEPARATOR = -2.0, -0.5
REMEMBERED = 150_000
#: Of a run of single characters, each place begins a word of so many.
LONGEST_IN_RUN = 16

# Which letters a character may stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = frozenset(".-_*~'`,:;/\\=^ ·•")
_SINGLES = re.compile(r"(?<!\S)\S(?!\S)(?:\s++\S(?!\S)){2,}+")
_RUN = re.compile(rb"\x01{3,}")
#: What is taken off a token at both ends, and then at its end; some of it may stand for letters.
BRACKETS, ENDINGS = "\"'()[]{}<>.,;:?*#%&", "!$|@+=~^/\\-_"
_PARTS = re.compile("[" + re.escape("".join(sorted(SEPARATORS))) + "]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_THRICE, _TWICE, _MORE = re.compile(r"(\w)\1\1"), re.compile(r"(\w)\1+"), re.compile(r"(\w)\1{3,}")


def _symbol_table() -> np.ndarray:
    table = np.zeros(1 << 16, np.int32)
    for i in range(1 << 16):
        c = chr(i)
        if "a" <= c <= "z":
            table[i] = i - 96
        elif c.isalpha():
            table[i] = 27 + i % (SYMBOLS - 27)
    return table


_TABLE = _symbol_table()


def _symbol(c: str) -> int:
    return int(_TABLE[min(ord(c), 0xFFFF)])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """trigram, n: of all texts of a task."""
    total = np.zeros(SYMBOLS**3, np.int64)
    for b in batches:
        for (text,) in rows_of(b, "text"):
            s = _TABLE[np.minimum(np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), np.uint32), 0xFFFF)]
            # a boundary once, however many characters it has
            s = s[(s > 0) | (np.append(s[1:], 1) > 0)]
            s = np.concatenate([s[:1], s])
            if len(s) > 2:
                # the letter before a word's first one is a boundary as well
                before = np.where(s[1:-1] > 0, s[:-2], 0)
                total += np.bincount(before * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:], minlength=SYMBOLS**3)
    at = np.flatnonzero(total)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["trigram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """Log probability of a symbol after two others, from all documents."""
    rows = texts(docs).where("text IS NOT NULL").select("text").mapInArrow(handed_back(_counts), "trigram long, n long")
    n = np.zeros(SYMBOLS**3)
    for r in rows.groupBy("trigram").agg(F.sum("n").alias("n")).collect():  # at most one row a trigram
        n[r["trigram"]] = r["n"]
    tri = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    bi = tri.sum(0)
    uni = bi.sum(0)
    p1 = (uni + 1) / (uni.sum() + SYMBOLS)
    p2 = (bi + 5 * p1) / (bi.sum(1, keepdims=True) + 5)
    p3 = (tri + 5 * p2[None]) / (tri.sum(2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


def _spelled(path: tuple | None, last_word: bool = False) -> str:
    letters = []
    while path is not None:
        path, x = path
        if last_word and x == " ":
            break
        letters.append(x)
    return "".join(reversed(letters))


class Decoder:
    """Restores tokens under a character model."""

    def __init__(self, model: np.ndarray) -> None:
        self.model = model.tolist()

    def viterbi(self, token: str, doubled: bool = False, joined: bool = False) -> str:
        """The cheapest reading of a token; blanks in it may stay as word boundaries, and other separators if ``joined`` is set.

        Of letters three or more times in a row any may go; of doubled ones only if ``doubled`` is set.
        """
        return self.beginnings(token, {len(token)}, doubled, joined)[-1]

    def beginnings(self, token: str, ends: set[int], doubled: bool = False, joined: bool = False) -> list[str]:
        """Of the cheapest reading of the token up to each of the ends the last word; for the token's length, which is the last end, the whole reading."""
        model, found = self.model, []
        # the last letter and what stood before it, so that a path of any length costs the same a character
        paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for i, c in enumerate(token):
            again = i > 0 and token[i - 1] == c and (doubled or token[i - 2 : i + 1] == 3 * c or token[i - 1 : i + 2] == 3 * c)
            reads = [(x, LOOK_ALIKE) for x in LOOKS.get(c, "")]
            if c.isalpha():
                reads.append((c, 0.0))
            if c == " ":
                reads.append((" ", KEPT_BLANK))
            elif joined and c in SEPARATORS:
                reads.append((" ", KEPT_SEPARATOR))
            drop = DROPPED if c in SEPARATORS or not reads else REPEATED if again else None
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (price, path) in paths.items():
                if drop is not None:
                    old = after.get((a, b))
                    if old is None or old[0] < price + drop:
                        after[a, b] = price + drop, path
                for x, more in reads:
                    if x == " " and b == 0:
                        continue
                    s = 0 if x == " " else _symbol(x)
                    total = price + more + model[a][b][s]
                    key = (b, s) if s else (0, 0)
                    old = after.get(key)
                    if old is None or old[0] < total:
                        after[key] = total, (path, x)
            paths = after or paths
            if i + 1 in ends:
                ended = [(price + (model[a][b][0] if b else 0.0), path) for (a, b), (price, path) in paths.items()]
                best = max(price for price, _ in ended)
                found.append(max(_spelled(path, i + 1 < len(token)) for price, path in ended if price == best))
        return found or [""]

    def words(self, token: str, doubled: bool = False) -> list[str]:
        """The words of a token in lower case, restored if it shows signs of disguise; each reading of it adds its words."""
        core = token.strip(BRACKETS)
        core = core.rstrip(ENDINGS)
        edges = self._of_edges(token, core, doubled) if len(core) < len(token) else []
        if not core or core.isalpha() and not (doubled or _THRICE.search(core)):
            return [core, *edges] if core else edges
        if not any(c.isalpha() or c in LOOKS for c in core) or core.isdigit():
            return _LETTERS.findall(core) + edges
        found = self.viterbi(core, doubled).split()
        if not SEPARATORS.isdisjoint(core):
            # a separator stands between letters or between words: one reading where all go, one where each may end a word, and parts alone: between all, and between those of one kind
            found += self.viterbi(core, doubled, True).split()
            for part in dict.fromkeys([*_PARTS.split(core), *(x for c in sorted(SEPARATORS & set(core)) for x in core.split(c))]):
                found += self.viterbi(part, doubled).split()
        return found + (_LETTERS.findall(core) if not core.isalpha() else []) + edges

    def _of_edges(self, token: str, core: str, doubled: bool) -> list[str]:
        """The words of a token with the punctuation at its edges that may stand for letters: any number of such characters at its end, none, one or all at its beginning."""
        if not core and len({c for c in token if c in LOOKS}) < 2:
            return []  # nothing but one sign
        first = len(token) - len(token.lstrip(BRACKETS)) if core else 0
        last = first + len(core)
        before = first - len(token[:first].rstrip("("))
        if not before and LOOKS.keys().isdisjoint(token[last:]):
            return []  # nothing here may stand for a letter
        # of three or more equal signs any may go
        ends = {k for k in range(last + 1, len(token) + 1) if token[k - 1] in LOOKS and token[max(k - 4, last) : k] != 4 * token[k - 1]}
        words: list[str] = []
        for start in {first, first - min(before, 1), first - before}:
            till = max(ends, default=last if start < first else start)
            if till > start:
                for reading in self.beginnings(token[start:till], {k - start for k in ends | {till}}, doubled, True):
                    words += reading.split()
        return words


def tokens_of(text: str | None) -> tuple[set[str], list[str]]:
    """The distinct tokens, and the runs of three or more single characters, with one blank for any white space between them."""
    words = (text or "").lower().split()
    single = bytes(map((1).__eq__, map(len, words)))
    return set(words), [" ".join(words[m.start() : m.end()]) for m in _RUN.finditer(single)]


def places(run: str) -> set[str]:
    """What may be a word in a run of single characters: all stretches of bounded length, without the blanks, and the run as a whole."""
    # any of three equal letters may go, so more of them say nothing more
    chars = _MORE.sub(r"\1\1\1", run.replace(" ", ""))
    return {run} | {chars[i : i + LONGEST_IN_RUN] for i in range(len(chars) - 2)} if any(c.isalpha() for c in chars) else set()


def restored(text: str | None, decoder: Decoder) -> str:
    """A text as the scorer reads it: runs of single characters and disguised tokens decoded, the rest in lower case."""
    low = _SINGLES.sub(lambda m: decoder.viterbi(" ".join(m[0].split())), (text or "").lower())
    return re.sub(r"\S+", lambda m: " ".join(decoder.words(m[0])), low)


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]


def read_words(text: str | None, decoder: Decoder) -> set[str]:
    tokens, runs = tokens_of(text)
    out = {w for t in tokens for w in decoder.words(t)}
    for run in runs:
        out.update(w for x in places(run) for w in decoder.viterbi(x).split())
    return out


@dataclass
class Model:
    characters: np.ndarray
    weights: dict[str, float]
    coefficients: list[float]

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model) -> None:
        self.decoder, self.weights, self.coefficients = Decoder(model.characters), model.weights, model.coefficients
        self.known: dict[str, float] = {}
        # a word of which no weighted feature shares the beginning has no weight
        self.first = min(PREFIXES)
        self.starts = {f[: self.first] for f in self.weights}

    def _of_word(self, word: str) -> float:
        if word[: self.first] not in self.starts:
            return 0.0
        weights = self.weights
        return max((weights[f] for f in features(word) if f in weights), default=0.0)

    def _of_token(self, token: str) -> float:
        best = max(map(self._of_word, self.decoder.words(token)), default=0.0)
        if _TWICE.search(token):
            # doubled letters are common; they are decoded only where a weighted word may stand behind them
            single = _TWICE.sub(r"\1", token)
            if any(self._of_word(w) > best for w in self.decoder.words(single)):
                best = max(best, max(map(self._of_word, self.decoder.words(token, True)), default=0.0))
        return best

    def inputs(self, text: str | None) -> list[float]:
        tokens, runs = tokens_of(text)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        found = []
        for t in tokens:
            w = known.get(t)
            if w is None:
                w = known[t] = self._of_token(t)
            if w:
                found.append(w)
        for run in runs:
            found += [w for w in (max(map(self._of_word, self.decoder.viterbi(x).split()), default=0.0) for x in places(run)) if w]
        return [1.0, max(found, default=0.0), math.log1p(sum(found)), math.log1p(len(found)), len(found) / math.sqrt(len(tokens) + 1)]

    def score(self, text: str | None) -> float:
        z = sum(c * x for c, x in zip(self.coefficients, self.inputs(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Ridge logistic regression by Newton steps; the first column is the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = TRAIN_DOCS) -> Model:
    spark = docs.sparkSession
    model = Model(character_model(docs), {}, [-30.0, 0.0, 0.0, 0.0, 0.0])
    sample = written(labelled(docs, labels, label, limit), "toxicity_sample")
    kinds = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(kinds) < 2:
        return model
    characters = spark.sparkContext.broadcast(model.characters)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(characters.value)

        def rows() -> Iterator[tuple]:
            for b in batches:
                for text, y in rows_of(b, "text", "y"):
                    for f in {f for w in read_words(text, decoder) for f in features(w)}:
                        yield f, y

        yield from batches_from(rows(), pa.schema([("feature", pa.string()), ("y", pa.int32())]), 32_768)

    counts = sample.mapInArrow(handed_back(seen), "feature string, y int").groupBy("feature").agg(F.sum("y").alias("toxic"), F.count("*").alias("n"))
    a, b = F.col("toxic") + 0.5, F.col("n") - F.col("toxic") + 0.5
    weight = F.log(a / (kinds[1] - a + 1)) - F.log(b / (kinds[0] - b + 1))
    every = float(kinds[0] + kinds[1])

    def part(k: Column, of: float) -> Column:
        return F.when(k > 0, k * F.log(k * every / (F.col("n") * of))).otherwise(0.0) + F.when(k < of, (of - k) * F.log((of - k) * every / ((every - F.col("n")) * of))).otherwise(0.0)

    clean = F.col("n") - F.col("toxic")
    evidence = F.sqrt(F.greatest(2 * (part(F.col("toxic"), kinds[1]) + part(clean, kinds[0])), F.lit(0.0)))
    strong = counts.where(F.col("toxic") >= LEAST_DOCS).select("feature", weight.alias("weight"), evidence.alias("evidence"))
    strong = strong.where((F.col("weight") >= LEAST_WEIGHT) & (F.col("evidence") >= LEAST_EVIDENCE))
    model.weights = {r["feature"]: r["weight"] for r in strong.orderBy(F.desc("evidence"), "feature").limit(LEXICON).collect()}
    sent = spark.sparkContext.broadcast(model)

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value.scorer()
        rows = ((scorer.inputs(text), y) for b in batches for text, y in rows_of(b, "text", "y"))
        yield from batches_from(rows, pa.schema([("x", pa.list_(pa.float64())), ("y", pa.int32())]))

    known = sorted((tuple(r["x"]), r["y"]) for r in sample.mapInArrow(handed_back(rated), "x array<double>, y int").collect())  # bounded by ``limit``
    model.coefficients = logistic(np.array([x for x, _ in known]), np.array([y for _, y in known], float))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value.scorer()
        yield from batches_from(((d, scorer.score(t)) for b in batches for d, t in rows_of(b, "doc_id", "text")), schema)

    return texts(docs).mapInArrow(handed_back(run), "doc_id long, score double")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below the threshold, all columns as they were. Rows are judged in one pass, where they stand."""
    sent, at = docs.sparkSession.sparkContext.broadcast(fit(docs, labels)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value.scorer()
        for b in batches:
            for part in slices(b):
                text = part.column(at).to_pylist()
                yield part.filter(pa.array([scorer.score(t) < threshold for t in text], pa.bool_()))

    return docs.mapInArrow(handed_back(run), docs.schema)
