"""Language ID by unigrams over a fixed public vocabulary, summed over all segmentations.

Each language has a probability for every piece of the vocabulary. The probability of a word is the sum, over all ways to cut
it into pieces, of the product of their probabilities (forward algorithm); of a text, the product over its words. Pieces are
learned by expectation-maximisation: the E step (forward-backward) runs where the texts are, one pass over the learning
rows, and only vocabulary x language sums travel, a size that the vocabulary bounds.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envspark.llm.common import chunks, prefix_sums, run_hashes, span_hashes, trim, utf8

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Longest piece that is used, in characters.
LONGEST = 16
#: Words whose scores a worker keeps, and their characters.
KEPT_WORDS, KEPT_CHARACTERS = 150_000, 3_000_000
#: Words that are scored at once, and the length up to which that is done side by side.
SIDE_BY_SIDE, SIDE_LENGTH = 4_000, 40
#: Bytes of text whose words are counted at once; a longer text is taken alone.
TEXT_BYTES = 1 << 19


#: Each character's probability is scaled by this, against underflow in words of up to SIDE_LENGTH characters.
SCALE = 30.0
_SCALES = SCALE ** np.arange(LONGEST + 1.0)


def _words(text: str) -> Counter:
    return Counter(text.lower().split())


def _texts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The texts of a column, nulls as empty, some at once with the number of the first."""
    _, offsets = utf8(column)
    for a, b in chunks(offsets, TEXT_BYTES):
        yield a, [t or "" for t in column.slice(a, b - a).to_pylist()]


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each after a word mark, and where each word begins (one more at the end)."""
    text = "".join("\u2581" + w for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.r_[0, np.cumsum([len(w) + 1 for w in words])]


class Pieces:
    """The vocabulary as a table of hashed prefixes: whether a run of characters begins a piece, and which piece it is."""

    _loaded: dict[str, "Pieces"] = {}

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.prior = np.full(self.size, math.exp(-18.0))
        self.bytes = np.zeros(256, dtype=np.int64)
        ids: dict[str, int] = {}
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (model.is_unknown(i) or model.is_control(i)) and len(piece.lower()) <= LONGEST:
                own = ids.setdefault(piece.lower(), i)  # texts are lower-cased, so cased forms share the first one's place
                self.prior[own] = (self.prior[own] if own != i else 0.0) + 1.0 / (i + 10)
        self.prior /= self.prior.sum()
        known = {piece[:k]: -1 for piece in ids for k in range(1, len(piece) + 1)} | ids
        runs = list(known)
        codes = np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32)
        end = np.cumsum([len(r) for r in runs])
        start = end - [len(r) for r in runs]
        hashes = span_hashes(codes, start, end)
        self.bits = 19
        while 1 << self.bits < 4 * len(runs):
            self.bits += 1
        self.keys = np.zeros((1 << self.bits) + 64, dtype=np.uint64)
        self.values = np.full(len(self.keys), -2, dtype=np.int64)
        for h, slot, value in zip(hashes.tolist(), (hashes >> np.uint64(64 - self.bits)).tolist(), known.values()):
            while self.values[slot] != -2:
                slot += 1
            self.keys[slot], self.values[slot] = h, value

    @classmethod
    def load(cls, path: str) -> "Pieces":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hashed run; -1: it only begins pieces; -2: it doesn't."""
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.keys[slot] == hashes, self.values[slot], -3)
        open_ = np.flatnonzero((out == -3) & (self.values[slot] != -2))
        out[out == -3] = -2
        while len(open_):
            slot[open_] += 1
            at = slot[open_]
            hit = self.keys[at] == hashes[open_]
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (self.values[at] != -2)]
        return out

    def arcs(self, codes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and piece of every run that is a piece; one of a character without a piece has piece -1 - its code."""
        limit = np.repeat(begin[1:], np.diff(begin))
        powers = prefix_sums(codes)
        alive = np.arange(len(codes))
        starts, lengths, found = [], [], []
        for k in range(1, LONGEST + 1):
            alive = alive[alive + k <= limit[alive]]
            if not len(alive):
                break
            piece = self.find(run_hashes(powers, alive, alive + k))
            if k == 1:
                piece = np.where(piece < 0, -10 - codes.astype(np.int64), piece)
                take = np.ones(len(alive), dtype=bool)
            else:
                take = piece >= 0
            starts.append(alive[take])
            lengths.append(np.full(int(take.sum()), k))
            found.append(piece[take])
            alive = alive[(piece >= -1) | (piece <= -10)]
        return np.concatenate(starts), np.concatenate(lengths), np.concatenate(found)


def _lattice(pieces: Pieces, words: list[str], chance: np.ndarray) -> tuple:
    """The arcs of words in the order in which a forward pass takes them, with their scaled probabilities a language."""
    codes, begin = _codes(words)
    start, length, piece = pieces.arcs(codes, begin)
    word = np.repeat(np.arange(len(words)), np.diff(begin))[start]
    offset = start - begin[word]
    order = np.argsort(((offset + length) * (LONGEST + 1) + length).astype(np.int32), kind="stable")
    start, length, piece, word, offset = (x[order] for x in (start, length, piece, word, offset))
    value = chance.take(np.maximum(piece, 0), axis=0)
    for at in np.flatnonzero(piece < 0):
        value[at] = chance[pieces.bytes[list(chr(-10 - int(piece[at])).encode("utf-8", "surrogatepass"))]].prod(axis=0)
    value *= _SCALES.take(length)[:, None]
    end = offset + length
    cut = np.flatnonzero(np.r_[True, (end[1:] != end[:-1]) | (length[1:] != length[:-1]), True])
    node = start + word  # every word has one node more than characters
    return begin, node, length, piece, value, cut


def _forward(lattice: tuple, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """alpha of each node, and the first and last node of each word."""
    begin, node, length, _, value, cut = lattice
    first, last = begin[:-1] + np.arange(count), begin[1:] + np.arange(count)
    alpha = np.zeros((begin[-1] + count, value.shape[1]))
    alpha[first] = 1.0
    for a, b in zip(cut[:-1], cut[1:]):  # same end and length: no node twice
        alpha[node[a:b] + length[a]] += alpha[node[a:b]] * value[a:b]
    return alpha, first, last


def _grouped(words: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """Words side by side in groups, then the long ones."""
    short = [k for k, w in enumerate(words) if len(w) <= SIDE_LENGTH]
    for at in range(0, len(short), SIDE_BY_SIDE):
        group = short[at : at + SIDE_BY_SIDE]
        yield [words[k] for k in group], group


def _long(pieces: Pieces, word: str, chance: np.ndarray) -> np.ndarray:
    """Log-probability of one long word, by logs."""
    begin, node, length, _, value, _ = _lattice(pieces, [word], chance)
    value = np.log(value) - length[:, None] * math.log(SCALE)
    alpha = np.full((len(word) + 2, value.shape[1]), -np.inf)
    alpha[0] = 0.0
    for i, n, v in zip(node.tolist(), length.tolist(), value):
        alpha[i + n] = np.logaddexp(alpha[i + n], alpha[i] + v)
    return alpha[-1]


def word_scores(pieces: Pieces, words: list[str], weight: np.ndarray) -> np.ndarray:
    """Log-probability of each word in each language, over all segmentations."""
    out, chance = np.empty((len(words), weight.shape[1])), np.exp(weight)
    for own, at in _grouped(words):
        lattice = _lattice(pieces, own, chance)
        alpha, _, last = _forward(lattice, len(own))
        out[at] = np.log(alpha[last]) - (np.diff(lattice[0]) * math.log(SCALE))[:, None]
    for k, w in enumerate(words):
        if len(w) > SIDE_LENGTH:
            out[k] = _long(pieces, w, chance)
    return out


def expected_pieces(pieces: Pieces, counts: Counter, weight: np.ndarray) -> np.ndarray:
    """Expected number of each piece over all segmentations of the counted words, under one language's weights.

    Words of more than SIDE_LENGTH characters add the pieces of their runs of that length.
    """
    out, chance = np.zeros(pieces.size), np.exp(weight)[:, None]
    words: Counter = Counter()
    for w, n in counts.items():
        for i in range(0, len(w), SIDE_LENGTH):
            words[w[i : i + SIDE_LENGTH]] += n
    names = list(words)
    for own, _ in _grouped(names):
        lattice = _lattice(pieces, own, chance)
        begin, node, length, piece, value, cut = lattice
        alpha, first, last = _forward(lattice, len(own))
        beta = np.zeros_like(alpha)
        beta[last] = 1.0
        # arcs by start: a node's beta is whole when the arcs that leave it are done, longest start offset first
        offset = node - np.repeat(first, np.diff(begin) + 1)[node]
        order = np.lexsort((length, -offset))
        o, n = offset[order], length[order]
        edge = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (n[1:] != n[:-1]), True])
        for a, b in zip(edge[:-1], edge[1:]):
            at = order[a:b]
            beta[node[at]] += beta[node[at] + n[a]] * value[at]
        times = np.array([words[w] for w in own], dtype=float) / alpha[last, 0]
        word = np.repeat(np.arange(len(own)), np.diff(begin) + 1)[node]
        share = alpha[node, 0] * value[:, 0] * beta[node + length, 0] * times[word]
        plain = piece >= 0
        out += np.bincount(piece[plain], share[plain], minlength=pieces.size)
        for q, x in zip(piece[~plain].tolist(), share[~plain].tolist()):
            for one in chr(-10 - q).encode("utf-8", "surrogatepass"):
                out[pieces.bytes[one]] += x
    return out


def learn(rows: DataFrame, vocabulary: str = VOCABULARY) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (pieces x languages, then a row of log priors) from rows (text, lang).

    Rows without text or lang teach nothing; an empty table gives no language. Repeated rows count each, and the order of rows
    changes nothing. Extra columns are ignored.
    """

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(vocabulary)
        prior = np.log(pieces.prior)
        counts: dict[str, Counter] = {}
        texts: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, words in counts.items():
                sums = expected_pieces(pieces, words, prior)
                at = np.flatnonzero(sums)
                names = pa.array([lang] * (len(at) + 1), pa.string())
                yield pa.RecordBatch.from_arrays([names, pa.array(np.r_[at, -1].astype(np.int32)), pa.array(np.r_[sums[at], float(texts[lang])])], names=["lang", "piece", "expected"])
            counts.clear()
            texts.clear()

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, some in _texts(batch.column("text")):
                for lang, text in zip(langs[first:], some):
                    counts.setdefault(lang, Counter()).update(text.lower().split())
                    texts[lang] += 1
                if sum(map(len, counts.values())) > KEPT_WORDS or sum(len(w) for c in counts.values() for w in c) > KEPT_CHARACTERS:
                    yield from flush()
        yield from flush()
        trim()

    found = (
        rows.select("text", "lang").filter("text is not null and lang is not null")
        .mapInArrow(expect, "lang string, piece int, expected double")
        .groupBy("lang", "piece").agg(F.sum("expected").alias("expected")).toPandas()
    )
    languages = sorted(found["lang"].unique())
    size = Pieces.load(vocabulary).size
    prior = Pieces.load(vocabulary).prior
    weight = np.zeros((size, len(languages)))
    share = np.ones(len(languages))
    for k, lang in enumerate(languages):
        own = found[found["lang"] == lang]
        share[k] = own.loc[own["piece"] < 0, "expected"].sum()
        own = own[own["piece"] >= 0]
        weight[own["piece"].to_numpy(), k] = own["expected"].to_numpy()
    smooth = 0.5 * np.maximum(prior, prior.max() / 1e6)[:, None] * size / 50
    weight += smooth
    weight = np.log(weight / weight.sum(axis=0))
    return languages, np.vstack([weight, np.log(share / share.sum())]) if languages else np.zeros((size + 1, 0))


def predict(documents: DataFrame, languages: list[str], model: np.ndarray, vocabulary: str = VOCABULARY, keep: list[str] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Predicted language and score of every row, under names, after the columns named in keep (other columns than names).

    score is the posterior of lang_pred. A text that is null or has no letter is `und` with score 0, and so is every text if
    nothing was learned. Whole texts are scored, in time that grows with their length. Repeated rows are scored each; equal
    posteriors go to the language that comes first in the alphabet.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)
    schema = documents.select(*keep).schema.add(names[0], "string").add(names[1], "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(vocabulary)
        weight, prior = shared.value[:-1], shared.value[-1]
        known: dict[str, int] = {}
        table, characters = np.zeros((0, len(languages))), 0
        for batch in batches:
            best, sure = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            for first, some in _texts(batch.column("text")) if languages else ():
                counts = [_words(t) for t in some]
                fresh = list(set().union(*counts).difference(known))
                if fresh:
                    if len(known) + len(fresh) > KEPT_WORDS or characters > KEPT_CHARACTERS:
                        known.clear()
                        table, characters = np.zeros((0, len(languages))), 0
                        fresh = list(set().union(*counts))
                    known.update(zip(fresh, range(len(table), len(table) + len(fresh))))
                    characters += sum(map(len, fresh))
                    table = np.concatenate([table, word_scores(pieces, fresh, weight)])
                for k, words in enumerate(counts):
                    if not words or not any(c.isalpha() for w in words for c in w):
                        continue
                    at = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
                    times = np.fromiter(words.values(), dtype=float, count=len(words))
                    total = prior + times @ table[at]
                    top = int(np.argmax(total))
                    best[first + k] = languages[top]
                    sure[first + k] = float(1.0 / np.exp(total - total[top]).sum())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(best, pa.string()), pa.array(sure, pa.float64())], names=[*keep, *names])
        trim()

    return documents.select(*dict.fromkeys([*keep, "text"])).mapInArrow(score, schema)
