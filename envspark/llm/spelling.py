"""Spelling variants: words one edit apart, found by a variable-length gram index, and the more frequent form of each.

A gram dictionary is pruned by frequency: a gram that many words hold is told apart by its longer extensions, a rarer one is not
extended. At each place of a word (with marks at both ends) stands the shortest gram that isn't frequent. An edit changes no gram
but those that hold the edited place, so that two near words share all of a word's grams but the most that one place can affect.
Merging the lists of one more gram than that, the rarest ones, finds every near word; an edit distance verifies it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envspark.llm.common import BROADCAST_IDS, LOWER, chunks, saved, trim, utf8

LEAST_LENGTH, LEAST_COUNT, ONE_IN = 5, 3, 97
#: Grams are this long; with the longer the shorter of two words, no gram is longer than it.
SHORTEST, LONGEST = 2, 8
#: A gram that more words hold is frequent. The bound is doubled until the dictionary has DICTIONARY frequent grams at most.
FREQUENT, DICTIONARY = 32, 400_000
#: Lists that are longer aren't paired: their words meet by what is left of them without one letter.
HOT = 256
CHUNK = 1 << 22

_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _TABLE = np.where(_TABLE & 1, (_TABLE >> 1) ^ np.uint32(0xEDB88320), _TABLE >> 1)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _crc(state: np.ndarray, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of spans behind prefixes of which state has the CRC-32; side by side, longest first."""
    order = np.argsort(-size, kind="stable")
    out = ~state[order]
    starts, size = starts[order], size[order]
    for j in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -j))  # so many spans have a byte j
        head = out[:n]
        out[:n] = _TABLE[(head ^ data[starts[:n] + j]) & 255] ^ (head >> 8)
    back = np.empty_like(out)
    back[order] = ~out
    return back


def _runs(ids: list[str], data: np.ndarray, offsets: np.ndarray, least: int, one_in: int) -> pa.Array:
    """The words of all rows' texts, thinned, of least code points or more."""
    lead = data == 0xC3  # U+00C0-U+00FF are the characters with this first byte
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    after, before = np.r_[inside, False], np.r_[False, inside]
    starts, ends = np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))
    leads = np.r_[0, np.cumsum(lead)]
    points = ends - starts - (leads[ends] - leads[starts])
    long = points >= least
    starts, ends, points = starts[long], ends[long], points[long]
    row = np.searchsorted(offsets, starts, side="right") - 1
    data = LOWER[data]
    prefix = np.fromiter((zlib.crc32(f"{i}:".encode()) for i in ids), np.uint32, len(ids))
    size, crc = ends - starts, np.zeros(len(starts), np.uint32)
    short = size <= 64
    crc[short] = _crc(prefix[row[short]], data, starts[short], size[short])
    for i in np.flatnonzero(~short):
        crc[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(prefix[row[i]]))
    thin = crc % one_in == 0
    odd = []
    for i in np.flatnonzero(thin & (points > least)):
        word, at = data[starts[i] : ends[i]].tobytes().decode(), int(crc[i]) % int(points[i])
        odd.append(word[:at] + word[at + 1 :])
    mark = np.zeros(len(data) + 1, dtype=np.int8)
    mark[starts[~thin]] += 1
    mark[ends[~thin]] -= 1  # a run that begins there makes 0 of it again
    letters = data[np.cumsum(mark[:-1], dtype=np.int8) > 0]
    whole = pa.Array.from_buffers(pa.large_string(), int((~thin).sum()), [None, pa.py_buffer(np.r_[0, np.cumsum(size[~thin])].astype(np.int64)), pa.py_buffer(letters)])
    return pa.concat_arrays([whole, pa.array(odd, pa.large_string())])


def vocabulary(documents: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, one_in: int = ONE_IN) -> DataFrame:
    """(word, n) of the words of least_length code points or more that occur least_count times or more.

    documents has doc_id and text. A word is a maximal run of letters of ASCII or U+00C0-U+00FF, A-Z lowered. Where one_in divides
    the CRC-32 h of "doc_id:word", the word goes without its code point h % length. A null doc_id is written as nothing there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for a, b in chunks(offsets, CHUNK):
                counts = _runs(ids[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], least_length, one_in).value_counts()
                yield pa.RecordBatch.from_arrays([counts.field("values").cast(pa.string()), counts.field("counts")], names=["word", "n"])
            trim()

    found = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def dictionary(words: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST) -> dict[str, int]:
    """The frequent grams and how often they occur; at most DICTIONARY of them, so that they can be broadcast."""
    marked = F.concat(F.lit("^"), "word", F.lit("$"))
    grams = F.flatten(F.transform(F.sequence(F.lit(shortest), F.lit(longest)), lambda q: F.transform(
        F.when(F.length(marked) >= q, F.sequence(F.lit(1), F.length(marked) - q + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(marked, i, q))))
    counted = saved(words.select(F.explode(grams).alias("gram")).groupBy("gram").count().filter(F.col("count") > FREQUENT))
    steps = [FREQUENT << i for i in range(40)]
    sizes = counted.agg(*[F.count_if(F.col("count") > s).alias(str(s)) for s in steps]).first()
    bound = next(s for s in steps if sizes[str(s)] <= DICTIONARY)
    return {r["gram"]: r["count"] for r in counted.filter(F.col("count") > bound).toLocalIterator()}


def variable_grams(word: str, frequent: dict[str, int], longest: int, shortest: int = SHORTEST) -> tuple[list[str], int]:
    """The gram at each place of a word with marks at its ends, and how many of them an edit can affect at most."""
    marked = f"^{word}$"
    size = len(marked)
    grams, holds = [], [0] * (size + 1)
    for p in range(size - shortest + 1):
        end = p + shortest
        while end < size and end - p < longest and marked[p:end] in frequent:
            end += 1
        grams.append(marked[p:end])
        holds[p] += 1
        holds[end] -= 1
    most = now = 0
    for i in range(size - 1):  # the marks are never edited
        now += holds[i]
        if i and now > most:
            most = now
    return grams, most


def probes(word: str, frequent: dict[str, int], longest: int) -> list[str]:
    """The rarest grams of a word, one more than an edit can affect; a gram's second place makes another of it."""
    grams, most = variable_grams(word, frequent, longest)
    seen: dict[str, int] = {}
    numbered = []
    for g in grams:
        k = seen[g] = seen.get(g, 0) + 1
        numbered.append((frequent.get(g, 0), g if k == 1 else f"{g}{k}"))
    numbered.sort()
    return [g for _, g in numbered[: most + 1]]


def near_pairs(words: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(a, b, n_a, n_b), each pair of words that one inserted, deleted or replaced code point makes equal once, a before b.

    words are distinct, have n and least_length (2 or more) code points at least: a gram is no longer than the shorter word of a
    pair, so that an edit always leaves one. Lists of over HOT words are not paired; words of such a list meet where both are equal without
    a letter (or one is the other without it), which only near ones are.
    """
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast(dictionary(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 20_000):
                part = batch.slice(a, 20_000)
                row, keys = [], []
                for i, word in enumerate(part.column("word").to_pylist()):
                    own: dict[int, list[str]] = {}
                    for size in (len(word) - 1, len(word)):  # of the pair's shorter word
                        if size >= least_length:
                            longest = min(LONGEST, size)
                            if longest not in own:
                                own[longest] = probes(word, frequent, longest)
                            keys += [f"{size}{g}" for g in own[longest]]
                            row += [i] * len(own[longest])
                taken = part.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), taken.column("word"), taken.column("n")], names=["key", "word", "n"])

    lists = words.select("word", "n").mapInArrow(run, "key string, word string, n long")
    lists = saved(lists.select(F.xxhash64("key").alias("key"), "word", "n"))  # keys that collide only make a list longer
    hot = saved(lists.groupBy("key").count().filter(F.col("count") > HOT).select("key"))
    many = hot.count()
    cold = lists
    if many:
        small = F.broadcast(hot) if many <= BROADCAST_IDS else hot
        cold = lists.join(small, "key", "left_anti")
    other = cold.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"))
    pairs = cold.select("key", F.col("word").alias("a"), F.col("n").alias("n_a")).join(other, "key")
    pairs = pairs.filter((F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)).select("a", "b", "n_a", "n_b")
    if many:
        held = lists.join(small, "key", "left_semi").select("word", "n").distinct()
        pairs = pairs.union(_by_deletion(held))
    return pairs.distinct()


def _by_deletion(words: DataFrame) -> DataFrame:
    """near_pairs() of words by their deletion neighbours: a key's words differ in one letter at one place, so that no key has more than the letters there are."""
    places = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("place"))
    less = saved(places.select("word", "n", "place", F.concat(F.substring("word", F.lit(1), F.col("place") - 1), F.expr("substring(word, place + 1)")).alias("rest")))
    other = less.select("place", "rest", F.col("word").alias("b"), F.col("n").alias("n_b"))
    replaced = less.select("place", "rest", F.col("word").alias("a"), F.col("n").alias("n_a")).join(other, ["place", "rest"]).filter("a < b").select("a", "b", "n_a", "n_b")
    shorter = words.select(F.col("word").alias("rest"), F.col("n").alias("m"))
    cut = less.select("word", "n", "rest").join(shorter, "rest")
    first = F.col("word") < F.col("rest")
    return replaced.union(cut.select(F.least("word", "rest").alias("a"), F.greatest("word", "rest").alias("b"), F.when(first, F.col("n")).otherwise(F.col("m")), F.when(first, F.col("m")).otherwise(F.col("n"))))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of each word's chain, found by doubling the steps. Counts double along a chain, so it has no circle."""
    up = saved(forms.select("word", F.col("form").alias("root")))
    while True:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = saved(up.join(above, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = up.filter("moved").limit(1).count()
        up = up.select("word", "root")
        if not moved:
            return up


def variants(documents: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, one_in: int = ONE_IN) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of vocabulary().

    form is the near word of largest n (ties: smallest in code-point order) if that n is at least twice the word's, else null; root
    follows forms to the last. Null and empty texts have no words; repeated rows count each; texts and words of any length are
    taken whole; an empty table gives an empty result. Columns but doc_id and text are ignored.
    """
    words = saved(vocabulary(documents, least_length, least_count, one_in))
    pairs = saved(near_pairs(words, least_length))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).union(pairs.select("b", "a", "n_a"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    table = words.join(best, "word", "left")
    enough = -F.col("best.less") >= 2 * F.col("n")
    table = saved(table.select("word", F.when(enough, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, -F.col("best.less")).alias("form_n")))
    ends = roots(table.filter("form IS NOT NULL"))
    return table.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
