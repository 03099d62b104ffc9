"""Passages of held-out test items in a corpus.

Texts and items become sequences of words; windows of a passage's length run
over both.  A random walk (Chakraborty, Goldenberg and Koucky 2016) embeds each
window so that few edits of words become few differing places: at each step it
writes the word it stands on and moves on when that word's random bit for the
step says so.  A signature samples some of the places; windows that agree on
the signature of one of several repetitions are candidates, and an edit
distance over the words themselves decides.  Equal windows have equal
signatures in every repetition, so for exact passages one repetition finds all.

The items' signatures are sent to every task as sorted arrays, MOST_SIGNATURES at
a time: more items are searched for in blocks, each with a pass over the corpus,
so that their number changes the work but no result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

PASSAGE = 12
#: Signatures of items that go to every task at once: 16 bytes each.
MOST_SIGNATURES = 4_000_000
#: Steps of the walk for each word, and places of it that a signature takes: fewer where more edits are allowed.
STEPS, SAMPLED, LEAST_SAMPLED = 3, 8, 4
TARGET_RECALL = 0.95
#: Repetitions beyond which so many edits of so few words can't be searched for.
MOST_REPETITIONS = 1_000
#: Words that are embedded at once, and candidates that are compared at once.
BLOCK_WORDS, CANDIDATES = 1 << 18, 1 << 17

TAG = re.compile(r"<(?:[^\W\d_]|/)[^<>]*>")
#: The entities that stand for a character.
ENTITIES = {"&nbsp;": " ", "&quot;": '"', "&lt;": "<", "&gt;": ">", "&amp;": "&"}
ENTITY = re.compile("|".join(ENTITIES))
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Words of a text: runs of letters and digits after tags are blanked, entities read, NFKC and lower case."""
    if not text:
        return []
    if "<" in text:
        text = TAG.sub(" ", text)
    if "&" in text:
        text = ENTITY.sub(lambda m: ENTITIES[m.group()], text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return WORD.findall(text.lower())


class _Hashes(dict):
    """64 random bits of each word, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 20:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _scramble(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def signatures(hashes: np.ndarray, starts: np.ndarray, length: int, repetition: int, places: int = SAMPLED) -> np.ndarray:
    """Bit-sampled walk of each window of ``length`` words that begins at ``starts``."""
    steps = STEPS * length
    sampled = set(np.random.default_rng(7919 + repetition).permutation(steps)[:places].tolist())
    symbols = _scramble(hashes, repetition)
    at, limit = starts.copy(), starts + length
    out = np.full(len(starts), repetition, np.uint64)
    pad = np.uint64(0x5851F42D4C957F2D)
    for step in range(max(sampled) + 1):
        inside = at < limit
        symbol = np.where(inside, symbols[np.minimum(at, len(symbols) - 1)], pad)
        if step in sampled:
            out = (out ^ symbol) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(29)
        at += inside & ((symbol >> np.uint64(step % 64)) & np.uint64(1)).astype(bool)
    return out


def edit_distance(a: list[str], b: list[str], most: int) -> int:
    """Insertions, removals and changes of words that make ``b`` of ``a``, or ``most`` + 1 if they are more than that."""
    if a == b:
        return 0
    if most == 0 or abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def sampled_places(edits: int) -> int:
    return max(LEAST_SAMPLED, SAMPLED - edits)


def repetitions(edits: int, length: int, recall: float = TARGET_RECALL) -> int:
    """How many repetitions find a window within ``edits`` with at least that probability.

    The rate at which one repetition does is measured on random windows of which
    every edit replaces, removes or inserts a word.  ValueError where more than
    MOST_REPETITIONS would be needed.
    """
    if edits == 0:
        return 1
    rng = np.random.default_rng(17)
    pairs = []
    for _ in range(500):
        base = [int(x) for x in rng.integers(0, 2**63, length + edits)]
        other = base[:length]
        for _ in range(edits):
            k, kind = int(rng.integers(0, length)), int(rng.integers(0, 3))
            other = other[:k] + ([] if kind == 1 else [int(rng.integers(0, 2**63))]) + other[k + (kind != 2) :]
        pairs += base[:length] + (other + base[length:])[:length]
    both, starts = np.array(pairs, np.uint64), np.arange(0, len(pairs), length)
    hits = np.zeros(len(starts) // 2)
    for r in range(64):
        s = signatures(both, starts, length, r, sampled_places(edits))
        hits += s[::2] == s[1::2]
    # pairs differ in how easily they are found: the mean over them of the chance to be missed is to fall below 1 - recall
    rates = (hits + 0.5) / 65
    for n in range(1, MOST_REPETITIONS + 1):
        if np.mean((1 - rates) ** n) <= 1 - recall:
            return n
    raise ValueError(f"{edits} edits of {length} words need more than {MOST_REPETITIONS} repetitions")


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, list[list[str]]]]:
    """Texts as words, in blocks of about BLOCK_WORDS with the number of the first text."""
    first, block, size = 0, [], 0
    for k, text in enumerate(texts):
        words = words_of(text)
        block.append(words)
        size += len(words)
        if size >= BLOCK_WORDS:
            yield first, block
            first, block, size = k + 1, [], 0
    if block:
        yield first, block


def _windows(block: list[list[str]], length: int, known: _Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, the windows' starts, their texts and the texts' first words."""
    sizes = np.array([len(w) for w in block], np.int64)
    hashes = np.fromiter((known[w] for words in block for w in words), np.uint64, int(sizes.sum()))
    begins = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    owner = np.repeat(np.arange(len(block)), np.maximum(sizes - length + 1, 0))
    counts = np.maximum(sizes - length + 1, 0)
    within = np.arange(int(counts.sum())) - np.repeat(np.concatenate(([0], np.cumsum(counts)))[:-1], counts)
    return hashes, begins[owner] + within, owner, begins


def edit_distances(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """``edit_distance`` of each row of ``a`` to the row of ``b``, in the band of ``most`` around the diagonal."""
    n, length = a.shape
    if most == 0:
        return (a != b).any(axis=1).astype(np.int16)
    far = np.int16(most + 1)
    width = 2 * most + 1  # cell d of row i is column i + d - most
    row = np.full((width, n), far, np.int16)
    for d in range(most, width):
        row[d] = d - most
    for i in range(1, length + 1):
        above = row
        row = np.full((width, n), far, np.int16)
        for d in range(width):
            j = i + d - most
            if j < 0 or j > length:
                continue
            if j == 0:
                row[d] = i
                continue
            best = above[d] + (a[:, i - 1] != b[:, j - 1])
            if d + 1 < width:
                best = np.minimum(best, above[d + 1] + 1)
            if d:
                best = np.minimum(best, row[d - 1] + 1)
            row[d] = np.minimum(best, far)
    return row[most]


class ItemIndex:
    """Signatures of all items' windows, sorted, with the item and place of each."""

    def __init__(self, items: list[tuple[object, list[str]]], length: int, edits: int, times: int) -> None:
        self.length, self.edits, self.places = length, edits, sampled_places(edits)
        self.ids, self.words = [i for i, _ in items], [w for _, w in items]
        self.tables = []
        if any(len(w) >= length for w in self.words):
            self.hashes, self.starts, self.owner, self.begins = _windows(self.words, length, _Hashes())
            for r in range(times):
                s = signatures(self.hashes, self.starts, length, r, self.places)
                order = np.argsort(s, kind="stable")
                self.tables.append((s[order], order.astype(np.int32)))

    def search(self, block: list[list[str]], known: _Hashes) -> list[tuple[int, int, int]]:
        """(text of the block, item, edits) of those that share a passage, with the fewest edits found.

        Candidates are compared by the hashes of their words, many at once; what
        that accepts, by the words.
        """
        hashes, starts, owner, begins = _windows(block, self.length, known)
        found: dict[int, int] = {}  # text * items + item: edits
        along = np.arange(self.length)
        for r, (sorted_signatures, windows) in enumerate(self.tables):
            s = signatures(hashes, starts, self.length, r, self.places)
            low = np.searchsorted(sorted_signatures, s, side="left")
            hit = np.flatnonzero(sorted_signatures[np.minimum(low, len(sorted_signatures) - 1)] == s)
            counts = np.searchsorted(sorted_signatures, s[hit], side="right") - low[hit]
            ends = np.cumsum(counts)
            for first in range(0, int(ends[-1]) if len(ends) else 0, CANDIDATES):  # candidates are numbered through
                at = np.arange(first, min(first + CANDIDATES, int(ends[-1])))
                of = np.searchsorted(ends, at, side="right")
                k = hit[of]
                w = windows[low[k] + at - (ends[of] - counts[of])].astype(np.int64)
                pair = owner[k] * len(self.words) + self.owner[w]
                exact = np.sort(np.array([-1, *(p for p, n in found.items() if n == 0)], np.int64))
                fresh = exact[np.searchsorted(exact, pair, side="right") - 1] != pair  # nothing better can be found for the others
                k, w, pair = k[fresh], w[fresh], pair[fresh]
                n = edit_distances(self.hashes[self.starts[w][:, None] + along], hashes[starts[k][:, None] + along], self.edits)
                near = np.flatnonzero(n <= self.edits)
                near = near[np.lexsort((n[near], pair[near]))]
                for x in near.tolist():
                    p, edits = int(pair[x]), int(n[x])
                    if edits < found.get(p, self.edits + 1):
                        text, item = divmod(p, len(self.words))
                        i, j = int(self.starts[w[x]] - self.begins[item]), int(starts[k[x]] - begins[text])
                        if edit_distance(self.words[item][i : i + self.length], block[text][j : j + self.length], edits) == edits:
                            found[p] = edits
        return sorted((*divmod(p, len(self.words)), n) for p, n in found.items())


def leaked_items(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", passage: int = PASSAGE, edits: int = 0, most_signatures: int = MOST_SIGNATURES
) -> DataFrame:
    """``doc_id``, ``item_id`` and ``edits`` of each document that holds a passage of an item.

    A passage is ``passage`` consecutive words of the item, found in the
    document with at most ``edits`` edits of words within a window of the same
    length; the column says how few were found.  With no edits every passage is
    found, else at least TARGET_RECALL of them.  Null and empty texts and items
    of fewer words hold no passage.  A pair comes once, however often ids or
    passages repeat; null ids are ids.  Columns besides ids and text are ignored.
    ``most_signatures`` bounds what is broadcast at once, and changes no result.
    """
    schema = T.StructType([T.StructField("doc_id", documents.schema[doc_id].dataType), T.StructField("item_id", items.schema[item_id].dataType), T.StructField("edits", T.IntegerType())])
    pool = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    corpus = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    times = repetitions(edits, passage)
    # a word and what parts it from the next are two characters at least
    bound = (pool.agg(F.sum(F.length("text"))).first()[0] or 0) / 2 * times
    blocks = max(1, math.ceil(bound / most_signatures))
    of_block = F.pmod(F.xxhash64("text"), F.lit(blocks))
    out = None
    for k in range(blocks):
        mine = pool if blocks == 1 else pool.where(of_block == k)
        index = ItemIndex([(r.item_id, words_of(r.text)) for r in mine.collect()], passage, edits, times)
        found = _searched(corpus, index, schema)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def _searched(corpus: DataFrame, index: ItemIndex, schema: T.StructType) -> DataFrame:
    shared = corpus.sparkSession.sparkContext.broadcast(index)
    item_type = to_arrow_type(schema["item_id"].dataType)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = shared.value, _Hashes()
        for batch in batches:
            for first, block in _blocks(batch.column(1).to_pylist()):
                if pairs := index.search(block, known):
                    docs = batch.column(0).take(pa.array([first + t for t, _, _ in pairs], pa.int64()))
                    ids = pa.array([index.ids[i] for _, i, _ in pairs], item_type)
                    yield pa.RecordBatch.from_arrays([docs, ids, pa.array([n for _, _, n in pairs], pa.int32())], names=["doc_id", "item_id", "edits"])

    return corpus.mapInArrow(search, schema)
