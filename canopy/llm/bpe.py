"""Byte-pair encoding as a bounded-lookahead streaming transducer, and its inverse.

A sequence of tokens is the encoding of its bytes exactly when each two
neighbours encode to themselves.  The last token of every prefix follows from
that in one pass over the bytes.  A token is final as soon as it ends at least
the merge list's *sufficient lookahead* before the last byte read, so a text of
any length is encoded in constant memory besides its output.

The sufficient lookahead is computed from the merges.  Two texts with a common
beginning are cut alike up to where a merge crosses into the part that differs.
When the merge ``u v`` moves that place to the left, by the length of ``u``, a
later merge ``u' v'`` can move it on only if the token ``v'`` starts with the
token ``u``.  The longest such chain of ascending ranks bounds the way.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed value: the pattern that parts text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A piece of text of more characters is encoded block by block.
BLOCK = 1 << 12
#: Texts of more characters are read slice by slice.
SLICE = 1 << 16
#: Pieces and pairs remembered by a worker.
REMEMBERED = 1 << 18
#: Ids in a result batch, besides the last text's.
BATCH_IDS = 1 << 20
CLASSES = tuple(regex.compile(p) for p in (r"\p{L}+", r"\p{N}+", r"\s+", r"[^\s\p{L}\p{N}]+"))
SPACES = CLASSES[2]
#: A match that ends nearer than this to the end of what was read can still change: 'll needs two characters more.
UNSETTLED = 3


@dataclass
class MergeList:
    """The vocabulary of a byte-level BPE; a token's rank is its id and the rank of its merge."""

    ranks: dict[bytes, int]
    tokens: dict[int, bytes] = field(init=False)
    longest: int = field(init=False)
    pairs: dict[tuple[int, int], bool] = field(init=False, default_factory=dict)
    pieces: dict[str, list[int]] = field(init=False, default_factory=dict)

    def __post_init__(self) -> None:
        self.tokens = {i: b for b, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))

    @classmethod
    def parse(cls, content: bytes) -> MergeList:
        """Of a file with a base64 token and its rank in each line."""
        return cls({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)})

    def merge(self, piece: bytes, below: int | None = None) -> list[bytes]:
        """The piece after all merges, or those of rank less than ``below``, by definition: always the first of lowest rank."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            found = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None and (below is None or r < below)]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def halves(self) -> dict[int, tuple[int, int]]:
        """Of every token that a merge makes, the two tokens that it joins."""
        out = {}
        for token, rank in self.ranks.items():
            if len(token) > 1 and len(parts := self.merge(token, rank)) == 2:
                out[rank] = self.ranks[parts[0]], self.ranks[parts[1]]
        return out

    def sufficient_lookahead(self) -> int:
        """Bytes before the end of what was read that later bytes can still cut otherwise, at most."""
        halves = self.halves()
        moved: dict[int, int] = {}  # by token u: the longest way of a chain that ends with a merge of u
        for rank in sorted(halves):
            u, v = halves[rank]
            way, token = 0, v
            while True:
                way = max(way, moved.get(token, 0))
                if token not in halves:
                    break
                token = halves[token][0]
            moved[u] = max(moved.get(u, 0), len(self.tokens[u]) + way)
        return max([1, *moved.values()])

    def compatible(self, a: int, b: int) -> bool:
        """Whether two tokens side by side encode to themselves."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            left, right = self.tokens[a], self.tokens[b]
            known = self.pairs[a, b] = self.merge(left + right) == [left, right]
        return known


class BytesTransducer:
    """Encodes one piece, fed in blocks of bytes."""

    def __init__(self, merges: MergeList, lookahead: int) -> None:
        self.merges, self.lookahead = merges, lookahead
        self.bytes = b""
        self.last: list[int] = [-1]  # the last token of the encoding up to each byte; -1: the beginning

    def feed(self, block: bytes) -> list[int]:
        """The ids that became final."""
        m, ranks, last = self.merges, self.merges.ranks, self.last
        known = len(self.bytes)
        self.bytes += block
        data = self.bytes
        for end in range(known + 1, len(data) + 1):
            for begin in range(max(0, end - m.longest), end):
                token = ranks.get(data[begin:end])
                if token is not None and (last[begin] < 0 or m.compatible(last[begin], token)):
                    last.append(token)
                    break
            else:  # every byte is a token and every text has an encoding
                raise AssertionError("the vocabulary lacks a byte")
        return self._emit(len(data) - self.lookahead)

    def finish(self) -> list[int]:
        return self._emit(len(self.bytes))

    def _emit(self, until: int) -> list[int]:
        """Ids of the tokens that end at ``until`` at the latest, which are forgotten."""
        ids, ends, end = [], [], len(self.bytes)
        while end > 0:
            ids.append(self.last[end])
            ends.append(end)
            end -= len(self.merges.tokens[self.last[end]])
        final = [(i, e) for i, e in zip(reversed(ids), reversed(ends), strict=True) if e <= until]
        if not final:
            return []
        cut = final[-1][1]
        self.bytes, self.last = self.bytes[cut:], [final[-1][0], *self.last[cut + 1 :]]
        return [i for i, _ in final]


class TextTransducer:
    """Encodes a text fed in slices; holds back what later slices could still change."""

    def __init__(self, merges: MergeList, lookahead: int) -> None:
        self.merges, self.lookahead, self.pattern = merges, lookahead, _pattern()
        self.held = ""
        self.run: tuple[BytesTransducer, regex.Pattern] | None = None  # a piece that is longer than a block

    def piece(self, text: str) -> list[int]:
        ids = self.merges.pieces.get(text)
        if ids is None:
            if (token := self.merges.ranks.get(raw := text.encode())) is not None:
                ids = [token]
            else:
                t = BytesTransducer(self.merges, self.lookahead)
                ids = [i for k in range(0, len(raw), BLOCK) for i in t.feed(raw[k : k + BLOCK])] + t.finish()
            if len(text) <= 64:
                if len(self.merges.pieces) >= REMEMBERED:
                    self.merges.pieces.clear()
                self.merges.pieces[text] = ids
        return ids

    def feed(self, text: str, final: bool = False) -> Iterator[int]:
        """The ids that became final; all that are left with ``final``."""
        self.held += text
        while True:
            if self.run:
                transducer, kind = self.run
                end = m.end() if (m := kind.match(self.held)) else 0
                over = end < len(self.held) or final
                if end and kind is SPACES and end < len(self.held):
                    end -= 1  # the last blank goes with what follows
                elif not over:
                    end -= 1
                for k in range(0, max(end, 0), BLOCK):
                    yield from transducer.feed(self.held[k : min(k + BLOCK, end)].encode())
                self.held = self.held[max(end, 0) :]
                if not over:
                    return
                yield from transducer.finish()
                self.run = None
            at = 0
            for m in self.pattern.finditer(self.held):
                if not final and m.end() > len(self.held) - UNSETTLED:
                    break
                yield from self.piece(m.group())
                at = m.end()
            self.held = self.held[at:]
            if final or len(self.held) <= BLOCK:
                return
            start = 1 if self.held[0] == " " and self.held[1] != " " and not SPACES.match(self.held[1]) else 0
            kind = next(c for c in CLASSES if c.match(self.held[start]))
            transducer = BytesTransducer(self.merges, self.lookahead)
            if start:
                yield from transducer.feed(b" ")
                self.held = self.held[1:]
            self.run = transducer, kind


class TextDecoder:
    """Incremental state machine from ids to text; bytes of an unfinished character wait for the next id."""

    def __init__(self, merges: MergeList) -> None:
        self.tokens, self.machine = merges.tokens, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, identifier: int) -> str:
        return self.machine.decode(self.tokens[identifier])

    def finish(self) -> str:
        return self.machine.decode(b"", True)


_patterns: list[regex.Pattern] = []
_loaded: dict[int, tuple[MergeList, int]] = {}


def _pattern() -> regex.Pattern:
    if not _patterns:
        _patterns.append(regex.compile(PATTERN))
    return _patterns[0]


def _load(content: bytes) -> MergeList:
    key = hash(content)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = MergeList.parse(content)
    return _loaded[key]


def encode_text(merges: MergeList, lookahead: int, text: str | None) -> list[int]:
    """Ids of the text; none for a null and an empty one."""
    if not text:
        return []
    t = TextTransducer(merges, lookahead)
    if len(text) <= SLICE:
        return list(t.feed(text, final=True))
    ids = [i for k in range(0, len(text), SLICE) for i in t.feed(text[k : k + SLICE])]
    return ids + list(t.feed("", final=True))


def _shared(df: DataFrame, vocabulary: str):
    """The vocabulary file's bytes (fixed, under 1 MB) for every executor, and the lookahead."""
    with open(vocabulary, "rb") as f:
        content = f.read()
    if len(content) > 32 << 20:
        raise ValueError("the vocabulary is too large to broadcast")
    return df.sparkSession.sparkContext.broadcast((content, MergeList.parse(content).sufficient_lookahead()))


def encode(df: DataFrame, identifier: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``identifier`` and ``ids`` of every row: its text's tokens, without special ones.

    Strings that look like special tokens are ordinary text.  A null and an
    empty text give an empty list.  Rows are kept as they are, repeated ones
    too; other columns are dropped.  A narrow map: no shuffle.
    """
    shared = _shared(df, vocabulary)
    schema = T.StructType([df.schema[identifier], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content, lookahead = shared.value
        merges = _load(content)

        def pack(begin: int, end: int) -> pa.RecordBatch:
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            array = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
            return pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), array], names=[identifier, "ids"])

        for batch in batches:
            lists: list[np.ndarray] = []
            begin = size = 0
            for k, value in enumerate(batch.column(1)):
                lists.append(np.array(encode_text(merges, lookahead, value.as_py()), np.int32))
                size += len(lists[-1])
                if size >= BATCH_IDS:
                    yield pack(begin, k + 1)
                    lists, begin, size = [], k + 1, 0
            if lists:
                yield pack(begin, batch.num_rows)

    return df.select(identifier, text).mapInArrow(run, schema)


def decode(df: DataFrame, identifier: str = "doc_id", ids: str = "ids", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``identifier`` and the ``text`` that the ids stand for; a null list gives null, an empty one an empty text."""
    shared = _shared(df, vocabulary)
    schema = T.StructType([df.schema[identifier], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _load(shared.value[0])
        for batch in batches:
            texts = []
            for value in batch.column(1).to_pylist():
                if value is None:
                    texts.append(None)
                    continue
                d = TextDecoder(merges)
                texts.append("".join(map(d.feed, value)) + d.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[identifier, "text"])

    return df.select(identifier, ids).mapInArrow(run, schema)
