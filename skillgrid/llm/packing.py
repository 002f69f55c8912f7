"""Hierarchical multi-length packing of tokenised documents.

A document's ids are cut into whole windows of the longest context and a remainder. The remainder
is routed to the smallest context tier (a power of two) that holds it. Tiers are packed from the
longest down: a window takes one item of its own tier, its gap is filled with the largest fitting
items of shorter tiers, and what is still open is closed with a cut of the next item. Only at the
end of a batch can a window stay open; its items are cut into power-of-two sequences. So every
sequence is exactly full, whatever the input. Sequences of a tier are dealt to step groups of an
equal number of tokens.

Packing is local to an Arrow batch: no shuffle, bounded memory, and a lost task repeats exactly.
"""

from __future__ import annotations

import bisect
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How byte-level vocabularies write the bytes of a text as letters: printable Latin-1 as it is, the other bytes from U+0100 on.
_BYTE_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
Piece = tuple[int, int, int]  # item, start in the item, length


def route(length: int, tiers: list[int]) -> int:
    """The smallest tier that holds ``length`` ids; ``tiers`` ascend."""
    return tiers[bisect.bisect_left(tiers, length)]


class _Shelf:
    """Items (length, item, start) of one tier in order of length."""

    def __init__(self, items: list[tuple[int, int, int]]):
        self.items = sorted(items)

    def pop_fitting(self, room: int):
        at = bisect.bisect_right(self.items, (room, 1 << 62, 0)) - 1
        return self.items.pop(at) if at >= 0 else None


def pack(lengths: np.ndarray, context: int = 4096, smallest: int = 256) -> list[tuple[int, list[Piece]]]:
    """Sequences (size, pieces) of documents with these numbers of ids. Every size is ``context`` or a power of two."""
    if context & (context - 1) or smallest & (smallest - 1) or not 0 < smallest <= context:
        raise ValueError("context and smallest tier must be powers of two")
    tiers = [1 << b for b in range(smallest.bit_length() - 1, context.bit_length())]
    out: list[tuple[int, list[Piece]]] = []
    rest: dict[int, list] = {t: [] for t in tiers}
    for item, n in enumerate(np.asarray(lengths).tolist()):
        full = n - n % context
        out += [(context, [(item, at, context)]) for at in range(0, full, context)]
        if n > full:
            rest[route(n - full, tiers)].append((n - full, item, full))
    shelves = {t: _Shelf(v) for t, v in rest.items()}

    for top in range(len(tiers) - 1, -1, -1):
        tier, own = tiers[top], shelves[tiers[top]]
        while own.items:
            n, item, start = own.items.pop()
            pieces, room = [(item, start, n)], tier - n
            for lower in range(top if tier == smallest else top - 1, -1, -1):  # whole items that fit, longest first
                while room and (found := shelves[tiers[lower]].pop_fitting(room)):
                    pieces.append((found[1], found[2], found[0]))
                    room -= found[0]
            if room:  # cut the shortest item that is left, of the shortest tier that has one
                source = next((shelves[t] for t in tiers[: top + 1] if shelves[t].items), None)
                if source:
                    n, item, start = source.items.pop(0)
                    pieces.append((item, start, room))
                    left = n - room
                    bisect.insort(shelves[route(left, tiers)].items, (left, item, start + room))
                    room = 0
            out += [(tier, pieces)] if not room else _halve(pieces)
    return out


def _halve(pieces: list[Piece]) -> list[tuple[int, list[Piece]]]:
    """Cut an open window into sequences whose sizes are its length's powers of two."""
    out, queue, total = [], list(pieces), sum(p[2] for p in pieces)
    for bit in range(total.bit_length() - 1, -1, -1):
        if not (size := total & (1 << bit)):
            continue
        own, room = [], size
        while room:
            item, start, n = queue[0]
            take = min(n, room)
            own.append((item, start, take))
            queue[0:1] = [(item, start + take, n - take)] if n > take else []
            room -= take
        out.append((size, own))
    return out


def step_groups(sizes: list[int], step_tokens: int) -> list[int]:
    """A step for each sequence: steps hold sequences of one size and ``step_tokens`` ids; what is left shares steps."""
    group, fill, spare = [0] * len(sizes), {}, []
    members: dict[int, list[int]] = {}
    step = 0
    for k, size in enumerate(sizes):
        members.setdefault(size, []).append(k)
        fill[size] = fill.get(size, 0) + size
        if fill[size] >= step_tokens:
            for m in members.pop(size):
                group[m] = step
            step, fill[size] = step + 1, 0
    spare = sorted((k for v in members.values() for k in v), key=lambda k: -sizes[k])
    total = 0
    for k in spare:
        if total + sizes[k] > step_tokens:
            step, total = step + 1, 0
        group[k] = step
        total += sizes[k]
    return group


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class ChunkIds:
    """Ids of text between ASCII white space. For a vocabulary that drops white space these make up the text's ids.

    A chunk of lower-case Latin-1 letters, digits and ASCII signs without an apostrophe is cut into its
    words here and given to the vocabulary's model directly; every other chunk, and every chunk of a
    vocabulary that doesn't agree with that on some trials, goes through the whole tokenizer.
    Known chunks are kept in two tables: when the young one is full it becomes the old one, and
    what is met again moves back.
    """

    PLAIN = re.compile("[a-z0-9!-&(-/:-@[-`{-~\u00df-\u00f6\u00f8-\u00ff]+")
    WORDS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
    TRIALS = ("word", "the", "gr\u00fc\u00dfe", "d\u00e9j\u00e0", "a1b22", "(x_y)...", "e-mail:", "***", "12", "\u00e0\u00ed\u00ff\u00f0")

    def __init__(self, path: str, most: int = 500_000):
        self.tokenizer, self.most, self.young, self.old = _tokenizer(path), most, {}, {}
        self.model, self.words = self.tokenizer.model, {}
        self.plain = all(list(np.frombuffer(self._cut(t), np.uint32)) == self.tokenizer.encode(t, add_special_tokens=False).ids for t in self.TRIALS)

    @staticmethod
    def _chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """What stands between white space: where each text's chunks begin and end, the number of each chunk, and the different chunks.

        The vocabulary lower-cases, so A-Z are lower-cased first to make fewer different chunks.
        Text that may name special tokens stays as it is.
        """
        special = pc.match_substring(texts, "<|")
        found = pc.ascii_split_whitespace(pc.if_else(special, texts, pc.ascii_lower(texts)))
        known = found.flatten().dictionary_encode()
        bounds = found.offsets.to_numpy()
        _, ends, data = known.dictionary.cast(pa.binary()).buffers()
        ends, data = np.frombuffer(ends, np.int32, len(known.dictionary) + 1).tolist() if ends else [0], data.to_pybytes() if data else b""
        return bounds - bounds[0], known.indices.to_numpy(), [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _cut(self, text: str) -> bytes:
        out = []
        for word in self.WORDS.findall(text):
            ids = self.words.get(word)
            if ids is None:
                if len(self.words) >= self.most // 2:
                    self.words.clear()
                seen = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LETTERS)
                ids = self.words[word] = array("I", [t.id for t in self.model.tokenize(seen)]).tobytes()
            out.append(ids)
        return out[0] if len(out) == 1 else b"".join(out)

    def _encode(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each chunk."""
        texts = [c.decode() for c in chunks]
        match = self.PLAIN.fullmatch
        plain = [self.plain and "<|" not in t and match(t) is not None for t in texts]
        rest = iter(self.tokenizer.encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        return [self._cut(t) if p else array("I", next(rest).ids).tobytes() for t, p in zip(texts, plain, strict=True)]

    def _look_up(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of different chunks. Those seen before are looked up; new ones are tokenised together."""
        each = list(map(self.young.get, chunks))
        new = [c for c, ids in zip(chunks, each, strict=True) if ids is None]
        if len(self.young) + len(new) > self.most:
            self.old, self.young = self.young, {}
            each, new = [None] * len(chunks), chunks
        found = dict(zip(new, map(self.old.get, new), strict=True))
        order = [c for c, ids in found.items() if ids is None]
        for at in range(0, len(order), 20_000):
            part = order[at : at + 20_000]
            found.update(zip(part, self._encode(part), strict=True))
        self.young.update(found)
        return [found[c] if ids is None else ids for c, ids in zip(chunks, each, strict=True)]

    def of(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        """Ids of each text, none of which is null."""
        bounds, codes, chunks = self._chunks(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        each = self._look_up(chunks)
        flat = np.frombuffer(b"".join(each), np.uint32)
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        begins, lengths = (np.cumsum(sizes) - sizes)[codes], sizes[codes]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = flat[np.repeat(begins - ends[:-1], lengths) + np.arange(ends[-1])]
        cuts = ends[bounds]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(maxsize=1)
def chunk_ids(path: str) -> ChunkIds:
    """The cache of a Python worker, which later tasks of the worker find filled."""
    return ChunkIds(path)


def pack_documents(docs: DataFrame, tokenizer: str, *, context: int = 4096, smallest: int = 256, end_id: int = 2, step_tokens: int = 65536, batch_ids: int = 4_000_000) -> DataFrame:
    """Pieces of packed sequences: ``doc_id, start, length, ids`` (little-endian uint32), ``doc_tokens,
    sequence_id, offset, sequence_length, step_group``.

    ``tokenizer`` is a ``tokenizers`` file whose vocabulary drops white space. A null or empty text
    is the end id alone. Rows that repeat are packed as often; a null doc_id stays null; an empty
    table gives no row. A task holds about ``batch_ids`` ids, and cuts
    about 4 MB of text, or one longer document, at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = chunk_ids(tokenizer), TaskContext.get().partitionId()
        sequence, step = part << 33, part << 33
        docs_now, ids_now, total = [], [], 0

        def flush():
            nonlocal sequence, step
            packed = pack(np.array([len(x) for x in ids_now], np.int64), context, smallest)
            groups = step_groups([size for size, _ in packed], step_tokens)
            rows = []
            for (size, pieces), group in zip(packed, groups, strict=True):
                offset = 0
                for item, start, n in pieces:
                    rows.append((docs_now[item], start, n, ids_now[item][start : start + n].tobytes(), len(ids_now[item]), sequence, offset, size, step + group))
                    offset += n
                sequence += 1
            step += max(groups, default=-1) + 1
            for at in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(zip(*rows[at : at + 20_000], strict=True), types, strict=True)], names)

        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            block = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) >> 22
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
            for at, end in zip(cuts[:-1], cuts[1:], strict=True):
                for doc, ids in zip(batch.column("doc_id").slice(at, end - at).to_pylist(), encode.of(texts.slice(at, end - at)), strict=True):
                    docs_now.append(doc)
                    ids_now.append(np.append(ids, np.uint32(end_id)).astype("<u4"))
                    total += len(ids) + 1
                    if total >= batch_ids:
                        yield from flush()
                        docs_now, ids_now, total = [], [], 0
        if docs_now:
            yield from flush()

    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long, step_group long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
