"""Cost-balanced packing of tokenised documents into sequences."""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shutterlake.llm.common import Memory, byte_chunks, map_arrow, narrow

#: Cost of a piece of n tokens: LINEAR * n + n * n, in units of one pair of tokens.
LINEAR = 4096
#: Tokens that are packed together; bounds what a task holds, and leaves less than one sequence of padding each time.
WINDOW = 1 << 20
#: Parts whose ids a worker remembers in each of two generations, and bytes of the longest such part.
CACHE_PARTS, CACHE_BYTES = 400_000, 64
#: Text that is encoded at once, and parts that are encoded in one call.
CHUNK_BYTES, CALL = 4_000_000, 4096

#: White space beyond ASCII: a text that holds any isn't cut into parts.
_ODD = "[\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# Classes of bytes: 0 white space, 1 letter, 2 digit, 3 other, 4 part of a character beyond ASCII, 5 apostrophe.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[:128] = [0 if c in b"\t\n\x0b\x0c\r " else 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 5 if c == 39 else 3 for c in range(128)]
#: Whether a part may begin between two bytes of these classes: before white space, and between plain characters of unlike kinds.
_CUT = np.zeros((6, 6), bool)
_CUT[1:, 0] = True
for _a, _b in ((1, 2), (1, 3), (1, 5), (2, 1), (2, 3), (2, 5), (3, 1), (3, 2)):
    _CUT[_a, _b] = True
_CUT_BYTES = _CUT[_CLASS[:, None], _CLASS[None, :]].ravel()


class PartTokenizer:
    """The ids of a byte-level BPE tokenizer, part by part: equal parts are encoded once.

    The tokenizer's own pattern ends a match wherever white space follows something visible, and where letters, digits
    and other marks meet (an apostrophe may begin a match with the letters after it). A match looks ahead only past
    white space, and a run of white space is never cut, so a text may be cut there without a change of its ids. The ids
    of other tokenizers, which may join what is parted here, are refused. Special tokens' strings aren't cut.
    """

    def __init__(self, path: str, end_id: int) -> None:
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        before = kind.get("pre_tokenizer") or {}
        if kind.get("normalizer") or kind.get("truncation") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("only byte-level tokenizers with the usual pattern, and nothing before it, are cut into parts")
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = Memory(CACHE_PARTS, CACHE_BYTES)
        self.end = np.array([end_id], "<u4").tobytes()

    def encode(self, texts: pa.Array) -> tuple[memoryview, np.ndarray]:
        """The ids of all texts, each with the end id, as little-endian unsigned 32-bit numbers; where each text's begin, in bytes."""
        texts = texts.cast(pa.string())
        whole = pc.match_substring_regex(texts, _ODD)
        for s in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, s))
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        new = np.zeros(len(raw) + 1, bool)
        if len(raw):
            new[1:-1] = _CUT_BYTES[(raw[:-1].astype(np.uint16) << 8) | raw[1:]]
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)):
            new[at[i] : at[i + 1]] = False
        new[at[:-1]] = True
        start = np.flatnonzero(new[:-1])
        cut = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.append(start, len(raw)).astype(np.int32)), pa.py_buffer(raw)])
        found = cut.dictionary_encode()
        ids = self.known.all(found.dictionary.to_pylist(), self._ids)
        last = np.searchsorted(start, at[1:])
        order = np.insert(found.indices.to_numpy(), last, len(ids))  # the end id after each text's last part
        out = pa.array([*ids, self.end], pa.large_binary()).take(pa.array(order))
        first = np.append(0, last + np.arange(1, len(texts) + 1))
        return memoryview(out.buffers()[2] or b""), np.frombuffer(out.buffers()[1], np.int64)[first]

    def _ids(self, parts: list[bytes]) -> list[bytes]:
        out = []
        for k in range(0, len(parts), CALL):
            for e in self.tokenizer.encode_batch_fast([p.decode() for p in parts[k : k + CALL]], add_special_tokens=False):
                out.append(np.array(e.ids, "<u4").tobytes())
        return out


_LOADED: dict[tuple[str, int], PartTokenizer] = {}


def _tokenizer(path: str, end_id: int) -> PartTokenizer:
    if (path, end_id) not in _LOADED:
        _LOADED[path, end_id] = PartTokenizer(path, end_id)
    return _LOADED[path, end_id]


def cost(n: int) -> int:
    return LINEAR * n + n * n


def pack(sizes: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece, for documents of the given numbers of tokens.

    Documents are cut after each full sequence; what is left of them is assigned by descending cost to the sequence of
    the lowest cost that has room. If none has, the piece is cut to the room of the lowest-cost sequence with any. There
    are as few sequences as the tokens allow.
    """
    out, rest, sequence = [], [], 0
    for d, n in enumerate(sizes):
        full = n // capacity
        for k in range(full):
            out.append((d, k * capacity, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rest.append((n % capacity, d, full * capacity))
    count = -(-sum(n for n, _, _ in rest) // capacity)
    heap = [(0, sequence + i, 0) for i in range(count)]  # cost, sequence, tokens
    room = [(-capacity, sequence + i) for i in range(count)]  # largest first; entries of other tokens than used are old
    used = {sequence + i: 0 for i in range(count)}
    for n, d, start in sorted(rest, key=lambda x: (-x[0], x[1])):
        while n:
            while room[0][0] != used[room[0][1]] - capacity:
                heapq.heappop(room)
            aside = []
            if -room[0][0] >= n:
                while heap[0][2] + n > capacity:
                    aside.append(heapq.heappop(heap))
            c, s, had = heapq.heappop(heap)
            put = min(n, capacity - had)
            out.append((d, start, put, s, had))
            for x in aside:
                heapq.heappush(heap, x)
            used[s] = had + put
            if had + put < capacity:
                heapq.heappush(heap, (c + cost(put), s, had + put))
                heapq.heappush(room, (had + put - capacity, s))
            start, n = start + put, n - put
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are the tokenizer's and then end_id; each id lies in one piece. Every task packs its own rows, a
    window of about WINDOW tokens at a time, without a shuffle; sequence_id holds the partition in its upper bits. Each
    window leaves less than one sequence of padding. The same files, split the same way, give the same sequences. A null
    or empty text is the end id alone; repeated rows are packed each; a document of any length is cut; empty tables give
    no rows. Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _tokenizer(tokenizer_path, end_id)
        base, kind = TaskContext.get().partitionId() << 40, None
        ids, coded, held = [], [], 0

        def give() -> pa.RecordBatch:
            nonlocal base
            pieces = pack([len(c) // 4 for c in coded], capacity)
            d = np.array([p[0] for p in pieces], np.int64)
            crc = [zlib.crc32(coded[p[0]][4 * p[1] : 4 * (p[1] + p[2])]) for p in pieces]
            sizes = np.array([len(c) // 4 for c in coded], np.int64)
            cols = [pa.array([p[j] for p in pieces], pa.int64()) for j in (1, 2)] + [pa.array(crc, pa.int64()), pa.array(sizes[d]), pa.array([base + p[3] for p in pieces], pa.int64()), pa.array([p[4] for p in pieces], pa.int64())]
            base += 1 + max(p[3] for p in pieces)
            return pa.RecordBatch.from_arrays([pa.array(ids, kind).take(pa.array(d)), *cols], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for b in byte_chunks(batches, "text", CHUNK_BYTES):
            kind = b.column(0).type
            raw, at = coder.encode(b.column(1).fill_null(""))
            ids += b.column(0).to_pylist()
            coded += [raw[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            held += len(raw) // 4
            if held >= WINDOW:
                yield give()
                ids, coded, held = [], [], 0
        if ids:
            yield give()

    rows = narrow(docs, id=id_col, text=F.col(f"`{text_col}`").cast("string"))
    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
