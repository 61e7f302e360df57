"""BPE encoding with a prefix table: the last token of each prefix's encoding, by automaton matches and pair tests.

The encoding of a text's prefix always ends in one and the same token, whatever follows, as long as the text is cut
where no token can reach across. So the last tokens of all prefixes are found from left to right: of the tokens that
end at a place, the one that may follow the last token of the prefix before it. Ids are read off backwards.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import Memory, byte_chunks, map_arrow, narrow

SPACE = "▁"
#: Parts whose encoding a worker remembers in each of two generations, and bytes of the longest such part.
CACHE_PARTS, CACHE_BYTES = 400_000, 64
#: Text that is encoded at once.
CHUNK_BYTES = 4_000_000
#: Texts on which the model must agree with the library before it is used: the normalisation that is taken for granted.
PROBES = ["", " ", "a", " a  b ", "\tx\ny\r\n", "Ünï ﬁ ½ ＡＢ", "e\u0301 \u00a0 \u3000 x", "▁ ▁▁a", "漢字 \U0001f600", "x\x00y"]


class PrefixTableBpe:
    """The encoder and decoder of one sentencepiece BPE model with byte fallback, identity normalisation and a dummy prefix.

    A text is cut wherever no piece holds the two adjacent bytes: no token reaches across such a place, so each part is
    encoded for itself, and equal parts once. Other models are refused.
    """

    def __init__(self, model_path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.score, self.byte_id = {}, {}
        for i, p in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.score[p] = (model.get_score(i), i)
        self.control = {i for i in range(len(self.pieces)) if model.is_control(i)}
        self.unknown = model.unk_id()
        self.byte_of = {i: v for v, i in self.byte_id.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece reaches across a word boundary")
        self.matches = ahocorasick.Automaton()
        for p in self.score:
            self.matches.add_word(p, (len(p), p))
        self.matches.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        self.known = Memory(CACHE_PARTS, CACHE_BYTES)
        joins = np.zeros((256, 256), bool)
        joins[:, 0x80:0xC0] = True  # inside a character
        for p in self.score:
            raw = np.frombuffer(p.replace(SPACE, " ").encode(), np.uint8)
            joins[raw[:-1], raw[1:]] = True
        self.joins = joins.ravel()
        if len(self.byte_id) < 256 or any(self.encode(t) != model.encode(t) or self.decode(model.encode(t)) != model.decode(model.encode(t)) for t in PROBES):
            raise ValueError("the model lacks byte fallback, or doesn't take texts as they are with a dummy prefix")

    def merge(self, text: str) -> list[str]:
        """The definition: join the adjacent pair that makes the best-scored piece, the leftmost of equals, until none is left."""
        parts: list[str | None] = list(text)
        after = [*range(1, len(parts)), -1]
        before = [*range(-1, len(parts) - 1)]
        heap = [(-self.score[x][0], i, x) for i in range(len(parts) - 1) if (x := text[i : i + 2]) in self.score]
        heapq.heapify(heap)
        while heap:
            _, i, made = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else -1
            if j < 0 or parts[i] + parts[j] != made:
                continue
            parts[i], parts[j], after[i] = made, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (x := parts[a] + parts[b]) in self.score:
                    heapq.heappush(heap, (-self.score[x][0], a, x))
        return [p for p in parts if p is not None]

    def may_follow(self, left: str, right: str) -> bool:
        """Whether the encoding of the two tokens' text is the two tokens; left is empty at a word's start."""
        known = self.fits.get((left, right))
        if known is None:
            known = self.merge(left + right) == ([left, right] if left else [right])
            if len(self.fits) < 500_000:
                self.fits[left, right] = known
        return known

    def split(self, part: str) -> list[str]:
        """The tokens of a part; single characters stand for unknown ones.

        The prefix table: last[i] is the unique last token of the first i characters' encoding.
        """
        last: list[str | None] = [None] * (len(part) + 1)
        last[0] = ""
        fits = self.fits
        for i, (n, token) in self.matches.iter(part):
            if last[i + 1] is None:
                left = last[i + 1 - n]
                if left is None:  # the character before is no piece
                    left = last[i + 1 - n] = part[i - n]
                ok = fits.get((left, token))
                if ok or ok is None and self.may_follow(left, token):
                    last[i + 1] = token
        out, i = [], len(part)
        while i:
            token = last[i] or part[i - 1]
            out.append(token)
            i -= len(token)
        return out[::-1]

    def ids(self, part: str) -> list[int]:
        out: list[int] = []
        for t in self.split(part):
            known = self.score.get(t)
            if known:
                out.append(known[1])
            else:
                out += [self.byte_id[b] for b in t.encode("utf-8")]
        return out

    def decode(self, ids: list[int], first: bool = True) -> str:
        """The text of ids: pieces joined, byte runs as UTF-8 with one replacement for each wrong byte.

        One leading space is dropped, unless these ids aren't a text's first.
        """
        out: list[str] = []
        held = bytearray()

        def flush() -> None:
            at = 0
            while at < len(held):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(held[at : at + n]).decode("utf-8"))
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            held.clear()

        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                first = False
                continue
            flush()
            if i in self.control:
                continue
            p = " ⁇ " if i == self.unknown else self.pieces[i].replace(SPACE, " ")
            out.append(p[1:] if first and p.startswith(" ") else p)
            first = False
        flush()
        return "".join(out)

    def parts(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The distinct parts of all texts with where they stand, in order, and each text's first part with the end."""
        texts = texts.cast(pa.string())
        marked = pc.binary_join_element_wise(pa.scalar(""), pc.replace_substring(texts, SPACE, " "), " ")
        marked = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", marked)
        at = np.frombuffer(marked.buffers()[1], np.int32)[marked.offset : marked.offset + len(marked) + 1]
        raw = np.frombuffer(marked.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        new = np.zeros(len(raw) + 1, bool)
        if len(raw):
            new[1:-1] = ~self.joins[(raw[:-1].astype(np.uint16) << 8) | raw[1:]]
        new[at[:-1]] = True
        start = np.flatnonzero(new[:-1])
        ends = np.append(start, len(raw)).astype(np.int32)
        cut = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
        return cut.dictionary_encode(), np.searchsorted(start, at)

    def encode(self, text: str) -> list[int]:
        found, _ = self.parts(pa.array([text]))
        ids = [self.ids(p.decode().replace(" ", SPACE)) for p in found.dictionary.to_pylist()]
        return [i for k in found.indices.to_pylist() for i in ids[k]]

    def _told(self, part: bytes) -> tuple[int, bytes, bytes]:
        ids = self.ids(part.decode().replace(" ", SPACE))
        return len(ids), b"".join(b"%d," % i for i in ids), self.decode(ids, False).encode()

    def digests(self, texts: pa.Array) -> tuple[np.ndarray, list[str], list[str]]:
        """Number of ids, SHA-256 of the ids in decimal joined by commas, and of the decoded text, for each text."""
        found, first = self.parts(texts)
        told = self.known.all(found.dictionary.to_pylist(), lambda new: [self._told(p) for p in new])
        size = np.append(0, np.cumsum(np.array([t[0] for t in told], np.int64)[found.indices.to_numpy()] if told else np.zeros(0, np.int64)))
        n = size[first[1:]] - size[first[:-1]]
        out = []
        for j, (head, tail) in ((1, (0, 1)), (2, (1, 0))):  # without the last comma, and without the dummy prefix
            whole = pa.array([t[j] for t in told], pa.large_binary()).take(found.indices)
            at = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset :][first] if len(whole) else np.zeros(len(first), np.int64)
            raw = memoryview(whole.buffers()[2] or b"")
            out.append([hashlib.sha256(raw[a + head : b - tail] if b > a else b"").hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
        return n, out[0], out[1]


_LOADED: dict[str, PrefixTableBpe] = {}


def encoder(model_path: str) -> PrefixTableBpe:
    """One per worker process and model."""
    if model_path not in _LOADED:
        _LOADED[model_path] = PrefixTableBpe(model_path)
    return _LOADED[model_path]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) per row, for a null text as for an empty one: no ids, empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(model_path)
        for b in batches:
            ids = [bpe.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids])], ["id", "ids", "decoded"])

    rows = narrow(docs, id=id_col, text=F.col(f"`{text_col}`").cast("string"))
    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per row; the ids and the text of encode() without carrying them.

    One pass without a shuffle. Null texts count as empty; repeated rows each get a row; empty tables give none. A worker
    holds CHUNK_BYTES of texts, or one longer text, and a bounded memory of parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(model_path)
        for b in byte_chunks(batches, "text", CHUNK_BYTES):
            n, ids, shown = bpe.digests(b.column(1).fill_null(""))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(ids, pa.string()), pa.array(shown, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = narrow(docs, id=id_col, text=F.col(f"`{text_col}`").cast("string"))
    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
