"""Language-model scoring with a log-frequency Bloom filter of quantised n-gram counts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import byte_chunks, cut_lineage, map_arrow, mix, narrow, spread_join, word_keys

#: Level q of a count c is 1 + floor(log c / log BASE); levels 1 to q of an n-gram are put in.
BASE = 1.5
#: Positions of one level of one n-gram, and bits of the filter for each such level.
HASHES, BITS_A_LEVEL = 3, 8
#: Pseudo-count of the unigram distribution in that of bigrams.
MU = 4.0
#: Upper bound of the two filters that are broadcast, and of the words whose exact counts are (12 bytes each). Bigrams that
#: occur once, and those beyond the bound, are in the filters of a table of slices, which texts meet in a join; so every
#: bigram's count is used, at any size.
MAX_FILTER_BYTES, MAX_WORDS = 96 << 20, 2_000_000
#: Bytes of text for each slice of the n-grams.
SLICE_BYTES = 12 << 20
#: Tokens that a task gathers before it counts them.
GATHER = 1_000_000

_ODD = 0x9E3779B97F4A7C15
_END, _BEGIN = np.uint64(0x7C0E5B1DA4F3E291), np.uint64(0x1B873593CC9E2D51)


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of all tokens of all texts, in order, and how many each text has; each text ends in the end token.

    Words are runs of bytes other than ASCII white space, A-Z in lower case.
    """
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b" ".join([*data, b""]).lower(), np.uint8)
    ends = np.cumsum([len(d) + 1 for d in data])  # after the white space that follows each text
    start, stop, word = word_keys(buf)
    doc = np.searchsorted(ends, start, "right")
    count = np.bincount(doc, minlength=len(texts)) + 1
    out = np.empty(len(word) + len(texts), np.uint64)
    out[np.cumsum(count) - 1] = _END
    out[np.arange(len(word)) + doc] = word
    return out, count


def bigrams(keys: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The key of each token with the one before it; a text's first token follows the begin mark."""
    before = np.empty_like(keys)
    before[1:] = keys[:-1]
    before[(np.cumsum(count) - count)] = _BEGIN
    return mix(before * np.uint64(0xD6E8FEB86659FD93) + keys)


def cut_keys(keys: np.ndarray, shift: int) -> np.ndarray:
    """Bigram keys without what lies below their 40 upper bits within a slice; that much is sent, in five bytes."""
    return keys & ~np.uint64((1 << (shift - 40)) - 1)


def to_bytes(keys: np.ndarray, shift: int) -> bytes:
    short = (keys << np.uint64(64 - shift)) >> np.uint64(24)
    return short.astype(np.uint32).tobytes() + (short >> np.uint64(32)).astype(np.uint8).tobytes()


def from_bytes(data: bytes, part: int, shift: int) -> np.ndarray:
    n = len(data) // 5
    short = np.frombuffer(data, np.uint32, n).astype(np.uint64) | np.frombuffer(data, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32)
    return np.uint64(part << shift) | short << np.uint64(shift - 40)


def levels(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(count) / np.log(BASE) + 1e-9).astype(np.int64)


def value(level: np.ndarray) -> np.ndarray:
    """The least count of a level; 0 for level 0."""
    return np.where(level > 0, BASE ** (level - 1.0), 0.0)


def _places(keys: np.ndarray, level: np.ndarray | int, bits: int) -> list[np.ndarray]:
    h = mix(keys + np.asarray(level, np.uint64) * np.uint64(_ODD))
    out, rest = [], bits.bit_length() - 1
    for i in range(HASHES):
        if rest * (i % 3 + 1) > 64 or i and i % 3 == 0:
            h = mix(h)
        out.append((h >> np.uint64(rest * (i % 3) if rest * (i % 3 + 1) <= 64 else 0)) & np.uint64(bits - 1))
    return out


def build_slice(keys: np.ndarray, level: np.ndarray, max_bits: int, bits_a_level: int = BITS_A_LEVEL, least: int = 1) -> tuple[bytes, int, int]:
    """The filter of a slice's n-grams by their levels, its number of bits, and the least level that it holds.

    The size follows the n-grams up to max_bits. If they don't fit, those of the lowest levels aren't put in, as many
    levels as need be.
    """
    need = int(level[level >= least].sum()) * bits_a_level
    while need > max_bits and least <= int(level.max(initial=0)):
        least += 1
        need = int(level[level >= least].sum()) * bits_a_level
    bits = min(max_bits, max(64, 1 << max(0, need - 1).bit_length()))
    held = np.zeros(bits, bool)
    keys, level = keys[level >= least], level[level >= least]
    for q in range(1, int(level.max(initial=0)) + 1):
        for p in _places(keys[level >= q], q, bits):
            held[p] = True
    return np.packbits(held).tobytes(), bits, least


@dataclass
class LogFrequencyFilter:
    """Filters of all slices; a key's slice is given by its upper bits."""

    shift: int
    maps: np.ndarray
    start: np.ndarray
    bits: np.ndarray
    least: np.ndarray

    def slices(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(self.shift)).astype(np.int64) if self.shift < 64 else np.zeros(len(keys), np.int64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key's count: membership is probed at level 1, 2 and so on, as long as it is found."""
        level = np.zeros(len(keys), np.int64)
        s = self.slices(keys)
        for size in np.unique(self.bits[s]) if len(keys) else []:
            own = np.flatnonzero(self.bits[s] == size)
            left, q = own, 1
            while len(left):
                ok = np.ones(len(left), bool)
                for p in _places(keys[left], q, int(size)):
                    ok &= (self.maps[self.start[s[left]] + (p >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (p & np.uint64(7)).astype(np.uint8))) & 1 == 1
                left = left[ok]
                level[left] = q
                q += 1
        return level


def _gather(slice_bits: int):
    """In each task: counts of the training texts' unigrams and bigrams, by slice, as keys with the counts over one."""
    shift = 64 - slice_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[], []]
        held = 0

        def give() -> pa.RecordBatch:
            rows = []
            for order in (0, 1):
                k, n = np.unique(np.concatenate(parts[order]), return_counts=True)
                s = (k >> np.uint64(64 - slice_bits)).astype(np.int64) if slice_bits else np.zeros(len(k), np.int64)
                at = np.searchsorted(s, np.arange((1 << slice_bits) + 1))
                for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    if b > a:  # keys that occur once go first, without a count
                        once = n[a:b] == 1
                        keys = np.concatenate([k[a:b][once], k[a:b][~once]])
                        rows.append((order + 1, i, to_bytes(keys, shift) if order else keys.tobytes(), n[a:b][~once].astype("<u4").tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["n", "slice", "keys", "counts"])

        for b in byte_chunks(batches, "text"):
            t, count = tokens(b.column(0).to_pylist())
            parts[0].append(t)
            parts[1].append(cut_keys(bigrams(t, count), shift))
            held += len(t)
            if held >= GATHER:
                yield give()
                parts, held = [[], []], 0
        if held:
            yield give()

    return run


def _sum_slice(max_bits: dict[int, int], bits_a_level: int, shift: int):
    def run(pdf):
        import pandas as pd

        n = int(pdf["n"].iloc[0])
        part, size = int(pdf["slice"].iloc[0]), 8 if n == 1 else 5
        k = np.frombuffer(b"".join(pdf["keys"]), np.uint64) if n == 1 else np.concatenate([from_bytes(x, part, shift) for x in pdf["keys"]])
        c = np.concatenate([np.append(np.ones(len(x) // size - len(y) // 4, np.int64), np.frombuffer(y, "<u4")) for x, y in zip(pdf["keys"], pdf["counts"], strict=True)])
        order = np.argsort(k)
        k, c = k[order], c[order]
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        keys, counts = k[first], np.add.reduceat(c, first)
        del k, c, order
        level = levels(counts)
        held, bits, least = build_slice(keys, level, max_bits[n], bits_a_level, n)
        words = (keys.tobytes(), counts.astype("<i8").tobytes()) if n == 1 else (b"", b"")
        low = level < least if n == 2 else np.zeros(len(level), bool)
        rest, rest_bits, _ = build_slice(short_key(keys[low], shift), level[low], 1 << 62, bits_a_level)
        return pd.DataFrame({"n": [n], "slice": [int(pdf["slice"].iloc[0])], "n_keys": [len(keys)], "total": [int(counts.sum())], "bits": [bits], "least": [least], "held": [held], "keys": [words[0]], "counts": [words[1]], "rest": [rest], "rest_bits": [rest_bits]})

    return run


@dataclass
class LanguageModel:
    """The counts of words that the driver holds and broadcasts, all bounded, and the table of the other words."""

    unigrams: LogFrequencyFilter
    bigrams: LogFrequencyFilter
    total: int
    distinct: int
    texts: int
    word_keys: np.ndarray
    word_counts: np.ndarray
    whole: bool

    def prob(self, joint: np.ndarray, word: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log10 of a token's smoothed probability, from the levels of its bigram, of itself and of the token before (-1: none)."""
        uni = (value(word) + 1.0) / (self.total + self.distinct + 1)
        # the level's upper end: no context's probabilities add up to more than 1
        context, joint = np.where(before < 0, self.texts * 1.0, value(before) * BASE), value(joint)
        return np.log10((joint + MU * uni) / (np.maximum(context, joint) + MU))

    def exact(self, words: np.ndarray) -> np.ndarray:
        """The counts of words whose exact counts are broadcast; 0 for others."""
        if not len(self.word_keys):
            return np.zeros(len(words), np.int64)
        place = np.minimum(np.searchsorted(self.word_keys, words), len(self.word_keys) - 1)
        return np.where(self.word_keys[place] == words, self.word_counts[place], 0)

    def unheld(self, words: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Words that the unigram filter can't tell: their slice has no room for the lowest levels, and no higher one was found."""
        return (level < self.unigrams.least[self.unigrams.slices(words)]) & (self.unigrams.least[self.unigrams.slices(words)] > 1)

    def ask(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct words of each text whose counts neither the filter nor the exact counts tell: key and whose it is."""
        t, count = tokens(texts)
        words, which = np.unique(t, return_inverse=True)
        open_ = self.unheld(words, self.unigrams.levels(words)) & (self.exact(words) == 0)
        at = np.flatnonzero(open_[which])
        some = np.unique(np.stack([np.repeat(np.arange(len(texts)), count)[at], which[at]]), axis=1)
        return words[some[1]], some[0]

    def score(self, texts: list[str | None], learned: np.ndarray, told: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
        """Per text: tokens, known tokens, base score and model score, over what is broadcast; then what isn't, in two parts.

        learned tells which texts the model was trained on: each of their bigrams occurs, so one that isn't in a filter of
        counts of two or more occurs once. told: keys and counts of words that ask() gave, where the training texts have them.
        First the keys of other words and whose they are; then, by slice, the bigrams that may be in the table: slice,
        key, whose it is, and the levels of the token and of the one before, with one row for each place.
        """
        t, count = tokens(texts)
        at = np.cumsum(count) - count
        words, which = np.unique(t, return_inverse=True)  # each distinct token is looked up once
        exact = self.exact(words)
        c, base = exact[which], np.log10((exact + 1.0) / (self.total + self.distinct + 1))[which]
        level = self.unigrams.levels(words)
        lost = np.flatnonzero(self.unheld(words, level))
        known = exact[lost].astype(np.int64)
        if len(told[0]):
            keys, first = np.unique(told[0], return_index=True)
            place = np.minimum(np.searchsorted(keys, words[lost]), len(keys) - 1)
            known = np.where(keys[place] == words[lost], told[1][first][place], known)
        level[lost] = np.where(known > 0, levels(np.maximum(known, 1)), 0)
        seen = level[which]
        before = np.append(-1, seen[:-1])
        before[at] = -1
        pairs, which = np.unique(cut_keys(bigrams(t, count), self.bigrams.shift), return_inverse=True)
        s = self.bigrams.slices(pairs)
        least = self.bigrams.least[s][which]
        joint = self.bigrams.levels(pairs)[which]
        joint[(joint == 0) & (least == 2) & np.repeat(learned, count)] = 1
        p = self.prob(joint, seen, before)
        other = np.flatnonzero(c == 0) if not self.whole else np.zeros(0, np.int64)
        far = np.flatnonzero((joint == 0) & (least > 1))
        far = far[np.argsort(s[which[far]], kind="stable")]
        far = s[which[far]], pairs[which[far]], np.searchsorted(at, far, "right") - 1, seen[far], before[far]
        return count, np.add.reduceat((c > 0).astype(np.int64), at), np.add.reduceat(base, at), np.add.reduceat(p, at), (t[other], np.searchsorted(at, other, "right") - 1), far


def pack_far(keys: np.ndarray, doc: np.ndarray, word: np.ndarray, before: np.ndarray, shift: int) -> np.ndarray:
    """One number for each bigram that isn't in the filter: 36 bits of its key below the slice's, 16 of its text's place, 6 of each level.

    A key is taken for another of its slice with a chance of the slice's size over 2**36.
    """
    return (short_key(keys, shift) << np.uint64(28)) | (doc.astype(np.uint64) << np.uint64(12)) | (word.astype(np.uint64) << np.uint64(6)) | (before & 63).astype(np.uint64)


def short_key(keys: np.ndarray, shift: int) -> np.ndarray:
    return (keys << np.uint64(64 - shift) if shift < 64 else keys) >> np.uint64(28)


def _filter(rows: pa.Table, slice_bits: int) -> LogFrequencyFilter:
    """The filters of the slices, side by side; eight zero bytes stand for those of slices without n-grams."""
    start, bits, least = np.zeros(1 << slice_bits, np.int64), np.full(1 << slice_bits, 64, np.int64), np.ones(1 << slice_bits, np.int64)
    part = rows["slice"].to_numpy()
    bits[part], least[part] = rows["bits"].to_numpy(), rows["least"].to_numpy()
    ends = np.append(8, 8 + np.cumsum([v.as_buffer().size for v in rows["held"]], dtype=np.int64))
    start[part] = ends[:-1]
    maps = np.zeros(int(ends[-1]), np.uint8)
    for at, v in zip(ends[:-1].tolist(), rows["held"], strict=True):
        maps[at : at + v.as_buffer().size] = np.frombuffer(v.as_buffer(), np.uint8)
    return LogFrequencyFilter(64 - slice_bits, maps, start, bits, least)


@dataclass
class Trained:
    """The model that is broadcast, and what it leaves to joins: words (key, c), bigrams (slice, rest, rest_bits)."""

    model: LanguageModel
    words: DataFrame
    bigrams: DataFrame
    #: Distinct words that the unigram filter has no room for; score() takes their levels from their exact counts.
    words_left_out: int


def train(docs: DataFrame, usable: Column | None = None, text_col: str = "text", max_filter_bytes: int = MAX_FILTER_BYTES, max_words: int = MAX_WORDS, bits_a_level: int = BITS_A_LEVEL) -> Trained:
    """Count all tokens and bigrams of the usable texts.

    Tasks count what they read, deal keys and counts to slices by the key's upper bits, and each slice sums its keys and
    builds its part of the filters. The driver gets the filters, max_filter_bytes at most, and the most frequent words,
    max_words at most; the other words' counts and the bigrams that don't fit the filter stay tables. Words that don't fit the
    unigram filter keep their exact counts too: score() asks for those that its texts hold.
    """
    rows = narrow(docs.filter(usable) if usable is not None else docs, text=F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    size, texts = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long") + 1), F.lit(0)), F.count(F.lit(1))).first()
    slice_bits = min(16, max(2, (max(1, size // SLICE_BYTES)).bit_length()))
    share = (max_filter_bytes * 8) >> slice_bits
    power = 1 << max(6, (share // 3).bit_length() - 1)
    gathered = map_arrow(rows, _gather(slice_bits), "n int, slice int, keys binary, counts binary")
    kinds = "n int, slice int, n_keys long, total long, bits long, least int, held binary, keys binary, counts binary, rest binary, rest_bits long"
    slices = cut_lineage(gathered.groupBy("n", "slice").applyInPandas(_sum_slice({1: power, 2: 2 * power}, bits_a_level, 64 - slice_bits), kinds))
    filters = []
    for n in (1, 2):  # max_filter_bytes at most, one order after the other
        held = slices.filter(F.col("n") == n).select("slice", "n_keys", "total", "bits", "least", "held").toArrow()
        if n == 1:
            distinct, total = (pc.sum(held[k]).as_py() or 0 for k in ("n_keys", "total"))
            cut = held["slice"].filter(pc.greater(held["least"], 1)).to_pylist()
        filters.append(_filter(held, slice_bits))
        del held
    words = map_arrow(slices.filter("n = 1").select("keys", "counts"), _words, "key long, c long")
    # a step of counts is 1/32 of a doubling, or one count: there are under 2048 steps, and the upper ones are broadcast
    step = F.floor(F.log2("c") * 32).cast("int")
    by = {r["s"]: r["count"] for r in words.groupBy(step.alias("s")).count().collect()}
    sums, least = 0, max(by, default=0) + 1
    for s in sorted(by, reverse=True):
        if (sums := sums + by[s]) > max_words:
            break
        least = s
    top = words.filter(step >= least).toArrow() if distinct else pa.table({"key": pa.array([], pa.int64()), "c": pa.array([], pa.int64())})
    keys = top["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    whole = distinct <= max_words
    model = LanguageModel(*filters, total, distinct, texts, keys[order], top["c"].to_numpy()[order].astype(np.int32 if total < 2**31 else np.int64), whole)
    left = map_arrow(slices.filter("n = 1").filter(F.col("slice").isin(cut)).select("counts", "least"), _left_out, "n long").agg(F.sum("n")).first()[0] if cut else 0
    rest = slices.filter("n = 2").select("slice", "rest", "rest_bits")
    return Trained(model, words.filter(step < least), rest, left or 0)


def _left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([int((levels(np.frombuffer(c.as_py(), np.int64)) < q.as_py()).sum()) for c, q in zip(b.column(0), b.column(1), strict=True)], pa.int64())], ["n"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k, c in zip(b.column(0), b.column(1), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(k.as_py(), np.int64)), pa.array(np.frombuffer(c.as_py(), np.int64))], ["key", "c"])


def _met(model):
    """In each slice: by how much the bigrams of the table change the texts' scores."""

    def run(far: pa.Table, rest: pa.Table) -> pa.Table:
        none = pa.table({"uid": pa.array([], pa.int64()), "more": pa.array([], pa.float64())})
        if not far.num_rows or not rest.num_rows:
            return none
        bits = rest["rest_bits"][0].as_py()
        table = LogFrequencyFilter(64, np.frombuffer(rest["rest"][0].as_py(), np.uint8), np.zeros(1, np.int64), np.array([bits]), np.ones(1, np.int64))
        uids, mores = [], []
        for base, blob in zip(far["uid"].to_pylist(), far["blob"].to_pylist(), strict=True):
            x = np.frombuffer(blob, np.uint64)
            doc = (x >> np.uint64(12)).astype(np.uint16)
            word, before = ((x >> np.uint64(6)) & np.uint64(63)).astype(np.int64), (x & np.uint64(63)).astype(np.int64)
            before[before == 63] = -1
            level = table.levels(x >> np.uint64(28))
            hit = np.flatnonzero(level)
            zero = np.zeros(len(hit), np.int64)
            delta = model.value.prob(level[hit], word[hit], before[hit]) - model.value.prob(zero, word[hit], before[hit])
            some, own = np.unique(doc[hit], return_inverse=True)
            uids.append(base + some.astype(np.int64))
            mores.append(np.bincount(own, delta, len(some)))
        return pa.table({"uid": pa.array(np.concatenate(uids)), "more": pa.array(np.concatenate(mores))})

    return run


_TOLD = "array<struct<key:bigint,c:bigint>>"


def _told(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    key, c = column.flatten().flatten()
    return key.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), c.to_numpy(zero_copy_only=False).astype(np.int64)


def _with_told(rows: DataFrame, trained: Trained, sent) -> DataFrame:
    """rows with told: the counts of each text's words that the filter has no room for and that aren't broadcast.

    Texts ask for their words' keys by their own hash, so that copies ask once; a text of many copies is spread.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_chunks(batches, "text", 1_000_000):
            keys, owner = sent.value.ask(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), pa.array(keys.view(np.int64))], ["h", "key"])

    rows = rows.withColumn("h", F.xxhash64("text"))
    asked = map_arrow(rows.select("h", "text"), run, "h long, key long").groupBy("h", "key").agg(F.count(F.lit(1)).alias("n"))
    known = asked.join(trained.words, "key").groupBy("h").agg(F.max("n").alias("n"), F.collect_list(F.struct("key", "c")).alias("told"))
    return spread_join(rows, cut_lineage(known), "h", "n", rows.count()).drop("n", "h").select("id", "text", "learned", F.col("told").cast(_TOLD).alias("told"))


def score(docs: DataFrame, trained: Trained, learned: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, n_known, base_score, score. learned: whether a row is one that the model learned from.

    base_score sums log10((c + 1) / (N + V + 1)) with the exact counts of all words: those of broadcast words in the
    same pass, those of other words by a join of their keys alone. score is the model's log10 probability: bigram counts
    over their context's, smoothed by unigrams, from probes of the filter; bigrams that the filter doesn't hold are
    looked up by slice in their table, and change the sums of the texts that hold them. A null or empty text has the
    end token alone; repeated rows are scored each; empty tables give no rows; other columns are left out.
    """
    model = trained.model
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (c.slice(i, 1 << 16) for c in byte_chunks(batches, "text", 1_000_000) for i in range(0, c.num_rows, 1 << 16)):
            n, known, base, whole, (keys, owner), (s, far, doc, word, before) = sent.value.score(b.column(2).to_pylist(), b.column(3).to_numpy(zero_copy_only=False), _told(b.column(4)))
            cut = pa.array(np.searchsorted(owner, np.arange(b.num_rows + 1)), pa.int32())
            some, first = np.unique(s, return_index=True)
            ends = np.append(first, len(s))[1:]
            packed = pack_far(far, doc, word, before, sent.value.bigrams.shift)
            blobs = [packed[i:j].tobytes() for i, j in zip(first, ends, strict=True)]
            texts = [b.column(0), b.column(1), pa.array(n), pa.array(known), pa.array(base), pa.array(whole), pa.ListArray.from_arrays(cut, pa.array(keys.view(np.int64)))]
            names = ["id", "uid", "n_tokens", "n_known", "base_score", "score", "rest"]
            yield pa.RecordBatch.from_arrays([*texts, pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())], [*names, "slice", "blob"])
            if len(some):
                kinds = [c.type for c in texts]
                empty = [pa.nulls(len(some), k) for k in kinds]
                empty[1] = pa.array([b.column(1)[0].as_py()] * len(some), kinds[1])  # uids follow one another in a partition
                yield pa.RecordBatch.from_arrays([*empty, pa.array(some.astype(np.int32)), pa.array(blobs, pa.binary())], [*names, "slice", "blob"])

    rows = narrow(docs, id=id_col, text=F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), learned=F.coalesce(learned, F.lit(False)) if learned is not None else F.lit(False))
    if trained.words_left_out and not model.whole:
        rows = _with_told(rows, trained, sent)
    else:
        rows = rows.withColumn("told", F.lit(None).cast(_TOLD))
    rows = rows.select("id", F.monotonically_increasing_id().alias("uid"), "text", "learned", "told")
    kind = rows.schema["id"].dataType.simpleString()
    done = map_arrow(rows, run, f"id {kind}, uid long, n_tokens long, n_known long, base_score double, score double, rest array<long>, slice int, blob binary")
    out = ["id", "n_tokens", "n_known", "base_score", "score"]
    done = cut_lineage(done)
    scored = done.filter("slice IS NULL")
    if not model.whole:
        more = scored.select("uid", F.explode("rest").alias("key")).join(trained.words, "key").groupBy("uid").agg(F.count(F.lit(1)).alias("k"), F.sum(F.log10(F.col("c") + 1)).alias("s"))
        scored = scored.join(more, "uid", "left").withColumn("n_known", F.col("n_known") + F.coalesce("k", F.lit(0))).withColumn("base_score", F.col("base_score") + F.coalesce("s", F.lit(0.0)))
    far = done.filter("slice IS NOT NULL").select("slice", "uid", "blob")
    met = far.groupBy("slice").cogroup(trained.bigrams.groupBy("slice")).applyInArrow(_met(sent), "uid long, more double")
    scored = scored.join(met.groupBy("uid").agg(F.sum("more").alias("more")), "uid", "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0)))
    return scored.select(out)
