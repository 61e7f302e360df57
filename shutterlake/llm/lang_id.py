"""Language identification: multinomial logistic regression on TF-IDF character n-grams, trained by FTRL."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import byte_chunks, let_go, narrow

UNDETERMINED = "und"
#: n-grams of 1 to ORDERS characters are hashed to 2**HASH_BITS features.
ORDERS, HASH_BITS = 3, 17
#: The values of a document add up to about this times the mean idf.
SCALE = 30.0
#: FTRL: learning rate, its offset, and the elastic net's two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
EPOCHS = 3
#: Bounds of the labelled sample that is collected for fitting: documents of each language, characters of a document, and
#: documents of all languages, which share them evenly if there are very many.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_ALL = 1000, 20_000, 20_000

#: Text that is told at once.
CHUNK_BYTES = 500_000

_FOLD: np.ndarray | None = None


def _fold() -> np.ndarray:
    """For each code point its lower-case letter, or a space if it isn't a letter."""
    global _FOLD
    if _FOLD is None:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x33480):  # no letters are assigned above
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _FOLD = table
    return _FOLD


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, document) of each character n-gram that isn't all spaces, document by document; and letters per document."""
    sizes = np.array([len(t) for t in texts], np.int64)
    c = _fold()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")]
    doc = np.repeat(np.arange(len(texts)), sizes)
    letters = np.bincount(doc[c != 32], minlength=len(texts))
    found, owner = [], []
    h, blank = np.zeros(len(c), np.uint32), np.ones(len(c), bool)
    for n in range(ORDERS):
        if len(c) <= n:
            break
        h = (h[: len(c) - n] * np.uint32(0x01000193)) ^ c[n:]
        blank = blank[: len(c) - n] & (c[n:] == 32)
        whole = (doc[: len(c) - n] == doc[n:]) & ~blank
        x = (h[whole] + np.uint32(0x9E3779B9 * (n + 1) & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        found.append(x >> np.uint32(32 - HASH_BITS))
        owner.append(doc[: len(c) - n][whole])
    return np.concatenate(found or [np.zeros(0, np.uint32)]), np.concatenate(owner or [np.zeros(0, np.int64)]), letters


@dataclass
class Model:
    """weights has idf folded in; a document's logits are the mean of its n-grams' rows, plus bias, over temperature."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        feature, doc, letters = grams(texts)
        count = np.maximum(np.bincount(doc, minlength=len(texts)), 1)
        sums = np.stack([np.bincount(doc, self.weights[feature, k], len(texts)) for k in range(len(self.languages))], 1)
        return sums / count[:, None] + self.bias, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language and its calibrated probability; `und` and 0 for a text that is null or has no letter."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        z, letters = self.logits([t or "" for t in texts])
        p = _softmax(z / self.temperature)
        best = p.argmax(1)
        known = letters > 0
        return [self.languages[k] if ok else UNDETERMINED for k, ok in zip(best, known, strict=True)], np.where(known, p.max(1), 0.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _vectors(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, share of the document's n-grams) of each text."""
    out = []
    for t in texts:
        f, n = np.unique(grams([t])[0], return_counts=True)
        out.append((f, n / max(1, n.sum())))
    return out


def fit(texts: list[str], labels: list[str], seed: int = 0) -> Model:
    """Fit on four fifths of the sample and calibrate the temperature on the rest; without texts, a model that says `und`."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((1 << HASH_BITS, 0), np.float32), np.zeros(0), 1.0)
    y, d, k = np.array([languages.index(x) for x in labels]), 1 << HASH_BITS, len(languages)
    order = np.random.default_rng(seed).permutation(len(texts))
    held = order[: len(texts) // 5]
    train = order[len(held) :] if len(texts) >= 5 * k else order
    x = _vectors(texts)
    df = np.bincount(np.concatenate([x[i][0] for i in train]), minlength=d)
    idf = np.log((1 + len(train)) / (1 + df)) + 1
    z, n = np.zeros((d + 1, k)), np.zeros((d + 1, k))  # the last row is the bias

    def weights(at):
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(nn)) / ALPHA + L2))

    rng = np.random.default_rng(seed + 1)
    for _ in range(EPOCHS):
        for i in rng.permutation(train):
            f, tf = x[i]
            at, v = np.append(f, d), np.append(tf * idf[f] * SCALE, 1.0)
            w = weights(at)
            p = _softmax(v @ w)
            p[y[i]] -= 1
            g = v[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(np.arange(d + 1))
    model = Model(languages, (w[:d] * idf[:, None] * SCALE).astype(np.float32), w[d], 1.0)
    if len(held):
        logits, truth = model.logits([texts[i] for i in held])[0], y[held]
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
        loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def held_out(id_col: str, buckets: int) -> Column:
    """crc32 of the id as text, modulo buckets, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % buckets == 2, F.lit(False))


def train(docs: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on a bounded sample: of each language, the sample_docs distinct labelled texts of at most sample_chars with the least hash.

    A first pass counts each language's distinct hashes; a second one takes the share of the hashes that holds half as
    many again as are wanted, so that no task gathers a language. Rows without text or label don't count.
    """
    text, lang = F.col(f"`{text_col}`").cast("string"), F.col(f"`{lang_col}`").cast("string")
    rows = narrow(docs.filter(usable) if usable is not None else docs, text=text, lang=lang)
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= sample_chars)).withColumn("h", F.xxhash64("text"))
    sizes = rows.select("lang", "h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not sizes:
        return fit([], [])
    sample_docs = max(1, min(sample_docs, SAMPLE_ALL // len(sizes)))
    bound = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, (1.5 * sample_docs + 50) / r["n"]))])
    some = rows.filter(F.col("h") / 2.0**64 + 0.5 <= F.element_at(bound, F.col("lang")))
    found: dict[str, list[tuple[int, str]]] = {}
    for r in some.groupBy("lang", "h").agg(F.min("text").alias("text")).collect():
        found.setdefault(r["lang"], []).append((r["h"], r["text"]))
    got = [(lang, t) for lang in sorted(found) for _, t in sorted(found[lang])[:sample_docs]]
    model = fit([t for _, t in got], [lang for lang, _ in got])
    let_go()  # the driver lives on
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and lang_score, from every whole text alone.

    Null, empty and letterless texts get `und` and 0; repeated rows get the same each; empty tables stay empty. A column
    of docs that is named lang_pred or lang_score is replaced. The model, 2**HASH_BITS rows, is broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, lang_score double")
    def tell(text: pa.Array) -> pa.Array:
        names, scores = [], []
        for part in byte_chunks(iter([pa.RecordBatch.from_arrays([text], ["text"])]), "text", CHUNK_BYTES):
            a, b = sent.value.predict(part.column(0).to_pylist())
            names.append(pa.array(a, pa.string()))
            scores.append(b)
        let_go()
        kinds = [pa.concat_arrays(names) if names else pa.array([], pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())]
        return pa.StructArray.from_arrays(kinds, ["lang_pred", "lang_score"])

    names = [c for c in docs.columns if c not in ("lang_pred", "lang_score", "__told")]
    told = docs.select(*[F.col(f"`{c}`") for c in names]).withColumn("__told", tell(F.col(f"`{text_col}`").cast("string")))
    return told.select(*[F.col(f"`{c}`") for c in names], "__told.lang_pred", "__told.lang_score")
