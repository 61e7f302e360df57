"""Substring deduplication against a plain version, and on passages that begin and end inside lines."""

import random
import re

import pyarrow as pa
import pytest

from shutterlake.llm import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FULL = (1 << 64) - 1
LOWER = {c: c + 32 for c in [*range(65, 91), *range(0xC0, 0xDF)] if c != 0xD7}


def mixed(x):
    x = (x ^ x >> 31) * 0x7FB5D329728EA185 & FULL
    x = (x ^ x >> 27) * 0x81DADEF4BC2DD44D & FULL
    return x ^ x >> 33


def key(word):
    raw, h = word.encode(), 0
    for i, b in enumerate(raw):
        h += (b + 1) * pow(0x5851F42D4C957F2D, i, 1 << 64)
    return mixed(h + len(raw) * 0x9E3779B97F4A7C15 & FULL)


def plain_units(text, radius=substring_dedup.RADIUS):
    """(start, end, words) of lines of eight words and runs of six, by loops."""
    low = text.translate(LOWER)
    found = [(m.start(), m.end(), m.group()) for m in WORD.finditer(low)]
    keys = [key(w) for _, _, w in found]
    h = [mixed((keys[i - 1] if i else 0) * 0xD6E8FEB86659FD93 + k & FULL) for i, k in enumerate(keys)]
    new_run = [i == 0 or all(h[i] < h[j] for j in range(max(0, i - radius), min(len(h), i + radius + 1)) if j != i) for i in range(len(h))]
    new_line = [i == 0 or "\n" in text[found[i - 1][1] : found[i][0]] for i in range(len(h))]
    out = []
    for new, least in ((new_line, 8), (new_run, 6)):
        at = [i for i, x in enumerate(new) if x] + [len(h)]
        out += [(found[a][0], found[b - 1][1], tuple(w for _, _, w in found[a:b])) for a, b in zip(at, at[1:], strict=False) if b - a >= least]
    return out


def plain_dedup(rows):
    """For each (id, text): its text after the cuts and whether any was made."""
    seen, out = {}, {}
    ranked = sorted({(i is None, i or 0, t or "") for i, t in rows}, key=lambda r: r[:2])
    for place in ranked:
        for s, _, words in sorted(plain_units(place[2])):
            seen.setdefault(words, (place, s))
    for place in ranked:
        spans = [(s, e) for s, e, words in plain_units(place[2]) if seen[words] != (place, s)]
        out[place] = substring_dedup.cut_spans(place[2], spans) if spans else (place[2], [])
    return out


def test_units_against_loops():
    rng = random.Random(1)
    texts = [None, "", " \n ", "A", *["".join(rng.choice(["ab", "Cé", "É", "x ", " ", "\n", "\t", "the ", "漢字", " de de de de de de de de "]) for _ in range(rng.randint(0, 120))) for _ in range(300)]]
    doc, start, end, digest = substring_dedup.units(pa.array(texts))
    got = sorted((int(d), int(s), int(e)) for d, s, e in zip(doc, start, end, strict=True))
    assert got == sorted((i, s, e) for i, t in enumerate(texts) for s, e, _ in plain_units(t or ""))
    words = {(i, s, e): w for i, t in enumerate(texts) for s, e, w in plain_units(t or "")}
    by = {}
    for d, s, e, g in zip(doc, start, end, digest, strict=True):
        by.setdefault(words[d, s, e], set()).add(g.tobytes())
    assert all(len(v) == 1 for v in by.values()) and len(set.union(*by.values())) == len(by)


@pytest.mark.parametrize("source", ["table", "awkward"])
def test_dedup_against_a_plain_version(spark, sf, awkward, source):
    docs = awkward if source == "awkward" else spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = plain_dedup(rows)
    for max_bytes in (substring_dedup.MAX_FILTER_BYTES, 512):  # the second lets nearly all units through
        got = substring_dedup.dedup_lines(docs, max_filter_bytes=max_bytes)
        assert got.columns == [*docs.columns, "removed_spans"]
        done = got.select("doc_id", "text", "removed_spans").collect()
        assert len(done) == len(rows)
        by_id = {}
        for (null, i, t), (cut, spans) in want.items():
            by_id.setdefault(None if null else i, []).append((cut, spans))
        for r in done:
            spans = [tuple(s) for s in r["removed_spans"]]
            assert (r["text"] or "", spans) in by_id[r["doc_id"]]


def test_passages_inside_lines_go(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    prose = lambda n: " ".join(w + ("\n" if rng.random() < 0.03 else "") for w in rng.choices(vocabulary, k=n))
    texts, passages = [prose(rng.randint(60, 400)) for _ in range(300)], []
    for _ in range(60):
        p, where = prose(rng.randint(51, 80)).strip(), rng.sample(range(300), 3)
        for d in where:
            w = texts[d].split(" ")
            w[(k := rng.randrange(len(w))) : k] = [p]
            texts[d] = " ".join(w)
        passages.append(p)
    out = [r["text"] for r in substring_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()]
    held = [sum(p in t for t in out) for p in passages]
    assert all(sum(p in t for t in texts) >= 2 for p in passages) and sum(h <= 1 for h in held) >= 0.95 * len(held)
    words = lambda ts: {w for t in ts for w in t.split()}
    assert words(out) == words(texts)  # nothing goes for good
    clean = [t for t in (prose(200) for _ in range(50))]
    kept = substring_dedup.dedup_lines(spark.createDataFrame(list(enumerate(clean)), "doc_id long, text string")).collect()
    assert [r["text"] for r in sorted(kept, key=lambda r: r["doc_id"])] == clean


@pytest.mark.parametrize(("text", "spans", "want"), [
    ("a b\nc d\ne", [(4, 7)], "a b\ne"),
    ("a b\nc d", [(4, 7)], "a b"),
    ("a b c d", [(2, 5)], "a d"),
    ("a b c\nd", [(2, 5)], "a\nd"),
    ("a b c", [(0, 5)], ""),
    ("a b\n c \nd", [(2, 3), (5, 6)], "a\nd"),
    ("é b c\nd e", [(4, 7)], "é b e"),
])
def test_cut_spans(text, spans, want):
    got, gone = substring_dedup.cut_spans(text, spans)
    at, kept = 0, ""
    for s, e in gone:
        kept, at = kept + text[at:s], e
    assert kept + text[at:] == got
    assert got == want
