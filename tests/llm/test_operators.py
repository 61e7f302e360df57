"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from shutterlake.llm import embedding_dedup, exact_dedup, html_extract, lang_id, lm_score, near_dedup, packing, queries, sharding, simhash, sp_bpe, substring_dedup
from shutterlake.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def lowest(nodes, links):
    """The smallest node that each reaches."""
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


@pytest.fixture(scope="module", params=["table", "awkward"])
def docs(request, spark, sf, awkward):
    return awkward if request.param == "awkward" else spark.read.parquet(f"{sf}/documents.parquet")


def same_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    got = queries.queries()[name](spark, sf).select(*cols).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_give_what_their_sql_gives(spark, sf, name):
    same_as_sql(spark, sf, name)


def test_sharding_is_balanced_gapless_and_stable(docs):
    got = sharding.shard(docs, 8).collect()
    assert len(got) == docs.count()
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by[k]) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows_of(docs)), key=str)
    assert sorted(((r["id"], r["size"], r["text_crc32"]) for r in got), key=str) == want
    assert sorted(map(str, got)) == sorted(map(str, sharding.shard(docs.repartition(5), 8).collect()))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 4097])
def test_permute_is_a_permutation(spark, n):
    p = [r[0] for r in spark.range(n).select(sharding.permute(F.col("id"), n, 3)).collect()]
    assert sorted(p) == list(range(n)) and (n < 100 or p != sorted(p))


def test_exact_dedup(docs):
    rows = rows_of(docs)
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    key = lambda i: -math.inf if i is None else i
    want = [(i, max(groups[t or ""], key=key), len(groups[t or ""]), i == max(groups[t or ""], key=key), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
    got = [(r["id"], r["keep_id"], r["group_size"], r["kept"], r["sha"]) for r in exact_dedup.exact_dedup(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    tight = exact_dedup.exact_dedup(docs, max_filter_bytes=512)  # nearly all rows look repeated
    assert sorted(((r["id"], r["keep_id"], r["group_size"], r["kept"], r["sha"]) for r in tight.collect()), key=str) == sorted(want, key=str)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(rows_of(kept), key=str) == sorted({(w[0], t) for w, (_, t) in zip(want, rows, strict=True) if w[3]}, key=str)


def test_language_id(spark, sf, docs):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = lang_id.train(table, ~lang_id.held_out("doc_id", 4))
    got = lang_id.predict(docs, model).select("doc_id", "text", "lang", "lang_pred", "lang_score").collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) and 0 <= r["lang_score"] <= 1
    told = [r for r in lang_id.predict(table.filter(lang_id.held_out("doc_id", 4) & F.col("lang").isNotNull()), model).collect() if r["lang_pred"] != "und"]
    assert np.mean([r["lang"] == r["lang_pred"] for r in told]) >= 0.9


def brute_tokens(t):
    return [*WORD.findall((t or "").translate(LOWER)), None]


def model_score(texts, trained_on):
    """The definition of score, from exact counts rounded down to levels."""
    uni, pair = collections.Counter(), collections.Counter()
    for words in trained_on:
        uni.update(words)
        pair.update(zip([False, *words], words, strict=False))
    size, rough = sum(uni.values()) + len(uni) + 1, lambda c: 1.5 ** math.floor(math.log(c) / math.log(1.5) + 1e-9) if c else 0.0
    for words in texts:
        total = 0.0
        for a, b in zip([False, *words], words, strict=False):
            context, joint = len(trained_on) if a is False else rough(uni[a]) * 1.5, rough(pair[a, b])
            total += math.log10((joint + 4 * (rough(uni[b]) + 1) / size) / (max(context, joint) + 4))
        yield total


@pytest.mark.parametrize(("max_words", "max_bytes"), [(2_000_000, 96 << 20), (20, 96 << 20), (2_000_000, 3000), (20, 60_000)])
def test_language_model_scores(docs, max_words, max_bytes, monkeypatch):
    few = {"bits_a_level": 128}  # next to no false positives
    rows = rows_of(docs)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = collections.Counter(w for i, t in rows if not held(i) for w in brute_tokens(t))
    total, distinct = sum(count.values()), len(count)
    trained = lm_score.train(docs, ~lang_id.held_out("doc_id", 7), max_words=max_words, max_filter_bytes=max_bytes, **few)
    assert (trained.model.total, trained.model.distinct) == (total, distinct)
    assert len(trained.model.word_keys) <= max_words and trained.model.bigrams.maps.nbytes <= max(max_bytes, 1 << 12)
    whole = max_bytes > 1 << 20
    assert bool((trained.model.bigrams.least > 2).any()) == (not whole) and (trained.words_left_out == 0) == whole
    want = collections.defaultdict(list)
    for (i, t), s in zip(rows, model_score([brute_tokens(t) for _, t in rows], [brute_tokens(t) for i, t in rows if not held(i)]), strict=True):
        words = brute_tokens(t)
        base = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in words)
        want[i].append((len(words), sum(count[w] > 0 for w in words), base, s))
    done = lm_score.score(docs, trained).collect()
    told = lm_score.score(docs, trained, ~lang_id.held_out("doc_id", 7)).collect()  # fewer look-ups, the same scores
    assert len(done) == len(rows) == len(told)
    for r in [*done, *told]:
        assert any((r["n_tokens"], r["n_known"]) == w[:2] and abs(r["base_score"] - w[2]) < 1e-4 for w in want[r["id"]])
        if whole:
            assert any(abs(r["score"] - w[3]) <= 0.002 * abs(w[3]) + 0.01 for w in want[r["id"]])
    if not whole:  # the bigrams that the filter has no room for count all the same: they are told from a table
        full = lm_score.train(docs, ~lang_id.held_out("doc_id", 7), **few)
        monkeypatch.setattr(full.model, "unigrams", trained.model.unigrams)
        scores = collections.defaultdict(list)
        for r in lm_score.score(docs, full).collect():
            scores[r["id"]].append(r["score"])
        assert all(any(abs(r["score"] - s) <= 0.002 * abs(s) + 0.01 for s in scores[r["id"]]) for r in [*done, *told])


@pytest.mark.parametrize(("max_words", "max_bytes"), [(2_000_000, 3000), (20, 60_000), (20, 3000)])
def test_language_model_counts_words_that_its_filter_has_no_room_for(docs, max_words, max_bytes):
    rows = rows_of(docs)
    trained = lm_score.train(docs, ~lang_id.held_out("doc_id", 7), max_words=max_words, max_filter_bytes=max_bytes, bits_a_level=128)
    assert trained.words_left_out > 20
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    want = collections.defaultdict(list)
    for (i, _), s in zip(rows, model_score([brute_tokens(t) for _, t in rows], [brute_tokens(t) for i, t in rows if not held(i)]), strict=True):
        want[i].append(s)
    got = lm_score.score(docs, trained, ~lang_id.held_out("doc_id", 7)).collect()
    assert len(got) == len(rows)
    assert all(any(abs(r["score"] - s) <= 0.002 * abs(s) + 0.01 for s in want[r["id"]]) for r in got)


def test_log_frequency_filter_never_underrates():
    keys = np.unique(np.random.default_rng(0).integers(1, 2**63, 5000).astype(np.uint64))
    count = np.random.default_rng(1).zipf(1.5, len(keys)).clip(1, 10**6)
    held, bits, least = lm_score.build_slice(keys, lm_score.levels(count), 1 << 24)
    assert least == 1
    got = lm_score.LogFrequencyFilter(64, np.frombuffer(held, np.uint8), np.zeros(1, np.int64), np.array([bits]), np.array([1])).levels(keys)
    assert (got >= lm_score.levels(count)).all() and (got == lm_score.levels(count)).mean() > 0.85


def test_packing_loses_no_id(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = packing.Tokenizer.from_file(path)
    want = collections.Counter()
    for i, t in rows_of(docs):
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[i, len(ids)] += 1
    got = packing.pack_documents(docs, path).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    texts = dict(rows_of(docs))
    for r in got:
        pieces[r["id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(want)
    for (i, n), parts in pieces.items():
        ids = np.array([*coder.encode(texts[i] or "", add_special_tokens=False).ids, 0], "<u4")
        assert sum(p[1] for p in parts) == n * want[i, n]
        assert sorted({x for s, k, _ in parts for x in range(s, s + k)}) == list(range(n))
        assert all(zlib.crc32(ids[s : s + k].tobytes()) == c for s, k, c in parts)
    for parts in sequences.values():
        at = 0
        for o, k in sorted(parts):
            assert o == at
            at += k
        assert at <= 1024


@pytest.mark.parametrize("seed", range(20))
def test_pack_uses_as_few_sequences_as_the_tokens_allow(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, rng.randint(1, 40), rng.randint(1, 500)]) for _ in range(rng.randint(0, 60))]
    out = packing.pack(sizes, 64)
    used = collections.Counter()
    for _, _, n, s, o in out:
        used[s] += n
        assert n > 0 and o + n <= 64
    assert sum(used.values()) == sum(sizes) and len(used) <= -(-sum(sizes) // 64)


def test_embedding_links_against_all_pairs(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    odd = [(900_001, None), (900_002, [0.0] * len(rows[0][1])), (900_003, [math.nan] * len(rows[0][1])), (900_004, [math.inf, *rows[0][1][1:]]), (900_005, rows[0][1]), (900_006, [])]
    odd = [(i, [float(v) for v in e] if e is not None else None) for i, e in odd]
    table = df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).unionByName(spark.createDataFrame(odd, "vec_id long, embedding array<double>"))
    rows = [(i, [float(v) for v in e] if e is not None else None) for i, e in rows] + odd
    good = [(i, np.array(e)) for i, e in rows if e and all(map(math.isfinite, e)) and any(e)]
    x = np.stack([e / np.linalg.norm(e) for _, e in good])
    a, b = np.nonzero(np.triu(x @ x.T >= 0.95, 1))
    ids = [i for i, _ in good]
    near = collections.Counter([ids[k] for k in a] + [ids[k] for k in b])
    low = lowest([i for i, _ in rows], [(ids[p], ids[q]) for p, q in zip(a, b, strict=True)])
    for cell in (4096, 64):
        got = embedding_dedup.embedding_components(table, cell=cell).collect()
        assert sorted((r["id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == sorted((i, near[i], low[i], i == low[i]) for i, _ in rows)


def planted(kind, n, seed=2):
    """Vectors of 16 numbers with near pairs and chains of them that wander far, and some exact repeats."""
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, 16))
    if kind == "low rank":
        base = r.normal(size=(n, 4)) @ r.normal(size=(4, 16)) * 3 + r.normal(size=16)
    if kind == "one side":
        base += 2 * r.normal(size=16)
    out = [base]
    for k in range(60):
        v = base[k].copy()
        for _ in range(12):  # a chain: each is near the last
            v = v + r.normal(size=16) * 0.055 * np.linalg.norm(v)
            out.append(v[None])
    out += [base[100:140] * 3, base[200:220]]
    return np.concatenate(out)


@pytest.mark.parametrize(("kind", "n", "cell", "block"), [("all sides", 9000, 4096, 4096), ("all sides", 3000, 64, 50), ("low rank", 2500, 64, 128), ("one side", 2500, 100, 4096)])
def test_no_embedding_link_is_lost_across_cells(spark, kind, n, cell, block):
    x = planted(kind, n)
    ids = [int(i) for i in np.random.default_rng(7).permutation(len(x))]
    ids[5] = ids[6]  # an id twice
    rows = [(i, v.tolist(), "clash", 1) for i, v in zip(ids, x, strict=True)] + [(99_999, [1.0, 2.0], "clash", 1), (99_998, [2.0, 4.0], "clash", 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, gid string, m int").repartition(5)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(u @ u.T >= 0.95, 1))
    near, low = np.bincount(np.concatenate([a, b]), minlength=len(x)), lowest(range(len(x)), zip(a.tolist(), b.tolist(), strict=True))
    least = {}
    for k, i in enumerate(ids):
        least[low[k]] = min(least.get(low[k], i), i)
    want = [(i, int(near[k]), least[low[k]], i == least[low[k]]) for k, i in enumerate(ids)] + [(99_999, 1, 99_998, False), (99_998, 1, 99_998, True)]
    got = embedding_dedup.embedding_components(table, cell=cell, block=block).collect()
    assert len(a) > 700 and sorted(map(tuple, got)) == sorted(want)


def test_sentencepiece_equals_the_library(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    want = collections.Counter()
    for i, t in rows_of(docs):
        ids = lib.encode(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, sp_bpe.encode_digests(docs, path).collect())) == want
    for r in sp_bpe.encode(docs, path).collect():
        assert r["decoded"] == lib.decode(r["ids"])


def brute_fingerprint(t):
    words = WORD.findall((t or "").translate(LOWER))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_all_pairs(docs):
    rows = [(i, t) for i, t in rows_of(docs) if t is None or len(t) < 50_000]
    some = docs.filter("text IS NULL OR length(text) < 50000")
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    at = range(len(fps))
    low = lowest(at, [(p, q) for p in at for q in at if p < q and (fps[p][1] ^ fps[q][1]).bit_count() <= 2])
    least = {}
    for p, (i, _) in enumerate(fps):
        if i is not None:
            least[low[p]] = min(least.get(low[p], i), i)
    want = sorted(((i, f"{fp:016x}", least.get(low[p])) for p, (i, fp) in enumerate(fps)), key=str)
    got = simhash.simhash_components(some, n=3, max_bits=2).select("id", simhash.fp_hex(F.col("fp")), "component_id").collect()
    assert sorted(map(tuple, got), key=str) == want


def test_print_links_join_all_near_prints(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = {x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for x in base for _ in range(40)}
    fps |= {0x1234 << 48 | 1 << a | 1 << b for a in range(40) for b in range(40)}  # long lists
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in fps]
    got = simhash.print_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 2).collect()
    near = [(a, b) for k, a in enumerate(signed) for b in signed[:k] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    assert lowest(signed, [(r["a"], r["b"]) for r in got]) == lowest(signed, near)


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (500, 400)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == lowest({x for p in real for x in p}, real)


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    texts, group = [], []
    for g in range(60):
        words = rng.choices(vocabulary, k=rng.randint(80, 300))
        for copy in range(1 if g % 2 else 4):
            new = list(words)
            if copy:
                new[rng.randrange(len(new))] = "edited"
            texts.append(" ".join(new))
            group.append(g)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    kept = {r["doc_id"] for r in near_dedup.drop_near_copies(df).collect()}
    assert kept == {group.index(g) for g in range(60)}


def test_near_dedup_of_awkward_rows(awkward, nothing):
    got = near_dedup.drop_near_copies(awkward)
    ids = [r["doc_id"] for r in got.select("doc_id").collect()]
    assert got.columns == awkward.columns and {1, 2, 3, 7, 8, None} <= set(ids) and not {4, 12} & set(ids)
    assert near_dedup.drop_near_copies(nothing).count() == 0


def test_empty_tables_give_no_rows(spark, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert sharding.shard(nothing).count() == 0
    assert substring_dedup.dedup_lines(nothing).count() == 0
    assert exact_dedup.exact_dedup(nothing).count() == 0 and exact_dedup.drop_copies(nothing).count() == 0
    assert lang_id.predict(nothing, lang_id.train(nothing)).count() == 0
    assert lm_score.score(nothing, lm_score.train(nothing)).count() == 0
    assert packing.pack_documents(nothing, path).count() == 0
    assert sp_bpe.encode_digests(nothing, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    assert simhash.simhash_components(nothing).count() == 0
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert embedding_dedup.embedding_components(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body>
<header><h1>Site name</h1><nav><ul><li><a href=/>Home</a><li><a href=/a>News</a></ul></nav></header>
<main><article><h1>A walk along the harbour &amp; back</h1>
<p>The  first paragraph of the story tells how the painters counted seven copper kettles on a quiet morning.</p>
<p>The second one goes on at some length about the old harbour walls, caf&eacute;s, and the people who live nearby.</p>
</article></main><aside><p><a href=/x>Related: ten more stories</a></p></aside>
<div class="comments"><p>Great post, thanks for sharing!</p></div><form><label>Your email</label></form>
<footer><p>Copyright 2020. All rights reserved. <a href=/p>Privacy</a></p></footer></body></html>"""


def test_html_extraction(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p"), (4, "u", "<p"), (None, "u", "<nav><a href=/>Home</a></nav>"), (5, "u", "<div>" * 3000 + "x")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    text = next(r["text"] for r in got if r["page_id"] == 1)
    assert "The first paragraph of the story" in text and "cafés, and the people" in text and "\n\n" in text
    assert not any(x in text for x in ("Home", "Great post", "Copyright", "Related", "email", "var x"))
    assert all(r["text"] == "" for r in got if r["page_id"] in (2, 3))
