"""Each stage of corpus_pipeline against brute force on what the stage before it left, over planted documents."""

import collections
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_lang_id import TEXTS
from tests.llm.test_near_dedup import leads
from tests.llm.test_substring import plain_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def planted():
    rng = random.Random(8)
    vocabulary = {k: [*t.split(), *("".join(rng.sample(t.lower().replace(" ", ""), 6)) for _ in range(400))] for k, t in TEXTS.items()}
    texts = []
    for i in range(150):
        k = rng.choice(list(TEXTS))
        texts.append((" ".join(w + ("\n" if rng.random() < 0.04 else "") for w in rng.choices(vocabulary[k], k=rng.randint(30, 260))), k if i % 3 else None))
    passage = " ".join(rng.choices(vocabulary["en"], k=70))
    for i in (3, 40, 77, 120):
        w = texts[i][0].split(" ")
        w[len(w) // 2 : len(w) // 2] = [passage]
        texts[i] = (" ".join(w), texts[i][1])
    texts += [texts[i] for i in (1, 5, 5, 5, 9)]  # exact copies
    for i in (10, 20, 30, 31, 32):
        for share in (0.008, 0.015, 0.06):
            texts.append((" ".join(rng.choice(vocabulary["en"]) if rng.random() < share else w for w in texts[i][0].split(" ")), texts[i][1]))
    texts += [(None, None), ("", "en"), ("12 34 ...", None), (" \n", None), ("word " * 20_000, "en")]
    ids = rng.sample(range(1000), len(texts))
    return [(i, t, k, "s", None if t is None else len(t)) for i, (t, k) in zip(ids, texts, strict=True)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before and after each stage, written and read again in between."""
    folder, out = str(tmp_path_factory.mktemp("pipeline")), {}
    spark.createDataFrame(planted(), SCHEMA).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = before.collect(), docs.collect()
        assert name == "packing" or docs.columns == before.columns
    out["run"] = corpus_pipeline.run(spark, folder).collect()
    return out


def texts_of(rows):
    return collections.Counter((r["doc_id"], r["text"]) for r in rows)


def test_language_keeps_what_has_letters(stages):
    before, after = stages["language"]
    letters = [r for r in before if any(c.isalpha() for c in r["text"] or "")]
    assert texts_of(after) <= texts_of(letters) and len(after) >= 0.99 * len(letters)


def test_exact_keeps_the_largest_id_of_equal_texts(stages):
    before, after = stages["exact"]
    last = {}
    for r in before:
        last[r["text"]] = max(last.get(r["text"], -1), r["doc_id"])
    assert texts_of(after) == collections.Counter((i, t) for t, i in last.items()) and len(after) < len(before)


def test_near_keeps_the_smallest_id_of_each_group(stages):
    before, after = stages["near"]
    rows = sorted(before, key=lambda r: r["doc_id"])
    want, _ = leads([r["text"] for r in rows])
    assert texts_of(after) == texts_of([r for i, r in enumerate(rows) if want[i] == i]) and len(after) <= len(before) - 5


def test_substring_cuts_what_a_plain_version_cuts(stages):
    before, after = stages["substring"]
    want = plain_dedup([(r["doc_id"], r["text"]) for r in before])
    assert texts_of(after) == collections.Counter((i, cut) for (_, i, _), (cut, _) in want.items())
    assert all(r["n_chars"] == len(r["text"]) for r in after) and sum(r["n_chars"] for r in after) < sum(r["n_chars"] for r in before)


def test_packing_holds_each_id_once_within_1024(stages):
    before, after = stages["packing"]
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = {r["doc_id"]: len(coder.encode(r["text"], add_special_tokens=False).ids) + 1 for r in before}
    held, full = collections.defaultdict(set), collections.Counter()
    for r in after:
        held[r["doc_id"]] |= set(range(r["start"], r["start"] + r["length"]))
        full[r["sequence_id"]] += r["length"]
    assert {i: len(v) for i, v in held.items()} == size and sum(full.values()) == sum(size.values()) and max(full.values()) <= 1024


def test_run_gives_what_the_stages_give(stages):
    pieces = lambda rows: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    tokens = lambda rows: collections.Counter({i: n for i, n in {(r["doc_id"], r["doc_tokens"]): 1 for r in rows}})
    assert tokens(stages["run"]) == tokens(stages["packing"][1]) and sum(p[2] for p in pieces(stages["run"])) == sum(p[2] for p in pieces(stages["packing"][1]))


def test_empty_documents_give_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_no_stage_names_are_lost():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "substring", "packing"]
