"""Near-copies against brute force at a Jaccard similarity of 0.8 of five-word shingle sets."""

import random

import pytest

from shutterlake.llm import near_dedup, simhash
from shutterlake.llm.components import connected_components


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def edit(rng, words, vocabulary, kind, share):
    k = max(1, int(len(words) * share))
    passage, at = rng.choices(vocabulary, k=k), rng.randrange(len(words))
    if kind == "scatter":
        return [rng.choice(vocabulary) if rng.random() < share / 6 else w for w in words]
    return {"append": words + passage, "cut": words[: len(words) - k], "insert": words[:at] + passage + words[at:]}[kind]


def leads(texts):
    """The smallest index that each text reaches by links at 0.8, and how many pairs lie between 0.6 and 0.8."""
    sets, root, below = [shingles(t) for t in texts], list(range(len(texts))), 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            s = len(a & sets[j]) / len(a | sets[j])
            below += 0.6 <= s < 0.8
            if s >= 0.8:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], below


def made(kinds, shares, groups=40):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    texts = []
    for _ in range(groups):
        words = rng.choices(vocabulary, k=rng.randint(60, 400))
        texts.append(" ".join(words))
        texts += [" ".join(edit(rng, words, vocabulary, kind, rng.uniform(*shares))) for kind in kinds]
    return texts


def same_as_brute_force(spark, texts):
    want, below = leads(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in near_dedup.drop_near_copies(df).collect()} == set(want)
    return want, below


def test_pairs_below_the_similarity_stay(spark):
    want, below = same_as_brute_force(spark, made(["scatter", "append", "cut", "insert"], (0.2, 0.4)))
    assert below > 60 and len(set(want)) > 150


@pytest.mark.parametrize("kind", ["append", "cut", "insert", "scatter"])
def test_pairs_at_the_similarity_go_whatever_the_edit(spark, kind):
    want, _ = same_as_brute_force(spark, made([kind] * 3, (0.01, 0.22)))
    assert len(set(want)) <= len(want) - 60


def test_long_posting_lists_lose_no_link(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    words, texts = rng.choices(vocabulary, k=300), []
    for k in range(150):  # a chain of copies, each an edit of the last; its ends are alike no more
        words = list(words)
        words[(k * 2) % 300] = f"edit{k}"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    texts += [" ".join(w if rng.random() > 0.05 else rng.choice(vocabulary) for w in texts[0].split()) for _ in range(60)]
    want, below = same_as_brute_force(spark, texts)
    assert below > 100 and len(set(want)) > 10


def test_simhash_gives_the_pairs_of_its_prints(spark):
    texts = made(["scatter"], (0.01, 0.06), 30)
    texts += [texts[0].upper(), "", " \n", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    prints = [simhash.majority(simhash.shingles(simhash.words(t), 3)) for t in texts]
    near = {(i, j) for j in range(len(texts)) for i in range(j) if prints[i] and prints[j] and (prints[i] ^ prints[j]).bit_count() <= 2}
    got = {(r["a"], r["b"]) for r in near_dedup.print_pairs(rows).collect()}
    assert got <= near and (0, 60) in got and len(got) > 1
    links = lambda pairs: {(r["node"], r["label"]) for r in connected_components(spark.createDataFrame(list(pairs), "a long, b long")).collect()}
    assert links(got) == links(near)


@pytest.mark.parametrize("local", [0, 1 << 18])
def test_components_on_the_driver_or_by_rounds(spark, local):
    pairs = [(i, i + 1) for i in range(40, 0, -1)] + [(100, 90), (90, 100), (7, 7), (-5, 100)]
    links = spark.createDataFrame(pairs, "a long, b long")
    want = {(i, 1) for i in range(1, 42)} | {(i, -5) for i in (-5, 90, 100)}
    assert {(r["node"], r["label"]) for r in connected_components(links, local).collect()} == want
