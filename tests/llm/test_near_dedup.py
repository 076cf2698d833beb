"""The pipeline's near-duplicate stage against brute force."""

import itertools

import corpus_pipeline

from .test_llm import LONG, SCHEMA, SF, WORDS, plain_shingles


def plain_kept(texts, least=0.8):
    """The smallest id of each class of texts linked by Jaccard similarity."""
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both >= least * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {find(i) for i in sets}


def edited(text, edits, start=0):
    """``edits`` words replaced, evenly dealt."""
    w = text.split()
    for k in range(edits):
        w[(start + k * len(w) // edits) % len(w)] = f"edit{start}{k}"
    return " ".join(w)


def test_near_copies_against_brute_force(spark):
    """Copies with ever more edits, half of them chained: each is near to the one before, not to the first."""
    words = LONG.split()
    texts = {}
    for g in range(12):
        base = " ".join(words[g * 400 : g * 400 + 300])
        for e in range(1, 12):
            texts[g * 100 + e] = edited(base, e, e)
        chain = " ".join(WORDS[(i * 5 + g * 7 + i // 11) % 24] + str(i * (g + 3) % 89) for i in range(250))
        for e in range(6):
            texts[5000 + g * 100 + e] = chain = edited(chain, 3, 17 * e + 1)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], SCHEMA)
    got = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, SF).collect()}
    want = plain_kept(texts)
    assert got == want and len(want) < len(texts) - 60


def test_near_copies_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, SF).collect()} == plain_kept(texts)
