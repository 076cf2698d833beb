"""Corpus operators against plain versions, and on awkward tables."""

import collections
import hashlib
import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from paperline.llm import bpe, exact_dedup, licenses, line_dedup, packing, quality_model, quality_rules, registry, secrets, sharding, simhash

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
LONG = " ".join(WORDS[(i * i + i // 7) % 24] + str(i % 97) for i in range(20000))
SENTENCE = "One quiet morning the old ferry left its harbour with nine travellers and a grey dog aboard."
ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, LONG, "en", "a", len(LONG)), (5, SENTENCE, "en", "a", 9), (6, SENTENCE, "en", "b", 9), (6, SENTENCE, "en", "b", 9),
    (7, SENTENCE + " ", "en", "b", 9), (None, SENTENCE, "en", None, None), (8, "x", "en", "a", 1), (8, "y", "en", "a", 1), (9, "é ß 中文 😀   end", "en", "a", 5), (None, None, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, equal rows, a repeated doc_id, and columns whose names the operators use themselves."""
    names = ["fp", "component_id", "size", "shard", "name", "line", "kept", "score", "value", "ids", "level", "runs", "bucket"]
    return spark.createDataFrame(ROWS, SCHEMA).select("*", *[F.lit("clash").alias(c) for c in names]).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def plain_texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def plain_shingles(text, k=5):
    w = bytes(text or "", "utf-8").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def plain_fingerprint(text, k=3):
    w = bytes(text or "", "utf-8").lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


# 1
def test_simhash_against_brute_force(spark, docs):
    base = plain_texts(docs)
    rows = [(i, t, None, None, None) for i, t in base.items()]
    rows += [(1000 + i, t.replace(" the ", " a ", 1) if i % 2 else t + " tail", None, None, None) for i, t in base.items() if i < 90]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    fps = {i: plain_fingerprint(t) for i, t, *_ in rows}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {i: (f"{f:016x}", find(i)) for i, f in fps.items()}
    assert len({c for _, c in got.values()}) < len(got)


def test_simhash_lower_bound_and_grid(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    near = np.array([int(x) ^ int(sum(1 << int(b) for b in rng.choice(64, 1 + i % 5, replace=False))) for i, x in enumerate(np.tile(base, 4))], dtype=np.uint64)
    fps = sorted({int(x) for x in np.concatenate([base, near])} | {0, 2**64 - 1, 2**64 - 2})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {tuple(sorted((r.u, r.v))) for r in simhash.links(df).collect()}
    assert got == {tuple(sorted((signed(a), signed(b)))) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 3}
    both = df.alias("a").join(df.alias("b"))
    bound = both.select(simhash.manhattan(simhash.segment_counts(F.col("a.fp")), simhash.segment_counts(F.col("b.fp"))).alias("m"), F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))).alias("h"))
    assert bound.where("m > h").count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "u long, v long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1001: 1000}


def test_simhash_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ROWS) and simhash.near_duplicates(none).count() == 0
    blank = [r for r in got if r.fingerprint == "0" * 16]
    assert len(blank) == 4 and {r.component_id for r in blank} == {1}
    assert {r.component_id for r in got if r.doc_id in (5, 6, 7)} == {5}
    kept = simhash.dedup(odd)
    assert kept.columns == odd.columns and kept.where(F.col("text") == SENTENCE).count() == 1 and simhash.dedup(none).count() == 0


# 2
def plain_lines(text):
    """A walk over the characters: a line ends before blanks that follow a sentence's mark or hold a newline, if a word follows."""
    blank, out, start, i = " \t\n\x0b\x0c\r", [], 0, 0
    while i < len(text):
        if text[i] in blank:
            end = i
            while end < len(text) and text[end] in blank:
                end += 1
            if i > 0 and end < len(text) and (text[i - 1] in ".!?" or "\n" in text[i:end]):
                out.append(text[start:i])
                start = i
            i = end
        else:
            i += 1
    return [*out, text[start:]]


def plain_line_dedup(docs):
    rows = sorted((i, plain_lines(t or "")) for i, t in docs.items())
    seen, gone = set(), collections.defaultdict(set)
    for i, ls in rows:
        folded = [" ".join(x.split()) for x in ls]
        for k in range(len(ls) - 2):
            window = tuple(folded[k : k + 3])
            if window in seen:
                gone[i] |= {k, k + 1, k + 2}
            seen.add(window)
    return {i: (len(ls), len(gone[i]), "".join(x for k, x in enumerate(ls) if k not in gone[i])) for i, ls in rows}


def line_rows(spark, texts):
    return {r.doc_id: (r.n_lines, r.n_removed, r.cleaned) for r in line_dedup.dedup(spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], SCHEMA)).collect()}


def test_line_dedup_against_brute_force(spark):
    texts = {1: "a\nb\nc\nd\ne", 2: "x\na\nb\nc\ny", 3: "q\nq\nq\nq\nq", 4: "b\nc\nd\ne\nf\na\nb\nc", 5: "a\nb", 6: "\n\n\n\n", 7: None, 8: "z\na\nb\nc\nd\ne\nw", 9: "", 10: "a. b!c d?  e.\n \n f .g. \n"}
    got = line_rows(spark, texts)
    assert got == plain_line_dedup(texts)
    assert got[3][1] == 4 and got[8][2] == "z\nw" and got[10][0] == 4


def test_line_dedup_of_carriage_returns(spark):
    """Lines that end in CRLF, with blank ones between: only what repeats goes."""
    texts = {1: "One is here.\r\n\r\n\r\nTwo is here.\r\n\r\n\r\nThree is here.\r\n", 2: "Four is here.\r\n\r\n\r\nFive is here.\r\n\r\n\r\nSix is here.\r\n", 3: "A.\r\n\r\nOne is here.\r\nTwo is here.\r\nThree is here.\r\n\t\r\nB."}
    got = line_rows(spark, texts)
    assert got == plain_line_dedup(texts) and got[1][2] == texts[1] and got[2][2] == texts[2] and got[3][2] == "A.\r\n\t\r\nB."


def test_line_dedup_of_passages_inside_lines(spark):
    """A passage of over 50 words inside a long line, with other line ends and blanks in its copies."""
    rng = np.random.default_rng(2)
    sentence = lambda: " ".join(WORDS[int(k)] + str(rng.integers(0, 99)) for k in rng.integers(0, 24, rng.integers(5, 14))) + "."
    passage = [sentence() for _ in range(8)]
    own = [[sentence() for _ in range(12)] for _ in range(6)]
    joins = [" ", "\n", "  ", " ", "\r\n", " "]
    texts = {i: joins[i].join(own[i][:6] + passage + own[i][6:]) for i in range(6)}
    got = line_rows(spark, texts)
    assert got == plain_line_dedup(texts) and got[0][2] == texts[0]
    assert all(got[i][2] == joins[i].join(own[i]) for i in range(1, 6))


def test_line_dedup_whole_table(docs):
    got = {r.doc_id: (r.n_lines, r.n_removed, r.cleaned) for r in line_dedup.dedup(docs).collect()}
    assert got == plain_line_dedup(plain_texts(docs))


def test_line_dedup_odd_rows(spark, odd, none):
    got = line_dedup.dedup(odd).collect()
    assert len(got) == len(ROWS) and line_dedup.dedup(none).count() == 0
    assert all(r.n_removed == 0 for r in got)
    text = " ".join(f"{w} {i}." for i, w in enumerate(LONG.split()))
    many = spark.createDataFrame([(i, text, None, None, None) for i in (3, 3, None, 1)], SCHEMA)
    assert sorted((r.n_removed, len(r.cleaned)) for r in line_dedup.dedup(many).collect()) == [(0, len(text))] + [(20000, 0)] * 3


# 3
def test_quality_base_statistics(docs):
    def brute(t):
        w = [x.decode() for x in (t or "").encode().split()]
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        often = collections.Counter(windows)
        covered = {j for i, x in enumerate(windows) if often[x] > 1 for j in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)

    texts = plain_texts(docs)
    for r in quality_rules.quality(docs).collect():
        b = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 10 or 100 * b[4] > 20 * b[0])
        assert not (r.base_failed and r.kept)


def test_quality_lines():
    good = "The ferry left the harbour early and came back before the evening storm reached the old town walls."
    for bad in ("A&&& b### c*** d$$$ e%%%", "HOME!! NOW!! GO!! BUY!!", "Home | News | About | Help | Login", "We use cookies. See our privacy policy.", "go go go go go go go go go"):
        m = quality_rules.measure(f"{good}\n{bad}\n{good} Again.")
        assert m[-1] == f"{good}\n{good} Again." and m[7] == 1, bad
    assert quality_rules.measure(good)[6] and quality_rules.measure(good)[-1] == good
    assert not quality_rules.measure("&&& *** " * 40)[6]


def test_quality_labels_agree(spark):
    sf = "/root/testdata/sf0.01"
    found = quality_rules.quality(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed")
    good, bad = found.where("quality = 1"), found.where("quality = 0")
    assert good.where("not kept").count() <= 0.01 * good.count() and bad.where("kept").count() <= 0.1 * bad.count()


def test_quality_odd_rows(odd, none):
    got = quality_rules.quality(odd).collect()
    assert len(got) == len(ROWS) and quality_rules.quality(none).count() == 0
    assert all(r.base_failed and r.n_words == 0 for r in got if r.doc_id in (1, 2, 3))
    kept = quality_rules.clean(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in ROWS if quality_rules.measure(r[1])[6]} >= {5, 6, 7, None} and quality_rules.clean(none).count() == 0


# 4
def plain_groups(rows):
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0, i))
    return {p: (min(g)[3], len(g), hashlib.sha256(p.encode()).hexdigest()) for p, g in groups.items()}, norm


@pytest.mark.parametrize("seeds", [(0, 1), (-3, 0), (-1, -2, 5)])
def test_exact_dedup_against_brute_force(spark, seeds):
    """Seeds below zero give keys so short that blocks share them; names must come out right all the same."""
    texts = ["abcdefgh" * 3, "abcdefgh" * 3 + "i", "a b c d e f g h" * 3, "abcdefgi" * 3, "", None, " ", "é中😀" * 5, "é中 😀" * 5, "z" * 40, "z" * 41, LONG[:300], LONG[:300] + " "]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    want, norm = plain_groups(rows)
    for r in exact_dedup.exact_duplicates(df, size=7, seeds=seeds).collect():
        keep, size, sha = want[norm(texts[r.doc_id])]
        assert (r.keep_id, r.group_size, r.text_sha256, r.kept) == (keep, size, sha, keep == r.doc_id)


def test_exact_dedup_gives_up_on_shared_keys(spark):
    df = spark.createDataFrame([(1, "abc", None, None, None), (2, "xyz", None, None, None)], SCHEMA)
    with pytest.raises(RuntimeError):
        exact_dedup.exact_duplicates(df, seeds=(-1,)).count()


def test_exact_dedup_odd_rows(odd, none):
    got = exact_dedup.exact_duplicates(odd).collect()
    assert len(got) == len(ROWS) and exact_dedup.exact_duplicates(none).count() == 0
    want, norm = plain_groups([(r[0], r[1]) for r in ROWS])
    assert collections.Counter((r.keep_id, r.group_size, r.text_sha256) for r in got) == collections.Counter(want[norm(r[1])] for r in ROWS)
    assert sum(r.kept for r in got) == len(want)
    kept = exact_dedup.dedup(odd)
    assert kept.columns == odd.columns and kept.count() == len(want) and exact_dedup.dedup(none).count() == 0


# 5
@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_equals_library(docs, name):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    texts = plain_texts(docs)
    for r in bpe.encoded(docs, path).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_forced_boundaries(name):
    import random

    path, rng = public_tokenizers.path(name), random.Random(11)
    codec, library, fast = bpe.Codec(path), Tokenizer.from_file(path), bpe.Codec(path, by_library=True)
    parts = [" ", "  ", "\n", "\t", "\r\n", "'s", "don't", "'", "a", "B", "é", "à", "ÉÇ", "1", "23", " ", "́", "Σ", "İ", "<|endoftext|>", "😀", "ß", "中", "à ", "  ", ".", "!!", "\x1c", "\x85", "Å", "ﬁ", "-", "_", "word.", "(x)", "µ", "ª"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 10)))
        ids = library.encode(text, add_special_tokens=False).ids
        raw = codec.encode(text)
        assert np.frombuffer(raw, "<u4").tolist() == ids and codec.decode(raw) == library.decode(ids, skip_special_tokens=False), repr(text)
        assert "".join(codec.fragments(text)) == text and fast.encode(text) == raw
    for f in codec.fragments("He said “go”, à la carte.  Then\nleft."):
        assert f


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_cuts_at_every_pair_inside_no_token(name):
    """Long texts without a blank, as the library has them; pieces hold no pair that the vocabulary lacks, and every cut is one."""
    codec, library = bpe.Codec(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    for text in ("a" * 60000, "中文" * 20000, "=" * 30000, "é1.x" * 20000, LONG.replace(" ", "")):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    inside = {t[k : k + 2] for t in (x.removesuffix("</w>") for x in library.get_vocab(False)) for k in range(len(t) - 1)}
    word = "xqé7ßzjqvûx%ñq".encode()
    shown, at = "".join(codec.shown[b] for b in word), codec.cuts(word)
    assert [k for k in range(1, len(word)) if shown[k - 1 : k + 1] not in inside] == at[1:-1] and len(at) > 3
    assert len(codec.memory) == 0 and all(len(p) <= bpe.LONGEST for p, _ in codec.pieces)


def test_merges_by_heap_and_by_list():
    rng = np.random.default_rng(5)
    for _ in range(300):
        pairs = {int(a) * bpe.PAIR + int(b) for a, b in rng.integers(0, 12, (14, 2))}
        ranks, made = {p: i for i, p in enumerate(sorted(pairs, key=hash))}, [int(x) for x in rng.integers(0, 12, len(pairs))]
        symbols = rng.integers(0, 12, int(rng.integers(0, bpe.MANY))).tolist()
        assert bpe._merged_by_heap(list(symbols), ranks, made) == bpe.merged(list(symbols), ranks, made)


def test_bpe_odd_rows(odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = bpe.digests(odd, path).collect()
    assert len(got) == len(ROWS) and bpe.digests(none, path).count() == 0
    assert {r.ids_sha256 for r in got if r.doc_id in (1, 2, 3)} == {hashlib.sha256(b"").hexdigest()}


# 6
@pytest.fixture(scope="module")
def scanner(spark):
    return licenses.train(spark)


def test_licences(spark, scanner):
    texts = {
        "mit": "Some prose before.\nReleased under the MIT License.\nSome prose after.", "apache-2.0": "Licensed under the Apache License, Version 2.0.", "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
        "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.", "": "The driver had no licence. All rights reserved.\nA permission was given by the public house.", "gpl-3.0,mit": "Released under the MIT License.\nDistributed under the terms of the GNU General Public License v3.0.",
    }
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts.values())], SCHEMA)
    got = {r.doc_id: r.families for r in licenses.scan(df, scanner).collect()}
    assert got == dict(enumerate(texts))


def test_licence_scores_against_plain(spark, scanner):
    lines = [t for t, _ in licenses.examples(seed=99, copies=1)][:120]
    df = spark.createDataFrame(list(enumerate(lines)), "id long, text string")
    got = {r.id: r for r in licenses.score(df.select("id", licenses.ngrams(licenses.words("text")).alias("grams")), scanner, ["id"]).collect()}
    anchors = set(scanner.anchors())
    for i, line in enumerate(lines):
        w = licenses.plain_words(line)
        grams = {" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)}
        z = np.array(scanner.intercepts) + sum((np.array(scanner.weights[g]) for g in grams if g in scanner.weights), np.zeros(len(scanner.families)))
        p = np.exp((z - z.max()) / scanner.temperature) / np.exp((z - z.max()) / scanner.temperature).sum()
        assert got[i].best == scanner.families[int(z.argmax())] and abs(got[i].probability - p.max()) < 1e-4
        assert anchors & set(w) or not (grams & set(scanner.weights))


def test_licences_held_out(spark, scanner):
    made = [(i, t, f) for i, (t, f) in enumerate(licenses.examples(seed=1234, copies=2))]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t, _ in made], SCHEMA)
    got = {r.doc_id: r.families for r in licenses.scan(df, scanner).collect()}
    known = [(got[i], f) for i, _, f in made if f != licenses.UNKNOWN]
    other = [got[i] for i, _, f in made if f == licenses.UNKNOWN]
    assert sum(g == f for g, f in known) >= 0.8 * len(known) and sum(g not in (f, "") for g, f in known) <= 0.05 * len(known) and sum(g != "" for g in other) <= 0.01 * len(other)


def plain_scan(text, scanner):
    """Paragraphs, believed and confirmed ones, families and the highest probability of a text, walked line by line."""
    triples = {f: {" ".join(w[i : i + 3]) for t in texts for w in [licenses.plain_words(t)] for i in range(len(w) - 2)} for f, texts in licenses.templates().items()}
    lines, believed, confirmed, families, top = (text or "").split("\n"), 0, 0, set(), 0.0
    for line in lines:
        w = licenses.plain_words(line)
        grams = {" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)}
        z = np.array(scanner.intercepts) + sum((np.array(scanner.weights[g]) for g in sorted(grams) if g in scanner.weights), np.zeros(len(scanner.families)))
        e = np.exp((z - z.max()) / scanner.temperature)
        p, best = round(float(e.max() / e.sum()), 6), scanner.families[int(z.argmax())]
        if best == licenses.UNKNOWN or p < scanner.believed:
            continue
        own = {" ".join(w[i : i + 3]) for i in range(len(w) - 2)}
        sure = len(own & triples[best]) >= 3 or len(own & triples[best]) == len(own) >= 1
        believed, confirmed, top = believed + 1, confirmed + sure, max(top, p)
        families |= {best} if sure else set()
    return sum(1 for x in lines if x.encode().split()), believed, confirmed, ",".join(sorted(families)), top


def test_licence_scan_against_plain(spark, docs, scanner):
    """The whole scan, over documents and made paragraphs; and the same of a table that holds every row three times."""
    made = [(10**6 + i, t + "\nA line.\n" + u) for i, ((t, _), (u, _)) in enumerate(itertools.pairwise(licenses.examples(seed=5, copies=1)))]
    rows = [*plain_texts(docs).items(), *made, (10**7, "Creative Commons Attribution 4.0"), (10**7 + 1, "BSD License redistribution")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    once = {tuple(r) for r in licenses.scan(df, scanner).collect()}
    want = {i: plain_scan(t, scanner) for i, t in rows}
    for i, *found, p in once:
        assert tuple(found) == want[i][:-1] and abs(p - want[i][-1]) < 1e-5
    thrice = licenses.scan(df.union(df).union(df), scanner).collect()
    assert len(thrice) == 3 * len(rows) and {(r[0], *r[1:5], round(r[5], 4)) for r in thrice} == {(r[0], *r[1:5], round(r[5], 4)) for r in once}
    assert scanner.temperature in licenses.TEMPERATURES and 0.5 <= scanner.believed < 1


def test_licences_odd_rows(odd, none, scanner):
    got = licenses.scan(odd, scanner).collect()
    assert len(got) == len(ROWS) and licenses.scan(none, scanner).count() == 0 and all(r.families == "" for r in got)


# 7
def check_packing(rows, docs, size=1024):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = collections.Counter()
    for i, t in docs:
        ids, start = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4"), 0
        stop, piece = len(ids) % size or size, 0
        while start < len(ids):
            want[i, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes())] += 1
            start, stop, piece = stop, stop + size, piece + 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= size
    return len(bins), -(-sum(k[3] * n for k, n in want.items()) // size)


def test_packing(docs):
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    used, least = check_packing(rows, list(plain_texts(docs).items()))
    assert used <= 1.02 * least + 1


def test_packing_rounds(spark):
    lengths = [1 + (i * 7919) % 1024 for i in range(3000)]
    parts = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(6)
    got = packing.packed(parts, at_once=200)
    fills = [r.s for r in got.groupBy("sequence_id").agg(F.sum("length").alias("s")).collect()]
    assert max(fills) <= 1024 and sum(fills) == sum(lengths) and got.count() == 3000
    alone = len(packing.best_fit(np.array(lengths), 1024))
    assert len(fills) <= 1.02 * alone + 1


def test_packing_that_cannot_merge_ends(spark):
    parts = spark.createDataFrame([(i, 0, 0, 600, 0) for i in range(500)], "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(4)
    assert packing.packed(parts, at_once=50).select("sequence_id").distinct().count() == 500


def test_packing_odd_rows(odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    check_packing(packing.pack(odd, path).collect(), [(r[0], r[1]) for r in ROWS])
    assert packing.pack(none, path).count() == 0


# 8
def test_quality_model_held_out(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_model.fit(d, labels)
    got = quality_model.scored(d, model).join(labels, "doc_id").collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    out = [r for r in got if r.held_out]
    assert sum(r.predicted == r.quality for r in out) >= 0.95 * len(out)
    assert model.weights and all(rule for rule in model.weights)


def test_quality_model_ignores_other_columns(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_model.fit(docs, labels)
    moved = docs.select((F.col("doc_id") + 1).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit("yy").alias("source"), F.lit(0).alias("n_chars"))
    a = {r.doc_id + 1: r.score for r in quality_model.scored(docs, model).collect()}
    assert a == {r.doc_id: r.score for r in quality_model.scored(moved, model).collect()}


def test_quality_model_odd_rows(spark, odd, none, docs):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (5, None, 0), (8, 0, 0), (8, 1, 1)], "doc_id long, quality int, toxic int")
    for source in (odd, none):
        model = quality_model.fit(source, labels)
        assert quality_model.scored(source, model).count() == source.count()
    assert quality_model.fit(docs, labels.limit(0)).score({}) is not None
    ensemble = quality_model.Ensemble(0.5, {(("words", True, 3.0),): 2.0})
    assert all(0 <= r.score <= 1 for r in quality_model.scored(odd, ensemble).collect())


# 9
def check_shards(rows, docs, count=40):
    size = lambda t: len((t or "").encode()) + 16
    want = collections.Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in docs)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots, weight = collections.defaultdict(list), collections.Counter()
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < count
        slots[r.shard].append(r.slot)
        weight[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total, largest = sum(weight.values()), max(size(t) for _, t in docs)
    assert all(abs(weight[k] - total / count) <= largest + 1 for k in range(count))


def test_shards(docs):
    check_shards(sharding.shards(docs).collect(), list(plain_texts(docs).items()))


def test_shards_of_a_large_group(spark):
    docs = [(i, "same text" if i % 3 == 0 else f"text number {i * i}") for i in range(3000)]
    rows = sharding.shards(spark.createDataFrame([(i, t, None, None, None) for i, t in docs], SCHEMA)).collect()
    check_shards(rows, docs)


def test_small_groups_stay_whole(spark):
    docs = [(i, f"text {i % 500} " * 5) for i in range(1000)] + [(5000, "z" * 4000)]
    rows = sharding.shards(spark.createDataFrame([(i, t, None, None, None) for i, t in docs], SCHEMA), count=10).collect()
    by_text = collections.defaultdict(set)
    for r in rows:
        by_text[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())


def test_shards_odd_rows(odd, none):
    rows = sharding.shards(odd).collect()
    assert len(rows) == len(ROWS) and sharding.shards(none).count() == 0
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


# 10
@pytest.fixture(scope="module")
def forest(spark):
    return secrets.train(spark)


def test_secrets_held_out(spark, forest):
    test = spark.createDataFrame(secrets.labelled_findings(1500, 99), "value string, before string, after string, path string, label int")
    got = forest.forest.transform(test.select("label", *secrets.features(F.col("value"), F.col("before"), F.col("after"), F.col("path"), forest.pairs)))
    assert got.where("label = prediction").count() >= 0.97 * 1500


def test_secrets_in_texts(spark, forest):
    key, token, commit = "AKIA" + "QZ7PL2MXT4RBW9KD", "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", "2fd4e1c67a2d28fced849ee1bb76e7391b93eb12"
    texts = [f'Prose before token = "{token}" and after.', f"key {key} in a text", f"commit {commit} fixed it", "password = changeme_please", "nothing here", None, f'token = "{token}"\nand again token = "{token}"']
    df = spark.createDataFrame([(i, t, None, "src", 7) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in secrets.report(df, forest).collect()}
    assert [got[i].n_secrets for i in range(7)] == [1, 1, 0, 0, 0, 0, 1]
    assert got[0].secret_sha256 == hashlib.sha256(token.encode()).hexdigest()
    clean = {r.doc_id: r for r in secrets.redacted(df, forest).collect()}
    assert clean[0].text == 'Prose before token = "[SECRET]" and after.' and clean[0].n_chars == len(clean[0].text)
    assert clean[6].text.count("[SECRET]") == 2 and clean[2].text == texts[2] and clean[2].n_chars == 7 and clean[5].text is None


def test_secrets_odd_rows(odd, none, forest):
    assert secrets.report(odd, forest).count() == len(ROWS) and secrets.report(none, forest).count() == 0
    kept = secrets.redacted(odd, forest)
    assert kept.columns == odd.columns and collections.Counter(r.text for r in kept.collect()) == collections.Counter(r[1] for r in ROWS)
    assert secrets.redacted(none, forest).count() == 0


# the pipeline
def test_pipeline_against_plain(spark, docs):
    """Each stage against a plain version on what the one before it kept."""
    now = docs
    texts = plain_texts(docs)
    for name, stage in corpus_pipeline.STAGES:
        before, now = texts, stage(spark, now, SF)
        if name != "packing":
            assert now.columns == docs.columns
            now = now.cache()
            texts = plain_texts(now)
        if name == "quality_rules":
            want = {i: (m := quality_rules.measure(t))[-1] for i, t in before.items() if quality_rules.measure(t)[6]}
            assert texts == want
        elif name == "exact_dedup":
            groups, norm = plain_groups(list(before.items()))
            assert set(texts) == {g[0] for g in groups.values()}
        elif name == "near_dedup":
            sets = {i: plain_shingles(t) for i, t in before.items()}
            like = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9
            assert all(any(like(i, j) for j in before if j != i) for i in set(before) - set(texts))
            assert not any(like(a, b) for a, b in itertools.combinations(texts, 2))
        elif name == "secret_scan":
            assert set(texts) == set(before) and not any('token = "' in t and "[SECRET]" not in t for t in texts.values())
        else:
            check_packing(now.collect(), list(before.items()))


def test_pipeline_stages_on_odd_tables(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES:
        for source in (odd.select("doc_id", "text", "lang", "source", "n_chars"), none):
            got = stage(spark, source, SF)
            assert got.count() >= 0 and (name == "packing" or got.columns == source.columns)


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracles(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(f"select {', '.join(columns)} from ({registry.ORACLES[name]})").fetchall()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in df.select(columns).collect()), key=key) == sorted(want, key=key)
