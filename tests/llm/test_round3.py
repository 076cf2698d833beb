"""Operators 11 to 13 against plain versions, and on awkward tables; secrets in further forms."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from paperline.llm import conversations, decontamination, divergence, registry, secrets
from tests.test_oracles import same_rows

from .test_llm import LONG, ROWS, SCHEMA, SENTENCE, SF

CLASHES = ["starts", "items", "window", "n_words", "at", "p", "no", "term", "cell", "fault", "audit", "block"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).select("*", *[F.lit("clash").alias(c) for c in CLASHES]).repartition(3)


@pytest.mark.parametrize("name", ["op11_divergence", "op12_decontamination", "op13_conversations"])
def test_oracle(spark, duck, name):
    same_rows(registry.QUERIES[name](spark, SF), duck, registry.ORACLES[name])


# 11
def plain_divergence(rows, least=3, top=200):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", term.findall((text or "").translate(low))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        kept = [t for t in {w for d in own for w in d[2]} if sum(t in set(d[2]) for d in own) >= least]
        counts = {s: {t: sum(d[2].count(t) for d in own if d[1] == s) for t in kept} for s in {d[1] for d in own}}
        whole = {t: sum(c[t] for c in counts.values()) for t in kept}
        share = lambda c, n=len(kept): {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + n) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            parts = {"pair": {h: sum(f(p[s][t], p[h][t]) for t in kept) for h in counts if h != s}, "term": {t: f(p[s][t], q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]}}
            for part, values in parts.items():
                ranked = sorted(values.items(), key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out)


@pytest.mark.parametrize("block,most", [(256, 10**6), (2, 10**6), (256, 4), (3, 0)])
def test_divergence_against_plain(spark, block, most):
    rng = random.Random(11)
    words = ["The", "the", "né", "NÉ", "ab-cd", "x1y", "中文", "rare", "zz", "ä"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", "d", "é", None]), 1) for i in range(60)]
    rows += [(100, None, "de", "a", 0), (101, "", "de", "b", 0), (102, "only twice", "de", "a", 0), (None, "only twice", "de", "a", 0)]
    got = sorted(tuple(r) for r in divergence.audit(spark.createDataFrame(rows, SCHEMA), most=most, block=block).collect())
    assert got == plain_divergence([(t, lang, s) for _, t, lang, s, _ in rows])
    assert {r[:5] for r in got if r[0] == "de"} == {("de", "a", "pair", "b", 0), ("de", "b", "pair", "a", 0)}


def test_divergence_odd_rows(spark, odd):
    got = sorted(tuple(r) for r in divergence.audit(odd).collect())
    assert got == plain_divergence([(r.text, r.lang, r.source) for r in odd.collect()])
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_counts_stay_exact(spark):
    n = 10**15
    got = spark.range(1).select(divergence.share(F.lit(n).cast("long"), F.lit(3 * n).cast("long")).alias("x")).first().x
    assert got == 1 + 10**9 * (n + 1) // (3 * n)


def test_texts_are_cut_at_delimiters(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 7)
    text = "Alpha beta, gammadelta  eps".encode()
    assert b"".join(divergence.pieces(text)).split() == text.translate(divergence.FOLD).split()


# 12
def plain_matches(text, items, size=10):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = word.findall((text or "").translate(low))
    hit, found = set(), set()
    for item, t in items:
        own = word.findall((t or "").translate(low))
        for i in range(max(1, len(own) - size + 1)) if own else ():
            window = own[i : i + size]
            for k in range(len(words) - len(window) + 1):
                if words[k : k + len(window)] == window:
                    hit.update(range(k, k + len(window)))
                    found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found)


BENCH = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Two"), (10, "a a a a a a a a a a a"), (None, "é–ß 中文 x"), (3, None), (4, "..."), (2, "nine TEN"), (5, "b a a a a a a a a a")]


def test_search_in_pieces(monkeypatch):
    monkeypatch.setattr(decontamination, "CHUNK", 5)
    words = lambda t: tuple(w for c in decontamination.chunks(t.encode()) for w in c)
    tables = [decontamination.Patterns(n, {words(t): [t]}) for n, t in ((3, "one two three"), (1, "three"), (2, "a a"))]
    n, spans, found = decontamination.search("a One, two three a a a one two one two three".encode(), tables)
    assert (n, spans, found) == (12, [(1, 7), (9, 12)], {"one two three", "three", "a a"})


@pytest.mark.parametrize("most", [10**6, 3])
def test_matches_against_plain(spark, most):
    rng = random.Random(12)
    alphabet = "one two three four five six seven eight nine ten a b é–ß 中文 x".split()
    texts = [" ".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(60)]
    texts += ["pre " + BENCH[0][1].upper() + ", post", "a " * 30, "one two three four five six seven eight nine ten", None, "", BENCH[0][1] + " " + BENCH[0][1]]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 1), (None, "two", None, None, None)]
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = decontamination.matches(spark.createDataFrame(rows, SCHEMA), bench, most=most).collect()
    want = sorted([(d, *plain_matches(t, BENCH)) for d, t, *_ in rows], key=repr)
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got], key=repr) == want
    assert all(sum(b - a for a, b in zip(r.starts, r.ends)) == r.n_hit for r in got)


def test_matches_odd_rows(spark, odd):
    bench = spark.createDataFrame([(7, SENTENCE), (8, LONG[:3000])], "item_id long, text string").withColumn("window", F.lit("clash"))
    got = decontamination.report(odd, bench).collect()
    assert len(got) == len(ROWS) and {r.doc_id for r in got if r.contaminated} == {4, 5, 6, 7, None}
    assert {r.items_sha256 for r in got if r.n_items == 0} == {hashlib.sha256(b"").hexdigest()}
    none, empty = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert decontamination.report(none, bench).count() == 0 and decontamination.report(odd, empty).where("contaminated").count() == 0


# 13
def plain_best(turns):
    """The least (cost, audit) over all edits that can be best: two insertions at most before each turn and at the end."""
    nothing, system, user, assistant = range(4)
    after = {"u": {nothing: user, system: user, assistant: user}, "a": {user: assistant}}
    states = {nothing: {(0, "")}}
    moves = lambda s: [(side[s], role) for role, side in after.items() if s in side]

    def filled(now):
        out = {s: set(x) for s, x in now.items()}
        for _ in range(2):
            for s, found in list(out.items()):
                for t, _ in moves(s):
                    out.setdefault(t, set()).update((c + 5, a + "I") for c, a in found if not a.endswith("II"))
        return {s: {min(x)} for s, x in out.items()}

    states = filled(states)
    for initial, fault in turns:
        new = {}
        extra = 5 if fault == "truncated" else 0
        for s, found in states.items():
            for c, a in found:
                new.setdefault(s, set()).add((c + 2, a + "D"))
                if fault not in ("blank", "duplicate"):
                    if initial == "s" and s == nothing:
                        new.setdefault(system, set()).add((c + extra, a + "K"))
                    for t, role in moves(s):
                        new.setdefault(t, set()).add((c + extra + (role != initial), a + ("K" if role == initial else "R")))
        states = filled({s: {min(x)} for s, x in new.items()})
    return min(x for s in (nothing, assistant) for x in states.get(s, ()))


def plain_conversation(rows):
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
    seen, marks = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        marks.append((role[:1], fault))
    cost, audit = plain_best(marks)
    lines, last, at = [], "", iter(rows)
    for e in audit:
        row = next(at) if e != "I" else None
        if e != "D":
            role = row[1] if e == "K" else "assistant" if last == "u" else "user"
            last = role[:1]
            lines.append((role, row[2] if row else ""))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    count = lambda f: sum(m[1] == f for m in marks)
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in lines))
    return (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in lines).encode()).hexdigest()), lines


def drawn_conversations():
    rng = random.Random(13)
    out = {}
    for c in range(60):
        rows = [(rng.choice([None, *range(6)]) if c % 3 else k, rng.choice(["user", "assistant", "system", "tool", "", None, "u"]), rng.choice(["Yes.", "no", "Why?", " ", None, "é!\t", "cut …"])) for k in range(rng.randint(1, 7))]
        out[c] = rows
    out[60] = [(k, "user" if k % 2 == 0 else "assistant", f"turn {k}.") for k in range(1500)]
    out[61] = [(k % 40, "user", rng.choice(["a.", "b.", "c"])) for k in range(900)]
    out[None] = [(1, "user", "Null key."), (2, "assistant", "Yes.")]
    return out


@pytest.mark.parametrize("run,fan", [(512, 16), (3, 2)])
def test_repair_against_plain(spark, run, fan):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that conversations lie in several partitions
    drawn = drawn_conversations()
    df = spark.createDataFrame([(c, *r) for c, rows in drawn.items() for r in rows], "conv_id long, turn long, role string, text string").withColumn("at", F.lit("clash")).withColumn("audit", F.lit(1))
    got = {r.conv_id: tuple(r)[1:] for r in conversations.report(df.repartition(5), run, fan).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {c: plain_conversation(rows)[0] for c, rows in drawn.items()}
    told = {}
    for r in conversations.repaired(df).orderBy("conv_id", "place").collect():
        told.setdefault(r.conv_id, []).append((r.role, r.text))
    assert told == {c: lines for c, rows in drawn.items() if (lines := plain_conversation(rows)[1])}


def test_products_may_be_grouped_freely():
    rng = random.Random(14)
    for _ in range(60):
        m = [conversations.TURNS[rng.choice("sua?"), rng.random() < 0.3, rng.random() < 0.2] for _ in range(5)]
        left = m[0]
        for x in m[1:]:
            left = conversations.product(left, x)
        right = m[-1]
        for x in reversed(m[:-1]):
            right = conversations.product(x, right)
        assert left == right == conversations.multiplied(list(m))


def test_damage_and_lost_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    import zlib

    gone = next(c for c in itertools.count() if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hi."), (None, None, None, None), (5, None, "user", "Hi.")]
    got = {r.conv_id: r for r in conversations.damage_report(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {gone, None, 5} and tuple(got[gone])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversations.damage_report(spark.createDataFrame([], schema)).count() == 0
    kinds = {k: next(t for t in itertools.count() if zlib.crc32(f"1:{t}".encode()) % 20 == k) for k in range(6)}
    df = conversations.damaged(spark.createDataFrame([(1, t, "assistant", "So. It? Is!") for t in kinds.values()], schema))
    told = {k: [(r.role, r.text) for r in df.where(F.col("turn") == t).collect()] for k, t in kinds.items()}
    assert told == {0: [], 1: [("assistant", "")], 2: [("assistant", "So It Is")], 3: [("assistant", "So. It? Is!")] * 2, 4: [("user", "So. It? Is!")], 5: [("assistant", "So. It? Is!")]}


# 10
FORMS = {
    'password = "abcdef$Gh1jkl9876&zz"': "abcdef$Gh1jkl9876&zz", "the db password: tr0ub4dor&3xyz": "tr0ub4dor&3xyz", "password=hunter2abc#K9": "hunter2abc#K9",
    'access_token_for_the_production_cluster_of_the_north = "9f8Ab3kQz0LmP4xT"': "9f8Ab3kQz0LmP4xT", 'password = "p@$$w0rd!"': "p@$$w0rd!", "postgres://bob:pa/ss1w0rd9@db.host.net/x": "pa/ss1w0rd9",
    "postgres://bob:p@ss1w0rd9@db.host.net/x": "p@ss1w0rd9", "Authorization: Bearer abcDEF123.ghiJKL456_mno789": "abcDEF123.ghiJKL456_mno789", "glpat-abcDEF123ghiJKL456mn": "glpat-abcDEF123ghiJKL456mn",
    "пароль: Зима2024!x": "Зима2024!x", '{\\"password\\": \\"abc$def9Z1\\"}': "abc$def9Z1", "secret='it\\'s9Kx&2pq'": "it\\'s9Kx&2pq", 'token = "unclosed9Kx2&pqz': "unclosed9Kx2&pqz", "Kennwort:   Ab*(9)?kq?L2x": "Ab*(9)?kq?L2x",
}
HARMLESS = ["http://host:8080/users/a@b.com", "password = get_value(user)", "the secret: everything we know", "token: the word is short"]


def test_secrets_go_whole_and_prose_stays(spark):
    texts = [f"Before it. {t} and after." for t in [*FORMS, *HARMLESS]]
    df = spark.createDataFrame([(i, t, None, "src", 7) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.text for r in secrets.redacted(df, secrets.train(spark)).collect()}
    assert got == {i: t.replace(FORMS[f], "[SECRET]") if (f := [*FORMS, *HARMLESS][i]) in FORMS else t for i, t in enumerate(texts)}


def test_no_false_positives_in_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = secrets.findings(docs, secrets.train(spark)).where("secret").collect()
    assert found and all(re.search(r"(?i)token|secret|key|password|AKIA|BEGIN|bearer|://", r.before + r.value) for r in found)
