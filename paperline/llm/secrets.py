"""Secret scans: candidates by patterns, false positives removed by a random forest.

Candidates are found natively: values given to a name that speaks of a credential, passwords of URLs, keys with a vendor's
prefix, long runs of key characters, and private key blocks. Each occurrence is judged in its own surroundings by a random forest,
trained from labelled findings: from the length, the character transitions (under a model of letter pairs fitted to the findings'
prose), the share covered by dictionary words and their parts, the path and the neighbouring words.
"""

from __future__ import annotations

import hashlib
import math
import random
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEY, columns, row_key
from .licenses import FILLER

#: Words that speak of a credential, in the languages at hand.
WORDS = (
    r"token|secret|passwd|password|passphrase|pwd|api[_-]?key|apikey|access[_-]?key|auth[_-]?key|private[_-]?key|credential|client[_-]?key|signing[_-]?key|encryption[_-]?key"
    r"|passwort|kennwort|mot[ _-]de[ _-]passe|contrase(?:ñ|n)a|пароль|секрет|токен"
)
#: A name around such a word, of any length. It starts where a run of name characters does and isn't tried again inside.
NAMES = r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?:" + WORDS + r"))[A-Za-z0-9_-]*+"
#: Public formats of keys. Runs have no upper bound; possessive quantifiers keep them linear.
PREFIXED = (
    r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,}+|glpat-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|xapp-[A-Za-z0-9-]{20,}+|[sr]k_live_[0-9A-Za-z]{16,}+"
    r"|sk-[A-Za-z0-9_-]{20,}+|AIza[0-9A-Za-z_-]{35}|npm_[A-Za-z0-9]{36}|hf_[A-Za-z0-9]{30,}+|dop_v1_[0-9a-f]{64}|SG\.[A-Za-z0-9_-]{16,}+\.[A-Za-z0-9_-]{16,}+"
    r"|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"
)
#: A private key block with all between its marks: header lines, line ends written as escapes, checksums.
BLOCK = r"-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----"
#: What stands before a named value, before the password of a URL, and before the token of a request.
ASSIGNED = r"(?iu:" + NAMES + r")\\?[\"'`]?[ \t]*+(?::=|=>|[=:])[ \t]*+"
NAMED = ASSIGNED + r"(?:\\?[\"'`])?"
LOGIN = r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*+://[^\s/:@\"'<>]*+:"
BEARER = r"(?<![A-Za-z0-9_-])(?i:bearer|basic)[ \t]++"
#: A value between quotes runs to the closing one, behind an escaped quote to the next escaped one.
QUOTED = "|".join(
    rf"{q}(?=[^{q}\r\n]{{6}})[^{q}\\\r\n]*+(?:\\[^\r\n][^{q}\\\r\n]*+)*+(?={q})|\\{q}(?=[^{q}\\\r\n]{{6}})[^{q}\\\r\n]*+(?:\\(?!{q})[^{q}\\\r\n]*+)*+(?=\\{q})" for q in ('"', "'", "`")
)
#: A bare one runs to the next blank; quotes, brackets and stops at its end are not its own.
BARE = r"(?:\\?[\"'`])?(?!-----BEGIN )(?=\S{6})[^\s\"'`]\S*[^\s\"'`,;.)\]}>]"
#: A URL's password runs to the last @ before its first stroke, or holds strokes and runs to one that a host follows.
PASSWORD = r"(?:[^\s/\"'<>]+(?=@)|(?![0-9]{1,5}[/?#])[^\s\"'<>]+?(?=@[A-Za-z0-9.-]++(?::[0-9]++)?(?:[/?#\s\"'<>]|$)))"
CANDIDATE = (
    r"(?:" + NAMED + r")?" + BLOCK
    + r"|" + LOGIN + PASSWORD
    + r"|" + ASSIGNED + r"(?!" + BEARER + r")(?:" + QUOTED + r"|" + BARE + r")"
    r"|" + BEARER + r"[A-Za-z0-9._~+/-]{16,}+={0,2}"
    r"|(?<![A-Za-z0-9_+/-])(?:" + PREFIXED + r")(?![A-Za-z0-9_-])"
    r"|(?<![A-Za-z0-9_+/=-])(?:[0-9a-fA-F]{32,}+|(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{40,}+={0,2})(?![A-Za-z0-9_+/-])"
)
#: Characters on each side of a candidate that its features may look at.
AROUND = 60
VALUE = r"^(?:" + NAMED + r"|" + LOGIN + r"|" + BEARER + r")?"
CREDENTIAL_WORDS = r"(?iu)token|secret|passw|passphrase|pwd|api[_-]?key|access[_-]?key|auth|private|credential|signing|bearer|kennwort|de[ _-]passe|contrase|пароль|секрет|токен"
HARMLESS_WORDS = r"(?i)(?<![\w.@-])(?:sha-?1|sha-?256|sha512|md5|checksum|digest|commit|revision|etag|uuid|example|sample|dummy|test|placeholder|fingerprint|integrity|hash)(?![\w.@])"
HARMLESS_PATHS = r"(?i)test|example|sample|fixture|mock|doc|lock|vendor"
PLACEHOLDER = r"(?i)your|example|changeme|placeholder|dummy|xxxx|\*\*\*\*|0000000|1234567|<.*>|\$\{|redacted|secret_?here|todo"
#: Frequent parts of written words, and whole ones, whose share of a value stands for dictionary coverage.
PARTS = r"the|ing|ion|tion|ent|and|for|her|ter|hat|tha|ere|ate|his|con|res|ver|all|ons|nce|men|ith|ted|ers|pro|thi|wit|are|ess|not|ive|was|ect|rea|com|eve|per|int|est|sta|cti|ica|ist|ear|ain|one|our|iti|rat|word|pass|name|user|value|key|data|file|config|string|default|null|true|false|none|env|get|set|test"
COVERED = r"(?i)" + "|".join(sorted({*PARTS.split("|"), *(w for w in FILLER if len(w) > 2)}, key=lambda w: (-len(w), w)))

FEATURES = ["length", "digits", "uppers", "lowers", "others", "distinct", "switches", "runs", "transition", "hexadecimal", "covered", "placeholder", "prefixed", "named", "quoted", "harmless_word", "harmless_path"]
#: Classes of characters in the model of letter pairs: letters, any digit, any other sign.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
CLASSES = len(LETTERS) + 2


@dataclass(frozen=True)
class Detector:
    """The forest over FEATURES, and the log probabilities of letter pairs (CLASSES x CLASSES, row after row)."""

    forest: PipelineModel
    pairs: list[float]


def classes_of(value: Column) -> Column:
    """The character classes of a value, an array of numbers from 0."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(value), "[0-9]", "0"), "[^a-z0]", "-")
    return F.transform(F.split(plain, ""), lambda c: F.when(c == "0", len(LETTERS)).when(c == "-", len(LETTERS) + 1).otherwise(F.ascii(c) - ord("a")))


def letter_pairs(findings: DataFrame) -> list[float]:
    """Log probabilities of a class given the one before it, from the words around the findings; at most CLASSES^2 counts."""
    words = F.split(F.concat_ws(" ", "before", "after"), "[^A-Za-z]+")
    at = findings.select(F.explode(words).alias("w")).where("char_length(w) > 1").select(classes_of(F.col("w")).alias("c"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.get("c", i - 1) * CLASSES + F.get("c", i))
    counts = {r[0]: r[1] for r in at.select(F.explode(pairs).alias("p")).groupBy("p").count().collect()}
    rows = [sum(counts.get(a * CLASSES + b, 0) + 0.5 for b in range(CLASSES)) for a in range(CLASSES)]
    return [math.log((counts.get(a * CLASSES + b, 0) + 0.5) / rows[a]) for a in range(CLASSES) for b in range(CLASSES)]


def features(value: Column, before: Column, after: Column, path: Column, pairs: list[float]) -> list[Column]:
    """Numbers about a candidate; every share is of the value's length."""
    n = F.greatest(F.char_length(value), F.lit(1)).cast("double")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    near = F.right(before, F.lit(40))
    says = lambda c, pattern: F.coalesce(c.rlike(pattern), F.lit(False)).cast("double")
    covered = (F.char_length(value) - F.char_length(F.regexp_replace(value, COVERED, ""))) / n
    table = F.array(*map(F.lit, pairs))
    # The class before goes along, so a long value is walked once.
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    walk = F.aggregate(classes_of(value), start, lambda a, c: F.struct(c.alias("last"), (a["sum"] + F.when(a["last"] < 0, 0.0).otherwise(F.get(table, a["last"] * CLASSES + c))).alias("sum")))
    found = [
        F.least(n, F.lit(512.0)), share("[0-9]"), share("[A-Z]"), share("[a-z]"), share("[^0-9A-Za-z]"),
        F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(64.0)),
        share("(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]|(?<=[a-z])[A-Z]"), share(r"(.)\1"), walk["sum"] / F.greatest(n - 1, F.lit(1.0)),
        says(value, "^[0-9a-fA-F]+$"), covered, says(value, PLACEHOLDER), says(value, f"^(?:{PREFIXED}|-----BEGIN)"),
        says(near, CREDENTIAL_WORDS), says(near, "[\"'`]$"), says(near, HARMLESS_WORDS), says(path, HARMLESS_PATHS),
    ]
    return [c.cast("double").alias(name) for c, name in zip(found, FEATURES, strict=True)]


def labelled_findings(n: int = 3000, seed: int = 7) -> list[tuple[str, str, str, str, int]]:
    """Findings made up by rule, half of them secrets: (value, before, after, path, label)."""
    rng = random.Random(seed)
    syllables = "th er on re in ed nd ha en es or ti te of ver con pro men ta li".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    upper, lower, digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    prose = lambda: " ".join(word() for _ in range(rng.randint(2, 6)))
    names = ["token", "secret", "api_key", "password", "access_key", "auth_token", "client_secret", "private_key", "db_password", "signing_key"]
    signs, marks = [" = ", "=", ": ", ":"], ['"', "'", ""]
    code, harmless = ["src/app.py", "config.yml", "deploy/env", "src7", ""], ["tests/test_app.py", "docs/example.md", "package-lock.json", "fixtures/a.json"]
    made = []
    for i in range(n):
        mark = rng.choice(marks)
        named = prose() + " " + rng.choice(names) + rng.choice(signs) + mark
        random_value = rng.choice([
            lambda: pick("0123456789abcdef", rng.choice([32, 40, 64])), lambda: pick(upper + lower + digit, rng.randint(20, 48)),
            lambda: pick(upper + lower + digit + "+/", rng.choice([40, 64])), lambda: pick(lower + digit + "!@%^", rng.randint(10, 18)),
            lambda: word() + pick(digit, rng.randint(1, 3)) + pick("!@%^_" + lower, rng.randint(0, 2)),
            lambda: pick(upper + lower + digit + "$&#*?(){}~!@%^+=.,;:-", rng.randint(9, 24)), lambda: word() + pick("$&#!@*", 1) + pick(upper + lower + digit, rng.randint(3, 8)),
            lambda: word()[:3] + pick(digit, 1) + word()[:3] + pick("&#$!", 1) + pick(digit, 1) + word()[:3], lambda: pick("$@!#", 1).join([word(), pick(digit, 2), word()]),
        ])()
        url = f"{prose()} {rng.choice(['postgres', 'https', 'redis', 'mysql', 'amqp'])}://{word()}:"
        if i % 2:
            prefixed = rng.choice(["AKIA" + pick(upper + digit, 16), "ghp_" + pick(upper + lower + digit, 36), "sk_live_" + pick(lower + digit, 24), "glpat-" + pick(upper + lower + digit + "_-", 20)])
            value, before, path = rng.choice([(random_value, named, rng.choice(code)), (random_value, named, rng.choice(code)), (random_value, url, rng.choice(code)), (prefixed, rng.choice([named, prose() + " "]), rng.choice(code)), (pick(upper + lower + digit + "._-", rng.randint(20, 60)), prose() + " Authorization: Bearer ", rng.choice(code))])
        else:
            said = rng.choice(["commit ", "sha256: ", "md5=", "checksum: ", "etag ", "revision ", "integrity sha512-", "digest "])
            digest = hashlib.sha256(str(i).encode()).hexdigest()[: rng.choice([32, 40, 64])]
            fake = rng.choice(["your_" + word() + "_here", "changeme" + word(), "xxxxxxxxxxxxxxxx", "example-" + word() + "-key", "placeholder_value", rng.choice(["required", "disabled", "enabled", "missing", "optional", "invalid", "encrypted", "unchanged"]), "${" + word().upper() + "}", "1234567890", word() + word() + word() + "." + word(), "get_" + word() + "(" + word() + ")", "self." + word() + "_" + word(), f'os.environ["{word().upper()}"]', prose() + " " + prose(), word() + word() + rng.choice([".", ",", "", "?"]), f"{word()}({word()}, {word()})", "<" + word() + "-" + word() + ">"])
            value, before, path = rng.choice([
                (digest, prose() + " " + said, rng.choice(code)), (digest, prose() + " ", rng.choice(code + harmless)), (fake, named, rng.choice(code + harmless)),
                (word() + "_" + word() + "_" + word() + "_" + word(), named, rng.choice(code)), ("get_" + word() + "." + word() + "_" + word(), named, rng.choice(code)),
                (random_value, prose() + " test example " + rng.choice(names) + "=" + mark, rng.choice(harmless)),
            ])
        made.append((value, before, mark + " " + prose(), path, i % 2))
    return made


def train(spark: SparkSession, findings: DataFrame | None = None, trees: int = 30, depth: int = 8) -> Detector:
    """A detector from findings (value, before, after, path, label); by default those of ``labelled_findings``."""
    if findings is None:
        findings = spark.createDataFrame(labelled_findings(), "value string, before string, after string, path string, label int")
    pairs = letter_pairs(findings)
    rows = findings.select(*features(F.col("value"), F.col("before"), F.col("after"), F.col("path"), pairs), F.col("label").cast("double").alias("label"))
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, featureSubsetStrategy="sqrt").fit(assembler.transform(rows))
    return Detector(PipelineModel([assembler, forest]), pairs)


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """doc_id, row key, ``place`` (from 0), ``value``, ``before``, ``after``, ``path``: a row for each occurrence of a candidate.

    ``before`` and ``after`` reach to the next candidate but one, and AROUND characters at most.
    """
    known = F.col(f"`{path}`").cast("string") if path in docs.columns else F.lit(None).cast("string")
    at = docs.select("doc_id", *row_key(), "text", known.alias("path"), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"))
    # Texts without a candidate leave here; a filter before would have the patterns looked for twice.
    at = at.select("doc_id", *KEY, "text", "path", F.explode(F.array("found")).alias("found")).where(F.size("found") > 0)
    # What stands between the candidates: one piece more than there are candidates, blank ones too.
    at = at.select("doc_id", *KEY, "path", "found", F.split("text", CANDIDATE, -1).alias("gaps"))
    none = F.lit("")
    around = F.transform("found", lambda x, i: F.struct(
        x.alias("whole"), F.concat(F.when(i > 0, F.get("found", i - 1)).otherwise(none), F.get("gaps", i)).alias("before"),
        F.concat(F.get("gaps", i + 1), F.coalesce(F.get("found", i + 1), none)).alias("after"),
    ))
    at = at.select("doc_id", *KEY, "path", F.posexplode(around).alias("place", "x")).select("doc_id", *KEY, "path", "place", "x.*")
    value = F.regexp_replace("whole", VALUE, "")
    at = at.withColumn("value", F.when(value == "", F.col("whole")).otherwise(value))
    named = F.expr("left(whole, char_length(whole) - char_length(value))")
    return at.select("doc_id", *KEY, "place", "value", F.concat(F.right("before", F.lit(AROUND)), named).alias("before"), F.left("after", F.lit(AROUND)).alias("after"), "path")


def findings(docs: DataFrame, model: Detector, path: str = "source", least: float = 0.5) -> DataFrame:
    """``candidates`` with ``probability`` of being a secret and ``secret`` (that is ``least`` or more).

    Null and empty texts have no candidate; very long texts and values are looked at whole. Rows alike in doc_id and text give
    the same findings, and null doc_ids pass as they are. A table without a ``path`` column has null paths. Other columns are
    not read. An empty table gives an empty result.
    """
    at = candidates(docs, path)
    wide = at.select("*", *features(F.col("value"), F.col("before"), F.col("after"), F.col("path"), model.pairs))
    scored = model.forest.transform(wide).withColumn("probability", F.round(vector_to_array("probability")[1], 6))
    return scored.select(*at.columns, "probability", (F.col("probability") >= least).alias("secret"))


def report(docs: DataFrame, model: Detector, path: str = "source", least: float = 0.5) -> DataFrame:
    """A row for each row of ``docs``: doc_id, candidates (occurrences), the secrets' number and SHA-256 in order (each value once),
    the highest probability. Nulls, empty texts, repeated rows and empty tables are dealt with as by ``findings``."""
    found = findings(docs, model, path, least)
    each = found.groupBy(*KEY).agg(F.countDistinct("place").alias("n_candidates"), F.array_sort(F.collect_set(F.when(F.col("secret"), F.sha2("value", 256)))).alias("secret_sha256"), F.max("probability").alias("max_probability"))
    at = docs.select("doc_id", *row_key()).join(each, KEY, "left")
    hashes = F.coalesce("secret_sha256", F.array().cast("array<string>"))
    return at.select(
        "doc_id", F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"), F.size(hashes).cast("long").alias("n_secrets"),
        F.array_join(hashes, ",").alias("secret_sha256"), F.coalesce("max_probability", F.lit(0.0)).alias("max_probability"),
    )


def redacted(docs: DataFrame, model: Detector, path: str = "source", least: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``mark``, wherever it stands; ``n_chars`` follows.

    All rows stay, with their columns, whatever their names; null and empty texts, repeated rows and empty tables pass as by
    ``findings``.
    """
    found = findings(docs, model, path, least).where("secret")
    # Longest first, so that a secret inside another does not break it up.
    values = F.transform(F.reverse(F.array_sort(F.collect_set(F.struct(F.char_length("value").alias("n"), "value")))), lambda x: x["value"])
    each = found.groupBy(*KEY).agg(values.alias("__secrets"))
    names = [f"__c{i}" for i in range(len(docs.columns))]
    of = dict(zip(docs.columns, names, strict=True))
    own = docs.select(*[c.alias(n) for c, n in zip(columns(docs), names, strict=True)], *row_key())
    at = own.join(each, KEY, "left").withColumn("__none", F.col("__secrets").isNull())
    text = F.when(F.col("__none"), F.col(of["text"])).otherwise(F.aggregate("__secrets", F.col(of["text"]), lambda t, v: F.replace(t, v, F.lit(mark))))
    new = {"text": text} | ({"n_chars": F.when(F.col("__none"), F.col(of["n_chars"])).otherwise(F.char_length(text).cast(docs.schema["n_chars"].dataType))} if "n_chars" in of else {})
    return at.select(*[new.get(c, F.col(n)).alias(c) for c, n in of.items()])
