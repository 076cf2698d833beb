"""Repair of conversation structure by a scan of min-plus matrices.

A repaired conversation's roles read ``(s?(ua)+)?``: an automaton of four states (nothing yet, after system, after user, after
assistant). Each turn is a 4x4 matrix over (cost, audit) elements, its entry (i, j) being the cheapest edit that leads from state i
to state j, followed by the closure of insertions. Elements add by taking the lesser (cost, then audit in ASCII order) and multiply by
adding costs and joining audits. That product is associative and distributes over the choice: of equal costs over the same turns no
audit is a proper prefix of another, since it would need more insertions, which cost. So turns may be multiplied in any grouping:
in runs inside a partition, then in a tree over the partitions that share a conversation.

Turns are dealt to partitions by ranges of (conversation, turn, role, start of the text), so a conversation with a third of all rows
lies in many. What runs need from each other (adjacent roles, shared turns) is part of their element too. Whole texts pass one range
shuffle; marks and matrices are narrow. The repaired texts of a conversation are streamed in order through one task, which holds
one text and the audit, since a digest of the whole can't be split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, fields, written

#: Costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state that follows each state when a user or an assistant speaks.
NEXT = {"u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = {"su", "ua", "au"}
#: Turns of a run, and elements merged at a time between runs.
RUN, FAN = 512, 16

Element = tuple[int, str]
Matrix = dict[tuple[int, int], Element]


def least(entries: Iterable[tuple[tuple[int, int], Element]]) -> Matrix:
    out: Matrix = {}
    for at, x in entries:
        if at not in out or x < out[at]:
            out[at] = x
    return out


def product(a: Matrix, b: Matrix) -> Matrix:
    return least(((i, j), (x[0] + y[0], x[1] + y[1])) for (i, k), x in a.items() for (m, j), y in b.items() if k == m)


def closure() -> Matrix:
    """No, one, two or three insertions; more come back to a state already reached at less cost."""
    once = {(i, j): (INSERT, "I") for side in NEXT.values() for i, j in side.items()}
    out = step = {(i, i): (0, "") for i in range(4)}
    for _ in range(3):
        step = product(step, once)
        out = least([*out.items(), *step.items()])
    return out


CLOSURE = closure()


def turn(initial: str, truncated: bool, must_go: bool) -> Matrix:
    """The matrix of one turn, insertions after it included."""
    moves: list[tuple[tuple[int, int], Element]] = [((i, i), (DELETE, "D")) for i in range(4)]
    if not must_go:
        extra = TRUNCATED if truncated else 0
        if initial == "s":
            moves.append(((NOTHING, SYSTEM), (extra, "K")))
        for role, side in NEXT.items():
            moves += [((i, j), (extra, "K") if role == initial else (REROLE + extra, "R")) for i, j in side.items()]
    return product(least(moves), CLOSURE)


TURNS = {(r, t, g): turn(r, t, g) for r in "sua?" for t in (False, True) for g in (False, True)}


def multiplied(matrices: list[Matrix]) -> Matrix:
    """The product in order, by a balanced tree."""
    while len(matrices) > 1:
        matrices = [product(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0]


#: What a run of turns is to its neighbours: ends, counts, matrix entries.
ELEMENT = {
    "first_role": pa.string(), "last_role": pa.string(), "first_turn": pa.int64(), "last_turn": pa.int64(), "turns": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(),
    "truncated": pa.int64(), "illegal": pa.int64(), "states": pa.list_(pa.int32()), "costs": pa.list_(pa.int64()), "audits": pa.list_(pa.string()),
}
ELEMENT_DDL = """first_role string, last_role string, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long,
states array<int>, costs array<long>, audits array<string>"""


def of_run(rows: list[dict]) -> dict:
    """The element of turns that follow each other."""
    numbers = [r["turn"] for r in rows if r["turn"] is not None]
    roles = [r["initial"] for r in rows]
    matrix = multiplied([TURNS[r["initial"] if r["initial"] in ("s", "u", "a") else "?", r["fault"] == "truncated", r["fault"] in ("blank", "duplicate")] for r in rows])
    return {
        "first_role": roles[0], "last_role": roles[-1], "first_turn": numbers[0] if numbers else None, "last_turn": numbers[-1] if numbers else None, "turns": len(set(numbers)),
        "illegal": sum(a + b not in LEGAL for a, b in zip(roles, roles[1:], strict=False)), **laid(matrix),
        **{f: sum(r["fault"] == f for r in rows) for f in ("blank", "duplicate", "truncated")},
    }


def laid(m: Matrix) -> dict:
    return {"states": [4 * i + j for i, j in m], "costs": [x[0] for x in m.values()], "audits": [x[1] for x in m.values()]}


def raised(x: dict) -> Matrix:
    return {divmod(s, 4): (c, a) for s, c, a in zip(x["states"], x["costs"], x["audits"], strict=True)}


def joined(a: dict, b: dict) -> dict:
    """Two neighbouring elements as one."""
    out = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated")}
    out["illegal"] = a["illegal"] + b["illegal"] + (a["last_role"] + b["first_role"] not in LEGAL)
    out["turns"] = a["turns"] + b["turns"] - (a["last_turn"] is not None and a["last_turn"] == b["first_turn"])
    out |= {"first_role": a["first_role"], "last_role": b["last_role"]}
    out |= {"first_turn": (a if a["turns"] else b)["first_turn"], "last_turn": (b if b["turns"] else a)["last_turn"]}
    return out | laid(product(raised(a), raised(b)))


class Fold:
    """Joins elements as they come, by a balanced tree, holding one for each level."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, dict]] = []

    def add(self, x: dict, level: int = 0) -> None:
        while self.levels and self.levels[-1][0] == level:
            x, level = joined(self.levels.pop()[1], x), level + 1
        self.levels.append((level, x))

    def total(self) -> dict:
        out = self.levels.pop()[1]
        while self.levels:
            out = joined(self.levels.pop()[1], out)
        return out


def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            yield from batch.slice(at, 4096).to_pylist()


def runs(rows: Iterable[dict], size: int) -> Iterator[dict]:
    """Elements of up to ``size`` rows."""
    own: list[dict] = []
    for r in rows:
        own.append(r)
        if len(own) == size:
            yield of_run(own)
            own = []
    if own:
        yield of_run(own)


def text_faults(text: Column) -> Column:
    """blank, truncated or null: what a turn's text alone shows."""
    bare = F.rtrim(text, F.lit(BLANKS))
    return F.when(F.length(bare) == 0, "blank").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated")


def ordered(conversations: DataFrame) -> DataFrame:
    """The turns with ``at``, which grows along each conversation; written. Null roles and texts are one space."""
    text = lambda c: F.coalesce(c, F.lit(" ")).alias(c)
    rows = conversations.select("conv_id", "turn", text("role"), text("text"))
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")
    return written(dealt.withColumn("at", F.monotonically_increasing_id()), "turns")


def marked(turns: DataFrame) -> DataFrame:
    """conv_id, turn, at, the role's initial and the first fault of each turn: blank, duplicate, truncated or null."""
    key = [F.xxhash64(F.lit(s), F.col("conv_id").isNull(), "conv_id", "role", "text").alias(h) for s, h in enumerate(("h1", "h2"))]
    rows = turns.select("conv_id", "turn", "at", F.left("role", F.lit(1)).alias("initial"), text_faults(F.col("text")).alias("own"), *key)
    first = rows.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = F.when(F.col("own") == "blank", "blank").when(F.col("at") > F.col("first"), "duplicate").otherwise(F.col("own"))
    return rows.join(first, ["h1", "h2"], "left").select("conv_id", "turn", "at", "initial", again.alias("fault"))


def elements(marks: DataFrame, run: int = RUN, fan: int = FAN) -> DataFrame:
    """One element for each conversation, its total: those of partitions first, then ``fan`` neighbours at a time."""
    schema = f"{fields(marks, 'conv_id')}, at long, {ELEMENT_DDL}"

    def folding(key: list[str], whole: bool):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for head in batches:
                kind = pa.schema([head.schema.field("conv_id"), pa.field("at", pa.int64()), *(pa.field(k, t) for k, t in ELEMENT.items())])
                for _, rows in groupby(records(chain([head], batches)), itemgetter(*key)):
                    first = next(rows)
                    fold = Fold()
                    for x in (chain if whole else lambda *r: runs(chain(*r), run))([first], rows):
                        fold.add(x)
                    yield pa.RecordBatch.from_pylist([{"conv_id": first["conv_id"], "at": first["at"], **fold.total()}], kind)

        return of

    found = written(marks.repartitionByRange("at").sortWithinPartitions("at").mapInArrow(folding(["conv_id"], False), schema), "elements")
    done, own = [], Window.partitionBy("conv_id")
    while True:
        # few rows: a conversation has one for each partition that it lies in
        place = F.row_number().over(own.orderBy("at")) - 1
        found = written(found.withColumn("n", F.count("*").over(own)).withColumn("part", F.floor(place / fan)), "counted")
        done.append(found.where("n = 1").drop("n", "part"))
        more = found.where("n > 1").drop("n")
        if more.isEmpty():
            return reduce(DataFrame.unionByName, done)
        found = more.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "at").mapInArrow(folding(["conv_id", "part"], True), schema)


def totals(turns: DataFrame, run: int = RUN, fan: int = FAN) -> DataFrame:
    """gaps, counts of faults, illegal neighbours, the least cost and its audit for each conversation of ``ordered`` turns."""
    entries = F.arrays_zip("costs", "audits", "states")
    ends = F.transform(F.filter(entries, lambda x: x.states.isin(NOTHING, ASSISTANT)), lambda x: F.struct(x.costs.alias("cost"), x.audits.alias("audit")))
    gaps = F.when(F.col("turns") == 0, 0).otherwise(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns")).cast("long")
    counts = [gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal"]
    return elements(marked(turns), run, fan).select("conv_id", *counts, F.array_min(ends).alias("best")).select("conv_id", *COUNTS, "best.cost", "best.audit")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]
SPOKEN = {"u": "user", "a": "assistant"}


def replayed(rows: Iterable[dict]) -> Iterator[tuple[str, str]]:
    """(role, text) of a repaired conversation; the first row holds its audit, the others its turns in order."""
    rows = iter(rows)
    edits, last = iter(next(rows)["audit"]), ""
    while True:
        edit = next(edits, None)
        if edit is None:
            return
        row = next(rows) if edit != "I" else None
        if edit == "D":
            continue
        role = row["role"] if edit == "K" else SPOKEN["a" if last == "u" else "u"]
        last = role[:1]
        yield role, row["text"] if row else ""


def streamed(turns: DataFrame, total: DataFrame) -> DataFrame:
    """Each conversation's audit and then its turns, in order and in one partition."""
    audit = total.select("conv_id", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
    lines = turns.select("conv_id", "at", "role", "text", F.lit(None).cast("string").alias("audit"))
    return audit.unionByName(lines).repartition("conv_id").sortWithinPartitions("conv_id", "at")


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, ``place`` (from 0), role and text of the repaired conversations; those left without a turn have no row.

    Handling of odd rows as in ``report``.
    """
    turns = ordered(conversations)
    text = pa.string()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head in batches:
            kind = pa.schema([head.schema.field("conv_id"), pa.field("place", pa.int64()), pa.field("role", text), pa.field("text", text)])
            for key, rows in groupby(records(chain([head], batches)), itemgetter("conv_id")):
                for place, (role, said) in enumerate(replayed(rows)):
                    yield pa.RecordBatch.from_pylist([{"conv_id": key, "place": place, "role": role, "text": said}], kind)

    return streamed(turns, written(totals(turns), "totals")).mapInArrow(of, f"{fields(turns, 'conv_id')}, place long, role string, text string")


def report(conversations: DataFrame, run: int = RUN, fan: int = FAN) -> DataFrame:
    """gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 for each conv_id.

    Turns come in the order of turn (nulls first), role and text. Null roles and texts are one space, so such texts are blank; null
    turns count for no gap; rows with a null conv_id are one conversation. Equal rows all count, the later ones as duplicates. Turns
    and texts of any number and length are handled. Other columns are neither read nor returned. An empty table gives an empty result.
    """
    turns = ordered(conversations)
    total = written(totals(turns, run, fan), "totals")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head in batches:
            kind = pa.schema([head.schema.field("conv_id"), pa.field("repaired_sha256", pa.string())])
            for key, rows in groupby(records(chain([head], batches)), itemgetter("conv_id")):
                digest = hashlib.sha256()
                for place, (role, said) in enumerate(replayed(rows)):
                    digest.update(("\n" * (place > 0) + f"{role}:{said}").encode())
                yield pa.RecordBatch.from_pylist([{"conv_id": key, "repaired_sha256": digest.hexdigest()}], kind)

    digests = streamed(turns, total).mapInArrow(of, f"{fields(turns, 'conv_id')}, repaired_sha256 string")
    named = total.withColumnRenamed("conv_id", "own")
    return digests.join(named, F.col("conv_id").eqNullSafe(F.col("own"))).select("conv_id", *COUNTS, "cost", "audit", "repaired_sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns damaged by the checksum of their place: a twentieth each is dropped, emptied, cut short, said twice or given to the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("times")).drop("times")


def damage_report(conversations: DataFrame) -> DataFrame:
    """``report`` of the damaged turns, with a row for every original conv_id: zeros and the empty text's digest where none is left."""
    found = report(damaged(conversations)).withColumnRenamed("conv_id", "own")
    every = conversations.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("own")), "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in (*COUNTS, "cost")]
    return every.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _oracle() -> str:
    """SQL of ``damage_report``: the same choice turn by turn, an element being its cost in nine digits and its audit."""
    more = lambda x, cost, edit: f"(printf('%09d', CAST({x}[1:9] AS BIGINT) + {cost}) || {x}[10:] || {edit})"
    stay = lambda x, r: more(x, f"(CASE WHEN i = '{r}' THEN 0 ELSE {REROLE} END) + extra", f"(CASE WHEN i = '{r}' THEN 'K' ELSE 'R' END)")
    gone = lambda x: more(x, DELETE, "'D'")
    put = lambda x, n=1: more(x, INSERT * n, f"'{'I' * n}'")
    after = {
        "n0": gone("s0"),
        "n1": f"least({gone('s1')}, CASE WHEN NOT go AND i = 's' THEN {more('s0', 'extra', chr(39) + 'K' + chr(39))} END)",
        "n2": f"least({gone('s2')}, CASE WHEN NOT go THEN least({stay('s0', 'u')}, {stay('s1', 'u')}, {stay('s3', 'u')}) END)",
        "n3": f"least({gone('s3')}, CASE WHEN NOT go THEN {stay('s2', 'a')} END)",
    }
    return rf"""
WITH RECURSIVE k AS (SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)) AS c FROM conversations),
d AS (SELECT conv_id, turn, xor(c, 4294967295::BIGINT) % 20 AS kind, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM k),
r AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM (SELECT *, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) FROM d WHERE kind <> 0)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, regexp_replace(text, '[ 	-
]+$', '') AS bare, left(role, 1) AS i FROM r),
f AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
      lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i AS pair FROM o),
g AS (SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS go, CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END AS extra FROM f),
n AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
      count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM g GROUP BY conv_id),
s AS (SELECT conv_id, 0::BIGINT AS pos, '000000000' AS s0, NULL::VARCHAR AS s1, '000000005I' AS s2, '000000010II' AS s3 FROM n
      UNION ALL SELECT conv_id, pos, n0, n1, least(n2, {put("n0")}, {put("n1")}, {put("n3")}), least(n3, {put("n2")}, {put("n0", 2)}, {put("n1", 2)}) FROM (
      SELECT g.conv_id, g.pos, {", ".join(f"{e} AS {name}" for name, e in after.items())} FROM s JOIN g ON s.conv_id IS NOT DISTINCT FROM g.conv_id AND g.pos = s.pos + 1)),
t AS (SELECT n.*, CAST(b[1:9] AS BIGINT) AS cost, b[10:] AS audit FROM (SELECT conv_id AS own, pos, least(s0, s3) AS b FROM s) JOIN n ON own IS NOT DISTINCT FROM conv_id AND pos = n),
u AS (SELECT conv_id, e, place, count(*) FILTER (WHERE e <> 'I') OVER w AS pos, count(*) FILTER (WHERE e <> 'D') OVER w AS said FROM (SELECT conv_id, audit[place] AS e, place FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS place FROM t))
      WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
v AS (SELECT u.conv_id, u.place, e, said, g.role, g.i, CASE WHEN e = 'I' THEN '' ELSE g.text END AS text, max(CASE WHEN said = 1 AND e = 'K' AND g.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY u.conv_id) AS off FROM u LEFT JOIN g ON u.conv_id IS NOT DISTINCT FROM g.conv_id AND u.pos = g.pos),
x AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (said - off) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY place) AS whole FROM v WHERE e <> 'D' GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN t ON c.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN x ON c.conv_id IS NOT DISTINCT FROM x.conv_id
"""


ORACLE = _oracle()
