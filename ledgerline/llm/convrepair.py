"""Repair of conversation structure by lightest derivations.

A conversation's rows are to become one optional system message and then pairs of user and assistant. Each row is kept,
given the other role, or deleted; messages without text may be inserted anywhere. The cheapest repair is a lightest
derivation: items (row, state) are deduced from the end backwards, each rule adds an edit's cost and puts its letter
before the audit, and an agenda pops items by (cost, rows consumed, audit) until the goal item is final. Rules are superior
functions in that order: an edit of a row consumes it, an insertion costs something; so what is popped can't improve.

Long conversations are cut into segments of rows, dealt by ranges of (conversation, turn), so that one conversation
may fill many tasks. A segment yields a table of lightest derivations from each entry state to each exit state; tables
are joined by a second deduction, (segment, from, to) and (rest, to) give (rest, from), over one row a segment.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialise, small_batches

BLANKS = " \t\n\x0b\x0c\r"
USER, ASSISTANT, SYSTEM, OTHER = range(4)
#: States: nothing yet, after the system message, after a user, after an assistant.
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
FORCED, TRUNCATED = 4, 8  # bits of a row's code beside its role
KEEP, REROLE, DELETE, INSERT, CUT_COST = 0, 2, 3, 2, 1
#: state after a message of a role; roles that a state doesn't take are missing
STEP = {(START, SYSTEM): AFTER_SYSTEM, (START, USER): AFTER_USER, (AFTER_SYSTEM, USER): AFTER_USER, (AFTER_ASSISTANT, USER): AFTER_USER, (AFTER_USER, ASSISTANT): AFTER_ASSISTANT}
#: The lightest ways from a state to an accepted end, by insertions alone.
ENDS = {START: (0, ""), AFTER_ASSISTANT: (0, ""), AFTER_USER: (INSERT, "I"), AFTER_SYSTEM: (2 * INSERT, "II")}
_INTO = {q: [a for (a, role), b in STEP.items() if b == q and role != SYSTEM] for q in range(4)}


def _rules(code: int) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, letter) of what may become of a row."""
    out = [(q, q, DELETE, "D") for q in range(4)]
    if not code & FORCED:
        more = CUT_COST if code & TRUNCATED else 0
        for (q, role), after in STEP.items():
            if role == code & 3:
                out.append((q, after, KEEP + more, "K"))
            elif role != SYSTEM:
                out.append((q, after, REROLE + more, "R"))
    return out


_BACK = [[[(a, c, x) for a, b, c, x in _rules(code) if b == q] for q in range(4)] for code in range(16)]


def lightest(codes: bytes, axioms: dict[int, tuple[int, str]], goals=(START,)) -> dict[int, tuple[int, str]]:
    """Lightest (cost, audit) from each goal state before the first row; ``axioms``: those of the states after the last one."""
    n, best, final = len(codes), {}, set()
    agenda = []

    def push(i, q, cost, audit):
        if (i, q) not in final and ((i, q) not in best or (cost, audit) < best[i, q]):
            best[i, q] = (cost, audit)
            heapq.heappush(agenda, (cost, n - i, audit, i, q))

    for q, (cost, audit) in axioms.items():
        push(n, q, cost, audit)
    open_ = set(goals)
    while agenda and open_:
        cost, _, audit, i, q = heapq.heappop(agenda)
        if (i, q) in final:
            continue
        final.add((i, q))
        if i == 0:
            open_.discard(q)
        if i < n:  # insertions before row i; those at the end are in the axioms
            for a in _INTO[q]:
                push(i, a, cost + INSERT, "I" + audit)
        if i:
            for a, c, letter in _BACK[codes[i - 1]][q]:
                push(i - 1, a, cost + c, letter + audit)
    return {q: best[0, q] for q in goals if (0, q) in final}


def damage(rows: DataFrame) -> DataFrame:
    """The query's damage: by crc32 of ``conv_id:turn`` a row is dropped, emptied, loses its end marks, comes twice or becomes a user's.

    A null counts as one space in each column but conv_id, which stays null in the result.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    own = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return own.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), copies.alias("copy")).drop("copy")


def _key(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("c"), F.col(c).cast("string")), F.lit(""))


def _keyed(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """key, conv_id, turn, role, text (null as one space) and digest, the order of rows of one turn."""
    own = rows.select(_key(conv).alias("key"), F.col(conv).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))])
    return own.withColumn("digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


SEGMENT = "key string, part int, seq bigint, complete boolean, n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, least bigint, greatest bigint, turns bigint, first_turn bigint, last_turn bigint, head int, tail int, table array<struct<a:int,b:int,cost:bigint,audit:string>>"
_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


class _Segment:
    """Counts and codes of consecutive rows of one conversation."""

    def __init__(self, key: str, seq: int):
        self.key, self.seq, self.codes = key, seq, bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.greatest = self.first = self.last = self.head = self.tail = None

    def add(self, turn, role: int, blank: bool, seen: bool, cut: bool):
        self.codes.append(role | (FORCED if blank or seen else TRUNCATED if cut else 0))
        self.blank += blank
        self.duplicate += seen and not blank
        self.truncated += cut and not blank and not seen
        if self.head is None:
            self.head, self.first = role, turn
        else:
            self.illegal += (self.tail, role) not in _LEGAL
        if turn is not None:
            self.turns += turn != self.last
            self.least = turn if self.least is None else self.least
            self.greatest = turn
        self.tail, self.last = role, turn

    def row(self, part: int, complete: bool) -> dict:
        codes = bytes(self.codes)
        if complete:  # the whole conversation
            table = [(START, START, *lightest(codes, ENDS)[START])]
        else:
            table = [(a, b, *w) for b in range(4) for a, w in lightest(codes, {b: (0, "")}, range(4)).items()]
        named = [dict(zip(("a", "b", "cost", "audit"), x)) for x in table]
        return {"key": self.key, "part": part, "seq": self.seq, "complete": complete, "n": len(codes), "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
                "least": self.least, "greatest": self.greatest, "turns": self.turns, "first_turn": self.first, "last_turn": self.last, "head": self.head, "tail": self.tail, "table": named}


DECISION = "key string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _decision(segments: list[dict]) -> dict:
    """Counts and lightest derivation of a conversation from its segments, in order."""
    total = {c: sum(s[c] for s in segments) for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
    for a, b in zip(segments, segments[1:]):
        total["illegal"] += (a["tail"], b["head"]) not in _LEGAL
        total["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    turns = [s for s in segments if s["least"] is not None]
    gaps = turns[-1]["greatest"] - turns[0]["least"] + 1 - total.pop("turns") if turns else 0
    total.pop("turns", None)
    rest = ENDS
    if segments[0]["complete"]:
        rest = {START: (segments[0]["table"][0]["cost"], segments[0]["table"][0]["audit"])}
    else:
        for s in reversed(segments):
            found = {}
            for t in s["table"]:
                if t["b"] in rest:
                    w = (t["cost"] + rest[t["b"]][0], t["audit"] + rest[t["b"]][1])
                    found[t["a"]] = min(found.get(t["a"], w), w)
            rest = found
    return {"key": segments[0]["key"], "gaps": gaps, **total, "cost": rest[START][0], "audit": rest[START][1]}


def decide(keyed: DataFrame, segment_rows: int = 1024) -> DataFrame:
    """_keyed rows -> one row a conversation: counts of faults, cost and audit. Texts aren't shuffled, only their digests."""
    spark = keyed.sparkSession
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    role = F.coalesce(F.create_map(F.lit("u"), F.lit(USER), F.lit("a"), F.lit(ASSISTANT), F.lit("s"), F.lit(SYSTEM))[F.substring("role", 1, 1)], F.lit(OTHER))
    narrow = keyed.select("key", "turn", "digest", role.alias("who"), (trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"))
    grouped = materialise(narrow.groupBy("key", "turn", "digest", "who", "blank", "cut").agg(F.count("*").alias("copies")), "conv-rows")
    again = grouped.groupBy("key", "digest").agg(F.count("*").alias("n"), F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("undated")).filter("n > 1").drop("n")
    marked = grouped.join(again, ["key", "digest"], "left")
    seen = F.coalesce(F.when(F.col("undated"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first")), F.lit(False))
    order = ["key", F.col("turn").asc_nulls_first(), "digest"]
    dealt = marked.select("key", "turn", "digest", "who", "blank", "cut", "copies", seen.alias("seen")).repartitionByRange(*order).sortWithinPartitions(*order)
    arrow = pa.schema([("key", pa.string()), ("part", pa.int32()), ("seq", pa.int64()), ("complete", pa.bool_()), *[(c, pa.int64()) for c in ("n", "blank", "duplicate", "truncated", "illegal", "least", "greatest", "turns", "first_turn", "last_turn")],
                       ("head", pa.int32()), ("tail", pa.int32()), ("table", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])

    def segments(batches):
        part, seg, first, out = TaskContext.get().partitionId(), None, True, []
        for b in batches:
            for r in b.to_pylist():
                if seg is None or seg.key != r["key"]:
                    if seg is not None:  # not the first of its partition, not the last: nothing of it lies elsewhere
                        out.append(seg.row(part, not first and not seg.seq))
                        first = False
                    seg = _Segment(r["key"], 0)
                for k in range(r["copies"]):
                    if len(seg.codes) >= segment_rows:
                        out.append(seg.row(part, False))
                        seg = _Segment(r["key"], seg.seq + 1)
                    seg.add(r["turn"], r["who"], r["blank"], r["seen"] or k > 0, r["cut"])
                    if len(out) >= 256:
                        yield pa.RecordBatch.from_pylist(out, arrow)
                        out = []
        if seg is not None:
            out.append(seg.row(part, False))
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    fields = [("key", pa.string()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())]

    def joined(batches):
        held, out = [], []
        for b in batches:
            for r in b.to_pylist():
                if held and held[0]["key"] != r["key"]:
                    out.append(_decision(held))
                    held = []
                held.append(r)
            if len(out) > 512:
                yield pa.RecordBatch.from_pylist(out, pa.schema(fields))
                out = []
        if held:
            out.append(_decision(held))
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema(fields))

    small_batches(spark)
    tables = dealt.mapInArrow(segments, SEGMENT).repartition("key").sortWithinPartitions("key", "part", "seq")
    return materialise(tables.mapInArrow(joined, DECISION), "conv-decided")


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", originals: DataFrame | None = None, messages: bool = False, segment_rows: int = 1024) -> DataFrame:
    """Repair conversations; one row a conversation, or with ``messages`` one row a message of the repaired ones.

    Rows of a conversation stand by turn (null first), then by a digest of role and text; equal rows are neighbours.
    Conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (of ``role:text``
    lines). Messages: conv_id, position (from 1), edit (K, R or I), turn (null where inserted), role, text.
    Null roles and texts count as one space, a null conversation is one of its own, long texts are hashed whole,
    repeated rows are duplicates of the first. ``originals``: a table whose conversations all appear, those without rows
    with zeros, an empty audit and the hash of nothing. An empty table gives an empty result; other columns don't matter.
    The digest of a conversation is one sequence by nature, so its texts stream through one task, which holds none of them.
    """
    conv = (originals if originals is not None else rows).schema[conv_col].dataType
    keyed = _keyed(rows, conv_col, turn_col, role_col, text_col)
    decided = decide(keyed, segment_rows)
    names = (originals if originals is not None else rows).select(_key(conv_col).alias("key"), F.col(conv_col).alias("conv_id")).groupBy("key").agg(F.first("conv_id").alias("conv_id"))
    head = names.join(decided, "key", "left").select("key", "conv_id", F.lit(0).alias("kind"), *[c.split()[0] for c in RESULT.split(", ")])
    both = head.unionByName(keyed.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    order = ["key", "kind", F.col("turn").asc_nulls_first(), "digest"]
    small_batches(rows.sparkSession)
    dealt = both.repartition("key").sortWithinPartitions(*order)
    kind, conv = conv.simpleString(), to_arrow_type(conv)
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    if messages:
        schema = f"conv_id {kind}, position bigint, edit string, turn bigint, role string, text string"
        arrow = pa.schema([("conv_id", conv), ("position", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    else:
        schema = f"conv_id {kind}, {RESULT}, repaired_sha256 string"
        arrow = pa.schema([("conv_id", conv), *[(c, pa.int64()) for c in counts], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches):
        at = None

        def insertions():
            while at.k < len(at.audit) and at.audit[at.k] == "I":
                at.k += 1
                yield at.emit("I", None, None, "")

        def end():
            if at is not None:
                yield from insertions()
                if at.k != len(at.audit):
                    raise ValueError("a conversation's rows don't fit its audit")
                if not messages:
                    yield at.head | {"repaired_sha256": at.sum.hexdigest()}

        def step(r):
            yield from insertions()
            edit = at.audit[at.k]
            at.k += 1
            if edit != "D":
                yield at.emit(edit, r["turn"], r["role"] if edit == "K" else None, r["text"])

        out, size = [], 0
        for b in batches:
            for r in b.to_pylist():
                if r["kind"] == 0:
                    made = list(end())
                    at = _Stream(r, counts)
                else:
                    made = list(step(r))
                if not messages:
                    made = [x for x in made if "audit" in x]
                out += made
                size += sum(len(x.get("text") or "") + 100 for x in made)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out, size = [], 0
        out += [x for x in end() if messages or "audit" in x]
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return dealt.mapInArrow(run, schema)


class _Stream:
    """A conversation while its rows pass: place in the audit, state, hash of what was put out."""

    def __init__(self, r: dict, counts):
        self.head = {"conv_id": r["conv_id"], **{c: r[c] or 0 for c in counts}, "audit": r["audit"] or ""}
        self.audit, self.k, self.state, self.position, self.sum = self.head["audit"], 0, START, 0, hashlib.sha256()

    def emit(self, edit, turn, role, text) -> dict:
        if role is None:  # the one role that the state takes: an assistant after a user, else a user
            role = "assistant" if self.state == AFTER_USER else "user"
        self.state = STEP[self.state, {"u": USER, "a": ASSISTANT, "s": SYSTEM}[role[0]]]
        self.sum.update(("\n" * bool(self.position) + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.position += 1
        return {"conv_id": self.head["conv_id"], "position": self.position, "edit": edit, "turn": turn, "role": role, "text": text}


def op12_conversation_repair(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair(damage(rows), originals=rows)


#: Forward dynamic programming over states instead of an agenda; crc32 by its table.
OP12_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_concat([i], [0, 1, 2, 3, 4, 5, 6, 7]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))),
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN g = 4 THEN 'user' ELSE role END AS role, CASE g WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE g WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM (SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS g FROM o, crc_table)),
s AS (
  SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, rtrim(text, E' \t\n\x0b\x0c\r') AS bare, left(role, 1) AS ini, lag(left(role, 1)) OVER w AS before
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), copy)),
f AS (SELECT *, bare = '' AS isblank, bare <> '' AND nth > 1 AS isdup, bare <> '' AND nth = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS iscut FROM s),
counts AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (isblank) AS blank, count(*) FILTER (isdup) AS duplicate,
         count(*) FILTER (iscut) AS truncated, count(*) FILTER (i > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
moves(q, role, nq) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
puts(q, letters, cost, nq, said) AS (
  SELECT q, '', 0, q, '' FROM range(4) t(q) UNION ALL
  SELECT q, 'I', 2, nq, CASE role WHEN 'u' THEN E'user:\n' ELSE E'assistant:\n' END FROM moves WHERE role <> 's' UNION ALL
  SELECT a.q, 'II', 4, b.nq, CASE a.role WHEN 'u' THEN E'user:\nassistant:\n' ELSE E'assistant:\nuser:\n' END FROM moves a JOIN moves b ON a.nq = b.q WHERE a.role <> 's' AND b.role <> 's'),
walk(conv_id, i, q, cost, audit, said) AS (
  SELECT conv_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), '', '' FROM counts UNION ALL
  SELECT conv_id, i, nq, cost, audit, said FROM (
    SELECT w.conv_id, w.i + 1 AS i, CAST(e.nq AS BIGINT) AS nq, CAST(w.cost + p.cost + e.cost AS BIGINT) AS cost, w.audit || p.letters || e.letter AS audit,
           w.said || p.said || CASE e.letter WHEN 'K' THEN f.role || ':' || f.text || E'\n' WHEN 'R' THEN CASE e.nq WHEN 3 THEN 'assistant:' ELSE 'user:' END || f.text || E'\n' ELSE '' END AS said,
           row_number() OVER (PARTITION BY w.conv_id, e.nq ORDER BY w.cost + p.cost + e.cost, w.audit || p.letters || e.letter) AS best
    FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN puts p ON p.q = w.q
    JOIN (SELECT q, role, nq, 'D' AS letter, 3 AS cost FROM (SELECT q, 'x' AS role, q AS nq FROM range(4) t(q)) UNION ALL SELECT q, role, nq, 'K', 0 FROM moves UNION ALL SELECT q, role, nq, 'R', 2 FROM moves WHERE role <> 's') e0 ON e0.q = p.nq
    CROSS JOIN LATERAL (SELECT e0.nq AS nq, e0.letter AS letter, e0.cost + CASE WHEN f.iscut AND e0.letter <> 'D' THEN 1 ELSE 0 END AS cost) e
    WHERE e0.letter = 'D' OR (NOT f.isblank AND NOT f.isdup AND (e0.letter = 'R' OR e0.role = f.ini))) x WHERE best = 1),
done AS (
  SELECT conv_id, cost, audit, said FROM (
    SELECT w.conv_id, w.cost + p.cost AS cost, w.audit || p.letters AS audit, w.said || p.said AS said, row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + p.cost, w.audit || p.letters) AS best
    FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i JOIN puts p ON p.q = w.q WHERE p.nq IN (0, 3)) x WHERE best = 1)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(left(said, length(said) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
