"""Operator 11: conversation structure repair by Knuth's lightest-derivation agenda.

A conversation's rows are edited, in order, until their role initials read `(s?(ua)+)?`:

    Keep     0   the row stays
    Rerole   1   the row becomes a user's or an assistant's
    Delete   2   the only edit of a blank row or of one whose role and text stood earlier
    Insert   5   an empty row of a user or an assistant, anywhere

A truncated row (its last visible character is not `.`, `!` or `?`) that is not deleted adds 5.

Deductions.  Item (i, q) says that rows i and on can be edited into a legal ending when q was
emitted last (nothing, s, u or a).  Axioms are (n, q) for the q that may end a conversation and one
fact for each row.  A hyperedge has the fact of row i and item (i + 1, r) as premises and (i, q) as
conclusion; an insertion has (i, r) alone.  The value of a derivation is (cost, audit), where audit
is the string of the edits' initials; a conclusion puts its initial in front of its premise's audit,
which keeps the order of any two audits (appending would not, as insertions make the lengths
differ).  The agenda orders by (cost, rows covered, audit): every function is monotone and superior in
this order, keeping a row too, which costs nothing and may lower the audit.  Derivations of one item
cover the same rows and differ in their first initial, so initials decide ties and no string is
compared; the agenda stops when the goal item, (0, nothing), is popped.

Distribution.  Decisions need no texts: of each row go its role, two flags and a digest, by which
rows that stood earlier are found in one grouped minimum.  The rows of a conversation meet in one
task as a sorted stream; more than CHUNK are decided chunk by chunk, each with one agenda for every
state after it, and of the ways through the chunks so far one stays for every state (equal costs
over the same rows never leave one audit a prefix of the other, so chunks can be joined).  A
second stream carries the decision first and the texts behind it, so texts are never held.  Both
streams use the memory of a chunk and one byte for each row, however long the conversation is.
That one task reads a conversation lies in the result: a digest of its whole text.

Edge cases: null roles and texts count as one space; rows of a null conversation are one
conversation; null turns come first; rows of equal turn follow by role and digest, so repeated rows
are adjacent and all but one are duplicates; a role without a legal initial, or an empty one, cannot
be kept; very long texts pass one batch at a time; other columns are not read, whatever their names;
an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import os.path
from itertools import groupby
from operator import itemgetter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_stream, materialize

START, SYSTEM, USER, ASSISTANT = range(4)
#: How each state is reached: from which state, by which role initial.
INTO = {START: (), SYSTEM: ((START, "s"),), USER: ((START, "u"), (SYSTEM, "u"), (ASSISTANT, "u")),
        ASSISTANT: ((USER, "a"),)}
STEP = {(p, initial): q for q, ways in INTO.items() for p, initial in ways}
#: The role that an inserted or changed row takes after each state.
OWED = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
FINAL = (START, ASSISTANT)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
CHUNK = 2048
SPACES = " \t\n\x0b\x0c\r"


def lightest(facts: list, ends: tuple, goals: set) -> dict:
    """{state: (cost, audit)} of the lightest way from each of `goals` before the first row to one of
    `ends` behind the last.  `facts` holds (role initial, must go, truncated) of each row."""
    n = len(facts)
    open_goals = set(goals)
    agenda = [(0, 0, "", q, ()) for q in ends]
    heapq.heapify(agenda)
    final: dict = {}
    while agenda and open_goals:
        cost, covered, letter, state, premise = heapq.heappop(agenda)
        item = (covered, state)
        if item in final:
            continue
        final[item] = (cost, letter, premise)
        if covered == n:
            open_goals.discard(state)
        else:
            initial, must_go, truncated = facts[n - covered - 1]
            heapq.heappush(agenda, (cost + DELETE, covered + 1, "D", state, item))
            if not must_go:
                here = cost + TRUNCATED if truncated else cost
                for before, needed in INTO[state]:
                    if initial == needed:
                        heapq.heappush(agenda, (here, covered + 1, "K", before, item))
                    if needed != "s":
                        heapq.heappush(agenda, (here + REROLE, covered + 1, "R", before, item))
        for before, needed in INTO[state]:
            if needed != "s":
                heapq.heappush(agenda, (cost + INSERT, covered, "I", before, item))
    found = {}
    for goal in goals:
        item = (n, goal)
        if item in final:
            cost, letters = final[item][0], []
            while item:
                _, letter, item = final[item]
                letters.append(letter)
            found[goal] = (cost, "".join(letters))
    return found


class Ways:
    """The lightest way through the chunks so far, for every state that they can end in."""

    def __init__(self):
        self.live = {START: (0, "")}
        self.settled: list[str] = []      # what all live ways begin with

    def through(self, facts: list) -> None:
        ways: dict = {}
        for end in INTO:
            for begin, (cost, audit) in lightest(facts, (end,), set(self.live)).items():
                way = (self.live[begin][0] + cost, self.live[begin][1] + audit)
                ways[end] = min(ways.get(end, way), way)
        shared = len(os.path.commonprefix([audit for _, audit in ways.values()]))
        self.settled.append(next(iter(ways.values()))[1][:shared])
        self.live = {end: (cost, audit[shared:]) for end, (cost, audit) in ways.items()}

    def finish(self, facts: list) -> tuple[int, str]:
        rest = lightest(facts, FINAL, set(self.live))
        cost, audit = min((self.live[q][0] + cost, self.live[q][1] + audit) for q, (cost, audit) in rest.items())
        return cost, "".join([*self.settled, audit])


def faults_of(rows) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit of the rows of one conversation:
    (turn, role initial, key, blank, later, truncated) in order."""
    ways, chunk = Ways(), []
    low = high = last = None
    turns = blank = duplicate = truncated = illegal = 0
    before, same = None, None
    for turn, initial, key, is_blank, is_later, is_truncated in rows:
        if turn is not None and turn != last:
            low, high, last, turns = turn if low is None else low, turn, turn, turns + 1
        is_duplicate = not is_blank and (is_later or same == (turn, key))
        same = (turn, key)
        cut = is_truncated and not is_blank and not is_duplicate
        blank, duplicate, truncated = blank + is_blank, duplicate + is_duplicate, truncated + cut
        illegal += before is not None and before + initial not in ("su", "ua", "au")
        before = initial
        if len(chunk) == CHUNK:
            ways.through(chunk)
            chunk = []
        chunk.append((initial, is_blank or is_duplicate, cut))
    cost, audit = ways.finish(chunk)
    return (0 if low is None else high - low + 1 - turns), blank, duplicate, truncated, illegal, cost, audit


def _visible(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def canonical(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, role, text without null roles and texts, and `key`, a digest of both."""
    role, text = F.coalesce(F.col(role_col), F.lit(" ")), F.coalesce(F.col(text_col), F.lit(" "))
    return turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("key"))


def decide(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """One row for each conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    rows = canonical(turns, conv_col, turn_col, role_col, text_col)
    seen = _visible(F.col("text"))
    facts = materialize(rows.select(
        "conv", "turn", "role", "key", (seen == "").alias("blank"),
        (~F.substring(seen, -1, 1).isin(".", "!", "?")).alias("truncated")))
    # a turn that may be null, as a value that sorts before all others
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    repeated = (facts.where("NOT blank").groupBy(F.col("conv").alias("of_conv"), F.col("key").alias("of_key"))
                .agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1"))
    marked = (facts.join(repeated, F.col("conv").eqNullSafe(F.col("of_conv")) & (F.col("key") == F.col("of_key")), "left")
              .select("conv", "turn", "role", "key", "blank", F.coalesce(at > F.col("first"), F.lit(False)).alias("later"), "truncated"))
    conv_type = facts.schema["conv"].dataType.simpleString()

    def make():
        def run(stream):
            for conv, group in groupby(stream, itemgetter(0)):
                yield (conv, *faults_of((turn, role[:1], key, blank, later, truncated)
                                        for _, turn, role, key, blank, later, truncated in group))
        return run

    return map_stream(marked.repartition("conv").sortWithinPartitions("conv", "turn", "role", "key"), make,
                      f"conv {conv_type}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, "
                      "illegal bigint, cost bigint, audit string")


def apply_edits(turns: DataFrame, decisions: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each edit, in order within its conversation and partition: conv, place, edit, role
    and text behind the edit.  Deleted rows (edit D) show what was deleted."""
    rows = canonical(turns, conv_col, turn_col, role_col, text_col)
    first = decisions.select("conv", F.lit(0).alias("phase"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                             F.lit(None).cast("binary").alias("key"), F.col("audit").alias("text"))
    both = first.unionByName(rows.withColumn("phase", F.lit(1)))
    conv_type = rows.schema["conv"].dataType.simpleString()

    def make():
        def run(stream):
            for conv, group in groupby(stream, itemgetter(0)):
                audit = next(group)[2]
                state = START
                for place, letter in enumerate(audit):
                    if letter == "I":
                        role, text = OWED[state], ""
                    else:
                        _, role, text = next(group)
                    if letter == "R":
                        role = OWED[state]
                    yield conv, place, letter, role, text
                    if letter != "D":
                        state = STEP[state, role[:1]]
        return run

    ordered = both.repartition("conv").sortWithinPartitions("conv", "phase", "turn", "role", "key")
    return map_stream(ordered.select("conv", "role", "text"), make,
                      f"conv {conv_type}, place bigint, edit string, role string, text string")


def digests(edits: DataFrame) -> DataFrame:
    """conv, repaired_sha256 of the rows that `apply_edits` leaves, read where they stand."""
    conv_type = edits.schema["conv"].dataType.simpleString()

    def make():
        def run(stream):
            for conv, group in groupby(stream, itemgetter(0)):
                digest, between = hashlib.sha256(), ""
                for _, edit, role, text in group:
                    if edit != "D":
                        digest.update(f"{between}{role}:{text}".encode("utf-8", "surrogatepass"))
                        between = "\n"
                yield conv, digest.hexdigest()
        return run

    return map_stream(edits.select("conv", "edit", "role", "text"), make, f"conv {conv_type}, repaired_sha256 string")


def damage(turns: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) with faults planted by crc32(`conv_id:turn`) % 20: 0 drops
    the row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it a user's."""
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    hit = turns.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = (F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The registered query: damage, decide, edit, and one row for each original conversation."""
    damaged = damage(conversations)
    decisions = materialize(decide(damaged))
    done = digests(apply_edits(damaged, decisions)).withColumnRenamed("conv", "of_conv")
    ids = conversations.select("conv_id").distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return (ids.join(decisions, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
            .join(done, F.col("conv_id").eqNullSafe(F.col("of_conv")), "left")
            .select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
                    F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))
