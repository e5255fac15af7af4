"""Cheapest repair of conversations, solved once per shared ending.

A conversation becomes a string with a letter per row: the class of its role and
its fault. Strings are sorted from their ends, so neighbours share their suffixes:
a stack holds one automaton node per distinct suffix, and every node knows for
each grammar state the cost to go and the first edit of the best audit. A node's
costs depend on its successor's costs alone, and up to a constant only few cost
vectors exist, so the step from node to node is looked up.

Texts move once, at the end, where each conversation's rows meet their edits in
order and run through its hash. Everything before works on keys and letters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.texts import shared_folder, slices

RETAG, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLOCK_ROWS = 4096
SORTED_LETTERS = 64

# Letters of a signature: class of the role (system, user, assistant, other) by fault.
CLEAN, CUT, BLANK, TWICE = "suao", "SUAO", "1234", "5678"
GONE = "x"
WORD = r"[^\x20\x09-\x0D]"


# -- automaton ------------------------------------------------------------------

# Grammar states of s?(ua)+: nothing yet, after s, after u, after a.
START, SYSTEM, USER, DONE = range(4)
_AFTER = {START: USER, SYSTEM: USER, USER: DONE, DONE: USER}


class Endings:
    """Nodes for the suffixes of a sorted run of signatures.

    ``choices[node][state]`` is the first edit and the state behind it. Nodes
    with the same costs, up to a constant, are one form.
    """

    def __init__(self):
        self.forms: dict[tuple, int] = {}
        self.costs: list[tuple] = []
        self.steps: dict[tuple[int, str], tuple[int, int, tuple]] = {}
        end, base = self._form((0, 2 * INSERT, INSERT, 0))
        self.end = (("", START), ("I", USER), ("I", DONE), ("", DONE))
        # One entry per suffix of the current signature: form, cost of the constant part, edits.
        self.stack: list[tuple[int, int, tuple]] = [(end, base, self.end)]
        self.letters = ""
        self.made = 0

    def _form(self, costs: tuple) -> tuple[int, int]:
        least = min(costs)
        shape = tuple(c - least for c in costs)
        if shape not in self.forms:
            self.forms[shape] = len(self.costs)
            self.costs.append(shape)
        return self.forms[shape], least

    def _step(self, form: int, letter: str) -> tuple[int, int, tuple]:
        behind = self.costs[form]
        own = letter.lower()
        extra = TRUNCATED if letter in CUT else 0
        options: list[list[tuple]] = []
        for state in range(4):
            found = [(DELETE + behind[state], "D", state)]
            if letter != GONE:
                after = _AFTER[state]
                found.append((RETAG + extra + behind[after], "R", after))
                if own == "s" and state == START:
                    found.append((extra + behind[SYSTEM], "K", SYSTEM))
                elif own == ("a" if state == USER else "u"):
                    found.append((extra + behind[after], "K", after))
            options.append(found)
        least = [min(found)[0] for found in options]
        for _ in range(4):  # an inserted row leads to another state before the same letter
            least = [min(c, INSERT + least[_AFTER[state]]) for state, c in enumerate(least)]
        for state, found in enumerate(options):
            found.append((INSERT + least[_AFTER[state]], "I", _AFTER[state]))
        # No two cheapest edits with one letter: the least letter decides the least audit.
        best = [min(found) for found in options]
        form, base = self._form(tuple(b[0] for b in best))
        return form, base, tuple((b[1], b[2]) for b in best)

    def enter(self, letters: str) -> None:
        """Make the given signature (from its end) current; what it shares with the last one stays."""
        same, most = 0, min(len(letters), len(self.letters))
        while same < most and letters[same : same + 64] == self.letters[same : same + 64]:
            same += 64
        same = min(same, most)
        while same < most and letters[same] == self.letters[same]:
            same += 1
        del self.stack[same + 1 :]
        form, total, _ = self.stack[-1]
        for letter in letters[same:]:
            step = self.steps.get((form, letter))
            if step is None:
                step = self.steps[form, letter] = self._step(form, letter)
            form, base, edits = step
            total += base
            self.stack.append((form, total, edits))
        self.made += len(letters) - same
        self.letters = letters

    def best(self) -> tuple[int, str, str]:
        """Cost, audit and plan of the current signature.

        The plan tells roles apart: K, D, U and A (given the role user or
        assistant), u and a (inserted).
        """
        at, state, audit, plan = len(self.stack) - 1, START, [], []
        cost = self.stack[at][1] + self.costs[self.stack[at][0]][START]
        while True:
            edit, after = self.stack[at][2][state]
            if not edit:
                return cost, "".join(audit), "".join(plan)
            audit.append(edit)
            if edit == "I":
                plan.append("u" if after == USER else "a")
            else:
                plan.append(("U" if after == USER else "A") if edit == "R" else edit)
                at -= 1
            state = after


# -- rows and signatures --------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (``conv_id``, ``turn``, ``role``, ``text``, ``copies``) after the keyed damage.

    A digest of ``conv_id:turn`` decides: the row goes (0 copies), loses its text
    or its sentence marks, stands twice, or is said by the user. NULLs in the
    key, the role or the text read as one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("_text", r"[.!?]", ""))
    return conversations.select("conv_id", "turn", space("role").alias("_role"), space("text").alias("_text"), kind.alias("_kind")).select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"),
        F.when(F.col("_kind") == 4, "user").otherwise(F.col("_role")).alias("role"),
        text.otherwise(F.col("_text")).alias("text"),
        F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1).alias("copies"),
    )


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with their place in the conversation: turn (NULLs first), role, digest of the text."""
    there = F.col("copies") > 0
    own = lambda c: F.when(there, c)
    return rows.select(
        "conv_id", own(F.col("turn")).alias("turn"), own(F.col("role")).alias("role"),
        own(F.unhex(F.sha2("text", 256))).alias("digest"),
        own(~F.col("text").rlike(WORD)).alias("blank"),
        own(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"),
        "copies", "text",
    )


PLACE = ["conv_id", "turn", "role", "digest"]


def _same(a: DataFrame, b: DataFrame, names: Iterable[str]) -> Column:
    found = F.lit(True)
    for name in names:
        found = found & a[name].eqNullSafe(b[f"_{name}"])
    return found


def signatures(rows: DataFrame) -> DataFrame:
    """Per conversation: ``letters``, ``gaps`` and the ``blocks`` its rows lie in.

    Equal rows are counted first, the first of equal messages is found by a
    minimum and joined back on the whole place, so no key is hotter than one
    place. Sorted ranges are cut into blocks of rows; letters are gathered per
    block, and a conversation gathers its blocks: one letter a row, as the audit
    that is asked for has.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark, "conversations")
    slim = _keyed(rows).groupBy(*PLACE, "blank", "cut").agg(F.sum("copies").alias("n"))
    firsts = (
        slim.filter("n > 0").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"))
        .select(*[F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "digest")], F.col("first.turn").alias("_turn"), F.lit(True).alias("first"))
    )
    known = slim.join(firsts, _same(slim, firsts, PLACE), "left").drop(*[f"_{c}" for c in PLACE])
    initial = F.substring("role", 1, 1)
    group = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(4)
    letter = lambda letters: F.substring(F.lit(letters), F.col("_group"), F.lit(1))
    n = F.col("n").cast("int")
    again = F.repeat(letter(TWICE), n - F.when(F.col("first"), 1).otherwise(0))
    own = F.when(F.col("cut"), letter(CUT)).otherwise(letter(CLEAN))
    spelt = F.when(F.col("n") == 0, "").when(F.col("blank"), F.repeat(letter(BLANK), n)).when(F.col("first"), F.concat(own, again)).otherwise(again)
    lettered = known.withColumn("_group", group).select(*PLACE, spelt.alias("letters"))
    ranged = lettered.repartitionByRange(*PLACE).sortWithinPartitions(*PLACE).withColumn("at", F.monotonically_increasing_id())
    # Numbers of a range partition are not the same when it is computed again.
    ranged.write.parquet(folder)
    rows_ = spark.read.parquet(folder)
    joined = lambda items, field: F.array_join(F.transform(F.array_sort(items), lambda x: x[field]), "")
    blocks = rows_.groupBy("conv_id", F.shiftright("at", BLOCK_ROWS.bit_length() - 1).alias("block")).agg(
        joined(F.collect_list(F.struct("at", "letters")), "letters").alias("letters"),
        F.min(F.struct("at", "turn", "role", "digest")).alias("first"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.size(F.collect_set("turn")).alias("turns"),
    )
    whole = blocks.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("block", "first", "low", "high", "turns", "letters"))).alias("_all"),
        F.min("low").alias("_low"), F.max("high").alias("_high"),
    )
    # A turn at the end of a block may go on in the next one.
    split = F.zip_with(
        F.slice("_all", 1, F.size("_all") - 1), F.slice("_all", 2, F.greatest(F.size("_all") - 1, F.lit(0))),
        lambda a, b: F.when(a["high"] == b["low"], 1).otherwise(0),
    )
    total = lambda items: F.aggregate(items, F.lit(0).cast("bigint"), lambda a, b: a + b)
    turns = total(F.transform("_all", lambda x: x["turns"])) - total(split)
    span = F.try_add(F.try_subtract(F.col("_high"), F.col("_low")), F.lit(1).cast("bigint"))
    return whole.select(
        "conv_id", F.array_join(F.transform("_all", lambda x: x["letters"]), "").alias("letters"),
        F.when(F.col("_low").isNull(), F.lit(0).cast("bigint")).otherwise(F.try_subtract(span, turns)).alias("gaps"),
        F.transform("_all", lambda x: F.struct(x["first"]["turn"].alias("turn"), x["first"]["role"].alias("role"), x["first"]["digest"].alias("digest"), F.length(x["letters"]).alias("n"))).alias("blocks"),
    )


# -- repair ---------------------------------------------------------------------

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_PLAIN = str.maketrans(CUT + BLANK + TWICE, CLEAN * 3)


def _counts(letters: str) -> dict[str, int]:
    plain = letters.translate(_PLAIN)
    legal = plain.count("su") + plain.count("ua") + plain.count("au")
    among = lambda some: sum(map(letters.count, some))
    return {"blank": among(BLANK), "duplicate": among(TWICE), "truncated": among(CUT), "illegal": max(0, len(plain) - 1) - legal}


def _pieces(plan: str, sizes: list[int]) -> list[str]:
    """The plan cut where blocks begin; rows inserted behind the last one go with the last block."""
    out, at = [], 0
    for size in sizes[:-1]:
        start = at
        while size:
            size -= plan[at] not in "ua"
            at += 1
        out.append(plan[start:at])
    return [*out, plan[at:]]


def plans(signed: DataFrame) -> DataFrame:
    """Per block of a conversation its first place and plan; with the first block the counts and the audit."""
    kind = signed.schema["conv_id"].dataType.simpleString()
    fields = [f"conv_id {kind}", "turn bigint", "role string", "digest binary", "block int", "plan string"]
    schema = ", ".join([*fields, *[f"{c} bigint" for c in COUNTS], "audit string"])

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        endings, last, found = Endings(), None, (0, "", "")
        for batch in batches:
            out: list[dict] = []
            ids = batch.column("conv_id")
            at: list[int] = []
            for k, row in enumerate(batch.drop_columns(["conv_id"]).to_pylist()):
                if row["ending"] != last:
                    endings.enter(row["ending"])
                    last, found = row["ending"], endings.best()
                cost, audit, plan = found
                pieces = _pieces(plan, [b["n"] for b in row["blocks"]])
                for number, (block, piece) in enumerate(zip(row["blocks"], pieces)):
                    counts = {"gaps": row["gaps"], "cost": cost, "audit": audit} | _counts(row["letters"]) if number == 0 else {}
                    out.append({"turn": block["turn"], "role": block["role"], "digest": block["digest"], "block": number, "plan": piece} | counts)
                    at.append(k)
            names = ["turn", "role", "digest", "block", "plan", *COUNTS, "audit"]
            types = [pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.string(), *[pa.int64()] * len(COUNTS), pa.string()]
            columns = [pa.array([r.get(n) for r in out], t) for n, t in zip(names, types)]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int32())), *columns], ["conv_id", *names])

    ending = F.reverse(F.translate("letters", BLANK + TWICE, GONE * 8))
    # Ranges by the last letters; conversations with one ending may lie in several ranges.
    dealt = signed.withColumn("ending", ending).repartitionByRange(F.substring("ending", 1, SORTED_LETTERS), "conv_id")
    return dealt.sortWithinPartitions("ending").mapInArrow(solve, schema)


def _written(edit: str, role: str, text: str) -> str | None:
    return {"K": f"{role}:{text}", "U": f"user:{text}", "A": f"assistant:{text}"}.get(edit)


def repair(conversations: DataFrame) -> DataFrame:
    """Faults, cheapest repair and digest of every conversation after the keyed damage.

    Rows stand by turn (NULLs first), rows of one turn by role and SHA-256 of
    their text. Edits cost: keep 0, give the role user or assistant 3, delete 4,
    insert an empty message 3, and 3 more for a cut-off message that stays. Of
    the cheapest edits the audit that sorts first counts.

    Returns ``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``,
    ``illegal``, ``cost``, ``audit``, ``repaired_sha256``. Rows with a NULL id
    are one conversation. Roles go by their first character, so an unknown or
    empty role is never kept. Where turns are too far apart for 64 bits, ``gaps``
    is NULL. A conversation of which the damage leaves nothing has zeros, an
    empty audit and the digest of nothing; an empty table gives no rows. Other
    columns are ignored, whatever their names.

    One conversation may hold any share of the rows: everything but its digest
    is worked out in blocks. The digest of one text is sequential, so its bytes
    stream through one task in bounded memory.
    """
    return repair_rows(damage(conversations))


def repair_rows(rows: DataFrame) -> DataFrame:
    """``repair`` for rows as ``damage`` returns them."""
    spark = rows.sparkSession
    kind = rows.schema["conv_id"].dataType.simpleString()
    folder = shared_folder(spark, "plans")
    plans(signatures(rows)).write.parquet(folder)
    headers = spark.read.parquet(folder)
    body = _keyed(rows).filter("copies > 0").select(*PLACE, "copies", F.when(F.col("blank"), "").otherwise(F.col("text")).alias("text"))
    both = headers.unionByName(body, allowMissingColumns=True)
    # A block's plan stands before its first row.
    dealt = both.repartition("conv_id").sortWithinPartitions(*PLACE, F.col("block").asc_nulls_last())
    names = [*COUNTS, "audit", "repaired_sha256"]
    schema = ", ".join([f"conv_id {kind}", *[f"{c} bigint" for c in COUNTS], "audit string", "repaired_sha256 string"])

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None
        plan, at, state, begun = "", 0, None, False
        ended: list[dict] = []
        ids: list[pa.Scalar] = []

        def write(text: str | None) -> None:
            nonlocal begun
            if text is not None:
                state.update((("\n" if begun else "") + text).encode())
                begun = True

        def inserted() -> None:
            nonlocal at
            while at < len(plan) and plan[at] in "ua":
                write("user:" if plan[at] == "u" else "assistant:")
                at += 1

        def close() -> None:
            if now is not None:
                inserted()
                ended.append(now | {"repaired_sha256": state.hexdigest()})

        def result() -> pa.RecordBatch:
            columns = [pa.array([r[n] for r in ended], pa.int64() if n in COUNTS else pa.string()) for n in names]
            return pa.RecordBatch.from_arrays([pa.array([i.as_py() for i in ids[: len(ended)]], type_), *columns], ["conv_id", *names])

        type_ = None
        for batch in slices(batches, "text"):
            column = batch.column("conv_id")
            type_ = column.type
            rest = batch.drop_columns(["conv_id"]).to_pylist()
            for k, row in enumerate(rest):
                if row["block"] == 0:
                    close()
                    ids.append(column[k])
                    now = {n: row[n] for n in (*COUNTS, "audit")}
                    plan, at, state, begun = row["plan"], 0, hashlib.sha256(), False
                elif row["block"] is not None:
                    plan, at = plan[at:] + row["plan"], 0
                else:
                    for _ in range(row["copies"]):
                        inserted()
                        write(_written(plan[at], row["role"], row["text"]))
                        at += 1
            if ended:
                yield result()
                del ids[: len(ended)]
                ended.clear()
        close()
        if ended:
            yield result()

    return dealt.mapInArrow(digest, schema)
