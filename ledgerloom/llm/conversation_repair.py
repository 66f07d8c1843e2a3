"""Repair of the structure of conversations, all in DataFrame functions.

``damage`` makes broken conversations of whole ones, ``repair`` finds the faults of conversations and the cheapest edits that bring their turns to
the form ``(system? (user assistant)+)?``. Edits of a row are Keep (0), Rerole to user or assistant (2) and Delete (3, and the only
one for blank and repeated rows); an empty user or assistant turn may be Inserted anywhere (2); a truncated row that stays adds 1.

Fault flags come from windows over one exchange by conversation. Each conversation's rows are then one sorted array of structs, and one ``aggregate()`` over it
carries four structs (cost, audit): the cheapest way to have written nothing, a system, a user or an assistant turn last. Ways are compared
by ``least`` over these structs, by cost, then by audit. Two ways of one cost into one state never have one audit at the beginning of the other
(they would differ in insertions alone, which cost), so the smaller beginning stays the smaller whole.

In the fold an insertion or change to user is written ``I`` or ``R``, one to assistant ``J`` or ``S``: in a given state only one of the two is possible, so
their order among all letters is that of the letters reported, and repaired turns can be read from the audit, row by row.

A conversation is one row of the result and one task's work, as its digest must be; the fold takes time with the square of its turns,
since audits are copied (a conversation of 400 turns: 400 * 400 / 2 characters a state). Whoever has conversations of millions of turns must cut them first.

Results for special input: a null role or text counts as one space (such a text is blank, such a role can't be kept); null turn numbers come first and count
for no gap; rows with one turn number are ordered by role and text; repeated rows are repeated turns, all but the first of which are
duplicates; a null conv_id is a conversation of its own; a role is known by its first character; a conversation without rows has zeros, an empty audit and
no repaired turn; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: A cost that no way has: the state can't be reached.
_NEVER = 1 << 60
_WORDLIKE = r"[^\x20\x09-\x0D]"
_STATES = ("none", "system", "user", "assistant")


def _or_space(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damage(chats: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, live) of all rows, damaged by crc32 of ``conv_id:turn`` modulo 20: 0 isn't live, 1 has no text, 2 none of ``.!?``, 3 is
    there twice, 4 is a user's. Rows that aren't live only keep their conversation known."""
    kind = F.pmod(F.crc32(F.concat(_or_space("conv_id"), F.lit(":"), _or_space("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = chats.select("conv_id", "turn", _or_space("role").alias("role"), _or_space("text").alias("text"), kind.alias("kind"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") != 0).alias("live"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "copy")


def flagged(chats: DataFrame) -> DataFrame:
    """Live rows with their first fault (blank, duplicate, truncated or null), whether their turn number is new, and whether they may follow the row before.

    One exchange by conversation serves both windows.
    """
    turn = F.asc_nulls_first("turn")
    rows = chats.where("live").select("conv_id", "turn", _or_space("role").alias("role"), _or_space("text").alias("text")).repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(turn)) > 1
    rows = rows.withColumn("again", again)
    before = Window.partitionBy("conv_id").orderBy(turn, "role", "text", "again")  # of equal rows the first comes first
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(~F.col("text").rlike(_WORDLIKE), "blank").when(F.col("again"), "duplicate").when(~last.rlike("[.!?]"), "truncated")
    pair = F.concat(F.lag(F.substring("role", 1, 1)).over(before), F.substring("role", 1, 1))
    n = F.row_number().over(before)
    return rows.select(
        "conv_id", "turn", "role", "text", fault.alias("fault"), n.alias("n"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(before))).alias("new_turn"),
        ((n > 1) & ~pair.isin("su", "ua", "au")).alias("illegal"),
    )


def _way(state: Column, cost, letter: str) -> Column:
    """``state`` and one more edit."""
    return F.struct((state["cost"] + cost).alias("cost"), F.concat(state["audit"], F.lit(letter)).alias("audit"))


def _inserted(at: dict[str, Column]) -> Column:
    """The four states after insertions: any state to user, user to assistant."""
    user = F.least(at["user"], *(_way(at[s], INSERT, "I") for s in ("none", "system", "assistant")))
    return F.struct(at["none"].alias("none"), at["system"].alias("system"), user.alias("user"), F.least(at["assistant"], _way(user, INSERT, "J")).alias("assistant"))


def _step(states: Column, row: Column) -> Column:
    """The four states after one more row, and the insertions behind it."""
    initial, staying = F.substring(row["role"], 1, 1), F.when(row["fault"] == "truncated", F.lit(TRUNCATED)).otherwise(F.lit(0)).cast("long")
    stays = ~F.coalesce(row["fault"].isin("blank", "duplicate"), F.lit(False))
    at = {s: states[s] for s in _STATES}

    def kept(from_: str, letter: str) -> Column:
        return F.when(stays & (initial == letter), _way(at[from_], staying, "K"))  # null where it can't be: least leaves it out

    def changed(from_: str, letter: str) -> Column:
        return F.when(stays, _way(at[from_], staying + REROLE, letter))

    gone = {s: _way(at[s], DELETE, "D") for s in _STATES}
    return _inserted({
        "none": gone["none"],
        "system": F.least(gone["system"], kept("none", "s")),
        "user": F.least(gone["user"], *(kept(s, "u") for s in ("none", "system", "assistant")), *(changed(s, "R") for s in ("none", "system", "assistant"))),
        "assistant": F.least(gone["assistant"], kept("user", "a"), changed("user", "S")),
    })


def cheapest_edits(rows: Column) -> Column:
    """(cost, audit in the fold's letters) of sorted row structs (role, fault)."""
    begin = {s: F.struct(F.lit(0 if s == "none" else _NEVER).cast("long").alias("cost"), F.lit("").alias("audit")) for s in _STATES}
    return F.aggregate(rows, _inserted(begin), _step, lambda s: F.least(s["none"], s["assistant"]))


def _repaired(rows: Column, audit: Column) -> Column:
    """``role:text`` of the turns that the edits leave: each row has its insertions and one letter of its own; insertions at the end follow."""
    added = lambda letters: F.transform(F.filter(F.split(letters, ""), lambda c: c != ""), lambda c: F.when(c == "I", F.lit("user:")).otherwise(F.lit("assistant:")))
    edits = F.regexp_extract_all(audit, F.lit("[IJ]*[DKRS]"), F.lit(0))

    def turns(row: Column, letters: Column) -> Column:
        own = F.substring(letters, -1, 1)
        role = F.when(own == "K", row["role"]).when(own == "R", F.lit("user")).when(own == "S", F.lit("assistant"))
        said = F.concat(role, F.lit(":"), row["text"])
        return F.concat(added(F.regexp_extract(letters, "^[IJ]*", 0)), F.when(own != "D", F.array(said)).otherwise(F.array().cast("array<string>")))

    return F.array_join(F.concat(F.flatten(F.zip_with(rows, edits, turns)), added(F.regexp_extract(audit, "[IJ]*$", 0))), "\n")


def repair(chats: DataFrame) -> DataFrame:
    """One row a conversation of (conv_id, turn, role, text, live): gaps, counts of faults and of illegal neighbours, cost and audit of the cheapest edits, and
    ``repaired``, its repaired turns. A conversation without live rows is kept."""
    count = lambda what: F.coalesce(F.count_if(what), F.lit(0)).cast("long")
    row = F.struct("n", "role", "text", "fault")
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if("new_turn"), F.lit(0)).cast("long")
    told = flagged(chats).groupBy("conv_id").agg(
        gaps.alias("gaps"), *(count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")), count(F.col("illegal")).alias("illegal"), F.sort_array(F.collect_list(row)).alias("rows"),
    )
    told = told.withColumn("edits", cheapest_edits(F.col("rows")))
    told = told.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("edits.cost").alias("cost"), F.translate("edits.audit", "JS", "IR").alias("audit"), _repaired(F.col("rows"), F.col("edits.audit")).alias("repaired"))
    # conversations of which no row is live: they meet no row of the others
    lost = chats.groupBy("conv_id").agg(F.max("live").alias("live")).where("not live").select("conv_id", *(F.lit(0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.lit("").alias("audit"), F.lit("").alias("repaired"))
    return told.unionByName(lost)
