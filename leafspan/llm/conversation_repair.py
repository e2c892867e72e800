"""Repair of conversations: the cheapest edits that make roles alternate and turns whole.

Method: A* over the edit lattice. A node is a turn's place and the role that the repaired
conversation ends with so far; edges keep the turn (0), give it another role (1), delete it (2) or insert an
empty turn (5), and keeping a truncated turn costs 5 more. The heuristic is a suffix sum: each turn that must be
deleted costs 2 still, and so does each truncated one at least. It never overestimates and is
consistent, so that the first way to a node is the best one. Nodes wait by (cost + heuristic, edits so far); of
equally cheap edits those whose initials are least in ASCII win.

A conversation of more than LONG_ROWS turns or LONG_BYTES bytes is cut into fragments in the order of its turns. For each fragment
the search gives the cost from each role that may come before to each that may end it, and how the edits
compare; these few numbers are put together from the last fragment to the first, and each fragment then
writes its own part. No task holds more of such a conversation than a fragment, but for its numbers, audit and digest.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspan.llm.session import join_hot, saved, small_batches, with_small

#: Longer conversations are handled in fragments of so many turns and bytes at most.
LONG_ROWS, LONG_BYTES = 1024, 8 << 20

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
WHITE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
LEGAL = {"su", "ua", "au"}
ROLES = {"u": "user", "a": "assistant"}
#: The repaired conversation so far: nothing, or the initial of its last role; which initials may follow; where it may end.
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}
LAST = ("", "a")

SOUND, CUT, GONE = 0, 1, 2

AUDIT = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id {id}, place long, edit string, role string, text string"


def cheapest(kinds: list[int], initials: list[str], entry: str = "", last: bool = True) -> dict[str, tuple[int, str]]:
    """The cheapest edits of turns (SOUND, CUT or GONE, and initials of roles) after ``entry``, by A*.

    For a conversation's last turns {end: (cost, audit)} with the one best end; otherwise with the best
    way to every end, none of which has insertions after its last turn.
    """
    n = len(kinds)
    charge = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        charge[i] = charge[i + 1] + (DELETE if kinds[i] != SOUND else 0)
    waiting = [(charge[0], "", 0, entry)]
    closed: set[tuple[int, str]] = set()
    ends: dict[str, tuple[int, str]] = {}
    while waiting:
        cost, audit, i, role = heapq.heappop(waiting)
        if (i, role) in closed:
            continue
        closed.add((i, role))
        if i == n:
            if not last:
                ends[role] = (cost, audit)
                continue
            if role in LAST:
                return {role: (cost, audit)}
        else:
            rest = cost - charge[i] + charge[i + 1]
            heapq.heappush(waiting, (rest + DELETE, audit + "D", i + 1, role))
            if kinds[i] != GONE:
                rest += TRUNCATED if kinds[i] == CUT else 0
                for to in NEXT[role]:
                    if initials[i] == to:
                        heapq.heappush(waiting, (rest + KEEP, audit + "K", i + 1, to))
                    elif to in ROLES:
                        heapq.heappush(waiting, (rest + REROLE, audit + "R", i + 1, to))
        to = NEXT[role][-1]
        heapq.heappush(waiting, (cost + INSERT, audit + "I", i, to))
    return ends


def edited(turns: list[tuple[str, str]], audit: str, entry: str = "") -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that remain or are inserted."""
    rows, role = iter(turns), entry
    for edit in audit:
        name, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        role = name[:1] if edit == "K" else NEXT[role][-1]
        yield edit, name if edit == "K" else ROLES[role], text


def _fault(text: str, seen: bool) -> tuple[int, int, int]:
    """Whether a turn is blank, else a duplicate, else truncated."""
    body = text.rstrip(WHITE)
    return (int(not body), int(bool(body) and seen), int(bool(body) and not seen and body[-1] not in ENDS))


def _kind(fault: tuple[int, int, int]) -> int:
    return GONE if fault[0] or fault[1] else CUT if fault[2] else SOUND


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def _digest(turns, digest=None, first=True):
    digest = digest or hashlib.sha256()
    for role, text in turns:
        digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
        first = False
    return digest, first


def _conversations(batches) -> Iterator[tuple[object, list[tuple]]]:
    """(conv_id, its rows (turn, role, text)) from batches that are sorted by conversation."""
    own, rows = None, []
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text")]
        for conv, *row in zip(*columns, strict=True):
            if rows and conv != own:
                yield own, rows
                rows = []
            own = conv
            rows.append(tuple(row))
    if rows:
        yield own, rows


def _repair(rows: list[tuple]) -> tuple:
    """(numbers of turns, faults, illegal neighbours, cost, audit, repaired turns) of a conversation's rows in order."""
    turns = [(role, text) for _, role, text in rows]
    seen: set[tuple[str, str]] = set()
    faults = []
    for turn in turns:
        faults.append(_fault(turn[1], turn in seen))
        seen.add(turn)
    initials = [role[:1] for role, _ in turns]
    ((cost, audit),) = cheapest([_kind(f) for f in faults], initials).values()
    return [t for t, *_ in rows if t is not None], faults, _illegal(initials), cost, audit, list(edited(turns, audit))


def _gaps(numbers: list[int]) -> int:
    return max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0


def _written(schema: pa.Schema, rows, at_once: int = 512):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == at_once:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _audits_of(found) -> Iterator[tuple]:
    for conv, rows in found:
        numbers, faults, illegal, cost, audit, kept = _repair(rows)
        sums = [sum(f[k] for f in faults) for k in range(3)]
        yield (conv, _gaps(numbers), *sums, illegal, cost, audit, _digest((r, t) for _, r, t in kept)[0].hexdigest())


def _turns_of(found) -> Iterator[tuple]:
    for conv, rows in found:
        for place, (edit, role, text) in enumerate(_repair(rows)[-1]):
            yield (conv, place, edit, role, text)


def _prepared(conversations: DataFrame) -> DataFrame:
    space = F.lit(" ")
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))


def _long(turns: DataFrame) -> DataFrame | None:
    """Conversations that are handled in fragments; None if there are none."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("_rows"), F.sum(F.octet_length("text")).alias("_bytes"))
    # all rows and bytes bound their number; the table is small beside what it stands for, and is measured before a broadcast
    long = saved(sizes.filter((F.col("_rows") > LONG_ROWS) | (F.col("_bytes") > LONG_BYTES)).select(F.col("conv_id").alias("_long")), "long-conversations")
    return with_small(long, 100_000) if long.limit(1).count() else None


def _ordered(turns: DataFrame) -> DataFrame:
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _both(conversations: DataFrame, short, schema: str, long) -> DataFrame:
    """Short conversations by ``short`` (found -> rows), long ones by ``long`` (their turns -> a table)."""
    small_batches(conversations.sparkSession)
    turns = _prepared(conversations)
    schema = schema.format(id=dict(turns.dtypes)["conv_id"])
    arrow = _arrow(turns.sparkSession, schema)
    ids = _long(turns)
    rest = turns if ids is None else turns.join(ids, F.col("conv_id").eqNullSafe(F.col("_long")), "left_anti")
    out = _ordered(rest).mapInArrow(lambda batches: _written(arrow, short(_conversations(batches))), schema)
    if ids is None:
        return out
    return out.unionByName(long(turns.join(ids, F.col("conv_id").eqNullSafe(F.col("_long")), "left_semi"), arrow, schema))


def _arrow(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def audits(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row per conversation that has rows.

    Turns are taken by number, nulls first, equal numbers by role and text. A turn is blank without
    anything but ASCII white space, else a duplicate if role and text occurred before, else truncated if its last such character is none of
    ``.!?``. ``audit`` holds the initials of the cheapest edits in order (Keep, Rerole, Delete, Insert): blank turns and duplicates go,
    and the initials of the roles become nothing or ``s?(ua)+``. The digest is that of the repaired ``role:text`` lines.
    gaps are numbers missing between the least and greatest turn; illegal are neighbours that are none of su, ua, au.
    Null roles and texts count as one space, so that the latter are blank; rows without conv_id are one conversation;
    other columns are not read; an empty table gives an empty result.
    """
    return _both(conversations, _audits_of, AUDIT, _long_audits)


def repaired(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the repaired conversations, a row per turn, with the edit (K, R or I) that it comes from.

    Conversations that lose all turns have no rows. See audits.
    """
    return _both(conversations, _turns_of, TURNS, _long_turns)


# Long conversations, by fragments. The rows that take part are many, the conversations few.

_FRAGMENT = "conv_id {id}, part long, roles array<string>, texts array<string>, seen array<boolean>, copies array<long>"
_WAYS = "conv_id {id}, part long, ways array<struct<entry:string,end:string,cost:long,rank:int>>, faults array<long>, first string, last string"


def _fragments(turns: DataFrame) -> DataFrame:
    """A row per fragment: turns in order, whether role and text occurred before, and how many equal turns each stands for."""
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("_conv")
    place = F.struct(F.col("turn").isNotNull().alias("k"), F.coalesce("turn", F.lit(0)).alias("t"))
    rows = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    rows = saved(rows.select("*", conv, F.sha2(F.concat("role", F.lit("\0"), "text"), 256).alias("_key"), place.alias("_place")), "long-turns")
    firsts = rows.groupBy("_conv", "_key").agg(F.min("_place").alias("_first"), F.count("*").alias("n"))
    marked = join_hot(rows, saved(firsts, "first-turns"), ["_conv", "_key"]).withColumn("seen", F.col("_place") > F.col("_first"))
    schema = _FRAGMENT.format(id=dict(turns.dtypes)["conv_id"])
    arrow = _arrow(turns.sparkSession, schema)

    def cut(batches):
        def found():
            number, own, held, size = TaskContext.get().partitionId() << 40, None, [], 0
            for batch in batches:
                columns = [batch.column(n).to_pylist() for n in ("conv_id", "role", "text", "seen", "copies")]
                for conv, *row in zip(*columns, strict=True):
                    if held and (conv != own or len(held) >= LONG_ROWS or size > LONG_BYTES):
                        yield (own, number, *map(list, zip(*held, strict=True)))
                        number, held, size = number + 1, [], 0
                    own = conv
                    held.append(row)
                    size += len(row[1])
            if held:
                yield (own, number, *map(list, zip(*held, strict=True)))

        return _written(arrow, found(), 1)

    order = ["_conv", "_place", "role", F.substring("text", 1, 64)]
    dealt = marked.repartitionByRange(*order).sortWithinPartitions("_conv", "_place", "role", "text")
    return saved(dealt.select("conv_id", "role", "text", "seen", "copies").mapInArrow(cut, schema), "fragments")


def _opened(fragment: dict) -> tuple[list[tuple[str, str]], list[tuple[int, int, int]]]:
    """All turns of a fragment and their faults; those after the first of equal turns are duplicates."""
    turns, faults = [], []
    for role, text, seen, n in zip(*(fragment[k] for k in ("roles", "texts", "seen", "copies")), strict=True):
        turns += [(role, text)] * n
        faults += [_fault(text, seen)] + [_fault(text, True)] * (n - 1)
    return turns, faults


def _ways(fragments: DataFrame) -> DataFrame:
    """What each fragment costs from each entry to each end, and how its edits compare with those to other ends."""
    schema = _WAYS.format(id=dict(fragments.dtypes)["conv_id"])
    arrow = _arrow(fragments.sparkSession, schema)

    def summed(batches):
        def found():
            for batch in batches:
                for fragment in batch.to_pylist():
                    turns, faults = _opened(fragment)
                    initials = [role[:1] for role, _ in turns]
                    kinds = [_kind(f) for f in faults]
                    ways = []
                    for entry in NEXT:
                        ends = sorted((audit, end, cost) for end, (cost, audit) in cheapest(kinds, initials, entry, False).items())
                        ways += [{"entry": entry, "end": end, "cost": cost, "rank": rank} for rank, (_, end, cost) in enumerate(ends)]
                    sums = [sum(f[k] for f in faults) for k in range(3)] + [_illegal(initials)]
                    yield (fragment["conv_id"], fragment["part"], ways, sums, initials[0], initials[-1])

        return _written(arrow, found(), 16)

    return saved(fragments.mapInArrow(summed, schema), "ways")


#: What is to be inserted after the last turn to reach an end.
_TAIL = {"": (0, ""), "a": (0, ""), "u": (INSERT, "I"), "s": (2 * INSERT, "II")}


def _chosen(ways: DataFrame) -> DataFrame:
    """(conv_id, part, entry, end): from the last fragment to the first, the end of least cost; of equal ones that of the least edits."""
    schema = f"conv_id {dict(ways.dtypes)['conv_id']}, part long, entry string, end string, tail string"
    arrow = _arrow(ways.sparkSession, schema)

    def best(table):
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        after = {role: cost for role, (cost, _) in _TAIL.items()}
        steps = []
        for row in reversed(rows):
            to: dict[str, tuple[int, int, str]] = {}
            for way in row["ways"]:
                found = (way["cost"] + after[way["end"]], way["rank"], way["end"])
                to[way["entry"]] = min(to.get(way["entry"], found), found)
            steps.append({entry: end for entry, (_, _, end) in to.items()})
            after = {entry: cost for entry, (cost, _, _) in to.items()}
        role, out = "", []
        for i, (row, step) in enumerate(zip(rows, reversed(steps), strict=True)):
            out.append((row["conv_id"], row["part"], role, step[role], _TAIL[step[role]][1] if i == len(rows) - 1 else ""))
            role = step[role]
        return pa.Table.from_batches(_written(arrow, out), schema=arrow)

    return ways.select("conv_id", "part", "ways").groupBy("conv_id").applyInArrow(best, schema)


def _parts(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The fragments' ways and sums, and their edits and repaired turns."""
    fragments = _fragments(turns)
    ways = _ways(fragments)
    chosen = saved(_chosen(ways), "ways-chosen")
    own = chosen.select(F.col("part").alias("_part"), "entry", "end", "tail")  # numbers of parts are unique
    schema = f"conv_id {dict(turns.dtypes)['conv_id']}, part long, cost long, audit string, edits array<string>, roles array<string>, texts array<string>"
    arrow = _arrow(turns.sparkSession, schema)

    def written(batches):
        def found():
            for batch in batches:
                for fragment in batch.to_pylist():
                    rows, faults = _opened(fragment)
                    cost, audit = cheapest([_kind(f) for f in faults], [r[:1] for r, _ in rows], fragment["entry"], False)[fragment["end"]]
                    audit += fragment["tail"]
                    kept = list(edited(rows, audit, fragment["entry"]))
                    yield (fragment["conv_id"], fragment["part"], cost + INSERT * len(fragment["tail"]), audit, *([k[j] for k in kept] for j in range(3)))

        return _written(arrow, found(), 1)

    return ways, saved(fragments.join(own, F.col("part") == F.col("_part")).drop("_part").mapInArrow(written, schema), "repaired-fragments")


def _long_audits(turns: DataFrame, arrow: pa.Schema, schema: str) -> DataFrame:
    ways, parts = _parts(turns)
    numbers = turns.filter("turn IS NOT NULL").select("conv_id", "turn").distinct().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    # the digest runs over a conversation's texts in order; they pass through as rows of fragments, one at a time
    both = ways.join(parts.select(F.col("part").alias("_part"), "cost", "audit", "roles", "texts"), F.col("part") == F.col("_part"))
    both = both.join(numbers.select(F.col("conv_id").alias("_id"), "gaps"), F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    both = both.select("conv_id", "part", "faults", "first", "last", "cost", "audit", "roles", "texts", F.coalesce("gaps", F.lit(0)).alias("gaps"))

    def told(batches):
        def found():
            own, held = None, None

            def end():
                return (own, held["gaps"], *held["sums"], held["cost"], "".join(held["audit"]), held["digest"].hexdigest())

            for batch in batches:
                for row in batch.to_pylist():
                    if held is None or row["conv_id"] != own:
                        if held:
                            yield end()
                        own, held = row["conv_id"], {"sums": [0] * 4, "cost": 0, "audit": [], "last": None, "digest": None, "first": True, "gaps": row["gaps"]}
                    held["sums"] = [a + b for a, b in zip(held["sums"], row["faults"], strict=True)]
                    held["sums"][3] += held["last"] is not None and held["last"] + row["first"] not in LEGAL
                    held["cost"] += row["cost"]
                    held["audit"].append(row["audit"])
                    held["last"] = row["last"]
                    held["digest"], held["first"] = _digest(zip(row["roles"], row["texts"], strict=True), held["digest"], held["first"])
            if held:
                yield end()

        return _written(arrow, found(), 16)

    return both.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(told, schema)


def _long_turns(turns: DataFrame, arrow: pa.Schema, schema: str) -> DataFrame:
    from pyspark.sql import Window

    parts = _parts(turns)[1]
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("conv_id", F.col("part").alias("_part"), F.size("edits").alias("n")).withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rows = parts.join(starts.select("_part", "begin"), F.col("part") == F.col("_part"))
    rows = rows.select("conv_id", "begin", F.posexplode(F.arrays_zip("edits", "roles", "texts")).alias("i", "t"))
    return rows.select("conv_id", (F.col("begin") + F.col("i")).alias("place"), F.col("t.edits").alias("edit"), F.col("t.roles").alias("role"), F.col("t.texts").alias("text"))
