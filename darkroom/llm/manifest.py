"""A Merkle manifest of job steps: one digest that vouches for every step, and a proof for each.

Every state is a tree of its own, its leaves in ascending step id. A leaf's place is not found by
sorting: the ids of a state are kept as 64-bit words of a bitmap, empty words left out, under
a directory of row counts, and a step's place is the count before its word plus the bits below
its own. Places then key fixed slots of 4096 leaves; a task fills one array of slots and reduces
four levels of eight at once, so a large state is spread over as many tasks as it has arrays.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darkroom.operators.ranks import ordinal_rank
from darkroom.session import cut_lineage

FAN = 8
HEIGHT = 4
SLOTS = FAN ** HEIGHT
SLOT_BITS = HEIGHT * (FAN.bit_length() - 1)
#: Bits of a word number that each directory level covers, from the words up: ids >> 16, 32, 48.
DIRECTORY = (10, 16, 16)
LOWEST = -(1 << 63)
ABOVE = "array<struct<left: string, right: string>>"


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256 (lowercase hex) of the values as text, each with its length in bytes; a null is ``-``."""
    said = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in said]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _digest(run: Sequence[str]) -> str:
    return sha256("".join(run).encode()).hexdigest()


def _height(n: int) -> int:
    """Levels until ``n`` nodes are one, as far as one array of slots reaches."""
    levels = 0
    while n > 1 and levels < HEIGHT:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _reduced(slots: list[str], height: int) -> list[list[str]]:
    """The slots and the levels above them, eight consecutive nodes to one."""
    levels = [slots]
    for _ in range(height):
        last = levels[-1]
        levels.append([_digest(last[i:i + FAN]) for i in range(0, len(last), FAN)])
    return levels


def _filled(table, value: str) -> tuple[int, list, int]:
    """(first place, values in their slots, nodes of the whole group) of one array."""
    places = table.column("pos").to_pylist()
    total = table.column("n")[0].as_py()
    base = places[0] // SLOTS * SLOTS
    slots: list = [None] * min(SLOTS, total - base)
    for place, v in zip(places, table.column(value).to_pylist(), strict=True):
        if slots[place - base] is not None:
            raise ValueError(f"two nodes for place {place}")
        slots[place - base] = v
    if None in slots:
        raise ValueError(f"no node for place {base + slots.index(None)}")
    return base, slots, total


def _around(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """Siblings left and right of node ``at`` on every level of an array, from the slots up."""
    found = []
    for level in levels[:-1]:
        run = at // FAN * FAN
        found.append(("".join(level[run:at]), "".join(level[at + 1:run + FAN])))
        at //= FAN
    return found


def _climbed(nodes: DataFrame) -> DataFrame:
    """(g, pos, n, digest) of the nodes that stand for whole arrays of ``nodes``."""
    def reduce(table):
        import pyarrow as pa

        base, slots, total = _filled(table, "digest")
        top = _reduced(slots, _height(total))[-1][0]
        return pa.table({
            "g": table.column("g").slice(0, 1), "pos": pa.array([base // SLOTS], pa.int64()),
            "n": pa.array([-(-total // SLOTS)], pa.int64()), "digest": pa.array([top], pa.string()),
        })

    arrays = nodes.select("g", "pos", "n", "digest").groupBy("g", F.shiftright("pos", SLOT_BITS).alias("array"))
    return arrays.applyInArrow(reduce, "g string, pos long, n long, digest string")


def _keyed(nodes: DataFrame, upper: DataFrame):
    """Arrays of ``nodes`` beside what ``upper`` says of the node each array becomes."""
    return nodes.groupBy("g", F.shiftright("pos", SLOT_BITS).alias("array")).cogroup(
        upper.groupBy("g", F.col("pos").alias("array"))
    )


def _siblings(nodes: DataFrame, upper: DataFrame) -> DataFrame:
    """(g, pos, above, subroot): the siblings of every node on its way up."""
    def open_array(table, over):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        base, slots, total = _filled(table, "digest")
        levels = _reduced(slots, _height(total))
        rest = over.column("above")[0].as_py()
        above = [[{"left": a, "right": b} for a, b in _around(levels, i)] + rest for i in range(len(slots))]
        n = len(slots)
        return pa.table({
            "g": pa.array([table.column("g")[0].as_py()] * n, pa.string()),
            "pos": pa.array(range(base, base + n), pa.int64()), "above": pa.array(above, kind),
            "subroot": pa.array([over.column("subroot")[0].as_py()] * n, pa.string()),
        })

    return _keyed(nodes.select("g", "pos", "n", "digest"), upper).applyInArrow(
        open_array, f"g string, pos long, above {ABOVE}, subroot string"
    )


def _levels(nodes: DataFrame, most: int) -> list[DataFrame]:
    """``nodes`` and every level of arrays above it, up to one node per group."""
    levels = [nodes]
    while True:
        levels.append(cut_lineage(_climbed(levels[-1])))
        most = -(-most // SLOTS)
        if most <= 1:
            return levels


def _directory(words: DataFrame) -> DataFrame:
    """Words with ``before``, the rows of their group in earlier words, and ``n``, all its rows.

    Counts are summed up four levels of ids and handed down again, so no task numbers more than
    65 536 entries of a level, however large a group is or far its ids are apart.
    """
    levels = [words.select("g", "at", "c")]
    for bits in DIRECTORY:
        levels.append(levels[-1].groupBy("g", F.shiftright("at", bits).alias("at")).agg(F.sum("c").alias("c")))
    group = Window.partitionBy("g")
    earlier = lambda w: F.coalesce(F.sum("c").over(w.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = levels[-1].select("g", "at", earlier(group).alias("before"), F.sum("c").over(group).alias("n"))
    for level, bits in zip(reversed(levels[:-1]), reversed(DIRECTORY), strict=True):
        mine = level.withColumn("up", F.shiftright("at", bits))
        mine = mine.select("g", "at", "up", earlier(Window.partitionBy("g", "up")).alias("inside"))
        over = known.select("g", F.col("at").alias("up"), "before", "n")
        known = mine.join(over, ["g", "up"]).select("g", "at", (F.col("before") + F.col("inside")).alias("before"), "n")
    return known


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` (g, id, row, digest, found) with ``pos``, the place in the group, and ``n``, its rows."""
    number = F.coalesce(F.col("id"), F.lit(LOWEST))
    rows = rows.withColumns({"at": F.shiftright(number, 6), "bit": number.bitwiseAND(F.lit(63)).cast("int")})
    words = cut_lineage(
        rows.groupBy("g", "at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.count(F.lit(1)).alias("c"))
    )
    index = words.join(_directory(words), ["g", "at"])
    met = rows.join(index, ["g", "at"])
    kept = ["g", "id", "digest", "found", "n"]
    single = F.col("c") == F.bit_count("bits")
    placed = met.where(single).select(
        *kept, (F.col("before") + F.bit_count(F.expr("bits & ~shiftleft(-1L, bit)"))).alias("pos")
    )
    if words.where(~single).isEmpty():
        return placed
    # A word holding repeated or missing ids cannot count them by bits: only its rows are ordered.
    crowd = ordinal_rank(met.where(~single), ["g", "id", "digest", "row"], "ordinal")
    first = crowd.groupBy("g", "at").agg(F.min("ordinal").alias("first"))
    told = crowd.join(first, ["g", "at"]).select(*kept, (F.col("before") + F.col("ordinal") - F.col("first")).alias("pos"))
    return placed.unionByName(told)


def step_manifest(
    steps: DataFrame, id: str = "id", group: str = "state", fields: Sequence[str] = ("id", "job_id", "state", "detail"),
    found: Sequence[Column] | None = None,
) -> DataFrame:
    """The manifest of job steps: each step's leaf, its tree and whether its proof leads to the root.

    A leaf is the SHA-256 of the step's ``fields`` (see ``leaf_digest``). Per ``group`` leaves ascend by
    ``id`` and every eight consecutive nodes become their digest until one is left, the subroot; the
    subroots, ordered by the group's name in bytes (null first), become the root in the same way.

    ``found`` gives the fields as they are met now (columns of ``steps``, in the order of ``fields``).
    ``folded_root`` is what that leaf and the recorded siblings lead to; ``verified`` says whether
    it is the root. Without ``found`` the recorded leaf is folded.

    Returns per row ``id`` (long), ``group``, ``position``, ``leaf``, ``subroot``, ``root``,
    ``proof_sha256``, ``folded_root``, ``verified``. Ids must be integers. Null ids come first; rows that
    share an id stand in the order of their leaves, so equal rows take neighbouring places. Null
    fields and groups count as values of their own; an empty table gives no rows. Texts of any
    length are digested whole. Only the named columns are read, whatever else the table holds.
    """
    now = [F.col(c) for c in fields] if found is None else list(found)
    # null before every name, then byte by byte
    name = F.coalesce(F.concat(F.lit(":"), F.col(group).cast("string")), F.lit("-"))
    rows = steps.select(
        F.col(id).cast("long").alias("id"), name.alias("g"), F.monotonically_increasing_id().alias("row"),
        leaf_digest([F.col(c) for c in fields]).alias("digest"),
        (F.lit(None).cast("string") if found is None else leaf_digest(now)).alias("found"),
    )
    rows = cut_lineage(rows.withColumn("found", F.nullif("found", "digest")))
    leaves = cut_lineage(_placed(rows))
    size = leaves.agg(F.max("n")).first()[0] or 0
    levels = _levels(leaves, size)

    tops = ordinal_rank(levels[-1].select(F.col("g").alias("name"), "digest"), ["name"], "pos")
    trees = tops.count()
    tops = tops.select("name", F.lit("").alias("g"), "pos", F.lit(trees).cast("long").alias("n"), "digest")
    over = _levels(tops, trees)
    root = over[-1].select("digest").first()  # one value, or none without rows
    known = over[-1].select("g", "pos", F.expr(f"cast(array() as {ABOVE})").alias("above"), F.col("digest").alias("subroot"))
    for nodes in reversed(over[:-1]):
        known = _siblings(nodes, known)
    known = known.select("pos", "above").join(tops.select("pos", "name", F.col("digest").alias("subroot")), "pos")
    known = known.select(F.col("name").alias("g"), F.lit(0).cast("long").alias("pos"), "above", "subroot")
    for nodes in reversed(levels[1:-1]):
        known = _siblings(nodes, known)

    top = None if root is None else root[0]

    def prove(table, over):
        import pyarrow as pa

        _, order, _ = _filled(table.append_column("line", pa.array(range(table.num_rows), pa.int64())), "line")
        table = table.take(pa.array(order, pa.int64()))
        leaf, changed = table.column("digest").to_pylist(), table.column("found").to_pylist()
        total = table.column("n")[0].as_py()
        levels = _reduced(leaf, _height(total))
        rest = [(s["left"], s["right"]) for s in over.column("above")[0].as_py()]
        # what stands above a node of each level is shared by all leaves below it
        shared = "".join(a + b for a, b in rest)
        higher: dict[int, tuple[str, list[tuple[str, str]]]] = {}
        proofs, folded = [], []
        for i, digest in enumerate(leaf):
            if i % FAN == 0:
                path = _around(levels, i)[1:]
                higher = {i // FAN: ("".join(a + b for a, b in path) + shared, path + rest)}
            told, path = higher[i // FAN]
            run = i // FAN * FAN
            left, right = ("".join(leaf[run:i]), "".join(leaf[i + 1:run + FAN])) if len(levels) > 1 else ("", "")
            proofs.append(sha256((left + right + told).encode()).hexdigest())
            node = changed[i] or digest
            if len(levels) > 1:
                node = sha256((left + node + right).encode()).hexdigest()
            for a, b in path:
                node = sha256((a + node + b).encode()).hexdigest()
            folded.append(node)
        n = len(leaf)
        return pa.table({
            "id": table.column("id"), "g": table.column("g"), "position": table.column("pos"), "leaf": pa.array(leaf, pa.string()),
            "subroot": pa.array([over.column("subroot")[0].as_py()] * n, pa.string()),
            "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()),
        })

    out = _keyed(leaves.select("g", "pos", "n", "id", "digest", "found"), known).applyInArrow(
        prove, "id long, g string, position long, leaf string, subroot string, proof_sha256 string, folded_root string"
    )
    named = F.when(F.col("g") != "-", F.substring("g", 2, (1 << 31) - 1)).cast(steps.schema[group].dataType)
    return out.select(
        "id", named.alias("group"), "position", "leaf", "subroot", F.lit(top).cast("string").alias("root"), "proof_sha256",
        "folded_root", (F.col("folded_root") == F.lit(top)).alias("verified"),
    )
