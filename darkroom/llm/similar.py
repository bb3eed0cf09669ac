"""Instructions that share nearly all of their word shingles, and the groups they form."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.llm.vocab import blocks
from darkroom.llm.words import Words, mix, windows
from darkroom.session import cut_lineage

#: Fewest bits of a parity bitmap; longer sets have longer ones, see ``_bits``.
BITS = 1024
#: Queries against one indexed text that go to one task; more of them are dealt over several.
PER_BLOCK = 4000
#: Members of a shingle's list that one task compares whole; a longer list is cut into blocks of about as many.
PER_LIST = 4096
#: The side of a set in a list: first or second block of a pair, a list or block compared with itself, a block whose leaders are told.
FIRST, SECOND, ITSELF, LEADERS = range(4)
NO_ID = -(1 << 63)
SET = "id long, row_hash long, n int, k1 long, k2 long, prefix array<long>, bits binary"


class Shingles:
    """Distinct shingles of every text: ``h`` sorted by text, with ``owner``, ``size`` in bytes and ``n``."""

    def __init__(self, texts: list[str | None], k: int) -> None:
        w = Words(texts, lower=True)
        count = w.count
        first = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
        h, at = windows(w.hash, k), np.arange(max(len(w.hash) - k + 1, 0))
        inside = w.owner[at] == w.owner[at + k - 1] if len(at) else np.zeros(0, bool)
        h, at = h[inside], at[inside]
        owner, size = w.owner[at], w.end[at + k - 1] - w.start[at]
        for i in np.flatnonzero((count > 0) & (count < k)):  # the whole short text is its one shingle
            a, b = first[i], first[i] + count[i]
            one = mix(windows(w.hash[a:b], int(count[i])) + np.uint64(count[i]))
            h, owner = np.append(h, one), np.append(owner, i)
            size = np.append(size, w.end[b - 1] - w.start[a])
        order = np.lexsort((h, owner))
        h, owner, size = h[order], owner[order], size[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        self.h, self.owner, self.size = h[new], owner[new], size[new]
        self.n = np.bincount(self.owner, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n)]).astype(np.int64)

    def key(self, salt: int) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.h + np.uint64(salt)), dtype=np.uint64)])
        return mix(sums[self.first[1:]] - sums[self.first[:-1]] + self.n.astype(np.uint64)).view(np.int64)


def least_overlap(a, b, share):
    """The smallest intersection at which sets of sizes ``a`` and ``b`` reach the similarity."""
    num, den = share
    return -((-num * (a + b)) // (num + den))


def common(n):
    """How many prefix shingles similar sets have in common at least; the prefix is as much longer."""
    return 1 + n // 100


def _bits(n: int, share: tuple[int, int]) -> int:
    """Bits of a set's bitmap: well over twice the number of shingles that may differ."""
    num, den = share
    return max(BITS, 1 << (26 * 2 * n * (den - num) // (10 * (den + num))).bit_length())


def _sets(rows: DataFrame, k: int, share: tuple[int, int]) -> DataFrame:
    """Per text its number of shingles, two keys of the set, its prefix and a bitmap of parities.

    The prefix holds so many shingles that similar sets have one in common. Longest shingles come
    first, then by hash: an order that is the same everywhere and puts rare ones in front.
    """
    num, den = share

    def run(batches):
        import pyarrow as pa

        for ids, hashes, texts in blocks(batches, "id", "row_hash", "text", most=2_000_000):
            s = Shingles(texts, k)
            order = np.lexsort((s.h, -s.size, s.owner))
            long = s.n - (-(-num * s.n // den)) + np.where(s.n > 0, common(s.n), 0)
            rank = np.arange(len(order)) - s.first[s.owner]
            picked = order[rank < long[s.owner]]
            bit = mix(s.h ^ np.uint64(0x51ED270B))
            out = []
            for i, n in enumerate(s.n.tolist()):
                width = _bits(n, share)
                mine = (bit[s.first[i]:s.first[i + 1]] & np.uint64(width - 1)).astype(np.int64)
                held = np.bincount(mine, minlength=width) & 1
                out.append(np.packbits(held.astype(np.uint8), bitorder="little").tobytes())
            offsets = np.concatenate([[0], np.cumsum(long)]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(s.h[picked].view(np.int64)))
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(s.n.astype(np.int32)), pa.array(s.key(1)),
                pa.array(s.key(2)), prefix, pa.array(out, pa.binary()),
            ], ["id", "row_hash", "n", "k1", "k2", "prefix", "bits"])

    return rows.mapInArrow(run, SET)


def _cut(listed: DataFrame, share: tuple[int, int]) -> DataFrame:
    """``s, n, tok`` of shingles that several sets have, with the block of every set in a long list.

    ``level`` is a size class so wide that similar sets are in one class or in neighbouring ones,
    ``salt`` a part of the class by hash and ``salts`` the number of parts of every class of the
    list. All three are null in lists of at most ``PER_LIST`` members.
    """
    width = max(math.log(share[1] / share[0]), 1e-6) * (1 + 1e-9)
    many = listed.groupBy("tok").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    shared = cut_lineage(listed.join(many, "tok").withColumn("level", F.when(F.col("many") > PER_LIST, F.floor(F.log("n") / F.lit(width)).cast("long"))))
    salts = shared.where("level is not null").groupBy("tok", "level").agg(F.ceil(F.count(F.lit(1)) / PER_LIST).cast("long").alias("parts"))
    salts = salts.groupBy("tok").agg(F.map_from_entries(F.collect_list(F.struct("level", "parts"))).alias("salts"))
    cut = shared.drop("many").join(salts, "tok", "left")
    return cut_lineage(cut.withColumn("salt", F.pmod(F.xxhash64("s"), F.try_element_at("salts", "level"))))


def _alone(members: DataFrame) -> DataFrame:
    """``members`` with ``list`` and ``side``: short lists whole, every block of a long one by itself."""
    short = F.col("salts").isNull()
    return members.withColumn("list", F.when(short, F.col("tok")).otherwise(F.xxhash64("tok", "level", "salt"))).withColumn(
        "side", F.when(short, F.lit(ITSELF)).otherwise(F.lit(LEADERS))
    )


def _paired(members: DataFrame) -> DataFrame:
    """``members`` with ``list`` and ``side``: short lists whole, and all pairs of blocks whose sizes may be similar."""
    level, salt = F.col("level"), F.col("salt")

    def beside(step: int):
        parts = F.coalesce(F.try_element_at("salts", level + F.lit(step).cast("long")), F.lit(0).cast("long"))
        return F.filter(F.sequence(F.lit(0).cast("long"), parts), lambda q: q < parts)

    place = lambda l1, r1, l2, r2, side: F.struct(F.xxhash64("tok", l1, r1, l2, r2).alias("list"), side.alias("side"))
    near = F.concat(
        F.transform(beside(0), lambda q: place(
            level, F.least(salt, q), level, F.greatest(salt, q),
            F.when(q == salt, F.lit(ITSELF)).when(salt < q, F.lit(FIRST)).otherwise(F.lit(SECOND)),
        )),
        F.transform(beside(1), lambda q: place(level, salt, level + 1, q, F.lit(FIRST))),
        F.transform(beside(-1), lambda q: place(level - 1, q, level, salt, F.lit(SECOND))),
    )
    whole = F.array(F.struct(F.col("tok").alias("list"), F.lit(ITSELF).alias("side")))
    return members.withColumn("at", F.explode(F.when(F.col("salts").isNull(), whole).otherwise(near))).select(
        *members.columns, F.col("at.list").alias("list"), F.col("at.side").alias("side")
    )


def _found(lists: DataFrame, share: tuple[int, int], across: bool) -> DataFrame:
    """``x, y, need, list``: pairs that may be similar; a null ``y`` names a set that stands for itself in a block."""
    def run(batches):
        import pyarrow as pa

        def table(out):
            return pa.RecordBatch.from_arrays([pa.array([v[k] for v in out], pa.int64()) for k in range(4)], ["x", "y", "need", "list"])

        out = []
        for name, held in _lists(batches):
            held = _List(held, share)
            for i, j in held.across() if across else held.stars():
                out.append((held.s[i], held.s[j], int(common(min(held.n[i], held.n[j]))), name))
                if len(out) >= 20_000:
                    yield table(out)
                    out = []
            if not across and held.side[0] == LEADERS:
                out += [(held.s[i], None, None, name) for i in held.leaders]
        if out:
            yield table(out)

    return lists.mapInArrow(run, "x long, y long, need long, list long")


def _stars(cut: DataFrame, lists, share: tuple[int, int]) -> DataFrame:
    """Pairs that may be similar: every set with one earlier set of each of its lists.

    So a list of near copies gives as many pairs as it has members. In a long list the sets of a
    block that stand for themselves are then held against those of the other blocks.
    """
    members = _alone(cut.withColumn("group", F.col("s")))
    found = cut_lineage(_found(lists(members), share, across=False))
    pairs, leaders = found.where("y is not null"), found.where("y is null").select("list", F.col("x").alias("s"))
    if not leaders.isEmpty():
        left = members.where(F.col("side") == LEADERS).join(leaders, ["list", "s"], "left_semi").drop("list", "side")
        pairs = pairs.unionByName(_found(lists(_paired(left).where(F.col("side") != ITSELF)), share, across=False))
    return pairs.select("x", "y").distinct()


def _across(members: DataFrame, lists, share: tuple[int, int]) -> DataFrame:
    """All pairs of different groups that may be similar and have enough prefix shingles in common."""
    found = _found(lists(_paired(members)), share, across=True)
    return found.groupBy("x", "y").agg(F.count(F.lit(1)).alias("many"), F.max("need").alias("need")).where("many >= need").select("x", "y")


def _lists(batches):
    """The lists of a partition sorted by list and size: its name and columns s, n, bits, group, side."""
    held, last = [], None
    for batch in batches:
        tok = batch.column("list").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(tok[1:] != tok[:-1]) + 1, [len(tok)]]).tolist() if len(tok) else [0]
        columns = [batch.column(c).to_pylist() for c in ("s", "n", "bits", "group", "side")]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and tok[a] != last:
                yield int(last), held
                held = []
            part = [c[a:b] for c in columns]
            held = [x + y for x, y in zip(held, part, strict=True)] if held else part
            last = tok[a]
    if held:
        yield int(last), held


class _List:
    """One list of sets in ascending order of size."""

    def __init__(self, held: list[list], share: tuple[int, int]) -> None:
        self.s, self.n, self.raw, self.group, self.side = held
        self.share = share
        self.big = [int.from_bytes(x, "little") for x in self.raw]
        self.base = None
        #: Members that ``stars`` has found to stand for themselves.
        self.leaders: list[int] = []

    def possible(self, i: int, j: int) -> bool:
        """Whether sizes and parities allow sets ``i`` and ``j`` to be similar."""
        a, b = self.n[i], self.n[j]
        num, den = self.share
        if den * min(a, b) < num * max(a, b):
            return False
        x, y, wx, wy = self.big[i], self.big[j], 8 * len(self.raw[i]), 8 * len(self.raw[j])
        while wx > wy:
            wx //= 2
            x = (x >> wx) ^ (x & (1 << wx) - 1)
        while wy > wx:
            wy //= 2
            y = (y >> wy) ^ (y & (1 << wy) - 1)
        return (x ^ y).bit_count() <= a + b - 2 * least_overlap(a, b, self.share)

    def near(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The same for many pairs at once on bitmaps folded to the fewest bits, so with more allowed."""
        if self.base is None:
            rows = []
            for raw in self.raw:
                row = np.frombuffer(raw, np.uint64)
                while len(row) > BITS // 64:
                    row = row[:len(row) // 2] ^ row[len(row) // 2:]
                rows.append(row)
            self.base, self.size = np.stack(rows), np.array(self.n, dtype=np.int64)
        a, b = self.size[x][:, None], self.size[y][None, :]
        apart = np.zeros((len(x), len(y)), dtype=np.int64)
        for w in range(self.base.shape[1]):
            apart += np.bitwise_count(self.base[x, w][:, None] ^ self.base[y, w][None, :])
        return (apart <= a + b - 2 * least_overlap(a, b, self.share)) & (self.share[1] * np.minimum(a, b) >= self.share[0] * np.maximum(a, b))

    def stars(self):
        """(member, earlier member) once for every member that may be similar to one standing for itself."""
        alone: list[int] = []
        many = len(self.s) > 12
        for a in range(0, len(self.s), 128):
            block = range(a, min(a + 128, len(self.s)))
            low = self.n[a] * self.share[0] // self.share[1] - 1
            alone = [p for p in alone if self.n[p] >= low]
            fresh: set[int] = set()
            if many:
                pool = np.array(alone + list(block))
                ok = self.near(np.array(block), pool)
            for k, i in enumerate(block):
                maybe = [j for j in pool[np.flatnonzero(ok[k])].tolist() if j < a or j in fresh] if many else alone
                j = next((j for j in maybe if self.possible(i, j)), None)
                if j is None:
                    alone.append(i)
                    fresh.add(i)
                    self.leaders.append(i)
                else:
                    yield i, j

    def across(self):
        """All (member, earlier member) of different groups and, in a pair of blocks, of both blocks that may be similar."""
        if self.group.count(self.group[0]) == len(self.group):
            return
        many = len(self.s) > 12
        for i in range(len(self.s)):
            if many and i % 128 == 0:
                block = np.arange(i, min(i + 128, len(self.s)))
                first = int(np.searchsorted(self.n, self.n[i] * self.share[0] // self.share[1] - 1))
                pool = np.arange(first, block[-1] + 1)
                ok = self.near(block, pool)
            maybe = pool[np.flatnonzero(ok[i % 128])].tolist() if many else range(i)
            for j in maybe:
                if j < i and self.group[i] != self.group[j] and (self.side[i] != self.side[j] or self.side[i] == ITSELF) and self.possible(i, j):
                    yield i, j


class Index:
    """Inverted lists of some sets, searched by T-occurrence with DivideSkip."""

    def __init__(self, names: list[int], sets: list[np.ndarray]) -> None:
        self.names, self.sizes = np.array(names), np.array([len(x) for x in sets])
        token = np.concatenate(sets)
        member = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.lexsort((member, token))
        self.token, start = np.unique(token[order], return_index=True)
        self.start = np.append(start, len(token))
        self.member = member[order]

    def search(self, tokens: np.ndarray, share: tuple[int, int]) -> np.ndarray:
        """Names of the sets similar to ``tokens``.

        The overlap must reach T. The longest lists are set aside, as many as T divided by the
        logarithm of their length allows; the short ones are merged in one heap-like sorted pass
        and leave the sets that occur often enough without the long ones. Those are then looked up
        in every long list by binary search.
        """
        at = np.searchsorted(self.token, tokens)
        at = at[self.token[np.minimum(at, len(self.token) - 1)] == tokens]
        need = -(-share[0] * len(tokens) // share[1])
        if len(at) < need:
            return self.names[:0]
        size = self.start[at + 1] - self.start[at]
        order = np.argsort(size, kind="stable")
        at, size = at[order], size[order]
        aside = int(min(need - 1, need / (0.1 * np.log2(max(int(size[-1]), 2)) + 1)))
        short, long = at[:len(at) - aside], at[len(at) - aside:]
        lengths = size[:len(short)]
        offsets = np.repeat(self.start[short] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        found, times = np.unique(self.member[offsets + np.arange(len(offsets))], return_counts=True)
        ok = (times >= need - aside) & (times + aside >= least_overlap(len(tokens), self.sizes[found], share))
        found, times = found[ok], times[ok]
        for t in long:
            if not len(found):
                break
            mine = self.member[self.start[t]:self.start[t + 1]]
            place = np.searchsorted(mine, found)
            times = times + (mine[np.minimum(place, len(mine) - 1)] == found)
        return self.names[found[times >= least_overlap(len(tokens), self.sizes[found], share)]]


def _links(pairs: DataFrame, sets: DataFrame, rows: DataFrame, k: int, share: tuple[int, int]) -> DataFrame:
    """The links among texts that ``pairs`` names, checked on their whole shingle sets.

    The second text of every pair is indexed, the first one is searched for. Indexed texts are
    dealt into blocks; one that very many others ask for has several blocks of its own. A task
    gives back only links that join something, so near copies give as many links as texts.
    """
    asked = pairs.groupBy("y").agg(F.count(F.lit(1)).alias("asked"))
    total = pairs.count()
    n_blocks = max(1, -(-total // 500))
    dealt = pairs.join(asked, "y").select("x", "y", F.when(
        F.col("asked") <= PER_BLOCK, F.pmod(F.xxhash64("y"), F.lit(n_blocks))
    ).otherwise(
        n_blocks + F.pmod(F.xxhash64("y", F.pmod(F.xxhash64("x"), F.ceil(F.col("asked") / PER_BLOCK))), F.lit(1 << 60))
    ).alias("block"))
    ends = dealt.select("block", F.col("y").alias("s"), F.lit(0).alias("role")).distinct().unionByName(
        dealt.select("block", F.col("x").alias("s"), F.lit(1).alias("role")).distinct()
    )
    # a set's text is found by id and hash; rows that repeat both come twice, which changes nothing
    wanted = cut_lineage(ends.join(sets.select("s", "id", "row_hash"), "s"))
    filled = wanted.join(
        rows.select(F.coalesce("id", F.lit(NO_ID)).alias("tid"), F.col("row_hash").alias("trow"), "text"),
        (F.coalesce("id", F.lit(NO_ID)) == F.col("tid")) & (F.col("row_hash") == F.col("trow")),
    ).select("block", "role", "s", "text")

    def run(batches):
        import pyarrow as pa

        block, index, names, sets_, parent = None, None, [], [], {}

        def root(v):
            while parent.setdefault(v, v) != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        for where, role, s, texts in blocks(batches, "block", "role", "s", "text", most=2_000_000):
            shingles = Shingles(texts, k)
            out = []
            for i, (b, r, name) in enumerate(zip(where, role, s, strict=True)):
                mine = shingles.h[shingles.first[i]:shingles.first[i + 1]]
                if b != block:
                    block, index, names, sets_, parent = b, None, [], [], {}
                if r == 0:
                    if name not in names[-1:]:
                        names.append(name)
                        sets_.append(mine)
                    continue
                index = index or Index(names, sets_)
                for other in index.search(mine, share).tolist():
                    u, v = root(name), root(other)
                    if u != v:
                        parent[u] = v
                        out.append((name, other))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["x", "y"]
            )

    return cut_lineage(filled.repartition("block").sortWithinPartitions("block", "role", "s").mapInArrow(run, "x long, y long").distinct())


def _renamed(links: DataFrame, names: DataFrame) -> DataFrame:
    """``links`` between what ``names`` (s, group) calls their ends; links within a group vanish."""
    for end in ("x", "y"):
        links = links.join(names.withColumnsRenamed({"s": end, "group": "to"}), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return links.where("x <> y").distinct()


def _groups(links: DataFrame) -> DataFrame:
    """``s, group``: the group of every set that has a link.

    Every set points to its smallest neighbour if that is smaller; pointers are followed to their
    ends, halving the way each time; then the links are contracted to the groups so found, and
    what is left goes round again. Links shrink by at least half a round, so both loops are short.
    """
    names, left = None, links.where("x <> y").distinct()
    while True:
        both = left.unionByName(left.select(F.col("y").alias("x"), F.col("x").alias("y")))
        up = cut_lineage(both.groupBy(F.col("x").alias("s")).agg(F.min(F.least("x", "y")).alias("group")))
        while True:
            higher = up.select(F.col("s").alias("group"), F.col("group").alias("top"))
            jumped = cut_lineage(up.join(higher, "group").select("s", F.col("top").alias("group"), (F.col("top") < F.col("group")).alias("moved")))
            up = jumped.select("s", "group")
            if jumped.where("moved").isEmpty():
                break
        if names is None:
            names = up
        else:
            named = names.join(up.select(F.col("s").alias("group"), F.col("group").alias("top")), "group", "left")
            names = cut_lineage(named.select("s", F.coalesce("top", "group").alias("group")))
        left = cut_lineage(_renamed(left, up))
        if left.isEmpty():
            return names


def similar_instructions(
    instructions: DataFrame, words: int = 5, share: tuple[int, int] = (80, 100), id: str = "id", instruction: str = "instruction"
) -> DataFrame:
    """Groups of instructions whose sets of distinct word shingles are similar.

    Two are linked when the intersection of their sets is at least ``share`` (a fraction) of the
    union. Words are parted by ASCII white space and A-Z is lower-cased; with fewer words than
    ``words`` the whole sequence is the one shingle. Returns per row ``id, row_hash, n_shingles,
    component_id, kept``: the smallest id reachable by links, and whether the row is the one of its
    group that stays (the one of the smallest id; of rows equal in id, one).

    Texts of equal sets are one set from the start. Similar sets must share a shingle of their
    prefixes, so lists of prefix shingles give possible pairs; sizes and parity bitmaps thin them,
    without losing a link. A list longer than ``PER_LIST`` is cut by size and hash, and pairs of its
    blocks are compared in tasks of their own. Each set is first searched for next to one earlier set of each list.
    Only what is then still apart is compared pair by pair. All searches are T-occurrence
    searches on whole sets. No pairs are formed within groups of near copies.

    Null and wordless texts have no shingles and are linked with nothing. A null id is no
    candidate for the smallest id unless the group has no other. An empty table gives no rows.
    """
    rows = instructions.select(
        F.col(id).cast("long").alias("id"), F.xxhash64(F.col(instruction).cast("string")).alias("row_hash"),
        F.col(instruction).cast("string").alias("text"),
    )
    docs = cut_lineage(_sets(rows, words, share).withColumn("row", F.monotonically_increasing_id()))
    key = ["k1", "k2", "n"]
    order = F.struct(F.col("id").isNull(), "id", "row")
    sets = cut_lineage(docs.where("n > 0").groupBy(*key).agg(
        F.min(order).alias("top"), F.min_by("prefix", order).alias("prefix"), F.min_by("bits", order).alias("bits"),
        F.min_by("row_hash", order).alias("row_hash"),
    ).select("*", F.col("top.id").alias("id"), F.monotonically_increasing_id().alias("s")))
    listed = sets.select("s", "n", F.explode("prefix").alias("tok"))
    shared = _cut(listed, share)

    def lists(members: DataFrame) -> DataFrame:
        thin = members.select("list", "side", "s", "n", "group")
        return thin.join(sets.select("s", "bits"), "s").repartition("list").sortWithinPartitions("list", "n", "s")

    pairs = cut_lineage(_stars(shared, lists, share))
    links = _links(pairs, sets, rows, words, share)
    groups = _groups(links)
    # lists all of whose members are in one group by now have nothing to add
    grouped = shared.join(groups, "s", "left").withColumn("group", F.coalesce("group", "s"))
    mixed = grouped.groupBy("tok").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("tok")
    more = cut_lineage(_across(grouped.join(mixed, "tok", "left_semi"), lists, share).join(pairs, ["x", "y"], "left_anti"))
    if not more.isEmpty():
        merged = _groups(_renamed(_links(more, sets, rows, words, share), groups))
        named = sets.join(groups, "s", "left").withColumn("group", F.coalesce("group", "s"))
        named = named.join(merged.select(F.col("s").alias("group"), F.col("group").alias("top_group")), "group", "left")
        named = named.withColumn("group", F.coalesce("top_group", "group"))
    else:
        named = sets.join(groups, "s", "left").withColumn("group", F.coalesce("group", "s"))
    tops = named.groupBy("group").agg(F.min("top").alias("top"))
    answer = named.select(*key, "group").join(tops, "group").select(*key, "top")
    with_set = docs.where("n > 0").select("id", "row_hash", "row", *key).join(answer, key)
    out = ["id", "row_hash", F.col("n").cast("long").alias("n_shingles")]
    return with_set.select(*out, F.col("top.id").alias("component_id"), (F.col("top.row") == F.col("row")).alias("kept")).unionByName(
        docs.where("n = 0").select(*out, F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    )
