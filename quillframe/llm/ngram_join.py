"""N-gram Jaccard join with set relations: exact links and their components at a threshold.

A document's set has the hashes of its distinct word shingles. Two sets link when their intersection is
at least ``PERCENT`` hundredths of their union.

1. Equal sets become one class. Sets are dealt to size classes, and a size class's universe to parts: one
   more than linked sets of that class can differ by, so linked sets agree in a whole part. A set sends a
   signature for each of its fullest parts, as many as that takes: full parts rarely agree by chance.
   Sets that agree are joined in their task, and one row a signature and one row a set go on; a signature that
   a task has seen in several sets is kept, and sent no more. Signatures are written once, eight bytes each, and meet range by range of
   their hash, so that their shuffle is never on disk as a whole. Related sets form families, by connected components.
2. Within a family, the sets of a block are joined exactly. Index lists hold sets by position in order of
   size, and a set skips to the positions whose sizes allow a link. A set that differs little from the
   set before it derives its answers from that set's: only the lists of members that differ are read.
   Families of more than ``WIDE`` sets are dealt anew: with members in one order for all, about rarest first, linked sets share a member
   among the first ones of each, one more than a set of that size may lack. Sets go together only where they share a family, hence a size
   class, and such a member, so that chains of unlike sets break at both. Near copies are related by a few members first, and stand as one for the rest. Passages that many sets share come last in the order, as a broadcast table of
   counted cells tells. A family still above a block is cut by hash into blocks, each joined together with the family's pivots.
   Sets that are in the family's largest component by then have nothing to learn from each other; only the others are joined
   with every other block, in probe blocks of their own. So a group of copies of one text costs one pass over its blocks.
3. Links become components; of each component only a spanning star leaves a task.

Documents of one class are joined to their class by its key, never pair by pair; hot keys are joined by broadcast.

Shingles are compared by 64-bit hashes and whole sets by 128 bits. A chance match of two shingles moves one
count by one, and among the some hundred members of two sets it is rarer than one in 10**13.

Defined results: texts without words have empty sets and link with nothing; texts with fewer words than
a shingle have their whole sequence as one; null ids are kept and take part, but a component is named by
the least id that is not null (null if it has none); repeated rows link with each other; an empty table gives an
empty result; other columns are ignored by ``similar_components`` and kept by ``keep_one``, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillframe.llm.common import held_table, join_hot, materialise, text_groups
from quillframe.llm.graph import connected_components
from quillframe.llm.words import Words, mix

#: Words of a shingle, and the threshold in hundredths.
SHINGLE, PERCENT = 5, 80
#: Growth of the size classes' upper ends.
CLASS_RATIO = 1.35
#: Sets, and members of sets, in a block; pivots of a family that has several blocks.
BLOCK, BLOCK_MEMBERS = 2048, 1 << 20
#: Sets from which a family is dealt anew.
WIDE = 64
PIVOTS = 4
#: Rows up to which a table of family members is broadcast (some 20 MB, as rows have a fixed width); above, it is joined by shuffle.
SMALL = 300_000
#: Cells of the counts that order members by rarity: 16 MB, broadcast, at any size of input; and cells in a row of counts.
CELLS, STRETCH = 1 << 23, 1 << 13
#: First members of a set, by hash, that relate near copies before all others are compared.
LEADS = 4
#: Shared signatures that a task remembers.
REMEMBERED = 1 << 18
#: Ranges of their hash in which signatures meet, a power of two, and signatures that meet at once at least (some 300 MB in the shuffle).
SLICES, ROUND = 8, 1 << 24


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    words = Words(texts, lower=True)
    hashes, inside = words.windows(size)
    sets = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        sets.append(np.unique(hashes[a:b][inside[a:b]] if b - a >= size else _short(words.hashes[a:b])))
    return sets


def _short(hashes: np.ndarray) -> np.ndarray:
    """A sequence shorter than a shingle as one member, apart from all whole shingles."""
    if not len(hashes):
        return hashes
    return np.frombuffer(hashlib.blake2b(b"short" + hashes.tobytes(), digest_size=8).digest(), np.uint64)


def _key(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def _class_ends(most: int) -> np.ndarray:
    """Upper ends of the size classes, up to the first that holds ``most``."""
    ends = [1]
    while ends[-1] < most:
        ends.append(max(ends[-1] + 1, int(ends[-1] * CLASS_RATIO)))
    return np.array(ends, np.int64)


def _node(key: bytes, size_class: int) -> int:
    """A set in a size class, as 64 bits; a chance match merely joins two families."""
    return int.from_bytes(hashlib.blake2b(key + size_class.to_bytes(4, "little"), digest_size=8).digest(), "little", signed=True)


def _classes(n: int, ends: np.ndarray, percent: int) -> range:
    """The size classes of the larger set in any link of a set with ``n`` members."""
    return range(int(np.searchsorted(ends, n)), int(np.searchsorted(ends, n * 100 // percent)) + 1)


def _signatures(sets: list[np.ndarray], keys: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Part signatures of sets and the node each stands for."""
    ends = _class_ends(max([1, *(len(s) * 100 // percent for s in sets)]))
    picks = [(i, c) for i, s in enumerate(sets) if len(s) for c in _classes(len(s), ends, percent)]
    if not picks:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    nodes = np.array([_node(keys[i], c) for i, c in picks], np.int64)
    # |A - B| + |B - A| of a link is at most (100 - percent) / (100 + percent) of |A| + |B|; parts are as many as a class needs, so
    # that all its sets are cut alike, but a small set's links cannot differ by so much
    most = np.array([2 * int(ends[c]) * (100 - percent) // (100 + percent) for _, c in picks], np.int64)
    parts = most + 2 + 3 * most // 20
    differ = np.array([(len(sets[i]) + min(int(ends[c]), len(sets[i]) * 100 // percent)) * (100 - percent) // (100 + percent) for i, c in picks], np.int64)
    base = np.cumsum(parts) - parts
    members = np.concatenate([sets[i] for i, _ in picks])
    owner = np.repeat(np.arange(len(picks)), [len(sets[i]) for i, _ in picks])
    spread = mix(members ^ np.uint64(0xA5A5A5A55A5A5A5A))
    part = base[owner] + (spread % parts[owner].astype(np.uint64)).astype(np.int64)
    total = int(parts.sum())
    sums = np.zeros(total, np.uint64)
    np.add.at(sums, part, mix(spread))
    counts = np.bincount(part, minlength=total)
    of = np.repeat(np.arange(len(picks)), parts)
    # the fullest parts, one more than may differ, ties included: of two linked sets, the one that asks for more
    # members finds a part that both have, and the other sends it too
    asked = -np.sort(np.stack([of * (1 << 32) - counts]), axis=1)[0][base + differ] + of[base] * (1 << 32)
    sent = np.flatnonzero(counts >= asked[of])
    place = (np.array([c for _, c in picks], np.uint64)[of] << np.uint64(40)) | (np.arange(total) - base[of]).astype(np.uint64)
    return mix(sums[sent] + mix(place[sent])), nodes[of[sent]]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col).cast("long"), text_col).alias("row"), F.col(text_col).alias("text"))


def _set_table(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(doc_id, row, n, key, nodes) of each row; key is null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_groups(batch):
                sets = shingle_sets(texts, shingle)
                keys = [_key(s) if len(s) else None for s in sets]
                ends = _class_ends(max([1, *(len(s) * 100 // percent for s in sets)]))
                nodes = [[_node(k, c) for c in _classes(len(s), ends, percent)] if k else [] for s, k in zip(sets, keys, strict=True)]
                columns = [batch.column(0).slice(start, len(texts)), batch.column(1).slice(start, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "n", "key", "nodes"])

    return rows.mapInArrow(run, "doc_id long, row long, n long, key binary, nodes array<long>")


#: Rows of packed signatures: ``n`` of a slice, and nodes, each with the number of its signatures; slice -1 has pairs of nodes that tasks have related.
_PACKED = "slice int, n long, signatures binary, nodes binary, sizes binary"


def _packed(signatures: np.ndarray, nodes: np.ndarray, pairs: np.ndarray) -> pa.RecordBatch:
    part = (signatures >> np.uint64(65 - SLICES.bit_length())).astype(np.int64)
    order = np.lexsort((nodes, part))
    signatures, nodes = signatures[order], nodes[order]
    rows = [(-1, len(pairs), pairs[:, 0].tobytes(), pairs[:, 1].tobytes(), b"")] if len(pairs) else []
    ends = np.searchsorted(part[order], np.arange(SLICES + 1)).tolist()
    for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        if a < b:
            first = np.flatnonzero(np.concatenate([[True], nodes[a + 1 : b] != nodes[a : b - 1]]))
            sizes = np.diff(np.concatenate([first, [b - a]])).astype(np.int32)
            rows.append((k, b - a, signatures[a:b].tobytes(), nodes[a:b][first].tobytes(), sizes.tobytes()))
    kinds = {"slice": pa.int32(), "n": pa.int64(), "signatures": pa.binary(), "nodes": pa.binary(), "sizes": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))


def _relations(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b): nodes that agree in a part, as stars.

    Signatures are written once, packed by ``SLICES`` ranges of their hash, and meet range by range (several at a time while they are few), so
    that the shuffle of all of them with their nodes never stands on disk as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, kept_nodes = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for _, texts in text_groups(batch):
                sets = [s for s in {_key(s): s for s in shingle_sets(texts, shingle)}.values() if len(s)]
                signatures, nodes = _signatures(sets, [_key(s) for s in sets], percent)
                order = np.lexsort((nodes, signatures))
                signatures, nodes = signatures[order], nodes[order]
                first = np.flatnonzero(np.concatenate([[True], signatures[1:] != signatures[:-1]])) if len(order) else order
                counts = np.diff(np.concatenate([first, [len(order)]]))
                pairs = np.column_stack([nodes, np.repeat(nodes[first], counts)])
                found, at = signatures[first], np.searchsorted(kept, signatures[first])
                seen = np.zeros(len(found), bool)
                if len(kept):
                    at = np.minimum(at, len(kept) - 1)
                    seen = kept[at] == found
                    pairs = np.concatenate([pairs, np.column_stack([nodes[first][seen], kept_nodes[at[seen]]])])
                pairs, roots = _stars(np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0))
                new = ~seen
                heads = nodes[first][new]
                heads = np.array([roots.get(x, x) for x in heads.tolist()], np.int64) if roots else heads
                several = counts[new] > 1
                if several.any() and len(kept) < REMEMBERED:
                    kept, kept_nodes = np.concatenate([kept, found[new][several]]), np.concatenate([kept_nodes, heads[several]])
                    order = np.argsort(kept)
                    kept, kept_nodes = kept[order], kept_nodes[order]
                yield _packed(found[new], heads, pairs)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for signatures, nodes, sizes in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                held = np.frombuffer(nodes, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(signatures, np.int64)), pa.array(np.repeat(held, np.frombuffer(sizes, np.int32)) if sizes else held)], names=["a", "b"])

    columns = ["signatures", "nodes", "sizes"]
    with held_table(rows.select("text").mapInArrow(run, _PACKED), "signatures", "slice") as table:
        n = table.where("slice >= 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        rounds = max(1, min(SLICES, -(-n // ROUND)))
        parts = [materialise(table.where("slice = -1").select(columns).mapInArrow(unpacked, "a long, b long").distinct(), "relations")]
        for k in range(rounds):
            sent = table.where(F.col("slice").isin([s for s in range(SLICES) if s * rounds // SLICES == k])).select(columns).mapInArrow(unpacked, "signature long, a long")
            least = F.min("a").over(Window.partitionBy("signature"))
            parts.append(materialise(sent.withColumn("b", least).where("a <> b").select("a", "b").distinct(), "relations"))
    return functools.reduce(DataFrame.unionByName, parts)


def _stars(pairs: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
    """A spanning star of each component of the pairs: (node, root) rows, and the same as a dictionary."""
    names, ends = np.unique(pairs, return_inverse=True)
    union = _Union(len(names))
    for a, b in ends.reshape(-1, 2).tolist():
        union.join(a, b)
    roots = {int(names[k]): int(names[union.find(k)]) for k in range(len(names)) if union.find(k) != k}
    return np.array(list(roots.items()), np.int64).reshape(-1, 2), roots


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.find(x)] = self.find(y)


class _Lists:
    """Index lists of sets by position: for each member the positions that hold it, ascending, end to end in one sorted array."""

    def __init__(self, members: np.ndarray, positions: np.ndarray, n: int):
        self.n = n
        self.flat = np.sort(members * n + positions)

    def tally(self, members: np.ndarray, low: int, high: int) -> np.ndarray:
        """How often each position in [low, high) stands in the members' lists; each list is entered and left by binary search."""
        begin, end = np.searchsorted(self.flat, members * self.n + low), np.searchsorted(self.flat, members * self.n + high)
        sizes = end - begin
        at = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        return np.bincount(self.flat[at] % self.n - low, minlength=high - low)


def link_stars(sets: list[np.ndarray], percent: int, asking: set[int] | None = None) -> list[tuple[int, int]]:
    """Exact links among sets, as (member, chosen member of its component) for every member that has a link.

    With ``asking``, only links that one of these sets has.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    union = _Union(len(sets))
    if len(order) < 2 or not sizes[-1]:
        return []
    owner = np.repeat(np.arange(len(order)), sizes)
    _, member, counts = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    held = counts[member] > 1
    by_set = np.split(member[held], np.cumsum(np.bincount(owner[held], minlength=len(order)))[:-1])
    lists = _Lists(member[held], owner[held], len(order))

    def bounds(n: int, slack: int) -> tuple[int, int]:
        low, high = -(-n * percent // 100) - slack, n * 100 // percent + slack
        return int(np.searchsorted(sizes, low)), int(np.searchsorted(sizes, high, side="right"))

    last: tuple[np.ndarray, np.ndarray, int, int] | None = None
    shared = np.array([len(b) for b in by_set])
    # similar sets have their least common member alike, and come one after the other
    chosen = (k for k in range(len(order)) if shared[k] * 100 >= percent * sizes[k] and (asking is None or order[k] in asking))
    for k in sorted(chosen, key=lambda k: (int(by_set[k][0]) if len(by_set[k]) else -1, k)):
        n, mine = int(sizes[k]), np.sort(by_set[k])
        low, high = bounds(n, 0)
        answers = None
        if last is not None and last[2] <= low and high <= last[3]:
            more, less = np.setdiff1d(mine, last[0], assume_unique=True), np.setdiff1d(last[0], mine, assume_unique=True)
            if 2 * (len(more) + len(less)) < len(mine):
                answers = last[1] + lists.tally(more, last[2], last[3]) - lists.tally(less, last[2], last[3])
                from_low = last[2]
        if answers is None:
            from_low, to_high = bounds(n, n // 8)
            answers = lists.tally(mine, from_low, to_high)
            last = (mine, answers, from_low, to_high)
        both = answers[low - from_low : high - from_low]
        linked = np.flatnonzero(100 * both >= percent * (n + sizes[low:high] - both)) + low
        for j in linked.tolist():
            if j != k:
                union.join(k, j)
    return [(order[k], order[union.find(k)]) for k in range(len(order)) if union.find(k) != k]


def _texts_of(dealt: DataFrame, rows: DataFrame) -> DataFrame:
    """(row, text) of the rows that are dealt; rows that repeat one another in id and text are one row here."""
    return rows.select("row", "text").join(dealt.select("row").distinct(), "row", "left_semi").groupBy("row").agg(F.first("text").alias("text"))


def _cell_counts(texts: DataFrame, shingle: int) -> np.ndarray:
    """How many members of the sets of all ``texts`` fall into each of ``CELLS`` cells by their hash, up to 65,535.

    Tasks send their counts as stretches of cells; stretches of one place are added where they meet, and only the sums go to the driver.
    """
    most = np.iinfo(np.uint16).max

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(-(-CELLS // STRETCH) * STRETCH, np.uint16)
        for batch in batches:
            for _, group in text_groups(batch):
                found, n = np.unique(_cells(np.concatenate(shingle_sets(group, shingle))), return_counts=True)
                cells[found] = np.minimum(cells[found] + n, most)
        stretches = cells.reshape(-1, STRETCH)
        for held in np.array_split(np.flatnonzero(stretches.any(axis=1)), 16):
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([stretches[i].tobytes() for i in held], pa.binary())], names=["stretch", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                more = np.frombuffer(counts.as_buffer(), np.uint16)
                sums[i] = np.minimum(sums[i].astype(np.int64) + more, most).astype(np.uint16) if i in sums else more.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["stretch", "counts"])

    schema = "stretch int, counts binary"
    table = texts.select("text").mapInArrow(count, schema).repartition("stretch").mapInArrow(add, schema).toArrow()
    cells = np.zeros((-(-CELLS // STRETCH), STRETCH), np.uint16)
    for i, counts in zip(table["stretch"].to_pylist(), table["counts"], strict=True):
        cells[i] = np.frombuffer(counts.as_buffer(), np.uint16)
    return cells.ravel()


def _cells(members: np.ndarray) -> np.ndarray:
    return (mix(members) % np.uint64(CELLS)).astype(np.int64)


def first_members(members: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The members of a set that come first by the count of their cell, then by hash: one more than a linked set may lack.

    Every set is put in the same order, whatever the counts are, so the first ones of two linked sets always meet.
    """
    reach = len(members) + -len(members) * percent // 100 + 1
    return members[np.lexsort((members, counts[_cells(members)]))[:reach]]


def _rare_relations(sets: DataFrame, rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, label): components of nodes of sets (row, key, dealt: their families and nodes) that share a family and a member among their rarest.

    Rarity is told by the counts of ``CELLS`` cells, which are broadcast; so only the first members of a set leave its task. Near copies share
    most of these, so nodes are first related by ``LEADS`` members each, least by hash, of which near copies share one as a rule. Then a
    component stands for its nodes: all members are compared, but only those that two components have are joined, not
    all that near copies share.
    """
    small = F.broadcast(sets) if sets.count() <= SMALL else sets
    with held_table(_texts_of(small, rows).join(small, "row").select("text", "key", "dealt.family", "dealt.node"), "wide_texts") as texts:
        shared = rows.sparkSession.sparkContext.broadcast(_cell_counts(texts, shingle))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start, group in text_groups(batch):
                    keys, families, nodes = (batch.column(c).slice(start, len(group)).to_pylist() for c in (1, 2, 3))
                    owners, members = [], []
                    for i, s in enumerate(shingle_sets(group, shingle)):
                        if _key(s) == keys[i]:
                            first = np.sort(mix(first_members(s, shared.value, percent)))
                            owners += nodes[i]
                            members += [mix(first ^ f).view(np.int64) for f in np.array(families[i], np.int64).view(np.uint64)]
                    yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(members, pa.list_(pa.int64()))], names=["node", "members"])

        first = materialise(texts.mapInArrow(run, "node long, members array<long>"), "rare_members")
    leads = _member_stars(first.select("node", F.explode(F.slice("members", 1, LEADS)).alias("member")), "lead_relations")
    related = connected_components(leads)
    held = first.join(related, "node", "left").select(F.coalesce("label", "node").alias("node"), F.explode("members").alias("member"))
    stars = _member_stars(held, "rare_relations")
    return connected_components(leads.unionByName(stars))


def _member_stars(held: DataFrame, name: str) -> DataFrame:
    """(a, b): nodes of (node, member) and the least node that has the same member, as a table of that name."""
    with held_table(held, "held_members") as held:
        least = held.groupBy("member").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("key_rows")).where("least < most").drop("most")
        stars = join_hot(held, least, "member").where("least is not null and least <> node").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
        return materialise(stars, name)


def _join_blocks(dealt: DataFrame, rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b): keys of linked sets, as stars, within each block of (row, key, family, one, two, asks)."""
    dealt = materialise(dealt, "family_blocks")
    if dealt.count() <= SMALL:
        dealt = F.broadcast(dealt)
    pieces = _texts_of(dealt, rows).join(dealt, "row").repartition("family", "one", "two")

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        sets, asking = {}, set()
        for key, members, asks in zip(frame["key"], shingle_sets(list(frame["text"]), shingle), frame["asks"], strict=True):
            if bytes(key) == _key(members):
                sets[bytes(key)] = members
                if asks:
                    asking.add(bytes(key))
        keys = list(sets)
        return pd.DataFrame([(keys[a], keys[b]) for a, b in link_stars(list(sets.values()), percent, {i for i, k in enumerate(keys) if k in asking})], columns=["a", "b"])

    return pieces.groupBy("family", "one", "two").applyInPandas(join, "a binary, b binary")


def _sized(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Families of several sets with their number of sets and of blocks, and their members beside the number of blocks."""
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_MEMBERS)).cast("int")
    sizes = materialise(members.groupBy("family").agg(F.count("*").alias("key_rows"), blocks.alias("blocks")).where("key_rows > 1"), "families")
    return sizes, join_hot(members, sizes.withColumn("family_sets", F.col("key_rows")), "family").where("blocks is not null")


def _components_of_links(members: DataFrame, rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(key, label): components of linked sets, from families (family, row, key, n, node)."""
    sizes, told = _sized(members)
    narrow = F.col("family_sets") <= min(WIDE, BLOCK)
    whole = told.where(narrow).drop("blocks", "family_sets")
    wide = materialise(told.where(~narrow).drop("blocks", "family_sets"), "wide_families")
    if wide.limit(1).count():
        by_set = wide.groupBy("key").agg(F.first("row").alias("row"), F.collect_set(F.struct("family", "node")).alias("dealt"))
        finer = wide.join(_rare_relations(materialise(by_set, "wide_sets"), rows, shingle, percent), "node").select(F.xxhash64("label", F.lit("finer")).alias("family"), "row", "key", "n", "node")
        sizes, told = _sized(materialise(whole.unionByName(finer), "finer_families"))
    dealt = materialise(told.withColumn("one", F.pmod(F.hash("key"), "blocks")), "blocks")
    columns = ["row", "key", "family", "one", F.lit(0).alias("two"), F.lit(True).alias("asks")]
    large = dealt.where("blocks > 1")
    chosen = large.groupBy("family", F.pmod(F.xxhash64("key"), F.lit(PIVOTS)).alias("nth")).agg(F.min(F.struct(F.xxhash64("row"), "row", "key", "blocks")).alias("p"))
    pivots = chosen.select("p.row", "p.key", "family", F.explode(F.sequence(F.lit(0), F.col("p.blocks") - 1)).alias("one"), F.lit(0).alias("two"), F.lit(True).alias("asks"))
    links = materialise(_join_blocks(dealt.select(columns).unionByName(pivots), rows, shingle, percent).distinct(), "links")
    found = connected_components(links).select(F.col("node").alias("key"), "label")
    if not large.limit(1).count():
        return found
    # sets outside of their family's largest component are joined with every block
    found = materialise(found, "block_components")
    placed = large.join(found, "key", "left").select("key", "row", "family", "blocks", "one", F.coalesce("label", "key").alias("label"))
    counted = placed.groupBy("family", "label").agg(F.count("*").alias("n"), F.first("blocks").alias("blocks"))
    top = counted.groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.sum("n").alias("key_rows"))
    others = materialise(join_hot(placed, top, "family").where("label <> top"), "others")
    probes = others.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("probes"), F.sum(F.lit(1)).alias("n_others"))
    asked = join_hot(others, probes.withColumnRenamed("n_others", "key_rows"), "family").withColumn("two", F.pmod(F.xxhash64("key"), "probes").cast("int"))
    asked = asked.select("row", "key", "family", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("one"), "two", F.lit(True).alias("asks"), F.col("one").alias("own")).where("one <> own").drop("own")
    told = join_hot(large.select("row", "key", "family", "one"), probes.join(sizes.select("family", "key_rows"), "family").drop("n_others"), "family").where("probes is not null")
    told = told.select("row", "key", "family", "one", F.explode(F.sequence(F.lit(0), F.col("probes") - 1)).alias("two"), F.lit(False).alias("asks"))
    more = _join_blocks(asked.unionByName(told), rows, shingle, percent)
    return connected_components(links.unionByName(more)).select(F.col("node").alias("key"), "label")


def _components(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Each row as (doc_id, row, n, key), and each key with its rows' number and the least (absent, doc_id, row) of its component."""
    rows = _rows(docs, id_col, text_col)
    table = materialise(_set_table(rows, shingle, percent), "sets")
    least = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row")
    classes = table.where("key is not null").groupBy("key").agg(F.min(least).alias("least"), F.count("*").alias("key_rows"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("nodes").alias("nodes"))
    classes = materialise(classes, "set_classes")
    families = connected_components(_relations(rows, shingle, percent)).withColumnRenamed("label", "family")
    members = classes.select("key", "row", "n", F.explode("nodes").alias("node")).join(families, "node").select("family", "row", "key", "n", "node")
    found = materialise(_components_of_links(materialise(members, "family_members"), rows, shingle, percent), "set_components")
    first = found.join(classes.select("key", "least"), "key").groupBy("label").agg(F.min("least").alias("first"), F.count("*").alias("key_rows"))
    told = join_hot(found, first, "label").select("key", "first")
    return table.drop("nodes"), materialise(classes.join(told, "key", "left").select("key", F.coalesce("first", "least").alias("first"), "key_rows"), "class_components")


def similar_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): the least id that links reach from each document."""
    table, classes = _components(docs, shingle, percent, id_col, text_col)
    return join_hot(table, classes, "key").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the least id (then row hash), with all its columns; empty sets all stay.

    Rows that repeat one another in id and text count as one document.
    """
    table, classes = _components(docs, shingle, percent, id_col, text_col)
    chosen = classes.select(F.col("first.doc_id").alias("kept_id"), F.col("first.row").alias("kept_row"))
    gone = table.where("key is not null").join(chosen, (F.col("row") == F.col("kept_row")) & F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_anti")
    gone = materialise(gone.select(F.col("row").alias("gone_row"), F.col("doc_id").alias("gone_id")).distinct(), "dropped")
    if gone.count() <= SMALL:
        gone = F.broadcast(gone)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.xxhash64(F.col(id_col).cast("long"), text_col).alias("row_hash"), F.col(id_col).cast("long").alias("own_id"))
    held = held.join(gone, (F.col("row_hash") == F.col("gone_row")) & F.col("own_id").eqNullSafe(F.col("gone_id")), "left_anti")
    if table.groupBy("doc_id", "row").count().where("count > 1").limit(1).count():
        held = held.groupBy("row_hash", "own_id").agg(F.first("doc").alias("doc"))
    return held.select("doc.*")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of every row of ``documents`` at 0.85 on shingles of four words."""
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4, percent=85)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
long_sets AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 4)),
sets AS (SELECT doc_id, s FROM long_sets UNION ALL SELECT doc_id, array_to_string(ws, ' ') AS s FROM w WHERE len(ws) BETWEEN 1 AND 3),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT shared.a, shared.b FROM shared JOIN sizes x ON x.doc_id = shared.a JOIN sizes y ON y.doc_id = shared.b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT least.doc_id, CAST(coalesce(sizes.n, 0) AS BIGINT) AS n_shingles, component_id FROM least LEFT JOIN sizes ON sizes.doc_id = least.doc_id
"""
