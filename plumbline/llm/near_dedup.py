"""SimHash near-duplicates through an index of the bytes of fingerprints.

A fingerprint is one or more lanes of 64 bits.  A text's postings are pairs,
triples ... of bytes of one group of positions; two fingerprints that share
enough positional bytes must share a posting (pigeonhole over the groups).  At
a posting the shared positional bytes of a pair are tallied; pairs that reach
the guaranteed minimum are verified by their differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import finished, slices, stored, utf8
from .components import components

SEED = 42
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16
#: Lists of so many fingerprints are first linked to a few of their own.
CROWD = 32
#: Words of 64 parities that sketch a set of shingles.
PARITIES = 8
#: Cells, by a shingle's lowest bits, that tell how often shingles occur; their counts travel with the tasks (1 MB),
#: and are added up in so many blocks.
CELLS = 1 << 18
BLOCKS = 64
#: Shared shingles of a node that tell where a pair meets first.
CARRIED = 16


@dataclass(frozen=True)
class Plan:
    """How fingerprints are made and compared.

    ``groups`` holds byte positions (0 is the lowest byte of the first lane); a posting is
    ``posting_bytes`` of one group.  Pairs that share ``guaranteed`` bytes are certain to meet;
    a tally below ``least_shared`` (else below that guarantee) is dropped.  With ``distinct``
    a shingle counts once however often a text repeats it.
    """

    words: int
    lanes: int
    groups: tuple[tuple[int, ...], ...]
    posting_bytes: int
    max_bits: int
    least_shared: int | None = None
    distinct: bool = False

    @property
    def guaranteed(self) -> int:
        return len(self.groups) * (self.posting_bytes - 1) + 1

    @property
    def min_shared(self) -> int:
        return self.guaranteed if self.least_shared is None else self.least_shared

    @property
    def postings(self) -> list[tuple[int, ...]]:
        return [c for g in self.groups for c in combinations(g, self.posting_bytes)]


PARITY_COLUMNS = [f"parity{i}" for i in range(PARITIES)]

#: 3 differing bits spoil at most 3 of 8 bytes: 5 are shared, 3 of them in one half.
NARROW = Plan(words=3, lanes=1, groups=((0, 1, 2, 3), (4, 5, 6, 7)), posting_bytes=3, max_bits=3)


def shingles(text: bytes, words: int) -> list[bytes]:
    """Word shingles with repeats; of fewer words the whole sequence, of none nothing."""
    found = text.lower().split()
    if len(found) <= words:
        return [b" ".join(found)] if found else []
    return [b" ".join(s) for s in zip(*(found[i:] for i in range(words)))]


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Further 64 bits of a hash: the finaliser of a splitmix generator, moved on by the lane."""
    if lane == 0:
        return h
    z = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(lane)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def hashes(text: bytes, words: int) -> np.ndarray:
    """The shingles of a text, with repeats, as unsigned hashes."""
    found = shingles(text, words)
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), dtype=np.uint64, count=len(found))


def majorities(h: np.ndarray, lanes: int) -> list[int]:
    """Lanes of the fingerprint of some hashes, as signed longs; all zero for none."""
    out = []
    for lane in range(lanes):
        ones = np.zeros(64, dtype=np.int64)
        for start in range(0, len(h), BLOCK):
            bits = _mixed(h[start:start + BLOCK], lane).astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0]))
    return out


def parities(once: np.ndarray) -> list[int]:
    """Whether an odd number of distinct hashes falls into each of some cells, as signed longs.

    Every hash that only one of two sets has turns one cell over, so sets differ in at least as many
    hashes as their parities differ in bits.
    """
    cells = (_mixed(once, 1) >> np.uint64(64 - (64 * PARITIES - 1).bit_length())).astype(np.int64)
    odd = np.bincount(cells, minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8").tolist()


def fingerprint(text: bytes, words: int = 3, lanes: int = 1, distinct: bool = False) -> list[int]:
    """Lanes of the fingerprint of a text, over its shingles with or without their repeats."""
    h = hashes(text, words)
    return majorities(np.unique(h) if distinct else h, lanes)


def fingerprints(docs: DataFrame, plan: Plan, content: bool = False) -> DataFrame:
    """(doc_id, lane0, lane1, ...) of every row; a null text is an empty one.

    With ``content`` further columns have a digest of the distinct shingles, their number and their parities.
    """
    names = [f"lane{i}" for i in range(plan.lanes)]
    more = ["content", "shingle_count", *PARITY_COLUMNS] if content else []
    words, lanes, distinct = plan.words, plan.lanes, plan.distinct

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            prints, digests, sizes, sketches = [], [], [], []
            for text in utf8(part.column(1)):
                h = hashes(text, words)
                once = np.unique(h) if content or distinct else h
                prints.append(majorities(once if distinct else h, lanes))
                if content:
                    digests.append(xxhash.xxh3_128_digest(once.astype("<u8").tobytes()))
                    sizes.append(len(once))
                    sketches.append(parities(once))
            columns = [pa.array([p[i] for p in prints], pa.int64()) for i in range(lanes)]
            if content:
                columns += [pa.array(digests, pa.binary()), pa.array(sizes, pa.int64())]
                columns += [pa.array([p[i] for p in sketches], pa.int64()) for i in range(PARITIES)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", *names, *more])

    schema = ", ".join(["doc_id long", *[f"{n} long" for n in names], *[f"{n} {'binary' if n == 'content' else 'long'}" for n in more]])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _byte(position: int, of: str = "") -> Column:
    lane, inside = divmod(position, 8)
    return F.shiftrightunsigned(F.col(f"{of}lane{lane}"), 8 * inside).bitwiseAND(255)


def _key(index: int, positions: tuple[int, ...]) -> Column:
    key = F.lit(index).cast("long")
    for p in positions:
        key = key * 256 + _byte(p)
    return key


def _first_posting(plan: Plan, lane: int) -> Column:
    """By the mask of a lane's shared bytes: the first posting of that lane inside the mask, or null."""
    own = [(i, {p - 8 * lane for p in c}) for i, c in enumerate(plan.postings) if c[0] // 8 == lane]
    first = []
    for mask in range(256):
        shared = {b for b in range(8) if mask >> b & 1}
        first.append(next((i for i, c in own if c <= shared), None))
    return F.array(*[F.lit(x).cast("int") for x in first])


def _postings(classes: DataFrame, plan: Plan, group: tuple[int, ...] | None = None) -> DataFrame:
    """A row per class and posting, of one group of positions if it is given."""
    own = [(i, c) for i, c in enumerate(plan.postings) if group is None or set(c) <= set(group)]
    keys = F.array(*[F.struct(F.lit(i).alias("posting"), _key(i, c).alias("key")) for i, c in own])
    return classes.select(*classes.columns, F.inline(keys))


def _sides(listed: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """The same rows as left and right side of pairs: ``node`` is a or b, other columns are prefixed."""
    return tuple(
        listed.select(F.col("node").alias(node), *[F.col(c).alias(f"{side}_{c}") for c in columns])
        for node, side in (("a", "l"), ("b", "r"))
    )


def _can_be_alike(least: float) -> Column:
    """Of the two sides of a pair: whether sizes and parities leave room for a Jaccard similarity of ``least``.

    Never false of a pair that has it: sizes are then within ``least`` of each other, and of both sets
    together at most (1 - least) / (1 + least) stand in one alone.
    """
    n, m = F.col("l_shingle_count"), F.col("r_shingle_count")
    differing = sum((F.bit_count(F.col(f"l_{c}").bitwiseXOR(F.col(f"r_{c}"))) for c in PARITY_COLUMNS), F.lit(0))
    return (F.least(n, m) + 1e-6 >= F.greatest(n, m) * least) & (differing <= (n + m) * ((1 - least) / (1 + least)) + 1e-6)


def _compared(plan: Plan, least: float | None = None) -> tuple[Column, Column]:
    """Of the two sides of a pair: whether tally and differing bits suffice, and the first shared posting.

    With ``least`` the sets of shingles must be able to have that similarity too.
    """
    tally, bits, first = F.lit(0), F.lit(0), []
    for i in range(plan.lanes):
        differing = F.col(f"l_lane{i}").bitwiseXOR(F.col(f"r_lane{i}"))
        mask = F.lit(0)
        for b in range(8):
            same = F.shiftrightunsigned(differing, 8 * b).bitwiseAND(255) == 0
            mask = mask + F.when(same, 1 << b).otherwise(0)
        tally, bits = tally + F.bit_count(mask), bits + F.bit_count(differing)
        first.append(F.element_at(_first_posting(plan, i), mask + 1))
    close = (bits <= plan.max_bits) & (tally >= plan.min_shared)
    return close if least is None else close & _can_be_alike(least), F.coalesce(*first)


def _close(plan: Plan, least: float | None = None) -> Column:
    """Of the two sides of a pair: whether ``_compared`` holds and has a first shared posting, in few steps.

    What rules out most comes first, and bytes are not taken one by one: lists of many nodes spend their time here, and
    the code of a condition that is too long is never compiled.
    """
    differing = [F.col(f"l_lane{i}").bitwiseXOR(F.col(f"r_lane{i}")) for i in range(plan.lanes)]
    close = sum(map(F.bit_count, differing), F.lit(0)) <= plan.max_bits
    if least is not None:
        close = close & _can_be_alike(least)
    folded = []  # the lowest bit of a byte tells whether any of it differs
    for x in differing:
        for by in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, by))
        folded.append(x)
    unlike = [F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101))) for x in folded]
    meets = [
        F.bit_count(folded[g[0] // 8].bitwiseAND(F.lit(_long(sum(1 << 8 * (p % 8) for p in g))))) <= len(g) - plan.posting_bytes
        for g in plan.groups
    ]
    return close & (sum(unlike, F.lit(0)) <= 8 * plan.lanes - plan.min_shared) & reduce(Column.__or__, meets)


def _long(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def crowd_links(classes: DataFrame, plan: Plan, crowd: int = CROWD, least: float | None = None) -> DataFrame:
    """Those pairs of ``candidate_links`` that join members of a long list to one of its heads.

    A list of ``crowd`` or more fingerprints has two heads, the first by node and by a hash of the
    node.  There are at most two pairs per row of the index, however long a list is, and a large
    group of fingerprints that are close to each other is all but joined by them.
    """
    compared = [c for c in classes.columns if c != "node"]
    listed = _postings(classes, plan).select("key", "node")
    heads = F.array_distinct(F.array(F.min("node"), F.min_by("node", F.xxhash64("node"))))
    long_lists = listed.groupBy("key").agg(F.count("*").alias("n"), heads.alias("heads")).where(F.col("n") >= crowd)
    pairs = (
        listed.join(long_lists.select("key", F.explode("heads").alias("head")), "key").where("node <> head")
        .select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()
    )
    left, right = _sides(classes, *compared)
    return pairs.join(left, "a").join(right, "b").where(_compared(plan, least)[0]).select("a", "b")


def candidate_links(
    classes: DataFrame, plan: Plan, crowd: int = CROWD, rare=None, least: float | None = None
) -> DataFrame:
    """Pairs (a, b) of nodes of different roots whose fingerprints differ in at most ``max_bits`` bits, each pair once.

    ``classes`` has one row per class: ``node``, its lanes and ``root`` (left out:
    each is its own).  Roots, tally and verification stand in the join condition, so no other
    pair leaves the join; AQE splits the list of a posting that many fingerprints share.

    With ``least`` pairs whose sizes and parities rule out that similarity do not leave the join either.

    With ``rare`` (nodes -> rows of node, shingle and ``ahead``, the shingles from there on) the members of lists of
    ``crowd`` or more meet at their rare shingles instead, under the same conditions: pairs without a common one are left
    out, so it must give a shingle in common to every pair that the verification would bear out.  A node carries the first of
    its shingles that others hold too; a pair leaves the join at its first common shingle if both carry that, and only if
    as many as it needs can follow.  Groups of postings, and as many parts of the shingles, are joined one after another
    and their pairs written, so that the shuffles of one of them take disk at a time.
    """
    if "root" not in classes.columns:
        classes = classes.withColumn("root", F.col("node"))
    close, first = _compared(plan, least)
    apart = (F.col("a") < F.col("b")) & (F.col("l_root") != F.col("r_root")) & close
    met = (F.col("l_key") == F.col("r_key")) & apart
    if rare is None:
        listed = _postings(classes, plan)
        left, right = _sides(listed, *[c for c in listed.columns if c != "node"])
        return left.join(right.drop("r_posting"), met & (first == F.col("l_posting"))).select("a", "b")
    # One group of postings at a time: written pairs free the shuffles that found them.
    found, members = [], []
    for group in plan.groups:
        listed = _postings(classes, plan, group)
        crowded = listed.groupBy("key").agg(
            F.count("*").alias("n"), (F.min("root") != F.max("root")).alias("mixed")
        ).where(F.col("n") >= crowd)
        crowded = stored(crowded.select("key", "mixed"), "crowded")
        inside = listed.select("node", "key").join(crowded.where("mixed"), "key", "left_semi")
        members.append(stored(inside.select("node").distinct(), "members"))
        # The first shared posting may be that of a crowded list: any short one will do, and pairs are made distinct.
        left, right = _sides(listed.join(crowded, "key", "left_anti"), *[c for c in listed.columns if c not in ("node", "posting")])
        found.append(stored(left.join(right, met).select("a", "b").distinct(), "short"))
    nodes = stored(_union(members).distinct(), "members")
    return _union([*found, rare_links(classes, plan, shared_shingles(rare(nodes)), least)]).distinct()


def shared_shingles(placed: DataFrame) -> DataFrame:
    """(node, shingle, ahead, carried), a written table: the rows of ``placed`` whose shingle other nodes have too.

    ``carried`` are the first of them of a node, ``CARRIED`` at most.
    """
    def carried() -> DataFrame:
        all_ = stored(placed.select("node", "shingle", "ahead"), "rare")
        # Nearly all shingles are rare enough to be one node's alone: they meet nothing and go no further.
        shared = all_.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").select("shingle")
        shared = stored(all_.join(stored(shared, "shared"), "shingle", "left_semi"), "shared")
        in_order = F.sort_array(F.collect_list(F.struct("ahead", "shingle")), asc=False)["shingle"]
        first = shared.groupBy("node").agg(F.slice(in_order, 1, CARRIED).alias("carried"))
        return shared.join(first, "node")

    return finished(carried, "carried")


def rare_crowd_links(classes: DataFrame, plan: Plan, shared: DataFrame, crowd: int = CROWD, least: float | None = None) -> DataFrame:
    """Those pairs of ``rare_links`` that join holders of a shingle of many nodes to one of its heads.

    As in ``crowd_links``, with the lists of carried shingles (``shared_shingles``) in place of postings.  Of ``crowd`` or more
    nodes that carry a shingle two are heads, the first and one by a hash of node and shingle: at most ``2 * CARRIED`` pairs for a
    node.  How long a list is follows from how alike the texts are, not from the size of the table.
    """
    compared = [c for c in classes.columns if c != "node"]
    listed = shared.where(F.array_contains("carried", F.col("shingle"))).select("shingle", "node")
    heads = F.array_distinct(F.array(F.min("node"), F.min_by("node", F.xxhash64("node", "shingle"))))
    long_lists = listed.groupBy("shingle").agg(F.count("*").alias("n"), heads.alias("heads")).where(F.col("n") >= crowd)
    pairs = (
        listed.join(long_lists.select("shingle", F.explode("heads").alias("head")), "shingle").where("node <> head")
        .select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()
    )
    left, right = _sides(classes, *compared)
    return pairs.join(left, "a").join(right, "b").where(_close(plan, least)).select("a", "b")


def rare_links(classes: DataFrame, plan: Plan, shared: DataFrame, least: float | None = None) -> DataFrame:
    """The pairs of ``candidate_links`` that have a shingle of ``shared`` (``shared_shingles``) in common, each once.

    A pair leaves the join at its first common shingle if both nodes carry that, and only if as many as it needs can
    follow.  Parts of the shingles, as many as ``plan`` has groups, are joined one after another and their pairs written.
    """
    kept = [c for c in classes.columns if c != "node"]
    met = (F.col("l_shingle") == F.col("r_shingle")) & (F.col("a") < F.col("b")) & (F.col("l_root") != F.col("r_root"))
    if least is not None:
        needed = (F.col("l_shingle_count") + F.col("r_shingle_count")) * (least / (1 + least)) - 1e-6
        met = met & (F.least("l_ahead", "r_ahead") >= needed)
    # The arrays stand here once: of what stands twice Spark takes the value beforehand, for every pair.
    meeting = F.get(F.array_intersect("l_carried", "r_carried"), F.lit(0))
    here = F.coalesce(meeting, "l_shingle") == F.col("l_shingle")
    found = []
    for part in range(len(plan.groups)):
        own = shared.where(F.pmod(F.xxhash64("shingle"), F.lit(len(plan.groups))) == part)
        left, right = _sides(own.join(classes, "node"), "shingle", "ahead", "carried", *kept)
        long = left.join(right, met & _close(plan, least) & here)
        found.append(stored(long.select("a", "b").distinct(), "long"))
    return _union(found).distinct()


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def near_duplicates(docs: DataFrame, plan: Plan = NARROW, verify=None, crowd: int = CROWD, rare=None) -> DataFrame:
    """Fingerprint lanes and ``component_id`` of every row of ``docs`` (doc_id, text).

    Equal fingerprints are one class, whose node is its smallest doc_id: copies never
    become pairs.  With ``verify`` equal fingerprints prove nothing: a class has one set of distinct
    shingles too, so what is found of its node holds for every member, and texts that differ
    in it are nodes of their own.  Large groups of close fingerprints do not either: lists of ``crowd`` and more
    are linked to their heads first, and then only pairs that these links leave apart are looked
    for, which gives the components of all links.  ``verify(docs, links)`` may drop links that a
    closer look does not bear out.  ``rare(docs, nodes)``, of shingles one of which any two texts that it would bear out
    share, then takes the place of the postings for all nodes: how many rows that makes follows from the texts, while
    postings fill up with the table, and the fingerprints are compared where shingles meet (``rare_crowd_links``,
    ``rare_links``).  A null text counts as empty, texts without words share
    fingerprint zero and are linked like any other; repeated rows share their component; rows with
    a null doc_id are returned, with the component of their class if that has any doc_id.
    Other columns of ``docs`` are ignored; an empty table gives an empty result.
    """
    lanes = [f"lane{i}" for i in range(plan.lanes)]

    def borne_out(links: DataFrame) -> DataFrame:
        return verify(docs, stored(links, "pairs")) if verify else links

    alike = [*lanes, "content"] if verify else lanes
    facts = ["shingle_count", *PARITY_COLUMNS] if verify else []
    least = getattr(verify, "least", None)
    prints = stored(fingerprints(docs, plan, verify is not None), "prints")
    same = [F.first(c).alias(c) for c in facts]  # alike in all rows of a class
    classes = stored(prints.groupBy(*alike).agg(F.min("doc_id").alias("node"), *same), "classes")
    named = classes.where("node is not null").select("node", *lanes, *facts)
    if rare:
        shared = shared_shingles(rare(docs, named.select("node")))
        crowds = components(borne_out(rare_crowd_links(named, plan, shared, crowd, least)))
    else:
        crowds = components(borne_out(crowd_links(named, plan, crowd, least)))
    grouped = stored(
        named.join(crowds, "node", "left").select("node", F.coalesce("root", "node").alias("root"), *lanes, *facts), "crowds"
    )
    links = borne_out(rare_links(grouped, plan, shared, least) if rare else candidate_links(grouped, plan, crowd, least=least))
    roots = components(links.union(crowds.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    rooted = classes.join(roots, "node", "left").select(
        *alike, F.coalesce("root", "node").alias("component_id")
    )
    return prints.join(rooted, alike, "left").select("doc_id", *lanes, "component_id")


def shingle_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, shingles): the distinct shingles of the texts of some nodes, as hashes; only those texts are read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [np.unique(hashes(t, words)).view(np.int64) for t in utf8(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes, "node", "left_semi")
    sets = stored(chosen.mapInArrow(run, "node long, shingles array<long>"), "shingles")
    return stored(sets.dropDuplicates(["node"]), "shingles") if _repeats(sets) else sets


def _repeats(rows: DataFrame) -> bool:
    """Whether a node stands in several rows: only then they have to be dealt once more."""
    return rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0


def verified_by_shingles(words: int, least: float):
    """A verification for ``near_duplicates``: keep links whose texts have a Jaccard similarity of ``least``."""
    def verify(docs: DataFrame, links: DataFrame) -> DataFrame:
        taking_part = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
        sets = shingle_sets(docs, taking_part, words)
        both = links.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
        common = F.size(F.array_intersect("x", "y"))
        return both.where(common >= least * (F.size("x") + F.size("y") - common)).select("a", "b")

    verify.least = least  # lets pairs that cannot have it be left out beforehand
    return verify


def cell_counts(docs: DataFrame, words: int) -> np.ndarray:
    """How many distinct shingles of the rows of ``docs`` fall into each cell, by their lowest bits.

    A task counts what it reads and sends on its cells in ``BLOCKS`` lists, however many shingles it has met.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, dtype=np.int64)
        for part in slices(batches):
            once = np.concatenate([np.unique(hashes(t, words)) for t in utf8(part.column(0))])
            counts += np.bincount((once & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(BLOCKS), pa.int32()), pa.array(list(counts.reshape(BLOCKS, -1)), pa.list_(pa.int64()))], names=["block", "counts"]
        )

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS // BLOCKS, dtype=np.int64)
        for batch in batches:
            total += batch.column("counts").flatten().to_numpy().reshape(batch.num_rows, -1).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total], pa.list_(pa.int64()))], names=["block", "counts"])

    schema = "block int, counts array<long>"
    each = docs.select("text").mapInArrow(run, schema)
    found = each.groupBy("block").applyInArrow(add, schema).toArrow().combine_chunks()
    spread = np.zeros((BLOCKS, CELLS // BLOCKS), dtype=np.uint32)
    if found.num_rows:
        counts = found.column("counts").combine_chunks().flatten().to_numpy().reshape(found.num_rows, -1)
        spread[found.column("block").to_numpy()] = np.minimum(counts, 2**32 - 1)
    return spread.reshape(-1)


def rare_shingles(words: int, least: float):
    """The rarest shingles of texts, one of which any two texts with a Jaccard similarity of ``least`` share.

    Of n distinct shingles two such texts have at least ``least`` n in common, so in one order
    of all shingles (here by how often those of their cell occur in the rows) their first n - ceil(least n) + 1 meet.
    """
    def rare(docs: DataFrame, nodes: DataFrame) -> DataFrame:
        spread = cell_counts(docs, words)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                firsts, carried, sizes = [], [], []
                for text in utf8(part.column(1)):
                    own = np.unique(hashes(text, words)).view(np.int64)
                    n, often = len(own), spread[own & (CELLS - 1)]
                    order = np.lexsort((own, often))[: n - int(np.ceil(n * least - 1e-6)) + 1]
                    firsts.append(own[order])
                    carried.append(own[order[often[order] > 1]][:CARRIED])  # the others meet nothing
                    sizes.append(n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(firsts, pa.list_(pa.int64())), pa.array(carried, pa.list_(pa.int64()))],
                    names=["node", "n", "first", "carried"],
                )

        # Nodes are nearly all rows: what is left of the texts is shuffled to be held against them, not the texts.
        named = docs.select(F.col("doc_id").cast("long").alias("node"), "text").where("node is not null")
        chosen = named.mapInArrow(run, "node long, n long, first array<long>, carried array<long>")
        chosen = chosen.join(nodes, "node", "left_semi")
        if _repeats(named):
            chosen = chosen.dropDuplicates(["node"])
        return chosen.select("node", "n", "carried", F.posexplode("first").alias("place", "shingle")).select(
            "node", "shingle", (F.col("n") - F.col("place")).alias("ahead"), "carried"
        )

    return rare
