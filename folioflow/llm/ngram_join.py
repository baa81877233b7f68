"""N-gram Jaccard self-join by grouped prefixes.

Two documents link when 100 * |A & B| >= percent * |A | B| for their shingle sets; the
result is each document's set size and the least document id it can reach by links.

1. Equal sets are one class (least doc_id stands for it).
2. A global order of shingles, rare ones first: by the logarithm of the count in a hashed
   sketch of the whole corpus (a fixed number of counters), then by hash.  Two linked sets
   share one of their first n - ceil(n * percent / 100) + 1 shingles, their prefixes.
3. Classes of equal size and prefix collapse into one group.
4. Groups that meet in a prefix shingle with a partner of fitting size go on; their pairs
   are filtered by size, position and signature.  A signature is the parity of the set's
   hashes in each of so many bins: two sets differ in at least as many elements as their
   signatures in bits, so no link is lost, whatever the order of shingles is worth.
   Only enough of the pairs that pass are kept to connect what they connect, at most one
   less than the shingle has groups, so the table of pairs grows with the prefixes.
5. The groups' members are expanded, per component of these pairs.  A component is cut
   into blocks of bounded size, each set being in one of them; the pairs in a block, and
   those with the component's first member, which is in every block, are verified exactly
   on the sets as long as they are not connected.  Members of large components that then
   are not connected to the first one are sent to all its blocks and verified there.
6. Components of the verified links give the result.

No pair is lost: a link's two sets meet in a common prefix shingle, pass the filters, and
so lie in one component of step 4; step 5 verifies or connects every pair of a component.

Defined cases: a null, empty or blank text has an empty set and links with nothing;
fewer words than the width make one shingle of the whole sequence; repeated rows are
linked copies; a doc_id names one document (rows of one doc_id that differ in text are
judged apart, and their classes are one if it is the least id of both); a row
with a null doc_id is returned with the component of its equals, or null; an empty table
gives an empty result; other columns are not carried.  Shingles are compared as 64-bit
hashes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from ._arrow import map_frames
from ._common import WORD, salted_join, table, written
from ._graph import components
from ._shingles import shingle_sets
from ._vectors import sorted_runs

WIDTH = 3
PERCENT = 90
#: Counters of the sketch, as a power of two, and how many of them travel in a row.
SKETCH_BITS = 22
SKETCH_ROW = 4096
#: Steps by which the logarithm of a count is ordered: eight to each doubling.
STEPS = 8
#: Shingles and sets in a block of a component; a cell holds a block and as many sets again at most.
BLOCK_SHINGLES = 1_000_000
BLOCK_SETS = 256
#: Bits of the map of documents that take part in a join, as a power of two.
MAP_BITS = 25
#: Runs turned into rows at a time.
BATCH = 1000


def shingle_order(docs: DataFrame, width: int = WIDTH) -> np.ndarray:
    """A step of the logarithm of the number of documents per hashed counter, over all documents; 2**SKETCH_BITS bytes."""
    slots, parts = 1 << SKETCH_BITS, (1 << SKETCH_BITS) // SKETCH_ROW

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(slots, np.uint32)
        held: list[np.ndarray] = []
        size = 0

        def taken() -> None:
            if held:
                at = (np.concatenate(held) & np.uint64(slots - 1)).astype(np.int64)
                np.add.at(total, at, np.ones(len(at), np.uint32))
                held.clear()

        for b in batches:
            for s in shingle_sets(b["text"], width):
                held.append(s)
                size += len(s)
                if size > slots // 8:
                    taken()
                    size = 0
        taken()
        rows = total.reshape(parts, SKETCH_ROW)
        some = np.flatnonzero(rows.any(axis=1))
        if len(some):
            wide = np.uint8 if total.max() < 256 else np.uint32
            yield pd.DataFrame({"part": some, "wide": np.dtype(wide).itemsize, "counts": [zlib.compress(rows[i].astype(wide).tobytes(), 1) for i in some]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def ended() -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "steps": [np.minimum(np.log2(total + 1) * STEPS, 255).astype(np.uint8).tobytes()]})

        part = total = None
        for (k,), begins, rows in sorted_runs(batches, ["part"]):
            if begins:
                if part is not None:
                    yield ended()
                part, total = k, np.zeros(SKETCH_ROW, np.int64)
            for wide, c in zip(rows["wide"], rows["counts"]):
                total += np.frombuffer(zlib.decompress(c), np.uint8 if wide == 1 else np.uint32)
        if part is not None:
            yield ended()

    counted = map_frames(docs.select("text"), "text", count, StructType().add("part", "integer").add("wide", "integer").add("counts", "binary"))
    sums = counted.repartition("part").sortWithinPartitions("part").mapInPandas(add, "part int, steps binary")
    out = np.zeros((parts, SKETCH_ROW), np.uint8)
    for r in sums.collect():  # a fixed number of rows
        out[r["part"]] = np.frombuffer(r["steps"], np.uint8)
    return out.reshape(-1)


def prefix_size(n, percent: int = PERCENT):
    return n - (n * percent + 99) // 100 + 1


def digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def most_different(n: int, m: int, percent: int) -> int:
    """In how many elements two linked sets of these sizes can differ."""
    return (n + m) * (100 - percent) // (100 + percent)


def signature(s: np.ndarray, percent: int) -> bytes:
    """The parity of the number of shingles in each bin; so many bins that unrelated sets differ in about twice as
    many as linked ones may (a power of two, so that signatures of two lengths compare after folding the longer)."""
    bits = 1 << max(6, (4 * most_different(len(s), len(s), percent) - 1).bit_length())
    odd = np.bincount(((s >> np.uint64(24)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_link(n: int, a: bytes | None, m: int, b: bytes | None, percent: int) -> bool:
    """Whether the signatures leave it open that two sets of n and m shingles link."""
    if a is None or b is None:
        return True
    x, y, wide = int.from_bytes(a, "little"), int.from_bytes(b, "little"), max(len(a), len(b)) * 8
    if len(a) < len(b):
        x, y = y, x
    while wide > min(len(a), len(b)) * 8:
        wide //= 2
        x = (x >> wide) ^ (x & ((1 << wide) - 1))
    return (x ^ y).bit_count() <= most_different(n, m, percent)


def set_table(docs: DataFrame, steps: np.ndarray, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n, set_key, prefix_key (digests of set and prefix), the prefix in the global order, and the signature."""
    shared = docs.sparkSession.sparkContext.broadcast(steps)  # of fixed size

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order, mask = shared.value, np.uint64((1 << SKETCH_BITS) - 1)
        for b in batches:
            n, keys, prefix_keys, prefixes, signatures = [], [], [], [], []
            for s in shingle_sets(b["text"], width):
                n.append(len(s))
                head = s[:0]
                if len(s):
                    # s is sorted, so equal steps stay in the order of the hashes
                    head = s[np.argsort(order[(s & mask).astype(np.int64)], kind="stable")[: prefix_size(len(s), percent)]]
                keys.append(digest(s))
                prefix_keys.append(digest(head))
                prefixes.append(head.view(np.int64))
                signatures.append(signature(s, percent))
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "n": n, "set_key": keys, "prefix_key": prefix_keys, "prefix": prefixes, "signature": signatures})

    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    schema = StructType().add("doc_id", "string").add("n", "long").add("set_key", "binary").add("prefix_key", "binary").add("prefix", ArrayType(LongType())).add("signature", "binary")
    return map_frames(named, "text", rows, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def connecting_pairs(ids: list[int], n: np.ndarray, pos: np.ndarray, signatures: list[bytes | None], percent: int) -> list[tuple[int, int]]:
    """Of the groups that share one prefix shingle, sorted by size: pairs that pass the filters, as few as connect
    all that such pairs connect."""
    left = n - pos
    label = np.arange(len(ids))
    found = []
    for i in range(len(ids) - 1):
        end = np.searchsorted(n, n[i] * 100 // percent, side="right")
        if end <= i + 1 or (label[i + 1 : end] == label[i]).all():
            continue
        need = -(-(percent * (n[i] + n[i + 1 : end])) // (100 + percent))
        near = np.flatnonzero((np.minimum(left[i], left[i + 1 : end]) >= need) & (label[i + 1 : end] != label[i])) + i + 1
        for j in near:
            if label[j] != label[i] and may_link(int(n[i]), signatures[i], int(n[j]), signatures[j], percent):
                found.append((ids[i], ids[j]))
                label[label == label[j]] = label[i]
        if (label == label[0]).all():
            break
    return found


def meeting(postings: DataFrame, percent: int) -> DataFrame:
    """The postings (token, gid, n, pos) that have a posting of the same shingle and of fitting size."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, open_end = None, False  # the last row waits for its follower
        for b in batches:
            if not len(b):
                continue
            b = b if held is None else pd.concat([held, b])
            token, n = b["token"].to_numpy(), b["n"].to_numpy()
            follows = (token[1:] == token[:-1]) & (100 * n[:-1] >= percent * n[1:])
            keep = np.r_[follows, False] | np.r_[open_end, follows]
            open_end = bool(follows[-1]) if len(follows) else open_end
            held = b.iloc[-1:]
            yield b.iloc[:-1][keep[:-1]]
        if held is not None and open_end:
            yield held

    schema = "token long, gid long, n long, pos int"
    return postings.repartition("token").sortWithinPartitions("token", "n").mapInPandas(rows, schema)


def group_pairs(groups: DataFrame, signatures: DataFrame, percent: int = PERCENT) -> DataFrame:
    """groups (gid, n, prefix) and signatures (gid, signature) to (a, b): filtered pairs of groups, enough to connect
    all candidates.  The postings of a shingle are one run, of which a task holds a few numbers for each group."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def runs(parts: list[pd.DataFrame], starts: np.ndarray) -> Iterator[tuple[int, int]]:
            """Pairs of the runs that begin at the starts but the last, which is the end."""
            b = pd.concat(parts) if len(parts) > 1 else parts[0]
            gid, n, pos, signed = b["gid"].tolist(), b["n"].to_numpy(), b["pos"].to_numpy(), b["signature"].tolist()
            left, two = n - pos, starts[:-1][np.diff(starts) == 2]
            need = -(-(percent * (n[two] + n[two + 1])) // (100 + percent))
            for i in two[np.minimum(left[two], left[two + 1]) >= need].tolist():
                if may_link(int(n[i]), signed[i], int(n[i + 1]), signed[i + 1], percent):
                    yield gid[i], gid[i + 1]
            for i in np.flatnonzero(np.diff(starts) > 2):
                at, to = starts[i], starts[i + 1]
                yield from connecting_pairs(gid[at:to], n[at:to], pos[at:to], signed[at:to], percent)

        tail: list[pd.DataFrame] = []  # the last shingle's rows so far: a batch may end within them
        for b in batches:
            if not len(b):
                continue
            token = b["token"].to_numpy()
            if tail and tail[0]["token"].iat[0] == token[0] == token[-1]:
                tail.append(b)
                continue
            held = sum(map(len, tail))
            token = np.concatenate([t["token"].to_numpy() for t in [*tail, b]])
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            found = set(runs([*tail, b], starts))
            tail = [b.iloc[max(0, starts[-1] - held) :]]
            if found:
                yield pd.DataFrame(list(found), columns=["a", "b"])
        if tail and (found := set(runs(tail, np.array([0, sum(map(len, tail))])))):
            yield pd.DataFrame(list(found), columns=["a", "b"])

    met = meeting(groups.select("gid", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "gid", "n", "pos"), percent)
    signed = met.join(signatures, "gid", "left").select("token", "gid", "n", "pos", "signature")
    return signed.repartition("token").sortWithinPartitions("token", "n").mapInPandas(rows, "a long, b long").distinct()


def linking_pairs(reps: np.ndarray, sets: list[np.ndarray], percent: int, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Verified links among the sets, as few as connect all that links connect; sets of one label are connected already."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    reps, sets, sizes = reps[order], [sets[i] for i in order], sizes[order]
    label, found = np.arange(len(sets)) if labels is None else np.unique(labels, return_inverse=True)[1][order], []
    if len(sets) > 8:
        values, codes = np.unique(np.concatenate(sets), return_inverse=True)
        at = np.r_[0, np.cumsum(sizes)]
        present = np.zeros(len(values), np.int64)
    for i in range(len(sets) - 1):
        end = np.searchsorted(sizes, sizes[i] * 100 // percent, side="right")
        near = np.flatnonzero(label[i + 1 : end] != label[i]) + i + 1
        if not len(near):
            continue
        if len(sets) > 8:
            own = codes[at[i] : at[i + 1]]
            present[own] = 1
            lo, hi = near[0], near[-1] + 1
            common = np.add.reduceat(present[codes[at[lo] : at[hi]]], at[lo:hi] - at[lo])[near - lo]
            present[own] = 0
        else:
            common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in near])
        for j in near[100 * common >= percent * (sizes[i] + sizes[near] - common)]:
            if label[j] != label[i]:
                found.append((reps[i], reps[j]))
                label[label == label[j]] = label[i]
    return found


def parted_by_ids(docs: DataFrame, ids: DataFrame, column: str = "rep") -> tuple[DataFrame, DataFrame]:
    """docs in two: the rows whose column is among the ids, with few others, and rows whose column surely is not.

    A map of hashed ids, of fixed size, goes to the tasks, so that texts of rows that need no join are not shuffled."""
    slot = F.pmod(F.xxhash64(column), F.lit(1 << MAP_BITS))
    bits = ids.select(F.bitmap_bucket_number(slot).alias("__part"), F.bitmap_bit_position(slot).alias("__bit"))
    # in pieces of 64 bytes: a row that is looked up copies its piece
    bits = bits.groupBy("__part").agg(F.bitmap_construct_agg("__bit").alias("__bits")).withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(63))))
    bits = bits.select((F.col("__part") * 64 + F.col("__i")).alias("__key"), F.substring("__bits", F.col("__i") * 64 + 1, F.lit(64)).alias("__piece"))
    bits = written(bits, "map")
    at = F.bitmap_bit_position(slot)
    seen = docs.withColumn("__key", F.bitmap_bucket_number(slot) * 64 + F.floor(at / 512)).withColumn("__bit", at % 512)
    byte = F.conv(F.hex(F.substring("__piece", (F.floor(F.col("__bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    inside = F.coalesce(F.bit_get(byte, (F.col("__bit") % 8).cast("int")), F.lit(0))
    seen = seen.join(F.broadcast(bits), "__key", "left").withColumn("__in", inside)
    return tuple(seen.where(F.col("__in") == k).drop("__key", "__bit", "__piece", "__in") for k in (1, 0))


def cell_links(cells: DataFrame, percent: int) -> DataFrame:
    """cells (cid, i, j, rep, label, shingles) to (a, b): links of each cell, enough to connect what its links and its
    labels connect."""

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def ended() -> pd.DataFrame:
            once = {(r, k, s) for p in parts for r, k, s in zip(p["rep"], p["label"], map(bytes, p["shingles"]))}
            reps, labels, raw = zip(*sorted(once))
            found = linking_pairs(np.array(reps), [np.frombuffer(s, np.uint64) for s in raw], percent, np.array(labels))
            return pd.DataFrame(found, columns=["a", "b"])

        parts: list[pd.DataFrame] = []
        out: list[pd.DataFrame] = []
        for _, begins, rows in sorted_runs(batches, ["cid", "i", "j"]):
            if begins and parts:
                out.append(ended())
                parts = []
                if len(out) >= BATCH:
                    yield pd.concat(out)
                    out = []
            parts.append(rows)
        if parts:
            out.append(ended())
        if out:
            yield pd.concat(out)

    dealt = cells.select("cid", "i", "j", "rep", "label", "shingles").repartition("cid", "i", "j").sortWithinPartitions("cid", "i", "j")
    return dealt.mapInPandas(links, "a long, b long").distinct()


def verified_links(docs: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """members (rep, set_key, n, cid): links among the members of each component, enough to connect them."""
    totals = members.groupBy("cid").agg(F.sum("n").alias("total"), F.count("*").alias("sets"), F.min("rep").alias("first"))
    members = salted_join(members, totals, ["cid"], F.col("rep"), "inner").where("sets > 1")
    members = members.withColumn("blocks", F.ceil(F.greatest(F.col("total") / BLOCK_SHINGLES, F.col("sets") / BLOCK_SETS)).cast("int"))
    members = written(members.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")), "placed")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = list(shingle_sets(b["text"], width))
            same = np.array([digest(s) == bytes(k) for s, k in zip(found, b["set_key"])], bool)  # doc ids may repeat
            out = b.loc[same, ["cid", "blocks", "block", "first", "rep"]]
            yield out.assign(shingles=[s.tobytes() for s, ok in zip(found, same) if ok])

    texts = parted_by_ids(docs.select(F.col("doc_id").alias("rep"), "text"), members)[0].join(members, "rep")
    texts = texts.select("rep", "text", "set_key", "cid", "blocks", "block", "first")
    schema = StructType().add("cid", "long").add("blocks", "integer").add("block", "integer").add("first", "long").add("rep", "long").add("shingles", "binary")
    held = written(map_frames(texts, "text", sets, schema), "members")

    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = held.withColumn("label", F.col("rep")).withColumn("i", F.col("block")).withColumn("j", F.lit(0))
    firsts = own.where("rep = first").withColumn("i", every("blocks"))
    links = written(cell_links(own.unionByName(firsts), percent), "links")

    large = held.where("blocks > 1")
    if large.isEmpty():
        return links
    labels = components(links)
    at = large.select("cid", "rep", "first").distinct().join(labels, F.col("rep") == F.col("node"), "left")
    at = at.select("cid", "rep", "first", F.coalesce("component", "rep").alias("label"))
    main = at.where("rep = first").select("cid", F.col("label").alias("main"))
    at = salted_join(at, main, ["cid"], F.col("rep"), "inner")
    rest = at.where("label <> main").groupBy("cid").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("parts"))
    at = written(salted_join(at, rest, ["cid"], F.col("rep"), "inner").select("cid", "rep", "label", "main", "parts"), "apart")
    again = large.join(at, ["cid", "rep"])
    asked = again.where("label <> main").withColumn("j", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")).cast("int")).withColumn("i", every("blocks"))
    others = again.withColumn("i", F.col("block")).withColumn("j", every("parts"))
    columns = ("cid", "i", "j", "rep", "label", "shingles")
    return links.unionByName(cell_links(asked.select(*columns).unionByName(others.select(*columns)), percent))


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs (doc_id, text) to one row per row: doc_id, n_shingles, component_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = written(set_table(docs, shingle_order(docs, width), width, percent), "sets")
    key = ["n", "set_key"]
    known = sets.where("n > 0 AND doc_id IS NOT NULL")
    cls = sets.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("prefix_key").alias("prefix_key"))
    cls = cls.where("rep IS NOT NULL")
    groups = cls.groupBy("n", "prefix_key").agg(F.min("rep").alias("gid"), F.count("*").alias("members"), F.sum("copies").alias("rows"))
    groups = written(groups, "groups")
    # a group of one row has its prefix there; of the others the first row is looked up
    large = groups.where("rows > 1").select(F.col("n").alias("gn"), F.col("prefix_key").alias("gp"), "gid")
    shared = known.select("n", "prefix_key", "doc_id").join(large, (F.col("n") == F.col("gn")) & (F.col("prefix_key") == F.col("gp")), "left_semi")
    some, own = parted_by_ids(known.select("n", "doc_id", "prefix_key", "prefix"), shared, "doc_id")
    groups_of = groups.select("gid", F.col("n").alias("gn"), F.col("prefix_key").alias("gp"))
    same = (F.col("doc_id") == F.col("gid")) & (F.col("n") == F.col("gn")) & (F.col("prefix_key") == F.col("gp"))
    some = some.join(groups_of, same).dropDuplicates(["gid", "n", "prefix_key"]).select("gid", "n", "prefix")
    prefixes = own.select(F.col("doc_id").alias("gid"), "n", "prefix").unionByName(some)
    # one signature speaks for a group of one set, and for an id that names one set
    signatures = known.groupBy(F.col("doc_id").alias("gid")).agg(F.min("set_key").alias("a"), F.max("set_key").alias("b"), F.first("signature").alias("signature"))
    several = groups.where("members > 1").select("gid").distinct()
    signatures = signatures.where("a = b").join(several, "gid", "left_anti").select("gid", "signature")
    near = components(group_pairs(prefixes, signatures, percent))
    alone = groups.where("members > 1").select(F.col("gid").alias("node"))
    near = near.unionByName(alone.join(near, "node", "left_anti").select("node", F.col("node").alias("component")))
    placed = groups.join(near, groups["gid"] == near["node"]).select("n", "prefix_key", F.col("component").alias("cid"))
    # the groups of one prefix hold few distinct sets, but may hold very many: deal them
    members = salted_join(cls, placed, ["n", "prefix_key"], F.col("rep"), "inner").select("rep", "set_key", "n", "cid")
    links = components(verified_links(docs, members, width, percent))
    named = cls.join(links, cls["rep"] == links["node"], "left").where("copies > 1 OR component IS NOT NULL")
    named = named.select(*key, F.coalesce("component", "rep").alias("component_id"))
    out = salted_join(sets.select("doc_id", *key), named, key, F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


_WORDS = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')"
OP8_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WIDTH} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {WIDTH} + 2), lambda i: array_to_string(w[i:i + {WIDTH} - 1], ' ')) END) AS s FROM w),
c AS (SELECT min(doc_id) AS rep, len(s) AS n, s FROM (SELECT doc_id, list_sort(s) AS s FROM s WHERE len(s) > 0) GROUP BY s),
e AS (SELECT rep, n, unnest(s) AS g FROM c),
p AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.rep <> b.rep
    AND 100 * a.n >= {PERCENT} * b.n AND 100 * b.n >= {PERCENT} * a.n GROUP BY a.rep, b.rep),
l AS (SELECT a, b FROM p WHERE 100 * k >= {PERCENT} * (na + nb - k)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT rep, least(rep, coalesce(min(r.b), rep)) AS component_id FROM c LEFT JOIN r ON r.a = rep GROUP BY rep)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id
FROM s d LEFT JOIN c ON list_sort(d.s) = c.s LEFT JOIN m USING (rep)
"""
