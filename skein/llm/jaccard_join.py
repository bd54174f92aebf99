"""Operator 8: Jaccard join of documents over sets of word shingles, by blocks and signature trees.

1. Each text becomes a set of shingle hashes, and of that only a small row stays: the set's size, two hashes of it, a
   bitmap of its tokens as wide as it is large, and keys of min-hash bands.  Rows with both hashes equal are one class.
2. Classes that share a band's key form a block.  BANDS bands of ROWS minima let a pair at the threshold slip through
   with chance (1 - 0.75**2)**34 < 1e-12, and less above it.
3. In each block a signature tree finds a forest of pairs that may link; it touches every class that has a possible
   partner.  Only for these classes are sets read.  Each class is verified against the partner that most blocks gave
   it, and the components of these links are formed.
4. Blocks within one component are done with.  In each other block the tree finds another forest, between components;
   its pairs are verified on the sets and components are formed again, as long as that finds links.  At last all pairs
   of different components that the bounds leave are verified, so that no link between them is left out.

Ids, keys and sizes are shuffled to form blocks; bitmaps go only to blocks of two classes or more, and of blocks with the
same members one is kept.  For forests a block larger than CHUNK members is cut at random into chunks, anew for each key,
so that no task gets a whole hot block and no row is copied; its members count as partnered.  Only at last, if it still
has several components, is it split by ranges of sizes that may link, and what is still larger into chunks that meet two
by two; members of its largest component do not meet each other again.  Copies and near-copies are never expanded into all pairs: once connected, they are one component.

Words: `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased.  A text of one to four words is one shingle; null and empty texts have
none and link with nothing.  Of rows that repeat a doc_id, each is reported with its own text's component.  A null
doc_id takes part and is never the smallest of a component that has another.  An empty table gives no rows.  Columns
beside doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted_broadcast, map_text, release, remove, scratch, small_batches, told_apart, without_ids, written
from .components import components
from .shingles import Bands, bitmap, shingle_sets, signature
from .signature_tree import candidates, spanning

PERCENT = 75
BANDS, ROWS = 34, 2
SALTS = 64
CHUNK = 1024
#: Rounds of forests at most, before all pairs that remain are verified; a round that leaves more than half of the blocks
#: with several components is the last.
FORESTS = 4
#: Tasks over which the classes of one component are named.
PARTS = 16
#: Classes whose bands a task remembers to have given already.
REMEMBERED = 200_000

_BANDS = Bands(BANDS, ROWS)
_SKETCH = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("node", pa.int64()), ("check", pa.int64()), ("bitmap", pa.binary()), ("bands", pa.list_(pa.int64()))])
_PAIR = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def sketches(docs: DataFrame, node_bits: int = 64) -> DataFrame:
    """doc_id, size, node and check (two hashes of the set) of every row.  The first row of a class that a task meets has
    its bitmap and bands, too; a hot group of copies gives one such row a task, not one a copy."""

    def make():
        seen: set[tuple[int, int]] = set()

        def sketch(ids: list, texts: list[str]) -> list:
            sets = shingle_sets(texts)
            signs, new = [], []
            for k, s in enumerate(sets):
                sign = signature(s) if len(s) else (None, None)
                if len(s) and node_bits < 64:
                    sign = sign[0] & (1 << node_bits) - 1, sign[1]
                signs.append(sign)
                if len(s) and sign not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(sign)
                    new.append(k)
            keys = dict(zip(new, _BANDS.keys([sets[k] for k in new]).view("i8"), strict=True)) if new else {}
            return [ids, [len(s) for s in sets], [s[0] for s in signs], [s[1] for s in signs], [bitmap(s) if k in keys else None for k, s in enumerate(sets)], [keys.get(k) for k in range(len(sets))]]

        return sketch

    return map_text(docs, make, "doc_id long, size long, node long, check long, bitmap binary, bands array<long>", _SKETCH, per_task=True)


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and its sorted hashes, for the wanted (doc_id, check, node); a document's text tells which of them is its own."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = counted_broadcast(wanted.select(F.col("doc_id").alias("_id")).distinct())
    chosen = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")

    def make():
        seen: set[tuple] = set()  # a row that repeats gives its set once a task

        def hashes(ids: list, texts: list[str]) -> list:
            out = []
            for i, s in zip(ids, shingle_sets(texts), strict=True):
                if len(s) and (own := (i, signature(s)[1])) not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(own)
                    out.append((*own, s.tobytes()))
            return [[r[k] for r in out] for k in range(3)]

        return hashes

    arrow = pa.schema([("doc_id", pa.int64()), ("check", pa.int64()), ("hashes", pa.binary())])
    read = map_text(chosen, make, "doc_id long, check long, hashes binary", arrow, per_task=True)
    own = counted_broadcast(wanted.select(F.col("doc_id").alias("_id"), F.col("check").alias("_check"), "node"))
    return read.join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("check") == F.col("_check"))).select("node", "hashes")


def verify(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (u, v) whose sets have 100 * common >= percent * union.  Both joins are skewed where one class has many
    partners; its set is one row, so that the partners' side can be split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs, found = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for u, v, x, y in zip(us, vs, batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), "u8"), np.frombuffer(y.as_buffer(), "u8")
                common = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * common >= percent * (len(a) + len(b) - common):
                    found.append((u, v))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=_PAIR)
        release()

    side = lambda name, data: sets.select(F.col("node").alias(name), F.col("hashes").alias(data))
    return pairs.select("u", "v").join(side("v", "b"), "v").join(side("u", "a"), "u").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _by_block(dealt: DataFrame, columns: list[str], pairs_of) -> DataFrame:
    """u, v: ``pairs_of`` the members of each block (key, part), which come as one list a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def joined() -> pa.RecordBatch:
            given = dict(zip(columns, map(list, zip(*held, strict=True)), strict=True))
            nodes, got = np.array(given["node"], "i8"), np.array(pairs_of(block[0], given), "i8").reshape(-1, 2)
            held.clear()
            u, v = nodes[got[:, 0]], nodes[got[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], schema=_PAIR)

        for batch in batches:
            for key, part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, part) != block:
                    if len(held) > 1:
                        yield joined()
                    held.clear()
                    block = key, part
                held.append(row)
        if len(held) > 1:
            yield joined()
        release()

    sorted_ = dealt.repartition("key", "part").sortWithinPartitions("key", "part", "node")
    return sorted_.select("key", "part", *columns).mapInArrow(run, "u long, v long")


def forest_pairs(members: DataFrame, percent: int) -> DataFrame:
    """members: key, part, node, size, bitmap, component.  u, v, n: pairs of a forest of each block, and how many blocks
    gave them."""

    def forest(key: int, m: dict) -> list:
        return spanning(m["bitmap"], np.array(m["size"], "i8"), np.array(m["component"], "i8"), percent)

    return _by_block(members, ["node", "size", "bitmap", "component"], forest).groupBy("u", "v").agg(F.count("*").alias("n"))


def all_pairs(members: DataFrame, percent: int) -> DataFrame:
    """members: those of ``_meetings`` with size, bitmap, component and keys (all that the node has).  u, v: all pairs that
    the bounds leave.  A pair is given by the smallest of the keys that its two have in common, and there once."""

    def once(key: int, m: dict) -> list:
        keys, home = [set(k) for k in m["keys"]], m["home"]
        found = candidates(m["bitmap"], np.array(m["size"], "i8"), np.array(m["component"], "i8"), percent)
        return [(i, j) for i, j in found if not (m["high"][i] and m["high"][j]) and (m["own"][i] != m["own"][j] or not m["across"][i]) and home[i] == min(keys[i] & keys[j])]

    return _by_block(members, ["node", "size", "bitmap", "component", "keys", "home", "high", "own", "across"], once)


def _once(entries: DataFrame) -> DataFrame:
    """entries: key, node, size, n.  Of keys with the same members only the smallest stays."""
    of = lambda k: F.sum(F.pmod(F.xxhash64("node", F.lit(k)), F.lit(1 << 31))).alias(f"h{k}")
    members = entries.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b"), of(1), of(2), of(3))
    kept = members.groupBy("n", "a", "b", "h1", "h2", "h3").agg(F.min("key").alias("key")).select("key")
    return entries.join(kept, "key", "left_semi")


def _chunks(entries: DataFrame, chunk: int) -> DataFrame:
    """key, part, node: each member of a block in one chunk of it, drawn by key and node."""
    chunks = F.ceil(F.col("n") / chunk)
    return entries.withColumn("part", F.pmod(F.xxhash64("node", "key"), chunks)).select("key", "part", "node")


def _meetings(entries: DataFrame, percent: int, chunk: int) -> DataFrame:
    """entries: key, node, size, n, component.  key, part, node such that each two members of different components that may
    link meet.

    Large blocks are split by size, where a range is as wide as a link allows and a block holds one range and the next.
    In what is still large, the members of the component that most belong to need not meet each other: they are cut into
    chunks, each of which meets the chunks of the others, and the others' chunks meet two by two.

    home: the key before it was split; high: the member's size is in the upper of the two ranges; own: its side (of the
    large component or not) or its chunk; across: whether only members of different ``own`` are paired here.  Two high
    members meet in another block too, two of a side or a chunk in another part."""
    level = F.floor(F.log(F.col("size").cast("double")) / math.log(100 / percent) + 1e-9).cast("int") if percent < 100 else F.col("size").cast("int")
    small = entries.filter(F.col("n") <= chunk).select("key", F.lit(0).cast("bigint").alias("part"), "node", F.col("key").alias("home"), F.lit(False).alias("high"), F.lit(0).alias("own"), F.lit(False).alias("across"))
    large = entries.filter(F.col("n") > chunk).withColumn("range", F.explode(F.array(level - 1, level)))
    large = large.select(F.xxhash64("key", "range").alias("key"), "node", "component", F.col("key").alias("home"), (level > F.col("range")).alias("high"))
    sizes = large.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("main"))
    half = max(1, chunk // 2)
    count = lambda n: F.greatest(F.lit(1), F.ceil(n / half)).cast("int")
    ranged = large.join(sizes.filter("most < n"), "key").withColumns({"of_main": count(F.col("most")), "of_rest": count(F.col("n") - F.col("most")), "is_main": F.col("component") == F.col("main")})
    chunks = F.when(F.col("is_main"), F.col("of_main")).otherwise(F.col("of_rest"))
    rows = ranged.withColumn("chunk", F.pmod(F.xxhash64("node"), chunks).cast("int"))
    whole = rows.filter(F.col("n") <= chunk).select("key", F.lit(0).cast("bigint").alias("part"), "node", "home", "high", F.lit(0).alias("own"), F.lit(False).alias("across"))
    rows = rows.filter(F.col("n") > chunk)
    facing = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("is_main"), F.col("of_rest")).otherwise(F.col("of_main")) - 1)))
    place = F.when(F.col("is_main"), F.col("chunk").cast("bigint") * F.col("of_rest") + F.col("other")).otherwise(F.col("other").cast("bigint") * F.col("of_rest") + F.col("chunk"))
    facing = facing.select("key", place.alias("part"), "node", "home", "high", F.col("is_main").cast("int").alias("own"), F.lit(True).alias("across"))
    rest = rows.filter("NOT is_main").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of_rest") - 1)))
    pair = F.col("of_main").cast("bigint") * F.col("of_rest") + F.least("chunk", "other").cast("bigint") * F.col("of_rest") + F.greatest("chunk", "other")
    rest = rest.select("key", pair.alias("part"), "node", "home", "high", F.col("chunk").alias("own"), (F.col("chunk") != F.col("other")).alias("across"))
    return small.unionByName(whole).unionByName(facing).unionByName(rest)


def _best_pairs(pairs: DataFrame) -> DataFrame:
    """For each node the pair that most blocks gave."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "n"))
    best = both.groupBy("v").agg(F.min(F.struct(-F.col("n"), "u")).alias("b"))
    return best.select(F.least("b.u", "v").alias("u"), F.greatest("b.u", "v").alias("v")).distinct()


def jaccard_groups(docs: DataFrame, percent: int = PERCENT, chunk: int = CHUNK, node_bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    spark, made = docs.sparkSession, []
    small_batches(spark)

    def keep(df: DataFrame, label: str) -> DataFrame:
        made.append(scratch(spark, f"jaccard-{label}"))
        return written(df, made[-1])

    rows = told_apart(keep(sketches(docs, node_bits).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")), "sketches"), keep)
    full = rows.filter("size > 0")
    parts = full.groupBy("node", "salt").agg(F.min("doc_id").alias("least"), F.first("check").alias("check"), F.first("size").alias("size"))
    classes = keep(parts.groupBy("node").agg(F.min("least").alias("doc_id"), F.first("check").alias("check"), F.first("size").alias("size")), "classes")
    banded = full.filter("bands IS NOT NULL").select(F.explode("bands").alias("key"), "node", F.col("size").cast("int").alias("size"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b")).filter("a != b").select("key", "n")
    entries = keep(_once(keep(banded.join(shared, "key"), "entries")), "blocks")
    sharing = entries.select("node").distinct()
    maps = full.filter("bands IS NOT NULL").select("node", "bitmap").join(sharing, "node", "left_semi").dropDuplicates(["node"])
    known = keep(classes.select("node", "doc_id", "check", "size").join(maps, "node"), "sharing")
    alone_yet = known.select("node", "size", "bitmap", F.col("node").alias("component"))
    pairs = keep(forest_pairs(_chunks(entries, chunk).join(alone_yet, "node"), percent), "forest")
    touched = lambda df: df.select(F.col("u").alias("node")).union(df.select("v"))
    partnered = touched(pairs).union(entries.filter(F.col("n") > chunk).select("node")).distinct()
    known = keep(known.join(partnered, "node", "left_semi"), "partnered")
    entries = keep(entries.join(known.select("node"), "node", "left_semi"), "entries")

    def more_sets(pairs: DataFrame, sets: DataFrame | None) -> DataFrame:
        """``sets`` and those of the classes in ``pairs`` that it lacks."""
        wanted = known.select("doc_id", "check", "node").join(touched(pairs).distinct(), "node", "left_semi")
        wanted = keep(wanted if sets is None else wanted.join(sets.select("node"), "node", "left_anti"), "wanted")
        if sets is not None and wanted.isEmpty():
            return sets
        new = keep(sets_of(docs, wanted), "sets")
        return new if sets is None else sets.unionByName(new)

    tried = keep(_best_pairs(pairs), "tried")
    sets = more_sets(pairs, None)
    links = keep(verify(tried, sets, percent), "links")
    found, before = components(links), None
    for n in range(FORESTS + 1):
        state = keep(known.select("node", "size", "bitmap").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "state")
        placed = keep(entries.join(state.select("node", "component"), "node"), "placed")
        mixed = keep(placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a != b").select("key"), "mixed")
        n_mixed = mixed.count()
        if not n_mixed:
            break
        forest = n < FORESTS and (before is None or 2 * n_mixed <= before)
        before, still = n_mixed, keep(placed.join(mixed, "key", "left_semi"), "still")
        if forest:
            given = forest_pairs(_chunks(still, chunk).join(state, "node"), percent)
        else:
            keys = still.groupBy("node").agg(F.collect_set("key").alias("keys"))  # at most one a band
            given = all_pairs(_meetings(still, percent, chunk).join(state.join(keys, "node"), "node"), percent)
        pairs = keep(given.select("u", "v").join(tried, ["u", "v"], "left_anti"), "pairs")
        sets = more_sets(pairs, sets)
        fresh = keep(verify(pairs, sets, percent), "links")
        tried = tried.unionByName(pairs)
        if not fresh.isEmpty():
            links = links.unionByName(fresh)
            found = components(links)
        if not forest:
            break
    grouped = found.select("node", "component").union(found.select(F.col("component").alias("node"), "component").distinct())
    grouped = keep(classes.select("node", "doc_id").join(grouped, "node"), "grouped")
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    named = grouped.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int")).join(least, ["component", "part"]).select("node", "component_id")
    settled = classes.select("node", "doc_id").join(named, "node", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id"))
    by_salt = keep(parts.select("node", "salt").join(settled, "node"), "components")
    linked = full.select("doc_id", F.col("size").alias("n_shingles"), "node", "salt").join(by_salt, ["node", "salt"]).select("doc_id", "n_shingles", "component_id")
    alone = rows.filter("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = keep(linked.unionByName(alone), "groups")
    remove(spark, *made[:-1])
    return out


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is their component's smallest, with all their columns, of any name and type.

    Rows that share a doc_id stay or go together.
    """
    found = jaccard_groups(docs)
    stays = F.max(F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = written(found.groupBy(F.col("doc_id").alias("gone")).agg(stays.alias("stays")).filter("NOT stays").select("gone"), scratch(docs.sparkSession, "near-copies"))
    return without_ids(docs, gone).select("row.*")
