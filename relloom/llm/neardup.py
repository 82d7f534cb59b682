"""MinHash near-duplicates with sequential Bayesian verification, and their connected components.

1. Each document becomes its set of distinct word shingles (64-bit hashes), a signature of minimum hashes and a hash of the
   set. Documents with the same set are one class from here on; its smallest id stands for it.
2. The signature is cut in bands. Sorting (band key, next band's key, id) by range puts a bucket's members side by side,
   however large the bucket, and neighbours become candidates: at most one pair for each class and band.
3. Candidates are compared signature batch by signature batch. A pair is dropped once the posterior chance that its
   similarity reaches the threshold (Beta posterior, flat prior) falls below the miss probability.
4. Survivors are verified exactly on full sets; first those that could join most (each class's smallest partner), then what
   still joins different components. Components are contracted by smallest neighbour and pointer jumping.
5. Buckets that still hold several components are finished in bounded blocks: every member outside the bucket's main
   component is compared with every other member, so no link is lost to the neighbour rule. Comparisons stay inside the
   block; what leaves it is the members that have a plausible partner, and then the verified links, one for each member and
   component. Members of buckets of more than WIDE blocks are first dealt anew by their rarest shingles (two sets that reach
   the threshold share one of the rarest n - ceil(threshold * n) + 1 of either), so that many pages of one template, which
   share the template alone, never meet; the cost of that is a few times their shingles, not their number squared.

The threshold is an argument, 85 percent by default; bands and posterior bounds follow from it. The chance that banding
misses a pair at the threshold is at most BAND_MISS: (1 - 0.85**6)**24 at 0.85, (1 - 0.80**5)**28 at 0.80. Nothing is capped: a bucket of any
size is sorted, not gathered. Documents without words have an empty set, size 0, and are linked with nothing; a null id
belongs to no component and isn't kept; rows that share an id share its component; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Cache, batch, map_batches, materialize, scratch

WORDS, PERCENT = 5, 85
#: Hashes of a signature, hashes compared at a time, chance of dropping a pair that reaches the threshold, by posterior and by bands.
HASHES, STEP, MISS, BAND_MISS = 144, 16, 1e-5, 2e-5
#: Members of a block when a bucket is finished; hashes that are looked up at a time in it; ids that may be broadcast (16 bytes each).
BLOCK, LOOKED_UP, FEW = 256, 1 << 16, 500_000
#: Blocks of a bucket above which its members are dealt by rare shingles; members of a bucket that are neighbours, and compared, anyway.
WIDE, SIDE_BY_SIDE = 64, 2
#: Sets of a shingle above which it is counted when shingles are put in order of rarity.
RARE = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SEED = np.random.default_rng(20240607)
FACTORS = _SEED.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = _SEED.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, cache: Cache, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's ``n``-word shingles; of fewer words, all as one."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = min(n, len(words))
    with np.errstate(over="ignore"):
        total = np.full(len(ids) - n + 1, _MIX * np.uint64(n), np.uint64)
        for j in range(n):
            total += ids[j : len(ids) - n + 1 + j] * PLACES[j]
    return np.unique(mixed(total))


def set_hash(hashes: np.ndarray) -> bytes | None:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def signature(hashes: np.ndarray) -> np.ndarray:
    """16 bits of the minimum under each hash function."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(hashes), 512):
            np.minimum(least, (FACTORS[:, None] * hashes[None, k : k + 512]).min(axis=1), out=least)
    return (mixed(least) & np.uint64(0xFFFF)).astype("<u2")


def banding(percent: int = PERCENT) -> tuple[int, int]:
    """Rows of a band and bands: the longest bands that miss a pair at the threshold with a chance of at most BAND_MISS."""
    for rows in range(HASHES, 1, -1):
        if (1 - (percent / 100) ** rows) ** (HASHES // rows) <= BAND_MISS:
            return rows, HASHES // rows
    return 1, HASHES


def band_keys(signatures: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """[rows, bands] keys; a key tells its band as well."""
    size, bands = banding(percent)
    cut = signatures[:, : bands * size].reshape(len(signatures), bands, size).astype(np.uint64)
    with np.errstate(over="ignore"):
        return mixed((cut * PLACES[:size]).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * _MIX).view(np.int64)


def least_matches(percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """For 0, 1, 2, ... compared hashes, the fewest matches at which P(similarity >= threshold) is still ``miss`` or more."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    upper = grid >= percent / 100
    out = [0]
    for n in range(1, HASHES + 1):
        for m in range(out[-1], n + 1):
            logs = m * np.log(grid) + (n - m) * np.log1p(-grid)
            mass = np.exp(logs - logs.max())
            if mass[upper].sum() / mass.sum() >= miss:
                break
        out.append(m)
    return out


def plausible(left: np.ndarray, right: np.ndarray, least: list[int]) -> np.ndarray:
    """Which rows' signature pairs survive every batch."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for k in range(0, left.shape[1], STEP):
        matches[alive] += (left[alive, k : k + STEP] == right[alive, k : k + STEP]).sum(axis=1)
        alive = alive[matches[alive] >= least[min(k + STEP, left.shape[1])]]
    mask = np.zeros(len(left), bool)
    mask[alive] = True
    return mask


def unpacked(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u2").reshape(-1, HASHES)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, sets (hash of the set, null if empty), sig of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("sets", pa.binary()), ("sig", pa.binary())])

    def run(batches):
        cache = Cache(word_hash, 250_000)
        for b in batches:
            cache.trim()
            found = [shingles(t, cache) for t in b.column(1).to_pylist()]
            yield batch(
                schema,
                doc_id=b.column(0),
                n_shingles=[len(x) for x in found],
                sets=list(map(set_hash, found)),
                sig=[signature(x).tobytes() if len(x) else None for x in found],
            )

    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), run, "doc_id long, n_shingles long, sets binary, sig binary")


def banded(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """key, next, band, rep: a row for each class and band."""
    schema = pa.schema([("key", pa.int64()), ("next", pa.int64()), ("band", pa.int32()), ("rep", pa.int64())])

    def run(batches):
        for b in batches:
            if b.num_rows:
                keys = band_keys(unpacked(b.column(1).to_pylist()), percent)
                bands = keys.shape[1]
                yield batch(schema, key=keys.ravel(), next=np.roll(keys, -1, axis=1).ravel(), band=np.tile(np.arange(bands, dtype=np.int32), len(keys)), rep=np.repeat(b.column(0).to_numpy(), bands))

    return map_batches(classes.select("rep", "sig"), run, "key long, next long, band int, rep long")


def neighbours(rows: DataFrame) -> DataFrame:
    """Distinct pairs a < b of classes that stand side by side in a bucket."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    schema = pa.schema([("part", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])

    def run(batches):
        part, last = TaskContext.get().partitionId(), None
        for b in batches:
            if not b.num_rows:
                continue
            key, rep = b.column(0).to_numpy(), b.column(1).to_numpy()
            if last is None:  # the partition's first row, for the seam
                yield batch(schema, part=[2 * part], a=[rep[0]], b=[None], key=[key[0]])
            else:
                key, rep = np.append(last[0], key), np.append(last[1], rep)
            same = key[1:] == key[:-1]
            x, y = rep[:-1][same], rep[1:][same]
            yield batch(schema, part=[None] * len(x), a=np.minimum(x, y), b=np.maximum(x, y), key=[None] * len(x))
            last = key[-1:], rep[-1:]
        if last is not None:
            yield batch(schema, part=[2 * part + 1], a=last[1], b=[None], key=last[0])

    ordered = rows.repartitionByRange(parts, "key", "next", "rep").sortWithinPartitions("key", "next", "rep").select("key", "rep")
    found = materialize(map_batches(ordered, run, "part long, a long, b long, key long"))
    seams = found.where("part is not null").orderBy("part").collect()  # two rows for each partition
    joined = [(min(x["a"], y["a"]), max(x["a"], y["a"])) for x, y in zip(seams, seams[1:]) if x["part"] % 2 and not y["part"] % 2 and x["key"] == y["key"]]
    pairs = found.where("part is null").select("a", "b")
    if joined:
        pairs = pairs.union(spark.createDataFrame(joined, "a long, b long"))
    return pairs.where("a < b").distinct()


def judged(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs that sequential Bayesian comparison of signatures doesn't drop."""
    least = least_matches(percent)
    sig = classes.select("rep", "sig")
    both = pairs.join(sig.selectExpr("rep a", "sig sig_a"), "a").join(sig.selectExpr("rep b", "sig sig_b"), "b").select("a", "b", "sig_a", "sig_b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for b in batches:
            if b.num_rows:
                keep = plausible(unpacked(b.column(2).to_pylist()), unpacked(b.column(3).to_pylist()), least)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], schema=schema).filter(pa.array(keep))

    return map_batches(both, run, "a long, b long")


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """rep, hashes: the full shingle sets of the listed documents."""
    schema = pa.schema([("rep", pa.int64()), ("hashes", pa.binary())])
    ids = materialize(ids.distinct())
    wanted = F.broadcast(ids) if ids.count() <= FEW else ids
    texts = docs.selectExpr("cast(doc_id as long) rep", "cast(text as string) text").join(wanted, "rep", "left_semi")

    def run(batches):
        cache = Cache(word_hash, 250_000)
        for b in batches:
            cache.trim()
            yield batch(schema, rep=b.column(0), hashes=[shingles(t, cache).tobytes() for t in b.column(1).to_pylist()])

    return map_batches(texts.select("rep", "text"), run, "rep long, hashes binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (with their further columns) whose full sets reach the threshold."""
    names = pairs.columns
    both = pairs.join(sets.selectExpr("rep a", "hashes set_a"), "a").join(sets.selectExpr("rep b", "hashes set_b"), "b").select(*names, "set_a", "set_b")
    n = len(names)

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared))
            yield b.select(names).filter(pa.array(keep, pa.bool_()))

    return map_batches(both, run, pairs.schema)


def relabelled(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
    """a, b, ca, cb: the pairs that join different components, with these, ca < cb."""
    if roots is None:
        return pairs.selectExpr("a", "b", "a ca", "b cb")
    out = pairs.join(roots.selectExpr("node a", "root ra"), "a", "left").join(roots.selectExpr("node b", "root rb"), "b", "left")
    out = out.selectExpr("a", "b", "coalesce(ra, a) ra", "coalesce(rb, b) rb").where("ra <> rb")
    return out.selectExpr("a", "b", "least(ra, rb) ca", "greatest(ra, rb) cb")


def contracted(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame | None:
    """node, root of every node that isn't its component's smallest; ``edges`` (ca < cb) join what ``roots`` holds so far."""
    edges = materialize(edges.select("ca", "cb").distinct())
    while not edges.isEmpty():
        parent = materialize(edges.groupBy(F.col("cb").alias("node")).agg(F.min("ca").alias("root")))
        while True:
            above = parent.selectExpr("node root", "root higher")
            step = materialize(parent.join(above, "root", "left").selectExpr("node", "coalesce(higher, root) root", "higher is not null moved"))
            parent = step.select("node", "root")
            if step.where("moved").isEmpty():
                break
        if roots is None:
            roots = parent
        else:
            moved = roots.join(parent.selectExpr("node root", "root higher"), "root", "left").selectExpr("node", "coalesce(higher, root) root")
            roots = materialize(moved.union(parent))
        edges = materialize(relabelled(edges.selectExpr("ca a", "cb b"), parent).select("ca", "cb").distinct())
    return roots


def joined_up(pairs: DataFrame, verify, roots: DataFrame | None, rounds: int) -> DataFrame | None:
    """Components after all ``pairs``: in each round ``verify`` sees one pair for each component, in the end what is left."""
    for k in range(rounds + 1):
        open_pairs = materialize(relabelled(pairs, roots))
        if open_pairs.isEmpty():
            break
        if k < rounds:
            tried = open_pairs.groupBy("cb").agg(F.min(F.struct("ca", "a", "b")).alias("x")).selectExpr("x.a a", "x.b b", "x.ca ca", "cb")
            roots = contracted(verify(tried), roots)
            pairs = open_pairs.select("a", "b")
        else:
            roots = contracted(verify(open_pairs), roots)
    return roots


def rare_shingles(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """rep, hash: of each set its n - ceil(threshold * n) + 1 rarest shingles; sets that reach the threshold share one of them.

    Any order of all shingles that is the same for every set will do, so only shingles of more than RARE sets are counted.
    """
    schema = pa.schema([("rep", pa.int64()), ("hash", pa.int64()), ("least", pa.int64())])

    def run(batches):
        for b in batches:
            for rep, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                hashes = np.frombuffer(x, np.int64)
                n = len(hashes)
                if n:
                    yield batch(schema, rep=np.full(n, rep), hash=hashes, least=np.full(n, n + (-percent * n) // 100 + 1))

    rows = materialize(map_batches(sets.select("rep", "hashes"), run, "rep long, hash long, least long"))
    common = rows.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > RARE)
    rows = rows.join(common, "hash", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("rep").orderBy("n", "hash"))
    return rows.withColumn("rank", rank).where("rank <= least").select("rep", "hash")


def open_sizes(rows: DataFrame) -> DataFrame:
    """key, n, main (its largest component), targets and probes (their blocks) of the buckets that hold several components."""
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("comps"), F.max_by("comp", F.struct("n", "comp")).alias("main"))
    return sizes.where("comps > 1").selectExpr("key", "n", "main", f"cast(ceil(n / {BLOCK}) as int) targets", f"cast(ceil((n - most) / {BLOCK}) as int) probes")


def unfinished(rows: DataFrame, classes: DataFrame, roots: DataFrame | None, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Blocks (key, i, j) of members with a plausible partner in another component of a bucket they share.

    Columns: key, i, j, rep, comp, probe. A pair that shares several buckets is looked at in the first of them only. Members of
    wide buckets meet by rare shingles of their full sets, in whatever bucket; there band is -1.
    """
    least, (size, _) = least_matches(percent), banding(percent)
    if roots is None:
        rows = rows.selectExpr("key", "band", "rep", "rep comp")
    else:
        rows = rows.join(roots.selectExpr("node rep", "root"), "rep", "left").selectExpr("key", "band", "rep", "coalesce(root, rep) comp")
    # two members were neighbours and have been compared
    rows = materialize(rows.join(open_sizes(rows).where(F.col("n") > SIDE_BY_SIDE), "key"))
    wide = rows.where(F.col("targets") > WIDE).select("rep", "comp")
    if not wide.isEmpty():
        wide = materialize(wide.distinct())
        dealt = rare_shingles(full_sets(docs, wide.select("rep")), percent).join(wide, "rep")
        dealt = materialize(dealt.select(F.col("hash").alias("key"), F.lit(-1).alias("band"), "rep", "comp"))
        rows = rows.where(F.col("targets") <= WIDE).unionByName(dealt.join(open_sizes(dealt), "key"))
    at = lambda blocks: F.pmod(F.xxhash64("rep"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    targets = rows.select("key", "band", "rep", "comp", at("targets").alias("i"), every("probes").alias("j"), F.lit(False).alias("probe"))
    probes = rows.where("comp <> main").select("key", "band", "rep", "comp", every("targets").alias("i"), at("probes").alias("j"), F.lit(True).alias("probe"))
    blocks = targets.union(probes).join(classes.select("rep", "sig"), "rep").select("key", "band", "i", "j", "rep", "comp", "probe", "sig")

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        one, two = block[block.probe.to_numpy()], block[~block.probe.to_numpy()]
        used_one, used_two = np.zeros(len(one), bool), np.zeros(len(two), bool)
        if len(one) and len(two):
            right, comps, band = unpacked(two.sig), two.comp.to_numpy(), max(int(block.band.iloc[0]), 0)
            for k, (comp, sig) in enumerate(zip(one.comp, unpacked(one.sig))):
                other = np.flatnonzero(comps != comp)
                earlier = (right[other, : band * size] == sig[: band * size]).reshape(len(other), band, size).all(axis=2).any(axis=1)
                other = other[~earlier]
                other = other[plausible(right[other], np.broadcast_to(sig, (len(other), len(sig))), least)]
                used_one[k], used_two[other] = len(other) > 0, True
        return pd.concat([one[used_one], two[used_two]])[["key", "i", "j", "rep", "comp", "probe"]]

    return blocks.groupBy("key", "i", "j").applyInPandas(compare, "key long, i int, j int, rep long, comp long, probe boolean")


def block_links(blocks: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: verified links inside blocks of ``unfinished``, one for each probe and other component."""

    def verify(block: pd.DataFrame) -> pd.DataFrame:
        one, two = block[block.probe.to_numpy()], block[~block.probe.to_numpy()]
        out = []
        if len(one) and len(two):
            reps, comps = two.rep.to_numpy(), two.comp.to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in two.hashes]
            sizes = np.array(list(map(len, sets)))
            ones = [np.frombuffer(x, np.uint64) for x in one.hashes]
            counts = np.zeros((len(ones), len(sets)), np.int64)
            part = (np.cumsum(sizes) - sizes) // LOOKED_UP
            for members in np.split(np.arange(len(sets)), np.flatnonzero(np.diff(part)) + 1):
                hashes, starts = np.concatenate([sets[m] for m in members]), np.cumsum(sizes[members]) - sizes[members]
                for k, mine in enumerate(ones):
                    at = np.minimum(np.searchsorted(mine, hashes), len(mine) - 1)
                    counts[k, members] = np.add.reduceat(mine[at] == hashes, starts, dtype=np.int64)
            for rep, comp, mine, shared in zip(one.rep, one.comp, ones, counts):
                close = np.flatnonzero((comps != comp) & (shared > 0) & (100 * shared >= percent * (sizes + len(mine) - shared)))
                for k in close[np.unique(comps[close], return_index=True)[1]]:
                    out.append((min(rep, reps[k]), max(rep, reps[k])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    rows = blocks.join(sets.where("length(hashes) > 0"), "rep").select("key", "i", "j", "rep", "comp", "probe", "hashes")
    return rows.groupBy("key", "i", "j").applyInPandas(verify, "a long, b long").distinct()


def components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept of every row."""
    return placed(docs, percent).drop("sets")


@scratch
def placed(docs: DataFrame, percent: int) -> DataFrame:
    """What ``components`` gives, with the hash of each row's set."""
    found = materialize(features(docs))
    classes = found.where("sets is not null and doc_id is not null").groupBy("sets").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    classes = materialize(classes)
    rows = banded(classes, percent)
    pairs = materialize(judged(neighbours(rows), classes, percent))
    roots = None
    if not pairs.isEmpty():
        sets = materialize(full_sets(docs, pairs.selectExpr("a rep").union(pairs.selectExpr("b rep"))))
        roots = joined_up(pairs, lambda some: verified(some, sets, percent), roots, rounds=2)
    late = materialize(unfinished(rows, classes, roots, docs, percent))
    if not late.isEmpty():
        links = materialize(block_links(late, full_sets(docs, late.select("rep")), percent))
        roots = contracted(relabelled(links, roots), roots)
    out = found.select("doc_id", "n_shingles", "sets").join(classes.select("sets", "rep"), "sets", "left")
    if roots is not None:
        out = out.join(roots.selectExpr("node rep", "root"), "rep", "left")
        out = out.withColumn("rep", F.coalesce("root", "rep"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")))
    return out.select("doc_id", "sets", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def with_sets(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the hash of each row's set as a last column."""
    wide = docs.withColumn(name, F.col("text").cast("string"))

    def run(batches):
        cache = Cache(word_hash, 250_000)
        for b in batches:
            cache.trim()
            found = [set_hash(shingles(t, cache)) for t in b.columns[-1].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.binary())], names=b.schema.names)

    return map_batches(wide, run, docs.withColumn(name, F.lit(None).cast("binary")).schema)


@scratch
def keep(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Whole rows of one document of each component: the one with the smallest id, once; rows with null id are left alone.

    An id whose rows have different sets can be in several components; its rows are then told apart by their sets, and each
    set stays once that isn't a copy of a smaller id's. Of rows with the same id and set the one whose text has the smallest
    hash stays.
    """
    found = materialize(placed(docs, percent).where("doc_id is not null").select("doc_id", "sets", "kept"))
    key = docs["doc_id"].cast("long")

    def listed(ids: DataFrame) -> DataFrame:
        ids = materialize(ids.select(F.col("doc_id").alias("relloom_id")).distinct())
        return F.broadcast(ids) if ids.count() <= FEW else ids

    by_id = materialize(found.groupBy("doc_id").agg(F.sum(F.col("kept").cast("int")).alias("stay"), F.count("*").alias("n")))
    gone = listed(by_id.where("stay = 0"))
    rows = docs.join(gone, key == gone["relloom_id"], "left_anti")
    twice = by_id.where("stay > 0 and n > 1")
    if twice.isEmpty():
        return rows
    twice = listed(twice)
    again = with_sets(rows.join(twice, key == twice["relloom_id"], "left_semi"), "relloom_sets")
    stay = found.where("kept").select(F.col("doc_id").alias("relloom_id"), F.col("sets").alias("relloom_kept")).distinct()
    same = (again["doc_id"].cast("long") == stay["relloom_id"]) & again["relloom_sets"].eqNullSafe(stay["relloom_kept"])
    again = again.join(stay, same, "left_semi")
    first = F.row_number().over(Window.partitionBy(again["doc_id"].cast("long"), again["relloom_sets"]).orderBy(F.xxhash64("text")))
    again = again.withColumn("relloom_row", first).where("relloom_row = 1").drop("relloom_sets", "relloom_row")
    return rows.join(twice, key == twice["relloom_id"], "left_anti").union(again)
