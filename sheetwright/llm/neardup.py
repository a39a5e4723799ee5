"""MinHash near-duplicates by a multi-index Hamming join.

Signatures have ``COMPONENTS`` minhashes of 16 bits, cut into chunks of
``WIDTH``.  Two signatures that differ in at most ``REACH`` components differ
in at most one component of some chunk (pigeonhole), so each chunk is indexed
under its ``WIDTH`` variants with one component left out, and every such pair
shares a key.  A pair of Jaccard similarity 0.75 is beyond the reach with
probability about 1e-4, one of 0.8 with 1e-6.

Copies cost nothing: rows with one shingle set are one entry.  A group of
thousands of near copies is never expanded into its pairs.  Each entry is
first compared, on full sets, with the nearest signature among the least
entries of its keys; the links found join entries into components; and only
keys that still hold several components yield pairs, between different
components, by blocks of bounded size.  No bucket is capped.  Bins only order
these comparisons: every pair within the reach whose components are still
apart is confirmed or refused on full sets.

Texts without words link with nothing.  Rows with equal ids are versions of
one document: a link of either is a link of the id.  Null texts count as
empty; null ids follow the copies they equal.  Of equally near signatures the
least id is compared first, which changes no group.  Very long texts are read
whole and full sets compared in groups bounded by bytes.  Only the id and the
text are read, so other columns can't clash.  An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwright.llm.common import Scratch, connected_components, group_bounds, release_memory, whole_groups

SHINGLE = 5
PERCENT = 75
COMPONENTS, WIDTH = 48, 4
CHUNKS = COMPONENTS // WIDTH
REACH = 2 * CHUNKS - 1
BLOCK = 1024
FAR = 255
#: Ranges of the hash values whose least members are compared before full sets are.
BINS = 256
#: Ids up to this many (8 bytes each) are sent to all executors; more are joined by a shuffle.
BROADCAST_IDS = 200_000
CHUNK_BYTES = 1 << 20
#: Full sets that are compared in one group: of two chunks of so many ids and bytes (or one larger set) at most.
SET_IDS, SET_BYTES = 512, 16 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_ODD = np.uint64(_BASE)
_rng = np.random.default_rng(20240607)
_A = _rng.integers(1, 1 << 63, COMPONENTS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, COMPONENTS, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_POWERS = np.zeros(0, np.uint64), np.zeros(0, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for the next call."""
    global _POWERS
    if len(_POWERS[0]) < n:
        out = []
        for base in (_ODD, _INVERSE):
            p = np.full(2 * n, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS = out[0], out[1]
    return _POWERS[0][:n], _POWERS[1][:n]


def shingle_sets(texts: list[bytes], width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct word shingles of each text; all words as one where there are fewer."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    n = len(data)
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    upper = (data >= 0x41) & (data <= 0x5A)
    lower = (data + (upper.view(np.uint8) << 5)).astype(np.uint64) + np.uint64(1)
    starts = np.flatnonzero(~space[1:] & space[:-1]) + 1
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    powers, inverse = _powers(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lower * powers, dtype=np.uint64)])
    words = _mix((sums[ends] - sums[starts]) * inverse[starts])
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
    rolled = np.zeros(len(words), np.uint64)
    for i in range(width):
        part = words[i:]
        rolled[: len(part)] = rolled[: len(part)] * _ODD + part
    rolled = _mix(rolled)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            value = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    value = value * _ODD + w
            out.append(_mix(np.array([value], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of COMPONENTS 16-bit minhashes for each non-empty set."""
    values = np.concatenate(sets)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), COMPONENTS), np.uint16)
    hashed = np.empty_like(values)
    for i in range(COMPONENTS):
        np.multiply(values, _A[i], out=hashed)
        hashed += _B[i]
        out[:, i] = np.minimum.reduceat(hashed, starts) >> np.uint64(8) & np.uint64(0xFFFF)
    return out


def bin_minima(sets: list[np.ndarray]) -> np.ndarray:
    """A byte for each of BINS ranges of hash values: of the least member there, or 0 without one."""
    out = np.zeros((len(sets), BINS), np.uint8)
    starts = np.arange(BINS, dtype=np.uint64) << np.uint64(56)
    for row, values in zip(out, sets, strict=True):
        at = np.searchsorted(values, starts)
        ends = np.append(at[1:], len(values))
        full = at < ends
        row[full] = values[at[full]] % np.uint64(255) + np.uint64(1)
    return out


def similar_bins(a: np.ndarray, b: np.ndarray, share: float = PERCENT / 100) -> np.ndarray:
    """Whether the equal bins of each pair are within four deviations of ``share`` of those that either fills."""
    used = ((a | b) > 0).sum(1)
    equal = ((a == b) & (a > 0)).sum(1)
    return equal >= share * used - 4 * np.sqrt(share * (1 - share) * used) - 1


def chunk_keys(signature: np.ndarray) -> np.ndarray:
    """CHUNKS * WIDTH keys of each signature row: the chunk, the component left out and the other three."""
    chunks = signature.reshape(len(signature), CHUNKS, WIDTH).astype(np.int64)
    keys = np.empty((len(signature), CHUNKS, WIDTH), np.int64)
    for left_out in range(WIDTH):
        value = np.zeros(chunks.shape[:2], np.int64)
        for j in range(WIDTH):
            if j != left_out:
                value = value << 16 | chunks[:, :, j]
        keys[:, :, left_out] = value | (np.arange(CHUNKS) * WIDTH + left_out) << 48
    return keys.reshape(len(signature), -1)


def _in_pieces(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(texts):
        part, held = [], 0
        while at + len(part) < len(texts) and (not part or held < CHUNK_BYTES):
            part.append((texts[at + len(part)] or "").encode())
            held += len(part[-1])
        yield at, part
        at += len(part)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_hash, sig and bins (null without words) of every row."""
    names = ["doc_id", "n_shingles", "set_hash", "sig", "bins"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in _in_pieces(batch.column(1).to_pylist()):
                sets = shingle_sets(part)
                full = [s for s in sets if len(s)]
                rows = iter(signatures(full)) if full else iter(())
                sig = [next(rows).tobytes() if len(s) else None for s in sets]
                lows = iter(bin_minima(full))
                bins = [next(lows).tobytes() if len(s) else None for s in sets]
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(bins, pa.binary())], names)
        release_memory()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, sig binary, bins binary")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, COMPONENTS)


def postings(entries: DataFrame) -> DataFrame:
    """(key, id) of every entry (id, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                keys = chunk_keys(_matrix(part.column(1)))
                ids = np.repeat(part.column(0).to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(ids)], ["key", "id"])

    return entries.select("id", "sig").mapInArrow(run, "key long, id long")


def _nearest_leads(spark, members: DataFrame, entries: DataFrame) -> DataFrame:
    """(a, b): each entry b and that least entry a of one of its keys whose signature is nearest, within REACH."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distance = (_matrix(batch.column(2)) != _matrix(batch.column(3))).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(distance.astype(np.int32))], ["a", "b", "distance"])

    sig = entries.select("id", "sig")
    pairs = members.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    pairs = pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
    near = pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long, distance int").where(f"distance <= {REACH}")
    return near.groupBy("b").agg(F.min(F.struct("distance", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")


def _cross_pairs(members: DataFrame, components: DataFrame, entries: DataFrame, nearest: int | None) -> DataFrame:
    """Pairs within REACH, of one key but of different components.

    With ``nearest``: (a, b), that many for each member of a block and one for
    each id in the end.  Without: all, a row for each block pair that has any,
    with ids, their components and pairs (places in ids, packed).  A pair is
    listed under the first of its keys alone.

    In a key, the members of its lead's component meet the others, and the
    others meet each other, in blocks of about BLOCK rows dealt by a hash.
    """
    own = members.join(components.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "id", "lead", F.coalesce("component", "id").alias("component"))
    leads = components.select(F.col("node").alias("lead"), F.col("component").alias("_c"))
    own = own.join(leads, "lead", "left").select("key", "id", "component", (F.col("component") == F.coalesce("_c", "lead")).alias("major"))
    stats = own.groupBy("key").agg(F.count_if("major").alias("n_major"), F.count_if(~F.col("major")).alias("n_minor")).where("n_minor > 0")
    blocks = lambda n: F.greatest(F.ceil(F.col(n) / BLOCK), F.lit(1)).cast("int")
    mixed = own.join(stats.select("key", blocks("n_major").alias("nb"), blocks("n_minor").alias("nm")), "key").join(entries.select("id", "sig", "bins", "n"), "id")
    at = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    major = mixed.where("major").select("*", at("nb").alias("i")).select("key", "id", "component", "sig", "bins", "n", F.lit(0).alias("side"), F.lit(0).alias("kind"), "i", F.explode(every("nm")).alias("j"))
    minor = mixed.where("not major").select("*", at("nm").alias("me"))
    against = minor.select("key", "id", "component", "sig", "bins", "n", F.lit(1).alias("side"), F.lit(0).alias("kind"), F.explode(every("nb")).alias("i"), F.col("me").alias("j"))
    among = minor.where("nm > 0").select("key", "id", "component", "sig", "bins", "n", "me", F.explode(every("nm")).alias("o")).select("key", "id", "component", "sig", "bins", "n", F.when(F.col("me") <= F.col("o"), 0).otherwise(1).alias("side"), F.lit(1).alias("kind"), F.least("me", "o").alias("i"), F.greatest("me", "o").alias("j"))
    group = ["key", "kind", "i", "j"]
    columns = ['grp', 'ids', 'components', 'pairs']
    dealt = major.unionByName(against).unionByName(among).repartition(*group).sortWithinPartitions(*group)

    def pairs_in(comp, sig, bins, side, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        left = np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        distance = np.empty((len(left), len(right)), np.uint8)
        for at in range(0, len(left), 64):
            distance[at : at + 64] = (sig[left[at : at + 64]][:, None, :] != sig[right][None, :, :]).sum(2)
        distance[comp[left][:, None] == comp[right][None, :]] = FAR
        x, y = np.nonzero(distance <= REACH)
        if len(x):
            alike = np.concatenate([similar_bins(bins[left[x[at : at + 4096]]], bins[right[y[at : at + 4096]]]) for at in range(0, len(x), 4096)])
            # Unlike bins make a link unlikely, not impossible: the first round leaves them out, the last has them at the end.
            first = np.flatnonzero(alike) if nearest is not None else np.argsort(~alike, kind="stable")
            x, y = x[first], y[first]
        if nearest is not None and len(x) > nearest:
            keep = np.zeros(len(x), bool)
            far = distance[x, y]
            for mine in (x, y):  # rank of each pair among those of its member
                order = np.lexsort((far, mine))
                first = np.concatenate([[0], np.flatnonzero(np.diff(mine[order])) + 1])
                rank = np.arange(len(order)) - np.repeat(first, np.diff(np.concatenate([first, [len(order)]])))
                keep[order[rank < nearest]] = True
            x, y = x[keep], y[keep]
        return left[x], right[y], distance[x, y]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, group):
            key, kind, i, j, ids, component, side, size = (rows.column(c).to_numpy() for c in ("key", "kind", "i", "j", "id", "component", "side", "n"))
            sig, bins, found = _matrix(rows.column("sig")), np.frombuffer(b"".join(rows.column("bins").to_pylist()), np.uint8).reshape(-1, BINS), []
            packed: list[list] = [[], [], [], []]
            for a, b in group_bounds(rows, group):
                if b - a < 2:
                    continue
                x, y, far = pairs_in(component[a:b], sig[a:b], bins[a:b], side[a:b], bool(kind[a] == 1 and i[a] == j[a]))
                if nearest is not None:
                    found.append((ids[a:b][x], ids[a:b][y], far))
                    continue
                own = first_key(sig[a:b][x], sig[a:b][y]) == key[a] >> 48
                for number, used, places in in_set_groups(x[own], y[own], size[a:b]):
                    values = (hash((int(key[a]), int(kind[a]), int(i[a]), int(j[a]), number)), ids[a:b][used].tolist(), component[a:b][used].tolist(), places.astype(np.int32).tobytes())
                    for column, value in zip(packed, values, strict=True):
                        column.append(value)
            if packed[0]:
                yield pa.RecordBatch.from_arrays([pa.array(packed[0], pa.int64()), pa.array(packed[1], pa.list_(pa.int64())), pa.array(packed[2], pa.list_(pa.int64())), pa.array(packed[3], pa.binary())], columns)
            if found:
                x, y, far = (np.concatenate(f) for f in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(far.astype(np.int32))], ["a", "b", "distance"])

    if nearest is None:
        return dealt.mapInArrow(run, "grp long, ids array<long>, components array<long>, pairs binary")
    pairs = dealt.mapInArrow(run, "a long, b long, distance int").where("a <> b")
    # Each id keeps its nearest partner of all its keys.
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("e"), "distance").select("e.*", "distance")
    best = ends.groupBy("id").agg(F.min(F.struct("distance", "other")).alias("m")).select("id", F.col("m.other").alias("other"))
    return best.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def in_set_groups(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number, rows, pairs as places in rows, all left ones first) of the groups in which the pairs (x, y) are compared: the
    rows are cut into chunks of SET_IDS ids and SET_BYTES of sets, and a group has the pairs between two chunks."""
    if not len(x):
        return
    used, places = np.unique(np.concatenate([x, y]), return_inverse=True)
    chunk = np.cumsum(8 * sizes[used]) // SET_BYTES * (len(used) // SET_IDS + 1) + np.arange(len(used)) // SET_IDS
    left, right = places[: len(x)], places[len(x) :]
    groups, of = np.unique(np.stack([chunk[left], chunk[right]]), axis=1, return_inverse=True)
    for number in range(groups.shape[1]):
        mine = np.flatnonzero(of.reshape(-1) == number)
        rows, inside = np.unique(np.concatenate([left[mine], right[mine]]), return_inverse=True)
        yield number, used[rows], inside


def first_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The leading part of the first key that each pair of signatures shares (of those that share one)."""
    equal = (a == b).reshape(len(a), CHUNKS, WIDTH)
    chunk = (equal.sum(2) >= WIDTH - 1).argmax(1)
    left_out = (~equal[np.arange(len(a)), chunk]).argmax(1)
    return chunk * WIDTH + left_out


def similar(p: np.ndarray, q: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets reach the similarity."""
    if not len(p) or not len(q) or 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
        return False
    both = np.concatenate([p, q])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def _confirm_packed(docs: DataFrame, packed: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): links that join the components of each block pair, confirmed on full sets.

    The sets of a row's ids, bounded by SET_IDS and SET_BYTES, are brought to it; a pair whose components are
    joined by then needs no look, so a row gives fewer links than it has ids.
    """
    ids = scratch.save(packed.select(F.explode("ids").alias("id")).distinct(), "ids")
    sets = scratch.save(_sets_of(docs, ids), "sets")
    needed = packed.select("grp", F.explode("ids").alias("id")).join(sets, "id").select("grp", F.lit(1).alias("tag"), "id", "set", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<long>").alias("components"), F.lit(None).cast("binary").alias("pairs"))
    heads = packed.select("grp", F.lit(0).alias("tag"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("set"), "ids", "components", "pairs")
    rows = heads.unionByName(needed).repartition("grp").sortWithinPartitions("grp", "tag")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["grp"]):
            tags = table.column("tag").to_numpy()
            out_a, out_b = [], []
            for a, b in group_bounds(table, ["grp"]):
                n = int((tags[a:b] == 0).sum())
                have: dict[int, list[np.ndarray]] = {}
                for key, data in zip(table.column("id").slice(a + n, b - a - n).to_pylist(), table.column("set").slice(a + n, b - a - n).to_pylist(), strict=True):
                    have.setdefault(key, []).append(np.frombuffer(data, np.uint64))
                for head in range(a, a + n):
                    keys, parts = table.column("ids")[head].as_py(), table.column("components")[head].as_py()
                    root = {c: c for c in parts}

                    def top(c: int, root: dict[int, int] = root) -> int:
                        while root[c] != c:
                            root[c] = c = root[root[c]]
                        return c

                    pairs = np.frombuffer(table.column("pairs")[head].as_py(), np.int32).reshape(2, -1)
                    for x, y in pairs.T.tolist():
                        p, q = top(parts[x]), top(parts[y])
                        if p != q and any(similar(s, t) for s in have[keys[x]] for t in have[keys[y]]):
                            root[max(p, q)] = min(p, q)
                            out_a.append(keys[x])
                            out_b.append(keys[y])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    links = scratch.save(rows.mapInArrow(run, "a long, b long"), "links")
    scratch.drop(sets)
    scratch.drop(ids)
    return links


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, set): the full shingle sets of the documents named by ``ids`` (distinct)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in _in_pieces(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array([s.tobytes() for s in shingle_sets(part)], pa.binary())], ["id", "set"])
        release_memory()

    few = ids.count() <= BROADCAST_IDS
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(ids) if few else ids, "id", "left_semi")
    return texts.mapInArrow(run, "id long, set binary")


def confirm(docs: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets reach the similarity."""
    ids = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    sets = scratch.save(_sets_of(docs, ids), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    links = scratch.save(joined.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long").distinct(), "links")
    scratch.drop(sets)
    scratch.drop(ids)
    return links


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text, ...)."""
    scratch = Scratch(spark, "neardup")
    docs = docs.select("doc_id", "text")
    described = scratch.save(describe(docs), "described")
    entries = scratch.save(described.where("set_hash is not null and doc_id is not null").groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.min("sig").alias("sig"), F.min("bins").alias("bins"), F.min("n_shingles").alias("n")), "entries")
    posted = scratch.save(postings(entries), "postings")
    shared = posted.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("n")).where("n > 1").select("key", "lead")
    members = scratch.save(posted.join(shared, "key"), "members")
    scratch.drop(posted)
    tested = scratch.save(_nearest_leads(spark, members, entries), "leads")
    links = confirm(docs, tested, scratch)
    first = scratch.save(connected_components(spark, links, scratch), "components")
    for nearest in (1, None):
        cross = _cross_pairs(members, first, entries, nearest)
        cross = scratch.save(cross.join(tested, ["a", "b"], "left_anti") if nearest else cross, "cross")
        if cross.isEmpty():
            continue
        more = confirm(docs, cross, scratch) if nearest else _confirm_packed(docs, cross, scratch)
        known = first.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        first = scratch.save(connected_components(spark, known.unionByName(more), scratch), "components")
    found = entries.select("set_hash", "id").join(first.select(F.col("node").alias("id"), "component"), "id", "left").select("set_hash", F.coalesce("component", "id").alias("component"))
    rows = described.join(found, "set_hash", "left")
    component = F.coalesce("component", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents, all columns kept, without those whose group has a smaller id.

    Rows with an id and a text in common are one document, of which one row
    stays.  Rows without an id always stay.
    """
    found = Scratch(spark, "groups").save(near_duplicates(spark, docs), "groups")
    gone = found.where("not kept and doc_id is not null").select("doc_id").distinct()
    few = gone.count() <= BROADCAST_IDS  # then the texts need not move
    kept = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*[docs[c] for c in docs.columns])
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    others = kept.join(repeated, "doc_id", "left_anti").select(*[docs[c] for c in docs.columns])
    return others.unionByName(kept.join(repeated, "doc_id", "left_semi").select(*[docs[c] for c in docs.columns]).dropDuplicates(["doc_id", "text"]))
