"""Removal of repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller id.  Sorting every suffix would move 50 times the text,
so only suffixes at anchors take part: the anchor of a window of LENGTH bytes
is its position with the least hash of GRAM bytes.  Equal windows have equal
anchors at equal places, hence nothing is lost.

1. Documents are gathered into blocks, which are written bucketed by their
   number, so that later joins move only what is said about a block.
2. Each block's sorted distinct anchor hashes go out in ranges.  The hash's
   leading bits are implied by the range (they are coded once).  A range tells
   each block which of its anchors occur in several documents.
3. For those, each block sorts its suffixes and sends front-coded runs: per
   suffix the length of the prefix it shares with the one before, and the
   rest.  A suffix starts at its anchor and is followed by the bytes to the
   left that its windows reach; equal ones of a block are sent once.
4. A loser tree that carries common-prefix lengths merges the runs of a range.
   Suffixes which share their whole anchor come out side by side, and each run
   learns the least document of its suffixes, window by window where variants
   of one anchor differ.
5. The suffixes of anchors found in more than HOT_BLOCKS blocks are merged in
   levels: runs of up to HOT_BLOCKS blocks become one run without equal keys,
   until that many runs are left, and the answers come back the same way.  So a
   passage in a third of all documents never meets in one task.

Nulls count as empty texts.  Rows without an id count as later than all others.
Rows with equal ids are one document: they remove nothing from each other, so
ties and repeated rows have one result.  Texts shorter than LENGTH bytes lose
nothing; very long ones are a block of their own.  Only the id and the text are
read, so other columns can't clash.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwright.llm.common import Scratch, release_memory, save_bucketed

LENGTH = 50
GRAM = 32
WINDOW = LENGTH - GRAM + 1  # anchors that a string of LENGTH bytes can choose from
#: A block is a row; rows of many megabytes are hard on the executors' heaps.
BLOCK_BYTES = 4 << 20
#: Text behind a bucket file of blocks, and behind a range of the exchange.
BUCKET_BYTES = RANGE_BYTES = 16 << 20
#: Files of blocks at most (Spark takes 100,000 buckets; a file then holds many blocks), and ranges at most, as bits.
MOST_BUCKETS, MOST_RANGE_BITS = 50_000, 16
PIECE_BYTES = 1 << 18
#: Bytes of a sort key at most, filled up to whole words: LENGTH + WINDOW - 1 of text and a length.
KEY = -(-(LENGTH + WINDOW) // 8) * 8
HOT_BLOCKS = 2048
LATEST = (1 << 63) - 1
#: Stands for the least document of a key whose windows have different ones.
MIXED = -(1 << 63)
_MULTIPLIERS = tuple(np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of every ``width`` neighbours."""
    n, step, out = len(values) - width + 1, 1, values
    while 2 * step <= width:
        out = best(out[:-step], out[step:])
        step *= 2
    if step < width:
        out = best(out[:n], out[width - step : width - step + n])
    return out[:n]


def gram_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each position."""
    n = len(data) - GRAM + 1
    words = np.ndarray((len(data) - 7,), np.uint64, buffer=data, strides=(1,))
    h = words[:n] * _MULTIPLIERS[0]
    product = np.empty_like(h)
    for i, m in enumerate(_MULTIPLIERS[1:], 1):
        np.multiply(words[8 * i : 8 * i + n], m, out=product)
        h += product
    np.right_shift(h, np.uint64(32), out=product)
    h ^= product
    h *= _MULTIPLIERS[0]
    return h


def anchors(data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, first window, last window) of each anchor of the texts that ``data`` joins, in order.

    A window start belongs to the leftmost of the positions with the least hash
    in its reach.  Windows that leave their text do not exist.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none.astype(np.uint64), none, none
    h = gram_hashes(data)
    least = _slide(h, WINDOW, np.minimum)
    ends = np.cumsum(sizes)
    change = np.zeros(len(data) + 1, np.int8)
    # Texts of LENGTH bytes and more have windows from their start to LENGTH before their end.
    long = sizes >= LENGTH
    np.add.at(change, (ends - sizes)[long], 1)
    np.add.at(change, ends[long] - LENGTH + 1, -1)
    starts = np.flatnonzero(np.cumsum(change[: len(least)], dtype=np.int8) > 0)
    # Candidates are positions that are the least of some window; each window takes the first that equals its own least.
    edge = np.zeros(WINDOW - 1, np.uint64)
    candidate = _slide(np.concatenate([edge, least, edge]), WINDOW, np.maximum) == h
    chosen = np.flatnonzero(candidate)
    at = (np.cumsum(candidate, dtype=np.int32) - candidate)[starts]  # the first candidate at or after each start
    wanted, hashes = least[starts], h[chosen]
    open_ = np.flatnonzero(hashes[at] != wanted)
    while len(open_):
        at[open_] += 1
        open_ = open_[hashes[at[open_]] != wanted[open_]]
    if not len(starts):
        return none, none.astype(np.uint64), none, none
    # Between the windows of two texts there is a gap.
    first = np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1])
    last = np.concatenate([first[1:] - 1, [len(starts) - 1]])
    position = chosen[at[first]]
    return position, h[position], starts[first], starts[last]


def suffix_keys(data: np.ndarray, position: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort keys (rows of KEY bytes, filled up with zeros) and their lengths.

    A key is the suffix at an anchor as far as its windows reach, then the
    bytes before it backwards as far, then the length of the former.
    """
    keys = np.zeros((len(position), KEY), np.uint8)
    sizes = last + LENGTH - first + 1
    column = np.arange(KEY, dtype=np.int32)
    for at in range(0, len(position), 1 << 14):
        p, f, e = (x[at : at + (1 << 14)].astype(np.int64) for x in (position, first, last))
        right, size = (e + LENGTH - p)[:, None], (e + LENGTH - f)[:, None]
        offset = np.where(column < right, column, right - 1 - column)
        part = data[np.clip(p[:, None] + offset, 0, len(data) - 1)]
        part[column >= size] = 0
        part[np.arange(len(p)), size[:, 0]] = right[:, 0]
        keys[at : at + len(p)] = part
    return keys, sizes


def windows_of(key: bytes) -> list[tuple[int, bytes]]:
    """(bytes before the anchor, string) of each window in a sort key, first window first."""
    right = key[: key[-1]]
    left = key[key[-1] : -1][::-1]
    whole, n = left + right, len(left) + len(right) - LENGTH + 1
    return [(len(left) - i, whole[i : i + LENGTH]) for i in range(n)]


def shared(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix, known to be ``start`` at least."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    while a[start : start + 8] == b[start : start + 8]:
        start += 8
    while a[start] == b[start]:
        start += 1
    return start


def front_code(keys: np.ndarray, sizes: np.ndarray) -> tuple[bytes, bytes]:
    """(per key the shared and the remaining length, the remaining bytes, compressed) of sorted distinct ``keys``."""
    lcp = np.zeros(len(keys), np.int64)
    if len(keys) > 1:
        lcp[1:] = np.minimum((keys[1:] != keys[:-1]).argmax(1), np.minimum(sizes[1:], sizes[:-1]))
    column = np.arange(keys.shape[1])
    rest = keys[(column >= lcp[:, None]) & (column < sizes[:, None])]
    return np.stack([lcp, sizes - lcp], 1).astype(np.uint8).tobytes(), pa.compress(rest.tobytes(), "zstd", asbytes=True)


def unfold(sizes: bytes, rest: bytes) -> tuple[list[bytes], list[int]]:
    """The keys of a front-coded run, and the prefix each shares with the one before."""
    keys, at, before = [], 0, b""
    if sizes:
        rest = pa.decompress(rest, sum(sizes[1::2]), "zstd", asbytes=True)
    for i in range(0, len(sizes), 2):
        n = sizes[i + 1]
        before = before[: sizes[i]] + rest[at : at + n]
        at += n
        keys.append(before)
    return keys, list(sizes[::2])


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[bytes, int, int, int]]:
    """(key, prefix shared with the key before, run, place in the run) in sorted order.

    A loser tree: each loser keeps the prefix it shares with the key that beat
    it.  Of two keys measured against the same winner, the one that shares more
    with it is smaller, without a look at either; on a tie the comparison goes
    on behind the known prefix.
    """
    k = 1
    while k < max(1, len(runs)):
        k *= 2
    keys: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (k - len(runs))
    lcps, places = [0] * k, [0] * k
    tree = [0] * k  # losers; tree[0] is the winner

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs; the loser's prefix is then measured against the winner."""
        x, y = keys[a], keys[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        p, q = lcps[a], lcps[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        n = shared(x, y, p)
        first = len(x) == n or (len(y) != n and x[n] < y[n])
        if len(x) == len(y) == n:
            first = a < b
        if first:
            lcps[b] = n
            return a, b
        lcps[a] = n
        return b, a

    level = list(range(k))
    node = k
    while len(level) > 1:
        node //= 2
        up = []
        for i in range(0, len(level), 2):
            won, lost = play(level[i], level[i + 1])
            tree[node + i // 2] = lost
            up.append(won)
        level = up
    winner = level[0]
    while keys[winner] is not None:
        yield keys[winner], lcps[winner], winner, places[winner]
        places[winner] += 1
        at, (own, own_lcps) = places[winner], runs[winner]
        if at < len(own):
            keys[winner], lcps[winner] = own[at], own_lcps[at]
        else:
            keys[winner] = None
        node = (winner + k) // 2
        while node:
            winner, tree[node] = play(winner, tree[node])
            node //= 2


class Block:
    """The documents of a block: ids, places and anchors."""

    def __init__(self, ids: bytes, sizes: bytes, blob: bytes):
        self.ids, self.sizes = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64)
        self.ends, self.blob = np.cumsum(self.sizes), blob
        self.data = np.frombuffer(blob, np.uint8)
        found, at = [], 0
        while at < len(self.sizes):  # some texts at a time, to hold few rows of eight bytes a byte
            begin = int(self.ends[at] - self.sizes[at])
            upto = max(at + 1, int(np.searchsorted(self.ends, begin + PIECE_BYTES, "right")))
            part = anchors(blob[begin : int(self.ends[upto - 1])], self.sizes[at:upto])
            found.append((part[0] + begin, part[1], part[2] + begin, part[3] + begin))
            at = upto
        self.position, self.hash, self.first, self.last = (np.concatenate([f[i] for f in found]) for i in range(4))
        self.hash = _spread(self.hash)
        self.owner = np.searchsorted(self.ends, self.first, "right")
        self.keys, self.inverse = np.unique(self.hash, return_inverse=True)

    def several(self) -> np.ndarray:
        """Of each distinct hash, whether several documents of the block have it."""
        owner_ids = self.ids[self.owner]
        low, high = np.full(len(self.keys), LATEST, np.int64), np.full(len(self.keys), -LATEST, np.int64)
        np.minimum.at(low, self.inverse, owner_ids)
        np.maximum.at(high, self.inverse, owner_ids)
        return low < high

    def marked(self, marks: np.ndarray, mark: int) -> np.ndarray:
        """Numbers of the anchors whose hash has ``mark``."""
        return np.flatnonzero(marks[self.inverse] == mark)

    def runs(self, marks: np.ndarray, mark: int, bits: int) -> tuple[list[tuple[int, bytes, bytes, bytes]], np.ndarray]:
        """(range, sizes, rest, docs) of the front-coded sorted distinct keys of the anchors with ``mark``, and for each of
        those anchors the place of its key among all keys in order of range and key."""
        chosen = self.marked(marks, mark)
        if not len(chosen):
            return [], chosen
        keys, sizes = suffix_keys(self.data, self.position[chosen], self.first[chosen], self.last[chosen])
        part = _range_of(self.hash[chosen], bits)
        words = keys.view(">u8").astype(np.uint64)
        order = np.lexsort([*words.T[::-1], part])
        sorted_words = words[order]
        new = np.concatenate([[True], (sorted_words[1:] != sorted_words[:-1]).any(1)])
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        least = np.full(int(new.sum()), LATEST, np.int64)
        np.minimum.at(least, place, self.ids[self.owner[chosen]])
        distinct = order[new]
        keys, sizes, part = keys[distinct], sizes[distinct], part[distinct]
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        return [(int(part[a]), *front_code(keys[a:b], sizes[a:b]), least[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], place


def _spread(hashes: np.ndarray) -> np.ndarray:
    """A one-to-one image of the hashes with even leading bits; those of anchors are least of many, hence small."""
    h = hashes.astype(np.uint64) * _MULTIPLIERS[1]
    h ^= h >> np.uint64(32)
    return h * _MULTIPLIERS[3]


def _range_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _gather(docs: DataFrame, block_bytes: int) -> DataFrame:
    """block, ids, sizes, blob: whole documents in blocks of about ``block_bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held, chunk = [], [], 0, 0
        task = TaskContext.get().partitionId()

        def close() -> pa.RecordBatch:
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            return pa.RecordBatch.from_arrays([pa.array([task << 24 | chunk], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([sizes.tobytes()]), pa.array([b"".join(texts)], pa.binary())], ["block", "ids", "sizes", "blob"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode()
                if texts and held + len(data) > block_bytes:
                    yield close()
                    ids, texts, held, chunk = [], [], 0, chunk + 1
                ids.append(LATEST if key is None else key)
                texts.append(data)
                held += len(data)
        if texts:
            yield close()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "block long, ids binary, sizes binary, blob binary")


def _rows(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _anchor_ranges(blocks: DataFrame, bits: int) -> DataFrame:
    """part, block, tails (uint32), several (uint8): each block's sorted distinct hashes by range."""
    names, types = ["part", "block", "tails", "several"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, *parts in _one_by_one(batch):
                block = Block(*parts)
                several = block.several().astype(np.uint8)
                ranges = _range_of(block.keys, bits)
                tails = (block.keys >> np.uint64(32 - bits)).astype(np.uint32)
                cuts = np.concatenate([[0], np.flatnonzero(ranges[1:] != ranges[:-1]) + 1, [len(ranges)]]) if len(ranges) else [0]
                rows = [(int(ranges[a]), number, tails[a:b].tobytes(), several[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield _rows(names, types, rows)

    return blocks.select("block", "ids", "sizes", "blob").mapInArrow(run, "part long, block long, tails binary, several binary")


def _mark_anchors(ranges: DataFrame, hot_blocks: int) -> DataFrame:
    """part, block, marks: for each hash 0 (one document only), 1 (several) or 2 (in more than ``hot_blocks`` blocks)."""
    names = ["part", "block", "marks"]

    def mark(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint32) for x in table.column("tails").to_pylist()]
        several = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("several").to_pylist()])
        _, inverse, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        any_several = np.zeros(len(counts), np.uint8)
        np.maximum.at(any_several, inverse, several)
        level = np.where(counts > hot_blocks, 2, (counts > 1) | (any_several > 0)).astype(np.uint8)[inverse]
        ends = np.cumsum([len(p) for p in parts])
        marks = [level[e - len(p) : e].tobytes() for e, p in zip(ends, parts, strict=True)]
        release_memory()
        return pa.Table.from_arrays([table.column("part"), table.column("block"), pa.array(marks, pa.binary())], names)

    return ranges.groupBy("part").applyInArrow(mark, "part long, block long, marks binary")


def _joined_marks(pairs: list[dict]) -> np.ndarray:
    """The marks of a block's ranges in order."""
    return np.frombuffer(b"".join(p["marks"] for p in sorted(pairs, key=lambda p: p["part"])), np.uint8)


def _send_runs(marked: DataFrame, bits: int) -> DataFrame:
    """kind 1 or 2: part, block, run_sizes, rest, docs, the front-coded runs of the anchors with that mark; kind 0: block, and
    as rest and docs the place of each anchor's key among the block's keys, range by range, of those marked 1 and 2."""

    names = ["kind", "part", "block", "run_sizes", "rest", "docs"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, sizes, blob, pairs in _one_by_one(batch):
                block, marks, rows, places = Block(ids, sizes, blob), _joined_marks(pairs), [], []
                for mark in (1, 2):
                    found, place = block.runs(marks, mark, bits)
                    rows += [(mark, part, number, coded, rest, docs) for part, coded, rest, docs in found]
                    places.append(place.astype(np.uint32).tobytes())
                yield _rows(names, types, [*rows, (0, None, number, None, *places)])

    return marked.select("block", "ids", "sizes", "blob", "pairs").mapInArrow(run, "kind int, part long, block long, run_sizes binary, rest binary, docs binary")


def least_documents(runs: list[tuple[bytes, bytes, bytes]]) -> list[tuple[bytes, bytes]]:
    """For each front-coded run (sizes, rest, docs): the least document of each suffix, MIXED where its windows differ,
    and the least documents of the windows of those, in order."""
    opened = [unfold(s, r) for s, r, _ in runs]
    docs = [np.frombuffer(d, np.int64).tolist() for _, _, d in runs]
    least = [[0] * len(keys) for keys, _ in opened]
    detail: list[dict[int, list[int]]] = [{} for _ in runs]
    group: list[tuple[bytes, int, list[tuple[int, int]]]] = []

    def close() -> None:
        if len(group) == 1:
            _, doc, places = group[0]
            for run, place in places:
                least[run][place] = doc
            return
        windows: dict[tuple[int, bytes], int] = {}
        split = [windows_of(key) for key, _, _ in group]
        for (_, doc, _), strings in zip(group, split, strict=True):
            for s in strings:
                if windows.setdefault(s, doc) > doc:
                    windows[s] = doc
        for (_, _, places), strings in zip(group, split, strict=True):
            found = [windows[s] for s in strings]
            same = min(found) == max(found)
            for run, place in places:
                least[run][place] = found[0] if same else MIXED
                if not same:
                    detail[run][place] = found

    before = None
    for key, lcp, run, place in merge_runs(opened):
        doc = docs[run][place]
        if before is not None and lcp >= GRAM:
            if lcp == len(before) == len(key):
                last = group[-1]
                group[-1] = (key, min(last[1], doc), last[2])
                last[2].append((run, place))
            else:
                group.append((key, doc, [(run, place)]))
        else:
            if group:
                close()
            group = [(key, doc, [(run, place)])]
        before = key
    if group:
        close()
    return [(np.array(row, np.int64).tobytes(), np.array([x for place in sorted(d) for x in d[place]], np.int64).tobytes()) for row, d in zip(least, detail, strict=True)]


def _merge(runs: DataFrame) -> DataFrame:
    """part, block, least, detail: what each run learns."""

    def merge(table: pa.Table) -> pa.Table:
        release_memory()
        found = least_documents(list(zip(*(table.column(c).to_pylist() for c in ("run_sizes", "rest", "docs")), strict=True)))
        return pa.Table.from_arrays([table.column("part"), table.column("block"), pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())], ["part", "block", "least", "detail"])

    return runs.select("part", "block", "run_sizes", "rest", "docs").groupBy("part").applyInArrow(merge, "part long, block long, least binary, detail binary")


def one_run(runs: list[tuple[bytes, bytes, bytes]]) -> tuple[tuple[bytes, bytes, bytes], list[bytes], bytes]:
    """The run of the distinct keys of front-coded runs with the least document of each; for each run the places of its
    keys there; and how many windows each key there has."""
    opened = [unfold(s, r) for s, r, _ in runs]
    docs = [np.frombuffer(d, np.int64).tolist() for _, _, d in runs]
    places: list[list[int]] = [[] for _ in runs]
    sizes, rest, least, windows, before = bytearray(), [], [], bytearray(), None
    for key, lcp, run, place in merge_runs(opened):
        doc = docs[run][place]
        if before is None or not lcp == len(before) == len(key):
            sizes += bytes((lcp if before is not None else 0, len(key) - (lcp if before is not None else 0)))
            rest.append(key[lcp if before is not None else 0 :])
            least.append(doc)
            windows.append(len(key) - LENGTH)
            before = key
        elif doc < least[-1]:
            least[-1] = doc
        places[run].append(len(least) - 1)
    whole = bytes(sizes), pa.compress(b"".join(rest), "zstd", asbytes=True), np.array(least, np.int64).tobytes()
    return whole, [np.array(p, np.uint32).tobytes() for p in places], bytes(windows)


def _merge_in_levels(hot: DataFrame, scratch: Scratch, blocks: int, fan_in: int) -> DataFrame:
    """What ``_merge`` gives, for anchors of any number of blocks: no task merges more than about ``fan_in`` runs."""
    names = ["kind", "part", "block", "parent", "run_sizes", "rest", "docs"]
    types = [pa.int32(), *[pa.int64()] * 3, *[pa.binary()] * 3]

    def merge(table: pa.Table) -> pa.Table:
        release_memory()
        part, parent = table.column("part")[0].as_py(), table.column("parent")[0].as_py()
        whole, places, windows = one_run(list(zip(*(table.column(c).to_pylist() for c in ("run_sizes", "rest", "docs")), strict=True)))
        rows = [(1, part, block, parent, place, windows, None) for block, place in zip(table.column("block").to_pylist(), places, strict=True)]
        return pa.Table.from_batches([_rows(names, types, [(0, part, parent, None, *whole), *rows])])

    def hand_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part, block, places, windows, least, detail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                least, detail, width = np.frombuffer(least, np.int64), np.frombuffer(detail, np.int64), np.frombuffer(windows, np.uint8).astype(np.int64)
                width = np.where(least == MIXED, width, 0)
                begin, places = np.cumsum(width) - width, np.frombuffer(places, np.uint32)
                own = [detail[b : b + w] for b, w in zip(begin[places].tolist(), width[places].tolist(), strict=True) if w]
                rows.append((part, block, least[places].tobytes(), np.concatenate([np.zeros(0, np.int64), *own]).tobytes()))
            yield _rows(["part", "block", "least", "detail"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()], rows)

    runs, levels = hot.select("part", "block", "run_sizes", "rest", "docs"), []
    while blocks > fan_in:
        blocks = -(-blocks // fan_in)
        dealt = runs.withColumn("parent", F.pmod(F.xxhash64("block"), F.lit(blocks)))
        level = scratch.save(dealt.groupBy("part", "parent").applyInArrow(merge, "kind int, part long, block long, parent long, run_sizes binary, rest binary, docs binary"), "level")
        levels.append(level.where("kind = 1").select("part", "block", "parent", F.col("run_sizes").alias("places"), F.col("rest").alias("windows")))
        runs = level.where("kind = 0").select("part", "block", "run_sizes", "rest", "docs")
    answers = scratch.save(_merge(runs), "hot")
    for level in reversed(levels):
        above = answers.select("part", F.col("block").alias("parent"), "least", "detail")
        joined = level.join(above, ["part", "parent"]).select("part", "block", "places", "windows", "least", "detail")
        answers = scratch.save(joined.mapInArrow(hand_down, "part long, block long, least binary, detail binary"), "hot")
    return answers


def _covered(block: Block, chosen: np.ndarray, places: bytes, answers: list[dict]) -> list[np.ndarray]:
    """The starts, in the block, of the windows that go, of the anchors ``chosen``."""
    if not len(chosen):
        return []
    answers = sorted(answers, key=lambda a: a["part"])
    least = np.concatenate([np.frombuffer(a["least"], np.int64) for a in answers])
    place = np.frombuffer(places, np.uint32)
    counts = block.last[chosen] - block.first[chosen] + 1
    own = block.ids[block.owner[chosen]]
    doc = least[place]
    whole = (doc != MIXED) & (doc < own)
    firsts, n = block.first[chosen[whole]], counts[whole]
    ends = np.cumsum(n)
    gone = [np.repeat(firsts - ends + n, n) + np.arange(int(n.sum()))]
    # Keys whose windows differ have their answers in detail, in the order of the keys.
    mixed = np.flatnonzero(doc == MIXED)
    if len(mixed):
        detail = np.concatenate([np.frombuffer(a["detail"], np.int64) for a in answers])
        width = np.zeros(len(least), np.int64)
        width[place[mixed]] = counts[mixed]
        begin = np.cumsum(width) - width
        n = counts[mixed]
        ends = np.cumsum(n)
        offset = np.arange(int(n.sum())) - np.repeat(ends - n, n)
        hit = detail[np.repeat(begin[place[mixed]], n) + offset] < np.repeat(own[mixed], n)
        gone.append((np.repeat(block.first[chosen[mixed]], n) + offset)[hit])
    return gone


def _one_by_one(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows as Python values; blocks are large, so never all at once, and what they took is given back."""
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in batch.columns)
    release_memory()


def _removed(ready: DataFrame) -> DataFrame:
    names = ["doc_id", "n_bytes", "spans", "kept"]
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sizes, blob, pairs, places, hot_places, answers, hot in _one_by_one(batch):
                block, marks = Block(ids, sizes, blob), _joined_marks(pairs or [])
                change = np.zeros(len(block.data) + 1, np.int32)
                parts = [_covered(block, block.marked(marks, mark), p, found or []) for mark, p, found in ((1, places, answers), (2, hot_places, hot))]
                starts = np.concatenate([np.zeros(0, np.int64), *parts[0], *parts[1]])
                np.add.at(change, starts, 1)
                np.add.at(change, starts + LENGTH, -1)
                gone = np.cumsum(change[:-1]) > 0
                # A run ends with its text, even if the next text begins with another.
                cuts = np.zeros(len(gone) + 1, bool)
                cuts[block.ends - block.sizes] = cuts[block.ends] = True
                cuts = cuts[:-1]
                begins = np.flatnonzero(gone & (cuts | ~np.concatenate([[False], gone[:-1]])))
                stops = np.flatnonzero(gone & np.concatenate([cuts[1:] | ~gone[1:], [True]])) + 1 if len(gone) else begins
                bounds = np.searchsorted(begins, np.concatenate([[0], block.ends]))
                rows, kept = [], block.data[~gone].tobytes()
                lost = np.concatenate([[0], np.cumsum(gone)])
                base = block.ends - block.sizes
                for i, (key, n) in enumerate(zip(block.ids.tolist(), block.sizes.tolist(), strict=True)):
                    at, end = int(base[i]), int(block.ends[i])
                    spans = [{"start": x - at, "end": y - at} for x, y in zip(begins[bounds[i] : bounds[i + 1]].tolist(), stops[bounds[i] : bounds[i + 1]].tolist(), strict=True)]
                    rows.append((None if key == LATEST else key, n, spans, kept[at - int(lost[at]) : end - int(lost[end])]))
                yield _rows(names, [pa.int64(), pa.int64(), spans_type, pa.binary()], rows)

    return ready.select("ids", "sizes", "blob", "pairs", "places", "hot_places", "answers", "hot").mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def remove_repeats(spark: SparkSession, docs: DataFrame, block_bytes: int = BLOCK_BYTES, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """doc_id, n_bytes, spans (removed) and kept (the remaining bytes) of every document."""
    scratch = Scratch(spark, "suffixes")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = min(MOST_BUCKETS, max(64, total // BUCKET_BYTES + 1))
    bits = min(MOST_RANGE_BITS, max(6, int(total // RANGE_BYTES).bit_length()))
    blocks = save_bucketed(spark, _gather(docs, block_bytes), scratch, "block", buckets)
    marks = scratch.save(_mark_anchors(_anchor_ranges(blocks, bits), hot_blocks), "marks")
    pairs = marks.groupBy("block").agg(F.collect_list(F.struct("part", "marks")).alias("pairs"))
    runs = scratch.save(_send_runs(blocks.join(pairs, "block"), bits), "runs")
    gathered = lambda found, name: found.groupBy("block").agg(F.collect_list(F.struct("part", "least", "detail")).alias(name))
    answers = gathered(scratch.save(_merge(runs.where("kind = 1")), "answers"), "answers")
    hot = gathered(_merge_in_levels(runs.where("kind = 2"), scratch, blocks.count(), max(2, hot_blocks)), "hot")
    places = runs.where("kind = 0").select("block", F.col("rest").alias("places"), F.col("docs").alias("hot_places"))
    ready = blocks.join(places, "block", "left").join(pairs, "block", "left").join(answers, "block", "left").join(hot, "block", "left")
    return _removed(ready)


def repeat_digest(removed: DataFrame) -> DataFrame:
    """The query's columns, from ``remove_repeats``."""
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return removed.select("doc_id", "n_bytes", lost.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
