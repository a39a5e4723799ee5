"""Hidden Markov language model: Baum-Welch across partitions, exact likelihood by scaled forward recursion.

Latent states emit symbols.  A word that makes up HEAD_SHARE of the training
tokens or more, and LEAST_HEAD tokens at least, is a symbol of its own (1 /
HEAD_SHARE of them at most); the rarer words of one ending (a hash of
their last four bytes, CLASSES of them) share a symbol and its emissions, and follow their own counts inside it.  With
c a word's training count, C that of its symbol, and u the unigram probability
of an unknown word,

    p(w | state) = (1 - u) b_state(symbol) c(w) / C(symbol)    for a known word,
    p(w | state) = u                                           for an unknown one,

which sums to one.  So a text's log probability is the sum of log c(w) / N over
its known words, log u for each unknown one, and the log of a forward recursion
over the ratios (1 - u) b(symbol) N / C(symbol).

Training and scoring run over whole texts.  Texts are worked on in stretches of
STRETCH tokens, which changes no result: the product of a stretch's matrices
carries the forward message in and the backward message out, so each stretch is
then passed over with the exact messages of the whole text, and memory is
bounded by stretches and not by the longest text.  Each task emits expected
counts by symbol, which are summed before and after the shuffle.  Training ends
after ROUNDS rounds, or once a round gains less than GAIN of the likelihood.

Word counts are exact up to equal 64-bit hashes of different words, and
distributed: texts are coded once in blocks with their own sorted dictionary,
a block sends each range of hashes its words there as one row, and gets back
their counts in the corpus.  What reaches the driver is the head words' hashes
and one row of STATES numbers per symbol, bounded by the parameters; the counts
of all words, which the scores rest on, grow with the corpus and stay in files.

Null and empty texts hold the end alone.  Rows without an id are training rows.
Repeated rows count as often as they stand, and ties do not arise: a text's
score depends on its words only.  Only the id and the text are read, so other
columns can't clash.  An empty table gives an empty result, and one without
training rows the unigram scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwright.llm.common import Scratch, release_memory

STATES = 6
HEAD_SHARE, LEAST_HEAD = 2.0**-17, 5
CLASSES = 1 << 15
ROUNDS, GAIN = 4, 1e-4
STRETCH = 512
BLOCK_BYTES = 8 << 20
#: Rows of a row group of the tables of blocks (megabytes each) and of their counts, so that a task holds few at once whatever it reads.
BLOCKS_AT_ONCE, COUNTS_AT_ONCE = 1, 256
#: Bytes that a text adds to its block besides its own.
ROW_BYTES = 16
#: Text behind a range of the exchange of counts, and ranges at most: beyond them a piece is no more than a shuffle's row.
RANGE_BYTES, MOST_RANGE_BITS = 16 << 20, 16
#: Tokens whose forward and backward rows are held at once.
HELD_TOKENS = 1 << 18
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
END = b""


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def word_class(word: bytes) -> int:
    """The class of a rare word; the end has class 0 to itself."""
    return 1 + zlib.crc32(word[-4:]) % (CLASSES - 1) if word else 0


def is_held_out(doc_id, parts: int = 7) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % parts == 2


def encode(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per block of whole texts: doc_ids, held, sizes (tokens), ids (places in the block's dictionary), and by
    place hashes (ascending), classes and counts (in training rows); tokens of training rows."""
    names = ["block", "doc_ids", "held", "sizes", "ids", "hashes", "classes", "counts", "tokens"]
    types = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 6, pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, chunk, size = TaskContext.get().partitionId(), 0, 0
        words, keys, coded = _Words({END: 0}), [], []

        def close() -> pa.RecordBatch:
            held = np.array([is_held_out(k) for k in keys], np.uint8)
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            hashes, place = np.unique(hashes, return_inverse=True)
            ids = place.astype(np.uint32)[np.concatenate(coded)]
            classes = np.zeros(len(hashes), np.uint16)
            classes[place] = np.fromiter(map(word_class, words), np.uint16, len(words))
            counts = np.bincount(ids[np.repeat(held == 0, sizes)], minlength=len(hashes)).astype(np.uint32)
            row = [task << 24 | chunk, keys, held.tobytes(), sizes.tobytes(), ids.tobytes(), hashes.tobytes(), classes.tobytes(), counts.tobytes(), int(sizes[held == 0].sum())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode()
                if keys and size + len(data) + ROW_BYTES > block_bytes:
                    yield close()
                    chunk, size, words, keys, coded = chunk + 1, 0, _Words({END: 0}), [], []
                tokens = data.translate(_LOWER).split()
                ids = np.zeros(len(tokens) + 1, np.uint32)
                ids[:-1] = np.fromiter(map(words.__getitem__, tokens), np.uint32, len(tokens))
                keys.append(key)
                coded.append(ids)
                size += len(data) + ROW_BYTES
        if keys:
            yield close()
        release_memory()

    schema = "block long, doc_ids array<long>, held binary, sizes binary, ids binary, hashes binary, classes binary, counts binary, tokens long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def corpus_counts(blocks: DataFrame, bits: int, least_head: int) -> DataFrame:
    """kind 0: part, block, known, the corpus counts of a block's words in a range of hashes, in order; kind 1: the
    number of distinct training words of a range, and the hashes of those found ``least_head`` times."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "block", "hashes", "counts"]
        for batch in batches:
            for block, hashes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes, counts = np.frombuffer(hashes, np.uint64), np.frombuffer(counts, np.uint32)
                part = (hashes >> np.uint64(64 - bits)).astype(np.int64)
                cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
                rows = [(int(part[a]), block, hashes[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.binary(), pa.binary()], strict=True)], names)

    def count(table: pa.Table) -> pa.Table:
        names = ["kind", "part", "block", "known", "distinct"]
        hashes = [np.frombuffer(h, np.uint64) for h in table.column("hashes").to_pylist()]
        distinct, place = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, place, np.concatenate([np.frombuffer(c, np.uint32) for c in table.column("counts").to_pylist()]).astype(np.int64))
        known, ends = total[place], np.cumsum(list(map(len, hashes)))
        rows = [known[e - len(h) : e].tobytes() for e, h in zip(ends, hashes, strict=True)]
        n, part = len(rows), table.column("part")[0].as_py()
        head = distinct[total >= least_head].tobytes()
        release_memory()
        return pa.Table.from_arrays(
            [pa.array([0] * n + [1], pa.int32()), pa.array([part] * (n + 1), pa.int64()), pa.array([*table.column("block").to_pylist(), None], pa.int64()), pa.array([*rows, head], pa.binary()), pa.array([0] * n + [int((total > 0).sum())], pa.int64())], names
        )

    pieces = blocks.select("block", "hashes", "counts").mapInArrow(send, "part long, block long, hashes binary, counts binary")
    return pieces.groupBy("part").applyInArrow(count, "kind int, part long, block long, known binary, distinct long")


def symbols_of(hashes: np.ndarray, classes: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The symbol of each word: its place in ``head`` (sorted hashes) behind the classes, or else its class."""
    at = np.minimum(np.searchsorted(head, hashes), max(0, len(head) - 1))
    own = head[at] == hashes if len(head) else np.zeros(len(hashes), bool)
    return np.where(own, CLASSES + at, classes).astype(np.int32)


def symbol_counts(blocks: DataFrame, head: np.ndarray) -> np.ndarray:
    """Training tokens of each symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES + len(head), np.int64)
        for batch in batches:
            for hashes, classes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                symbols = symbols_of(np.frombuffer(hashes, np.uint64), np.frombuffer(classes, np.uint16), head)
                np.add.at(total, symbols, np.frombuffer(counts, np.uint32).astype(np.int64))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["symbol", "n"])

    rows = blocks.select("hashes", "classes", "counts").mapInArrow(run, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CLASSES + len(head))
    out[rows.column("symbol").to_numpy()] = rows.column("n").to_numpy()
    return out


class Stretches:
    """Sequences cut into stretches: first token, length and sequence of each, whether it begins its sequence, and the
    normalised messages that cross its ends (``before``: forward, ``after``: backward)."""

    def __init__(self, seen: np.ndarray, sizes: np.ndarray, start: np.ndarray, move: np.ndarray, ratio: np.ndarray, length: int | None = None):
        length = length or STRETCH
        parts = -(-sizes // length)
        self.sequence = np.repeat(np.arange(len(sizes)), parts)
        nth = np.arange(len(self.sequence)) - np.repeat(np.cumsum(parts) - parts, parts)
        self.at = np.repeat(np.cumsum(sizes) - sizes, parts) + nth * length
        self.size = np.minimum(length, np.repeat(sizes, parts) - nth * length)
        self.first = nth == 0
        k = len(start)
        self.before, self.after = np.full((len(nth), k), 1 / k), np.ones((len(nth), k))
        long = np.flatnonzero(parts[self.sequence] > 1)
        if len(long):
            self._messages(long, transfers(seen, self.at[long], self.size[long], self.first[long], start, move, ratio), parts)

    def _messages(self, long: np.ndarray, product: np.ndarray, parts: np.ndarray) -> None:
        place = np.zeros(len(self.sequence), np.int64)
        place[long] = np.arange(len(long))
        many = np.flatnonzero(parts > 1)
        many = many[np.argsort(-parts[many], kind="stable")]
        begin, count = (np.cumsum(parts) - parts)[many], parts[many]
        for j in range(int(count[0]) - 1):  # a stretch hands on to the next, in all sequences that go on
            now = begin[: np.searchsorted(-count, -(j + 1))] + j
            passed = (self.before[now][:, None, :] @ product[place[now]])[:, 0]
            self.before[now + 1] = passed / passed.sum(1, keepdims=True)
        ends = begin + count - 1
        for j in range(int(count[0]) - 1):
            now = ends[: np.searchsorted(-count, -(j + 1))] - j
            passed = (product[place[now]] @ self.after[now][:, :, None])[:, :, 0]
            self.after[now - 1] = passed / passed.sum(1, keepdims=True)


def transfers(seen: np.ndarray, at: np.ndarray, size: np.ndarray, first: np.ndarray, start: np.ndarray, move: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Of each stretch, the product of its moves and emissions, scaled: from the state before it to its last state."""
    k = len(start)
    order = np.argsort(-size, kind="stable")
    at, size = at[order], size[order]
    m = np.where(first[order][:, None, None], np.broadcast_to(start, (k, k)), move) * ratio[seen[at]][:, None, :]
    for t in range(1, int(size[0])):
        n = int(np.searchsorted(-size, -t))
        m[:n] = (m[:n].reshape(-1, k) @ move).reshape(n, k, k) * ratio[seen[at[:n] + t]][:, None, :]
        if t % 8 == 0:
            m[:n] /= m[:n].sum((1, 2), keepdims=True)
    out = np.empty_like(m)
    out[order] = m / m.sum((1, 2), keepdims=True)
    return out


def _batches(size: np.ndarray, held: int = HELD_TOKENS) -> Iterator[np.ndarray]:
    """Which stretches, longest first, of about ``held`` tokens at once."""
    order = np.argsort(-size, kind="stable")
    upto = np.cumsum(size[order])
    at = 0
    while at < len(order):
        stop = max(at + 1, int(np.searchsorted(upto, upto[at] - size[order[at]] + held, "right")))
        yield order[at:stop]
        at = stop


def _active(size: np.ndarray) -> np.ndarray:
    """Of sizes in falling order: how many go on at each step."""
    return len(size) - np.searchsorted(size[::-1], np.arange(size[0]), "right")


def expected_counts(seen: np.ndarray, sizes: np.ndarray, start: np.ndarray, move: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch sums over whole sequences: first states, moves, emissions by symbol, and the log likelihood ratio."""
    k = len(start)
    firsts, moves, emissions, log = np.zeros(k), np.zeros((k, k)), np.zeros((len(ratio), k)), 0.0
    if not len(sizes):
        return firsts, moves, emissions, log
    parts = Stretches(seen, sizes, start, move, ratio)
    for chosen in _batches(parts.size):
        size, at = parts.size[chosen], parts.at[chosen]
        active = _active(size)
        ends = np.cumsum(active)
        begins = ends - active
        step = np.repeat(np.arange(len(active)), active)
        symbols = seen[at[np.arange(len(step)) - begins[step]] + step]
        weighted = ratio[symbols]
        alpha, scale = np.empty_like(weighted), np.empty(len(step))
        row = np.where(parts.first[chosen][:, None], start, parts.before[chosen] @ move)
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            now = weighted[a:b] * (row if not a else row[: b - a] @ move)
            total = now.sum(1)
            now /= total[:, None]
            alpha[a:b], scale[a:b] = now, total
            row = now
        log += float(np.log(scale).sum())
        weighted /= scale[:, None]
        beta = np.ones_like(alpha)
        last = begins[size - 1] + np.arange(len(size))
        after = parts.after[chosen]
        beta[last] = after / (after * alpha[last]).sum(1, keepdims=True)
        back = move.T.copy()
        for t in range(len(active) - 1, 0, -1):
            a, b, n = begins[t], ends[t], active[t]
            weighted[a:b] *= beta[a:b]
            beta[begins[t - 1] : begins[t - 1] + n] = weighted[a:b] @ back
        weighted[: active[0]] *= beta[: active[0]]
        gamma = alpha * beta
        entry = parts.first[chosen]
        firsts += gamma[: active[0]][entry].sum(0)
        late = np.arange(active[0], len(step))
        pairs = alpha[late - np.repeat(active[:-1], active[1:])].T @ weighted[late]
        moves += move * (pairs + parts.before[chosen][~entry].T @ weighted[: active[0]][~entry])
        for i in range(k):
            emissions[:, i] += np.bincount(symbols, weights=gamma[:, i], minlength=len(ratio))
    return firsts, moves, emissions, log


def log_ratios(symbols: np.ndarray, known: np.ndarray, sizes: np.ndarray, start: np.ndarray, move: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """log10 of the exact likelihood ratio of each whole sequence; unknown tokens have ratio one in every state."""
    out = np.zeros(len(sizes))
    if not len(sizes):
        return out
    table = np.concatenate([ratio, np.ones((1, len(start)))])
    seen = np.where(known, symbols, len(ratio))
    parts = Stretches(seen, sizes, start, move, table)
    for chosen in _batches(parts.size):
        size, at = parts.size[chosen], parts.at[chosen]
        gain = np.zeros(len(chosen))
        row = np.where(parts.first[chosen][:, None], start, parts.before[chosen] @ move)
        for t, n in enumerate(_active(size).tolist()):
            row = (row[:n] @ move if t else row) * table[seen[at[:n] + t]]
            total = row.sum(1)
            row /= total[:, None]
            gain[:n] += np.log10(total)
        np.add.at(out, parts.sequence[chosen], gain)
    return out


def _expectations(blocks: DataFrame, head: np.ndarray, start: np.ndarray, move: np.ndarray, ratio: np.ndarray) -> DataFrame:
    """A task's sums: symbols -1 and below for moves (row by row), then first states and the log likelihood, else emissions."""
    k = len(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, moves, emissions, log = np.zeros(k), np.zeros((k, k)), np.zeros((len(ratio), k)), 0.0
        for batch in batches:
            for held, sizes, ids, hashes, classes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sizes, train = np.frombuffer(sizes, np.int64), np.frombuffer(held, np.uint8) == 0
                symbols = symbols_of(np.frombuffer(hashes, np.uint64), np.frombuffer(classes, np.uint16), head)
                tokens = np.frombuffer(ids, np.uint32)[np.repeat(train, sizes)]
                f, m, e, one = expected_counts(symbols[tokens], sizes[train], start, move, ratio)
                firsts, moves, log = firsts + f, moves + m, log + one
                emissions += e
        used = np.flatnonzero(emissions.any(1))
        number = np.concatenate([used, -1 - np.arange(k), [-1 - k]]).astype(np.int32)
        values = np.concatenate([emissions[used], moves, firsts[None]])
        yield pa.RecordBatch.from_arrays([pa.array(number), *(pa.array(values[:, i]) for i in range(k)), pa.array(np.where(number == -1 - k, log, 0.0))], ["symbol", *(f"s{i}" for i in range(k)), "log"])
        release_memory()

    return blocks.select("held", "sizes", "ids", "hashes", "classes").mapInArrow(run, "symbol int, " + ", ".join(f"s{i} double" for i in range(k)) + ", log double")


def train(blocks: DataFrame, head: np.ndarray, counts: np.ndarray, unknown: float, states: int = STATES, rounds: int = ROUNDS, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """(start, move, ratio, log likelihood ratio of each round).  ``counts``: training tokens by symbol."""
    rng = np.random.default_rng(seed)
    total = counts.sum()
    share = counts / max(total, 1)
    emission = share[:, None] * np.exp(rng.normal(0, 0.7, (len(counts), states)))
    start = np.full(states, 1 / states)
    move = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
    logs: list[float] = []

    def ratio_of(b: np.ndarray) -> np.ndarray:
        return (1 - unknown) * b / np.maximum(b.sum(0), 1e-300) / np.where(share > 0, share, 1.0)[:, None]

    for _ in range(rounds if total else 0):
        sums = [F.sum(f"s{i}").alias(f"s{i}") for i in range(states)]
        rows = _expectations(blocks, head, start, move, ratio_of(emission)).groupBy("symbol").agg(*sums, F.sum("log").alias("log")).toArrow()
        number = rows.column("symbol").to_numpy()
        values = np.stack([rows.column(f"s{i}").to_numpy() for i in range(states)], 1)
        found = np.zeros((len(counts), states))
        found[number[number >= 0]] = values[number >= 0]
        for i in range(states):
            move[i] = values[number == -1 - i][0] + 0.1
        move /= move.sum(1, keepdims=True)
        start = values[number == -1 - states][0] + 0.1
        start /= start.sum()
        # A thousandth of each state's mass follows the unigram shares, so no known symbol is impossible.
        emission = found + share[:, None] * (1 + 0.001 * found.sum(0))
        logs.append(float(rows.column("log").to_numpy().sum()))
        if len(logs) > 1 and logs[-1] - logs[-2] < GAIN * total:
            break
    return start, move, ratio_of(emission), logs


def _score(blocks: DataFrame, head: np.ndarray, total: int, distinct: int, start: np.ndarray, move: np.ndarray, ratio: np.ndarray) -> DataFrame:
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, held, sizes, ids, hashes, classes, pieces in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sizes, tokens = np.frombuffer(sizes, np.int64), np.frombuffer(ids, np.uint32)
                counts = np.frombuffer(b"".join(p["known"] for p in sorted(pieces, key=lambda p: p["part"])), np.int64)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                of = lambda v: np.bincount(owner, weights=v[tokens], minlength=len(sizes))  # noqa: B023, E731
                base = of(np.log10(counts + 1)) - sizes * np.log10(total + distinct + 1)
                own = of(np.where(counts > 0, np.log10(np.maximum(counts, 1) / max(total, 1)), -np.log10(total + distinct + 1)))
                symbols = symbols_of(np.frombuffer(hashes, np.uint64), np.frombuffer(classes, np.uint16), head)
                gain = log_ratios(symbols[tokens], counts[tokens] > 0, sizes, start, move, ratio)
                known_of = of((counts > 0).astype(np.float64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.frombuffer(held, np.uint8) == 1), pa.array(sizes), pa.array(known_of), pa.array([total] * len(sizes), pa.int64()), pa.array(base), pa.array(own + gain)], names)
        release_memory()

    return blocks.select("doc_ids", "held", "sizes", "ids", "hashes", "classes", "pieces").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(spark: SparkSession, docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text."""
    scratch = Scratch(spark, "markov")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = scratch.save(encode(docs, block_bytes), "blocks", BLOCKS_AT_ONCE)
    total = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    bits = min(MOST_RANGE_BITS, max(6, int(size // RANGE_BYTES).bit_length()))
    known = scratch.save(corpus_counts(blocks, bits, max(LEAST_HEAD, int(total * HEAD_SHARE))), "known", COUNTS_AT_ONCE)
    distinct = known.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    heads = [r["known"] for r in known.where("kind = 1 and length(known) > 0").select("known").collect()]  # 1 / HEAD_SHARE hashes at most
    head = np.sort(np.frombuffer(b"".join(heads), np.uint64))
    start, move, ratio, _ = train(blocks, head, symbol_counts(blocks, head), 1 / (total + distinct + 1), states, rounds)
    pieces = known.where("kind = 0").groupBy("block").agg(F.collect_list(F.struct("part", "known")).alias("pieces"))
    return _score(blocks.join(pieces, "block"), head, total, distinct, start, move, ratio)
