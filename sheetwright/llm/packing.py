"""Best-fit packing of token pieces by minimum bin slack.

Documents become token pieces in one pass.  Only the histogram of piece
lengths (at most ``capacity`` rows, whatever the corpus) reaches the driver:
there each sequence is planned by a bitset subset-sum over the lengths still
available, the fullest combination is taken out as often as its lengths last,
and pieces are then dealt to the planned places by their rank among the pieces
of equal length.  The number of plans is bounded by the capacity too, since
each one uses up a length (or less than one use of it stays).

Null and empty texts are one piece that holds the end id alone.  Repeated rows
are packed each for itself, null ids too.  Very long texts are tokenised whole
and cut only then.  Equal lengths are dealt by rank, so ties change which
sequence a piece is in, never how many there are.  Only the id and the text are
read, so other columns can't clash.  An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetwright.llm.common import Scratch, release_memory, short_batches

CAPACITY = 4096
END_ID = 1


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Chunks(dict):
    """Number of each blank-separated chunk; unknown ones get the next and are noted."""

    def __init__(self):
        self.new: list[str] = []
        self.chars = 0

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        self.new.append(chunk)
        self.chars += len(chunk)
        return n


def _gathered(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ..., ``counts[i]`` of them for each i in turn."""
    ends = np.cumsum(counts)
    places = np.repeat(starts - ends + counts, counts)
    places += np.arange(len(places))
    return places


#: The normalizer and the splitting under which ``_SIMPLE`` chunks are taken apart.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}
#: Latin letters, and ASCII punctuation behind them but the apostrophe: a token's worth of each for the tokenizer's splitting.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class ChunkTokenizer:
    """Ids of whole texts, tokenising each distinct blank-separated chunk once.

    The tokenizer drops white space and never joins characters across it, so
    the ids of a text are those of its chunks in turn.  Only the blank, tab and
    line ends split here; any other space stays inside its chunk.  The special
    tokens' own strings hold no space, so they are found inside their chunk and
    give the special ids, as they do in the whole text.

    Where the tokenizer lower-cases and splits letters from what follows them, a
    chunk of Latin letters and punctuation has the ids of its lower-cased word
    and then those of its punctuation, so a word's spellings are learned once.
    Such words are told apart by their last ids, which end a word.
    """

    MAX_CHUNKS, MAX_CHARS = 600_000, 24_000_000
    #: A chunk of one token that stands between the chunks learned at once; those that hold it are learned singly.
    MARK = "\U0001f602"
    AT_ONCE = 500

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self._ids(self.MARK)
        self.ends = self._word_ends(path)
        self.chunks = _Chunks()
        self.starts, self.counts, self.hits = (np.zeros(0, np.int64) for _ in range(3))
        self.flat = np.zeros(0, np.uint32)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def shrink(self, parts: int = 2) -> None:
        """Keep the chunks met most often, in one of ``parts`` of the room at most."""
        least = 2
        while np.count_nonzero(self.hits >= least) > self.MAX_CHUNKS // parts:
            least *= 2
        before, self.chunks, kept = self.chunks, _Chunks(), []
        for n, (word, hits) in enumerate(zip(before, self.hits.tolist(), strict=True)):
            if hits >= least and self.chunks.chars + len(word) <= self.MAX_CHARS // parts:
                self.chunks[word]
                kept.append(n)
        self.chunks.new = []
        counts = self.counts[kept]
        self.flat = self.flat[_gathered(self.starts[kept], counts)]
        self.starts, self.counts, self.hits = np.cumsum(counts) - counts, counts, self.hits[kept]

    @staticmethod
    def _word_ends(path: str) -> np.ndarray | None:
        """Whether an id ends a word; None for a tokenizer by other rules."""
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        model, split = rules["model"], (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        known = {"type": "Split", "pattern": _SPLIT, "behavior": "Removed", "invert": True}
        level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
        if rules.get("normalizer") != _NORMALIZER or split[0] != known or len(split) != 2 or split[1] | level != split[1] or model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>":
            return None
        ends = np.zeros(1 + max([*model["vocab"].values(), *(t["id"] for t in rules["added_tokens"])]), bool)
        ends[[n for token, n in model["vocab"].items() if token.endswith("</w>")]] = True
        return ends

    def _learn(self) -> None:
        new, first = self.chunks.new, len(self.counts)
        if not new:
            return
        words, others, whole, heads, tails = [], [], [], [], []
        for n, chunk in enumerate(new):  # a part that is not yet known comes behind them
            found = _SIMPLE.fullmatch(chunk) if self.ends is not None else None
            if not found:
                others.append(n)
            elif chunk == (word := found[1].lower()):
                words.append(n)
            else:
                whole.append(n)
                heads.append(self.chunks[word])
                tails.append(self.chunks[found[2]])
        flat, size = [self.flat], len(self.flat)
        starts, counts = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)

        def add(which: list[int], ids: np.ndarray, lengths: np.ndarray) -> None:
            nonlocal size
            starts[which], counts[which] = size + np.cumsum(lengths) - lengths, lengths
            flat.append(ids)
            size += len(ids)

        for at in range(0, len(words), self.AT_ONCE):
            part = words[at : at + self.AT_ONCE]
            ids = np.array(self._ids(" ".join([new[n] for n in part])), np.uint32)
            cuts = np.flatnonzero(self.ends[ids])
            if len(cuts) == len(part) and cuts[-1] == len(ids) - 1:
                add(part, ids, np.diff(cuts, prepend=-1))
            else:
                others += part
        plain = len(self.mark) == 1
        at = 0
        while at < len(others):
            upto = at
            while plain and upto < min(len(others), at + self.AT_ONCE) and self.MARK not in new[others[upto]]:
                upto += 1
            if upto - at > 1:
                ids = np.array(self._ids(f" {self.MARK} ".join([new[n] for n in others[at:upto]])), np.uint32)
                cuts = np.flatnonzero(ids == self.mark[0])
                add(others[at:upto], ids[ids != self.mark[0]], np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
            else:
                upto = at + 1
                ids = np.array(self._ids(new[others[at]]), np.uint32)
                add(others[at:upto], ids, np.array([len(ids)]))
            at = upto
        self.starts, self.counts = np.concatenate([self.starts, starts]), np.concatenate([self.counts, counts])
        self.flat = np.concatenate(flat)
        if whole:
            parts = np.array([heads, tails]).T.ravel()
            lengths = self.counts[parts]
            own = lengths[::2] + lengths[1::2]
            at = first + np.array(whole)
            self.starts[at], self.counts[at] = len(self.flat) + np.cumsum(own) - own, own
            self.flat = np.concatenate([self.flat, self.flat[_gathered(self.starts[parts], lengths)]])
        self.hits = np.concatenate([self.hits, np.zeros(len(new), np.int64)])
        self.chunks.new = []

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        for at in range(0, len(texts), 2000):
            part = texts[at : at + 2000]
            if len(self.chunks) > self.MAX_CHUNKS or self.chunks.chars > self.MAX_CHARS:
                self.shrink()
            number = self.chunks.__getitem__
            rows = []
            for text in part:
                words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if text else []
                rows.append(np.fromiter(map(number, words), np.int64, len(words)))
            self._learn()
            self.hits += np.bincount(np.concatenate(rows), minlength=len(self.hits))
            for row in rows:
                yield self.flat[_gathered(self.starts[row], self.counts[row])]


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """One tokenizer for each Python worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: id, piece, start, length, ids_crc32, ids if asked for,
    and ``task`` and ``nth``, the rank among the task's pieces of that length."""
    field = docs.schema[id_col]
    names = [id_col, "piece", "start", "length", "ids_crc32", "task", "nth", *(["ids"] if with_ids else [])]
    schema = f"`{id_col}` {field.dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, task int, nth long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        encoder = chunk_tokenizer(tokenizer_path)
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for key, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                data = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for piece, start in enumerate(range(0, len(data), capacity)):
                    part = data[start : start + capacity]
                    n = len(part)
                    for column, value in zip(rows, (key, piece, start, n, zlib.crc32(part.tobytes()), task, int(seen[n]), part.astype(np.int32) if with_ids else None), strict=False):
                        column.append(value)
                    seen[n] += 1
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=False)], names)
        encoder.shrink(6)  # the worker may serve other stages next
        release_memory()

    return short_batches(docs).select(id_col, text_col).mapInArrow(run, schema)


def fullest(lengths: dict[int, int], space: int) -> dict[int, int]:
    """The multiset of available ``lengths`` (length: count) with the greatest sum up to ``space``.

    A bitset holds the sums reached; counts are split into powers of two, and
    the longest lengths come first, as they are the hardest to place later.
    """
    mask, reach, steps = (1 << space + 1) - 1, 1, []
    for length in sorted((x for x in lengths if x <= space), reverse=True):
        left, k = min(lengths[length], space // length), 1
        while left:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= reach << k * length & mask
            left, k = left - k, 2 * k
        if reach >> space & 1:
            break
    rest, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> rest & 1:
            used[length] = used.get(length, 0) + k
            rest -= k * length
    return used


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """[(how many sequences, {length: uses in each})]: longest first, filled with least slack."""
    left = {length: n for length, n in histogram.items() if n > 0}
    if any(not 0 < x <= capacity for x in left):
        raise ValueError("a length is outside 1 to the capacity")
    plans = []
    while left:
        seed = max(left)
        others = left | {seed: left[seed] - 1}
        uses = fullest({x: n for x, n in others.items() if n}, capacity - seed)
        uses[seed] = uses.get(seed, 0) + 1
        times = min(left[x] // n for x, n in uses.items())
        plans.append((times, uses))
        for x, n in uses.items():
            left[x] -= times * n
            if not left[x]:
                del left[x]
    return plans


def _places(plans: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """By length: rows of first rank, first sequence, uses and first offset, in rank order."""
    found: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for times, uses in plans:
        offset = 0
        for length in sorted(uses, reverse=True):
            first = ranks.get(length, 0)
            found.setdefault(length, []).append((first, sequence, uses[length], offset))
            ranks[length] = first + times * uses[length]
            offset += length * uses[length]
        sequence += times
    return {k: np.array(v, np.int64) for k, v in found.items()}


def pack(spark: SparkSession, pieces: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with length, task and nth) and sequence_id and offset for each."""
    kept = scratch.save(pieces, "pieces")
    counts = scratch.save(kept.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    places = _places(plan_bins(histogram, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    ranked = kept.join(offsets.hint("merge"), ["task", "length"]).select(*kept.columns, (F.col("_first") + F.col("nth")).alias("_rank"))
    keep = [c for c in kept.columns if c not in ("task", "nth")]
    schema = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep) + ", sequence_id long, offset long"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                table = places[int(length)]
                row = table[np.searchsorted(table[:, 0], ranks[at], "right") - 1]
                nth = ranks[at] - row[:, 0]
                sequence[at] = row[:, 1] + nth // row[:, 2]
                offset[at] = row[:, 3] + nth % row[:, 2] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    return ranked.mapInArrow(deal, schema)


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of whole documents and their places in sequences of ``capacity`` tokens."""
    pieces = token_pieces(docs, tokenizer_path or default_tokenizer_path(), capacity, with_ids=with_ids)
    return pack(spark, pieces, Scratch(spark, "packing"), capacity)
