"""Cross-entropy difference of matched target and background n-gram models.

Both models are bigram models over one vocabulary, all words of all documents and of the target, with the
same smoothing. The background model counts all documents, the target model the target's. Background counts are
scaled to the target's number of words before smoothing, so the models differ in what they have read, not in how much.

Words are white-space-separated runs, ASCII capitals folded. A document is scored by models that have not read it: its own counts are
taken from the background's, and from the target's if its doc_id is one of the target's. Else membership, not likeness,
would show, and a document that occurs once would look as foreseen as one that occurs twice.

Counts are whole and grow with the corpus: no word or bigram is left out. They are exchanged between partitions:

1. Words are counted in a Spark table. The most frequent, HOT at most, are broadcast with their counts and numbers.
2. Each task turns its documents into blocks of about BLOCK words' numbers, which are written. Bigrams of the DENSE most
   frequent words are counted in a matrix for each task.
3. The other distinct bigrams and the rare words of a block go, with their number in the block, to the owners of ranges of
   the hash space, sorted and compressed. A block knows at most FAN ranges. Where there are more owners, what a lane of about FAN
   blocks sent to one range is added up and divided further, as often as needed; the answers come back the same way.
4. An owner adds up what all blocks sent, and answers each block with the totals in the order of its message.
5. Each block meets its answers and sums the losses of its documents.

So a bigram crosses the network once a block, however many documents of the block hold it, and a bigram in every block costs
its owner one entry a lane. Each task on the way holds about as many keys as a block has. The number of owners grows with the words, and
a hop's messages are at most FAN times the blocks, so they grow as the input does, and hops as its logarithm. A document is never divided, so a
block is as large as the longest document at least.

Bigrams of frequent words are known by both numbers, scrambled. Rare words and other bigrams are known by 63 and 64 bits of hash: of
m of them about m**2 / 2**65 share one with another.

p(w | u) = (c(u, w) + PRIOR * p(w)) / (c(u) + PRIOR), p(w) = (c(w) + 1) / (N + V), for V of the vocabulary and one word more.

A document's losses are in nats a word; difference is target less background loss, lower for
documents more like the target. Null, empty and blank texts have no words and losses of 0. Without any target
document both models are those of the background and differences are 0. Repeated rows and
equal or null doc_ids each give a row, scored without that row's own counts; an empty table gives none. Columns other than
doc_id and text are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents_of, fan_out, frequent, mixed, written

HOT = (1 << 16) - 1
DENSE = 1 << 10
#: Words of a block, about.
BLOCK = 1 << 19
#: Words of the corpus an owner, about.
OWNED = 1 << 20
#: Ranges that a block or lane divides its keys among, at most.
FAN = 1 << 10
#: Distinct words that a task counts before it passes them on, and words whose numbers it remembers.
HELD, MEMO = 250_000, 200_000
#: Cells of a piece of the matrix.
PIECE = 1 << 13
PRIOR = 50.0
#: The number of the mark of a text's start; its count is the number of texts.
START = 0


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_code(word: bytes) -> int:
    """A negative hash."""
    import xxhash

    return -1 - (xxhash.xxh3_64_intdigest(word) >> 1)


class Codes(dict):
    """Numbers of words: ranks from 1 of the frequent ones, negative hashes of the rest. Emptied when full."""

    def __init__(self, ranks: dict[int, int]):
        self.ranks = ranks

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        code = word_code(word)
        self[word] = found = self.ranks.get(code, code)
        return found


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 8-byte items, laid out by byte, so that equal leading bytes cost little."""
    import zstandard

    sizes = np.array([len(arrays), *map(len, arrays)], "<i8").tobytes()
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([sizes, *planes]))


def unpack(data: bytes) -> list[np.ndarray]:
    """The arrays, as signed integers."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    many = int.from_bytes(raw[:8], "little")
    at, out = 8 + 8 * many, []
    for n in np.frombuffer(raw, "<i8", many, 8).tolist():
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T).view(np.int64).ravel())
        at += 8 * n
    return out


@dataclass
class Model:
    """What tasks know of both models: counts of frequent words, and of bigrams of the most frequent ones."""

    hot: np.ndarray  # hashes of the frequent words, by rank from 1
    single: np.ndarray  # counts by number: of all documents, of the target
    n_all: int
    n_target: int
    size: int
    dense: int
    pairs: np.ndarray | None = None

    def codes(self) -> Codes:
        return Codes({h: k + 1 for k, h in enumerate(self.hot.tolist())})

    def is_dense(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        return (before >= 0) & (before < self.dense) & (after >= 0) & (after < self.dense)

    def log_p(self, pair: np.ndarray, before: np.ndarray, after: np.ndarray, n: np.ndarray) -> np.ndarray:
        """ln p(w | u) from counts of the bigram, of its two words, and of all words."""
        p = (after + 1) / (n + self.size)
        return np.log(pair + PRIOR * p) - np.log(before + PRIOR)

    def bits(self) -> tuple[int, int]:
        """Bits of the keys of both forms."""
        return 2 * max(1, len(self.hot).bit_length()), 64

    def keys(self, before: np.ndarray, after: np.ndarray, words: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """What owners are asked for, by form: bits of its keys, keys, and which bigrams, then words, they are of.

        Bigrams of the most frequent words, which the matrix has, and frequent words are of neither form.
        """
        hot = (before >= 0) & (after >= 0)
        wide, rare = np.flatnonzero(~hot), np.flatnonzero(words < 0)
        narrow = np.flatnonzero(hot & ~self.is_dense(before, after))
        bits = self.bits()[0] // 2
        scrambled = ((before[narrow] << bits) + after[narrow]).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) & np.uint64((1 << 2 * bits) - 1)
        hashed = mixed(mixed(before[wide].view(np.uint64)) + after[wide].view(np.uint64))
        return [(2 * bits, scrambled, narrow), (64, np.concatenate([hashed, mixed(~words[rare].view(np.uint64))]), np.concatenate([wide, len(before) + rare]))]


#: Kinds of rows: a block's document ids, words in order and distinct words; pieces of a task's matrix; keys for an owner; an owner's answer.
#: The numbers of keys and answers are those of narrow ones; wide ones follow.
TEXTS, MATRIX, KEYS, ANSWER = 0, 1, 2, 4
#: Blocks of the target have this bit.
TARGET = 1 << 61
ROWS = "kind int, block long, owner int, data binary"
_NAMES = ["kind", "block", "owner", "data"]
_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.binary()]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(_TYPES), _TYPES)], _NAMES)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of words and, as START, the number of texts; a word may come more than once."""
    held: Counter = Counter()
    texts = 0

    def out() -> pa.RecordBatch:
        made = pa.record_batch([pa.array([START, *map(word_code, held)], pa.int64()), pa.array([texts, *held.values()], pa.int64())], ["word", "n"])
        held.clear()
        return made

    for batch in batches:
        for text in batch.column("text").to_pylist():
            held.update(words_of(text))
            texts += 1
            if len(held) > HELD:
                yield out()
                texts = 0
    yield out()


def word_counts(docs: DataFrame, target: DataFrame) -> DataFrame:
    """word, n (in all documents), t (in the target) of each word and of START."""
    none = F.lit(0).cast("long")
    of = lambda df, n, t: df.select("text").mapInArrow(_count_words, "word long, n long").select("word", n.alias("n"), t.alias("t"))
    every = of(docs, F.col("n"), none).unionByName(of(target, none, F.col("n")))
    return written(every.groupBy("word").agg(F.sum("n").alias("n"), F.sum("t").alias("t")), "words", even=False)


def _blocks(batches: Iterator[pa.RecordBatch], codes: Codes, most: int) -> Iterator[tuple[np.ndarray, list]]:
    """The numbers of the words of some texts, each after START, and the texts' doc_ids."""
    held: list[int] = []
    docs: list[int | None] = []
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            held.append(START)
            held += map(codes.__getitem__, words_of(text))
            docs.append(doc_id)
            if len(held) >= most:
                yield np.array(held, np.int64), docs
                held, docs = [], []
    if docs:
        yield np.array(held, np.int64), docs


def _numbered(shared, target: bool, most: int):
    """Blocks of texts, and a matrix for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model = shared.value
        block = (TaskContext.get().partitionId() << 40) + (TARGET if target else 0)
        matrix = np.zeros(-(-(model.dense**2) // PIECE) * PIECE, np.int64)
        for x, docs in _blocks(batches, model.codes(), most):
            token = np.flatnonzero(x != START)
            before, after = x[token - 1], x[token]
            dense = model.is_dense(before, after)
            matrix += np.bincount(before[dense] * model.dense + after[dense], minlength=len(matrix))
            codes, local = np.unique(x, return_inverse=True)
            ids, given = np.array([d or 0 for d in docs], np.int64), np.array([d is not None for d in docs], np.int64)
            yield _rows([(TEXTS, block, 0, pack(ids, given, local, codes))])
            block += 1
        pieces = matrix.reshape(-1, PIECE)
        yield _rows([(MATRIX, block, k, pack(pieces[k])) for k in np.flatnonzero(pieces.any(axis=1)).tolist()])
        pa.default_memory_pool().release_unused()  # the worker stays for other stages

    return run


def _total(rows: pa.Table) -> pa.Table:
    total = sum(unpack(d)[0] for d in rows.column("data").to_pylist())
    return pa.Table.from_batches([_rows([(MATRIX, rows.column("block")[0].as_py(), rows.column("owner")[0].as_py(), pack(total))])])


def matrices(sent: DataFrame, size: int) -> np.ndarray:
    """Counts of the most frequent words' bigrams: of all documents, of the target. 256 tasks are added up at first."""
    out = np.zeros((2, -(-(size**2) // PIECE) * PIECE), np.int64)
    parts = sent.where(F.col("kind") == MATRIX)
    for bits in (48, 13):
        parts = parts.withColumn("block", F.shiftright("block", bits)).groupBy("block", "owner").applyInArrow(_total, ROWS)
    for r in parts.toLocalIterator():
        out[r.block, r.owner * PIECE : (r.owner + 1) * PIECE] = unpack(bytes(r.data))[0]
    return out[:, : size**2].reshape(2, size, size)


def _messages(shared, ranges: int):
    """The distinct bigrams and rare words of blocks, with their numbers there, for each owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
                _, _, x, codes = unpack(data)
                x = codes[x]
                token = np.flatnonzero(x != START)
                out = []
                for form, (bits, keys, _) in enumerate(model.keys(x[token - 1], x[token], x)):
                    keys, times = np.unique(keys, return_counts=True)
                    out += _keyed(KEYS + form, block, keys, bits, times, ranges)
                yield _rows(out)
        pa.default_memory_pool().release_unused()  # the worker stays for other stages

    return run


def _keyed(kind: int, block: int, keys: np.ndarray, bits: int, times: np.ndarray, owners: int) -> list[tuple]:
    """A row for each owner of some of the ascending keys: owners have even ranges of all keys of so many bits."""
    if not len(keys):
        return []
    first, last = (int(keys[k]) * owners >> bits for k in (0, -1))
    starts = np.array([-(-(k << bits) // owners) for k in range(first + 1, last + 1)], np.uint64)
    cuts = [0, *np.searchsorted(keys, starts).tolist(), len(keys)]
    return [(kind, block, k, pack(np.diff(keys[a:b], prepend=np.uint64(0)), times[a:b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]), first) if a < b]


def _received(rows: pa.Table, form: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """block, owner, keys and their numbers of each message of a form."""
    told = [(b, o, *unpack(d)) for k, b, o, d in zip(*(rows.column(c).to_pylist() for c in _NAMES)) if k == KEYS + form]
    return [(b, o, np.cumsum(gaps.view(np.uint64), dtype=np.uint64), times) for b, o, gaps, times in told]


def _added(bits: tuple[int, int], owners: int):
    """What the blocks of a lane sent to one range, added up, as the messages of one block to the owners in it."""

    def run(rows: pa.Table) -> pa.Table:
        out = []
        for form in (0, 1):
            mine = _received(rows, form)
            if mine:
                keys, at = np.unique(np.concatenate([k for _, _, k, _ in mine]), return_inverse=True)
                times = np.bincount(at, np.concatenate([t for *_, t in mine]), len(keys)).astype(np.int64)
                out += _keyed(KEYS + form, rows.column("lane")[0].as_py(), keys, bits[form], times, owners)
        return pa.Table.from_batches([_rows(out)])

    return run


def _passed_on(rows: pa.Table) -> pa.Table:
    """The answers to a lane, as answers to the messages of its blocks."""
    out = []
    for form in (0, 1):
        mine = _received(rows, form)
        if mine:
            told = sorted((o, d) for k, o, d in zip(*(rows.column(c).to_pylist() for c in ("kind", "owner", "data"))) if k == ANSWER + form)
            totals = np.concatenate([unpack(d) for _, d in told], axis=1)
            every = np.unique(np.concatenate([k for _, _, k, _ in mine]))
            out += [(ANSWER + form, b, o, pack(*totals[:, np.searchsorted(every, k)])) for b, o, k, _ in mine]
    return pa.Table.from_batches([_rows(out)])


def answered(sent: DataFrame, bits: tuple[int, int], each: int, hops: int, blocks: int, hop: int = 1) -> DataFrame:
    """The answers to the messages of so many blocks to each ** hop ranges, of each ** hops owners."""
    if hop == hops:
        return sent.groupBy("owner").applyInArrow(_answers, ROWS)
    lanes = -(-blocks // each)
    lane = F.pmod(F.xxhash64("block", F.lit(hop)), F.lit(lanes)) + F.when(F.col("block") >= TARGET, TARGET).otherwise(0)
    sent = written(sent, "messages", even=False).withColumn("lane", lane).withColumn("range", F.col("owner"))
    added = sent.groupBy("range", "lane").applyInArrow(_added(bits, each ** (hop + 1)), ROWS)
    told = answered(added, bits, each, hops, lanes, hop + 1).withColumn("lane", F.col("block")).withColumn("range", F.expr(f"owner div {each}").cast("int"))
    return sent.where(F.col("block") < TARGET).unionByName(told).groupBy("range", "lane").applyInArrow(_passed_on, ROWS)


def _answers(rows: pa.Table) -> pa.Table:
    """An owner's totals, of all documents and of the target, for each message of a block."""
    out = []
    for form in (0, 1):
        mine = _received(rows, form)
        if not mine:
            continue
        keys, at = np.unique(np.concatenate([k for _, _, k, _ in mine]), return_inverse=True)
        sizes = [len(k) for _, _, k, _ in mine]
        times, of_target = np.concatenate([t for *_, t in mine]), np.repeat([b >= TARGET for b, *_ in mine], sizes)
        totals = np.stack([np.bincount(at, times * (of_target == t), len(keys)).astype(np.int64) for t in (False, True)])
        ends = np.cumsum([0, *sizes])
        out += [(ANSWER + form, b, o, pack(*totals[:, at[ends[i] : ends[i + 1]]])) for i, (b, o, *_) in enumerate(mine) if b < TARGET]
    return pa.Table.from_batches([_rows(out)])


def _losses(shared):
    """The summed losses of a block's documents: as one outside the target, as one of it, and of the background."""

    def run(rows: pa.Table) -> pa.Table:
        model = shared.value
        got = sorted(zip(*(rows.column(c).to_pylist() for c in ("kind", "owner", "data"))), key=lambda r: r[:2])
        ids, given, x, codes = unpack(got[0][2])
        start = x == np.searchsorted(codes, START)
        doc = np.cumsum(start) - 1
        token = np.flatnonzero(~start)
        # distinct bigrams of the block and the counts of them and of its words
        pair, of = np.unique(x[token - 1] * len(codes) + x[token], return_inverse=True)
        u, w = codes[pair // len(codes)], codes[pair % len(codes)]
        totals = np.zeros((2, len(pair) + len(codes)))
        for form, (_, keys, which) in enumerate(model.keys(u, w, codes)):
            told = [unpack(d) for k, _, d in got if k == ANSWER + form]
            if told:
                totals[:, which] = np.concatenate(told, axis=1)[:, np.searchsorted(np.unique(keys), keys)]
        of_pair, of_word = totals[:, : len(pair)], totals[:, len(pair) :]
        dense, hot = model.is_dense(u, w), codes >= 0
        of_pair[:, dense] = model.pairs[:, u[dense], w[dense]]
        of_word[:, hot] = model.single[:, codes[hot]]
        # distinct words and bigrams of each document, and how often it holds them itself
        _, held, own = np.unique(doc * len(codes) + x, return_inverse=True, return_counts=True)
        _, first, times = np.unique(doc[token] * max(1, len(pair)) + of, return_index=True, return_counts=True)
        own, at, d = own[held], token[first], doc[token[first]]
        size = np.bincount(doc[token], minlength=len(ids))
        mine = (times, own[at - 1], own[at], size[d])
        of_all = (of_pair[0][of[first]], of_word[0][x[at - 1]], of_word[0][x[at]], model.n_all)
        of_target = (of_pair[1][of[first]], of_word[1][x[at - 1]], of_word[1][x[at]], model.n_target)
        share = model.n_target / max(1, model.n_all) if model.n_target else 1.0
        less = lambda counts: [np.maximum(0, c - own) for c, own in zip(counts, mine)]
        background = model.log_p(*(c * share for c in less(of_all)))
        outside = model.log_p(*of_target) if model.n_target else background
        inside = model.log_p(*less(of_target)) if model.n_target else background
        sums = [pa.array(np.bincount(d, -times * p, len(ids))) for p in (outside, inside, background)]
        return pa.table([pa.array(ids, mask=given == 0), pa.array(size), *sums], ["doc_id", "n_words", "outside", "inside", "background"])

    return run


def cross_entropy_difference(documents: DataFrame, target: DataFrame, hot: int = HOT, dense: int = DENSE, block: int = BLOCK, owned: int = OWNED, fan: int = FAN) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss, difference of each document.

    target: texts of the target in a column text. Those that are documents of the corpus bear their doc_id.
    """
    docs = documents_of(documents)
    of_corpus: Column = F.col("doc_id").cast("long") if "doc_id" in target.columns else F.lit(None).cast("long")
    wanted = written(target.select(of_corpus.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "target")
    context = docs.sparkSession.sparkContext
    counted = word_counts(docs, wanted)
    every = counted.where(F.col("word") == START).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    words = counted.where(F.col("word") != START)
    size, n, t = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    top = sorted((-r.n, r.word, r.t) for r in frequent(words.where("n > 0"), hot).toLocalIterator())
    single = np.array([(every.n, every.t), *((-m, u) for m, _, u in top)], np.int64).T
    model = Model(np.array([w for _, w, _ in top], np.int64), single, n, t, size + 1, min(dense, len(top) + 1))
    owners, hops = fan_out(max(1, n // owned), fan)
    each = round(owners ** (1 / hops))
    shared = context.broadcast(model)
    numbered = docs.mapInArrow(_numbered(shared, False, block), ROWS).unionByName(wanted.mapInArrow(_numbered(shared, True, block), ROWS))
    numbered = written(numbered, "blocks", even=False)
    texts = numbered.where(F.col("kind") == TEXTS)
    sent = texts.select("block", "data").mapInArrow(_messages(shared, each), ROWS)
    answers = answered(sent, model.bits(), each, hops, texts.count() if hops > 1 else 1)
    model.pairs = matrices(numbered, model.dense)
    shared = context.broadcast(model)
    blocks = texts.where(F.col("block") < TARGET).unionByName(answers)
    sums = blocks.groupBy("block").applyInArrow(_losses(shared), "doc_id long, n_words long, outside double, inside double, background double")
    members = wanted.where("doc_id is not null").select("doc_id", F.lit(True).alias("member")).distinct()
    a_word = lambda c: F.when(F.col("n_words") > 0, c / F.col("n_words")).otherwise(0.0)
    loss = F.when(F.col("member"), F.col("inside")).otherwise(F.col("outside"))
    found = sums.join(members, "doc_id", "left").select("doc_id", "n_words", a_word(loss).alias("target_loss"), a_word(F.col("background")).alias("background_loss"))
    return found.withColumn("difference", F.col("target_loss") - F.col("background_loss"))
