"""Language-model scores by context-tree weighting over bytes.

A text is its words (lower case A-Z, parted by white space), each followed by a blank, and one end byte. A byte's context
is the DEPTH bytes before it, across words, with end bytes before the text; bytes are eight binary decisions. At each node
(a context of 0 to DEPTH bytes and the bits so far) a Krichevsky-Trofimov estimate of the counts is mixed, half and half,
with the product of the longer contexts' mixtures; learnt from the training texts, that gives each byte a probability.

Texts are read once, into blocks. A block deals its different words and keys (a context and the byte after it), as arrays
with their counts, over parts by hash; a part adds up the blocks' counts, grows its subtrees once, and answers each block
with code lengths. The block then scores its texts. The arrays hold each key of a block once, as rows of (block, key)
would, and there are never more arrays than such rows; a part is a hash of the last SPLIT context bytes, so a group of
equal endings is bounded: 256 ** (DEPTH - SPLIT + 1) keys.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribolens.llm.bytetext import LOWER, SPACE, chunks, mix, spans, spans_hash
from ribolens.llm.shared import small_batches, written

DEPTH = 5
#: Contexts that end in the same SPLIT bytes are in one part. Of the levels above, at most 65,536 x 255 nodes are there, and
#: two numbers of each go to all tasks (some MB for text, 330 MB at the very most).
SPLIT = 3
#: Bytes of text in a block, and so about the work of a part: there are as many parts as blocks of this size.
BLOCK_BYTES = 16 << 20
#: Keys that are spread out into bits at a time, more only where they have one ending.
KEYS_AT_ONCE = 20_000
#: Table entries up to which numbers are ranked by a table, beyond by sorting.
TABLE = 1 << 25
#: Entries after which a block's parts of counts are merged.
MERGE_AT = 2 << 20
BLANK, END = 0x20, 0xFF  # 0xFF never occurs in UTF-8

#: kind 0: a text; 2, 3: what a block sends to a part of words, of keys; 4, 5: what comes back.
SENT = "block long, kind int, part int, doc_id long, held_out boolean, data binary, counts binary"
GROWN = "part int, keys binary, chance binary, nodes binary, sums binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0, by Stirling's series after moving x up to 10."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    up = x.copy()
    while (low := up < 10).any():
        shift[low] -= np.log(up[low])
        up[low] += 1
    r = 1 / up
    return shift + (up - 0.5) * np.log(up) - up + 0.5 * np.log(2 * np.pi) + r * (1 / 12 - r * r * (1 / 360 - r * r * (1 / 1260 - r * r * (1 / 1680 - r * r / 1188))))


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def plain_bytes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' words in lower case, each followed by one blank: bytes and row offsets."""
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(offsets))
    out, space = np.full(len(buf) + rows, BLANK, np.uint8), np.ones(len(buf) + rows, bool)
    at = np.arange(len(buf)) + row
    out[at], space[at] = LOWER[buf], SPACE[buf]
    begin = offsets[:-1] + np.arange(rows)
    after = np.ones(len(out), bool)  # follows white space, or begins a row
    after[1:] = space[:-1]
    after[begin] = True
    keep = ~(space & after)
    out[space] = BLANK
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], np.append(kept[begin], kept[-1])


def ranked(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each code's number among the different codes, and those in order; codes are under ``size``."""
    if size > TABLE:
        different, numbers = np.unique(codes, return_inverse=True)
        return numbers, different
    there = np.zeros(size, bool)
    there[codes] = True
    different = np.flatnonzero(there)
    number = np.zeros(size, np.int32)
    number[different] = np.arange(len(different), dtype=np.int32)
    return number[codes], different


def keyed(flat: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys (context << 8 | byte) of the rows' bytes and of an end byte after each; the number of each
    byte's key, row by row; and where each row begins."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    buf = np.full(len(flat) + rows * (depth + 1), END, np.uint8)
    buf[np.arange(len(flat)) + np.repeat(np.arange(rows), size) * (depth + 1) + depth] = flat
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    at = np.arange(begin[-1]) + np.repeat(np.arange(1, rows + 1) * depth, size + 1)
    symbols = np.flatnonzero(np.bincount(buf, minlength=256))
    code = np.zeros(256, np.int64)
    code[symbols] = np.arange(len(symbols))
    buf = code[buf]
    numbers, keys = ranked(buf[at], len(symbols))
    keys = symbols[keys].astype(np.int64)
    for back in range(1, depth + 1):
        numbers, different = ranked(numbers * np.int64(len(symbols)) + buf[at - back], len(keys) * len(symbols))
        keys = keys[different // len(symbols)] | (symbols[different % len(symbols)] << (8 * back))
    return keys, numbers, begin


def _bits(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the eight decisions of each key's byte: the bits before (with a leading one), and the bit."""
    byte = (keys & 0xFF)[:, None]
    j = np.arange(8)
    return (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1


def subtree(keys: np.ndarray, counts: np.ndarray, depth: int = DEPTH, split: int = SPLIT) -> tuple[np.ndarray, tuple]:
    """Of all keys whose contexts end in the same ``split`` bytes: each decision's probability by the mixture from depth
    ``split`` on, [keys, 8]; and the nodes of that depth: context, bits, zeros, ones, ln mixture."""
    prefix, bit = _bits(keys)
    context, bit = keys >> 8, bit.reshape(-1)
    weight = np.repeat(counts, 8).astype(float)
    chance = mixed = below = None
    for d in range(depth, split - 1, -1):
        code = ((context & ((1 << (8 * d)) - 1))[:, None] << 8) | prefix
        node, back = np.unique(code.reshape(-1), return_inverse=True)
        ones = np.bincount(back, weight * bit, len(node))
        zeros = np.bincount(back, weight, len(node)) - ones
        kt = log_kt(zeros, ones)
        one = (ones + 0.5) / (zeros + ones + 1)
        own = np.where(bit == 1, one[back], 1 - one[back])
        if below is None:
            mixed, chance = kt, own
        else:
            up = np.searchsorted(node, ((below >> 8) & ((1 << (8 * d)) - 1)) << 8 | (below & 0xFF))
            mixed = np.log(0.5) + np.logaddexp(kt, np.bincount(up, mixed, len(node)))
            share = np.exp(np.log(0.5) + kt - mixed)[back]
            chance = share * own + (1 - share) * chance
        below = node
    return chance.reshape(-1, 8), (below >> 8, below & 0xFF, zeros, ones, mixed)


def squeezed(x: np.ndarray) -> bytes:
    """An array's bytes, all first ones first, compressed."""
    return zlib.compress(np.ascontiguousarray(x.reshape(-1).view(np.uint8).reshape(x.size, x.itemsize).T).tobytes(), 1)


def unsqueezed(data: bytes, kind: str) -> np.ndarray:
    flat, size = np.frombuffer(zlib.decompress(data), np.uint8), np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, -1).T).reshape(-1).view(kind)


def endings(keys: np.ndarray) -> np.ndarray:
    return (keys >> 8) & ((1 << (8 * SPLIT)) - 1)


def by_part(keys: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part and the places of its keys."""
    order = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.diff(part[order])) + 1
    for places in np.split(order, edges) if len(order) else []:
        yield int(part[places[0]]), places


class Counts:
    """Keys with the sums of their counts, added piece by piece."""

    def __init__(self):
        self.pieces: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.pieces.append((keys, counts))
        self.size += len(keys)
        if self.size > MERGE_AT and len(self.pieces) > 1:
            self.pieces = [self.summed()]
            self.size = len(self.pieces[0][0]) // 2  # so that merging stays in proportion

    def summed(self) -> tuple[np.ndarray, np.ndarray]:
        keys, back = np.unique(np.concatenate([k for k, _ in self.pieces]), return_inverse=True)
        return keys, np.bincount(back, np.concatenate([c for _, c in self.pieces]), len(keys)).astype(np.int64)


def blocks_of(plain: DataFrame, parts: int) -> DataFrame:
    """Blocks of plain(doc_id, held_out, text): the texts, and what each block sends to the parts."""
    names = ["block", "kind", "part", "doc_id", "held_out", "data", "counts"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]

    def sent(block: int, kind: int, counts: Counts) -> Iterator[pa.RecordBatch]:
        keys, times = counts.summed()
        part = (mix(keys if kind == 2 else endings(keys).astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        for p, at in by_part(keys, part):
            row = block, kind, p, None, None, squeezed(keys[at].view("<i8")), squeezed(times[at].astype("<i8"))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, words, keys, held_bytes = TaskContext.get().partitionId() << 32, Counts(), Counts(), 0
        for batch in batches:
            held = batch.column(1).to_numpy(zero_copy_only=False)
            for low, high, buf, offsets in chunks(batch.column(2)):
                flat, offsets = plain_bytes(buf, offsets)
                rows, learnt = high - low, ~held[low:high]
                own, number, begin = keyed(flat, offsets)
                keys.add(own, np.bincount(number[np.repeat(learnt, np.diff(begin))], minlength=len(own)))
                starts, ends, row = spans(flat != BLANK, offsets)
                hashes, back = np.unique(spans_hash(flat, starts, ends), return_inverse=True)
                words.add(hashes, np.bincount(back[learnt[row]], minlength=len(hashes)))
                texts = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat.tobytes())])
                same = [pa.array(np.full(rows, block)), pa.array(np.zeros(rows, np.int32)), pa.nulls(rows, pa.int32())]
                yield pa.RecordBatch.from_arrays([*same, batch.column(0).slice(low, rows), batch.column(1).slice(low, rows), texts, pa.nulls(rows, pa.binary())], names)
                held_bytes += len(flat)
                if held_bytes >= BLOCK_BYTES:
                    yield from sent(block, 2, words)
                    yield from sent(block, 3, keys)
                    block, words, keys, held_bytes = block + 1, Counts(), Counts(), 0
        if words.pieces:
            yield from sent(block, 2, words)
            yield from sent(block, 3, keys)

    small_batches(plain.sparkSession)
    return plain.mapInArrow(gather, SENT)


ANSWER = "block long, kind int, data binary, counts binary, found long, tokens long"


def _columns(table: pa.Table) -> list[np.ndarray]:
    """The arrays of keys of a part's rows."""
    return [unsqueezed(x, "<i8") for x in table.column("data").to_pylist()]


def count_words(sent: DataFrame) -> DataFrame:
    """For each block and part the training counts of the words sent, over all blocks. On one row of a part, found and
    tokens: how many different words, and how many words, training has of the part."""

    def count(table: pa.Table) -> pa.Table:
        own = _columns(table)
        every, back = np.unique(np.concatenate(own), return_inverse=True)
        total = np.bincount(back, np.concatenate([unsqueezed(x, "<i8") for x in table.column("counts").to_pylist()]), len(every)).astype(np.int64)
        back = np.split(total[back], np.cumsum([len(x) for x in own])[:-1])
        rest = [0] * (len(own) - 1)
        kind = pa.array([4] * len(own), pa.int32())
        counts = pa.array([squeezed(x.astype("<i8")) for x in back], pa.binary())
        found, tokens = pa.array([int((total > 0).sum()), *rest], pa.int64()), pa.array([int(total.sum()), *rest], pa.int64())
        return pa.table({"block": table.column("block"), "kind": kind, "data": table.column("data"), "counts": counts, "found": found, "tokens": tokens})

    return sent.where("kind = 2").select("block", "part", "data", "counts").groupBy("part").applyInArrow(count, ANSWER)


def grow(sent: DataFrame) -> DataFrame:
    """The parts' keys with each decision's probability below depth SPLIT, [keys, 8], and the sums of zeros, ones and ln
    mixtures of the nodes above (context of SPLIT - 1 bytes << 8 | bits); rows of some ten thousand keys."""

    def grown(table: pa.Table) -> pa.Table:
        keys, back = np.unique(np.concatenate(_columns(table)), return_inverse=True)
        counts = np.bincount(back, np.concatenate([unsqueezed(x, "<i8") for x in table.column("counts").to_pylist()]), len(keys))
        last = endings(keys)
        order = np.argsort(last, kind="stable")
        edges = np.append(np.flatnonzero(np.diff(last[order])) + 1, len(order))
        out, low = [], 0
        while low < len(order):
            high = int(edges[min(np.searchsorted(edges, low + KEYS_AT_ONCE), len(edges) - 1)])
            rows = np.sort(order[low:high])
            chance, (context, bits, *sums) = subtree(keys[rows], counts[rows])
            node, up = np.unique((context & ((1 << (8 * (SPLIT - 1))) - 1)) << 8 | bits, return_inverse=True)
            sums = np.concatenate([np.bincount(up, x, len(node)) for x in sums])
            out.append((squeezed(keys[rows].astype("<i8")), chance.astype("<f4").tobytes(), node.astype("<i4").tobytes(), sums.astype("<f8").tobytes()))
            low = high
        part = pa.array([table.column("part")[0].as_py()] * len(out), pa.int32())
        return pa.table([part, *(pa.array(x, pa.binary()) for x in zip(*out, strict=True))], names=["part", "keys", "chance", "nodes", "sums"])

    return sent.where("kind = 3").select("part", "data", "counts").groupBy("part").applyInArrow(grown, GROWN)


def _mixed(nodes: DataFrame) -> DataFrame:
    """nodes(code, zeros, ones, below) with their ln mixture, chance of a one and share of the own estimate."""

    def mixing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            zeros, ones, below = (batch.column(n).to_numpy() for n in (1, 2, 3))
            kt = log_kt(zeros, ones)
            mixed = np.log(0.5) + np.logaddexp(kt, below)
            more = [pa.array(x) for x in (mixed, (ones + 0.5) / (zeros + ones + 1), np.exp(np.log(0.5) + kt - mixed))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *more], ["code", "zeros", "ones", "mixed", "one", "share"])

    return nodes.select("code", "zeros", "ones", "below").mapInArrow(mixing, "code int, zeros double, ones double, mixed double, one double, share double")


def top_levels(grown: DataFrame) -> pa.Table:
    """(code, one, rest) of the nodes of depth SPLIT - 1: the probability of a one by all levels down to theirs, and the weight
    that is left for the levels below."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nodes, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(nodes, "<i4")), *(pa.array(x) for x in np.frombuffer(sums, "<f8").reshape(3, -1))], ["code", "zeros", "ones", "below"])

    level = grown.select("nodes", "sums").mapInArrow(spread, "code int, zeros double, ones double, below double")
    levels = []
    for depth in range(SPLIT - 1, -1, -1):
        mask = (1 << (8 * (depth + 1))) - 1
        below = "below" if depth == SPLIT - 1 else "mixed"
        summed = level.groupBy(F.col("code").bitwiseAND(F.lit(mask)).cast("int").alias("code")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum(below).alias("below"))
        level = written(_mixed(summed), f"level-{depth}")
        levels.append(level)
    down = levels[-1].select(F.col("code").alias("up"), (F.col("one") * F.col("share")).alias("sure"), (1 - F.col("share")).alias("rest"))
    for depth, level in zip(range(1, SPLIT), levels[-2::-1], strict=True):
        met = level.join(down, level["code"].bitwiseAND(F.lit((1 << (8 * depth)) - 1)) == down["up"])
        down = met.select(level["code"].alias("up"), (F.col("sure") + F.col("rest") * level["share"] * level["one"]).alias("sure"), (F.col("rest") * (1 - level["share"])).alias("rest"))
    return down.orderBy("up").toArrow()


def code_lengths(keys: np.ndarray, chance: np.ndarray, top: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """ln probability of each key's byte, from the mixture below depth SPLIT and the levels above (codes, one, rest)."""
    prefix, bit = _bits(keys)
    at = np.searchsorted(top[0], (((keys >> 8) & ((1 << (8 * (SPLIT - 1))) - 1)) << 8)[:, None] | prefix)
    one, rest = top[1][at], top[2][at]
    return np.log(np.where(bit == 1, one, 1 - rest - one) + rest * chance).sum(axis=1)


def learn(sent: DataFrame) -> DataFrame:
    """For each block and part the ln probabilities of the keys sent, as 32-bit floats."""
    grown = written(grow(sent), "grown")
    top = top_levels(grown)
    shared = sent.sparkSession.sparkContext.broadcast(tuple(top.column(n).to_numpy() for n in range(3)))

    def measure(table: pa.Table) -> pa.Table:
        is_key = table.column("block").is_null().to_numpy()
        keys, lengths = [], []
        for i in np.flatnonzero(is_key):
            keys.append(unsqueezed(table.column("data")[int(i)].as_py(), "<i8"))
            lengths.append(code_lengths(keys[-1], np.frombuffer(table.column("chance")[int(i)].as_py(), "<f4").reshape(-1, 8), shared.value))
        keys, lengths = np.concatenate(keys), np.concatenate(lengths).astype("<f4")
        order = np.argsort(keys)
        keys, lengths = keys[order], lengths[order]
        own = table.filter(pa.array(~is_key))
        back = [squeezed(lengths[np.searchsorted(keys, unsqueezed(x, "<i8"))]) for x in own.column("data").to_pylist()]
        none = pa.array([0] * len(back), pa.int64())
        return pa.table({"block": own.column("block"), "kind": pa.array([5] * len(back), pa.int32()), "data": own.column("data"), "counts": pa.array(back, pa.binary()), "found": none, "tokens": none})

    asked = sent.where("kind = 3").select("part", "block", "data", F.lit(None).cast("binary").alias("chance"))
    known = grown.select("part", F.lit(None).cast("long").alias("block"), F.col("keys").alias("data"), "chance")
    return asked.unionAll(known).groupBy("part").applyInArrow(measure, ANSWER)


def context_tree_scores(docs: DataFrame, fold: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    The model learns from rows whose crc32(key as text) mod ``fold`` isn't 0; a null key counts as the empty text. score is
    the log10 probability of the text (words and end) under the tree, base_score under a word unigram model with 0.1
    added to each count; bits_per_byte is the tree's code length by the bytes of words, blanks and end. A null or empty
    text is its end alone. Repeated rows count and are scored each. Extra columns are left out. Words are told apart by
    64 bits of hash; keys are whole.
    """
    held = F.crc32(F.coalesce(docs[key].cast("string"), F.lit("")).cast("binary")) % fold == 0
    plain = docs.select(docs[key].cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    whole = plain.agg(F.sum(F.when(F.col("held_out"), 0).otherwise(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    ends, parts = whole["n"] or 0, max(12, -(-(whole["bytes"] or 0) // BLOCK_BYTES))
    sent = written(blocks_of(plain, parts), "blocks")
    counted = written(count_words(sent), "word-counts")
    total = counted.agg(F.sum("found").alias("found"), F.sum("tokens").alias("tokens")).first()
    distinct, trained = (total["found"] or 0) + (ends > 0), (total["tokens"] or 0) + ends

    def score(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        known = []
        for k, form in ((4, "<i8"), (5, "<f4")):
            own = table.filter(pa.array(kind == k))
            keys = np.concatenate([np.zeros(0, "<i8"), *_columns(own)]).view("<u8" if k == 4 else "<i8")
            found = np.concatenate([np.zeros(0, form), *(unsqueezed(x, form) for x in own.column("counts").to_pylist())])
            order = np.argsort(keys)
            known.append((keys[order], found[order].astype(float)))
        (words, times), (every, lengths) = known
        texts = table.filter(pa.array(kind == 0)).select(["doc_id", "held_out", "data"]).combine_chunks()
        base = np.log10((np.append(times, ends) + 0.1) / (trained + 0.1 * (distinct + 1)))
        out = []
        for low, high, flat, offsets in chunks(texts.column("data")):
            own, number, begin = keyed(flat, offsets)
            ln_p = np.add.reduceat(lengths[np.searchsorted(every, own)][number], begin[:-1])
            starts, ends_at, row = spans(flat != BLANK, offsets)
            word = np.searchsorted(words, spans_hash(flat, starts, ends_at))
            rows = high - low
            n = np.bincount(row, minlength=rows) + 1
            n_known = np.bincount(row, times[word] > 0, rows).astype(np.int64) + (ends > 0)
            scored = np.bincount(row, base[word], rows) + base[-1]
            out.append((n, n_known, np.full(rows, trained), scored, ln_p / np.log(10), -ln_p / np.log(2) / np.diff(begin)))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)]
        return pa.table([texts.column("doc_id"), texts.column("held_out"), *map(pa.array, columns)], names=[x.split()[0] for x in SCORES.split(", ")])

    own = sent.where("kind = 0").select("block", "kind", "doc_id", "held_out", "data", F.lit(None).cast("binary").alias("counts"))
    answers = counted.unionAll(learn(sent)).select("block", "kind", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), "data", "counts")
    return own.unionAll(answers).groupBy("block").applyInArrow(score, SCORES)


def op4_context_tree(spark, sf_dir: str) -> DataFrame:
    """All documents, learning from nine tenths."""
    return context_tree_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
