"""Language-model scoring with a weighted backoff automaton.

The model is an n-gram model with Dirichlet smoothing: after history h,
    P(w | h) = (c(h, w) + mu * P(w | shorter h)) / (c(h) + mu),
down to the add-one unigram (c(w) + 1) / (N + V + 1). As an automaton, each history seen in training is a state; it has an
arc for each word seen after it and a failure arc, weighing mu / (c(h) + mu), to the state of the history without its first
word; the empty history takes every word. Texts are traversed left to right; a traversal carries its state and adds up log10
weights. A long text is walked in segments at the same time: a segment begins order - 1 tokens earlier in the empty state,
and after them is in the state in which the whole walk would be, since a state is the longest trained history of so many words.

No task or driver holds the whole model. Texts are dealt into blocks as they are read, a block being one row that holds an
Arrow batch, written once; a block sends each distinct n-gram once with its training count; each n-gram's owner adds the counts
up and answers only blocks whose own count isn't the total; a block then builds the part of the automaton that its texts can
reach. Blocks and owners both follow the input, and what a block sends depends on its n-grams and not on how many owners
there are. No key deals the texts, so no text or id, however often it stands there, gathers in one task.

Words are told apart by 63 bits of hash. Longer n-grams are told apart by the bits that name their owner and WITHIN bits
besides, so as many n-grams of an owner are taken for one another whatever the input: less than one in a million.

Defined results: a null or empty text has one token, its end. A null id counts as not held out (it trains). Repeated rows
count as often as they stand there and score alike. No training tokens: N = V = 0 and each token has P = 1. Extra columns
are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import UPPER, batches_of, bound_batches, combine, joined, materialize, span_hashes, word_bounds

#: Fixed stand-ins for the hashes of a text's end and beginning.
END, START = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
#: Bytes of text in a block, and for each owner.
BLOCK_BYTES, OWNER_BYTES = 3 << 20, 4 << 20
#: Bits that tell an owner's n-grams of two and more words apart.
WITHIN = 40
#: Tokens that one walk takes of a long text.
SEGMENT = 256
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_CHUNK = 2 << 20


def token_stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts, each text's end among them, and where each text begins in them (and the end)."""
    streams, counts = [], []
    for first, last in batches_of(texts, _CHUNK):
        data, at = joined([t.translate(_LOWER) for t in texts[first:last]])
        starts, ends = word_bounds(data)
        upto = np.searchsorted(starts, at)
        words = span_hashes(data, starts, ends)
        streams.append(np.insert(words, upto[1:], END))
        counts.append(np.diff(upto) + 1)
    at = np.zeros(len(texts) + 1, np.int64)
    if counts:
        np.cumsum(np.concatenate(counts), out=at[1:])
    return (np.concatenate(streams) if streams else np.zeros(0, np.uint64)), at


def grams_of(tokens: np.ndarray, at: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 to order, the hash of the n-gram that ends at each token; histories are padded with START."""
    grams = [tokens]
    first = np.zeros(len(tokens), bool)
    first[at[:-1]] = True
    for _ in range(1, order):
        # the history of a token is the shorter n-gram at the token before it; at a text's beginning, of STARTs only
        before = np.empty_like(tokens)
        before[1:] = grams[-1][:-1]
        pad = START
        for _ in range(len(grams) - 1):
            pad = combine(np.array([pad]), np.array([START]))[0]
        before[first] = pad
        grams.append(combine(before, tokens))
    return grams


class Traversal:
    """An automaton in arrays, walked by many texts in step: arcs sorted by (state, word), and one failure arc a state."""

    def __init__(self, vocabulary: np.ndarray, base: np.ndarray, arcs: list[tuple], fail: np.ndarray, fail_weight: np.ndarray, start: int):
        self.n_words, self.base, self.fail, self.fail_weight, self.start = len(vocabulary), base, fail, fail_weight, start
        state, word, weight, target = (np.concatenate(x) if len(x) else np.zeros(0, np.int64) for x in zip(*arcs, strict=True))
        key = state.astype(np.int64) * self.n_words + word
        order = np.argsort(key, kind="stable")
        self.key, self.weight, self.target = key[order], weight[order], target[order].astype(np.int64)

    def step(self, state: np.ndarray, word: np.ndarray, unigram_state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Follow failure arcs until the word has an arc; gives the log10 weight and the state after."""
        total, after = np.zeros(len(state)), np.zeros(len(state), np.int64)
        left = np.arange(len(state))
        while len(left):
            empty = state[left] == 0
            done = left[empty]
            total[done] += self.base[word[done]]
            after[done] = unigram_state[word[done]]
            left = left[~empty]
            if not len(left):
                break
            key = state[left] * self.n_words + word[left]
            where = np.searchsorted(self.key, key)
            found = self.key[np.minimum(where, len(self.key) - 1)] == key if len(self.key) else np.zeros(len(left), bool)
            hit = left[found]
            total[hit] += self.weight[where[found]]
            after[hit] = self.target[where[found]]
            left = left[~found]
            total[left] += self.fail_weight[state[left]]
            state[left] = self.fail[state[left]]
        return total, after


def build(total: int, at: np.ndarray, uniques: list[np.ndarray], inverse: list[np.ndarray], counts: list[np.ndarray], n_texts: int, n_tokens: int, n_types: int, mu: float) -> tuple[Traversal, np.ndarray]:
    """The part of the automaton that these texts can reach, and the state after each word seen alone."""
    order = len(uniques)
    base = np.log10((counts[0] + 1.0) / (n_tokens + n_types + 1.0)) if n_tokens else np.zeros(len(uniques[0]))
    first = np.zeros(total, bool)
    first[at[:-1]] = True
    # one occurrence of each distinct n-gram tells its word, its history and its suffix
    some = []
    for n in range(order):
        at_one = np.zeros(len(uniques[n]), np.int64)
        at_one[inverse[n]] = np.arange(total)
        some.append(at_one)
    # states: 0 empty; then START histories of 1 to order-1; then trained n-grams for n < order
    n_pads = order - 1 if n_texts else 0
    state_of, fail, fail_weight, used = [], [np.zeros(1 + n_pads, np.int64)], [np.zeros(1 + n_pads)], 1 + n_pads
    for k in range(1, n_pads + 1):
        fail[0][k], fail_weight[0][k] = k - 1, math.log10(mu / (n_texts + mu))
    for n in range(order - 1):
        own = np.zeros(len(uniques[n]), np.int64)
        seen = counts[n] > 0
        own[seen] = used + np.arange(int(seen.sum()))
        state_of.append(own)
        used += int(seen.sum())
        shorter = state_of[n - 1][inverse[n - 1][some[n][seen]]] if n else np.zeros(int(seen.sum()), np.int64)
        fail.append(shorter)
        fail_weight.append(np.log10(mu / (counts[n][seen] + mu)))
    arcs, p = [], 10.0**base
    for n in range(1, order):
        where = some[n]
        word = inverse[0][where]
        begins = first[where]
        before = np.maximum(where - 1, 0)
        history_count = np.where(begins, n_texts, counts[n - 1][inverse[n - 1][before]])
        history = np.where(begins, min(n, n_pads), state_of[n - 1][inverse[n - 1][before]])
        p = (counts[n] + mu * p[inverse[n - 1][where]]) / (history_count + mu)
        seen = counts[n] > 0
        # after the longest arcs the state is the n-gram without its first word, which is as long as histories get
        target = (state_of[n] if n < order - 1 else state_of[n - 1][inverse[n - 1][where]])[seen]
        arcs.append((history[seen], word[seen], np.log10(p[seen]), target))
    alone = state_of[0] if order > 1 else np.zeros(len(uniques[0]), np.int64)
    return Traversal(uniques[0], base, arcs or [(np.zeros(0, np.int64),) * 4], np.concatenate(fail), np.concatenate(fail_weight), n_pads), alone


def traverse(automaton: Traversal, words: np.ndarray, at: np.ndarray, alone: np.ndarray, order: int) -> np.ndarray:
    """log10 probability of each text: all segments of all texts take their k-th token together, longest first in the arrays."""
    per = -(-np.diff(at) // SEGMENT)
    text = np.repeat(np.arange(len(per)), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    warm = np.where(nth > 0, order - 1, 0)
    begin = at[:-1][text] + nth * SEGMENT - warm
    length = np.minimum(at[1:][text], at[:-1][text] + (nth + 1) * SEGMENT) - begin
    longest = np.argsort(-length, kind="stable")
    begin, length, warm = begin[longest], length[longest], warm[longest]
    score, state = np.zeros(len(text)), np.where(warm > 0, 0, automaton.start)
    running = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), side="left")
    for k, n in enumerate(running):
        weight, state[:n] = automaton.step(state[:n].copy(), words[begin[:n] + k], alone)
        score[:n] += weight if k >= order - 1 else np.where(warm[:n] > k, 0.0, weight)
    return np.bincount(text[longest], score, len(per))


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """An Arrow array whose k-th value has the next sizes[k] bytes of data."""
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])


def _bytes(values: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow array, and the size of each value."""
    data = b"".join(values.to_pylist())
    return np.frombuffer(data, np.uint8), np.fromiter(map(len, values.to_pylist()), np.int64, len(values))


def _pack_numbers(numbers: np.ndarray, sizes: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Runs of so many numbers, a byte for each; those from 255 on stand besides in 8 bytes each."""
    large = numbers >= 255
    runs = np.repeat(np.arange(len(sizes)), sizes)
    return _binary(np.minimum(numbers, 255).astype(np.uint8), sizes), _binary(numbers[large].astype("<u8").view(np.uint8), 8 * np.bincount(runs[large], minlength=len(sizes)))


def _unpack_numbers(small: pa.Array, large: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all runs, and how many each has."""
    data, sizes = _bytes(small)
    numbers = data.astype(np.int64)
    numbers[numbers == 255] = _bytes(large)[0].view("<u8").astype(np.int64)
    return numbers, sizes


def _pack_keys(keys: np.ndarray, starts: np.ndarray, begins: np.ndarray):
    """For each width in bytes: the runs that need it, and their sorted keys as differences (the first from the run's begin)."""
    sizes = np.diff(np.append(starts, len(keys)))
    steps = np.diff(keys, prepend=np.uint64(0))
    steps[starts] = keys[starts] - begins
    most = np.maximum.reduceat(steps, starts)
    width = 1 + (most[:, None] >> (np.uint64(8) * np.arange(1, 8, dtype=np.uint64)) > 0).sum(axis=1)
    for w in np.unique(width):
        runs = np.flatnonzero(width == w)
        own = steps if len(runs) == len(starts) else steps[np.repeat(width == w, sizes)]
        yield int(w), runs, _binary(np.ascontiguousarray(own.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w]).reshape(-1), w * sizes[runs])


def _unpack_keys(packed: pa.Array, width: int, begin: np.uint64) -> np.ndarray:
    """The keys of runs that _pack_keys wrote in this width and that have one begin."""
    data, sizes = _bytes(packed)
    steps = np.zeros((len(data) // width, 8), np.uint8)
    steps[:, :width] = data.reshape(-1, width)
    upto = np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64)
    ends = np.cumsum(sizes // width)
    before = np.concatenate((np.zeros(1, np.uint64), upto[ends[:-1] - 1])) if len(ends) else np.zeros(0, np.uint64)
    return upto - np.repeat(before, sizes // width) + begin


def _key_bits(order: int, owner_bits: int) -> list[int]:
    """How many leading bits of a hash tell n-grams of 1, 2, ... words apart."""
    return [63, *[min(63, owner_bits + WITHIN)] * (order - 1)]


def _asked(keys: np.ndarray, trains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each stands in training texts."""
    marked = np.sort(keys << np.uint64(1) | trains)
    sorted_keys = marked >> np.uint64(1)
    first = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    return sorted_keys[first], np.add.reduceat((marked & np.uint64(1)).astype(np.int64), first)


def ask(block: int, texts: list[bytes], trains: np.ndarray, order: int, owner_bits: int):
    """What a block sends: record batches of (part, block, n, width, grams, small, large), a row for each owner and n."""
    tokens, at = token_stream(texts)
    mine = np.repeat(trains, np.diff(at)).astype(np.uint64)
    for n, (gram, bits) in enumerate(zip(grams_of(tokens, at, order), _key_bits(order, owner_bits), strict=True)):
        keys, counts = _asked(gram >> np.uint64(64 - bits), mine)
        part = keys >> np.uint64(bits - owner_bits)
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        owners = part[starts]
        sizes = np.diff(np.append(starts, len(keys)))
        for width, runs, packed in _pack_keys(keys, starts, owners << np.uint64(bits - owner_bits)):
            chosen = np.zeros(len(starts), bool)
            chosen[runs] = True
            small, large = _pack_numbers(counts[np.repeat(chosen, sizes)], sizes[runs])
            fixed = [pa.array(np.full(len(runs), v, t)) for v, t in ((block, np.int64), (n, np.int32), (width, np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(owners[runs].astype(np.int64)), *fixed, packed, small, large], ["part", "block", "n", "width", "grams", "small", "large"])


ASKED = "part long, block long, n int, width int, grams binary, small binary, large binary"
ANSWERED = "block long, part long, n int, small binary, large binary, types long, tokens long"


def own(table: pa.Table, order: int, owner_bits: int) -> pa.Table:
    """Totals of an owner's n-grams; for each block a number for each of its n-grams: 0 where the total is its own count.

    A row of block -1 has the owner's number of words and of training tokens.
    """
    out = []
    part = table.column("part")[0].as_py()
    names = [x.split()[0] for x in ANSWERED.split(", ")]
    number, wide = table.column("n").to_numpy(), table.column("width").to_numpy()
    for n, bits in enumerate(_key_bits(order, owner_bits)):
        keys, counts, sizes, blocks = [], [], [], []
        for width in np.unique(wide[number == n]):
            same = table.filter(pa.array((number == n) & (wide == width)))
            keys.append(_unpack_keys(same.column("grams"), int(width), np.uint64(part) << np.uint64(bits - owner_bits)))
            count, size = _unpack_numbers(same.column("small"), same.column("large"))
            counts.append(count)
            sizes.append(size)
            blocks.append(same.column("block").to_numpy())
        if not keys:
            continue
        keys, counts, sizes, blocks = map(np.concatenate, (keys, counts, sizes, blocks))
        found, inverse = np.unique(keys, return_inverse=True)
        total = np.bincount(inverse, counts, len(found)).astype(np.int64)
        if n == 0:
            out.append(pa.Table.from_arrays([pa.array([v], t) for v, t in ((-1, pa.int64()), (part, pa.int64()), (0, pa.int32()), (b"", pa.binary()), (b"", pa.binary()), (int((total > 0).sum()), pa.int64()), (int(total.sum()), pa.int64()))], names))
        told = np.where(total[inverse] != counts, total[inverse], 0)
        some = np.add.reduceat((told > 0).astype(np.int64), np.cumsum(sizes) - sizes) > 0
        rows = int(some.sum())
        small, large = _pack_numbers(told[np.repeat(some, sizes)], sizes[some])
        out.append(pa.Table.from_arrays([pa.array(blocks[some]), pa.array(np.full(rows, part, np.int64)), pa.array(np.full(rows, n, np.int32)), small, large, *[pa.array(np.zeros(rows, np.int64))] * 2], names))
    return pa.concat_tables(out)


def walk(texts: list[bytes], trains: np.ndarray, answered: pa.Table, order: int, owner_bits: int, n_texts: int, n_tokens: int, n_types: int, mu: float) -> dict[str, np.ndarray]:
    """n_tokens, n_known, base_score and score of a block's texts, from the answers to what it asked."""
    tokens, at = token_stream(texts)
    grams = grams_of(tokens, at, order)
    mine = np.repeat(trains, np.diff(at))
    uniques, inverses, counts = [], [], []
    number = answered.column("n").to_numpy()
    for n, bits in enumerate(_key_bits(order, owner_bits)):
        unique, inverse = np.unique(grams.pop(0) >> np.uint64(64 - bits), return_inverse=True)
        inverse = inverse.astype(np.int32)  # a block has far fewer n-grams
        count = np.bincount(inverse[mine], minlength=len(unique))
        told = answered.filter(pa.array(number == n))
        totals, sizes = _unpack_numbers(told.column("small"), told.column("large"))
        begin = np.searchsorted(unique, told.column("part").to_numpy().astype(np.uint64) << np.uint64(bits - owner_bits))
        where = np.arange(len(totals)) - np.repeat(np.cumsum(sizes) - sizes - begin, sizes)
        count[where] = np.where(totals > 0, totals, count[where])
        uniques.append(unique)
        inverses.append(inverse)
        counts.append(count)
    automaton, alone = build(len(tokens), at, uniques, inverses, counts, n_texts, n_tokens, n_types, mu)
    known = np.add.reduceat((counts[0] > 0)[inverses[0]].astype(np.int64), at[:-1])
    base = np.add.reduceat(automaton.base[inverses[0]], at[:-1])
    return {"n_tokens": np.diff(at), "n_known": known, "base_score": base, "score": traverse(automaton, inverses[0], at, alone, order)}


def _packed(batches: list[pa.RecordBatch], block: int) -> pa.RecordBatch:
    """One row for a block: its number, training texts, bytes, and the rows (id, held, text) as a compressed Arrow stream."""
    table = pa.Table.from_batches(batches)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.combine_chunks())
    trains = table.num_rows - int(np.count_nonzero(table.column("held").to_numpy()))
    return pa.record_batch({"block": pa.array([block], pa.int64()), "trains": pa.array([trains], pa.int64()), "bytes": pa.array([sum(c.nbytes for c in batches)], pa.int64()), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def blocks_of(rows: DataFrame) -> DataFrame:
    """rows (id, held, text) in blocks of about BLOCK_BYTES, written once, so that a block stays what it is."""

    def gather(batches):
        first = TaskContext.get().partitionId() << 32
        kept, size = [], 0
        for batch in batches:
            if kept and size + batch.nbytes > BLOCK_BYTES:
                yield _packed(kept, first)
                first, kept, size = first + 1, [], 0
            if batch.num_rows:
                kept.append(batch)
                size += batch.nbytes
        if kept:
            yield _packed(kept, first)

    return materialize(rows.mapInArrow(gather, "block long, trains long, bytes long, rows binary"), "lm-blocks")


def _opened(rows: bytes) -> tuple[pa.Table, list[bytes], np.ndarray]:
    table = pa.ipc.open_stream(rows).read_all()
    return table.select(["id", "held"]), table.column("text").to_pylist(), ~table.column("held").to_numpy()


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held_out: int = 2, order: int = 3, mu: float = 50.0) -> DataFrame:
    """One row for each row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_types.

    Rows whose crc32(id as text) mod `modulus` is not `held_out` train the model; all are scored.
    """
    bound_batches(docs.sparkSession)
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus)) == held_out, F.lit(False))
    blocks = blocks_of(docs.select(F.col(id_col).alias("id"), held.alias("held"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")))
    size = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b"), F.coalesce(F.sum("trains"), F.lit(0)).alias("n")).first()
    n_texts, owner_bits = size.n, max(6, math.ceil(math.log2(1 + size.b / OWNER_BYTES)))

    def send(batches):
        for batch in batches:
            for block, rows in zip(batch.column("block").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                yield from ask(block, *_opened(rows)[1:], order, owner_bits)

    asked = blocks.select("block", "rows").mapInArrow(send, ASKED)
    answers = materialize(asked.groupBy("part").applyInArrow(lambda table: own(table, order, owner_bits), ANSWERED), "lm-answers")
    sums = answers.where("block = -1").agg(F.coalesce(F.sum("types"), F.lit(0)).alias("v"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()
    n_types, n_tokens = sums.v, sums.n
    schema = docs.select(id_col).schema.add("held_out", "boolean")
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double"), ("n_types", "long")):
        schema = schema.add(name, kind)

    def read(block: pa.Table, answered: pa.Table) -> pa.Table:
        table, texts, trains = _opened(block.column("rows")[0].as_py())
        found = walk(texts, trains, answered, order, owner_bits, n_texts, n_tokens, n_types, mu)
        columns = [table.column("id"), table.column("held"), *[pa.array(found[x]) for x in ("n_tokens", "n_known")], pa.array(np.full(len(texts), n_tokens)), pa.array(found["base_score"]), pa.array(found["score"]), pa.array(np.full(len(texts), n_types))]
        return pa.Table.from_arrays(columns, schema.names)

    told = answers.where("block >= 0").select("block", "n", "part", "small", "large")
    return blocks.select("block", "rows").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(read, schema)
