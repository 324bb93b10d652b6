"""SentencePiece encoding and decoding by a Viterbi search that shares the scores of common prefixes.

Texts are cut into marked words (blanks and the word after them; a line feed is a word of its own), which no piece of the
vocabulary crosses. The distinct words of a task, sorted, form a trie; going through it depth first, each word starts from
the forward scores at the prefix that it shares with the word before. Scores are the vocabulary's piece scores. A character
that no piece covers costs the lowest score less UNKNOWN_PENALTY and is written as its UTF-8 byte pieces. Among equal scores
the shorter last piece wins. A blank goes before each text that isn't empty, and decoding takes it away again, so
decode(encode(text)) is the text, whatever it contains.

Defined results: a null text has null ids and stays null, an empty text has no ids and is '' again. Rows are independent.
Extra columns pass through `encode` untouched; ids and n_ids are replaced.
"""

from __future__ import annotations

import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm.common import bound_batches

UNKNOWN_PENALTY = 10.0
MARK = "▁"
_WORDS = re.compile(r" +[^ \n]*|[^ \n]+|\n")
#: Words kept per task, and characters of text taken together.
_CACHE_WORDS, _CHUNK = 250_000, 1 << 20
#: Characters from which on a word is searched by itself: eight bytes a character are kept of it, and no scores to share.
LONG_WORD = 2000


def load_vocabulary(model_path: str) -> dict:
    """Pieces, their scores and the byte pieces of a SentencePiece model file; no bigger than that file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    n = sp.get_piece_size()
    ids, scores, spelled, byte_ids = {}, {}, [b""] * n, [0] * 256
    for k in range(n):
        piece = sp.id_to_piece(k)
        if sp.is_byte(k):
            byte_ids[int(piece[3:5], 16)] = k
            spelled[k] = bytes([int(piece[3:5], 16)])
        elif not (sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)):
            piece = piece.replace(MARK, " ")
            ids[piece], scores[piece], spelled[k] = k, sp.get_score(k), piece.encode()
    crossing = [p for p in ids if re.search(r"[^ ] |\n", p)]
    if crossing:
        raise ValueError(f"pieces cross marked words: {crossing[:3]}")
    return {"ids": ids, "scores": scores, "spelled": spelled, "bytes": byte_ids, "unknown": min(scores.values(), default=0.0) - UNKNOWN_PENALTY}


def piece_trie(vocabulary: dict) -> dict:
    """The pieces as nested nodes: character -> (score or None, id or None, children or None)."""
    root: dict = {}
    for piece in sorted(vocabulary["ids"]):
        kids = root
        for char in piece[:-1]:
            node = kids.setdefault(char, [None, None, None])
            if node[2] is None:
                node[2] = {}
            kids = node[2]
        node = kids.setdefault(piece[-1], [None, None, None])
        node[0], node[1] = vocabulary["scores"][piece], vocabulary["ids"][piece]
    return root


def encode_words(words: list[str], vocabulary: dict, trie: dict) -> dict[str, list[int]]:
    """Ids of each distinct word: a depth-first walk of the words' trie.

    Each depth of the current path keeps its forward score, its best last piece, and the pieces still open there (their
    start's score, their start, and the children reached in the vocabulary's trie), newest first.
    """
    byte_ids, unknown, out = vocabulary["bytes"], vocabulary["unknown"], {}
    best, back, opened = [0.0], [(0, None)], [()]
    path, root_of = "", trie.get
    for word in sorted(words):
        if len(word) > LONG_WORD:
            out[word] = _encode_long(word, vocabulary, trie)
            continue
        shared, most = 0, min(len(path), len(word))
        while shared < most and path[shared] == word[shared]:
            shared += 1
        del best[shared + 1 :], back[shared + 1 :], opened[shared + 1 :]
        path = word
        depth = shared
        for char in word[shared:]:
            before, node, still = best[depth], root_of(char), []
            top, last = before + unknown, (depth, None)
            if node is not None:
                score, k, kids = node
                if score is not None:
                    top, last = before + score, (depth, k)
                if kids is not None:
                    still.append((before, depth, kids))
            for begun, start, kids in opened[depth]:
                node = kids.get(char)
                if node is not None:
                    score, k, kids = node
                    if score is not None and begun + score > top:
                        top, last = begun + score, (start, k)
                    if kids is not None:
                        still.append((begun, start, kids))
            best.append(top)
            back.append(last)
            opened.append(still)
            depth += 1
        pieces = []
        while depth:
            start, k = back[depth]
            if k is None:
                pieces.extend(byte_ids[b] for b in reversed(word[start:depth].encode("utf-8", "surrogatepass")))
            else:
                pieces.append(k)
            depth = start
        pieces.reverse()
        out[word] = pieces
    return out


def _encode_long(word: str, vocabulary: dict, trie: dict) -> list[int]:
    """The same search over one word; scores are let go as soon as no open piece begins there."""
    byte_ids, unknown, root_of = vocabulary["bytes"], vocabulary["unknown"], trie.get
    starts, chosen = array("i", [0]), array("i", [-1])
    best, opened = 0.0, []
    for depth, char in enumerate(word):
        node, still = root_of(char), []
        top, start, last = best + unknown, depth, -1
        if node is not None:
            score, k, kids = node
            if score is not None:
                top, last = best + score, k
            if kids is not None:
                still.append((best, depth, kids))
        for begun, at, kids in opened:
            node = kids.get(char)
            if node is not None:
                score, k, kids = node
                if score is not None and begun + score > top:
                    top, start, last = begun + score, at, k
                if kids is not None:
                    still.append((begun, at, kids))
        starts.append(start)
        chosen.append(last)
        best, opened = top, still
    pieces, depth = [], len(word)
    while depth:
        start, k = starts[depth], chosen[depth]
        if k < 0:
            pieces.extend(byte_ids[b] for b in reversed(word[start:depth].encode("utf-8", "surrogatepass")))
        else:
            pieces.append(k)
        depth = start
    pieces.reverse()
    return pieces


class Encoder:
    """Encodes texts of one task; remembers up to _CACHE_WORDS words."""

    def __init__(self, vocabulary: dict):
        self.vocabulary, self.trie, self.index, self.flat, self.at = vocabulary, piece_trie(vocabulary), {}, np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        parts, counts, first = [], [], 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last] or "") <= _CHUNK):
                size += len(texts[last] or "")
                last += 1
            words, n = [], []
            for text in texts[first:last]:
                own = _WORDS.findall(" " + text) if text else []
                words += own
                n.append(len(own))
            distinct = set(words)
            if len(self.index) + len(distinct) > _CACHE_WORDS:
                fresh, self.index, self.flat, self.at = list(distinct), {}, np.zeros(0, np.int32), np.zeros(1, np.int64)
            else:
                fresh = [w for w in distinct if w not in self.index]
            if fresh:
                got = encode_words(fresh, self.vocabulary, self.trie)
                start = len(self.index)
                self.index.update(zip(got, range(start, start + len(got)), strict=True))
                self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(got.values()), np.int32)])
                self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(list(map(len, got.values())))])
            which = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
            begin, length = self.at[which], self.at[which + 1] - self.at[which]
            ends = np.cumsum(length)
            total = int(ends[-1]) if len(ends) else 0
            parts.append(self.flat[np.arange(total) - np.repeat(ends - length - begin, length)])
            per_text = np.zeros(len(n) + 1, np.int64)
            np.cumsum(n, out=per_text[1:])
            upto = np.concatenate(([0], ends))
            counts.append(np.diff(upto[per_text]))
            first = last
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), (np.concatenate(counts) if counts else np.zeros(0, np.int64))


def decode_ids(ids: list[int], spelled: list[bytes]) -> str:
    """The text whose encoding is ids."""
    data = b"".join([spelled[k] for k in ids])
    return data[1:].decode("utf-8", "replace") if data[:1] == b" " else data.decode("utf-8", "replace")


def encode(docs: DataFrame, model_path: str, *, text_col: str = "text") -> DataFrame:
    """docs with ids (array of int) and n_ids (long) in place of the text column."""
    bound_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in (text_col, "ids", "n_ids")]
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model_path))  # as large as the model file
    schema = docs.select(*names).schema.add("ids", T.ArrayType(T.IntegerType())).add("n_ids", "long")

    def run(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            flat, n = encoder.encode(text.to_pylist())
            at = np.zeros(len(n) + 1, np.int32)
            np.cumsum(n, out=at[1:])
            null = text.is_null().to_numpy(zero_copy_only=False)
            ids = pa.ListArray.from_arrays(pa.array(at), pa.array(flat), mask=pa.array(null))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids, pa.array(n, pa.int64(), mask=null)], [*names, "ids", "n_ids"])

    return docs.select(*names, F.col(text_col).alias("text to encode")).mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str, *, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """encoded with the text in place of the ids; a null list gives a null text."""
    bound_batches(encoded.sparkSession)
    names = [c for c in encoded.columns if c not in (text_col, ids_col)]
    shared = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(model_path)["spelled"])
    schema = encoded.select(*names).schema.add(text_col, "string")

    def run(batches):
        spelled = shared.value
        sizes, piece = np.array(list(map(len, spelled)), np.int64), spelled.__getitem__
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                ids = batch.column(batch.num_columns - 1).slice(first, 512)
                flat, null = ids.flatten().to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
                data = b"".join(map(piece, flat.tolist()))
                n = np.where(null, 0, ids.value_lengths().fill_null(0).to_numpy())
                upto = np.concatenate(([0], np.cumsum(sizes[flat])))[np.concatenate(([0], np.cumsum(n)))]
                texts = []
                for missing, a, b in zip(null.tolist(), upto[:-1].tolist(), upto[1:].tolist(), strict=True):
                    # the blank that encoding put before the text goes
                    texts.append(None if missing else data[a + (data[a : a + 1] == b" " and a < b) : b].decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([*(c.slice(first, 512) for c in batch.columns[:-1]), pa.array(texts, pa.string())], [*names, text_col])

    return encoded.select(*names, F.col(ids_col).alias("ids to decode")).mapInArrow(run, schema)
