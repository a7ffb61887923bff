"""Operator 1: SentencePiece BPE encoding and decoding by vectorised merge rounds.

A batch's distinct words are laid out as one flat array of symbols.  Each round looks up the rank of every adjacent pair,
takes the minimum per word (a segmented reduction), merges all leftmost non-overlapping occurrences of that minimum in
every word at once and compacts the array, until no pair has a rank.  Where a merge would make a pair that ranks before
the one being merged, that word takes only its leftmost merge in the round, which is the library's own order.  A word needs as
many rounds as it has different merges, so words above LONG_WORD symbols (text without spaces) are merged with a heap instead.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm.common import load, mapped

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Distinct words kept with their ids between batches (about 300 bytes each); the store is emptied when it is full.
CACHE_WORDS = 1_000_000
NO_RANK = np.int64(1 << 40)
#: Symbols of a word up to which rounds over arrays cost less than a heap, which is linear but for a logarithm.
LONG_WORD = 256


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol-buffer message: (number, value)."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            size = 4 if key & 7 == 5 else 8
            yield key >> 3, data[at : at + size]
            at += size


class PieceModel:
    """A BPE model file: pieces, scores and the pair table that its merges follow."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = list(_fields(f.read()))
        self.pieces, self.scores, self.kinds = [], [], []
        trainer = normalizer = {}
        for number, value in message:
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode("utf-8"))
                self.scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3) != 2 or normalizer.get(1) != b"identity" or normalizer.get(4, 1) or not normalizer.get(3, 1):
            raise ValueError("only BPE models with identity normalisation, a dummy prefix and kept white space")
        if not trainer.get(35):
            raise ValueError("only models with byte fallback")
        self.end_id = trainer.get(42, 2)
        normal = [i for i, k in enumerate(self.kinds) if k == NORMAL]
        self.ids = {self.pieces[i]: i for i in normal}
        self.byte_ids = [0] * 256
        for i, k in enumerate(self.kinds):
            if k == BYTE:
                self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        order = {score: rank for rank, score in enumerate(sorted({self.scores[i] for i in normal}, reverse=True))}
        keys, merged, ranks = [], [], []
        size = len(self.pieces)
        for i in normal:
            text = self.pieces[i]
            for cut in range(1, len(text)):
                left, right = self.ids.get(text[:cut]), self.ids.get(text[cut:])
                if left is not None and right is not None:
                    keys.append(left * size + right)
                    merged.append(i)
                    ranks.append(order[self.scores[i]])
        keys, merged, ranks = np.array(keys, np.int64), np.array(merged, np.int32), np.array(ranks, np.int64)
        # pairs by open addressing: `slots` holds each pair's key, in the first free slot from its hash on
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        n_slots = 1 << int(64 - self.shift)
        self.slots, self.slot_ranks, self.slot_merged = np.full(n_slots, -1, np.int64), np.full(n_slots, NO_RANK), np.full(n_slots, -1, np.int64)
        left, place = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = left[self.slots[place[left]] == -1]
            _, first = np.unique(place[free], return_index=True)
            put = free[first]
            self.slots[place[put]], self.slot_ranks[place[put]], self.slot_merged[place[put]] = keys[put], ranks[put], merged[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            place[left] = (place[left] + 1) % n_slots
        self.size = size
        self.merges: dict[int, tuple[int, int]] = {}
        # characters that are pieces, by code point; others become -1 - code point and are written as bytes in the end
        self.symbol_of = -1 - np.arange(0x110000, dtype=np.int64)
        for t, i in self.ids.items():
            if len(t) == 1:
                self.symbol_of[ord(t)] = i
        self.names = [str(i) for i in range(size)]
        inner = {c for t in (self.pieces[i] for i in normal) if len(t) > 1 for c in t}
        if any(SPACE in t.lstrip(SPACE) for t in self.ids):
            self.words = re.compile(r"(?s).+")  # pieces cross words: a text is one word
        else:
            breaks = "".join(c for c in "\n\r\t" if c not in inner)
            self.words = re.compile(rf"{SPACE}+[^{SPACE}{breaks}]*|[{breaks}][^{SPACE}{breaks}]*" if breaks else rf"{SPACE}+[^{SPACE}]*")
        self.decoded = [t.replace(SPACE, " ") if k == NORMAL else "" for t, k in zip(self.pieces, self.kinds, strict=True)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair; NO_RANK where the pair does not merge."""
        keys = np.where((left >= 0) & (right >= 0), left * np.int64(self.size) + right, np.int64(-2))
        at = self._slot(keys)
        held = self.slots[at]
        other = np.flatnonzero((held != keys) & (held != -1))
        while len(other):  # the slot is another pair's: look into the next one
            at[other] = (at[other] + 1) % len(self.slots)
            held = self.slots[at[other]]
            other = other[(held != keys[other]) & (held != -1)]
        return self.slot_ranks[at], self.slot_merged[at]

    def _finish(self, symbols: np.ndarray) -> np.ndarray:
        """All merges of one word, best rank first and leftmost first among equals."""
        if not self.merges:
            used = np.flatnonzero(self.slots >= 0)
            self.merges.update(zip(self.slots[used].tolist(), zip(self.slot_ranks[used].tolist(), self.slot_merged[used].tolist(), strict=True), strict=True))
        s: list[int | None] = symbols.tolist()
        n = len(s)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and s[i] >= 0 and s[j] >= 0 and (found := self.merges.get(s[i] * self.size + s[j])):
                heapq.heappush(heap, (found[0], i, s[i], s[j], found[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, left, right, merged = heapq.heappop(heap)
            j = after[i]
            if s[i] != left or j >= n or s[j] != right:
                continue
            s[i], s[j], after[i] = merged, None, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return np.array([x for x in s if x is not None], np.int64)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word (its spaces already written as the space symbol), by merge rounds over all words at once: the ids of
        all words, characters without a piece as -1 - code point, and where each word's ids end."""
        symbol = self.symbol_of[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), lengths)
        done_symbol, done_word = [], []
        ends = np.cumsum(lengths)
        for w in np.flatnonzero(lengths > LONG_WORD).tolist():
            done_symbol.append(self._finish(symbol[ends[w] - lengths[w] : ends[w]]))
            done_word.append(np.full(len(done_symbol[-1]), w))
        if done_word:
            keep = np.repeat(lengths <= LONG_WORD, lengths)
            symbol, word = symbol[keep], word[keep]
        while len(symbol) > 1:
            rank, merged = self._pairs(symbol[:-1], symbol[1:])
            rank[word[:-1] != word[1:]] = NO_RANK
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(np.concatenate([rank, [NO_RANK]]), starts)
            # the last pair slot of a word holds NO_RANK, so a word of one symbol never merges
            spread = np.repeat(best, np.diff(np.concatenate([starts, [len(symbol)]])))
            active = spread < NO_RANK
            if not active.all():  # compaction: finished words leave the arrays
                done_symbol.append(symbol[~active])
                done_word.append(word[~active])
                keep = np.flatnonzero(active)
                symbol, word, spread = symbol[keep], word[keep], spread[keep]
                if not len(symbol):
                    break
                rank, merged = np.concatenate([rank, [NO_RANK]])[keep][:-1], np.concatenate([merged, [-1]])[keep][:-1]
            hit = (rank == spread[:-1]) & (rank < NO_RANK)
            at = np.flatnonzero(hit)
            # overlapping hits (a a a): every second one from the start of its run
            run = np.concatenate([[True], np.diff(at) != 1])
            begin = at[run][np.cumsum(run) - 1]
            at = at[(at - begin) % 2 == 0]
            new = merged[at]
            limit = spread[at]
            follows = np.concatenate([[False], at[1:] == at[:-1] + 2])
            before = np.where(follows, np.concatenate([[-1], new[:-1]]), symbol[np.maximum(at - 1, 0)])
            has_before = (at > 0) & (word[np.maximum(at - 1, 0)] == word[at])
            after = np.minimum(at + 2, len(symbol) - 1)
            has_after = (at + 2 < len(symbol)) & (word[after] == word[at])
            early = (has_before & (self._pairs(before, new)[0] < limit)) | (has_after & (self._pairs(new, symbol[after])[0] < limit))
            if early.any():
                careful = np.isin(word[at], word[at[early]])
                leftmost = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
                at, new = at[~careful | leftmost], new[~careful | leftmost]
            symbol[at] = new
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, word = symbol[keep], word[keep]
        done_symbol.append(symbol)
        done_word.append(word)
        symbol, word = np.concatenate(done_symbol), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return symbol[order], np.searchsorted(word[order], np.arange(len(words)), "right")

    def written(self, symbols: list[int]) -> list[int]:
        """Ids with characters that have no piece as their bytes."""
        return [i for s in symbols for i in ([s] if s >= 0 else [self.byte_ids[b] for b in chr(-1 - s).encode("utf-8", "surrogatepass")])]

    def split(self, text: str) -> list[str]:
        """Words that no piece crosses; their concatenation is the text with the dummy prefix."""
        return self.words.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def decode_run(self, ids: list[int]) -> str:
        """Text of ids that holds every byte run whole; spaces stay as they are, control ids give nothing."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_bytes_text(bytes(raw)))
                raw.clear()
            out.append(self.decoded[i])
        if raw:
            out.append(_bytes_text(bytes(raw)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids): the dummy prefix goes, bytes that are no UTF-8 become U+FFFD each."""
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        text = self.decode_run(ids)
        return text[1:] if first is not None and self.kinds[first] == NORMAL and text.startswith(" ") else text


def _bytes_text(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + size].decode("utf-8"))
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


class Encoder:
    """Encodes whole texts through a bounded store of distinct words."""

    def __init__(self, model: PieceModel, cache_words: int = CACHE_WORDS):
        self.model, self.cache_words = model, cache_words
        self.lines: dict[str, str] = {}  # a word's ids as text
        self.texts: dict[str, str] = {}  # and what they decode to

    def learn(self, texts: list[list[str]]) -> None:
        fresh = set().union(*texts).difference(self.lines)
        if not fresh:
            return
        if len(self.lines) + len(fresh) > self.cache_words and self.lines:
            self.lines.clear()
            self.texts.clear()
            fresh = set().union(*texts)
        words, model = list(fresh), self.model
        symbol, ends = model.encode_words(words)
        starts = np.concatenate([[0], ends[:-1]])
        plain = (np.minimum.reduceat(symbol, starts) >= 0).tolist()
        flat, names, decoded, begin = symbol.tolist(), model.names, model.decoded, 0
        for w, end, whole in zip(words, ends.tolist(), plain, strict=True):
            ids = flat[begin:end]
            begin = end
            if whole:
                self.texts[w] = "".join([decoded[i] for i in ids])
            else:
                ids = model.written(ids)
                self.texts[w] = model.decode_run(ids)
            self.lines[w] = " ".join([names[i] for i in ids])

    def ids(self, text: str) -> list[int]:
        words = self.model.split(text)
        self.learn([words])
        return [int(i) for w in words for i in self.lines[w].split()] + [self.model.end_id]

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(n_tokens, ids_sha256, decoded_sha256) of each text."""
        out, at = [], 0
        while at < len(texts):  # a few MB of text at a time, so that the store's growth between checks is bounded
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= 2_000_000):
                size += len(texts[to])
                to += 1
            split = [self.model.split(t) for t in texts[at:to]]
            self.learn(split)
            line_of, text_of, end = self.lines.__getitem__, self.texts.__getitem__, str(self.model.end_id)
            for words in split:
                line = " ".join([*map(line_of, words), end])
                text = "".join(map(text_of, words))
                text = text[1:] if text.startswith(" ") else text
                out.append((line.count(" ") + 1, hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()))
            at = to
        return out


#: The worker process's encoders, which its later tasks use again with the words they have learned.
_ENCODERS: dict[str, Encoder] = {}


def _encoder(model_path: str) -> Encoder:
    if model_path not in _ENCODERS:
        _ENCODERS[model_path] = Encoder(PieceModel(model_path))
    return _ENCODERS[model_path]


def encode_digests(documents: DataFrame, model_path: str) -> DataFrame:
    """Encode each document and decode its ids again.

    Null and empty texts are the end id alone; repeated rows give repeated rows; a null doc_id stays null; other columns
    are not read.  `model_path` must exist on every executor, as the tokenizer files do.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(model_path)
        for frame in batches:
            rows = encoder.digests([t if isinstance(t, str) else "" for t in frame["text"]])
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_tokens": [r[0] for r in rows], "ids_sha256": [r[1] for r in rows], "decoded_sha256": [r[2] for r in rows]})

    return mapped(documents, ["doc_id"], ["text"], run, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
