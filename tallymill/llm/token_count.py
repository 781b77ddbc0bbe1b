"""Token counts by rank-synchronous array merging.

Texts are cut before every run of spaces (no piece of the vocabulary continues over such a place; this is checked
when the model is loaded, else whole texts are merged). Distinct pieces of a batch lie in one ragged array; in each
round the lowest-rank pair of every sequence is merged at once, and the surviving symbols are counted. Symbols that
the vocabulary lacks count one token per UTF-8 byte (byte fallback) or one unknown token.

Defined results: a null or empty text has 0 tokens; control strings inside texts are ordinary text; no limit on
length; repeated rows are counted each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table

SPACE = "▁"
NONE = np.int64(1) << 40
#: Characters of all pieces whose counts a task remembers (it starts afresh beyond that), and of a piece that is worth it.
REMEMBER, SHORT = 16_000_000, 64


class PieceBpe:
    """Merge tables of a sentencepiece BPE model without normalisation."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("needs a BPE model with identity normalisation and no user-defined or unused pieces")
        self.prefix, self.bytes_back = norm.add_dummy_prefix, model.trainer_spec.byte_fallback
        normal = [p for p in model.pieces if p.type == 1]
        self.ids = {p.piece: i for i, p in enumerate(normal)}
        _, rank = np.unique([-p.score for p in normal], return_inverse=True)
        left, right, made = [], [], []
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(i)
        if any(c not in self.ids for piece in self.ids for c in piece):
            raise ValueError("needs single characters of all pieces in the vocabulary")
        self.cuttable = not any(SPACE in piece.lstrip(SPACE) for piece in self.ids)
        self.rank = np.asarray(rank, np.int64)
        keys = np.asarray(left, np.int64) << 20 | np.asarray(right, np.int64)
        self.bits = 20
        self.keys, self.made = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        todo, vals = keys, np.asarray(made, np.int32)
        slot = self._slot(todo)
        while len(todo):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = todo[free]
            won = self.keys[slot] == todo
            self.made[slot[won]] = vals[won]
            todo, vals, slot = todo[~won], vals[~won], (slot[~won] + 1) & (1 << self.bits) - 1
        self.chars = np.full(0x110000, -1, np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.chars[ord(piece)] = i

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the piece that each pair makes, or -1."""
        out = np.full(len(left), -1, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left[at].astype(np.int64) << 20 | right[at]
        slot = self._slot(keys)
        while len(at):
            there = self.keys[slot]
            hit = there == keys
            out[at[hit]] = self.made[slot[hit]]
            on = ~hit & (there >= 0)
            at, keys, slot = at[on], keys[on], (slot[on] + 1) & (1 << self.bits) - 1
        return out

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each word (spaces already replaced, prefix already there)."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym, seq = self.chars[points], np.repeat(np.arange(len(words)), lens)
        lost = sym < 0
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF) if self.bytes_back else np.ones(len(points), np.int64)
        total = np.bincount(seq, weights=np.where(lost, width, 0), minlength=len(words)).astype(np.int64)
        made = self._pairs_within(sym, seq)
        while len(sym):
            ranks = np.where(made >= 0, self.rank[made], NONE)
            starts = np.flatnonzero(np.diff(seq, prepend=-1))
            low = np.minimum.reduceat(ranks, starts)
            size = np.diff(starts, append=len(seq))
            over = low == NONE  # nothing left to merge: its known symbols are final
            if over.any():
                gone = np.repeat(over, size)
                total += np.bincount(seq[gone], weights=sym[gone] >= 0, minlength=len(words)).astype(np.int64)
                sym, seq, made, ranks = (x[~gone] for x in (sym, seq, made, ranks))
                if not len(sym):
                    break
                low, size = low[~over], size[~over]
                starts = np.cumsum(size) - size
            floor = np.repeat(low, size)
            here = ranks == floor
            new = self._merge(sym, seq, made, self._alternate(here))
            # a new pair of a lower rank would have come before the sequence's later occurrences: then only its first one is merged now
            early = np.where(new[2] >= 0, self.rank[new[2]], NONE) < low[np.searchsorted(seq[starts], new[1])]
            if early.any():
                first = np.zeros(len(sym), bool)
                at = np.flatnonzero(here)
                first[at[np.diff(seq[at], prepend=-1) != 0]] = True
                odd = np.isin(seq, np.unique(new[1][early]))
                new = self._merge(sym, seq, made, np.where(odd, first, self._alternate(here)))
            sym, seq, made = new
        return total

    def _pairs_within(self, sym: np.ndarray, seq: np.ndarray) -> np.ndarray:
        made = np.full(len(sym), -1, np.int32)
        if len(sym) > 1:
            made[:-1] = np.where(seq[:-1] == seq[1:], self.pairs(sym[:-1], sym[1:]), -1)
        return made

    @staticmethod
    def _alternate(here: np.ndarray) -> np.ndarray:
        """Of overlapping places, each run's first, third, fifth, ... (made[i] = -1 ends each sequence, so runs lie in one)."""
        at = np.flatnonzero(here)
        start = np.diff(at, prepend=-2) != 1
        run = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
        out = np.zeros(len(here), bool)
        out[at[run % 2 == 0]] = True
        return out

    def _merge(self, sym: np.ndarray, seq: np.ndarray, made: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, ...]:
        """Merge the pairs that begin at ``take`` and look up the pairs they come to stand in."""
        sym = np.where(take, made, sym)
        keep = np.ones(len(sym), bool)
        keep[1:] = ~take[:-1]
        changed = take.copy()
        changed, sym, seq, made = changed[keep], sym[keep], seq[keep], made[keep].copy()
        stale = changed.copy()
        stale[:-1] |= changed[1:]
        at = np.flatnonzero(stale)
        made[at] = -1
        at = at[at < len(sym) - 1]
        at = at[seq[at] == seq[at + 1]]
        made[at] = self.pairs(sym[at], sym[at + 1])
        return sym, seq, made

    def pieces(self, text: str) -> list[str]:
        if not text:
            return []
        text = (" " if self.prefix else "") + text.replace(SPACE, " ")
        return CUT.findall(text) if self.cuttable else [text]


CUT = re.compile(r" *[^ ]+| +")


@functools.cache
def load(path: str) -> PieceBpe:
    return PieceBpe(path)


def token_count(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document. ``model_path`` must exist on every executor."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, held = load(model_path), {}, 0
        for batch in slices(batches):
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            words = [model.pieces(t) for t in texts]
            if held > REMEMBER:
                known.clear()
                held = 0
            fresh = list({w for ws in words for w in ws if w not in known})
            counted = dict(zip(fresh, model.count([w.replace(" ", SPACE) for w in fresh]).tolist(), strict=True)) if fresh else {}
            tokens = [sum(known[w] if w in known else counted[w] for w in ws) for ws in words]
            short = {w: n for w, n in counted.items() if len(w) <= SHORT}
            known |= short
            held += sum(map(len, short))
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_count(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
