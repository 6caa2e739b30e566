"""Token counts of a public byte-level BPE by rank-synchronous merging of ragged arrays.

A batch's new words are cut into pre-tokens, whose byte symbols lie in one flat numpy array with a sequence number for each
symbol.  Every round finds each sequence's lowest-rank pair and merges all its places in all sequences at once, until no
sequence has a mergeable pair; the symbols that survive are counted.  In a long sequence the places of each rank are kept, so that
a round touches only merged places and their neighbours.  Words never depend on their neighbours, so each distinct word is merged
once and kept in a bounded table of the Python worker.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batches, bounded_batches, documents, vocabulary

LIMIT = 2048
#: Words that a worker keeps (beyond that it starts anew), and bytes of text whose words it holds at once.
KEPT_WORDS, SPLIT_BYTES = 400_000, 2 << 20
#: Bytes of a pre-token from which the places of each rank are kept.
LONG = 256
NONE = 1 << 40
#: The pre-token pattern of the vocabulary file (fixed value); a part of white space is no pre-token.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class MergeTable:
    """Vocabulary and merge ranks of a byte-level BPE file as sorted arrays."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a.removesuffix(suffix) + b if suffix else a + b] if a.endswith(suffix) and suffix else vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int64)
        self.pieces = regex.compile(PIECES).findall
        special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.marks = [s.encode() for s in special]

    def cut(self, word: str) -> list[str]:
        """Pre-tokens of a stretch of text without special strings: NFC, lower case by character, then the pattern."""
        import unicodedata

        if not word.isascii():
            word = unicodedata.normalize("NFC", word).replace("Σ", "σ")  # no final form for the capital sigma
        return self.pieces(word.lower())

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair of symbols, NONE where it has none, and the symbol that it makes."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), self.made[at]

    def symbols(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The byte symbols of all pieces, flat, and the number of each symbol's piece."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        sym, ends = self.inner[flat], np.cumsum(sizes) - 1
        sym[ends] = self.final[flat[ends]]
        return sym, np.repeat(np.arange(len(pieces)), sizes)

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left after all merges, flat, and the number of each symbol's piece."""
        sym, seq = self.symbols(pieces)
        done_sym, done_seq = [], []
        while len(sym) > 1:
            rank, made = self.pairs(sym[:-1], sym[1:])
            rank = np.append(np.where(seq[:-1] == seq[1:], rank, NONE), NONE)
            first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(seq))))
            made, settled = np.append(made, 0), lowest == NONE
            if settled.any():
                done_sym.append(sym[settled])
                done_seq.append(seq[settled])
                if settled.all():
                    break
                go = ~settled
                sym, seq, rank, made, lowest = sym[go], seq[go], rank[go], made[go], lowest[go]
            hit = rank == lowest
            hit[hit] = every_other(np.append(False, np.diff(np.flatnonzero(hit)) == 1))
            sym = np.where(hit, made, sym)
            left = ~np.append(False, hit[:-1])
            sym, seq = sym[left], seq[left]
        else:
            done_sym.append(sym)
            done_seq.append(seq)
        sym, seq = np.concatenate(done_sym or [sym]), np.concatenate(done_seq or [seq])
        order = np.argsort(seq, kind="stable")
        return sym[order], seq[order]

    def merged_long(self, piece: bytes) -> np.ndarray:
        """Symbols of one long piece after all merges, by the same rounds; a round looks at the places of one rank and their neighbours."""
        sym = self.symbols([piece])[0]
        n = len(sym)
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        rank, made = self.pairs(sym[:-1], sym[1:])
        rank, made = np.append(rank, NONE), np.append(made, 0)
        places: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def noted(at: np.ndarray) -> None:
            at = at[np.argsort(rank[at], kind="stable")]
            r = rank[at]
            for part in np.split(at, np.flatnonzero(r[1:] != r[:-1]) + 1):
                if len(part) and (low := int(rank[part[0]])) != NONE:
                    if low not in places:
                        places[low] = []
                        heapq.heappush(waiting, low)
                    places[low].append(part)

        noted(np.arange(n))
        while waiting:
            low = heapq.heappop(waiting)
            at = np.unique(np.concatenate(places.pop(low)))
            at = at[alive[at] & (rank[at] == low)]
            if not len(at):
                continue
            at = at[every_other(np.append(False, after[at[:-1]] == at[1:]))]
            gone = after[at]
            sym[at], alive[gone] = made[at], False
            after[at] = after[gone]
            inside = after[at] < n
            before[after[at][inside]] = at[inside]
            touched = np.unique(np.append(at, before[at][before[at] >= 0]))
            right = after[touched]
            found, makes = self.pairs(sym[touched], sym[np.minimum(right, n - 1)])
            rank[touched], made[touched] = np.where(right < n, found, NONE), makes
            noted(touched)
        return sym[alive]

    def lengths(self, pieces: list[bytes]) -> np.ndarray:
        """Number of symbols of each piece after all merges."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = np.zeros(len(pieces), np.int64)
        short = np.flatnonzero(size < LONG)
        if len(short):
            _, seq = self.merged([pieces[k] for k in short])
            out[short] = np.bincount(seq, minlength=len(short))
        for k in np.flatnonzero(size >= LONG):
            out[k] = len(self.merged_long(pieces[k]))
        return out

    def counts(self, words: list[bytes]) -> list[int]:
        """Number of tokens of each word (no ASCII white space inside)."""
        owner, pieces, extra = [], [], np.zeros(len(words), np.int64)
        for k, w in enumerate(words):
            if self.special and any(m in w for m in self.marks):
                text = w.decode("utf-8", "replace")
                extra[k] += len(self.special.findall(text))
                found = [p for part in self.special.split(text) for p in self.cut(part)]
            else:
                found = self.cut(w.decode("utf-8", "replace"))
            pieces += found
            owner += [k] * len(found)
        if not pieces:
            return extra.tolist()
        distinct = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
        each = self.lengths([p.encode() for p in distinct])
        np.add.at(extra, np.array(owner), each[[distinct[p] for p in pieces]])
        return extra.tolist()


def every_other(follows: np.ndarray) -> np.ndarray:
    """Of places in order, some of which overlap the one before, as in "aaa": every other one of each such run, from the left."""
    i = np.arange(len(follows))
    return (i - np.maximum.accumulate(np.where(follows, 0, i))) % 2 == 0


_tables: dict[str, MergeTable] = {}


def merge_table(path: str) -> MergeTable:
    """One table for each vocabulary file and Python worker."""
    if path not in _tables:
        _tables[path] = MergeTable(path)
    return _tables[path]


def count_texts(texts: list[bytes], table: MergeTable, known: dict[bytes, int]) -> list[int]:
    split = [t.split() for t in texts]
    new = list(set().union(*split) - known.keys()) if split else []
    if len(known) + len(new) > KEPT_WORDS:
        known.clear()
        new = list(set().union(*split))
    known.update(zip(new, table.counts(new)))
    get = known.__getitem__
    return [sum(map(get, ws)) for ws in split]


def token_counts(docs: DataFrame, vocab_path: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """Every row of ``docs`` with the number of tokens of its whole text.

    No begin, end or other token is added; special strings inside a text count as their one token, as the library does.  Null
    and empty texts have 0 tokens; a very long text, or a text of one very long word, is counted whole, with work in proportion
    to its merges; repeated rows are counted alike; ties (one rank in several places) are merged from the left; an empty table
    gives an empty table; a column of that name is replaced, and there are no other working columns.
    """
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("bigint")
    def counted(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table, known = merge_table(vocab_path), {}
        for texts in it:
            parts = batches(iter(as_bytes(texts)), SPLIT_BYTES, len)
            yield pa.array([n for part in parts for n in count_texts(part, table, known)], pa.int64())

    return docs.withColumn(name, counted(F.col(text)))


def op7_token_counts(spark, sf_dir, vocab_path: str | None = None):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = token_counts(docs, vocab_path or vocabulary("word_bpe_49k.json"))
    return out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
