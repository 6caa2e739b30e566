"""Cost-balanced packing of tokenised documents into sequences of fixed length.

A sequence costs ``linear * tokens + quadratic * sum of squared piece lengths`` (attention stays inside a piece).  Every task
packs its own documents in chunks of a bounded number of tokens, so nothing is shuffled.  In a chunk the pieces that fill a
sequence stand alone; the rest go, by descending length, to the sequence of lowest cost that still has room.  A chunk opens
just as many sequences as its tokens need, and a piece that fits nowhere whole is cut over the roomiest ones, so at most the
last sequence's worth of a chunk is padding.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batches, bounded_batches, documents, vocabulary

MAX_TOKENS = 2048
END_ID = 1
#: Tokens that one chunk holds; each chunk leaves half a sequence of padding on average.
CHUNK_TOKENS = 1 << 20
#: Cost of a token, and of a pair of tokens that attend to each other.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Distinct words whose ids a Python worker keeps, and bytes of text whose words it holds at once.
KEPT_WORDS, SPLIT_BYTES = 400_000, 2 << 20

PIECES = "start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


class Tokens:
    """Ids of whole texts by the tokenizers library, each distinct word encoded once (words never join across white space).

    Words of letters, alone or before common signs, are encoded many to a string, and cut apart after each id that ends a
    pre-token: such a word is one pre-token, and so are the signs after it.  All other words are encoded by themselves.
    """

    SIGNS = b".,;:!?*#$%&|<>()+=@-\""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), np.uint32(end_id).tobytes()
        self.known: dict[bytes, bytes] = {}
        self.letters: dict[bytes, bytes] = {}
        self.signs: dict[bytes, bytes] = {b"": b""}
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix = model.get("end_of_word_suffix")
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        if suffix:
            self.ends[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True

    def each(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, encoded by itself."""
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def together(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of letters, encoded in strings of many."""
        out: list[bytes] = []
        for k in range(0, len(words), 20_000):
            lines = [words[j : j + 100] for j in range(k, min(k + 20_000, len(words)), 100)]
            for line, e in zip(lines, self.tokenizer.encode_batch_fast([b" ".join(ws).decode() for ws in lines], add_special_tokens=False)):
                ids = np.array(e.ids, np.uint32)
                cut = 4 * (np.flatnonzero(self.ends[ids]) + 1)
                raw = ids.tobytes()
                out += [raw[a:b] for a, b in zip([0, *cut.tolist()], cut.tolist())] if len(cut) == len(line) else self.each(line)
        return out

    def learn(self, words: list[bytes]) -> None:
        letters, signs = self.letters, self.signs
        cores = [w.rstrip(self.SIGNS).lower() for w in words]
        plain = [c.isalpha() or (not c.isascii() and c.decode("utf-8", "replace").lower().isalpha()) for c in cores] if self.ends.any() else [False] * len(words)
        others = [w for w, p in zip(words, plain) if not p]
        for k in range(0, len(others), 20_000):
            self.known.update(zip(others[k : k + 20_000], self.each(others[k : k + 20_000])))
        words, cores = list(compress(words, plain)), list(compress(cores, plain))
        new = [c for c in set(cores) if c not in letters]
        letters.update(zip(new, self.together(new)))
        after = [w[len(c) :] for w, c in zip(words, cores)]
        marks = [s for s in set(after) if s not in signs]
        signs.update(zip(marks, self.each(marks)))
        self.known.update(zip(words, [letters[c] + signs[s] if s else letters[c] for c, s in zip(cores, after)]))

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text with the end id."""
        split = [t.split() for t in texts]
        for table in (self.known, self.letters, self.signs):
            if len(table) > KEPT_WORDS:
                table.clear()
                self.signs[b""] = b""
        known = self.known
        self.learn([w for w in set().union(*split) if w not in known])
        get = known.__getitem__
        return [b"".join(map(get, ws)) + self.end for ws in split]


_kept: dict[tuple[str, int], Tokens] = {}


def tokens_for(path: str, end_id: int) -> Tokens:
    """One for each Python worker, which keeps it from task to task."""
    if (path, end_id) not in _kept:
        _kept[path, end_id] = Tokens(path, end_id)
    return _kept[path, end_id]


def pack(lengths: np.ndarray, size: int = MAX_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` that hold every token of documents of these lengths once.

    Documents without tokens give no piece; ties go to the earlier document and the lower sequence.
    """
    out, seq, rest = [], 0, []
    for d, n in enumerate(lengths.tolist()):
        for start in range(0, n - size + 1, size):
            out.append((d, start, size, seq, 0))
            seq += 1
        if n % size:
            rest.append((n % size, d, n - n % size))
    room = np.full(-(-sum(r[0] for r in rest) // size), size, np.int64)
    cost = np.zeros(len(room))

    def put(k: int, d: int, start: int, n: int) -> None:
        out.append((d, start, n, seq + k, int(size - room[k])))
        room[k] -= n
        cost[k] += linear * n + quadratic * n * n

    for n, d, start in sorted(rest, key=lambda r: (-r[0], r[1])):
        k = int(np.argmin(np.where(room >= n, cost, np.inf)))
        if room[k] >= n:
            put(k, d, start, n)
            continue
        while n:
            k = int(np.argmax(room))
            part = min(n, int(room[k]))
            put(k, d, start, part)
            start, n = start + part, n - part
    return out


def packed(docs: DataFrame, vocab_path: str, end_id: int = END_ID, max_tokens: int = MAX_TOKENS, chunk_tokens: int = CHUNK_TOKENS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pieces of all ``docs``: ids as little-endian 32-bit numbers, the sequence they lie in and their offset there.

    A document is its tokens and then ``end_id``; a null or empty text is the end id alone, so each row has a piece.  Ids may
    be of any type, null or repeat: a piece carries its row's id.  Repeated rows are packed each for itself.  A very long text fills sequences
    of its own, but for its rest; ties go to the earlier document and the lower sequence.  An empty table gives no pieces.
    Extra columns aren't read, so they can't clash.
    """
    bounded_batches(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[doc_id].dataType
    arrow_kind = to_arrow_type(kind)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, first = tokens_for(vocab_path, end_id), TaskContext.get().partitionId() << 40
        some = (part for b in it for part in batches(zip(b.column(0).to_pylist(), as_bytes(b.column(1))), SPLIT_BYTES, lambda r: len(r[1])))
        rows = ((i, x) for part in some for (i, _), x in zip(part, tokens.ids([t for _, t in part])))
        for chunk in batches(rows, 4 * chunk_tokens, lambda r: len(r[1])):
            lengths = np.array([len(x) // 4 for _, x in chunk], np.int64)
            pieces = sorted(pack(lengths, max_tokens), key=lambda p: p[3:])
            d = [p[0] for p in pieces]
            for k in range(0, len(pieces), 2000):
                some, of = pieces[k : k + 2000], d[k : k + 2000]
                yield pa.record_batch(
                    [
                        pa.array([chunk[i][0] for i in of], arrow_kind),
                        pa.array([p[1] for p in some], pa.int64()),
                        pa.array([p[2] for p in some], pa.int64()),
                        pa.array([chunk[p[0]][1][4 * p[1] : 4 * (p[1] + p[2])] for p in some], pa.binary()),
                        pa.array(lengths[of], pa.int64()),
                        pa.array([first + p[3] for p in some], pa.int64()),
                        pa.array([p[4] for p in some], pa.int64()),
                    ],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )
            first += max((p[3] for p in pieces), default=-1) + 1

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, {PIECES}")


def op3_packing(spark, sf_dir, vocab_path: str | None = None):
    out = packed(documents(spark, sf_dir), vocab_path or vocabulary("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
