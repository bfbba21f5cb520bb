"""Alignment of two tokenisers over the same bytes.

A is a byte-level BPE of space + text, B a piece model that adds the space itself.  Byte offsets where tokens of both
end cut them into groups; a link is a pair of tokens whose bytes overlap.

:class:`Transducer` finds both with a dangling suffix.  Its state is which side leads and the bytes of the leading token
that the other side has not met; the next token of the other side either leaves a shorter suffix, takes the lead with
the rest of its own bytes, or ends with it, which closes the group.  Every token but the first of a group
gives one link, to the token that dangles.  Transitions are kept by (state, token), states by (side, bytes).

Long texts are cut before a space that stands alone between other characters: A's pattern starts a token there, and so does B, as no
piece holds a space behind another character (checked when the model is read).  So the tokens of a text are those of its pieces.

Counts over the whole corpus.  A task hands on *chunks*: documents of up to ``CHUNK_BYTES`` of text (or one larger
document), each with its distinct id pairs and how often it has them, and the chunk's sums of them.  The sums are added over
all chunks, the highest for each B id is found, and each chunk gets back the counts of its own pairs, which are at most as many as
its links.  Nothing is sent to all tasks but the two vocabularies (under 4 MB), and no task holds more than a chunk.

Defined results: texts that are null or empty, or whose joined bytes on either side differ from space + text, have zeros
and ``''``; of several id pairs with the highest count of their B id all count as best; rows are measured
each, so repeated rows count each time; null doc_ids stay; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import cut
from tapewright.llm.fertility import Vocabulary

VOCABULARY_A = "/opt/tokenizers/byte_bpe_50k.json"
VOCABULARY_B = "/opt/tokenizers/piece_bpe_32k.model"
#: UTF-8 bytes of the documents of a chunk; a longer document is a chunk by itself.
CHUNK_BYTES = 2 << 20
#: Characters that are tokenised at once, about.
PIECE_CHARS = 1 << 20
#: UTF-8 bytes of documents whose tokens are held at once; a longer document is by itself.
AT_ONCE = 1 << 19
#: Transitions kept before they are found anew.
KEPT_STEPS = 1 << 20
#: A lone space between two characters that are no white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: An id pair is one number: A's id times this, plus B's.
PAIR = 1 << 16
COLUMNS = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>, whole boolean"


def read_file(df: DataFrame, path: str) -> bytes:
    """A vocabulary file: of the driver's machine by a plain path, through Spark by one with a scheme."""
    if "://" not in path:
        return Path(path).read_bytes()
    return bytes(df.sparkSession.read.format("binaryFile").load(path).first()["content"])


class ByteVocabulary(Vocabulary):
    """A byte-level BPE from its JSON file, whose ids follow its merges."""

    def __init__(self, data: bytes):
        import tiktoken

        from tapewright.llm.fertility import PATTERN

        model = json.loads(data)["model"]
        # the file writes byte b as chr(b) where that prints, and the others, in order, as the characters from 256 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids = [model["vocab"][m] for m in merges]
        if any(b <= a for a, b in zip(ids, ids[1:])):
            raise ValueError("ids of the byte-level vocabulary do not follow its merges")
        ordinary = set(merges) | set(byte_of)
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token in ordinary}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token


class PieceVocabulary:
    """A piece model with byte fallback."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_proto=data)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece holds a space behind another character")
        self.bytes = [bytes([int(p[3:-1], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def tokens(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Transducer:
    """States are numbers: 0 is an empty suffix, odd ones are led by A, other even ones by B."""

    def __init__(self, bytes_a, bytes_b):
        self.bytes = (bytes_a, bytes_b)
        self.suffixes: list[bytes] = [b""]
        self.numbers: dict[tuple[int, bytes], int] = {}
        self.start: dict[int, int] = {}
        self.step: dict[int, int] = {}
        #: groups of one token on either side, by their link
        self.single: dict[int, str] = {}
        self.names = [str(i) for i in range(max(len(bytes_a), len(bytes_b)))]

    def _state(self, side: int, suffix: bytes) -> int:
        """A leads at odd places of the list of states, B at even ones."""
        if not suffix:
            return 0
        found = self.numbers.get((side, suffix))
        if found is None:
            while len(self.suffixes) % 2 != 1 - side:
                self.suffixes.append(b"")
            found = self.numbers[side, suffix] = len(self.suffixes)
            self.suffixes.append(suffix)
        return found

    def _next(self, state: int, token: int) -> int:
        side, suffix = 1 - state % 2, self.suffixes[state]
        other = self.bytes[1 - side][token]
        if len(other) <= len(suffix):
            if not suffix.startswith(other):
                raise ValueError("the two sides differ in their bytes")
            to = self._state(side, suffix[len(other) :])
        else:
            if not other.startswith(suffix):
                raise ValueError("the two sides differ in their bytes")
            to = self._state(1 - side, other[len(suffix) :])
        if len(self.step) >= KEPT_STEPS:
            self.step.clear()
        self.step[state * PAIR + token] = to
        return to

    def align(self, a: list[int], b: list[int]) -> tuple[list[str], list[int]]:
        """The groups as text, and the links as id pairs.  Fails where the two sides' joined bytes differ."""
        texts, links, i, j = [], [], 0, 0
        step, single, names, n = self.step, self.single, self.names, len(a)
        while i < n:
            lead = a[i]
            link = lead * PAIR + b[j]
            text = single.get(link)
            if text is None:
                at_i, at_j = i, j
                i += 1
                state = self.start.get(lead)
                if state is None:
                    state = self.start[lead] = self._state(0, self.bytes[0][lead])
                while state:
                    if state % 2:  # A leads
                        token = b[j]
                        j += 1
                        links.append(lead * PAIR + token)
                    else:
                        token = a[i]
                        i += 1
                        links.append(token * PAIR + lead)
                    to = step.get(state * PAIR + token)
                    if to is None:
                        to = self._next(state, token)
                    if (to ^ state) & 1:
                        lead = token  # only of use where the other side leads now
                    state = to
                text = ",".join([names[t] for t in a[at_i:i]]) + "|" + ",".join([names[t] for t in b[at_j:j]])
                if i - at_i == j - at_j == 1:
                    if len(single) >= KEPT_STEPS:
                        single.clear()
                    single[link] = text
            else:  # the step of this pair from the empty suffix closes at once
                i += 1
                j += 1
                links.append(link)
            texts.append(text)
        if j != len(b):
            raise ValueError("the two sides differ in their bytes")
        return texts, links


class Aligner:
    """Tokens, groups and links of whole texts."""

    def __init__(self, data_a: bytes, data_b: bytes):
        self.a, self.b = ByteVocabulary(data_a), PieceVocabulary(data_b)
        self.transducer = Transducer(self.a.bytes, self.b.bytes)

    def measured(self, texts: list[str]) -> list[tuple[int, int, list[str], list[int]] | None]:
        """Tokens of A and of B, groups as text, and links of each space + text; None where joined bytes differ from it.  One tokeniser
        goes over all texts after the other, which takes less time than by turns."""
        parts = [(k, piece) for k, text in enumerate(texts) for piece in pieces(text)]
        of_a = [self.a.tokens(" " + piece).tolist() for _, piece in parts]
        of_b = self.b.tokens([piece for _, piece in parts])
        out: list = [(0, 0, [], []) for _ in texts]
        for (k, piece), a, b in zip(parts, of_a, of_b):
            if out[k] is None:
                continue
            if self.a.encoding.decode_bytes(a) != (" " + piece).encode():
                out[k] = None
                continue
            try:  # A's bytes are the text's, so B's are if the two align
                groups, links = self.transducer.align(a, b)
            except (ValueError, IndexError):
                out[k] = None
                continue
            n_a, n_b, before, linked = out[k]
            out[k] = (n_a + len(a), n_b + len(b), before + groups if before else groups, linked + links if linked else links)
        return out


def pieces(text: str) -> Iterator[str]:
    """The text, cut at lone spaces (which are left out) after every ``PIECE_CHARS`` characters or so."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        gap = _CUT.search(text, at + PIECE_CHARS)
        if not gap:
            break
        yield text[at : gap.start()]
        at = gap.end()
    yield text[at:] if at else text


def n_bytes(text: str | None) -> int:
    return len(text or "") if (text or "").isascii() else len((text or "").encode())


class Chunk:
    """Documents of one chunk."""

    def __init__(self, number: int):
        self.number, self.size, self.rows = number, 0, []

    def add(self, rows: list[tuple[int | None, str | None]], aligner: Aligner) -> None:
        measured = aligner.measured([text or "" for _, text in rows])
        for (doc_id, text), found in zip(rows, measured):
            n_a, n_b, groups, links = found if found and text else (0, 0, [], [])
            counts = Counter(links)
            n = len(counts)
            own, times = np.fromiter(counts.keys(), np.int64, n), np.fromiter(counts.values(), np.int32, n)
            sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
            self.rows.append((doc_id, n_a, n_b, len(groups), len(links), sha, own, times))
            self.size += n_bytes(text)

    def batch(self) -> pa.RecordBatch:
        """A row for each document, and last one for the chunk: its distinct pairs, and how often it has each."""
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        pairs, at = np.unique(np.concatenate([r[6] for r in self.rows]), return_inverse=True)
        times = np.bincount(at, np.concatenate([r[7] for r in self.rows]), len(pairs)).astype(np.int32)
        n = len(self.rows)
        cols = [pa.array([r[i] for r in self.rows] + [None], pa.int64()) for i in range(5)]
        return pa.RecordBatch.from_arrays([
            pa.array([self.number] * (n + 1), pa.int64()), *cols, pa.array([r[5] for r in self.rows] + [None], pa.string()),
            pa.array([r[6] for r in self.rows] + [pairs], pa.list_(pa.int64())), pa.array([r[7] for r in self.rows] + [times], pa.list_(pa.int32())),
            pa.array([False] * n + [True]),
        ], names)


def _finish(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """The measures of a chunk's documents, from the counts of its pairs."""
    keys = counts.column("pair").to_numpy()
    order = np.argsort(keys)
    keys, best, total = keys[order], counts.column("best").to_numpy()[order].astype(np.int64), counts.column("total").to_numpy()[order]
    sums = [[], []]
    for pairs, times in zip(docs.column("pairs"), docs.column("times")):
        at, n = np.searchsorted(keys, pairs.values.to_numpy()), times.values.to_numpy().astype(np.int64)
        sums[0].append(int(best[at] @ n))
        sums[1].append(int(total[at] @ n))
    out = docs.append_column("n_best", pa.array(sums[0], pa.int64())).append_column("count_sum", pa.array(sums[1], pa.int64()))
    return out.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def align_tokens(docs: DataFrame, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each input row."""
    sent = docs.sparkSession.sparkContext.broadcast((read_file(docs, vocabulary_a), read_file(docs, vocabulary_b)))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, pid, number = Aligner(*sent.value), TaskContext.get().partitionId(), 0
        open_chunk, rows, size = Chunk(pid << 32), [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                rows.append((doc_id.as_py(), text.as_py()))
                size += n_bytes(rows[-1][1])
                if size >= AT_ONCE or open_chunk.size + size >= chunk_bytes:
                    open_chunk.add(rows, aligner)
                    rows, size = [], 0
                if open_chunk.size >= chunk_bytes:
                    yield open_chunk.batch()
                    number += 1
                    open_chunk = Chunk((pid << 32) + number)
        open_chunk.add(rows, aligner)
        if open_chunk.rows:
            yield open_chunk.batch()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    written = cut(own.mapInArrow(chunks, COLUMNS), "alignment-chunks")
    own_sums = written.filter("whole").select("chunk", F.explode(F.arrays_zip("pairs", "times")).alias("z"))
    sums = cut(own_sums.select("chunk", F.col("z.pairs").alias("pair"), F.col("z.times").alias("n")), "alignment-sums")
    totals = cut(sums.groupBy("pair").agg(F.sum("n").alias("total")), "alignment-totals")
    # at most one row for each id of B
    highest = totals.groupBy((F.col("pair") % PAIR).alias("b")).agg(F.max("total").alias("highest"))
    marked = totals.withColumn("b", F.col("pair") % PAIR).join(F.broadcast(highest), "b").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))
    counts = sums.select("chunk", "pair").join(marked, "pair")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return written.filter("NOT whole").groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(_finish, schema)
