"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the model crosses from a word into a white-space marker, so a text falls into chunks (markers and
the characters after them) that are segmented independently. Each task keeps a table of the distinct chunks
it has met; only new chunks go through the library, and ids are joined back by position.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import small_batches, text_slices

MARK = "▁"
_CHUNK = re.compile(f"{MARK}({MARK}*[^{MARK}]*)")
#: Chunks that a worker's table holds; beyond that the table begins anew, which changes no result.
TABLE_CHUNKS = 200_000
#: A longer chunk is segmented when met and not kept.
KEPT_CHARS = 64
#: Bytes of text and rows that are encoded at once (a longer text alone).
SLICE_BYTES, SLICE_ROWS = 500_000, 256


def chunks_of(text: str) -> list[str]:
    """A text's chunks, each without the first of its markers. The library puts one marker before the text."""
    if not text:
        return []
    if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
        return _CHUNK.findall(MARK + text.replace(" ", MARK))
    return text.split(" ")


class ChunkTable:
    """Segments of distinct chunks; `rows` gives ids as the library does, and the text that they decode to."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece of this model crosses a white-space marker")
        probe = self.sp.encode(" a ", num_threads=1)
        if self.sp.encode("a", num_threads=1) != self.sp.encode(f"{MARK}a", num_threads=1)[-1:] and self.sp.decode(probe) != " a ":
            raise ValueError("this model does not keep white space")
        self.mark_id = self.sp.piece_to_id(MARK)
        self.names = [str(i) for i in range(self.sp.get_piece_size())]
        #: Ids of each chunk, in 32 bits each, and the decoded texts of those that don't decode to themselves.
        self.table: dict[str, bytes] = {}
        self.changed: dict[str, str] = {}

    def _segment(self, chunks: list[str]) -> None:
        """Take new chunks into the table. The library puts one marker before each input, as all chunks have."""
        ids = [i or [self.mark_id] for i in self.sp.encode(chunks, num_threads=1)]
        back = self.sp.decode(ids, num_threads=1)
        flat = np.fromiter(chain.from_iterable(ids), np.int32).tobytes()
        ends = [4 * e for e in accumulate(map(len, ids))]
        self.table.update((c, flat[a:e]) for c, a, e in zip(chunks, [0, *ends], ends))
        self.changed.update((c, b) for c, b in zip(chunks, back) if b != c.replace(MARK, " "))

    def rows(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """(ids, decoded text) of each text."""
        split = list(map(chunks_of, texts))
        if len(self.table) > TABLE_CHUNKS:
            self.table, self.changed = {}, {}
        missing = [c for c in set().union(*split) if c not in self.table]
        if missing:
            self._segment(missing)
        out = []
        for text, chunks in zip(texts, split):
            ids = np.frombuffer(b"".join(map(self.table.__getitem__, chunks)), np.int32)
            if self.changed.keys().isdisjoint(chunks):  # every chunk decodes to itself
                back = text.replace(MARK, " ")
            else:
                back = " ".join([self.changed.get(c) or c.replace(MARK, " ") for c in chunks])
            out.append((ids, back))
        for c in missing:
            if len(c) > KEPT_CHARS:
                del self.table[c]
                self.changed.pop(c, None)
        return out

    def joined(self, ids: np.ndarray) -> str:
        """The decimal ids joined by commas."""
        return ",".join([self.names[i] for i in ids.tolist()])


#: One table a worker and model: tasks that a worker runs one after another go on with it.
_TABLES: dict[bytes, ChunkTable] = {}


def _table(model: bytes) -> ChunkTable:
    key = hashlib.sha256(model).digest()
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = ChunkTable(model)
    return _TABLES[key]


def encode_pieces(docs: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = True, digests: bool = False) -> DataFrame:
    """Encode every whole text with a SentencePiece model and decode the ids again.

    Returns the `keep` columns, n_tokens (long), round_trip (whether decoding gives the text back) and either ids
    (array<int>), with the decoded text unless `decoded` is false, or, with `digests`, their SHA-256: ids_sha256
    of the decimal ids joined by commas, decoded_sha256 of the decoded text in UTF-8. Null texts count as empty
    and have no ids. Rows are independent: repeats give equal rows, an empty table an empty result. Batches are cut
    by bytes, so very long texts go one by one. The model is read on the driver and travels with the tasks (0.5 MB).
    """
    small_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()
    kept = [docs[c].alias(f"k{i}") for i, c in enumerate(keep)]
    own = [("n_tokens", T.LongType(), pa.int64()), ("round_trip", T.BooleanType(), pa.bool_())]
    if digests:
        own += [("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())]
    else:
        own += [("ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))] + [("decoded", T.StringType(), pa.string())] * decoded
    schema = T.StructType([T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)] + [T.StructField(n, t) for n, t, _ in own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model)
        for piece, raw in text_slices(batches, SLICE_BYTES, SLICE_ROWS):
            texts = [t.decode() for t in raw]
            rows = table.rows(texts)
            sizes = [len(i) for i, _ in rows]
            columns = [pa.array(sizes, pa.int64()), pa.array([t == back for t, (_, back) in zip(texts, rows)])]
            if digests:
                columns.append(pa.array([hashlib.sha256(table.joined(i).encode()).hexdigest() for i, _ in rows]))
                columns.append(pa.array([hashlib.sha256(back.encode()).hexdigest() for _, back in rows]))
            else:
                ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([i for i, _ in rows]))))
                if decoded:
                    columns.append(pa.array([back for _, back in rows], pa.string()))
            held = [piece.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays(held + columns, names=[f.name for f in schema])

    out = docs.select(*kept, docs[text].cast("string").alias("text")).mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[n for n, _, _ in own])
