"""Token-ID output: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

A file holds the documents of one run of ascending ids.  Its ids are ranked by how often the file has them (ties: the
smaller id first), so frequent ids get one byte; the rank table stands in the file, which can be read alone.  A rank
takes 1 to 4 data bytes; two bits in the control bytes, which are stored apart, tell how many.  The decoder looks all
lengths of a control byte up in a table and gathers the data bytes in a few numpy passes.

Layout (little-endian): magic 8 bytes; documents, tokens, distinct ids, data bytes as u64; rank table u32; document ids
i64 and validity u8; document lengths u32; control bytes; data bytes.

Files are written by one pass over documents dealt out by ranges of the id, under names that no other attempt uses; the
manifest, a table written after them, says which files count and in which order.  A lost executor repeats its
tasks; files that no manifest row names are ignored.

Defined results: a null text counts as empty (it has the end id only); null ids come first; rows with equal ids stand
in the order of a hash of their text, then of the text; an empty table gives no file and no row.
"""

from __future__ import annotations

import functools
import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import shared, words
from .units import Memo, give_back

MAGIC = b"LSVB0001"
#: Lengths of the four values of a control byte.
_LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)
#: Ids that a numpy pass of pack() and unpack() takes at once, a multiple of four.
_STEP = 1 << 18


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rank table, control bytes, data bytes)."""
    counts = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.int64)  # as long as the vocabulary
    for i in range(0, len(ids), _STEP):
        counts += np.bincount(ids[i : i + _STEP], minlength=len(counts))
    values = np.flatnonzero(counts)
    order = np.lexsort((values, -counts[values]))
    rank_of = np.empty(len(counts), np.uint32)
    rank_of[values[order]] = np.arange(len(values), dtype=np.uint32)
    controls, datas = [np.zeros(0, np.uint8)], [np.zeros(0, np.uint8)]
    for i in range(0, len(ids), _STEP):
        ranks = rank_of[ids[i : i + _STEP]]
        size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
        padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
        padded[: len(ranks)] = size - 1
        four = padded.reshape(-1, 4)
        controls.append((four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8))
        raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
        datas.append(raw[np.arange(4) < size[:, None]])
    return values[order].astype("<u4"), np.concatenate(controls), np.concatenate(datas)


def unpack(table: np.ndarray, control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """ids, as they were given to pack()."""
    out, used = np.empty(n, table.dtype), 0
    for i in range(0, n, _STEP):
        size = _LENGTHS[control[i // 4 : (i + _STEP) // 4]].ravel()[: n - i].astype(np.int64)
        at = used + np.cumsum(size) - size
        used += int(size.sum())
        ranks = data[at].astype(np.uint32)
        for k in (1, 2, 3):
            longer = np.flatnonzero(size > k)
            if not len(longer):
                break
            ranks[longer] |= data[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
        out[i : i + _STEP] = table[ranks]
    return out


def to_file(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    table, control, data = pack(ids)
    head = np.array([len(doc_ids), len(ids), len(table), len(data)], "<u8")
    known = np.array([x is not None for x in doc_ids], np.uint8)
    numbers = np.array([x or 0 for x in doc_ids], "<i8")
    return b"".join(x.tobytes() if isinstance(x, np.ndarray) else x for x in (MAGIC, head, table, numbers, known, lengths.astype("<u4"), control, data))


def from_file(raw: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, lengths, ids)."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, tokens, distinct, size = (int(x) for x in np.frombuffer(raw, "<u8", 4, 8))
    at = 40

    def take(kind, n):
        nonlocal at
        x = np.frombuffer(raw, kind, n, at)
        at += x.nbytes
        return x

    table, numbers, known, lengths = take("<u4", distinct), take("<i8", docs), take("u1", docs), take("<u4", docs)
    control, data = take("u1", -(-tokens // 4)), take("u1", size)
    return [int(x) if k else None for x, k in zip(numbers, known)], lengths, unpack(table, control, data, tokens)


class Encoder:
    """ids of texts as the library gives them.  Its added tokens (strings such as <|endoftext|>, which become one id
    wherever they stand) cut a text into pieces; the pieces are encoded by a memo of their words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        tok = self.tok
        added = tok.get_added_tokens_decoder()
        #: Added tokens that take blanks or parts of words with them, or look at changed text, are left to the library.
        self.simple = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
        self.id_of = {t.content: i for i, t in added.items() if t.content}
        longest_first = sorted(self.id_of, key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.id_of else None
        batch = getattr(tok, "encode_batch_fast", tok.encode_batch)
        begins = np.array([(tok.id_to_token(i) or "").startswith("\u0120") for i in range(tok.get_vocab_size(True))])

        def many(units):
            return [e.ids for i in range(0, len(units), 4096) for e in batch(units[i : i + 4096], add_special_tokens=False)]

        def spaced(words):
            """Many words in one call: of a word's tokens the first one begins with the space, and no other does."""
            joined = [" " + " ".join(words[i : i + 256]) for i in range(0, len(words), 256)]
            got = (e.ids for i in range(0, len(joined), 64) for e in batch(joined[i : i + 64], add_special_tokens=False))
            ids = np.concatenate([np.array(x, np.int32) for x in got])
            return ids, np.diff(np.append(np.flatnonzero(begins[ids]), len(ids)))

        self.memo = Memo(many, spaced)

    def encode(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and how many each text has (with the end id)."""
        if self.added is None:
            return self.memo.encode(texts, end_id)
        odd = [i for i, t in enumerate(texts) if self.added.search(t)]
        if not odd:
            return self.memo.encode(texts, end_id)
        pieces, last, between = [], [], []  # pieces of all texts, where each text ends, and the id after each piece
        marked = set(odd)
        for i, text in enumerate(texts):
            if i not in marked:
                pieces.append(text)
                between.append(-1)
            elif self.simple:
                parts = self.added.split(text)
                pieces += parts[::2]
                between += [self.id_of[x] for x in parts[1::2]] + [-1]
            else:
                pieces.append("")
                between.append(-1)
            last.append(len(pieces))
        ids, lengths = self.memo.encode(pieces)
        after = np.array(between)
        ends = np.cumsum(lengths)
        where = np.flatnonzero(after >= 0)
        ids = np.insert(ids, ends[where], after[where])
        per_piece = np.concatenate([[0], np.cumsum(lengths + (after >= 0))])
        lengths = np.diff(np.concatenate([[0], per_piece[np.array(last)]]))
        if not self.simple:
            edges = np.concatenate([[0], np.cumsum(lengths)])
            own = [ids[a:b] for a, b in zip(edges[:-1], edges[1:])]
            for i in odd:
                own[i] = np.array(self.tok.encode(texts[i], add_special_tokens=False).ids, np.int32)
            ids, lengths = np.concatenate(own), np.array([len(x) for x in own])
        if end_id is not None:
            ids = np.insert(ids, np.cumsum(lengths), end_id)
            lengths = lengths + 1
        return ids, lengths


@functools.cache
def encoder(path: str) -> Encoder:
    """A worker process keeps it from task to task."""
    return Encoder(path)


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
    file_tokens: int = 4_000_000, batch_bytes: int = words.SLICE,
) -> DataFrame:
    """Write the files under `folder` and return the manifest: part, number, path, docs, tokens."""

    def write(batches):
        from pyspark import TaskContext

        part, memo, number = TaskContext.get().partitionId(), encoder(tokenizer), 0
        held_docs, held_lengths, held_ids, held = [], [], [], 0

        def flush():
            nonlocal number, held_docs, held_lengths, held_ids, held
            path = f"{folder}/tokens-{part:06d}-{number:06d}-{uuid.uuid4().hex}.lsvb"
            shared.put_file(path, to_file(held_docs, np.concatenate(held_lengths), np.concatenate(held_ids)))
            values = [part], [number], [path], [len(held_docs)], [held]
            kinds = pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()
            row = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["part", "number", "path", "docs", "tokens"])
            number, held_docs, held_lengths, held_ids, held = number + 1, [], [], [], 0
            return row

        for batch in batches:
            for first, texts in words.parts(batch.column(1), batch_bytes):
                ids, lengths = memo.encode([x or "" for x in texts.to_pylist()], end_id)
                held_docs += batch.column(0).slice(first, len(texts)).to_pylist()
                held_lengths.append(lengths)
                held_ids.append(ids)
                held += len(ids)
                del texts, ids, lengths
                if held >= file_tokens:
                    yield flush()
            del batch  # else it stays while the next one comes in
            give_back()
        if held_docs:
            yield flush()
            give_back()

    # rows that share id and text are the same to the files, and a number of their own spreads them over tasks
    text = shared.text_of(text_col)
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), shared.row_hash(text_col).alias("h"))
    order = "doc_id", "h", "text", "n"
    keyed = keyed.withColumn("n", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange("doc_id", "h", "n").sortWithinPartitions(*order).select("doc_id", "text")
    manifest = ordered.mapInArrow(write, "part int, number int, path string, docs long, tokens long")
    manifest.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32, and on demand ids (array<int>)."""
    spark = manifest.sparkSession
    # sums of parts, of which there are as many as write tasks, go to the driver; those of files don't
    before, parts = 0, []
    for row in manifest.groupBy("part").agg(F.sum("tokens").alias("tokens")).orderBy("part").toLocalIterator():
        parts.append((row.part, before))
        before += row.tokens
    starts = spark.createDataFrame(parts, "part int, part_start long")
    own = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("inside", F.coalesce(F.sum("tokens").over(own), F.lit(0))).join(F.broadcast(starts), "part")
    files = files.select("path", (F.col("part_start") + F.col("inside")).alias("start"))
    # a number of its own keeps the few manifest rows from being read by one task
    files = files.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), "path")

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, p = shared.task_fs(path)
                with store.open_input_file(p) as f:
                    docs, lengths, ids = from_file(f.read())
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = ids.astype("<u4")
                pieces = [raw[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist())]
                for a in range(0, len(docs), 4096):
                    b = a + 4096
                    out = {
                        "doc_id": pa.array(docs[a:b], pa.int64()), "start": pa.array(start + ends[a:b] - lengths[a:b], pa.int64()),
                        "n_tokens": pa.array(lengths[a:b].astype(np.int64)), "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in pieces[a:b]], pa.int64()),
                    }
                    if with_ids:
                        out["ids"] = pa.array([x.astype(np.int32) for x in pieces[a:b]], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_pydict(out)
                del ids, raw, pieces
                give_back()

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write all documents to files in the shared folder, and read them back."""
    return read_tokens(write_tokens(docs, shared.scratch(spark, "tokens"), tokenizer, **options))
