"""SentencePiece encoding and decoding by a forward pass that words with a common prefix share.

Texts become words with their space mark; the distinct new words of a batch are sorted, which is a depth-first walk of
their trie, and the forward states of a prefix are kept for the next word that begins with it.

The state is that of Viterbi with BPE's own score: at each place of a word, the last piece of the best segmentation of
the prefix.  In a byte-pair model the best segmentation is the one that merging gives, and two pieces may stand side by
side in it exactly if merging their concatenation gives those two pieces again; so of all pieces that end at a place, the
one that may follow the state at its start is the one.  This gives the ids of the library's own encoder.  Runs of spaces
are merged directly, as the pieces for them share one score.

Defined results: a null text counts as empty and has no ids; characters without a piece become byte pieces; decoding
gives back the text, but for U+2581, which is the mark of a space; rows are handled one by one, so repeated rows give
repeated results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words
from .units import Memo, give_back

MARK = "\u2581"
#: Pairs of pieces that are remembered.
PAIRS = 200_000
_SPACES = re.compile("(?<=[^ ])(?= )")


class Pieces:
    """Pieces, ids and merge order of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.ids, self.score, self.byte_id, raw = {}, {}, [0] * 256, []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                raw.append(b"")
            else:
                self.ids[piece] = i
                self.score[piece] = model.get_score(i)
                raw.append(piece.replace(MARK, " ").encode())
        self.longest = max(map(len, self.ids))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.split: dict[str, tuple[str, str] | None] = {}
        self.last = None
        # for decoding: all pieces' bytes one after the other
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size

    def merge(self, text: str) -> list[str]:
        """Byte-pair merging: always the pair whose piece scores best, the leftmost of equals."""
        parts = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list = []

        def push(a):
            b = after[a]
            if b < len(parts) and (s := self.score.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-s, a, parts[a] + parts[b], b))

        for i in range(len(parts) - 1):
            push(i)
        while heap:
            _, a, both, b = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or after[a] != b or parts[a] + parts[b] != both:
                continue
            self.last = parts[a], parts[b]
            parts[a], parts[b] = both, None
            after[a] = after[b]
            if after[a] < len(parts):
                before[after[a]] = a
            push(a)
            if before[a] >= 0:
                push(before[a])
        return [p for p in parts if p is not None]

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge made this one, None if merging its characters does not give it."""
        known = self.split.get(piece)
        if known is None and piece not in self.split:
            known = self.split[piece] = self.last if self.merge(piece) == [piece] else None
        return known

    def follows(self, a: str, b: str) -> bool:
        """Whether b may stand after a, or with an empty a at the start.

        The merges that made a and b are undone, the latest first.  Whenever two pieces x and y met at the border, their
        own merge must not have come before the one that made x or y part of something longer.  Of equal merges
        the one further left comes first."""
        if len(b) > 1 and self.halves(b) is None:
            return False
        x, y, limit, also = a, b, float("inf"), False
        while a:
            both = self.score.get(x + y)
            if both is not None and (-both < limit or also and -both == limit):
                return False
            when_x = -self.score[x] if len(x) > 1 else -1.0
            when_y = -self.score[y] if len(y) > 1 else -1.0
            if when_x < 0 and when_y < 0:
                break
            if when_x > when_y:
                limit, also, x = when_x, False, self.halves(x)[1]
            else:
                limit, also, y = when_y, True, self.halves(y)[0]
        return True

    def fits(self, a: str, b: str) -> bool:
        """follows(), remembered."""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        known = self.pairs[a, b] = self.follows(a, b)
        return known

    def ids_of(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            i = self.ids.get(p)
            if i is None:
                out += [self.byte_id[b] for b in p.encode()]
            else:
                out.append(i)
        return out

    def encode_words(self, units: list[str]) -> list[list[int]]:
        """ids of each unit, in the order given."""
        out: list = [None] * len(units)
        ids, longest, pairs = self.ids, self.longest, self.pairs
        previous, last = "", [""]  # last[i]: last piece of the segmentation of the first i characters
        for k in sorted(range(len(units)), key=units.__getitem__):
            word = units[k].replace(" ", MARK)
            if word.startswith(MARK + MARK):
                out[k] = self.ids_of(self.merge(word))
                continue
            same = 0
            for x, y in zip(previous, word):
                if x != y:
                    break
                same += 1
            del last[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                best = word[end - 1]  # a character without a piece stands alone
                for start in range(max(0, end - longest), end):
                    piece = word[start:end]
                    if piece in ids:
                        left = last[start]
                        known = pairs.get((left, piece))
                        if known if known is not None else self.fits(left, piece):
                            best = piece
                            break
                last.append(best)
            pieces, end = [], len(word)
            while end:
                pieces.append(last[end])
                end -= len(last[end])
            out[k] = self.ids_of(pieces[::-1])
            previous = word
        return out

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """Texts of the ids, which stand one after the other."""
        sizes = self.raw_size[ids]
        at = np.concatenate([[0], np.cumsum(sizes)])
        data = self.raw[np.repeat(self.raw_at[ids] - at[:-1], sizes) + np.arange(at[-1])].tobytes()
        edges = at[np.concatenate([[0], np.cumsum(lengths)])].tolist()
        out = []
        for a, b in zip(edges[:-1], edges[1:]):
            text = data[a:b].decode("utf-8", "replace")
            out.append(text[1:] if text.startswith(" ") else text)
        return out


class PieceMemo(Memo):
    """Memo over units of a text with a space put before it: so its first word is a spaced one."""

    def __init__(self, pieces: Pieces, most: int = 300_000):
        self.pieces = pieces
        super().__init__(pieces.encode_words, most=most, first_spaced=True, split=lambda text: _SPACES.split(" " + text))

    def clear(self):
        super().clear()
        if len(self.pieces.pairs) > PAIRS // 2:
            self.pieces.pairs.clear()


@functools.cache
def codec(path: str) -> tuple[Pieces, PieceMemo]:
    """A worker process keeps it from task to task."""
    pieces = Pieces(path)
    return pieces, PieceMemo(pieces)


def encode_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), decoded (whether decoding gives the
    text back), and on demand ids."""

    def run(batches):
        pieces, memo = codec(model)
        for batch in batches:
            for first, texts in words.parts(batch.column(1)):
                given = [x or "" for x in texts.to_pylist()]
                ids, lengths = memo.encode(given)
                back = pieces.decode(ids, lengths)
                raw, ends = ids.astype("<u4"), np.cumsum(lengths)
                crc = [zlib.crc32(raw[e - n : e].tobytes()) for e, n in zip(ends.tolist(), lengths.tolist())]
                out = {
                    "doc_id": batch.column(0).slice(first, len(texts)), "n_tokens": pa.array(lengths, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()), "decoded": pa.array([a == b for a, b in zip(given, back)]),
                }
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)
                del texts, given, ids, back, raw, out
            del batch  # else it stays while the next one comes in
            give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded boolean" + ", ids array<int>" * with_ids)
