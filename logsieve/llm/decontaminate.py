"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names and units turn into typed placeholders, other words stay, in lower case.  Every
window of `window` template words of a benchmark item is hashed (an item of fewer words is one window by itself), and
windows of documents with the same hash are hits, if their slots agree: one benchmark value always meets the same
document value and the other way round, per type.  So an item is found when its numbers, names or units were exchanged, and
not when its words merely stand around unrelated values.  Slots agree exactly if the same places have equal values on both
sides; the places at which a value stands again are hashed with the template, so that the hash join is the check.

Number: a word of digits only.  Unit: a word of the list.  Name: a word with a capital first letter that does not
begin a sentence (no `.`, `!`, `?`, `:`, line break or start of the text before it).  A template window needs at least
half of its words to be none of these.  Every window, whatever its words, is also hashed by its real words in lower case
(an exact window), so copies of items that are mostly numbers, names or capitals are found too, in any letter case,
punctuation or line wrapping.

What stands around a window must not decide.  So a template window is read in several ways: a capital that begins a
sentence is a literal word, or a name; the first word, if it has a capital, is either; and runs are read word by word, or as
one slot: digits joined by a point or a comma (1,000.5), and names with only blanks between them (Mary Ann).

Benchmark hashes up to BROADCAST_WINDOWS go to every task; beyond, windows of documents and benchmark meet in a shuffled
join.  Both ways give the same rows.

Defined results: null texts count as empty and have no window; an item without words is never found; repeated items
and documents each count by themselves, and documents with null or repeated ids are dropped by id and text; an empty
benchmark contaminates nothing; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import shared, words
from .units import forget

WINDOW = 13
#: 16 MB of hashes.
BROADCAST_WINDOWS = 2_000_000

# Words that are units.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg lb lbs oz ton tons gram grams kilogram kilograms pound pounds ounce ounces ml l cl liter liters litre litres gallon gallons cup cups "
    "s sec min h hr hour hours minute minutes second seconds day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents percent degree degrees mph kmh kph"
).split()

LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3
_MARKS = np.array([0, 0x4E554D0000000001, 0x4E414D4500000003, 0x554E495400000005], np.uint64)
#: Keeps hashes of exact windows apart from those of templates.
_EXACT_MARK = np.uint64(0x4558414354000007)
_DIGITS = np.zeros(256, bool)
_DIGITS[48:58] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 13, 32]] = True
_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[[ord(c) for c in ".!?:\n\r"]] = True


def _fold(data: np.ndarray) -> np.ndarray:
    """ASCII and two-byte Latin capitals in lower case, in place lengths."""
    out = data.copy()
    upper = (data >= 65) & (data <= 90)
    out[upper] += 32
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    latin = after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    out[latin] += 32
    return out


_UNIT_HASHES: list = []


def _unit_hashes() -> np.ndarray:
    if not _UNIT_HASHES:
        data, offs = words.as_bytes(pa.array(UNITS))
        starts, ends, _ = words.spans(data, offs)
        _UNIT_HASHES.append(np.sort(words.span_hashes(data, starts, ends)))
    return _UNIT_HASHES[0]


class Tokens:
    """Template words of all texts in one reading: kinds, hashes, the first word of each and the n + 1 offsets of texts;
    plain: whether a token is one word with a capital; wanted: counts of tokens that a window needs one of each of."""

    def __init__(self, kinds, hashes, word, at, plain, wanted):
        self.kinds, self.hashes, self.word, self.at, self.plain = kinds, hashes, word, at, plain
        self.wanted = [_sums(w) for w in wanted]
        self.slots = _sums(kinds != LITERAL)
        self.marks = np.where(kinds == LITERAL, hashes, _MARKS[kinds])
        self.template = _rolling(self.marks)


def _sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(x, dtype=np.int64)])


def readings(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[Tokens]]:
    """(hashes of all words, n + 1 offsets of texts, readings of the words)."""
    data, offs = words.as_bytes(texts)
    starts, ends, at = words.spans(_fold(data), offs)
    if not len(starts):
        return np.zeros(0, np.uint64), at, []
    # lower case maps letters to letters: the same words stand in both, at other bytes
    low, low_offs = words.as_bytes(words.lowered(texts))
    hashes = words.span_hashes(low, *words.spans(low, low_offs)[:2])
    literal, capitals = np.zeros(len(starts), np.int8), np.zeros(len(starts), np.int8)
    # names: a capital first letter, and no sentence end between the last word and this one
    first = data[starts]
    second = data[np.minimum(starts + 1, len(data) - 1)]
    capital = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    stops = _sums(_SENTENCE_END[data])
    previous = np.concatenate([[0], ends[:-1]])
    opens = at[:-1][at[:-1] < len(starts)]
    previous[opens] = starts[opens]
    begins = stops[starts] > stops[previous]
    begins[opens] = True
    literal[capital & ~begins] = capitals[capital] = NAME
    units = _unit_hashes()
    where = np.minimum(np.searchsorted(units, hashes), len(units) - 1)
    unit = units[where] == hashes
    digits = _sums(_DIGITS[data])
    number = digits[ends] - digits[starts] == ends - starts
    for kinds in (literal, capitals):
        kinds[unit], kinds[number] = UNIT, NUMBER
    # runs: what stands between a word and the last one
    gap = starts - previous
    blanks = _sums(_BLANK[data])
    apart = blanks[starts] - blanks[previous] == gap
    joint = (gap == 1) & np.isin(data[previous.clip(max=len(data) - 1)], (44, 46))
    apart[opens] = joint[opens] = False
    whole, every, unlike = _rolling(hashes), np.arange(len(starts)), literal != capitals
    named = capitals == NAME
    out = [Tokens(literal, hashes, every, at, named, []), Tokens(capitals, hashes, every, at, named, [unlike])]
    for kinds, needs in ((literal, False), (capitals, True)):
        again = np.zeros(len(kinds), bool)
        again[1:] = (kinds[1:] == kinds[:-1]) & ((kinds[1:] == NAME) & apart[1:] | (kinds[1:] == NUMBER) & joint[1:])
        if again.any():
            begin = np.flatnonzero(~again)
            size = np.diff(np.append(begin, len(kinds)))
            both = np.where(size > 1, words.mix(whole(begin, size) + size.astype(np.uint64)), hashes[begin])
            change = np.add.reduceat(unlike.astype(np.int64), begin) > 0
            wanted = [size > 1, change] if needs else [size > 1]
            out.append(Tokens(kinds[begin], both, begin, np.searchsorted(begin, at), named[begin] & (size == 1), wanted))
    return hashes, at, out


def _rolling(marks: np.ndarray):
    """Sums of marks times powers: the sum of any run of marks is one difference, times the power taken back."""
    up, down = words._powers_to(len(marks) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(marks * up[: len(marks)], dtype=np.uint64)])
    return lambda begin, n: (total[begin + n] - total[begin]) * down[begin]


def repeats(kinds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each row of (windows, places) kinds and values a hash of which places hold a value of an earlier place of the
    same kind, and of which; 0 if none does.  Two windows of one template agree one to one exactly if theirs are equal."""
    out = np.zeros(len(kinds), np.uint64)
    for j in range(1, kinds.shape[1]):
        first = np.full(len(kinds), j)
        for i in range(j - 1, -1, -1):
            first[(kinds[:, i] == kinds[:, j]) & (values[:, i] == values[:, j]) & (kinds[:, j] != LITERAL)] = i
        again = first < j
        if again.any():
            out[again] += words.mix((first[again] + 64 * j).astype(np.uint64))
    return out


def _begins(at: np.ndarray, n: int, most: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(text, first token) of the runs of n tokens inside a text, of texts with most == n if it is given."""
    counts = np.maximum(np.diff(at) - n + 1, 0)
    if most is not None:
        counts[most != n] = 0
    text = np.repeat(np.arange(len(counts)), counts)
    return text, at[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts))


def windows(texts: pa.Array, lengths: tuple[list[int], list[int]] | None, window: int, known=None):
    """(text number, first word, length, template hash, hash) of the windows, one array each.  lengths: those of exact and
    of template windows; None: each text has windows of its own length, `window` at most.  known: sorted template hashes;
    others are left out before the slots are read."""
    hashes, at, ways = readings(texts)
    out = []

    def add(text, word, n, template, full=None):
        """full(rows): hashes of these rows."""
        keep = np.arange(len(text))
        if known is not None:
            where = np.minimum(np.searchsorted(known, template), len(known) - 1)
            keep = np.flatnonzero(known[where] == template)
        if len(keep):
            exact = template[keep] if full is None else full(keep)
            out.append((text[keep], word[keep], np.full(len(keep), n), template[keep], exact))

    def all_lengths(own, k):
        most = np.minimum(np.diff(own), window) if lengths is None else None
        return most, sorted({int(n) for n in most if n}) if lengths is None else lengths[k]

    most, these = all_lengths(at, 0)
    real = _rolling(hashes)
    for n in these:
        text, begin = _begins(at, n, most)
        add(text, begin, n, words.mix(real(begin, n) + np.uint64(n)) ^ _EXACT_MARK)

    for t in ways:
        most, these = all_lengths(t.at, 1)
        for n in these:
            text, begin = _begins(t.at, n, most)
            some = np.ones(len(begin), bool)
            for w in t.wanted:
                some &= w[begin + n] > w[begin]
            filled = t.slots[begin + n] - t.slots[begin]
            turn = some & t.plain[begin]  # the first word is a name or not
            other = np.where(t.kinds[begin] == NAME, -1, 1)
            for turned in (False, True):
                count = filled + other if turned else filled
                good = np.flatnonzero((turn if turned else some) & (count > 0) & (2 * (n - count) >= n))
                if not len(good):
                    continue
                b, c = begin[good], count[good]
                sums = t.template(b, n)
                if turned:
                    sums = sums + np.where(t.kinds[b] == NAME, t.hashes[b], _MARKS[NAME]) - t.marks[b]
                template = words.mix(sums + np.uint64(n))

                def full(rows, b=b, c=c, n=n, t=t, template=template, turned=turned):
                    found = template[rows].copy()
                    two = np.flatnonzero(c[rows] > 1)
                    for k in range(0, len(two), 1 << 15):
                        part = two[k : k + (1 << 15)]
                        places = b[rows[part]][:, None] + np.arange(n)
                        kinds = t.kinds[places]
                        if turned:
                            kinds[:, 0] = np.where(kinds[:, 0] == NAME, LITERAL, NAME)
                        found[part] += repeats(kinds, t.hashes[places])
                    return found

                add(text[good], t.word[b], n, template, full)
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64), np.zeros(0, np.uint64), at
    return *(np.concatenate(x) for x in zip(*out)), at


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """item_id, length, template, hash of each window; an item of fewer words has one
    window of its own length."""

    def cut(batches):
        for batch in batches:
            for first, texts in words.parts(batch.column(1)):
                text, _, length, template, found, _ = windows(texts, None, window)
                ids = batch.column(0).slice(first, len(texts)).take(pa.array(text))
                hashes = [pa.array(x.view(np.int64)) for x in (template, found)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(length, pa.int32()), *hashes], ["item_id", "length", "template", "hash"])

    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, "item_id long, length int, template long, hash long")


def _document_windows(docs: DataFrame, lengths: list[int], window: int, known) -> DataFrame:
    """doc_id, h, row, at, length, hash of the windows of docs (doc_id, text, h, row); of those whose template is in `known`
    (a broadcast sorted array) if given."""

    def cut(batches):
        forget()
        table = known.value if known is not None else None
        for batch in batches:
            for first, texts in words.parts(batch.column(1)):
                text, word, length, _, found, at = windows(texts, (lengths, lengths), window, table)
                for a in range(0, len(text), 1 << 16):
                    t = text[a : a + (1 << 16)]
                    own = [batch.column(c).slice(first, len(texts)).take(pa.array(t)) for c in (0, 2, 3)]
                    b = slice(a, a + len(t))
                    where = [pa.array((word[b] - at[t]).astype(np.int32)), pa.array(length[b].astype(np.int32)), pa.array(found[b].view(np.int64))]
                    yield pa.RecordBatch.from_arrays([*own, *where], ["doc_id", "h", "row", "at", "length", "hash"])

    return docs.mapInArrow(cut, "doc_id long, h long, row long, at int, length int, hash long")


def _matches(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, window: int, broadcast_windows: int) -> DataFrame:
    """doc_id, h, row, at, length, items: document windows with consistent slots, and the sorted ids of all items that have
    them.  A window that is found in several ways has several rows."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), shared.row_hash(text_col).alias("h"))
    docs = docs.withColumn("row", F.monotonically_increasing_id())
    known = shared.keep(benchmark_windows(benchmark, window=window).distinct(), "benchmark-windows")
    lengths = sorted(r.length for r in known.select("length").distinct().toLocalIterator())  # at most `window` of them
    templates = known.select("template").distinct()
    table = None
    if templates.limit(broadcast_windows + 1).count() <= broadcast_windows:
        found = np.fromiter((r.template for r in templates.toLocalIterator()), np.int64)  # at most broadcast_windows
        if not len(found):
            return spark.createDataFrame([], "doc_id long, h long, row long, at int, length int, items array<long>")
        table = spark.sparkContext.broadcast(np.sort(found.view(np.uint64)))
    hits = _document_windows(docs, lengths, window, table)
    key = ["length", "hash"]
    hits = shared.keep(hits.join(known.select(key).distinct(), key, "left_semi"), "window-hits")
    # many documents share a passage
    pairs = shared.keep(hits.groupBy(key).agg(F.count("*").alias("n")), "hit-windows")
    listed = known.join(pairs, key).groupBy(F.struct(*key).alias("window"), "n")
    listed = shared.keep(listed.agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.count_if(F.col("item_id").isNull()).alias("nulls")), "listed-windows")
    listed = listed.withColumn("items", F.when(F.col("nulls") > 0, F.concat(F.array(F.lit(None).cast("long")), "items")).otherwise(F.col("items")))
    hits = hits.select("doc_id", "h", "row", "at", F.struct(*key).alias("window"))
    matched = shared.join_counted(hits, listed.drop("nulls"), "window", "n", docs.count())
    return matched.select("doc_id", "h", "row", "at", "window.length", "items")


def _counted(matched: DataFrame) -> DataFrame:
    """A window that is found in several ways counts once."""
    return matched.groupBy("doc_id", "item_id").agg(F.count_distinct("row", "at", "length").alias("n_windows"))


def benchmark_links(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS
) -> DataFrame:
    """doc_id, item_id, n_windows: how many windows of the item a document has, with consistent slots.  A window that
    several items have counts for each of them.  Only contaminated documents have rows."""
    matched = _matches(docs, benchmark, id_col, text_col, window, broadcast_windows)
    return _counted(matched.select("doc_id", "row", "at", "length", F.explode("items").alias("item_id")))


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS
) -> DataFrame:
    """benchmark_links() in short: a window that several items have counts for the one with the least id only."""
    matched = _matches(docs, benchmark, id_col, text_col, window, broadcast_windows)
    return _counted(matched.select("doc_id", "row", "at", "length", F.array_min("items").alias("item_id")))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without those that have a benchmark window.  A row is known by its id and text."""
    matched = _matches(docs, benchmark, id_col, text_col, **({"window": WINDOW, "broadcast_windows": BROADCAST_WINDOWS} | options))
    found = shared.keep(matched.select("doc_id", "h").distinct(), "contaminated")
    return shared.without_rows(docs, found, id_col, shared.row_hash(text_col))
