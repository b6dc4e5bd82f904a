"""Small tests of the training-data operators: defined cases, and comparisons with brute force."""

import collections
import io
import random
import re
import tracemalloc
import weakref
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logsieve.llm import cotrain, decontaminate, exact_dedup, language_id, near_dups, piece_codec, pii, queries, token_files, units, url_filter, warc_zip

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, sha string, seq long"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "src1", len(t or ""), "x", 1) for i, t in rows], DOCS).repartition(3)


ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (4, "one two three four five six"), (5, "one two three four five six"), (None, "a"), (6, "x " * 60_000), (7, "É à\tü\n\n z "), (8, "tie"), (9, "tie")]


def sql_rows(name, tables):
    import duckdb

    c = duckdb.connect()
    for t in tables:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    r = c.sql(queries.ORACLE_SQL[name])
    return [dict(zip(r.columns, x)) for x in r.fetchall()]


@pytest.mark.parametrize("name,tables", [("op1_warc_zip", ["pages"]), ("op3_exact_dedup", ["documents"]), ("op5_url_filter", ["pages"])])
def test_sql(spark, name, tables):
    got = [r.asDict() for r in queries.QUERIES[name](spark, SF).collect()]
    want = sql_rows(name, tables)
    key = lambda r: sorted((k, str(v)) for k, v in r.items())
    assert sorted(map(key, got)) == sorted(map(key, want)) and got


# ---- 1 ---------------------------------------------------------------------------------------------------------


def test_warc_cases(spark):
    long, other = "ä" * 600, "b" * 1000
    rows = [(1, "u", long), (2, "u\nv", long), (3, None, other), (4, "", None), (5, "u", "s"), (6, "u", "s"), (None, "u", other), (7, "u", "c" * 999), (8, "u", "c" * 999), (8, "u", other)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = {(r.page_id, r.payload_bytes): (r.record_type, r.refers_to, r.payload) for r in warc_zip.read_packages(warc_zip.write_packages(pages, warc_zip.shared.scratch(spark, "w")), with_payload=True, records_a_task=2).collect()}
    assert got[1, 1200] == ("revisit", 2, None) and got[2, 1200] == ("response", None, long) and got[4, 0] == ("response", None, "")
    assert got[3, 1000][:2] == ("revisit", 8) and got[None, 1000][:2] == ("revisit", 8) and got[8, 1000] == ("response", None, other) and len(got) == 10
    assert all(got[i, n][0] == "response" for i, n in ((5, 1), (6, 1), (7, 999), (8, 999)))
    assert warc_zip.warc_round_trip(spark, pages.limit(0)).count() == 0


def test_warc_large_payloads(spark):
    """Payloads of several MB, very long urls and clashing extra columns; as many tasks as parts."""
    big = "".join(chr(97 + i * 7 % 26) for i in range(3_000_000))
    rows = [(1, "u" * 100_000, big, 7, "x"), (2, "u", big + "é", 7, "x"), (3, "v", big, 7, None)] + [(10 + i, "w", "s", 7, "x") for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, id long, sha string").repartition(2)
    manifest = warc_zip.write_packages(pages, warc_zip.shared.scratch(spark, "w"))
    read = warc_zip.read_packages(manifest, records_a_task=2)
    assert read.rdd.getNumPartitions() == sum(-(-r.records // 2) for r in manifest.collect())
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in read.collect()}
    assert got == {1: (3_000_000, "revisit", 3), 2: (3_000_002, "response", None), 3: (3_000_000, "response", None)} | {10 + i: (1, "response", None) for i in range(9)}


def test_zip64_and_ranges():
    records = [warc_zip.record("response", i, "u", "00" * 20, 3, b"abc") for i in range(5)]
    for wide in (False, True):
        raw = warc_zip.package(records, wide)
        assert [f["warc-record-id"] for f, _ in warc_zip.read_records(io.BytesIO(raw), len(raw), [3, 1])] == ["<urn:record:3>", "<urn:record:1>"]
    # a real ZIP64 end record: the fields of the old one are full
    raw = warc_zip.package(records)
    end = raw.rfind(b"PK\x05\x06")
    count, length, at = int.from_bytes(raw[end + 10 : end + 12], "little"), raw[end + 12 : end + 16], raw[end + 16 : end + 20]
    e64 = b"PK\x06\x06" + (44).to_bytes(8, "little") + b"\0" * 12 + count.to_bytes(8, "little") * 2 + length + b"\0" * 4 + at + b"\0" * 4
    locator = b"PK\x06\x07" + b"\0" * 4 + end.to_bytes(8, "little") + (1).to_bytes(4, "little")
    big = raw[:end] + e64 + locator + b"PK\x05\x06" + b"\0" * 4 + b"\xff" * 12 + b"\0" * 2
    assert len(list(warc_zip.read_records(io.BytesIO(big), len(big)))) == 5


# ---- 2 ---------------------------------------------------------------------------------------------------------


def test_pii_base_patterns():
    rnd = random.Random(1)
    for _ in range(20_000):
        t = "".join(rnd.choice("a1.@-+ 4") for _ in range(rnd.randint(0, 26)))
        base = pii.base_spans(t)
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        assert base[0] == [m.span() for m in pii.EMAIL.finditer(t)]
        assert base[1] == [m.span() for m in pii.IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        assert base[2] == [m.span() for m in pii.CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        assert base[3] == [m.span() for m in pii.PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]


@pytest.mark.parametrize(
    "text,kind,found",
    [
        ("mail bob [at] site (dot) com now", "email", "bob [at] site (dot) com"), ("ask bob at site dot com", "email", "bob at site dot com"), ("х аlice@exаmple.cоm", "email", "аlice@exаmple.cоm"),
        ("at 10[.]1[.]2[.]3 x", "ip", "10[.]1[.]2[.]3"), ("full １９２.168.0.1 y", "ip", "１９２.168.0.1"), ("call +one two zero two five five five zero one two three", "phone", "+one two zero two five five five zero one two three"),
        ("card four one one one 1111 1111 1111", "card", "four one one one 1111 1111 1111"),
    ],
)
def test_pii_disguises(text, kind, found):
    spans = pii.method_spans(text, pii.base_spans(text))
    assert [text[a:b] for a, b in spans[pii.KINDS.index(kind)]] == [found]


@pytest.mark.parametrize("found", ["jane at company dot xyz", "jane at company dot cloud", "jane at example.com", "jane at mail.example.sg", "a\tat\tb\tdot\tly", "bob@site dot hk", "jane AT example dot co dot uk"])
def test_pii_bare_words(found):
    for text in (found, f"write {found} now", f"({found}), please."):
        spans = pii.method_spans(text, pii.base_spans(text))
        assert [text[a:b] for a, b in spans[0]] == [found]
    for text in ("see you at noon. Then we go", "look at node.js5 now", "it is at step 3.next"):
        assert pii.method_spans(text, pii.base_spans(text)) == pii.base_spans(text)


@pytest.mark.parametrize("text", ["he is at home dot", "one two", "look at this dot that", "", "plain a@b.co and 1.2.3.4", "rest at the end"])
def test_pii_leaves_clean_text(text):
    base = pii.base_spans(text)
    assert pii.method_spans(text, base) == base


def test_pii_rows(spark):
    rows = pii.find_pii(docs(spark, [*ODD, (10, "a@b.co, +1 (988) 555-2485, 42.144.35.254, 4041894974608795")])).collect()
    assert len(rows) == len(ODD) + 1
    r = next(r for r in rows if r.doc_id == 10)
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1) and r.spans.startswith("email:0:6,ip:")
    assert pii.find_pii(docs(spark, ODD).limit(0)).count() == 0
    assert pii.masked("x a@b.co", [[(2, 8)], [], [], []]) == "x [EMAIL]"


def disguise(rnd, kind):
    """(text of an identifier in disguise, the same in plain)."""
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6)))
    glyph = str.maketrans("aeocx1", "аеосх１")
    if kind == "email":
        at = rnd.choice([" [at] ", "(at)", " { AT } ", "<@>", " at ", "\tat\n"])
        dots = [rnd.choice([" dot ", "[.]", " (dot) ", "."] if at.strip(" \t\n") != "at" else [" dot ", "."]) for _ in range(rnd.randint(1, 2))]
        return word() + at + word() + "".join(d + x for d, x in zip(dots, ["uk", "com"][-len(dots) :]))
    if kind == "ip":
        dots = rnd.choice([["[.]"] * 3, [" dot "] * 3, ["(dot)", ".", "."], [".", ".", "{.}"]])
        return "".join(str(rnd.randint(0, 255)) + d for d in dots) + str(rnd.randint(0, 255))
    if kind == "phone":
        return ("+1 (988) 555-24" + str(rnd.randint(10, 99))).translate(str.maketrans("0123456789", "０１２３４５６７８９" if rnd.random() < 0.5 else "٠١٢٣٤٥٦٧٨٩"))
    return rnd.choice(["four one one one 1111 1111 1111", "４１１１ 1111 1111 1111", "4111 one one one one 1111 1111"])


def test_pii_planted_disguises():
    rnd = random.Random(4)
    filler = ["tree", "x1", "the", "says", "Mary", "é", "漢字", "17"]
    for _ in range(3000):
        text, want = "", []
        for _ in range(rnd.randint(1, 4)):
            text += " ".join(rnd.choice(filler[:-1]) for _ in range(rnd.randint(1, 3))) + rnd.choice([", see ", "; ", " | ", ": "])
            kind = rnd.choice(pii.KINDS)
            found = disguise(rnd, kind)
            want.append((pii.KINDS.index(kind), len(text), len(text) + len(found)))
            text += found + rnd.choice(["; then ", ", ", " | ", ". "])
        spans = pii.method_spans(text, pii.base_spans(text))
        assert [(k, a, b) for k, own in enumerate(spans) for a, b in own] == sorted(want), text


def test_pii_digests(spark):
    """base_sha256 and spans of rows against the plain patterns."""
    import hashlib

    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice(["a@b.co", "1.2.3.4", "+1 988 555 2485", "4111 1111 1111 1111", "x", "é", "300.1.1.1", "x at y dot com", "9" * 14]) for _ in range(rnd.randint(0, 9)))) for i in range(60)]
    text, checks = dict(rows), {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and pii.luhn(d), "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15}
    for r in pii.find_pii(docs(spark, rows)).collect():
        base = [f"{k}:{m.start()}:{m.end()}" for k, p in zip(pii.KINDS, (pii.EMAIL, pii.IP, pii.CARD, pii.PHONE)) for m in p.finditer(text[r.doc_id]) if checks[k](m[0])]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r.spans.split(",")) | {""}
        more = [x for x in r.spans.split(",") if x and x not in base]
        assert len(more) == text[r.doc_id].count("x at y dot com") and all(text[r.doc_id][slice(*map(int, x.split(":")[1:]))] == "x at y dot com" for x in more)
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(base)


def test_pii_time_grows_with_the_text():
    import time

    for unit in ("x dot ", "x at ", "( ", "a (at) b dot ", "1 dot ", "+(((((", "one two ", "a@", "1.", " " * 500 + "dot"):
        text = unit * (400_000 // len(unit))
        begin = time.time()
        pii.method_spans(text, pii.base_spans(text))
        assert time.time() - begin < 2, unit


# ---- 3 ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("options", [{}, {"max_bits": 1 << 3}, {"max_bits": 1 << 16, "bits_per_row": 1 << 14}])
def test_exact_dedup(spark, options):
    got = sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs(spark, ODD), **options).collect())
    assert len(got) == len(ODD)
    by = collections.Counter(got)
    assert by[1, 2, 2, False] == by[2, 2, 2, True] == by[0, 3, 3, False] == by[4, 5, 2, False] == by[8, 9, 2, False] == by[6, 6, 1, True] == 1
    assert by[3, 3, 3, True] == by[3, 3, 3, False] == 1
    left = exact_dedup.without_copies(docs(spark, ODD), **options)
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 5, 6, 7, 9] and left.columns == docs(spark, ODD).columns
    assert exact_dedup.exact_dedup(docs(spark, ODD).limit(0)).count() == 0
    unique = docs(spark, [(i, f"t{i % 50}") for i in range(500)])
    assert sorted(r.doc_id for r in exact_dedup.without_copies(unique).collect()) == list(range(450, 500))


# ---- 4 and 7 ---------------------------------------------------------------------------------------------------


def test_pieces_against_library(spark):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(3)
    texts = [t or "" for _, t in ODD] + ["  héllo  wörld\n foo\tbar ☃", "<s> <0x0A>", "日本語 テキスト", "    " * 9 + "x", "a" * 3000, "🙂🙂 ok"]
    texts += ["".join(rnd.choice("abcdefghijetaoins   \n.,éß漢") for _ in range(rnd.randint(0, 40))) for _ in range(800)]
    texts += [" ".join("".join(rnd.choice(["the", "ing", "er", "un", "tion", "s", "In"]) for _ in range(rnd.randint(1, 6))) for _ in range(5)) for _ in range(800)]
    ids, lengths = piece_codec.PieceMemo(piece_codec.Pieces(path), most=50).encode(texts)
    ends = np.cumsum(lengths)
    for t, e, n in zip(texts, ends, lengths):
        assert ids[e - n : e].tolist() == model.encode(t), t
    assert piece_codec.Pieces(path).decode(ids, lengths) == texts
    got = piece_codec.encode_texts(docs(spark, ODD), path, with_ids=True).collect()
    assert len(got) == len(ODD) and all(r.decoded and len(r.ids) == r.n_tokens and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)


def test_pieces_hold_one_batch(spark):
    """A batch is gone before the next one comes in."""

    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    seen = []

    def batches():
        for i in range(3):
            held = [pa.RecordBatch.from_pydict({"doc_id": [i], "text": ["one two"]})]
            seen.append(weakref.ref(held[0]))
            yield held.pop()
            assert seen[-1]() is None

    out = piece_codec.encode_texts(Docs(), P.path("piece_bpe_32k.model"))(batches())
    assert [b.column(0).to_pylist() for b in out] == [[0], [1], [2]]


def test_units_are_whole():
    for t in ["a b", " a", "a  b", "a\nb c", "a\n\nb", "a \nb", "x y z", "", "a ", "é b\tc d"]:
        assert "".join(units.word_units(t)) == t


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = [r for r in ODD if r[0] != 3] + [(20 + i, f"word{i} <|endoftext|> " * (i % 5)) for i in range(30)]
    rows += [(60, "<|endoftext|>"), (61, "a <|endoftext|><|endoftext|>b \n"), (62, "  <|endoftext|>  x<|endof"), (63, "<|endoftext|")]
    frame = docs(spark, rows)
    manifest = token_files.write_tokens(frame, token_files.shared.scratch(spark, "t"), path, file_tokens=100, batch_bytes=200)
    got = sorted(token_files.read_tokens(manifest, with_ids=True).collect(), key=lambda r: r.start)
    assert manifest.count() > 3 and [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    text, start = dict(rows), 0
    for r in got:
        ids = tok.encode(text[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, list(r.ids), r.ids_crc32) == (start, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.token_files(spark, frame.limit(0), path).count() == 0
    again = [(1, "a b"), (1, "a b"), (None, None), (None, ""), (1, "c")]
    twice = sorted(token_files.token_files(spark, docs(spark, again), path, file_tokens=2).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.n_tokens) for r in twice][:2] == [(None, 1)] * 2 and sorted(r.n_tokens for r in twice) == [1, 1, 2, 3, 3]


@pytest.mark.parametrize("options", [{}, {"lstrip": True}, {"normalized": True, "rstrip": True}])
def test_added_tokens(tmp_path, options):
    from tokenizers import AddedToken, Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.add_tokens([AddedToken("<x>", **options), AddedToken("<x>y", **options)])
    tok.save(path := str(tmp_path / "tok.json"))
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(["<x>", "y", " ", "  ", "a", "the", "\n", "<|endoftext|>", "<x"]) for _ in range(rnd.randint(0, 12))) for _ in range(400)]
    ids, lengths = token_files.Encoder(path).encode(texts, 2)
    ends = np.cumsum(lengths)
    for t, e, n in zip(texts, ends, lengths):
        assert ids[e - n : e].tolist() == tok.encode(t, add_special_tokens=False).ids + [2], t


def test_pack_round_trip():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 5, 1000):
        for high in (3, 300, 70_000):
            ids = rnd.integers(0, high, n).astype(np.uint32)
            assert (token_files.unpack(*token_files.pack(ids), n) == ids).all()
    raw = token_files.to_file([5, None], np.array([2, 1]), np.array([7, 8, 7]))
    back = token_files.from_file(raw)
    assert back[0] == [5, None] and back[1].tolist() == [2, 1] and back[2].tolist() == [7, 8, 7]


def test_pack_needs_little_memory():
    """Beside the ids and the result a file of any size takes a few MB."""
    ids = np.random.default_rng(1).zipf(1.3, 3_000_001).clip(1, 70_000).astype(np.int32)
    tracemalloc.start()
    try:
        packed = token_files.pack(ids)
        most = tracemalloc.get_traced_memory()[1] / len(ids)
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        back = token_files.unpack(*packed, len(ids))
        more = (tracemalloc.get_traced_memory()[1] - before) / len(ids)
    finally:
        tracemalloc.stop()
    assert (back == ids).all() and most < 8 and more < 10, (most, more)


# ---- 6 and 9 ---------------------------------------------------------------------------------------------------


def test_language(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train = frame.withColumn("lang", F.when(F.col("doc_id") % 3 != 0, F.col("lang")))
    got = language_id.identify(train, host=F.col("source")).join(frame.select("doc_id", "lang"), "doc_id").filter("doc_id % 3 = 0").toPandas()
    assert (got.language == got.lang).mean() > 0.97 and got.kept.mean() > 0.99
    odd = language_id.identify(docs(spark, ODD)).collect()
    assert len(odd) == len(ODD) and {r.doc_id for r in odd if not r.kept} == {1, 2}
    assert language_id.identify(docs(spark, ODD).limit(0)).count() == 0
    assert not any(r.kept for r in language_id.identify(docs(spark, ODD).withColumn("lang", F.lit(None).cast("string"))).collect())
    assert language_id.accepted(docs(spark, ODD)).columns == docs(spark, ODD).columns


def test_language_keeps_rare_labels(spark):
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k: alphabet[k // 26] * 2 + alphabet[k % 26] * 2
    rows = [(k, f"{word(k)} " * 9, f"l{k:02d}") for k in range(70)] + [(1000 + i, "the common tongue of most rows", "zz") for i in range(200)] + [(2000 + k, f"{word(k)} " * 7, None) for k in range(70)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.language for r in language_id.identify(frame, train_rows=20).filter("doc_id >= 2000").collect()}
    assert got == {2000 + k: f"l{k:02d}" for k in range(70)}


def test_language_evidence(spark, monkeypatch):
    given = {}
    monkeypatch.setattr(language_id, "identify", lambda docs, **options: given.update(options) or docs)
    corpus = queries.op6_language_id(spark, SF)
    assert given.keys() == {"declared", "host", "suffix", "carry"}
    # the label that trains is no evidence, and pages have no label
    assert corpus.filter("lang is not null and (declared is not null or suffix is not null)").isEmpty()
    assert corpus.filter("page_id is not null and lang is not null").isEmpty() and not corpus.filter("declared is not null").isEmpty()
    monkeypatch.undo()
    rows = [(i, t, l, l * 2, l * 3) for i in range(30) for t, l in (("aaa bab", "a"), ("ccc dcd", "c"))] + [(100, "eee", None, "aa", None), (101, "eee", None, "cc", None), (102, "eee", None, None, "aaa"), (103, "eee", None, None, "ccc"), (104, "aaa", None, "new", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, said string, ending string")
    got = {r.doc_id: r.language for r in language_id.identify(frame, declared=F.col("said"), suffix=F.col("ending")).filter("doc_id >= 100").collect()}
    assert got == {100: "a", 101: "c", 102: "a", 103: "c", 104: "a"}


def brute_languages(rows, strength=5.0):
    """(language, probability) of (text, label, declared, host, suffix) rows, by loops over single trigrams."""
    cls = lambda b: b - 96 if 97 <= b <= 122 else 27 + (b - 128) % 37 if b >= 128 else 0
    def grams(t):
        c = [cls(b) for b in (" " + (t or "").lower() + " ").encode()]
        return [x for x in (c[i] << 12 | c[i + 1] << 6 | c[i + 2] for i in range(len(c) - 2)) if x]
    names = sorted({r[1] for r in rows if r[1]})
    counts = {n: collections.Counter(g for r in rows if r[1] == n for g in grams(r[0])) for n in names}
    cells, every = 1 << 18, collections.Counter()
    for c in counts.values():
        every += c
    mass = sum(every.values()) + 0.5 * len(names) * cells
    like = lambda g, n: 0.98 * (counts[n][g] + 0.5) / (sum(counts[n].values()) + 0.5 * cells) + 0.02 * (every[g] + 0.5 * len(names)) / mass
    per, top = [], []
    for r in rows:
        gs = grams(r[0])
        per.append([float(np.mean([np.log(like(g, n)) for g in gs])) if gs else 0.0 for n in names])
        top.append(int(np.argmax(per[-1])) if gs else None)
    k = len(names)
    tally = lambda of: np.array([sum(1 for i in of if top[i] == j) for j in range(k)], float)
    where = lambda f: [i for i, r in enumerate(rows) if f(r)]
    root = (tally(range(len(rows))) + 1) / (sum(t is not None for t in top) + k)
    domain = lambda h: ".".join(h.split(".")[-2:]) if h.count(".") > 1 else h
    out = []
    for i, (_, _, declared, host, suffix) in enumerate(rows):
        total = np.array(per[i]) * min(len(grams(rows[i][0])), 40.0)
        if host is None:
            total += np.log(root)
        else:
            own = tally(where(lambda r: r[3] == host))
            others = tally(where(lambda r: r[3] is not None and r[3] != host and domain(r[3]) == domain(host)))
            above = (others + strength * root) / (others.sum() + strength)
            total += np.log((own + strength * above) / (own.sum() + strength))
        for c, value in ((2, declared), (4, suffix)):
            if value is not None:
                known = tally(where(lambda r: r[c] is not None))
                total += np.log((tally(where(lambda r: r[c] == value)) + 0.1) / (known + 0.1 * len({r[c] for r in rows if r[c] is not None})))
        p = np.exp(total - total.max())
        p /= p.sum()
        out.append((names[int(p.argmax())], float(p.max()), len(grams(rows[i][0]))) if grams(rows[i][0]) else (None, 0.0, 0))
    return out


def test_language_against_brute_force(spark):
    rnd = random.Random(11)
    speech = {"a": "aabeio", "b": "bcdfo", "c": "éacßxü"}
    rows = []
    for _ in range(150):
        n = rnd.choice("aaabc")
        text = " ".join("".join(rnd.choice(speech[n]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(0, 5)))
        host = rnd.choice([None, "src1", "x.org", "www.x.org", f"{n}.x.org", f"{n}.y.com", "www.y.com"])
        rows.append((rnd.choice([text, text, text, None, ""]), rnd.choice([n, None]), rnd.choice([n, None, "zz", "a"]), host, rnd.choice([None, "org", n])))
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, said string, place string, ending string")
    got = language_id.identify(frame.repartition(3), declared=F.col("said"), host=F.col("place"), suffix=F.col("ending")).collect()
    want = brute_languages(rows)
    assert len(got) == len(rows)
    for r in got:
        language, p, n = want[r.doc_id]
        assert r.n_trigrams == n and abs(r.probability - p) < 1e-4 and (r.language == language or p < 0.51) and r.kept == (n > 0 and r.probability >= 0.5)


def test_page_text(spark):
    from logsieve.llm.markup import page_rows, page_text

    cases = {
        "<html lang='fr-CA'><body>a<script>if (x<y) '</p>'</script>b<!-- c <p> -->d &amp; e<br/>f</body>": (" ab d & e f".split(), "fr"),
        "<HTML data-lang=xx LANG=De><style>p{}</style>x < y <1": (["x", "<", "y", "<1"], "de"),
        "plain": (["plain"], None), "": ([], None), "<p>open <script>never closed": (["open"], None), "<!-- never": ([], None), "<p lang=es>a": (["a"], None),
    }
    for source, (shown, language) in cases.items():
        text, said = page_text(source)
        assert ("".join(text.split()), said) == ("".join(shown), language), source
    import time

    begin = time.time()
    page_text("<script>" * 200_000), page_text("<!-- " * 200_000), page_text("<p lang=" * 200_000)
    assert time.time() - begin < 3
    frame = spark.createDataFrame([(1, "https://A.b.FR:8/x", "<html lang=fr>é"), (2, None, None), (None, "http://1.2.3.4/", "x")], "page_id long, url string, html string")
    assert sorted(((r.page_id or 0, r.text, r.declared, r.host, r.suffix) for r in page_rows(frame).collect())) == [(0, "x", None, "1.2.3.4", None), (1, " é", "fr", "a.b.fr", "fr"), (2, "", None, None, None)]


def test_language_drops_rows(spark):
    rows = [(1, "one two three"), (1, None), (None, "one two"), (None, ""), (2, "12 34"), (2, "two one"), (3, "three one"), (3, "three one")]
    left = language_id.accepted(docs(spark, rows), host=F.col("source")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in left) == [(0, "one two"), (1, "one two three"), (2, "two one"), (3, "three one"), (3, "three one")]


def test_quality(spark):
    frame, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = cotrain.quality_scores(frame, labels.filter("doc_id % 3 <> 0")).join(labels, "doc_id").filter("doc_id % 3 = 0").toPandas()
    assert (got.kept == (got.quality > 0)).mean() > 0.93
    marks = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (99, 1, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    assert cotrain.quality_scores(docs(spark, ODD), marks).count() == len(ODD)
    none = cotrain.quality_scores(docs(spark, ODD), marks.limit(0)).collect()
    assert len(none) == len(ODD) and all(r.kept and r.score is None for r in none)


def quality_corpus(rnd, n):
    """(rows, labels): good and bad documents differ in words and in host; two thirds have one view only."""
    rows, marks = [], {}
    for i in range(n):
        good = rnd.random() < 0.5
        # words of either kind: few of them stand in any one document
        own = [f"{'good' if good else 'bad'}{rnd.randrange(60)}" for _ in range(4)]
        text = " ".join(own + [f"w{rnd.randrange(200)}" for _ in range(30)])
        url = f"https://{'fine' if good else 'poor'}{rnd.randrange(3)}.example.{'org' if good else 'biz'}/p/{i}"
        rows.append((i, text, None, None, None, None if i % 3 == 0 else url, None))
        marks[i] = int(good)
    return rows, marks


def test_co_training_beats_its_start(spark):
    rows, marks = quality_corpus(random.Random(6), 3000)
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, url string, html string").repartition(4)
    labels = spark.createDataFrame([(i, marks[i]) for i in range(40)], "doc_id long, quality int")
    right = {}
    for rounds in (0, 3):
        got = [r for r in cotrain.quality_scores(frame, labels, rounds=rounds, sure=0.9).collect() if r.doc_id >= 40]
        assert len(got) == 2960
        right[rounds] = [np.mean([(getattr(r, c) > 0.5) == marks[r.doc_id] for r in got if r.doc_id % 3 == 0 or c != "text_score"]) for c in ("text_score", "score")]
    # documents without an address: the text view learned from what the metadata view was sure of
    assert right[3][0] > right[0][0] + 0.1 and right[3][1] > right[0][1] and right[3][1] > 0.9


def test_exchange_covers_all_rows(spark):
    """Sums over tasks against one matrix product."""
    rows, marks = quality_corpus(random.Random(3), 400)
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, url string, html string").repartition(5)
    every = cotrain.shared.keep(cotrain.features(frame), "test-features")
    got = sorted(every.collect(), key=lambda r: r.doc_id)
    import pyarrow as pa

    x = cotrain._unpacked(pa.array([bytes(r.x) for r in got], pa.binary()))
    y = np.array([marks[r.doc_id] for r in got])
    model = cotrain.Model([cotrain.LeastSquares(cotrain.Moments(v.shape[1]).add(v[:60], y[:60]), None, 0.5, 3.0) for v in x], [v[60:120] for v in x], y[60:120])
    for k, m in enumerate(cotrain.exchanged(every, model, 0.7)):
        p = model.scores(x)[1 - k]
        rows = (p >= 0.7) | (p <= 0.3)
        want = cotrain.Moments(x[k].shape[1]).add(x[k][rows], p[rows] > 0.5)
        assert rows.sum() > 20 and (m.n == want.n).all() and np.allclose(m.s, want.s) and np.allclose(m.m, want.m)


def test_quality_rows(spark):
    """Null metadata, repeated and null ids, odd addresses, an empty table."""
    odd = [(1, None, None, None, None, None, None), (None, "a b", "en", "s", 3, "x", "<p>"), (2, "", "en", None, -5, "http://", ""), (2, "c", None, "s", None, "HTTPS://A.b/?q", "<A href>"), (3, "a " * 50_000, "en", "s", 1, "u" * 50_000, "<")]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, url string, html string"
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, quality int")
    got = cotrain.quality_scores(spark.createDataFrame(odd, kinds), labels).collect()
    assert len(got) == 5 and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    assert cotrain.quality_scores(spark.createDataFrame([], kinds), labels).count() == 0


# ---- 5 ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_url_filter(spark, most):
    at = lambda n: f"2024-01-{n:02d} 00:00:00"
    entries = spark.createDataFrame(
        [("host", "a.b.com", "add", at(5)), ("host", "a.b.com", "remove", at(10)), ("host", "a.b.com", "add", at(10)), ("domain", "b.com", "add", at(7)), ("prefix", "c.org/x", "add", at(1)), (None, None, "add", at(1)),
         ("host", "d.net", "add", at(3)), ("host", "d.net", "add", at(6)), ("host", "d.net", "remove", at(9))],
        "kind string, pattern string, action string, at string",
    ).withColumn("at", F.to_timestamp("at"))
    options = {"broadcast_bytes": most}
    captures = [(1, "http://u:p@A.b.com:80/z?q", at(6)), (2, "http://a.b.com/", at(4)), (3, "http://a.b.com/", at(11)), (4, "http://z.b.com/", at(6)), (5, "http://c.org/x/y", at(2)), (6, "http://c.org/xy", at(2)),
                (7, None, at(2)), (8, "bad", at(2)), (9, "http://d.net", at(7)), (9, "http://d.net", at(7)), (10, "http://d.net./", at(9)), (11, "http://b.com/", None)]
    frame = spark.createDataFrame(captures, "page_id long, url string, fetched string").withColumn("fetched", F.to_timestamp("fetched"))
    frame = frame.selectExpr("*", "'x' as kind", "'y' as pattern", "1 as hit", "2 as since", "3 as salt", "4 as key")
    got = sorted((r.page_id, r.kind, r.since.day if r.since else None) for r in url_filter.url_verdicts(frame, entries, **options).collect() if r.blocked)
    assert got == [(1, "host", 5), (3, "domain", 7), (5, "prefix", 1), (9, "host", 3), (9, "host", 3)]
    assert url_filter.url_verdicts(frame, entries.limit(0), **options).filter("blocked").count() == 0
    assert url_filter.url_verdicts(frame.limit(0), entries, **options).count() == 0


def test_url_filter_levels_and_case(spark):
    at, deep = "2024-01-01 00:00:00", "/".join(f"s{i}" for i in range(40))
    entries = spark.createDataFrame([("domain", "far.com", "add", at), ("prefix", f"p.org/{deep}", "add", at), ("prefix", "Q.net/EN", "add", at)], "kind string, pattern string, action string, at string").withColumn("at", F.to_timestamp("at"))
    captures = [(1, "http://" + "a." * 60 + "far.com/"), (2, f"http://p.org/{deep}/end"), (3, "http://q.NET/EN/x"), (4, "http://q.net/en/x"), (5, "http://p.org/" + deep[:-1] + "/end"), (6, "http://" + "b" * 200_000 + "." + "a." * 2000 + "far.com/" + "s/" * 3000)]
    frame = spark.createDataFrame(captures, "page_id long, url string").withColumn("fetched", F.to_timestamp(F.lit(at)))
    for most in (1 << 20, 0):
        got = {r.page_id: r.kind for r in url_filter.url_verdicts(frame, entries, broadcast_bytes=most).collect() if r.blocked}
        assert got == {1: "domain", 2: "prefix", 3: "prefix", 6: "domain"}


# ---- 8 ---------------------------------------------------------------------------------------------------------

_W = re.compile("[0-9a-z\u0080-\U0010ffff]+")


def brute_near(rows):
    sets = []
    for _, t in rows:
        w = _W.findall((t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n, links = len(rows), collections.Counter()
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], least[find(i)], links[i]) for i in range(n))


@pytest.mark.parametrize("block", [256, 16])
def test_near_duplicates(spark, block):
    rnd = random.Random(7)
    base = [" ".join(f"w{rnd.randrange(400)}" for _ in range(120)) for _ in range(3)]
    rows = [(i, t) for i, t in ODD if i is not None]
    for k in range(90):
        w = base[k % 3].split()
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = f"z{rnd.randrange(100)}"
        rows.append((100 + k, " ".join(w)))
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in near_dups.near_duplicates(docs(spark, rows), block=block).collect())
    assert got == brute_near(rows)


@pytest.mark.parametrize("block", [256, 4])
def test_near_rows(spark, block):
    """One row of each class stays, whatever the ids; brute force over rows."""
    rnd = random.Random(9)
    base = [[f"w{rnd.randrange(300)}" for _ in range(60)] for _ in range(4)]
    rows = [(3, "a b c d"), (5, "e f g h"), (5, "q r s t"), (None, "i j k l"), (None, "m n o p"), (None, "A b, c d"), (None, None), (5, ""), (None, "i j k l")]
    for k in range(60):
        w = list(base[k % 4])
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(60)] = f"z{rnd.randrange(50)}"
        rows.append((rnd.choice([None, rnd.randrange(12)]), " ".join(w)))
    numbered = brute_near([(i, t) for i, (_, t) in enumerate(rows)])
    groups = collections.defaultdict(list)
    for i, c, _ in numbered:
        groups[c].append(i)
    frame = docs(spark, rows)
    left = [(r.doc_id, r.text) for r in near_dups.one_of_each(frame, block=block).collect()]
    assert len(left) == len(groups) and not collections.Counter(left) - collections.Counter(rows)
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        assert sum(min(collections.Counter(left)[rows[i]], 1) for i in g) >= 1
        assert len(g) == 1 or not ids or any((min(ids), rows[i][1]) in left for i in g)
    got = sorted((r.doc_id or -1, r.class_id if r.class_id is not None else -1, r.n_links) for r in near_dups.near_duplicates(frame, block=block).collect())
    least = lambda g: min((rows[i][0] for i in g if rows[i][0] is not None), default=-1)
    assert got == sorted((rows[i][0] or -1, least(groups[c]), n) for i, c, n in numbered)


def test_near_chains(spark):
    """A long chain of similar texts is one component, whose pairs mostly share no band: compared by bucket."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 4 : i * 4 + 80])) for i in range(80)] + [(100 + i, " ".join(words[i : i + 80])) for i in range(40)]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in near_dups.near_duplicates(docs(spark, rows), block=4).collect())
    assert got == brute_near(rows)


def test_exact_rows(spark):
    rows = [(1, "a"), (1, "b"), (2, "a"), (None, "c"), (None, "d"), (None, None), (4, ""), (4, ""), (None, "d")]
    left = exact_dedup.without_copies(docs(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == [(0, "c"), (0, "d"), (1, "b"), (2, "a"), (4, "")]


def test_near_edges(spark):
    assert near_dups.band_shape(0.8, 0.9999) == (18, 4)
    assert near_dups.near_duplicates(docs(spark, ODD).limit(0)).count() == 0
    assert near_dups.one_of_each(docs(spark, [(1, "a b c"), (2, "A, b c!"), (3, "q")])).count() == 2


# ---- 10 --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [2_000_000, 1])
def test_decontamination(spark, limit):
    item = "If Tom has 12 apples and gives 5 apples to Mary then how many apples does Tom keep for lunch today with 7 kg"
    bench = spark.createDataFrame([(1, item), (2, "a tiny item"), (3, None), (4, ""), (5, item)], "item_id long, text string")
    rows = [*ODD, (50, "Before it. " + item.replace("Tom", "Sam").replace("12", "99").replace("kg", "lb") + " and after"), (51, item.replace("and gives 5", "or sells 5").replace("Tom keep", "he keep")), (52, "A tiny item"),
            (53, "a tiny thing"), (54, " ".join(str(i) for i in range(40)))]
    got = {(r.doc_id, r.item_id) for r in decontaminate.benchmark_hits(docs(spark, rows), bench, broadcast_windows=limit).collect()}
    assert got == {(50, 1), (52, 2)}
    assert decontaminate.decontaminated(docs(spark, rows), bench, broadcast_windows=limit).count() == len(rows) - 2
    assert decontaminate.benchmark_hits(docs(spark, rows), bench.limit(0)).count() == 0


def test_slots_agree_one_to_one():
    """Equal patterns of repeats mean one-to-one agreement, per kind; brute force over small windows."""
    rnd = random.Random(5)
    kinds = [[rnd.choice([0, 1, 1, 2]) for _ in range(5)] for _ in range(30)]
    for own in kinds:
        values = np.array([[rnd.randrange(3) for _ in own] for _ in range(40)], np.uint64)
        found = decontaminate.repeats(np.array([own] * 40, np.int8), values)
        for i in range(40):
            for j in range(40):
                there, back, same = {}, {}, True
                for k, x, y in zip(own, values[i].tolist(), values[j].tolist()):
                    if k:
                        same &= there.setdefault((k, x), y) == y and back.setdefault((k, y), x) == x
                assert same == (found[i] == found[j])


@pytest.mark.parametrize("limit", [2_000_000, 1])
def test_runs_are_one_slot(spark, limit):
    item = "Then Mary Ann bought 1,000 pens and 3.5 kg of rice, so how many pens does Mary Ann have per child at home?"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item.replace("Mary Ann", "Tom").replace("1,000", "500").replace("3.5", "4")), (2, item.replace("so how many pens does Mary Ann", "so how many pens does Bob")),
            (3, "Ask Bob " + item.replace("1,000", "12")), (4, item.replace("1,000 pens", "1,000 and 1 pens"))]
    got = {(r.doc_id, r.item_id): r.n_windows for r in decontaminate.benchmark_links(docs(spark, rows), bench, broadcast_windows=limit).collect()}
    assert got.keys() == {(1, 1), (2, 1), (3, 1), (4, 1)} and got[1, 1] >= 5 and got[4, 1] < got[3, 1]


def test_decontamination_drops_rows(spark):
    item = "what is the name of the town that lies by the old stone bridge"
    bench = spark.createDataFrame([(1, item), (None, item)], "item_id long, text string")
    rows = [(1, item), (1, "clean"), (None, item), (None, "clean too"), (None, None), (2, "so " + item), (2, "so " + item), (3, ""), (3, "")]
    for limit in (2_000_000, 1):
        left = decontaminate.decontaminated(docs(spark, rows), bench, broadcast_windows=limit)
        assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, ""), (0, "clean too"), (1, "clean"), (3, ""), (3, "")] and left.columns == docs(spark, rows).columns
    assert {(r.doc_id, r.item_id) for r in decontaminate.benchmark_links(docs(spark, rows), bench).collect()} == {(d, i) for d in (1, 2, None) for i in (1, None)}


@pytest.mark.parametrize("limit", [2_000_000, 1])
def test_slot_heavy_items_are_found(spark, limit):
    items = ["What is 12 * 5 + 3 - 8 / 2 + 7 * 9 - 4?", "Compute the mean of 12, 15, 18, 21, 24, 27, 30, 33, 36, 39, 42, 45 and 48 exactly.", "ÉVERY WORD OF THIS ITEM STANDS IN CAPITALS FROM ITS FIRST TO ITS LAST WORD", "Каждое Слово Здесь"]
    bench = spark.createDataFrame(list(enumerate(items, 1)), "item_id long, text string")
    rows = [(i, f"some text before {t} and after") for i, t in enumerate(items, 1)] + [(10 + i, t.lower().replace(",", "").replace(" ", "\n")) for i, t in enumerate(items, 1)]
    rows += [(20, "what is 12 * 5 + 3 - 8 / 2 + 7 * 9 - 5?"), (21, " ".join(str(i) for i in range(60)))]
    got = {(r.doc_id, r.item_id): r.n_windows for r in decontaminate.benchmark_hits(docs(spark, rows), bench, broadcast_windows=limit).collect()}
    assert set(got) == {(k + i, i) for i in range(1, 5) for k in (0, 10)} and got[1, 1] == 1 and got[2, 2] == got[12, 2] == 7
    assert decontaminate.decontaminated(docs(spark, rows), bench, broadcast_windows=limit).count() == 2


@pytest.mark.parametrize("limit", [2_000_000, 1])
def test_templates_do_not_depend_on_context(spark, limit):
    tom = "Tom has 3 apples. Tom buys 5 more. Tom eats 2 now. How many apples are left?"
    which = "Which planet near Mars has the largest number of moons?"
    bench = spark.createDataFrame([(1, tom), (2, which)], "item_id long, text string")
    rows = [(1, tom.replace("Tom", "Sam").replace("5", "8")), (2, "as in 5) " + which.replace("Mars", "Venus")), (3, "so, " + which.replace("Which", "which").replace("Mars", "Venus")), (4, which.replace(" ", "\n").replace("Mars", "Venus")), (5, which),
            (6, tom.replace("Tom has", "Sam has")), (7, "as in 5) Which planet has a moon?")]
    got = {(r.doc_id, r.item_id): r.n_windows for r in decontaminate.benchmark_hits(docs(spark, rows), bench, broadcast_windows=limit).collect()}
    assert got.keys() == {(1, 1), (2, 2), (3, 2), (4, 2), (5, 2), (6, 1)} and got[1, 1] >= 4 and all(got[i, 2] == 1 for i in (2, 3, 4, 5))


@pytest.mark.parametrize("limit", [2_000_000, 1])
def test_all_items_of_a_window_are_linked(spark, limit):
    start = "please read the question below with care and give one short answer for the following case"
    items = {1: f"{start} of red birds", 2: f"{start} of blue fish", 3: "Ann sold 7 pens to Bob on the way home", 4: "Ann sold 9 pens to Cid on the way home", 5: f"{start} of red birds"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = [(1, items[2]), (2, items[4]), (2, items[4]), (3, items[1]), (None, items[3])]
    got = {(r.doc_id, r.item_id): r.n_windows for r in decontaminate.benchmark_links(docs(spark, rows), bench, broadcast_windows=limit).collect()}
    n = len(start.split())
    share, whole = n + 1 - 12, n + 3 - 12
    assert got == {(1, 1): share, (1, 2): whole, (1, 5): share, (2, 3): 2, (2, 4): 2, (3, 1): whole, (3, 2): share, (3, 5): whole, (None, 3): 1, (None, 4): 1}


# ---- pipeline --------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    frame = spark.read.parquet(f"{SF}/documents.parquet")
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in frame.select("doc_id", "text").collect()}
        frame = near_dups.shared.keep(stage(spark, frame, SF), "test-stage")
        left = {r.doc_id for r in frame.select("doc_id").collect()}
        assert frame.columns == columns and left <= set(before)
        if name == "exact dedup":
            best = {}
            for i, t in before.items():
                best[t or ""] = max(i, best.get(t or "", i))
            assert left == set(best.values())
        if name == "n-gram Jaccard join":
            assert left == {c for _, c, _ in brute_near(sorted(before.items()))}
    last = corpus_pipeline.STAGES[-1][1](spark, frame, SF)
    assert last.filter("decoded").count() == frame.count() == corpus_pipeline.run(spark, SF).count()


def test_pipeline_odd_rows(spark, tmp_path):
    """Null, repeated and unsorted ids, null and empty texts, copies, near copies and benchmark passages: the whole pipeline
    against a plain model of its stages."""
    import sentencepiece

    import corpus_pipeline

    rnd = random.Random(21)
    base = [" ".join(f"w{rnd.randrange(500)}" for _ in range(50)) for _ in range(30)]
    item = "which of the seven rivers that cross the old town runs under the stone bridge near the mill"
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(rnd.choice([None, 3, 100 + k]), rnd.choice(base)) for k in range(25)]  # exact copies, some with null or repeated ids
    rows += [(rnd.choice([None, 5, 200 + k]), base[k] + " end") for k in range(10)]  # near copies
    rows += [(300, item), (5, f"{base[12][:40]} {item}"), (None, item.upper()), (301, item.replace("seven", "eight"))]
    rows += [(400, None), (401, ""), (None, None), (402, "12 34"), (403, "x " * 30_000), (404, "one unlike any other"), (404, "one unlike any other"), (None, "a null id of its own"), (None, "a second null id")]
    rnd.shuffle(rows)
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    # language ID: texts without a letter go (to the model a text of numbers has none)
    left = [(i, t) for i, t in rows if t and re.search("[a-z]", t.lower())]
    # exact: of equal texts one row with the largest id
    exact = {}
    for i, t in left:
        exact[t] = max(exact.get(t, -1), -1 if i is None else i)
    # near: of each class the least id, null ids last
    texts = sorted(exact.items())
    classes = collections.defaultdict(list)
    for n, c, _ in brute_near([(n, t) for n, (t, _) in enumerate(texts)]):
        classes[c].append(texts[n])
    near = [min(g, key=lambda x: (x[1] < 0, x[1])) for g in classes.values()]
    words_of = lambda t: re.findall("[0-9a-z\u0080-\U0010ffff]+", t.lower())
    cut = lambda w: {tuple(w[k : k + 13]) for k in range(max(0, len(w) - 12))}
    clean = [(t, i) for t, i in near if not cut(words_of(t)) & cut(words_of(item))]
    assert len(clean) < len(near) < len(texts) < len(left) < len(rows)

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = sorted((i, len(ids := model.encode(t)), zlib.crc32(np.array(ids, "<u4").tobytes())) for t, i in clean)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want and all(r.decoded for r in got)

    # empty tables, and documents that nothing is known about
    frame.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
