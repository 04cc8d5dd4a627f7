from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from slotwise.llm import bpe, packing

PATH = bpe.tokenizer_path()
ODD = [
    "a  b   c\n\n d'll it's 're  x\t\ty  ", "<|endoftext|>a<|endoftext|> b <|endo", "日本語のテキスト 漢字 かな  ", "word " * 40,
    "    \n\n  \n x" * 20, "it's we'll they've 'll 's " * 20, "é è ü ñ  ° ½ ² x²  " * 10, "", "a" * 3000, " " * 500,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_librarys(library):
    encode = bpe.encoder(PATH)
    for text in ODD:
        assert encode(text).tolist() == ids_of(library, text)
        assert bpe.decode(encode(text), PATH).decode() == library.decode(ids_of(library, text), skip_special_tokens=False)


def test_joins_of_arbitrary_cuts_are_exact(library):
    r, encode = random.Random(2), bpe.encoder(PATH)
    for _ in range(400):
        body = "".join(r.choice(ODD) for _ in range(r.randint(1, 4)))[:1500].encode()
        cuts, parts, last = sorted({r.randrange(len(body) + 1) for _ in range(r.randint(0, 8))}), [], 0
        for cut in [*cuts, len(body)]:
            while cut < len(body) and body[cut] & 0xC0 == 0x80:
                cut += 1
            if cut > last:
                parts.append(body[last:cut])
                last = cut
        got = bpe.join_encoded([(p, encode(p.decode())) for p in parts], PATH)
        assert got.tolist() == ids_of(library, body.decode())


def test_chunks_depend_on_content_only():
    r = random.Random(3)
    passage = bytes(r.choice(b"abcdefghij ") for _ in range(6000))
    chunks = lambda body: {body[a:b] for a, b in zip([0, *bpe.chunk_bounds(body)], bpe.chunk_bounds(body))}
    shared = chunks(b"x" * 500 + passage) & chunks(passage[:3000] + b"other" + passage)
    assert sum(map(len, shared)) > 3000


def test_encode_documents_against_the_library(documents, library, spark):
    r = random.Random(4)
    passage = " ".join("".join(r.choice("abcdé") for _ in range(r.randint(1, 9))) for _ in range(900))
    texts = [*ODD, None, passage, passage, "head " + passage, passage + " tail", passage[:2500] + "\n\n" + passage[1000:], passage[::-1]]
    docs = documents(*texts, (7, "same id"), (7, "same id"), (None, passage), clash=True)
    texts += ["same id", "same id", passage]
    got = bpe.encode_documents(docs, PATH, chunk_bytes=256, filter_bits=12)
    want = []
    for i, t in zip([*range(len(texts) - 3), 7, 7, None], texts, strict=True):
        ids = ids_of(library, t)
        text = library.decode(ids, skip_special_tokens=False)
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((str(r.id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == sorted(want)


def test_encode_nothing(no_documents):
    assert bpe.encode_documents(no_documents, PATH).collect() == []


def test_pieces_put_the_shorter_one_first():
    assert packing.cut_pieces(5, 4) == [(0, 1), (1, 4)]
    assert packing.cut_pieces(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut_pieces(3, 4) == [(0, 3)]


def test_best_fit_decreasing_meets_bounds():
    r = np.random.default_rng(5)
    for _ in range(50):
        lengths = r.integers(1, 100, r.integers(1, 60))
        bins, offsets, fills = packing.best_fit_decreasing(lengths, 100)
        for b in range(len(fills)):
            own = sorted(zip(offsets[bins == b], lengths[bins == b]))
            assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist()
            assert sum(n for _, n in own) == fills[b] <= 100
        assert packing.least_bins(lengths, 100) <= len(fills)


def test_lower_bound_is_below_the_optimum():
    # Three pieces over a third each: no two of 51 fit together.
    assert packing.least_bins(np.array([51, 51, 51]), 100) == 3
    assert packing.least_bins(np.array([34, 34, 34]), 100) == 2
    assert packing.least_bins(np.array([50, 50, 50, 50]), 100) == 2


def test_packing_places_every_piece_once(documents, library):
    r = random.Random(6)
    texts = [" ".join(r.choice(["alpha", "beta", "x", "7"]) for _ in range(r.randint(0, 90))) for _ in range(120)]
    docs = documents(*texts, None, "", (3, texts[3]), (3, texts[3]), (None, "no id"), clash=True)
    texts += [None, "", texts[3], texts[3], "no id"]
    got = packing.pack_documents(docs, PATH, capacity=64, group_size=24, keep_ids=True).collect()
    want = []
    for i, t in zip([*range(122), 3, 3, None], texts, strict=True):
        ids = np.array([*ids_of(library, t), 2], "<u4")
        for k, (s, n) in enumerate(packing.cut_pieces(len(ids), 64)):
            want.append((str(i), k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
    assert sorted((str(p.doc_id), p.piece, p.start, p.length, p.ids_crc32) for p in got) == sorted(want)
    sequences: dict[int, list] = {}
    for p in got:
        assert zlib.crc32(bytes(p.ids)) == p.ids_crc32
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= -(-sum(w[3] for w in want) // 64) * 1.1


def test_exchanges_go_on_while_they_save_sequences(documents, monkeypatch):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    def one_less_each_turn(pieces, n, capacity, group_size, salt):
        """A stand-in for packing, in which each of six exchanges saves a bin."""
        k = (F.row_number().over(Window.orderBy("uid")) - 1).cast("long")
        placed = pieces.withColumn("k", k).withColumn("bin", F.greatest(F.col("k") - salt, F.lit(0).cast("long")))
        placed = placed.withColumn("group", F.col("bin") % 2).withColumn("offset", F.when(F.col("bin") == 0, F.col("k")).otherwise(0))
        placed = placed.withColumn("fill", F.lit(9).cast("long")).withColumn("gap", F.lit(int(salt < 6)).cast("long"))
        return placed.select(*[f.strip().split(" ")[0] for f in packing.PACKED_COLUMNS.split(",")])

    monkeypatch.setattr(packing, "_pack", one_less_each_turn)
    got = packing.pack_documents(documents(*["the " * i for i in range(1, 21)]), PATH, capacity=64).collect()
    assert len(got) == 20 and len({p.sequence_id for p in got}) == 14


def test_packing_nothing(no_documents):
    assert packing.pack_documents(no_documents, PATH).collect() == []
