from __future__ import annotations

import random
import zlib

import corpus_pipeline as P
from slotwise.llm import bpe, packing
from slotwise.llm.common import DOCUMENT_COLUMNS, table

SAMPLE = "/root/testdata/sf0.01"


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


def test_each_stage_decides_on_its_own_input(spark, documents):
    r = random.Random(1)
    clean = [prose(r, 80) for _ in range(20)]
    near = clean[1].split()
    near[40] = "changed"
    secret = "password=Abcdefgh1234567890xyz"
    texts = [*clean, clean[0] + "  ", " ".join(near), prose(r, 30) + " " + secret, "", None]
    docs = documents(*texts, (3, texts[3]))

    kept = P.drop_exact_copies(spark, docs, SAMPLE)
    assert kept.columns == list(DOCUMENT_COLUMNS)
    ids = sorted(x.doc_id for x in kept.collect())
    assert 20 in ids and 0 not in ids  # the copy with more code points stays
    assert ids.count(3) == 1 and len([i for i in ids if i in (23, 24)]) == 1

    kept = P.drop_near_copies(spark, docs, SAMPLE)
    ids = sorted(x.doc_id for x in kept.collect())
    assert 1 in ids and 21 not in ids and ids.count(3) == 1 and 0 in ids and 20 not in ids

    kept = {x.doc_id: x for x in P.hide_secrets(spark, docs, SAMPLE).collect()}
    assert len(kept) == len(texts) and secret not in kept[22].text and "[SECRET]" in kept[22].text
    assert all(kept[i].text == texts[i] for i in range(len(texts)) if i != 22)

    pieces = P.pack_sequences(spark, docs, SAMPLE).collect()
    assert {p.doc_id for p in pieces} == set(range(len(texts)))


def test_toxic_documents_go(spark):
    docs = table(spark, SAMPLE, "documents")
    kept = P.reject_toxic(spark, docs, SAMPLE)
    assert kept.columns == docs.columns
    labels = {x.doc_id: x.toxic for x in table(spark, SAMPLE, "labels").collect()}
    left = {x.doc_id for x in kept.select("doc_id").collect()}
    toxic = [i for i, y in labels.items() if y == 1]
    clean = [i for i, y in labels.items() if y == 0]
    assert sum(i in left for i in toxic) <= 0.5 * len(toxic)
    assert sum(i in left for i in clean) >= 0.98 * len(clean)


def test_run_applies_the_stages_in_turn(spark):
    docs = table(spark, SAMPLE, "documents")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SAMPLE)
    encode, want = bpe.encoder(bpe.tokenizer_path()), []
    for x in docs.select("doc_id", "text").collect():
        ids = [*encode(x.text or "").tolist(), 2]
        for k, (start, length) in enumerate(packing.cut_pieces(len(ids), 1024)):
            raw = b"".join(i.to_bytes(4, "little") for i in ids[start : start + length])
            want.append((x.doc_id, k, start, length, zlib.crc32(raw)))
    got = P.run(spark, SAMPLE).collect()
    assert sorted((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in got) == sorted(want)
