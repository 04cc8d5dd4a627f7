"""Byte-level BPE: token ids of whole texts, and the content-defined chunks that documents share.

Chunk reuse. A rolling hash over the bytes cuts each text into chunks at places that depend on
nearby content only, so equal passages give equal chunks wherever they stand. Chunks that occur more
than once in the corpus are encoded once, and every document takes their ids from there; what stands
between them is encoded in place.

Joins. Ids on the two sides of a join may differ from those of the whole text, as a word can lie
across it. The pre-tokeniser starts a new word before every space that is followed by a character
other than white space, whatever stands before; such a place is *safe*: the ids of a text are those
of its part before and its part after. A join is repaired by re-encoding from the last safe place of
the left chunk to the first one of the right chunk. The repair agrees exactly when the ids kept on
both sides end and start at those places; otherwise the window grows to the next safe place, at
worst over both chunks, and goes on into the next join.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b, sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.durable import cut_lineage
from .common import mapped, parts_of, whole_text

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
#: A chunk has about this many bytes, and never fewer than a quarter of it unless its text ends.
CHUNK_BYTES = 1024
#: Bits of the filter of shared chunks that is sent to the tasks: 16 MiB for any corpus.
FILTER_BITS = 27


@cache
def _special(path: str) -> dict[str, int]:
    import json

    with open(path, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


@cache
def _units() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves,
    the others in order from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


@cache
def _token_bytes(path: str) -> list[bytes]:
    """The bytes of each id."""
    import json

    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    special, units = _special(path), _units()
    out = [b""] * (max([*vocabulary.values(), *special.values()]) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(units[c] for c in token) if token not in special else token.encode()
    for token, i in special.items():
        out[i] = token.encode()
    return out


@cache
def _token_lengths(path: str) -> np.ndarray:
    return np.array([len(b) for b in _token_bytes(path)], dtype=np.int64)


@cache
def encoder(path: str):
    """text -> ids as little-endian unsigned 32-bit integers, equal to those of the vocabulary's own library.

    A byte-level vocabulary merges in the order of its ids, so it can be read as ranks; the ranked
    encoder is about five times as fast. Tests hold both against each other.
    """
    import public_tokenizers
    import tiktoken

    special = _special(path)
    ranks = {b: i for i, b in enumerate(_token_bytes(path)) if b and i not in special.values()}
    ranked = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    allowed = set(special)

    def encode(text: str) -> np.ndarray:
        if not text:
            return np.empty(0, dtype="<u4")
        return ranked.encode_to_numpy(text, allowed_special=allowed, disallowed_special=()).astype("<u4", copy=False)

    return encode


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _token_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes in one array, and where each id's bytes start in it."""
    lengths = _token_lengths(path)
    return np.frombuffer(b"".join(_token_bytes(path)), dtype=np.uint8), np.cumsum(lengths) - lengths


def decode(ids: np.ndarray, path: str) -> bytes:
    """The bytes of ids; bytes that are no UTF-8 become replacement characters, as in the library's decode."""
    table, starts = _token_table(path)
    lengths = _token_lengths(path)[ids]
    before = np.cumsum(lengths) - lengths
    body = table[np.repeat(starts[ids] - before, lengths) + np.arange(int(lengths.sum()))].tobytes()
    try:
        body.decode("utf-8")
    except UnicodeDecodeError:
        body = body.decode("utf-8", errors="replace").encode()
    return body


# -- chunks ------------------------------------------------------------------------------------

_MULTIPLIER = {np.uint32: np.uint32(0x9E3779B1), np.uint64: np.uint64(0x9E3779B97F4A7C15)}


def rolling_hashes(body: np.ndarray, width: int, kind: type = np.uint32) -> np.ndarray:
    """Polynomial hashes of all windows of ``width`` bytes (a power of two), each from its own bytes only."""
    hashes, power, step = body.astype(kind) + kind(1), _MULTIPLIER[kind], 1
    while step < width:
        hashes = hashes[:-step] * power + hashes[step:]
        with np.errstate(over="ignore"):
            power = power * power
        step *= 2
    return hashes


def chunk_bounds(body: bytes, average: int = CHUNK_BYTES) -> list[int]:
    """Ends of the content-defined chunks of a text in UTF-8, each between two characters."""
    if len(body) <= average // 4 + 32:
        return [len(body)] if body else []
    raw = np.frombuffer(body, dtype=np.uint8)
    hashes = rolling_hashes(raw, 32)
    hashes ^= hashes >> np.uint32(15)
    hashes *= _MULTIPLIER[np.uint32]
    cuts = np.flatnonzero(hashes < np.uint32((1 << 32) // average)) + 32
    out, last, least = [], 0, average // 4
    for cut in cuts.tolist():
        while cut < len(body) and body[cut] & 0xC0 == 0x80:
            cut += 1
        if cut - last >= least and cut < len(body):
            out.append(cut)
            last = cut
    return [*out, len(body)]


def chunk_key(chunk: bytes) -> bytes:
    return blake2b(chunk, digest_size=16).digest()


# -- joins -------------------------------------------------------------------------------------

_SAFE = re.compile(rb" (?=[!-~])")


def _safe_places(body: bytes) -> np.ndarray:
    """Offsets of spaces followed by a printable ASCII character: a part of all safe places, enough to find one."""
    return np.fromiter((m.start() for m in _SAFE.finditer(body)), dtype=np.int64)


def join_encoded(parts: list[tuple[bytes, np.ndarray]], path: str) -> np.ndarray:
    """Ids of the whole text from its parts and their own ids."""
    encode, lengths = encoder(path), _token_lengths(path)
    special = [t.encode() for t in _special(path)]
    done: list[np.ndarray] = []
    pending = b""  # text whose ids are still to be made
    kept = np.empty(0, dtype="<u4")  # ids of the last part after its safe place, sure unless the next join reaches back
    kept_body = b""
    for body, ids in parts:
        ends = np.concatenate([[0], np.cumsum(lengths[ids])])
        whole = pending == b"" and kept_body == b""
        safe = _safe_places(body)
        safe = safe[safe > 0]
        if any(body.find(t[1:]) >= 0 or t in (kept_body + pending)[-len(t) :] + body[: len(t)] for t in special):
            safe = safe[:0]  # a special token near: encode what is around it as one
        # Places at which this part's own ids part as well.
        at = safe[np.isin(safe, ends)]
        if len(at) == 0:
            pending, kept_body, kept = pending + kept_body + body, b"", np.empty(0, dtype="<u4")
            continue
        first, last = int(at[0]), int(at[-1])
        if whole and not done:
            # The text starts here; its first ids need no repair.
            first = 0
        else:
            done.append(encode((pending + kept_body + body[:first]).decode("utf-8")))
        pending = b""
        low, high = np.searchsorted(ends, first), np.searchsorted(ends, last)
        done.append(ids[low:high])
        kept_body, kept = body[last:], ids[high:]
    if pending:
        done.append(encode((pending + kept_body).decode("utf-8")))
    elif kept_body:
        done.append(kept)
    return np.concatenate(done) if done else np.empty(0, dtype="<u4")


# -- the operator --------------------------------------------------------------------------------


def shared_filter(hashes: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of the values of the one long column that occur more than once.

    Its size is fixed, however large the corpus: a fuller one lets more chunks that occur once pass,
    which then are exchanged like shared ones. Results don't depend on it.
    """
    column = hashes.columns[0]
    slot = F.pmod(F.col(column), F.lit(1 << bits))
    words = (
        hashes.groupBy(column).agg(F.sum("n").alias("n")).filter("n > 1")
        .groupBy(F.shiftrightunsigned(slot, 6).alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))")).alias("mask"))
    )
    bitmap = np.zeros(1 << (bits - 6), dtype=np.int64)
    for batch in words.toArrow().to_batches():
        bitmap[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return bitmap


def _in_filter(bitmap: np.ndarray, bits: int, h: int) -> bool:
    return bool(int(bitmap[(h & ((1 << bits) - 1)) >> 6]) >> (h & 63) & 1)


def _short(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def encode_documents(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    chunk_bytes: int = CHUNK_BYTES, filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """One row per input row: id, text_key, n_tokens, ids_sha256, decoded_sha256.

    Null texts count as empty: no tokens. Rows repeated or with equal texts get equal answers; null
    ids are kept. An empty table gives an empty result, other columns are ignored. ``tokenizer`` is
    the path of a byte-level vocabulary on every machine.
    """
    spark = docs.sparkSession
    path, parts = tokenizer, parts_of(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    texts = rows.select("text")

    def chunks(body: bytes) -> Iterator[tuple[int, int, bytes]]:
        start = 0
        for end in chunk_bounds(body, chunk_bytes):
            yield start, end, chunk_key(body[start:end])
            start = end

    def count(stream):
        seen: dict[int, int] = {}
        for (text,) in stream:
            for _, _, key in chunks(text.encode()):
                h = _short(key)
                seen[h] = seen.get(h, 0) + 1
            if len(seen) > 200_000:
                yield from seen.items()
                seen = {}
        yield from seen.items()

    bitmap = spark.sparkContext.broadcast(shared_filter(mapped(texts, "h long, n long", count, 65536), filter_bits))

    def digests(ids: np.ndarray) -> tuple:
        return len(ids), sha256(ids.tobytes()).hexdigest(), sha256(decode(ids, path)).hexdigest()

    def alone(stream):
        """Documents without a shared chunk are finished here; the others go on with their texts."""
        encode, shared, sent = encoder(path), bitmap.value, set()
        for id_, text in stream:
            body = text.encode()
            text_key = chunk_key(body)
            if not any(_in_filter(shared, filter_bits, _short(key)) for _, _, key in chunks(body)):
                yield id_, text_key, *digests(encode(text)), None
            elif text_key in sent:
                yield id_, text_key, None, None, None, None
            else:
                if len(sent) < 500_000:  # it only saves sending a text twice
                    sent.add(text_key)
                yield id_, text_key, None, None, None, text

    def references(stream):
        shared = bitmap.value
        for text_key, text in stream:
            body = text.encode()
            for start, end, key in chunks(body):
                if _in_filter(shared, filter_bits, _short(key)):
                    yield text_key, key, start, end

    def shared_chunks(stream):
        shared, sent = bitmap.value, set()
        for _, text in stream:
            body = text.encode()
            for start, end, key in chunks(body):
                if key not in sent and _in_filter(shared, filter_bits, _short(key)):
                    if len(sent) < 500_000:
                        sent.add(key)
                    yield key, body[start:end]

    def encode_once(stream):
        encode, before = encoder(path), None
        for key, body in stream:
            if key != before:
                before = key
                yield key, encode(body.decode("utf-8")).astype("<u2" if len(_token_bytes(path)) <= 65536 else "<u4").tobytes()

    def assemble(stream):
        width = "<u2" if len(_token_bytes(path)) <= 65536 else "<u4"
        encode = encoder(path)
        for text_key, text, starts, ends, ids in stream:
            body = text.encode()
            pieces, at = [], 0
            for start, end, got in sorted(zip(starts or [], ends or [], ids or [], strict=True)):
                if start > at:
                    pieces.append((body[at:start], encode(body[at:start].decode("utf-8"))))
                pieces.append((body[start:end], np.frombuffer(got, dtype=width).astype("<u4")))
                at = end
            if at < len(body):
                pieces.append((body[at:], encode(body[at:].decode("utf-8"))))
            yield text_key, *digests(join_encoded(pieces, path))

    # Written once: its texts are read by three branches.
    finished = cut_lineage(mapped(
        rows, "id long, text_key binary, n_tokens long, ids_sha256 string, decoded_sha256 string, text string", alone
    ))
    distinct = finished.filter("text is not null").groupBy("text_key").agg(F.first("text").alias("text"))
    refs = mapped(distinct, "ref_text binary, ref_key binary, start int, stop int", references)
    once = mapped(
        mapped(distinct, "key binary, body binary", shared_chunks)
        .repartition(parts, "key").sortWithinPartitions("key"),
        "key binary, ids binary", encode_once,
    )
    # A text has as many references as chunks, so this group is bounded by its own length.
    gathered = (
        refs.join(once, F.col("ref_key") == F.col("key"))
        .groupBy("ref_text")
        .agg(F.collect_list(F.struct("start", "stop", "ids")).alias("found"))
    )
    together = distinct.join(gathered, F.col("text_key") == F.col("ref_text"), "left").select(
        "text_key", "text",
        F.col("found.start").alias("starts"), F.col("found.stop").alias("stops"), F.col("found.ids").alias("ids"),
    )
    assembled = mapped(
        together, "made_key binary, made_n long, made_ids string, made_text string", assemble
    )
    return finished.drop("text").join(assembled, F.col("text_key") == F.col("made_key"), "left").select(
        "id", "text_key",
        F.coalesce("n_tokens", "made_n").alias("n_tokens"),
        F.coalesce("ids_sha256", "made_ids").alias("ids_sha256"),
        F.coalesce("decoded_sha256", "made_text").alias("decoded_sha256"),
    )
