"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no token of the vocabulary can lie inside no
token of any encoding, so a token ends between its two bytes wherever the pair
stands.  Where such a pair also is a sure boundary of the tokenizer's own
pre-splitting pattern, the text can be cut there, the fragments encoded on
their own and the ids concatenated: the result equals encoding the whole text.
Fragments repeat (most are words), so each distinct one is encoded once per
step.  The work is one narrow pass: no shuffle, no state between rows.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tessera.llm.common import arrow_map, steps, text_bytes

#: Bytes that the fragments a task remembers may take, about; only speed depends on it.
REMEMBERED = 48 << 20
EACH = 400  # bytes of one remembered fragment beside its own, its ids and its decoded bytes
STEP = 2 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable character that byte-level BPE writes for each byte, reversed."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    out |= {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
    return out


class ForcedBoundaryBPE:
    """Encoder and decoder of one byte-level tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        letters = byte_letters()
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = spec["model"]["vocab"]
        self.bytes_of = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        inside = np.zeros((256, 256), bool)
        for token, i in vocab.items():
            raw = token.encode() if token in self.added else bytes(letters[c] for c in token)
            self.bytes_of[i] = raw
            if token not in self.added:
                row = np.frombuffer(raw, np.uint8)
                inside[row[:-1], row[1:]] = True
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        # The pre-splitting pattern always separates a letter from a space, line end or
        # punctuation after it, and any visible ASCII character from white space after it.
        # It never looks back over such a place, so both sides split as in the whole text.
        letter = np.zeros(256, bool)
        letter[[*range(65, 91), *range(97, 123)]] = True
        visible = np.zeros(256, bool)
        visible[0x21:0x7F] = True
        white = np.zeros(256, bool)
        white[[0x20, 0x0A, 0x0D, 0x09]] = True
        punctuation = visible & ~letter
        punctuation[ord("'")] = False
        sure = (visible[:, None] & white[None, :]) | (letter[:, None] & punctuation[None, :])
        # Any added token is matched before splitting; a cut inside one would hide it.
        self.cut = sure & ~inside
        self.known: dict[bytes, tuple[int, bytes, bytes]] = {}
        self.held = 0

    def fragments(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """All fragments in order, and the n+1 offsets of each text's fragments."""
        begins = np.zeros(len(raw), bool)
        if len(raw):
            begins[1:] = self.cut[raw[:-1], raw[1:]]
            data = raw.tobytes()
            for token in self.added:  # no cut inside an added token
                needle, at = token.encode(), data.find(token.encode())
                while at >= 0:
                    begins[at + 1 : at + len(needle)] = False
                    at = data.find(needle, at + len(needle))
            starts = offsets[:-1]
            begins[starts[starts < len(raw)]] = True
        at = np.flatnonzero(begins)
        bounds = np.append(at, len(raw)).astype(np.int64)
        out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))])
        return out, np.searchsorted(at, offsets)

    def encode_fragments(self, distinct: list[bytes]) -> list[tuple[int, bytes, bytes]]:
        """Of each fragment: its number of ids, the ids as text, the bytes they decode to."""
        if self.held > REMEMBERED:
            self.forget()
        new = [x for x in distinct if x not in self.known]
        for i in range(0, len(new), 5_000):
            part = new[i : i + 5_000]
            for x, e in zip(part, self.tokenizer.encode_batch_fast([p.decode() for p in part], add_special_tokens=False), strict=True):
                ids = e.ids
                self.known[x] = made = (len(ids), ",".join(map(str, ids)).encode(), b"".join([self.bytes_of[k] for k in ids]))
                self.held += EACH + len(x) + len(made[1]) + len(made[2])
        return [self.known[x] for x in distinct]

    def forget(self) -> None:
        self.known.clear()
        self.held = 0

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, list[bytes], list[bytes]]:
        """Per text: number of ids, ids as comma-joined text, decoded bytes."""
        raw, offsets = text_bytes(texts)
        parts, ends = self.fragments(raw, offsets)
        coded = parts.dictionary_encode()
        made = self.encode_fragments(coded.dictionary.to_pylist())
        codes = coded.indices
        counts = np.array([m[0] for m in made], np.int64)[codes.to_numpy(zero_copy_only=False)] if made else np.zeros(0, np.int64)
        total = np.append(0, np.cumsum(counts))
        lists = lambda k, sep: pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([m[k] for m in made], pa.binary()).take(codes)), sep).to_pylist()
        return total[ends[1:]] - total[ends[:-1]], lists(1, b","), lists(2, b"")


@lru_cache(maxsize=1)
def coder(path: str) -> ForcedBoundaryBPE:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
    return ForcedBoundaryBPE(path)


def encode_decode(docs: DataFrame, *, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, keep_text: bool = False) -> DataFrame:
    """Encode each whole text and decode the ids again.

    Returns ``id_col``, the columns of ``keep``, n_tokens, ids_sha256 and decoded_sha256,
    and with ``keep_text`` ids (comma-joined) and decoded.

    Null and empty texts have no ids: n_tokens 0 and the hash of the empty string.
    Very long texts are encoded whole.  Repeated rows give repeated results; an empty
    table gives no rows.  Other columns, whatever their names, are not read.
    """
    path = path or default_path()
    kept = [id_col, *(keep or [])]
    types = ", ".join(f"k{j} {docs.schema[c].dataType.simpleString()}" for j, c in enumerate(kept))
    schema = f"{types}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids string, decoded string" if keep_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            for part in steps(batch, "text", STEP):
                n, ids, decoded = bpe.encode(part.column("text"))
                text = [d.decode("utf-8", "replace") for d in decoded]
                cols = [*(part.column(f"k{j}") for j in range(len(kept))), pa.array(n), [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(x.encode()).hexdigest() for x in text]]
                if keep_text:
                    cols += [[x.decode() for x in ids], text]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.string()) for c in cols], names=names)
        bpe.forget()

    made = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep_text
    names = [f"k{j}" for j in range(len(kept))] + made
    rows = docs.select(*[docs[c].alias(f"k{j}") for j, c in enumerate(kept)], docs[text_col].alias("text"))
    return arrow_map(rows, run, schema).toDF(*kept, *made)
