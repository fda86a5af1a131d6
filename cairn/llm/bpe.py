"""Byte-level BPE: a backtracking encoder in linear time, and a decoder that reads an offset table.

An Aho-Corasick automaton over all tokens gives the longest token that begins at each byte of a piece.
The encoder walks from match to match. A token may follow another only if merging by rank would leave
just these two of the bytes they cover (the pair-compatibility rule, remembered in a table); if it may
not, the next shorter token that is a prefix is tried, and if there is none the last token is taken back.
An end of a token from which no way leads on is never tried again, so each is visited once. Since a
sequence whose neighbours are all compatible is the one that merging gives, the result is exact.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import read, slices, with_fields

#: Fixed value: how byte-level vocabularies cut text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose tokens a worker remembers: the first it meets, which the common ones are among.
REMEMBERED = 1 << 17
#: Bytes of text cut into pieces at once; a piece is looked up once in them.
TEXT_BYTES = 1 << 20
#: Pairs whose compatibility a worker remembers.
PAIRS = 1 << 17


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary: itself if printable, else the next from U+0100."""
    printable = [b for lo, hi in (("!", "~"), ("\xa1", "\xac"), ("\xae", "\xff")) for b in range(ord(lo), ord(hi) + 1)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes of all given ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Bpe:
    """A tokenizer from the bytes of its JSON file. Internally a token is its rank: bytes, then merges in order."""

    def __init__(self, blob: bytes):
        import ahocorasick
        import regex

        spec = json.loads(blob)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        names = [c for c in letters] + [a + b for a, b in merges]
        rank = {name: r for r, name in enumerate(names)}
        if len(rank) != len(names):
            raise ValueError("a token is made by two merges; ranks do not order such a vocabulary")
        self.ids = np.array([vocab[name] for name in names], np.uint32)
        own = range(len(letters))
        self.left = array("I", [*own, *(rank[a] for a, _ in merges)])
        self.right = array("I", [*own, *(rank[b] for _, b in merges)])
        self.merged = {a * len(names) + b: r for r, (a, b) in enumerate(zip(self.left, self.right, strict=True)) if r >= len(letters)}
        self.latin = [bytes(letters[c] for c in name).decode("latin-1") for name in names]
        self.rank = {t: r for r, t in enumerate(self.latin)}
        self.size = array("I", map(len, self.latin))
        self.automaton = ahocorasick.Automaton()
        for r, t in enumerate(self.latin):
            self.automaton.add_word(t, r)
        self.automaton.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.pieces = regex.compile(PATTERN).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.shorter = cache(self._shorter)
        self.fits = lru_cache(PAIRS)(self._fits)
        table = {int(self.ids[r]): t.encode("latin-1") for r, t in enumerate(self.latin)} | {i: s.encode() for s, i in self.special.items()}
        parts = [table.get(i, b"") for i in range(max(table) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)

    def _shorter(self, r: int) -> int:
        """The longest token that is a proper prefix; -1 if none."""
        t = self.latin[r]
        return next((self.rank[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.rank), -1)

    def _fits(self, a: int, b: int) -> bool:
        """Whether merging keeps these two apart: undo merges at their seam, the latest first, and look for a
        merge across it that would have come before the one undone last."""
        n = before = len(self.latin)
        while True:
            if self.merged.get(a * n + b, before) < before:
                return False
            left, right = self.right[a], self.left[b]
            # of two halves at the seam that are still to be undone, the one merged later goes first;
            # a merge across the seam wins a tie with the right one, which lies further on
            if left == a and right == b:
                return True
            if right == b or (left != a and a > b):
                before, a = a, left
            else:
                before, b = b + 1, right

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        text = piece.encode().decode("latin-1")
        whole = len(text)
        if whole == 1:
            return (int(self.ids[self.rank[text]]),)
        longest = [0] * whole
        for end, r in self.automaton.iter(text):
            longest[end + 1 - self.size[r]] = r
        open_ends, out, at, token = bytearray(b"\1") * (whole + 1), [], 0, longest[0]
        size, fits, shorter = self.size, self.fits, self.shorter
        while True:
            end = at + size[token]
            if open_ends[end] and (not out or fits(out[-1], token)):
                out.append(token)
                if end == whole:
                    return tuple(self.ids[out].tolist())
                at, token = end, longest[end]
                continue
            while (less := shorter(token)) < 0:
                open_ends[at] = 0
                token = out.pop()
                at -= size[token]
            token = less

    def tokens(self, piece: str) -> tuple[int, ...]:
        if (got := self.known.get(piece)) is None:
            got = self.encode_piece(piece)
            if len(piece) <= 64 and len(self.known) < REMEMBERED:
                self.known[piece] = got
        return got

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the texts, one after the other, and how many each text has."""
        words, counts, specials = [], [], {}
        for text in texts:
            n = len(words)
            if text:
                at = 0
                for m in self.cut.finditer(text) if self.cut else ():
                    words += self.pieces(text[at : m.start()])
                    specials[len(words)] = self.special[m[0]]
                    words.append("")
                    at = m.end()
                words += self.pieces(text[at:] if at else text)
            counts.append(len(words) - n)
        coded = pa.array(words, pa.string()).dictionary_encode()
        pieces = [self.tokens(w) if w else () for w in coded.dictionary.to_pylist()]
        index = coded.indices.to_numpy(zero_copy_only=False)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.fromiter((t for p in pieces for t in p), np.uint32, int(sizes.sum()))
        starts, n = (np.cumsum(sizes) - sizes)[index], sizes[index]
        if specials:
            for k, v in specials.items():
                starts[k], n[k] = len(flat), 1
                flat = np.append(flat, np.uint32(v))
        ends = np.concatenate([[0], np.cumsum(n)])
        edges = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        return flat[gather(starts, n)], np.diff(ends[edges])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, from the offset table."""
        starts = self.offsets[ids]
        return self.bytes[gather(starts, self.offsets[ids.astype(np.int64) + 1] - starts)].tobytes()


@lru_cache(2)
def _load(digest: str, held) -> Bpe:
    return Bpe(held.blob)


class Vocabulary:
    """The file's bytes as they travel to the executors; a worker builds the tables once."""

    def __init__(self, spark, path: str):
        with open(path, "rb") as f:
            blob = f.read()
        self.digest, self.sent = hashlib.sha256(blob).hexdigest(), spark.sparkContext.broadcast(blob)

    @property
    def blob(self) -> bytes:
        return self.sent.value

    def __eq__(self, other):
        return self.digest == other.digest

    def __hash__(self):
        return hash(self.digest)

    def model(self) -> Bpe:
        return _load(self.digest, self)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long, ids binary) for every row; ``ids`` are little-endian unsigned 32-bit numbers.

    The vocabulary's file is read on the driver and sent along (its size is fixed). Strings of special
    tokens in a text become those tokens. Null and empty texts give no tokens and empty ``ids``. Null and
    repeated ids are rows of their own; other columns are not read; an empty table gives no rows.
    """
    vocabulary = Vocabulary(docs.sparkSession, path)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        model = vocabulary.model()
        for batch in batches:
            for part in slices(batch, limit=TEXT_BYTES):
                ids, n = model.encode(part.column(1).to_pylist())
                raw, edges = memoryview(ids.astype("<u4").tobytes()), np.concatenate([[0], 4 * np.cumsum(n)]).tolist()
                packed = pa.array([bytes(raw[a:b]) for a, b in zip(edges, edges[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), packed], names=["id", "n_tokens", "ids"])

    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids binary")
    return made.withColumnRenamed("id", id_col)


def decode(coded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``coded`` with ``decoded``, the text of the tokens; bytes that are not UTF-8 become U+FFFD; null ids: empty."""
    vocabulary = Vocabulary(coded.sparkSession, path)
    fields = with_fields(coded, decoded="string")

    def run(batches):
        model = vocabulary.model()
        for batch in batches:
            for part in slices(batch, ids_col):
                ids = part.column(part.schema.get_field_index(ids_col)).to_pylist()
                texts = [model.decode(np.frombuffer(x or b"", "<u4")).decode("utf-8", "replace") for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])

    return coded.mapInArrow(run, fields)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of what encode() and decode() give."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    both = decode(encode(docs, path), path)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"))
