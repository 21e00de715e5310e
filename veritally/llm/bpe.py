"""BPE encoding and decoding with the merge ranks of a given vocabulary file.

A piece of text becomes a doubly linked list of symbols. A heap holds every adjacent pair that
has a merge rank; the lowest rank (leftmost first) is merged, the pairs beside it are pushed,
and entries that speak of symbols that have changed since are skipped when they come up.
Decoding looks each id up in the vocabulary and concatenates the strings, with the separator
that the vocabulary's missing decoder implies.

The vocabulary file is JSON in the common `tokenizers` layout: NFC, white space folded to one
blank, lower case, pieces by pattern, bytes as visible characters, an end-of-word suffix.
Special tokens are found in the raw text, leftmost and longest first, and are never split.

Every document is encoded whole inside its task; nothing is shuffled. Null and empty texts give
no ids. Repeated rows are encoded twice. The vocabulary is a fixed public file whose bytes (some
MB) travel with the task.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Unicode white space, as the vocabulary's normaliser takes it.
SPACE = r"\p{White_Space}"
#: Entries in the young half of a worker's cache. When it is full it becomes the old half, and what is still used moves back.
CACHE_PIECES = 150_000
LONGEST_CACHED = 64
#: Stops that are a piece of their own after letters.
STOPS = ".,;:!?"
PAIR_BITS = 24

SCHEMA = "doc_id bigint, n_tokens bigint, ids array<int>, decoded string"
DIGEST_SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def byte_characters() -> dict[int, str]:
    """The visible character that stands for each byte: itself if printable, else from 256 upwards."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in printable}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return table


class Vocabulary:
    def __init__(self, definition: str):
        spec = json.loads(definition)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.unknown = self.ids.get(model["unk_token"]) if model.get("unk_token") else None
        #: A pair of ids, as one number -> its rank; the id that each rank's pair becomes.
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, m in enumerate(model["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            self.ranks[self.ids[left] << PAIR_BITS | self.ids[right]] = rank
            self.merged.append(self.ids[left + right])
        #: The same by left id: its partners and their ranks.
        none: dict[int, int] = {}
        self.partners = [none] * (1 + max([0, *self.ids.values()]))
        for pair, rank in self.ranks.items():
            left = pair >> PAIR_BITS
            if not self.partners[left]:
                self.partners[left] = {}
            self.partners[left][pair & ((1 << PAIR_BITS) - 1)] = rank
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.specials.items()}
        visible = byte_characters()
        self.byte_ids = [self.ids.get(visible[b], self.unknown) for b in range(256)]
        self.last_ids = [self.ids.get(visible[b] + self.suffix, self.unknown) for b in range(256)]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"].replace(r"\s", SPACE))
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.space = regex.compile(f"{SPACE}+")
        self.packed = {i: struct.pack("<I", i) for i in self.strings}
        # Pieces, and runs of text without blanks, with their packed ids and the text these decode to.
        self.young: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge the symbols (ids) of one piece until no adjacent pair has a rank.

        A heap entry is rank and place in one number. It is stale, and skipped, unless the pair
        that now begins at that place has that very rank.
        """
        n = len(symbols)
        partners, merged = self.partners, self.merged
        ranks = [partners[a].get(b, -1) for a, b in zip(symbols, symbols[1:], strict=False)]
        ranks.append(-1)
        place_bits = n.bit_length()
        place = (1 << place_bits) - 1
        heap = [r << place_bits | i for i, r in enumerate(ranks) if r >= 0]
        if not heap:
            return symbols
        heapq.heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            entry = heapq.heappop(heap)
            i = entry & place
            rank = entry >> place_bits
            if ranks[i] != rank:
                continue
            j = after[i]
            k = after[j]
            symbol = symbols[i] = merged[rank]
            symbols[j] = -1
            ranks[j] = ranks[i] = -1
            after[i] = k
            if k < n:
                before[k] = i
                r = partners[symbol].get(symbols[k], -1)
                if r >= 0:
                    ranks[i] = r
                    heapq.heappush(heap, r << place_bits | i)
            h = before[i]
            if h >= 0:
                r = ranks[h] = partners[symbols[h]].get(symbol, -1)
                if r >= 0:
                    heapq.heappush(heap, r << place_bits | h)
        return [s for s in symbols if s >= 0]

    def decode(self, ids: list[int]) -> str:
        strings = self.strings
        return " ".join([strings[i] for i in ids if i in strings])

    def _known(self, key: str) -> tuple[bytes, str] | None:
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.young[key] = found
        return found

    def _keep(self, key: str, found: tuple[bytes, str]) -> tuple[bytes, str]:
        if len(key) <= LONGEST_CACHED:
            if len(self.young) >= CACHE_PIECES:
                self.old, self.young = self.young, {}
            self.young[key] = found
        return found

    def _piece(self, piece: str) -> tuple[bytes, str]:
        """Ids (little-endian, 32 bits) and decoded text of one piece."""
        found = self._known(piece)
        if found is None:
            raw = piece.encode()
            byte_ids = self.byte_ids
            symbols = [byte_ids[b] for b in raw]
            symbols[-1] = self.last_ids[raw[-1]]
            ids = self.merge([s for s in symbols if s is not None])
            packed = self.packed
            found = self._keep(piece, (b"".join([packed[i] for i in ids]), self.decode(ids)))
        return found

    def _chunk(self, chunk: str) -> tuple[bytes, str]:
        """The same of a run of text without blanks."""
        base = chunk.rstrip(STOPS)
        if base.isascii() and base.isalpha():
            if len(base) == len(chunk):
                return self._piece(chunk)
            parts = [self._piece(base), self._piece(chunk[len(base) :])]
        else:
            parts = [self._piece(piece) for piece in self.pieces.findall(chunk)]
            if len(parts) == 1:
                return parts[0]
        return self._keep(chunk, (b"".join([a for a, _ in parts]), " ".join([b for a, b in parts if a])))

    def _plain(self, text: str, out: list[tuple[bytes, str]]) -> None:
        if text.isascii():
            text = text.lower()
        else:
            # Letters are lowered one by one, so a capital sigma never depends on its place.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        chunks = self.space.sub(" ", text).split(" ")
        known = self.young.get
        found = [known(c) for c in chunks]
        for i, c in enumerate(chunks):
            if found[i] is None and c:
                found[i] = self._known(c) or self._chunk(c)
        out += [f for f in found if f]

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and the text they decode to."""
        out: list[tuple[bytes, str]] = []
        start = 0
        if self.special is not None and any(s in text for s in self.specials):
            for m in self.special.finditer(text):
                self._plain(text[start : m.start()], out)
                out.append((np.array([self.specials[m.group()]], "<u4").tobytes(), m.group()))
                start = m.end()
        self._plain(text[start:], out)
        return b"".join([a for a, _ in out]), " ".join([b for a, b in out if a])


@lru_cache(maxsize=2)
def _vocabulary(definition: str) -> Vocabulary:
    return Vocabulary(definition)


def _shared(spark: SparkSession, path: str):
    """The file's text as a broadcast: executors may lack the driver's files. Its size is that of a public vocabulary."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _encoded(docs: DataFrame, path: str, id_col: str, text_col: str, schema: str, finish) -> DataFrame:
    shared = _shared(docs.sparkSession, path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [vocabulary.encode(text or "") for text in part.column(1).to_pylist()]
                yield finish(part.column(0), found)

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(encode, schema)


def encode_decode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and the text they decode to."""

    def finish(ids, found):
        rows = [np.frombuffer(a, "<u4").astype(np.int32) for a, _ in found]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([len(r) for r in rows], pa.int64()), pa.array(rows, pa.list_(pa.int32())), pa.array([b for _, b in found], pa.string())],
            names=["doc_id", "n_tokens", "ids", "decoded"],
        )

    return _encoded(docs, vocabulary_path, id_col, text_col, SCHEMA, finish)


def encode_digests(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The same encoding with only the digests of its two results, and the ids if asked for, leaving the task."""

    def finish(ids, found):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        columns = {
            "doc_id": ids,
            "n_tokens": pa.array([len(a) // 4 for a, _ in found], pa.int64()),
            "ids_sha256": pa.array([sha(a) for a, _ in found], pa.string()),
            "decoded_sha256": pa.array([sha(b.encode("utf-8", "surrogatepass")) for _, b in found], pa.string()),
        }
        if with_ids:
            columns["ids"] = pa.array([np.frombuffer(a, "<i4") for a, _ in found], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return _encoded(docs, vocabulary_path, id_col, text_col, DIGEST_SCHEMA + (", ids array<int>" if with_ids else ""), finish)
