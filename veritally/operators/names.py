"""Listed names in texts: one pass of an automaton over a text, whatever the number and length of the names.

A hit is a listed surface that begins where a word begins and ends where one ends; names may overlap and
all hits are found. A list within the bound goes to every task. A longer one is cut in shards, each within the bound, and
every shard meets every text in a task that holds that shard alone, so neither the driver nor
a task ever holds the whole list. Both ways use the same search.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritally.scale import SMALL_SIDE_ROWS

# Fixed value: what separates words.
WORD = r"[^\s.,;:!?()\[\]{}\"]+"

#: Hits gathered before they leave a task.
FLUSH_HITS = 100_000


class NameSearch:
    """An Aho-Corasick automaton over surfaces with their types."""

    def __init__(self, names: Iterable[tuple[str, str]]):
        import ahocorasick

        types: dict[str, list[str]] = {}
        word = re.compile(WORD)
        for surface, entity_type in names:
            # A surface that does not begin and end with a word can never be a run of words.
            if surface and word.match(surface) and word.match(surface[-1]):
                types.setdefault(surface, []).append(entity_type)
        self.automaton = ahocorasick.Automaton()
        for surface, kinds in types.items():
            self.automaton.add_word(surface, (len(surface), surface, tuple(sorted(set(kinds)))))
        if types:
            self.automaton.make_automaton()
        self.empty = not types
        self.in_word = re.compile(WORD).match

    def find(self, text: str | None) -> Iterator[tuple[int, int, str, tuple[str, ...]]]:
        """(start, end, surface, types) in the order of ends, then of starts."""
        if self.empty or not text:
            return
        size, in_word = len(text), self.in_word
        held: list[tuple[int, int, str, tuple[str, ...]]] = []
        for last, (length, surface, kinds) in self.automaton.iter(text):
            start, end = last + 1 - length, last + 1
            if (end < size and in_word(text[end])) or (start and in_word(text[start - 1])):
                continue
            if held and held[0][1] != end:
                yield from sorted(held)
                held = []
            held.append((start, end, surface, kinds))
        yield from sorted(held)


@lru_cache(maxsize=2)
def _search(names: tuple[tuple[str, str], ...]) -> NameSearch:
    return NameSearch(names)


def _hits_schema(docs: DataFrame) -> T.StructType:
    return T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
         T.StructField("surface", T.StringType()), T.StructField("entity_type", T.StringType())]
    )


class _Hits:
    """Hits of one batch of texts as columns."""

    def __init__(self) -> None:
        self.rows: list[int] = []
        self.columns: tuple[list, list, list, list] = ([], [], [], [])

    def add(self, row: int, start: int, end: int, surface: str, entity_type: str) -> None:
        self.rows.append(row)
        for column, value in zip(self.columns, (start, end, surface, entity_type), strict=True):
            column.append(value)

    def batch(self, ids: pa.Array) -> pa.RecordBatch:
        start, end, surface, kind = self.columns
        arrays = [ids.take(pa.array(self.rows, pa.int32())), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(surface, pa.string()), pa.array(kind, pa.string())]
        self.__init__()
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "end", "surface", "entity_type"])


def _searched(search: NameSearch, ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    hits = _Hits()
    for row, text in enumerate(texts):
        for start, end, surface, kinds in search.find(text.as_py()):
            for kind in kinds:
                hits.add(row, start, end, surface, kind)
            if len(hits.rows) >= FLUSH_HITS:
                yield hits.batch(ids)
    if hits.rows:
        yield hits.batch(ids)


def find_names(docs: DataFrame, names: DataFrame, max_rows: int = SMALL_SIDE_ROWS) -> DataFrame:
    """(doc_id, start, end, surface, entity_type) of every hit of `names` (surface, entity_type) in `docs` (doc_id, text)."""
    listed = names.filter(F.length("surface") > 0).select("surface", "entity_type").distinct()
    head = listed.limit(max_rows + 1).collect()
    schema = _hits_schema(docs)
    if len(head) > max_rows:
        return _find_in_shards(docs, listed, -(-listed.count() // max_rows), schema)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(sorted((r.surface, r.entity_type or "") for r in head)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _search(shared.value)
        for batch in batches:
            yield from _searched(found, batch.column(0), batch.column(1))

    return docs.select("doc_id", "text").mapInArrow(search, schema)


def _find_in_shards(docs: DataFrame, names: DataFrame, shards: int, schema: T.StructType) -> DataFrame:
    """The same where the list is cut by a hash in `shards`, and the texts in pieces: a task has one shard and one piece.

    Names come first in a task's order, so the automaton is complete before the first text; texts
    stream past it.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = max(1, -(-tasks // shards))
    every_piece = F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    no_id = F.lit(None).cast(schema["doc_id"].dataType)
    listed = names.select(F.pmod(F.xxhash64("surface"), F.lit(shards)).cast("int").alias("shard"), every_piece.alias("piece"), F.lit(0).alias("kind"), no_id.alias("doc_id"), F.col("surface").alias("body"), "entity_type")
    texts = docs.filter(F.length("text") > 0).select(every_shard.alias("shard"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(pieces)).cast("int").alias("piece"), F.lit(1).alias("kind"), "doc_id", F.col("text").alias("body"), F.lit("").alias("entity_type"))
    dealt = listed.unionByName(texts).repartition(tasks, "shard", "piece").sortWithinPartitions("shard", "piece", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, names_here, found = None, [], None
        for batch in batches:
            places = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            at = 0
            while at < len(places):
                end = at
                while end < len(places) and places[end] == places[at]:
                    end += 1
                part = batch.slice(at, end - at)
                if places[at][:2] != place:
                    place, names_here, found = places[at][:2], [], None
                if places[at][2] == 0:
                    names_here += zip(part.column(4).to_pylist(), [t or "" for t in part.column(5).to_pylist()], strict=True)
                else:
                    if found is None:
                        found, names_here = NameSearch(names_here), []
                    yield from _searched(found, part.column(3), part.column(4))
                at = end

    return dealt.mapInArrow(search, schema)


def name_finder(names: dict[str, str], score: float = 0.85) -> Callable[[], Callable[[str], list[tuple[int, int, str, float]]]]:
    """A detector of listed names; `names` gives each one's type."""
    listed = tuple(sorted(names.items()))

    def factory() -> Callable[[str], list[tuple[int, int, str, float]]]:
        search = _search(listed)
        return lambda text: [(start, end, kind, score) for start, end, _, kinds in search.find(text) for kind in kinds]

    return factory
