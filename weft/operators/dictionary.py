"""Dictionary matches in sentences by a trie over words, walked once along each sentence."""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from weft.functions import normalize as N

#: Fixed surfaces that are common words as well, matched only in exact case.
AMBIGUOUS = ("MET", "SET", "CA2", "PCA", "REST", "MAX", "AGO", "IMPACT", "CAD", "GC", "T", "APP", "ARC", "CAT", "COPE", "MICE", "SDS", "PIGS", "SHE", "CS")
#: Fixed generic words that never match alone.
GENERIC = ("cancer", "carcinoma", "tumor", "tumour", "obesity", "pain", "death", "response", "disease", "syndrome", "disorder", "infection", "inflammation", "deficiency", "failure", "injury", "aging", "ageing")
#: Shorter surfaces match in exact case only.
ANY_CASE_LENGTH = 5
#: A dictionary of up to so many bytes goes to every task; larger ones meet the words in joins.
BROADCAST_BYTES = 64 << 20

MATCH = [StructField("start", IntegerType()), StructField("n", IntegerType()), *[StructField(c, StringType()) for c in ("found", "node_id", "kind", "canonical")]]


def passes(found: str, surface: str) -> bool:
    """May a run of words stand for a surface: not a number, not a generic word; short and ambiguous ones in exact case."""
    if re.fullmatch("[0-9]+", found) or found.lower() in GENERIC:
        return False
    return found == surface or not (len(surface) < ANY_CASE_LENGTH or surface.upper() in AMBIGUOUS)


class Trie:
    """Surfaces by their lower-cased words, as numbers. A node is a dictionary of next words; under -1 it holds the entries that end there."""

    def __init__(self, entries: list[tuple[str, str, str, str]]) -> None:
        numbers: dict[str, int] = {}
        self.root: dict = {}
        for entry in entries:
            path = [w.lower() for w in WORDS.findall(entry[0])]
            if path and " ".join(path) == entry[0].lower():
                node = self.root
                for word in path:
                    node = node.setdefault(numbers.setdefault(word, len(numbers)), {})
                node.setdefault(-1, []).append(entry)
        self.words = pa.array(list(numbers), pa.string())
        self.begins = np.zeros(len(numbers) + 1, bool)
        self.begins[list(self.root)] = True

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Each word's number, one more than the largest for words that are in no surface."""
        return pc.index_in(pc.utf8_lower(words), value_set=self.words).fill_null(len(self.words)).to_numpy(zero_copy_only=False)

    def ends(self, numbers: list[int], start: int, stop: int) -> list[tuple[int, list[tuple]]]:
        """Where surfaces that begin at `start` end, the longest first, with their entries."""
        node, found = self.root, []
        for at in range(start, stop):
            node = node.get(numbers[at])
            if node is None:
                break
            if -1 in node:
                found.append((at + 1, node[-1]))
        return found[::-1]


#: The words of normalize.tokens.
WORDS = re.compile(r"[A-Za-z0-9]+(?:[.\-][A-Za-z0-9]+)*")


class _Entries:
    """A broadcast dictionary under a name of its own, so that a worker builds its trie once."""

    def __init__(self, broadcast: Broadcast) -> None:
        self.name, self.broadcast = uuid.uuid4().hex, broadcast

    def __hash__(self) -> int:
        return hash(self.name)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Entries) and other.name == self.name


@functools.lru_cache(2)
def _built(held: _Entries) -> Trie:
    return Trie(held.broadcast.value)


def _walk(held: _Entries, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Greedy matches of each sentence: only words that begin a surface are walked from, none inside a match."""
    trie = _built(held)
    for batch in batches:
        sentences = batch.column(2)
        offsets, words = sentences.offsets.to_numpy() - sentences.offsets[0].as_py(), sentences.flatten()
        numbers = trie.numbers(words)
        places = np.flatnonzero(trie.begins[numbers])
        rows = np.searchsorted(offsets, places, "right") - 1
        numbers, end, taken, out = numbers.tolist(), 0, [], []
        for start, row, stop in zip(places.tolist(), rows.tolist(), offsets[rows + 1].tolist(), strict=True):
            if start < end:
                continue
            for at, entries in trie.ends(numbers, start, stop):
                found = " ".join(words.slice(start, at - start).to_pylist())
                if kept := {e[1:] for e in entries if passes(found, e[0])}:
                    end = at
                    taken += [row] * len(kept)
                    out += [(start - int(offsets[row]), at - start, found, *e) for e in kept]
                    break
        if taken:
            known = batch.select([0, 1]).take(pa.array(taken))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(schema)[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([*known.columns, *columns], schema=schema)


def _chosen(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted matches (document, sentence, start, longest first) those that a walk takes; a sentence may stretch over batches."""
    last, end, run = None, 0, None
    for batch in batches:
        rows = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
        kept = []
        for i, (doc, sentence, start, n) in enumerate(rows):
            if (doc, sentence) != last:
                last, end, run = (doc, sentence), 0, None
            if start >= end:
                end, run = start + n, (start, n)
            if (start, n) == run:
                kept.append(i)
        if kept:
            yield pa.RecordBatch.from_arrays(batch.take(pa.array(kept)).columns, schema=schema)


def _by_joins(rows: DataFrame, surfaces: DataFrame, longest: int, schema: StructType) -> DataFrame:
    """For dictionaries of any size: runs of words that begin like a surface meet it in an equi-join; matches, not words, are dealt out by sentence and walked."""
    words = N.tokens(F.col("sentence"))
    runs = rows.select("doc_id", "sentence_no", words.alias("w")).filter("size(w) > 0").select("doc_id", "sentence_no", F.explode(F.expr(f"transform(w, (x, i) -> struct(i as start, slice(w, i + 1, {int(longest)}) as run))")).alias("r")).select("doc_id", "sentence_no", "r.start", "r.run")
    first = surfaces.select(F.lower(F.get(N.tokens(F.col("surface")), 0)).alias("first")).distinct()
    runs = runs.withColumn("first", F.lower(F.get("run", 0))).join(first, "first", "left_semi")
    sized = runs.select("doc_id", "sentence_no", "start", F.explode(F.expr("transform(sequence(1, size(run)), n -> struct(n as n, array_join(slice(run, 1, n), ' ') as found))")).alias("g")).select("doc_id", "sentence_no", "start", "g.n", "g.found")
    found, surface = F.col("found"), F.col("surface")
    exact = (F.length(surface) < ANY_CASE_LENGTH) | F.upper(surface).isin(*AMBIGUOUS)
    met = sized.withColumn("lower", F.lower("found")).join(surfaces.drop("n_tokens"), "lower").filter(~found.rlike("^[0-9]+$") & ~F.lower(found).isin(*GENERIC) & (~exact | (found == surface)))
    met = met.select("doc_id", "sentence_no", "start", "n", "found", "node_id", "kind", "canonical").distinct()
    dealt = met.repartition("doc_id", "sentence_no").sortWithinPartitions("doc_id", "sentence_no", "start", F.col("n").desc())
    return dealt.mapInArrow(functools.partial(_chosen, to_arrow_schema(schema)), schema)


def link(sentence_rows: DataFrame, surfaces: DataFrame, longest: int | None = None) -> DataFrame:
    """(doc_id, sentence_no, start, n, found, node_id, kind, canonical): longest non-overlapping matches, all entities of each.

    A dictionary (see `gazetteer`) whose counted size allows it goes to every task as a trie over lower-cased words; sentences are walked where
    they lie, in time that grows with their words. Larger ones meet runs of words in equi-joins, and a sentence's matches are walked in
    their order. A gate that fails lets a shorter run match. Sentences without words and surfaces that aren't words joined by one space match nothing.
    """
    rows = sentence_rows.select("doc_id", "sentence_no", "sentence").filter("sentence is not null")
    schema = StructType([rows.schema["doc_id"], rows.schema["sentence_no"], *MATCH])
    size = surfaces.agg(F.sum(F.length("surface") + F.length("node_id") + F.length("canonical") + 100)).first()[0] or 0
    if size > BROADCAST_BYTES:
        return _by_joins(rows, surfaces, longest or (surfaces.agg(F.max("n_tokens")).first()[0] or 1), schema)
    entries = [tuple(r) for r in surfaces.select("surface", "node_id", "kind", "canonical").distinct().collect()]
    held = _Entries(sentence_rows.sparkSession.sparkContext.broadcast(entries))
    words = rows.select("doc_id", "sentence_no", N.tokens(F.col("sentence")).alias("w")).filter("size(w) > 0")
    return words.mapInArrow(functools.partial(_walk, held, to_arrow_schema(schema)), schema)
