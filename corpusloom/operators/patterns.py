"""Many patterns in many texts: an automaton of a block of patterns goes once over each text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialize

#: Characters of the patterns of one automaton, about: some hundred bytes each in a task. More patterns are more passes.
BLOCK_CHARS = 2_000_000


class Automaton:
    """Built once in each task from the patterns, which are distinct and not empty."""

    def __init__(self, patterns: list[str]):
        self.found = ahocorasick.Automaton()
        self.size = np.array([len(p) for p in patterns], np.int64)
        for k, p in enumerate(patterns):
            self.found.add_word(p, k)
        self.found.make_automaton()

    def counts(self, text: str) -> dict[int, int]:
        """How often each pattern occurs, from the left, occurrences of one pattern not overlapping."""
        out: dict[int, int] = {}
        ends: dict[int, int] = {}
        for end, k in self.found.iter(text):
            if end - self.size[k] >= ends.get(k, -1):
                ends[k] = end
                out[k] = out.get(k, 0) + 1
        return out


def contained(texts: DataFrame, key: str, text: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """(key, pattern, times): each text of texts with each pattern that it holds, also inside of words, and how often.

    Null and empty patterns are in no text, null texts hold none; repeated patterns count once. Blocks of about BLOCK_CHARS
    characters of patterns are broadcast, and each is a pass over the texts, which stay where they are; no text is held
    against patterns that it doesn't hold.
    """
    known = materialize(patterns.select(F.col(pattern).alias("pattern")).filter("pattern <> ''").distinct(), "patterns")
    chars = known.agg(F.coalesce(F.sum(F.length("pattern")), F.lit(0))).first()[0]
    kind = texts.select(key).schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, pattern string, times int"
    blocks = -(-chars // BLOCK_CHARS)
    passes = []
    for block in range(blocks):
        mine = known.filter(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == block)
        shared = texts.sparkSession.sparkContext.broadcast([r["pattern"] for r in mine.orderBy("pattern").collect()])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = Automaton(shared.value)
            for batch in batches:
                row, which, times = [], [], []
                for k, t in enumerate(batch.column("text").to_pylist()):
                    found = automaton.counts(t) if t and len(shared.value) else {}
                    row += [k] * len(found)
                    which += [shared.value[p] for p in found]
                    times += found.values()
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(which, pa.string()), pa.array(times, pa.int32())], [key, "pattern", "times"])

        passes.append(texts.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, passes) if passes else texts.sparkSession.createDataFrame([], schema)
