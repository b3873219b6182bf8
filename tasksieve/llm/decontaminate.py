"""Benchmark passages in documents: one Aho-Corasick automaton over the normalised windows of all items.

Words are runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased. A window is 13 consecutive words of an
item, or the whole of a shorter one. The windows, as sequences of word numbers, make the automaton: one node a word, about ``NODE_BYTES`` each. A text's words are turned into
numbers (0 for a word in no window) and scanned once; each find gives words whose places in the original text are known.

Test sets do not grow with the corpus. Their windows are measured in Spark first: as long as the automaton stays within
``automaton_bytes`` there is one, which each Python worker builds once and keeps; beyond that windows are dealt by hash into shards of that
size and the texts are scanned once per shard, so nothing is left out.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tasksieve.llm.stored import small_batches, tidy
from tasksieve.llm.words import ALNUM, LOWER, find_words, text_bytes

#: One byte string per step: lower-case and turn every separator into a space.
_SPACED = bytes(LOWER[b] if ALNUM[b] else 32 for b in range(256))
_SPAN = "array<struct<first:bigint,stop:bigint,start:bigint,end:bigint>>"
_FOUND = f"doc_id bigint, digest string, n_words bigint, items array<string>, spans {_SPAN}"


@dataclass(frozen=True)
class Decontamination:
    """window: words a window; contaminated if share * hit words >= words; spans closer than a word are one."""

    window: int = 13
    share: int = 20
    automaton_bytes: int = 192 << 20


def normalised(text: str | None) -> str:
    """The words with one space before, between and after them; no word gives a single space."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_SPACED).split()
    return " " + "".join(w.decode("utf-8", "surrogatepass") + " " for w in words)


def windows(benchmark: DataFrame, op: Decontamination) -> DataFrame:
    """Distinct ``(window, items)``: the normalised window and the sorted ids of the items that hold it; an item without an id adds none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                words = normalised(text).split(" ")[1:-1]
                own = {" " + " ".join(words[i : i + op.window]) + " " for i in range(max(1, len(words) - op.window + 1))} if words else ()
                found += own
                ids += [item] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.string())], ["item_id", "window"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.mapInArrow(tidy(run), "item_id string, window string").groupBy("window").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


_BUILT: dict[str, tuple[dict[bytes, int], ahocorasick.Automaton]] = {}
#: What a word of a window takes in a built automaton and in its list of numbers, rounded up (a test measures it).
NODE_BYTES = 96


def _automaton(key: str, patterns: list[tuple[str, tuple[str, ...]]]) -> tuple[dict[bytes, int], ahocorasick.Automaton]:
    """The numbers of the windows' words and the automaton over them, built once per Python worker."""
    if key not in _BUILT:
        _BUILT.clear()
        numbers: dict[bytes, int] = {}
        built = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, items in patterns:
            words = window.encode("utf-8", "surrogatepass").split()
            built.add_word(tuple(numbers.setdefault(w, len(numbers) + 1) for w in words), (len(words), items))
        if len(built):
            built.make_automaton()
        _BUILT[key] = numbers, built
    return _BUILT[key]


def _scanner(held, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, automaton = _automaton(key, held.value)
        for batch in batches:
            texts = batch.column("text")
            data, offsets = text_bytes(texts)
            out = ([], [], [], [], [])
            digests = batch.column("digest").to_pylist()
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                tokens = raw.translate(_SPACED).split()
                found = list(automaton.iter(tuple(numbers.get(w, 0) for w in tokens))) if tokens and len(automaton) else []
                items: set[str] = set()
                spans = []
                if found:
                    # A find is the place of its last word and the number of its words.
                    hit = np.zeros(len(tokens) + 1, np.int64)
                    ends = np.array([e for e, _ in found]) + 1
                    np.add.at(hit, ends - [n for _, (n, _) in found], 1)
                    np.add.at(hit, ends, -1)
                    covered = np.cumsum(hit)[:-1] > 0
                    for _, (_, own) in found:
                        items.update(own)
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
                    words = find_words(pa.array([raw], pa.large_binary()), ALNUM)
                    for s, e in zip(edges[::2], edges[1::2]):
                        low, high = int(words.start[s]), int(words.end[e - 1])
                        begin = len(raw[:low].decode("utf-8", "surrogatepass"))
                        end = begin + len(raw[low:high].decode("utf-8", "surrogatepass"))
                        spans.append({"first": int(s), "stop": int(e), "start": begin, "end": end})
                for column, value in zip(out, (doc_id, digests[i], len(tokens), sorted(items), spans)):
                    column.append(value)
            span = pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "stop", "start", "end")]))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), span)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "digest", "n_words", "items", "spans"])

    return run


def _scan(rows: DataFrame, shard: list) -> DataFrame:
    patterns = [(r["window"], tuple(r["items"])) for r in shard]
    key = hashlib.sha256("\n".join(sorted(w + ",".join(i) for w, i in patterns)).encode("utf-8", "surrogatepass")).hexdigest()
    return rows.mapInArrow(tidy(_scanner(rows.sparkSession.sparkContext.broadcast(patterns), key)), _FOUND)


def find_benchmark(documents: DataFrame, benchmark: DataFrame, op: Decontamination = Decontamination()) -> DataFrame:
    """``(doc_id, n_words, n_hit, items, spans, contaminated)`` for each row of ``documents`` (doc_id, text).

    ``spans`` are code-point places [start, end) in the original text; ``items`` the sorted ids (as text) of the items with a
    window in it; a window of an item without an id counts as any other, but names none. Null and empty texts have no words and are clean, as
    are all without benchmark rows; items without words match nothing, repeated items count once. With several shards, rows that share a doc_id are merged and must be equal.
    """
    small_batches(documents.sparkSession)
    patterns = windows(benchmark, op).persist()
    words = F.length("window") - F.length(F.replace("window", F.lit(" "))) - 1
    size = patterns.agg(F.coalesce(F.sum(words * NODE_BYTES + F.octet_length("window") + F.octet_length(F.to_json("items"))), F.lit(0))).first()[0]
    shards = max(1, -(-size // op.automaton_bytes))
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")) if shards > 1 else F.lit(None).cast("string")
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), digest.alias("digest"))
    parts = []
    for k in range(shards):
        # Each shard is about automaton_bytes at most, whatever the benchmark's size.
        shard = patterns.where(F.pmod(F.xxhash64("window"), F.lit(shards)) == k).collect()
        parts.append(_scan(rows, shard).withColumn("shard", F.lit(k)))
    patterns.unpersist()
    found = parts[0].drop("shard") if shards == 1 else _merged(functools.reduce(DataFrame.unionByName, parts))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["first"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), "items", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("spans"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (op.share * F.col("n_hit") >= F.col("n_words")))


def _merged(found: DataFrame) -> DataFrame:
    """The finds of all shards by document: spans that overlap become one; repeated rows come back as often as they were."""
    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    by_text = found.groupBy("doc_id", "digest").agg(
        F.max("n_words").alias("n_words"), F.sum(F.when(F.col("shard") == 0, 1).otherwise(0)).cast("int").alias("times"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), spans.alias("spans"),
    )

    def joined(done, span):
        last = F.get(done, F.size(done) - 1)
        longer = F.named_struct(
            F.lit("first"), last["first"], F.lit("stop"), F.greatest(last["stop"], span["stop"]), F.lit("start"), last["start"],
            F.lit("end"), F.greatest(last["end"], span["end"]),
        )
        kept = F.slice(done, F.lit(1), F.size(done) - 1)
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["stop"] >= span["first"]), F.concat(kept, F.array(longer))).otherwise(
            F.concat(done, F.array(span))
        )

    whole = F.aggregate("spans", F.expr(f"cast(array() AS {_SPAN})"), joined)
    return by_text.select("doc_id", "n_words", "items", whole.alias("spans"), F.explode(F.array_repeat(F.lit(1), F.col("times"))).alias("copy")).drop("copy")
