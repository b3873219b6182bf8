"""The whole pipeline on small tables against naive stages: rows without an id of their own, nulls, copies and clashing columns included."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import struct

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tasksieve.llm import byte_bpe, quality_ftrl
from tasksieve.llm.queries import byte_bpe_op, quality_weights
from tasksieve.llm.words import SAME, WORDS_AND_MARKS, find_words

SPACED, PLAIN = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, label int, score double, n long"


def lowered(text, words=SPACED):
    return words.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def prose(seed, n):
    draw = random.Random(seed)
    return [f"Word{draw.randrange(4000)}" for _ in range(n)]


def tables(spark, folder, docs, labels, benchmark):
    spark.createDataFrame([(i, t, "x", "y", len(t or ""), 7, 0.1, 3) for i, t in docs], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")


def fixture():
    docs = [(i, " ".join(prose(i, 60 + i))) for i in range(60)]
    docs += [(100 + i, " ".join(random.Random(i).choice(("buy", "cheap", "click", "win", "now", "!!!")) for _ in range(40 + i))) for i in range(60)]
    labels = [(i, 1, 0) for i in range(50)] + [(100 + i, 0, 0) for i in range(50)]
    shared = prose(777, 80)
    item = prose(888, 30)
    docs += [(200, docs[3][1]), (201, docs[3][1].upper()), (202, " ".join(prose(5, 65)[:-1] + ["Changed"]))]
    docs += [(210 + k, " ".join(prose(900 + k, 40) + shared + prose(950 + k, 30))) for k in range(4)]
    docs += [(220, " ".join(prose(960, 20) + item + prose(961, 10))), (221, " ".join(prose(962, 900) + item[:13]))]
    docs += [(None, " ".join(prose(970, 70))), (None, " ".join(prose(971, 70))), (None, docs[7][1]), (None, None), (None, "")]
    docs += [(300, " ".join(prose(972, 70))), (300, " ".join(prose(973, 70))), (300, " ".join(prose(972, 70))), (301, None), (302, " \n"), (303, "")]
    return docs, labels, [("a", " ".join(item)), (None, " ".join(prose(999, 20))), ("b", None), ("c", "")]


def components(sets, linked):
    part = list(range(len(sets)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                part[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(sets))]


def naive_score(text, weights, op):
    slots, _ = quality_ftrl._features(find_words(pa.array([text or ""]), WORDS_AND_MARKS, SAME), op.bits)
    total = weights[-1] + op.scale * sum(float(weights[s]) for s in slots) / max(1, len(slots))
    return 1 / (1 + np.exp(-total))


def naive_run(rows, weights, benchmark):
    """Rows are (key, doc_id, text); keys are the order in which copies and passages give way."""
    op = quality_ftrl.QualityModel()
    rows = sorted(r for r in rows if naive_score(r[2], weights, op) >= 0.5)
    sets = [set(zip(*(w[i:] for i in range(5)))) or ({tuple(w)} if w else set()) for w in (lowered(t) for _, _, t in rows)]
    roots = components(sets, lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b))
    rows = [r for i, r in enumerate(rows) if roots[i] == i]
    seen, cut = set(), []
    for key, doc_id, text in rows:
        spans = [m.span() for m in SPACED.finditer(text or "")]
        words = lowered(text)
        windows = [tuple(words[i : i + 51]) for i in range(len(words) - 50)]
        gone = {i + j for i, w in enumerate(windows) if w in seen for j in range(51)}
        seen.update(windows)
        # A cut word goes with what stands between it and the next word.
        ends = [*(start for start, _ in spans[1:]), len(text or "")]
        left = [c for k, c in enumerate(text or "") if not any(spans[i][0] <= k < ends[i] for i in gone)] if gone else None
        cut.append((key, doc_id, text if left is None else "".join(left)))
    windows = set()
    for _, text in benchmark:
        w = lowered(text, PLAIN)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    clean = []
    for key, doc_id, text in cut:
        words, hit = lowered(text, PLAIN), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit.update(range(i, i + n))
        if not (hit and 20 * len(hit) >= len(words)):
            clean.append((doc_id, text))
    return clean


def test_run_equals_naive_stages(spark, tmp_path):
    folder = str(tmp_path / "tables")
    docs, labels, benchmark = fixture()
    tables(spark, folder, docs, labels, benchmark)
    found = corpus_pipeline.run(spark, folder).collect()
    weights = quality_weights(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"), quality_ftrl.QualityModel())
    often = collections.Counter(i for i, _ in docs)
    keyed = [(i if i is not None and often[i] == 1 else k - 10**9, i, t) for k, (i, t) in enumerate(docs)]
    want = naive_run(keyed, weights, benchmark)
    op = byte_bpe_op()
    encoding = byte_bpe.encoding(op.path, op.pattern)
    expected = []
    for doc_id, text in want:
        ids = encoding.encode_ordinary(text or "")
        packed = struct.pack(f"<{len(ids)}I", *ids)
        expected.append((doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found), key=repr) == sorted(expected, key=repr)
    # What the fixture plants has happened.
    left = collections.Counter(i for i, _ in want)
    assert not any(100 <= (i or 0) < 160 for i in left) and not {200, 201, 202, 7, 220} & set(left) and {210, 211, 221} <= set(left)
    assert left[300] == 2 and left[None] >= 3


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    folder = str(tmp_path / "tables")
    tables(spark, folder, [(1, "x")], [(1, 1, 0)], [("a", "x y")])
    for name in ("documents", "labels", "benchmark"):
        frame = spark.read.parquet(f"{folder}/{name}.parquet")
        frame.limit(0).write.parquet(f"{folder}/empty/{name}.parquet")
    docs = spark.read.parquet(f"{folder}/empty/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, f"{folder}/empty")
        assert kept.columns == docs.columns and kept.count() == 0, name
    assert corpus_pipeline.run(spark, f"{folder}/empty").count() == 0


@pytest.mark.parametrize("ids", [[1, 2, 3], [1, 1, 2], [None, None, 5], [None, 4, 4]])
def test_every_row_has_a_key_of_its_own(spark, ids):
    keyed = corpus_pipeline._keyed(spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string")).collect()
    keys = [r[corpus_pipeline.KEY] for r in keyed]
    assert len(set(keys)) == len(ids) and None not in keys
    assert all(r[corpus_pipeline.KEY] == r["doc_id"] for r in keyed if ids.count(r["doc_id"]) == 1 and r["doc_id"] is not None)
