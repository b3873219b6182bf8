"""Whitening, exact search and conversation repair against numpy and exhaustive search, with the edge cases of each."""

from __future__ import annotations

import functools
import hashlib
import random
import zlib

import numpy as np
import pytest

from tasksieve.llm import chat_repair, pivot_search, whitening_feast
from tasksieve.llm.chat_repair import ChatRepair
from tasksieve.llm.pivot_search import PivotSearch
from tasksieve.llm.whitening_feast import Whitening, count_above, leading_components
from tasksieve.llm.whole_vectors import packed, unpacked

NAN, INF = float("nan"), float("inf")


def embeddings(spark, rows):
    """vec_id, embedding, and columns whose names the operators use themselves."""
    floats = [(i, v and [c if c is None else float(c) for c in v]) for i, v in rows]
    return spark.createDataFrame([(i, v, 1, b"x", 2) for i, v in floats], "vec_id long, embedding array<double>, n int, x binary, row int")


def clustered(seed, n, dim, spread=0.15, centres=12):
    draw = np.random.default_rng(seed)
    middle = draw.standard_normal((centres, dim))
    return middle[draw.integers(0, centres, n)] + spread * draw.standard_normal((n, dim))


def whole(rows):
    return np.floor(256 * np.array(rows, dtype=np.float64)).astype(np.int64)


def test_whole_numbers_are_packed_by_their_size():
    rows = np.array([[0, -1, 2], [40_000, 0, 0], [-(2**40), 5, 2**52], [32_767, -32_768, 0]])
    payloads = [packed(r) for r in rows]
    assert [p[0] for p in payloads] == [2, 4, 8, 2]
    assert (unpacked(payloads, 3) == rows).all()
    assert unpacked([packed(np.zeros(0, np.int64))], 0).shape == (1, 0)


# --- components ---------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("dim", [1, 2, 5, 24])
@pytest.mark.parametrize("kind", ["plain", "graded", "one line", "equal variances"])
def test_components_are_those_of_a_full_decomposition(dim, kind):
    rows = np.random.default_rng(dim).standard_normal((4 * dim + 2, dim))
    if kind == "graded":
        rows *= 10.0 ** -np.arange(dim).clip(0, 5)
    if kind == "one line":
        rows = np.outer(rows[:, 0], np.arange(1, dim + 1))
    if kind == "equal variances":
        rows = np.concatenate([np.eye(dim), -np.eye(dim)])
    rows -= rows.mean(axis=0)
    matrix = rows.T @ rows / len(rows)
    values, vectors = leading_components(matrix)
    full = np.linalg.eigvalsh(matrix)[::-1]
    assert len(values) == (1 if kind == "one line" else min(4, dim))
    np.testing.assert_allclose(values, full[: len(values)], rtol=1e-10)
    assert np.abs(matrix @ vectors - vectors * values).max() <= 1e-13 * full[0] * dim
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-13)


def test_inertia_counts_eigenvalues_also_with_a_zero_diagonal():
    matrix = np.array([[0.0, 1, 0], [1, 0, 0], [0, 0, -3]])
    assert [count_above(matrix, t) for t in (-4, -2, 0, 0.5, 2)] == [3, 2, 1, 1, 0]
    draw = np.random.default_rng(1)
    for dim in (2, 7, 20):
        a = draw.standard_normal((dim, dim))
        a += a.T
        for t in draw.standard_normal(5):
            assert count_above(a, t) == (np.linalg.eigvalsh(a) > t).sum()


def expected_whitening(vectors):
    fit = np.unique(vectors, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    matrix = centred.T @ centred / n
    values, turn = np.linalg.eigh(matrix)
    values, turn = values[::-1][:4], turn[:, ::-1][:, :4]
    return n, ((n * vectors - total) ** 2).sum(axis=1), (vectors - total / n) @ turn / np.sqrt(values), values / np.trace(matrix)


def test_whitened_vectors(spark):
    rows = clustered(3, 400, 6).tolist()
    rows += rows[:30] + [rows[0]] * 150  # copies count once in the fit
    odd = [(9001, None), (9002, [1.0, NAN, 0, 0, 0, 0]), (9003, [1.0, None, 0, 0, 0, 0]), (9004, []), (9005, [INF] * 6), (9006, [2.0**60] * 6)]
    short = [(9100 + i, [float(i % 3), -float(i % 3)]) for i in range(6)]  # one direction only
    single = [(9200, [0.5, 0.5, 0.5]), (None, [0.5, 0.5, 0.5])]  # nothing varies
    found = whitening_feast.whitened(embeddings(spark, [*enumerate(rows), *odd, *short, *single])).collect()
    by_id = {}
    for r in found:
        by_id.setdefault(r["vec_id"], []).append(r)
    assert not set(by_id) & {i for i, _ in odd}
    n, deviation, white, share = expected_whitening(whole(rows))
    for i in range(len(rows)):
        own = sorted(by_id[i], key=lambda r: r["component"])
        assert [r["component"] for r in own] == [1, 2, 3, 4]
        assert {(r["n"], r["deviation"]) for r in own} == {(n, deviation[i])}
        np.testing.assert_allclose([r["explained"] for r in own], share, rtol=1e-9)
        assert own[0]["identity_error"] < 1e-10
    got = np.array([[r["whitened"] for r in sorted(by_id[i], key=lambda r: r["component"])] for i in range(len(rows))])
    signs = np.sign((got * white).sum(axis=0))
    np.testing.assert_allclose(got * signs, white, atol=1e-9)
    line = sorted(by_id[9101], key=lambda r: r["component"])
    assert line[1]["whitened"] is None and line[1]["explained"] == 0 and line[0]["explained"] == pytest.approx(1)
    assert [r["whitened"] for r in by_id[9200] + by_id[None]] == [None] * 6 and {r["explained"] for r in by_id[9200]} == {None}
    assert {r["identity_error"] for r in by_id[9200]} == {None} and {r["deviation"] for r in by_id[9200]} == {0}


def test_whitening_of_nothing_and_of_more_components(spark):
    assert whitening_feast.whitened(embeddings(spark, [(1, [1.0])]).limit(0)).count() == 0
    assert whitening_feast.whitened(embeddings(spark, [(1, None)])).count() == 0
    found = whitening_feast.whitened(embeddings(spark, list(enumerate(clustered(5, 60, 5).tolist()))), Whitening(components=2)).collect()
    assert len(found) == 120 and max(r["identity_error"] for r in found) < 1e-10


# --- search -----------------------------------------------------------------------------------------------------------------

def expected_top(rows, asks, k):
    """Brute force over all pairs of usable rows, as a sorted list of answers."""
    usable = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    found = []
    for p, (q, x) in enumerate(usable):
        if q is None or not asks(q):
            continue
        scores = [(-sum(int(a) * int(b) for a, b in zip(whole(x), whole(y))), i is None, i or 0) for j, (i, y) in enumerate(usable) if j != p and len(y) == len(x)]
        found.append((q, [(r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]))
    return sorted((q, *a) for q, answers in found for a in answers)


def answers(frame):
    return [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in frame.collect()]


SMALL = PivotSearch(k=3, pivots=6, sample=64, per_tile=20, block=8, batch=4, chunk=3)


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_top_products_equal_all_pairs(spark, spread):
    rows = list(enumerate(clustered(7, 240, 5, spread).tolist()))
    rows += [(1000 + i, rows[3][1]) for i in range(80)]  # a third are copies of one, queries among them
    rows += [(50, rows[4][1]), (50, rows[4][1]), (None, rows[5][1]), (2000, [0.0] * 5), (2010, None), (2020, [NAN] * 5), (2030, [1.0, None, 2, 3, 4])]
    rows += [(3000, [1.0, 2.0]), (3010, [1.0, 2.5]), (3020, [7.0]), (3030, []), (3040, [])]
    found = answers(pivot_search.top_products(embeddings(spark, rows), "vec_id % 10 = 0", SMALL))
    assert sorted(found, key=repr) == sorted(expected_top(rows, lambda q: q % 10 == 0, 3), key=repr)


def test_bounds_leave_out_most_of_what_is_far(spark):
    """Candidates are skipped by their bounds: of well separated groups a query evaluates hardly more than its own."""
    x = whole(clustered(11, 2000, 8, 0.02, 20))
    op = PivotSearch(k=5, chunk=16)
    space = pivot_search._space(x[:500], op, 1)
    table = space.distances(x).astype(np.float32)
    held = pivot_search._Held(x, table, np.arange(2000)[:, None].repeat(6, 1), np.where(np.arange(6) == 0, np.arange(2000)[:, None], pivot_search._LAST))
    asked = pivot_search._Asked.fresh(x[:1], table[:1], op.k)
    evaluated, products = [], pivot_search._products
    pivot_search._products = lambda a, b: evaluated.append(len(b)) or products(a, b)
    try:
        pivot_search._evaluate(asked, held, op)
    finally:
        pivot_search._products = products
    scores = x @ x[0]
    assert asked.ids[0].tolist() == np.lexsort((np.arange(2000), -scores))[:6].tolist()
    assert sum(evaluated) < 500


def test_batches_of_queries_are_not_broadcast(spark, monkeypatch):
    """Their number grows with queries times tiles, which no estimate from the home answers tells."""
    plans, stored = {}, pivot_search.stored
    monkeypatch.setattr(pivot_search, "stored", lambda rows, name: plans.update({name: rows._jdf.queryExecution().executedPlan().toString()}) or stored(rows, name))
    rows = list(enumerate(clustered(5, 60, 4).tolist()))
    found = answers(pivot_search.top_products(embeddings(spark, rows), "vec_id % 10 = 0", SMALL))
    assert sorted(found) == expected_top(rows, lambda q: q % 10 == 0, 3)
    assert "SortMergeJoin" in plans["answers"] and "Broadcast" not in plans["answers"]


def test_search_edges(spark):
    one = embeddings(spark, [(0, [1.0, 2.0])])
    assert answers(pivot_search.top_products(one, "true")) == []
    assert answers(pivot_search.top_products(one.limit(0), "true")) == []
    large = embeddings(spark, [(0, [2.0**40, 1.0]), (1, [2.0**40, 1.0]), (2, [-(2.0**40), 0.0])])
    found = answers(pivot_search.top_products(large, "vec_id = 0"))
    assert found == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63) + 1)]
    exact = embeddings(spark, [(0, [2.0**22, 1.0]), (1, [2.0**22, 1.0]), (2, [2.0**22, 1.0 - 1 / 256])])
    assert answers(pivot_search.top_products(exact, "vec_id = 0")) == [(0, 1, 1, 2**60 + 2**16), (0, 2, 2, 2**60 + 2**16 - 2**8)]


# --- repair -----------------------------------------------------------------------------------------------------------------

SPACE = " \t\n\x0b\x0c\r"


def exhaustive(turns):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, lines) by search over all edits, compared by (cost, letters)."""
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
    seen, faults = set(), []
    for _, role, text in turns:
        shown = text.strip(SPACE)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))

    def fits(before, role):
        return role in {"": "su", "s": "u", "u": "a", "a": "u"}[before] and role != ""

    @functools.cache
    def best(i, before, inserted):
        options = [(0, "", ())] if i == len(turns) and before in ("", "a") else []

        def option(cost, letter, rest, *line):
            if rest is not None:
                options.append((cost + rest[0], letter + rest[1], line + rest[2]))

        for role in ("user", "assistant"):
            if inserted < 3 and fits(before, role[0]):
                option(2, "I", best(i, role[0], inserted + 1), f"{role}:")
        if i < len(turns):
            _, role, text = turns[i]
            option(3, "D", best(i + 1, before, 0))
            if faults[i] not in ("blank", "duplicate"):
                more = int(faults[i] == "truncated")
                if fits(before, role[:1]):
                    option(more, "K", best(i + 1, role[0], 0), f"{role}:{text}")
                for new in ("user", "assistant"):
                    if fits(before, new[0]):
                        option(2 + more, "R", best(i + 1, new[0], 0), f"{new}:{text}")
        return min(options, default=None, key=lambda o: o[:2])

    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, *best(0, "", 0))


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, seg int, key string")


def repaired(spark, rows, op):
    result = chat_repair.repair(conversations(spark, rows), op)
    audits = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")) for r in result.audits.collect()}
    lines, edits = {}, {}
    for r in result.parts.orderBy("conv_id", "part").collect():
        lines.setdefault(r["conv_id"], []).extend(f"{t['role']}:{t['text']}" for t in r["turns"])
        edits.setdefault(r["conv_id"], []).extend(t["edit"] for t in r["turns"])
    digests = {r["conv_id"]: r["repaired_sha256"] for r in chat_repair.repaired_digests(result.parts).collect()}
    for conv_id, own in lines.items():
        assert digests[conv_id] == hashlib.sha256("\n".join(own).encode()).hexdigest()
        assert "".join(edits[conv_id]) == audits[conv_id][-1].replace("D", "")
    return {c: (*a, tuple(lines[c])) for c, a in audits.items()}


def random_chat(draw, n):
    roles = ("user", "user", "assistant", "assistant", "system", "tool", "", "Sue")
    texts = ("Yes.", "No!", "Why", "", " \n\t", "é?", "Well. ", "a\x85", "漢字", "Done.\x0b") if draw.random() < 0.5 else tuple(f"t{i}{c}" for i in range(40) for c in (".", ""))
    return [(draw.choice((None, *range(n))) if draw.random() < 0.1 else i, draw.choice(roles), draw.choice(texts)) for i in range(n)]


@pytest.mark.parametrize("op", [ChatRepair(), ChatRepair(segment_rows=2, fan_in=2), ChatRepair(segment_bytes=1)])
def test_repair_equals_exhaustive_search(spark, op):
    draw = random.Random(5)
    chats = {i: random_chat(draw, draw.choice((1, 2, 3, 5, 8, 13))) for i in range(120)}
    chats[500] = random_chat(draw, 150)
    chats[None] = random_chat(draw, 20)
    chats[501] = [(0, "system", "Rules.")]
    chats[502] = [(0, "system", "Rules"), (None, "system", "Rules")]
    chats[503] = [(3, "user", "Hi.")] * 9
    rows = [(c, *t) for c, turns in chats.items() for t in turns]
    draw.shuffle(rows)
    found = repaired(spark, rows, op)
    assert found == {c: exhaustive(turns) for c, turns in chats.items()}


def test_long_conversations_and_texts(spark):
    text = "word " * 200_000
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(3000) if i % 100] + [(2, 0, "user", text), (2, 1, "assistant", text + ".")]
    found = repaired(spark, rows, ChatRepair(segment_rows=64, fan_in=4))
    assert found[2][:7] == (0, 0, 0, 1, 0, 1, "KK") and found[2][7] == (f"user:{text}", f"assistant:{text}.")
    gaps, blank, duplicate, truncated, illegal, cost, audit, lines = found[1]
    # Without every hundredth turn, a user's: each neighbour pair is a-a, one insert each; the first turn left is an assistant's.
    assert (gaps, blank, duplicate, truncated, illegal, cost) == (29, 0, 0, 0, 29, 60)
    assert audit.count("I") == 30 and audit.startswith("I") and audit.count("K") == 2970 and len(lines) == 3000


def test_repair_of_nothing(spark):
    empty = chat_repair.repair(conversations(spark, [(1, 0, "user", "x")]).limit(0))
    assert empty.audits.count() == 0 and empty.parts.count() == 0
    found = repaired(spark, [(7, None, None, None), (8, 0, None, "Said.")], ChatRepair())
    assert found == {7: (0, 1, 0, 0, 0, 3, "D", ()), 8: (0, 0, 0, 0, 0, 3, "D", ())}


def test_damage(spark):
    rows = conversations(spark, [(c, t, "assistant", "One. Two! Three?") for c in (1, None) for t in (None, *range(60))] + [(3, 3, None, None)])
    found = sorted(((r["conv_id"], r["turn"], r["role"], r["text"]) for r in chat_repair.damaged(rows).collect()), key=repr)
    expected = []
    for c, t in [(c, t) for c in (1, None) for t in (None, *range(60))] + [(3, 3)]:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = ("assistant", "One. Two! Three?") if c != 3 else (" ", " ")
        text = {1: "", 2: text.replace(".", "").replace("!", "").replace("?", "")}.get(fault, text)
        expected += [(c, t, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    assert found == sorted(expected, key=repr)
    assert chat_repair.damaged(rows.limit(0)).count() == 0
