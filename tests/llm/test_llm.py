"""The operators for training text against brute force, exact round trips and held-out accuracy, with the edge cases of each."""

from __future__ import annotations

import collections
import hashlib
import json
import random
import re
import struct

import numpy as np
import pytest
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from tasksieve.llm import (
    byte_bpe, chat_snapshots, decontaminate, embedding_ego, html_template, minhash, quality_ftrl, substring_chain, token_counts, url_links,
)
from tasksieve.llm.components import connected_components
from tasksieve.llm.queries import RULES, byte_bpe_op
from tasksieve.llm.words import BY_SPACE, find_words, shingle_sets

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, texts, extra=True):
    """doc_id, text, and columns whose names the operators use themselves."""
    rows = [(i, t, "x", 1) for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
    return spark.createDataFrame(rows, "doc_id long, text string, digest string, n_shingles int")


def lowered(text):
    return SPACED.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def prose(seed, n, vocabulary=5000):
    draw = random.Random(seed)
    return [f"w{draw.randrange(vocabulary)}é" for _ in range(n)]


def mutated(words, edits, seed):
    draw, words = random.Random(seed), list(words)
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"m{draw.randrange(10**9)}"
    return words


def test_words_and_shingles_agree_with_a_regular_expression():
    texts = ["One two x\x0bthree", None, "", " \n ", "a", "A b", "ÄÖ 漢字 x " * 50, "q" * 10_000]
    for limit in (16, 1 << 18):
        found = find_words(pa.array(texts, pa.string()), BY_SPACE, limit=limit)
        for i, text in enumerate(texts):
            words = lowered(text)
            own = slice(found.first[i], found.first[i + 1])
            assert len(words) == found.first[i + 1] - found.first[i]
            assert len(set(words)) == len(set(found.hash[own].tolist()))
        sets = shingle_sets(found, 3)
        expected = [len(set(zip(w, w[1:], w[2:]))) if len(w) > 2 else min(1, len(w)) for w in map(lowered, texts)]
        assert [len(s) for s in sets] == expected


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (200, 7)]
    rows = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    found = {r["id"]: r["component"] for r in connected_components(rows).collect()}
    assert found == {**{i: 1 for i in range(1, 41)}, 200: 1, 100: 100, 101: 100}
    assert connected_components(rows.limit(0)).count() == 0


def brute_components(texts, k, percent):
    sets = {i: (set(zip(*(w[j:] for j in range(k)))) if len(w) >= k else ({tuple(w)} if w else set())) for i, w in ((i, lowered(t)) for i, t in texts.items())}
    part = {i: i for i in sets}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                shared = len(sets[i] & sets[j])
                if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                    a, b = sorted((root(i), root(j)))
                    part[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates_equal_all_pairs(spark):
    base, other = prose(1, 150), prose(2, 60)
    second = mutated(base, 9, 77)
    texts = [mutated(base, k % 13, k) for k in range(150)] + [mutated(second, k % 9, 1000 + k) for k in range(80)]
    texts += [mutated(other, k % 3, 2000 + k) for k in range(30)] + [["a"], ["A"], ["a", "b"], ["b", "a"], []] + [base] * 20
    table = {3 * i: " ".join(w) for i, w in enumerate(texts)} | {5000: None, 5001: " \n "}
    found = minhash.near_duplicates(documents(spark, table)).collect()
    expected = brute_components(table, 3, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found) and len(found) == len(table)
    assert minhash.near_duplicates(documents(spark, table).limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d")], "doc_id long, text string")
    assert sorted(map(tuple, minhash.near_duplicates(nameless).collect()), key=repr) == [(4, 2, 4, True), (4, 2, 4, True), (None, 2, None, True)]


def test_a_cluster_of_one_component_below_the_threshold_meets_nothing(spark, monkeypatch):
    """Copies of a text that resembles a bucket's smallest one, but not enough, are one component: no element of theirs is expanded."""
    base = prose(31, 200)
    outlying = mutated(base, 14, 5)
    texts = [base] + [outlying[:-1] + [f"end{k}"] for k in range(60)]
    seen, plain = [], minhash._of_several_parts
    monkeypatch.setattr(minhash, "_of_several_parts", lambda left, right: seen.append((left.count(), plain(left, right))) or seen[-1][1])
    found = minhash.near_duplicates(documents(spark, {i: " ".join(w) for i, w in enumerate(texts)}), minhash.NearDedup(bands=60, rows=2)).collect()
    assert {r["component_id"] for r in found} == {0, 1}
    assert seen[0][0] > 1000 and seen[0][1].count() == 0


def test_rows_that_share_an_id_but_not_the_text_keep_their_links(spark):
    a, b = " ".join(prose(41, 50)), " ".join(prose(42, 50))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, "q r s t")]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_sketch_coordinates_agree_as_often_as_sets():
    draw = np.random.default_rng(5)
    common, a, b = (draw.integers(0, 2**63, n).astype(np.uint64) for n in (300, 100, 100))
    x, y = (np.concatenate([common, s]) for s in (a, b))
    agree = np.mean(minhash.fast_sketch(x, 2000) == minhash.fast_sketch(y, 2000))
    assert abs(agree - 0.6) < 0.05
    assert len(set(minhash.fast_sketch(x[:1], 64).tolist())) == 64


def test_repeated_passages(spark):
    passage, long = prose(3, 70), prose(4, 400)
    table = {
        1: prose(10, 80) + passage + prose(11, 80), 2: prose(12, 20) + passage + prose(13, 90), 3: prose(14, 100), 4: mutated(passage, 4, 9) + prose(15, 30),
        5: long, 6: long[100:300], 7: passage[:30] + prose(16, 60), 8: ["is", "on"] * 60, 9: prose(17, 40) + ["is", "on"] * 60, 10: [],
    }
    rows = documents(spark, {i: " ".join(w) for i, w in table.items()} | {11: None})
    found = collections.defaultdict(list)
    for r in substring_chain.repeated_passages(rows).collect():
        assert r["source"] < r["doc_id"]
        found[r["doc_id"]].append((r["source"], r["first_word"], r["n_words"]))
    assert found[2] == [(1, 20, 70)] and found[6] == [(5, 0, 200)]
    assert set(found) == {2, 4, 6, 9} and found[4][0][2] >= 66
    cut = {r["doc_id"]: r for r in substring_chain.without_passages(rows, substring_chain.repeated_passages(rows)).collect()}
    assert cut[2]["text"].split() == table[2][:20] + table[2][90:] and cut[1]["text"].split() == table[1]
    assert cut[11]["text"] is None and cut[3]["digest"] == "x" and len(cut) == 11
    assert substring_chain.repeated_passages(rows.limit(0)).count() == 0


def test_passages_of_lines_that_others_hold_are_found_whole(spark):
    """Every word of an exact repeat of 51 words is covered, though all its runs of eight words first stand in one of several documents."""
    passage = prose(50, 70)
    lines = [passage[k : k + 22] for k in range(0, 60, 12)]
    table = {i: prose(100 + i, 30) + line + prose(200 + i, 30) for i, line in enumerate(lines)}
    table |= {20: prose(300, 60) + passage + prose(301, 20), 21: passage + prose(302, 70), 22: prose(303, 5) + passage}
    covered = collections.defaultdict(set)
    for r in substring_chain.repeated_passages(documents(spark, {i: " ".join(w) for i, w in table.items()})).collect():
        covered[r["doc_id"]].update(range(r["first_word"], r["first_word"] + r["n_words"]))
    first, repeated = {}, collections.defaultdict(set)
    for i, words in sorted(table.items()):
        for k in range(len(words) - 50):
            if first.setdefault(tuple(words[k : k + 51]), i) != i:
                repeated[i].update(range(k, k + 51))
    assert set(repeated) == {21, 22} == set(covered)
    assert all(covered[i] == repeated[i] for i in repeated)


def test_passages_that_a_document_repeats_within_are_found_each_time(spark):
    """Every word of an exact repeat of 51 words is covered, though the source holds the passage less often than the later documents."""
    passage, other, page = prose(60, 120), prose(61, 55), prose(62, 30)
    table = {
        1: prose(400, 40) + passage + prose(401, 40), 2: prose(402, 30) + passage + prose(403, 70) + passage + prose(404, 10),
        3: passage + passage + prose(405, 20) + passage, 4: prose(406, 20) + other + prose(407, 60) + other, 5: prose(408, 60),
        6: other + prose(409, 9) + other + prose(410, 90) + other, 7: prose(411, 9) + page * 4, 8: page * 3 + prose(412, 80) + page * 9,
    }
    covered = collections.defaultdict(set)
    for r in substring_chain.repeated_passages(documents(spark, {i: " ".join(w) for i, w in table.items()})).collect():
        assert r["source"] < r["doc_id"]
        covered[r["doc_id"]].update(range(r["first_word"], r["first_word"] + r["n_words"]))
    first, repeated = {}, collections.defaultdict(set)
    for i, words in sorted(table.items()):
        for k in range(len(words) - 50):
            if first.setdefault(tuple(words[k : k + 51]), i) != i:
                repeated[i].update(range(k, k + 51))
    assert set(repeated) == {2, 3, 6, 8} == set(covered)
    assert all(covered[i] >= repeated[i] and len(covered[i] - repeated[i]) < 10 for i in repeated)


def test_passages_with_words_changed_all_over_are_found(spark):
    """Of 60 planted passages a length and share of changed words, changed at places drawn at random, at most the given number is missed."""
    allowed = {(60, 4): 0, (60, 6): 1, (60, 9): 9, (100, 10): 1, (100, 15): 2}
    table, of = {}, {}
    for k, (n, edits) in enumerate(allowed):
        for i in range(60):
            at, draw = 2 * (60 * k + i), random.Random(9000 + 60 * k + i)
            words = [f"{draw.getrandbits(40):x}" for _ in range(n)]
            changed = list(words)
            for place in draw.sample(range(n), edits):
                changed[place] = f"{draw.getrandbits(40):x}"
            around = [[f"{draw.getrandbits(40):x}" for _ in range(40)] for _ in range(4)]
            table[at], table[at + 1] = around[0] + words + around[1], around[2] + changed + around[3]
            of[at + 1] = n, edits
    found = {r["doc_id"] for r in substring_chain.repeated_passages(documents(spark, {i: " ".join(w) for i, w in table.items()})).collect()}
    missed = collections.Counter(of[i] for i in of if i not in found)
    print("missed of 60:", {k: missed[k] for k in allowed})
    assert found <= set(of) and all(missed[k] <= n for k, n in allowed.items())


def test_later_occurrences_match_again_only_outside_certain_passages():
    op = substring_chain.PassageDedup(seed=8, long_seed=30)
    p = np.array([0, 81, 160, *(~np.array([120, 200, 801, 40]))])
    q, source = np.array([0, 81, 160, 0, 0, 0, 0]), np.array([7, 7, 7, 7, 9, 9, 9])
    assert substring_chain.wanted_matches(source, p, q, op).tolist() == [0, 1, 2, 3, 4, 5, 6]  # 20 to 49 and two short runs apart
    p, q = np.append(p, [1, 181]), np.append(q, [1, 181])
    source = np.append(source, [7, 7])
    assert substring_chain.wanted_matches(source, p, q, op).tolist() == [0, 1, 2, 5, 7, 8]
    source[-1] = 8
    assert substring_chain.wanted_matches(source, p, q, op).tolist() == [0, 1, 2, 4, 5, 7, 8]


def test_chaining_is_best_by_brute_force():
    draw = random.Random(8)
    for _ in range(40):
        points = sorted({(draw.randrange(60), draw.randrange(60)) for _ in range(12)})
        best = max(len(c) for c in substring_chain.chain(points, 1000))
        length = {}
        for p in points:
            length[p] = 1 + max((length[q] for q in points if q in length and q[0] < p[0] and q[1] < p[1]), default=0)
        assert best == max(length.values())


def test_quality_on_held_out_rows(spark):
    good = {i: " ".join(prose(i, 60, 300)) for i in range(0, 400, 2)}
    bad = {i: " ".join(f"{w}{'***' if i % 4 == 1 else '$$$'}" for w in prose(i, 60, 300)) for i in range(1, 400, 2)}
    rows = documents(spark, good | bad | {1000: None, 1001: ""})
    labels = spark.createDataFrame([*((i, int(i in good)) for i in good | bad), (5000, 1), (None, 0), (3, None)], "doc_id long, label int")
    op = quality_ftrl.QualityModel()
    weights = quality_ftrl.fit(rows, labels.where(~quality_ftrl.held_out()), op)
    found = {r["doc_id"]: r["score"] for r in quality_ftrl.score(rows, weights, op).where(quality_ftrl.held_out()).collect()}
    assert len(found) > 100 and np.mean([(s >= 0.5) == (i in good) for i, s in found.items() if i < 1000]) > 0.97
    assert all(0 <= s <= 1 for s in found.values())
    assert not quality_ftrl.fit(rows, labels.limit(0), op).any()


def test_benchmark_passages_equal_window_search(spark):
    items = {"1": prose(20, 40), "2": ["short", "item"], "3": [], "4": prose(20, 40)[:20]}
    benchmark = spark.createDataFrame([*((i, " ".join(w)) for i, w in items.items()), ("5", None), (None, "x y")], "item_id string, text string")
    table = {
        1: " ".join(prose(30, 50) + items["1"][5:30] + prose(31, 50)), 2: "A Short, ITEM! " + " ".join(prose(32, 300)), 3: None, 4: "...", 5: " ".join(prose(33, 30)),
        6: "-".join(items["1"]),
    }
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: split.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for item, w in ((i, words(" ".join(x))) for i, x in items.items()):
        for k in range(max(1, len(w) - 12)) if w else ():
            windows[tuple(w[k : k + 13])].add(item)
    for size in (32 << 20, 500):
        found = decontaminate.find_benchmark(documents(spark, table), benchmark, decontaminate.Decontamination(automaton_bytes=size)).collect()
        assert len(found) == len(table)
        for r in found:
            w, hit, ids = words(table[r["doc_id"]]), set(), set()
            for window, owners in windows.items():
                for k in range(len(w) - len(window) + 1):
                    if tuple(w[k : k + len(window)]) == window:
                        hit.update(range(k, k + len(window)))
                        ids |= owners
            assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(ids))
            assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))
            covered = [x for s in r["spans"] for x in words(table[r["doc_id"]][s["start"] : s["end"]])]
            assert covered == [w[k] for k in sorted(hit)]
    assert decontaminate.find_benchmark(documents(spark, table), benchmark.limit(0)).where("contaminated").count() == 0


def test_windows_of_items_without_an_id_count(spark):
    passage = " ".join(prose(1, 15))
    benchmark = spark.createDataFrame([(None, passage), ("i", "quite short")], "item_id string, text string")
    found = {r["doc_id"]: r for r in decontaminate.find_benchmark(documents(spark, [passage, "so quite short it is", "none"]), benchmark).collect()}
    assert [(found[i]["n_hit"], found[i]["items"], found[i]["contaminated"]) for i in range(3)] == [(15, [], True), (2, ["i"], True), (0, [], False)]


def test_the_automaton_is_as_large_as_it_is_counted():
    patterns = [(" " + " ".join(prose(i, 13, 10**9)) + " ", ("x",)) for i in range(3000)]
    numbers, built = decontaminate._automaton("size", patterns)
    assert len(built) == 3000 and len(numbers) > 38_900
    node = built.get_stats()["total_size"] / (13 * 3000)
    import sys

    names = (sys.getsizeof(numbers) + sum(map(sys.getsizeof, numbers))) / 39_000
    assert node + names / 1.5 < decontaminate.NODE_BYTES + len(patterns[0][0]) / 13


LONG = {
    1: " \n\t " * 3000, 2: "é<|endoftext|>" * 900, 3: "漢字" * 3000, 4: None, 5: "", 6: "é don't 12x  áb " * 700, 7: "a" * 9000, 8: "x<|startoftext|>'s  " * 300, 9: "ok",
}


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    rows = documents(spark, LONG).unionByName(documents(spark, {6: LONG[6]}))
    found = token_counts.count_tokens(rows, token_counts.TokenCounts(path, chunk=1500, overlap=200)).collect()
    count = lambda t: len(whole.encode(t or "", add_special_tokens=False).ids)
    expected = [(i, len((t or "").encode()), count(t)) for i, t in [*LONG.items(), (6, LONG[6])]]
    assert sorted(map(tuple, found)) == sorted(expected)


def test_scores_and_updates_equal_plain_loops():
    """The update rule written out weight by weight, and scores as sums that do not depend on other texts."""
    op = quality_ftrl.QualityModel(bits=8, batch=4, epochs=2)
    draw = np.random.default_rng(2)
    rows = [(draw.integers(0, 256, n), int(n % 2)) for n in range(1, 30)] + [(np.zeros(0, np.int64), 1)]
    z, n, w = ([0.0] * 257 for _ in range(3))
    order = np.random.default_rng(0)
    for _ in range(op.epochs):
        shuffled = order.permutation(len(rows))
        for at in range(0, len(rows), op.batch):
            g = collections.Counter()
            chosen = [rows[i] for i in shuffled[at : at + op.batch]]
            for slots, label in chosen:
                x = {256: 1.0} | {int(s): op.scale * c / len(slots) for s, c in collections.Counter(slots.tolist()).items()}
                p = 1 / (1 + np.exp(-sum(w[s] * v for s, v in x.items())))
                for s, v in x.items():
                    g[s] += (p - label) * v / len(chosen)
            for s, own in g.items():
                z[s] += own - (np.sqrt(n[s] + own * own) - np.sqrt(n[s])) / op.alpha * w[s]
                n[s] += own * own
                w[s] = 0.0 if abs(z[s]) <= op.l1 else -(z[s] - np.sign(z[s]) * op.l1) / ((op.beta + np.sqrt(n[s])) / op.alpha + op.l2)
    np.testing.assert_allclose(quality_ftrl.fit_ftrl(rows, op), w, atol=1e-9)
    weights = draw.standard_normal(257) * 1e3
    slots, first = np.concatenate([s for s, _ in rows]), np.append(0, np.cumsum([len(s) for s, _ in rows]))
    together = quality_ftrl._raw_scores(slots, first, weights, weights[-1], op.scale)
    for (own, _), score in zip(rows, together):
        alone = quality_ftrl._raw_scores(own, np.array([0, len(own)]), weights, weights[-1], op.scale)[0]
        assert alone == score
        assert score == pytest.approx(weights[-1] + op.scale * sum(weights[own]) / max(1, len(own)))


def test_words_are_counted_apart_only_where_the_file_allows_it():
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, counts = token_counts._tokenizer(path, 1000), token_counts._Counts(path, 1000, words=50, length=8)
    assert counts.by_word and not token_counts.splits_at_space(open(public_tokenizers.path("byte_bpe_50k.json")).read())
    file = json.loads(whole.to_str())
    for part, change in (
        ("normalizer", {"type": "NFKC"}), ("pre_tokenizer", {"type": "Whitespace"}), ("added_tokens", [file["added_tokens"][0] | {"rstrip": True}]),
        ("added_tokens", [file["added_tokens"][0] | {"content": "a b"}]), ("normalizer", {"type": "Prepend", "prepend": " "}),
    ):
        assert not token_counts.splits_at_space(json.dumps(file | {part: change}))
    draw, parts = random.Random(3), ["a", "İ", "ǅ", "Σ", "'s", "'", ".", "1", " ", "\t", "\u0301", "\u00a0", "\u2003", "\x85", "\x1c", "é", "e\u0301", "<|endoftext|>", "한", "\u1100\u1161", "<", "\u0338", "x" * 30]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(60))) for _ in range(3000)]
    assert counts(pa.array(texts)).tolist() == [len(whole.encode(t, add_special_tokens=False).ids) for t in texts]
    assert counts(pa.array(texts).slice(10, 5)).tolist() == counts(pa.array(texts)).tolist()[10:15]


def test_chunks_find_the_boundaries_of_the_whole_text():
    """Zones and the span between them give a chunk's count and boundaries as encoding all of it does."""
    op = token_counts.TokenCounts(public_tokenizers.path("word_bpe_49k.json"), margin=16)
    draw = random.Random(4)
    text = " ".join("".join(draw.choice("abcdeé'1.") for _ in range(draw.randrange(1, 9))) for _ in range(1500))
    for start, n in ((0, 9000), (700, 9000), (700, 700 + len(text)), (0, len(text))):
        whole, found = token_counts._stable(text, 16, len(text) - 16, start, op)
        total, head, tail = token_counts.boundaries(text, start, n, op, 300)
        assert total == whole
        assert head == ([x for _, b, x in found if b <= 284] if start else [])
        assert tail == ([x for a, _, x in found if a >= len(text) - 284] if start + len(text) < n else [])


def test_byte_bpe_round_trip(spark):
    op = byte_bpe.ByteBpe(byte_bpe_op().path, byte_bpe_op().pattern, chunk=1500, overlap=200)
    ids = byte_bpe.encode(documents(spark, LONG), op)
    whole = byte_bpe.encoding(op.path, op.pattern)
    expected = {i: whole.encode_ordinary(t or "") for i, t in LONG.items()}
    assert {r["doc_id"]: r["ids"] for r in ids.collect()} == expected
    assert {r["doc_id"]: bytes(r["bytes"]) for r in byte_bpe.decode(ids, op).collect()} == {i: (t or "").encode() for i, t in LONG.items()}
    for r in byte_bpe.digests(ids, op).collect():
        own = expected[r["doc_id"]]
        assert r["n_tokens"] == len(own) and r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(own)}I", *own)).hexdigest()
    assert byte_bpe.encode(documents(spark, LONG).limit(0), op).count() == 0


def test_maximal_chats(spark):
    def turns(conv, *texts, start=0):
        return [(conv, start + i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]

    rows = turns(1, "a") + turns(2, "a", "b") + turns(3, "a", "b", "c", start=5) + turns(4, "a", "x") + turns(5, "a", "x") + turns(6, "b")
    rows += turns(6, "b") + turns(None, "z", None) + [(8, None, None, None), (9, 1, "user", "t"), (9, 1, "user", "s")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit(1))
    op = chat_snapshots.ChatFormat(part_turns=2, ranges=9)
    found = sorted(chat_snapshots.maximal_chats(table, op).collect(), key=lambda r: (str(r["conv_id"]), r["part"]))
    kept = {(r["conv_id"], r["n_turns"], r["copies"]) for r in found}
    assert kept == {(3, 3, 1), (4, 2, 2), (6, 1, 1), (None, 2, 1), (8, 1, 1), (9, 2, 1)}
    text = "".join(r["text"] for r in found if r["conv_id"] == 3)
    assert text == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert [r["text"] for r in found if r["conv_id"] == 9][0].index("s") < 40
    assert chat_snapshots.maximal_chats(table.limit(0), op).count() == 0


def test_url_verdicts(spark):
    pages = [
        (1, "HTTP://A.Example.NET/en/x?q#f", None), (2, "http://b.example.com/de/1", ""), (3, None, "x"), (4, "no scheme", None), (5, "http://c.org?x=/fr/", None),
        (6, "https://c.org/fr/1", "<a href='/fr/2'>"), (7, "http://friend.info/a", "<a class=x href=//bad.net/>"), (8, "http://evil.info/", '<a href="http://bad.net/q">'),
        (9, "http://bad.net/q", ""), (10, "http://example.net", None), (10, "http://example.net", None),
    ]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("rule", F.lit("x"))
    found = collections.defaultdict(list)
    for r in url_links.judge_urls(table, url_links.UrlFilter(RULES)).collect():
        found[r["page_id"]].append((r["host"], r["path"], r["rule"], r["verdict"]))
    assert found[1] == [("a.example.net", "/en/x", "example.net/en/", "allow")] and found[2] == [("b.example.com", "/de/1", "example.com/de/", "block")]
    assert found[3] == found[4] == [("", "", None, "allow")] and found[5] == [("c.org", "", None, "allow")]
    assert found[8] == [("evil.info", "/", None, "block")] and found[9][0][2:] == ("net/", "block")
    assert found[10] == [("example.net", "", None, "allow")] * 2
    assert url_links.judge_urls(table.limit(0), url_links.UrlFilter(RULES)).count() == 0


def test_ranks_equal_power_iteration(spark):
    links = [(1, 2, 3.0), (2, 3, 1.0), (2, 1, 1.0), (3, 1, 2.0)]
    shares = [("trust", str(a), str(b), w / sum(x for s, _, x in links if s == a)) for a, b, w in links]
    op = url_links.UrlFilter(RULES, rounds=6, cut_every=4)
    seeds = {"1": 0.5, "3": 0.5}
    ranks = dict(seeds)
    for _ in range(op.rounds):
        ranks = {h: 0.15 * seeds.get(h, 0) + 0.85 * sum(ranks.get(s, 0) * w for _, s, d, w in shares if d == h) for h in "123"}
    found = url_links.propagate(
        spark.createDataFrame(shares, "kind string, src string, dst string, share double"),
        spark.createDataFrame([("trust", h, s) for h, s in seeds.items()], "kind string, host string, score double"), op,
    )
    assert {r["host"]: round(r["score"], 9) for r in found.collect()} == {h: round(s, 9) for h, s in ranks.items()}


def test_near_vectors_equal_all_pairs(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(12, 16))
    rows = [c + 0.13 * draw.normal(size=16) for c in centres for _ in range(25)]
    rows += [draw.normal(size=16) for _ in range(60)] + [rows[0]] * 9 + [3.5 * rows[1], 1e-30 * rows[2], -rows[3]]
    vectors = [(2 * i, v.tolist()) for i, v in enumerate(rows)]
    odd = [(1001, None), (1003, [0.0] * 16), (1005, [float("nan")] * 16), (1007, [None] + [1.0] * 15), (1009, []), (1011, [1.0, 2.0]), (1013, [2.0, 4.0])]
    table = spark.createDataFrame([*vectors, *odd], "vec_id long, embedding array<double>").withColumn("digest", F.lit(1))
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_ego.near_duplicate_vectors(table, embedding_ego.EgoJoin(block=50, leaf=16)).collect()}
    x = np.array(rows)
    x = x / np.abs(x).max(axis=1)[:, None]
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= 0.9
    part = np.arange(len(x))
    for _ in range(len(x)):
        part = np.where(linked, part[None, :], len(x)).min(axis=1)
    for i in range(len(rows)):
        assert found[2 * i] == (linked[i].sum() - 1, 2 * part[i], part[i] == i)
    assert all(found[i] == (0, i, True) for i, _ in odd[:5])
    assert found[1011] == (1, 1011, True) and found[1013] == (1, 1011, False)
    assert embedding_ego.near_duplicate_vectors(table.limit(0)).count() == 0


def test_marks_drop_nothing_of_an_article():
    """Ids made of headings, parts of class names and a form around the page do not empty an article."""
    def text(source):
        return html_template.extract(html_template.read_page(source))

    assert text("<article><h1>A</h1><section id=related-work><p>B</p></section><section id=search><p>C</p></section></article>") == "A\nB\nC"
    assert text("<article><header class=entry-header><h1>A</h1></header><p>B</p></article>") == "A\nB"
    assert text("<article><header class=header><h1>A</h1></header><p>B</p></article>") == "A\nB"
    assert text("<nav>M</nav><article id=notice-12><p>A</p></article>") == "A"
    assert text("<nav>M</nav><main class=search-page><p>A</p></main>") == "A"
    assert text("<body><form action=x><div>M</div><article><p>A</p><form>F</form></article></form>") == "A"
    assert text("<article><p>A</p><div class='ad'>B</div><div class='x social-share'>C</div><p hidden>D</p><nav>E</nav></article>") == "A"
    assert text("<article>A</article><section id=comments><article id=comment-5>B</article><article class=comment>C</article></section>") == "A"


def page_text(source):
    return html_template.page_text(source)


def test_a_quote_opens_a_value_only_behind_an_equals_sign():
    assert page_text('<article><p>One</p><img alt="5" screen"><p>Two</p><p class="x">Three</p></article>') == "One\nTwo\nThree"
    assert page_text("<p class=it's>Hello world. It's nice</p><p>More</p>") == "Hello world. It's nice\nMore"
    assert page_text("<p title = 'a > b'>A</p><a href=x\"y>B</a><p data-x=\"<b>\">C</p><p a='unended>D") == "A\nB\nC"


def test_names_are_told_as_a_whole():
    assert page_text("<div class=legal-history><p>A</p></div><div id=content class='post social-science'>B</div><div class=site-header>C</div>") == "A\nB"
    assert page_text("<body><form action=x><div>Menu of a page</div><p>Text</p><select><option>O</select></form></body>") == "Menu of a page\nText"
    assert page_text("<article><p>Let <math><mi>x</mi></math> be z</p><div id=comments><p>First!</p></div><section id=related-comments>C</section></article>") == "Let x be z\nC"


def test_deep_nesting_takes_linear_time_and_memory():
    import tracemalloc

    def peak(n):
        tracemalloc.start()
        text = page_text("<i>" * n + "<p>x" * 200 + "</b>" * 200 + "<div>" * n + "end" + "</div></i>" * n)
        size = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert text.endswith("end")
        return size

    assert peak(40_000) < 6 * peak(10_000) < 600 << 20


def host_pages(spark, bodies):
    rows = [(i, f"http://h.example/{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_the_template_alone_finds_the_main_slot(spark):
    """No element or name tells menus, notices and text apart here: only what the host's pages share and where their words vary."""
    texts = [[" ".join(prose(i, 40)), " ".join(prose(50 + i, 30))] for i in range(12)]
    plain = [
        f"<div class=a><ul><li>Item {i}<li>Item {i * 7}</ul></div><div class=b><div class=c><p>Read our terms first.</p><h2>Story</h2><p>{x}</p><p>{y}</p></div></div><div class=z>Seen {i} times</div>"
        for i, (x, y) in enumerate(texts)
    ]
    found = {r["page_id"]: r["text"] for r in html_template.main_text(host_pages(spark, plain)).collect()}
    assert found == {i: f"{x}\n{y}" for i, (x, y) in enumerate(texts)}
    articles = [f"<div>Menu {i}</div><article><h1>Notes</h1><p>{x}</p><p>Subscribe today, it is free.</p><p>{y}</p></article>" for i, (x, y) in enumerate(texts)]
    found = {r["page_id"]: r["text"] for r in html_template.main_text(host_pages(spark, articles)).collect()}
    assert found == {i: f"Notes\n{x}\n{y}" for i, (x, y) in enumerate(texts)}
    # Few pages, or pages that are copies of each other, lose nothing of an article.
    for bodies in (articles[:4], [articles[0]] * 12):
        found = html_template.main_text(host_pages(spark, bodies)).collect()
        assert all(r["text"].startswith("Notes\n") and "Subscribe" in r["text"] for r in found)


def test_classes_equal_a_plain_deduction(spark):
    draw = random.Random(8)
    bodies = ["".join(draw.choice(("<p>A</p>", "<p>B</p>", "<ul><li>C</ul>", f"<div class=k>{i}</div>", "<p>A</p><hr>")) for _ in range(6)) + "<b>end</b><p>Z</p>" for i in range(9)]
    op = html_template.TemplateDeduction(support=0.7)
    pages = [html_template.token_counts(html_template.read_page(f"<html><body>{b}</body></html>"))[0] for b in bodies]
    vectors = collections.defaultdict(set)
    for token in set().union(*pages):
        vector = tuple(p[token] for p in pages)
        if sum(n > 0 for n in vector) >= op.support * 9 and len({n for n in vector if n}) == 1:
            vectors[vector].add(token)
    found = html_template.templates(host_pages(spark, bodies), op).first()
    assert sorted(map(sorted, found["classes"])) == sorted(map(sorted, vectors.values()))


def test_classes_nest_by_the_deepest_tag_around_them():
    classes = [["<html", "<html/body"], ["<html/body/div", "=html/body/div|x"], ["=html/body/div/p|y"], ["<html/body/ul/li"]]
    sets, parents = html_template.nested(classes)
    place = {min(c): i for i, c in enumerate(sets)}
    inner = {min(c): parents[i] for i, c in enumerate(sets)}
    assert inner == {"<html": -1, "<html/body/div": place["<html"], "=html/body/div/p|y": place["<html/body/div"], "<html/body/ul/li": place["<html"]}
    assert html_template.main_slot(classes, {"html/body/div/p": 70, "html/body/ul/li/a": 20, "html/body": 10}, 0.6) == "html/body/div"


def test_page_text(spark):
    shell = (
        "<!DOCTYPE html><html><head><title>T</title><script>var a='<article>no</article>';</script><style>p{{}}</style></head><body class=has-sidebar>"
        "<header><p>Site</p></header><nav><ul><li>Menu</ul></nav><div class='cookie-notice'>Cookies</div>{}<aside>Side</aside><form>Find<input></form>"
        "<section id=comments><article class=comment><p>First!</p></article></section><footer>&copy; us</footer></body></html>"
    )
    article = "<article><h1>Head &amp; tail</h1><p>One  <b>bold\n</b> text<br>more<p>Two &lt;x&gt;&nbsp;<div class=advert>Buy</div><ul><li>a<li>b</ul></article>"
    text = "Head & tail\nOne bold text more\nTwo <x>\na\nb"
    pages = [(i, "http://h.example/x", shell.format(article)) for i in range(5)] + [
        (10, "http://h.example/y", shell.format("<div class=story><p>Plain</p></div>")), (11, None, None), (12, "", ""), (13, "http://h.example/z", shell.format(article)[:-330]),
        (14, "x", "<p>loose <i>end"), (15, "x", "a < b & c"),
    ]
    table = spark.createDataFrame([*pages, pages[0]], "page_id long, url string, html string").withColumn("template", F.lit(1))
    found = [(r["page_id"], r["text"], r["n_chars"]) for r in html_template.main_text(table).collect()]
    texts = {i: t for i, t, _ in found}
    assert len(found) == len(pages) + 1 and all(n == len(t) for _, t, n in found)
    assert all(texts[i] == text for i in range(5))
    assert texts[10] == "Plain" and texts[11] == texts[12] == "" and texts[14] == "loose end" and texts[15] == "a < b & c"
    classes = html_template.templates(table).where("host = 'h.example'").first()["classes"]
    assert any("<html/body[class=has-sidebar]/nav" in c and "=html/body[class=has-sidebar]/nav/ul/li|Menu" in c for c in classes)
    assert html_template.main_text(table.limit(0)).count() == 0
