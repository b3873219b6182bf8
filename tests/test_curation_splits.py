import hashlib
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tasksieve.errors import SplitError
from tasksieve.functions import text
from tasksieve.operators import curation, deficit, splits
from tasksieve.sources import tables
from tests.conftest import SMALL


def test_report_counts_by_status(spark, task, tasks_of):
    report = curation.curation_report(tasks_of(task("a"), task("u", review_status="unreviewed", review_notes=""))).first()
    assert (report.task_count, report.accepted_count, report.unreviewed_count) == (2, 1, 1)
    assert (report.revised_count, report.rejected_count, report.issues_by_code) == (0, 0, "{}")


def test_issues_in_order(spark, task, tasks_of):
    rows = tasks_of(
        task("a", program="MOVE  A\n TO Straße"),
        task("b", program=" move a to\tSTRASSE ", specification="Some cases, etc.", source_url="ftp://x",
             license_id="UNſPECIFIED", review_notes=" "),
        task("c", program="move a to strasse", license_id="N/A"),
    )
    issues = curation.curation_issues(rows).orderBy("seq", "check_ord").collect()
    assert [(i.task_id, i.code, i.severity) for i in issues] == [
        ("b", "duplicate_program", "review"), ("b", "possible_ambiguity", "review"),
        ("b", "missing_provenance_url", "error"), ("b", "unknown_license", "error"),
        ("b", "missing_review_rationale", "warning"), ("c", "duplicate_program", "review"), ("c", "unknown_license", "error"),
    ]
    assert issues[0].detail == "program duplicates task a" and issues[5].detail == "program duplicates task a"
    counts = {r.code: r.n for r in curation.issues_by_code(rows).collect()}
    assert counts == {"duplicate_program": 2, "possible_ambiguity": 1, "missing_provenance_url": 1,
                      "unknown_license": 2, "missing_review_rationale": 1}


SPECS = [
    "etc", "a, b, etc.", "ETC.x", "etcetera", "fetch etch", "as  appropriate", "as appropriate", "and so on", "band so on",
    "some casesé", "ésome cases", "_etc", "some caseś", "ſome caſes", "etc1", "x-etc-y", "",
]


VAGUE = [True, True, True, False, False, False, True, True, False, False, False, False, True, True, False, True, False]


def test_vague_phrases_are_whole_words(spark):
    frame = spark.createDataFrame([(s,) for s in SPECS], "s string")
    found = {row.s: row.vague for row in frame.select("s", curation.is_vague(F.col("s")).alias("vague")).collect()}
    assert found == dict(zip(SPECS, VAGUE))


ODD = ["", " ", " a\u0085b\x1cc\x1dd", " x 　y ", "ﬁle STRASSE Straße ſ İI ΣΑΣ ς", "a\r\nb\rc\x0bd\x0ce",
       "½ ﷺ ™ ａ", "​zero﻿", "ŉ ǰ ΐ և ẖ", "plain ASCII\t text\n", "\x1f\x1e"]


FOLDED = ['', '', 'a b c d', 'x y', 'file strasse strasse s i\u0307i \u03c3\u03b1\u03c3 \u03c3', 'a b c d e', '\xbd \ufdfa \u2122 \uff41', '\u200bzero\ufeff', '\u02bcn j\u030c \u03b9\u0308\u0301 \u0565\u0582 h\u0331', 'plain ascii text', '']
COMPATIBLE = ['', '', 'a b c d', 'x y', 'file strasse strasse s i\u0307i \u03c3\u03b1\u03c3 \u03c3', 'a b c d e', '1\u20442 \u0635\u0644\u0649 \u0627\u0644\u0644\u0647 \u0639\u0644\u064a\u0647 \u0648\u0633\u0644\u0645 tm a', '\u200bzero\ufeff', '\u02bcn j\u030c \u03b9\u0308\u0301 \u0565\u0582 h\u0331', 'plain ascii text', '']


def test_text_functions_follow_python(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "i int, s string")
    s = F.col("s")
    out = {r.i: r for r in rows.select(
        "i", text.strip(s).alias("strip"), text.is_blank(s).alias("blank"), text.squeeze(s).alias("squeeze"),
        text.word_count(s).alias("words"), text.visible_line_count(s).alias("lines"), text.json_string(s).alias("json"),
        text.folded_digest(s).alias("fold"), text.folded_digest(s, compatibility=True).alias("nfkc"),
    ).collect()}
    for i, value in enumerate(ODD):
        assert out[i].strip == value.strip()
        assert out[i].blank == (not value.strip())
        assert out[i].squeeze == re.sub(r"\s+", " ", value).strip()
        assert out[i].words == len(value.split())
        assert out[i].lines == len([line for line in value.splitlines() if line.strip()])
        assert out[i].fold == hashlib.sha256(FOLDED[i].encode()).hexdigest()
        assert out[i].nfkc == hashlib.sha256(COMPATIBLE[i].encode()).hexdigest()


def folded_and_composed(spark, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, s string").repartition(8)
    return {r.i: (r.fold, r.nfkc, r.words) for r in rows.select(
        "i", text.case_folded(F.col("s")).alias("fold"), text.compatible(F.col("s")).alias("nfkc"), text.word_count(F.col("s")).alias("words")
    ).collect()}


def test_random_texts_fold_and_compose_like_python(spark):
    rng = random.Random(1)
    pool = [chr(c) for c in (*range(1, 0x250), *range(0x300, 0x590), *range(0x1100, 0x1200), *range(0x1e00, 0x2070), *range(0xac00, 0xac80), *range(0xf900, 0xfb50), 0x1d15e, 0x2f800)]
    values = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    found = folded_and_composed(spark, [*values, None])
    for i, value in enumerate(values):
        assert found[i] == (value.casefold(), unicodedata.normalize("NFKC", value), len(value.split())), ascii(value)
    assert found[3000] == (None, None, None)


def test_all_assigned_characters_fold_and_compose_like_python(spark):
    """Between marks and letters, so that composing and reordering show; the engine's library knows newer characters too."""
    known = [c for c in map(chr, range(1, 0x110000)) if unicodedata.category(c) not in ("Cn", "Cs", "Co")]
    values = ["a" + "".join(f"{c}\u0301\u0323" for c in known[i : i + 40]) for i in range(0, len(known), 40)]
    found = folded_and_composed(spark, values)
    assert all(found[i][:2] == (v.casefold(), unicodedata.normalize("NFKC", v)) for i, v in enumerate(values))


def test_folding_stays_on_the_jvm(spark):
    rows = tables.tasks(spark, SMALL, "task_id", "seq", "program")
    for frame in (curation.duplicate_programs(rows), splits.spec_leakage(tables.per_task_split(spark, SMALL))):
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan and "ReusedExchange" in plan


def test_fingerprint_ignores_order_and_sees_moved_text(spark, task, tasks_of):
    a, b = task("a", program="XY", reference_program="Z"), task("b")
    first = curation.dataset_fingerprint(tasks_of(a, b)).first()[0]
    assert curation.dataset_fingerprint(tasks_of(b, a).repartition(5)).first()[0] == first
    moved = task("a", program="X", reference_program="YZ")
    assert curation.dataset_fingerprint(tasks_of(moved, b)).first()[0] != first
    assert curation.dataset_fingerprint(tasks_of(a, b, b)).first()[0] != first


def test_groups_stay_together_and_every_split_is_filled(spark, task, tasks_of):
    sizes = {"north": 4, "east": 1, "south": 3, "west": 2, "centre": 1}
    rows = tasks_of(*[task(f"{g}-{i}", group_id=g) for g, n in sizes.items() for i in range(n)])
    for in_turn in (False, True):
        found = splits.make_splits(rows, seed=11, in_turn=in_turn).groupBy("group_id").agg(F.collect_set("split").alias("s"), F.count("*").alias("n")).collect()
        assert {r.group_id: r.n for r in found} == sizes and all(len(r.s) == 1 for r in found)
        assert {r.s[0] for r in found} == {"train", "validation", "test"}


def test_split_guards(spark, task, tasks_of):
    three = tasks_of(*[task(i) for i in "abc"])
    for bad in [(0, 0.1), (1, 0.1), (0.5, 0), (0.7, 0.3), (0.9, 0.2)]:
        with pytest.raises(SplitError):
            splits.make_splits(three, train_fraction=bad[0], validation_fraction=bad[1])
    with pytest.raises(SplitError, match="fill three"):
        splits.make_splits(tasks_of(task("a"), task("b")))
    with pytest.raises(SplitError, match="no tasks"):
        splits.make_splits(three.limit(0))
    with pytest.raises(SplitError, match="more than one row"):
        splits.make_splits(tasks_of(task("a"), task("a", group_id="x"), task("b"), task("c")))
    with pytest.raises(ValueError, match="none of"):
        splits.get_split(splits.make_splits(three), "dev")


def test_strict_split_finds_equal_specifications(spark, task, tasks_of):
    rows = tasks_of(*[task(i, specification="Ｓame  TEXT" if i in "ab" else i) for i in "abc"])
    with pytest.raises(SplitError, match="specification"):
        splits.make_splits(rows)
    loose = splits.make_splits(rows, strict=False)
    assert {r.task_id for r in splits.spec_leakage(loose).collect()} == {"a", "b"}
    assert splits.group_leakage(loose).count() == 0


def one_window(sizes, seed, train, validation):
    """The split rule over one ordered list."""
    order = sorted(sizes, key=lambda g: (hashlib.md5(f"{seed}:{g}".encode()).hexdigest(), g))
    total = sum(sizes.values())
    filled = {"train": sizes[order[0]], "validation": sizes[order[1]], "test": sizes[order[2]]}
    target = {"train": max(1, int(total * train)), "validation": max(1, int(total * validation))}
    owner = dict(zip(order, ("train", "validation", "test")))
    for g in order[3:]:
        name = next((n for n in ("train", "validation") if filled[n] < target[n]), "test")
        owner[g] = name
        filled[name] += sizes[g]
    return owner


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bucketed_windows_equal_one_ordered_pass(spark, seed):
    rng = random.Random(seed)
    sizes = {f"g{i}": rng.choice([1, 2, 5, 40]) for i in range(rng.randint(3, 3000))}
    sizes["hot"] = sum(sizes.values()) // 2
    frame = spark.createDataFrame(list(sizes.items()), "group_id string, n_tasks long")
    train, validation = rng.choice([(0.7, 0.15), (0.5, 0.3), (0.1, 0.1)])
    got = {r.group_id: r.split for r in splits.assign_groups(frame, seed, train, validation).collect()}
    assert got == one_window(sizes, seed, train, validation)


def one_after_the_other(order, sizes, train, validation):
    """The sequential rule over one ordered list."""
    lacks = {"train": train - sizes[order[0]], "validation": validation - sizes[order[1]]}
    owner = dict(zip(order, ("train", "validation", "test")))
    for g in order[3:]:
        name = "test"
        if lacks["train"] > 0 and lacks["train"] >= lacks["validation"]:
            name = "train"
        elif lacks["validation"] > 0:
            name = "validation"
        owner[g] = name
        if name != "test":
            lacks[name] -= sizes[g]
    return owner


def random_sizes(rng, n):
    kind = rng.randrange(4)
    sizes = [rng.choice([[1], [1, 2, 3], [5, 7, 40], [1, 1, 1, 300]][kind]) for _ in range(n)]
    if rng.random() < 0.4:
        sizes[rng.randrange(n)] = max(1, sum(sizes) // rng.choice([2, 3, 10]))
    return sizes


def test_composed_maps_equal_the_rule_on_random_lists():
    """1,000 lists: maps of blocks composed in any grouping give the state that going through all groups gives."""
    rng = random.Random(4)
    for _ in range(1000):
        sizes = random_sizes(rng, rng.randint(1, 60))
        radius = rng.randint(0, 50)
        cuts = sorted(rng.sample(range(len(sizes) + 1), min(len(sizes), rng.randint(0, 4))))
        pieces = [sizes[a:b] for a, b in zip([0, *cuts], [*cuts, len(sizes)])]
        whole, reach = None, radius
        for piece in pieces:
            own = deficit.block_map(piece, reach)
            whole = own if whole is None else whole.then(own)
            reach = max([reach, *piece])
        for state in {-radius, -1, 0, radius, rng.randint(-radius, radius)} & set(range(-radius, radius + 1)):
            now = state
            for size in sizes:
                now += -size if now >= 0 else size
            assert whole(state) == now
        assert len(whole.starts) <= 2 * min(radius, sum(sizes)) + 2


@pytest.mark.parametrize("seed", range(6))
def test_groups_in_turn_equal_one_ordered_pass(spark, seed):
    rng = random.Random(seed)
    listed = random_sizes(rng, rng.choice([3, 40, 400]))
    if seed == 5:
        listed = [1] * 300
    train, validation = rng.choice([(0.7, 0.15), (0.3, 0.6), (0.1, 0.1)])
    order = [f"g{i}" for i in range(len(listed))]
    sizes = dict(zip(order, listed))
    before = [sum(listed[:i]) for i in range(len(listed))]
    ranked = spark.createDataFrame([(g, sizes[g], i + 1, x) for i, (g, x) in enumerate(zip(order, before))], "group_id string, n_tasks long, rank long, tasks_before long")
    targets = deficit.deficit_targets(sum(listed), train, validation)
    found = deficit.assign_by_deficit(ranked, targets, block_tasks=20, fan_in=3).collect()
    assert {r.group_id: r.split for r in found} == one_after_the_other(order, sizes, *targets) and len(found) == len(order)


def test_split_does_not_depend_on_input_order(spark):
    rows = tables.tasks(spark, SMALL, "task_id", "group_id")
    a = splits.make_splits(rows, strict=False)
    b = splits.make_splits(rows.orderBy(F.desc("task_id")).repartition(3), strict=False)
    assert a.exceptAll(b).isEmpty() and a.count() == rows.count()


def test_splits_are_written_by_partition(spark, tmp_path):
    rows = splits.make_splits(tables.tasks(spark, SMALL, "task_id", "group_id"), strict=False)
    back = spark.read.parquet(splits.write_splits(rows, str(tmp_path / "s")))
    test = splits.get_split(back, "test")
    assert "PartitionFilters: [isnotnull(split" in test._jdf.queryExecution().executedPlan().toString()
    assert test.count() == splits.get_split(rows, "test").count()
