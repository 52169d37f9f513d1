import numpy as np
import pytest

from lectern.llm.mixing import Mixture
from lectern.llm.packing import byte_pieces, fill_report, pack, pack_texts


def brute_pack(sizes, cap):
    levels: list[int] = []
    for s in sizes:
        if s == 0:
            continue
        best = None
        for h in sorted({0, *levels}, reverse=True):
            if h + s > cap or h == cap:
                continue
            after = list(levels)
            if h:
                after.remove(h)
            after.append(h + s)
            counts = np.bincount([x for x in after if x < cap], minlength=cap + 1)
            cost = int((counts**2).sum())
            if best is None or cost < best[0]:
                best = (cost, after)
        levels = best[1]
    return sorted(levels)


def test_same_levels_as_by_definition():
    rng = np.random.default_rng(2)
    for _ in range(60):
        sizes = rng.integers(0, 13, size=40)
        window = pack(sizes, 12)
        got = np.bincount(window, weights=sizes)
        assert got.max() <= 12
        assert sorted(int(x) for x in got if x) == brute_pack(sizes.tolist(), 12)


def test_byte_pieces():
    text = "é" * 5000 + "x"
    got = byte_pieces(text, 4096)
    assert sum(got) == len(text.encode()) and max(got) <= 4096
    raw, at = text.encode(), 0
    for n in got:
        raw[at : at + n].decode()
        at += n
    assert byte_pieces("", 10) == [0]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int, shard int, key string")


def test_pack_texts(spark):
    rows = [(i, "w" * (i * 37 % 900), "s", 0, 0, "k") for i in range(400)] + [(900, "é" * 3000, "s", 0, 0, "k"), (901, None, None, 0, 0, None), (902, "", "s", 0, 0, "k"), (5, "again", "s", 0, 0, "k"), (None, "lost", "s", 0, 0, "k")]
    packed = pack_texts(docs(spark, rows))
    got = packed.collect()
    assert {r.doc_id for r in got} == set(range(400)) | {900, 901, 902}
    assert sum(r.n_tokens for r in got) == sum(len((t or "").encode()) for i, t, *_ in rows if i is not None)
    assert {r.doc_id for r in got if r.n_pieces > 1} == {900}
    assert [r.start_token for r in sorted(got, key=lambda r: r.piece_no) if r.doc_id == 900] == [0, 4096]
    report = fill_report(packed).first()
    assert report.largest <= 4096 and report.mean_fill > 0.9
    assert pack_texts(docs(spark, [])).count() == 0


TARGETS = [("a", 2, 3), ("b", 1, 1), ("c", 1, 2), ("none", 1, 4), ("a", 1, 1), (None, 5, 1)]


@pytest.fixture(scope="module")
def mix(spark):
    rows = [(i, "word " * (i % 50), "a", 0, 0, "k") for i in range(300)] + [(1000 + i, "text! " * 30, "b", 0, 0, "k") for i in range(300)]
    rows += [(2000 + i, "zz " * 10, "c", 0, 0, "k") for i in range(20)] + [(5000, None, "a", 0, 0, "k"), (5001, "x", None, 0, 0, "k"), (5002, "y", "other", 0, 0, "k")]
    return rows, Mixture(docs(spark, rows), spark.createDataFrame(TARGETS, "source string, weight int, max_repeats int"))


def test_shares_caps_and_epochs(mix):
    rows, m = mix
    size = {i: len((t or "").encode()) for i, t, *_ in rows}
    total = {s: sum(size[r[0]] for r in rows if r[2] == s) for s in "abc"}
    weight, cap, every = {"a": 3, "b": 1, "c": 1, "none": 1}, {"a": 3, "b": 1, "c": 2, "none": 4}, sum(total.values())
    report = {r.source: r for r in m.report().collect()}
    assert set(report) == set(weight)
    for s, w in weight.items():
        have = total.get(s, 0)
        assert report[s].reachable == (have * cap[s] * 6 >= w * every)
        budget = min(w / 6 * every, have * cap[s])
        assert budget - (max([size[r[0]] for r in rows if r[2] == s] or [0])) <= report[s].actual_tokens <= budget + 1e-6
        assert report[s].most_uses <= cap[s]
    drawn = m.draws().collect()
    assert len({r.doc_id for r in drawn}) == len(drawn)
    for s in "abc":
        uses = [r.uses for r in drawn if r.source == s]
        assert max(uses) - min(uses) <= 1
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9


def test_fraction_takes_smallest_keys(mix):
    _, m = mix
    keyed = {r.id: r for r in m.keyed.collect()}
    for source in "ab":
        mine = sorted((r for r in keyed.values() if r.source == source and r.n_tokens), key=lambda r: (r.key, r.id))
        uses = {r.doc_id: r.uses for r in m.draws().collect() if r.source == source}
        epochs = m.plan.where(f"source = '{source}'").first()
        spent, want = 0, {}
        for r in mine:
            spent += r.n_tokens
            n = epochs.epochs + (spent <= epochs.rest)
            if n:
                want[r.id] = n
        assert uses == want


def test_empty(spark):
    m = Mixture(docs(spark, []), spark.createDataFrame([("a", 1, 1)], "source string, weight int, max_repeats int"))
    assert m.draws().count() == 0 and [r.actual_tokens for r in m.report().collect()] == [0]
    m = Mixture(docs(spark, [(1, "x", "a", 0, 0, "")]), spark.createDataFrame([], "source string, weight int, max_repeats int"))
    assert m.report().count() == 0


def test_buckets_are_even_whatever_the_quality(spark):
    """Documents of tables and code (quality 0.05) beside good ones: no bucket has over 1 % of a source."""
    rows = spark.range(40_000).selectExpr("id doc_id", "if(id % 3 = 0, 'plain words here', '0123456789;;{}[]()==++') text", "if(id % 2 = 0, 'a', 'b') source", "1 id", "1 n", "'k' bucket")
    rows = rows.selectExpr("doc_id", "if(source = 'b', '0123456789;;{}[]()==++', text) text", "source", "id", "n", "bucket")
    m = Mixture(rows, spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "source string, weight int, max_repeats int"))
    for source in "ab":
        assert m.buckets.where(f"source = '{source}'").agg({"documents": "max"}).first()[0] < 0.01 * 20_000


def test_missing_weights_and_repeats(spark):
    rows = docs(spark, [(i, "some words", s, 0, 0, "") for i, s in enumerate("aabbc")])
    targets = spark.createDataFrame([("a", 1, None), ("b", None, 1), ("c", 1, 0)], "source string, weight int, max_repeats int")
    got = {r.source: (r.actual_tokens, r.reachable) for r in Mixture(rows, targets).report().collect()}
    assert got == {"a": (0, False), "b": (0, True), "c": (0, False)}
