"""Prose, labels, the network's gradients, held-out accuracy and segments."""

from pathlib import Path

import numpy as np
import pytest

from spanloom.llm import langid as L

SAMPLES = "/root/testdata/sf0.001/lang_samples.parquet"


def test_prose_only():
    text = "First sentence stands here. **And a second one!**\n\n```\nnot this at all.\n```\nselect a, count(*) from t group by a;\nwith x as (select * from t)\n" \
           "CITED: q1, q2\n- **CITED:** q3\nspan=1 parent=2 exec_ms=3\nERROR:  relation does not exist\nabc,def,ghi,12,3.5\n[11:27] - A marked line is prose.\nwith our own eyes we saw it."
    assert L.sentences(text) == ["first sentence stands here.", "and a second one!", "a marked line is prose.", "with our own eyes we saw it."]
    assert L.sentences("The\tlog\tof\t2026-07-06\tstops\there.") == ["the log of stops here."]
    assert len(L.sentences("昨日から変化はない。freight_costの合計を比べたが、違いはない。")) == 2
    assert L.sentences("We saw orders_v2 and q43, then waited a bit.") == ["we saw and , then waited a bit."]
    assert L.sentences("") == [] and L.sentences(" \n ") == [] and L.sentences("a b") == []


def test_labels(spark):
    cases = {"en": "en", "English": "en", " en-US ": "en", "eng": "en", "pt_BR": "pt", "Nederlands": "nl", "??": None, "": None, "n/a": None, "und": None, "unknown": None, None: None, "zh": "zh", "ja-JP": "ja"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "raw string, want string")
    got = {r["raw"]: r["l"] for r in df.select("raw", L.label_column(df["raw"]).alias("l")).collect()}
    assert got == cases and all(L.label_of(k) == v for k, v in cases.items())


def test_gradients():
    rng = np.random.default_rng(0)
    m = {"embed": rng.normal(0, 0.5, (256, L.EMBED)), "out": rng.normal(0, 0.3, (len(L.WIDTHS) * L.FILTERS, len(L.LANGS))), "bias": np.zeros(len(L.LANGS))}
    for w in L.WIDTHS:
        m[f"w{w}"], m[f"b{w}"] = rng.normal(0, 0.3, (w * L.EMBED, L.FILTERS)), np.zeros(L.FILTERS)
    x, y = rng.integers(0, 256, (3, L.WINDOW)), np.array([0, 3, 7])
    ones = np.ones((3, len(L.WIDTHS) * L.FILTERS))
    loss = lambda: -L.forward(m, x)[0][np.arange(3), y].mean()
    g = L.gradients(m, x, y, ones)
    for name in m:
        flat = m[name].reshape(-1)
        for i in rng.choice(len(flat), 4, replace=False):
            at, flat[i] = flat[i], flat[i] + 1e-5
            up = loss()
            flat[i] = at - 1e-5
            down = loss()
            flat[i] = at
            assert np.isclose((up - down) / 2e-5, g[name].reshape(-1)[i], atol=1e-4)


def test_chain_weighs_neighbours():
    weak, strong = np.full(11, -3.0), np.full(11, -30.0)
    a, b = strong.copy(), strong.copy()
    a[0] = b[1] = 0.0
    doubt = weak.copy()
    doubt[1] = -1.0
    assert L.smooth(np.stack([a, doubt, a])).argmax(axis=1).tolist() == [0, 0, 0]
    assert L.smooth(np.stack([a, b, a])).argmax(axis=1).tolist() == [0, 1, 0]


@pytest.fixture(scope="module")
def model(spark):
    if not Path(SAMPLES).exists():
        pytest.skip("no samples here")
    return L.fit(spark.read.parquet(SAMPLES).where("sample_id % 5 <> 0"))


def test_held_out(spark, model):
    rows = spark.read.parquet(SAMPLES).where("sample_id % 5 = 0").collect()
    seg = L.languages(L.segments(spark.createDataFrame([(r["sample_id"], r["text"]) for r in rows], "doc_id long, text string"), model)).collect()
    best = {}
    for r in seg:
        if r["doc_id"] not in best or r["share"] > best[r["doc_id"]]["share"]:
            best[r["doc_id"]] = r
    assert np.mean([best[r["sample_id"]]["lang"] == r["lang"] for r in rows if r["sample_id"] in best]) >= 0.97


def test_segments(spark, model):
    en, de = "The agent asked the warehouse for the same table again and again.", "Der Agent hat das Lager immer wieder nach derselben Tabelle gefragt."
    df = spark.createDataFrame([(1, f"{en} {en} {de} {de} {en}", 1), (2, None, 1), (3, "", 1), (4, "select 1 from t;", 1), (5, (de + " ") * 3000, 1)], "doc_id long, text string, segment int")
    got = {}
    for r in sorted(L.segments(df, model).collect(), key=lambda r: (r["doc_id"], r["segment"])):
        assert 0 < r["confidence"] <= 1
        got.setdefault(r["doc_id"], []).append((r["lang"], r["sentences"]))
    assert got == {1: [("en", 2), ("de", 2), ("en", 1)], 5: [("de", 3000)]}
    assert L.segments(df.limit(0), model).count() == 0


@pytest.mark.parametrize("text", ["a=" * 60_000 + "b c", "x" * 150_000 + " y z.", "x1" * 80_000, "-" * 150_000 + "x", "*" * 100_000, "a_" * 60_000 + " b c d.", "." * 100_000, "`" * 50_000 + "a", "select " * 20_000, "= " * 50_000])
def test_long_runs_end_in_time(text):
    import time
    began = time.time()
    L.sentences(text)
    assert time.time() - began < 5


def test_no_prefix_decides():
    """A long run of marks before the first letter, or before CITED, changes nothing."""
    marks = "*" * 900
    assert L.sentences(f"{marks}total=5 {marks}n=6") == []
    assert L.sentences("The answer is in the second table. " + "#" * 60 + " CITED: q1 and q2 and q3 of it.") == ["the answer is in the second table."]
