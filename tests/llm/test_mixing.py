"""Raking and sampling: shares, caps, edge cases."""

import numpy as np

from spanloom.llm import mixing as M


def test_rake_meets_marginals():
    rng = np.random.default_rng(1)
    tokens = rng.integers(50, 500, 24).astype(float)
    lang, topic, src = np.arange(24) % 2, np.arange(24) // 2 % 3, np.arange(24) // 6
    size = tokens.sum() * 0.4
    source = size * np.array([0.4, 0.3, 0.2, 0.1])
    share = lambda a, n: np.bincount(a, tokens, n) / tokens.sum() * size
    w = M.rake(tokens, [lang, topic, src], [share(lang, 2), share(topic, 3), source], tokens * 5)
    assert np.allclose(np.bincount(src, w), source)
    assert np.allclose(np.bincount(lang, w), share(lang, 2), rtol=1e-3) and np.allclose(np.bincount(topic, w), share(topic, 3), rtol=1e-3)


def test_rake_keeps_the_cap_and_fills_the_source():
    tokens, src = np.array([10.0, 10.0, 100.0]), np.array([0, 0, 1])
    w = M.rake(tokens, [np.array([0, 1, 0]), np.zeros(3, int), src], [np.array([60.0, 5.0]), np.array([65.0]), np.array([25.0, 40.0])], np.array([15.0, 15.0, 100.0]))
    assert np.allclose(np.bincount(src, w), [25, 40]) and (w <= [15.000001, 15.000001, 100]).all()


def tables(spark, n=600):
    docs = [(i, None if i % 97 == 0 else "" if i % 89 == 0 else f"word number {i} " * (1 + i % 5), ["Blog", "wiki", "WIKI ", "news-wire", "newswire", None, "rare"][i % 7] if i % 50 else "rare", ["en", "de", None, "??"][i % 4], f"a{i % 3}", 1) for i in range(n)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, agent_id string, src int")
    a = spark.createDataFrame([("a0", "x"), ("a1", None)], "agent_id string, team string")
    t = spark.createDataFrame([(1, "blog", 0.5, 1, 0.2), (1, "wiki", 0.3, 2, 0.2), (1, "news_wire", 0.2, 2, 0.2), (2, "rare", 0.9, 3, 0.9), (2, "absent", 0.1, 2, 0.9)], "mix_id int, source string, target_share double, max_repeats int, size_ratio double")
    return d, a, t


def test_shares_and_caps(spark):
    d, a, t = tables(spark)
    mixed, plan = M.mix(M.sized(d, a, t), t)
    rows = mixed.collect()
    cap = {(r["mix_id"], r["source"]): r["max_repeats"] for r in t.collect()}
    assert rows and all(0 < r["copies"] <= cap[r["mix_id"], r["src"]] for r in rows)
    assert len({(r["mix_id"], r["doc_id"]) for r in rows}) == len(rows) and all(r["n_tokens"] > 0 for r in rows)
    s = {(r["mix_id"], r["source"]): r for r in M.shares(mixed, plan).collect()}
    for name, share in (("blog", 0.5), ("wiki", 0.3), ("news_wire", 0.2)):
        assert s[1, name]["reachable"] and abs(s[1, name]["actual_share"] - share) < 0.02
    assert not s[2, "rare"]["reachable"] and s[2, "rare"]["most_copies"] == 3 and s[2, "absent"]["actual_tokens"] == 0
    assert sorted(map(tuple, rows)) == sorted(map(tuple, M.mix(M.sized(d, a, t), t)[0].collect()))


def test_no_documents(spark):
    d, a, t = tables(spark, 20)
    mixed, plan = M.mix(M.sized(d.limit(0), a, t), t)
    assert mixed.count() == 0
    assert all(r["actual_share"] == 0 and r["actual_tokens"] == 0 for r in M.shares(mixed, plan).collect())


def test_a_document_at_its_cap_gets_no_further_copy(spark):
    """One source out of reach (all its documents at the cap) beside one whose cut falls into the top bin."""
    docs = [(i, "word " * 5, "rare" if i < 40 else "blog", "en", "a0", 1) for i in range(1500)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, agent_id string, src int")
    a = spark.createDataFrame([("a0", "x")], "agent_id string, team string")
    for ratio in (0.3, 0.03, 0.0101):
        t = spark.createDataFrame([(1, "rare", 0.9, 3, ratio), (1, "blog", 0.1, 1, ratio), (2, "rare", 0.999, 1, 0.9), (2, "blog", 0.001, 2, 0.9)], "mix_id int, source string, target_share double, max_repeats int, size_ratio double")
        cap = {(r["mix_id"], r["source"]): r["max_repeats"] for r in t.collect()}
        rows = M.mix(M.sized(d, a, t), t)[0].collect()
        assert rows and all(r["copies"] <= cap[r["mix_id"], r["src"]] for r in rows)


def test_caps_on_the_given_tables(spark):
    import os

    from spanloom.llm.queries import p8_limits

    for sf in ("sf0.001", "sf0.01"):
        d = f"/root/testdata/{sf}"
        if os.path.isdir(d):
            assert p8_limits(spark, d).where("not within_cap").count() == 0
