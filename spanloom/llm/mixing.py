"""Mixing sources to target weights, by raking and calibrated sampling.

1. Sizes: every document's tokens under a public tokenizer, counted once and written to the shared folder.
2. Cells: tokens by source, language and topic, a table whose size depends on the labels, not on the documents.
3. Raking (iterative proportional fitting): the cells' token weights are scaled in turn to the source targets of the mix
   (share of its size) and to the corpus' own language and topic shares, never above ``max_repeats`` times what a
   cell holds, until nothing moves. The source step comes last, so sources are met wherever they can be.
4. Sampling: a document of a cell with weight ``w`` times its tokens occurs ``floor(w)`` times and once more with the
   remaining probability, decided by a hash of mix and document. Per mix and source the cut of that hash is then
   shifted so that the tokens drawn meet the raked total (a histogram of 4096 bins a source, then one bin's documents
   more or less), which removes the sampling error. A document at its cap takes no part in that: no document ever
   occurs more than ``max_repeats`` times.

A source that holds too little even when repeated ``max_repeats`` times gives all it can; the shortfall is reported, not
filled from other sources.

Defined results: sources are matched to the targets in lower case with ``_`` for blanks and hyphens, then by at most two
edits; other and null sources belong to no mix. Documents without tokens (null, empty) never occur. Unknown language or
topic labels form a class of their own. No documents, or none of a mix's sources: the mix is empty, its shares 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.bpe import NAME, TOKENIZERS, token_counts
from spanloom.llm.langid import LANGS, label_column
from spanloom.session import cut

BINS = 4096


def source_of(c: Column, known: list[str]) -> Column:
    """The known source a label stands for, or null."""
    t = F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")
    near = F.lit(None).cast("string")
    for k in sorted(known, reverse=True):
        near = F.when(F.levenshtein(t, F.lit(k)) <= 2, F.lit(k)).otherwise(near)
    return F.when(t.isin(*known), t).otherwise(near)


def rake(tokens: np.ndarray, axes: list[np.ndarray], targets: list[np.ndarray], cap: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weights of cells whose sums over each axis meet its targets as far as ``cap`` (per cell) allows.

    axes: class of every cell on each axis, the last one (sources) being met exactly where it can be.
    """
    w = np.minimum(tokens.astype(float), cap)
    for _ in range(rounds):
        before = w.copy()
        for axis, target in zip(axes, targets):
            now = np.bincount(axis, w, len(target))
            w = np.minimum(w * np.divide(target, now, out=np.ones_like(now), where=now > 0)[axis], cap)
        axis, target = axes[-1], targets[-1]
        for _ in range(30):  # what the cap cut off goes to the source's other cells
            lack = target - np.bincount(axis, w, len(target))
            free = w < cap * (1 - 1e-12)
            room = np.bincount(axis, np.where(free, w, 0), len(target))
            if not np.any((lack > 1e-9 * target.max(initial=1)) & (room > 0)):
                break
            w = np.where(free, np.minimum(w * (1 + np.divide(np.maximum(lack, 0), room, out=np.zeros_like(lack), where=room > 0))[axis], cap), w)
        if np.abs(w - before).max(initial=0) <= 1e-9 * max(w.max(initial=0), 1):
            break
    return w


def sized(documents: DataFrame, agents: DataFrame, targets: DataFrame, path: str = f"{TOKENIZERS}/{NAME}") -> DataFrame:
    """``doc_id, src, lang, topic, n_tokens`` of the documents of known sources, written once."""
    known = sorted({r["source"] for r in targets.select("source").distinct().collect()})  # a fixed, small table
    teams = agents.select(F.col("agent_id").alias("_agent"), F.col("team").alias("_team")).dropDuplicates(["_agent"])
    lang = label_column(F.col("lang"))
    d = documents.select("doc_id", "text", source_of(F.col("source"), known).alias("src"), "agent_id",
                         F.when(lang.isin(*LANGS), lang).otherwise("unknown").alias("lang"))
    d = d.join(teams, d["agent_id"] == teams["_agent"], "left").select("doc_id", "text", "src", "lang", F.coalesce("_team", F.lit("unknown")).alias("topic"))
    return cut(token_counts(d, path=path).drop("text"), name="sized")


def mix(docs: DataFrame, targets: DataFrame) -> tuple[DataFrame, list[tuple]]:
    """The mixes of :func:`sized` documents: ``mix_id, doc_id, src, n_tokens, copies``, and the plan's rows by source."""
    spark = docs.sparkSession
    cells = docs.groupBy("src", "lang", "topic").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0").orderBy("src", "lang", "topic").collect()
    corpus = float(sum(c["tokens"] for c in cells))
    cells = [c for c in cells if c["src"] is not None]
    weights, plan = [], []
    wanted: dict[int, list] = {}
    for r in targets.where("mix_id is not null and source is not null").orderBy("mix_id", "source").collect():
        wanted.setdefault(r["mix_id"], []).append(r)
    for mix_id, rows in wanted.items():
        size = corpus * float(rows[0]["size_ratio"])
        share, repeats = {r["source"]: float(r["target_share"]) for r in rows}, {r["source"]: int(r["max_repeats"]) for r in rows}
        mine = [c for c in cells if c["src"] in share]
        tokens = np.array([c["tokens"] for c in mine], float)
        cap = np.array([c["tokens"] * repeats[c["src"]] for c in mine], float)
        names = [sorted({c[k] for c in mine}) for k in ("lang", "topic", "src")]
        axes = [np.array([n.index(c[k]) for c in mine], int) for n, k in zip(names, ("lang", "topic", "src"))]
        most = np.bincount(axes[2], cap, len(names[2]))
        src = np.minimum([share[s] * size for s in names[2]], most)
        marg = [np.bincount(a, tokens, len(n)) / max(tokens.sum(), 1) * src.sum() for a, n in zip(axes[:2], names[:2])]
        w = rake(tokens, axes, [*marg, src], cap) if len(mine) else np.zeros(0)
        weights += [(mix_id, c["src"], c["lang"], c["topic"], float(x / c["tokens"]), repeats[c["src"]]) for c, x in zip(mine, w)]
        got = np.bincount(axes[2], w, len(names[2])) if len(mine) else np.zeros(0)
        for r in rows:
            s = r["source"]
            i = names[2].index(s) if s in names[2] else -1
            plan.append((mix_id, s, share[s], repeats[s], share[s] * size, float(most[i]) if i >= 0 else 0.0, float(got[i]) if i >= 0 else 0.0))
    at = spark.createDataFrame(weights, "mix_id int, src string, lang string, topic string, w double, cap int")  # cells times mixes
    u = (F.pmod(F.xxhash64(F.lit("mix"), "mix_id", "doc_id"), F.lit(1 << 40)) / float(1 << 40))
    drawn = docs.where("n_tokens > 0").join(F.broadcast(at), ["src", "lang", "topic"]).withColumn("base", F.floor(F.col("w") + 1e-9).cast("int"))
    # a document at its cap has no chance of one more copy: no bin
    v = u - 1 + F.greatest(F.col("w") - F.col("base"), F.lit(0.0))
    drawn = drawn.withColumn("bin", F.when(F.col("base") < F.col("cap"), F.least(F.floor((v + 1) / 2 * BINS), F.lit(BINS - 1))).cast("int"))
    hist = drawn.groupBy("mix_id", "src", "bin").agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.col("base")).alias("b")).collect()  # at most BINS rows a mix and source
    cuts = []
    for mix_id, s, _, _, _, _, got in plan:
        rows = sorted(((h["bin"], h["n"], h["b"]) for h in hist if h["mix_id"] == mix_id and h["src"] == s), key=lambda x: -1 if x[0] is None else x[0])
        lack = got - sum(b for _, _, b in rows)
        best, first, have = abs(lack), BINS, 0.0
        for b, n, _ in reversed([x for x in rows if x[0] is not None]):
            have += n
            if abs(lack - have) <= best:
                best, first = abs(lack - have), b
        cuts.append((mix_id, s, first))
    edge = spark.createDataFrame(cuts, "mix_id int, src string, first int")  # a row a mix and source
    out = drawn.join(F.broadcast(edge), ["mix_id", "src"]).withColumn("copies", F.col("base") + F.when(F.col("bin").isNotNull() & (F.col("bin") >= F.col("first")), 1).otherwise(0))
    return out.where("copies > 0").select("mix_id", "doc_id", "src", "n_tokens", "copies"), plan


def shares(mixed: DataFrame, plan: list[tuple]) -> DataFrame:
    """What each source reached: target and actual tokens and shares, and whether its target can be met at all."""
    spark = mixed.sparkSession
    got = mixed.groupBy("mix_id", "src").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("actual_tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"), F.max("n_tokens").alias("largest"))
    p = spark.createDataFrame(plan, "mix_id int, source string, target_share double, max_repeats int, target_tokens double, most_tokens double, planned_tokens double")
    x = p.join(got, (p["mix_id"] == got["mix_id"]) & (p["source"] == got["src"]), "left").select(p["*"], F.coalesce("actual_tokens", F.lit(0)).alias("actual_tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce("largest", F.lit(0)).alias("largest_document"))
    all_ = x.groupBy("mix_id").agg(F.sum("actual_tokens").alias("_all"), F.sum("target_tokens").alias("_size"))
    return x.join(all_, "mix_id").select(
        "mix_id", "source", "target_share", "max_repeats", "target_tokens", "actual_tokens", "most_tokens", "documents", "most_copies", "largest_document",
        F.when(F.col("_all") > 0, F.col("actual_tokens") / F.col("_all")).otherwise(0.0).alias("actual_share"),
        F.when(F.col("_size") > 0, F.col("actual_tokens") / F.col("_size")).otherwise(0.0).alias("share_of_size"),
        (F.col("most_tokens") >= F.col("target_tokens")).alias("reachable"))
