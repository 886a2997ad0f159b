"""Whole-table checks against brute force on the generated tables, where these are there."""

import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, mixing, neardup, quality_rules, repeats, toxicity

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SF, "documents.parquet").exists(), reason="no generated tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_near_duplicates_of_a_table(spark, texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    shared = Counter((a, b) for ids in where.values() for n, a in enumerate(ids) for b in ids[n + 1 :])
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
    got = neardup.op2_minhash(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_repeats_of_a_table(spark, texts):
    raw = {i: (t or "").encode() for i, t in texts.items()}
    seen = Counter(hash(b[p : p + 400]) for b in raw.values() for p in range(len(b) - 399))
    got = {r.doc_id: r for r in repeats.op7_suffix_dedup(spark, SF).collect()}
    assert len(got) == len(raw)
    for i, b in raw.items():
        hit = np.zeros(len(b) + 1, np.int64)
        for p in range(len(b) - 399):
            if seen[hash(b[p : p + 400])] > 1:
                hit[p] += 1
                hit[p + 400 if p + 400 < len(hit) else -1] -= 1
        gone = np.cumsum(hit)[: len(b)] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        assert (got[i].n_bytes, got[i].n_removed, got[i].kept_text) == (len(b), int(gone.sum()), kept.decode("utf-8", "ignore")), i
        assert got[i].n_spans == int(gone[0] if len(b) else 0) + int((gone[1:] & ~gone[:-1]).sum())


def test_mixing_recomputed(spark):
    """Raking and the probabilities' scale by another implementation, over a dense array."""
    rows = mixing.op9_mixing(spark, SF).collect()
    axes = [sorted({r[d] for r in rows}) for d in mixing.DIMENSIONS]
    tokens = np.zeros([len(a) for a in axes])
    at = [tuple(a.index(r[d]) for a, d in zip(axes, mixing.DIMENSIONS, strict=True)) for r in rows]
    for r, i in zip(rows, at, strict=True):
        tokens[i] += r.n_tokens
    goals, raked, before = [], tokens.copy(), np.inf
    for k, d in enumerate(mixing.DIMENSIONS):
        m = tokens.sum(axis=tuple(j for j in range(3) if j != k))
        w = np.where(m > 0, m ** mixing.ALPHA[d], 0)
        goals.append(w / w.sum() * tokens.sum())
    while True:
        gap = 0.0
        for k, goal in enumerate(goals):
            m = raked.sum(axis=tuple(j for j in range(3) if j != k))
            f = np.where(m > 0, goal / np.where(m > 0, m, 1), 1.0)
            shape = [-1 if j == k else 1 for j in range(3)]
            raked = raked * f.reshape(shape)
            gap = max(gap, np.abs(np.where(raked > 0, f.reshape(shape) - 1, 0)).max())
        if gap <= 0.005 or gap > 0.99 * before:
            break
        before = gap
    ratio = np.where(tokens > 0, raked / np.where(tokens > 0, tokens, 1), 0)
    lo, hi = 0.0, 1e6
    for _ in range(200):  # the scale at which the expected tokens are the budget, by bisection
        c = (lo + hi) / 2
        lo, hi = (c, hi) if (tokens * np.minimum(1, ratio * c)).sum() < 0.6 * tokens.sum() else (lo, c)
    p = np.where(tokens > 0, np.minimum(1, ratio * lo), 1)
    assert all(r.probability == pytest.approx(p[i], rel=1e-6) for r, i in zip(rows, at, strict=True))


def test_fitted_lexicon_applied_again(spark, texts):
    """Scores of the whole table from the exported lexicon by plain search, without an automaton."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.select(F.col("doc_id").alias("k"), F.col("text").alias("t"))
    known = labels.where(~toxicity.held_out(F.col("doc_id"))).select(F.col("doc_id").alias("k"), F.col("toxic").alias("y"))
    lex = toxicity.learn_lexicon(rows, known)

    def weight(t):
        best, spared = {}, []
        for low in {toxicity.fold(t), toxicity.fold(t, True)}:
            starts = [i for i, c in enumerate(low) if c.isalnum() and (not i or not low[i - 1].isalnum())]
            for s in starts:
                for (e, whole), w in lex.entries.items():
                    if low.startswith(e, s) and (not whole or s + len(e) == len(low) or not low[s + len(e)].isalnum()):
                        best[s] = max(best.get(s, 0.0), w)
                spared += [(s, s + len(x)) for x in lex.exceptions if low.startswith(x, s) and (s + len(x) == len(low) or not low[s + len(x)].isalnum())]
        return sum(w for s, w in best.items() if not any(a <= s < b for a, b in spared))

    got = {r.doc_id: r.score for r in toxicity.op1_toxicity(spark, SF).collect()}
    for i, t in texts.items():
        p = toxicity.probability(weight(t or ""), max(1, len((t or "").split())), lex.calibration)
        assert got[i] == pytest.approx(float(p), abs=1e-9), i


def test_rules_applied_again_and_on_unseen_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.quality_rules(docs, labels).collect()
    for r in rows:
        v = {"n_words": r.n_words, "mean_word": r.word_chars / max(1, r.n_words), "symbol_share": r.n_symbols / max(1, r.word_chars), "repeat_share": r.n_repeat_words / max(1, r.n_words)}
        named = [c.split() for rule in r.rules.split(" ; ") if rule for c in rule.split(" and ")]
        if all(f in v for f, _, _ in named):
            hit = any(all((v[f] > float(x)) if op == ">" else (v[f] <= float(x)) for f, op, x in (c.split() for c in rule.split(" and "))) for rule in r.rules.split(" ; ") if rule)
            assert r.kept == (not r.base_failed and not hit)
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    seen = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels.where(half)).collect()}
    other = [(seen[r.doc_id].kept, r.quality) for r in labels.where(~half).collect() if r.doc_id in seen and not seen[r.doc_id].base_failed]
    right = sum(k == bool(q) for k, q in other) / len(other)
    assert right > 0.95, right


def test_languages_of_unseen_documents(spark):
    """Fitted on one half, judged by the text alone on the other."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null and length(text) > 40")
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    langs, model = langid.fit(docs.where(half))
    rows = docs.where(~half).select("doc_id", "lang", F.col("text").alias("t"))
    got = langid.text_evidence(rows, langs, model, 60.0, False).collect()
    right = sum(langs[int(np.argmax(r.ll))] == r.lang for r in got if r.letters) / sum(1 for r in got if r.letters)
    assert right > 0.97, right
