import numpy as np
import pytest
from pyspark.sql import functions as F

from laminara.llm import mixing as m
from tests.llm.helpers import empty, labels, odd, table


def expected(rows, weight):
    return np.array([sum(weight(r) * r.n_tokens * r[f"p_{d}"] for r in rows) for d in m.DOMAINS])


def test_targets_are_met(spark):
    sf = "/root/testdata/sf0.01"
    rows = m.op9_mixing(spark, sf).collect()
    assert len(rows) == table(spark, sf, "documents").count()
    total = sum(r.n_tokens for r in rows)
    got = expected(rows, lambda r: r.rate) / total
    assert np.abs(got - [m.TARGETS[d] for d in m.DOMAINS]).max() < 0.1 * min(m.TARGETS.values())
    assert all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) and abs(sum(r[f"p_{d}"] for d in m.DOMAINS) - 1) < 1e-9 for r in rows)
    split = lambda text: len([w for w in text.replace("\t", " ").split() if w])
    n = {r.doc_id: r.n_tokens for r in rows}
    assert all(n[d.doc_id] == split(d.text) for d in table(spark, sf, "documents").limit(50).collect())


def test_rates_are_the_least_squares():
    """Against a long plain projected gradient on the same cells, and the conditions of an optimum."""
    rng = np.random.default_rng(0)
    for trial in range(6):
        p, n = rng.dirichlet(np.ones(4) * 0.3, 30), rng.uniform(10, 100, 30)
        want = (n @ p).sum() * np.array([0.4, 0.3, 0.2, 0.1] if trial % 2 else [0.9, 0.1, 0.0, 0.0])
        a = n[:, None] * p
        for most in (None, 1.2):
            r = m.fit_rates(n, p, want, most)
            x = np.ones(30)
            for _ in range(30_000):
                x = np.clip(x - a @ (a.T @ x - want) / np.linalg.norm(a, 2) ** 2, 0, most)
            assert (r >= 0).all() and (most is None or (r <= most).all())
            assert ((a.T @ r - want) ** 2).sum() <= ((a.T @ x - want) ** 2).sum() + 1e-9 * (want**2).sum()
            slope = p @ (a.T @ r - want) / want.sum()
            free = (r > 0) & (r < (most or np.inf))
            assert np.abs(slope[free]).max(initial=0) < 1e-8 and slope[r <= 0].min(initial=0) > -1e-8


def test_held_out_domains(spark):
    """Fitted without a fifth of the labelled rows, the posteriors name the domain of that fifth, toxic ones of all languages too."""
    sf = "/root/testdata/sf0.1"
    docs, known = table(spark, sf, "documents"), m.labelled(table(spark, sf, "labels"))
    held = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    rows = m.mix(docs, table(spark, sf, "labels").where(~held)).join(known.where(held), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    best = [max(m.DOMAINS, key=lambda d: r[f"p_{d}"]) for r in rows]
    right = sum(b == r.domain for b, r in zip(best, rows, strict=True)) / len(rows)
    toxic = [(r.lang, b.endswith("toxic")) for b, r in zip(best, rows, strict=True) if r.domain.endswith("toxic")]
    print(f"held-out domains right: {right:.3f} of {len(rows)}; toxic found: {sum(t for _, t in toxic)} of {len(toxic)}")
    assert right > 0.9 and sum(t for _, t in toxic) > 0.85 * len(toxic)


@pytest.mark.parametrize("rows", [[], [(1, 1, 0), (6, 0, 1), (None, 1, 1), (8, None, 0)]])
def test_odd_rows(spark, rows):
    out = m.mix(odd(spark), labels(spark, rows)).collect()
    assert len(out) == 11 and all(np.isfinite(r.rate) for r in out)
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by[2].n_tokens == by[3].n_tokens == by[4].n_tokens == 0 and by[5].n_tokens == 40_001
    assert m.mix(empty(spark), labels(spark, rows)).count() == 0
    kept = m.mixed_rows(odd(spark), labels(spark, rows), kept=dict.fromkeys(m.DOMAINS, 1.0), max_rate=1.0)
    assert kept.columns == odd(spark).columns and kept.count() == 11
    more = m.mixed_rows(odd(spark).where("doc_id = 1"), labels(spark, rows), kept=dict.fromkeys(m.DOMAINS, 3.0))
    assert more.count() == 3
    clash = odd(spark).withColumns({c: F.lit("x") for c in ("doc", "coin", "f", "cell", "p", "place", "told", "size", "_copy", "_f")})
    got = m.mixed_rows(clash, labels(spark, rows), kept=dict.fromkeys(m.DOMAINS, 2.0))
    assert got.columns == clash.columns and got.count() == 22 and {r["doc"] for r in got.collect()} == {"x"}


def test_no_python_in_the_plan(spark, sf):
    plan = m.op9_mixing(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert F is not None
