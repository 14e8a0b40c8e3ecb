"""Posteriors of hosts and paths against simulated sites and a plain recomputation."""

import math

import numpy as np

from weirlog.llm import site_quality as sq

SCORED = "doc_id bigint, host string, path string, l_quality double, l_toxic double"


def scored_of(spark, host, path, quality, toxic=None):
    quality = np.clip(quality, 0.01, 0.99)
    toxic = np.full(len(quality), 0.1) if toxic is None else np.clip(toxic, 0.01, 0.99)
    rows = [
        (i, h, p, math.log(a / (1 - a)), math.log(b / (1 - b)))
        for i, (h, p, a, b) in enumerate(zip(host, path, quality.tolist(), toxic.tolist(), strict=True))
    ]
    return spark.createDataFrame(rows, SCORED)


def strength_of(chance, effect):
    return sq.MOST if effect <= 0 else min(sq.MOST, max(sq.LEAST_STRENGTH, chance / effect))


def test_sites_that_do_not_differ_are_shrunk(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    one = scored_of(spark, [f"h{i}" for i in range(5000)], ["p"] * 5000, rng.beta(2, 2, 5000))
    chance, path, host = sq.variances(sq.sites(one)[2], "quality")
    assert strength_of(chance, host) == strength_of(chance, path) == sq.MOST
    moved = sq.posteriors(one).selectExpr("max(abs(host_quality - path_quality)) as d", "max(host_quality) - min(host_quality) as w").first()
    assert moved.w < 0.002
    ten = scored_of(spark, [f"h{i // 10}" for i in range(10000)], [f"p{i % 2}" for i in range(10000)], rng.beta(2, 2, 10000))
    chance, path, host = sq.variances(sq.sites(ten)[2], "quality")
    # ten documents move a host by less than a twentieth of what they show
    assert strength_of(chance, host) > 190 and strength_of(chance, path) > 95
    same = sq.sites(ten)[2]
    assert sq.variances(same, "toxic")[1:] == (0.0, 0.0)


def test_effects_of_hosts_and_paths_are_recovered(spark):
    rng = np.random.Generator(np.random.PCG64(5))
    host, path, p = [], [], []
    for h in range(500):
        of_host = rng.normal(0, 0.1)
        for q in range(int(rng.integers(3, 9))):
            mean, n = 0.5 + of_host + rng.normal(0, 0.07), int(rng.integers(1, 12))
            host += [f"h{h}"] * n
            path += [f"p{q}"] * n
            p += (mean + rng.normal(0, 0.06, n)).tolist()
    chance, of_path, of_host = sq.variances(sq.sites(scored_of(spark, host, path, np.array(p)))[2], "quality")
    for got, true in ((chance, 0.06**2), (of_path, 0.07**2), (of_host, 0.1**2)):
        assert abs(got / true - 1) < 0.2


def test_posteriors_against_a_plain_recomputation(spark):
    rng = np.random.Generator(np.random.PCG64(7))
    n = 600
    host = [None if i % 19 == 0 else f"h{int(x)}" for i, x in enumerate(rng.integers(0, 30, n))]
    path = [None if i % 23 == 0 else f"p{int(x)}" for i, x in enumerate(rng.integers(0, 4, n))]
    shift = np.array([0.0 if h is None else (int(h[1:]) % 5) * 0.12 for h in host])
    quality, toxic = 0.2 + shift + rng.uniform(0, 0.2, n), rng.beta(1, 6, n)
    scored = scored_of(spark, host, path, quality, toxic)
    rows = {r.doc_id: r for r in scored.collect()}
    got = {r.doc_id: r for r in sq.posteriors(scored).collect()}
    assert len(got) == n
    site = [(h or "", p or "") for h, p in zip(host, path, strict=True)]
    for t in sq.TARGETS:
        prob = [1 / (1 + math.exp(-rows[i][f"l_{t}"])) for i in range(n)]
        paths = {s: [prob[i] for i in range(n) if site[i] == s] for s in set(site)}
        hosts = {h: [prob[i] for i in range(n) if site[i][0] == h] for h in {s[0] for s in site}}
        mean = sum(prob) / n
        chance = sum(sum((x - np.mean(v)) ** 2 for x in v) for v in paths.values()) / (n - len(paths))
        squares = {h: sum(len(v) ** 2 for s, v in paths.items() if s[0] == h) for h in hosts}
        ss_path = sum(len(v) * (np.mean(v) - np.mean(hosts[s[0]])) ** 2 for s, v in paths.items())
        k1 = n - sum(squares[h] / len(v) for h, v in hosts.items())
        of_path = max(0.0, ss_path - (len(paths) - len(hosts)) * chance) / k1
        ss_host = sum(len(v) * (np.mean(v) - mean) ** 2 for v in hosts.values())
        k2 = sum(squares[h] / len(v) for h, v in hosts.items()) - sum(squares.values()) / n
        k3 = n - sum(len(v) ** 2 for v in hosts.values()) / n
        of_host = max(0.0, ss_host - (len(hosts) - 1) * chance - k2 * of_path) / k3
        for i in range(n):
            h = site[i][0]
            pull = strength_of(chance + of_path * squares[h] / len(hosts[h]), of_host)
            at_host = (pull * mean + sum(hosts[h])) / (pull + len(hosts[h]))
            pull = strength_of(chance, of_path)
            others = paths[site[i]]
            at_path = (pull * at_host + sum(others) - prob[i]) / (pull + len(others) - 1)
            logit = rows[i][f"l_{t}"] + sq.SITE_WEIGHT * (math.log(at_path / (1 - at_path)) - math.log(mean / (1 - mean)))
            assert abs(got[i][t] - 1 / (1 + math.exp(-logit))) < 1e-6
            if t == "quality":
                assert abs(got[i].host_quality - at_host) < 1e-6 and abs(got[i].path_quality - at_path) < 1e-6
