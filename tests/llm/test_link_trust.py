"""URL filter: rules by a plain loop, propagation by dense matrices, and the checking SQL on pages that link to other hosts."""
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from lotwise.llm import link_trust as T
from lotwise.llm.queries import URL_RULES, URL_SQL


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split(r"[?#]", rest[len(host):])[0]


def rule(host, path):
    best = None
    for says, name in URL_RULES:
        head, tail = name.split("/", 1)
        if (host == head or host.endswith("." + head)) and path.startswith("/" + tail) and (best is None or len(name) > len(best[0])):
            best = (name, says)
    return best or (None, None)


def brute(rows):
    parts = [(i, *split(u), h) for i, u, h in rows]
    weight, seen = {}, {}
    for _, host, path, page in parts:
        seen.setdefault(host, []).append(rule(host, path)[1])
        for dst in {d.lower() for d in re.findall(r"href=\"?(?:https?:)?//([^/?#\"'\s>]+)", page or "")}:
            if host and dst != host:
                weight[host, dst] = weight.get((host, dst), 0) + 1
    for _, dst in weight:
        seen.setdefault(dst, [rule(dst, "/")[1]])
    hosts = sorted(h for h in seen if h)
    w = np.array([[weight.get((a, b), 0.0) for b in hosts] for a in hosts])
    out, into = w / np.maximum(w.sum(1, keepdims=True), 1), w / np.maximum(w.sum(0, keepdims=True), 1)
    t0 = np.array([np.mean([s == "allow" for s in seen[h]]) for h in hosts])
    d0 = np.array([np.mean([s == "block" for s in seen[h]]) for h in hosts])
    one = np.eye(len(hosts))
    t, d = 0.15 * np.linalg.solve(one - 0.85 * out.T, t0), 0.15 * np.linalg.solve(one - 0.85 * into, d0)
    score = {h: (a, b) for h, a, b in zip(hosts, t, d)}
    result = []
    for i, host, path, _ in parts:
        name, says = rule(host, path)
        a, b = score.get(host, (0, 0))
        result.append((i, host, path, name, says or ("block" if b >= 0.01 and b > a else "allow"), round(a, 6), round(b, 6)))
    return sorted(result, key=repr)


def pages(seed):
    rng = random.Random(seed)
    hosts = ["a.com", "www.example.com", "x.example.com", "b.net", "Farm.org", "spam.org", "good.io", "lone.io", "c.net"]
    rows = []
    for i in range(120):
        host = rng.choice(hosts)
        links = "".join(f'<a class="x" href="{rng.choice(["https:", "http:", ""])}//{rng.choice([h for h in hosts if h != "lone.io"] + ["only.linked.org", "net"])}/p">l</a>' if host in ("spam.org", "Farm.org", "good.io") or rng.random() < 0.2 else '<a href="/local">m</a>' for _ in range(rng.randint(0, 4)))
        if host == "spam.org":
            links = '<a href="http://b.net/es/1">s</a><A HREF=//c.net/fr/>t</A>'.replace("A HREF=", "a href=")
        rows.append((i, f"http://{host}/{rng.choice(['en/', 'es/', 'fr/', 'es', '', 'en/1?x=http://q'])}", links))
    return rows + [(200, None, "x"), (201, "no scheme/en/", None), (202, "http://", ""), (203, "https://EXAMPLE.com?en/", None), (203, "https://EXAMPLE.com?en/", None), (None, "a://b.net/fr/#x", None), (204, "http://b.net", "<a href='//"), (205, "ftp://notcom/", None)]


def test_judge_equals_brute_force(spark):
    for seed in (1, 2):
        rows = pages(seed)
        df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string").repartition(3)
        got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, round(r.trust, 6), round(r.distrust, 6)) for r in T.judge(df, URL_RULES).collect()), key=repr)
        want = brute(rows)
        assert got == want
        assert {v for _, h, _, r, v, _, _ in want if r is None} == {"allow", "block"}
        con = duckdb.connect()
        con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
        sql = con.execute(URL_SQL).fetchall()
        assert sorted(set(map(repr, ((a, b, c, d or None, e) for a, b, c, d, e in sql)))) == sorted(set(repr(r[:5]) for r in want))


def test_trust_runs_along_long_chains_and_round_cycles(spark):
    """Sixty hops from the seed, and a cycle that keeps all its mass but the damping."""
    chain = [(f"h{i}", f"h{i + 1}", 1.0) for i in range(60)] + [("p", "q", 1.0), ("q", "p", 1.0)]
    seeds = [("h0", 1.0, 0.0), ("p", 1.0, 0.0), ("h60", 0.0, 1.0)]
    got = {r.host: (r.trust, r.distrust) for r in T.propagate(spark.createDataFrame(chain, "src string, dst string, weight double"),
                                                               spark.createDataFrame(seeds, "host string, trust double, distrust double")).collect()}
    for i in range(61):
        assert got[f"h{i}"] == pytest.approx((0.15 * 0.85 ** i, 0.15 * 0.85 ** (60 - i)), abs=1e-8)
    assert got["p"][0] == pytest.approx(0.15 / (1 - 0.85 ** 2), abs=1e-8) and got["q"][0] == pytest.approx(0.15 * 0.85 / (1 - 0.85 ** 2), abs=1e-8)


def test_empty_table(spark):
    assert T.judge(spark.createDataFrame([], "page_id long, url string, html string"), URL_RULES).count() == 0
